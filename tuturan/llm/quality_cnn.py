"""Quality classifier: a convolutional network over bytes, in numpy.

A text is cut into overlapping chunks that cover all of it. Learned filters, ``WIDTH`` bytes wide,
slide over a chunk and each keeps its largest response; a small layer turns these into chunk
features, and their mean, maximum and minimum over all chunks give one probability. Since a filter
sums one table entry per byte, scoring is table look-ups and additions.

The network is fitted on a bounded sample of labelled rows outside the held-out part: ``SAMPLE``
labels in order of a hash, of which texts of at most ``SAMPLE_BYTES`` bytes. Scores read whole texts
of any length and see nothing but the text.

A null or empty text is one chunk of padding and gets the score that the network gives it. Null
labels are not learned from; repeated rows get equal scores; a column named like a computed one is
replaced, others pass; an empty table gives no rows; without labels of both classes the score is 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tuturan.llm.common import append_arrow, free_name, held_out, utf8
from tuturan.llm.rule_trees import labelled

SAMPLE, SAMPLE_BYTES = 4000, 16_384
CHUNK, STRIDE, WIDTH, HOP = 512, 448, 8, 2
PLACES = (CHUNK - WIDTH) // HOP + 1
FILTERS, DIMENSIONS, HIDDEN = 16, 6, 12
BLOCK = 64  # chunks whose responses are in memory at once
GROUP_BYTES = 4 << 20
ACCEPT_FROM = 0.7


def chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of the texts, padded with zero bytes, and the number of chunks of each text."""
    counts = np.array([max(1, 1 + -(-(len(t) - CHUNK) // STRIDE)) for t in texts], dtype=np.int64)
    out = np.zeros((int(counts.sum()), CHUNK), np.uint8)
    at = 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        whole = np.zeros((n - 1) * STRIDE + CHUNK, np.uint8)
        whole[: len(text)] = np.frombuffer(text, np.uint8)
        out[at : at + n] = np.lib.stride_tricks.as_strided(whole, (n, CHUNK), (STRIDE, 1))
        at += n
    return out, counts


@dataclass
class Network:
    """Byte vectors, filters, the chunk layer and the last layer."""

    vectors: np.ndarray  # 256 x DIMENSIONS
    filters: np.ndarray  # WIDTH x DIMENSIONS x FILTERS
    bias: np.ndarray
    layer: np.ndarray  # FILTERS x HIDDEN
    layer_bias: np.ndarray
    last: np.ndarray  # 3 * HIDDEN
    last_bias: np.ndarray

    def tables(self) -> np.ndarray:
        return np.matmul(self.vectors[None], self.filters).astype(np.float32)

    def largest(self, parts: np.ndarray, places: bool = False):
        """The largest response of every filter in each chunk, and where it is."""
        tables = self.tables()
        top = np.empty((len(parts), FILTERS), np.float32)
        where = np.empty((len(parts), FILTERS), np.int64) if places else None
        for a in range(0, len(parts), BLOCK):
            block = parts[a : a + BLOCK]
            sums = np.zeros((len(block), PLACES, FILTERS), np.float32)
            for k in range(WIDTH):
                sums += tables[k].take(block[:, k : k + HOP * PLACES : HOP][:, :PLACES], axis=0)
            if places:
                where[a : a + BLOCK] = sums.argmax(1)
            top[a : a + BLOCK] = sums.max(1)
        return top, where

    def combine(self, top: np.ndarray, counts: np.ndarray):
        """Chunk features and the logit of every text."""
        hidden = np.tanh((top + self.bias) @ self.layer + self.layer_bias)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        mean = np.add.reduceat(hidden, starts) / counts[:, None]
        high, low = np.maximum.reduceat(hidden, starts), np.minimum.reduceat(hidden, starts)
        pooled = np.concatenate([mean, high, low], 1)
        return hidden, pooled, pooled @ self.last + self.last_bias[0]

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 for every text, groups of texts at a time."""
        out, a = np.empty(len(texts)), 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and (b == a or size + len(texts[b]) <= GROUP_BYTES):
                size += len(texts[b])
                b += 1
            parts, counts = chunks(texts[a:b])
            logits = self.combine(self.largest(parts)[0], counts)[2]
            out[a:b] = 1 / (1 + np.exp(-np.clip(logits, -60, 60)))
            a = b
        return out


def new_network(seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, by=1.0: rng.normal(0, by, shape)
    return Network(
        draw(256, DIMENSIONS, by=0.5),
        draw(WIDTH, DIMENSIONS, FILTERS, by=0.3),
        np.zeros(FILTERS),
        draw(FILTERS, HIDDEN, by=0.3),
        np.zeros(HIDDEN),
        draw(3 * HIDDEN, by=0.3),
        np.zeros(1),
    )


def _gradients(net: Network, parts, counts, labels) -> list[np.ndarray]:
    top, where = net.largest(parts, True)
    hidden, pooled, logits = net.combine(top, counts)
    n = len(labels)
    d_logit = (1 / (1 + np.exp(-np.clip(logits, -60, 60))) - labels) / n
    d_pool = d_logit[:, None] * net.last[None]
    owner = np.repeat(np.arange(n), counts)
    d_hidden = d_pool[owner, :HIDDEN] / counts[owner, None]
    for part, pick in ((1, pooled[:, HIDDEN : 2 * HIDDEN]), (2, pooled[:, 2 * HIDDEN :])):
        hit = hidden == pick[owner]
        ties = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(counts)[:-1]]), dtype=float)
        share = d_pool[:, part * HIDDEN : (part + 1) * HIDDEN] / ties
        d_hidden = d_hidden + hit * share[owner]
    d_in = d_hidden * (1 - hidden**2)
    d_top = d_in @ net.layer.T
    d_vectors, d_filters = np.zeros_like(net.vectors), np.zeros_like(net.filters)
    rows = np.arange(len(parts))[:, None]
    for k in range(WIDTH):
        code = parts[rows, where * HOP + k].astype(np.int64) * FILTERS + np.arange(FILTERS)
        d_table = np.bincount(code.ravel(), d_top.ravel(), 256 * FILTERS).reshape(256, FILTERS)
        d_vectors += d_table @ net.filters[k].T
        d_filters[k] = net.vectors.T @ d_table
    return [
        d_vectors,
        d_filters,
        d_top.sum(0),
        (top + net.bias).T @ d_in,
        d_in.sum(0),
        pooled.T @ d_logit,
        np.array([d_logit.sum()]),
    ]


def fit_network(
    texts: list[bytes], labels: np.ndarray, steps: int = 1200, batch: int = 48, rate: float = 0.01, seed: int = 7
) -> Network:
    """Adam on the log loss for at least this many steps, the rate falling to zero."""
    net = new_network(seed)
    if not len(labels) or labels.min() == labels.max():
        net.last[:] = 0
        net.last_bias[0] = 40.0 if not len(labels) or labels[0] == 1 else -40.0
        return net
    names = list(net.__dataclass_fields__)
    first = [np.zeros_like(getattr(net, x)) for x in names]
    second = [np.zeros_like(getattr(net, x)) for x in names]
    rng, step = np.random.default_rng(seed), 0
    epochs = -(-steps // -(-len(texts) // batch))
    total = epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(texts), batch):
            own = order[a : a + batch]
            parts, counts = chunks([texts[i] for i in own])
            step += 1
            pace = rate * (1 - step / (total + 1))
            for k, (name, g) in enumerate(
                zip(names, _gradients(net, parts, counts, labels[own]), strict=True)
            ):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                fix = first[k] / (1 - 0.9**step), second[k] / (1 - 0.999**step)
                value = getattr(net, name)
                value -= pace * fix[0] / (np.sqrt(fix[1]) + 1e-8)
    return net


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """A network from the labelled rows among the documents."""
    rows = labelled(docs, labels, sample, F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.where(F.octet_length("text") <= SAMPLE_BYTES).limit(2 * sample)
    got = sorted((t.encode(), q) for q, t in rows.toPandas().itertuples(index=False, name=None))
    return fit_network([t for t, _ in got], np.array([q for _, q in got], dtype=np.float64))


def _scores(net: Network):
    return lambda: lambda batch: [pa.array(net.score(utf8(batch)))]


def score(docs: DataFrame, net: Network, keep: list[str] | None = None) -> DataFrame:
    """Documents with ``score``, the chance that their label is 1, and ``predicted``."""
    scored = append_arrow(docs, [("score", T.DoubleType())], _scores(net), keep)
    return scored.withColumn("predicted", (F.col("score") >= ACCEPT_FROM).cast("int"))


def digest(docs: DataFrame, net: Network) -> DataFrame:
    chosen = docs.select("doc_id", "text")
    return score(chosen, net, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, net: Network) -> DataFrame:
    """The documents that the network accepts, with just their own columns."""
    name = free_name(docs, "quality_score")
    scored = append_arrow(docs, [(name, T.DoubleType())], _scores(net))
    return scored.where(F.col(name) >= ACCEPT_FROM).drop(name)
