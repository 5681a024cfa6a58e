"""Quality rules: document statistics judged by gradient-boosted trees in numpy node arrays.

The statistics are counted over the whole text. The trees are fitted on a bounded sample of labelled
rows (``SAMPLE`` rows in order of a hash); splits that would break a monotonic constraint are never
taken and child values are kept within bounds, so that more symbols, more repeated lines or more
repeated words never raise a score. A fitted forest is six flat arrays and scores a batch of rows at
once.

A null or empty text has no words: its counts are 0 and it fails the base rule. Null labels are not
learned from; repeated rows are scored each on its own; a column that is named like a computed one is
replaced, other columns pass; an empty table gives no rows; without labels of both classes every
probability is the share of label 1 (1 where there is no label), so only the base rule decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tuturan.llm.common import append_arrow, free_name, held_out, utf8

SAMPLE = 4000  # labelled rows that the trees are fitted on
WINDOW = 5
MIN_WORDS, REPEAT_PERCENT = 10, 20
KEEP_FROM = 0.5

SYMBOLS = b"#*$%&|<>"
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
UPPER = np.arange(65, 91)
DIGIT = np.arange(48, 58)
SYMBOL = np.frombuffer(SYMBOLS, np.uint8)

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

# Name of each statistic and the sign of its effect on the score: 0 is free.
FEATURES = {
    "log_words": 0,
    "mean_word": 0,
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "distinct_share": 0,
    "upper_share": 0,
    "digit_share": 0,
    "shout_per_word": 0,
    "stop_per_word": 0,
    "words_per_line": 0,
    "next_same_share": -1,
    "non_ascii_share": 0,
}


def repeated_windows(ids: np.ndarray, kinds: int, window: int = WINDOW) -> int:
    """Words that lie in a window of words found twice or more; exact, without hashing."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    key, reach = ids[:n].astype(np.int64), kinds
    for k in range(1, window):
        if reach * kinds >= 1 << 62:
            distinct, key = np.unique(key, return_inverse=True)
            reach = len(distinct)
        key = key * kinds + ids[k : k + n]
        reach *= kinds
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + window, np.int64)
    at = np.nonzero(twice)[0]
    edge[at] += 1
    edge[at + window] -= 1
    return int(np.count_nonzero(np.cumsum(edge)))


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """The base counts of a text and the statistics that the trees see."""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = len(joined) - int(hist[128:192].sum())
    symbols = int(hist[SYMBOL].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    kinds: dict[bytes, int] = {}
    ids = np.fromiter((kinds.setdefault(w, len(kinds)) for w in words), np.int64, n)
    repeated = repeated_windows(ids, max(1, len(kinds)))
    per, letters = max(1, n), max(1, chars)
    return [n, chars, symbols, dup_lines, repeated], [
        float(np.log1p(n)),
        chars / per,
        symbols / per,
        dup_lines / max(1, len(lines)),
        repeated / per,
        len(kinds) / per,
        float(hist[UPPER].sum()) / letters,
        float(hist[DIGIT].sum()) / letters,
        float(hist[33]) / per,
        float(hist[46]) / per,
        n / max(1, len(lines)),
        float(np.count_nonzero(ids[1:] == ids[:-1])) / per,
        float(hist[192:].sum()) / letters,
    ]


@dataclass
class Forest:
    """Nodes of all trees in flat arrays; a leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 for every row of statistics."""
        total = np.full(len(rows), self.base)
        at = np.arange(len(rows))
        for root in self.roots:
            node = np.full(len(rows), root)
            for _ in range(self.depth):
                low = rows[at, self.feature[node]] <= self.threshold[node]
                node = np.where(low, self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit_trees(
    rows: np.ndarray,
    labels: np.ndarray,
    signs: np.ndarray,
    trees: int = 60,
    depth: int = 3,
    rate: float = 0.15,
    bins: int = 48,
    ridge: float = 2.0,
    least: float = 1.0,
) -> Forest:
    """Boosted trees on the log loss, with histogram splits and monotonic constraints."""
    n, width = rows.shape
    share = (labels.sum() + 1) / (n + 1) if n else 1.0
    nodes: list[list[float]] = []
    roots: list[int] = []
    one_sided = n == 0 or labels.min() == labels.max()
    base = float(np.log(share / max(1 - share, 1e-9))) if not one_sided else 20.0 * (share >= 0.5)
    if not one_sided:
        cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
        coded = np.stack([np.searchsorted(c, rows[:, f], "left") for f, c in enumerate(cuts)], 1)
        margin = np.full(n, base)

    def weight(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + ridge), low, high))

    def gain(g, h, v):
        return -(g * v + 0.5 * (h + ridge) * v * v)

    def grow(own: np.ndarray, level: int, low: float, high: float) -> int:
        g, h = grad[own].sum(), hess[own].sum()
        at = len(nodes)
        value = weight(g, h, low, high)
        nodes.append([0, np.inf, at, at, rate * value])
        best = (1e-6, None)
        if level < depth and len(own) > 1:
            for f in range(width):
                k = len(cuts[f]) + 1
                gl = np.cumsum(np.bincount(coded[own, f], grad[own], k))[:-1]
                hl = np.cumsum(np.bincount(coded[own, f], hess[own], k))[:-1]
                vl = np.clip(-gl / (hl + ridge), low, high)
                vr = np.clip(-(g - gl) / (h - hl + ridge), low, high)
                won = gain(gl, hl, vl) + gain(g - gl, h - hl, vr) - gain(g, h, value)
                ok = (hl >= least) & (h - hl >= least) & (signs[f] * (vr - vl) >= 0)
                won = np.where(ok, won, 0)
                if len(won) and won.max() > best[0]:
                    c = int(won.argmax())
                    best = (float(won[c]), (f, c, vl[c], vr[c]))
        if best[1]:
            f, c, vl, vr = best[1]
            goes = coded[own, f] <= c
            middle = (vl + vr) / 2
            bounds = {0: (low, high, low, high), 1: (low, middle, middle, high)}
            bounds[-1] = (middle, high, low, middle)
            a, b, d, e = bounds[int(signs[f])]
            left = grow(own[goes], level + 1, a, b)
            right = grow(own[~goes], level + 1, d, e)
            nodes[at] = [f, cuts[f][c], left, right, 0.0]
        return at

    for _ in range(0 if one_sided else trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - labels, p * (1 - p)
        first = len(nodes)
        roots.append(grow(np.arange(n), 0, -np.inf, np.inf))
        margin += _flat(nodes, [first], depth, 0.0).raw(rows)
    return _flat(nodes, roots, depth, base).forest()


class _flat:
    def __init__(self, nodes, roots, depth, base):
        a = np.array(nodes, dtype=np.float64).reshape(-1, 5)
        self.parts = (a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4])
        self.roots, self.depth, self.base = np.array(roots, dtype=int), depth, base

    def forest(self) -> Forest:
        return Forest(*self.parts, self.roots, self.depth, self.base)

    def raw(self, rows: np.ndarray) -> np.ndarray:
        p = np.clip(self.forest().score(rows), 1e-300, 1 - 1e-16)
        return np.log(p / (1 - p))


def with_statistics(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Documents with their base counts and the statistics of the trees."""

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            pairs = [statistics(x) for x in utf8(batch)]
            counts = np.array([c for c, _ in pairs], dtype=np.int64).reshape(-1, len(COUNTS))
            rows = pa.array([r for _, r in pairs], pa.list_(pa.float64()))
            return [pa.array(counts[:, k]) for k in range(len(COUNTS))] + [rows]

        return work

    fields = [(c, T.LongType()) for c in COUNTS] + [("statistics", T.ArrayType(T.DoubleType()))]
    return append_arrow(docs, fields, make, keep)


def labelled(docs: DataFrame, labels: DataFrame, sample: int, *columns: str) -> DataFrame:
    """A sample of labelled documents outside the held-out part, at most ``sample`` labels."""
    chosen = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("quality", *columns)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """Trees from the labelled rows among the documents."""
    rows = with_statistics(labelled(docs, labels, sample, "doc_id", "text"), ["quality"])
    got = rows.select("quality", "statistics").limit(2 * sample).toPandas()
    x = np.array(got["statistics"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return fit_trees(x, got["quality"].to_numpy(np.float64), np.array([*FEATURES.values()]))


def judge(docs: DataFrame, forest: Forest, keep: list[str] | None = None) -> DataFrame:
    """Documents with counts, ``base_failed``, ``probability`` and ``kept``."""

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            pairs = [statistics(x) for x in utf8(batch)]
            counts = np.array([c for c, _ in pairs], dtype=np.int64).reshape(-1, len(COUNTS))
            rows = np.array([r for _, r in pairs], dtype=np.float64).reshape(-1, len(FEATURES))
            n, repeated = counts[:, 0], counts[:, 4]
            failed = (n < MIN_WORDS) | (100 * repeated > REPEAT_PERCENT * n)
            chance = forest.score(rows)
            return [pa.array(counts[:, k]) for k in range(len(COUNTS))] + [
                pa.array(failed),
                pa.array(chance),
                pa.array(~failed & (chance >= KEEP_FROM)),
            ]

        return work

    fields = [(c, T.LongType()) for c in COUNTS] + [
        ("base_failed", T.BooleanType()),
        ("probability", T.DoubleType()),
        ("kept", T.BooleanType()),
    ]
    return append_arrow(docs, fields, make, keep)


def accepted(docs: DataFrame, forest: Forest) -> DataFrame:
    """The documents that the rules keep, with just their own columns."""
    flag = free_name(docs, "rules_kept")

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            pairs = [statistics(x) for x in utf8(batch)]
            rows = np.array([r for _, r in pairs], dtype=np.float64).reshape(-1, len(FEATURES))
            good = forest.score(rows) >= KEEP_FROM
            for k, (c, _) in enumerate(pairs):
                good[k] &= c[0] >= MIN_WORDS and 100 * c[4] <= REPEAT_PERCENT * c[0]
            return [pa.array(good)]

        return work

    return append_arrow(docs, [(flag, T.BooleanType())], make).where(F.col(flag)).drop(flag)
