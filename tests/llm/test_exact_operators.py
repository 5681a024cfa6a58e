"""Clusters, Merkle manifests and token counts against plain versions."""

import hashlib
import random
import zlib
from fractions import Fraction
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from tuturan.llm import bisector_clusters, merkle, token_counts
from tuturan.llm.queries import QUERIES, tokenizer_path

SMALL = "/root/testdata/sf0.001"
PIECES = tokenizer_path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_clusters(rows, k=40, rounds=5):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid hash), with Python integers."""
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v):
            kept.append((vec_id, [floor(256 * Fraction(float(x))) for x in v]))
    place = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=place)[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((apart(v, c), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        found = [nearest(v)[1] for _, v in kept]
        new = list(centroids)
        for c in set(found):
            own = [v for (_, v), f in zip(kept, found) if f == c]
            new[c] = [sum(x) // len(own) for x in zip(*own)]
        centroids = new
    last = [nearest(v) for _, v in kept]
    total = {c: sum(d for d, e in last if e == c) for _, c in last}
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(
        (str(i), c, d, total[c], sum(total.values()), hashes[c]) for (i, _), (d, c) in zip(kept, last)
    )


def clustered(spark, rows, kind="float"):
    vectors = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    for name in ("point", "cluster", "distance", "_place", "n"):
        vectors = vectors.withColumn(name, F.lit("own"))
    got = bisector_clusters.digest(vectors.repartition(5))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((str(r[0]), *r[1:]) for r in got.collect())


def test_clusters_are_those_of_plain_integers(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=64).astype("f4").tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]  # a third in one place
    rows += [(3, rows[7][1]), (3, rows[7][1]), (None, rows[8][1])]
    rows += [(400, None), (401, [1.0] * 63), (402, [0.0] * 64), (403, [None] + [1.0] * 63)]
    rows += [(404, [float("nan")] + [1.0] * 63), (405, [float("-inf")] + [1.0] * 63), (406, [])]
    assert clustered(spark, rows) == plain_clusters(rows)


def test_ties_of_centroids_go_to_the_smaller_number(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.integers(0, 2, size=64) / 256.0).tolist()) for i in range(90)]
    rows += [(200 + i, rows[i % 3][1]) for i in range(60)]
    rows += [(300, [-500_000.25] * 64), (301, [500_000.25] * 64)]
    assert clustered(spark, rows, "double") == plain_clusters(rows)


def test_few_and_no_vectors(spark):
    rows = [(5, [0.5] * 64), (6, [-0.25] * 64)]
    assert clustered(spark, rows) == plain_clusters(rows)
    assert clustered(spark, [(1, [0.5])]) == [] == clustered(spark, [])


def test_far_components_are_refused(spark):
    with pytest.raises(Exception, match="too large for exact distances"):
        clustered(spark, [(5, [1e30] * 64)])


def test_tournament_agrees_with_all_distances():
    rng = np.random.default_rng(7)
    centroids, points = rng.integers(-3, 4, (17, 6)), rng.integers(-3, 4, (5000, 6))
    all_pairs = ((points[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    game = bisector_clusters.Tournament(centroids)
    found = game.winners(points)
    assert (found == all_pairs.argmin(axis=1)).all()
    assert (game.distances(points, found) == all_pairs.min(axis=1)).all()
    with pytest.raises(ValueError):
        bisector_clusters._check_size(np.zeros((5000, 64), dtype=np.int64))


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    def leaf(r, more=0):
        doc, text, lang, source, n = r
        n = n if n is None else n + more
        values = [None if v is None else str(v) for v in (doc, source, lang, n, text)]
        return sha(*["-" if v is None else f"{len(v.encode())}:{v}" for v in values])

    def climb(nodes):
        """Root and, per leaf, (hash beside or '', is it left) from the bottom up."""
        ways, place = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for way, p in zip(ways, place):
                beside = p ^ 1
                way.append((nodes[beside] if beside < len(nodes) else "", bool(p & 1)))
            nodes = [sha(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
            place = [p >> 1 for p in place]
        return nodes[0], ways

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = (own, *climb([leaf(r) for r in own]))
    root, tops = climb([trees[g][1] for g in order])
    out = []
    for g, top in zip(order, tops):
        own, subroot, ways = trees[g]
        for r, way in zip(own, ways):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            acc = leaf(r, 1) if tampered else leaf(r)
            for beside, left in way + top:
                acc = sha(beside, acc) if left else sha(acc, beside)
            proof = sha(*[b for b, _ in way + top])
            out.append((str(r[0]), leaf(r), subroot, root, proof, acc, acc == root))
    return sorted(out)


def manifest(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    for name in ("leaf", "hash", "tree", "rank", "block", "kids", "_order", "path"):
        docs = docs.withColumn(name, F.lit(1))
    got = merkle.digest(docs.repartition(7))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((str(r[0]), *r[1:]) for r in got.collect())


def odd_documents(n):
    rng = random.Random(n)
    langs = ["en"] * 4 + [None, "de", "é", "", "zz"]
    rows = [(i * 3, f"text {i} 日本" * (i % 3), rng.choice(langs), f"s{i % 4}", i) for i in range(n)]
    rows += [(None, None, None, None, None), (None, "", "de", "", 0), (6, None, "lone", "s", None)]
    rows += [(9, "a", "en", "s", 1), (9, "a", "en", "s", 1), (9, "b", "en", "s", 1)]
    return rows


@pytest.mark.parametrize("n", [0, 1, 130])
def test_manifest_is_that_of_plain_hashing(spark, n):
    rows = odd_documents(n)
    got = manifest(spark, rows)
    assert got == plain_manifest(rows)
    assert any(not r[-1] for r in got) == any(not r[-1] for r in plain_manifest(rows))


def test_manifest_of_one_row_and_of_none(spark):
    row = [(4, "x", "en", "s", 1)]
    got = manifest(spark, row)
    assert got == plain_manifest(row) and got[0][1] == got[0][2] == got[0][3]
    assert manifest(spark, []) == []


def test_manifest_of_several_tiers(spark, monkeypatch):
    """Blocks of four: a hot group of 300 needs five tiers, 40 groups three."""
    monkeypatch.setattr(merkle, "DIGITS", 2)
    rows = [(i, f"t{i}", "hot" if i < 300 else f"g{i % 40:02}", "s", i) for i in range(420)]
    assert manifest(spark, rows) == plain_manifest(rows)


ODD_TEXTS = [
    None, "", " ", "  ", "a", " a", "a  b ", "▁a", "\n", "a\nb", "\n\n  x", "<s> </s>", "<0x0A>", "\x00",
    "a" * 60, "        x         ", "日本語テスト 😀😀 ok", "éèà ñ́", "===---*****", "x y　z\tw",
]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def some_texts(seed, n, most):
    rng = random.Random(seed)
    marks = "abcdehst  \n\t.,-=é日😀▁<>0123"
    return ["".join(rng.choice(marks) for _ in range(rng.randint(1, most))) for _ in range(n)]


def test_every_prefix_counts_as_the_library_does(library):
    known = token_counts.PrefixCounter(PIECES)
    for text in [t or "" for t in ODD_TEXTS] + some_texts(1, 300, 50):
        wanted = [len(library.encode(text[:i])) for i in range(len(text) + 1)]
        assert known.prefixes(text).tolist() == wanted, text


def test_chunks_and_uncut_vocabularies_give_the_same(library, monkeypatch):
    monkeypatch.setattr(token_counts, "CHUNK", 16)
    monkeypatch.setattr(token_counts, "LONG_WORD", 2)
    monkeypatch.setattr(token_counts, "WORDS_KEPT", 3)
    known, uncut = token_counts.PrefixCounter(PIECES), token_counts.PrefixCounter(PIECES)
    uncut.cuts = False
    for text in some_texts(2, 200, 90):
        wanted = library.encode(text)
        assert known.count(text) == uncut.count(text) == len(wanted), text


def test_counts_of_documents(spark, library):
    long = " ".join(some_texts(3, 400, 60)) + "y" * 100_000
    rows = [(i, t, 1) for i, t in enumerate(ODD_TEXTS + [long])] + [(0, None, 1), (None, "x y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    docs = docs.withColumn("n_bytes", F.lit("own")).withColumn("over_limit", F.lit(2))
    got = token_counts.token_counts(docs.repartition(3), PIECES)
    wanted = [(str(i), len((t or "").encode()), len(library.encode(t or ""))) for i, t, _ in rows]
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == sorted((*w, w[2] > 4096) for w in wanted)
    assert token_counts.token_counts(docs.where("false"), PIECES).count() == 0


def test_query_counts_all_documents(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r["n_tokens"] for r in QUERIES["op13_prefix_token_counts"](spark, SMALL).collect()}
    assert got == {r["doc_id"]: len(library.encode(r["text"] or "")) for r in docs}


def test_stored_counts_answer_truncation_and_budgets(spark, library, monkeypatch):
    texts = [t or "" for t in ODD_TEXTS] + some_texts(4, 40, 200) + ["word " * 200 + "x" * 100]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(token_counts, "BLOCK", 32)
    stored = token_counts.prefix_counts(docs, PIECES)
    asked = [(i, n) for i, t in enumerate(texts) for n in {0, 1, 31, 32, 33, 64, len(t), len(t) + 1}]
    asked += [(0, None), (0, -1), (9999, 1)]
    frame = spark.createDataFrame(asked, "doc_id long, n_chars long")
    for r in token_counts.count_at(stored, frame).collect():
        known = r["doc_id"] < len(texts) and r["n_chars"] is not None and 0 <= r["n_chars"] <= len(texts[r["doc_id"]])
        assert r["n_tokens"] == (len(library.encode(texts[r["doc_id"]][: r["n_chars"]])) if known else None), r
    for budget in (0, 1, 7, 10_000):
        for r in token_counts.longest_within(stored, budget).collect():
            counts = [len(library.encode(texts[r["doc_id"]][:n])) for n in range(len(texts[r["doc_id"]]) + 1)]
            best = max(n for n, c in enumerate(counts) if c <= budget)
            assert (r["n_chars"], r["n_tokens"]) == (best, counts[best])
