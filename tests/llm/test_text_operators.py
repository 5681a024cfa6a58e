"""Token files, packing, rules, network, fingerprints and language models against brute force."""

import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tuturan.llm import dac_output, lm_difference, packing, quality_cnn, rule_trees, simhash
from tuturan.llm.components import components
from tuturan.llm.queries import tokenizer_path
from tuturan.llm.tokens import Encoder

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
ODD = [
    None,
    "",
    " ",
    "\n",
    "one two",
    "one two",
    "tabs\tand  runs \n\n\n of   space   here ",
    "</s><|endoftext|> it's don't 3.14% naïve über straße 漢字 😀 x" * 3,
    "word " * 3000,
    "x" * 5000,
    "a b c d e f g h i j k l",
]


def documents(spark, values, extra=False):
    rows = [(k, t, None if k == 3 else f"s{k % 3}") for k, t in enumerate(values)]
    rows.append((None, "no id at all", None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    if extra:
        from pyspark.sql import functions as F

        for c in ("score", "kept", "start", "print", "src", "near_print", "rules_kept", "quality_score", "row"):
            docs = docs.withColumn(c, F.lit(c))
    return docs


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, ODD)


@pytest.fixture(scope="module")
def encoder():
    return Encoder(tokenizer_path())


def plain(encoder, text):
    return encoder.library.encode(text or "", add_special_tokens=False).ids


PIECES = st.sampled_from([" ", "\n", "\t", "  ", "\n\n", "a", "The", "don't", "'s", "é", "ß", "7", "!!", "###", "|", "漢", " ,", " ", " ", "<|endoftext|>", "x'", "\r"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=14))
def test_pieces_give_the_librarys_ids(parts):
    text = "".join(parts)
    own = test_pieces_give_the_librarys_ids.__dict__.setdefault("e", Encoder(tokenizer_path(), kept=8))
    assert np.frombuffer(own.ids(text), "<u4").tolist() == plain(own, text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500))
def test_codes_give_back_every_id(ids):
    codes = dac_output.Codes(dac_output.encode(np.array(ids, np.uint32)))
    assert codes.run(0, len(ids)).tolist() == ids
    assert [codes[i] for i in range(0, len(ids), 37)] == ids[::37]
    assert codes.run(len(ids) // 3, len(ids) // 2).tolist() == ids[len(ids) // 3 :][: len(ids) // 2]


def test_files_hold_all_documents_in_order(spark, odd, encoder, tmp_path):
    path = str(tmp_path / "ids")
    dac_output.write_ids(odd, path, tokenizer_path(), 0, segment=1000)
    got = sorted(dac_output.read_documents(spark, path).collect(), key=lambda r: r["start"])
    want, at, stream = [], 0, []
    for key, text in [(None, "no id at all"), *enumerate(ODD)]:
        ids = [*plain(encoder, text), 0]
        want.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at, stream = at + len(ids), stream + ids
    assert [tuple(r) for r in got] == want
    assert [dac_output.token_at(spark, path, k) for k in (0, 17, at - 1, at)] == [stream[0], stream[17], 0, None]
    empty = str(tmp_path / "none")
    dac_output.write_ids(odd.where("false"), empty, tokenizer_path(), 0)
    assert dac_output.read_documents(spark, empty).count() == 0


def test_packing_keeps_every_piece_and_fills(spark, odd, encoder):
    pieces, placed = packing.pack(odd, tokenizer_path(), 2, 64)
    rows = sorted(packing.digest(pieces, placed).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    total = sum(len(plain(encoder, t)) + 1 for t in [*ODD, "no id at all"])
    assert sum(r["length"] for r in rows) == total
    room = {}
    for r in rows:
        assert r["offset"] == room.get(r["sequence_id"], 0)
        room[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(room.values()) <= 64 and len(room) <= -(-total // 64) + 1
    ids = np.array([*plain(encoder, ODD[8]), 2], "<u4")
    own = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == 8)
    assert own == [(k, a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(packing.cut(len(ids), 64))]
    joined = packing.sequences(pieces, placed).collect()
    assert sum(len(r["ids"]) for r in joined) == 4 * total and all(len(r["ids"]) == 4 * r["length"] for r in joined)
    none = packing.pack(odd.where("false"), tokenizer_path(), 2, 64)
    assert packing.digest(*none).count() == 0


def test_swaps_only_raise_the_squared_fill():
    rng = np.random.default_rng(1)
    lengths = rng.integers(20, 60, 300)
    first = packing.best_fit(lengths, 100)
    last = packing.swap_search([list(b) for b in first], lengths, 100)
    assert sorted(i for b in last for i in b) == list(range(300))
    squares = lambda bins: sum(int(lengths[b].sum()) ** 2 for b in bins)
    assert squares(last) >= squares(first) and len(last) <= len(first)
    assert max(lengths[b].sum() for b in last) <= 100


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:k] for k, x in enumerate(lines)), len(hit)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é", "#x", " ", " ", "\n", "\t", "a b a b a b ", " "]), max_size=60))
def test_rule_counts(parts):
    text = "".join(parts)
    assert rule_trees.statistics(text.encode())[0] == brute_counts(text)


def test_long_windows_are_exact_with_many_words():
    ids = np.concatenate([np.arange(20_000), np.arange(100, 110), np.arange(50)])
    assert rule_trees.repeated_windows(ids, 20_000) == 10 + 10 + 50 + 50 - 0


def labelled(spark):
    return spark.read.parquet(f"{MIDDLE}/documents.parquet"), spark.read.parquet(f"{MIDDLE}/labels.parquet")


def test_trees_are_right_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    forest = rule_trees.fit(docs, labels)
    rows = rule_trees.judge(docs, forest, ["doc_id"]).join(labels, "doc_id").toPandas()
    own = rows[[zlib.crc32(str(i).encode()) % 4 == 2 for i in rows["doc_id"]]]
    assert ((own["probability"] >= 0.5) == (own["quality"] == 1)).mean() > 0.95
    x = np.random.default_rng(0).random((200, len(rule_trees.FEATURES)))
    for f, (name, sign) in enumerate(rule_trees.FEATURES.items()):
        if sign:
            more = x.copy()
            more[:, f] += 0.3
            assert (sign * (forest.score(more) - forest.score(x)) >= -1e-12).all(), name


def test_network_is_right_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    net = quality_cnn.fit(docs, labels)
    rows = quality_cnn.digest(docs, net).join(labels, "doc_id").toPandas()
    own = rows[rows["held_out"]]
    assert (own["predicted"] == own["quality"]).mean() > 0.9
    assert own["score"].between(0, 1).all()


def test_chunks_cover_whole_texts():
    text = bytes(range(256)) * 40
    parts, counts = quality_cnn.chunks([b"", text, text[:512]])
    assert counts.tolist() == [1, 1 + -(-(len(text) - 512) // 448), 1]
    back = b"".join(p[: quality_cnn.STRIDE].tobytes() for p in parts[1:-1])
    assert back[: len(text)] == text[: len(back)] and len(back) + quality_cnn.CHUNK >= len(text)


def test_gradients_follow_the_loss():
    rng = np.random.default_rng(3)
    net = quality_cnn.new_network(3)
    texts, labels = [bytes(rng.integers(0, 256, n).tolist()) for n in (30, 700, 1200)], np.array([1.0, 0.0, 1.0])
    parts, counts = quality_cnn.chunks(texts)
    grads = quality_cnn._gradients(net, parts, counts, labels)

    def loss():
        z = net.combine(net.largest(parts)[0].astype(float), counts)[2]
        return float(np.mean(np.logaddexp(0, z) - labels * z))

    for name, g in zip(net.__dataclass_fields__, grads, strict=True):
        if name in ("vectors", "filters"):
            continue  # single precision tables
        value = getattr(net, name).reshape(-1)
        for k in range(0, len(value), max(1, len(value) // 5)):
            old, e = value[k], 1e-4
            value[k] = old + e
            up = loss()
            value[k] = old - e
            down = loss()
            value[k] = old
            assert abs((up - down) / (2 * e) - np.asarray(g).reshape(-1)[k]) < 1e-4, name


def test_models_without_labels_and_odd_rows(spark):
    docs = documents(spark, ODD, extra=True)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    forest, net = rule_trees.fit(docs, none), quality_cnn.fit(docs, none)
    judged = rule_trees.judge(docs, forest)
    assert judged.count() == len(ODD) + 1
    assert {r["doc_id"] for r in judged.where("kept").collect()} == {10}
    assert quality_cnn.score(docs, net).where("score = 1").count() == len(ODD) + 1
    assert quality_cnn.accepted(docs, net).columns == docs.columns
    assert rule_trees.accepted(docs, forest).columns == docs.columns
    assert rule_trees.accepted(docs.where("false"), forest).count() == 0


def brute_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(pairs, nodes):
    root = {v: v for v in nodes}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {v: find(v) for v in nodes}


def test_fingerprints_and_components(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows += [(1000 + k, t) for k, t in enumerate(ODD)] + [(2000, rows[5][1] + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {i: brute_fingerprint(t) for i, t in rows}
    ids = sorted(prints)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 4]
    want = reachable(pairs, ids)
    for tile in (40, simhash.TILE):
        got = simhash.link(docs, tile=tile).collect()
        assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in ids}
    kept = simhash.one_of_each(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_tile_comparison_is_exact():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2**64, 1500, dtype=np.uint64)
    near = x[:300] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    x = simhash._ordered(np.unique(np.concatenate([x, near])))
    a, b = simhash.compare(x[:900], x[900:])
    c, d = simhash.compare(x, None)
    every = [(i, j) for i in range(len(x)) for j in np.nonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= 4)[0] + i + 1]
    nodes = range(len(x))
    across = [(i, j) for i, j in every if i < 900 <= j]
    assert reachable(zip(a.tolist(), b.tolist()), nodes) == reachable(across, nodes)
    assert reachable(zip(c.tolist(), d.tolist()), nodes) == reachable(every, nodes)


def test_one_of_each_with_odd_rows(spark):
    docs = documents(spark, ODD, extra=True)
    docs = docs.unionByName(docs)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    assert got.count((True, 0)) == 1 and (False, 0) in got and len(got) == len(set(got))
    assert simhash.one_of_each(docs.where("false")).count() == 0
    assert simhash.link(docs.where("false")).count() == 0


def test_one_of_each_keeps_a_row_of_every_group(spark):
    """One id with texts of several groups, whatever the partitions; the least content of copies stays."""
    far = [" ".join(f"{w}{i}" for i in range(60)) for w in ("satu", "dua", "tiga", "empat")]
    rows = [(1, far[0], "a"), (1, far[1], "b"), (2, far[1], "c"), (2, far[2], "d"), (3, far[2], "e"), (None, far[3], "f"), (None, far[2], "g")]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, source string")
    results = []
    for n in (1, 4):
        kept = simhash.one_of_each(docs.repartition(n, "source")).collect()
        results.append(sorted(map(str, kept)))
        assert sorted(r["text"] for r in kept) == sorted(far)
        assert {(r["doc_id"], r["text"]) for r in kept} == {(1, far[0]), (1, far[1]), (2, far[2]), (None, far[3])}
    assert results[0] == results[1]


def test_components_of_a_long_path_and_stars(spark):
    path = [(i, i + 1) for i in range(200)]
    stars = [(1000, 1000 + k) for k in range(1, 300)]
    rows = path + stars + [(7, 7), (None, 3), (5, None)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert len(got) == 501 and len(set(got.values())) == 2 and got[0] == got[200] and got[1000] == got[1299]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_scores(rows, good):
    """(id, tokens, target loss, background loss) with dictionaries of real words and pairs."""
    from collections import Counter
    from math import log

    said = [(i, (t or "").encode().lower().split()) for i, t in rows]
    picked = lambda i: i in good and zlib.crc32(str(i).encode()) % 4 != 2

    def counted(words):
        before = [None, *words[:-1]]
        return Counter(words), Counter(before[: len(words)]), Counter(zip(before, words))

    totals = [[Counter(), Counter(), Counter()] for _ in range(2)]
    for i, words in said:
        for k in [1] + [0] * picked(i):
            for total, own in zip(totals[k], counted(words)):
                total.update(own)
    sizes = [sum(t[0].values()) for t in totals]
    scale = [1.0, sizes[0] / sizes[1] if sizes[0] and sizes[1] else 1.0]
    vocabulary, flat = max(1, len(totals[1][0])), 0.5 * min(1.0, scale[1])
    out = []
    for i, words in said:
        own, losses = counted(words), []
        for k in range(2):
            less = scale[k] if k or picked(i) else 0.0
            of = lambda j, gram: max(0.0, totals[k][j][gram] * scale[k] - less * own[j][gram])
            size, loss = max(0.0, sizes[k] * scale[k] - less * len(words)), 0.0
            for before, word in zip([None, *words], words):
                single = (of(0, word) + flat) / (size + flat * vocabulary)
                loss -= log((of(2, (before, word)) + 50.0 * single) / (of(1, before) + 50.0))
            losses.append(loss / len(words) if words else 0.0)
        out.append((i, len(words), *losses))
    return out


@pytest.mark.parametrize("sizes", [{}, {"CHUNK_BYTES": 200, "PART_BYTES": 64, "TEXT_BYTES": 16, "WORDS_KEPT": 3}])
def test_language_models_are_those_of_plain_counts(spark, monkeypatch, sizes):
    """In one chunk and part, and in many, with texts cut into pieces."""
    for name, value in sizes.items():
        monkeypatch.setattr(lm_difference, name, value)
    rng = random.Random(8)
    words = ["a", "B", "é", "don't", "x,", "日本", "Word"] + [f"w{i}" for i in range(30)]
    rows = [(i, rng.choice([" ", "\n", "  "]).join(rng.choice(words) for _ in range(rng.randrange(40)))) for i in range(60)]
    rows += [(3, rows[7][1]), (3, rows[7][1]), (None, "a b a b"), (None, None), (70, ""), (71, " \n ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("chunk", "part", "target", "background", "is_target", "score"):
        docs = docs.withColumn(name, F.lit("own"))
    good = set(range(0, 60, 3))
    labels = spark.createDataFrame([(i, int(i in good)) for i in range(60)] + [(None, 1), (3, 1)], "doc_id long, quality int")
    got = lm_difference.difference(docs.repartition(4), labels).collect()
    told = sorted((str(r["doc_id"]), r["n_tokens"], round(r["target_loss"], 9), round(r["background_loss"], 9)) for r in got)
    assert told == sorted((str(i), n, round(t, 9), round(b, 9)) for i, n, t, b in plain_scores(rows, good))
    assert all(r["score"] == r["target_loss"] - r["background_loss"] for r in got)


def test_language_models_without_targets_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c d")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in lm_difference.difference(docs, none).collect()}
    assert abs(got[1]["target_loss"] - np.log(4)) < 1e-12  # flat over four words
    assert lm_difference.difference(docs.where("false"), none).count() == 0


def test_unrelated_texts_change_a_score_by_their_size_only(spark):
    """Real words are counted, so texts of other words leave the counts of a document's words alone."""
    base = [(i, f"good words here {i % 3}") for i in range(20)]
    docs = spark.createDataFrame(base, "doc_id long, text string")
    more = spark.range(1000, 1400).selectExpr("id AS doc_id", "concat('u', id, ' v', id, ' w', id) AS text")
    labels = spark.createDataFrame([(i, 1) for i in range(10)], "doc_id long, quality int")
    wanted = {i: (t, b) for i, _, t, b in plain_scores(base + [(r["doc_id"], r["text"]) for r in more.collect()], set(range(10)))}
    for r in lm_difference.difference(docs.unionByName(more), labels).collect():
        assert abs(r["target_loss"] - wanted[r["doc_id"]][0]) < 1e-9 and abs(r["background_loss"] - wanted[r["doc_id"]][1]) < 1e-9


def test_language_model_prefers_good_documents(spark):
    docs, labels = labelled(spark)
    rows = lm_difference.difference(docs, labels).join(labels, "doc_id").toPandas()
    own = rows[[zlib.crc32(str(i).encode()) % 4 == 2 for i in rows["doc_id"]]]
    assert own[own["quality"] == 1]["score"].median() < own[own["quality"] == 0]["score"].median()


@pytest.mark.parametrize("text", ["a\n\n b", "Head.\n\n b", "<|endoftext|>", "a <|endoftext|> b", "a\n\nb\n c\n\n d e"])
def test_ids_are_those_of_a_fresh_library(text):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(tokenizer_path())
    want = fresh.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(Encoder(tokenizer_path()).ids(text), "<u4").tolist() == want


def test_every_short_run_of_spaces_gives_the_librarys_ids():
    from itertools import product

    from tokenizers import Tokenizer

    own, fresh = Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    for size in range(1, 6):
        for parts in product("a \n.", repeat=size):
            text = "".join(parts)
            assert np.frombuffer(own.ids(text), "<u4").tolist() == fresh.encode(text, add_special_tokens=False).ids, text


def test_sequences_follow_the_order_of_reading(spark, tmp_path):
    rows = [(k, "word and more " * (1 + k % 7), "a" if k < 1500 else "b") for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id").write.parquet(str(tmp_path / "docs"))
    pieces = packing.write_once(
        packing.token_pieces(spark.read.parquet(str(tmp_path / "docs")), tokenizer_path(), 2, 64), "pieces"
    )
    order = packing.positions(pieces).join(pieces.select("uid", "doc_id"), "uid").orderBy("position").collect()
    assert [r["position"] for r in order] == list(range(len(order)))
    assert [r["doc_id"] for r in order] == sorted(r["doc_id"] for r in order)
    placed = packing.place(pieces, 64, shard=40)
    got = packing.digest(pieces, placed).orderBy("sequence_id", "offset").collect()
    assert len(got) == len(order)
    # windows of five shards hold the sources as the same stretch of the documents does
    window = len(got) // 10
    for k in range(10):
        share = np.mean([r["doc_id"] >= 1500 for r in got[k * window : (k + 1) * window]])
        want = np.mean([r["doc_id"] >= 1500 for r in order[k * window : (k + 1) * window]])
        assert abs(share - want) < 0.25, (k, share, want)
