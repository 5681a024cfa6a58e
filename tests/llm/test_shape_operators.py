"""Mixing, pages, conversations, vectors and the pipeline against brute force."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tuturan.llm import chat_windows, host_paths, mixing, vector_graph
from tuturan.llm.queries import QUERIES, tokenizer_path

SMALL = "/root/testdata/sf0.001"
ODD_COLUMNS = ("row", "src", "start", "size", "hash", "bucket", "n", "a", "mark", "position", "page_host", "near")


def mixture(spark, sizes, targets=None):
    rows, key = [], 0
    for s, n in enumerate(sizes):
        for _ in range(n):
            rows.append((key, "x" * (400 + 37 * (key % 90)), f"s{s}" if s else None))
            key += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return mixing.digest(docs, targets).toPandas(), docs


def test_every_block_keeps_its_deadline(spark):
    got, docs = mixture(spark, [700, 30, 300, 1], {"s1": 5, "s2": 2, "s3": 9})
    assert len(got) == docs.count() and got["doc_id"].is_unique
    assert (got["release"] <= got["position"]).all() and (got["position"] < got["deadline"]).all()
    blocks = got.assign(source=got["source"].fillna("")).groupby(["source", "block"])["position"]
    assert (blocks.nunique() == 1).all() and blocks.first().is_unique
    for _, own in got.assign(source=got["source"].fillna("")).groupby("source"):
        own = own.sort_values("start")
        assert own["position"].is_monotonic_increasing and own["start"].iloc[0] == 0


def test_shares_deviate_by_less_than_a_block(spark):
    """Until the first source ends, from the weights as they were given."""
    got, _ = mixture(spark, [400, 400, 400], {"s1": 3, "s2": 1})
    got["source"] = got["source"].fillna("")
    last = int(got.groupby("source")["position"].max().min())
    by_spot = {r.position: r.source for r in got.itertuples()}
    assert all(p in by_spot for p in range(last + 1))
    for s, a in {"": 1, "s1": 3, "s2": 1}.items():
        taken = 0
        for p in range(last + 1):
            taken += by_spot[p] == s
            assert abs(taken - (p + 1) * a / 5) < 1, (s, p)


@pytest.mark.parametrize(
    "weights, slots",
    [([3, 1, 1], 240 * 256), ([1000, 1], 30_000), ([6, 4], 5000), (list(range(1, 21)), 300 * 210), ([7919, 7907, 1], 40_000)],
)
def test_long_runs_keep_the_weights_to_the_block(spark, weights, slots):
    """Also the default weights, which are integers like given ones, only with another definition."""
    whole = sum(weights)
    counts = [max(1, slots * w // whole) + 3 * w for w in weights]
    rows = [(f"=s{i}", "0", n * mixing.BLOCK) for i, n in enumerate(counts)]
    sums = spark.createDataFrame(rows, "src string, bucket string, size long")
    sources = mixing.write_once(mixing._sources(sums, {f"s{i}": w for i, w in enumerate(weights)}), "sources")
    schedule = mixing.write_once(mixing._schedule(sources), "schedule")
    blocks = None
    for i, n in enumerate(counts):
        own = spark.range(n).select(F.lit(i).alias("row"), F.lit(f"=s{i}").alias("src"), F.lit(0).alias("start"), F.col("id").alias("block"))
        blocks = own if blocks is None else blocks.unionByName(own)
    got = mixing.block_places(blocks, sources, schedule).toPandas().sort_values("position")
    assert (got["position"].to_numpy() == np.arange(sum(counts))).all()
    assert (got["release"] <= got["position"]).all() and (got["position"] < got["deadline"]).all()
    last = int(got.groupby("row")["position"].max().min())
    order, at = got["row"].to_numpy()[: last + 1], np.arange(1, last + 2)
    assert last + 1 >= slots
    for i, w in enumerate(weights):
        assert (np.abs(np.cumsum(order == i) * whole - at * w) < whole).all()


def test_weights_that_cannot_be_met_are_refused(spark):
    rows = [(i, "x", f"s{i % 2}") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    with pytest.raises(ValueError, match="cycle of"):
        mixing.digest(docs, {"s0": 1_000_003, "s1": 2})
    with pytest.raises(ValueError, match="from 1 on"):
        mixing.digest(docs, {"s0": 0})
    assert mixing.digest(docs, {"s0": 1_000_000, "s1": 2_000_000}).count() == 4


def test_mixing_keeps_rows_and_columns(spark):
    rows = [(1, "a", None), (1, "a", None), (None, None, "s"), (3, "", "s"), (4, "y" * 30_000, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for c in ODD_COLUMNS:
        docs = docs.withColumn(c, F.lit(1))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    assert mixing.mixed(docs.where("false")).count() == 0
    assert mixing.digest(docs.where("false")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>Site | t</title><script>var a="</p><article>no</article>";</script>
<style>p{{}}</style></head><body class="home"><header><h1>Site name</h1></header>
<div class="nav-bar"><a href="/">Home</a></div><!-- <p>gone</p> -->
<div class="{wrap}"><div class="post-body post-{n}"><h2>Head &amp; line</h2><p>First <b>bold</b>&nbsp;text,
 over   lines<br>and on <a href="x">linked</a>.<p>Second &lt;para&gt; 3 > 2 &#233;</p>
<ul><li>one<li>two</ul><form>your <input value="q>"> mail</form><div class="cookie-notice">We use cookies</div>
</div><aside>Side bar</aside><div id="comments"><p>Reader says a very long thing, {filler}</p></div></div>
<footer>&copy; all</footer></body></html>"""
WANT = "Head & line\n\nFirst bold text, over lines and on linked.\n\nSecond <para> 3 > 2 é\n\none\n\ntwo"


def test_articles_of_a_host(spark):
    rows = [(k, f"https://A.example.org:80/{k}", PAGE.format(wrap="main", n=k, filler="w " * 300)) for k in range(6)]
    rows += [(90, "http://a.example.org", None), (91, None, ""), (92, "bad url", "just text &amp more")]
    rows += [(93, "https://a.example.org/x", "<div><p>other template, own best path</div>"), (0, *rows[0][1:])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("mine"))
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in host_paths.main_text(pages).collect()]
    assert [t for k, t, _ in sorted(got) if k < 90] == [WANT] * 7
    rest = {k: t for k, t, _ in got if k >= 90}
    assert rest == {90: "", 91: "", 92: "just text & more", 93: "other template, own best path"}
    assert all(n == len(t) for _, t, n in got)
    assert host_paths.main_text(pages.where("false")).count() == 0


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p>a<script>x</script >b</p>", "ab"),
        ("<article><p>cut in a ta", "cut in a ta"),
        ("<article><p>x <i class='a' title='q>'>y</i", "x y"),
        ('<p title="open>one</p><p>two</p>', "one\n\ntwo"),
        ("<div hidden><p>no</p></div><p>yes</p>", "yes"),
        ("<p>1 < 2 &am", "1 < 2 &am"),
        ("<", "<"),
    ],
)
def test_broken_markup(page, text):
    assert host_paths.extract(page, []) == text


def test_adverse_markup_is_linear():
    host_paths.extract("<a " + "x='" * 20_000 + "<p>" * 20_000, [])


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("<|\\[]/sINST>YS end\n"), max_size=40))
def test_escapes_are_undone(text):
    safe = chat_windows.escape(text)
    assert chat_windows.unescape(safe) == text
    assert not any(c in safe for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))
    role = text[:5]
    assert chat_windows.read_turns(chat_windows.format_turn(role, text)) == [(role, text)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=40), st.integers(0, 30), st.integers(0, 40))
def test_spans_fit_the_budget(sizes, fixed, history):
    cut = chat_windows.spans(sizes, fixed, 100, history)
    assert [i for _, a, b in cut for i in range(a, b)] == list(range(len(sizes)))
    for back, a, b in cut:
        assert sum(sizes[back:a]) <= history
        assert sum(sizes[back:b]) + fixed <= 100 or b == a + 1 and back == a


def expected_digest(rows):
    told, loss = "", ""
    for _, turn, role, text in sorted(rows, key=lambda r: (r[1], r[2] or "", r[3] or "")):
        told += f"{role or ''}\n{text or ''}\n"
        loss += text or "" if role == "assistant" else ""
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(rows), digest(told), len(loss), digest(loss)


def test_conversations_read_back(spark):
    rows = [(1, 0, "system", "be <|end|> brief"), (1, 1, "user", None), (1, 2, "assistant", "[INST]" * 3)]
    rows += [(2, t, ("user", "assistant")[t % 2], f"turn {t} " + "word " * (t % 50)) for t in range(700)]
    rows += [(3, 5, "assistant", "long " * 3000), (3, 5, "assistant", "long " * 3000), (3, 6, None, "x")]
    rows += [(4, 0, "system", "s " * 2000), (4, 1, "assistant", "a"), (4, 2, "user", "b"), (None, 1, "user", "n")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    made = chat_windows.windows(turns.withColumn("chunk", F.lit(0)), tokenizer_path(), chunk=64)
    made = made.persist()
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat_windows.digest(made).collect()}
    assert got == {c: expected_digest([r for r in rows if r[0] == c]) for c in (None, 1, 2, 3, 4)}
    for w in made.collect():
        own = chat_windows.read_turns(w["text"])
        assert w["n_tokens"] <= chat_windows.BUDGET or len(own) - w["repeated"] == 1
        if w["conv_id"] == 4:
            assert own[0][0] == "system"
        assert all(w["text"][s["start"] : s["end"]] in w["text"] for s in w["loss"])
    later = [w for w in made.collect() if w["conv_id"] == 2 and (w["chunk"], w["window"]) > (0, 0)]
    assert later and all(w["repeated"] > 0 for w in later)
    assert chat_windows.digest(chat_windows.windows(turns.where("false"), tokenizer_path())).count() == 0


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 24))
    x[1000:1400] = x[0] + 0.05 * rng.normal(size=(400, 24))
    for k in range(1400, 1600):
        x[k] = x[k - 400 - 800] + 0.12 * rng.normal(size=24)
    x[1600:1700] = x[5]
    x[1700] = 3 * x[6]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(9000, None), (9001, [0.0] * 24), (9002, [float("nan")] * 24), (9003, [None] * 24), (9004, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit(1))
    got = {r["vec_id"]: r for r in vector_graph.link(vectors).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hit = unit @ unit.T >= 0.95
    degree = hit.sum(1) - 1
    links = np.array([got[k]["n_links"] for k in range(3000)])
    assert (links <= degree).all() and links.sum() >= 0.98 * degree.sum()
    assert got[1000]["component_id"] == 0 and not got[1000]["kept"] and got[0]["kept"]
    assert all(got[k]["n_links"] == 0 and got[k]["component_id"] == k and got[k]["kept"] for k in range(9000, 9005))
    linked = spark.createDataFrame([(k, r["n_links"]) for k, r in got.items()], "vec_id long, n_links long")
    audit = vector_graph.recall(vectors, linked).toPandas()
    assert audit["found"].sum() >= 0.9 * audit["expected"].sum() > 0
    assert (audit.set_index("vec_id")["expected"] == degree[audit["vec_id"]]).all() or len(audit) == 30
    assert vector_graph.link(vectors.where("false")).count() == 0
    assert vector_graph.link(vectors.where("vec_id >= 9000")).count() == 5


def test_links_of_a_spread_cloud_are_not_lost_between_shards(spark, monkeypatch):
    """Hundreds of small shards over a cloud: the audit finds how many of them a node needs."""
    monkeypatch.setattr(vector_graph, "SHARD", 32)
    monkeypatch.setattr(vector_graph, "OVERLAP", 1)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(9000, 8)) @ rng.normal(size=(8, 64)) + 0.02 * rng.normal(size=(9000, 64))
    x[:3000] = x[0] + 0.05 * rng.normal(size=(3000, 64))  # a third in one group
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    degree = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    _, nodes, length = vector_graph._nodes(vectors)
    centres, first = vector_graph._shards(vector_graph._centroids(nodes, 9000, length), 0.95)
    assert len(first) > 100
    assert vector_graph.overlap_needed(nodes, centres, first, length, 0.95) > vector_graph.OVERLAP
    got = {r["vec_id"]: r["n_links"] for r in vector_graph.link(vectors).collect()}
    links = np.array([got[k] for k in range(9000)])
    cloud = degree[3000:] > 0
    assert (links <= degree).all() and links[3000:][cloud].sum() >= 0.95 * degree[3000:][cloud].sum()
    assert links[:3000].sum() >= 0.95 * degree[:3000].sum()


def test_shards_that_cannot_hold_the_pairs_are_refused(spark, monkeypatch):
    monkeypatch.setattr(vector_graph, "SHARD", 32)
    monkeypatch.setattr(vector_graph, "MOST_SHARDS", 1)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(3000, 8)) @ rng.normal(size=(8, 64))
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="audited pairs"):
        vector_graph.link(vectors)


def test_pipeline_on_odd_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = docs.limit(20).unionByName(docs.limit(3)).withColumn("score", F.lit(1)).withColumn("kept", F.lit("x"))
    odd = odd.unionByName(odd.limit(2).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(None).cast("long")))
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SMALL)
        assert stage is corpus_pipeline.STAGES[-1][1] or out.columns == odd.columns
        assert stage(spark, odd.where("false"), SMALL).count() == 0
        out.count()


def test_pipeline_runs(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SMALL).toPandas()
    assert len(rows) and rows.groupby("sequence_id")["length"].sum().max() <= 1024


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_have_rows(spark, name):
    frame = QUERIES[name](spark, SMALL)
    assert len(frame.take(1)) == 1


def test_headlines_leads_and_rare_templates_are_kept(spark):
    body = "<p>" + "some long text of the body " * 20 + "</p>"
    inner = f"<article><h1>Title</h1><div><div class=content>{body}</div></div><nav>menu</nav></article>"
    parts = f"<div class=page><div class=lead><p>The lead.</p></div><div class=text>{body}</div></div>"
    rare = f"<article><p>Teaser.</p></article><div class=story>{body}</div>"
    assert host_paths.extract(inner, []).startswith("Title\n\nsome long")
    assert host_paths.extract(parts, []).startswith("The lead.\n\nsome long")
    rows = [(k, f"http://a.org/{k}", inner) for k in range(12)] + [(20, "http://a.org/r", rare)]
    rows += [(30 + k, f"http://b.org/{k}", parts) for k in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in host_paths.main_text(pages).collect()}
    assert all(got[k].startswith("Title\n\nsome long") for k in range(12))
    assert "some long" in got[20]
    assert all(got[30 + k].startswith("The lead.\n\nsome long") for k in range(3))


def test_a_page_has_all_winning_paths_that_stand_on_it():
    page = "<div class=a><p>first part</p></div><aside>no</aside><div class=b><p>second part</p></div>"
    assert host_paths.extract(page, ["/div.a", "/div.b"]) == "first part\n\nsecond part"


def test_a_dense_group_with_many_centroids_keeps_its_links(spark, monkeypatch):
    monkeypatch.setattr(vector_graph, "SHARD", 8)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2400, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[:800] = x[0] + 0.0285 * rng.normal(size=(800, 64))
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    linked = vector_graph.link(vectors)
    links = np.array([r["n_links"] for r in sorted(linked.collect(), key=lambda r: r["vec_id"])])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    degree = (unit @ unit.T >= 0.95).sum(1) - 1
    print("recall", links.sum() / degree.sum())
    assert (links <= degree).all() and links.sum() >= 0.98 * degree.sum()


LONG = "word and more text, " * 30
BODY = f"<p>{LONG}</p><p>{LONG}</p>"
SIDE = '<div class="sidebar"><p>short side text</p><a href="/">a link in it</a></div>'
LAYOUTS = [
    '<div class="site-content has-sidebar"><h1>Head</h1>{body}</div>{side}',
    '<body class="no-sidebar"><div class="with-widget-area"><h1>Head</h1>{body}</div></body>',
    '<article><h1>Head</h1><div class="elementor-widget elementor-widget-text-editor">{body}</div></article>',
    '<article><h1>Head</h1><section id="search-for-meaning">{body}</section></article>',
    '<article><h1>Head</h1><section id="share">{body}</section><div class="share"><p>Share this</p></div></article>',
    '<div class="entry-header"><h1>Head</h1></div><div class="entry-body">{body}</div>{side}',
    '<div class="post-header"><h1>Head</h1></div>{body}{side}',
    '<div class="page"><div class="article-header"><h1>Head</h1></div><div class="text">{body}</div></div>',
    '<main><div class="social-layout"><h1>Head</h1>{body}</div><aside>{side}</aside></main>',
    '<div class="widget-page"><article><h1>Head</h1>{body}</article></div>{side}',
    '<div id="banner-wrap"><main><h1>Head</h1>{body}</main></div>{side}',
    '<main class="promo"><h1>Head</h1>{body}</main>{side}',
    '<article class="post tags-news"><h1>Head</h1>{body}<div class="tags"><a href="/t">tag one</a></div></article>',
    '<article><h1>Head</h1>{body}<div class="related-posts"><p><a href="/x">' + LONG * 3 + '</a></p></div></article>',
    '<article><h1>Head</h1>{body}<section id="comments"><p>' + LONG * 9 + "</p></section></article>",
    '<div class="content"><h1>Head</h1>{body}</div><div id="disqus_thread"><p>' + LONG * 9 + "</p></div>",
    '<div class="cookie-consent"><p>We use cookies</p></div><div class="story"><h1>Head</h1>{body}</div>',
    '<div class="siteHeader"><p>Name of site</p></div><div class="mainText"><h1>Head</h1>{body}</div><div class="siteFooter"><p>Imprint</p></div>',
    '<header><p>Name</p></header><article><header class="entry-header"><h1>Head</h1></header>{body}<footer>By me</footer></article>',
    '<table><tr><td class="menu"><a href="/">Home page</a></td><td class="page"><h1>Head</h1>{body}</td></tr></table>',
    '<div hidden><p>{long}</p></div><div class="is-sticky"><h1>Head</h1>{body}</div>',
    '<article><h1>Head</h1><div class="notice"><p>short notice</p></div>{body}</article><div class="newsletter-box"><p>Sign up now</p></div>',
]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_names_do_not_cost_an_article(layout):
    page = f"<html>{layout.format(body=BODY, side=SIDE, long=LONG)}</html>"
    assert host_paths.extract(page, []) == f"Head\n\n{LONG.strip()}\n\n{LONG.strip()}"


def test_comments_stay_where_there_is_nothing_else():
    page = '<div class="comments"><p>first thought</p><p>second one</p></div>'
    assert host_paths.extract(page, []) == "first thought\n\nsecond one"


def test_deep_markup_takes_memory_in_proportion():
    import tracemalloc

    tracemalloc.start()
    assert host_paths.extract("<div class='a b'>" * 50_000 + "deep text", []) == "deep text"
    assert host_paths.extract("<div class='a'>text <p>more</p>" * 5000, []).count("more") == 5000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000
