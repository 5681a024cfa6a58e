"""Main text of web pages by consensus of a host's pages on where their articles stand.

A page is read once for its blocks of text: each has the generalised path of its container (tags
with their classes, digits made equal). Containers are scored by the text in them less the text of
links. From the best one a page climbs to the smallest container that holds all running text of its
outermost article or main part (of the page, where it has none), and votes for that path. Votes are
counted by host in Spark; paths with a fair share of a host's votes win, and every page is read again
with the winning paths of its host, all that stand on it. A page uses its own path where the winning
ones hold too little of the text that its own one does.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are
left out by tag, role or class, wherever they stand; a class, id or role only where the text agrees
(see ``_without_others``).

A null or empty page gives an empty text; a null or odd url is a host of its own name ''; rows that
repeat are extracted each; columns named like a computed one are replaced, others pass; an empty
table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tuturan.llm.common import append_arrow, free_name, write_once

SHARE = 0.2  # of a host's votes that a winning path has; so five paths at most
FAIR = 0.5  # of the text below a page's own path that the winning paths hold at least
MOST = 0.5  # of the page's running text: a part that holds so much is not left out by its name
FEW = 0.2  # of an article's running text: a part of it with less may be left out by its name
LINKED = 0.5  # of a part's text in links: then it may be, however long

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg math object select".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
    "ol p pre section summary table tbody td tfoot th thead tr ul head".split()
)
CONTAINER = set("article body center div main section td".split())
LEFT_OUT = set("nav footer aside form button dialog menu head audio video canvas".split())
# Words before which a name tells a layout, words for content, and words for readers' comments.
STATE = set("has have with no without is not hide show".split())
CONTENT = set("article body blog content entry heading news page post section single story text title".split())
COMMENTS = set("comment comments commentlist disqus replies respond".split())
# Words of class, id and role names of what is not the article.
OTHER = set(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment "
    "comments commentlist consent cookie cookies copyright disqus dropdown footer footnotes gdpr "
    "header login masthead menu menubar modal nav navbar navigation newsletter notice notices "
    "pager pagination paywall popup promo promoted promotion recommended related replies respond "
    "search share sharing shares sidebar sidebars signup skip social sponsor sponsored subscribe "
    "subscription tags toolbar topbar widget widgets contentinfo complementary alert".split()
)
ENDS_P = BLOCK - {"body", "html", "head"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}}
SAME |= {"td": {"td", "th"}, "th": {"td", "th"}}


def _closing(name: str, found: dict[str, re.Pattern] = {}) -> re.Pattern:  # noqa: B006
    if name not in found:
        found[name] = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I)
    return found[name]


def _label(name: str, attributes: dict[str, str]) -> str:
    named = attributes.get("class") or attributes.get("id") or ""
    kinds = sorted(set(re.sub(r"\d+", "0", named).split()))
    return ".".join([name, *kinds]).replace("/", "_")


def _is_out(name: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Is a part left out by its tag, or hidden?"""
    if name in LEFT_OUT or name == "header" and not in_article:
        return True
    if "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    return bool(_HIDDEN.search(attributes.get("style", "")))


def _named_other(name: str, attributes: dict[str, str], in_article: bool) -> str:
    """The word of its class, id or role for which a part may be left out, empty without one.

    A word counts in a name of its own or joined with others (``cookie-notice``), not behind a word
    that tells how a page is laid out (``has-sidebar``), nor ``header`` beside a word for content
    (``entry-header``). A long id is a heading's, as anchors have them.
    """
    if name in ("html", "body", "article", "main"):
        return ""
    for key in ("class", "id", "role"):
        for token in attributes.get(key, "").split():
            words = [w.lower() for w in _WORDS.findall(token)]
            if key == "id" and len(words) > 2:
                continue
            for k, word in enumerate(words):
                if word not in OTHER or k and words[k - 1] in STATE:
                    continue
                if word == "header" and (in_article or CONTENT & set(words)):
                    continue
                return word
    return ""


class Page:
    """The blocks of text of a page and the trie of its containers' generalised paths.

    A node is a path, numbered after its parent, so what holds for all nodes below another is found
    in one pass, and markup of any depth takes memory in proportion. Blocks are ``(node, raw text,
    characters in links, whether it is a paragraph)``.
    """

    def __init__(self, page: str):
        self.parent, self.label, self.length = [-1], [""], [0]
        self._known: dict[tuple[int, str], int] = {}
        found, parts = self._read(page)
        self.blocks = _without_others(found, parts)

    def _child(self, node: int, label: str) -> int:
        known = self._known.get((node, label))
        if known is None:
            known = self._known[node, label] = len(self.parent)
            self.parent.append(node)
            self.label.append(label)
            self.length.append(self.length[node] + 1 + len(label))
        return known

    def _read(self, page: str) -> tuple[list[tuple], list[tuple]]:
        """All blocks but those left out by tag, each with the innermost part around it that has a
        name for leaving out; and these parts: the part around, the word, whether in an article."""
        out: list[tuple[int, str, int, bool, int, bool]] = []
        parts: list[tuple[int, str, bool]] = []
        stack: list[tuple[str, int, bool, bool, int]] = []  # name, node, left out, in an article, part
        held: list[str] = []
        linked = link_depth = 0
        at, end = 0, len(page)

        def flush() -> None:
            nonlocal linked
            if held:
                text = "".join(held)
                held.clear()
                if text.strip():
                    name, node, _, in_article, part = stack[-1] if stack else ("", 0, False, False, -1)
                    out.append((node, text, linked, name in ("p", "pre"), part, in_article))
            linked = 0

        while at < end:
            tag = _TAG.search(page, at)
            stop = tag.start() if tag else end
            if stop > at and not (stack and stack[-1][2]):
                held.append(page[at:stop])
                if link_depth:
                    linked += stop - at
            if not tag:
                break
            at = tag.end()
            name = (tag[2] or tag[5] or "").lower()
            if not name:
                continue
            if tag[1] or tag[4]:  # an end tag
                if name == "a":
                    link_depth = max(0, link_depth - 1)
                if name in BLOCK:
                    flush()
                    for depth in range(len(stack) - 1, -1, -1):
                        if stack[depth][0] == name:
                            del stack[depth:]
                            break
                continue
            if name == "br":
                held.append(" ")
                continue
            if name in RAW:
                if not (tag[3] or tag[6] or "").endswith("/"):
                    close = _closing(name).search(page, at)
                    at = close.start() if close else end
                if name in BLOCK:
                    flush()
                continue
            if name == "a":
                link_depth += 1
            if name not in BLOCK:
                if name in LEFT_OUT:  # inline: drop to its end
                    close = _closing(name).search(page, at)
                    at = close.start() if close else at
                continue
            flush()
            if name == "hr":
                continue
            if name in ENDS_P and stack and stack[-1][0] == "p":
                del stack[-1]
            for other in SAME.get(name, ()):
                if stack and stack[-1][0] == other:
                    del stack[-1]
                    break
            text = tag[3] or tag[6] or ""
            attributes = (
                {k.lower(): a or b or c or "" for k, a, b, c in _ATTRIBUTE.findall(text)} if text else {}
            )
            _, node, out_here, in_article, part = stack[-1] if stack else ("", 0, False, False, -1)
            if name in CONTAINER and name != "body":
                node = self._child(node, _label(name, attributes))
            out_here = out_here or _is_out(name, attributes, in_article)
            word = "" if out_here or not attributes else _named_other(name, attributes, in_article)
            if word:
                parts.append((part, word, in_article))
                part = len(parts) - 1
            stack.append((name, node, out_here, in_article or name in ("article", "main"), part))
            link_depth = 0
        flush()
        return out, parts

    def path(self, node: int) -> str:
        labels = []
        while node > 0:
            labels.append(self.label[node])
            node = self.parent[node]
        return "".join(f"/{x}" for x in reversed(labels))

    def node(self, path: str) -> int | None:
        """The node of a path, None where the page has none."""
        node = 0
        for label in path.split("/")[1:]:
            found = self._known.get((node, label))
            if found is None:
                return None
            node = found
        return node

    def below(self, tops: list[int]) -> list[bool]:
        """Of every node, whether it is one of ``tops`` or below."""
        chosen = set(tops)
        flags = [0 in chosen]
        for node in range(1, len(self.parent)):
            flags.append(node in chosen or flags[self.parent[node]])
        return flags

    def _outermost(self, node: int) -> int:
        """The outermost article or main part around a node, or the page."""
        top = 0
        while node > 0:
            if self.label[node].partition(".")[0] in ("article", "main"):
                top = node
            node = self.parent[node]
        return top

    def best(self) -> int | None:
        """The container with most text outside links, widened to all running text around it.

        Half of a container's text counts for the container around. Blocks that are mostly links do
        not widen it.
        """
        scores: dict[int, float] = defaultdict(float)
        for node, text, linked, paragraph in self.blocks:
            score = (len(text) - 2 * linked) * (1.0 if paragraph else 0.5)
            scores[node] += score
            if node:
                scores[self.parent[node]] += score / 2
        if not scores:
            return None
        most = max(scores.values())
        tied = [n for n in scores if scores[n] == most]
        shortest = min(self.length[n] for n in tied)
        best = min((n for n in tied if self.length[n] == shortest), key=self.path)
        inside = self.below([self._outermost(best)])
        held = [0] * len(self.parent)  # running blocks in and below a node
        for node, text, linked, _ in self.blocks:
            if 2 * linked < len(text) and inside[node]:
                held[node] += 1
        every = sum(held)
        for node in range(len(held) - 1, 0, -1):
            held[self.parent[node]] += held[node]
        while held[best] < every:
            best = self.parent[best]
        return best


def _without_others(found: list[tuple], parts: list[tuple]) -> list[tuple[int, str, int, bool]]:
    """The blocks outside the parts that are left out by name.

    A name is no proof: a part that holds most of the running text of the page's articles, or of a
    page without any, is where the article is; inside an article or main part only what is short or
    mostly links is left out. Readers' comments are left out however long, unless there is nothing else.
    """
    if not parts:
        return [block[:4] for block in found]
    running, of_article, linked = [0] * len(parts), [0] * len(parts), [0] * len(parts)
    remarks = [p[1] in COMMENTS for p in parts]
    for k, (around, _, _) in enumerate(parts):
        remarks[k] = remarks[k] or around >= 0 and remarks[around]
    whole = article = 0
    for _, text, links, _, part, in_article in found:
        size = max(0, len(text.strip()) - links)
        own = size if in_article else 0
        if part < 0 or not remarks[part]:
            whole, article = whole + size, article + own
        if part >= 0:
            running[part] += size
            of_article[part] += own
            linked[part] += links
    for k in range(len(parts) - 1, -1, -1):
        around = parts[k][0]
        if around >= 0:
            for sums in (running, of_article, linked):
                sums[around] += sums[k]
    stays = []
    for k, (around, _, in_article) in enumerate(parts):
        if remarks[k]:
            keep = whole == 0
        elif article:
            keep = of_article[k] > 0 and of_article[k] >= (FEW if in_article else MOST) * article
            keep = keep and linked[k] < LINKED * (linked[k] + running[k])
        else:
            keep = running[k] > 0 and running[k] >= MOST * whole
        stays.append(keep and (around < 0 or stays[around]))
    return [b[:4] for b in found if b[4] < 0 or stays[b[4]]]


def best_path(page: str) -> str | None:
    """The path for which a page votes; none without text."""
    read = Page(page)
    best = read.best()
    return None if best is None else read.path(best)


def extract(page: str, winners: list[str]) -> str:
    """The text of the blocks below the winning paths, or below the page's own one."""
    read = Page(page)
    own = read.best()
    if own is None:
        return ""
    size = lambda flags: sum(len(t) for n, t, _, _ in read.blocks if flags[n])
    wide, mine = read.below([n for w in winners if (n := read.node(w)) is not None]), read.below([own])
    inside = mine if size(wide) < max(1, FAIR * size(mine)) else wide
    texts = (" ".join(html.unescape(t).split()) for n, t, _, _ in read.blocks if inside[n])
    return "\n\n".join(t for t in texts if t)


def host(url="url"):
    name = F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.coalesce(name, F.lit(""))


def votes(pages: DataFrame) -> DataFrame:
    """``host`` and ``winners``, the paths that have a fair share of its pages' votes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = [best_path(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(paths, pa.string())], names=["host", "path"]
            )

    cast = pages.select(host().alias("host"), "html").mapInArrow(run, "host string, path string")
    counted = cast.where("path is not null").groupBy("host", "path").agg(F.count("*").alias("n"))
    counted = write_once(counted, "votes")
    totals = counted.groupBy("host").agg(F.sum("n").alias("total"))
    won = counted.join(totals, "host").where(F.col("n") >= SHARE * F.col("total"))
    return write_once(won.groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("winners")), "winners")


def main_text(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Pages with ``text`` and ``n_chars``."""
    won = votes(pages)
    own_host, own_paths = free_name(pages, "page_host"), free_name(pages, "page_winners")
    won = won.select(F.col("host").alias(own_host), F.col("winners").alias(own_paths))
    rows = pages.withColumn(own_host, host()).join(won, own_host, "left")

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            column = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()
            pairs = zip(column("html"), column(own_paths), strict=True)
            found = [extract(page or "", winners or []) for page, winners in pairs]
            return [pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]

        return work

    fields = [("text", T.StringType()), ("n_chars", T.LongType())]
    return append_arrow(rows, fields, make, list(pages.columns) if keep is None else keep)
