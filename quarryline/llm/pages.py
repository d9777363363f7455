"""Main text of web pages, without what their site puts on every page.

Each page is read into pieces of text under a tree of elements. What the markup itself calls furniture (menus, adverts,
forms and the like) goes. Every element with text is hashed as a subtree, also those that a name takes, and Spark counts on how many
different pages a subtree stands and beside how many different stories. It is compared with what else stands at its
position, in its section and on its host, so that a notice in a place of its own is template on however small a part of
a host, and a line that articles share is not. Near copies of one article are one story.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import html as entities
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.words import mix, normal, shingles, slices
from quarryline.session import workspace

#: A subtree is template at a position of a host when it stands there on so many different pages, beside half as many
#: stories at least, and on such a share of the pages with an element at that position. In a section of a host, where fewer
#: pages say less, the bounds are MANY and HALF, as they are for a subtree anywhere on a host among all its pages.
LEAST_PAGES, SHARE = 3, 1 / 3
MANY, HALF = 10, 0.5
#: Stories are told apart by the least hashes of the shingles outside the subtree, in so many independent ways.
WAYS = 2

# Elements that hold no text for readers, furniture, elements that end a line, words in class, id and role
# that name furniture, and words that only add to them: a token of others ("no-sidebar", "has-comments") names none.
UNREAD = {"script", "style", "noscript", "template", "head", "title", "iframe", "object", "svg", "canvas", "math", "audio", "video"}
FURNITURE = {"nav", "footer", "aside", "form", "button", "select", "option", "textarea", "input", "label", "fieldset", "dialog", "menu"}
BLOCKS = {
    "address", "article", "blockquote", "body", "br", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption",
    "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "ol", "p", "pre", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
} | FURNITURE
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment",
    "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "disqus", "footer", "masthead", "menu",
    "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "popup", "promo", "related", "respond",
    "search", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
_ADDED = {
    "area", "bar", "block", "bottom", "box", "col", "column", "container", "content", "inner", "item", "left", "link", "links",
    "list", "main", "outer", "primary", "right", "secondary", "section", "site", "slot", "text", "title", "top", "wrap", "wrapper",
}
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: A new element of the first kind ends an open one of the second, up to the nearest container.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CONTAINERS = {"article", "aside", "body", "div", "dl", "footer", "form", "header", "html", "main", "nav", "ol", "section", "table", "td", "th", "ul"}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"]*"|'[^']*'|[^"'>])*)>?""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[a-z0-9]+")
_NONE = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.IGNORECASE)


class Page:
    """Pieces of text (a None ends a block) and elements as ranges of pieces."""

    def __init__(self, source: str):
        self.pieces: list[str | None] = []
        self.dropped: list[tuple[int, int]] = []
        self.named: list[tuple[int, int]] = []
        self.subtrees: list[tuple[str, int, int, int]] = []
        self.unread: list[tuple[int, int]] = []
        self.articles: list[tuple[int, int]] = []
        self.teasers: list[tuple[int, int]] = []
        self.mains: list[tuple[int, int]] = []
        self._open: list[tuple[str, int, bool, bool, bool, str]] = []
        at = 0
        while True:
            tag = _TAG.search(source, at)
            if not tag:
                self._text(source[at:])
                break
            self._text(source[at : tag.start()])
            at = tag.end()
            name = (tag.group(2) or "").lower()
            if not name:
                continue
            if tag.group(1):
                self._close(name)
                continue
            self._start(name, tag.group(3))
            if name in _RAW:  # its text runs to its own end tag
                end = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(source, at)
                if name == "textarea":
                    self._text(source[at : end.start() if end else len(source)])
                at = end.end() if end else len(source)
                self._close(name)
        while self._open:
            self._pop()

    def _text(self, raw: str) -> None:
        if raw:
            self.pieces.append(entities.unescape(raw) if "&" in raw else raw)

    def _start(self, name: str, attributes: str) -> None:
        if name in BLOCKS:
            self.pieces.append(None)
        if name in BLOCKS and name != "br":
            ends = _ENDS.get(name, {"p"})
            for i in range(len(self._open) - 1, -1, -1):
                opened = self._open[i][0]
                if opened in ends or opened == "p":
                    while len(self._open) > i:
                        self._pop()
                    if name not in _ENDS:
                        break
                elif opened in _CONTAINERS:
                    break
        if name in _VOID:
            return
        inside = any(n == "article" for n, *_ in self._open)
        drop = name in UNREAD or name in FURNITURE or (name == "header" and not inside)
        named, classes = False, ""
        if attributes:
            given: dict[str, str] = {}
            for key, *values in _ATTRIBUTE.findall(attributes):
                given.setdefault(key.lower(), entities.unescape("".join(values)))
            classes = re.sub(r"\d+", "", given.get("class", ""))
            if name not in ("html", "body"):
                shown = given.get("aria-hidden", "").strip().lower() != "true" and not _NONE.search(given.get("style", ""))
                if "hidden" in given or not shown:
                    drop = True
                named = any(names_furniture(given.get(key, "")) for key in ("class", "id", "role"))
        under = bool(self._open) and (self._open[-1][3] or self._open[-1][4])
        self._open.append((name, len(self.pieces), drop, named, under, f"{name} {classes}"))

    def _close(self, name: str) -> None:
        if any(n == name for n, *_ in self._open):
            while self._open[-1][0] != name:
                self._pop()
            self._pop()
        if name in BLOCKS:
            self.pieces.append(None)

    def _pop(self) -> None:
        name, start, drop, named, under, position = self._open.pop()
        end = len(self.pieces)
        if name in BLOCKS:
            self.pieces.append(None)
        if name in UNREAD:
            self.unread.append((start, end))
        if drop:
            self.dropped.append((start, end))
        else:
            if name == "article":
                (self.teasers if named or under else self.articles).append((start, end))
            elif name == "main":
                self.mains.append((start, end))
            if named:
                self.named.append((start, end))
        if name in BLOCKS and name not in ("html", "body", "article", "main"):
            above = self._open[-1][5] if self._open else ""
            self.subtrees.append((name, start, end, _position(above, position)))

    def kept(self) -> list[bool]:
        """Which pieces belong to the main text by the markup alone: articles, else main, else articles with or below
        a name of furniture (comments are often articles), else all. A name takes no element that is or holds such a
        region or most of the text, and names do not take all."""
        regions = sorted(self.articles or self.mains or self.teasers or [(0, len(self.pieces))])
        keep = [False] * len(self.pieces)
        for start, end in regions:
            keep[start:end] = [True] * (end - start)
        for start, end in self.dropped:
            keep[start:end] = [False] * (end - start)
        if not self.named:
            return keep
        before = list(itertools.accumulate((len(p.strip()) if p and k else 0 for p, k in zip(self.pieces, keep)), initial=0))
        left, starts = list(keep), [start for start, _ in regions]
        for start, end in self.named:
            inside = itertools.islice(regions, bisect.bisect_left(starts, start), bisect.bisect_left(starts, end))
            if 2 * (before[end] - before[start]) <= before[-1] and not any(b <= end for _, b in inside):
                left[start:end] = [False] * (end - start)
        return left if any(p and k and p.strip() for p, k in zip(self.pieces, left)) else keep

    def text(self, keep: list[bool], start: int = 0, end: int | None = None) -> str:
        parts = (" " if p is None else p for p, k in zip(self.pieces[start:end], keep[start:end]) if k)
        return " ".join("".join(parts).split())

    def hashed(self, keep: list[bool]) -> list[tuple[int, int, int, int]]:
        """``subtree, position, start, end`` of the elements with text outside furniture by tag, as hashes: what names leave
        of it, or the whole where they leave nothing. A position is an element's name and classes and its parent's."""
        read = [True] * len(self.pieces)
        for start, end in self.dropped:
            read[start:end] = [False] * (end - start)
        out = []
        for name, start, end, position in self.subtrees:
            if any(read[start:end]) and (text := self.text(keep, start, end) or self.text(read, start, end)):
                out.append((_hash(f"{name} {text}"), position, start, end))
        return out

    def blocks(self, keep: list[bool]) -> tuple[list[int], list[bytes]]:
        """Where kept blocks start, and their words."""
        starts, words, parts, at = [], [], [], 0
        for i, (piece, k) in enumerate(zip([*self.pieces, None], [*keep, False])):
            if piece is not None and k:
                at = at if parts else i
                parts.append(piece)
            elif piece is None and parts:
                if text := normal("".join(parts).encode("utf-8", "replace")):
                    starts.append(at)
                    words.append(text)
                parts = []
        return starts, words


def _least(words: list[bytes]) -> list[list[int]]:
    """The least hash of each block's shingles, for each of WAYS."""
    if not words:
        return [[] for _ in range(WAYS)]
    hashes, begins = shingles(words)
    return [np.minimum.reduceat(mix(hashes + np.uint64(way)), begins[:-1]).tolist() for way in range(WAYS)]


def _stories(starts: list[int], least: list[list[int]], ranges: list[tuple[int, int]]) -> list[int]:
    """For each range, one hash of the least hashes of the blocks outside it."""
    top = 1 << 64
    left = [list(itertools.accumulate(way, min, initial=top)) for way in least]
    right = [list(itertools.accumulate(reversed(way), min, initial=top))[::-1] for way in least]
    out = []
    for start, end in ranges:
        a, b = bisect.bisect_left(starts, start), bisect.bisect_left(starts, end)
        story = 0
        for before, after in zip(left, right):
            story = (story * 0x9E3779B97F4A7C15 + min(before[a], after[b])) % top
        out.append(story - (top >> 1))
    return out


def names_furniture(value: str) -> bool:
    """Whether a token of a class, id or role is made of NAMES, with nothing but _ADDED words and numbers beside them."""
    for token in value.split():
        words = _WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower())
        if NAMES & set(words) and all(w in NAMES or w in _ADDED or w.isdigit() for w in words):
            return True
    return False


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


@functools.lru_cache(1 << 14)
def _position(above: str, own: str) -> int:
    return _hash(f"{above}>{own}")


def _decoded(column: pa.Array) -> list[str]:
    return [(v or b"").decode("utf-8", "replace") for v in column.cast(pa.binary()).to_pylist()]


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, or null."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.when(host != "", host)


_ROWS = "host string, section string, source long, page long, subtree long, position long, story long"


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The subtrees of each page, with the hash of its whole text and the stories beside them; subtree 0 at position 0 is
    the page itself."""
    for batch in batches:
        sources, keys = _decoded(batch.column(3)), list(zip(*(column.to_pylist() for column in batch.columns[:3])))
        for first, last in slices(sources):
            rows, read, words = set(), [], []
            for key, source in zip(keys[first:last], sources[first:last]):
                page = Page(source)
                keep = page.kept()
                starts, found = page.blocks(keep)
                read.append((key, _hash(page.text(keep)), page.hashed(keep), starts, len(words)))
                words += found
            least = _least(words)
            for key, whole, found, starts, at in read:
                rows.add((*key, whole, 0, 0, None))
                own = [way[at : at + len(starts)] for way in least]
                stories = _stories(starts, own, [h[2:] for h in found])
                rows.update((*key, whole, *h[:2], story) for h, story in zip(found, stories))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64() if i > 1 else pa.string()) for i, c in enumerate(zip(*rows))],
                ["host", "section", "source", "page", "subtree", "position", "story"],
            )


def _stored(frame: DataFrame, label: str) -> DataFrame:
    path = workspace(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


def _keys() -> list[Column]:
    """What a page is found by: host, section (the first folder of the path, or nothing) and a hash of the markup."""
    section = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)/", 1)
    return [host_of(F.col("url")).alias("host"), section.alias("section"), F.xxhash64("html").alias("source")]


def recurring(pages: DataFrame, least: int = LEAST_PAGES) -> tuple[DataFrame, DataFrame]:
    """The subtrees that recur on a host, in its scopes, which are the host and its sections, and the number of pages of
    each position there; position 0 counts all pages."""
    found = pages.select(*_keys(), "html").where("host IS NOT NULL")
    rows = _stored(found.mapInArrow(_subtrees, _ROWS).withColumn("at", F.xxhash64("host", "subtree")), "subtrees")
    often = rows.where("subtree <> 0").groupBy("at").agg(F.count_distinct("page").alias("n_all")).where(F.col("n_all") >= least)
    scopes = F.expr("explode(if(section = '', array(xxhash64(host)), array(xxhash64(host), xxhash64(host, section))))")
    is_section = F.col("scope") != F.xxhash64("host")
    places = (
        rows.select(scopes.alias("scope"), "position", "page")
        .groupBy("scope", "position").agg(F.count_distinct("page").alias("n_at")).where(F.col("n_at") >= least)
    )
    often, places = _stored(often, "often"), _stored(places, "places")
    some = _stored(rows.join(often, "at"), "recurring")
    return some.select(scopes.alias("scope"), "*").withColumn("is_section", is_section), places


def templates(some: DataFrame, places: DataFrame, least: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """``scope, subtree, position, n``: subtrees that are template at a position, or anywhere where that is null, and on how
    many different pages. Pages of the same text count once, and near copies are one story, so that copies of one article
    are not taken for a template."""
    n, section = F.col("n"), F.col("is_section")
    at_place = (
        some.groupBy("scope", "is_section", "subtree", "position")
        .agg(F.count_distinct("page").alias("n"), F.count_distinct("story").alias("stories"))
        .where((F.col("stories") >= least) & (F.col("stories") >= HALF * n))
        .join(places, ["scope", "position"])
        .where(n >= F.when(section, max(least, MANY)).otherwise(least))
        .where(n >= F.when(section, max(share, HALF)).otherwise(share) * F.col("n_at"))
        .select("scope", "subtree", "position", "n")
    )
    totals = places.where("position = 0").select("scope", F.col("n_at").alias("n_pages"))
    anywhere = (
        some.where(~section).select("scope", "subtree", "n_all").distinct()
        .where(F.col("n_all") >= max(least, MANY))
        .join(totals, "scope")
        .where(F.col("n_all") >= HALF * F.col("n_pages"))
        .select("scope", "subtree", F.lit(None).cast("long").alias("position"), F.col("n_all").alias("n"))
    )
    return at_place.union(anywhere)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for source, template in zip(_decoded(batch.column(2)), batch.column(3).to_pylist()):
            page = Page(source)
            keep = page.kept()
            if template:
                template = {(t["subtree"], t["position"]) for t in template}
                for _, _, start, end in [h for h in page.hashed(keep) if (h[0], h[1]) in template or (h[0], None) in template]:
                    keep[start:end] = [False] * (end - start)
            texts.append(page.text(keep))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame, least: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """One row per row of ``pages`` (``page_id``, ``url``, ``html``; others are ignored): ``page_id, url, text, n_chars``.

    Text is the articles of a page, else its ``main``, else its body, without furniture, hidden elements and templates;
    character references are decoded and white space runs are one space. A null or empty page has an empty text. A page
    whose URL is null or has no host loses no template. Broken markup is read as far as it goes. Repeated rows are
    extracted each; an empty table gives an empty table. Templates are written first, so that Spark knows their size when
    it plans the joins; a page is given those that stand on it, not those of its host.
    """
    some, places = recurring(pages, least)
    known = _stored(templates(some, places, least, share), "templates").select("scope", "subtree", "position").distinct()
    keys = ["host", "section", "source"]
    lists = _stored(
        some.select("scope", "subtree", *keys)
        .join(known, ["scope", "subtree"])
        .groupBy(*keys)
        .agg(F.collect_set(F.struct("subtree", "position")).alias("subtrees")),
        "lists",
    )
    named = pages.select("page_id", "url", F.col("html").alias("_html"), F.struct(*_keys()).alias("_key"))
    same = [F.col(f"_key.{k}") == lists[k] for k in keys]
    return (
        named.join(lists, same, "left")
        .select("page_id", "url", F.col("_html").alias("html"), "subtrees")
        .mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
    )
