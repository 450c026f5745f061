"""Main text of web pages: structure first, then a host's suffix array against repeated text.

Each page's html is cut into blocks of text. Structure settles most of them:
blocks in menus, headers, footers, sidebars, notices, adverts, forms and reader
comments go; where a page marks its article (``article``, ``main``, a role, or
a content container), its other blocks in there stay and all others go.

Pages without such a mark are settled by repetition. The token streams of all
blocks outside an article are concatenated host by host, and a suffix array of
the run gives the substrings of DEPTH tokens or more that stand in several
places. Each task builds the arrays of its own pages; groups of suffixes that
agree in DEPTH tokens are merged over tasks by host and hash, so that a host of
any size is spread over all tasks and the result is that of one array for each
host. Where such a group has pages of unlike content, its tokens are covered;
covered runs are boilerplate and go, unique runs stay, in page order. Ranks of
DEPTH tokens are enough for that: a token lies in a repeated substring of DEPTH
tokens or more, however long, just if it lies in a repeated one of DEPTH.

Defined results: null and empty html gives an empty text; a page without a
block left too. Pages of one host with equal content count once, so copies
don't remove each other. Rows with null ids or urls (one host without name)
and repeated rows are treated like all others. Only page_id, url and html are
read, so other columns never clash.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_long, fold_hashes, mix

#: Tokens of a repeated substring at least.
DEPTH = 6
#: Tokens of one suffix array at about.
ARRAY_TOKENS = 1 << 19

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PARTS = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Elements whose content is no html.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that don't break a block.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Elements that never hold an article's text.
CHROME = {"nav", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "svg", "canvas", "object", "button", "select", "textarea", "head", "title", "dialog", "menu", "audio", "video", "map", "option", "datalist", "fieldset", "noembed", "noframes", "xmp"}
CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "form", "status", "note", "tablist"}
#: Words in a class or an id that mark what is no article's text.
CHROME_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adbox", "adslot", "sponsor", "sponsored", "promo", "promos", "promotion", "promoted", "banner",
    "nav", "navbar", "navigation", "navi", "menu", "menus", "submenu", "breadcrumb", "breadcrumbs", "crumbs", "sidebar", "sidebars", "side", "aside", "rail", "widget", "widgets",
    "footer", "foot", "footnav", "header", "masthead", "topbar", "toolbar", "subheader", "cookie", "cookies", "consent", "gdpr", "privacy", "notice", "notices", "notification", "alert", "alerts", "popup", "modal", "overlay", "lightbox",
    "subscribe", "subscription", "newsletter", "signup", "signin", "login", "register", "share", "sharing", "social", "follow", "related", "recommended", "recommendations", "recirc", "trending", "popular", "readmore", "more",
    "comment", "comments", "commentlist", "disqus", "respond", "reply", "replies", "discussion", "feedback", "reviews", "pagination", "pager", "paging", "copyright", "legal", "disclaimer", "terms", "skip", "search", "form", "outbrain", "taboola", "tags", "tagcloud", "hidden",
}
CONTENT_NAMES = {"article", "content", "maincontent", "articlebody", "entry", "post", "story", "main", "body", "text"}
#: Before a chrome word these say that the element only has such a part beside it.
BESIDE = {"has", "with", "no", "without", "not"}
_CLOSED_BY = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: What a block is: article text, no article text, or text that only repetition can settle.
ARTICLE, OTHER, OPEN = 0, 1, 2


def _names(value: str) -> list[str]:
    return _NAME_PARTS.findall(_CAMEL.sub(" ", value).lower())


def _chrome(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Whether an element holds no article's text, by its name, role, class and id."""
    if tag in CHROME or (tag == "header" and not in_article):
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")):
        return True
    if attributes.get("role", "").lower() in CHROME_ROLES:
        return True
    if tag in ("html", "body", "main"):
        return False
    for key in ("class", "id"):
        for word in attributes.get(key, "").split():
            parts = _names(word)
            if any(p in CHROME_NAMES and not (i and parts[i - 1] in BESIDE) for i, p in enumerate(parts)):
                return not (in_article and parts in (["header"], ["entry", "header"], ["post", "header"], ["article", "header"]))
    return False


def _container(tag: str, attributes: dict[str, str]) -> int:
    """How strongly an element says that it is the article: 3 article, 2 main, 1 by class or id, 0 not at all."""
    if tag == "article" or attributes.get("role") == "article" or "articlebody" in attributes.get("itemprop", "").lower():
        return 3
    if tag == "main" or attributes.get("role") == "main":
        return 2
    if tag in ("div", "section", "td") and attributes:
        for key in ("class", "id"):
            for word in attributes.get(key, "").split():
                parts = _names(word)
                if parts and all(p in CONTENT_NAMES for p in parts):
                    return 1
    return 0


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, ARTICLE, OTHER or OPEN) of each block of a page, in order."""
    out: list[tuple[list[str], bool, int]] = []  # pieces, chrome, strongest container
    stack: list[tuple[str, bool, int]] = []
    pieces: list[str] = []

    def end_block() -> None:
        if pieces:
            _, chrome, container = stack[-1] if stack else ("", False, 0)
            out.append((pieces.copy(), chrome, container))
            pieces.clear()

    at, n = 0, len(page)
    for m in _TAG.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            pieces.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                pieces.append(htmllib.escape(m[0][9:-3], False))
            continue
        tag = tag.lower()
        block = tag not in INLINE
        if m[1]:
            if block:
                end_block()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if not block and (stack[i][1] != (stack[-1][1])):
                        end_block()
                    del stack[i:]
                    break
            continue
        if tag in VOID:
            if block:
                end_block()
            continue
        attributes = {k.lower(): htmllib.unescape(a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(m[3])} if m[3].strip(" /\n\t") else {}
        if block:
            end_block()
            closes = _CLOSED_BY.get(tag, {"p"} if tag in ("div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "blockquote", "pre", "form", "nav", "footer", "header", "aside", "main", "dl", "hr", "figure") else set())
            for i in range(len(stack) - 1, max(len(stack) - 6, -1), -1):
                if stack[i][0] in closes:
                    del stack[i:]
                    break
                if stack[i][0] not in INLINE:
                    break
        _, chrome, container = stack[-1] if stack else ("", False, 0)
        own = _container(tag, attributes)
        now = chrome or _chrome(tag, attributes, container >= 1 or own >= 1)
        if now != chrome and not block:
            end_block()
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
            at = close.end() if close else n
            continue
        if not (m[3] or "").endswith("/") or block is False:
            stack.append((tag, now, max(container, own)))
    if at < n:
        pieces.append(page[at:])
    end_block()
    seen = []
    for parts, chrome, container in out:
        text = " ".join(htmllib.unescape("".join(parts)).split())
        if text:
            seen.append((text, chrome, container))
    best = max((c for _, chrome, c in seen if not chrome), default=0)
    return [(t, OTHER if chrome or (best and c < best) else ARTICLE if best else OPEN) for t, chrome, c in seen]


def _token_hashes(text: str) -> np.ndarray:
    return np.array([hash_word(w) for w in text.lower().split()], np.uint64)


_words: dict[str, int] = {}


def hash_word(w: str) -> int:
    """A 64-bit hash that is the same in every process (FNV-1a, finished)."""
    h = _words.get(w)
    if h is None:
        if len(_words) > 200_000:
            _words.clear()
        h = 0xCBF29CE484222325
        for b in w.encode("utf-8", "surrogatepass"):
            h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
        _words[w] = h
    return h


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page: text if structure settles it, else its open blocks; and the stream of tokens outside an article."""
    for whole in batches:
        for k in range(0, whole.num_rows, 512):
            batch = whole.slice(k, 512)
            text, open_blocks, stream, place, content = [], [], [], [], []
            for page in batch.column("html").to_pylist():
                found = blocks(page or "")
                is_open = [t for t, kind in found if kind == OPEN]
                text.append(None if is_open else " ".join(t for t, kind in found if kind == ARTICLE))
                open_blocks.append(is_open)
                tokens, owner, i = [], [], 0
                for t, kind in found:
                    if kind != ARTICLE:
                        words = _token_hashes(t)
                        tokens.append(words)
                        owner.append(np.full(len(words), i if kind == OPEN else -1, np.int64))
                        i += kind == OPEN
                flat = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
                stream.append(as_long(flat))
                place.append(np.concatenate(owner) if owner else np.zeros(0, np.int64))
                whole_page = np.array([hash_word(t) for t, _ in found], np.uint64)
                content.append(int(mix(np.array([int(whole_page.sum()) & (2**64 - 1)], np.uint64)).view(np.int64)[0]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid"), batch.column("page_id"), batch.column("url"), batch.column("host"), pa.array(text, pa.string()), pa.array(open_blocks, pa.list_(pa.string())), pa.array(stream, pa.list_(pa.int64())), pa.array(place, pa.list_(pa.int64())), pa.array(content, pa.int64())],
                ["uid", "page_id", "url", "host", "text", "blocks", "stream", "place", "content"],
            )


def suffix_array(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, rank of each suffix) by their first ``depth`` tokens; prefix doubling, each round one sort."""
    _, rank = np.unique(tokens, return_inverse=True)
    n, have = len(tokens), 1
    while have < depth:
        step = min(have, depth - have)
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:]
        order = np.lexsort((after, rank))
        new = np.r_[True, (rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1])] if n else np.zeros(0, bool)
        out = np.empty(n, np.int64)
        out[order] = np.cumsum(new) - 1
        rank, have = out, have + step
    return np.argsort(rank, kind="stable"), rank


def _shared_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, h, low, high): a row for each group of suffixes of a host that agree in DEPTH tokens, with the least and greatest content hash."""
    for batch in batches:
        streams, first = batch.column("stream"), 0
        sizes = np.array([len(x) for x in streams], np.int64)
        while first < len(sizes):
            stop = max(first + 1, int(np.searchsorted(np.cumsum(sizes[first:]), ARRAY_TOKENS, "right")) + first)
            part = batch.slice(first, stop - first)
            first = stop
            n = sizes[stop - part.num_rows : stop]
            tokens = part.column("stream").flatten().to_numpy().view(np.uint64)
            page = np.repeat(np.arange(part.num_rows), n)
            hosts = part.column("host").to_pylist()
            codes = {h: i for i, h in enumerate(dict.fromkeys(hosts))}
            host = np.array([codes[h] for h in hosts], np.uint64)[page]
            content = part.column("content").to_numpy()[page]
            if len(tokens) < DEPTH:
                continue
            # a host's tokens differ from all others', so no group spans two hosts
            order, rank = suffix_array(mix(tokens ^ mix(host + np.uint64(1))), DEPTH)
            whole = np.zeros(len(tokens), bool)
            whole[: len(tokens) - DEPTH + 1] = page[: len(tokens) - DEPTH + 1] == page[DEPTH - 1 :]
            order = order[whole[order]]
            if not len(order):
                continue
            r = rank[order]
            heads = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            h = fold_hashes([tokens[order[heads] + i] for i in range(DEPTH)], DEPTH)
            names = list(codes)
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[int(i)] for i in host[order[heads]]], pa.string()), pa.array(as_long(h)), pa.array(np.minimum.reduceat(content[order], heads)), pa.array(np.maximum.reduceat(content[order], heads))],
                ["host", "h", "low", "high"],
            )


def _open_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, host, h, at) of each substring of DEPTH tokens of open pages."""
    for batch in batches:
        uid, host = batch.column("uid").to_pylist(), batch.column("host").to_pylist()
        for i, tokens in enumerate(batch.column("stream")):
            t = tokens.values.to_numpy(zero_copy_only=False).view(np.uint64)
            if len(t) >= DEPTH:
                k = len(t) - DEPTH + 1
                h = fold_hashes([t[j : j + k] for j in range(DEPTH)], DEPTH)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, uid[i])), pa.array([host[i]] * k, pa.string()), pa.array(as_long(h)), pa.array(np.arange(k, dtype=np.int32))], ["uid", "host", "h", "at"])


def _unique_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, text) of open pages: their open blocks without the tokens that repeats cover."""
    for batch in batches:
        out = []
        for parts, place, covered in zip(batch.column("blocks").to_pylist(), batch.column("place").to_pylist(), batch.column("covered").to_pylist(), strict=True):
            gone = np.zeros(len(place), bool)
            for a in covered or ():
                gone[a : a + DEPTH] = True
            keep: list[list[str]] = [[] for _ in parts]
            left = [p.split() for p in parts]
            at = [0] * len(parts)
            for i, g in zip(place, gone.tolist(), strict=True):
                if i >= 0:
                    if not g:
                        keep[i].append(left[i][at[i]])
                    at[i] += 1
            out.append(" ".join(" ".join(w) for w in keep if w))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])


def host_of(url: Column) -> Column:
    """The host in an url, lower-cased; '' if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def main_text(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars."""
    scratch = Scratch(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.select(F.xxhash64("page_id", "url", "html").alias("uid"), "page_id", "url", host_of(F.col("url")).alias("host"), "html")
    parsed = scratch.save(rows.mapInArrow(_parse, "uid long, page_id long, url string, host string, text string, blocks array<string>, stream array<long>, place array<long>, content long"), "blocks")
    starts = parsed.where("size(stream) > 0").select("host", "content", "stream").mapInArrow(_shared_starts, "host string, h long, low long, high long")
    repeated = starts.groupBy("host", "h").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("host", "h")
    open_pages = parsed.where("text is null")
    windows = open_pages.select("uid", "host", "stream").dropDuplicates(["uid"]).mapInArrow(_open_windows, "uid long, host string, h long, at int")
    covered = windows.join(repeated, ["host", "h"], "left_semi").groupBy("uid").agg(F.collect_set("at").alias("covered"))
    settled = open_pages.join(covered, "uid", "left").select("page_id", "url", "blocks", "place", "covered").mapInArrow(_unique_runs, "page_id long, url string, text string")
    texts = parsed.where("text is not null").select("page_id", "url", "text").unionAll(settled)
    return texts.withColumn("n_chars", F.length("text").cast("long"))
