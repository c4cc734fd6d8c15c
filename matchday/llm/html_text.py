"""Main text of web pages (operator 2): page structure, and suffix arrays over the pages of a host.

A page is read as a row of blocks (block elements part them; `br` and table
cells are white space). Its markup puts each block into a zone:

- dropped: inside menus, page headers, footers, sidebars, forms, dialogs, and
  elements whose class, id or role names an advert, notice, sidebar, comment
  section and the like (`sidebar`, `ad-slot`, but not `has-sidebar` or
  `category-social`); scripts, styles and comments have no text at all. Where a
  page has no other article or main element, one inside (or of) an element that
  is dropped for such a name is kept, unless the name is that of comments;
- main: inside `article`, else `main`, else an element named as content;
- open: what a `main` holds beside its articles, what lies beside an element that
  is only named as content, and all the text of a page without such marks;
- dropped too: what lies outside the `article` or `main` of a page that has one.

What lies outside the main zone goes into the page's stream. The streams of a
host's pages are searched together for long strings that occur in different
pages, by the suffix arrays of `suffix_dedup` with the host as group (so a host
that holds a third of all pages is spread over many buckets). Open blocks that
such strings cover are boilerplate; the unique runs between them stay. A page
whose open blocks are covered altogether is a copy of another and keeps them.

Blocks of the main zone go by strings that many pages of the host hold: at least
`MANY` distinct ones, and `SHARE` of the host's. Blocks that begin and end with
strings with which blocks of so many pages begin or end go into the stream too;
those that the suffix arrays find covered have their windows counted by distinct
pages, and go if windows of that many pages cover them. A page whose main blocks
are covered altogether keeps them. Main blocks below `MIN_REPEAT` bytes stay.

Defined results: null and empty html give an empty text, as do pages without
text; a null url is a host of its own; repeated rows are extracted each, and
count as one page when strings are searched; a null `page_id` is ordered first;
an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import read_table
from . import common
from .suffix_dedup import merged_spans, repeated_spans

MIN_REPEAT = 24     # bytes of a string that is searched for in other pages of the host
GRAM = 12
MANY = 8            # distinct pages with a string, at least, that takes a block out of the main zone
SHARE = 0.25        # and their share of the host's pages
DROPPED, MAIN, OPEN = 0, 1, 2
_NO_ID = -(1 << 63)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)"
                    r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?",
                        re.I)
_RAW = ("script", "style", "noscript", "template", "iframe", "svg", "title", "textarea", "object", "math", "canvas",
        "select", "button")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in _RAW}
_BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p
pre section summary table tbody tfoot thead tr ul""".split())
_SPACE = frozenset(("br", "td", "th", "wbr"))
_CONTAINER = frozenset("""article aside blockquote center details dialog div dl fieldset figure footer form header main
menu nav ol section table ul span p li""".split())
_DROPPED_TAGS = frozenset("nav footer aside form dialog menu".split())
_DROPPED_WORDS = frozenset("""ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs byline-share
comment comments commentlist consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter
notice notices notification overlay paywall popup promo promotion related recommended reader-comments replies reply respond
share sharing shares sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets
alert contentinfo complementary search""".split())
_COMMENT_WORDS = frozenset("comment comments commentlist disqus reader-comments replies reply respond".split())
# a name is dropped if it consists of words above and of these only
_BOX_WORDS = frozenset("""area article articles aside bar block bottom box btn button buttons center container content footer form
group header icon icons inline inner item items left link links list message native outer panel panes post posts region right
row section slot stories text thread title top unit wrap wrapper zone""".split())
KEPT, NAMED, HELD, GONE = 0, 1, 2, 3     # NAMED: dropped for a name; HELD: an article or main element in such a one
_PAGE_HEADER_WORDS = frozenset(("header", "site-header", "page-header"))
_CONTENT_WORDS = frozenset("""article-body article-content articlebody body-content content entry entry-content main main-content
maincontent post post-body post-content story story-body""".split())


def _drops(name: str) -> int:
    """How a name drops its element."""
    if name in _DROPPED_WORDS:
        return GONE if name in _COMMENT_WORDS else NAMED
    parts = [x for x in re.split(r"[-_]+", name) if x]
    told = [x for x in parts if x in _DROPPED_WORDS]
    if not told or any(x not in _DROPPED_WORDS and x not in _BOX_WORDS for x in parts):
        return KEPT
    return GONE if any(x in _COMMENT_WORDS for x in told) else NAMED


def _named(attributes: str) -> tuple[set[str], set[str], bool]:
    """Names of class, id and role, whole and parted at hyphens and underscores; whether the element is hidden."""
    names, words, hidden = set(), set(), False
    for m in _ATTRIBUTE.finditer(attributes):
        kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if kind == "hidden":
            hidden = True
        elif kind == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif kind in ("class", "id", "role"):
            for word in value.lower().split():
                names.add(word)
                words.add(word)
                words.update(re.split(r"[-_]+", word))
    return names, words, hidden


def blocks(page: str | None) -> list[tuple[str, int]]:
    """(text, zone) of the blocks of a page, in order."""
    page = page or ""
    found: list[tuple[str, int, int]] = []         # text, dropped, rank of the main container around it
    held: list[str] = []
    stack: list[tuple[str, int, int]] = []         # tag, dropped, rank: 3 article, 2 main, 1 content
    dropped, rank = KEPT, 0

    def close() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                found.append((text, dropped, rank))

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            held.append(page[at:])
            break
        held.append(page[at:m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        ending, attributes = bool(m[1] or m[4]), m[3] if m[2] else m[6]
        if tag in _SPACE:
            held.append(" ")
            continue
        if tag in _RAW:
            if not ending and not (attributes or "").rstrip().endswith("/"):
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in _BLOCK:
            close()
        if tag not in _CONTAINER:
            continue
        if ending:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag not in ("span", "p", "li") or i == len(stack) - 1:
                        if tag == "span":
                            if stack[i][1] != (stack[i - 1][1] if i else KEPT):
                                close()
                        del stack[i:]
                    break
                if tag in ("span", "p", "li") and stack[i][0] not in ("span", "p", "li"):
                    break
            dropped, rank = (stack[-1][1], stack[-1][2]) if stack else (KEPT, 0)
            continue
        if (attributes or "").rstrip().endswith("/"):
            continue
        names, words, hidden = _named(attributes) if attributes and attributes.strip() else (set(), set(), False)
        inner, drop = rank, dropped
        if tag == "p" or tag == "li":             # a new one ends the last
            while stack and stack[-1][0] in ("span", tag):
                stack.pop()
            drop, inner = (stack[-1][1], stack[-1][2]) if stack else (KEPT, 0)
        own = max(map(_drops, names), default=KEPT)
        if drop == GONE or tag in _DROPPED_TAGS or hidden or own == GONE or tag == "header" and not inner:
            drop = GONE
        elif own or not inner and names & _PAGE_HEADER_WORDS:
            drop = NAMED
        if drop == NAMED and tag in ("article", "main") and not inner:
            drop = HELD
        if drop in (KEPT, HELD):
            if tag == "article":
                inner = 3
            elif tag == "main" or "main" in words and tag in ("div", "section"):
                inner = max(inner, 2)
            elif tag in ("div", "section") and words & _CONTENT_WORDS:
                inner = max(inner, 1)
        if drop != dropped and tag == "span":
            close()
        if tag in ("span", "p", "li") and drop == dropped and inner == rank:
            if tag != "span":
                dropped, rank = drop, inner
            if tag == "span":
                stack.append((tag, drop, inner))
            continue
        stack.append((tag, drop, inner))
        dropped, rank = drop, inner
    close()
    if not any(r >= 2 and not d for _, d, r in found):
        found = [(t, KEPT if d == HELD else d, r) for t, d, r in found]
    best = max((r for _, d, r in found if not d), default=0)
    beside = 0 if best < 2 else 2         # least rank of the text beside the best container that may be part of the article
    return [(t, DROPPED if d else MAIN if best and r >= best else OPEN if r >= beside else DROPPED) for t, d, r in found]


def _key(string: bytes, host: int) -> int:
    return int.from_bytes(hashlib.blake2b(string, digest_size=8, salt=host.to_bytes(8, "little", signed=True)).digest(),
                          "little", signed=True)


def _ends(text: str, host: int) -> set[int]:
    """Keys of the strings that a block begins and ends with; none of a short block."""
    raw = text.encode()
    return {_key(raw[:MIN_REPEAT], host), _key(raw[-MIN_REPEAT:], host)} if len(raw) >= MIN_REPEAT else set()


def _candidate(text: str, host: int, keys: set[int]) -> bool:
    ends = _ends(text, host) if keys else set()
    return bool(ends) and ends <= keys


def stream_of(rows: list[tuple[str, int]], host: int = 0,
              keys: set[int] = frozenset()) -> tuple[str, list[tuple[int, int] | None]]:
    """The text outside the main zone and of main blocks with `keys` at both ends, and each block's place in bytes."""
    parts, places, at = [], [], 0
    for text, zone in rows:
        if zone == MAIN and not _candidate(text, host, keys):
            places.append(None)
            continue
        size = len(text.encode())
        parts.append(text)
        places.append((at, at + size))
        at += size + 1
    return "\n".join(parts), places


def _covered(place: tuple[int, int] | None, runs: list[tuple[int, int]]) -> bool:
    return place is not None and any(a <= place[0] and place[1] <= b for a, b in runs)


def main_text(rows: list[tuple[str, int]], runs: list[tuple[int, int]], host: int = 0,
              keys: set[int] = frozenset()) -> str:
    """Main and open blocks; those covered by `runs` of the stream are left out, unless all are."""
    kept = [(text, _covered(place, runs)) for (text, zone), place in zip(rows, stream_of(rows, host, keys)[1])
            if zone != DROPPED]
    uncovered = any(not covered for _, covered in kept)
    return "\n\n".join(t for t, covered in kept if not (covered and uncovered))


def _block_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for did, rid, host, h in zip(*(c.to_pylist() for c in batch.columns)):
            keys = set().union(*(_ends(text, host) for text, zone in blocks(h) if zone == MAIN))
            out += [(host, k, did, rid) for k in keys]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)],
                                         ["_host", "key", "_did", "_rid"])


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stream of each page, and the places of its main blocks (start, end, start, ...)."""
    for batch in batches:
        texts, main = [], []
        for host, h, keys in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
            rows = blocks(h)
            text, places = stream_of(rows, host, set(keys or ()))
            texts.append(text)
            main.append([x for (_, zone), place in zip(rows, places) if zone == MAIN and place for x in place])
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string()),
                                          pa.array(main, pa.list_(pa.int64()))],
                                         ["_did", "_rid", "_host", "raw", "main"])


def _windows(min_repeat: int):
    """Windows of the main blocks that spans cover."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for did, rid, host, raw, main, spans in zip(*(c.to_pylist() for c in batch.columns)):
                raw, runs = raw.encode(), merged_spans(spans)
                for lo, hi in zip(main[::2], main[1::2]):
                    if _covered((lo, hi), runs):
                        out += [(host, _key(raw[at:at + min_repeat], host), did, rid, at)
                                for at in range(lo, hi - min_repeat + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(5)],
                                             ["_host", "key", "_did", "_rid", "lo"])
    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each page; of pages with open blocks, the html, to be finished with the strings found."""
    for batch in batches:
        out, later = [], []
        for host, h, keys, spans in zip(*(batch.column(i).to_pylist() for i in (4, 5, 6, 7))):
            rows = blocks(h)
            open_too = any(zone == OPEN for _, zone in rows)
            later.append(h if open_too else None)
            out.append(None if open_too else main_text(rows, merged_spans(spans), host, set(keys or ())))
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.string()), pa.array(later, pa.string())],
                                         ["_did", "_rid", "page_id", "url", "text", "html"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [main_text(blocks(h), merged_spans(s))
               for h, s in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.string())], ["page_id", "url", "text"])


def _on_many(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    """The (_host, key) that lie on many distinct pages of their host."""
    return (rows.groupBy("_host", "key").agg(F.countDistinct("_rid").alias("n")).filter(F.col("n") >= MANY)
            .join(hosts, "_host").filter(F.col("n") >= SHARE * F.col("pages")).select("_host", "key"))


def host_of(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]*)", 1))


def extract(pages: DataFrame, min_repeat: int = MIN_REPEAT, bucket_bytes: int = 1 << 20) -> DataFrame:
    """(page_id, url, text) of each row of `pages(page_id, url, html)`."""
    did = F.coalesce(F.col("page_id").cast("long"), F.lit(_NO_ID))
    rid = F.xxhash64(did, F.coalesce("url", F.lit("")), F.coalesce("html", F.lit("")))
    group = F.xxhash64(F.lit("host"), host_of(F.col("url"))).alias("_host")
    rows = pages.select(did.alias("_did"), rid.alias("_rid"), group, F.col("page_id").cast("long").alias("page_id"), "url", "html")
    hosts = rows.groupBy("_host").agg(F.countDistinct("_rid").alias("pages"))
    ends = common.stored(rows.select("_did", "_rid", "_host", "html").mapInArrow(
        _block_ends, "_host long, key long, _did long, _rid long"), "block-ends")
    known = common.stored(_on_many(ends, hosts), "known-ends")
    page = ["_did", "_rid"]
    some = known.limit(1).count() > 0
    if some:       # candidates in the main zone
        keys = common.stored(ends.join(known, ["_host", "key"]).groupBy(*page).agg(F.collect_set("key").alias("keys")), "page-ends")
        rows = rows.join(keys, page, "left")
    else:
        rows = rows.withColumn("keys", F.lit(None).cast("array<long>"))
    streams = common.stored(rows.select(*page, "_host", "html", "keys").mapInArrow(
        _streams, "_did long, _rid long, _host long, raw string, main array<long>"), "streams")
    spans = repeated_spans(streams, min_repeat, "none", bucket_bytes, group="_host", gram=GRAM)
    if some:
        spans = common.stored(spans, "host-spans")
        windows = common.stored(streams.filter(F.size("main") > 0).join(spans, page)
                                .select(*page, "_host", "raw", "main", "spans").mapInArrow(
            _windows(min_repeat), "_host long, key long, _did long, _rid long, lo long"), "main-windows")
        many = (windows.join(_on_many(windows, hosts), ["_host", "key"]).groupBy(*page)
                .agg(F.collect_list(F.struct("lo", (F.col("lo") + min_repeat).alias("hi"))).alias("many")))
        rows = rows.join(many, page, "left")
    else:
        rows = rows.withColumn("many", F.lit(None).cast("array<struct<lo:long,hi:long>>"))
    parsed = rows.select(*page, "page_id", "url", "_host", "html", "keys", "many").mapInArrow(
        _texts, "_did long, _rid long, page_id long, url string, text string, html string")
    ready = parsed.filter("text is not null").select("page_id", "url", "text")
    later = (parsed.filter("text is null").select("_did", "_rid", "page_id", "url", "html")
             .join(spans, ["_did", "_rid"], "left").select("page_id", "url", "html", "spans")
             .mapInArrow(_finish, "page_id long, url string, text string"))
    return ready.union(later)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text",
                                                              F.char_length("text").cast("long").alias("n_chars"))
