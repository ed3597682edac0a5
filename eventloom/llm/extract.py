"""Main text of web pages: differencing against the nearest page of the same host, and the page's structure where that can't decide.

1. A page is parsed into lines (blocks of text), menus and footers included, with a 64-bit hash of each line.
2. Pages of a host with the same outline (the same lines) count as one page, at the smallest of their urls; then the pages of a url count as one.
   What is left is ordered by (host, path, url); the neighbour with the longer common path prefix is the partner (the one before on a tie).
   So a copy of a page, or another version of its url, is never its partner.
3. The lines of the longest common subsequence of a page and its partner are deleted, but for those that an <article> or <main> owns.
4. Structure decides on the lines that no partner shares: those in menus, headers, footers, sidebars, forms, adverts, notices or comments, by
   element, role or class, go; so does what stands outside of the <article> or <main> of a page that has one.

Differencing alone can't give the right text: it leaves menus and adverts that change from page to page, and deletes what articles
share; n_shared and n_structure say how many lines each rule removed. Pages are paired by a global order in ranges: no host is
gathered in one task, and only line hashes are shuffled and staged to pair them. Pages are parsed twice, for their hashes and for their text: staged texts would
take more disk than the parse takes time. Texts, and the lines of pages without an article, are shuffled once, to meet what their outline shares.

Defined cases: null html has no text; a null url is of the empty host; a page without another url and outline on its host has no partner and
keeps its lines; repeated rows have equal texts; broken markup is read to the end; an empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Runs, blocks, byte_set, neighbours, small_batches, stage, utf8
from .urlgraph import host_of, path_of

#: Elements whose content is never text; elements that are page furniture; elements that end a block.
RAW = frozenset("script style template noscript iframe object svg math canvas textarea title select option datalist audio video head".split())
FURNITURE = frozenset("nav footer aside form menu dialog button fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role that mark furniture; the second set only outside an article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice popup modal overlay "
    "newsletter subscribe signup sidebar menu nav navbar navigation breadcrumb breadcrumbs footer toolbar share sharing social related "
    "recommended comment comments disqus pagination pager complementary contentinfo search".split()
)
OUTER_MARKS = frozenset("header masthead banner alert".split())
FURNISHED, OUTSIDE, OWNED = range(3)
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)(?:>|\Z)", re.S)
_MARKED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z0-9]+")


def _is_furniture(name: str, attributes: str, inside: bool) -> bool:
    if name in FURNITURE or (name == "header" and not inside):
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    for m in _MARKED.finditer(attributes):
        words = set(_WORD.findall((m[1] or m[2] or m[3] or "").lower()))
        if words & MARKS or (not inside and words & OUTER_MARKS):
            return True
    return False


def lines_of(page: str) -> list[tuple[str, int]]:
    """The lines of a page in order, each with FURNISHED, OUTSIDE or OWNED (by an article or main element)."""
    lines: list[tuple[str, int]] = []
    text: list[str] = []
    lower = None
    inside = 0
    skip, depth = "", 0

    def flush() -> None:
        if text:
            line = " ".join("".join(text).split())
            text.clear()
            if line:
                lines.append((line, FURNISHED if skip else OWNED if inside else OUTSIDE))

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        piece = page[at : m.start() if m else end]
        if piece:
            text.append(entities.unescape(piece) if "&" in piece else piece)
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing = bool(m[1] or m[4])
        attributes = m[3] or m[6] or ""
        if name in BLOCKS:
            flush()
        if skip and name == skip:
            depth += -1 if closing else not attributes.endswith("/")
            if not depth:
                flush()
                skip = ""
        elif closing:
            if name in ("article", "main") and inside and not skip:
                inside -= 1
        elif name in RAW and not (skip and name == "head"):
            if not attributes.endswith("/"):
                at = _raw_end(lower := lower or page.lower(), name, at)
        elif skip or name in VOID or attributes.endswith("/"):
            continue
        elif name in ("article", "main"):
            inside += 1
        elif _is_furniture(name, attributes, bool(inside)):
            flush()
            lower = lower or page.lower()
            # furniture that nothing closes ends the page if it's a footer, and is no furniture else
            if name == "footer" or lower.find(f"</{name}", at) >= 0:
                skip, depth = name, 1
    flush()
    return lines


def _raw_end(lower: str, name: str, at: int) -> int:
    """Where a raw element ends; a head that nothing closes ends where the body begins."""
    close = lower.find(f"</{name}", at)
    if close < 0:
        if name != "head":
            return len(lower)
        close = lower.find("<body", at)
        return close if close >= 0 else at
    return lower.find(">", close) + 1 or len(lower)


def _strings(block: pa.RecordBatch, column: str) -> Iterator[str]:
    for k in range(block.num_rows):
        yield block.column(column)[k].as_py() or ""


def _hash(lines: list[list[str]]) -> list[list[int]]:
    flat = [x for own in lines for x in own]
    if not flat:
        return [[] for _ in lines]
    data, at = utf8(pa.array(flat, pa.string()))
    h = Runs(data, at, byte_set()).hashes().view(np.int64).tolist()
    out, k = [], 0
    for own in lines:
        out.append(h[k : k + len(own)])
        k += len(own)
    return out


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The kinds and hashes of the lines of every page; the text of the lines that an article owns, or all lines of a page without one."""
    for block in blocks(batches, "_html"):
        found = [lines_of(page) for page in _strings(block, "_html")]
        lines, kinds = [[x for x, _ in own] for own in found], [[k for _, k in own] for own in found]
        text = [" ".join(x for x, k in own if k == OWNED) if OWNED in kind else None for own, kind in zip(found, kinds, strict=True)]
        keep = ["page_id", "url", "host", "path"]
        columns = [block.column(c) for c in keep]
        columns += [pa.array(text, pa.string()), pa.array([own if t is None else None for own, t in zip(lines, text, strict=True)], pa.list_(pa.string()))]
        columns += [pa.array(kinds, pa.list_(pa.int8())), pa.array(_hash(lines), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, [*keep, "text", "lines", "kinds", "hashes"])


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in a of a longest common subsequence of a and b: the longest increasing run of matches, in n log n of them."""
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(a) - head and tail < len(b) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    where = defaultdict(list)
    for j in range(len(b) - tail - 1, head - 1, -1):
        where[b[j]].append(j)
    ends: list[int] = []
    links: list[tuple] = []
    for i in range(head, len(a) - tail):
        for j in where.get(a[i], ()):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    middle = []
    link = links[-1] if links else None
    while link:
        middle.append(link[0])
        link = link[1]
    return [*range(head), *reversed(middle), *range(len(a) - tail, len(a))]


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, outline, shared): the places of the lines that an outline shares with its partner."""
    for batch in batches:
        shared = []
        for at in batch.select(["path", "hashes", "before", "after", "host"]).to_pylist():
            near = [x for x in (at["before"], at["after"]) if x and x["host"] == at["host"]]
            partner = max(near, key=lambda x: _prefix(x["at"]["path"], at["path"])) if near else None
            shared.append(common_lines(at["hashes"], partner["hashes"]) if partner else [])
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("outline"), pa.array(shared, pa.list_(pa.int32()))], ["host", "outline", "shared"])


def kept_text(owned: str | None, lines: list[str] | None, kinds: list[int], shared: set[int]) -> tuple[str, int, int]:
    """(text, lines removed because they're shared, lines removed by structure)."""
    left = [k for k, kind in enumerate(kinds) if kind != OWNED and k not in shared]
    by_partner = sum(kind != OWNED for kind in kinds) - len(left)
    kept = [] if lines is None else [lines[k] for k in left if kinds[k] == OUTSIDE]
    return (" ".join(kept) if owned is None else owned), by_partner, len(left) - len(kept)


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("text", "lines", "kinds", "shared"))
        found = [kept_text(text, lines, kinds, set(shared or ())) for text, lines, kinds, shared in zip(*columns, strict=True)]
        text, *removed = zip(*found, strict=True) if found else ((), (), ())
        out = [batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), *(pa.array(x, pa.int32()) for x in removed)]
        yield pa.RecordBatch.from_arrays(out, ["page_id", "url", "text", "n_shared", "n_structure"])


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path, text, lines, kinds, hashes, outline for each row of pages."""
    small_batches(pages.sparkSession)
    raw = pages.select("page_id", "url", pages["html"].alias("_html"))
    placed = raw.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, host string, path string, text string, lines array<string>, kinds array<tinyint>, hashes array<bigint>"
    return placed.mapInArrow(_parse, schema).withColumn("outline", F.xxhash64("hashes", "kinds"))


def shared_lines(lines: DataFrame) -> DataFrame:
    """(host, outline, shared) of each outline of each host."""
    outlines = lines.groupBy("host", "outline").agg(F.min(F.struct("path", "url")).alias("at"), F.first("hashes").alias("hashes"))
    outlines = stage(outlines, "outlines")
    urls = outlines.groupBy("host", "at").agg(F.min_by("hashes", "outline").alias("hashes"))
    paired = neighbours(urls, ["host", "at"], ["host", "at", "hashes"]).select("host", "at", "before", "after")
    rows = outlines.join(paired, ["host", "at"]).select("host", "outline", F.col("at.path").alias("path"), "hashes", "before", "after")
    return rows.mapInArrow(_difference, "host string, outline long, shared array<int>")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_shared, n_structure for each row of pages."""
    lines = parsed(pages)
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = lines.select("page_id", "url", "host", "outline", "text", "lines", "kinds").join(shared_lines(lines), ["host", "outline"], "left")
    out = rows.mapInArrow(_keep, f"page_id {kind}, url string, text string, n_shared int, n_structure int")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared", "n_structure")
