"""HTML extraction by nearest-URL page differencing.

Pages are dealt by ranges of (host, URL path), so that a large host is many tasks and a page's neighbours in
URL order are in its task; the first and last page of a range are settled apart, together with the ranges
beside it. Each page is cut into text lines, one per block. It is paired with the neighbour on its host whose
path shares the longer run of leading segments (of equal ones the one before); the two pages' lines are aligned
by longest common subsequence, and the shared lines go as boilerplate.

Two kinds of lines aren't left to the differencing, as the markup says what they are: lines of a declared main
part (<article>, <main>, role=main) are the page's own, however many pages repeat them; lines in menus, headers,
footers, sidebars, notices, adverts, forms and reader comments go, shared or not. All other lines, on pages
with a declared main part or without, stay unless the paired page shares them.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import materialize, ship_package
from .common import packed, slices, text_of, unpacked

NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
PLAIN = re.compile(r"[^>\"']*")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
#: HTML's elements by what they do to text, and the names by which noise is known.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("script", "style")}
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - frozenset("body html option caption tbody td tfoot th thead tr".split())
NOISE_TAGS = frozenset("aside audio button canvas dialog footer form head header iframe input math menu nav noscript object option script select style svg template textarea title video".split())
NOISE_NAMES = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies copyright disqus footer header login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo recommended related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
NOISE_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())


def tokens(source: str) -> Iterator[tuple[str | None, bool, str, int]]:
    """(tag, closing, attributes, end) of each tag, and (None, False, text, end) of each run of text. send(position)
    goes on from there. Comments and declarations are left out. Linear: what isn't found once isn't looked for again.
    """
    at, end = 0, len(source)
    absent: set[str] = set()

    def find(what: str, start: int) -> int:
        if what in absent:
            return -1
        got = source.find(what, start)
        if got < 0:
            absent.add(what)
        return got

    while at < end:
        if source[at] != "<":
            stop = source.find("<", at)
            stop = end if stop < 0 else stop
            at = (yield None, False, source[at:stop], stop) or stop
            continue
        if source.startswith("<!--", at):
            stop = find("-->", at + 4)
            at = end if stop < 0 else stop + 3
            continue
        if source.startswith(("<!", "<?"), at):
            stop = find(">", at)
            at = end if stop < 0 else stop + 1
            continue
        m = NAME.match(source, at + 1)
        k = m.end() if m else -1
        while k >= 0:
            k = PLAIN.match(source, k).end() if find(">", k) >= 0 else end
            if k >= end:
                k = -1  # the tag never ends: a bare "<"
            elif source[k] == ">":
                break
            else:
                shut = find(source[k], k + 1)
                k = shut + 1 if shut >= 0 else -1
        if k < 0:
            at = (yield None, False, "<", at + 1) or at + 1
        else:
            at = (yield m[2].lower(), bool(m[1]), source[m.end() : k], k + 1) or k + 1


class Line(NamedTuple):
    text: str
    main: bool
    noise: bool


def page_lines(source: str) -> list[Line]:
    """The page's non-empty text lines, one per block, white space runs as one space."""
    lines: list[Line] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, in main, in noise
    opened: Counter[str] = Counter()
    parts: list[str] = []
    main = noise = False

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            lines.append(Line(text, main, noise))

    def close(k: int) -> None:
        opened.subtract(x[0] for x in stack[k:])
        del stack[k:]

    found, resume = tokens(source), None
    while True:
        try:
            tag, closing, inner, at = found.send(resume)
        except StopIteration:
            break
        resume = None
        if tag is None:
            parts.append(inner)
            continue
        if closing:
            if tag in BLOCKS or tag in NOISE_TAGS:
                flush()
            if opened[tag] > 0:
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
                main, noise = stack[-1][1:] if stack else (False, False)
            continue
        if tag in BLOCKS or tag in NOISE_TAGS:
            flush()
        elif tag in ("br", "img", "wbr") and tag != "wbr":
            parts.append(" ")
        if tag in CLOSES_P and opened["li" if tag == "li" else "p"] > 0:
            shut = "li" if tag == "li" else "p"
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == shut:
                    close(k)
                    break
                if stack[k][0] in BLOCKS and stack[k][0] != "p":
                    break
            main, noise = stack[-1][1:] if stack else (False, False)
        if tag in RAW:
            shut = RAW[tag].search(source, at)
            resume = shut.end() if shut else len(source)
            continue
        if tag in VOID or inner.rstrip().endswith("/") and tag not in BLOCKS:
            continue
        own_main, own_noise = main, noise or tag in NOISE_TAGS
        if inner:
            for name, *values in ATTRIBUTE.findall(inner):
                value = "".join(values).lower()
                if name.lower() in ("class", "id"):
                    own_noise |= not NOISE_NAMES.isdisjoint(re.split(r"[^a-z0-9]+", value)) and tag not in ("body", "html")
                elif name.lower() == "role":
                    own_noise |= value in NOISE_ROLES
                    own_main |= value == "main"
                elif name.lower() == "style":
                    own_noise |= bool(re.search(r"display\s*:\s*none", value))
                elif name.lower() == "aria-hidden":
                    own_noise |= value == "true"
            own_noise |= bool(re.search(r"(?:^|\s)hidden(?:\s|=|$)", inner))
        own_main |= tag in ("article", "main")
        stack.append((tag, own_main, own_noise))
        opened[tag] += 1
        main, noise = own_main, own_noise
    flush()
    return lines


#: Bytes of html that are cut at once.
SLICE_BYTES = 1 << 21
#: Most bits that the rows of one alignment hold; beyond, it is cut in halves.
MOST_BITS = 1 << 26


def _row(a: list[int], where: dict[int, int], full: int) -> int:
    """The last row of the bit-parallel table: unset bits mark where the common subsequence grows along b."""
    row = full
    for x in a:
        u = row & where.get(x, 0)
        row = ((row + u) | (row - u)) & full
    return row


def _places(b: list[int]) -> dict[int, int]:
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    return where


def _lengths(row: int, n: int) -> np.ndarray:
    """The length of the common subsequence with each prefix of b."""
    bits = np.unpackbits(np.frombuffer(row.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]
    return np.append(0, np.cumsum(1 - bits.astype(np.int64)))


def _aligned(a: list[int], b: list[int], at: int, found: set[int]) -> None:
    """Adds the positions (from at on) of a in one longest common subsequence with b. In linear space: a long a is
    halved where the halves' tables meet best."""
    if not a or not b:
        return
    if len(a) * len(b) > MOST_BITS and len(a) > 1:
        half, full = len(a) // 2, (1 << len(b)) - 1
        ahead = _lengths(_row(a[:half], _places(b), full), len(b))
        back = _lengths(_row(a[half:][::-1], _places(b[::-1]), full), len(b))[::-1]
        cut = int(np.argmax(ahead + back))
        _aligned(a[:half], b[:cut], at, found)
        _aligned(a[half:], b[cut:], at + half, found)
        return
    where, full = _places(b), (1 << len(b)) - 1
    row, rows = full, []
    for x in a:
        u = row & where.get(x, 0)
        row = ((row + u) | (row - u)) & full
        rows.append(row)
    i, j = len(a), len(b)
    while i and j:
        bit = 1 << (j - 1)
        if rows[i - 1] & bit:
            j -= 1
        elif i > 1 and not rows[i - 2] & bit:
            i -= 1
        else:
            i -= 1
            j -= 1
            found.add(at + i)


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in a of one longest common subsequence with b. Lines that the other list lacks, and equal lines at both
    ends, are set apart first."""
    both = {x: k for k, x in enumerate(set(a) & set(b))}
    ia, ib = [k for k, x in enumerate(a) if x in both], [x for x in b if x in both]
    n = min(len(ia), len(ib))
    top = next((k for k in range(n) if a[ia[k]] != ib[k]), n)
    low = next((k for k in range(n - top) if a[ia[-1 - k]] != ib[-1 - k]), n - top)
    found: set[int] = set()
    _aligned([both[a[k]] for k in ia[top : len(ia) - low]], [both[x] for x in ib[top : len(ib) - low]], 0, found)
    return {ia[k] for k in range(top)} | {ia[len(ia) - 1 - k] for k in range(low)} | {ia[top + k] for k in found}


def own_text(lines: list[Line], other: list[Line] | None) -> str:
    """The page's text: what the markup declares main, and what else the paired page doesn't share, without marked noise."""
    shared = common_lines([x.text for x in lines], [x.text for x in other]) if other else set()
    return "\n".join(x.text for k, x in enumerate(lines) if not x.noise and (x.main or k not in shared))


def nearness(a: str, b: str) -> int:
    """Leading path segments that two paths share."""
    n = 0
    for x, y in zip(a.split("/"), b.split("/"), strict=False):
        if x != y:
            break
        n += 1
    return n


class Page:
    """A page and its repeated rows; its lines are cut when they are first asked for."""

    def __init__(self, rows: list[pa.Array], host: str, path: str, source: str):
        self.rows, self.host, self.path, self.source = rows, host, path, source
        self._lines: list[Line] | None = None

    @property
    def lines(self) -> list[Line]:
        if self._lines is None:
            self._lines = page_lines(self.source)
        return self._lines


def paired_text(page: Page, before: Page | None, after: Page | None) -> str:
    """The page's own text against the nearer of its neighbours on its host, the one before if both are equal."""
    near = [p for p in (before, after) if p is not None and p.host == page.host and page.host]
    return own_text(page.lines, max(near, key=lambda p: nearness(p.path, page.path)).lines if near else None)


def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[Page]:
    """The pages of a range in order: rows of one page (equal html and page_id at one URL) come together."""
    page = key = None
    for b in slices(batches, 3, SLICE_BYTES):
        for k, (host, path, h, tie) in enumerate(zip(*(b.column(c).to_pylist() for c in (1, 2, 3, 4)), strict=True)):
            row = b.column(0).slice(k, 1)
            if page is not None and key == (host, path, tie):
                page.rows.append(row)
                continue
            if page is not None:
                yield page
            page, key = Page([row], host, path, h), (host, path, tie)
    if page is not None:
        yield page


def settled(found: Iterator[tuple[Page, str]]) -> Iterator[pa.RecordBatch]:
    """row and text of the pages, with their repeated rows."""
    done: list[tuple[pa.Array, str]] = []
    for page, text in found:
        done.extend((row, text) for row in page.rows)
        if len(done) >= 500:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([d[0] for d in done]), pa.array([d[1] for d in done], pa.string())], ["row", "text"])
            done.clear()
    if done:
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([d[0] for d in done]), pa.array([d[1] for d in done], pa.string())], ["row", "text"])


def settle_inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pages of a range but its first and last."""

    def texts():
        before = here = None
        for after in ranged(batches):
            if before is not None:
                yield here, paired_text(here, before, after)
            before, here = here, after

    return settled(texts())


#: What is known of the first and last page of a range: the range, whether the page is its first and its last, the
#: page, and its neighbour within the range. A page is one row without row; its rows follow without the page.
END_PAGE = ("host", "path", "h", "inner_host", "inner_path", "inner_h")
END = [("part", "int", pa.int32()), ("first", "boolean", pa.bool_()), ("last", "boolean", pa.bool_()), *[(c, "string", pa.string()) for c in END_PAGE]]


def range_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and last page of a range, each once, and their rows."""
    part = TaskContext.get().partitionId()
    first = second = before = last = None
    for page in ranged(batches):
        first, second = first or page, second or (page if first else None)
        before, last = last, page
    for page, inner, is_first, is_last in ((first, second, True, second is None), (last if second else None, before, False, True)):
        if page is not None:
            known = [page.host, page.path, page.source, *((inner.host, inner.path, inner.source) if inner else (None,) * 3)]
            rows = pa.concat_arrays(page.rows)
            for r, values in ((pa.nulls(1, rows.type), known), (rows, [None] * len(END_PAGE))):
                cells = [part, is_first, is_last, *values]
                yield pa.RecordBatch.from_arrays([r, *[pa.array([v] * len(r), t) for v, (_, _, t) in zip(cells, END, strict=True)]], ["row", *[n for n, _, _ in END]])


def settle_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, first, last and text of pages that stand beside the one before them and the one after."""
    for b in batches:
        for x in b.to_pylist():
            here, before, after = (Page([], x[f"{k}host"], x[f"{k}path"], x[f"{k}h"]) if x[f"{k}h"] is not None else None for k in ("", "before_", "after_"))
            yield pa.RecordBatch.from_pydict({"part": pa.array([x["part"]], pa.int32()), "first": [x["first"]], "last": [x["last"]], "text": pa.array([paired_text(here, before, after)], pa.string())})


def end_texts(ends: DataFrame) -> DataFrame:
    """row and text of the ends of all ranges. The page before a range's first is the last of the range before that has
    pages, and the other way round: ranges meet on their numbers, so that no task has the ends of all."""
    pages = ends.where("row IS NULL").drop("row")
    order = Window.orderBy("part")  # one row for each range
    beside = pages.where("first").select("part", F.lag("part").over(order).alias("left"), F.lead("part").over(order).alias("right"))
    side = lambda end, key, name: pages.where(end).select(F.col("part").alias(key), *[F.col(c).alias(f"{name}{c}") for c in ("host", "path", "h")])
    met = pages.join(beside, "part").join(side("last", "left", "l_"), "left", "left").join(side("first", "right", "r_"), "right", "left")
    pick = lambda end, name, c: F.when(F.col(end), F.col(f"{name}{c}")).otherwise(F.col(f"inner_{c}"))
    cols = [pick(end, name, c).alias(f"{to}{c}") for end, name, to in (("first", "l_", "before_"), ("last", "r_", "after_")) for c in ("host", "path", "h")]
    texts = met.select("part", "first", "last", "host", "path", "h", *cols).mapInArrow(settle_ends, "part int, first boolean, last boolean, text string")
    return ends.where("row IS NOT NULL").select("row", "part", "first", "last").join(texts, ["part", "first", "last"]).select("row", "text")


def extract_text(pages: DataFrame) -> DataFrame:
    """pages with text (main text, empty if none) and n_chars in place of html; other columns stay.

    Null html is an empty page. Pages without a url, or alone on their host, have no partner and are judged
    by their markup. Repeated rows are each returned and don't pair; pages with equal paths may pair. The pages
    are shuffled once: both passes, over the inner pages and over the ranges' ends, read the same exchange. The
    ends, with their neighbours at most four pages a range, are written and meet the neighbouring ranges' by number. An
    empty table gives an empty table.
    """
    ship_package(pages.sparkSession)
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    host = F.lower(F.regexp_extract(F.coalesce("row.url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(F.coalesce("row.url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    base = packed(pages).select("row", host.alias("host"), path.alias("path"), F.xxhash64("row.html", "row.page_id").alias("tie"))
    dealt = base.repartitionByRange(n, "host", "path", "tie").sortWithinPartitions("host", "path", "tie")
    rest = [c for c in pages.columns if c.lower() != "html"]
    slim = dealt.select(F.struct(*[F.col(f"row.`{c}`") for c in rest]).alias("row"), "host", "path", text_of("row.html").alias("h"), "tie")
    shape = slim.select("row", F.lit(None).cast("string").alias("text")).schema
    # row is null in a page's own row
    known = slim.select(*[F.lit(None).cast(t).alias(n) for n, t, _ in END]).schema
    ends = materialize(slim.mapInArrow(range_ends, StructType([StructField("row", slim.schema["row"].dataType, True), *known.fields])))
    whole = slim.mapInArrow(settle_inner, shape).unionByName(end_texts(ends))
    return unpacked(whole, rest, {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")})
