"""Main text of web pages: structure, and differencing against the page with the nearest URL.

A page is cut into lines, one for each block.  Menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments go by
their elements and class names.  Each page is paired with the page of its host
whose URL path is nearest to its own, their lines are aligned by longest common
subsequence, and shared lines go, since what two pages of a site share is the
site's and not the article's.  In the order of URLs, pages of a host each of
which is a copy or near copy of the one before are a run, however long, and a
run is passed over as one: the pair of its pages is the page before it or the
page after it, whichever is nearer and no copy itself.  Lines inside
an <article> or <main> stay even if shared: articles of one host share paragraphs
that are theirs.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, drop_path, global_order, stage

#: Pages of a block that one task compares in order.
BLOCK = 64
#: Pages that share more than this part of the lines of both are copies, which say nothing about the site.
COPY = 0.9
#: Rows of the alignment that are kept at once (bits); longer ones are halved first.
BITS = 1 << 27

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"""=\s*(["'])|>""")
_ATTR = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_RAW = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio", "video"}
_DROP = {"nav", "aside", "form", "button", "select", "textarea", "fieldset", "dialog", "menu", "head", "title", "datalist", "label", "footer"}
_BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "caption", "section", "article", "main", "header", "footer", "nav", "aside", "form", "fieldset", "blockquote", "pre", "figure", "figcaption", "address", "hr", "body", "html", "details", "summary", "hgroup", "center"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
#: Words of class, id and role that mark what is not main text.
_NOISE = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "adbox", "adslot", "sponsor", "sponsored", "promo", "promotion", "banner",
    "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "share", "sharing",
    "social", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "footer", "comment",
    "comments", "disqus", "replies", "related", "widget", "toolbar", "skip", "hidden", "complementary", "contentinfo", "search", "alert",
}
_CUTS_P = _BLOCKS - {"body", "html"}


class _Tags:
    """The tags of a page from left to right, in linear time."""

    def __init__(self, html: str) -> None:
        self.html, self.plain, self.comment_ends = html, False, True
        self.last = html.rfind(">")

    def _end(self, at: int) -> int:
        """Where the > is that ends the tag: not one in a quoted value.

        From the first tag on whose quotes or itself don't end, any > does.
        """
        first = self.html.find(">", at)
        i = at
        while not self.plain:
            m = _STOP.search(self.html, i)
            if m is None:
                break
            if not m[1]:
                return m.start()
            i = self.html.find(m[1], m.end()) + 1
            if not i:
                break
        self.plain = True
        return first

    def after(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """Start, end, name (empty for comments and declarations), whether it closes, and attributes of the next tag."""
        html = self.html
        while (i := html.find("<", at)) >= 0:
            if html.startswith("<!--", i):
                stop = html.find("-->", i + 4) if self.comment_ends else -1
                self.comment_ends = stop >= 0
                return i, stop + 3 if stop >= 0 else len(html), "", False, ""
            if i > self.last:
                return None
            if html.startswith(("<!", "<?"), i):
                return i, html.find(">", i) + 1, "", False, ""
            m = _NAME.match(html, i + 1)
            if m:
                stop = self._end(m.end())
                return i, stop + 1, m[2].lower(), bool(m[1]), html[m.end() : stop]
            at = i + 1
        return None


def lines_of(html: str) -> list[tuple[str, bool, bool]]:
    """(line, kept by structure, in an article or main) of every block with text, in page order; time is linear in the page."""
    out: list[tuple[str, bool, bool]] = []
    stack: list[tuple[str, bool, bool]] = []
    open_: Counter[str] = Counter()  # names on the stack; "!" counts articles and mains opened where all is skipped
    skip = inside = False
    buf: list[str] = []
    at, n, tags = 0, len(html), _Tags(html)

    def flush() -> None:
        if buf:
            line = " ".join("".join(buf).split())
            buf.clear()
            if line:
                out.append((line, not skip, inside))

    def close(name: str) -> None:
        nonlocal skip, inside
        while open_[name]:
            top, skip, inside = stack.pop()
            open_[top] -= 1
            open_["!"] -= top in ("article", "main") and skip
            if top == name:
                return

    while at < n:
        tag = tags.after(at)
        if tag is None:
            buf.append(htmllib.unescape(html[at:]))
            break
        start, stop, name, end, attrs = tag
        if start > at:
            buf.append(htmllib.unescape(html[at:start]))
        at = stop
        if not name:
            continue
        if end:
            if name in _BLOCKS or name in _DROP:
                flush()
            if name not in _VOID:
                close(name)
            continue
        if name in _RAW:
            if not attrs.rstrip().endswith("/"):
                m = re.compile(f"</{name}(?=[\\s/>])", re.I).search(html, at)
                at = html.find(">", m.end()) + 1 if m else n
                at = at or n
            continue
        if name in _BLOCKS or name in _DROP:
            flush()
            if name in _CUTS_P and any(x[0] == "p" for x in stack[-6:]):
                close("p")
        if name in ("br", "td", "th"):
            buf.append(" ")
        if name in _VOID:
            continue
        stack.append((name, skip, inside))
        open_[name] += 1
        open_["!"] += name in ("article", "main") and skip
        words = set()
        for _, a, b, c in _ATTR.findall(attrs) if "=" in attrs else ():
            words.update(re.split(r"[^a-z0-9]+", (a or b or c).lower()))
        noise = bool(words & _NOISE) or name in _DROP or (name == "header" or "header" in words) and not inside
        if name in ("article", "main") and not words & _NOISE or words & {"main"} and name == "div" and not noise:
            skip, inside = False if name in ("article", "main") and not open_["!"] else skip, True
        elif noise and name not in ("body", "html"):
            skip = True
    flush()
    return out


def shared_lines(a: list[int], b: list[int]) -> set[int]:
    """Places in a of a longest common subsequence of a and b, by rows of bits."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    out = {*range(lo), *range(len(a) - hi, len(a))}
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if x and y:
        out |= {lo + i for i in _align(x, y)}
    return out


def _rows(x: list[int], y: list[int]) -> list[int]:
    """After each line of x: bits of y, 0 where the subsequence grows by one."""
    at: dict[int, int] = {}
    for j, v in enumerate(y):
        at[v] = at.get(v, 0) | 1 << j
    full = (1 << len(y)) - 1
    v, rows = full, []
    for t in x:
        u = v & at.get(t, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    return rows


def _align(x: list[int], y: list[int]) -> list[int]:
    if len(x) * len(y) > BITS and len(x) > 1:  # split x in the middle, y where both halves together are longest
        mid = len(x) // 2
        left = np.cumsum(1 - np.array([int(c) for c in bin(_rows(x[:mid], y)[-1] | 1 << len(y))[:2:-1]]))
        right = np.cumsum(1 - np.array([int(c) for c in bin(_rows(x[:mid - 1 : -1], y[::-1])[-1] | 1 << len(y))[:2:-1]]))
        total = np.r_[0, left] + np.r_[0, right][::-1]
        cut = int(total.argmax())
        return _align(x[:mid], y[:cut]) + [mid + i for i in _align(x[mid:], y[cut:])] if 0 < cut < len(y) else (_align(x[:mid], y) if cut else [mid + i for i in _align(x[mid:], y)])
    rows, out, j = _rows(x, y), [], len(y) - 1
    i = len(x) - 1
    while i >= 0 and j >= 0:
        if rows[i] >> j & 1:
            j -= 1  # y[j] adds nothing to x[:i + 1]
        elif i and not rows[i - 1] >> j & 1:
            i -= 1
        else:
            out.append(i)
            i, j = i - 1, j - 1
    return out[::-1]


def _address(url: str | None) -> tuple[str, str]:
    """Host and path, lower case; a url that can't be read is its own host."""
    try:
        u = urlsplit(url or "")
        return (u.hostname or "").lower(), u.path.rstrip("/")
    except ValueError:
        return url or "", ""


def _closeness(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def copies(a: tuple, b: tuple) -> bool:
    """Whether two pages (key, rank, host, path, hashes, flags) share nearly all their lines."""
    mine, other = set(a[4]), set(b[4])
    return len(mine & other) > COPY * max(len(mine), len(other))


def nearness(cur: tuple, other: tuple) -> tuple[int, int, int]:
    """Greater for nearer pages of a host: the path they share, then places between them, then the earlier one."""
    return _closeness(other[3], cur[3]), -abs(other[1] - cur[1]), -other[1]


def verdict(cur: tuple, other: tuple) -> tuple[bytes, int, list[int]]:
    """key, shared lines, and the lines of cur that go: those shared outside an article or main."""
    got = shared_lines(cur[4], other[4])
    outside = [i for i, f in enumerate(cur[5]) if not f & 2]
    kept = [i for i in outside if cur[5][i] & 1]
    lose = [i for i in outside if i in got]
    if set(kept) <= got and not any(f == 3 for f in cur[5]):
        lose = []  # nothing says which lines are the site's
    return cur[0], len(got), lose


_OUTLINE = "key binary, page_id long, host string, path string, hashes array<long>, flags binary"
_LINES = "key binary, page_id long, url string, flags binary, packed binary"


def _outline(texts: bool):
    """The lines of each page (page_id, url, html): hashes and flags (1: kept by structure, 2: in an article or main), or with texts flags and the packed lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(3)
        kinds = (pa.binary(), pa.binary(), pa.binary()) if texts else (pa.binary(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.binary())
        for b in batches:
            rows = []
            for url, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                lines = lines_of(h or "")
                host, path = _address(url)
                hashes = np.array([xxhash.xxh3_64_intdigest(x) for x, _, _ in lines], np.uint64)
                flags = bytes(k + 2 * i for _, k, i in lines)
                key = xxhash.xxh3_128_digest(host.encode("utf-8", "replace") + b"\0" + hashes.tobytes() + flags)
                rows.append((key, flags, z.compress("\n".join(x for x, _, _ in lines).encode())) if texts else (key, host, path, hashes.view(np.int64).tolist(), flags))
            cols = [pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * len(kinds), kinds, strict=True)]
            given = [b.column(0), b.column(1)] if texts else [b.column(0)]
            yield pa.RecordBatch.from_arrays([cols[0], *given, *cols[1:]], [c.split()[0] for c in (_LINES if texts else _OUTLINE).split(", ")])

    return run


_VERDICT = "key binary, rank long, part long, starts boolean, open boolean, n_shared long, lose array<int>, host string, path string, hashes array<long>, flags binary"
_KINDS = {"binary": pa.binary(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    fields = [c.split() for c in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[t]) for c, (_, t) in zip(list(zip(*rows, strict=True)) or [()] * len(fields), fields, strict=True)], [n for n, _ in fields])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block and rank: for each page of its own block, what goes by the page before or after it.

    starts: it is no copy of the page before.  open: it is a copy of one of the
    two, so its pair lies outside the run.  The lines come along for open pages
    and for those beside a run.
    """
    held: list[tuple] = []  # the rows of a block: BLOCK + 4 at most
    block = None

    def told() -> pa.RecordBatch:
        out = []
        joined = [False] + [x[2] == y[2] and copies(x, y) for x, y in zip(held, held[1:], strict=False)] + [False, False]  # joined[i]: held[i] is a copy of the one before
        for i, cur in enumerate(held):
            if not cur[7]:
                continue
            sides = [x for x in (held[i - 1] if i else None, held[i + 1] if i + 1 < len(held) else None) if x and x[2] == cur[2]]
            starts, open_ = not joined[i], joined[i] or joined[i + 1]
            got = (None, None)
            if sides and not open_ and cur[4]:
                got = verdict(cur, max(sides, key=lambda x: nearness(cur, x)))[1:]
            beside = joined[i + 2] or i and joined[i - 1]
            out.append((cur[0], cur[1], cur[6], starts, open_, *got, *(cur[2:6] if open_ or beside else (None,) * 4)))
        held.clear()
        return _batch(out, _VERDICT)

    for b in batches:
        for blk, own, *row in zip(*(b.column(i).to_pylist() for i in range(9)), strict=True):
            if blk != block:
                yield told()
                block = blk
            held.append((*row, own))
    yield told()


_SIDE = "key binary, near array<long>, n_shared long, lose array<int>"


def _outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a page in a run and a page beside the run: how near, and what goes by it; none for copies and other hosts."""
    for b in batches:
        out = []
        for row in zip(*(b.column(i).to_pylist() for i in range(12)), strict=True):
            cur, other = row[:6], row[6:]
            if cur[2] == other[2] and not copies(cur, other):
                out.append((cur[0], list(nearness(cur, other)), *verdict(cur, other)[1:]))
        yield _batch(out, _SIDE)


def _beside_runs(verdicts: DataFrame) -> DataFrame:
    """key, n_shared, lose of the open pages, by the page before or after their run.

    Runs may go on over any number of parts of the order: what a part takes from
    those around it is a row for each part.
    """
    spark = verdicts.sparkSession
    start = F.when(F.col("starts"), F.col("rank"))
    ends = verdicts.groupBy("part").agg(F.min(start).alias("first"), F.max(start).alias("last")).orderBy("part").collect()  # a row for each part of the order
    firsts = [r["first"] for r in ends]
    carried, before = [], None
    for i, r in enumerate(ends):
        carried.append((r["part"], before, next((x for x in firsts[i + 1 :] if x is not None), None)))
        before = before if r["last"] is None else r["last"]
    carry = F.broadcast(spark.createDataFrame(carried, "part long, _before long, _after long"))
    up = Window.partitionBy("part").orderBy("rank")
    down = Window.partitionBy("part").orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, -1)
    runs = verdicts.select("key", "rank", "part", "open", F.max(start).over(up).alias("_start"), F.min(start).over(down).alias("_next")).filter("open").join(carry, "part")
    wanted = runs.select("key", F.explode(F.array_compact(F.array(F.coalesce("_start", "_before") - 1, F.coalesce("_next", "_after")))).alias("at"))
    lines = verdicts.filter("host IS NOT NULL").select("key", "rank", "host", "path", "hashes", "flags")
    other = lines.select(F.col("rank").alias("at"), *[F.col(c).alias("_" + c) for c in lines.columns])
    # many pages of one run want the same one, of which there is one row: adaptive execution can split them
    sides = lines.join(wanted, "key").join(other, "at").select(*lines.columns, *["_" + c for c in lines.columns])
    found = arrow_map(sides, _outside, _SIDE)
    return found.groupBy("key").agg(F.max_by(F.struct("n_shared", "lose"), "near").alias("x")).select("key", "x.n_shared", "x.lose")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_shared, n_cut for every row of pages (page_id, url, html).

    text: the kept blocks in page order, joined by line feeds, white space
    inside a block as one blank; empty if there are none, for null html too.
    n_shared: lines, in all of the page, that it shares with its pair (0: no
    pair); n_cut: those of them that go by this, outside articles and mains,
    whether or not structure would drop them too.  A null url is a host and path
    of its own.  Pages of a host with the same lines fare alike.  One row out for
    each row in.
    """
    spark = pages.sparkSession
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    alike = arrow_map(p, _outline(texts=False), _OUTLINE).groupBy("key").agg(F.min(F.struct("path", "page_id")).alias("x"), *[F.first(c).alias(c) for c in ("host", "hashes", "flags")])
    order, part = global_order(alike.select("key", "host", "x.path", "hashes", "flags"), ["host", "path", "key"], "page-order")
    counts = order.groupBy(part).count().orderBy(part).collect()  # a row for each partition
    offsets, total = [], 0
    for r in counts:
        offsets.append((r[0], total))
        total += r[1]
    starts = F.broadcast(spark.createDataFrame(offsets, "part long, _off long"))
    ranked = order.withColumn("part", F.col("_part").cast("long")).join(starts, "part").withColumn("rank", F.col("_off") + F.col("_at")).withColumn("blk", F.floor(F.col("rank") / BLOCK))
    at = F.col("rank") % BLOCK
    beside = lambda cond, n: F.when(cond, F.struct((F.col("blk") + n).alias("blk"), F.lit(False).alias("own")))
    blocks = F.array_compact(F.array(F.struct(F.col("blk").alias("blk"), F.lit(True).alias("own")), beside(at < 2, -1), beside(at >= BLOCK - 2, 1)))
    near = ranked.withColumn("b", F.explode(blocks)).select("b.blk", "b.own", "key", "rank", "host", "path", "hashes", "flags", "part")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    verdicts = stage(arrow_map(near.repartition(n, "blk").sortWithinPartitions("blk", "rank"), _compare, _VERDICT), "page-verdicts")
    for path in {f.rsplit("/", 1)[0] for f in order.inputFiles()}:  # nothing reads it any more
        drop_path(spark, path)
    if verdicts.filter("open").head(1):
        verdicts = stage(verdicts.filter("NOT open").select("key", "n_shared", "lose").unionByName(_beside_runs(verdicts)), "page-run-verdicts")
    else:
        verdicts = verdicts.select("key", "n_shared", "lose")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            texts, cut = [], []
            for packed, flags, lose in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(5).to_pylist(), strict=True):
                lost = set(lose or ())
                cut.append(len(lost))
                texts.append("\n".join(x for j, (x, f) in enumerate(zip(z.decompress(packed).decode().split("\n"), flags, strict=False)) if f & 1 and j not in lost))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), b.column(4).fill_null(0), pa.array(cut, pa.int64())], ["page_id", "url", "text", "n_chars", "n_shared", "n_cut"])

    # pages are cut into lines a second time, which costs less than keeping the lines of all pages meanwhile
    lines = arrow_map(p, _outline(texts=True), _LINES)
    return arrow_map(lines.join(verdicts, "key", "left").select("page_id", "url", "packed", "flags", "n_shared", "lose"), write, "page_id long, url string, text string, n_chars long, n_shared long, n_cut long")
