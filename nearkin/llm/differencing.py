"""Main text of pages by differencing with the page of the nearest URL on the same host.

Of a page's neighbours among the URLs of its host, sorted by path and query, the one with the longer common start is
the nearest, the one before it where both are as near. Their lines of text are aligned by a longest common
subsequence, and lines that both share are deleted. Differencing alone leaves what pages do not share (an advert, a
footer of the page's own) and deletes sentences that two articles share, so containers that name themselves are
judged by their names: lines in articles stay, lines in menus, headers, footers, sidebars, notices, adverts, forms
and comments go. Differencing decides on all other lines of pages without an article, unless that leaves a page with
nothing. A host's only URL is judged by its containers.

Pages are dealt by ranges of host, path and query, so a hot host has many tasks; each task also gets the page before
its first URL and the page after its last one, found beforehand from URLs alone. Of several pages with one URL, the
one with the smallest id is what others are compared with, so a page's text depends on the table only: not on the
order of rows nor on the number of tasks.

Null pages are empty; pages without a host are judged by their containers; repeated rows and pages of one URL are
separate pages with the same neighbour. An empty table gives no rows. Other columns are ignored, whatever their
names. A page is read in proportion to its length, and its lines are compared as bits, within memory in proportion
to them; a task holds the pages of one URL until the next URL comes.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .markup import BOILER, MAIN, PLAIN, lines
from .shared import partitions

RESULT = "page_id long, url string, text string, n_chars long, n_shared long"
#: Bits of the rows that one alignment keeps; more lines are aligned half by half.
KEPT_BITS = 1 << 27


def _rows(a: list[str], b: list[str]) -> Iterator[int]:
    """After each line of a, a number whose bit j is 0 where the common subsequence grows with b's line j."""
    places: dict[str, int] = {}
    for j, line in enumerate(b):
        places[line] = places.get(line, 0) | 1 << j
    every = (1 << len(b)) - 1
    v = every
    for line in a:
        met = v & places.get(line, 0)
        v = (v + met | v - met) & every
        yield v


def _lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of a and each beginning of b."""
    v = (1 << len(b)) - 1
    for v in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def _aligned(a: list[str], b: list[str], first: int, out: set[int]) -> None:
    """Adds to out the places of a, counted from first, of a longest common subsequence."""
    if not a or not b:
        return
    if len(a) * len(b) <= KEPT_BITS or len(a) == 1:
        rows = list(_rows(a, b))
        i, j = len(a), len(b)
        while i and j:
            if rows[i - 1] >> j - 1 & 1:
                j -= 1
                continue
            i -= 1
            if not i or rows[i - 1] >> j - 1 & 1:
                out.add(first + i)
                j -= 1
        return
    half = len(a) // 2
    forth, back = _lengths(a[:half], b), _lengths(a[half:][::-1], b[::-1])
    cut = int(np.argmax(forth + back[::-1]))
    _aligned(a[:half], b[:cut], first, out)
    _aligned(a[half:], b[cut:], first + half, out)


def shared(a: list[str], b: list[str]) -> set[int]:
    """Places in a of a longest common subsequence of a and b."""
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    found = set(range(first)) | set(range(len(a) - last, len(a)))
    a, b = a[first : len(a) - last], b[first : len(b) - last]
    both = set(a) & set(b)  # other lines are in no common subsequence
    places = [k for k, x in enumerate(a) if x in both]
    inner: set[int] = set()
    _aligned([a[k] for k in places], [x for x in b if x in both], 0, inner)
    return found | {first + places[k] for k in inner}


def main_text(own: list[tuple[str, int]], near: list[tuple[str, int]] | None) -> tuple[str, int]:
    """The text of a page's lines that stay, and how many lines differencing deleted."""
    gone: set[int] = set()
    articles = any(kind == MAIN for _, kind in own)
    if near is not None and not articles:
        gone = {k for k in shared([t for t, _ in own], [t for t, _ in near]) if own[k][1] == PLAIN}
    kept = [t for k, (t, kind) in enumerate(own) if kind == MAIN or kind == PLAIN and not articles and k not in gone]
    if not kept and not articles:
        kept, gone = [t for t, kind in own if kind != BOILER], set()
    return " ".join(kept), len(gone)


#: What pages are sorted by: a page's URL, then what tells pages of one URL apart.
PLACE = ["host", "path", "page_id", "mark"]


def _key(row: tuple) -> tuple:
    """A place that sorts as Spark sorts it: nulls first."""
    return (row[0].encode(), row[1].encode(), row[2] is not None, row[2] or 0, row[3])


def _ranges(rows: DataFrame, n: int) -> tuple[list[tuple], dict[tuple, list[int]]]:
    """First places of the tasks but the first, and the pages that other tasks compare with, with the numbers of these tasks."""

    def ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts: list[tuple] = []  # of the task's first two URLs, and of its last two, the first place
        lasts: list[tuple] = []
        for batch in batches:
            for now in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not lasts or lasts[-1][:2] != now[:2]:
                    lasts = [*lasts[-1:], now]
                    firsts = [*firsts, now][:2]
        task = TaskContext.get().partitionId()
        found = list(dict.fromkeys([*firsts, *lasts]))
        yield pa.RecordBatch.from_arrays([pa.array([task] * len(found), pa.int32()), *(pa.array([x[c] for x in found], t) for c, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64())))], ["task", *PLACE])

    dealt = rows.select(*PLACE).repartitionByRange(n, *PLACE).sortWithinPartitions(*PLACE)
    found = sorted(((r["task"], *(r[c] for c in PLACE)) for r in dealt.mapInArrow(ends, "task int, host string, path string, page_id long, mark long").collect()), key=lambda r: _key(r[1:]))  # four a task
    heads: dict[tuple, tuple] = {}  # of each URL here, its first place
    tasks: dict[int, list[tuple]] = {}
    for task, *place in found:
        heads.setdefault(tuple(place[:2]), tuple(place))
        tasks.setdefault(task, []).append(tuple(place))
    urls = list(heads)
    number = {u: k for k, u in enumerate(urls)}
    bounds, wanted = [], {}
    for own in (tasks[t] for t in sorted(tasks)):
        task = len(bounds)
        bounds.append(_key(own[0]))
        first, last = number[own[0][:2]], number[own[-1][:2]]
        for k in {first - 1, first, last + 1} & set(range(len(urls))):
            if urls[k][0] in (own[0][0], own[-1][0]):
                wanted.setdefault(_key(heads[urls[k]]), []).append(task)
    return bounds[1:], wanted


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars and n_shared of each page."""
    n = partitions(pages.sparkSession)
    start = r"^[a-zA-Z][a-zA-Z0-9+.-]*://"
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), rf"{start}([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(F.col(url), rf"{start}[^/?#]*([^#]*)", 1), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), host.alias("host"), path.alias("path"), F.xxhash64(url, page).alias("mark"), F.col(page).alias("html"))
    bounds, wanted = _ranges(rows, n)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = [_key(x) for x in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in PLACE), strict=True)]
            tasks = [bisect_right(bounds, x) for x in places]
            more = [(k, t) for k, x in enumerate(places) for t in wanted.get(x, ()) if t != tasks[k]]
            at = pa.array([*range(b.num_rows), *(k for k, _ in more)], pa.int64())
            own = pa.array([True] * b.num_rows + [False] * len(more))
            yield pa.RecordBatch.from_arrays([pa.array([*tasks, *(t for _, t in more)], pa.int32()), own, *(c.take(at) for c in b.columns)], ["task", "own", *b.schema.names])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: list[tuple] = []  # pages of the URL that is read
        now = head = before = None  # that URL, its first page and the lines of it, and (URL, lines) of the one before it

        def judge(after: tuple | None) -> None:
            sides = [x for x in (before, after) if x and x[0][0] == now[0] != ""]
            near = max(sides, key=lambda x: len(commonprefix([x[0][1], now[1]])), default=(None, None))[1]
            seen: dict[str | None, tuple[str, int]] = {}
            for page_id, link, body in held:
                if body not in seen:
                    seen[body] = main_text(head[1] if body == head[0] else lines(body), near)
                text, gone = seen[body]
                out.append((page_id, link, text, len(text), gone))
            held.clear()

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()))], ["page_id", "url", "text", "n_chars", "n_shared"])
            out.clear()
            return made

        for b in batches:
            for k in range(b.num_rows):
                own, page_id, link, place, body = b.column(0)[k].as_py(), b.column(1)[k].as_py(), b.column(2)[k].as_py(), (b.column(3)[k].as_py(), b.column(4)[k].as_py()), b.column(5)[k].as_py()
                if place != now:
                    own_lines = lines(body)
                    if now is not None:
                        judge((place, own_lines))
                        before = (now, head[1])
                    now, head = place, (body, own_lines)
                if own:
                    held.append((page_id, link, body))
                if now[0] == "":
                    judge(None)
                if len(out) >= 500:
                    yield batch_of()
        if now is not None:
            judge(None)
        yield batch_of()

    schema = "task int, own boolean, page_id long, url string, host string, path string, mark long, html string"
    dealt = rows.mapInArrow(deal, schema).repartitionById(n, F.col("task")).sortWithinPartitions(*PLACE, F.desc("own"))
    return dealt.select("own", "page_id", "url", "host", "path", "html").mapInArrow(run, RESULT)


def op4_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the main text of all pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
