"""Removal of word windows that an earlier document has, by compaction of a De Bruijn graph.

The windows of k words are edges. Documents lie in slabs, rows of a table that is bucketed by slab, so all
joins below bring answers to the slabs and never move text.

1. Every window has a minimizer, the least hash of the shorter runs in it; equal windows have equal ones. Each
   slab asks once for each distinct minimizer whether other documents have it. Windows of unique minimizers
   are unique and drop out.
2. For the windows left, each slab asks, once for each distinct edge, whether other documents have it and
   whether all its occurrences have the same word before and the same word after.
3. Edges that several documents have are compacted: an edge and the next become one path unless the node
   between them branches. All occurrences of a path lie in the same documents. A path is known by its length
   and a 128-bit BLAKE2 digest of its words, so a hash that two edges happen to share splits paths and joins none.
4. Spark joins the slabs' distinct paths with the source of each: the least document id that has it, and the slab
   and place of an occurrence there. The source's slab sends the words at that place, once to every slab that asks,
   and an occurrence in a later document is removed only if its words are the same.

Distinct edges and paths are summed within a slab before they are shuffled, so a passage that a third of all
documents share costs a row for each slab. A bucket of questions has a bounded share of the text, and slabs grow with the
number of buckets. A document is never cut, so a very long one is a slab of its own.

Null and empty texts have no words; rows without a document id lose nothing and are no source; rows that share a
document id, repeated rows among them, are the same document to each other. An empty table gives no rows. Columns
other than text and the id pass through unchanged, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop_at_end, fresh_path, partitions, steps, stored, utf8
from .words import BASES, Words, own_words, prefix, runs

#: Bytes of text in a slab, at least, and for each bucket of a question; and of all texts for each bucket, at most.
SLAB_BYTES, BUCKET_BYTES, BUCKET_TEXT = 1 << 20, 4096, 32 << 20
#: Of an edge's occurrences: in several documents; several words before; several words after.
SHARED, FORKED_IN, FORKED_OUT = 1, 2, 4
EDGE = np.dtype([("hash", "<u8"), ("before", "<u8"), ("after", "<u8"), ("flags", "u1")])


def _slabs(docs: DataFrame, text: str, key: str, slab_bytes: int) -> DataFrame:
    """slab and its documents as an Arrow stream, in a table bucketed by slab."""
    spark = docs.sparkSession

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_words()
        made = TaskContext.get().partitionId() << 32
        for batch in batches:
            _, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
            for i, j in steps(offsets, slab_bytes):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_batch(pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(i, j - i)]) for c in batch.columns], schema=batch.schema))
                yield pa.RecordBatch.from_arrays([pa.array([made], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["slab", "docs"])
                made += 1

    path = fresh_path(spark, "slabs")
    name = f"nearkin_slabs_{path.rpartition('-')[2]}"
    made = docs.mapInArrow(run, "slab long, docs binary")
    made.write.format("parquet").option("path", path).option("compression", "none").bucketBy(partitions(spark), "slab").saveAsTable(name)
    drop_at_end(name)
    return spark.table(name)


class _Slab:
    """A slab's documents, words and windows."""

    def __init__(self, docs: bytes, text: str, key: str, k: int):
        self.batch = next(iter(pa.ipc.open_stream(docs)))
        self.ids = self.batch.column(self.batch.schema.get_field_index(key))
        self.words = Words(*utf8(self.batch.column(self.batch.schema.get_field_index(text))))
        self.doc, self.k = self.words.doc(), k
        self.rank = np.unique(self.ids.fill_null(0).to_numpy(zero_copy_only=False), return_inverse=True)[1] if len(self.ids) else np.zeros(0, np.int64)
        n = max(0, len(self.words) - k + 1)
        self.real = self.doc[: n] == self.doc[k - 1 :] if n else np.zeros(0, bool)
        if self.ids.null_count:  # rows without an id take no part
            self.real &= ~np.asarray(self.ids.is_null())[self.doc[:n]]

    def hash(self) -> np.ndarray:
        self.word = self.words.hashes()
        self.sums = prefix(self.word, BASES[0])
        return self.word

    def grams(self, size: int) -> np.ndarray:
        at = np.arange(len(self.words) - size + 1)
        return runs(self.sums, at, at + size, BASES[0])

    def minimizers(self) -> np.ndarray:
        """Each window's minimizer; windows that are not real have any."""
        size = (self.k + 3) // 2
        if not len(self.real):
            return np.zeros(0, np.uint64)
        grams = self.grams(size)
        least = grams[: len(self.real)].copy()
        for s in range(1, self.k - size + 1):
            np.minimum(least, grams[s : s + len(least)], out=least)
        return least


def _several(order: np.ndarray, firsts: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each group of sorted rows, the least value, and whether there are several."""
    v = values[order]
    if not len(v):
        return v, np.zeros(0, bool)
    least = np.minimum.reduceat(v, firsts)
    return least, least != np.maximum.reduceat(v, firsts)


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort order, the groups' first places in it, and each row's group."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    group = np.empty(len(v), np.int64)
    group[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), group


def _deal(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets that distinct hashes go to: an order by bucket, the buckets, and where each begins and ends."""
    bucket = (hashes >> np.uint64(40)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    names, firsts = np.unique(bucket[order], return_index=True)
    return order, names.astype(np.int64), np.append(firsts, len(hashes))


def _ask(slab: int, order: np.ndarray, names: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket with the slab's entries for it; rows: an entry's bytes in each."""
    rows = rows[order]
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(np.full(len(names), slab), pa.int64()), pa.array([rows[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], ["bucket", "slab", "entries"])


def _told(order: np.ndarray, names: np.ndarray, answers: list[dict] | None) -> np.ndarray:
    """A byte for each entry, in the order of the hashes that were asked for."""
    by = {x["bucket"]: x["entries"] for x in answers or ()}
    out = np.empty(len(order), np.uint8)
    out[order] = np.frombuffer(b"".join(by[n] for n in names.tolist()), np.uint8)
    return out


def _answered(asked: DataFrame, answer: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """slab and answers, from a function that gets all slabs' entries of a bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slabs: list[int] = []
        entries: list[bytes] = []
        now = None

        def done() -> Iterator[pa.RecordBatch]:
            if slabs:
                yield pa.RecordBatch.from_arrays([pa.array(slabs, pa.int64()), pa.array([now] * len(slabs), pa.int64()), pa.array(answer(entries), pa.binary())], ["slab", "bucket", "entries"])
            slabs.clear()
            entries.clear()

        for batch in batches:
            for bucket, slab, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    yield from done()
                    now = bucket
                slabs.append(slab)
                entries.append(x)
        yield from done()

    dealt = asked.repartition(partitions(asked.sparkSession), "bucket").sortWithinPartitions("bucket", "slab")
    told = dealt.mapInArrow(run, "slab long, bucket long, entries binary")
    return stored(told.groupBy("slab").agg(F.collect_list(F.struct("bucket", "entries")).alias("answers")), "answers")


def _split(values: np.ndarray, parts: list[bytes], width: int) -> list[bytes]:
    ends = np.cumsum([len(x) // width for x in parts])
    return [x.tobytes() for x in np.split(values, ends[:-1])]


def _shared_minimizers(parts: list[bytes]) -> list[bytes]:
    raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :6] = raw
    v = wide.view("<u8").ravel()
    order, firsts, group = _groups(v >> np.uint64(1))
    several = np.diff(np.append(firsts, len(v))) > 1
    flagged = np.maximum.reduceat((v & np.uint64(1))[order], firsts) > 0
    return _split((several | flagged)[group].astype(np.uint8), parts, 6)


def _edge_flags(parts: list[bytes]) -> list[bytes]:
    e = np.frombuffer(b"".join(parts), EDGE)
    order, firsts, group = _groups(e["hash"])
    flags = np.bitwise_or.reduceat(e["flags"][order], firsts)
    flags |= np.where(np.diff(np.append(firsts, len(e))) > 1, SHARED, 0).astype(np.uint8)
    for name, bit in (("before", FORKED_IN), ("after", FORKED_OUT)):
        flags |= np.where(_several(order, firsts, e[name])[1], bit, 0).astype(np.uint8)
    return _split(flags[group], parts, EDGE.itemsize)


class _Questions:
    """What a slab asks, and what it makes of the answers; both questions are put again the same way when answers come."""

    def __init__(self, slab: _Slab, buckets: int):
        self.s, self.buckets = slab, buckets
        slab.hash()

    def first(self) -> tuple:
        least = self.s.minimizers()
        at = np.flatnonzero(self.s.real)
        order, firsts, self.group = _groups(least[at])
        hashes = least[at][order][firsts]
        own = self.s.rank[self.s.doc[at]]
        several = _several(order, firsts, own)[1]
        entries = (hashes & np.uint64((1 << 47) - 1)) << np.uint64(1) | several.astype(np.uint64)
        self.at = at
        return *_deal(hashes, self.buckets), entries.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]

    def second(self, answers: list[dict] | None) -> tuple:
        order, names, *_ = self.first()
        shared = _told(order, names, answers) > 0
        at = self.at[shared[self.group]] if len(self.at) else self.at
        s, k = self.s, self.s.k
        before, after = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        check = s.word | np.uint64(1)
        inner = (at > 0) & (s.doc[np.maximum(at - 1, 0)] == s.doc[at]) if len(at) else np.zeros(0, bool)
        before[inner] = check[at[inner] - 1]
        last = np.minimum(at + k, len(s.doc) - 1)
        inner = (at + k < len(s.doc)) & (s.doc[last] == s.doc[at]) if len(at) else np.zeros(0, bool)
        after[inner] = check[at[inner] + k]
        h = runs(s.sums, at, at + k, BASES[0])
        order, firsts, self.group = _groups(h)
        rows = np.zeros(len(firsts), EDGE)
        rows["hash"] = h[order][firsts]
        flags = np.where(_several(order, firsts, s.rank[s.doc[at]])[1], SHARED, 0)
        for name, values, bit in (("before", before, FORKED_IN), ("after", after, FORKED_OUT)):
            rows[name], several = _several(order, firsts, values)
            flags |= np.where(several, bit, 0)
        rows["flags"] = flags
        self.at = at
        return *_deal(rows["hash"], self.buckets), rows.view(np.uint8).reshape(-1, EDGE.itemsize)

    def paths(self, first: list[dict] | None, second: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and lengths, in windows, of the nonbranching paths of shared edges."""
        order, names, *_ = self.second(first)
        flags = _told(order, names, second)[self.group] if len(self.at) else np.zeros(0, np.uint8)
        keep = flags & SHARED > 0
        at, flags = self.at[keep], flags[keep]
        joined = np.zeros(len(at), bool)
        joined[1:] = (at[1:] == at[:-1] + 1) & (self.s.doc[at[1:]] == self.s.doc[at[:-1]]) & (flags[1:] & FORKED_IN == 0) & (flags[:-1] & FORKED_OUT == 0)
        firsts = np.flatnonzero(~joined)
        return at[firsts], np.diff(np.append(firsts, len(at)))


PATHS = "slab long, places binary, paths array<struct<n:int,hash:long,check:long,least:long,most:long,at:int>>"
TOLD = "slab long, at int, n int, words binary"


def _paths(slabs: DataFrame, text: str, key: str, k: int, buckets: int) -> DataFrame:
    """Of each slab, the places of its paths, and its distinct paths with the least and greatest document ids that have them and a place in the least."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, _Questions, list]]:
        own_words()
        for batch in batches:
            for i in range(batch.num_rows):
                slab, docs, *answers = (c[i] for c in batch.columns)
                yield slab.as_py(), _Questions(_Slab(docs.as_buffer(), text, key, k), buckets), [x.as_py() for x in answers]

    def ask_first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab, q, _ in each(batches):
            yield _ask(slab, *q.first())

    def ask_second(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab, q, (first,) in each(batches):
            yield _ask(slab, *q.second(first))

    def compact(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab, q, (first, second) in each(batches):
            at, n = q.paths(first, second)
            s = q.s
            digests = b"".join(hashlib.blake2b(s.words.run(a, b), digest_size=16).digest() for a, b in zip(at.tolist(), (at + n + k - 1).tolist(), strict=True))
            hashes, check = np.frombuffer(digests, "<u8").reshape(-1, 2).T
            distinct = np.array([n.astype(np.uint64), hashes, check]).T.copy().view("V24").ravel()
            order, firsts, group = _groups_of(distinct)
            own = np.asarray(s.ids.fill_null(0))[s.doc[at]] if len(at) else np.zeros(0, np.int64)
            most = -_several(order, firsts, -own)[0]
            one = np.lexsort((at, own, group))[firsts] if len(at) else order  # of each path, the first place in its least document
            columns = ((n[one], pa.int32()), (hashes[one].view(np.int64), pa.int64()), (check[one].view(np.int64), pa.int64()), (own[one], pa.int64()), (most, pa.int64()), (at[one], pa.int32()))
            struct = pa.StructArray.from_arrays([pa.array(x, t) for x, t in columns], ["n", "hash", "check", "least", "most", "at"])
            places = np.array([at, n, group], "<i4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([slab], pa.int64()), pa.array([places], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(struct)], pa.int32()), struct)], ["slab", "places", "paths"])

    question = "bucket long, slab long, entries binary"
    first = _answered(slabs.mapInArrow(ask_first, question), _shared_minimizers).withColumnRenamed("answers", "first")
    met = slabs.join(first, "slab", "left")
    second = _answered(met.mapInArrow(ask_second, question), _edge_flags).withColumnRenamed("answers", "second")
    return stored(met.join(second, "slab", "left").mapInArrow(compact, PATHS), "paths")


def _groups_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    _, firsts, group = np.unique(values, return_index=True, return_inverse=True)
    order = np.argsort(group, kind="stable")
    return order, np.searchsorted(group[order], np.arange(len(firsts))), group


def _sources(slabs: DataFrame, asked: DataFrame, text: str, key: str, k: int) -> DataFrame:
    """The words of the spans that are asked for (slab, at, n): each span once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_words()
        for batch in batches:
            for i in range(batch.num_rows):
                slab, docs, spans = (c[i] for c in batch.columns)
                s = _Slab(docs.as_buffer(), text, key, k)
                at, n = (np.array([x[c] for x in spans.as_py()], np.int64) for c in ("at", "n"))
                words = [s.words.run(a, b) for a, b in zip(at.tolist(), (at + n + k - 1).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([slab.as_py()] * len(at), pa.int64()), pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(words, pa.binary())], ["slab", "at", "n", "words"])

    spans = asked.distinct().groupBy("slab").agg(F.collect_list(F.struct("at", "n")).alias("spans"))  # of a slab's own paths
    return slabs.join(spans, "slab").select("slab", "docs", "spans").mapInArrow(run, TOLD)


def _removed(docs: DataFrame, window: int, text: str, key: str) -> DataFrame:
    """Slabs with the places of their paths and, of each path with an earlier document, that document's id and its words there."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(2 * partitions(spark), size // BUCKET_TEXT)
    slabs = _slabs(docs, text, key, max(SLAB_BYTES, BUCKET_BYTES * buckets // 2))
    paths = _paths(slabs, text, key, window, buckets)
    each = paths.select("slab", F.posexplode("paths").alias("path", "p")).select("slab", "path", "p.*")
    source = each.groupBy("n", "hash", "check").agg(F.min(F.struct("least", "slab", "at")).alias("source"))
    earlier = each.select("slab", "path", "n", "hash", "check", "most").join(source, ["n", "hash", "check"]).filter(F.col("source.least") < F.col("most"))
    earlier = stored(earlier.select("slab", "path", "n", F.col("source.least").alias("source"), F.col("source.slab").alias("from"), F.col("source.at").alias("at")), "earlier")
    words = _sources(slabs, earlier.select(F.col("from").alias("slab"), "at", "n"), text, key, window).withColumnRenamed("slab", "from")
    told = earlier.join(words, ["from", "at", "n"]).groupBy("slab").agg(F.collect_list(F.struct("path", "source", "words")).alias("sources"))
    return slabs.join(paths.select("slab", "places"), "slab").join(told, "slab", "left").select("slab", "docs", "places", "sources")


def _words_gone(row: dict, s: _Slab) -> np.ndarray:
    """Which words of a slab are covered by windows that an earlier document has."""
    at, n, path = np.frombuffer(row["places"], "<i4").reshape(3, -1).astype(np.int64)
    edge = np.zeros(len(s.words) + 1, np.int64)
    if row["sources"]:
        sources = np.full(int(path.max()) + 1, np.iinfo(np.int64).max)
        sources[[x["path"] for x in row["sources"]]] = [x["source"] for x in row["sources"]]
        words = {x["path"]: x["words"] for x in row["sources"]}
        later = np.flatnonzero(sources[path] < np.asarray(s.ids.fill_null(0))[s.doc[at]])
        same = [s.words.run(a, b) == words[p] for a, b, p in zip(at[later].tolist(), (at + n + s.k - 1)[later].tolist(), path[later].tolist(), strict=True)]
        gone = later[np.array(same, bool)]
        np.add.at(edge, at[gone], 1)
        np.add.at(edge, at[gone] + n[gone] + s.k - 1, -1)
    return np.cumsum(edge)[:-1] > 0


def digest_substrings(docs: DataFrame, window: int = 13, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each document: doc_id, n_words, n_removed and the SHA-256 of the kept words, joined by one space."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                s = _Slab(row["docs"], text, key, window)
                gone = _words_gone(row, s)
                data, offsets, firsts = s.words.data.tobytes(), s.words.offsets.tolist(), s.words.firsts.tolist()
                before = np.concatenate([[0], np.cumsum(gone)])
                n_gone = np.diff(before[firsts])
                sums = []
                for d, n in enumerate(n_gone.tolist()):
                    words = data[offsets[d] : offsets[d + 1]].split()
                    if n:
                        words = [w for w, g in zip(words, gone[firsts[d] : firsts[d + 1]].tolist(), strict=True) if not g]
                    sums.append(hashlib.sha256(b" ".join(words)).hexdigest())
                yield pa.RecordBatch.from_arrays([s.ids.cast(pa.int64()), pa.array(s.words.counts, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(sums)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = docs.select(F.col(key).cast("long").alias(key), text)
    return _removed(rows, window, text, key).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_substrings(docs: DataFrame, window: int = 13, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with the words gone that are covered by windows of earlier documents, each with the white space after it."""
    schema = docs.schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                s = _Slab(row["docs"], text, key, window)
                gone = _words_gone(row, s)
                keep = np.ones(len(s.words.data) + 1, np.int64)
                if gone.any():
                    # a word reaches to the next one of its document
                    reach = np.append(s.words.starts[1:], len(s.words.data)) if len(s.words) else s.words.starts
                    reach = np.minimum(reach, s.words.offsets[1:][s.doc])
                    edge = np.zeros(len(s.words.data) + 1, np.int64)
                    np.add.at(edge, s.words.starts[gone], 1)
                    np.add.at(edge, reach[gone], -1)
                    keep = np.cumsum(edge) == 0
                at = np.concatenate([[0], np.cumsum(keep[:-1].astype(np.int64))])[s.words.offsets]
                body = s.words.data[keep[:-1].astype(bool)].tobytes()
                texts = pa.array([body[a:b].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string())
                i = s.batch.schema.get_field_index(text)
                texts = pa.compute.if_else(s.batch.column(i).is_null(), pa.scalar(None, pa.string()), texts)
                columns = [texts if c == i else x for c, x in enumerate(s.batch.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=s.batch.schema.names)

    return _removed(docs, window, text, key).mapInArrow(run, schema)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: windows of 13 words over all documents."""
    return digest_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
di AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS g FROM di),
m AS (SELECT g, min(doc_id) AS first_id FROM win GROUP BY g),
spot AS (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM (SELECT win.doc_id, i FROM win JOIN m ON win.g = m.g WHERE first_id < win.doc_id) q),
gone AS (SELECT DISTINCT doc_id, p FROM spot),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d WHERE len(w) > 0),
kept AS (SELECT word.doc_id, string_agg(word, ' ' ORDER BY word.p) AS t FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p WHERE gone.p IS NULL GROUP BY word.doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""
