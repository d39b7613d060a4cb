"""Token files: each document's ids are one zstandard frame, checked by itself and found through a seek table.

A file is the documents' frames, in order, then two skippable frames: the document index (a zstandard frame
of the documents' ids) and the seek table of the public seekable format. An entry of the seek table has a
frame's compressed size, its decompressed size and the low 32 bits of the XXH64 of its content. A reader
reads the end of the file, then only the frames of the documents that it wants.

Null texts are empty, null document ids come first, and rows that share a document id stay separate, in
order of their texts' hashes. An empty table gives files without documents. Other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encoding import encoder
from .shared import fresh_path, partitions

#: Fixed values of the public seekable format; the index frame's number is ours.
SKIPPABLE_INDEX, SKIPPABLE_TABLE, SEEKABLE_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
FOOTER, ENTRY = struct.Struct("<IBI"), struct.Struct("<III")
#: Bytes read at once by a reader that takes all documents.
READ_BYTES = 8 << 20

MANIFEST = "file_no int, path string, n_docs long, n_tokens long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids binary"
SUMS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _files(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if urlsplit(uri).scheme else f"file://{uri}")


class Writer:
    """Appends documents to an open binary file; close() adds the index and the seek table."""

    def __init__(self, out, dtype: str, level: int):
        self.out, self.dtype = out, np.dtype(dtype)
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.entries, self.doc_ids, self.n_tokens = [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw = ids.astype(self.dtype).tobytes()
        frame = self.zstd.compress(raw)
        self.out.write(frame)
        self.entries.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.doc_ids.append(doc_id)
        self.n_tokens += len(ids)

    def close(self) -> None:
        nulls = np.array([x is None for x in self.doc_ids], np.uint8)
        index = self.zstd.compress(struct.pack("<B", self.dtype.itemsize) + nulls.tobytes() + np.array([x or 0 for x in self.doc_ids], "<i8").tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        table = np.array(self.entries, "<u4").tobytes() + FOOTER.pack(len(self.entries), 0x80, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_TABLE, len(table)) + table)


class Reader:
    """Random access to a file of tokens; `source` is seekable."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - FOOTER.size)
        n, flags, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != SEEKABLE_MAGIC or not flags & 0x80:
            raise ValueError("not a token file")
        at = size - FOOTER.size - n * ENTRY.size
        source.seek(at)
        table = np.frombuffer(source.read(n * ENTRY.size), "<u4").reshape(n, 3)
        self.sums = table[:, 2]
        self.raw = table[:, 1].astype(np.int64)
        self.ends = np.cumsum(table[:, 0], dtype=np.int64)
        frames = int(self.ends[-1]) if n else 0
        source.seek(frames)
        kind, length = struct.unpack("<II", source.read(8))
        if kind != SKIPPABLE_INDEX:
            raise ValueError("no document index")
        self.zstd = zstandard.ZstdDecompressor()
        index = self.zstd.decompress(source.read(length))
        self.dtype = {2: "<u2", 4: "<u4"}[index[0]]
        null = np.frombuffer(index, np.uint8, n, 1)
        self.doc_ids = [None if z else int(x) for x, z in zip(np.frombuffer(index, "<i8", n, 1 + n), null, strict=True)]
        self.n_tokens = self.raw // np.dtype(self.dtype).itemsize

    def documents(self, wanted: Sequence[int]) -> Iterator[np.ndarray]:
        """The ids of the documents at these places of the file, ascending; neighbours are read together."""
        i = 0
        while i < len(wanted):
            j, start = i + 1, self._start(wanted[i])
            while j < len(wanted) and wanted[j] == wanted[j - 1] + 1 and self.ends[wanted[j]] - start <= READ_BYTES:
                j += 1
            self.source.seek(start)
            block = self.source.read(int(self.ends[wanted[j - 1]]) - start)
            for k in wanted[i:j]:
                raw = self.zstd.decompress(block[self._start(k) - start : int(self.ends[k]) - start], max_output_size=int(self.raw[k]))
                if len(raw) != self.raw[k] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
                    raise ValueError(f"frame {k} is damaged")
                yield np.frombuffer(raw, self.dtype)
            i = j

    def _start(self, k: int) -> int:
        return int(self.ends[k - 1]) if k else 0


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, text: str = "text", key: str = "doc_id", level: int = 1) -> DataFrame:
    """Writes docs' ids, end_id after each, in ascending order of key, a file for each partition; returns the manifest.

    A file is written under a name of its attempt and then renamed, so a task that runs again replaces it whole.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "tokens")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        wide = "<u2" if max(enc.library.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        end = np.array([end_id], "<u4").tobytes()
        no = TaskContext.get().partitionId()
        fs, at = _files(f"{folder}/part-{no:06d}.zst")
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        held = f"{at}.{uuid.uuid4().hex}"
        with fs.open_output_stream(held) as out:
            w = Writer(out, wide, level)
            for batch in batches:
                for k in range(0, batch.num_rows, 512):
                    part = batch.slice(k, 512)
                    for doc_id, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist()), strict=True):
                        w.add(doc_id, np.frombuffer(ids + end, "<u4"))
            w.close()
        fs.move(held, at)
        yield pa.RecordBatch.from_arrays([pa.array([no], pa.int32()), pa.array([f"{folder}/part-{no:06d}.zst"]), pa.array([len(w.entries)], pa.int64()), pa.array([w.n_tokens], pa.int64())], ["file_no", "path", "n_docs", "n_tokens"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    n = partitions(spark)
    bounds = sorted({int(x) for x in docs.select(F.col(key).cast("long").alias("key")).approxQuantile("key", [k / n for k in range(1, n)], 0.1 / n)}) if n > 1 else []
    place = F.expr(f"coalesce(size(filter(array({', '.join(f'{x}L' for x in bounds)}), b -> b <= key)), 0)") if bounds else F.lit(0)
    placed = rows.repartitionById(n, place.cast("int")).sortWithinPartitions("key", F.xxhash64("text"), "text")
    path = fresh_path(spark, "manifest")
    placed.mapInArrow(write, MANIFEST).write.parquet(path)
    return spark.read.schema(MANIFEST).parquet(path)


def read_tokens(manifest: DataFrame, wanted: Sequence[int] | None = None, sums: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit), of all documents or of those wanted.

    With sums, ids_crc32 (the CRC-32 of those ids) stands in place of ids.
    """
    spark = manifest.sparkSession
    only = None if wanted is None else set(wanted)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, at = _files(row["path"])
                with fs.open_input_file(at) as source:
                    r = Reader(source, fs.get_file_info(at).size)
                    starts = row["start"] + np.cumsum(r.n_tokens) - r.n_tokens
                    places = [k for k, x in enumerate(r.doc_ids) if only is None or x in only]
                    found = r.documents(places)
                    for k in range(0, len(places), 256):
                        own = places[k : k + 256]
                        ids = [next(found).astype("<u4").tobytes() for _ in own]
                        last = pa.array(map(zlib.crc32, ids), pa.int64()) if sums else pa.array(ids, pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array([r.doc_ids[x] for x in own], pa.int64()), pa.array(starts[own], pa.int64()), pa.array(r.n_tokens[own], pa.int64()), last], ["doc_id", "start", "n_tokens", "ids_crc32" if sums else "ids"])

    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))  # a row for each file
    return files.repartition(partitions(spark)).mapInArrow(read, SUMS if sums else DOCUMENTS)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every whole document, encoded, written and read back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_tokens(write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), 2), sums=True)
