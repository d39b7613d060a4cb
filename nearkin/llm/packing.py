"""Packing of documents into training sequences by non-negative least squares over length combinations.

Each task packs its own documents, in chunks of a bounded number of tokens. Of each document, whole windows
are sequences of their own. The lengths that remain are counted in classes; shallow combinations of classes
that fill a window are enumerated, and non-negative least squares against the histogram gives how often to
repeat each. The counts are rounded down and filled with real remainders. What is left over is packed
greedily: it is cut to fill the gaps of those sequences, then into whole windows, and the last few tokens
into sequences whose lengths are powers of two. So no sequence needs padding: each has `window` tokens or a
power of two. No rows are shuffled.

Null texts are empty documents, of the end id alone. Rows that share a document id, or have none, are packed
each by itself. Empty tables give no pieces. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoding import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Length classes of a window, remainders in a combination, and tokens packed at once.
CLASSES, DEPTH, CHUNK_TOKENS = 32, 4, 4 << 20


@lru_cache
def combinations(total: int = CLASSES, depth: int = DEPTH) -> np.ndarray:
    """All combinations of at most `depth` classes whose lengths sum to `total`: a row for each, a column for each class."""

    def parts(left: int, most: int, slots: int) -> Iterator[list[int]]:
        if left == 0:
            yield []
        elif slots:
            for k in range(min(left, most), 0, -1):
                if k * slots >= left:
                    for rest in parts(left - k, k, slots - 1):
                        yield [k, *rest]

    return np.array([np.bincount(p, minlength=total + 1)[1:] for p in parts(total, total, depth)], np.int64)


def nnls(a: np.ndarray, b: np.ndarray, most: int = 400) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method of Lawson and Hanson."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(most):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        if gain.max(initial=-np.inf) <= 1e-9 * max(1.0, np.abs(b).max(initial=0)):
            break
        active[int(gain.argmax())] = True
        for _ in range(most):
            s = np.zeros_like(x)
            s[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if s[active].min(initial=1.0) > 0:
                break
            worse = active & (s <= 0)
            step = (x[worse] / np.maximum(x[worse] - s[worse], 1e-300)).min()
            x += step * (s - x)
            active &= x > 1e-12
            x[~active] = 0
        x = s
    return x


def pack(lengths: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Pieces of documents of these lengths: document, start, length, sequence, offset. Each token lies in one piece."""
    n = np.asarray(lengths, np.int64)
    whole, rest = n // window, n % window
    docs = np.repeat(np.arange(len(n)), whole)
    nth = np.arange(len(docs)) - np.repeat(np.cumsum(whole) - whole, whole)
    out = [(docs, nth * window, np.full(len(docs), window), np.arange(len(docs)), np.zeros(len(docs), np.int64))]
    taken = len(docs)

    items = np.flatnonzero(rest)
    items = items[np.lexsort((items, -rest[items]))]
    classes = -(-rest[items] * CLASSES // window)
    counts = np.bincount(classes, minlength=CLASSES + 1)[1:]
    combos = combinations()
    usable = combos[(counts[np.newaxis] >= combos).all(1)]
    repeats = np.floor(nnls(usable.T.astype(float), counts.astype(float)) + 1e-6).astype(np.int64)
    queues = [items[classes == c + 1] for c in range(CLASSES)]
    used = np.zeros(CLASSES, np.int64)
    rows: list[np.ndarray] = []
    for combo, times in sorted(zip(usable.tolist(), repeats.tolist(), strict=True), key=lambda x: -x[1]):
        combo = np.array(combo)
        parts = np.flatnonzero(combo)
        times = min(times, *((counts[parts] - used[parts]) // combo[parts]).tolist())
        if times <= 0:
            continue
        own = np.full((times, DEPTH), -1)
        slot = 0
        for c in parts[::-1]:
            for _ in range(combo[c]):
                own[:, slot] = queues[c][used[c] : used[c] + times]
                used[c] += times
                slot += 1
        rows.append(own)
    made = np.concatenate(rows) if rows else np.zeros((0, DEPTH), np.int64)
    left = np.concatenate([queues[c][used[c] :] for c in range(CLASSES - 1, -1, -1)]) if len(items) else items

    # sequences are given up, from the last, until what is left over fills the gaps of the others
    size = np.where(made >= 0, rest[made], 0)
    gaps = window - size.sum(1)
    spare = rest[left].sum() + size.sum() - np.concatenate([[0], np.cumsum(size.sum(1))])
    kept = int(np.flatnonzero(np.concatenate([[0], np.cumsum(gaps)]) <= spare)[-1])
    given = made[kept:].ravel()
    left = np.concatenate([left, given[given >= 0]])
    made, size, gaps = made[:kept], size[:kept], gaps[:kept]
    at = np.cumsum(size, axis=1) - size
    real = made >= 0
    out.append((made[real], whole[made[real]] * window, size[real], taken + np.repeat(np.arange(kept), real.sum(1)), at[real]))

    # the rest is one stream, cut where a gap, a window or a power of two ends
    total = int(rest[left].sum())
    tail = total - int(gaps.sum())
    sinks = [*gaps.tolist(), *[window] * (tail // window), *(1 << k for k in range(window.bit_length(), -1, -1) if tail % window >> k & 1)]
    first = [*(window - gaps).tolist(), *[0] * (len(sinks) - kept)]
    sink_ends, item_ends = np.cumsum(np.array(sinks, np.int64)), np.cumsum(rest[left])
    ends = np.union1d(sink_ends, item_ends)
    ends = ends[ends > 0]
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    sink, item = np.searchsorted(sink_ends, begins, "right"), np.searchsorted(item_ends, begins, "right")
    doc = left[item]
    out.append((doc, whole[doc] * window + begins - (item_ends - rest[left])[item], ends - begins, taken + sink, np.array(first, np.int64)[sink] + begins - (sink_ends - np.array(sinks, np.int64))[sink]))
    return tuple(np.concatenate([np.asarray(x[k], np.int64) for x in out]) for k in range(5))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, window: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each piece: its document, where it starts there, its length and checksum, its sequence and its place there."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        next_id = TaskContext.get().partitionId() << 40
        keys: list[int | None] = []
        ids: list[bytes] = []
        held = 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal next_id, held
            lengths = np.array([len(x) // 4 for x in ids], np.int64)
            doc, start, length, seq, at = pack(lengths, window)
            order = np.lexsort((at, seq))
            for k in range(0, len(order), 20_000):
                o = order[k : k + 20_000]
                sums = [zlib.crc32(memoryview(ids[d])[4 * s : 4 * (s + n)]) for d, s, n in zip(doc[o].tolist(), start[o].tolist(), length[o].tolist(), strict=True)]
                columns = [pa.array([keys[d] for d in doc[o].tolist()], pa.int64()), *(pa.array(x, pa.int64()) for x in (start[o], length[o], sums, lengths[doc[o]], seq[o] + next_id, at[o]))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            next_id += int(seq.max(initial=-1)) + 1
            keys.clear()
            ids.clear()
            held = 0

        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                made = enc.encode(part.column(1).to_pylist())
                keys.extend(part.column(0).to_pylist())
                ids.extend(x + end for x in made)
                held += sum(map(len, made)) // 4 + len(made)
                if held >= CHUNK_TOKENS:
                    yield from packed()
        if ids:
            yield from packed()

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, PIECES)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all documents, packed into sequences of at most 2048 tokens."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 1)
