"""Toxicity scores: nearest labelled examples by exact TF-IDF cosine, found through a block-max inverted index.

Terms are all lower-cased words of at most EXAMPLES labelled documents (least hashed ids first), and one term that
every text has; none is selected. A term's weight in a text is (1 + log times) * idf * rf ** RELEVANCE, where rf, the
relevance factor log2(2 + examples with the label / examples without), is about 1 for most words and large for words
that go with the label. Words that no example has weigh nothing. Examples with equal words are one entry with counts.

The index has a postings list for each term. Terms in over COMMON of the entries, whose postings are long and weigh
little, also have the greatest weight in each block of BLOCK similar entries. A query adds up the postings of its
other terms, bounds each block by that and by its common terms' greatest weights, looks into the best blocks first,
and then into all that can still hold one of the NEAREST entries; all entries as near as the last one count. Their
labels vote with weights that fall with distance; a logistic curve fitted on the examples, each without its own vote
(counted on the executors), makes the vote a probability. Evidence are ids of examples at the nearest entries.

Index and vocabulary are bounded by the examples and go to all executors. Null texts are empty; an empty text is
scored by the term that every text has; a very long text is counted whole. Repeated rows are scored alike, and each
labelled one is an example. An empty table gives no rows; without labelled rows every score is 0. Of other columns
score_toxicity takes none and reject_toxic gives all back, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import held_out, sample
from .shared import own, partitions, release_unused

#: Labelled documents used at most; entries that vote; entries of a block; blocks looked into first; texts scored at once.
EXAMPLES, NEAREST, BLOCK, FIRST, TOGETHER = 6000, 12, 64, 4, 64
#: Share of the entries above which a term is common; power of the relevance factor; weight of the term that every text has.
COMMON, RELEVANCE, ALWAYS = 1 / 16, 2, 1.0
#: Cosines closer than this are equal.
TIE = 1e-9
WORD = re.compile(r"[^\W\d_]+")

def counted(text: str | None) -> Counter:
    """How often a text has each word."""
    return Counter(WORD.findall((text or "").lower()))


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(x.max(initial=0)))


class Vectors:
    """Texts as TF-IDF vectors over the words of the examples; place 0 is the term that every text has."""

    def __init__(self, rows: list[tuple[int, str, int]]):
        self.place: dict[str, int] = {}
        found, with_label = [], []
        for _, text, label in rows:
            for word in (words := counted(text)):
                self.place.setdefault(word, len(self.place) + 1)
            found.append(self.counts(words)[0])
            with_label.append(np.full(len(found[-1]), label))
        terms = np.concatenate([*found, np.zeros(0, np.int64)])
        df = np.bincount(terms, minlength=len(self.place) + 1)[1:]
        yes = np.bincount(terms, np.concatenate([*with_label, np.zeros(0)]), len(self.place) + 1)[1:]
        idf = 1 + np.log((1 + len(rows)) / (1 + df))
        relevance = np.log2(2 + yes / np.maximum(1, df - yes))
        self.term_weight = np.concatenate([[ALWAYS], idf * relevance**RELEVANCE])

    def counts(self, words: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Places and times of a text's known words, by place."""
        place = self.place
        terms = np.array([0, *[place.get(w, -1) for w in words]])
        times = np.array([1, *words.values()])
        order = np.argsort(terms, kind="stable")
        order = order[np.searchsorted(terms[order], 0) :]
        return terms[order], times[order]

    def weights(self, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Weights of a vector of length 1."""
        w = (1 + np.log(times)) * self.term_weight[terms]
        return w / np.sqrt(w @ w)

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and weights of a text."""
        terms, times = self.counts(counted(text))
        return terms, self.weights(terms, times)


class Index:
    """Block-max inverted index of the examples (id, text, label)."""

    def __init__(self, rows: list[tuple[int, str, int]]):
        self.make, self.block = Vectors(rows), BLOCK
        by: dict[bytes, list[int]] = {}
        vectors: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        order = []
        for k, (_, text, _) in enumerate(rows):
            terms, times = self.make.counts(counted(text))
            name = self._name(terms, times)
            by.setdefault(name, []).append(k)
            if name not in vectors:
                weights = self.make.weights(terms, times)
                vectors[name] = terms.astype(np.int32), times.astype(np.int32)
                order.append((terms[np.lexsort((terms, -weights))][:8].tolist(), name))  # a block's entries are alike
        order.sort()
        names = [name for _, name in order]
        self.entry = {name: e for e, name in enumerate(names)}
        self.n = np.array([len(by[x]) for x in names], float)
        self.hits = np.array([sum(rows[k][2] for k in by[x]) for x in names], float)
        self.ids = [[rows[k][0] for k in by[x][:3]] for x in names]
        self.blocks = max(1, -(-len(names) // self.block))
        self._post([vectors[x][0] for x in names], [vectors[x][1] for x in names])

    @staticmethod
    def _name(terms: np.ndarray, times: np.ndarray) -> bytes:
        return xxhash.xxh128_digest(np.concatenate([terms, times]).tobytes())

    def _post(self, terms: list[np.ndarray], times: list[np.ndarray]) -> None:
        """Postings by term, then entry, as narrow integers; weights are made where they are used."""
        term = np.concatenate([*terms, np.zeros(0, np.int32)])
        order = np.argsort(term, kind="stable")
        self.where = _narrow(np.repeat(np.arange(len(terms), dtype=np.int32), [len(x) for x in terms])[order])
        self.times = _narrow(np.concatenate([*times, np.zeros(0, np.int32)])[order])
        self.lengths = _narrow(np.bincount(term, minlength=len(self.make.term_weight)))
        self.tiles = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "tiles": None, "most": None, "posted": None, "entries": None, "firsts": None, "row": None}

    def _spread(self) -> None:
        """Weights of the postings, and of common terms their rows, tiles of each block, and block maxima."""
        lengths, weight = self.lengths.astype(np.int64), self.make.term_weight
        self.firsts = np.concatenate([[0], np.cumsum(lengths)])
        self.entries = self.where.astype(np.int32)
        self.posted = (1 + np.log(self.times, dtype=np.float64)) * np.repeat(weight, lengths)
        self.posted /= np.sqrt(np.bincount(self.entries, self.posted**2, len(self.n)))[self.entries]
        common = np.flatnonzero(lengths > COMMON * len(self.n))
        self.row = np.full(len(weight), -1)
        self.row[common] = np.arange(len(common))
        self.tiles = np.zeros((self.blocks, len(common), self.block))
        for row, t in enumerate(common):
            some = slice(self.firsts[t], self.firsts[t + 1])
            block, place = np.divmod(self.entries[some], self.block)
            self.tiles[block, row, place] = self.posted[some]
        self.most = self.tiles.max(2).T
        release_unused()

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], without: list[int | None] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each vector, entries and cosines: the NEAREST best and all that tie with the last, exactly."""
        if self.tiles is None:
            self._spread()
        size, q = self.blocks * self.block, len(vectors)
        sums, by_common = np.empty((q, size)), np.zeros((q, len(self.most)))
        for k, (terms, weights) in enumerate(vectors):
            rows = self.row[terms]
            rare = rows < 0
            by_common[k, rows[~rare]] = weights[~rare]
            first = self.firsts[terms[rare]]
            n = self.firsts[terms[rare] + 1] - first
            at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            sums[k] = np.bincount(self.entries[at], self.posted[at] * np.repeat(weights[rare], n), size)
            if without and without[k] is not None:
                sums[k, without[k]] = -np.inf
        sums[:, len(self.n) :] = -np.inf
        cells = sums.reshape(q, self.blocks, self.block)
        bounds = cells.max(2) + by_common @ self.most

        def look(wanted: np.ndarray) -> np.ndarray:
            """Completes the wanted blocks and gives the NEAREST-th best of what is known then."""
            for b in np.flatnonzero(wanted.any(0)):
                some = np.flatnonzero(wanted[:, b])
                cells[some, b] += by_common[some] @ self.tiles[b]
            return np.partition(sums, -NEAREST, 1)[:, -NEAREST]

        first = np.zeros((q, self.blocks), bool)
        np.put_along_axis(first, np.argsort(-bounds, 1, kind="stable")[:, :FIRST], True, 1)
        least = look(first)
        rest = (bounds >= least[:, None] - TIE) & ~first
        least = look(rest)
        cells[~(first | rest)] = -np.inf
        out = []
        for c, low in zip(sums, least, strict=True):
            entries = np.flatnonzero((c >= low - TIE) & (c > -np.inf))
            entries = entries[np.lexsort((entries, -c[entries]))]
            out.append((entries, c[entries]))
        return out

    def vote(self, entries: np.ndarray, cosines: np.ndarray) -> float:
        """Votes by distance, drawn a little to the examples' share of the label."""
        w = self.n[entries] / (0.02 + np.maximum(0.0, 1 - cosines)) ** 2
        share = self.hits[entries] / np.maximum(self.n[entries], 1)
        prior = self.hits.sum() / max(1.0, self.n.sum())
        return float((w @ share + prior) / (w.sum() + 1))

    def own_votes(self, texts: list[str], labels: list[int]) -> list[float]:
        """Examples' votes, each without its own."""
        found = [self.make.counts(counted(x)) for x in texts]
        entries = [self.entry[self._name(*x)] for x in found]
        without = [e if self.n[e] == 1 else None for e in entries]
        out = []
        for e, label, near in zip(entries, labels, self.nearest([(x[0], self.make.weights(*x)) for x in found], without), strict=True):
            n, hits = self.n[e], self.hits[e]
            self.n[e], self.hits[e] = n - 1, hits - label
            out.append(self.vote(*near))
            self.n[e], self.hits[e] = n, hits
        return out


def curve(votes: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve over the votes' log-odds, by damped Newton steps."""
    x = _odds(votes)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -35, 35)))
        g = np.array([((p - labels) * x).sum() + (a - 1), (p - labels).sum()])
        v = p * (1 - p) + 1e-6
        h = np.array([[(v * x * x).sum() + 1, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 0.05)), float(b)


def _odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


class Scorer:
    """Probability and evidence of texts by a broadcast index; equal texts are scored once."""

    def __init__(self, index: Broadcast[Index], slope: float, intercept: float):
        self.index, self.slope, self.intercept = index, slope, intercept
        self.seen: dict[bytes, tuple[float, list[int]]] = {}

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[int]]]:
        index = self.index.value
        if not len(index.n):
            return [(0.0, [])] * len(texts)
        if len(self.seen) > 10_000:
            self.seen.clear()
        names = [xxhash.xxh128_digest(x or "") for x in texts]
        new = {name: x for name, x in zip(names, texts, strict=True) if name not in self.seen}
        for name, near in zip(new, index.nearest([index.make.vector(x) for x in new.values()]), strict=True):
            p = 1 / (1 + np.exp(-(self.slope * _odds(np.array(index.vote(*near))) + self.intercept)))
            self.seen[name] = float(p), [x for e in near[0][:3].tolist() for x in index.ids[e][:1]]
        return [self.seen[name] for name in names]


def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most TOGETHER rows."""
    for b in batches:
        for k in range(0, b.num_rows, TOGETHER):
            yield b.slice(k, TOGETHER)


def fit(examples: DataFrame) -> Scorer:
    """A scorer from bounded rows doc_id, text, label."""
    rows = examples.orderBy(F.xxhash64("doc_id"), "doc_id", "text").collect()  # bounded by the sample
    index = examples.sparkSession.sparkContext.broadcast(Index([(r["doc_id"], r["text"], r["label"]) for r in rows]))

    def votes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own("toxicity")
        for b in pieces(batches):
            out = index.value.own_votes(b.column(0).to_pylist(), b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(out, pa.float64())], ["label", "vote"])

    spread = examples.select("text", "label").repartition(partitions(examples.sparkSession))
    known = sorted((r["vote"], r["label"]) for r in spread.mapInArrow(votes, "label int, vote double").collect()) if rows else []
    slope, intercept = curve(np.array([v for v, _ in known]), np.array([y for _, y in known], float)) if known else (1.0, 0.0)
    return Scorer(index, slope, intercept)


def _scored(docs: DataFrame, labels: DataFrame, modulus: int, remainder: int, threshold: float, most: int, text: str, key: str) -> DataFrame:
    """docs' columns, named by their places, then held_out, score, predicted and evidence."""
    fitted = fit(sample(docs, labels, "toxic", modulus, remainder, most, text, key))
    place, key_place = docs.columns.index(text), docs.columns.index(key)
    docs = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("evidence", T.ArrayType(T.LongType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own("toxicity")
        for b in pieces(batches):
            out = fitted.scores(b.column(place).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.list_(pa.int64()))], names=[*b.schema.names, "score", "evidence"])

    scored = docs.mapInArrow(run, schema)
    return scored.withColumn("held_out", held_out(f"c{key_place}", modulus, remainder)).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def score_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, threshold: float = 0.3, most: int = EXAMPLES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (ids of near examples) of each row."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return _scored(rows, labels, modulus, remainder, threshold, most, "text", "doc_id").select(F.col("c0").alias("doc_id"), "held_out", "score", "predicted", "evidence")


def reject_toxic(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, threshold: float = 0.3, most: int = EXAMPLES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without those that are predicted toxic."""
    kept = _scored(docs, labels, modulus, remainder, threshold, most, text, key).filter("predicted = 0")
    return kept.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all documents, by labels outside the held-out quarter."""
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
