"""Benchmark decontamination with DataFrame functions only.

Texts are lower-cased (A-Z) and cut into words. An item's windows are its runs of `window` words; an item of fewer
words is one window. Any occurrence of a window of m words covers one whole block of (m + 1) / 2 words that begins
at a multiple of that length, so a document looks up the hashes of its aligned blocks only, a quarter as many as it
has words. The hash set of all blocks that a window can have there, and of the windows themselves, is a bitmap of
at most MOST_BITS bits that goes to every executor; it takes blocks and windows that it should not now and then, but
leaves none out. What is left are the windows around hits, which meet the benchmark's windows word by word in an
equi-join: the benchmark's side is broadcast where counted rows and bytes allow it, and else both sides are shuffled,
hits only. No text is shuffled, and the same rows come out whatever the benchmark's size: a larger one fills the
bitmap, so that more windows go to the join. Documents are scanned in pieces of PIECE words and an overlap, so
that no row of a long one repeats its text.

Null texts have no words and are not hit; so have empty ones. Items without an id, or without words, are left out;
items that share an id are one. Rows that share a document id are judged each by itself, and each has its row. An
empty benchmark hits nothing; no documents give no rows. Columns other than those named are ignored, whatever their
names. A very long text is split into words once, as one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import numbered

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: ASCII that is no letter or digit.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"
#: Bits of the set for each hash in it, and at most (16 MB); what a bitmap of Spark's functions holds (fixed value).
BITS_EACH, MOST_BITS, BITMAP_BITS = 32, 1 << 27, 1 << 15
#: Windows, and their bytes, that are broadcast to the join at most.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20
#: Words of a document that are scanned as one row, besides those that a window may take of the next one.
PIECE = 128


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{BETWEEN}+"), "")


def _exact(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _loose(words: Column) -> Column:
    """Lower-cased words, equal where those in A-Z's lower case are. Capital sigma is lower-cased first, as Unicode looks at its neighbours."""
    return F.split(F.lower(F.replace(F.array_join(words, " "), F.lit("Σ"), F.lit("σ"))), " ")


def _hash(m: int, words: str, at: str, size: int) -> str:
    """SQL of a hash of `size` words from the place `at`, for windows of m words."""
    return f"xxhash64({m}, {', '.join(f'get({words}, {at} + {k})' for k in range(size))})"


def _windows(items: DataFrame, text: str, key: str, window: int) -> DataFrame:
    """item, m (words), window (its words, joined) and loose (words), of all windows."""
    words = items.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("item"), _words(_exact(F.col(text))).alias("all"))
    words = words.filter(F.size("all") > 0).withColumn("m", F.least(F.size("all"), F.lit(window)))
    starts = words.withColumn("p", F.explode(F.sequence(F.lit(0), F.size("all") - F.col("m"))))
    own = starts.select("item", "m", F.slice("all", F.col("p") + 1, F.col("m")).alias("words"))
    return own.select("item", "m", F.array_join("words", " ").alias("window"), _loose(F.col("words")).alias("loose"))


def _per_length(lengths: list[int], of) -> Column:
    return reduce(lambda rest, m: F.when(F.col("m") == m, of(m)).otherwise(rest), lengths, F.lit(None))


class _HashSet:
    """A bitmap of hashes; it is a scalar subquery of the plan that asks for it."""

    def __init__(self, hashes: DataFrame):
        spark = hashes.sparkSession
        n = hashes.agg(F.count("h")).first()[0]
        self.bits = BITMAP_BITS
        while self.bits < min(MOST_BITS, n * BITS_EACH):
            self.bits *= 2
        at = hashes.select(F.pmod("h", F.lit(self.bits)).alias("at"))
        filled = at.groupBy(F.expr("at div 32768").alias("k")).agg(F.expr(f"bitmap_construct_agg(at % {BITMAP_BITS})").alias("bitmap"))
        every = spark.range(self.bits // BITMAP_BITS).select(F.col("id").alias("k"))  # at most 4,096 bitmaps of 4 KB
        whole = every.join(filled, "k", "left").select("k", F.coalesce("bitmap", F.expr(f"unhex(repeat('00', {BITMAP_BITS // 8}))")).alias("bitmap"))
        parts = whole.agg(F.sort_array(F.collect_list(F.struct("k", "bitmap"))).alias("parts"))
        self.set = parts.select(F.unhex(F.array_join(F.transform("parts", lambda x: F.hex(x["bitmap"])), "")).alias("set")).scalar()

    def has(self, h: Column) -> Column:
        """Whether a hash may be in the set."""
        at = F.pmod(h, F.lit(self.bits))
        byte = F.conv(F.hex(F.substring(self.set, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
        return F.getbit(byte, (at % 8).cast("int")) == 1


def _cut(words: str, n: Column, size: int, window: int) -> Column:
    """Array of (first, raw): slices that begin at multiples of `size` below n, each with what a window may take of the next one."""
    return F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size)), lambda c: F.struct(c.alias("first"), F.slice(words, c + 1, size + window - 1).alias("raw")))


def _candidates(rows: DataFrame, kept: list[str], found: DataFrame, lengths: list[int], window: int) -> DataFrame:
    """kept and n_words of rows (these, text) once for each s, m and window (exact) that the set takes, and once with nulls there."""
    half = {m: (m + 1) // 2 for m in lengths}
    blocks = F.explode(_per_length(lengths, lambda m: F.array(*[F.expr(_hash(m, "loose", str(k), half[m])) for k in range(half[m])])))
    own = found.select(_per_length(lengths, lambda m: F.expr(_hash(-m, "loose", "0", m))).alias("h"))
    known = _HashSet(found.select(blocks.alias("h")).union(own).distinct())

    # what explode gives is not computed again by those that use it; a text is cut twice, as a slice costs as much as what it is cut from
    words = rows.select(*kept, F.explode(F.array(_words(F.col("text")))).alias("words")).withColumn("n_words", F.size("words"))
    parts = _cut("words", F.col("n_words"), PIECE * PIECE, window)
    words = words.select(*kept, "n_words", F.explode(parts).alias("part")).select(*kept, "n_words", F.col("part.first").alias("base"), F.col("part.raw").alias("part"))
    pieces = F.transform(_cut("part", F.least(F.size("part"), F.lit(PIECE * PIECE)), PIECE, window), lambda x: F.struct(x["first"].alias("at"), x["raw"].alias("raw"), _loose(x["raw"]).alias("loose")))
    pieces = words.select(*kept, "n_words", "base", F.explode(pieces).alias("piece")).select(*kept, "n_words", (F.col("base") + F.col("piece.at")).alias("first"), "piece.raw", "piece.loose")
    pieces = pieces.withColumn("n", F.size("raw"))
    own_columns = [*kept, "n_words", "first", "raw", "n", "loose"]
    # a piece's hashes one after another, by length, and a null for each document
    sizes = {m: f"(if(n >= {m}, n div {half[m]}, 0))" for m in lengths}
    hashes = [f"if(n >= {m}, transform(sequence(0, n div {half[m]} - 1), j -> {_hash(m, 'loose', f'j * {half[m]}', half[m])}), array())" for m in lengths]
    scanned = pieces.withColumn("hashes", F.expr(f"concat({', '.join([*hashes, 'if(first = 0, array(cast(null as bigint)), array())'])})"))
    each = scanned.select(*own_columns, F.posexplode("hashes").alias("at", "h")).filter(F.col("h").isNull() | known.has(F.col("h")))
    m_of, p_of = "cast(null as int)", "cast(null as int)"
    for k, m in reversed(list(enumerate(lengths))):
        first = f"({' + '.join(['0', *(sizes[x] for x in lengths[:k])])})"
        m_of = f"if(at < {first} + {sizes[m]}, {m}, {m_of})"
        p_of = f"if(at < {first} + {sizes[m]}, (at - {first}) * {half[m]}, {p_of})"
    placed = each.select(*own_columns, F.expr(f"if(h is null, null, {m_of})").alias("m"), F.expr(f"if(h is null, null, {p_of})").alias("p"))
    # a window that begins in the overlap is the next piece's
    low, high = F.expr("greatest(0, p - (m + 1) div 2 + 1)"), F.expr(f"least(p, n - m, {PIECE - 1})")
    starts = F.when(F.col("m").isNull(), F.array(F.lit(None).cast("int"))).when(low <= high, F.sequence(low, high))
    spread = placed.select(*own_columns, "m", F.explode(starts).alias("s"))
    spread = spread.filter(F.col("m").isNull() | known.has(_per_length(lengths, lambda m: F.expr(_hash(-m, "loose", "s", m)))))
    text = F.when(F.col("m").isNotNull(), _exact(F.array_join(F.slice("raw", F.col("s") + 1, F.col("m")), " ")))
    return spread.select(*kept, "n_words", (F.col("first") + F.col("s")).alias("s"), "m", text.alias("window"))


def hits(rows: DataFrame, items: DataFrame, window: int = 8, item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """A row for each of rows (row_id, text, and others that go along): these without text, n_words, starts (of windows found, with their lengths) and items (ids found, as strings)."""
    found = _windows(items, item_text, item_key, window)
    table = found.groupBy("m", "window").agg(F.collect_set("item").alias("items"))
    kept = [c for c in rows.columns if c != "text"]
    lengths = sorted(r[0] for r in found.select("m").distinct().collect())  # as many as a window has words at most
    if not lengths:
        none = F.expr("cast(array() as array<struct<s:int,m:int>>)"), F.expr("cast(array() as array<string>)")
        return rows.select(*kept, F.size(_words(F.col("text"))).cast("long").alias("n_words"), none[0].alias("starts"), none[1].alias("items"))
    n, size = found.select("m", "window", "item").agg(F.count("*"), F.sum(F.octet_length("window") + F.octet_length("item"))).first()
    small = n <= BROADCAST_ROWS and size <= BROADCAST_BYTES
    places = _candidates(rows, kept, found, lengths, window)
    # a row without a place has a window that no item has, of its own, so that such rows do not meet in one task
    places = places.withColumn("window", F.coalesce("window", F.concat(F.lit(" "), F.col("row_id").cast("string"))))
    table = table.select(F.col("m").alias("item_m"), F.col("window").alias("item_window"), "items")
    met = places.join(F.broadcast(table) if small else table, (F.col("window") == F.col("item_window")) & (F.coalesce("m", F.lit(0)) == F.col("item_m")), "left")
    spans = F.collect_set(F.when(F.col("items").isNotNull(), F.struct("s", "m"))).alias("starts")
    others = [F.first(c).alias(c) for c in [*kept, "n_words"] if c != "row_id"]
    return met.groupBy("row_id").agg(*others, spans, F.collect_set("items").alias("items")).select(*kept, F.col("n_words").cast("long").alias("n_words"), "starts", F.array_distinct(F.flatten("items")).alias("items"))


def _covered() -> Column:
    """The places of all words that are hit."""
    return F.array_distinct(F.flatten(F.transform("starts", lambda x: F.sequence(x["s"], x["s"] + x["m"] - 1))))


def contamination(docs: DataFrame, items: DataFrame, window: int = 8, min_items: int = 2, text: str = "text", key: str = "doc_id", **columns: str) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(key).alias("key"), F.col(text).alias("text"))
    n = F.size("items").cast("long")
    listed = F.array_join(F.array_sort("items"), ",")
    return hits(rows, items, window, **columns).select(F.col("key").alias("doc_id"), "n_words", F.size(_covered()).cast("long").alias("n_hit"), n.alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (n >= min_items).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 8, min_items: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without those that hold passages of `min_items` items or more; in the others, every word that is hit is cut out, with what follows it up to the next word.

    Rows are numbered in a stored table, so that both scans of it have the same numbers. Null and empty texts stay
    as they are, as does every text that is not hit; repeated rows stay or go together.
    """
    rows = numbered(docs, "decontamination")
    found = hits(rows.select("row_id", F.col("doc").getField(text).alias("text")), items, window).filter(F.size("starts") > 0)
    found = found.select("row_id", _covered().alias("hit_at"), F.size("items").alias("hit_items"))
    rows = rows.join(found, "row_id", "left")
    rows = rows.filter(F.coalesce("hit_items", F.lit(0)) < min_items)
    body = F.col("doc").getField(text)
    pieces = F.split(body, f"(?<={BETWEEN})(?!{BETWEEN}|$)")  # each a word with what follows it; the first may be no word
    lead = F.when(body.rlike(f"^{BETWEEN}"), 1).otherwise(0)
    cut = F.array_join(F.filter(pieces, lambda _, k: ~F.array_contains("hit_at", k - lead)), "")
    kept = F.when(F.col("hit_at").isNull(), body).otherwise(cut)
    return rows.select(*[kept.alias(c) if c == text else F.col("doc").getField(c).alias(c) for c in docs.columns])


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all documents against all items."""
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP2_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bi AS (SELECT item_id, w, least(len(w), 8) AS m, unnest(range(1, len(w) - least(len(w), 8) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g FROM bi),
ms AS (SELECT DISTINCT m FROM bw),
di AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d CROSS JOIN ms WHERE len(w) >= m),
dw AS (SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g FROM di),
hit AS (SELECT doc_id, dw.m, i, item FROM dw JOIN bw ON dw.m = bw.m AND dw.g = bw.g),
spot AS (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, m, i FROM hit) q),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM spot GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) q GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
