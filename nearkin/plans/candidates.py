"""Candidate pairs of a distance join, so that few pairs reach a kernel.

A pair within e edits shares one of e + 1 segments of the target, and the segment's shift is bounded from the
left and from the right, as in the Pass-Join filter. Hamming pairs share a segment at the same place. Anchored
pairs share one of any e + 1 segments of the target's prefix that any alignment consumes, shifted by e at most;
as texts often begin alike, a prefix is cut into twice as many segments where it is long enough, and the e + 1
that the fewest targets have are taken. Segments and the query's substrings meet by an equi-join on bytes, so the
plan is a hash or sort-merge join that AQE can split where a segment is frequent. Pairs too short for e + 1
segments meet by length where one bounds the other. All pairs are compared only where nothing bounds the edits,
where an anchored query is no longer than twice its edits, and for more edits than pay: a query asks for some e**3
substrings, so that is where there are fewer targets than that, and e is above MOST_EDITS.

Both sides hold distinct texts: queries (query, k: the threshold, e: the edits it allows, or null), targets (target).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.units import size, view

#: Up to so many edits segments are used whatever the number of targets.
MOST_EDITS = 16


def _place(i: Column, length: Column, parts: Column) -> tuple[Column, Column]:
    """Where the i-th of a text's parts begins (from 1), and its size; the longer parts come last."""
    base, extra = F.floor(length / parts).cast("int"), length % parts
    short = parts - extra
    return i * base + F.greatest(F.lit(0), i - short) + 1, base + F.when(i >= short, 1).otherwise(0)


def _segments(text: Column, length: Column, parts: Column) -> Column:
    """Array of (seg, piece)."""

    def of(i: Column) -> Column:
        at, n = _place(i, length, parts)
        return F.struct(i.alias("seg"), F.substring(text, at, n).alias("piece"))

    return F.transform(F.sequence(F.lit(0), parts - 1), of)


def _probes(text: Column, n: Column, length: Column, e: Column, parts: Column, mode: str) -> Column:
    """Array of (seg, piece): the query's substrings that can equal a segment of a text of this length."""

    def of(i: Column) -> Column:
        at, size_ = _place(i, length, parts)
        if mode == "hamming":
            low = high = at
        elif mode == "global":
            low = F.greatest(at - i, at + (n - length) - (e - i))
            high = F.least(at + i, at + (n - length) + (e - i))
        else:
            low, high = at - e, at + e
        low, high = F.greatest(low, F.lit(1)), F.least(high, n - size_ + 1)
        places = F.when(low <= high, F.sequence(low, high)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.transform(places, lambda p: F.struct(i.alias("seg"), F.substring(text, p, size_).alias("piece")))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), parts - 1), of)))


def candidates(queries: DataFrame, targets: DataFrame, mode: str, unit: str = "byte", strategy: str = "blocked") -> DataFrame:
    """query, k and target of all pairs that can be within k, each once."""
    q = queries.withColumns({"n": size(F.col("query"), unit), "q_text": view(F.col("query"), unit)})
    t = targets.withColumns({"m": size(F.col("target"), unit), "t_text": view(F.col("target"), unit)})
    if strategy == "nested":
        return _all(q, t, mode)
    pays = (F.col("e") <= MOST_EDITS) | (F.pow(F.col("e"), F.lit(3)) <= targets.agg(F.count("*")).scalar())
    bounded = q.filter(F.col("e").isNotNull() & pays)
    free = _all(q.filter(F.col("e").isNull() | ~pays), t, mode)
    if mode == "anchored":
        return _anchored(bounded, t, targets, unit).unionByName(free)
    n, e = F.col("n"), F.col("e")
    if mode == "hamming":
        lengths, short = F.array(n), F.array(n)
    else:
        lengths = _up(F.greatest(n - e, e + 1), n + e)
        short = _up(F.greatest(n - e, F.lit(0)), e)
    probing = bounded.withColumn("p", F.explode(lengths)).filter("p > e")
    wanted = bounded.select("n", "e").distinct().select("e", F.explode(lengths).alias("p")).filter("p > e").distinct()
    indexed = t.join(wanted, F.col("m") == F.col("p"))
    index = indexed.withColumn("s", F.explode(_segments(F.col("t_text"), F.col("p"), e + 1))).select("target", "p", "e", "s.*")
    probes = probing.withColumn("s", F.explode(_probes(F.col("q_text"), n, F.col("p"), e, e + 1, mode))).select("query", "k", "p", "e", "s.*")
    met = probes.join(index, ["p", "e", "seg", "piece"]).select("query", "k", "target").distinct()
    few = bounded.withColumn("p", F.explode(short)).filter("p <= e").join(t, F.col("m") == F.col("p")).select("query", "k", "target")
    return met.unionByName(few).unionByName(free)


def _up(low: Column, high: Column) -> Column:
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.expr("cast(array() as array<int>)"))


def _anchored(bounded: DataFrame, t: DataFrame, targets: DataFrame, unit: str) -> DataFrame:
    """A target's prefix of length p is segmented for queries of n = p + e, or for all longer ones if it is the whole target."""
    e, p = F.col("e"), F.col("p")
    wanted = bounded.select((F.col("n") - e).alias("p"), "e").distinct()  # a row for each length and number of edits
    prefixes = t.join(F.broadcast(wanted), (p < F.col("m")) & (p > e)).select("target", "t_text", "p", "e")
    edits = bounded.select("e").distinct()
    full = t.join(F.broadcast(edits), F.col("m") > e).select("target", "t_text", F.col("m").alias("p"), "e")
    lengths = targets.select(size(F.col("target"), unit).alias("p")).distinct()
    own = bounded.select("query", "k", "e", "n", "q_text", (F.col("n") - e).alias("p"))
    shorter = bounded.join(F.broadcast(lengths), (p < F.col("n") - e) & (p > e)).select("query", "k", "e", "n", "q_text", "p")
    parts = F.when(p >= 6 * (e + 1), 2 * (e + 1)).otherwise(e + 1)
    index = prefixes.unionByName(full).withColumn("s", F.explode(_segments(F.col("t_text"), p, parts))).select("target", "p", "e", "s.*")
    index = index.withColumn("have", F.count("*").over(Window.partitionBy("p", "e", "seg", "piece")))
    index = index.withColumn("place", F.row_number().over(Window.partitionBy("target", "p", "e").orderBy("have", "seg"))).filter(F.col("place") <= e + 1)
    index = index.select("target", "p", "e", "seg", "piece")
    probes = own.filter("p > e").unionByName(shorter).withColumn("s", F.explode(_probes(F.col("q_text"), F.col("n"), p, e, parts, "anchored"))).select("query", "k", "p", "e", "s.*")
    met = probes.join(index, ["p", "e", "seg", "piece"]).select("query", "k", "target").distinct()
    brief = bounded.filter("n <= 2 * e").join(t).select("query", "k", "target")
    few = bounded.filter("n > 2 * e").join(t, F.col("m") <= e).select("query", "k", "target")
    return met.unionByName(brief).unionByName(few)


def _all(q: DataFrame, t: DataFrame, mode: str) -> DataFrame:
    """All pairs, of lengths that can be near each other."""
    if mode == "hamming":
        pairs = q.join(t, F.col("n") == F.col("m"))
    elif mode == "global":
        pairs = q.join(t, F.col("e").isNull() | (F.abs(F.col("n") - F.col("m")) <= F.col("e")))
    else:
        pairs = q.join(t)
    return pairs.select("query", "k", "target")
