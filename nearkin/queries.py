"""Queries over the driver's tables, one for each operator, and the same rows in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.costs import CostMatrix, generate_cost_matrix
from .functions.distance import charset as chars
from .functions.distance import dist_matrix, dist_pairwise
from .operators import search, sets, split, tree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _column(spark: SparkSession, d: str, name: str, column: str, to: str = "sequence") -> DataFrame:
    return _table(spark, d, name).select(F.col(column).alias(to))


def _parts(spark: SparkSession, d: str) -> sets.SequenceSet:
    return sets.SequenceSet(spark, _column(spark, d, "part", "p_name"))


def _keyed(spark: SparkSession, d: str, name: str, key: str, column: str) -> DataFrame:
    return _table(spark, d, name).select(F.col(key).cast("long").alias("pos"), F.col(column).alias("sequence"))


#: A DNA-like text of nine letters for each customer.
DNA = "translate(substring(c_name, 10), '0123456789', 'ACGTACGTAC')"
#: An asymmetric cost table, as text and as SQL.
SUB = "CASE WHEN {q} = {t} THEN 0 ELSE 1 + ((ascii({q}) * 7 + ascii({t}) * 3) % 3) END"


def _costs() -> CostMatrix:
    return CostMatrix({q: {t: 0 if q == t else 1 + (ord(q) * 7 + ord(t) * 3) % 3 for t in "ACGT"} for q in "ACGT"})


def _dna(spark: SparkSession, d: str, to: str) -> DataFrame:
    return _table(spark, d, "customer").select(F.expr(DNA).alias(to)).distinct()


# sets


@query("SELECT DISTINCT p_name AS sequence FROM part")
def set_distinct(spark, d):
    return _parts(spark, d).to_df()


@query("SELECT count(DISTINCT p_name) AS size FROM part")
def set_size(spark, d):
    return _parts(spark, d).to_df().agg(F.count("*").alias("size"))


@query("SELECT CAST(strlen(p_name) AS INTEGER) AS len, count(DISTINCT p_name) AS count FROM part GROUP BY 1")
def set_size_by_len(spark, d):
    return sets.LengthSet(spark, _column(spark, d, "part", "p_name")).lengths()


_STORED = "(SELECT DISTINCT p_name AS sequence FROM part WHERE p_size <= 2)"
_FIRST = "row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1"


def _small(spark: SparkSession, d: str) -> sets.SequenceSet:
    """The names of small parts: a set that lacks some of the names that come next."""
    return sets.SequenceSet(spark, _table(spark, d, "part").filter("p_size <= 2").select(F.col("p_name").alias("sequence")))


@query(f"SELECT p_partkey AS pos, p_name AS sequence, p_name NOT IN (SELECT sequence FROM {_STORED}) AND {_FIRST} AS flag FROM part")
def insert_flags(spark, d):
    return _small(spark, d).insert(_keyed(spark, d, "part", "p_partkey", "p_name"))


@query(f"SELECT p_partkey AS pos, p_name AS sequence, p_name IN (SELECT sequence FROM {_STORED}) AND {_FIRST} AS flag FROM part")
def erase_flags(spark, d):
    return _small(spark, d).erase(_keyed(spark, d, "part", "p_partkey", "p_name"))


@query("SELECT DISTINCT p_name AS sequence FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size = 1)")
def erase_set(spark, d):
    s = _parts(spark, d)
    s.erase(_table(spark, d, "part").filter("p_size = 1").select("p_name"))
    return s.to_df()


@query("SELECT DISTINCT sequence FROM (SELECT p_name AS sequence FROM part UNION ALL SELECT n_name FROM nation) q")
def insert_set(spark, d):
    s = _parts(spark, d)
    s.insert(_table(spark, d, "nation").select("n_name"))
    return s.to_df()


@query("SELECT CAST(n_nationkey AS BIGINT) AS pos, n_name AS sequence, n_name IN (SELECT n_name FROM nation WHERE n_regionkey < 3) AS flag FROM nation")
def find_flags(spark, d):
    s = sets.SequenceSet(spark, _table(spark, d, "nation").filter("n_regionkey < 3").select("n_name"))
    return s.find(_keyed(spark, d, "nation", "n_nationkey", "n_name"))


_CHARS = "(SELECT unnest(string_split(r_name, '')) AS char FROM region) q WHERE char <> ''"


@query(f"SELECT DISTINCT char FROM {_CHARS}")
def charset(spark, d):
    return sets.char_counts(_column(spark, d, "region", "r_name")).select("char")


@query(f"SELECT char, count(*) AS count FROM {_CHARS} GROUP BY char")
def char_counts(spark, d):
    return sets.char_counts(_column(spark, d, "region", "r_name"))


@query("SELECT count(*) = count(DISTINCT p_name) AS valid FROM (SELECT DISTINCT p_name FROM part) q")
def set_validate(spark, d):
    return spark.createDataFrame([(_parts(spark, d).validate(),)], "valid boolean")


# trees

_NODES = """
WITH w AS (SELECT DISTINCT p_name AS w FROM part),
p AS (SELECT w, n, substr(w, 1, n) AS path, CASE WHEN n < length(w) THEN substr(w, n + 1, 1) END AS nxt FROM (SELECT w, unnest(range(0, length(w) + 1)) AS n FROM w) q),
k AS (SELECT path, bool_or(path = w) AS is_terminal FROM p GROUP BY path HAVING bool_or(path = w) OR count(DISTINCT nxt) >= 2 OR path = ''),
a AS (SELECT c.path, c.is_terminal, max(length(b.path)) AS up, count(*) AS depth FROM k c JOIN k b ON b.path <> c.path AND starts_with(c.path, b.path) GROUP BY c.path, c.is_terminal),
n AS (SELECT path, substr(path, 1, up) AS parent, substr(path, up + 1) AS label, is_terminal, CAST(depth AS INTEGER) AS depth FROM a
  UNION ALL SELECT path, NULL, '', is_terminal, 0 FROM k WHERE path = '')
"""


@query(f"{_NODES} SELECT path, parent, label, is_terminal, depth FROM n")
def tree_nodes(spark, d):
    return tree.nodes(_column(spark, d, "part", "p_name"))


@query(f"{_NODES} SELECT b.label AS parent, c.label AS child FROM n c JOIN n b ON c.parent = b.path")
def tree_edges(spark, d):
    return _parts(spark, d).graph()


@query(f"{_NODES} SELECT b.label AS parent, c.label AS child FROM n c JOIN n b ON c.parent = b.path WHERE c.depth <= 1")
def tree_edges_depth(spark, d):
    return _parts(spark, d).graph(depth=1)


@query(f"{_NODES} SELECT path, repeat(' ', depth) || CASE WHEN path = '' THEN '(root)' ELSE label END || CASE WHEN is_terminal THEN ':1' ELSE '' END AS line FROM n")
def tree_lines(spark, d):
    return tree.lines(_column(spark, d, "part", "p_name"))


_FOREST = """
WITH w AS (SELECT DISTINCT p_name AS w, CAST(length(p_name) AS INTEGER) AS len FROM part),
p AS (SELECT w, len, n, substr(w, 1, n) AS path, CASE WHEN n < length(w) THEN substr(w, n + 1, 1) END AS nxt FROM (SELECT w, len, unnest(range(0, length(w) + 1)) AS n FROM w) q),
k AS (SELECT len, path FROM p GROUP BY len, path HAVING bool_or(path = w) OR count(DISTINCT nxt) >= 2 OR path = ''),
a AS (SELECT c.len, c.path, max(length(b.path)) AS up FROM k c JOIN k b ON b.len = c.len AND b.path <> c.path AND starts_with(c.path, b.path) GROUP BY c.len, c.path),
n AS (SELECT len, path, substr(path, 1, up) AS parent, substr(path, up + 1) AS label FROM a UNION ALL SELECT len, path, NULL, '' FROM k WHERE path = '')
"""


@query(f"{_FOREST} SELECT b.label AS parent, c.label AS child FROM n c JOIN n b ON c.len = b.len AND c.parent = b.path")
def forest_edges(spark, d):
    """A tree for each length of text."""
    return sets.LengthSet(spark, _column(spark, d, "part", "p_name")).graph()


@query("SELECT count(*) = count(DISTINCT p_name) AS valid FROM (SELECT DISTINCT p_name FROM part) q")
def forest_validate(spark, d):
    return spark.createDataFrame([(sets.LengthSet(spark, _column(spark, d, "part", "p_name")).validate(),)], "valid boolean")


# searches


@query("SELECT q.query, t.target FROM (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]+') AS query FROM pages) q JOIN (SELECT DISTINCT url AS target FROM pages) t ON starts_with(t.target, q.query)")
def prefix_search(spark, d):
    """All pages of each host."""
    hosts = _table(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://[^/]+", 0).alias("query")).distinct()
    return search.prefix_search(hosts, _column(spark, d, "pages", "url"), target="sequence")


@query("SELECT '' AS query, url AS target FROM (SELECT DISTINCT url FROM pages) q")
def prefix_search_empty(spark, d):
    return search.prefix_search(spark.createDataFrame([("",)], "query string"), _column(spark, d, "pages", "url"), target="sequence")


_HAMMING = "list_sum([CAST(substr({q}, i, 1) <> substr({t}, i, 1) AS INTEGER) for i in range(1, length({q}) + 1)])"


def _hamming_sql(rows: str, limit: str) -> str:
    return f"SELECT * FROM (SELECT q.s AS query, t.s AS target, CAST(coalesce({_HAMMING.format(q='q.s', t='t.s')}, 0) AS INTEGER) AS distance FROM {rows} q JOIN {rows} t ON length(q.s) = length(t.s)) p WHERE distance <= {limit}"


_DNA = f"(SELECT DISTINCT {DNA} AS s FROM customer)"


@query(_hamming_sql(_DNA, "1"))
def hamming_search(spark, d):
    return search.similarity_join(_dna(spark, d, "query"), _dna(spark, d, "target"), 1, mode="hamming")


@query(_hamming_sql(_DNA, "trunc(length(query) * CAST(0.25 AS DOUBLE))"))
def hamming_fraction(spark, d):
    return search.similarity_join(_dna(spark, d, "query"), _dna(spark, d, "target"), max_fraction=0.25, mode="hm")


@query(_hamming_sql("(SELECT DISTINCT p_name AS s FROM part)", "3"))
def hamming_forest(spark, d):
    s = sets.LengthSet(spark, _column(spark, d, "part", "p_name"))
    return s.search(s.df, 3, mode="hamming")


def _lev_sql(queries: str, targets: str, limit: str) -> str:
    return f"SELECT * FROM (SELECT q.s AS query, t.s AS target, CAST(levenshtein(q.s, t.s) AS INTEGER) AS distance FROM {queries} q CROSS JOIN {targets} t) p WHERE distance <= {limit}"


_PART = "(SELECT DISTINCT p_name AS s FROM part)"


@query(_lev_sql(_PART, _PART, "2"))
def lev_search(spark, d):
    s = _parts(spark, d)
    return s.search(s.df, 2)


@query(_lev_sql("(SELECT p_name AS s FROM part)", _PART, "1"))
def lev_search_bag(spark, d):
    """A row for every part: queries are not made distinct."""
    return _parts(spark, d).search(_table(spark, d, "part").select("p_name"), 1)


@query(_lev_sql(_PART, _PART, "trunc(length(query) * CAST(0.29 AS DOUBLE))"))
def lev_fraction(spark, d):
    s = _parts(spark, d)
    return s.search(s.df, max_fraction=0.29)


@query(f"SELECT query, target, distance FROM (SELECT q.s AS query, q.k, t.s AS target, CAST(levenshtein(q.s, t.s) AS INTEGER) AS distance FROM (SELECT DISTINCT p_name AS s, p_size % 3 AS k FROM part) q CROSS JOIN {_PART} t) p WHERE distance <= k")
def lev_per_row(spark, d):
    asked = _table(spark, d, "part").select(F.col("p_name").alias("query"), (F.col("p_size") % 3).alias("k")).distinct()
    return _parts(spark, d).search(asked, "k")


_URL = "(SELECT DISTINCT url AS s FROM pages)"


@query(_lev_sql(_URL, _URL, "3"))
def lev_forest(spark, d):
    s = sets.LengthSet(spark, _column(spark, d, "pages", "url"))
    return s.search(s.df, 3)


_ITEM = "(SELECT DISTINCT text AS s FROM benchmark)"


@query(_lev_sql(_ITEM, _ITEM, "trunc(length(query) * CAST(0.75 AS DOUBLE))"))
def lev_bytes_nonascii(spark, d):
    """Whole texts in several languages: the distance counts bytes, the threshold characters."""
    rows = _column(spark, d, "benchmark", "text").distinct()
    return search.dist_search(rows, rows, max_fraction=0.75, query="sequence", target="sequence")


def _dp_sql(pairs: str, gap: int, opening: int | None, sub: str = SUB) -> str:
    """A recursion over the target's characters with one list for each state; {pairs} has query and target. Ends in the CTE cell (query, target, n, m, j, col)."""
    sub = sub.format(q="substr(query, i, 1)", t="substr(target, j + 1, 1)")
    far = 1 << 28
    if opening is None:
        state, first = "col", f"[i * {gap} for i in range(0, n + 1)] AS col"
        step = f"list_reduce(list_prepend([(j + 1) * {gap}], [[i] for i in range(1, n + 1)]), lambda acc, x: list_append(acc, least(col[x[1]] + ({sub.replace('i, 1', 'x[1], 1')}), col[x[1] + 1] + {gap}, acc[x[1]] + {gap}))) AS col"
        return f"WITH RECURSIVE p AS (SELECT DISTINCT query, target, length(query) AS n, length(target) AS m FROM {pairs} z), cell AS (SELECT query, target, n, m, CAST(0 AS BIGINT) AS j, {first} FROM p UNION ALL SELECT query, target, n, m, j + 1, {step} FROM cell WHERE j < m)"
    o, g = gap + opening, gap
    first = f"[CASE WHEN i = 0 THEN 0 ELSE {far} END for i in range(0, n + 1)] AS mm, [CAST({far} AS BIGINT) for i in range(0, n + 1)] AS xx, [CASE WHEN i = 0 THEN {far} ELSE {o} + (i - 1) * {g} END for i in range(0, n + 1)] AS yy"
    m_new = f"[CASE WHEN i = 0 THEN {far} ELSE least(mm[i], xx[i], yy[i]) + ({sub}) END for i in range(0, n + 1)]"
    x_new = f"[least({o} + mm[i + 1], {g} + xx[i + 1], {o} + yy[i + 1]) for i in range(0, n + 1)]"
    y_new = f"list_reduce(list_prepend([CAST({far} AS BIGINT)], [[i] for i in range(1, n + 1)]), lambda acc, z: list_append(acc, least({o} + m1[z[1]], {o} + x1[z[1]], {g} + acc[z[1]])))"
    return (
        f"WITH RECURSIVE p AS (SELECT DISTINCT query, target, length(query) AS n, length(target) AS m FROM {pairs} z), run AS (SELECT query, target, n, m, CAST(0 AS BIGINT) AS j, {first} FROM p"
        f" UNION ALL SELECT query, target, n, m, j + 1, m1, x1, {y_new} FROM (SELECT query, target, n, m, j, {m_new} AS m1, {x_new} AS x1 FROM run WHERE j < m) s),"
        " cell AS (SELECT query, target, n, m, j, [least(mm[i + 1], xx[i + 1], yy[i + 1]) for i in range(0, n + 1)] AS col FROM run)"
    )


def _global_sql(pairs: str, gap: int, opening: int | None, limit: int | None, sub: str = SUB) -> str:
    rule = "" if limit is None else f"AND col[n + 1] <= {limit}"
    return f"{_dp_sql(pairs, gap, opening, sub)} SELECT query, target, CAST(col[n + 1] AS INTEGER) AS distance FROM cell WHERE j = m {rule}"


def _anchored_cte(pairs: str, gap: int, opening: int | None, sub: str = SUB) -> str:
    return (
        f"{_dp_sql(pairs, gap, opening, sub)}, c AS (SELECT query, target, m, list_min(col) AS cd, list_position(col, list_min(col)) - 1 AS ci FROM cell WHERE j = m),"
        " r AS (SELECT query, target, n, min(col[n + 1]) AS rd FROM cell GROUP BY query, target, n),"
        " r2 AS (SELECT r.query, r.target, r.n, rd, min(j) AS rj FROM r JOIN cell ON r.query = cell.query AND r.target = cell.target AND cell.col[cell.n + 1] = rd GROUP BY r.query, r.target, r.n, rd),"
        " an AS (SELECT c.query, c.target, CAST(least(cd, rd) AS INTEGER) AS distance, CAST(CASE WHEN cd <= rd THEN ci ELSE n END AS INTEGER) AS query_size, CAST(CASE WHEN cd <= rd THEN m ELSE rj END AS INTEGER) AS target_size FROM c JOIN r2 ON c.query = r2.query AND c.target = r2.target)"
    )


def _anchored_sql(pairs: str, gap: int, opening: int | None, limit: int, sub: str = SUB) -> str:
    return f"{_anchored_cte(pairs, gap, opening, sub)} SELECT query, target, distance, query_size, target_size FROM an WHERE distance <= {limit}"


UNIT = "CAST({q} <> {t} AS INTEGER)"
_PAIRS = f"(SELECT q.s AS query, t.s AS target FROM {_DNA} q CROSS JOIN {_DNA} t)"
_NAMES = f"(SELECT q.s AS query, t.s AS target FROM {_PART} q CROSS JOIN {_PART} t)"


@query(_global_sql(_PAIRS, 2, None, 2))
def global_linear(spark, d):
    return search.similarity_join(_dna(spark, d, "query"), _dna(spark, d, "target"), 2, cost_matrix=_costs(), gap_cost=2)


@query(_global_sql(_PAIRS, 1, 2, 3))
def global_affine(spark, d):
    return search.similarity_join(_dna(spark, d, "query"), _dna(spark, d, "target"), 3, cost_matrix=_costs(), gap_cost=1, gap_open_cost=2)


@query(_anchored_sql(_NAMES, 1, None, 3, UNIT))
def anchored_unit(spark, d):
    s = _parts(spark, d)
    return s.search(s.df, 3, mode="anchored")


@query(_anchored_sql(_PAIRS, 2, None, 2))
def anchored_linear(spark, d):
    return search.similarity_join(_dna(spark, d, "query"), _dna(spark, d, "target"), 2, mode="an", cost_matrix=_costs(), gap_cost=2)


@query(_anchored_sql(_PAIRS, 1, 2, 2))
def anchored_affine(spark, d):
    return search.similarity_join(_dna(spark, d, "query"), _dna(spark, d, "target"), 2, mode="extension", cost_matrix=_costs(), gap_cost=1, gap_open_cost=2)


#: Names with letters of two bytes.
_WIDE = "translate(n_name, 'AEIO', 'ÀÉÎÕ')"
_WIDE_PAIRS = f"(SELECT q.s AS query, t.s AS target FROM (SELECT DISTINCT {_WIDE} AS s FROM nation) q CROSS JOIN (SELECT DISTINCT {_WIDE} AS s FROM nation) t)"


def _costs_of(*columns: tuple[DataFrame, str]) -> CostMatrix:
    """Costs as SUB has them, of all characters of some columns."""
    found = chars(*columns)
    return CostMatrix({q: {t: 0 if q == t else 1 + (ord(q) * 7 + ord(t) * 3) % 3 for t in found} for q in found})


@query(_global_sql(_WIDE_PAIRS, 2, None, 2))
def global_linear_nonascii(spark, d):
    """Costs of characters of several bytes: the distance counts characters."""
    rows = _table(spark, d, "nation").select(F.expr(_WIDE).alias("sequence")).distinct()
    return search.similarity_join(rows, rows, 2, cost_matrix=_costs_of((rows, "sequence")), gap_cost=2, query="sequence", target="sequence", unit="char")


def _single_gap_sql(pairs: str, gap: int, limit: int) -> str:
    ham = "coalesce(list_sum([CAST(substr({a}, i, 1) <> substr({b}, i, 1) AS INTEGER) for i in range(1, least(length({a}), length({b})) + 1)]), 0)"
    pre = "coalesce(list_sum([CAST(substr(query, i, 1) <> substr(target, i, 1) AS INTEGER) for i in range(1, p)]), 0)"
    drop_q = "coalesce(list_sum([CAST(substr(query, i + 1, 1) <> substr(target, i, 1) AS INTEGER) for i in range(p, least(n - 1, m) + 1)]), 0)"
    drop_t = "coalesce(list_sum([CAST(substr(query, i, 1) <> substr(target, i + 1, 1) AS INTEGER) for i in range(p, least(n, m - 1) + 1)]), 0)"
    return f"""WITH z AS (SELECT query, target, length(query) AS n, length(target) AS m FROM {pairs} y),
    c AS (SELECT query, target, {ham.format(a='query', b='target')} AS v FROM z
      UNION ALL SELECT query, target, {gap} + {pre} + {drop_q} FROM (SELECT *, unnest(range(1, n + 1)) AS p FROM z) a WHERE p - 1 <= least(n - 1, m)
      UNION ALL SELECT query, target, {gap} + {pre} + {drop_t} FROM (SELECT *, unnest(range(1, m + 1)) AS p FROM z) a WHERE p - 1 <= least(n, m - 1))
    SELECT query, target, CAST(min(v) AS INTEGER) AS distance FROM c GROUP BY query, target HAVING min(v) <= {limit}"""


@query(_single_gap_sql(_NAMES, 2, 4))
def single_gap(spark, d):
    s = _parts(spark, d)
    return s.single_gap_search(s.df, 4, 2)


@query(f"SELECT query, target, distance FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, target) AS r FROM ({_lev_sql(_PART, _PART, '4')}) q) p WHERE r <= 3")
def topn_per_query(spark, d):
    s = _parts(spark, d)
    return s.search(s.df, 4, limit=3)


# distances without a threshold

_IDS = "CAST(r_regionkey AS BIGINT) AS query_id, CAST(n_nationkey AS BIGINT) AS target_id, r_name AS query, n_name AS target"


def _matrix(spark: SparkSession, d: str, mode: str, **gaps: int) -> DataFrame:
    q = _table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("qid"), F.col("r_name").alias("query"))
    t = _table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("tid"), F.col("n_name").alias("target"))
    costs = {"cost_matrix": _costs_of((q, "query"), (t, "target")), **gaps} if gaps else {}
    return dist_matrix(q, t, mode, query_id="qid", target_id="tid", **costs)


@query(f"SELECT {_IDS}, CASE WHEN length(r_name) = length(n_name) THEN CAST(coalesce({_HAMMING.format(q='r_name', t='n_name')}, 0) AS INTEGER) END AS distance FROM region CROSS JOIN nation")
def dist_matrix_hm(spark, d):
    return _matrix(spark, d, "hamming")


@query(f"SELECT {_IDS}, CAST(levenshtein(r_name, n_name) AS INTEGER) AS distance FROM region CROSS JOIN nation")
def dist_matrix_gb(spark, d):
    return _matrix(spark, d, "global")


_RN = "(SELECT r_name AS query, n_name AS target FROM region CROSS JOIN nation)"


@query(f"{_anchored_cte(_RN, 1, None, UNIT)} SELECT {_IDS}, distance, query_size, target_size FROM region CROSS JOIN nation JOIN an ON an.query = r_name AND an.target = n_name")
def dist_matrix_an(spark, d):
    return _matrix(spark, d, "anchored")


def _weighted_matrix_sql(gap: int, opening: int | None) -> str:
    return f"{_dp_sql(_RN, gap, opening)}, an AS (SELECT query, target, CAST(col[n + 1] AS INTEGER) AS distance FROM cell WHERE j = m) SELECT {_IDS}, distance FROM region CROSS JOIN nation JOIN an ON an.query = r_name AND an.target = n_name"


@query(_weighted_matrix_sql(2, None))
def dist_matrix_linear(spark, d):
    return _matrix(spark, d, "global", gap_cost=2)


@query(_weighted_matrix_sql(1, 2))
def dist_matrix_affine(spark, d):
    return _matrix(spark, d, "global", gap_cost=1, gap_open_cost=2)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "part").select(F.col("p_partkey").alias("pair_id"), F.col("p_name").alias("query"), F.col("p_type").alias("target"))


_PP = "(SELECT DISTINCT p_name AS query, p_type AS target FROM part)"
_KEYS = "p_partkey AS pair_id, p_name AS query, p_type AS target"


@query(f"SELECT {_KEYS}, CASE WHEN strlen(p_name) = strlen(p_type) THEN CAST(coalesce({_HAMMING.format(q='p_name', t='p_type')}, 0) AS INTEGER) END AS distance FROM part")
def dist_pairwise_hm(spark, d):
    return dist_pairwise(_pairs(spark, d), "hm")


@query(f"SELECT {_KEYS}, CAST(levenshtein(p_name, p_type) AS INTEGER) AS distance FROM part")
def dist_pairwise_gb(spark, d):
    return dist_pairwise(_pairs(spark, d), "lv")


@query(f"{_anchored_cte(_PP, 1, None, UNIT)} SELECT {_KEYS}, distance, query_size, target_size FROM part JOIN an ON an.query = p_name AND an.target = p_type")
def dist_pairwise_an(spark, d):
    return dist_pairwise(_pairs(spark, d), "an")


def _pair_costs(spark: SparkSession, d: str) -> CostMatrix:
    p = _pairs(spark, d)
    return _costs_of((p, "query"), (p, "target"))


def _pairwise_sql(gap: int, opening: int | None, kind: str) -> str:
    if kind == "global":
        return f"{_dp_sql(_PP, gap, opening)}, an AS (SELECT query, target, CAST(col[n + 1] AS INTEGER) AS distance FROM cell WHERE j = m) SELECT {_KEYS}, distance FROM part JOIN an ON an.query = p_name AND an.target = p_type"
    return f"{_anchored_cte(_PP, gap, opening)} SELECT {_KEYS}, distance, query_size, target_size FROM part JOIN an ON an.query = p_name AND an.target = p_type"


@query(_pairwise_sql(2, None, "global"))
def dist_pairwise_linear(spark, d):
    return dist_pairwise(_pairs(spark, d), "gb", cost_matrix=_pair_costs(spark, d), gap_cost=2)


@query(_pairwise_sql(1, 2, "global"))
def dist_pairwise_affine(spark, d):
    return dist_pairwise(_pairs(spark, d), "gb", cost_matrix=_pair_costs(spark, d), gap_cost=1, gap_open_cost=2)


@query(_pairwise_sql(2, None, "anchored"))
def dist_pairwise_an_linear(spark, d):
    return dist_pairwise(_pairs(spark, d), "an", cost_matrix=_pair_costs(spark, d), gap_cost=2)


@query(_pairwise_sql(1, 2, "anchored"))
def dist_pairwise_an_affine(spark, d):
    return dist_pairwise(_pairs(spark, d), "an", cost_matrix=_pair_costs(spark, d), gap_cost=1, gap_open_cost=2)


def _square_sql(chars: str, cost: str) -> str:
    return f"SELECT q.c AS query_char, t.c AS target_char, CAST({cost} AS INTEGER) AS cost FROM (SELECT unnest(string_split('{chars}', '')) AS c) q CROSS JOIN (SELECT unnest(string_split('{chars}', '')) AS c) t"


@query(_square_sql("ACGT", "CASE WHEN q.c = t.c THEN 0 ELSE 1 END"))
def cost_matrix(spark, d):
    return generate_cost_matrix("ACGT").table(spark)


@query(_square_sql("ACGTN", "CASE WHEN q.c = t.c OR q.c = 'N' OR t.c = 'N' THEN 0 ELSE 3 END"))
def cost_matrix_ambiguity(spark, d):
    return generate_cost_matrix("ACGT", "N", 0, 3).table(spark)


# split search: URLs, out from a place near the host's start

_SPLIT = "strpos(url, '://') + 5"
_SIDES = f"(SELECT url, reverse(substr(url, 1, {_SPLIT})) AS l, substr(url, {_SPLIT} + 1) AS r FROM pages)"


def _split_sql(limit: int) -> str:
    pairs = f"(SELECT DISTINCT a.l AS query, b.l AS target FROM {_SIDES} a CROSS JOIN {_SIDES} b UNION SELECT DISTINCT a.r, b.r FROM {_SIDES} a CROSS JOIN {_SIDES} b)"
    return (
        f"{_anchored_cte(pairs, 1, None, UNIT)} SELECT a.url AS query, b.url AS target, CAST(x.distance + y.distance AS INTEGER) AS distance FROM {_SIDES} a CROSS JOIN {_SIDES} b"
        f" JOIN an x ON x.query = a.l AND x.target = b.l JOIN an y ON y.query = a.r AND y.target = b.r WHERE x.distance + y.distance <= {limit}"
    )


@query(_split_sql(3))
def split_search(spark, d):
    """All URLs against all, cut after the first characters of the host."""
    rows = _table(spark, d, "pages").select(F.col("url").alias("sequence"), F.expr("locate('://', url) + 5").alias("cut"))
    return split.split_search(rows, rows, "cut", "cut", max_distance=3, query="sequence", target="sequence")
