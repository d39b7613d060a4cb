"""Substitution costs of pairs of characters; rows are the query's characters, columns the target's."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession

COSTS = "query_char string, target_char string, cost int"
#: Names of a table's rows that are no characters (fixed values).
GAPS = ("gap", "gap_open")


class CostMatrix:
    """A square table of non-negative integer costs, from nested mappings: costs[query_char][target_char].

    Rows and columns named gap or gap_open are skipped: gap costs are parameters of their own.
    """

    def __init__(self, costs: Mapping[str, Mapping[str, int]]):
        costs = {q: {t: c for t, c in row.items() if t not in GAPS} for q, row in costs.items() if q not in GAPS}
        chars = list(costs)
        if any(len(c) != 1 for c in chars):
            raise ValueError("names of a cost matrix are single characters")
        for row in costs.values():
            if set(row) != set(chars):
                raise ValueError("a cost matrix has the same names for its rows and its columns")
            for x in row.values():
                if isinstance(x, bool) or x != int(x) or x < 0:
                    raise ValueError("costs are integers of at least 0")
        self.chars = chars
        self.costs = {q: {t: int(costs[q][t]) for t in chars} for q in chars}

    @classmethod
    def of(cls, rows: DataFrame) -> CostMatrix:
        """From a table query_char, target_char, cost: a few rows for each character."""
        found: dict[str, dict[str, int]] = {}
        for r in rows.select("query_char", "target_char", "cost").collect():
            found.setdefault(r[0], {})[r[1]] = r[2]
        return cls(found)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(q, t, c) for q, row in self.costs.items() for t, c in row.items()], COSTS)

    def off_diagonal(self) -> list[int]:
        return [c for q, row in self.costs.items() for t, c in row.items() if q != t]

    def nonzero_diagonal(self) -> bool:
        return any(self.costs[c][c] for c in self.chars)

    def is_unit(self) -> bool:
        return all(c == (q != t) for q, row in self.costs.items() for t, c in row.items())

    def covers(self, charset: Sequence[str], unit: str = "char") -> None:
        """Raises ValueError unless all characters have costs; bytes of other than ASCII characters have none."""
        if unit == "byte" and (wide := [c for c in {*self.chars, *charset} if not c.isascii()]):
            raise ValueError(f'costs of {sorted(wide)} are costs of characters, not of bytes: unit="char" is needed')
        if missing := sorted(set(charset) - set(self.chars)):
            raise ValueError(f"the cost matrix has no costs for {missing}")

    def lookup(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted character codes, and the costs in their order."""
        chars = sorted(self.chars)
        return np.array([ord(c) for c in chars], np.int64), np.array([[self.costs[q][t] for t in chars] for q in chars], np.int64)


def generate_cost_matrix(charset: str | Sequence[str], ambiguity_base: str | None = None, match: int = 0, mismatch: int = 1) -> CostMatrix:
    """Costs `match` on the diagonal and `mismatch` elsewhere; an ambiguity base costs `match` against every character."""
    chars = list(dict.fromkeys(charset))
    if ambiguity_base is not None and ambiguity_base not in chars:
        chars.append(ambiguity_base)
    return CostMatrix({q: {t: match if q == t or ambiguity_base in (q, t) else mismatch for t in chars} for q in chars})
