"""Modes, thresholds and costs: normalised and checked on the driver."""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from numbers import Integral, Real

from pyspark.sql import Column
from pyspark.sql import functions as F

from .costs import CostMatrix

#: Aliases of the modes (fixed values).
MODES = {
    "hamming": ("hamming", "hm"),
    "global": ("global", "gb", "levenshtein", "lv"),
    "anchored": ("anchored", "an", "extension", "en"),
}


def normalize_mode(mode: str) -> str:
    """'hamming', 'global' or 'anchored', of any alias in any case."""
    if isinstance(mode, str):
        for name, aliases in MODES.items():
            if mode.lower() in aliases:
                return name
    raise ValueError(f"mode must be one of {[a for x in MODES.values() for a in x]}, not {mode!r}")


@dataclass(frozen=True)
class Costs:
    """What a distance charges. gap is a gap's cost for each character; opening is charged once more for each gap."""

    algorithm: str  # hamming, unit, linear or affine
    matrix: CostMatrix | None = None
    gap: int = 1
    opening: int = 0

    @property
    def first(self) -> int:
        """Cost of a gap's first character."""
        return self.gap + self.opening

    def edits(self, distance: int) -> int | None:
        """The most edits that a distance allows, or None if there is no bound."""
        if self.algorithm in ("hamming", "unit"):
            return distance
        least = min([self.gap, *self.matrix.off_diagonal()])
        return None if least <= 0 or self.matrix.nonzero_diagonal() else distance // least


def _integer(x: object, name: str, least: int) -> int:
    if isinstance(x, bool) or not isinstance(x, Real) or x != int(x) or x < least:
        raise ValueError(f"{name} must be an integer of at least {least}, not {x!r}")
    return int(x)


def costs(mode: str, matrix: CostMatrix | None = None, gap_cost: int | None = None, gap_open_cost: int | None = None, zero_diagonal: bool = True) -> Costs:
    """Checked costs of a normalised mode. Gap costs are only used, and checked, with a matrix."""
    if mode == "hamming":
        if matrix is not None or gap_cost is not None or gap_open_cost is not None:
            warnings.warn("costs are ignored in Hamming mode", stacklevel=3)
        return Costs("hamming")
    if matrix is None:
        if gap_cost is not None or gap_open_cost is not None:
            warnings.warn("gap costs are ignored without a cost matrix", stacklevel=3)
        return Costs("unit")
    if not isinstance(matrix, CostMatrix):
        matrix = CostMatrix(matrix)
    if zero_diagonal and matrix.nonzero_diagonal():
        raise ValueError("a search needs a cost matrix whose diagonal is zero")
    if gap_open_cost is not None and gap_cost is None:
        raise ValueError("gap_open_cost needs gap_cost")
    gap = 1 if gap_cost is None else _integer(gap_cost, "gap_cost", 1)
    opening = 0 if gap_open_cost is None else _integer(gap_open_cost, "gap_open_cost", 0)
    if opening == 0:
        return Costs("unit") if gap == 1 and matrix.is_unit() else Costs("linear", matrix, gap)
    return Costs("affine", matrix, gap, opening)


def threshold(query: Column, max_distance: int | str | Column | None, max_fraction: float | str | Column | None) -> Column:
    """Each query's greatest distance. max_distance wins over max_fraction, a share of the query's characters, cut to an integer."""
    for x, name in ((max_distance, "max_distance"), (max_fraction, "max_fraction")):
        if isinstance(x, Real) and not isinstance(x, bool) and x < 0:
            raise ValueError(f"{name} must not be negative")
    if max_distance is not None:
        if isinstance(max_distance, Integral | Real):
            return F.lit(int(max_distance))
        return (F.col(max_distance) if isinstance(max_distance, str) else max_distance).cast("int")
    if max_fraction is not None:
        share = F.lit(float(max_fraction)) if isinstance(max_fraction, Real) else F.col(max_fraction) if isinstance(max_fraction, str) else max_fraction
        return (F.char_length(query).cast("double") * share.cast("double")).cast("int")
    raise ValueError("either max_distance or max_fraction is needed")
