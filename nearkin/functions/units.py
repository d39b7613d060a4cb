"""The unit that distances count in: bytes of UTF-8 (the default) or characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("byte", "char")


def check_unit(unit: str) -> str:
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}, not {unit!r}")
    return unit


def view(column: Column, unit: str = "byte") -> Column:
    """The text itself, or a text with one character for each of its bytes."""
    return column if check_unit(unit) == "char" else F.decode(F.encode(column, "UTF-8"), "ISO-8859-1")


def size(column: Column, unit: str = "byte") -> Column:
    return F.char_length(column) if check_unit(unit) == "char" else F.octet_length(column)


def codes(text: str, unit: str) -> bytes:
    """The text as fixed-width code units: one byte each, or four."""
    return text.encode("utf-8") if unit == "byte" else text.encode("utf-32-le")


def code_type(unit: str) -> str:
    return "u1" if unit == "byte" else "<u4"
