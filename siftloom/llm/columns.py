"""Columns of a caller's table, whatever their names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores in front until no column has it (names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def apart(df: DataFrame) -> tuple[DataFrame, dict[str, str], Callable[[DataFrame], DataFrame]]:
    """``df`` with its columns named ``own0``, ``own1``, ..., the new name of each, and the way back.

    No operator uses such names itself, so none of a caller's columns can clash.
    """
    names = {c: f"own{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names, lambda out: out.select(*names.values()).toDF(*names)
