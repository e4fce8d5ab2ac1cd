"""Slot columns on a stream: the narrow part of the extraction needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.extract import Rules, with_numbers


def stream_numbers(q: DataFrame, rules: Rules | None = None) -> DataFrame:
    """A streaming table (id, text) with class, energies, target and program names."""
    return with_numbers(q, rules)
