"""Groups of intermediate columns under a common prefix.

Flat columns on purpose: fields of a struct would be inlined into every consumer by the optimizer and their
regular expressions evaluated once per use, while a flat column used several times is computed once.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


class Parts:
    """Access to the columns of a group by short name."""

    def __init__(self, prefix: str):
        self.prefix = prefix

    def __getitem__(self, name: str) -> Column:
        return F.col(f"{self.prefix}_{name}")

    def define(self, columns: dict[str, Column]) -> list[Column]:
        return [c.alias(f"{self.prefix}_{n}") for n, c in columns.items()]
