"""Carrying a caller's columns through an operator under neutral names, so that no name can clash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Carried:
    """``rows``: the table with columns ``__c0, __c1 ...``; ``col(name)``: a caller's column; ``back``: the caller's
    names again, followed by the operator's own columns (which replace a caller's column of the same name)."""

    def __init__(self, df: DataFrame):
        self.columns = list(df.columns)
        self.names = [f"__c{i}" for i in range(len(self.columns))]
        self.rows = df.toDF(*self.names)

    def name(self, column: str) -> str:
        return self.names[self.columns.index(column)]

    def col(self, column: str) -> Column:
        return F.col(self.name(column))

    def only(self, columns: list[str]) -> Carried:
        """The same with fewer of the caller's columns to give back."""
        kept = [(n, c) for n, c in zip(self.names, self.columns) if c in columns]
        self.names, self.columns = [n for n, _ in kept], [c for _, c in kept]
        return self

    def back(self, df: DataFrame, *own: str) -> DataFrame:
        kept = [F.col(n).alias(c) for n, c in zip(self.names, self.columns) if c not in own]
        return df.select(*kept, *[F.col(f"__{c}").alias(c) for c in own])
