"""Results: a wide table with one column per label, its long form, and the settings that made it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Table:
    """``long`` has (axis, label, value); ``wide`` pivots it with the labels known from the request."""

    long: DataFrame
    axis: str
    labels: tuple[str, ...]
    attrs: dict = field(default_factory=dict)

    @property
    def wide(self) -> DataFrame:
        return self.long.groupBy(self.axis).pivot("label", list(self.labels)).agg(F.first("value")).orderBy(self.axis)

    def toPandas(self):
        out = self.wide.toPandas()
        out.attrs = dict(self.attrs)
        return out


def grid(spark, name: str, values: list, *more: tuple[str, list]) -> DataFrame:
    """A small table of grid points: (place, name, ...)."""
    rows = [(k, *(float(x) for x in row)) for k, row in enumerate(zip(values, *(v for _, v in more)))]
    return spark.createDataFrame(rows, ", ".join(["place int", f"{name} double", *(f"{n} double" for n, _ in more)]))


def any_of(label: Column, names: list[str]) -> Column:
    return label.isin(names)
