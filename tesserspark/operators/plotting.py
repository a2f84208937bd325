"""Plot data of scattering results, and drawing where matplotlib is installed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tesserspark.operators.scattering import ProbeScatteringResult


def structure_factor_data(result: ProbeScatteringResult, show_partials: bool = True) -> DataFrame:
    """(Q, label, y): pair contributions stand on the line S = 1."""
    t = result.structure_factor
    rows = t.long if show_partials else t.long.where("label = 'Total'")
    return rows.select("Q", "label", (F.col("value") + F.when(F.col("label") == "Total", 0.0).otherwise(1.0)).alias("y"))


def weighted_rdf_data(result: ProbeScatteringResult, show_partials: bool = True) -> DataFrame:
    t = result.weighted_rdf
    return (t.long if show_partials else t.long.where("label = 'Total'")).select("r", "label", F.col("value").alias("y"))


def _draw(data: DataFrame, axis: str, ax, total_kwargs, partial_kwargs, labels):
    if ax is None:
        try:
            import matplotlib.pyplot as plt
        except ImportError as e:
            raise ImportError("plotting needs matplotlib; pass an axis or install it") from e
        ax = plt.subplots()[1]
    rows = data.orderBy(axis).toPandas()
    for label, part in rows.groupby("label", sort=False):
        style = dict((total_kwargs if label == "Total" else partial_kwargs) or {})
        ax.plot(part[axis].to_numpy(), part["y"].to_numpy(), label=label, **style)
    ax.set_xlabel(labels[0])
    ax.set_ylabel(labels[1])
    return ax


def plot_structure_factor(result, *, ax=None, show_partials=True, total_kwargs=None, partial_kwargs=None):
    return _draw(structure_factor_data(result, show_partials), "Q", ax, total_kwargs, partial_kwargs, ("Q (1/angstrom)", "S(Q)"))


def plot_weighted_rdf(result, *, ax=None, show_partials=True, total_kwargs=None, partial_kwargs=None):
    return _draw(weighted_rdf_data(result, show_partials), "r", ax, total_kwargs, partial_kwargs, ("r (angstrom)", "g(r)"))
