"""Star queries: filter the dimensions, join the fact, aggregate, sort."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Star:
    """A fact with its dimensions {name: (table, fact key, dimension key)}."""

    fact: DataFrame
    dims: Mapping[str, tuple[DataFrame, str, str]]


@dataclass(frozen=True)
class Flight:
    """One star query. `where` filters a dimension (or the fact) before the join."""

    measure: Column
    name: str
    where: Mapping[str, Column] = field(default_factory=dict)
    by: Sequence[str] = ()
    order: Sequence[Column] = ()
    uses: Sequence[str] = ()  # dimension columns the measure reads


def run_flight(star: Star, flight: Flight, dims: Sequence[str]) -> DataFrame:
    """Dimensions are cut to the rows and columns the flight needs; whether one is broadcast is left to
    Spark, which compares its size with the broadcast threshold at run time."""
    out = star.fact
    if "fact" in flight.where:
        out = out.filter(flight.where["fact"])
    for name in dims:
        table, fact_key, key = star.dims[name]
        if name in flight.where:
            table = table.filter(flight.where[name])
        wanted = [key] + [c for c in (*flight.by, *flight.uses) if c in table.columns and c != key]
        out = out.join(table.select(*wanted), F.col(fact_key) == F.col(key))
    agg = out.groupBy(*flight.by).agg(F.sum(flight.measure).cast("double").alias(flight.name))
    return agg.orderBy(*flight.order) if flight.order else agg
