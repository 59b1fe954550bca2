"""Places where trips stop, and the trips that visit each of them."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import groups_of
from .smoothing import affinity_propagation, stops_of
from .spatial import within_distance

# What an exemplar costs (squared metres), and how near a trip must come to a place.
PREFERENCE, RADIUS = -100_000.0, 100.0


def places_of(stops: DataFrame, save, preference: float = PREFERENCE) -> DataFrame:
    """(label, cx, cy): the exemplars of stops (px, py) by affinity propagation.

    A point farther from an exemplar than the root of the preference is better off as its own, so stops in cells of that size that
    don't touch share no exemplar: message passing runs for each group of touching cells by itself, in memory of the square of its
    places. Stops at one place are one of their weight: copies would share its exemplar at no cost.
    """
    size = math.sqrt(-preference)
    at = stops.groupBy("px", "py").agg(F.count("*").alias("weight"))
    at = save(at.select(F.floor(F.col("px") / size).alias("gx"), F.floor(F.col("py") / size).alias("gy"), "px", "py", "weight"), "stops")
    cell = F.struct("gx", "gy")
    cells = at.select(cell.alias("u")).distinct()
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    near = cells.select("u", F.explode(around).alias("d")).select("u", F.struct((F.col("u.gx") + F.col("d.a")).alias("gx"), (F.col("u.gy") + F.col("d.b")).alias("gy")).alias("v"))
    roots = groups_of(near.join(cells.withColumnRenamed("u", "v"), "v"), save)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["px", "py"])
        points = pdf[["px", "py"]].to_numpy()
        best = affinity_propagation(points, preference, weights=pdf.weight.to_numpy())
        g = pdf.root.iloc[0]
        return pd.DataFrame([(f"{g['gx']}:{g['gy']}:{k}", *points[e]) for k, e in enumerate(sorted(set(best)))], columns=["label", "cx", "cy"])

    grouped = at.withColumn("node", cell).join(roots, "node").select("root", "px", "py", "weight")
    return grouped.groupBy("root").applyInPandas(run, "label string, cx double, cy double")


def cluster_trips(states: DataFrame, save, *, preference: float = PREFERENCE, radius: float = RADIUS) -> tuple[DataFrame, DataFrame]:
    """(places, visits) of smoothed states: places (label, cx, cy); visits (trip_id, label), one row for each place that a state of
    the trip is nearer to than radius."""
    places = save(places_of(stops_of(states), save, preference), "places")
    at = states.select("trip_id", F.col("x")[0].alias("x"), F.col("x")[1].alias("y"))
    return places, within_distance(at, places, radius).select("trip_id", "label").distinct()


def trips_by_place(visits: DataFrame) -> DataFrame:
    """(label, trips): who came to a place."""
    return visits.groupBy("label").agg(F.array_sort(F.collect_set("trip_id")).alias("trips"))
