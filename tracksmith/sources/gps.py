"""GPS logs: CSV files with a header, cut into trips, projected, and filled up to one row a second."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import trips

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def read_points(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The rows of the files: trip_id (the first column, whatever its name), ts, x, y in metres, altitude, speed, acc_h and acc_v
    as standard deviations, link struct<src, dst>, and where the row stood: file, block (a part of the file that one task reads) and pos.

    Missing columns are null. Rows without an id, a time or a position go; other cells that don't parse are null.
    """
    raw = spark.read.csv(paths, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=False)
    raw = raw.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"))

    def cell(name: str, kind: str = "double"):
        return F.col(f"`{name}`").try_cast(kind) if name in raw.columns else F.lit(None).cast(kind)

    df = raw.select(
        F.col(f"`{raw.columns[0]}`").alias("trip_id"), "file", "block", "pos",
        F.try_to_timestamp(cell("recorded_at", "string"), F.lit(TIME_FORMAT)).cast("timestamp_ntz").alias("ts"),
        cell("longitude").alias("lon"), cell("latitude").alias("lat"), cell("altitude").alias("altitude"), cell("speed").alias("speed"),
        trips.sigma_of(cell("hort_accuracy")).alias("acc_h"), trips.sigma_of(cell("vert_accuracy")).alias("acc_v"),
        F.struct(cell("src", "int").alias("src"), cell("dst", "int").alias("dst")).alias("link"),
    )
    sound = F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90) & (F.abs("lat") < 90)
    df = df.where(F.col("trip_id").isNotNull() & F.col("ts").isNotNull() & sound).withColumn("_p", g.to_plane(F.col("lon"), F.col("lat")))
    return df.withColumns({"x": F.col("_p.x"), "y": F.col("_p.y")}).drop("_p", "lon", "lat")


def runs_of_ids(df: DataFrame, trip: str = "trip_id", file: str = "file", block: str = "block", pos: str = "pos") -> DataFrame:
    """Adds session: runs of equal ids in file order. Runs are counted within blocks and carried over by one summary row a block,
    so no task holds a file."""
    w = Window.partitionBy(file, block).orderBy(pos)
    new = F.when(F.row_number().over(w) == 1, 0).when(F.col(trip) != F.lag(trip).over(w), 1).otherwise(0)
    inner = df.withColumn("_run", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = inner.groupBy(file, block).agg(F.min_by(trip, pos).alias("_first"), F.max_by(trip, pos).alias("_last"), F.max("_run").alias("_runs"))
    blocks = Window.partitionBy(file).orderBy(block)
    begins = F.when(F.lag("_last").over(blocks).isNull(), 1).when(F.col("_first") != F.lag("_last").over(blocks), 1).otherwise(0) + F.coalesce(F.lag("_runs").over(blocks), F.lit(0))
    ends = ends.withColumn("_step", begins)
    ends = ends.select(file, block, F.sum("_step").over(blocks.rowsBetween(Window.unboundedPreceding, 0)).alias("_before"))
    return inner.join(ends, [file, block]).withColumn("session", (F.col("_before") + F.col("_run")).cast("long")).drop("_before", "_run")


def load_trips(spark: SparkSession, paths: str | list[str], *, runs: bool = True, max_trips: int = 0, skip_last: bool = False, fill: bool = True) -> DataFrame:
    """Points of trips with idx from 0, one a second; a missing second has nulls for all but its time.

    runs: an id that comes back in a file begins another trip (its trip_id gets #session after it); else a trip is all rows of an id.
    max_trips: only the first trips in the order of files and rows. skip_last: without the last trip of each file.
    """
    points = read_points(spark, paths)
    order = F.struct("file", "block", "pos")
    if runs or skip_last:
        points = runs_of_ids(points)
        if skip_last:
            points = points.join(points.groupBy("file").agg(F.max("session").alias("_last")), "file").where(F.col("session") < F.col("_last")).drop("_last")
        again = points.groupBy("trip_id").agg(F.count_distinct("file", "session").alias("_times"))
        if runs:
            points = points.join(again, "trip_id").withColumn("trip_id", F.when(F.col("_times") > 1, F.format_string("%s#%s#%d", "trip_id", F.element_at(F.split("file", "/"), -1), "session")).otherwise(F.col("trip_id"))).drop("_times")
        points = points.drop("session")
    points = points.withColumn("at", order).drop("file", "block", "pos")
    points = trips.first_trips(points, "trip_id", "at", max_trips)
    if not fill:
        return points.withColumn("idx", (F.row_number().over(Window.partitionBy("trip_id").orderBy("at")) - 1).cast("long")).drop("at")
    return fill_seconds(points)


def fill_seconds(points: DataFrame) -> DataFrame:
    """Missing seconds before a trip's next row, in the order of the file: rows that repeat a time or go back stay as they are."""
    w = Window.partitionBy("trip_id").orderBy("at")
    rows = points.withColumn("_next", F.lead("ts").over(w))
    rows = rows.withColumn("_t", F.explode(F.expr("CASE WHEN _next > ts + INTERVAL '1' SECOND THEN sequence(ts, _next - INTERVAL '1' SECOND, INTERVAL '1' SECOND) ELSE array(ts) END")))
    values = [F.when(F.col("_t") == F.col("ts"), F.col(c)).alias(c) for c in points.columns if c not in ("trip_id", "ts", "at")]
    idx = (F.row_number().over(Window.partitionBy("trip_id").orderBy("at", "_t")) - 1).cast("long").alias("idx")
    return rows.select("trip_id", idx, F.col("_t").alias("ts"), *values)
