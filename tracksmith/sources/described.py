"""Features of trips as JSON and CSV, and back: files of one row a trip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import spatial


def write(df: DataFrame, path: str) -> None:
    """Writes a folder of one JSON object a line, or of CSV with a header, by the ending of path (.json or .csv)."""
    if path.rstrip("/").endswith(".json"):
        df.write.mode("overwrite").json(path, ignoreNullFields=False)
    elif path.rstrip("/").endswith(".csv"):
        df.write.mode("overwrite").csv(path, header=True)
    else:
        raise ValueError(f"{path}: neither .json nor .csv")


def read(spark: SparkSession, paths: list[str], schema: str, key: str = "trip_id") -> DataFrame:
    """The rows of several such folders, in the order of paths: of an id that repeats, the row of the later folder counts."""
    out = None
    for no, path in enumerate(paths):
        rows = spark.read.schema(schema)
        rows = rows.json(path) if path.rstrip("/").endswith(".json") else rows.csv(path, header=True)
        rows = rows.withColumn("_no", F.lit(no))
        out = rows if out is None else out.unionByName(rows)
    return spatial.latest(out, [key], ["_no"]).drop("_no")
