"""What the operators share: saved tables in the shared folder, size checks, row keys, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only if a count has shown that it has no more rows than this.
BROADCAST_ROWS = 400_000
#: Spark's setting under which the shuffle files of a write go when it ends; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may go without it."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.conf.set("spark.checkpoint.dir", folder := "file://" + tempfile.mkdtemp(prefix="tracksmith-"))
    return folder


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Workspace:
    """Tables that cut the lineage of one run. They stay until dropped, or until the program ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path, self.n = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", 0
        atexit.register(self.close)

    def save(self, df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
        """narrow: a table of few bytes a row; it gets a few files a core at most, however many tasks a shuffle has."""
        self.n += 1
        if narrow:
            conf = self.spark.conf
            df = df.coalesce(max(2 * self.spark.sparkContext.defaultParallelism, int(conf.get("spark.sql.shuffle.partitions")) // 16))
        to = f"{self.path}/{self.n:03d}-{name}"
        conf, before = self.spark.conf, self.spark.conf.get(CLEANUP, "false")
        conf.set(CLEANUP, "true")
        try:
            df.write.parquet(to)
        finally:
            conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(to)
        out._saved_at = to
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            delete(self.spark, t._saved_at)

    def close(self) -> None:
        try:
            delete(self.spark, self.path)
        except Exception:  # the session has ended before the program
            pass


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it has at most so many rows; else joined by sorting, whatever size Spark expects of either side. df must be
    cheap to count."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else shuffled(df)


def shuffled(df: DataFrame) -> DataFrame:
    """df, whose joins broadcast neither side. Spark sizes a table by its files and the width of its types: it knows nothing of the rows
    that an explosion makes nor of the length of arrays, and would send the driver many times what it expects."""
    return df.hint("merge")


#: The same for rows of any width, by the sum of their bytes.
BROADCAST_BYTES = 16_000_000


def small_by_bytes(df: DataFrame, width: Column) -> DataFrame:
    """df, to be broadcast if its rows, each of so many bytes, take no more than BROADCAST_BYTES. df must be cheap to read."""
    total = df.agg(F.sum(width.cast("long"))).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def row_key(doc_id: Column, text: Column) -> Column:
    """A key for a row by its contents; repeated rows share it and get the same results."""
    return F.struct(doc_id.alias("id"), F.xxhash64(text).alias("a"), F.hash(F.coalesce(text, F.lit("\0"))).alias("b"))


def text_key(text: Column) -> Column:
    """A key of 96 bits for a text: equal texts share it, whatever rows carry them. Null has one of its own."""
    return F.struct(F.xxhash64(text).alias("a"), F.hash(F.coalesce(text, F.lit("\0"))).alias("b"))


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = "\t\n\x0b\x0c\r"


def split_words(text: Column, breaks: str, lower: bool = False) -> Column:
    """The words of a text as an array: what stands between blanks and the signs in breaks, A-Z in lower case if asked for.

    One pass maps signs one to one, then a plain split: regular expressions with negated ranges cost twenty times as much here.
    """
    marks = breaks + UPPER * lower
    plain = F.translate(text, marks, " " * len(breaks) + UPPER.lower() * lower) if marks else text
    return F.coalesce(F.array_remove(F.split(plain, " "), ""), F.array().cast("array<string>"))


def components(work: Workspace, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root, moved) for every node of edges (u, v): root is the smallest node that can be reached.

    Every round lets each node take the smallest label among itself and its neighbours, then the label of that label, so the
    rounds grow with the logarithm of the longest chain. Labels are saved each round, with whether they moved in it; only a count comes
    to the driver. A label that hasn't moved has been offered to its neighbours before, so it isn't offered again.
    Groupings have a partial step, so a node with very many edges meets no single task.
    """
    both = work.save(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges", narrow=True)
    labels = work.save(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("root"), F.lit(True).alias("moved")), "labels", narrow=True)
    for _ in range(max_rounds):
        near = (
            both.join(small(labels.where("moved").select(F.col("node").alias("v"), F.col("root").alias("r"))), "v")
            .select(F.col("u").alias("node"), "r", F.lit(None).alias("old"))
            .union(labels.select("node", F.col("root").alias("r"), F.col("root").alias("old")))
            .groupBy("node")
            .agg(F.min("r").alias("r"), F.max("old").alias("old"))
        )
        jump = labels.select(F.col("node").alias("r"), F.col("root").alias("rr"))
        root = F.least("r", F.coalesce("rr", "r"))
        new = near.join(small(jump), "r", "left").select("node", root.alias("root"), (root != F.col("old")).alias("moved"))
        new = work.save(new, "labels", narrow=True)
        work.drop(labels)
        labels = new
        if not labels.where("moved").limit(1).count():
            work.drop(both)
            return labels
    raise RuntimeError("components did not settle")
