"""Mixing sources to target weights by nested hash thresholds, without a sort of documents.

Every document has a hash; a source takes the documents whose hash lies below the source's threshold. The threshold comes from
histograms: words are summed by source and hash bucket, the bucket in which the budget runs out is found, and only this bucket's
rows are summed again by finer buckets, until it holds one hash value. Each level narrows a bucket 4,096 times, so three levels
are enough for 10^10 documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, Workspace, small, split_words

HASH_BITS = 63


def words(text):
    return F.size(split_words(text, BLANKS)).cast("long")


def source_targets(totals: DataFrame, weights: Sequence[float], share: float, max_repeat: float) -> DataFrame:
    """(src, source_size) to (src, source_size, target). Sources by code point, null last, take the weights in turn.

    The budget is share times all sizes. A source's target is its weight's part, at most max_repeat times its size; what is cut
    off goes to the others by weight, until none is above. One row a source: the only windows here go over that small table, in one
    task, so sources may be millions, but not as many as documents.
    """
    by_name, by_cap = Window.orderBy("src"), Window.orderBy("cap_rate", "src")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everyone = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    t = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    t = t.withColumn("cap", F.col("source_size") * float(max_repeat)).withColumn("cap_rate", F.col("cap") / F.col("weight"))
    t = t.withColumn("rate", (float(share) * F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    t = t.withColumn("open_rate", F.max(F.when(F.col("cap_rate") > F.col("rate"), F.col("rate"))).over(everyone))  # the first open one's
    return t.select("src", "source_size", F.when(F.col("cap_rate") > F.col("rate"), F.col("open_rate") * F.col("weight")).otherwise(F.col("cap")).alias("target"))


def thresholds(work: Workspace, narrow: DataFrame, weights: Sequence[float], share: float, max_repeat: float, bits: int) -> DataFrame:
    """narrow (src, h, size) to one row a source: src, source_size, target, copies (whole ones), cut (hashes below it go once more)."""
    totals = narrow.groupBy("src").agg(F.sum("size").alias("source_size"))
    plan = source_targets(totals, weights, share, max_repeat)
    plan = plan.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int"))
    plan = work.save(plan.withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")), "plan", narrow=True)
    state = work.save(plan.select("src", F.col("rest"), F.lit(0).cast("long").alias("prefix")), "state", narrow=True)
    shift = HASH_BITS
    while True:
        fine = max(0, shift - bits)
        of = narrow.join(small(state), "src").where((F.shiftrightunsigned("h", shift) if shift < HASH_BITS else F.lit(0).cast("long")) == F.col("prefix"))
        parts = of.groupBy("src", F.shiftrightunsigned("h", fine).alias("b")).agg(F.sum("size").alias("w"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.first("rest").alias("rest"))
        parts = parts.withColumn("cum", F.sum("w").over(Window.partitionBy("src").orderBy("b"))).where("cum > rest and cum - w <= rest")
        new = work.save(parts.select("src", (F.col("rest") - F.col("cum") + F.col("w")).alias("rest"), F.col("b").alias("prefix"), "w", "lo", "hi"), "state", narrow=True)
        shift = fine
        if shift == 0 or not new.where("lo != hi").limit(1).count():
            break
        work.drop(state)
        state = new
    # The last bucket has one hash: its rows go in if the sum comes nearer to the target with them.
    cut = new.select("src", F.when(F.col("w") - F.col("rest") < F.col("rest"), F.col("lo") + 1).otherwise(F.col("lo")).alias("cut"))
    return work.save(plan.join(cut, "src", "left").select("src", "source_size", "target", "copies", F.coalesce("cut", F.lit(0)).alias("cut")), "thresholds", narrow=True)


def mix_to_targets(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    max_repeat: float = 2.0,
    bits: int = 12,
    narrow_only: bool = False,
) -> DataFrame:
    """docs with size (words), source_size, target (the source's), copies (times that the mix takes the row) and taken (words).

    Columns of docs with these names are replaced. narrow_only keeps doc_id alone of docs, so texts are read once.
    Null and empty texts have size 0 and count as taken by hash like any other. A null source is a source of its own. Rows that
    repeat (doc_id, text) share a hash and are decided together. An empty table gives an empty result. The hash depends on
    doc_id and text only, so reruns agree. A target is missed by half of the words at the boundary hash at most, usually half a document.
    A hot source is summed in parts before the shuffle; its documents are never gathered.
    """
    work = Workspace(docs.sparkSession, "mixing")
    src = F.struct(F.col(source).isNull().alias("none"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("name"))
    keyed = docs.select(
        *([F.col(doc_id)] if narrow_only else [F.col(c) for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]),
        src.alias("_mix_src"),
        F.shiftrightunsigned(F.xxhash64(F.lit(7), F.col(doc_id), F.col(text)), 1).alias("_mix_h"),
        words(F.col(text)).alias("size"),
    )
    narrow = work.save(keyed if narrow_only else keyed.select("_mix_src", "_mix_h", "size"), "sizes")
    cuts = thresholds(work, narrow.select(F.col("_mix_src").alias("src"), F.col("_mix_h").alias("h"), "size"), weights, share, max_repeat, bits)
    out = (narrow if narrow_only else keyed).join(small(cuts.withColumnRenamed("src", "_mix_src").withColumnRenamed("copies", "_mix_n")), "_mix_src")
    out = out.withColumn("copies", F.col("_mix_n") + F.when(F.col("_mix_h") < F.col("cut"), 1).otherwise(0))
    return out.withColumn("taken", F.col("size") * F.col("copies")).drop("_mix_src", "_mix_h", "_mix_n", "cut")
