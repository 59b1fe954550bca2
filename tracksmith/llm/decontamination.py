"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every window of SPAN item words has one fingerprint: the smallest hash among its K-word grams, the leftmost if there are several.
A document keeps the smallest gram hash of each window of its own, so any window that it shares with an item shares the
fingerprint too. Documents that share one are looked at once more: each place of a shared gram is extended to the item windows
that have the gram there, word by word. An item of fewer words than SPAN is one window of its own length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, small, small_by_bytes, split_words, text_key

#: Words are runs of ASCII digits and letters and of everything beyond ASCII; the other ASCII signs part them.
BREAKS = "".join(c for c in map(chr, range(128)) if not c.isalnum())
SPAN, K = 13, 6


def words_of(text: Column) -> Column:
    return split_words(text, BREAKS, lower=True)


def _shifted(a: str, b: str, by: int, f) -> Column:
    """f of each element of a and the element of b that stands `by` further on."""
    n = F.greatest(F.least(F.size(a), F.size(b) - by), F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1 + by), n), f)


def with_grams(df: DataFrame, words: str, k: int, out: str) -> DataFrame:
    """Adds the hashes of k-word grams in order. Hashes of grams double in length; what k needs is put together."""
    df = df.withColumn(f"{out}_p1", F.transform(words, lambda w: F.xxhash64(w)))
    have, done, length, made = 1, None, 0, [f"{out}_p1"]
    while True:
        if k & have:
            part = f"{out}_p{have}"
            if done is None:
                done, length = part, have
            else:
                df = df.withColumn(f"{out}_c{have}", _shifted(done, part, length, lambda x, y: F.xxhash64(x, y)))
                done, length = f"{out}_c{have}", length + have
                made.append(done)
        if have * 2 > k:
            break
        df = df.withColumn(f"{out}_p{have * 2}", _shifted(f"{out}_p{have}", f"{out}_p{have}", have, lambda x, y: F.xxhash64(x, y)))
        have *= 2
        made.append(f"{out}_p{have}")
    return df.withColumnRenamed(done, out).drop(*[c for c in made if c != done])


def with_minima(df: DataFrame, grams: str, w: int, out: str) -> DataFrame:
    """Adds the smallest of every w neighbours, by minima over doubling widths."""
    have, at, made = 1, grams, []
    while have * 2 <= w:
        df = df.withColumn(f"{out}_m{have * 2}", _shifted(at, at, have, lambda x, y: F.least(x, y)))
        have, at = have * 2, f"{out}_m{have * 2}"
        made.append(at)
    if have < w:
        df = df.withColumn(f"{out}_m", _shifted(at, at, w - have, lambda x, y: F.least(x, y)))
        at = f"{out}_m"
        made.append(at)
    return df.withColumn(out, F.array_distinct(at)).drop(*made)


def gram_length(span: int, k: int) -> int:
    return min(k, span)


def item_windows(items: DataFrame, item_id: str, text: str, span: int, k: int) -> DataFrame:
    """(item, w): the windows of the items as arrays of words."""
    rows = items.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text).cast("string")).alias("words")).where("size(words) > 0")
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - (span - 1), F.lit(1))), lambda i: F.slice("words", i, span))
    return rows.select("item", F.explode(many).alias("w")).distinct()


def window_prints(windows: DataFrame, spans: list[int], k: int) -> DataFrame:
    """(w) to (w, span, print, off): each distinct window with its fingerprint and where that stands in it."""
    out = None
    for span in spans:
        part = with_grams(windows.where(F.size("w") == span), "w", gram_length(span, k), "g")
        part = part.select("w", F.lit(span).alias("span"), F.array_min("g").alias("print"), (F.array_position("g", F.array_min("g")) - 1).cast("int").alias("off"))
        out = part if out is None else out.unionByName(part)
    return out


def item_hits(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN, k: int = K) -> DataFrame:
    """One row a row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in an occurrence of an item window. contaminated: a hit, and at least a twentieth of the words.
    Null and empty texts have no words and no hits; items without words are left out; equal items of several ids count each; an
    item without an id gives hits but isn't counted. Equal texts get equal results, whatever their ids, and are extended once.
    Empty tables on either side give no hits. Other columns aren't looked at.
    """
    body = F.col(text).cast("string")
    found = hits_by_text(docs.select(body.alias("text")), benchmark, item_id, item_text, span, k)
    base = docs.select(F.col(doc_id).alias("doc_id"), text_key(body).alias("key"), F.size(words_of(body)).cast("long").alias("n_words"))
    nothing = {"n_hit": F.lit(0).cast("long"), "n_items": F.lit(0).cast("long"), "items_sha256": F.sha2(F.lit(""), 256)}
    if found is None:
        out = base.withColumns(nothing)
    else:
        out = base.join(found, "key", "left").withColumns({c: F.coalesce(c, x) for c, x in nothing.items()})
    contaminated = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", contaminated.alias("contaminated"))


def hits_by_text(docs: DataFrame, benchmark: DataFrame, item_id: str, item_text: str, span: int, k: int) -> DataFrame | None:
    """docs (text) to (key, n_hit, n_items, items_sha256, whole: a window of span words occurs), a row for each text with hits, to be
    broadcast if they are few; None if no item has words."""
    work = Workspace(docs.sparkSession, "decontamination")
    body = F.col("text")
    windows = work.save(item_windows(benchmark, item_id, item_text, span, k), "windows", narrow=True)
    spans = sorted(r[0] for r in windows.select(F.size("w")).distinct().collect())  # span lengths at most
    if not spans:
        return None
    prints = work.save(window_prints(windows.select("w").distinct(), spans, k).withColumn("wid", F.xxhash64(F.concat_ws(" ", "w"))), "prints", narrow=True)

    def with_all_grams(df: DataFrame) -> DataFrame:
        df = df.withColumn("words", words_of(F.col("body")))
        for g in sorted({gram_length(s, k) for s in spans}):
            df = with_grams(df, "words", g, f"g{g}")
        return df

    # Which documents share a fingerprint, and which fingerprints.
    rows = with_all_grams(docs.select(text_key(body).alias("key"), body.alias("body")).where("body is not null")).drop("body", "words")
    for s in spans:
        g = gram_length(s, k)
        rows = with_minima(rows, f"g{g}", s - g + 1, f"f{s}")
    # Outer explosions: the optimiser puts a filter below the others, which would work out the arrays twice.
    kept = rows.select("key", F.explode_outer(F.array_distinct(F.concat(*[f"f{s}" for s in spans]))).alias("print"))
    wanted = prints.select("print").distinct()
    shared = kept.join(small(wanted), "print").groupBy("key").agg(F.collect_set("print").alias("prints"))
    shared = work.save(shared, "shared", narrow=True)

    # The places of these grams, extended to windows.
    rows = docs.select(text_key(body).alias("key"), body.alias("body")).where("body is not null")
    rows = rows.join(small_by_bytes(shared, 40 + 8 * F.size("prints")), "key").dropDuplicates(["key"])  # copies of a text are extended once
    rows = with_all_grams(rows)
    places = F.concat(*[F.filter(F.transform(f"g{g}", lambda h, i: F.struct(h.alias("print"), i.alias("p"))), lambda x: F.array_contains("prints", x["print"])) for g in sorted({gram_length(s, k) for s in spans})])
    rows = rows.withColumn("place", F.explode_outer(places)).withColumn("from", F.greatest(F.col("place.p") - (span - 1), F.lit(0)))
    rows = rows.select("key", F.col("place.print").alias("print"), F.col("place.p").alias("p"), "from", F.slice("words", F.col("from") + 1, F.lit(2 * span)).alias("near"))
    start = F.col("p") - F.col("off")
    same = F.when((start >= F.col("from")) & (start >= 0), F.slice("near", F.greatest(start - F.col("from") + 1, F.lit(1)), F.col("span")) == F.col("w")).otherwise(False)
    right = small(prints.withColumnRenamed("print", "print_r"))
    hits = rows.join(right, (F.col("print") == F.col("print_r")) & same).select("key", start.alias("s"), (start + F.col("span")).alias("e"), "wid")
    hits = work.save(hits, "hits")

    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("s", "e"))),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(F.greatest(acc.end, x.e).alias("end"), (acc.n + F.greatest(x.e - F.greatest(acc.end, x.s), F.lit(0))).alias("n")),
        lambda acc: acc.n.cast("long"),
    )
    n_hit = hits.groupBy("key").agg(covered.alias("n_hit"), F.max((F.col("e") - F.col("s")) == span).alias("whole"))
    of = windows.select(F.xxhash64(F.concat_ws(" ", "w")).alias("wid"), "item").where("item is not null").distinct()
    items = hits.select("key", "wid").distinct().join(small(of), "wid").select("key", "item").groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = n_hit.join(items, "key", "left").select(
        "key", "n_hit", F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "items"), F.lit("")), 256).alias("items_sha256"), "whole",
    )
    # Rows of one width: where they are few, the documents stay where they are, however many of them share a text.
    return small_by_bytes(work.save(found, "found", narrow=True), F.lit(120))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN, k: int = K) -> DataFrame:
    """docs without the rows that hold a window of span item words, however long their texts are, or that item_hits calls contaminated.

    An item shorter than span may be an ordinary phrase, so it alone drops a text only if that is contaminated. Rows are judged by
    their texts: repeated and null ids change nothing. Null and empty texts stay; with an empty benchmark all rows do.
    """
    body = F.col(text).cast("string")
    found = hits_by_text(docs.select(body.alias("text")), benchmark, item_id, item_text, span, k)
    if found is None:
        return docs
    told = docs.withColumn("_key", text_key(body)).join(found.select(F.col("key").alias("_hit_key"), F.col("n_hit").alias("_hits"), F.col("whole").alias("_whole")), F.col("_key") == F.col("_hit_key"), "left")
    # The words are counted for texts with hits alone.
    goes = F.when(F.col("_hits").isNull(), False).otherwise(F.col("_whole") | (20 * F.col("_hits") >= F.size(words_of(body))))
    return told.where(~goes).drop("_key", "_hit_key", "_hits", "_whole")
