"""Secret scans with an incremental ledger of blobs, in DataFrame functions only.

Every version of every file is addressed by the SHA-256 of its text. The ledger has a row for each (blob, rules) pair that was
scanned, findings or not; a scan reads only the pairs that the ledger lacks, once each, adds them to the ledger, and joins the
findings that the ledger holds back to all paths. Only texts that some rule may match are dealt out; of the rest, only addresses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace

# Kind, pattern (Java syntax), group whose length counts, least length; in the order of listing.
BASE_RULES = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
# Kinds that go beyond the base ones.
MORE_RULES = (
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("pem", r"-----BEGIN\x20(?:[A-Z]+\x20)*PRIVATE\x20KEY-----", 0, 27),
)
RULES = BASE_RULES + MORE_RULES
RULES_VERSION = "base3+more2/1"
# What a match of the rules above must hold, cheaper to look for than the rules themselves.
NEEDED = {
    "assign": r"""(?i:passw(?:or)?d|secret|token|api_?key)["']?\x20*[:=]""", "access": "AKIA[A-Z0-9]{12}", "hex": "[0-9a-f]{32}",
    "github": "gh[pousr]_[A-Za-z0-9]{36}", "pem": "-----BEGIN",
}

LEDGER_SCHEMA = "blob binary, rules string, findings array<struct<start:int,rank:int,kind:string,end:int>>"


def any_rule(rules) -> str:
    """A pattern that every text with a match of the rules matches; one pass rules most texts out."""
    known = {r[0]: r for r in RULES}
    return "|".join(f"(?:{NEEDED[r[0]] if known.get(r[0]) == tuple(r) else r[1]})" for r in rules)


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def scan_blobs(blobs: DataFrame, rules=RULES, version: str = RULES_VERSION) -> DataFrame:
    """(blob, body), one row a blob, to the ledger rows of those with findings.

    A match's place comes from the lengths of the pieces between matches: one window sum a blob and kind, over numbers only, so
    a text with very many matches costs n log n. Lengths are in code points.
    """
    hit, found = blobs, []
    for rank, (kind, pattern, group, least) in enumerate(rules):
        pieces, whole = F.split("body", pattern, -1), F.regexp_extract_all("body", F.lit(pattern), 0)
        counted = F.regexp_extract_all("body", F.lit(pattern), group) if group else whole
        spans = F.zip_with(
            F.transform(pieces, lambda x: F.length(x)),
            F.zip_with(whole, counted, lambda a, b: F.struct(F.length(a).alias("n"), F.length(b).alias("c"))),
            lambda gap, m: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), gap.alias("gap"), m.n.alias("n"), (m.c >= least).alias("ok")),
        )
        found.append(F.when(F.col("body").rlike(pattern), F.transform(spans, lambda x, i: F.struct(i.alias("i"), x.rank.alias("rank"), x.kind.alias("kind"), x.gap.alias("gap"), x.n.alias("n"), x.ok.alias("ok")))))
    none = F.array().cast("array<struct<i:int,rank:int,kind:string,gap:int,n:int,ok:boolean>>")
    rows = hit.select("blob", F.explode(F.concat(*[F.coalesce(x, none) for x in found])).alias("m")).select("blob", "m.*").where("n is not null")
    upto = Window.partitionBy("blob", "rank").orderBy("i")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(upto).cast("int")).where("ok")
    rows = rows.select("blob", F.struct((F.col("end") - F.col("n")).alias("start"), "rank", "kind", "end").alias("f"))
    return rows.groupBy("blob").agg(F.array_sort(F.collect_list("f")).alias("findings")).select("blob", F.lit(version).alias("rules"), "findings")


EMPTY = "array<struct<start:int,rank:int,kind:string,end:int>>"


def scan_new(versions: DataFrame, *, body: str = "text", ledger: DataFrame | None = None, rules=RULES, version: str = RULES_VERSION, work: Workspace | None = None) -> DataFrame:
    """The rows that the ledger lacks for the blobs of versions under this rule version: scanned once each, however many rows carry
    them, with empty findings where there are none."""
    work = work or Workspace(versions.sparkSession, "secrets")
    text = F.coalesce(F.col(body).cast("string"), F.lit(""))
    known = None if ledger is None else ledger.where(F.col("rules") == version).select("blob")

    def lacking(df: DataFrame) -> DataFrame:
        return df if known is None else df.join(known, "blob", "left_anti")

    # Copies are reduced before the shuffle, and texts that no rule can match don't reach it.
    suspects = lacking(versions.where(text.rlike(any_rule(rules))).select(blob_of(text).alias("blob"), text.alias("body")))
    hits = work.save(scan_blobs(suspects.groupBy("blob").agg(F.first("body").alias("body")), rules, version), "hits")
    # A blob without findings has a row too: it was seen.
    seen = lacking(versions.select(blob_of(text).alias("blob")).distinct())
    return seen.join(hits.select("blob", "findings"), "blob", "left").select("blob", F.lit(version).alias("rules"), F.coalesce("findings", F.array().cast(EMPTY)).alias("findings"))


def with_findings(versions: DataFrame, ledger: DataFrame, *, body: str = "text", version: str = RULES_VERSION) -> DataFrame:
    """versions with blob and findings, as the ledger has them; own columns of these names are replaced."""
    own = [c for c in versions.columns if c not in ("blob", "findings")]
    found = ledger.where((F.col("rules") == version) & (F.size("findings") > 0)).select("blob", "findings").dropDuplicates(["blob"])
    out = versions.select(*own, blob_of(F.coalesce(F.col(body).cast("string"), F.lit(""))).alias("blob")).join(found, "blob", "left")
    return out.select(*own, "blob", F.coalesce("findings", F.array().cast(EMPTY)).alias("findings"))


def scan_versions(versions: DataFrame, *, body: str = "text", ledger: DataFrame | None = None, rules=RULES, version: str = RULES_VERSION, work: Workspace | None = None) -> tuple[DataFrame, DataFrame]:
    """versions (any columns, one row a version of a path) to (versions with blob and findings, new ledger rows).

    ledger holds earlier rows; blobs that it has for this rule version aren't scanned. rules are (kind, Java pattern, group whose
    length counts, least length); give other rules another version. Null and empty bodies are one blob without findings. Repeated
    rows each get the findings. Own columns named blob or findings are replaced.
    """
    work = work or Workspace(versions.sparkSession, "secrets")
    new = work.save(scan_new(versions, body=body, ledger=ledger, rules=rules, version=version, work=work), "new")
    return with_findings(versions, new if ledger is None else new.unionByName(ledger.select(*new.columns)), body=body, version=version), new


class Ledger:
    """A ledger kept as Parquet in a folder that all machines reach. Every scan adds the pairs that it lacked."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame | None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return None
        return self.spark.read.schema(LEDGER_SCHEMA).parquet(self.path)

    def scan(self, versions: DataFrame, *, body: str = "text", rules=RULES, version: str = RULES_VERSION) -> DataFrame:
        """versions with blob and findings, read from the ledger after what it lacked was scanned and added."""
        scan_new(versions, body=body, ledger=self.rows(), rules=rules, version=version).write.mode("append").parquet(self.path)
        return with_findings(versions, self.rows(), body=body, version=version)


def joined(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f.kind, f.start.cast("string"), f.end.cast("string"))), ",")


def digest_columns(findings: Column) -> dict[str, Column]:
    kinds = [r[0] for r in BASE_RULES]

    def count(kind: str) -> Column:
        return F.size(F.filter(findings, lambda f: f.kind == kind)).cast("long")

    out = {f"n_{k}": count(k) for k in kinds}
    return out | {"base_sha256": F.sha2(joined(F.filter(findings, lambda f: f.kind.isin(kinds))), 256), "spans": joined(findings)}
