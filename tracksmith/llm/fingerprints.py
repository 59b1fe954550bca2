"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Each 5-word shingle is hashed once; the hash's high bits choose one of BINS bins, which keeps its smallest hash. An empty bin
copies the bin that a fixed random sequence of its own reaches first among the filled ones. A fingerprint stores the low BITS
bits of each bin. Two fingerprints agree in a bin by chance with 2^-BITS; likeness takes this off.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace
from .shingles import shingle_hashes

BINS, BITS, SHINGLE = 256, 4, 5
TRIES = 64


def _draws(first: int, count: int, bins: int) -> np.ndarray:
    """Rows first.. of the sequences: for each bin the candidate bins in order of trial."""
    out = np.empty((count, bins), np.int64)
    for k in range(count):
        out[k] = np.random.default_rng([99, bins, first + k]).integers(0, bins, bins)
    return out


class Sketcher:
    def __init__(self, bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE):
        self.bins, self.bits, self.shingle, self.table, self.memo = bins, bits, shingle, _draws(0, TRIES, bins), {}

    def bins_of(self, text: str) -> np.ndarray | None:
        h = shingle_hashes(text, self.shingle, self.memo)
        if not len(h):
            return None
        at = (h >> np.uint64(64 - 16)).astype(np.int64) * self.bins >> 16
        low = np.full(self.bins, np.iinfo(np.uint64).max, np.uint64)
        first = np.flatnonzero(np.diff(at, prepend=-1))  # h is sorted: a bin's first hash is its smallest
        low[at[first]] = h[first]
        full = np.zeros(self.bins, bool)
        full[at[first]] = True
        if not full.all():
            empty, k = np.flatnonzero(~full), 0
            while len(empty):
                if k + TRIES > len(self.table):
                    self.table = np.vstack([self.table, _draws(len(self.table), len(self.table), self.bins)])
                cand = self.table[k : k + TRIES, empty]
                ok = full[cand]
                hit = ok.any(0)
                low[empty[hit]] = low[cand[ok.argmax(0), np.arange(len(empty))][hit]]
                empty, k = empty[~hit], k + TRIES
        return low

    def pack(self, text: str) -> bytes:
        """Packed low bits; no bytes for a text without words."""
        low = self.bins_of(text)
        if low is None:
            return b""
        digits = (low & np.uint64((1 << self.bits) - 1)).astype(np.uint8)
        return np.packbits(np.unpackbits(digits[:, None], axis=1)[:, 8 - self.bits :].ravel()).tobytes()

    def likeness(self, a: bytes, b: bytes) -> float:
        """Estimated share of common shingles, 0 to 1. Two texts without words are alike, one such is like no other."""
        if not a or not b:
            return float(a == b)
        x, y = (np.unpackbits(np.frombuffer(v, np.uint8))[: self.bins * self.bits].reshape(self.bins, self.bits) for v in (a, b))
        chance = 2.0**-self.bits
        return float(min(1.0, max(0.0, ((x == y).all(1).mean() - chance) / (1 - chance))))


def _row(s: Sketcher, doc_id, text: str, after: str, prints: dict) -> dict:
    half = len(text) // 2
    edited = text[: len(text) - half] + after[:half]
    own = prints.get("own") if prints.get("for") is text else s.pack(text)
    nxt, changed = s.pack(after), s.pack(edited)
    prints.update({"for": after, "own": nxt})
    return {"doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(), "fingerprint": own.hex(), "edited_fingerprint": changed.hex(), "near_edited": s.likeness(own, changed), "near_next": s.likeness(own, nxt)}


ROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
ENDS = [("head_id", pa.int64()), ("head_hash", pa.int64()), ("head", pa.string()), ("tail", pa.string())]
SPARK_ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """One row a document: fingerprints (hex) of the text and of its edited text, and their likeness.

    The edited text has its last floor(n/2) code points replaced by as many of the first of the next document's, in descending
    doc_id; ties follow a hash of the text, null ids come last, and the first document follows the last. Null texts are empty
    ones. Repeated rows follow one another. An empty table gives no rows; other columns are not looked at.

    Texts are dealt once, by ranges of doc_id, and streamed in order. What crosses a range's end are two texts a range, joined by
    the range's first id; only those ids are ordered in one place.
    """
    work = Workspace(docs.sparkSession, "fingerprints")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    order = [F.desc_nulls_last("doc_id"), F.asc("h")]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = pa.schema([*ROW, *ENDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, prints, last, head = Sketcher(bins, bits, shingle), {}, None, None
        for batch in batches:
            ids, texts, hashes = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
            out = []
            for k in range(batch.num_rows):
                one = texts[k].as_py()
                if head is None:
                    head = (ids[k], hashes[k].as_py(), one)
                if last is not None:
                    out.append(_row(s, *last, one, prints))
                last = (ids[k], one)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if last is not None:
            yield pa.RecordBatch.from_pylist([{"doc_id": last[0], "tail": last[1], "head_id": head[0], "head_hash": head[1], "head": head[2]}], schema)

    saved = work.save(dealt.mapInArrow(run, SPARK_ROW + ", head_id long, head_hash long, head string, tail string"), "rows")
    ends = saved.where("tail is not null")
    keys = ends.select("head_id", "head_hash", F.col("doc_id").alias("tail_id"))
    chain = Window.orderBy(F.desc_nulls_last("head_id"), F.asc("head_hash"), F.desc_nulls_last("tail_id"))
    everyone = chain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = F.struct("head_id", "head_hash", "tail_id")
    nexts = keys.select(at.alias("here"), F.coalesce(F.lead(at).over(chain), F.first(at).over(everyone)).alias("next"))
    here = ends.select(F.struct("head_id", "head_hash", F.col("doc_id").alias("tail_id")).alias("here"), "doc_id", "tail", "head")
    pairs = here.select("here", "doc_id", "tail").join(nexts, "here")
    pairs = pairs.join(here.select(F.col("here").alias("next"), F.col("head").alias("after")), "next").select("doc_id", "tail", "after")

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Sketcher(bins, bits, shingle)
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([_row(s, r["doc_id"], r["tail"], r["after"], {})], ROW)

    return saved.where("tail is null").select(*ROW.names).unionByName(pairs.mapInArrow(stitch, SPARK_ROW))
