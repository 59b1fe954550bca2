"""MinHash near-duplicates by a signature-coordinate inverted join, confirmed on whole shingle sets.

1. Every text becomes its set of word shingles, a hash of that set and a signature of COORDINATES minima. Equal sets are one
   class from here on, however many documents carry it.
2. Each class is posted under its (coordinate, value) pairs. Two sets of the wanted similarity agree in at least `need`
   coordinates but for a chance of MISS, so a class with fewer values that anyone shares is skipped; the others are posted under
   their rarest values only, as many as must meet (prefix), and lists whose members hang together already are skipped.
3. Within a list, collisions are counted over whole signatures and pairs of `need` or more make candidates. A long list is cut
   into blocks, and each pair of blocks is a group of its own, so no task meets a whole hot list; a group reports a spanning
   forest, never its pairs.
4. The members of a candidate family meet once more with their full shingle sets, again by blocks, and links are confirmed by
   exact intersections. Connected components of the confirmed links are the answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import cache
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, components, shuffled, small
from .shingles import shingle_hashes

COORDINATES, MISS = 40, 1e-7
#: A group holds two blocks at most, each of about so many members and so many shingles.
BLOCK_MEMBERS, BLOCK_SHINGLES = 512, 1_000_000


@cache
def matches_needed(similarity: float, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The largest count of agreeing coordinates that sets of this similarity miss with a chance under miss."""
    below, t = 0.0, 0
    while t < coordinates and (below := below + comb(coordinates, t) * similarity**t * (1 - similarity) ** (coordinates - t)) < miss:
        t += 1
    return max(1, t)


def _permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(2024)
    return rng.integers(1, 2**64, k, np.uint64, endpoint=False) | np.uint64(1), rng.integers(0, 2**64, k, np.uint64, endpoint=False)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of 32-bit hashes, one a coordinate; long sets go in pieces."""
    low = np.full(len(a), 2**32 - 1, np.uint64)
    for at in range(0, len(shingles), 4096):
        x = shingles[at : at + 4096, None] * a + b
        x ^= x >> np.uint64(29)
        np.minimum(low, ((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).min(0), out=low)
    return low.astype(np.uint32)


def set_key(shingles: np.ndarray) -> bytes:
    return blake2b(shingles.tobytes(), digest_size=16).digest()


class Forest(dict):
    def find(self, x):
        root = x
        while (up := self.get(root, root)) != root:
            root = up
        while self.get(x, x) != root:
            self[x], x = root, self[x]
        return root

    def join(self, x, y) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self[max(x, y)] = min(x, y)


def link_group(forest: Forest, ids: list, near: Callable[[int], np.ndarray]) -> None:
    """Joins the members of a group that near (k to a mask of those linked with k) connects; members joined before are not compared."""
    roots = [forest.find(x) for x in ids]
    open_ = np.ones(len(ids), bool)
    families: dict = {}
    for k, r in enumerate(roots):
        families.setdefault(r, []).append(k)
    if len(families) == 1:
        return
    for start in range(len(ids)):
        if not open_[start]:
            continue
        queue = families.get(roots[start], [start])
        open_[queue] = False
        queue = list(queue)
        while queue and open_.any():
            k = queue.pop()
            for j in np.flatnonzero(near(k) & open_):
                if open_[j]:
                    forest.join(ids[k], ids[j])
                    more = families.get(roots[j], [j])
                    open_[more] = False
                    queue.extend(more)
        if not open_.any():
            return


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """The runs of rows with equal first n_keys columns, from batches sorted by them. One run is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            key = tuple(keys[:, lo])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def by_blocks(df: DataFrame, blocks, member, *keys) -> DataFrame:
    """Adds i <= j: the pairs of blocks that a row of a list with so many blocks belongs to. One block pairs with itself only."""
    own = F.pmod(F.xxhash64(F.lit(3), member), blocks).cast("int")
    with_others = F.transform(F.sequence(F.lit(0), blocks.cast("int") - 1), lambda x: F.struct(F.least(x, F.col("_own")).alias("i"), F.greatest(x, F.col("_own")).alias("j")))
    df = df.withColumn("_own", own)
    df = df.withColumn("_ij", F.explode(F.when(blocks == 1, with_others).otherwise(F.filter(with_others, lambda p: p.i != p.j))))
    return df.select(*keys, F.col("_ij.i").alias("i"), F.col("_ij.j").alias("j"), *[c for c in df.columns if c not in (*keys, "_own", "_ij")])


def describe(docs: DataFrame, doc_id: str, text: str, shingle: int, coordinates: int) -> DataFrame:
    """(doc_id, set_key, n, sig) of every row; set_key and sig are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _permutations(coordinates)
        memo: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                keys, ns, sigs = [], [], []
                for t in part.column(1):
                    s = shingle_hashes(t.as_py() or "", shingle, memo)
                    ns.append(len(s))
                    if len(s):
                        keys.append(set_key(s))
                        sigs.append(signature(s, a, b).view(np.int32))
                    else:
                        keys.append(None), sigs.append(None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.binary()), pa.array(ns, pa.int64()), pa.array(sigs, pa.list_(pa.int32()))], names=["doc_id", "set_key", "n", "sig"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, set_key binary, n long, sig array<int>")


def candidate_links(work: Workspace, classes: DataFrame, need: int, ratio: float, coordinates: int) -> DataFrame:
    """(u, v): a spanning forest of the pairs of classes that agree in need coordinates or more."""
    value = (F.col("c").cast("long") * F.lit(1 << 32)) + (F.col("v").cast("long") + F.lit(1 << 31))
    posts = classes.select("node", F.posexplode("sig").alias("c", "v")).select("node", value.alias("cv"))
    shared = work.save(posts.groupBy("cv").agg(F.count("*").alias("cnt")).where("cnt > 1"), "shared", narrow=True)
    met = posts.join(small(shared), "cv").groupBy("node").agg(F.collect_list(F.struct("cnt", "cv")).alias("met")).where(F.size("met") >= need)
    met = met.select("node", F.explode(F.slice(F.array_sort("met"), F.lit(1), F.size("met") - need + 1)).alias("p")).select("node", F.col("p.cv").alias("cv"), F.col("p.cnt").alias("cnt"))
    met = met.join(shuffled(classes.select("node", "n", "sig")), "node")
    listed = by_blocks(met, F.ceil(F.col("cnt") / BLOCK_MEMBERS).cast("int"), F.col("node"), "cv").select("cv", "i", "j", "node", "n", "sig")
    parts = int(work.spark.conf.get("spark.sql.shuffle.partitions"))
    listed = listed.repartition(parts, "cv", "i", "j").sortWithinPartitions("cv", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for g in groups(batches, 3):
            if g.num_rows < 2:
                continue
            ids, n = g.column("node").to_pylist(), g.column("n").to_numpy()
            sig = g.column("sig").combine_chunks().flatten().to_numpy().reshape(g.num_rows, coordinates)
            link_group(forest, ids, lambda k, s=sig, n=n: ((s == s[k]).sum(1) >= need) & (np.minimum(n, n[k]) >= ratio * np.maximum(n, n[k])))
        u = list(forest)
        for at in range(0, len(u), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(u[at : at + 50_000], pa.int64()), pa.array([forest.find(x) for x in u[at : at + 50_000]], pa.int64())], names=["u", "v"])

    return listed.mapInArrow(run, "u long, v long").where("u != v")


def confirmed_links(work: Workspace, docs: DataFrame, doc_id: str, text: str, members: DataFrame, shingle: int, similarity: Fraction) -> DataFrame:
    """members (node, set_key, root, first_id, n) to (u, v): a spanning forest of the nodes whose sets are similar enough."""
    sizes = members.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK_MEMBERS), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int")
    members = work.save(members.join(sizes.select("root", blocks.alias("blocks")), "root"), "members", narrow=True)
    # One long as the key, as a table of other keys takes 64 MB of the driver at once. Null ids share theirs with the smallest one;
    # the sets' keys tell them apart below.
    no_id = F.lit(-(1 << 63)).cast("long")
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), no_id).alias("id"), F.col(text).cast("string").alias("text"))
    members = members.select(F.coalesce("first_id", no_id).alias("id"), "root", "blocks", "node", "set_key")
    found = rows.join(small(members), "id").select("root", "blocks", "node", "set_key", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                out = []
                for r in batch.slice(at, 200).to_pylist():
                    s = shingle_hashes(r["text"] or "", shingle, memo)
                    if len(s) and set_key(s) == r["set_key"]:  # another text may carry the same id
                        out.append((r["root"], r["blocks"], r["node"], s.tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["root", "blocks", "node", "shingles"])

    listed = by_blocks(found.mapInArrow(sets, "root long, blocks int, node long, shingles binary"), F.col("blocks"), F.col("node"), "root")
    parts = int(work.spark.conf.get("spark.sql.shuffle.partitions"))
    listed = listed.select("root", "i", "j", "node", "shingles").repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j")
    num, den = similarity.numerator, similarity.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, 3):
            by_node = dict(zip(g.column("node").to_pylist(), g.column("shingles").to_pylist(), strict=True))
            if len(by_node) < 2:
                continue
            ids = list(by_node)
            each = [np.frombuffer(x, np.uint64) for x in by_node.values()]
            n = np.array([len(x) for x in each])
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])
            values, at = np.unique(np.concatenate(each), return_inverse=True)
            mark = np.zeros(len(values), np.int64)

            def near(k, at=at, mark=mark, starts=starts, n=n):
                own = at[starts[k] : starts[k] + n[k]]
                mark[own] = 1
                both = np.add.reduceat(mark[at], starts)
                mark[own] = 0
                return both * den >= num * (n + n[k] - both)

            forest = Forest()
            link_group(forest, ids, near)
            u = [x for x in forest if forest.find(x) != x]
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array([forest.find(x) for x in u], pa.int64())], names=["u", "v"])

    return listed.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, coordinates: int = COORDINATES) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links of the similarity or more) and kept, one row a row.

    Words are runs of anything but ASCII blanks, A-Z in lower case; a text with fewer words than a shingle is one shingle. Null
    and blank texts have no shingles, link with nothing and are kept. Rows with a null id link like others, but take a null
    component_id if no linked row has an id. Repeated ids are one document for component_id; all rows that carry it are kept
    together. An empty table gives no rows; other columns aren't looked at.
    """
    work = Workspace(docs.sparkSession, "near-dedup")
    exact = Fraction(str(similarity))
    need = matches_needed(similarity, coordinates)
    rows = work.save(describe(docs, doc_id, text, shingle, coordinates), "signatures")
    classes = rows.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = work.save(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # from here on a class is one long
    links = work.save(candidate_links(work, classes, need, similarity, coordinates), "candidates")
    families = components(work, links)
    members = small(families.select("node", "root")).join(classes.select("set_key", "node", "first_id", "n"), "node").select("node", "set_key", "root", "first_id", "n")
    confirmed = work.save(confirmed_links(work, docs, doc_id, text, members, shingle, exact), "links")
    final = components(work, confirmed)
    named = classes.select("node", "set_key", "first_id").join(small(final.select("node", "root")), "node", "left")
    named = work.save(named.select("set_key", "first_id", F.coalesce("root", "node").alias("root")), "named", narrow=True)
    joint = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    ids = work.save(named.join(shuffled(joint), "root").select("set_key", "component_id"), "ids", narrow=True)
    work.drop(classes, links, families, confirmed, final, named)  # the signatures and the ids are read by the result
    out = rows.select("doc_id", "set_key", "n").join(small(ids), "set_key", "left")
    comp = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without the rows of documents whose component has a smaller id; rows with a null id stay."""
    verdict = near_duplicates(docs, doc_id=doc_id, text=text, shingle=shingle, similarity=similarity)
    gone = verdict.where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col(doc_id).cast("long") == F.col("_gone"), "left_anti")
