"""Quality classifier: random-indexing word vectors pooled per document, a two-layer numpy network, calibrated probabilities.

A word is known by its spelling, hashed into WORD_SLOTS slots, and by its shape (letters, capitals, digits and marks by class),
hashed into SHAPE_SLOTS slots. Every slot has a sparse random index vector, and a word's index vector is the sum of its two.
Over the training texts each slot gathers the index vectors of the words around its uses; what it has gathered beyond the average
word's surroundings is its context vector. A word vector is the index vectors of both slots plus their context vectors. A document
is pooled as the mean of its words' vectors, their deviation, and the mean product of neighbours' vectors, which tells whether
words stand where they are expected. Everything is learned here.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

WORD_SLOTS, SHAPE_SLOTS, DIM, NONZERO, WINDOW = 32_768, 2_048, 64, 6, 2
SLOTS, POOLS = WORD_SLOTS + SHAPE_SLOTS, 3
#: A slot with so many uses has half the weight that its context vector can have.
HALF_USES = 5.0
#: The classifier is fitted on so many labelled rows at most, those with the smallest hashes.
MAX_LABELLED = 8_000
HIDDEN, EPOCHS, RATE, DECAY = 32, 40, 3e-3, 3e-3
#: Words of a text that are looked at together; longer ones go in pieces.
PIECE = 20_000

_SHAPE = bytes(b"a"[0] if 97 <= b <= 122 or b >= 128 else b"A"[0] if 65 <= b <= 90 else b"0"[0] if 48 <= b <= 57 else b for b in range(256))


def index_vectors(seed: int = 11) -> np.ndarray:
    """Sparse ternary vectors of length 1, a row a slot: half of the nonzero entries above 0, half below."""
    rng, out = np.random.default_rng(seed), np.zeros((SLOTS, DIM), np.float32)
    at = rng.random((SLOTS, DIM)).argpartition(NONZERO, axis=1)[:, :NONZERO]
    np.put_along_axis(out, at, (np.where(np.arange(NONZERO) % 2, -1, 1) / np.sqrt(NONZERO)).astype(np.float32)[None], axis=1)
    return out


class _Slots(dict):
    def __init__(self, first: int, slots: int):
        super().__init__()
        self.first, self.slots = first, slots

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        value = self[word] = self.first + crc32(word) % self.slots
        return value


def slots_of(text: str, memo: dict) -> np.ndarray:
    """Two rows, the slots of the words' spellings and of their shapes, over the whole text."""
    if "w" not in memo:
        memo["w"], memo["s"] = _Slots(0, WORD_SLOTS), _Slots(WORD_SLOTS, SHAPE_SLOTS)
    raw = text.encode()
    words, shapes = raw.split(), raw.translate(_SHAPE).split()
    return np.stack([np.fromiter(map(memo["w"].__getitem__, words), np.int64, len(words)), np.fromiter(map(memo["s"].__getitem__, shapes), np.int64, len(shapes))])


def gather_context(slots: np.ndarray, index: np.ndarray, into: np.ndarray, uses: np.ndarray) -> None:
    """Adds to both slots of each word the index vectors of its neighbours, and counts their uses."""
    for at in range(0, slots.shape[1], PIECE):
        begin, end = max(0, at - WINDOW), at + PIECE + WINDOW  # with the neighbours of the words at the ends
        unit = index[slots[:, begin:end]].sum(0)
        near = np.zeros_like(unit)
        for d in range(1, WINDOW + 1):
            if len(unit) > d:
                near[d:] += unit[:-d]
                near[:-d] += unit[d:]
        near = near[at - begin : at - begin + PIECE]
        for row in slots[:, at : at + PIECE]:
            np.add.at(into, row, near)
            np.add.at(uses, row, 1)


def word_vectors(context: np.ndarray, uses: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Index vectors plus context vectors: what a slot gathered less what as many average words would have, scaled to a length that
    grows to 1 with its uses."""
    average = context[:WORD_SLOTS].sum(0) / max(1.0, uses[:WORD_SLOTS].sum())
    out = np.empty_like(index)
    for at in range(0, SLOTS, 2_048):  # in pieces, for the driver's memory
        own, n = context[at : at + 2_048] - uses[at : at + 2_048, None] * average, uses[at : at + 2_048, None]
        length = np.linalg.norm(own, axis=1, keepdims=True)
        out[at : at + 2_048] = index[at : at + 2_048] + own / np.maximum(length, 1e-9) * np.sqrt(n / (n + HALF_USES))
    return out


def pooled(text: str, vectors: np.ndarray, memo: dict) -> np.ndarray:
    """The features of a text; zeros if it has no words."""
    slots = slots_of(text, memo)
    n, last = slots.shape[1], None
    sums = np.zeros((POOLS, DIM))
    for at in range(0, n, PIECE):
        v = vectors[slots[:, at : at + PIECE]].sum(0)
        sums[0] += v.sum(0, dtype=np.float64)
        sums[1] += np.einsum("ij,ij->j", v, v)
        sums[2] += np.einsum("ij,ij->j", v[1:], v[:-1]) + (0 if last is None else last * v[0])
        last = v[-1]
    mean = sums[0] / max(1, n)
    return np.concatenate([mean, np.sqrt(np.maximum(sums[1] / max(1, n) - mean * mean, 0)), sums[2] / max(1, n - 1)]).astype(np.float32)


#: Temperatures that are tried.
GRID = np.geomspace(0.01, 100, 161)


class Network:
    """Two layers, trained by Adam on the log loss with decay. The temperature is the best of a grid on a part kept from training,
    against targets short of 0 and 1 by what that part's size leaves open, so that it is finite even if the classes part without error."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 5, members: int = 5):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        rng = np.random.default_rng(seed)
        part = rng.permutation(len(x))
        held, fit = part[: max(1, len(x) // 5)], part[max(1, len(x) // 5) :] if len(x) > 1 else part
        z = self._scaled(x)
        self.layers = [self._train(z[fit], y[fit], np.random.default_rng(seed + 1 + m)) for m in range(members)]
        self.temperature = 1.0
        raw = self._logit(z[held])
        ones = y[held].sum()
        wanted = np.where(y[held] > 0.5, (ones + 1) / (ones + 2), 1 / (len(held) - ones + 2))
        z = np.clip(raw[None] / GRID[:, None], -500, 500)
        self.temperature = float(GRID[(np.logaddexp(0, z) - wanted * z).mean(1).argmin()])

    def _scaled(self, x):
        return np.clip((x - self.mean) / self.scale, -6, 6)

    @staticmethod
    def _train(x, y, rng):
        p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(EPOCHS):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
                step += 1
                h = np.tanh(x[at] @ p[0] + p[1])
                d = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - y[at]) / len(at)
                dh = d[:, None] * p[2] * (1 - h * h)
                grads = [x[at].T @ dh + DECAY * p[0], dh.sum(0), h.T @ d + DECAY * p[2], np.array([d.sum()])]
                for a, g, mm, vv in zip(p, grads, m, v, strict=True):
                    mm += 0.1 * (g - mm)
                    vv += 0.001 * (g * g - vv)
                    a -= RATE * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
        return p

    def _logit(self, z):
        return np.mean([np.tanh(z @ p[0] + p[1]) @ p[2] + p[3] for p in self.layers], axis=0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logit(self._scaled(x)) / self.temperature, -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def fit(work: Workspace, docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_labelled: int = MAX_LABELLED):
    """(word vectors, network) from labelled rows that are not held out. Texts stay on the executors: context sums and features come here."""
    lab = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(label).cast("double").alias("_y")).where(~held_out(F.col("_id")))
    chosen = lab.groupBy("_id").agg(F.min("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    train = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t")).join(F.broadcast(chosen), "_id").select("_y", "_t")
    train = work.save(train, "training")
    index = index_vectors()
    shared_index = docs.sparkSession.sparkContext.broadcast(index)  # of fixed size

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, into, uses, index = {}, np.zeros((SLOTS, DIM)), np.zeros(SLOTS), shared_index.value
        for batch in batches:
            for t in batch.column(0):
                gather_context(slots_of(t.as_py(), memo), index, into, uses)
        at = np.flatnonzero(uses)
        if len(at):
            flat = pa.FixedSizeListArray.from_arrays(pa.array(into[at].ravel()), DIM).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(uses[at]), flat], names=["slot", "uses", "v"])

    # A table of fixed size a task: so few tasks, each with many rows.
    few = train.select("_t").repartition(max(1, -(-max_labelled // 2_000)))
    sums = few.mapInArrow(contexts, "slot long, uses double, v array<double>").groupBy("slot").agg(F.sum("uses").alias("uses"), F.array(*[F.sum(F.col("v")[k]) for k in range(DIM)]).alias("v")).toArrow()
    context, uses = np.zeros((SLOTS, DIM)), np.zeros(SLOTS)
    if sums.num_rows:
        context[sums["slot"].to_numpy()] = sums["v"].combine_chunks().flatten().to_numpy().reshape(-1, DIM)
        uses[sums["slot"].to_numpy()] = sums["uses"].to_numpy()
    vectors = word_vectors(context, uses, index)
    shared_index.destroy()
    del sums, context, index
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, vectors = {}, shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array([pooled(t.as_py(), vectors, memo) for t in batch.column(1)], np.float32).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))], names=["y", "x"])

    got = train.mapInArrow(features, "y double, x array<float>").toArrow()
    shared.destroy()
    if not got.num_rows:
        return vectors, 0.5
    x, y = got["x"].combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1), got["y"].to_numpy()
    if y.min() == y.max():
        return vectors, float(y.mean())
    order = np.lexsort(np.vstack([x.T[:4], y]))  # the fit doesn't depend on the order of rows
    return vectors, Network(x[order].astype(np.float64), y[order])


def score_quality(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.7, max_labelled: int = MAX_LABELLED, keep: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; with keep, the columns of docs and then score and predicted.

    Only texts enter a score. Null and empty texts get the score of a text without words. Without labels of two classes the
    score is the labelled share, 0.5 if there are none. Rows with a null id are scored like others and count as not held out.
    Repeated labels of an id count once, the smaller one. Columns of docs named score or predicted are replaced.
    """
    work = Workspace(docs.sparkSession, "quality")
    vectors, net = fit(work, docs, labels, doc_id=doc_id, text=text, label=label, max_labelled=max_labelled)
    own = [c for c in docs.columns if c not in ("score", "predicted")] if keep else [doc_id, "held_out"]
    rows = docs.withColumn("_qt", F.coalesce(F.col(text).cast("string"), F.lit("")))
    rows = rows.select(*own, "_qt") if keep else rows.select(F.col(doc_id), held_out(F.col(doc_id)).alias("held_out"), "_qt")
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))  # of fixed size

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        table, model = shared.value
        if isinstance(model, float):
            return pa.array([model] * len(texts), pa.float64())
        memo, out = {}, np.empty(len(texts))
        for k in range(0, len(texts), 500):
            x = np.array([pooled(t.as_py(), table, memo) for t in texts.slice(k, 500)], np.float64)
            out[k : k + 500] = model.score(x)
        return pa.array(out)

    out = rows.withColumn("score", score("_qt")).drop("_qt")
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))
