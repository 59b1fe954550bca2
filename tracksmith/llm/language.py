"""Language identification by Bayesian fusion of evidence.

Text gives a likelihood by hashed byte trigrams. Grouped sums of the text posteriors over the whole table give the rest: a prior
by host, smoothed towards its domain and that towards the table; and the likelihoods of the declared markup language and of the
address suffix, with the language code of the path if there is one. A row's own posterior is taken out of its host's sums.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, small

SLOTS = 32_768
#: The trigram model is fitted on about so many labelled rows of each language (all of a rarer one), those with the smallest hashes.
MAX_LABELLED = 1_500
#: The model and the sums have a column a language; with more languages than this there is an error, none is left out.
MAX_LANGUAGES = 128
#: Text counts as so many trigrams at most, so that long texts stay comparable with the other evidence.
TEXT_WEIGHT = 60.0
HOST_WEIGHT, DOMAIN_WEIGHT, SMOOTH = 4.0, 8.0, 0.5

_DROP = re.compile(r"<!--.*?(?:-->|$)|<(script|style)\b.*?(?:</\1\s*>|$)|<[^>]*(?:>|$)", re.S | re.I)
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)
_PATH = re.compile(r"^/([A-Za-z]{2})(?:/|$)")


def text_of(html: str) -> str:
    return html_lib.unescape(_DROP.sub(" ", html))


def declared_language(html: str) -> str | None:
    m = _LANG.search(html)
    return m[1].lower() if m else None


def address_of(url: str | None) -> tuple[str | None, str | None, str | None]:
    """(host, domain, suffix): the suffix is the last label, with the language code that the path starts with."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").rstrip(".")
    except ValueError:
        return None, None, None
    if not host:
        return None, None, None
    labels, code = host.split("."), _PATH.match(parts.path)
    return host, ".".join(labels[-2:]), labels[-1] + (f"/{code[1].lower()}" if code else "")


def trigram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    b = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0)
    h = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(32 - 15)
    n = np.bincount(h, minlength=SLOTS)
    at = np.flatnonzero(n)
    return at, n[at]


class TextModel:
    """Log probabilities of trigram slots by language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + 0.1
        self.table = np.log(smooth / smooth.sum(0, keepdims=True))

    def posterior(self, text: str) -> list[float]:
        at, n = trigram_counts(text)
        if not len(at) or not text.strip():
            return [1.0 / len(self.languages)] * len(self.languages)
        ll = n @ self.table[at] / n.sum() * min(float(n.sum()), TEXT_WEIGHT)
        p = np.exp(ll - ll.max())
        return (p / p.sum()).tolist()


def fit_text_model(labelled: DataFrame, *, row_id: str, text: str, language: str, max_labelled: int = MAX_LABELLED) -> TextModel:
    """From rows with a language and a text; counts are summed on the executors. The sample is dealt by language: a row is in it
    if its hash lies below the share that brings its language to max_labelled rows."""
    rows = labelled.where(F.col(language).isNotNull() & F.col(text).isNotNull()).select(F.col(language).cast("string").alias("l"), F.col(row_id).alias("id"), F.col(text).cast("string").alias("t"))
    sizes = rows.groupBy("l").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"the labels name more than {MAX_LANGUAGES} languages")
    share = rows.sparkSession.createDataFrame([(r.l, min(1.0, max_labelled / r.n)) for r in sizes], "l string, share double")
    u = F.pmod(F.xxhash64("id", "t"), F.lit(1 << 40)) / float(1 << 40)
    train = rows.join(F.broadcast(share), "l").where(u < F.col("share")).select("l", "t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for l, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                at, n = trigram_counts(t.as_py() or "")
                sums.setdefault(l, np.zeros(SLOTS))[at] += n
        for l, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([l] * len(at), pa.string()), pa.array(at), pa.array(v[at])], names=["l", "slot", "n"])

    got = train.mapInArrow(count, "l string, slot long, n double").groupBy("l", "slot").agg(F.sum("n").alias("n")).toArrow()
    names, slots, n = got["l"].to_pylist(), got["slot"].to_numpy(), got["n"].to_numpy()
    languages = sorted(r.l for r in sizes) or ["und"]
    counts = np.zeros((SLOTS, len(languages)))
    index = {x: k for k, x in enumerate(languages)}
    np.add.at(counts, (slots, np.fromiter((index[x] for x in names), np.int64, len(names))), n)
    return TextModel(languages, counts)


EVIDENCE = "doc_id long, page_id long, host string, domain string, suffix string, declared string, p array<double>"


def evidence(rows: DataFrame, model: TextModel, markup: bool) -> DataFrame:
    """rows (doc_id, page_id, body, address) to EVIDENCE. Without markup the address is the host's name itself."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                out = []
                for body, address in zip(part.column(2), part.column(3).to_pylist(), strict=True):
                    t = body.as_py() or ""
                    if markup:
                        out.append((*address_of(address), declared_language(t), m.posterior(text_of(t))))
                    else:
                        out.append((address, None, None, None, m.posterior(t)))
                cols = [pa.array([r[k] for r in out], pa.string()) for k in range(4)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols, pa.array([r[4] for r in out], pa.list_(pa.float64()))], names=["doc_id", "page_id", "host", "domain", "suffix", "declared", "p"])

    return rows.mapInArrow(run, EVIDENCE)


def fuse(work: Workspace, told: DataFrame, languages: list[str]) -> DataFrame:
    """EVIDENCE rows with the fused posterior q, an array by language."""
    n = len(languages)

    def sums(by: str, name: str) -> DataFrame:
        each = told.where(F.col(by).isNotNull()).groupBy(by).agg(*[F.sum(F.col("p")[k]).alias(f"s{k}") for k in range(n)])
        return work.save(each.select(by, F.array(*[f"s{k}" for k in range(n)]).alias(name)), name, narrow=True)

    whole = told.agg(*[F.sum(F.col("p")[k]).alias(f"s{k}") for k in range(n)]).first()
    total = [float(x or 0) for x in whole]
    prior = [(x + 1) / (sum(total) + n) for x in total]
    hosts, domains, suffixes, declared = sums("host", "by_host"), sums("domain", "by_domain"), sums("suffix", "by_suffix"), sums("declared", "by_declared")
    out = told.join(small(hosts, 50_000), "host", "left").join(small(domains, 50_000), "domain", "left").join(small(suffixes, 50_000), "suffix", "left").join(small(declared, 50_000), "declared", "left")
    kinds = {"by_suffix": suffixes.count() + 1, "by_declared": declared.count() + 1}

    def at(c: str, k: int) -> Column:
        return F.coalesce(F.col(c)[k], F.lit(0.0))

    def size(c: str) -> Column:
        return F.coalesce(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))

    def others(c: str, k: int) -> Column:  # without the row itself
        return F.greatest(F.when(F.col(c).isNull(), 0.0).otherwise(at(c, k) - F.col("p")[k]), F.lit(0.0))

    logs = []
    for k in range(n):
        domain = (others("by_domain", k) + DOMAIN_WEIGHT * prior[k]) / (F.greatest(size("by_domain") - 1, F.lit(0.0)) + DOMAIN_WEIGHT)
        host = (others("by_host", k) + HOST_WEIGHT * domain) / (F.greatest(size("by_host") - 1, F.lit(0.0)) + HOST_WEIGHT)
        log = F.log(host) + F.log(F.col("p")[k] + 1e-30)
        for c, d in kinds.items():
            log = log + F.when(F.col(c).isNotNull(), F.log((others(c, k) + SMOOTH) / (total[k] + SMOOTH * d))).otherwise(0.0)
        logs.append(log)
    out = out.withColumn("logs", F.array(*logs))
    out = out.withColumn("e", F.transform("logs", lambda x: F.exp(x - F.array_max("logs"))))
    return out.withColumn("q", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, y: a + y)))


def identify(pages: DataFrame, documents: DataFrame, *, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """One row a page (page_id) and one a document (doc_id): lang, probability, text_lang, declared, host.

    pages (page_id, url, html) have all kinds of evidence; documents (doc_id, text, source) have text and their source as host;
    their language column only trains the trigram model. Null and empty texts count for nothing, so the other evidence decides,
    at worst the table's prior. It is fitted on about max_labelled rows of every language, all of them if there are fewer; every
    language of the column can be answered, and more than MAX_LANGUAGES are an error. Null or unreadable addresses have no host and no suffix. Ties go to the first language by name.
    Repeated rows are judged each; without any labelled row every answer is "und". Other columns aren't looked at.
    """
    work = Workspace(pages.sparkSession, "language")
    model = fit_text_model(documents, row_id="doc_id", text="text", language="lang", max_labelled=max_labelled)
    none = F.lit(None).cast("long")
    page_rows = pages.select(none.alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("body"), F.col("url").cast("string").alias("address"))
    doc_rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), none.alias("page_id"), F.col("text").cast("string").alias("body"), F.col("source").cast("string").alias("address"))
    told = [work.save(evidence(rows, model, markup), "evidence") for rows, markup in ((page_rows, True), (doc_rows, False))]
    names = F.array(*[F.lit(x) for x in model.languages])
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    out = None
    for part in told:
        got = fuse(work, part, model.languages)
        got = got.select("doc_id", "page_id", best("q").alias("lang"), F.array_max("q").alias("probability"), best("p").alias("text_lang"), "declared", "host")
        out = got if out is None else out.unionByName(got)
    return out
