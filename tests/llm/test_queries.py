"""The registered queries against their SQL and contract, and the pipeline's stages against brute force, on the smallest tables."""

import re
from collections import defaultdict

import pytest

from tracksmith.llm import oracles, quality, queries

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "labels", "conversations")


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_and_sql_agree(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(oracles.ORACLES[name])
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = want.select(*columns).fetchall()
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(rows, key=repr) and rows


CONTRACT = {
    "op4_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op7_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op9_fingerprints": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op3_language_id": {"doc_id": "bigint", "page_id": "bigint", "lang": "string", "probability": "double", "text_lang": "string", "declared": "string", "host": "string"},
    "op10_chat_format": {"conv_id": "bigint", "turn": "bigint", "role": "string", "reply_to": "bigint", "thread": "bigint", "depth": "int", "place": "bigint", "n_quotes": "bigint", "n_linked": "bigint", "content": "string", "chat": "string"},
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_columns(spark, name):
    out = queries.QUERIES[name](spark, SF)
    assert dict(out.dtypes) == CONTRACT[name]
    source = {"op3_language_id": ("documents", "pages"), "op10_chat_format": ("conversations",)}.get(name, ("documents",))
    assert out.count() == sum(spark.read.parquet(f"{SF}/{t}.parquet").count() for t in source)


def words(text):
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def blank_words(text):
    return [w for w in re.split("[\\x09-\\x0D ]+", text or "") if w]


def lines_by_force(rows):
    seen, out = [], []
    for doc_id, text, lang, source, _ in sorted(rows):
        kept, had = [], False
        for line in (text or "").split("\n"):
            s = {w for w in re.split("[\\x09-\\x0D ]", line.lower()) if w}
            had |= bool(s)
            if not s or not any(5 * len(s & x) >= 4 * len(s | x) for x in seen if 4 * len(x) <= 5 * len(s) and 4 * len(s) <= 5 * len(x)):
                kept.append(line)
            if s:
                seen.append(s)
        new = None if text is None else "\n".join(kept)
        if text is None or new == text or blank_words(new):
            out.append((doc_id, new, lang, source, len(new) if new is not None else None))
    return out


def near_by_force(rows):
    sets = {}
    for doc_id, text, *_ in rows:
        w = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        w = blank_words(w)
        sets[doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return [r for r in rows if find(r[0]) == r[0]]


def clean_by_force(rows, items):
    windows = {tuple(w[i : i + 13]) for w in map(words, items) for i in range(max(1, len(w) - 12)) if w}
    assert all(len(w) == 13 for w in windows)
    return [r for r in rows if not any(tuple(w[i : i + 13]) in windows for w in [words(r[1])] for i in range(len(w) - 12))]


def targets_by_force(sizes):
    """sizes: source to words; to targets."""
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}
    budget, capped = 1.5 * sum(sizes.values()), set()
    while True:
        rest = budget - sum(2 * sizes[n] for n in capped)
        total = sum(weight[n] for n in names if n not in capped)
        share = {n: 2.0 * sizes[n] if n in capped else rest * weight[n] / total for n in names}
        over = {n for n in names if n not in capped and share[n] > 2 * sizes[n]}
        if not over:
            return share
        capped |= over


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    read = lambda df: [tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "MinHash near-dedup", "benchmark decontamination", "mixing to target weights"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(to := f"{tmp_path}/{k}")
        out, rows = spark.read.parquet(to), read(docs)
        if k < 4:
            assert out.columns == docs.columns, name
        if k == 0:
            scores = quality.score_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            want = {r.doc_id for r in scores.where("score >= 0.7").collect()}
            assert sorted(read(out)) == sorted(r for r in rows if r[0] in want) and 0 < len(want) < len(rows)
        elif k < 4:
            want = [lines_by_force, near_by_force, lambda rows: clean_by_force(rows, items)][k - 1](rows)
            assert sorted(read(out), key=repr) == sorted(want, key=repr), name
        else:
            size = {r[0]: len(blank_words(r[1])) for r in rows}
            sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
            for r in rows:
                sizes[r[3]] += size[r[0]]
                largest[r[3]] = max(largest[r[3]], size[r[0]])
            target = targets_by_force(sizes)
            for r in out.collect():
                assert r.size == size[r.doc_id] and r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, r.target)
                assert r.copies > 0 and r.taken == r.copies * r.size <= 2 * r.size
                taken[r.source] += r.taken
            assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)
        docs = out
    assert corpus_pipeline.run(spark, SF).count() == docs.count()
