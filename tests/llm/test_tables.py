"""Sharding, vectors and the pipeline."""

from __future__ import annotations

import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from lumenfield.llm import bpe, decontaminate, kdtree, pii, pivots, queries, simhash, toxicity
from lumenfield.llm.tables import salted


def test_shards(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    got = queries.op3_kdtree_shards(spark, sf_dir).collect()
    assert len(got) == len(text) and {r["law"] for r in got} == {"bytes"}
    size, slots = Counter(), {}
    for r in got:
        assert (r["size"], r["text_crc32"]) == (len(text[r["doc_id"]]) + 1, zlib.crc32(text[r["doc_id"]]))
        assert r["grown_shard"] is None
        size[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(size) == list(range(16))
    assert max(size.values()) - min(size.values()) <= 2 * max(r["size"] for r in got)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("count", [1, 3, 16])
def test_shards_of_odd_rows(spark, count):
    rows = [(k % 50 if k else None, None if k % 7 == 0 else "same" if k % 2 else "é" * k, "hot" if k % 3 else None, None) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard string")
    got = kdtree.shards(docs, count).collect()
    assert len(got) == 400 and max(r["shard"] for r in got) == count - 1
    size = Counter()
    for r in got:
        size[r["shard"]] += r["size"]
    assert max(size.values()) - min(size.values()) <= 2 * max(r["size"] for r in got)
    assert kdtree.shards(docs.limit(0), count).count() == 0


def brute_vectors(rows: list) -> dict:
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) == 8 and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    unit = np.array([v / np.linalg.norm(v) for _, v in good])
    near = unit @ unit.T >= pivots.LEAST
    low = np.array([i for i, _ in good])
    while True:
        new = np.array([low[near[k]].min() for k in range(len(low))])
        if (new == low).all():
            break
        low = new
    out = {i: (0, i) for i, _ in rows}
    return out | {i: (int(near[k].sum()) - 1, int(low[k])) for k, (i, _) in enumerate(good)}


@pytest.mark.parametrize("block", [pivots.BLOCK, 7])
def test_vectors_against_brute_force(spark, block):
    rng = np.random.default_rng(2)
    rows = []
    for c in range(30):
        center = rng.normal(size=8)
        rows += [(len(rows) + k, (center + rng.normal(size=8) * 0.12).tolist()) for k in range(rng.integers(1, 40))]
    n = len(rows)
    rows += [(n, rows[0][1]), (n + 1, None), (n + 2, [0.0] * 8), (n + 3, [float("nan")] * 8), (n + 4, [1.0, None] + [0.0] * 6), (n + 5, [1.0]), (n + 6, [])]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, n_links int, uid int")
    want = brute_vectors(rows)
    got = pivots.near_duplicates(table, block=block).collect()
    assert len(got) == len(rows)
    found = sum(r["n_links"] for r in got)
    assert all(r["n_links"] <= want[r["vec_id"]][0] for r in got)
    assert found >= 0.98 * sum(w[0] for w in want.values())
    assert sum((r["component_id"] == want[r["vec_id"]][1]) and r["kept"] == (r["vec_id"] == r["component_id"]) for r in got) >= 0.98 * len(got)


def test_vectors_of_every_length_are_compared(spark):
    rows = [(1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [2.0, 2.01]), (4, [1.0, 0.0, 0.0]), (5, [1.0, 0.0, 0.0]), (6, [0.0, 1.0, 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pivots.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (0, 6)}


def test_hot_keys_are_dealt(spark):
    rows = spark.range(2000).selectExpr("id", "if(id % 3 = 0, 7, id) as k", "if(id = 5, null, 1) as one")
    unique = rows.groupBy("k").count()
    got = {(r["id"], r["count"]) for r in salted(rows, unique, "k", parts=8).collect()}
    assert len(got) == 2000 and (9, 668) in got and (1, 1) in got


def test_vectors_of_odd_tables(spark, sf_dir):
    schema = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(1, None, 0)], [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [2.0, 0.0], 0), (3, [0.0, 1.0], 1)]):
        got = pivots.near_duplicates(spark.createDataFrame(rows, schema)).collect()
        assert len(got) == len(rows)
    links = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got)
    assert links == {(1, 2, 1, True): 2, (None, 2, 1, False): 1, (3, 0, 3, True): 1}
    assert queries.op7_pivot_near_duplicates(spark, sf_dir).count() == 500


def test_pipeline_against_brute_force(spark):
    root = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{root}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, root).collect()}
    # toxicity: the operator's scores of all documents
    scored = toxicity.classify(docs, spark.read.parquet(f"{root}/labels.parquet")).collect()
    left = {r["doc_id"] for r in scored if not r["predicted"]}
    # SimHash: all pairs
    ids = sorted(left)
    prints = [simhash.fingerprint(rows[i]) for i in ids]
    kept: list[int] = []
    low = list(range(len(ids)))
    near = [[j for j in range(len(ids)) if (prints[i] ^ prints[j]).bit_count() <= 2] for i in range(len(ids))]
    while (new := [min(low[j] for j in n) for n in near]) != low:
        low = new
    kept = [ids[k] for k in range(len(ids)) if low[k] == k]
    # contamination: every document aligned to every item
    items = [decontaminate.words(r["text"]) for r in spark.read.parquet(f"{root}/benchmark.parquet").collect()]
    number = {w: k + 1 for k, w in enumerate({w for i in items for w in i})}
    coded = [np.array([number[w] for w in i]) for i in items if len(i) > decontaminate.SHORT]
    clean = []
    for i in kept:
        own = np.array([number.get(w, 0) for w in decontaminate.words(rows[i])])
        score = decontaminate.smith_waterman([own] * len(coded), coded) / [2 * len(c) for c in coded] if len(own) else np.zeros(1)
        if score.max() < decontaminate.LEAST:
            clean.append(i)
    assert sorted(got) == clean
    # personal data and encoding
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    changed = 0
    for i in clean:
        text = pii.redacted(rows[i], pii.base_spans(rows[i]))
        changed += got[i]["n_tokens"] != len(enc.encode_ordinary(text))
    assert changed <= 0.01 * len(clean)  # texts in which the network found more


def test_stages_on_odd_rows(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a@b.org is here", None, "s", 15), (4, "same words here now", "en", None, 19), (4, "same words here now", "en", None, 19), (None, "x" * 5000, "en", "s", 5000)]
    docs = spark.createDataFrame(rows, schema)
    for empty in (False, True):
        current = docs.limit(0) if empty else docs
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            current = stage(spark, current, sf_dir)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert current.columns == docs.columns and current.dtypes == docs.dtypes
        assert current.count() == (0 if empty else 4)
