import random
import re

import numpy as np
import pytest
import xxhash

from spantail.llm import common, simhash, topk

from .conftest import prose


def fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(nodes, near):
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if near(a, b) and least[b] < least[a]:
                    least[a], changed = least[b], True
    return least


def test_fingerprints_and_components(spark, documents):
    rows = documents.collect()
    marks = [fingerprint(r.text) for r in rows]
    reach = linked(set(marks), lambda a, b: (a ^ b).bit_count() <= 2)
    first = {}
    for r, m in zip(rows, marks):
        if r.doc_id is not None:
            first[reach[m]] = min(first.get(reach[m], r.doc_id), r.doc_id)
    expected = sorted((str(r.doc_id), f"{m:016x}", str(first.get(reach[m]))) for r, m in zip(rows, marks))
    found = simhash.near_duplicates(documents)
    got = sorted((str(r.doc_id), r.f, str(r.component_id)) for r in found.select("doc_id", simhash.fingerprint_text().alias("f"), "component_id").collect())
    assert got == expected
    assert simhash.near_duplicates(documents.limit(0)).count() == 0


@pytest.mark.parametrize("distance, blocks, crowded", [(2, 4, 0), (2, 4, 2), (2, 4, 1000), (1, 3, 0), (3, 5, 0), (3, 5, 3), (3, 6, 1000)])
def test_links_of_crowds(spark, distance, blocks, crowded):
    """Groups around a few centres and chains of single steps; crowded keys must lose and add no link."""
    r = random.Random(4)
    marks = set()
    for _ in range(4):
        centre = r.getrandbits(64)
        marks |= {centre ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(30)}
        step = centre ^ r.getrandbits(64)
        for _ in range(6):
            step ^= (1 << r.randrange(64)) | (1 << r.randrange(64))
            marks.add(step)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = sorted(map(signed, marks))
    expected = linked(nodes, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= distance)
    df = spark.createDataFrame([(n,) for n in nodes], "fp long")
    got = {r.node: r.least for r in simhash.components(simhash.links(df, distance, blocks, crowded)).collect()}
    assert {n: got.get(n, n) for n in nodes} == expected
    with pytest.raises(ValueError):
        simhash.links(df, 4, 6)


def test_hot_nodes_and_hot_fingerprints(spark, documents, monkeypatch):
    """The ways for very many rows of one key give the same, whatever counts as many."""
    monkeypatch.setattr(common, "FEW_ROWS", 0)
    monkeypatch.setattr(simhash, "FEW_ROWS", 0)
    monkeypatch.setattr(common, "HOT", 20)
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(9)] + [(59, 200)]
    got = {r.node: r.least for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {n: got.get(n, n) for e in edges for n in e} == {n: 0 if n < 100 or n == 200 else 100 for e in edges for n in e}
    rows = documents.unionAll(documents.where("doc_id = 1").crossJoin(spark.range(50).toDF("times")).drop("times"))
    found = simhash.near_duplicates(rows).collect()
    assert len(found) == rows.count() and {r.component_id for r in found if r.doc_id == 1} == {1}


def test_one_of_each(spark, documents):
    kept = simhash.one_of_each(documents)
    assert kept.columns == documents.columns
    rows = {r.doc_id: r.component_id for r in simhash.near_duplicates(documents.where("doc_id is not null")).collect()}
    ids = sorted(r.doc_id for r in kept.where("doc_id is not null").collect())
    assert ids == sorted(set(rows.values()))


def test_other_columns_may_have_our_names(spark):
    df = spark.createDataFrame([(1, "a b c", 9, 8), (2, "a b c", 7, 6)], "doc_id long, text string, fp int, component_id int")
    assert [r.component_id for r in simhash.near_duplicates(df).collect()] == [1, 1]


def brute(vectors, k=20, every=20):
    fine = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i in sorted({i for i, _ in fine if i % every == 0}):
        q = min(v for j, v in fine if j == i)
        scored = sorted(((-sum(a * b for a, b in zip(q, v)), j) for j, v in fine if j != i and len(v) == len(q)))
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("values", ["normal", "ties", "long"])
def test_top_k(spark, values):
    r = np.random.default_rng(2)
    make = {"normal": lambda: r.normal(0, 0.2, 8), "ties": lambda: r.integers(-1, 2, 8) / 64, "long": lambda: r.normal(0, 1e6, 8)}[values]
    vectors = [(i, [float(x) for x in make()]) for i in range(500)]
    vectors += [(3, vectors[3][1]), (None, vectors[1][1]), (1000, None), (1001, [None] * 8), (1002, [float("nan")] * 8), (1003, [float("inf")] + [0.0] * 7), (1040, [1.0, 2.0]), (1041, [1.0, 3.0]), (1060, [])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk.exact_topk(df).collect()))
    assert got == sorted(brute(vectors))


def test_top_k_in_blocks_and_small(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 20)
    vectors = [(i, [float(i % 7), float(i % 5)]) for i in range(100)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.exact_topk(df, k=5).collect())) == sorted(brute(vectors, 5))
    assert topk.exact_topk(df.limit(0)).count() == 0
    assert topk.exact_topk(df.where("vec_id = 20")).count() == 0


@pytest.mark.parametrize("values", ["pareto", "normal"])
def test_early_stop_is_exact(values):
    """Most queries stop before the full depth, whether lists are skewed or not, over one shard and over several."""
    r = np.random.default_rng(5)
    vectors = {"pareto": lambda: r.pareto(1.0, (12_000, 6)) * 50, "normal": lambda: r.normal(0, 8, (12_000, 64))}[values]()
    vectors = np.floor(vectors).astype(np.int64)
    queries, ids = np.floor(r.normal(0, 8, (20, vectors.shape[1]))).astype(np.int64), np.arange(12_000)
    search = topk.Search(np.arange(100_000, 100_020), queries, 5)
    for i in range(0, 12_000, 4000):
        search.read(vectors[i : i + 4000], ids[i : i + 4000])
        for q in range(20):
            scores = vectors[: i + 4000] @ queries[q]
            best = np.lexsort((ids[: i + 4000], -scores))[:5]
            assert (search.ids[q].tolist(), search.scores[q].tolist()) == (best.tolist(), scores[best].tolist())
    assert sum(search.stopped.values()) == 60
    assert sum(n for d, n in search.stopped.items() if d < 1) >= 50


def test_one_task_returns_k_rows_a_query(spark, tmp_path, monkeypatch):
    """However many shards it read."""
    monkeypatch.setattr(topk, "SHARD", 50)
    monkeypatch.setattr(topk, "new_path", lambda spark, name: f"file://{tmp_path}/{name}")
    df = spark.createDataFrame([(i, [float(i % 9), float(i % 7)]) for i in range(1000)], "vec_id long, embedding array<float>").coalesce(1)
    assert topk.exact_topk(df, k=3).count() == 150
    assert spark.read.parquet(f"file://{tmp_path}/topk").count() == 150


def test_registered_fingerprints(spark, sf_dir):
    """The query on its table, against all pairs."""
    from spantail.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in common.table(spark, sf_dir, "documents").collect()}
    marks = {d: fingerprint(t) for d, t in texts.items()}
    reach = linked(set(marks.values()), lambda a, b: (a ^ b).bit_count() <= 2)
    first = {}
    for d, m in marks.items():
        first[reach[m]] = min(first.get(reach[m], d), d)
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in QUERIES["op10_simhash"](spark, sf_dir).collect()}
    assert got == {(d, f"{m:016x}", first[reach[m]]) for d, m in marks.items()}
