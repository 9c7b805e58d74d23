import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from spantail.llm import packing, tokens, wavelet

from .conftest import prose, texts

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def library(name, items):
    return [e.ids for e in Tokenizer.from_file(P.path(name)).encode_batch([t or "" for t in items], add_special_tokens=False)]


@pytest.mark.parametrize("name", FILES)
def test_ids_equal_the_library(name):
    items = texts(1, 3000) + [prose(2, 5000), "x" * 20_000, "", None]
    encoder = tokens.Encoder(open(P.path(name)).read())
    for _ in range(2):  # the second time from memory
        ids, at = encoder.encode(pa.array(items, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == library(name, items)
        assert encoder.counts(pa.array(items, pa.string())).tolist() == np.diff(at).tolist()


def test_other_builds_get_whole_texts():
    import json

    told = json.load(open(P.path(FILES[0])))
    told["added_tokens"][0]["lstrip"] = True
    encoder = tokens.Encoder(json.dumps(told))
    assert encoder.build == "whole"
    ids, at = encoder.encode(pa.array(["a b", "", "c"]))
    assert at.tolist()[0] == 0 and len(at) == 4


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 10)
    encoder = tokens.Encoder(open(P.path(FILES[0])).read())
    for seed in range(4):
        items = texts(seed, 50)
        ids, at = encoder.encode(pa.array(items))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == library(FILES[0], items)


def test_counts(spark, documents):
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(documents, P.path(FILES[0])).collect()}
    rows = documents.collect()
    expected = {(r.doc_id, len((r.text or "").encode()), len(i), len(i) > 1024) for r, i in zip(rows, library(FILES[0], [r.text for r in rows]))}
    assert got == expected
    assert tokens.token_counts(documents, P.path(FILES[0])).count() == len(rows)
    assert tokens.token_counts(documents.limit(0), P.path(FILES[0])).count() == 0


def test_wavelet_matrix_round_trip():
    r = np.random.default_rng(1)
    ids = np.concatenate([r.integers(0, 300, 5000), r.integers(0, 50_000, 3000), np.full(500, 7)]).astype(np.uint32)
    shard = wavelet.Shard.from_bytes(wavelet.Shard.of(ids, pa.array([3, None]), np.array([8000, 500]), 9).to_bytes())
    assert (shard.ids() == ids).all() and (shard.token(np.arange(len(ids))) == ids).all()
    assert shard.doc_ids.to_pylist() == [3, None] and shard.start == 9
    for x in (7, int(ids[0]), int(ids[6000])):
        places = np.flatnonzero(ids == x)
        assert (shard.find(x, np.arange(len(places))) == places).all()
        assert shard.count(x, 100, 8100) == ((places >= 100) & (places < 8100)).sum()
    assert shard.count(49_999_999, 0, 10) == 0
    with pytest.raises(ValueError):
        wavelet.Shard.from_bytes(b"x" * 100)


@pytest.mark.parametrize("shard_ids", [50, 1 << 20])
def test_token_files(spark, documents, shard_ids):
    rows = sorted(documents.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    ids = [np.array([*i, 0], "<u4") for i in library(FILES[0], [r.text for r in rows])]
    ends = np.cumsum([len(i) for i in ids])
    expected = sorted((str(r.doc_id), int(e - len(i)), len(i), zlib.crc32(i.tobytes())) for r, i, e in zip(rows, ids, ends))
    images = wavelet.write_token_files(documents, P.path(FILES[0]), shard_ids=shard_ids)
    got = sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in wavelet.read_token_files(images).collect())
    assert got == expected
    assert wavelet.read_token_files(wavelet.write_token_files(documents.limit(0), P.path(FILES[0]))).count() == 0


def pieces_of(df):
    return sorted(df.collect(), key=lambda r: (str(r.doc_id), r.start))


@pytest.mark.parametrize("limits", [{}, {"max_tokens": 64}, {"max_tokens": 64, "max_segments": 3}, {"max_tokens": 64, "max_loss": 20}])
def test_packing(spark, documents, limits):
    docs = documents.where("doc_id is not null").dropDuplicates(["doc_id"])
    ids = dict(zip([r.doc_id for r in docs.collect()], library(FILES[1], [r.text for r in docs.collect()])))
    got = packing.pack(docs.coalesce(1), P.path(FILES[1]), **limits).collect()
    most = limits.get("max_tokens", 4096)
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for d, i in ids.items():
        parts = sorted(by_doc[d], key=lambda r: r.start)
        assert b"".join(bytes(p.ids) for p in parts) == np.array([*i, 2], "<u4").tobytes()
        assert [p.start for p in parts] == np.cumsum([0, *[p.length for p in parts]])[:-1].tolist()
        assert {p.doc_tokens for p in parts} == {len(i) + 1}
    padding = 0
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r.offset)
        assert [p.offset for p in parts] == np.cumsum([0, *[p.length for p in parts]])[:-1].tolist()
        total = sum(p.length for p in parts)
        assert total <= most and len(parts) <= limits.get("max_segments", 512) and sum(p.loss_tokens for p in parts) <= limits.get("max_loss", 4096)
        padding += 0 if total & (total - 1) == 0 else most - total
    if not {"max_segments", "max_loss"} & limits.keys():
        assert padding == 0


def test_packing_prompts_and_repeats(spark):
    rows = [(1, "q " * 50, "a " * 10), (1, "q " * 50, "a " * 10), (2, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, prompt string, text string")
    got = packing.pack(df.coalesce(1), P.path(FILES[1]), max_tokens=32, max_loss=8, prompt_col="prompt").collect()
    assert sum(r.length for r in got) == 2 * 61 + 1 and sum(r.loss_tokens for r in got) == 2 * 11 + 1
    loss = {}
    for r in got:
        loss[r.sequence_id] = loss.get(r.sequence_id, 0) + r.loss_tokens
    assert max(loss.values()) <= 8
    assert packing.pack(df.limit(0), P.path(FILES[1])).count() == 0
    with pytest.raises(ValueError):
        packing.Packer(0, 1, 1)


@pytest.mark.parametrize("count, size", [(500_000, 1), (50_000, 10), (200_000, 2)])
def test_many_tiny_examples(count, size):
    """The cost hangs on kinds of items, not on how many wait."""
    import time

    began = time.process_time()
    packer = packing.Packer(4096, 512, 4096)
    packer.add(np.arange(count), np.full(count, size), np.zeros(count, np.int64))
    packer.fill(True)
    assert time.process_time() - began < 10
    assert sum(p[2] for p in packer.pieces) == count * size and packer.waiting == 0
    assert max(np.bincount([p[3] for p in packer.pieces])) <= 512


def test_all_three_limits_on_conversations(spark, sf_dir):
    """Turns of users are prompts without loss; the answers are packed under limits each of which binds."""
    from pyspark.sql import functions as F

    from spantail.llm.common import table

    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    said = lambda mine: F.concat_ws("\n", F.transform(F.filter("t", lambda x: (x["role"] == "assistant") == mine), lambda x: x["text"]))
    rows = turns.select(F.monotonically_increasing_id().alias("doc_id"), said(True).alias("text"), said(False).alias("prompt")).coalesce(1)
    limits = {"max_tokens": 512, "max_segments": 6, "max_loss": 256}
    got = packing.pack(rows, P.path(FILES[1]), prompt_col="prompt", **limits).collect()
    sums = {}
    for r in got:
        n = sums.setdefault(r.sequence_id, [0, 0, 0])
        for i, x in enumerate((r.length, 1, r.loss_tokens)):
            n[i] += x
    for i, most in enumerate(limits.values()):
        assert max(n[i] for n in sums.values()) == most
    want = rows.collect()
    sizes = zip(library(FILES[1], [r.text for r in want]), library(FILES[1], [r.prompt for r in want]))
    assert sum(r.length for r in got) == sum(len(a) + len(b) + 1 for a, b in sizes)
    fewest = max(sum(n[0] for n in sums.values()) / 512, sum(n[2] for n in sums.values()) / 256)
    assert len(sums) <= 1.2 * fewest + 2


def test_empty_documents_in_a_table(spark):
    df = spark.range(5000).selectExpr("id AS doc_id", "CAST(NULL AS STRING) AS text")
    got = packing.pack(df.coalesce(1), P.path(FILES[1])).select("doc_id", "length", "sequence_id").collect()
    assert len(got) == 5000 and {r.length for r in got} == {1} and len({r.sequence_id for r in got}) <= 20
