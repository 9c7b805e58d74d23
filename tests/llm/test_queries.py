"""The registered queries on the small tables: one row a document, and their SQL where there is one."""

import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from spantail.llm import pii
from spantail.llm.common import table
from spantail.llm.queries import ORACLE_SQL, QUERIES

from .test_text import base_spans


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}


def rows(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir).collect()


def test_names():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES] == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = c.execute(ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    expected = sorted(rel.fetchall())
    df = QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(*names).collect())) == expected


def test_tokens_and_files(spark, sf_dir, texts):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {d: e.ids for d, e in zip(texts, library.encode_batch([t or "" for t in texts.values()], add_special_tokens=False))}
    counted = rows(spark, sf_dir, "op1_token_counts")
    assert {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in counted} == {(d, len((texts[d] or "").encode()), len(i), len(i) > 1024) for d, i in ids.items()}
    start, expected = 0, set()
    for d in sorted(ids):
        whole = np.array([*ids[d], 0], "<u4")
        expected.add((d, start, len(whole), zlib.crc32(whole.tobytes())))
        start += len(whole)
    assert {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows(spark, sf_dir, "op4_wavelet_files")} == expected


def test_packed_pieces(spark, sf_dir, texts):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {d: np.array([*e.ids, 2], "<u4") for d, e in zip(texts, library.encode_batch([t or "" for t in texts.values()], add_special_tokens=False))}
    got = rows(spark, sf_dir, "op2_packing")
    assert all(zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id]) for r in got)
    assert sum(r.length for r in got) == sum(map(len, ids.values()))
    size = {}
    for r in got:
        size[r.sequence_id] = size.get(r.sequence_id, 0) + r.length
    assert all(n <= 4096 for n in size.values()) and sum(0 if n & (n - 1) == 0 else 4096 - n for n in size.values()) == 0


def test_personal_data(spark, sf_dir, texts):
    got = {r.doc_id: r.text for r in rows(spark, sf_dir, "op3_pseudonyms")}
    assert got.keys() == texts.keys()
    for d, t in texts.items():
        if not re.search("[0-9@]", t):
            assert got[d] == t
        for found in re.findall(r"[\w.]+@[\w.]+\.com|\+1 \(\d{3}\) \d{3}-\d{4}", t):
            assert found not in got[d]
    assert pii.ANY


def test_secrets(spark, sf_dir, texts):
    import hashlib

    got = rows(spark, sf_dir, "op7_secrets")
    assert {r.doc_id for r in got} == texts.keys() and len(got) == len(texts)
    for r in got:
        spans = base_spans(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, _, _ in spans) for x in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_toxicity_of_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in rows(spark, sf_dir, "op8_toxicity")}
    told = [(r.toxic, got[r.doc_id]) for r in table(spark, sf_dir, "labels").collect() if got[r.doc_id].held_out]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert sum(t == r.predicted for t, r in told) / len(told) > 0.97
    assert sum(r.predicted for t, r in told if t) / sum(t for t, _ in told) > 0.85


def test_licenses(spark, sf_dir, texts):
    got = {r.doc_id: r for r in rows(spark, sf_dir, "op5_licenses")}
    assert got.keys() == texts.keys()
    for d, t in texts.items():
        if "Released under the MIT License." in t:
            assert got[d].license == "MIT" and got[d].via == "own"
        if not re.search("(?i)licen[cs]|copyright|spdx|rights reserved|permission is|proprietary", t):
            assert got[d].license is None and got[d].n_statements == 0
