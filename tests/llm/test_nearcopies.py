"""Near copies against brute force over all pairs of shingle sets."""

import random

import pytest

import corpus_pipeline as pipeline
from spantail.llm import nearcopies
from spantail.llm.common import table

from .conftest import prose


def shingles(text, width=5):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def least_of(rows):
    """The smallest id of each group that links of 0.8 connect."""
    sets = [(i, shingles(t)) for i, t in sorted(rows)]
    least = {i: i for i, _ in sets}
    near = [(a, b) for n, (a, x) in enumerate(sets) for b, y in sets[n + 1 :] if 9 * len(x & y) >= 4 * (len(x) + len(y))]
    changed = True
    while changed:
        changed = False
        for a, b in near:
            low = min(least[a], least[b])
            if (least[a], least[b]) != (low, low):
                least[a], least[b], changed = low, low, True
    return set(least.values())


def edited(r, text, count):
    words = text.split()
    for _ in range(count):
        words[r.randrange(len(words))] = f"x{r.getrandbits(40)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    """Copies around centres with few to many edits, chains, a passage that most texts share, short and empty texts."""
    r = random.Random(8)
    passage = prose(99, 30, 10_000)
    out = []
    for c in range(6):
        centre = prose(c, r.randint(30, 200), 10_000)
        out += [edited(r, centre, r.randint(0, 8)) for _ in range(25)]
        step = centre
        for _ in range(8):
            step = edited(r, step, 3)
            out.append(step)
    out += [f"{passage} {prose(200 + i, r.randint(3, 60), 10_000)}" for i in range(60)]
    return out + [None, "", " \n", "one two", "One Two", "a b c d e", "a b c d f"]


@pytest.mark.parametrize("crowded, common", [(0, 10), (2, 3), (1000, 10**9)])
def test_one_of_each(spark, texts, monkeypatch, crowded, common):
    monkeypatch.setattr(nearcopies, "COMMON", common)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.doc_id for r in nearcopies.one_of_each(df, crowded=crowded).collect()]
    assert sorted(got) == sorted(least_of(rows))


def test_the_stage_drops_near_copies(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = {r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, sf_dir).select("doc_id").collect()}
    assert got == least_of([(r.doc_id, r.text) for r in docs.collect()])


def test_fingerprints_link_first(spark, monkeypatch):
    """Without the search by prefixes the checked links of SimHash alone decide."""
    one = " ".join(f"word{i}" for i in range(4000))
    copies = [(1, one), (2, one + " more"), (3, one + " other"), (4, "quite another text of some words")]
    monkeypatch.setattr(nearcopies, "_met", lambda entries, crowded: spark.createDataFrame([], "u long, v long, h long"))
    got = nearcopies.one_of_each(spark.createDataFrame(copies, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == [1, 4]
