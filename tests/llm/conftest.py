import random

import pytest

LETTERS = [" ", " ", "\n", "\t", "　", "\x0b", "\x1c", "\u0085", "​", "a", "B", "é", "É", "'s", "'", "1", "!", "́", "<|endoftext|>", "中", "😀", "Σ", "İ", "-", ".", ",", "word", " Hello", "ß"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts(seed, count, longest=14):
    r = random.Random(seed)
    return ["".join(r.choice(LETTERS) for _ in range(r.randint(0, longest))) for _ in range(count)]


def prose(seed, words, vocabulary=60):
    r = random.Random(seed)
    return " ".join(f"w{r.randint(0, vocabulary)}" for _ in range(words))


@pytest.fixture
def documents(spark):
    """Null and empty texts, a null id, a repeated row, a long text, other scripts."""
    rows = [(1, "a b c d", "en", "s/1", 7), (2, None, None, None, None), (3, "", "en", "s/2", 0), (None, "no id here", "en", "s/1", 10), (1, "a b c d", "en", "s/1", 7), (5, prose(1, 30_000), "en", "s/3", 1)]
    rows += [(10 + i, t, "x", f"s/{i % 4}", len(t)) for i, t in enumerate(texts(3, 60, 40))]
    return spark.createDataFrame(rows, SCHEMA)
