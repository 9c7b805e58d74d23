"""Pseudonyms against a plain model, and what links, leaves and shows the key."""

import datetime as dt
import hashlib

import pytest
import regex
from pyspark.sql import functions as F

from spantail.llm import pii
from spantail.llm.common import table
from spantail.llm.queries import DEMO_KEY, QUERIES

START = dt.date(1800, 1, 1)


def keyed(key, size, *about):
    return int(hashlib.sha256("|".join(map(str, (key, *about))).encode()).hexdigest()[:15], 16) % size


def feistel(x, a, b, key, tweak):
    left, right = divmod(x, b)
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            left = (left + keyed(key, a, tweak, a, b, i, right)) % a
        else:
            right = (right + keyed(key, b, tweak, a, b, i, left)) % b
    return left * b + right


def permuted(s, base, key, tweak):
    out, block = "", 18 if base == 10 else 12
    for i in range(0, len(s), block):
        part = s[i : i + block]
        half = len(part) // 2
        a, b = base**half, base ** (len(part) - half)
        x = int(part) if base == 10 else sum((ord(c) - 97) * 26**k for k, c in enumerate(reversed(part)))
        y = feistel(x, a, b, key, f"{tweak}#{i // block}")
        out += f"{y:0{len(part)}}" if base == 10 else "".join(chr(97 + y // 26**k % 26) for k in reversed(range(len(part))))
    return out


def refilled(form, digits, letters="", others=""):
    d, a, o = iter(digits), iter(letters), iter(others)
    out = ""
    for c in form:
        if c.isascii() and c.isdigit():
            out += next(d)
        elif letters and c.isascii() and c.isalpha():
            out += next(a).upper() if c.isupper() else next(a)
        elif not c.isascii():
            out += next(o)
        else:
            out += c
    return out


def moved(s, key, tweak):
    out = ""
    for i, c in enumerate(s):
        first, size = next(((a, n) for a, n in pii.SCRIPTS if a <= ord(c) < a + n), (ord(c) // 16 * 16, 16))
        out += chr(first + (ord(c) - first + keyed(key, size, tweak, i)) % size)
    return out


def luhn(s):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(s)))) % 10 == 0


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def day(m, form, key):
    try:
        date = dt.datetime.strptime(m, form).date()
    except ValueError:
        return None
    if not 1800 <= date.year <= 2199:
        return None
    v = (date - START).days
    while True:
        v = feistel(v, 189, 773, key, "date")
        new = START + dt.timedelta(v)
        if (new.day > 12) == (date.day > 12):
            return new.strftime(form)


def national(digits, key):
    area, line = digits[:3], digits[6:]
    exchange = digits[3:6]
    low = lambda s: 0 if s[0] in "01" else 200
    many = lambda s: 200 if s[0] in "01" else 800
    x = ((int(area) - low(area)) * many(exchange) + int(exchange) - low(exchange)) * 10_000 + int(line)
    y = feistel(x, many(area) * many(exchange), 10_000, key, f"phone1,{low(area) // 100},{low(exchange) // 100}")
    upper, line = divmod(y, 10_000)
    upper, middle = divmod(upper, many(exchange))
    return f"{low(area) + upper:03}{low(exchange) + middle:03}{line:04}"


def pseudonym(m, key):
    kind = next(k for k, p in pii.PATTERNS.items() if regex.fullmatch(p, m))
    digits = "".join(c for c in m if c.isascii() and c.isdigit())
    if kind == "email":
        local, domain = m.split("@")
        out = ""
        for i in range(0, len(local), pii.PIECE):
            part, tweak = local[i : i + pii.PIECE], f"mail{domain}#{i // pii.PIECE}"
            pick = lambda test: "".join(c for c in part if test(c))
            number, low, other = pick(lambda c: c.isascii() and c.isdigit()), pick(lambda c: c.isascii() and c.isalpha()).lower(), pick(lambda c: not c.isascii())
            out += refilled(part, permuted(number, 10, key, tweak), permuted(low, 26, key, tweak), moved(other, key, tweak))
        return f"{out}@{domain}"
    if kind == "iban":
        bare = m.replace(" ", "")
        if mod97(bare) != 1:
            return m
        body = refilled(bare[4:], permuted("".join(c for c in bare[4:] if c.isdigit()), 10, key, f"iban{bare[:2]}"))
        return refilled(m, f"{98 - mod97(bare[:2] + '00' + body):02}" + "".join(c for c in body if c.isdigit()))
    if kind == "date":
        forms = ["%Y-%m-%d"] if "-" in m else ["%d/%m/%Y", "%m/%d/%Y"] if "/" in m else ["%d.%m.%Y"]
        return next((x for f in forms if (x := day(m, f, key))), m)
    if kind == "ipv4":
        parts = [int(x) for x in m.split(".")]
        if max(parts) > 255:
            return m
        x = feistel(int.from_bytes(bytes(parts)), 65536, 65536, key, "ipv4")
        return ".".join(map(str, x.to_bytes(4)))
    if kind == "ssn":
        area, group, serial = int(digits[:3]), int(digits[3:5]), int(digits[5:])
        if not (1 <= area <= 899 and area != 666 and group and serial):
            return m
        x = feistel(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, key, "ssn")
        area = x // 9999 // 99 + 1
        return f"{area + (area >= 666):03}-{x // 9999 % 99 + 1:02}-{x % 9999 + 1:04}"
    if kind == "phone":
        country = digits[: 1 if digits[0] in "17" else 2 if digits[:2] in pii.COUNTRIES else 3]
        rest = digits[len(country) :]
        if not (7 <= len(digits) <= 15 and len(rest) >= 4):
            return m
        return refilled(m, country + (national(rest, key) if country == "1" and len(rest) == 10 else permuted(rest, 10, key, f"phone{country}")))
    if kind == "national":
        return refilled(m, national(digits, key))
    if not luhn(digits):
        return m
    body = permuted(digits[:-1], 10, key, "card")
    return refilled(m, next(body + str(c) for c in range(10) if luhn(body + str(c))))


def plain(text, key):
    return None if text is None else regex.sub(pii.ANY, lambda m: pseudonym(m[0], key), text)


TEXTS = [
    "call +1 415 555 1234, +14155551234, (415) 555-1234 or 415-555-1234", "415.555.1234 x 115-555-1234 415-555-1234-9", "+49 30 123456 +441632960961 +1 (017) 555-7713 +353 1 234 5678 +12 34",
    "2024-02-29T10:00:00Z 2024-02-29 12/31/1999 31/12/1999 1999-12-31 31.12.1999 05/06/2001 30.02.2001 13/13/2000", "2199-12-31 1800-01-01 1799-12-31 2024-01-01-5",
    "3782 822463 10005, 378282246310005 4111-1111-1111-1111 4111111111111112 6011000990139424", "DE89370400440532013000 GB82 WEST 1234 5698 7654 32 DE89370400440532013001",
    "josé.müller99@ex-ample.co.uk JOSÉ@x.io иван@mail.ru 李四7@x.cn " + "a" * 70 + "@x.org " + "b" * 30_000 + "@" + "c" * 70 + ".de not@anaddress", "219-09-9999 000-12-3456 666-12-3456 899-99-9999",
    "1.2.3.4 300.1.1.1 1.2.3.4.5 255.255.255.255", None, "", "plain words, 12 of them", "x" * 100_000 + " 1.2.3.4",
]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([*enumerate(TEXTS), (0, TEXTS[0])], "i int, text string").withColumn("key", F.lit("own"))
    return df, pii.pseudonyms(df, "k")


def test_as_the_plain_model(rows):
    df, out = rows
    assert out.columns == df.columns
    got = [(r.i, r.text) for r in out.orderBy("i").collect()]
    assert got == [(0, plain(TEXTS[0], "k")), *((i, plain(t, "k")) for i, t in enumerate(TEXTS))]
    assert pii.pseudonyms(df.limit(0), "k").count() == 0


def test_there_is_a_way_back(rows):
    df, out = rows
    assert [r.text for r in pii.pseudonyms(out, "k", inverse=True).orderBy("i").collect()] == [TEXTS[0], *TEXTS]


def test_one_number_has_one_pseudonym(rows):
    _, out = rows
    text = {r.i: r.text for r in out.collect()}
    spelled = ["".join(c for c in x if c.isdigit())[-10:] for x in regex.findall(r"\+?[0-9(][0-9 ()-]{8,}[0-9]", text[0])]
    assert len(spelled) == 4 and len(set(spelled)) == 1 and spelled[0] != "4155551234"
    days = regex.findall(r"[0-9./-]{10}", text[3])
    assert days[0] == days[1] and days[4] == "-".join(reversed(days[3].split("/"))) == "-".join(reversed(days[5].split("."))) == "-".join([days[2][6:], *days[2][:5].split("/")])
    assert not regex.search("jos|müller|иван|李四", text[7][:60]) and not regex.search("aaaaaaaa|bbbbbbbb", text[7])


def test_the_key_is_not_in_the_plan(spark):
    df = pii.pseudonyms(spark.createDataFrame([(1, "1.2.3.4")], "i int, text string"), "a very private key")
    df.collect()
    told = df._jdf.queryExecution()
    assert "very private" not in told.toString() + told.stringWithStats()


def test_registered_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    got = {r.doc_id: r.text for r in QUERIES["op3_pseudonyms"](spark, sf_dir).collect()}
    assert got == {d: plain(t, DEMO_KEY) for d, t in texts.items()}
    assert any(got[d] != t for d, t in texts.items())
