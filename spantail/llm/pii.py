"""Format-preserving pseudonyms for personal data, by a keyed Feistel network in DataFrame functions.

A value that passes its validation is mapped by a keyed permutation of all values of its format, so
equal values get equal pseudonyms in every document, different values different ones, and whoever has
the key can go back (inverse=True). A permutation of a * b values is a Feistel network on the pair
(x div b, x mod b): rounds add a keyed SHA-256 of one half to the other, modulo its size.

kind | validated by | permuted
card | 13 to 19 digits, plain or in groups (4-6-5 too), Luhn | all digits but the check digit, which is computed anew
iban | country, check digits modulo 97, 11 to 30 more | the digits after the check digits, which are computed anew
ssn | area, group and serial that may be issued | all of those
phone | + country, 7 to 15 digits with separators | the digits after the country code; of 10 after +1, area and exchange keep whether they begin with 0 or 1
national | ten digits as (415) 555-1234, 415-555-1234 or 415.555.1234, area and exchange from 200 | as after +1, so one number has one pseudonym in any spelling
ipv4 | four numbers of at most 255 | all 32 bits
date | a day of 1800 to 2199: yyyy-mm-dd (also before T and a time), dd/mm/yyyy, mm/dd/yyyy where only that is a day, dd.mm.yyyy | the days of these 400 years, those after the 12th of a month among themselves
email | local part, @, domain with a dot, of any length | letters and digits of the local part, each kind for itself, in blocks; letters beyond ASCII each within their script

Separators, lengths and letter case stay. What fails validation stays as it is. A letter of a script that
isn't listed moves within 16 code points, and may have no way back. The key is no literal of the plan,
which explain() and event logs show, but read from a table of one row.

Null texts stay null, empty ones empty; repeated rows each get their row; an empty table gives no rows.
Whole texts are read, whatever their length, in linear time; only texts with a match are rebuilt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spantail.llm.native import once, replaced

ROUNDS = 8
#: Steps in which a permutation is walked until its value is of the right class: each fails with a probability under 0.61.
STEPS = 64
#: Characters of a local part that are changed together; longer ones in pieces.
PIECE = 64
#: Kinds in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "date": r"(?<![\p{L}\p{N}./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?:(?=T[0-9])|(?![\p{L}\p{N}/-]|\.[0-9]))",
    "ipv4": r"(?<![\p{L}\p{N}.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\p{L}\p{N}]|\.[0-9])",
    "ssn": r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}]|-[0-9])",
    "phone": r"(?<![\p{L}\p{N}+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){1,4}(?![\p{L}\p{N}])",
    "national": r"(?<![\p{L}\p{N}+.-])(?:\([2-9][0-9]{2}\)[ ]?|[2-9][0-9]{2}[.-])[2-9][0-9]{2}[.-][0-9]{4}(?![\p{L}\p{N}]|[.-][0-9])",
    "card": r"(?<![\p{L}\p{N}])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{4}(?:[ -][0-9]{4}){2,3}[ -][0-9]{1,4})(?![\p{L}\p{N}])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Fixed value: days of 400 years, 189 * 773.
DAYS, _DAYS_A, _DAYS_B = 146097, 189, 773
#: Country codes of two digits; 1 and 7 have one, all others three.
COUNTRIES = ("20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")
#: First code point and number of letters (digits, marks) of a script that follow each other.
SCRIPTS = ((0xC0, 23), (0xD8, 7), (0xDF, 24), (0xF8, 8), (0x100, 128), (0x180, 208), (0x300, 112), (0x391, 17), (0x3B1, 25), (0x400, 16), (0x410, 32), (0x430, 32), (0x450, 16), (0x5D0, 27), (0x660, 10), (0x966, 10), (0xE01, 46), (0x3041, 86), (0x30A1, 90), (0x4E00, 20992), (0xAC00, 11172), (0xFF10, 10))


def _keyed(key: Column, size: Column, *about: Column) -> Column:
    """A number below size that hangs on the key and what it is about."""
    digest = F.sha2(F.concat_ws("|", key, *[x.cast("string") for x in about]), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), size)


def feistel(x: Column, a: Column, b: Column, key: Column, tweak: Column, inverse: bool = False) -> Column:
    """x, from 0 to a * b - 1, permuted. x, a, b: bigint."""

    order = range(ROUNDS)[::-1] if inverse else range(ROUNDS)

    def network(t: Column) -> Column:
        a, b = t["a"], t["b"]

        def turn(s: Column, i: Column) -> Column:
            plus = (lambda v, f, size: F.pmod(v - f + size, size)) if inverse else (lambda v, f, size: F.pmod(v + f, size))
            left = F.struct(plus(s["l"], _keyed(key, a, tweak, a, b, i, s["r"]), a).alias("l"), s["r"].alias("r"))
            right = F.struct(s["l"].alias("l"), plus(s["r"], _keyed(key, b, tweak, a, b, i, s["l"]), b).alias("r"))
            return F.when(i % 2 == 0, left).otherwise(right)

        first = F.struct(F.call_function("div", t["x"], b).alias("l"), F.pmod(t["x"], b).alias("r"))
        return F.aggregate(F.array(*map(F.lit, order)), first, turn, lambda s: s["l"] * b + s["r"])

    return once(F.struct(x.alias("x"), a.alias("a"), b.alias("b")), network)


def _power(base: int, n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(base**k).cast("long") for k in range(10)]), n + 1)


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _permuted(s: Column, base: int, key: Column, tweak: Column, inverse: bool) -> Column:
    """A string of digits (base 10) or letters a-z (base 26), block by block."""
    block = 18 if base == 10 else 12

    def one(i: Column, part: Column) -> Column:
        n = F.length(part)
        half = F.call_function("div", n, F.lit(2)).cast("int")
        a, b = _power(base, half), _power(base, n - half)
        mark = F.concat_ws("#", tweak, i.cast("string"))
        if base == 10:
            return F.lpad(feistel(part.cast("long"), a, b, key, mark, inverse).cast("string"), n, F.lit("0"))
        x = F.aggregate(_chars(part), F.lit(0).cast("long"), lambda v, c: v * 26 + F.ascii(c) - 97)
        y = feistel(x, a, b, key, mark, inverse)
        written = F.aggregate(F.sequence(F.lit(1), n), F.struct(y.alias("v"), F.lit("").alias("out")), lambda t, _: F.struct(F.call_function("div", t["v"], F.lit(26).cast("long")).alias("v"), F.concat(F.char(F.lit(97) + F.pmod(t["v"], F.lit(26).cast("long"))), t["out"]).alias("out")))
        return written["out"]

    def whole(s: Column) -> Column:
        blocks = F.call_function("div", F.length(s) + (block - 1), F.lit(block)).cast("int")
        return F.when(s == "", s).otherwise(F.concat_ws("", F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: once(F.substr(s, i * block + 1, F.lit(block)), lambda part: one(i, part)))))

    return once(s, whole)


def _moved(s: Column, key: Column, tweak: Column, inverse: bool) -> Column:
    """A string of letters beyond ASCII, each moved within its script by a number that hangs on its place."""

    def one(c: Column, i: Column) -> Column:
        code = F.ascii(c).cast("long")

        def within(first: Column, size: Column) -> Column:
            by = _keyed(key, size, tweak, i)
            return first + F.pmod(code - first + (size - by if inverse else by), size)

        new = within(code - code % 16, F.lit(16).cast("long"))
        for first, size in SCRIPTS:
            new = F.when(code.between(first, first + size - 1), within(F.lit(first).cast("long"), F.lit(size).cast("long"))).otherwise(new)
        return F.decode(F.unhex(F.lpad(F.hex(new), 8, "0")), "UTF-32")

    return F.when(s == "", s).otherwise(F.concat_ws("", F.transform(_chars(s), one)))


def _refilled(form: Column, digits: Column, letters: Column | None = None, others: Column | None = None) -> Column:
    """form with its digits, and its letters if given, those of ASCII and the others, replaced one by one."""
    none = F.lit("")

    def refill(new: Column) -> Column:
        def step(t: Column, c: Column) -> Column:
            one_byte = F.octet_length(c) == 1
            number = c.between("0", "9") & one_byte
            letter = F.lower(c).between("a", "z") & one_byte if letters is not None else F.lit(False)
            value = F.when(number, F.substr(new["digits"], t["d"] + 1, F.lit(1)))
            if letters is not None:
                given = F.substr(new["letters"], t["l"] + 1, F.lit(1))
                value = value.when(letter, F.when(c.between("A", "Z"), F.upper(given)).otherwise(given)).when(~one_byte, F.substr(new["others"], t["o"] + 1, F.lit(1)))
            return F.struct((t["d"] + number.cast("int")).alias("d"), (t["l"] + letter.cast("int")).alias("l"), (t["o"] + (~one_byte).cast("int")).alias("o"), F.concat(t["out"], value.otherwise(c)).alias("out"))

        return F.aggregate(_chars(form), F.struct(F.lit(0).alias("d"), F.lit(0).alias("l"), F.lit(0).alias("o"), F.lit("").alias("out")), step, lambda t: t["out"])

    return once(F.struct(digits.alias("digits"), (none if letters is None else letters).alias("letters"), (none if others is None else others).alias("others")), refill)


def _mod97(s: Column) -> Column:
    """An IBAN's text, first four characters last, letters as 10 to 35, modulo 97."""
    moved = F.concat(F.substr(s, F.lit(5)), F.substring(s, 1, 4))
    return F.aggregate(_chars(moved), F.lit(0), lambda r, c: F.when(c.between("0", "9"), F.pmod(r * 10 + F.ascii(c) - 48, F.lit(97))).otherwise(F.pmod(r * 100 + F.ascii(c) - 55, F.lit(97))))


def _day(m: Column, form: str, key: Column, inverse: bool) -> Column:
    """A date in another day's place; one after the 12th of its month gets such a day, so it can be read in one way only, as before."""
    start = F.lit("1800-01-01").cast("date")
    number = F.datediff(F.try_to_timestamp(m, F.lit(form)).cast("date"), start).cast("long")
    turned = lambda v: feistel(v, F.lit(_DAYS_A).cast("long"), F.lit(_DAYS_B).cast("long"), key, F.lit("date"), inverse)
    late = lambda v: F.dayofmonth(F.date_add(start, v.cast("int"))) > 12
    new = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), turned(number), lambda v, _: F.when(late(v) == late(number), v).otherwise(turned(v)))
    return F.when(number.between(0, DAYS - 1), F.date_format(F.date_add(start, new.cast("int")), form))


def _national(digits: Column, key: Column, inverse: bool) -> Column:
    """The ten digits after +1."""
    part = lambda at, n: F.substring(digits, at, n).cast("long")
    low = lambda first: F.when(first < 2, 0).otherwise(2).cast("long")
    many = lambda first: F.when(first < 2, 2).otherwise(8).cast("long")
    area, exchange = part(1, 1), part(4, 1)
    hundred, ten = F.lit(100).cast("long"), F.lit(10_000).cast("long")
    upper, middle = (area - low(area)) * hundred + part(2, 2), (exchange - low(exchange)) * hundred + part(5, 2)
    x = (upper * many(exchange) * hundred + middle) * ten + part(7, 4)
    new = feistel(x, many(area) * many(exchange) * ten, ten, key, F.concat_ws(",", F.lit("phone1"), low(area).cast("string"), low(exchange).cast("string")), inverse)
    above = F.call_function("div", new, ten)
    three = lambda first, n: F.lpad((low(first) * hundred + n).cast("string"), 3, "0")
    return F.concat(three(area, F.call_function("div", above, many(exchange) * hundred)), three(exchange, F.pmod(above, many(exchange) * hundred)), F.lpad(F.pmod(new, ten).cast("string"), 4, "0"))


def pseudonym(m: Column, key: Column, inverse: bool = False) -> Column:
    """The pseudonym of one match of ANY, or the match itself if it isn't valid."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    whole = {k: m.rlike(f"^(?:{p})$") for k, p in PATTERNS.items()}

    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    def piece(i: Column, part: Column) -> Column:
        tweak = F.concat(F.lit("mail"), domain, F.lit("#"), i.cast("string"))
        low, number, other = F.lower(F.regexp_replace(part, "[^A-Za-z]", "")), F.regexp_replace(part, "[^0-9]", ""), F.regexp_replace(part, r"[\x00-\x7F]", "")
        return _refilled(part, _permuted(number, 10, key, tweak, inverse), _permuted(low, 26, key, tweak, inverse), _moved(other, key, tweak, inverse))

    def pieces(local: Column) -> Column:
        last = F.call_function("div", F.length(local) - 1, F.lit(PIECE)).cast("int")
        return F.concat_ws("", F.transform(F.sequence(F.lit(0), last), lambda i: once(F.substr(local, i * PIECE + 1, F.lit(PIECE)), lambda part: piece(i, part))))

    mail = F.concat(once(local, pieces), F.lit("@"), domain)

    bare = F.regexp_replace(m, " ", "")
    account = F.regexp_replace(F.substr(bare, F.lit(5)), "[^0-9]", "")
    moved = _refilled(F.substr(bare, F.lit(5)), _permuted(account, 10, key, F.concat(F.lit("iban"), F.substring(m, 1, 2)), inverse))
    check = F.lpad((98 - _mod97(F.concat(F.substring(bare, 1, 2), F.lit("00"), moved))).cast("string"), 2, "0")
    iban = F.when(_mod97(bare) == 1, _refilled(m, F.concat(check, F.regexp_replace(moved, "[^0-9]", ""))))

    slashes = F.coalesce(_day(m, "dd/MM/yyyy", key, inverse), _day(m, "MM/dd/yyyy", key, inverse))
    date = F.coalesce(F.when(m.rlike("^[0-9]{4}-"), _day(m, "yyyy-MM-dd", key, inverse)), F.when(m.rlike("^[0-9]{2}/"), slashes), F.when(m.rlike("^[0-9]{2}[.]"), _day(m, "dd.MM.yyyy", key, inverse)))

    parts = F.transform(F.split(m, "[.]"), lambda c: c.cast("long"))
    wide = F.lit(65536).cast("long")
    ip = feistel(F.aggregate(parts, F.lit(0).cast("long"), lambda v, c: v * 256 + c), wide, wide, key, F.lit("ipv4"), inverse)
    ipv4 = F.when(F.forall(parts, lambda c: c <= 255), F.concat_ws(".", *[F.pmod(F.shiftright(ip, s), F.lit(256).cast("long")).cast("string") for s in (24, 16, 8, 0)]))

    area, group, serial = F.substring(digits, 1, 3).cast("long"), F.substring(digits, 4, 2).cast("long"), F.substring(digits, 6, 4).cast("long")
    number = ((area - 1 - (area > 666).cast("long")) * 99 + group - 1) * 9999 + serial - 1
    new = feistel(number, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"), key, F.lit("ssn"), inverse)
    upper = F.call_function("div", new, F.lit(9999).cast("long"))
    area2 = F.call_function("div", upper, F.lit(99).cast("long")) + 1
    ssn_digits = F.concat(F.lpad((area2 + (area2 >= 666).cast("long")).cast("string"), 3, "0"), F.lpad((F.pmod(upper, F.lit(99).cast("long")) + 1).cast("string"), 2, "0"), F.lpad((F.pmod(new, F.lit(9999).cast("long")) + 1).cast("string"), 4, "0"))
    ssn = F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), _refilled(m, ssn_digits))

    country = F.when(digits.rlike("^[17]"), F.substring(digits, 1, 1)).when(F.substring(digits, 1, 2).isin(*COUNTRIES), F.substring(digits, 1, 2)).otherwise(F.substring(digits, 1, 3))
    national = F.substr(digits, F.length(country) + 1)
    moved_on = F.when((country == "1") & (F.length(national) == 10), _national(national, key, inverse)).otherwise(_permuted(national, 10, key, F.concat(F.lit("phone"), country), inverse))
    phone = F.when(n.between(7, 15) & (F.length(national) >= 4), _refilled(m, F.concat(country, moved_on)))
    home = _refilled(m, _national(digits, key, inverse))

    body = _permuted(F.substr(digits, F.lit(1), n - 1), 10, key, F.lit("card"), inverse)
    full = F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(body, d.cast("string"))), lambda c: F.call_function("luhn_check", c))
    card = F.when(n.between(13, 19) & F.call_function("luhn_check", digits), _refilled(m, F.element_at(full, 1)))

    kinds = {"email": mail, "iban": iban, "date": date, "ipv4": ipv4, "ssn": ssn, "phone": phone, "national": home, "card": card}
    chosen = F.when(F.lit(False), m)
    for kind, value in kinds.items():
        chosen = chosen.when(whole[kind], value)
    return F.coalesce(chosen, m)


def pseudonyms(df: DataFrame, key: str, text_col: str = "text", inverse: bool = False) -> DataFrame:
    """df with every valid value in text_col replaced by its pseudonym under the key."""
    if not key:
        raise ValueError("a key is needed")
    text, held = F.col(text_col), df.sparkSession.createDataFrame([(key,)], "key string").scalar()
    rows = df.withColumn("__key", held)
    changed = replaced(text, ANY, lambda m: pseudonym(m, F.col("__key"), inverse))
    return rows.withColumn(text_col, F.when(text.rlike("[0-9@]"), changed).otherwise(text)).drop("__key")
