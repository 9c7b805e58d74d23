"""Secrets in text, told from examples by how widely each value is owned across the corpus.

Base kinds, each leftmost and non-overlapping, the match first and its length tested after:
assign, a named value of 8 or more characters; access, AKIA and 12 or more capitals and digits; hex,
32 or more digits a-f. All of them are kept. Further candidates are of kind issued, with the prefix
of a known issuer, and mixed, 24 or more characters of three classes outside any other span.

Each candidate's value is hashed; the hashes are counted by distinct repositories and distinct owners
over all rows (repeats in one repository are merged first, so a value that a third of the rows hold is
one row a repository). A value in at least `repositories` of the former and `owners` of the latter is
a widely copied example, any other is live. Live issued and mixed candidates are added to the base;
widely copied ones aren't.

DataFrame functions only. The first pass writes a row for each document, without its text unless it
is asked for; only documents with candidates are exploded, joined and grouped again, by a row number
that the written table holds. Values that very many spans have meet their count by broadcast. Null and
empty texts have no spans. A null repository is one of its own. Very long texts are searched whole, in
linear time. Repeated rows each get their row; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spantail.llm.common import joined_hot, others, written
from spantail.llm.native import cut, matches, merged

#: Kinds in the order in which spans of one start are listed: pattern, group that is the value, its least length.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
#: Prefixes by which issuers mark their credentials.
ADDED = {
    "issued": (r"(?<![A-Za-z0-9_-])(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 0, 1),
    "mixed": (r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{24,}", 0, 24),
}
KINDS = [*BASE, *ADDED]
SPAN = "array<struct<start:int,kind:int,end:int,hash:string>>"


def _spans(text: Column, kind: str) -> Column:
    pattern, group, least = (BASE | ADDED)[kind]
    found = F.filter(matches(text, pattern, group), lambda m: F.length(m["value"]) >= least)
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end"), F.sha2(m["value"], 256).alias("hash")))


def candidates(df: DataFrame, text_col: str = "text", repo_col: str = "source", owner: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """A written table of the rows of df: `keep`, row, repo, owner, base and more (spans in order)."""
    kept = df.columns if keep is None else keep
    repo = F.coalesce(F.col(repo_col).cast("string"), F.lit(""))
    owner = F.regexp_extract(repo, "^[^/]*", 0) if owner is None else owner
    text = F.col(text_col)
    found = df.select(*kept, repo.alias("__repo"), owner.alias("__owner"), *[_spans(text, k).alias(f"__{k}") for k in KINDS])
    base = F.array_sort(F.concat(*[f"__{k}" for k in BASE]))
    found = found.select(*kept, "__repo", "__owner", base.alias("__base"), F.concat(*[f"__{k}" for k in ADDED]).alias("__more"))
    more = F.filter("__more", lambda m: ~F.exists("__base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return written(found.withColumn("__more", more).withColumn("__row", F.monotonically_increasing_id()), "candidates")[0]


def owned(found: DataFrame) -> DataFrame:
    """hash, repositories, owners and n (spans) of each candidate value in a table of candidates."""
    spans = found.select("__repo", "__owner", F.explode(F.concat("__base", "__more")).alias("s"))
    once = spans.groupBy(F.col("s.hash").alias("hash"), "__repo", "__owner").agg(F.count("*").alias("n"))
    return once.groupBy("hash").agg(F.count_distinct("__repo").alias("repositories"), F.count_distinct("__owner").alias("owners"), F.sum("n").alias("n"))


def secrets(df: DataFrame, text_col: str = "text", repo_col: str = "source", owner: Column | None = None, keep: list[str] | None = None, repositories: int = 5, owners: int = 4) -> DataFrame:
    """The columns `keep` of df (all, if None) and base and spans: array<struct<start, end, kind, live>> in order, by start and kind.

    A column of df named base or spans is replaced.
    """
    kept = others(df.columns if keep is None else keep, "base", "spans")
    found = candidates(df.select(*{*kept, text_col, repo_col}), text_col, repo_col, owner, kept)
    wide, _ = written(owned(found).where((F.col("repositories") >= repositories) & (F.col("owners") >= owners)).select("hash", "n", F.lit(True).alias("wide")), "wide")
    with_some = F.size("__base") + F.size("__more") > 0
    one = found.where(with_some).select("__row", F.explode(F.concat("__base", "__more")).alias("s")).select("__row", "s.*")
    judged = joined_hot(one, wide, "hash", "left").select("__row", "start", "kind", "end", F.col("wide").isNull().alias("live"))
    stay = (F.col("kind") < len(BASE)) | F.col("live")
    again = judged.where(stay).groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "live"))).alias("__all"))
    found_some = found.where(with_some).join(again, "__row", "left")
    every = F.coalesce("__all", F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean>>"))
    rows = found_some.select(*kept, every.alias("__all")).unionAll(found.where(~with_some).select(*kept, F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean>>").alias("__all")))
    names = F.array(*map(F.lit, KINDS))

    def named(spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(names, s["kind"] + 1).alias("kind"), s["live"].alias("live")))

    return rows.select(*kept, named(F.filter("__all", lambda s: s["kind"] < len(BASE))).alias("base"), named(F.col("__all")).alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def without_live_text(text_col: str = "text", spans_col: str = "spans", instead: str = "[SECRET]") -> Column:
    """The text with the live spans of secrets() replaced, those that touch as one."""
    return cut(F.col(text_col), merged(F.filter(spans_col, lambda s: s["live"])), instead)
