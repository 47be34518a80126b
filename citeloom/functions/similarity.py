"""Similarity measures of titles, names and records."""

from __future__ import annotations

from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as t


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one bit of an integer for each character of ``a``."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def token_set_score(both: str, p: str, q: str) -> float:
    """0 to 100: the best insertion-deletion similarity among the common tokens and the two sides
    with them; arguments are the common tokens and those of each side alone, sorted."""
    joint = 1 if both else 0
    left, right = len(both) + joint + len(p), len(both) + joint + len(q)
    out = 100 * 2 * (len(both) + joint + _common_subsequence(p, q)) / (left + right)
    if both:
        out = max(out, 100 * (1 - (joint + len(p)) / (len(both) + left)), 100 * (1 - (joint + len(q)) / (len(both) + right)))
    return out


@cache
def _token_set_ratio():
    def ratio(both: pd.Series, p: pd.Series, q: pd.Series) -> pd.Series:
        seen: dict[tuple, float] = {}

        def one(*sides) -> float | None:
            if sides[1] is None:
                return None
            if sides not in seen:
                seen[sides] = token_set_score(*sides)
            return seen[sides]

        return pd.Series([one(*x) for x in zip(both, p, q)], dtype="float64")

    return F.pandas_udf(ratio, "double")


def _with_sides(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """``rows`` with the common tokens of two arrays (__both), those of each side alone (__p, __q), and whether built-in
    functions leave the ratio open (__open): both sides have tokens, and none contains the other."""
    tokens = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))
    rows = rows.withColumns({"__x": tokens(a), "__y": tokens(b)})
    x, y, both, p, q = (F.col(c) for c in ("__x", "__y", "__both", "__p", "__q"))
    join = lambda c: F.array_join(c, " ")
    rows = rows.withColumns({"__both": join(F.array_intersect(x, y)), "__p": join(F.array_except(x, y)), "__q": join(F.array_except(y, x)), "__none": (F.size(x) == 0) | (F.size(y) == 0)})
    contained = (both != "") & ((p == "") | (q == ""))
    return rows.withColumn("__open", ~F.col("__none") & ~contained).drop("__x", "__y")


def _most() -> Column:
    """Upper bound of the ratio of open sides: the shorter side's own tokens are a subsequence of the other's."""
    n, p, q = (F.length(c) for c in ("__both", "__p", "__q"))
    common, joint = F.least(p, q), F.when(n > 0, 1).otherwise(0)
    left, right = n + joint + p, n + joint + q
    with_one = F.when(n > 0, F.greatest(100 * (1 - (joint + p) / (n + left)), 100 * (1 - (joint + q) / (n + right))))
    return F.round(F.greatest(200.0 * (n + joint + common) / (left + right), F.coalesce(with_one, F.lit(0.0))), 6)


def _decided(otherwise: Column) -> Column:
    return F.when(F.col("__none"), 0.0).when(~F.col("__open"), 100.0).otherwise(otherwise)


def with_ratio(rows: DataFrame, name: str, a: Column, b: Column, asked: Column | None = None, least: float = 0.0) -> DataFrame:
    """``rows`` with the token-set ratio of two arrays of tokens, rounded to six places; null where it is not ``asked`` for,
    or where lengths show that it is under ``least``. The sides are columns of
    their own on the way, so that nothing is worked out twice. What needs no subsequence is decided by built-in
    functions: no tokens on a side (0), equal sides or one that contains the other (100); for those, and where the
    answer is null, Python is given nulls. Pairs that repeat in a batch are scored once."""
    rows = _with_sides(rows.withColumn("__asked", F.lit(True) if asked is None else F.coalesce(asked, F.lit(False))), a, b)
    if least > 0:
        rows = rows.withColumn("__asked", F.col("__asked") & (_decided(_most()) >= least))
    given = lambda c: F.when(F.col("__asked") & F.col("__open"), F.col(c))
    rows = rows.withColumn("__score", _token_set_ratio()(given("__both"), given("__p"), given("__q")))
    score = F.when(F.col("__asked"), _decided(F.round(F.col("__score"), 6)))
    return rows.withColumn(name, score).drop("__both", "__p", "__q", "__none", "__open", "__asked", "__score")


def with_title_ratio(rows: DataFrame, name: str, a: Column, b: Column, asked: Column | None = None, least: float = 0.0) -> DataFrame:
    return with_ratio(rows, name, t.title_tokens(a), t.title_tokens(b), asked, least)


def surname_overlap(a: Column, b: Column) -> Column:
    """Common surnames among the smaller number of them; 0 where one side has none."""
    return overlap(t.surnames(a), t.surnames(b))


def overlap(x: Column, y: Column) -> Column:
    """``surname_overlap`` of surnames that are normalised already."""
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(F.lit(0.0))


def year_score(cited: Column, year: Column) -> Column:
    return F.when(cited.isNull(), 60).when(cited == year, 100).when(F.abs(cited - year) <= 1, 70).otherwise(50)


def close_years(a: Column, b: Column) -> Column:
    return a.isNull() | b.isNull() | (F.abs(a - b) <= 1)


def same_doi(a: Column, b: Column) -> Column:
    return ~t.missing(a) & ~t.missing(b) & (F.lower(t.text(a)) == F.lower(t.text(b)))


def record_score(ref: dict[str, Column], work: dict[str, Column], title_score: Column, common: Column, titled: Column) -> Column:
    """Weighted agreement of a reference and a record (year and doi of each), 0 to 96.5; ``common`` is the overlap of their
    surnames, null where the reference has no authors; ``titled`` says whether both have titles."""
    names = F.coalesce(common * 100, F.lit(60.0))
    total = 0.55 * title_score + 0.25 * names + 0.15 * year_score(ref["year"], work["year"]) + 0.05 * F.when(same_doi(ref["doi"], work["doi"]), 30).otherwise(0)
    sandbox = ~t.missing(work["doi"]) & ~t.real_doi(work["doi"])
    total = total - F.when(sandbox, 15).otherwise(0)
    return F.when(~titled, 0.0).otherwise(F.round(total, 6))
