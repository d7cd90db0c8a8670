"""Column helpers with the null rules of the whole engine: a missing value is NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F


def or_else(name: str | Column, default) -> Column:
    """The value, or the default where it is missing."""
    return F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit(default))


def first_truthy(*columns: str | Column) -> Column:
    """The first value that is neither missing nor zero; zero if there is none."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.coalesce(*[F.when(c != 0, c) for c in cols], F.lit(0.0))


def ratio(top: Column, bottom: Column, default=None) -> Column:
    """top / bottom where bottom is positive, else the default (missing, if none is given)."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(default).cast("double"))


def known(c: str | Column) -> Column:
    """A double whose NaN is NULL."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.nanvl(c, F.lit(None).cast("double"))


def full(value: Column, counted: str | Column, n: int, window: WindowSpec) -> Column:
    """A window value that is NULL until the frame holds n values."""
    return F.when(F.count(counted).over(window) == n, value)


def listed(*items: Column) -> Column:
    """An array of the items that are not NULL, in order."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def said(condition: Column, text: str) -> Column:
    return F.when(condition, F.lit(text))


def mentions(items: Column, word: str) -> Column:
    """How many strings of an array contain the word, in any case."""
    return F.size(F.filter(items, lambda s: F.lower(s).contains(word)))


def _digits(value: Column, digits: int) -> Column:
    """The absolute value of a double under 2 ** 53 as text, rounded from its exact binary value.

    With e the exponent, the double is m / 2 ** s for whole m and s = 52 - e; times 100 it still fits into a long.
    From s = 61 on it is under a half of the last decimal.
    """
    e = F.floor(F.log2(value))
    e = F.when(F.pow(F.lit(2.0), e) > value, e - 1).when(F.pow(F.lit(2.0), e + 1) <= value, e + 1).otherwise(e)
    s = F.greatest(F.lit(0), F.lit(52) - e).cast("int")
    scaled = (value * F.pow(F.lit(2.0), F.least(s, F.lit(62)))).cast("bigint") * (10**digits)
    bit = F.least(s, F.lit(61))
    # shifts by a column are SQL's only
    whole, unit = F.call_function("shiftright", scaled, bit), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    rest = scaled - F.call_function("shiftleft", whole, bit)
    up = (rest * 2 > unit) | ((rest * 2 == unit) & (whole % 2 == 1))
    n = F.when((value == 0) | (s >= 61), F.lit(0).cast("bigint")).otherwise(whole + up.cast("bigint"))
    if digits == 0:
        return n.cast("string")
    text = F.lpad(n.cast("string"), digits + 1, "0")
    text = F.when(F.length(n.cast("string")) > digits, n.cast("string")).otherwise(text)
    return F.concat(F.substring(text, F.lit(1), F.length(text) - digits), F.lit("."), F.substring(text, -digits, digits))


def _large(value: Column) -> Column:
    """All digits of a whole double from 2 ** 53 on: its mantissa in limbs of nine digits, doubled as often as the exponent says."""
    e = F.floor(F.log2(value))
    e = F.when(F.pow(F.lit(2.0), F.least(e, F.lit(1023))) > value, e - 1).when((e < 1023) & (F.pow(F.lit(2.0), F.least(e + 1, F.lit(1023))) <= value), e + 1).otherwise(e)
    twos = (F.least(e, F.lit(1023)) - 52).cast("int")
    mantissa = (value / F.pow(F.lit(2.0), twos)).cast("bigint")
    base = 10**9
    limbs = F.array(mantissa % base, ((mantissa - mantissa % base) / F.lit(base)).cast("bigint"))

    def times(limbs: Column, by: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("carry"), F.array().cast("array<bigint>").alias("out"))

        def step(state: Column, limb: Column) -> Column:
            x = limb * by + state["carry"]
            return F.struct(((x - x % base) / F.lit(base)).cast("bigint").alias("carry"), F.concat(state["out"], F.array(x % base)).alias("out"))

        return F.aggregate(limbs, start, step, lambda state: F.concat(state["out"], F.array(state["carry"])))

    rounds = F.sequence(F.lit(0), F.floor(twos / F.lit(20)).cast("int"))
    grown = F.aggregate(rounds, limbs, lambda limbs, k: times(limbs, F.pow(F.lit(2.0), F.least(F.lit(20), twos - k * 20)).cast("bigint")))
    text = F.array_join(F.transform(F.reverse(grown), lambda x: F.lpad(x.cast("string"), 9, "0")), "")
    return F.ltrim(text, F.lit("0"))


def fixed(value: Column, digits: int, after: str = "") -> Column:
    """A number as text with so many decimals (up to two), as its exact binary value rounds; an exact half goes to the even digit.

    The sign stays on what rounds to zero; what is no number reads nan, inf or -inf.
    """
    if not 0 <= digits <= 2:
        raise ValueError("up to two decimals")
    x = value.cast("double")

    def text(x: Column) -> Column:
        size = F.abs(x)
        zeros = "." + "0" * digits if digits else ""
        number = F.when(size < 2.0**53, _digits(size, digits)).otherwise(F.concat(_large(size), F.lit(zeros)))
        sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
        shown = F.when(F.isnan(x), "nan").when(size == float("inf"), F.concat(sign, F.lit("inf"))).otherwise(F.concat(sign, number))
        return F.concat(shown, F.lit(after))

    return F.transform(F.array(x), lambda v: F.when(v.isNotNull(), text(v)))[0]


def percent(value: Column, digits: int = 1) -> Column:
    """A share as text in percent."""
    return fixed(value * 100, digits, "%")


def rounded(df: DataFrame, digits: int = 7) -> DataFrame:
    """Doubles (also in arrays) rounded, for results that are compared; -0.0 becomes 0.0."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "double":
            c = (F.round(c, digits) + F.lit(0.0)).alias(name)
        elif kind == "array<double>":
            c = F.transform(c, lambda x: F.round(x, digits) + F.lit(0.0)).alias(name)
        out.append(c)
    return df.select(*out)
