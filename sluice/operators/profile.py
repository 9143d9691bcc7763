"""Profiles of all columns of a table (D)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import contact, dates, numbers
from ..sources.shared import stored

#: The patterns of a profile.
PATTERNS = {
    "email": r"(?i)^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "phone": r"^[\+\(\)\s\-\d]{7,20}$",
    "url": r"(?i)^https?://[^\s]+$",
    "currency": r"^[$€£¥]?\s*\d+([,.]\d{3})*([,.]\d{2})?$",
    "date_iso": r"^\d{4}-\d{2}-\d{2}$",
    "date_us": r"^\d{1,2}/\d{1,2}/\d{2,4}$",
    "date_eu": r"^\d{1,2}\.\d{1,2}\.\d{2,4}$",
}
BOOLS = (*numbers.TRUE, *numbers.FALSE)
INTEGRAL = ("tinyint", "smallint", "int", "bigint")
NUMERIC = (*INTEGRAL, "float", "double")


def ratio(condition: Column, of: Column) -> Column:
    """Share of the non-NULL values that meet a condition."""
    return F.round(F.try_divide(F.count_if(condition), F.count(of)), 6)


def long_form(row: DataFrame, columns: list[str], stats: list[str]) -> DataFrame:
    """One row of `<column>|<stat>` fields to one row per column."""
    structs = [F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}|{s}`").alias(s) for s in stats]) for c in columns]
    return row.select(F.explode(F.array(*structs)).alias("p")).select("p.*")


def aggregate(df: DataFrame, columns: list[str], stats: dict[str, callable]) -> DataFrame:
    """All stats of all columns in one aggregation over the table, one row per column."""
    row = df.agg(*[fn(F.col(f"`{c}`")).alias(f"{c}|{s}") for c in columns for s, fn in stats.items()])
    return long_form(row, columns, list(stats))


def _kind(kind: str) -> str:
    """How a column's cells are kept until they are distinct: whole, real, time, day or text."""
    return "whole" if kind in INTEGRAL else "real" if kind == "double" else "time" if kind.startswith("timestamp") and "ntz" not in kind else "day" if kind == "date" else "text"


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(at, whole, real, text, times): the distinct values of all columns, `at` the column's place.

    One scan turns a row into a row per column, in the columns' own types, so nothing is written out as
    text before values are distinct; the grouping counts within each task before it shuffles."""
    kinds = dict(df.dtypes)

    def cell(at: int, name: str):
        c, kind = F.col(f"`{name}`"), _kind(kinds[name])
        whole = c.cast("long") if kind == "whole" else F.unix_micros(c) if kind == "time" else F.unix_date(c).cast("long") if kind == "day" else F.lit(None).cast("long")
        return F.struct(F.lit(at).alias("at"), whole.alias("whole"), (c if kind == "real" else F.lit(None).cast("double")).alias("real"), (c.cast("string") if kind == "text" else F.lit(None).cast("string")).alias("text"))

    return df.select(F.inline(F.array(*[cell(i, x) for i, x in enumerate(columns)]))).groupBy("at", "whole", "real", "text").agg(F.count("*").alias("times"))


def _as_text(kinds: list[str]) -> Column:
    """A value as text."""
    at = lambda *of: F.col("at").isin([i for i, k in enumerate(kinds) if _kind(k) in of])
    return F.when(at("whole"), F.col("whole").cast("string")).when(at("real"), F.col("real").cast("string")).when(at("time"), F.timestamp_micros("whole").cast("string")).when(at("day"), F.date_from_unix_date(F.col("whole").cast("int")).cast("string")).otherwise(F.col("text"))


def _type(t: Column, kinds: list[str]) -> Column:
    """Aggregate: integer, float, boolean, date, string or null over distinct values; what a column's own
    type settles isn't asked of its values."""
    whole, real = (F.col("at").isin([i for i, k in enumerate(kinds) if _kind(k) == of]) for of in ("whole", "real"))
    asked = t.isNotNull() & ~whole & ~real
    every = lambda cond: F.bool_and(F.when(asked, cond))
    finite = F.bool_and(F.when(real & t.isNotNull(), ~F.isnan("real") & (F.abs("real") != float("inf"))))
    return (
        F.when(F.count(t) == 0, "null")
        .when(F.bool_or(whole), F.when(F.bool_and(F.when(t.isNotNull(), t.isin(*BOOLS))), "boolean").otherwise("integer"))
        .when(F.bool_or(real), F.when(finite, "float").otherwise("string"))
        .when(every(F.lower(t).isin(*BOOLS)), "boolean")
        .when(every(F.rlike(t, F.lit(r"^[+-]?\d+$"))), "integer")
        .when(every(F.rlike(t, F.lit(numbers.NUMBER))), "float")
        .when(every(F.rlike(t, F.lit(dates.SHAPE)) & dates.ladder(t).isNotNull()), "date")  # few values get to the ladder
        .otherwise("string")
    )


def inferred_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, type) of each column, from the distinct values of one scan."""
    kinds = [dict(df.dtypes)[c] for c in columns]
    found = value_counts(df, columns).groupBy("at").agg(_type(_as_text(kinds), kinds).alias("type"))
    return _of_columns(found, columns, {"type": F.lit("null")})


def _of_columns(found: DataFrame, columns: list[str], empty: dict[str, Column]) -> DataFrame:
    """found by column name, with the given values for the columns of a table without rows."""
    names = found.sparkSession.createDataFrame(list(enumerate(columns)), "at int, column string")
    return names.join(found, "at", "left").select("column", *[F.coalesce(c, empty[c]).alias(c) if c in empty else F.col(c) for c in found.columns if c != "at"])


def examples(counts: DataFrame, kinds: list[str], k: int, samples: int) -> DataFrame:
    """(at, top, sample): the k most frequent values with their counts, and the first values. Only so many
    rows per task and column are sent on to be ranked."""
    known = counts.select("at", _as_text(kinds).alias("value"), "times").where("value IS NOT NULL")
    rank = lambda *by: F.row_number().over(Window.partitionBy("at").orderBy(*by))
    top = known.withColumn("r", rank(F.desc("times"), "value")).where(F.col("r") <= k).groupBy("at").agg(F.array_sort(F.collect_list(F.struct("r", "value", "times"))).alias("top"))
    first = known.withColumn("r", rank("value")).where(F.col("r") <= samples).groupBy("at").agg(F.array_sort(F.collect_list("value")).alias("sample"))
    return top.join(first, "at").select("at", F.transform("top", lambda t: F.struct(t["value"].alias("value"), t["times"].alias("n"))).alias("top"), "sample")


def medians(counts: DataFrame) -> DataFrame:
    """(at, median) of numbers, exact: values are dealt by ranges, the sums of the ranges before one tell
    its ranks, and no task takes a whole column."""
    v = counts.select("at", F.coalesce(F.col("whole").cast("double"), "real").alias("v"), "times").where("v IS NOT NULL")
    dealt = stored(v.repartitionByRange("at", "v").withColumn("part", F.spark_partition_id()), "ranges")
    ranges = dealt.groupBy("at", "part").agg(F.sum("times").alias("n"))
    column = Window.partitionBy("at")
    ranges = ranges.select("at", "part", (F.sum("n").over(column.orderBy("part")) - F.col("n")).alias("start"), F.sum("n").over(column).alias("total"))
    running = dealt.join(ranges, ["at", "part"]).withColumn("upto", F.col("start") + F.sum("times").over(Window.partitionBy("at", "part").orderBy("v")))
    holds = lambda rank: (F.col("upto") >= rank) & (F.col("upto") - F.col("times") < rank)
    low, high = F.expr("(total + 1) div 2"), F.expr("total div 2 + 1")
    return running.where(holds(low) | holds(high)).groupBy("at").agg(((F.min("v") + F.max("v")) / 2).alias("median"))


def profile(df: DataFrame, columns: list[str] | None = None, top: int = 0, samples: int = 10, median: bool = False) -> DataFrame:
    """A row per column: rows, nulls, distinct, uniqueness, type, lengths, numeric stats (columns of
    numbers only), pattern ratios (those of 0.2 or more) and, with `top`, the most frequent values and a
    sample; `median` adds that of numbers. Exact, over every row.

    The table is read once; types and patterns are found once per distinct value and weighed by its
    count."""
    columns = columns or df.columns
    kinds = [dict(df.dtypes)[c] for c in columns]
    counts = value_counts(df, columns)
    if top or median:
        counts = stored(counts, "value-counts")
    times, t = F.col("times"), _as_text(kinds)
    valued = counts.withColumn("t", t)
    t = F.col("t")
    is_ = lambda of: F.col("at").isin([i for i, k in enumerate(kinds) if k in of])
    known = F.sum(F.when(t.isNotNull(), times).otherwise(0))
    # Text of numbers fits no other pattern.
    asked = {k: ~is_(NUMERIC) if k not in ("phone", "currency") else ~is_(("float", "double")) if k == "phone" else F.lit(True) for k in PATTERNS}
    shares = {k: F.round(F.try_divide(F.sum(F.when(asked[k] & F.rlike(t, F.lit(p)), times).otherwise(0)), F.when(F.bool_or(asked[k]), known)), 6) for k, p in PATTERNS.items()}
    number = F.when(is_(INTEGRAL), F.col("whole").cast("double")).when(is_(("double",)), F.col("real")).when(is_(("float",)), t.cast("double"))
    exact = F.when(is_(INTEGRAL), F.col("whole").cast("decimal(18,4)")).otherwise(number.cast("decimal(18,4)")).cast("decimal(28,4)") * times.cast("decimal(10,0)")
    row = valued.groupBy("at").agg(
        F.sum(times).alias("n"), F.coalesce(F.sum(F.when(t.isNull(), times)), F.lit(0)).alias("n_null"), F.count(t).alias("n_distinct"),
        F.round(F.try_divide(F.count(t), known), 6).alias("uniqueness"), _type(t, kinds).alias("type"), F.min(F.length(t)).alias("min_length"), F.max(F.length(t)).alias("max_length"),
        F.min(number).alias("min"), F.max(number).alias("max"), F.round(F.try_divide(F.sum(exact).cast("double"), known), 4).alias("mean"), *[r.alias(f"p_{k}") for k, r in shares.items()],
    )
    keep = lambda c: F.when(c >= 0.2, c)
    day = F.greatest("p_date_iso", "p_date_us", "p_date_eu")
    stats = ["n", "n_null", "n_distinct", "uniqueness", "type", "min_length", "max_length", "min", "max", "mean"]
    if median:
        row = row.join(medians(counts.where(is_(NUMERIC))), "at", "left")
        stats.append("median")
    out = row.select("at", *stats, *[keep(F.col(f"p_{k}")).alias(f"p_{k}") for k in ("email", "phone", "url", "currency")], keep(day).alias("p_date"))
    if top:
        out = out.join(examples(counts, kinds, top, samples), "at", "left")
    zero = F.lit(0).cast("long")
    return _of_columns(out, columns, {"n": zero, "n_null": zero, "n_distinct": zero, "type": F.lit("null")})


def suggest_field(profile: DataFrame) -> DataFrame:
    """column, field_type, size, required by a ladder of rules on a profile."""
    p = lambda k: F.coalesce(F.col(f"p_{k}"), F.lit(0.0))
    share = F.try_divide(F.col("n_distinct"), F.col("n"))
    kind = (
        F.when(p("email") > 0.8, "Char").when(p("phone") > 0.8, "Char").when(p("currency") > 0.8, "Monetary")
        .when(F.col("type") == "boolean", "Boolean").when(F.col("type") == "date", "Date").when((share < 0.05) & (F.col("n_distinct") <= 10), "Selection")
        .when(F.col("type") == "integer", "Integer").when(F.col("type") == "float", "Float").when(F.col("max_length") > 255, "Text").otherwise("Char")
    )
    size = F.when(p("email") > 0.8, 255).when(p("phone") > 0.8, 32).otherwise(F.least(F.greatest(F.col("max_length") + 50, F.lit(64)), F.lit(255)))
    return profile.select("column", kind.alias("field_type"), F.when(kind == "Char", size).cast("int").alias("size"), (F.try_divide(F.col("n_null"), F.col("n")) < 0.1).alias("required"))


def top_values(df: DataFrame, column: str, k: int = 100) -> DataFrame:
    """The k most frequent values, ties by value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(k)


def parse_ratios(c: Column) -> dict[str, Column]:
    """Aggregates: shares of values that parse as e-mail, phone or money."""
    return {"email": ratio(contact.email_rfc(c).isNotNull(), c), "phone": ratio(contact.phone_valid(c).isNotNull(), c), "currency": ratio(numbers.parse_decimal(c).isNotNull(), c)}


def cleaning_report(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Values changed per column."""
    both = before.select(key, *[F.col(c).alias(f"{c}|before") for c in columns]).join(after.select(key, *[F.col(c).alias(f"{c}|after") for c in columns]), key)
    row = both.agg(*[F.count_if(~F.col(f"`{c}|before`").eqNullSafe(F.col(f"`{c}|after`"))).alias(f"{c}|changed") for c in columns])
    return long_form(row, columns, ["changed"])


def sampled_type(df: DataFrame, column: str, order: str, n: int = 10) -> DataFrame:
    """boolean if all values are such words, else date or currency if over 0.7 of the first n parse."""
    t = F.col(column).cast("string")
    words = df.agg(F.bool_and(F.lower(t).isin(*BOOLS)).alias("bools"))
    first = df.where(t.isNotNull()).orderBy(order).limit(n).agg(ratio(dates.ladder(t).isNotNull(), t).alias("dates"), ratio(numbers.parse_decimal(t).isNotNull(), t).alias("money"))
    kind = F.when(F.col("bools"), "boolean").when(F.col("dates") > 0.7, "date").when(F.col("money") > 0.7, "currency").otherwise("string")
    return words.crossJoin(first).select(F.lit(column).alias("column"), kind.alias("type"))


def ranked(df: DataFrame, by: str, score: str, tie: str, k: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
