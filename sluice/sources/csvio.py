"""CSV sources and sinks, lookup exports, seeds, records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CSV = {"header": True, "emptyValue": "", "escape": '"', "lineSep": "\n", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def all_string(df: DataFrame) -> DataFrame:
    """Every column as text, so that types are inferred from what was written."""
    return df.select([F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.options(**CSV).csv(path)


def read_csv(spark: SparkSession, path: str, types: dict[str, str]) -> DataFrame:
    """A CSV with a header: fields are text first, then cast; what doesn't parse is NULL, and so are
    fields that a ragged line lacks."""
    text = spark.read.schema(", ".join(f"`{c}` string" for c in types)).csv(path, header=True, escape='"', mode="PERMISSIVE")
    return text.select([F.expr(f"try_cast(`{c}` AS {t})").alias(c) for c, t in types.items()])


def read_csv_raw(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Lines of a CSV without a header: file, and columns column_1 to column_<width> of text."""
    schema = ", ".join(f"column_{i + 1} string" for i in range(width))
    return spark.read.schema(schema).csv(path, header=False, escape='"').withColumn("file", F.col("_metadata.file_path"))


def emit(df: DataFrame, headers: list[str], path: str, single: bool = False) -> None:
    """The deterministic CSV: text only, NULL as nothing, exactly these headers, ordered by id.

    Ordered part files of id ranges; `single` gives one file, for tables that one task can sort.
    """
    t = df.select([F.coalesce(F.col(f"`{h}`").cast("string"), F.lit("")).alias(h) for h in headers])
    ordered = t.orderBy("id").coalesce(1) if single else t.repartitionByRange("id").sortWithinPartitions("id")
    write_csv(ordered, path)


def seed_table(spark: SparkSession, seeds: dict[str, dict]) -> DataFrame:
    """(seed, alias, canonical_id, kind) of vocabularies; nested ones are named file_key."""
    rows = []
    for name, content in seeds.items():
        nested = {name: content} if "canonical" in content else {f"{name}_{k}": v for k, v in content.items()}
        for seed, part in nested.items():
            rows += [(seed, a, i, "canonical") for a, i in part["canonical"].items()]
            rows += [(seed, a, i, "synonym") for a, i in part.get("synonyms_map", {}).items()]
    return spark.createDataFrame(rows, "seed string, alias string, canonical_id string, kind string")


def to_records(df: DataFrame, model: str) -> DataFrame:
    """One JSON record per row, without NULL fields, with its model."""
    return df.select(F.to_json(F.struct(F.lit(model).alias("model"), *[F.col(f"`{c}`") for c in df.columns])).alias("record"))


def export_lookup(df: DataFrame, column: str, delimiter: str, table: str) -> DataFrame:
    """(source_key, external_id) of the distinct trimmed parts of a multi-value column."""
    parts = df.select(F.explode(F.split(F.col(column), rf"\Q{delimiter}\E")).alias("v")).select(F.trim("v").alias("source_key")).where("source_key <> ''").distinct()
    return parts.select("source_key", F.concat(F.lit(f"migr.{table}."), F.regexp_replace("source_key", r"[^a-zA-Z0-9_.-]", "_")).alias("external_id"))
