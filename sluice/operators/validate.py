"""Row validation: one pass, one error per row (V), and the ledger of decisions (W)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contact, dates, text

#: Error codes in the order of checks, quarantine reasons, actions by severity.
NORMALIZERS = {"email": ("INVALID_EMAIL", contact.email_rfc), "phone": ("INVALID_PHONE", contact.phone_us), "date": ("DATE_PARSE_FAIL", dates.normalize_any)}
REASONS = ("missing_reference", "vocab_unknown", "validation_failed", "multi_match", "low_confidence", "exception")
SEVERITY = {"blocker": "abort", "critical": "critical", "error": "quarantine", "warning": "warn"}


def error(code: str, field: str, hint: str, bad: Column) -> Column:
    """A check's outcome: a struct where the row is bad, else NULL."""
    value = F.create_map(F.lit(field), text.blank(F.col(field).cast("string")))
    return F.when(bad, F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"), F.lit(hint).alias("hint"), F.to_json(value).alias("offending")))


def required(field: str) -> Column:
    return error("REQ_MISSING", field, "required", F.col(field).isNull())


def normalizable(field: str, kind: str) -> Column:
    code, normalize = NORMALIZERS[kind]
    return error(code, field, kind, (text.blank(F.col(field)) != "") & normalize(F.col(field)).isNull())


def known(field: str, found: Column, optional: bool = False) -> Column:
    blank = text.blank(F.col(field)) == ""
    return error("ENUM_UNKNOWN", field, "vocabulary", found.isNull() & (~blank if optional else F.lit(True)))


def has_parent(field: str, found: Column) -> Column:
    return error("FK_UNRESOLVED", field, "parent", (text.blank(F.col(field).cast("string")) != "") & found.isNull())


def validated(df: DataFrame, checks: list[Column]) -> DataFrame:
    """df with error, the first failing check's, computed in one projection."""
    return df.withColumn("error", F.coalesce(*checks))


def valid_rows(df: DataFrame) -> DataFrame:
    return df.where("error IS NULL").drop("error")


def exceptions(df: DataFrame, pointer: str = "source_ptr") -> DataFrame:
    return df.where("error IS NOT NULL").select(pointer, F.col("error.code").alias("error_code"), "error.field", "error.hint", "error.offending")


def quarantine(df: DataFrame, key: str, reason: Column) -> DataFrame:
    """Ledger rows of what waits for a decision."""
    return df.select(F.col(key).cast("string").alias("source_key"), F.lit("quarantined").alias("action"), reason.alias("reason"))


def resolve_quarantine(ledger: DataFrame, decisions: DataFrame) -> DataFrame:
    """A new version of the ledger: decisions change quarantined rows only."""
    action = F.when(F.col("decision").isin("approve", "fix", "create_new"), "created").when(F.col("decision").isin("match", "merge"), "matched").when(F.col("decision").isin("reject", "skip"), "skipped")
    out = ledger.join(decisions, "source_key", "left")
    return out.withColumn("action", F.when(F.col("action") == "quarantined", F.coalesce(action, F.col("action"))).otherwise(F.col("action"))).drop("decision")
