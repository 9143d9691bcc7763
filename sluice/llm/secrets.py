"""Secret scans with multipart credential linking (operator 8)."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import by_batch, checked_broadcast, saved, table, tune

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Weak candidates, reported only beside what they belong to.
KEY = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])")
ENDPOINT = re.compile(r"https?://[^\s\"'<>|]{4,}")
USER = re.compile(r"(?<![A-Za-z0-9_])(?:user(?:name)?|login|client_id|account)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.@-]{3,})", re.I | re.A)

KINDS = ("assign", "access", "hex", "key", "endpoint", "user")
#: Parts are of one scope if at most this many code points lie between them.
SCOPE = 400
BIN = 4096

SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base string, text_key string, parts array<struct<kind:string,start:int,end:int>>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def weak_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("key", *m.span()) for m in KEY.finditer(text) if re.search(r"[A-Z]", m[0]) and re.search(r"[a-z]", m[0]) and re.search(r"\d", m[0])]
    if "://" in text:
        found += [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
    return found + [("user", *m.span(1)) for m in USER.finditer(text)]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        text = text or ""
        base = base_spans(text)
        # Weak parts matter only beside strong ones: an access identifier or an assigned secret, or each other.
        weak = weak_spans(text)
        kinds = [k for k, _, _ in base]
        as_text = joined(base)
        parts = [s for s in base if s[0] != "hex"] + weak if weak else []
        rows.append((doc_id, kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(as_text.encode()).hexdigest(), as_text, hashlib.md5(text.encode()).hexdigest() if parts else None, [{"kind": k, "start": a, "end": b} for k, a, b in parts]))
    types = [pa.int64()] * 4 + [pa.string()] * 3 + [pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))]
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "text_key", "parts"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def linked_parts(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Interval join of parts within a scope: (doc_id, text_key, links), the weak spans that count.

    A pair counts when its kinds complement each other: an identifier (access, user) with a secret
    (key, assign), or an endpoint with either. Parts lie in bins of positions; each weak part looks
    into its own bins and those within the scope, so the join is on (document, bin) and then by
    distance. A weak part is reported when it has both complements: a key its identifier, a user its
    secret, an endpoint an identifier and a secret.
    """
    one = scanned.where(F.size("parts") > 1).select("doc_id", "text_key", "parts").distinct()
    parts = one.select("doc_id", "text_key", F.explode("parts").alias("p")).select("doc_id", "text_key", "p.kind", "p.start", "p.end")
    role = F.when(F.col("kind").isin("access", "user"), "id").when(F.col("kind").isin("key", "assign"), "secret").otherwise("endpoint")
    parts = parts.withColumn("role", role)
    near = parts.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor(F.col("end") / BIN)))).select("doc_id", "text_key", "bin", F.col("role").alias("other"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    weak = parts.where(F.col("kind").isin("key", "endpoint", "user"))
    weak = weak.withColumn("bin", F.explode(F.sequence(F.floor(F.greatest(F.col("start") - scope, F.lit(0)) / BIN), F.floor((F.col("end") + scope) / BIN))))
    near = near.withColumnsRenamed({"doc_id": "_d", "text_key": "_t", "bin": "_b"})
    here = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_t")) & (F.col("bin") == F.col("_b"))  # a null id is an id here
    pairs = weak.join(near, here).where((F.col("s2") <= F.col("end") + scope) & (F.col("e2") >= F.col("start") - scope) & (F.col("role") != F.col("other")))
    linked = pairs.groupBy("doc_id", "text_key", "kind", "start", "end", "role").agg(F.collect_set("other").alias("others"))
    has = lambda r: F.array_contains("others", r)
    linked = linked.where(((F.col("role") == "secret") & has("id")) | ((F.col("role") == "id") & has("secret")) | ((F.col("role") == "endpoint") & has("id") & has("secret")))
    return linked.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("links"))


def _spans(base: str = "base", links: str = "links"):
    """Base and linked spans in one text, by start and then kind as listed."""
    order = F.array(*map(F.lit, KINDS))
    part = F.transform(F.filter(F.split(F.col(base), ","), lambda s: s != ""), lambda s: F.struct(F.split(s, ":")[1].cast("int").alias("start"), F.array_position(order, F.split(s, ":")[0]).cast("int").alias("rank"), F.split(s, ":")[2].cast("int").alias("end")))
    more = F.transform(F.coalesce(F.col(links), F.array().cast("array<struct<kind:string,start:int,end:int>>")), lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).cast("int").alias("rank"), s["end"].alias("end")))
    return F.array_join(F.transform(F.array_sort(F.concat(part, more)), lambda s: F.concat_ws(":", F.element_at(order, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Secrets in whole texts: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null text counts as empty; empty texts have no spans (spans is '', base_sha256 that of ''). Rows
    that repeat a doc_id each keep their own result, and so do rows with a null doc_id; other columns
    are ignored; an empty table gives no rows.
    """
    tune(docs.sparkSession)
    scanned = saved(by_batch(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _scan, SCANNED), "secrets")
    links = saved(linked_parts(scanned, scope), "secret-links")
    plain = scanned.where(F.size("parts") <= 1).withColumn("links", F.lit(None).cast("array<struct<kind:string,start:int,end:int>>"))
    l = links.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t"), "links")  # noqa: E741
    multi = scanned.where(F.size("parts") > 1).join(l, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_t")), "left").drop("_d", "_t")
    return plain.unionByName(multi).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", _spans().alias("spans"))


def _cleaned(text: str | None, links: list[dict] | None) -> str | None:
    if not text:
        return text
    spans = base_spans(text) + [(x["kind"], x["start"], x["end"]) for x in links or ()]
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def redacted(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """docs with every span that scan_secrets finds in text replaced by its kind in brackets.

    All rows and columns stay; n_chars, if there is one, is counted anew. Null texts stay null.
    """
    tune(docs.sparkSession)
    scanned = by_batch(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _scan, SCANNED).where(F.size("parts") > 1)
    links = saved(linked_parts(saved(scanned.drop("base"), "secret-parts"), scope), "secret-links").select(F.col("doc_id").alias("of"), "text_key", "links")

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(_cleaned, batch.column(1).to_pylist(), batch.column(2).to_pylist()), pa.string())], ["row", "clean"])

    d = docs.select(F.struct(*docs.columns).alias("row"))
    d = d.join(checked_broadcast(links), F.col("row.doc_id").eqNullSafe(F.col("of")) & (F.md5("row.text") == F.col("text_key")), "left")
    d = by_batch(d.select("row", F.col("row.text").alias("text"), "links"), clean, StructType([d.schema["row"], StructField("clean", StringType())]))
    new = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return d.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
