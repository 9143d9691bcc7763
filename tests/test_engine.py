"""Properties of whole operators: determinism, conservation, edge cases."""

import hashlib
from pathlib import Path

from pyspark.sql import functions as F

from sluice.operators import profile, reshape, resolve, validate
from sluice.plans import validation
from sluice.sources import csvio
from sluice.sources.shared import fresh_path
from tests.oracle import DATA


def _bytes(path):
    parts = sorted(Path(path.removeprefix("file:").replace("//", "/")).glob("part-*"))
    return hashlib.sha256(b"".join(p.read_bytes() for p in parts)).hexdigest()


def test_emit_is_byte_identical(spark):
    rows = spark.createDataFrame([("b", "x,y", None), ("a", 'q"z', ""), ("c", " lead ", "é")], "id string, name string, email string")
    paths = []
    for n in (1, 3):
        paths.append(fresh_path(spark, "twice"))
        csvio.emit(rows.repartition(n), ["id", "name", "email"], paths[-1], single=True)
    assert _bytes(paths[0]) == _bytes(paths[1])
    text = next(Path(paths[0].removeprefix("file:").replace("//", "/")).glob("part-*")).read_text()
    assert text == 'id,name,email\na,"q""z",\nb,"x,y",\nc, lead ,é\n'


def test_valid_and_exceptions_are_all_rows(spark):
    rows = validation.checked(spark, DATA)
    assert validate.valid_rows(rows).count() + validate.exceptions(rows).count() == rows.count()


def test_first_failing_check_wins(spark):
    rows = spark.createDataFrame([("1", None, "not-an-email"), ("2", "n", "not-an-email"), ("3", "n", "a@b.co")], "source_ptr string, name string, email string")
    out = validate.exceptions(validate.validated(rows, [validate.required("name"), validate.normalizable("email", "email")]))
    assert {(r.source_ptr, r.error_code) for r in out.collect()} == {("1", "REQ_MISSING"), ("2", "INVALID_EMAIL")}


def test_pointer_counts_in_order(spark):
    rows = spark.range(100).select((F.col("id") * 7 % 100).alias("k"))
    out = reshape.attach_pointer(rows, "k", n=5).collect()
    assert {r.source_ptr: r.k for r in out} == {f"row_{i}": i for i in range(100)}


def test_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, None), (6, 6)], "node long, parent long")
    assert {r.node for r in resolve.cycles(edges).collect()} == {1, 2, 3, 6}


def test_cycles_of_any_length(spark):
    ring = [(i, (i + 1) % 150) for i in range(150)]
    tail = [(200 + i, 199 + i if i else 7) for i in range(90)]
    chain = [(400 + i, 401 + i) for i in range(100)]
    edges = spark.createDataFrame(ring + tail + chain, "node long, parent long")
    assert {r.node for r in resolve.cycles(edges).collect()} == set(range(150))
    assert resolve.cycles(edges.where("node >= 400")).collect() == [] and resolve.cycles(edges.limit(0)).collect() == []


def test_profile_of_an_empty_table(spark):
    out = profile.profile(spark.createDataFrame([], "a string, b int")).collect()
    assert {(r.column, r.n, r.type) for r in out} == {("a", 0, "null"), ("b", 0, "null")}


def test_mapping_keeps_confirmed_columns_only(spark):
    rows = spark.createDataFrame([("1", " A ", "x")], "source_ptr string, Name string, Other string")
    out = reshape.apply_mapping(rows, [{"source": "Name", "target": "name", "transforms": ["trim"]}, {"source": "Other", "target": "o", "confirmed": False}], {"lang": "en"})
    assert out.columns == ["source_ptr", "name", "lang"] and tuple(out.first()) == ("1", "A", "en")


def test_upsert_labels(spark):
    s = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    t = spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "k int, v string")
    assert {(r.k, r.v, r.op) for r in resolve.upsert(s, t, "k").collect()} == {(1, "a", "create"), (2, "b", "update"), (3, None, "skip"), (4, "d", "keep")}
