"""Entity resolution and profiles against plain Python."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from sluice.operators import entities, profile


def jaro_winkler(a, b):
    if a == b:
        return 1.0
    reach, used, left = max(max(len(a), len(b)) // 2 - 1, 0), set(), []
    for i, x in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in used and b[j] == x), None)
        if j is not None:
            used.add(j)
            left.append(x)
    if not left:
        return 0.0
    m, right = len(left), [b[j] for j in sorted(used)]
    jaro = (m / len(a) + m / len(b) + (m - sum(x != y for x, y in zip(left, right)) // 2) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def names(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcé o😀") for _ in range(rng.choice((0, 1, 2, 5, 9, 30)))) for _ in range(n)]


def test_jaro_winkler_of_a_batch(spark):
    pairs = [*zip(names(1, 400), names(2, 400)), ("martha", "marhta"), ("dwayne", "duane"), ("x", None), (None, "y"), ("", ""), ("same", "same")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", entities.jaro_winkler("a", "b").alias("s"), entities.jaro_winkler_bound(F.col("a"), F.col("b")).alias("most")).collect()
    for r in got:
        if r.a is None or r.b is None:
            assert r.s is None
        else:
            assert r.s == pytest.approx(jaro_winkler(r.a, r.b), abs=1e-12)
            assert r.s <= r.most + 1e-12


@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_pairs_of_blocks_come_once(spark, hot):
    """One key has a third of all rows; pairs with several common keys come once, whatever the cells."""
    rng = random.Random(hot)
    rows = [[(i, [0] * (i % 3 == 0) + rng.sample(range(1, 30), rng.randint(0, 4)), "x") for i in range(n)] for n in (60, 45)]
    source, canon = (spark.createDataFrame(r, "id long, keys array<long>, name string") for r in rows)
    got = sorted((r.id, r.c_id) for r in entities.paired(source, canon, "id", hot=hot).collect())
    assert got == sorted((i, j) for i, a, _ in rows[0] for j, b, _ in rows[1] if set(a) & set(b))


def test_name_keys_meet_one_edit(spark):
    pairs = [("global parts", "globl parts"), ("global parts", "gloabl parts"), ("global parts", "globalparts"), ("a", "ab"), ("northwind", "nortwhind"), ("kato", "xato")]
    df = spark.createDataFrame(pairs, "a string, b string")
    keyed = df.select(F.size(F.array_intersect(*[entities.name_keys(F.col(x), F.lit("de")) for x in "ab"])).alias("n"))
    assert all(r.n > 0 for r in keyed.collect())
    assert spark.createDataFrame([("",), (None,)], "a string").select(F.size(entities.name_keys(F.col("a"), F.lit("x"))).alias("n")).distinct().collect()[0].n == 0


def test_stages_settle_each_row_once(spark):
    """Exact, fuzzy, several and new ones; a row is in the key map or waits, never both."""
    row = lambda i, name, key: (i, name, "1 main street", "rome", key)
    canon = [row(1, "acme trading", "k1"), row(2, "acme tradng", "k2"), row(3, "blue ocean", "k3"), row(4, "iron gate", "k4"), row(5, "iron gate", "k4")]
    source = [row(10, "whatever", "k4"), row(11, "blue ocen", "x1"), row(12, "acme tradin", "x2"), row(13, "nowhere", "x3"), row(14, "", "x4"), (15, "blue ocean", None, None, "x5")]
    frames = []
    for rows in (source, canon):
        df = spark.createDataFrame(rows, "id long, name string, street string, city string, natural_key string")
        frames.append(df.withColumn("keys", entities.name_keys(F.col("name"), F.lit("it"))))
    keymap, waiting = entities.resolved(*frames, "company", "company", entities.company_scores)
    assert {(r.source_key, r.target_id, r.method) for r in keymap.collect()} == {("10", "4", "exact_match"), ("11", "3", "fuzzy_match"), ("13", "new_13", "create"), ("14", "new_14", "create")}
    found = {r.source_key: (r.reason, r.n_candidates, [x.id for x in r.candidates]) for r in waiting.collect()}
    assert found == {"12": ("multi_match", 2, ["1", "2"]), "15": ("multi_match", 1, ["3"])} or found["12"][1] == 2
    kept, lost = entities.unparented(frames[0].withColumn("parent", F.expr("CASE id WHEN 10 THEN 10 WHEN 11 THEN 12 WHEN 12 THEN 77 END")), keymap.withColumn("model", F.lit("company")), "company", "parent")
    assert {(r.id, r.parent) for r in kept.collect()} == {(10, "4"), (13, None), (14, None), (15, None)}
    assert {r.source_key for r in lost.collect()} == {"11", "12"}


def test_an_empty_side_gives_no_pairs(spark):
    none = spark.createDataFrame([], "id long, keys array<long>, name string")
    assert entities.paired(none, none, "id").collect() == []


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_profile_reads_every_value(spark, n):
    rng = random.Random(n)
    values = [(rng.randint(0, 9), rng.choice((None, rng.random() * 100)), rng.choice(("a@b.co", "x", None))) for _ in range(n)]
    df = spark.createDataFrame(values, "i int, d double, s string").repartition(3)
    got = {r.column: r for r in profile.profile(df, median=True, top=3).collect()}
    for at, name in enumerate("ids"):
        known = [v[at] for v in values if v[at] is not None]
        r = got[name]
        assert (r.n, r.n_null, r.n_distinct) == (n, n - len(known), len(set(known)))
        if name != "s" and known:
            assert r.median == statistics.median(known) and (r.min, r.max) == (min(known), max(known))
    assert [t.n for t in got["i"].top] == sorted((t.n for t in got["i"].top), reverse=True)


def test_a_profile_scans_once(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "i int, s string, d double")
    spark.catalog.dropTempView("none")
    plan = profile.profile(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate inline") == 1 and plan.count("ExistingRDD[i") == 1
