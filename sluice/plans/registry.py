"""Where the engine's queries register: a Spark plan and the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers the decorated (spark, sf_dir) function under `name`."""

    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


#: Dirty partner records made from `customer`; each expression means the same in Spark and in SQL.
PARTNER = {
    "id": "c_custkey",
    "source_ptr": "concat('row_', c_custkey)",
    "name": """CASE c_custkey % 6 WHEN 0 THEN concat('  Acme   Trading ', c_custkey, ' Inc ') WHEN 1 THEN concat('josé o''neil-', c_custkey)
               WHEN 2 THEN concat('BETA #', c_custkey, ' LLC.') WHEN 3 THEN concat('Smith, Mr. John', c_custkey) WHEN 4 THEN '' ELSE NULL END""",
    "email": """CASE c_custkey % 5 WHEN 0 THEN concat(' User', c_custkey, '@Example.COM ') WHEN 1 THEN 'not-an-email'
                WHEN 2 THEN concat('a.b+', c_custkey, '@mail.example.co.uk') WHEN 3 THEN concat('x@', c_custkey) ELSE NULL END""",
    "phone": """CASE c_custkey % 6 WHEN 0 THEN concat('(555) 123-', c_custkey % 9000 + 1000) WHEN 1 THEN concat('+1 555.321.', c_custkey % 9000 + 1000)
                WHEN 2 THEN concat('+49 30 ', c_custkey % 900000 + 100000, ' ext 12') WHEN 3 THEN '123' WHEN 4 THEN concat('555123', c_custkey % 9000 + 1000) ELSE NULL END""",
    "vat": "CASE WHEN c_custkey % 4 = 0 THEN concat('us ', c_custkey, '-4.', c_nationkey) WHEN c_custkey % 4 = 1 THEN ' - ' ELSE NULL END",
    "street": "CASE WHEN c_custkey % 3 = 0 THEN concat(c_custkey, '  Main St.') ELSE NULL END",
    "city": "CASE WHEN c_custkey % 7 < 4 THEN concat('City-', c_nationkey) ELSE NULL END",
    "zip": "concat(c_nationkey, ' a', c_custkey % 10)",
    "day": """CASE c_custkey % 8 WHEN 0 THEN '01/15/2024' WHEN 1 THEN '15/01/2024' WHEN 2 THEN 'Jan 15, 2024' WHEN 3 THEN '15 January 2024'
              WHEN 4 THEN '20240115' WHEN 5 THEN '2024-01-15' WHEN 6 THEN '44927' ELSE '13/32/2024' END""",
    "money": "CASE c_custkey % 5 WHEN 0 THEN concat('$1,', c_custkey % 900 + 100, '.50') WHEN 1 THEN concat('€ ', c_custkey) WHEN 2 THEN 'n/a' WHEN 3 THEN concat('-', c_custkey, '.25') ELSE NULL END",
    "flag": "CASE c_custkey % 7 WHEN 0 THEN 'Yes' WHEN 1 THEN ' t ' WHEN 2 THEN '0' WHEN 3 THEN 'FALSE' WHEN 4 THEN 'maybe' WHEN 5 THEN '' ELSE NULL END",
    "nation": "c_nationkey",
    "balance": "c_acctbal",
    "segment": "c_mktsegment",
}


def partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*[f"{e} AS {c}" for c, e in PARTNER.items()])


#: The same as a CTE.
PARTNERS = f"WITH partners AS (SELECT {', '.join(f'{e} AS {c}' for c, e in PARTNER.items())} FROM customer)"
