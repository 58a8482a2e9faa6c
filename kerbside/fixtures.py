"""Stand-in tables derived from the driver's test data (see FIXTURES.md §B).

The product's own tables (premises, jobs, postcodes) are rebuilt from the
TPC-H-like parquet files, so every query reads real, scalable input.  The
same definitions exist as SQL text in ``ORACLE_CTES`` for the DuckDB oracle.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.sources.ingest import with_load_ts, with_search_postcode

# Fixed values of the fixtures: the reference day used for "today" and the
# load instant stamped on created_at / updated_at.
AS_OF = dt.date(2000, 6, 1)
LOAD_TS = dt.datetime(2000, 5, 31, 3, 0, 0)
MERGE_TS = dt.datetime(2000, 6, 1, 3, 0, 0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _s(c: Column) -> Column:
    return c.cast("string")


def _unit(k: Column) -> Column:
    """The postcode's unit: one of four in every block of 250 customers, so
    the number of postcodes grows with the table."""
    return (F.floor(k / 250) * 10 + k % 4).cast("long")


def premises_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw premises rows: id + six address parts (FIXTURES.md view ``premises``)."""
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k = F.col("c_custkey")
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            # some ids that no job has
            F.when(k % 101 == 50, k + 10_000_000).otherwise(k).alias("id"),
            F.when(k % 7 == 0, F.concat(F.lit("FLAT "), _s(k % 9))).alias("address_room"),
            F.when(k % 11 == 0, F.lit("THE ROW"))
            .when(k % 5 == 0, F.concat(_s(k % 30), F.lit("A")))
            .when(k % 13 == 0, F.lit(None).cast("string"))
            .otherwise(_s(k % 30))
            .alias("address_number"),
            F.concat(F.col("c_mktsegment"), F.lit(" ROAD")).alias("address_street"),
            F.when(k % 3 == 0, F.lit(None).cast("string")).otherwise(F.lit("FERNHOLT")).alias("address_locality"),
            F.col("n_name").alias("address_city"),
            F.when(k % 97 == 0, F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("QX"), _s(F.col("c_nationkey")), F.lit(" "), _s(_unit(k)), F.lit("aB")))
            .alias("address_postcode"),
        )
    )


def jobs_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs rows (FIXTURES.md view ``jobs``); FOOD is a bin the UI does not know."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    p = F.col("o_orderpriority")
    c = F.col("o_custkey")
    return orders.select(
        F.col("o_orderkey").alias("id"),
        # some premises that do not exist
        F.when(c % 17 == 3, c + 20_000_000).otherwise(c).alias("premises_id"),
        F.when(p == "1-URGENT", "BLACK")
        .when(p == "2-HIGH", "GREEN")
        .when(p == "3-MEDIUM", "BROWN")
        .when(p == "4-NOT SPECIFIED", "BLACK")
        .otherwise("FOOD")
        .alias("bin"),
        F.col("o_orderdate").cast("date").alias("date"),
    )


def postcodes_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geocoded postcodes, a number that grows with the customers; unit 3 of
    every block is missing on purpose.  Units 1 and 2 lie scattered over about
    11 x 10 km, some on shared points; every unit 0 lies in one dense cluster."""
    k = F.col("c_custkey")
    unit = (
        read_table(spark, sf_dir, "customer")
        .select(F.col("c_nationkey").alias("n"), (k % 4).alias("u"), F.floor(k / 250).cast("long").alias("b"))
        .where("u < 3")
        .distinct()
    )
    x = (F.col("n") * 7919 + F.col("u") * 31337 + F.col("b") * 65537) % 1009
    y = (F.col("n") * 4001 + F.col("u") * 17 + F.col("b") * 92821) % 1013
    dense = F.col("u") == 0
    return unit.select(
        F.concat(F.lit("QX"), _s(F.col("n")), F.lit(" "), _s(F.col("b") * 10 + F.col("u")), F.lit("aB")).alias("id"),
        F.when(dense, F.lit(53.85) + (x % 41) * F.lit(1e-5)).otherwise(F.lit(53.8) + x * F.lit(1e-4)).alias("latitude"),
        F.when(dense, F.lit(-1.5) + (y % 37) * F.lit(1.3e-5)).otherwise(F.lit(-1.55) + y * F.lit(1.5e-4)).alias("longitude"),
    )


@dataclass
class Tables:
    premises: DataFrame
    jobs: DataFrame
    postcodes: DataFrame


def load(spark: SparkSession, sf_dir: str) -> Tables:
    """The product tables as the live importer would leave them."""
    premises = with_load_ts(with_search_postcode(premises_source(spark, sf_dir)), LOAD_TS)
    postcodes = with_load_ts(postcodes_source(spark, sf_dir), LOAD_TS)
    return Tables(premises=premises, jobs=jobs_source(spark, sf_dir), postcodes=postcodes)


def premises_snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(old, new) premises snapshots: old lacks id%10=0, new lacks id%10=1 and
    renames the locality of id%8=0 to 'X'."""
    base = premises_source(spark, sf_dir)
    old = with_load_ts(with_search_postcode(base.where(F.col("id") % 10 != 0)), LOAD_TS)
    new = with_search_postcode(
        base.where(F.col("id") % 10 != 1).withColumn(
            "address_locality",
            F.when(F.col("id") % 8 == 0, F.lit("X")).otherwise(F.col("address_locality")),
        )
    )
    return old, new


def jobs_snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(old, new) jobs snapshots: old lacks id%10=0, new lacks id%10=1."""
    base = jobs_source(spark, sf_dir)
    return base.where(F.col("id") % 10 != 0), base.where(F.col("id") % 10 != 1)


def recents_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved-list log from ``events``: pid = event_id % 1500; errors are removes,
    and every 47th event clears the list."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return ev.select(
        "user_id",
        "ts",
        "event_id",
        F.when(F.col("event_id") % 47 == 0, "clear")
        .when(F.col("event_type") == "error", "remove")
        .otherwise("add")
        .alias("op"),
        (F.col("event_id") % 1500).alias("pid"),
    )


# ---------------------------------------------------------------------------
# The same fixtures as SQL text for the DuckDB oracle (runs unchanged in Spark).
# ---------------------------------------------------------------------------

PREMISES_SOURCE_SQL = """
SELECT CASE WHEN c_custkey % 101 = 50 THEN c_custkey + 10000000 ELSE c_custkey END AS id,
  CASE WHEN c_custkey % 7 = 0 THEN concat('FLAT ', CAST(c_custkey % 9 AS STRING)) END AS address_room,
  CASE WHEN c_custkey % 11 = 0 THEN 'THE ROW'
       WHEN c_custkey % 5 = 0 THEN concat(CAST(c_custkey % 30 AS STRING), 'A')
       WHEN c_custkey % 13 = 0 THEN NULL
       ELSE CAST(c_custkey % 30 AS STRING) END AS address_number,
  concat(c_mktsegment, ' ROAD') AS address_street,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'FERNHOLT' END AS address_locality,
  n_name AS address_city,
  CASE WHEN c_custkey % 97 = 0 THEN NULL
       ELSE concat('QX', CAST(c_nationkey AS STRING), ' ',
                   CAST(CAST(floor(c_custkey / 250) * 10 + c_custkey % 4 AS BIGINT) AS STRING), 'aB') END AS address_postcode
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""

JOBS_SQL = """
SELECT o_orderkey AS id, CASE WHEN o_custkey % 17 = 3 THEN o_custkey + 20000000 ELSE o_custkey END AS premises_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'BLACK' WHEN '2-HIGH' THEN 'GREEN' WHEN '3-MEDIUM' THEN 'BROWN'
       WHEN '4-NOT SPECIFIED' THEN 'BLACK' ELSE 'FOOD' END AS bin,
  CAST(o_orderdate AS DATE) AS date
FROM orders
"""

POSTCODES_SQL = """
SELECT concat('QX', CAST(n AS STRING), ' ', CAST(b * 10 + u AS STRING), 'aB') AS id,
  CASE WHEN u = 0 THEN CAST(53.85 AS DOUBLE) + (x % 41) * CAST(1e-5 AS DOUBLE)
       ELSE CAST(53.8 AS DOUBLE) + x * CAST(1e-4 AS DOUBLE) END AS latitude,
  CASE WHEN u = 0 THEN CAST(-1.5 AS DOUBLE) + (y % 37) * CAST(1.3e-5 AS DOUBLE)
       ELSE CAST(-1.55 AS DOUBLE) + y * CAST(1.5e-4 AS DOUBLE) END AS longitude
FROM (SELECT n, u, b, (n * 7919 + u * 31337 + b * 65537) % 1009 AS x, (n * 4001 + u * 17 + b * 92821) % 1013 AS y
      FROM (SELECT DISTINCT c_nationkey AS n, c_custkey % 4 AS u, CAST(floor(c_custkey / 250) AS BIGINT) AS b
            FROM customer WHERE c_custkey % 4 < 3) units) xy
"""

LOAD_TS_SQL = "TIMESTAMP '2000-05-31 03:00:00'"
AS_OF_SQL = "DATE '2000-06-01'"

ORACLE_CTES = f"""
premises_src AS ({PREMISES_SOURCE_SQL}),
premises AS (
  SELECT *, upper(replace(coalesce(address_postcode, ''), ' ', '')) AS search_postcode,
         {LOAD_TS_SQL} AS created_at, {LOAD_TS_SQL} AS updated_at
  FROM premises_src),
jobs AS ({JOBS_SQL}),
postcodes AS (SELECT *, {LOAD_TS_SQL} AS created_at, {LOAD_TS_SQL} AS updated_at FROM ({POSTCODES_SQL}) pc)
"""


def oracle(body: str, extra_ctes: str = "") -> str:
    """Wrap an oracle query body with the fixture CTEs."""
    more = f",\n{extra_ctes}" if extra_ctes.strip() else ""
    return f"WITH {ORACLE_CTES}{more}\n{body}"

