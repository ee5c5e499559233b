"""The canonical transaction views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same views in SQL, for the oracle.
TXN_SQL = """txn AS (SELECT event_id AS transaction_id, user_id AS cc_num, event_type AS operation_type, value AS amount,
 concat('fraud_Shop ', json_extract_string(props, '$.k'), ', Ltd.') AS merchant_name, CAST(event_id % 50 = 0 AS INT) AS is_fraud, epoch_us(ts) AS us FROM events)"""
TIES_SQL = """txn AS (SELECT o_orderkey AS transaction_id, o_custkey % 100 AS cc_num, o_orderpriority AS operation_type, o_totalprice AS amount,
 concat('M', o_orderkey % 37) AS merchant_name, CAST(o_orderkey % 40 = 0 AS INT) AS is_fraud, epoch_us(o_orderdate) AS us FROM orders)"""
#: Rows in the order of their card: ties is more than the rows of any card and time, so that ord rises by time first, whatever the table.
ORD_SQL = """tied AS (SELECT *, row_number() OVER (PARTITION BY cc_num, us ORDER BY transaction_id) - 1 AS seq FROM txn),
 o AS (SELECT *, us::HUGEINT * (SELECT max(seq) + 1 FROM tied) + seq AS ord, (SELECT max(seq) + 1 FROM tied)::HUGEINT AS ties FROM tied)"""


def over_sql(micros: int, keys: str = "cc_num") -> str:
    """The rows of the keys in the last micros, up to this row."""
    return f"OVER (PARTITION BY {keys} ORDER BY ord RANGE BETWEEN {micros} * ties + ties - 1 PRECEDING AND CURRENT ROW)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Epoch microseconds of a time without zone, taken as UTC, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz"))


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with microsecond times, one month."""
    e = read(spark, sf_dir, "events")
    merchant = F.concat(F.lit("fraud_Shop "), F.get_json_object("props", "$.k"), F.lit(", Ltd."))
    return e.select(F.col("event_id").alias("transaction_id"), F.col("user_id").alias("cc_num"), F.col("event_type").alias("operation_type"), F.col("value").alias("amount"), merchant.alias("merchant_name"), (F.col("event_id") % 50 == 0).cast("int").alias("is_fraud"), micros("ts").alias("us"))


def txn_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with day-level times and many ties, six years."""
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("transaction_id"), (F.col("o_custkey") % 100).alias("cc_num"), F.col("o_orderpriority").alias("operation_type"), F.col("o_totalprice").alias("amount"), F.concat(F.lit("M"), F.col("o_orderkey") % 37).alias("merchant_name"), (F.col("o_orderkey") % 40 == 0).cast("int").alias("is_fraud"), micros("o_orderdate").alias("us"))


def near(value: str | Column, places: int = 4) -> Column:
    """The value cut to some places, with an offset under one half: sums of cents have exact halves, which would round by their last bit."""
    value = F.col(value) if isinstance(value, str) else value
    return F.floor(value * F.lit(float(10**places)) + F.lit(0.37)).cast("double") / F.lit(float(10**places))


def near_sql(sql: str) -> str:
    """sql with NEAR(expression, places) written out as near() computes it."""
    while (at := sql.find("NEAR(")) >= 0:
        depth, end = 1, at + 5
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner, _, places = sql[at + 5 : end - 1].rpartition(",")
        power = f"{10 ** int(places)}.0::DOUBLE"
        sql = f"{sql[:at]}(floor(({inner})::DOUBLE * {power} + 0.37::DOUBLE) / {power}){sql[end:]}"
    return sql
