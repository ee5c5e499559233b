"""Queries over streams give the SQL's rows however the events are cut into files."""

import duckdb
import pytest
from pyspark.sql import functions as F

from compare import assert_same
from conftest import DATA
from ledgerflow.plans import modelling


@pytest.fixture(scope="module")
def unordered(spark, tmp_path_factory):
    """The events as a folder of files, the latest times first."""
    base = str(tmp_path_factory.mktemp("events"))
    e = spark.read.parquet(f"{DATA}/events.parquet")
    cuts = [r[0] for r in e.select(F.percentile("event_id", F.array(F.lit(0.7), F.lit(0.3))).alias("c")).select(F.explode("c")).collect()]
    for part in (e.where(F.col("event_id") > cuts[0]), e.where(F.col("event_id").between(cuts[1], cuts[0])), e.where(F.col("event_id") < cuts[1])):
        part.coalesce(1).write.mode("append").parquet(f"{base}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{base}/events.parquet/*.parquet'")
    return base, con


@pytest.mark.parametrize("name", ["stream_decisions"])
def test_files_in_any_order(spark, unordered, name):
    base, con = unordered
    assert_same(modelling.QUERIES[name](spark, base), con.execute(modelling.ORACLE_SQL[name]))


def test_drift_of_batches_in_several_files(spark, unordered):
    """A quarter's rows lie in several files in no order of time; they are one batch, so none counts as late."""
    base, con = unordered
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 100)
    try:
        assert_same(modelling.QUERIES["stream_drift"](spark, base), con.execute(modelling.ORACLE_SQL["stream_drift"]))
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
