import pytest
from pyspark.sql import functions as F

from ledgerflow.functions import scalars
from ledgerflow.operators import stats
from ledgerflow.sources import dictionary, readers, sinks


def test_csv_columns_limit_and_family(spark, tmp_path):
    (tmp_path / "base.csv").write_text("fraud_bool,income,extra\n1,0.5,x\n0,bad,y\n")
    df = readers.read_csv(spark, str(tmp_path / "base.csv"), ["fraud_bool", "income", "absent"], 1)
    assert df.columns == ["fraud_bool", "income"] and df.count() == 1
    family = readers.read_family(spark, {"base": str(tmp_path / "base.csv"), "none": str(tmp_path / "none.csv")})
    assert [r["dataset"] for r in family.collect()] == ["base", "base"]
    assert readers.read_family(spark, {"none": str(tmp_path / "none.csv")}) is None


def test_pipe_files_are_found_by_their_header(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/tx.csv").write_text("trans_num|unix_time|cc_num|amt\nt1|5|77|1.5\n")
    (tmp_path / "comma.csv").write_text("trans_num,unix_time,cc_num\n1,2,3\n")
    (tmp_path / "other.csv").write_text("a|b\n1|2\n")
    df = readers.read_generated(spark, str(tmp_path))
    row = dictionary.harmonise(df, "generated", "generated").first()
    assert (row["transaction_id"], row["event_time_ts"], row["cc_num"], row["amount"]) == ("t1", 5, "77", 1.5)


def test_documents_with_absent_fields(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"uuid": "1", "merchant_clean_name": "A"}\n{"uuid": "2"}\n')
    schema = "uuid string, merchant_clean_name string, amount double, operation_date string"
    assert readers.read_documents(spark, str(tmp_path), schema).count() == 2
    assert readers.read_documents(spark, str(tmp_path), schema, named_only=True, limit=5).count() == 1


def test_harmonise_casts_and_counts(spark):
    raw = spark.createDataFrame([("a", "x", "1"), ("b", "2.5", "0")], "trans_num string, amt string, is_fraud string").withColumn("unix_time", F.lit("7"))
    out = dictionary.detect_and_harmonise(raw, "card")
    assert {r["transaction_id"]: (r["amount"], r["is_fraud"], r["event_time_ts"]) for r in out.collect()} == {"a": (None, True, 7), "b": (2.5, False, 7)}
    renamed = raw.select(F.col("trans_num").alias("transaction_id"), F.col("amt").alias("amount"))
    assert {r["column"]: r["failures"] for r in dictionary.cast_failures(renamed, out, "transaction_id").collect()} == {"amount": 1}
    with pytest.raises(ValueError):
        dictionary.detect_and_harmonise(raw.select("amt"), "x")


def test_both_spellings_of_the_balance(spark):
    a = dictionary.harmonise(spark.createDataFrame([("1", "2")], "newbalanceOrg string, nameOrig string"), "mobile", "m")
    b = dictionary.harmonise(spark.createDataFrame([("3", "2")], "newbalanceOrig string, nameOrig string"), "mobile", "m")
    assert [r["orig_balance_after"] for r in dictionary.union([a, b]).collect()] == [1.0, 3.0]


def test_dictionary_and_ddl(spark):
    rows = {r["column"]: r for r in dictionary.dictionary_table(spark).collect()}
    assert rows["transaction_id"]["sources"] == "bank,card,generated,online" and rows["V339"]["type"] == "double"
    assert '"is_fraud" BOOLEAN' in dictionary.create_table_sql("t") and len(dictionary.schema()) == len(dictionary.columns())


def test_enriched_derives_time_only_if_absent(spark, tmp_path):
    spark.range(1).select(F.lit(60).alias("event_time_ts")).write.parquet(str(tmp_path / "e"))
    assert readers.read_enriched(spark, str(tmp_path / "e")).select(F.unix_seconds("event_time")).first()[0] == 60


def test_profile_report_and_log(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, s string")
    text = sinks.write_profile(stats.profile(df), str(tmp_path / "p"), "T")
    assert "| s | string | 0.5000 |" in text
    sinks.append_log(df, str(tmp_path / "log"), "2024-01-01")
    sinks.append_log(df, str(tmp_path / "log"), "2024-01-02")
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    sinks.write_single(df, str(tmp_path / "one"), "x")
    assert spark.read.parquet(str(tmp_path / "one")).count() == 2


def test_keyed_token_is_hmac(spark):
    import hashlib
    import hmac

    for key in (b"k", b"x" * 100):
        got = spark.range(1).select(scalars.keyed_token(F.lit("abc"), key)).first()[0]
        assert got == hmac.new(key, b"abc", hashlib.sha256).hexdigest()


def test_tags_times_and_guards(spark):
    row = spark.range(1).select(scalars.tags(F.lit('["a","b"]')).alias("t"), scalars.lenient_time(F.lit("nope")).alias("n"), scalars.array_length(F.lit(None).cast("array<int>")).alias("z"), scalars.guarded_z(F.lit(1.0), F.lit(1.0), F.lit(0.0)).alias("g")).first()
    assert (row["t"], row["n"], row["z"], row["g"]) == (["a", "b"], None, 0, 0.0)


def test_incremental_harmonising_is_idempotent(spark, tmp_path):
    from ledgerflow.streaming import jobs

    raw = spark.createDataFrame([("a", "1.5", "5", "9")], "trans_num string, amt string, unix_time string, cc_num string")
    raw.write.json(str(tmp_path / "in"))
    for log in ("log1", "log2"):  # a second run from nothing writes the same batch folder again
        stream = readers.stream_files(spark, str(tmp_path / "in"), raw.schema, format="json")
        jobs.harmonise_stream(stream, "card", "card", str(tmp_path / "out"), str(tmp_path / log)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
