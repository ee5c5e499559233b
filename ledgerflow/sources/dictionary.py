"""The unified wide table: its columns, the six source mappings, and casts that count what they could not read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the data model: column families by rule, the others by name.
CORE = ["transaction_id", "dataset", "event_time_ts", "amount", "transaction_type", "is_fraud", "merchant_name", "merchant_lat", "merchant_long"]
LONGS = ["event_time_ts", "event_time_ts_raw"]
BOOLEANS = ["is_fraud", "risk_flag"]
TEXTS = [
    "transaction_id", "dataset", "transaction_type", "merchant_name", "product_code", "card4", "card6", "email_domain_payer", "email_domain_receiver",
    "device_type", "device_info", "cc_num", "first", "last", "gender", "street", "city", "state", "job", "dob", "trans_date_trans_time",
    "counterparty_id", "nameOrig", "employment_status", "housing_status", "source", "device_os", "currency", "description", "categories",
    "user_id", "account_id", "event_time_str", *[f"M{k}" for k in range(1, 10)],
]
COUNTS, DELAYS, FLAGS, SIGNALS = [f"C{k}" for k in range(1, 15)], [f"D{k}" for k in range(1, 16)], [f"M{k}" for k in range(1, 10)], [f"V{k}" for k in range(1, 340)]
PERSON = ["first", "last", "gender", "street", "city", "state", "zip", "lat", "long", "city_pop", "job", "dob"]
CARD = {"trans_num": "transaction_id", "unix_time": "event_time_ts", "category": "transaction_type", "amt": "amount", "merchant": "merchant_name", "merch_lat": "merchant_lat", "merch_long": "merchant_long", "is_fraud": "is_fraud"}
#: source -> (original -> unified, columns taken as they are)
MAPPINGS: dict[str, tuple[dict[str, str], list[str]]] = {
    "online": (
        {"TransactionID": "transaction_id", "isFraud": "is_fraud", "TransactionAmt": "amount", "ProductCD": "product_code", "P_emaildomain": "email_domain_payer", "R_emaildomain": "email_domain_receiver", "DeviceType": "device_type", "DeviceInfo": "device_info", "TransactionDT": "event_time_ts_raw"},
        [*COUNTS, *DELAYS, *FLAGS, *SIGNALS, *[f"card{k}" for k in range(1, 7)], "addr1", "addr2", "dist1", "dist2"],
    ),
    "card": (CARD, PERSON),
    "applications": (
        {"fraud_bool": "is_fraud", "payment_type": "transaction_type", "session_length_in_minutes": "session_length_minutes"},
        ["email_is_free", "employment_status", "housing_status", "phone_home_valid", "phone_mobile_valid", "bank_months_count", "has_other_cards", "proposed_credit_limit", "foreign_request", "source", "device_os", "keep_alive_session", "device_distinct_emails_8w", "device_fraud_count", "zip_count_4w", "velocity_6h", "velocity_24h", "velocity_4w", "bank_branch_count_8w", "date_of_birth_distinct_emails_4w", "credit_risk_score", "customer_age", "days_since_request", "intended_balcon_amount", "current_address_months_count", "prev_address_months_count", "name_email_similarity", "income", "month", "x1", "x2"],
    ),
    "mobile": (
        # both spellings of the balance after are known
        {"type": "transaction_type", "amount": "amount", "isFraud": "is_fraud", "nameDest": "counterparty_id", "oldbalanceOrg": "orig_balance_before", "newbalanceOrig": "orig_balance_after", "newbalanceOrg": "orig_balance_after", "oldbalanceDest": "dest_balance_before", "newbalanceDest": "dest_balance_after"},
        ["nameOrig", "isFlaggedFraud", "step"],
    ),
    "generated": (CARD, ["cc_num", *PERSON, "trans_date_trans_time"]),
    "bank": (
        {"uuid": "transaction_id", "merchant_clean_name": "merchant_name", "operation_type": "transaction_type", "fraud_score": "risk_score", "is_suspicious": "risk_flag", "operation_date": "event_time_str"},
        ["amount", "currency", "description", "categories", "balance", "user_id", "account_id"],
    ),
}


def kind(column: str) -> T.DataType:
    if column in LONGS:
        return T.LongType()
    if column in BOOLEANS:
        return T.BooleanType()
    return T.StringType() if column in TEXTS else T.DoubleType()


def columns() -> list[str]:
    """All unified columns, the core first."""
    found = dict.fromkeys(CORE)
    for renamed, kept in MAPPINGS.values():
        found |= dict.fromkeys([*renamed.values(), *kept])
    return list(found)


def schema() -> T.StructType:
    return T.StructType([T.StructField(c, kind(c), True) for c in columns()])


def harmonise(df: DataFrame, source: str, dataset: str) -> DataFrame:
    """The mapped columns that df has, under their unified names and kinds; of two originals of a name the first with a value."""
    renamed, kept = MAPPINGS[source]
    originals: dict[str, list[str]] = {}
    for a, b in [*renamed.items(), *[(c, c) for c in kept]]:
        if a in df.columns:
            originals.setdefault(b, []).append(a)
    cols = [F.coalesce(*[F.col(f"`{a}`") for a in names]).alias(b) for b, names in originals.items()]
    return enforce(df.select(F.lit(dataset).alias("dataset"), *cols))


def enforce(df: DataFrame) -> DataFrame:
    """Every column cast to its kind; what does not fit is null. 1 and 0 are booleans."""

    def cast(c: str):
        to = kind(c)
        text = F.col(f"`{c}`").cast("string")
        if isinstance(to, T.BooleanType):
            return F.when(F.lower(text).isin("1", "1.0", "true"), True).when(F.lower(text).isin("0", "0.0", "false"), False)
        if isinstance(to, T.LongType):
            return F.coalesce(text.try_cast("long"), text.try_cast("double").try_cast("long"))
        return text.try_cast(to)

    return df.select(*[cast(c).alias(c) for c in df.columns])


def cast_failures(raw: DataFrame, cast: DataFrame, id_col: str) -> DataFrame:
    """(column, failures): values that were there before the casts and are null after them."""
    shared = [c for c in raw.columns if c in cast.columns and c != id_col]
    both = raw.select(id_col, *[F.col(c).alias(f"__{c}") for c in shared]).join(cast, id_col)
    counts = [F.sum((F.col(f"__{c}").isNotNull() & F.col(c).isNull()).cast("long")).alias(c) for c in shared]
    return both.agg(*counts).unpivot([], shared, "column", "failures")


def detect_and_harmonise(df: DataFrame, dataset: str) -> DataFrame:
    """Pick the mapping by the columns that are there; already unified rows pass."""
    have = set(df.columns)
    if {"transaction_id", "amount", "event_time_ts"} <= have:
        return df
    for source, needed in (("card", {"trans_num", "amt", "unix_time"}), ("online", {"TransactionID", "TransactionAmt", "TransactionDT"}), ("mobile", {"step", "nameOrig", "nameDest"}), ("bank", {"uuid", "operation_date"})):
        if needed <= have:
            return harmonise(df, source, dataset)
    raise ValueError(f"no known source has the columns {sorted(have)[:10]}")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def dictionary_table(spark: SparkSession) -> DataFrame:
    """(column, type, sources, originals)."""
    rows = [(b, s, f"{s}:{a}") for s, (renamed, kept) in MAPPINGS.items() for a, b in [*renamed.items(), *[(c, c) for c in kept]]]
    table = spark.createDataFrame(rows, "column string, source string, original string")
    kinds = spark.createDataFrame([(c, kind(c).simpleString()) for c in columns()], "column string, type string")
    grouped = table.groupBy("column").agg(F.concat_ws(",", F.sort_array(F.collect_set("source"))).alias("sources"), F.concat_ws(",", F.sort_array(F.collect_set("original"))).alias("originals"))
    return kinds.join(grouped, "column", "left")


def create_table_sql(name: str) -> str:
    sql = {"string": "TEXT", "double": "DOUBLE PRECISION", "boolean": "BOOLEAN", "bigint": "BIGINT"}
    lines = ",\n".join(f'  "{f.name}" {sql[f.dataType.simpleString()]}' for f in schema())
    return f"CREATE TABLE IF NOT EXISTS {name} (\n{lines}\n)"
