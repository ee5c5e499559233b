"""Column functions: normalisation, time parts, encodings, flags and scores."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the data model.
STEP_EPOCH = 1_546_300_800
RELATIVE_EPOCH = 1_512_086_400  # 2017-12-01
HOLIDAYS = ("01-01", "07-04", "12-25", "11-22", "11-23", "10-31", "02-14", "03-17")
SUBSCRIPTIONS = ("Services", "Digital Services", "Online Services", "Entertainment", "Online Shopping")
TRANSACTION_TYPES = {
    "debit": ("withdrawal", "atm_withdrawal", "atm", "cash_withdrawal", "cashout", "cash_out", "cash advance", "sepa_direct_debit", "ach_debit", "charge", "fee"),
    "credit": ("deposit", "refund", "cash_deposit", "reversal", "chargeback", "interest", "cash_in"),
    "transfer": ("transfer", "p2p", "peer_to_peer", "wire_transfer", "bank_transfer", "internal_transfer", "sepa_credit_transfer", "ach_credit", "remittance"),
    "payment": ("payment", "purchase", "pos", "card_present", "card_not_present", "ecommerce", "bill_payment", "merchant_payment", "standing_order", "topup", "top_up"),
}
MOBILE_TYPES = {"debit": ("cash_out", "debit"), "credit": ("cash_in", "credit"), "transfer": ("transfer",), "payment": ("payment",)}
#: dataset, code, category, subcategory, group
CATEGORIES = (
    ("card", "gas_transport", "Transportation", "Gas Station", "Travel & Transport"),
    ("card", "grocery_pos", "Food & Dining", "Grocery Store", "Food & Dining"),
    ("card", "grocery_net", "Food & Dining", "Online Grocery", "Food & Dining"),
    ("card", "food_dining", "Food & Dining", "Restaurant", "Food & Dining"),
    ("card", "shopping_pos", "Shopping", "Retail Store", "Shopping"),
    ("card", "shopping_net", "Shopping", "Online Shopping", "Shopping"),
    ("card", "home", "Shopping", "Home & Garden", "Shopping"),
    ("card", "kids_pets", "Shopping", "Kids & Pets", "Shopping"),
    ("card", "entertainment", "Entertainment", "Entertainment", "Entertainment"),
    ("card", "personal_care", "Health & Wellness", "Personal Care", "Health & Wellness"),
    ("card", "health_fitness", "Health & Wellness", "Health & Fitness", "Health & Wellness"),
    ("card", "misc_pos", "Services", "Miscellaneous", "Services"),
    ("card", "misc_net", "Services", "Online Services", "Services"),
    ("card", "travel", "Travel", "Travel Services", "Travel & Transport"),
    ("online", "W", "Services", "Digital Services", "Services"),
    ("online", "H", "Home Services", "Home Services", "Services"),
    ("online", "C", "Technology", "Consumer Electronics", "Shopping"),
    ("online", "S", "Services", "Professional Services", "Services"),
    ("online", "R", "Recreation", "Recreation", "Entertainment"),
)


def categories(spark) -> DataFrame:
    """The three-level taxonomy as a table, for a left join on (dataset, code)."""
    return spark.createDataFrame(CATEGORIES, "dataset string, code string, category string, subcategory string, category_group string")


#: Spellings of a country, in lower case.
COUNTRIES = {"US": ("us", "usa", "u.s.", "united states"), "GB": ("gb", "uk", "united kingdom", "great britain"), "DE": ("de", "germany", "deutschland"), "FR": ("fr", "france")}


def synonyms(spark, kinds: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(synonym, canonical) as a table."""
    rows = [(s, k) for k, names in (kinds or TRANSACTION_TYPES).items() for s in names]
    return spark.createDataFrame(rows, "synonym string, canonical string")


def canonical_type(df: DataFrame, table: DataFrame, col: str, out: str = "transaction_type") -> DataFrame:
    """Lower case, trimmed and mapped by a table of synonyms; what is not in it stays."""
    key = F.lower(F.trim(col))
    found = df.withColumn("__key", key).join(table, F.col("__key") == F.col("synonym"), "left")
    return found.withColumn(out, F.coalesce("canonical", "__key")).drop("__key", "synonym", "canonical")


def step_epoch(step: Column) -> Column:
    return F.lit(STEP_EPOCH) + step * 3600


def epoch_time(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def relative_time(seconds: Column) -> Column:
    return F.timestamp_seconds(F.lit(RELATIVE_EPOCH) + seconds)


def lenient_time(text: Column, formats: tuple[str, ...] = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy")) -> Column:
    """The first format that fits; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def merchant_proxy(domain: Column, brand: Column) -> Column:
    """The mail domain stands for the merchant, else the card's brand."""
    return F.coalesce(domain, brand, F.lit("UNK"))


def card_proxy(card: Column) -> Column:
    return F.coalesce(card.cast("long"), F.lit(-1).cast("long"))


def token(value: Column, salt: str) -> Column:
    """SHA-256 of salt and value; null stays null. Cast numbers to long first: 7919.0 has another token than 7919."""
    return F.sha2(F.concat(F.lit(f"{salt}:"), value.cast("string")), 256)


def keyed_token(value: Column, key: bytes) -> Column:
    """HMAC-SHA256, from two nested hashes over the padded key."""
    import hashlib

    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    padded = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in padded)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(value.cast("string"), "UTF-8")), 256))), 256)


def versioned_token(value: Column, keys: dict[int, bytes]) -> Column:
    """The token under the newest key, with that key's version."""
    newest = max(keys)
    return F.struct(F.lit(newest).alias("key_version"), keyed_token(value, keys[newest]).alias("token"))


def clean_merchant(name: Column) -> Column:
    """Lower case, without the fraud_ prefix, other signs as single spaces; null as UNK."""
    out = F.regexp_replace(F.lower(F.coalesce(name, F.lit("UNK"))), "^fraud_", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "[^a-z0-9\\s]", " "), "\\s+", " "))


def log_amount(amount: Column) -> Column:
    return F.log1p(F.greatest(F.abs(amount), F.lit(0.0)))


def calendar(time: Column) -> dict[str, Column]:
    """Hour, week day from Monday = 0, month, night and weekend flags."""
    h = F.hour(time)
    return {"hour": h, "dow": F.weekday(time), "month": F.month(time), "is_night": ((h < 6) | (h >= 22)).cast("int"), "is_weekend": (F.weekday(time) >= 5).cast("int")}


def cyclic(value: Column, period: int) -> tuple[Column, Column]:
    angle = value * (2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def is_holiday(date: Column, days: tuple[str, ...] = HOLIDAYS) -> Column:
    return F.date_format(date, "MM-dd").isin(*days).cast("int")


def guarded_z(value: Column, mean: Column, std: Column, otherwise: float | None = 0.0) -> Column:
    z = F.try_divide(value - mean, std)
    return z if otherwise is None else F.coalesce(z, F.lit(otherwise))


def flag(col: Column) -> Column:
    return F.coalesce(col.isNotNull().cast("int"), F.lit(0))


def completeness(cols: list[Column]) -> Column:
    """How many of the columns have a value."""
    return reduce(lambda a, b: a + b, [flag(c) for c in cols])


def confidence(n: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(0.5 + 0.1 * n, F.lit(0.95)))


def confidence_band(value: Column) -> Column:
    return F.when(value >= 0.75, "high").when(value >= 0.6, "medium").when(value >= 0.45, "low").otherwise("very_low")


def quality(category: Column, site: Column, location: Column, conf: Column) -> Column:
    return 0.3 * category + 0.2 * site + 0.2 * location + 0.3 * conf


def array_length(col: Column) -> Column:
    return F.when(col.isNull(), 0).otherwise(F.size(col))


def hash_share(key: Column, salt: str) -> Column:
    """A number in [0, 1) fixed by the key, however rows are partitioned."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}:"), key.cast("string"))), 1, 8), 16, 10).cast("long") / F.lit(float(2**32))


def bernoulli(key: Column, salt: str, p: Column | float) -> Column:
    return (hash_share(key, salt) < p).cast("int")


def categorical(key: Column, salt: str, shares: dict) -> Column:
    """One of the values, each with its share."""
    share, total, out = hash_share(key, salt), 0.0, None
    for value, p in shares.items():
        total += p
        out = F.when(share < total, value) if out is None else out.when(share < total, value)
    return out.otherwise(list(shares)[-1])


def fixed_map(col: Column, mapping: dict, default) -> Column:
    pairs = F.create_map(*[F.lit(x) for item in mapping.items() for x in item])
    return F.coalesce(F.try_element_at(pairs, col), F.lit(default))


def affordability(premium: Column, income: Column) -> Column:
    return F.try_divide(premium * 12, income)


def relevance(purchased: Column, clicked: Column) -> Column:
    return F.when(purchased, 3).when(clicked, 1).otherwise(0)


def propensity_weight(ctr: Column) -> Column:
    return F.coalesce(F.try_divide(F.lit(1.0), ctr), F.lit(1.0))


def hashed_bin(value: Column, bins: int) -> Column:
    """A bin by the value's MD5, which any engine computes alike; null is a value."""
    return F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % bins


def redact(text: Column) -> Column:
    """E-mail addresses and long digit runs masked."""
    out = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]")
    return F.regexp_replace(out, r"[0-9]{13,19}", "[CARD]")


def redact_with_signals(text: Column, signals: dict[str, str]) -> dict[str, Column]:
    """The masked text, and a 0/1 flag for each allow-listed pattern of the original one."""
    return {"text": redact(text)} | {name: F.coalesce(text.rlike(p).cast("int"), F.lit(0)) for name, p in signals.items()}


def tags(categories: Column) -> Column:
    return F.coalesce(F.from_json(categories, "array<string>"), F.array().cast("array<string>"))


def validity_flags(amount: Column, time: Column, now: Column, opened: Column) -> dict[str, Column]:
    """Nothing is dropped: what looks wrong is marked."""
    return {"neg_amount": (amount < 0).cast("int"), "future": (time > now + F.expr("INTERVAL 90 DAYS")).cast("int"), "stale": ((time < now - F.expr("INTERVAL 730 DAYS")) | (time < opened)).cast("int")}


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def country_default(dataset: Column, country: Column) -> Column:
    """US for the card and online sources, unknown for others, where no country is given."""
    return F.coalesce(country, F.when(dataset.isin("card", "online"), "US").otherwise("unknown"))


def refund_flags() -> dict[str, Column]:
    """Refund columns of sources that report none."""
    return {"is_refund": F.lit(0), "refund_risk": F.lit(0)}


def risk_flags(home: Column, seen: Column, category: Column, risky: tuple[str, ...]) -> dict[str, Column]:
    return {"country_mismatch": F.coalesce((home != seen).cast("int"), F.lit(0)), "risky_category": F.coalesce(category.isin(*risky).cast("int"), F.lit(0))}


def fill(df: DataFrame, policy: dict) -> DataFrame:
    """Nulls filled by column: a value, or "median" for the exact median of the column."""
    medians = [c for c, v in policy.items() if v == "median"]
    fixed = {c: v for c, v in policy.items() if v != "median"}
    out = df.na.fill(fixed) if fixed else df
    if medians:
        from ..operators.quantiles import quantiles

        for c in medians:
            out = out.crossJoin(F.broadcast(quantiles(df, c, {f"__{c}": 0.5})))  # one row
        out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"__{c}")) for c in medians}).drop(*[f"__{c}" for c in medians])
    return out


def usable_features(df: DataFrame, wanted: list[str], ids: tuple[str, ...] = ()) -> list[str]:
    """Those of the wanted columns that df has, without ids and texts."""
    kinds = dict(df.dtypes)
    return [c for c in wanted if c in kinds and c not in ids and kinds[c] != "string"]


def event_time_of(*candidates: Column) -> Column:
    return F.coalesce(*candidates)


def entity_of(card: Column, account: Column, user: Column) -> Column:
    """Card, else account, else user, marked by its kind."""
    named = lambda kind, c: F.when(c.isNotNull(), F.concat(F.lit(f"{kind}:"), c.cast("string")))
    return F.coalesce(named("card", card), named("account", account), named("user", user))


def deductible_ratio(deductible: Column, premium: Column) -> Column:
    return F.try_divide(deductible, premium * 12)


def family_fit(options: Column, members: Column) -> Column:
    """Share of the family's members (array of kinds) that the plan's options (array of kinds) cover."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(members, options)).cast("double"), F.size(F.array_distinct(members))), F.lit(0.0))
