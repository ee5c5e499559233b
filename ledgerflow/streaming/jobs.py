"""Streams: incremental harmonising, scoring with keyed state, monitors, late rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import models, quantiles, rules
from ..sources.dictionary import harmonise

HOUR, DAY = 3_600_000_000, 86_400_000_000
KEPT = 30 * DAY
KNOWN, PIECES = 1 << 16, 32
SLOT_ROWS = 8192
VELOCITY = "transaction_id long, cc_num long, us long, amount double, merchant_name string, cnt_1h long, cnt_6h long, cnt_24h long, sum_24h double, mean_24h double, std_24h double, new_merchant int, uniq_7d long, same_30d long"
_FIELDS = [c.split()[0] for c in VELOCITY.split(", ")]
#: Rows and first meetings as the state holds them.
ROWS = pa.schema([("cc_num", pa.int64()), ("us", pa.int64()), ("id", pa.int64()), ("amount", pa.float64()), ("merchant", pa.string())])
MEETINGS = pa.schema([ROWS.field(c) for c in ("cc_num", "us", "id", "merchant")])


def harmonise_stream(raw: DataFrame, source: str, dataset: str, path: str, checkpoint: str):
    """Append each batch once: a batch that runs again overwrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        harmonise(batch, source, dataset).write.mode("overwrite").parquet(f"{path}/dataset={dataset}/batch={batch_id}")

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_stream(df: DataFrame, path: str, checkpoint: str):
    """Append each batch once, by dataset: a batch that runs again overwrites the parts of its own number."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.partitionBy("dataset").mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _codes(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row its card, its merchant (-1 for none) and the two together, as small numbers."""
    cards = np.unique(rows["cc_num"].fill_null(0).to_numpy(), return_inverse=True)[1].astype(np.int64)
    named = rows["merchant"].combine_chunks().dictionary_encode()
    merchants = named.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return cards, merchants, cards * (len(named.dictionary) + 1) + merchants + 1


class History:
    """Rows of some cards in order of (card, time, id), with the features of each as the batch windows define them: of its card's rows at or before it in that order."""

    def __init__(self, rows: pa.Table, new: np.ndarray) -> None:
        cards, merchants, pairs = _codes(rows)
        us, ids = rows["us"].to_numpy(), rows["id"].to_numpy()
        self.order = np.lexsort((ids, us, cards))
        self.cards, self.merchants, self.pairs, self.us, self.amounts, self.new = (x[self.order] for x in (cards, merchants, pairs, us, rows["amount"].to_numpy(), new))
        self.times, self.rank = np.unique(self.us, return_inverse=True)

    def _since(self, group: np.ndarray, at: np.ndarray | slice, span: int) -> np.ndarray:
        """The place of the first row of the same group in the last span; rows `at` are in order of (group, time)."""
        width = len(self.times) + 1
        return np.searchsorted(group * width + self.rank[at], group * width + np.searchsorted(self.times, self.us[at] - span))

    def features(self) -> dict[str, np.ndarray]:
        """Of the new rows, in order."""
        cards, n = self.cards, len(self.us)
        at, size, valued = np.arange(n), np.nan_to_num(np.abs(self.amounts)), ~np.isnan(self.amounts)
        first = {h: self._since(cards, slice(None), h * HOUR) for h in (1, 6, 24)}
        known = np.r_[0, np.cumsum(valued)]
        count = known[at + 1] - known[first[24]]
        # running sums by card, of distances from the card's mean, so that large amounts don't drown small deviations
        centre = (np.bincount(cards, size) / np.maximum(np.bincount(cards, valued), 1))[cards]
        off = np.where(valued, size - centre, 0.0)
        starts = first[24] == np.searchsorted(cards, cards)
        within = lambda x: (total := pd.Series(x).groupby(cards).cumsum().to_numpy()) - np.where(starts, 0.0, total[first[24] - 1])
        gap = np.divide(within(off), count, out=np.full(n, np.nan), where=count > 0)
        mean, var = centre + gap, np.maximum(np.divide(within(off**2), count, out=np.zeros(n), where=count > 0) - np.nan_to_num(gap) ** 2, 0.0)
        sums = np.nan_to_num(mean) * count
        uniq, same = self._merchants()
        out = {f"cnt_{h}h": at - first[h] + 1 for h in (1, 6, 24)} | {"sum_24h": np.where(count > 0, sums, np.nan), "mean_24h": mean, "std_24h": np.sqrt(var), "uniq_7d": uniq, "same_30d": same}
        return {name: x[self.new] for name, x in out.items()}

    def _merchants(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct merchants of 7 days: the named rows less those whose merchant comes again inside; rows of the same merchant in 30 days."""
        n, named = len(self.us), np.r_[0, np.cumsum(self.merchants >= 0)]
        first, by_pair = self._since(self.cards, slice(None), 7 * DAY), np.argsort(self.pairs, kind="stable")
        group = self.pairs[by_pair]
        again = (group[1:] == group[:-1]) & (self.merchants[by_pair[1:]] >= 0)
        row, previous = by_pair[1:][again], by_pair[:-1][again]
        # a row and the previous one of its merchant are both seen from the row on, until windows start after the previous one
        until = np.maximum(np.searchsorted(first, previous, "right"), row)
        twice = np.cumsum(np.bincount(row, minlength=n + 1) - np.bincount(until, minlength=n + 1))[:n]
        same = np.zeros(n, np.int64)
        same[by_pair] = np.arange(n) - self._since(group, by_pair, KEPT) + 1
        return named[1:] - named[first] - twice, same


def _packed(rows: pa.Table) -> tuple[bytes]:
    """Rows as one value of the state."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_table(rows)
    return (sink.getvalue().to_pybytes(),)


def _unpacked(values: list, schema: pa.Schema) -> pa.Table:
    return pa.concat_tables([schema.empty_table(), *[pa.ipc.open_stream(v[0]).read_all() for v in values]])


class Velocity(StatefulProcessor):
    """The rows of the last 30 days of some cards (a slot), by the batches that brought them, and when each card first met each merchant; gives each arriving row the features of the batch windows.

    A row that comes late sees the rows at or before its own time only, never later ones, and from then on counts for those that follow.
    Rows given out already are not changed. A call and each of its round trips to the JVM cost far more than a row, so a call serves all cards of a
    slot at once: it reads the slot's rows and appends its own as one piece. Rows that lie 30 days before the
    watermark are dropped once they are half of what is held, and a timer drops those of slots without new rows. First meetings stay, as
    first-seen flags need them: up to `known` of a slot together, further ones by card and merchant, so that a batch reads no more of a slot with very many.
    """

    def __init__(self, known: int = KNOWN) -> None:
        self.known = known

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pieces = handle.getListState("pieces", "rows binary")
        self.first = handle.getValueState("first", "rows binary")
        self.seen = handle.getMapState("seen", "pair string", "us long, id long")
        self.handle = handle

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        new = pd.concat(frames) if len(frames) > 1 else frames[0]
        cards = new["cc_num"] if key[0] >= 0 else pa.nulls(len(new))
        columns = [cards, new["us"], new["transaction_id"], pd.to_numeric(new["amount"]).to_numpy(float), new["merchant_name"]]
        arrived = pa.table([pa.array(x, t, from_pandas=t != pa.float64()) for x, t in zip(columns, ROWS.types)], ROWS)
        pieces = list(self.pieces.get())
        everything = pa.concat_tables([_unpacked(pieces, ROWS), arrived])
        is_new = np.arange(len(everything)) >= len(everything) - len(arrived)
        history = History(everything, is_new)
        found = history.features()
        own = history.order[history.new]
        meets = self._first_meetings(arrived)[own - (len(everything) - len(arrived))]
        us = everything["us"].to_numpy()
        open_rows = us >= timerValues.getCurrentWatermarkInMs() * 1000 - KEPT
        if len(pieces) >= PIECES or 2 * np.count_nonzero(open_rows) < len(open_rows):
            self._keep(everything, open_rows | is_new)
        else:
            self.pieces.appendValue(_packed(arrived))
        if not pieces:  # a timer is set as long as rows are held
            self._set_timer(us.max())
        given = everything.take(pa.array(own)).rename_columns(["cc_num", "us", "transaction_id", "amount", "merchant_name"]).to_pandas()
        yield given.assign(**found, new_merchant=meets)[_FIELDS]

    def _keep(self, rows: pa.Table, kept: np.ndarray) -> None:
        """Hold these rows only, as one piece."""
        self.pieces.put([_packed(rows.filter(pa.array(kept)))])

    def _set_timer(self, us: int) -> None:
        self.handle.registerTimer(int((us + KEPT) // 1000 + 1))

    def _first_meetings(self, arrived: pa.Table) -> np.ndarray:
        """1 where no earlier row of the card and merchant is known."""
        held = self.first.get()
        first, arrived = _unpacked([held] if held else [], MEETINGS), arrived.select(MEETINGS.names)
        full = len(first) >= self.known
        known = pa.concat_tables([first, self._seen(first, arrived)]) if full else first
        rows = pa.concat_tables([known, arrived])
        pairs = _codes(rows)[2]
        order = np.lexsort((rows["id"].to_numpy(), rows["us"].to_numpy(), pairs))
        lead = order[np.r_[True, np.diff(pairs[order]) > 0]]
        flags = np.zeros(len(rows), np.int64)
        flags[lead] = 1
        if flags[len(known) :].any():
            inside = np.isin(pairs[lead], pairs[: len(first)])
            inside |= np.cumsum(~inside) <= self.known - len(first)
            self.first.update(_packed(rows.take(pa.array(lead[inside]))))
            for r in rows.take(pa.array(lead[~inside & (lead >= len(known))])).to_pylist():
                self.seen.updateValue((_pair(r),), (r["us"], r["id"]))
        return flags[len(known) :]

    def _seen(self, first: pa.Table, arrived: pa.Table) -> pa.Table:
        """First meetings of the arrived pairs that are held one by one."""
        both = pa.concat_tables([first, arrived])
        pairs = _codes(both)[2]
        places = np.unique(pairs, return_index=True)[1]
        asked = both.take(pa.array(places[places >= len(first)])).to_pylist()
        found = [r | dict(zip(("us", "id"), self.seen.getValue((_pair(r),)))) for r in asked if self.seen.containsKey((_pair(r),))]
        return pa.Table.from_pylist(found, MEETINGS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = _unpacked(list(self.pieces.get()), ROWS)
        us = rows["us"].to_numpy()
        kept = us >= timerValues.getCurrentWatermarkInMs() * 1000 - KEPT
        if kept.any():  # later rows came since the timer was set
            self._keep(rows, kept)
            self._set_timer(us.max())
        else:
            self.pieces.clear()
        yield from ()

    def close(self) -> None:
        pass


def _pair(row: dict) -> str:
    return f"{row['cc_num']}" + ("" if row["merchant"] is None else "+" + row["merchant"])


def score_stream(payments: DataFrame, delay: str = "1 hour", slots: int = 64) -> DataFrame:
    """Velocity features of each arriving row; payments has transaction_id, cc_num, us, amount, merchant_name.

    slots: into how many parts the cards are dealt, about one for SLOT_ROWS rows of 30 days; it stays as it is as long as the checkpoint is used.
    """
    # further columns would go through the shuffle, its sort and every Python row
    timed = payments.select("transaction_id", "cc_num", "us", "amount", "merchant_name", F.timestamp_micros("us").alias("event_time")).withWatermark("event_time", delay)
    slot = F.when(F.col("cc_num").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("cc_num"), F.lit(slots)))  # rows without a card are one more
    # pandas would make doubles of a column with nulls
    return timed.withColumns({"slot": slot, "cc_num": F.coalesce("cc_num", F.lit(0).cast("long"))}).groupBy("slot").transformWithStateInPandas(Velocity(), VELOCITY, "append", "eventTime")


def decide_stream(payments: DataFrame, fitted: DataFrame, alert_at: float = 2.0, slots: int = 64) -> DataFrame:
    """Each arriving row with its rules, their score and the decision; fitted: one row with p995, from training rows, and a stored table, as every batch reads it."""
    scored = score_stream(payments, slots=slots).withColumns({"abs_amount": F.abs("amount"), "is_new_merchant": F.col("new_merchant")})
    return rules.rules_b(scored, fitted).withColumn("alert", (F.col("rule_score") >= alert_at).cast("int"))


def predict_stream(payments: DataFrame, model, columns: list[str], derived: dict[str, Column] | None = None, slots: int = 64) -> DataFrame:
    """Each arriving row with a fitted model's probability p; derived: columns that the model needs beyond the stream's own."""
    return models.probability(model, score_stream(payments, slots=slots).withColumns(derived or {}), columns)


def deduplicated(payments: DataFrame, time: str = "event_time", id_col: str = "transaction_id", delay: str = "1 hour") -> DataFrame:
    return payments.withWatermark(time, delay).dropDuplicatesWithinWatermark([id_col])


def tumbling(payments: DataFrame, time: str, label: str, size: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Rows and rate for each window, once it is closed."""
    w = payments.withWatermark(time, delay).groupBy(F.window(time, size)).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("rate"))
    return w.select(F.col("window.start").alias("start"), "n", "rate")


def drift_baseline(base: DataFrame, value: str, *by: str, bins: int = 10, floor: float = 1e-4) -> DataFrame:
    """(by, edges, shares, nulls): quantile edges of the baseline's values, the share of each bin, and the share of nulls; one row, or one for each group.

    Fitted once on a table; a null group is a group.
    """
    cuts = {f"__e{k}": k / bins for k in range(1, bins)}
    edges = quantiles.quantiles(base, value, cuts, *by).select(*[F.col(c).alias(f"__{c}") for c in by], F.array(*cuts).alias("edges"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], F.lit(True))
    met = base.join(F.broadcast(edges), same) if by else base.crossJoin(F.broadcast(edges))  # a row a group
    n = F.count(F.lit(1))
    found = met.withColumn("__bin", _bin(value, bins)).groupBy(*by, "edges").agg(_binned(bins), n.alias("__rows"), F.count(value).alias("__n"))
    shares = F.transform("bins", lambda c: F.greatest(F.coalesce(F.try_divide(c, F.col("__n")), F.lit(0.0)), F.lit(floor)))
    return found.select(*by, "edges", shares.alias("shares"), (1 - F.col("__n") / F.col("__rows")).alias("nulls"))


def _bin(value: str, bins: int) -> Column:
    """How many edges lie below a value, once a row; null where there is none."""
    above = [F.coalesce((F.get("edges", F.lit(k)) < F.col(value)).cast("int"), F.lit(0)) for k in range(bins - 1)]
    return F.when(F.col(value).isNotNull(), reduce(lambda a, b: a + b, above, F.lit(0)))


def _binned(bins: int) -> Column:
    """An array of the counts of each bin."""
    return F.array(*[F.count(F.when(F.col("__bin") == k, F.lit(1))) for k in range(bins)]).alias("bins")


def drift(payments: DataFrame, baseline: DataFrame, time: str, value: str, *by: str, bins: int = 10, size: str = "1 day", delay: str = "1 hour", floor: float = 1e-4) -> DataFrame:
    """(by, start, n, nulls, psi, kl, null_gap) of each window, once it is closed: how the values' histogram departs from the baseline's.

    The state of a window is its bins' counts, which every task sums for its own rows first. Groups without a baseline are left out; rows
    behind the watermark count nowhere here, `split_stream` keeps them apart. Every batch reads the baseline, so it should be a stored table.
    """
    timed = payments.withWatermark(time, delay)
    fixed = baseline.select(*[F.col(c).alias(f"__{c}") for c in by], "edges", "shares", F.col("nulls").alias("base_nulls"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], F.lit(True))
    met = timed.join(F.broadcast(fixed), same) if by else timed.crossJoin(F.broadcast(fixed))  # a row a group
    counts = met.withColumn("__bin", _bin(value, bins)).groupBy(*by, F.window(time, size), "edges", "shares", "base_nulls").agg(_binned(bins), F.count(F.lit(1)).alias("n"), F.count(value).alias("filled"))
    now = F.transform("bins", lambda c: F.greatest(F.coalesce(F.try_divide(c, F.col("filled")), F.lit(0.0)), F.lit(floor)))
    total = lambda f: F.aggregate(F.zip_with(F.col("now"), F.col("shares"), f), F.lit(0.0), lambda a, x: a + x)
    nulls = 1 - F.col("filled") / F.col("n")
    found = counts.withColumn("now", now)
    return found.select(*by, F.col("window.start").alias("start"), "n", nulls.alias("nulls"), total(lambda c, b: (c - b) * F.log(c / b)).alias("psi"), total(lambda c, b: c * F.log(c / b)).alias("kl"), (nulls - F.col("base_nulls")).alias("null_gap"))


def sliding(payments: DataFrame, time: str, entity: str, size: str = "1 hour", step: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    w = payments.withWatermark(time, delay).groupBy(entity, F.window(time, size, step)).agg(F.count(F.lit(1)).alias("n"))
    return w.select(entity, F.col("window.start").alias("start"), "n")


def split_late(batch: DataFrame, time: str, closed_until) -> tuple[DataFrame, DataFrame]:
    """Rows in time, and rows for the side table."""
    late = F.coalesce(F.col(time) < F.lit(closed_until), F.lit(False))
    return batch.where(~late), batch.where(late)


def split_stream(payments: DataFrame, path: str, checkpoint: str, time: str = "us", delay: int = HOUR):
    """Rows in time go to path/main, later ones to path/late, by batch: a row is late if it lies before the latest time of earlier batches less the delay.

    The latest time of each batch is kept beside its rows, so a batch that runs again splits alike and overwrites its own folders.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        latest = spark.read.schema("batch long, latest long").parquet(f"{path}/marks") if batch_id and _exists(spark, f"{path}/marks") else None
        closed = latest.where(F.col("batch") < batch_id).agg(F.max("latest")).first()[0] if latest is not None else None
        in_time, late = split_late(batch, time, -(2**63) if closed is None else closed - delay)
        in_time.write.mode("overwrite").parquet(f"{path}/main/batch={batch_id}")
        late.write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
        batch.agg(F.max(time).alias("latest")).write.mode("overwrite").parquet(f"{path}/marks/batch={batch_id}")

    return payments.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
