"""Joins: lookups, dimensions, as-of, ranges, shared keys and cycles."""

from __future__ import annotations

from functools import partial, reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.workspace import dealt, staged
from . import packing, select
from .graphs import FEW, HEAVY, heavy_join


def left_on(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    return a.join(b, a[left] == b[right], "left")


def lookup(df: DataFrame, table: DataFrame, on: str | list[str], defaults: dict) -> DataFrame:
    """df with the table's columns, defaults where there is no match. Small tables broadcast by their measured size."""
    out = df.join(table, on, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()}) if defaults else out


def fact_dimensions(fact: DataFrame, dimensions: list[tuple[DataFrame, str, str]]) -> DataFrame:
    return reduce(lambda df, d: df.join(d[0], df[d[1]] == d[0][d[2]], "left"), dimensions, fact)


def pair_all(profiles: DataFrame, items: DataFrame) -> DataFrame:
    """Every profile with every item of a catalogue; the catalogue broadcasts only if its size allows."""
    return profiles.crossJoin(items)


def as_of(df: DataFrame, facts: DataFrame, time: str, fact_time: str, value: str, *keys: str, bucket: int = 86_400_000_000) -> DataFrame:
    """df with the latest value at or before each row's time; null before the first.

    A fact is valid until the next one of its keys. Facts repeat for each time bucket that they are valid in, so both sides
    meet by an equality and the rows of df pass no window: a small table of facts broadcasts, and a large one
    joins with split partitions where a bucket is hot.
    """
    # the next fact stands in the same bucket, or is the first of the next bucket that has any: one row a bucket
    at = [f"__{k}" for k in keys]
    own = facts.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(fact_time).alias("__from"), F.col(value).alias(value)).withColumn("__b", F.floor(F.col("__from") / bucket))
    starts = own.groupBy(*at, "__b").agg(F.min("__from").alias("__first"))
    starts = starts.select(*at, "__b", F.lead("__first").over(W.partitionBy(*at).orderBy("__b")).alias("__after"))
    starts = starts.withColumnsRenamed({c: f"{c}_s" for c in [*at, "__b"]})
    met = F.col("__b") == F.col("__b_s")
    for c in at:
        met = met & F.col(c).eqNullSafe(F.col(f"{c}_s"))
    inside = F.lead("__from").over(W.partitionBy(*at, "__b").orderBy("__from"))
    valid = own.withColumn("__in", inside).join(starts, met).select(*at, "__from", F.coalesce("__in", "__after").alias("__to"), value)
    last = df.agg(F.max(time).alias("__last"))  # one row
    valid = valid.crossJoin(F.broadcast(last)).where(F.col("__from") <= F.col("__last")).where(F.col("__to").isNull() | (F.col("__to") > F.col("__from")))
    upto = F.floor(F.coalesce("__to", "__last") / bucket)
    valid = valid.withColumn("__b", F.explode(F.sequence(F.floor(F.col("__from") / bucket), upto))).drop("__last")
    keyed = df.withColumn("__at", F.floor(F.col(time) / bucket))
    same = (F.col("__at") == F.col("__b")) & (F.col(time) >= F.col("__from")) & (F.col("__to").isNull() | (F.col(time) < F.col("__to")))
    for k in keys:
        same = same & (keyed[k] == F.col(f"__{k}"))
    return keyed.join(valid, same, "left").select(*[keyed[c] for c in df.columns], value)


#: Range tables of up to so many nodes are broadcast; values and ends lie between plus and minus REACH.
NODES, REACH = 1 << 18, 1 << 61


def range_nodes(bands: DataFrame, low: str, high: str, tie: list[str]) -> DataFrame:
    """(level, prefix, best): the bands cut into dyadic intervals, at most two a level, and in best the narrowest band of each interval.

    Ends are whole numbers and belong to the band; a null end is open; a band whose ends are crossed holds nothing. Intervals that
    several bands share keep the narrowest, then the lowest, then the first by the columns of tie.
    """
    a, b = F.coalesce(F.col(low).cast("long"), F.lit(-REACH)), F.coalesce(F.col(high).cast("long"), F.lit(REACH))
    best = F.struct((b - a).alias("width"), a.alias("from"), F.struct(*[F.col(c).alias(c) for c in tie]).alias("row"))
    # of ends moved to be positive: at each level the first whole interval, and the one behind the last
    ends = bands.where(a <= b).select(best.alias("best"), (a + REACH).alias("a"), (b + REACH + 1).alias("b"))
    first, last = "shiftright(a + shiftleft(1L, j) - 1L, j)", "shiftright(b, j)"
    levels = F.expr(f"filter(transform(sequence(0, 62), j -> struct(j AS level, {first} AS first, {last} AS last)), s -> s.first < s.last)")
    left = F.transform(F.filter("levels", lambda s: s["first"] % 2 == 1), lambda s: F.struct(s["level"].alias("level"), s["first"].alias("prefix")))
    right = F.transform(F.filter("levels", lambda s: s["last"] % 2 == 1), lambda s: F.struct(s["level"].alias("level"), (s["last"] - 1).alias("prefix")))
    nodes = ends.withColumn("levels", levels).select("best", F.explode(F.concat(left, right)).alias("node"))
    return nodes.groupBy(F.col("node.level").alias("level"), F.col("node.prefix").alias("prefix")).agg(F.min("best").alias("best"))


def in_range(df: DataFrame, bands: DataFrame, value: str, low: str, high: str, small: int = NODES) -> DataFrame:
    """df with the columns of the narrowest band that holds its value, ends included; nulls where none does.

    Bands may overlap, nest and be of any width: each is at most 124 dyadic intervals, and a value meets those that hold it by equality,
    one for each level that the bands have. A table of at most `small` intervals is broadcast, and rows of df stay where they are; beyond it a row
    is sent once for each level, and the narrowest of what it met comes back by the row's number.
    """
    nodes = staged(range_nodes(bands, low, high, bands.columns), "nodes")
    levels = sorted(r["level"] for r in nodes.select("level").distinct().collect())  # 63 at most
    at = F.col(value).cast("long") + REACH
    columns = [F.col("__best.row")[c].alias(c) for c in bands.columns]
    if not levels:
        return df.select("*", *[F.lit(None).cast(bands.schema[c].dataType).alias(c) for c in bands.columns])
    if nodes.count() <= small:
        out = df.withColumn("__at", at)
        for k in levels:
            own = nodes.where(F.col("level") == k).select(F.col("prefix").alias(f"__p{k}"), F.col("best").alias(f"__b{k}"))
            out = out.join(F.broadcast(own), F.shiftright("__at", k) == F.col(f"__p{k}"), "left").drop(f"__p{k}")
        best = F.least(*[f"__b{k}" for k in levels]) if len(levels) > 1 else F.col(f"__b{levels[0]}")
        return out.withColumn("__best", best).select(*[F.col(c) for c in df.columns], *columns)
    rows = staged(df.withColumns({"__row": F.monotonically_increasing_id(), "__at": at}), "rows")
    asked = rows.where("__at IS NOT NULL").select("__row", "__at", F.explode(F.array(*[F.lit(k) for k in levels])).alias("level")).withColumn("prefix", F.expr("shiftright(__at, level)"))
    met = asked.join(nodes, ["level", "prefix"]).groupBy(F.col("__row").alias("__r")).agg(F.min("best").alias("__best"))
    return rows.join(met, F.col("__row") == F.col("__r"), "left").select(*[F.col(c) for c in df.columns], *columns)


def ip_number(address: Column) -> Column:
    """An IPv4 address as a whole number; null for what isn't one."""
    parts = F.split(F.when(address.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), address), r"\.").cast("array<long>")
    return F.when(F.forall(parts, lambda x: x <= 255), F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x))


def network_ends(network: Column) -> tuple[Column, Column]:
    """The first and last address, as numbers, of a network as in 10.0.0.0/8."""
    size = F.pow(F.lit(2.0), 32 - F.split(network, "/")[1].cast("int")).cast("long")
    first = F.floor(ip_number(F.split(network, "/")[0]) / size) * size
    return first, first + size - 1


def by_prefix(df: DataFrame, table: DataFrame, text: Column, n: int, prefix: str) -> DataFrame:
    return df.withColumn("__p", F.substring(text, 1, n)).join(table, F.col("__p") == table[prefix], "left").drop("__p")


def members(df: DataFrame, keys: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    return df.join(keys, on, "left_semi"), df.join(keys, on, "left_anti")


def shared_pairs(uses: DataFrame, by: str, who: str, block: int = 500, rows: int = 1 << 21) -> DataFrame:
    """(a, b, shared): pairs a < b and how many keys they share.

    The users of a key are dealt over lists of at most `block`, and lists meet pairwise, so that a hot key's pairs are found by many tasks and none is
    lost. Pairs aren't shuffled as rows: a user goes with the later users of a list, packed in a few bytes each, to one task, which counts about `rows` of all
    pairs. A user's pairs are at most as many as there are uses.
    """
    kind = uses.schema[who].dataType
    uses = uses.select(by, who).where(F.col(by).isNotNull() & F.col(who).isNotNull())
    if not isinstance(kind, T.IntegralType):
        return _numbered_pairs(uses, by, who, block, rows)
    block = min(block, (1 << 16) - 1)  # lengths are sent in two bytes
    kept = T.StructType([uses.schema[by], T.StructField("users", T.ArrayType(T.LongType()))])
    # a hot key lies in many ranges of (key, user)
    sorted_uses = uses.withColumn(who, F.col(who).cast("long")).repartitionByRange(by, who).sortWithinPartitions(by, who)
    lists = staged(sorted_uses.mapInArrow(partial(packing.lists, block=block), kept), "users").withColumn("n", F.size("users").cast("long"))
    low, high, inner = lists.agg(F.min(F.col("users")[0]), F.max(F.element_at("users", -1)), F.sum(F.expr("n * (n - 1) div 2"))).first()
    if low is None:
        return uses.sparkSession.createDataFrame([], f"a {kind.simpleString()}, b {kind.simpleString()}, shared long")
    if high - low >= 1 << 32:
        return _numbered_pairs(lists.select(by, F.explode(F.col("users").cast(T.ArrayType(kind))).alias(who)), by, who, block, rows)
    width = max(1, -(-(high - low).bit_length() // 8))
    # keys of several lists: large ones, and those that two ranges share
    several = staged(lists.groupBy(by).agg(F.count(F.lit(1)).alias("lists"), F.expr("(sum(n) * sum(n) - sum(n * n)) div 2").alias("pairs")).where("lists > 1"), "several")
    outer = several.agg(F.sum("pairs")).first()[0] or 0
    lists = lists.withColumn("users", F.transform("users", lambda x: (x - F.lit(low)).cast("int" if width < 4 else "long")))
    met = dealt(lists.where("n > 1").select(F.col("users").alias("xs"), F.lit(None).cast(lists.schema["users"].dataType).alias("ys")), rows=rows, n=inner)
    if outer:
        # lists i < j of a key meet: all users of the first are before those of the second
        own = lists.join(several.drop("pairs"), by).withColumn("k", F.row_number().over(W.partitionBy(by).orderBy(F.col("users")[0])).cast("long"))
        left = own.where("k < lists").select(by, F.col("k").alias("__i"), F.explode(F.expr("sequence(k + 1, lists)")).alias("__j"), F.col("users").alias("xs"))
        right = own.where("k > 1").select(by, F.explode(F.expr("sequence(1L, k - 1)")).alias("__i"), F.col("k").alias("__j"), F.col("users").alias("ys"))
        left, right = (dealt(x, by, "__i", "__j", rows=rows, n=int(outer)) for x in (left, right))
        met = met.unionByName(left.join(right.hint("merge"), [by, "__i", "__j"]).select("xs", "ys"))
    tasks = max(8, -(-int(inner + outer) // rows))
    sent = met.mapInArrow(partial(packing.packed, tasks=tasks, width=width), "task int, owners binary, counts binary, others binary")
    found = sent.repartitionById(tasks, F.col("task")).mapInArrow(partial(packing.counted, low=low, width=width), "a long, b long, shared long")
    return found.select(*[F.col(c).cast(kind).alias(c) for c in ("a", "b")], "shared")


def _numbered_pairs(uses: DataFrame, by: str, who: str, block: int, rows: int) -> DataFrame:
    """shared_pairs of users that are no whole numbers, or lie far apart: by numbers in their order."""
    uses = staged(uses.distinct(), "uses")
    numbers = staged(select.global_index(uses.select(who).distinct(), who, out="__n"), "numbers")
    out = shared_pairs(uses.join(numbers, who).select(by, "__n"), by, "__n", block, rows)
    for c in ("a", "b"):
        out = out.join(numbers.select(F.col("__n").alias(c), F.col(who).alias(f"__{c}")), c).drop(c)
    return out.select(F.col("__a").alias("a"), F.col("__b").alias("b"), "shared")


#: Edges of an account in a time bucket up to which its edges meet in one task.
HUB = 4096


def cycles(edges: DataFrame, within: int, src: str = "src", dst: str = "dst", time: str = "us", id_col: str = "o_orderkey", hub: int = HUB) -> DataFrame:
    """(first, second, third): A to B to C to A in rising time, all within a span.

    Edges are dealt by time bucket, as long as the span; a later edge stands in the first one's bucket or in the next. Where no account has more
    than `hub` edges in a bucket, they simply meet by account and bucket; otherwise by triangles, whose cost no hub drives up.
    """
    e = edges.where(F.col(src) != F.col(dst))
    bucket = F.floor(F.col(time) / max(1, within)).alias("w")
    ends = e.select(bucket, F.col(src).alias("node")).unionByName(e.select(bucket, F.col(dst).alias("node")))
    most = ends.groupBy("w", "node").count().agg(F.max("count")).first()[0]
    return (_cycles_by_account if (most or 0) <= hub else cycles_by_triangles)(edges, within, src, dst, time, id_col)


def _cycles_by_account(edges: DataFrame, within: int, src: str, dst: str, time: str, id_col: str) -> DataFrame:
    e = edges.where(F.col(src) != F.col(dst))
    a, b, c = (e.select(F.col(src).alias(f"s{k}"), F.col(dst).alias(f"d{k}"), F.col(time).alias(f"t{k}"), F.col(id_col).alias(k)) for k in ("first", "second", "third"))
    bucket = lambda k: F.floor(F.col(f"t{k}") / max(1, within))
    a = a.withColumn("__w", bucket("first"))
    # a later edge stands in the first one's bucket or in the next
    b, c = (x.withColumn("__w", F.explode(F.array(bucket(k), bucket(k) - 1))) for x, k in ((b, "second"), (c, "third")))
    two = a.join(b, (a["__w"] == b["__w"]) & (F.col("dfirst") == F.col("ssecond")) & (F.col("tsecond") > F.col("tfirst")) & (F.col("tsecond") - F.col("tfirst") <= within)).drop(b["__w"])
    three = two.join(c, (two["__w"] == c["__w"]) & (F.col("dsecond") == F.col("sthird")) & (F.col("dthird") == F.col("sfirst")) & (F.col("tthird") > F.col("tsecond")) & (F.col("tthird") - F.col("tfirst") <= within))
    return three.select("first", "second", "third")


def cycles_by_triangles(edges: DataFrame, within: int, src: str = "src", dst: str = "dst", time: str = "us", id_col: str = "o_orderkey", block: int = 1000, heavy: int = HEAVY, few: int = FEW) -> DataFrame:
    """The rows of cycles(), from the triangles of each bucket.

    In a bucket the accounts that trade with each other are a graph, and only its triangles can hold cycles. They are listed from their account of least
    degree: such an account has at most the root of twice the bucket's pairs of larger ones beside it, however many a hub has; these neighbours meet in a
    grid of blocks. What is known of a hub goes to its pairs by `heavy_join`. The edges of a triangle then meet in each of its six orders.
    """
    e = edges.where(F.col(src) != F.col(dst)).select(F.col(src).alias("s"), F.col(dst).alias("d"), F.col(time).alias("t"), F.col(id_col).alias("id"))
    own = F.floor(F.col("t") / max(1, within))
    later = staged(e.withColumn("w", F.explode(F.array(own, own - 1))), "edges")
    pairs = staged(later.select("w", F.least("s", "d").alias("x"), F.greatest("s", "d").alias("y")).distinct(), "pairs")
    account = lambda c: F.struct("w", F.col(c).alias("node"))
    ends = pairs.select(account("x").alias("k")).unionByName(pairs.select(account("y").alias("k")))
    degrees = staged(ends.groupBy("k").agg(F.count(F.lit(1)).alias("degree")).withColumn("n", F.col("degree")), "degrees")
    known = pairs
    for c in ("x", "y"):
        known = heavy_join(known.withColumn("k", account(c)), degrees, "k", "n", heavy, few).withColumnRenamed("degree", f"{c}_degree").drop("k")
    lower = F.struct("x_degree", "x") < F.struct(F.col("y_degree").alias("x_degree"), F.col("y").alias("x"))
    out = staged(known.select("w", F.when(lower, F.col("x")).otherwise(F.col("y")).alias("u"), F.when(lower, F.col("y")).otherwise(F.col("x")).alias("v")), "out")
    sizes = out.groupBy("w", "u").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    dealt = out.join(sizes, ["w", "u"]).withColumn("k", F.pmod(F.xxhash64("v"), F.col("blocks")))
    left = dealt.select("w", "u", F.col("v").alias("b"), F.col("k").alias("i"), F.explode(F.sequence(F.col("k"), F.col("blocks") - 1)).alias("j"))
    right = dealt.select("w", "u", F.col("v").alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("k"))).alias("i"), F.col("k").alias("j"))
    wedges = left.join(right, ["w", "u", "i", "j"]).where("i < j OR b < c").where("b <> c").select("w", "u", F.least("b", "c").alias("x"), F.greatest("b", "c").alias("y"))
    triangles = wedges.join(pairs, ["w", "x", "y"])
    nodes = ("u", "x", "y")
    orders = [F.struct(*[F.col(n).alias(k) for n, k in zip(order, ("a", "b", "c"))]) for order in permutations(nodes)]
    walks = staged(triangles.select("w", F.explode(F.array(*orders)).alias("o")).select("w", "o.*"), "walks")
    step = lambda k, start, end: later.select("w", F.col("s").alias(start), F.col("d").alias(end), F.col("t").alias(f"t{k}"), F.col("id").alias(k))
    first = step("first", "a", "b").where(F.floor(F.col("tfirst") / max(1, within)) == F.col("w"))
    one = walks.join(first, ["w", "a", "b"])
    two = one.join(step("second", "b", "c"), ["w", "b", "c"]).where((F.col("tsecond") > F.col("tfirst")) & (F.col("tsecond") - F.col("tfirst") <= within))
    three = two.join(step("third", "c", "a"), ["w", "c", "a"]).where((F.col("tthird") > F.col("tsecond")) & (F.col("tthird") - F.col("tfirst") <= within))
    return three.select("first", "second", "third")


def fan(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    out = edges.groupBy(F.col(src).alias("node")).agg(F.countDistinct(dst).alias("fan_out"))
    into = edges.groupBy(F.col(dst).alias("node")).agg(F.countDistinct(src).alias("fan_in"))
    return out.join(into, "node", "full").na.fill(0, ["fan_out", "fan_in"])
