"""Global order without one task: row numbers, running totals and average ranks by range partitions, quantiles by radix selection.

A sort of all rows is dealt to range partitions; each partition runs its own totals, and the totals of the partitions
(one number each) are added up on the driver. Quantiles need no sort: passes over the ordered bits of a double narrow
the place of each order statistic, 16 bits a pass, with a histogram of at most 65,536 rows a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.files import stored

#: Rows of one group that the last step of a quantile may order at once; larger rests are narrowed by another pass.
SMALL = 1 << 16


def running_totals(df: DataFrame, order: Sequence[str | Column], weight: str | None = None, to: str = "total") -> DataFrame:
    """``df`` with the sum of ``weight`` (a whole number; null: 1 a row) over all rows up to and with this one in ``order``.

    Rows that tie in ``order`` follow each other in any, but fixed, sequence: the result is written once. A tie as
    large as a partition stays in one partition; collapse ties to counts beforehand.
    """
    schema = StructType([*df.schema.fields, StructField("_part", LongType()), StructField("_run", LongType())])
    names, place = schema.names, df.columns.index(weight) if weight else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, so_far = TaskContext.get().partitionId(), 0
        for batch in batches:
            each = np.ones(batch.num_rows, np.int64) if place is None else batch.column(place).to_numpy(zero_copy_only=False).astype(np.int64)
            total = np.cumsum(each) + so_far
            so_far = int(total[-1]) if len(total) else so_far
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int64)), pa.array(total)], names)

    dealt = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema))
    # one row a partition
    ends = sorted((r["_part"], r["n"]) for r in dealt.groupBy("_part").agg(F.max("_run").alias("n")).collect())
    starts = dict(zip([p for p, _ in ends], accumulate([0, *(n for _, n in ends)]), strict=False))
    before = df.sparkSession.createDataFrame(list(starts.items()) or [(0, 0)], "_part long, _before long")
    return dealt.join(F.broadcast(before), "_part").withColumn(to, F.col("_run") + F.col("_before")).drop("_part", "_run", "_before")


def numbered(df: DataFrame, order: Sequence[str | Column], to: str = "number") -> DataFrame:
    """``df`` with row numbers 1, 2, 3, ... in ``order``."""
    return running_totals(df, order, None, to)


def distinct_ranks(counts: DataFrame, group: Sequence[str], value: str, n: str, to: str) -> DataFrame:
    """Average ranks of distinct values with their counts, within ``group``; a group may be as large as the table."""
    run = stored(running_totals(counts, [*group, value], n, "_total"))
    if not group:
        return run.withColumn(to, F.col("_total") - (F.col(n) - 1) / 2).drop("_total")
    starts = run.groupBy(*group).agg(F.min(F.col("_total") - F.col(n)).alias("_start"))
    same = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group]
    joined = run.alias("a").join(starts.alias("b"), same)
    return joined.select(*[f"a.{c}" for c in counts.columns], (F.col("_total") - F.col("_start") - (F.col(n) - 1) / 2).alias(to))


#: Rounds of the keyed permutation, each of which may swap any row with a partner.
ROUNDS = 24


def hash_number(*parts: Column) -> Column:
    """The first 32 bits of the MD5 of the parts' text, joined by ``|``: a draw that every engine can tell."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def permuted(place: Column, n: int, *key: Column, rounds: int = ROUNDS) -> Column:
    """Where the random permutation of 0 .. n - 1 that belongs to ``key`` sends ``place``.

    A swap-or-not shuffle: in each round a place and its mirror image about a keyed point change sides together or not,
    by a bit of the larger of the two. It needs neither other rows nor a sort, and is a bijection for every n.
    """
    if n < 2:
        return place

    def round_(at: Column, k: Column) -> Column:
        other = F.pmod(hash_number(*key, k) % n - at, F.lit(n).cast("long"))
        return F.when(hash_number(*key, k, F.greatest(at, other)) % 2 == 1, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), place.cast("long"), round_)


def _ordered_bits(v: pd.Series) -> pd.Series:
    bits = np.ascontiguousarray(v.to_numpy(np.float64)).view(np.int64)
    return pd.Series(np.where(bits < 0, ~bits ^ np.int64(-(2**63)), bits))


def _value_of(bits: pd.Series) -> pd.Series:
    b = bits.to_numpy(np.int64)
    return pd.Series(np.where(b < 0, ~(b ^ np.int64(-(2**63))), b).view(np.float64))


def _same(left: str, right: str, names: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in names:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def exact_quantiles(df: DataFrame, wanted: Mapping[str, Mapping[str, float]], by: Sequence[str] = (), count: str | None = None, small: int = SMALL) -> DataFrame:
    """Linearly interpolated quantiles ``{column: {name: p}}`` of each group, exact at every size.

    No group's values are gathered: each pass counts 16 more of the ordered bits of the values that can still be one
    of the order statistics asked for, until a group has at most ``small`` of them or all 64 bits are told. Nulls
    count for nothing, NaN stands above all numbers; a group without values is left out. Without ``by`` there is always
    one row, of nulls where there is no value.
    ``count`` names a column for the number of values of the first column.
    """
    by, g = list(by), [*by, "_c"]
    columns = list(wanted)
    bits_of, value_of = F.pandas_udf(_ordered_bits, "long"), F.pandas_udf(_value_of, "double")
    long = df.select(*by, F.posexplode(F.array(*[F.col(c).cast("double") + F.lit(0.0) for c in columns])).alias("_c", "_v")).filter("_v is not null")
    data = stored(long.select(*g, bits_of("_v").alias("_bits")))
    sizes = stored(data.groupBy(*g).agg(F.count("*").alias("_n")))
    asked = F.array(*[F.struct(F.lit(k).alias("c"), F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for k, c in enumerate(columns) for name, p in wanted[c].items()])
    place = (F.col("_n") - 1) * F.col("_q.p")
    at = sizes.withColumn("_q", F.explode(asked)).filter("_q.c = _c").select(*g, "_n", F.col("_q.name").alias("_name"), place.alias("_at"))
    sides = F.explode(F.array(F.floor("_at"), F.ceil("_at"))).alias("_k")
    targets = at.select(*g, sides).distinct().select(*g, "_k", F.col("_k").alias("_left"), F.lit(0).cast("long").alias("_prefix"))

    def leading(shift: int) -> Column:
        return F.shiftright("_bits", shift) if shift < 64 else F.lit(0).cast("long")

    def held(targets: DataFrame, shift: int) -> DataFrame:
        """Values that share all but their last ``shift`` bits with some target."""
        rows = data.withColumn("_prefix", leading(shift))
        return rows if shift == 64 else rows.alias("a").join(targets.select(*g, "_prefix").distinct().alias("b"), _same("a", "b", [*g, "_prefix"]), "left_semi")

    def next_digit(targets: DataFrame, shift: int) -> DataFrame:
        """Targets with 16 more bits in their prefix, and how many values share it."""
        digit = leading(48) if shift == 48 else leading(shift).bitwiseAND(F.lit(0xFFFF))
        digits = held(targets, shift + 16).groupBy(*g, "_prefix", digit.alias("_d")).agg(F.count("*").alias("_m"))
        w = F.sum("_m").over(Window.partitionBy(*g, "_prefix").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1))
        told = digits.withColumn("_before", F.coalesce(w, F.lit(0)))
        found = targets.drop("_m").alias("a").join(told.alias("b"), _same("a", "b", [*g, "_prefix"]) & (F.col("_left") >= F.col("_before")) & (F.col("_left") < F.col("_before") + F.col("_m")))
        prefix = F.col("_d") if shift == 48 else F.shiftleft(F.col("a._prefix"), 16).bitwiseOR(F.col("_d"))
        return stored(found.select(*[F.col(f"a.{c}").alias(c) for c in g], "_k", (F.col("_left") - F.col("_before")).alias("_left"), prefix.alias("_prefix"), "_m"))

    shift, most = 64, sizes.agg(F.max("_n")).first()[0] or 0
    while shift and most > small:
        shift -= 16
        targets = next_digit(targets, shift)
        most = targets.agg(F.max("_m")).first()[0] or 0
    if shift:
        w = Window.partitionBy(*g, "_prefix").orderBy("_bits")
        rest = held(targets, shift).groupBy(*g, "_prefix", "_bits").agg(F.count("*").alias("_m")).withColumn("_upto", F.sum("_m").over(w))
        found = targets.drop("_m").alias("a").join(rest.alias("b"), _same("a", "b", [*g, "_prefix"]) & (F.col("_left") < F.col("_upto")) & (F.col("_left") >= F.col("_upto") - F.col("_m")))
        targets = found.select(*[F.col(f"a.{c}").alias(c) for c in g], "_k", F.col("_bits").alias("_prefix"))
    values = stored(targets.select(*g, "_k", F.coalesce(value_of("_prefix"), F.lit(math.nan)).alias("_value")))
    low, high = (values.select(*[F.col(c).alias(f"{s}{c}") for c in g], F.col("_k").alias(f"{s}k"), F.col("_value").alias(f"{s}value")) for s in "lh")
    match = lambda s, k: _all([F.col(c).eqNullSafe(F.col(f"{s}{c}")) for c in g]) & (F.col(f"{s}k") == k)
    both = at.join(low, match("l", F.floor("_at"))).join(high, match("h", F.ceil("_at")))
    part = F.col("_at") - F.floor("_at")
    value = F.when(part == 0, F.col("lvalue")).otherwise(F.col("lvalue") * (1 - part) + F.col("hvalue") * part)
    names = [(k, name) for k, c in enumerate(columns) for name in wanted[c]]
    cells = [F.max(F.when((F.col("_c") == k) & (F.col("_name") == name), value)).alias(name) for k, name in names]
    return both.groupBy(*by).agg(*cells, *([F.max(F.when(F.col("_c") == 0, F.col("_n"))).alias(count)] if count else []))


def _all(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
