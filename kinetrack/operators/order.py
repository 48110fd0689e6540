"""Markov-order tests on state sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kinematics import KEY


def fold_of(key: Sequence[str] = KEY, folds: int = 5, seed: int = 0) -> Column:
    """Fold of a track: the first 8 hex digits of MD5(key|seed), modulo ``folds``; the same in every engine."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed)))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % folds).cast("int")


def context_counts(states: DataFrame, order: int, by: Sequence[str] = (), key: Sequence[str] = KEY, index: str = "idx") -> DataFrame:
    """M5: counts of each next state after each context (the ``order`` states before it, as digits)."""
    w = Window.partitionBy(*key).orderBy(index)
    ctx = F.concat(*[F.lag("state", k).over(w).cast("string") for k in range(order, 0, -1)]) if order else F.lit("")
    return states.select(*by, ctx.alias("ctx"), F.col("state").alias("next")).filter("ctx is not null").groupBy(*by, "ctx", "next").agg(F.count("*").alias("n"))


def order_test(states: DataFrame, orders: Sequence[int] = (0, 1, 2, 3), folds: int = 5, alpha: float = 0.5, key: Sequence[str] = KEY, index: str = "idx", n_states: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """M6: held-out log-likelihood per token for each order (of each group), K-fold by track.

    One pass counts the contexts of all orders; a fold's training counts are the total less its own, by windows over
    that table (at most orders x folds x contexts x states rows a group). Contexts that training has not seen fall back to
    its smoothed state frequencies.
    """
    w = Window.partitionBy(*key).orderBy(index)
    top = max(orders)
    past = states.select(*by, "state", fold_of(key, folds).alias("fold"), *[F.lag("state", k).over(w).cast("string").alias(f"_{k}") for k in range(1, top + 1)])
    contexts = F.array(*[F.struct(F.lit(o).alias("order"), F.concat(F.lit(""), *[F.col(f"_{k}") for k in range(o, 0, -1)]).alias("ctx")) for o in sorted({0, *orders})])
    counts = past.select(*by, "fold", F.col("state").alias("next"), F.explode(contexts).alias("c")).filter("c.ctx is not null").groupBy(*by, "c.order", "fold", "c.ctx", "next").agg(F.count("*").alias("n"))
    over = lambda *of: F.sum("n").over(Window.partitionBy(*by, "order", *of))
    table = counts.withColumns({"t": over("ctx", "next"), "seen": over("ctx") - over("fold", "ctx")})
    zero = counts.filter("order = 0").withColumns({"c": over("next") - F.col("n"), "all": over() - over("fold")})
    back = zero.select(*by, "fold", "next", ((F.col("c") + alpha) / (F.col("all") + alpha * n_states)).alias("g"))
    p = F.when(F.col("seen") > 0, (F.col("t") - F.col("n") + alpha) / (F.col("seen") + alpha * n_states)).otherwise(F.col("g"))
    scored = table.filter(F.col("order").isin(*orders)).join(F.broadcast(back), [*by, "fold", "next"]).withColumn("ll", F.col("n") * F.log(p + 1e-12))
    return scored.groupBy(*by, "order").agg((F.sum("ll") / F.sum("n")).alias("ll_per_token"), F.sum("n").alias("n_tokens"))


def order_gains(tests: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Gains g1, g2, g3 of each order over the one below (of each group), with perplexity ratios."""
    below = tests.select(*by, (F.col("order") + 1).alias("order"), F.col("ll_per_token").alias("below"))
    g = F.col("ll_per_token") - F.col("below")
    return tests.join(below, [*by, "order"]).select(*by, "order", g.alias("gain"), F.exp(-g).alias("perplexity_ratio"))


def memory_share(real: Column, null: Column, homogeneous: Column) -> Column:
    """Share of the gain beyond the null, of the gain beyond a homogeneous null; null where that is 0."""
    return F.when(real != homogeneous, (real - null) / (real - homogeneous))
