"""Measures of a flow of transfers: how circular, concentrated, mechanical and fresh it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexora.scale import ranged


def flow_metrics(transfers: DataFrame, key: str = "symbol") -> DataFrame:
    """Per key: sample_size, circularity, net_volume, senders, receivers, counterparties, sender_hhi, quantization,
    interarrival_cv, manipulation_score, data_quality. transfers: key, value, src, dst, ts.

    Net volume is half the sum of all balances' absolute changes; circularity is what of the gross it isn't. Measures
    that a sample can't support are null, and the score weighs those that are there. Values count by their size; missing
    ones as 0, and empty addresses as missing.
    """
    addr = lambda c: F.nullif(F.col(c), F.lit(""))
    t = transfers.select(F.col(key).alias("k"), F.abs(F.coalesce(F.col("value").cast("double"), F.lit(0.0))).alias("v"), addr("src").alias("s"), addr("dst").alias("d"), "ts")
    legs = t.select("k", F.explode(F.array(F.struct(F.col("s").alias("w"), (-F.col("v")).alias("x"), F.lit(1).alias("out")), F.struct(F.col("d").alias("w"), F.col("v").alias("x"), F.lit(0).alias("out")))).alias("l"))
    legs = legs.select("k", "l.*").where(F.col("w").isNotNull())
    wallet = legs.groupBy("k", "w").agg(
        F.sum("x").alias("change"), F.sum(F.when(F.col("out") == 1, -F.col("x"))).alias("sent"), F.max("out").alias("sends"), F.max(1 - F.col("out")).alias("gets")
    )
    by_wallet = wallet.groupBy("k").agg(
        (F.sum(F.abs("change")) / 2).alias("net"), F.sum("sends").alias("senders"), F.sum("gets").alias("receivers"), F.count(F.lit(1)).alias("counterparties"),
        F.sum("sent").alias("all_sent"), F.sum(F.col("sent") * F.col("sent")).alias("sq"),
    )
    total = t.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("gross"))
    sizes = t.where(F.col("v") > 0).groupBy("k", F.round("v", 8).alias("q")).agg(F.count(F.lit(1)).alias("c"))
    quant = sizes.groupBy("k").agg((F.max("c") / F.sum("c")).alias("quant"))
    pace = gaps(t.where(F.col("ts").isNotNull()).select("k", "ts"))
    j = total.join(by_wallet, "k", "left").join(quant, "k", "left").join(pace, "k", "left")
    circ = F.when(F.col("gross") > 0, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce("net", F.lit(0.0)) / F.col("gross"))), 4))
    hhi = F.when(F.col("all_sent") > 0, F.round(F.col("sq") / (F.col("all_sent") * F.col("all_sent")), 4))
    cv = F.when((F.col("gaps") >= 2) & (F.col("mean") > 0), F.round(F.col("sd") / F.col("mean"), 4))
    m = j.select(
        F.col("k").alias(key), F.col("n").alias("sample_size"), circ.alias("circularity"), F.when(F.col("gross") > 0, F.round(F.coalesce("net", F.lit(0.0)), 4)).alias("net_volume"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("senders", "receivers", "counterparties")],
        hhi.alias("sender_hhi"), F.round("quant", 4).alias("quantization"), cv.alias("interarrival_cv"),
    )
    parts = ((0.40, F.col("circularity")), (0.30, F.col("sender_hhi")), (0.20, F.col("quantization")), (0.10, F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), F.col("interarrival_cv")))))
    up = down = F.lit(0.0)
    for w, c in parts:
        # greatest() skips nulls, so the regularity of an unknown pace is told by the pace itself
        c = F.when(F.col("interarrival_cv").isNotNull(), c) if w == 0.10 else c
        up, down = up + F.coalesce(c * w, F.lit(0.0)), down + F.when(c.isNotNull(), w).otherwise(0.0)
    m = m.withColumn("manipulation_score", F.when(down > 0, F.round(up / down, 4)))
    s = F.col("manipulation_score")
    quality = F.when((F.col("sample_size") < 3) | s.isNull(), "sparse").when(s >= 0.66, "suspect").when(s >= 0.33, "mixed").otherwise("organic")
    return m.withColumn("data_quality", quality)


def gaps(moments: DataFrame) -> DataFrame:
    """k, gaps, mean, sd: number, mean and population deviation of the gaps between a key's consecutive moments (k, ts).

    Moments are sorted over all tasks; gaps are taken within each sorted piece of a key, and those between two pieces from
    the pieces' ends, so that a key may hold any share of the rows.
    """
    m = ranged(moments, ["k"], [F.col("ts")], "gaps")
    inner = m.select("k", (F.col("ts") - F.lag("ts").over(Window.partitionBy("k", "__part").orderBy("ts"))).alias("gap"))
    ends = m.groupBy("k", "__part").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    between = ends.select("k", (F.col("a") - F.lag("b").over(Window.partitionBy("k").orderBy("__part"))).alias("gap"))
    every = inner.unionByName(between)
    return every.groupBy("k").agg(F.count("gap").alias("gaps"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("sd"))


def holder_metrics(balances: DataFrame, key: str, balance: str, holders: str, complete: str) -> DataFrame:
    """Per key: active_holders, lower_bound, dust_share (of all holders), top_share (of the active balance)."""
    g = balances.groupBy(key).agg(
        F.count(balance).alias("active_holders"), F.sum(balance).alias("b"), F.max(balance).alias("m"), F.max(holders).alias("h"), F.min(F.col(complete).cast("int")).alias("c")
    )
    return g.select(
        key, "active_holders", (F.col("c") == 0).alias("lower_bound"),
        F.when(F.col("h") > 0, F.round(F.greatest(F.lit(0.0), 1 - F.col("active_holders") / F.col("h")), 4)).alias("dust_share"),
        F.when(F.col("b") > 0, F.round(F.col("m") / F.col("b"), 4)).alias("top_share"),
    )


def age_bucket(now: int, at: Column) -> Column:
    """<1h, 1-24h, 1-7d, >7d, or none; the clock is a parameter."""
    a = F.lit(now) - at
    return F.when(at.isNull() | (at == 0), "none").when(a < 3600, "<1h").when(a < 86400, "1-24h").when(a < 604800, "1-7d").otherwise(">7d")


def freshness(assets: DataFrame, transfers: DataFrame, now: int) -> DataFrame:
    """One row: head, newest block and time, seconds per block, lag in blocks and seconds, counts and age buckets.

    assets: observed_head, activity_block, activity_at; transfers: block, ts. The pace comes from the first and the last
    (block, time) pair; the head is at least where the newest event is.
    """
    both = transfers.select("block", "ts").unionByName(assets.select(F.col("activity_block").alias("block"), F.col("activity_at").alias("ts")))
    pair = F.when((F.col("block") > 0) & (F.col("ts") > 0), F.struct("block", "ts"))
    e = both.agg(F.min(pair).alias("a"), F.max(pair).alias("b"), F.max("block").alias("newest_block"), F.max("ts").alias("newest_at"))
    bucket = age_bucket(now, F.col("activity_at"))
    counts = [F.sum(F.when(bucket == b, 1).otherwise(0)).alias(n) for b, n in (("<1h", "age_1h"), ("1-24h", "age_24h"), ("1-7d", "age_7d"), (">7d", "age_older"), ("none", "age_none"))]
    a = assets.agg(F.max("observed_head").alias("seen"), F.count(F.lit(1)).alias("assets"), *counts)
    n = transfers.agg(F.count(F.lit(1)).alias("transfers"))
    j = e.join(a, how="cross").join(n, how="cross")  # three single rows
    pace = F.when(F.col("b.block") > F.col("a.block"), (F.col("b.ts") - F.col("a.ts")) / (F.col("b.block") - F.col("a.block")))
    head = F.when(F.col("seen").isNotNull(), F.greatest("seen", "newest_block"))
    return j.select(
        head.alias("head"), "newest_block", "newest_at", (F.lit(now) - F.col("newest_at")).alias("newest_age"), F.round(pace, 4).alias("sec_per_block"),
        (head - F.col("newest_block")).alias("lag_blocks"), F.round((head - F.col("newest_block")) * pace).alias("lag_seconds"), "assets", "transfers",
        "age_1h", "age_24h", "age_7d", "age_older", "age_none",
    )


def largest(transfers: DataFrame, key: str, n: int, order: str = "value", tie: str = "id") -> DataFrame:
    """The n largest transfers of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order), tie)
    return transfers.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def flow_graph(assets: DataFrame, transfers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, entity_type, symbol) and edges (src, rel, dst) of assets and transfers.

    Of an asset's rows the one of the highest block counts, of equal ones the last; assets that only transfers name are
    made up; of transfers with one id the first counts, but each of its rows gives its edges; wallets are one node
    whatever their case.
    """
    w = Window.partitionBy("symbol").orderBy(F.col("block").desc_nulls_last(), F.desc("seq"))
    known = assets.withColumn("rn", F.row_number().over(w)).where(F.col("rn") == 1).select("symbol")
    named = known.unionByName(transfers.select("symbol")).where(F.col("symbol").isNotNull()).distinct()
    node = lambda c: F.concat(F.lit("asset:"), F.col(c))
    asset_nodes = named.select(node("symbol").alias("id"), F.lit("Asset").alias("entity_type"), "symbol")
    t = transfers.where(F.col("id").isNotNull())
    tx = t.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy("seq"))).where(F.col("rn") == 1)
    tx_nodes = tx.select("id", F.lit("Transfer").alias("entity_type"), "symbol")
    wallet = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit("wallet:"), F.lower(F.col(c))))
    ends = t.select(F.explode(F.array(wallet("src"), wallet("dst"))).alias("id")).where(F.col("id").isNotNull()).distinct()
    nodes = asset_nodes.unionByName(tx_nodes).unionByName(ends.select("id", F.lit("Wallet").alias("entity_type"), F.lit(None).cast("string").alias("symbol")))
    e = F.array(
        F.struct(F.col("id").alias("src"), F.lit("ofAsset").alias("rel"), node("symbol").alias("dst")),
        F.struct(wallet("src").alias("src"), F.lit("sent").alias("rel"), F.col("id").alias("dst")),
        F.struct(F.col("id").alias("src"), F.lit("receivedBy").alias("rel"), wallet("dst").alias("dst")),
    )
    edges = t.select(F.explode(e).alias("e")).select("e.*").where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    return nodes, edges
