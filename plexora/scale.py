"""Helpers that keep plans safe at scale: staging, checked broadcasts, heavy keys and salted joins."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key is heavy when it holds at least this share of all rows; so there are at most 1 / HEAVY_SHARE heavy keys.
HEAVY_SHARE = 1 / 256
#: Rows below which no key is worth salting.
HEAVY_ROWS = 20_000
#: Rows up to which a side may be broadcast.
BROADCAST_ROWS = 50_000

_OWN_DIR: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a temporary one only where it is unset (tests)."""
    global _OWN_DIR
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _OWN_DIR is None:
        _OWN_DIR = tempfile.mkdtemp(prefix="plexora-")
        atexit.register(lambda d=_OWN_DIR: __import__("shutil").rmtree(d, ignore_errors=True))
    return "file://" + _OWN_DIR


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table that is read more than once to the shared folder and read it back.

    Unlike an in-memory cache it survives the loss of executors, and its size is known to the planner afterwards. The
    folder is removed when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plexora-stage/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    _remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    """Leaves the removal to the folder's own file system, when the driver's JVM ends."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most max_rows rows; looks at no more than max_rows + 1 of them."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The broadcast hint, behind a check of the number of rows; beyond it the planner joins by shuffle."""
    return F.broadcast(df) if small(df, max_rows) else df


def heavy_keys(df: DataFrame, key: str, share: float = HEAVY_SHARE, least: int = HEAVY_ROWS) -> dict:
    """Keys that hold at least `share` of the rows (and `least` rows), with their counts.

    The counts are pre-aggregated before the shuffle, and no more than 1 / share keys can qualify, so what comes to the
    driver is bounded whatever the data.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") >= least)
    top = counts.orderBy(F.desc("count")).limit(int(1 / share)).collect()
    if not top:
        return {}
    total = df.count()
    return {r[0]: r["count"] for r in top if r["count"] >= share * total}


def _salts(heavy: dict, per_task: int) -> dict:
    return {k: max(2, -(-n // per_task)) for k, n in heavy.items()}


def salted_join(
    big: DataFrame,
    unique: DataFrame,
    key: str,
    how: str = "left",
    spread: Sequence[str] = (),
    per_task: int = HEAVY_ROWS,
    heavy: dict | None = None,
) -> DataFrame:
    """Sort-merge join of `big` with `unique` on `key`, heavy keys of `big` split over several tasks.

    Rows of a heavy key get a salt from the hash of the `spread` columns; the other side's rows of that key (only these)
    are repeated once per salt. All other keys join as they are. how: inner or left.
    """
    heavy = heavy_keys(big, key) if heavy is None else heavy
    if not heavy:
        return big.hint("merge").join(unique, key, how)
    n = F.coalesce(_lookup(_salts(heavy, per_task), F.col(key)), F.lit(1))
    cols = [F.col(c) for c in (spread or [c for c in big.columns if c != key])]
    left = big.withColumn("__salt", F.pmod(F.xxhash64(*cols), n.cast("bigint")).cast("int"))
    right = unique.withColumn("__salt", F.explode(F.sequence(F.lit(0), n - 1)))
    return left.hint("merge").join(right, [key, "__salt"], how).drop("__salt")


def _lookup(values: dict, key: Column) -> Column:
    """values[key] as an expression; values is bounded by 1 / HEAVY_SHARE entries."""
    pairs: list[Column] = []
    for k, v in values.items():
        pairs += [F.lit(k), F.lit(int(v))]
    return F.create_map(*pairs)[key].cast("int")


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """df sorted by keys and order over all tasks, staged, with __part, the number of the sorted piece a row lies in.

    A key of very many rows is spread over many pieces, as the order takes part in the cut. So what a window by key would
    do in one task per key can be done per (key, __part), with what a piece must know of those before it carried over.
    order: total, or ties may be placed in any order.
    """
    cols = [F.col(k) for k in keys] + list(order)
    return stage(df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("__part", F.spark_partition_id()), name)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str, total: str | None = None) -> DataFrame:
    """df with the row's number within its keys (from 1) and, if asked for, the number of rows of its keys.

    Like row_number over a window by key, but for keys that may hold a third of all rows: each sorted piece is numbered by
    itself, and a table of one row per key and piece carries the counts over. Keys may be null.
    """
    d = ranged(df, keys, order, "numbered")
    own = Window.partitionBy(*keys, "__part").orderBy(*order)
    n = d.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    every = Window.partitionBy(*keys)
    before = every.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    n = n.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(every).alias("__all"))
    on = F.col("__part") == F.col("__p")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    j = d.join(n, on, "left").withColumn(out, F.row_number().over(own) + F.col("__before"))
    if total:
        j = j.withColumn(total, F.col("__all"))
    return j.drop("__part", "__p", "__before", "__all", *[f"__{k}" for k in keys])
