"""References to records that do not exist: missing, deleted or late parents, per record and counted per month."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexora.scale import salted_join, stage

#: Words that stand for "nothing" in a key column.
FILLERS = ("", "-", "--", "n/a", "na", "nan", "nil", "none", "null", "unknown", "undefined", "tbd", "tba", "?", ".")


def plain_key(c: Column) -> Column:
    """The key without surrounding blanks and without a name-space or path prefix; null for fillers."""
    k = F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"^.*[:/]\s*", "")
    t = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(t.isin(*FILLERS) | F.lower(k).isin(*FILLERS), F.lit(None)).otherwise(k)


@dataclass(frozen=True)
class Referrer:
    """A table whose `fields` refer to keys elsewhere."""

    name: str
    rows: DataFrame
    key: str
    fields: Sequence[str]
    arrived: str


@dataclass(frozen=True)
class Parent:
    """A table of keys; arrived None: its rows were always there."""

    rows: DataFrame
    key: str
    arrived: str | None


def parent_intervals(parents: Sequence[Parent], tombstones: DataFrame, record: str = "record_id", deleted: str = "deleted_at") -> DataFrame:
    """ref, first_at, gone_at: from when a key holds, and since when no more (null: still there).

    A key is gone if its last deletion is later than its last arrival. Rows without a key are left out.
    """
    epoch = F.lit("0001-01-01 00:00:00").cast("timestamp")
    arrivals = None
    for p in parents:
        t = p.rows.select(F.trim(F.col(p.key)).alias("ref"), (F.col(p.arrived) if p.arrived else epoch).alias("at"))
        arrivals = t if arrivals is None else arrivals.unionByName(t)
    every = arrivals.select("ref", F.col("at"), F.lit(None).cast("timestamp").alias("del"), F.lit(1).alias("here")).unionByName(
        tombstones.select(F.trim(F.col(record)).alias("ref"), F.lit(None).cast("timestamp").alias("at"), F.col(deleted).alias("del"), F.lit(0).alias("here"))
    )
    g = (
        every.where(F.col("ref").isNotNull())
        .groupBy("ref")
        .agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.max("del").alias("del"), F.max("here").alias("here"))
        .where(F.col("here") == 1)
    )
    return g.select("ref", "first_at", F.when(F.col("del") > F.col("last_at"), F.col("del")).alias("gone_at"))


def references(referrers: Sequence[Referrer]) -> DataFrame:
    """tablename, recordid, fieldname, ref, record_at: each reference once, with the first arrival of its record."""
    out = None
    for r in referrers:
        f = F.explode(F.array(*[F.struct(F.lit(x).alias("fieldname"), plain_key(F.col(x)).alias("ref")) for x in r.fields]))
        t = (
            r.rows.where(F.col(r.key).isNotNull())
            .select(F.lit(r.name).alias("tablename"), F.col(r.key).cast("string").alias("recordid"), F.col(r.arrived).alias("at"), f.alias("f"))
            .select("tablename", "recordid", "at", "f.*")
        )
        out = t if out is None else out.unionByName(t)
    # the record's first arrival is over all its rows, whatever they refer to
    per = out.groupBy("tablename", "recordid", "fieldname").agg(F.min("at").alias("record_at"), F.collect_set("ref").alias("refs"))
    return per.select("tablename", "recordid", "fieldname", "record_at", F.explode("refs").alias("ref"))


def broken_references(referrers: Sequence[Referrer], parents: Sequence[Parent], tombstones: DataFrame) -> DataFrame:
    """tablename, recordid, fieldname, kind, record_at of references that do not hold.

    kind is the first that applies of `missing` (no row has the key), `deleted` (its last deletion is later than its last
    arrival) and `late` (its first arrival is later than the record's). References and parents are co-partitioned and
    sorted by key and merged linearly (a sort-merge join); a parent is one row, its validity interval. Keys that many
    records refer to are split over tasks by salt. Null, blank and filler references refer to nothing. Repeated rows give
    one row. Records without a key are left out; an arrival that is null is neither early nor late.
    """
    refs = stage(references(referrers), "references")  # read to find heavy keys, and joined
    joined = salted_join(refs, parent_intervals(parents, tombstones).withColumn("held", F.lit(True)), "ref", "left", ("recordid", "fieldname"))
    kind = (
        F.when(F.col("held").isNull(), "missing")
        .when(F.col("gone_at").isNotNull(), "deleted")
        .when(F.col("first_at") > F.col("record_at"), "late")
    )
    bad = joined.select("tablename", "recordid", "fieldname", kind.alias("kind"), "record_at").where(F.col("kind").isNotNull())
    return bad.distinct()


def reference_report(bad: DataFrame) -> DataFrame:
    """Broken references counted per table, field, kind and month of the record's first arrival."""
    return bad.groupBy("tablename", "fieldname", "kind", F.date_format("record_at", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n")
    )
