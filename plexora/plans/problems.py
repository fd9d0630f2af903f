"""Queries of the general training-data problems p1, p5, p6 and p7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexora.operators import moments, references, snapshots, spatial
from plexora.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, d, "bundle_points"))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.change_counts(p1_found(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    ev = moments.event_moments(table(spark, d, "place_events"), table(spark, d, "localities"))
    return ev.unionByName(moments.review_moments(table(spark, d, "place_reviews"))).distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return spatial.near_and_inside(table(spark, d, "place_events"), table(spark, d, "mb_places"), table(spark, d, "localities"))


def _broken(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    return references.broken_references(
        [
            references.Referrer("localcore_links", t("localcore_links"), "linkid", ("from_id", "to_id"), "observed_at"),
            references.Referrer("place_reviews", t("place_reviews"), "reviewid", ("businessid",), "ingested_at"),
            references.Referrer("place_events", t("place_events"), "eventid", ("hostbusinessid",), "ingested_at"),
        ],
        [
            references.Parent(t("places_raw"), "place_id", "fetched_at"),
            references.Parent(t("place_events"), "eventid", "ingested_at"),
            references.Parent(t("place_reviews"), "reviewid", "ingested_at"),
            references.Parent(t("localities"), "localityid", None),
        ],
        t("tombstones"),
    )


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _broken(spark, d).select("tablename", "recordid", "fieldname", "kind").distinct()


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return references.reference_report(_broken(spark, d))


QUERIES = {
    "p1_found": p1_found,
    "p1_counts": p1_counts,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p7_report": p7_report,
}
