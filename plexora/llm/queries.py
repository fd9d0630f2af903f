"""Queries of the problems tagged llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexora.llm import addresses, encodings, leakage, linkage, mixing, neighbours
from plexora.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return addresses.same_locations(table(spark, d, "place_events"), table(spark, d, "places_raw"), table(spark, d, "localities"))


def p3_confidence(spark: SparkSession, d: str) -> DataFrame:
    return linkage.hosts_of_events(table(spark, d, "place_events"), table(spark, d, "places_raw"), table(spark, d, "localities"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_confidence(spark, d).select("eventid", "place_id")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """The last full snapshot of the bundle together with the CDN, one usable vector per key."""
    bundle = table(spark, d, "bundle_points").where(F.col("snapshot_no") == 5)
    return neighbours.latest(bundle, "track_id", "embedding", "meta.version", 64).unionByName(
        neighbours.latest(table(spark, d, "cdn_points"), "id", "vector", "shard", 64)
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(_vectors(spark, d)).select("id_a", "id_b")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    done = leakage.remove_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return done.where(F.col("removed_words") > 0)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(p9_mix(spark, d), table(spark, d, "mix_targets"))


def p9_shards(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shard_report(p9_mix(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return encodings.find_garbled(table(spark, d, "documents")).select("doc_id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return encodings.restore_garbled(table(spark, d, "documents"))


QUERIES = {"p3_found": p3_found, "p3_confidence": p3_confidence, "p2_found": p2_found, "p10_found": p10_found, "p10_restored": p10_restored, "p4_found": p4_found, "p8_found": p8_found, "p8_clean": p8_clean, "p9_mix": p9_mix, "p9_report": p9_report, "p9_shards": p9_shards}
