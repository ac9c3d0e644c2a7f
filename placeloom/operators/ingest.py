"""Ingestion of a batch of observations, and relinking of places that an older matcher made."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.graph import written
from ..sources import sinks
from . import places


def ingest(spark: SparkSession, observations: DataFrame, state: DataFrame, folder: str, run_id: str) -> tuple[DataFrame, DataFrame]:
    """(new state, counters): rejected rows go to dead letters with reasons, the others to the run's history and, if new or changed, into the state.

    observations: provider, external_id, raw_name, raw_phone, raw_website, lat, lon, observed_at, seq, raw_payload;
    state: provider, external_id, hash, seq. The classified batch is written once and read three times. A run repeated
    under its id replaces its own history and dead letters.
    """
    c = F.col
    reasons = places.reject_reasons(c("raw_name"), c("external_id"), c("observed_at"), c("lat"), c("lon"), c("raw_phone"), c("raw_website"))
    checked = observations.withColumn("reasons", reasons).withColumn("hash", places.identity_hash(c("raw_name"), c("raw_phone"), c("raw_website"), c("lat"), c("lon")))
    good = places.classify_changes(checked.filter(F.size("reasons") == 0), state, ["provider", "external_id"], "hash", "seq")
    batch = written(good.unionByName(checked.filter(F.size("reasons") > 0).withColumn("change", F.lit("rejected"))), "classified")
    sinks.append_history(batch.filter("change <> 'rejected'").drop("reasons"), f"{folder}/history", run_id)
    sinks.append_history(sinks.dead_letters(batch.filter("change = 'rejected'"), "raw_payload"), f"{folder}/dead_letters", run_id)
    changed = batch.filter("change IN ('new', 'changed')").select("provider", "external_id", "hash", "seq")
    counters = batch.groupBy("change").agg(F.count(F.lit(1)).alias("n"))
    return places.upsert(state, changed, ["provider", "external_id"], "seq"), counters


def relink_stale(records: DataFrame, links: DataFrame, version: str) -> DataFrame:
    """record_id, place_id, relinked: records of places with a link of another matcher version are resolved again, other links stay.

    links: record_id, place_id, version; records as places.resolve takes them.
    """
    stale = links.filter(F.col("version") != version).select("place_id").distinct()
    kept = links.join(stale, "place_id", "left_anti").select("record_id", "place_id", F.lit(False).alias("relinked"))
    again = links.join(stale, "place_id", "left_semi").select("record_id")
    fresh = places.resolve(records.join(again, "record_id", "left_semi"))
    return kept.unionByName(fresh.select("record_id", "place_id", F.lit(True).alias("relinked")))
