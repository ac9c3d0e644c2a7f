"""Queries of readers, sinks, ingestion and streams; files are written from the given tables into the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest, places
from ..plans.graph import shared_path, written
from ..sources import readers, sinks
from ..streaming import circuits, jobs
from .fixtures import RECORDS, derive, sql, table
from .place_queries import _PLACES, D_NORMAL, normal
from .registry import query


#: Normal records of the places whose links are stale.
D_STALE = D_NORMAL.replace("FROM r2)", "FROM r2 WHERE p % 15 = 0)")


def lines(spark, d):
    """Scraper lines of the records; some are broken, some blank."""
    r, i = derive(spark, d, RECORDS), F.col("record_id")
    kind = lambda k, n: F.when(i % 3 == n, F.concat(F.lit("x"), i.cast("string"))).alias(k)
    address = F.when(i % 4 == 0, "").otherwise(F.concat(F.lit("số "), i.cast("string")))
    parts = F.when(i % 4 == 0, F.struct(F.lit("Phố Huế").alias("street"), F.lit("Hà Nội").alias("city")))
    row = F.struct(F.col("raw_name").alias("title"), kind("cid", 0), kind("place_id", 1), kind("link", 2), address.alias("address"), parts.alias("complete_address"), (i % 5 == 0).alias("permanently_closed"), F.lit("OPEN").alias("status"), F.lit(10.5).alias("latitude"), F.lit(106.25).alias("longtitude"))
    return r.select(F.when(i % 31 == 0, "{broken").when(i % 37 == 0, "  ").otherwise(F.to_json(row)).alias("line"))


_FACTS = f"""r AS ({sql(RECORDS)}), f AS (SELECT record_id, 'x' || CAST(record_id AS VARCHAR) AS external_id, CASE record_id % 3 WHEN 0 THEN 'cid' WHEN 1 THEN 'place_id' ELSE 'link' END AS external_id_type, raw_name,
 CASE WHEN record_id % 4 = 0 THEN 'Phố Huế, Hà Nội' ELSE 'số ' || CAST(record_id AS VARCHAR) END AS raw_address, CASE WHEN record_id % 5 = 0 THEN 'closed_permanently' ELSE 'OPEN' END AS raw_status FROM r WHERE record_id % 31 <> 0 AND record_id % 37 <> 0)"""


@query("s1_scraper_lines", f"WITH {_FACTS} SELECT external_id, external_id_type, raw_name, raw_address, raw_status, 10.5e0 AS lat, 106.25e0 AS lon, false AS bad FROM f UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, true FROM r WHERE record_id % 31 = 0")
def s1(spark, d):
    path = shared_path(spark, "lines")
    lines(spark, d).select("line").write.text(path)
    return readers.read_scraper_ndjson(spark, path).select("external_id", "external_id_type", "raw_name", "raw_address", "raw_status", "lat", "lon", F.col("parse_error").isNotNull().alias("bad"))


@query("s2_curated_lines", f"SELECT 'c' || CAST(record_id AS VARCHAR) AS external_id, raw_name, nullif(raw_phone, '12') AS raw_phone, lat, lon, CASE WHEN record_id % 2 = 0 THEN TIMESTAMP '2024-01-05 00:00:00' ELSE TIMESTAMP '2024-02-01 00:00:00' END AS observed_at FROM ({sql(RECORDS)})")
def s2(spark, d):
    path = shared_path(spark, "curated")
    r = derive(spark, d, RECORDS)
    row = F.struct(F.col("raw_name").alias("name"), F.concat(F.lit("c"), F.col("record_id").cast("string")).alias("external_id"), F.nullif("raw_phone", F.lit("12")).alias("phone"), "lat", "lon", F.when(F.col("record_id") % 2 == 0, "2024-01-05T00:00:00").alias("observed_at"))
    r.select(F.to_json(row)).write.text(path)
    return readers.read_curated_ndjson(spark, path, "curated", "2024-02-01 00:00:00").select("external_id", "raw_name", "raw_phone", "lat", "lon", F.col("observed_at").cast("timestamp_ntz").alias("observed_at"))


@query("s3_places_from_documents", f"""SELECT 'u' || CAST(record_id AS VARCHAR) AS external_id, raw_name, CASE WHEN record_id % 6 = 0 THEN raw_phone END AS raw_phone, CASE record_id % 6 WHEN 1 THEN '1 Le Loi, Hue' WHEN 2 THEN 'so 1' END AS raw_address,
 CASE WHEN record_id % 6 = 3 THEN 10.5e0 WHEN record_id % 6 = 4 THEN 11.5e0 END AS lat, CASE WHEN record_id % 6 = 3 THEN 105.5e0 WHEN record_id % 6 = 4 THEN 106.5e0 END AS lon FROM ({sql(RECORDS)}) WHERE record_id % 6 <> 5""")
def s3(spark, d):
    r, k = derive(spark, d, RECORDS), F.col("record_id") % 6
    meta = F.when(k == 0, F.to_json(F.struct(F.col("raw_phone").alias("telephone")))).when(k == 1, '{"address":{"streetAddress":"1 Le Loi","addressLocality":"Hue","addressRegion":""}}').when(k == 2, '{"address":"so 1"}')
    meta = meta.when(k == 3, '{"geo":{"latitude":10.5,"longitude":"105.5"}}').when(k == 4, '{"latitude":11.5,"longitude":106.5}').otherwise('{"name":"only"}')
    docs = r.select(F.concat(F.lit("u"), F.col("record_id").cast("string")).alias("url"), F.col("raw_name").alias("title"), meta.alias("metadata"))
    return readers.places_from_documents(docs).select("external_id", "raw_name", "raw_phone", "raw_address", "lat", "lon")


@query("s4_osm_elements", """WITH n AS (SELECT s_suppkey AS id, 10 + s_suppkey % 64 / 8e0 AS lat, 105 + s_suppkey % 32 / 8e0 AS lon, s_name, s_nationkey FROM supplier), w AS (SELECT n_nationkey, n_regionkey, n.* FROM n JOIN nation ON n_nationkey = s_nationkey),
m AS (SELECT n_regionkey AS id, lat, lon FROM w UNION ALL SELECT r_regionkey, lat, lon FROM region JOIN n ON n.id = r_regionkey + 1)
SELECT 'node:' || id AS external_id, s_name AS raw_name, 'shop:tea' AS raw_category, CASE WHEN id % 2 = 0 THEN 'CLOSED_PERMANENTLY' END AS raw_status, round(lat, 6) AS lat, round(lon, 6) AS lon FROM n WHERE id % 3 = 0
UNION ALL SELECT 'way:' || n_nationkey, n_name, 'amenity:cafe', NULL, round(avg(lat), 6), round(avg(lon), 6) FROM w JOIN nation USING (n_nationkey) GROUP BY n_nationkey, n_name
UNION ALL SELECT 'relation:' || id, r_name, 'tourism:zoo', 'CLOSED_TEMPORARILY', round(avg(lat), 6), round(avg(lon), 6) FROM m JOIN region ON r_regionkey = id GROUP BY id, r_name""")
def s4(spark, d):
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    named = F.create_map(F.lit("name"), F.col("s_name"), F.lit("shop"), F.lit("tea"), F.lit("opening_hours"), F.when(k % 2 == 0, "closed").otherwise("24/7"))
    tags = F.when(k % 3 == 0, named).otherwise(F.create_map(F.lit("highway"), F.lit("x")))
    nodes = s.select(k.alias("id"), (10 + k % 64 / 8).alias("lat"), (105 + k % 32 / 8).alias("lon"), tags.alias("tags"))
    refs = s.groupBy("s_nationkey").agg(F.collect_list("s_suppkey").alias("refs"))
    ways = table(spark, d, "nation").join(refs, F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("n_nationkey").alias("id"), "refs", "n_regionkey", F.create_map(F.lit("name"), F.col("n_name"), F.lit("amenity"), F.lit("cafe")).alias("tags"))
    members = ways.groupBy("n_regionkey").agg(F.collect_list(F.struct(F.lit("way").alias("kind"), F.col("id").alias("ref"))).alias("w"))
    one = F.array(F.struct(F.lit("node").alias("kind"), (F.col("r_regionkey") + 1).alias("ref")))
    relations = table(spark, d, "region").join(members, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(F.col("r_regionkey").alias("id"), F.concat(F.coalesce("w", F.slice(one, 1, 0)), one).alias("members"), F.create_map(F.lit("name"), F.col("r_name"), F.lit("tourism"), F.lit("zoo"), F.lit("temporary_closed"), F.lit("yes")).alias("tags"))
    return readers.places_from_osm(nodes, ways.drop("n_regionkey"), relations).select("external_id", "raw_name", "raw_category", "raw_status", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("s7_keyset_page", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 100")
def s7(spark, d):
    return readers.page(table(spark, d, "orders"), "o_orderkey", 500, 100).select("o_orderkey", "o_custkey")


@query("s6_fingerprint")
def s6(spark, d):
    """sha256 and bytes of the files of a dataset."""
    return readers.fingerprint(spark, f"{d}/pages.parquet").select("sha256", "bytes")


@query("k2_history", "SELECT event_type, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'second run', count(*) FROM orders")
def k2(spark, d):
    """Two runs; the first is written twice."""
    path = shared_path(spark, "history")
    e = table(spark, d, "events").select("event_type")
    for rows, run in ((e, "1"), (table(spark, d, "orders").select(F.lit("second run").alias("event_type")), "2"), (e, "1")):
        sinks.append_history(rows, path, run)
    return spark.read.schema("event_type string, run string").parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("k3_dead_letters", "SELECT doc_id, octet_length(encode(text)) > 32768 AS truncated, CASE WHEN octet_length(encode(text)) > 32768 THEN octet_length(encode(text)) END AS size_bytes, CASE WHEN octet_length(encode(text)) > 32768 THEN NULL ELSE sha256(text) END AS raw_sha FROM documents WHERE text IS NOT NULL AND text <> ''")
def k3(spark, d):
    rows = table(spark, d, "documents").filter("text <> ''").select("doc_id", "text", F.col("text").alias("payload"))
    wrapped = F.when(F.col("payload") != F.col("text"), F.from_json("payload", "truncated boolean, size_bytes long, raw string"))  # JSON stays as it is
    got = sinks.dead_letters(rows, "payload").select("doc_id", "text", wrapped.alias("p"))
    raw = F.when(F.col("p").isNull(), F.col("text")).otherwise(F.col("p.raw"))
    return got.select("doc_id", F.coalesce("p.truncated", F.lit(False)).alias("truncated"), "p.size_bytes", F.sha2(raw, 256).alias("raw_sha"))


@query("k4_overflow", "SELECT doc_id, CASE WHEN octet_length(encode(text)) > 4096 THEN sha256(text) END AS payload_ref, text IS NOT NULL AS found FROM documents")
def k4(spark, d):
    """Payloads above 4 KB in a side table; found: the payload is inline or there."""
    inline, side = sinks.overflow(table(spark, d, "documents").select("doc_id", "text"), "text", 4096)
    side = written(side, "overflow").select(F.col("payload_ref").alias("ref"), F.col("text").alias("big"))
    return inline.join(side, F.col("payload_ref") == F.col("ref"), "left").select("doc_id", "payload_ref", F.coalesce("text", "big").isNotNull().alias("found"))


@query("k6_serving_rebuild", "SELECT p_brand AS brand, count(*) AS n FROM part GROUP BY 1")
def k6(spark, d):
    """Two generations; readers see the newer one."""
    path = shared_path(spark, "serving")
    p = table(spark, d, "part")
    sinks.write_snapshot(p.limit(0).select(F.col("p_brand").alias("brand")), path)
    sinks.write_snapshot(p.select(F.col("p_brand").alias("brand")), path)
    return sinks.read_snapshot(spark, path).groupBy("brand").agg(F.count(F.lit(1)).alias("n"))


#: Half of the records are known, a third of these unchanged.
@query("c1_ingest", f"""WITH r AS ({sql(RECORDS)}), v AS (SELECT *, lon IS NULL OR (lat > 90) OR raw_phone = '12' OR (lat <= 90 AND lon IS NOT NULL AND NOT (lat BETWEEN 7 AND 24 AND lon BETWEEN 102 AND 118)) AS bad FROM r)
SELECT CASE WHEN bad THEN 'rejected' WHEN record_id % 2 = 1 THEN 'new' WHEN record_id % 3 = 0 THEN 'unchanged' ELSE 'changed' END AS change, count(*) AS n FROM v GROUP BY 1""")
def c1(spark, d):
    r = derive(spark, d, RECORDS).withColumn("external_id", F.col("record_id").cast("string")).withColumn("observed_at", F.col("days")).withColumn("seq", F.col("record_id") + 1).withColumn("raw_payload", F.to_json(F.struct("raw_name")))
    h = places.identity_hash(F.col("raw_name"), F.col("raw_phone"), F.col("raw_website"), F.col("lat"), F.col("lon"))
    state = r.filter("record_id % 2 = 0").select("provider", "external_id", F.when(F.col("record_id") % 3 == 0, h).otherwise("old").alias("hash"), F.lit(0).cast("long").alias("seq"))
    return ingest.ingest(spark, r, state, shared_path(spark, "ingest"), "run-1")[1]


@query("c3_relink_stale", f"WITH RECURSIVE {D_STALE}, {_PLACES} SELECT record_id, place_id, true AS relinked FROM links UNION ALL SELECT c_custkey, c_custkey - c_custkey % 3, false FROM customer WHERE (c_custkey - c_custkey % 3) % 15 <> 0")
def c3(spark, d):
    """Places of every fifth record's group come from an old matcher."""
    n = normal(spark, d)
    links = n.select("record_id", F.col("p").alias("place_id"), F.when(F.col("record_id") % 15 == 0, "v1").otherwise("v2").alias("version"))
    return ingest.relink_stale(n, links, "v2")


def events_stream(spark, d):
    schema = table(spark, d, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{d}/events*.parquet")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def with_rocks(spark, make):
    """make() with the state store that list and value state need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, jobs.ROCKS)
    try:
        return make()
    finally:
        spark.conf.set(key, before)


@query("g1_incremental", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def g1(spark, d):
    """New files are appended to the history under their batch, and committed after it; a second run finds nothing new."""
    path, state = shared_path(spark, "incremental"), shared_path(spark, "incremental-state")
    for _ in range(2):
        jobs.incremental(events_stream(spark, d), lambda df, i: sinks.append_history(df.select("event_type"), path, str(i)), state).awaitTermination()
    return spark.read.schema("event_type string").parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("g2_weekly_demand", "SELECT time_bucket(INTERVAL 7 DAYS, ts, TIMESTAMP '1970-01-01') AS week, event_type, count(*) AS demand FROM events GROUP BY 1, 2")
def g2(spark, d):
    t = jobs.run_once(spark, jobs.demand_by_week(events_stream(spark, d)), "update", "weekly")
    return jobs.latest(t, "week", "event_type").withColumn("week", F.col("week").cast("timestamp_ntz"))


@query("g3_reformulated", """SELECT t.event_id AS trace_id, e.event_id FROM events t JOIN events e ON t.user_id = e.user_id AND t.event_type = 'view' AND e.event_type = 'error' AND e.ts >= t.ts AND e.ts <= t.ts + INTERVAL 3600 SECONDS""")
def g3(spark, d):
    """An error of the user within an hour after a view."""
    s = events_stream(spark, d)
    t = s.filter("event_type = 'view'").select(F.col("event_id").alias("trace_id"), F.col("user_id").alias("query"), F.col("ts").alias("trace_ts"))
    e = s.filter("event_type = 'error'").select("event_id", F.col("user_id").alias("from_query"), F.col("ts").alias("event_ts"))
    return jobs.run_once(spark, jobs.reformulated(t, e, 3600), "append", "reformulated").select("trace_id", "event_id")


@query("g4_health", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i, max(ts) OVER (PARTITION BY user_id) AS last FROM events), k AS (SELECT * FROM r WHERE i <= 64 AND epoch_us(ts) >= epoch_us(last) - 864000000000),
g AS (SELECT user_id AS key, count(*) AS n, avg((event_type <> 'error')::INT) AS success_rate, list_sort(list(value)) AS v FROM k GROUP BY 1) SELECT key, n, round(success_rate, 6) AS success_rate, v[CAST(ceil(n * 95 / 100e0) AS BIGINT)] AS p95, n >= 8 AND success_rate < 0.8 AS tripped FROM g""")
def g4(spark, d):
    """A user's last 64 events of ten days; errors are failures, the value is the latency."""
    calls = events_stream(spark, d).select("user_id", (F.unix_micros("ts") / 1_000_000).alias("t"), "event_id", (F.col("event_type") != "error").alias("ok"), F.col("value").alias("ms"))
    t = with_rocks(spark, lambda: jobs.run_once(spark, jobs.health_by_key(calls, "user_id", 64, 864_000, 0.8), "update", "health"))
    return jobs.latest(t, "key").withColumn("success_rate", F.round("success_rate", 6))


CALLS = """SELECT user_id, CAST(ts AS TIMESTAMP) AS at, UNIX_MICROS(CAST(ts AS TIMESTAMP)) / 1000000.0D AS t, event_id, CASE event_type WHEN 'error' THEN CASE event_id % 4 WHEN 0 THEN 'timeout' WHEN 1 THEN 'captcha' WHEN 2 THEN 'rate_limited' ELSE 'error' END
  WHEN 'view' THEN 'captcha' ELSE CASE WHEN event_id % 3 = 0 THEN 'empty' ELSE 'success' END END AS outcome, CAST(event_id * 37 % 5003 AS DOUBLE) AS ms, event_id % 9 AS results FROM {events}"""
#: Users' events lie hours apart, so calls count for ten days and a circuit cools down for hours.
SLOW = circuits.Rules(seconds=864_000.0, cooldown=7200.0, max_cooldown=86_400.0)


@query("g4_circuits")
def g4_circuits(spark, d):
    """The circuit of each user after each of their calls, as a stream that ends with what is there."""
    made = spark.sql(CALLS, events=events_stream(spark, d))
    t = with_rocks(spark, lambda: jobs.run_once(spark, circuits.circuits(made, "user_id", SLOW), "update", "circuits"))
    return t.filter("event_id IS NOT NULL").drop("batch_id")


@query("g4_circuit_replay")
def g4_circuit_replay(spark, d):
    """The same from the table of events."""
    return circuits.replay(derive(spark, d, CALLS), "user_id", SLOW)


@query("g5_ema_state", """
WITH RECURSIVE s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
e AS (SELECT user_id, i, value AS ema FROM s WHERE i = 1 UNION ALL SELECT s.user_id, s.i, 0.7e0 * e.ema + 0.3e0 * s.value FROM e JOIN s ON s.user_id = e.user_id AND s.i = e.i + 1)
SELECT user_id AS key, round(arg_max(ema, i), 6) AS ema, count(*) AS n FROM e GROUP BY user_id""")
def g5(spark, d):
    t = with_rocks(spark, lambda: jobs.run_once(spark, jobs.ema_by_key(events_stream(spark, d), "user_id", 0.3), "update", "ema"))
    return jobs.latest(t, "key").withColumn("ema", F.round("ema", 6))


@query("g6_distinct_interactions", "SELECT DISTINCT user_id, event_type FROM events")
def g6(spark, d):
    return jobs.run_once(spark, jobs.distinct_interactions(events_stream(spark, d), ["user_id", "event_type"]), "append", "interactions").select("user_id", "event_type")


@query("g8_daily_usage", "SELECT date_trunc('day', ts) AS day, user_id, count(*) AS requests, count(CASE WHEN event_type = 'error' THEN 1 END) AS errors FROM events GROUP BY 1, 2")
def g8(spark, d):
    t = jobs.run_once(spark, jobs.usage_by_day(events_stream(spark, d)), "update", "usage")
    return jobs.latest(t, "day", "user_id").withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("k8_incremental_sync", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def k8(spark, d):
    """An index of users, brought up to date batch by batch; a batch writes the buckets again that it touches."""
    path = shared_path(spark, "sync")

    def handle(df, i):
        new = df.select("user_id", "event_id").groupBy("user_id").agg(F.max("event_id").alias("event_id"))
        sinks.sync_buckets(spark, path, new, "user_id", lambda state, batch: places.upsert(state, batch, ["user_id"], "event_id"), 16)

    jobs.incremental(events_stream(spark, d), handle, shared_path(spark, "sync-state")).awaitTermination()
    return sinks.read_buckets(spark, path, table(spark, d, "events").select("user_id", "event_id")).select("user_id", "event_id")
