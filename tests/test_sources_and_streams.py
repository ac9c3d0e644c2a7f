import json

from pyspark.sql import functions as F

from placeloom.sources import readers, sinks
from placeloom.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_bad_lines_become_rows(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text(json.dumps({"title": "Quán", "cid": "7", "latitude": 10.5, "longtitude": 106.5, "permanently_closed": True}) + "\n\n{broken\n")
    rows = readers.read_scraper_ndjson(spark, str(tmp_path / "a.ndjson")).collect()
    assert len(rows) == 2
    good = next(r for r in rows if r.parse_error is None)
    assert (good.external_id, good.external_id_type, good.lon, good.raw_status) == ("7", "cid", 106.5, "closed_permanently")


def test_osm_ways_stand_at_their_mean(spark):
    nodes = spark.createDataFrame([(1, 10.0, 106.0, {"name": "A", "shop": "tea"}), (2, 12.0, 108.0, {})], "id long, lat double, lon double, tags map<string,string>")
    ways = spark.createDataFrame([(9, [1, 2], {"name": "B", "amenity": "cafe", "disused:shop": "x"})], "id long, refs array<long>, tags map<string,string>")
    got = {r.external_id: (r.raw_category, r.raw_status, r.lat) for r in readers.places_from_osm(nodes, ways).collect()}
    assert got == {"node:1": ("shop:tea", None, 10.0), "way:9": ("amenity:cafe", "CLOSED_PERMANENTLY", 11.0)}


def test_dead_letters_are_json(spark):
    rows = spark.createDataFrame([("{}",), ("{no",), ("x" * 40000,)], "payload string")
    got = [json.loads(r.payload) for r in sinks.dead_letters(rows, "payload").collect()]
    assert got[0] == {} and got[1] == {"raw": "{no"} and got[2]["truncated"] and got[2]["size_bytes"] == 40000


def test_snapshot_points_at_newest(spark, tmp_path):
    sinks.write_snapshot(spark.range(3).toDF("x"), str(tmp_path / "s"))
    sinks.write_snapshot(spark.range(5).toDF("x"), str(tmp_path / "s"))
    assert sinks.read_snapshot(spark, str(tmp_path / "s")).count() == 5


def stream(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(str(tmp_path / "in"))
    return e, spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))


def test_weekly_demand_equals_batch(spark, tmp_path):
    e, s = stream(spark, tmp_path)
    q = jobs.demand_by_week(s).writeStream.outputMode("complete").format("memory").queryName("weekly").start()
    q.processAllAvailable()
    q.stop()
    batch = e.groupBy(F.window("ts", "7 days")["start"].alias("week"), "event_type").agg(F.count(F.lit(1)).alias("demand"))
    assert sorted(map(tuple, spark.table("weekly").collect())) == sorted(map(tuple, batch.collect()))


def test_incremental_commits_after_each_batch(spark, tmp_path):
    e, s = stream(spark, tmp_path)
    seen = []
    for _ in range(2):
        jobs.incremental(s, lambda df, i: seen.append(df.count()), str(tmp_path / "ck")).awaitTermination()
    assert sum(seen) == e.count()
