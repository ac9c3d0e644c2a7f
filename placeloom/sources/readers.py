"""Readers of place observations and tables. Bad lines become rows, not failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = "title string, place_id string, cid string, data_id string, link string, address string, complete_address struct<street:string,borough:string,city:string,state:string,country:string>, category string, phone string, web_site string, website string, latitude double, longitude double, longtitude double, business_status string, status string, permanently_closed boolean, temporarily_closed boolean, review_rating string, review_count string, __parse_error__ string"
CURATED = "name string, external_id string, external_id_type string, source_url string, address string, phone string, website string, category string, hours string, status string, lat double, lon double, observed_at timestamp, review_status string, reviewed_at timestamp, verification_method string, __parse_error__ string"
# Fixed value: tags that make a named element a place, in the order in which they name its category.
TAGS = ["amenity", "shop", "tourism", "office", "leisure", "craft", "healthcare"]


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    rows = spark.read.text(path).filter(F.trim("value") != "")
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__parse_error__"})
    return rows.select("value", parsed.alias("r"), F.col("_metadata.file_path").alias("file"))


def read_scraper_ndjson(spark: SparkSession, path: str, provider: str = "scraper") -> DataFrame:
    """Observations of a scraper's lines: the id is the first of place_id, cid, data_id, link; the address is put together from its parts if it has none."""
    r = F.col("r")
    closed = F.when(r["permanently_closed"], "closed_permanently").when(r["temporarily_closed"], "closed_temporarily")
    parts = F.concat_ws(", ", *[r["complete_address"][k] for k in ("street", "borough", "city", "state", "country")])
    kinds = ("place_id", "cid", "data_id", "link")
    return _lines(spark, path, LINE).select(
        F.lit(provider).alias("provider"), F.coalesce(*[F.nullif(r[k], F.lit("")) for k in kinds]).alias("external_id"),
        F.coalesce(*[F.when(r[k] != "", k) for k in kinds]).alias("external_id_type"), r["title"].alias("raw_name"),
        F.coalesce(F.nullif(r["address"], F.lit("")), F.nullif(parts, F.lit(""))).alias("raw_address"), r["phone"].alias("raw_phone"),
        F.coalesce(r["web_site"], r["website"]).alias("raw_website"), r["category"].alias("raw_category"),
        F.coalesce(closed, r["business_status"], r["status"]).alias("raw_status"), r["latitude"].alias("lat"),
        F.coalesce(r["longitude"], r["longtitude"]).alias("lon"), r["review_rating"].alias("rating"), r["review_count"].alias("review_count"),
        F.col("value").alias("raw_payload"), r["__parse_error__"].alias("parse_error"),
    )


def read_curated_ndjson(spark: SparkSession, path: str, provider: str, fetched_at: str) -> DataFrame:
    """Curated rows; observed_at falls back to the time of fetching."""
    r = F.col("r")
    names = {"name": "raw_name", "address": "raw_address", "phone": "raw_phone", "website": "raw_website", "category": "raw_category", "hours": "raw_hours", "status": "raw_status"}
    same = ["external_id", "external_id_type", "source_url", "lat", "lon", "review_status", "reviewed_at", "verification_method"]
    return _lines(spark, path, CURATED).select(F.lit(provider).alias("provider"), *[r[k].alias(v) for k, v in names.items()], *[r[k].alias(k) for k in same], F.coalesce(r["observed_at"], F.lit(fetched_at).cast("timestamp")).alias("observed_at"), F.col("value").alias("raw_payload"), r["__parse_error__"].alias("parse_error"))


def places_from_documents(docs: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Observations of documents whose metadata (JSON) has a telephone, address, position or opening hours, and a name or title.

    A position may stand in geo; an address may be a text or an object of streetAddress, addressLocality and
    addressRegion, which are joined. Metadata that is no JSON gives no observation.
    """
    get = lambda p: F.nullif(F.get_json_object(metadata, f"$.{p}"), F.lit(""))
    address = get("address")
    whole = F.when(address.startswith("{"), F.nullif(F.concat_ws(", ", *[get(f"address.{k}") for k in ("streetAddress", "addressLocality", "addressRegion")]), F.lit(""))).otherwise(address)
    number = lambda k: F.coalesce(get(k), get(f"geo.{k}")).try_cast("double")
    d = docs.select(
        F.lit("web_corpus").alias("provider"), F.col("url").alias("external_id"), F.coalesce(get("name"), F.nullif("title", F.lit(""))).alias("raw_name"), whole.alias("raw_address"), get("telephone").alias("raw_phone"),
        F.col("url").alias("source_url"), F.col("url").alias("raw_website"), F.coalesce(F.nullif(F.get_json_object(metadata, "$['@type']"), F.lit("")), get("category")).alias("raw_category"),
        number("latitude").alias("lat"), number("longitude").alias("lon"), get("openingHours").alias("raw_hours"), F.coalesce(get("telephone"), address, get("geo"), get("latitude"), get("openingHours")).alias("__sign"),
    )
    return d.filter("__sign IS NOT NULL AND raw_name IS NOT NULL").drop("__sign")


def places_from_osm(nodes: DataFrame, ways: DataFrame, relations: DataFrame | None = None, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Named, tagged elements: nodes(id, lat, lon, tags), ways(id, refs, tags), relations(id, members: array of struct kind, ref; tags).

    A way stands at the mean of its nodes, a relation at the mean of its member nodes and of its member ways' nodes.
    Status: lifecycle prefixes and hours that say closed are permanent. box: south, north, west, east, of the position.
    """
    get = lambda k: F.nullif(F.try_element_at(F.col("tags"), F.lit(k)), F.lit(""))
    kind = F.coalesce(*[F.concat(F.lit(f"{t}:"), get(t)) for t in TAGS])
    shut = F.exists(F.map_keys("tags"), lambda k: k.startswith("disused:") | k.startswith("abandoned:")) | F.coalesce(get("opening_hours") == "closed", F.lit(False))
    status = F.when(shut, "CLOSED_PERMANENTLY").when(get("temporary_closed").isin("yes", "true", "1"), "CLOSED_TEMPORARILY")
    street = F.trim(F.concat_ws(" ", get("addr:housenumber"), get("addr:street")))
    address = F.coalesce(get("addr:full"), F.nullif(F.concat_ws(", ", F.nullif(street, F.lit("")), F.coalesce(get("addr:district"), get("addr:city"), get("addr:province"))), F.lit("")))

    def keep(df, name):
        fields = {"raw_address": address, "raw_phone": F.coalesce(get("phone"), get("contact:phone")), "raw_website": F.coalesce(get("website"), get("contact:website"), get("url")), "raw_category": kind, "raw_status": status}
        named = df.filter(get("name").isNotNull() & kind.isNotNull())
        return named.select(F.concat(F.lit(f"{name}:"), F.col("id").cast("string")).alias("external_id"), get("name").alias("raw_name"), *[c.alias(k) for k, c in fields.items()], "lat", "lon")

    mean = lambda df: df.groupBy("id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    spots = nodes.select(F.col("id").alias("ref"), "lat", "lon")
    way_nodes = ways.select("id", F.explode("refs").alias("ref"))
    out = keep(nodes, "node").unionByName(keep(ways.join(mean(way_nodes.join(spots, "ref")), "id", "left"), "way"))
    if relations is not None:
        m = relations.select("id", F.explode("members").alias("m")).select("id", "m.kind", "m.ref")
        inside = m.filter("kind = 'way'").join(way_nodes.toDF("ref", "node"), "ref").select("id", F.col("node").alias("ref"))
        at = mean(m.filter("kind = 'node'").select("id", "ref").union(inside).join(spots, "ref"))
        out = out.unionByName(keep(relations.join(at, "id", "left"), "relation"))
    return out.filter(F.col("lat").between(*box[:2]) & F.col("lon").between(*box[2:])) if box else out


#: Kinds of paths that Arrow opens in a task, and bytes read at once.
STREAMED, BLOCK = ("file", "s3", "s3a", "gs", "hdfs"), 8 << 20


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """file, sha256, bytes of each file of a dataset.

    Files are listed by Spark, without their content (it lists no empty files). A file is one task's work: it is read as a stream, BLOCK bytes at a
    time, so files of any size need no more memory than that. Files of stores that Arrow does not open are read
    by Spark as one value each (2 GB at most).
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"))
    kind = F.regexp_extract("file", "^([A-Za-z0-9]+):", 1)

    def digests(it):
        import hashlib
        from urllib.parse import unquote

        import pyarrow as pa
        from pyarrow import fs

        for batch in it:
            for file, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                scheme, rest = file.split(":", 1)
                if scheme == "file":
                    store, at = fs.LocalFileSystem(), unquote(rest if not rest.startswith("//") else rest[2:])
                else:
                    store, at = fs.FileSystem.from_uri(file.replace("s3a:", "s3:", 1))
                digest = hashlib.sha256()
                with store.open_input_stream(at) as stream:
                    while block := stream.read(BLOCK):
                        digest.update(block)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([digest.hexdigest()]), pa.array([size])], names=["file", "sha256", "bytes"])

    streamed = files.filter(kind.isin(*STREAMED)).repartition("file").mapInArrow(digests, "file string, sha256 string, bytes long")
    whole = spark.read.format("binaryFile").load(path).filter(~F.regexp_extract("path", "^([A-Za-z0-9]+):", 1).isin(*STREAMED))
    return streamed.union(whole.select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes")))


def delta(table: DataFrame, at: str, key: str, after_at, after_key) -> DataFrame:
    """Rows after a cursor (at, key)."""
    return table.filter((F.col(at) > F.lit(after_at)) | ((F.col(at) == F.lit(after_at)) & (F.col(key) > F.lit(after_key))))


def page(table: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next `size` rows in order of key after a cursor (null: from the first)."""
    rows = table if after is None else table.filter(F.col(key) > F.lit(after))
    return rows.orderBy(key).limit(size)
