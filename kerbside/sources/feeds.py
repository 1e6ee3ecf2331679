"""Readers over landed feed files.

Each ``parse_*`` takes a DataFrame with one JSON document (or text record) per row in ``value`` and is a
pure transformation; each ``read_*`` applies it to files. Fetching the files is not part of this package.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.functions.geo import in_bbox
from kerbside.functions.numbers import finite
from kerbside.functions.rules import accessible, permit_severity, sidewalk
from kerbside.functions.text import (blank_to_null, date_prefix, f_to_c, first_number, first_value, lookup,
                                     normalise_header, optional_double, parse_epoch, parse_instant, wind_bearing)
from kerbside.vocab import (AQI_PARAMETERS, FACILITY_PADDING_DEG, FACILITY_STATE, GRID_NAME_PATTERNS,
                            INDUSTRIAL_PROGRAMS, POLLEN_CODES, PROGRAM_COLUMNS, SENSOR_PARAMETERS,
                            TRAFFIC_CLASS_WEIGHTS)


def file_order() -> Column:
    """Sortable position of a row in its files: path, block, then row within the block."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("row"))


def text_rows(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Lines (or whole files) with their position; ``whole`` suits one JSON document per file."""
    rows = spark.read.text(path, wholetext=whole)
    return rows.select("value", file_order().alias("row_order"))


def _with_order(rows: DataFrame) -> DataFrame:
    return rows if "row_order" in rows.columns else rows.withColumn("row_order", F.monotonically_increasing_id())


def first_per(df: DataFrame, key: str, order: str = "row_order") -> DataFrame:
    rest = [c for c in df.columns if c != key]
    kept = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r"))
    return kept.select(key, *[F.col("r")[c].alias(c) for c in rest])


def last_per(df: DataFrame, key: str, order: str = "row_order") -> DataFrame:
    rest = [c for c in df.columns if c != key]
    kept = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r"))
    return kept.select(key, *[F.col("r")[c].alias(c) for c in rest])


# --- street network ------------------------------------------------------------------------------------
WAY_SCHEMA = ("id string, geometry struct<type:string,coordinates:array<array<double>>>, "
              "properties map<string,string>")


def _line_features(rows: DataFrame) -> DataFrame:
    """Line features of a GeoJSON text sequence with their way id, points and tags."""
    payload = F.trim(F.regexp_replace("value", "^\u001e+", ""))
    parsed = rows.where(payload != "").select(F.from_json(payload, WAY_SCHEMA).alias("f"))
    pts = F.transform(F.filter("f.geometry.coordinates", lambda c: F.size(c) >= 2),
                      lambda c: F.struct(c[0].alias("x"), c[1].alias("y")))
    return (parsed.where(F.col("f.id").startswith("w") & (F.col("f.geometry.type") == "LineString"))
            .select(F.substring("f.id", 2, 40).cast("long").alias("osm_way_id"), pts.alias("pts"),
                    F.coalesce("f.properties", F.create_map().cast("map<string,string>")).alias("tags")))


def parse_ways(rows: DataFrame) -> DataFrame:
    """Walkable or cyclable ways."""
    return (_line_features(rows).where(F.col("tags")["highway"].isNotNull() & accessible(F.col("tags")))
            .select("osm_way_id", "pts", F.col("tags")["highway"].alias("highway_class"),
                    sidewalk(F.col("tags")).alias("has_sidewalk")))


def parse_traffic_roads(rows: DataFrame) -> DataFrame:
    """Ways of the traffic classes with their weight; link roads count as their class."""
    kind = F.regexp_replace(F.lower(F.col("tags")["highway"]), "_link$", "")
    return (_line_features(rows).withColumn("highway_class", kind)
            .withColumn("proxy_weight", lookup(F.col("highway_class"), TRAFFIC_CLASS_WEIGHTS))
            .where(F.col("proxy_weight").isNotNull() & (F.size("pts") >= 2))
            .select("osm_way_id", "highway_class", "proxy_weight", "pts"))


def read_ways(spark: SparkSession, path: str) -> DataFrame:
    return parse_ways(text_rows(spark, path))


def read_traffic_roads(spark: SparkSession, path: str) -> DataFrame:
    return parse_traffic_roads(text_rows(spark, path))


BOUNDARY_SCHEMA = ("features array<struct<geometry:struct<type:string,coordinates:string>>>")


def borough_boundary(rows: DataFrame, expected: int = 5) -> DataFrame:
    """Rings of each boundary feature (MultiPolygons flattened); fails unless there are exactly five.

    A point lies in the dissolved boundary exactly if it lies in one of the features.
    """
    features = rows.select(F.posexplode(F.from_json("value", BOUNDARY_SCHEMA)["features"]).alias("area_id", "f"))
    single = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    multi = F.flatten(F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>"))
    rings = F.when(F.col("f.geometry.type") == "MultiPolygon", multi).when(F.col("f.geometry.type") == "Polygon", single)
    shaped = features.withColumn("rings", F.transform(rings, lambda r: F.transform(
        r, lambda c: F.struct(c[0].alias("x"), c[1].alias("y")))))
    n = features.agg(F.count(F.lit(1))).scalar()
    checked = (F.when(n != expected, F.raise_error(F.lit(f"expected exactly {expected} boundary features"))
                      .cast(shaped.schema["rings"].dataType))
               .when(F.col("rings").isNull(), F.raise_error(F.lit("a boundary feature is not a polygon"))
                     .cast(shaped.schema["rings"].dataType)).otherwise(F.col("rings")))
    return shaped.select("area_id", checked.alias("rings"))


# --- facilities ------------------------------------------------------------------------------------------
def _normalised(df: DataFrame) -> DataFrame:
    """Columns under their normalised header; of equal headers the last one counts."""
    names: dict[str, str] = {}
    for column in df.columns:
        if column != "row_order":
            names[normalise_header(column)] = column
    return df.select("row_order", *[F.col(f"`{c}`").alias(n) for n, c in names.items() if n])


def _any_of(df: DataFrame, *names: str) -> Column:
    present = [F.col(n) for n in names if n in df.columns]
    return first_value(*present) if present else F.lit(None).cast("string")


def _facility_rows(df: DataFrame, source: str, keys: dict[str, tuple[str, ...]], programs: Column) -> DataFrame:
    lon, lat = optional_double(_any_of(df, *keys["longitude"])), optional_double(_any_of(df, *keys["latitude"]))
    return (df.select(
        F.lit(source).alias("source"), _any_of(df, *keys["source_id"]).alias("source_id"),
        _any_of(df, *keys["name"]).alias("name"), programs.alias("programs"),
        _any_of(df, *keys["state"]).alias("state"), lon.alias("longitude"), lat.alias("latitude"), "row_order")
        .where((F.col("state") == FACILITY_STATE) & F.col("source_id").isNotNull() & F.col("name").isNotNull()
               & finite(F.col("longitude")) & finite(F.col("latitude"))
               & in_bbox(F.col("longitude"), F.col("latitude"), FACILITY_PADDING_DEG)))


def parse_tri(raw: DataFrame) -> DataFrame:
    """Toxic release facilities; the first usable row per id counts."""
    df = _normalised(_with_order(raw))
    rows = _facility_rows(df, "TRI", {
        "source_id": ("frsid", "trifd", "trifacilityid"), "name": ("facilityname",), "state": ("st", "state"),
        "longitude": ("longitude",), "latitude": ("latitude",)}, F.array(F.lit("TRI")))
    return first_per(rows, "source_id").select(*rows.columns)


def parse_echo(raw: DataFrame) -> DataFrame:
    """Regulated facilities taking part in at least one programme that counts as industrial."""
    df = _normalised(_with_order(raw))
    marks = [F.when(blank_to_null(F.col(c)).isNotNull(), F.lit(p)) for c, p in PROGRAM_COLUMNS.items() if c in df.columns]
    programs = F.filter(F.array(*marks) if marks else F.array().cast("array<string>"), lambda p: p.isNotNull())
    rows = _facility_rows(df, "ECHO", {
        "source_id": ("registryid",), "name": ("facname", "facilityname"), "state": ("facstate", "state"),
        "longitude": ("faclong", "longitude"), "latitude": ("faclat", "latitude")}, programs)
    return rows.where(F.arrays_overlap("programs", F.array(*[F.lit(p) for p in INDUSTRIAL_PROGRAMS])))


def _read_csv(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, header=True, encoding="UTF-8", quote='"', escape='"')
    return df.select("*", file_order().alias("row_order"))


def read_tri(spark: SparkSession, path: str) -> DataFrame:
    return parse_tri(_read_csv(spark, path))


def read_echo(spark: SparkSession, path: str) -> DataFrame:
    return parse_echo(_read_csv(spark, path))


# --- readings --------------------------------------------------------------------------------------------
READING = ("hazard", "station_id", "observed_at", "source", "value", "unit")
PARAMETER = "struct<name:string,displayName:string,units:string>"
SENSOR_SCHEMA = (f"location struct<id:string>, sensor struct<id:string,parameter:{PARAMETER}>, "
                 f"results array<struct<value:double,parameter:{PARAMETER},"
                 "period:struct<datetimeFrom:struct<utc:string>,datetimeTo:struct<utc:string>>>>")


def parse_openaq(rows: DataFrame) -> DataFrame:
    """Hourly sensor values; a document joins a location, one of its sensors and that sensor's hours."""
    doc = rows.select(F.from_json("value", SENSOR_SCHEMA).alias("d")).select("d.*")
    name = F.lower(F.coalesce(F.nullif("sensor.parameter.name", F.lit("")), F.col("sensor.parameter.displayName")))
    hour = doc.withColumn("hazard", lookup(name, SENSOR_PARAMETERS)).where(
        F.col("hazard").isNotNull() & F.col("sensor.id").isNotNull()).select("*", F.explode("results").alias("r"))
    seen = F.coalesce("r.period.datetimeFrom.utc", "r.period.datetimeTo.utc")
    unit = F.coalesce(F.nullif("r.parameter.units", F.lit("")), F.nullif("sensor.parameter.units", F.lit("")), F.lit(""))
    return hour.where(F.col("r.value").isNotNull() & seen.isNotNull()).select(
        "hazard", F.concat_ws(":", F.lit("openaq"), "location.id", "sensor.id").alias("station_id"),
        parse_instant(seen).alias("observed_at"), F.lit("openaq").alias("source"),
        F.col("r.value").alias("value"), unit.alias("unit"))


def parse_airnow(rows: DataFrame, loaded_at: Column) -> DataFrame:
    """Air quality index rows, stamped with the time of loading."""
    schema = "array<struct<ParameterName:string,ReportingArea:string,AQI:double>>"
    row = rows.select(F.explode(F.from_json("value", schema)).alias("r")).select("r.*")
    hazard = lookup(F.lower("ParameterName"), AQI_PARAMETERS)
    return row.withColumn("hazard", hazard).where(F.col("hazard").isNotNull()).select(
        F.concat("hazard", F.lit("_aqi")).alias("hazard"),
        F.concat(F.lit("airnow:"), F.coalesce("ReportingArea", F.lit("nyc"))).alias("station_id"),
        loaded_at.alias("observed_at"), F.lit("airnow").alias("source"), F.col("AQI").alias("value"),
        F.lit("AQI").alias("unit"))


def parse_weather(rows: DataFrame) -> DataFrame:
    """Up to four readings from the first hourly period of a forecast."""
    schema = ("properties struct<periods:array<struct<startTime:string,temperature:double,temperatureUnit:string,"
              "relativeHumidity:struct<value:double>,windSpeed:string,windDirection:string>>>")
    period = rows.select(F.get(F.from_json("value", schema)["properties"]["periods"], F.lit(0)).alias("p")).select("p.*")
    heat = F.when(F.upper(F.coalesce("temperatureUnit", F.lit("F"))) == "F", f_to_c(F.col("temperature"))) \
        .otherwise(F.col("temperature"))
    parts = [("heat", heat, "C"), ("humidity", F.col("relativeHumidity.value"), "%"),
             ("wind_speed", first_number(F.coalesce("windSpeed", F.lit(""))), "mph"),
             ("wind_bearing", wind_bearing(F.coalesce("windDirection", F.lit(""))), "deg")]
    readings = F.explode(F.array(*[F.struct(F.lit(h).alias("hazard"), v.alias("value"), F.lit(u).alias("unit"))
                                   for h, v, u in parts]))
    return period.select("startTime", readings.alias("r")).where(F.col("r.value").isNotNull()).select(
        "r.hazard", F.lit("nws:nyc").alias("station_id"), parse_instant(F.col("startTime")).alias("observed_at"),
        F.lit("nws").alias("source"), "r.value", "r.unit")


def parse_alerts(rows: DataFrame, loaded_at: Column) -> DataFrame:
    fields = ("event", "headline", "severity", "urgency", "certainty", "onset", "expires", "description", "instruction", "sent")
    schema = f"features array<struct<id:string,properties:struct<id:string,{','.join(f'{f}:string' for f in fields)}>>>"
    f = rows.select(F.explode(F.from_json("value", schema)["features"]).alias("f")).select("f.*")
    alert_id = F.coalesce(F.nullif("properties.id", F.lit("")), F.nullif("id", F.lit("")))
    p = {name: F.col(f"properties.{name}") for name in fields}
    return f.where(alert_id.isNotNull() & (F.coalesce(p["event"], F.lit("")) != "")).select(
        alert_id.alias("id"), *[p[n].alias(n) for n in fields[:5]],
        parse_instant(p["onset"]).alias("onset"), parse_instant(p["expires"]).alias("expires_at"),
        p["description"].alias("description"), p["instruction"].alias("instruction"),
        F.coalesce(parse_instant(p["sent"]), loaded_at).alias("updated_at"))


def parse_pollen(rows: DataFrame) -> DataFrame:
    """First forecast day per location; a kind without an index reads 0."""
    schema = ("latitude double, longitude double, forecast struct<dailyInfo:array<struct<"
              "date:struct<year:int,month:int,day:int>,"
              "pollenTypeInfo:array<struct<code:string,indexInfo:struct<value:double>>>>>>")
    day = rows.select(F.from_json("value", schema).alias("d")).select(
        "d.latitude", "d.longitude", F.get(F.col("d.forecast.dailyInfo"), F.lit(0)).alias("day")).where(F.col("day").isNotNull())
    info = day.select("latitude", "longitude", "day.date", F.explode("day.pollenTypeInfo").alias("i"))
    hazard = lookup(F.upper("i.code"), POLLEN_CODES)
    return info.withColumn("hazard", hazard).where(F.col("hazard").isNotNull()).select(
        "hazard", F.format_string("google-pollen:%.5f:%.5f", "latitude", "longitude").alias("station_id"),
        F.make_date("date.year", "date.month", "date.day").cast("timestamp").alias("observed_at"),
        F.lit("google_pollen").alias("source"), F.coalesce("i.indexInfo.value", F.lit(0.0)).alias("value"),
        F.lit("UPI").alias("unit"))


def read_openaq(spark: SparkSession, path: str) -> DataFrame:
    return parse_openaq(text_rows(spark, path))


def read_airnow(spark: SparkSession, path: str, loaded_at: Column) -> DataFrame:
    return parse_airnow(text_rows(spark, path, whole=True), loaded_at)


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    return parse_weather(text_rows(spark, path, whole=True))


def read_alerts(spark: SparkSession, path: str, loaded_at: Column) -> DataFrame:
    return parse_alerts(text_rows(spark, path, whole=True), loaded_at)


def read_pollen(spark: SparkSession, path: str) -> DataFrame:
    return parse_pollen(text_rows(spark, path))


def records(rows: DataFrame, fields: str) -> DataFrame:
    """JSON records of a feed as columns, with ``row_order``: one object a row, an array of them, or a page with ``data``."""
    page = F.coalesce(F.get_json_object("value", "$.data"), F.col("value"))
    kind = T.ArrayType(T.StructType.fromDDL(fields))
    found = _with_order(rows).select("row_order", F.posexplode(F.from_json(page, kind)).alias("pos", "r"))
    return found.where("r is not null").select("r.*", F.struct("row_order", "pos").alias("row_order"))


def rejects(rows: DataFrame, fields: str) -> DataFrame:
    """Rows of a feed that hold no record at all, with the reason; what parsers leave out for its values is not here."""
    page = F.coalesce(F.get_json_object("value", "$.data"), F.col("value"))
    read = F.from_json(page, T.ArrayType(T.StructType.fromDDL(fields)))
    names = [f.name for f in T.StructType.fromDDL(fields)]
    bare = F.forall(read, lambda r: r.isNull() | ~F.coalesce(*[F.when(r[n].isNotNull(), F.lit(True)) for n in names], F.lit(False)))
    reason = (F.when(F.trim(F.coalesce("value", F.lit(""))) == "", "empty").when(read.isNull(), "not JSON records")
              .when((F.size(read) > 0) & bare, "none of the fields"))
    return rows.select("value", reason.alias("reason")).where("reason is not null")


PERMIT_FIELDS = ("work_permit string, bin string, work_type string, permit_status string, issued_date string, "
                 "expired_date string")
TREE_FIELDS = ("tree_id string, spc_latin string, spc_common string, status string, tree_dbh string, "
               "latitude string, longitude string")
IMAGE_FIELDS = ("id string, geometry struct<type:string,coordinates:array<double>>, compass_angle double, "
                "captured_at string, thumb_1024_url string")


# --- permits, trees, images --------------------------------------------------------------------------------
def parse_permits(rows: DataFrame, as_of: Column) -> DataFrame:
    """Issued permits not expired on the day, with severity."""
    p = records(rows, PERMIT_FIELDS)
    filled = F.lit(True)
    for name in ("work_permit", "bin", "work_type", "expired_date"):
        filled = filled & (F.coalesce(F.col(name), F.lit("")) != "")
    return (p.where(filled & (F.coalesce("permit_status", F.lit("Permit Issued")) == "Permit Issued"))
            .withColumn("expires_at", date_prefix(F.col("expired_date")))
            .where(F.col("expires_at") >= F.to_date(as_of))
            .select(F.col("work_permit").alias("permit_id"), F.lit("nyc_dob_now").alias("source"), "bin",
                    F.col("work_type").alias("permit_type"), date_prefix(F.col("issued_date")).alias("issued_at"),
                    "expires_at", permit_severity(F.col("work_type")).alias("severity")))


def parse_centroids(rows: DataFrame) -> DataFrame:
    """Building centroids, the last one per building."""
    schema = ("features array<struct<properties:struct<bin:string>,geometry:struct<coordinates:array<double>>>>")
    f = _with_order(rows).select("row_order", F.posexplode(F.from_json("value", schema)["features"]).alias("pos", "f"))
    usable = f.where((F.coalesce("f.properties.bin", F.lit("")) != "") & (F.size("f.geometry.coordinates") >= 2))
    placed = usable.select(F.col("f.properties.bin").alias("bin"), F.get("f.geometry.coordinates", F.lit(0)).alias("longitude"),
                           F.get("f.geometry.coordinates", F.lit(1)).alias("latitude"),
                           F.struct("row_order", "pos").alias("row_order"))
    return last_per(placed, "bin").drop("row_order")


def parse_trees(rows: DataFrame) -> DataFrame:
    """Living trees inside the city's box."""
    t = records(rows, TREE_FIELDS).where(F.col("status") == "Alive")
    latin = blank_to_null(F.col("spc_latin"))
    return t.select(
        F.col("tree_id").try_cast("long").alias("tree_id"), latin.alias("species_latin"),
        blank_to_null(F.col("spc_common")).alias("species_common"), F.get(F.split(latin, r"\s+"), F.lit(0)).alias("genus"),
        "status", optional_double(F.col("tree_dbh")).alias("dbh_inches"),
        optional_double(F.col("longitude")).alias("longitude"), optional_double(F.col("latitude")).alias("latitude")) \
        .where(F.col("tree_id").isNotNull() & in_bbox(F.col("longitude"), F.col("latitude")))


def parse_images(rows: DataFrame) -> DataFrame:
    """Street images that are complete and in range; the last one per id."""
    i = records(rows, IMAGE_FIELDS)
    number = F.trim("captured_at").try_cast("double")
    captured = F.when(number.isNotNull(), parse_epoch(number)).otherwise(parse_instant(F.trim("captured_at")))
    lon, lat = F.get("geometry.coordinates", F.lit(0)), F.get("geometry.coordinates", F.lit(1))
    usable = i.select(
        blank_to_null(F.col("id")).alias("image_id"), "geometry", lon.alias("longitude"), lat.alias("latitude"),
        F.pmod("compass_angle", F.lit(360.0)).alias("compass_angle"), captured.alias("captured_at"),
        blank_to_null(F.col("thumb_1024_url")).alias("thumb_url"), "row_order") \
        .where(F.col("image_id").isNotNull() & (F.col("geometry.type") == "Point") & (F.size("geometry.coordinates") >= 2)
               & finite(F.col("compass_angle")) & F.col("captured_at").isNotNull() & F.col("thumb_url").isNotNull()
               & finite(F.col("longitude")) & finite(F.col("latitude"))
               & F.col("longitude").between(-180, 180) & F.col("latitude").between(-90, 90)).drop("geometry")
    return last_per(usable, "image_id").drop("row_order")


def read_permits(spark: SparkSession, path: str, as_of: Column) -> DataFrame:
    return parse_permits(text_rows(spark, path), as_of)


def read_centroids(spark: SparkSession, path: str) -> DataFrame:
    return parse_centroids(text_rows(spark, path, whole=True))


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    return parse_trees(text_rows(spark, path))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    return parse_images(text_rows(spark, path))


def latest_grids(paths: DataFrame) -> DataFrame:
    """Newest grid per pollutant from a listing (``path``); fails when used if a pollutant is missing."""
    found = None
    for hazard, pattern in GRID_NAME_PATTERNS.items():
        year = F.regexp_extract("path", pattern, 1)
        part = paths.where(year != "").select(F.lit(hazard).alias("hazard"), year.cast("int").alias("year"), "path")
        found = part if found is None else found.unionByName(part)
    latest = found.groupBy("hazard").agg(F.max(F.struct("year", "path")).alias("g"))
    n = latest.agg(F.count(F.lit(1))).scalar()
    complete = F.when(n < len(GRID_NAME_PATTERNS), F.raise_error(F.lit("the archive lacks the grid of a pollutant")).cast("int")) \
        .otherwise(F.col("g.year"))
    return latest.select("hazard", complete.alias("year"), F.col("g.path").alias("path"))
