"""Fixture layer: the driver tables seen as streets, roads, trees, readings, images and routes.

Each fixture exists twice, as a DataFrame and as a SQL common table expression, built from the same
expressions. Coordinates are planar metres in a 20 km square from integer arithmetic, so both engines
agree exactly. Lines run in +x direction: they start at (x, y) and are ``length_m`` long.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.session import configure

AS_OF = "2024-01-30 12:00:00"
PERMIT_DAY = "1998-06-01"


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None = None, ctes: tuple[str, ...] = ()):
    """Add a query; ``ctes`` names the fixtures its SQL uses."""
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(Tables(spark, sf_dir))

        REGISTRY[name] = Entry(run, with_ctes(sql, ctes) if sql else None)
        return fn
    return add


# --- comparable output -----------------------------------------------------------------------------
def r4(value: Column | str, places: int = 4) -> Column:
    """Round for comparison. The offset keeps exact ties from depending on summation order."""
    value = F.col(value) if isinstance(value, str) else value
    factor = float(10 ** places)
    return F.floor(value * F.lit(factor) + F.lit(0.500001)) / F.lit(factor)


def q4(expr: str, places: int = 4) -> str:
    factor = float(10 ** places)
    return f"(floor(({expr})*{factor}+0.500001)/{factor})"


def ts(text: str) -> Column:
    return F.to_timestamp(F.lit(text))


def micros(column: str) -> Column:
    return F.unix_micros(F.col(column))


# --- fixtures as SQL ---------------------------------------------------------------------------------
CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "fx_segment": ((), """
        SELECT l_orderkey*100+l_linenumber AS segment_id, l_orderkey AS osm_way_id, l_linenumber AS seq,
          max(l_quantity)*2.0 AS length_m,
          cast((l_orderkey*7919+l_linenumber*613)%20000 as double) AS x,
          cast((l_orderkey*104729+l_linenumber*389)%20000 as double) AS y,
          CASE WHEN l_orderkey%13=0 THEN NULL ELSE floor((max(l_tax)-0.04)*5000000+0.5)/10000 END AS grade_pct,
          max(l_extendedprice) AS raw_value
        FROM lineitem GROUP BY l_orderkey, l_linenumber"""),
    "fx_road": ((), """
        SELECT p_partkey AS road_id,
          CASE p_type WHEN 'LARGE' THEN 'motorway' WHEN 'MEDIUM' THEN 'trunk'
            WHEN 'STANDARD' THEN 'primary' ELSE 'secondary' END AS highway_class,
          CASE p_type WHEN 'LARGE' THEN 5.0 WHEN 'MEDIUM' THEN 4.0 WHEN 'STANDARD' THEN 3.0
            ELSE 2.0 END::double AS proxy_weight,
          cast((p_partkey*15485863)%20000 as double) AS x, cast((p_partkey*32452843)%20000 as double) AS y,
          p_size*20.0::double AS length_m
        FROM part WHERE p_type IN ('LARGE','MEDIUM','STANDARD','SMALL')"""),
    "fx_facility": ((), """
        SELECT s_suppkey AS facility_id, cast((s_suppkey*7561)%20000 as double) AS x,
          cast((s_suppkey*5449)%20000 as double) AS y FROM supplier"""),
    "fx_tree": ((), """
        SELECT c_custkey AS tree_id,
          CASE c_mktsegment WHEN 'BUILDING' THEN 'Quercus' WHEN 'FURNITURE' THEN 'Acer' ELSE 'Other' END AS genus,
          cast((c_custkey*10007)%20000 as double) AS x, cast((c_custkey*20011)%20000 as double) AS y
        FROM customer"""),
    "fx_reading": ((), """
        SELECT CASE event_type WHEN 'view' THEN 'pm25' WHEN 'click' THEN 'ozone' WHEN 'purchase' THEN 'no2'
            WHEN 'signup' THEN 'pollen_tree' ELSE 'heat' END AS hazard,
          'st-' || cast(user_id%20 as varchar) AS station_id, ts AS observed_at,
          CASE WHEN event_id%4=0 THEN 'airnow' ELSE 'openaq' END AS source, value,
          CASE WHEN event_type='view' THEN 'ug/m3' ELSE 'ppb' END AS unit FROM events"""),
    "fx_permit": ((), """
        SELECT o_orderkey AS permit_id, greatest(5-cast(substring(o_orderpriority,1,1) as int), 1) AS severity,
          cast(o_orderdate as date) AS issued_at, cast(o_orderdate as date)+90 AS expires_at,
          cast((o_orderkey*6007)%20000 as double) AS x, cast((o_orderkey*9001)%20000 as double) AS y
        FROM orders"""),
    "fx_image": ((), """
        SELECT doc_id AS image_id, cast((doc_id*3571)%20000 as double) AS x,
          cast((doc_id*2221)%20000 as double) AS y, cast((doc_id*37)%360 as double) AS compass_angle,
          1420070400+(doc_id*5941541)%280000000 AS captured_s, n_chars,
          'https://img.example/' || cast(doc_id as varchar) AS thumb_url FROM documents"""),
    "fx_analysis": ((), """
        SELECT doc_id AS image_id, 'v1' AS model_version,
          ((doc_id*7919)%1000)/1000.0::double AS sky_view_factor,
          ((doc_id*104729)%300)/1000.0::double AS car_frac, ((doc_id*31)%200)/1000.0::double AS person_frac,
          CASE WHEN toxic=1 THEN NULL ELSE ((doc_id*613)%1000)/1000.0::double END AS ego_vehicle_frac, quality
        FROM labels"""),
    "fx_route": ((), """
        SELECT o_orderkey AS route_id, CASE WHEN o_custkey%10=0 THEN NULL ELSE o_custkey END AS user_id
        FROM orders"""),
    "fx_cell": ((), """
        SELECT (p_partkey%2500)//50 AS row, (p_partkey%2500)%50 AS col, max(p_retailprice)/100.0 AS pm25,
          cast(max(CASE WHEN p_size=7 THEN -9999 ELSE p_size END) as double) AS no2,
          cast(max((p_partkey*37)%101) as double) AS ozone
        FROM part GROUP BY 1, 2"""),
    "fx_scores": (("fx_segment",), """
        SELECT segment_id,
          CASE WHEN segment_id%7=0 THEN NULL ELSE cast((segment_id*17)%101 as double) END AS pm25_prior,
          CASE WHEN segment_id%11=0 THEN NULL ELSE cast((segment_id*29)%101 as double) END AS no2_prior,
          cast((segment_id*31)%101 as double) AS ozone_prior, cast((segment_id*37)%101 as double) AS traffic_prox,
          cast((segment_id*41)%101 as double) AS industrial_prox,
          CASE WHEN osm_way_id%9=0 THEN NULL ELSE cast((segment_id*43)%101 as double) END AS shade_benefit,
          cast((segment_id*47)%101 as double) AS pollen_source, segment_id%5=0 AS industrial_within_200m,
          CASE WHEN osm_way_id%3=0 THEN cast((segment_id*53)%101 as double) END AS sky_view_factor,
          CASE WHEN osm_way_id%3=0 THEN cast((segment_id*59)%101 as double) END AS crowd_prior
        FROM fx_segment WHERE segment_id%17<>0"""),
    "fx_way": (("fx_segment", "fx_scores"), None),
}


def _way_sql() -> str:
    from kerbside.operators.ways import SEGMENT_COLUMNS

    parts = []
    for name, column in SEGMENT_COLUMNS.items():
        missing = "127" if name in ("svf", "crowd") else "0"
        parts.append(f"coalesce(sum(c.{column}*s.length_m)/nullif(sum(CASE WHEN c.{column} IS NOT NULL THEN "
                     f"s.length_m END),0),{missing}) AS {name}")
    return (f"SELECT s.osm_way_id, {', '.join(parts)}, coalesce(sum(abs(s.grade_pct)*s.length_m)/nullif(sum(CASE "
            "WHEN s.grade_pct IS NOT NULL THEN s.length_m END),0),0) AS grade, max(CASE WHEN "
            "c.industrial_within_200m THEN 100.0 ELSE 0.0 END)::double AS industrial_within_200m "
            "FROM fx_segment s LEFT JOIN fx_scores c USING (segment_id) GROUP BY s.osm_way_id")


CTE["fx_way"] = (("fx_segment", "fx_scores"), _way_sql())


def quantised_sql(names=None) -> str:
    names = names or ("pm25", "no2", "ozone", "traffic", "industrial", "shade", "pollen", "grade",
                      "industrial_within_200m", "svf", "crowd")
    return ", ".join(
        f"cast(floor(least(greatest({n},0),{127.0 if n in ('svf', 'crowd') else 100.0})+0.5) as int) AS {n}"
        for n in names)


CTE["fx_wayq"] = (("fx_way",), f"SELECT osm_way_id, {quantised_sql()} FROM fx_way")


def with_ctes(sql: str, names: tuple[str, ...]) -> str:
    order: list[str] = []

    def need(name: str) -> None:
        for dep in CTE[name][0]:
            need(dep)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    head = ", ".join(f"{n} AS ({CTE[n][1]})" for n in order)
    text = sql.strip()
    if not head:
        return text
    if text.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {text[15:]}"
    if text.upper().startswith("WITH "):
        return f"WITH {head}, {text[5:]}"
    return f"WITH {head} {text}"


# --- fixtures as DataFrames --------------------------------------------------------------------------
def line_pts(x: str = "x", y: str = "y", length: str = "length_m") -> Column:
    return F.array(F.struct(F.col(x).alias("x"), F.col(y).alias("y")),
                   F.struct((F.col(x) + F.col(length)).alias("x"), F.col(y).alias("y")))


class Tables:
    """The driver tables of one folder and the fixtures made from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def segment(self) -> DataFrame:
        return (self.raw("lineitem").groupBy("l_orderkey", "l_linenumber")
                .agg(F.max("l_quantity").alias("q"), F.max("l_tax").alias("t"), F.max("l_extendedprice").alias("raw_value"))
                .selectExpr(
                    "l_orderkey*100+l_linenumber AS segment_id", "l_orderkey AS osm_way_id", "l_linenumber AS seq",
                    "q*2.0D AS length_m", "cast((l_orderkey*7919+l_linenumber*613)%20000 as double) AS x",
                    "cast((l_orderkey*104729+l_linenumber*389)%20000 as double) AS y",
                    "CASE WHEN l_orderkey%13=0 THEN NULL ELSE floor((t-0.04D)*5000000D+0.5D)/10000D END AS grade_pct",
                    "raw_value")
                .withColumn("pts", line_pts()))

    def road(self) -> DataFrame:
        return (self.raw("part").where("p_type IN ('LARGE','MEDIUM','STANDARD','SMALL')").selectExpr(
            "p_partkey AS road_id",
            "CASE p_type WHEN 'LARGE' THEN 'motorway' WHEN 'MEDIUM' THEN 'trunk' WHEN 'STANDARD' THEN 'primary' "
            "ELSE 'secondary' END AS highway_class",
            "CASE p_type WHEN 'LARGE' THEN 5.0D WHEN 'MEDIUM' THEN 4.0D WHEN 'STANDARD' THEN 3.0D ELSE 2.0D END "
            "AS proxy_weight",
            "cast((p_partkey*15485863)%20000 as double) AS x", "cast((p_partkey*32452843)%20000 as double) AS y",
            "p_size*20.0D AS length_m").withColumn("pts", line_pts()))

    def facility(self) -> DataFrame:
        return self.raw("supplier").selectExpr(
            "s_suppkey AS facility_id", "cast((s_suppkey*7561)%20000 as double) AS x",
            "cast((s_suppkey*5449)%20000 as double) AS y")

    def tree(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "c_custkey AS tree_id",
            "CASE c_mktsegment WHEN 'BUILDING' THEN 'Quercus' WHEN 'FURNITURE' THEN 'Acer' ELSE 'Other' END AS genus",
            "cast((c_custkey*10007)%20000 as double) AS x", "cast((c_custkey*20011)%20000 as double) AS y")

    def reading(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "CASE event_type WHEN 'view' THEN 'pm25' WHEN 'click' THEN 'ozone' WHEN 'purchase' THEN 'no2' "
            "WHEN 'signup' THEN 'pollen_tree' ELSE 'heat' END AS hazard",
            "concat('st-', cast(user_id%20 as string)) AS station_id", "cast(ts as timestamp) AS observed_at",
            "CASE WHEN event_id%4=0 THEN 'airnow' ELSE 'openaq' END AS source", "value",
            "CASE WHEN event_type='view' THEN 'ug/m3' ELSE 'ppb' END AS unit")

    def permit(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS permit_id", "greatest(5-cast(substring(o_orderpriority,1,1) as int), 1) AS severity",
            "to_date(o_orderdate) AS issued_at", "date_add(to_date(o_orderdate), 90) AS expires_at",
            "cast((o_orderkey*6007)%20000 as double) AS x", "cast((o_orderkey*9001)%20000 as double) AS y")

    def image(self) -> DataFrame:
        return self.raw("documents").selectExpr(
            "doc_id AS image_id", "cast((doc_id*3571)%20000 as double) AS x",
            "cast((doc_id*2221)%20000 as double) AS y", "cast((doc_id*37)%360 as double) AS compass_angle",
            "timestamp_seconds(1420070400+(doc_id*5941541)%280000000) AS captured_at", "n_chars",
            "concat('https://img.example/', cast(doc_id as string)) AS thumb_url")

    def analysis(self) -> DataFrame:
        return (self.raw("labels").selectExpr(
            "doc_id AS image_id", "'v1' AS model_version", "((doc_id*7919)%1000)/1000.0D AS sky_view_factor",
            "((doc_id*104729)%300)/1000.0D AS car_frac", "((doc_id*31)%200)/1000.0D AS person_frac",
            "CASE WHEN toxic=1 THEN NULL ELSE ((doc_id*613)%1000)/1000.0D END AS ego_vehicle_frac", "quality")
            .withColumn("raw_class_hist", F.create_map(F.lit("car"), F.col("car_frac"),
                                                       F.lit("person"), F.col("person_frac"))))

    def route(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS route_id", "CASE WHEN o_custkey%10=0 THEN NULL ELSE o_custkey END AS user_id")

    def grid(self) -> DataFrame:
        """One row per 400 m cell with the three pollutants."""
        return (self.raw("part").groupBy(F.expr("(p_partkey%2500) div 50").alias("row"),
                                         F.expr("(p_partkey%2500)%50").alias("col"))
                .agg((F.max("p_retailprice") / 100.0).alias("pm25"),
                     F.max(F.expr("CASE WHEN p_size=7 THEN -9999 ELSE p_size END")).cast("double").alias("no2"),
                     F.max(F.expr("(p_partkey*37)%101")).cast("double").alias("ozone")))

    def cells(self) -> DataFrame:
        return self.grid().select("row", "col", F.expr(
            "stack(3, 'pm25', pm25, 'no2', no2, 'ozone', ozone) AS (hazard, value)")).withColumn("raster", F.col("hazard"))

    def raster_meta(self) -> DataFrame:
        rows = [(h, h, i, 0.0, 20000.0, 400.0, 400.0, 50, 50, -9999.0)
                for i, h in enumerate(("pm25", "no2", "ozone"))]
        return self.spark.createDataFrame(
            rows, "raster string, hazard string, priority int, origin_x double, origin_y double, cell_x double, "
                  "cell_y double, n_rows int, n_cols int, nodata double")

    def scores(self, segments: DataFrame | None = None) -> DataFrame:
        return (self.segment() if segments is None else segments).where("segment_id%17<>0").selectExpr(
            "segment_id",
            "CASE WHEN segment_id%7=0 THEN NULL ELSE cast((segment_id*17)%101 as double) END AS pm25_prior",
            "CASE WHEN segment_id%11=0 THEN NULL ELSE cast((segment_id*29)%101 as double) END AS no2_prior",
            "cast((segment_id*31)%101 as double) AS ozone_prior", "cast((segment_id*37)%101 as double) AS traffic_prox",
            "cast((segment_id*41)%101 as double) AS industrial_prox",
            "CASE WHEN osm_way_id%9=0 THEN NULL ELSE cast((segment_id*43)%101 as double) END AS shade_benefit",
            "cast((segment_id*47)%101 as double) AS pollen_source", "segment_id%5=0 AS industrial_within_200m",
            "CASE WHEN osm_way_id%3=0 THEN cast((segment_id*53)%101 as double) END AS sky_view_factor",
            "CASE WHEN osm_way_id%3=0 THEN cast((segment_id*59)%101 as double) END AS crowd_prior")

    def ways(self, segments: DataFrame | None = None) -> DataFrame:
        from kerbside.operators.ways import way_scores

        return way_scores(self.segment() if segments is None else segments, self.scores(segments))

    def ways_quantised(self, segments: DataFrame | None = None) -> DataFrame:
        from kerbside.operators.ways import quantised_ways

        return quantised_ways(self.ways(segments))
