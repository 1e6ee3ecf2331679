"""Street imagery: snapping, route sampling, scoring backlogs, masks and segment features."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Tables, micros, q4, r4, register
from kerbside.operators import imagery, network
from kerbside.operators.ranking import drop_repeats, number_rows
from kerbside.session import stored
from kerbside.vocab import PERSON_CLASSES, VEHICLE_CLASSES

SNAP = """snapped AS (
  SELECT image_id, segment_id AS nearest_segment_id, d, captured_s, thumb_url, x, y FROM (
    SELECT i.image_id, i.captured_s, i.thumb_url, i.x, i.y, s.segment_id, floor(sqrt(power(greatest(s.x-i.x,0,i.x-s.x-s.length_m),2)+power(s.y-i.y,2))*1e6+0.5)/1e6 AS d,
      row_number() OVER (PARTITION BY i.image_id ORDER BY floor(sqrt(power(greatest(s.x-i.x,0,i.x-s.x-s.length_m),2)+power(s.y-i.y,2))*1e6+0.5), s.segment_id) AS rn
    FROM fx_image i JOIN fx_segment s ON s.y BETWEEN i.y-25 AND i.y+25 AND sqrt(power(greatest(s.x-i.x,0,i.x-s.x-s.length_m),2)+power(s.y-i.y,2)) <= 25)
  WHERE rn=1)"""


def snapped(t: Tables):
    return imagery.snap_images(t.image(), t.segment())


@register("c7_snap_images", f"WITH {SNAP} SELECT image_id, nearest_segment_id, {q4('d')} AS snap_distance_m FROM snapped", ("fx_image", "fx_segment"))
def c7(t: Tables):
    return snapped(t).select("image_id", "nearest_segment_id", r4("snap_distance_m").alias("snap_distance_m"))


# One route per order: an L of two legs, long enough for several steps.
ROUTES = """rt AS (SELECT o_orderkey AS route_id, cast((o_orderkey*3571)%19000 as double) AS x, cast((o_orderkey*2221)%19000 as double) AS y,
  cast(o_orderkey%7*40+60 as double) AS a, cast(o_orderkey%5*50+40 as double) AS b FROM orders),
st AS (SELECT *, s*50.0::double AS o FROM rt, generate_series(0, cast(floor((a+b)/50) as bigint)) g(s)),
pos AS (SELECT route_id, s, o, x+least(o,a) AS px, y+greatest(o-a,0) AS py,
  x+least(greatest(o-10,0),a) AS bhx, y+greatest(o-10-a,0) AS bhy, x+least(least(o+10,a+b),a) AS ahx, y+greatest(least(o+10,a+b)-a,0) AS ahy FROM st),
stp AS (SELECT *, CASE WHEN ahx=bhx AND ahy=bhy THEN 0.0 WHEN degrees(atan2(ahx-bhx,ahy-bhy))<0 THEN degrees(atan2(ahx-bhx,ahy-bhy))+360 ELSE degrees(atan2(ahx-bhx,ahy-bhy)) END AS bearing FROM pos)"""


def routes(t: Tables):
    base = t.raw("orders").selectExpr("o_orderkey AS route_id", "cast((o_orderkey*3571)%19000 as double) AS x", "cast((o_orderkey*2221)%19000 as double) AS y",
                                      "cast(o_orderkey%7*40+60 as double) AS a", "cast(o_orderkey%5*50+40 as double) AS b")
    return base.selectExpr("route_id", "array(struct(x, y), struct(x+a AS x, y), struct(x+a AS x, y+b AS y)) AS pts")


@register("h20_route_steps", f"WITH {ROUTES} SELECT route_id, cast(s as bigint) AS step, o AS distance_offset_m, {q4('px')} AS x, {q4('py')} AS y, {q4('bearing')} AS bearing_deg FROM stp")
def route_steps(t: Tables):
    return imagery.route_steps(routes(t)).select("route_id", "step", "distance_offset_m", r4("x").alias("x"), r4("y").alias("y"), r4("bearing_deg").alias("bearing_deg"))


FRAMES = f"""{ROUTES},
near AS (SELECT p.route_id, p.s, p.o, p.bearing, i.image_id, floor(sqrt(power(i.x-px,2)+power(i.y-py,2))*1e6+0.5)/1e6 AS d
  FROM stp p JOIN fx_image i ON i.x BETWEEN px-30 AND px+30 AND i.y BETWEEN py-30 AND py+30 AND sqrt(power(i.x-px,2)+power(i.y-py,2)) <= 30
   AND abs((i.compass_angle-p.bearing+540)-360*floor((i.compass_angle-p.bearing+540)/360)-180) <= 45),
best AS (SELECT *, row_number() OVER (PARTITION BY route_id, s ORDER BY d, image_id) AS rn FROM near),
lagged AS (SELECT *, lag(image_id) OVER (PARTITION BY route_id ORDER BY s) AS prev FROM best WHERE rn=1),
fr AS (SELECT route_id, s, o, bearing, image_id, d, row_number() OVER (PARTITION BY route_id ORDER BY s)-1 AS seq FROM lagged WHERE prev IS DISTINCT FROM image_id)"""


def frames(t: Tables):
    return stored(imagery.sample_route_images(routes(t), t.image()).withColumn("analysis_id", F.col("route_id")),
                  "route_analysis_frame")


@register("c8_sample_route_images", f"WITH {FRAMES} SELECT route_id, cast(s as bigint) AS step, seq, image_id, {q4('bearing')} AS bearing_deg, {q4('d')} AS image_distance_m FROM fr", ("fx_image",))
def c8(t: Tables):
    return frames(t).select("route_id", "step", "seq", "image_id", r4("bearing_deg").alias("bearing_deg"), r4("image_distance_m").alias("image_distance_m"))


@register("e3_drop_repeats", """SELECT user_id, event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type""")
def e3(t: Tables):
    return drop_repeats(t.raw("events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type", chunk=50).select("user_id", "event_id")


@register("e4_number_rows", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)-1 AS seq FROM events")
def e4(t: Tables):
    return number_rows(t.raw("events").select("user_id", "event_id"), "user_id", "event_id", chunk=50).select("event_id", "seq")


UNSCORED = """usable AS (SELECT image_id FROM fx_analysis WHERE model_version='v1' AND (ego_vehicle_frac IS NOT NULL OR cast(cast(car_frac as float) as double)<=0.10))"""


@register("c10_unscored_images", f"WITH {SNAP}, {UNSCORED} SELECT image_id, nearest_segment_id FROM snapped WHERE image_id NOT IN (SELECT image_id FROM usable)", ("fx_image", "fx_segment", "fx_analysis"))
def c10(t: Tables):
    return imagery.unscored_images(snapped(t), t.analysis(), "v1").select("image_id", "nearest_segment_id")


@register("f2_newest_unscored", f"WITH {SNAP}, {UNSCORED} SELECT image_id FROM snapped WHERE image_id NOT IN (SELECT image_id FROM usable) ORDER BY captured_s DESC, image_id LIMIT 25", ("fx_image", "fx_segment", "fx_analysis"))
def f2(t: Tables):
    return imagery.unscored_images(snapped(t), t.analysis(), "v1", 25).select("image_id")


@register("c11_unscored_frames", f"WITH {FRAMES} SELECT route_id, seq, image_id FROM fr WHERE image_id NOT IN (SELECT image_id FROM fx_analysis)", ("fx_image", "fx_analysis"))
def c11(t: Tables):
    return imagery.unscored_frames(frames(t), t.analysis(), "v1").select("route_id", "seq", "image_id")


@register("c12_frame_detail", f"WITH {FRAMES} SELECT route_id, seq, image_id, i.thumb_url, a.sky_view_factor, cast(a.sky_view_factor IS NOT NULL as bigint) AS scored FROM fr JOIN fx_image i USING (image_id) LEFT JOIN fx_analysis a USING (image_id)", ("fx_image", "fx_analysis"))
def c12(t: Tables):
    return detail(t).select("route_id", "seq", "image_id", "thumb_url", "sky_view_factor", F.col("scored").cast("long").alias("scored"))


def detail(t: Tables):
    metrics = t.analysis().withColumn("vegetation_frac", F.lit(None).cast("double"))
    for name in ("sidewalk_frac", "vehicle_count", "person_count"):
        metrics = metrics.withColumn(name, F.lit(None).cast("double"))
    return imagery.frame_detail(frames(t), t.image(), metrics, "v1")


@register("d23_frame_coverage", f"WITH {FRAMES} SELECT route_id AS analysis_id, count(a.image_id) AS scored_count, count(*)*50.0::double AS covered_m FROM fr LEFT JOIN fx_analysis a USING (image_id) GROUP BY 1", ("fx_image", "fx_analysis"))
def d23(t: Tables):
    return imagery.frame_coverage(detail(t))


@register("i5_analysis_status", f"""WITH {FRAMES}, p AS (SELECT route_id, count(*) AS n, count(*)-count(a.image_id) AS w FROM fr LEFT JOIN fx_analysis a USING (image_id) GROUP BY 1)
SELECT o_orderkey AS analysis_id, coalesce(n,0) AS frame_count, CASE WHEN coalesce(n,0)=0 THEN 'no_imagery' WHEN w=0 THEN 'ready' ELSE 'pending' END AS status FROM orders LEFT JOIN p ON route_id=o_orderkey""", ("fx_image", "fx_analysis"))
def status(t: Tables):
    analyses = t.raw("orders").select(F.col("o_orderkey").alias("analysis_id"))
    return imagery.analysis_status(analyses, detail(t)).select("analysis_id", "frame_count", "status")


# Frames for features: every image on one of a few segments, in UTC seconds.
FEATURE_FRAMES = """ff AS (SELECT i.image_id, i.image_id%23 AS segment_id, i.captured_s, a.sky_view_factor AS sky, least(greatest(a.car_frac+a.person_frac,0),1) AS crowd, coalesce(a.ego_vehicle_frac,0) AS ego,
  hour(make_timestamp(i.captured_s*1000000) AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York') BETWEEN 8 AND 17 AS day FROM fx_image i JOIN fx_analysis a USING (image_id))"""


def feature_frames(t: Tables):
    placed = t.image().withColumn("nearest_segment_id", F.col("image_id") % 23)
    return imagery.scored_frames(placed, t.analysis(), "v1")


@register("b5_daylight", f"WITH {FEATURE_FRAMES} SELECT image_id, segment_id FROM ff WHERE day", ("fx_image", "fx_analysis"))
def b5(t: Tables):
    return imagery.daylight(feature_frames(t)).select("image_id", "segment_id")


@register("b5_dark_count", f"WITH {FEATURE_FRAMES} SELECT count(*) FILTER (WHERE NOT day) AS excluded_dark_count FROM ff", ("fx_image", "fx_analysis"))
def b5_dark(t: Tables):
    return imagery.dark_count(feature_frames(t))


@register("d10_crowd_density", f"WITH {FEATURE_FRAMES} SELECT image_id, {q4('crowd', 6)} AS crowd_density FROM ff", ("fx_image", "fx_analysis"))
def d10(t: Tables):
    return feature_frames(t).select("image_id", r4("crowd_density", 6).alias("crowd_density"))


FEATURES = f"""{FEATURE_FRAMES},
w AS (SELECT *, exp(-greatest(1704067200-captured_s,0)/31557600.0/5.0) AS sw, exp(-greatest(1704067200-captured_s,0)/31557600.0/0.5) AS cw, bool_or(ego<=0.5) OVER (PARTITION BY segment_id) AS usable FROM ff WHERE day),
s AS (SELECT segment_id, sky, sum(sw) OVER (PARTITION BY segment_id ORDER BY sky) AS c, sum(sw) OVER (PARTITION BY segment_id) AS t FROM w),
k AS (SELECT segment_id, crowd, sum(cw) OVER (PARTITION BY segment_id ORDER BY crowd) AS c, sum(cw) OVER (PARTITION BY segment_id) AS t FROM w WHERE ego<=0.5 OR NOT usable),
feature AS (SELECT * FROM (SELECT segment_id, min(sky) AS sky FROM s WHERE c>=t/2*(1-1e-12) GROUP BY 1) JOIN (SELECT segment_id, min(crowd) AS crowd FROM k WHERE c>=t/2*(1-1e-12) GROUP BY 1) USING (segment_id) JOIN (SELECT segment_id, count(*) AS frame_count FROM w GROUP BY 1) USING (segment_id))"""


def features(t: Tables):
    return imagery.image_features(imagery.daylight(feature_frames(t)), F.timestamp_seconds(F.lit(1704067200)))


@register("d9_image_features", f"WITH {FEATURES} SELECT segment_id, {q4('sky')} AS sky_view_factor_raw, {q4('crowd')} AS crowd_density_raw, frame_count FROM feature", ("fx_image", "fx_analysis"))
def d9(t: Tables):
    return features(t).select("segment_id", r4("sky_view_factor_raw").alias("sky_view_factor_raw"), r4("crowd_density_raw").alias("crowd_density_raw"), "frame_count")


@register("d18_feature_stats", f"WITH {FEATURES} SELECT count(*) FILTER (WHERE day) AS frame_count, count(*) FILTER (WHERE NOT day) AS excluded_dark_count, (SELECT count(*) FROM feature) AS segment_count, {q4('(SELECT count(*) FROM feature)*1.0/(SELECT count(*) FROM fx_segment)')} AS coverage_fraction FROM ff", ("fx_image", "fx_analysis", "fx_segment"))
def d18(t: Tables):
    out = network.feature_stats(feature_frames(t), features(t), t.segment())
    return out.select("frame_count", "excluded_dark_count", "segment_count", r4("coverage_fraction").alias("coverage_fraction"))


# --- masks: an 8x8 label mask from every 64-float embedding -------------------------------------------
LABELS = {0: "road", 1: "sidewalk", 2: "car", 3: "vegetation", 4: "sky", 5: "person", 6: "building"}
MASK = "cast(least(floor(abs(e)*30),7) as int)"
PIXELS = f"""px AS (SELECT vec_id, (i-1)//8 AS r, {MASK} AS c FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(1,65)) AS i FROM embeddings))"""
NAME = "CASE c " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in LABELS.items()) + " ELSE 'class_'||c END"


def masks(t: Tables):
    mask = F.transform("embedding", lambda e: F.least(F.floor(F.abs(e) * 30), F.lit(7)).cast("int"))
    return t.raw("embeddings").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), mask.alias("mask"))


@register("d11_class_histogram", f"WITH {PIXELS} SELECT vec_id AS image_id, {NAME} AS label, {q4('count(*)/64.0', 6)} AS fraction FROM px GROUP BY 1, 2")
def d11(t: Tables):
    return imagery.class_histogram(masks(t), LABELS).select("image_id", F.explode("class_fractions").alias("label", "fraction")).withColumn("fraction", r4("fraction", 6))


@register("d12_frame_metrics", f"""WITH {PIXELS} SELECT vec_id AS image_id, {q4('sum(CASE WHEN c=4 THEN 1-r/7.0 ELSE 0 END)/32.0', 5)} AS sky_view_factor,
  {q4('sum(CASE WHEN c=2 AND r>=6 THEN 1 ELSE 0 END)/16.0', 5)} AS ego_vehicle_frac, {q4('count(*) FILTER (WHERE c=3)/64.0', 5)} AS vegetation_frac FROM px GROUP BY 1""")
def d12(t: Tables):
    return imagery.frame_metrics(masks(t), LABELS).select("image_id", *[r4(c, 5).alias(c) for c in ("sky_view_factor", "ego_vehicle_frac", "vegetation_frac")])


def _components_sql(classes) -> str:
    ids = ",".join(str(k) for k, v in LABELS.items() if v in classes)
    return f"c IN ({ids})"


@register("d13_instance_counts", f"""
WITH RECURSIVE {PIXELS.replace('(i-1)//8 AS r', '(i-1)//8 AS r, (i-1)%8 AS q')},
hit AS (SELECT vec_id, 'v' AS k, r, q FROM px WHERE {_components_sql(VEHICLE_CLASSES)} UNION ALL SELECT vec_id, 'p', r, q FROM px WHERE {_components_sql(PERSON_CLASSES)}),
reach AS (SELECT vec_id, k, r, q, r*8+q AS root FROM hit UNION SELECT h.vec_id, h.k, h.r, h.q, a.root FROM reach a JOIN hit h ON h.vec_id=a.vec_id AND h.k=a.k AND abs(h.r-a.r)<=1 AND abs(h.q-a.q)<=1),
comp AS (SELECT vec_id, k, r, q, min(root) AS root FROM reach GROUP BY 1,2,3,4),
big AS (SELECT vec_id, k, root FROM comp GROUP BY 1,2,3 HAVING count(*)>=16)
SELECT e.vec_id AS image_id, cast((SELECT count(*) FROM big b WHERE b.vec_id=e.vec_id AND k='v') as bigint) AS vehicle_count, cast((SELECT count(*) FROM big b WHERE b.vec_id=e.vec_id AND k='p') as bigint) AS person_count FROM embeddings e""")
def d13(t: Tables):
    return imagery.instance_counts(masks(t), LABELS).select("image_id", F.col("vehicle_count").cast("long").alias("vehicle_count"), F.col("person_count").cast("long").alias("person_count"))


@register("d24_class_manifest", f"""WITH {PIXELS}, pick AS (SELECT image_id FROM fx_image WHERE image_id IN (SELECT vec_id FROM embeddings) ORDER BY captured_s DESC, image_id LIMIT 40), h AS (SELECT vec_id, {NAME} AS label FROM px WHERE vec_id IN (SELECT image_id FROM pick))
SELECT vec_id AS image_id, count(DISTINCT label) AS classes, (SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM h) AS detected_classes FROM h GROUP BY 1""", ("fx_image",))
def d24(t: Tables):
    # Snapped images here are those whose picture has a mask.
    placed = (t.image().join(t.raw("embeddings").select(F.col("vec_id").alias("image_id")), "image_id", "left_semi")
              .withColumn("nearest_segment_id", F.lit(1)))
    out = imagery.class_manifest(placed, masks(t), LABELS, 40)
    return out.select("image_id", F.size("class_fractions").cast("long").alias("classes"), "detected_classes")
