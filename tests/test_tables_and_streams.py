"""Writes that survive failure, and streams with late corrections and restarts."""

import pytest
from pyspark.sql import functions as F

from kerbside import sinks
from kerbside.sources import feeds
from kerbside.streaming import jobs

SCHEMA = "hazard string, station_id string, observed_at timestamp, source string, value double, unit string"
ONCE = {"availableNow": True}


def test_failed_replace_keeps_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_table(spark.range(3), path)
    with pytest.raises(Exception):
        sinks.replace_table(spark.range(3).select(F.raise_error(F.lit("boom")).cast("long").alias("id")), path)
    assert sinks.read_table(spark, path).count() == 3
    with pytest.raises(ValueError):
        sinks.replace_table(spark.range(0), path, allow_empty=False)
    assert sinks.read_table(spark, path).count() == 3


def test_merge_family_keeps_and_resets(spark):
    old = spark.createDataFrame([(1, 5.0, 7.0), (2, 6.0, 8.0)], "segment_id long, a double, b double")
    new = spark.createDataFrame([(2, None), (3, 1.0)], "segment_id long, a double")
    kept = {r.segment_id: (r.a, r.b) for r in sinks.merge_family(old, new, ["a"]).collect()}
    assert kept == {1: (5.0, 7.0), 2: (None, 8.0), 3: (1.0, None)}
    reset = {r.segment_id: r.a for r in sinks.merge_family(old, new, ["a"], reset=True).collect()}
    assert reset == {1: None, 2: None, 3: 1.0}


def test_reading_stream_restarts_and_takes_late_corrections(spark, tmp_path):
    inbox, table, chk = (str(tmp_path / n) for n in ("in", "table", "chk"))

    def land(rows):
        spark.createDataFrame(rows, "hazard string, station_id string, t string, source string, value double, unit string") \
            .withColumn("observed_at", F.to_timestamp("t")).drop("t").write.mode("append").parquet(inbox)

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(inbox)
        jobs.stream_readings(stream, table, chk, ONCE).awaitTermination()
        return {(r.station_id, str(r.observed_at)): r.value for r in sinks.read_partitions(spark, table).collect()}

    land([("pm25", "a", "2024-01-01 00:00:00", "s", 1.0, "u"), ("pm25", "a", "2024-01-03 00:00:00", "s", 3.0, "u")])
    first = run()
    assert sorted(first.values()) == [1.0, 3.0]
    # Older than the lookback, out of order, and a repeat: still overwritten by key after a restart.
    land([("pm25", "a", "2024-01-01 00:00:00", "s", 9.0, "u"), ("pm25", "b", "2024-01-02 00:00:00", "s", 2.0, "u")])
    second = run()
    assert sorted(second.values()) == [2.0, 3.0, 9.0]


def test_analysis_progress_emits_once_completes_and_times_out(spark, tmp_path):
    inbox, out, chk = (str(tmp_path / n) for n in ("in", "out", "chk"))

    def land(rows):
        spark.createDataFrame(rows, "analysis_id long, frame_count int, seq int, t string").withColumn(
            "scored_at", F.to_timestamp("t")).drop("t").coalesce(1).write.mode("append").parquet(inbox)

    def run():
        stream = spark.readStream.schema("analysis_id long, frame_count int, seq int, scored_at timestamp").parquet(inbox)
        jobs.stream_analysis(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", chk) \
            .trigger(**ONCE).start().awaitTermination()
        return sorted((r.analysis_id, r.event, r.seq) for r in spark.read.schema(jobs.PROGRESS_SCHEMA).parquet(out).collect())

    land([(1, 2, 0, "2024-01-01 00:00:00"), (1, 2, 0, "2024-01-01 00:00:01"), (2, 0, None, "2024-01-01 00:00:00"),
          (3, 5, 4, "2024-01-01 00:00:00")])
    assert run() == [(1, "frame", 0), (2, "no-imagery", None), (3, "frame", 4)]
    land([(1, 2, 1, "2024-01-01 00:00:30"), (9, 1, 0, "2024-01-01 00:05:00")])
    got = run()
    assert (1, "complete", None) in got and (1, "frame", 1) in got
    assert (3, "timeout", None) in got and got.count((1, "frame", 0)) == 1


def test_token_bucket_flags_only_the_excess(spark, tmp_path):
    inbox, out, chk = (str(tmp_path / n) for n in ("in", "out", "chk"))
    rows = [(i, "/api/v1/analysis/7/stream", "u1", f"2024-01-01 00:00:{i:02d}") for i in range(9)]
    spark.createDataFrame(rows, "request_id long, path string, user_id string, t string").withColumn(
        "address", F.lit("10.0.0.1")).withColumn("requested_at", F.to_timestamp("t")).drop("t").write.parquet(inbox)
    stream = spark.readStream.schema("request_id long, path string, user_id string, address string, requested_at timestamp").parquet(inbox)
    over = jobs.stream_over_limit(stream)
    over.writeStream.format("parquet").option("path", out).option("checkpointLocation", chk).trigger(**ONCE).start().awaitTermination()
    got = sorted(r.request_id for r in spark.read.schema(over.schema).parquet(out).collect())
    # Six at once, then one token per ten seconds: none has come back within nine seconds.
    assert got == [6, 7, 8]


def test_csv_reader_takes_first_row_per_id_in_file_order(spark, tmp_path):
    path = tmp_path / "tri.csv"
    path.write_text("3. FRS ID,4. FACILITY NAME,8. ST,12. LATITUDE,13. LONGITUDE\n1,Plant A,NY,40.7,-74.0\n1,Plant B,NY,40.8,-74.0\n"
                    "2,Far,NY,44.0,-74.0\n3,Other,NJ,40.7,-74.0\n")
    got = feeds.read_tri(spark, str(path)).collect()
    assert [(r.source_id, r.name, list(r.programs)) for r in got] == [("1", "Plant A", ["TRI"])]


def test_way_reader_strips_record_separators(spark, tmp_path):
    path = tmp_path / "ways.geojsonseq"
    path.write_text('\x1e{"id":"w42","geometry":{"type":"LineString","coordinates":[[-74.0,40.7],[-74.0,40.701]]},"properties":{"highway":"residential","sidewalk":"no"}}\n'
                    '\x1e{"id":"w43","geometry":{"type":"LineString","coordinates":[[-74.0,40.7],[-74.0,40.701]]},"properties":{"highway":"motorway"}}\n\n'
                    '\x1e{"id":"a9","geometry":{"type":"Point","coordinates":[-74.0,40.7]},"properties":{}}\n')
    got = feeds.read_ways(spark, str(path)).collect()
    assert [(r.osm_way_id, r.highway_class, r.has_sidewalk) for r in got] == [(42, "residential", False)]


def test_boundary_needs_exactly_five_features(spark):
    one = '{"features":[{"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}}]}'
    with pytest.raises(Exception, match="exactly 5"):
        feeds.borough_boundary(spark.createDataFrame([(one,)], "value string")).collect()


def test_a_source_can_be_replaced_by_nothing(spark, tmp_path):
    path, schema = str(tmp_path / "permits"), "permit_id string, source string"
    for source in ("a", "b"):
        sinks.replace_source(spark.createDataFrame([(f"{source}1", source), (f"{source}2", source)], schema), path, source)
    sinks.replace_source(spark.createDataFrame([], schema), path, "a")
    assert sorted(r.permit_id for r in sinks.read_partitions(spark, path).collect()) == ["b1", "b2"]
    with pytest.raises(Exception, match="not of the source"):
        sinks.replace_source(spark.createDataFrame([("x", "b")], schema), path, "c")
    assert sorted(r.permit_id for r in sinks.read_partitions(spark, path).collect()) == ["b1", "b2"]


def test_two_families_merged_at_once_are_both_kept(spark, tmp_path, monkeypatch):
    from kerbside.plans import static
    root = str(tmp_path)
    traffic = spark.createDataFrame([(1, 10.0), (2, 20.0)], "segment_id long, traffic_prox double")
    trees = spark.createDataFrame([(1, 30.0, 40.0), (3, 50.0, 60.0)], "segment_id long, shade_benefit double, pollen_source double")
    whole, calls = sinks.merge_family, []

    def interrupted(*args, **more):
        calls.append(1)
        if len(calls) == 1:
            static.refresh_family(trees, root, "trees")
        return whole(*args, **more)

    monkeypatch.setattr(sinks, "merge_family", interrupted)
    static.refresh_family(traffic, root, "traffic")
    got = {r.segment_id: (r.traffic_prox, r.shade_benefit) for r in sinks.read_table(spark, f"{root}/segment_static_score").collect()}
    assert got == {1: (10.0, 30.0), 2: (20.0, None), 3: (None, 50.0)}


def test_feeds_come_as_objects_arrays_or_pages_and_rejects_are_told(spark):
    from kerbside.sources import feeds
    tree = '{"tree_id":"%d","spc_latin":"Acer rubrum","status":"Alive","tree_dbh":"3","latitude":"40.7","longitude":"-74.0"}'
    texts = [tree % 1, "[" + tree % 2 + "," + tree % 3 + "]", '{"data":[' + tree % 4 + "]}", "not json", "", '{"other":1}', "[]"]
    rows = spark.createDataFrame([(t,) for t in texts], "value string")
    assert sorted(r.tree_id for r in feeds.parse_trees(rows).collect()) == [1, 2, 3, 4]
    told = {r.value: r.reason for r in feeds.rejects(rows, feeds.TREE_FIELDS).collect()}
    assert told == {"not json": "not JSON records", "": "empty", '{"other":1}': "none of the fields"}


def test_recent_readings_open_the_days_concerned_and_distrust_the_future(spark, tmp_path):
    from datetime import datetime
    path, schema = str(tmp_path / "readings"), "hazard string, station_id string, observed_at timestamp, source string, value double, unit string"
    times = ["2024-01-01 10:00:00", "2024-01-05 10:00:00", "2024-01-06 09:00:00", "2024-01-06 12:00:00", "2030-01-01 00:00:00"]
    rows = [("pm25", f"s{i}", datetime.fromisoformat(t), "openaq", float(i), "u") for i, t in enumerate(times)]
    jobs.store_readings(spark.createDataFrame(rows, schema), path)
    stored, now = jobs.recent_readings(spark, path, datetime(2024, 1, 6, 12, 5))
    assert now == datetime(2024, 1, 6, 12, 0) and {r.station_id for r in stored.collect()} == {"s1", "s2", "s3"}
    assert not any("2024-01-01" in f or "2030" in f for f in stored.inputFiles())
    _, ahead = jobs.recent_readings(spark, path)
    assert ahead == datetime(2030, 1, 1)
    assert sinks.expire_versions(spark, path, 1.0) == []
    jobs.store_readings(spark.createDataFrame(rows, schema), path)
    assert len(sinks.expire_versions(spark, path, -1.0)) == 1 and sinks.read_partitions(spark, path).count() == 5


def test_a_reading_dated_a_year_ahead_changes_no_mean(spark, tmp_path):
    from datetime import datetime, timedelta

    from kerbside.streaming import jobs
    now = datetime(2024, 1, 30, 12, 0)
    rows = [("pm25", "a", now, "openaq", 1.0, "ug/m3"), ("pm25", "b", now - timedelta(hours=1), "openaq", 3.0, "ug/m3"),
            ("pm25", "c", now + timedelta(days=365), "openaq", 99.0, "ug/m3")]
    schema = "hazard string, station_id string, observed_at timestamp, source string, value double, unit string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    jobs.stream_citywide_means(stream, f"{tmp_path}/t", f"{tmp_path}/out", f"{tmp_path}/chk", {"availableNow": True}, lambda: now).awaitTermination()
    (row,) = sinks.read_table(spark, f"{tmp_path}/out").collect()
    assert (row["hazard"], row["value"]) == ("pm25", 2.0)
    assert sinks.read_partitions(spark, f"{tmp_path}/t").count() == 3
