import datetime as dt

from pyspark.sql import functions as F

from albumlake.functions import sky
from albumlake.operators import files, tagging


def test_sun_and_moon_at_known_hours(spark):
    rows = [("2024-03-20 12:07:00", 0.0, 0.0), ("2024-06-20 12:00:00", 51.48, 0.0), ("2024-12-21 00:00:00", 51.48, 0.0), ("2024-04-08 18:17:00", 25.3, -104.1)]
    df = spark.createDataFrame(rows, "t string, lat double, lon double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    at = [f(F.col("t"), F.col("lat"), F.col("lon")) for f in (sky.sun_position, sky.moon_position)]
    noon, summer, midnight, eclipse = df.select(*[c.alias(n) for c, n in zip(at[0] + at[1], ("az", "alt", "moon_az", "moon_alt"), strict=True)], sky.twilight(at[0][1]).alias("light")).collect()
    assert noon.alt > 89.5 and noon.light == "Daylight"  # equinox over the equator
    assert abs(summer.alt - (90 - 51.48 + 23.44)) < 0.2 and abs(summer.az - 180) < 2
    assert midnight.light == "Night" and abs(midnight.alt + 61.96) < 0.3
    assert abs(eclipse.alt - eclipse.moon_alt) < 1.5 and abs(eclipse.az - eclipse.moon_az) < 5  # a solar eclipse


REGION = "file_id long, idx int, label string, category string, status string, x double, y double, w double, h double"


def test_one_owner_of_a_name(spark):
    r = spark.createDataFrame([(1, 0, "Tim", "Person", "Accepted", .1, .1, .2, .2), (1, 1, None, "Person", "Accepted", .5, .5, .2, .2), (1, 2, "tim", "Animal", "Accepted", .7, .7, .1, .1),
                               (2, 0, "Tim", "Person", "Accepted", .1, .1, .2, .2)], REGION)
    c = spark.createDataFrame([(1, 1, "TIM"), (2, 5, "Tim"), (9, 0, "x")], "file_id long, idx int, label string")
    want = {(1, 0): None, (1, 1): "TIM", (1, 2): "tim", (2, 0): "Tim"}
    for fn in (tagging.region_relabel, tagging.tag_face):
        assert {(x.file_id, x.idx): x.label for x in fn(r, c).collect()} == want
    assert {x.file_id for x in tagging.command_errors(r, c).collect()} == {2, 9}
    assert tagging.region_relabel(r, c).columns == r.columns


def test_names_are_claimed_once_a_photo(spark):
    r = spark.createDataFrame([(1, 0, "Ann", "Person", "Accepted", .1, .1, .2, .2)], REGION)
    m = spark.createDataFrame([(1, 5, "ann", .99), (1, 6, "Bob", .7), (1, 7, "bob", .8), (2, 0, "Ann", .7)], "file_id long, idx int, name string, similarity double")
    assert {tuple(x) for x in tagging.face_assign_names(r, m).collect()} == {(1, 7, "bob"), (2, 0, "Ann")}


def test_iptc_dates(spark):
    df = spark.createDataFrame([("20240229", "101112+0200"), ("20240229", None), ("20230229", None), (" ", "101112"), (None, None)], "d string, t string")
    got = [x[0] for x in df.select(tagging.iptc_date(F.col("d"), F.col("t"))).collect()]
    assert got == [dt.datetime(2024, 2, 29, 10, 11, 12), dt.datetime(2024, 2, 29), None, None, None]


def test_kmeans_finds_far_places_and_keeps_few_apart(spark):
    rows = [(i, 10.0 * (i % 3) + i / 1000, 50.0 * (i % 3)) for i in range(60)]
    df = spark.createDataFrame([*rows, (99, 95.0, 0.0), (100, None, 0.0)], "file_id long, lat double, lon double")
    got = {x.file_id: x.cluster for x in files.geo_kmeans(df, 3).collect()}
    assert set(got) == set(range(60)) and len({(i % 3, c) for i, c in got.items()}) == 3
    assert len({x.cluster for x in files.geo_kmeans(df.filter("file_id < 5"), 8).collect()}) == 5


def test_scan_takes_extensions_in_any_case(spark, tmp_path):
    for name in ("a.JPG", "b.txt", "sub/c.jpg", "noext"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"xyz")
    assert {(x.name, x.length) for x in files.scan_files(spark, str(tmp_path), [".jpg"]).collect()} == {("a.JPG", 3), ("c.jpg", 3)}
    assert {x.name for x in files.scan_files(spark, str(tmp_path), ["jpg"], recursive=False).collect()} == {"a.JPG"}


def test_appended_regions_are_sorted_by_more_tasks_when_there_are_more(spark, monkeypatch):
    monkeypatch.setattr(tagging, "ROWS_A_TASK", 10)
    rows = [(f, i, "a", "Person", "Accepted", i / 10, 0.0, 0.1, 0.1) for f in range(40) for i in range(3)]
    df = spark.createDataFrame(rows, "file_id long, idx int, label string, category string, status string, x double, y double, w double, h double")
    made = tagging.region_append(df, df.filter("idx = 1").withColumn("x", F.col("x") + F.col("file_id") % 2))
    assert made.rdd.getNumPartitions() == 16
    assert {(x.file_id, x.idx) for x in made.collect()} == {(f, i) for f in range(40) for i in range(3 + f % 2)}
