"""Import plans, numbering, dates in names, capture dates, renames, hash pairs and keyword trees on small tables."""

import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from albumlake.operators import faces, library, naming, ordered, places

IN, DISK = "file_id long, dir string, base string, ext string, name string, sha string", "dir string, base string, ext string, n long, sha string"


def plan(spark, incoming, disk, handling="Smart", **more):
    a = spark.createDataFrame([(i, "d", base, ".jpg", f"n{i}", sha) for i, base, sha in incoming], IN)
    b = spark.createDataFrame([("d", base, ".jpg", n, sha) for base, n, sha in disk], DISK)
    return {r.file_id: (r.final, r.outcome) for r in ordered.import_plan(a, b, handling, **more).collect()}


def test_smart_compares_with_the_holder_of_the_plain_name(spark):
    assert plan(spark, [(1, "A", "x")], [("A", 0, "s0"), ("A", 2, "x")]) == {1: ("d/A (3).jpg", "renamed")}
    assert plan(spark, [(1, "A", "x"), (2, "A", "x"), (3, "A", "y")], []) == {1: ("d/A.jpg", "imported"), 2: ("d/A.jpg", "skipped"), 3: ("d/A (2).jpg", "renamed")}
    assert plan(spark, [(1, "A", "s0")], [("A", 0, "s0")], preserve=False) == {1: ("d/A.jpg", "removed")}
    assert plan(spark, [(1, "A", "x")], [("A", 2, "x")]) == {1: ("d/A.jpg", "imported")}
    assert plan(spark, [(1, "A", "s0"), (2, "A", "q")], [("A", 0, "s0"), ("A", 3, "z")], "Rename") == {1: ("d/A (2).jpg", "renamed"), 2: ("d/A (4).jpg", "renamed")}
    for handling, says in (("Skip", "skipped"), ("Overwrite", "overwritten")):
        assert plan(spark, [(1, "A", "x"), (2, "A", "y")], [], handling) == {1: ("d/A.jpg", "imported"), 2: ("d/A.jpg", says)}
    with pytest.raises(ValueError):
        plan(spark, [], [], "Ask")


def test_preview_looks_at_the_disk_only(spark):
    a = spark.createDataFrame([(1, "d", "A", ".jpg", "n1", "x"), (2, "d", "A", ".jpg", "n2", "s"), (3, "d", "B", ".jpg", "n3", "x"), (4, "d", "B", ".jpg", "n4", "x")], IN)
    b = spark.createDataFrame([("d", "A", ".jpg", 0, "s"), ("d", "B", ".jpg", 2, "x")], DISK)
    assert [r.preview for r in ordered.import_preview(a, b).orderBy("file_id").collect()] == ["resolve conflict", "skip identical", "import", "import"]


def test_numbers_skip_what_is_taken(spark):
    r = np.random.default_rng(9)
    files = [(i, "d", f"B{i % 3}", ".x", f"n{int(r.integers(100))}") for i in range(90)]
    taken = [("d", f"B{k}", ".x", n) for k in (0, 1) for n in sorted({int(x) for x in r.integers(0, 40, 25)})] + [("d", "B9", ".x", 0)]
    a = spark.createDataFrame(files, "file_id long, dir string, base string, ext string, name string")
    b = spark.createDataFrame(taken + taken[:4], "dir string, base string, ext string, n long")
    want = {}
    for k in range(3):
        free = (n for n in itertools.count(1) if n not in {max(t[3], 1) for t in taken if t[1] == f"B{k}"})
        for f in sorted((f for f in files if f[2] == f"B{k}"), key=lambda f: (f[4], f[0])):
            n = next(free)
            want[f[0]] = f"d/B{k}{f' ({n})' if n > 1 else ''}.x"
    assert {x.file_id: x.final for x in ordered.collision_suffix(a, b).collect()} == want


def stamps(spark, rows):
    return spark.createDataFrame(rows, "file_id long, ts string, source string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_a_stale_satellite_date_gives_way(spark):
    rows = [(1, "2020-01-01 10:00:00", "Gps"), (1, "2020-01-01 10:30:00", "SubIfd"), (2, "2020-01-01 10:00:00", "Gps"), (2, "2020-01-01 11:00:01", "SubIfd"), (3, "2020-01-01 10:00:00", "Gps"), (3, "2020-01-01 09:59:00", "SubIfd"),
            (4, "2020-01-01 10:00:00", "Gps"), (4, "2020-01-01 11:00:00", "SubIfd"), (5, "1980-01-01 00:00:00", "Gps"), (5, "2001-01-01 00:00:00", "Created"), (6, "1970-01-01 00:00:00", "Ifd0")]
    got = {r.file_id: (str(r.captured), r.source) for r in ordered.best_capture_date(stamps(spark, rows)).collect()}
    assert got == {1: ("2020-01-01 10:30:00", "SubIfd"), 2: ("2020-01-01 10:00:00", "Gps"), 3: ("2020-01-01 10:00:00", "Gps"), 4: ("2020-01-01 11:00:00", "SubIfd"), 5: ("2001-01-01 00:00:00", "Created")}


def test_layouts_of_names(spark):
    day = dt.datetime(2015, 6, 7, 8, 9, 10)
    names = ["IMG_20240229_101112.jpg", "31-12-98 x", "scan 1999_01_02 030405", "none", "20230229", "49-05-06", "50-05-06", None]
    df = spark.createDataFrame([(i, n, day, day + dt.timedelta(days=1)) for i, n in enumerate(names)], "file_id long, name string, created timestamp_ntz, modified timestamp_ntz")
    got = {}
    for r in naming.filename_dates(df).collect():
        got.setdefault(r.file_id, {})[r.layout] = str(r.named)
    assert got[0]["yyyyMMdd_HHmmss"] == "2024-02-29 10:11:12" and got[0]["yyyyMMdd"] == "2024-02-29 08:09:10"
    assert got[1]["dd-MM-yy"] == "1998-12-31 08:09:10" and "yy-MM-dd" not in got[1]
    assert got[2]["yyyy_MM_dd"] == "1999-01-02 08:09:10" and 3 not in got and 7 not in got
    assert "yyyyMMdd" not in got.get(4, {})  # no such day
    assert got[5]["yy-MM-dd"].startswith("2049-05-06") and got[6]["yy-MM-dd"].startswith("1950-05-06")
    dates = [("1985-01-01", "2001-01-01"), ("2003-01-01", "2001-01-01"), ("2001-01-01", "1985-01-01"), ("1985-01-01", "1984-01-01")]
    d = spark.createDataFrame(dates, "c string, m string").select(naming.default_date(F.col("c").cast("timestamp_ntz"), F.col("m").cast("timestamp_ntz")).alias("d"))
    assert [str(r.d)[:4] for r in d.collect()] == ["2001", "2001", "2001", "1984"]


def test_tokens_with_formats(spark):
    df = spark.createDataFrame([(1, "d", "a/b.jpg", None, None, None)], "file_id long, dir string, name string, rating int, color_label string, city string").withColumn("captured", F.lit("2020-02-03 04:05:06").cast("timestamp_ntz"))
    name = lambda t: ordered.rename_plan(df, t).first().new_name
    assert name("{date}_{TIME}_{index:00}_{total}_{City}{Nope:x}{open") == "2020-02-03_040506_01_1_{Nope_x}{open.jpg"
    assert name("{date:dd.MM.yy}") == "03.02.20.jpg"
    for bad in ("{date:QQ}", "{index:#}"):
        with pytest.raises(ValueError):
            name(bad)


@pytest.mark.parametrize("hot", [1000, 1])
def test_hash_pairs_equal_all_pairs(spark, hot):
    r = np.random.default_rng(6)
    base = [int(x) for x in r.integers(-(2**63), 2**63 - 1, 12)]
    rows = []
    for i in range(160):
        h = base[i % 12]
        for bit in r.integers(0, 64, int(r.integers(0, 6))):
            h ^= (1 << int(bit)) if bit < 63 else -(2**63)
        rows.append((i, h))
    rows += [(500, rows[0][1]), (501, 0), (502, 1 << 5), (503, None)]
    df = spark.createDataFrame(rows, "file_id long, hash long")
    reps = {}
    for i, h in rows:
        if h is not None:
            reps.setdefault(h, i)
    for threshold in (0, 3, 6):
        want = {(a, b, bin((x ^ y) & (2**64 - 1)).count("1")) for (x, a), (y, b) in itertools.product(reps.items(), reps.items()) if a < b and bin((x ^ y) & (2**64 - 1)).count("1") <= threshold}
        got = [tuple(p) for p in places.hash_pairs_within(df, threshold, hot).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert {x.file_id: x.rep for x in places.hash_members(df).collect()} == {i: reps[h] for i, h in rows if h is not None}
    led = {x.file_id: x.leader for x in faces.near_duplicate_files(places.hash_pairs_within(df, 3), places.hash_members(df)).collect()}
    assert led[500] == led.get(0, 0)


def test_a_coordinate_is_rounded_once_scaled(spark):
    p = spark.createDataFrame([(1, 10.0, 127.94999999999999), (2, 10.0, 127.95), (3, -53.43000000000001, -127.94999999999999), (4, 64.84, 53.84)], "file_id long, lat double, lon double").withColumn("city", F.lit(None).cast("string"))
    g = spark.createDataFrame([(10.0, 128.0, "a"), (-53.4, -128.0, "b"), (64.8, 53.8, "c")], "lat4 double, lon4 double, place string")
    got = {x.file_id: x.city_after for x in places.reverse_geocode_join(p, g, places=1).collect()}
    assert got == {1: "a", 2: "a", 3: "b", 4: "c"}


@pytest.mark.parametrize("size", [7, 1 << 16])
def test_links_and_leaders_of_hashes_equal_a_scan(spark, monkeypatch, size):
    monkeypatch.setattr(places, "BLOCK", size)
    monkeypatch.setattr(places, "ROUND", size)
    r = np.random.default_rng(8)
    base = [int(x) for x in r.integers(-(2**63), 2**63 - 1, 6)]
    rows = []
    for i in range(90):
        h = base[i % 6]
        for bit in r.integers(0, 64, int(r.integers(0, 9))):
            h ^= (1 << int(bit)) if bit < 63 else -(2**63)
        rows.append((i, h))
    rows += [(200, rows[3][1]), (201, rows[40][1]), (202, None)]
    df = spark.createDataFrame(rows, "file_id long, hash long").repartition(3)
    apart = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1")
    reps = {}
    for i, h in rows:
        if h is not None:
            reps.setdefault(h, i)
    for threshold in (0, 6, 12):
        links = {h: sum(g != h and apart(g, h) <= threshold for g in reps) for h in reps}
        got = {(x.file_id, x.rep, x.links) for x in places.hash_links(df, threshold).collect()}
        assert got == {(i, reps[h], links[h]) for i, h in rows if h is not None}
        led, leader = [], {}
        for h, i in sorted(reps.items(), key=lambda x: x[1]):
            leader[h] = next((j for j, g in led if apart(g, h) <= threshold), i)
            if leader[h] == i:
                led.append((i, h))
        got = [(x.file_id, x.leader) for x in places.hash_leaders(df, threshold).collect()]
        assert sorted(got) == [(i, leader[h]) for i, h in rows if h is not None and leader[h] != i]


def test_pairs_of_hashes_and_copies_equal_a_scan(spark, monkeypatch):
    monkeypatch.setattr(places, "BLOCK", 11)
    monkeypatch.setattr(places, "PAIRS", 7)
    r = np.random.default_rng(12)
    rows = [(i, (3 - i % 6) << 40 ^ int(b)) for i, b in enumerate(r.integers(0, 1 << 14, 120))]
    rows += [(200, rows[3][1]), (201, rows[40][1]), (-5, rows[40][1]), (202, None), (203, -1), (204, -1)]
    df = spark.createDataFrame(rows, "file_id long, hash long").repartition(3)
    reps = {}
    for i, h in sorted(rows):
        if h is not None:
            reps.setdefault(h, i)
    for threshold in (0, 9):
        apart = [(a, b, bin((x ^ y) & (2**64 - 1)).count("1")) for (x, a), (y, b) in itertools.product(reps.items(), reps.items()) if a < b]
        want = [p for p in apart if p[2] <= threshold] + [(reps[h], i, 0) for i, h in rows if h is not None and reps[h] != i]
        assert sorted(tuple(x) for x in places.hash_pairs(df, threshold).collect()) == sorted(want)


def test_hash_pairs_query_lists_the_pairs(spark):
    data = "/root/testdata/sf0.001"
    hashes = sorted((x.file_id, x.hash) for x in entry.queries()["perceptual_hash"](spark, data).collect() if x.hash is not None)
    got = {(x.a, x.b): x.distance for x in entry.queries()["hash_pairs_within"](spark, data).collect()}
    apart = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1")
    first = {h: i for i, h in reversed(hashes)}
    near = {(i, j): apart(g, h) for (i, g), (j, h) in itertools.combinations(hashes, 2) if apart(g, h) <= 12 and (g == h and first[g] == i or g != h and first[g] == i and first[h] == j)}
    assert got == near and any(near.values())


def test_deep_trees_and_circles(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None, f"k{i}") for i in range(70)] + [(100, 999, "lost")], "node_id long, parent_id long, name string")
    got = {r.node_id: r.path for r in naming.keyword_paths(chain).collect()}
    assert set(got) == set(range(70)) and got[69] == [f"k{i}" for i in range(70)]
    with pytest.raises(ValueError):
        naming.keyword_paths(spark.createDataFrame([(1, 2, "a"), (2, 1, "b"), (3, None, "c")], "node_id long, parent_id long, name string"))


def test_keywords_expand_once_a_list_and_the_result_does_not_move(spark):
    """Names over words in any case, rows of one file, blanks and nulls; the rows of the result are made without a shuffle."""
    tree = [(1, None, "Trips"), (2, 1, "Sea"), (3, 2, "beach"), (4, None, "Sand"), (5, 4, "Beach"), (6, 5, "Cove")]
    photos = [(1, ["beach", " Other ", None, ""]), (1, ["OTHER", "sea"]), (2, ["Beach", "beach"]), (3, None), (4, [" "]), (5, ["k0", "k1", "k11"]), (None, ["Cove"]), (6, ["other", "Other"]), (7, ["beach", " Other ", "OTHER", "sea"])]
    paths = naming.keyword_paths(spark.createDataFrame(tree, "node_id long, parent_id long, name string"))
    out = naming.keyword_expand(spark.createDataFrame(photos, "file_id long, keywords array<string>"), paths)
    beach, want = ["Beach", "Sand", "Sea", "Trips"], {6: ["Other"], 5: ["k0", "k1", "k11"]}
    want |= {1: ["Beach", "OTHER", "Sand", "Sea", "Trips"], 2: beach, None: ["Beach", "Cove", "Sand"]}
    want[7] = want[1]
    assert sorted(map(str, out.collect())) == sorted(str(x) for f, names in want.items() for x in spark.createDataFrame([(f, n) for n in names], "file_id long, keyword string").collect())
    assert "Exchange hash" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_person_is_shown_or_a_region(spark):
    p = spark.createDataFrame([(1, ["Ann"]), (2, None), (3, ["x"])], "file_id long, persons_shown array<string>")
    r = spark.createDataFrame([(2, "Person", "Joann"), (3, "Animal", "Ann"), (1, "Person", None)], "file_id long, category string, label string")
    ids = lambda **k: {x.file_id for x in library.smart_album(p, [{"type": "person", "value": "ann"}], **k).collect()}
    assert ids() == {1} and ids(regions=r) == {1, 2}


def test_altitude_between_points(spark):
    at = lambda s: dt.datetime(2024, 1, 1, 12, 0, s)
    p = spark.createDataFrame([(1, 1, at(5)), (2, 2, at(5)), (3, 3, at(5)), (4, 4, at(3))], "u long, file_id long, captured timestamp_ntz")
    g = spark.createDataFrame([(1, at(0), 0.0, 0.0, 100.0), (1, at(10), 1.0, 2.0, 200.0), (2, at(0), 0.0, 0.0, None), (2, at(10), 1.0, 1.0, 7.0), (3, at(0), 5.0, 5.0, 9.0), (4, at(8), 5.0, 5.0, None)], "u long, captured timestamp_ntz, lat double, lon double, ele double")
    got = {r.file_id: (r.lat, r.altitude, r.how) for r in places.gpx_asof_match(p, g, ["u"]).collect()}
    assert got == {1: (0.5, 150.0, "between"), 2: (0.5, 7.0, "between"), 3: (5.0, 9.0, "before"), 4: (5.0, None, "after")}
    assert places.gpx_asof_match(p, g.drop("ele"), ["u"]).filter("altitude is not null").count() == 0


def test_on_this_trips_equals_all_pairs_and_holds_no_side_whole(spark, tmp_path):
    rnd = np.random.default_rng(11)
    start = dt.datetime(2024, 1, 1)
    spots = [(90.0, 0.0), (90.0, 77.0), (-90.0, 5.0), (89.99, 180.0), (89.99, -180.0), (0.0, 180.0), (0.0, -180.0), (0.0, 179.99), (45.0, -179.9), (85.0, 10.0), (-85.0, -170.0), (0.0, 0.0), (0.0, 0.0)]
    spots += [(float(a), float(b)) for a, b in zip(rnd.uniform(-90, 90, 220), rnd.uniform(-180, 180, 220), strict=True)]
    spots += [(float(np.clip(a + d, -90, 90)), float(b)) for (a, b), d in zip(spots[:120], rnd.normal(0, 0.02, 120), strict=True)]
    spots += [(float(s * a), float(b)) for s, a, b in zip(rnd.choice([-1, 1], 80), rnd.uniform(80, 90, 80), rnd.uniform(-180, 180, 80), strict=True)]
    seconds = [int(x) for x in rnd.integers(0, 6 * 86400, len(spots))]
    seconds[:13] = [3 * 86400 * (i % 3) for i in range(13)]
    rows = [(i, a, b, start + dt.timedelta(seconds=s)) for i, ((a, b), s) in enumerate(zip(spots, seconds, strict=True))]
    df = spark.createDataFrame([*rows, (-1, 91.0, 0.0, start), (-2, None, 0.0, start), (-3, 0.0, 0.0, None)], "file_id long, lat double, lon double, captured timestamp_ntz")
    df.write.parquet(str(tmp_path / "photos"))
    df = spark.read.parquet(str(tmp_path / "photos"))
    anchors = df.withColumnRenamed("file_id", "anchor_id")
    plan = places.on_this_trips(df, anchors, 900.0, 3.0)._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    lat, lon, s = np.radians([r[1] for r in rows]), np.radians([r[2] for r in rows]), np.array(seconds, float)
    h = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat[:, None]) * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
    metres, apart = 2 * 6_371_008.8 * np.arcsin(np.sqrt(np.minimum(h, 1))), np.abs(s[:, None] - s)
    for km, days in ((900.0, 3.0), (0.5, 0.5), (3.0, 2.0), (5000.0, 1.0), (9990.0, 1.0), (12000.0, 1.0), (30000.0, 0.2), (0.0, 6.0)):
        got = places.on_this_trips(df, anchors, km, days)
        want = {(i, j) for i, j in np.argwhere((metres <= km * 1000) & (apart <= days * 86400) & ((metres >= 1) | (apart >= 1))).tolist()}
        pairs = [(r["anchor_id"], r["file_id"]) for r in got.select("anchor_id", "file_id").collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == want, (km, days)
