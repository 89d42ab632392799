"""Vector joins, pixels, resection, merged faces, sidecar regions and stateful streams against brute force."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from albumlake.operators import faces, images, resection, vectors
from albumlake.plans import vision
from albumlake.sources import rasters, readers
from albumlake.streaming import jobs


def cosine(a, b):
    a, b = np.array(a, float), np.array(b, float)
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / n) if n > 1e-12 else 0.0


def groups_of(rows, least):
    up = {i: i for i, v in rows if v}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, v in rows:
        for j, w in rows:
            if i < j and v and w and len(v) == len(w) and (v == w or cosine(v, w) >= least):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in up}


def some_vectors():
    r = np.random.default_rng(5)
    centres = r.normal(size=(9, 12))
    v = [(centres[i % 9] + r.normal(size=12) * (0.05 if i % 3 else 0.5)).round(3).tolist() for i in range(220)]
    v += [v[0]] * 30 + [v[1]] * 5 + [[0.0] * 12] * 2 + [r.normal(size=5).round(2).tolist() for _ in range(20)] + [None, []]
    return list(enumerate(v, 100))


@pytest.mark.parametrize("least,pivots,slice_", [(0.0, 64, 4096), (0.55, 64, 4096), (0.55, 3, 7), (0.9, 5, 10), (0.99, 64, 16), (1.0, 4, 9)])
def test_links_have_the_components_of_all_pairs(spark, monkeypatch, least, pivots, slice_):
    monkeypatch.setattr(vectors, "PIVOTS", pivots)
    monkeypatch.setattr(vectors, "SLICE", slice_)
    monkeypatch.setattr(vectors, "LANE", 60)
    rows = some_vectors()
    df = spark.createDataFrame(rows, "face_id long, embedding array<double>")
    edges = vectors.links(df, "face_id", "embedding", least)
    got = {x.id: x.component for x in vectors.components(edges).collect()}
    want = groups_of(rows, least)
    assert {i: got.get(i, i) for i in want} == want and set(got) <= set(want)
    assert edges.count() < 30 * len(rows)


@pytest.mark.parametrize("pivots,slice_", [(64, 4096), (3, 11)])
def test_nearest_equals_all_pairs(spark, monkeypatch, pivots, slice_):
    monkeypatch.setattr(vectors, "PIVOTS", pivots)
    monkeypatch.setattr(vectors, "SLICE", slice_)
    rows = some_vectors()
    q = spark.createDataFrame(rows, "file_id long, v array<double>")
    words = [(f"w{i}", v) for i, v in rows if i % 3 == 0]
    w = spark.createDataFrame(words, "word string, v array<double>")
    for least, top, strict in ((0.5, 3, False), (-1.0, 1, True), (0.97, 0, False)):
        want = {}
        for i, v in rows:
            near = sorted((-round(cosine(v, x), 9), n) for n, x in words if v and x and len(v) == len(x) and (cosine(v, x) > least if strict else cosine(v, x) >= least - 1e-12))
            want |= {(i, k): s for k, (s, _) in enumerate(near[:top] if top else near, 1)}
        got = {(x.file_id, x.rank): -round(x.similarity, 9) for x in vectors.nearest(q, w, ("file_id", "v"), ("word", "v"), least, top, strict).collect()}
        assert got == want
    others = vectors.nearest(q, q.withColumnRenamed("file_id", "o"), ("file_id", "v"), ("o", "v"), 0.5, 2, others=True).collect()
    assert others and all(x.file_id != x.o for x in others)


def test_numbers_and_components_of_chains(spark):
    df = spark.createDataFrame([(i, f"n{999 - i}") for i in range(1000)], "id long, name string").repartition(5)
    assert [x.k for x in vectors.numbered(df, ["name"], "k", 7).orderBy("name").collect()] == list(range(7, 1007))
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 300)] + [(500, 501), (501, 502), (7, 7)], "a long, b long")
    assert {x.id: x.component for x in vectors.components(chain).collect()} == {i: 1 for i in range(1, 301)} | {500: 500, 501: 500, 502: 500}


def test_face_clusters(spark):
    rows = [(1, "bob", None), (2, " ", [1.0, 0.0]), (3, None, [0.99, 0.1]), (4, "Ann", [1.0, 0.0]), (5, None, None), (6, None, [0.0, 1.0]), (7, "BOB", None), (8, None, [])]
    df = spark.createDataFrame(rows, "face_id long, name string, embedding array<double>")
    assert {x.face_id: x.cluster_id for x in faces.face_clusters_embedding(df).collect()} == {4: 1, 1: 2, 7: 2, 2: 3, 3: 3, 6: 4, 5: 5, 8: 6}
    assert {x.face_id: x.cluster_id for x in faces.face_groups_by_name(df, False).collect()} == {i: i for i in range(1, 9)}
    for bad in (-0.1, 1.1):
        with pytest.raises(ValueError):
            faces.face_clusters_embedding(df, bad)
    assert faces.face_clusters_embedding(df.limit(0)).count() == 0


PICTURE = "file_id long, width long, height long, pixels array<int>"


def pictures(spark):
    r = np.random.default_rng(3)
    rows = [(i, w, h, r.integers(0, 1 << 24, w * h).tolist()) for i, (w, h) in enumerate([(32, 32), (33, 70), (5, 400), (300, 280), (2, 9), (3, 3), (1, 1)])]
    return rows + [(20, 0, 0, []), (21, 40, 40, [0] * 1600), (22, 40, 40, [0xFFFFFF] * 1600), (22, 40, 40, [0x204060] * 1600), (23, 0, 0, None)]


def test_hash_equals_a_slow_transform(spark):
    def slow(w, h, p):
        lum = [(77 * (x >> 16) + 150 * (x >> 8 & 255) + 29 * (x & 255)) >> 8 for x in p]
        g = [[0] * 32 for _ in range(32)]
        for cy in range(32):
            for cx in range(32):
                ys, xs = (range(c * n // 32, max(c * n // 32 + 1, (c + 1) * n // 32)) for c, n in ((cy, h), (cx, w)))
                cell = [lum[y * w + x] for y in ys for x in xs]
                g[cy][cx] = math.floor(sum(cell) / len(cell) + 0.5)
        c = [round(sum(g[y][x] * math.cos(math.pi * (2 * x + 1) * u / 64) * math.cos(math.pi * (2 * y + 1) * v / 64) for y in range(32) for x in range(32)), 6) for v in range(8) for u in range(8)]
        rest = sorted(c[1:])
        bits = sum(1 << i for i, x in enumerate(c) if x >= (rest[30] + rest[31]) / 2)
        return bits - (1 << 64) if bits >> 63 else bits

    rows = [r for r in pictures(spark) if r[0] < 22]
    got = {x.file_id: x.hash for x in images.perceptual_hash(spark.createDataFrame(rows, PICTURE)).collect()}
    assert got == {i: slow(w, h, p) if p else None for i, w, h, p in rows}


def test_flags_and_scores_of_odd_images(spark):
    df = spark.createDataFrame(pictures(spark), PICTURE)
    flags = {(x.file_id, x.overexposed, x.underexposed): x for x in images.quality_flags(df).collect()}
    assert len(images.quality_flags(df).collect()) == len(pictures(spark))
    small = [x for x in flags.values() if x.file_id in (4, 6, 20, 23)]
    assert len(small) == 4 and not any(x.blurry or x.overexposed or x.underexposed or x.sharpness for x in small)
    assert (21, False, True) in flags and (22, True, False) in flags and (22, False, False) in flags
    i, w, h, p = pictures(spark)[1]
    lum = np.array([(77 * (x >> 16) + 150 * (x >> 8 & 255) + 29 * (x & 255)) >> 8 for x in p]).reshape(h, w)
    lap = lum[:-2, 1:-1] + lum[2:, 1:-1] + lum[1:-1, :-2] + lum[1:-1, 2:] - 4 * lum[1:-1, 1:-1]
    assert abs(next(x for x in flags.values() if x.file_id == i).sharpness - lap.var()) < 1e-6
    scores = {x.file_id: x for x in images.issue_scores(df.filter("file_id <> 22")).collect()}
    assert (scores[21].low_light, scores[21].noise, scores[21].haze, scores[21].low_resolution) == (1, 0, 0, 1) and scores[0].noise == 1 and scores[20].low_light == 1
    balance = {x.file_id: x for x in images.white_balance_estimate(df.filter("file_id <> 22 or pixels[0] = 2113632")).collect()}
    assert balance[20].temperature == balance[21].tint == 0 and balance[22].temperature == 50.0 and balance[22].tint == 0


def test_packed_pixels_of_rasters(spark):
    rows = [(1, bytearray([5, 250])), (3, bytearray([1, 2, 3, 255, 0, 128])), (4, bytearray([1, 2, 3, 9, 200, 100, 50, 9])), (3, bytearray()), (3, None)]
    df = spark.createDataFrame(rows, "n int, data binary")
    got = [x[0] for x in df.select(images.packed(F.col("data"), F.col("n"))).collect()]
    assert got[:4] == [[0x050505, 0xFAFAFA], [0x030201, 0x8000FF], [0x030201, 0x3264C8], []] and not got[4]


def test_decode_ties_and_clamping(spark):
    values = [10.0, 300.0, 10.0, 300.0, 8.0, 900.0, 8.0, 900.0, 0.5, 0.2, 0.5, 0.1]  # two cells; classes 0 and 1
    df = spark.createDataFrame([(1, values, 0.5, 4.0, 0.0, 100, 80), (2, values[:8], 0.5, 4.0, 0.0, 100, 80)], "file_id long, values array<double>, scale double, pad_x double, pad_y double, full_width int, full_height int")
    got = {x.cell: x for x in images.detection_decode(df, 2, 0.2).collect()}
    a = got[0]
    assert (a["class"], a.left, a.top, a.box_width, a.box_height) == (0, 4.0, 12.0, 16.0, 16.0)  # of equal scores the lower class
    assert got[1]["class"] == 0 and got[1].box_width <= 100 and got[1].left >= 0


def test_resection_of_a_known_camera(spark):
    lat0, lon0, heading, width, fov = 47.0, 8.5, 350.0, 4000.0, 60.0
    marks = [(-25.0, 800.0), (3.0, 1500.0), (22.0, 600.0), (10.0, 900.0)]
    rows = []
    for k, (turn, far) in enumerate(marks):
        t = math.radians(heading + turn)
        rows.append((1, k, lat0 + far * math.cos(t) / resection.M_PER_DEG, lon0 + far * math.sin(t) / resection.M_PER_DEG / math.cos(math.radians(lat0)), (turn / fov + 0.5) * width))
    rows += [(2, k, *rows[k][2:]) for k in (0, 1)] + [(3, k, rows[k][2], rows[k][3], 2000.0 + k) for k in range(3)] + [(4, k, rows[0][2], rows[0][3], 1000.0 * k) for k in range(3)]
    df = spark.createDataFrame(rows, "photo_id long, ord int, lat double, lon double, pixel_x double")
    got = {x.photo_id: x for x in resection.photo_resection(df, width, fov).collect()}
    assert abs(got[1].lat - lat0) < 1e-4 and abs(got[1].lon - lon0) < 1e-4 and abs(got[1].heading - heading) < 0.1 and got[1].rms < 1e-6
    assert [got[i].lat for i in (2, 3, 4)] == [None] * 3  # two landmarks, angles under half a degree, one place
    for bad in ((0, 60), (100, 180), (100, 0)):
        with pytest.raises(ValueError):
            resection.photo_resection(df, *bad)


def test_a_face_merges_into_one_appended_before(spark):
    r = spark.createDataFrame([(1, 0, "Ann", "Animal", "Accepted", 0.1, 0.1, 0.2, 0.2, None), (2, 4, None, "Person", "Accepted", 0.1, 0.1, 0.2, 0.2, None)],
                              "file_id long, idx int, label string, category string, status string, x double, y double, w double, h double, embedding array<double>")
    d = [(1, 0, None, 0.1, 0.1, 0.2, 0.2, None), (1, 1, "Eve", 0.11, 0.1, 0.2, 0.2, [1.0]), (1, 2, "Tim", 0.12, 0.1, 0.2, 0.2, [2.0]), (2, 0, "Bob", 0.1, 0.1, 0.2, 0.2, [3.0]), (3, 0, "New", 0.5, 0.5, 0.1, 0.1, None)]
    d = spark.createDataFrame(d, "file_id long, ord int, label string, x double, y double, w double, h double, embedding array<double>")
    got = {(x.file_id, x.idx): (x.label, x.category, x.status, x.embedding) for x in faces.merge_detected_faces(r, d).collect()}
    assert got == {(1, 0): ("Ann", "Animal", "Accepted", None), (1, 1): ("Eve", "Person", "Proposed", [1.0]), (2, 4): ("Bob", "Person", "Accepted", [3.0]), (3, 0): ("New", "Person", "Proposed", None)}


def test_sidecars_that_do_not_fit(spark):
    li = '<li><Area x="0.5" y="0.5" w="0.2" h="0.4"/><Type>Face</Type><embedding>AACAPw==</embedding></li><li><Area x="0.5" y="0.5" w="0.2"/></li><li><Area x="0.1" y="0.1" w="0" h="0"/><embedding>@@</embedding><category>PLACE</category><status>proposed</status></li>'
    xml = f"<x><RDF><Description><Regions><RegionList><Bag>{li}</Bag></RegionList></Regions></Description></RDF></x>"
    rows = [(1, xml), (2, None), (3, ""), (4, "<x"), (5, "<!doctype x>" + xml), (6, "<x/>"), (7, "<x><RDF><Description/></RDF></x>")]
    got = readers.sidecar_regions(spark.createDataFrame(rows, "path long, xml string")).collect()
    assert [(x.path, x.idx, round(x.x, 6), round(x.y, 6), x.category, x.status, x.embedding) for x in got] == [(1, 0, 0.4, 0.3, "Person", "Accepted", [1.0]), (1, 1, 0.1, 0.1, "Place", "Proposed", None)]
    texts = spark.createDataFrame([("1/4",), (" -3/2 ",), ("2.5",), ("1/0",), ("a/b",), (None,)], "t string")
    assert [x[0] for x in texts.select(readers.rational(F.col("t"))).collect()] == [0.25, -1.5, 2.5, None, None, None]


def test_a_declaration_is_found_without_a_change_of_case(spark):
    """In any case, on any line; only embeddings are encoded, not all regions."""
    rows = spark.createDataFrame([("<!DOCTYPE x><x/>",), ("<x/>\n<!DocType y>",), ("<x>doctype ß ı</x>",), ("",), (None,)], "t string")
    out = rows.select(readers.undeclared(F.col("t")).alias("t"))
    assert [r.t for r in out.collect()] == [None, None, "<x>doctype ß ı</x>", "", None]
    plan = vision._sidecars(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("ArrowEvalPython"):]
    assert "Join" in plan[: plan.index("ArrowEvalPython")] and "events.parquet" not in below and "event_id" not in below and "upper" not in plan


def test_retries_over_batches_and_a_restart(spark, tmp_path):
    def arrive(name, rows):
        spark.createDataFrame(rows, "path long, field string, seq long, failed boolean").coalesce(1).write.parquet(f"{tmp_path}/new-{name}")
        for f in os.listdir(f"{tmp_path}/new-{name}"):
            if f.endswith(".parquet"):
                os.makedirs(f"{tmp_path}/in", exist_ok=True)
                os.rename(f"{tmp_path}/new-{name}/{f}", f"{tmp_path}/in/{name}.parquet")

    def run():
        return {(x.path, x.field): (x.attempts, x.state) for x in jobs.stream_edit_retry(spark, f"{tmp_path}/in", lambda d: d, f"{tmp_path}/out", f"{tmp_path}/check", files=1).collect()}

    arrive("a", [(1, "t", s, True) for s in range(6)] + [(2, "t", 0, True), (3, "t", 0, True), (3, "t", 1, False)])
    arrive("b", [(1, "t", s, True) for s in range(6, 9)] + [(2, "t", 1, False), (2, "u", 0, True)])
    assert run() == {(1, "t"): (9, "pending"), (2, "u"): (1, "pending")}
    arrive("c", [(1, "t", 9, True), (2, "u", 2, True), (2, "u", 1, False), (3, "t", 2, True)])
    want = {(1, "t"): (10, "dead"), (2, "u"): (1, "pending"), (3, "t"): (1, "pending")}
    assert run() == want
    from albumlake.operators import tagging

    batch = tagging.edit_retry(spark.read.parquet(f"{tmp_path}/in"))
    assert {(x.path, x.field): (x.attempts, x.state) for x in batch.collect()} == want == run()


def test_burst_sessions_are_final_once(spark, tmp_path):
    def arrive(name, seconds):
        rows = [(1, s) for s in seconds]
        d = spark.createDataFrame(rows, "user_id long, s long").select("user_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("captured")).coalesce(1)
        d.write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        final = jobs.stream_bursts(spark, f"{tmp_path}/in", lambda d: d, "10 seconds", f"{tmp_path}/out", f"{tmp_path}/check", "60 seconds")
        rest = jobs.open_bursts(spark.read.parquet(f"{tmp_path}/in"), final, "10 seconds")
        return sorted(x.n for x in final.collect()), sorted(x.n for x in rest.collect())

    arrive("a", [0, 5, 14, 100, 300])
    assert run() == ([1, 3], [1])
    arrive("b", [305, 309, 500, 600])
    assert run() == ([1, 1, 3, 3], [1])


# Folds and rounds that SQL cannot check ------------------------------------------------------------------------------


def test_nms_equals_a_loop(spark):
    r = np.random.default_rng(1)
    rows = [(i % 3, i, "ab"[i % 2], *(r.random(2) * 0.3).tolist(), *(0.1 + r.random(2) * 0.2).tolist(), round(float(r.random()), 1)) for i in range(60)]
    df = spark.createDataFrame(rows, "file_id long, idx int, label string, x double, y double, w double, h double, score double")

    def over(p, q):
        w, h = (max(0.0, min(p[k] + p[k + 2], q[k] + q[k + 2]) - max(p[k], q[k])) for k in (3, 4))
        both = w * h
        return both / (p[5] * p[6] + q[5] * q[6] - both)

    kept = []
    for p in sorted(rows, key=lambda p: (-p[7], p[1])):
        if all(p[0] != q[0] or p[2] != q[2] or over(p, q) <= 0.3 for q in kept):
            kept.append(p)
    assert {(x.file_id, x.idx) for x in faces.nms(df, 0.3).collect()} == {(p[0], p[1]) for p in kept}


def test_leaders_equal_a_scan(spark):
    r = np.random.default_rng(2)
    links = {tuple(sorted(r.choice(80, 2, replace=False).tolist())) for _ in range(120)}
    near = lambda a, b: (min(a, b), max(a, b)) in links
    leader, done = {}, set()
    for a in range(80):
        if a in done:
            continue
        for b in range(a + 1, 80):
            if b not in done and near(a, b):
                leader[b] = a
                done.add(b)
    df = spark.createDataFrame(sorted(links), "a long, b long")
    assert {x.file_id: x.leader for x in faces.near_duplicate_groups(df).collect()} == leader


def test_bursts_equal_a_scan(spark):
    from albumlake.operators import ordered

    r = np.random.default_rng(4)
    rows = [(i, int(i % 2), f"{'IMG_' if r.random() < 0.8 else 'X'}{int(r.integers(1000, 1400))}.jpg", int(86380 + i // 2 + (5 if r.random() < 0.1 else 0))) for i in range(200)]
    df = spark.createDataFrame(rows, "file_id long, owner long, name string, s long").select("file_id", "owner", "name", F.timestamp_seconds("s").cast("timestamp_ntz").alias("captured"), F.lit(None).cast("timestamp_ntz").alias("mtime"))

    def distance(a, b):
        a, b = a.lower(), b.lower()
        same = 0
        while same < min(len(a), len(b)) and a[same] == b[same]:
            same += 1
        return max(len(a), len(b)) - same

    want = {}
    for owner in (0, 1):
        last = first = None
        for f in sorted((p for p in rows if p[1] == owner), key=lambda p: (p[3], p[2], p[0])):
            s = f[2].rsplit(".", 1)[0]
            if last is None or f[3] - last > 2 or distance(first[1], s) > 3:
                first = (f[0], s)
            last = f[3]
            want[f[0]] = first[0]
    assert {x.file_id: x.burst_first for x in ordered.burst_groups(df, ["owner"]).collect()} == want


def test_pixels_of_a_text(spark, tmp_path):
    from albumlake.sources import rasters

    texts = {0: "ab\u00e9\U0001f600" * 30, 1: "x", 2: "", 3: None, 5: "yz" * 50, 6: "\u4e2d" * 41, 7: "q" * 47}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.file_id: (x.width, x.height, x.pixels) for x in rasters.images(spark, str(tmp_path)).collect()}

    def pixel(i, at, o):
        v = ((o * 37 + at) % 256, 100 + o % 8, o % 128, 190 + o % 66)[i % 4]
        return v * 65793 if i % 12 < 4 else v * 65536 + (v * 3 // 4 + 20) * 256 + (v + 40) % 256

    for i, t in texts.items():
        w = 40 + i % 25
        h = -(-len(t or "") // w)
        made = [pixel(i, at, ord(c)) for at, c in enumerate(t or "")]
        assert got[i] == (w, h, made + [0] * (w * h - len(made)))


def test_pixels_never_move_and_equal_ids_are_added(spark):
    rows = [(1, 2, 1, [0x010203, 0x010203]), (2, 1, 1, [0xFFFFFF]), (1, 1, 2, [0x010203, 5]), (3, 0, 0, []), (4, 0, 0, None)]
    df = spark.createDataFrame(rows, PICTURE).repartition(3)
    made = images.image_histogram(df)
    got = {(x.file_id, x.channel, x.bin): x.n for x in made.collect()}
    assert got == {(1, "R", 1): 3, (1, "R", 0): 1, (1, "G", 2): 3, (1, "G", 0): 1, (1, "B", 3): 3, (1, "B", 5): 1, (1, "L", 1): 3, (1, "L", 0): 1, **{(2, c, 255): 1 for c in "RGBL"}}
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in (made, images.white_balance_estimate(df))]
    assert not any("explode(pixels" in p for p in plans)


def test_histograms_are_made_where_the_pixels_are_and_added_over_batches(spark, monkeypatch):
    monkeypatch.setattr(images, "ROWS_AT_ONCE", 3)
    r = np.random.default_rng(3)
    rows = [(int(i), 1, n, [int(x) for x in r.integers(0, 1 << 24, n)]) for i, n in zip([7] * 9 + list(r.integers(0, 12, 25)), r.integers(0, 6, 34).tolist(), strict=True)]
    rows += [(50, 1, 40, [0x0A0A0A] * 39 + [0xFFFFFF]), (51, 0, 0, None), (None, 1, 1, [0x102030]), (None, 1, 1, [0x102030])]
    want = {}
    for i, _, _, pixels in rows:
        for p in pixels or []:
            c = (p >> 16, p >> 8 & 255, p & 255)
            for name, v in zip("RGBL", (*c, (77 * c[0] + 150 * c[1] + 29 * c[2]) >> 8), strict=True):
                want[i, name, v] = want.get((i, name, v), 0) + 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = [((x.file_id, x.channel, x.bin), x.n) for x in images.image_histogram(spark.createDataFrame(rows, PICTURE).repartition(3)).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(want) and dict(got) == want
    made = images.image_histogram(rasters.images(spark, "/root/testdata/sf0.001"))
    assert "ArrowEvalPython [bins(_pixels(" in made._jdf.queryExecution().executedPlan().toString()


def test_visits_and_products_are_held_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(vectors, "AT_ONCE", 7)
    monkeypatch.setattr(vectors, "SLICE", 5)
    r = np.random.default_rng(9)
    rows = [(i, r.normal(size=4).round(3).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "face_id long, embedding array<double>")
    names = df.select(F.col("face_id").cast("string").alias("name"), F.col("embedding").alias("vector")).filter("face_id % 2 = 1")
    want = {}
    for i, v in rows:
        best = max(((cosine(v, w), str(j)) for j, w in rows if j % 2), key=lambda x: (round(x[0], 12), [-ord(c) for c in x[1]]))
        if best[0] > 0.35:
            want[i] = best[1]
    assert {x.face_id: x.known_as for x in faces.face_known_match(df, names, 0.35).collect()} == want
    at = vectors.Cells({2: [1]}, {2: np.array([[1.0, 0.0]])}, 3.2, {(2, 0, True): 12}, {(2, 0, True): 3.2}, 5)
    seen = spark.createDataFrame([(i, [1.0, 0.0], 2) for i in range(20)], "id long, v array<double>, dims int")
    got = vectors.visits(seen, at, lambda d, c, near: np.full(len(d), True)).select("id", "cell", "near", "slice").collect()
    assert {tuple(x) for x in got} == {(i, 0, True, s) for i in range(20) for s in range(3)} and len(got) == 60
