"""Regions, faces, detections and their vectors. A region row has file_id, idx, label, category, status, x, y, w, h."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written
from .vectors import components, links, nearest, numbered

# Detector labels of animals.
ANIMALS = ["bird", "cat", "dog", "horse", "sheep", "cow", "elephant", "bear", "zebra", "giraffe"]

# The other labels of the same detector, comma-separated.
THINGS = """person, bicycle, car, motorcycle, airplane, bus, train, truck, boat, traffic light, fire hydrant, stop sign, parking meter, bench,
backpack, umbrella, handbag, tie, suitcase, frisbee, skis, snowboard, sports ball, kite, baseball bat, baseball glove, skateboard, surfboard,
tennis racket, bottle, wine glass, cup, fork, knife, spoon, bowl, banana, apple, sandwich, orange, broccoli, carrot, hot dog, pizza, donut, cake,
chair, couch, potted plant, bed, dining table, toilet, tv, laptop, mouse, remote, keyboard, cell phone, microwave, oven, toaster, sink,
refrigerator, book, clock, vase, scissors, teddy bear, hair drier, toothbrush"""


def scan_faces(regions: DataFrame) -> DataFrame:
    return regions.filter("category = 'Person'")


def effective_faces(regions: DataFrame) -> DataFrame:
    return regions.filter("category = 'Person' and status = 'Accepted'")


def region_category(label: Column) -> Column:
    """Person, Animal or Item of a label that the detector knows; any other, also none, is Other."""
    known = [x.strip() for x in THINGS.split(",")]
    return F.when(F.lower(label) == "person", "Person").when(F.lower(label).isin(ANIMALS), "Animal").when(F.lower(label).isin(known), "Item").otherwise("Other")


def propose_regions(detections: DataFrame, least: float = 0.3) -> DataFrame:
    """Detections sure enough and with a box, as proposed regions."""
    rows = detections.filter((F.col("score") >= least) & (F.col("w") > 0) & (F.col("h") > 0))
    return rows.select("file_id", "idx", "label", region_category(F.col("label")).alias("category"), F.lit("Proposed").alias("status"), "x", "y", "w", "h")


def iou(a: str, b: str) -> Column:
    """Intersection over union of the boxes of two aliases; 0 without an area."""
    def side(p: str, s: str) -> Column:
        edge = [F.col(f"{t}.{p}") + F.col(f"{t}.{s}") for t in (a, b)]
        return F.greatest(F.least(*edge) - F.greatest(F.col(f"{a}.{p}"), F.col(f"{b}.{p}")), F.lit(0.0))

    both = side("x", "w") * side("y", "h")
    union = F.col(f"{a}.w") * F.col(f"{a}.h") + F.col(f"{b}.w") * F.col(f"{b}.h") - both
    return F.when(union > 0, both / union).otherwise(0.0)


def box_iou_pairs(regions: DataFrame, least: float = 0.0) -> DataFrame:
    """Pairs of one photo's boxes that overlap by more than `least`."""
    pairs = regions.alias("a").join(regions.alias("b"), "file_id").filter("a.idx < b.idx").withColumn("iou", iou("a", "b"))
    return pairs.filter(F.col("iou") > least).select("file_id", F.col("a.idx").alias("a"), F.col("b.idx").alias("b"), "iou")


def dedupe_regions(regions: DataFrame) -> DataFrame:
    """The first region of each photo, box rounded to 3 places and category."""
    w = Window.partitionBy("file_id", *[F.round(c, 3) for c in "xywh"], "category").orderBy("idx")
    return regions.withColumn("_at", F.row_number().over(w)).filter("_at = 1").drop("_at")


def suppress_body_boxes(regions: DataFrame, slack: float = 0.02, most: float = 0.4) -> DataFrame:
    """Without the Person boxes that hold a much smaller Person box of the same photo."""
    p = regions.filter("category = 'Person'")
    body, face = p.alias("a"), p.alias("b")
    inside = (F.col("b.x") >= F.col("a.x") - slack) & (F.col("b.y") >= F.col("a.y") - slack)
    inside &= (F.col("b.x") + F.col("b.w") <= F.col("a.x") + F.col("a.w") + slack) & (F.col("b.y") + F.col("b.h") <= F.col("a.y") + F.col("a.h") + slack)
    small = F.col("b.w") * F.col("b.h") <= most * F.col("a.w") * F.col("a.h")
    drop = body.join(face, "file_id").filter((F.col("a.idx") != F.col("b.idx")) & inside & small).select("file_id", F.col("a.idx").alias("idx")).distinct()
    return regions.join(drop, ["file_id", "idx"], "left_anti")


REGIONS = "array<struct<idx:int,label:string,category:string,status:string,x:double,y:double,w:double,h:double,embedding:array<double>>>"


def merge_detected_faces(regions: DataFrame, detections: DataFrame, least: float = 0.5) -> DataFrame:
    """A photo's regions after its detected faces are merged in, in order: file_id, idx, label, category, status, box,
    embedding; photos of either side.

    A face that overlaps a Person region by `least` or more (the first such by idx, one appended before included) only
    fills that region's blank label and missing embedding; any other is appended as Proposed. Order matters, so a photo's
    faces are folded one after the other, within its row. detections: file_id, ord, label, x, y, w, h, embedding.
    """
    box = ["x", "y", "w", "h"]
    vector = F.col("embedding").cast("array<double>").alias("embedding")
    have = regions.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct(F.col("idx").cast("int").alias("idx"), "label", "category", "status", *[F.col(c).cast("double").alias(c) for c in box], vector))).alias("have"))
    found = detections.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("ord", "label", *[F.col(c).cast("double").alias(c) for c in box], vector))).alias("found"))
    both = have.join(found, "file_id", "full")
    none = F.array().cast(REGIONS)

    def meets(r: Column, d: Column) -> Column:
        across, down = (F.greatest(F.least(r[s] + r[n], d[s] + d[n]) - F.greatest(r[s], d[s]), F.lit(0.0)) for s, n in (("x", "w"), ("y", "h")))
        both_ = across * down
        return (r["category"] == "Person") & (both_ >= least * (r["w"] * r["h"] + d["w"] * d["h"] - both_)) & (both_ > 0)

    def filled(r: Column, d: Column) -> Column:
        label = F.when(F.trim(F.coalesce(r["label"], F.lit(""))) != "", r["label"]).otherwise(d["label"])
        return F.struct(r["idx"].alias("idx"), label.alias("label"), r["category"].alias("category"), r["status"].alias("status"), *[r[c].alias(c) for c in box],
                        F.when(F.size(r["embedding"]) > 0, r["embedding"]).otherwise(d["embedding"]).alias("embedding"))

    def put(acc: Column, d: Column) -> Column:
        at = F.array_position(F.transform(acc, lambda r: F.coalesce(meets(r, d), F.lit(False))), True)
        new = F.struct((F.coalesce(F.array_max(F.transform(acc, lambda r: r["idx"])), F.lit(-1)) + 1).alias("idx"), d["label"].alias("label"), F.lit("Person").alias("category"), F.lit("Proposed").alias("status"),
                       *[d[c].alias(c) for c in box], d["embedding"].alias("embedding"))
        return F.when(at == 0, F.concat(acc, F.array(new)).cast(REGIONS)).otherwise(F.transform(acc, lambda r, i: F.when(i + 1 == at, filled(r, d)).otherwise(r)).cast(REGIONS))

    merged = F.aggregate(F.coalesce("found", F.array()), F.coalesce(F.col("have").cast(REGIONS), none), put)
    return both.select("file_id", F.explode(merged).alias("r")).select("file_id", "r.*")


def nms(detections: DataFrame, most: float = 0.45, by: list[str] | None = None) -> DataFrame:
    """Greedy suppression per photo and class: in order of score, a box stays unless it overlaps a kept one by more than
    `most`. A fold over the boxes of one photo and class."""
    by = by or ["file_id", "label"]
    boxes = F.reverse(F.array_sort(F.collect_list(F.struct("score", (-F.col("idx")).alias("order"), "x", "y", "w", "h"))))
    kind = "array<struct<score:double,order:bigint,x:double,y:double,w:double,h:double>>"

    def overlap(p: Column, q: Column) -> Column:
        def side(s: str, n: str) -> Column:
            return F.greatest(F.least(p[s] + p[n], q[s] + q[n]) - F.greatest(p[s], q[s]), F.lit(0.0))

        both = side("x", "w") * side("y", "h")
        union = p["w"] * p["h"] + q["w"] * q["h"] - both
        return F.when(union > 0, both / union).otherwise(0.0)

    kept = F.aggregate(F.col("boxes").cast(kind), F.array().cast(kind), lambda acc, b: F.when(F.exists(acc, lambda k: overlap(k, b) > most), acc).otherwise(F.array_append(acc, b)))
    out = detections.groupBy(*by).agg(boxes.alias("boxes")).select(*by, F.explode(kept).alias("b"))
    return out.select(*by, (-F.col("b.order")).alias("idx"), F.col("b.score").alias("score"))


def detected_keywords(detections: DataFrame) -> DataFrame:
    """Per photo the distinct labels found, sorted."""
    return detections.groupBy("file_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def _named(faces: DataFrame) -> DataFrame:
    """face_id, name, cluster_id of the faces with a name that is not blank: ids from 1 in order of name, without case."""
    named = faces.filter("trim(name) <> ''").withColumn("_key", F.lower("name"))
    ranks = numbered(named.select("_key").distinct(), ["_key"], "cluster_id")
    return named.join(ranks, "_key").select("face_id", "name", "cluster_id")


def face_groups_by_name(faces: DataFrame, by_name: bool = True) -> DataFrame:
    """face_id, name and cluster_id: named faces by name without regard to case, in order of name from 1; then every
    unnamed face alone, in order of face_id. Without `by_name` every face is alone."""
    if not by_name:
        return numbered(faces.select("face_id", "name"), ["face_id"], "cluster_id")
    known = written(_named(faces))
    first = known.agg(F.coalesce(F.max("cluster_id"), F.lit(0))).first()[0]
    alone = numbered(faces.filter("name is null or trim(name) = ''").select("face_id", "name"), ["face_id"], "cluster_id", first + 1)
    return known.unionByName(alone)


def face_clusters_embedding(faces: DataFrame, least: float = 0.6) -> DataFrame:
    """face_id, name and cluster_id: named faces by name; then unnamed faces joined where two have a cosine of at least
    `least` (single linkage, vectors of one length), the largest cluster first, of equal ones that of the least face_id;
    then every unnamed face without a vector, in order of face_id."""
    if not 0 <= least <= 1:
        raise ValueError("the threshold must lie between 0 and 1")
    known = written(_named(faces))
    first = known.agg(F.coalesce(F.max("cluster_id"), F.lit(0))).first()[0]
    other = faces.filter("name is null or trim(name) = ''").select("face_id", "name", "embedding")
    seen = other.filter("size(embedding) > 0")
    of = components(links(seen, "face_id", "embedding", least))
    member = written(seen.join(of.withColumnRenamed("id", "face_id"), "face_id", "left").select("face_id", "name", F.coalesce("component", "face_id").alias("_of")))
    sizes = member.groupBy("_of").agg(F.count("*").alias("_n"))
    ids = written(numbered(sizes, [F.desc("_n"), "_of"], "cluster_id", first + 1))
    last = ids.agg(F.coalesce(F.max("cluster_id"), F.lit(first))).first()[0]
    alone = numbered(other.filter("embedding is null or size(embedding) = 0").select("face_id", "name"), ["face_id"], "cluster_id", last + 1)
    return known.unionByName(member.join(ids, "_of").select("face_id", "name", "cluster_id")).unionByName(alone)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm <= 1e-9, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def face_cluster_centroid(faces: DataFrame, by: str) -> DataFrame:
    """The normalised mean vector per cluster; clusters whose vectors differ in length have none."""
    sized = faces.filter("embedding is not null").withColumn("dims", F.size("embedding"))
    same = sized.groupBy(by).agg(F.min("dims").alias("lo"), F.max("dims").alias("hi"), F.count("*").alias("n")).filter("lo = hi").select(by, "n")
    mean = sized.join(same, by).select(by, "n", F.posexplode("embedding").alias("i", "x")).groupBy(by, "n", "i").agg(F.avg("x").alias("x"))
    v = mean.groupBy(by, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    return v.select(by, "n", l2_normalize(F.col("v")).alias("centroid"))


def nearest_named_clusters(centroids: DataFrame, by: str, top: int = 3) -> DataFrame:
    """Per cluster the `top` nearest others by cosine; clusters without a centroid have and are none."""
    rows = centroids.select(F.col(by).alias("a"), "centroid")
    return nearest(rows, rows.withColumnRenamed("a", "b"), ("a", "centroid"), ("b", "centroid"), -1.0, top, others=True).select("a", "b", "rank", "similarity")


def auto_keywords(images: DataFrame, vocabulary: DataFrame, top: int = 5, least: float = 0.22) -> DataFrame:
    """Per image the `top` words (word, vector) of a similarity of at least `least`; other lengths are skipped, top <= 0
    keeps all."""
    return nearest(images, vocabulary, ("file_id", "embedding"), ("word", "vector"), least, top).select("file_id", "word", "rank")


def face_known_match(faces: DataFrame, references: DataFrame, above: float = 0.65) -> DataFrame:
    """Per face the best reference (name, vector) above a cosine; of equals the first name. A name may have many vectors."""
    best = nearest(faces, references, ("face_id", "embedding"), ("name", "vector"), above, 1, strict=True)
    return best.select("face_id", F.col("name").alias("known_as"))


def near_duplicate_groups(pairs: DataFrame) -> DataFrame:
    """Greedy leaders over pairs (a < b): in order of id, a file without a leader leads all later ones within reach.

    By rounds: a file whose earlier partners are all settled leads, if none of them leads; then what it reaches is
    settled. Every round settles at least the least open file of each connected part; links that hang together in a long
    chain take as many rounds. Returns file_id and leader for files that a leader absorbs.
    """
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    pairs = written(pairs)
    state = written(ids.withColumn("leads", F.lit(None).cast("boolean")))
    while state.filter("leads is null").limit(1).count():
        earlier = pairs.join(state.select(F.col("id").alias("a"), "leads"), "a").groupBy("b").agg(F.max(F.coalesce(F.col("leads"), F.lit(False))).alias("led"), F.max(F.col("leads").isNull()).alias("open"))
        new = F.when(F.col("leads").isNotNull(), F.col("leads")).when(F.coalesce("led", F.lit(False)), False).when(~F.coalesce("open", F.lit(False)), True)
        state = written(state.join(earlier.withColumnRenamed("b", "id"), "id", "left").select("id", new.alias("leads")))
    leaders = state.filter("leads").select(F.col("id").alias("a"))
    return pairs.join(leaders, "a").groupBy(F.col("b").alias("file_id")).agg(F.min("a").alias("leader"))


def near_duplicate_files(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """file_id and leader of every file that a leader absorbs: near_duplicate_groups() over one file for each hash, and the
    other files of a hash with it. members is file_id, rep."""
    leaders = near_duplicate_groups(pairs).withColumnRenamed("file_id", "rep")
    out = members.join(leaders, "rep", "left").select("file_id", F.coalesce("leader", "rep").alias("leader"))
    return out.filter("file_id <> leader")
