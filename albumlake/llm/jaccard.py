"""Exact Jaccard self-join of word-shingle sets: pivots, Voronoi regions, triangle-inequality windows, recursion.

First regions. Unrelated texts lie at a distance of about 1 from each other, so documents taken as pivots cannot part a
whole corpus: every window would hold every document. The first pivots are therefore single shingles: a document lies
at 1 - 1/n from each of its own n shingles and at 1 from all others. Its home is its first shingle in a global order
(rare classes first), and the window in which a linked document's home can lie is its first n - ceil(t n) + 1 shingles;
it is replicated to the regions of these. Two linked documents meet in a region. Regions with equal members are one.

Inside a region. A link needs |x ^ y| <= (|x| + |y|) (1-t) / (1+t), the symmetric difference being a metric; so are the L1
distances of the sets' counts in DIMS shingle classes, which never exceed it. One pivot document per region is compared
with all members, again while that joins more of them; members already in one component need no further comparison.
A region over LEAF members of several components is split by PIVOTS pivot documents into Voronoi regions in the L1
metric: a document is an inner member of its nearest pivot's region and a replica in each that its window reaches
(D(y,p) <= D(y,nearest) + 2r), and these regions are split again. Where a split does not halve the pairs, the region is
compared whole in blocks: exact, quadratic in the region. Pairs are compared in order of size, where one of the two is
inner and their distances to the pivot differ by no more than the radius; what passes the L1 bound is decided on the
whole sets.

Equal sets are one node, so copies cost nothing more. Null, empty and word-free texts have the empty set and link with
nothing. Repeated rows of one doc_id give repeated result rows; rows of one doc_id with different texts are separate
nodes. An empty table gives an empty result. Columns beyond doc_id and text are not read. Shingles and sets are compared
by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, release, table
from .shingles import mix, shingle_sets

K, T = 5, 80
SMALL, LEAF, PIVOTS, STARS, TRIES = 16, 2048, 16, 4, 8
#: log2 of the sets from which a shingle class is heavy.
HEAVY = 20
CLASSES, PAGE, DIMS = 1 << 20, 1 << 14, 256
FILTER_BITS = 1 << 24


def set_id(s: np.ndarray) -> int | None:
    """A 64-bit key of a sorted set; None of the empty set."""
    import xxhash

    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())))) if len(s) else None


def class_counts(s: np.ndarray) -> np.ndarray:
    """Shingles per class, at most 255: a map to uint8^DIMS whose L1 distances never exceed the symmetric difference."""
    return np.minimum(np.bincount((s & np.uint64(DIMS - 1)).astype(np.int64), minlength=DIMS), 255).astype(np.uint8)


def survey_sets(docs: DataFrame, k: int = K) -> DataFrame:
    """One pass over the texts: rows (doc_id, n, id, vec), and pages (g, counts) of shingle-class counts per task."""

    def run(batches):
        seen, known = np.zeros(CLASSES, np.int32), set()
        for b in batches:
            ids, sizes, vecs = [], [], []
            for s in shingle_sets(b["text"], k):
                key = set_id(s)
                new = key is not None and key not in known
                if new:
                    known.add(key)
                    seen[((s >> np.uint64(20)) & np.uint64(CLASSES - 1)).astype(np.int64)] += 1
                ids.append(key)
                sizes.append(len(s))
                vecs.append(class_counts(s).tobytes() if new else None)
            yield pd.DataFrame({"doc_id": b["doc_id"], "text_hash": b["text_hash"], "n": sizes, "id": pd.array(ids, "Int64"), "vec": vecs, "g": -1, "counts": None})
        for g in range(CLASSES // PAGE):
            page = seen[g * PAGE : (g + 1) * PAGE]
            if page.any():
                yield pd.DataFrame({"doc_id": pd.array([None], "Int64"), "text_hash": pd.array([None], "Int64"), "n": [0], "id": pd.array([None], "Int64"), "vec": [None], "g": [g], "counts": [page.tobytes()]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInPandas(run, "doc_id long, text_hash long, n long, id long, vec binary, g int, counts binary")


def class_order(survey: DataFrame) -> np.ndarray:
    """log2 of the sets that hold a shingle class: a table of CLASSES bytes, whatever the input."""

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(PAGE, np.int64)
        for c in part["counts"]:
            total += np.frombuffer(c, np.int32)
        return pd.DataFrame({"g": part["g"].iloc[:1], "level": [np.floor(np.log2(total + 1)).astype(np.uint8).tobytes()]})

    out = np.zeros(CLASSES, np.uint8)
    for r in survey.filter("g >= 0").select("g", "counts").groupBy("g").applyInPandas(add, "g int, level binary").collect():
        out[r["g"] * PAGE : (r["g"] + 1) * PAGE] = np.frombuffer(r["level"], np.uint8)
    return out


def regions(docs: DataFrame, order: np.ndarray, heavy: bool, t: int = T, k: int = K, level: int = HEAVY) -> DataFrame:
    """(cell, id): each set with the pivot shingles in its window. A task sends a set once, however many copies it has.

    Of shingles in classes of at least 2^level sets with heavy, else of the others: their regions are of a bounded size.
    """
    held = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches):
        known = set()
        for b in batches:
            ids, found = [], [np.zeros(0, np.int64)]
            for s in shingle_sets(b["text"], k):
                key = set_id(s)
                if key is None or key in known:
                    continue
                known.add(key)
                take = len(s) - -(-t * len(s) // 100) + 1
                rank = held.value[((s >> np.uint64(20)) & np.uint64(CLASSES - 1)).astype(np.int64)].astype(np.uint64)
                # Sets are sorted, so a stable sort by rank orders ties by shingle.
                pick = np.argsort(rank, kind="stable")[:take]
                pick = pick[(rank[pick] >= level) == heavy]
                found.append(mix(s[pick]).view(np.int64))
                ids.append(np.full(len(pick), key))
            if ids:
                yield pd.DataFrame({"cell": np.concatenate(found), "id": np.concatenate(ids)})

    return docs.select("text").mapInPandas(run, "cell long, id long")


def shared_regions(docs: DataFrame, order: np.ndarray, t: int = T, k: int = K, level: int = HEAVY) -> DataFrame:
    """(cell, id) of the regions with several members; the table written may hold a row again.

    Regions below the heavy classes have at most 2^level members and the tasks' repeats, so one shuffle by region and a
    window find them. Heavy ones are counted before they are shuffled, and their join is one that Spark may split.
    """
    w = Window.partitionBy("cell")
    rows = regions(docs, order, False, t, k, level).withColumns({"lo": F.min("id").over(w), "hi": F.max("id").over(w)})
    rows = rows.filter("lo <> hi").select("cell", "id")
    if order.max() >= level:
        met = materialise(regions(docs, order, True, t, k, level))
        several = met.groupBy("cell").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo <> hi").select("cell")
        rows = rows.union(met.join(several, "cell"))
    return materialise(rows)


def near(n_a, n_b, d, t: int):
    """Whether a symmetric difference of at least d allows a link between sets of these sizes."""
    return (100 + t) * d <= (100 - t) * (n_a + n_b)


def bounded(pairs: DataFrame, nodes: DataFrame, t: int = T) -> DataFrame:
    """The pairs (a, b) whose sizes and class counts allow a link."""

    def run(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b[c]), np.uint8).reshape(-1, DIMS).astype(np.int16) for c in ("va", "vb"))
            yield b.loc[near(b["na"].to_numpy(), b["nb"].to_numpy(), np.abs(x - y).sum(axis=1), t), ["a", "b"]]

    left = nodes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("vec").alias("va"))
    right = nodes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("vec").alias("vb"))
    held = pairs.join(right, "b").join(left, "a").filter(100 * F.least("na", "nb") >= t * F.greatest("na", "nb"))
    return held.select("a", "b", "na", "nb", "va", "vb").mapInPandas(run, "a long, b long")


def needed_sets(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, k: int = K) -> DataFrame:
    """(id, shingles) of the documents in pairs, and of a few more that share their place in a filter of fixed size.

    The filter (FILTER_BITS bits, 2 MB) spares the others' hashing and shuffle; it never drops a needed one.
    """
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    at = F.pmod(F.xxhash64("doc"), F.lit(FILTER_BITS))
    used = ids.join(nodes, "id").groupBy(F.floor(at / 64).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))).alias("v"))
    got = used.toPandas()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[got["w"].to_numpy(np.int64)] = got["v"].to_numpy(np.int64)
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        known = set()
        for b in batches:
            at = b["at"].to_numpy()
            hit = ((held.value[at // 64] >> (at % 64)) & 1).astype(bool)
            ids, sets = [], []
            for s in shingle_sets(b["text"][hit], k):
                key = set_id(s)
                if key is not None and key not in known:
                    known.add(key)
                    ids.append(key)
                    sets.append(s.tobytes())
            yield pd.DataFrame({"id": pd.Series(ids, dtype="int64"), "shingles": sets})

    texts = docs.select(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(FILTER_BITS)).alias("at"), "text")
    return texts.mapInPandas(run, "id long, shingles binary")


def links(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, t: int = T, k: int = K) -> DataFrame:
    """The pairs that link, decided on the whole sets."""
    sets = needed_sets(docs, pairs, nodes, k)

    def run(batches):
        for b in batches:
            hit = []
            for x, y in zip(b["sa"], b["sb"], strict=True):
                both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                hit.append(100 * common >= t * (len(both) - common))
            yield b.loc[np.array(hit, bool), ["a", "b"]]

    joined = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    return joined.select("a", "b", "sa", "sb").mapInPandas(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id reachable, by minimum labels with pointer jumping; each round is written and reread."""
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    label = materialise(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("label")))
    while True:
        seen = both.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        jump = label.select(F.col("id").alias("label"), F.col("label").alias("far"))
        new = label.join(seen, "id").join(jump, "label", "left")
        new = materialise(new.select("id", F.least("label", "near", F.coalesce("far", "label")).alias("label"), F.col("label").alias("old")))
        release(label)
        label = new
        if not new.filter("label <> old").limit(1).count():
            release(both)
            return label.select("id", "label")


def unsettled(rows: DataFrame, label: DataFrame) -> DataFrame:
    """Rows of regions whose members lie in several components, with label."""
    named = rows.drop("label").join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
    mixed = named.groupBy("cell").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 < l1").select("cell")
    return named.join(mixed, "cell")


def voronoi(rows: DataFrame, nodes: DataFrame, t: int, turn: int, pivots: int = PIVOTS) -> DataFrame:
    """Each region's members in the Voronoi regions of its pivots: (cell, id, n, label, inner, gap, parent, m)."""
    rank = F.xxhash64(F.lit(turn), "id")
    chosen = rows.groupBy("cell", F.pmod(rank, F.lit(pivots)).alias("slot")).agg(F.min(F.struct(rank.alias("h"), F.col("id").alias("id")))["id"].alias("id"))
    chosen = chosen.join(nodes.select("id", "vec"), "id").groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("id", "vec"))).alias("pivots"))

    def run(batches):
        for b in batches:
            out = []
            for (_, m), part in b.groupby(["cell", "m"], sort=False):
                found = part["pivots"].iloc[0]
                p = np.frombuffer(b"".join(x["vec"] for x in found), np.uint8).reshape(-1, DIMS).astype(np.int16)
                x = np.frombuffer(b"".join(part["vec"]), np.uint8).reshape(-1, DIMS).astype(np.int16)
                d = np.stack([np.abs(x - q).sum(axis=1) for q in p], axis=1)
                n = part["n"].to_numpy()
                radius = (100 - t) * (n + n * 100 / t) / (100 + t)
                home = d.argmin(axis=1)
                at, j = np.nonzero(d <= (d.min(axis=1) + 2 * radius)[:, None])
                got = part.iloc[at]
                salt = mix(np.array([y["id"] for y in found], np.int64).view(np.uint64) + np.uint64(turn))
                cell = mix(got["cell"].to_numpy().view(np.uint64) ^ salt[j]).view(np.int64)
                out.append(pd.DataFrame({"cell": cell, "id": got["id"], "n": got["n"], "label": got["label"], "inner": got["inner"].to_numpy() & (home[at] == j), "gap": d[at, j], "parent": got["cell"], "m": m}))
            if out:
                yield pd.concat(out)

    held = rows.join(nodes.select("id", "vec"), "id").join(chosen, "cell")
    return held.select("cell", "id", "n", "label", "inner", "m", "vec", "pivots").mapInPandas(run, "cell long, id long, n int, label long, inner boolean, gap int, parent long, m long")


def compare(rows: DataFrame, nodes: DataFrame, t: int = T, leaf: int = LEAF, tries: int | None = None) -> DataFrame:
    """Pairs (a, b) of different components within the windows of a region, whole regions in blocks of about `leaf`.

    With `tries`, only about so many of a region for each two components.
    """
    blocks = F.ceil(F.col("m") / leaf)
    rows = rows.withColumn("mine", F.pmod(F.xxhash64(F.lit(7), "id"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    rows = rows.withColumn("part", F.xxhash64("cell", F.least("mine", "other"), F.greatest("mine", "other")))
    rows = rows.withColumn("cross", F.when(F.col("mine") == F.col("other"), 0).otherwise(F.signum(F.col("mine") - F.col("other"))).cast("int"))
    # A pair of blocks is one part; a block with itself has cross 0 for all, two blocks have -1 and 1.
    tasks = rows.agg(F.ceil(F.count(F.lit(1)) / 30_000)).first()[0] or 1
    rows = rows.withColumn("bucket", F.pmod(F.col("part"), F.lit(int(tasks)))).join(nodes.select("id", "vec"), "id")

    def thin(found: list) -> list:
        rows = pd.DataFrame(np.concatenate(found), columns=["part", "la", "lb", "a", "b"])
        return [rows.groupby(["part", "la", "lb"], sort=False).head(tries).to_numpy()]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["part", "n", "id"], kind="stable")
        cell, n, gap, ids, label, cross = (part[c].to_numpy() for c in ("part", "n", "gap", "id", "label", "cross"))
        inner, n = part["inner"].to_numpy(bool), n.astype(np.int64)
        vec = np.frombuffer(b"".join(part["vec"]), np.uint8).reshape(-1, DIMS)
        out, held, at, step = [np.zeros((0, 5), np.int64)], 0, np.arange(len(part)), 1
        while len(at):
            at = at[at + step < len(part)]
            at = at[(cell[at] == cell[at + step]) & (100 * n[at] >= t * n[at + step])]
            to = at + step
            ok = (label[at] != label[to]) & (inner[at] | inner[to]) & (cross[at] + cross[to] == 0)
            ok &= near(n[at], n[to], np.abs(gap[at] - gap[to]), t)
            x, y = at[ok], to[ok]
            for lo in range(0, len(x), 4096):
                i, j = x[lo : lo + 4096], y[lo : lo + 4096]
                d = np.abs(vec[i].astype(np.int16) - vec[j]).sum(axis=1)
                hit = near(n[i], n[j], d, t)
                i, j = i[hit], j[hit]
                low = label[i] < label[j]
                out.append(np.stack([cell[i], np.where(low, label[i], label[j]), np.where(low, label[j], label[i]), np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])], axis=1))
                held += len(i)
                if tries and held > 500_000:
                    out, held = thin(out), 0
            step += 1
        found = (thin(out) if tries else out) if held or len(out) > 1 else out
        got = np.concatenate(found)
        return pd.DataFrame({"a": got[:, 3], "b": got[:, 4]}).drop_duplicates()

    return rows.groupBy("bucket").applyInPandas(run, "a long, b long").distinct()


def jaccard_links(docs: DataFrame, nodes: DataFrame, order: np.ndarray, t: int = T, k: int = K, small: int = SMALL, leaf: int = LEAF, pivots: int = PIVOTS, level: int = HEAVY) -> DataFrame:
    """(id, label): the component of every set that links with another."""
    shared = shared_regions(docs, order, t, k, level)
    rows = shared.distinct()
    half = F.lit((1 << 31) - 1)
    # Regions with equal members count once; sums of the ids' halves stand for the members.
    kept = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("pivot"), F.sum(F.col("id").bitwiseAND(half)).alias("s1"), F.sum(F.shiftrightunsigned("id", 31).bitwiseAND(half)).alias("s2"))
    kept = kept.groupBy("m", "pivot", "s1", "s2").agg(F.min("cell").alias("cell")).select("cell", "m", "pivot")
    rows = materialise(rows.join(kept, "cell").join(nodes.select("id", "n"), "id"))
    release(shared)
    few = rows.filter(F.col("m") <= small)
    pairs = few.alias("x").join(few.alias("y"), "cell").filter("x.id < y.id").filter(100 * F.least("x.n", "y.n") >= t * F.greatest("x.n", "y.n"))
    star = rows.filter((F.col("m") > small) & (F.col("id") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    pairs = materialise(bounded(pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).union(star).distinct(), nodes, t))
    edges = materialise(links(docs, pairs, nodes, t, k))
    label = components(edges)
    rest = materialise(unsettled(rows.filter(F.col("m") > small).select("cell", "id", "n"), label))
    left, turn = rest.select("label").distinct().count(), 0
    while left:  # a few more pivots per region while they join a tenth of the components that meet
        turn += 1
        rank = F.xxhash64(F.lit(turn), "id")
        pivot = rest.groupBy("cell", F.pmod(rank, F.lit(STARS)).alias("slot")).agg(F.min(F.struct(rank.alias("h"), F.col("id").alias("id"), F.col("label").alias("l"))).alias("p")).select("cell", "p.id", "p.l").toDF("cell", "pivot", "pl")
        star = rest.join(pivot, "cell").filter("label <> pl").select(F.least("pivot", "id").alias("a"), F.greatest("pivot", "id").alias("b")).distinct()
        star = materialise(bounded(star, nodes, t))
        edges = materialise(edges.union(links(docs, star, nodes, t, k)))
        label = components(edges)
        rest = materialise(unsettled(rest, label))
        before, left = left, rest.select("label").distinct().count()
        if left > 0.9 * before:
            break
    if not left:
        return label
    sizes = rest.groupBy("cell").agg(F.count(F.lit(1)).alias("m"))
    work = materialise(rest.join(sizes, "cell").select("cell", "id", "n", "label", F.lit(True).alias("inner"), F.lit(0).alias("gap"), "m"))
    done = [work.filter(F.col("m") <= leaf)]
    large = work.filter(F.col("m") > leaf)
    while large.limit(1).count():
        turn += 1
        made = materialise(voronoi(large, nodes, t, turn, pivots))
        sizes = made.groupBy("parent", "m", "cell").agg(F.count(F.lit(1)).alias("size"), F.max("inner").alias("some"))
        cost = sizes.groupBy("parent", "m").agg(F.sum(F.col("size").cast("double") * F.col("size")).alias("cost"))
        split = cost.filter(2 * F.col("cost") <= F.col("m").cast("double") * F.col("m")).select("parent")
        whole = large.join(split.withColumnRenamed("parent", "cell"), "cell", "left_anti")
        made = made.drop("m").join(split, "parent", "left_semi").join(sizes.filter("some").select("cell", F.col("size").alias("m")), "cell")
        made = materialise(made.select("cell", "id", "n", "label", "inner", "gap", "m"))
        done += [whole, made.filter(F.col("m") <= leaf)]
        large = made.filter(F.col("m") > leaf)
    todo = done[0]
    for d in done[1:]:
        todo = todo.unionByName(d)
    todo = materialise(todo)
    # A few pairs of each two components join most that belong together; then every pair that is left.
    pairs = materialise(compare(todo, nodes, t, leaf, TRIES))
    edges = materialise(edges.union(links(docs, pairs, nodes, t, k)))
    todo = materialise(unsettled(todo, components(edges)))
    pairs = materialise(compare(todo, nodes, t, leaf))
    return components(materialise(edges.union(links(docs, pairs, nodes, t, k))))


def jaccard_components(docs: DataFrame, t: int = T, k: int = K, small: int = SMALL, leaf: int = LEAF, pivots: int = PIVOTS, level: int = HEAVY) -> DataFrame:
    """doc_id, n_shingles, component_id, text_hash (xxhash64 of the text) for every row of docs."""
    docs = docs.select("doc_id", "text")
    survey = materialise(survey_sets(docs, k))
    members = survey.filter("g < 0").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "id")
    nodes = survey.filter("id is not null").groupBy("id").agg(F.min("doc_id").alias("doc"), F.max("n").alias("n"), F.max("vec").alias("vec"))
    nodes = materialise(nodes)
    label = jaccard_links(docs, nodes, class_order(survey), t, k, small, leaf, pivots, level)
    named = nodes.select("id", "doc").join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
    first = named.groupBy("label").agg(F.min("doc").alias("component_id"))
    classes = named.join(first, "label").select("id", "component_id")
    return members.join(classes, "id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).drop("text_hash")
