"""Exact cosine joins of vectors, and the groups that links of a least cosine form.

Angles between unit vectors are a metric. A bounded sample of the vectors are pivots; every vector lives in the cell of its
nearest pivot, and a cell knows how far its members lie from the pivot. By the triangle inequality a vector can have a
partner in a cell only if it lies within that radius plus the angle sought of the cell's pivot: those cells it visits.
Members of a cell are dealt into slices of a bounded size; a task holds one slice as a matrix and streams its visitors past
it. Nothing is dropped: where vectors have no structure (at low cosines in many dimensions) the windows admit nearly all,
and the work is that of all pairs, in blocks; what leaves a task are matches only, or for groups a spanning forest of them.

Vectors of different lengths never meet. Null or empty vectors match nothing; a zero vector has cosine 0 with all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import acos

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written

#: Pivots for each length of vectors (the sample's bound), rows of a slice, visitors that one task streams past it.
PIVOTS, SLICE, LANE = 64, 4096, 1 << 20
#: Rows whose visits, or whose products with a slice, a task holds at once.
AT_ONCE = 512
#: Room for rounding of angles.
SLACK = 1e-6


@dataclass
class Cells:
    """Per length of vectors the pivots' ids and unit vectors; per (length, cell, near) how many members lie there, and how
    far out. Near: within the angle sought of the pivot."""

    ids: dict[int, list]
    pivots: dict[int, np.ndarray]
    angle: float
    size: dict[tuple[int, int, bool], int]
    reach: dict[tuple[int, int, bool], float]
    slice_rows: int

    def slices(self, key: tuple[int, int, bool]) -> int:
        return -(-self.size.get(key, 0) // self.slice_rows)


def unit_rows(vectors: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(v, float) for v in vectors])
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.where(norm <= 1e-9, 0.0, m / np.where(norm <= 1e-9, 1.0, norm))


def angles(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(m @ pivots.T, -1.0, 1.0))


def by_length(batch: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame, np.ndarray]]:
    for n, part in batch.groupby("dims", sort=False):
        yield int(n), part, unit_rows(part["v"])


def plain(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v, dims of the rows that have a vector."""
    return rows.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.size(vector).alias("dims")).filter("dims > 0 and id is not null and not exists(v, x -> x is null)")


def cells(members: DataFrame, angle: float) -> tuple[Cells, DataFrame]:
    """The cells of members (id, v, dims), and the members with cell, near and slot (a hash)."""
    lengths = [r[0] for r in members.select("dims").distinct().collect()]  # one number for each model that made vectors
    ids, pivots = {}, {}
    for n in lengths:
        rows = members.filter(F.col("dims") == n).orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()
        ids[n], pivots[n] = [r["id"] for r in rows], unit_rows(pd.Series([r["v"] for r in rows]))
    kind = members.schema["id"].dataType.simpleString()

    def place(batches):
        for batch in batches:
            for n, part, m in by_length(batch):
                d = angles(m, pivots[n])
                cell = d.argmin(axis=1)
                far = d[np.arange(len(d)), cell]
                yield part.assign(cell=cell, far=far, near=far <= angle - SLACK)

    homes = written(members.mapInPandas(place, f"id {kind}, v array<double>, dims int, cell int, far double, near boolean"))
    got = homes.groupBy("dims", "cell", "near").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()  # at most 2 * PIVOTS a length
    keys = [(r["dims"], r["cell"], r["near"]) for r in got]
    made = Cells(ids, pivots, angle, dict(zip(keys, [r["n"] for r in got], strict=True)), dict(zip(keys, [r["far"] for r in got], strict=True)), SLICE)
    slices = F.create_map(*[F.lit(x) for k in keys for x in (":".join(map(str, k)).lower(), made.slices(k))]) if keys else F.create_map(F.lit(""), F.lit(1))
    name = F.concat_ws(":", F.col("dims").cast("string"), F.col("cell").cast("string"), F.col("near").cast("string"))
    return made, homes.withColumn("slice", F.pmod(F.xxhash64("id"), F.coalesce(slices[name], F.lit(1))).cast("int"))


def visits(rows: DataFrame, at: Cells, wanted: Callable[[np.ndarray, int, bool], np.ndarray]) -> DataFrame:
    """id, v, dims and the slices (cell, near, slice) that a row visits: by the window, where wanted(angles to the pivots,
    cell, near) agrees."""
    kind = rows.schema["id"].dataType.simpleString()
    keep = rows.select("id", "v", "dims")

    def targets(batches):
        for batch in batches:
            for n, part, m in by_length(batch):
                if n not in at.pivots:
                    continue
                keys = [(c, near) for c in range(len(at.pivots[n])) for near in (True, False) if at.slices((n, c, near))]
                codes = [c << 33 | near << 32 | s for c, near in keys for s in range(at.slices((n, c, near)))]
                codes, often = np.array(codes, np.int64), [at.slices((n, *k)) for k in keys]
                for r in range(0, len(m), AT_ONCE):
                    d = angles(m[r : r + AT_ONCE], at.pivots[n])
                    hit = [(d[:, c] <= at.reach[n, c, near] + at.angle + SLACK) & wanted(d, c, near) for c, near in keys]
                    hit = np.repeat(np.stack(hit, axis=1), often, axis=1) if keys else np.zeros((len(d), 0), bool)
                    yield part.iloc[r : r + AT_ONCE].assign(to=[codes[h] for h in hit])

    out = keep.mapInPandas(targets, f"id {kind}, v array<double>, dims int, to array<long>").withColumn("to", F.explode("to"))
    near = F.shiftright("to", 32).bitwiseAND(1) == 1
    return out.select("id", "v", "dims", F.shiftright("to", 33).cast("int").alias("cell"), near.alias("near"), F.col("to").bitwiseAND((1 << 32) - 1).cast("int").alias("slice"))


def blank(rows: DataFrame) -> Column:
    """A value of the id's type that is not null: a null would make pandas read integers as floats."""
    kind = rows.schema["id"].dataType.simpleString()
    return F.lit("" if kind == "string" else 0).cast(kind)


KEY = ["dims", "cell", "near", "slice", "lane"]


def meet(members: DataFrame, visitors: DataFrame, lanes: int, each, schema: str) -> DataFrame:
    """each(members' ids, their matrix) gives a function that takes visitors' ids and matrix and returns a frame of
    `schema`; called for every slice, the visitors in Arrow batches."""
    m = members.select(F.col("id").alias("m"), blank(visitors).alias("q"), "v", *KEY[:-1], F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(False).alias("side"))
    q = visitors.select(blank(members).alias("m"), F.col("id").alias("q"), "v", *KEY[:-1], F.pmod(F.xxhash64("id"), F.lit(lanes)).cast("int").alias("lane"), F.lit(True).alias("side"))
    rows = m.unionByName(q).repartition(*KEY).sortWithinPartitions(*KEY, "side")

    def stream(batches):
        now, ids, parts, match = None, [], [], None
        for batch in batches:
            for key, part in batch.groupby(KEY, sort=False):
                if key != now:
                    now, ids, parts, match = key, [], [], None
                side = part["side"].to_numpy(bool)
                if not side.all():
                    ids += part["m"][~side].tolist()
                    parts.append(unit_rows(part["v"][~side]))
                if side.any() and ids:
                    match = match or each(ids, np.concatenate(parts))
                    who, vectors = part["q"][side], part["v"][side]
                    for r in range(0, len(who), AT_ONCE):
                        out = match(who.iloc[r : r + AT_ONCE].tolist(), unit_rows(vectors.iloc[r : r + AT_ONCE]))
                        if len(out):
                            yield out

    return rows.mapInPandas(stream, schema)


def nearest(queries: DataFrame, references: DataFrame, query: tuple[str, str], reference: tuple[str, str], least: float, top: int = 0, strict: bool = False, others: bool = False) -> DataFrame:
    """query id, reference id, similarity, rank: per query row the `top` references (0: all) of a cosine of at least
    `least` (above it if strict), of equals the least id first. `query` and `reference` name the id and vector columns;
    `others` leaves out references of the query's own id."""
    members, rows = plain(references, *reference), plain(queries, *query)
    at, homes = cells(members, acos(max(-1.0, min(1.0, least))))
    names, kinds = (query[0], reference[0] if reference[0] != query[0] else f"other_{reference[0]}"), [x.schema["id"].dataType.simpleString() for x in (rows, members)]

    def each(ids, matrix):
        order = np.empty(len(ids), int)
        order[sorted(range(len(ids)), key=lambda i: ids[i])] = np.arange(len(ids))

        def match(who, m):
            got = []
            s = m @ matrix.T
            hit = s > least if strict else s >= least
            for i in np.flatnonzero(hit.any(axis=1)):
                at_ = np.flatnonzero(hit[i])
                at_ = at_[np.lexsort((order[at_], -s[i, at_]))]
                found = [(who[i], ids[j], float(s[i, j])) for j in at_ if not others or ids[j] != who[i]]
                got += found[:top] if top > 0 else found
            return pd.DataFrame(got, columns=["q", "m", "similarity"])

        return match

    lanes = max(1, -(-rows.count() // LANE))
    pairs = meet(homes, visits(rows, at, lambda d, c, near: np.full(len(d), True)), lanes, each, f"q {kinds[0]}, m {kinds[1]}, similarity double")
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "m")).cast("long"))
    return (pairs.filter(F.col("rank") <= top) if top > 0 else pairs).select(F.col("q").alias(names[0]), F.col("m").alias(names[1]), "similarity", "rank")


def links(rows: DataFrame, key: str, vector: str, least: float) -> DataFrame:
    """a, b: edges whose components are those of all pairs of a cosine of at least `least`; linear in the rows.

    Exact copies are linked to the least id among them and drop out. A vector within the angle of its pivot (near) is
    linked to it, and pivots that share a near vector to each other; so two near vectors of one cell, or a vector near a
    pivot and that pivot's near members, need not meet. All others meet slice by slice.
    """
    if not 0 <= least <= 1:
        raise ValueError("the threshold must lie between 0 and 1")
    every = plain(rows, key, vector)
    kind = every.schema["id"].dataType.simpleString()
    copies = every.groupBy("v").agg(F.min("id").alias("a"), F.count("*").alias("n"))
    twins = every.join(copies.filter("n > 1").select("v", "a"), "v").select("a", F.col("id").alias("b")).filter("a <> b")
    single = written(copies.select(F.col("a").alias("id"), "v", F.size("v").alias("dims")))
    angle = acos(least)
    at, homes = cells(single, angle)

    def stars(batches):
        for batch in batches:
            out = set()
            for n, part, m in by_length(batch):
                s = m @ at.pivots[n].T
                own = angles(m, at.pivots[n]).argmin(axis=1)
                for x, c, row in zip(part["id"], own, s, strict=True):
                    if row[c] >= least:
                        out.add((at.ids[n][c], x))
                        out |= {(at.ids[n][c], at.ids[n][j]) for j in np.flatnonzero(row >= least)}
            yield pd.DataFrame([p for p in out if p[0] != p[1]], columns=["a", "b"])

    def wanted(d, c, near):
        """A cell's near members are linked by its pivot to whoever is close to it; of two cells the lower one's rows visit,
        of one cell's near and other members the others."""
        own, close = d.argmin(axis=1), d[:, c] <= angle - SLACK
        return ~close & ((own == c) | (own < c)) if near else ~close & (own == c) | (own < c)

    def each(ids, matrix):
        root = np.arange(len(ids))

        def match(who, m):
            hit = m @ matrix.T >= least
            got = []
            for i in np.flatnonzero(hit.any(axis=1)):
                roots = np.unique(root[hit[i]])
                got.append((who[i], ids[roots[0]]))
                if len(roots) > 1:
                    got += [(ids[roots[0]], ids[r]) for r in roots[1:]]
                    root[np.isin(root, roots)] = roots[0]
            return pd.DataFrame([g for g in got if g[0] != g[1]], columns=["a", "b"])

        return match

    lanes = max(1, -(-single.count() // LANE))
    kinds = f"a {kind}, b {kind}"
    met = meet(homes, visits(homes, at, wanted), lanes, each, kinds)
    return twins.unionByName(single.mapInPandas(stars, kinds)).unionByName(met)


def components(edges: DataFrame) -> DataFrame:
    """id, component (its least id) of all ends of edges (a, b), by rounds of large and small stars: every vertex ties its
    larger neighbours, then its smaller ones and itself, to the least of them. Rounds grow with the logarithm of the size;
    each is written, so that the next starts from a table."""
    def tied(both: DataFrame, larger: bool) -> DataFrame:
        """both: every edge from both ends (u, v)."""
        side = both if larger else both.filter("v < u")
        least = (both if larger else side).groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        told = side.filter("v > u") if larger else side
        out = told.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return out if larger else out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))

    def both(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))

    def sign(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while (mark := sign(now)) != before:
        before = mark
        large = written(tied(both(now), True).filter("a <> b").distinct())
        now = written(tied(both(large), False).filter("a <> b").distinct())
    ends = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return ends.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def numbered(rows: DataFrame, order: list, name: str, start: int = 1) -> DataFrame:
    """rows numbered from `start` in this order, without a window over all: sorted in ranges, written once, and each range
    begins where those before it end (one small row a range)."""
    part = F.shiftright("_at", 33)
    d = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    size = d.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    first = size.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    d = d.withColumn("_part", part).join(F.broadcast(first), "_part")
    return d.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + start).drop("_part", "_before", "_at")


def ranked(rows: DataFrame, key: list[str], order: list, name: str) -> DataFrame:
    """rows numbered from 1 within each key: all rows are numbered in order of key, and each key's least number is taken
    off. A key of any size is spread over ranges."""
    d = numbered(rows, [*key, *order], "_all")
    least = d.groupBy(*key).agg(F.min("_all").alias("_least"))
    return d.join(least, key).withColumn(name, F.col("_all") - F.col("_least") + 1).drop("_all", "_least")
