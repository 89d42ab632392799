"""Pixels of images: histograms, white balance, sharpness and exposure, issues, perceptual hashes, decoded detections.

An image row has file_id, width, height and pixels: 0xRRGGBB integers, row by row. A pixel's neighbours lie in its own
row's array, so stencils need no shuffle: what leaves a task are counts per image, or per image and brightness. Every input
row is an image of its own, also where file_ids repeat.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, ShortType, StructField, StructType

# Thresholds and sensitivities.
BLUR_BELOW, HIGHLIGHT, SHADOW, CLIPPED_SHARE = 100.0, 250, 5, 0.01
CLIP_LOW, CLIP_HIGH, PATCH_LOW, PATCH_HIGH, PATCH_PIXELS, PATCH_WEIGHT, SENSITIVITY = 0.02, 0.02, 200, 250, 10, 0.5, 50.0
WORKING_EDGE, TILE, TILE_STEP = 256, 32, 16
LOW_LIGHT, NOISE, HAZE, MEGAPIXELS = (40, 90), (8, 30), (50, 130), (0.5, 8)
HASH_EDGE, HASH_LOW = 32, 8
#: Bins that leave a task together.
ROWS_AT_ONCE = 1 << 15


def red(p: Column) -> Column:
    return F.shiftright(p, 16).bitwiseAND(255)


def green(p: Column) -> Column:
    return F.shiftright(p, 8).bitwiseAND(255)


def blue(p: Column) -> Column:
    return p.bitwiseAND(255)


def luminance(p: Column) -> Column:
    """Rec. 601 brightness in integers."""
    return F.shiftright(77 * red(p) + 150 * green(p) + 29 * blue(p), 8)


def packed(data: Column, channels: Column) -> Column:
    """Pixels of a BGR, BGRA or grey byte raster, as Spark's image source gives it; alpha is left out."""
    byte = F.transform(F.split(F.decode(data, "ISO-8859-1"), ""), lambda c: F.ascii(c))
    n = F.when(F.octet_length(data) > 0, F.floor(F.octet_length(data) / channels)).otherwise(0)
    at = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))

    def pixel(i: Column) -> Column:
        b, g, r = (F.get(byte, (i * channels + F.when(channels > 1, k).otherwise(0)).cast("int")) for k in range(3))
        return F.shiftleft(r, 16) + F.shiftleft(g, 8) + b

    return F.transform(at, pixel)


@F.arrow_udf(StructType([StructField("cell", ArrayType(ShortType())), StructField("n", ArrayType(IntegerType()))]))
def bins(pixels: pa.Array) -> pa.Array:
    """Of every image the cells (256 * the channel's place in RGBL + bin) that occur, in order, and their counts."""
    cells, counts, ends = [np.empty(0, np.int16)], [np.empty(0, np.int32)], [0]
    starts, p = pixels.offsets.to_numpy(), pixels.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
    for low, high, there in zip(starts[:-1].tolist(), starts[1:].tolist(), pixels.is_valid().to_pylist(), strict=True):
        if there and high > low:
            b, g, r, _ = p[low:high].view(np.uint8).reshape(-1, 4).T.astype(np.uint16, order="C")
            if np.array_equal(r, g) and np.array_equal(g, b):  # grey, so its brightness too
                n = np.tile(np.bincount(r, minlength=256), 4)
            else:
                n = np.concatenate([np.bincount(c, minlength=256) for c in (r, g, b, brightness(r, g, b))])
            cells.append(np.flatnonzero(n).astype(np.int16))
            counts.append(n[cells[-1]].astype(np.int32))
        ends.append(ends[-1] + (len(cells[-1]) if there and high > low else 0))
    at = pa.array(ends, pa.int32())
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(at, pa.array(np.concatenate(x))) for x in (cells, counts)], ["cell", "n"])


def image_histogram(images: DataFrame) -> DataFrame:
    """file_id, channel (R, G, B, L), bin, n of the bins that occur. An image's pixels are counted where they lie (where a
    function makes them, they do not leave its worker); what moves is one row of bins an image, and the bins of equal file_ids
    are added up as they pass in order."""
    def added(batches):
        held = None  # the last image, which may go on: its id, cells and counts

        def given(ids, at, cell, n):
            for low in range(0, len(cell), ROWS_AT_ONCE):
                part = slice(low, low + ROWS_AT_ONCE)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at[part])), pa.array((cell[part] & 1023).astype(np.int16)), pa.array(n[part])], names=["file_id", "cell", "n"])

        for batch in batches:
            ids, lists = batch.column("file_id"), (batch.column("cell"), batch.column("n"))
            sizes, (cell, n) = np.diff(lists[0].offsets.to_numpy()), (x.flatten().to_numpy() for x in lists)
            if held:
                ids, sizes = pa.concat_arrays([held[0], ids]), np.concatenate([[len(held[1])], sizes])
                cell, n = np.concatenate([held[1], cell]), np.concatenate([held[2], n])
            code = ids.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            heads = np.concatenate([[True], np.diff(code) != 0])
            key = np.repeat((heads.cumsum() - 1) << 10, sizes) + cell
            n = n.astype(np.int64, copy=False)
            if (np.diff(key) <= 0).any():  # images of one id: its cells come again
                order = np.argsort(key, kind="stable")
                first = np.flatnonzero(np.diff(key[order], prepend=-1))
                key, n = key[order][first], np.add.reduceat(n[order], first)
            open_ = np.searchsorted(key, (heads.sum() - 1) << 10)
            yield from given(ids, np.flatnonzero(heads)[key[:open_] >> 10], key[:open_], n[:open_])
            held = ids[-1:], key[open_:] & 1023, n[open_:]
        if held:
            yield from given(held[0], np.zeros(len(held[1]), np.int64), *held[1:])

    kind = images.schema["file_id"].dataType.simpleString()
    rows = images.select("file_id", bins("pixels").alias("_bins")).select("file_id", "_bins.*")
    rows = rows.repartition("file_id").sortWithinPartitions("file_id").mapInArrow(added, f"file_id {kind}, cell smallint, n long")
    cell = F.col("cell").cast("int")
    channel = F.when(cell < 256, "R").when(cell < 512, "G").when(cell < 768, "B").otherwise("L")
    return rows.select("file_id", channel.alias("channel"), cell.bitwiseAND(255).alias("bin"), "n")


def quality_flags(images: DataFrame) -> DataFrame:
    """file_id, sharpness (variance of the Laplacian over inner pixels), highlights and shadows (shares of clipped pixels),
    blurry, overexposed, underexposed. Images under 3 pixels wide or high have zeros and no flag."""
    rows = images.withColumn("_row", F.monotonically_increasing_id())
    rows = rows.select("_row", "file_id", "width", "height", "pixels", F.posexplode_outer("pixels").alias("i", "p"))
    x, y, w = F.col("i") % F.col("width"), F.floor(F.col("i") / F.col("width")), F.col("width").cast("int")

    def at(step: Column | int) -> Column:
        return luminance(F.get("pixels", F.col("i") + step))

    inner = (x > 0) & (x < F.col("width") - 1) & (y > 0) & (y < F.col("height") - 1)
    v = F.when(inner, at(w) + at(-w) + at(1) + at(-1) - 4 * luminance(F.col("p"))).cast("long")
    lum = luminance(F.col("p"))
    rows = rows.select("_row", "file_id", "width", "height", v.alias("v"), lum.alias("lum"))
    sums = rows.groupBy("_row", "file_id", "width", "height").agg(
        F.count("v").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss"), F.count("lum").alias("total"),
        F.count_if(F.col("lum") >= HIGHLIGHT).alias("hi"), F.count_if(F.col("lum") <= SHADOW).alias("lo"),
    )
    large = (F.col("width") >= 3) & (F.col("height") >= 3) & (F.col("n") > 0)
    mean = F.col("s") / F.col("n")
    sharp = F.when(large, F.col("ss") / F.col("n") - mean * mean).otherwise(0.0)
    hi, lo = (F.when(large, F.col(c) / F.col("total")).otherwise(0.0) for c in ("hi", "lo"))
    return sums.select(
        "file_id", sharp.alias("sharpness"), hi.alias("highlights"), lo.alias("shadows"),
        (large & (sharp < BLUR_BELOW)).alias("blurry"), (large & (hi >= CLIPPED_SHARE)).alias("overexposed"), (large & (lo >= CLIPPED_SHARE)).alias("underexposed"),
    )


def white_balance_estimate(images: DataFrame) -> DataFrame:
    """file_id, temperature, tint in [-100, 100] that would take out the colour cast: grey world without the extreme
    percentiles of brightness, blended with the near-white pixels where there are enough. Nothing moves; the percentiles are
    exact. An image without pixels, or a black one, has zeros."""
    def cast_of(r: float, g: float, b: float) -> tuple[float, float, float]:
        mean = (r + g + b) / 3.0
        return (mean, (b - r) / mean * SENSITIVITY, -((g - (r + b) / 2.0) / mean) * SENSITIVITY) if mean else (0.0, 0.0, 0.0)

    def balance(pixels) -> tuple[float, float]:
        if pixels is None or not len(pixels):
            return 0.0, 0.0
        rgb = channels(pixels)
        lum = brightness(*rgb)
        upto, total = np.bincount(lum, minlength=256).cumsum(), len(lum)
        low, high = (int((upto > place).argmax()) for place in (min(total - 1, int(total * CLIP_LOW)), int(total * (1.0 - CLIP_HIGH))))
        inside = (lum >= low) & (lum <= high)
        n = int(inside.sum())
        mean, *world = cast_of(*(int(c[inside].sum()) / n for c in rgb)) if n else (0.0, 0.0, 0.0)
        if not mean > 0:
            return 0.0, 0.0
        patch = (lum >= PATCH_LOW) & (lum <= PATCH_HIGH) & (np.maximum.reduce(rgb) < 255)
        if (hn := int(patch.sum())) >= PATCH_PIXELS:
            bright, *white = cast_of(*(int(c[patch].sum()) / hn for c in rgb))
            if bright > 0:
                world = [w * (1.0 - PATCH_WEIGHT) + v * PATCH_WEIGHT for w, v in zip(world, white, strict=True)]
        return tuple(max(-100.0, min(100.0, w)) for w in world)

    def balanced(batches):
        for batch in batches:
            out = pd.DataFrame([balance(p) for p in batch["pixels"]], columns=["temperature", "tint"], dtype=float)
            yield out.assign(file_id=batch["file_id"].to_numpy())

    kind = images.schema["file_id"].dataType.simpleString()
    return images.select("file_id", "pixels").mapInPandas(balanced, f"file_id {kind}, temperature double, tint double")


def spans(size: int, made: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of `made` cells the first pixel of `size` and the one after its last; at least one pixel each."""
    at = np.arange(made + 1) * size // made
    return at[:-1], np.maximum(at[:-1] + 1, at[1:])


def resized(plane: np.ndarray, width: int, height: int) -> np.ndarray:
    """The plane's means over the cells of a width x height grid, rounded half up to integers."""
    (y0, y1), (x0, x1) = spans(plane.shape[0], height), spans(plane.shape[1], width)
    sums = np.zeros((plane.shape[0] + 1, plane.shape[1] + 1), np.int64)
    sums[1:, 1:] = plane.cumsum(axis=0, dtype=np.int64).cumsum(axis=1)
    total = sums[y1][:, x1] - sums[y0][:, x1] - sums[y1][:, x0] + sums[y0][:, x0]
    n = (y1 - y0)[:, None] * (x1 - x0)[None, :]
    return (2 * total + n) // (2 * n)


def channels(pixels) -> list[np.ndarray]:
    p = np.asarray(pixels, np.int32)
    return [p >> 16 & 255, p >> 8 & 255, p & 255]


def planes(pixels, width: int, height: int) -> list[np.ndarray]:
    return channels(np.asarray(pixels, np.int32)[: width * height].reshape(height, width))


def brightness(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 77 * r + 150 * g + 29 * b >> 8


def ramp(value: float, ends: tuple[float, float]) -> float:
    return min(1.0, max(0.0, (value - ends[0]) / (ends[1] - ends[0])))


def noise(lum: np.ndarray) -> float:
    """Root mean square of the Laplacian inside the flattest tile, the first of equal ones."""
    lum = lum.astype(np.int64)
    h, w = lum.shape
    if h < TILE or w < TILE:
        return 0.0
    s = np.zeros((2, h + 1, w + 1), np.int64)
    s[0, 1:, 1:], s[1, 1:, 1:] = lum.cumsum(axis=0).cumsum(axis=1), (lum * lum).cumsum(axis=0).cumsum(axis=1)
    y, x = np.arange(0, h - TILE + 1, TILE_STEP)[:, None], np.arange(0, w - TILE + 1, TILE_STEP)[None, :]
    total, squares = (t[y + TILE, x + TILE] - t[y, x + TILE] - t[y + TILE, x] + t[y, x] for t in s)
    n = TILE * TILE
    mean = total / n
    at = int((squares / n - mean * mean).argmin())
    top, left = at // x.shape[1] * TILE_STEP, at % x.shape[1] * TILE_STEP
    t = lum[top : top + TILE, left : left + TILE]
    v = t[:-2, 1:-1] + t[2:, 1:-1] + t[1:-1, :-2] + t[1:-1, 2:] - 4 * t[1:-1, 1:-1]
    return float(np.sqrt((v * v).sum() / v.size))


def issue_scores(images: DataFrame) -> DataFrame:
    """file_id and four scores from 0 (fine) to 1: low_light (mean brightness), noise (the flattest tile's residual), haze
    (mean of the darkest channel), low_resolution. All but the last on an image of at most 256 pixels a side. An image
    without pixels is dark and small; one that no tile fits has no noise."""
    def score(pixels, width: int, height: int) -> tuple[float, float, float]:
        if not width * height:
            return 1.0, 0.0, 0.0
        p = planes(pixels, width, height)
        scale = WORKING_EDGE / max(width, height)
        if scale < 1:
            p = [resized(c, max(8, round(width * scale)), max(8, round(height * scale))) for c in p]
        lum = brightness(*p)
        return 1 - ramp(lum.sum() / lum.size, LOW_LIGHT), ramp(noise(lum), NOISE), ramp(np.minimum.reduce(p).sum() / lum.size, HAZE)

    def scored(batches):
        for batch in batches:
            got = [score(p if p is not None else [], int(w), int(h)) for p, w, h in zip(batch["pixels"], batch["width"], batch["height"], strict=True)]
            out = pd.DataFrame(got, columns=["low_light", "noise", "haze"], dtype=float)
            yield out.assign(file_id=batch["file_id"], width=batch["width"], height=batch["height"])

    kind = images.schema["file_id"].dataType.simpleString()
    rows = images.select("file_id", "width", "height", "pixels").mapInPandas(scored, f"file_id {kind}, width long, height long, low_light double, noise double, haze double")
    size = F.col("width") * F.col("height") / 1_000_000
    small = F.least(F.greatest((MEGAPIXELS[1] - size) / (MEGAPIXELS[1] - MEGAPIXELS[0]), F.lit(0.0)), F.lit(1.0))
    return rows.select("file_id", "low_light", "noise", "haze", small.alias("low_resolution"))


def perceptual_hash(images: DataFrame) -> DataFrame:
    """file_id and hash, 64 bits: the image's brightness as 32 x 32 means, its 8 x 8 lowest cosine frequencies (a product
    with a fixed matrix on either side), a bit for each that reaches the median of those but the first. Coefficients count
    to six places, so that flat images hash alike everywhere. No hash without pixels."""
    k, n = np.arange(HASH_LOW)[:, None], np.arange(HASH_EDGE)[None, :]
    cosines = np.cos(np.pi * (2 * n + 1) * k / (2.0 * HASH_EDGE))

    def bits(pixels, width: int, height: int) -> int | None:
        if pixels is None or not width * height:
            return None
        grey = resized(brightness(*planes(pixels, width, height)), HASH_EDGE, HASH_EDGE)
        c = np.round(cosines @ grey @ cosines.T, 6).ravel()
        rest = np.sort(c[1:])
        median = (rest[len(rest) // 2 - 1] + rest[len(rest) // 2]) / 2
        return int(np.packbits(c >= median, bitorder="little").view("<i8")[0])

    def hashed(batches):
        for batch in batches:
            got = [bits(p, int(w), int(h)) for p, w, h in zip(batch["pixels"], batch["width"], batch["height"], strict=True)]
            yield pd.DataFrame({"file_id": batch["file_id"], "hash": pd.array(got, dtype="Int64")})

    kind = images.schema["file_id"].dataType.simpleString()
    return images.select("file_id", "width", "height", "pixels").mapInPandas(hashed, f"file_id {kind}, hash long")


def detection_decode(tensors: DataFrame, cells: int, least: float) -> DataFrame:
    """file_id, cell, class, score and box of the cells whose best class scores at least `least`; the lowest of equals.

    A tensor row has values, laid out channel by channel over `cells` cells (centre x and y, width, height, then a score
    per class), and the letterbox: scale, pad_x, pad_y, full_width, full_height. Boxes are in the image's own pixels (left,
    top, box_width, box_height), clamped to it.
    """
    rows = tensors.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))

    def channel(c: Column | int) -> Column:
        return F.get("values", (F.lit(c) * cells + F.col("cell")).cast("int")).cast("double")

    classes = (F.size("values") / cells).cast("int") - 4
    scores = F.transform(F.sequence(F.lit(0), classes - 1), lambda c: F.get("values", ((c + 4) * cells + F.col("cell")).cast("int")).cast("double"))
    rows = rows.filter(classes > 0).withColumn("scores", scores).withColumn("score", F.array_max("scores")).filter(F.col("score") >= least)

    def side(centre: int, size: int, pad: str, limit: str) -> tuple[Column, Column]:
        at, half = (channel(centre) - F.col(pad)) / F.col("scale"), channel(size) / F.col("scale") / 2
        low, high = (F.least(F.greatest(v, F.lit(0.0)), F.col(limit).cast("double")) for v in (at - half, at + half))
        return low, high - low

    (left, width), (top, height) = side(0, 2, "pad_x", "full_width"), side(1, 3, "pad_y", "full_height")
    at = (F.array_position("scores", F.col("score")) - 1).cast("int")
    return rows.select("file_id", "cell", at.alias("class"), "score", left.alias("left"), top.alias("top"), width.alias("box_width"), height.alias("box_height"))
