"""Images, detector tensors, landmarks and detections derived from the supplied tables, with the SQL of the same rows."""

from __future__ import annotations

from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions.geo import EARTH_M

M_PER_DEG = pi / 180 * EARTH_M
WIDTH, FOV = 4000.0, 60.0

#: A document's characters as pixels, row by row, the last row filled with black; four kinds of contrast, grey or coloured.
_VALUE = "case {id} % 4 when 0 then ({o} * 37 + {i}) % 256 when 1 then 100 + {o} % 8 when 2 then {o} % 128 else 190 + {o} % 66 end"
_PIXEL = "case when {id} % 12 < 4 then {v} * 65793 else {v} * 65536 + ({v} * 3 // 4 + 20) * 256 + ({v} + 40) % 256 end"


@F.arrow_udf(ArrayType(IntegerType()))
def _pixels(text: pa.Array, kind: pa.Array, grey: pa.Array, size: pa.Array) -> pa.Array:
    """_VALUE and _PIXEL over a whole text at once: its code points, then black up to size."""
    ends = np.concatenate([[0], np.cumsum(size.to_numpy())])
    out = np.zeros(ends[-1], np.int32)
    for at, k, g, t in zip(ends.tolist(), kind.to_pylist(), grey.to_pylist(), text, strict=False):
        o = np.frombuffer(t.as_py().encode("utf-32-le"), "<i4")
        v = (o * 37 + np.arange(len(o), dtype=np.int32)) & 255 if k == 0 else 100 + (o & 7) if k == 1 else o & 127 if k == 2 else 190 + (o - o // 66 * 66)
        out[at : at + len(o)] = v * 65793 if g else (v << 16) + ((v * 3 >> 2) + 20 << 8) + (v + 40 & 255)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, width, height, pixels (0xRRGGBB)."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("file_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("width", 40 + F.col("file_id") % 25).withColumn("height", F.ceil(F.length("text") / F.col("width")))
    return d.select("file_id", "width", "height", _pixels("text", F.col("file_id") % 4, F.col("file_id") % 12 < 4, F.col("width") * F.col("height")).alias("pixels"))


#: file_id, width, height, i, p: a row a pixel.
PIXELS = f"""(select file_id, width, height, i, case when i < len(o) then {_PIXEL.format(id='file_id', v='(' + _VALUE.format(id='file_id', o='o[i + 1]', i='i') + ')')} else 0 end p
  from (select *, unnest(range(width * height)) i from (select *, cast(ceil(len(o) / width) as bigint) height from
    (select doc_id file_id, 40 + doc_id % 25 width, list_transform(case when coalesce(text, '') = '' then [] else string_split(text, '') end, lambda c: unicode(c)) o from documents))))"""
LUM = "(77 * (p // 65536) + 150 * (p // 256 % 256) + 29 * (p % 256)) // 256"


def tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, values (8 channels of 8 cells) and letterbox of every vector read as a detector's output."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    values = F.transform("embedding", lambda x, i: F.when(i < 32, F.abs(x.cast("double")) * 2000).otherwise(x.cast("double")))
    box = {"scale": F.lit(0.5), "pad_x": F.lit(16.0), "pad_y": (F.col("vec_id") % 3 * 8).cast("double"), "full_width": F.lit(1000), "full_height": 600 + F.col("vec_id") % 5 * 100}
    return e.select(F.col("vec_id").alias("file_id"), values.alias("values"), *[v.alias(k) for k, v in box.items()])


#: Customers' photos of three or four landmarks at known angles from the camera; some angles too small, some pixels wrong.
_LANDMARKS = f"""select c_custkey as photo_id, k as ord, lat0 + dist * cos(radians(toward)) / {M_PER_DEG!r}e0 as lat,
    lon0 + dist * sin(radians(toward)) / ({M_PER_DEG!r}e0 * cos(radians(lat0))) as lon, (turn / {FOV:.0f}e0 + 5e-1) * {WIDTH:.0f}e0 + case when c_custkey % 13 = 0 and k = 1 then 900e0 else 0e0 end as pixel_x
  from (select *, c_custkey * 7 % 360 + turn as toward from
    (select c_custkey, k, cast((c_custkey * 37) % 120 - 60 as double) as lat0, cast((c_custkey * 91) % 360 - 180 as double) as lon0,
      cast(400 + (c_custkey * 13 + k * 700) % 2600 as double) as dist,
      case k when 0 then -25e0 + c_custkey % 9 when 1 then case when c_custkey % 11 = 0 then -24.7e0 + c_custkey % 9 else -5e0 + c_custkey % 13 end when 2 then 14e0 + c_custkey % 12 else 29e0 end as turn
     from customer cross join (values (0), (1), (2), (3)) ks(k) where k < 3 or c_custkey % 2 = 0) a) b"""


def landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """photo_id, ord, lat, lon, pixel_x."""
    return spark.sql(_LANDMARKS.replace("from customer", "from {customer}"), customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))


LANDMARKS = f"({_LANDMARKS})"
