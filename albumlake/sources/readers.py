"""Metadata documents in text columns: GPX tracks, XMP sidecars, bookmark lists and people registries."""

from __future__ import annotations

from functools import reduce
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..functions.geo import dms_parse, is_valid_gps


def read_gpx(tracks: DataFrame, xml: str = "xml") -> DataFrame:
    """track_id, captured, lat, lon of every track, route and way point, in any namespace, with a place and a time."""
    # One path for all kinds of points: a document is parsed three times, for its places and its times.
    kinds = " or ".join(f"local-name()='{k}'" for k in ("trkpt", "rtept", "wpt"))
    point = f"//*[({kinds}) and @lat and @lon and *[local-name()='time']]"
    found = F.arrays_zip(*[F.xpath(F.col(xml), F.lit(point + tail)).alias(n) for n, tail in (("lat", "/@lat"), ("lon", "/@lon"), ("time", "/*[local-name()='time'][1]/text()"))])
    rows = tracks.select("track_id", F.explode(found).alias("p"))
    at = F.try_to_timestamp(F.regexp_replace("p.time", "Z$", "+00:00")).cast("timestamp_ntz")
    return rows.select("track_id", at.alias("captured"), F.col("p.lat").try_cast("double").alias("lat"), F.col("p.lon").try_cast("double").alias("lon")).filter("captured is not null and lat is not null and lon is not null")


def _sidecar(xml: str | None) -> dict:
    """The texts of one sidecar by local name. A document with a type declaration is not read: it could define entities."""
    out: dict = {"keywords": []}
    try:
        root = ElementTree.fromstring(xml) if xml and "<!DOCTYPE" not in xml else None
    except ElementTree.ParseError:
        root = None
    for e in root.iter() if root is not None else ():
        name = e.tag.rsplit("}", 1)[-1]
        items = [i.text for i in e.iter() if i.tag.rsplit("}", 1)[-1] == "li" and i.text]
        if name == "subject":
            out["keywords"] = items
        elif name == "title":
            out["title"] = items[0] if items else None
        elif name in ("GPSLatitude", "GPSLongitude", "Rating", "Label"):
            out.setdefault(name, e.text)
        for key, value in e.attrib.items():
            out.setdefault(key.rsplit("}", 1)[-1], value)
    return out


def read_xmp_sidecars(sidecars: DataFrame, xml: str = "xml") -> DataFrame:
    """path, lat, lon, rating, label, title, keywords of a sidecar's XML; what is missing or does not parse is null."""
    fields = ["GPSLatitude", "GPSLongitude", "Rating", "Label", "title", "keywords"]

    @F.pandas_udf("GPSLatitude string, GPSLongitude string, Rating string, Label string, title string, keywords array<string>")
    def parse(texts: pd.Series) -> pd.DataFrame:
        found = [_sidecar(t) for t in texts]
        return pd.DataFrame({f: pd.Series([x.get(f) for x in found], dtype=object) for f in fields})

    s = sidecars.select("path", parse(xml).alias("s"))
    return s.select("path", dms_parse(F.col("s.GPSLatitude")).alias("lat"), dms_parse(F.col("s.GPSLongitude")).alias("lon"), F.col("s.Rating").try_cast("int").alias("rating"), F.col("s.Label").alias("label"), F.col("s.title").alias("title"), F.col("s.keywords").alias("keywords"))


def read_bookmarks(lists: DataFrame, col: str = "json") -> DataFrame:
    """Bookmarks of JSON lists; blank names and impossible places are dropped, an unreadable list is empty."""
    kind = "array<struct<name:string,lat:double,lon:double,radius_m:double>>"
    rows = lists.select(F.explode(F.from_json(F.col(col), kind)).alias("b")).select("b.*")
    return rows.filter((F.trim(F.coalesce("name", F.lit(""))) != "") & is_valid_gps(F.col("lat"), F.col("lon")))


def read_people_registry(registries: DataFrame, col: str = "json") -> DataFrame:
    """name, ref_no, embedding of a JSON map from name to vectors; an unreadable one is empty."""
    people = F.from_json(F.col(col), "map<string,array<array<double>>>")
    rows = registries.select(F.explode(people).alias("name", "refs"))
    return rows.select("name", F.posexplode("refs").alias("ref_no", "embedding"))


# Element names of the region lists of photo sidecars, region types and the categories they stand for.
REGION_XML = """RDF struct<Description: array<struct<Regions: struct<RegionList: struct<Bag: struct<li: array<struct<
  Area: struct<_x: string, _y: string, _w: string, _h: string>, Name: string, Type: string, category: string, status: string, source: string, embedding: string>>>>>>>>"""
TYPES = {"face": "Person", "pet": "Animal", "focus": "Item", "barcode": "Item", "": "Item"}
CATEGORIES, STATUSES = ["Person", "Animal", "Item", "Place", "Other"], ["Proposed", "Accepted"]


def one_of(text: Column, names: list[str]) -> Column:
    """The name of the list that text is but for case; else null."""
    return F.create_map(*[F.lit(x) for n in names for x in (n.lower(), n)])[F.lower(F.trim(text))]


def rational(text: Column) -> Column:
    """A number, or the quotient of 'n/d' of integers; else null."""
    n, d = (F.regexp_extract(text, r"^\s*([+-]?\d+)/([+-]?\d+)\s*$", i).try_cast("long") for i in (1, 2))
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.trim(text).try_cast("double"))


def undeclared(text: Column) -> Column:
    """A document's text; null where it declares types, in any case. The text is searched as it is: to change the case of all of
    it costs a fifth of its parse."""
    return F.when(~text.rlike("(?i)<!DOCTYPE"), text)


@F.pandas_udf(ArrayType(FloatType()))
def floats(data: pd.Series) -> pd.Series:
    """Little-endian float32 values; null where the bytes are none or no whole number of them."""
    return pd.Series([np.frombuffer(b, "<f4") if b and len(b) % 4 == 0 else None for b in data], dtype=object)


def sidecar_regions(sidecars: DataFrame, xml: str = "xml") -> DataFrame:
    """path, idx, x, y, w, h, category, label, status, source, embedding of a sidecar's region list, numbered in order.

    Areas give the centre; a region without four numbers is left out. The region's own category counts, else its type; a
    missing or unknown status is Accepted; blank names and sources are null. Embeddings are base64 of little-endian float32;
    what does not decode is null. A document that does not parse, or declares types, has no regions.
    """
    text = undeclared(F.col(xml))
    rows = sidecars.select("path", F.from_xml(text, REGION_XML, {"ignoreNamespace": "true"}).alias("x"))
    items = F.flatten(F.transform(F.filter("x.RDF.Description", lambda d: d["Regions"]["RegionList"]["Bag"]["li"].isNotNull()), lambda d: d["Regions"]["RegionList"]["Bag"]["li"]))
    area = [f"Area._{c}" for c in "xywh"]
    whole = F.filter(items, lambda r: reduce(lambda a, b: a & b, [F.trim(r["Area"][f"_{c}"]).try_cast("double").isNotNull() for c in "xywh"]))
    rows = rows.select("path", F.posexplode(whole).alias("idx", "r")).select("path", "idx", "r.*")
    cx, cy, w, h = (F.trim(F.col(a)).try_cast("double") for a in area)
    kind = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])[F.lower(F.coalesce("Type", F.lit("")))]
    return rows.select(
        "path", "idx", (cx - w / 2).alias("x"), (cy - h / 2).alias("y"), w.alias("w"), h.alias("h"),
        F.coalesce(one_of(F.col("category"), CATEGORIES), kind, F.lit("Other")).alias("category"), F.nullif(F.col("Name"), F.lit("")).alias("label"),
        F.coalesce(one_of(F.col("status"), STATUSES), F.lit("Accepted")).alias("status"), F.nullif(F.col("source"), F.lit("")).alias("source"),
        floats(F.try_to_binary(F.trim("embedding"), F.lit("base64"))).alias("embedding"),
    )


# Element names of photo sidecars. Plain texts, texts in several languages, and lists.
TEXTS = """GPSLatitude GPSLongitude GPSAltitude GPSAltitudeRef Rating Label Pick Reject Location City State Country CountryCode Headline Credit
Source Instructions DateCreated CaptionWriter TransmissionReference DigitalSourceType WebStatement ImageRating AuthorsPosition ModelReleaseStatus
PropertyReleaseStatus DataMining SupplierImageId""".split()
LANGUAGES = "title description rights UsageTerms AltTextAccessibility ExtDescrAccessibility Event".split()
LISTS = {"subject": "Bag", "PersonInImage": "Bag", "Genre": "Bag", "EventId": "Bag", "creator": "Seq"}
PLAIN = {
    "Label": "label", "Location": "location", "City": "city", "State": "state", "Country": "country", "CountryCode": "country_code", "Headline": "headline",
    "Credit": "credit", "Source": "source", "Instructions": "instructions", "CaptionWriter": "caption_writer", "TransmissionReference": "job_id",
    "DigitalSourceType": "digital_source", "WebStatement": "web_statement", "AuthorsPosition": "creator_job_title", "ModelReleaseStatus": "model_release",
    "PropertyReleaseStatus": "property_release", "DataMining": "data_mining", "SupplierImageId": "supplier_image_id",
}


def true_or_false(text: Column) -> Column:
    """Of the words true and false, in any case; else null."""
    return F.when(F.lower(F.trim(text)) == "true", True).when(F.lower(F.trim(text)) == "false", False)


def sidecar_metadata(sidecars: DataFrame, xml: str = "xml") -> DataFrame:
    """path and a sidecar's fields: place and altitude, rating, label, pick and reject, texts, place names, rights, people and
    keywords; in one typed parse, without Python.

    Of texts in several languages the x-default one counts, else the first. Blank values are null, lists without their
    blanks; altitudes below the sea (reference 1) are negative; a place needs both coordinates. A document that does not
    parse, or declares types, has nulls and empty lists. Of several descriptions the first that has a field gives it.
    """
    kinds = [f"{t}: string" for t in TEXTS] + [f"{t}: struct<Alt: struct<li: array<struct<_VALUE: string, _lang: string>>>>" for t in LANGUAGES]
    kinds += [f"{t}: struct<{kind}: struct<li: array<string>>>" for t, kind in LISTS.items()]
    text = undeclared(F.col(xml))
    x = F.from_xml(text, f"RDF struct<Description: array<struct<{', '.join(kinds)}>>>", {"ignoreNamespace": "true"})
    rows = sidecars.select("path", x.alias("x")).select("path", F.col("x.RDF.Description").alias("d"))

    def field(name: str) -> Column:
        return F.get(F.filter(F.transform("d", lambda d: d[name]), lambda v: v.isNotNull()), F.lit(0))

    def filled(c: Column) -> Column:
        return F.when(F.trim(c) != "", c)

    def spoken(name: str) -> Column:
        said = field(name)["Alt"]["li"]
        return filled(F.coalesce(F.get(F.filter(said, lambda v: v["_lang"] == "x-default"), F.lit(0)), F.get(said, F.lit(0)))["_VALUE"])

    def listed(name: str) -> Column:
        items = field(name)[LISTS[name]]["li"]
        return F.coalesce(F.filter(items, lambda v: F.coalesce(v, F.lit("")) != ""), F.array().cast("array<string>"))

    lat, lon = dms_parse(field("GPSLatitude")), dms_parse(field("GPSLongitude"))
    altitude = rational(field("GPSAltitude"))
    out = {
        "lat": F.when(lon.isNotNull(), lat), "lon": F.when(lat.isNotNull(), lon),
        "altitude": F.when(lat.isNotNull() & lon.isNotNull(), F.when(F.trim(field("GPSAltitudeRef")) == "1", -altitude).otherwise(altitude)),
        "rating": F.trim(field("Rating")).try_cast("int"), "is_pick": true_or_false(field("Pick")), "is_reject": true_or_false(field("Reject")),
        "iptc_rating": F.trim(field("ImageRating")).try_cast("double"), "date_created": F.try_to_timestamp(F.trim(field("DateCreated"))).cast("timestamp_ntz"),
        "title": spoken("title"), "caption": spoken("description"), "copyright": spoken("rights"), "usage_terms": spoken("UsageTerms"), "event": spoken("Event"),
        "alt_text": spoken("AltTextAccessibility"), "extended_description": spoken("ExtDescrAccessibility"),
        "keywords": listed("subject"), "persons_shown": listed("PersonInImage"), "creator": F.get(listed("creator"), F.lit(0)), "genre": F.get(listed("Genre"), F.lit(0)),
        "event_id": F.get(listed("EventId"), F.lit(0)), **{made: filled(field(name)) for name, made in PLAIN.items()},
    }
    return rows.select("path", *[c.alias(n) for n, c in out.items()])
