"""Weighted URL vocabulary: strict and soft terms found with Aho-Corasick, after host/path allow and block rules.

A null url, or one without ://, has an empty host and path and fits no rule; terms are looked for in the whole url, so a
null or empty one is allowed. Equal urls get equal verdicts, repeated rows stay rows; other columns are passed on by
url_vocabulary, whose own column replaces one of its name. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
STRICT = ("porn", "xxx", "casino", "viagra", "warez", "spam-farm", "cheap-pills", "escort", "phishing")
SOFT = ("cheap", "pills", "spam", "farm", "bet", "poker", "loan", "bonus", "sex", "adult", "crack", "torrent", "hack", "prize", "win")
SOFT_LIMIT = 2


def host_path(url) -> tuple[F.Column, F.Column]:
    """(host with A-Z lower-cased, path): both empty for null or without ://."""
    u = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, u.substr(F.instr(u, "://") + 3, F.length(u))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_columns(host, path, rules=RULES) -> tuple[F.Column, F.Column]:
    """(rule text, its verdict) of the longest fitting rule, null where none fits."""
    whens = None
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        hit = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        whens = F.when(fits, hit) if whens is None else whens.when(fits, hit)
    return whens["rule"], whens["verdict"]


@lru_cache(maxsize=4)
def _automaton(strict: tuple, soft: tuple):
    import ahocorasick

    a = ahocorasick.Automaton()
    for weight, terms in ((2, strict), (1, soft)):
        for t in terms:
            a.add_word(t, (t, weight))
    a.make_automaton()
    return a


def term_hits(url: str | None, strict=STRICT, soft=SOFT) -> tuple[list[str], list[str]]:
    """(distinct strict terms, distinct soft terms) of a url, with no letter or digit on either side of a hit."""
    low = (url or "").lower()
    found: tuple[set, set] = (set(), set())
    for end, (term, weight) in _automaton(tuple(strict), tuple(soft)).iter(low):
        start = end - len(term) + 1
        if not (start and low[start - 1].isalnum()) and not (end + 1 < len(low) and low[end + 1].isalnum()):
            found[2 - weight].add(term)
    return sorted(found[0]), sorted(found[1])


#: Terms of a vocabulary table that fit in an automaton (about 30 MB); more are an error.
MAX_TERMS = 200_000


def read_terms(terms: DataFrame) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """The strict and soft terms of a table (term, strict boolean), in lower case; blank and null ones are left out, one
    that is both is strict."""
    rows = terms.filter("trim(term) <> ''").groupBy(F.lower(F.trim("term")).alias("term")).agg(F.max(F.coalesce("strict", F.lit(False))).alias("strict")).limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"the vocabulary has over {MAX_TERMS} terms")
    return tuple(tuple(sorted(r["term"] for r in rows if r["strict"] == side)) for side in (True, False))


def url_vocabulary(pages: DataFrame, url: str = "url", strict=STRICT, soft=SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """pages plus term_hit struct(strict, soft, rejected)."""

    @F.pandas_udf("struct<strict array<string>, soft array<string>, rejected boolean>")
    def judge(urls: pd.Series) -> pd.DataFrame:
        hits = [term_hits(u, strict, soft) for u in urls]
        return pd.DataFrame({"strict": [h[0] for h in hits], "soft": [h[1] for h in hits], "rejected": [bool(h[0]) or len(h[1]) >= soft_limit for h in hits]})

    return pages.withColumn("term_hit", judge(F.col(url)))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = host_path(F.col("url"))
    judged = url_vocabulary(pages).withColumn("host", host).withColumn("path", path)
    rule, verdict = rule_columns(F.col("host"), F.col("path"))
    fallback = F.when(F.col("term_hit.rejected"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, fallback).alias("verdict"))
