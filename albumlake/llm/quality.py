"""Weak supervision of document quality: rules vote or abstain, EM estimates their accuracies, the posterior decides.

All columns are native expressions; only the counts of vote patterns (at most 3^rules rows, whatever the input) reach the
driver, where EM runs on those of the documents that pass the base rule. The model has two classes; in each, a rule votes
good, bad or abstains at rates of its own, independently of the other rules. Junk seldom breaks every rule: in the bad
class a rule keeps a rate of at least MIN_BAD for bad and MIN_GOOD for good votes, so one kind of junk that is common in a
corpus does not clear the others.

Null and empty texts have no words, fail the base rule and are not kept; an empty table gives an empty result. Equal
texts get equal verdicts. Result columns replace input columns of the same name (compared without case); other columns
are passed on.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GAP, free_prefix, materialise, table

MIN_WORDS, MAX_REPEAT_PCT = 50, 50
KEEP_AT = 0.5
MIN_BAD, MIN_GOOD = 0.1, 0.3
BLANKS = " \t\n\x0b\x0c\r"
#: A word without a letter or digit.
BARE = r"(?:^|[\x20\x09-\x0D])[^\p{L}\p{N}\x20\x09-\x0D]+(?=[\x20\x09-\x0D]|$)"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_letters", "n_bare_words", "n_short_words", "n_ends"]


def signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs plus the BASE and MORE counts (long).

    A repeated window is found by sorting (hash of the window, position) keys inside the row and comparing neighbours, so
    a row costs n log n and nothing is shuffled. The low bits of a key hold the position, as many as the row needs.
    """
    p = free_prefix(docs)
    t, w, lines, n, low, g, r = (F.col(p + x) for x in ("t", "w", "lines", "n", "low", "g", "r"))
    d = docs.withColumn(p + "t", F.coalesce(F.col(text), F.lit("")))
    d = d.withColumn(p + "w", F.split(F.trim(t, F.lit(BLANKS)), GAP))
    d = d.withColumn(p + "n", F.when(F.get(w, F.lit(0)) == "", 0).otherwise(F.size(w)))
    # Only a text with an equal pair of lines needs the lines with a word.
    some = F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != "")
    d = d.withColumn(p + "lines", F.when(F.contains(t, F.lit("\n")), some))
    d = d.withColumn(p + "low", F.call_function("shiftleft", F.lit(1).cast("long"), F.ceil(F.log2(F.greatest(n, F.lit(2)))).cast("int")))
    key = F.transform(
        F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))),
        lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(-low).bitwiseOR(i),
    )
    d = d.withColumn(p + "g", F.when(n >= 4, F.sort_array(key)))
    twin = F.filter(g, lambda x, k: (F.get(g, k - 1).bitwiseXOR(x) < low) & (F.get(g, k - 1).bitwiseXOR(x) >= 0) | (F.get(g, k + 1).bitwiseXOR(x) < low) & (F.get(g, k + 1).bitwiseXOR(x) >= 0))
    d = d.withColumn(p + "r", F.sort_array(F.transform(twin, lambda x: x.bitwiseAND(low - 1))))
    covered = F.aggregate(
        F.transform(r, lambda x, k: F.least(F.lit(3).cast("long"), F.coalesce(F.get(r, k + 1) - x, F.lit(3).cast("long")))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )

    def held(chars: str) -> Column:
        return F.length(t) - F.length(F.translate(t, chars, ""))

    made = {
        # Never null; a row-numbering function keeps later filters above this projection. Pushed below, they would
        # put the sorts inside the lambdas and run them once per word.
        "n_words": F.when(F.monotonically_increasing_id() >= 0, n),
        "word_chars": F.length(F.translate(t, BLANKS, "")),
        "n_symbols": held("#*$%&|<>"),
        "n_dup_lines": F.coalesce(F.size(lines) - F.size(F.array_distinct(lines)), F.lit(0)),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_letters": F.length(F.regexp_replace(t, r"\P{L}+", "")),
        "n_bare_words": F.regexp_count(t, F.lit(BARE)),
        "n_short_words": F.size(F.filter(w, lambda x: F.length(x).between(1, 3))),
        "n_ends": held(".!?。！？…"),
    }
    d = d.withColumns({p + c: e.cast("long") for c, e in made.items()})
    taken = {c.lower() for c in made}
    return d.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken], *[F.col(p + c).alias(c) for c in made])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))


def votes() -> dict[str, Column]:
    """Labelling functions: 1 votes good, -1 bad, 0 abstains. Integer arithmetic, so SQL gives the same votes."""
    n, c, s, d, r, letters, bare, short, ends = (F.col(x) for x in BASE + MORE)

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    return {
        "v_mean_word": vote((2 * n > c) | (c > 10 * n), (c >= 3 * n) & (c <= 7 * n)),
        "v_symbols": vote(5 * s > n, 50 * s <= n),
        "v_letters": vote(100 * letters < 85 * c, 100 * letters >= 92 * c),
        "v_bare": vote(5 * bare > n, 50 * bare <= n),
        "v_short": vote(20 * short < n, 10 * short >= n),
        "v_ends": vote(100 * ends < n, 50 * ends >= n),
        "v_dup_lines": vote(d >= 4, d == 0),
        "v_repeats": vote(100 * r > 35 * n, 100 * r <= 10 * n),
    }


Pattern = tuple[int, ...]
#: A class: its share, and per rule the rates of bad, no and good votes.
Model = list[tuple[float, list[tuple[float, float, float]]]]
START: Callable[[int], Model] = lambda k: [(0.9, [(0.02, 0.08, 0.9)] * k), (0.1, [(0.45, 0.15, 0.4)] * k)]


def fit_em(patterns: list[tuple[Pattern, int]], rounds: int = 60) -> Model:
    """The good and the bad class of independent votes; ten made-up documents hold each class at its start, so an empty
    input returns the start."""
    k = len(patterns[0][0]) if patterns else 0
    model = START(k)
    for _ in range(rounds):
        sums = [[10 * share, [[10 * share * x for x in rates] for rates in start]] for share, start in START(k)]
        for pattern, count in patterns:
            p = posterior(pattern, model)
            for side, q in ((sums[0], p), (sums[1], 1 - p)):
                side[0] += q * count
                for j, v in enumerate(pattern):
                    side[1][j][v + 1] += q * count
        total = sums[0][0] + sums[1][0]
        model = [(size / total, [tuple(x / sum(rule) for x in rule) for rule in rules]) for size, rules in sums]
        model[1] = (model[1][0], [floored(r) for r in model[1][1]])
    return model


def floored(rates: tuple[float, float, float]) -> tuple[float, float, float]:
    bad, none, good = max(rates[0], MIN_BAD), rates[1], max(rates[2], MIN_GOOD)
    return bad / (bad + none + good), none / (bad + none + good), good / (bad + none + good)


def log_odds(model: Model) -> tuple[float, list[tuple[float, float, float]]]:
    """Log odds of the good class: of no vote at all, and what each rule's bad, no or good vote adds."""
    (good, a), (bad, b) = model
    return math.log(good / bad), [tuple(math.log(x / y) for x, y in zip(p, q, strict=True)) for p, q in zip(a, b, strict=True)]


def posterior(pattern: Pattern, model: Model) -> float:
    start, steps = log_odds(model)
    z = start + sum(step[v + 1] for v, step in zip(pattern, steps, strict=True))
    return 1 / (1 + math.exp(-z))


def fit(judged: DataFrame) -> Model:
    """Fit on the vote patterns of documents that pass the base rule."""
    names = list(votes())
    counts = judged.filter(~base_failed()).select(*[v.alias(x) for x, v in votes().items()]).groupBy(*names).count().collect()
    patterns = sorted((tuple(r[x] for x in names), r["count"]) for r in counts)
    return fit_em(patterns) if patterns else START(len(names))


def judge(counted: DataFrame, model: Model) -> DataFrame:
    """counted plus the votes, quality (posterior probability of the good class), base_failed and kept."""
    start, steps = log_odds(model)
    out = counted.withColumns({**votes(), "base_failed": base_failed()})
    z = F.lit(start)
    for name, (bad, none, good) in zip(votes(), steps, strict=True):
        z = z + F.when(F.col(name) < 0, bad).when(F.col(name) > 0, good).otherwise(none)
    out = out.withColumn("quality", 1 / (1 + F.exp(-z)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_AT))


def weak_supervision(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs plus the counts, the votes, quality, base_failed and kept. The counts are written once, for fit and verdict."""
    counted = materialise(signals(docs, text), codec="zstd")
    return judge(counted, fit(counted))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = materialise(signals(docs).drop("text"))
    return judge(counted, fit(counted)).select("doc_id", *BASE, "base_failed", "kept", "quality")
