import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from albumlake.llm import common, htmltree, jaccard, langid, media, mixing, order, quality, toxicity, urls, wfst

DATA = "/root/testdata/sf0.01"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "one two"), (6, "a b c d e f g " * 2000), (6, "a b c d e f g " * 2000)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None, None, -1) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, label int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} if w else set()
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in sets.items():
        common = {}
        for x in s:
            for j in where[x]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, c in common.items():
            if 100 * c >= 80 * (len(s) + len(sets[j]) - c):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("small,leaf,level", [(16, 2048, 20), (2, 8, 4)])
def test_jaccard_equals_brute_force(spark, docs, small, leaf, level):
    some = docs.select("doc_id", "text").limit(1000 if leaf > 100 else 150)
    base = [f"w{i}" for i in range(120)]
    near = []
    for v in range(60):  # a family of near copies, some only linked through others
        w = list(base)
        for k in range(v % 5):
            w[(v * 7 + k * 11) % 120] = f"x{v}_{k}"
        near.append((10_000 + v, " ".join(w)))
    both = some.union(spark.createDataFrame(near, some.schema))
    want = brute_components([tuple(r) for r in both.collect()])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(both, small=small, leaf=leaf, pivots=4, level=level).collect()}
    assert got == want


def unlinked(n, groups):
    """n documents that share a prefix shingle and hardly link: each begins with its group's words, all with the same five."""
    out = []
    for v in range(n):
        g = v % groups
        own = [f"o{v}_{j}" for j in range(20)]
        out.append((v, " ".join(["s0", "s1", "s2", "s3", "s4", *(f"g{g}_{j}" for j in range(24)), *(own if v % 5 else own[:2])])))
    return out


def test_jaccard_splits_and_blocks_regions(spark):
    """Over 700 unlinked documents that share shingles, dense near copies, and rows repeated hundreds of times."""
    rows = unlinked(720, 6)
    base = [f"w{i}" for i in range(120)]
    for v in range(90):
        w = list(base)
        for k in range(v % 6):
            w[(v * 7 + k * 31) % 120] = f"d{(v * k) % 40}"
        rows.append((2000 + v, " ".join(w)))
    rows += [(5000, "one text of some words " * 4)] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    for r in jaccard.jaccard_components(df, small=2, leaf=32, pivots=4, level=30).collect():
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]


def test_shingle_sets_equal_words():
    texts = ["A b  c\td e f", "a B c d e f", "x y", None, "", " ", "x y x y x y x y", "\u00a0a b c d e", "é è ê"]
    sets = [s.tolist() for s in jaccard.shingle_sets(texts, 5)]
    assert sets[0] == sets[1] and [len(s) for s in sets] == [2, 2, 1, 0, 0, 0, 2, 1, 1]


def test_jaccard_odd_rows(spark, odd):
    got = sorted(tuple(r) for r in jaccard.jaccard_components(odd).drop("text_hash").collect())
    assert got == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 7, 6), (6, 7, 6)]
    assert jaccard.jaccard_components(odd.limit(0)).count() == 0


def brute_quality(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = {}
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_signals_equal_brute_force(docs, odd):
    both = docs.select("doc_id", "text").union(odd.select("doc_id", "text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for r in quality.weak_supervision(both).collect():
        assert tuple(r[n] for n in names) == brute_quality(r["text"]), r["doc_id"]
        assert not (r["base_failed"] and r["kept"])


def test_em_recovers_rates():
    rng = np.random.default_rng(1)
    good = rng.random(6000) < 0.8
    right = (0.97, 0.95, 0.9)
    votes = [tuple(int(v) for v in np.where(rng.random(3) < right, 1, -1) * (1 if y else -1)) for y in good]
    counts = {v: votes.count(v) for v in set(votes)}
    (share, rules), _ = quality.fit_em(sorted(counts.items()))
    assert abs(share - 0.8) < 0.06 and np.allclose([r[2] for r in rules], right, atol=0.06)


def test_posterior_rejects_junk_and_equals_the_model(spark, docs):
    import random

    rng = random.Random(3)
    junk = {
        -1: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40)) for _ in range(60)),
        -2: " ".join("".join(rng.choice("#$%&|<>") for _ in range(6)) for _ in range(60)),
        -3: " ".join(f"word{i % 37}x{i}### | |" for i in range(60)),
    }
    both = docs.select("doc_id", "text").union(spark.createDataFrame(list(junk.items()), "doc_id long, text string"))
    counted = common.materialise(quality.signals(both).drop("text"))
    model = quality.fit(counted)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {0: [], 1: []}
    for r in quality.judge(counted, model).collect():
        p = quality.posterior(tuple(r[v] for v in quality.votes()), model)
        assert r["quality"] == pytest.approx(p) and r["kept"] == (not r["base_failed"] and p >= quality.KEEP_AT)
        assert r["doc_id"] >= 0 or not r["kept"]
        if not r["base_failed"] and labels.get(r["doc_id"]) is not None:
            kept[labels[r["doc_id"]]].append(r["kept"])
    assert np.mean(kept[1]) > 0.98 and np.mean(kept[0]) < 0.1


def test_audio_round_trip(odd):
    for r in media.audio_features(odd).collect():
        data = (dict(ODD)[r["doc_id"]] or "").encode()
        assert r["payload"] == media.pad_payload(data) and r["n_bytes"] == len(data)
        assert len(r["payload"]) % 192 == 0 and r["tensors"] and all(len(t["tensor"]) == 640 for t in r["tensors"])
    assert media.tensor_array([np.zeros(640, np.float32)], media.AudioSpec()).type.shape == [32, 20]


def test_resample_keeps_a_tone_and_segments_find_a_burst():
    x = np.sin(2 * np.pi * 200 * np.arange(8000) / 8000)
    y = media.resample(x, 3, 4)
    assert np.abs(y - np.sin(2 * np.pi * 200 * np.arange(len(y)) / 6000))[100:-100].max() < 0.01
    assert media.hysteresis(np.array([0, 2, 5, 2, 2, 0, 2, 6.0]), 4, 1) == [(2, 5), (7, 8)]


def test_toxicity_held_out(spark):
    data = DATA.replace("0.01", "0.1")
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    held = docs.filter("crc32(encode(cast(doc_id as string), 'utf-8')) % 3 = 1").join(labels.select("doc_id"), "doc_id", "left_semi")
    scored = toxicity.toxicity(held, toxicity.fit_toxicity(docs, labels)).join(labels, "doc_id").collect()
    assert np.mean([r["score"] >= toxicity.THRESHOLD for r in scored if r["toxic"] == 1]) > 0.9
    assert np.mean([r["score"] >= toxicity.THRESHOLD for r in scored if r["toxic"] == 0]) < 0.03


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, toxic int")
    for model in (toxicity.fit_toxicity(odd, labels), toxicity.fit_toxicity(odd, labels.limit(0))):
        rows = toxicity.toxicity(odd, model).collect()
        assert len(rows) == len(ODD) and all(0 <= r["score"] < 0.01 for r in rows)
    assert toxicity.toxicity(odd.limit(0), model).count() == 0


def test_toxicity_locates_sentence():
    texts = [f"Fine words here. You are an idiot {i}. Good day." for i in range(20)] + [f"Fine words here. Good day {i}." for i in range(20)]
    model = toxicity.fit_noisy_or(texts, [1] * 20 + [0] * 20)
    text = "Good day. What an idiot. Fine words here."
    a, b, _ = max(toxicity.sentence_scores(text, model), key=lambda s: s[2])
    assert "idiot" in text[a:b] and toxicity.noisy_or([]) == 0.0


def test_language_held_out(docs, odd):
    model = langid.fit_language_id(docs)
    rows = [r for r in langid.language_id(docs, model).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["lang"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.85
    got = {r["doc_id"]: r["lang_pred"] for r in langid.language_id(odd, model).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[4] != "und"
    assert langid.letter_words("² ½ ① Ⅷ x²y 12ab") == ["x", "y", "ab"]


UNLEARNED = [
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swojej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
    "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα.",
    "xqzjk vwbpf zzkqx jxvbq wqpfk kzxjv qqvwb pfxzj kjqwx vbzpf xkqjz",
]


def test_language_stage_decides_by_the_model(spark, docs):
    some = docs.select("doc_id", "text", "lang")
    en, fr = ([r["text"] for r in some.filter(f"lang = '{x}'").orderBy("doc_id").limit(3).collect()] for x in ("en", "fr"))
    mixed = [(2_000_000 + i, f"{a[:600]}\n{b[:600]}", None) for i, (a, b) in enumerate(zip(en, fr, strict=True))]
    bad = [(1_000_000 + i, t, None) for i, t in enumerate(UNLEARNED)]
    both = some.union(spark.createDataFrame(bad + mixed, some.schema))
    kept = {r["doc_id"] for r in corpus_pipeline.language_stage(spark, both, DATA).select("doc_id").collect()}
    assert not kept & {i for i, *_ in bad}
    assert kept >= {i for i, *_ in mixed}
    clean = {r["doc_id"] for r in some.filter(F.col("text").rlike("[a-zA-Z]")).select("doc_id").collect()}
    assert len(kept & clean) >= 0.99 * len(clean)


def test_language_stage_keeps_all_when_nothing_is_learned(spark, odd):
    assert corpus_pipeline.language_stage(spark, odd, DATA).count() == len(ODD)


def test_fits_learn_from_long_rows_only(spark, docs):
    joined = F.array_join(F.array_repeat("text", 30), "\n")
    long = docs.filter(F.length("text") > 1000).withColumn("text", joined)
    model = langid.fit_language_id(long)
    assert model["labels"] == ["de", "en", "es", "fr"]
    rows = [(i, f"Fine words {i % 7} here. " * 1500 + ("You are an idiot. " * 1500 if i % 2 else "") , i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    fitted = toxicity.fit_toxicity(df.drop("toxic"), df.drop("text"))
    assert fitted["weights"].get("idiot", 0) > 1
    page = "<html><body><nav><a href=x>Home</a></nav><article>" + "<p>A paragraph of the text.</p>" * 3000 + "</article></body></html>"
    pages = spark.createDataFrame([(i, page) for i in range(5)], "page_id long, html string")
    assert htmltree.fit_extractor(pages)["trees"]
    empty = htmltree.fit_extractor(pages.limit(0))
    assert not empty["trees"] and htmltree.extract("<body><nav>Home</nav><p>Text</p></body>", empty) == "Text"


def test_sample_is_stratified(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") < 20, "rare").otherwise("common").alias("lang"))
    got = {r["lang"]: r["count"] for r in common.stratified_sample(df, "id", 100, "lang").groupBy("lang").count().collect()}
    assert got == {"common": 80, "rare": 20}
    assert common.quotas([5, 10], 100) == [5, 10] and sum(common.quotas([3, 1000, 7], 50)) == 50


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    emit, trans = rng.normal(size=(1, 4, 2)), rng.normal(size=(2, 2))
    post, _ = langid.forward_backward(emit, np.ones((1, 4), bool), trans)
    total, want = 0.0, np.zeros((4, 2))
    for path in np.ndindex(2, 2, 2, 2):
        s = np.exp(sum(emit[0, i, y] for i, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:], strict=False)))
        total += s
        for i, y in enumerate(path):
            want[i, y] += s
    assert np.allclose(post[0], want / total)


def test_tagger_without_labels():
    assert [p.shape for p in langid.Tagger(langid.fit_crf([], [])).tag(["some words", None])] == [(0, 0), (0, 0)]


def test_transducer_equals_brute_force():
    import random

    t = wfst.Transducer(wfst.read_vocabulary(wfst.default_vocabulary()))
    rng = random.Random(4)
    texts = ["", "a", " a  b ", "naïve ▁ meta", "日本語 🎉\n\ttab", "x" * 500, "� bad", "   ", "thinking about things"]
    texts += ["".join(rng.choice("abeht ▁é日\x01🎉") for _ in range(40)) for _ in range(60)]
    cost = {i: c for i, c in t.pieces.values()} | {int(i): wfst.BYTE_COST for i in t.byte_ids}

    def best(text):
        """The least cost by trying every piece and byte at every place, on the normalised symbols."""
        symbols = [wfst.META] + [wfst.META if c == " " else c if c != wfst.META else None for c in text]
        least = [0.0] + [np.inf] * len(symbols)
        for i in range(len(symbols)):
            for j in range(i + 1, min(i + 17, len(symbols)) + 1):
                if None not in symbols[i:j] and "".join(symbols[i:j]) in t.pieces:
                    least[j] = min(least[j], least[i] + t.pieces["".join(symbols[i:j])][1])
            raw = (symbols[i] or wfst.META).encode() if symbols[i] != wfst.META else b" "
            least[i + 1] = min(least[i + 1], least[i] + wfst.BYTE_COST * len(raw))
        return least[-1] if text else 0.0

    for text in texts:
        ids = t.encode(text)
        assert t.decode(ids) == text and sum(cost[i] for i in ids) == pytest.approx(best(text)), text
    again = [x for x in t.encode_texts(texts)]
    assert np.concatenate([a[0] for a in again]).tolist() == [i for x in texts for i in t.encode(x)] and all(a[2].all() for a in again)
    t.known_ids = t.known_ids[::-1].copy()  # a wrong table is found out and not used
    assert t.encode("thinking about things") == wfst.Transducer(wfst.read_vocabulary(wfst.default_vocabulary())).encode("thinking about things")


def test_outputs_replace_clashing_columns(spark, odd):
    names = ["token_ids", "N_tokens", "score", "lang_pred", "weight", "block", "epoch", "_h", "_src", "kept", "quality", "_made", "_t", "extra col"]
    wide = odd.withColumns({n: F.lit("mine") for n in names})
    encoded = wfst.encode_documents(wide)
    assert [c.lower() for c in encoded.columns].count("n_tokens") == 1 and encoded.filter("round_trip").count() == len(ODD)
    assert wfst.decode_documents(encoded).filter("decoded = coalesce(text, '')").count() == len(ODD)
    judged = langid.language_id(wide, langid.fit_crf([], []))
    assert judged.columns.count("score") == 1 and judged.filter("lang_pred = 'und' and weight = 'mine'").count() == len(ODD)
    mixed = mixing.mix_sources(wide, blocks=4)
    assert mixed.columns.count("block") == 1 and mixed.filter("_h = 'mine' and `extra col` = 'mine'").count() >= len(ODD)
    assert quality.weak_supervision(wide).filter("not kept and _t = 'mine'").count() == len(ODD)
    for made in (encoded, judged, mixed):
        assert made.limit(0).count() == 0


def test_pipeline_stages(spark, docs, odd):
    wide = odd.drop("label").withColumns({n: F.lit(1) for n in ("n_tokens", "score", "kept", "_h", "label")})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, wide.limit(0), DATA).count() == 0, name
        out = stage(spark, wide, DATA)
        assert out.count() <= len(ODD) and (name.startswith("SentencePiece") or out.columns == wide.columns), name
    rows = docs.limit(300)
    kept = corpus_pipeline.duplicate_stage(spark, rows, DATA)
    want = brute_components([(r["doc_id"], r["text"]) for r in rows.collect()])
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_feistel_is_a_permutation():
    for n in (1, 2, 7, 1000, 4097):
        assert sorted(order.feistel(np.arange(n), n).tolist()) == list(range(n))


def test_training_order_slots(spark, odd):
    rows = order.training_order(odd, length=64, per_shard=8).collect()
    assert [r["slot"] for r in rows] == list(range(len(rows)))
    assert all(len(r["ids"]) == 128 and r["offset"] == r["slot"] % 8 * 128 for r in rows)
    assert order.training_order(odd.limit(0)).count() == 0


def test_mixing_budget(spark):
    rows = [(i, "w " * 10, "big" if i < 300 else "small", "x") for i in range(320)] + [(400, None, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens string").drop("n_tokens")
    got = {r["source"]: (r["n"], r["d"]) for r in mixing.mix_sources(df, blocks=4).groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("d")).collect()}
    assert got["big"] == (300, 300) and got["small"] == (80, 20) and got[None] == (1, 1)
    half = {r["source"]: r["n"] for r in mixing.mix_sources(df, max_epochs=2.5, blocks=4).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert half["big"] == 300 and 49 <= half["small"] <= 50
    tokens = [100, 1000, 10_000]
    e = mixing.bisect_exponent(tokens, target_entropy=0.8)
    assert -sum(x * np.log(x) for x in mixing.weights_at(tokens, e)) == pytest.approx(0.8, abs=1e-6)


def test_url_terms():
    assert urls.term_hits("http://x.com/casino") == (["casino"], [])
    assert urls.term_hits("http://x.com/casinos") == ([], [])
    assert urls.term_hits("http://cheap.com/?q=pills") == ([], ["cheap", "pills"])
    assert urls.term_hits(None) == ([], [])


def test_html_extraction(spark):
    model = htmltree.fit_extractor(spark.read.parquet(f"{DATA}/pages.parquet"))
    page = "<html><body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>First  long paragraph of text.<p>Second.</article><footer>foot</footer></body></html>"
    assert htmltree.extract(page, model) == "A & B\nFirst long paragraph of text.\nSecond."
    assert htmltree.extract(None, model) == "" and htmltree.extract("<p", model) == ""


def test_html_stray_close_tags_and_places():
    deep = htmltree.parse("<div>" * 20_000 + "x" + "</span></nope></root>" * 20_000 + "</div>" * 20_000 + "<p>y")
    assert [c.tag for c in deep.children] == ["div", "p"] and deep.children[1].children == ["y"]
    many = htmltree.parse("<ul>" + "<li>a<b>c</b>" * 200 + "</ul></li></b><i>d</i>")
    assert [n.place for n in many.children[0].children] == list(range(200)) and many.children[1].tag == "i"
    crossed = htmltree.parse("<div><span><p>a<p>b</span>c</div>d</p>")  # the close tag of span ends what is open in it
    span = crossed.children[0].children[0]
    assert [c.children for c in span.children] == [["a"], ["b"]] and crossed.children[0].children[1:] == ["c"] and crossed.children[1:] == ["d"]


def test_html_boilerplate_without_names_outside_the_article(spark):
    def page(i, n):
        links = "".join(f"<li><a href=x>Go {i} {j}</a></li>" for j in range(3 + i % 4))
        text = "".join(f"<p>Paragraph {j} of page {i} <span class=q>holds</span> a few more words of the story.</p>" for j in range(n))
        return f"<html><body><div class=wrap><div class=x{i}><ul>{links}</ul></div><article><h1>Title {i}</h1>{text}</article><div class=y{i}><span class=z>Short note {i}</span></div></div></body></html>"

    pages = spark.createDataFrame([(i, page(i, 2 + i % 5)) for i in range(40)], "page_id long, html string")
    text = htmltree.extract(page(99, 3), htmltree.fit_extractor(pages))
    assert text.split("\n") == ["Title 99", *(f"Paragraph {j} of page 99 holds a few more words of the story." for j in range(3))]
    plain = htmltree.measure(htmltree.parse("<html><body><div><p>Text</p></div></body></html>"))
    assert htmltree.taught(plain) == [None] * len(plain)


def test_shards_resume(spark, odd, tmp_path):
    rows, total, _ = order.slotted(odd, length=64, per_shard=8)
    want = sorted(tuple(r) for r in order.training_order(odd, length=64, per_shard=8).collect())
    path = f"file://{tmp_path}/shards"
    order.write_shards(rows, total, path, length=64, per_shard=8)
    assert len(list(tmp_path.glob("shards/shard=*/*.parquet"))) == -(-total // 8) > 2
    for start in (0, 8, 13):
        assert sorted(tuple(r) for r in order.read_shards(spark, path, start, per_shard=8).collect()) == want[start:]
    for r in spark.read.schema(order.SHARDS).parquet(path).collect():
        assert len(r["data"]) == r["n"] * 128 and bytes(r["data"]) == b"".join(w[5] for w in want if w[1] == r["shard"])


def test_audio_tensors_are_stored_with_a_fixed_shape_and_the_tail_is_heard(odd):
    for r in media.audio_features(odd).collect():
        got = media.read_tensors(r["tensor_arrow"])
        assert got.shape == (len(r["tensors"]), 32, 20) and np.array_equal(got.reshape(len(got), -1), [t["tensor"] for t in r["tensors"]])
    x = np.zeros(150 + 60 + 30)
    x[-10:] = 1.0
    assert np.concatenate([e for _, e in media.log_mel(x, media.AudioSpec())])[-1] > -30


def test_entropy_exponent_reads_every_source(spark):
    n = 100_500  # the last 500 hold most tokens
    sources = spark.range(n).select(F.when(F.col("id") < 100_000, F.lit(1)).otherwise(5000 + F.col("id") % 7).cast("long").alias("n_tokens"))
    e = mixing.entropy_exponent(sources, 8.0)
    w = np.array([r[0] for r in sources.collect()], float) ** e
    w /= w.sum()
    assert -(w * np.log(w)).sum() == pytest.approx(8.0, abs=1e-6)
    assert mixing.entropy_exponent(sources, 20.0) == 0.0 and mixing.entropy_exponent(sources.limit(1), 1.0) == 1.0


def test_mixing_with_target_entropy_uses_all_sources(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(mixing, "bisect_exponent", lambda *a: seen.append(a) or 1.0)
    rows = [(i, "w " * (1 + i), f"s{i}") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    w = [r["weight"] for r in mixing.mix_sources(df, target_entropy=2.4, blocks=4).dropDuplicates(["source"]).collect()]
    assert not seen and -sum(x * np.log(x) for x in w) == pytest.approx(2.4, abs=1e-6)
