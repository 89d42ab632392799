"""Conversation repair, decontamination and the filter audit against brute force, with odd rows."""

import hashlib
import itertools
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest

from albumlake.llm import audit, htmltree, langid, mixing, order, repair, urls, wfst, winnow

DATA = "/root/testdata/sf0.01"
ROWS = "conv_id long, turn long, role string, text string, audit string, _k int"


def damage(rows):
    """Rows (conv_id, turn, role, text) after damage."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def brute(rows):
    """The contract's columns for one conversation's damaged rows: all edits tried, least cost first, then least string."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    n = {"blank": 0, "duplicate": 0, "truncated": 0}
    must, cut, seen = [], [], set()
    for _, _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        must.append(fault in ("blank", "duplicate"))
        cut.append(int(fault == "truncated"))
        if fault:
            n[fault] += 1
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(maxsize=None)
    def best(i, state, inserts):
        tries = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if inserts < 3:
            for role in ("user", "assistant"):
                if (state, role[0]) in after:
                    c, s, o = best(i, after[state, role[0]], inserts + 1)
                    tries.append((c + 2, "I" + s, ((role, ""), *o)))
        if i < len(rows):
            role, text = rows[i][2:]
            c, s, o = best(i + 1, state, 0)
            tries.append((c + 3, "D" + s, o))
            if not must[i]:
                for e, r, cost in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                    if r and (state, r[0]) in after:
                        c, s, o = best(i + 1, after[state, r[0]], 0)
                        tries.append((c + cost + cut[i], e + s, ((r, text), *o)))
        return min(tries, default=(10**9, "", ()))

    cost, edits, kept = best(0, "", 0)
    turns = [r[1] for r in rows if r[1] is not None]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **n,
        "illegal": sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(rows)),
        "cost": cost, "audit": edits, "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest(),
    }


def wanted(rows):
    after = damage(rows)
    return {c: brute([r for r in after if r[0] == c]) for c in {r[0] for r in rows}}


def got(df):
    out = [r.asDict() for r in df.collect()]
    assert len({r["conv_id"] for r in out}) == len(out)
    return {r.pop("conv_id"): r for r in out}


def test_repair_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(repair.op11_conversation_repair(spark, DATA)) == wanted(rows)


def odd_conversations():
    words = ["Yes.", "No", "", " \t", "a b!", "Why?", "é.", "end. "]
    rows = []
    for c in range(60):
        for k in range(c % 13):
            i = zlib.crc32(f"{c}/{k}".encode())
            rows.append((c, (i >> 4) % 9 - 2, ["user", "assistant", "system", "tool", "", "uncle"][i % 6 if c % 3 else i % 2], words[(i >> 8) % 8]))
    rows += [(None, 1, "user", "a."), (None, None, None, None), (None, None, "assistant", "b."), (7, None, "user", None)]
    rows += [(99, 5, "user", "Same.")] * 7 + [(98, k, "user" if k % 2 else "assistant", f"t{k}.") for k in range(30)]
    return [(*r, "clash", 3) for r in rows]


@pytest.mark.parametrize("bits,chars", [(12, 10**6), (2, 10**6), (0, 1)])
def test_repair_of_odd_rows_held_or_in_blocks(spark, bits, chars):
    rows = odd_conversations()
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    assert got(repair.with_empty(repair.repair(repair.damaged(df), bits, chars), df.select("conv_id"))) == wanted([r[:4] for r in rows])


def test_repair_of_nothing(spark):
    df = spark.createDataFrame([], ROWS)
    assert repair.with_empty(repair.repair(repair.damaged(df)), df.select("conv_id")).count() == 0


def test_checkpointed_walk_equals_whole_costs():
    for n in range(1, 40):
        kinds = bytes(zlib.crc32(f"{n}.{i}".encode()) % 9 for i in range(n))
        assert repair.product(kinds)[repair.NONE * 4 + repair.ASSISTANT] >= repair.start_costs(kinds) >= 0
        after, costs = repair.END, []
        for k in reversed(kinds):
            costs.append(after)
            after = repair.back(k, after)[0]
        state, edits = 0, ""
        for k, v in zip(kinds, reversed(costs), strict=True):
            e, state = repair.step(k, v, state)
            edits += e
        assert repair.walk(kinds, repair.END, [0])[:2] == ([edits], [state])


# Decontamination ---------------------------------------------------------------------------------------------------


def words_of(text):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute_spans(docs, items, window=10):
    out = []
    for i, text in docs:
        w, hit, found = words_of(text), set(), set()
        for item, t in items:
            v = words_of(t)
            size = min(len(v), window)
            runs = {tuple(v[j : j + size]) for j in range(len(v) - size + 1)} if v else set()
            for j in range(len(w) - size + 1):
                if tuple(w[j : j + size]) in runs:
                    hit |= set(range(j, j + size))
                    found.add("" if item is None else str(item))
        out.append((i, len(w), tuple(sorted(hit)), tuple(sorted(found))))
    return sorted(out, key=str)


def spans_of(df):
    return sorted(((r.doc_id, r.n_words, tuple(x for s in r.spans for x in range(s.start, s.end)), tuple(r["items"])) for r in df.collect()), key=str)


ITEMS = [(1, "One two three FOUR five six seven eight nine ten eleven twelve"), (10, "b b b b b b b b b b b b b"), (2, "Short item, here"), (3, "solo"), (4, None), (5, " .,; "),
         (6, "x three four five six seven eight nine ten eleven twelve y"), (None, "Ünder größe Éa " * 4), (2, "another text of the second item that has ten words or more in it")]
TEXTS = [None, "", " \n\t", "nothing of it", "a one two three four five six seven eight nine ten z", "ONE-two three\nfour five_six seven eight nine TEN eleven twelve! b b", "b " * 40,
         "this short ITEM here is solo", "three four five six seven eight nine ten eleven", "ünder größe Éa " * 5, "ünder größe éa " * 5, "one two three four five six seven eight nine. " * 3, "b " * 9,
         "w " * 3000 + "three four five six seven eight nine ten eleven twelve " + "v " * 3000, "another text of the second item that has ten words"]


@pytest.mark.parametrize("k,rows", [(4, 100_000), (1, 3), (10, 100_000), (7, 5)])
def test_shared_spans_equal_brute_force(spark, monkeypatch, k, rows):
    monkeypatch.setattr(winnow, "BLOCK_ROWS", rows)
    docs = [*enumerate(TEXTS), (4, TEXTS[4]), (None, TEXTS[4])]
    d = spark.createDataFrame([(*r, "s", 1) for r in docs], "doc_id long, text string, start string, _n int")
    i = spark.createDataFrame([(*r, 1) for r in ITEMS], "item_id long, text string, class int")
    assert spans_of(winnow.shared_spans(d, i, k=k)) == brute_spans(docs, ITEMS)


def test_empty_sides(spark):
    d, i = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert spans_of(winnow.shared_spans(d, i.limit(0))) == brute_spans(list(enumerate(TEXTS)), [])
    assert winnow.shared_spans(d.limit(0), i).count() == 0
    with pytest.raises(ValueError):
        winnow.shared_spans(d, i, k=11)


def test_main_path_is_native(spark):
    for df in (winnow.op12_decontamination(spark, DATA),):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


# Filter audit ------------------------------------------------------------------------------------------------------


def brute_audit(docs, marks):
    """docs: (doc_id, text, source); marks: doc_id to (good, toxic)."""
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    rows = []
    for i, t, part in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        rows.append((part or "", {f for f, bad in fails.items() if bad}, *marks.get(i, (False, False))))
    out, share = {}, {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                before, here = set(order[:k]), [r for r in mine if f in r[1]]
                gone = [r for r in here if not r[1] & before]
                out[part, "".join(order), k + 1] = [sum(not r[1] & (before | {f}) for r in mine), len(gone), len(here) - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                share[part, f] = share.get((part, f), 0) + len(gone)
    return {k: (*v, share[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_of_odd_rows_equals_brute_force(spark):
    long = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", "AB cd", long, long + " #", "same word " * 40, "SAME WORD " * 40, long.upper(), "a|b", "\t".join(f"é{i}" for i in range(70))]
    docs = [(i, texts[i % 10], [None, "", "web", "Books"][i % 4]) for i in range(45)] + [(3, long, "web"), (3, long, "Books"), (13, long, None), (None, long, "web"), (None, None, None)]
    marks = [(i, i % 2, None if i % 5 else i % 3) for i in range(0, 45, 2)] + [(3, 0, 1), (3, 1, None), (None, 1, 1)]
    want = {}
    for i, q, t in marks:
        g, x = want.get(i, (False, False))
        want[i] = (g or q == 1, x or t == 1)
    want.pop(None)
    d = spark.createDataFrame([(*r, 1, "c") for r in docs], "doc_id long, text string, source string, mask int, part string").drop("part")
    m = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in audit.COUNTS) for r in audit.audit_orders(audit.mask_cells(d, m), "ABCDE").collect()}
    assert got == brute_audit(docs, want)


def test_audit_of_nothing(spark):
    d = spark.createDataFrame([], "doc_id long, text string, source string")
    m = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit_orders(audit.mask_cells(d, m), "ABCDE").count() == 0


# Mixing, stored ids, URL terms -------------------------------------------------------------------------------------


def test_entropy_does_not_repeat_beyond_the_limit(spark):
    rows = [(i, "w " * 2000, "big") for i in range(40)] + [(99, "one", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    made = mixing.mix_sources(df, max_epochs=3.0, target_entropy=0.69).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in made} == {i: 1 for i in range(40)} | {99: 3}


def test_blocks_come_one_after_the_other(spark):
    df = spark.createDataFrame([(i, f"text {i} of some words", "a" if i % 50 else "b") for i in range(400)], "doc_id long, text string, source string")
    rows = mixing.mix_sources(df, blocks=16).orderBy("order_key").collect()
    runs = [k for k, _ in itertools.groupby((r.epoch, r.block) for r in rows)]
    assert len(runs) == len(set(runs)) and runs != sorted(runs)


def test_ids_take_four_bytes_of_a_large_vocabulary(spark, monkeypatch, tmp_path):
    df = spark.createDataFrame([(1, "some words to encode " * 40), (2, None)], "doc_id long, text string")
    kind, end = order.id_format(wfst.read_vocabulary(wfst.default_vocabulary()))
    assert (kind, end) == ("<u2", 2)
    two = [np.frombuffer(r.ids, "<u2").tolist() for r in order.sequences(df, 64).orderBy("doc_id", "seq_no").collect()]
    monkeypatch.setattr(order, "id_format", lambda model: ("<u4", end))
    four = [np.frombuffer(r.ids, "<u4").tolist() for r in order.sequences(df, 64).orderBy("doc_id", "seq_no").collect()]
    ids = wfst.encode_documents(df.withColumn("source", df.text)).orderBy("doc_id").collect()
    assert two == four and two[-1] == [end] * 64
    assert sum(two[:-1], [])[: len(ids[0].token_ids)] == list(ids[0].token_ids)
    rows, total, _ = order.slotted(df, 64, 2)
    order.write_shards(rows, total, str(tmp_path / "s"), 64, 2)
    back = order.read_shards(spark, str(tmp_path / "s"), 0, 2).orderBy("doc_id", "seq_no").collect()
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in back] == four and all(r.offset % 256 == 0 for r in back)


def test_terms_of_a_table(spark):
    terms = spark.createDataFrame([(" Casino ", True), ("casino", False), ("bet", None), ("win", False), (None, True), (" ", True)], "term string, strict boolean")
    strict, soft = urls.read_terms(terms)
    assert (strict, soft) == (("casino",), ("bet", "win"))
    pages = spark.createDataFrame([("http://a/bet-win", 1), ("http://a/betting", 1), ("casino", 1), (None, 1), ("http://a/bet-win", 1)], "url string, strict int")
    assert [r.term_hit.rejected for r in urls.url_vocabulary(pages, strict=strict, soft=soft).collect()] == [True, False, True, False, True]


def test_text_beside_an_article_is_left_out(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    model = htmltree.fit_extractor(pages)
    main = '<article><h1>T</h1><p>The main paragraph of the page, with enough words to be one.</p></article>'
    page = f'<body>{main}<div class="q1"><p>Accept our cookies to go on reading this site today.</p></div>Loose body text</body>'
    assert htmltree.extract(page, model) == "T\nThe main paragraph of the page, with enough words to be one."
    assert "Loose" in htmltree.extract("<body>Loose body text</body>", model)
    rows = [(1, page, "x"), (1, page, "x"), (2, None, "y")]
    made = htmltree.extract_pages(spark.createDataFrame(rows, "page_id long, html string, text string"), model)
    assert made.columns == ["page_id", "html", "text"] and [r.text.split("\n")[0] for r in made.orderBy("page_id").collect()] == ["T", "T", ""]


def test_language_features_of_many_words_are_made_at_once(monkeypatch):
    rnd = np.random.default_rng(4)
    letters = list("abcdeéßñøжщ中文あ𐐨ps")
    words = list(dict.fromkeys("".join(rnd.choice(letters, rnd.integers(1, 30))) for _ in range(2000))) + ["pab" * 400, "abpab", "spsps"]
    flat, start, lone = langid.features_together(words)
    asked = set(lone.tolist())
    ends = [*start[1:].tolist(), len(flat)]
    for i, (word, a, b) in enumerate(zip(words, start.tolist(), ends, strict=True)):
        assert i in asked or flat[a:b].tolist() == langid.word_features(word), word
    assert {i for i, w in enumerate(words) if len(w) < 3} <= asked and len(asked) < len(words) / 2
    model = langid.fit_crf(["le chat dort", "the cat sleeps"] * 3, ["fr", "en"] * 3)
    weights = np.array([model["weights"][langid.word_features(w)].sum(axis=0) for w in words])
    calls = []
    by_one = langid.word_features
    monkeypatch.setattr(langid, "word_features", lambda w: calls.append(w) or by_one(w))
    assert np.allclose(langid.Tagger(model).emissions(words * 2), np.concatenate([weights, weights]), atol=1e-5)
    assert sorted(calls) == sorted(words[i] for i in asked)
