import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesselon.llm import chat, licenses, mixing, quality, toxicity, url_filter
from tesselon.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# chat


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a < b # c \\l \\ </turn>\n### x:\n"), (1, 1, "assistant", "\\### Assistant: </turn> ok\n"), (1, 1, "assistant", None), (1, None, None, "first"), (2, 0, "assistant", ""), (None, 5, "ro:le\n#<", "é日"), (3, 0, "user", "x" * 50_000), (3, 0, "user", "x" * 50_000)]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("content", chat.text_part(F.col("text")))
    formatted = chat.format_conversations(m)
    got = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    for conv in (1, 2, 3, None):
        mine = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda v: (v[0], v[1], v[2]))
        assert [(t["role"], t["text"]) for t in got[conv]["read"]] == [v[1:] for v in mine]
        for t, span in zip(got[conv]["read"], got[conv]["loss_mask"]):
            under = got[conv]["formatted"][span["start"] : span["end"]]
            assert under == (chat_escape(t["text"]) if t["role"] == "assistant" else "")
    d = {r["conv_id"]: r for r in chat.digests(formatted).collect()}
    assert d[2]["turns_sha256"] == hashlib.sha256(b"assistant\n\n").hexdigest() and d[2]["loss_chars"] == 0
    assert chat.digests(chat.format_conversations(m.limit(0))).count() == 0


def test_the_loss_digest_reads_the_mask(spark):
    rows = [(1, 0, "user", "ask <b>"), (1, 1, "assistant", "tell # me"), (1, 2, "assistant", "more")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("content", chat.text_part(F.col("text")))
    formatted = chat.format_conversations(m)
    whole = chat.digests(formatted).first()
    assert (whole["loss_chars"], whole["loss_sha256"]) == (13, hashlib.sha256(b"tell # memore").hexdigest())
    moved = formatted.withColumn("loss_mask", F.transform("loss_mask", lambda s: F.struct(F.lit(0).cast("long").alias("start"), F.lit(1).cast("long").alias("end"))))
    other = chat.digests(moved).first()
    assert other["loss_sha256"] == hashlib.sha256(b"###").hexdigest() and other["turns_sha256"] == whole["turns_sha256"]


def chat_escape(t):
    for a, b in chat.ESCAPES:
        t = t.replace(a, b)
    return t


def test_chat_parts(spark):
    part = lambda t, text=None, ref=None, n=None: {"type": t, "text": text, "ref": ref, "n_tokens": n}
    rows = [(1, 0, "user", [part("text", "see "), part("image", ref="i.png", n=256), part("text", " and "), part("audio", ref="s.wav", n=50)]), (1, 1, "assistant", [part("document", ref="d.pdf", n=900), part("text", "done <image:1>")]), (1, 2, "user", None)]
    r = chat.format_conversations(spark.createDataFrame(rows, f"conv_id long, turn long, role string, content array<{chat.PART}>")).first()
    assert r["formatted"] == "### user:\nsee <image:1> and <audio:2></turn>\n### assistant:\n<document:3>done \\limage:1></turn>\n### user:\n</turn>\n"
    assert [(a["turn_no"], a["ordinal"], a["type"], a["ref"], a["n_tokens"]) for a in r["attachments"]] == [(0, 1, "image", "i.png", 256), (0, 2, "audio", "s.wav", 50), (1, 3, "document", "d.pdf", 900)]
    assert r["n_media_tokens"] == 1206


# URLs


def test_url_filter(spark):
    urls = ["http://EXAMPLE.com/en/x?q", "https://www.example.com/en/", "http://a.example.com/de/#t", "http://b.net/es/1", "http://net/fr/", "http://xnet/fr/", "no scheme", None, "", "http://", "ftp://c.org", "http://badexample.com/en/", "x://y://z.net/fr/", "http://b.net/es"]
    rows = [(i, u, 1) for i, u in enumerate(urls)] + [(0, urls[0], 1), (None, urls[3], 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, `key` int")
    got = url_filter.filter_urls(pages, url_filter.entry_table(spark, url_filter.RULES)).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}
    assert by[0] == ("example.com", "/en/x", "example.com/en/", "block") and by[1][2:] == ("www.example.com/en/", "allow")
    assert by[2][2:] == ("com/", "allow") and by[3][2:] == ("net/es/", "block") and by[4][2:] == ("net/fr/", "block")
    assert by[5][2:] == (None, "allow") and by[6] == by[7] == by[8] == by[9] == ("", "", None, "allow") and by[10][0] == "c.org"
    assert by[11][2] == "com/" and by[12][:2] == ("y:", "//z.net/fr/") and by[13][2] is None
    assert url_filter.filter_urls(pages.limit(0), url_filter.entry_table(spark, url_filter.RULES)).count() == 0
    listed = url_filter.entry_table(spark, [(f"h{i}.org", f"/p{i}", "block") for i in range(3000)] + [("h1.org", "/p1", "allow")])
    more = spark.createDataFrame([(i, f"http://h{i}.org/p{i}") for i in range(0, 6000, 7)], "page_id long, url string")
    assert {r["page_id"] for r in url_filter.filter_urls(more, listed).where("verdict = 'block'").collect()} == {i for i in range(0, 6000, 7) if i < 3000}


def test_a_long_list_is_joined_by_salted_keys(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", 0)
    pages = spark.createDataFrame([(i, f"http://x{i % 7}.com/a" if i % 3 else f"http://b.NET/es/{i}") for i in range(300)] + [(300, "http://x.com/" + "y/" * 5000)], "page_id long, url string")
    rules = url_filter.entry_table(spark, (*url_filter.RULES, ("B.net", "/", "allow")))
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, rules).collect()}
    assert got == {i: ("com/", "allow") if i % 3 or i == 300 else ("net/es/", "block") for i in range(301)}


def test_bloom_has_no_false_negatives_and_few_false_positives():
    bloom = url_filter.BlockedBloom(400)
    keys = [f"k{i}" for i in range(10_000)]
    bloom.add(keys)
    assert bloom.may_contain(keys).all()
    assert bloom.may_contain([f"other{i}" for i in range(10_000)]).mean() < 0.02


# toxicity


def test_viterbi_restores_disguises(spark):
    words = "loser idiot moron stupid pathetic worthless scum trash clown the and of with for from that this have"
    lm = toxicity.LanguageModel(toxicity.language_model(spark.createDataFrame([((words + " ") * 50,)], "text string"), Scratch(spark, "lm")))
    own = toxicity.Restorer(lm)
    for disguised, plain in (("l0ser", "loser"), ("1d10t", "idiot"), ("m0r0n!!", "moron"), ("stuuuupid", "stupid"), ("p@thetic,", "pathetic"), ("$cum", "scum"), ("tr.a.s.h", "trash"), ("plain", "plain")):
        assert plain in own.words(disguised), disguised
    assert {"loser", "idiot"} & own.text("you l o s e r there") and "clown" in own.text("c-l-0-w-n")


def test_long_disguises_are_restored_whole(spark):
    words = "worthlessness loser idiot moron stupid pathetic the and of with for from that this have you are all"
    lm = toxicity.LanguageModel(toxicity.language_model(spark.createDataFrame([((words + " ") * 50,)], "text string"), Scratch(spark, "lm")))
    own = toxicity.Restorer(lm)
    sentence = " ".join("youareallpatheticandstupid" * 5 + "idiot")
    assert len(sentence) > 200 and {"pathetic", "stupid"} <= own.text("so " + sentence)
    dotted = ".".join("worthlessness")
    assert len(dotted) > 24 and "worthlessness" in own.words(dotted) and "worthlessness" in own.words("~".join("worthlessness"))
    scorer = toxicity.Scorer(lm, {"pathetic": (5.0, True), "worthlessness": (4.0, True), "stupid": (1.0, False)})
    assert scorer.evidence(sentence)[0] == 5.0 and scorer.evidence("~".join("worthlessness"))[0] == 4.0
    assert toxicity.viterbi("a" * 50_000, lm) in ("a", "aa") and len(toxicity.viterbi(" ".join("stupid" * 5000), lm, split=True).replace(" ", "")) == 30_000


def test_language_model_grows_with_the_corpus_and_knows_letters_apart(spark):
    count = lambda *texts: toxicity.language_model(spark.createDataFrame([(t,) for t in texts], "text string"), Scratch(spark, "lm"))
    few, many = count("été était " * 3), count("été était " * 3, "größe straße " * 4, "снег идёт " * 2, None, "")
    assert all(many[g] >= n for g, n in few.items()) and len(many) > 2 * len(few) and many["   g"] == 4 and many["öße "] == 4 and many["снег"] == 2 and many["é"] == 9
    lm = toxicity.LanguageModel(many)
    assert lm("  é", "t") > lm("  é", "s") and lm("   ", "g") > lm("   ", "q")
    assert "größe" in toxicity.Restorer(lm).words("größ3") and "était" in toxicity.Restorer(lm).words("ét4it")


def test_language_model_leaves_no_gram_out(spark):
    docs = spark.createDataFrame([("quagga " + "the cat " * 9,), ("quagga, ein|mal x1y été_là ² ³a\x1fb\xa0c\u3000d",)], "text string")
    counts = toxicity.language_model(docs, Scratch(spark, "lm"))
    want = Counter()
    for (text,) in docs.collect():
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            s = "   " + word + " "
            want.update(s[i + k : i + 4] for i in range(len(word) + 1) for k in range(4))
    assert counts == dict(want) and counts["quag"] == 2 and counts["einm"[:3] + " "] == 1
    assert "quagga" in toxicity.Restorer(toxicity.LanguageModel(counts)).words("qu4gg4")
    table = toxicity.language_model(docs, Scratch(spark, "lm"), most=100)  # too large for a dictionary: all of it, as a table
    assert {r["gram"]: r["n"] for r in table.collect()} == counts


def test_toxicity_is_the_same_by_a_model_that_is_joined(spark, docs, monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK_LETTERS", 50)  # several blocks
    model = toxicity.language_model
    rng = random.Random(1)
    bad, fine = ["loser", "idiot", "moron", "worthless"], ["table", "green", "window", "quagga", "été", "größe", "snow"]
    disguise = lambda w: rng.choice([w, w.replace("o", "0").replace("i", "1"), w[:2] + w[2] * 4 + w[3:], ".".join(w), " ".join(w), w + "!!", "~".join(w * 9)])
    rows = [(i, " ".join(disguise(rng.choice(bad if i % 5 == 0 and rng.random() < 0.4 else fine)) for _ in range(30))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "don't don't, w0rthless  a b c d"), rows[0], (None, rows[5][1]), (1003, rows[7][1])]
    rows = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select((F.col("doc_id") + 5000).alias("doc_id"), "text"))
    named = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["score"])
    want = sorted(toxicity.toxicity(rows, named).collect(), key=key)
    got = sorted(toxicity.toxicity(rows, named, model_bytes=0).collect(), key=key)
    assert len(want) == rows.count() and [r["doc_id"] for r in got] == [r["doc_id"] for r in want] and sum(r["predicted"] for r in want) > 30
    assert [r["score"] for r in got] == pytest.approx([r["score"] for r in want], rel=1e-6)
    monkeypatch.setattr(toxicity, "language_model", lambda docs, scratch, most: model(docs, scratch, 0))
    got = sorted(toxicity.toxicity(rows, named).collect(), key=key)
    assert [(r["doc_id"], r["score"]) for r in got] == [(r["doc_id"], pytest.approx(r["score"], rel=1e-6)) for r in want]
    monkeypatch.setattr(toxicity, "language_model", model)
    scratch = Scratch(spark, "lm")
    counts = toxicity.language_model(rows, scratch)
    own = toxicity.Restorer(toxicity.LanguageModel(counts))
    joined, none = toxicity.with_restored(rows, toxicity.language_model(rows, scratch, 0), scratch, 0)
    other = Scratch(spark, "lm")
    same, known = toxicity.with_restored(rows, toxicity.language_model(rows, other, 0), other)  # few enough for a worker
    assert same is rows and not none and len(known) > 100 and joined.count() == rows.count()
    for r in joined.collect():
        assert toxicity.Restorer(known).text(r["text"] or "") == own.text(r["text"] or "")
        assert toxicity.Restorer(toxicity.Restored(r["restored"] or {})).text(r["text"] or "") == own.text(r["text"] or "")
    assert toxicity.toxicity(rows.limit(0), named, model_bytes=0).count() == 0


def test_toxicity_held_out(spark):
    rng = random.Random(0)
    vocabulary = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(3, 9))) for _ in range(800)]
    bad = ["loser", "idiot", "moron", "worthless"]
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(vocabulary) for _ in range(40)]
        toxic = int(i % 6 == 0)
        for _ in range(3 * toxic):
            w.insert(rng.randrange(40), rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, toxic))
    rows += [(5000, None), (5001, ""), (5002, "what a l0ser and 1diot, a m0ron"), rows[0], (None, "idiot")]
    labels += [(0, None), (None, 1), (1, labels[1][1])]
    docs, named = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(docs, named).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 900]
    right = [r["predicted"] == int(r["doc_id"] % 6 == 0) for r in held]
    assert len(held) > 100 and np.mean(right) > 0.98
    by = {r["doc_id"]: r for r in got}
    assert by[5000]["predicted"] == by[5001]["predicted"] == 0 and by[5002]["predicted"] == 1
    assert {r["score"] for r in toxicity.toxicity(docs, named.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), named).count() == 0


# quality


def base(text):
    text = text or ""
    w = WORD.findall(text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count, covered = Counter(tri), set()
    for i, t in enumerate(tri):
        if count[t] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark, docs, rows, empty):
    got = quality.quality_report(docs, min_group=5).collect()
    want = sorted((r[0] if r[0] is not None else -1, *base(r[1])) for r in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, *[r[c] for c in quality.BASE]) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"]) and (r["distance"] is None) == r["base_failed"]
    assert quality.quality_report(empty).count() == 0
    kept = quality.quality_filter(docs, min_group=5)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)


def test_quality_rejects_outliers_only(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    rows = []
    for i in range(400):
        w = [word() for _ in range(rng.randrange(60, 300))]
        if i % 20 == 0:
            w = [x + rng.choice(("***", "$$$", "%%%")) for x in w]
        rows.append((i, " ".join(w), "en", "s" if i % 2 else "t"))
    got = {r["doc_id"]: r["kept"] for r in quality.quality_report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), min_group=100).collect()}
    assert all(got[i] == (i % 20 != 0) for i in got)


def test_quality_kinds_of_outliers_and_boilerplate(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    rows, bad = [], set()
    for i in range(1200):
        w = [word() for _ in range(rng.randrange(80, 400))]
        kind, text = i % 60, " ".join(w)
        if kind == 1:  # tables
            text = " | ".join(w)
        elif kind == 2:  # a sign on every second word
            text = " ".join(x + "#" * (k % 2) for k, x in enumerate(w))
        elif kind == 3:
            text = " ".join(x + "***" for x in w)
        elif kind == 4:  # keys and addresses run together
            text = " ".join(a + b + c + d + e + f for a, b, c, d, e, f in zip(*[iter(w + w[::-1] + w[1::2] + w[::2] + w[1::3] + w[::3])] * 6))
        elif kind in (5, 6, 7):  # a header that comes again as a footer, with up to two more lines
            line = " ".join(word() for _ in range(7))
            text = "\n".join([line, text, *["menu", "menu"][: kind - 4], line])
        bad |= {i} if kind in (1, 2, 3, 4) else set()
        # one large group, one of 40 documents and many of four
        rows.append((i, text, "en", "large" if i >= 540 else "small" if i < 40 else f"s{i // 4}"))
    got = {r["doc_id"]: r["kept"] for r in quality.quality_report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert {i for i in got if not got[i]} == bad


def mcd(x, steps=60, starts=40, seed=0):
    """Brute force: the least determinant of the covariance of three quarters of the rows, by concentration steps from many random starts."""
    rng, h, best = np.random.default_rng(seed), int(np.ceil(0.75 * len(x))), None
    floor = np.array(quality.FLOORS) ** 2
    for _ in range(starts):
        pick = rng.choice(len(x), 12, replace=False)
        for _ in range(steps):
            m, c = x[pick].mean(0), np.cov(x[pick].T, bias=True)
            np.fill_diagonal(c, np.maximum(np.diag(c), floor))
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            pick = np.argsort(d)[:h]
        m, c = x[pick].mean(0), np.cov(x[pick].T, bias=True)
        np.fill_diagonal(c, np.maximum(np.diag(c), floor))
        det = np.linalg.slogdet(c)[1]
        best = (det, m, c) if best is None or det < best[0] else best
    return best


def test_least_determinant_against_brute_force(spark):
    rng = np.random.default_rng(7)
    mix = rng.normal(size=(5, 5))
    clean = {g: rng.normal(size=(300, 5)) @ mix + 10 * g for g in (0, 1)}
    far = {0: rng.normal(size=(60, 5)) * 0.3 + 25, 1: rng.normal(size=(0, 5))}  # a tight cluster of a sixth
    rows = {g: np.concatenate([clean[g], far[g]]) for g in clean}
    frame = spark.createDataFrame([(str(g), *map(float, v)) for g in rows for v in rows[g]], "g string, " + ", ".join(f"x_{i} double" for i in range(5)))
    got = {r["g"]: r for r in quality.fit(frame, Scratch(spark, "mcd"), 2).collect()}
    for g in rows:
        det, m, c = mcd(rows[g])
        assert got[str(g)]["logdet"] <= det + 0.05
        assert np.abs(np.array([got[str(g)][f"m_{i}"] for i in range(5)]) - m).max() < 0.3
        assert all(abs(got[str(g)][f"v_{i}_{i}"] / (c[i, i] * quality.CONSISTENCY) - 1) < 0.25 for i in range(5))


def test_quality_small_groups_lean_on_their_language(spark):
    rng = random.Random(4)
    vectors = [(f"=en\x00{'big' if i < 3000 else 'few'}", "=en", "all", *[rng.gauss(3.0 * (i >= 3000), 1.0) for _ in range(5)]) for i in range(3050)]
    schema = "g1 string, g2 string, g3 string, " + ", ".join(f"x_{i} double" for i in range(5))
    got = {r["g1"]: r for r in quality.models(spark.createDataFrame(vectors, schema), Scratch(spark, "quality-test"), 200).collect()}
    # 50 documents of their own against 200 of the language's: about a fifth of the way
    assert abs(got["=en\x00big"]["m_0"]) < 0.2 and 0.3 < got["=en\x00few"]["m_0"] < 1.0
    assert all(r["scale"] >= 1 for r in got.values())


# mixing


def test_mix(spark, docs, rows, empty):
    got = mixing.mix_report(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    total, names = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * total
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            target.update({s: level * weight[s] for s in free})
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    source = {r[0]: r[3] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s]) and r["taken"] in (0, r["size"], 2 * r["size"])
    assert sum(r["taken"] for r in got) <= 1.5 * total
    assert sorted(map(str, mixing.mix_report(docs.repartition(7)).collect())) == sorted(map(str, got))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got)
    assert mixing.mix_report(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(1, 60), f"s{i % 5}" if i % 3 else "s0") for i in range(4000)]
    got = mixing.mix_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    got["source"] = got.doc_id.map({r[0]: r[2] for r in rows})
    g = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert (abs(g.taken - g.target) <= 0.02 * g.target + 120).all() and (g.taken <= 2 * g["size"]).all()


# licenses


def test_license_base_counts(spark, docs, rows, empty):
    more = ["Released under the MIT License. Under the MIT\nLicense!", "Apache License, Version 2.0 cc-by-nc", None, "under the mit", "license under the mit license under the mit license"]
    rows = [(i, t) for i, t in enumerate(more)] + [(100 + i, r[1]) for i, r in enumerate(rows)]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for d, t in rows:
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(i, label) for p, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in places]
        r = got[d]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    assert licenses.scan_licenses(empty).count() == 0


def test_templates():
    auto = licenses.Automaton("a [[b [[c]]]] <<2>> d e [[f]]")
    for text, end in (("a d e", 3), ("a b c d e f", 6), ("a b x y d e", 6), ("a x y z d e", -1), ("a c d e", 4), ("a b d x", -1), ("b d e", -1), ("a x y d e f g", 6)):
        assert auto.match(text.split(), 0) == end, text
    scan = licenses.Scanner()
    assert scan.templates_in("this work is licensed under the gnu general public license version 3".split())[0] == {"gpl-3"}
    assert scan.templates_in("licensed under the apache license version 2 0".split())[0] == {"apache-2"}
    with pytest.raises(ValueError):
        licenses.Automaton("[[a]]")
    with pytest.raises(ValueError):
        licenses.Automaton("[[a b")


def pattern(markup):
    """The template as a regular expression over words that each end in a blank."""
    out = ""
    for tok in re.findall(r"\[\[|\]\]|<<\d+>>|[^\s\[\]<>]+", markup):
        out += {"[[": "(?:", "]]": ")?"}.get(tok) or (r"(?:\S+ ){0,%s}" % tok[2:-2] if tok.startswith("<<") else tok + " ")
    return re.compile(r"(?:^|(?<= ))" + out)


def filled(markup, rng):
    """A text that the template accepts."""
    words, keep = [], [True]
    for tok in re.findall(r"\[\[|\]\]|<<\d+>>|[^\s\[\]<>]+", markup):
        if tok == "[[":
            keep.append(keep[-1] and rng.random() < 0.5)
        elif tok == "]]":
            keep.pop()
        elif keep[-1]:
            words += [f"any{rng.randrange(9)}" for _ in range(rng.randrange(int(tok[2:-2]) + 1))] if tok.startswith("<<") else [tok]
    return words


def test_templates_against_brute_force():
    rng, scan = random.Random(8), licenses.Scanner()
    texts = []
    for _, markup in licenses.TEMPLATES:
        for _ in range(3):
            words = filled(markup, rng)
            texts.append(["before", *words, "after"])
            spoilt = list(words)
            spoilt[rng.randrange(len(spoilt))] = "other"  # mandatory wording broken, or an optional region, or a replaced word
            texts.append(spoilt)
            texts.append(words[: rng.randrange(1, len(words) + 1)])
    wanted = [{label for label, markup in licenses.TEMPLATES if pattern(markup).search(" ".join(w) + " ")} for w in texts]
    assert [scan.templates_in(w)[0] for w in texts] == wanted and {"mit", "bsd-2", "bsd-3", "isc", "apache-2", "gpl-2", "gpl-3"} <= set().union(*wanted)
    got = licenses.Scanner().scan(pa.array([" ".join(w).upper() + ", (C)" for w in texts]))
    assert [set(r[5].split(",")) - {""} for r in got] == [w | ({"mit"} if "under the mit license" in " ".join(x) else set()) | ({"apache-2"} if "apache license version 2" in " ".join(x) else set()) | ({"cc-by-nc"} if "cc by nc" in " ".join(x) else set()) for w, x in zip(wanted, texts)]
