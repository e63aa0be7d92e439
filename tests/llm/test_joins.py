import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tesselon.llm import decontaminate, ngram_join, signature_tree
from tesselon.llm.common import Scratch
from tesselon.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(texts):
    """doc_id -> (set size, component) for distinct doc_ids."""
    sets = {i: shingles(t) for i, t in texts.items()}
    comp = {i: i for i in texts}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            comp[y] = x
    return {i: (len(sets[i]), root(i)) for i in texts}


def check(spark, docs, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_components(docs).collect() if r["doc_id"] is not None}
    assert got == brute_components(texts)


def test_join_with_odd_rows(spark, docs, rows):
    check(spark, docs, {r[0]: r[1] for r in rows if r[0] is not None})
    found = ngram_join.join_components(docs)
    assert found.count() == len(rows)
    assert found.where("doc_id IS NULL AND component_id IS NULL").count() == 1


def test_join_of_chains_and_large_groups(spark):
    rng = random.Random(5)
    words = [f"v{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    texts = {}
    for i in range(150):  # a chain of edits: neighbours link, the ends don't
        texts[i] = " ".join(base)
        base[rng.randrange(len(base))] = rng.choice(words)
    common = " ".join(rng.choice(words) for _ in range(60))
    for i in range(150, 260):  # a passage that many texts share, which links none by itself
        texts[i] = common + " " + " ".join(rng.choice(words) for _ in range(rng.choice((3, 10, 15, 30, 80))))
    check(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string"), texts)


def test_join_of_an_empty_table(spark, empty):
    assert ngram_join.join_components(empty).count() == 0
    assert ngram_join.deduplicate(empty).columns == empty.columns


def test_deduplicate_keeps_one_of_each(spark, docs, rows):
    kept = ngram_join.deduplicate(docs)
    comps = brute_components({r[0]: r[1] for r in rows if r[0] is not None})
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in comps.items() if c == i} | {None}


def test_large_meetings_are_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK", 4)
    rng = random.Random(9)
    words = [f"u{i}" for i in range(60)]
    core = [rng.choice(words) for _ in range(60)]
    texts = {}
    for i in range(60):
        t = list(core)
        for _ in range(rng.choice((1, 2, 3))):
            t[rng.randrange(60)] = f"own{i}"
        texts[i] = " ".join(t)
    check(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string"), texts)


def test_rows_that_repeat_a_doc_id_link_by_their_own_texts(spark):
    one, two = (" ".join(f"{p}{i}" for i in range(40)) for p in "xy")
    rows = [(1, one), (1, two), (2, one + " tail"), (3, two + " tail"), (4, one), (1, one), (5, "some text of its own here"), (5, two), (None, one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in ngram_join.join_components(docs).collect())
    assert got == [(0, None), (1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (5, 5)]
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in ngram_join.deduplicate(docs).collect())
    # of each component one row: of x and y, which doc_id 1 has both of, the first by fingerprint
    assert len(kept) == 3 and kept[0] == (0, one) and kept[1][0] == 1 and kept[2] == (5, "some text of its own here")


def members(sets, keys, comps):
    """Rows of tasks: each set in the tree of each of its keys."""
    built = [signature_tree.bitmap(s) for s in sets]
    rows = sorted((k, i) for i, own in enumerate(keys) for k in own)
    pick = np.array([i for _, i in rows])
    column = lambda v: np.array(v, np.int64)
    return {"key": column([k for k, _ in rows]), "i": column([0] * len(rows)), "j": column([0] * len(rows)), "side": column([0] * len(rows)), "number": pick, "comp": column(comps)[pick], "n": column([len(s) for s in sets])[pick], "extra": column([e for _, e in built])[pick], "bits": np.stack([b for b, _ in built])[pick]}


def test_trees_find_all_linked_pairs_and_prune():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(60):
        core = rng.integers(0, 1 << 62, rng.integers(5, 200)).astype(np.uint64)
        for _ in range(4):
            keep = core[rng.random(len(core)) < 0.95]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 62, rng.integers(0, 8)).astype(np.uint64)])))
    linked = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if 4 * len(np.intersect1d(sets[a], sets[b])) >= 3 * len(np.union1d(sets[a], sets[b]))}
    seen = Counter()
    got = set(map(tuple, ngram_join.candidates(members(sets, [(0, i % 7) if i % 5 else (0,) for i in range(len(sets))], range(len(sets))), seen).T.tolist()))
    assert linked <= got and len(got) < len(sets) ** 2 // 8
    assert seen["nodes", "visited"] > seen["nodes", "pruned"] > 0 and seen["leaves", "pruned"] > 0
    # sets of one component are left out above the leaves
    seen = Counter()
    same = ngram_join.candidates(members(sets, [(0,)] * len(sets), [0] * len(sets)), seen)
    assert same.shape[1] == 0 and seen == Counter({("nodes", "visited"): 1, ("nodes", "pruned"): 1})


def test_the_join_takes_its_links_from_trees(spark, monkeypatch):
    """Without the pairs that the traversal gives, nothing but equal sets is linked."""
    base = [f"w{i}" for i in range(80)]
    texts = {i: " ".join([*base[:i], "odd", *base[i + 1 :]]) for i in range(8)} | {100: " ".join([*base[:0], "odd", *base[1:]])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["component_id"] for r in ngram_join.join_components(docs).collect()} == {0}
    monkeypatch.setattr(ngram_join, "_traversed", lambda members, sets: spark.createDataFrame([], "a long, b long"))
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.join_components(docs).collect()} == {**{i: i for i in range(8)}, 100: 0}



def test_copies_that_do_not_link_with_their_least_set_give_few_candidates(spark, monkeypatch):
    """The least set leads all trees of the first round; here it links with nothing, and before other sets led in turn, all pairs were candidates."""
    rng, base = random.Random(5), [f"w{i}" for i in range(200)]
    edited = lambda i, n: " ".join(f"odd{i}-{k}" if k in places else w for places in [set(rng.sample(range(200), n))] for k, w in enumerate(base))
    number = lambda texts: ngram_join._fingerprints(*ngram_join.shingle_sets(pa.array(texts)))[0]
    texts = [edited(i, 1 + i % 2) for i in range(400)]
    h, at = ngram_join.shingle_sets(pa.array([" ".join(base), *(far := [edited(400 + i, 6) for i in range(6000)])]))
    salts = ngram_join.mix64(np.arange(1, ngram_join.STARS + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
    least = np.stack([np.minimum.reduceat(ngram_join.mix64(h ^ x), at[:-1]) for x in salts], axis=1)
    base_like = [t for t, own in zip(far, least[1:]) if set(own) == set(least[0])]
    texts.append(base_like[int(np.argmin(number(base_like)))])
    assert number(texts).argmin() == 400
    docs, traversed, made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ngram_join._traversed, []

    def counted(members, sets):
        out = traversed(members, sets).localCheckpoint()
        made.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "_traversed", counted)
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.join_components(docs).collect()} == {**dict.fromkeys(range(400), 0), 400: 400}
    assert sum(made) < 80 * len(texts)


def test_links_of_one_component_are_not_gone_through_again(spark, monkeypatch):
    """Before, each round looked for the components of all links found so far."""
    rng, base = random.Random(6), [f"w{i}" for i in range(200)]
    edited = lambda i: " ".join(f"odd{i}-{k}" if k in places else w for places in [set(rng.sample(range(200), 2))] for k, w in enumerate(base))
    docs = spark.createDataFrame([(i, edited(i)) for i in range(150)] + [(1000 + i, f"all of these {i % 7} words stand by themselves {i}") for i in range(20)], "doc_id long, text string")
    found, edges = ngram_join.components, []

    def counted(pairs, scratch, name):
        edges.append(pairs.where("a <> b").distinct().count())
        return found(pairs, scratch, name)

    monkeypatch.setattr(ngram_join, "components", counted)
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.join_components(docs).collect() if r["doc_id"] < 1000} == dict.fromkeys(range(150), 0)
    assert edges[0] >= 100 and sum(edges) < 2 * edges[0]


def test_shingles_of_very_long_and_odd_texts(texts):
    h, at = ngram_join.shingle_sets(pa.array(texts, pa.string()))
    assert np.diff(at).tolist() == [len(shingles(t)) for t in texts]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(300, 200)]
    got = {r["id"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "c").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 300: 200}


def edit_distance_in(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers_against_the_table():
    rng = random.Random(1)
    for _ in range(200):
        p = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 90)))
        t = "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 60)))
        if rng.random() < 0.5:
            t = t[:20] + p[: len(p) // 2] + "x" + p[len(p) // 2 :] + t[20:]
        assert decontaminate.myers(p, t)[0] == edit_distance_in(p, t)


def test_matches_against_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeiostn") for _ in range(rng.randrange(2, 8)))
    items = [" ".join(word() for _ in range(rng.randrange(9, 30))) for _ in range(12)] + [None, "too short"]
    rows = []
    for i in range(80):
        text = [word() for _ in range(30)]
        if i % 2:
            it = list(items[i % 12])
            for _ in range(rng.randrange(0, 8)):
                k = rng.randrange(len(it))
                it[k] = rng.choice(["", "z", it[k] + "q"])
            text.insert(rng.randrange(30), "".join(it).upper() if i % 3 else "".join(it).replace(" ", "\n  "))
        rows.append((i, " ".join(text)))
    rows += [(900, None), (901, ""), rows[1]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (50, items[0])], "item_id long, text string")
    want = []
    for d, t in rows:
        for k, it in [*enumerate(items), (50, items[0])]:
            n = decontaminate.normalise(it or "")
            if len(n) >= decontaminate.MIN_CHARS and t:
                e = edit_distance_in(n, decontaminate.normalise(t))
                if e <= int(decontaminate.RATE * len(n)):
                    want.append((d, k, e))
    got = decontaminate.matches(docs, bench)
    assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in got.collect()) == sorted(want) and want
    kept = decontaminate.decontaminate(docs, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _ in rows if d not in {w[0] for w in want})


def test_no_items_and_no_texts(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "the cat number nine sat on the mat and looked away")], "item_id long, text string")
    assert decontaminate.matches(docs, none).count() == 0 and decontaminate.matches(empty, some).count() == 0
    assert decontaminate.decontaminate(docs, none).count() == docs.count()


def test_short_items_are_sought_exactly_and_as_whole_words(spark):
    docs = spark.createDataFrame([(1, "Well, What is 2+2? he said"), (2, "what is 2+22 then"), (3, "somewhat is 2+2"), (4, "what\nis  2+2"), (5, "x" * 200_000 + " what is 2+2"), (6, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "What is 2+2"), (2, " \n "), (3, None)], "item_id long, text string")
    assert sorted((r["doc_id"], r["distance"]) for r in decontaminate.matches(docs, items).collect()) == [(1, 0), (4, 0), (5, 0)]
    assert sorted(r["doc_id"] for r in decontaminate.decontaminate(docs, items).collect()) == [2, 3, 6]
