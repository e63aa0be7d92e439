import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesselon.functions import analysis, scoring
from tesselon.functions.porter2 import stem
from tesselon.operators import facets, knn, quantisation, ranking
from tesselon.operators.nodes import BM25F, Bool, Function, FunctionScore, Fuzzy, GeoDistance, Match, MatchAll, MatchNone, Phrase, Prefix, QueryError, Range, Regexp, SpanNear, Term, Wildcard
from tesselon.operators.retrieval import Corpus, find, matched, rescored, scored
from tesselon.plans.conditions import from_dict, from_json, from_text
from tesselon.plans.schema import Field, Schema, SchemaError
from tesselon.sources.index import invert

SAMPLE = [
    (1, "a", "the quick brown fox", "anim", 2001),
    (2, "b", "the lazy dog sleeps", "anim", 2010),
    (3, "c", "quick foxes are quick", "anim", 1999),
    (4, "d", "a slow green turtle", "plant", 2020),
    (5, "e", "brown bears and brown foxes", "anim", 2005),
]
FACETS = [(1, "a", "alpha shoe", "shoe", 2001, 50.0), (2, "b", "beta shoe", "shoe", 2010, 80.0), (3, "c", "gamma hat", "hat", 1999, 20.0), (4, "d", "delta hat", "hat", 2020, 35.0), (5, "e", "eps bag", "bag", 2005, 120.0)]


@pytest.fixture(scope="module")
def sample(spark):
    docs = spark.createDataFrame(SAMPLE, "doc_id long, _id string, title string, tag string, year long").cache()
    return Corpus(docs, Schema((Field("title", "text"), Field("tag", "keyword"), Field("year", "long"))))


@pytest.fixture(scope="module")
def shoes(spark):
    return spark.createDataFrame(FACETS, "doc_id long, _id string, title string, tag string, year long, price double").cache()


def ids(found):
    return [r["_id"] for r in found.collect()]


@pytest.mark.parametrize(
    ("node", "want"),
    [
        (Term("title", "fox"), "a"),
        (Bool(must=(Term("title", "brown"), Term("title", "fox"))), "a"),
        (Bool(must=(Term("title", "quick"),), must_not=(Term("title", "brown"),)), "c"),
        (Phrase("title", "brown fox"), "a"),
        (Phrase("title", "quick fox", slop=1), "a"),
        (Phrase("title", "quick fox"), ""),
        (Prefix("title", "fox"), "ace"),
        (Range("year", 2005, None), "bde"),
        (Range("year", 2000, 2010), "abe"),
        (Range("tag", "anim", "anim"), "abce"),
        (MatchAll(), "abcde"),
        (Bool(must_not=(Term("title", "quick"),)), ""),
        (Fuzzy("title", "quikc"), "ac"),
        (Fuzzy("title", "foxs"), "ace"),
        (Wildcard("title", "f?x*"), "ace"),
        (Wildcard("title", "f?x"), "a"),
        (Regexp("title", "b(rown|ears)"), "ae"),
        (SpanNear("title", ("brown", "quick"), slop=0, in_order=False), "a"),
        (SpanNear("title", ("brown", "quick"), slop=0), ""),
        (Bool(should=(Term("title", "quick"), Term("title", "brown"), Term("title", "the")), minimum_should_match=2), "a"),
        (Bool(filter=(Term("tag", "plant"),)), "d"),
        (Term("year", 1999), "c"),
    ],
)
def test_conditions(sample, node, want):
    assert sorted(ids(scored(sample, node))) == list(want)


def test_match_ranks_repeats_first(sample):
    assert ids(find(sample, Match("title", "quick dog"), 10))[0] in "bc" and set(ids(find(sample, Match("title", "quick dog"), 10))) == set("abc")
    both = ids(find(sample, Match("title", "quick"), 10))
    assert both == ["c", "a"]
    assert ids(find(sample, MatchAll(), 2, offset=1)) == ["b", "c"] and ids(find(sample, MatchAll(), 0)) == []


def test_scores_by_hand(sample):
    import math

    n, df, avg = 5, 2, (4 + 4 + 4 + 4 + 5) / 5
    got = {r["_id"]: r["score"] for r in scored(sample, Term("title", "quick", boost=2.0)).collect()}
    for key, tf, dl in (("a", 1, 4), ("c", 2, 4)):
        assert got[key] == pytest.approx(2 * math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 0.3 + 0.9 * dl / avg))
    nested = {r["_id"]: r["score"] for r in scored(sample, Bool(must=(Term("title", "quick"), Prefix("title", "f", boost=3.0)), filter=(MatchAll(),))).collect()}
    assert nested["a"] == pytest.approx(got["a"] / 2 + 3.0)


def test_filter_only_matches_score_zero(sample):
    assert [r["score"] for r in scored(sample, Bool(filter=(Term("title", "fox"),))).collect()] == [0.0]


def test_norms_keep_four_bits(spark):
    got = [r[0] for r in spark.range(0, 70).select(scoring.quantised(F.col("id"))).collect()]
    assert got == [n if n < 16 else (n >> (n.bit_length() - 4)) << (n.bit_length() - 4) for n in range(70)]


NODES = [
    Match("title", "brown foxes brown"), Match("title", "brown foxes", "must"), Phrase("title", "brown fox"), Phrase("title", "quick fox", 1), Phrase("title", "brown brown", 5),
    SpanNear("title", ("fox", "quick"), 1, in_order=False), Prefix("title", "fox"), Wildcard("title", "f?x*"), Fuzzy("title", "quikc"), Range("title", "f", "l"),
    Bool(must=(Term("title", "quick"),), should=(Term("tag", "anim"), Prefix("title", "fox")), must_not=(Term("title", "brown"),)),
    Bool(must=(MatchAll(),), must_not=(Term("title", "the"),)), Bool(should=(Term("title", "the"), Range("year", 2005, None))), Bool(must_not=(Term("title", "the"),)),
    FunctionScore(Term("title", "quick"), (Function("field_value_factor", field="year", filter=Term("title", "brown")),), boost_mode="sum"),
]


@pytest.fixture(scope="module")
def indexed(spark, sample, tmp_path_factory):
    return invert(sample, str(tmp_path_factory.mktemp("ix")))


@pytest.mark.parametrize("node", NODES, ids=str)
def test_an_index_gives_what_a_scan_gives(sample, indexed, node):
    a, b = ({r["doc_id"]: r["score"] for r in matched(c, node).collect()} for c in (sample, indexed))
    assert a == pytest.approx(b)


def test_hits_of_an_index_are_fetched_by_id(sample, indexed):
    node = Match("title", "brown quick")
    got = find(indexed, node, 2)
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in find(sample, node, 2).collect()]
    assert find(indexed, Term("title", "absent"), 2).collect() == []


def test_a_scan_analyses_each_text_once(spark, sample):
    plan = matched(sample, Bool(must=(Match("title", "brown quick fox"),), should=(Phrase("title", "brown fox", 2), Prefix("title", "f"))))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2  # the statistics' scan and the matches'


@pytest.mark.parametrize("seed", range(4))
def test_merges_equal_brute_force(spark, seed):
    import itertools
    import random

    rng = random.Random(seed)
    texts = [(i, [rng.choice("abcd") for _ in range(rng.randrange(1, 30))]) for i in range(60)]
    corpus = Corpus(spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, title string"), Schema((Field("title", "text"),)))
    for span, slop in ((("a", "b"), 0), (("a", "b", "a"), 1), (("c", "a", "d"), 3), (("a", "a"), 2)):
        places = lambda t: [[i for i, w in enumerate(t) if w == s] for s in span]  # noqa: B023, E731
        ordered = {i for i, t in texts if any(all(x < y for x, y in itertools.pairwise(q)) and q[-1] - q[0] - len(q) + 1 <= slop for q in itertools.product(*places(t)))}
        near = {i for i, t in texts if any(max(q) - min(q) - len(q) + 1 <= slop for q in itertools.product(*places(t)))}
        assert {r["doc_id"] for r in matched(corpus, SpanNear("title", span, slop)).collect()} == ordered
        assert {r["doc_id"] for r in matched(corpus, SpanNear("title", span, slop, in_order=False)).collect()} == near


def test_conditions_from_text_and_json():
    assert from_text('a +b -c d:"e f" n:[1 TO 5} h*', "t") == Bool(should=(Match("t", "a"), Phrase("d", "e f"), Range("n", "1", "5", True, False), Prefix("t", "h")), must=(Match("t", "b"),), must_not=(Match("t", "c"),))
    assert from_text("a AND b", "t") == Bool(should=(Match("t", "a"),), must=(Match("t", "b"),)) and from_text("a", "t") == Match("t", "a")
    assert from_text("NOT a b", "t") == Bool(must_not=(Match("t", "a"),), should=(Match("t", "b"),)) and from_text(" ", "t") == MatchNone()
    assert from_text("n:{* TO 5]", "t") == Range("n", None, "5", False, True)
    for bad in ("[0", '"open', "[1 5]", "f:", "a NOT", "[1 TO 2", "]"):
        with pytest.raises(QueryError):
            from_text(bad, "t")
    assert from_dict({"match": {"field": "f", "query": "q", "operator": "and"}, "boost": 2}) == Match("f", "q", "must", boost=2.0)
    assert from_json('{"range": {"field": "n", "gt": 1, "lte": 3}}') == Range("n", 1, 3, False, True)
    assert from_dict({"bm25f": {"terms": ["x"], "fields": [{"name": "a", "boost": 2, "b": -1}]}}) == BM25F(("x",), (("a", 2.0, None),))
    scored_by = {"function_score": {"query": {"match_all": {}}, "functions": [{"gauss": {"field": "n", "origin": 1, "scale": 2}, "weight": 3}], "score_mode": "sum"}}
    assert from_dict(scored_by) == FunctionScore(MatchAll(), (Function("gauss", weight=3.0, field="n", origin=1.0, scale=2.0),), "sum")
    for bad in ("[1]", "{}", '{"term": 1}', '{"other": {}}', '{"term": {"value": "x"}}', '{"term": {}, "match": {}}', "{"):
        with pytest.raises(QueryError):
            from_json(bad)


def test_function_scores(spark, sample):
    one = FunctionScore(Term("title", "quick"), (Function("field_value_factor", field="year", factor=0.001),), boost_mode="replace")
    assert {r["_id"]: round(r["score"], 3) for r in scored(sample, one).collect()} == {"a": 2.001, "c": 1.999}
    no_match = FunctionScore(MatchAll(), (Function(weight=5.0, filter=Term("tag", "none")),), score_mode="sum", boost_mode="sum")
    assert {r["score"] for r in scored(sample, no_match).collect()} == {1.0}
    least = FunctionScore(MatchAll(), (Function("field_value_factor", field="year"),), boost_mode="replace", min_score=2005)
    assert sorted(ids(scored(sample, least))) == ["b", "d", "e"]
    random = FunctionScore(MatchAll(), (Function("random", seed=7),))
    first = [r["score"] for r in scored(sample, random).orderBy("doc_id").collect()]
    assert first == [r["score"] for r in scored(sample, random).orderBy("doc_id").collect()] and len(set(first)) == 5 and all(0 <= x < 1 for x in first)
    with pytest.raises(QueryError):
        scored(sample, FunctionScore(MatchAll(), (Function(),), score_mode="other"))


def test_rescore(sample):
    found = rescored(sample, Match("title", "brown quick"), Phrase("title", "brown fox"), window=5, k=3, rescore_weight=10.0)
    assert [r["doc_id"] for r in found.collect()][0] == 1 and found.count() == 3


def test_bm25f_prefers_the_weighted_field(spark):
    docs = spark.createDataFrame([(1, "x", "red shoe", "plain"), (2, "y", "plain", "red shoe"), (3, "z", "none", "none")], "doc_id long, _id string, title string, body string")
    corpus = Corpus(docs, Schema((Field("title", "text"), Field("body", "text"))))
    assert ids(find(corpus, BM25F(("red", "shoe"), (("title", 3.0, None), ("body", 1.0, None))), 5)) == ["x", "y"]


def test_geo(spark):
    rows = [(1, "near", (37.78, -122.42)), (2, "mid", (37.80, -122.27)), (3, "far", (38.5814, -121.4944)), (4, "none", None)]
    docs = spark.createDataFrame(rows, "doc_id long, _id string, place struct<lat:double,lon:double>")
    found = scored(Corpus(docs, Schema((Field("place", "geo_point"),))), GeoDistance("place", 37.7749, -122.4194, 50_000))
    assert sorted(ids(found)) == ["mid", "near"]
    assert ids(ranking.sort(docs, [ranking.SortKey("place", origin=(37.7749, -122.4194), missing_last=True)])) == ["near", "mid", "far", "none"]


def test_multi_valued_text_has_gaps(spark):
    docs = spark.createDataFrame([(1, "a", ["red big", "shoe box"])], "doc_id long, _id string, title array<string>")
    corpus = Corpus(docs, Schema((Field("title", "text", multi=True),)))
    assert ids(scored(corpus, Phrase("title", "big shoe"))) == [] and ids(scored(corpus, Phrase("title", "shoe box"))) == ["a"]
    assert ids(scored(corpus, Phrase("title", "big shoe", slop=100))) == ["a"]


def tokens(spark, analyzer, text):
    return [t["term"] for t in spark.range(1).select(analyzer(F.lit(text)).alias("t")).first()["t"]]


@pytest.mark.parametrize(
    ("name", "text", "want"),
    [
        ("standard", "The quick-brown fox", "the quick brown fox"),
        ("standard", "ping 192.168.1.1 now", "ping 192.168.1.1 now"),
        ("standard", "fox's den", "fox's den"),
        ("english", "running runs run", "run run run"),
        ("english", "computer's computing computed", "comput comput comput"),
        ("english", "The lazy DOGS", "lazi dog"),
        ("simple", "a1b2 c", "a b c"),
        ("standard", "", ""),
    ],
)
def test_analyzers(spark, name, text, want):
    assert tokens(spark, analysis.ANALYZERS[name], text) == want.split()


def test_custom_analyzers(spark):
    make = lambda **c: analysis.custom(c)
    assert tokens(spark, make(tokenizer={"type": "ngram", "min": 2, "max": 3}), "abcd") == ["ab", "abc", "bc", "bcd", "cd"]
    assert tokens(spark, make(tokenizer={"type": "ngram", "min": 3, "max": 3}), "ab") == []
    assert tokens(spark, make(tokenizer={"type": "edge_ngram", "min": 1, "max": 3}), "abcd") == ["a", "ab", "abc"]
    assert tokens(spark, make(tokenizer="standard", char_filters=["html_strip"]), "<b>x</b>&amp;lt; y") == ["x", "lt", "y"]
    assert tokens(spark, make(tokenizer="whitespace", char_filters=[{"type": "pattern_replace", "pattern": "(\\d+)", "replacement": "<$1>"}]), "a12 b") == ["a<12>", "b"]
    assert tokens(spark, make(tokenizer="whitespace", filters=["lowercase", "ascii_folding", "unique"]), "Ærø Straße STRASSE çà ca") == ["aero", "strasse", "ca"]
    stops = make(tokenizer="standard", filters=["lowercase", "stop"])
    assert [tuple(t) for t in spark.range(1).select(stops(F.lit("the fox and the dog")).alias("t")).first()["t"]] == [("fox", 1), ("dog", 4)]
    synonyms = make(tokenizer="whitespace", filters=[{"type": "synonym", "rules": ["quick => fast, rapid", "big, large"]}])
    assert [tuple(t) for t in spark.range(1).select(synonyms(F.lit("quick large")).alias("t")).first()["t"]] == [("quick", 0), ("fast", 0), ("rapid", 0), ("large", 1), ("big", 1)]
    with pytest.raises(ValueError):
        make(tokenizer="none")


@pytest.mark.parametrize(
    ("word", "want"),
    [("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cries", "cri"), ("gas", "gas"), ("kiwis", "kiwi"), ("agreed", "agre"), ("hopping", "hop"), ("hoping", "hope"), ("luxuriating", "luxuri"), ("national", "nation"), ("generously", "generous"), ("communication", "communic"), ("relational", "relat"), ("happy", "happi"), ("by", "by"), ("say", "say"), ("skies", "sky"), ("dying", "die"), ("adoption", "adopt"), ("knightly", "knight"), ("controlling", "control"), ("electricity", "electr"), ("consisting", "consist"), ("news", "news"), ("evening", "evening")],
)
def test_porter2(word, want):
    assert stem(word) == want


def test_facets(shoes):
    pairs = lambda df: [tuple(r) for r in df.collect()]
    assert pairs(facets.terms(shoes, "tag", 2)) == [("hat", 2), ("shoe", 2)]
    assert pairs(facets.terms(shoes, "tag", 0, by_key=True)) == [("bag", 1), ("hat", 2), ("shoe", 2)]
    assert pairs(facets.histogram(shoes, "year", 10)) == [(1990.0, 1), (2000.0, 2), (2010.0, 1), (2020.0, 1)]
    assert pairs(facets.ranges(shoes, "price", [("low", None, 50.0), ("mid", 50.0, 100.0), ("none", 500.0, None)])) == [("low", 2), ("mid", 2), ("none", 0)]
    assert facets.metrics(shoes, "price").first().asDict() == {"count": 5, "sum": 305.0, "min": 20.0, "max": 120.0, "avg": 61.0}
    assert facets.metrics(shoes.limit(0), "price").first().asDict() == {"count": 0, "sum": 0.0, "min": 0.0, "max": 0.0, "avg": 0.0}
    assert ("hat", 2, "hat", 2) in pairs(facets.nested_terms(shoes, "tag", "tag"))


def test_sketches(spark):
    n = spark.range(1000).withColumn("v", F.col("id").cast("double"))
    assert abs(facets.cardinality(n, "id").first()["value"] - 1000) <= 50
    got = {r["key"]: r["value"] for r in facets.percentiles(n, "v").collect()}
    assert abs(got["50"] - 500) <= 30 and abs(got["95"] - 950) <= 30 and abs(got["99"] - 990) <= 20


def test_sorting_and_collapsing(shoes):
    assert ids(ranking.sort(shoes, [ranking.SortKey("price")])) == list("cdabe")
    assert ids(ranking.sort(shoes, [ranking.SortKey("tag", desc=True), ranking.SortKey("price", desc=True)])) == list("badce")
    missing = shoes.withColumn("v", F.when(F.col("year") > 2004, F.col("year")))
    assert ids(ranking.sort(missing, [ranking.SortKey("v", desc=True)])) == list("acdbe")
    assert ids(ranking.sort(missing, [ranking.SortKey("v", missing_last=True)], limit=2, offset=1)) == list("bd")
    assert sorted(ids(ranking.collapse(shoes, "tag", [ranking.SortKey("price", desc=True)]))) == ["b", "d", "e"]
    assert sorted(ids(ranking.collapse(shoes, "tag", [ranking.SortKey("title", desc=True)]))) == ["b", "c", "e"]
    alone = shoes.withColumn("tag", F.when(F.col("tag") != "hat", F.col("tag")))
    assert sorted(ids(ranking.collapse(alone, "tag", [ranking.SortKey("price")]))) == ["a", "c", "d", "e"]
    many = shoes.withColumn("a", F.array("price", "year"))
    for mode, want in (("min", "cdabe"), ("sum", "cadbe"), ("median", "cadbe"), ("avg", "cadbe")):
        assert ids(ranking.sort(many, [ranking.SortKey("a", mode=mode)])) == list(want), mode


def test_highlight(spark):
    docs = spark.createDataFrame([(1, "The quick brown fox. " + "filler words here " * 20 + "A Quick end"), (2, None)], "doc_id long, t string")
    corpus = Corpus(docs, Schema((Field("t", "text"),)))
    whole, none = ranking.highlight(corpus, docs, "t", Bool(must=(Match("t", "quick"),), must_not=(Term("t", "brown"),))).orderBy("doc_id").collect()
    assert whole["highlights"][0].count("<em>") == 2 and "<em>Quick</em> end" in whole["highlights"][0] and none["highlights"] == []
    cut = ranking.highlight(corpus, docs, "t", Match("t", "quick"), "[", "]", fragment_size=30).orderBy("doc_id").first()["highlights"]
    assert len(cut) == 2 and all(len(c) <= 40 and "uick]" in c for c in cut)


@pytest.mark.parametrize(
    ("analyzer", "text", "words", "want"),
    [
        ("english", "Foxes dens, a fox", "fox", "<em>Foxes</em> dens, a <em>fox</em>"),
        ({"tokenizer": "standard", "filters": ["lowercase", "ascii_folding"]}, "Ça va, ca", "ca", "<em>Ça</em> va, <em>ca</em>"),
        ({"tokenizer": {"type": "ngram", "min": 2, "max": 2}}, "aabaa", "aa", "<em>aa</em>b<em>aa</em>"),
        ({"tokenizer": "standard", "char_filters": ["html_strip"], "filters": ["lowercase"]}, "<b>Tag</b> tag", "tag", " <em>Tag</em>  <em>tag</em>"),
        ({"tokenizer": "whitespace", "filters": [{"type": "synonym", "rules": ["fast => quick"]}]}, "fast car", "quick", "<em>fast</em> car"),
    ],
)
def test_highlight_by_the_fields_analyzer(spark, analyzer, text, words, want):
    docs = spark.createDataFrame([(1, text)], "doc_id long, t string")
    own = {} if isinstance(analyzer, str) else {"own": analysis.custom(analyzer)}
    corpus = Corpus(docs, Schema((Field("t", "text", analyzer="own" if own else analyzer),)), own)
    assert ranking.highlight(corpus, docs, "t", Term("t", words)).first()["highlights"] == [want]
    assert own or [tuple(r)[1:] for r in analysis.analyze(spark, analysis.ANALYZERS["standard"], "a bc").collect()] == [(0, 0, 1), (1, 2, 4)]
    assert [tuple(r) for r in analysis.analyze(spark, analysis.custom({"tokenizer": {"type": "ngram", "min": 2, "max": 2}}), "aba").collect()] == [("ab", 0, 0, 2), ("ba", 1, 1, 3)]


@pytest.mark.parametrize("metric", ["cosine", "dot_product", "l2"])
def test_vectors(spark, metric):
    import numpy as np

    rng = np.random.default_rng(0)
    m, q = rng.normal(size=(300, 16)), rng.normal(size=16)
    score = {"cosine": (m @ q / np.linalg.norm(m, axis=1) / np.linalg.norm(q) + 1) / 2, "dot_product": (m @ q + 1) / 2, "l2": 1 / (1 + ((m - q) ** 2).sum(1))}[metric]
    docs = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(999, None)], "doc_id long, v array<double>")
    want = [int(i) for i in np.argsort(-score)[:7]]
    assert [r["doc_id"] for r in knn.knn(docs, "v", q, 7, metric).collect()] == want
    assert [r["doc_id"] for r in knn.knn(docs, "v", q, 3, metric, F.col("doc_id") % 2 == 0).collect()] == [int(i) for i in np.argsort(-score) if i % 2 == 0][:3]
    quantised = {r["doc_id"] for r in knn.knn_quantised(docs, "v", q, 7, metric).collect()}
    assert len(quantised & set(want)) >= 6
    batch = knn.batch_knn(docs, spark.createDataFrame([(5, q.tolist())], "query_id long, v array<double>"), "v", 7, metric)
    assert [r["doc_id"] for r in batch.orderBy("rank").collect()] == want


def test_vector_checks_and_fusion(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0])], "doc_id long, v array<double>")
    for bad in ([0.0, 0.0], [float("nan"), 1.0], []):
        with pytest.raises(ValueError):
            knn.knn(docs, "v", bad, 1)
    a = spark.createDataFrame([(1, 9.0), (2, 8.0)], "doc_id long, score double")
    b = spark.createDataFrame([(2, 1.0), (3, 0.5)], "doc_id long, score double")
    assert [(r["doc_id"], round(r["score"], 6)) for r in knn.fuse([a, b], 3).collect()] == [(2, round(1 / 61 + 1 / 62, 6)), (1, round(1 / 61, 6)), (3, round(1 / 62, 6))]


def test_product_quantisation(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    m = centres[rng.integers(0, 20, 400)] + rng.normal(scale=0.1, size=(400, 16))
    docs = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(999, None)], "doc_id long, v array<double>").cache()
    book = quantisation.train(docs, "v", 16, centroids=32, iterations=5)
    assert book.centroids.shape == (8, 32, 2) and quantisation.parts_for(6) == 2
    for metric in ("l2", "cosine"):
        want = {r["doc_id"] for r in knn.knn(docs, "v", m[0], 10, metric).collect()}
        got = {r["doc_id"] for r in quantisation.knn_coded(docs, "v", book, m[0], 10, metric).collect()}
        assert len(want & got) >= 9


def test_schemas():
    s = Schema((Field("a", "text"),))
    assert Schema.from_json(s.to_json()) == s and s.extended([Field("b", "long")]).ddl() == "`a` string, `b` bigint"
    for bad in (lambda: Field("", "text"), lambda: Field("a", "other"), lambda: Field("v", "dense_vector"), lambda: Schema((Field("a", "text"), Field("a", "long"))), lambda: s.extended([Field("a", "long")]), lambda: s.extended([], key="x"), lambda: s["none"]):
        with pytest.raises(SchemaError):
            bad()


def test_dates_are_typed(spark):
    docs = spark.createDataFrame([(1, "a", datetime.datetime(2020, 1, 1)), (2, "b", datetime.datetime(2021, 1, 1))], "doc_id long, _id string, at timestamp")
    corpus = Corpus(docs, Schema((Field("at", "date"),)))
    assert ids(scored(corpus, Range("at", datetime.datetime(2020, 6, 1)))) == ["b"]


def test_quantised_neighbours_are_exact(spark):
    import numpy as np

    m = np.random.default_rng(5).normal(size=(3000, 16))
    docs = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)] + [(3000, None), (3001, [0.0] * 16)], "doc_id long, v array<float>")
    book = quantisation.train(docs, "v", 16, parts=2, centroids=8, iterations=2)
    for metric in ("l2", "cosine", "dot_product"):
        for q in (m[7], m[8] + 0.5):
            want = knn.knn(docs, "v", q, 10, metric).collect()
            for got in (quantisation.knn_coded(docs, "v", book, q, 10, metric, candidates=10).collect(), knn.knn_quantised(docs, "v", q, 10, metric, candidates=10).collect()):
                assert [r["doc_id"] for r in got] == [r["doc_id"] for r in want]
                assert [r["score"] for r in got] == pytest.approx([r["score"] for r in want], rel=1e-12)
    assert quantisation.knn_coded(docs.where("doc_id < 4"), "v", book, m[7], 10).count() == 4


def test_batch_search_holds_a_tile_and_k_rows_a_query(spark, monkeypatch):
    """Many queries with ties against brute force, over blocks of few rows; no vector is fetched by the driver."""
    rng = np.random.default_rng(4)
    v = rng.integers(-3, 4, (300, 6)).astype(np.float32)
    v[100:200] = v[100]  # exact copies
    v[(v == 0).all(axis=1)] = 1
    docs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None)], "vec long, v array<float>").repartition(3)
    monkeypatch.setattr(knn, "BLOCK_ROWS", 7)
    for name in ("collect", "toLocalIterator", "toPandas", "toArrow"):
        monkeypatch.setattr(type(docs), name, lambda self, *a, **k: pytest.fail("rows on the driver"))
    found = knn.batch_knn(docs, docs.withColumn("query_id", F.col("vec")), "v", 5, "dot_product", doc_id="vec")
    monkeypatch.undo()
    s = v.astype(float) @ v.astype(float).T
    want = {(i, j, r) for i in range(300) for r, j in enumerate(np.lexsort((np.arange(300), -s[i]))[:5].tolist(), 1)}
    assert {(r["query_id"], r["vec"], r["rank"]) for r in found.collect()} == want
    # what a task holds for a query grows neither with the rows nor with their ties
    score, near = np.full((2, 3), -np.inf), np.full((2, 3), knn._NONE)
    for at in range(0, 1000, 100):
        knn._nearer(score, near, np.zeros((2, 100)), np.arange(1000 - at, 900 - at, -1))
    assert near.tolist() == [[1, 2, 3]] * 2 and score.tolist() == [[0.0] * 3] * 2


def test_stems_of_a_batch_are_made_once_a_term():
    lists = pa.array([["running", "shoes"], [], None, ["shoes", "running", "running"], ["at"]], pa.list_(pa.string()))
    assert analysis._stemmed(lists).to_pylist() == [None if x is None else [stem(t) for t in x] for x in lists.to_pylist()]
    assert analysis._stemmed(lists.slice(1, 3)).to_pylist() == analysis._stemmed(lists).to_pylist()[1:4]
