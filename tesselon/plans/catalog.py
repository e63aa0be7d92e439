"""Named queries and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.functions import analysis
from tesselon.operators import facets, knn, quantisation, ranking
from tesselon.operators.nodes import BM25F, Bool, Function, FunctionScore, Fuzzy, GeoDistance, Match, MatchAll, MatchNone, Phrase, Prefix, Range, Regexp, SpanNear, Term, Wildcard
from tesselon.operators.retrieval import Context, Corpus, best, find, matched, rescored
from tesselon.plans.conditions import from_json, from_text
from tesselon.plans.schema import Field, Schema
from tesselon.sources import index
from tesselon.sources.scratch import Scratch

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Registers fn(spark, sf_dir) under name, with its oracle if SQL can express it."""

    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


DOCUMENTS = Schema((Field("text", "text"), Field("lang", "keyword"), Field("source", "keyword"), Field("n_chars", "long")), key="doc_id")
PARTS = Schema((Field("p_name", "text"), Field("p_type", "text"), Field("p_brand", "keyword"), Field("p_size", "long"), Field("p_retailprice", "double")), key="p_partkey")
LINES = Schema((Field("l_quantity", "double"), Field("l_linenumber", "long"), Field("l_returnflag", "keyword"), Field("l_shipdate", "date")))
CUSTOMERS = Schema((Field("place", "geo_point"), Field("c_mktsegment", "keyword")))


def scanned_documents(spark: SparkSession, sf_dir: str) -> Corpus:
    return Corpus(table(spark, sf_dir, "documents"), DOCUMENTS)


_indexes: dict[tuple[str, str, str], str] = {}


def _indexed(corpus: Corpus, sf_dir: str, name: str) -> Corpus:
    """The corpus with its inverted index, which a session builds once a table, in the shared folder."""
    spark = corpus.docs.sparkSession
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _indexes:
        path = Scratch(spark, f"index-{name}").root
        index.invert(corpus, path)
        _indexes[key] = path
    return index.inverted(corpus, _indexes[key])


def documents(spark: SparkSession, sf_dir: str) -> Corpus:
    return _indexed(scanned_documents(spark, sf_dir), sf_dir, "documents")


def parts(spark: SparkSession, sf_dir: str) -> Corpus:
    return _indexed(Corpus(table(spark, sf_dir, "part").withColumn("doc_id", F.col("p_partkey")), PARTS), sf_dir, "part")


def customers(spark: SparkSession, sf_dir: str) -> Corpus:
    c = table(spark, sf_dir, "customer")
    place = F.struct(((F.col("c_custkey") * 37 % 18000) / 100 - 90).alias("lat"), ((F.col("c_custkey") * 91 % 36000) / 100 - 180).alias("lon"))
    return Corpus(c.withColumn("doc_id", F.col("c_custkey")).withColumn("place", place), CUSTOMERS)


def hits(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.round("score", 6).alias("score"))


# SQL pieces

_PAT = analysis.STANDARD.replace("'", "''")


def _toks(column: str) -> str:
    return f"list_transform(regexp_extract_all({column}, '{_PAT}'), lambda x: lower(x))"


def _corpus_sql(name: str = "documents", doc_id: str = "doc_id", column: str = "text", extra: str = "") -> str:
    """CTEs d (doc_id, t, dl, dlq and extra columns) and s (n, avg)."""
    return f"""d0 AS (SELECT {doc_id} AS doc_id, {_toks(column)} AS t{extra} FROM {name}),
d1 AS (SELECT *, len(t) AS dl, greatest(length(bin(len(t))) - 4, 0) AS e FROM d0),
d AS (SELECT *, (dl >> e) << e AS dlq FROM d1),
s AS (SELECT count(*) AS n, sum(dl) / nullif(count(*) FILTER (WHERE dl > 0), 0)::DOUBLE AS avg FROM d)"""


def _tf(term: str) -> str:
    return f"len(list_filter(t, lambda x: x = '{term}'))"


def _bm25_sql(term: str, boost: float = 1.0) -> str:
    """BM25 of a term for a row of d, s."""
    df = f"(SELECT count(*) FROM d WHERE list_contains(t, '{term}'))"
    return f"(CASE WHEN {_tf(term)} > 0 THEN {boost} * ln(1 + (n - {df} + 0.5) / ({df} + 0.5)) * {_tf(term)} / ({_tf(term)} + 1.2 * 0.25 + 1.2 * 0.75 * dlq / avg) ELSE 0 END)"


def _has(term: str) -> str:
    return f"list_contains(t, '{term}')"


def _select(where: str, score: str, corpus: str | None = None) -> str:
    return f"WITH {corpus or _corpus_sql()}\nSELECT doc_id, round({score}, 6) AS score FROM d, s WHERE {where}"


def _ranked(where: str, score: str, k: int, corpus: str | None = None, offset: int = 0) -> str:
    return f"WITH {corpus or _corpus_sql()}, f AS (SELECT doc_id, {score} AS score FROM d, s WHERE {where} ORDER BY score DESC, doc_id LIMIT {k} OFFSET {offset})\nSELECT doc_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INT) AS rank FROM f"


def _rank(found: DataFrame) -> DataFrame:
    return knn.ranked(found.select("doc_id", "score")).select("doc_id", F.round("score", 6).alias("score"), "rank")


def condition(name: str, make, node, where: str, score: str, corpus: str | None = None) -> None:
    """Registers all matches of a node with their scores."""
    query(name, _select(where, score, corpus))(lambda spark, sf_dir: hits(matched(make(spark, sf_dir), node)))


_PARTS_NAME = _corpus_sql("part", "p_partkey", "p_name", ", p_brand, p_size, p_retailprice, p_type")
_DOCS = _corpus_sql(extra=", lang, source, n_chars")

condition("term_bm25", documents, Term("text", "the"), _has("the"), _bm25_sql("the"))
condition("term_keyword", documents, Term("lang", "fr"), "lang = 'fr'", "ln(1 + (n - (SELECT count(*) FROM d WHERE lang = 'fr') + 0.5) / ((SELECT count(*) FROM d WHERE lang = 'fr') + 0.5)) / (1 + 1.2 * 0.25 + 1.2 * 0.75)", _DOCS)
condition("term_number", parts, Term("p_size", 7), "p_size = 7", "1.0", _PARTS_NAME)
condition("match_or", documents, Match("text", "de en"), f"{_has('de')} OR {_has('en')}", f"{_bm25_sql('de')} + {_bm25_sql('en')}")
condition("match_and", documents, Match("text", "the and of", "must"), f"{_has('the')} AND {_has('and')} AND {_has('of')}", f"{_bm25_sql('the')} + {_bm25_sql('and')} + {_bm25_sql('of')}")
condition("match_repeated_term", documents, Match("text", "de de en"), f"{_has('de')} OR {_has('en')}", f"{_bm25_sql('de', 2.0)} + {_bm25_sql('en')}")
condition("match_all", documents, MatchAll(), "true", "1.0")
condition("match_none", documents, MatchNone(), "false", "0.0")
condition("prefix", documents, Prefix("text", "erth", boost=2.0), "len(list_filter(t, lambda x: starts_with(x, 'erth'))) > 0", "2.0")
condition("prefix_keyword", documents, Prefix("source", "src1"), "starts_with(source, 'src1')", "1.0", _DOCS)
condition("wildcard", documents, Wildcard("text", "th?t*ion"), "len(list_filter(t, lambda x: regexp_full_match(x, 'th.t.*ion'))) > 0", "1.0")
condition("regexp", documents, Regexp("text", "(and|or)[a-m]+t"), "len(list_filter(t, lambda x: regexp_full_match(x, '(and|or)[a-m]+t'))) > 0", "1.0")
condition("fuzzy", parts, Fuzzy("p_brand", "Brand#12"), "levenshtein(p_brand, 'Brand#12') <= 2", "1.0", _PARTS_NAME)
condition("fuzzy_one_edit", documents, Fuzzy("lang", "em", max_edits=1), "levenshtein(lang, 'em') <= 1", "1.0", _DOCS)
condition("range_long", documents, Range("n_chars", 500, 2000, True, False), "n_chars >= 500 AND n_chars < 2000", "1.0", _DOCS)
condition("range_double", parts, Range("p_retailprice", 1000.0, None, False), "p_retailprice > 1000.0", "1.0", _PARTS_NAME)
condition("range_keyword", documents, Range("lang", "de", "es"), "lang BETWEEN 'de' AND 'es'", "1.0", _DOCS)
condition("range_text", documents, Range("text", "zu", "zz"), "len(list_filter(t, lambda x: x >= 'zu' AND x <= 'zz')) > 0", "1.0")
condition(
    "bool_must_filter_mustnot", documents,
    Bool(must=(Term("text", "the"),), filter=(Range("n_chars", 1000, None),), must_not=(Term("text", "with"),)),
    f"{_has('the')} AND n_chars >= 1000 AND NOT {_has('with')}", _bm25_sql("the"), _DOCS,
)
condition(
    "bool_should_msm2", documents,
    Bool(should=(Term("text", "the"), Term("text", "de"), Term("text", "en"), Prefix("text", "zu")), minimum_should_match=2),
    f"{_has('the')}::INT + {_has('de')}::INT + {_has('en')}::INT + (len(list_filter(t, lambda x: starts_with(x, 'zu'))) > 0)::INT >= 2",
    f"{_bm25_sql('the')} + {_bm25_sql('de')} + {_bm25_sql('en')} + (len(list_filter(t, lambda x: starts_with(x, 'zu'))) > 0)::INT",
)
condition(
    "bool_nested_boost", documents,
    Bool(must=(Bool(should=(Term("text", "the", boost=3.0), Term("text", "la"))), Term("lang", "en")), should=(Term("text", "with"),), boost=2.0),
    f"({_has('the')} OR {_has('la')}) AND lang = 'en'",
    f"2.0 * ({_bm25_sql('the', 3.0)} + {_bm25_sql('la')} + {_bm25_sql('with')} + ln(1 + (n - (SELECT count(*) FROM d WHERE lang = 'en') + 0.5) / ((SELECT count(*) FROM d WHERE lang = 'en') + 0.5)) / (1 + 1.2 * 0.25 + 1.2 * 0.75))", _DOCS,
)
condition("bool_pure_must_not", documents, Bool(must_not=(Term("text", "the"),)), "false", "0.0")

# positions in SQL: i is the place of a token, from 1


def _at(term: str) -> str:
    return f"list_filter(range(1, len(t) + 1), lambda i: t[i] = '{term}')"


def _next(lists: list[str], slop: int) -> str:
    """From some first place the nearest later ones, in order."""
    at = "q"
    for i, p in enumerate(lists[1:]):
        at = f"list_min(list_filter({p}, lambda x{i}: x{i} > {at}))"
    return f"len(list_filter({lists[0]}, lambda q: coalesce({at} - q - {len(lists) - 1} <= {slop}, false))) > 0"


condition("phrase_exact", documents, Phrase("text", "of the"), _next([_at("of"), _at("the")], 0), f"{_bm25_sql('of')} + {_bm25_sql('the')}")
condition("phrase_slop", documents, Phrase("text", "the of and", slop=6), _next([_at("the"), _at("of"), _at("and")], 6), f"{_bm25_sql('the')} + {_bm25_sql('of')} + {_bm25_sql('and')}")
condition("span_near_ordered", documents, SpanNear("text", ("with", "the"), slop=3), _next([_at("with"), _at("the")], 3), f"{_bm25_sql('with')} + {_bm25_sql('the')}")
_FIRST = f"list_concat({_at('with')}, {_at('the')})"
condition(
    "span_near_unordered", documents, SpanNear("text", ("with", "the"), slop=3, in_order=False),
    f"len(list_filter({_FIRST}, lambda m: coalesce(list_min(list_filter({_at('with')}, lambda x: x >= m)) - m - 1 <= 3 AND list_min(list_filter({_at('the')}, lambda x: x >= m)) - m - 1 <= 3, false))) > 0",
    f"{_bm25_sql('with')} + {_bm25_sql('the')}",
)


@query("match_top10", _ranked(f"{_has('the')} OR {_has('de')} OR {_has('und')}", f"{_bm25_sql('the')} + {_bm25_sql('de')} + {_bm25_sql('und')}", 10))
def match_top10(spark, sf_dir):
    return _rank(best(documents(spark, sf_dir), Match("text", "the de und"), 10))


@query("page_from_size", _ranked(_has("the"), _bm25_sql("the"), 10, offset=20))
def page_from_size(spark, sf_dir):
    return _rank(best(documents(spark, sf_dir), Term("text", "the"), 10, offset=20))


# the same without an index: each text is analysed where it is read

condition("scan_match_or", scanned_documents, Match("text", "de en"), f"{_has('de')} OR {_has('en')}", f"{_bm25_sql('de')} + {_bm25_sql('en')}")
condition("scan_phrase_slop", scanned_documents, Phrase("text", "of the", slop=4), _next([_at("of"), _at("the")], 4), f"{_bm25_sql('of')} + {_bm25_sql('the')}")
condition("scan_prefix", scanned_documents, Prefix("text", "erth", boost=2.0), "len(list_filter(t, lambda x: starts_with(x, 'erth'))) > 0", "2.0")
condition(
    "scan_bool", scanned_documents,
    Bool(must=(Term("text", "the"),), filter=(Range("n_chars", 1000, None),), must_not=(Term("text", "with"),)),
    f"{_has('the')} AND n_chars >= 1000 AND NOT {_has('with')}", _bm25_sql("the"), _DOCS,
)

# conditions from a line of text and from JSON

condition("text_form", documents, from_text('the -with lang:en n_chars:[500 TO 5000}', "text"), f"({_has('the')} OR lang = 'en' OR n_chars >= 500 AND n_chars < 5000) AND NOT {_has('with')}", f"{_bm25_sql('the')} + (CASE WHEN lang = 'en' THEN ln(1 + (n - (SELECT count(*) FROM d WHERE lang = 'en') + 0.5) / ((SELECT count(*) FROM d WHERE lang = 'en') + 0.5)) / (1 + 1.2 * 0.25 + 1.2 * 0.75) ELSE 0 END) + (n_chars >= 500 AND n_chars < 5000)::INT", _DOCS)
condition("text_form_and", documents, from_text('de AND "of the" OR erth*', "text"), _next([_at("of"), _at("the")], 0), f"{_bm25_sql('de')} + {_bm25_sql('of')} + {_bm25_sql('the')} + (len(list_filter(t, lambda x: starts_with(x, 'erth'))) > 0)::INT")
condition(
    "json_form", documents,
    from_json('{"bool": {"must": [{"match": {"field": "text", "query": "the and of", "operator": "and"}}], "filter": [{"range": {"field": "n_chars", "gte": 500, "lt": 9000}}], "must_not": [{"term": {"field": "lang", "value": "fr"}}], "should": [{"fuzzy": {"field": "lang", "value": "em", "max_edits": 1}, "boost": 3}]}}'),
    f"{_has('the')} AND {_has('and')} AND {_has('of')} AND n_chars >= 500 AND n_chars < 9000 AND NOT (lang = 'fr')",
    f"{_bm25_sql('the')} + {_bm25_sql('and')} + {_bm25_sql('of')} + CASE WHEN levenshtein(lang, 'em') <= 1 THEN 3.0 ELSE 0.0 END", _DOCS,
)


@query("rescore_phrase", f"""WITH {_corpus_sql()}, b AS (SELECT doc_id, {_bm25_sql('the')} + {_bm25_sql('of')} AS base, CASE WHEN {_next([_at('of'), _at('the')], 0)} THEN {_bm25_sql('of')} + {_bm25_sql('the')} ELSE 0 END AS again
  FROM d, s WHERE {_has('the')} OR {_has('of')} ORDER BY base DESC, doc_id LIMIT 50)
SELECT doc_id, round(1.0 * base + 2.0 * again, 6) AS score, CAST(row_number() OVER (ORDER BY 1.0 * base + 2.0 * again DESC, doc_id) AS INT) AS rank FROM b QUALIFY rank <= 10""")
def rescore_phrase(spark, sf_dir):
    return _rank(rescored(documents(spark, sf_dir), Match("text", "the of"), Phrase("text", "of the"), window=50, k=10, rescore_weight=2.0))


@query("bm25f_two_fields", f"""WITH d0 AS (SELECT p_partkey AS doc_id, {_toks('p_name')} AS a, {_toks('p_type')} AS b FROM part),
d1 AS (SELECT *, greatest(length(bin(len(a))) - 4, 0) AS ea, greatest(length(bin(len(b))) - 4, 0) AS eb FROM d0),
s AS (SELECT count(*) AS n, sum(len(a)) / count(*) FILTER (WHERE len(a) > 0)::DOUBLE AS avga, sum(len(b)) / count(*) FILTER (WHERE len(b) > 0)::DOUBLE AS avgb,
  greatest(count(*) FILTER (WHERE list_contains(a, 'steel')), count(*) FILTER (WHERE list_contains(b, 'steel'))) AS df FROM d0),
p AS (SELECT doc_id, n, df, 2.0 * len(list_filter(a, lambda x: x = 'steel')) / (0.25 + 0.75 * ((len(a) >> ea) << ea) / avga) + 1.0 * len(list_filter(b, lambda x: x = 'steel')) / 1.0 AS pt FROM d1, s)
SELECT doc_id, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * pt / (pt + 1.2), 6) AS score FROM p WHERE pt > 0""")
def bm25f_two_fields(spark, sf_dir):
    return hits(matched(parts(spark, sf_dir), BM25F(("steel",), (("p_name", 2.0, None), ("p_type", 1.0, 0.0)))))


def function_score(name: str, functions: tuple[Function, ...], sql: str, where: str = "true", **options) -> None:
    node = FunctionScore(Term("text", "the"), functions, **options)
    query(name, _select(f"{_has('the')} AND ({where})", sql.replace("BASE", _bm25_sql("the")), _DOCS))(lambda spark, sf_dir: hits(matched(documents(spark, sf_dir), node)))


for _mod, _sql in (("none", "V"), ("log", "log10(V)"), ("log1p", "log10(V + 1)"), ("log2p", "log10(V + 2)"), ("ln", "ln(V)"), ("ln1p", "ln(V + 1)"), ("ln2p", "ln(V + 2)"), ("square", "V * V"), ("sqrt", "sqrt(V)"), ("reciprocal", "1.0 / V")):
    function_score(f"function_score_field_{_mod}", (Function("field_value_factor", field="n_chars", factor=0.1, modifier=_mod),), "BASE * " + _sql.replace("V", "(n_chars * 0.1::DOUBLE)"))
_FAR = "greatest(abs(n_chars - 1000.0) - 100.0, 0.0)"
function_score("function_score_decay_gauss", (Function("gauss", field="n_chars", origin=1000, scale=500, offset=100),), f"BASE * exp(-({_FAR} * {_FAR}) / (2 * (-(500.0::DOUBLE ^ 2) / (2 * ln(0.5)))))")
function_score("function_score_decay_exp", (Function("exp", field="n_chars", origin=1000, scale=500, offset=100),), f"BASE * exp(ln(0.5) / 500.0 * {_FAR})")
function_score("function_score_decay_linear", (Function("linear", field="n_chars", origin=1000, scale=500, offset=100),), f"BASE * greatest(0.0, (1000.0 - {_FAR}) / 1000.0)")
_F1, _F2 = Function("weight", weight=3.0, filter=Term("lang", "en")), Function("field_value_factor", weight=0.5, field="n_chars", modifier="ln1p")
_S1, _S2 = "(CASE WHEN lang = 'en' THEN 3.0 END)", "(0.5 * ln(n_chars + 1.0))"
for _mode, _sql in (("multiply", f"coalesce({_S1}, 1.0) * {_S2}"), ("sum", f"coalesce({_S1}, 0.0) + {_S2}"), ("avg", f"(coalesce({_S1}, 0.0) + {_S2}) / (1 + (lang = 'en')::INT)"), ("max", f"greatest({_S1}, {_S2})"), ("min", f"least({_S1}, {_S2})"), ("first", f"coalesce({_S1}, {_S2})")):
    function_score(f"function_score_mode_{_mode}", (_F1, _F2), f"BASE + {_sql}", score_mode=_mode, boost_mode="sum")
for _mode, _sql in (("multiply", "BASE * {}"), ("replace", "{}"), ("sum", "BASE + {}"), ("avg", "(BASE + {}) / 2"), ("max", "greatest(BASE, {})"), ("min", "least(BASE, {})")):
    function_score(f"function_score_boost_{_mode}", (_F2,), _sql.format(_S2), boost_mode=_mode)
function_score("function_score_max_boost", (_F2,), f"BASE * least({_S2}, 3.0)", max_boost=3.0)
function_score("function_score_min_score", (_F2,), f"BASE * {_S2}", where=f"{_bm25_sql('the')} * {_S2} >= 1.0", min_score=1.0)


_BITS = "18446744073709551616::UHUGEINT"  # 2^64: products of 64-bit numbers fit into 128 bits


@query("function_score_random", f"""WITH a AS (SELECT doc_id, xor(42::UHUGEINT, (doc_id::UHUGEINT * 11400714819323198485::UHUGEINT) % {_BITS}) AS x FROM documents),
b AS (SELECT doc_id, (xor(x, x >> 30) * 13787848793156543929::UHUGEINT) % {_BITS} AS x FROM a), c AS (SELECT doc_id, (xor(x, x >> 27) * 10723151780598845931::UHUGEINT) % {_BITS} AS x FROM b)
SELECT doc_id, round((xor(x, x >> 31) >> 11)::DOUBLE / 9007199254740992.0::DOUBLE, 6) AS score FROM c""")
def function_score_random(spark, sf_dir):
    return hits(matched(documents(spark, sf_dir), FunctionScore(MatchAll(), (Function("random", seed=42),))))


_HAVERSINE = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(lat - 10.5) / 2), 2) + cos(radians(10.5)) * cos(radians(lat)) * pow(sin(radians(lon - 20.25) / 2), 2))))"
_PLACES = "SELECT c_custkey AS doc_id, c_mktsegment, (c_custkey * 37 % 18000) / 100.0::DOUBLE - 90 AS lat, (c_custkey * 91 % 36000) / 100.0::DOUBLE - 180 AS lon FROM customer"


@query("geo_distance", f"SELECT doc_id, 1.0::DOUBLE AS score FROM ({_PLACES}) WHERE {_HAVERSINE} <= 4000000")
def geo_distance(spark, sf_dir):
    return hits(matched(customers(spark, sf_dir), GeoDistance("place", 10.5, 20.25, 4_000_000)))


@query("sort_geo", f"SELECT doc_id, CAST(row_number() OVER (ORDER BY {_HAVERSINE}, doc_id) AS INT) AS rank FROM ({_PLACES}) QUALIFY rank <= 20")
def sort_geo(spark, sf_dir):
    return _numbered(customers(spark, sf_dir).docs, [ranking.SortKey("place", origin=(10.5, 20.25))], 20)


def _numbered(df: DataFrame, keys: list, limit: int, offset: int = 0) -> DataFrame:
    """doc_id and rank of a page of a sort."""
    from pyspark.sql import Window

    page = ranking.sort(df, keys, limit, offset)
    w = Window.partitionBy(F.lit(0)).orderBy(*[k.order(page) for k in keys], "doc_id")
    return page.select("doc_id", F.row_number().over(w).alias("rank"))


@query("range_date", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1995-02-01'")
def range_date(spark, sf_dir):
    import datetime

    lines = table(spark, sf_dir, "lineitem")
    day = lambda m: datetime.datetime(1995, m, 1)
    corpus = Corpus(lines, LINES)
    node = Range("l_shipdate", day(1), day(2), True, False)  # no text is read, so the condition goes to the reader
    return lines.where(node.build(Context(corpus))[0]).select("l_orderkey", "l_linenumber")


# aggregations


@query("terms_agg", "SELECT o_orderpriority AS key, count(*) AS doc_count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def terms_agg(spark, sf_dir):
    return facets.terms(table(spark, sf_dir, "orders"), "o_orderpriority", 3)


@query("terms_by_key", "SELECT event_type AS key, count(*) AS doc_count, round(sum(value), 4) AS total FROM events GROUP BY 1")
def terms_by_key(spark, sf_dir):
    return facets.terms(table(spark, sf_dir, "events"), "event_type", 0, by_key=True, metrics={"total": F.round(F.sum("value"), 4)})


@query("terms_multi_valued", "SELECT key, count(*) AS doc_count FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_type, ' ')) AS key FROM part) GROUP BY key ORDER BY 2 DESC, 1 LIMIT 10")
def terms_multi_valued(spark, sf_dir):
    return facets.terms(table(spark, sf_dir, "part").withColumn("tags", F.split("p_type", " ")), "tags", 10)


@query("terms_nested", """WITH p AS (SELECT o_orderpriority AS parent_key, count(*) AS parent_count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)
, c AS (SELECT parent_key, parent_count, o_orderstatus AS key, count(*) AS doc_count FROM orders JOIN p ON o_orderpriority = parent_key GROUP BY 1, 2, 3)
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY parent_key ORDER BY doc_count DESC, key) <= 2""")
def terms_nested(spark, sf_dir):
    return facets.nested_terms(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", 3, 2)


@query("histogram", "SELECT floor((o_totalprice - 500.0) / 10000.0) * 10000.0 + 500.0 AS key, count(*) AS doc_count FROM orders GROUP BY 1")
def histogram(spark, sf_dir):
    return facets.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 10000.0, 500.0)


@query("date_histogram", "SELECT CAST(floor(epoch_us(ts) / 3600000000) * 3600 AS BIGINT) AS key, count(*) AS doc_count FROM events GROUP BY 1")
def date_histogram(spark, sf_dir):
    return facets.date_histogram(table(spark, sf_dir, "events"), "ts", 3600)


@query("range_agg", """SELECT 'cheap' AS key, count(*) FILTER (WHERE p_retailprice < 1000) AS doc_count FROM part UNION ALL
SELECT 'middle', count(*) FILTER (WHERE p_retailprice >= 900 AND p_retailprice < 1500) FROM part UNION ALL SELECT 'dear', count(*) FILTER (WHERE p_retailprice >= 1e9) FROM part""")
def range_agg(spark, sf_dir):
    return facets.ranges(table(spark, sf_dir, "part"), "p_retailprice", [("cheap", None, 1000.0), ("middle", 900.0, 1500.0), ("dear", 1e9, None)])


@query("stats_agg", "SELECT count(l_quantity) AS count, sum(l_quantity) AS sum, min(l_quantity) AS min, max(l_quantity) AS max, round(avg(l_quantity), 8) AS avg FROM lineitem")
def stats_agg(spark, sf_dir):
    return facets.metrics(table(spark, sf_dir, "lineitem"), "l_quantity").withColumn("avg", F.round("avg", 8))


for _kind in ("min", "max", "avg", "sum", "count"):
    _own = "CAST(coalesce(count(nullif(l_linenumber % 7, 0)), 0) AS BIGINT)" if _kind == "count" else f"round(coalesce({_kind}(nullif(l_linenumber % 7, 0)), 0)::DOUBLE, 8)"
    query(f"metric_{_kind}", f"SELECT {_own} AS {_kind} FROM lineitem")(lambda spark, sf_dir, k=_kind: facets.metrics(table(spark, sf_dir, "lineitem").withColumn("v", F.expr("nullif(l_linenumber % 7, 0)")), "v", [k]).withColumn(k, F.round(k, 8) if k != "count" else F.col(k)))


@query("metrics_empty", "SELECT 0::BIGINT AS count, 0.0::DOUBLE AS sum, 0.0::DOUBLE AS min, 0.0::DOUBLE AS max, 0.0::DOUBLE AS avg")
def metrics_empty(spark, sf_dir):
    return facets.metrics(table(spark, sf_dir, "part").where("p_size < 0"), "p_retailprice")


@query("cardinality_exact", "SELECT count(DISTINCT user_id) AS value FROM events")
def cardinality_exact(spark, sf_dir):
    return facets.cardinality(table(spark, sf_dir, "events"), "user_id", exact=True)


@query("cardinality_sketch", "SELECT true AS near")
def cardinality_sketch(spark, sf_dir):
    """Whether the sketch is within three per cent of the exact number."""
    e = table(spark, sf_dir, "events")
    both = facets.cardinality(e, "user_id").crossJoin(facets.cardinality(e, "user_id", exact=True).withColumnRenamed("value", "exact"))  # one row each
    return both.select((F.abs(F.col("value") - F.col("exact")) <= 0.03 * F.col("exact") + 1).alias("near"))


@query("percentiles_exact", "SELECT '50' AS key, round(quantile_cont(value, 0.5), 6) AS value FROM events UNION ALL SELECT '95', round(quantile_cont(value, 0.95), 6) FROM events UNION ALL SELECT '99', round(quantile_cont(value, 0.99), 6) FROM events")
def percentiles_exact(spark, sf_dir):
    return facets.percentiles(table(spark, sf_dir, "events"), "value", exact=True).withColumn("value", F.round("value", 6))


@query("percentiles_sketch", "SELECT * FROM (VALUES ('50', true), ('95', true), ('99', true)) v(key, near)")
def percentiles_sketch(spark, sf_dir):
    """Whether each value has its share of all values below it, to one part in a hundred."""
    e = table(spark, sf_dir, "events")
    points = facets.percentiles(e, "value")
    ranks = e.crossJoin(F.broadcast(points.withColumnRenamed("value", "p"))).groupBy("key").agg(F.avg((F.col("value") <= F.col("p")).cast("double")).alias("share"))  # three rows
    return ranks.select("key", (F.abs(F.col("share") - F.col("key").cast("double") / 100) <= 0.01).alias("near"))


@query("histogram_in_terms", """WITH p AS (SELECT o_orderpriority AS parent_key, count(*) AS c FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)
SELECT parent_key, floor(o_totalprice / 50000.0) * 50000.0 AS key, count(*) AS doc_count FROM orders JOIN p ON o_orderpriority = parent_key GROUP BY 1, 2""")
def histogram_in_terms(spark, sf_dir):
    return facets.histogram(facets.within(table(spark, sf_dir, "orders"), "o_orderpriority", 3), "o_totalprice", 50000.0, by=("parent_key",))


@query("percentiles_in_terms", "SELECT event_type AS parent_key, '50' AS key, round(quantile_cont(value, 0.5), 6) AS value FROM events GROUP BY 1")
def percentiles_in_terms(spark, sf_dir):
    return facets.percentiles(facets.within(table(spark, sf_dir, "events"), "event_type", 0), "value", (50.0,), True, by=("parent_key",)).withColumn("value", F.round("value", 6))


@query("range_in_terms_in_terms", """SELECT o_orderpriority AS parent_key, o_orderstatus AS status, k AS key, count(*) FILTER (WHERE CASE k WHEN 'low' THEN o_totalprice < 100000 ELSE o_totalprice >= 100000 END) AS doc_count
FROM orders, (VALUES ('low'), ('high')) v(k) GROUP BY 1, 2, 3""")
def range_in_terms_in_terms(spark, sf_dir):
    inner = facets.within(facets.within(table(spark, sf_dir, "orders"), "o_orderpriority", 0), "o_orderstatus", 0, "status", ("parent_key",))
    return facets.ranges(inner, "o_totalprice", [("low", None, 1e5), ("high", 1e5, None)], ("parent_key", "status"))


@query("histogram_key_text", "SELECT CASE WHEN k = floor(k) THEN CAST(k AS BIGINT)::VARCHAR ELSE k::VARCHAR END AS key, count(*) AS doc_count FROM (SELECT floor(l_quantity / 2.5) * 2.5::DOUBLE AS k FROM lineitem) GROUP BY 1")
def histogram_key_text(spark, sf_dir):
    return facets.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", 2.5).select(facets.key_text(F.col("key")).alias("key"), "doc_count")


@query("facets_of_match", f"WITH {_DOCS} SELECT source AS key, count(*) AS doc_count FROM d WHERE {_has('the')} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def facets_of_match(spark, sf_dir):
    return facets.terms(matched(documents(spark, sf_dir), Term("text", "the"), ["source"]), "source", 5)


# sorting and collapsing


def _orders(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("doc_id", F.col("o_orderkey")).withColumn("v", F.expr("nullif(o_custkey % 7, 0)"))


def _sort_sql(order: str, k: int) -> str:
    return f"SELECT o_orderkey AS doc_id, CAST(row_number() OVER (ORDER BY {order}, o_orderkey) AS INT) AS rank FROM (SELECT *, nullif(o_custkey % 7, 0) AS v FROM orders) QUALIFY rank <= {k}"


@query("sort_multi", _sort_sql("o_orderpriority DESC NULLS FIRST, o_totalprice ASC NULLS FIRST", 25))
def sort_multi(spark, sf_dir):
    return _numbered(_orders(spark, sf_dir), [ranking.SortKey("o_orderpriority", desc=True), ranking.SortKey("o_totalprice")], 25)


@query("sort_missing_first", _sort_sql("v DESC NULLS FIRST", 25))
def sort_missing_first(spark, sf_dir):
    return _numbered(_orders(spark, sf_dir), [ranking.SortKey("v", desc=True)], 25)


@query("sort_missing_last", _sort_sql("v ASC NULLS LAST", 25))
def sort_missing_last(spark, sf_dir):
    return _numbered(_orders(spark, sf_dir), [ranking.SortKey("v", missing_last=True)], 25)


@query("sort_multi_valued", "SELECT p_partkey AS doc_id, CAST(row_number() OVER (ORDER BY list_min(string_split(p_type, ' ')), p_partkey) AS INT) AS rank FROM part QUALIFY rank <= 20")
def sort_multi_valued(spark, sf_dir):
    return _numbered(table(spark, sf_dir, "part").withColumn("doc_id", F.col("p_partkey")).withColumn("tags", F.split("p_type", " ")), [ranking.SortKey("tags")], 20)


@query("collapse", "SELECT o_orderkey AS doc_id, o_custkey FROM (SELECT *, nullif(o_custkey % 1000, 0) AS g FROM orders) QUALIFY row_number() OVER (PARTITION BY coalesce('+' || g, '-' || o_orderkey) ORDER BY o_totalprice DESC, o_orderkey) = 1")
def collapse(spark, sf_dir):
    rows = _orders(spark, sf_dir).withColumn("g", F.expr("nullif(o_custkey % 1000, 0)"))
    return ranking.collapse(rows, "g", [ranking.SortKey("o_totalprice", desc=True)]).select("doc_id", "o_custkey")


@query("collapse_by_score", f"WITH {_DOCS} SELECT source, doc_id, round({_bm25_sql('the')}, 6) AS score FROM d, s WHERE {_has('the')} QUALIFY row_number() OVER (PARTITION BY source ORDER BY {_bm25_sql('the')} DESC, doc_id) = 1")
def collapse_by_score(spark, sf_dir):
    found = matched(documents(spark, sf_dir), Term("text", "the"), ["source"])
    return ranking.collapse(found, "source", [ranking.SortKey("_score", desc=True)]).select("source", "doc_id", F.round("score", 6).alias("score"))


_PIECES = f"regexp_extract_all(text, '(?s){_PAT}|.')"


@query("highlight", f"""WITH {_corpus_sql(extra=', text')}, f AS (SELECT doc_id, text FROM d, s WHERE {_has('the')} OR {_has('with')} ORDER BY {_bm25_sql('the')} + {_bm25_sql('with')} DESC, doc_id LIMIT 10)
SELECT doc_id, array_to_string(list_transform({_PIECES}, lambda x: CASE WHEN lower(x) IN ('the', 'with') THEN '<em>' || x || '</em>' ELSE x END), '') AS marked FROM f""")
def highlight(spark, sf_dir):
    corpus, node = documents(spark, sf_dir), Match("text", "the with")
    return ranking.highlight(corpus, find(corpus, node, 10), "text", node).select("doc_id", F.element_at("highlights", 1).alias("marked"))


# vectors


def _vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumn("doc_id", F.col("vec_id"))


def _query_vector(seed: int = 1, dims: int = 64) -> list[float]:
    return [((i * 37 + seed * 101) % 19 - 9) / 10 for i in range(dims)]


_V = f"{_query_vector()}::DOUBLE[]"
_SIM = {"cosine": f"(list_cosine_similarity(embedding::DOUBLE[], {_V}) + 1) / 2", "dot_product": f"(list_inner_product(embedding::DOUBLE[], {_V}) + 1) / 2", "l2": f"1 / (1 + list_distance(embedding::DOUBLE[], {_V}) ^ 2)"}


def _knn_sql(metric: str, where: str = "true", k: int = 10) -> str:
    return f"WITH f AS (SELECT vec_id AS doc_id, {_SIM[metric]} AS score FROM embeddings WHERE {where} ORDER BY score DESC, doc_id LIMIT {k}) SELECT doc_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INT) AS rank FROM f"


for _metric in _SIM:
    query(f"knn_{_metric.replace('dot_product', 'dot')}", _knn_sql(_metric))(lambda spark, sf_dir, m=_metric: _rank(knn.knn(_vectors(spark, sf_dir), "embedding", _query_vector(), 10, m)))


@query("knn_filtered", _knn_sql("cosine", "label % 3 = 1"))
def knn_filtered(spark, sf_dir):
    return _rank(knn.knn(_vectors(spark, sf_dir), "embedding", _query_vector(), 10, "cosine", F.col("label") % 3 == 1))


@query("knn_int8", _knn_sql("l2"))
def knn_int8(spark, sf_dir):
    return _rank(knn.knn_quantised(_vectors(spark, sf_dir), "embedding", _query_vector(), 10, "l2"))


@query("knn_pq")
def knn_pq(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    book = quantisation.train(v, "embedding", 64, iterations=4)
    return _rank(quantisation.knn_coded(v, "embedding", book, _query_vector(), 10, "l2", candidates=100))


@query("knn_batch", """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0)
SELECT query_id, vec_id AS doc_id, round((list_cosine_similarity(embedding::DOUBLE[], v) + 1) / 2, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(embedding::DOUBLE[], v) DESC, vec_id) AS INT) AS rank
FROM q, embeddings QUALIFY rank <= 5""")
def knn_batch(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return knn.batch_knn(v, v.where("vec_id % 50 = 0").withColumn("query_id", F.col("vec_id")), "embedding", 5).withColumn("score", F.round("score", 6))


@query("hybrid_rrf", f"""WITH {_corpus_sql()}, a AS (SELECT doc_id, {_bm25_sql('the')} + {_bm25_sql('and')} AS score FROM d, s WHERE {_has('the')} OR {_has('and')} ORDER BY score DESC, doc_id LIMIT 20),
b AS (SELECT vec_id AS doc_id, {_SIM['cosine']} AS score FROM embeddings ORDER BY score DESC, doc_id LIMIT 20),
r AS (SELECT doc_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) AS s FROM a UNION ALL SELECT doc_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) FROM b)
SELECT doc_id, round(sum(s), 6) AS score FROM r GROUP BY doc_id ORDER BY sum(s) DESC, doc_id LIMIT 20""")
def hybrid_rrf(spark, sf_dir):
    text = best(documents(spark, sf_dir), Match("text", "the and"), 20)
    vectors = knn.knn(_vectors(spark, sf_dir), "embedding", _query_vector(), 20)
    return hits(knn.fuse([text, vectors], 20))


# analysis: counts of terms, so that no arrays are compared


def _term_counts(df: DataFrame, tokens) -> DataFrame:
    return df.select(F.explode(tokens).alias("t")).groupBy(F.col("t.term").alias("term")).agg(F.count("*").alias("n"), F.sum("t.pos").alias("places"))


def _counts_sql(tokens: str, source: str) -> str:
    return f"WITH x AS (SELECT {tokens} AS t FROM {source}), y AS (SELECT unnest(t) AS term, unnest(range(0, len(t))) AS pos FROM x) SELECT term, count(*) AS n, CAST(sum(pos) AS BIGINT) AS places FROM y GROUP BY term"


@query("analyze_standard", _counts_sql(_toks("text"), "documents"))
def analyze_standard(spark, sf_dir):
    return _term_counts(table(spark, sf_dir, "documents"), analysis.ANALYZERS["standard"](F.col("text")))


@query("analyze_simple", _counts_sql(r"list_transform(regexp_extract_all(text, '\p{L}+'), lambda x: lower(x))", "documents"))
def analyze_simple(spark, sf_dir):
    return _term_counts(table(spark, sf_dir, "documents"), analysis.ANALYZERS["simple"](F.col("text")))


@query("analyze_whitespace", _counts_sql(r"regexp_extract_all(text, '[^\s\x{0b}\x{85}\p{Z}]+')", "documents"))
def analyze_whitespace(spark, sf_dir):
    return _term_counts(table(spark, sf_dir, "documents"), analysis.custom({"tokenizer": "whitespace"})(F.col("text")))


@query("analyze_html", _counts_sql(_toks("replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'gs'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&')"), "pages"))
def analyze_html(spark, sf_dir):
    return _term_counts(table(spark, sf_dir, "pages"), analysis.custom({"tokenizer": "standard", "filters": ["lowercase"], "char_filters": ["html_strip"]})(F.col("html")))


@query("analyze_ngram", "WITH x AS (SELECT p_partkey, unnest(range(1, greatest(length(p_brand) - 1, 0) + 1)) AS i, p_brand AS b FROM part), y AS (SELECT b[i:i + k - 1] AS term FROM x, (VALUES (2), (3)) v(k) WHERE i + k - 1 <= length(b)) SELECT term, count(*) AS n FROM y GROUP BY term")
def analyze_ngram(spark, sf_dir):
    grams = analysis.custom({"tokenizer": {"type": "ngram", "min": 2, "max": 3}})(F.col("p_brand"))
    return _term_counts(table(spark, sf_dir, "part"), grams).drop("places")


@query("analyze_edge_ngram", "SELECT p_brand[1:k] AS term, count(*) AS n FROM part, range(1, 6) v(k) WHERE k <= length(p_brand) GROUP BY 1")
def analyze_edge_ngram(spark, sf_dir):
    grams = analysis.custom({"tokenizer": {"type": "edge_ngram", "min": 1, "max": 5}})(F.col("p_brand"))
    return _term_counts(table(spark, sf_dir, "part"), grams).drop("places")


_STOP_SQL = ", ".join("'" + w.replace("'", "''") + "'" for w in analysis.STOP_WORDS)


@query("analyze_stop", f"SELECT * FROM ({_counts_sql(_toks('text'), 'documents')}) WHERE term NOT IN ({_STOP_SQL})")
def analyze_stop(spark, sf_dir):
    return _term_counts(table(spark, sf_dir, "documents"), analysis.custom({"tokenizer": "standard", "filters": ["lowercase", "stop"]})(F.col("text")))


@query("analyze_synonym", f"""WITH c AS ({_counts_sql(_toks('text'), 'documents')}), a AS (SELECT term, n, places FROM c UNION ALL SELECT 'those', n, places FROM c WHERE term = 'the' UNION ALL SELECT 'of2', n, places FROM c WHERE term = 'of')
SELECT term, CAST(sum(n) AS BIGINT) AS n, CAST(sum(places) AS BIGINT) AS places FROM a GROUP BY term""")
def analyze_synonym(spark, sf_dir):
    return _term_counts(table(spark, sf_dir, "documents"), analysis.custom({"tokenizer": "standard", "filters": ["lowercase", {"type": "synonym", "rules": ["the => those", "of => of2"]}]})(F.col("text")))


@query("analyze_fold_length_unique", f"""WITH x AS (SELECT doc_id, list_transform({_toks('text')}, lambda v: replace(translate(v, '{analysis.FOLD_FROM}', '{analysis.FOLD_TO}'), 'ß', 'ss')) AS t FROM documents),
y AS (SELECT doc_id, unnest(t) AS term, unnest(range(0, len(t))) AS pos FROM x), z AS (SELECT doc_id, term, min(pos) AS pos FROM y WHERE length(term) BETWEEN 3 AND 6 GROUP BY 1, 2)
SELECT term, count(*) AS n, CAST(sum(pos) AS BIGINT) AS places FROM z GROUP BY term""")
def analyze_fold_length_unique(spark, sf_dir):
    return _term_counts(table(spark, sf_dir, "documents"), analysis.custom({"tokenizer": "standard", "filters": ["lowercase", "ascii_folding", {"type": "length", "min": 3, "max": 6}, "unique"]})(F.col("text")))


@query("analyze_english")
def analyze_english(spark, sf_dir):
    return _term_counts(table(spark, sf_dir, "documents"), analysis.ANALYZERS["english"](F.col("text")))


# rows in and out


@query("upsert_last_wins", """WITH new AS (SELECT conv_id, turn, text || '!' AS text FROM conversations WHERE conv_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1),
old AS (SELECT conv_id, turn, text FROM conversations WHERE turn = 0) SELECT * FROM new UNION ALL SELECT * FROM old WHERE conv_id NOT IN (SELECT conv_id FROM new)""")
def upsert_last_wins(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return index.upsert(c.where("turn = 0"), c.where("conv_id % 3 = 0").withColumn("text", F.concat("text", F.lit("!"))), "conv_id", "turn")


@query("delete_antijoin", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_antijoin(spark, sf_dir):
    return index.delete(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id").select("doc_id", "lang")


@query("number_by_key", "SELECT p_name, p_partkey, row_number() OVER (ORDER BY p_partkey) AS doc_id FROM part")
def number_by_key(spark, sf_dir):
    return index.numbered(table(spark, sf_dir, "part").select("p_name", "p_partkey"), "p_partkey", Scratch(spark, "numbered").root)[0]


# the same conditions in SQL: the index as a view, full-text scores as one of its columns


def _view(spark, sf_dir, node, name: str) -> None:
    matched(documents(spark, sf_dir), node, ["lang", "source", "n_chars"]).createOrReplaceTempView(name)


@query("sql_match", f"WITH {_DOCS} SELECT doc_id, lang, round({_bm25_sql('the')}, 6) AS score FROM d, s WHERE {_has('the')} AND n_chars BETWEEN 500 AND 3000 AND lang IN ('en', 'de') ORDER BY {_bm25_sql('the')} DESC, doc_id LIMIT 10")
def sql_match(spark, sf_dir):
    _view(spark, sf_dir, Match("text", "the"), "matches")
    return spark.sql("SELECT doc_id, lang, round(score, 6) AS score FROM matches WHERE n_chars BETWEEN 500 AND 3000 AND lang IN ('en', 'de') ORDER BY matches.score DESC, doc_id LIMIT 10")


@query("sql_between_in_like", "SELECT p_partkey, p_brand FROM part WHERE p_size BETWEEN 5 AND 20 AND p_brand LIKE 'Brand#1%' AND p_partkey NOT IN (3, 7)")
def sql_between_in_like(spark, sf_dir):
    return spark.sql("SELECT p_partkey, p_brand FROM {p} WHERE p_size BETWEEN :low AND :high AND p_brand LIKE 'Brand#1%' AND p_partkey NOT IN (3, 7)", args={"low": 5, "high": 20}, p=table(spark, sf_dir, "part"))


@query("sql_not", f"WITH {_DOCS} SELECT doc_id, 0.0::DOUBLE AS score FROM d WHERE NOT ({_has('the')}) AND lang = 'en'")
def sql_not(spark, sf_dir):
    # a selection that only filters scores 0; NOT of a condition is what its matches leave
    _view(spark, sf_dir, Match("text", "the"), "matches")
    return spark.sql("SELECT doc_id, 0.0D AS score FROM {d} d WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.doc_id = d.doc_id) AND lang = 'en'", d=table(spark, sf_dir, "documents"))


@query("sql_match_or_filter", f"WITH {_DOCS} SELECT doc_id, round({_bm25_sql('the')} + (lang IN ('fr', 'de'))::INT, 6) AS score FROM d, s WHERE {_has('the')} OR lang IN ('fr', 'de')")
def sql_match_or_filter(spark, sf_dir):
    _view(spark, sf_dir, Match("text", "the"), "matches")
    return spark.sql("SELECT doc_id, round(coalesce(m.score, 0) + CAST(d.lang IN ('fr', 'de') AS INT), 6) AS score FROM {d} d LEFT JOIN matches m USING (doc_id) WHERE m.score IS NOT NULL OR d.lang IN ('fr', 'de')", d=table(spark, sf_dir, "documents"))


@query("sql_like_terms", "WITH x AS (SELECT doc_id, " + _toks("text") + " AS t FROM documents) SELECT doc_id FROM x WHERE len(list_filter(t, lambda v: v LIKE 'th_t%ion')) > 0")
def sql_like_terms(spark, sf_dir):
    """LIKE on a text field asks for its terms: % is any run and _ one character."""
    _view(spark, sf_dir, Wildcard("text", "th?t*ion"), "likes")
    return spark.sql("SELECT doc_id FROM likes")


@query("sql_order_limit_offset", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10 OFFSET 5")
def sql_order_limit_offset(spark, sf_dir):
    return spark.sql("SELECT doc_id, n_chars FROM {d} ORDER BY n_chars DESC, doc_id LIMIT 10 OFFSET 5", d=table(spark, sf_dir, "documents"))
