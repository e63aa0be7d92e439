"""Running conditions over a corpus: facts of its texts, statistics, ranked hits and rescoring.

A corpus is a table of documents, with or without an inverted index of its text fields. What a tree of conditions asks
of a text field become columns, one row a document: from an index by one aggregate over the rows of the tree's terms,
else from the text, analysed once a scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselon.functions import scoring
from tesselon.functions.analysis import ANALYZERS, Analyzer
from tesselon.operators.nodes import Node
from tesselon.plans.schema import Schema

VALUE_GAP = 100
TOKENS = "array<struct<term:string,pos:int>>"


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row: a filter above is not pushed below a generator, nor are its columns repeated."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


@dataclass(frozen=True)
class Inverted:
    """An inverted index: for each text field rows of (term, doc_id, tf, places, length), and for each document `_len_<field>`."""

    postings: dict[str, DataFrame]
    lengths: DataFrame


class Corpus:
    """Documents with a schema; `docs` needs a column of distinct longs, doc_id."""

    def __init__(self, docs: DataFrame, schema: Schema, analyzers: dict[str, Analyzer] | None = None, doc_id: str = "doc_id", inverted: Inverted | None = None):
        self.docs, self.schema, self.doc_id, self.inverted = docs, schema, doc_id, inverted
        self.analyzers = {**ANALYZERS, **(analyzers or {})}

    def analyzer(self, name: str) -> Analyzer:
        return self.analyzers[self.schema[name].analyzer]

    def tokens(self, name: str) -> Column:
        """A text field's tokens; values of an array stand VALUE_GAP places apart, so that no phrase spans two."""
        f, analyzer = self.schema[name], self.analyzer(name)
        if not f.multi:
            return analyzer(F.col(name))
        each = F.transform(F.coalesce(F.col(name), F.array().cast("array<string>")), lambda v: analyzer(v))
        empty = F.struct(F.lit(0).alias("next"), F.array().cast(TOKENS).alias("toks"))

        def add(acc: Column, toks: Column) -> Column:
            last = F.coalesce(F.array_max(F.transform(toks, lambda t: t["pos"])), F.lit(-1))
            moved = F.transform(toks, lambda t: F.struct(t["term"].alias("term"), (t["pos"] + acc["next"]).alias("pos")))
            return F.struct((acc["next"] + last + 1 + VALUE_GAP).alias("next"), F.concat(acc["toks"], moved).alias("toks"))

        return F.aggregate(each, empty, add)["toks"]


class Context:
    """What nodes build their columns from, and what they have asked for so far."""

    def __init__(self, corpus: Corpus):
        self.corpus, self.schema, self.doc_id = corpus, corpus.schema, corpus.doc_id
        self.pairs: dict[tuple[str, str], int] = {}
        self.n_docs = F.col("_n_docs")
        self.columns: dict[str, None] = {}
        self._terms: dict[tuple[str, str], list[str]] = {}
        self._tf: dict[tuple[str, str], str] = {}
        self._places: dict[tuple[str, str], str] = {}
        self._any: list[tuple[str, str, Callable[[Column], Column]]] = []
        self._measured: dict[str, None] = {}

    def analyse(self, name: str, text: str) -> list[str]:
        if (name, text) not in self._terms:
            if self.schema[name].type == "keyword":
                self._terms[name, text] = [text] if text else []
            else:
                self._terms[name, text] = self.corpus.analyzer(name).terms(self.corpus.docs.sparkSession, text)
        return self._terms[name, text]

    def is_text(self, name: str) -> bool:
        return self.schema[name].type == "text"

    def scored(self, name: str) -> bool:
        return self.schema[name].type in ("text", "keyword")

    def column(self, name: str) -> Column:
        """A column of the documents."""
        self.columns[name] = None
        return F.col(name)

    def any_value(self, name: str, condition: Callable[[Column], Column]) -> Column:
        """Whether some value meets a condition; on a single-valued column the condition itself, which Spark pushes to the scan."""
        if self.is_text(name):
            fact = f"_any{len(self._any)}"
            self._any.append((name, fact, condition))
            return F.coalesce(F.col(fact), F.lit(False))
        return F.exists(self.column(name), condition) if self.schema[name].multi else condition(self.column(name))

    def tf(self, name: str, term: str) -> Column:
        f = self.schema[name]
        if f.type == "text":
            return F.coalesce(F.col(self._tf.setdefault((name, term), f"_tf{len(self._tf)}")), F.lit(0))
        if f.multi:
            return F.size(F.filter(F.coalesce(self.column(name), F.array().cast(f.spark_type)), lambda v: v == F.lit(term)))
        return F.coalesce((self.column(name) == F.lit(term)).cast("int"), F.lit(0))

    def places(self, name: str, term: str) -> Column:
        return F.coalesce(F.col(self._places.setdefault((name, term), f"_at{len(self._places)}")), F.array().cast("array<int>"))

    def length(self, name: str) -> Column:
        f = self.schema[name]
        if f.type == "text":
            self._measured[name] = None
            return F.coalesce(F.col(f"_len_{name}"), F.lit(0))
        return F.size(F.coalesce(self.column(name), F.array().cast(f.spark_type))) if f.multi else self.column(name).isNotNull().cast("int")

    def average(self, name: str) -> Column:
        return F.col(f"_avg_{name}")

    def df(self, name: str, term: str) -> Column:
        return F.col(f"_df_{self.pairs[name, term]}")

    def bm25(self, name: str, term: str, tf: Column) -> Column:
        if (name, term) not in self.pairs:  # a clause that only filters
            return F.lit(0.0)
        return F.when(tf > 0, scoring.bm25(tf, self.length(name), self.average(name), scoring.idf(self.n_docs, self.df(name, term)))).otherwise(F.lit(0.0))

    # facts

    def _fields(self) -> list[str]:
        asked = [n for n, _ in (*self._tf, *self._places)] + [n for n, _, _ in self._any] + list(self._measured)
        return list(dict.fromkeys(asked))

    def _asked(self, name: str) -> tuple[list[str], list[tuple[str, Callable[[Column], Column]]]]:
        """The terms asked for in a field, and the conditions on its terms with the columns they give."""
        terms = dict.fromkeys(t for n, t in (*self._tf, *self._places) if n == name)
        return list(terms), [(fact, c) for n, fact, c in self._any if n == name]

    def scanned(self, docs: DataFrame) -> DataFrame:
        """docs with the facts, each text being analysed once and its tokens passed once for all terms."""
        for name in self._fields():
            terms, conditions = self._asked(name)
            docs = once(docs, _tok=self.corpus.tokens(name))
            tok = F.col("_tok")
            hit = F.filter(tok, lambda t: t["term"].isin(terms)) if terms else F.array().cast(TOKENS)  # noqa: B023
            every = {fact: F.exists(tok, _on_term(c)) for fact, c in conditions}
            docs = once(docs, **{f"_len_{name}": F.size(tok), "_hit": hit}, **every).drop("_tok")
            of = lambda term: F.filter(F.col("_hit"), lambda t: t["term"] == F.lit(term))
            each = {fact: F.size(of(t)) for (n, t), fact in self._tf.items() if n == name}
            each |= {fact: F.transform(of(t), lambda x: x["pos"]) for (n, t), fact in self._places.items() if n == name}
            docs = (once(docs, **each) if each else docs).drop("_hit")
        return docs

    def indexed(self) -> DataFrame | None:
        """doc_id and the facts of the documents that have any of the terms, from the index: one aggregate a field."""
        out = None
        for name in self._fields():
            terms, conditions = self._asked(name)
            term = F.col("term")
            wanted = [term.isin(terms)] if terms else []
            wanted += [c(term) for _, c in conditions]
            if not wanted:
                continue
            keep = wanted[0]
            for c in wanted[1:]:
                keep = keep | c
            rows = self.corpus.inverted.postings[name].where(keep)
            here = lambda t, v: F.when(term == F.lit(t), F.col(v))
            facts = {fact: here(t, "tf") for (n, t), fact in self._tf.items() if n == name}
            places = {fact: here(t, "places") for (n, t), fact in self._places.items() if n == name}
            if len(terms) == 1 and not conditions:  # a row a document already
                found = rows.select("doc_id", F.col("length").alias(f"_len_{name}"), *[c.alias(n) for n, c in (facts | places).items()])
            else:
                aggs = [F.max("length").alias(f"_len_{name}"), *[F.max(c).alias(n) for n, c in facts.items()]]
                aggs += [F.get(F.collect_list(c), F.lit(0)).alias(n) for n, c in places.items()]
                aggs += [F.bool_or(c(term)).alias(fact) for fact, c in conditions]
                found = rows.groupBy("doc_id").agg(*aggs)
            out = found if out is None else out.join(found, "doc_id", "full_outer")
        return out

    # statistics of the whole corpus

    def ask(self, *nodes: Node) -> None:
        for node in nodes:
            for pair in node.needs(self):
                self.pairs.setdefault(pair, len(self.pairs))

    def statistics(self) -> DataFrame | None:
        """One row: documents, average lengths of the fields that have terms, and document frequencies of all terms asked for."""
        if not self.pairs:
            return None
        own = Context(self.corpus)
        names = dict.fromkeys(n for n, _ in self.pairs)
        present = {f"_df_{i}": own.tf(n, t) > 0 for (n, t), i in self.pairs.items()}
        if self.corpus.inverted is None:
            lengths = {n: own.length(n) for n in names}
            return own.scanned(self.corpus.docs).agg(*_sizes(lengths), *[F.count_if(c).alias(n) for n, c in present.items()])
        plain = {n: own.length(n) for n in names if not own.is_text(n)}
        texts = {n: F.col(f"_len_{n}") for n in names if own.is_text(n)}
        of_docs = [F.count_if(present[f"_df_{i}"]).alias(f"_df_{i}") for (n, _), i in self.pairs.items() if n in plain]
        rows = self.corpus.docs if plain else self.corpus.inverted.lengths
        if plain and texts:
            rows = rows.drop(*[f"_len_{n}" for n in texts]).join(self.corpus.inverted.lengths, self.doc_id)
        out = rows.agg(*_sizes({**texts, **plain}), *of_docs)
        for n in texts:
            terms = {t: i for (m, t), i in self.pairs.items() if m == n}
            held = self.corpus.inverted.postings[n].where(F.col("term").isin(list(terms)))
            out = out.crossJoin(F.broadcast(held.agg(*[F.count_if(F.col("term") == F.lit(t)).alias(f"_df_{i}") for t, i in terms.items()])))  # one row each
        return out


def _on_term(condition: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda t: condition(t["term"])


def _sizes(lengths: dict[str, Column]) -> list[Column]:
    out = [F.count(F.lit(1)).alias("_n_docs")]
    for n, c in lengths.items():
        out.append(F.coalesce(F.try_divide(F.sum(c).cast("double"), F.count_if(c > 0)), F.lit(0.0)).alias(f"_avg_{n}"))
    return out


def _evaluated(corpus: Corpus, node: Node, columns: Iterable[str], *more: Node) -> tuple[DataFrame, list[tuple[Column, Column]]]:
    """Rows (doc_id, columns) with all that the built conditions and scores of node and more read; only rows that node can match."""
    ctx = Context(corpus)
    ctx.ask(node, *more)
    stats = ctx.statistics()
    built = [n.build(ctx) for n in (node, *more)]
    wanted = list(dict.fromkeys([corpus.doc_id, *ctx.columns, *columns]))
    if corpus.inverted is None:
        rows = ctx.scanned(corpus.docs.select(*dict.fromkeys([*wanted, *ctx._fields()])))
    else:
        facts = ctx.indexed()
        docs = corpus.docs.select(*wanted)
        if facts is None:
            rows = docs
        elif not node.anchored(ctx):
            rows = docs.join(facts, corpus.doc_id, "left")
        else:
            rows = facts if wanted == [corpus.doc_id] else docs.join(facts, corpus.doc_id)
    return rows if stats is None else rows.crossJoin(F.broadcast(stats)), built  # one row


def matched(corpus: Corpus, node: Node, columns: Sequence[str] = ()) -> DataFrame:
    """(doc_id, columns, score) of all matches; columns are of the documents."""
    rows, [(condition, score)] = _evaluated(corpus, node.rewrite(), columns)
    return rows.where(condition).select(corpus.doc_id, *columns, score.cast("double").alias("score"))


def scored(corpus: Corpus, node: Node) -> DataFrame:
    """The matching documents, all their columns and `score`."""
    return matched(corpus, node, [c for c in corpus.docs.columns if c != corpus.doc_id]).select(*corpus.docs.columns, "score")


def top(found: DataFrame, k: int, doc_id: str = "doc_id", offset: int = 0) -> DataFrame:
    """Best scores first, the lesser doc_id first among equals."""
    if k <= 0:
        return found.limit(0)
    best = found.orderBy(F.desc("score"), F.asc(doc_id))
    return (best.offset(offset) if offset else best).limit(k)


def _fetched(corpus: Corpus, hits: DataFrame) -> DataFrame:
    """The documents of hits of an index. They are k rows, and their ids reach the reader of the documents as a filter."""
    got = hits.select(corpus.doc_id, "score").collect()
    kind = corpus.docs.schema[corpus.doc_id].dataType.simpleString()
    few = corpus.docs.sparkSession.createDataFrame([tuple(r) for r in got], f"`{corpus.doc_id}` {kind}, score double")
    rows = corpus.docs.where(F.col(corpus.doc_id).isin([r[0] for r in got])).join(F.broadcast(few), corpus.doc_id)  # k rows
    return top(rows.select(*corpus.docs.columns, "score"), len(got), corpus.doc_id)


def find(corpus: Corpus, node: Node, k: int = 10, offset: int = 0) -> DataFrame:
    """Ranked hits with all their columns. With an index, only the hits' rows of the documents are read; else a scan carries them along."""
    if corpus.inverted is None:
        return top(scored(corpus, node), k, corpus.doc_id, offset)
    return _fetched(corpus, top(matched(corpus, node), k, corpus.doc_id, offset))


def best(corpus: Corpus, node: Node, k: int = 10, offset: int = 0) -> DataFrame:
    """(doc_id, score) of ranked hits."""
    return top(matched(corpus, node), k, corpus.doc_id, offset)


def rescored(corpus: Corpus, base: Node, second: Node, window: int, k: int, query_weight: float = 1.0, rescore_weight: float = 1.0) -> DataFrame:
    """(doc_id, score): the best max(window, k) by the base score, ranked anew by weighted sums; a row that the second condition misses keeps its share of the base."""
    base, second = base.rewrite(), second.rewrite()
    rows, [(condition, score), (again, extra)] = _evaluated(corpus, base, (), second)
    found = rows.where(condition).select(corpus.doc_id, score.cast("double").alias("score"), F.when(again, extra).otherwise(0.0).alias("_again"))
    window_rows = top(found, max(window, k), corpus.doc_id)
    return top(window_rows.select(corpus.doc_id, (query_weight * F.col("score") + rescore_weight * F.col("_again")).alias("score")), k, corpus.doc_id)


def lengths(corpus: Corpus) -> dict[str, Column]:
    """Numbers of tokens of the text fields, by the names of the columns that hold them in an index."""
    return {f"_len_{f.name}": F.size(corpus.tokens(f.name)) for f in corpus.schema.of_type("text")}


#: Tokens whose rows are grouped and sorted together.
RUN_TOKENS = 1 << 20


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of whole documents of about RUN_TOKENS tokens, or of one document: large ones are cut, small ones gathered."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        size = np.cumsum(np.diff(batch.column("terms").offsets.to_numpy()))
        at = 0
        while at < len(batch):
            before = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, before + RUN_TOKENS - n, side="right")))
            held.append(batch.slice(at, to - at))
            n += int(size[to - 1] - before)
            at = to
            if n >= RUN_TOKENS or at < len(batch):
                yield pa.concat_batches(held)
                held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, terms, places) to one row a term of a document, in runs sorted by (term, doc_id)."""
    for batch in _runs(batches):
        terms = batch.column("terms")
        size = np.diff(terms.offsets.to_numpy())
        coded = terms.flatten().dictionary_encode()
        place = batch.column("places").flatten().to_numpy()
        rank = np.empty(len(coded.dictionary), np.int32)
        by_term = pc.sort_indices(coded.dictionary).to_numpy()
        rank[by_term] = np.arange(len(rank), dtype=np.int32)
        ids = batch.column("doc_id")
        by_id = pc.sort_indices(ids).to_numpy()
        doc_rank = np.empty(len(ids), np.int32)
        doc_rank[by_id] = np.arange(len(ids), dtype=np.int32)
        # one number a token: its term, then its document
        key = (rank[coded.indices.to_numpy()].astype(np.int64) << 32) | np.repeat(doc_rank, size)
        order = np.lexsort((place, key))
        key, place = key[order], place[order]
        cut = np.flatnonzero(np.diff(key, prepend=-1))
        stop = np.append(cut, len(key)).astype(np.int32)
        term, doc = by_term[key[cut] >> 32], by_id[key[cut] & 0xFFFFFFFF]
        for lo in range(0, len(cut), 1 << 16):
            hi = min(lo + (1 << 16), len(cut))
            own = place[stop[lo] : stop[hi]]
            lists = pa.ListArray.from_arrays(stop[lo : hi + 1] - stop[lo], pa.array(own))
            rows = [coded.dictionary.take(pa.array(term[lo:hi])), ids.take(pa.array(doc[lo:hi])), pa.array(np.diff(stop[lo : hi + 1])), lists, pa.array(size[doc[lo:hi]].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(rows, names=["term", "doc_id", "tf", "places", "length"])


def postings(corpus: Corpus, name: str) -> DataFrame:
    """(term, doc_id, tf, places, length) of a text field: a document's tokens are grouped by term where they lie, over Arrow batches, and come in runs sorted by (term, doc_id)."""
    docs = once(corpus.docs.select(F.col(corpus.doc_id).alias("doc_id"), name), tok=corpus.tokens(name))
    column = lambda part: F.transform("tok", lambda t: t[part])
    return docs.select("doc_id", column("term").alias("terms"), column("pos").alias("places")).mapInArrow(_grouped, "term string, doc_id long, tf int, places array<int>, length int")
