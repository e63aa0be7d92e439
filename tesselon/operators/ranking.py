"""Sorting by several keys, one row a group, and highlighting of hits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesselon.functions.scoring import haversine
from tesselon.operators.nodes import Node
from tesselon.operators.retrieval import Context, Corpus


@dataclass(frozen=True)
class SortKey:
    """field, or _score, or with `origin` the distance to a point. Missing values come first unless missing_last, whatever the direction."""

    field: str
    desc: bool = False
    missing_last: bool = False
    mode: str | None = None  # of several values: min, max, sum, avg, median; by default min ascending, max descending
    origin: tuple[float, float] | None = None

    def value(self, df: DataFrame) -> Column:
        if self.origin:
            return haversine(F.col(self.field)["lat"], F.col(self.field)["lon"], *self.origin)
        if self.field == "_score":
            return F.col("score")
        if not isinstance(df.schema[self.field].dataType, T.ArrayType):
            return F.col(self.field)
        a, n = F.col(self.field), F.size(self.field)
        total = F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double"))
        ordered = F.array_sort(a)
        forms = {
            "min": lambda: F.array_min(a),
            "max": lambda: F.array_max(a),
            "sum": lambda: F.when(n > 0, total),
            "avg": lambda: F.when(n > 0, total / n),
            "median": lambda: F.when(n > 0, (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2),
        }
        return forms[self.mode or ("max" if self.desc else "min")]()

    def order(self, df: DataFrame) -> Column:
        v = self.value(df)
        if self.desc:
            return v.desc_nulls_last() if self.missing_last else v.desc_nulls_first()
        return v.asc_nulls_last() if self.missing_last else v.asc_nulls_first()


def _orders(df: DataFrame, keys: Sequence[SortKey], doc_id: str) -> list[Column]:
    return [k.order(df) for k in keys] + [F.asc(doc_id)]


def sort(df: DataFrame, keys: Sequence[SortKey], limit: int | None = None, offset: int = 0, doc_id: str = "doc_id") -> DataFrame:
    """Rows in order, equal ones by doc_id; with a limit only so many rows of each task are kept."""
    out = df.orderBy(*_orders(df, keys, doc_id))
    out = out.offset(offset) if offset else out
    return out if limit is None or limit < 0 else out.limit(limit)


def collapse(df: DataFrame, name: str, keys: Sequence[SortKey], doc_id: str = "doc_id") -> DataFrame:
    """The first row of each value by the sort; rows without a value stand for themselves.

    The first row of a group is a running minimum of (sort keys, doc_id), so a group of any size is reduced map-side.
    """
    group = F.when(F.col(name).isNull(), F.concat(F.lit("-"), F.col(doc_id).cast("string"))).otherwise(F.concat(F.lit("+"), F.col(name).cast("string")))
    keyed = df.withColumn("_group", group)
    plain = all(_negatable(df, k) for k in keys)
    if plain:
        rank = []
        for k in keys:
            v = k.value(df)
            rank += [v.isNull() if k.missing_last else v.isNotNull(), -v if k.desc else v]
        first = keyed.groupBy("_group").agg(F.min_by(F.struct(*df.columns), F.struct(*rank, F.col(doc_id))).alias("r"))
        return first.select("r.*")
    w = Window.partitionBy("_group").orderBy(*_orders(df, keys, doc_id))
    return keyed.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_group")


def _negatable(df: DataFrame, k: SortKey) -> bool:
    if k.origin or k.field == "_score" or not k.desc:
        return True
    return isinstance(df.schema[k.field].dataType, T.NumericType)


def fragments(text: str, spans: list[tuple[int, int]], pre: str = "<em>", post: str = "</em>", size: int = 0, count: int = 5, by_score: bool = False) -> list[str]:
    """Marked pieces of a text: the whole of it with size 0, else windows around matches, cut at white space."""

    def marked(lo: int, hi: int) -> str:
        out, at = [], lo
        for a, b in spans:
            if lo <= a and b <= hi:
                out += [text[at:a], pre, text[a:b], post]
                at = b
        return "".join([*out, text[at:hi]])

    if not spans:
        return []
    if size <= 0:
        return [marked(0, len(text))]
    windows, end = [], -1
    for a, b in spans:
        if b <= end:
            continue
        lo = max(0, (a + b) // 2 - size // 2)
        hi = min(len(text), lo + size)
        while 0 < lo < a and not text[lo - 1].isspace():
            lo += 1
        while hi < len(text) and hi > b and not text[hi].isspace():
            hi -= 1
        lo, hi = max(min(lo, a), end + 1 if end >= 0 and end < a else 0), max(hi, b)
        windows.append((sum(1 for x, y in spans if lo <= x and y <= hi), lo, hi))
        end = hi
    if by_score:
        windows.sort(key=lambda w: (-w[0], w[1]))
    return [marked(lo, hi) for _, lo, hi in windows[:count]]


def highlight(corpus: Corpus, hits: DataFrame, name: str, node: Node, pre: str = "<em>", post: str = "</em>", fragment_size: int = 0, number_of_fragments: int = 5, order: str = "none") -> DataFrame:
    """Adds `highlights` (array of strings) to hits, which have been cut to a page already: the places of a condition's terms in a text field.

    The field's own analyzer says what a term is and where it lies; with char filters, the text behind them is what is marked.
    """
    ctx, analyzer = Context(corpus), corpus.analyzer(name)
    wanted = frozenset(t for n, t in node.rewrite().terms(ctx) if n == name)

    @F.pandas_udf("array<string>")
    def mark(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, found in zip(texts, spans):
            at = sorted({(s["start"], s["end"]) for s in found if s["term"] in wanted})
            out.append(fragments(t, at, pre, post, fragment_size, number_of_fragments, order == "score"))
        return pd.Series(out)

    return analyzer.spans(hits, name, "_clean", "highlights").withColumn("highlights", mark(F.col("_clean"), F.col("highlights"))).drop("_clean")
