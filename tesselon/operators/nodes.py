"""Conditions as a tree of small values. Each gives a row condition and a score, both Spark columns.

A node is asked for `needs()`, the statistics of the whole corpus that its score uses, and for `build(ctx)`, which
returns (condition, score). What a node wants of a text (a term's frequency or places, whether some term meets a
condition) it asks of the context, which gathers these facts once a document, from the text or from an inverted index. So
the tree becomes one projection and one filter; there is no join per clause.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesselon.functions import scoring

if TYPE_CHECKING:
    from tesselon.operators.retrieval import Context

Built = tuple[Column, Column]
ZERO = 0.0


class QueryError(ValueError):
    pass


@dataclass(frozen=True)
class Node:
    boost: float = field(default=1.0, kw_only=True)

    @property
    def weight(self) -> float:
        return self.boost or 1.0

    def needs(self, ctx: Context) -> list[tuple[str, str]]:
        """(field, term) pairs whose document frequencies the score uses."""
        return []

    def build(self, ctx: Context) -> Built:
        raise NotImplementedError

    def terms(self, ctx: Context) -> list[tuple[str, str]]:
        """(field, term) pairs to highlight."""
        return self.needs(ctx)

    def anchored(self, ctx: Context) -> bool:
        """Whether every match has one of the terms that the node asks for, so that documents without any needn't be read."""
        return False

    def rewrite(self) -> Node:
        return self

    def _constant(self, condition: Column) -> Built:
        return F.coalesce(condition, F.lit(False)), F.lit(float(self.weight))


@dataclass(frozen=True)
class MatchAll(Node):
    def build(self, ctx):
        return self._constant(F.lit(True))


@dataclass(frozen=True)
class MatchNone(Node):
    def anchored(self, ctx):
        return True

    def build(self, ctx):
        return F.lit(False), F.lit(ZERO)


@dataclass(frozen=True)
class Term(Node):
    """One indexed term, unanalysed; typed equality on numbers, dates and booleans."""

    field: str
    term: Any

    def needs(self, ctx):
        return [(self.field, self.term)] if ctx.scored(self.field) else []

    def anchored(self, ctx):
        return ctx.is_text(self.field)

    def build(self, ctx):
        if not ctx.scored(self.field):
            return self._constant(ctx.any_value(self.field, lambda v: v == F.lit(self.term)))
        tf = ctx.tf(self.field, self.term)
        return tf > 0, ctx.bm25(self.field, self.term, tf) * F.lit(float(self.weight))


def _sum_terms(ctx: Context, name: str, terms: Sequence[str], weight: float) -> Column:
    """BM25 of a list of terms; one that repeats counts as often."""
    total = F.lit(ZERO)
    for t in dict.fromkeys(terms):
        total = total + ctx.bm25(name, t, ctx.tf(name, t)) * F.lit(float(terms.count(t) * weight))
    return total


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _any(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


@dataclass(frozen=True)
class Match(Node):
    """Analysed text: any of its terms, or all with operator 'must'."""

    field: str
    text: str
    operator: str = "should"

    def _terms(self, ctx):
        return ctx.analyse(self.field, self.text)

    def needs(self, ctx):
        return [(self.field, t) for t in dict.fromkeys(self._terms(ctx))] if ctx.scored(self.field) else []

    def anchored(self, ctx):
        return ctx.is_text(self.field)

    def build(self, ctx):
        if not ctx.scored(self.field):
            return Term(self.field, self.text, boost=self.boost).build(ctx)
        terms = self._terms(ctx)
        if not terms:
            return MatchNone().build(ctx)
        has = [ctx.tf(self.field, t) > 0 for t in dict.fromkeys(terms)]
        return (_all(has) if self.operator == "must" else _any(has)), _sum_terms(ctx, self.field, terms, self.weight)


def _events(places: Sequence[Column]) -> Column:
    """(place, list number) of all lists in order of place; at one place later lists come first, so that no place follows itself."""
    n = len(places)
    each = [F.transform(p, _marked(n - 1 - i)) for i, p in enumerate(places)]
    return F.array_sort(F.concat(*each))


def _marked(back: int) -> Callable[[Column], Column]:
    return lambda x: F.struct(x.alias("at"), F.lit(back).alias("back"))


def ordered_within(places: Sequence[Column], slop: int) -> Column:
    """Whether places q0 < q1 < ... of the lists, one of each in turn, leave at most slop places between.

    One merge in order of place: of the chains through the first lists that end by now, only the latest start counts.
    """
    n = len(places)
    if slop == 0:  # a start that every list has at its own distance
        starts = places[0]
        for i, p in enumerate(places[1:], 1):
            starts = F.array_intersect(starts, F.transform(p, _shifted(i)))
        return F.coalesce(F.size(starts) > 0, F.lit(False))
    start = F.struct(F.array_repeat(F.lit(None).cast("int"), n - 1).alias("from"), F.lit(False).alias("met"))

    def step(state: Column, e: Column) -> Column:
        i = F.lit(n - 1) - e["back"]
        begun = F.when(i == 0, e["at"]).otherwise(F.get(state["from"], i - 1))
        kept = F.transform(state["from"], lambda old, k: F.when(k == i, begun).otherwise(old))
        last = (i == n - 1) & F.coalesce(e["at"] - begun - (n - 1) <= slop, F.lit(False))
        return F.struct(kept.alias("from"), (state["met"] | last).alias("met"))

    return F.coalesce(F.aggregate(_events(places), start, step)["met"], F.lit(False))


def _shifted(i: int) -> Callable[[Column], Column]:
    return lambda x: x - i


def unordered_within(places: Sequence[Column], slop: int) -> Column:
    """Whether some window holds a place of each list with at most slop places to spare: at each place, the latest of every list so far."""
    n = len(places)
    start = F.struct(F.array_repeat(F.lit(None).cast("int"), n).alias("last"), F.lit(False).alias("met"))

    def step(state: Column, e: Column) -> Column:
        i = F.lit(n - 1) - e["back"]
        last = F.transform(state["last"], lambda old, k: F.when(k == i, e["at"]).otherwise(old))
        whole = F.forall(last, lambda x: x.isNotNull()) & (e["at"] - F.array_min(last) - (n - 1) <= slop)
        return F.struct(last.alias("last"), (state["met"] | F.coalesce(whole, F.lit(False))).alias("met"))

    return F.coalesce(F.aggregate(_events(places), start, step)["met"], F.lit(False))


@dataclass(frozen=True)
class Phrase(Node):
    """Analysed terms in order; up to `slop` other places among them. Gaps that the analyser leaves in the query don't count."""

    field: str
    text: str
    slop: int = 0

    def _terms(self, ctx):
        return ctx.analyse(self.field, self.text)

    def needs(self, ctx):
        return [(self.field, t) for t in dict.fromkeys(self._terms(ctx))]

    def anchored(self, ctx):
        return ctx.is_text(self.field)

    def build(self, ctx):
        terms = self._terms(ctx)
        if not terms:
            return MatchNone().build(ctx)
        score = _sum_terms(ctx, self.field, terms, self.weight)
        if len(terms) == 1:
            return ctx.tf(self.field, terms[0]) > 0, score
        has = _all([ctx.tf(self.field, t) > 0 for t in dict.fromkeys(terms)])
        return has & ordered_within([ctx.places(self.field, t) for t in terms], self.slop), score


@dataclass(frozen=True)
class SpanNear(Node):
    """Unanalysed terms near one another, in order or not."""

    field: str
    span: tuple[str, ...]
    slop: int = 0
    in_order: bool = True

    def needs(self, ctx):
        return [(self.field, t) for t in dict.fromkeys(self.span)]

    def anchored(self, ctx):
        return ctx.is_text(self.field)

    def build(self, ctx):
        if not self.span:
            return MatchNone().build(ctx)
        score = _sum_terms(ctx, self.field, list(self.span), self.weight)
        if len(self.span) == 1:
            return ctx.tf(self.field, self.span[0]) > 0, score
        places = [ctx.places(self.field, t) for t in self.span]
        near = (ordered_within if self.in_order else unordered_within)(places, self.slop)
        return _all([ctx.tf(self.field, t) > 0 for t in dict.fromkeys(self.span)]) & near, score


@dataclass(frozen=True)
class Prefix(Node):
    field: str
    prefix: str

    def anchored(self, ctx):
        return ctx.is_text(self.field)

    def build(self, ctx):
        return self._constant(ctx.any_value(self.field, lambda v: v.startswith(self.prefix)))


@dataclass(frozen=True)
class Range(Node):
    """Bounds by type: texts and keywords by code point, others by value; None or '*' leaves an end open."""

    field: str
    low: Any = None
    high: Any = None
    include_low: bool = True
    include_high: bool = True

    def anchored(self, ctx):
        return ctx.is_text(self.field)

    def build(self, ctx):
        def within(v: Column) -> Column:
            conditions = []
            if self.low not in (None, "*", ""):
                conditions.append(v >= F.lit(self.low) if self.include_low else v > F.lit(self.low))
            if self.high not in (None, "*", ""):
                conditions.append(v <= F.lit(self.high) if self.include_high else v < F.lit(self.high))
            return _all(conditions) if conditions else v.isNotNull()

        return self._constant(ctx.any_value(self.field, within))


@dataclass(frozen=True)
class Fuzzy(Node):
    """Terms within an edit distance in code points; by default 0 up to two letters, 1 up to four, else 2."""

    field: str
    term: str
    max_edits: int | None = None

    def anchored(self, ctx):
        return ctx.is_text(self.field)

    def build(self, ctx):
        n = len(self.term)
        k = self.max_edits if self.max_edits is not None else 0 if n <= 2 else 1 if n <= 4 else 2
        return self._constant(ctx.any_value(self.field, lambda v: F.length(v).between(n - k, n + k) & (F.levenshtein(v, F.lit(self.term), k) >= 0)))


def _literal_prefix(pattern: str, special: str) -> str:
    m = re.match(f"[^{re.escape(special)}]*", pattern)
    return m[0]


@dataclass(frozen=True)
class Wildcard(Node):
    """`*` any run, `?` one character, anchored at both ends."""

    field: str
    pattern: str

    def anchored(self, ctx):
        return ctx.is_text(self.field)

    def build(self, ctx):
        start = _literal_prefix(self.pattern, "*?")
        if self.pattern == start + "*":
            return Prefix(self.field, start, boost=self.boost).build(ctx)
        rx = "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in self.pattern) + "$"
        return self._constant(ctx.any_value(self.field, lambda v: v.startswith(start) & v.rlike(rx) if start else v.rlike(rx)))


@dataclass(frozen=True)
class Regexp(Node):
    """The whole term matches a regular expression."""

    field: str
    pattern: str

    def anchored(self, ctx):
        return ctx.is_text(self.field)

    def build(self, ctx):
        start = _literal_prefix(self.pattern, r".^$*+?{}[]\|()") if "|" not in self.pattern else ""
        if start and self.pattern[len(start) : len(start) + 1] in ("*", "?", "{"):
            start = start[:-1]
        return self._constant(ctx.any_value(self.field, lambda v: (v.startswith(start) if start else F.lit(True)) & v.rlike(f"^(?:{self.pattern})$")))


@dataclass(frozen=True)
class GeoDistance(Node):
    field: str
    lat: float
    lon: float
    metres: float

    def build(self, ctx):
        place = ctx.column(self.field)
        lat, lon = place["lat"], place["lon"]
        return self._constant(scoring.within_box(lat, self.lat, self.metres) & (scoring.haversine(lat, lon, self.lat, self.lon) <= self.metres))


@dataclass(frozen=True)
class Bool(Node):
    """All of must and filter, none of must_not, and minimum_should_match of should (by default 1 if nothing else is positive)."""

    must: tuple[Node, ...] = ()
    should: tuple[Node, ...] = ()
    must_not: tuple[Node, ...] = ()
    filter: tuple[Node, ...] = ()
    minimum_should_match: int | None = None

    def __post_init__(self):
        if not (self.must or self.should or self.must_not or self.filter):
            raise QueryError("an empty bool")

    def _children(self):
        return (*self.must, *self.should, *self.must_not, *self.filter)

    def needs(self, ctx):
        return [p for c in (*self.must, *self.should) for p in c.needs(ctx)]

    def terms(self, ctx):
        return [p for c in (*self.must, *self.should, *self.filter) for p in c.terms(ctx)]

    def rewrite(self):
        parts = {k: tuple(c.rewrite() for c in getattr(self, k)) for k in ("must", "should", "must_not", "filter")}
        if self.minimum_should_match is None and not parts["must_not"] and not parts["filter"] and len(parts["must"]) + len(parts["should"]) == 1:
            only = (parts["must"] or parts["should"])[0]
            return replace(only, boost=only.weight * self.weight)
        return replace(self, **parts)

    def anchored(self, ctx):
        if any(c.anchored(ctx) for c in (*self.must, *self.filter)):
            return True
        wants = self.minimum_should_match is None or self.minimum_should_match > 0
        return not (self.must or self.filter) and wants and all(c.anchored(ctx) for c in self.should)

    def build(self, ctx):
        if not (self.must or self.should or self.filter):
            return MatchNone().build(ctx)
        conditions, score = [], F.lit(ZERO)
        for c in self.must:
            p, s = c.build(ctx)
            conditions.append(p)
            score = score + s
        conditions += [c.build(ctx)[0] for c in self.filter]
        conditions += [~c.build(ctx)[0] for c in self.must_not]
        least = self.minimum_should_match
        if least is None:
            least = 0 if self.must or self.filter else 1
        met = F.lit(0)
        built = [c.build(ctx) for c in self.should]
        for p, s in built:
            score = score + F.when(p, s).otherwise(ZERO)
            met = met + p.cast("int")
        if least == 1 and built:
            conditions.append(_any([p for p, _ in built]))
        elif least > 0:
            conditions.append(met >= least)
        return _all(conditions) if conditions else F.lit(True), score * F.lit(float(self.weight))


@dataclass(frozen=True)
class Function:
    """A score of a document: a field's value, a decay from an origin, a random number or a plain weight, where `filter` holds."""

    kind: str = "weight"  # weight, field_value_factor, gauss, exp, linear, random
    weight: float = 1.0
    filter: Node | None = None
    field: str | None = None
    factor: float = 1.0
    modifier: str = "none"
    missing: float = 0.0
    origin: float = 0.0
    scale: float = 1.0
    offset: float = 0.0
    decay: float = 0.5
    seed: int = 0

    def value(self, ctx: Context) -> Column:
        if self.kind == "weight":
            out = F.lit(1.0)
        elif self.kind == "field_value_factor":
            v = F.coalesce(ctx.column(self.field).cast("double"), F.lit(float(self.missing)))
            out = F.coalesce(scoring.modifier(self.modifier, v * F.lit(float(self.factor or 1.0))), F.lit(ZERO))
        elif self.kind == "random":
            out = scoring.random_score(self.seed)(F.col(ctx.doc_id))
        else:
            out = F.coalesce(scoring.decay(self.kind, ctx.column(self.field).cast("double"), self.origin, self.scale, self.offset, self.decay), F.lit(ZERO))
        return out * F.lit(float(self.weight or 1.0))


def _blend(mode: str, a: Column, b: Column) -> Column:
    modes = {"multiply": lambda: a * b, "replace": lambda: b, "sum": lambda: a + b, "avg": lambda: (a + b) / 2, "max": lambda: F.greatest(a, b), "min": lambda: F.least(a, b)}
    if mode not in modes:
        raise QueryError(f"unknown boost mode {mode!r}")
    return modes[mode]()


@dataclass(frozen=True)
class FunctionScore(Node):
    query: Node
    functions: tuple[Function, ...] = ()
    score_mode: str = "multiply"
    boost_mode: str = "multiply"
    max_boost: float = 0.0
    min_score: float = 0.0

    def needs(self, ctx):
        return self.query.needs(ctx) + [p for f in self.functions if f.filter for p in f.filter.needs(ctx)]

    def terms(self, ctx):
        return self.query.terms(ctx)

    def rewrite(self):
        return replace(self, query=self.query.rewrite())

    def _folded(self, ctx) -> Column:
        neutral = F.lit(1.0 if self.score_mode == "multiply" else ZERO)
        if not self.functions:
            return neutral
        parts = [F.when(f.filter.build(ctx)[0] if f.filter else F.lit(True), f.value(ctx)) for f in self.functions]
        found = F.filter(F.array(*parts), lambda v: v.isNotNull())
        start, rest = F.element_at(found, 1), F.slice(found, 2, max(len(parts), 1))
        folds = {
            "multiply": lambda: F.aggregate(rest, start, lambda a, v: a * v),
            "sum": lambda: F.aggregate(rest, start, lambda a, v: a + v),
            "avg": lambda: F.aggregate(rest, start, lambda a, v: a + v) / F.size(found),
            "max": lambda: F.array_max(found),
            "min": lambda: F.array_min(found),
            "first": lambda: start,
        }
        if self.score_mode not in folds:
            raise QueryError(f"unknown score mode {self.score_mode!r}")
        return F.when(F.size(found) == 0, neutral).otherwise(folds[self.score_mode]())

    def anchored(self, ctx):
        return self.query.anchored(ctx)

    def build(self, ctx):
        p, s = self.query.build(ctx)
        own = self._folded(ctx)
        if self.max_boost > 0:
            own = F.least(own, F.lit(float(self.max_boost)))
        score = _blend(self.boost_mode, s, own) * F.lit(float(self.weight))
        return (p & (score >= F.lit(float(self.min_score))) if self.min_score else p), score


@dataclass(frozen=True)
class BM25F(Node):
    """Unanalysed terms over weighted fields {name: boost or (boost, b)}; b None is the usual 0.75, 0 no length normalisation."""

    span: tuple[str, ...]
    fields: tuple[tuple[str, float, float | None], ...]

    def needs(self, ctx):
        return [(f, t) for t in self.span for f, _, _ in self.fields]

    def anchored(self, ctx):
        return all(ctx.is_text(f) for f, _, _ in self.fields)

    def build(self, ctx):
        conditions, score = [], F.lit(ZERO)
        for t in dict.fromkeys(self.span):
            pseudo = F.lit(ZERO)
            for f, boost, b in self.fields:
                b = scoring.B if b is None else b
                tf = ctx.tf(f, t)
                conditions.append(tf > 0)
                ratio = F.when(ctx.average(f) > 0, scoring.quantised(ctx.length(f)) / ctx.average(f)).otherwise(F.lit(1.0))
                pseudo = pseudo + F.lit(float(boost or 1.0)) * tf / (F.lit(1 - b) + F.lit(float(b)) * ratio)
            most = F.greatest(*[ctx.df(f, t) for f, _, _ in self.fields], F.lit(0))
            score = score + F.lit(float(self.span.count(t))) * scoring.idf(ctx.n_docs, most) * pseudo / (pseudo + scoring.K1)
        return _any(conditions), score * F.lit(float(self.weight))
