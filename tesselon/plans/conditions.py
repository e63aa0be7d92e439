"""Conditions from a dictionary (as JSON gives it) and from one line of text. Both only name nodes; nodes do the rest."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from typing import Any

from tesselon.operators.nodes import BM25F, Bool, Function, FunctionScore, Fuzzy, GeoDistance, Match, MatchAll, MatchNone, Node, Phrase, Prefix, QueryError, Range, Regexp, SpanNear, Term, Wildcard

#: Kind to node, and the node's arguments by the keys that give them (the first that is there).
SIMPLE = {
    "term": (Term, {"field": ("field",), "term": ("value",)}),
    "match_phrase": (Phrase, {"field": ("field",), "text": ("query",), "slop": ("slop",)}),
    "prefix": (Prefix, {"field": ("field",), "prefix": ("value",)}),
    "fuzzy": (Fuzzy, {"field": ("field",), "term": ("term", "value"), "max_edits": ("max_edits",)}),
    "wildcard": (Wildcard, {"field": ("field",), "pattern": ("pattern", "value")}),
    "regexp": (Regexp, {"field": ("field",), "pattern": ("pattern", "value")}),
    "geo_distance": (GeoDistance, {"field": ("field",), "lat": ("lat",), "lon": ("lon",), "metres": ("distance", "meters")}),
}
OPTIONS = ("score_mode", "boost_mode", "max_boost", "min_score")


def from_json(text: str) -> Node:
    try:
        return from_dict(json.loads(text))
    except json.JSONDecodeError as e:
        raise QueryError(f"not JSON: {e}") from None


def from_dict(d: Mapping[str, Any]) -> Node:
    """{kind: body}; a boost stands in the body or beside it."""
    kinds = [k for k in d if k != "boost"] if isinstance(d, Mapping) else []
    if len(kinds) != 1:
        raise QueryError("a condition has exactly one kind")
    kind, body = kinds[0], d[kinds[0]]
    if not isinstance(body, Mapping):
        raise QueryError(f"{kind}: a body is an object")
    boost = {"boost": float(b)} if (b := d.get("boost", body.get("boost"))) is not None else {}
    try:
        return _made(kind, body, boost)
    except (KeyError, TypeError, AttributeError) as e:
        raise QueryError(f"{kind}: {e}") from None


def _made(kind: str, body: Mapping[str, Any], boost: dict) -> Node:
    if kind in SIMPLE:
        node, keys = SIMPLE[kind]
        given = {name: body[k] for name, options in keys.items() for k in options[:1] if k in body}
        given |= {name: body[k] for name, options in keys.items() if name not in given for k in options[1:] if k in body}
        return node(**given, **boost)
    if kind == "match":
        return Match(body["field"], body["query"], "must" if body.get("operator") == "and" else "should", **boost)
    if kind in ("match_all", "match_none"):
        return MatchAll(**boost) if kind == "match_all" else MatchNone()
    if kind == "range":
        low, high = body.get("gte", body.get("gt")), body.get("lte", body.get("lt"))
        return Range(body["field"], low, high, "gte" in body, "lte" in body, **boost)
    if kind == "bool":
        clauses = {k: tuple(from_dict(c) for c in body.get(k, ())) for k in ("must", "should", "must_not", "filter")}
        return Bool(**clauses, minimum_should_match=body.get("minimum_should_match"), **boost)
    if kind == "span_near":
        return SpanNear(body["field"], tuple(body["terms"]), body.get("slop", 0), body.get("in_order", True), **boost)
    if kind == "function_score":
        functions = tuple(_function(f) for f in body.get("functions", ()))
        return FunctionScore(from_dict(body["query"]), functions, **{k: body[k] for k in OPTIONS if body.get(k)}, **boost)
    if kind == "bm25f":
        fields = tuple((f["name"], float(f.get("boost", 1.0)), None if f.get("b", 0.0) < 0 else float(f.get("b", 0.0))) for f in body["fields"])
        return BM25F(tuple(body["terms"]), fields, **boost)
    raise QueryError(f"unknown kind {kind!r}")


def _function(f: Mapping[str, Any]) -> Function:
    common = {"weight": float(f.get("weight", 1.0)), "filter": from_dict(f["filter"]) if "filter" in f else None}
    if v := f.get("field_value_factor"):
        return Function("field_value_factor", field=v["field"], factor=float(v.get("factor", 1.0)), modifier=v.get("modifier", "none"), missing=float(v.get("missing", 0.0)), **common)
    if "random_score" in f:
        return Function("random", seed=int(f["random_score"].get("seed", 0)), **common)
    for kind in ("gauss", "exp", "linear"):
        if v := f.get(kind):
            return Function(kind, field=v["field"], **{k: float(v[k]) for k in ("origin", "scale", "offset", "decay") if k in v}, **common)
    return Function(**common)


#: One clause: a sign, a field, and a phrase, a range or a word.
CLAUSE = re.compile(r"""(?P<sign>[+-]?)(?:(?P<field>[^\s:"\[\]{}]+):)?(?:"(?P<phrase>[^"]*)"|(?P<open>[\[{])\s*(?P<low>\S+)\s+TO\s+(?P<high>[^\s\]}]+)\s*(?P<close>[\]}])|(?P<word>[^\s"\[\]{}]+))\s*""")


def from_text(text: str, default: str) -> Node:
    """`a +b -c d:"e f" g:[1 TO 5} h*` and AND, OR, NOT; words that stand alone may match, AND makes the word after it a must.

    Words are analysed, prefixes aren't; no clause matches nothing, and what is no clause is an error.
    """
    clauses: dict[str, list[Node]] = {"must": [], "should": [], "must_not": []}
    at, kind, text = 0, "should", text.strip()
    while at < len(text):
        m = CLAUSE.match(text, at)
        if m is None:
            raise QueryError(f"no clause at place {at}: {text[at:]!r}")
        at = m.end()
        if m["word"] in ("AND", "OR", "NOT") and not (m["sign"] or m["field"]):
            kind = {"AND": "must", "OR": "should", "NOT": "must_not"}[m["word"]]
            continue
        own = {"+": "must", "-": "must_not"}.get(m["sign"], kind)
        clauses[own].append(_clause(m, m["field"] or default))
        kind = "should"
    if kind == "must_not":
        raise QueryError("NOT without a clause")
    if not any(clauses.values()):
        return MatchNone()
    return Bool(**{k: tuple(v) for k, v in clauses.items()}).rewrite()


def _clause(m: re.Match, field: str) -> Node:
    if m["phrase"] is not None:
        return Phrase(field, m["phrase"])
    if m["open"]:
        low, high = (None if v == "*" else v for v in (m["low"], m["high"]))
        return Range(field, low, high, m["open"] == "[", m["close"] == "]")
    if m["word"].endswith(":"):
        raise QueryError(f"an empty term for {m['word']}")
    return Prefix(field, m["word"][:-1]) if len(m["word"]) > 1 and m["word"].endswith("*") else Match(field, m["word"])
