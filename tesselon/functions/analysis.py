"""Text analysis as Catalyst column expressions.

An analyzer is char filters, one tokenizer and token filters; each works on a column and the result is
array<struct<term string, pos int>>. Filters that drop tokens keep the others' positions, so phrases see the gap.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesselon.functions.porter2 import stem

Step = Callable[[Column], Column]

#: A number with inner separators and perhaps a word grown onto it, or a word with inner apostrophes.
STANDARD = r"\p{Nd}+(?:['’.,-]\p{Nd}+)*(?:\p{L}[\p{L}\p{Nd}]*(?:['’][\p{L}\p{Nd}]+)*)?|\p{L}[\p{L}\p{Nd}]*(?:['’][\p{L}\p{Nd}]+)*"

#: The Snowball project's English stop words.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing would should could ought i'm you're he's she's it's we're they're i've you've we've they've i'd you'd he'd she'd "
    "we'd they'd i'll you'll he'll she'll we'll they'll isn't aren't wasn't weren't hasn't haven't hadn't doesn't don't didn't won't "
    "wouldn't shan't shouldn't can't cannot couldn't mustn't let's that's who's what's here's there's when's where's why's how's a an the "
    "and but if or because as until while of at by for with about against between into through during before after above below to from "
    "up down in out on off over under again further then once here there when where why how all any both each few more most other some "
    "such no nor not only own same so than too very"
).split()

#: Latin letters with marks and what they fold to, one letter to one letter.
FOLD_FROM = "ÀÁÂÃÄÅàáâãäåĀāĂăĄąÇçĆćĈĉĊċČčÐðĎďĐđÈÉÊËèéêëĒēĔĕĖėĘęĚěĜĝĞğĠġĢģĤĥĦħÌÍÎÏìíîïĨĩĪīĬĭĮįİıĴĵĶķĹĺĻļĽľĿŀŁłÑñŃńŅņŇňÒÓÔÕÖØòóôõöøŌōŎŏŐőŔŕŖŗŘřŚśŜŝŞşŠšŢţŤťŦŧÙÚÛÜùúûüŨũŪūŬŭŮůŰűŲųŴŵÝýÿŶŷŸŹźŻżŽž"
FOLD_TO = "AAAAAAaaaaaaAaAaAaCcCcCcCcCcDdDdDdEEEEeeeeEeEeEeEeEeGgGgGgGgHhHhIIIIiiiiIiIiIiIiIiJjKkLlLlLlLlLlNnNnNnNnOOOOOOooooooOoOoOoRrRrRrSsSsSsSsTtTtTtUUUUuuuuUuUuUuUuUuUuWwYyyYyYZzZzZz"
FOLD_WIDE = (("Æ", "AE"), ("æ", "ae"), ("Œ", "OE"), ("œ", "oe"), ("ß", "ss"), ("Þ", "TH"), ("þ", "th"))


# char filters


def html_strip(text: Column) -> Column:
    """Tags become blanks; seven entities are decoded, the ampersand last so that nothing is decoded twice."""
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for name, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(plain))
    return text


def pattern_replace(pattern: str, replacement: str) -> Step:
    return lambda text: F.regexp_replace(text, pattern, replacement)


# tokenizers: text to array of strings


def _all(pattern: str) -> Step:
    return lambda text: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


standard_tokens = _all(STANDARD)
whitespace_tokens = _all(r"[^\p{IsWhite_Space}]+")
letter_tokens = _all(r"\p{L}+")


def keyword_tokens(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))


#: Tokenizers whose pieces overlap.
OVERLAPPING: set = set()


def ngram_tokens(least: int, most: int) -> Step:
    """From each start the shortest first; nothing for texts that are too short."""

    def grams(text: Column) -> Column:
        n = F.length(text)
        starts = F.when(n >= least, F.sequence(F.lit(1), n - least + 1)).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(starts, lambda s: F.transform(F.sequence(F.lit(least), F.least(F.lit(most), n - s + 1)), lambda k: F.substring(text, s, k))))

    OVERLAPPING.add(grams)
    return grams


def edge_ngram_tokens(least: int, most: int) -> Step:
    def grams(text: Column) -> Column:
        n = F.length(text)
        sizes = F.when(n >= least, F.sequence(F.lit(least), F.least(F.lit(most), n))).otherwise(F.array().cast("array<int>"))
        return F.transform(sizes, lambda k: F.left(text, k))

    OVERLAPPING.add(grams)
    return grams


# token filters: array<struct<term, pos>> to the same


@dataclass(frozen=True)
class TermFilter:
    """A filter that changes each term by itself, so that several need one pass."""

    change: Step

    def __call__(self, toks: Column) -> Column:
        return F.transform(toks, lambda t: F.struct(self.change(t["term"]).alias("term"), t["pos"].alias("pos")))


def _terms(change: Step) -> Step:
    return TermFilter(change)


lowercase = _terms(F.lower)
possessive = _terms(lambda t: F.regexp_replace(t, "['’][sS]$", ""))


def stop(words: Sequence[str] = tuple(STOP_WORDS)) -> Step:
    return lambda toks: F.filter(toks, lambda t: ~t["term"].isin(list(words)))


def length(least: int, most: int) -> Step:
    return lambda toks: F.filter(toks, lambda t: F.length(t["term"]).between(least, most))


def unique(toks: Column) -> Column:
    """The first of equal terms stays where it is: in order of (term, place in the list) each term's first begins a run."""
    placed = F.array_sort(F.transform(toks, lambda t, i: F.struct(t["term"].alias("term"), i.alias("i"), t["pos"].alias("pos"))))
    # an array of one, so that the sorted list is made once
    firsts = F.element_at(F.transform(F.array(placed), lambda s: F.filter(s, lambda t, i: (i == 0) | (t["term"] != F.get(s, i - 1)["term"]))), 1)
    return F.transform(F.array_sort(F.transform(firsts, lambda t: F.struct(t["i"], t["term"], t["pos"]))), lambda t: F.struct(t["term"].alias("term"), t["pos"].alias("pos")))


def _folded(term: Column) -> Column:
    term = F.translate(term, FOLD_FROM, FOLD_TO)
    for wide, plain in FOLD_WIDE:
        term = F.replace(term, F.lit(wide), F.lit(plain))
    return term


ascii_folding = _terms(_folded)


def synonym(rules: Sequence[str]) -> Step:
    """`a => b, c` adds b and c after a, at a's position; `a, b, c` does so for each of them."""
    more: dict[str, list[str]] = {}
    for rule in rules:
        if "=>" in rule:
            left, right = rule.split("=>")
            pairs = [(a.strip(), [b.strip() for b in right.split(",")]) for a in left.split(",")]
        else:
            group = [w.strip() for w in rule.split(",")]
            pairs = [(w, [o for o in group if o != w]) for w in group]
        for word, others in pairs:
            more.setdefault(word, []).extend(o for o in others if o not in more.get(word, []))
    table = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in more.items() for x in kv])

    def expand(toks: Column) -> Column:
        others = lambda t: F.coalesce(F.try_element_at(table, t["term"]), F.array().cast("array<string>"))
        return F.flatten(F.transform(toks, lambda t: F.concat(F.array(t), F.transform(others(t), lambda s: F.struct(s.alias("term"), t["pos"].alias("pos"))))))

    return expand


#: Stems that a worker keeps.
STEMS = 1 << 17
_stems: dict[str, str] = {}


def _stem(term: str) -> str:
    s = _stems.get(term)
    if s is None:
        s = stem(term)
        if len(_stems) < STEMS:
            _stems[term] = s
    return s


def _stemmed(terms: pa.ListArray) -> pa.ListArray:
    """Lists of terms stemmed: each distinct term of a batch once, and no list becomes Python's."""
    coded = terms.flatten().dictionary_encode()
    stems = pa.array(map(_stem, coded.dictionary.to_pylist()), pa.string())
    at = terms.offsets.to_numpy()
    return pa.ListArray.from_arrays(pa.array(at - at[0]), stems.take(coded.indices), mask=terms.is_null())


@F.arrow_udf(T.ArrayType(T.StringType()))
def _stem_terms(terms: pa.Array) -> pa.Array:
    return _stemmed(terms)


def porter2(toks: Column) -> Column:
    stems = _stem_terms(F.transform(toks, lambda t: t["term"]))
    return F.zip_with(toks, stems, lambda t, s: F.struct(s.alias("term"), t["pos"].alias("pos")))


def located(text: str, pieces: Sequence[str], overlapping: bool) -> list[tuple[int, int]]:
    """Starts and ends of a tokenizer's pieces: each behind the last, or of n-grams, which go from each start the shortest first, one further whenever they don't grow."""
    out, at, last = [], 0, 1 << 62
    for p in pieces:
        if overlapping:
            at += bool(out) and len(p) <= last
            last = len(p)
            out.append((at, at + last))
        else:
            start = text.find(p, at)
            at = start + len(p)
            out.append((start, at))
    return out


_SPAN = T.StructType([T.StructField(n, T.StringType() if n == "term" else T.IntegerType()) for n in ("term", "pos", "start", "end")])


@F.pandas_udf(T.ArrayType(_SPAN))
def _spans(texts: pd.Series, pieces: pd.Series, overlapping: pd.Series, terms: pd.Series, places: pd.Series) -> pd.Series:
    out = []
    for text, raw, o, term, pos in zip(texts, pieces, overlapping, terms, places):
        at = located(text, list(raw), o)
        out.append([{"term": t, "pos": int(p), "start": at[p][0], "end": at[p][1]} for t, p in zip(term, pos)])
    return pd.Series(out)


@dataclass(frozen=True)
class Analyzer:
    """Called on a text it gives its tokens. `spans` gives where they lie, too."""

    tokenizer: Step
    filters: tuple[Step, ...] = ()
    char_filters: tuple[Step, ...] = ()
    #: Whether a filter leaves the JVM.
    in_python: bool = field(default=False)

    def __call__(self, text: Column) -> Column:
        text = self.cleaned(text)
        n = next((i for i, f in enumerate(self.filters) if not isinstance(f, TermFilter)), len(self.filters))

        def first(term: Column) -> Column:
            for f in self.filters[:n]:
                term = f.change(term)
            return term

        toks = F.transform(self.tokenizer(text), lambda t, i: F.struct(first(t).alias("term"), i.cast("int").alias("pos")))
        for f in self.filters[n:]:
            toks = f(toks)
        return toks

    def cleaned(self, text: Column) -> Column:
        """The text behind the char filters, in which `spans` counts."""
        text = F.coalesce(text, F.lit(""))
        for f in self.char_filters:
            text = f(text)
        return text

    def spans(self, df: DataFrame, name: str, clean: str, out: str) -> DataFrame:
        """df with `clean`, the text behind the char filters, and `out`, array<struct<term, pos, start, end>>: the tokens with their places in it, in code points from 0.

        A token's pos is its number among the tokenizer's pieces, whatever filters follow.
        """
        text = F.col(name)
        toks = self(text)
        parts = F.struct(self.cleaned(text).alias("text"), self.tokenizer(self.cleaned(text)).alias("pieces"), F.transform(toks, lambda t: t["term"]).alias("terms"), F.transform(toks, lambda t: t["pos"]).alias("places"))
        # a row each, exploded, as Spark doesn't evaluate Python functions over nested lambdas
        df = df.select("*", F.explode(F.array(parts)).alias(out))
        spans = _spans(F.col(out)["text"], F.col(out)["pieces"], F.lit(self.tokenizer in OVERLAPPING), F.col(out)["terms"], F.col(out)["places"])
        return df.withColumns({clean: F.col(out)["text"], out: spans})

    def terms(self, spark, text: str) -> list[str]:
        """The terms of one query text, in order."""
        # a table of constants is evaluated where the plan is made, without a job
        row = spark.sql("SELECT * FROM VALUES (:text) AS v(text)", args={"text": text})
        return [t["term"] for t in row.select(self(F.col("text")).alias("t")).collect()[0]["t"]]


def analyze(spark, analyzer: Analyzer, text: str) -> DataFrame:
    """(term, pos, start, end) of one text."""
    row = spark.sql("SELECT * FROM VALUES (:text) AS v(text)", args={"text": text})
    return analyzer.spans(row, "text", "_clean", "_spans").select(F.inline("_spans"))


ANALYZERS = {
    "standard": Analyzer(standard_tokens, (lowercase,)),
    "english": Analyzer(standard_tokens, (possessive, lowercase, stop(), porter2), in_python=True),
    "keyword": Analyzer(keyword_tokens),
    "simple": Analyzer(letter_tokens, (lowercase,)),
}

#: Names by which a configuration refers to the parts.
TOKENIZERS = {"standard": lambda **_: standard_tokens, "whitespace": lambda **_: whitespace_tokens, "letter": lambda **_: letter_tokens, "keyword": lambda **_: keyword_tokens, "ngram": lambda min=1, max=2: ngram_tokens(min, max), "edge_ngram": lambda min=1, max=2: edge_ngram_tokens(min, max)}
FILTERS = {"lowercase": lambda **_: lowercase, "stop": lambda words=tuple(STOP_WORDS): stop(words), "length": lambda min=0, max=1 << 30: length(min, max), "unique": lambda **_: unique, "ascii_folding": lambda **_: ascii_folding, "english_possessive_stemmer": lambda **_: possessive, "stemmer": lambda **_: porter2, "synonym": lambda rules: synonym(rules)}
CHAR_FILTERS = {"html_strip": lambda **_: html_strip, "pattern_replace": lambda pattern, replacement: pattern_replace(pattern, replacement)}


def custom(config: dict) -> Analyzer:
    """{tokenizer, filters, char_filters}, each a name or {type, options}."""

    def made(spec, table):
        options = {} if isinstance(spec, str) else {k: v for k, v in spec.items() if k != "type"}
        name = spec if isinstance(spec, str) else spec["type"]
        if name not in table:
            raise ValueError(f"unknown analysis component {name!r}")
        return table[name](**options)

    filters = config.get("filters", [])
    return Analyzer(
        made(config["tokenizer"], TOKENIZERS),
        tuple(made(f, FILTERS) for f in filters),
        tuple(made(f, CHAR_FILTERS) for f in config.get("char_filters", [])),
        any((f if isinstance(f, str) else f["type"]) == "stemmer" for f in filters),
    )
