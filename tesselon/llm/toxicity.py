"""Toxicity of texts whose words may be disguised: noisy-channel restoring, then a trained score.

1. A character language model: counts of all the corpus's n-grams of code points up to ORDER within words, weighed by how
   often each word occurs, with back-off to shorter ones. It is gathered anew from all texts of the corpus it is used on,
   and grows with them; none is left out, however rare.
2. Disguised chunks (digits or signs among letters, letters drawn out, letters set apart) become lattices: a sign may
   stand for itself or for letters it resembles, a run of one letter for one or two, a separator for nothing. Viterbi
   decoding under the language model restores the likeliest word, whatever the chunk's length. If the model makes no more
   than MODEL_BYTES, each worker has it. Else it stays a table: which n-grams a lattice asks for doesn't depend on the
   model, so those that blocks of distinct chunks ask for are joined with it, and each chunk is restored once in its
   block. Workers have all restored chunks if these make no more than MODEL_BYTES; else texts are joined with what stands
   behind their chunks. All ways give the same words.
3. Features of a text are its restored words and their beginnings. Log odds of features, for toxicity and against it, are
   learned from the labelled rows that aren't held out, about MAX_LABELLED at most (those of least hash), one of each group of
   near copies. A text's two figures, the sum of its strongly toxic features and the mean of its words' log odds,
   pass a logistic curve. It is fitted on all those rows, each one's figures being by the log odds that the rows of the
   other PARTS - 1 parts give.

The only inputs of a score are the text and these models.

Defined cases: null and empty texts score as a text without features; a doc_id labelled more than once counts as
toxic if any label does; null labels are no labels; without labelled rows of both classes every score is 0; rows that
repeat a doc_id each have their row; an empty table gives an empty result; texts of any length are read whole, in time
linear in it; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import math
import re
import sys
import uuid
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.llm.common import BROADCAST_BYTES, Scratch, mix64, slices, small
from tesselon.llm.ngram_join import shingle_sets

MAX_LABELLED, MAX_FEATURES, FOLDS, PARTS = 200_000, 1 << 16, 5, 4
#: A feature has log odds if so many texts have it and they are so many standard errors from 0; it is strongly toxic if so
#: many toxic texts have it, and if they are STRONG at least and so many errors from 0.
LEAST_DOCS, LEAST_Z, STRONG, STRONG_Z = 4, 1.0, 3.0, 3.0
#: Letters of an n-gram, bytes of one in a worker's table (or of a restored chunk, its letters apart), and what a letter less of context costs.
ORDER, GRAM_BYTES, BACK_OFF = 4, 160, math.log(0.4)
#: Restored chunks that a worker keeps for each model, and the longest of them; longer ones are restored each time.
CACHE, CACHED = 1 << 19, 64

#: Bytes of the language model's table in a worker, or of restored chunks; a larger model is joined with what a block of chunks asks, and that has about so many letters.
MODEL_BYTES, BLOCK_LETTERS = 2 * BROADCAST_BYTES, 1 << 14

#: What a sign may stand for.
LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e"}
SEPARATORS = "._-*~'’"

_PLAIN = re.compile(r"[^\W\d_]+")
PAD = " " * (ORDER - 1)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()  # of chunks: no word goes over white space

    def out() -> pa.RecordBatch:
        words: defaultdict[str, int] = defaultdict(int)
        while held:
            chunk, n = held.popitem()
            for word in (chunk,) if chunk.isalpha() else _PLAIN.findall(chunk):
                words[word] += n
        return pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], names=["word", "n"])

    for batch in batches:
        for text in batch.column("text").to_pylist():
            if text:
                held.update(text.lower().split())
        if len(held) >= 1 << 20:
            yield out()
    yield out()


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams of words, a blank marking the end and ORDER - 1 of them the beginning."""
    for batch in batches:
        longest: defaultdict[str, int] = defaultdict(int)
        for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
            s = PAD + word + " "
            for i in range(len(word) + 1):
                longest[s[i : i + ORDER]] += n
        # a shorter one that ends at the same letter is an end of it
        counts: defaultdict[str, int] = defaultdict(int)
        for gram, n in longest.items():
            for k in range(ORDER):
                counts[gram[k:]] += n
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["gram", "n"])


class LanguageModel:
    """log P(letter | letters before it in its word), by the longest context known."""

    def __init__(self, counts: dict[str, int], context: dict[str, int] | None = None):
        """counts of n-grams, and those of what they begin with; without the latter, counts are all there are."""
        self.counts, self.seen = counts, {}
        self.context = Counter() if context is None else context
        if context is None:
            for gram, n in counts.items():
                self.context[gram[:-1]] += n
        self.least = -math.log(self.context[""] + 1) + ORDER * BACK_OFF

    def __call__(self, before: str, letter: str) -> float:
        gram = before + letter
        found = self.seen.get(gram)
        if found is None:
            found, cost = self.least, 0.0
            for k in range(len(gram)):
                n = self.counts.get(gram[k:])
                if n:
                    found = cost + math.log(n / self.context[gram[k:-1]])
                    break
                cost += BACK_OFF
            if len(self.seen) < CACHE:
                self.seen[gram] = found
        return found

    def restore(self, chunk: str, split: bool = False) -> str:
        return viterbi(chunk, self, split)


def language_model(docs: DataFrame, scratch: Scratch, most: int = MODEL_BYTES) -> dict[str, int] | DataFrame:
    """Counts of all n-grams over all texts: in a dictionary if that makes `most` bytes at most, else as a table (gram, n)."""
    words = docs.select("text").mapInArrow(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    grams = words.mapInArrow(_grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    grams = scratch.write(grams, "grams")
    if grams.count() * GRAM_BYTES > most:
        return grams
    rows = grams.toArrow()  # `most` bytes at most
    return dict(zip(rows.column("gram").to_pylist(), rows.column("n").to_pylist()))


def lattice(chunk: str) -> list[list[tuple[str, int, float]]]:
    """From each place of a chunk: (letters given, next place, log probability of writing them so)."""
    out: list[list[tuple[str, int, float]]] = []
    lengths = [1] * len(chunk)
    for i in range(len(chunk) - 2, -1, -1):
        if chunk[i] == chunk[i + 1]:
            lengths[i] += lengths[i + 1]
    for i, (c, run) in enumerate(zip(chunk, lengths)):
        edges = []
        if c.isalpha():
            edges.append((c, i + 1, -0.05))
            if run > 1:
                edges += [(c, i + run, -0.5 - 0.1 * run), (c * 2, i + run, -1.0 - 0.1 * run)]
        elif c in LOOKS:
            edges += [(x, i + 1, -1.5) for x in LOOKS[c]]
            if run > 1:
                edges += [(x, i + run, -2.0) for x in LOOKS[c]]
        if not c.isalpha():
            edges.append(("", i + 1, -0.7 if c in SEPARATORS or c == " " else -6.0))
        out.append(edges)
    return out


def viterbi(chunk: str, lm: LanguageModel, split: bool = False) -> str:
    """The likeliest letters behind a chunk; with split, words may end between any two of them and blanks say where.

    A path is a link to the path before it and the letters added, and a place's states go once they are used, so time and
    memory are linear in the chunk's length.
    """
    edges = lattice(chunk)
    beams: list[dict[str, tuple[float, tuple | None]]] = [{} for _ in range(len(chunk) + 1)]
    beams[0][PAD] = (0.0, None)

    def put(place: int, state: str, score: float, path: tuple | None, letters: str) -> None:
        old = beams[place].get(state)
        if old is None or score > old[0]:
            beams[place][state] = (score, (path, letters) if letters else path)

    for i, out in enumerate(edges):
        here, beams[i] = beams[i], {}
        for before, (score, path) in here.items():
            ways = [(before, score, path)]
            if split and before[-1] != " ":
                ways.append((PAD, score + lm(before, " "), (path, " ")))
            for b2, s2, p2 in ways:
                for letters, to, cost in out:
                    x, s = b2, s2 + cost
                    for c in letters:
                        s += lm(x, c)
                        x = x[1:] + c
                    put(to, x, s, p2, letters)
    ends = [(s + lm(before, " "), p) for before, (s, p) in beams[-1].items()]
    if not ends:
        return chunk
    path, parts = max(ends, key=lambda end: end[0])[1], []
    while path is not None:
        path, letters = path
        parts.append(letters)
    return "".join(reversed(parts))


_DRAWN = re.compile(r"(.)\1\1")
_APART = re.compile(r"(?<!\S)(?:[^\W_][ .\-_*]){3,}[^\W_](?!\S)")


def _asked(chunk: str, split: bool) -> str:
    """A chunk to restore and how, in one string: a blank before it, where no chunk has one, is for split."""
    return " " + chunk if split else chunk


class Asked(set):
    """Restores nothing and holds what it was asked."""

    def restore(self, chunk: str, split: bool = False) -> str:
        self.add(_asked(chunk, split))
        return ""


class Restored(dict):
    """What was restored before, for all that a text asks."""

    def restore(self, chunk: str, split: bool = False) -> str:
        return self[_asked(chunk, split)]


class AskedGrams(set):
    """A language model's place in viterbi: holds the n-grams asked for, which the answers don't change."""

    def __call__(self, before: str, letter: str) -> float:
        self.add(before + letter)
        return 0.0


class Restorer:
    """Restored words of chunks and texts."""

    def __init__(self, lm: LanguageModel | Restored | Asked):
        self.lm = lm

    def words(self, chunk: str) -> tuple[str, ...]:
        """The words behind a lower-case chunk without white space."""
        # a sign before a word may be a letter, as in $cum; behind it, signs end a sentence or are junk
        core = chunk.lstrip(".,;:?\"()[]{}<>#%&=/\\`^*~_-'!|+").rstrip(".,;:?\"()[]{}<>#%&=/\\`^*~_-'!|+$@")
        if core.isalpha() or _PLAIN.fullmatch(core):
            return (core,) if not _DRAWN.search(core) else (core, self.lm.restore(core))
        bare = core
        parts = tuple(_PLAIN.findall(chunk))
        letters = sum(map(len, parts))
        # numbers and addresses aren't disguised words
        if letters < 1 or any(not (c.isalpha() or c in LOOKS or c in SEPARATORS) for c in bare):
            return parts
        return (*parts, *self.lm.restore(bare).split())

    def apart(self, low: str) -> Iterator[str]:
        """The words behind runs of letters set apart in a lower-case text."""
        for m in _APART.finditer(low):
            yield from self.lm.restore(m[0], split=True).split()
            yield re.sub(r"[\W_]+", "", m[0])

    def text(self, text: str) -> set[str]:
        low = text.lower()
        return {w for c in set(low.split()) for w in self.words(c)}.union(self.apart(low))


class Gatherer:
    """The union of what is made of the restored words of a text's chunks, cached a worker."""

    def __init__(self, lm: LanguageModel | Restored, make: Callable[[str], tuple[str, ...]]):
        self.own, self.make, self.cache = Restorer(lm), make, {}

    def __call__(self, text: str) -> set[str]:
        low = text.lower()
        chunks, cache, out = set(low.split()), self.cache, set()
        new = chunks.difference(cache)
        if len(cache) + len(new) > CACHE:
            cache.clear()
            new = chunks
        for c in new:
            made = tuple(x for w in self.own.words(c) for x in self.make(w))
            if len(c) <= CACHED and len(cache) < CACHE:
                cache[c] = made
            else:
                out.update(made)
        out.update(chain.from_iterable(map(cache.get, chunks, repeat(()))))
        for w in self.own.apart(low):
            out.update(self.make(w))
        return out


def _asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key of the text, chunk to restore), each pair once a text."""
    now, quiet = Asked(), set()
    own = Restorer(now)
    for batch in batches:
        keys, chunks = [], []
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
            low, asked = (text or "").lower(), set()
            for c in set(low.split()).difference(quiet):
                own.words(c)
                if now:
                    asked |= now
                    now.clear()
                elif len(c) <= CACHED and len(quiet) < CACHE:
                    quiet.add(c)
            for _ in own.apart(low):
                pass
            asked |= now
            now.clear()
            keys += repeat(key, len(asked))
            chunks += asked
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(chunks, pa.string())], names=["key", "asked"])


def _asked_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, n-gram or beginning of one) that the chunks of a block ask for."""
    held: defaultdict[int, set[str]] = defaultdict(set)

    def out() -> pa.RecordBatch:
        blocks, grams = np.repeat(np.fromiter(held, np.int64, len(held)), [len(g) for g in held.values()]), list(chain.from_iterable(held.values()))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(grams, pa.string())], names=["block", "gram"])

    size = 0
    for batch in batches:
        for block, asked in zip(batch.column("block").to_pylist(), batch.column("asked").to_pylist()):
            grams, of = AskedGrams(), held[block]
            viterbi(asked.lstrip(" "), grams, asked[0] == " ")
            size -= len(of)
            of.update(x for gram in grams for k in range(ORDER) for x in (gram[k:], gram[k:-1]))
            size += len(of)
            if size >= 1 << 18:
                yield out()
                size = 0
    yield out()


def _restore(chunks: pa.Table, grams: pa.Table) -> pa.Table:
    """The chunks of a block restored, by the counts of all that they ask for."""
    names = grams.column("gram").to_pylist()
    counts, context = ({g: n for g, n in zip(names, grams.column(c).to_pylist()) if n is not None} for c in ("n", "total"))
    lm = LanguageModel(counts, defaultdict(int, context))
    asked = chunks.column("asked")
    return pa.table({"asked": asked, "restored": pa.array([lm.restore(a.lstrip(" "), a[0] == " ") for a in asked.to_pylist()], pa.string())})


def with_restored(rows: DataFrame, grams: DataFrame, scratch: Scratch, most: int = MODEL_BYTES) -> tuple[DataFrame, Restored]:
    """rows, and all that they ask with what stands behind it by the table of all n-grams. If that makes more than `most` bytes, it is empty, and each row has a map `restored` of what its text asks."""
    keyed = rows.withColumn("key", F.xxhash64("text"))  # texts that share a key share a larger map
    asks = scratch.write(keyed.select("key", "text").mapInArrow(_asks, "key long, asked string").distinct(), "asks")
    asked = scratch.write(asks.select("asked").distinct(), "asked")
    letters = asked.agg(F.sum(F.length("asked"))).first()[0] or 0
    dealt = asked.select("asked", F.pmod(F.xxhash64("asked"), F.lit(letters // BLOCK_LETTERS + 1)).alias("block"))
    context = grams.groupBy(F.expr("substring(gram, 1, length(gram) - 1)").alias("gram")).agg(F.sum("n").alias("total"))
    known = dealt.mapInArrow(_asked_grams, "block long, gram string").distinct().join(grams.join(context, "gram", "full"), "gram")
    found = scratch.write(dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_restore, "asked string, restored string"), "restored")
    size = found.agg(F.sum(F.octet_length("asked") + F.octet_length("restored") + GRAM_BYTES)).first()[0] or 0
    if size <= most:
        known = found.toArrow()  # `most` bytes at most
        return rows, Restored(zip(known.column("asked").to_pylist(), known.column("restored").to_pylist()))
    told = asks.join(small(found, 1, size), "asked").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("asked", "restored"))).alias("restored"))
    keys = small(asks.select("key").distinct(), 16)  # so that only texts that ask are shuffled
    loud = scratch.write(keyed.join(keys, "key", "left_semi").join(told, "key").drop("key"), "rows")
    return loud.unionByName(keyed.join(keys, "key", "left_anti").drop("key"), allowMissingColumns=True), Restored()


def _texts(batch: pa.RecordBatch, lm: LanguageModel | Restored) -> Iterator[str]:
    """The texts of a batch; where rows have what was restored, lm holds that of the text that is out."""
    texts = batch.column("text").to_pylist()
    if "restored" in batch.schema.names:
        for text, restored in zip(texts, batch.column("restored").to_pylist()):
            lm.clear()
            lm.update(restored or ())
            yield text or ""
    else:
        yield from (text or "" for text in texts)


def features(word: str) -> tuple[str, ...]:
    """A word of three letters or more, and its first four and five letters."""
    n = len(word)
    if n > 5:
        return word, sys.intern(word[:4] + "…"), sys.intern(word[:5] + "…")
    return () if n < 3 else (word,) if n < 5 else (word, sys.intern(word[:4] + "…"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least shingle hash of each text: near copies mostly share it."""
    for batch in slices(batches):
        h, at = shingle_sets(batch.column("text"))
        h = mix64(h ^ np.uint64(0x5DEECE66D))
        least = [int(h[a:b].min().view(np.int64)) if b > a else 0 for a, b in zip(at, at[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(least, pa.int64())], names=["doc_id", "toxic", "least"])


def _tally(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm = _model(sent)[0]
        gather = Gatherer(lm, features)
        counts: defaultdict[tuple[int, int], Counter] = defaultdict(Counter)
        for batch in batches:
            for part, toxic, text in zip(batch.column("part").to_pylist(), batch.column("toxic").to_pylist(), _texts(batch, lm)):
                counts[part, toxic].update(gather(text))
        for (part, toxic), of in counts.items():
            n, none = pa.array(of.values(), pa.int64()), pa.array(np.zeros(len(of), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(of.keys(), pa.string()), pa.array(np.full(len(of), part, np.int32)), n if toxic else none, none if toxic else n], names=["feature", "part", "pos", "neg"])

    return run


def log_odds(names: list[str], pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> dict[str, tuple[float, bool]]:
    """Features with their log odds, and whether they are strongly toxic."""
    w = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
    z = w / np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
    strong = (pos >= LEAST_DOCS) & (z >= STRONG_Z) & (w >= STRONG)
    known = np.flatnonzero((pos + neg >= LEAST_DOCS) & (np.abs(z) >= LEAST_Z))
    return {names[i]: (float(w[i]), bool(strong[i])) for i in known}


#: What tells a strongly toxic feature from a word.
SURE = "\0"


class Scorer:
    def __init__(self, lm: LanguageModel | Restored, weights: dict[str, tuple[float, bool]]):
        self.weights = {f: w for f, (w, _) in weights.items()}
        self.sure = {SURE + f: w for f, (w, strong) in weights.items() if strong}
        self.known, self.strong = frozenset(self.weights), frozenset(self.sure)
        self.gather = Gatherer(lm, self._items)

    def _items(self, word: str) -> tuple[str, ...]:
        """A word of three letters or more and, of its strongly toxic features, the one that counts most."""
        if len(word) < 3:
            return ()
        found = [(self.sure[SURE + f], SURE + f) for f in features(word) if SURE + f in self.sure]
        return (word, max(found)[1]) if found else (word,)

    def evidence(self, text: str) -> tuple[float, float]:
        """The sum of a text's strongly toxic features (of a word and its beginnings the greatest counts, as they say one thing), and the mean of its words' log odds."""
        items = self.gather(text)
        sure = items & self.strong
        return math.fsum(map(self.sure.get, sure)), math.fsum(map(self.weights.get, items & self.known)) / max(len(items) - len(sure), 1)


_models: dict = {}


def _model(counts, weights=None) -> tuple[LanguageModel | Restored, list[Scorer]]:
    """The models of two broadcasts, (name, counts or restored chunks) and (name, log odds of each scorer), kept while the worker sees the same names."""
    name, table = counts.value
    if _models.get("lm", ("",))[0] != name:
        _models.clear()
        _models["lm"] = name, table if isinstance(table, Restored) else LanguageModel(table)
    lm = _models["lm"][1]
    if weights is None:
        return lm, []
    name, odds = weights.value
    if _models.get("scorers", ("",))[0] != name:
        _models.pop("scorers", None)
        _models["scorers"] = name, [Scorer(lm, w) for w in odds]
    return lm, _models["scorers"][1]


def _evidence(counts, weights):
    """(first column, strong, mean) of each text, by the log odds of its part's scorer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm, scorers = _model(counts, weights)
        for batch in batches:
            e = [scorers[p].evidence(t) for p, t in zip(batch.column("part").to_pylist(), _texts(batch, lm))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in e], pa.float64()), pa.array([x for _, x in e], pa.float64())], names=[batch.schema.names[0], "strong", "mean"])

    return run


def fit_curve(bins: list[tuple[float, float, int, int]]) -> np.ndarray:
    """Slopes and intercept of the logistic curve over (strong, mean, negatives, positives), by Newton steps with a weak prior."""
    x = np.array([(b[0], b[1], 1.0) for b in bins], float).reshape(-1, 3)
    neg, pos = np.array([b[2] for b in bins], float), np.array([b[3] for b in bins], float)
    prior, weak = np.array([1.0, 1.0, -2.0]), 0.02
    at = prior.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        n = neg + pos
        gradient = x.T @ (pos - n * p) - weak * (at - prior)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + weak * np.eye(3), gradient)
        at = at + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return at


def _sample(named: DataFrame, most: int) -> DataFrame:
    """All labelled rows, or those of least hash, about `most`: a share by hash, so that nothing is ordered."""
    n, span = named.count(), 1 << 40
    return named if n <= most else named.where(F.pmod(F.xxhash64("doc_id"), F.lit(span)) < int(span * (most / n)))


def held_out(doc_id, folds: int = FOLDS):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", max_labelled: int = MAX_LABELLED, model_bytes: int = MODEL_BYTES) -> DataFrame:
    """Per row of docs: doc_id, held_out, score (0 to 1), predicted (score >= 0.5). A language model of more than model_bytes isn't broadcast but joined."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    named = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    named = scratch.write(_sample(scratch.write(named.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "labelled"), max_labelled), "named")
    training = rows.join(small(named, 64), "doc_id").select("doc_id", "toxic", "text")
    counts = language_model(rows, scratch, model_bytes)
    if isinstance(counts, DataFrame):
        rows, counts = with_restored(rows, counts, scratch, model_bytes)
    read = [c for c in rows.columns if c != "doc_id"]
    kind = rows.schema["doc_id"].dataType.simpleString()
    grouped = training.mapInArrow(_groups, f"doc_id {kind}, toxic int, least long")
    single = scratch.write(grouped.groupBy("least", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic"), "single")
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(PARTS)).cast("int").alias("part")
    own = scratch.write(rows.join(small(single, 64), "doc_id").select(part, "toxic", *read), "training")
    size = {(r["part"], r["toxic"]): r["n"] for r in own.groupBy("part", "toxic").agg(F.count("*").alias("n")).collect()}  # 2 PARTS rows
    total = [sum(n for (_, t), n in size.items() if t == label) for label in (0, 1)]
    if not all(total):
        return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    send = lambda value: spark.sparkContext.broadcast((uuid.uuid4().hex, value))
    sent = send(counts)
    tallied = own.mapInArrow(_tally(sent), "feature string, part int, pos long, neg long").groupBy("feature")
    of = lambda c, p: F.sum(F.when(F.col("part") == p, F.col(c)).otherwise(0)).alias(f"{c}{p}")
    odds = tallied.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), *[of(c, p) for p in range(PARTS) for c in ("pos", "neg")])
    weight = F.log((F.col("pos") + 0.5) / (total[1] + 1)) - F.log((F.col("neg") + 0.5) / (total[0] + 1))
    clear = F.abs(weight / F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5)))
    kept = odds.where((F.col("pos") + F.col("neg") >= LEAST_DOCS) & (clear >= LEAST_Z)).orderBy(clear.desc(), "feature").limit(MAX_FEATURES).toArrow()
    names, column = kept.column("feature").to_pylist(), lambda c: kept.column(c).to_numpy().astype(float)
    without = [log_odds(names, column("pos") - column(f"pos{p}"), column("neg") - column(f"neg{p}"), total[1] - size.get((p, 1), 0), total[0] - size.get((p, 0), 0)) for p in range(PARTS)]
    final = log_odds(names, column("pos"), column("neg"), total[1], total[0])
    seen = own.select("toxic", "part", *read).mapInArrow(_evidence(sent, send(without)), "toxic int, strong double, mean double")
    bins = seen.groupBy(F.least(F.round("strong", 1), F.lit(60.0)).alias("s"), F.round("mean", 2).alias("m")).agg(F.sum(1 - F.col("toxic")).alias("neg"), F.sum("toxic").alias("pos")).collect()  # labelled rows at most
    a, m, b = map(float, fit_curve([(r["s"], r["m"], r["neg"], r["pos"]) for r in bins]))
    scored = rows.select("doc_id", F.lit(0).alias("part"), *read).mapInArrow(_evidence(sent, send([final])), f"doc_id {kind}, strong double, mean double")
    x = a * F.least("strong", F.lit(60.0)) + m * F.col("mean") + b
    score = 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(40.0)), F.lit(-40.0))))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("predicted"))
