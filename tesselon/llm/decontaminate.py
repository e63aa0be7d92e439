"""Benchmark decontamination by pigeonhole edit matching.

Test items and texts are lower-cased and their white space becomes single blanks. An item of m characters may occur in
a text with k = floor(rate * m) edits; cut into k + 1 pieces, one piece at least occurs unchanged. One Aho-Corasick
pass over each whole text finds all pieces of all items, and around each hit Myers' bit-parallel algorithm gives
the least edit distance of the whole item to any part of the text there. So no occurrence within the budget is missed.

Items are a stated query set; they are taken in blocks of at most BLOCK_CHARS, each block a pass over the texts, so
neither the driver nor a task holds more than one block.

An item of fewer than `min_chars` characters has no budget and counts where it stands as whole words: with edits, or
inside a word, it would occur by chance.

Defined cases: null and empty texts match nothing, nor do null and blank items; equal items share the work and each get their rows; rows
that repeat a doc_id each get theirs; a text of any length is passed over once, and windows around its hits only are
compared; no texts or no items give no matches, and filtering then keeps everything;
other columns pass through `decontaminate`.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE, MIN_CHARS = 0.07, 40
BLOCK_CHARS = 8 << 20


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 adjoining pieces of nearly equal length, with their places."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of pattern to any substring of text, and the end of the first such substring."""
    m = len(pattern)
    at: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        at[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, now = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = at.get(c, 0)
        x = eq | down
        flat = ((((x & up) + up) ^ up) | x) & full
        rise = (down | ~(flat | up)) & full
        fall = up & flat
        if rise & top:
            now += 1
        elif fall & top:
            now -= 1
        rise = (rise << 1) & full
        fall = (fall << 1) & full
        # the text may begin anywhere, so row 0 stays 0
        up = (fall | ~(x | rise)) & full
        down = rise & x
        if now < best:
            best, end = now, j + 1
    return best, end


class Matcher:
    """All items of a block; built once a worker."""

    def __init__(self, items: list[str], rate: float, min_chars: int):
        self.items, self.budget = items, [int(rate * len(t)) if len(t) >= min_chars else 0 for t in items]
        self.whole = [len(t) < min_chars for t in items]
        self.auto = ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, t in enumerate(items):
            for at, piece in pieces(t, self.budget[i]):
                where[piece].append((i, at))
        for piece, places in where.items():
            self.auto.add_word(piece, (len(piece), places))
        if where:
            self.auto.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item, least distance, end of the first best match in the normalised text) for each item within its budget."""
        if not self.items or not text:
            return []
        text = normalise(text)
        spots: dict[int, list[int]] = defaultdict(list)
        for end, (n, places) in self.auto.iter(text):
            for item, at in places:
                start = end + 1 - n - at
                if not self.whole[item] or not (text[start - 1 : start].isalnum() or text[end + 1 : end + 2].isalnum()):
                    spots[item].append(start)
        out = []
        for item, starts in spots.items():
            m, k = len(self.items[item]), self.budget[item]
            best = None
            for lo, hi in _windows(sorted(starts), m, k, len(text)):
                d, end = myers(self.items[item], text[lo:hi])
                if d <= k and (best is None or d < best[0]):
                    best = (d, lo + end)
            if best:
                out.append((item, *best))
        return out


def _windows(starts: list[int], m: int, k: int, n: int) -> Iterator[tuple[int, int]]:
    """Parts of the text that can hold a match begun near one of the starts; overlapping ones are one."""
    lo = hi = None
    for s in starts:
        a, b = max(0, s - k), min(n, s + m + k)
        if hi is None:
            lo, hi = a, b
        elif a <= hi:
            hi = max(hi, b)
        else:
            yield lo, hi
            lo, hi = a, b
    if hi is not None:
        yield lo, hi


_matchers: dict = {}


def _matcher(sent, rate: float, min_chars: int) -> Matcher:
    """The matcher of a broadcast (name, items), kept while the worker sees the same name."""
    name, items = sent.value
    if name not in _matchers:
        _matchers.clear()
        _matchers[name] = Matcher(items, rate, min_chars)
    return _matchers[name]


def item_blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[dict[str, list[int]]]:
    """Normalised item texts and their ids, a bounded block at a time."""
    block: dict[str, list[int]] = defaultdict(list)
    size = 0
    for r in benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where("text IS NOT NULL").orderBy("text", "item_id").toLocalIterator():
        t = normalise(r["text"])
        if not t:
            continue
        if size > BLOCK_CHARS and t not in block:
            yield block
            block, size = defaultdict(list), 0
        size += 0 if t in block else len(t)
        block[t].append(r["item_id"])
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, budget, end_char) of each item that occurs in a text within its budget; end_char counts the normalised text's characters."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, distance int, budget int, end_char long"
    out = None
    for block in item_blocks(benchmark, item_id, item_text):
        sent, ids = spark.sparkContext.broadcast((uuid.uuid4().hex, list(block))), list(block.values())

        def run(batches: Iterator[pa.RecordBatch], sent=sent, ids=ids) -> Iterator[pa.RecordBatch]:
            own = _matcher(sent, rate, min_chars)
            for batch in batches:
                found = []
                for doc, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    for item, d, end in own.find(t) if t else []:
                        found += [(doc, i, d, own.budget[item], end) for i in ids[item]]
                columns = list(zip(*found)) or [[]] * 5
                types = [batch.schema.field("doc_id").type, pa.int64(), pa.int32(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "item_id", "distance", "budget", "end_char"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs in which no item occurs within its budget, in docs' own columns; each row is judged where it lies."""
    spark = docs.sparkSession
    for block in item_blocks(benchmark, item_id, item_text):
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, list(block)))
        docs = docs.where(_clean_udf(sent, rate, min_chars)(F.col(text)))
    return docs


def _clean_udf(sent, rate: float, min_chars: int):
    def clean(texts: pd.Series) -> pd.Series:
        own = _matcher(sent, rate, min_chars)
        return pd.Series([not (t and own.find(t)) for t in texts], dtype=bool)

    return F.pandas_udf(clean, "boolean")
