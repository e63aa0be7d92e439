"""Token counts without token ids: pieces are counted once per distinct pre-token and joined to per-document frequencies.

1. Every text's pre-token frequencies are added up map-side; each distinct pre-token passes the model once.
2. The HOT most frequent pre-tokens (a fixed bound) and their piece counts go to all tasks, which sum them per document
   where the text lies. So no frequent pre-token is ever a shuffle key.
3. The rest, rare by definition, are joined as (document, pre-token, frequency) rows and summed per document.

Defined cases: null text counts 0 bytes and 0 tokens; strings of added tokens inside a text count one token each, as by
the library's default; rows that repeat a doc_id each have their row; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.llm.common import Scratch
from tesselon.llm.pretokens import worker

HOT = 1 << 18
#: A task's partial frequencies are passed on when they have as many entries.
PARTIAL = 1 << 20


def _vocabulary(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker(path)
        held: Counter = Counter()

        def out():
            done = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["pretoken", "freq"])
            held.clear()
            return done

        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text:
                    held.update(own.split(text)[0])
            if len(held) >= PARTIAL:
                yield out()
        if held:
            yield out()

    return run


def _pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker(path)
        for batch in batches:
            n = [own.n_pieces(p) for p in batch.column("pretoken").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("pretoken"), batch.column("freq"), pa.array(n, pa.int32())], names=["pretoken", "freq", "n_pieces"])

    return run


def _known(path: str, hot):
    """A row for each text (pretoken null, n the tokens known here) and one for each of its rare pre-tokens (n its frequency)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = worker(path), hot.value
        for batch in batches:
            row, ids = batch.column("row").to_pylist(), batch.column("doc_id").to_pylist()
            rows, docs, sizes, keys, ns = [], [], [], [], []
            for r, d, text in zip(row, ids, batch.column("text").to_pylist()):
                freq, n = own.split(text or "")
                rare = []
                for p, k in freq.items():
                    each = known.get(p)
                    if each is None:
                        rare.append((p, k))
                    else:
                        n += each * k
                rows += [r] * (len(rare) + 1)
                docs += [d] * (len(rare) + 1)
                sizes += [len((text or "").encode())] + [None] * len(rare)
                keys += [None, *[p for p, _ in rare]]
                ns += [n, *[k for _, k in rare]]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(docs, batch.schema.field("doc_id").type), pa.array(sizes, pa.int64()), pa.array(keys, pa.string()), pa.array(ns, pa.int64())], names=["row", "doc_id", "n_bytes", "pretoken", "n"])

    return run


def _band(freq):
    return F.floor(F.log2(freq) * 16)


def _last_band(pieces: DataFrame, hot: int) -> int:
    """The frequency band (sixteen to a doubling) above which there are at most `hot` pre-tokens; a band is never split."""
    n = 0
    for r in pieces.groupBy(_band(F.col("freq")).alias("band")).agg(F.count("*").alias("n")).orderBy(F.desc("band")).collect():  # 16 * 64 rows at most
        n += r["n"]
        if n > hot:
            return r["band"]
    return -1


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, text: str = "text", doc_id: str = "doc_id", hot: int = HOT) -> DataFrame:
    """Per row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    vocabulary = rows.select("text").mapInArrow(_vocabulary(tokenizer), "pretoken string, freq long").groupBy("pretoken").agg(F.sum("freq").alias("freq"))
    pieces = scratch.write(vocabulary.mapInArrow(_pieces(tokenizer), "pretoken string, freq long, n_pieces int"), "pieces")
    top = pieces.where(_band(F.col("freq")) > _last_band(pieces, hot)).select("pretoken", "n_pieces").toArrow()
    known = spark.sparkContext.broadcast(dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist())))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    split = scratch.write(rows.mapInArrow(_known(tokenizer, known), f"row long, doc_id {id_type}, n_bytes long, pretoken string, n long"), "split")
    rare = split.where("pretoken IS NOT NULL").select("row", "pretoken", "n").join(pieces.select("pretoken", "n_pieces"), "pretoken").select("row", (F.col("n") * F.col("n_pieces")).alias("n"))
    rare = rare.groupBy("row").agg(F.sum("n").alias("rare"))
    counted = split.where("pretoken IS NULL").select("row", "doc_id", "n_bytes", "n").join(rare, "row", "left")
    n = (F.col("n") + F.coalesce("rare", F.lit(0))).cast("long")
    return counted.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
