"""Token-ID output: documents' ids in ascending doc_id order, in blocks of a static range asymmetric numeral system.

A dataset is a folder of three tables, written through Spark's committers, so that a lost executor's part is written
again and any store that Spark writes will do:

- `freqs` (id, freq): the shared table, fixed before the first block is coded;
- `blocks` (part, block, doc_ids, counts, n_ids, words, states, at, crc): whole documents up to about BLOCK_IDS ids,
  `block` being the place of the first in its part, coded on interleaved lanes with checkpoints and a checksum, each block readable by itself;
- `parts` (part, n_ids, start): where each part's ids begin in the whole sequence.

Documents are range-partitioned by doc_id, so parts are in order and no task holds more than one part's share; a part's
place is a prefix sum over parts.

Defined cases: null text is the end id alone; null doc_ids come first; rows that repeat a doc_id follow one another,
in the order of their texts' hashes; one document is one block at most, however long; an empty table gives a dataset without
blocks; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselon.llm import rans
from tesselon.llm.common import Scratch, n_partitions
from tesselon.llm.pretokens import worker

BLOCK_IDS = 1 << 16
#: Bytes of text of a part.
PART_BYTES = 32 << 20
#: Blocks coded together.
TOGETHER_IDS = 1 << 20


def _ids(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seq = worker(path), 0
        kind = np.dtype("<u2" if max(own.tok.get_vocab_size() - 1, end) < 1 << 16 else "<u4")
        last = np.array([end], kind).tobytes()
        for batch in batches:
            packed = [own.packed(text, kind.str) + last if text else last for text in batch.column("text").to_pylist()]
            n = [len(p) // kind.itemsize for p in packed]
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(np.arange(seq, seq + len(n))), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(packed, pa.binary())], names=["part", "seq", "doc_id", "n", "ids"])
            seq += len(n)

    return run


def _unpacked(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, np.uint16 if len(blob) == 2 * n else np.uint32)


def _count(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for n, b in zip(batch.column("n").to_pylist(), batch.column("ids").to_pylist()):
                total += np.bincount(_unpacked(b, n), minlength=size) if n > size // 8 else 0
                if n <= size // 8:
                    np.add.at(total, _unpacked(b, n), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    return run


def _code(table):
    """Blocks of consecutive documents of a part. A task reads pieces of parts; where one ends, so does the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list = []  # (part, block, doc_ids, counts, ids)
        docs: list = []
        state = {"part": None, "block": 0, "next": 0, "held": 0, "ids": 0}

        def close():
            if docs:
                waiting.append((state["part"], state["block"], [d for d, _ in docs], [len(x) for _, x in docs], np.concatenate([x for _, x in docs])))
                state["held"] += state["ids"]
                state["ids"] = 0
                docs.clear()

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for part, seq, doc, n, blob in zip(batch.column("part").to_pylist(), batch.column("seq").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), batch.column("ids").to_pylist()):
                if part != state["part"] or seq != state["next"]:
                    close()
                if not docs:
                    state["part"], state["block"] = part, seq
                state["next"] = seq + 1
                docs.append((doc, _unpacked(blob, n)))
                state["ids"] += n
                if state["ids"] >= BLOCK_IDS:
                    close()
                if state["held"] >= TOGETHER_IDS:
                    yield _rows(waiting, table.value, kind)
                    waiting.clear()
                    state["held"] = 0
        close()
        if waiting:
            yield _rows(waiting, table.value, kind)

    return run


def _directory_crc(crc: int, doc_ids: list, counts: list[int]) -> int:
    """A block's checksum with its directory."""
    return zlib.crc32(repr(doc_ids).encode(), zlib.crc32(np.array(counts, "<i8").tobytes(), crc))


def _coded(batch: pa.RecordBatch, table: rans.Table) -> tuple[list[rans.Block], list, list]:
    """The blocks of a batch, their doc_ids and counts, each directory held against the checksum."""
    n, words, states, at, crc, docs, counts = (batch.column(c).to_pylist() for c in ("n_ids", "words", "states", "at", "crc", "doc_ids", "counts"))
    blocks = []
    for b, d, c, k in zip(zip(n, words, states, at), docs, counts, crc):
        own = rans._crc(*b, table)
        if _directory_crc(own, d, c) != k or sum(c) != b[0]:
            raise ValueError("a block doesn't match its checksum")
        blocks.append(rans.Block(*b, own))
    return blocks, docs, counts


def _rows(waiting: list, table: rans.Table, kind: pa.DataType) -> pa.RecordBatch:
    coded = rans.encode([w[4] for w in waiting], table)
    columns = [
        pa.array([w[0] for w in waiting], pa.int32()),
        pa.array([w[1] for w in waiting], pa.int64()),
        pa.array([w[2] for w in waiting], pa.list_(kind)),
        pa.array([w[3] for w in waiting], pa.list_(pa.int64())),
        pa.array([b.n for b in coded], pa.int64()),
        pa.array([b.words for b in coded], pa.binary()),
        pa.array([b.states for b in coded], pa.binary()),
        pa.array([b.at for b in coded], pa.list_(pa.int64())),
        pa.array([_directory_crc(b.crc, w[2], w[3]) for b, w in zip(coded, waiting)], pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["part", "block", "doc_ids", "counts", "n_ids", "words", "states", "at", "crc"])


def write_dataset(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, text: str = "text", doc_id: str = "doc_id") -> None:
    """Encodes every text, appends end_id, and writes the dataset to path."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ids")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    parts = n_partitions(spark, rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0, PART_BYTES)
    keyed = rows.withColumn("_order", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(parts, "doc_id", "_order").sortWithinPartitions("doc_id", "_order", "text").drop("_order").withColumn("part", F.spark_partition_id())
    ids = ordered.mapInArrow(_ids(tokenizer, end_id), f"part int, seq long, doc_id {kind}, n long, ids binary")
    ids = scratch.write(ids, "ids", "none")
    size = max(worker(tokenizer).tok.get_vocab_size(), end_id + 1)
    counts = np.zeros(size, np.int64)
    tallied = ids.select("n", "ids").mapInArrow(_count(size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # a row for each id of the vocabulary at most
    counts[tallied.column("id").to_numpy()] = tallied.column("n").to_numpy()
    table = rans.Table.from_counts(counts)
    spark.createDataFrame(pa.table({"id": np.arange(size), "freq": table.freq.astype(np.int64)})).coalesce(1).write.mode("overwrite").parquet(f"{path}/freqs")
    sent = spark.sparkContext.broadcast(table)
    blocks = ids.mapInArrow(_code(sent), f"part int, block long, doc_ids array<{kind}>, counts array<long>, n_ids long, words binary, states binary, at array<long>, crc long")
    blocks.write.mode("overwrite").option("compression", "none").parquet(f"{path}/blocks")
    per_part = ids.groupBy("part").agg(F.sum("n").alias("n_ids"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_part.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).coalesce(1).write.mode("overwrite").parquet(f"{path}/parts")
    scratch.drop()


def _decode(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded, doc_ids, lengths = _coded(batch, table.value)
            doc, start, n, crc = [], [], [], []
            for ids, docs, counts, at in zip(rans.decode(coded, table.value), doc_ids, lengths, batch.column("start").to_pylist()):
                raw = memoryview(ids.astype("<u4").tobytes())
                lo = 0
                for d, k in zip(docs, counts):
                    doc.append(d)
                    start.append(at + lo)
                    n.append(k)
                    crc.append(zlib.crc32(raw[4 * lo : 4 * (lo + k)]))
                    lo += k
            kind = batch.schema.field("doc_ids").type.value_type
            yield pa.RecordBatch.from_arrays([pa.array(doc, kind), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def _placed_blocks(spark: SparkSession, path: str) -> tuple[DataFrame, object]:
    """The blocks with `start`, the number of ids before each, and the shared table for all tasks."""
    freqs = spark.read.parquet(f"{path}/freqs").toArrow()  # a row for each id of the vocabulary
    freq = np.zeros(len(freqs), np.int64)
    freq[freqs.column("id").to_numpy()] = freqs.column("freq").to_numpy()
    blocks = spark.read.parquet(f"{path}/blocks")
    before = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = blocks.select("part", "block", "n_ids").withColumn("inside", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).drop("n_ids")
    starts = inside.join(spark.read.parquet(f"{path}/parts").select("part", "start"), "part").select("part", "block", (F.col("start") + F.col("inside")).alias("start"))
    return blocks.join(starts, ["part", "block"]), spark.sparkContext.broadcast(rans.Table.of(freq))


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the dataset: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers)."""
    blocks, table = _placed_blocks(spark, path)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    return blocks.mapInArrow(_decode(table), f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def _decode_ids(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded, doc_ids, lengths = _coded(batch, table.value)
            doc, out = [], []
            for ids, docs, counts in zip(rans.decode(coded, table.value), doc_ids, lengths):
                doc += docs
                out += np.split(ids, np.cumsum(counts)[:-1])
            kind = batch.schema.field("doc_ids").type.value_type
            yield pa.RecordBatch.from_arrays([pa.array(doc, kind), pa.array([o.astype(np.int64) for o in out], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return run


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) of the dataset."""
    blocks, table = _placed_blocks(spark, path)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    return blocks.mapInArrow(_decode_ids(table), f"doc_id {kind}, ids array<long>")
