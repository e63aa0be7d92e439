import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tesselon.llm import rans, token_codec, token_counts
from tesselon.llm.common import Scratch
from tesselon.llm.pretokens import PLAIN, Worker

PATH = public_tokenizers.path("word_bpe_49k.json")


def library(texts):
    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_worker_equals_the_library():
    rng = random.Random(4)
    plain = [c for c in map(chr, [9, 10, 13, *range(32, 0x180)]) if PLAIN.fullmatch(c)]
    texts = ["".join(rng.choice(plain) for _ in range(30)) for _ in range(300)]
    texts += ["".join(rng.choice("'SsTtd Ll_-9.é") for _ in range(25)) for _ in range(300)]
    texts += ["e\u0301 İstanbul ΑΣ Σ", "a<|endoftext|>b<|startoftext|>", "x\u00a0y\u2028z", "½ ² ª", "\x1c\x0b\x0cq", ""]
    own = Worker(PATH)
    for t, ids in zip(texts, library(texts)):
        assert own.encode(t) == ids
        assert all(np.frombuffer(own.packed(t, kind), kind).tolist() == ids for kind in ("<u2", "<u4"))
        freq, extra = own.split(t)
        assert extra + sum(own.n_pieces(p) * k for p, k in freq.items()) == len(ids)


def test_a_word_is_encoded_once_whatever_signs_follow_it():
    own, real, asked = Worker(PATH), Tokenizer.from_file(PATH).model, []

    class Counting:
        def tokenize(self, piece):
            asked.append(piece)
            return real.tokenize(piece)

    own.model = Counting()
    text = "quokkas quokkas, quokkas%%% Quokkas. (quokkas) it's"
    assert np.frombuffer(own.packed(text, "<u2"), "<u2").tolist() == library([text])[0]
    assert asked.count("quokkas") == 1 and len(asked) == len(set(asked)) > 0


@pytest.mark.parametrize("hot", [0, 10, 1 << 18])
def test_counts(spark, docs, rows, hot):
    got = token_counts.count_tokens(docs, PATH, limit=50, hot=hot).collect()
    want = [(r[0], len((r[1] or "").encode()), len(ids), len(ids) > 50) for r, ids in zip(rows, library([r[1] for r in rows]))]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_counts_of_an_empty_table(empty):
    assert token_counts.count_tokens(empty, PATH).count() == 0


def test_rans_round_trip_and_compression():
    rng = np.random.default_rng(0)
    counts = (1e6 / np.arange(1, 50_001) ** 1.2).astype(np.int64)
    table = rans.Table.from_counts(counts)
    assert table.freq.sum() == 1 << rans.SCALE and table.freq.min() > 0
    p = counts / counts.sum()
    blocks = [rng.choice(len(p), n, p=p).astype(np.uint32) for n in (0, 1, 63, 64, 65, 5000, 40_000)]
    coded = rans.encode(blocks, table)
    for b, back in zip(blocks, rans.decode(coded, table)):
        assert (b == back).all()
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum()
    assert len(coded[-1].words) * 8 < 40_000 * entropy * 1.05 + 8000
    assert len(coded[-1].at) == -(-(-(-40_000 // rans.LANES)) // rans.CHECKPOINT)


def test_damaged_block_is_refused():
    table = rans.Table.from_counts(np.ones(100, np.int64))
    block = rans.encode([np.arange(100)], table)[0]
    block.states = b"\x01" + block.states[1:]
    with pytest.raises(ValueError, match="checksum"):
        rans.decode([block], table)


def test_damaged_directories_and_tables_are_refused(spark, docs):
    path = Scratch(spark, "t").root
    token_codec.write_dataset(docs.limit(20), path, PATH)
    blocks = spark.read.parquet(f"{path}/blocks")
    for column, change in (("doc_ids", F.reverse("doc_ids")), ("counts", F.transform("counts", lambda c: c + 1)), ("at", F.transform("at", lambda c: c + 1))):
        other = Scratch(spark, "t").root
        for name in ("freqs", "parts"):
            spark.read.parquet(f"{path}/{name}").write.parquet(f"{other}/{name}")
        blocks.withColumn(column, change).write.parquet(f"{other}/blocks")
        with pytest.raises(Exception, match="checksum"):
            token_codec.read_digest(spark, other).collect()
    other = Scratch(spark, "t").root
    spark.read.parquet(f"{path}/freqs").withColumn("freq", F.col("freq") + F.when(F.col("id") == 5, 1).when(F.col("id") == 6, -1).otherwise(0)).write.parquet(f"{other}/freqs")
    for name in ("blocks", "parts"):
        spark.read.parquet(f"{path}/{name}").write.parquet(f"{other}/{name}")
    with pytest.raises(Exception, match="checksum|repeat|negative"):
        token_codec.read_digest(spark, other).collect()


def test_dataset_round_trip(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(token_codec, "BLOCK_IDS", 500)
    path = Scratch(spark, "t").root
    token_codec.write_dataset(docs, path, PATH)
    ids = [(r[0], tuple([*i, 1])) for r, i in zip(rows, library([r[1] for r in rows]))]
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, tuple(r["ids"])) for r in token_codec.read_ids(spark, path).collect()) == sorted((*key(r), r[1]) for r in ids)
    got = sorted(token_codec.read_digest(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [r[0] for r in sorted(ids, key=key)]
    at, by = 0, {}
    for d, i in ids:
        by.setdefault(d, []).append((len(i), zlib.crc32(np.array(i, "<u4").tobytes())))
    for r in got:
        assert r["start"] == at
        assert (r["n_tokens"], r["ids_crc32"]) in by[r["doc_id"]]
        at += r["n_tokens"]
    assert spark.read.parquet(f"{path}/blocks").count() > 5


def test_dataset_of_an_empty_table(spark, empty):
    path = Scratch(spark, "t").root
    token_codec.write_dataset(empty, path, PATH)
    assert token_codec.read_digest(spark, path).count() == 0
