"""URL filters: a blocked Bloom filter before an exact hash join.

Rules and listed URLs are entries (host, path, action). A URL's possible entries are its host and the host's parents,
each with the path's prefixes of the lengths that entries have. Their keys are probed in a blocked Bloom filter
(512-bit blocks, seven bits of one block a key); the few that pass go to an exact join on the key, which removes
false positives, and the longest entry wins.

The filter has at most MAX_BITS bits whatever the list's size, so its broadcast is bounded; a list too long for
it passes more false positives to the join and gives the same verdicts.

Defined cases: null URLs and URLs without `://` have empty host and path and fit no entry; repeated page rows each
get their verdict; two entries with one key count once, `block` before `allow`; no pages or no entries give every page
(or none) the default verdict; entries' hosts are taken in lower case; a URL of any length is split and probed whole, as
many keys as its host has parts times the entries' path lengths; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.llm.common import BROADCAST_BYTES

#: Entries of the production query: (host, path, action).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SALTS = 64
BITS_PER_KEY, PROBES, BLOCK, MAX_BITS = 16, 7, 512, 1 << 28


def key_bits(keys: Sequence[str], n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block number of each key, and the bit numbers within the block: nine bits of a hash each."""
    raw = np.frombuffer(b"".join(hashlib.blake2b(k.encode(), digest_size=16).digest() for k in keys), np.uint64).reshape(-1, 2)
    shifts = np.arange(PROBES, dtype=np.uint64) * np.uint64(9)
    return (raw[:, 0] % np.uint64(n_blocks)).astype(np.int64), ((raw[:, 1:] >> shifts) & np.uint64(BLOCK - 1)).astype(np.int64)


class BlockedBloom:
    """Bits as one array of bytes; built part by part and merged by or."""

    def __init__(self, n_blocks: int, bits: np.ndarray | None = None):
        self.n_blocks = n_blocks
        self.bits = np.zeros(n_blocks * BLOCK // 8, np.uint8) if bits is None else bits

    def add(self, keys: Sequence[str]) -> None:
        if len(keys):
            block, bit = key_bits(keys, self.n_blocks)
            place = (block[:, None] * BLOCK + bit).ravel()
            np.bitwise_or.at(self.bits, place >> 3, (1 << (place & 7)).astype(np.uint8))

    def may_contain(self, keys: Sequence[str]) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, bool)
        block, bit = key_bits(keys, self.n_blocks)
        place = block[:, None] * BLOCK + bit
        return ((self.bits[place >> 3] >> (place & 7)) & 1).all(axis=1)


def entry_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame([(h, p, a) for h, p, a in rules], "host string, path string, action string")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (ASCII lower case) and path of a URL; both empty without `://`."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [rest.find(c) for c in "/?#"]
    host = rest[: min([e for e in ends if e >= 0], default=len(rest))]
    path = rest[len(host) :]
    cut = min([e for e in (path.find("?"), path.find("#")) if e >= 0], default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path[:cut]


def possible(host: str, path: str, lengths: Sequence[int]) -> list[str]:
    """Keys of the entries that would fit: the host and its parents, with path prefixes of these lengths."""
    if not host and not path:
        return []
    hosts, rest = [host], host
    while "." in rest:
        rest = rest.split(".", 1)[1]
        hosts.append(rest)
    prefixes = [path[:n] for n in lengths if n <= len(path)]
    return [h + p for h in hosts for p in prefixes if h]


def build_filter(entries: DataFrame, n: int) -> BlockedBloom:
    """The filter of all n keys; tasks build filters of equal size, executors merge them by blocks."""
    n_blocks = max(1, min(MAX_BITS, n * BITS_PER_KEY) // BLOCK)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = BlockedBloom(n_blocks)
        for batch in batches:
            own.add(batch.column("key").to_pylist())
        rows = own.bits.reshape(-1, BLOCK // 8)
        used = np.flatnonzero(rows.any(axis=1))
        words = rows[used].copy().view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(used)] + [pa.array(words[:, i]) for i in range(8)], names=["block", *[f"w{i}" for i in range(8)]])

    schema = "block long, " + ", ".join(f"w{i} long" for i in range(8))
    merged = entries.select("key").mapInArrow(part, schema).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)])
    out = BlockedBloom(n_blocks)
    rows = out.bits.reshape(-1, BLOCK // 8)
    for r in merged.toLocalIterator():  # MAX_BITS / BLOCK rows at most
        rows[r["block"]] = np.array(r[1:], np.int64).view(np.uint8)
    return out


def filter_urls(pages: DataFrame, entries: DataFrame, default: str = "allow", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Per page: page_id, host, path, rule (the winning entry's host and path, or null), verdict, n_candidates (keys that passed the filter)."""
    spark = pages.sparkSession
    keyed = entries.select(F.concat(F.translate("host", UPPER, UPPER.lower()), "path").alias("key"), F.length("path").alias("path_length"), "action")
    keyed = keyed.groupBy("key").agg(F.max("action").alias("action"), F.max("path_length").alias("path_length"))
    lengths = sorted(r[0] for r in keyed.select("path_length").distinct().collect())  # as many as paths have lengths
    size = keyed.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("key")), F.lit(0)).alias("bytes")).first()
    bloom = build_filter(keyed, size["n"])
    sent = spark.sparkContext.broadcast(bloom)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, keys, owner = [], [], [], []
            for i, u in enumerate(batch.column("url").to_pylist()):
                host, path = split_url(u)
                hosts.append(host)
                paths.append(path)
                for k in possible(host, path, lengths):
                    keys.append(k)
                    owner.append(i)
            passed: list[list[str]] = [[] for _ in hosts]
            for j in np.flatnonzero(sent.value.may_contain(keys)):
                passed[owner[j]].append(keys[j])
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("page_id"), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(passed, pa.list_(pa.string()))], names=["row", "page_id", "host", "path", "passed"])

    id_type = pages.select(F.col(page_id).alias("page_id")).schema["page_id"].dataType.simpleString()
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    probed = rows.mapInArrow(judge, f"row long, page_id {id_type}, host string, path string, passed array<string>")
    # a page without hits keeps one row under a key of its own, which joins nothing and crowds no task
    own = F.array(F.concat(F.lit("\x00"), F.col("row").cast("string")))
    wide = probed.select("row", "page_id", "host", "path", F.size("passed").alias("n_candidates"), F.explode(F.when(F.size("passed") > 0, F.col("passed")).otherwise(own)).alias("key"))
    exact = keyed.select("key", "action")
    if size["bytes"] + 64 * size["n"] <= BROADCAST_BYTES:
        hits = wide.join(F.broadcast(exact), "key", "left")
    else:  # a key that many pages have is dealt to SALTS tasks
        salted = exact.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = wide.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"], "left")
    best = F.max(F.when(F.col("action").isNotNull(), F.struct(F.length("key"), F.col("key"), F.col("action"))))
    judged = hits.groupBy("row", "page_id", "host", "path", "n_candidates").agg(best.alias("best"))
    return judged.select("page_id", "host", "path", F.col("best")["key"].alias("rule"), F.coalesce(F.col("best")["action"], F.lit(default)).alias("verdict"), F.col("n_candidates").cast("long").alias("n_candidates"))


ORACLE = r"""
WITH u AS (
  SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages
), s AS (
  SELECT page_id, row_number() OVER () AS row_no,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM u
), r(h, p, action) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), f AS (
  SELECT row_no, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action, count(*) AS n
  FROM s JOIN r ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p) GROUP BY row_no
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM s LEFT JOIN f USING (row_no)
"""
