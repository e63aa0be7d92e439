"""N-gram Jaccard join with signature trees, and the classes of near copies that it links.

A document's set is its distinct five-word shingles (64-bit hashes). Two documents link when their sets' Jaccard
similarity reaches num / den (3/4); the result names each document's component.

1. Equal sets collapse: a 128-bit fingerprint of the set stands for all its rows, its first half is the set's number.
2. One pass deals the shingles of the distinct sets, packed, to ranges of hash values and finds those in two sets or
   more. Only they can overlap, so a set with fewer of them than 3/4 of its size links with nothing; the rest go on.
3. Signature trees over the bitmaps of the sets that remain give the candidates, by dual traversal; candidates are verified
   on the whole sets. A single tree over all sets would compare all of them with one another, as the upper nodes of a large
   tree are full; so there is a forest, and the work has three rounds:
   - trees of sets with an equal minimum hash (six a set), traversed with the tree of their least set alone: large groups
     of near copies become one component early, at a pair a set;
   - the same with trees of sets that share one of their first shingles (see below), TURNS times with another leader a tree,
     as in a group whose copies are barely alike no one set links with most: again a pair a set and tree at most. The first
     turn's leader is the same in all trees of a group, so that most of a group is linked by a few pairs a set;
   - trees of sets that share one of their first shared - ceil(3/4 n) + 1 shingles, in order of rising frequency, which any
     two linked sets do, traversed with themselves. Nodes whose sets are of one component already are not compared.
   Links that a round finds join the components of the rounds before; no link is gone through twice.

Trees hold CHUNK sets at most; larger groups are several trees whose pairs are dealt to different tasks. No partner or
candidate is capped.

A shingle that HOT sets of one packed batch have is shared for sure: its sets needn't meet in the task of its range, which
only learns of its frequency. So no common passage fills one task.

Defined cases: null, empty and blank texts have empty sets, link with nothing and are their own component; a text
of one to four words is one shingle; rows with a null doc_id are returned with a null component and link nothing; rows
that repeat a doc_id are linked each by its own text; an empty table gives an empty result; other columns pass
through `deduplicate`. Equality rests on 64-bit hashes of shingles and of sets (128 bits where whole sets are compared).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesselon.llm.common import Scratch, lower_ascii, mix64, n_partitions, slices, small, utf8, word_hashes, words
from tesselon.llm.components import components
from tesselon.llm.signature_tree import Forest, bitmap, linked_leaves

WIDTH, NUM, DEN = 5, 3, 4
STARS = 6
CHUNK = 512
#: Leaders in turn of the trees of sets that share one of their first shingles.
TURNS = 3
#: Sets of one packed batch (of about a million shingles) that make a shingle hot, and the frequency it then counts as.
HOT, HOT_DF = 64, (1 << 16) - 1
#: Pairs of one set that a task verifies.
PAIRS = 1024
_LOW = np.uint64(16)


def shingle_sets(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and their offsets."""
    raw, at = utf8(column)
    raw = lower_ascii(raw)
    starts, ends, first = words(raw, at)
    w = word_hashes(raw, starts, ends)
    n_texts, counts = len(at) - 1, np.diff(first)
    text = np.repeat(np.arange(n_texts), counts)
    place = np.arange(len(w)) - first[text]
    # a text of fewer words than the width is one shingle, which its word count tells from a full one
    begin = np.flatnonzero((place + width <= counts[text]) | (place == 0))
    length = np.minimum(counts[text[begin]], width)
    h = np.full(len(begin), 0x51ED270B9F1F4C2D, np.uint64)
    for k in range(width):
        there = k < length
        step = w[np.minimum(begin + k, max(len(w) - 1, 0))] if len(w) else np.zeros(0, np.uint64)
        h = np.where(there, mix64(h * np.uint64(0x9E3779B97F4A7C15) + step + np.uint64(k)), h)
    h = mix64(h + length.astype(np.uint64))
    owner = text[begin]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(n_texts + 1))


def _fingerprints(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each sorted set."""
    n = len(at) - 1
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x94D049BB133111EB):
        keyed = mix64(h ^ np.uint64(salt)) * np.uint64(salt | 1)
        total = np.concatenate([[np.uint64(0)], np.cumsum(keyed, dtype=np.uint64)])
        out.append(mix64(total[at[1:]] - total[at[:-1]] + np.arange(n, dtype=np.uint64) * np.uint64(0) + np.diff(at).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        h, at = shingle_sets(batch.column("text"))
        a, b = _fingerprints(h, at)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), pa.array(a), pa.array(b)], names=["doc_id", "n", "fa", "fb"])


def _pack(values: np.ndarray) -> bytes:
    """Ascending values as differences of four bytes, or of eight where one doesn't fit."""
    steps = np.diff(values, prepend=np.uint64(0))
    first, rest = steps[:1], steps[1:]
    small = len(rest) == 0 or int(rest.max()) < 1 << 32
    return (b"4" if small else b"8") + first.tobytes() + rest.astype(np.uint32 if small else np.uint64).tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    if len(blob) < 9:
        return np.zeros(0, np.uint64)
    first = np.frombuffer(blob, np.uint64, 1, 1)
    rest = np.frombuffer(blob, np.uint32 if blob[:1] == b"4" else np.uint64, offset=9)
    return np.cumsum(np.concatenate([first, rest.astype(np.uint64)]), dtype=np.uint64)


def _deal(n_parts: int):
    """Packs the shingles of each batch for every range of hash values: values, place of each one's set, and the sets' numbers and sizes."""
    starts = np.array([(p << 64) // n_parts for p in range(n_parts)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = 0
        for batch in slices(batches):
            h, at = shingle_sets(batch.column("text"))
            number, _ = _fingerprints(h, at)
            n = np.diff(at)
            # a row that isn't the only one of its doc_id or of its set stands for the sets that `keep` names
            stands = np.array([k is None or f in k for k, f in zip(batch.column("keep").to_pylist(), number.tolist())], bool)
            owner = np.repeat(np.arange(len(number)), n)
            good = stands[owner]
            held.append((h[good], number[owner[good]], n[owner[good]]))
            size += int(good.sum())
            if size >= 1 << 20:
                yield _packed(held, starts)
                held, size = [], 0
        if size:
            yield _packed(held, starts)

    return run


PACKED = "part int, values binary, low binary, places binary, numbers binary, sizes binary, hot binary"


def _row(part: int, h: np.ndarray, place: np.ndarray, numbers: np.ndarray, sizes: np.ndarray, hot: np.ndarray) -> tuple:
    """48 bits of the ascending values as differences, the other 16 beside them; numbers once a row."""
    own, mine = np.unique(place, return_inverse=True)
    low = (h & np.uint64(0xFFFF)).astype(np.uint16)
    return part, _pack(h >> _LOW), low.tobytes(), mine.astype(np.uint16 if len(own) < 1 << 16 else np.uint32).tobytes(), numbers[own].tobytes(), sizes[own].tobytes(), hot.tobytes()


def _packed(held: list, starts: np.ndarray) -> pa.RecordBatch:
    h, number, n = (np.concatenate(x) for x in zip(*held))
    numbers, first, place = np.unique(number, return_index=True, return_inverse=True)
    sizes = n[first].astype(np.int32)
    order = np.lexsort((place, h))
    h, place = h[order], place[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (place[1:] != place[:-1])  # of rows that repeat
    h, place = h[new], place[new]
    cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    count = np.diff(np.append(cut, len(h)))
    is_hot = np.repeat(count >= HOT, count)
    hot = h[cut[count >= HOT]]
    rows = []
    # hot shingles go past the ranges, in rows of the sets' own
    if len(hot):
        rows.append(_row(-1 - int(mix64(numbers[:1])[0] % np.uint64(len(starts))), h[is_hot], place[is_hot], numbers, sizes, np.zeros(0, np.uint64)))
    h, place = h[~is_hot], place[~is_hot]
    part, told = np.searchsorted(starts, h, side="right") - 1, np.searchsorted(starts, hot, side="right") - 1
    for p in np.union1d(part, told):
        lo, hi = np.searchsorted(part, (p, p + 1))
        a, b = np.searchsorted(told, (p, p + 1))
        rows.append(_row(int(p), h[lo:hi], place[lo:hi], numbers, sizes, hot[a:b]))
    names = [c.split()[0] for c in PACKED.split(", ")]
    part, *blobs = zip(*rows) if rows else ((), *[()] * 6)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *[pa.array(b, pa.binary()) for b in blobs]], names=names)


def _shared(n_buckets: int):
    """Of one range of hash values: the shingles that several sets have, packed for each bucket of sets."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        hs, ids, ns = [], [], []
        for v, low, places, numbers, sizes in zip(pdf["values"], pdf["low"], pdf["places"], pdf["numbers"], pdf["sizes"]):
            high = _unpack(v)
            place = np.frombuffer(places, np.uint16 if len(places) == 2 * len(high) else np.uint32)
            hs.append((high << _LOW) | np.frombuffer(low, np.uint16))
            ids.append(np.frombuffer(numbers, np.int64)[place])
            ns.append(np.frombuffer(sizes, np.int32)[place])
        h, number, n = np.concatenate(hs), np.concatenate(ids), np.concatenate(ns)
        if pdf["part"].iloc[0] < 0:
            df = np.full(len(h), HOT_DF, np.uint16)
        else:
            order = np.lexsort((number, h))
            h, number, n = h[order], number[order], n[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (number[1:] != number[:-1])
            h, number, n = h[new], number[new], n[new]
            cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            df = np.diff(np.append(cut, len(h)))
            # frequencies only make an order, in which the most frequent shingles may be equal
            df = np.repeat(np.minimum(df, HOT_DF), df)
            df[np.isin(h, np.unique(np.frombuffer(b"".join(pdf["hot"]), np.uint64)))] = HOT_DF
            many = df >= 2
            h, number, n, df = h[many], number[many], n[many], df[many].astype(np.uint16)
        bucket = (mix64(number.view(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)
        order = np.lexsort((number, bucket))
        h, number, n, df, bucket = h[order], number[order], n[order], df[order], bucket[order]
        rows = []
        edge = np.flatnonzero(np.diff(bucket, prepend=-1))
        for lo, hi in zip(edge, np.append(edge[1:], len(bucket))):
            first = np.flatnonzero(np.concatenate([[True], number[lo + 1 : hi] != number[lo : hi - 1]]))
            count = np.diff(np.append(first, hi - lo)).astype(np.int32)
            rows.append((bucket[lo], number[lo:hi][first].tobytes(), n[lo:hi][first].tobytes(), count.tobytes(), h[lo:hi].tobytes(), df[lo:hi].tobytes()))
        return pd.DataFrame(rows, columns=["bucket", "numbers", "sizes", "counts", "h", "df"]).astype({"bucket": np.int32})

    return run


def _assemble(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket of sets: those with enough shared shingles to link with anything.

    Columns: shared shingles ascending, their frequencies, bitmap, tokens that share a bit, minimum hashes.
    """
    join = lambda c, kind: np.frombuffer(b"".join(pdf[c]), kind)
    count = join("counts", np.int32)
    number, n = np.repeat(join("numbers", np.int64), count), np.repeat(join("sizes", np.int32), count).astype(np.int64)
    h, df = join("h", np.uint64), join("df", np.uint16).astype(np.uint32)
    order = np.lexsort((df, h, number))
    order = order[np.concatenate([[True], (h[order[1:]] != h[order[:-1]]) | (number[order[1:]] != number[order[:-1]])])]  # of rows that repeat
    number, n, h, df = number[order], n[order], h[order], df[order]
    cut = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    salts = mix64(np.arange(1, STARS + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
    rows = []
    for a, b in zip(cut, np.append(cut[1:], len(number))):
        if b - a >= _least_shared(int(n[a])):
            own = h[a:b]
            bits, extra = bitmap(mix64(own))
            stars = [int(mix64(own ^ s).min().view(np.int64)) for s in salts]
            rows.append((int(number[a]), int(n[a]), b - a, _pack(own), df[a:b].tobytes(), bits.tobytes(), extra, stars))
    return pd.DataFrame(rows, columns=["number", "n", "shared", "h", "df", "bits", "extra", "stars"])


def _least_shared(n: np.ndarray | int, num: int = NUM, den: int = DEN):
    """ceil(num / den * n)."""
    return -(-num * n // den)


def _first_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(number, key) for the shared shingles, rarest first, of which linked sets must have one in common."""
    for batch in batches:
        numbers, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for number, n, blob, counts in zip(*(batch.column(c).to_pylist() for c in ("number", "n", "h", "df"))):
            h, df = _unpack(blob), np.frombuffer(counts, np.uint32)
            order = np.lexsort((h, df))[: len(h) - _least_shared(n) + 1]
            keys.append(h[order].view(np.int64))
            numbers.append(np.full(len(order), number, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(numbers)), pa.array(np.concatenate(keys))], names=["number", "key"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        na, nb = batch.column("na").to_pylist(), batch.column("nb").to_pylist()
        for i, (x, y) in enumerate(zip(batch.column("ha").to_pylist(), batch.column("hb").to_pylist())):
            both = len(np.intersect1d(_unpack(x), _unpack(y), assume_unique=True))
            if DEN * both >= NUM * (na[i] + nb[i] - both):
                good.append(i)
        yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those whose sets link. A set with many pairs is dealt to a task for each PAIRS of them."""
    tasks = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("tasks"))
    one = sets.select(F.col("number").alias("a"), F.col("n").alias("na"), F.col("h").alias("ha")).join(tasks, "a")
    one = one.withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")
    two = sets.select(F.col("number").alias("b"), F.col("n").alias("nb"), F.col("h").alias("hb"))
    dealt = pairs.join(tasks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("tasks")).cast("int").alias("task"))
    both = dealt.join(two, "b").join(one, ["a", "task"]).where(f"{DEN} * na >= {NUM} * nb AND {DEN} * nb >= {NUM} * na")
    return both.select("a", "b", "na", "nb", "ha", "hb").mapInArrow(_verify, "a long, b long")


#: Sides of a task: 0 is a tree to be traversed with itself and with 1, 2 a tree to be traversed with 3 only.
SIDES = ((0, 0), (0, 1), (2, 3))
MEMBER = "key long, i int, j int, side int, number long, comp long, n long, extra int, bits binary"


def candidates(rows: dict[str, np.ndarray], seen=None) -> np.ndarray:
    """Pairs of numbers (2, k) that the traversal of all tasks' trees doesn't rule out. rows: as MEMBER, those of a task together."""
    task = np.stack([rows["key"], rows["i"].astype(np.int64), rows["j"].astype(np.int64)])
    new = np.ones(task.shape[1], bool)
    new[1:] = (task[:, 1:] != task[:, :-1]).any(axis=0)
    place = (np.cumsum(new) - 1) * 4 + rows["side"]
    trees, tree = np.unique(place, return_inverse=True)
    forest = Forest(tree, rows["bits"], rows["n"].astype(np.int64), rows["extra"].astype(np.int64), rows["comp"])
    known = {int(t): i for i, t in enumerate(trees)}
    pairs = [(i, known[t - t % 4 + y]) for t, i in known.items() for x, y in SIDES if t % 4 == x and t - t % 4 + y in known]
    found = [np.zeros((2, 0), np.int64)]
    for i, j in linked_leaves(forest, pairs, NUM, DEN, seen=seen) if pairs else ():
        a, b = rows["number"][i], rows["number"][j]
        found.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1))
    return np.unique(np.concatenate(found, axis=1), axis=1)


def _tree_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of all tasks of a partition, whose rows come sorted by task."""
    held: list[pa.RecordBatch] = []

    def flush(whole: pa.Table) -> pa.RecordBatch:
        rows = {c: whole.column(c).to_numpy() for c in ("key", "i", "j", "side", "number", "comp", "n", "extra")}
        rows["bits"] = np.frombuffer(b"".join(whole.column("bits").to_pylist()), np.uint64).reshape(len(whole), -1)
        pairs = candidates(rows)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    n = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        n += len(batch)
        if n >= 1 << 15:
            whole = pa.Table.from_batches(held)
            same = np.ones(len(whole), bool)
            for c in ("key", "i", "j"):
                same &= whole.column(c).to_numpy() == whole.column(c)[-1].as_py()
            done = len(whole) - int(same.sum())  # the last task may go on in the next batch
            if done:
                yield flush(whole.slice(0, done))
            held = whole.slice(done).combine_chunks().to_batches()
            n = len(whole) - done
    if n:
        yield flush(pa.Table.from_batches(held))


def _traversed(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Candidates (a, b) of tasks (key, i, j, side, number, comp)."""
    rows = members.join(sets.select("number", "n", "extra", "bits"), "number").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.select(*[c.split()[0] for c in MEMBER.split(", ")]).mapInArrow(_tree_pairs, "a long, b long").distinct()


def _led_members(rows: DataFrame, order: Column) -> DataFrame:
    """Tasks of rows (key, number, comp): the trees of sets of a key whose sets aren't all of one component, and their first by `order` as a tree of its own."""
    groups = rows.groupBy("key").agg(F.min(F.struct(order.alias("order"), "number", "comp")).alias("first"), F.count("*").alias("m"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    groups = groups.where("low < high").select("key", "first", F.ceil(F.col("m") / CHUNK).cast("int").alias("chunks"))
    column = lambda c: F.lit(c).cast("int")
    rest = rows.join(groups, "key").where("comp <> first.comp").select("key", column(0).alias("i"), F.pmod(F.xxhash64("number"), F.col("chunks")).cast("int").alias("j"), column(3).alias("side"), "number", "comp")
    first = groups.select("key", column(0).alias("i"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("j"), column(2).alias("side"), "first.number", "first.comp")
    return rest.unionByName(first)


def _star_members(sets: DataFrame) -> DataFrame:
    """Tasks of the first round: the trees of sets with an equal minimum hash, and their least set."""
    stars = sets.select("number", F.posexplode("stars").alias("k", "star")).select(F.xxhash64("k", "star").alias("key"), "number", F.col("number").alias("comp"))
    return _led_members(stars, F.col("number"))


def _labelled(keys: DataFrame, comps: DataFrame) -> DataFrame:
    """(key, number, comp) of keys (key, number)."""
    return keys.join(comps, "number", "left").select("key", "number", F.coalesce("comp", "number").alias("comp"))


def _meeting(keys: DataFrame, comps: DataFrame) -> DataFrame:
    """The keys (key, number) in which several components meet."""
    rows = _labelled(keys, comps)
    return rows.join(rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key"), "key").select("key", "number")


def _prefix_members(keys: DataFrame, comps: DataFrame) -> DataFrame:
    """Tasks of the last round: the trees of sets that share one of their first shingles and aren't all of one component.

    The component that is largest there is not compared with itself, so its sets are dealt in chunks of their own. Task
    (i, j) with j < ko compares chunks i <= j of the others, one with j >= ko chunk i of the others with chunk j - ko of it.
    """
    labelled = _labelled(keys, comps)
    per = labelled.groupBy("key", "comp").agg(F.count("*").alias("k"))
    met = per.groupBy("key").agg(F.sum("k").alias("m"), F.count("*").alias("n_comps"), F.max(F.struct("k", "comp")).alias("top")).where("n_comps > 1")
    met = met.select("key", "m", F.col("top")["comp"].alias("main"), F.when(F.col("top")["k"] > 1, F.col("top")["k"]).otherwise(0).alias("n_main"))
    rows = labelled.join(met, "key").withColumn("is_main", (F.col("comp") == F.col("main")) & (F.col("n_main") > 1))
    chunks = lambda n: F.greatest(F.ceil(n / CHUNK), F.lit(1)).cast("int")
    rows = rows.withColumn("ko", chunks(F.col("m") - F.col("n_main"))).withColumn("km", chunks(F.col("n_main")))
    spot = F.pmod(F.xxhash64("number", "key"), F.when(F.col("is_main"), F.col("km")).otherwise(F.col("ko"))).cast("int")
    rows = rows.withColumn("spot", spot)
    task = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).cast("int").alias("side"))
    others = lambda n: F.sequence(F.lit(0), n - 1)
    upto = F.transform(others(F.col("ko")), lambda o: F.when(o == F.col("spot"), task(o, o, 0)).when(o > F.col("spot"), task(F.col("spot"), o, 2)).otherwise(task(o, F.col("spot"), 3)))
    across = F.when(F.col("n_main") > 1, F.transform(others(F.col("km")), lambda c: task(F.col("spot"), c + F.col("ko"), 2))).otherwise(F.array().cast("array<struct<i:int,j:int,side:int>>"))
    main = F.transform(others(F.col("ko")), lambda o: task(o, F.col("spot") + F.col("ko"), 3))
    return rows.withColumn("t", F.explode(F.when(F.col("is_main"), main).otherwise(F.concat(upto, across)))).select("key", "number", "comp", "t.*")


def _ends(links: DataFrame, comps: DataFrame) -> DataFrame:
    """(a, b) with the components of both, a set without one being its own."""
    label = lambda c: comps.select(F.col("number").alias(c), F.col("comp").alias(f"comp_{c}"))
    both = links.join(label("a"), "a", "left").join(label("b"), "b", "left")
    return both.select("a", "b", F.coalesce("comp_a", "a").alias("comp_a"), F.coalesce("comp_b", "b").alias("comp_b"))


def _merged(comps: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(number, comp) after more links. Only links between components are looked at, each pair of components once, so what is linked already costs nothing again."""
    ends = scratch.write(_ends(links, comps), f"{name}-ends")
    over = components(ends.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")), scratch, name)
    new = ends.select(F.col("a").alias("number")).unionByName(ends.select(F.col("b").alias("number"))).distinct().join(comps, "number", "left_anti")
    all_of = comps.unionByName(new.select("number", F.col("number").alias("comp")))
    return scratch.write(all_of.join(over.withColumnRenamed("comp", "least"), F.col("comp") == F.col("id"), "left").select("number", F.coalesce("least", "comp").alias("comp")), f"{name}-comps")


def _classes(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, fa, fb) of every row, and (fa, fb, rep, n, copies) of every distinct non-empty set."""
    sizes = scratch.write(docs.mapInArrow(_sizes, "doc_id long, n long, fa long, fb long"), "sizes")
    some = sizes.where("n > 0 AND doc_id IS NOT NULL")
    return sizes, scratch.write(some.groupBy("fa", "fb").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.count("*").alias("copies")), "classes")


def _representatives(docs: DataFrame, sizes: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """docs with `keep`, the sets that a row may stand for, null where it may for its own.

    Only exceptional doc_ids are named: those of copies of other documents, and those that come with several texts.
    """
    crowded = classes.where("copies > 1").select("fa", "fb", "rep")
    copies = sizes.where("n > 0 AND doc_id IS NOT NULL").join(crowded, ["fa", "fb"]).where("doc_id <> rep").select("doc_id").distinct()
    reps = classes.groupBy(F.col("rep").alias("doc_id")).agg(F.collect_set("fa").alias("keep"))
    odd = copies.join(reps, "doc_id", "left").unionByName(reps.where("size(keep) > 1")).groupBy("doc_id").agg(F.first("keep", True).alias("keep"))
    odd = scratch.write(odd.select("doc_id", F.coalesce("keep", F.array().cast("array<long>")).alias("keep")), "odd")
    size = odd.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("keep")), F.lit(0)).alias("k")).first()
    return docs.where("doc_id IS NOT NULL").join(small(odd, 1, 64 * size["n"] + 16 * size["k"]), "doc_id", "left").select("doc_id", "text", "keep")


def link(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sizes of all rows, classes of equal sets, and (number, comp) of the sets that link with others. docs: (doc_id long, text)."""
    spark: SparkSession = docs.sparkSession
    sizes, classes = _classes(docs, scratch)
    total = classes.agg(F.sum("n")).first()[0] or 0
    parts = n_partitions(spark, total, 1 << 20)
    dealt = _representatives(docs, sizes, classes, scratch).mapInArrow(_deal(parts), PACKED)
    shared = dealt.groupBy("part").applyInPandas(_shared(parts), "bucket int, numbers binary, sizes binary, counts binary, h binary, df binary")
    sets = shared.groupBy("bucket").applyInPandas(_assemble, "number long, n long, shared long, h binary, df binary, bits binary, extra int, stars array<long>")
    sets = scratch.write(sets, "sets")
    near = scratch.write(_traversed(_star_members(sets), sets), "near")
    comps = components(scratch.write(verified(near, sets), "stars"), scratch, "stars").select(F.col("id").alias("number"), "comp")
    keys = sets.select("number", "n", "h", "df").mapInArrow(_first_shingles, "number long, key long")
    keys = scratch.write(_meeting(keys, comps), "keys")
    for turn in range(TURNS):
        # a group's trees have one leader at first, so that a pair a set links most of it; what is left meets another leader in each tree
        order = F.xxhash64("number", *[F.col("key"), F.lit(turn)][: 2 * turn])
        led = scratch.write(_traversed(_led_members(_labelled(keys, comps), order), sets), f"near-{turn}")
        found = scratch.write(verified(led, sets), f"led-{turn}")
        if found.isEmpty():
            break
        comps = _merged(comps, found, scratch, f"merged-{turn}")
    more = scratch.write(_traversed(_prefix_members(keys, comps), sets), "meetings")
    # one candidate of each set first: most of the others are of one component then, and say nothing
    first = more.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").unionByName(more.groupBy("a").agg(F.max("b").alias("b")).select("a", "b")).distinct()
    comps = _merged(comps, scratch.write(verified(first, sets), "first"), scratch, "merged-first")
    rest = _ends(more, comps).where("comp_a <> comp_b").select("a", "b")
    linked = _merged(comps, scratch.write(verified(rest, sets), "rest"), scratch, "merged-rest")
    scratch.drop("sets", "near", "keys", "meetings")
    return sizes, classes, linked


def _components(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, n, fa, fb, component_id) of every row."""
    sizes, classes, linked = link(docs, scratch)
    # only sets with several documents or with links have a component other than their own document
    placed = classes.select("fa", "fb", "rep", "copies").join(linked.withColumnRenamed("number", "fa"), "fa", "left")
    least = placed.where("comp IS NOT NULL").groupBy("comp").agg(F.min("rep").alias("least"))
    named = placed.where("copies > 1 OR comp IS NOT NULL").join(least, "comp", "left").select("fa", "fb", F.coalesce("least", "rep").alias("comp"))
    found = sizes.join(small(scratch.write(named, "named"), 64), ["fa", "fb"], "left")
    own = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return found.select("doc_id", "n", "fa", "fb", F.when(own, F.coalesce("comp", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def join_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return _components(rows, Scratch(docs.sparkSession, "ngram")).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs of which each component keeps one: the text of its smallest doc_id, of several such the one with the least fingerprint.

    Rows without words and rows without a doc_id stay. A doc_id that comes once is judged by itself; rows of one that comes
    more often are judged by their texts.
    """
    scratch = Scratch(docs.sparkSession, "unique")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = scratch.write(_components(rows, scratch), "found")
    per = scratch.write(found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows"), F.bool_or(F.col("component_id") < F.col("doc_id")).alias("gone")).where("rows > 1 OR gone"), "judged")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"))
    judged = packed.join(small(per.select(F.col("doc_id").alias("_id"), "rows", "gone"), 32), "_id", "left")
    alone = judged.where("rows IS NULL OR rows = 1 AND NOT gone").select("_row.*")
    again = per.where("rows > 1").select(F.col("doc_id").alias("_id"))
    if again.isEmpty():
        return alone
    several = judged.where("rows > 1").select("_row", "_id", _fingerprint(F.col("_text")).alias("f"))
    chosen = found.where("n > 0 AND component_id = doc_id").join(again, F.col("doc_id") == F.col("_id"), "left_semi").groupBy("component_id").agg(F.min(F.struct("fa", "fb")).alias("f"))
    first = F.row_number().over(Window.partitionBy("_id", "f.fa", "f.fb").orderBy(F.xxhash64("_row"), F.to_json("_row")))
    kept = several.where("f.n > 0").join(chosen.select(F.col("component_id").alias("_id"), F.col("f").alias("best")), "_id").where("f.fa = best.fa AND f.fb = best.fb").withColumn("_first", first).where("_first = 1")
    return alone.unionByName(kept.select("_row.*")).unionByName(several.where("f.n = 0").select("_row.*"))


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("fa", "fb", "n")]))
def _fingerprint(texts: pd.Series) -> pd.DataFrame:
    out = [next(_sizes(iter([pa.RecordBatch.from_arrays([pa.array([0]), pa.array([t], pa.string())], names=["doc_id", "text"])]))) for t in texts]
    return pd.DataFrame({c: [b.column(c)[0].as_py() for b in out] for c in ("fa", "fb", "n")})


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
f AS MATERIALIZED (SELECT g.doc_id, g.g FROM g JOIN (SELECT g FROM g GROUP BY g HAVING count(*) > 1) USING (g)),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM f a JOIN f b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r(id, c) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT l.a, r.c FROM r JOIN l ON l.b = r.id WHERE r.c < l.a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(c) FROM r WHERE r.id = d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""
