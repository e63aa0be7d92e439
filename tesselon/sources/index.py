"""An index on storage: segments of documents and postings, tombstones, and a pointer a version.

Layout: <path>/seg-<n>/docs and, per text field, <path>/seg-<n>/postings_<field>; <path>/gone-<n> holds the doc_ids that a
version replaces or deletes; <path>/versions/<n>.json names the segments and tombstones of a version. A version is its
pointer, which is written last under a name of its own and renamed into place: a write that fails leaves the last
version as it was, and a reader keeps the one it has begun with. A commit writes its own documents only, and of the old
ones reads no more than their keys.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesselon.functions.analysis import custom
from tesselon.operators.retrieval import Corpus, Inverted, lengths, once, postings
from tesselon.plans.schema import Field, Schema, SchemaError


def read_jsonl(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """One document a line; a line that isn't one stops the read."""
    return spark.read.schema(f"`{schema.key}` string, {schema.ddl()}").option("mode", "FAILFAST").json(path)


def last_wins(docs: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the last by `order`; a running maximum, so reduced map-side."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.groupBy(key).agg(F.max_by(rest, F.col(order)).alias("_r")).select("_r.*")


def upsert(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """`new` in place of rows of `old` with the same key, the last of its own repeats."""
    new = last_wins(new, key, order) if order else new
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return docs.join(gone.select(key).distinct(), key, "left_anti")


def export_jsonl(docs: DataFrame, path: str, key: str) -> None:
    """Lines in ascending order of the key: range-partitioned, sorted within."""
    docs.orderBy(key).write.mode("overwrite").json(path)


def write_postings(rows: DataFrame, path: str) -> None:
    """Postings written where their documents are read, as the runs sorted by term that they come in: nothing is shuffled or sorted
    again, no term's rows meet in one task, and a look-up passes over most pages and row groups by their statistics and Bloom filters."""
    rows.write.mode("overwrite").option("parquet.bloom.filter.enabled#term", "true").parquet(path)


def invert(corpus: Corpus, path: str) -> Corpus:
    """The corpus with an inverted index of its text fields, written to path: for a table that has its doc_ids and stays as it is."""
    spark = corpus.docs.sparkSession
    slots = 2 * spark.sparkContext.defaultParallelism
    docs = corpus.docs
    if docs.rdd.getNumPartitions() < slots:  # a small table in few files
        docs = docs.repartition(slots)
    once(docs, **lengths(corpus)).select(F.col(corpus.doc_id), *lengths(corpus)).write.mode("overwrite").parquet(f"{path}/lengths")
    spread = Corpus(docs, corpus.schema, corpus.analyzers, corpus.doc_id)
    for f in corpus.schema.of_type("text"):
        write_postings(postings(spread, f.name), f"{path}/postings_{f.name}")
    return inverted(corpus, path)


def inverted(corpus: Corpus, path: str) -> Corpus:
    """The corpus with the index that `invert` wrote."""
    read = corpus.docs.sparkSession.read
    held = Inverted({f.name: read.parquet(f"{path}/postings_{f.name}") for f in corpus.schema.of_type("text")}, read.parquet(f"{path}/lengths"))
    return Corpus(corpus.docs, corpus.schema, corpus.analyzers, corpus.doc_id, held)


def check_vectors(docs: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """docs, whose vectors have their field's length, finite numbers only and, where cosines are to be taken, a direction; another one stops the job."""
    for f in fields:
        v = F.col(f.name)
        odd = (F.size(v) != f.dims) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        if f.metric == "cosine":
            odd = odd | F.forall(v, lambda x: x == 0)
        docs = docs.withColumn(f.name, F.when(F.coalesce(odd, F.lit(False)), F.raise_error(F.lit(f"{f.name}: not a vector of {f.dims} finite numbers")).cast(docs.schema[f.name].dataType)).otherwise(v))
    return docs


class TextIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: Schema, analyzers: dict[str, dict] | None = None) -> TextIndex:
        """analyzers: configurations of the index's own analyzers, by the names that its fields use."""
        index = cls(spark, path)
        index._put(0, {"schema": schema.to_json(), "analyzers": analyzers or {}, "segments": [], "gone": [], "columns": None, "next": 1})
        return index

    # pointers

    def _files(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _put(self, version: int, state: dict) -> None:
        folder, fs = self._files()
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        draft, final = path(folder, f".{version}.json"), path(folder, f"{version}.json")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError(f"version {version} of {self.path} is there already: another writer was first")

    def versions(self) -> list[int]:
        folder, fs = self._files()
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    @property
    def version(self) -> int:
        return self.versions()[-1]

    def state(self, version: int | None = None) -> dict:
        v = self.version if version is None else version
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/versions/{v}.json", wholetext=True).collect()))

    @property
    def schema(self) -> Schema:
        return Schema.from_json(self.state()["schema"])

    def add_fields(self, fields: Sequence[Field]) -> None:
        v, state = self.version, self.state()
        self._put(v + 1, {**state, "schema": Schema.from_json(state["schema"]).extended(fields).to_json()})

    def put_analyzer(self, name: str, config: dict) -> None:
        """Adds an analyzer; one that is there can't change, as documents may have been indexed by it."""
        v, state = self.version, self.state()
        custom(config)
        if state["analyzers"].get(name, config) != config:
            raise SchemaError(f"analyzer {name!r} is frozen")
        self._put(v + 1, {**state, "analyzers": {**state["analyzers"], name: config}})

    # readers

    def _live(self, rows: DataFrame, state: dict) -> DataFrame:
        if not state["gone"]:
            return rows
        return rows.join(self.spark.read.schema("doc_id long").parquet(*[f"{self.path}/{g}" for g in state["gone"]]), "doc_id", "left_anti")

    def _docs(self, state: dict) -> DataFrame | None:
        if not state["segments"]:
            return None
        schema = T.StructType.fromJson(json.loads(state["columns"]))
        return self._live(self.spark.read.schema(schema).parquet(*[f"{self.path}/{s}/docs" for s in state["segments"]]), state)

    def docs(self, version: int | None = None) -> DataFrame | None:
        """The documents with doc_id, as they were given."""
        docs = self._docs(self.state(version))
        return docs if docs is None else docs.drop(*[c for c in docs.columns if c.startswith("_len_")])

    def postings(self, field: str, version: int | None = None) -> DataFrame:
        return self._postings(field, self.state(version))

    def _postings(self, field: str, state: dict) -> DataFrame:
        schema = "term string, doc_id long, tf int, places array<int>, length int"
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/{s}/postings_{field}" for s in state["segments"] if field in state["fields"][s]])
        return self._live(rows, state)

    def corpus(self, version: int | None = None) -> Corpus:
        """The version as conditions read it: documents, inverted index and analyzers."""
        state = self.state(version)
        schema = Schema.from_json(state["schema"])
        stored = self._docs(state)
        names = [f.name for f in schema.of_type("text") if any(f.name in state["fields"][s] for s in state["segments"])]
        inverted = Inverted({n: self._postings(n, state) for n in names}, stored.select("doc_id", *[f"_len_{n}" for n in names]))
        docs = stored.drop(*[f"_len_{n}" for n in names])
        return Corpus(docs, schema, {n: custom(c) for n, c in state["analyzers"].items()}, inverted=inverted)

    # writers

    def _segment(self, version: int, numbered_docs: DataFrame, state: dict, rows_of=None) -> str:
        """Writes a segment; postings come from the texts, or of each field from rows_of."""
        schema = Schema.from_json(state["schema"])
        analyzers = {n: custom(c) for n, c in state["analyzers"].items()}
        name, texts = f"seg-{version}", [f.name for f in schema.of_type("text") if f.name in numbered_docs.columns]
        sized = numbered_docs
        if rows_of is None:
            known = Schema(tuple(f for f in schema.fields if f.type != "text" or f.name in texts), schema.key)
            sized = once(numbered_docs, **lengths(Corpus(numbered_docs, known, analyzers))) if texts else numbered_docs
        sized.write.mode("overwrite").parquet(f"{self.path}/{name}/docs")
        stored = self.spark.read.schema(sized.schema).parquet(f"{self.path}/{name}/docs")
        for field in texts:
            rows = rows_of(field) if rows_of else postings(Corpus(stored, schema, analyzers), field)
            write_postings(rows, f"{self.path}/{name}/postings_{field}")
        state["fields"] = {**state.get("fields", {}), name: texts}
        return name

    def index(self, batch: DataFrame, order: str | None = None) -> int:
        """Adds documents; a key that is there already is replaced, and of repeats in the batch the last stays: by `order`, or without it by the batch's own order of rows.

        doc_id numbers follow on from the greatest one, in the order of the keys, so the same input gives the same numbers.
        """
        v, state = self.version + 1, self.state()
        schema = Schema.from_json(state["schema"])
        key = schema.key
        if order is None:
            batch = last_wins(batch.withColumn("_place", F.monotonically_increasing_id()), key, "_place").drop("_place")
        else:
            batch = last_wins(batch, key, order)
        batch = check_vectors(batch, [f for f in schema.of_type("dense_vector") if f.name in batch.columns])
        new, n = numbered(batch, key, f"{self.path}/seg-{v}/stage", state["next"] - 1)
        old = self._docs(state)
        if old is not None:
            old.select("doc_id", key).join(new.select(key), key, "left_semi").select("doc_id").write.mode("overwrite").parquet(f"{self.path}/gone-{v}")
            state["gone"] = [*state["gone"], f"gone-{v}"]
        state["segments"] = [*state["segments"], self._segment(v, new, state)]
        self._remove(f"seg-{v}/stage")
        stored = self.spark.read.parquet(f"{self.path}/seg-{v}/docs").schema
        known = T.StructType.fromJson(json.loads(state["columns"])) if state["columns"] else T.StructType()
        names = set(known.fieldNames())
        state["columns"] = T.StructType([*known.fields, *[f for f in stored.fields if f.name not in names]]).json()
        state["next"] += n
        self._put(v, state)
        return v

    def delete(self, keys: DataFrame) -> int:
        v, state = self.version + 1, self.state()
        key = Schema.from_json(state["schema"]).key
        self._docs(state).select("doc_id", key).join(keys.select(key).distinct(), key, "left_semi").select("doc_id").write.mode("overwrite").parquet(f"{self.path}/gone-{v}")
        self._put(v, {**state, "gone": [*state["gone"], f"gone-{v}"]})
        return v

    def compact(self, files: int) -> int:
        """The live documents and postings as one segment; texts aren't analysed again."""
        v, state = self.version + 1, self.state()
        new = {**state, "gone": [], "fields": {}}
        new["segments"] = [self._segment(v, self._docs(state).coalesce(files), new, lambda f: self._postings(f, state).coalesce(files).sortWithinPartitions("term", "doc_id"))]
        self._put(v, new)
        return v

    def repair(self) -> int:
        """Postings built anew from the documents."""
        v, state = self.version + 1, self.state()
        new = {**state, "gone": [], "fields": {}}
        docs = self._docs(state)
        new["segments"] = [self._segment(v, docs.drop(*[c for c in docs.columns if c.startswith("_len_")]), new)]
        self._put(v, new)
        return v

    def _remove(self, name: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def vacuum(self, keep: int = 1) -> None:
        """Removes all versions but the last `keep`, and what only they named."""
        every = self.versions()
        kept = [self.state(v) for v in every[-keep:]]
        needed = {n for s in kept for n in (*s["segments"], *s["gone"])}
        for v in every[:-keep]:
            state = self.state(v)
            self._remove(f"versions/{v}.json")
            for name in (*state["segments"], *state["gone"]):
                if name not in needed:
                    self._remove(name)

    # reports

    def get(self, key: str) -> DataFrame:
        return self.docs().where(F.col(self.schema.key) == F.lit(key))

    def get_by_id(self, doc_id: int) -> DataFrame:
        return self.docs().where(F.col("doc_id") == F.lit(doc_id))

    def export(self, path: str) -> None:
        export_jsonl(self.docs().drop("doc_id"), path, self.schema.key)

    def stats(self) -> DataFrame:
        """One row a text field: documents having it, distinct terms, postings, tokens."""
        out = None
        for f in self.schema.of_type("text"):
            p = self.postings(f.name).agg(F.count_distinct("doc_id").alias("docs"), F.count_distinct("term").alias("terms"), F.count("*").alias("postings"), F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens"))
            p = p.withColumn("field", F.lit(f.name))
            out = p if out is None else out.unionByName(p)
        return out

    def segments(self) -> DataFrame:
        """(segment, field, live_docs, deleted_docs, terms, postings) of every segment and text field."""
        state, out = self.state(), None
        for s in state["segments"]:
            alone = {**state, "segments": [s]}
            every = self.spark.read.parquet(f"{self.path}/{s}/docs").agg(F.count("*").alias("n"))
            live = self._docs(alone).agg(F.count("*").alias("live_docs"))
            for f in state["fields"][s]:
                p = self._postings(f, alone).agg(F.count_distinct("term").alias("terms"), F.count("*").alias("postings"))
                row = live.crossJoin(every).crossJoin(p).select(F.lit(s).alias("segment"), F.lit(f).alias("field"), "live_docs", (F.col("n") - F.col("live_docs")).alias("deleted_docs"), "terms", "postings")  # one row each
                out = row if out is None else out.unionByName(row)
        return out

    def verify(self) -> DataFrame:
        """Rows of (field, problem, n): postings without a document and documents whose tokens the postings don't have. Empty if all is well."""
        out, docs = None, self._docs(self.state())
        for f in self.schema.of_type("text"):
            p = self.postings(f.name)
            orphans = p.join(docs.select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit(f.name).alias("field"), F.lit("orphan posting").alias("problem"), "n")
            have = p.groupBy("doc_id").agg(F.sum("tf").alias("have"))
            lost = docs.select("doc_id", F.coalesce(F.col(f"_len_{f.name}"), F.lit(0)).alias("want")).join(have, "doc_id", "left").where("want <> coalesce(have, 0)")
            lost = lost.agg(F.count("*").alias("n")).select(F.lit(f.name).alias("field"), F.lit("lost tokens").alias("problem"), "n")
            both = orphans.unionByName(lost)
            out = both if out is None else out.unionByName(both)
        return out.where("n > 0")


def numbered(rows: DataFrame, key: str, path: str, start: int = 0) -> tuple[DataFrame, int]:
    """rows with doc_id, start + 1 and on in the order of the key, and how many they are.

    The rows are written to path in ranges of the key, so that their division is fixed before the ranges are counted; no task orders all rows.
    """
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    ranged.write.mode("overwrite").parquet(path)
    parts = spark.read.schema(ranged.schema).parquet(path)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_size"))
    w = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    before = sizes.select("_part", F.coalesce(F.sum("_size").over(w), F.lit(0)).alias("_before"))
    out = parts.join(before, "_part").withColumn("doc_id", F.col("_before") + F.col("_in") + 1 + start)
    return out.drop("_part", "_in", "_before"), parts.count()
