"""Indexes: segments of Parquet under versioned snapshots, a writer, and readers pinned to a snapshot.

A segment is marked as staged in storage before its data is written, and until the commit that publishes it is done; so
garbage collection, by whatever handle, leaves it alone. It also leaves alone what an open reader of this process has.
"""

from __future__ import annotations

import logging
import uuid
import weakref
from collections import defaultdict
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarry.functions.analysis import REGISTRY, Registry
from quarry.operators.collectors import Collector, TopScore
from quarry.plans.compile import compile_query
from quarry.plans.query import Parser, Query
from quarry.shared import spread
from quarry.sources import postings as P
from quarry.sources.merge_policy import MergePolicy, Segment, SizeTieredPolicy
from quarry.sources.schema import IndexSchema, SchemaError
from quarry.sources.storage import MemoryFiles, Storage

log = logging.getLogger("quarry")

#: Open readers by the root of their index.
_READERS: dict[str, weakref.WeakSet] = defaultdict(weakref.WeakSet)
#: What is added by single documents becomes a segment at so many documents or characters.
BUNDLE_DOCS = 100_000
BUNDLE_SIZE = 3_000_000
_JOINED = 10_000  # documents of a segment, on average, up to which a merge joins the rows of a term
_FORMAT = 2  # of the files; that of segments with a row for each posting was 1, and is not read any more

_SCHEMAS = {
    "postings": "term string, n int, doc_id array<long>, tf array<long>, segment string, field string",
    "terms": "term string, df long, segment string, field string",
    "docs": "doc_id long, segment string",
}


@dataclass(frozen=True)
class Meta:
    """A snapshot."""

    version: int
    opstamp: int
    schema: IndexSchema
    segments: tuple[Segment, ...] = ()
    streams: dict[str, int] = field(default_factory=dict)

    @property
    def num_docs(self) -> int:
        return sum(s.num_docs for s in self.segments)

    def to_json(self) -> dict:
        return {
            "format": _FORMAT,
            "version": self.version,
            "opstamp": self.opstamp,
            "schema": self.schema.to_json(),
            "segments": [{"id": s.id, "num_docs": s.num_docs, "opstamp": s.opstamp} for s in self.segments],
            "num_docs": self.num_docs,
            "streams": self.streams,
        }

    @classmethod
    def from_json(cls, d: dict) -> Meta:
        if d.get("format") != _FORMAT:
            raise ValueError("the index is of another format; it must be built again")
        segments = tuple(Segment(s["id"], s["num_docs"], s["opstamp"]) for s in d["segments"])
        return cls(d["version"], d["opstamp"], IndexSchema.from_json(d["schema"]), segments, d.get("streams", {}))


class _Files:
    """Segments as folders: postings/segment=<id>/field=<name> (packed), terms likewise, docs/segment=<id>."""

    def __init__(self, spark: SparkSession, storage: Storage):
        self.spark, self.storage = spark, storage

    def _write(self, rows: DataFrame, table: str, segments: list[str], *by: str) -> None:
        """``rows`` in order of (segment, *by). One segment is written to its own folder, several are in one pass."""
        if len(segments) == 1:
            writer, path = rows.drop("segment").write.partitionBy(*by), f"{table}/segment={segments[0]}"
        else:
            writer, path = rows.write.mode("append").partitionBy("segment", *by), table
        writer.option("parquet.bloom.filter.enabled#term", "true").parquet(self.storage.path(path))

    def put(self, segments: list[str], postings: DataFrame, docs: DataFrame) -> dict[str, int]:
        """``postings`` packed, ``part`` being the place of their segment; ``docs`` likewise. How many documents each has.

        Postings are sorted within tasks only, and analyzed once: each file has its documents' terms in order, of which a
        query reads the pages with its own."""
        named = F.array(*map(F.lit, segments))[F.col("part")].alias("segment")
        rows = postings.select("term", "n", "doc_id", "tf", named, "field").sortWithinPartitions("segment", "field", "term")
        self._write(rows, "postings", segments, "field")
        self._write(docs.select("doc_id", named).sortWithinPartitions("segment"), "docs", segments)
        stats = P.packed_stats(self.packed(segments), "segment")
        self._write(stats.sortWithinPartitions("segment", "field", "term"), "terms", segments, "field")
        found = self.get("docs", segments).groupBy("segment").count().collect()
        return dict.fromkeys(segments, 0) | {r["segment"]: r["count"] for r in found}

    def merge(self, segment: str, ids: list[str], num_docs: int) -> int:
        """Segments as a new one, in fewer files, each in order. Small segments have short rows, which are brought together
        by term and joined; those of larger ones stay as they are, and are not shuffled."""
        rows = self.packed(ids).select(F.lit(0).alias("part"), "field", "term", "n", "doc_id", "tf")
        if num_docs < _JOINED * len(ids):
            rows = P.joined(rows.repartitionByRange("field", "term"))
        rows = rows.select("term", "n", "doc_id", "tf", F.lit(segment).alias("segment"), "field").sortWithinPartitions("field", "term")
        self._write(rows, "postings", [segment], "field")
        self._write(self.get("docs", ids).select("doc_id"), "docs", [segment])
        self._write(P.sum_stats(self.get("terms", ids)).sortWithinPartitions("field", "term"), "terms", [segment], "field")
        return self.get("docs", [segment]).count()

    def settle(self, docs: DataFrame, name: str) -> DataFrame:
        """The same rows, whose given ids don't change when they are read again."""
        docs.write.parquet(self.storage.path(f"drafts/docs-{name}"))
        return self.spark.read.schema(docs.schema).parquet(self.storage.path(f"drafts/docs-{name}"))

    def unsettle(self, docs: DataFrame, name: str) -> None:
        self.storage.delete(f"drafts/docs-{name}")

    def close(self) -> None:
        """Files stay."""

    def packed(self, segments: list[str]) -> DataFrame:
        return self._read("postings", segments)

    def get(self, table: str, segments: list[str]) -> DataFrame:
        rows = self._read(table, segments)
        return P.unpacked(rows) if table == "postings" else rows

    def _read(self, table: str, segments: list[str]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], _SCHEMAS[table])
        paths = [self.storage.path(f"{table}/segment={s}") for s in segments]
        # A segment without rows has no folder where it was written beside others.
        paths = [p for s, p in zip(segments, paths, strict=True) if self.storage.exists(f"{table}/segment={s}")]
        if not paths:
            return self.spark.createDataFrame([], _SCHEMAS[table])
        return self.spark.read.schema(_SCHEMAS[table]).option("basePath", self.storage.path(table)).parquet(*paths)

    def present(self) -> set[str]:
        names = [name for table in _SCHEMAS for name in self.storage.list(table)]
        return {name.removeprefix("segment=") for name in names if name.startswith("segment=")}

    def drop(self, segment: str) -> None:
        for table in _SCHEMAS:
            self.storage.delete(f"{table}/segment={segment}")


class _Cached:
    """Segments as cached DataFrames, freed when dropped, or with the index."""

    def __init__(self, spark: SparkSession):
        self.spark, self.segments = spark, {}
        weakref.finalize(self, _Cached._free, self.segments).atexit = False  # the session's end frees them, too

    @staticmethod
    def _free(segments: dict[str, dict[str, DataFrame]]) -> None:
        while segments:
            for df in segments.popitem()[1].values():
                df.unpersist()

    def put(self, segments: list[str], postings: DataFrame, docs: DataFrame) -> dict[str, int]:
        of = lambda df, i: df.where(F.col("part") == i)
        return {s: self._keep(s, of(postings, i), of(docs, i)) for i, s in enumerate(segments)}

    def merge(self, segment: str, ids: list[str], num_docs: int) -> int:
        return self._keep(segment, self.packed(ids), self.get("docs", ids))

    def _keep(self, segment: str, postings: DataFrame, docs: DataFrame) -> int:
        tag = F.lit(segment).alias("segment")
        own = {
            "postings": postings.select("term", "n", "doc_id", "tf", tag, "field").persist(),
            "docs": docs.select("doc_id", tag).persist(),
        }
        own["terms"] = P.packed_stats(own["postings"]).select("term", "df", tag, "field").persist()
        self.segments[segment] = own
        return [own[table].count() for table in ("postings", "terms", "docs")][-1]

    def settle(self, docs: DataFrame, name: str) -> DataFrame:
        return docs.persist()

    def unsettle(self, docs: DataFrame, name: str) -> None:
        docs.unpersist()

    def packed(self, segments: list[str]) -> DataFrame:
        return self._union("postings", segments)

    def get(self, table: str, segments: list[str]) -> DataFrame:
        rows = self._union(table, segments)
        return P.unpacked(rows) if table == "postings" else rows

    def _union(self, table: str, segments: list[str]) -> DataFrame:
        parts = [self.segments[s][table] for s in segments]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], _SCHEMAS[table])

    def present(self) -> set[str]:
        return set(self.segments)

    def drop(self, segment: str) -> None:
        for df in self.segments.pop(segment, {}).values():
            df.unpersist()

    def close(self) -> None:
        self._free(self.segments)


class Index:
    """A handle: the schema and the snapshots of an index."""

    def __init__(self, spark: SparkSession, storage, data, registry: Registry = REGISTRY):
        self.spark, self.storage, self.data, self.registry = spark, storage, data, registry

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: IndexSchema, registry: Registry = REGISTRY) -> Index:
        """A new index; an error where there is one."""
        storage = Storage(spark, path)
        if storage.versions():
            raise FileExistsError(f"there is an index at {path}")
        return cls._started(cls(spark, storage, _Files(spark, storage), registry), schema)

    @classmethod
    def in_memory(cls, spark: SparkSession, schema: IndexSchema, registry: Registry = REGISTRY) -> Index:
        return cls._started(cls(spark, MemoryFiles(), _Cached(spark), registry), schema)

    @classmethod
    def open(cls, spark: SparkSession, path: str, registry: Registry = REGISTRY) -> Index:
        storage = Storage(spark, path)
        storage.load()
        return cls(spark, storage, _Files(spark, storage), registry)

    @classmethod
    def open_or_create(cls, spark: SparkSession, path: str, schema: IndexSchema, registry: Registry = REGISTRY) -> Index:
        """The index at the path, whose stored schema counts, or a new one."""
        exists = bool(Storage(spark, path).versions())
        return cls.open(spark, path, registry) if exists else cls.create(spark, path, schema, registry)

    @staticmethod
    def _started(index: Index, schema: IndexSchema) -> Index:
        index.storage.publish(Meta(0, 0, schema).to_json())
        return index

    def meta(self, version: int | None = None) -> Meta:
        return Meta.from_json(self.storage.load(version))

    @property
    def schema(self) -> IndexSchema:
        return self.meta().schema

    def writer(self, policy: MergePolicy | None = None) -> Writer:
        return Writer(self, SizeTieredPolicy() if policy is None else policy)

    def reader(self, version: int | None = None) -> Reader:
        return Reader(self, version)

    @property
    def readers(self) -> weakref.WeakSet:
        """Open readers of this index in this process, by any handle."""
        return _READERS[self.storage.key]

    def garbage(self, keep_versions: int = 1, abandoned: bool = False) -> list[str]:
        """Segments that none of the last snapshots, no open reader and no writer holds.

        ``abandoned`` counts what is staged as well; only for when no writer runs, to clear up after one that died.
        """
        live = {s.id for v in self.storage.versions()[-keep_versions:] for s in self.meta(v).segments}
        live |= {s.id for reader in self.readers for s in reader.meta.segments}
        return sorted(self.data.present() - live - (set() if abandoned else self.storage.staged()))

    def vacuum(self, keep_versions: int = 1, abandoned: bool = False) -> list[str]:
        """Delete what is garbage, and older snapshots' files. Readers of other processes that are pinned to those
        snapshots end here."""
        gone = self.garbage(keep_versions, abandoned)
        for segment in gone:
            self.data.drop(segment)
            self.storage.unstage(segment)
        for version in self.storage.versions()[:-keep_versions]:
            self.storage.delete(f"v{version}.json")
        log.info("vacuum removed %d segments", len(gone))
        return gone

    def close(self) -> None:
        """Free what is cached; an index in memory is empty from then on."""
        self.data.close()


@dataclass(frozen=True)
class Added:
    """What ``Writer.add`` did. The segment is there, but no reader sees it before the commit."""

    opstamp: int
    segment: Segment


class Writer:
    """Adds documents in segments, and publishes them by commits. One writer at a time."""

    def __init__(self, index: Index, policy: MergePolicy):
        self.index, self.policy = index, policy
        self.meta = index.meta()
        self.opstamp = self.meta.opstamp
        self.staged: list[Segment] = []
        self.bundle: list[dict[str, Any]] = []
        self.bundle_size = 0
        self.closed = False

    def _stamp(self) -> int:
        self.opstamp += 1
        return self.opstamp

    def _open(self) -> None:
        if self.closed:
            raise RuntimeError("the writer is closed")

    @staticmethod
    def _name(stamp: int) -> str:
        return f"s{stamp:08d}-{uuid.uuid4().hex[:12]}"

    def add(self, docs: DataFrame) -> Added:
        """Documents as one new segment. They have a doc_id, unique in the index, or get one."""
        return self._add(docs, 1, F.lit(0))[0]

    def add_divided(self, docs: DataFrame, parts: int, part: Column) -> list[Added]:
        """Documents as several new segments, in one pass: ``part`` is the place of each document's, an int from 0 on."""
        return self._add(docs, parts, part)

    def _add(self, docs: DataFrame, parts: int, part: Column) -> list[Added]:
        self._open()
        stamps = [self._stamp() for _ in range(parts)]
        given = "doc_id" in docs.columns
        if given and not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
            raise SchemaError("doc_id must be a whole number")
        docs, names = spread(docs), [self._name(s) for s in stamps]
        if not given:
            docs = self.index.data.settle(docs.withColumn("doc_id", F.lit(stamps[0] << 40) + F.monotonically_increasing_id()), names[0])
        ids = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
        postings = P.packed(ids, self.meta.schema, self.index.registry, part)
        for name in names:
            self.index.storage.stage(name)
        found = self.index.data.put(names, postings, ids.select("doc_id", part.alias("part")))
        if not given:
            self.index.data.unsettle(docs, names[0])
        added = [Added(s, Segment(name, found[name], s)) for s, name in zip(stamps, names, strict=True)]
        self.staged += [a.segment for a in added]
        for a in added:
            log.info("staged segment %s with %d documents", a.segment.id, a.segment.num_docs)
        return added

    def add_document(self, **fields: Any) -> None:
        """One document, by its fields. Documents are held until there are ``BUNDLE_DOCS`` of them, or ``BUNDLE_SIZE``
        characters, or a commit; then they become a segment. All of them have a doc_id, or none."""
        self._open()
        if self.bundle and ("doc_id" in fields) != ("doc_id" in self.bundle[0]):
            raise SchemaError("documents of one bundle have a doc_id each, or none")
        self.bundle.append(fields)
        self.bundle_size += sum(len(v) if isinstance(v, str) else sum(map(len, v)) for k, v in fields.items() if k != "doc_id" and v)
        if len(self.bundle) >= BUNDLE_DOCS or self.bundle_size >= BUNDLE_SIZE:
            self.flush()

    def flush(self) -> Added | None:
        """The held documents as a segment."""
        self._open()
        if not self.bundle:
            return None
        lists = {f.name: any(isinstance(d.get(f.name), list) for d in self.bundle) for f in self.meta.schema.fields}
        kinds = {"doc_id": "long"} if "doc_id" in self.bundle[0] else {}
        kinds |= {name: "array<string>" if many else "string" for name, many in lists.items()}
        one = lambda name, v: [v] if lists.get(name) and isinstance(v, str) else v
        rows = [tuple(one(name, d.get(name)) for name in kinds) for d in self.bundle]
        schema = ", ".join(f"`{name}` {kind}" for name, kind in kinds.items())
        self.bundle, self.bundle_size = [], 0
        return self.add(self.index.spark.createDataFrame(rows, schema))

    def commit(self, streams: dict[str, int] | None = None) -> int:
        """Publish what was added, merging as the policy says what was added before that, and all after it. Returns the
        commit's opstamp. A merge that fails is logged; what was published stays as it is."""
        self._open()
        self.flush()
        self._try_merges(lambda: self.policy(list(self.staged)), self._merge_staged)
        stamp = self._stamp()
        lost = {s.id for s in self.staged if s.num_docs} - self.index.data.present()
        if lost:
            raise RuntimeError(f"staged segments are gone: {sorted(lost)}")
        staged = self.staged
        self._publish([*self.meta.segments, *staged], streams)
        self.staged = []
        for s in staged:
            self.index.storage.unstage(s.id)
        self._try_merges(lambda: self.policy(list(self.meta.segments)), self.merge)
        return stamp

    def _try_merges(self, candidates, merge) -> None:
        try:
            while wanted := candidates():
                for ids in wanted:
                    merge(ids)
        except Exception:
            log.exception("a merge failed")

    def _publish(self, segments: list[Segment], streams: dict[str, int] | None = None) -> None:
        kept = sorted((s for s in segments if s.num_docs), key=lambda s: (-s.num_docs, s.id))
        meta = replace(
            self.meta,
            version=self.meta.version + 1,
            opstamp=self.opstamp,
            segments=tuple(kept),
            streams={**self.meta.streams, **(streams or {})},
        )
        self.index.storage.publish(meta.to_json())
        self.meta = meta
        log.info("published version %d with %d segments", meta.version, len(kept))

    def _merged(self, ids: list[str]) -> Segment:
        stamp = self._stamp()
        name = self._name(stamp)
        self.index.storage.stage(name)
        sizes = {s.id: s.num_docs for s in (*self.meta.segments, *self.staged)}
        return Segment(name, self.index.data.merge(name, ids, sum(sizes[i] for i in ids)), stamp)

    def _merge_staged(self, ids: list[str]) -> None:
        merged = self._merged(ids)
        self.staged = [*(s for s in self.staged if s.id not in set(ids)), merged]
        for segment in ids:
            self.index.data.drop(segment)
            self.index.storage.unstage(segment)

    def merge(self, ids: list[str]) -> Segment:
        """Committed segments become one, and those that no reader here has are deleted. Documents and scores stay the
        same."""
        self._open()
        known = {s.id: s for s in self.meta.segments}
        if len(set(ids)) != len(ids) or not set(ids) <= known.keys():
            raise ValueError("only committed segments, each once, can be merged")
        merged = self._merged(ids)
        self._publish([*(s for s in self.meta.segments if s.id not in set(ids)), merged])
        self.index.storage.unstage(merged.id)
        self.index.vacuum()
        return merged

    def close(self) -> None:
        """End without publishing what wasn't committed."""
        for s in self.staged:
            self.index.data.drop(s.id)
            self.index.storage.unstage(s.id)
        self.staged, self.bundle, self.closed = [], [], True


class Reader:
    """A snapshot. Later commits show after ``reload``. Until it is closed, its segments are not deleted in this process."""

    def __init__(self, index: Index, version: int | None = None):
        self.index = index
        self.spark = index.spark
        self.meta = index.meta(version)
        index.readers.add(self)

    def reload(self) -> Reader:
        self.meta = self.index.meta()
        return self

    @property
    def schema(self) -> IndexSchema:
        return self.meta.schema

    @property
    def segment_ids(self) -> list[str]:
        return [s.id for s in self.meta.segments]

    def segment(self, segment_id: str) -> Reader:
        """A reader of one segment; its statistics are the segment's."""
        one = Reader(self.index)
        one.meta = replace(self.meta, segments=tuple(s for s in self.meta.segments if s.id == segment_id))
        return one

    closed = False

    @property
    def postings(self) -> DataFrame:
        if self.closed:
            raise RuntimeError("the reader is closed")
        return self.index.data.get("postings", self.segment_ids)

    @property
    def term_stats(self) -> DataFrame:
        return P.sum_stats(self.index.data.get("terms", self.segment_ids))

    @property
    def docs(self) -> DataFrame:
        return self.index.data.get("docs", self.segment_ids)

    @property
    def n_docs(self) -> DataFrame:
        return self.spark.range(1).select(F.lit(self.meta.num_docs).cast("long").alias("n"))

    def doc_freq(self, field: str, term: str) -> int:
        row = self.term_stats.where((F.col("field") == field) & (F.col("term") == term)).agg(F.sum("df").alias("df")).first()
        return row["df"] or 0

    def terms(self, field: str) -> DataFrame:
        return self.term_stats.where(F.col("field") == field).select("term", "df")

    def parser(self, default_fields: list[str] | None = None, analyze_bare: bool = False) -> Parser:
        """The texts of a query are analyzed together, in one job."""
        known: dict[tuple[str, str], list[str] | None] = {}

        def prepare(pairs: list[tuple[str, str]]) -> None:
            fields = {name: self.schema.field(name) for name, _ in pairs}
            known.update({pair: None for pair in pairs if fields[pair[0]] is None})
            wanted = [pair for pair in dict.fromkeys(pairs) if pair not in known]
            if wanted:
                columns = [self.index.registry.get(fields[name].analyzer).tokens(F.lit(text)) for name, text in wanted]
                row = self.spark.range(0, 1, 1, 1).select(*(c.alias(f"t{i}") for i, c in enumerate(columns))).first()
                known.update({pair: list(tokens) for pair, tokens in zip(wanted, row, strict=True)})

        def analyze(name: str, text: str) -> list[str] | None:
            if (name, text) not in known:
                prepare([(name, text)])
            return known[name, text]

        return Parser(self.schema.names if default_fields is None else default_fields, analyze, analyze_bare, prepare)

    def scored(self, query: Query | str) -> DataFrame:
        """(doc_id, score) of the documents that match."""
        query = self.parser().parse(query) if isinstance(query, str) else query
        return compile_query(query, self.postings, self.term_stats, self.n_docs, self.docs)

    def search(self, query: Query | str, collector: Collector | None = None) -> Any:
        return (collector or TopScore()).result(self.scored(query))

    def addresses(self) -> DataFrame:
        """(doc_id, segment_ord, seg_doc_id): places by segment in the snapshot's order. They change with merges."""
        ords = self.spark.createDataFrame(list(enumerate(self.segment_ids)), "segment_ord int, segment string")
        place = F.row_number().over(Window.partitionBy("segment").orderBy("doc_id")) - 1
        return self.docs.join(F.broadcast(ords), "segment").select("doc_id", "segment_ord", place.cast("long").alias("seg_doc_id"))

    def create_views(self, prefix: str = "") -> None:
        """Temporary views for SQL: postings, term_stats and docs."""
        self.postings.createOrReplaceTempView(f"{prefix}postings")
        self.term_stats.createOrReplaceTempView(f"{prefix}term_stats")
        self.docs.createOrReplaceTempView(f"{prefix}docs")

    def close(self) -> None:
        """Its segments may be deleted from now on; it can't be searched any more."""
        self.index.readers.discard(self)
        self.meta = replace(self.meta, segments=())
        self.closed = True
