"""Ranked lexical search over hashed max-sketches.

A document's sketch folds its terms into 65,536 coordinates by a hash and keeps each coordinate's
largest term count; as a term's impact grows with its count, the impact of that count is the maximum
of the impacts folded there. Queries are looked up in blocks: the weighted sum of a query's
coordinates bounds the document's score from above. The documents with the highest bounds are scored
exactly, which gives a threshold; every document whose bound reaches it is then scored exactly too.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialspark.llm.common import documents, pieces, query, text_of, utf8
from trialspark.llm.decontaminate import words_of
from trialspark.shared import materialize

WIDTH = 1 << 16  # coordinates of a sketch
BLOCK_ENTRIES = 1 << 20  # (query, coordinate) entries looked up at once: 16 MB broadcast
FIRST_ROUND = 16  # documents a query whose exact scores give the threshold
TOP = 10
SLICE_BYTES = 4 << 20  # of texts that a Python worker holds as words at a time


def coordinate(term: bytes) -> int:
    return zlib.crc32(term) % WIDTH


def impact(tf, m):
    """Saturated count of a term in a document of length factor ``m``; it never falls as ``tf`` grows."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


@dataclass(frozen=True)
class SketchIndex:
    """``sketches``: doc_id, text_key, n, coords, peaks; ``vocabulary``: term, df; documents and terms in all."""

    sketches: DataFrame
    vocabulary: DataFrame
    n_docs: int
    n_terms: int


def build_index(docs: DataFrame) -> SketchIndex:
    """Sketch every document with at least one term and count document frequencies, in one pass over the texts.

    ``coords`` holds the sorted 16-bit coordinates, ``peaks`` their largest term counts (32 bits). Tasks
    count document frequencies per slice of texts before anything is shuffled. NULL texts have no
    terms; repeated rows count each.
    """
    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("text_key"), utf8().alias("__text"))
    partial = "array<struct<term:binary,df:bigint>>"
    empty = [F.lit(0).cast("long").alias("n"), F.lit(b"").alias("coords"), F.lit(b"").alias("peaks"), F.lit(None).cast(partial).alias("partial")]
    schema = rows.select("doc_id", "text_key", *empty).schema
    for field in schema.fields:
        field.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, 2, SLICE_BYTES):
            ids, keys = part.column(0).to_pylist(), part.column(1).to_pylist()
            rows_out, frequencies, places = [], Counter(), {}
            for i, text in enumerate(texts):
                words = words_of(text)
                if not words:
                    continue
                counts = Counter(words)
                frequencies.update(counts.keys())
                for w in counts:
                    if w not in places:
                        places[w] = coordinate(w)
                coords = np.fromiter((places[w] for w in counts), np.uint16, len(counts))
                peaks = np.fromiter(counts.values(), np.uint32, len(counts))
                order = np.argsort(coords, kind="stable")
                coords, peaks = coords[order], peaks[order]
                first = np.flatnonzero(np.concatenate([[True], coords[1:] != coords[:-1]]))
                rows_out.append((ids[i], keys[i], len(words), coords[first].tobytes(), np.maximum.reduceat(peaks, first).tobytes()))
            rows_out.append((None,) * 5)
            columns = list(zip(*rows_out, strict=True))
            arrays = [pa.array(c, t) for c, t in zip(columns, [part.schema.field(0).type, pa.int64(), pa.int64(), pa.binary(), pa.binary()], strict=True)]
            pairs = pa.StructArray.from_arrays([pa.array(frequencies.keys(), pa.binary()), pa.array(frequencies.values(), pa.int64())], names=["term", "df"])
            sizes = np.zeros(len(rows_out) + 1, np.int32)
            sizes[-1] = len(frequencies)
            arrays.append(pa.ListArray.from_arrays(pa.array(sizes), pairs))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    stored = materialize(rows.mapInArrow(run, schema))
    sketches = stored.filter("n is not null").drop("partial")
    counted = stored.filter("n is null").select(F.explode("partial").alias("p")).groupBy("p.term").agg(F.sum("p.df").alias("df"))
    totals = sketches.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    return SketchIndex(sketches, materialize(counted), totals["n"], totals["l"])


def query_terms(queries: DataFrame, index: SketchIndex) -> DataFrame:
    """``item, item_id, term, place, weight`` for the terms of each query that the corpus holds.

    ``item`` numbers the distinct rows (``item_id``, ``text``); ``weight`` is the term's weight times its
    repeats in the query. Queries without terms have no rows.
    """
    numbered = materialize(queries.select("item_id", "text").distinct().withColumn("item", F.monotonically_increasing_id()))
    rows = numbered.select("item", "item_id", utf8().alias("__text"))
    schema = rows.drop("__text").withColumns({"term": F.lit(b""), "place": F.lit(0), "repeats": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, 2):
            found = [(i, term, coordinate(term), n) for i, text in enumerate(texts) for term, n in Counter(words_of(text)).items()]
            if found:
                at, terms, places, repeats = zip(*found, strict=True)
                own = [part.column(c).take(pa.array(at)) for c in range(2)]
                new = [pa.array(terms, pa.binary()), pa.array(places, pa.int32()), pa.array(repeats, pa.int64())]
                yield pa.RecordBatch.from_arrays([*own, *new], names=schema.names)

    weight = F.floor(1000 * F.log(F.lit(2.0 * index.n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    held = rows.mapInArrow(run, schema).join(index.vocabulary, "term")
    return held.select("item", "item_id", "term", "place", (weight * F.col("repeats")).alias("weight"))


class Block:
    """Queries of a block as one flat list of (coordinate, weight), query after query."""

    def __init__(self, rows: list, n_docs: int, n_terms: int):
        rows = sorted(rows)
        items = np.array([r[0] for r in rows], np.int64)
        self.starts = np.flatnonzero(np.concatenate([[True], items[1:] != items[:-1]]))
        self.items = items[self.starts]
        self.places = np.array([r[1] for r in rows], np.uint16)
        self.weights = np.array([r[2] for r in rows], np.int64)
        self.n_docs, self.n_terms = n_docs, n_terms

    def bounds(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """For each sketch: id, text key, length factor and the upper bounds of all queries."""
        dense = np.zeros(WIDTH, np.int64)
        for batch in batches:
            for doc, key, n, coords, peaks in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                m = 25 + 75 * n * self.n_docs // self.n_terms  # no overflow: Python's own integers
                at = np.frombuffer(coords, np.uint16)
                dense[at] = impact(np.frombuffer(peaks, np.uint32).astype(np.int64), m)
                yield doc, key, m, np.add.reduceat(dense[self.places] * self.weights, self.starts)
                dense[at] = 0


CANDIDATE = ["item", "doc_id", "text_key", "m", "bound"]


def _rows(found: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*found, strict=True) if found else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _candidate_schema(batch: pa.RecordBatch) -> pa.Schema:
    return pa.schema([("item", pa.int64()), ("doc_id", batch.schema.field(0).type), ("text_key", pa.int64()), ("m", pa.int64()), ("bound", pa.int64())])


def _highest(shared, k: int):
    """Per task and query, the ``k`` documents with the highest bounds above 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        heaps: list[list] = [[] for _ in block.items]
        floor = np.zeros(len(block.items), np.int64)  # what a bound has to exceed
        schema = None

        def noted():
            nonlocal schema
            for batch in batches:
                schema = schema or _candidate_schema(batch)
                yield batch

        for no, (doc, key, m, bounds) in enumerate(block.bounds(noted())):
            for q in np.flatnonzero(bounds > floor).tolist():
                entry = (int(bounds[q]), -no, doc, key, m)
                if len(heaps[q]) < k:
                    heapq.heappush(heaps[q], entry)
                else:
                    heapq.heapreplace(heaps[q], entry)
                if len(heaps[q]) == k:
                    floor[q] = heaps[q][0][0]
        if schema is not None:
            yield _rows([(int(block.items[q]), doc, key, m, bound) for q, heap in enumerate(heaps) for bound, _, doc, key, m in heap], schema)

    return run


def _reaching(shared, limits):
    """Every document whose bound is above a query's threshold, or equals it with an id that could still win the tie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        held = limits.value
        least = np.array([held.get(int(i), (1, None))[0] for i in block.items], np.int64)
        last = [held.get(int(i), (1, None))[1] for i in block.items]
        for batch in batches:
            found = []
            for doc, key, m, bounds in block.bounds(iter([batch])):
                for q in np.flatnonzero(bounds >= least).tolist():
                    bound = int(bounds[q])
                    if bound > least[q] or last[q] is None or (doc is not None and doc <= last[q]):
                        found.append((int(block.items[q]), doc, key, m, bound))
            yield _rows(found, _candidate_schema(batch))

    return run


def exact_scores(candidates: DataFrame, docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``item, doc_id, text_key, score`` of candidate pairs by the terms themselves; scores of 0 are left out.

    Only the texts of candidate documents are read into terms, and only terms of queries go on.
    """
    wanted = candidates.select(F.col("doc_id").alias("__d"), F.col("text_key").alias("__k")).distinct()
    keyed = docs.select("doc_id", F.xxhash64(text_of()).alias("text_key"), utf8().alias("__text"))
    rows = keyed.join(wanted, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("text_key") == F.col("__k")), "left_semi")
    schema = rows.drop("__text").withColumns({"term": F.lit(b""), "tf": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, 2, SLICE_BYTES):
            counts = [Counter(words_of(t)) for t in texts]
            at = pa.array(np.repeat(np.arange(len(counts)), [len(c) for c in counts]))
            new = [pa.array([t for c in counts for t in c], pa.binary()), pa.array([n for c in counts for n in c.values()], pa.int64())]
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), *new], names=schema.names)

    counted = rows.mapInArrow(run, schema).join(terms.select("term").distinct(), "term", "left_semi")
    counted = counted.groupBy("doc_id", "text_key", "term").agg(F.max("tf").alias("tf"))  # rows that repeat id and text are one document
    pairs = candidates.select("item", "doc_id", "text_key", "m").distinct().join(terms.select("item", "term", "weight"), "item")
    same = pairs.doc_id.eqNullSafe(counted.doc_id) & (pairs.text_key == counted.text_key) & (pairs.term == counted.term)
    part = F.expr("weight * ((1000000000 * tf) div (1000 * tf + 8 * m))")
    scored = pairs.join(counted, same).groupBy(pairs.item, pairs.doc_id, pairs.text_key).agg(F.sum(part).alias("score"))
    return scored.filter("score > 0")


def _ranked(scored: DataFrame, top: int) -> DataFrame:
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "text_key")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _blocks(entries: DataFrame, limit: int) -> int:
    """Number of hash blocks of queries so that none has more than ``limit`` entries (a single query has ``WIDTH`` at most)."""
    blocks = max(1, -(-entries.count() // limit))
    while True:
        sizes = entries.groupBy(F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block")).agg(F.count("*").alias("c"), F.min("item").alias("lo"), F.max("item").alias("hi"))
        if sizes.filter((F.col("c") > limit) & (F.col("lo") < F.col("hi"))).isEmpty():
            return blocks
        blocks *= 2


def search(index: SketchIndex, docs: DataFrame, queries: DataFrame, top: int = TOP, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """The ``top`` highest-scoring documents of each query: ``item_id, rank, doc_id, score``.

    Exact: a document is left out unscored only if its bound is below the ``top``-th exact score, or
    equals it with an id after that document's. Equal scores rank by ascending id, NULL ids last;
    documents without any term of the query have no row. Rows that repeat an id and its text are
    listed once, and so are repeated queries; queries that share an id but not the text are ranked
    each. NULL and empty queries and empty tables give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    terms = materialize(query_terms(queries, index))
    entries = materialize(terms.groupBy("item", "place").agg(F.sum("weight").alias("weight")))
    candidate = index.sketches.select(F.lit(0).cast("long").alias("item"), "doc_id", "text_key", *[F.lit(0).cast("long").alias(c) for c in CANDIDATE[3:]]).schema
    blocks = _blocks(entries, block_entries)
    part = F.pmod(F.xxhash64("item"), F.lit(blocks))
    by_bound = W.partitionBy("item").orderBy(F.desc("bound"))
    first = max(FIRST_ROUND, top)
    out = None
    for b in range(blocks):  # a block of queries against all sketches at a time
        asked = terms.filter(part == b)
        rows = [tuple(r) for r in entries.filter(part == b).select("item", "place", "weight").collect()]
        if not rows:
            continue
        shared = spark.sparkContext.broadcast(Block(rows, index.n_docs, index.n_terms))
        highest = index.sketches.mapInArrow(_highest(shared, first), candidate)
        leading = materialize(highest.withColumn("no", F.row_number().over(by_bound)).filter(F.col("no") <= first).drop("no"))
        known = _ranked(exact_scores(leading, docs, asked), top).filter(F.col("rank") == top).select("item", "score", "doc_id").collect()
        # queries with fewer than ``top`` documents so far take every bound above 0
        limits = spark.sparkContext.broadcast({r["item"]: (r["score"], r["doc_id"]) for r in known})
        rest = materialize(index.sketches.mapInArrow(_reaching(shared, limits), candidate))
        best = materialize(_ranked(exact_scores(rest, docs, asked), top))
        out = best if out is None else out.unionByName(best)
    names = terms.select("item", "item_id").distinct()
    if out is None:
        return names.join(index.sketches.select("doc_id"), F.lit(False)).select("item_id", F.lit(0).alias("rank"), "doc_id", F.lit(0).cast("long").alias("score"))
    return out.join(names, "item").select("item_id", "rank", "doc_id", "score")


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
with d as (select doc_id, {_TERMS} as terms from documents),
tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest(terms) as term from d) group by all),
g as (select count(*) as nd, sum(len(terms))::bigint as l from d where len(terms) > 0),
m as (select doc_id, 100 - 75 + (75 * len(terms) * nd) // l as m from d, g where len(terms) > 0),
w as (select term, floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1)))::bigint as w from tf, g group by term, nd),
q as (select item_id, unnest({_TERMS}) as term from benchmark),
s as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
      from q join w using (term) join tf using (term) join m using (doc_id) group by all),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0)
select item_id, rank::int as rank, doc_id, score from r where rank <= 10
"""


@query("op13_max_sketches", ORACLE)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "text")
    return search(build_index(docs), docs, spark.read.parquet(f"{sf}/benchmark.parquet"))
