"""Removal of benchmark passages from training texts.

The n-gram windows of the benchmark, normalised, are broadcast as a hash set; each task scans the token
windows of whole documents, verifies hits word by word, and reports spans. A benchmark of more windows than
may be broadcast is broadcast as a bitmap of fixed size, which screens the token windows, and what
passes is joined to the table of windows, word by word. Either way documents are scanned once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm.common import documents, lean, query, text_of, utf8
from trialspark.shared import materialize

WINDOW = 10
BLOCK_WINDOWS = 200_000  # windows that may be broadcast with their words and items
BITMAP_BITS = 1 << 27  # of the screen for more windows: 16 MB, whatever the benchmark
WORD_BYTES = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
NORMAL = bytes(b if b in WORD_BYTES else 0x20 for b in bytes(range(256)).lower())
RADIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters and digits and of all non-ASCII bytes."""
    return text.translate(NORMAL).split()


def window_rows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """``item, gram`` (words joined by a space), ``size`` (its words) and ``print`` (a 64-bit hash) of each item's windows.

    An item of fewer than ``n`` words is one window of its own; NULL and wordless items have none.
    """
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), utf8().alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, grams, sizes, prints = [], [], [], [np.zeros(0, np.int64)]
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                k = min(n, len(words))
                if k:
                    prints.append(window_prints(words, k).view(np.int64))
                for i in range(len(words) - k + 1 if k else 0):
                    items.append(item)
                    grams.append(b" ".join(words[i : i + k]))
                    sizes.append(k)
            columns = [pa.array(items, pa.string()), pa.array(grams, pa.binary()), pa.array(sizes, pa.int32()), pa.array(np.concatenate(prints))]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "gram", "size", "print"])

    return rows.mapInArrow(run, "item string, gram binary, size int, print bigint")


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """Distinct ``gram``, its ``size`` and the ``items`` that hold it."""
    return window_rows(benchmark, n).groupBy("gram", "size").agg(F.sort_array(F.collect_set("item")).alias("items"))


def window_prints(words: list[bytes], k: int) -> np.ndarray:
    """A 64-bit hash of every run of ``k`` words."""
    marks = {w: zlib.crc32(w) for w in set(words)}
    h = _rolled(np.array([marks[w] for w in words], np.uint64), k)
    return (h ^ (h >> np.uint64(29))) * RADIX


class WindowSet:
    """A block of windows: a vocabulary, hashes by window length, and the windows for verification."""

    def __init__(self, rows: list[tuple[bytes, list[str]]]):
        self.items = {tuple(gram.split(b" ")): items for gram, items in rows}
        self.vocabulary: dict[bytes, int] = {}
        for gram in self.items:
            for w in gram:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.hashes = {}
        for k in {len(g) for g in self.items}:
            ids = np.array([[self.vocabulary[w] for w in g] for g in self.items if len(g) == k], np.uint64)
            self.hashes[k] = np.unique(_rolled(ids.ravel(), k)[::k])

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word spans [from, to) covered by occurring windows, and the items they belong to."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words], np.uint64)
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        hits, items = [], set()
        for k, hashes in self.hashes.items():
            if len(words) < k:
                continue
            start = np.flatnonzero(unknown[k:] == unknown[:-k])  # windows of known words only
            if not len(start):
                continue
            h = _rolled(ids, k)[start]
            at = np.searchsorted(hashes, h)
            at[at == len(hashes)] = 0
            for s in start[hashes[at] == h].tolist():
                owners = self.items.get(tuple(words[s : s + k]))
                if owners is not None:
                    hits.append((s, s + k))
                    items.update(owners)
        return merged(hits), items


def _rolled(ids: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of each run of k ids, modulo 2**64."""
    out = np.zeros(len(ids) - k + 1, np.uint64)
    for j in range(k):
        out = out * RADIX + ids[j : len(ids) - k + 1 + j]
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans, in order; touching spans become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan_documents(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block: int = BLOCK_WINDOWS) -> DataFrame:
    """Add ``n_words``, ``spans`` (word spans hit) and ``items`` (ids of occurring items) to ``docs``.

    Up to ``block`` windows are broadcast whole, and documents are not shuffled. More windows are screened
    by a bitmap of fixed size and verified by a join, which moves the hits only; broadcasts stay bounded
    for any benchmark. NULL texts have no words. Repeated rows are scanned each. Input columns named
    like the added ones are replaced.
    """
    kept = [c for c in docs.columns if c not in ("n_words", "spans", "items")]
    rows = materialize(window_rows(benchmark, n))
    if rows.count() > block and rows.select("gram").distinct().count() > block:
        return _scan_by_screen(docs.select(*kept), rows, kept)
    spark = docs.sparkSession
    windows = rows.groupBy("gram").agg(F.sort_array(F.collect_set("item")).alias("items")).collect()
    shared = spark.sparkContext.broadcast([(bytes(r["gram"]), list(r["items"])) for r in windows])
    out = docs.select(*kept, *no_hits(), utf8().alias("__text"))
    return out.mapInArrow(lean(_scanner(shared, len(kept))), out.schema).drop("__text")


SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def no_hits() -> list:
    """The added columns of a document without hits."""
    return [
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<struct<a:int,b:int>>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    ]


def _bitmap(rows: DataFrame) -> np.ndarray:
    """Bits of the windows' prints; built by tasks in pieces of 4 KB, so what is collected has a fixed size."""
    slot = F.pmod("print", F.lit(BITMAP_BITS))
    built = rows.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    whole = np.zeros((BITMAP_BITS // (8 * 4096) + 2, 4096), np.uint8)
    for r in built.toLocalIterator():
        whole[r["bucket"]] = np.frombuffer(r["bits"], np.uint8)
    return whole


def _passes(whole: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Which prints have their bit set (buckets count from 1 and hold slots from 0 up, as Spark numbers them)."""
    slot = prints.view(np.int64) % BITMAP_BITS
    bucket = np.where(slot > 0, 1 + (slot - 1) // 32768, 0)
    position = np.where(slot > 0, (slot - 1) % 32768, 0)
    return (whole[bucket, position >> 3] >> (position & 7).astype(np.uint8)) & 1 == 1


def _scan_by_screen(docs: DataFrame, rows: DataFrame, kept: list[str]) -> DataFrame:
    spark = docs.sparkSession
    sizes = sorted(r["size"] for r in rows.select("size").distinct().collect())  # one to the window's length
    shared = spark.sparkContext.broadcast((_bitmap(rows), sizes))
    keyed = docs.select(F.col("doc_id").alias("__d"), F.xxhash64(text_of()).alias("__k"), utf8().alias("__text"))
    schema = keyed.drop("__text").withColumns({"gram": F.lit(b""), "at": F.lit(0), "size": F.lit(0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, sizes = shared.value
        for batch in batches:
            owners, grams, starts, lengths = [], [], [], []
            for no, text in enumerate(batch.column(2)):
                words = words_of(text.as_py())
                for k in sizes:
                    if len(words) >= k:
                        for i in np.flatnonzero(_passes(whole, window_prints(words, k))).tolist():
                            owners.append(no)
                            grams.append(b" ".join(words[i : i + k]))
                            starts.append(i)
                            lengths.append(k)
            at = pa.array(owners, pa.int64())
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(grams, pa.binary()), pa.array(starts, pa.int32()), pa.array(lengths, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    hits = keyed.mapInArrow(lean(run), schema).distinct()  # rows that repeat id and text have the same hits
    found = materialize(hits.join(rows.select("gram", "item").distinct(), "gram"))
    span = F.struct(F.col("at").alias("a"), (F.col("at") + F.col("size")).cast("int").alias("b"))
    per = found.groupBy("__d", "__k").agg(F.array_sort(F.collect_set(span)).alias("spans"), F.sort_array(F.collect_set("item")).alias("items"))
    joined = docs.withColumn("__key", F.xxhash64(text_of())).join(per.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__key") == F.col("__k")), "left")
    n_words, no_spans, no_items = no_hits()
    out = joined.select(*kept, n_words, F.coalesce("spans", no_spans).alias("spans"), F.coalesce("items", no_items).alias("items"), utf8().alias("__text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = len(kept)
        for batch in batches:
            n = pa.array([len(words_of(t.as_py())) for t in batch.column(at + 3)], pa.int64())
            spans = [[{"a": a, "b": b} for a, b in merged([(s["a"], s["b"]) for s in row])] for row in batch.column(at + 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], n, pa.array(spans, SPANS), *batch.columns[at + 2 :]], names=batch.schema.names)

    return out.mapInArrow(lean(count), out.schema).drop("__text")


def _scanner(shared, kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = WindowSet(shared.value)
        for batch in batches:
            n_words, spans, items = [], [], []
            for text in batch.column(kept + 3):
                words = words_of(text.as_py())
                found, owners = windows.scan(words)
                n_words.append(len(words))
                spans.append([{"a": a, "b": b} for a, b in found])
                items.append(sorted(owners))
            new = [pa.array(n_words, pa.int64()), pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *new, batch.column(kept + 3)], names=batch.schema.names)

    return run


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the bytes from the first to the last word of each span."""
    normal = text.translate(NORMAL)
    wanted = {x for s in spans for x in s}
    starts, ends, at, number = {}, {}, 0, 0
    for run in normal.split(b" "):
        if run:
            if number in wanted:
                starts[number] = at
            if number + 1 in wanted:
                ends[number + 1] = at + len(run)
            number += 1
        at += len(run) + 1
    out, done = [], 0
    for a, b in spans:
        out.append(text[done : starts[a]])
        done = ends[b]
    return b"".join([*out, text[done:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "spans", n: int = WINDOW) -> DataFrame:
    """``docs`` without benchmark passages; the columns stay as they are.

    ``mode="spans"`` cuts the hit spans out of the text and drops documents that keep no word;
    ``mode="documents"`` drops each document with a hit. Documents without a hit are unchanged, NULL
    texts and texts without words included.
    """
    kept = docs.columns  # columns of the added names stay the caller's
    aside = {c: f"__own_{c}" for c in ("n_words", "spans", "items") if c in kept}
    flagged = scan_documents(docs.withColumnsRenamed(aside), benchmark, n).withColumnRenamed("spans", "__spans").drop("n_words", "items")
    flagged = flagged.withColumnsRenamed({v: k for k, v in aside.items()})
    clean = F.size("__spans") == 0
    if mode == "documents":
        return flagged.filter(clean).select(*docs.columns)
    if mode != "spans":
        raise ValueError(f"mode must be 'spans' or 'documents', not {mode!r}")
    names = [c for c in docs.columns if c != "text"]
    rows = flagged.select(*names, "text", F.col("__spans"), F.encode("text", "UTF-8").alias("__bytes"))
    schema = rows.drop("__spans", "__bytes").schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = len(names)
        for batch in batches:
            texts, keep = batch.column(at).to_pylist(), []
            for i, spans in enumerate(batch.column(at + 1).to_pylist()):
                if spans:
                    left = without_spans(batch.column(at + 2)[i].as_py(), [(s["a"], s["b"]) for s in spans])
                    texts[i] = left.decode()
                    keep.append(bool(words_of(left)))
                else:
                    keep.append(True)
            part = pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, pa.string())], names=[*names, "text"])
            yield part.filter(pa.array(keep))

    return rows.mapInArrow(lean(cut), schema).select(*docs.columns)


@query("op8_benchmark_windows")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    found = scan_documents(documents(spark, sf).select("doc_id", "text"), benchmark)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["b"] - s["a"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join(F.sort_array("items"), ","), "UTF-8"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
