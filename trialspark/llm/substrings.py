"""Removal of repeated byte strings with suffix arrays.

Each window of ``LENGTH`` bytes selects an anchor, the gram inside it with the smallest hash. Equal
windows select equal anchors at equal places, so only windows around anchors that occur again can
repeat. The surroundings of these anchors are gathered by anchor, trimmed to what some other one
shares, and sorted by suffix (linear grouping); neighbours in that order with a common prefix of
``LENGTH`` bytes are repeats, compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm.common import documents, query, text_of, utf8
from trialspark.llm.gsaca import suffix_array
from trialspark.shared import scratch_path

LENGTH = 200
GRAM = 24
HOT = 1 << 16  # anchors that occur more often are settled window by window, without a group
SEGMENT = 1 << 22
BLOCK = 1 << 16  # bytes sorted at a time, more only for a larger bucket
FLUSH = 1 << 24
LOW24 = np.uint64((1 << 24) - 1)


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each run of ``gram`` bytes (a multiple of 8)."""
    m = len(data) - gram + 1
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded, (len(data), 8), (1, 1)).copy().view(np.uint64).ravel()
    h = np.full(m, 0x9E3779B97F4A7C15, np.uint64)
    for at in range(0, gram, 8):
        h = (h ^ words[at : at + m]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchors of a text: hash, position, and the window starts [low, high) that select each.

    A window takes the last of the grams whose hash, cut to 40 bits, is smallest in it, which depends
    on nothing outside the window. Every window start is in exactly one anchor's run.
    """
    parts = []
    for base in range(0, max(0, len(text) - length + 1), SEGMENT):
        data = np.frombuffer(text, np.uint8, offset=base)[: SEGMENT + length - 1]
        h = _gram_hashes(data, gram)
        m, wide = len(h), length - gram + 1
        rank = (h & ~LOW24) | (LOW24 - np.arange(m, dtype=np.uint64))
        blocks = -(-m // wide)
        grid = np.full(blocks * wide, np.uint64(0xFFFFFFFFFFFFFFFF))
        grid[:m] = rank
        grid = grid.reshape(blocks, wide)
        before = np.minimum.accumulate(grid, axis=1).ravel()
        after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = m - wide + 1
        least = np.minimum(after[:windows], before[wide - 1 : wide - 1 + windows])
        low = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        at = (LOW24 - (least[low] & LOW24)).astype(np.int64)
        parts.append((h[at].view(np.int64), at + base, low + base, np.append(low[1:], windows) + base))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id``, the text's hash ``k`` and its UTF-8 bytes; rows that agree in both are equal rows."""
    return docs.select("doc_id", F.xxhash64("doc_id", text_of()).alias("k"), utf8().alias("body"))


def _packed(rows: DataFrame) -> DataFrame:
    """The same rows with compressed bytes, for a smaller shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            body = pa.array([press.compress(t.as_py()) for t in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], body], names=["doc_id", "k", "body"])

    return rows.mapInArrow(run, rows.schema)


def _write(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def repeated_anchors(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """``h, n``: anchors that occur at least twice; a task adds up its own occurrences first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors(t.as_py(), length)[0] for t in batch.column(0)]
            h, n = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "n"])

    return rows.select("body").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1")


def _lists(rows: DataFrame, repeated: DataFrame, hot: int, length: int) -> DataFrame:
    """Per text hash: its repeated anchors, the rare and the hot ones apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(anchors(t.as_py(), length)[0]) for t in batch.column(1)]
            k = np.repeat(batch.column(0).to_numpy(), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found])), pa.array(k)], names=["h", "k"])

    pairs = rows.select("k", "body").mapInArrow(run, "h long, k long").join(repeated.hint("merge"), "h")
    rare, many = (F.collect_set(F.when(c, F.col("h"))) for c in (F.col("n") <= hot, F.col("n") > hot))
    return pairs.groupBy("k").agg(rare.alias("rare"), many.alias("many"))


CONTEXT = "id binary, h long, hot boolean, off int, body binary, n long, doc_id long, k long, low long"


def _contexts(packed: DataFrame, lists: DataFrame, length: int) -> DataFrame:
    """Surroundings of repeated anchors, and where each occurs, as two kinds of rows.

    Occurrences carry ``id, doc_id, k, low``; contexts carry ``id, h, hot, off, body, n`` with the
    anchor at ``off`` and ``n`` equal ones combined within the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        seen: dict[bytes, list] = {}
        held = 0

        def flush() -> pa.RecordBatch:
            cols = list(zip(*((i, *v) for i, v in seen.items()), strict=True)) or [[]] * 6
            gap = [None] * len(seen)
            out = pa.record_batch([pa.array(c, t) for c, t in zip([*map(list, cols), gap, gap, gap], types, strict=True)], names=names)
            seen.clear()
            return out

        for batch in batches:
            spots: list[tuple[bytes, int | None, int, int]] = []
            for doc_id, k, body, rare, many in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = unpack.decompress(body)
                h, at, low, high = anchors(text, length)
                kept = np.flatnonzero(np.isin(h, np.array([*rare, *many], np.int64)))
                hot = set(many)
                for hh, aa, ll, uu in zip(h[kept].tolist(), at[kept].tolist(), low[kept].tolist(), high[kept].tolist(), strict=True):
                    part = text[ll : uu - 1 + length]
                    i = xxhash.xxh3_128_digest(b"%d %d " % (hh, aa - ll) + part)
                    spots.append((i, doc_id, k, ll))
                    if i in seen:
                        seen[i][4] += 1
                    else:
                        seen[i] = [hh, hh in hot, aa - ll, part, 1]
                        held += len(part)
                if held > FLUSH:
                    held = 0
                    yield flush()
            gap = [None] * len(spots)
            cols = [list(c) for c in zip(*spots, strict=True)] or [[]] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip([cols[0], gap, gap, gap, gap, gap, *cols[1:]], types, strict=True)], names=names)
        yield flush()

    types = [pa.binary(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in CONTEXT.split(", ")]
    return packed.join(lists.hint("merge"), "k").select("doc_id", "k", "body", "rare", "many").mapInArrow(run, CONTEXT)


def _shared_lengths(bucket: np.ndarray, parts: list[bytes], width: int) -> np.ndarray:
    """For each byte string the longest prefix that it shares with another one of its bucket (or more)."""
    rows = b"".join(int(b).to_bytes(4, "big") + p.ljust(width, b"\0") for b, p in zip(bucket, parts, strict=True))
    order = np.argsort(np.frombuffer(rows, f"S{width + 4}"), kind="stable")
    table = np.frombuffer(rows, np.uint8).reshape(-1, width + 4)[order]
    differ = table[1:] != table[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width + 4) - 4  # below 0: another bucket
    best = np.zeros(len(parts), np.int64)
    np.maximum.at(best, order[1:], common)
    np.maximum.at(best, order[:-1], common)
    return np.minimum(best, np.fromiter(map(len, parts), np.int64, len(parts)))


def repeated_windows(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Starts in each text of the strings of ``length`` bytes that also start elsewhere in ``texts``.

    One suffix array over all texts: equal strings are neighbours in it. A string must end before its
    text does, so what follows the text takes no part.
    """
    joined = b"\n".join(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes + 1) - sizes - 1
    room = np.concatenate([np.append(np.arange(n, 0, -1), 0) for n in sizes.tolist()])  # bytes left in the own text
    order = suffix_array(joined)
    order = order[room[order] >= length]
    data = np.frombuffer(joined + b"\0" * 8, np.uint8)
    words = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))
    same = np.arange(len(order) - 1)
    for at in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        same = same[(words[order[same] + at] == words[order[same + 1] + at]).all(axis=1)]
    hit = np.zeros(len(joined) + 1, bool)
    hit[order[same]] = hit[order[same + 1]] = True
    return [np.flatnonzero(hit[s : s + n]) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def _spans(windows: np.ndarray, length: int) -> list[dict]:
    """Byte spans that windows at the (sorted) starts cover."""
    if not len(windows):
        return []
    cut = np.flatnonzero(np.diff(windows) > length)
    return [{"a": a, "b": b + length} for a, b in zip(windows[np.append(0, cut + 1)].tolist(), windows[np.append(cut, len(windows) - 1)].tolist(), strict=True)]


def covered_contexts(ids: list[bytes], hs: np.ndarray, offs: np.ndarray, bodies: list[bytes], counts: np.ndarray, length: int) -> tuple[list[bytes], list[list[dict]]]:
    """Covered spans of each distinct context of whole buckets; contexts without any are left out."""
    merged: dict[bytes, int] = {}
    total: dict[bytes, int] = {}
    for j, (i, n) in enumerate(zip(ids, counts.tolist(), strict=True)):
        merged.setdefault(i, j)
        total[i] = total.get(i, 0) + n
    rows = np.array(list(merged.values()), np.int64)
    found = {i: [{"a": 0, "b": len(bodies[j])}] for i, j in merged.items() if total[i] > 1}
    _, bucket, kinds = np.unique(hs[rows], return_inverse=True, return_counts=True)
    mixed = kinds[bucket] > 1
    rows, bucket = rows[mixed], bucket[mixed]
    if len(rows):
        right = _shared_lengths(bucket, [bodies[j][offs[j] :] for j in rows], length)
        left = _shared_lengths(bucket, [bodies[j][offs[j] - 1 :: -1] if offs[j] else b"" for j in rows], length)
        near = left + right >= length
        rows, bucket, left, right = rows[near], bucket[near], left[near], right[near]
        start, stop = offs[rows] - left, offs[rows] + right
        ends = np.flatnonzero(np.append(np.diff(bucket[np.argsort(bucket, kind="stable")]) != 0, True))
        by_bucket = np.argsort(bucket, kind="stable")
        block: list[int] = []
        held = 0
        for first, last in zip(np.append(0, ends[:-1] + 1).tolist(), ends.tolist(), strict=True):
            alike: dict[tuple[int, bytes], list[int]] = {}
            for b in by_bucket[first : last + 1].tolist():
                alike.setdefault((int(left[b]), bodies[rows[b]][start[b] : stop[b]]), []).append(b)
            for same in alike.values():  # equal as a whole, around the same anchor
                for b in same if len(same) > 1 else ():
                    found.setdefault(ids[rows[b]], [{"a": int(start[b]), "b": int(stop[b])}])
            if len(alike) > 1:
                block += [same[0] for same in alike.values()]
                held += sum(len(t) for _, t in alike)
            if block and (held >= BLOCK or last == len(rows) - 1):
                texts = [bodies[rows[b]][start[b] : stop[b]] for b in block]
                for b, windows in zip(block, repeated_windows(texts, length), strict=True):
                    if len(windows) and ids[rows[b]] not in found:
                        found[ids[rows[b]]] = _spans(windows + start[b], length)
                block, held = [], 0
    return list(found), list(found.values())


def _sorted_spans(contexts: DataFrame, length: int) -> DataFrame:
    """Spans of rare contexts: buckets are dealt by anchor and sorted, then taken whole in small blocks."""
    rows = contexts.filter("body is not null and not hot").select("id", "h", "off", "body", "n").repartition("h").sortWithinPartitions("h")
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts)
            h, off, n = (t.column(c).to_numpy() for c in ("h", "off", "n"))
            ids, spans = covered_contexts(t.column("id").to_pylist(), h, off, t.column("body").to_pylist(), n, length)
            return pa.record_batch([pa.array(ids, pa.binary()), pa.array(spans, kind)], names=["id", "spans"])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                h = part.column(1).to_numpy()
                new = np.flatnonzero(np.diff(h)) + 1
                if held and (h[0] != held[-1].column(1)[-1].as_py() or len(new)):
                    cut = int(new[-1]) if len(new) else 0  # whole buckets end here
                    if cut or size > BLOCK:
                        yield settle([*held, part.slice(0, cut)] if cut else held)
                        held, size = [], 0
                        part = part.slice(cut)
                held.append(part)
                size += part.nbytes
        if held:
            yield settle(held)

    return rows.mapInArrow(run, "id binary, spans array<struct<a:int,b:int>>")


def _hot_spans(contexts: DataFrame, length: int) -> DataFrame:
    """Spans of hot contexts: each window of a distinct one is a row, and equal windows are counted.

    Contexts that occur again are covered as a whole and only serve as partners of the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, body, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += [(xxhash.xxh3_128_digest(body[d : d + length]), i, d, n) for d in range(len(body) - length + 1)]
            cols = [list(c) for c in zip(*out, strict=True)] or [[]] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.binary(), pa.int32(), pa.int64()), strict=True)], names=["w", "id", "d", "n"])

    hot = contexts.filter("body is not null and hot").groupBy("id").agg(F.first("body").alias("body"), F.sum("n").alias("n"))
    windows = hot.mapInArrow(run, "w binary, id binary, d int, n long")
    again = windows.groupBy("w").agg(F.sum("n").alias("total")).filter("total > 1")
    span = F.struct(F.col("d").alias("a"), (F.col("d") + length).alias("b"))
    partly = windows.filter("n = 1").join(again, "w").groupBy("id").agg(F.collect_set(span).alias("spans"))
    whole = hot.filter("n > 1").select("id", F.array(F.struct(F.lit(0).alias("a"), F.length("body").alias("b"))).alias("spans"))
    return partly.unionByName(whole)


def repeated_spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """``doc_id, k, spans``: byte spans of each document that lie in a repeated string of ``length`` bytes.

    ``k`` is the text's hash; documents without such a span have no row. Matches inside one document
    count, matches across documents' ends don't exist. Rows equal in id and text repeat each other.
    Anchors that occur over ``hot`` times are settled by counting exact windows, so no task
    gathers an unbounded group.
    """
    rows = keyed(docs)
    repeated = _write(repeated_anchors(rows, length), "anchors")
    contexts = _write(_contexts(_packed(rows), _lists(rows, repeated, hot, length), length), "contexts")
    covered = _sorted_spans(contexts, length).unionByName(_hot_spans(contexts, length)).withColumnRenamed("id", "cid")
    spots = contexts.filter("body is null").select("id", "doc_id", "k", "low")
    moved = F.transform("spans", lambda s: F.struct((s["a"] + F.col("low")).alias("a"), (s["b"] + F.col("low")).alias("b")))
    found = spots.join(covered.hint("merge"), F.col("id") == F.col("cid")).select("doc_id", "k", moved.alias("spans"))
    return found.groupBy("doc_id", "k").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept`` (the bytes that are left).

    NULL texts are empty, texts shorter than ``length`` keep everything, and a cut may fall inside a
    character, so ``kept`` is binary. Only ``doc_id`` and ``text`` are read.
    """
    rows = keyed(docs)
    spans = _write(repeated_spans(docs, length, hot), "spans").select(F.col("doc_id").alias("d"), F.col("k").alias("kk"), "spans")
    joined = _packed(rows).join(spans.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("k") == F.col("kk")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            sizes, removed, runs, kept = [], [], [], []
            for body, found in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = unpack.decompress(body.as_py())
                gone, left, at, number = 0, [], 0, 0
                for a, b in _merged(found or []):
                    left.append(text[at:a])
                    gone, at, number = gone + b - a, b, number + 1
                sizes.append(len(text))
                removed.append(gone)
                runs.append(number)
                kept.append(b"".join([*left, text[at:]]))
            new = [pa.array(x, pa.int64()) for x in (sizes, removed, runs)]
            yield pa.record_batch([batch.column(0), *new, pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.select("doc_id", "body", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs that the spans cover together."""
    out: list[tuple[int, int]] = []
    for s in sorted(spans, key=lambda s: s["a"]):
        if out and s["a"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s["b"]))
        else:
            out.append((s["a"], s["b"]))
    return out


@query("op4_suffix_groups")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return remove_repeats(documents(spark, sf)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
