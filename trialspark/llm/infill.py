"""Fill-in-middle transformation over a learned index of token boundaries.

The boundaries of a text are the byte offsets at which its tokens end. Error-bounded straight segments
are fitted to all of them, and every boundary's distance from its segment is kept in one byte. A cut at
a token rank is predicted by the segment that holds the rank and put right by the stored residual, so
texts are cut again (other seeds, further epochs) without being cut into tokens again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm.common import documents, pieces, query, utf8

SEED = 42
INFILL_PERCENT = 50
SUFFIX_FIRST_PERCENT = 80
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
ERROR = 126  # of a prediction before rounding; residuals then fit into eight bits
FIRST_LOOK = 64  # ranks that a segment tries at first, doubled while they fit
SEGMENT = np.dtype([("rank", "<i8"), ("offset", "<i8"), ("slope", "<f8")])
INDEX = ["n", "segments", "residuals"]


def boundaries(text: bytes) -> np.ndarray:
    """0 and the byte offset after each token: white space belongs to the token that follows it.

    Trailing white space is a token of its own, and the empty text has none. White space is one byte
    per character in UTF-8, so offsets never fall inside a character.
    """
    raw = np.frombuffer(text, np.uint8)
    white = (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))
    ends = np.flatnonzero(white[1:] & ~white[:-1]) + 1
    return np.concatenate([[0], ends, [len(raw)]] if len(raw) else [[0]]).astype(np.int64)


def fit(offsets: np.ndarray, error: float = ERROR) -> tuple[np.ndarray, np.ndarray]:
    """Segments over ranks 0 to len − 1, and the residual of every rank.

    A segment starts at a boundary and grows while some slope passes every further boundary within
    ``error`` bytes (the feasible slopes shrink to nothing at the first one that can't be passed).
    """
    segments, at, total = [], 0, len(offsets)
    while at < total:
        low, high, end, look = -np.inf, np.inf, at + 1, FIRST_LOOK
        while end < total:
            rise = offsets[end : end + look] - offsets[at]
            run = np.arange(end - at, end - at + len(rise))
            lows = np.maximum.accumulate(np.maximum((rise - error) / run, low))
            highs = np.minimum.accumulate(np.minimum((rise + error) / run, high))
            out = lows > highs
            fits = int(out.argmax()) if out.any() else len(rise)
            if fits:
                low, high = lows[fits - 1], highs[fits - 1]
            end += fits
            if fits < len(rise):
                break
            look *= 2
        segments.append((at, offsets[at], (low + high) / 2 if end > at + 1 else 0.0))
        at = end
    table = np.array(segments, SEGMENT)
    residuals = offsets - predict(table, np.arange(total))
    return table, residuals.astype(np.int8)


def predict(segments: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Offsets of the ranks as their segments put them, before the residuals."""
    s = segments[np.searchsorted(segments["rank"], ranks, side="right") - 1]
    return s["offset"] + np.floor(s["slope"] * (ranks - s["rank"]) + 0.5).astype(np.int64)


def look_up(segments: np.ndarray, residuals: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Exact byte offsets of the boundaries of the given ranks."""
    return predict(segments, ranks) + residuals[ranks]


def index_boundaries(docs: DataFrame) -> DataFrame:
    """Add the boundary index of ``text``: ``n`` (tokens), ``segments`` and ``residuals`` (one byte a boundary).

    A NULL text counts as empty and has no tokens. Input columns of the added names are replaced;
    repeated rows are indexed each.
    """
    kept = [c for c in docs.columns if c not in INDEX]
    rows = docs.select(*kept, utf8().alias("__text"))
    schema = rows.drop("__text").withColumns({"n": F.lit(0).cast("long"), "segments": F.lit(b""), "residuals": F.lit(b"")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, len(kept)):
            fitted = [fit(boundaries(t)) for t in texts]
            new = [
                pa.array([len(r) - 1 for _, r in fitted], pa.int64()),
                pa.array([s.tobytes() for s, _ in fitted], pa.binary()),
                pa.array([r.tobytes() for _, r in fitted], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *new], names=[*kept, *INDEX])

    return rows.mapInArrow(run, schema)


def _draws(seed: int) -> list[Column]:
    """The first four 8-digit groups, as numbers, of the hex SHA-256 of ``seed:doc_id``."""
    digest = F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "UTF-8"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"__h{i + 1}") for i in range(4)]


def form_of(text: bytes, h3: int, h4: int, infill: int, suffix_first: int) -> str:
    """``plain``, ``spm`` (suffix first) or ``psm``; texts that hold a marker stay plain."""
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= infill:
        return "plain"
    return "spm" if h4 % 100 < suffix_first else "psm"


def fill_in_middle(docs: DataFrame, seed: int = SEED, infill: int = INFILL_PERCENT, suffix_first: int = SUFFIX_FIRST_PERCENT) -> DataFrame:
    """Rearranged texts: the other columns, then ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    Two token ranks drawn from ``seed`` and ``doc_id`` cut each text in three. The boundary index of
    ``index_boundaries`` is used where ``docs`` carries it, else it is fitted on the way; either way the
    cuts come out of it. ``infill`` is the percentage of texts that are cut, ``suffix_first`` that of
    the cut ones whose suffix leads. NULL and empty texts and texts with a marker are ``plain``, their
    output is the text itself (empty for NULL) and the two lengths are NULL. A NULL id draws like an
    empty one; repeated rows are cut alike. ``text`` gives way to ``output``; input columns of the
    added names are replaced.
    """
    added = ["n", "form", "prefix_chars", "middle_chars", "output"]
    indexed = all(c in docs.columns for c in INDEX)
    kept = [c for c in docs.columns if c not in [*added, *INDEX, "text"]]
    index = [F.col("segments"), F.col("residuals")] if indexed else []
    rows = docs.select(*kept, *_draws(seed), utf8().alias("__text"), *index)
    empty = docs.select(*kept, F.lit(0).cast("long").alias("n"), F.lit("").alias("form"), *[F.lit(None).cast("long").alias(c) for c in added[2:4]])
    schema = empty.withColumn("output", F.lit(b"")).schema
    at = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, at + 4):
            draws = np.array([np.asarray(part.column(at + i)) for i in range(4)], np.int64)
            counts, forms, before, between, outputs = [], [], [], [], []
            for i, text in enumerate(texts):
                if indexed:
                    segments = np.frombuffer(part.column(at + 5)[i].as_py(), SEGMENT)
                    residuals = np.frombuffer(part.column(at + 6)[i].as_py(), np.int8)
                else:
                    segments, residuals = fit(boundaries(text))
                n = len(residuals) - 1
                h1, h2, h3, h4 = draws[:, i].tolist()
                form = form_of(text, h3, h4, infill, suffix_first)
                counts.append(n)
                forms.append(form)
                if form == "plain":
                    before.append(None)
                    between.append(None)
                    outputs.append(text)
                    continue
                a, b = look_up(segments, residuals, np.sort([h1 % (n + 1), h2 % (n + 1)])).tolist()
                prefix, middle, suffix = text[:a], text[a:b], text[b:]
                before.append(len(prefix.decode()))
                between.append(len(middle.decode()))
                outputs.append(b"".join([PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle] if form == "psm" else [SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle]))
            new = [pa.array(counts, pa.int64()), pa.array(forms, pa.string()), pa.array(before, pa.int64()), pa.array(between, pa.int64()), pa.array(outputs, pa.binary())]
            yield pa.RecordBatch.from_arrays([*part.columns[:at], *new], names=[*kept, *added])

    return rows.mapInArrow(run, schema).withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text before the transformation.

    Only the three markers of a cut text match: the text holds none, and no marker can begin in one
    part and end in another, as no marker's end is another's beginning.
    """
    parts = F.split(output, "<[PSM]>")
    a, b, c = F.get(parts, F.lit(1)), F.get(parts, F.lit(2)), F.get(parts, F.lit(3))
    return F.when(form == "psm", F.concat(a, c, b)).when(form == "spm", F.concat(b, c, a)).otherwise(output)


ORACLE = r"""
with d as (select doc_id, coalesce(text, '') as t, sha256('42:' || coalesce(doc_id::varchar, '')) as h from documents),
u as (select *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as units from d),
r as (select *, len(units) as n, ('0x' || substr(h, 1, 8))::bigint % (len(units) + 1) as r1, ('0x' || substr(h, 9, 8))::bigint % (len(units) + 1) as r2,
             ('0x' || substr(h, 17, 8))::bigint % 100 as r3, ('0x' || substr(h, 25, 8))::bigint % 100 as r4 from u),
p as (select doc_id, t, n, array_to_string(units[1:least(r1, r2)], '') as pre, array_to_string(units[least(r1, r2) + 1:greatest(r1, r2)], '') as mid,
             array_to_string(units[greatest(r1, r2) + 1:n], '') as suf,
             case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or r3 >= 50 then 'plain' when r4 < 80 then 'spm' else 'psm' end as form from r)
select doc_id, n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
       sha256(t) as restored_sha256
from p
"""


def _sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


@query("op11_boundary_index", ORACLE)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    cut = fill_in_middle(documents(spark, sf).select("doc_id", "text"))
    return cut.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        _sha256(F.col("output")).alias("output_sha256"),
        _sha256(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
