"""Line deduplication by content-defined chunks of lines (DataFrame functions only).

Lines, and inside them sentences, are the units of a text. A rolling hash over neighbouring unit hashes
decides where a chunk ends, so that equal runs of units are cut alike wherever they stand in a document.
Chunks are taken at two scales. Coarse ones end where the rolling hash says so and nothing ended
one unit before, which gives two units or more between boundaries; what they find are long
repeats. Passages rarely begin and end at such a boundary, so what coarse chunks leave is
looked at in the finest chunks that hold more than one unit, the pairs of neighbours: they grow a
repeat to its edges and find short passages. All but the first occurrence go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm.common import documents, query, text_of
from trialspark.shared import gather

UNIT = r"[^\n]*?[.!?] +|[^\n]*\n+|[^\n]+"  # a sentence before a blank, or a line (or its rest) with the line feeds after it
CUT = r"(?=[\s\S])(?:[^\n.!?]+|[.!?](?! ))*+(?:[.!?] +|\n+)?+"  # the same units, each letter matched once
BLANK = " \t\r\n"
DIVISOR = 3
MIN_UNITS = 2
MIN_LETTERS = 24  # of a pair; pairs of shorter units are too common to be passages
PLACE = ["doc_id", "body_key", "a"]
BASE = 31  # of the rolling hash; hashes have 32 bits, so sums stay far inside a long


def units_of(text: Column) -> Column:
    """The text cut into units; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(CUT), F.lit(0))


def _part(digest: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("long")


def _key(unit: Column) -> Column:
    """Digest by which units are compared before their bytes are."""
    return F.xxhash64(unit)


def _candidates(hashes: Column) -> Column:
    """For each unit whether the rolling hash ends something after it."""

    def candidate(h: Column, i: Column) -> Column:
        return (h + F.coalesce(F.get(hashes, i - 1), F.lit(0).cast("long")) * BASE) % DIVISOR == 0

    return F.transform(hashes, candidate)


def _boundaries(candidates: Column) -> Column:
    """Numbers of the units after which a coarse chunk ends."""
    last = F.size(candidates) - 1
    ends = lambda c, i: (i == last) | (c & ~F.coalesce(F.get(candidates, i - 1), F.lit(False)))
    return F.filter(F.transform(candidates, lambda c, i: F.when(ends(c, i), i)), lambda i: i.isNotNull())


def coarse_chunks(docs: DataFrame) -> DataFrame:
    """One row per coarse chunk, without its text: ``doc_id, body_key, n_lines, n_chunks, a, chunk, sizes, after, after_size``.

    ``a`` is the chunk's first unit (from 0), ``chunk`` has the 64-bit digest of each unit without the
    blanks around it, ``sizes`` their letters; ``after`` and ``after_size`` are those of the unit that follows, if any.
    ``n_lines`` and ``n_chunks`` count the units and chunks of the whole text.
    """
    bare = F.transform(units_of(text_of()), lambda u: F.trim(u, F.lit(BLANK)))
    units = docs.select("doc_id", F.xxhash64(text_of()).alias("body_key"), bare.alias("bare"))
    hashes = F.transform("bare", lambda u: _part(F.md5(u), 1, 8))
    units = units.select("doc_id", "body_key", hashes.alias("hashes"), F.transform("bare", _key).alias("keys"), F.transform("bare", F.length).alias("sizes"))
    cut = units.withColumn("candidates", _candidates(F.col("hashes"))).drop("hashes").withColumn("stops", _boundaries(F.col("candidates"))).drop("candidates")
    starts = F.slice(F.concat(F.array(F.lit(0)), F.transform("stops", lambda s: s + 1)), F.lit(1), F.size("stops"))
    bounds = cut.withColumn("bounds", F.arrays_zip(starts.alias("a"), F.col("stops").alias("b")))

    counts = [F.size("keys").alias("n_lines"), F.size("bounds").alias("n_chunks")]
    # what a chunk holds is taken after, in generated code; a plain explode would be preceded by a filter that cuts the text again
    at = bounds.select("doc_id", "body_key", "keys", "sizes", *counts, F.explode_outer("bounds").alias("at")).filter("at is not null")
    a, b = F.col("at.a"), F.col("at.b")
    inside = [F.slice(c, a + 1, b - a + 1).alias(name) for c, name in (("keys", "chunk"), ("sizes", "sizes"))]
    following = [F.get("keys", b + 1).alias("after"), F.get("sizes", b + 1).alias("after_size")]
    return at.select("doc_id", "body_key", "n_lines", "n_chunks", a.alias("a"), *inside, *following)


def _repeats(windows: DataFrame, chunk: list[str]) -> DataFrame:
    """Chunks that occur again, with their first place in order of (doc_id with NULL first, text, unit).

    Occurrences are counted before they are shuffled, so a chunk that a third of all documents hold is one row a task.
    """
    return windows.groupBy(*chunk).agg(F.count("*").alias("n"), F.min(F.struct(*PLACE)).alias("first")).filter("n > 1").drop("n")


def _pairs(chunks: DataFrame) -> DataFrame:
    """Neighbouring units: those inside a chunk that stays, and those across the end of any chunk.

    A pair inside a chunk that goes is never the first of its kind, as the first such chunk stands before it.
    """
    last = F.size("chunk") - 1
    at = chunks.select("*", F.explode(F.sequence(F.when(F.col("gone"), last).otherwise(F.lit(0)), last)).alias("i"))  # filtered after, in generated code
    one, two = F.get("sizes", F.col("i")), F.coalesce(F.get("sizes", F.col("i") + 1), F.col("after_size"))
    wide = at.filter((one > 0) & (two > 0) & (one + two >= MIN_LETTERS))  # NULL after the last unit
    x, y = F.get("chunk", F.col("i")), F.coalesce(F.get("chunk", F.col("i") + 1), F.col("after"))
    return wide.select("doc_id", "body_key", (F.col("a") + F.col("i")).alias("a"), x.alias("x"), y.alias("y"))


def _met(pairs: DataFrame) -> DataFrame:
    """Places of pairs that occur again, and whether another one comes ``first``; counted before they are looked at."""
    several = pairs.groupBy("x", "y").agg(F.count("*").alias("n")).filter("n > 1").select("x", "y")
    met = gather(pairs.join(several, ["x", "y"], "left_semi"))
    first = met.groupBy("x", "y").agg(F.min(F.struct(*PLACE)).alias("first"))
    return met.join(first, ["x", "y"]).withColumn("gone", ~F.struct(*PLACE).eqNullSafe(F.col("first"))).drop("first")


def _unlike(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``key`` of units that are not all the same bytes, among ``places`` (``doc_id, body_key, a, keys``) of what repeats (none are expected)."""
    wanted = places.groupBy("doc_id", "body_key").agg(F.collect_list(F.struct("a", "keys")).alias("places"))
    wanted = wanted.select(F.col("doc_id").alias("__d"), F.col("body_key").alias("__k"), "places")
    keyed = docs.select("doc_id", text_of().alias("text"), F.xxhash64(text_of()).alias("body_key"))
    joined = keyed.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("body_key") == F.col("__k")))

    def units_at(units: Column) -> Column:
        at = lambda p: F.transform(p["keys"], lambda k, i: F.struct(k.alias("key"), F.trim(F.get(units, p["a"] + i), F.lit(BLANK)).alias("unit")))
        return F.flatten(F.transform("places", at))

    # the text is cut once, outside the functions that pick from it
    picked = joined.select(F.explode(F.get(F.transform(F.array(units_of(F.col("text"))), units_at), F.lit(0))).alias("u"))
    bodies = picked.select("u.key", "u.unit").distinct()
    return bodies.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")


def repeated_units(docs: DataFrame) -> DataFrame:
    """What goes: ``doc_id, body_key, n_lines, n_chunks, gone`` (sorted unit numbers) and ``chunks`` (coarse chunks among them), one row a document with units.

    Chunks are compared by the digests of their units, and the digests of all units in repeated chunks by the units' bytes;
    chunks with a unit whose digest stands for different bytes stay. Rows that repeat an id and its text are one document.
    """
    every = gather(coarse_chunks(docs))
    every = every.withColumn("mark", F.xxhash64("chunk"))  # rows are sorted by a number first, by arrays only where it is equal
    long_repeats = gather(_repeats(every.filter(F.size("chunk") >= MIN_UNITS), ["mark", "chunk"]))
    again = F.col("first").isNotNull() & ~F.struct(*PLACE).eqNullSafe(F.col("first"))
    judged = every.join(long_repeats, ["mark", "chunk"], "left").withColumn("gone", again).withColumn("met", F.col("first").isNotNull())
    judged = gather(judged.drop("first", "mark", "n_lines", "n_chunks"))
    met = gather(_met(_pairs(judged)))

    places = judged.filter("met").select("doc_id", "body_key", "a", F.col("chunk").alias("keys"))
    unlike = gather(_unlike(docs, places.unionByName(met.select("doc_id", "body_key", "a", F.array("x", "y").alias("keys")))))
    bad = long_repeats.select("chunk", F.explode("chunk").alias("key")).join(unlike, "key", "left_semi").select("chunk").distinct()
    coarse = judged.filter("gone").select("doc_id", "body_key", "a", "chunk").join(bad, "chunk", "left_anti")
    coarse = coarse.select("doc_id", "body_key", F.sequence(F.col("a"), F.col("a") + F.size("chunk") - 1).alias("units"), F.col("a").alias("chunk"))
    fine = met.filter("gone").join(unlike.withColumnRenamed("key", "x"), "x", "left_anti").join(unlike.withColumnRenamed("key", "y"), "y", "left_anti")
    fine = fine.select("doc_id", "body_key", F.array(F.col("a"), F.col("a") + 1).alias("units"), F.lit(None).cast("int").alias("chunk"))
    whole = every.filter("a = 0").select("doc_id", "body_key", "n_lines", "n_chunks")
    found = coarse.unionByName(fine).unionByName(whole, allowMissingColumns=True).groupBy("doc_id", "body_key")
    counts = [F.max(c).alias(c) for c in ("n_lines", "n_chunks")]
    found = found.agg(*counts, F.flatten(F.collect_list("units")).alias("units"), F.size(F.collect_set("chunk")).alias("chunks"))
    return found.select("doc_id", "body_key", "n_lines", "n_chunks", F.array_sort(F.array_distinct("units")).alias("gone"), "chunks")


def remove_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated chunks cut from ``text``, and counts of what was cut.

    Added columns: ``n_lines`` (units), ``n_chunks`` (coarse chunks), ``n_removed_lines``,
    ``n_removed_chunks``. A NULL text has no units and stays NULL. Rows that repeat both id and text are
    one document: they lose the same units. A text of one unit never loses it, and neither does one
    whose units repeat only one by one. Columns of the added names are replaced.
    """
    added = ["n_lines", "n_chunks", "n_removed_lines", "n_removed_chunks"]
    kept = [c for c in docs.columns if c not in added]
    removed = gather(repeated_units(docs.select("doc_id", "text")))
    own = {"doc_id": "__d", "body_key": "__k", "gone": "__gone", "chunks": "__chunks", "n_lines": "__n_lines", "n_chunks": "__n_chunks"}
    gaps = removed.select(*[F.col(c).alias(name) for c, name in own.items()])
    # the list grows with the documents: one plan at every size, not a broadcast while it is small
    keyed = docs.select(*kept, F.xxhash64(text_of()).alias("__key"))
    joined = keyed.join(gaps.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__key") == F.col("__k")), "left")

    def stay(units: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.greatest(F.size(units) - 1, F.lit(0))), F.col("__gone"))
        return F.array_join(F.transform(left, lambda i: F.get(units, i)), "")

    # the text is cut once, outside the function that picks from it, and only where something goes
    body = F.get(F.transform(F.array(units_of(text_of())), stay), F.lit(0))
    return joined.select(
        *[F.when(F.size("__gone") > 0, body).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in kept],
        F.coalesce("__n_lines", F.lit(0)).alias("n_lines"),
        F.coalesce("__n_chunks", F.lit(0)).alias("n_chunks"),
        F.coalesce(F.size("__gone"), F.lit(0)).alias("n_removed_lines"),
        F.coalesce("__chunks", F.lit(0)).alias("n_removed_chunks"),
    )


ORACLE = rf"""
with d as (select doc_id, coalesce(text, '') as body from documents),
u as (select doc_id, body, unnest(regexp_extract_all(body, '{UNIT}')) as unit, generate_subscripts(regexp_extract_all(body, '{UNIT}'), 1) as i from d),
h as (select *, trim(unit, ' ' || chr(9) || chr(13) || chr(10)) as bare, ('0x' || substr(md5(trim(unit, ' ' || chr(9) || chr(13) || chr(10))), 1, 8))::bigint as h from u),
r as (select *, (h + coalesce(lag(h) over w, 0) * {BASE}) % {DIVISOR} = 0 as candidate, lead(bare) over w as after from h window w as (partition by doc_id, body order by i)),
e as (select *, candidate and not coalesce(lag(candidate) over (partition by doc_id, body order by i), false) as ends from r),
n as (select *, coalesce(sum(ends::int) over (partition by doc_id, body order by i rows between unbounded preceding and 1 preceding), 0) as no from e),
c as (select doc_id, body, no, count(*) >= {MIN_UNITS} as several, string_agg(bare, chr(10) order by i) as chunk, count(*) as size from n group by all),
cg as (select doc_id, body, no, several and row_number() over (partition by several, chunk, size order by doc_id, no) > 1 as gone from c),
p as (select *, coalesce(bare <> '' and after <> '' and length(bare) + length(after) >= {MIN_LETTERS}, false) as wide from n),
pg as (select *, wide and row_number() over (partition by wide, bare, after order by doc_id, i) > 1 as again from p),
g as (select pg.*, cg.gone as chunk_gone, cg.gone or again or coalesce(lag(again) over (partition by doc_id, body order by i), false) as gone from pg join cg using (doc_id, body, no)),
t as (select doc_id, body, count(*)::int as n_lines, count(distinct no)::int as n_chunks, sum(gone::int)::int as n_removed_lines, count(distinct case when chunk_gone then no end)::int as n_removed_chunks,
             coalesce(string_agg(unit, '' order by i) filter (not gone), '') as kept from g group by all)
select doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_chunks, 0) as n_chunks, coalesce(n_removed_lines, 0) as n_removed_lines, coalesce(n_removed_chunks, 0) as n_removed_chunks,
       sha256(coalesce(kept, '')) as kept_sha256
from d left join t using (doc_id, body)
"""


@query("op9_content_defined_lines", ORACLE)
def op9(spark: SparkSession, sf: str) -> DataFrame:
    out = remove_repeated_lines(documents(spark, sf).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_chunks", "n_removed_lines", "n_removed_chunks", F.sha2(F.encode(text_of(), "UTF-8"), 256).alias("kept_sha256"))
