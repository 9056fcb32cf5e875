"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into units wherever two neighbouring characters stand together in no piece, so that no
merge can cross. The distinct units are a table; the substrings of a block of units are matched with
the pieces at once, the matching edges are sorted by unit and rank, and a fold over them gives the units' ids. The model is of the
BPE kind, whose result is not the best-scoring path, so the fold takes the best-ranked edge that
joins two neighbouring symbols, again and again, which gives the library's ids.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from trialspark.llm.common import documents, lean, pieces, query, release_unused, text_of, utf8
from trialspark.llm.substrings import _write
from trialspark.shared import in_few_files

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁".encode()  # stands for a blank, and before a text
LATTICE = 60  # letters of the longest unit whose state fits into the bits of a long
COMMON_UNITS = 1 << 18  # most frequent units, broadcast; all others are joined
BUCKET_BYTES = 8 << 20  # text per group of documents that gets its rare units together
FLUSH = 1 << 20  # counted units that a task holds before it adds them up and hands them over
SLICE_BYTES = 4 << 20  # of texts whose units a task holds at a time
CUT_BYTES = 1 << 18  # of them whose letters are looked at at a time
PACK_LEVEL = 5  # of the texts that travel
BLOCK_UNITS = 1 << 12  # units whose lattice is held at a time


@lru_cache(maxsize=4)
def piece_table(vocabulary: str) -> tuple[list[tuple[str, int, int]], int, int]:
    """(piece, id, rank) of the ordinary pieces, the id of byte 0 and the id for unknown symbols.

    Ranks number the distinct scores from the best; equal scores have equal ranks.
    """
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(vocabulary))
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    ranks = {s: r for r, s in enumerate(sorted({model.get_score(i) for i in plain}, reverse=True))}
    zero = model.piece_to_id("<0x00>")
    assert all(model.piece_to_id(f"<0x{b:02X}>") == zero + b for b in range(256)), "byte pieces must follow each other"
    assert not any("\n" in model.id_to_piece(i) or "▁" in model.id_to_piece(i).lstrip("▁") for i in plain), "a piece crosses units"
    return [(model.id_to_piece(i), i, ranks[model.get_score(i)]) for i in plain], zero, model.unk_id()


def words_of(text: str) -> list[str]:
    """Words of a text without the mark that stands before each, for a blank or for the text's start.

    A word may hold line feeds, and marks in front where several blanks stood.
    """
    words = text.split(" ") if text else []
    if "" not in words:
        return words
    out, blanks = [], 0
    for word in words[:-1]:
        if word:
            out.append("▁" * blanks + word)
            blanks = 0
        else:
            blanks += 1
    return [*out, "▁" * blanks + words[-1]]


@lru_cache(maxsize=4)
def _neighbours(vocabulary: str) -> frozenset[str]:
    """Pairs of characters that stand together in some piece."""
    return frozenset(p[i : i + 2] for p, _, _ in piece_table(vocabulary)[0] for i in range(len(p) - 1))


def units_of(word: str, vocabulary: str = VOCABULARY) -> list[str]:
    """A word with its mark, cut wherever neighbouring characters stand together in no piece."""
    pairs, marked = _neighbours(vocabulary), "▁" + word
    if pairs.issuperset(map(add, marked, marked[1:])):  # nearly all words
        return [marked]
    cuts = [i for i, pair in enumerate(map(add, marked, marked[1:]), 1) if pair not in pairs]
    return [marked[a:b] for a, b in zip([0, *cuts], [*cuts, None])]


@lru_cache(maxsize=4)
def _pair_table(vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
    """A number for each code point (0 for those in no pair), and for two of them whether no piece holds the pair."""
    pairs = _neighbours(vocabulary)
    letters = sorted({c for pair in pairs for c in pair})
    number = np.zeros(0x110000, np.int32)
    number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
    apart = np.ones((len(letters) + 1, len(letters) + 1), bool)
    for x, y in pairs:
        apart[number[ord(x)], number[ord(y)]] = False
    return number, apart


def cut_texts(texts: list[bytes], vocabulary: str = VOCABULARY) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The units of all texts (in UTF-8) in order, and how many each text has; joined they are the marked texts."""
    number, apart = _pair_table(vocabulary)
    marked = [MARK + t.replace(b" ", MARK) if t else t for t in texts]
    stops = np.cumsum([0, *map(len, marked)], dtype=np.int64)  # of texts
    body = b"".join(marked)
    del marked
    at, last, found = 0, 0, []
    while at < len(body):
        end = min(at + CUT_BYTES, len(body))
        while end < len(body) and body[end] & 0xC0 == 0x80:  # not inside a letter
            end += 1
        points = np.frombuffer(body[at:end].decode().encode("utf-32-le"), np.uint32)
        numbers = np.concatenate([[last], number[points]])
        cuts = np.flatnonzero(apart.ravel()[numbers[:-1] * len(apart) + numbers[1:]])
        wide = 1 + (points > 0x7F).view(np.int8) + (points > 0x7FF).view(np.int8) + (points > 0xFFFF).view(np.int8)
        found.append(at + (np.cumsum(wide, dtype=np.int64) - wide)[cuts])
        at, last = end, numbers[-1]
    places = _distinct(np.concatenate([*found, stops]))
    units = pa.LargeStringArray.from_buffers(len(places) - 1, pa.py_buffer(places), pa.py_buffer(body))
    return units, np.diff(np.searchsorted(places, stops))


def _distinct(numbers: np.ndarray) -> np.ndarray:
    """The different numbers in order; sorting takes a fraction of the time of numpy's hashed ``unique``."""
    numbers = np.sort(numbers)
    return numbers[np.diff(numbers, prepend=-1) > 0]


def unit_counts(rows: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``unit, n`` over all texts; a task adds up before it hands over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                whole = pa.concat_tables(held).group_by("unit").aggregate([("n", "sum")]).sort_by("unit")  # neighbours are alike, which packs better
                held.clear()
                yield from whole.select(["unit", "n_sum"]).rename_columns(["unit", "n"]).to_batches()

        for _, texts in pieces(batches, 0, SLICE_BYTES):
            units = cut_texts(texts, vocabulary)[0].dictionary_encode()
            n = np.bincount(units.indices.to_numpy(), minlength=len(units.dictionary))
            held.append(pa.table([units.dictionary.cast(pa.string()), pa.array(n, pa.int64())], names=["unit", "n"]))
            if sum(t.num_rows for t in held) > FLUSH:
                yield from flush()
        yield from flush()

    return rows.select(utf8().alias("text")).mapInArrow(lean(run), "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


@lru_cache(maxsize=4)
def _trie(vocabulary: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pieces as a trie: a number for each code point, the steps (node, number) in order and where they lead, id and rank of each node (-1 where no piece ends)."""
    table, _, _ = piece_table(vocabulary)
    letters = sorted({c for p, _, _ in table for c in p})
    number = np.zeros(0x110000, np.int64)
    number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
    steps: dict[int, int] = {}
    ends = {}
    for p, i, rank in table:
        node = 0
        for c in p:
            node = steps.setdefault(node << 21 | int(number[ord(c)]), len(steps) + 1)
        ends[node] = i, rank
    keys = np.array(sorted(steps), np.int64)
    ids, ranks = np.full(len(steps) + 1, -1, np.int64), np.full(len(steps) + 1, -1, np.int64)
    for node, (i, rank) in ends.items():
        ids[node], ranks[node] = i, rank
    return number, keys, np.array([steps[k] for k in keys.tolist()], np.int64), ids, ranks


def lattice(units: list[str], vocabulary: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """Edges of units of up to ``LATTICE`` letters, and the id of each letter alone (-1 where it is no piece).

    An edge is a substring of two letters or more that is a piece, as one number: unit, rank, start, size and id.
    They are sorted by it: each unit's edges stand together, the best rank first and then the leftmost.
    """
    number, keys, leads, ids, ranks = _trie(vocabulary)
    sizes = np.array([len(u) for u in units], np.int64)
    letters = number[np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)]
    unit = np.repeat(np.arange(len(units)), sizes)
    start = np.arange(len(letters)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = np.repeat(sizes, sizes) - start  # letters from here to the unit's end

    def walk(at: np.ndarray, node: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The starts whose substring of ``size`` letters begins a piece, and the nodes they are at."""
        fits = left[at] >= size
        at, node = at[fits], node[fits]
        want = node << 21 | letters[at + size - 1]
        hit = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        known = keys[hit] == want
        return at[known], leads[hit[known]]

    at, node = walk(np.arange(len(letters)), np.zeros(len(letters), np.int64), 1)
    alone = np.full(len(letters), -1, np.int64)
    alone[at] = ids[node]
    edges, size = [np.zeros(0, np.int64)], 1
    while len(at):
        size += 1
        at, node = walk(at, node, size)
        whole = ids[node] >= 0
        a, end = at[whole], node[whole]
        edges.append((((unit[a] << 16 | ranks[end]) << 6 | start[a]) << 6 | size) << 16 | ids[end])
    return np.sort(np.concatenate(edges)), alone


def fold(units: list[str], vocabulary: str = VOCABULARY) -> pa.ListArray:
    """Ids of units of up to ``LATTICE`` letters: in each step every unit joins the first of its edges that can."""
    _, zero, _ = piece_table(vocabulary)
    edges, tokens = lattice(units, vocabulary)
    sizes = np.array([len(u) for u in units], np.int64)
    firsts = np.cumsum(sizes) - sizes  # of the units' letters
    unit, start, size, ids = edges >> 44, edges >> 22 & 63, edges >> 16 & 63, edges & 0xFFFF
    bit = lambda at: np.uint64(1) << at.astype(np.uint64)
    inside = bit(start + size) - bit(start + 1)
    ends = bit(start) | bit(start + size)
    places = bit(sizes + 1) - np.uint64(1)  # between symbols; both ends of a unit are among them
    while len(unit):
        now = places[unit]
        between = now & inside
        alive = ((now & ends) == ends) & (between != 0)  # places only go, so an edge without its ends can never join again
        unit, start, ids, inside, ends, between = (x[alive] for x in (unit, start, ids, inside, ends, between))
        can = np.flatnonzero((between & (between - np.uint64(1))) == 0)
        take = can[np.diff(unit[can], prepend=-1) > 0]  # the first of each unit
        if not len(take):
            break
        places[unit[take]] &= ~inside[take]
        tokens[firsts[unit[take]] + start[take]] = ids[take]
    at = np.repeat(np.arange(len(units)), sizes)
    letter = (np.arange(len(at)) - firsts[at]).astype(np.uint64)
    kept = np.flatnonzero(places[at] >> letter & np.uint64(1))
    found, text = tokens[kept], "".join(units)
    spelled = [text[i].encode() for i in kept[found < 0].tolist()]  # letters in no piece, byte by byte
    wide = np.ones(len(kept), np.int64)
    wide[found < 0] = [len(b) for b in spelled]
    out = np.repeat(found, wide)
    out[out < 0] = np.frombuffer(b"".join(spelled), np.uint8) + np.int64(zero)
    stops = np.cumsum(np.bincount(at[kept], weights=wide, minlength=len(units))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(1, np.int32), stops])), pa.array(out.astype(np.int32)))


def encode_units(units: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``units`` (distinct, in column ``unit``) with their ``ids``: the lattice fold, and a heap of merges for the overlong ones."""
    at = units.columns.index("unit")
    schema = T.StructType([*units.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK_UNITS):
                part = batch.slice(i, BLOCK_UNITS)
                texts = part.column(at).to_pylist()
                short = [u for u in texts if len(u) <= LATTICE]
                ids = fold(short, vocabulary)
                if len(short) < len(texts):
                    long = pa.array([merge_ids(u, vocabulary) for u in texts if len(u) > LATTICE], ids.type)
                    is_long = np.array([len(u) > LATTICE for u in texts])
                    place = np.where(is_long, len(short) + np.cumsum(is_long), np.cumsum(~is_long)) - 1
                    ids = pa.concat_arrays([ids, long]).take(pa.array(place))
                yield pa.record_batch([*part.columns, ids], names=schema.names)

    return units.mapInArrow(lean(run), schema)


def merge_ids(unit: str, vocabulary: str = VOCABULARY) -> list[int]:
    """Ids of one unit of any length, by a heap of possible merges (n·log n)."""
    pieces, zero = _lookup(vocabulary)
    text, n = list(unit), len(unit)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (hit := pieces.get(text[i] + text[j])):
            heapq.heappush(heap, (hit[1], i, len(text[i]) + len(text[j])))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or len(text[i]) + len(text[j]) != size:
            continue
        text[i] += text[j]
        alive[j] = False
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    out: list[int] = []
    for i in range(n):
        if alive[i]:
            hit = pieces.get(text[i])
            out += [hit[0]] if hit else [zero + b for b in text[i].encode()]
    return out


@lru_cache(maxsize=4)
def _lookup(vocabulary: str) -> tuple[dict[str, tuple[int, int]], int]:
    table, zero, _ = piece_table(vocabulary)
    return {p: (i, r) for p, i, r in table}, zero


def common_from(counts: DataFrame, limit: int = COMMON_UNITS) -> int:
    """Smallest count such that at most ``limit`` units have it or more (read off a coarse histogram)."""
    step = F.floor(F.log2("n") * 8)
    rows = counts.groupBy(step.alias("step")).agg(F.count("*").alias("units"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()  # 8 rows per doubling
    total, least = 0, 1 << 62
    for r in rows:
        total += r["units"]
        if total > limit:
            break
        least = r["least"]
    return least


def common_units(counts: DataFrame, limit: int = COMMON_UNITS) -> DataFrame:
    """The rows of units to broadcast: at most ``limit`` frequent ones, none longer than ``LATTICE`` letters."""
    short = counts.filter(F.length("unit") <= LATTICE)
    return short.filter(F.col("n") >= common_from(short, limit))


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = COMMON_UNITS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``doc_id, n_bytes, ids`` for each row of ``docs``: the ids that the library gives the whole text.

    The ids of at most ``limit`` frequent units of up to ``LATTICE`` letters are broadcast; every other unit reaches the documents
    that hold it through joins on the unit and on buckets of documents, whose number grows with the
    text. NULL and empty texts have no ids; repeated rows are encoded each; other columns
    are not read.
    """
    return _encoded(docs, vocabulary, limit, bucket_bytes, False)


def _encoded(docs: DataFrame, vocabulary: str, limit: int, bucket_bytes: int, decoded: bool) -> DataFrame:
    """``encode``, with the digest of what the ids decode to if ``decoded``."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", text_of().alias("text"))
    dictionary = _write(in_few_files(encode_units(unit_counts(rows, vocabulary), vocabulary)), "codes")
    common = _codes(common_units(dictionary, limit).select("unit", "ids").toArrow())
    shared = spark.sparkContext.broadcast(_stored(common))
    total = rows.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    buckets = max(1, -(-total // bucket_bytes))
    bucket = F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int")
    rare = _rare_units(rows.select(bucket.alias("bucket"), utf8().alias("text")), shared, vocabulary)
    coded = rare.join(dictionary.hint("merge"), "unit").select("bucket", "unit", "ids")  # a unit of several slices comes several times
    packed = _packed_texts(rows.select(bucket.alias("bucket"), "doc_id", utf8().alias("text")))
    key = packed.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, n_bytes long, ids array<int>" + (", decoded_sha256 string" if decoded else "")

    def assemble(texts: pa.Table, units: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        known = pa.concat_tables([_loaded(shared), _codes(units.select(["unit", "ids"]))]).combine_chunks()
        unit, code = (known.column(c).combine_chunks() for c in ("unit", "ids"))
        results = []
        for part, bodies in pieces(iter(texts.select(["doc_id", "body"]).to_batches()), 1, SLICE_BYTES // 2):
            raw = [unpack.decompress(b) for b in bodies]
            found, n = cut_texts(raw, vocabulary)
            local = found.dictionary_encode()
            at = pc.index_in(local.dictionary, value_set=unit)
            assert not at.null_count, "a unit has no ids"
            taken = code.take(at).take(local.indices)
            ends = pa.array(taken.offsets.to_numpy()[np.cumsum([0, *n])], pa.int32())
            ids = taken.values if taken.offset == 0 else taken.flatten()
            columns = [part.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.ListArray.from_arrays(ends, ids)]
            results.append(pa.table([*columns, *([_digests(ids, ends, vocabulary)] if decoded else [])], names=names))
        release_unused()
        return pa.concat_tables(results) if results else pa.table([pa.array([], t) for t in types], names=names)

    names = ["doc_id", "n_bytes", "ids", *(["decoded_sha256"] if decoded else [])]
    types = [to_arrow_type(packed.schema["doc_id"].dataType), pa.int64(), pa.list_(pa.int32()), *([pa.string()] if decoded else [])]
    return packed.groupBy("bucket").cogroup(coded.groupBy("bucket")).applyInArrow(assemble, schema)


def _codes(table: pa.Table) -> pa.Table:
    """``unit, ids`` in the types that ``cut_texts`` looks up."""
    return table.cast(pa.schema([("unit", pa.large_string()), ("ids", pa.list_(pa.int32()))]))


def _stored(table: pa.Table) -> bytes:
    """The table as Arrow bytes, which a worker reads without making an object for each unit."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _loaded(shared) -> pa.Table:
    return pa.ipc.open_stream(shared.value).read_all()


def _digests(ids: pa.Array, ends: pa.Array, vocabulary: str) -> pa.Array:
    """Per document the digest of what its ids decode to; the ids' bytes are put together for all at once."""
    whole = _name_array(vocabulary).take(ids)
    stops = np.frombuffer(whole.buffers()[1], np.int64)[np.asarray(ends)]
    raw = whole.buffers()[2]
    body = memoryview(raw or b"")
    return pa.array([sha256(_plain(bytes(body[s:e])).encode()).hexdigest() for s, e in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)], pa.string())


def _rare_units(rows: DataFrame, shared, vocabulary: str) -> DataFrame:
    """``bucket, unit`` for units outside the broadcast ones, once per slice of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = _loaded(shared).column("unit").combine_chunks()
        for part, texts in pieces(batches, 1, SLICE_BYTES):
            found, n = cut_texts(texts, vocabulary)
            units = found.dictionary_encode()
            rare = pc.index_in(units.dictionary, value_set=common).is_null().to_numpy(zero_copy_only=False)
            at = units.indices.to_numpy().astype(np.int64)
            buckets = np.repeat(part.column(0).to_numpy().astype(np.int64), n)
            places = _distinct((buckets << 32 | at)[rare[at]])
            unit = units.dictionary.take(pa.array(places & 0xFFFFFFFF)).cast(pa.string())
            yield pa.record_batch([pa.array((places >> 32).astype(np.int32)), unit], names=["bucket", "unit"])

    return rows.mapInArrow(lean(run), "bucket int, unit string")


def _packed_texts(rows: DataFrame) -> DataFrame:
    """``bucket, doc_id, body``: texts as they travel to their bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=PACK_LEVEL)
        for part, texts in pieces(batches, 2):
            body = pa.array([press.compress(t) for t in texts], pa.binary())
            yield pa.record_batch([part.column(0), part.column(1), body], names=["bucket", "doc_id", "body"])

    return rows.mapInArrow(lean(run), rows.withColumnRenamed("text", "body").schema)


def decode_ids(ids: list[int], vocabulary: str = VOCABULARY) -> str:
    """The text of a run of ids: pieces joined, byte pieces as UTF-8, blanks for marks, front blank off."""
    return _plain(b"".join(map(_names(vocabulary).__getitem__, ids)))


def _plain(raw: bytes) -> str:
    return raw.decode("utf-8", "replace").replace("▁", " ").removeprefix(" ")


@lru_cache(maxsize=4)
def _name_array(vocabulary: str) -> pa.LargeBinaryArray:
    return pa.array(_names(vocabulary), pa.large_binary())


@lru_cache(maxsize=4)
def _names(vocabulary: str) -> list[bytes]:
    """The bytes of each id, in order; ids that stand for no text have none."""
    table, zero, _ = piece_table(vocabulary)
    names = [b""] * (max(zero + 255, *(i for _, i, _ in table)) + 1)
    names[zero : zero + 256] = [bytes([b]) for b in range(256)]
    for p, i, _ in table:
        names[i] = p.encode()
    return names


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Replace ``ids`` by the decoded ``text``; NULL ids give NULL. Other columns pass through."""
    kept = [c for c in encoded.columns if c not in ("ids", "text")]
    rows = encoded.select(*kept, "ids")
    schema = T.StructType([*rows.drop("ids").schema.fields, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if v is None else decode_ids(v, vocabulary) for v in batch.column(len(kept)).to_pylist()]
            yield pa.record_batch([*batch.columns[: len(kept)], pa.array(texts, pa.string())], names=[*kept, "text"])

    return rows.mapInArrow(lean(run), schema)


def encode_decode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, ids, decoded_sha256`` of each document.

    The digest is that of the text where decoding gives it back, as it does for every text without
    the mark U+2581 of its own; NULL counts as empty.
    """
    encoded = _encoded(docs, vocabulary, COMMON_UNITS, BUCKET_BYTES, True)
    return encoded.select("doc_id", "n_bytes", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


@query("op3_piece_lattice")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    out = encode_decode(documents(spark, sf).select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_tokens", F.sha2(F.encode(F.array_join("ids", ","), "UTF-8"), 256).alias("ids_sha256"), "decoded_sha256")
