"""Token counts of whole texts, with long texts encoded in overlapping chunks that resynchronise.

A chunk border may fall inside a word, where byte-pair merges differ from those of the whole text. Two
neighbouring chunks overlap, and they are spliced at a boundary that is proven stable: between a
character that isn't white space and a following blank or line feed. The vocabulary's word pattern
lets a word begin with white space but never hold any after another character, and no special token
holds white space, so nothing crosses such a place and neither side depends on what lies beyond it.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm.common import documents, query, text_of

CHUNK = 1 << 16
OVERLAP = 1 << 10
LIMIT = 512
STABLE = re.compile(r"\S(?=[ \n])")
# beyond these letters the word patterns of two libraries may follow different Unicode versions
COMMON = re.compile("[\u0000-ɏ -⁯₠-₿]*")

Encode = Callable[[str], np.ndarray]


@lru_cache(maxsize=4)
def encoder(vocabulary: str) -> tuple[Encode, np.ndarray]:
    """A function from text to ids, and the length in bytes of each id's token.

    The ranks file of the same vocabulary is used for texts of Latin letters, as it is several
    times faster, and the vocabulary's own library for all others; both give the same ids.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(vocabulary + ".tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = Tokenizer.from_file(public_tokenizers.path(vocabulary + ".json"))
    special = {t.content: i for i, t in own.get_added_tokens_decoder().items()}
    fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    sizes = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
    for token, i in [*ranks.items(), *((s.encode(), i) for s, i in special.items())]:
        sizes[i] = len(token)

    def encode(text: str) -> np.ndarray:
        if COMMON.fullmatch(text):
            return np.array(fast.encode(text, allowed_special="all"), np.int64)
        return np.array(own.encode(text, add_special_tokens=False).ids, np.int64)

    return encode, sizes


def encode_long(text: str, encode: Encode, sizes: np.ndarray, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[np.ndarray]:
    """Ids of a text of any length, in runs; memory is bounded by the widest chunk.

    When an overlap has no stable boundary on which both encodings agree, it is doubled, and once it
    would fill the chunk the chunk is doubled too, in the limit to the whole text.
    """
    start, wide, shared = 0, chunk, overlap
    ids = encode(text[:wide])
    while start + wide < len(text):
        end = start + wide
        following = encode(text[end - shared : end - shared + wide])
        cut = _agreed(text, start, end, shared, ids, following, sizes)
        if cut is not None:
            left, right = cut
            yield ids[:left]
            ids = following[right:]
            start = end - shared + len(_decoded_prefix(text, end - shared, following[:right], sizes))
            wide = end - shared + wide - start
            shared = overlap
        elif 2 * shared <= wide:
            shared *= 2
        else:
            wide *= 2
            ids = encode(text[start : start + wide])
    yield ids


def _decoded_prefix(text: str, at: int, ids: np.ndarray, sizes: np.ndarray) -> str:
    """The characters from ``at`` on that the ids cover."""
    n = int(sizes[ids].sum())
    return text[at : at + n].encode()[:n].decode()


def _agreed(text: str, start: int, end: int, shared: int, left: np.ndarray, right: np.ndarray, sizes: np.ndarray) -> tuple[int, int] | None:
    """Token positions in both encodings of the first common stable boundary inside the overlap."""
    from_start = np.cumsum(sizes[left])
    from_overlap = np.cumsum(sizes[right])
    base = len(text[start : end - shared].encode())
    for m in STABLE.finditer(text, end - shared, end - 1):
        b = len(text[end - shared : m.end()].encode())
        i, j = int(np.searchsorted(from_start, base + b)), int(np.searchsorted(from_overlap, b))
        if i < len(left) and j < len(right) and from_start[i] == base + b and from_overlap[j] == b:
            return i + 1, j + 1
    return None


def count_tokens(texts: DataFrame, vocabulary: str, column: str = "text", limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` to the other columns of ``texts``.

    A NULL or empty text has no tokens. Strings of special tokens count as that token, as the
    library does by default. Columns of the same names in the input are replaced.
    """
    added = ["n_bytes", "n_tokens", "over_limit"]
    kept = [c for c in texts.columns if c not in [*added, column]]
    rows = texts.select(*kept, text_of(column).alias("__text"))
    schema = rows.drop("__text").withColumns({"n_bytes": F.lit(0).cast("long"), "n_tokens": F.lit(0).cast("long"), "over_limit": F.lit(False)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sizes = encoder(vocabulary)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for value in batch.column(len(kept)):
                text = value.as_py()
                n_bytes.append(len(text.encode()))
                if len(text) <= chunk:
                    n_tokens.append(len(encode(text)))
                else:
                    n_tokens.append(sum(map(len, encode_long(text, encode, sizes, chunk))))
            out = [batch.column(i) for i in range(len(kept))]
            out += [pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())]
            yield pa.RecordBatch.from_arrays(out, names=kept + added)

    return rows.mapInArrow(run, schema)


@query("op6_overlap_resync")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return count_tokens(documents(spark, sf).select("doc_id", "text"), "byte_bpe_50k")
