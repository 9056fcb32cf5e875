import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trialspark.llm.tokens import count_tokens, encode_long, encoder

WORDS = ["and", " the", "\n", "  ", "é", "ñandú", "<|endoftext|>", "don't", "123", "!!", "\t", "字", "🙂", " ", "x" * 40]


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("chunk", [8, 50, 400])
def test_chunks_give_the_ids_of_the_whole_text(seed, chunk):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(seed)
    text = "".join(rng.choice(WORDS[: 4 + seed], 300))
    encode, sizes = encoder("byte_bpe_50k")
    got = np.concatenate(list(encode_long(text, encode, sizes, chunk, 4)))
    assert got.tolist() == own.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["x" * 3000, " " * 3000, "", "<|endoftext|>" * 200])
def test_texts_without_a_stable_boundary_widen_to_the_whole(text):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode, sizes = encoder("byte_bpe_50k")
    got = np.concatenate(list(encode_long(text, encode, sizes, 16, 4)))
    assert got.tolist() == own.encode(text, add_special_tokens=False).ids


def test_counts_with_nulls_long_texts_and_clashing_columns(spark):
    texts = [(1, None, 7), (2, "", 7), (None, "a b", 7), (2, "word " * 40000, 7)]
    df = spark.createDataFrame(texts, "doc_id long, text string, n_tokens int")
    got = [tuple(r) for r in count_tokens(df, "byte_bpe_50k").select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()]
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    long = len(own.encode(texts[3][1]).ids)
    assert sorted(got, key=str) == sorted([(1, 0, 0, False), (2, 0, 0, False), (None, 3, 2, False), (2, 200000, long, True)], key=str)
    assert count_tokens(df.limit(0), "byte_bpe_50k").count() == 0


def test_query_against_the_library(spark, sf):
    from trialspark.llm.tokens import op6

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op6(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        n = len(own.encode(docs[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(docs[r["doc_id"]].encode()), n, n > 512)
