import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from trialspark.llm import pieces
from trialspark.llm.pieces import LATTICE, VOCABULARY, common_from, common_units, decode, decode_ids, encode, encode_units, merge_ids, op3, units_of, words_of

MODEL = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(VOCABULARY))
ODD = ["", " ", "   ", "\n\n", "a  b", "  Hello   world\n\n\tfoo éàç 你 🙂 \xa0b", "x" * 500, "abc" * 200 + " d", "don't stop", "▁mark", "é", "ﬁ Ａ", " lead", "trail ", "123456 7.5%!!"]


def test_units_join_to_the_marked_text_and_merge_alone():
    for t in ODD:
        units = [u for w in words_of(t) for u in units_of(w)]
        assert "".join(units) == ("▁" + t.replace(" ", "▁") if t else "")
        assert [i for u in units for i in merge_ids(u)] == MODEL.encode(t)


@pytest.mark.parametrize("limit", [0, 30, 1 << 20])
def test_whole_texts_give_the_ids_of_the_library(spark, limit):
    rng = np.random.default_rng(limit)
    letters = list("aeinorst  ÉñTh.,\n你")
    texts = [None, *ODD, *("".join(rng.choice(letters, int(rng.integers(1, 200)))) for _ in range(60)), "the cat " * 20000]
    df = spark.createDataFrame([(i % 70, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], r["n_bytes"], tuple(r["ids"])) for r in encode(df, limit=limit, bucket_bytes=5000).collect())
    assert got == sorted((i % 70, len((t or "").encode()), tuple(MODEL.encode(t or ""))) for i, t in enumerate(texts))
    assert encode(df.limit(0), limit=limit).count() == 0


def test_fold_of_units_and_frequent_units(spark):
    units = sorted({u for t in ODD for w in words_of(t) for u in units_of(w)} | {w for t in ODD for w in words_of(t) if w} | {"▁international", "▁▁▁▁▁", "zzzz", "▁thethethe"})
    got = {r["unit"]: r["ids"] for r in encode_units(spark.createDataFrame([(u,) for u in units], "unit string")).collect()}
    assert got == {u: merge_ids(u) for u in units}
    counts = spark.createDataFrame([(str(i), 1 + 100 * (i < 5)) for i in range(50)], "unit string, n long")
    assert [common_from(counts, k) for k in (3, 5, 49, 50)] == [1 << 62, 101, 101, 1]


def test_decoding_gives_the_text_back(spark):
    for t in ODD:
        if "▁" not in t:
            assert decode_ids(MODEL.encode(t)) == t
    df = spark.createDataFrame([(1, MODEL.encode("a é b"), "z"), (2, None, "z"), (3, [], "z")], "doc_id long, ids array<int>, text string")
    assert [tuple(r) for r in decode(df).orderBy("doc_id").collect()] == [(1, "a é b"), (2, None), (3, "")]


def test_query_against_the_library(spark, sf):
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = MODEL.encode(r["text"])
        want[r["doc_id"]] = (len(r["text"].encode()), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest())
    got = {r["doc_id"]: tuple(r)[1:] for r in op3(spark, sf).collect()}
    assert got == want


def test_long_units_are_joined_and_not_broadcast(spark):
    rows = [("z" * (LATTICE + 1), 90), ("é" * LATTICE, 80), ("a", 70), ("x" * 100000, 60), ("b", 1)]
    counts = spark.createDataFrame(rows, "unit string, n long")
    assert {r["unit"] for r in common_units(counts).collect()} == {"é" * LATTICE, "a", "b"}
    assert {r["unit"] for r in common_units(counts, 2).collect()} == {"é" * LATTICE, "a"}
    texts = ["x" * 3000, "the " + "x" * 3000, "end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["ids"] for r in encode(df).collect()} == {i: MODEL.encode(t) for i, t in enumerate(texts)}


def test_marks_beside_blanks_and_blocks_of_any_size(spark, monkeypatch):
    texts = ["n▁ ▁\n", "a▁ ▁ b", " ▁ ▁▁ the", "▁", "▁ ", *ODD]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["ids"] for r in encode(df).collect()} == {i: MODEL.encode(t) for i, t in enumerate(texts)}
    whole, n = pieces.cut_texts([t.encode() for t in texts])
    monkeypatch.setattr(pieces, "CUT_BYTES", 3)
    parts, m = pieces.cut_texts([t.encode() for t in texts])
    assert whole.equals(parts) and n.tolist() == m.tolist()
    assert "".join(whole.to_pylist()) == "".join("▁" + t.replace(" ", "▁") if t else "" for t in texts)


def test_fold_takes_whole_blocks():
    units = sorted({u for t in ODD for w in words_of(t) for u in units_of(w) if len(u) <= LATTICE} | {"zzzz", "▁thethethe", "é" * LATTICE, "▁" * 7})
    assert pieces.fold(units).to_pylist() == [merge_ids(u) for u in units]
    assert pieces.fold([]).to_pylist() == []
