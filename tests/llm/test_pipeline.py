import hashlib
import re

import public_tokenizers
import pytest
import sentencepiece
from test_decontaminate import words as item_words
from test_lines import slow as slow_lines

import corpus_pipeline
from trialspark.shared import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], sf)))
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns_and_names(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
    assert all(s.columns == COLUMNS for s in steps[:-1]) and corpus_pipeline.ORACLE_SQL is None


def test_toxic_documents_go_and_others_stay(spark):
    sf = "/root/testdata/sf0.01"  # the smallest tables have nine toxic rows to learn from
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    left = rows(corpus_pipeline.toxicity(spark, docs, sf))
    clean = [d for d, t in labels.items() if not t]
    assert sum(d in left for d in clean) >= 0.98 * len(clean)
    toxic = [d for d, t in labels.items() if t]
    assert sum(d not in left for d in toxic) >= 0.6 * len(toxic)
    all_rows = rows(docs)
    assert all(tuple(r) == tuple(all_rows[d]) for d, r in left.items())


def test_lines_as_by_brute_force(steps):
    want = dict(slow_lines([(r["doc_id"], r["text"]) for r in steps[1].collect()]))
    assert {d: r["text"] for d, r in rows(steps[2]).items()} == want


def test_near_duplicates_keep_texts(steps):
    before, after = rows(steps[2]), rows(steps[3])
    assert set(after) <= set(before) and all(after[d]["text"] == before[d]["text"] for d in after)
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"]) for r in after.values()]
    assert len(set(texts)) == len(texts)


def test_many_partitions_leave_few_files(spark, monkeypatch):
    """Each file that an executor opens may make it launch processes, so files must not follow the partitions."""
    from trialspark import shared

    text = lambda i: " ".join(f"w{i * 7 + k}" for k in range(40)) + ". A line that all of the rows have in common.\n" + f"Copy of number {i // 2} " * 9
    docs = spark.createDataFrame([(i, text(i // 3), "en", "s", 1) for i in range(400)], "doc_id long, text string, lang string, source string, n_chars long").repartition(90)
    most, files = shared.FILES_PER_CORE * spark.sparkContext.defaultParallelism, []

    def seen(df):
        files.append(len(df.inputFiles()))
        return df

    real = shared.materialize
    monkeypatch.setattr(shared, "materialize", lambda df: seen(real(df)))
    monkeypatch.setattr(corpus_pipeline, "materialize", shared.materialize)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(held, ("90", "false"), strict=True):
            spark.conf.set(k, v)
        for stage in (corpus_pipeline.line_dedup, corpus_pipeline.near_dedup):
            docs = corpus_pipeline.materialize(stage(spark, docs, ""))
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert docs.count() < 400 and len(files) > 20 and max(files) <= most


def test_no_benchmark_window_is_left(spark, sf, steps):
    grams = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = item_words(r["text"])
        grams |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    has = lambda t: any(tuple(w[i : i + 10]) in grams for w in [item_words(t)] for i in range(len(w) - 9))
    before, after = rows(steps[3]), rows(steps[4])
    assert any(has(r["text"]) for r in before.values())
    for d, r in before.items():
        if not has(r["text"]):
            assert after[d]["text"] == r["text"]


def test_tokens_are_those_of_the_library(steps):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs, got = rows(steps[4]), rows(steps[5])
    assert set(docs) == set(got)
    for d, r in got.items():
        assert r["ids"] == model.encode(docs[d]["text"]) and r["decoded_sha256"] == hashlib.sha256(docs[d]["text"].encode()).hexdigest()


def test_run_is_the_chain_of_stages(spark, sf, steps):
    got = {r["doc_id"]: tuple(r["ids"]) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == {d: tuple(r["ids"]) for d, r in rows(steps[5]).items()}


def test_columns_named_like_the_operators_own_stay(spark):
    body = "\n".join(f"line {i}" for i in range(40))
    extra = ["lines", "bounds", "n_lines", "n_chunks", "n_removed_lines", "hashes", "ends", "stops", "__key"]
    df = spark.createDataFrame([(1, body, *extra), (2, body, *extra)], ", ".join(["doc_id long", "text string", *(f"{c} string" for c in extra)]))
    got = corpus_pipeline.line_dedup(spark, df, "")
    assert got.columns == df.columns
    left = rows(got)
    assert left[1]["text"] == body and len(left[2]["text"]) < len(body)
    assert all(list(r)[2:] == extra for r in left.values())


def test_near_duplicates_are_the_groups_of_exact_similarity(steps):
    """One text of each group of pairs whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more."""
    sets, root = {}, {}
    for r in steps[2].collect():
        w = r["text"].encode().lower().split()
        k = min(5, len(w))
        sets[r["doc_id"]], root[r["doc_id"]] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set(), r["doc_id"]

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sorted(sets):
        for b in sorted(sets):
            x, y = sets[a], sets[b]
            if a < b and (x == y or len(x & y) >= 0.8 * len(x | y)) and top(a) != top(b):
                root[max(top(a), top(b))] = min(top(a), top(b))
    assert set(rows(steps[3])) == {d for d in sets if top(d) == d} and len(set(map(top, sets))) < len(sets)


def test_benchmark_passages_are_cut_out(spark, sf, steps):
    """Each text loses exactly what stands from the first to the last word of its runs of hit words."""
    grams = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = item_words(r["text"])
        k = min(10, len(w))
        grams |= {tuple(w[i : i + k]) for i in range(len(w) - k + 1) if k}
    want, cut = {}, 0
    for d, r in rows(steps[3]).items():
        found = list(re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r["text"]))  # as item_words, capitals too
        w = item_words(r["text"])
        spans = []
        for k, i in sorted(((k, i) for k in {len(g) for g in grams} for i in range(len(w) - k + 1) if tuple(w[i : i + k]) in grams), key=lambda x: x[1]):
            if spans and i <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], i + k)
            else:
                spans.append([i, i + k])
        text = r["text"]
        for a, b in reversed(spans):
            text = text[: found[a].start()] + text[found[b - 1].end() :]
        cut += bool(spans)
        if not spans or item_words(text):
            want[d] = text
    assert cut and {d: r["text"] for d, r in rows(steps[4]).items()} == want
