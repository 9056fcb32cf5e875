import hashlib
import re

import numpy as np
import pytest
from compare import compare

from trialspark.llm.common import REGISTRY
from trialspark.llm.infill import ERROR, boundaries, fill_in_middle, fit, index_boundaries, look_up, predict, restored

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = ["", " ", "\n\t", "a", " a", "a ", "Ünï cödé  🙂 字", "a\x1cb\x00c d", "x" * 5000, "w " * 3000, " " * 4000 + "end", "<P> is here", "a <S", "<M>"]


def slow(doc_id, text):
    units = UNITS.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted([h1 % (len(units) + 1), h2 % (len(units) + 1)])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    if h4 % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_query_equals_sql(spark, con, sf):
    assert compare(spark, con, REGISTRY["op11_boundary_index"], sf) == ""


@pytest.mark.parametrize("text", TEXTS)
def test_boundaries_are_those_of_the_pattern(text):
    ends = np.cumsum([0, *(len(u.encode()) for u in UNITS.findall(text))])
    assert boundaries(text.encode()).tolist() == ends.tolist()


@pytest.mark.parametrize("seed", range(20))
def test_index_is_exact_and_error_bounded(seed):
    rng = np.random.default_rng(seed)
    steps = rng.choice([1, 3, 7, 40, 10**6], rng.integers(1, 20000), p=[0.3, 0.4, 0.2, 0.0999, 0.0001])
    offsets = np.concatenate([[0], np.cumsum(steps)])
    segments, residuals = fit(offsets)
    ranks = np.arange(len(offsets))
    assert (look_up(segments, residuals, ranks) == offsets).all()
    assert np.abs(predict(segments, ranks) - offsets).max() <= ERROR + 1
    rng.shuffle(ranks)
    assert (look_up(segments, residuals, ranks) == offsets[ranks]).all()


def test_even_boundaries_need_one_segment():
    segments, residuals = fit(np.arange(0, 700001, 7))
    assert len(segments) == 1 and residuals.dtype == np.int8


def test_edges_ties_and_clashing_columns(spark):
    rows = [(i, t, "own", i) for i, t in enumerate(TEXTS * 8)] + [(None, "no id here", "own", 1), (5, None, "own", 2), (3, "again", "a", 3), (3, "again", "b", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, tag int")
    out = fill_in_middle(df)
    assert out.columns == ["doc_id", "tag", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = sorted((r.tag, str(r.doc_id), r.n, r.form, str(r.prefix_chars), str(r.middle_chars), r.output) for r in out.collect())
    want = []
    for d, t, _, tag in rows:
        n, form, p, m, output = slow(d, t or "")
        want.append((tag, str(d), n, form, str(p), str(m), output))
    assert got == sorted(want) and {g[3] for g in got} == {"plain", "spm", "psm"}
    back = out.select("tag", restored(out.output, out.form).alias("t")).collect()
    assert sorted((r.tag, r.t) for r in back) == sorted((tag, t or "") for _, t, _, tag in rows)
    assert fill_in_middle(df.limit(0)).count() == 0 and index_boundaries(df.limit(0)).count() == 0


def test_a_stored_index_gives_the_same_cuts_for_any_seed(spark, tmp_path):
    df = spark.createDataFrame([(i, f"some text {i} " * (i % 50)) for i in range(300)], "doc_id long, text string")
    index_boundaries(df).write.parquet(f"{tmp_path}/index")
    stored = spark.read.parquet(f"{tmp_path}/index")
    for seed in (42, 7):
        assert sorted(map(tuple, fill_in_middle(stored, seed, 90, 50).collect()), key=str) == sorted(map(tuple, fill_in_middle(df, seed, 90, 50).collect()), key=str)
