import numpy as np
import pytest
from compare import duck

from trialspark.llm import fuse
from trialspark.llm.common import crc_bucket
from trialspark.llm.exact import ORACLE, build_filters, deduplicate, digests, grouped, op1, screen


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 500, 70000])
def test_filter_holds_members_and_few_others(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
    f = fuse.build(keys)
    assert f.holds(keys).all()
    others = rng.integers(1 << 63, (1 << 64) - 1, 50000, dtype=np.uint64)
    assert f.holds(others).mean() < 0.002
    assert n < 5000 or len(f.prints) < 1.5 * n


def test_edge_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "a  b", 5), (4, "a\t\nb", 5), (4, "a b", 5), (None, "c", 5), (7, "é" * 50000, 5), (6, "é" * 50000, 5), (9, "a b ", 5), (None, "a b", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sha int")
    for batches in (1, 2, 5):
        got = {tuple(r)[:4] for r in deduplicate(df, crc_bucket("doc_id", batches), batches).collect()}
        assert got == {(1, 1, 2, True), (2, 1, 2, False), (3, 3, 4, True), (4, 3, 4, False), (None, 3, 4, False), (None, None, 1, True), (7, 6, 2, False), (6, 6, 2, True), (9, 9, 1, True)}
    assert deduplicate(df.limit(0), crc_bucket("doc_id", 2), 2).count() == 0


def test_a_third_of_all_rows_in_one_group(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'same', concat('t', id)) as text")
    got = deduplicate(df, crc_bucket("doc_id", 3), 3)
    assert got.count() == 3000 and got.filter("group_size = 1000 and keep_id = 0").count() == 1000 and got.filter("kept").count() == 2001


def test_screen_passes_every_member(spark):
    df = digests(spark.range(2000).selectExpr("id as doc_id", "string(id) as text"))
    old, new = grouped(df.filter("doc_id < 1200")), grouped(df.filter("doc_id >= 1000"))
    passed = {r["sha"] for r in screen(new, build_filters(old, 3), 3).collect()}
    both = {r["sha"] for r in df.filter("doc_id between 1000 and 1199").collect()}
    assert both <= passed and len(passed) < 210


def test_query_equals_sql(spark, sf):
    got = sorted(map(tuple, op1(spark, sf).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()))
    assert got == sorted(duck(sf).execute(ORACLE).fetchall())
