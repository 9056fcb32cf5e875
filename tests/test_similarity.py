"""Bounded similarity results against all pairs in numpy, with batches of one and of many blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark.operators import similarity as S


@pytest.fixture(scope="module")
def members():
    g = np.random.default_rng(5)
    out = []
    for batch, n in (("1", 90), ("2", 33), ("3", 1)):
        for i in range(n):
            p = 0.1 + 0.8 * (i % 9) / 8  # norms differ widely, so that bounds have something to rule out
            dosage = g.binomial(2, p, 24).astype(float)
            out.append((f"m{batch}{i:03d}", int(batch), dosage.tolist(), g.normal(size=6).tolist()))
    out += [(f"twin{i}", 2, out[95][2], out[95][3]) for i in range(4)]  # ties
    return out


@pytest.fixture(scope="module")
def df(spark, members):
    return spark.createDataFrame(members, "vec_id string, batch long, dosage array<double>, embedding array<double>").repartition(3)


def table(kind, x):
    if kind == "ibs":
        return 1 - np.abs(x[:, None] - x[None]).mean(axis=2) / 2
    if kind == "grm":
        p = x.mean(axis=0) / 2
        ok = (p > 1e-6) & (p < 1 - 1e-6)
        z = np.where(ok, (x - 2 * p) / np.sqrt(2 * p * (1 - p) + 1e-6), 0)
        return z @ z.T / max(1, ok.sum())
    x = x - x.mean(axis=1, keepdims=True) if kind == "correlation" else x
    norm = np.maximum(np.linalg.norm(x, axis=1), 1e-12)
    return x @ x.T / norm[:, None] / norm[None]


def batches(members):
    for b in {m[1] for m in members}:
        mine = sorted(m for m in members if m[1] == b)
        yield b, [m[0] for m in mine], np.array([m[2] for m in mine]), np.array([m[3] for m in mine])


KINDS = ["ibs", "grm", "cosine", "correlation"]


@pytest.mark.parametrize("block", [7, 512])
@pytest.mark.parametrize("kind", KINDS)
def test_nearest(df, members, kind, block):
    got = {}
    for r in S.nearest(df, kind, 4, block=block).collect():
        got.setdefault((r.batch, r.i), {})[r.place] = (r.j, r.sim)
    n = 0
    for b, keys, x, _ in batches(members):
        sims = np.round(table(kind, x), 9)
        for i, key in enumerate(keys):
            want = sorted((-sims[i, j], keys[j]) for j in range(len(keys)) if j != i)[:4]
            if want:
                n += 1
                mine = got[b, key]
                assert sorted(mine) == list(range(1, len(want) + 1))
                assert np.allclose([-s for s, _ in want], [mine[p][1] for p in sorted(mine)], atol=1e-8)
                if kind == "ibs":  # discrete values: ties are real and go to the smaller key
                    assert [k for _, k in want] == [mine[p][0] for p in sorted(mine)]
    assert n == len(got)


@pytest.mark.parametrize("block", [7, 512])
@pytest.mark.parametrize("kind", KINDS)
def test_pairs_above_a_threshold(df, members, kind, block):
    least = {"ibs": 0.7, "grm": 0.6, "cosine": 0.95, "correlation": 0.4}[kind]
    got = {(r.batch, r.i, r.j): r.sim for r in S.similar_above(df, kind, least, block=block).collect()}
    want = {}
    for b, keys, x, _ in batches(members):
        sims = np.round(table(kind, x), 9)
        want |= {(b, keys[i], keys[j]): sims[i, j] for i in range(len(keys)) for j in range(i + 1, len(keys)) if sims[i, j] >= least}
    assert got.keys() == want.keys() and len(want) > 5
    assert all(abs(got[p] - want[p]) < 1e-8 for p in want)


def test_norms_rule_blocks_out(df, monkeypatch):
    seen = []
    real = S._streamed
    monkeypatch.setattr(S, "_streamed", lambda *a: seen.append(a[4]) or real(*a))
    S.similar_above(df, "ibs", 0.9, block=7).collect()
    met, blocks = seen[0].filter("batch = 1"), 13
    assert met.count() < blocks * (blocks + 1) // 2


@pytest.mark.parametrize("block", [7, 512])
@pytest.mark.parametrize("loss", ["mse", "cosine", "kl"])
@pytest.mark.parametrize("kind", KINDS)
def test_alignment(df, members, kind, loss, block):
    got = {r.batch: (r.n, r.loss) for r in S.alignment_score(df, kind, loss, 0.3, block=block).collect()}
    for b, keys, x, e in batches(members):
        n, e, t = len(keys), table("cosine", e), table(kind, x)
        off = ~np.eye(n, dtype=bool)
        if n < 2 and kind in ("cosine", "correlation"):
            want = 0.0
        elif loss == "mse":
            t = np.clip(t / max(0.1, np.diag(t).mean()), -1, 2) if kind == "grm" else 2 * t - 1 if kind == "ibs" else np.clip(t, -1, 1)
            want = ((e - t)[off] ** 2).mean() if n > 1 else None
        elif loss == "cosine":
            size = np.linalg.norm(e) * np.linalg.norm(t)
            want = 1 - (e * t).sum() / size if size else None
        else:
            a, q = e / 0.3, np.exp(t / 0.3)
            want = (np.log(np.exp(a).sum(axis=1)) - (q / q.sum(axis=1, keepdims=True) * a).sum(axis=1)).mean()
        assert got[b][0] == n
        assert got[b][1] == (None if want is None else pytest.approx(want, abs=1e-9))


def test_what_leaves_python_is_linear_in_the_members(df, members, monkeypatch):
    rows = []
    real = S._streamed

    def counted(*a, **k):
        out = real(*a, **k)
        rows.append(out.count())
        return out

    monkeypatch.setattr(S, "_streamed", counted)
    S.alignment_score(df, "ibs", "kl", block=7)
    S.nearest(df, "ibs", 3, block=7)
    assert rows[0] == len(members) and rows[1] <= 3 * len(members)


def test_empty_and_wrong_arguments(df):
    none = df.limit(0)
    assert S.nearest(none, "ibs", 2).count() == 0 and S.similar_above(none, "grm", 0.1).count() == 0 and S.alignment_score(none, "ibs").count() == 0
    with pytest.raises(S.TrialError):
        S.nearest(df, "ibs", 0)
    with pytest.raises(S.TrialError):
        S.similar_above(df, "euclid", 0.5)
    assert S.nearest(df.withColumn("dosage", F.col("dosage")), "ibs", 1).count() == 127
