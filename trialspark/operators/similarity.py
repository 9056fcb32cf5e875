"""Pairwise similarity inside batches.

The work unit is a batch of entities, as when a model compares the members of a training batch;
``batched`` cuts a table into batches of a fixed size, which keeps the number of pairs linear in
the rows. A batch may also be larger: its members are cut into blocks in order of their norm, and a task
holds one block while the other members stream past it. What leaves a task is bounded by the
members: the k nearest of each, the pairs above a threshold, or sums for an alignment score. Only
``gram`` and what is named after a full table give all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.functions import expressions as X
from trialspark.operators import ordering as O
from trialspark.operators.features import allele_freq
from trialspark.schema import TrialError
from trialspark.shared import materialize

# Fixed values that results depend on.
GRM_EPS, NORM_EPS = 1e-6, 1e-12
GRM_DIAG_MIN, GRM_CLAMP = 0.1, (-1.0, 2.0)
TEMPERATURE_MIN = 1e-6
BLOCK = 512
DIGITS = 9  # similarities are compared after rounding, so that the order of summation cannot matter


def batched(df: DataFrame, key: str, size: int, seed: int = 42, out: str = "batch") -> DataFrame:
    """Assign every row to a batch of ``size`` rows (the last one may be short) in digest order."""
    if size < 1:
        raise TrialError("batch size must be positive")
    ordered = O.positions(df.withColumn("__h", X.hash_order(seed, key)), [], [F.col("__h"), F.col(key)], "__pos")
    return ordered.withColumn(out, F.expr(f"(__pos - 1) div {size}")).drop("__h", "__pos")


def _block_products(vectors: list[str]) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cols = ["batch", "i", "j"] + [f"{t}_{v}" for v in vectors for t in ("dot", "ii", "jj")]
        if left.empty or right.empty:
            return pd.DataFrame(columns=cols)
        left, right = left.sort_values("place"), right.sort_values("place")
        same = left["block"].iloc[0] == right["block"].iloc[0]
        a, b = np.triu_indices(len(left)) if same else np.divmod(np.arange(len(left) * len(right)), len(right))
        out = {"batch": left["batch"].iloc[0], "i": left["key"].to_numpy()[a], "j": right["key"].to_numpy()[b]}
        for v in vectors:
            x = np.vstack(left[v].to_numpy()).astype("float64")
            y = np.vstack(right[v].to_numpy()).astype("float64")
            out[f"dot_{v}"] = (x @ y.T)[a, b]
            out[f"ii_{v}"] = np.einsum("ij,ij->i", x, x)[a]
            out[f"jj_{v}"] = np.einsum("ij,ij->i", y, y)[b]
        return pd.DataFrame(out, columns=cols)

    return run


def gram(df: DataFrame, key: str, vectors: str | list[str], batch: str = "batch", block: int = BLOCK) -> DataFrame:
    """Upper triangle (with diagonal) of the products of all members of each batch.

    Columns ``batch, i, j`` with i before j in key order, and per vector column the dot product
    and both squared norms.
    """
    vectors = [vectors] if isinstance(vectors, str) else vectors
    base, rows = O.counted(df.select(F.col(batch).cast("long").alias("batch"), F.col(key).alias("key"), *vectors))
    places = O.positions(base.select("batch", "key"), ["batch"], [F.col("key")], "place", known=rows)
    placed = materialize(base.join(places, ["batch", "key"]).withColumn("block", F.expr(f"(place - 1) div {block}")))
    sizes = placed.groupBy("batch").agg((F.max("block") + 1).alias("n_blocks"))
    # a block is the left partner of itself and later blocks, and the right partner of earlier ones
    sized = placed.join(sizes, "batch")
    left = sized.withColumn("other", F.explode(F.sequence("block", F.col("n_blocks") - 1))).withColumns({"lb": F.col("block"), "rb": F.col("other")})
    right = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("block")))).withColumns({"lb": F.col("other"), "rb": F.col("block")})
    kt = dict(base.dtypes)["key"]
    schema = f"batch bigint, i {kt}, j {kt}, " + ", ".join(f"dot_{v} double, ii_{v} double, jj_{v} double" for v in vectors)
    keep = ["batch", "lb", "rb", "key", "place", "block", *vectors]
    # both sides come from one table, so the right one gets columns of its own
    right = right.select(*[F.col(c).alias(c) for c in keep])
    grouped = left.select(*keep).groupBy("batch", "lb", "rb").cogroup(right.groupBy("batch", "lb", "rb"))
    return grouped.applyInPandas(_block_products(vectors), schema)


# -- vector preparation ------------------------------------------------------------------

def thermometer(dose: str | Column) -> Column:
    """Dosage 0/1/2 as the bits [d ≥ 1] then [d ≥ 2], scaled so that the squared distance of two
    such vectors is half the mean absolute dosage difference."""
    d = F.col(dose) if isinstance(dose, str) else dose
    on = F.lit(1.0) / F.sqrt(F.lit(2.0) * F.size(d))
    bits = [
        F.transform(d, lambda x: F.when(x >= F.lit(1), on).otherwise(F.lit(0.0))),
        F.transform(d, lambda x: F.when(x >= F.lit(2), on).otherwise(F.lit(0.0))),
    ]
    return F.concat(*bits)


def with_grm_vector(df: DataFrame, dose: str = "dosage", batch: str = "batch", out: str = "z") -> DataFrame:
    """Centred, scaled dosages of each batch, divided by √(valid markers), so that products are
    relationship coefficients."""
    half = df.withColumn("__half", F.transform(dose, lambda x: x.cast("double") / 2.0))
    freq = allele_freq(half, [batch], "__half")
    p = F.col("freq")
    valid = (p > GRM_EPS) & (p < 1.0 - GRM_EPS)
    stats = freq.groupBy(batch).agg(
        F.sort_array(F.collect_list(F.struct("marker", p.alias("p"), F.sqrt(F.lit(2.0) * p * (F.lit(1.0) - p) + GRM_EPS).alias("s"), valid.alias("ok")))).alias("__st"),
        F.sqrt(F.greatest(F.count_if(valid), F.lit(1)).cast("double")).alias("__m"),
    )
    z = F.zip_with(dose, "__st", lambda d, s: F.when(s["ok"], (d.cast("double") - F.lit(2.0) * s["p"]) / s["s"]).otherwise(F.lit(0.0)))
    joined = df.join(stats, batch).withColumn("__z", z)
    return joined.withColumn(out, F.transform("__z", lambda v: v / F.col("__m"))).drop("__st", "__m", "__z")


def centred(vector: str | Column) -> Column:
    """Vector minus its own mean."""
    v = F.col(vector) if isinstance(vector, str) else vector
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(v)
    return F.transform(v, lambda x: x.cast("double") - mean)


def _cosine(v: str) -> Column:
    ni = F.greatest(F.sqrt(f"ii_{v}"), F.lit(NORM_EPS))
    nj = F.greatest(F.sqrt(f"jj_{v}"), F.lit(NORM_EPS))
    return F.col(f"dot_{v}") / (ni * nj)


def _prepare(df: DataFrame, kind: str, vector: str, batch: str, out: str) -> DataFrame:
    if kind == "ibs":
        return df.withColumn(out, thermometer(vector))
    if kind == "grm":
        return with_grm_vector(df, vector, batch, out)
    if kind == "cosine":
        return df.withColumn(out, F.col(vector))
    if kind == "correlation":
        return df.withColumn(out, centred(vector))
    raise TrialError(f"unknown similarity: {kind}")


def _similarity(kind: str, v: str) -> Column:
    if kind == "ibs":
        return F.lit(1.0) - (F.col(f"ii_{v}") + F.col(f"jj_{v}") - F.lit(2.0) * F.col(f"dot_{v}"))
    if kind == "grm":
        return F.col(f"dot_{v}")
    return _cosine(v)


def _pairs(df: DataFrame, kind: str, key: str, vector: str, batch: str, block: int) -> DataFrame:
    ready = _prepare(df, kind, vector, batch, "v")
    return gram(ready, key, "v", batch, block).select("batch", "i", "j", _similarity(kind, "v").alias("sim"))


def ibs(df: DataFrame, key: str = "vec_id", dose: str = "dosage", batch: str = "batch", block: int = BLOCK) -> DataFrame:
    """Identity by state: one minus half the mean absolute dosage difference."""
    return _pairs(df, "ibs", key, dose, batch, block)


def grm(df: DataFrame, key: str = "vec_id", dose: str = "dosage", batch: str = "batch", block: int = BLOCK) -> DataFrame:
    """Genomic relationship of batch members with the batch's own allele frequencies."""
    return _pairs(df, "grm", key, dose, batch, block)


def env_similarity(df: DataFrame, method: str = "cosine", key: str = "env", vector: str = "features", batch: str = "batch", block: int = BLOCK) -> DataFrame:
    """Cosine or correlation of feature vectors."""
    if method not in ("cosine", "correlation"):
        raise TrialError(f"unknown method: {method}")
    return _pairs(df, method, key, vector, batch, block)


# -- one block against a stream of members ------------------------------------------------

def _norm_blocks(df: DataFrame, key: str, vectors: list[str], batch: str, block: int) -> DataFrame:
    """Members with the norm of their last vector and their place and block in norm order, written once."""
    norm = F.sqrt(F.aggregate(vectors[-1], F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    doubles = [F.transform(v, lambda x: x.cast("double")).alias(v) for v in vectors]
    base, rows = O.counted(df.select(F.col(batch).cast("long").alias("batch"), F.col(key).alias("key"), *doubles, norm.alias("norm")))
    places = O.positions(base.select("batch", "key", "norm"), ["batch"], [F.col("norm"), F.col("key")], "place", known=rows).drop("norm")
    return materialize(base.join(places, ["batch", "key"]).withColumn("block", F.expr(f"(place - 1) div {block}")))


def _streamed(placed: DataFrame, vectors: list[str], start: Callable, schema: str, met: DataFrame | None = None, extra: list[str] | None = None) -> DataFrame:
    """Let every block meet the members of its batch, nearest norms first, and give what its fold returns.

    ``start(keys, places, vectors, extra)`` makes the fold of a block; its ``take(keys, places, norms, vectors)``
    is called for runs of members, the block's own ones first, and ``rows()`` gives the result as a dict
    of columns, at the end and whenever it likes by ``ready()``. ``met`` limits the block pairs (``batch, lb, block``).
    """
    extra = extra or []
    if met is None:
        sizes = placed.groupBy("batch").agg((F.max("block") + 1).alias("n_blocks"))
        pairs = placed.join(sizes, "batch").withColumn("lb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    else:
        pairs = placed.join(met, ["batch", "block"])
    far = F.abs(F.col("block") - F.col("lb"))
    ordered = pairs.select("batch", "lb", far.alias("far"), "place", "key", "norm", *vectors, *extra).repartition("batch", "lb").sortWithinPartitions("batch", "lb", "far", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, own, fold = None, [], None

        def opened() -> object:
            """The fold of the block whose own members have all been seen, with these members taken."""
            keys, places, norms = (np.concatenate([o[i] for o in own]) for i in range(3))
            vecs = [np.concatenate([o[3][v] for o in own]) for v in range(len(vectors))]
            made = start(keys, places, vecs, own[0][4])
            made.take(keys, places, norms, vecs)
            return made

        def result(f, where: int) -> Iterator[pa.RecordBatch]:
            columns = f.rows()
            if columns is not None:
                n = len(next(iter(columns.values())))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, where)), *map(pa.array, columns.values())], names=["batch", *columns])

        for b in batches:
            ids = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            cut = np.flatnonzero((np.diff(ids[0]) != 0) | (np.diff(ids[1]) != 0) | ((ids[2][1:] == 0) != (ids[2][:-1] == 0))) + 1
            for lo, hi in zip([0, *cut], [*cut, b.num_rows]):
                if lo == hi:
                    continue
                part = b.slice(lo, hi - lo)
                group = (ids[0][lo], ids[1][lo])
                if group != current:
                    if current is not None:
                        yield from result(fold or opened(), current[0])
                    current, own, fold = group, [], None
                member = (
                    part.column(4).to_numpy(zero_copy_only=False),
                    ids[3][lo:hi],
                    part.column(5).to_numpy(),
                    [part.column(6 + v).flatten().to_numpy().reshape(hi - lo, -1) for v in range(len(vectors))],
                    [part.column(6 + len(vectors) + e)[0].as_py() for e in range(len(extra))],
                )
                if ids[2][lo] == 0:
                    own.append(member)
                    continue
                fold = fold or opened()
                fold.take(*member[:4])
                if fold.ready():
                    yield from result(fold, current[0])
        if current is not None:
            yield from result(fold or opened(), current[0])

    return ordered.mapInArrow(run, schema)


def _between(kind: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarities of all rows of ``x`` with all rows of ``y``."""
    dot = x @ y.T
    if kind == "grm":
        return dot
    xx, yy = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    if kind == "ibs":
        return 1.0 - (xx[:, None] + yy[None, :] - 2.0 * dot)
    return dot / (np.maximum(np.sqrt(xx), NORM_EPS)[:, None] * np.maximum(np.sqrt(yy), NORM_EPS)[None, :])


def _norm_bound(kind: str, lo: float, hi: float, other_lo, other_hi):
    """The highest similarity that two members can have whose norms lie in the two ranges."""
    if kind == "grm":
        return hi * other_hi
    if kind == "ibs":
        gap = np.maximum(0.0, np.maximum(lo - other_hi, other_lo - hi))
        return 1.0 - gap * gap
    return np.ones_like(np.asarray(other_hi, dtype=float))


class _Nearest:
    """Per member of a block, the ``k`` most similar others so far; ties go to the smaller key."""

    def __init__(self, kind: str, k: int, keys, places, vectors):
        self.kind, self.k, self.keys, self.places, self.x = kind, k, keys, places, vectors[0]
        norms = np.sqrt(np.einsum("ij,ij->i", self.x, self.x))
        self.lo, self.hi = norms.min(), norms.max()
        self.best = [np.zeros(0)] * len(keys)
        self.who = [keys[:0]] * len(keys)
        self.floor = np.full(len(keys), -np.inf)

    def take(self, keys, places, norms, vectors) -> None:
        if _norm_bound(self.kind, self.lo, self.hi, norms.min(), norms.max()) < self.floor.min() - 10.0 ** (1 - DIGITS):
            return  # no member of this run can be among the k of any member of the block
        sims = np.round(_between(self.kind, self.x, vectors[0]), DIGITS)
        for i in range(len(self.keys)):
            hits = np.flatnonzero((sims[i] >= self.floor[i]) & (places != self.places[i]))
            if len(hits):
                sim, who = np.concatenate([self.best[i], sims[i][hits]]), np.concatenate([self.who[i], keys[hits]])
                order = np.lexsort((who, -sim))[: self.k]
                self.best[i], self.who[i] = sim[order], who[order]
                if len(order) == self.k:
                    self.floor[i] = sim[order[-1]]

    def ready(self) -> bool:
        return False

    def rows(self) -> dict | None:
        count = [len(b) for b in self.best]
        if not sum(count):
            return None
        place = np.concatenate([np.arange(1, c + 1) for c in count])
        return {"i": np.repeat(self.keys, count), "j": np.concatenate(self.who), "sim": np.concatenate(self.best), "place": place}


class _Above:
    """Pairs of a block with members of equal or later place whose similarity reaches a threshold."""

    def __init__(self, kind: str, least: float, keys, places, vectors):
        self.kind, self.least, self.keys, self.places, self.x, self.found = kind, least, keys, places, vectors[0], []

    def take(self, keys, places, norms, vectors) -> None:
        sims = np.round(_between(self.kind, self.x, vectors[0]), DIGITS)
        a, b = np.nonzero((sims >= self.least) & (places[None, :] > self.places[:, None]))
        if len(a):
            self.found.append((self.keys[a], keys[b], sims[a, b]))

    def ready(self) -> bool:
        return sum(len(f[0]) for f in self.found) > BLOCK * BLOCK

    def rows(self) -> dict | None:
        if not self.found:
            return None
        x, y, sim = (np.concatenate([f[c] for f in self.found]) for c in range(3))
        self.found = []
        return {"i": np.minimum(x, y), "j": np.maximum(x, y), "sim": sim}


def nearest(df: DataFrame, kind: str, k: int, key: str = "vec_id", vector: str = "dosage", batch: str = "batch", block: int = BLOCK) -> DataFrame:
    """The ``k`` most similar other members of each member: ``batch, i, j, sim, place``.

    ``kind`` is ibs, grm, cosine or correlation. Similarities are compared after rounding to nine
    digits, equal ones in key order. Members of a batch with no other have no row. At most ``k``
    rows a member leave Python; runs of members whose norms rule them out are not multiplied.
    """
    if k < 1:
        raise TrialError("k must be positive")
    placed = _norm_blocks(_prepare(df, kind, vector, batch, "v"), key, ["v"], batch, block)
    kt = dict(placed.dtypes)["key"]
    return _streamed(placed, ["v"], lambda keys, places, v, _: _Nearest(kind, k, keys, places, v), f"batch bigint, i {kt}, j {kt}, sim double, place bigint")


def similar_above(df: DataFrame, kind: str, least: float, key: str = "vec_id", vector: str = "dosage", batch: str = "batch", block: int = BLOCK) -> DataFrame:
    """All pairs of different members with a similarity of ``least`` or more: ``batch, i, j, sim`` with i before j.

    Pairs of blocks whose norms rule that out never meet: identity by state falls by the squared
    difference of the norms and a relationship is at most their product (cosines have no such bound).
    """
    placed = _norm_blocks(_prepare(df, kind, vector, batch, "v"), key, ["v"], batch, block)
    blocks = placed.groupBy("batch", "block").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi"))
    left, right = blocks.toDF("batch", "lb", "llo", "lhi"), blocks
    gap = F.greatest(F.lit(0.0), F.col("llo") - F.col("hi"), F.col("lo") - F.col("lhi"))
    bound = {"ibs": 1.0 - gap * gap, "grm": F.col("lhi") * F.col("hi")}.get(kind, F.lit(1.0))
    reach = (F.col("block") == F.col("lb")) | ((F.col("block") > F.col("lb")) & (bound >= least - 10.0 ** (1 - DIGITS)))
    met = left.join(right, "batch").filter(reach).select("batch", "lb", "block")
    kt = dict(placed.dtypes)["key"]
    return _streamed(placed, ["v"], lambda keys, places, v, _: _Above(kind, least, keys, places, v), f"batch bigint, i {kt}, j {kt}, sim double", met)


class _Alignment:
    """Sums over a block's rows of the two similarity tables, one row a member.

    ``mse``: squared differences off the diagonal; ``cosine``: products; ``kl``: running maxima and sums of
    exponentials, rescaled when a maximum rises, so that no pass over pairs is needed before.
    """

    def __init__(self, kind: str, loss: str, temperature: float, keys, places, vectors, scale: float):
        self.kind, self.loss, self.temperature, self.scale = kind, loss, temperature, scale
        self.keys, self.places, (self.e, self.t) = keys, places, vectors
        self.sums = np.zeros((4, len(keys)))
        self.peak = np.full((2, len(keys)), -np.inf)

    def take(self, keys, places, norms, vectors) -> None:
        e, t = _between("cosine", self.e, vectors[0]), _between(self.kind, self.t, vectors[1])
        if self.loss == "mse":
            if self.kind == "grm":
                t = np.clip(t / self.scale, *GRM_CLAMP)
            elif self.kind == "ibs":
                t = 2.0 * t - 1.0
            else:
                t = np.clip(t, -1.0, 1.0)
            d = np.where(places[None, :] == self.places[:, None], 0.0, e - t)
            self.sums[0] += (d * d).sum(axis=1)
        elif self.loss == "cosine":
            for i, x in enumerate((e * t, e * e, t * t)):
                self.sums[i] += x.sum(axis=1)
        else:
            e, t = e / self.temperature, t / self.temperature
            peak = np.maximum(self.peak, np.stack([e.max(axis=1), t.max(axis=1)]))
            with np.errstate(invalid="ignore"):
                shrink = np.where(np.isneginf(self.peak), 0.0, np.exp(self.peak - peak))
            pe, pt = np.exp(e - peak[0][:, None]), np.exp(t - peak[1][:, None])
            self.sums[0] = self.sums[0] * shrink[0] + pe.sum(axis=1)
            self.sums[1] = self.sums[1] * shrink[1] + pt.sum(axis=1)
            self.sums[2] = self.sums[2] * shrink[1] + (pt * e).sum(axis=1)
            self.peak = peak

    def ready(self) -> bool:
        return False

    def rows(self) -> dict:
        if self.loss == "kl":  # cross entropy of the member's row
            return {"s0": self.peak[0] + np.log(self.sums[0]) - self.sums[2] / self.sums[1], "s1": self.sums[1], "s2": self.sums[2]}
        return {f"s{i}": self.sums[i] for i in range(3)}


def alignment_score(
    df: DataFrame, kind: str, loss: str = "mse", temperature: float = 0.1, key: str = "vec_id", embedding: str = "embedding", target: str = "dosage", batch: str = "batch", block: int = BLOCK
) -> DataFrame:
    """Per batch: how well cosine similarity of embeddings follows the target similarity.

    ``kind`` is grm, ibs, cosine or correlation; ``loss`` is mse (off-diagonal), cosine (of the
    flattened matrices) or kl (row-wise softmax). Environment kinds with fewer than two members
    score 0. A task sees whole rows of both tables block by block and gives one row of sums a member.
    """
    if loss not in ("mse", "cosine", "kl"):
        raise TrialError(f"unknown loss: {loss}")
    ready = _prepare(df, kind, target, batch, "t").withColumn("e", F.col(embedding))
    placed = _norm_blocks(ready, key, ["e", "t"], batch, block)
    env_kind = kind in ("cosine", "correlation")
    if kind == "grm":
        # the target is scaled by its mean diagonal, the mean of the squared norms
        scale = placed.groupBy("batch").agg(F.greatest(F.avg(F.col("norm") * F.col("norm")), F.lit(GRM_DIAG_MIN)).alias("scale"))
        placed = placed.join(scale, "batch")
    else:
        placed = placed.withColumn("scale", F.lit(1.0))
    temp = max(temperature, TEMPERATURE_MIN) if env_kind else temperature

    def start(keys, places, vectors, extra):
        return _Alignment(kind, loss, temp, keys, places, vectors, extra[0])

    members = _streamed(placed, ["e", "t"], start, "batch bigint, s0 double, s1 double, s2 double", extra=["scale"])
    m = members.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("s0", "s1", "s2")])
    value = {
        "mse": F.try_divide("s0", F.col("n") * (F.col("n") - 1)),
        "cosine": F.lit(1.0) - F.try_divide("s0", F.sqrt("s1") * F.sqrt("s2")),
        "kl": F.col("s0") / F.col("n"),
    }[loss]
    return m.select("batch", "n", (F.when(F.col("n") < 2, F.lit(0.0)).otherwise(value) if env_kind else value).alias("loss"))
