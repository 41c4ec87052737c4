"""Approximate nearest neighbours by inner product, with learned partitions.

Of a bounded sample the driver makes a neighbour graph and cuts it into parts of equal
size: a start by recursive median splits, then rounds in which vertices move to the part
that holds most of their neighbours while it has room. A small network learns, from a
vector alone, the shares that its neighbours' parts have. It indexes every
row in its most probable part, and routes a query to the most probable parts until
they hold `mass` of the probability. Parts have about ROWS_PER_PART rows up to MOST_PARTS of them;
beyond that (some million rows) parts grow, as a bounded sample can't tell more apart.
How much a query reads depends on the vectors: nearest() reports it in `shares`. Within a part, blocks of queries meet blocks of rows;
scores are exact, in double precision, and the best of each block are merged. A query's most
probable part is searched first: the other parts give only rows that reach the k-th best score found there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, small_batches, table

TOP, EVERY, SAMPLE, SAMPLE_BYTES = 20, 20, 20_000, 64 << 20
ROWS_PER_PART, LEAST_PARTS, MOST_PARTS, BLOCK, MASS, LEAST_PROBES, SEED = 1000, 8, 1024, 4096, 0.985, 2, 11
NEIGHBOURS, HIDDEN, EPOCHS = 20, 128, 40


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and x (doubles): rows with an id and a finite vector that isn't zero, of the commonest dimension.

    Rows that share a vec_id count as one, with the least of their vectors.
    """
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).filter(finite("x"))
    rows = table(rows.groupBy("vec_id").agg(F.min("x").alias("x")), "vectors")
    dims = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("x") == (dims.d if dims else 0))


def finite(col: str) -> Column:
    return F.exists(col, lambda v: v != 0) & ~F.exists(col, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row by inner product."""
    k, found, x = min(k, len(x) - 1), [], x.astype(np.float32)
    for at in range(0, len(x), 64):  # a few MB at a time
        s = x[at : at + 64] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        found.append(np.argpartition(np.negative(s, out=s), k - 1, axis=1)[:, :k].astype(np.int32) if k > 0 else np.zeros((len(s), 0), np.int32))
    return np.concatenate(found)


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 15, slack: float = 1.05) -> np.ndarray:
    """A part for each vertex of the neighbour graph; none is larger than slack times the mean."""
    part, rng = np.zeros(len(x), int), np.random.default_rng(SEED)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        rows, first, n = todo.pop()
        if n == 1:
            part[rows] = first
            continue
        own = x[rows] - x[rows].mean(axis=0)
        axis = rng.normal(size=x.shape[1])
        for _ in range(8):  # power iteration: the direction of most variance
            axis = own.T @ (own @ axis)
            axis /= np.linalg.norm(axis) + 1e-12
        order, left = rows[np.argsort(own @ axis, kind="stable")], n // 2
        cut = len(rows) * left // n
        todo += [(order[:cut], first, left), (order[cut:], first + left, n - left)]
    room, sizes = int(np.ceil(slack * len(x) / parts)), np.bincount(part, minlength=parts)
    both = np.concatenate([np.c_[np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()], np.c_[near.ravel(), np.repeat(np.arange(len(x)), near.shape[1])]])
    for _ in range(rounds):
        held = np.zeros((len(x), parts), np.float32)
        np.add.at(held, (both[:, 0], part[both[:, 1]]), 1)
        best = held.argmax(axis=1)
        gain = held[np.arange(len(x)), best] - held[np.arange(len(x)), part]
        moved = 0
        for v in np.argsort(-gain, kind="stable").tolist():
            if gain[v] <= 0:
                break
            if sizes[best[v]] < room:
                sizes[part[v]] -= 1
                sizes[best[v]] += 1
                part[v] = best[v]
                moved += 1
        if moved < len(x) // 500:
            break
    return part


class Router:
    """One hidden layer and a softmax over the parts, trained with Adam."""

    def __init__(self, x: np.ndarray, target: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS) -> None:
        rng = np.random.default_rng(SEED)
        self.scale = float(np.sqrt((x**2).sum(axis=1).mean())) or 1.0
        self.w = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, target.shape[1])), np.zeros(target.shape[1])]
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for epoch in range(epochs):
            rate = 0.01 * 0.93**epoch
            order = rng.permutation(len(x))
            for at in range(0, len(x), 256):
                rows = order[at : at + 256]
                a = self._input(x[rows])
                h = np.maximum(a @ self.w[0] + self.w[1], 0)
                err = (self._softmax(h @ self.w[2] + self.w[3]) - target[rows]) / len(rows)
                back = (err @ self.w[2].T) * (h > 0)
                t += 1
                for k, g in enumerate((a.T @ back, back.sum(axis=0), h.T @ err, err.sum(axis=0))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def _input(self, x: np.ndarray) -> np.ndarray:
        return x / self.scale * np.sqrt(x.shape[1])

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._softmax(np.maximum(self._input(x) @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3])


def train(x: np.ndarray, parts: int) -> Router:
    """x: the sample, each vector once."""
    near = neighbours(x, NEIGHBOURS)
    part = balanced_parts(x, near, parts)
    target = np.zeros((len(x), parts), np.float32)
    np.add.at(target, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].ravel()), 1.0)
    target[np.arange(len(x)), part] += near.shape[1] or 1
    return Router(x, target / target.sum(axis=1, keepdims=True))


def _search(k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if queries.num_rows and rows.num_rows:
            q = np.array(queries.column("x").to_pylist(), float)
            x = np.array(rows.column("x").to_pylist(), float)
            qid, rid = (t.column("id").to_numpy() for t in (queries, rows))
            least = queries.column("floor").to_numpy()
            order = np.argsort(rid, kind="stable")
            rid, x = rid[order], x[order]
            _, which = np.unique(x, axis=0, return_inverse=True)  # equal vectors score alike: their k + 1 least ids are enough
            by = np.argsort(which, kind="stable")
            nth = np.arange(len(by)) - np.searchsorted(which[by], which[by])
            keep = np.sort(by[nth <= k])
            x, rid = x[keep], rid[keep]
            for at in range(0, len(q), 256):
                s = q[at : at + 256] @ x.T
                floor = least[at : at + 256].copy()
                if s.shape[1] > k + 1:
                    np.fmax(floor, np.partition(s, -(k + 1), axis=1)[:, -(k + 1)], out=floor)
                for i in range(len(s)):
                    c = np.flatnonzero(s[i] >= floor[i] - 1e-9 * (1 + abs(floor[i]))) if np.isfinite(floor[i]) else np.arange(len(x))
                    c = c[rid[c] != qid[at + i]]
                    exact = (x[c] * q[at + i]).sum(axis=1)  # the same sum for equal vectors, wherever they lie
                    c, exact = c[exact >= least[at + i]], exact[exact >= least[at + i]]
                    best = np.lexsort((rid[c], -exact))[:k]
                    out[0].append(np.full(len(best), qid[at + i]))
                    out[1].append(rid[c][best])
                    out[2].append(exact[best])
        cat = [np.concatenate(o) if o else np.zeros(0) for o in out]
        return pa.table({"query_id": pa.array(cat[0].astype(np.int64)), "vec_id": pa.array(cat[1].astype(np.int64)), "score": pa.array(cat[2].astype(float))})

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int = TOP, mass: float = MASS, sample: int = SAMPLE, shares: list | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows found nearest to each query, other than itself.

    rows and queries: vec_id and x, as valid() gives them. Ties go to the smaller vec_id. Fewer
    rows than k: all of them. No row or no query: an empty result. If the parts a
    query is routed to hold fewer than k rows, it is routed to every part. shares: a list
    that gets the share of all rows that a query meets on average.
    """
    spark = rows.sparkSession
    small_batches(spark, 2000)
    n = rows.count()
    first = rows.first()
    if first is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = max(1, min(sample, SAMPLE_BYTES // (8 * len(first.x))))
    # the rows of the least hashes, wherever they lie; the filter only keeps the others out of the sort
    hashed = F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(1 << 40))
    picked = rows.select(hashed.alias("hash"), "x").filter(F.col("hash") <= int(min(1.0, 1.3 * sample / n + 100 / n) * (1 << 40))).orderBy("hash").limit(sample).collect()
    x = np.unique(np.array([r.x for r in picked] or [first.x], float), axis=0)
    parts = int(max(1, min(max(LEAST_PARTS, -(-n // ROWS_PER_PART)), MOST_PARTS, len(x) // 20)))
    router = train(x, parts)

    @F.pandas_udf("int")
    def home(v: pd.Series) -> pd.Series:
        return pd.Series(router.probabilities(np.stack(v.to_numpy())).argmax(axis=1).astype("int32") if len(v) else [])

    indexed = table(rows.select(F.col("vec_id").alias("id"), "x", home("x").alias("part")), "ann-index")
    counts = {r[0]: r[1] for r in indexed.groupBy("part").count().collect()}  # at most MOST_PARTS

    @F.pandas_udf("array<int>")
    def route(v: pd.Series) -> pd.Series:
        out = []
        for p in router.probabilities(np.stack(v.to_numpy())) if len(v) else []:
            order = np.argsort(-p, kind="stable")
            m = max(LEAST_PROBES, int(np.searchsorted(np.cumsum(p[order]), mass)) + 1)
            out.append(order[:m].astype("int32") if sum(counts.get(int(c), 0) for c in order[:m]) > k else np.arange(parts, dtype="int32"))
        return pd.Series(out, dtype=object)

    routed = table(queries.select(F.col("vec_id").alias("id"), "x", F.posexplode(route("x")).alias("turn", "part")), "ann-routes")
    met: dict[int, int] = {}

    def search(asking: DataFrame) -> DataFrame:
        """The k rows nearest to each query in each block of rows of its part, of those that reach the query's floor."""
        asked = {r[0]: r[1] for r in asking.groupBy("part").count().collect()}  # at most MOST_PARTS
        met.update({p: met.get(p, 0) + m for p, m in asked.items()})
        blocks = [(p, -(-counts.get(p, 0) // BLOCK), -(-asked.get(p, 0) // BLOCK)) for p in range(parts)]
        sizes = F.broadcast(spark.createDataFrame([b for b in blocks if b[1] and b[2]] or [(-1, 1, 1)], "part_ int, row_blocks int, query_blocks int"))  # at most MOST_PARTS rows
        salt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        # a block of queries meets each block of rows of its part, so a hot part is many groups
        at = F.col("part") == F.col("part_")
        left = asking.join(sizes, at).select("part", salt("query_blocks").alias("qb"), every("row_blocks").alias("rb"), "id", "x", "floor")
        right = indexed.join(sizes, at).select("part", every("query_blocks").alias("qb"), salt("row_blocks").alias("rb"), "id", "x")
        return left.groupBy("part", "qb", "rb").cogroup(right.groupBy("part", "qb", "rb")).applyInArrow(_search(k), "query_id long, vec_id long, score double")

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    none = F.lit(float("-inf"))
    first = table(search(routed.filter("turn = 0").withColumn("floor", none)), "ann-first")
    floors = first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    rest = routed.filter("turn > 0").join(floors, "id", "left").withColumn("floor", F.coalesce("kth", none))
    found = first.unionByName(search(rest))
    if shares is not None:
        shares.append(sum(m * counts.get(p, 0) for p, m in met.items()) / (n * max(1, queries.count())))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = valid(load(spark, sf_dir, "embeddings"))
    return nearest(rows, rows.filter(F.col("vec_id") % EVERY == 0))
