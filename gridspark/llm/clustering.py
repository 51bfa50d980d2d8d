"""Centroid clustering with Yinyang grouping.

Centroids are put into groups once, by the first centroids. A vector keeps an upper bound of the distance to its own centroid and,
for each group, a lower bound of the distance to any other centroid of it. Bounds follow the centroids' drift. In a round, a vector
whose upper bound is below all its lower bounds is settled (the global filter); else its own distance is made exact, groups whose
lower bound is still above it are left out (the group filter), and the centroids of the others are scanned exactly. Bounds are
rounded away from the truth, so the filters never change a result; among equal distances the smaller number wins.

All arithmetic on vectors is on whole numbers: components are floor(256 x), sums are exact, centroids are floor(sum / count).

A round is one pass over a table in the shared folder (vector, cluster, bounds), which writes the next and, for each task, at most one
row of sums per centroid. The driver sees centroids and those sums, k rows each, never vectors. Nothing is shuffled but the sums, so
a cluster that holds most vectors costs no task more than another.

Kept are vectors with `dims` components, none of them null or not finite; all others are left out, as are null ones. Components beyond
+-2^27 / 256, and sums of distances beyond a long, raise an error. Null ids count as the empty text in the order of the first
centroids; rows that repeat an id or a vector are rows like any other, and equal hashes are ordered by the vector. With fewer vectors
than k there are as many centroids as vectors; an empty table gives no rows. Extra columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, written

SCALE, LARGEST = 256, 1 << 27
#: Centroids for each group, as the method's authors advise.
GROUP_SIZE = 10
#: Relative room that keeps rounded bounds on their safe side.
ROOM = 2.0**-40
FAR = np.iinfo(np.int64).max
STATE = "vec_id long, v array<int>, cluster int, upper double, lower array<double>, distance long, total array<long>, n long, scanned long"


class Centroids(NamedTuple):
    at: np.ndarray  # (k, dims), whole numbers
    group: np.ndarray  # (k,)
    drift: np.ndarray  # (k,), how far each moved at most, since the bounds were made


def vectors(rows: DataFrame, dims: int = 64) -> DataFrame:
    """(vec_id, v): the vectors that are kept, as whole numbers."""
    x = F.col("embedding")
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    y = F.transform(x, lambda c: F.floor(F.when(F.abs(c.cast("double") * SCALE) < LARGEST, c.cast("double") * SCALE)).cast("int"))
    whole = F.when(F.exists(y, lambda c: c.isNull()), F.raise_error(F.lit(f"a component is beyond {LARGEST // SCALE}")).cast("array<int>"))
    return rows.filter(x.isNotNull() & (F.size(x) == dims)).filter(~odd).select(F.col("vec_id").cast("long").alias("vec_id"), whole.otherwise(y).alias("v"))


def first_centroids(vecs: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose hashes of seed and id are smallest, in that order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    picked = vecs.select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()  # k rows
    return np.array([r.v for r in picked], np.int64)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of v to all rows of c, exactly."""
    if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) < 1 << 20:  # sums stay below 2^53
        f, g = v.astype(np.float64), c.astype(np.float64)
        return ((f**2).sum(1)[:, None] - 2 * (f @ g.T) + (g**2).sum(1)).astype(np.int64)
    return np.stack([((v - x) ** 2).sum(1) for x in c], axis=1) if len(c) else np.zeros((len(v), 0), np.int64)


def above(x: np.ndarray) -> np.ndarray:
    return x * (1 + ROOM)


def below(x: np.ndarray) -> np.ndarray:
    return x * (1 - ROOM)


def groups_of(at: np.ndarray) -> np.ndarray:
    """A group for each centroid: a few rounds of plain clustering of the k centroids themselves, without empty groups."""
    heads = at[:: GROUP_SIZE][: max(1, len(at) // GROUP_SIZE)].astype(np.float64)
    label = np.zeros(len(at), np.int64)
    for _ in range(5):
        label = ((at[:, None, :] - heads[None]) ** 2).sum(2).argmin(1)
        heads = np.stack([at[label == g].mean(0) if (label == g).any() else heads[g] for g in range(len(heads))])
    return np.unique(label, return_inverse=True)[1]


def assign(v: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """A round for a batch: clusters, bounds, and how many distances were worked out."""
    groups = int(c.group.max()) + 1
    moved = np.array([c.drift[c.group == g].max() for g in range(groups)])
    own = own.copy()
    upper = above(upper + c.drift[own])
    lower = np.maximum(below(lower - moved), 0)
    live = np.flatnonzero(~(upper < lower.min(axis=1)))  # the global filter
    x, old, low = v[live], own[live], lower[live]
    mine = ((x - c.at[old]) ** 2).sum(1)
    need = low <= above(np.sqrt(mine))[:, None]  # the group filter
    found = np.full((len(live), len(c.at)), FAR)
    scanned = len(live)
    for g in range(groups):
        rows, members = np.flatnonzero(need[:, g]), np.flatnonzero(c.group == g)
        found[np.ix_(rows, members)] = squared(x[rows], c.at[members])
        scanned += len(rows) * len(members)
    every = np.arange(len(live))
    found[every, old] = mine
    new = found.argmin(axis=1)  # the first, so the smaller number, among equals
    best = found[every, new]
    found[every, new] = FAR
    for g in range(groups):
        least = found[:, c.group == g].min(axis=1)
        least = np.where(least == FAR, np.inf, below(np.sqrt(least)))
        # A group that wasn't scanned keeps its bound; a centroid just left now counts in it.
        low[:, g] = np.where(need[:, g], least, np.minimum(low[:, g], least))
    own[live], upper[live], lower[live] = new, above(np.sqrt(best)), low
    return own, upper, lower, scanned


def pass_over(state: DataFrame, c: Centroids, first: bool, last: bool) -> DataFrame:
    """The next state, and rows of sums (n not null) per task and centroid. The first pass takes bare vectors, the last gives exact distances."""
    groups, dims = int(c.group.max()) + 1, c.at.shape[1]
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(T._parse_datatype_string(STATE))

    def rows(height: int, **cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(height, f.type) for f in schema], schema=schema)

    def lists(a: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32), pa.array(a.ravel(), kind.value_type)).cast(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count, work = np.zeros(c.at.shape, np.int64), np.zeros(len(c.at), np.int64), 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v = batch.column("v").flatten().to_numpy().astype(np.int64).reshape(n, dims)
            if first:
                own, upper, lower = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros((n, groups))
            else:
                own, upper = (batch.column(name).to_numpy().copy() for name in ("cluster", "upper"))
                lower = batch.column("lower").flatten().to_numpy().reshape(n, groups).copy()
            own, upper, lower, done = assign(v, own, upper, lower, c)
            work += done
            np.add.at(total, own, v)
            count += np.bincount(own, minlength=len(c.at))
            kept = {"vec_id": batch.column("vec_id"), "cluster": own.astype(np.int32)}
            if last:
                yield rows(n, **kept, distance=((v - c.at[own]) ** 2).sum(1))
            else:
                yield rows(n, **kept, v=lists(v.astype(np.int32), schema.field("v").type), upper=upper, lower=lists(lower, schema.field("lower").type))
        at = np.flatnonzero(count)
        if len(at):
            yield rows(len(at), cluster=at.astype(np.int32), total=lists(total[at], schema.field("total").type), n=count[at], scanned=np.where(at == at[0], work, 0))

    return state.mapInArrow(run, STATE)


def moved(state: DataFrame, c: Centroids) -> Centroids:
    """Centroids after the sums of a pass: exact floors of the means; those without vectors stay."""
    sums = state.filter("n IS NOT NULL").select("cluster", "n", F.posexplode("total").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    at = c.at.copy()
    for r in sums.collect():  # k * dims rows
        at[r.cluster, r.i] = r.x // r.n
    return Centroids(at, c.group, above(np.sqrt(((at - c.at) ** 2).sum(1))))


def digest_of(at: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, at.tolist())).encode()).hexdigest()


def cluster(rows: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, work: list[int] | None = None) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each kept vector; `work` gets each pass's distances."""
    spark = rows.sparkSession
    vecs = vectors(rows, dims)
    at = first_centroids(vecs, k, seed)
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(at):
        return spark.createDataFrame([], out)
    c = Centroids(at, groups_of(at), np.zeros(len(at)))
    state = vecs
    for r in range(rounds + 1):
        before, state = state, written(pass_over(state.filter("n IS NULL") if r else vecs, c, r == 0, r == rounds))
        if r:
            forget(before)
        if work is not None:
            work.append(state.agg(F.sum("scanned")).collect()[0][0])
        if r < rounds:
            c = moved(state, c)
    members = state.filter("n IS NULL").select("vec_id", "cluster", "distance")
    sums = {r.cluster: r.s for r in members.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    told = spark.createDataFrame([(i, s, sum(sums.values()), digest_of(c.at[i])) for i, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return members.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
