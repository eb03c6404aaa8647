"""Exact k-means in whole numbers with the Shallot search.

Each vector remembers its nearest and second nearest centroid, an upper bound of the distance to the one and a lower
bound of the distance to all others. Bounds that centroid moves have not crossed keep the assignment without a look at
the vector. Otherwise the closer one of the two remembered centroids starts the search: the other centroids are taken
by their distance from it, only while they lie in a ball around it that can still hold a nearer one than the second
best, and the ball shrinks with each one found. Bounds are floating numbers with slack; every centroid that survives
them is compared by exact squared distance in whole numbers, ties to the smaller number.

A round is one pass in Spark: it reads the vectors with their bounds, writes them with new ones, and each task adds a row
of its clusters' sums, which Spark adds up; k * dims sums come to the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, parts

#: Up to this size of a component sums of squares fit 64 bits; beyond it numbers are Python's own.
SMALL = 1 << 27
#: Relative error that a floating bound may have gathered.
SLACK = 1e-9
LIMB = 60
LONGEST = (1 << 63) - 1
STATE = "vec_id long, q binary, cluster int, second int, upper double, lower double, distance long, totals array<struct<cluster:int,n:long,sums:array<array<long>>>>"
NAMES = ["vec_id", "q", "cluster", "second", "upper", "lower", "distance", "totals"]
TOTALS = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.list_(pa.int64())))]))


def quantised(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are kept, and floor(64 * x) of those as doubles, which hold such numbers exactly.

    Kept are vectors of `dims` components, none of them null or not finite, neither as given nor times 64.
    """
    column = column.cast(pa.list_(pa.float64()))
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    fits = np.flatnonzero(sizes == dims)
    flat = column.take(pa.array(fits)).flatten()
    known = np.asarray(flat.is_valid()).reshape(-1, dims)
    values = np.asarray(flat.fill_null(0)).reshape(-1, dims)
    with np.errstate(over="ignore"):
        q = np.floor(values * 64.0)
    good = known.all(axis=1) & np.isfinite(q).all(axis=1)
    return fits[good], q[good]


def packed(q: np.ndarray) -> list[bytes]:
    """Rows of 16-bit numbers where they fit, else of doubles."""
    narrow = np.abs(q).max(axis=1, initial=0) < 1 << 15
    small, wide = q.astype("<i2", casting="unsafe") if narrow.all() else np.where(narrow[:, None], q, 0).astype("<i2"), q.astype("<f8")
    return [(small if n else wide)[i].tobytes() for i, n in enumerate(narrow)]


def unpacked(rows: list[bytes], dims: int) -> np.ndarray:
    if all(len(r) == 2 * dims for r in rows):
        return np.frombuffer(b"".join(rows), "<i2").reshape(-1, dims).astype(np.int64)
    return exact(np.stack([np.frombuffer(r, "<i2" if len(r) == 2 * dims else "<f8").astype(np.float64) for r in rows]))


def exact(q: np.ndarray) -> np.ndarray:
    """Whole doubles as 64-bit numbers, or as Python's where squares would not fit."""
    return q.astype(np.int64) if np.abs(q).max(initial=0) < SMALL else np.array([[int(x) for x in row] for row in q], object)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    d = a - b
    return (d * d).sum(axis=-1) if d.dtype == object else np.einsum("...i,...i->...", d, d)


def root(x) -> np.ndarray:
    """Square roots as doubles; of numbers that no double holds, infinity."""
    if getattr(x, "dtype", None) != object:
        return np.sqrt(np.asarray(x, np.float64))
    return np.array([math.sqrt(v) if v < 10**300 else math.inf for v in x.ravel()]).reshape(x.shape)


class Centroids:
    """Centroids of a round: their distances from each other, and how far they have moved since the round before."""

    def __init__(self, rows: list[list[int]], before: list[list[int]] | None):
        big = max((abs(v) for row in rows for v in row), default=0) >= SMALL
        self.c = np.array(rows, object if big else np.int64)
        self.k = len(rows)
        self.gap = root(squared(self.c[:, None, :], self.c[None, :, :]))
        self.near = [sorted((j for j in range(self.k) if j != i), key=lambda j: (self.gap[i, j], j)) for i in range(self.k)]
        self.half = np.array([self.gap[i, n[0]] / 2 if n else math.inf for i, n in enumerate(self.near)]) * (1 - SLACK)
        if before is not None:
            was = np.array(before, object)
            self.moved = root(squared(self.c.astype(object), was)) * (1 + SLACK)
            self.others = np.array([max((self.moved[j] for j in range(self.k) if j != i), default=0.0) for i in range(self.k)])

    def assign(self, q: np.ndarray, cluster: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        """Bring assignments and bounds of the rows up to date with these centroids, in place."""
        if hasattr(self, "moved"):
            upper += self.moved[cluster]
            lower -= self.others[cluster]
        open_ = np.flatnonzero(~(upper < np.maximum(lower, self.half[cluster])))
        if not len(open_):
            return
        own = squared(q[open_], self.c[cluster[open_]])
        upper[open_] = root(own) * (1 + SLACK)
        still = ~(upper[open_] < np.maximum(lower[open_], self.half[cluster[open_]]))
        open_, own = open_[still], own[still]
        if self.k == 1 or not len(open_):
            return
        other = squared(q[open_], self.c[second[open_]])
        a, s = cluster[open_], second[open_]
        closer = (other < own) | ((other == own) & (s < a))  # the remembered second has come nearer
        best, runner = np.where(closer, other, own), np.where(closer, own, other)
        first, next_ = np.where(closer, s, a), np.where(closer, a, s)
        starts = first.copy()
        for c in np.unique(starts):
            mine = np.flatnonzero(starts == c)
            self._search(q[open_[mine]], int(c), mine, best, runner, first, next_)
        cluster[open_], second[open_] = first, next_
        upper[open_], lower[open_] = root(best) * (1 + SLACK), root(runner) * (1 - SLACK)

    def _search(self, q: np.ndarray, start: int, at: np.ndarray, best: np.ndarray, runner: np.ndarray, first: np.ndarray, next_: np.ndarray) -> None:
        """Look through the neighbours of centroid `start` for rows `at`, whose nearest it is so far; `q` are their vectors."""
        here, known = root(best[at]), next_[at].copy()
        for j in self.near[start]:
            inside = ~(self.gap[start, j] * (1 - SLACK) > (here + root(runner[at])) * (1 + SLACK))
            at, q, here, known = at[inside], q[inside], here[inside], known[inside]
            if not len(at):
                return
            new = known != j  # the other remembered centroid has been compared already
            rows, d = at[new], squared(q[new], self.c[j])
            nearest = (d < best[rows]) | ((d == best[rows]) & (j < first[rows]))
            better = ~nearest & ((d < runner[rows]) | ((d == runner[rows]) & (j < next_[rows])))
            up = rows[nearest]
            runner[up], next_[up] = best[up], first[up]
            best[up], first[up] = d[nearest], j
            runner[rows[better]], next_[rows[better]] = d[better], j


def limbs(x: int) -> list[int]:
    """A whole number in parts of 60 bits, the last one signed: their sums stay exact in Spark whatever its size."""
    out = []
    while not -(1 << 62) <= x < 1 << 62:
        out.append(x & ((1 << LIMB) - 1))
        x >>= LIMB
    return [*out, x]


def _pass(df: DataFrame, dims: int, rows: list[list[int]], before: list[list[int]] | None, last: bool) -> DataFrame:
    """One round over `df`: its vectors with new bounds, and one row of totals of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = Centroids(rows, before)
        n, sums, far = [0] * len(rows), [[0] * dims for _ in rows], [0] * len(rows)
        for batch in parts(batches, 8192):
            if not batch.num_rows:
                continue
            if before is None:  # the given table
                kept, q = quantised(batch.column(1), dims)
                ids, body, q = batch.column(0).take(pa.array(kept)), packed(q), exact(q)
                cluster, second = np.zeros(len(q), np.int32), np.full(len(q), min(1, len(rows) - 1), np.int32)
                upper, lower = np.full(len(q), math.inf), np.zeros(len(q))
            else:
                ids, body = batch.column(0), batch.column(1).to_pylist()
                q = unpacked(body, dims)
                cluster, second, upper, lower = (np.array(batch.column(k)) for k in range(2, 6))
            if not len(q):
                continue
            centroids.assign(q, cluster, second, upper, lower)
            distance = squared(q, centroids.c[cluster]) if last else None
            for c in np.unique(cluster):
                mine = cluster == c
                n[c] += int(mine.sum())
                if last:
                    far[c] += sum(map(int, distance[mine]))
                else:
                    sums[c] = [a + int(b) for a, b in zip(sums[c], q[mine].sum(axis=0), strict=True)]
            shown = pa.array([int(d) if d <= LONGEST else None for d in distance], pa.int64()) if last else pa.nulls(len(q), pa.int64())
            body = pa.nulls(len(q), pa.binary()) if last else pa.array(body, pa.binary())
            yield pa.RecordBatch.from_arrays([ids, body, pa.array(cluster, pa.int32()), pa.array(second, pa.int32()), pa.array(upper), pa.array(lower), shown, pa.nulls(len(q), TOTALS)], NAMES)
        own = [{"cluster": c, "n": n[c], "sums": [limbs(x) for x in ([far[c]] if last else sums[c])]} for c in range(len(rows)) if n[c]]
        if own:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, t) for t in (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64())] + [pa.array([own], TOTALS)], NAMES)

    given = df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding") if before is None else df.where("totals is null").select(*NAMES[:6])
    return given.mapInArrow(run, STATE)


def _totals(state: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Of each cluster with vectors, their number and exact sums, added up by Spark."""
    each = state.where("totals is not null").select(F.inline("totals"))
    counted = {r.cluster: r.n for r in each.groupBy("cluster").agg(F.sum("n").alias("n")).collect()}
    limb = each.select("cluster", F.posexplode("sums").alias("component", "limbs")).select("cluster", "component", F.posexplode("limbs").alias("place", "x"))
    added = limb.groupBy("cluster", "component", "place").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()  # k * dims rows
    sums: dict[int, dict[int, int]] = {c: {} for c in counted}
    for r in added:
        sums[r.cluster][r.component] = sums[r.cluster].get(r.component, 0) + (int(r.x) << LIMB * r.place)
    return {c: (n, [sums[c][i] for i in sorted(sums[c])]) for c, n in counted.items()}


def _first(df: DataFrame, dims: int, k: int) -> list[list[int]]:
    """The k kept vectors with the least sha256 of `1:<vec_id>`, in that order. Rows without vec_id have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 8192):
            kept, q = quantised(batch.column(1), dims)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), pa.FixedSizeListArray.from_arrays(pa.array(q.ravel()), dims).cast(pa.list_(pa.float64()))], ["vec_id", "q"])

    kept = df.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, q array<double>")
    rank = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    return [[int(x) for x in r.q] for r in kept.orderBy(rank, "vec_id", "q").limit(k).collect()]


def cluster(df: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each kept vector.

    Vectors of another length, with null or non-finite components, or whose 64-fold isn't finite, are left out; null
    vectors too. Repeated rows count each; of repeated ids the lesser vector is the earlier first centroid. Rows without
    vec_id are clustered and start no centroid. With fewer than k such vectors there are fewer centroids, with none no
    rows. Squared distances and their sums beyond a long are null; assignments stay exact. Other columns aren't read.
    """
    spark = df.sparkSession
    rows = _first(df, dims, k)
    if not rows:
        empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], empty)
    before, state = None, df
    for step in range(rounds + 1):
        new = materialize(_pass(state, dims, rows, before, step == rounds), "clusters")
        if step:
            discard(state)
        state, found, before = new, _totals(new), rows
        if step < rounds:
            rows = [[s // found[c][0] for s in found[c][1]] if c in found else row for c, row in enumerate(rows)]
    far = {c: sums[0] for c, (_, sums) in found.items()}
    long = lambda x: x if x <= LONGEST else None
    digest = lambda row: hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()
    told = spark.createDataFrame([(c, long(far[c]), long(sum(far.values())), digest(rows[c])) for c in far], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.where("totals is null").select("vec_id", "cluster", "distance").join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def _sql(k: int = 16, rounds: int = 3, dims: int = 64) -> str:
    steps = [
        f"v as (select vec_id, [floor(64 * x::double)::hugeint for x in embedding] as q from embeddings where len(embedding) = {dims} and len([x for x in embedding if isfinite(x)]) = {dims})",
        f"c0 as (select (row_number() over (order by h) - 1)::int as c, q from (select q, sha256('1:' || vec_id) as h from v order by h limit {k}))",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} as (select vec_id, any_value(v.q) as q, min((list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(v.q, c.q)]), c)) as best from v, c{r} c group by vec_id)")
        if r < rounds:
            summed = f"select best[2] as c, i, sum(q[i]) as s, count(*) as n from a{r}, range(1, {dims + 1}) t(i) group by 1, 2"
            floors = f"select c, list((s - (((s % n) + n) % n)) // n order by i) as q from ({summed}) group by c"
            steps.append(f"c{r + 1} as (select o.c, coalesce(n.q, o.q) as q from c{r} o left join ({floors}) n using (c))")
    final = f"""select vec_id, best[2]::int as cluster, best[1]::bigint as distance, (sum(best[1]) over (partition by best[2]))::bigint as cluster_inertia, (sum(best[1]) over ())::bigint as inertia,
        sha256(array_to_string([x::bigint::varchar for x in c.q], ',')) as centroid_sha256 from a{rounds} join c{rounds} c on c.c = best[2]"""
    return "with " + ", ".join(steps) + " " + final


#: The same rows in DuckDB, for tables whose vec_ids are all different.
SQL = _sql()
