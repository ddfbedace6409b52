"""Nearest neighbours by inner product through an inverted multi-index.

Vectors get one more component that makes all of them equally long (that of a query is 0), so the
largest inner product is the least distance.  The two halves of vectors are quantised apart; a cell is a
pair of centroids, and its distance from a query the sum of both halves'.  A query goes through cells in order of
distance, by a heap over the two sorted lists, until they hold enough vectors; it needs no list
of cells afterwards but the distance it has reached.  The vectors of these cells are compared exactly.

How many vectors are enough is measured: some of the queries, ``PROBES`` of them,
are compared with all vectors, and the number is the least by which the share of their nearest found
reaches ``recall``.  Where vectors form no groups that share is hard to reach, and a query reads
a good part of all vectors; in grouped ones, a few cells.

Work is dealt out in units: cells together that hold about ``VECTORS_A_UNIT`` vectors, or a part of a larger
cell, with about ``QUERIES_A_UNIT`` of the queries that reach them.  Equal vectors are one row with
their k + 1 least ids: no query's nearest can hold more of them, as ties go to the
smaller id; equal queries are searched for once.

The driver gets: a sample of ``SAMPLE`` vectors at most, by a hash of ids, from which centroids are fitted;
the number of vectors and of queries in each cell (at most ``MOST_CENTROIDS`` squared); and the probes' nearest.

Results: vectors that are null, zero, of another length than most, or hold null, NaN or infinite components take no part, nor do
rows without an id.  Rows that repeat an id are one vector, the least of them.  With
fewer than k candidates, all are returned; without queries or vectors the result is empty.  Further columns of any name don't matter.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches

SAMPLE, PROBES, ROUNDS = 20_000, 200, 8
VECTORS_A_UNIT, QUERIES_A_UNIT = 4096, 8192
ROWS_A_CELL, MOST_CENTROIDS = 32, 1024


def clean_vectors(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    """id, vector (doubles): one row for each id whose vector can take part."""
    found = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    fit = found.where(F.col("id").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    return fit.groupBy("id").agg(F.min("vector").alias("vector"))


def fitted(x: np.ndarray, k: int) -> np.ndarray:
    """k centroids of the rows of x, by k-means from rows spread over their order; a centroid without rows stays."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(np.int64)].copy()
    for _ in range(ROUNDS):
        near = nearest(x, centres)
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, column, k) for column in x.T], 1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return distances(x, centres).argmin(1)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x from the centres."""
    return np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1) - 2 * x @ centres.T, 0)


class Index:
    """Centroids of both halves, and of each cell how many vectors it has and in which units they are."""

    def __init__(self, sample: np.ndarray, norm: float, k: int):
        self.norm, self.half = norm, (sample.shape[1] + 1) // 2
        x = self.lengthened(sample)
        self.low, self.high = fitted(x[:, : self.half], k), fitted(x[:, self.half :], k)

    def lengthened(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm - (x * x).sum(1), 0))
        return np.concatenate([x, rest[:, None]], 1)

    def cells(self, x: np.ndarray) -> np.ndarray:
        x = self.lengthened(x)
        return nearest(x[:, : self.half], self.low) * len(self.high) + nearest(x[:, self.half :], self.high)

    def from_query(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of queries from the centroids of either half."""
        q = np.concatenate([q, np.zeros((len(q), 1))], 1)
        return distances(q[:, : self.half], self.low), distances(q[:, self.half :], self.high)

    def counted(self, cells: list, counts: list) -> None:
        """Takes in how many vectors each cell has, and deals cells out to bins."""
        self.counts = np.zeros(len(self.low) * len(self.high), np.int64)
        self.counts[cells] = counts
        large = self.counts > VECTORS_A_UNIT
        filled = np.cumsum(np.where(large, 0, self.counts)) // VECTORS_A_UNIT
        self.bins = np.where(large, filled[-1] + np.cumsum(large), filled)
        self.parts = np.ones(int(self.bins.max()) + 1, np.int64)  # of a bin
        self.parts[self.bins[large]] = -(-self.counts[large] // VECTORS_A_UNIT)

    def reach(self, low: np.ndarray, high: np.ndarray, enough: int) -> tuple[float, np.ndarray]:
        """How far a query must go, by its distances, to meet ``enough`` vectors, and the cells with vectors it meets."""
        rows, columns = np.argsort(low, kind="stable"), np.argsort(high, kind="stable")
        a, b, wide = low[rows].tolist(), high[columns].tolist(), len(high)
        counts = self.counts.reshape(len(low), wide)[rows][:, columns].tolist()
        heap, next_row, met, at, far = [(a[0] + b[0], 0, 0)], [0] * len(a), 0, [], 0.0
        while heap and met < enough:
            far, i, j = heapq.heappop(heap)
            if counts[i][j]:
                met += counts[i][j]
                at.append((i, j))
            if j + 1 < len(b):
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
        i, j = np.array(at, np.int64).reshape(-1, 2).T
        return far, rows[i] * wide + columns[j]

    def enough_for(self, low: np.ndarray, high: np.ndarray, wanted: list[list[tuple[int, int]]], recall: float) -> int:
        """The number of vectors to meet so that of the wanted (cell, number) of each query this share is met."""
        need, weight = [], []
        for a, b, want in zip(low, high, wanted):
            whole = (a[:, None] + b).ravel()
            order = np.argsort(whole, kind="stable")
            before = np.empty(len(order), np.int64)
            before[order] = np.cumsum(self.counts[order]) - self.counts[order]
            need += [before[cell] + 1 for cell, _ in want]
            weight += [n for _, n in want]
        order = np.argsort(need, kind="stable")
        share = np.cumsum(np.array(weight)[order]) / sum(weight)
        return int(np.array(need)[order][np.searchsorted(share, min(recall, share[-1]))])


def as_matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def as_lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def ends(n: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())


def best_of(scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the n greatest scores of each row that aren't -inf, and all that equal the last of them up to rounding."""
    if scores.shape[1] > n:
        last = np.partition(scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n]
        return np.nonzero((scores >= (last - 1e-9 * (1 + np.abs(last)))[:, None]) & (scores > -np.inf))
    return np.nonzero(scores > -np.inf)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner products of pairs of rows; equal for equal rows, wherever they are."""
    return (a * b).sum(1)


def ranked(row: np.ndarray, score: np.ndarray, least_id: np.ndarray, n: int) -> np.ndarray:
    """Which of some pairs are among the n best of their row, in order; ties go to the smaller id."""
    order = np.lexsort((least_id, -score, row))
    begins = np.flatnonzero(np.concatenate([[True], np.diff(row[order]) != 0])) if len(order) else order
    place = np.arange(len(order)) - np.repeat(begins, np.diff(begins, append=len(order)))
    return order[place < n]


def probe_pass(vectors: DataFrame, keys: list[bytes], probes: np.ndarray, n: int) -> DataFrame:
    """probe, cell, score, held, own: the n best rows for each probe that each task has met, with how many ids they hold."""

    def run(batches):
        best = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = as_matrix(batch.column("vector"))
            cells, held = batch.column("cell").to_numpy(), batch.column("held").to_numpy()
            known = {key: i for i, key in enumerate(batch.column("key").to_pylist())}
            own = np.array([known.get(key, -1) for key in keys])[:, None] == np.arange(len(x))
            scores = probes @ x.T
            wide = [np.broadcast_to(c, scores.shape) for c in (cells, held)]
            fresh = [scores, *wide, own]
            best = fresh if best is None else [np.concatenate(c, 1) for c in zip(best, fresh)]
            if best[0].shape[1] > n:
                top = np.argpartition(-best[0], n - 1, 1)[:, :n]
                best = [np.take_along_axis(c, top, 1) for c in best]
        if best is not None:
            number = np.repeat(np.arange(len(probes)), best[0].shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(best[1].ravel().astype(np.int64)), pa.array(best[0].ravel()), pa.array(best[2].ravel().astype(np.int64)), pa.array(best[3].ravel())], ["probe", "cell", "score", "held", "own"])

    return vectors.select("key", "vector", "cell", F.size("ids").cast("long").alias("held")).mapInArrow(run, "probe long, cell long, score double, held long, own boolean")


def wanted_by(rows: list, n_probes: int, k: int) -> list[list[tuple[int, int]]]:
    """For each probe the cells of its k nearest, with how many each gives."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(n_probes)]
    left = [k] * n_probes
    for r in sorted(rows, key=lambda r: (r.probe, -r.score)):
        n = min(left[r.probe], r.held - r.own)
        if n:
            out[r.probe].append((r.cell, n))
            left[r.probe] -= n
    return out


def compared(index: Index, n: int):
    """For the vectors and the queries of a unit: the n best of each query among the vectors in its reach."""

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if vectors.num_rows and queries.num_rows:
            x, q = as_matrix(vectors.column("vector").combine_chunks()), as_matrix(queries.column("vector").combine_chunks())
            cells, far, ids = vectors.column("cell").to_numpy(), queries.column("far").to_numpy(), vectors.column("ids").combine_chunks()
            edges, flat = ids.offsets.to_numpy() - ids.offsets[0].as_py(), ids.flatten().to_numpy()
            i, j = np.divmod(cells, len(index.high))
            for at in range(0, len(q), 256):
                part = q[at : at + 256]
                low, high = index.from_query(part)
                scores = part @ x.T
                limit = far[at : at + 256]
                scores[low[:, i] + high[:, j] > (limit * (1 + 1e-9) + 1e-12)[:, None]] = -np.inf
                row, column = best_of(scores, n)
                score = np.concatenate([np.zeros(0), *(exact(part[row[s : s + 65_536]], x[column[s : s + 65_536]]) for s in range(0, len(row), 65_536))])
                top = ranked(row, score, flat[edges[column]], n)
                held = np.diff(edges)[column[top]]
                of = np.repeat(np.arange(len(top)), held)
                place = np.arange(len(of)) - np.repeat(np.cumsum(held) - held, held) + edges[column[top]][of]
                out.append((row[top][of] + at, flat[place], score[top][of] + 0.0))
        row, found, score = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        key = queries.column("key").combine_chunks().take(pa.array(row)).cast(pa.binary()) if len(row) else pa.array([], pa.binary())
        return pa.table({"key": key, "id": pa.array(found, pa.int64()), "score": pa.array(score, pa.float64())})

    return run


def placed_in(index: Index, vectors: DataFrame) -> DataFrame:
    """id, key (a digest of the vector), cell, vector."""

    def run(batches):
        for batch in batches:
            x = as_matrix(batch.column("vector")) + 0.0
            if len(x):
                keys = [hashlib.blake2b(row.tobytes(), digest_size=16).digest() for row in x]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(keys, pa.binary()), pa.array(index.cells(x), pa.int64()), as_lists(x)], ["id", "key", "cell", "vector"])

    return vectors.select("id", "vector").mapInArrow(run, "id long, key binary, cell long, vector array<double>")


def reached_by(index: Index, queries: DataFrame, enough: int) -> DataFrame:
    """key, vector, far and the bins of the cells that a query reaches."""

    def run(batches):
        for batch in batches:
            q = as_matrix(batch.column("vector"))
            if len(q):
                found = [index.reach(a, b, enough) for a, b in zip(*index.from_query(q))]
                bins = [np.unique(index.bins[cells]) for _, cells in found]
                lists = pa.ListArray.from_arrays(ends(np.array([len(b) for b in bins])), pa.array(np.concatenate(bins), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("vector"), pa.array([far for far, _ in found]), lists], ["key", "vector", "far", "bins"])

    return queries.select("key", "vector").mapInArrow(run, "key binary, vector array<double>, far double, bins array<long>")


def first_rows(df: DataFrame, n: int, by: str, *order) -> DataFrame:
    """The first n rows of each group; tasks keep n of a group before the shuffle."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def nearest_vectors(rows: DataFrame, asked, scratch: Scratch, k: int = 20, recall: float = 0.95, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose id meets the condition ``asked`` (on column id), its k nearest found."""
    spark = rows.sparkSession
    small_batches(spark)
    vectors = scratch.keep(clean_vectors(rows, id_column, vector))
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = vectors.groupBy(F.size("vector").alias("size")).count().orderBy(F.col("count").desc(), "size").first()
    if size is None:
        return nothing
    vectors = vectors.where(F.size("vector") == size["size"])
    norm = vectors.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))).first()[0]
    sample = np.unique(as_matrix(vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toArrow().column("vector").combine_chunks()), axis=0)
    centres = min(MOST_CENTROIDS, len(sample), 1 << max(round(np.log2(max(size["count"] / ROWS_A_CELL, 1)) / 2), 0))
    index = Index(np.random.default_rng(1).permutation(sample), norm, centres)
    placed = scratch.keep(placed_in(index, vectors))
    least = first_rows(placed, k + 1, "key", "id").groupBy("key").agg(F.any_value("cell").alias("cell"), F.any_value("vector").alias("vector"), F.array_sort(F.collect_list("id")).alias("ids"))
    classes = scratch.keep(least)
    counts = classes.groupBy("cell").count().toArrow()
    index.counted(counts.column("cell").to_numpy(), counts.column("count").to_numpy())
    asking = placed.where(asked).select("id", "key", "vector")
    queries = scratch.keep(asking.groupBy("key").agg(F.any_value("vector").alias("vector")))
    probes = queries.orderBy(F.xxhash64("key"), "key").limit(PROBES).toArrow()
    if not probes.num_rows:
        return nothing
    matrix = as_matrix(probes.column("vector").combine_chunks())
    best = first_rows(probe_pass(classes, probes.column("key").to_pylist(), matrix, k + 1), k + 1, "probe", F.col("score").desc()).collect()
    enough = k + 1
    wanted = wanted_by(best, len(matrix), k)
    if any(wanted):
        enough = max(enough, index.enough_for(*index.from_query(matrix), wanted, recall))
    reached = scratch.keep(reached_by(index, queries, enough))
    visits = dict(reached.select(F.explode("bins").alias("bin")).groupBy("bin").count().collect())
    salts = [-(-visits.get(b, 0) // QUERIES_A_UNIT) for b in range(len(index.parts))]
    bins = spark.createDataFrame([(b, int(p), s) for b, (p, s) in enumerate(zip(index.parts, salts)) if s], "bin long, parts long, salts long")
    cells = np.flatnonzero(index.counts)
    of_cell = spark.createDataFrame(list(zip(cells.tolist(), index.bins[cells].tolist())), "cell long, bin long")
    unit = ["bin", "part", "salt"]
    dealt = lambda n, key: F.pmod(F.xxhash64(key), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    # Both tables have a row for each cell at most.
    held = classes.join(F.broadcast(of_cell), "cell").join(F.broadcast(bins), "bin").select("bin", dealt("parts", "key").alias("part"), each("salts").alias("salt"), "cell", "vector", "ids")
    going = reached.select("key", "vector", "far", F.explode("bins").alias("bin")).join(F.broadcast(bins), "bin").select("bin", each("parts").alias("part"), dealt("salts", "key").alias("salt"), "key", "vector", "far")
    pairs = held.groupBy(*unit).cogroup(going.groupBy(*unit)).applyInArrow(compared(index, k + 1), "key binary, id long, score double")
    first = first_rows(pairs, k + 1, "key", F.col("score").desc(), "id")
    lists = first.groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "id"))).alias("found"))
    whole = asking.select(F.col("id").alias("query_id"), "key").join(lists, "key")
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    return scratch.result(whole.select("query_id", F.posexplode(others).alias("place", "x")).select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (0.0 - F.col("x.less")).alias("score")))
