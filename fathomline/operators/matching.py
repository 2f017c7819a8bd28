"""Descriptor matching: nearest neighbours, ratio and mutual tests, greedy spacing of features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.plans.fold import fold_sorted

#: Rows of a block at most; a block of queries meets a block of the pool in one task.  Smaller tables are cut into SPLIT blocks of LEAST rows or more.
BLOCK, SPLIT, LEAST = 32768, 8, 2048
#: Products of queries and pool that are held at once, and pairs whose distance is taken at once.
CELLS, PAIRS = 1 << 23, 1 << 16


def _met(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """q, p, distance of the k nearest within every block: left (_g, _k, q, v) and right (_g, _k, p, v) meet by a shuffle of _g, and rows of equal _k are compared."""

    cells, pairs = CELLS, PAIRS  # what workers run is sent to them whole

    def best(own: np.ndarray, q: np.ndarray, other: np.ndarray, p: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """q, p and distance of the k nearest of every row of own; ties go to the smaller p.

        Single-precision products tell, within their error, which rows can be among the k nearest; distances are
        taken of these alone, from differences, so distances of near copies keep their digits.
        """
        n, size = min(k, len(p)), own.shape[1]
        with np.errstate(all="ignore"):
            x, y = own.astype(np.float32), other.astype(np.float32)
            xx, yy = (own * own).sum(1), (other * other).sum(1)
            share = 4.0 * (size + 16) * 2.0**-24  # error of a product and of the squares
            high, wide = (yy * (1 + share)).astype(np.float32), (2 * share * yy).astype(np.float32)
        out = []
        for at in range(0, len(q), rows := max(1, cells // len(p))):
            part = slice(at, at + rows)
            with np.errstate(all="ignore"):
                near = high - 2 * (x[part] @ y.T)  # the query's own square is the same for all
                lost = ~np.isfinite(near)  # too large for single precision: always looked at
                near[lost] = np.inf
                top = near.min(1) if n == 1 else np.partition(near, n - 1, axis=1)[:, n - 1]
                most = top + 2 * share * xx[part]
                most[~np.isfinite(most)] = np.inf
                near -= wide
                near[lost] = -np.inf
            i, j = np.nonzero(near <= most[:, None])
            d = np.empty(len(i))
            for c in range(0, len(i), pairs):
                pick = slice(c, c + pairs)
                d[pick] = np.sqrt(((other[j[pick]] - own[at + i[pick]]) ** 2).sum(1))
            order = np.lexsort((p[j], d, i))
            i, j, d = i[order], j[order], d[order]
            first = np.arange(len(i)) - np.searchsorted(i, i) < n
            out.append((q[at + i[first]], p[j[first]], d[first]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def vectors(table: pa.Table) -> np.ndarray:
        return np.array(table.column("v").combine_chunks().flatten(), float).reshape(table.num_rows, -1)

    def search(own: pa.Table, other: pa.Table) -> pa.Table:
        found = []
        if own.num_rows and other.num_rows:
            own, other = own.sort_by("_k"), other.sort_by("_k")
            (x, q), (y, p) = (vectors(own), own.column("q").to_numpy()), (vectors(other), other.column("p").to_numpy())
            here, there = own.column("_k").to_numpy(), other.column("_k").to_numpy()
            for key in np.intersect1d(here, there):
                (a, b), (c, d) = (np.searchsorted(keys, [key, key + 1]) if key < np.iinfo(np.int64).max else (np.searchsorted(keys, key), len(keys)) for keys in (here, there))
                found.append(best(x[a:b], q[a:b], y[c:d], p[c:d], k))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table(dict(zip(("q", "p", "distance"), columns, strict=True)))

    return left.groupBy("_g").cogroup(right.groupBy("_g")).applyInArrow(search, "q bigint, p bigint, distance double")


def _blocks(rows: int) -> Column:
    return F.lit(max(1, -(-rows // BLOCK), min(SPLIT, -(-rows // LEAST))))


def _block(c: str, n: Column) -> Column:
    return F.pmod(F.xxhash64(c), n).cast("int")


def _every(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def nearest(queries: DataFrame, pool: DataFrame, k: int = 2, qid: str = "q", pid: str = "p", vec: str = "vec") -> DataFrame:
    """q, p, distance (L2), rank of the k nearest pool rows of every query row; ties go to the smaller p.

    Both sides are dealt into blocks by hash, and every pair of blocks meets by a shuffle: nothing passes
    through the driver, and a task holds two blocks.  Work is queries times pool, as exact search is; a
    pair of blocks gives k rows a query, and these are ranked again.
    """
    n_q, n_p = (_blocks(df.count()) for df in (queries, pool))
    key = [(F.col("_q").cast("long") * n_p + F.col("_p")).alias("_k"), (F.col("_q") * n_p + F.col("_p")).alias("_g")]
    left = queries.select(F.col(qid).cast("long").alias("q"), F.col(vec).alias("v"), _block(qid, n_q).alias("_q"), _every(n_p).alias("_p"))
    right = pool.select(F.col(pid).cast("long").alias("p"), F.col(vec).alias("v"), _block(pid, n_p).alias("_p"), _every(n_q).alias("_q"))
    return _ranked(_met(left.select(*key, "q", "v"), right.select(*key, "p", "v"), k), k)


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q").orderBy("distance", "p"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest_by_hashes(queries: DataFrame, pool: DataFrame, k: int = 2, tables: int = 12, width: float = 1.0, seed: int = 7, qid: str = "q", pid: str = "p", vec: str = "vec") -> DataFrame:
    """Approximately the same: only pool rows that share one of `tables` random-projection buckets (of `width`) with a query are compared.

    A query that meets fewer than k rows so is searched exactly, so every query has its k rows.  A wider bucket or more
    tables find more of the true neighbours and compare more; distances are exact.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    own = queries.select(F.col(qid).cast("long").alias("q"), F.col(vec).alias("vec"))
    other = pool.select(F.col(pid).cast("long").alias("p"), F.col(vec).alias("vec"))
    with_vectors = lambda df: df.withColumn("features", array_to_vector("vec"))
    lsh = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", numHashTables=tables, bucketLength=width, seed=seed)
    model = lsh.fit(with_vectors(own.select("vec").unionByName(other.select("vec")).limit(1)))  # it only needs the vectors' length

    def keyed(df: DataFrame, name: str) -> DataFrame:
        hashed = model.transform(with_vectors(df)).select(name, F.col("vec").alias("v"), F.posexplode("hashes").alias("table", "h"))
        return hashed.select(name, "v", F.xxhash64("table", F.col("h").cast("string")).alias("_b"))

    # A bucket gives each of its queries the k nearest in it, so pairs of a bucket are never rows: the k nearest of all buckets are among these.
    left, right = keyed(own, "q"), keyed(other, "p")
    blocks = F.ceil(F.count(F.lit(1)) / BLOCK).cast("int")
    sizes = left.groupBy("_b").agg(blocks.alias("_nq")).join(right.groupBy("_b").agg(blocks.alias("_np")), "_b")
    groups = max(1, tables * (own.count() + other.count()) // LEAST)
    key = F.xxhash64("_b", "_q", "_p")
    left = left.join(sizes, "_b").select("*", _block("q", F.col("_nq")).alias("_q"), _every(F.col("_np")).alias("_p")).select(F.pmod(key, F.lit(groups)).alias("_g"), key.alias("_k"), "q", "v")
    right = right.join(sizes, "_b").select("*", _block("p", F.col("_np")).alias("_p"), _every(F.col("_nq")).alias("_q")).select(F.pmod(key, F.lit(groups)).alias("_g"), key.alias("_k"), "p", "v")
    found = _ranked(_met(left, right, k).dropDuplicates(["q", "p"]), k).persist(StorageLevel.DISK_ONLY)  # k rows a query
    short = own.join(found.groupBy("q").count().where(F.col("count") >= k).select("q"), "q", "left_anti")
    rest = nearest(short, other, k, "q", "p", "vec")
    return found.join(short.select("q"), "q", "left_anti").unionByName(rest)


def ratio_matches(neighbours: DataFrame, ratio: float) -> DataFrame:
    """q, p, distance, score of the nearest that are nearer than ratio times the second; a single neighbour stays."""
    own = neighbours.groupBy("q").agg(
        F.max(F.when(F.col("rank") == 1, F.struct("p", "distance"))).alias("one"), F.max(F.when(F.col("rank") == 2, F.col("distance"))).alias("two")
    )
    good = own.where(F.col("two").isNull() | (F.col("one.distance") < ratio * F.col("two")))
    return good.select("q", "one.p", "one.distance", (1.0 / (1.0 + F.col("one.distance"))).alias("score"))


def mutual_matches(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Pairs that are each other's nearest."""
    one = forward.where("rank = 1").select("q", "p", "distance")
    other = backward.where("rank = 1").select(F.col("q").alias("p"), F.col("p").alias("q"))
    return one.join(other, ["q", "p"])


def spaced(features: DataFrame, least: float, by: str = "frame_id", order: list[Column] | None = None) -> DataFrame:
    """Greedy non-maximum suppression: by score, then number, a feature stays unless a kept one is nearer than `least`.

    features: by, number, x, y, score.  A grid of cells of that size holds what was kept, so a feature is
    compared with the kept ones of nine cells.
    """

    def step(state, row):
        _, _, x, y, _, _ = row
        cells = state if state is not None else {}
        cx, cy = int(x // least), int(y // least)
        for dx in (-1, 0, 1):
            for dy in (-1, 0, 1):
                for px, py in cells.get((cx + dx, cy + dy), ()):
                    if (px - x) ** 2 + (py - y) ** 2 < least * least:
                        return cells, []
        cells.setdefault((cx, cy), []).append((x, y))
        return cells, [row[:5]]

    kinds = {c: features.schema[c].dataType.simpleString() for c in (by, "number")}
    given = features.select(by, "number", F.col("x").cast("double"), F.col("y").cast("double"), F.col("score").cast("double"), (-F.col("score")).cast("double").alias("_o"))
    return fold_sorted(given, by, ["_o", "number"], step, f"{by} {kinds[by]},number {kinds['number']},x double,y double,score double")


__all__ = ["mutual_matches", "nearest", "nearest_by_hashes", "ratio_matches", "spaced"]
