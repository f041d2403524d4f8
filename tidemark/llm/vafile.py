"""Exact top-k by inner product with a vector-approximation file.

Vectors are whole numbers (``floor(scale * x)``). The file holds one cell of
``BITS`` bits per component: component v lies in ``low + cell * step`` and the
step - 1 numbers above. So for a query q the score lies between q * lows and that
plus a width which depends on q alone.

1. Tiles of queries and cells are scanned. Per query a tile keeps what may still be
   among its k best: upper bound not below the k-th best lower bound of the tile.
2. Over all tiles, the k-th best lower bound of a query decides who stays.
3. Exact vectors are read in the order of the bounds: first the k with the best
   upper bounds; then those whose upper bound reaches the k-th exact score of
   these. Nobody behind them can still get in, so the result is certain.

A vector that more than k smaller ids share can't be among the k best of any
query, since those have the same score and win the tie; it is left out before the
scan, so a vector repeated a million times costs a few rows. Vectors meet only
vectors of the same length. Nothing is broadcast, and a tile has a fixed size.

Left out: null ids, vectors that are null, empty or hold a null or non-finite
component. Rows that share an id count one by one; a query's own id is no
candidate. Scores must fit in 64 bits. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch, ship

BITS = 5
TILE = 8192      # candidates of a tile
QUERIES = 512    # queries of a tile


def whole_numbers(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) per component, x as double; null for a vector that takes no part."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(fine & (F.size(x) > 0), F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of whole numbers: by floats where no sum can leave their range."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if bound < 2**52 else a @ b.T


_CANDIDATE = "query_id long, query_row long, vec_id long, vec_row long, lower long, upper long"


def _scan(k: int):
    def run(key: tuple[pa.Scalar, ...], queries: pa.Table, cells: pa.Table) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int64()) for n in ("query_id", "query_row", "vec_id", "vec_row", "lower", "upper")])
        if not queries.num_rows or not cells.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in schema.names})
        dim = key[2].as_py()
        low, step = (np.array(cells[c][0].as_py(), np.int64) for c in ("low", "step"))
        q = _matrix(queries["vector"], dim)
        raw = cells["cells"].combine_chunks()
        codes = np.frombuffer(b"".join(x.as_py() for x in raw), np.uint8).reshape(-1, dim).astype(np.int64)
        base = _dot(q, low + codes * step)
        under, over = (np.minimum(q, 0) * (step - 1)).sum(1), (np.maximum(q, 0) * (step - 1)).sum(1)
        q_id, q_row = (queries[c].to_numpy() for c in ("vec_id", "row"))
        v_id, v_row = (cells[c].to_numpy() for c in ("vec_id", "row"))
        out = []
        for i in range(len(q)):
            other = np.flatnonzero(v_id != q_id[i])
            if not len(other):
                continue
            score = base[i, other]
            best = np.partition(score, len(score) - k)[len(score) - k] + under[i] if len(score) > k else np.iinfo(np.int64).min
            stay = other[score + over[i] >= best]
            n = len(stay)
            out.append(np.stack([np.full(n, q_id[i]), np.full(n, q_row[i]), v_id[stay], v_row[stay], base[i, stay] + under[i], base[i, stay] + over[i]]))
        rows = np.concatenate(out, axis=1) if out else np.empty((6, 0), np.int64)
        return pa.table({n: pa.array(x) for n, x in zip(schema.names, rows)})

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of a batch: which of the equal steps between the smallest and largest component each one falls into."""
    for rows in batches:
        cells = []
        for x, low, step in zip(*(rows.column(i) for i in (3, 4, 5))):
            v, a, w = (s.values.to_numpy() for s in (x, low, step))
            cells.append(((v - a) // w).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([*rows.columns[:3], rows.column(4), rows.column(5), pa.array(cells, pa.binary())],
                                         names=["dim", "vec_id", "row", "low", "step", "cells"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, bits: int = BITS,
          id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of every query row, ties to the smaller id.

    ``is_query`` is a condition on the column ``vec_id`` of the result's ids.
    """
    spark = ship(vectors.sparkSession)
    scratch = Scratch(spark, "vafile")
    exact = vectors.select(F.col(id_col).cast("long").alias("vec_id"), whole_numbers(F.col(vector_col), scale).alias("vector"))
    exact = exact.filter("vec_id IS NOT NULL AND vector IS NOT NULL").select(
        F.monotonically_increasing_id().alias("row"), "vec_id", "vector", F.size("vector").alias("dim"))
    exact = scratch.keep(exact, "exact")
    asked = exact.filter(is_query)

    # the k + 1 smallest ids of equal vectors; one may be the query itself
    same = Window.partitionBy("vector").orderBy("vec_id", "row")
    useful = exact.withColumn("nth", F.row_number().over(same)).filter(F.col("nth") <= k + 1).drop("nth")

    # cells: equal steps between the ends of each component, from all vectors
    ends = (
        exact.select("dim", F.posexplode("vector").alias("at", "v")).groupBy("dim", "at").agg(F.min("v").alias("low"), F.max("v").alias("high"))
        .withColumn("step", F.floor((F.col("high") - F.col("low")) / (1 << bits)) + 1)
        .groupBy("dim").agg(F.array_sort(F.collect_list(F.struct("at", "low", "step"))).alias("ends"))
        .select("dim", F.transform("ends", lambda e: e["low"]).alias("low"), F.transform("ends", lambda e: e["step"]).alias("step"))
    )
    cells = scratch.keep(
        useful.join(ends, "dim").select("dim", "vec_id", "row", "vector", "low", "step")
        .mapInArrow(_packed, "dim int, vec_id long, row long, low array<long>, step array<long>, cells binary"), "cells")

    tiles = -(-cells.count() // TILE) or 1
    blocks = -(-asked.count() // QUERIES) or 1
    tile, block = F.pmod(F.xxhash64("row"), F.lit(tiles)), F.pmod(F.xxhash64("row"), F.lit(blocks))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = asked.select("dim", "vec_id", "row", "vector", block.cast("int").alias("block"), every(tiles).alias("tile"))
    spread = cells.select("dim", "vec_id", "row", "low", "step", "cells", tile.cast("int").alias("tile"), every(blocks).alias("block"))
    kept = (
        dealt.groupBy("tile", "block", "dim").cogroup(spread.groupBy("tile", "block", "dim")).applyInArrow(_scan(k), _CANDIDATE)
    )
    per_query = Window.partitionBy("query_row")
    by_lower = per_query.orderBy(F.desc("lower"), "vec_id", "vec_row")
    kept = (
        kept.withColumn("nth", F.row_number().over(by_lower))
        .withColumn("need", F.max(F.when(F.col("nth") == k, F.col("lower"))).over(per_query))
        .filter("need IS NULL OR upper >= need").drop("nth", "need")
        .withColumn("turn", F.row_number().over(per_query.orderBy(F.desc("upper"), "vec_id", "vec_row")))
    )
    kept = scratch.keep(kept, "kept")

    def scored(pairs: DataFrame) -> DataFrame:
        q = asked.select(F.col("row").alias("query_row"), F.col("vector").alias("q"))
        v = exact.select(F.col("row").alias("vec_row"), F.col("vector").alias("v"))
        product = F.aggregate(F.zip_with("q", "v", lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)
        return pairs.join(q, "query_row").join(v, "vec_row").select("query_id", "query_row", "vec_id", "vec_row", product.alias("score"))

    first = scratch.keep(scored(kept.filter(F.col("turn") <= k)), "first")
    sure = first.groupBy("query_row").agg(F.min("score").alias("sure"), F.count("*").alias("n")).filter(F.col("n") == k)
    scratch.keep(scored(kept.filter(F.col("turn") > k).join(sure, "query_row").filter("upper >= sure")), "second")
    scratch.drop("kept", "cells")
    return (
        scratch.read(first, "first", "second")
        .withColumn("rank", F.row_number().over(per_query.orderBy(F.desc("score"), "vec_id", "vec_row")))
        .filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
