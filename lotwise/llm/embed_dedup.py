"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors of one label link when their cosine reaches ``threshold``.  All vectors
are scaled to length 1 and rotated to principal axes, which changes no cosine and
puts most of their length into the first coordinates.  Linked vectors differ by at
most ``sqrt(2 - 2 * threshold)`` in any coordinate, so a grid of that width over
the two leading ones leaves neighbouring cells to compare.  A cell is cut into
blocks of about ``BLOCK`` vectors by hash, and pairs of blocks are the tiles.

In a tile products are summed over the leading coordinates first.  What the rest
can still add is at most the product of both suffix norms; vectors that can reach
the threshold with no other are dropped before the next coordinates are read, and
the tile ends when none is left.  Sums within ``NEAR`` of the threshold are decided
by the cosine of the vectors as given.

Equal vectors are one row with a count.  A tile returns a row per linked vector,
its number of links and the smallest vector it is tied to, never its pairs; so a
group of thousands of near copies costs comparisons, but no output.

The axes are fitted on a bounded sample (``SAMPLE`` vectors in the order of a hash
of the id); they only decide how early a tile ends, never its result.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components, and rows with a null label or id link with nothing (component: the own
id); vectors of different lengths do not compare; rows with the same id are one
node, but each row counts its own links; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import hash_sample, small_batches, stored, table
from lotwise.llm.components import components

THRESHOLD = 0.93
BLOCK = 1024
SAMPLE = 4096
NEAR = 1e-9
#: Leading coordinates read at once, doubled at each step.
FIRST_STEP = 8
CELL = ["label", "dim", "c0", "c1"]
#: A cell and those after it, of its eight neighbours.
FORWARD = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def axes(sample: np.ndarray) -> np.ndarray:
    """Principal axes of unit vectors about the origin, the longest first."""
    _, vectors = np.linalg.eigh(sample.T @ sample)
    return vectors[:, ::-1].copy()


def linked(a: np.ndarray, b: np.ndarray, xa: np.ndarray, xb: np.ndarray, threshold: float,
           same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked rows of a and b (rotated units; xa, xb as given).
    For the same block each pair comes once."""
    dim = a.shape[1]
    rows, cols = np.arange(len(a)), np.arange(len(b))
    sums, start, step = np.zeros((len(a), len(b))), 0, FIRST_STEP
    while start < dim and len(rows) and len(cols):
        end = min(dim, start + step)
        sums += a[rows, start:end] @ b[cols, start:end].T
        start, step = end, end
        if start < dim:
            rest_a = np.sqrt((a[rows, start:] ** 2).sum(1))
            rest_b = np.sqrt((b[cols, start:] ** 2).sum(1))
            alive = sums + rest_a[:, None] * rest_b >= threshold - NEAR
            if same:
                alive &= rows[:, None] < cols
            keep_rows, keep_cols = alive.any(1), alive.any(0)
            if not keep_rows.all() or not keep_cols.all():
                rows, cols = rows[keep_rows], cols[keep_cols]
                sums = sums[np.ix_(keep_rows, keep_cols)]
    if not len(rows) or not len(cols):
        return rows[:0], cols[:0]
    i, j = np.nonzero(sums >= threshold - NEAR)
    close = sums[i, j] < threshold + NEAR
    i, j = rows[i], cols[j]
    if same:
        once = i < j
        i, j, close = i[once], j[once], close[once]
    if close.any():
        p, q = unit_rows(xa[i[close]]), unit_rows(xb[j[close]])
        fine = np.ones(len(i), bool)
        fine[close] = (p * q).sum(1) >= threshold
        i, j = i[fine], j[fine]
    return i, j


def tied(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node reachable over the links i, j."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _usable() -> Column:
    """Whether a row (id, label, v) can link at all."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    some = F.exists("v", lambda x: x != 0)
    return F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & ~bad & some, F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _with_cells(reps: DataFrame, basis: dict[int, np.ndarray], threshold: float) -> DataFrame:
    width = np.sqrt(2 - 2 * threshold) * (1 + 1e-9) + 1e-12

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(batch.schema.get_field_index("v"))
            dims = np.diff(vectors.offsets.to_numpy())
            cells = np.zeros((len(dims), 2), np.int64)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                y = unit_rows(_matrix(vectors.take(pa.array(at)), dim))
                lead = y @ basis[dim][:, :2] if dim in basis else y[:, :2]
                cells[at, :lead.shape[1]] = np.floor(lead / width)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(dims.astype(np.int32)), pa.array(cells[:, 0]), pa.array(cells[:, 1])],
                names=[*batch.schema.names, "dim", "c0", "c1"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in reps.schema)
    return reps.mapInArrow(run, f"{kinds}, dim int, c0 bigint, c1 bigint")


def _tiles(reps: DataFrame) -> DataFrame:
    """One row per pair of blocks to compare: dim, a, b (their vectors), same."""
    cells = stored(reps.groupBy(*CELL).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "cells")
    block = F.pmod(F.xxhash64("rep", "g"), F.col("blocks")).cast("int")
    packed = stored(
        reps.join(cells, CELL).withColumn("block", block).groupBy(*CELL, "block")
        .agg(F.collect_list(F.struct("rep", "g", "copies", "v")).alias("rows")), "blocks")
    there = [F.col(c).alias(f"{c}_b") for c in CELL]
    steps = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in FORWARD])
    pairs = packed.select(*CELL, "block", F.explode(steps).alias("step")).withColumns(
        {"c0_n": F.col("c0") + F.col("step.x"), "c1_n": F.col("c1") + F.col("step.y")})
    near = cells.select(*there, "blocks")
    pairs = pairs.join(near, (F.col("label") == F.col("label_b")) & (F.col("dim") == F.col("dim_b"))
                       & (F.col("c0_n") == F.col("c0_b")) & (F.col("c1_n") == F.col("c1_b")))
    own = (F.col("c0") == F.col("c0_b")) & (F.col("c1") == F.col("c1_b"))
    pairs = pairs.withColumn("block_b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where(
        ~own | (F.col("block_b") >= F.col("block")))
    same = own & (F.col("block") == F.col("block_b"))
    pairs = pairs.select(*CELL, "block", "label_b", "dim_b", "c0_b", "c1_b", "block_b", same.alias("same"))
    first = packed.withColumnRenamed("rows", "a")
    second = packed.select(*there, F.col("block").alias("block_b"), F.col("rows").alias("b"))
    return (
        pairs.join(second, [*(f"{c}_b" for c in CELL), "block_b"]).join(first, [*CELL, "block"])
        .select("dim", "a", "b", "same")
    )


def _compared(tiles: DataFrame, basis: dict[int, np.ndarray], threshold: float, id_type: str) -> DataFrame:
    """rep, g, links (other vectors linked within the tile), root (the smallest
    vector it is tied to there)."""
    schema = f"rep {id_type}, g bigint, links bigint, root {id_type}"

    def side(column: pa.Array, dim: int):
        rows = column.flatten()
        x = _matrix(rows.field("v"), dim)
        y = unit_rows(x)
        return (rows.field("rep"), rows.field("g"), rows.field("copies").to_numpy(zero_copy_only=False), x,
                y @ basis[dim] if dim in basis else y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                dims, a, b, same = (c.slice(k, 1) for c in batch.columns)
                dim, same = dims[0].as_py(), same[0].as_py()
                reps, gs, copies, x, y = side(a, dim)
                if same:
                    i, j = linked(y, y, x, x, threshold, True)
                else:
                    reps_b, gs_b, copies_b, x_b, y_b = side(b, dim)
                    i, j = linked(y, y_b, x, x_b, threshold, False)
                    j = j + len(x)
                    reps, gs = pa.concat_arrays([reps, reps_b]), pa.concat_arrays([gs, gs_b])
                    copies = np.r_[copies, copies_b]
                if not len(i):
                    continue
                n = len(copies)
                links = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
                at = np.flatnonzero(links)
                root = tied(i, j, n)[at]
                yield pa.RecordBatch.from_arrays(
                    [reps.take(pa.array(at)), gs.take(pa.array(at)), pa.array(links[at].astype(np.int64)),
                     reps.take(pa.array(root))], names=["rep", "g", "links", "root"])

    small_batches(tiles.sparkSession)
    return tiles.mapInArrow(run, schema)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    given = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    rows = given.where(_usable()).withColumn("g", F.xxhash64("label", "v"))
    id_type = rows.schema["id"].dataType.simpleString()
    sample: dict[int, list] = {}
    for r in sorted(hash_sample(rows.select("id", "v"), F.col("id"), SAMPLE).collect()):
        sample.setdefault(len(r.v), []).append(r.v)
    basis = {dim: axes(unit_rows(np.array(x))) for dim, x in sample.items()}
    reps = rows.groupBy("label", "v", "g").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    reps = stored(_with_cells(reps, basis, threshold), "vectors")
    found = stored(_compared(_tiles(reps), basis, threshold, id_type), "tile-links")

    owners = rows.join(reps.select("label", "v", "g", "rep", "copies"), ["g", "label", "v"]).select("id", "g", "rep", "copies")
    owners = stored(owners, "owners")
    twice = owners.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("_b")).where("a < _b")
    ties = found.select(F.col("rep").alias("a"), F.col("root").alias("b")).unionByName(
        owners.join(twice, "id").select("a", F.col("rep").alias("b")))
    own = components(ties, "a", "b").select(F.col("id").alias("_rep"), "component")
    counts = found.groupBy("rep", "g").agg(F.sum("links").alias("links"))
    known = (
        owners.join(counts, ["rep", "g"], "left").join(own, F.col("rep") == F.col("_rep"), "left")
        .select("id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                F.coalesce("component", "rep").alias("component_id"))
    )
    rest = given.where(~_usable()).select(
        "id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return known.unionByName(rest).select(
        F.col("id").alias(id_col), "n_links", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op5_pca_tiles(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))
