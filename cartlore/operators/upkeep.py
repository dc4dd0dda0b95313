"""Keeping a stored cell index up to date: increments by the stored centres, drift of cell sizes, splits of oversized cells."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors
from ..session import stored
from ..sources import files
from ..sources.keyed import KeyedTable
from . import similarity as sim
from .centres import SAMPLE_ROWS, Centres, means

OVERSIZED = 4.0  # times the mean size of a cell


def _places(spark: SparkSession, path: str, index: sim.IvfIndex) -> KeyedTable:
    """Where each id lies; made from the rows the first time."""
    table = KeyedTable(spark, f"{path}/places", (index.id,))
    if not table.exists():
        table.update(index.rows.select(index.id, "cell"), lambda _old, new: new)
    return table


def _replace_cells(index: sim.IvfIndex, path: str, rows: DataFrame, cells: list[int]) -> DataFrame:
    """Write ``rows``, which are all that the given cells are to have; a cell without any goes."""
    merged = stored(rows, "cells")
    sim.write_cells(merged, path)
    left = {r["cell"] for r in merged.select("cell").distinct().collect()}
    for cell in set(cells) - left:
        files.delete_tree(merged.sparkSession, f"{path}/rows/cell={cell}")
    return merged


def update_index(spark: SparkSession, path: str, changed: DataFrame | None = None, deleted: DataFrame | None = None) -> list[int]:
    """Bring rows into a stored index and take ids out; returns the cells that were written.

    ``changed`` has the columns of the indexed table, one row per id; new ids are added, known ones replaced, in the cell nearest to
    them by the stored centres (none if they have no vector). ``deleted`` has the ids to take out; an id in both stays. Only cells that win or lose rows are read and
    written. An update that was broken off is to be run again with the same rows, which gives the same index.
    """
    index = sim.read_vectors(spark, path)
    places, key = _places(spark, path, index), index.id
    gone = [df.select(F.col(key)) for df in (changed, deleted) if df is not None]
    if not gone:
        return []
    bare = index.rows.drop("cell")
    fresh = spark.createDataFrame([], bare.schema) if changed is None else changed.select(bare.columns)
    fresh = stored(sim.nearest_cells(fresh.filter(F.size(index.vec) > 0), index.centres, 1, index.vec), "fresh")
    ids = stored(reduce(DataFrame.unionByName, gone).distinct(), "ids")
    schema = T.StructType([index.rows.schema[key], T.StructField("cell", T.IntegerType())])
    buckets = [r[0] for r in ids.select(places.bucket).distinct().collect()]
    old = places.read(schema, buckets).join(ids, key, "left_semi")
    cells = sorted({r[0] for r in old.select("cell").unionByName(fresh.select("cell")).distinct().collect()})  # numbers of cells
    if not cells:
        return []
    kept = index.rows.filter(F.col("cell").isin(cells)).join(ids, key, "left_anti")
    _replace_cells(index, path, kept.unionByName(fresh), cells)
    now = ids.join(fresh.select(key, "cell"), key, "left")
    places.update(now, lambda before, new: before.join(new, key, "left_anti").unionByName(new.filter("cell IS NOT NULL")))
    return cells


def cell_sizes(index: sim.IvfIndex) -> DataFrame:
    """(cell, n, share): rows of each cell, and how many times the mean of all cells that is; drift shows as large shares."""
    mean = index.rows.count() / len(index.centres)
    return index.rows.groupBy("cell").agg(F.count("*").alias("n"), (F.count("*") / F.lit(mean)).alias("share"))


def split_oversized(spark: SparkSession, path: str, factor: float = OVERSIZED, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> list[int]:
    """Split cells of more than ``factor`` times the mean size, each into as many as bring it to the mean; returns all cells written.

    The new centres of a cell come from a sample of its rows; the first takes the cell's number, the others new ones below the same top centre.
    No other cell is read or written. A cell of equal vectors cannot be split and stays. Centres are stored before rows move,
    so a search in between misses nothing but what lies in cells being replaced.
    """
    index = sim.read_vectors(spark, path)
    sizes = {r["cell"]: r["n"] for r in index.rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row per cell
    mean = sum(sizes.values()) / len(index.centres)
    large = {c: n for c, n in sizes.items() if n > factor * mean}
    if not large:
        return []
    rows = index.rows.filter(F.col("cell").isin(list(large)))
    shares = F.create_map(*(F.lit(x) for c, n in large.items() for x in (c, min(1.0, sample_rows / n))))
    drawn = F.pmod(F.xxhash64(index.id, F.lit("split")), F.lit(1 << 30)) < F.element_at(shares, F.col("cell")) * (1 << 30)
    sample = rows.filter(drawn).select("cell", vectors.l2_normalize(F.col(index.vec)).alias("unit"))
    wanted = {c: int(np.ceil(n / mean)) for c, n in large.items()}

    def centres_of(table: pa.Table) -> pa.Table:
        unit, cell = table["unit"].combine_chunks(), table["cell"][0].as_py()
        x = unit.flatten().to_numpy(zero_copy_only=False).reshape(len(unit), -1).astype(float)
        found = means(x, wanted[cell], seed)
        return pa.table({"cell": pa.array([cell] * len(found), pa.int32()), "centre": pa.array(list(found), pa.list_(pa.float64()))})

    found = sample.groupBy("cell").applyInArrow(centres_of, "cell int, centre array<double>").collect()
    groups = {c: sorted(r["centre"] for r in found if r["cell"] == c) for c in large}
    groups = {c: own for c, own in groups.items() if len(own) > 1}
    if not groups:
        return []
    cells, parent = list(index.centres.cells), None if index.centres.parent is None else list(index.centres.parent)
    numbers: dict[int, list[int]] = {}
    for c, own in groups.items():
        numbers[c] = [c, *range(len(cells), len(cells) + len(own) - 1)]
        cells[c] = np.array(own[0])
        cells += [np.array(x) for x in own[1:]]
        if parent is not None:
            parent += [parent[c]] * (len(own) - 1)
    centres = Centres(np.array(cells), index.centres.tops, None if parent is None else np.array(parent))
    sim.write_centres(spark, centres, index.id, index.vec, path)

    written = sorted(n for own in numbers.values() for n in own)
    asked = {c: (np.array(own), Centres(centres.cells[own])) for c, own in numbers.items()}
    moved, vec = index.rows.filter(F.col("cell").isin(list(groups))), index.vec

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = batch.schema.get_field_index("cell")
                cell = batch.column(at).to_numpy().copy()
                units = sim._matrix(batch[vec])
                for c in np.unique(cell):
                    own = np.flatnonzero(batch.column(at).to_numpy() == c)
                    known, near = asked[int(c)]
                    cell[own] = known[near.probe(units[own], 1)[:, 0]]
                yield batch.set_column(at, batch.schema.field(at), pa.array(cell.astype(np.int32)))

    merged = _replace_cells(index, path, moved.mapInArrow(place, moved.schema), written)
    places = _places(spark, path, index)
    places.update(merged.select(index.id, "cell"), lambda before, new: before.join(new, index.id, "left_anti").unionByName(new))
    return written
