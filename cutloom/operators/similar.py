"""Similar cases by an inverted-list index over vectors.

Coarse centroids are fitted on a bounded sample; every case is listed in the cell of its nearest one. A query looks into the cells nearest to it, and what it finds is
ranked by the exact cosine. The angle to a centroid and the reach of its cell bound how near anything in it can be, so with ``exact`` all further cells that could hold a
better case are looked into as well. Crowded cells are dealt into parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutloom.tables import written

#: Vectors that centroids are fitted on at most, and centroids at most; rows of a cell's part, about.
SAMPLE, MOST_CELLS, PART_ROWS = 16_384, 1_024, 20_000
ROUNDS, STEP = 12, 1_024
CELL = "array<struct<cell: int, angle: double>>"
FOUND = "query_id long, case_id long, similarity double"


@dataclass(frozen=True)
class Index:
    """``lists`` (cell, part, id, block, vector), unit vectors in their cells; ``cells`` (cell, parts, reach), the largest angle in each; the centroids."""

    lists: DataFrame
    cells: DataFrame
    centroids: np.ndarray


def units(vectors: pa.Array) -> np.ndarray:
    """The vectors at length 1; rows that are null or without a length are all 0."""
    made = [np.asarray(v.as_py() if v.is_valid else (), float) for v in vectors]
    width = max((len(v) for v in made), default=0)
    whole = np.array([v if len(v) == width else np.zeros(width) for v in made]).reshape(len(made), width)
    length = np.linalg.norm(whole, axis=1, keepdims=True)
    return np.divide(whole, length, out=np.zeros_like(whole), where=length > 0)


def fitted(vectors: np.ndarray, cells: int) -> np.ndarray:
    """``cells`` centroids of unit vectors by a few rounds of spherical k-means, the same for the same vectors in one order; fewer where there are fewer vectors."""
    known = np.unique(vectors, axis=0)
    centroids = known[np.linspace(0, len(known) - 1, min(cells, len(known))).astype(int)] if len(known) else known
    for _ in range(ROUNDS if len(known) > cells else 0):
        nearest = np.argmax(vectors @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, vectors)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), centroids)
    return centroids


def with_cells(rows: DataFrame, vector: str, centroids: np.ndarray, most: int) -> DataFrame:
    """``rows`` with ``_near``, the ``most`` nearest cells and the angles to them, nearest first (none for a vector without a length), and ``_unit``, the vector at length 1."""
    held = rows.sparkSession.sparkContext.broadcast(centroids)

    @F.arrow_udf(f"struct<near: {CELL}, unit: array<double>>")
    def listed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            near, own = [], units(batch)
            for step in range(0, len(own), STEP):
                part = own[step : step + STEP]
                angles = np.arccos(np.clip(part @ held.value.T, -1, 1)) if part.shape[1] == held.value.shape[1] else np.zeros((len(part), 0))
                first = np.argsort(angles, axis=1, kind="stable")[:, :most]
                near += [[{"cell": int(c), "angle": float(a[c])} for c in cs] if np.any(v) else [] for v, a, cs in zip(part, angles, first, strict=True)]
            yield pa.array([{"near": n, "unit": v.tolist()} for n, v in zip(near, own, strict=True)], pa.struct([("near", pa.list_(pa.struct([("cell", pa.int32()), ("angle", pa.float64())]))), ("unit", pa.list_(pa.float64()))]))

    return rows.withColumn("_x", listed(F.col(vector))).withColumns({"_near": F.col("_x")["near"], "_unit": F.col("_x")["unit"]}).drop("_x")


def built(history: DataFrame, block: str, vector: str = "embedding", cells: int | None = None, sample: int = SAMPLE) -> Index:
    """An index over every row of ``history`` (id, block, vector). The sample is the first by a hash of the id; cells are about the root of the rows by default. Rows whose
    vector is null, of another length than most or without a length are in no list."""
    n = history.count()
    chosen = history.orderBy(F.xxhash64("id"), "id").limit(sample).select(F.col(vector).cast("array<double>").alias("v")).collect()
    vectors = units(pa.array([r["v"] for r in chosen], pa.list_(pa.float64())))
    centroids = fitted(vectors[np.any(vectors, axis=1)] if len(vectors) else vectors, cells or int(min(MOST_CELLS, max(1, n**0.5))))
    placed = with_cells(history, vector, centroids, 1).where("size(_near) > 0")
    lists = written(placed.select("id", F.col(block).alias("block"), F.col("_unit").alias("vector"), F.col("_near")[0]["cell"].alias("cell"), F.col("_near")[0]["angle"].alias("angle")), "case_index")
    known = written(lists.groupBy("cell").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"), F.max("angle").alias("reach")), "case_cells")
    return Index(lists.join(F.broadcast(known), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")), known, centroids)


def looked_up(wanted: DataFrame, index: Index, k: int) -> DataFrame:
    """(query_id, case_id, similarity): the best ``k`` of each part of the cells that a query (query_id, block, vector, cell) looks into, of its block and without itself."""

    def best(queries: pa.Table, cases: pa.Table) -> pa.Table:
        rows = []
        if queries.num_rows and cases.num_rows:
            ids, blocks = cases.column("id").to_pylist(), np.array(cases.column("block").to_pylist(), object)
            vectors = np.array(cases.column("vector").to_pylist())
            for query, block, vector in zip(*(queries.column(c).to_pylist() for c in ("query_id", "block", "vector")), strict=True):
                own = [i for i in np.flatnonzero(blocks == block) if ids[i] != query]
                # twelve places, so that equal vectors tie and ids decide
                alike = np.round(vectors[own] @ np.array(vector), 12) if own else ()
                rows += [(query, ids[i], float(s)) for s, i in sorted(zip(alike, own, strict=True), key=lambda x: (-x[0], ids[x[1]]))[:k]]
        return pa.table({n: pa.array([r[j] for r in rows], t) for j, (n, t) in enumerate((("query_id", pa.int64()), ("case_id", pa.int64()), ("similarity", pa.float64())))})

    # a tile holds a part of a cell's cases and a part of the queries that look into it; both tables below have a row a cell
    turns = wanted.groupBy("cell").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("turns"))
    tiles = F.broadcast(turns.join(index.cells.select("cell", "parts"), "cell"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sent = wanted.join(tiles, "cell").withColumns({"part": every("parts")}).withColumn("turn", F.pmod(F.xxhash64("query_id"), F.col("turns")).cast("int"))
    held = index.lists.join(tiles.drop("parts"), "cell").withColumn("turn", every("turns"))
    tile = ["cell", "part", "turn"]
    left, right = sent.select("query_id", "block", "vector", *tile), held.select("id", "block", "vector", *tile)
    return left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(best, FOUND)


def similar(queries: DataFrame, index: Index, block: str, k: int = 5, probes: int = 8, exact: bool = False, vector: str = "embedding") -> DataFrame:
    """(query_id, case_id, similarity, place): the ``k`` most similar cases of each query's (id, block, vector) own block by cosine, the smaller id of equals first.

    Without ``exact`` only the ``probes`` nearest cells are looked into. Queries without a length or a block find nothing; a query is never its own case.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "case_id")
    ranked = lambda df: df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    every = written(with_cells(queries, vector, index.centroids, len(index.centroids) if exact else probes).select(F.col("id").alias("query_id"), F.col(block).alias("block"), F.col("_unit").alias("vector"), F.col("_near").alias("near")), "case_queries")
    first = every.withColumn("cell", F.explode(F.slice("near", 1, probes)["cell"]))
    found = looked_up(first, index, k)
    if exact:
        found = written(ranked(found).drop("place"), "case_found")
        least = found.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("similarity")).otherwise(-1.0).alias("least"))
        further = every.join(least, "query_id", "left").withColumn("x", F.explode(F.slice("near", probes + 1, max(1, len(index.centroids)))))
        further = further.withColumns({"cell": F.col("x")["cell"], "angle": F.col("x")["angle"]}).join(F.broadcast(index.cells.select("cell", "reach")), "cell")
        bound = F.cos(F.greatest(F.col("angle") - F.col("reach"), F.lit(0.0)))
        found = found.unionByName(looked_up(further.where(bound >= F.coalesce("least", F.lit(-1.0)) - 1e-9), index, k))
    return ranked(found)


def probes_for(queries: DataFrame, index: Index, block: str, k: int = 5, recall: float = 0.95, vector: str = "embedding", most: int = 256) -> int:
    """In how many cells to look so that ``recall`` of the ``k`` most similar cases is found, measured on at most ``most`` of the queries (the first by a hash of the id).

    Their cases are found exactly; each lies in some place of its query's list of cells, and the quantile of those places is the answer.
    """
    some = queries.orderBy(F.xxhash64("id"), "id").limit(most)
    near = with_cells(some, vector, index.centroids, len(index.centroids)).select(F.col("id").alias("query_id"), F.transform("_near", lambda c: c["cell"]).alias("cells"))
    found = similar(some, index, block, k, exact=True, vector=vector).join(near, "query_id").join(index.lists.select(F.col("id").alias("case_id"), "cell"), "case_id")
    place = found.agg(F.percentile(F.array_position("cells", F.col("cell")), F.lit(recall))).first()[0]
    return max(1, int(-(-(place or 1) // 1)))


def remembered(found: DataFrame, history: DataFrame, near: float = 0.9) -> DataFrame:
    """What past cases say for each query: query_id, n, accepts, rejects, best, match_reason, notes (best first) and priority.

    ``found`` as from ``similar``; ``history`` (id, verdict, note). The reason is ``near_case`` from a similarity of ``near`` on, else ``same_class``. A query with a rejected case is
    reviewed first, one with accepted ones only last; a verdict other than accept and reject is neither.
    """
    said = history.select(F.col("id").alias("case_id"), "verdict", "note")
    own = found.join(said, "case_id", "left").groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "accept").alias("accepts"), F.count_if(F.col("verdict") == "reject").alias("rejects"), F.max("similarity").alias("best"), F.array_sort(F.collect_list(F.struct("place", "note"))).alias("_notes"))
    priority = F.when(F.col("rejects") > 0, "review_first").when((F.col("accepts") > 0) & (F.col("accepts") == F.col("n")), "review_last").otherwise("normal")
    return own.select("query_id", "n", "accepts", "rejects", "best", F.when(F.col("best") >= near, "near_case").otherwise("same_class").alias("match_reason"), F.transform("_notes", lambda x: x["note"]).alias("notes"), priority.alias("priority"))
