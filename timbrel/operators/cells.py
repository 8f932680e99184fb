"""Exact nearest neighbours through cells: a metric index for vectors, a grid for points.

Both skip whatever cannot hold an answer and give the same rows as comparing everything. Cells
that hold too much are split, so no task gets a whole hot cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timbrel.operators.vectors import BROADCAST_BYTES, CELLS, ROWS_PER_BLOCK, _stack, _unit
from timbrel.session import materialise

MAX_PIVOTS = 2048
# Distances come from cosines, whose rounding shows in the root.
SLACK = 1e-7
# Most points of a grid cell that is not split, and the depth at which splitting ends.
LEAF = 16
DEEPEST = 16
# Halvings of a side from one depth of the grid to the next: sixteen parts a cell.
HALVINGS = 2


# --- vectors: cells around pivots ---------------------------------------------------------------


def _lifted(unit: np.ndarray, place: int) -> np.ndarray:
    """Two more columns that give every vector length one and leave row-by-reference products.

    Zero vectors thereby become points of the same sphere, and chords order as similarities do.
    """
    rest = np.zeros((len(unit), 2))
    rest[:, place] = np.sqrt(np.maximum(0.0, 1.0 - (unit * unit).sum(axis=1)))
    return np.hstack([unit, rest])


def _chords(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def _bundles(
    counts: dict[int, int], centres: np.ndarray, block: int
) -> tuple[np.ndarray, list[int]]:
    """(bundle of every cell or -1, parts of every bundle).

    Cells are halved along their widest direction until a bundle holds ``block`` references; a
    cell that is larger alone is a bundle of several parts.
    """
    of_cell, parts = np.full(len(centres), -1), []
    groups = [np.array(sorted(counts), dtype=np.int64)]
    while groups:
        group = groups.pop()
        n = sum(counts[cell] for cell in group)
        if n > block and len(group) > 1:
            spread = centres[group] - centres[group].mean(axis=0)
            along = spread @ np.linalg.eigh(spread.T @ spread)[1][:, -1]
            order = np.argsort(along, kind="stable")
            groups += [group[order[: len(group) // 2]], group[order[len(group) // 2 :]]]
        else:
            of_cell[group] = len(parts)
            parts.append(math.ceil(n / block))
    return of_cell, parts


def visits(
    rows: DataFrame, refs: DataFrame, k: int = 5, row_id: str = "row_id", ref_id: str = "vec_id",
    vec: str = "embedding", skip_self: bool = False, max_pivots: int = MAX_PIVOTS,
    block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Candidates among which are the k best: (row_id, ref_id, cohort, similarity, visited).

    The root of the number of references, ``max_pivots`` at most, serve as pivots (picked by
    hash); every reference belongs to its nearest one. Near cells travel in bundles of ``block``
    references; larger cells are cut by hash, and so are the rows of a bundle. A row first meets
    one part of the bundle around its nearest pivot. The k best found bound its answer, and of
    the other cells it meets those whose ring around their pivot is not farther away.
    ``visited`` counts comparisons; a line without ``row_id`` counts those of rows that found
    nothing nearer in a group. Of equal reference vectors only the lowest ids that can be asked
    for take part. Rows and references without a vector are left out; ``row_id`` is unique.
    """
    spark = rows.sparkSession
    want = k + 1 if skip_self else k
    schema = "row_id long, ref_id long, cohort long, similarity double, visited long"
    rows = rows.select(F.col(row_id).cast("long").alias("row_id"), F.col(vec).alias("v"))
    rows = rows.filter(F.col("v").isNotNull())
    same = Window.partitionBy("v").orderBy("ref_id")
    distinct = materialise(
        refs.select(
            F.col(ref_id).cast("long").alias("ref_id"), F.col("cohort").cast("long"),
            F.col(vec).alias("v"),
        )
        .filter(F.col("v").isNotNull())
        .withColumn("_n", F.row_number().over(same))
        .filter(F.col("_n") <= want)
        .drop("_n"),
        "references",
    )
    size = distinct.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    if not size["n"]:
        return spark.createDataFrame([], schema)
    count = min(max_pivots, math.ceil(math.sqrt(size["n"])), BROADCAST_BYTES // (8 * size["d"] + 16))
    picked = distinct.orderBy(F.xxhash64("ref_id"), "ref_id").limit(max(1, count)).toPandas()
    pivots = spark.sparkContext.broadcast(
        (_lifted(_unit(_stack(picked["v"])), 0), picked["ref_id"].to_numpy())
    )

    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres = pivots.value[0]
        for part in parts:
            if len(part):
                d = _chords(_lifted(_unit(_stack(part["v"])), 0), centres)
                cell = d.argmin(axis=1)
                yield part.assign(cell=cell, away=d[np.arange(len(d)), cell])

    kind = distinct.schema["v"].dataType.simpleString()
    index = materialise(
        distinct.mapInPandas(
            assign, f"ref_id long, cohort long, v {kind}, cell int, away double"
        ),
        "index",
    )
    # one row per pivot
    rings = index.groupBy("cell").agg(
        F.min("away").alias("low"), F.max("away").alias("high"), F.count(F.lit(1)).alias("n")
    ).toPandas()
    low, high = np.full(len(picked), np.inf), np.full(len(picked), -np.inf)
    low[rings["cell"]], high[rings["cell"]] = rings["low"], rings["high"]
    of_cell, splits = _bundles(
        dict(zip(rings["cell"].tolist(), rings["n"].tolist(), strict=True)), pivots.value[0], block
    )
    filled = of_cell >= 0

    def gaps(d: np.ndarray) -> np.ndarray:
        """Least possible distance from a row at ``d`` from the pivots to each cell's members."""
        own = d.min(axis=1, keepdims=True)
        # a member is nearer to its own pivot than to the row's, hence the half difference
        near = np.maximum((d - own) / 2, np.maximum(d - high, low - d))
        return np.where(filled, np.maximum(near, 0.0), np.inf)

    def first(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, ids = pivots.value
        for part in parts:
            for piece, d in _slices(part, centres):
                home = of_cell[np.where(filled, d, np.inf).argmin(axis=1)]
                if skip_self:
                    d = np.where(piece["row_id"].to_numpy()[:, None] == ids[None, :], np.inf, d)
                bound = np.full(len(d), np.inf)
                if d.shape[1] >= k:
                    bound = np.partition(d, k - 1, axis=1)[:, k - 1]
                yield piece.assign(bound=bound, bundle=home)

    def others(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for piece, d in _slices(part, pivots.value[0]):
                open_ = gaps(d) <= piece["bound"].to_numpy()[:, None] + SLACK
                yield piece.assign(bundles=[np.unique(of_cell[o]).tolist() for o in open_])

    # one row per bundle, of which there are no more than pivots
    sizes = F.broadcast(spark.createDataFrame(list(enumerate(splits)), "bundle int, ref_parts int"))
    places = F.broadcast(spark.createDataFrame(
        [(int(i), int(b)) for i, b in enumerate(of_cell) if b >= 0], "cell int, bundle int"
    ))
    keys = ["bundle", "row_part", "ref_part"]

    def meet(each: DataFrame, answer, schema: str) -> DataFrame:
        """Rows (bundle, ref_part, row_id, v, bound) with the references of their parts."""
        load = each.groupBy("bundle").agg(F.count(F.lit(1)).alias("n")).collect()
        cut = F.broadcast(spark.createDataFrame(
            [(r["bundle"], math.ceil(r["n"] / splits[r["bundle"]] / ROWS_PER_BLOCK)) for r in load],
            "bundle int, row_parts int",
        ))
        left = each.join(cut, "bundle").withColumn(
            "row_part", F.pmod(F.xxhash64("row_id"), F.col("row_parts")).cast("int"))
        right = index.join(places, "cell").join(sizes, "bundle").join(cut, "bundle").withColumn(
            "ref_part", F.pmod(F.xxhash64("ref_id"), F.col("ref_parts")).cast("int")
        ).withColumn("row_part", F.explode(F.sequence(F.lit(0), F.col("row_parts") - 1)))

        def group(part: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
            centres = pivots.value[0]
            cells = [(cell, t["ref_id"].to_numpy(), t["cohort"].to_numpy(), _unit(_stack(t["v"])))
                     for cell, t in table.groupby("cell")]
            out = [answer(piece, *_visit(piece, d, cells, gaps, k, skip_self))
                   for piece, d in _slices(part, centres, len(table))]
            return pd.concat(out) if out else answer(part, *_visit(part, None, [], gaps, k, skip_self))

        return left.select(*keys, "row_id", "v", "bound").groupBy(*keys).cogroup(
            right.select(*keys, "ref_id", "cohort", "v", "cell").groupBy(*keys)
        ).applyInPandas(group, schema)

    def at_home(piece, top, visited, bound):
        hits = [[] for _ in range(len(piece))]
        for at, *hit in top.itertuples(index=False):
            hits[at].append(tuple(hit))
        return piece[["bundle", "ref_part", "row_id", "v"]].assign(
            bound=bound, visited=visited, hits=hits)

    def elsewhere(piece, top, visited, bound):
        at = top["at"].to_numpy()
        new = ~pd.Series(at).duplicated().to_numpy()
        rest = visited.sum() - visited[at[new]].sum()
        found = pd.DataFrame({
            "row_id": pd.array(piece["row_id"].to_numpy()[at], dtype="Int64"),
            "ref_id": top["ref_id"].array, "cohort": top["cohort"].array,
            "similarity": top["similarity"].to_numpy(), "visited": np.where(new, visited[at], 0)})
        none = pd.array([None], dtype="Int64")
        return pd.concat([found, pd.DataFrame({
            "row_id": none, "ref_id": none, "cohort": none, "similarity": [np.nan],
            "visited": [rest]})]) if rest else found

    kind_row = rows.schema["v"].dataType.simpleString()
    start = materialise(
        rows.mapInPandas(first, f"row_id long, v {kind_row}, bound double, bundle int"), "start")
    home = materialise(
        meet(
            start.join(sizes, "bundle").withColumn(
                "ref_part", F.pmod(F.xxhash64("row_id"), F.col("ref_parts")).cast("int")),
            at_home,
            f"bundle int, ref_part int, row_id long, v {kind_row}, bound double, visited long, "
            "hits array<struct<ref_id: long, cohort: long, similarity: double>>",
        ),
        "home",
    )
    routed = materialise(
        home.select("row_id", "v", "bound", F.col("bundle").alias("own"),
                    F.col("ref_part").alias("own_part"))
        .mapInPandas(others, f"row_id long, v {kind_row}, bound double, own int, own_part int, "
                             "bundles array<int>"),
        "routed",
    )
    each = (
        routed.withColumn("bundle", F.explode("bundles")).join(sizes, "bundle")
        .withColumn("ref_part", F.explode(F.sequence(F.lit(0), F.col("ref_parts") - 1)))
        .filter((F.col("bundle") != F.col("own")) | (F.col("ref_part") != F.col("own_part")))
    )
    near = home.select("row_id", "visited", F.posexplode_outer("hits").alias("p", "h")).select(
        "row_id", "h.ref_id", "h.cohort", "h.similarity",
        F.when(F.coalesce("p", F.lit(0)) == 0, F.col("visited")).otherwise(0).alias("visited"))
    return near.unionByName(meet(each, elsewhere, schema))


def _slices(part: pd.DataFrame, centres: np.ndarray, width: int = 0):
    """Pieces of rows with their distances from the pivots, small enough for one matrix each."""
    step = max(1, CELLS // max(width, len(centres)))
    for start in range(0, len(part), step):
        piece = part.iloc[start : start + step]
        yield piece, _chords(_lifted(_unit(_stack(piece["v"])), 1), centres)


def _lines(at, ref_ids, cohorts, similarity) -> pd.DataFrame:
    # whole numbers stay whole beside missing ones
    return pd.DataFrame({
        "at": at, "ref_id": pd.array(ref_ids, dtype="Int64"),
        "cohort": pd.array(cohorts, dtype="Int64"),
        "similarity": np.asarray(similarity, dtype=np.float64),
    })


def _visit(piece: pd.DataFrame, d, cells: list, gaps, k: int, skip_self: bool):
    """(best references of the rows by place, comparisons, bounds): near cells come first.

    ``d`` are the distances of the rows from the pivots. Only references that are at least as
    near as the bound, or as the k-th found so far, are looked at any further.
    """
    ids, visited = piece["row_id"].to_numpy(), np.zeros(len(piece), dtype=np.int64)
    bound = piece["bound"].to_numpy(dtype=np.float64).copy()
    found = [_lines(*[np.zeros(0, dtype=np.int64)] * 4)]
    if cells and len(piece):
        unit, gap = _unit(_stack(piece["v"])), gaps(d)
        best = np.full((len(ids), k), -np.inf)
        # products of matrices differ in the last digits with the place of a pair
        floor = np.where(np.isfinite(bound), 1.0 - bound * bound / 2, -np.inf) - 1e-9
    for cell, ref_ids, cohorts, refs in sorted(cells, key=lambda c: gap[:, c[0]].mean()):
        need = np.flatnonzero(gap[:, cell] <= bound + SLACK)
        if not len(need):
            continue
        sims = unit[need] @ refs.T
        visited[need] += len(ref_ids)
        if skip_self:
            sims[ids[need][:, None] == ref_ids[None, :]] = -np.inf
        some = np.flatnonzero(sims.max(axis=1) >= floor[need])
        need, sims = need[some], sims[some]
        merged = np.hstack([best[need], sims])
        best[need] = -np.sort(np.partition(-merged, k - 1, axis=1)[:, :k], axis=1)
        floor[need] = np.maximum(floor[need], best[need, k - 1] - 1e-9)
        chord = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.maximum(best[need, k - 1], -1.0)))
        bound[need] = np.minimum(
            bound[need], np.where(np.isfinite(best[need, k - 1]), chord, np.inf))
        at, ref = np.nonzero((sims >= floor[need][:, None]) & np.isfinite(sims))
        exact = (unit[need[at]] * refs[ref]).sum(axis=1)
        found.append(_lines(need[at], ref_ids[ref], cohorts[ref], exact))
    top = pd.concat(found).sort_values(
        ["at", "similarity", "ref_id"], ascending=[True, False, True])
    return top.groupby("at", sort=False).head(k), visited, bound


def nearest_pruned(
    rows: DataFrame, refs: DataFrame, k: int = 5, row_id: str = "row_id", ref_id: str = "vec_id",
    vec: str = "embedding", skip_self: bool = False, **bounds: int,
) -> DataFrame:
    """The answer of ``vectors.nearest_references`` by way of ``visits``."""
    parts = visits(rows, refs, k, row_id, ref_id, vec, skip_self, **bounds)
    w = Window.partitionBy("row_id").orderBy(F.desc("similarity"), "ref_id")
    return (
        parts.filter(F.col("ref_id").isNotNull())
        .withColumn("rank", F.row_number().over(w).cast("long"))
        .filter(F.col("rank") <= k)
        .select("row_id", "rank", "ref_id", "cohort", "similarity")
    )


# --- points: a grid that is finer where points are dense ----------------------------------------


def nearest_on_grid(
    rows: DataFrame, points: DataFrame, radius: float, row_id: str = "row_id",
    ref_id: str = "point_id", leaf: int = LEAF,
) -> DataFrame:
    """Nearest point strictly nearer than ``radius``: (row_id, ref_id, distance).

    Both sides have finite ``x`` and ``y`` (other rows have no answer); equal distances go to the
    lower id, ``row_id`` is unique, and coordinates stay below 2^31 radii. Rows start from the nine
    cells around them, as wide as the radius. A cell with more than ``leaf`` different points is
    cut into sixteen, and a row keeps the parts whose nearest possible point is not farther than
    the farthest possible one of another. Only the cells left at the end are compared point by point.
    """
    side = radius * (1 + 1e-9)
    finite = F.col("x").between(-1e300, 1e300) & F.col("y").between(-1e300, 1e300)

    def cell(level: int) -> list[Column]:
        scale = F.lit(float(2 ** (HALVINGS * level)))
        return [F.floor(F.col(a) / side * scale).alias(f"c{a}") for a in ("x", "y")]

    open_points = materialise(
        points.filter(finite).groupBy("x", "y").agg(F.min(ref_id).alias("ref_id")), "points"
    )
    around = rows.filter(finite).select(F.col(row_id).alias("row_id"), "x", "y", *cell(0)).select(
        "row_id", "x", "y", F.col("cx").alias("kx"), F.col("cy").alias("ky"),
        F.lit(float(radius)).alias("bound"),
    )

    def nearest(b: Column) -> Column:
        return F.hypot(F.greatest(b["x0"] - F.col("x"), F.col("x") - b["x1"], F.lit(0.0)),
                       F.greatest(b["y0"] - F.col("y"), F.col("y") - b["y1"], F.lit(0.0)))

    def farthest(b: Column) -> Column:
        return F.hypot(F.greatest(F.abs(F.col("x") - b["x0"]), F.abs(F.col("x") - b["x1"])),
                       F.greatest(F.abs(F.col("y") - b["y0"]), F.abs(F.col("y") - b["y1"])))

    own = Window.partitionBy("row_id")
    aside = F.array(*[F.lit(i).cast("long") for i in (-1, 0, 1)])
    done, leaves = [], []
    for level in range(DEEPEST + 1):
        boxed = materialise(
            open_points.groupBy(*cell(level)).agg(
                F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"),
                F.min("y").alias("y0"), F.max("y").alias("y1"),
            ),
            "boxes",
        )
        # at most nine boxes around a cell of the first depth, sixteen within a cell of a later one
        if level == 0:
            keyed = boxed.withColumn("_i", F.explode(aside)).withColumn("_j", F.explode(aside))
            key = [F.col("cx") + F.col("_i"), F.col("cy") + F.col("_j")]
        else:
            keyed = boxed
            key = [F.shiftright("cx", HALVINGS), F.shiftright("cy", HALVINGS)]
        boxes = keyed.groupBy(key[0].alias("kx"), key[1].alias("ky")).agg(
            F.collect_list(F.struct("cx", "cy", "n", "x0", "x1", "y0", "y1")).alias("boxes"))
        sure = F.array_min(F.transform("boxes", farthest)) * (1 + 1e-12)
        kept = materialise(
            around.join(boxes, ["kx", "ky"])
            .withColumn("bound", F.min(F.least("bound", sure)).over(own))
            .withColumn("b", F.explode(F.filter("boxes", lambda b: nearest(b) <= F.col("bound"))))
            .select("row_id", "x", "y", "b.cx", "b.cy", nearest(F.col("b")).alias("low"),
                    "bound", "b.n"),
            "kept",
        )
        large = (F.col("n") > leaf) & F.lit(level < DEEPEST)
        at = F.lit(level).alias("level")
        placed = open_points.select("*", *cell(level))
        done.append(kept.filter(~large).select(at, "cx", "cy", "row_id", "x", "y", "low", "bound"))
        split = boxed.filter(large).select("cx", "cy")
        if split.isEmpty():
            leaves.append(placed.select(at, "cx", "cy", F.col("x").alias("px"),
                                        F.col("y").alias("py"), "ref_id"))
            break
        leaves.append(placed.join(split, ["cx", "cy"], "left_anti").select(
            at, "cx", "cy", F.col("x").alias("px"), F.col("y").alias("py"), "ref_id"))
        open_points = materialise(
            placed.join(split, ["cx", "cy"], "left_semi").select("x", "y", "ref_id"), "points"
        )
        around = kept.filter(large).select(
            "row_id", "x", "y", F.col("cx").alias("kx"), F.col("cy").alias("ky"), "bound")

    def union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionByName(frame)
        return out

    open_cells = (
        union(done).withColumn("bound", F.min("bound").over(own))
        .filter(F.col("low") <= F.col("bound")).drop("low", "bound")
    )
    distance = F.sqrt(
        (F.col("x") - F.col("px")) * (F.col("x") - F.col("px"))
        + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py"))
    )
    return (
        open_cells.join(union(leaves), ["level", "cx", "cy"])
        .select("row_id", F.struct(distance.alias("distance"), "ref_id").alias("_p"))
        .filter(F.col("_p.distance") < radius)
        .groupBy("row_id")
        .agg(F.min("_p").alias("_p"))
        .select("row_id", "_p.ref_id", "_p.distance")
    )
