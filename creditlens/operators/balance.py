"""Weights for an unbalanced label, and synthetic minority rows."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from creditlens.functions.hashing import row_hash, unit_hash
from creditlens.operators.ranges import running_totals
from creditlens.session import MAX_SMALL_ROWS, write_stage

# --- fixed values ---------------------------------------------------------------------------

CLASS_WEIGHTS = {0: 1.0, 1: 10.0}
MINORITY_SHARE = 0.15
NEIGHBOURS = 5
SMOTE_SEED = 42


def balance_weights(df: DataFrame, label: str, out: str = "classWeightCol") -> DataFrame:
    """Label 0 weighs the share of the other rows, the others weigh the share of label 0."""
    positives = df.agg((1 - F.count_if(F.col(label) == 0) / F.count(F.lit(1))).alias("r")).scalar()
    return df.withColumn(out, F.when(F.col(label) == 0, positives).otherwise(1.0 - positives))


def class_weights(df: DataFrame, label: str, weights: dict = CLASS_WEIGHTS, out: str = "weight") -> DataFrame:
    column = None
    for key, w in weights.items():
        test = F.col(label) == key
        column = F.when(test, float(w)) if column is None else column.when(test, float(w))
    return df.withColumn(out, column)


# Nearest neighbours --------------------------------------------------------------------------
#
# Exact, without comparing all pairs. Equal rows are one point. Pivots cut the points into cells, and
# pivots chosen anew inside each crowded cell cut that one, until every cell fits a task: a tree of
# cells whose levels are tables. The neighbours in a point's own leaf bound the distance to its
# nearest ones; with that bound the point goes down the tree, and the triangle inequality rules cells
# out. All meetings are dealt to groups of bounded size, so a crowded cell is many tasks.


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, summed in column order so that they are the same everywhere."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        diff = a[:, j, None] - b[None, :, j]
        out += diff * diff
    return out


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.array(rows.tolist(), dtype="float64")


def _refuse_gaps(rows: DataFrame, features: list[str]) -> None:
    """A distance to a row with a null, NaN or infinite feature has no meaning."""
    bad = [F.count_if(F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True))).alias(f) for f, x in
           ((f, F.col(f).cast("double")) for f in features)]
    gaps = {f: n for f, n in rows.agg(*bad).first().asDict().items() if n}
    if gaps:
        raise ValueError(f"features without a finite value, and in how many rows: {gaps}")


def nearest_neighbours(
    points: DataFrame,
    row_id: str,
    features: list[str],
    k: int = NEIGHBOURS,
    cell: int = 1024,
    fanout: int = 1024,
    depth: int = 6,
    block: int = 4096,
) -> DataFrame:
    """The ``k`` nearest other rows of each row by Euclidean distance, ties by the smaller id.

    A cell of more than ``block`` points is split into one cell for every ``cell`` points, at most ``fanout``; cells that are
    still crowded after ``depth`` levels are cut into blocks of about ``block`` points.

    Result: (row_id, slot 0..k-1, neighbour, distance2); fewer slots if there are fewer other rows.
    """
    if (fanout + 1) ** depth >= 2**63:
        raise ValueError("the cells of such a tree have no numbers")
    _refuse_gaps(points, features)
    vector = F.array(*[F.col(f).cast("double") for f in features])
    rows = points.select(F.col(row_id).cast("long").alias("id"), vector.alias("v"))
    # Equal rows are one point, named by the smallest id.
    distinct = write_stage(rows.groupBy("v").agg(F.min("id").alias("point")), "points")
    leaves, levels = _grow(distinct, k, cell, fanout, depth, block)
    blocks = F.ceil(F.col("n") / block).cast("int")
    base = leaves.select(
        "cell", (row_hash(F.col("point"), 11) % blocks).cast("int").alias("block"),
        F.col("point").alias("other"), F.col("v").alias("w"),
    )
    at_blocks = ["cell", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), "point", "v"]
    best = W.partitionBy("point").orderBy("distance2", "neighbour")
    own = _block_neighbours(leaves.select(*at_blocks), base, k, block)
    own = write_stage(own.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r"), "own-cell")
    found = own
    if levels:
        visits = _descend(leaves, own, levels, k, block)
        found = own.unionByName(_block_neighbours(visits.select(*at_blocks), base, k, block))
    near_points = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")
    return _spread_to_rows(rows, distinct, near_points, row_id, k)


def _if_small(stage: DataFrame) -> DataFrame:
    """A written table, hinted as a broadcast side if its checked size allows."""
    return F.broadcast(stage) if stage.count() <= MAX_SMALL_ROWS else stage


def _meet(visitors: DataFrame, tables: DataFrame, keys: list[str], group: int, meeting, schema: str) -> DataFrame:
    """``meeting(visitors, table rows)`` of each key, in groups of about ``group`` visitors; the table rows go to each group."""
    crowds = visitors.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / group).cast("int").alias("groups"))
    crowds = _if_small(write_stage(crowds, "crowds"))
    dealt = (row_hash(F.col("point"), 17) % F.col("groups")).cast("int")
    visitors = visitors.join(crowds, keys).withColumn("grp", dealt).drop("groups")
    tables = tables.join(crowds, keys).withColumn("grp", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
    # Both sides may stem from one stage; new columns keep them apart.
    left, right = (df.toDF(*df.columns).groupBy(*keys, "grp") for df in (visitors, tables))
    return left.cogroup(right).applyInPandas(meeting, schema)


def _grow(distinct: DataFrame, k: int, cell: int, fanout: int, depth: int, block: int) -> tuple[DataFrame, list[DataFrame]]:
    """The points with their leaf (point, v, cell, n, bound), and per level its cells (parent, cell, centre, n, split, radius).

    A cell's (k + 1)-th smallest distance to its pivot bounds the distance from a point to k others; ``bound`` is the least such
    bound along the point's way down.
    """
    here = distinct.select(
        "point", "v", F.lit(0).cast("long").alias("cell"), F.lit(distinct.count()).cast("long").alias("n"),
        F.lit(float("inf")).alias("bound"),
    )
    leaves, levels = [], []
    for level in range(depth):
        leaves.append(here.where(F.col("n") <= block))
        here = here.where(F.col("n") > block)
        # The limit on the rank reaches the map side, so a crowded cell sends few rows per task.
        rank = F.row_number().over(W.partitionBy("cell").orderBy(row_hash(F.col("point"), 7 + level), "point"))
        chosen = here.withColumn("slot", rank).where(F.col("slot") <= fanout).where(F.col("slot") <= F.ceil(F.col("n") / cell))
        pivots = write_stage(chosen.select(
            F.col("cell").alias("parent"), (F.col("cell") * (fanout + 1) + F.col("slot")).alias("cell"), F.col("v").alias("centre"),
        ), "pivots")
        if pivots.isEmpty():
            break
        children = pivots.select(F.col("parent").alias("cell"), F.col("cell").alias("child"), "centre")
        placed = write_stage(_meet(
            here.select("cell", "point", "v", "bound"), children, ["cell"], 16 * block, _home_cell,
            "point long, v array<double>, bound double, cell long, distance double",
        ), "cells")
        sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius"))
        rank = F.row_number().over(W.partitionBy("cell").orderBy("distance", "point"))
        kth = placed.withColumn("r", rank).where(F.col("r") <= k + 1).where(F.col("r") == k + 1)
        split = (F.col("n") > block) & F.lit(level + 1 < depth)
        about = write_stage(
            pivots.join(sizes, "cell").join(kth.select("cell", F.col("distance").alias("kth")), "cell", "left")
            .withColumn("split", split), "levels",
        )
        levels.append(about)
        # Least ignores the null of a cell with k points or fewer.
        here = placed.join(_if_small(about.select("cell", "n", "kth")), "cell").select(
            "point", "v", "cell", "n", F.least("bound", F.col("distance") + F.col("kth")).alias("bound")
        )
    leaves.append(here)
    return write_stage(reduce(DataFrame.unionByName, leaves), "leaves"), levels


def _home_cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """The child with the nearest pivot for each point of a cell."""
    if left.empty or right.empty:
        return pd.DataFrame({"point": [], "v": [], "bound": [], "cell": [], "distance": []})
    right = right.sort_values("child")
    names, centres = right["child"].to_numpy(), _matrix(right["centre"])
    cells, near = [], []
    for i in range(0, len(left), 512):
        d = _distances(_matrix(left["v"].iloc[i:i + 512]), centres)
        at = d.argmin(axis=1)
        cells.append(names[at])
        near.append(np.sqrt(d[np.arange(len(d)), at]))
    return left[["point", "v", "bound"]].assign(cell=np.concatenate(cells), distance=np.concatenate(near))


def _reachable(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """The children of a cell that may hold a point within the bound, but for the point's own leaf; slack covers rounding."""
    columns = ["point", "v", "bound", "home", "cell", "n", "split"]
    if left.empty or right.empty:
        return pd.DataFrame({c: [] for c in columns})
    names, centres, radius = right["child"].to_numpy(), _matrix(right["centre"]), right["radius"].to_numpy()
    parts = []
    for i in range(0, len(left), 512):
        some = left.iloc[i:i + 512]
        reach = some["bound"].to_numpy() * (1 + 1e-9) + 1e-9
        near = np.sqrt(_distances(_matrix(some["v"]), centres)) - radius[None, :] <= reach[:, None]
        near &= some["home"].to_numpy()[:, None] != names[None, :]
        row, col = np.nonzero(near)
        parts.append(some[["point", "v", "bound", "home"]].iloc[row].assign(
            cell=names[col], n=right["n"].to_numpy()[col], split=right["split"].to_numpy()[col]))
    return pd.concat(parts)[columns]


def _descend(leaves: DataFrame, own: DataFrame, levels: list[DataFrame], k: int, block: int) -> DataFrame:
    """(point, v, cell, n) for each leaf, other than its own, that may hold one of a point's ``k`` nearest neighbours."""
    kth = own.groupBy("point").agg(F.when(F.count(F.lit(1)) == k, F.sqrt(F.max("distance2"))).alias("kth"))
    here = write_stage(leaves.join(kth, "point", "left").select(
        F.lit(0).cast("long").alias("cell"), "point", "v", F.least("bound", "kth").alias("bound"), F.col("cell").alias("home")
    ), "bounds")
    visits = []
    for about in levels:
        children = about.select(F.col("parent").alias("cell"), F.col("cell").alias("child"), "centre", "n", "split", "radius")
        reached = write_stage(_meet(
            here, children, ["cell"], 16 * block, _reachable,
            "point long, v array<double>, bound double, home long, cell long, n long, split boolean",
        ), "visits")
        visits.append(reached.where(~F.col("split")).select("point", "v", "cell", "n"))
        here = reached.where("split").select("cell", "point", "v", "bound", "home")
    return reduce(DataFrame.unionByName, visits)


def _block_neighbours(visits: DataFrame, base: DataFrame, k: int, block: int) -> DataFrame:
    """The k nearest points of one block for each visiting point: k rows per visit, never all pairs."""

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"point": [], "neighbour": [], "distance2": []})
        right = right.sort_values("other")
        ids, vectors = right["other"].to_numpy(), _matrix(right["w"])
        parts = []
        for start in range(0, len(left), 256):
            some = left.iloc[start:start + 256]
            own = some["point"].to_numpy()
            d = _distances(_matrix(some["v"]), vectors)
            d[own[:, None] == ids[None, :]] = np.inf
            # Everything up to the k-th smallest distance, ties included; ids ascend along the row.
            last = min(k, d.shape[1]) - 1
            row, col = np.nonzero((d <= np.partition(d, last, axis=1)[:, last, None]) & np.isfinite(d))
            near = d[row, col]
            order = np.lexsort((col, near, row))
            row, col, near = row[order], col[order], near[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            parts.append(pd.DataFrame({"point": own[row[keep]], "neighbour": ids[col[keep]], "distance2": near[keep]}))
        return pd.concat(parts)

    return _meet(visits, base, ["cell", "block"], block, search, "point long, neighbour long, distance2 double")


def _spread_to_rows(rows: DataFrame, distinct: DataFrame, near_points: DataFrame, row_id: str, k: int) -> DataFrame:
    """From neighbours of points to neighbours of rows.

    A row's own copies are at distance 0; each neighbouring point stands for its first k + 1 rows.
    """
    members = rows.join(distinct, "v").select("id", "point")
    # The first k + 1 rows of each point; the limit reaches the map side here too.
    rank = F.row_number().over(W.partitionBy("point").orderBy("id"))
    first = members.withColumn("r", rank).where(F.col("r") <= k + 1)
    first = first.groupBy("point").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    # Candidates per point, at most (k + 1) * (k + 1): its own rows, then those of its neighbours.
    own = first.select("point", F.lit(0.0).alias("distance2"), "ids")
    others = near_points.join(first.withColumnRenamed("point", "neighbour"), "neighbour").select("point", "distance2", "ids")
    candidates = own.unionByName(others).select("point", "distance2", F.explode("ids").alias("neighbour"))
    listed = candidates.groupBy("point").agg(F.sort_array(F.collect_list(F.struct("distance2", "neighbour"))).alias("c"))
    # Written, so that a point with a third of all rows meets a plain table and adaptive execution can split its rows.
    listed = write_stage(listed, "listed")
    kept = members.join(listed, "point").select(
        F.col("id").alias(row_id), F.slice(F.filter("c", lambda e: e["neighbour"] != F.col("id")), 1, k).alias("c")
    )
    return kept.select(row_id, F.posexplode("c").alias("slot", "e")).select(
        row_id, "slot", F.col("e.neighbour").alias("neighbour"), F.col("e.distance2").alias("distance2")
    )


def synthetic_minority(
    df: DataFrame,
    row_id: str,
    features: list[str],
    label: str,
    share: float = MINORITY_SHARE,
    k: int = NEIGHBOURS,
    seed: int = SMOTE_SEED,
    **search,
) -> DataFrame:
    """Synthetic rows of class 1 that raise it to ``int(n0 * share / (1 - share))`` rows.

    A new row lies between a minority row and one of its ``k`` nearest minority neighbours. All
    minority rows get the same number of new rows, give or take one; neighbour and position come
    from hashes. Result: (parent, neighbour, copy, u, features..., label).
    """
    sizes = df.agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")).first()
    n0, n1 = sizes["n0"], sizes["n1"]
    wanted = int(n0 * (share / (1 - share))) - n1
    if wanted < 0:
        raise ValueError(f"class 1 already has {n1} rows; it cannot be cut down to {n1 + wanted}")
    if n1 <= k:
        raise ValueError(f"class 1 needs more than {k} rows")
    minority = df.where(F.col(label) == 1).select(F.col(row_id).cast("long").alias("parent"), *features)
    per_row, extra = divmod(wanted, n1)
    # Rank of a row by hash, through running totals over the hash values.
    keyed = minority.select("parent", row_hash(F.col("parent"), seed).cast("double").alias("h"))
    ranks = running_totals(keyed, "h", {"n": F.lit(1)})
    tie = W.partitionBy("h").orderBy("parent")
    ranked = keyed.withColumn("t", F.row_number().over(tie)).join(ranks, "h").select(
        "parent", (F.col("n_before") + F.col("t") <= extra).cast("int").alias("one_more")
    )
    copies = ranked.select(
        "parent",
        F.explode(F.filter(
            F.sequence(F.lit(0), F.lit(per_row) + F.col("one_more")), lambda i: i < F.lit(per_row) + F.col("one_more")
        )).alias("copy"),
    )
    # The id is hashed before the copy number joins in, so that draws of ids at any distance differ.
    draw = row_hash(F.col("parent"), seed + 5) + F.col("copy")
    drawn = copies.select(
        "parent", "copy", (row_hash(draw, seed + 1) % k).cast("int").alias("slot"), unit_hash(draw, seed + 2).alias("u")
    )
    neighbours = nearest_neighbours(minority, "parent", features, k, **search)
    pairs = drawn.join(neighbours, ["parent", "slot"])
    a, b = minority.alias("a"), minority.alias("b")
    return (
        pairs.join(a, "parent")
        .join(b, F.col("neighbour") == F.col("b.parent"))
        .select(
            pairs["parent"], "neighbour", "copy", "u",
            *[(F.col(f"a.{f}") + F.col("u") * (F.col(f"b.{f}") - F.col(f"a.{f}"))).alias(f) for f in features],
            F.lit(1).alias(label),
        )
    )
