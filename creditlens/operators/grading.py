"""Rating grades: building the grade table from clustered scores, and looking scores up in it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from creditlens import schemas as S
from creditlens.functions.labels import choose
from creditlens.session import small_rows, write_stage

# --- fixed values ---------------------------------------------------------------------------

TOP_SCORE = 1000
GRADE_COUNT = 8

# Cells of the score range that clusters are made of.
MAX_CELLS = 2_000


def default_grades(spark) -> DataFrame:
    return spark.createDataFrame(S.GRADES, S.GRADE_SCHEMA)


def score_cells(df: DataFrame, score: str, cells: int = MAX_CELLS) -> list[tuple[float, float, int, float, float]]:
    """(least, largest, number, sum, sum of squares) of the scores of each cell, in order.

    A cell is one value as long as there are at most ``cells`` of them, otherwise one of ``cells`` equal parts of the range. Every row is
    counted; what comes back is no more than ``cells`` rows.
    """
    values = df.select(F.col(score).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    sums = [F.min("x").alias("least"), F.max("x").alias("largest"), F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q")]
    rows = values.groupBy("x").agg(*sums).drop("x").limit(cells + 1).collect()
    if len(rows) > cells:
        low, high = values.agg(F.min("x"), F.max("x")).first()
        cell = F.least(F.floor((F.col("x") - low) / ((high - low) / cells)), F.lit(cells - 1))
        rows = values.groupBy(cell.alias("cell")).agg(*sums).drop("cell").collect()
    return sorted(tuple(r) for r in rows)


def best_intervals(cells: list[tuple[float, float, int, float, float]], k: int) -> list[tuple[float, float]]:
    """The at most ``k`` intervals of neighbouring cells with the least sum of squared distances from their means, by dynamic programming."""
    if not cells:
        return []
    least, largest, n, s, q = (np.array(c, float) for c in zip(*cells))
    # Around the mean of all, so that squares do not cancel.
    mean = s.sum() / n.sum()
    s, q = s - n * mean, q - 2 * mean * s + n * mean * mean
    n, s, q = (np.concatenate([[0.0], np.cumsum(x)]) for x in (n, s, q))
    m = len(cells)

    def cost(to):
        """Costs of the intervals from each cell 0 ... ``to`` to the cell ``to``."""
        first = np.arange(to + 1)
        return np.maximum(q[to + 1] - q[first] - (s[to + 1] - s[first]) ** 2 / (n[to + 1] - n[first]), 0.0)

    costs = [cost(to) for to in range(m)]
    best, froms = np.array([c[0] for c in costs]), []
    for _ in range(1, min(k, m)):
        before = np.concatenate([[np.inf], best[:-1]])
        start = np.array([int(np.argmin(before[: to + 1] + costs[to])) for to in range(m)])
        best = np.array([before[start[to]] + costs[to][start[to]] for to in range(m)])
        froms.append(start)
    out, to = [], m - 1
    for start in reversed(froms):
        if start[to] == 0:
            # Fewer cells than intervals.
            continue
        out.append((least[start[to]], largest[to]))
        to = int(start[to]) - 1
    out.append((least[0], largest[to]))
    return [(float(a), float(b)) for a, b in reversed(out)]


def in_interval(score: Column, intervals: list[tuple[float, float]]) -> Column:
    """Number of the interval of a score, from 0; scores between two intervals belong to the lower one; null for null and NaN."""
    number = sum((F.when(score >= low, 1).otherwise(0) for low, _ in intervals[1:]), F.lit(0))
    return F.when(score.isNotNull() & ~F.isnan(score), number)


def cluster_scores(df: DataFrame, score: str, k: int = GRADE_COUNT, out: str = "cluster", cells: int = MAX_CELLS) -> DataFrame:
    """One-dimensional clusters of a score, numbered from the lowest; the same rows always give the same clusters.

    They are the best intervals over the cells of ``score_cells``: the least possible sum of squared distances if there are at most ``cells`` different
    scores, and otherwise the least one with limits between cells. Being intervals, they make grades that a probability can be looked up in.
    """
    return df.withColumn(out, in_interval(F.col(score).cast("double"), best_intervals(score_cells(df, score, cells), k)))


def pool_clusters(df: DataFrame, label: str, cluster: str = "cluster") -> DataFrame:
    """Neighbouring clusters whose default rates do not rise become one, so that better scores always mean fewer defaults."""
    counts = df.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.sum(F.col(label).cast("long")).alias("bad"), F.count(F.lit(1)).alias("n"))
    pools = []
    for row in sorted(small_rows(counts, "cluster table"), key=lambda r: r[cluster]):
        pools.append(([row[cluster]], row["bad"] or 0, row["n"]))
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = (pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2] + last[2])
    number = F.lit(None).cast("int")
    for i, (members, _, _) in enumerate(pools):
        number = F.when(F.col(cluster).isin(members), F.lit(i)).otherwise(number)
    return df.withColumn(cluster, number)


def learn_grades(df: DataFrame, score: str, label: str, k: int = GRADE_COUNT) -> DataFrame:
    """The grade table of scored rows with known labels: best clusters, pooled until defaults rise, one grade each.

    The table is written and checked, so that ``GradeRules`` accepts it; a single grade is refused.
    """
    known = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    grades = write_stage(build_grades(pool_clusters(cluster_scores(known, score, k), label), score, label), "grades")
    GradeRules(grades)
    return grades


def build_grades(df: DataFrame, score: str, label: str, cluster: str = "cluster") -> DataFrame:
    """Grade table of clustered scores, ordered by default percentage.

    Scores run from 1000 down to 0; the best grade starts at 1000 and the worst ends at 0.
    """
    per_cluster = df.groupBy(cluster).agg(
        F.min(score).alias("Proba_MIN"),
        F.max(score).alias("Proba_MAX"),
        F.count(F.lit(1)).alias("Total"),
        (F.sum(F.col(label).cast("long")) * 100 / F.count(F.lit(1))).alias("PD(%)"),
    )
    # One row per cluster from here on.
    order = W.orderBy("PD(%)", "Proba_MIN")
    ranked = per_cluster.withColumns({
        "Rating": F.row_number().over(order),
        "_last": F.count(F.lit(1)).over(W.partitionBy()),
    })
    return ranked.select(
        "Rating", "Proba_MIN", "Proba_MAX",
        F.when(F.col("Rating") == F.col("_last"), F.lit(0.0))
        .otherwise(F.bround((1 - F.col("Proba_MAX") * 2) * TOP_SCORE, 0)).alias("Score_MIN"),
        F.when(F.col("Rating") == 1, F.lit(float(TOP_SCORE)))
        .otherwise(F.bround((1 - F.col("Proba_MIN") * 2) * TOP_SCORE, 0)).alias("Score_MAX"),
        "Total", "PD(%)",
    )


class GradeRules:
    """Rating bands and score lines of a grade table, as expressions over a default probability.

    The table is small by nature (checked), so the lookup is a conditional expression: no join, no
    shuffle, and usable on a stream.
    """

    def __init__(self, grades: DataFrame):
        columns = ["Rating", "Proba_MIN", "Proba_MAX", "Score_MIN", "Score_MAX"]
        rows = sorted(small_rows(grades.select(columns), "grade table"), key=lambda r: r["Rating"])
        if len(rows) < 2:
            raise ValueError("a grade table needs at least two grades")
        uppers = [r["Proba_MAX"] for r in rows]
        if any(a >= b for a, b in zip(uppers, uppers[1:])):
            raise ValueError("upper probabilities must rise with the rating")
        self.rows = rows

    def _bands(self, p: Column) -> list[tuple[Column, object, float, float]]:
        """(test, grade, lower, upper) in the order in which they are tried.

        The last grade comes before the middle ones: the upper end of the last but one belongs to it.
        """
        rows = self.rows
        first, last = rows[0], rows[-1]
        floor = rows[-2]["Proba_MAX"]
        bands = [
            ((p >= 0) & (p <= first["Proba_MAX"]), first, first["Proba_MIN"], first["Proba_MAX"]),
            ((p >= floor) & (p <= 1), last, floor, 1.0),
        ]
        for below, row in zip(rows, rows[1:-1]):
            low, high = below["Proba_MAX"], row["Proba_MAX"]
            bands.append(((p >= low) & (p <= high), row, low, high))
        return bands

    def rating(self, p: Column) -> Column:
        """Rating, null outside [0, 1]."""
        return choose([(test, F.lit(int(row["Rating"]))) for test, row, _, _ in self._bands(p)])

    def score(self, p: Column) -> Column:
        """Score on the straight line between the ends of the band; below the first band's lowest
        probability the line goes on, so a score can pass 1000."""
        return choose([
            (test, (p - low) * (row["Score_MIN"] - row["Score_MAX"]) / (high - low) + row["Score_MAX"])
            for test, row, low, high in self._bands(p)
        ])


def add_grades(df: DataFrame, grades: DataFrame, pd: str = "pd") -> DataFrame:
    """Add ``score`` and ``rating`` for the default probability in ``pd``."""
    rules = GradeRules(grades)
    return df.withColumns({"score": rules.score(F.col(pd)), "rating": rules.rating(F.col(pd))})


def count_ungraded(df: DataFrame) -> DataFrame:
    """Rows whose probability is outside every band."""
    return df.agg(F.count_if(F.col("rating").isNull()).alias("n_ungraded"), F.count(F.lit(1)).alias("n_rows"))
