"""Per-key results where a few keys hold most rows.

All states are algebraic (counts and sums), so every map task folds its rows into a bounded hash table of
(key -> state) and only these compact partials are shuffled; a key that holds a third of all rows is one partial
row per map task, not one giant group. Distinct counts are made algebraic first: rows are made distinct under a
key that includes the partner, which spreads a hot key over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_counts(rows: DataFrame, key: str, partner: str, *rest: str) -> DataFrame:
    """(key, n_rows, n_partners): distinct rows of (key, partner, *rest) and distinct partners of each key.

    Every step folds map-side before its rows are shuffled: repeats of a row within a task are one row, then the rows of
    a (key, partner), then one partial row per key and task. Rows with a null key are left out (null is no key); a null
    partner is not counted as a partner but its row counts.
    """
    r = rows.where(F.col(key).isNotNull()).select(partner, key, *rest)
    one = r.groupBy(partner, key, *rest).agg(F.lit(1).alias("__one"))
    pairs = one.groupBy(partner, key).agg(F.count(F.lit(1)).alias("__n"))
    return pairs.groupBy(key).agg(F.sum("__n").alias("n_rows"), F.count(partner).alias("n_partners"))


def heavy(counts: DataFrame, n: str, percent: int) -> DataFrame:
    """Rows of a per-key table whose count is at least ``percent`` % of the whole; the whole is a scalar subquery."""
    whole = counts.agg(F.coalesce(F.sum(n), F.lit(0)).alias("whole"))
    return counts.where(F.col(n) * 100 >= whole.scalar() * percent)


def hub_rows(insights: DataFrame) -> DataFrame:
    """Distinct (repo, number, hub); null and empty hub lists and null names give none."""
    return (
        insights.select("repo", "number", F.explode("hubs").alias("hub")).where("hub is not null").distinct()
    )


def hub_results(insights: DataFrame) -> DataFrame:
    """(hub, pull_requests, mean_risk): a pull request counts once a hub, with the risk of its last computation.

    The last computation is the one of the greatest (computed_at, risk); where all risks are null so is the mean.
    """
    last = insights.groupBy("repo", "number").agg(
        F.max(F.struct(F.col("computed_at"), F.col("risk"))).alias("last")
    ).select("repo", "number", F.col("last.risk").alias("risk"))
    # null-safe on both keys, so pull requests without a repository or number count like any other
    hubs = hub_rows(insights).alias("h")
    joined = hubs.join(last.alias("l"), F.col("h.repo").eqNullSafe(F.col("l.repo")) & F.col("h.number").eqNullSafe(F.col("l.number")))
    return joined.groupBy("hub").agg(
        F.count(F.lit(1)).alias("pull_requests"), (F.sum("risk").cast("double") / F.count("risk")).alias("mean_risk")
    )


def heavy_keys(edges: DataFrame, insights: DataFrame, percent: int = 2) -> DataFrame:
    """(field, key_value): the dst of at least ``percent`` % of the distinct edges, the hubs of as many distinct mentions."""
    dst = heavy(pair_counts(edges, "dst", "src", "kind"), "n_rows", percent)
    hubs = heavy(hub_rows(insights).groupBy("hub").agg(F.count(F.lit(1)).alias("n_rows")), "n_rows", percent)
    return dst.select(F.lit("dst").alias("field"), F.col("dst").cast("string").alias("key_value")).unionByName(
        hubs.select(F.lit("hubs").alias("field"), F.col("hub").alias("key_value"))
    )
