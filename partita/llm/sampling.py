"""Problem 4: a sample whose category shares match targets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partita.operators.ranking import global_rank, hash_order
from partita.session import broadcast_small, cut_lineage

def allocate(available: dict[str, int], targets: list[tuple[str, float, int]], n: int) -> tuple[dict[str, int], dict[str, tuple[int, int]]]:
    """(quotas, shortfalls): integer quotas that sum to n where availability allows, and what availability cut.

    A category's floor is its minimum, its cap what exists. Its quota is its share of a common level,
    kept between floor and cap; the level is the one at which the quotas sum to n (all of them are their
    floors if these are more, their caps if these are less). Fractions are rounded by largest remainder
    (ties: the smaller name). shortfalls has (needed, granted) for each category whose cap is less than it
    needs by its target alone: its share of n rounded up, or its minimum.
    """
    share = {q: max(0.0, float(s or 0.0)) for q, s, _ in targets}
    cap = {q: available.get(q, 0) for q in share}
    floor = {q: min(cap[q], int(m or 0)) for q, _, m in targets}
    need = {q: max(math.ceil((s or 0.0) * n), int(m or 0)) for q, s, m in targets}
    # between the levels at which categories leave their floors and reach their caps the sum grows evenly
    turns = sorted([(floor[q] / share[q], share[q]) for q in share if share[q]] + [(cap[q] / share[q], -share[q]) for q in share if share[q]])
    level, slope, total = 0.0, 0.0, float(sum(floor.values()))
    for at, change in turns:
        if total + slope * (at - level) >= n:
            break
        total, level, slope = total + slope * (at - level), at, slope + change
    if total < n and slope > 1e-12:
        level += (n - total) / slope
    real = {q: min(max(level * share[q], floor[q]), cap[q]) for q in share}
    quota = {q: min(cap[q], math.floor(real[q] + 1e-9)) for q in real}
    spare = n - sum(quota.values())
    for q in sorted(quota, key=lambda q: (quota[q] - real[q], q)):
        if spare <= 0 or quota[q] >= real[q]:
            break
        if quota[q] < cap[q]:
            quota[q] += 1
            spare -= 1
    return quota, {q: (need[q], cap[q]) for q in need if cap[q] < need[q]}


def target_report(rows: DataFrame, category: str, targets: DataFrame, fraction: float, name: str = "quality", share: str = "target_share", minimum: str = "min_frames") -> DataFrame:
    """(category, available, wanted, quota, short) for each target; quota is what is drawn, short what allocate() could not grant.

    wanted = max(ceil(share * n), minimum) with n = floor(fraction * all rows). The result is a
    table of targets, so it is worked out on the driver from one count per target category.
    """
    spark = rows.sparkSession
    t = [(r[0], r[1], r[2]) for r in targets.select(name, share, minimum).where(F.col(name).isNotNull()).dropDuplicates([name]).collect()]
    wanted = broadcast_small(targets.select(F.col(name).alias("__t")).distinct(), len(t))
    counts = rows.groupBy(category).agg(F.count(F.lit(1)).alias("m"))
    total = counts.agg(F.sum("m")).first()[0] or 0
    have = {r[0]: r[1] for r in counts.join(wanted, F.col(category) == F.col("__t"), "left_semi").collect()}
    n = math.floor(total * fraction)
    quota, short = allocate(have, t, n)
    out = [(q, have.get(q, 0), max(math.ceil((s or 0.0) * n), m or 0), quota[q], q in short) for q, s, m in sorted(t)]
    return spark.createDataFrame(out, f"{name} string, available bigint, wanted bigint, quota bigint, short boolean")


def stratified_sample(rows: DataFrame, category: str, ids: list[str], targets: DataFrame, fraction: float, seed: int = 0, **names: str) -> tuple[DataFrame, DataFrame]:
    """(sample, report). The sample keeps, per category, the rows with the smallest random keys.

    Ranks are exact and distributed (see global_rank), so a category that holds most rows is no
    single task. Rows with a null category, or one without a target, are never drawn; empty input
    gives an empty sample and a report in which every target with a minimum falls short.
    """
    rows = cut_lineage(rows)
    report = target_report(rows, category, targets, fraction, **names)
    name = names.get("name", "quality")
    wanted = report.select(name, "available").collect()
    quota = broadcast_small(report.select(F.col(name).alias("__q"), F.col("quota").alias("__quota")), len(wanted))
    keyed = rows.join(quota, F.col(category) == F.col("__q")).withColumn("__h", hash_order(*[F.col(c) for c in ids], seed=seed))
    ranked = global_rank(keyed, [category], "__h", ids, "__rank", rows=sum(r.available for r in wanted))
    return ranked.where(F.col("__rank") <= F.col("__quota")).drop("__q", "__quota", "__h", "__rank"), report
