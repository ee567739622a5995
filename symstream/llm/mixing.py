"""Mixing sources to target weights (problem 8).

A source's budget, in tokens, is its share of the wanted size; what a source can't give, even with every document repeated as
often as allowed, goes to the others in proportion to their shares. Budget over size is the number of copies that each document
of the source should have: its whole part is given to all, and for the rest documents are drawn by Pareto order sampling, as
one sample of fixed size (in tokens) for each source, of unequal probabilities: those of a source are as a power of the documents'
tokens (``POWER``), as far as they stay below 1, so that long documents, of which there are few, aren't left to chance as much as short
ones. Documents are ranked by the odds of a random number over the odds of their inclusion probability; those of probability 1 come
first. The random number is a hash of the id and a seed, so that a task run again draws the same.

No source is sorted in one task: ranks fall into buckets, the buckets' token sums tell in which bucket a source's sample ends,
and only documents of that bucket are put in order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symstream.session import cut

#: Inclusion probabilities are as this power of a document's tokens; 0 makes them equal.
POWER = 0.5
#: Classes of size, for each doubling of the tokens, over which a source's probabilities are set.
STEPS = 16
#: Buckets of a source's ranks: the one that is put in order holds about this part of its documents.
BUCKETS = 1 << 14


@dataclass
class Plan:
    """What a source gives: whole copies of each document, and tokens of the drawn rest."""

    source: str
    target_share: float
    max_repeats: int
    size: int
    budget: float
    whole: int
    rest: float


def allocate(targets: list[tuple[str, float, int]], sizes: dict[str, int], wanted: float) -> list[Plan]:
    """Budgets by source: capped at max_repeats times the size, the shortfall spread over the others by their shares."""
    capacity = {s: sizes.get(s, 0) * max(0, m) for s, _, m in targets}
    share = {s: max(0.0, x) for s, x, _ in targets}
    budget = {s: 0.0 for s in share}
    open_, left = {s for s in share if capacity[s] and share[s]}, wanted
    while open_:
        total = sum(share[s] for s in open_)
        full = {s for s in open_ if left * share[s] / total >= capacity[s]}
        if not full:
            budget |= {s: left * share[s] / total for s in open_}
            break
        for s in full:
            budget[s] = float(capacity[s])
        left -= sum(capacity[s] for s in full)
        open_ -= full
    plans = []
    for s, x, m in targets:
        size = sizes.get(s, 0)
        copies = min(float(m), budget[s] / size) if size else 0.0
        whole = int(copies + 1e-12)
        rest = max(0.0, budget[s] - whole * size) if whole < m else 0.0
        plans.append(Plan(s, x, m, size, budget[s], whole, rest))
    return plans


def factor(classes: list[tuple[float, float]], rest: float) -> float:
    """x, so that documents of (tokens, weight) classes with the probabilities min(1, x * weight) have ``rest`` tokens on the average."""
    classes = [(n, w) for n, w in classes if n > 0 and w > 0]
    if rest <= 0 or not classes:
        return 0.0
    high = max(1 / w for _, w in classes)
    if sum(n for n, _ in classes) <= rest:
        return high
    low = 0.0
    for _ in range(80):
        x = (low + high) / 2
        low, high = (x, high) if sum(n * min(1.0, x * w) for n, w in classes) < rest else (low, x)
    return high


def mixture(documents: DataFrame, targets: DataFrame, id_col: str, source_col: str, tokens_col: str, seed: int = 17, power: float = POWER) -> DataFrame:
    """id, source, n_tokens and ``copies`` (1 or more) of each document of the mixture, as large as all documents together.

    targets: source_name, target_share, max_repeats, a small fixed table. Documents without a source, or of one without a
    target, count for the size of the mixture but aren't drawn. Documents without tokens get the whole copies only. Ids are
    unique. Empty tables give no rows.
    """
    rows = cut(documents.select(F.col(id_col).alias("k"), F.col(source_col).alias("s"), F.col(tokens_col).cast("bigint").alias("n")))
    wanted = [(r.source_name, float(r.target_share or 0), int(r.max_repeats or 0)) for r in targets.collect() if r.source_name is not None]
    names = [s for s, _, _ in wanted]
    summed = rows.groupBy(F.when(F.col("s").isin(names), F.col("s")).alias("s")).agg(F.sum("n").alias("n")).collect()
    sizes = {r.s: r.n or 0 for r in summed}
    plans = allocate(wanted, sizes, float(sum(sizes.values())))
    weight = F.pow(F.col("n").cast("double"), F.lit(power))
    # at most STEPS classes for each of the 63 doublings, and each target
    classed = rows.where(F.col("s").isin(names) & (F.col("n") > 0)).groupBy("s", F.floor(F.log2("n") * STEPS).alias("c"))
    classes: dict[str, list[tuple[float, float]]] = {}
    for r in classed.agg(F.sum("n").cast("double").alias("n"), F.sum(F.col("n") * weight).alias("w")).collect():
        classes.setdefault(r.s, []).append((r.n, r.w / r.n))
    spark = rows.sparkSession
    planned = spark.createDataFrame([(p.source, p.whole, p.rest, factor(classes.get(p.source, []), p.rest)) for p in plans], "s string, whole int, rest double, x double")
    # a row for each source of the fixed table of targets
    drawn = rows.join(F.broadcast(planned), "s")
    # uniform from 53 bits of a hash, never 0 or 1
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("k")), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    p = F.least(F.lit(1.0), F.col("x") * weight)
    rank = F.when(p >= 1, u - 1).when((p > 0) & (F.col("n") > 0), (u / (1 - u)) * ((1 - p) / p))
    # ranks go from 0 to any number, about 1 where the sample ends; those of probability 1 lie below 0
    of = F.col("rank")
    ranked = drawn.withColumn("rank", rank).withColumn("bucket", F.floor(F.when(of < 0, of).otherwise(of / (1 + of)) * BUCKETS).cast("int"))
    filled = ranked.where("rest > 0 AND rank IS NOT NULL").groupBy("s", "bucket").agg(F.sum("n").alias("n"), F.first("rest").alias("rest"))
    running = filled.withColumn("before", F.sum("n").over(Window.partitionBy("s").orderBy("bucket")) - F.col("n"))
    last = running.where("before <= rest AND rest < before + n").select("s", F.col("bucket").alias("last"), "before")
    placed = ranked.join(F.broadcast(last), "s", "left")  # a row for each source at most
    inside = Window.partitionBy("s", "bucket").orderBy("rank", "k").rowsBetween(Window.unboundedPreceding, -1)
    edge = placed.where("bucket = last").withColumn("sum_before", F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    # the sample ends where its size is nearest to the budget
    edge = edge.withColumn("copies", F.col("whole") + (F.col("sum_before") + F.col("n") / 2 <= F.col("rest")).cast("int"))
    others = placed.where("last IS NULL OR bucket IS NULL OR bucket <> last").withColumn("copies", F.col("whole") + F.when(F.col("bucket") < F.col("last"), 1).otherwise(0))
    out = edge.select("k", "s", "n", "copies").unionByName(others.select("k", "s", "n", "copies")).where("copies > 0")
    return out.select(F.col("k").alias(id_col), F.col("s").alias(source_col), F.col("n").alias("n_tokens"), "copies")


def shares(mixed: DataFrame, targets: DataFrame, source_col: str) -> DataFrame:
    """For each target source: its share wanted and reached, its documents, copies and tokens in the mixture."""
    got = mixed.groupBy(F.col(source_col).alias("source_name")).agg(
        F.count(F.lit(1)).alias("documents"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.max("copies").alias("most_copies")
    )
    out = targets.join(got, "source_name", "left").fillna(0, ["documents", "copies", "tokens", "most_copies"])
    total = F.sum("tokens").over(Window.partitionBy())  # over the fixed table of targets
    return out.withColumn("share_reached", F.coalesce(F.try_divide(F.col("tokens"), total), F.lit(0.0))).select("source_name", "target_share", "max_repeats", "documents", "copies", "most_copies", "tokens", "share_reached")
