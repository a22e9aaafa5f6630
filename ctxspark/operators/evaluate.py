"""Retrieval metrics, A/B tests, annotator agreement."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int, case: str = "query_id") -> DataFrame:
    """Per case: precision (by the returned count), recall, F1, reciprocal rank, hit rate and binary NDCG at k.

    ranked(case, id, rank), relevant(case, id); a case without relevant items scores 0.
    """
    mine = ranked.where(F.col("rank") <= k).dropDuplicates([case, "id"])
    hits = mine.join(relevant.select(case, "id", F.lit(1).alias("rel")), [case, "id"], "left")
    rel = F.col("rel").isNotNull()
    got = hits.groupBy(case).agg(F.count("*").alias("returned"), F.sum(rel.cast("int")).alias("hits"), F.coalesce(F.max(F.when(rel, 1 / F.col("rank"))), F.lit(0.0)).alias("mrr"), F.sum(F.when(rel, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"))
    total = relevant.groupBy(case).agg(F.count("*").alias("total"))
    j = got.join(total, case, "left").na.fill({"total": 0})
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least("total", F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    p, r = F.col("hits") / F.col("returned"), F.coalesce(F.try_divide("hits", "total"), F.lit(0.0))
    return j.select(case, p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), "mrr", (F.col("hits") > 0).cast("double").alias("hit_rate"), F.when(F.col("total") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"))


def ndcg_graded(ranked: DataFrame, grades: DataFrame, k: int, case: str = "query_id") -> DataFrame:
    """Gain 2^g - 1 over log2(rank + 1); the ideal order is cut at k too. grades(case, id, grade)."""
    return ndcg_by_counts(ranked.join(grades, [case, "id"]), grades.select(case, "grade", F.lit(1).alias("n")), k, case)


def ndcg_by_counts(graded: DataFrame, counts: DataFrame, k: int, case: str = "query_id") -> DataFrame:
    """ndcg_graded() of graded(case, rank, grade), where counts(case, grade, n) says how many items a case has of each
    grade. The ideal order needs no more, so pairs that are not ranked need no row."""
    gain = F.pow(2.0, "grade") - 1
    got = graded.where(F.col("rank") <= k).groupBy(case).agg(F.sum(gain / F.log2(F.col("rank") + 1)).alias("dcg"))
    upto = F.sum("n").over(W.partitionBy(case).orderBy(F.desc("grade")))
    placed = counts.groupBy(case, "grade").agg(F.sum("n").cast("long").alias("n")).withColumn("upto", upto)
    places = F.sequence(F.col("upto") - F.col("n") + 1, F.least("upto", F.lit(k)))
    share = F.aggregate(places, F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    best = placed.groupBy(case).agg(F.sum(F.when((F.col("n") > 0) & (F.col("upto") - F.col("n") < k), gain * share)).alias("ideal"))
    return best.join(got, case, "left").select(case, F.coalesce(F.try_divide("dcg", "ideal"), F.lit(0.0)).alias("ndcg"))


def batch_summary(metrics: DataFrame, names: list[str]) -> DataFrame:
    """(metric, mean, p95, low): p95 is the value at place int(n * 0.95) of the sorted values."""
    long = metrics.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("v")) for n in names))).alias("s")).select("s.*")
    value = long.groupBy("metric", "v").agg(F.count("*").alias("c"))  # few: metrics at a cut have few values
    w = W.partitionBy("metric")
    upto = F.sum("c").over(w.orderBy("v"))
    placed = value.withColumns({"upto": upto, "n": F.sum("c").over(w)})
    at = F.floor(F.col("n") * 0.95)
    hit = (F.col("upto") > at) & (F.col("upto") - F.col("c") <= at)
    return placed.groupBy("metric").agg((F.sum(F.col("v") * F.col("c")) / F.max("n")).alias("mean"), F.max(F.when(hit, F.col("v"))).alias("p95"), F.min("v").alias("low"))


def erf(x: Column) -> Column:
    """The error function by its series, 2 / sqrt(pi) * exp(-x^2) * sum of x^(2n + 1) * 2^n / (1 * 3 * ... * (2n + 1)); 1
    beyond 6, where doubles can't tell it from 1."""
    z = F.least(F.abs(x), F.lit(6.0))
    start = F.struct(z.alias("term"), z.alias("total"))

    def add(s: Column, n: Column) -> Column:
        term = s["term"] * 2 * z * z / (2 * n + 1)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(150)), start, add, lambda s: s["total"])
    return F.signum(x) * F.least(F.lit(1.0), 2 / F.sqrt(F.lit(math.pi)) * F.exp(-z * z) * total)


def normal_cdf(x: Column) -> Column:
    return 0.5 * (1 + erf(x / F.sqrt(F.lit(2.0))))


def ab_test(pairs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row for paired scores (a, b): means, delta, z, p and winner; without spread p is 0 or 1.

    Means are those of decimals, so they don't depend on the order in which partitions are added up.
    """
    exact = lambda c: F.avg(c.cast("decimal(28, 12)")).cast("double")
    a, b = F.col("a"), F.col("b")
    s = pairs.agg(F.count("*").alias("n"), exact(a).alias("mean_a"), exact(b).alias("mean_b"), exact(b.cast("decimal(28, 12)") - a.cast("decimal(28, 12)")).alias("delta"), F.stddev_samp(b - a).alias("sd"))
    s = s.withColumn("z", F.try_divide(F.col("delta"), F.col("sd") / F.sqrt("n")))
    flat = F.when(F.coalesce(F.col("delta"), F.lit(0.0)) == 0, 1.0).otherwise(0.0)
    out = s.withColumn("p", F.when(F.col("z").isNull(), flat).otherwise(2 * (1 - normal_cdf(F.abs("z")))))
    return out.withColumn("winner", F.when(F.col("p") >= alpha, "tie").when(F.col("delta") > 0, "b").otherwise("a"))


def cohen_kappa(ratings: DataFrame) -> DataFrame:
    """(n, observed, expected, kappa) over items that annotators 1 and 2 both rated: ratings(item, annotator, rating)."""
    who = F.dense_rank().over(W.partitionBy(F.lit(1)).orderBy("annotator"))
    two = ratings.select("annotator").distinct().withColumn("who", who).where("who <= 2")
    pair = ratings.join(F.broadcast(two), "annotator").groupBy("item").agg(F.max(F.when(F.col("who") == 1, F.col("rating"))).alias("x"), F.max(F.when(F.col("who") == 2, F.col("rating"))).alias("y")).where("x is not null and y is not null")
    n = pair.agg(F.count("*").alias("n"), F.avg((F.col("x") == F.col("y")).cast("double")).alias("observed"))
    long = pair.select(F.explode(F.array(F.struct(F.lit(1).alias("who"), F.col("x").alias("r")), F.struct(F.lit(2).alias("who"), F.col("y").alias("r")))).alias("s")).groupBy("s.r").agg(F.sum((F.col("s.who") == 1).cast("double")).alias("a"), F.sum((F.col("s.who") == 2).cast("double")).alias("b"))
    chance = long.agg(F.sum(F.col("a") * F.col("b")).alias("ab"))
    expected = F.col("ab") / (F.col("n") * F.col("n"))
    return n.join(F.broadcast(chance)).select("n", "observed", expected.alias("expected"), F.when(expected == 1, 1.0).otherwise(F.try_divide(F.col("observed") - expected, 1 - expected)).alias("kappa"))


def metric_floor(metrics: DataFrame, name: str, floor: float, case: str = "query_id") -> DataFrame:
    """The gate of a metric in one row: its mean, whether that reaches the floor, and the three worst cases."""
    mean = metrics.agg(F.avg(name).alias("mean"))
    worst = metrics.orderBy(name, case).limit(3).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(name, case))), lambda s: s[case].cast("string")), ",").alias("worst"))
    return mean.join(F.broadcast(worst)).withColumn("reached", F.coalesce(F.col("mean") >= floor, F.lit(False)))


def evaluate_pipeline(cases: DataFrame, run: Callable[[DataFrame], DataFrame], relevant: DataFrame, k: int, judges: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """Per case the retrieval metrics of what run(cases) ranks, and a column for each judge(cases) that gives
    (query_id, score); a case that a judge leaves out is null there, a case without results scores 0."""
    got = retrieval_metrics(run(cases), relevant, k)
    names = [c for c in got.columns if c != "query_id"]
    out = cases.select("query_id").join(got, "query_id", "left").na.fill(0.0, names)
    for name, judge in (judges or {}).items():
        out = out.join(judge(cases).select("query_id", F.col("score").alias(name)), "query_id", "left")
    return out


def rag_scores(answers: DataFrame, **metrics: Callable[[Column, Column, Column], Column] | None) -> DataFrame:
    """answers(case, question, answer, contexts) with a column for each metric(question, answer, contexts), clamped to
    [0, 1]; one that isn't given is null."""
    q, a, c = F.col("question"), F.col("answer"), F.col("contexts")
    score = lambda f: F.lit(None).cast("double") if f is None else F.greatest(F.lit(0.0), F.least(F.lit(1.0), f(q, a, c)))
    return answers.withColumns({name: score(f) for name, f in metrics.items()})


def replay_consolidation(cases: DataFrame, after: DataFrame) -> DataFrame:
    """(case, passed, missing, forbidden, size_ok) of cases(case, must_have, must_not, most) against the stores that a
    consolidator left, after(case, content): each text of must_have is part of an entry (case folded), none of must_not is
    part of any, and there are at most `most` entries. A case without entries has an empty store."""
    low = after.select("case", F.lower("content").alias("content"))
    size = low.groupBy("case").agg(F.count("*").alias("n"))
    parts = cases.select("case", F.explode(F.concat(F.transform("must_have", lambda t: F.struct(F.lit(True).alias("want"), t.alias("t"))), F.transform("must_not", lambda t: F.struct(F.lit(False).alias("want"), t.alias("t"))))).alias("p")).select("case", "p.*")
    held = parts.join(low, "case", "left").groupBy("case", "want", "t").agg(F.coalesce(F.max(F.contains("content", F.lower("t"))), F.lit(False)).alias("there"))
    sums = held.groupBy("case").agg(F.count(F.when(F.col("want") & ~F.col("there"), 1)).alias("missing"), F.count(F.when(~F.col("want") & F.col("there"), 1)).alias("forbidden"))
    out = cases.join(sums, "case", "left").join(size, "case", "left").na.fill(0, ["missing", "forbidden", "n"])
    fits = F.col("most").isNull() | (F.col("n") <= F.col("most"))
    return out.select("case", ((F.col("missing") == 0) & (F.col("forbidden") == 0) & fits).alias("passed"), "missing", "forbidden", fits.alias("size_ok"))


def pair_runs(a: DataFrame, b: DataFrame, metric: str, case: str = "query_id") -> DataFrame:
    """Paired samples (case, a, b) of two runs' metrics; cases that either lacks are left out."""
    return a.select(case, F.col(metric).alias("a")).join(b.select(case, F.col(metric).alias("b")), case)


def relevant_by_rating(ratings: DataFrame, threshold: float = 2.0) -> DataFrame:
    """(query, item, mean_rating, judgments) of the pairs whose ratings(query, item, rating) reach the threshold on average."""
    mean = ratings.groupBy("query", "item").agg(F.avg(F.col("rating").cast("double")).alias("mean_rating"), F.count("*").alias("judgments"))
    return mean.where(F.col("mean_rating") >= threshold)
