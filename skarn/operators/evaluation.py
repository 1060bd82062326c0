"""Evaluation statistics over runs (qid, docid, rank, score), judgements (qid, docid, rel) and ratings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbers import at_ranks


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """The run with rel (0 where unjudged)."""
    return run.join(qrels.select("qid", "docid", "rel"), ["qid", "docid"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def ir_metrics(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """A31 per query: nDCG@k, AP@k, RR@k, R@k, P@k; a query without judgements has none, one without hits has zeros."""
    hits = judged(run, qrels).where(F.col("rank") <= k)
    w = Window.partitionBy("qid").orderBy("rank")
    seen = hits.withColumn("good", (F.col("rel") > 0).cast("int")).withColumn("n_good", F.sum("good").over(w))
    got = seen.groupBy("qid").agg(
        F.sum(F.col("rel") / F.log2(F.col("rank") + 1.0)).alias("dcg"),
        F.sum(F.when(F.col("good") == 1, F.col("n_good") / F.col("rank")).otherwise(0.0)).alias("ap_sum"),
        F.max(F.when(F.col("good") == 1, 1.0 / F.col("rank")).otherwise(0.0)).alias("rr"),
        F.sum("good").alias("hits"),
    )
    ideal = qrels.where("rel > 0").withColumn("i", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rel"), "docid")))
    best = ideal.groupBy("qid").agg(F.sum(F.when(F.col("i") <= k, F.col("rel") / F.log2(F.col("i") + 1.0))).alias("idcg"), F.count("*").alias("n_rel"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    r6 = lambda c, name: F.round(c, 6).alias(name)
    return best.join(got, "qid", "left").select(
        "qid",
        r6(zero("dcg") / F.col("idcg"), "ndcg"),
        r6(zero("ap_sum") / F.col("n_rel"), "ap"),
        r6(zero("rr") * 1.0, "rr"),
        r6(zero("hits") / F.col("n_rel"), "recall"),
        r6(zero("hits") / F.lit(float(k)), "precision"),
    )


def aggregate_metrics(per_query: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Means over queries, for each slice if slices are named."""
    return per_query.groupBy(*by).agg(F.count("*").alias("n_queries"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("ndcg", "ap", "rr", "recall", "precision")])


def capped_recall(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Hits / min(number of relevant documents, k)."""
    rel = qrels.where("rel > 0").select("qid", "docid")
    hits = run.where(F.col("rank") <= k).join(rel, ["qid", "docid"], "left_semi").groupBy("qid").agg(F.count("*").alias("hits"))
    return rel.groupBy("qid").agg(F.count("*").alias("n")).join(hits, "qid", "left").select("qid", F.round(F.coalesce("hits", F.lit(0)) / F.least("n", F.lit(k)), 6).alias("recall"))


def unjudged_rate(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """The share of the first k that has no judgement."""
    known = qrels.select("qid", "docid", F.lit(1).alias("j"))
    return run.where(F.col("rank") <= k).join(known, ["qid", "docid"], "left").groupBy("qid").agg(F.round(F.avg(F.when(F.col("j").isNull(), 1.0).otherwise(0.0)), 6).alias("unjudged"))


def breakdown(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """How many of the first k have each relevance, and the shares of harmful (0) and useful (2) ones."""
    top = run.where(F.col("rank") <= k).join(qrels.select("qid", "docid", "rel"), ["qid", "docid"], "inner")
    return top.groupBy("qid").agg(
        *[F.count_if(F.col("rel") == r).alias(f"rel_{r}") for r in (0, 1, 2)],
        F.round(F.avg((F.col("rel") == 0).cast("double")), 6).alias("harmful_rate"),
        F.round(F.avg((F.col("rel") == 2).cast("double")), 6).alias("useful_rate"),
    )


def cohen_linear(pairs: DataFrame, a: str, b: str, top: int = 2) -> DataFrame:
    """Linearly weighted kappa of two raters over 0..top, from sums alone."""
    cells = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("i"), F.col(b).alias("j")).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("t"), F.sum(F.abs(F.col("i") - F.col("j")) * F.col("n")).alias("o"), *[F.sum(F.when(F.col(c) == v, F.col("n")).otherwise(0)).alias(f"{c}{v}") for c in "ij" for v in range(top + 1)])
    expected = F.lit(0.0)
    for u in range(top + 1):
        for v in range(top + 1):
            expected = expected + abs(u - v) * F.col(f"i{u}") * F.col(f"j{v}") / F.col("t")
    return total.select(F.col("t").cast("long").alias("n"), F.round(F.when(expected > 0, 1 - F.col("o") / expected).otherwise(1.0), 6).alias("kappa"))


def fleiss(ratings: DataFrame, item: str, raters: Sequence[str], cats: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """Fleiss' kappa for items that every rater judged."""
    m = len(raters)
    full = ratings.dropna(subset=list(raters))
    votes = [sum((F.when(F.col(r) == c, 1).otherwise(0) for r in raters), F.lit(0)) for c in cats]
    own = full.select(item, *[v.alias(f"v{c}") for v, c in zip(votes, cats)])
    agree = sum((F.col(f"v{c}") * F.col(f"v{c}") for c in cats), F.lit(0))
    sums = own.agg(F.count("*").alias("n"), F.avg((agree - m) / float(m * (m - 1))).alias("p"), *[(F.sum(f"v{c}") / (F.count("*") * float(m))).alias(f"s{c}") for c in cats])
    chance = sum((F.col(f"s{c}") * F.col(f"s{c}") for c in cats), F.lit(0.0))
    return sums.select("n", F.round(F.when(chance < 1, (F.col("p") - chance) / (1 - chance)).otherwise(1.0), 6).alias("kappa"))


def median_judge(ratings: DataFrame, raters: Sequence[str]) -> Column:
    """Floor of the median of the judges that answered; 0 if none did."""
    known = F.array_sort(F.array_compact(F.array(*[F.col(r) for r in raters])))
    n = F.size(known)
    low, high = F.get(known, ((n - 1) / 2).cast("int")), F.get(known, (n / 2).cast("int"))
    return F.when(n == 0, 0).otherwise(F.floor((low + high) / 2.0)).cast("int")


def calibration_error(df: DataFrame, prob: str, hit: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over bins (lo, hi]; a probability of 0 is in the first one."""
    b = F.greatest(F.lit(1), F.ceil(F.col(prob) * bins))
    one = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(prob).alias("conf"), F.avg(F.col(hit).cast("double")).alias("acc"))
    return one.agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n"), 6).alias("ece"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The interval's ends; 0 and 0 without trials."""
    p, z2 = k / n, z * z
    mid, half = (p + z2 / (2 * n)) / (1 + z2 / n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    low, high = F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)
    return F.when(n > 0, low).otherwise(0.0), F.when(n > 0, high).otherwise(0.0)


def token_f1(pairs: DataFrame, key: str, pred: str, gold: str) -> DataFrame:
    """Multiset token F1 of two token arrays by key."""
    count = lambda c: pairs.select(key, F.explode(c).alias("t")).groupBy(key, "t").agg(F.count("*").alias("n"))
    a, b = count(pred).withColumnRenamed("n", "a"), count(gold).withColumnRenamed("n", "b")
    same = a.join(b, [key, "t"]).groupBy(key).agg(F.sum(F.least("a", "b")).alias("same"))
    base = pairs.select(key, F.size(pred).alias("p"), F.size(gold).alias("g")).join(same, key, "left").withColumn("same", F.coalesce("same", F.lit(0)))
    return base.select(key, F.round(F.when(F.col("same") > 0, 2.0 * F.col("same") / (F.col("p") + F.col("g"))).otherwise(0.0), 6).alias("f1"))


def latency(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """p50, p95, p99 by linear interpolation, and the mean, two places."""
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    place = {k: (F.col("n") - 1) * q for k, q in shares.items()}
    found = at_ranks(df, by, value, {f"{k}{side}": (F.floor(x) if side == "lo" else F.ceil(x)) + 1 for k, x in place.items() for side in ("lo", "hi")})
    mid = lambda k: F.col(f"{k}lo") + (F.col(f"{k}hi") - F.col(f"{k}lo")) * (place[k] - F.floor(place[k]))
    mean = df.groupBy(*by).agg(F.avg(value).alias("m"))
    out = found.join(mean, list(by)) if by else found.join(F.broadcast(mean))
    return out.select(*by, "n", *[F.round(mid(k), 2).alias(k) for k in shares], F.round("m", 2).alias("mean"))


def nearest_rank(df: DataFrame, value: str, by: Sequence[str], q: float = 0.95) -> DataFrame:
    """The value at place round(q * (n - 1)), halves to even, counted from 0."""
    return at_ranks(df, by, value, {"p95": F.bround((F.col("n") - 1) * q) + 1}).select(*by, "n", "p95")


def best_setting(results: DataFrame, setting: Sequence[str], score: str) -> DataFrame:
    """The mean of each setting's scores and whether it is the best (ties to the smallest setting)."""
    mean = results.groupBy(*setting).agg(F.round(F.avg(score), 6).alias("mean_score"))
    return mean.withColumn("best", F.row_number().over(Window.partitionBy().orderBy(F.desc("mean_score"), *setting)) == 1)
