"""Retrieval quality and latency figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions.text import tune_or_test, word_jaccard


def first_right_rank(hits: DataFrame, gold: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, right_rank) of every question: the best rank of a right answer, null if none was found."""
    right = hits.join(gold.select("query_id", "id").distinct(), ["query_id", "id"], "left_semi")
    return questions.select("query_id").distinct().join(right.groupBy("query_id").agg(F.min("rank").alias("right_rank")), "query_id", "left")


def retrieval_metrics(ranks: DataFrame, groups: Column) -> DataFrame:
    """n, hit@1, hit@3, hit@10 and MRR of each group; a question may be in several. Ranks beyond 10 count as misses."""
    rank = F.col("right_rank")

    def within(k: int) -> Column:
        return F.sum(F.when(rank <= k, 1).otherwise(0))

    rows = ranks.select("query_id", "right_rank", F.explode(groups).alias("group"))
    return rows.groupBy("group").agg(
        F.count("*").alias("n"), within(1).alias("hit1"), within(3).alias("hit3"), within(10).alias("hit10"), F.round(F.sum(F.when(rank <= 10, 1 / rank).otherwise(0.0)) / F.count("*"), 6).alias("mrr")
    )


def question_groups(question_id: Column, *more: Column) -> Column:
    """All questions, the question's half, and further groups."""
    return F.array(F.lit("all"), F.concat(F.lit("half: "), tune_or_test(question_id)), *more)


def index_quantiles(rows: DataFrame, by: str, value: str, percents: dict[str, int]) -> DataFrame:
    """For each group the values at index ``n * percent / 100`` (whole division) of the sorted rows.

    Equal values are counted first, so what is sorted is a row a distinct value.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("times"))
    order = Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    sizes = counted.groupBy(by).agg(F.sum("times").alias("n"))
    upto = counted.withColumn("upto", F.sum("times").over(order)).join(sizes, by)
    columns = [F.min(F.when(F.col("upto") > F.floor(F.col("n") * p / 100), F.col(value))).alias(name) for name, p in percents.items()]
    return upto.groupBy(by).agg(F.first("n").alias("n"), *columns)


def tallied(ranks: DataFrame, groups: DataFrame) -> DataFrame:
    """A row a method and group: n, hit1, hit3, hit10, lenient3, mrr and lenient_mrr.

    ``ranks``: method, query_id, right_rank and lenient_rank (of the first that is as good as
    right), null for none; ``groups``: query_id, group. Ranks beyond 10 count as misses.
    """

    def within(rank: str, k: int) -> Column:
        return F.sum(F.when(F.col(rank) <= k, 1).otherwise(0))

    def mean(rank: str) -> Column:
        return F.round(F.sum(F.when(F.col(rank) <= 10, 1 / F.col(rank)).otherwise(0.0)) / F.count("*"), 6)

    return (
        ranks.join(groups.select("query_id", "group").distinct(), "query_id")
        .groupBy("method", "group")
        .agg(F.count("*").alias("n"), *[within("right_rank", k).alias(f"hit{k}") for k in (1, 3, 10)], within("lenient_rank", 3).alias("lenient3"), mean("right_rank").alias("mrr"), mean("lenient_rank").alias("lenient_mrr"))
    )


def all_groups(questions: DataFrame) -> DataFrame:
    """(query_id, group) of questions (query_id, name, source, kind, answer): all, their half, source, kind and kind of answer."""
    half = F.when(tune_or_test(F.col("name")) == "test", "held-out test half").otherwise("tune half")
    named = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("source", "kind", "answer")]
    return questions.select("query_id", F.explode(F.array(F.lit("all questions"), half, *named)).alias("group"))


def paired_bootstrap(ranks: DataFrame, method: str, against: str, replicates: int = 1000, percents: tuple[int, int] = (25, 975), seed: str = "0") -> DataFrame:
    """One row (difference, low, high): the mean difference of two methods' reciprocal ranks over the questions, and its interval.

    A replicate weighs each question by a Poisson number (mean 1) that a hash of the
    question and the replicate gives, so that both methods have the same weights, any
    partitioning gives the same figures and no sample is drawn on the driver. ``percents`` are
    thousandths of the sorted differences.
    """
    gain = F.when(F.col("right_rank") <= 10, 1 / F.col("right_rank")).otherwise(0.0)
    each = ranks.groupBy("query_id").agg((F.sum(F.when(F.col("method") == method, gain)) - F.sum(F.when(F.col("method") == against, gain))).alias("d")).filter("d is not null")
    rows = each.select("query_id", "d", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    named = F.concat_ws(":", F.lit(seed), F.col("query_id").cast("string"), F.col("replicate").cast("string"))
    u = F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("long") / 4294967296.0
    weight, upto, term = F.lit(0), 0.0, 0.36787944117144233  # e to the -1, over k factorial
    for k in range(12):
        upto += term
        weight = weight + F.when(u >= upto, 1).otherwise(0)
        term /= k + 1
    drawn = rows.withColumn("w", weight).groupBy("replicate").agg(F.try_divide(F.sum(F.col("w") * F.col("d")), F.sum("w")).alias("mean")).filter("mean is not null")
    place = F.row_number().over(Window.orderBy("mean")) - 1  # ``replicates`` rows
    placed = drawn.withColumns({"place": place, "n": F.count("*").over(Window.partitionBy())})
    ends = [F.round(F.min(F.when(F.col("place") == F.floor(F.col("n") * p / 1000), F.col("mean"))), 6).alias(name) for name, p in zip(("low", "high"), percents)]
    return each.agg(F.round(F.avg("d"), 6).alias("difference")).crossJoin(placed.agg(*ends))  # one row each


def equivalent(found: DataFrame, right: DataFrame, least: float = 0.8) -> DataFrame:
    """Pairs (query_id, id) of found chunks that are as good as a right one.

    Both have query_id, id, package, symbol and text. Equivalent is the same id, the same
    qualified symbol, or texts that share ``least`` of their words. The join is by question.
    """
    r = right.select("query_id", *[F.col(c).alias(f"right_{c}") for c in ("id", "package", "symbol", "text")])
    same = (F.col("id") == F.col("right_id")) | ((F.coalesce("symbol", F.lit("")) != "") & (F.col("symbol") == F.col("right_symbol")) & F.col("package").eqNullSafe(F.col("right_package")))
    return found.join(r, "query_id").filter(same | (word_jaccard(F.col("text"), F.col("right_text")) >= least)).select("query_id", "id").distinct()


def sync_progress(builds: DataFrame) -> DataFrame:
    """Progress of each run from (run, state, seconds): done, failed, total, median and p90, what remains, and how sure.

    Medians and percentiles are by index; confidence is low below 10 builds, medium
    below 25 or where p90 is over three medians, else high.
    """
    done = builds.filter("state = 'done'")
    counts = builds.groupBy("run").agg(*[F.count(F.when(F.col("state") == s, 1)).alias(s) for s in ("done", "failed", "pending")], F.count("*").alias("total"))
    times = index_quantiles(done, "run", "seconds", {"median": 50, "p90": 90}).drop("n")
    joined = counts.join(times, "run", "left")
    sure = F.when(F.col("done") < 10, "low").when((F.col("done") < 25) | (F.col("p90") > 3 * F.col("median")), "medium").otherwise("high")
    return joined.withColumn("remaining", F.col("median") * F.col("pending")).withColumn("confidence", sure)
