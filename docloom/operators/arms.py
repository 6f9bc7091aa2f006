"""Judged runs of arms, verdicts against each other, timings, and predicted spans against gold ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.evaluate import sign_tail


def nearest_rank(values: str, q: float) -> Column:
    """The value of a group at the place q (n - 1), rounded to the even place where it lies between two; null without any."""
    ordered = F.array_sort(F.collect_list(values))
    return F.try_element_at(ordered, F.bround(F.lit(q) * (F.count(values) - 1), 0).cast("int") + 1)


def arm_metrics(runs: DataFrame) -> DataFrame:
    """(arm, metric, value) of runs (arm, qid, rep, kind, correctness, flags_conflict, uses_stale_fact, hallucination,
    cites_source, turns, tool_calls, duration_ms, cost), the scores null where a run wasn't judged. Shares are in percent,
    of judged runs; of a kind of trap only its own. No run, no value: such a metric is left out. p90 is the nearest rank;
    an arm's runs are few, as each costs an agent, so their durations are gathered."""
    percent = lambda c, of=None: F.avg(F.when(F.col("correctness").isNotNull() & (of if of is not None else F.lit(True)), F.when(c, 100.0).otherwise(0.0)))
    metrics = {
        "runs": F.count("*").cast("double"),
        "correctness_mean": F.avg("correctness"),
        "fully_correct": percent(F.col("correctness") == 2),
        "wrong": percent(F.col("correctness") == 0),
        "conflict_flagged": percent(F.col("flags_conflict"), F.col("kind") == "conflict-trap"),
        "stale_as_current": percent(F.col("uses_stale_fact"), F.col("kind") == "stale-trap"),
        "hallucination": percent(F.col("hallucination")),
        "cites_source": percent(F.col("cites_source")),
        "one_turn": F.avg(F.when(F.coalesce(F.col("turns") == 1, F.lit(False)), 100.0).otherwise(0.0)),
        "turns_median": F.percentile(F.coalesce("turns", F.lit(0)), 0.5),
        "tool_calls_median": F.percentile("tool_calls", 0.5),
        "seconds_median": F.percentile(F.when(F.col("duration_ms") > 0, F.col("duration_ms") / 1000), 0.5),
        "seconds_p90": nearest_rank("seconds", 0.9),
        "cost_mean": F.avg(F.coalesce("cost", F.lit(0.0))),
        "cost_total": F.sum(F.coalesce("cost", F.lit(0.0))),
    }
    rows = runs.withColumn("seconds", F.when(F.col("duration_ms") > 0, F.col("duration_ms") / 1000)).groupBy("arm").agg(*[c.cast("double").alias(k) for k, c in metrics.items()])
    return rows.unpivot("arm", list(metrics), "metric", "value").filter("value is not null")


def paired_arms(runs: DataFrame, first: str) -> DataFrame:
    """(arm, better, worse, same, p): each other arm against the first one, run by run of the same question and repeat, with
    the two-sided sign test of those that differ. Runs that weren't judged take no part."""
    judged = runs.filter("correctness is not null").select("arm", "qid", "rep", "correctness")
    base = judged.filter(F.col("arm") == first).select("qid", "rep", F.col("correctness").alias("base"))
    sign = F.signum(F.col("correctness") - F.col("base"))
    count = lambda v: F.sum((sign == v).cast("int"))
    out = judged.filter(F.col("arm") != first).join(base, ["qid", "rep"]).groupBy("arm").agg(count(1).alias("better"), count(-1).alias("worse"), count(0).alias("same"))
    return out.withColumn("p", sign_tail(F.col("better"), F.col("worse")))


def question_spread(runs: DataFrame) -> DataFrame:
    """(qid, arm, mean, spread) of the judged correctness: the mean of a question's repeats, and their largest less their
    least."""
    return runs.filter("correctness is not null").groupBy("qid", "arm").agg(F.avg("correctness").alias("mean"), (F.max("correctness") - F.min("correctness")).cast("double").alias("spread"))


def agreement(hand: DataFrame, judged: DataFrame, fields: list[str]) -> DataFrame:
    """(field, n, agree): the share of runs (run, *fields) for which two judges say the same, in any case and without
    blanks; runs that the first left open take no part, nor do those that the second doesn't have."""
    plain = lambda s, c: F.lower(F.trim(F.col(f"{s}.{c}").cast("string")))
    both = hand.filter(F.coalesce(F.trim(F.col(fields[0]).cast("string")), F.lit("")) != "").alias("a").join(judged.alias("b"), F.col("a.run") == F.col("b.run"))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), plain("a", c).eqNullSafe(plain("b", c)).alias("same")) for c in fields]))
    return both.select(each.alias("x")).groupBy(F.col("x.field").alias("field")).agg(F.count("*").alias("n"), F.avg(F.col("x.same").cast("double")).alias("agree"))


def silent_failures(scores: DataFrame, batch: str, fields: list[str], share: float = 1 / 3) -> DataFrame:
    """(batch, n, most): the batches of which more than `share` have one and the same tuple of scores, as a judge gives who
    failed without saying so."""
    counts = scores.groupBy(F.col(batch).alias("batch"), *fields).agg(F.count("*").alias("n"))
    return counts.groupBy("batch").agg(F.sum("n").alias("n"), F.max("n").alias("most")).filter(F.col("most") > share * F.col("n"))


def latency_profile(times: DataFrame) -> DataFrame:
    """(stage, n, median, p90, share) of times (stage, seconds): share is of the seconds of all stages."""
    total = times.agg(F.sum("seconds").alias("total"))  # one row
    stages = times.groupBy("stage").agg(F.count("seconds").alias("n"), F.percentile("seconds", 0.5).alias("median"), F.percentile("seconds", 0.9).alias("p90"), F.sum("seconds").alias("sum"))
    return stages.crossJoin(F.broadcast(total)).select("stage", "n", "median", "p90", F.when(F.col("total") > 0, F.col("sum") / F.col("total")).otherwise(0.0).alias("share"))


def span_scores(predicted: DataFrame, gold: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """(level, name, tp, fp, fn, precision, recall, f1) of spans (repo, doc, first, last, label): for all with their labels
    ("typed", ""), for all without ("boundary", ""), by label and by repo. Predictions that overlap an ignored region (repo,
    doc, first, last), last not included, don't count. A share of nothing is 0."""
    key = ["repo", "doc", "first", "last"]
    if ignored is not None:
        regions = ignored.select("repo", "doc", F.col("first").alias("a"), F.col("last").alias("b")).distinct()
        hit = predicted.select(*key).distinct().join(regions, ["repo", "doc"]).filter("first < b and last > a").select(*key).distinct()
        predicted = predicted.join(hit, key, "left_anti")

    def counted(columns: list[str], level: str, name: Column) -> DataFrame:
        both = predicted.select(*columns).distinct().withColumn("p", F.lit(1)).join(gold.select(*columns).distinct().withColumn("g", F.lit(1)), columns, "full")
        n = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
        p, g = F.col("p").isNotNull(), F.col("g").isNotNull()
        return both.groupBy(name.alias("name")).agg(n(p & g).alias("tp"), n(p & ~g).alias("fp"), n(~p & g).alias("fn")).select(F.lit(level).alias("level"), "name", "tp", "fp", "fn")

    typed = [*key, "label"]
    out = counted(typed, "typed", F.lit("")).union(counted(key, "boundary", F.lit(""))).union(counted(typed, "label", F.col("label"))).union(counted(typed, "repo", F.col("repo")))
    share = lambda a, b: F.when(a + b > 0, a / (a + b)).otherwise(0.0)
    out = out.withColumns({"precision": share(F.col("tp"), F.col("fp")), "recall": share(F.col("tp"), F.col("fn"))})
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def compare_scorers(scores: DataFrame, gold: DataFrame, base: str) -> DataFrame:
    """(suite, scorer, queries, ndcg10, same_first) of scores (suite, query, scorer, key, score) of one pool a query: nDCG at ten
    with gold (query, key), and the share of queries whose first is that of the scorer `base`; suite '' is all. Ties go to
    the lesser key."""
    ranked = scores.withColumn("rank", F.expr("row_number() over (partition by suite, query, scorer order by score desc, key)"))
    first = ranked.join(gold.select("query", "key").distinct().withColumn("hit", F.lit(1)), ["query", "key"], "left")
    each = first.groupBy("suite", "query", "scorer").agg(F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("at"), F.max(F.when(F.col("rank") == 1, F.col("key"))).alias("top"))
    of_base = each.filter(F.col("scorer") == base).select("suite", "query", F.col("top").alias("base_top"))
    each = each.join(of_base, ["suite", "query"], "left")
    gain = F.when(F.col("at") <= 10, 1 / F.log2(F.col("at") + 1)).otherwise(0.0)
    out = each.groupingSets([["suite", "scorer"], ["scorer"]], "suite", "scorer").agg(F.count("*").alias("queries"), F.avg(gain).alias("ndcg10"), F.avg(F.col("top").eqNullSafe(F.col("base_top")).cast("double")).alias("same_first"))
    return out.withColumn("suite", F.coalesce("suite", F.lit("")))
