"""Ranking metrics, summaries, comparisons of systems."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ["precision_at_1", "precision_at_k", "recall_at_k", "hit_rate_at_k", "mrr", "ap_at_k", "r_precision", "ndcg_at_k"]
EPSILON = 1e-12


def metrics(results: DataFrame, judgments: DataFrame, k: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """One row for each system and query of ``judgments`` (query_id, doc_id).

    ``results``: by + (doc_id, rank), to a depth of max(k, relevant documents): mrr, first rank and
    r-precision look past k. Queries without results get zeros; those without judgments no row. One
    window for the running hits of average precision, one aggregation for the rest.
    """
    relevant = judgments.select("query_id", "doc_id").distinct()
    sizes = relevant.groupBy("query_id").agg(F.count("*").alias("relevant_count"))
    hits = results.join(relevant.withColumn("rel", F.lit(1)), ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    keys = [c for c in by if c != "query_id"]
    hits = hits.join(sizes, "query_id")
    within = F.col("rank") <= k
    running = F.sum(F.when(within, F.col("rel")).otherwise(0)).over(Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hits = hits.withColumn("_run", running)
    hit = F.col("rel") == 1
    g = hits.groupBy(*by).agg(
        F.sum(F.when(within, F.col("rel")).otherwise(0)).alias("hits"),
        F.max(F.when((F.col("rank") == 1) & hit, 1.0).otherwise(0.0)).alias("precision_at_1"),
        F.min(F.when(hit, F.col("rank"))).alias("first_relevant_rank"),
        F.sum(F.when(within & hit, F.col("_run") / F.col("rank")).otherwise(0.0)).alias("_ap"),
        F.count_if((F.col("rank") <= F.col("relevant_count")) & hit).alias("_r"),
        F.sum(F.when(within & hit, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("_dcg"),
    )
    frame = sizes.crossJoin(F.broadcast(results.select(*keys).distinct())) if keys else sizes
    g = frame.join(g, list(by), "left")
    n, zero = F.col("relevant_count"), F.lit(0.0)
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    six = lambda c: F.round(F.coalesce(c, zero), 6)
    return g.select(
        *by,
        n,
        F.coalesce("hits", F.lit(0)).cast("long").alias("hits"),
        F.col("first_relevant_rank").cast("long").alias("first_relevant_rank"),
        six(F.col("precision_at_1")).alias("precision_at_1"),
        six(F.col("hits") / k).alias("precision_at_k"),
        six(F.col("hits") / n).alias("recall_at_k"),
        six((F.col("hits") > 0).cast("double")).alias("hit_rate_at_k"),
        six(1 / F.col("first_relevant_rank")).alias("mrr"),
        six(F.col("_ap") / F.least(n, F.lit(k))).alias("ap_at_k"),
        six(F.col("_r") / n).alias("r_precision"),
        six(F.col("_dcg") / ideal).alias("ndcg_at_k"),
    )


def summarize(rows: DataFrame, keys: list[str], metrics_: list[str] = METRICS, latency: str | None = None) -> DataFrame:
    """Counts, means and medians of a group; blank group values are ``uncategorized``. Ranks leave misses out."""
    keys_ = [F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit("uncategorized")).otherwise(F.col(c).cast("string")).alias(c) for c in keys]
    six = lambda c: F.round(c, 6)
    timing = [six(F.avg(latency)).alias("mean_latency_ms"), six(F.median(latency)).alias("median_latency_ms")] if latency else []
    return rows.groupBy(*keys_).agg(
        F.count("*").alias("queries"),
        F.count_if(F.col("hit_rate_at_k") > 0).alias("queries_with_hit"),
        F.count_if(F.col("precision_at_1") > 0).alias("queries_top1_hit"),
        *timing,
        *(six(F.avg(m)).alias(f"mean_{m}") for m in metrics_),
        six(F.avg("first_relevant_rank")).alias("mean_first_relevant_rank"),
        six(F.median("first_relevant_rank")).alias("median_first_relevant_rank"),
    )


def summarize_fields(rows: DataFrame, system: list[str], fields: list[str], metric: str) -> DataFrame:
    """A10: one pass over several grouping fields (GROUPING SETS): field, value, system, queries, mean. Rows with a blank field are left out of its sets, the set without a field has all."""
    values = [F.expr(f"nullif(trim(cast({f} as string)), '')").alias(f"_v{i}") for i, f in enumerate(fields)]
    t = rows.select(*system, metric, *values)
    sets = [[*map(F.col, system), F.col(f"_v{i}")] for i in range(len(fields))] + [list(map(F.col, system))]
    g = t.groupingSets(sets, *system, *(f"_v{i}" for i in range(len(fields)))).agg(F.count("*").alias("queries"), F.round(F.avg(metric), 6).alias("mean"), F.grouping_id().alias("_g"))
    full = (1 << len(fields)) - 1
    which = F.lit("all")
    for i, f in enumerate(fields):
        which = F.when(F.col("_g") == full - (1 << (len(fields) - 1 - i)), F.lit(f)).otherwise(which)
    g = g.select(*system, which.alias("field"), F.coalesce(*(f"_v{i}" for i in range(len(fields)))).alias("value"), "queries", "mean")
    return g.where((F.col("field") == "all") | F.col("value").isNotNull())


def pairwise(rows: DataFrame, system: str, metrics_: list[str] = METRICS) -> DataFrame:
    """Wins, losses, ties and mean difference of every two systems (left < right) on the queries both have. ``queries`` counts all queries."""
    long = rows.select("query_id", F.col(system).alias("s"), F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics_))).alias("x")).select("query_id", "s", "x.metric", "x.v")
    left, right = (long.select("query_id", "metric", F.col("s").alias(f"{side}_system"), F.col("v").alias(f"_{side}")) for side in ("left", "right"))
    pairs = left.join(right, ["query_id", "metric"]).where(F.col("left_system") < F.col("right_system"))
    d = F.col("_left") - F.col("_right")
    out = pairs.groupBy("left_system", "right_system", "metric").agg(
        F.count_if(d > EPSILON).alias("left_wins"), F.count_if(d < -EPSILON).alias("right_wins"), F.count_if(F.abs(d) <= EPSILON).alias("ties"), F.round(F.avg(d), 6).alias("mean_delta")
    )
    return out.crossJoin(F.broadcast(rows.agg(F.count_distinct("query_id").alias("queries"))))


def _bucket(value: Column, cuts: list) -> Column:
    """How many of the ascending cuts are at most ``value``, by binary search."""
    if not cuts:
        return F.lit(0)
    table, steps = F.array(*map(F.lit, cuts)), F.array(*(F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(table, at + s - 1) <= value, at + s).otherwise(at))


def nearest_rank(df: DataFrame, column: str, ratios: list[float], buckets: int = 1000) -> DataFrame:
    """One row with the element at round((n - 1) * ratio), half to even, of the sorted column for each ratio.

    Exact at any size: values are counted, dealt to buckets by approximate quantiles, and running sums are
    taken inside each bucket on top of the sums of those before, so no task sorts the whole column.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    cuts = sorted(set(counts.agg(F.percentile_approx("v", [k / buckets for k in range(1, buckets)], 10 * buckets)).first()[0] or []))
    placed = counts.withColumn("b", _bucket(F.col("v"), cuts))
    before = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)  # over the sums of the buckets
    sums = placed.groupBy(F.col("b").alias("k")).agg(F.sum("c").alias("s"))
    sums = sums.select("k", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("shift"), F.sum("s").over(Window.partitionBy()).alias("n"))
    upto = F.sum("c").over(Window.partitionBy("b").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = placed.withColumn("upto", upto).join(F.broadcast(sums), F.col("b") == F.col("k"))
    return placed.agg(*(F.min(F.when(F.col("shift") + F.col("upto") > F.bround((F.col("n") - 1) * r), F.col("v"))).alias(f"q{round(r * 100)}") for r in ratios))


def distribution(df: DataFrame, features: list[str]) -> DataFrame:
    """Documents and share of the total for every (feature, bucket)."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("bucket")) for f in features))).alias("x")).select("x.*")
    g = long.groupBy("feature", "bucket").agg(F.count("*").alias("documents"))
    return g.withColumn("share", F.round(F.col("documents") / F.sum("documents").over(Window.partitionBy("feature")), 6))


def exposure(results: DataFrame, judgments: DataFrame, features: DataFrame, bucket: str, k: int) -> DataFrame:
    """How documents of a bucket are exposed: pairs, documents, hit and top-1 rates, ranks when hit. ``results`` may have several methods."""
    methods = F.broadcast(results.select("method").distinct())
    rows = judgments.join(features, "doc_id").crossJoin(methods).join(results.where(F.col("rank") <= k).select("method", "query_id", "doc_id", "rank"), ["method", "query_id", "doc_id"], "left")
    return rows.groupBy("method", bucket).agg(
        F.count("*").alias("pairs"), F.count_distinct("doc_id").alias("documents"), F.round(F.avg(F.col("rank").isNotNull().cast("double")), 6).alias("hit_rate"),
        F.round(F.avg((F.coalesce("rank", F.lit(0)) == 1).cast("double")), 6).alias("top1_rate"), F.round(F.avg("rank"), 6).alias("mean_rank_when_hit"), F.round(F.median("rank"), 6).alias("median_rank_when_hit"),
    )


def padded(results: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """K rows a query, blanks where there are no results."""
    slots = queries.select("query_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long"))).alias("rank"))
    return slots.join(results, ["query_id", "rank"], "left")


def probes(results: DataFrame, probes_: DataFrame, combo: str = "combo") -> DataFrame:
    """For each configuration, precision at 1 and 3 of the probes with an expected text, and the share of ``weak`` probes whose first result is marked weak.

    ``results``: combo, probe_id, rank, label, weak_match; ``probes_``: probe_id, expected.
    """
    top = F.when(F.col("rank") <= 3, F.contains(F.lower("label"), F.lower("expected")))
    per = results.join(probes_, "probe_id").groupBy(combo, "probe_id", "expected").agg(
        F.max(F.when(F.col("rank") == 1, top).cast("int")).alias("p1"), F.max(top.cast("int")).alias("p3"), F.max(F.when(F.col("rank") == 1, F.col("weak_match")).cast("int")).alias("w")
    )
    known = F.col("expected") != "weak"
    three = lambda c: F.bround(F.coalesce(F.avg(c), F.lit(0.0)), 3)
    return per.groupBy(combo).agg(F.count_if(known).alias("in_corpus"), three(F.when(known, F.col("p1"))).alias("p_at_1"), three(F.when(known, F.col("p3"))).alias("p_at_3"), three(F.when(~known, F.col("w"))).alias("weak_recall"))


def best_by(rows: DataFrame, group: list[str], system: str, metric: str) -> DataFrame:
    """The system with the largest metric in each group, ties to the smaller name."""
    w = Window.partitionBy(*group).orderBy(F.col(metric).desc(), F.col(system))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def row_for(summary: DataFrame, **keys: str) -> DataFrame:
    """The first row of a summary with these values (profile, method, ...), in the order of its columns; empty where there is none."""
    for k, v in keys.items():
        summary = summary.where(F.col(k) == v)
    return summary.orderBy(*summary.columns).limit(1)


def overview(judgments: DataFrame, fields: list[str]) -> DataFrame:
    """Distinct queries for every value of each field of a judgment table: field, value, queries. A query counts with the value of its first row."""
    w = Window.partitionBy("query_id").orderBy("doc_id")
    first = judgments.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    long = first.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))).alias("x")).select("x.*")
    return long.where("value is not null and trim(value) <> ''").groupBy("field", "value").agg(F.count("*").alias("queries"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """U1, U3, K3's header: all rows, columns in first-seen order, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
