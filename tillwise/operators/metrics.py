"""Usage, cost, latency, evaluation and run-state tables over landed logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.core import d, first_by, last_by, lookup, rnd
from tillwise.functions.skew import spread_rank

def usage_summary(log: DataFrame, keys: list[str]) -> DataFrame:
    """log(keys…, query_id, document_id, tokens_in, tokens_out, latency_ms, provider, model)."""
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return log.groupBy(*keys).agg(
        F.count("*").alias("model_call_count"), F.count_distinct("query_id").alias("query_count"),
        F.count_distinct("document_id").alias("document_count"), F.sum("tokens_in").alias("input_tokens"),
        F.sum("tokens_out").alias("output_tokens"), F.sum("latency_ms").alias("total_latency_ms"),
        names("provider").alias("providers"), names("model").alias("models"))


def token_cost(log: DataFrame, rates: dict[str, tuple[float, float, float]]) -> DataFrame:
    """Adds cost (8 decimals) and its status; `rates` is model -> USD per million tokens of input,
    output and cached input. An unknown or all-zero rate gives no cost."""
    rate = lambda i: lookup({k: float(v[i]) for k, v in rates.items()}, F.col("model"))
    fresh = F.greatest(F.lit(0), F.col("input_tokens") - F.col("cached_tokens"))
    cost = (fresh * rate(0) + F.col("output_tokens") * rate(1) + F.col("cached_tokens") * rate(2)) / 1e6
    zero = (rate(0) == 0) & (rate(1) == 0) & (rate(2) == 0)
    status = F.when(rate(0).isNull(), "MODEL_RATE_NOT_CONFIGURED").when(zero, "RATE_NOT_CONFIGURED").otherwise("ESTIMATED")
    return log.withColumn("cost_status", status).withColumn("cost_usd", F.when(status == "ESTIMATED", rnd(cost, 8)))


def latency_percentiles(samples: DataFrame, key: str, points=(0.50, 0.95)) -> DataFrame:
    """Percentiles by index floor((n-1)*p) over all samples of each metric.

    Equal values are counted before the shuffle. A value is the percentile if its run of positions covers
    the index; positions come from counts by bucket of values and are numbered inside a bucket only, so no
    metric lies in one task."""
    counted = samples.filter(F.col("value").isNotNull()).groupBy(key, "value").agg(F.count("*").alias("_c"))
    counted = counted.withColumn("_bucket", F.floor(F.signum("value") * F.log2(F.abs(F.col("value")) + 1) * 16))
    sizes = counted.groupBy(key, "_bucket").agg(F.sum("_c").alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(key, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
                         F.sum("_n").over(Window.partitionBy(key)).alias("sample_count"))
    inside = Window.partitionBy(key, "_bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    rows = counted.withColumn("_upto", F.sum("_c").over(inside)).join(sizes, [key, "_bucket"])
    last = F.col("_before") + F.col("_upto")
    covers = lambda p: F.floor((F.col("sample_count") - 1) * F.lit(p)).between(last - F.col("_c"), last - 1)
    return rows.groupBy(key).agg(F.max("sample_count").alias("sample_count"), *[
        F.max(F.when(covers(p), F.col("value"))).alias(f"p{int(p * 100)}") for p in points])


def counted_percentiles(counted: DataFrame, keys: list[str], points=(0.50, 0.95)) -> DataFrame:
    """counted(keys…, value, c): rows per distinct value to (keys…, n, max_value, p…), percentiles being the
    value at rank ceil(p * samples), exactly.

    Null values count in n only. Ranks are found as in `latency_percentiles`, by bucket of values, so no group
    lies in one task; null keys are groups too."""
    value = F.col("value")
    bucket = F.when(F.isnan("value"), F.lit(2**63 - 1)).otherwise(F.floor(F.signum(value) * F.log2(F.abs(value) + 1) * 16))
    counted = counted.withColumn("_bucket", bucket).withColumn("_held", F.when(value.isNotNull(), F.col("c")).otherwise(F.lit(0)))
    sizes = counted.groupBy(*keys, "_bucket").agg(F.sum("_held").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
                         F.sum("_n").over(Window.partitionBy(*keys)).alias("_samples"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("_bucket").eqNullSafe(F.col("_b"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    rows = counted.withColumn("_upto", F.sum("_held").over(inside)).join(sizes, same)
    last = F.col("_before") + F.col("_upto")
    covers = lambda p: F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("_samples"))).between(last - F.col("_held") + 1, last)
    return rows.groupBy(*keys).agg(F.sum("c").alias("n"), F.max("value").alias("max_value"), *[
        F.max(F.when(covers(p), value)).alias(f"p{int(p * 100)}") for p in points])


def acceptance_ratio(counts: DataFrame, keys: list[str]) -> DataFrame:
    """counts(keys…, accepted, rejected) plus the accepted share, 0 without events."""
    total = F.sum("accepted") + F.sum("rejected")
    return counts.groupBy(*keys).agg(F.coalesce(F.try_divide(F.sum("accepted"), total), d(0)).alias("event_acceptance_ratio"))


def rejection_shares(candidates: DataFrame) -> DataFrame:
    """(code, n, share): how often each failure code was given, and its part of all codes given. candidates(failure_codes)."""
    counts = candidates.select(F.explode("failure_codes").alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n")).scalar())


def per_accepted(documents: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: documents, accepted candidates, cost and latency for each accepted one (0 where none was).
    documents(cost_usd, latency_ms); candidates(accepted)."""
    spent = documents.agg(F.count("*").alias("documents"), F.coalesce(F.sum("cost_usd"), d(0)).alias("_cost"), F.coalesce(F.sum("latency_ms"), d(0)).alias("_latency"))
    accepted = candidates.agg(F.count_if("accepted")).scalar()
    share = lambda total: F.coalesce(F.try_divide(F.col(total), F.col("accepted")), d(0))
    return spent.withColumn("accepted", accepted).select("documents", "accepted", share("_cost").alias("cost_per_accepted_usd"), share("_latency").alias("latency_per_accepted_ms"))


def timeout_counts(outcomes: DataFrame, order: list[str]) -> DataFrame:
    """Timeouts per code; a source counts once, for its first timeout."""
    hits = outcomes.withColumn("code", F.explode("reason_codes")).filter(
        F.col("code").isin("DOCUMENT_FETCH_TIMEOUT", "ATTACHMENT_FETCH_TIMEOUT"))
    first = hits.groupBy("source_id").agg(first_by(F.col("code"), *[F.col(c) for c in order], F.col("code")).alias("code"))
    return first.groupBy("code").agg(F.count("*").alias("timeout_count"))


def sliding_counts(requests: DataFrame, key: str, ts: str, seconds: int, limit: int) -> DataFrame:
    """Requests of the same client in the window ending at each request, and a flag over `limit`.

    A client is cut into stretches of one window length. A row goes to its own stretch and, as a
    mere neighbour, to the next one, so a busy client is many small tasks and counts stay exact."""
    width = seconds * 1_000_000
    rows = requests.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("_slot", F.floor(F.col("_t") / width))
    rows = rows.withColumn("_d", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_stretch", F.col("_slot") + F.col("_d"))
    back = Window.partitionBy(key, "_stretch").orderBy("_t").rangeBetween(-(width - 1), 0)
    rows = rows.withColumn("window_count", F.count("*").over(back)).filter(F.col("_d") == 0)
    return rows.withColumn("over_limit", F.col("window_count") > limit).drop("_t", "_slot", "_d", "_stretch")


def current_state(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Latest state per key with the number of transitions."""
    return log.groupBy(key).agg(last_by(F.col("to_state"), *[F.col(c) for c in order]).alias("state"), F.count("*").alias("transitions"))


def run_deadlines(log: DataFrame, keys: list[str], limit_seconds: int, final_states: list[str]) -> DataFrame:
    """Status per run of a job event log: finished, timed out past the limit, or running."""
    rows = log.groupBy(*keys).agg(F.min("ts").alias("a"), F.max("ts").alias("b"),
                                  last_by(F.col("to_state"), F.col("ts"), F.col("event_id")).alias("last_state"))
    elapsed = F.unix_timestamp("b") - F.unix_timestamp("a")
    status = F.when(F.col("last_state").isin(final_states), "FINISHED").when(elapsed > limit_seconds, "ANALYSIS_JOB_TIMEOUT").otherwise("RUNNING")
    return rows.select(*keys, elapsed.alias("elapsed_seconds"), "last_state", status.alias("status"))


def ratio(top: Column, bottom: Column, empty: float) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), d(empty))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    p, r = ratio(tp, tp + fp, 1.0), ratio(tp, tp + fn, 1.0)
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(d(0))


def extraction_metrics(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """Corpus scores. Events of a case match greedily by type, in order: the n-th prediction of a
    type meets the n-th expected one, so the pairing is an equi join on (case, type, n).

    expected(case_id, event_type, seq, quote, start, end); predicted(same, accepted)."""
    nth = lambda df: spread_rank(df, ["case_id", "event_type"], F.floor(F.col("seq") / 1000), [F.col("seq")], "n")
    e = nth(expected).select("case_id", "event_type", "n", F.struct("quote", "start", "end").alias("e"))
    p = nth(predicted).select("case_id", "event_type", "n", F.struct("quote", "start", "end").alias("p"), "accepted")
    both = e.join(p, ["case_id", "event_type", "n"], "full")
    tp = F.count_if(F.col("e").isNotNull() & F.col("p").isNotNull())
    out = both.agg(tp.alias("tp"), F.count_if(F.col("e").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"),
                   F.count_if(F.col("e") == F.col("p")).alias("exact"), F.count_if(F.col("accepted")).alias("accepted"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.select("tp", "fp", "fn", "accepted", ratio(tp, tp + fp, 1.0).alias("precision"), ratio(tp, tp + fn, 1.0).alias("recall"),
                      f1(tp, fp, fn).alias("f1"), ratio(F.col("exact"), tp, 1.0).alias("span_exact_rate"), ratio(fp, tp + fp, 0.0).alias("false_positive_rate"))


def presence_metrics(documents: DataFrame) -> DataFrame:
    """documents(gold, predicted, type_ok, evidence, evidence_ok): counts per document."""
    s = lambda c: F.sum(c)
    out = documents.agg(
        F.count("*").alias("documents"), F.count_if((F.col("predicted") > 0) & (F.col("gold") > 0)).alias("tp"),
        F.count_if((F.col("predicted") > 0) & (F.col("gold") == 0)).alias("fp"), F.count_if((F.col("predicted") == 0) & (F.col("gold") > 0)).alias("fn"),
        s("predicted").alias("p"), s("type_ok").alias("t"), s("evidence").alias("ev"), s("evidence_ok").alias("ok"))
    return out.select("documents", f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("presence_f1"), ratio(F.col("t"), F.col("p"), 1.0).alias("type_accuracy"),
                      ratio(F.col("ok"), F.col("ev"), 1.0).alias("valid_evidence_rate"), ratio(F.col("ev") - F.col("ok"), F.col("p"), 0.0).alias("unsupported_rate"))


def candidate_view(candidates: DataFrame, log: DataFrame, evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """Per candidate: latest state, sorted distinct failure codes, number of distinct landed
    sources and the first of them; `candidate_sources` lists them all in long form."""
    states = log.groupBy("candidate_id").agg(
        last_by(F.col("to_state"), F.col("ts"), F.col("event_id")).alias("validation_status"),
        F.array_join(F.array_sort(F.collect_set("failure_code")), ",").alias("failure_codes"))
    landed = candidate_sources(evidence, documents).groupBy("candidate_id").agg(F.count("*").alias("source_count"), F.min("source").alias("first_source"))
    out = candidates.join(states, "candidate_id", "left").join(landed, "candidate_id", "left")
    return out.select("candidate_id", F.coalesce("validation_status", F.lit("EXTRACTED")).alias("validation_status"),
                      F.coalesce("failure_codes", F.lit("")).alias("failure_codes"), F.coalesce("source_count", F.lit(0)).alias("source_count"), "first_source")


def candidate_sources(evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """(candidate_id, doc_id, source) of the landed documents a candidate cites, each once."""
    return evidence.select("candidate_id", "doc_id").distinct().join(documents.select("doc_id", "source"), "doc_id")
