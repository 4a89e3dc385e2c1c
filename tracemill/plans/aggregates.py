"""Aggregates, rollouts and comparisons over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import compare, metrics, rollouts
from .registry import query, table

C = F.col


@query("""
SELECT lang, CAST(grouping(lang) AS INTEGER) AS is_total, count(*) AS n, round(avg(quality::DOUBLE), 4) AS quality, round(avg(toxic::DOUBLE), 4) AS toxic
FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((lang), ())""")
def rates_by_group(spark, d):
    """Rates by language and overall in one pass."""
    return metrics.rates_overall_and_by(table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id"), ["quality", "toxic"], "lang")


@query("""
SELECT bucket, n, row_number() OVER (ORDER BY n DESC, bucket)::INTEGER AS rank FROM (
  SELECT coalesce(nullif(CASE WHEN event_type = 'click' THEN '' WHEN event_type = 'view' THEN NULL ELSE event_type END, ''), 'none') AS bucket, count(*) AS n
  FROM events GROUP BY 1)""")
def error_histogram(spark, d):
    """Null and empty errors count as none."""
    error = F.when(C("event_type") == "click", "").when(C("event_type") == "view", None).otherwise(C("event_type"))
    return metrics.histogram(table(spark, d, "events"), metrics.bucket(error))


@query("""SELECT bucket, n, row_number() OVER (ORDER BY n DESC, first)::INTEGER AS rank FROM (
  SELECT props AS bucket, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1)""")
def histogram_first_seen(spark, d):
    """A3: counts by value, ties in order of first appearance."""
    return metrics.histogram(table(spark, d, "events"), C("props"), pos="event_id")


@query("""SELECT conv_id, turn < 2 AS early, count(*) AS members, bool_and(length(text) > 60) AS all_success, NOT bool_or(length(text) > 60) AS all_failure,
  max(length(text)) = min(length(text)) AS zero_reward_std, NOT bool_and(length(text) > 60) AND bool_or(length(text) > 60) AS mixed
FROM conversations WHERE turn < 2 GROUP BY 1, 2""")
def group_contrast_sized(spark, d):
    """Contrast within groups that must have two members each, here the first two turns of a conversation."""
    turns = table(spark, d, "conversations").where("turn < 2").select("conv_id", (C("turn") < 2).alias("early"), (F.length("text") > 60).alias("ok"), F.length("text").alias("size"))
    return rollouts.contrast(turns, ["conv_id", "early"], "ok", "size", members=2)


@query("SELECT l_linenumber AS calls, count(*) AS n FROM lineitem GROUP BY 1")
def sorted_histogram(spark, d):
    """A4: counts by key in order of the key."""
    return table(spark, d, "lineitem").groupBy(C("l_linenumber").alias("calls")).agg(F.count("*").alias("n")).orderBy("calls")


@query("""
SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'O') AS n_O, count(*) FILTER (WHERE l_linestatus = 'F') AS n_F,
  count(*) FILTER (WHERE l_linestatus = 'X') AS n_X FROM lineitem GROUP BY 1""")
def counts_fixed_domain(spark, d):
    """A5: conditional counts over a fixed domain, zeros kept."""
    return metrics.counts_over(table(spark, d, "lineitem"), "l_linestatus", ["O", "F", "X"], ["l_returnflag"])


@query("""
SELECT event_type, sum(t)::BIGINT AS total_tokens, round(avg(t), 3) AS mean_per_row, round(sum(t)::DOUBLE / sum(n), 3) AS mean_per_turn FROM (
  SELECT event_type, user_id % 7 + event_id % 5 + CASE WHEN event_id % 3 = 0 THEN 4 ELSE 0 END AS t, CASE WHEN event_id % 3 = 0 THEN 3 ELSE 2 END AS n FROM events)
GROUP BY 1""")
def token_usage(spark, d):
    """Totals, mean by row and mean over flattened lists."""
    lists = F.concat(F.array(C("user_id") % 7, C("event_id") % 5), F.when(C("event_id") % 3 == 0, F.array(F.lit(4).cast("long"))).otherwise(F.array().cast("array<bigint>")))
    return metrics.token_usage(table(spark, d, "events").select("event_type", lists.alias("counts")), "counts", ["event_type"])


@query("""
WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, n_chars AS p95 FROM r WHERE i = round_even((n - 1) * 0.95, 0)::BIGINT""")
def nearest_rank_p95(spark, d):
    """Percentile at the nearest rank, half-way ranks to the even one."""
    return metrics.nearest_rank_by(table(spark, d, "documents"), "n_chars", 0.95, ["lang"], "p95")


@query("SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def interp_p95(spark, d):
    """Interpolated percentile."""
    return metrics.percentile_by(table(spark, d, "events"), "value", 0.95, ["event_type"], "p95").withColumn("p95", F.round("p95", 6))


@query("""
SELECT lang, min(n_chars) AS low, list_sort(list(n_chars))[(count(*) // 2)::BIGINT + 1] AS median, max(n_chars) AS high FROM documents GROUP BY 1""")
def upper_median(spark, d):
    """Least, upper median and greatest."""
    return metrics.upper_median_by(table(spark, d, "documents"), "n_chars", ["lang"])


@query("""
SELECT count(*) AS samples, max(l_extendedprice) AS total_max, max(l_quantity) AS used_max, min(l_discount) AS free_min, round(avg(l_tax), 4) AS utilization_mean,
  round(quantile_cont(l_tax, 0.95), 4) AS utilization_p95, max(l_tax) AS utilization_max, round(avg(l_quantity), 4) AS power_mean, max(l_quantity) AS power_max FROM lineitem""")
def telemetry_summary(spark, d):
    """A10: one row over all samples."""
    return metrics.telemetry_summary(table(spark, d, "lineitem"), "l_quantity", "l_discount", "l_extendedprice", "l_tax", "l_quantity")


@query("""
WITH s AS (SELECT event_type, user_id % 3 AS seed, round(avg((value > 20)::INTEGER::DOUBLE), 4) AS passed FROM events GROUP BY ALL)
SELECT event_type, count(*) AS n_groups, round(avg(passed), 4) AS passed FROM s GROUP BY 1""")
def mean_over_seeds(spark, d):
    """Mean of rounded means by seed."""
    rows = table(spark, d, "events").select("event_type", (C("user_id") % 3).alias("seed"), (C("value") > 20).alias("passed"))
    return metrics.mean_of_rounded_means(rows, ["passed"], ["event_type"], ["seed"])


@query("""
WITH e AS (
  SELECT event_id, 'k' AS name, json_extract_string(props, '$.k')::DOUBLE AS value FROM events
  UNION ALL SELECT event_id, event_type, value FROM events)
SELECT name, min(value) AS low, max(value) AS high, arg_max(value, event_id) AS last FROM e WHERE value IS NOT NULL GROUP BY 1""")
def log_summary(spark, d):
    """Least, greatest and last value of each name over a log of maps with different keys."""
    entry = F.map_filter(F.create_map(F.lit("k"), F.get_json_object("props", "$.k").cast("double"), C("event_type"), C("value")), lambda k, v: v.isNotNull())
    return metrics.log_summary(table(spark, d, "events").select("event_id", entry.alias("entry")), "entry", "event_id")


@query("""SELECT event_id AS pos, event_type AS name, value FROM events WHERE isnan(value) OR isinf(value)""")
def non_finite_values(spark, d):
    """Log values that are NaN or infinite; empty when all is well."""
    rows = table(spark, d, "events").where("value is not null").select(C("event_id").alias("pos"), F.create_map("event_type", "value").alias("entry"))
    return metrics.non_finite(rows, "entry", "pos")


_GROUPS = """
WITH g AS (SELECT user_id, count(*) AS members, bool_and(value > 5) AS all_success, NOT bool_or(value > 5) AS all_failure, max(value) = min(value) AS zero_reward_std,
  min(event_type) AS tier FROM events GROUP BY 1), f AS (SELECT *, NOT all_success AND NOT all_failure AS mixed FROM g)"""


@query(_GROUPS + " SELECT user_id, members, all_success, all_failure, zero_reward_std, mixed FROM f")
def group_contrast(spark, d):
    """Whether a group's members all succeed, all fail or differ."""
    return rollouts.contrast(table(spark, d, "events").withColumn("ok", C("value") > 5), ["user_id"], "ok", "value")


@query(_GROUPS + """ SELECT tier, count(*) AS n_groups, round(avg(all_success::INTEGER), 4) AS all_success, round(avg(all_failure::INTEGER), 4) AS all_failure,
  round(avg(mixed::INTEGER), 4) AS mixed, round(avg(zero_reward_std::INTEGER), 4) AS zero_reward_std FROM f GROUP BY 1""")
def group_contrast_rates(spark, d):
    """Rates of the contrast flags by tier."""
    rows = table(spark, d, "events").withColumn("ok", C("value") > 5)
    groups = rollouts.contrast(rows, ["user_id"], "ok", "value").join(rows.groupBy("user_id").agg(F.min("event_type").alias("tier")), "user_id")
    return rollouts.contrast_rates(groups, ["tier"])


def _rollouts(spark, d):
    """Rollout rows from line items: outcome by order key, calls by line number."""
    k, n = C("l_orderkey") % 5, C("l_linenumber")
    outcome = F.element_at(F.array(*map(F.lit, rollouts.OUTCOMES)), (k + 1).cast("int"))
    return table(spark, d, "lineitem").select(
        "l_returnflag", outcome.alias("outcome"), (k < 2).alias("valid_trajectory"), k.isin(0, 2).alias("answer_correct"), (C("l_partkey") % 11 == 0).alias("truncated"),
        F.when(k == 0, 2.0).when(k == 3, -1.0).when(k == 4, -0.1).otherwise(0.0).alias("reward"), n.alias("tool_call_count"), F.lit(4).alias("expected_tool_call_count"),
    )


@query("""SELECT l_returnflag, round(avg((l_orderkey % 5 = 0)::INTEGER), 4) AS valid_correct, round(avg((l_orderkey % 5 = 1)::INTEGER), 4) AS valid_incorrect,
  round(avg((l_orderkey % 5 = 2)::INTEGER), 4) AS invalid_correct, round(avg((l_orderkey % 5 = 3)::INTEGER), 4) AS invalid_incorrect,
  round(avg((l_orderkey % 5 = 4)::INTEGER), 4) AS no_answer FROM lineitem GROUP BY 1""")
def outcome_rates(spark, d):
    """Shares of the five outcomes."""
    return rollouts.outcome_rates(_rollouts(spark, d), ["l_returnflag"])


@query("""SELECT l_returnflag, round(avg((k = 0)::INTEGER), 4) AS task_success, round(avg((k = 4)::INTEGER), 4) AS no_answer, round(avg((k >= 2)::INTEGER), 4) AS invalid_trace,
  round(avg((k = 2)::INTEGER), 4) AS correct_but_invalid, round(avg((k = 2)::INTEGER), 4) AS nonnegative_invalid, round(avg((l_partkey % 11 = 0)::INTEGER), 4) AS truncated,
  round(avg((l_linenumber < 4)::INTEGER), 4) AS under_call, round(avg((l_linenumber = 4)::INTEGER), 4) AS exact_call, round(avg((l_linenumber > 4)::INTEGER), 4) AS over_call
FROM (SELECT *, l_orderkey % 5 AS k FROM lineitem) GROUP BY 1""")
def reward_metrics(spark, d):
    """Derived reward metrics and call-count rates."""
    return rollouts.reward_metrics(_rollouts(spark, d), ["l_returnflag"])


@query("""WITH r AS (SELECT event_type, row_number() OVER w AS seen, count(*) OVER (PARTITION BY event_type) AS n,
  round(avg((value > 20)::INTEGER::DOUBLE) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING), 4) AS rate FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id))
SELECT event_type, seen, rate FROM r WHERE seen % 10 = 0 OR seen = n""")
def running_success(spark, d):
    """Mean so far after every 10 rows and after the last."""
    return metrics.running_rate(table(spark, d, "events").withColumn("ok", C("value") > 20), "ok", "event_id", 10, ["event_type"])


@query("""SELECT l_returnflag, CASE WHEN sum(l_tax) > 0 THEN round(sum(l_quantity) / sum(l_tax), 1) ELSE 0.0 END AS per_second,
  CASE WHEN sum(l_tax * 0) > 0 THEN 1.0 ELSE 0.0 END AS without_time FROM lineitem GROUP BY 1""")
def throughput(spark, d):
    """Sum by sum, 0 without time."""
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        metrics.throughput(C("l_quantity"), C("l_tax")).alias("per_second"), metrics.throughput(C("l_quantity"), C("l_tax") * 0).alias("without_time"))


@query("""SELECT count(*) AS n, count(DISTINCT doc_id) AS n_ids, count(*) = count(DISTINCT doc_id) AS unique_ids, count(DISTINCT text) AS n_texts FROM documents""")
def uniqueness(spark, d):
    """Exact distinct counts; texts go by 128 bits each."""
    rows = table(spark, d, "documents").select("doc_id", F.when(C("text").isNotNull(), hashing.identity(C("text"))).alias("text"))
    return rows.agg(
        F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_ids"), (F.count("*") == F.countDistinct("doc_id")).alias("unique_ids"),
        F.countDistinct("text").alias("n_texts"))


@query("""SELECT l_returnflag, min(l_linenumber) FILTER (WHERE l_linestatus = 'O') AS low, max(l_linenumber) FILTER (WHERE l_linestatus = 'O') AS high,
  greatest(6, max(l_linenumber)) AS budget FROM lineitem GROUP BY 1""")
def operation_range(spark, d):
    """Conditional range, and the greatest value with a floor."""
    open_ = F.when(C("l_linestatus") == "O", C("l_linenumber"))
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.min(open_).alias("low"), F.max(open_).alias("high"), metrics.floored_max(C("l_linenumber"), 6).alias("budget"))


@query("""SELECT source, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'fr') AS fr, count(*) FILTER (WHERE lang = 'de') AS de,
  count(*) FILTER (WHERE lang = 'xx') AS xx FROM documents GROUP BY 1""")
def composition_matrix(spark, d):
    """Counts of stage by domain, zeros kept."""
    return metrics.composition(table(spark, d, "documents"), "source", "lang", ["en", "fr", "de", "xx"])


_ARMS = "WITH a AS (SELECT l_returnflag AS arm, l_linestatus AS split, avg(l_quantity) AS q, avg(l_discount) AS x FROM lineitem GROUP BY ALL)"


@query(_ARMS + """, o AS (SELECT arm, avg(q) AS q FROM a GROUP BY 1) SELECT arm, round(o.q, 6) AS q, round(o.q - b.q, 6) AS q_delta, round(o.q / b.q, 6) AS q_ratio
FROM o CROSS JOIN (SELECT q FROM o WHERE arm = 'A') b""")
def baseline_delta(spark, d):
    """Every arm against one baseline row."""
    arms = table(spark, d, "lineitem").groupBy(C("l_returnflag").alias("arm"), "l_linestatus").agg(F.avg("l_quantity").alias("q")).groupBy("arm").agg(F.avg("q").alias("q"))
    return compare.against_baseline(arms, "arm", "A", ["q"]).withColumn("q", F.round("q", 6))


@query(_ARMS + """ SELECT a.arm, a.split, round(a.q, 6) AS q, round(a.x, 6) AS x, round(a.q - b.q, 6) AS q_delta, round(a.x - b.x, 6) AS x_delta, round(a.q / b.q, 6) AS q_ratio,
  round(a.x / b.x, 6) AS x_ratio FROM a LEFT JOIN a b ON a.split = b.split AND b.arm = 'R'""")
def treatment_deltas(spark, d):
    """Vector deltas to the baseline by split."""
    arms = table(spark, d, "lineitem").groupBy(C("l_returnflag").alias("arm"), C("l_linestatus").alias("split")).agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("x"))
    return compare.against_baseline(arms, "arm", "R", ["q", "x"], ["split"]).withColumn("q", F.round("q", 6)).withColumn("x", F.round("x", 6))


_PAIRS = "WITH p AS (SELECT user_id, event_type, avg(value) > 20 AS ok FROM events GROUP BY ALL)"


@query(_PAIRS + """ SELECT a.user_id, a.ok AS passed_click, b.ok AS passed_view, c.ok AS passed_purchase FROM p a
LEFT JOIN p b ON a.user_id = b.user_id AND b.event_type = 'view' LEFT JOIN p c ON a.user_id = c.user_id AND c.event_type = 'purchase' WHERE a.event_type = 'click'""")
def paired_survival(spark, d):
    """Results of several variants side by side, by the ids of the first."""
    rows = table(spark, d, "events").groupBy("user_id", "event_type").agg((F.avg("value") > 20).alias("ok"))
    return compare.paired(rows, "user_id", "event_type", "ok", "click", ["view", "purchase"])


@query(_PAIRS + """, j AS (SELECT a.ok AS a, coalesce(b.ok, false) AS b FROM p a LEFT JOIN p b ON a.user_id = b.user_id AND b.event_type = 'view' WHERE a.event_type = 'click')
SELECT count(*) FILTER (WHERE a AND b) AS "both", count(*) FILTER (WHERE a AND NOT b) AS lost, count(*) FILTER (WHERE NOT a AND b) AS gained,
  count(*) FILTER (WHERE NOT a AND NOT b) AS neither FROM j""")
def paired_changes(spark, d):
    """How many ids keep, lose and gain success from one variant to another."""
    return compare.paired_counts(paired_survival(spark, d), "click", "view")


@query("""SELECT o_orderpriority AS arm, o.n AS n_orders, round(l.q, 4) AS mean_quantity, c.n AS n_customers FROM
  (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) o
  JOIN (SELECT o_orderpriority, avg(l_quantity) AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1) l USING (o_orderpriority)
  JOIN (SELECT o_orderpriority, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1) c USING (o_orderpriority)""")
def multi_source_join(spark, d):
    """One row for each arm from several sources."""
    orders, items = table(spark, d, "orders"), table(spark, d, "lineitem")
    size = orders.groupBy("o_orderpriority").agg(F.count("*").alias("n_orders"), F.countDistinct("o_custkey").alias("n_customers"))
    quantity = orders.join(items, C("o_orderkey") == C("l_orderkey")).groupBy("o_orderpriority").agg(F.round(F.avg("l_quantity"), 4).alias("mean_quantity"))
    return size.join(quantity, "o_orderpriority").withColumnRenamed("o_orderpriority", "arm")


_DOSE = "WITH m AS (SELECT l_returnflag AS stage, month(l_shipdate)::INTEGER * 10 AS percent, round(avg(l_quantity), 4) AS success, round(avg(l_tax), 4) AS exhausted FROM lineitem GROUP BY ALL)"


def _doses(spark, d):
    by = [C("l_returnflag").alias("stage"), (F.month("l_shipdate") * 10).alias("percent")]
    return table(spark, d, "lineitem").groupBy(*by).agg(F.round(F.avg("l_quantity"), 4).alias("success"), F.round(F.avg("l_tax"), 4).alias("exhausted"))


@query(_DOSE + """ SELECT stage, percent, success, exhausted, round(success - lag(success) OVER w, 6) AS gain,
  round((success - lag(success) OVER w) * 10 / (percent - lag(percent) OVER w), 6) AS gain_per_10 FROM m WINDOW w AS (PARTITION BY stage ORDER BY percent)""")
def dose_response(spark, d):
    """Marginal gain of each step of a mixture."""
    return compare.dose_response(_doses(spark, d), "percent", "success", ["stage"])


@query(_DOSE + """ SELECT percent, stage AS best, success FROM m QUALIFY row_number() OVER (PARTITION BY percent ORDER BY success DESC, stage) = 1""")
def best_policy(spark, d):
    """The best policy of each split."""
    return compare.best_by(_doses(spark, d), ["percent"], "stage", "success")


@query(_DOSE + """, n AS (SELECT *, max(success) OVER () AS best FROM m WHERE stage = 'N') SELECT min(percent) AS percent FROM n WHERE success >= best - 0.2 AND exhausted < 0.05""")
def constrained_pick(spark, d):
    """The smallest cap near the best success with little exhaustion."""
    return compare.constrained_pick(_doses(spark, d).where("stage = 'N'"), "percent", "success", "exhausted", 0.2, 0.05)


@query("""SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS n_ids FROM events GROUP BY 1 HAVING count(*) <> 5 OR count(DISTINCT event_type) <> 5""")
def incomplete_runs(spark, d):
    """Runs without exactly the expected rows and ids."""
    return compare.incomplete_runs(table(spark, d, "events"), "user_id", "event_type", 5)


@query("""SELECT bucket, n, row_number() OVER (ORDER BY n DESC, bucket)::INTEGER AS rank FROM (SELECT CASE WHEN l_linestatus = 'O' THEN 'success' WHEN l_linenumber < 3 THEN 'premature_stop'
  WHEN l_linenumber > 3 THEN 'overcall' ELSE 'wrong_order' END AS bucket, count(*) AS n FROM lineitem GROUP BY 1)""")
def failure_kinds(spark, d):
    """Failures by whether they stopped early, went on or took a wrong order."""
    kind = compare.failure_kind(C("l_linestatus") == "O", C("l_linenumber"), F.lit(3))
    return metrics.histogram(table(spark, d, "lineitem"), kind)
