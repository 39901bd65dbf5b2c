"""Operational marts from event and load logs, run metrics, run checks, similar runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions import expr
from tabulon.operators import relational as R


def rate(part: Column, whole: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(part, whole), F.lit(0.0)), 4)


def fct_loads(loads: DataFrame) -> DataFrame:
    """The ledger with its day and throughput."""
    speed = F.when(F.col("duration_ms") > 0, F.round(F.col("rows_out") * 1000 / F.col("duration_ms"), 2))
    return loads.withColumn("dt", F.to_date("created_at")).withColumn("rows_per_s", speed)


def fct_agent_runs(events: DataFrame) -> DataFrame:
    tokens = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("input_tokens", "output_tokens")}
    return events.filter("event = 'agent.run'").withColumns(tokens)


def daily(df: DataFrame, keys: list[str], ok: Column, failed: Column, duration: str) -> DataFrame:
    """Counts, failure rate and duration figures by ``keys``."""
    n = F.count(F.lit(1))
    return df.groupBy(*keys).agg(
        n.alias("runs"),
        F.count_if(ok).alias("succeeded"),
        F.count_if(failed).alias("failed"),
        rate(F.count_if(failed), n).alias("failure_rate"),
        F.round(F.avg(duration), 2).alias("avg_duration"),
        F.round(F.percentile(duration, 0.95), 4).alias("p95_duration"),
        F.max(duration).alias("max_duration"),
    )


def daily_pipeline(loads: DataFrame) -> DataFrame:
    """Loads by day and project: outcomes, rows, bytes and durations."""
    n, total = F.count(F.lit(1)), lambda c: F.coalesce(F.sum(c), F.lit(0))
    quarantined = F.count_if(F.col("status") == "quarantined")
    return loads.groupBy("dt", "project_id").agg(
        n.alias("loads"),
        F.count_if(F.col("status") == "succeeded").alias("succeeded"),
        quarantined.alias("quarantined"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.round(quarantined / n, 4).alias("quarantine_rate"),
        total("rows_out").alias("rows_loaded"),
        total("rows_rejected").alias("rows_rejected"),
        total("raw_bytes").alias("raw_bytes"),
        F.round(F.avg("duration_ms")).alias("avg_duration_ms"),
        F.percentile("duration_ms", 0.95).alias("p95_duration_ms"),
        F.max("duration_ms").alias("max_duration_ms"),
    )


def dataset_health(loads: DataFrame) -> DataFrame:
    """Per dataset: loads by outcome, first and last load, and the state of the last that succeeded."""
    ok, status = F.col("status") == "succeeded", F.col("status")
    last = lambda c: F.max_by(F.when(ok, F.col(c)), F.when(ok, F.col("load_id")))
    return loads.groupBy("project_id", "dataset").agg(
        F.count(F.lit(1)).alias("loads"),
        *[F.count_if(status == k).alias(k) for k in ("succeeded", "quarantined", "failed")],
        F.min("created_at").alias("first_load_at"),
        F.max("created_at").alias("last_load_at"),
        last("load_id").alias("last_success_load_id"),
        last("rows_out").alias("last_rows_out"),
        last("quality_status").alias("last_quality_status"),
        F.coalesce(F.sum("rows_rejected"), F.lit(0)).alias("rows_rejected_total"),
        F.round(F.avg("duration_ms")).alias("avg_duration_ms"),
    )


def recent_window(mart: DataFrame, until: Column, days: int = 30, project: str | None = None) -> DataFrame:
    rows = mart.filter((F.col("dt") > F.date_sub(until, days)) & (F.col("dt") <= until))
    return (rows.filter(F.col("project_id") == project) if project else rows).orderBy("dt")


def _counted(df: DataFrame, c: str, name: str, most: int | None = None) -> DataFrame:
    """One row: ``name``, an array of ``(value, n)``, most frequent first."""
    top = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "value", "n")))
    return (top.limit(most) if most else top).agg(F.transform(pairs, lambda p: F.struct(p["value"].alias("value"), p["n"].alias("n"))).alias(name))


def run_metrics(runs: DataFrame) -> DataFrame:
    """One row of rates, averages and totals; models, failures and top tools as arrays of ``(value, n)``.

    Completed runs are ``finished`` or ``text``. Verified counts among the
    completed, positive among the rated; a rate of nothing is null.
    """
    n = F.count(F.lit(1))
    completed = F.col("status").isin("finished", "text")
    share = lambda part, whole: F.round(F.try_divide(F.count_if(part), F.count_if(whole)), 3)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    s = runs.agg(
        n.alias("runs"),
        F.count_if(completed).alias("completed"),
        F.round(F.try_divide(F.count_if(completed), n), 3).alias("success_rate"),
        share(completed & F.coalesce("verified", F.lit(False)), completed).alias("verified_rate"),
        share(F.col("feedback") == "up", F.col("feedback").isin("up", "down")).alias("positive_rate"),
        F.round(F.avg("turns"), 2).alias("avg_turns"),
        F.round(F.avg("tool_calls"), 2).alias("avg_tool_calls"),
        F.round(F.avg("duration_ms")).cast("long").alias("avg_ms"),
        *map(total, ("retries", "self_corrections", "input_tokens", "output_tokens")),
        F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("cost_usd"),
    )
    tools = runs.select(F.explode("trace").alias("step")).select(F.col("step.tool").alias("tool"))
    models = runs.select(F.coalesce("model_name", F.lit("unknown")).alias("model"))
    parts = (_counted(runs, "error_type", "failures"), _counted(models, "model", "models"), _counted(tools, "tool", "top_tools", 5))
    return reduce(lambda a, b: a.join(b, F.lit(True)), parts, s)  # one row each


def subsequence(wanted: Column, found: Column) -> Column:
    """Whether ``wanted`` occurs in ``found`` in order, gaps allowed."""
    step = lambda at, tool: F.when((at < F.size(wanted)) & (F.try_element_at(wanted, at + 1) == tool), at + 1).otherwise(at)
    return F.aggregate(found, F.lit(0), step) == F.size(wanted)


# Words of a request for data, and those that name an aggregate.
DATA_INTENT = ("average", "avg", "count", "data", "filter", "group", "highest", "join", "lowest", "maximum", "minimum", "rows", "show", "sum", "table", "top", "total")
AGGREGATES = {"avg": ("average", "avg", "mean"), "sum": ("total", "sum"), "min": ("minimum", "min"), "max": ("maximum", "max")}


def _checks(rules: dict[str, tuple[Column, Column]]) -> Column:
    """Names and outcomes of the rules ``name: (applies, passed)`` that apply."""
    found = [F.when(applies, F.struct(F.lit(name).alias("name"), F.coalesce(passed, F.lit(False)).alias("passed"))) for name, (applies, passed) in rules.items()]
    return F.filter(F.array(*found), lambda c: c.isNotNull())


def _run_rules(most_rows: int) -> dict[str, tuple[Column, Column]]:
    """The required checks of a run by its status, the kind of its result and its request."""
    words = F.regexp_extract_all(F.lower(F.regexp_replace(F.coalesce("query", F.lit("")), "_", " ")), F.lit("([a-z]+)"))
    says = lambda names: F.arrays_overlap(words, F.array(*map(F.lit, names)))
    wanted = F.lit(None).cast("string")
    for op, names in reversed(AGGREGATES.items()):
        wanted = F.when(says(names), op).otherwise(wanted)
    finished, kind = F.col("status") == "finished", F.col("result_kind")
    value, has = F.col("result_value"), F.col("result_kind").isNotNull()
    return {
        "finish_selected": (finished, F.array_contains(F.transform("trace", lambda t: t["tool"]), "finish")),
        "named_result": (finished, has),
        "bounded_output": (finished & has, F.col("result_rows").isNull() | (F.col("result_rows") <= most_rows) | kind.isin("dataframe", "aggregate")),
        "columns_present": (finished & kind.isin("table", "dataframe", "aggregate"), F.col("result_columns") > 0),
        "aggregate_operation": (finished & (kind == "aggregate") & wanted.isNotNull(), F.col("result_operation") == wanted),
        "finite_number": (finished & (kind == "number"), value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))),
        "text_is_appropriate": (F.col("status") == "text", ~says(DATA_INTENT)),
    }


def _graded(checks: Column) -> dict[str, Column]:
    """Passed if there are checks and none fails; the score is the share that passes."""
    good = F.size(F.filter(checks, lambda c: c["passed"]))
    failed = F.transform(F.filter(checks, lambda c: ~c["passed"]), lambda c: c["name"])
    return {"passed": (F.size(checks) > 0) & (good == F.size(checks)), "score": F.round(F.coalesce(F.try_divide(good, F.size(checks)), F.lit(0.0)), 3), "failed": failed}


def verify_runs(runs: DataFrame, most_rows: int = 25) -> DataFrame:
    """``request_id, passed, score, failed, tool_failed``: the fixed checks of each run.

    Which checks apply follows from the run's status and result. A step that
    ended in an error is told by ``tool_failed`` but decides nothing.
    """
    errors = F.coalesce(F.exists("trace", lambda t: t["status"] == "error"), F.lit(False))
    checked = runs.withColumn("checks", _checks(_run_rules(most_rows)))
    return checked.select("request_id", *[c.alias(n) for n, c in _graded(F.col("checks")).items()], errors.alias("tool_failed"))


def evaluate_suite(cases: DataFrame, runs: DataFrame, most_rows: int = 25) -> DataFrame:
    """``case_id, passed, score, failed``: each case against its run.

    To the run's own checks come those of the case: tools in order, none
    forbidden, kind of result, limits of turns and calls, the answer, and a
    correction. What a case leaves null or empty is not asked for; a case
    without a run fails.
    """
    tools = F.coalesce(F.transform("trace", lambda t: t["tool"]), F.array().cast("array<string>"))
    asked = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0
    given = lambda c: F.col(c).isNotNull()
    rules = _run_rules(most_rows) | {
        "ran": (F.col("request_id").isNull(), F.lit(False)),
        "expected_tool_sequence": (asked(F.col("expected_tools")), subsequence(F.col("expected_tools"), tools)),
        "forbidden_tools": (asked(F.col("forbidden_tools")), ~F.arrays_overlap("forbidden_tools", tools)),
        "result_kind": (given("expected_kind"), F.col("result_kind") == F.col("expected_kind")),
        "turn_efficiency": (given("max_turns"), F.col("turns") <= F.col("max_turns")),
        "tool_efficiency": (given("max_tool_calls"), F.col("tool_calls") <= F.col("max_tool_calls")),
        "answer_accuracy": (given("expected_answer"), F.col("answer") == F.col("expected_answer")),
        "self_correction_success": (F.coalesce("required_correction", F.lit(False)), (F.col("status") == "finished") & (F.col("self_corrections") > 0)),
    }
    checked = cases.join(runs, "case_id", "left").withColumn("checks", _checks(rules))
    return checked.select("case_id", *[c.alias(n) for n, c in _graded(F.col("checks")).items()])


def suite_metrics(evaluated: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: passed and failed cases, mean score, rates, retries, latency, tokens and cost of their runs."""
    j = evaluated.join(runs, "case_id", "left")
    corrected, finished, n = F.coalesce(F.col("self_corrections") > 0, F.lit(False)), F.coalesce(F.col("status") == "finished", F.lit(False)), F.count(F.lit(1))
    third = lambda a, b: F.round(F.try_divide(a, b), 3)
    return j.agg(
        F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
        F.round(F.avg("score"), 3).alias("average_score"),
        third(F.count_if(finished), n).alias("execution_success_rate"),
        third(F.count_if("passed"), n).alias("answer_accuracy_rate"),
        third(F.count_if(corrected & finished), F.count_if(corrected)).alias("self_correction_success_rate"),
        F.coalesce(F.sum("retries"), F.lit(0)).alias("retries"),
        F.round(F.avg("duration_ms")).cast("long").alias("average_latency_ms"),
        F.coalesce(F.sum(F.col("input_tokens") + F.col("output_tokens")), F.lit(0)).alias("tokens"),
        F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("cost_usd"),
    )


def similar_runs(targets: DataFrame, runs: DataFrame, k: int = 3, last: int = 100, schema_words: tuple[str, ...] = ()) -> DataFrame:
    """``id, request_id, score, rank``: past runs to learn from, for each target ``(id, user_id, goal)``.

    Candidates are the ``last`` newest runs of the user that completed, were not
    rated down, have steps and did not fail their verification; so a target is
    compared with ``last`` runs at most. The score is the Jaccard similarity of
    the goals' signatures, and 0.15 more where rated up; newer runs win ties.
    Of runs without any similarity only a first one is given.
    """
    fit = F.col("status").isin("finished", "text") & (F.coalesce("feedback", F.lit("")) != "down") & F.coalesce("verified", F.lit(True)) & (F.size("trace") > 0)
    newest = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("request_id")))
    recent = runs.filter(F.col("status").isin("finished", "text") & (F.coalesce("feedback", F.lit("")) != "down")).withColumn("age", newest).filter(F.col("age") <= last)
    past = recent.filter(fit).select("user_id", "request_id", "age", "feedback", expr.goal_words(F.col("goal"), schema_words).alias("then"))
    now = targets.select("id", "user_id", expr.goal_words(F.col("goal"), schema_words).alias("now"))
    score = expr.jaccard(F.col("now"), F.col("then")) + F.when(F.col("feedback") == "up", 0.15).otherwise(0.0)
    both = now.join(past, "user_id").withColumn("score", F.round(score, 6))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "age")))
    return ranked.filter((F.col("rank") <= k) & ((F.col("score") > 0) | (F.col("rank") == 1))).select("id", "request_id", "score", "rank")


def daily_agent(runs: DataFrame) -> DataFrame:
    """Runs by day and project: success, verification, advanced tier, tokens, cost, durations."""
    n, finished = F.count(F.lit(1)), F.count_if(F.col("status") == "finished")
    return runs.groupBy("dt", "project_id").agg(
        n.alias("runs"),
        finished.alias("finished"),
        F.round(finished / n, 4).alias("success_rate"),
        F.round(F.avg(F.when(F.col("verified"), 1).otherwise(0)), 4).alias("verification_pass_rate"),
        F.count_if(F.col("routing_tier") == "advanced").alias("advanced_runs"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.round(F.sum("cost_usd"), 6).alias("cost_usd"),
        F.round(F.avg("duration_ms")).alias("avg_duration_ms"),
        F.percentile("duration_ms", 0.95).alias("p95_duration_ms"),
        F.round(F.avg("tool_calls"), 2).alias("avg_tool_calls"),
    )


def request_cap(events: DataFrame, cap: int) -> DataFrame:
    """Admitted requests: the first ``cap`` of each user and day."""
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    return events.withColumn("admitted", F.row_number().over(w) <= cap)


def token_cap(events: DataFrame, cap: float, tokens: str) -> DataFrame:
    """Admitted while the day's tokens of the user before the request are below ``cap``."""
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("admitted", F.coalesce(F.sum(tokens).over(w), F.lit(0)) < cap)


def usage_budget(events: DataFrame, user_requests: int = 0, user_tokens: float = 0, global_requests: int = 0, global_tokens: float = 0, tokens: str = "tokens", slice_seconds: int = 60) -> DataFrame:
    """``events`` (user_id, event_id, ts, tokens) with ``admitted`` and ``reason``; a ceiling of 0 is none.

    Requests of a UTC day are taken in the order of (ts, event_id). One is rejected
    by the first ceiling that the day's admitted requests have reached: tokens of
    all, tokens of the user, requests of the user, requests of all. A rejected
    request uses nothing, also where it passed the user's ceilings and failed a
    global one. A null token count is none; negative ones are not usage either.

    Counts only grow, so a user's ceilings admit a first run of the user's
    requests, and the global ones a first run of those. Whether a request lies in
    that run follows from running sums: per user and day, and over the day by
    slices of time. Only in the slice where a global ceiling is reached are
    requests ordered one by one; no window spans a day.
    """
    most = {n: (v if v > 0 else float("inf")) for n, v in (("ur", user_requests), ("ut", user_tokens), ("gr", global_requests), ("gt", global_tokens))}
    day = F.to_date("ts")
    used = F.greatest(F.coalesce(F.col(tokens).cast("double"), F.lit(0.0)), F.lit(0.0))
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (slice_seconds * 1_000_000))
    rows = events.withColumns({"__day": day, "__used": used, "__slice": at})
    before = lambda *keys: Window.partitionBy(*keys).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    summed = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))

    mine = before("user_id", "__day")
    rows = rows.withColumns({"__n": F.row_number().over(Window.partitionBy("user_id", "__day").orderBy("ts", "event_id")) - 1, "__u": summed("__used", mine)})
    rows = rows.withColumn("__own", (F.col("__n") < most["ur"]) & (F.col("__u") < most["ut"]))

    own = F.col("__own")
    slices = rows.groupBy("__day", "__slice").agg(F.count_if(own).alias("__k"), F.sum(F.when(own, F.col("__used")).otherwise(0.0)).alias("__s"))
    order = Window.partitionBy("__day").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)  # a day has a bounded number of slices
    slices = slices.withColumns({"__k0": summed("__k", order), "__s0": summed("__s", order)})
    reached = lambda k, s: (k >= most["gr"]) | (s >= most["gt"])
    slices = slices.withColumns({"__shut": reached(F.col("__k0"), F.col("__s0")), "__turns": reached(F.col("__k0") + F.col("__k"), F.col("__s0") + F.col("__s"))})
    rows = rows.join(slices.drop("__k", "__s"), (rows["__day"].eqNullSafe(slices["__day"])) & (rows["__slice"].eqNullSafe(slices["__slice"]))).drop(slices["__day"]).drop(slices["__slice"])

    turning = ~F.col("__shut") & F.col("__turns")
    ahead = before("__day", "__slice")
    exact = rows.filter(turning).withColumns({"__k1": F.col("__k0") + summed(F.when(own, 1).otherwise(0), ahead), "__s1": F.col("__s0") + summed(F.when(own, F.col("__used")).otherwise(0.0), ahead)})
    exact = exact.withColumn("__shut", reached(F.col("__k1"), F.col("__s1"))).drop("__k1", "__s1")
    rows = rows.filter(~turning).unionByName(exact).withColumn("admitted", own & ~F.col("__shut"))

    # What a rejected request met: its user's admitted requests all came before it, and if a global
    # ceiling was reached by then, so did the day's.
    took = rows.groupBy("user_id", "__day").agg(F.count_if("admitted").alias("__n1"), F.sum(F.when(F.col("admitted"), F.col("__used")).otherwise(0.0)).alias("__u1"))
    days = took.groupBy("__day").agg(F.sum("__u1").alias("__all"))
    same = lambda a, b, keys: reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])
    rows = rows.join(took, same(rows, took, ("user_id", "__day"))).drop(took["user_id"]).drop(took["__day"])
    rows = rows.join(days, same(rows, days, ("__day",))).drop(days["__day"])
    reason = (
        F.when(F.col("admitted"), None)
        .when(F.col("__shut") & (F.col("__all") >= most["gt"]), "global_tokens")
        .when(F.col("__u1") >= most["ut"], "user_tokens")
        .when(F.col("__n1") >= most["ur"], "user_requests")
        .otherwise("global_requests")
    )
    return rows.select(*events.columns, "admitted", reason.alias("reason"))
