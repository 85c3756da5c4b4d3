"""Operators over job records: requests, outcomes and stage logs.

Requests carry ``name, tenant, user, user_email, graph_location,
nr_workers, ts``; outcomes ``name, result_code``; stage logs ``run, action,
ts``.  Each operator is one declarative plan; the aggregations are hash
aggregates with partial combine, so one tenant or run holding a third of
the rows is pre-reduced in every task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage_log import STAGES

# Fixed values from the request record definition: allowed characters and
# maximum lengths.
NAME_PATTERN = r"^[0-9a-z-./]+\z"
MAX_TENANT, MAX_USER, MAX_EMAIL, MAX_LOCATION = 32, 32, 128, 128
DEFAULT_WORKERS = 2
# Result code -> class
OUTCOME_CLASSES = {200: "ok", 400: "user_error", 500: "platform_error"}


def _check(cond: Column, code: str) -> Column:
    return F.when(cond, F.lit(code))


def validate_requests(requests: DataFrame) -> DataFrame:
    """Adds ``violations`` (array of codes) and ``is_valid``."""
    t, u, e, g = (F.col(c) for c in ("tenant", "user", "user_email", "graph_location"))
    checks = F.array(
        _check(t.isNull(), "tenant_missing"),
        _check(t.isNotNull() & ~t.rlike(NAME_PATTERN), "tenant_pattern"),
        _check(F.length(t) > MAX_TENANT, "tenant_length"),
        _check(u.isNull(), "user_missing"),
        _check(u.isNotNull() & ~u.rlike(NAME_PATTERN), "user_pattern"),
        _check(F.length(u) > MAX_USER, "user_length"),
        _check(F.length(e) > MAX_EMAIL, "email_length"),
        _check(g.isNull(), "location_missing"),
        _check(F.length(g) > MAX_LOCATION, "location_length"),
    )
    v = F.filter(checks, lambda x: x.isNotNull())
    return requests.withColumn("violations", v).withColumn("is_valid", F.size(v) == 0)


def normalize_requests(requests: DataFrame) -> DataFrame:
    """Lower-case names, default worker count, module path and run name."""
    return requests.select(
        "name",
        F.lower("tenant").alias("tenant"),
        F.lower("user").alias("user"),
        F.coalesce(F.col("nr_workers"), F.lit(DEFAULT_WORKERS)).alias("nr_workers"),
        F.concat(F.lit("mount."), F.col("graph_location")).alias("module"),
        F.concat_ws("-", F.lower("tenant"), F.lower("user"), F.col("name")).alias("run_name"))


def first_arrivals(arrivals: DataFrame, key: str = "name", ts: str = "ts",
                   tie: str | None = None) -> DataFrame:
    """First record per key by (ts, tie): ``key, first_ts[, tie]``.

    A min over a struct is a partial aggregate, unlike a row_number window,
    which would put all records of one key into one task.
    """
    order = [F.col(ts).alias("t")] + ([F.col(tie).alias("k")] if tie else [])
    first = arrivals.groupBy(key).agg(F.min(F.struct(*order)).alias("_f"))
    cols = [F.col(key), F.col("_f.t").alias("first_ts")]
    if tie:
        cols.append(F.col("_f.k").alias(tie))
    return first.select(*cols)


def request_outcomes(requests: DataFrame, outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Each request with the result code of its outcome (NULL when none).

    Both sides are reduced to one row per key first (of several requests the
    earliest: the smallest by its time stamps, then by its other columns; of
    several outcomes the largest by its columns in order), so the join is
    one-to-one and co-partitioned on the key.
    """
    values = [c for c in outcomes.columns if c not in keys]
    last = outcomes.groupBy(*keys).agg(F.max(F.struct(*values)).alias("_o"))
    asked = [c for c in requests.columns if c not in keys]
    if asked:
        first = requests.groupBy(*keys).agg(F.min(F.struct(*(F.col(c) for c in _time_first(asked)))).alias("_r"))
        once = first.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in asked))
    else:
        once = requests.distinct()
    return once.join(last.select(*keys, *(F.col(f"_o.{c}").alias(c) for c in values)), keys, "left")


def _time_first(columns: list[str]) -> list[str]:
    """Time stamps before all other columns: the least struct is then the earliest request."""
    return sorted(columns, key=lambda c: not (c == "ts" or c.endswith("_ts")))


def match_outcomes(requests: DataFrame, outcomes: DataFrame, key: str, within: int, request_ts: str = "request_ts",
                   outcome_ts: str = "outcome_ts", code: str = "result_code") -> DataFrame:
    """Every request with the first outcome of its ``key`` at or after it, at most ``within`` seconds later.

    Adds ``outcome_ts`` and ``code`` (NULL when none; of outcomes at one time the smallest code).
    Time is cut into buckets of ``within`` seconds, so an answer lies in the request's bucket or the
    next one: one running value per (key, bucket), and one row a bucket for the next. No pair of
    request and outcome is formed, and a hot key is spread over its buckets. A request without a key
    has no outcome.
    """
    def bucket(c: str) -> Column:
        return F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(within * 1_000_000)).cast("long")

    answer = F.struct(F.col(outcome_ts).alias("t"), F.col(code).alias("c"))
    given = outcomes.where(F.col(key).isNotNull()).select(
        F.col(key).alias("_k"), bucket(outcome_ts).alias("_b"), F.col(outcome_ts).alias("_at"),
        F.lit(None).cast(requests.schema.simpleString()).alias("_r"), answer.alias("_a"))
    asked = requests.select(F.col(key).alias("_k"), bucket(request_ts).alias("_b"), F.col(request_ts).alias("_at"),
                            F.struct(*requests.columns).alias("_r"), F.lit(None).cast(given.schema["_a"].dataType).alias("_a"))
    # from the latest on: at one time outcomes come first, the smallest code last of them
    later = Window.partitionBy("_k", "_b").orderBy(F.desc("_at"), F.col("_r").isNotNull(), F.desc("_a")) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = asked.unionByName(given).withColumn("_here", F.last("_a", ignorenulls=True).over(later)).where(F.col("_r").isNotNull())
    nxt = given.groupBy("_k", (F.col("_b") - 1).alias("_b")).agg(F.min("_a").alias("_next"))
    found = here.join(nxt, ["_k", "_b"], "left").withColumn("_got", F.coalesce("_here", "_next"))
    gap = F.unix_micros(F.col("_got.t").cast("timestamp")) - F.unix_micros(F.col("_at").cast("timestamp"))
    got = F.when(F.col("_k").isNotNull() & (gap <= within * 1_000_000), F.col("_got"))
    return found.withColumn("_got", got).select("_r.*", F.col("_got.t").alias(outcome_ts), F.col("_got.c").alias(code))


def stage_durations(stamps: DataFrame) -> DataFrame:
    """Per run: ``<stage>_sec`` = finish - start, seconds (NULL if a stamp is missing)."""
    aggs = []
    for action in sorted({a for pair in STAGES.values() for a in pair}):
        aggs.append(F.min(F.when(F.col("action") == action, F.col("ts"))).alias(action))
    per_run = stamps.groupBy("run").agg(*aggs)
    micros = lambda c: F.unix_micros(F.col(f"`{c}`").cast("timestamp"))
    cols = [F.col("run")]
    for stage, (start, finish) in STAGES.items():
        cols.append(((micros(finish) - micros(start)) / F.lit(1e6)).alias(f"{stage}_sec"))
    return per_run.select(*cols)


def _long(durations: DataFrame, group_col: str) -> DataFrame:
    """(group, stage, sec): one row per measured stage."""
    return durations.select(
        group_col, F.explode(F.array(*[
            F.struct(F.lit(s).alias("stage"), F.col(f"{s}_sec").alias("sec")) for s in STAGES
        ])).alias("_s")).select(group_col, "_s.stage", "_s.sec").where(F.col("sec").isNotNull())


def stage_percentiles(durations: DataFrame, group_col: str = "day", percentages: tuple[float, ...] = (0.5, 0.95),
                      accuracy: int = 1000) -> DataFrame:
    """Percentiles of stage seconds by rollup(stage, group): ``n, percentage, sec``.

    The aggregate keeps a quantile summary whose size depends on ``accuracy`` alone, and
    summaries merge, so every task reduces a hot group before the shuffle. ``sec`` is a
    value of the group whose rank differs from ``percentage * n`` by ``n / accuracy`` at most
    (``percentile_ranks`` measures it).
    """
    micros = F.round(F.col("sec") * F.lit(1e6)).cast("long")
    ps = F.array(*(F.lit(float(p)) for p in percentages))
    each = _long(durations, group_col).rollup("stage", group_col).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"),
        F.percentile_approx(micros, ps, F.lit(accuracy)).alias("_q"))
    return each.select("stage", group_col, "level", "n", F.explode(F.arrays_zip(ps.alias("p"), F.col("_q").alias("q"))).alias("_z")) \
        .select("stage", group_col, "level", "n", F.col("_z.p").alias("percentage"), (F.col("_z.q") / F.lit(1e6)).alias("sec"))


def percentile_ranks(durations: DataFrame, percentiles: DataFrame, group_col: str = "day") -> DataFrame:
    """``percentiles`` with ``below`` and ``upto``: how many durations of the group are less, and less or equal.

    Counts are partial sums. Rollup levels are joined apart: totals by stage are at most a row per
    stage and percentage, which is broadcast; only the finest level moves by its key.
    """
    long = _long(durations, group_col).select(F.col(group_col).alias("_g"), F.col("stage").alias("_st"), F.col("sec").alias("_x"))
    below, upto = F.count_if(F.col("_x") < F.col("sec")).alias("below"), F.count_if(F.col("_x") <= F.col("sec")).alias("upto")
    keys = ["stage", group_col, "level", "n", "percentage", "sec"]
    same_stage, same_group = F.col("stage") == F.col("_st"), F.col(group_col).eqNullSafe(F.col("_g"))
    fine = percentiles.where(F.col("level") == 0).join(long, same_stage & same_group)
    stages = F.broadcast(percentiles.where(F.col("level") == 1))
    total = F.broadcast(percentiles.where(F.col("level") == 3).withColumn("_one", F.lit(1)))
    coarse = long.join(stages, same_stage).select(*keys, "_x") \
        .unionByName(long.withColumn("_one", F.lit(1)).join(total, "_one").select(*keys, "_x"))
    return fine.select(*keys, "_x").unionByName(coarse).groupBy(*keys).agg(below, upto)


def stage_summary(durations: DataFrame, group_col: str = "day") -> DataFrame:
    """count / avg / stddev / min / max of stage seconds by rollup(stage, group).

    Durations are whole microseconds, so the average is taken from an exact
    decimal sum (the same double in any engine and any summation order).  The
    sample standard deviation is a floating-point result whose last digits
    depend on the order of summation; it is reported to the millisecond.
    """
    long = _long(durations, group_col)
    micros = F.round(F.col("sec") * F.lit(1e6)).cast("decimal(38,0)")
    n = F.count(F.lit(1))
    return long.rollup("stage", group_col).agg(
        n.alias("n"),
        F.round(F.sum(micros).cast("double") / n / F.lit(1e6), 6).alias("avg_sec"),
        F.round(F.stddev_samp("sec"), 3).alias("stddev_sec"),
        F.round(F.min("sec"), 6).alias("min_sec"),
        F.round(F.max("sec"), 6).alias("max_sec"))


def outcome_classes(outcomes: DataFrame, code_col: str = "result_code") -> DataFrame:
    """Counts per outcome class (ok / user_error / platform_error / no_outcome / other)."""
    c = F.col(code_col)
    cls = F.when(c.isNull(), F.lit("no_outcome"))
    for code, name in OUTCOME_CLASSES.items():
        cls = cls.when(c == code, F.lit(name))
    cls = cls.otherwise(F.lit("other"))
    return outcomes.groupBy(cls.alias("outcome_class")).agg(F.count(F.lit(1)).alias("n"))
