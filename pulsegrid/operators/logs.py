"""Call logs, ping logs, CI logs and quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Quality gate -> threshold that the value must reach.
GATES = {
    "code_coverage": 80.0,
    "test_success_rate": 95.0,
    "performance_score": 85.0,
    "security_score": 90.0,
    "code_quality_score": 3.5,
}
PERFORMANCE_SCORE = 85.0

# Whitespace as a text split sees it, letters of other scripts included.
_SPACE = r"(?U)\s+"


def function_timing_summary(calls: DataFrame) -> DataFrame:
    """Calls, times, success share and errors per function, and one row for all of them."""
    ok = F.col("success")
    return (
        calls.rollup("function")
        .agg(
            F.count("*").alias("call_count"),
            F.round(F.avg("execution_time"), 4).alias("average_time"),
            F.round(F.min("execution_time"), 4).alias("min_time"),
            F.round(F.max("execution_time"), 4).alias("max_time"),
            F.round(F.sum("execution_time"), 4).alias("total_time"),
            F.round(F.count_if(ok) / F.count("*") * 100, 2).alias("success_rate"),
            F.count_if(~ok).alias("error_count"),
            F.grouping("function").alias("_all"),
        )
        .filter("call_count > 0")
        .withColumn("function", F.when(F.col("_all") == 1, "(all)").otherwise(F.col("function")))
        .drop("_all")
    )


def slow_functions(calls: DataFrame, threshold_seconds: float = 1.0) -> DataFrame:
    """Functions whose mean time exceeds the threshold, slowest first."""
    return (
        calls.groupBy("function")
        .agg(
            F.avg("execution_time").alias("_avg"),
            F.round(F.max("execution_time"), 4).alias("max_time"),
            F.count("*").alias("call_count"),
        )
        .filter(F.col("_avg") > threshold_seconds)
        .withColumn("average_time", F.round("_avg", 4))
        .drop("_avg")
        .orderBy(F.col("average_time").desc())
    )


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _numbers(lines: Column, pattern: str, dtype: str = "double") -> Column:
    """First group of the pattern on each line as a number, lines without one left out."""
    found = F.transform(lines, lambda s: F.regexp_extract(s, pattern, 1).try_cast(dtype))
    return F.filter(found, lambda x: x.isNotNull())


def ping_latency_stats(runs: DataFrame, output: str = "output") -> DataFrame:
    """Extremes, mean, count and loss of the reply times in each ping output.

    Everything is computed inside the row; no shuffle.
    """
    hits = F.filter(_lines(F.col(output)), lambda s: s.contains("time="))
    times = F.transform(
        hits,
        lambda s: F.replace(F.regexp_extract(s, r"time=\s*(\S+)", 1), F.lit("ms")).try_cast("double"),
    )
    times = F.filter(times, lambda x: x.isNotNull())
    n = F.size("_t")
    return (
        runs.withColumn("_t", F.explode(F.array(times)))
        .select(
            *[c for c in runs.columns if c != output],
            F.array_min("_t").alias("min_ms"),
            F.array_max("_t").alias("max_ms"),
            F.when(n > 0, F.aggregate("_t", F.lit(0.0), lambda a, x: a + x) / n).alias("avg_ms"),
            n.alias("count"),
            F.when(n > 0, 0).otherwise(100).alias("packet_loss_percent"),
        )
    )


def _last(values: Column) -> Column:
    return F.coalesce(F.try_element_at(values, F.lit(-1)), F.lit(0.0))


def _coverage(lines: Column) -> Column:
    totals = F.filter(lines, lambda s: s.contains("TOTAL") & s.contains("%"))

    def percent(line: Column) -> Column:
        parts = F.transform(
            F.split(line, _SPACE),
            lambda p: F.when(p.contains("%"), F.replace(p, F.lit("%")).try_cast("double")),
        )
        return F.try_element_at(F.filter(parts, lambda x: x.isNotNull()), F.lit(1))

    return _last(F.filter(F.transform(totals, percent), lambda x: x.isNotNull()))


def _pylint_score(lines: Column) -> Column:
    rated = F.filter(lines, lambda s: s.contains("Your code has been rated at"))

    def score(line: Column) -> Column:
        after = F.split(line, "at ").getItem(1)
        return F.trim(F.split(after, "/").getItem(0)).try_cast("double")

    return _last(F.filter(F.transform(rated, score), lambda x: x.isNotNull()))


def _tests(lines: Column, word: str) -> Column:
    def count(line: Column) -> Column:
        before = F.rtrim(F.split(line, word).getItem(0))
        return F.element_at(F.split(before, _SPACE), -1).try_cast("int").cast("double")

    hits = F.filter(lines, lambda s: s.contains(word))
    return _last(F.filter(F.transform(hits, count), lambda x: x.isNotNull()))


def _json_length(text: Column) -> Column:
    return F.json_array_length(text).cast("double")


def quality_log_metrics(steps: DataFrame) -> DataFrame:
    """Quality metrics of each CI step from the whole text of its output, one row per metric.

    ``steps`` has run_id, step_id, command and stdout.
    """
    # The split text is a column of its own, so that each branch reads it once.
    steps = steps.withColumn("_lines", F.explode(F.array(_lines(F.col("stdout")))))
    lines, text = F.col("_lines"), F.trim("stdout")
    # Only a complete JSON value gives a result here; other texts give null.
    obj = F.from_json(text, T.StructType.fromDDL("results ARRAY<STRUCT<issue_severity: STRING>>"))
    results = obj.getField("results")
    listed = F.when(text.startswith("["), _json_length(text))
    is_json = F.get_json_object(text, "$").isNotNull()
    looks_json = text.startswith("{") | text.startswith("[")
    issue_lines = F.size(
        F.filter(lines, lambda s: s.contains("Issue:") | s.contains("CRITICAL:") | s.contains("HIGH:"))
    ).cast("double")
    zero = F.lit(0.0)
    high = F.size(F.filter(results, lambda x: x["issue_severity"] == "HIGH")).cast("double")
    issues = (
        F.when(looks_json & ~is_json, issue_lines)
        .when(text.startswith("{") & results.isNotNull(), F.size(results).cast("double"))
        .otherwise(F.coalesce(listed, zero))
    )
    words = ("passed", "failed", "skipped")
    counts = F.array(*[_tests(lines, w) for w in words])

    def metric(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("metric"), value.alias("value"))

    command = F.col("command")
    none = F.array(metric("", zero))
    flake8 = F.size(F.filter(lines, lambda s: (F.trim(s) != "") & s.contains(":"))).cast("double")
    metrics = (
        F.when(command.contains("coverage report"), F.array(metric("coverage_percentage", _coverage(lines))))
        .when(
            command.contains("pylint"),
            F.array(
                metric("pylint_score", _pylint_score(lines)),
                metric("pylint_issues", F.coalesce(listed, zero)),
            ),
        )
        .when(command.contains("flake8"), F.array(metric("flake8_issues", flake8)))
        .when(
            command.contains("pytest"),
            F.flatten(
                F.transform(
                    F.array(counts),
                    lambda c: F.array(
                        *[metric(f"tests_{w}", c[i]) for i, w in enumerate(words)],
                        metric("tests_total", c[0] + c[1] + c[2]),
                    ),
                )
            ),
        )
        .when(
            command.contains("bandit") | command.contains("safety"),
            F.array(
                metric("security_issues", issues),
                metric(
                    "security_high_issues",
                    F.when(is_json & text.startswith("{") & results.isNotNull(), high).otherwise(zero),
                ),
            ),
        )
        .otherwise(F.filter(none, lambda x: x["metric"] != ""))
    )
    return steps.select("run_id", "step_id", F.inline(metrics))


def quality_gates(step_metrics: DataFrame) -> DataFrame:
    """Gate values and results per run; a later step overrides an earlier one."""
    names = [
        "coverage_percentage", "tests_total", "tests_passed",
        "security_issues", "security_high_issues", "pylint_score",
    ]

    def newest(name: str) -> Column:
        mine = F.col("metric") == name
        value = F.max_by(F.when(mine, F.col("value")), F.when(mine, F.col("step_id")))
        return F.coalesce(value, F.lit(0.0)).alias(name)

    runs = step_metrics.groupBy("run_id").agg(*[newest(n) for n in names])
    values = {
        "code_coverage": F.col("coverage_percentage"),
        "test_success_rate": F.when(
            F.col("tests_total") > 0, F.col("tests_passed") / F.col("tests_total") * 100
        ).otherwise(0.0),
        "performance_score": F.lit(PERFORMANCE_SCORE),
        "security_score": F.greatest(
            F.lit(0.0), 100 - F.col("security_issues") * 5 - F.col("security_high_issues") * 10
        ),
        "code_quality_score": F.col("pylint_score"),
    }
    gates = F.array(
        *[
            F.struct(
                F.lit(g).alias("gate"),
                F.lit(GATES[g]).alias("threshold"),
                v.alias("current_value"),
                (v >= GATES[g]).alias("passed"),
            )
            for g, v in values.items()
        ]
    )
    overall = F.when(F.forall("_g", lambda g: g["passed"]), "passed").otherwise("failed")
    return (
        runs.select("run_id", gates.alias("_g"))
        .select("run_id", overall.alias("overall_status"), F.inline("_g"))
        .withColumn("status", F.when(F.col("passed"), "passed").otherwise("failed"))
        .drop("passed")
    )
