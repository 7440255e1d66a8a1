"""Data quality: counts, completeness, keys, ranges, timing, format and gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import stats as fs
from strandline.functions import dims as fd
from strandline.functions import text
from strandline.operators.matching import orphans
from strandline.operators.series import gaps
from strandline.sources.readers import NUMBER_LINE, TIMING_LINE


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table."""
    return _union(
        [t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, t in tables.items()]
    )


def record_counts(tables: dict[str, DataFrame], expected: dict[str, tuple[int, int | None]]) -> DataFrame:
    """Row counts against expectations.

    With an upper bound the count has to equal the lower one, without it the count has
    to reach it.
    """
    rows = []
    for name, (low, high) in expected.items():
        n = F.col("rows")
        ok = (n >= low) if high is None else (n == low)
        rows.append(
            tables[name]
            .agg(F.count(F.lit(1)).alias("rows"))
            .select(
                F.lit(name).alias("table_name"),
                F.col("rows").alias("actual"),
                F.lit(f"{low}+" if high is None else str(low)).alias("expected"),
                F.when(ok, "PASS").otherwise("WARN").alias("status"),
            )
        )
    return _union(rows)


def completeness(tables: dict[str, tuple[DataFrame, list[str]]], threshold: float = 100.0) -> DataFrame:
    """Share of non-NULL values per critical field; one pass per table."""
    rows = []
    for name, (df, fields) in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in fields])
        long = one.unpivot(["_n"], fields, "field", "_c")
        pct = F.coalesce(F.try_divide(F.col("_c").cast("double"), F.col("_n").cast("double")) * 100, F.lit(0.0))
        rows.append(
            long.select(
                F.lit(name).alias("table_name"),
                "field",
                pct.alias("completeness_pct"),
                F.when(pct < threshold, "WARN").otherwise("PASS").alias("status"),
            )
        )
    return _union(rows)


def duplicates(df: DataFrame, keys: list[Column]) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") > 1)


def referential_integrity(
    checks: list[tuple[str, DataFrame, str, DataFrame, str]]
) -> DataFrame:
    """Per named check the distinct dangling keys and the rows that refer to them."""
    rows = []
    for name, child, key, parent, parent_key in checks:
        found = orphans(child, key, parent, parent_key)
        rows.append(
            found.agg(
                F.count(F.lit(1)).alias("orphan_keys"),
                F.coalesce(F.sum("references"), F.lit(0)).cast("bigint").alias("orphan_rows"),
            ).select(
                F.lit(name).alias("check_name"),
                "orphan_keys",
                "orphan_rows",
                F.when(F.col("orphan_keys") == 0, "PASS").otherwise("FAIL").alias("status"),
            )
        )
    return _union(rows)


def runtime_overrun(extents: DataFrame, last: str, expected: str, buffer: float = 10.0) -> DataFrame:
    """Series that run past their expected length plus a buffer."""
    over = F.col(last) - F.col(expected)
    return (
        extents.withColumn("overrun_minutes", over)
        .withColumn("buffer_minutes", F.lit(float(buffer)))
        .withColumn(
            "validation_status",
            F.when(F.col(expected).isNull(), "UNKNOWN").when(over <= buffer, "PASS").otherwise("FAIL"),
        )
        .withColumn(
            "data_quality_score",
            F.when(
                F.col(expected).isNull(), F.lit(100.0)
            ).otherwise(
                F.least(
                    F.lit(100.0),
                    F.lit(100.0)
                    * (
                        1
                        - F.try_divide(
                            F.greatest(F.lit(0.0), F.col("overrun_minutes").cast("double")), F.col(expected).cast("double")
                        )
                    ),
                )
            ),
        )
        .withColumn("is_within_buffer", over <= buffer)
        .withColumn("requires_investigation", over > 8.0)
    )


def overrun_severity(over: str | Column = "overrun_minutes") -> Column:
    x = F.col(over) if isinstance(over, str) else over
    return (
        F.when(x > 50, "CRITICAL (>50 min overrun)")
        .when(x > 20, "SEVERE (20-50 min overrun)")
        .when(x > 10, "MODERATE (10-20 min overrun)")
        .otherwise("MINOR (<10 min overrun)")
    )


def with_summary_row(df: DataFrame, key: str, status: str = "validation_status") -> DataFrame:
    """The rows plus one summary row with the counts by status."""
    counts = df.agg(
        F.count(F.lit(1)).alias("total_combinations"),
        F.count(F.when(F.col(status) == "PASS", 1)).alias("pass_count"),
        F.count(F.when(F.col(status) == "FAIL", 1)).alias("fail_count"),
        (
            F.try_divide(
                F.count(F.when(F.col(status) == "PASS", 1)).cast("double"), F.count(F.lit(1)).cast("double")
            )
            * 100
        ).alias("pass_rate_pct"),
    ).withColumn(key, F.lit("_SUMMARY_"))
    return df.unionByName(counts, allowMissingColumns=True)


def overrun_audit(
    extents: DataFrame, durations: DataFrame, keys: list[str], last: str, duration: str
) -> DataFrame:
    """Overrun of a series against its source's length: PASS, WARN, FAIL or MISSING."""
    over = F.col(last) - F.col(duration)
    return (
        extents.join(durations, keys, "left")
        .withColumn("overrun_minutes", over)
        .withColumn(
            "classification",
            F.when(over.isNull(), "MISSING").when(over <= 1.0, "PASS").when(over <= 5.0, "WARN").otherwise("FAIL"),
        )
    )


def audit_statistics(audit: DataFrame) -> DataFrame:
    """Totals of an overrun audit; the pass rate leaves out MISSING."""

    def n(label: str) -> Column:
        return F.count(F.when(F.col("classification") == label, 1))

    def mean(label: str) -> Column:
        return F.coalesce(
            F.avg(F.when(F.col("classification") == label, F.col("overrun_minutes"))), F.lit(0.0)
        ).cast("double")

    one = audit.agg(
        F.count(F.lit(1)).alias("total"),
        n("PASS").alias("pass_count"),
        n("WARN").alias("warn_count"),
        n("FAIL").alias("fail_count"),
        n("MISSING").alias("missing_count"),
        mean("FAIL").alias("avg_fail_overrun"),
        mean("WARN").alias("avg_warn_overrun"),
    )
    valid = (F.col("total") - F.col("missing_count")).cast("double")
    return one.withColumn(
        "pass_rate", F.coalesce(F.try_divide(F.col("pass_count").cast("double"), valid) * 100, F.lit(0.0))
    ).withColumn("reprocess_count", F.col("warn_count") + F.col("fail_count"))


def _drift(value: Column, reference: Column) -> Column:
    return F.try_divide(F.abs(value - reference), reference) * 100


def drift_status(drift: Column, warn: float, fail: float, missing: str = "FAIL") -> Column:
    return (
        F.when(drift.isNull(), F.lit(missing)).when(drift > fail, F.lit("FAIL")).when(drift > warn, F.lit("WARN")).otherwise(F.lit("PASS"))
    )


def timing_profile(
    lines: DataFrame, keys: list[str], start: str, end: str, gap: float = 120.0,
    chunk_width: float | None = None, tie: str | None = None,
) -> DataFrame:
    """Covered time, last end, negative starts and long pauses per document."""
    order = F.struct(start, *([tie] if tie else []), end)
    spans = lines.groupBy(*keys).agg(
        (F.max(end) - F.min(start)).alias("duration"),
        F.max_by(end, order).alias("last_end"),
        F.max(end).alias("max_end"),
        F.count(F.when(F.col(start) < 0, 1)).alias("negative_starts"),
    )
    return spans.join(gaps(lines, keys, start, end, gap, chunk_width, tie), keys)


def timing_drift(
    documents: DataFrame,
    reference: DataFrame,
    keys: list[str],
    runtime: str,
    warn: float = 2.0,
    fail: float = 5.0,
    edge: float = 120.0,
    empty: str = "line_count",
) -> DataFrame:
    """Documents against their documented length: status, drift, issues and warnings.

    ``documents`` comes from :func:`timing_profile`; a document without lines has NULL
    or 0 there. A document without a documented length fails.
    """
    joined = documents.join(reference.select(*keys, F.col(runtime).cast("double").alias("_runtime")), keys, "left")
    ref, dur, last = F.col("_runtime"), F.col("duration"), F.col("last_end")
    known = ref.isNotNull() & (F.coalesce(F.col(empty), F.lit(0)) > 0)
    drift = _drift(dur, ref)
    rest = ref - last
    base = drift_status(drift, warn, fail)
    status = (
        F.when(~known, "FAIL")
        .when((base == "PASS") & (rest > edge), "WARN")
        .when((base != "FAIL") & (rest < -edge), "WARN")
        .otherwise(base)
    )
    number = text.fixed
    span = F.concat(F.lit("(subtitle: "), number(dur, 1), F.lit("s, film: "), number(ref, 0), F.lit("s)"))
    issues = F.array(
        F.when(ref.isNull(), "No documented length"),
        F.when(ref.isNotNull() & ~known, "No subtitles found in file"),
        F.when(known & (drift > fail), F.concat(F.lit("Critical timing drift: "), number(drift, 2), F.lit("% "), span)),
    )
    warnings = F.array(
        F.when(known & (drift > warn) & (drift <= fail), F.concat(F.lit("Timing drift: "), number(drift, 2), F.lit("% "), span)),
        F.when(
            known & (rest > edge),
            F.concat(
                F.lit("Last subtitle ends "), number(rest, 1), F.lit("s ("), number(rest / 60, 1),
                F.lit(" min) before film end (missing final scenes?)"),
            ),
        ),
        F.when(
            known & (rest < -edge),
            F.concat(F.lit("Last subtitle extends "), number(F.abs(rest), 1), F.lit("s past documented film end")),
        ),
        F.when(
            known & (F.col("negative_starts") > 0),
            F.concat(F.lit("Found "), F.col("negative_starts"), F.lit(" subtitles with negative timestamps")),
        ),
        F.when(
            known & (F.col("gap_count") > 0),
            F.concat(
                F.lit("Found "), F.col("gap_count"), F.lit(" gaps >2 minutes between subtitles (largest: "),
                number(F.col("largest_gap"), 1), F.lit("s)"),
            ),
        ),
    )
    present = lambda a: F.filter(a, lambda x: x.isNotNull())
    return joined.select(
        *keys,
        status.alias("status"),
        F.when(known, F.round(drift, 2)).alias("timing_drift_percent"),
        F.when(known, F.round(last, 2)).alias("last_subtitle_time"),
        ref.alias("documented_runtime"),
        F.when(ref.isNotNull(), F.round(dur, 2)).alias("subtitle_duration"),
        present(issues).alias("issues"),
        present(warnings).alias("warnings"),
    )


def quick_drift(
    documents: DataFrame, reference: DataFrame, keys: list[str], value: str, runtime: str,
    warn: float, fail: float, missing: str,
) -> DataFrame:
    """Drift of one measured length with its own bands and missing status."""
    ref = reference.select(*keys, F.col(runtime).cast("double").alias("_runtime"))
    joined = documents.join(ref, keys, "left")
    measured = F.when(F.col(value) != 0, F.col(value))
    drift = _drift(measured, F.col("_runtime"))
    return joined.select(
        *keys, F.round(drift, 2).alias("timing_drift_percent"), drift_status(drift, warn, fail, missing).alias("status")
    )


def cross_group_drift(df: DataFrame, keys: list[str], member: str, duration: str, fail: float = 3.0, digits: int | None = 2) -> DataFrame:
    """Largest relative deviation of a member's length from the mean of its group.

    Mean, minimum and maximum are enough: the largest deviation belongs to one of the
    two extremes. Nothing is collected and no window is needed.
    """
    stats = df.filter(F.col(duration).isNotNull()).groupBy(*keys).agg(
        F.avg(duration).alias("_mean"),
        F.min(duration).alias("_low"),
        F.max(duration).alias("_high"),
        F.min_by(member, F.struct(F.col(duration), F.col(member))).alias("_low_member"),
        F.max_by(member, F.struct(F.col(duration), F.col(member))).alias("_high_member"),
        F.count(F.lit(1)).alias("members"),
    )
    down = F.try_divide(F.col("_mean") - F.col("_low"), F.col("_mean")) * 100
    up = F.try_divide(F.col("_high") - F.col("_mean"), F.col("_mean")) * 100
    worst = F.greatest(down, up)
    single = F.col("members") == 1
    return stats.select(
        *keys,
        "members",
        F.when(single, "PASS").when(worst > fail, "FAIL").otherwise("PASS").alias("status"),
        F.when(single, F.lit(0.0)).otherwise(worst if digits is None else F.round(worst, digits)).alias("max_drift_percent"),
        F.when(~single & (worst > fail), F.when(up > down, F.col("_high_member")).otherwise(F.col("_low_member"))).alias("worst_member"),
        F.when(single, F.lit("Only one member available")).alias("warning"),
    )


def range_null_check(df: DataFrame, dims: list[str], count: str, expected_dims: int | None = None) -> DataFrame:
    """Rows with values outside [0, 1] or NULL, dimensions present, share of rows with lines."""
    one = df.agg(
        F.count(F.when(fd.out_of_range(dims), 1)).alias("invalid_count"),
        F.count(F.when(fd.any_null(dims), 1)).alias("null_count"),
        F.count(F.lit(1)).alias("total_records"),
        F.count(F.when(F.col(count) > 0, 1)).alias("valid_records"),
    )
    present = len([d for d in dims if d in df.columns])
    return one.select(
        "*",
        (F.col("invalid_count") == 0).alias("range_passed"),
        (F.col("null_count") == 0).alias("null_passed"),
        F.lit(present).cast("bigint").alias("present_count"),
        F.lit(present == (expected_dims or len(dims))).alias("dimensions_passed"),
        F.coalesce(
            F.try_divide(F.col("valid_records").cast("double"), F.col("total_records").cast("double")) * 100, F.lit(0.0)
        ).alias("completeness_pct"),
    )


def dimension_ranges(df: DataFrame, dims: list[str]) -> DataFrame:
    """Minimum, maximum and mean of every dimension."""
    one = df.agg(*[F.struct(F.min(d).alias("min"), F.max(d).alias("max"), F.avg(d).alias("mean")).alias(d) for d in dims])
    rows = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("s")) for d in dims])).alias("_r")
    return one.select(rows).select(
        F.col("_r.dimension").alias("dimension"), F.col("_r.s.min").alias("min"), F.col("_r.s.max").alias("max"),
        F.col("_r.s.mean").alias("mean"),
        ((F.col("_r.s.min") >= 0) & (F.col("_r.s.max") <= 1)).alias("in_range"),
    )


def line_count_match(lines: DataFrame, series: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Input lines against the lines accounted for in the series, per document."""
    a = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("input_lines"))
    s = series.groupBy(*keys).agg(F.sum(count).cast("bigint").alias("series_lines"))
    joined = a.join(s, keys, "full")
    return joined.select(
        *keys,
        F.coalesce("input_lines", F.lit(0)).alias("input_lines"),
        F.coalesce("series_lines", F.lit(0)).alias("series_lines"),
    ).withColumn("matches", F.col("input_lines") == F.col("series_lines"))


def duration_gate(extents: DataFrame, last: str, expected: str, label: str, buffer: float = 10.0) -> DataFrame:
    """The rows unchanged; reading a row that overruns its length raises an error."""
    bad = F.col(last) > F.col(expected) + buffer
    message = F.concat(F.lit("series runs past its source: "), F.col(label).cast("string"))
    return extents.filter(F.when(bad, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))


def format_check(files: DataFrame, content: str) -> DataFrame:
    """Format errors of timed-text files, with the number of entries found.

    A fold over the lines of each file keeps the state of a small reader (seek an
    entry, expect its timing, expect its text, skip the rest), all inside the JVM.
    """
    ids = [c for c in files.columns if c != content]
    lines = F.transform(F.split(content, "\n"), lambda x: F.trim(F.regexp_replace(x, text.WHITESPACE, " ")))
    numbered = F.transform(lines, lambda x, i: F.struct(x.alias("t"), (i + 1).alias("n")))
    start = F.struct(
        F.lit("seek").alias("at"),
        F.lit(1).cast("bigint").alias("expected"),
        F.lit(0).cast("bigint").alias("entries"),
        F.lit("").alias("number"),
        F.lit(0).alias("line"),
        F.array().cast("array<string>").alias("errors"),
    )

    def prefix(n: Column) -> Column:
        return F.concat(F.lit("Line "), n.cast("string"), F.lit(": "))

    def step(s: Column, x: Column) -> Column:
        line, n, at = x["t"], x["n"], s["at"]
        blank = line == ""
        opens = (at == "seek") & line.rlike(NUMBER_LINE)
        value = F.when(opens, line.try_cast("bigint"))
        wrong = opens & ~value.eqNullSafe(s["expected"])
        bad_time = (at == "time") & ~line.rlike(TIMING_LINE)
        no_text = (at == "text") & blank
        found = F.array(
            F.when(
                wrong,
                F.concat(
                    prefix(n), F.lit("Non-sequential subtitle number. Expected "), s["expected"].cast("string"),
                    F.lit(", got "), F.regexp_replace(line, r"^0+(?=\d)", ""),
                ),
            ),
            F.when(bad_time, F.concat(prefix(n), F.lit("Invalid timestamp format: '"), line, F.lit("'"))),
            F.when(no_text, F.concat(prefix(s["line"]), F.lit("Subtitle "), s["number"], F.lit(" has no text content"))),
        )
        return F.struct(
            F.when(opens, "time")
            .when(at == "time", "text")
            .when((at == "text") & ~blank, "skip")
            .when((at == "skip") & ~blank, "skip")
            .otherwise("seek")
            .alias("at"),
            F.when(opens, s["expected"] + 1).otherwise(s["expected"]).alias("expected"),
            F.when(opens, s["entries"] + 1).otherwise(s["entries"]).alias("entries"),
            F.when(opens, F.regexp_replace(line, r"^0+(?=\d)", "")).otherwise(s["number"]).alias("number"),
            F.when(opens, n).otherwise(s["line"]).alias("line"),
            F.concat(s["errors"], F.filter(found, lambda e: e.isNotNull())).alias("errors"),
        )

    def finish(s: Column) -> Column:
        tail = F.when(
            s["at"] == "time", F.concat(prefix(s["line"]), F.lit("Subtitle "), s["number"], F.lit(" missing timestamp"))
        ).when(
            s["at"] == "text", F.concat(prefix(s["line"]), F.lit("Subtitle "), s["number"], F.lit(" has no text content"))
        )
        errors = F.when(tail.isNull(), s["errors"]).otherwise(F.concat(s["errors"], F.array(tail)))
        return F.struct(s["entries"].alias("entries"), errors.alias("errors"))

    checked = files.withColumn("_r", F.aggregate(numbered, start, step, finish))
    return checked.select(
        *ids,
        (F.size("_r.errors") == 0).alias("valid"),
        F.col("_r.errors").alias("errors"),
        F.col("_r.entries").alias("entry_count"),
    )


def text_stats(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Entries, words without tags and covered minutes per timed-text document."""
    return entries.groupBy(*keys).agg(
        F.count("subtitle_index").alias("entry_count"),
        F.sum(F.size(text.words("dialogue_text"))).cast("bigint").alias("word_count"),
        F.round(
            F.coalesce(
                F.max_by("first_time", F.when(F.col("first_time").isNotNull(), F.col("position")))
                - F.min_by("first_time", F.when(F.col("first_time").isNotNull(), F.col("position"))),
                F.lit(0.0),
            )
            / 60.0,
            1,
        ).alias("time_span_minutes"),
    )


def compare_entries(
    original: DataFrame, stored: DataFrame, keys: list[str], tolerance: float = 0.1
) -> DataFrame:
    """Field by field comparison of stored entries with freshly parsed ones, all rows."""
    a = original.select(*keys, F.col("start_time").alias("_s"), text.clean_text("dialogue_text").alias("_t"))
    joined = stored.join(a, keys, "left")
    index = F.col("_s").isNotNull()
    time = F.coalesce(F.abs(F.col("_s") - F.col("start_time")) < tolerance, F.lit(False))
    words = F.coalesce(F.col("_t") == F.col("dialogue_text"), F.lit(False))
    return joined.select(
        *keys, index.alias("index_match"), time.alias("time_match"), words.alias("text_match"), (index & time & words).alias("passed")
    )


def uuid_check(df: DataFrame, ident: str, title: str) -> DataFrame:
    """Rows without id or title, or with an id that is no UUID."""
    problem = (
        F.when(F.coalesce(F.col(ident), F.lit("")) == "", "missing id")
        .when(F.coalesce(F.col(title), F.lit("")) == "", "missing title")
        .when(~F.lower(F.col(ident)).rlike(text.UUID_PATTERN), "invalid UUID")
    )
    return df.withColumn("problem", problem).filter(F.col("problem").isNotNull())


# --- declarative rules --------------------------------------------------------


def failing(rule: dict) -> Column | None:
    """When a row fails a row rule; None for rules that look at several rows."""
    if rule["kind"] == "not_null":
        return F.col(rule["column"]).isNull()
    if rule["kind"] == "accepted_values":
        c = F.col(rule["column"])
        return c.isNotNull() & ~c.isin(rule["values"])
    if rule["kind"] == "expression":
        return ~F.coalesce(rule["condition"], F.lit(False))
    return None


def rule_failures(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Number of failing rows per rule.

    A rule is a dict with ``name`` and ``kind``: ``not_null`` (column),
    ``accepted_values`` (column, values), ``expression`` (condition that must hold),
    ``unique`` (columns) or ``relationship`` (column, to, to_column). The row rules of a
    table share one pass; the others need one aggregation each.
    """
    row_rules, frames = [], []
    for rule in rules:
        kind, name = rule["kind"], rule["name"]
        bad = failing(rule)
        if bad is not None:
            row_rules.append((name, bad))
        elif kind == "unique":
            twice = duplicates(df.dropna(subset=rule["columns"]), [F.col(c) for c in rule["columns"]])
            frames.append(
                twice.agg(F.count(F.lit(1)).alias("failures")).select(F.lit(name).alias("rule"), "failures")
            )
        elif kind == "relationship":
            lost = orphans(df, rule["column"], rule["to"], rule["to_column"])
            frames.append(
                lost.agg(F.coalesce(F.sum("references"), F.lit(0)).cast("bigint").alias("failures")).select(
                    F.lit(name).alias("rule"), "failures"
                )
            )
        else:
            raise ValueError(f"unknown rule kind: {kind}")
    if row_rules:
        one = df.agg(*[F.count(F.when(bad, 1)).alias(f"r{i}") for i, (_, bad) in enumerate(row_rules)])
        rows = F.explode(
            F.array(
                *[
                    F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("failures"))
                    for i, (name, _) in enumerate(row_rules)
                ]
            )
        ).alias("_r")
        frames.insert(0, one.select(rows).select("_r.*"))
    return _union(frames).withColumn("status", F.when(F.col("failures") == 0, "PASS").otherwise("FAIL"))


def enforce(failures: DataFrame) -> DataFrame:
    """The rule results unchanged; reading a failed rule raises an error."""
    message = F.concat(F.lit("quality rule failed: "), F.col("rule"))
    return failures.filter(
        F.when(F.col("failures") > 0, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    )


def failing_rows(df: DataFrame, key: str, status: str = "validation_status") -> DataFrame:
    """Rows with status FAIL, without a summary row."""
    return df.filter((F.col(status) == "FAIL") & (F.col(key) != "_SUMMARY_"))


# --- summaries of validation results --------------------------------------------


def pass_rate_by_member(results: DataFrame, member: str, status: str) -> DataFrame:
    def n(label: str) -> Column:
        return F.count(F.when(F.upper(F.col(status)) == label, 1))

    return results.groupBy(member).agg(
        n("PASS").alias("pass"), n("WARN").alias("warn"), n("FAIL").alias("fail"), F.count(F.lit(1)).alias("total")
    )


def overall_stats(results: DataFrame, status: str, drift: str, keys: list[str] | None = None) -> DataFrame:
    """Counts, pass rate and mean drift; NULL drifts are skipped."""

    def n(label: str) -> Column:
        return F.count(F.when(F.upper(F.col(status)) == label, 1))

    return results.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("total_files"),
        n("PASS").alias("pass_count"),
        n("WARN").alias("warn_count"),
        n("FAIL").alias("fail_count"),
        F.coalesce(
            F.try_divide(n("PASS").cast("double"), F.count(F.lit(1)).cast("double")) * 100, F.lit(0.0)
        ).alias("pass_rate"),
        F.coalesce(F.avg(drift), F.lit(0.0)).alias("average_drift"),
    )


def consistency_rate(groups: DataFrame, status: str, drift: str, keys: list[str] | None = None) -> DataFrame:
    good = F.count(F.when(F.col(status) == "PASS", 1))
    return groups.groupBy(*(keys or [])).agg(
        good.alias("consistent"),
        (F.count(F.lit(1)) - good).alias("inconsistent"),
        F.coalesce(F.try_divide(good.cast("double"), F.count(F.lit(1)).cast("double")) * 100, F.lit(0.0)).alias(
            "consistency_rate"
        ),
        F.coalesce(F.avg(drift), F.lit(0.0)).alias("average_max_drift"),
    )


def compare_runs(
    baseline: DataFrame, new: DataFrame, status: str, drift: str, member: str, target: float = 75.0,
    digits: int = 5, drift_digits: int = 4,
) -> DataFrame:
    """Change of pass rate and mean drift from one run to another, overall and per member.

    Both runs go through one aggregation over (member, run) with the overall line as a rollup.
    Drifts are summed as whole numbers of ``drift_digits`` decimals and rates come from exact
    counts, so no figure depends on the order of rows; figures are rounded to ``digits``.
    """
    tagged = baseline.select(status, drift, member, F.lit(0).alias("_run")).unionByName(
        new.select(status, drift, member, F.lit(1).alias("_run"))
    )
    units = F.round(F.col(drift) * 10**drift_digits).cast("decimal(20,0)")

    def of(run: int, value: Column) -> Column:
        return F.when(F.col("_run") == run, value)

    sums = [F.grouping(member).alias("_all")]
    for run in (0, 1):
        sums += [
            F.count(of(run, F.lit(1))).alias(f"n{run}"),
            F.count(of(run, F.when(F.upper(F.col(status)) == "PASS", 1))).alias(f"p{run}"),
            F.count(of(run, units)).alias(f"m{run}"),
            F.coalesce(F.sum(of(run, units)), F.lit(0)).alias(f"s{run}"),
        ]
    out = tagged.rollup(member).agg(*sums)
    n, p, m, s = ([F.col(f"{c}{run}").cast("decimal(18,0)") for run in (0, 1)] for c in "npms")
    m = [F.greatest(x, F.lit(1).cast("decimal(18,0)")) for x in m]
    scale = F.lit(10**drift_digits).cast("decimal(9,0)")
    return out.select(
        F.when(F.col("_all") == 1, "_ALL_").otherwise(F.col(member)).alias(member),
        F.col("n0").alias("baseline_total"),
        F.col("n1").alias("new_total"),
        fs.half_up_ratio(p[0] * 100, n[0], digits).alias("baseline_pass_rate"),
        fs.half_up_ratio(p[1] * 100, n[1], digits).alias("new_pass_rate"),
        fs.half_up_ratio((p[1] * n[0] - p[0] * n[1]) * 100, n[0] * n[1], digits).alias("pass_rate_change"),
        fs.half_up_ratio(s[0] * m[1] - s[1] * m[0], m[0] * m[1] * scale, digits).alias("drift_reduction"),
        ((F.col("p1") * 100 >= F.col("n1") * target) & (F.col("n1") > 0)).alias("target_met"),
    )


# --- priorities and candidates ------------------------------------------------


def priority_score(
    results: DataFrame,
    entity: str,
    status: str,
    group_drift: DataFrame,
    drift: str,
    featured: DataFrame,
) -> DataFrame:
    """Score and class of every entity from pass rate, group drift and a featured list."""
    counts = results.groupBy(entity).agg(
        F.count(F.lit(1)).alias("total_members"),
        F.count(F.when(F.col(status) == "PASS", 1)).alias("passed"),
        F.count(F.when(F.col(status) == "WARN", 1)).alias("warned"),
    )
    rate = F.try_divide(F.col("passed").cast("double"), F.col("total_members").cast("double"))
    joined = (
        counts.withColumn("failed", F.col("total_members") - F.col("passed") - F.col("warned"))
        .withColumn("pass_rate", rate)
        .join(group_drift.select(entity, F.col(drift).alias("_drift")), entity, "left")
        .join(featured.select(entity, F.lit(True).alias("_featured")).distinct(), entity, "left")
    )
    is_featured = F.coalesce(F.col("_featured"), F.lit(False))
    score = (
        F.when(F.col("pass_rate") < 0.5, 40).when(F.col("pass_rate") < 0.7, 20).otherwise(0)
        + F.when(is_featured, 30).otherwise(0)
        + F.when(F.col("_drift") > 10, 30).when(F.col("_drift") > 5, 15).otherwise(0)
    ).cast("bigint")
    scored = joined.withColumn("priority_score", score)
    category = (
        F.when(F.col("priority_score") >= 50, "HIGH")
        .when((F.col("priority_score") >= 20) | (F.col("pass_rate") < 0.7), "MEDIUM")
        .otherwise("LOW")
    )
    return scored.withColumn("priority_category", category).withColumn("is_featured", is_featured).withColumnRenamed(
        "_drift", "group_drift"
    ).drop("_featured")


def target_score(
    targets: DataFrame,
    status: str,
    drift: str,
    group_drift: str,
    featured: str,
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """Score of every not-passed member, at most 100, with its reasons."""
    w = {
        "featured": 40, "fail": 30, "warn": 20,
        "drift_high": 15, "drift_medium": 10, "drift_high_at": 5.0, "drift_medium_at": 2.0,
        "group_high": 10, "group_medium": 5,
        **(weights or {}),
    }
    d = F.coalesce(F.col(drift), F.lit(0.0))
    g = F.coalesce(F.col(group_drift), F.lit(0.0))
    feat = F.coalesce(F.col(featured), F.lit(False))
    total = (
        F.when(feat, w["featured"]).otherwise(0)
        + F.when(F.col(status) == "FAIL", w["fail"]).when(F.col(status) == "WARN", w["warn"]).otherwise(0)
        + F.when(d > w["drift_high_at"], w["drift_high"]).when(d > w["drift_medium_at"], w["drift_medium"]).otherwise(0)
        + F.when(g > 10, w["group_high"]).when(g > 5, w["group_medium"]).otherwise(0)
    )
    one = lambda c: text.fixed(c, 1)
    reason = F.concat_ws(
        ", ",
        F.when(feat, "Featured film"),
        F.when(F.col(status).isin("FAIL", "WARN"), F.concat(F.col(status), F.lit(" status ("), one(d), F.lit("% drift)"))),
        F.when(g > 10, F.concat(F.lit("High cross-lang drift ("), one(g), F.lit("%)"))),
    )
    return (
        targets.filter(F.col(status) != "PASS")
        .withColumn("priority_score", F.least(F.lit(100), total).cast("bigint"))
        .withColumn("reason", reason)
    )


def refinement_tiers(
    first: DataFrame, second: DataFrame, keys: list[str], featured: str, group_drift: str
) -> DataFrame:
    """Members still failing or warned after a second version, scored and tiered.

    Both frames carry ``status`` and ``drift``; the second version overrides the first.
    """
    newer = second.select(*keys, F.col("status").alias("_s2"), F.col("drift").alias("_d2"), F.lit(True).alias("_v2"))
    joined = first.join(newer, keys, "left")
    is_new = F.coalesce(F.col("_v2"), F.lit(False))
    current = joined.withColumn("current_status", F.when(is_new, F.col("_s2")).otherwise(F.col("status"))).withColumn(
        "current_drift", F.when(is_new, F.col("_d2")).otherwise(F.col("drift"))
    )
    d = F.coalesce(F.col("current_drift"), F.lit(0.0))
    total = (
        F.when(F.coalesce(F.col(featured), F.lit(False)), 50).otherwise(0)
        + F.when(F.col("current_status") == "FAIL", 30).when(F.col("current_status") == "WARN", 20).otherwise(0)
        + F.when(is_new, 15).otherwise(0)
        + F.when(d > 20, 10).when(d > 10, 5).otherwise(0)
        + F.when(F.coalesce(F.col(group_drift), F.lit(0.0)) > 10, 5).otherwise(0)
    )
    scored = current.filter(F.col("current_status").isin("FAIL", "WARN")).withColumn(
        "priority_score", F.least(F.lit(100), total).cast("bigint")
    )
    tier = F.when(F.col("priority_score") >= 80, "tier1").when(F.col("priority_score") >= 60, "tier2").otherwise("tier3")
    return scored.select(
        *keys, "current_status", "current_drift", F.when(is_new, "v2").otherwise("v1").alias("version"), "priority_score",
        tier.alias("tier"),
    )


def best_candidate(
    candidates: DataFrame, keys: list[str], ident: str, popularity: str, penalised: str, bonus: int = 10000
) -> DataFrame:
    """Most popular candidate per key; unpenalised ones get a large bonus.

    Maximum by a struct: partial aggregation only, so a key with many candidates is
    no hot spot.
    """
    score = F.col(popularity) + F.when(F.coalesce(F.col(penalised), F.lit(False)), 0).otherwise(bonus)
    usable = candidates.filter(F.col(ident).isNotNull()).withColumn("score", score)
    rank = F.struct(F.col("score"), (-F.col(ident)).alias("i"))
    return usable.groupBy(*keys).agg(F.max_by(ident, rank).alias(ident), F.max("score").alias("score"))


def closest_candidate(
    candidates: DataFrame, keys: list[str], ident: str, value: str, target: str, tolerance: float
) -> DataFrame:
    """Candidate with the smallest drift from its target, and whether it is within tolerance."""
    usable = candidates.filter(F.col(value).isNotNull() & (F.col(value) != 0)).withColumn(
        "_drift", _drift(F.col(value), F.col(target))
    )
    return (
        usable.groupBy(*keys)
        .agg(F.min_by(ident, F.struct("_drift", ident)).alias(ident), F.min("_drift").alias("drift_percent"))
        .withColumn("within_tolerance", F.col("drift_percent") <= tolerance)
    )
