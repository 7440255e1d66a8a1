"""Quality, timing and priority queries, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import text
from strandline.operators import cleaning, quality, series
from strandline.plans import base as b
from strandline.plans.cleaning_queries import SQL_CLEAN, _SQL_WORDS, _quote
from strandline.session import scratch_path
from strandline.sources import readers

Q: dict = {}
SQL: dict[str, str] = {}
T = b.table

# --- table level -----------------------------------------------------------------
_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
Q["table_counts"] = lambda s, f: quality.table_counts({n: T(s, f, n) for n in _TABLES})
SQL["table_counts"] = " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS rows FROM {n}" for n in _TABLES)
_EXPECTED = {"region": (5, 5), "nation": (24, 24), "customer": (100, None), "supplier": (10**6, None), "labels": (1, None)}
Q["record_counts"] = lambda s, f: quality.record_counts({n: T(s, f, n) for n in _EXPECTED}, _EXPECTED)
SQL["record_counts"] = " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS actual, '{lo}{'+' if hi is None else ''}' AS expected, CASE WHEN count(*) {'>=' if hi is None else '='} {lo} THEN 'PASS' ELSE 'WARN' END AS status FROM {n}"
    for n, (lo, hi) in _EXPECTED.items()
)


def _holes(s, f):
    return T(s, f, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price")
    )


_SQL_HOLES = "h AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price FROM orders)"
Q["completeness"] = lambda s, f: b.rounded(
    quality.completeness({"orders": (_holes(s, f), ["o_orderkey", "price"]), "part": (T(s, f, "part"), ["p_partkey", "p_name"])}), ["completeness_pct"]
)
SQL["completeness"] = f"WITH {_SQL_HOLES}, x AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, '{c}' AS field, round(count({c}) / count(*) * 100, 6) AS completeness_pct FROM {src}"
    for n, src, c in [("orders", "h", "o_orderkey"), ("orders", "h", "price"), ("part", "part", "p_partkey"), ("part", "part", "p_name")]
) + ") SELECT *, CASE WHEN completeness_pct < 100 THEN 'WARN' ELSE 'PASS' END AS status FROM x"
Q["duplicates"] = lambda s, f: quality.duplicates(T(s, f, "part"), [F.lower("p_name").alias("title")])
SQL["duplicates"] = 'SELECT lower(p_name) AS title, count(*) AS "count" FROM part GROUP BY 1 HAVING count(*) > 1'
Q["duplicate_ids"] = lambda s, f: quality.duplicates(T(s, f, "conversations"), [F.col("conv_id").alias("id")])
SQL["duplicate_ids"] = 'SELECT conv_id AS id, count(*) AS "count" FROM conversations GROUP BY 1 HAVING count(*) > 1'
Q["referential_integrity"] = lambda s, f: quality.referential_integrity(
    [
        ("labels_documents", T(s, f, "labels"), "doc_id", T(s, f, "documents"), "doc_id"),
        ("orders_rich_customers", T(s, f, "orders"), "o_custkey", T(s, f, "customer").filter("c_acctbal > 5000"), "c_custkey"),
        ("lineitem_orders", T(s, f, "lineitem"), "l_orderkey", T(s, f, "orders"), "o_orderkey"),
    ]
)
SQL["referential_integrity"] = " UNION ALL ".join(
    f"""SELECT '{n}' AS check_name, count(DISTINCT {k}) AS orphan_keys, count(*) AS orphan_rows, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status
FROM {c} WHERE NOT EXISTS (SELECT 1 FROM {p} p WHERE p.{pk} = {c}.{k})"""
    for n, c, k, p, pk in [
        ("labels_documents", "labels", "doc_id", "documents", "doc_id"),
        ("orders_rich_customers", "orders", "o_custkey", "(SELECT * FROM customer WHERE c_acctbal > 5000)", "c_custkey"),
        ("lineitem_orders", "lineitem", "l_orderkey", "orders", "o_orderkey"),
    ]
)
_RULES = lambda s, f: [
    {"name": "key_not_null", "kind": "not_null", "column": "o_orderkey"},
    {"name": "price_not_null", "kind": "not_null", "column": "price"},
    {"name": "status_values", "kind": "accepted_values", "column": "o_orderstatus", "values": ["F", "O"]},
    {"name": "price_positive", "kind": "expression", "condition": F.col("price") > 1000},
    {"name": "key_unique", "kind": "unique", "columns": ["o_orderkey"]},
    {"name": "customer_unique", "kind": "unique", "columns": ["o_custkey"]},
    {"name": "customer_exists", "kind": "relationship", "column": "o_custkey", "to": T(s, f, "customer").filter("c_acctbal > 0"), "to_column": "c_custkey"},
]
Q["rule_failures"] = lambda s, f: quality.rule_failures(
    T(s, f, "orders").withColumn("price", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))), _RULES(s, f)
)
SQL["rule_failures"] = """WITH o AS (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price FROM orders), r AS (
SELECT 'key_not_null' AS rule, count(*) AS failures FROM o WHERE o_orderkey IS NULL UNION ALL SELECT 'price_not_null', count(*) FROM o WHERE price IS NULL
UNION ALL SELECT 'status_values', count(*) FROM o WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT 'price_positive', count(*) FROM o WHERE NOT coalesce(price > 1000, false)
UNION ALL SELECT 'key_unique', count(*) FROM (SELECT o_orderkey FROM o GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'customer_unique', count(*) FROM (SELECT o_custkey FROM o GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'customer_exists', count(*) FROM o WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))
SELECT *, CASE WHEN failures = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM r"""
Q["uuid_check"] = lambda s, f: quality.uuid_check(
    T(s, f, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", F.regexp_replace(F.md5(F.col("o_orderkey").cast("string")), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
        .when(F.col("o_orderstatus") == "O", F.md5(F.col("o_orderkey").cast("string"))).alias("id"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("title"),
    ),
    "id", "title",
).select("o_orderkey", "problem")
SQL["uuid_check"] = """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'missing id' WHEN o_orderpriority = '5-LOW' THEN 'missing title' ELSE 'invalid UUID' END AS problem
FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority = '5-LOW' OR o_orderstatus = 'O'"""
Q["range_null_check"] = lambda s, f: b.rounded(
    quality.range_null_check(
        b.ship_series(s, f).withColumn("tax", F.when(F.col("lines") > 1, F.col("tax"))).withColumn("price", F.col("price") * 1.2), b.SHIP_DIMS, "lines"
    ), ["completeness_pct"]
)
SQL["range_null_check"] = f"""WITH {b.SQL_SHIP_SERIES}, z AS (SELECT * REPLACE (CASE WHEN lines > 1 THEN tax END AS tax, price * 1.2 AS price) FROM ship_series),
a AS (SELECT count(CASE WHEN {" OR ".join(f"{d} < 0 OR {d} > 1" for d in b.SHIP_DIMS)} THEN 1 END) AS invalid_count, count(CASE WHEN {" OR ".join(f"{d} IS NULL" for d in b.SHIP_DIMS)} THEN 1 END) AS null_count,
count(*) AS total_records, count(CASE WHEN lines > 0 THEN 1 END) AS valid_records FROM z)
SELECT *, invalid_count = 0 AS range_passed, null_count = 0 AS null_passed, CAST(5 AS BIGINT) AS present_count, true AS dimensions_passed, round(valid_records / total_records * 100, 6) AS completeness_pct FROM a"""
Q["dimension_ranges"] = lambda s, f: b.rounded(quality.dimension_ranges(b.ship_series(s, f), b.SHIP_DIMS), ["min", "max", "mean"])
SQL["dimension_ranges"] = f"WITH {b.SQL_SHIP_SERIES} " + " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, round(min({d}), 6) AS min, round(max({d}), 6) AS max, round(avg({d}), 6) AS mean, min({d}) >= 0 AND max({d}) <= 1 AS in_range FROM ship_series" for d in b.SHIP_DIMS
)
Q["line_count_match"] = lambda s, f: quality.line_count_match(
    b.event_lines(s, f), b.event_series(s, f).filter(F.col("click") == 0), ["user_id"], "dialogue_count"
)
SQL["line_count_match"] = f"""WITH {b.SQL_EVENT_SERIES}, a AS (SELECT user_id, count(*) AS input_lines FROM event_lines GROUP BY 1),
z AS (SELECT user_id, CAST(sum(dialogue_count) AS BIGINT) AS series_lines FROM event_series WHERE click = 0 GROUP BY 1)
SELECT user_id, input_lines, coalesce(series_lines, 0) AS series_lines, input_lines = coalesce(series_lines, 0) AS matches FROM a FULL JOIN z USING (user_id)"""

# --- overruns -------------------------------------------------------------------


def _extents(s, f):
    ext = series.axis_extent(b.event_series(s, f), ["user_id"], "minute_offset").select("user_id", "max_minute")
    ref = T(s, f, "customer").filter("c_acctbal >= 0").select(
        F.col("c_custkey").alias("user_id"), (F.lit(650) + F.col("c_nationkey") * 4).cast("bigint").alias("expected")
    )
    return ext.join(ref, "user_id", "left")


_SQL_EXT = b.SQL_EVENT_SERIES + """,
ext AS (SELECT user_id, max(minute_offset) AS max_minute FROM event_series GROUP BY 1),
ref AS (SELECT c_custkey AS user_id, CAST(650 + c_nationkey * 4 AS BIGINT) AS expected FROM customer WHERE c_acctbal >= 0),
over AS (SELECT user_id, max_minute, expected, max_minute - expected AS overrun_minutes, 10.0::DOUBLE AS buffer_minutes,
  CASE WHEN expected IS NULL THEN 'UNKNOWN' WHEN max_minute - expected <= 10 THEN 'PASS' ELSE 'FAIL' END AS validation_status,
  round(least(100.0, 100.0 * (1 - greatest(0, max_minute - expected) / nullif(expected, 0))), 6) AS data_quality_score,
  max_minute - expected <= 10 AS is_within_buffer, max_minute - expected > 8 AS requires_investigation FROM ext LEFT JOIN ref USING (user_id))"""


def _overrun(s, f):
    return b.rounded(quality.runtime_overrun(_extents(s, f), "max_minute", "expected"), ["data_quality_score"])


Q["runtime_overrun"] = _overrun
SQL["runtime_overrun"] = f"WITH {_SQL_EXT} SELECT * FROM over"
Q["overrun_severity"] = lambda s, f: _overrun(s, f).filter("validation_status = 'FAIL'").select(
    "user_id", "overrun_minutes", (F.col("overrun_minutes") - F.col("buffer_minutes")).alias("beyond_buffer"), quality.overrun_severity().alias("severity")
)
SQL["overrun_severity"] = f"""WITH {_SQL_EXT} SELECT user_id, overrun_minutes, overrun_minutes - buffer_minutes AS beyond_buffer,
CASE WHEN overrun_minutes > 50 THEN 'CRITICAL (>50 min overrun)' WHEN overrun_minutes > 20 THEN 'SEVERE (20-50 min overrun)' WHEN overrun_minutes > 10 THEN 'MODERATE (10-20 min overrun)' ELSE 'MINOR (<10 min overrun)' END AS severity
FROM over WHERE validation_status = 'FAIL'"""
Q["with_summary_row"] = lambda s, f: b.rounded(
    quality.with_summary_row(_overrun(s, f).select(F.col("user_id").cast("string").alias("slug"), "overrun_minutes", "validation_status"), "slug"), ["pass_rate_pct"]
)
SQL["with_summary_row"] = f"""WITH {_SQL_EXT} SELECT CAST(user_id AS VARCHAR) AS slug, overrun_minutes, validation_status, NULL::BIGINT AS total_combinations, NULL::BIGINT AS pass_count, NULL::BIGINT AS fail_count, NULL::DOUBLE AS pass_rate_pct FROM over
UNION ALL SELECT '_SUMMARY_', NULL, NULL, count(*), count(CASE WHEN validation_status = 'PASS' THEN 1 END), count(CASE WHEN validation_status = 'FAIL' THEN 1 END),
round(count(CASE WHEN validation_status = 'PASS' THEN 1 END) / count(*) * 100, 6) FROM over"""
Q["failing_rows"] = lambda s, f: quality.failing_rows(
    quality.with_summary_row(_overrun(s, f).select(F.col("user_id").cast("string").alias("slug"), "overrun_minutes", "validation_status"), "slug"), "slug"
).select("slug", "overrun_minutes", "validation_status")
SQL["failing_rows"] = f"WITH {_SQL_EXT} SELECT CAST(user_id AS VARCHAR) AS slug, overrun_minutes, validation_status FROM over WHERE validation_status = 'FAIL'"
Q["duration_gate"] = lambda s, f: quality.duration_gate(
    _extents(s, f).withColumn("expected", F.coalesce(F.col("expected"), F.lit(0)) + 720), "max_minute", "expected", "user_id"
)
SQL["duration_gate"] = f"WITH {_SQL_EXT} SELECT user_id, max_minute, coalesce(expected, 0) + 720 AS expected FROM over"


def _audit(s, f):
    ext = _extents(s, f).select("user_id", "max_minute")
    dur = T(s, f, "customer").filter("c_acctbal >= 0").select(
        F.col("c_custkey").alias("user_id"), (F.lit(700.5) + F.col("c_nationkey")).alias("duration")
    )
    return quality.overrun_audit(ext, dur, ["user_id"], "max_minute", "duration")


_SQL_AUDIT = b.SQL_EVENT_SERIES + """,
ext AS (SELECT user_id, max(minute_offset) AS max_minute FROM event_series GROUP BY 1),
dur AS (SELECT c_custkey AS user_id, 700.5::DOUBLE + c_nationkey AS duration FROM customer WHERE c_acctbal >= 0),
au AS (SELECT user_id, max_minute, duration, max_minute - duration AS overrun_minutes, CASE WHEN duration IS NULL THEN 'MISSING' WHEN max_minute - duration <= 1 THEN 'PASS'
  WHEN max_minute - duration <= 5 THEN 'WARN' ELSE 'FAIL' END AS classification FROM ext LEFT JOIN dur USING (user_id))"""
Q["overrun_audit"] = _audit
SQL["overrun_audit"] = f"WITH {_SQL_AUDIT} SELECT * FROM au"
Q["audit_statistics"] = lambda s, f: b.rounded(quality.audit_statistics(_audit(s, f)), ["avg_fail_overrun", "avg_warn_overrun", "pass_rate"])
SQL["audit_statistics"] = f"""WITH {_SQL_AUDIT}, a AS (SELECT count(*) AS total, count(CASE WHEN classification = 'PASS' THEN 1 END) AS pass_count, count(CASE WHEN classification = 'WARN' THEN 1 END) AS warn_count,
count(CASE WHEN classification = 'FAIL' THEN 1 END) AS fail_count, count(CASE WHEN classification = 'MISSING' THEN 1 END) AS missing_count,
round(coalesce(avg(CASE WHEN classification = 'FAIL' THEN overrun_minutes END), 0), 6) AS avg_fail_overrun, round(coalesce(avg(CASE WHEN classification = 'WARN' THEN overrun_minutes END), 0), 6) AS avg_warn_overrun FROM au)
SELECT *, round(pass_count / (total - missing_count) * 100, 6) AS pass_rate, warn_count + fail_count AS reprocess_count FROM a"""

# --- timing --------------------------------------------------------------------


def _timed(s, f):
    return b.event_lines(s, f).select(
        "user_id", "event_id", "event_type", F.col("seconds").cast("double").alias("start"), (F.col("seconds") + F.col("value")).alias("end")
    )


def _runtimes(s, f):
    return T(s, f, "customer").filter("c_acctbal >= 0").select(
        F.col("c_custkey").alias("user_id"), (F.lit(2592000.0) * (F.lit(0.931) + F.col("c_nationkey") * 0.0031)).alias("runtime")
    )


_SQL_TIMED = b.SQL_EVENT_LINES + """,
timed AS (SELECT user_id, event_id, event_type, seconds::DOUBLE AS "start", seconds + value AS "end" FROM event_lines),
rt AS (SELECT c_custkey AS user_id, 2592000.0::DOUBLE * (0.931::DOUBLE + c_nationkey * 0.0031::DOUBLE) AS runtime FROM customer WHERE c_acctbal >= 0)"""
_SQL_PROFILE = _SQL_TIMED + """,
g AS (SELECT *, "start" - lag("end") OVER (PARTITION BY user_id ORDER BY "start", event_id) AS pause FROM timed),
prof AS (SELECT user_id, max("end") - min("start") AS duration, arg_max("end", {'a': "start", 'b': event_id}) AS last_end, max("end") AS max_end, count(CASE WHEN "start" < 0 THEN 1 END) AS negative_starts,
  count(CASE WHEN pause > 43200 THEN 1 END) AS gap_count, max(CASE WHEN pause > 43200 THEN pause END) AS largest_gap, count(*) AS line_count FROM g GROUP BY 1)"""
Q["timing_profile"] = lambda s, f: b.rounded(
    quality.timing_profile(_timed(s, f), ["user_id"], "start", "end", 43200.0, 86400.0, "event_id"), ["duration", "last_end", "max_end", "largest_gap"], 3
)
SQL["timing_profile"] = f"WITH {_SQL_PROFILE} SELECT user_id, {b.sql_rounded(['duration', 'last_end', 'max_end', 'largest_gap'], 3)}, negative_starts, gap_count, line_count FROM prof"


def timing_drift(s, f):
    profile = quality.timing_profile(_timed(s, f), ["user_id"], "start", "end", 43200.0, 86400.0, "event_id")
    out = quality.timing_drift(profile, _runtimes(s, f), ["user_id"], "runtime")
    return out.withColumn("documented_runtime", F.round("documented_runtime", 2)).withColumn(
        "warnings", F.size("warnings").cast("bigint")
    )


Q["timing_drift"] = timing_drift
SQL["timing_drift"] = f"""WITH {_SQL_PROFILE}, j AS (SELECT prof.*, runtime, abs(duration - runtime) / runtime * 100 AS drift, runtime - last_end AS rest FROM prof LEFT JOIN rt USING (user_id)),
k AS (SELECT *, CASE WHEN drift > 5 THEN 'FAIL' WHEN drift > 2 THEN 'WARN' ELSE 'PASS' END AS base FROM j)
SELECT user_id, CASE WHEN runtime IS NULL THEN 'FAIL' WHEN base = 'PASS' AND rest > 120 THEN 'WARN' WHEN base <> 'FAIL' AND rest < -120 THEN 'WARN' ELSE base END AS status,
  round(drift, 2) AS timing_drift_percent, CASE WHEN runtime IS NOT NULL THEN round(last_end, 2) END AS last_subtitle_time, round(runtime, 2) AS documented_runtime,
  CASE WHEN runtime IS NOT NULL THEN round(duration, 2) END AS subtitle_duration,
  list_filter([CASE WHEN runtime IS NULL THEN 'No documented length' END, CASE WHEN drift > 5 THEN printf('Critical timing drift: %.2f%% (subtitle: %.1fs, film: %.0fs)', drift, duration, runtime) END], lambda x: x IS NOT NULL) AS issues,
  CASE WHEN runtime IS NULL THEN 0 ELSE CAST((drift > 2 AND drift <= 5) AS BIGINT) + CAST(rest > 120 OR rest < -120 AS BIGINT) + CAST(gap_count > 0 AS BIGINT) END AS warnings FROM k"""
Q["quick_drift"] = lambda s, f: quality.quick_drift(
    _timed(s, f).groupBy("user_id").agg(F.max("end").alias("last")), _runtimes(s, f), ["user_id"], "last", "runtime", 5.0, 10.0, "FAIL"
)
SQL["quick_drift"] = f"""WITH {_SQL_TIMED}, d AS (SELECT user_id, abs(max("end") - any_value(runtime)) / any_value(runtime) * 100 AS drift FROM timed LEFT JOIN rt USING (user_id) GROUP BY 1)
SELECT user_id, round(drift, 2) AS timing_drift_percent, CASE WHEN drift IS NULL THEN 'FAIL' WHEN drift > 10 THEN 'FAIL' WHEN drift > 5 THEN 'WARN' ELSE 'PASS' END AS status FROM d"""
Q["drift_or_unknown"] = lambda s, f: quality.quick_drift(
    _timed(s, f).groupBy("user_id").agg((F.max("end") - F.min("start")).alias("covered")), _runtimes(s, f), ["user_id"], "covered", "runtime", 2.0, 5.0, "UNKNOWN"
)
SQL["drift_or_unknown"] = f"""WITH {_SQL_TIMED}, d AS (SELECT user_id, abs(max("end") - min("start") - any_value(runtime)) / any_value(runtime) * 100 AS drift FROM timed LEFT JOIN rt USING (user_id) GROUP BY 1)
SELECT user_id, round(drift, 2) AS timing_drift_percent, CASE WHEN drift IS NULL THEN 'UNKNOWN' WHEN drift > 5 THEN 'FAIL' WHEN drift > 2 THEN 'WARN' ELSE 'PASS' END AS status FROM d"""


def _durations(s, f):
    return _timed(s, f).groupBy("user_id", "event_type").agg((F.max("end") - F.min("start")).alias("duration"))


_SQL_DURS = _SQL_TIMED + """, durs AS (SELECT user_id, event_type, max("end") - min("start") AS duration FROM timed GROUP BY ALL)"""
Q["cross_group_drift"] = lambda s, f: quality.cross_group_drift(_durations(s, f), ["user_id"], "event_type", "duration")
_SQL_GROUP = _SQL_DURS + """, gd AS (SELECT user_id, avg(duration) AS m, count(*) AS members FROM durs GROUP BY 1),
dv AS (SELECT durs.user_id, event_type, members, duration, abs(duration - m) / m * 100 AS d FROM durs JOIN gd USING (user_id)),
grp AS (SELECT user_id, any_value(members) AS members, max(d) AS worst, arg_max(event_type, d) AS who FROM dv GROUP BY 1)"""
SQL["cross_group_drift"] = f"""WITH {_SQL_GROUP} SELECT user_id, members, CASE WHEN members = 1 THEN 'PASS' WHEN worst > 3 THEN 'FAIL' ELSE 'PASS' END AS status,
CASE WHEN members = 1 THEN 0.0 ELSE round(worst, 2) END AS max_drift_percent, CASE WHEN members > 1 AND worst > 3 THEN who END AS worst_member,
CASE WHEN members = 1 THEN 'Only one member available' END AS warning FROM grp"""


def _results(s, f, scale=1.0):
    joined = _durations(s, f).join(_runtimes(s, f), "user_id", "left")
    drift = F.abs(F.col("duration") - F.col("runtime") * scale) / (F.col("runtime") * scale) * 100
    return joined.select(
        "user_id", "event_type", "duration", F.round(drift, 4).alias("drift"), quality.drift_status(drift, 5, 10).alias("status")
    )


def _sql_results(name: str, scale: str) -> str:
    return f"""{name} AS (SELECT user_id, event_type, duration, round(d, 4) AS drift, CASE WHEN d IS NULL OR d > 10 THEN 'FAIL' WHEN d > 5 THEN 'WARN' ELSE 'PASS' END AS status
FROM (SELECT durs.*, abs(duration - runtime * {scale}) / (runtime * {scale}) * 100 AS d FROM durs LEFT JOIN rt USING (user_id)))"""


_SQL_RES = _SQL_DURS + ", " + _sql_results("res", "1.0::DOUBLE")
_P = "count(CASE WHEN status = 'PASS' THEN 1 END)"
Q["pass_rate_by_language"] = lambda s, f: quality.pass_rate_by_member(_results(s, f), "event_type", "status")
SQL["pass_rate_by_language"] = f"""WITH {_SQL_RES} SELECT event_type, {_P} AS pass, count(CASE WHEN status = 'WARN' THEN 1 END) AS warn, count(CASE WHEN status = 'FAIL' THEN 1 END) AS fail, count(*) AS total FROM res GROUP BY 1"""
Q["overall_stats"] = lambda s, f: b.rounded(quality.overall_stats(_results(s, f), "status", "drift"), ["pass_rate", "average_drift"])
SQL["overall_stats"] = f"""WITH {_SQL_RES} SELECT count(*) AS total_files, {_P} AS pass_count, count(CASE WHEN status = 'WARN' THEN 1 END) AS warn_count, count(CASE WHEN status = 'FAIL' THEN 1 END) AS fail_count,
round({_P} / count(*) * 100, 6) AS pass_rate, round(avg(drift), 6) AS average_drift FROM res"""
Q["consistency_rate"] = lambda s, f: b.rounded(
    quality.consistency_rate(quality.cross_group_drift(_durations(s, f), ["user_id"], "event_type", "duration", 10.0), "status", "max_drift_percent"),
    ["consistency_rate", "average_max_drift"], 4,
)
SQL["consistency_rate"] = f"""WITH {_SQL_GROUP}, st AS (SELECT CASE WHEN members > 1 AND worst > 10 THEN 'FAIL' ELSE 'PASS' END AS status, CASE WHEN members = 1 THEN 0.0 ELSE round(worst, 2) END AS md FROM grp)
SELECT {_P} AS consistent, count(*) - {_P} AS inconsistent, round({_P} / count(*) * 100, 4) AS consistency_rate, round(avg(md), 4) AS average_max_drift FROM st"""
Q["compare_runs"] = lambda s, f: quality.compare_runs(_results(s, f), _results(s, f, 0.97), "status", "drift", "event_type")


def _sql_half_up(num: str, den: str, digits: int = 5) -> str:
    return f"sign({num}) * ((abs(({num})::HUGEINT) * {2 * 10**digits} + ({den})) // (2 * ({den}))) / {10**digits}.0::DOUBLE"


SQL["compare_runs"] = f"""WITH {_SQL_DURS}, {_sql_results("res", "1.0::DOUBLE")}, {_sql_results("nres", "0.97::DOUBLE")},
u AS (SELECT *, CAST(round(drift * 10000) AS BIGINT) AS d, 0 AS run FROM res UNION ALL SELECT *, CAST(round(drift * 10000) AS BIGINT), 1 FROM nres),
v AS (SELECT CASE WHEN grouping(event_type) = 1 THEN '_ALL_' ELSE event_type END AS event_type, {", ".join(f"count(CASE WHEN run = {r} THEN 1 END) AS n{r}, count(CASE WHEN run = {r} AND status = 'PASS' THEN 1 END) AS p{r}, count(CASE WHEN run = {r} THEN d END) AS m{r}, sum(CASE WHEN run = {r} THEN d END) AS s{r}" for r in (0, 1))}
FROM u GROUP BY ROLLUP (event_type))
SELECT event_type, n0 AS baseline_total, n1 AS new_total, {_sql_half_up("100 * p0", "n0")} AS baseline_pass_rate, {_sql_half_up("100 * p1", "n1")} AS new_pass_rate,
{_sql_half_up("100 * (p1 * n0 - p0 * n1)", "n0 * n1")} AS pass_rate_change, {_sql_half_up("s0 * m1 - s1 * m0", "m0 * m1 * 10000")} AS drift_reduction, 100 * p1 >= 75 * n1 AS target_met FROM v"""


def _featured(s, f):
    return T(s, f, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))


_SQL_FEAT = "feat AS (SELECT c_custkey AS user_id FROM customer WHERE c_mktsegment = 'BUILDING')"
Q["priority_score"] = lambda s, f: b.rounded(
    quality.priority_score(
        _results(s, f), "user_id", "status", quality.cross_group_drift(_durations(s, f), ["user_id"], "event_type", "duration"), "max_drift_percent", _featured(s, f)
    ), ["pass_rate"]
)
SQL["priority_score"] = f"""WITH {_SQL_GROUP}, {_sql_results("res", "1.0::DOUBLE")}, {_SQL_FEAT},
c AS (SELECT user_id, count(*) AS total_members, {_P} AS passed, count(CASE WHEN status = 'WARN' THEN 1 END) AS warned FROM res GROUP BY 1),
x AS (SELECT c.*, total_members - passed - warned AS failed, passed / total_members AS pr, round(worst, 2) AS group_drift, feat.user_id IS NOT NULL AS is_featured FROM c LEFT JOIN grp USING (user_id) LEFT JOIN feat USING (user_id)),
y AS (SELECT *, CASE WHEN pr < 0.5 THEN 40 WHEN pr < 0.7 THEN 20 ELSE 0 END + CASE WHEN is_featured THEN 30 ELSE 0 END + CASE WHEN group_drift > 10 THEN 30 WHEN group_drift > 5 THEN 15 ELSE 0 END AS sc FROM x)
SELECT user_id, total_members, passed, warned, failed, round(pr, 6) AS pass_rate, group_drift, is_featured, CAST(sc AS BIGINT) AS priority_score,
  CASE WHEN sc >= 50 THEN 'HIGH' WHEN sc >= 20 OR pr < 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS priority_category FROM y"""


def _targets(s, f):
    drift = quality.cross_group_drift(_durations(s, f), ["user_id"], "event_type", "duration", digits=None).select("user_id", F.col("max_drift_percent").alias("group_drift"))
    return _results(s, f).join(drift, "user_id", "left").join(_featured(s, f).withColumn("featured", F.lit(True)), "user_id", "left")


_SQL_TARGETS = f"""{_SQL_GROUP}, {_sql_results("res", "1.0::DOUBLE")}, {_SQL_FEAT},
tg AS (SELECT res.*, worst AS group_drift, feat.user_id IS NOT NULL AS featured FROM res LEFT JOIN grp USING (user_id) LEFT JOIN feat USING (user_id))"""
Q["target_score"] = lambda s, f: quality.target_score(_targets(s, f), "status", "drift", "group_drift", "featured").select(
    "user_id", "event_type", "status", "priority_score", "reason"
)
SQL["target_score"] = f"""WITH {_SQL_TARGETS} SELECT user_id, event_type, status, CAST(least(100, CASE WHEN featured THEN 40 ELSE 0 END + CASE status WHEN 'FAIL' THEN 30 WHEN 'WARN' THEN 20 ELSE 0 END
+ CASE WHEN coalesce(drift, 0) > 5 THEN 15 WHEN coalesce(drift, 0) > 2 THEN 10 ELSE 0 END + CASE WHEN group_drift > 10 THEN 10 WHEN group_drift > 5 THEN 5 ELSE 0 END) AS BIGINT) AS priority_score,
concat_ws(', ', CASE WHEN featured THEN 'Featured film' END, status || ' status (' || printf('%.1f', coalesce(drift, 0)) || '% drift)', CASE WHEN group_drift > 10 THEN 'High cross-lang drift (' || printf('%.1f', group_drift) || '%)' END) AS reason
FROM tg WHERE status <> 'PASS'"""
Q["refinement_tiers"] = lambda s, f: quality.refinement_tiers(
    _targets(s, f), _results(s, f, 0.97).filter(F.col("event_type").isin("click", "view")).select("user_id", "event_type", "status", "drift"),
    ["user_id", "event_type"], "featured", "group_drift",
)
SQL["refinement_tiers"] = f"""WITH {_SQL_TARGETS}, {_sql_results("nres", "0.97::DOUBLE")}, n2 AS (SELECT * FROM nres WHERE event_type IN ('click', 'view')),
c AS (SELECT tg.user_id, tg.event_type, featured, group_drift, n2.user_id IS NOT NULL AS v2, CASE WHEN n2.user_id IS NOT NULL THEN n2.status ELSE tg.status END AS current_status,
  CASE WHEN n2.user_id IS NOT NULL THEN n2.drift ELSE tg.drift END AS current_drift FROM tg LEFT JOIN n2 USING (user_id, event_type)),
p AS (SELECT *, least(100, CASE WHEN featured THEN 50 ELSE 0 END + CASE current_status WHEN 'FAIL' THEN 30 WHEN 'WARN' THEN 20 ELSE 0 END + CASE WHEN v2 THEN 15 ELSE 0 END
  + CASE WHEN coalesce(current_drift, 0) > 20 THEN 10 WHEN coalesce(current_drift, 0) > 10 THEN 5 ELSE 0 END + CASE WHEN group_drift > 10 THEN 5 ELSE 0 END) AS sc FROM c WHERE current_status IN ('FAIL', 'WARN'))
SELECT user_id, event_type, current_status, current_drift, CASE WHEN v2 THEN 'v2' ELSE 'v1' END AS version, CAST(sc AS BIGINT) AS priority_score,
  CASE WHEN sc >= 80 THEN 'tier1' WHEN sc >= 60 THEN 'tier2' ELSE 'tier3' END AS tier FROM p"""
Q["best_candidate"] = lambda s, f: quality.best_candidate(
    T(s, f, "orders").select("o_custkey", "o_orderkey", F.floor("o_totalprice").cast("bigint").alias("downloads"), (F.col("o_orderstatus") == "P").alias("impaired")),
    ["o_custkey"], "o_orderkey", "downloads", "impaired", 100000,
)
SQL["best_candidate"] = """WITH c AS (SELECT o_custkey, o_orderkey, CAST(floor(o_totalprice) AS BIGINT) + CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 100000 END AS score FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey) AS rn FROM c) SELECT o_custkey, o_orderkey, score FROM r WHERE rn = 1"""
Q["closest_candidate"] = lambda s, f: b.rounded(
    quality.closest_candidate(
        T(s, f, "orders").join(T(s, f, "customer"), F.col("o_custkey") == F.col("c_custkey")).filter("c_acctbal > 0")
        .select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("runtime"), (F.col("c_acctbal") * 31).alias("target")),
        ["o_custkey"], "o_orderkey", "runtime", "target", 5.0,
    ), ["drift_percent"], 5,
)
SQL["closest_candidate"] = """WITH c AS (SELECT o_custkey, o_orderkey, abs(o_totalprice - c_acctbal * 31) / (c_acctbal * 31) * 100 AS d FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY d, o_orderkey) AS rn FROM c) SELECT o_custkey, o_orderkey, round(d, 5) AS drift_percent, d <= 5 AS within_tolerance FROM r WHERE rn = 1"""

# --- diagnostics -----------------------------------------------------------------
Q["diagnose_null_ids"] = lambda s, f: (
    _extents(s, f).filter(F.col("expected").isNull()).join(b.event_series(s, f), "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("record_count"), F.max("minute_offset").alias("max_minute"))
)
SQL["diagnose_null_ids"] = f"""WITH {_SQL_EXT} SELECT user_id, count(*) AS record_count, max(minute_offset) AS max_minute FROM event_series WHERE user_id IN (SELECT user_id FROM over WHERE expected IS NULL) GROUP BY 1"""
Q["diagnose_null_durations"] = lambda s, f: (
    b.event_lines(s, f).select("user_id").distinct().join(_runtimes(s, f), "user_id", "left")
    .filter(F.col("runtime").isNull()).join(T(s, f, "customer").select(F.col("c_custkey").alias("user_id"), "c_name"), "user_id", "left").drop("runtime")
)
SQL["diagnose_null_durations"] = f"WITH {_SQL_TIMED} SELECT DISTINCT user_id, c_name FROM timed LEFT JOIN rt USING (user_id) LEFT JOIN customer ON c_custkey = user_id WHERE runtime IS NULL"
Q["diagnose_name_mapping"] = lambda s, f: T(s, f, "documents").select(
    F.regexp_replace(F.concat("source", F.lit("_"), F.col("lang")), r"^.*_", "").alias("suffix"), "source"
).distinct()
SQL["diagnose_name_mapping"] = "SELECT DISTINCT reverse(left(reverse(source || '_' || lang), position('_' IN reverse(source || '_' || lang)) - 1)) AS suffix, source FROM documents"

# --- timed text --------------------------------------------------------------------


def _timed_text(s, f):
    """Every document written as timed text, one entry per line, some of them broken."""
    def stamp(sec):
        return F.format_string("%02d:%02d:%02d,%03d", F.floor(sec / 3600).cast("int"), (F.floor(sec / 60) % 60).cast("int"), (sec % 60).cast("int"), F.lit(250))

    def entry(x, i):
        number = (i + 1 + F.when(F.length(x) % 7 == 0, 1).otherwise(0)).cast("string")
        arrow = F.when(F.length(x) % 11 == 0, F.lit(" -> ")).otherwise(F.lit(" --> "))
        return F.concat(number, F.lit("\n"), stamp(i * 5), arrow, stamp(i * 5 + 3), F.lit("\n"), x, F.lit("\n"))

    return T(s, f, "documents").select(
        "doc_id", F.array_join(F.transform(F.split("text", "\n"), entry), "\n").alias("content")
    )


_SQL_TT = r"""ln AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS x FROM documents),
en AS (SELECT doc_id, i, x, i + 1 + CASE WHEN length(x) % 7 = 0 THEN 1 ELSE 0 END AS number, length(x) % 11 <> 0 AS ok, i * 5 + 0.25::DOUBLE AS start_time, i * 5 + 3.25::DOUBLE AS end_time,
  CLEAN AS dialogue_text FROM ln)""".replace("CLEAN", SQL_CLEAN.replace("{0}", "x"))


def _entries(s, f):
    return readers.parse_timed_text(_timed_text(s, f), "content").withColumn("position", F.col("position").cast("bigint"))


Q["parse_timed_text"] = lambda s, f: _entries(s, f).drop("first_time")
SQL["parse_timed_text"] = f"""WITH {_SQL_TT} SELECT doc_id, i AS position, number AS subtitle_index, CASE WHEN ok THEN start_time END AS start_time, CASE WHEN ok THEN end_time END AS end_time,
dialogue_text, CASE WHEN ok THEN 3.0::DOUBLE END AS duration, ok FROM en"""


def _slugged(s, f):
    """Timed texts under the slug of their source and language."""
    d = T(s, f, "documents").select("doc_id", F.concat_ws("_", "source", "lang").alias("film_slug"))
    return _timed_text(s, f).join(d, "doc_id").select("film_slug", "content")


def read_subtitles(s, f):
    """The same entries after a trip through files; every writing task has its own file per slug."""
    path = scratch_path(s, "timed")
    rows = _slugged(s, f).select(F.col("film_slug").alias("name"), F.col("content").alias("value"))
    rows.write.partitionBy("name").option("lineSep", "\n\n\n").text(path)
    files = s.read.format("binaryFile").load(path)
    named = files.select(F.regexp_extract("path", r"name=([^/]+)/", 1).alias("film_slug"), readers.decode_bytes("content").alias("content"))
    return readers.document_metadata(readers.parse_timed_text(named, "content"))


Q["read_subtitles"] = read_subtitles
_SQL_META = f"""WITH {_SQL_TT}, sg AS (SELECT source || '_' || lang AS film_slug, en.* FROM en JOIN documents USING (doc_id)),
g AS (SELECT film_slug, count(CASE WHEN ok THEN 1 END) AS total_subtitles, count(CASE WHEN NOT ok THEN 1 END) AS skipped,
coalesce(max(CASE WHEN ok THEN end_time END) - min(CASE WHEN ok THEN start_time END), 0.0) AS total_duration FROM sg GROUP BY 1)
SELECT *, array_to_string(list_transform(string_split(regexp_replace(film_slug, '_(en|ja|fr|es|nl|ar)', '', 'g'), '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS film_name,
coalesce(nullif(regexp_extract(film_slug, '_(ja|fr|es|nl|ar)$', 1), ''), 'en') AS language_code FROM g"""
SQL["read_subtitles"] = _SQL_META
Q["document_metadata"] = lambda s, f: readers.document_metadata(readers.parse_timed_text(_slugged(s, f), "content"))
SQL["document_metadata"] = _SQL_META


def explode_documents(s, f):
    """Nested documents written as JSON and read back, one row per line."""
    path = scratch_path(s, "docs")
    lines = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.struct(
            (i + 1).cast("bigint").alias("subtitle_index"), (i * 5.0).alias("start_time"), (i * 5.0 + 3.0).alias("end_time"),
            F.lit(3.0).alias("duration"), text.clean_text(x).alias("dialogue_text"),
        ),
    )
    meta = F.struct(
        F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("film_name"), F.col("doc_id").cast("string").alias("film_slug"), F.col("lang").alias("language_code"),
        F.size(F.split("text", "\n")).cast("bigint").alias("total_subtitles"), F.lit(0.0).alias("total_duration"), F.lit("").alias("parse_timestamp"),
    )
    T(s, f, "documents").select(meta.alias("metadata"), lines.alias("subtitles")).write.json(path)
    docs = s.read.schema(readers.DOCUMENT_SCHEMA).json(path)
    return readers.explode_documents(docs).drop("parse_timestamp", "position")


Q["explode_documents"] = explode_documents
SQL["explode_documents"] = f"""WITH {_SQL_TT}, m AS (SELECT doc_id, lang, len(string_split(text, chr(10))) AS n FROM documents)
SELECT 'Doc ' || doc_id AS film_name, CAST(doc_id AS VARCHAR) AS film_slug, lang AS language_code, n AS total_subtitles, 0.0::DOUBLE AS total_duration, i + 1 AS subtitle_index,
i * 5.0::DOUBLE AS start_time, i * 5.0::DOUBLE + 3 AS end_time, 3.0::DOUBLE AS duration, dialogue_text FROM en JOIN m USING (doc_id)"""
Q["format_check"] = lambda s, f: quality.format_check(_timed_text(s, f), "content")
SQL["format_check"] = f"""WITH {_SQL_TT},
er AS (SELECT doc_id, i, list_filter([CASE WHEN number <> i + 1 THEN 'Line ' || (i * 4 + 1) || ': Non-sequential subtitle number. Expected ' || (i + 1) || ', got ' || number END,
  CASE WHEN NOT ok THEN 'Line ' || (i * 4 + 2) || ': Invalid timestamp format: ''' || printf('%02d:%02d:%02d,250', i * 5 // 3600, (i * 5 // 60) % 60, i * 5 % 60) || ' -> ' || printf('%02d:%02d:%02d,250', (i * 5 + 3) // 3600, ((i * 5 + 3) // 60) % 60, (i * 5 + 3) % 60) || '''' END,
  CASE WHEN trim(regexp_replace(x, '\\s+', ' ', 'g')) = '' THEN 'Line ' || (i * 4 + 1) || ': Subtitle ' || number || ' has no text content' END], lambda e: e IS NOT NULL) AS errs FROM en),
g AS (SELECT doc_id, flatten(list(errs ORDER BY i)) AS errors, count(*) AS entry_count FROM er GROUP BY 1)
SELECT doc_id, len(errors) = 0 AS valid, errors, entry_count FROM g"""
Q["text_stats"] = lambda s, f: quality.text_stats(_entries(s, f), ["doc_id"])
SQL["text_stats"] = f"""WITH {_SQL_TT} SELECT doc_id, count(*) AS entry_count, CAST(sum(len({_SQL_WORDS.replace('{0}', 'dialogue_text')})) AS BIGINT) AS word_count,
round((max(start_time) - min(start_time)) / 60.0, 1) AS time_span_minutes FROM en GROUP BY 1"""
Q["compare_entries"] = lambda s, f: quality.compare_entries(
    _entries(s, f).select("doc_id", "position", F.coalesce("start_time", F.col("position") * 5.0).alias("start_time"), "dialogue_text"),
    _entries(s, f).filter("ok").select("doc_id", "position", F.round("start_time", 0).alias("start_time"), F.col("dialogue_text")), ["doc_id", "position"],
)
SQL["compare_entries"] = f"WITH {_SQL_TT} SELECT doc_id, i AS position, true AS index_match, false AS time_match, true AS text_match, false AS passed FROM en WHERE ok"


def split_valid(s, f):
    good, bad = cleaning.split_valid(T(s, f, "documents"), "text")
    return good.select("doc_id", F.lit("accepted").alias("side")).unionByName(bad.select("doc_id", F.col("reason").alias("side")))


Q["split_valid"] = split_valid
SQL["split_valid"] = r"""SELECT doc_id, CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 'empty' WHEN length(text) > 1000 THEN 'too_long'
WHEN contains(lower(text), '<script>') OR contains(lower(text), 'javascript:') OR contains(lower(text), 'onerror=') OR contains(lower(text), 'onclick=') THEN 'suspicious' ELSE 'accepted' END AS side FROM documents"""
Q["screen_response"] = lambda s, f: T(s, f, "documents").select("doc_id", text.screen_response("text").alias("shown"))
_SQL_XSS = " OR ".join(f"regexp_matches(text, {_quote('(?i)' + p)})" for p in text.XSS_PATTERNS)
_SQL_NOTES = " + ".join(f"CAST(regexp_matches(text, {_quote('(?i)' + p)}) AS INTEGER)" for p in text.INJECTION_PATTERNS)
SQL["screen_response"] = f"""SELECT doc_id, CASE WHEN {_SQL_XSS} THEN NULL ELSE text END || repeat(chr(10) || chr(10) || '⚠️ Note: This response may contain unverified content.', {_SQL_NOTES}) AS shown FROM documents"""
