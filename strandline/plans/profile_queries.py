"""Profile, comparison, success and correlation queries, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import dims as fd
from strandline.functions import text
from strandline.operators import correlation, profiles, success
from strandline.plans import base as b

Q: dict = {}
SQL: dict[str, str] = {}
D, K, POS, NEG = b.SHIP_DIMS, b.SHIP_KEYS, b.SHIP_POSITIVE, b.SHIP_NEGATIVE
_AVGS = ", ".join(f"avg({d}) AS {d}" for d in D)
_LIST = "[" + ", ".join(D) + "]"
_SUM_COMPOUND = "(qty + price + net) - (disc + tax)"

Q["mean_vector"] = lambda s, f: b.rounded(profiles.mean_vector(b.ship_lines(s, f), K, D), D)
SQL["mean_vector"] = f"WITH {b.SQL_SHIP_LINES} SELECT nation, flag, {', '.join(f'round(avg({d}), 6) AS {d}' for d in D)} FROM ship_lines GROUP BY ALL"


def group_profile(s, f):
    out = profiles.group_profile(b.ship_lines(s, f), "nation", "l_suppkey", "week", D)
    out = out.withColumn("diversity", fd.row_diversity([f"avg_{d}" for d in D]))
    return profiles.with_top_dims(out, [f"avg_{d}" for d in D], D, 3)


_PROFILE = f"""p AS (SELECT nation, count(DISTINCT l_suppkey) AS entity_count, count(*) AS row_count,
  {", ".join(f"round(avg({d}), 4) AS avg_{d}" for d in D)}, min(week) AS earliest_year, max(week) AS latest_year,
  max(week) - min(week) AS span_years FROM ship_lines GROUP BY nation)"""
_TOPS = "list_sort([" + ", ".join(f"{{'s': -avg_{d}, 'i': {i}, 'n': '{d}'}}" for i, d in enumerate(D)) + "])"
Q["director_profile"] = group_profile
SQL["director_profile"] = f"""WITH {b.SQL_SHIP_LINES}, {_PROFILE},
t AS (SELECT *, {_TOPS} AS l, round(list_stddev_pop([{", ".join(f"avg_{d}" for d in D)}]), 4) AS diversity FROM p)
SELECT * EXCLUDE (l), {", ".join(f"l[{i}].n AS top_{i}, -l[{i}].s AS top_{i}_score" for i in (1, 2, 3))} FROM t"""

Q["top3_pivot"] = lambda s, f: profiles.with_top_dims(
    b.rounded(profiles.mean_vector(b.ship_lines(s, f), ["nation"], D), D, 4), D, D, 3
).drop(*D)
SQL["top3_pivot"] = f"""WITH {b.SQL_SHIP_LINES}, v AS (SELECT nation, {", ".join(f"round(avg({d}), 4) AS avg_{d}" for d in D)} FROM ship_lines GROUP BY ALL),
t AS (SELECT nation, {_TOPS} AS l FROM v)
SELECT nation, {", ".join(f"l[{i}].n AS top_{i}, -l[{i}].s AS top_{i}_score" for i in (1, 2, 3))} FROM t"""

Q["row_diversity"] = lambda s, f: b.ship_series(s, f).select(*K, "week", F.round(fd.row_diversity(D, None), 6).alias("diversity"))
SQL["row_diversity"] = f"WITH {b.SQL_SHIP_SERIES} SELECT nation, flag, week, round(list_stddev_pop({_LIST}), 6) AS diversity FROM ship_series"

Q["pooled_diversity"] = lambda s, f: b.rounded(profiles.pooled_diversity(b.ship_series(s, f), K, D), ["diversity"])
SQL["pooled_diversity"] = f"""WITH {b.SQL_SHIP_SERIES}, u AS (SELECT nation, flag, unnest({_LIST}) AS v FROM ship_series)
SELECT nation, flag, round(stddev(v), 6) AS diversity FROM u GROUP BY ALL"""

Q["compound_sentiment"] = lambda s, f: b.ship_series(s, f).select(
    *K, "week", F.round(fd.compound(POS, NEG), 6).alias("compound")
)
SQL["compound_sentiment"] = f"WITH {b.SQL_SHIP_SERIES} SELECT nation, flag, week, round({_SUM_COMPOUND}, 6) AS compound FROM ship_series"
Q["compound_mean_form"] = lambda s, f: b.ship_series(s, f).select(
    *K, "week", F.round(fd.compound(POS, NEG, "mean"), 6).alias("compound")
)
SQL["compound_mean_form"] = f"WITH {b.SQL_SHIP_SERIES} SELECT nation, flag, week, round((qty + price + net) / 3.0 - (disc + tax) / 2.0, 6) AS compound FROM ship_series"
Q["compound_wide_form"] = lambda s, f: b.event_series(s, f).select(
    "user_id", "minute_offset",
    F.round(fd.compound(["purchase", "signup", "view"], ["click", "error"]), 6).alias("compound"),
)
SQL["compound_wide_form"] = f'WITH {b.SQL_EVENT_SERIES} SELECT user_id, minute_offset, round((purchase + signup + "view") - (click + error), 6) AS compound FROM event_series'

_SUMMARY_COLS = [
    "avg_compound", "compound_spread", "peak_positive", "peak_negative", "emotional_range", "beginning", "ending", "avg_neutral",
]


def _summary(s, f):
    return profiles.trajectory_class(
        profiles.sentiment_summary(b.ship_series(s, f), K, "week", fd.compound(POS, NEG), "tax", "lines")
    )


_SQL_SUMMARY = f"""{b.SQL_SHIP_SERIES},
c AS (SELECT *, {_SUM_COMPOUND} AS x, max(week) OVER (PARTITION BY nation, flag) AS last FROM ship_series),
g AS (SELECT nation, flag, avg(x) AS avg_compound, stddev(x) AS compound_spread, max(x) AS peak_positive, min(x) AS peak_negative,
  max(x) - min(x) AS emotional_range, avg(CASE WHEN week <= last * 0.1 THEN x END) AS beginning,
  avg(CASE WHEN week >= last * 0.9 THEN x END) AS ending, count(*) AS data_points, CAST(sum(lines) AS BIGINT) AS total_lines,
  avg(tax) AS avg_neutral FROM c GROUP BY ALL),
summary AS (SELECT *, CASE WHEN ending - beginning > 0.15 THEN 'rising' WHEN ending - beginning < -0.15 THEN 'falling' ELSE 'stable' END AS trajectory,
  CASE WHEN avg_compound > 0.1 THEN 'positive' WHEN avg_compound < -0.1 THEN 'negative' ELSE 'neutral' END AS tone FROM g)"""
Q["sentiment_summary"] = lambda s, f: b.rounded(_summary(s, f), _SUMMARY_COLS, 4).drop("trajectory", "tone", "beginning", "ending")
SQL["sentiment_summary"] = f"""WITH {_SQL_SUMMARY} SELECT nation, flag, {b.sql_rounded([c for c in _SUMMARY_COLS if c not in ('beginning', 'ending')], 4)},
data_points, total_lines FROM summary"""


def _user_arc(s, f):
    return profiles.trajectory_class(
        profiles.sentiment_summary(
            b.event_series(s, f), ["user_id"], "minute_offset",
            fd.compound(["purchase", "signup", "view"], ["click", "error"]) * 10, "view", "dialogue_count",
        )
    )


_SQL_USER_ARC = f"""{b.SQL_EVENT_SERIES},
c AS (SELECT *, ((purchase + signup + "view") - (click + error)) * 10 AS x, max(minute_offset) OVER (PARTITION BY user_id) AS last FROM event_series),
g AS (SELECT user_id, avg(x) AS avg_compound, stddev(x) AS spread, max(x) AS hi, min(x) AS lo, avg(CASE WHEN minute_offset <= last * 0.1 THEN x END) AS beginning,
  avg(CASE WHEN minute_offset >= last * 0.9 THEN x END) AS ending, count(*) AS n FROM c GROUP BY ALL)"""
Q["begin_end_means"] = lambda s, f: b.rounded(_user_arc(s, f).select("user_id", "beginning", "ending"), ["beginning", "ending"])
SQL["begin_end_means"] = f"WITH {_SQL_USER_ARC} SELECT user_id, round(beginning, 6) AS beginning, round(ending, 6) AS ending FROM g"
Q["trajectory_class"] = lambda s, f: _user_arc(s, f).select("user_id", "trajectory", "tone")
SQL["trajectory_class"] = f"""WITH {_SQL_USER_ARC} SELECT user_id,
CASE WHEN ending - beginning > 0.15 THEN 'rising' WHEN ending - beginning < -0.15 THEN 'falling' ELSE 'stable' END AS trajectory,
CASE WHEN avg_compound > 0.1 THEN 'positive' WHEN avg_compound < -0.1 THEN 'negative' ELSE 'neutral' END AS tone FROM g"""
Q["join_back_bounds"] = lambda s, f: b.ship_series(s, f).select(
    *K, "week", F.max("week").over(profiles.Window.partitionBy(*K)).alias("max_week")
)
SQL["join_back_bounds"] = f"""WITH {b.SQL_SHIP_SERIES}, m AS (SELECT nation, flag, max(week) AS max_week FROM ship_series GROUP BY ALL)
SELECT nation, flag, week, max_week FROM ship_series JOIN m USING (nation, flag)"""


def _customers(s, f):
    """Customers with their order value (revenue), balance (budget) and a 0-100 score."""
    orders = b.table(s, f, "orders").groupBy("o_custkey").agg(
        F.round(F.sum("o_totalprice"), 2).alias("revenue"),
        F.round(F.avg(F.when(F.col("o_orderstatus") == "F", 97.3).when(F.col("o_orderstatus") == "O", 71.9).otherwise(53.1)), 4).alias("score"),
        F.min(F.year("o_orderdate")).cast("bigint").alias("first_year"),
    )
    return b.table(s, f, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", "c_mktsegment", "c_nationkey", F.col("c_acctbal").alias("budget"), "revenue", "score", "first_year"
    )


SQL_CUSTOMERS = """o AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS revenue,
  round(avg(CASE o_orderstatus WHEN 'F' THEN 97.3::DOUBLE WHEN 'O' THEN 71.9::DOUBLE ELSE 53.1::DOUBLE END), 4) AS score, min(year(o_orderdate)) AS first_year FROM orders GROUP BY 1),
customers AS (SELECT c_custkey, c_mktsegment, c_nationkey, c_acctbal AS budget, revenue, score, first_year FROM customer LEFT JOIN o ON c_custkey = o_custkey)"""
_SQL_SUCCESS = SQL_CUSTOMERS + """,
st AS (SELECT avg(revenue) AS ar, stddev(revenue) AS sr, avg(score) AS asc_, stddev(score) AS ss FROM customers WHERE revenue IS NOT NULL),
qs AS (SELECT percentile_cont(0.75) WITHIN GROUP (ORDER BY revenue) AS q75, percentile_cont(0.5) WITHIN GROUP (ORDER BY revenue) AS q50,
  percentile_cont(0.25) WITHIN GROUP (ORDER BY revenue) AS q25 FROM customers WHERE revenue IS NOT NULL),
m AS (SELECT customers.*, CASE WHEN revenue IS NOT NULL AND sr > 0 THEN (revenue - ar) / sr END AS rz, CASE WHEN score IS NOT NULL AND ss > 0 THEN (score - asc_) / ss END AS cz,
  CASE WHEN budget > 0 THEN (revenue - budget) / budget END AS roi,
  CASE WHEN revenue >= q75 THEN 'top_quartile' WHEN revenue >= q50 THEN 'above_median' WHEN revenue >= q25 THEN 'below_median' ELSE 'bottom_quartile' END AS revenue_tier,
  CASE WHEN score >= 90 THEN 'certified_fresh' WHEN score >= 75 THEN 'fresh' WHEN score >= 60 THEN 'mixed' ELSE 'rotten' END AS critical_reception_tier
  FROM customers CROSS JOIN st CROSS JOIN qs),
success AS (SELECT c_custkey, c_mktsegment, c_nationkey, budget, revenue, score, first_year, round(roi, 6) AS roi, round(rz, 4) AS revenue_zscore, round(cz, 4) AS score_zscore, revenue_tier, critical_reception_tier,
  revenue IS NOT NULL AS has_revenue_data, score IS NOT NULL AS has_critic_data,
  round((coalesce(rz, 0) + coalesce(cz, 0)) / nullif((CASE WHEN rz IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN cz IS NOT NULL THEN 1 ELSE 0 END), 0), 4) AS composite_success_score FROM m)"""


def _success(s, f):
    return b.rounded(success.success_metrics(_customers(s, f), "revenue", "budget", "score"), ["roi"])


Q["success_metrics"] = _success
SQL["success_metrics"] = f"WITH {_SQL_SUCCESS} SELECT * FROM success"
Q["zscore"] = lambda s, f: b.rounded(
    success.zscores(_customers(s, f), ["revenue", "score"], "revenue").select("c_custkey", "revenue_zscore", "score_zscore"),
    ["revenue_zscore", "score_zscore"], 4,
)
SQL["zscore"] = f"WITH {_SQL_SUCCESS} SELECT c_custkey, revenue_zscore, score_zscore FROM success"
Q["broadcast_scalar"] = lambda s, f: b.table(s, f, "orders").select(
    "o_orderkey",
    F.round(
        F.col("o_totalprice")
        - b.table(s, f, "orders").agg(F.avg("o_totalprice").alias("m")).scalar(), 4
    ).alias("above_mean"),
)
SQL["broadcast_scalar"] = "SELECT o_orderkey, round(o_totalprice - (SELECT avg(o_totalprice) FROM orders), 4) AS above_mean FROM orders"
Q["quartile_tier"] = lambda s, f: success.quartile_tier(_customers(s, f), "revenue").select("c_custkey", "revenue", "revenue_tier")
SQL["quartile_tier"] = f"WITH {_SQL_SUCCESS} SELECT c_custkey, revenue, revenue_tier FROM success"
Q["threshold_tier"] = lambda s, f: _customers(s, f).select("c_custkey", success.threshold_tier("score").alias("tier"))
SQL["threshold_tier"] = f"WITH {_SQL_SUCCESS} SELECT c_custkey, critical_reception_tier AS tier FROM success"
Q["roi"] = lambda s, f: _customers(s, f).select("c_custkey", F.round(success.roi("revenue", "budget"), 6).alias("roi"))
SQL["roi"] = f"WITH {_SQL_SUCCESS} SELECT c_custkey, roi FROM success"
Q["composite_score"] = lambda s, f: success.zscores(_customers(s, f), ["revenue", "score"], "revenue").select(
    "c_custkey", success.composite_score(["revenue_zscore", "score_zscore"]).alias("composite")
)
SQL["composite_score"] = f"WITH {_SQL_SUCCESS} SELECT c_custkey, composite_success_score AS composite FROM success"


def success_correlation_view(s, f):
    """Arc of every user next to the success metrics of the customer with that number."""
    arcs = _user_arc(s, f).filter(F.col("avg_compound").isNotNull() & (F.col("data_points") >= 10))
    joined = arcs.join(_success(s, f), F.col("user_id") == F.col("c_custkey"))
    return joined.select(
        "user_id", F.round("avg_compound", 4).alias("avg_compound"), "trajectory", "tone", "data_points",
        "revenue", "roi", "revenue_zscore", "score_zscore", "revenue_tier", "critical_reception_tier",
        "composite_success_score",
        (F.col("avg_compound").isNotNull() & F.col("revenue").isNotNull()).alias("has_sentiment_revenue_pair"),
        (F.col("avg_compound").isNotNull() & F.col("score").isNotNull()).alias("has_sentiment_critic_pair"),
    )


Q["success_correlation_view"] = success_correlation_view
SQL["success_correlation_view"] = f"""WITH {_SQL_USER_ARC}, {_SQL_SUCCESS}
SELECT user_id, round(avg_compound, 4) AS avg_compound,
  CASE WHEN ending - beginning > 0.15 THEN 'rising' WHEN ending - beginning < -0.15 THEN 'falling' ELSE 'stable' END AS trajectory,
  CASE WHEN avg_compound > 0.1 THEN 'positive' WHEN avg_compound < -0.1 THEN 'negative' ELSE 'neutral' END AS tone, n AS data_points,
  revenue, roi, revenue_zscore, score_zscore, revenue_tier, critical_reception_tier, composite_success_score,
  avg_compound IS NOT NULL AND revenue IS NOT NULL AS has_sentiment_revenue_pair, avg_compound IS NOT NULL AND score IS NOT NULL AS has_sentiment_critic_pair
FROM g JOIN success ON user_id = c_custkey WHERE avg_compound IS NOT NULL AND n >= 10"""


def finance_vector_join(s, f):
    vectors = profiles.mean_vector(b.event_series(s, f), ["user_id"], b.EVENT_DIMS)
    joined = _customers(s, f).join(vectors, F.col("c_custkey") == F.col("user_id"))
    return joined.select(
        "c_custkey", "revenue", "budget", *[F.round(d, 6).alias(f"avg_{d}") for d in b.EVENT_DIMS],
        fd.dominant_name(b.EVENT_DIMS).alias("top_dimension"),
        F.round(fd.row_diversity(b.EVENT_DIMS, None), 4).alias("diversity"),
    )


_EV = "[" + ", ".join(f'v."{d}"' for d in b.EVENT_DIMS) + "]"
_SQL_TOP_CASE = "CASE " + " ".join(
    f"WHEN greatest({', '.join(chr(34) + x + chr(34) for x in b.EVENT_DIMS)}) = \"{d}\" THEN '{d}'" for d in b.EVENT_DIMS
) + " ELSE 'view' END"
Q["finance_vector_join"] = finance_vector_join
SQL["finance_vector_join"] = f"""WITH {b.SQL_EVENT_SERIES}, {SQL_CUSTOMERS},
v AS (SELECT user_id, {", ".join(f'avg("{d}") AS "{d}"' for d in b.EVENT_DIMS)} FROM event_series GROUP BY 1)
SELECT c_custkey, revenue, budget, {", ".join(f'round("{d}", 6) AS avg_{d}' for d in b.EVENT_DIMS)}, {_SQL_TOP_CASE} AS top_dimension,
  round(list_stddev_pop({_EV}), 4) AS diversity FROM customers JOIN v ON c_custkey = user_id"""

Q["dominant_dimension"] = lambda s, f: b.ship_series(s, f).select(
    *K, "week", fd.dominant_name(D).alias("dominant")
)
SQL["dominant_dimension"] = f"""WITH {b.SQL_SHIP_SERIES} SELECT nation, flag, week,
CASE {" ".join(f"WHEN greatest({', '.join(D)}) = {d} THEN '{d}'" for d in D)} END AS dominant FROM ship_series"""
Q["dominant_signed"] = lambda s, f: (
    b.ship_series(s, f).select(*K, "week", fd.dominant_signed(POS, NEG).alias("d"))
    .select(*K, "week", F.round("d.score", 6).alias("score"), F.col("d.name").alias("name"),
            F.round("d.intensity", 6).alias("intensity"), F.col("d.polarity").alias("polarity"))
)
SQL["dominant_signed"] = f"""WITH {b.SQL_SHIP_SERIES},
m AS (SELECT *, greatest(0.0, qty, price, net) AS pv, greatest(0.0, disc, tax) AS nv FROM ship_series),
n AS (SELECT *, CASE WHEN pv <= 0 THEN NULL WHEN qty = pv THEN 'qty' WHEN price = pv THEN 'price' WHEN net = pv THEN 'net' END AS pn,
  CASE WHEN nv <= 0 THEN NULL WHEN disc = nv THEN 'disc' WHEN tax = nv THEN 'tax' END AS nn FROM m)
SELECT nation, flag, week, round(CASE WHEN pv > nv THEN pv ELSE -nv END, 6) AS score, CASE WHEN pv > nv THEN pn ELSE nn END AS name,
  round(CASE WHEN pv > nv THEN pv ELSE nv END, 6) AS intensity, CASE WHEN pv > nv THEN 'positive' ELSE 'negative' END AS polarity FROM n"""
Q["dominant_value"] = lambda s, f: b.ship_series(s, f).select(*K, "week", F.round(fd.strongest_value(D), 6).alias("score"))
SQL["dominant_value"] = f"WITH {b.SQL_SHIP_SERIES} SELECT nation, flag, week, round(greatest({', '.join(D)}), 6) AS score FROM ship_series"

Q["coverage"] = lambda s, f: profiles.coverage(b.ship_series(s, f), "nation", "flag", "lines")
SQL["coverage"] = f"""WITH {b.SQL_SHIP_SERIES} SELECT count(DISTINCT nation) AS entities, count(DISTINCT flag) AS members,
CAST(sum(lines) AS BIGINT) AS lines, count(*) AS rows FROM ship_series"""
Q["coverage_by_member"] = lambda s, f: profiles.entities_per_member(b.ship_series(s, f), "nation", "flag")
SQL["coverage_by_member"] = f"WITH {b.SQL_SHIP_SERIES} SELECT flag, count(DISTINCT nation) AS entities FROM ship_series GROUP BY flag"
Q["language_averages"] = lambda s, f: b.rounded(profiles.member_averages(b.ship_series(s, f), "flag", D), D)
SQL["language_averages"] = f"""WITH {b.SQL_SHIP_SERIES}, v AS (SELECT flag, {_AVGS} FROM ship_series GROUP BY flag)
SELECT flag, {b.sql_rounded(D)}, list_transform(list_slice(list_sort([{", ".join(f"{{'s': -{d}, 'i': {i}, 'n': '{d}'}}" for i, d in enumerate(D))}]), 1, 3), lambda x: x.n) AS top_names FROM v"""


def _status_lines(s, f):
    """Order values of every priority, scaled per status, as three dimensions."""
    o = b.table(s, f, "orders")
    return o.select(
        "o_orderpriority",
        *[F.when(F.col("o_orderstatus") == x, F.col("o_totalprice") / 555559.0).otherwise(0.0).alias(x.lower()) for x in "FOP"],
    )


_SQL_STATUS = "st AS (SELECT o_orderpriority, " + ", ".join(
    f"CASE WHEN o_orderstatus = '{x}' THEN o_totalprice / 555559.0 ELSE 0.0 END AS {x.lower()}" for x in "FOP"
) + " FROM orders)"
Q["baseline_diff"] = lambda s, f: b.rounded(
    profiles.baseline_diff(_status_lines(s, f), "o_orderpriority", ["f", "o", "p"], "1-URGENT", 1.0, 20),
    ["baseline_score", "member_score", "difference_pct"],
)
SQL["baseline_diff"] = f"""WITH {_SQL_STATUS}, v AS (SELECT o_orderpriority, avg(f) AS f, avg(o) AS o, avg(p) AS p FROM st GROUP BY 1),
l AS (UNPIVOT v ON f, o, p INTO NAME dimension VALUE score),
d AS (SELECT a.o_orderpriority, a.dimension, e.score AS baseline_score, a.score AS member_score, (a.score - e.score) / e.score * 100 AS difference_pct
  FROM l a JOIN l e ON a.dimension = e.dimension AND e.o_orderpriority = '1-URGENT' WHERE a.o_orderpriority <> '1-URGENT' AND e.score > 0)
SELECT o_orderpriority, dimension, {b.sql_rounded(["baseline_score", "member_score", "difference_pct"])} FROM d WHERE abs(difference_pct) > 1
ORDER BY abs(d.difference_pct) DESC, o_orderpriority, dimension LIMIT 20"""

Q["pair_self_join"] = lambda s, f: profiles.member_pairs(
    b.rounded(profiles.mean_vector(b.ship_series(s, f), K, D), D), ["nation"], "flag", D
).select("nation", "member_a", "member_b", *[F.col("va")[d].alias(f"{d}_a") for d in D], *[F.col("vb")[d].alias(f"{d}_b") for d in D])
_SQL_VEC = f"vec AS (SELECT nation, flag, {_AVGS} FROM ship_series GROUP BY ALL)"
SQL["pair_self_join"] = f"""WITH {b.SQL_SHIP_SERIES}, {_SQL_VEC} SELECT a.nation, a.flag AS member_a, c.flag AS member_b,
{", ".join(f"round(a.{d}, 6) AS {d}_a, round(c.{d}, 6) AS {d}_b" for d in D)} FROM vec a JOIN vec c ON a.nation = c.nation AND a.flag < c.flag"""
Q["pair_difference"] = lambda s, f: b.rounded(
    profiles.pair_difference(profiles.mean_vector(b.ship_series(s, f), K, D), ["nation"], "flag", D, significant=2.0),
    ["score_a", "score_b", "difference"],
)
SQL["pair_difference"] = f"""WITH {b.SQL_SHIP_SERIES}, {_SQL_VEC}, l AS (UNPIVOT vec ON {", ".join(D)} INTO NAME dimension VALUE score),
p AS (SELECT a.nation, a.flag AS member_a, c.flag AS member_b, a.dimension, a.score AS sa, c.score AS sb,
  CASE WHEN a.score = 0 THEN NULL ELSE round((c.score - a.score) / a.score * 100, 4) END AS percent_difference
  FROM l a JOIN l c ON a.nation = c.nation AND a.dimension = c.dimension AND a.flag < c.flag)
SELECT nation, member_a, member_b, dimension, round(sa, 6) AS score_a, round(sb, 6) AS score_b, round(sb - sa, 6) AS difference,
  percent_difference, coalesce(abs(percent_difference) > 2, false) AS is_significant FROM p"""

Q["top_n_dimensions"] = lambda s, f: b.rounded(profiles.top_n_dimensions(b.event_series(s, f), b.EVENT_DIMS, 3, ["view"]), ["score"])
_SQL_LONG = "long AS (UNPIVOT (SELECT " + ", ".join(f'{{}}("{d}") AS "{d}"' for d in b.EVENT_DIMS) + " FROM event_series) ON " + ", ".join(f'"{d}"' for d in b.EVENT_DIMS) + " INTO NAME dimension VALUE score)"
SQL["top_n_dimensions"] = f"""WITH {b.SQL_EVENT_SERIES}, {_SQL_LONG.replace("{}", "avg")}
SELECT dimension, round(score, 6) AS score FROM long WHERE dimension <> 'view' ORDER BY long.score DESC LIMIT 3"""
Q["volatile_dimensions"] = lambda s, f: b.rounded(profiles.volatile_dimensions(b.event_series(s, f), b.EVENT_DIMS, 3), ["score"])
SQL["volatile_dimensions"] = f"""WITH {b.SQL_EVENT_SERIES}, {_SQL_LONG.replace("{}", "stddev")}
SELECT dimension, round(score, 6) AS score FROM long ORDER BY long.score DESC LIMIT 3"""
Q["display_series"] = lambda s, f: b.rounded(profiles.display_series(b.event_series(s, f), b.EVENT_DIMS, ["error"]), b.EVENT_DIMS)
SQL["display_series"] = f"""WITH {b.SQL_EVENT_SERIES}, n AS (SELECT * REPLACE (-error AS error) FROM event_series)
SELECT user_id, minute_offset, dialogue_count, {b.sql_rounded(b.EVENT_DIMS)} FROM n"""
Q["segment_compare"] = lambda s, f: b.rounded(
    profiles.segment_compare(_customers(s, f), "c_mktsegment", "BUILDING", "MACHINERY", "revenue"),
    ["first_mean", "second_mean", "difference_pct"], 3,
)
SQL["segment_compare"] = f"""WITH {SQL_CUSTOMERS}, a AS (SELECT avg(CASE WHEN c_mktsegment = 'BUILDING' THEN revenue END) AS x, avg(CASE WHEN c_mktsegment = 'MACHINERY' THEN revenue END) AS y,
count(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 END) AS first_count, count(CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 END) AS second_count FROM customers)
SELECT 'BUILDING' AS first_segment, 'MACHINERY' AS second_segment, round(x, 3) AS first_mean, round(y, 3) AS second_mean, first_count, second_count, round((x - y) / y * 100, 3) AS difference_pct FROM a"""
Q["version_summary"] = lambda s, f: b.rounded(
    profiles.version_summary(b.ship_series(s, f), ["nation"], "flag", "R", "lines"), ["avg_lines"]
)
SQL["version_summary"] = f"""WITH {b.SQL_SHIP_SERIES} SELECT nation, count(*) AS minute_count, CAST(sum(lines) AS BIGINT) AS total_lines,
round(avg(lines), 6) AS avg_lines FROM ship_series WHERE flag = 'R' GROUP BY nation"""
Q["partition_totals"] = lambda s, f: b.rounded(profiles.partition_totals(_customers(s, f), ["c_nationkey"], "revenue"), ["total"], 1)
SQL["partition_totals"] = f"""WITH {SQL_CUSTOMERS} SELECT c_nationkey, count(*) AS row_count, round(sum(coalesce(revenue, 0)), 1) AS total FROM customers GROUP BY 1"""
Q["pivot_max"] = lambda s, f: profiles.pivot_max(
    b.table(s, f, "orders"), ["o_custkey"], "o_orderstatus", ["F", "O", "P"], {"max_{}": "o_totalprice"}
)
SQL["pivot_max"] = "SELECT o_custkey, " + ", ".join(f"max(CASE WHEN o_orderstatus = '{x}' THEN o_totalprice END) AS \"max_{x}\"" for x in "FOP") + " FROM orders GROUP BY 1"

Q["pearson"] = lambda s, f: b.rounded(correlation.pearson(_customers(s, f), "budget", "revenue", False), ["r"])
SQL["pearson"] = f"""WITH {SQL_CUSTOMERS}, a AS (SELECT count(CASE WHEN budget IS NOT NULL AND revenue IS NOT NULL THEN 1 END) AS n, corr(budget, revenue) AS r FROM customers)
SELECT n, round(r, 6) AS r, CASE WHEN abs(r) < 0.3 THEN 'weak' WHEN abs(r) < 0.7 THEN 'moderate' ELSE 'strong' END AS strength,
  CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction, 'ok' AS status FROM a"""
Q["pearson_p_value"] = lambda s, f: b.rounded(correlation.pearson(_customers(s, f), "budget", "revenue"), ["r", "p_value"])
# The tail of Student's distribution by Simpson's rule over its density.
SQL["pearson_p_value"] = f"""WITH {SQL_CUSTOMERS}, a AS (SELECT count(CASE WHEN budget IS NOT NULL AND revenue IS NOT NULL THEN 1 END) AS n, corr(budget, revenue) AS r FROM customers),
t AS (SELECT *, n - 2 AS nu, abs(r) * sqrt((n - 2) / (1 - r * r)) AS t FROM a), k AS (SELECT unnest(range(0, 20001)) AS k),
d AS (SELECT sum((CASE WHEN k IN (0, 20000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(lgamma((nu + 1) / 2) - lgamma(nu / 2) - (nu + 1) / 2 * ln(1 + (t * k / 20000) ** 2 / nu)) / sqrt(nu * pi())) * any_value(t) / 60000 AS half FROM t, k)
SELECT n, round(r, 6) AS r, round(1 - 2 * half, 6) AS p_value, CASE WHEN abs(r) < 0.3 THEN 'weak' WHEN abs(r) < 0.7 THEN 'moderate' ELSE 'strong' END AS strength,
  CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction, 1 - 2 * half < 0.05 AS is_significant, 'ok' AS status FROM t, d"""

_FLAGS = ["A", "N", "R"]


def _aligned(s, f):
    return correlation.align_members(b.ship_series(s, f), ["nation"], "week", "flag", "qty", _FLAGS)


_SQL_ALIGNED = b.SQL_SHIP_SERIES + ", aligned AS (SELECT nation, week, " + ", ".join(
    f"max(CASE WHEN flag = '{x}' THEN qty END) AS \"{x}\"" for x in _FLAGS
) + " FROM ship_series GROUP BY ALL)"
Q["outer_align"] = lambda s, f: b.rounded(_aligned(s, f), _FLAGS)
SQL["outer_align"] = f"WITH {_SQL_ALIGNED} SELECT nation, week, {b.sql_rounded(_FLAGS)} FROM aligned"
Q["pairwise_correlation"] = lambda s, f: b.rounded(correlation.pairwise_correlation(_aligned(s, f), ["nation"], _FLAGS), ["r"])
_SQL_PAIRS = " UNION ALL ".join(
    f"""SELECT nation, '{x}' AS member_a, '{y}' AS member_b, count(CASE WHEN "{x}" IS NOT NULL AND "{y}" IS NOT NULL THEN 1 END) AS n, corr("{x}", "{y}") AS r FROM aligned GROUP BY nation"""
    for x, y in [("A", "N"), ("A", "R"), ("N", "R")]
)
SQL["pairwise_correlation"] = f"WITH {_SQL_ALIGNED}, p AS ({_SQL_PAIRS}) SELECT nation, member_a, member_b, n, round(r, 6) AS r FROM p WHERE n >= 2"
Q["correlation_summary"] = lambda s, f: b.rounded(
    correlation.correlation_summary(correlation.pairwise_correlation(_aligned(s, f), ["nation"], _FLAGS), ["nation"]), ["avg_correlation"]
)
SQL["correlation_summary"] = f"""WITH {_SQL_ALIGNED}, p AS ({_SQL_PAIRS}), q AS (SELECT *, member_a || '-' || member_b AS name FROM p WHERE n >= 2)
SELECT nation, round(avg(r), 6) AS avg_correlation, arg_max(name, r) AS closest_pair, arg_min(name, r) AS most_different_pair FROM q GROUP BY nation"""
Q["variance_by_key"] = lambda s, f: b.rounded(correlation.divergence(_aligned(s, f), ["nation"], "week", _FLAGS), ["variance"], 9)
SQL["variance_by_key"] = f"""WITH {b.SQL_SHIP_SERIES}, v AS (SELECT nation, week, round(var_pop(qty), 9) AS variance FROM ship_series GROUP BY ALL HAVING count(qty) > 1),
r AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY variance DESC, week) AS rank FROM v)
SELECT nation, week, variance, rank FROM r WHERE rank <= 3"""
Q["arc_stats"] = lambda s, f: b.rounded(correlation.arc_stats(b.ship_series(s, f), ["nation"], "flag", "qty"), ["avg", "min", "max"])
SQL["arc_stats"] = f"""WITH {b.SQL_SHIP_SERIES} SELECT nation, flag, round(avg(qty), 6) AS avg, round(min(qty), 6) AS min, round(max(qty), 6) AS max, count(qty) AS n FROM ship_series GROUP BY ALL"""


def _rounded_series(s, f):
    return b.rounded(b.ship_series(s, f), ["net"])


_SQL_RSERIES = b.SQL_SHIP_SERIES + ", rs AS (SELECT nation, flag, week, round(net, 6) AS net FROM ship_series)"
Q["arc_peaks"] = lambda s, f: correlation.arc_peaks(_rounded_series(s, f), ["nation"], "week", "flag", "net", 3)
SQL["arc_peaks"] = f"""WITH {_SQL_RSERIES}, r AS (SELECT nation, flag, week, net, row_number() OVER (PARTITION BY nation, flag ORDER BY net DESC, week) AS rank FROM rs)
SELECT * FROM r WHERE rank <= 3"""


def distinctive_peaks(s, f):
    rs = _rounded_series(s, f)
    aligned = correlation.align_members(rs, ["nation"], "week", "flag", "net", _FLAGS)
    return b.rounded(
        correlation.distinctive_peaks(rs, aligned, ["nation"], "week", "flag", "net", _FLAGS, 3, 0.1), ["others_mean"], 9
    )


Q["distinctive_peaks"] = distinctive_peaks
SQL["distinctive_peaks"] = f"""WITH {_SQL_RSERIES}, r AS (SELECT nation, flag, week, net, row_number() OVER (PARTITION BY nation, flag ORDER BY net DESC, week) AS rank FROM rs),
p AS (SELECT * FROM r WHERE rank <= 3),
o AS (SELECT p.nation, p.flag, p.week, p.net, p.rank, avg(rs.net) AS others_mean FROM p JOIN rs ON rs.nation = p.nation AND rs.week = p.week AND rs.flag <> p.flag GROUP BY ALL)
SELECT nation, flag, week, net, rank, round(others_mean, 9) AS others_mean FROM o WHERE net > others_mean + 0.1"""
