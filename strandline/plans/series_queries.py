"""Series queries over the events and the line items, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import dims, text
from strandline.operators import ordered, profiles, series
from strandline.plans import base as b

Q: dict = {}
SQL: dict[str, str] = {}
E_DIMS = b.EVENT_DIMS


def peaks_smoothed(spark, folder):
    """Five highest smoothed buckets per user and event type."""
    out = series.peaks_per_dimension(
        b.event_series(spark, folder), ["user_id"], "minute_offset", E_DIMS, k=5, smooth=(5, 5)
    )
    return out.withColumn("scene_description", text.scene_label("minute_offset"))


Q["peaks_smoothed"] = peaks_smoothed
_SMOOTHED = ", ".join(
    f'avg("{d}") OVER (PARTITION BY user_id ORDER BY minute_offset ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS "{d}"'
    for d in E_DIMS
)


def _sql_long(source: str, ids: str, names: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT {ids}, '{d}' AS dimension, \"{d}\" AS score FROM {source}" for d in names)


def _sql_peaks(source: str, k: int) -> str:
    return f"""long AS ({_sql_long(source, 'user_id, minute_offset', E_DIMS)}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id, dimension ORDER BY score DESC, minute_offset) AS peak_rank FROM long)
SELECT concat_ws('_', user_id, dimension, minute_offset) AS peak_id, user_id, dimension, minute_offset,
       round(score, 4) AS intensity_score, peak_rank"""


SQL["peaks_smoothed"] = f"""WITH {b.SQL_EVENT_SERIES},
smoothed AS (SELECT user_id, minute_offset, {_SMOOTHED} FROM event_series),
{_sql_peaks('smoothed', 5)},
       'Minutes ' || (minute_offset - 5) || '-' || (minute_offset + 5) AS scene_description
FROM ranked WHERE peak_rank <= 5"""

Q["peaks_raw"] = lambda spark, folder: series.peaks_per_dimension(
    b.event_series(spark, folder), ["user_id"], "minute_offset", E_DIMS, k=5
)
SQL["peaks_raw"] = f"WITH {b.SQL_EVENT_SERIES}, {_sql_peaks('event_series', 5)} FROM ranked WHERE peak_rank <= 5"

Q["minute_aggregate"] = lambda spark, folder: b.rounded(b.event_series(spark, folder), E_DIMS)
SQL["minute_aggregate"] = f"""WITH {b.SQL_EVENT_SERIES}
SELECT user_id, minute_offset, dialogue_count, {b.sql_rounded(E_DIMS)} FROM event_series"""

Q["minute_bucket"] = lambda spark, folder: b.event_lines(spark, folder).select(
    "event_id", text.minute_bucket("seconds", 60).alias("minute_offset")
)
SQL["minute_bucket"] = f"""WITH {b.SQL_EVENT_LINES}
SELECT event_id, CAST(floor(seconds / 60) AS BIGINT) AS minute_offset FROM event_lines"""

Q["rolling_mean"] = lambda spark, folder: b.rounded(
    series.rolling_mean(b.ship_series(spark, folder), b.SHIP_KEYS, "week", b.SHIP_DIMS), b.SHIP_DIMS
).drop("lines")


def _sql_roll(before: int, after: int, cols: list[str]) -> str:
    return ", ".join(
        f'round(avg("{c}") OVER (PARTITION BY nation, flag ORDER BY week ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING), 6) AS "{c}"'
        for c in cols
    )


SQL["rolling_mean"] = f"""WITH {b.SQL_SHIP_SERIES}
SELECT nation, flag, week, {_sql_roll(5, 5, b.SHIP_DIMS)} FROM ship_series"""

Q["rolling_mean_window"] = lambda spark, folder: b.rounded(
    series.rolling_mean_window(b.ship_series(spark, folder), b.SHIP_KEYS, "week", b.SHIP_DIMS, 10), b.SHIP_DIMS
).drop("lines")
SQL["rolling_mean_window"] = f"""WITH {b.SQL_SHIP_SERIES}
SELECT nation, flag, week, {_sql_roll(5, 4, b.SHIP_DIMS)} FROM ship_series"""

Q["multi_window_smooth"] = lambda spark, folder: b.rounded(
    series.multi_window_smooth(b.ship_series(spark, folder), b.SHIP_KEYS, "week", "qty"), ["smoothed_score"]
)
SQL["multi_window_smooth"] = f"WITH {b.SQL_SHIP_SERIES} " + " UNION ALL ".join(
    f"""SELECT nation, flag, week, CAST({n} AS BIGINT) AS window_size, round(avg(qty) OVER (PARTITION BY nation, flag ORDER BY week
ROWS BETWEEN {x} PRECEDING AND {y} FOLLOWING), 6) AS smoothed_score FROM ship_series"""
    for n, (x, y) in series.SMOOTHING_FRAMES.items()
)

Q["first_derivative"] = lambda spark, folder: b.rounded(
    series.first_derivative(b.ship_series(spark, folder), b.SHIP_KEYS, "week", "qty").select(
        *b.SHIP_KEYS, "week", "first_derivative"
    ),
    ["first_derivative"],
)
SQL["first_derivative"] = f"""WITH {b.SQL_SHIP_SERIES}
SELECT nation, flag, week, round(qty - lag(qty) OVER (PARTITION BY nation, flag ORDER BY week), 6) AS first_derivative
FROM ship_series"""

Q["second_derivative"] = lambda spark, folder: b.rounded(
    series.second_derivative(b.ship_series(spark, folder), b.SHIP_KEYS, "week", "qty").select(
        *b.SHIP_KEYS, "week", "second_derivative"
    ),
    ["second_derivative"],
)
SQL["second_derivative"] = f"""WITH {b.SQL_SHIP_SERIES},
f AS (SELECT *, qty - lag(qty) OVER (PARTITION BY nation, flag ORDER BY week) AS d1 FROM ship_series)
SELECT nation, flag, week, round(d1 - lag(d1) OVER (PARTITION BY nation, flag ORDER BY week), 6) AS second_derivative FROM f"""

Q["local_maxima"] = lambda spark, folder: series.local_maxima(
    b.ship_series(spark, folder), b.SHIP_KEYS, "week", "lines"
).select(*b.SHIP_KEYS, "week", "is_peak")
SQL["local_maxima"] = f"""WITH {b.SQL_SHIP_SERIES}
SELECT nation, flag, week, CASE WHEN lines > lag(lines) OVER w AND lines > lead(lines) OVER w THEN 1 ELSE 0 END AS is_peak
FROM ship_series WINDOW w AS (PARTITION BY nation, flag ORDER BY week)"""


def methodology_metrics(spark, folder):
    s = b.ship_series(spark, folder)
    extent = series.axis_extent(s, b.SHIP_KEYS, "week").select(
        *b.SHIP_KEYS, (F.col("max_minute") - F.col("min_minute") + 1).alias("duration")
    )
    return series.methodology_metrics(s.join(extent, b.SHIP_KEYS), b.SHIP_KEYS, "week", "lines", "duration").drop(
        "duration"
    )


Q["methodology_metrics"] = methodology_metrics
SQL["methodology_metrics"] = f"""WITH {b.SQL_SHIP_SERIES},
extent AS (SELECT nation, flag, max(week) - min(week) + 1 AS duration FROM ship_series GROUP BY ALL),
windows AS ({" UNION ALL ".join(f'''SELECT nation, flag, week, duration, CAST({n} AS BIGINT) AS window_size, avg(lines) OVER (PARTITION BY nation, flag
ORDER BY week ROWS BETWEEN {x} PRECEDING AND {y} FOLLOWING) AS s FROM ship_series JOIN extent USING (nation, flag)''' for n, (x, y) in series.SMOOTHING_FRAMES.items())}),
d1 AS (SELECT *, s - lag(s) OVER w AS f FROM windows WINDOW w AS (PARTITION BY nation, flag, window_size ORDER BY week)),
d2 AS (SELECT *, f - lag(f) OVER w AS g, CASE WHEN s > lag(s) OVER w AND s > lead(s) OVER w THEN 1 ELSE 0 END AS p
  FROM d1 WINDOW w AS (PARTITION BY nation, flag, window_size ORDER BY week))
SELECT nation, flag, window_size, round(stddev(g), 4) AS noise_level, CAST(sum(p) AS BIGINT) AS peak_count,
  round(avg(s), 4) AS avg_intensity, round(window_size::DOUBLE / duration::DOUBLE * 100, 2) AS temporal_precision_loss_pct,
  window_size = 10 AS is_recommended
FROM d2 WHERE g IS NOT NULL GROUP BY nation, flag, window_size, duration"""

Q["noise_reduction"] = lambda spark, folder: b.rounded(
    series.noise_reduction(b.ship_series(spark, folder), b.SHIP_KEYS, "week", b.SHIP_DIMS, 10),
    ["avg_noise_reduction_pct", "avg_volatility"],
    4,
)
SQL["noise_reduction"] = f"""WITH {b.SQL_SHIP_SERIES},
s AS (SELECT *, {", ".join(f'avg({d}) OVER (PARTITION BY nation, flag ORDER BY week ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS {d}_s' for d in b.SHIP_DIMS)} FROM ship_series),
steps AS (SELECT nation, flag, {", ".join(f'abs({d} - lag({d}) OVER w) AS {d}_rd, abs({d}_s - lag({d}_s) OVER w) AS {d}_sd' for d in b.SHIP_DIMS)}
  FROM s WINDOW w AS (PARTITION BY nation, flag ORDER BY week)),
spread AS (SELECT nation, flag, count(*) AS n, {", ".join(f'stddev({d}_rd) AS {d}_r, stddev({d}_sd) AS {d}_v' for d in b.SHIP_DIMS)} FROM steps GROUP BY ALL)
SELECT nation, flag, CAST(10 AS BIGINT) AS window_size,
  round(coalesce(list_avg(list_filter([{", ".join(f'CASE WHEN {d}_r > 0 THEN ({d}_r - {d}_v) / {d}_r * 100 ELSE 0.0 END' for d in b.SHIP_DIMS)}], lambda x: x IS NOT NULL)), 0.0), 4) AS avg_noise_reduction_pct,
  round(coalesce(list_avg(list_filter([{", ".join(f'{d}_v' for d in b.SHIP_DIMS)}], lambda x: x IS NOT NULL)), 0.0), 4) AS avg_volatility, n AS data_points
FROM spread"""

Q["unpivot_dims"] = lambda spark, folder: b.rounded(
    series.unpivot_dims(b.event_series(spark, folder), ["user_id", "minute_offset"], E_DIMS), ["score"]
)
SQL["unpivot_dims"] = f"""WITH {b.SQL_EVENT_SERIES}, long AS ({_sql_long('event_series', 'user_id, minute_offset', E_DIMS)})
SELECT user_id, minute_offset, dimension, round(score, 6) AS score FROM long"""

Q["top_k_per_group"] = lambda spark, folder: ordered.top_k(
    b.table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice"),
    ["o_custkey"],
    [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()],
    5,
)
SQL["top_k_per_group"] = """SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (
SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
WHERE rank <= 5"""

Q["intensity_rank"] = lambda spark, folder: b.rounded(
    series.intensity_rank(b.event_series(spark, folder), ["user_id"], "minute_offset", E_DIMS, "dialogue_count", 50).select(
        "user_id", "minute_offset", "intensity", "rank"
    ),
    ["intensity"],
)
SQL["intensity_rank"] = f"""WITH {b.SQL_EVENT_SERIES},
r AS (SELECT user_id, minute_offset, click + error + purchase + signup + "view" AS intensity,
  row_number() OVER (PARTITION BY user_id ORDER BY click + error + purchase + signup + "view" DESC, minute_offset) AS rank
  FROM event_series WHERE dialogue_count > 0)
SELECT user_id, minute_offset, round(intensity, 6) AS intensity, rank FROM r WHERE rank <= 50"""


def _event_islands(spark, folder, chunk_width):
    s = b.event_series(spark, folder).select("user_id", "minute_offset", F.round("click", 6).alias("score"))
    return series.cluster_peaks(s, ["user_id"], "minute_offset", "score", 5, chunk_width)


Q["cluster_peaks"] = lambda spark, folder: _event_islands(spark, folder, 24)
SQL["cluster_peaks"] = f"""WITH {b.SQL_EVENT_SERIES},
s AS (SELECT user_id, minute_offset, round(click, 6) AS score FROM event_series),
m AS (SELECT *, CASE WHEN minute_offset - lag(minute_offset) OVER w <= 5 THEN 0 ELSE 1 END AS fresh FROM s
  WINDOW w AS (PARTITION BY user_id ORDER BY minute_offset)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY minute_offset) AS island FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY score DESC, minute_offset) AS rn FROM i)
SELECT user_id, min(minute_offset) AS start, max(minute_offset) AS "end", max(score) AS intensity,
  max(CASE WHEN rn = 1 THEN minute_offset END) AS center, count(*) AS members
FROM r GROUP BY user_id, island"""


def _top_clicks(spark, folder, k=3):
    return ordered.top_k(
        b.event_series(spark, folder), ["user_id"], [F.col("click").desc(), F.col("minute_offset").asc()], k
    ).select("user_id", "minute_offset")


_SQL_TOP_CLICKS = """top_clicks AS (SELECT user_id, minute_offset FROM (SELECT *, row_number() OVER (PARTITION BY user_id
  ORDER BY click DESC, minute_offset) AS rn FROM event_series) WHERE rn <= 3)"""

Q["context_window"] = lambda spark, folder: series.context_window(
    _top_clicks(spark, folder), ["user_id"], "minute_offset", 2
)
SQL["context_window"] = f"""WITH {b.SQL_EVENT_SERIES}, {_SQL_TOP_CLICKS}
SELECT DISTINCT user_id, unnest(generate_series(greatest(minute_offset - 2, 0), minute_offset + 2)) AS minute_offset FROM top_clicks"""


def _timed_events(spark, folder):
    return b.event_lines(spark, folder).select(
        "user_id", "event_id", "seconds", (F.col("seconds") + F.col("value")).alias("end")
    )


Q["gaps"] = lambda spark, folder: b.rounded(
    series.gaps(_timed_events(spark, folder), ["user_id"], "seconds", "end", 7200.0, 86400.0, "event_id"),
    ["largest_gap"],
    3,
)
SQL["gaps"] = f"""WITH {b.SQL_EVENT_LINES},
g AS (SELECT user_id, seconds - lag(seconds + value) OVER (PARTITION BY user_id ORDER BY seconds, event_id) AS pause FROM event_lines)
SELECT user_id, count(CASE WHEN pause > 7200 THEN 1 END) AS gap_count, round(max(CASE WHEN pause > 7200 THEN pause END), 3) AS largest_gap,
  count(*) AS line_count FROM g GROUP BY user_id"""

Q["sequence_check"] = lambda spark, folder: series.sequence_check_chunked(
    b.event_lines(spark, folder).select("user_id", "seconds", "event_id", F.col("event_id").alias("number")),
    ["user_id"],
    ["seconds", "event_id"],
    "number",
    F.floor(F.col("seconds") / 86400),
)
SQL["sequence_check"] = f"""WITH {b.SQL_EVENT_LINES},
n AS (SELECT user_id, seconds, event_id, event_id AS number, row_number() OVER (PARTITION BY user_id ORDER BY seconds, event_id) AS expected_number FROM event_lines)
SELECT * FROM n WHERE number <> expected_number"""

Q["surrogate_row_ids"] = lambda spark, folder: ordered.global_row_ids(
    b.table(spark, folder, "orders").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"]
)
SQL["surrogate_row_ids"] = """SELECT o_custkey, o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS row_id FROM orders"""

Q["axis_extent"] = lambda spark, folder: series.axis_extent(b.event_series(spark, folder), ["user_id"], "minute_offset")
SQL["axis_extent"] = f"""WITH {b.SQL_EVENT_SERIES}
SELECT user_id, coalesce(min(minute_offset), 0) AS min_minute, coalesce(max(minute_offset), 0) AS max_minute FROM event_series GROUP BY user_id"""

Q["interval_join_minute"] = lambda spark, folder: series.lines_of_peaks(
    _top_clicks(spark, folder),
    b.event_lines(spark, folder).select("user_id", "event_id", "seconds"),
    ["user_id"],
    "minute_offset",
    "seconds",
    b.EVENT_WIDTH,
)
SQL["interval_join_minute"] = f"""WITH {b.SQL_EVENT_SERIES}, {_SQL_TOP_CLICKS}
SELECT t.user_id, t.minute_offset, l.event_id, l.seconds FROM top_clicks t JOIN event_lines l
ON t.user_id = l.user_id AND l.seconds >= t.minute_offset * 3600 AND l.seconds < (t.minute_offset + 1) * 3600"""


def interval_join_nearest(spark, folder):
    peaks = _top_clicks(spark, folder).select("user_id", (F.col("minute_offset") * b.EVENT_WIDTH).alias("center"))
    lines = b.event_lines(spark, folder).select("user_id", "event_id", "seconds")
    return series.nearest_lines(peaks, lines, ["user_id"], "center", "seconds", 21600, 3, tie="event_id")


Q["interval_join_nearest"] = interval_join_nearest
SQL["interval_join_nearest"] = f"""WITH {b.SQL_EVENT_SERIES}, {_SQL_TOP_CLICKS},
n AS (SELECT t.user_id, t.minute_offset * 3600 AS center, l.event_id, l.seconds, abs(l.seconds - t.minute_offset * 3600) AS distance,
  row_number() OVER (PARTITION BY t.user_id, t.minute_offset ORDER BY abs(l.seconds - t.minute_offset * 3600), l.seconds, l.event_id) AS rank
  FROM top_clicks t JOIN event_lines l ON t.user_id = l.user_id AND abs(l.seconds - t.minute_offset * 3600) <= 21600)
SELECT * FROM n WHERE rank <= 3"""

Q["global_top_k"] = lambda spark, folder: profiles.global_top_k(
    b.event_series(spark, folder).select("user_id", "minute_offset", F.round("purchase", 6).alias("purchase")),
    "purchase", 5, ["user_id", "minute_offset"],
)
SQL["global_top_k"] = f"""WITH {b.SQL_EVENT_SERIES}
SELECT user_id, minute_offset, round(purchase, 6) AS purchase FROM event_series ORDER BY round(purchase, 6) DESC, user_id, minute_offset LIMIT 5"""


def peaks_valleys(spark, folder):
    out = profiles.peaks_valleys(
        b.ship_series(spark, folder), b.SHIP_KEYS, "week", b.SHIP_POSITIVE, b.SHIP_NEGATIVE, k=5, threshold=0.01
    )
    return out.select(
        *b.SHIP_KEYS, "week", "side", "rank", F.round("compound", 6).alias("compound"),
        F.transform("top_dims", lambda x: x["name"]).alias("top_names"), "dominant",
    )


def _sql_top(cols: list[str], n: int) -> str:
    items = ", ".join(f"{{'s': -{c}, 'i': {i}, 'name': '{c}'}}" for i, c in enumerate(cols))
    return f"list_transform(list_slice(list_sort([{items}]), 1, {n}), lambda x: x.name)"


Q["peaks_valleys"] = peaks_valleys
SQL["peaks_valleys"] = f"""WITH {b.SQL_SHIP_SERIES},
c AS (SELECT *, (qty + price + net) / 3.0 - (disc + tax) / 2.0 AS compound FROM ship_series),
f AS (SELECT * FROM c WHERE abs(compound) > 0.01),
p AS (SELECT *, 'positive' AS side, row_number() OVER (PARTITION BY nation, flag ORDER BY compound DESC, week) AS rank, {_sql_top(b.SHIP_POSITIVE, 3)} AS top_names FROM f),
n AS (SELECT *, 'negative' AS side, row_number() OVER (PARTITION BY nation, flag ORDER BY compound ASC, week) AS rank, {_sql_top(b.SHIP_NEGATIVE, 3)} AS top_names FROM f)
SELECT nation, flag, week, side, rank, round(compound, 6) AS compound, top_names, top_names[1] AS dominant
FROM (SELECT * FROM p UNION ALL SELECT * FROM n) WHERE rank <= 5"""


def _turn_lines(spark, folder):
    """Turns as timed lines: a turn starts every 45 s and lasts as long as it takes to read."""
    return b.table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        "role",
        (F.col("turn") * 45.0).alias("start"),
        (F.col("turn") * 45.0 + F.length("text") / 15.0).alias("end"),
        "text",
    )


Q["longest_lines"] = lambda spark, folder: series.longest_lines(
    _turn_lines(spark, folder).withColumn("minute_offset", text.minute_bucket("start")),
    ["conv_id", "minute_offset"],
    "text",
    3,
    80,
    "turn",
    buckets=series.context_window(
        _turn_lines(spark, folder).select("conv_id", text.minute_bucket("start").alias("minute_offset")),
        ["conv_id"], "minute_offset", 2,
    ),
)
SQL["longest_lines"] = """WITH l AS (SELECT conv_id, turn, text, CAST(floor(turn * 45.0 / 60) AS BIGINT) AS minute_offset FROM conversations),
w AS (SELECT DISTINCT conv_id, unnest(generate_series(greatest(minute_offset - 2, 0), minute_offset + 2)) AS minute_offset FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, minute_offset ORDER BY length(text) DESC, turn) AS rn FROM l WHERE trim(text) <> ''),
p AS (SELECT conv_id, minute_offset, list(CASE WHEN length(text) > 80 THEN text[1:77] || '...' ELSE text END ORDER BY rn) AS excerpts
  FROM r WHERE rn <= 3 GROUP BY ALL)
SELECT w.conv_id, w.minute_offset, coalesce(p.excerpts, ['[No dialogue]']) AS excerpts FROM w LEFT JOIN p USING (conv_id, minute_offset)"""
