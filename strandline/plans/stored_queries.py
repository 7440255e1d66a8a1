"""Queries over stored tables: keyed loads, gates, clustered marts, sketches, versions; with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import sketches, success, versions
from strandline.plans import base as b
from strandline.plans import reports
from strandline.plans.vector_queries import _event_stream
from strandline.session import scratch_path
from strandline.sources import clustered, gates, keyed

Q: dict = {}
SQL: dict[str, str] = {}
T = b.table


# --- keyed loads ----------------------------------------------------------------------


def _orders(s, f):
    return T(s, f, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


def keyed_load(s, f):
    """Two overlapping loads of orders, the second twice; keys are stored once."""
    path = scratch_path(s, "keyed-orders")
    first = _orders(s, f).where(F.pmod("o_orderkey", F.lit(3)) < 2)
    second = _orders(s, f).where(F.pmod("o_orderkey", F.lit(3)) > 0)
    for part in (first, second, second):
        keyed.load_keyed(part, path, ["o_orderkey"], 16)
    return keyed.keyed_table(s, path, first.schema).drop(keyed.BUCKET)


Q["keyed_load"] = keyed_load
SQL["keyed_load"] = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders"


def stream_keyed_load(s, f):
    """Every event arrives twice, its copy in a later micro-batch; what each batch brought and appended."""
    path, state = scratch_path(s, "keyed-events"), scratch_path(s, "keyed-events-state")
    twice = _event_stream(s, f, again=True).filter("event_id IS NOT NULL").select("event_id", "user_id", "value")
    keyed.load_keyed_batches(twice, path, ["event_id"], state, 16).awaitTermination()
    return keyed.keyed_table(s, path, twice.schema).groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("event_id").alias("keys"))


Q["stream_keyed_load"] = stream_keyed_load
SQL["stream_keyed_load"] = "SELECT user_id, count(*) AS events, count(DISTINCT event_id) AS keys FROM events GROUP BY 1"

# --- gates ----------------------------------------------------------------------------

def _rules():
    return [
        {"name": "key_not_null", "kind": "not_null", "column": "event_id"},
        {"name": "type_values", "kind": "accepted_values", "column": "event_type", "values": ["click", "purchase", "signup", "view"]},
        {"name": "value_small", "kind": "expression", "condition": F.col("value") < 400},
    ]


_SQL_FAILS = """SELECT {0} AS load, 'key_not_null' AS rule, count(*) FILTER (event_id IS NULL) AS failures, count(*) AS total FROM {1} GROUP BY {0}
UNION ALL SELECT {0}, 'type_values', count(*) FILTER (event_type = 'error'), count(*) FROM {1} GROUP BY {0}
UNION ALL SELECT {0}, 'value_small', count(*) FILTER (NOT coalesce(value < 400, false)), count(*) FROM {1} GROUP BY {0}"""


def gated_write(s, f):
    """Events by user, each load gated by itself: figures of every rule, and the rows that are left."""
    path, events = scratch_path(s, "gated"), T(s, f, "events").select("event_id", "user_id", "event_type", "value")
    out = None
    for load in range(4):
        part = events.where(F.pmod("user_id", F.lit(4)) == load)
        most = {"type_values": 10**9} if load == 1 else {"type_values": 10**9, "value_small": 10**9} if load == 3 else {}
        rows = gates.gated_write(part, path, _rules(), load, most).rows(s, load)
        out = rows if out is None else out.unionAll(rows)
    stored = s.read.schema(events.schema).parquet(path).agg(F.count(F.lit(1)).alias("stored"))
    return out.withColumn("stored", stored.scalar())


Q["gated_write"] = gated_write
SQL["gated_write"] = f"""WITH e AS (SELECT *, CAST(user_id % 4 AS VARCHAR) AS l FROM events), r AS ({_SQL_FAILS.format("l", "e")}),
k AS (SELECT load, bool_and(failures <= CASE WHEN rule = 'type_values' AND load IN ('1', '3') OR rule = 'value_small' AND load = '3' THEN 1000000000 ELSE 0 END) AS kept FROM r GROUP BY 1)
SELECT r.*, kept, (SELECT count(*) FROM e JOIN k ON l = load WHERE kept) AS stored FROM r JOIN k USING (load)"""


def stream_gated_write(s, f):
    path, state = scratch_path(s, "gated-stream"), scratch_path(s, "gated-stream-state")
    rows = _event_stream(s, f).filter("event_id IS NOT NULL").select("event_id", "event_type", "value")
    gates.stream_gated_write(rows, path, _rules(), state, {"type_values": 10**9, "value_small": 10**9}).awaitTermination()
    figures = s.read.schema("load string, rule string, failures bigint, total bigint, kept boolean").parquet(f"{path}-verdicts/*")
    return figures.groupBy("rule").agg(F.sum("failures").cast("bigint").alias("failures"), F.sum("total").cast("bigint").alias("total"), F.min("kept").alias("kept"))


Q["stream_gated_write"] = stream_gated_write
SQL["stream_gated_write"] = "WITH x AS (" + _SQL_FAILS.format("'all'", "events").replace(" GROUP BY 'all'", "") + ") SELECT rule, failures, total, true AS kept FROM x"

# --- clustered marts ---------------------------------------------------------------------


def clustered_lookup(s, f):
    """A mart of all series, clustered by nation and flag, and one nation's rows of it."""
    path = scratch_path(s, "clustered-mart")
    clustered.write_clustered(b.rounded(b.ship_series(s, f), b.SHIP_DIMS), path, ["nation", "flag"], files=4)
    return clustered.clustered_lookup(s, path, {"nation": "nation_7", "flag": None})


Q["clustered_lookup"] = clustered_lookup
SQL["clustered_lookup"] = f"WITH {b.SQL_SHIP_SERIES} SELECT nation, flag, week, lines, {b.sql_rounded(b.SHIP_DIMS)} FROM ship_series WHERE nation = 'NATION_7'"

# --- sketches --------------------------------------------------------------------------


def _daily_sketches(s, f):
    """Sketches of users and values by event type and day, stored day after day in three loads."""
    path = scratch_path(s, "daily-sketches")
    events = T(s, f, "events").select("event_type", "user_id", "value", F.floor(b.seconds_since("ts", "2024-01-01") / 86400).cast("int").alias("day"))
    for part in range(3):
        sketches.append_sketches(events.where(F.pmod(F.floor(F.col("day") / 10), F.lit(3)) == part), path, ["event_type"], "day", item="user_id", value="value")
    return s.read.schema("event_type string, rows bigint, distinct_sketch binary, value_sketch binary, day int").parquet(path)


def sketched_coverage(s, f):
    """Rows and distinct users per event type and in all from stored sketches; exact while users are few."""
    daily = _daily_sketches(s, f)
    by_type = sketches.rolled_up(daily, ["event_type"])
    every = sketches.rolled_up(by_type, []).withColumn("event_type", F.lit("_ALL_"))
    return by_type.unionByName(every).select("event_type", "rows", sketches.distinct_count().alias("users"))


# The estimates aren't exact in general: the tests hold their error against exact counts.
Q["sketched_coverage"] = sketched_coverage


def sketched_rows(s, f):
    """What sketches hold exactly: rows a type, and the least and greatest value."""
    rolled = sketches.rolled_up(_daily_sketches(s, f), ["event_type"])
    ends = sketches.quantiles([0.0, 1.0])
    return rolled.select("event_type", "rows", F.get(ends, F.lit(0)).alias("least"), F.get(ends, F.lit(1)).alias("most"))


Q["sketched_rows"] = sketched_rows
SQL["sketched_rows"] = 'SELECT event_type, count(*) AS "rows", min(value) AS least, max(value) AS most FROM events GROUP BY 1'


def sketched_tiers(s, f):
    """Rows whose class by merged sketches differs from the exact one, as a share; rank error stated in the module."""
    events = T(s, f, "events").select("event_id", "value")
    tiers = sketches.sketched_tiers(events, "value", _daily_sketches(s, f))
    exact = success.quartile_tier(tiers, "value", "exact")
    return exact.groupBy("exact").agg(F.count(F.lit(1)).alias("rows"), F.avg((F.col("tier") != F.col("exact")).cast("double")).alias("share_apart"))


Q["sketched_tiers"] = sketched_tiers

# --- versions --------------------------------------------------------------------------


def _versions(s, f):
    old = T(s, f, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    keep = old.where(F.pmod("o_orderkey", F.lit(401)) != 7)
    price = F.when(F.pmod("o_orderkey", F.lit(307)) == 5, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    status = F.when(F.pmod("o_orderkey", F.lit(503)) != 9, F.col("o_orderstatus"))
    new = keep.withColumns({"o_totalprice": price, "o_orderstatus": status})
    return old, new.unionByName(old.where(F.pmod("o_orderkey", F.lit(401)) == 8).withColumn("o_orderkey", -F.col("o_orderkey")))


_SQL_VERSIONS = """n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 503 <> 9 THEN o_orderstatus END AS st, o_totalprice + CASE WHEN o_orderkey % 307 = 5 THEN 1 ELSE 0 END AS p FROM orders WHERE o_orderkey % 401 <> 7),
c AS (SELECT o_orderkey, 'changed' AS change, list_filter([CASE WHEN st IS DISTINCT FROM o_orderstatus THEN 'o_orderstatus' END, CASE WHEN p <> o_totalprice THEN 'o_totalprice' END], lambda x: x IS NOT NULL) AS differing FROM n JOIN orders USING (o_orderkey)
UNION ALL SELECT o_orderkey, 'removed', [] FROM orders WHERE o_orderkey % 401 = 7 UNION ALL SELECT -o_orderkey, 'added', [] FROM orders WHERE o_orderkey % 401 = 8)"""
Q["compare_versions"] = lambda s, f: versions.compare_versions(*_versions(s, f), ["o_orderkey"])
SQL["compare_versions"] = f"WITH {_SQL_VERSIONS} SELECT * FROM c WHERE change <> 'changed' OR len(differing) > 0"


def compare_stored(s, f):
    """The same from two stored versions: only folders of leaves that differ are read."""
    old, new = _versions(s, f)
    paths = [scratch_path(s, n) for n in ("version-old", "version-new")]
    for side, path in zip((old, new), paths):
        versions.write_version(side, path, ["o_orderkey"])
    return versions.compare_stored(*paths, old.schema, s, ["o_orderkey"])[0]


Q["compare_stored"] = compare_stored
SQL["compare_stored"] = SQL["compare_versions"]

# --- queries by parsed plan ----------------------------------------------------------------


def safe_select_nested(s, f):
    """A query with common table expressions, a nested query and words that a text test would refuse."""
    T(s, f, "orders").withColumn("created_at", F.col("o_orderdate")).createOrReplaceTempView("report_orders")
    T(s, f, "customer").createOrReplaceTempView("report_customers")
    sql = """WITH rich AS (SELECT c_custkey FROM report_customers WHERE c_acctbal > (SELECT avg(c_acctbal) FROM report_customers)) -- no update
SELECT o_orderpriority, count(*) AS n, year(max(created_at)) AS last FROM report_orders JOIN rich ON o_custkey = c_custkey GROUP BY 1"""
    return reports.safe_select(s, sql, ["report_orders", "report_customers"])


Q["safe_select_nested"] = safe_select_nested
SQL["safe_select_nested"] = """WITH rich AS (SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer))
SELECT o_orderpriority, count(*) AS n, CAST(year(max(o_orderdate)) AS INTEGER) AS last FROM orders JOIN rich ON o_custkey = c_custkey GROUP BY 1"""
