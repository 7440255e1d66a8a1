"""Cleaning, matching, set and source queries, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import text
from strandline.operators import cleaning, matching
from strandline.plans import base as b
from strandline.session import scratch_path
from strandline.sources import readers, writers

Q: dict = {}
SQL: dict[str, str] = {}
WS = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]+"
SQL_CLEAN = "coalesce(trim(regexp_replace(regexp_replace({0}, '<[^>]+>', '', 'g'), '" + WS + "', ' ', 'g')), '')"


def _raw_orders(s, f):
    """Orders as an API would deliver them: every value a text."""
    o = b.table(s, f, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_orderpriority").alias("title"),
        F.year("o_orderdate").cast("string").alias("release_date"),
        F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.floor(F.col("o_totalprice") / 1000).cast("string")).alias("running_time"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("director"),
    )


_SQL_RAW = """raw AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS title, CAST(year(o_orderdate) AS VARCHAR) AS release_date,
CASE WHEN o_orderstatus = 'P' THEN 'n/a' ELSE CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS VARCHAR) END AS running_time,
CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS director FROM orders)"""
Q["stage_films"] = lambda s, f: cleaning.stage_films(
    _raw_orders(s, f).select(
        "*",
        F.col("id").cast("string").alias("rt_score"),
        F.when(F.col("title") != "", F.col("title")).alias("producer"),
        F.lit(None).cast("string").alias("description"),
        *[F.lit("x").alias(c) for c in ("original_title", "original_title_romanised", "url")],
    )
)
SQL["stage_films"] = f"""WITH {_SQL_RAW} SELECT id, title, TRY_CAST(release_date AS INTEGER) AS release_year, TRY_CAST(running_time AS INTEGER) AS running_time,
coalesce(director, '') AS director, CAST(id AS INTEGER) AS rt_score, CASE WHEN title <> '' THEN title ELSE '' END AS producer, '' AS description FROM raw"""
Q["stage_people"] = lambda s, f: cleaning.stage_people(
    b.table(s, f, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_nationkey") % 3 == 0, "Male").when(F.col("c_nationkey") % 3 == 1, "Female").otherwise(F.col("c_mktsegment")).alias("gender"),
        F.when(F.col("c_acctbal") > 0, F.concat(F.lit("https://api.example/species/"), F.col("c_nationkey"))).otherwise("").alias("species"),
        F.lit("https://api.example/people").alias("url"),
    )
)
SQL["stage_people"] = """SELECT c_custkey AS id, c_name AS name, CASE c_nationkey % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' END AS gender,
CASE WHEN c_acctbal > 0 THEN CAST(c_nationkey AS VARCHAR) END AS species_id FROM customer"""
Q["stage_locations"] = lambda s, f: cleaning.stage_locations(
    b.table(s, f, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).alias("climate"),
        F.when(F.col("l_linestatus") == "O", F.col("l_linestatus")).alias("terrain"),
        F.when(F.col("l_discount") > 0, F.concat(F.round(F.col("l_discount") * 100, 0).cast("int").cast("string"), F.lit("%"))).otherwise("").alias("surface_water"),
        F.lit("u").alias("url"),
    )
)
SQL["stage_locations"] = """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'A' THEN l_returnflag ELSE '' END AS climate, CASE WHEN l_linestatus = 'O' THEN l_linestatus ELSE '' END AS terrain,
CASE WHEN l_discount > 0 THEN CAST(replace(CAST(CAST(round(l_discount * 100, 0) AS INTEGER) AS VARCHAR) || '%', '%', '') AS DOUBLE) END AS surface_water_pct FROM lineitem"""
Q["stage_financials"] = lambda s, f: cleaning.stage_financials(
    b.table(s, f, "part").select(
        "p_partkey",
        F.concat("p_name", F.lit(" (1986)")).alias("name"),
        F.concat((F.col("p_size") % 5).cast("string"), F.lit("h "), (F.col("p_partkey") % 60).cast("string"), F.lit("m")).alias("duration"),
        F.when(F.col("p_size") > 25, F.concat(F.lit("$"), F.col("p_size").cast("string"), F.lit(",000"))).otherwise("unknown").alias("budget"),
        F.col("p_partkey").cast("string").alias("revenue"),
    )
)
SQL["stage_financials"] = """SELECT p_partkey, p_name || ' (1986)' AS name, p_name AS title, CAST((p_size % 5) * 60 + p_partkey % 60 AS INTEGER) AS duration,
CASE WHEN p_size > 25 THEN p_size * 1000.0::DOUBLE ELSE 0.0::DOUBLE END AS budget, CAST(p_partkey AS DOUBLE) AS revenue FROM part"""
Q["stage_species"] = lambda s, f: cleaning.stage_species(
    b.table(s, f, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("classification"),
        F.col("p_brand").alias("eye_colors"), F.col("p_size").alias("hair_colors"), "p_retailprice",
    )
)
SQL["stage_species"] = "SELECT p_partkey AS id, p_name AS name, p_type AS classification, p_brand AS eye_colors, p_size AS hair_colors FROM part"


def _durations(s, f):
    return b.table(s, f, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", F.concat((F.col("o_custkey") % 5).cast("string"), F.lit("h "), (F.col("o_orderkey") % 60).cast("string"), F.lit("m")))
        .when(F.col("o_orderpriority") == "1-URGENT", F.concat((F.col("o_custkey") % 5).cast("string"), F.lit("h")))
        .when(F.col("o_orderpriority") == "2-HIGH", F.concat((F.col("o_orderkey") % 200).cast("string"), F.lit("m")))
        .when(F.col("o_orderpriority") == "3-MEDIUM", (F.col("o_orderkey") % 200).cast("string"))
        .otherwise("about 2 hours").alias("duration"),
    )


_SQL_DUR = """d AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN (o_custkey % 5) || 'h ' || (o_orderkey % 60) || 'm'
WHEN o_orderpriority = '1-URGENT' THEN (o_custkey % 5) || 'h' WHEN o_orderpriority = '2-HIGH' THEN (o_orderkey % 200) || 'm'
WHEN o_orderpriority = '3-MEDIUM' THEN CAST(o_orderkey % 200 AS VARCHAR) ELSE 'about 2 hours' END AS duration FROM orders)"""
Q["parse_duration"] = lambda s, f: _durations(s, f).select("o_orderkey", text.parse_duration("duration").alias("minutes"))
SQL["parse_duration"] = f"""WITH {_SQL_DUR} SELECT o_orderkey, CASE WHEN regexp_full_match(duration, '\\d+h\\s+\\d+m') THEN
CAST(regexp_extract(duration, '^(\\d+)h', 1) AS INTEGER) * 60 + CAST(regexp_extract(duration, '(\\d+)m$', 1) AS INTEGER)
WHEN regexp_full_match(duration, '\\d+h') THEN CAST(regexp_extract(duration, '^(\\d+)h', 1) AS INTEGER) * 60
WHEN regexp_full_match(duration, '\\d+m') THEN CAST(regexp_extract(duration, '^(\\d+)m', 1) AS INTEGER)
WHEN regexp_full_match(duration, '\\d+') THEN CAST(duration AS INTEGER) END AS minutes FROM d"""


def _titles(s, f):
    """Part names written as messy titles: year suffixes, newlines, accents, blanks."""
    p = b.table(s, f, "part")
    return p.select(
        "p_partkey",
        F.when(F.col("p_size") % 4 == 0, F.concat("p_name", F.lit("\n       ("), (F.col("p_size") + 1980).cast("string"), F.lit(")")))
        .when(F.col("p_size") % 4 == 1, F.concat(F.lit("Élan  "), F.initcap("p_name"), F.lit(" ("), (F.col("p_size") + 1980).cast("string"), F.lit(") ")))
        .when(F.col("p_size") % 4 == 2, F.concat(F.lit("  "), F.col("p_name"), F.lit(" "), (F.col("p_size") + 1980).cast("string")))
        .otherwise(F.concat(F.initcap("p_name"), F.lit("'s \"Tale\" - "), F.col("p_brand"))).alias("title"),
    )


_CAP = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
_SQL_TITLES = f"""t AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_name || chr(10) || '       (' || (p_size + 1980) || ')'
WHEN 1 THEN 'Élan  ' || {_CAP} || ' (' || (p_size + 1980) || ') ' WHEN 2 THEN '  ' || p_name || ' ' || (p_size + 1980)
ELSE {_CAP} || '''s "Tale" - ' || p_brand END AS title FROM part)"""
Q["clean_title"] = lambda s, f: _titles(s, f).select("p_partkey", text.clean_title("title").alias("title"))
SQL["clean_title"] = f"""WITH {_SQL_TITLES} SELECT p_partkey, trim(regexp_replace(regexp_replace(title, '\\n.*', ''), '\\s*\\([0-9]{{4}}\\)\\s*$', '')) AS title FROM t"""
Q["normalize_title"] = lambda s, f: _titles(s, f).select("p_partkey", text.normalize_title("title").alias("title"))
_SQL_NORM = f"trim(translate(lower(regexp_replace(regexp_replace(trim(regexp_replace(title, '{WS}', ' ', 'g')), '\\s*\\([0-9]{{4}}\\)\\s*$', ''), '\\s+[0-9]{{4}}\\s*$', '')), 'äöüéèêàâîïç', 'aoueeeaaiic'))"
SQL["normalize_title"] = f"WITH {_SQL_TITLES} SELECT p_partkey, {_SQL_NORM} AS title FROM t"
Q["slugify"] = lambda s, f: _titles(s, f).select("p_partkey", text.slugify("title").alias("slug"))
SQL["slugify"] = f"""WITH {_SQL_TITLES} SELECT p_partkey, trim(regexp_replace(regexp_replace(replace(lower(title), ' ', '_'), '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '_') AS slug FROM t"""


def _slugs(s, f):
    return b.table(s, f, "documents").select(
        "doc_id", "source", "lang",
        F.concat("source", F.lit("_story_"), F.col("lang"), F.when(F.col("n_chars") % 2 == 0, F.lit("_v2")).otherwise(F.lit(""))).alias("slug"),
    )


_SQL_SLUGS = """sl AS (SELECT doc_id, source, lang, source || '_story_' || lang || CASE WHEN n_chars % 2 = 0 THEN '_v2' ELSE '' END AS slug FROM documents)"""
Q["strip_slug_suffix"] = lambda s, f: _slugs(s, f).select(
    "doc_id", text.strip_version_and_language("slug").alias("base"), text.strip_language("slug").alias("short")
)
SQL["strip_slug_suffix"] = f"""WITH {_SQL_SLUGS} SELECT doc_id, regexp_replace(regexp_replace(slug, '_v[0-9]+$', ''), '_(en|fr|es|nl|ar)$', '') AS base,
regexp_replace(slug, '_[a-z]{{2}}$', '') AS short FROM sl"""
Q["title_from_slug"] = lambda s, f: _slugs(s, f).select("doc_id", text.title_from_slug("slug").alias("title"))
SQL["title_from_slug"] = f"WITH {_SQL_SLUGS} SELECT doc_id, array_to_string(list_transform(string_split(slug, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title FROM sl"


def _money(s, f):
    return b.table(s, f, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("$"), F.format_number("o_totalprice", 2)))
        .when(F.col("o_orderstatus") == "O", F.format_string(" %.2f ", "o_totalprice"))
        .when(F.col("o_orderpriority") == "1-URGENT", F.lit("Unknown")).when(F.col("o_orderpriority") == "2-HIGH", F.lit(""))
        .alias("money"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.year("o_orderdate").cast("string"), F.lit(".0")))
        .when(F.col("o_orderstatus") == "O", F.year("o_orderdate").cast("string")).otherwise("c. 1990").alias("year"),
    )


Q["clean_currency"] = lambda s, f: _money(s, f).select("o_orderkey", text.clean_currency("money").alias("amount"))
SQL["clean_currency"] = "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_totalprice ELSE 0.0::DOUBLE END AS amount FROM orders"
Q["safe_int"] = lambda s, f: _money(s, f).select("o_orderkey", text.safe_int("year").alias("year"))
SQL["safe_int"] = "SELECT o_orderkey, CAST(CASE WHEN o_orderstatus IN ('F', 'O') THEN year(o_orderdate) ELSE 0 END AS INTEGER) AS year FROM orders"


def _holes(s, f):
    o = b.table(s, f, "orders")
    return o.select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("priority"),
    )


_SQL_HOLES = "h AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS price, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS priority FROM orders)"
Q["fill_missing"] = lambda s, f: cleaning.fill_missing(_holes(s, f), ["price"], ["priority"])
SQL["fill_missing"] = f"WITH {_SQL_HOLES} SELECT o_orderkey, coalesce(price, 0) AS price, coalesce(priority, 'Unknown') AS priority FROM h"
Q["missing_counts"] = lambda s, f: cleaning.missing_counts(_holes(s, f), ["price", "priority"])
SQL["missing_counts"] = f"WITH {_SQL_HOLES} SELECT 'price' AS \"column\", count(*) - count(price) AS missing FROM h UNION ALL SELECT 'priority', count(*) - count(priority) FROM h"

Q["clean_text"] = lambda s, f: b.table(s, f, "pages").select("page_id", text.clean_text("html").alias("text"))
SQL["clean_text"] = f"SELECT page_id, {SQL_CLEAN.replace('{0}', 'html')} AS text FROM pages"
Q["truncate_text"] = lambda s, f: b.table(s, f, "documents").select(
    "doc_id", text.truncate_text("text", 80).alias("short"), text.truncate_text("text", 500).alias("medium"),
    text.truncate_text("text", 200, 200).alias("plus"),
)
SQL["truncate_text"] = """SELECT doc_id, CASE WHEN length(text) > 80 THEN text[1:77] || '...' ELSE text END AS short,
CASE WHEN length(text) > 500 THEN text[1:497] || '...' ELSE text END AS medium, CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE text END AS plus FROM documents"""
Q["truncate_words"] = lambda s, f: b.table(s, f, "documents").select("doc_id", text.truncate_words("text", 450).alias("text"))
_SQL_WORDS = "list_filter(regexp_split_to_array({0}, '" + WS + "'), lambda w: w <> '')"
SQL["truncate_words"] = f"""WITH w AS (SELECT doc_id, text, {_SQL_WORDS.replace('{0}', 'text')} AS ws FROM documents)
SELECT doc_id, CASE WHEN len(ws) > 450 THEN array_to_string(ws[1:450], ' ') ELSE text END AS text FROM w"""
Q["composite_key"] = lambda s, f: b.table(s, f, "lineitem").select(
    "l_orderkey", "l_linenumber", "l_partkey",
    text.composite_key("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey").alias("key"), text.stable_id("flag_", "l_returnflag").alias("flag_id")
)
SQL["composite_key"] = "SELECT l_orderkey, l_linenumber, l_partkey, concat_ws('_', l_orderkey, l_linenumber, l_returnflag, l_partkey) AS key, 'flag_' || md5(l_returnflag) AS flag_id FROM lineitem"
Q["build_json_props"] = lambda s, f: b.table(s, f, "part").select(
    "p_partkey", text.json_props(brand=F.col("p_brand"), size=F.when(F.col("p_size") > 25, F.col("p_size"))).alias("props")
)
SQL["build_json_props"] = "SELECT p_partkey, CAST(json_object('brand', p_brand, 'size', CASE WHEN p_size > 25 THEN p_size END) AS VARCHAR) AS props FROM part"
Q["parse_json_props"] = lambda s, f: b.table(s, f, "events").select(
    "event_id", text.parse_json_props(F.when(F.col("event_type") == "error", F.lit("{bad")).otherwise(F.col("props")))["k"].alias("k")
)
SQL["parse_json_props"] = "SELECT event_id, CASE WHEN event_type <> 'error' THEN props::JSON ->> 'k' END AS k FROM events"
Q["scene_label"] = lambda s, f: b.event_series(s, f).select("user_id", "minute_offset", text.scene_label("minute_offset").alias("label"))
SQL["scene_label"] = f"WITH {b.SQL_EVENT_SERIES} SELECT user_id, minute_offset, 'Minutes ' || (minute_offset - 5) || '-' || (minute_offset + 5) AS label FROM event_series"

_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
_SQL_SANITIZE = (
    "regexp_replace(regexp_replace(regexp_replace(" + _ESC + r", '(?is)<script[^>]*>.*?</script>', '', 'g'), "
    r"'(?i)on[\p{L}\p{N}_]+\s*=\s*[""'']?[^""'']*[""'']?', '', 'g'), "
    r"'(?i)\[([^\]]+)\]\(((?:javascript|data|vbscript):[^)]*)\)', '\1 (blocked: \2)', 'g')"
).replace('""', '"')
Q["sanitize_text"] = lambda s, f: b.table(s, f, "pages").select("page_id", text.sanitize_text("html").alias("safe"))
SQL["sanitize_text"] = "SELECT page_id, " + _SQL_SANITIZE.replace("{0}", "html") + " AS safe FROM pages"


def _quote(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


_ALL_FLAGS = text.XSS_PATTERNS + text.INJECTION_PATTERNS
Q["flag_injection"] = lambda s, f: b.table(s, f, "pages").select(
    "page_id", text.pattern_hits("html", _ALL_FLAGS).alias("hits"), text.is_safe("html").alias("is_safe")
)
_SQL_HITS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(html, {_quote('(?i)' + p)}) THEN {_quote(p)} END" for p in _ALL_FLAGS) + "], lambda x: x IS NOT NULL)"
SQL["flag_injection"] = f"SELECT page_id, {_SQL_HITS} AS hits, len({_SQL_HITS}) = 0 AS is_safe FROM pages"
Q["redact_secrets"] = lambda s, f: b.table(s, f, "documents").select("doc_id", text.redact_secrets("text").alias("text"))
_red = "text"
for _p, _r in text.SECRET_PATTERNS:
    _red = f"regexp_replace({_red}, {_quote(_p)}, {_quote(_r.replace('$1', chr(92) + '1'))}, 'g')"
SQL["redact_secrets"] = f"SELECT doc_id, {_red} AS text FROM documents"
Q["validate_input_text"] = lambda s, f: b.table(s, f, "documents").select("doc_id", text.input_problem("text").alias("problem"))
SQL["validate_input_text"] = f"""SELECT doc_id, CASE WHEN trim(regexp_replace(text, '{WS}', ' ', 'g')) = '' OR text IS NULL THEN 'empty' WHEN length(text) > 1000 THEN 'too_long'
WHEN contains(lower(text), '<script>') OR contains(lower(text), 'javascript:') OR contains(lower(text), 'onerror=') OR contains(lower(text), 'onclick=') THEN 'suspicious' END AS problem FROM documents"""
Q["estimate_tokens"] = lambda s, f: b.table(s, f, "documents").select("doc_id", text.estimate_tokens("text").alias("tokens"))
SQL["estimate_tokens"] = "SELECT doc_id, coalesce(length(text) // 4, 0) AS tokens FROM documents"

# --- joins -----------------------------------------------------------------


def _brand_titles(s, f):
    """Distinct part names per brand as a title dimension."""
    return b.table(s, f, "part").groupBy("p_name").agg(F.min("p_partkey").alias("title_id"))


Q["match_on_normalized_title"] = lambda s, f: matching.match_on_title(
    b.table(s, f, "part").select("p_partkey", F.concat(F.lit(" "), F.upper("p_name")).alias("title")),
    _brand_titles(s, f), "title", "p_name",
).select("p_partkey", "title_id")
SQL["match_on_normalized_title"] = """WITH d AS (SELECT p_name, min(p_partkey) AS title_id FROM part GROUP BY 1)
SELECT p_partkey, title_id FROM part LEFT JOIN d ON lower(trim(' ' || upper(part.p_name))) = lower(trim(d.p_name))"""
Q["join_on_slug"] = lambda s, f: matching.join_on_slug(
    b.table(s, f, "part").select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_en")).alias("slug")),
    _brand_titles(s, f), "slug", "p_name",
).select("p_partkey", "slug", "title_id")
SQL["join_on_slug"] = """WITH d AS (SELECT p_name, min(p_partkey) AS title_id FROM part GROUP BY 1), l AS (SELECT p_partkey, replace(p_name, ' ', '_') || '_en' AS slug FROM part)
SELECT p_partkey, slug, title_id FROM l LEFT JOIN d ON lower(replace(d.p_name, ' ', '_')) = regexp_replace(slug, '_[a-z]{2}$', '') WHERE title_id IS NOT NULL"""


def coalesce_join(s, f):
    orders = b.table(s, f, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).alias("cust_id"),
        F.format_string("customer#%09d", F.col("o_custkey")).alias("cust_name"),
    )
    customer = b.table(s, f, "customer").select("c_custkey", "c_name", "c_nationkey")
    return matching.coalesce_join(
        orders, customer, "cust_id", "c_custkey", F.lower("cust_name"), F.lower("c_name"), ["c_nationkey"]
    )


Q["coalesce_join"] = coalesce_join
SQL["coalesce_join"] = """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS cust_id, printf('customer#%09d', o_custkey) AS cust_name FROM orders)
SELECT o_orderkey, cust_id, cust_name, coalesce(a.c_nationkey, z.c_nationkey) AS c_nationkey FROM o LEFT JOIN customer a ON cust_id = a.c_custkey LEFT JOIN customer z ON lower(cust_name) = lower(z.c_name)"""


def _linked_customers(s, f):
    url = F.lit("https://api.example/nations/")
    n = F.col("c_nationkey")
    return b.table(s, f, "customer").select(
        "c_custkey",
        F.when(F.col("c_acctbal") < 0, F.array().cast("array<string>"))
        .otherwise(F.array(F.concat(url, n.cast("string")), F.concat(url, ((n + 1) % 27).cast("string")))).alias("links"),
        F.when(F.col("c_acctbal") >= 0, F.concat(url, n.cast("string"))).otherwise("").alias("link"),
    )


def _nation_urls(s, f):
    return b.table(s, f, "nation").select(
        "n_nationkey", "n_name", F.concat(F.lit("https://api.example/nations/"), F.col("n_nationkey").cast("string")).alias("url")
    )


_SQL_LINKS = """lc AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN []::VARCHAR[] ELSE ['https://api.example/nations/' || c_nationkey, 'https://api.example/nations/' || ((c_nationkey + 1) % 27)] END AS links,
CASE WHEN c_acctbal >= 0 THEN 'https://api.example/nations/' || c_nationkey ELSE '' END AS link FROM customer),
nu AS (SELECT n_nationkey, n_name, 'https://api.example/nations/' || n_nationkey AS url FROM nation)"""
Q["explode_join"] = lambda s, f: matching.explode_join(
    _linked_customers(s, f).select("c_custkey", "links"), "links", _nation_urls(s, f), "url"
).select("c_custkey", "n_nationkey", "n_name")
SQL["explode_join"] = f"WITH {_SQL_LINKS}, e AS (SELECT c_custkey, unnest(links) AS u FROM lc) SELECT c_custkey, n_nationkey, n_name FROM e JOIN nu ON u = url"
Q["fk_url_join"] = lambda s, f: matching.fk_url_join(
    _linked_customers(s, f).select("c_custkey", "link"), "link", _nation_urls(s, f), "url"
).select("c_custkey", "n_name")
SQL["fk_url_join"] = f"WITH {_SQL_LINKS} SELECT c_custkey, n_name FROM lc JOIN nu ON link = url WHERE link IS NOT NULL AND link <> ''"
Q["orphans"] = lambda s, f: matching.orphans(
    b.table(s, f, "orders"), "o_custkey", b.table(s, f, "customer").filter(F.col("c_acctbal") >= 0), "c_custkey"
)
SQL["orphans"] = """SELECT o_custkey, count(*) AS "references" FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal >= 0) GROUP BY 1"""
Q["unmatched"] = lambda s, f: matching.unmatched(
    b.table(s, f, "documents").select("doc_id", "source"), b.table(s, f, "labels"), F.col("doc_id"), F.col("doc_id")
)
SQL["unmatched"] = "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"


def _bracketed(name=None):
    return F.concat(F.lit("["), F.col("p_name") if name is None else name, F.lit("]"))


def _short_titles(s, f):
    return b.table(s, f, "part").select(_bracketed().alias("left_title")).distinct()


def _long_titles(s, f):
    """The names of another catalogue: other words for one colour, often a type behind."""
    other = _bracketed(F.replace("p_name", F.lit("red"), F.lit("crimson")))
    return b.table(s, f, "part").select(
        F.when(F.col("p_size") > 40, other).otherwise(F.concat(other, F.lit(" "), F.lower("p_type"))).alias("right_title")
    ).distinct()


_SQL_FUZZY = """a AS (SELECT DISTINCT '[' || p_name || ']' AS left_title FROM part), o AS (SELECT '[' || replace(p_name, 'red', 'crimson') || ']' AS n, p_size, p_type FROM part),
zz AS (SELECT DISTINCT CASE WHEN p_size > 40 THEN n ELSE n || ' ' || lower(p_type) END AS right_title FROM o)"""
Q["substring_candidates"] = lambda s, f: matching.substring_candidates(_short_titles(s, f), _long_titles(s, f), "left_title", "right_title")
SQL["substring_candidates"] = f"WITH {_SQL_FUZZY} SELECT left_title, right_title FROM a, zz WHERE contains(right_title, left_title) OR contains(left_title, right_title)"
Q["fuzzy_substring_match"] = lambda s, f: matching.fuzzy_substring_match(
    _short_titles(s, f), _long_titles(s, f), "left_title", "right_title"
)
_SQL_MATCHES = _SQL_FUZZY + """, e AS (SELECT left_title, right_title, 'exact' AS match FROM a JOIN zz ON left_title = right_title),
fz AS (SELECT left_title, min(right_title) AS right_title, 'fuzzy_substring' AS match FROM a JOIN zz ON contains(right_title, left_title)
  WHERE left_title NOT IN (SELECT left_title FROM e) AND right_title NOT IN (SELECT left_title FROM e) GROUP BY 1)"""
SQL["fuzzy_substring_match"] = f"WITH {_SQL_MATCHES} SELECT * FROM e UNION ALL SELECT * FROM fz"
Q["cross_reference"] = lambda s, f: matching.cross_reference(
    matching.fuzzy_substring_match(_short_titles(s, f), _long_titles(s, f), "left_title", "right_title"),
    _short_titles(s, f), _long_titles(s, f), "left_title", "right_title",
)
SQL["cross_reference"] = f"""WITH {_SQL_MATCHES}, n AS (SELECT (SELECT count(*) FROM e) AS x, (SELECT count(*) FROM fz) AS y, (SELECT count(*) FROM a) AS l, (SELECT count(*) FROM zz) AS r)
SELECT x AS exact_matches, y AS fuzzy_matches, l - x - y AS only_left, r - x - y AS only_right FROM n"""


def alias_match(s, f):
    aliases = b.table(s, f, "nation").select(
        F.col("n_name").alias("left_name"), F.concat(F.lit("country_"), F.col("n_nationkey").cast("string")).alias("right_name")
    )
    right = b.table(s, f, "customer").select(
        F.when(F.col("c_nationkey") > 12, F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")))
        .otherwise(F.concat(F.lit("country_"), F.col("c_nationkey").cast("string"))).alias("name")
    )
    left = b.table(s, f, "supplier").join(b.table(s, f, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return matching.alias_match(left, right, "n_name", "name", aliases)


Q["alias_match"] = alias_match
SQL["alias_match"] = """WITH l AS (SELECT DISTINCT n_name AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey),
r AS (SELECT DISTINCT CASE WHEN c_nationkey > 12 THEN 'NATION_' || c_nationkey ELSE 'country_' || c_nationkey END AS k FROM customer),
al AS (SELECT n_name AS ln, 'country_' || n_nationkey AS rn FROM nation),
x AS (SELECT l.k AS left_name, r.k AS right_name, 'exact' AS match FROM l JOIN r ON l.k = r.k),
v AS (SELECT ln AS left_name, rn AS right_name, 'alias' AS match FROM al WHERE ln IN (SELECT k FROM l) AND rn IN (SELECT k FROM r)
  AND ln NOT IN (SELECT left_name FROM x) AND rn NOT IN (SELECT right_name FROM x)),
m AS (SELECT * FROM x UNION ALL SELECT * FROM v)
SELECT * FROM m UNION ALL SELECT k, NULL, 'only_left' FROM l WHERE k NOT IN (SELECT left_name FROM m)
UNION ALL SELECT NULL, k, 'only_right' FROM r WHERE k NOT IN (SELECT right_name FROM m)"""


def pattern_join(s, f):
    rows = b.table(s, f, "documents").groupBy(
        F.concat(F.col("source"), F.lit("_"), F.col("lang")).alias("slug")
    ).agg(F.count(F.lit(1)).alias("docs"))
    dim = b.table(s, f, "nation").select("n_nationkey", F.concat(F.lit("SRC"), (F.col("n_nationkey") + 1).cast("string"), F.lit(" ")).alias("title"))
    return matching.pattern_join(rows, dim, "title", "slug")


Q["pattern_join"] = pattern_join
SQL["pattern_join"] = """WITH r AS (SELECT source || '_' || lang AS slug, count(*) AS docs FROM documents GROUP BY 1),
d AS (SELECT n_nationkey, 'SRC' || (n_nationkey + 1) || ' ' AS title FROM nation)
SELECT n_nationkey, title, slug, docs FROM d LEFT JOIN r ON slug LIKE concat('%', replace(lower(title), ' ', '_'), '%')"""
Q["set_compare"] = lambda s, f: matching.set_compare(
    b.table(s, f, "documents").filter(F.col("lang") == "en").select("source", "lang"),
    b.table(s, f, "documents").join(b.table(s, f, "labels"), "doc_id").select("source", "lang"), ["source", "lang"],
)
SQL["set_compare"] = """WITH a AS (SELECT DISTINCT source, lang FROM documents WHERE lang = 'en'), z AS (SELECT DISTINCT source, lang FROM documents JOIN labels USING (doc_id))
SELECT coalesce(a.source, z.source) AS source, coalesce(a.lang, z.lang) AS lang, CASE WHEN a.source IS NULL THEN 'only_b' WHEN z.source IS NULL THEN 'only_a' ELSE 'both' END AS side
FROM a FULL JOIN z ON a.source = z.source AND a.lang = z.lang"""
Q["resolve_entity_id"] = lambda s, f: matching.resolve_entity_id(
    b.table(s, f, "part").select(
        "p_partkey", F.when(F.col("p_size") > 25, F.upper("p_name")).alias("name"), F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_fr_v2")).alias("slug")
    ),
    b.table(s, f, "part").filter(F.col("p_brand") != "Brand#7").select("p_partkey", "p_name").withColumnsRenamed({"p_partkey": "title_id"}),
    "name", "slug", "title_id", "p_name",
)
SQL["resolve_entity_id"] = """WITH d AS (SELECT lower(p_name) AS t, min(p_partkey) AS resolved_id FROM part WHERE p_brand <> 'Brand#7' GROUP BY 1)
SELECT p_partkey, CASE WHEN p_size > 25 THEN upper(p_name) END AS name, replace(p_name, ' ', '_') || '_fr_v2' AS slug, resolved_id FROM part LEFT JOIN d ON lower(p_name) = t"""

# --- sets ------------------------------------------------------------------
Q["union_all_typed"] = lambda s, f: (
    b.table(s, f, "customer").select(F.concat(F.lit("customer_"), F.col("c_custkey")).alias("id"), F.lit("customer").alias("kind"))
    .unionByName(b.table(s, f, "supplier").select(F.concat(F.lit("supplier_"), F.col("s_suppkey")).alias("id"), F.lit("supplier").alias("kind")))
)
SQL["union_all_typed"] = "SELECT 'customer_' || c_custkey AS id, 'customer' AS kind FROM customer UNION ALL SELECT 'supplier_' || s_suppkey, 'supplier' FROM supplier"
Q["distinct_rows"] = lambda s, f: b.table(s, f, "documents").select("source", "lang").distinct()
SQL["distinct_rows"] = "SELECT DISTINCT source, lang FROM documents"
Q["intersect_sets"] = lambda s, f: b.table(s, f, "orders").select(F.col("o_custkey").alias("k")).intersect(b.table(s, f, "customer").select(F.col("c_custkey").alias("k")))
SQL["intersect_sets"] = "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer"
Q["subtract_sets"] = lambda s, f: b.table(s, f, "customer").select(F.col("c_custkey").alias("k")).subtract(b.table(s, f, "orders").select(F.col("o_custkey").alias("k")))
SQL["subtract_sets"] = "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders"
Q["pivot_counts"] = lambda s, f: b.table(s, f, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
SQL["pivot_counts"] = "SELECT o_orderpriority, " + ", ".join(f"nullif(count(CASE WHEN o_orderstatus = '{x}' THEN 1 END), 0) AS \"{x}\"" for x in "FOP") + " FROM orders GROUP BY 1"

# --- sources and sinks -------------------------------------------------------
_CUSTOMER_DDL = "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"


def read_json_entities(s, f):
    path = scratch_path(s, "entities")
    writers.write_json(b.table(s, f, "customer").withColumn("c_mktsegment", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment"))), path)
    from pyspark.sql.types import _parse_datatype_string

    out = readers.read_json_entities(s, path, _parse_datatype_string(_CUSTOMER_DDL), "api", multi_line=False)
    return out.drop("loaded_at")


Q["read_json_entities"] = read_json_entities
SQL["read_json_entities"] = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS c_mktsegment, 'api' AS source FROM customer"


def write_json_nulls(s, f):
    path = scratch_path(s, "json")
    writers.write_json(_holes(s, f), path)
    return s.read.text(path).select(
        F.get_json_object("value", "$.o_orderkey").cast("bigint").alias("o_orderkey"), F.col("value").contains('"price":null').alias("null_kept")
    )


Q["write_json_nulls"] = write_json_nulls
SQL["write_json_nulls"] = f"WITH {_SQL_HOLES} SELECT o_orderkey, price IS NULL AS null_kept FROM h"


def read_csv_with_encodings(s, f):
    utf8, latin = scratch_path(s, "csv"), scratch_path(s, "csv")
    rows = b.table(s, f, "customer").withColumn("c_name", F.concat(F.lit('Café "1,2"\n  '), F.col("c_name")))
    for part, path, encoding in ((rows.filter(F.col("c_acctbal") >= 0), utf8, "UTF-8"), (rows.filter(F.col("c_acctbal") < 0), latin, "ISO-8859-1")):
        part.write.option("header", True).option("encoding", encoding).option("escape", '"').csv(path)
    return readers.read_csv_with_encodings(s, utf8, _CUSTOMER_DDL).unionByName(readers.read_csv_with_encodings(s, latin, _CUSTOMER_DDL))


Q["read_csv_with_encodings"] = read_csv_with_encodings
SQL["read_csv_with_encodings"] = "SELECT c_custkey, 'Café \"1,2\"' || chr(10) || '  ' || c_name AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


def write_csv_report(s, f):
    path = scratch_path(s, "csv")
    writers.write_csv(b.table(s, f, "supplier"), path)
    return s.read.option("header", True).schema("s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE").csv(path)


Q["write_csv_report"] = write_csv_report
SQL["write_csv_report"] = "SELECT * FROM supplier"


def load_idempotent(s, f):
    path = scratch_path(s, "load")
    orders = b.table(s, f, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    writers.load_idempotent(orders.filter(F.col("o_orderstatus") == "F"), path, ["o_orderkey"])
    writers.load_idempotent(orders.withColumn("o_totalprice", F.col("o_totalprice") + 1), path, ["o_orderkey"])
    return s.read.parquet(path)


Q["load_idempotent"] = load_idempotent
SQL["load_idempotent"] = "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE o_totalprice + 1 END AS o_totalprice FROM orders"


def load_replacing(s, f):
    path = scratch_path(s, "replace")
    orders = b.table(s, f, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    writers.load_replacing(orders, path, ["o_orderstatus"])
    writers.load_replacing(orders.filter("o_orderstatus = 'F'").withColumn("o_totalprice", F.lit(0.0)), path, ["o_orderstatus"])
    return s.read.parquet(path)


Q["load_replacing"] = load_replacing
SQL["load_replacing"] = "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0.0::DOUBLE ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders"
Q["update_from_lookup"] = lambda s, f: writers.update_from_lookup(
    b.table(s, f, "documents").select("doc_id", "lang"), b.table(s, f, "labels"), ["doc_id"], ["quality", "toxic"]
)
SQL["update_from_lookup"] = "SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)"


def materialise_mart(s, f):
    out = writers.materialise(b.rounded(b.ship_series(s, f), b.SHIP_DIMS), "ship_mart", "table", scratch_path(s, "mart"))
    return out


Q["materialise_mart"] = materialise_mart
SQL["materialise_mart"] = f"WITH {b.SQL_SHIP_SERIES} SELECT nation, flag, week, lines, {b.sql_rounded(b.SHIP_DIMS)} FROM ship_series"
Q["freshness"] = lambda s, f: writers.freshness(b.table(s, f, "events"), "ts", 48, "2024-02-01 00:00:00")
SQL["freshness"] = """WITH m AS (SELECT floor(epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(max(ts))) / 3600.0 AS h FROM events)
SELECT round(h, 4) AS age_hours, CASE WHEN h IS NULL OR h > 48 THEN 'WARN' ELSE 'PASS' END AS status FROM m"""
Q["detect_language"] = lambda s, f: _slugs(s, f).select(
    "doc_id", readers.detect_language(F.concat(F.col("slug"), F.lit("_parsed.json"))).alias("language"), readers.file_language("slug").alias("by_end")
)
SQL["detect_language"] = f"""WITH {_SQL_SLUGS} SELECT doc_id, CASE WHEN lang IN ('en', 'fr', 'es', 'nl', 'ar') THEN lang END AS language,
coalesce(nullif(regexp_extract(slug, '_(ja|fr|es|nl|ar)$', 1), ''), 'en') AS by_end FROM sl"""


def quarantine_unknown_language(s, f):
    good, bad = readers.split_by_language(_slugs(s, f).withColumn("name", F.concat("slug", F.lit("_parsed.json"))), "name")
    return good.select("doc_id", F.lit("good").alias("side")).unionByName(bad.select("doc_id", F.lit("quarantine").alias("side")))


Q["quarantine_unknown_language"] = quarantine_unknown_language
SQL["quarantine_unknown_language"] = "SELECT doc_id, CASE WHEN lang IN ('en', 'fr', 'es', 'nl', 'ar') THEN 'good' ELSE 'quarantine' END AS side FROM documents"
Q["versioned_source_pick"] = lambda s, f: readers.versioned_source_pick(
    [
        b.table(s, f, "orders").select("o_orderkey", "o_totalprice"),
        b.table(s, f, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice")),
    ],
    ["o_orderkey"],
)
SQL["versioned_source_pick"] = "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, CAST(CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS BIGINT) AS version FROM orders"
Q["parse_markdown_table"] = lambda s, f: readers.parse_markdown_table(
    b.table(s, f, "orders").select(
        F.concat(
            F.lit("| Customer's "), F.col("o_custkey").cast("string"), F.lit(" | "), F.upper("o_orderstatus"), F.lit(" | x | y | "),
            F.when(F.col("o_orderpriority") == "5-LOW", "high").otherwise(F.col("o_orderkey").cast("string")), F.lit(" | z |"),
        ).alias("value")
    )
)
SQL["parse_markdown_table"] = """SELECT 'customers_' || o_custkey AS film_slug, 'Customer''s ' || o_custkey AS film_title, lower(o_orderstatus) AS language,
CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE o_orderkey END AS priority_score FROM orders"""
