"""SQL twins of the registered queries that SQL can express, for a single-node engine on small tables."""

from __future__ import annotations

from strandline.llm import licences, quality_hosts
from strandline.llm.common import LOWER, UPPER

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _quality() -> str:
    names = {m: m for m in quality_hosts.MEASURES}
    flags = {r: e.format(**names) for r, e in quality_hosts.RULES.items()}
    counts = ", ".join(f"sum(CASE WHEN {e} THEN 1 ELSE 0 END)::DOUBLE AS {r}" for r, e in flags.items())
    priors = ", ".join(f"sum({r}) / sum(n) AS {r}_m, coalesce(var_samp({r} / n), 0.0) AS {r}_v" for r in flags)
    strength = lambda r: f"CASE WHEN {r}_v > 0 THEN greatest({r}_m * (1 - {r}_m) / {r}_v - 1, 1.0) ELSE {quality_hosts.STRONGEST} END"
    rates = ", ".join(f"({r} + {r}_m * ({strength(r)})) / (n + ({strength(r)}))" for r in flags)
    base = f"({flags['too_short']}) OR ({flags['repetitive']})"
    return f"""WITH t AS (SELECT doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t))),
c AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM g WHERE n > 1) GROUP BY 1),
l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
m AS (SELECT doc_id, host, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '{quality_hosts.SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM l LEFT JOIN c USING (doc_id)),
h AS (SELECT host, count(*)::DOUBLE AS n, {counts} FROM m GROUP BY 1), p AS (SELECT {priors} FROM h),
v AS (SELECT host, greatest({rates}) > {quality_hosts.HOST_LIMIT} AS host_rejected FROM h, p)
SELECT doc_id, {', '.join(quality_hosts.MEASURES)}, {base} AS base_failed, host_rejected, NOT ({base}) AND NOT host_rejected AS kept FROM m JOIN v USING (host)"""


def _contamination() -> str:
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""WITH d AS (SELECT doc_id, {words} AS w FROM documents), b AS (SELECT item_id, w, least(10, len(w)) AS size FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM b)),
dw AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS s FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM b))),
h AS (SELECT doc_id, i, size, item_id FROM dw JOIN bw USING (size, s)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM h) GROUP BY 1),
x AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN x USING (doc_id)"""


def _licences() -> str:
    known = " ".join(f"WHEN s IN ({', '.join(repr(f) for f in forms)}) THEN '{name}'" for name, forms in licences.SENTENCES.items())
    steps, last = [], "r0"
    for k, (ids, name, kind) in enumerate(licences.RULES, 1):
        rest = f"replace(replace(rest, ',{ids},', ',.,'), ',{ids},', ',.,')"
        add = lambda column, value: f"CASE WHEN contains(rest, ',{ids},') AND NOT list_contains({column}, '{value}') THEN list_append({column}, '{value}') ELSE {column} END AS {column}"  # noqa: B023, E731
        steps.append(f"r{k} AS (SELECT doc_id, ids, {rest} AS rest, {add('licences', name)}, {add('kinds', kind)} FROM {last})")
        last = f"r{k}"
    spdx = licences.SPDX.replace("(?:or|and)", "(or|and)")
    low = "lower(coalesce(text, ''))"
    for _ in range(3):
        low = f"regexp_replace({low}, '{spdx}', '\\1 \\2' || chr(10) || '\\1 \\4', 'g')"
    return f"""WITH t AS (SELECT doc_id, string_split(regexp_replace(regexp_replace({low}, ',\\s+(all rights reserved)', chr(10) || '\\1', 'g'), '([.!?;])\\s+', '\\1' || chr(10), 'g'), chr(10)) AS ls FROM documents),
s AS (SELECT doc_id, list_filter(list_transform(ls, lambda x: trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS ss FROM t),
i AS (SELECT doc_id, ',' || array_to_string(list_transform(ss, lambda s: CASE {known} ELSE '?' END), ',') || ',' AS seq FROM s),
j AS (SELECT doc_id, regexp_replace(seq, ',(\\?,)+', ',?,', 'g') AS seq FROM i),
r0 AS (SELECT doc_id, CASE WHEN regexp_matches(seq, '[A-Za-z]') THEN seq ELSE '' END AS ids, CASE WHEN regexp_matches(seq, '[A-Za-z]') THEN seq ELSE '' END AS rest, []::VARCHAR[] AS licences, []::VARCHAR[] AS kinds FROM j),
{', '.join(steps)}
SELECT doc_id, trim(ids, ',') AS sentence_ids, array_to_string(licences, ',') AS licences, array_to_string(kinds, ',') AS kinds FROM {last}"""


def _lines() -> str:
    return r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents),
w AS (SELECT *, row_number() OVER (ORDER BY doc_id, pos) AS k FROM (SELECT doc_id, pos, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM l) WHERE len(w) > 0),
s AS (SELECT DISTINCT k, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w)),
n AS (SELECT k, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.k AS ka, b.k AS kb, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.k < b.k GROUP BY ALL),
g AS (SELECT DISTINCT kb AS k FROM p JOIN n x ON x.k = ka JOIN n y ON y.k = kb WHERE 100 * c >= 80 * (x.n + y.n - c)),
o AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (g.k IS NULL) AS n_kept, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FILTER (g.k IS NULL) AS kept FROM w LEFT JOIN g USING (k) GROUP BY 1)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_lines - n_kept, 0)::BIGINT AS n_removed, coalesce(kept, '') AS kept_lines FROM documents LEFT JOIN o USING (doc_id)"""


def _hard_negatives() -> str:
    return """WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 5"""


def _lexical_search() -> str:
    terms = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""WITH d AS (SELECT doc_id, {terms} AS w FROM documents), c AS (SELECT count(*) FILTER (len(w) > 0) AS nd, sum(len(w))::BIGINT AS nt FROM d),
t AS (SELECT doc_id, t, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY doc_id, t),
f AS (SELECT t, count(*) AS df FROM t GROUP BY t), b AS (SELECT DISTINCT item_id, unnest({terms}) AS t FROM benchmark),
q AS (SELECT item_id, t, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) AS w FROM b JOIN f USING (t), c),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // nt)))) AS BIGINT) AS score FROM q JOIN t USING (t), c GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER r AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 WINDOW r AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER r <= 10"""


SQL = {
    "op1_quality_rules": _quality(),
    "op2_decontamination": _contamination(),
    "op4_line_dedup": _lines(),
    "op7_license_scans": _licences(),
    "op11_hard_negatives": _hard_negatives(),
    "op12_lexical_search": _lexical_search(),
}
