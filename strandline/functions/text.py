"""Text cleaning, normalisation and screening expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and replacements that decide the results.
WHITESPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"
TAG = r"<[^>]+>"
TRAILING_YEAR_PAREN = r"\s*\([0-9]{4}\)\s*$"
TRAILING_YEAR = r"\s+[0-9]{4}\s*$"
ACCENTS_FROM = "äöüéèêàâîïç"
ACCENTS_TO = "aoueeeaaiic"
LANGUAGE_SUFFIX = r"_(en|fr|es|nl|ar)$"
ANY_LANGUAGE_SUFFIX = r"_[a-z]{2}$"
VERSION_SUFFIX = r"_v[0-9]+$"
UUID_PATTERN = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
SECRET_PATTERNS = [
    (r"sk-[a-zA-Z0-9]{48}", "***REDACTED_API_KEY***"),
    (r"(?i)(OPENAI_API_KEY[\s=:]+)[\S]+", "$1***REDACTED***"),
    (r"(?i)(api[_-]?key[\s=:\"'\]]+)[\S]+", "$1***REDACTED***"),
    (r"(?i)(openai[_-]?api[_-]?key[\s=:\"'\]]+)[\S]+", "$1***REDACTED***"),
]
XSS_PATTERNS = [r"<script[^>]*>", r"javascript:", r"onerror\s*=", r"onclick\s*=", r"onload\s*="]
INJECTION_PATTERNS = [
    r"ignore\s+(previous|all)\s+(instructions?|prompts?)",
    r"disregard\s+(previous|all)",
    r"reveal\s+(your|the)\s+(prompt|instructions?|system)",
    r"you\s+are\s+now\s+",
    r"new\s+instructions?:",
]
SUSPICIOUS_INPUT = ["<script>", "javascript:", "onerror=", "onclick="]
UNVERIFIED_NOTE = "\n\n⚠️ Note: This response may contain unverified content."
SCRIPT_BLOCK = r"(?is)<script[^>]*>.*?</script>"
EVENT_HANDLER = r"(?i)on[\p{L}\p{N}_]+\s*=\s*[\"']?[^\"']*[\"']?"
BLOCKED_LINK = r"(?i)\[([^\]]+)\]\(((?:javascript|data|vbscript):[^)]*)\)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_space(c: Column | str) -> Column:
    """Runs of white space become one blank; the ends are trimmed."""
    return F.trim(F.regexp_replace(_col(c), WHITESPACE, " "))


def clean_text(c: Column | str) -> Column:
    """Drop tags, collapse white space, NULL becomes ''."""
    return F.coalesce(collapse_space(F.regexp_replace(_col(c), TAG, "")), F.lit(""))


def clean_title(c: Column | str) -> Column:
    """Drop the line after the first newline and a trailing ``(yyyy)``, then trim."""
    first_line = F.regexp_replace(_col(c), r"^([^\n]*)\n[^\n]*", "$1")
    return F.trim(F.regexp_replace(first_line, TRAILING_YEAR_PAREN, ""))


def normalize_title(c: Column | str) -> Column:
    """Comparison key of a title: no year, lower case, no accents."""
    flat = collapse_space(c)
    bare = F.regexp_replace(F.regexp_replace(flat, TRAILING_YEAR_PAREN, ""), TRAILING_YEAR, "")
    folded = F.translate(F.lower(bare), ACCENTS_FROM, ACCENTS_TO)
    return F.coalesce(F.trim(folded), F.lit(""))


def slugify(c: Column | str) -> Column:
    """Lower-case key of words joined by single underscores."""
    slug = F.replace(F.lower(_col(c)), F.lit(" "), F.lit("_"))
    slug = F.regexp_replace(slug, r"[^a-z0-9_]", "")
    return F.regexp_replace(F.regexp_replace(slug, r"_+", "_"), r"^_|_$", "")


def plain_slug(c: Column | str, drop_apostrophes: bool = False) -> Column:
    """Lower case with blanks as underscores, as the marts join on."""
    base = _col(c)
    if drop_apostrophes:
        base = F.replace(base, F.lit("'"), F.lit(""))
    return F.lower(F.replace(base, F.lit(" "), F.lit("_")))


def strip_language(c: Column | str) -> Column:
    """Remove any two-letter suffix."""
    return F.regexp_replace(_col(c), ANY_LANGUAGE_SUFFIX, "")


def strip_version_and_language(c: Column | str) -> Column:
    """Remove ``_v2`` first and a known language code after it."""
    return F.regexp_replace(F.regexp_replace(_col(c), VERSION_SUFFIX, ""), LANGUAGE_SUFFIX, "")


def title_from_slug(c: Column | str) -> Column:
    return F.initcap(F.replace(_col(c), F.lit("_"), F.lit(" ")))


def clean_currency(c: Column | str) -> Column:
    """``$1,000`` to 1000.0; anything unreadable to 0.0."""
    digits = F.trim(F.regexp_replace(_col(c), r"[$,]", ""))
    return F.coalesce(digits.try_cast("double"), F.lit(0.0))


def safe_int(c: Column | str, default: int = 0) -> Column:
    """``2001.0`` to 2001; anything unreadable to the default."""
    number = _col(c).try_cast("double")
    whole = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))
    return F.coalesce(whole.try_cast("int"), F.lit(default))


def fixed(c: Column | str, digits: int) -> Column:
    """A number with a fixed count of decimals, rounded from its exact binary value."""
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", _col(c).cast("double"), F.lit(pattern))


def parse_duration(c: Column | str) -> Column:
    """``1h 43m``, ``1h``, ``43m`` or ``103`` to minutes; NULL otherwise."""
    d = _col(c)
    hours = F.regexp_extract(d, r"^(\d+)h", 1).try_cast("int")
    minutes = F.regexp_extract(d, r"(\d+)m$", 1).try_cast("int")
    return (
        F.when(d.rlike(r"^\d+h\s+\d+m$"), hours * 60 + minutes)
        .when(d.rlike(r"^\d+h$"), hours * 60)
        .when(d.rlike(r"^\d+m$"), minutes)
        .when(d.rlike(r"^\d+$"), d.try_cast("int"))
    )


def truncate_text(c: Column | str, limit: int = 80, keep: int | None = None) -> Column:
    """Cut to ``keep`` characters plus an ellipsis when longer than ``limit``."""
    keep = limit - 3 if keep is None else keep
    text = _col(c)
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, keep), F.lit("..."))).otherwise(text)


def words(c: Column | str) -> Column:
    """White-space separated words of the whole text."""
    return F.filter(F.split(_col(c), WHITESPACE), lambda w: w != "")


def truncate_words(c: Column | str, limit: int = 450) -> Column:
    """First ``limit`` words of a longer text; shorter texts are left as they are."""
    parts = words(c)
    return F.when(F.size(parts) > limit, F.array_join(F.slice(parts, 1, limit), " ")).otherwise(_col(c))


def minute_bucket(seconds: Column | str, width: int = 60) -> Column:
    """Whole buckets of ``width`` seconds."""
    return F.floor(_col(seconds) / F.lit(width)).cast("bigint")


def composite_key(*cols: Column | str, sep: str = "_") -> Column:
    return F.concat_ws(sep, *[_col(c).cast("string") for c in cols])


def stable_id(prefix: str, c: Column | str) -> Column:
    """Prefix plus the MD5 of a name."""
    return F.concat(F.lit(prefix), F.md5(_col(c)))


def json_props(**cols: Column) -> Column:
    """JSON object text that keeps NULL members."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in cols.items()]), {"ignoreNullFields": "false"})


def parse_json_props(c: Column | str) -> Column:
    """JSON object text to map<string,string>; bad text to an empty map."""
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    parsed = F.from_json(_col(c), "map<string,string>", {"mode": "PERMISSIVE"})
    return F.coalesce(parsed, empty)


def scene_label(minute: Column | str, reach: int = 5) -> Column:
    m = _col(minute)
    return F.concat(F.lit("Minutes "), (m - reach).cast("string"), F.lit("-"), (m + reach).cast("string"))


def last_segment(c: Column | str) -> Column:
    """Last part of a URL path; NULL for a blank one."""
    text = _col(c)
    return F.when((text.isNotNull()) & (text != ""), F.split_part(text, F.lit("/"), F.lit(-1)))


def escape_html(c: Column | str) -> Column:
    out = _col(c)
    for raw, entity in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]:
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def sanitize_text(c: Column | str) -> Column:
    """Escape HTML, drop script blocks and event handlers, block script links."""
    out = F.regexp_replace(escape_html(c), SCRIPT_BLOCK, "")
    out = F.regexp_replace(out, EVENT_HANDLER, "")
    return F.regexp_replace(out, BLOCKED_LINK, "$1 (blocked: $2)")


def pattern_hits(c: Column | str, patterns: list[str]) -> Column:
    """The patterns (as text) that occur in the column, in list order."""
    text = _col(c)
    found = [F.when(text.rlike("(?i)" + p), F.lit(p)) for p in patterns]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def is_safe(c: Column | str) -> Column:
    """False when a script or prompt-injection pattern occurs."""
    hits = pattern_hits(c, XSS_PATTERNS + INJECTION_PATTERNS)
    return F.coalesce(F.size(hits) == 0, F.lit(True))


def screen_response(c: Column | str) -> Column:
    """The text as it may be shown.

    Script patterns sanitise it, once for every pattern that matches, and every
    injection pattern adds a note at the end.
    """
    original = _col(c)
    passes = F.size(pattern_hits(original, XSS_PATTERNS))
    shown = F.when(passes <= 0, original)
    cleaned = original
    for n in range(1, len(XSS_PATTERNS) + 1):
        cleaned = sanitize_text(cleaned)
        shown = shown.when(passes == n, cleaned)
    notes = F.size(pattern_hits(original, INJECTION_PATTERNS))
    return F.concat(shown, F.repeat(F.lit(UNVERIFIED_NOTE), notes))


def redact_secrets(c: Column | str) -> Column:
    out = _col(c)
    for pattern, replacement in SECRET_PATTERNS:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def input_problem(c: Column | str, max_length: int = 1000) -> Column:
    """Why a text is rejected: empty, too_long, suspicious; NULL when accepted."""
    text = _col(c)
    lowered = F.lower(text)
    suspicious = F.lit(False)
    for token in SUSPICIOUS_INPUT:
        suspicious = suspicious | lowered.contains(token)
    return (
        F.when(text.isNull() | (collapse_space(text) == ""), F.lit("empty"))
        .when(F.length(text) > max_length, F.lit("too_long"))
        .when(suspicious, F.lit("suspicious"))
    )


def estimate_tokens(c: Column | str) -> Column:
    """Rough token count: one per four characters."""
    return F.coalesce(F.floor(F.length(_col(c)) / 4).cast("bigint"), F.lit(0).cast("bigint"))
