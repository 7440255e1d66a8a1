"""Quality rules with host-level verdicts.

Each document is measured and tested by rules; failures are counted by host (the ``source``
column, or any column named), each host's failure rate is shrunk with a beta prior fitted to all
hosts by moments, and the host's verdict is joined back to its documents. Only one row per host
and task is shuffled; measured columns are stored once, without texts.

A NULL text has no words and fails as too short. A NULL host is a host of its own. Repeated rows
are judged alike and each counts. An empty table gives an empty result. A single host, or hosts
of equal rates, give an infinitely strong prior: every shrunk rate is then the common rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import SPACE, col, free_names, stored

#: Documents of fewer words fail; so do those with a larger share of repeated 5-word windows.
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
SYMBOLS = "[#*$%&|<>]"
#: A host is rejected when the shrunk rate of any rule is above this.
HOST_LIMIT = 0.5
STRONGEST = 1e9
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
RULES = {
    "too_short": "{n_words} < 10",
    "repetitive": "100 * {n_repeat_words} > 20 * {n_words}",
    "symbols": "10 * {n_symbols} > {word_chars}",
    "dup_lines": "10 * {n_dup_lines} > 3 * {n_lines}",
}


def trimmed_words(text: Column) -> Column:
    """Words of a text; an empty array for NULL or a text of white space.

    Where single blanks alone part the words no pattern is matched.
    """
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    odd = bare.contains("  ")
    for space in "\t\n\x0b\f\r":
        odd = odd | bare.contains(space)
    return F.when(bare == "", F.array().cast("array<string>")).when(odd, F.split(bare, SPACE + "+")).otherwise(F.split(bare, " "))


def windows(hashes: Column, size: int = 5) -> Column:
    """Hash of every run of ``size`` neighbours; empty for fewer."""
    starts = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (size - 1), F.lit(0)))
    return F.transform(starts, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, size)]))


def measured(docs: DataFrame, text: str = "text", prefix: str = "") -> tuple[DataFrame, dict[str, str]]:
    """The frame with the measures added, and the columns they are in.

    Repeated words are those in 5-word windows that occur twice or more, the first included:
    equal windows are neighbours when sorted by hash, and the gaps between the places of
    repeated ones tell how many words they cover.
    """
    w, h, win, again, at, lines = free_names(docs, *[f"_{prefix}{n}" for n in ("words", "hashes", "windows", "again", "places", "lines")])
    names = dict(zip(MEASURES, free_names(docs, *[prefix + m for m in MEASURES])))
    whole = F.coalesce(col(text).cast("string"), F.lit(""))
    out = docs.withColumn(w, trimmed_words(whole))
    out = out.withColumn(h, F.transform(col(w), lambda x: F.xxhash64(x)))
    out = out.withColumn(win, windows(col(h)))
    marked = F.array_sort(F.transform(col(win), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    out = out.withColumn(again, F.when(F.size(F.array_distinct(col(win))) < F.size(col(win)), marked))
    same = lambda e, k: (e["h"] == F.get(col(again), k - 1)["h"]) | (e["h"] == F.get(col(again), k + 1)["h"])
    places = F.transform(F.filter(col(again), lambda e, k: F.coalesce(same(e, k), F.lit(False))), lambda e: e["i"])
    out = out.withColumn(at, F.sort_array(places))
    gaps = F.transform(col(at), lambda p, k: F.least(F.lit(5), F.coalesce(F.get(col(at), k + 1) - p, F.lit(5))))
    out = out.withColumn(lines, F.filter(F.split(whole, "\n"), lambda x: x.rlike(SPACE.replace("[", "[^", 1))))
    values = {
        "n_words": F.size(col(w)),
        "word_chars": F.length(F.array_join(col(w), "")),
        "n_symbols": F.length(whole) - F.length(F.regexp_replace(whole, SYMBOLS + "+", "")),
        "n_lines": F.size(col(lines)),
        "n_dup_lines": F.size(col(lines)) - F.size(F.array_distinct(col(lines))),
        "n_repeat_words": F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0)),
    }
    out = out.select(*[col(c) for c in docs.columns], *[values[m].cast("bigint").alias(names[m]) for m in MEASURES])
    return out, names


def failed(rule: str, names: dict[str, str]) -> Column:
    return F.expr(RULES[rule].format(**{m: f"`{n}`" for m, n in names.items()}))


def base_failed(names: dict[str, str]) -> Column:
    return failed("too_short", names) | failed("repetitive", names)


def host_key(host: Column) -> Column:
    """Text that tells NULL from every name."""
    return F.coalesce(F.concat(F.lit("="), host.cast("string")), F.lit(""))


def host_verdicts(frame: DataFrame, names: dict[str, str], host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """(host_key, n_docs, rate of each rule after shrinkage, host_rejected) of a measured frame."""
    counts = frame.groupBy(host_key(col(host)).alias("host_key")).agg(
        F.count(F.lit(1)).alias("n_docs"), *[F.sum(failed(r, names).cast("bigint")).alias(f"{r}_n") for r in RULES]
    )
    hosts = stored(counts, "host-counts")
    rate = {r: F.col(f"{r}_n") / F.col("n_docs") for r in RULES}
    means = [(F.sum(f"{r}_n") / F.sum("n_docs")).alias(f"{r}_mean") for r in RULES]
    spreads = [F.coalesce(F.var_samp(rate[r]), F.lit(0.0)).alias(f"{r}_spread") for r in RULES]
    prior = hosts.agg(F.struct(*means, *spreads)).scalar()
    shrunk = []
    for r in RULES:
        mean, spread = prior[f"{r}_mean"], prior[f"{r}_spread"]
        strength = F.when(spread > 0, F.greatest(mean * (1 - mean) / spread - 1, F.lit(1.0))).otherwise(F.lit(STRONGEST))
        shrunk.append(((F.col(f"{r}_n") + mean * strength) / (F.col("n_docs") + strength)).alias(f"{r}_rate"))
    rates = hosts.select("host_key", "n_docs", *shrunk)
    return rates.withColumn("host_rejected", F.greatest(*[F.col(f"{r}_rate") for r in RULES]) > limit)


def judged(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """doc_id, measures, base_failed and kept of every row; behind them n_lines and host_rejected."""
    frame = docs.select(F.col("doc_id"), col(text).alias("text"), col(host).cast("string").alias("host"))
    frame, names = measured(frame)
    frame = stored(frame.drop("text"), "measured")
    verdicts = host_verdicts(frame, names, "host").select("host_key", "host_rejected")
    joined = frame.withColumn("host_key", host_key(F.col("host"))).join(verdicts, "host_key", "left")
    base = base_failed(names)
    rejected = F.coalesce("host_rejected", F.lit(False))
    agreed = [m for m in MEASURES if m != "n_lines"]
    return joined.select("doc_id", *agreed, base.alias("base_failed"), (~base & ~rejected).alias("kept"), "n_lines", rejected.alias("host_rejected"))


def good_documents(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The rows that pass, in their columns.

    Rows are stored with their measures once: a filter on measures that aren't stored would be
    pushed below them and take them again. Texts aren't shuffled while rejected hosts are few
    enough for Spark to broadcast them.
    """
    frame, names = measured(docs, text, "q_")
    frame = stored(frame, "measured-documents")
    rejected = stored(host_verdicts(frame, names, host).where("host_rejected").select("host_key"), "rejected-hosts")
    kept = frame.where(~F.coalesce(base_failed(names), F.lit(False)))
    kept = kept.join(rejected, host_key(kept[host]) == rejected["host_key"], "left_anti")
    return kept.select(*[col(c) for c in docs.columns])
