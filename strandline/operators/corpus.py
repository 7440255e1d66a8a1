"""Text corpora: chunks, templates, scores, statistics, rubric and ledger."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import dims as fd
from strandline.functions import text
from strandline.operators.ordered import chunked_running_sum, global_row_ids, top_k
from strandline.operators.series import lines_of_peaks
from strandline.session import scratch_path

# Patterns of the answer rubric and its weights.
STATISTICAL_PATTERNS = [
    (r"correlation", "correlation"),
    (r"r\s*=\s*[0-9.-]+", "correlation"),
    (r"p\s*[-=]\s*value\s*[=:]\s*[0-9.e-]+", "pvalue"),
    (r"p\s*<\s*0\.05", "pvalue"),
    (r"p\s*>\s*0\.05", "pvalue"),
    (r"z\s*[-=]\s*score\s*[=:]\s*[0-9.-]+", "zscore"),
    (r"quartile", "quartile"),
    (r"trajectory", "trajectory"),
    (r"statistical\s+significance", "significance"),
    (r"n\s*=\s*\d+", "sample_size"),
]
METRIC_PATTERNS = [
    r"compound[\s_]sentiment",
    r"sentiment[\s_]variance",
    r"emotional[\s_]range",
    r"peak[\s_]positive",
    r"beginning[\s_]sentiment",
    r"ending[\s_]sentiment",
    r"avg[\s_]compound",
    r"sentiment[\s_]trajectory",
    r"sentiment\s+(score|value|metric|analysis)",
]
INTERPRETATION_PATTERNS = [
    r"Based on this (emotional pattern|dialogue pattern|data|sentiment|emotion)",
    r"I imagine (this|that|it)",
    r"The data suggests (this|that|it)",
    r"My interpretation (is|of)",
    r"If I had to guess",
    r"This emotional signature (feels|suggests|indicates)",
    r"Based on this combination",
    r"I imagine this (could be|is|might be)",
    r"Looking at the.*context.*I (imagine|see)",
    r"interpretation",
    r"narratively",
]
SCORE_PATTERNS = [
    r"\([a-z_]+\s*:\s*[0-9.]+(?:\s*,\s*[a-z_]+\s*:\s*[0-9.]+)*\)",
    r"[a-z_]+\s*:\s*[0-9.]+(?:\s*,\s*[a-z_]+\s*:\s*[0-9.]+)+",
]
QUOTE_PATTERNS = [r"['\"]([^'\"]{10,})['\"]", r"['\"]([^'\"]{5,})['\"]"]
TIME_PATTERNS = [r"minute\s+\d+", r"\d{1,2}:\d{2}:\d{2}", r"\d{4}-\d{2}-\d{2}"]
ID_PATTERNS = [r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", r"film_id\s*[=:]\s*[\w-]+"]
RUBRIC_WEIGHTS = {"citations": 0.15, "statistics": 0.25, "metrics": 0.25, "interpretation": 0.25, "elements": 0.10}
RUBRIC_PASS = 0.70


def chunk_text(df: DataFrame, column: str, max_tokens: int = 300, overlap: int = 50) -> DataFrame:
    """Overlapping chunks of white-space tokens, one row per chunk.

    A text of at most ``max_tokens`` stays whole. Chunks start every ``max_tokens -
    overlap`` tokens until the text is used up, so the last one may consist of
    overlap only. The chunk list is never empty; the outer explode keeps Catalyst from
    adding a not-empty filter that would tokenise every text again below.
    """
    tokens = text.words(column)
    step = max_tokens - overlap
    cut = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("_t") - 1, F.lit(0)), F.lit(step)),
        lambda i: F.array_join(F.slice("_t", i + 1, F.lit(max_tokens)), " "),
    )
    chunks = F.when(F.size("_t") <= max_tokens, F.array(F.col(column))).otherwise(cut)
    return (
        df.withColumn("_t", tokens)
        .withColumn("_c", chunks)
        .select(
            *[c for c in df.columns if c != column],
            F.size("_c").cast("bigint").alias("total_chunks"),
            F.posexplode_outer("_c").alias("_i", "chunk"),
        )
        .withColumn("chunk_num", (F.col("_i") + 1).cast("bigint"))
        .drop("_i")
    )


def chunk_with_tokenizer(
    df: DataFrame,
    column: str,
    encode: Callable[[str], list[int]],
    decode: Callable[[list[int]], str],
    max_tokens: int = 300,
    overlap: int = 50,
) -> DataFrame:
    """The same chunking with a caller-supplied tokenizer, in Arrow batches."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            tokens = encode(t or "")
            if len(tokens) <= max_tokens:
                out.append([t])
            else:
                starts = range(0, len(tokens), max_tokens - overlap)
                out.append([decode(tokens[i : i + max_tokens]) for i in starts])
        return pd.Series(out)

    return (
        df.withColumn("_c", cut(column))
        .select(
            *[c for c in df.columns if c != column],
            F.size("_c").cast("bigint").alias("total_chunks"),
            F.posexplode_outer("_c").alias("_i", "chunk"),
        )
        .withColumn("chunk_num", (F.col("_i") + 1).cast("bigint"))
        .drop("_i")
    )


def count_tokens(column: str, encode: Callable[[str], list[int]]) -> Column:
    """Token counts by a caller-supplied tokenizer, in Arrow batches."""

    @F.arrow_udf("bigint")
    def counts(texts: pa.Array) -> pa.Array:
        return token_lengths(texts, encode)

    return counts(column)


def token_lengths(texts: pa.Array, encode: Callable[[str], list[int]]) -> pa.Array:
    """Tokens of each text, 0 for NULL; one text at a time becomes a Python string, whatever the batch holds."""
    lengths = (len(encode(t)) if (t := text.as_py()) else 0 for text in texts)
    return pa.array(np.fromiter(lengths, np.int64, len(texts)))


def entity_documents(
    df: DataFrame,
    kind: str,
    key: str,
    name: str,
    opening: Column,
    parts: list[tuple[str, str, str]],
    description: str | None = None,
    metadata: list[str] | None = None,
) -> DataFrame:
    """One document per entity: its description, or an opening sentence and its facts.

    ``parts`` are (column, text before, text after); a fact is skipped when its value
    is NULL, '' or 0.
    """

    def fact(column: str, before: str, after: str) -> Column:
        value = F.col(column).cast("string")
        blank = value.isNull() | value.isin("", "0", "0.0")
        return F.when(~blank, F.concat(F.lit(before), value, F.lit(after)))

    made = F.concat_ws(" ", opening, *[fact(*p) for p in parts])
    body = made
    if description is not None:
        body = F.when(F.coalesce(F.trim(F.col(description)), F.lit("")) == "", made).otherwise(F.col(description))
    meta = F.to_json(F.struct(*(metadata or [])), {"ignoreNullFields": "false"}) if metadata else F.lit("{}")
    return df.filter(F.col(name).isNotNull()).select(
        F.concat(F.lit(kind + "_"), F.col(key).cast("string")).alias("doc_id"),
        F.lit(kind).alias("type"),
        F.col(name).alias("name"),
        body.alias("text"),
        meta.alias("metadata"),
    )


def joined_lines(
    lines: DataFrame, keys: list[str], line: str, order: list[str], limit: int = 500, keep: int = 497
) -> DataFrame:
    """The lines of every key joined by blanks and cut to a length.

    NULL lines add nothing, not even a separator, and are ordered last. Every other line but the
    first adds its separator at least, so ``limit + 2`` of them are longer than ``limit`` and
    decide the cut text; no more are gathered for one key.
    """
    first = top_k(lines, keys, [F.col(line).isNull().asc(), *[F.col(c).asc() for c in order]], limit + 2, "_rank")
    packed = first.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_rank", F.col(line).alias("line")))).alias("_l")
    )
    joined = F.array_join(F.transform("_l", lambda x: x["line"]), " ")
    return packed.select(*keys, text.truncate_text(joined, limit, keep).alias("text"))


def quote_documents(
    top_buckets: DataFrame,
    lines: DataFrame,
    keys: list[str],
    time: str,
    start: str,
    line: str,
    order: list[str],
    scores: list[str],
    width: int = 60,
) -> DataFrame:
    """The lines of every top bucket as one document with its scores as metadata."""
    found = lines_of_peaks(top_buckets.select(*keys, time), lines, keys, time, start, width)
    bodies = joined_lines(found, [*keys, time], line, order)
    return bodies.join(top_buckets.select(*keys, time, *scores), [*keys, time]).select(
        text.composite_key(F.lit("quote"), *keys, time).alias("doc_id"),
        F.lit("quote").alias("type"),
        *keys,
        time,
        "text",
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in scores],
    )


def corpus_stats(docs: DataFrame, kind: str, column: str) -> DataFrame:
    """Documents, mean length and tokens and blank texts per type."""
    return docs.groupBy(kind).agg(
        F.count(F.lit(1)).alias("documents"),
        F.avg(F.length(column)).alias("avg_length"),
        F.avg(text.estimate_tokens(column)).alias("avg_tokens"),
        F.count(F.when(F.coalesce(text.collapse_space(column), F.lit("")) == "", 1)).alias("empty_texts"),
    )


def corpus_in_range(docs: DataFrame, low: int = 100, high: int = 2000) -> DataFrame:
    one = docs.agg(F.count(F.lit(1)).alias("total_documents"))
    return one.withColumn("in_expected_range", F.col("total_documents").between(low, high))


def embedding_cost(docs: DataFrame, column: str, per_million: float = 0.02, budget: float = 2.0) -> DataFrame:
    one = docs.agg(F.count(F.lit(1)).alias("total_documents"), F.coalesce(F.sum(text.estimate_tokens(column)), F.lit(0)).alias("total_tokens"))
    cost = F.col("total_tokens") / F.lit(1000000.0) * F.lit(per_million)
    return one.select("*", cost.alias("estimated_cost_usd"), (cost < budget).alias("under_budget"))


def batch_ids(df: DataFrame, order: list[str], size: int = 100) -> DataFrame:
    """Consecutive batches of a fixed size along an order."""
    return global_row_ids(df, order, "_id").withColumn("batch_id", F.floor((F.col("_id") - 1) / size).cast("bigint")).drop("_id")


def pattern_count(column: str | Column, patterns: list[str]) -> Column:
    """Occurrences of all patterns together, ignoring case."""
    total = F.lit(0)
    for p in patterns:
        total = total + F.regexp_count(column, F.lit("(?i)" + p))
    return total.cast("bigint")


def any_pattern(column: str, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | F.col(column).rlike("(?i)" + p)
    return out


def detect_patterns(df: DataFrame, column: str, citations: list[str]) -> DataFrame:
    """Counts of citations, statistics, metrics, interpretation, scores and quotes."""
    by_kind = {}
    for p, kind in STATISTICAL_PATTERNS:
        by_kind.setdefault(kind, []).append(p)
    hits = pattern_count(column, citations)
    for p in TIME_PATTERNS + ID_PATTERNS:
        hits = hits + F.col(column).rlike("(?i)" + p).cast("bigint")
    return df.withColumns(
        {
            "citation_count": hits,
            "has_timestamps": any_pattern(column, TIME_PATTERNS),
            "has_ids": any_pattern(column, ID_PATTERNS),
            "stat_count": pattern_count(column, [p for p, _ in STATISTICAL_PATTERNS]),
            **{
                f"has_{kind}": any_pattern(column, by_kind[kind])
                for kind in ("correlation", "pvalue", "quartile", "zscore", "sample_size")
            },
            "metric_count": pattern_count(column, METRIC_PATTERNS),
            "interpretation_count": pattern_count(column, INTERPRETATION_PATTERNS),
            "score_count": pattern_count(column, SCORE_PATTERNS),
            "quote_count": pattern_count(column, QUOTE_PATTERNS),
        }
    )


def expected_terms(df: DataFrame, column: str, terms: str) -> DataFrame:
    """Terms of an array column that occur in the text, ignoring case, and those missing."""
    lowered = F.lower(F.col(column))
    return df.withColumn("found_terms", F.filter(terms, lambda t: F.contains(lowered, F.lower(t)))).withColumn(
        "missing_terms", F.filter(terms, lambda t: ~F.contains(lowered, F.lower(t)))
    )


def rubric_score(df: DataFrame, column: str, citations: list[str], terms: str) -> DataFrame:
    """Weighted score of an answer and whether it passes."""
    marked = expected_terms(detect_patterns(df, column, citations), column, terms)
    two = lambda c: F.least(F.lit(1.0), F.col(c) / 2.0)
    elements = sum([(F.col(c) > 0).cast("double") for c in ("interpretation_count", "score_count", "quote_count")], F.lit(0.0))
    found = F.coalesce(
        F.try_divide(F.size("found_terms").cast("double"), F.size(terms).cast("double")), F.lit(0.0)
    )
    w = RUBRIC_WEIGHTS
    scored = marked.withColumns(
        {
            "citation_score": two("citation_count"),
            "stat_score": two("stat_count"),
            "metric_score": two("metric_count"),
            "interpretation_score": F.least(F.lit(1.0), elements / 2.0),
            "element_score": found,
        }
    ).withColumn(
        "validation_score",
        F.col("citation_score") * w["citations"]
        + F.col("stat_score") * w["statistics"]
        + F.col("metric_score") * w["metrics"]
        + F.col("interpretation_score") * w["interpretation"]
        + F.col("element_score") * w["elements"],
    )
    return scored.withColumn("passed", F.col("validation_score") >= RUBRIC_PASS)


def rubric_report(scored: DataFrame, category: str) -> DataFrame:
    """Answers, passes, pass rate and mean score per category and overall."""
    return scored.rollup(category).agg(
        F.grouping(category).alias("_all"),
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(F.col("passed"), 1)).alias("passed"),
        F.avg("validation_score").alias("mean_score"),
    ).select(
        F.when(F.col("_all") == 1, "_ALL_").otherwise(F.col(category)).alias(category),
        "total",
        "passed",
        F.try_divide(F.col("passed").cast("double"), F.col("total").cast("double")).alias("pass_rate"),
        "mean_score",
    )


def narrative_excerpts(
    minutes: DataFrame,
    series: DataFrame,
    excerpts: DataFrame,
    keys: list[str],
    time: str,
    dims: list[str],
    compound: Column,
    threshold: float = 0.01,
) -> DataFrame:
    """Excerpts, visible dimensions and compound score of chosen buckets."""
    scored = series.select(*keys, time, fd.nonzero_dims(dims, threshold).alias("emotions"), compound.alias("compound"))
    empty = F.from_json(F.lit("{}"), "map<string,double>")
    return (
        minutes.select(*keys, time).distinct()
        .join(scored, [*keys, time], "left")
        .join(excerpts, [*keys, time], "left")
        .select(
            *keys, time,
            F.coalesce("excerpts", F.array(F.lit("[No dialogue]"))).alias("dialogue"),
            F.coalesce("emotions", empty).alias("emotions"),
            F.coalesce("compound", F.lit(0.0)).alias("compound"),
        )
    )


def lexicon_scores(df: DataFrame, ident: str, column: str, lexicon: DataFrame) -> DataFrame:
    """Sum of the lexicon weights of a text's words per label, over its number of words.

    ``lexicon`` has word, label and weight, each (word, label) once. Every text has a row for
    every label, 0 where no word of it occurs (also for texts without words). Words are counted
    per text before the join, so a frequent word is one row per text.
    """
    split = df.select(F.col(ident), text.words(F.lower(F.col(column))).alias("_w"))
    words = split.select(ident, F.size("_w").alias("_all"), F.explode_outer("_w").alias("word"))
    counted = words.filter(F.col("word").isNotNull()).groupBy(ident, "_all", "word").agg(F.count(F.lit(1)).alias("_n"))
    hits = counted.join(lexicon, "word").groupBy(ident, "_all", "label").agg(F.sum(F.col("_n") * F.col("weight")).alias("_s"))
    found = hits.select(ident, "label", F.try_divide(F.col("_s"), F.col("_all").cast("double")).alias("score"))
    labels = lexicon.agg(F.array_sort(F.collect_set("label"))).scalar()
    every = df.select(ident, F.explode(labels).alias("label")).distinct()
    return every.join(found, [ident, "label"], "left").select(ident, "label", F.coalesce("score", F.lit(0.0)).alias("score"))


def score_text(
    df: DataFrame, column: str, scorer: Callable[[list[str]], list[dict[str, float]]], labels: list[str],
    max_words: int = 450, prefix: str = "emotion_",
) -> DataFrame:
    """Scores of every text for all labels, by a caller-supplied scorer in Arrow batches.

    The scorer sees texts cut to ``max_words`` words. Blank texts score 0 everywhere
    and are not passed on; labels the scorer leaves out score 0.
    """
    schema = "struct<" + ",".join(f"`{x}`:double" for x in labels) + ">"

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            filled = texts.fillna("")
            wanted = filled[filled.str.strip() != ""]
            made = dict(zip(wanted.index, scorer(wanted.tolist()))) if len(wanted) else {}
            rows = [[float(made.get(i, {}).get(x, 0.0)) for x in labels] for i in filled.index]
            yield pd.DataFrame(rows, columns=labels)

    scored = df.withColumn("_scores", run(text.truncate_words(column, max_words)))
    return scored.select(*df.columns, *[F.col(f"_scores.`{x}`").alias(prefix + x) for x in labels])


def running_cost_ledger(
    usage: DataFrame,
    prices: DataFrame,
    session: str,
    seq: str,
    model: str,
    fallback: str,
    limit: float = 20.0,
    thresholds: tuple[float, ...] = (5.0, 10.0, 15.0),
) -> DataFrame:
    """Cost of every call, running total per session, thresholds crossed, calls over the limit.

    ``usage`` has input_tokens and output_tokens, ``prices`` input and output prices per
    1000 tokens and model; unknown models pay the fallback model's price. A call that would
    bring its session's total to the limit is rejected and not charged, and a cheaper one
    behind it may still pass. A call without a cost is neither charged nor rejected.

    Calls are numbered along (session, seq) and the sums run over chunks of that order, so a session
    may be spread over any number of tasks. :func:`rejected_calls` says which calls aren't charged.
    """
    default = prices.filter(F.col("model") == fallback).select(F.struct("input", "output").alias("p")).scalar()
    known = prices.select(F.col("model").alias("_m"), F.struct("input", "output").alias("_p"))
    priced = usage.join(known, F.col(model) == F.col("_m"), "left").withColumn("_p", F.coalesce(F.col("_p"), default))
    cost = F.col("input_tokens") / 1000.0 * F.col("_p.input") + F.col("output_tokens") / 1000.0 * F.col("_p.output")
    charged = priced.withColumn("cost", cost).drop("_m", "_p")
    names = charged.columns
    numbered = global_row_ids(charged, [session, seq], "_row")
    at = scratch_path(usage.sparkSession, "numbered-calls")
    numbered.withColumn("_of", F.coalesce(F.concat(F.lit("="), F.col(session).cast("string")), F.lit(""))).write.parquet(at)
    calls = usage.sparkSession.read.parquet(at)
    gone = rejected_calls(calls.select("_of", "_row", F.coalesce("cost", F.lit(0.0)).alias("cost")), limit)
    marked = calls.join(gone.select("_row", F.lit(True).alias("rejected")), "_row", "left").withColumn("rejected", F.coalesce("rejected", F.lit(False)))
    paid = F.when(F.col("rejected"), F.lit(0.0)).otherwise(F.coalesce("cost", F.lit(0.0)))
    out = chunked_running_sum(marked.withColumn("_paid", paid), ["_of"], ["_row"], F.col("_paid"), "session_total", F.floor(F.col("_row") / CHUNK_CALLS))
    # what was paid before is a difference of sums, so both sides are compared beyond its rounding
    before, after = F.round(F.col("session_total") - F.col("_paid"), 9), F.round("session_total", 9)
    crossed = F.filter(F.array(*[F.when((before < t) & (after >= t), F.lit(t)) for t in thresholds]), lambda x: x.isNotNull())
    return out.select(*names, "session_total", crossed.alias("thresholds_crossed"), "rejected")


#: Calls of one session that a task sums up together.
CHUNK_CALLS = 100_000


def rejected_calls(calls: DataFrame, limit: float, chunk: int = CHUNK_CALLS) -> DataFrame:
    """(_of, _row) of the calls that a saturating sum leaves out, from (_of, _row, cost).

    What a session has paid only grows, so its room only shrinks. One running sum settles all sessions
    that stay below the limit, and the others up to their first crossing, which is rejected. Behind it
    a call that costs no less than the room left is rejected for good; only cheaper ones go into the
    next round, over their own calls alone. Every round charges or rejects the first open call of each
    session at least; lineage is cut by a written table each round.
    """
    spark = calls.sparkSession
    gone: list[DataFrame] = []
    open_ = calls.withColumn("paid", F.lit(0.0))
    while True:
        at = scratch_path(spark, "open-calls")
        open_.write.parquet(at)
        open_ = spark.read.schema("_of string, _row bigint, cost double, paid double").parquet(at)
        total = F.col("paid") + F.col("sum")
        summed = chunked_running_sum(open_, ["_of"], ["_row"], F.col("cost"), "sum", F.floor(F.col("_row") / chunk))
        crossing = summed.where(total >= limit).groupBy("_of").agg(F.min(F.struct("_row", (total - F.col("cost")).alias("paid"))).alias("x"))
        at = scratch_path(spark, "crossings")
        crossing.select("_of", F.col("x._row").alias("first"), F.col("x.paid").alias("now")).write.parquet(at)
        crossing = spark.read.schema("_of string, first bigint, now double").parquet(at)
        if crossing.isEmpty():
            break
        later = open_.join(crossing, "_of").where(F.col("_row") >= F.col("first"))
        fits = (F.col("_row") > F.col("first")) & (F.col("now") + F.col("cost") < limit)
        gone.append(later.where(~fits).select("_of", "_row"))
        open_ = later.where(fits).select("_of", "_row", "cost", F.col("now").alias("paid"))
    out = calls.select("_of", "_row").where("false")
    for part in gone:
        out = out.unionAll(part)
    return out
