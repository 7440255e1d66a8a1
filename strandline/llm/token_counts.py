"""Exact histogram of encoded lengths, and what its suffix sums answer for every context limit.

Only (length, number of documents) leaves the encoding tasks, pre-aggregated, so a hot source or
many copies cost nothing more. The histogram has as many rows as there are different lengths,
never more than the longest text has tokens. Sums along the lengths are taken in two levels:
within blocks of lengths, and over the blocks, whose number is the longest length / ``BLOCK``.

NULL and empty texts have length 0 and count as documents; repeated rows count each time; an
empty table gives an empty histogram.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.bpe import encoded
from strandline.llm.common import stored

BLOCK = 4096


def length_histogram(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(n_tokens, n_docs) over all rows."""
    lengths = encoded(docs, path, text, make=lambda codes, decoded: (len(codes) // 4,), schema="n_tokens bigint", keep=[], decode=False)
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def context_limits(histogram: DataFrame) -> DataFrame:
    """For every occurring length, taken as a context limit, the exact answers.

    docs_within / docs_beyond: documents of at most / over that length; tokens_within: tokens of
    the first; truncated_total: tokens left when every document is cut to the limit;
    cut_tokens: tokens lost by that; share_within: the limit is the quantile of every share in
    (share_within of the next shorter length, share_within].
    """
    hist = stored(histogram, "length-histogram").withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    sums = [F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("tokens")]
    blocks = hist.groupBy("block").agg(*sums)
    above = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("docs", "tokens")],
        *[F.sum(c).over(every).alias(f"{c}_all") for c in ("docs", "tokens")],
    )
    longer = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    beyond = F.coalesce(F.sum("n_docs").over(longer), F.lit(0))
    lost = F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")).over(longer), F.lit(0))
    parts = hist.withColumns({"_docs": beyond, "_tokens": lost}).join(blocks, "block")
    docs_beyond = F.col("_docs") + F.col("docs_above")
    tokens_beyond = F.col("_tokens") + F.col("tokens_above")
    return parts.select(
        "n_tokens",
        "n_docs",
        (F.col("docs_all") - docs_beyond).alias("docs_within"),
        docs_beyond.alias("docs_beyond"),
        (F.col("tokens_all") - tokens_beyond).alias("tokens_within"),
        (F.col("tokens_all") - tokens_beyond + docs_beyond * F.col("n_tokens")).alias("truncated_total"),
        (tokens_beyond - docs_beyond * F.col("n_tokens")).alias("cut_tokens"),
        ((F.col("docs_all") - docs_beyond) / F.col("docs_all")).alias("share_within"),
    )


def at_limits(limits: DataFrame, wanted: list[int]) -> DataFrame:
    """The answers for given context limits, whether or not a document has that very length.

    A row for each wanted limit; NULL sums of an empty table become 0.
    """
    out = None
    for limit in wanted:
        below = limits.where(F.col("n_tokens") <= limit)
        row = below.agg(
            F.lit(limit).cast("bigint").alias("context"),
            F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs_within"),
            F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")), F.lit(0)).alias("tokens_within"),
        )
        over = limits.where(F.col("n_tokens") > limit).agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"))
        row = row.withColumn("docs_beyond", over.scalar())
        out = row if out is None else out.unionAll(row)
    return out.withColumn("truncated_total", F.col("tokens_within") + F.col("context") * F.col("docs_beyond"))


def quantiles(limits: DataFrame, shares: list[float]) -> DataFrame:
    """The shortest length within which each share of the documents lies; NULL for no documents."""
    picked = [F.min(F.when(F.col("share_within") >= s, F.col("n_tokens"))).alias(f"q{k}") for k, s in enumerate(shares)]
    pairs = F.explode(F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(f"q{k}").alias("n_tokens")) for k, s in enumerate(shares)]))
    return limits.agg(*picked).select(pairs.alias("p")).select("p.*")
