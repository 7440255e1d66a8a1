"""Ad-hoc reports composed from the operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import dims as fd
from strandline.operators import correlation, profiles
from strandline.operators.ordered import top_k

# Words a read-only query must not contain, and its row limit.
BANNED_WORDS = ["DROP", "DELETE", "UPDATE", "INSERT", "ALTER", "TRUNCATE", "CREATE"]
RESULT_LIMIT = 100


#: Functions that run code of the caller's choice.
UNSAFE_FUNCTIONS = {"reflect", "java_method", "try_reflect"}
_LOGICAL = "org.apache.spark.sql.catalyst.plans.logical."
_ANALYSIS = "org.apache.spark.sql.catalyst.analysis."


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


class _Reading:
    """What a parsed query reads: tables by their full names, functions, and whether it does anything but read."""

    def __init__(self, spark: SparkSession, sql: str):
        self.kind = lambda name: spark._jvm.java.lang.Class.forName(name)
        self.commands = [self.kind(_LOGICAL + c) for c in ("Command", "ParsedStatement")]
        self.relation, self.ctes = self.kind(_ANALYSIS + "UnresolvedRelation"), self.kind(_LOGICAL + "UnresolvedWith")
        self.function = self.kind(_ANALYSIS + "UnresolvedFunction")
        self.tables: set[str] = set()
        self.functions: set[str] = set()
        self.writes = False
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
        self.limited = self.kind(_LOGICAL + "GlobalLimit").isInstance(plan)
        self._plan(plan, frozenset())

    def _plan(self, plan, known: frozenset) -> None:
        """``known`` are the names of common table expressions in sight."""
        self.writes |= any(c.isInstance(plan) for c in self.commands)
        if self.relation.isInstance(plan):
            parts = [str(p).lower() for p in _items(plan.multipartIdentifier())]
            if len(parts) > 1 or parts[0] not in known:
                self.tables.add(".".join(parts))
        if self.ctes.isInstance(plan):
            recursive = plan.allowRecursion()
            for pair in _items(plan.cteRelations()):
                name = str(pair._1()).lower()
                self._plan(pair._2(), known | {name} if recursive else known)
                known = known | {name}
        for e in _items(plan.expressions()):
            self._expression(e)
        for part in [*_items(plan.children()), *_items(plan.subqueries())]:
            self._plan(part, known)

    def _expression(self, e) -> None:
        if self.function.isInstance(e):
            self.functions.add(str(_items(e.nameParts())[-1]).lower())
        for child in _items(e.children()):
            self._expression(child)


def safe_select(spark: SparkSession, sql: str, views: list[str], limit: int = RESULT_LIMIT, by_text: bool = False) -> DataFrame:
    """Run a read-only query over registered views, with a row limit when it has none.

    What the query reads is taken from its parsed plan: it must read at least one view, and none that isn't
    allowed, at any depth; commands, files as tables and functions that run foreign code are refused. Names
    of common table expressions are no tables, and words in comments, texts and column names don't count.

    ``by_text`` tests the text instead: it must begin with SELECT, and banned words are found anywhere in it,
    also inside longer names.
    """
    statement = (sql or "").strip()
    if by_text:
        upper = statement.upper()
        if not upper.startswith("SELECT"):
            raise ValueError("only SELECT queries are allowed")
        if any(word in upper for word in BANNED_WORDS):
            raise ValueError("the query contains a banned word")
        if not any(v.lower() in statement.lower() for v in views):
            raise ValueError("the query names none of the allowed views")
        out = spark.sql(statement.rstrip("; \n"))
        return out if re.search(r"\bLIMIT\b", upper) else out.limit(limit)
    statement = statement.rstrip("; \n")
    if not statement:
        raise ValueError("only SELECT queries are allowed")
    reading = _Reading(spark, statement)
    if reading.writes:
        raise ValueError("only SELECT queries are allowed")
    foreign = reading.tables - {v.lower() for v in views}
    if foreign:
        raise ValueError(f"the query reads what isn't allowed: {', '.join(sorted(foreign))}")
    if not reading.tables:
        raise ValueError("the query names none of the allowed views")
    if reading.functions & UNSAFE_FUNCTIONS:
        raise ValueError("the query calls a function that isn't allowed")
    out = spark.sql(statement)
    return out if reading.limited else out.limit(limit)


def find_by_criteria(
    df: DataFrame,
    maker: tuple[str, str | None] = ("director", None),
    min_year: tuple[str, int | None] = ("release_year", None),
    min_rating: tuple[str, float | None] = ("rt_score", None),
    tie: list[str] | None = None,
    limit: int = RESULT_LIMIT,
) -> DataFrame:
    """Rows that meet the criteria given, newest first."""
    if all(v is None for _, v in (maker, min_year, min_rating)):
        raise ValueError("at least one criterion is needed")
    if min_rating[1] is not None and not 0 <= min_rating[1] <= 100:
        raise ValueError("the rating must lie between 0 and 100")
    out = df
    if maker[1]:
        out = out.filter(F.lower(F.col(maker[0])) == maker[1].lower())
    if min_year[1] is not None:
        out = out.filter(F.col(min_year[0]) >= min_year[1])
    if min_rating[1] is not None:
        out = out.filter(F.col(min_rating[0]) >= min_rating[1])
    return out.orderBy(F.col(min_year[0]).desc(), *[F.col(t).asc() for t in tie or []]).limit(limit)


def series_report(series: DataFrame, keys: list[str], time: str, value: Column) -> DataFrame:
    """Level, population variance, range, ends, direction, peak and dip of every series."""
    scored = series.withColumn("_x", value)
    high = F.struct(F.col("_x"), (-F.col(time)).alias("t"))
    low = F.struct(F.col("_x"), F.col(time))
    out = scored.groupBy(*keys).agg(
        F.avg("_x").alias("overall"),
        F.var_pop("_x").alias("variance"),
        (F.max("_x") - F.min("_x")).alias("emotional_range"),
        F.min_by("_x", time).alias("beginning"),
        F.max_by("_x", time).alias("ending"),
        F.max_by(time, high).alias("peak_minute"),
        F.min_by(time, low).alias("dip_minute"),
        F.max("_x").alias("peak_score"),
        F.min("_x").alias("dip_score"),
        F.count(F.lit(1)).alias("n"),
    )
    return out.withColumn(
        "direction",
        F.when(F.col("overall") > 0.1, "positive").when(F.col("overall") < -0.1, "negative").otherwise("neutral"),
    )


def report_extremes(series: DataFrame, keys: list[str], time: str, value: Column, k: int = 5) -> DataFrame:
    """The k highest and lowest buckets of every series."""
    scored = series.select(*keys, time, value.alias("score"))
    parts = [
        top_k(scored, keys, [order, F.col(time).asc()], k).withColumn("side", F.lit(side))
        for side, order in (("peak", F.col("score").desc()), ("valley", F.col("score").asc()))
    ]
    return parts[0].unionByName(parts[1])


def compare_arcs(
    series: DataFrame, keys: list[str], time: str, member: str, value: Column, members: list[str]
) -> dict[str, DataFrame]:
    """Everything about how the members of an entity differ over time.

    ``value`` is a dimension, a compound score or the strongest value of a row.
    """
    if len(members) < 2:
        raise ValueError("at least two members are needed")
    arcs = series.filter(F.col(member).isin(members)).select(*keys, time, member, value.alias("score"))
    aligned = correlation.align_members(arcs, keys, time, member, "score", members)
    pairs = correlation.pairwise_correlation(aligned, keys, members)
    return {
        "correlations": pairs,
        "summary": correlation.correlation_summary(pairs, keys),
        "stats": correlation.arc_stats(arcs, keys, member, "score"),
        "peaks": correlation.arc_peaks(arcs, keys, time, member, "score"),
        "divergence": correlation.divergence(aligned, keys, time, members),
        "distinctive": correlation.distinctive_peaks(arcs, aligned, keys, time, member, "score", members),
    }


def series_export(
    series: DataFrame, time: str, dims: list[str], positive: list[str], negative: list[str],
    start: int | None = None, end: int | None = None,
) -> DataFrame:
    """The series of a range with compound and dominant scores; the range is pushed to the scan."""
    out = series
    if start is not None:
        out = out.filter(F.col(time) >= start)
    if end is not None:
        out = out.filter(F.col(time) <= end)
    return out.withColumn("compound", fd.compound(positive, negative, "mean")).withColumn(
        "dominant", fd.dominant_signed(positive, negative)
    )


def entity_lookup(df: DataFrame, wanted: dict[str, object], columns: list[str] | None = None, defaults: dict[str, object] | None = None) -> DataFrame:
    """Rows of one entity (and member), with defaults for missing values."""
    out = df
    for column, value in wanted.items():
        if value is None:
            continue
        c = F.col(column)
        out = out.filter(F.lower(c) == value.lower() if isinstance(value, str) else c == value)
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in (defaults or {}).items()})
    return out.select(*columns) if columns else out


def summary_by_entity(series: DataFrame, keys: list[str], dims: list[str], count: str) -> DataFrame:
    """Mean vector, buckets and lines per entity and member."""
    means = profiles.mean_vector(series, keys, dims)
    sizes = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("buckets"), F.sum(count).cast("bigint").alias("lines"))
    return means.join(sizes, keys)
