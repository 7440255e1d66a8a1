"""Matching and joining of entity tables.

No join is hinted: Catalyst broadcasts a side whose measured size allows it and AQE
splits skewed partitions of the rest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import text
from strandline.session import cut_lineage


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumnsRenamed({c: prefix + c for c in df.columns})


def match_on_title(left: DataFrame, right: DataFrame, left_title: str, right_title: str) -> DataFrame:
    """Left join on the trimmed lower-case titles."""
    return left.join(right, F.lower(F.trim(left[left_title])) == F.lower(F.trim(right[right_title])), "left")


def join_on_slug(
    df: DataFrame, dimension: DataFrame, slug: str, title: str, required: bool = True
) -> DataFrame:
    """Join rows to a dimension by slug; with ``required`` unmatched rows disappear."""
    keyed = dimension.withColumn("_slug", text.plain_slug(title))
    joined = df.withColumn("_base", text.strip_language(slug)).join(
        keyed, F.col("_base") == F.col("_slug"), "inner" if required else "left"
    )
    return joined.drop("_slug", "_base")


def coalesce_join(
    df: DataFrame,
    lookup: DataFrame,
    id_column: str,
    lookup_id: str,
    name: Column,
    lookup_name: Column,
    values: list[str],
) -> DataFrame:
    """Values by id first, then by normalised name."""
    by_id = lookup.select(F.col(lookup_id).alias("_id"), *[F.col(v).alias(f"_a_{v}") for v in values])
    by_name = lookup.select(lookup_name.alias("_name"), *[F.col(v).alias(f"_b_{v}") for v in values])
    joined = df.withColumn("_key", name)
    joined = joined.join(by_id, joined[id_column] == by_id["_id"], "left").join(
        by_name, F.col("_key") == F.col("_name"), "left"
    )
    out = joined.withColumns({v: F.coalesce(F.col(f"_a_{v}"), F.col(f"_b_{v}")) for v in values})
    return out.select(*df.columns, *values)


def explode_join(df: DataFrame, links: str, target: DataFrame, url: str) -> DataFrame:
    """One row per link of an array column that a target row answers to."""
    rows = df.filter(F.size(links) > 0).withColumn("_url", F.explode(links)).drop(links)
    return rows.join(target, rows["_url"] == target[url]).drop("_url")


def fk_url_join(df: DataFrame, link: str, target: DataFrame, url: str) -> DataFrame:
    """Join on one link column; NULL and '' never match."""
    return df.filter(F.col(link).isNotNull() & (F.col(link) != "")).join(target, df[link] == target[url])


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Referenced keys without a parent, with the number of referring rows.

    References are counted per key before the join, so a hot key is one row.
    """
    counted = child.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("references"))
    return counted.join(parent.select(F.col(parent_key).alias("_p")), F.col(key) == F.col("_p"), "left_anti")


def unmatched(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column) -> DataFrame:
    """Rows of the left table whose key the right table lacks (NULL keys count as lacking)."""
    other = right.select(right_key.alias("_k"))
    return left.withColumn("_l", left_key).join(other, F.col("_l") == F.col("_k"), "left_anti").drop("_l")


def set_compare(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with the side that has them: both, only_a or only_b; one shuffle of distinct keys."""
    tagged = a.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    return tagged.groupBy(*keys).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b")).select(
        *keys,
        F.when((F.col("_a") == 1) & (F.col("_b") == 1), "both")
        .when(F.col("_a") == 1, "only_a")
        .otherwise("only_b")
        .alias("side"),
    )


def resolve_entity_id(
    df: DataFrame, dimension: DataFrame, name: str, slug: str, dim_id: str, dim_title: str
) -> DataFrame:
    """Entity id by name, or by the title rebuilt from the slug when there is no name."""
    rebuilt = text.title_from_slug(text.strip_version_and_language(slug))
    wanted = F.lower(F.when(F.coalesce(F.col(name), F.lit("")) != "", F.col(name)).otherwise(rebuilt))
    ids = dimension.groupBy(F.lower(F.col(dim_title)).alias("_t")).agg(F.min(dim_id).alias("resolved_id"))
    return df.withColumn("_w", wanted).join(ids, F.col("_w") == F.col("_t"), "left").drop("_w", "_t")


def alias_match(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, aliases: DataFrame
) -> DataFrame:
    """Set match of two key columns, then known aliases for the leftovers.

    ``aliases`` has ``left_name`` and ``right_name``. Returns the compared keys with
    ``match``: exact, alias, only_left or only_right.
    """
    a = left.select(F.col(left_key).alias("k")).distinct()
    b = right.select(F.col(right_key).alias("k")).distinct()
    compared = set_compare(a, b, ["k"])
    left_only = compared.filter(F.col("side") == "only_a").select(F.col("k").alias("left_name"))
    right_only = compared.filter(F.col("side") == "only_b").select(F.col("k").alias("right_name"))
    linked = aliases.select("left_name", "right_name").distinct().join(left_only, "left_name").join(right_only, "right_name")
    exact = compared.filter(F.col("side") == "both").select(
        F.col("k").alias("left_name"), F.col("k").alias("right_name"), F.lit("exact").alias("match")
    )
    via = linked.select("left_name", "right_name", F.lit("alias").alias("match"))
    none = F.lit(None).cast("string")
    rest_left = left_only.join(linked, "left_name", "left_anti").select(
        "left_name", none.alias("right_name"), F.lit("only_left").alias("match")
    )
    rest_right = right_only.join(linked, "right_name", "left_anti").select(
        none.alias("left_name"), "right_name", F.lit("only_right").alias("match")
    )
    return exact.unionByName(via).unionByName(rest_left).unionByName(rest_right)


def _grams(c: Column, size: int) -> Column:
    """All substrings of one size; none when the text is shorter."""
    return F.when(
        F.length(c) >= size, F.transform(F.sequence(F.lit(1), F.length(c) - size + 1), lambda i: F.substr(c, i, F.lit(size)))
    ).otherwise(F.array().cast("array<string>"))


def containment_pairs(
    short: DataFrame, long: DataFrame, pattern: str, target: str, wildcard: bool = False, size: int = 4
) -> DataFrame:
    """Pairs whose pattern occurs inside the target, without a nested-loop join.

    A pattern can only occur where all of its character grams occur. Every pattern
    looks up the one of its grams that is rarest among the targets (or itself, when
    shorter than a gram), so the join is an equality join and common grams are not
    used; the containment is verified on the few candidates. With ``wildcard`` an
    underscore of the pattern matches any character and a percent sign any run of them,
    as in SQL LIKE; a pattern of wildcards alone asks for a length, so it looks up all
    lengths from there (those of a pattern without a percent sign count as found inside). Blank patterns match nothing.
    """
    patterns = short.select(F.col(pattern).alias("_p")).filter(F.col("_p") != "").distinct()
    targets = long.select(F.col(target).alias("_t")).filter(F.col("_t") != "").distinct()
    pieces = F.split("_p", "[_%]") if wildcard else F.array("_p")
    literal = F.filter(pieces, lambda x: x != "")
    keys = F.flatten(
        F.transform(literal, lambda x: F.when(F.length(x) < size, F.array(x)).otherwise(_grams(x, size)))
    )
    every = F.array_distinct(F.concat(*[_grams(F.col("_t"), n) for n in range(1, size + 1)]))
    index = targets.select("_t", F.explode_outer(every).alias("_g")).filter(F.col("_g").isNotNull())
    frequency = index.groupBy("_g").agg(F.count(F.lit(1)).alias("_f"))
    needed = patterns.select("_p", F.explode_outer(F.array_distinct(keys)).alias("_g")).filter(F.col("_g").isNotNull())
    rarest = (
        needed.join(frequency, "_g", "left")
        .groupBy("_p")
        .agg(F.min_by("_g", F.struct(F.coalesce(F.col("_f"), F.lit(0)).alias("f"), F.col("_g").alias("g"))).alias("_g"))
    )
    check = F.expr("_t LIKE concat('%', _p, '%')") if wildcard else F.col("_t").contains(F.col("_p"))
    found = rarest.join(index, "_g").filter(check).select("_p", "_t")
    if wildcard:
        loose = patterns.filter(F.col("_p").rlike("^[_%]+$")).withColumn("_n", F.length(F.regexp_replace("_p", "%", "")))
        lengths = targets.select("_t", F.length("_t").alias("_l"))
        asked = loose.withColumn("_top", lengths.agg(F.max("_l")).scalar()).filter("_n <= _top")
        asked = asked.select("_p", F.explode(F.sequence("_n", "_top")).alias("_l"))
        found = found.unionByName(asked.join(lengths, "_l").select("_p", "_t"))
    return found.select(F.col("_p").alias(pattern), F.col("_t").alias(target))


def pattern_join(df: DataFrame, dimension: DataFrame, title: str, slug: str) -> DataFrame:
    """Left join of a dimension to the rows whose slug contains its title slug."""
    keyed = dimension.withColumn("_pattern", text.plain_slug(title))
    pairs = containment_pairs(keyed, df, "_pattern", slug, wildcard=True)
    return keyed.join(pairs, "_pattern", "left").join(df, slug, "left").drop("_pattern")


def substring_candidates(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Pairs where either text contains the other."""
    inside = containment_pairs(left, right, left_key, right_key)
    around = containment_pairs(right, left, right_key, left_key)
    return inside.unionByName(around).distinct()


def greedy_one_to_one(candidates: DataFrame, first: str, second: str) -> DataFrame:
    """The one-to-one assignment of taking firsts in order, each with its first free second.

    Runs in rounds: a pair is final when its second is the smallest left for its
    first, and its first the smallest left for its second. Nobody earlier can then
    claim either, so a round settles many pairs at once and the result is that of the
    sequential loop. Lineage is cut per round.
    """
    left = cut_lineage(candidates.select(first, second).distinct())
    settled: DataFrame | None = None
    while not left.isEmpty():
        by_first = left.groupBy(first).agg(F.min(second).alias("_s"))
        by_second = left.groupBy(second).agg(F.min(first).alias("_f"))
        final = cut_lineage(
            by_first.join(by_second, (F.col("_s") == F.col(second)) & (F.col("_f") == F.col(first))).select(first, second)
        )
        settled = final if settled is None else settled.unionByName(final)
        left = cut_lineage(
            left.join(final.select(first), first, "left_anti").join(final.select(second), second, "left_anti")
        )
    return settled if settled is not None else candidates.select(first, second).limit(0)


def fuzzy_substring_match(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Exact matches first, then one-to-one containment matches of the leftovers.

    Keys are compared trimmed and in lower case. Returns both keys and the match type.
    """
    a = left.select(F.lower(F.trim(left_key)).alias(left_key)).filter(F.col(left_key).isNotNull()).distinct()
    b = right.select(F.lower(F.trim(right_key)).alias(right_key)).filter(F.col(right_key).isNotNull()).distinct()
    exact = a.join(b, F.col(left_key) == F.col(right_key)).select(left_key, right_key, F.lit("exact").alias("match"))
    rest_a = a.join(b, F.col(left_key) == F.col(right_key), "left_anti")
    rest_b = b.join(a, F.col(left_key) == F.col(right_key), "left_anti")
    pairs = greedy_one_to_one(substring_candidates(rest_a, rest_b, left_key, right_key), left_key, right_key)
    return exact.unionByName(pairs.withColumn("match", F.lit("fuzzy_substring")))


def cross_reference(matches: DataFrame, left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Counts of exact and fuzzy matches and of the leftovers on both sides.

    Each input becomes one tagged row per distinct key, and one aggregation counts.
    """
    a = left.select(F.lower(F.trim(left_key)).alias(left_key)).filter(F.col(left_key).isNotNull()).distinct()
    b = right.select(F.lower(F.trim(right_key)).alias(right_key)).filter(F.col(right_key).isNotNull()).distinct()
    tags = [
        matches.select(F.col("match").alias("tag")),
        a.join(matches.select(left_key), left_key, "left_anti").select(F.lit("only_left").alias("tag")),
        b.join(matches.select(right_key), right_key, "left_anti").select(F.lit("only_right").alias("tag")),
    ]
    rows = reduce(DataFrame.unionByName, tags)
    return rows.agg(
        *[
            F.count(F.when(F.col("tag") == tag, 1)).alias(out)
            for tag, out in [
                ("exact", "exact_matches"), ("fuzzy_substring", "fuzzy_matches"),
                ("only_left", "only_left"), ("only_right", "only_right"),
            ]
        ]
    )
