"""Prefix-filtered set-similarity join on native columns, shared by the line and the document join.

A class is one distinct set: ``rep`` (its number), ``n`` (its size), ``prefix`` (its first
n - ceil(percent * n / 100) + 1 members in one global order) and ``parity``, 64 bits of which each is the
parity of the number of members that fall to it, or NULL. Sets that reach the Jaccard
similarity share a prefix member and pass every filter here; each surviving pair is verified once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import release, stored

FIELDS = ("rep", "n", "pos", "rank", "most", "last", "parity")
SHORT = dict(zip(FIELDS, ("", "n", "p", "r", "m", "w", "x")))


def prefix_size(n: Column, percent: int) -> Column:
    return n - F.floor((n * percent + 99) / 100).cast("int") + 1


def live_postings(classes: DataFrame) -> DataFrame:
    """(key, rep, n, pos, rank, most, last, parity, before) of the prefix members that two classes or more hold.

    ``rank`` counts such members up to this one within its class, ``before`` is the one in front of it or NULL. ``most`` bounds the overlap with any set whose prefix ends later in the order: what of the
    own prefix no other prefix holds can't be common. ``last`` is the prefix's last member.
    """
    postings = classes.select("rep", "n", F.posexplode("prefix").alias("pos", "key"))
    keys = postings.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("key")
    live = stored(postings.join(keys, "key"), "postings")
    held = live.groupBy("rep").agg(F.count(F.lit(1)).alias("shared"))
    bound = classes.join(held, "rep").select("rep", "parity", (F.col("n") - F.size("prefix") + F.col("shared")).alias("most"), F.element_at("prefix", -1).alias("last"))
    along = Window.partitionBy("rep").orderBy("pos", "key")
    out = stored(live.join(bound, "rep").withColumn("rank", F.row_number().over(along)).withColumn("before", F.lag("key").over(along)), "live")
    release(live)
    return out


def enough(overlap: Column, percent: int) -> Column:
    """Whether an overlap gives the similarity, for sizes na and nb."""
    return (100 + percent) * overlap >= percent * (F.col("na") + F.col("nb"))


def possible(side_a: dict[str, Column], side_b: dict[str, Column], percent: int) -> Column:
    """Length and positional filters on one shared key.

    Up to the shared key only members that other prefixes hold can be common, behind it no more
    than either side has left; the prefix that ends first bounds the overlap as a whole. Where the
    parities of two sets differ in a bit, at least one member is not common; so near copies of one
    set that differ in different places are told apart before they become a row.
    """
    na, nb, pa, pb = side_a["n"], side_b["n"], side_a["pos"], side_b["pos"]
    need = percent * (na + nb)
    most = F.when(side_a["last"] <= side_b["last"], side_a["most"]).otherwise(side_b["most"])
    along = F.least(side_a["rank"], side_b["rank"]) + F.least(na - pa, nb - pb) - 1
    apart = F.coalesce(F.bit_count(side_a["parity"].bitwiseXOR(side_b["parity"])), F.lit(0))
    sizes = (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * (na + nb - apart) >= 2 * need)
    return sizes & ((100 + percent) * most >= need) & ((100 + percent) * along >= need)


def sides(side_a: dict[str, Column], side_b: dict[str, Column]) -> list[Column]:
    return [c.alias(SHORT[f] + s) for s, cols in (("a", side_a), ("b", side_b)) for f, c in cols.items() if f not in ("most", "rank", "parity")]


def pairs_of(shared: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb, common) where the shared keys leave room for the similarity.

    The prefix that ends first shares only keys with the other prefix, so the overlap is at
    most these and what its set has behind its prefix; behind the last shared key it is no
    more than either side has left.
    """
    pairs = shared.groupBy("a", "b", "na", "nb", "wa", "wb").agg(F.count(F.lit(1)).alias("common"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    behind = F.when(F.col("wa") <= F.col("wb"), F.col("na") - prefix_size(F.col("na"), percent)).otherwise(F.col("nb") - prefix_size(F.col("nb"), percent))
    left = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) - 1
    return pairs.where(enough(F.col("common") + F.least(behind, left), percent)).select("a", "b", "na", "nb", "common")


def star_pairs(live: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb): each class b with the one center a it shares most keys with.

    The center of a key is its member with the smallest share of members of its own, so the
    original of many near copies is the center of nearly all their keys.
    """
    typical = F.struct(F.col("most") / F.col("n"), -F.col("rep"))
    centers = live.groupBy("key").agg(F.max_by(F.struct(*FIELDS), typical).alias("c"))
    side_a, side_b = {f: F.col("c")[f] for f in FIELDS}, {f: live[f] for f in FIELDS}
    shared = live.join(centers, "key").where((side_a["rep"] != side_b["rep"]) & possible(side_a, side_b, percent))
    pairs = pairs_of(shared.select(*sides(side_a, side_b)), percent)
    best = pairs.groupBy("b").agg(F.max_by(F.struct("a", "na", "nb"), F.struct("common", -F.col("a"))).alias("x"))
    return best.select("x.a", "b", "x.na", "x.nb")


def cross_pairs(left: DataFrame, right: DataFrame, apart, percent: int) -> DataFrame:
    """(a, b, na, nb) of all pairs that share a key and for which ``apart(left, right)`` holds."""
    left, right = left.alias("l"), right.alias("r")
    side_a, side_b = ({f: F.col(f"{s}.{f}") for f in FIELDS} for s in "lr")
    on = (F.col("l.key") == F.col("r.key")) & apart(lambda c: F.col(f"l.{c}"), lambda c: F.col(f"r.{c}")) & possible(side_a, side_b, percent)
    return pairs_of(left.join(right, on).select(*sides(side_a, side_b)), percent).select("a", "b", "na", "nb")


def run_pairs(left: DataFrame, right: DataFrame, apart, percent: int) -> DataFrame:
    """Those of cross_pairs, and some more, with one row for each run of shared keys instead of one for each key.

    Both frames hold the whole postings of their classes. Where the keys in front are equal too, the pair also meets
    there, and the filters let a pair that reaches the similarity pass at every key it shares; so its row at the
    first key of a run is enough. Keys are then not counted, and the bound of ``pairs_of`` is left out.
    """
    left, right = left.alias("l"), right.alias("r")
    side_a, side_b = ({f: F.col(f"{s}.{f}") for f in FIELDS} for s in "lr")
    start = F.coalesce(F.col("l.before") != F.col("r.before"), F.lit(True))
    on = (F.col("l.key") == F.col("r.key")) & start & apart(lambda c: F.col(f"l.{c}"), lambda c: F.col(f"r.{c}")) & possible(side_a, side_b, percent)
    met = left.join(right, on)
    return met.select(side_a["rep"].alias("a"), side_b["rep"].alias("b"), side_a["n"].alias("na"), side_b["n"].alias("nb")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) among the pairs.

    Where the sets come with sizes by band (``bands``), their differences bound the members not
    in common first (the suffix filter); then the overlap is counted on the whole sets.
    """
    if "bands" in sets.columns:
        for side in "ab":
            pairs = pairs.join(sets.select(F.col("rep").alias(side), F.col("bands").alias(f"bands_{side}")), side)
        apart = F.aggregate(F.zip_with("bands_a", "bands_b", lambda x, y: F.abs(x.cast("int") - y)), F.lit(0), lambda s, x: s + x)
        pairs = pairs.where(enough((F.col("na") + F.col("nb") - apart) / 2, percent)).select("a", "b", "na", "nb")
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("rep").alias(side), F.col("tokens").alias(f"tokens_{side}")), side)
    return pairs.where(enough(F.size(F.array_intersect("tokens_a", "tokens_b")), percent)).select("a", "b").distinct()


def members(pairs: DataFrame) -> DataFrame:
    """(rep) of every class in the pairs, once."""
    return pairs.select(F.col("a").alias("rep")).distinct().unionAll(pairs.select(F.col("b").alias("rep"))).distinct()
