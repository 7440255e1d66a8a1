"""Typed property graphs as node and edge tables: metrics, ego networks, similarity.

Nodes have (node_id, node_type, name, properties), edges (source_node_id,
target_node_id, edge_type, ...). Parallel edges stay separate rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import text
from strandline.operators.ordered import global_row_ids, top_k
from strandline.session import cut_lineage, discard, wide_enough, written

SRC, DST = "source_node_id", "target_node_id"


def node_set(df: DataFrame, node_type: str, key: Column, name: Column, **props: Column) -> DataFrame:
    """Nodes of one type with id ``{type}_{key}`` and JSON properties."""
    return df.select(
        F.concat(F.lit(node_type + "_"), key.cast("string")).alias("node_id"),
        F.lit(node_type).alias("node_type"),
        name.cast("string").alias("name"),
        text.json_props(**props).alias("properties") if props else F.lit("{}").alias("properties"),
    )


def edge_set(
    df: DataFrame, edge_type: str, source_type: str, source: Column, target_type: str, target: Column,
    prefix: str | None = None, strength: float = 1.0,
) -> DataFrame:
    """Edges of one type; with a prefix every edge gets a numbered id along (source, target)."""
    rows = df.select(
        F.concat(F.lit(source_type + "_"), source.cast("string")).alias(SRC),
        F.concat(F.lit(target_type + "_"), target.cast("string")).alias(DST),
        F.lit(edge_type).alias("edge_type"),
        text.json_props(relationship_strength=F.lit(strength)).alias("properties"),
    )
    if prefix is None:
        return rows
    return global_row_ids(rows, [SRC, DST], "_id").withColumn(
        "edge_id", F.concat(F.lit(prefix), F.col("_id").cast("string"))
    ).drop("_id")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def graph_from_tables(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Checked node and edge frames; endpoints without a node row are added as bare nodes."""
    if nodes.isEmpty() or edges.isEmpty():
        raise ValueError("a graph needs at least one node and one edge")
    known = nodes.withColumn("properties", text.parse_json_props("properties"))
    return known.unionByName(dangling_endpoints(nodes, edges), allowMissingColumns=True), edges


def endpoints(edges: DataFrame) -> DataFrame:
    """One row per edge end."""
    return edges.select(F.explode(F.array(SRC, DST)).alias("node_id"))


def dangling_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edge ends that have no node row."""
    return endpoints(edges).distinct().join(nodes.select("node_id"), "node_id", "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    """In- plus out-degree, parallel edges counted."""
    return endpoints(edges).groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))


def edge_type_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_type").agg(F.count(F.lit(1)).alias("edges"))


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Component label (smallest node id) of every node.

    Each round contracts every node with its smallest neighbour (Boruvka's step): all nodes of a tree of such
    picks become its root, and only distinct edges between different roots go on. Every node with an edge
    picks one, so the nodes halve at least from round to round, also along paths; as their numbers are
    hashes, dense graphs shrink by about their degree.
    """
    number, current = _stars(nodes, edges)
    marked = number.join(current, F.col("i") == F.col("a"), "left").select("node_id", F.coalesce("b", "i").alias("c"))
    roots = marked.groupBy("c").agg(F.min("node_id").alias("component"))
    return marked.join(roots, "c").select("node_id", "component")


def _stars(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered nodes (node_id, i), and (a, b): each node that isn't the root of its component with that one."""
    every = nodes.select("node_id").unionByName(endpoints(edges)).distinct()
    number, hashed = _numbered(every)
    ends = edges.filter(F.col(SRC) != F.col(DST)).select(hashed(SRC).alias("a"), hashed(DST).alias("b"))
    current = written(ends, "component-edges")
    stars = None
    while not current.isEmpty():
        picks = _roots(current)
        low, high = picks.select(F.col("v").alias("a"), F.col("up").alias("x")), picks.select(F.col("v").alias("b"), F.col("up").alias("y"))
        rest = current.join(low, "a").join(high, "b").filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
        rest = written(rest.distinct(), "component-edges")
        discard(current)
        current = rest
        if stars is None:
            stars = picks
            continue
        lifted = stars.join(picks.select(F.col("v").alias("up"), F.col("up").alias("root")), "up", "left")
        lifted = written(lifted.select("v", F.coalesce("root", "up").alias("up")), "component-stars")
        discard(stars, picks)
        stars = lifted
    if stars is None:
        return number, current
    return number, stars.filter("v <> up").select(F.col("v").alias("a"), F.col("up").alias("b"))


def _numbered(every: DataFrame):
    """(node_id, i) of the distinct nodes, and the column of that number from a column of ids.

    The number is a 64-bit hash, so edges get theirs without a join. Should two ids share one, all are
    hashed again with another salt.
    """
    salt = 0
    every = written(every, "component-ids")
    while True:
        hashed = lambda c, salt=salt: F.xxhash64(F.lit(salt), F.col(c))
        number = every.select("node_id", hashed("node_id").alias("i"))
        if number.groupBy("i").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
            return number, hashed
        salt += 1


def _roots(edges: DataFrame) -> DataFrame:
    """(v, up) of every node of the edges (a, b): the root of its tree when each node picks its smallest neighbour.

    Two steps of picks never lead to a larger node, so the only cycles are two nodes that pick each
    other; the smaller is the root. Then every step doubles the way up.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    picks = written(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("up")), "component-picks")
    first = True
    while True:
        further = picks.join(picks.select(F.col("v").alias("up"), F.col("up").alias("next")), "up")
        if first:
            root = (F.col("next") == F.col("v")) & (F.col("v") < F.col("up"))
            step = further.select("v", F.when(root, F.col("v")).otherwise(F.col("up")).alias("up"), F.lit(True).alias("moved"))
        else:
            step = further.select("v", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved"))
        step = written(step, "component-picks")
        discard(picks)
        picks = step.select("v", "up")
        picks.written_at = step.written_at
        if not first and step.filter("moved").isEmpty():
            return picks
        first = False


def graph_metrics(nodes: DataFrame, edges: DataFrame, components: bool = True) -> DataFrame:
    """Nodes, edges, average degree, density and number of weak components as one row."""
    every = nodes.select("node_id").unionByName(endpoints(edges)).distinct()
    parts = [
        every.agg(F.count(F.lit(1)).alias("v")).select(F.lit("node_count").alias("k"), "v"),
        edges.agg(F.count(F.lit(1)).alias("v")).select(F.lit("edge_count").alias("k"), "v"),
    ]
    if components:
        # All nodes but the root of their component point to another.
        number, stars = _stars(nodes, edges)
        v = number.join(stars.select(F.col("a").alias("i")).distinct(), "i", "left_anti").agg(F.count(F.lit(1)).alias("v"))
        parts.append(v.select(F.lit("connected_components").alias("k"), "v"))
    names = ["node_count", "edge_count"] + (["connected_components"] if components else [])
    one = union_all(parts).agg(*[F.max(F.when(F.col("k") == n, F.col("v"))).alias(n) for n in names])
    n, e = F.col("node_count").cast("double"), F.col("edge_count").cast("double")
    return one.withColumn("avg_degree", F.coalesce(F.try_divide(e * 2, n), F.lit(0.0))).withColumn("density", density(n, e))


def density(nodes: Column, edges: Column) -> Column:
    """Edges over possible directed edges; 0 for fewer than two nodes."""
    return F.when(nodes > 1, F.try_divide(edges, nodes * (nodes - 1))).otherwise(F.lit(0.0))


def degree_centrality(nodes: DataFrame, edges: DataFrame, top: int | None = None) -> DataFrame:
    """Degree over (number of nodes - 1), largest first."""
    every = nodes.select("node_id").unionByName(endpoints(edges)).distinct()
    total = every.agg(F.count(F.lit(1)).alias("n")).scalar()
    scored = (
        every.join(degrees(edges), "node_id", "left")
        .withColumn("degree", F.coalesce("degree", F.lit(0)))
        .withColumn("_n", total)
        .withColumn(
            "centrality",
            F.when(F.col("_n") <= 1, F.lit(1.0)).otherwise(
                F.try_divide(F.col("degree").cast("double"), (F.col("_n") - 1).cast("double"))
            ),
        )
        .drop("_n")
    )
    if top is None:
        return scored
    return scored.orderBy(F.col("centrality").desc(), "node_id").limit(top)


def connectivity_check(nodes: DataFrame, edges: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Per (type, partner type): nodes, nodes linked to the partner type, nodes with any edge."""
    kinds = nodes.select("node_id", "node_type")
    ends = edges.select(
        F.explode(
            F.array(F.struct(F.col(SRC).alias("n"), F.col(DST).alias("o")), F.struct(F.col(DST).alias("n"), F.col(SRC).alias("o")))
        ).alias("e")
    ).select("e.n", "e.o")
    # Flags of the neighbours' types are maxima, so edges needn't be made distinct, and all counts come from one pass.
    typed = ends.join(kinds.withColumnsRenamed({"node_id": "o", "node_type": "other"}), "o", "left")
    seen = typed.groupBy("n").agg(*[F.max((F.col("other") == p).cast("int")).alias(f"p{i}") for i, (_, p) in enumerate(pairs)])
    joined = kinds.join(seen, F.col("node_id") == F.col("n"), "left")
    counts = []
    for i, (kind, _) in enumerate(pairs):
        mine = F.col("node_type") == kind
        counts += [
            F.count(F.when(mine, 1)).alias(f"total{i}"),
            F.count(F.when(mine & (F.col(f"p{i}") == 1), 1)).alias(f"linked{i}"),
            F.count(F.when(mine & F.col("n").isNotNull(), 1)).alias(f"validated{i}"),
        ]
    rows = [
        F.struct(
            F.lit(kind).alias("node_type"), F.lit(partner).alias("partner_type"), F.col(f"total{i}").alias("total"),
            F.col(f"linked{i}").alias("linked_to_partner"), F.col(f"validated{i}").alias("validated"),
        )
        for i, (kind, partner) in enumerate(pairs)
    ]
    return joined.agg(*counts).select(F.inline(F.array(*rows))).withColumn("is_valid", F.col("total") == F.col("validated"))


def ego_edges(
    edges: DataFrame,
    into_center: list[str],
    member_edge: str,
    attribute_edge: str,
) -> DataFrame:
    """Induced edges of the ego network of every centre at once.

    An ego network holds the centre, everything with an edge of ``into_center`` into
    it, and the attributes (``attribute_edge``) of its members (``member_edge``). Its
    edges are exactly the edges into the centre and the attribute edges of its
    members, so two keyed passes give all networks without testing node pairs.
    """
    inner = edges.filter(F.col("edge_type").isin(into_center)).select(F.col(DST).alias("ego"), SRC, DST, "edge_type")
    members = edges.filter(F.col("edge_type") == member_edge).select(F.col(DST).alias("ego"), F.col(SRC).alias("_m")).distinct()
    attributes = edges.filter(F.col("edge_type") == attribute_edge)
    outer = members.join(attributes, F.col("_m") == F.col(SRC)).select("ego", SRC, DST, "edge_type")
    return inner.unionByName(outer)


#: Bytes of the tables read for each task that groups by network or by target.
TASK_BYTES = 8 << 20


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by key over as many tasks as the tables read ask for; groups within the keys need no further shuffle."""
    return df.repartition(wide_enough(df, TASK_BYTES), *keys)


def ego_nodes(ego: DataFrame) -> DataFrame:
    """Each network is dealt to one task, once an edge, before its edges become nodes."""
    return by_key(ego.select("ego", SRC, DST), "ego").select("ego", F.explode(F.array("ego", SRC, DST)).alias("node_id")).distinct()


def ego_degrees(ego: DataFrame) -> DataFrame:
    """Degree centrality inside every ego network."""
    ends = by_key(ego.select("ego", SRC, DST), "ego").select("ego", F.explode(F.array(SRC, DST)).alias("node_id"))
    counts = ends.groupBy("ego", "node_id").agg(F.count(F.lit(1)).alias("degree"))
    sizes = counts.groupBy("ego").agg(F.count(F.lit(1)).alias("ego_size"))
    return counts.join(sizes, "ego").withColumn(
        "degree_centrality", F.try_divide(F.col("degree").cast("double"), (F.col("ego_size") - 1).cast("double"))
    )


def path_levels(ego: DataFrame) -> list[DataFrame]:
    """Directed shortest paths inside every ego network, one frame per distance.

    Rows are (ego, s, v, sigma): sigma shortest paths lead from s to v. The frontier
    is joined to the distinct edges by (ego, node) and each level is written, so
    the state is the reachable pairs; in ego networks, whose edges lead into the
    centre or to attributes, that is about the number of edges.
    """
    steps = by_key(ego.select("ego", F.col(SRC).alias("u"), F.col(DST).alias("w")).filter("u <> w"), "ego").distinct()
    steps = written(steps, "ego-steps")
    level = steps.select("ego", F.col("u").alias("s"), F.col("w").alias("v"), F.lit(1.0).alias("sigma"))
    levels = [level]
    seen = level.select("ego", "s", "v")
    while True:
        onward = (
            levels[-1].withColumnRenamed("v", "u").join(steps, ["ego", "u"]).filter(F.col("w") != F.col("s"))
            .groupBy("ego", "s", F.col("w").alias("v")).agg(F.sum("sigma").alias("sigma"))
        )
        fresh = written(onward.join(seen, ["ego", "s", "v"], "left_anti"), "ego-level")
        if fresh.isEmpty():
            return levels
        levels.append(fresh)
        seen = seen.unionByName(fresh.select("ego", "s", "v"))


def ego_centrality(ego: DataFrame) -> DataFrame:
    """Degree, closeness and betweenness centrality of every node in every ego network.

    Closeness is over incoming paths, scaled by the reachable share; betweenness is
    Brandes' (2001) accumulation over the path levels, normalised for directed graphs.
    All networks advance together, keyed by (ego, source, node).

    Networks in which no node has both an edge in and one out have paths of one edge only, so degrees and
    distinct neighbours say all; only the others are dealt again and walked.
    """
    base = written(_ego_counts(ego), "ego-counts")
    flat = base.select("ego", "node_id", "degree", "ego_size", "r", F.col("r").alias("x"), F.lit(0.0).alias("b"), "deep")
    deep = base.where("deep").select("ego").distinct()
    if deep.isEmpty():
        return _centralities(flat)
    ego = written(by_key(ego.select("ego", SRC, DST).join(deep, "ego", "left_semi"), "ego").sortWithinPartitions("ego"), "ego-edges")
    levels = path_levels(ego)
    incoming = union_all(
        [lv.groupBy("ego", F.col("v").alias("node_id")).agg(F.count(F.lit(1)).alias("r"), F.count(F.lit(1)).alias("x"))
         .withColumn("x", F.col("x") * (d + 1)) for d, lv in enumerate(levels)]
    ).groupBy("ego", "node_id").agg(F.sum("r").alias("r"), F.sum("x").alias("x"))
    through: DataFrame | None = None
    if len(levels) > 1:
        steps = ego.select("ego", F.col(SRC).alias("v"), F.col(DST).alias("w")).distinct()
        delta: DataFrame | None = None
        shares = []
        for d in range(len(levels) - 1, 0, -1):
            deeper = levels[d].select("ego", "s", F.col("v").alias("w"), F.col("sigma").alias("sw"))
            if delta is not None:
                deeper = deeper.join(delta.withColumnRenamed("v", "w"), ["ego", "s", "w"], "left")
            else:
                deeper = deeper.withColumn("delta", F.lit(0.0))
            flow = (
                deeper.join(steps, ["ego", "w"])
                .join(levels[d - 1], ["ego", "s", "v"])
                .groupBy("ego", "s", "v")
                .agg(F.sum(F.col("sigma") / F.col("sw") * (1 + F.coalesce(F.col("delta"), F.lit(0.0)))).alias("delta"))
            )
            delta = written(flow, "ego-shares")
            shares.append(delta)
        through = union_all(shares).groupBy("ego", F.col("v").alias("node_id")).agg(F.sum("delta").alias("b"))
    walked = base.where("deep").select("ego", "node_id", "degree", "ego_size").join(incoming, ["ego", "node_id"], "left")
    walked = walked.join(through, ["ego", "node_id"], "left") if through is not None else walked.withColumn("b", F.lit(0.0))
    return _centralities(flat.where("NOT deep").drop("deep").unionByName(walked))


def _ego_counts(ego: DataFrame) -> DataFrame:
    """(ego, node_id, degree, r, ego_size, deep): r distinct other nodes lead to the node; deep networks have paths of two edges.

    Networks are dealt by key once; all groups lie within that.
    """
    dealt = by_key(ego.select("ego", SRC, DST).where("ego IS NOT NULL"), "ego")
    links = dealt.groupBy("ego", SRC, DST).agg(F.count(F.lit(1)).alias("n"))
    onward = F.when(F.col(SRC) != F.col(DST), 1).otherwise(0)
    end = lambda node, goes, comes: F.struct(F.col(node).alias("node_id"), F.col("n"), goes.alias("goes"), comes.alias("comes"))
    ends = links.select("ego", F.inline(F.array(end(SRC, onward, F.lit(0)), end(DST, F.lit(0), onward))))
    counts = ends.groupBy("ego", "node_id").agg(F.sum("n").alias("degree"), F.sum("comes").alias("r"), F.max("goes").alias("goes"))
    whole = Window.partitionBy("ego")
    sized = counts.withColumns({"ego_size": F.count(F.lit(1)).over(whole), "deep": F.max((F.col("r") > 0) & (F.col("goes") > 0)).over(whole)})
    return sized.drop("goes")


def _centralities(counts: DataFrame) -> DataFrame:
    """Centralities from degree, size of the network, r nodes that lead to a node over distances of x in all, and b paths through it."""
    n, r = F.col("ego_size").cast("double"), F.col("r").cast("double")
    return counts.select(
        "ego",
        "node_id",
        F.try_divide(F.col("degree").cast("double"), n - 1).alias("degree_centrality"),
        F.coalesce(F.try_divide(r, F.col("x").cast("double")) * F.try_divide(r, n - 1), F.lit(0.0)).alias("closeness"),
        F.when(n > 2, F.try_divide(F.coalesce(F.col("b"), F.lit(0.0)), (n - 1) * (n - 2)))
        .otherwise(F.coalesce(F.col("b"), F.lit(0.0)))
        .alias("betweenness"),
    )


def ego_ranking(ego: DataFrame, nodes: DataFrame, node_type: str, metric: str, n: int = 10) -> DataFrame:
    """The n most central nodes of one type in every ego network."""
    if metric == "degree":
        scored, column = ego_degrees(ego), "degree_centrality"
    elif metric in ("closeness", "betweenness"):
        scored, column = ego_centrality(ego), metric
    else:
        raise ValueError(f"unknown metric: {metric}")
    wanted = scored.join(nodes.filter(F.col("node_type") == node_type).select("node_id"), "node_id", "left_semi")
    return top_k(wanted.select("ego", "node_id", F.col(column).alias("score")), ["ego"], [F.col("score").desc(), F.col("node_id").asc()], n)


def node_metadata(nodes: DataFrame, edges: DataFrame, node_type: str, edge_type: str) -> DataFrame:
    """Distinct targets by one edge type and total degree of every node of a type."""
    targets = (
        edges.filter(F.col("edge_type") == edge_type).select(SRC, DST).distinct()
        .groupBy(F.col(SRC).alias("node_id")).agg(F.count(F.lit(1)).alias("film_count"))
    )
    mine = nodes.filter(F.col("node_type") == node_type).select("node_id")
    return (
        mine.join(targets, "node_id", "left").join(degrees(edges), "node_id", "left")
        .select("node_id", F.coalesce("film_count", F.lit(0)).alias("film_count"), F.coalesce("degree", F.lit(0)).alias("degree"))
    )


def shared_attributes(
    edges: DataFrame, single_edge: str, place_edge: str, member_edge: str, attribute_edge: str
) -> DataFrame:
    """Distinct (entity, kind, attribute): director, location and the members' species."""
    direct = edges.filter(F.col("edge_type").isin(single_edge, place_edge)).select(
        F.col(DST).alias("entity"),
        F.when(F.col("edge_type") == single_edge, "director").otherwise("location").alias("kind"),
        F.col(SRC).alias("attribute"),
    )
    # Repeated members end in the last distinct.
    members = edges.filter(F.col("edge_type") == member_edge).select(F.col(DST).alias("entity"), F.col(SRC).alias("_m"))
    kinds = edges.filter(F.col("edge_type") == attribute_edge).select(F.col(SRC).alias("_m"), F.col(DST).alias("attribute")).distinct()
    two_hop = members.join(kinds, "_m").select("entity", F.lit("species").alias("kind"), "attribute")
    return by_key(direct.unionByName(two_hop), "entity").distinct()


def attribute_similarity(pairs: DataFrame, attributes: DataFrame, a: str = "entity_a", b: str = "entity_b") -> DataFrame:
    """Score of given pairs: 5 for a shared director, 1 per shared location and species.

    Only the given pairs are looked up; nothing is enumerated within a group. An entity's attributes travel as
    one row, so a pair is dealt out with two rows however many attributes it has.
    """
    def of(kind: str) -> Column:
        return F.collect_set(F.when(F.col("kind") == kind, F.col("attribute"))).alias(kind)

    kinds = ["director", "location", "species"]
    named = F.concat(F.length("kind").cast("string"), F.lit(":"), "kind", "attribute")
    rest = F.collect_set(F.when(~F.col("kind").isin(*kinds), named)).alias("rest")
    known = attributes.where("entity IS NOT NULL AND kind IS NOT NULL AND attribute IS NOT NULL")
    lists = known.groupBy("entity").agg(*[of(k) for k in kinds], rest).select("entity", F.struct(*kinds, "rest").alias("_held"))
    # Both sides of a pair meet the lists in one join; what both have is shared.
    given = pairs.select(a, b).distinct().where(F.col(a).isNotNull() & F.col(b).isNotNull())
    sides = F.explode(F.array(F.struct(F.col(a).alias("entity"), F.lit(1).alias("_side")), F.struct(F.col(b).alias("entity"), F.lit(2).alias("_side"))))
    asked = given.select(a, b, sides.alias("_s")).select(a, b, "_s.entity", "_s._side")
    side = lambda n: F.first(F.when(F.col("_side") == n, F.col("_held")), ignorenulls=True).alias(f"_{n}")
    met = asked.join(lists, "entity").groupBy(a, b).agg(side(1), side(2)).where("_1 IS NOT NULL AND _2 IS NOT NULL")
    shared = met.select(a, b, *[F.array_sort(F.array_intersect(f"_1.{k}", f"_2.{k}")).alias(k) for k in [*kinds, "rest"]])
    hits = shared.where(" + ".join(f"size({k})" for k in [*kinds, "rest"]) + " > 0")
    director = F.size("director") > 0
    return hits.select(
        a,
        b,
        (F.when(director, 5).otherwise(0) + F.size("location") + F.size("species")).cast("bigint").alias("score"),
        director.alias("shared_director"),
        F.col("location").alias("shared_locations"),
        F.col("species").alias("shared_species"),
    )


def similarity_network(attributes: DataFrame, min_score: int = 1) -> DataFrame:
    """All pairs whose score reaches a minimum.

    Attributes are ordered from rare to common. Two entities that reach the minimum
    must share an attribute among those left after dropping the common tail whose
    total weight stays below it (prefix filtering), so only these are joined and an
    attribute shared by very many entities is skipped whenever it cannot decide. The
    candidates are then scored exactly.
    """
    weight = F.when(F.col("kind") == "director", 5).otherwise(1)
    frequency = attributes.groupBy("kind", "attribute").agg(F.count(F.lit(1)).alias("_f"))
    ranked = attributes.join(frequency, ["kind", "attribute"]).filter(F.col("_f") > 1).withColumn("_w", weight)
    common_first = [F.col("_f").desc(), F.col("kind").asc(), F.col("attribute").asc()]
    # Weights are at least 1, so the dropped tail is among the min_score commonest.
    head = top_k(ranked, ["entity"], common_first, min_score, "_r")
    tail = Window.partitionBy("entity").orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)
    dropped = head.withColumn("_tail", F.sum("_w").over(tail)).filter(F.col("_tail") < min_score)
    prefix = ranked.join(dropped.select("entity", "kind", "attribute"), ["entity", "kind", "attribute"], "left_anti")
    left = prefix.select(F.col("entity").alias("entity_a"), "kind", "attribute")
    right = prefix.select(F.col("entity").alias("entity_b"), "kind", "attribute")
    candidates = left.join(right, ["kind", "attribute"]).filter("entity_a < entity_b").select("entity_a", "entity_b").distinct()
    return attribute_similarity(candidates, attributes).filter(F.col("score") >= min_score)


def co_members(seeds: DataFrame, edges: DataFrame, edge_type: str) -> DataFrame:
    """Members that share a target with the given seeds, with the number of shared targets."""
    links = edges.filter(F.col("edge_type") == edge_type).select(F.col(SRC).alias("member"), F.col(DST).alias("target")).distinct()
    return _shared_targets(seeds, links)


def _shared_targets(seeds: DataFrame, links: DataFrame) -> DataFrame:
    own = seeds.select(F.col("node_id").alias("seed")).distinct().join(links, F.col("seed") == F.col("member")).select("seed", "target")
    pairs = own.join(links, "target").filter(F.col("member") != F.col("seed")).select("seed", "member")
    return by_key(pairs, "seed", "member").groupBy("seed", "member").agg(F.count(F.lit(1)).alias("shared"))


def co_members_topk(edges: DataFrame, edge_type: str, k: int = 10, seeds: DataFrame | None = None, block_members: int = 20_000) -> DataFrame:
    """seed, member, shared, rank: the k members that share most targets with every seed (every member without seeds).

    The product of the incidence table with itself, block by block: members are dealt into blocks by hash,
    and a tile multiplies two blocks and passes on k rows a member, so no list of pairs is
    shuffled. A target of many members is spread over all tiles, each of which meets two
    blocks' share of it. Targets of one member are left out first. Ties go by the member's id.
    Where the pairs, counted exactly, are no more than the rows that the blocks would be copied to, they
    are joined and counted instead.
    """
    links = edges.filter(F.col("edge_type") == edge_type).select(F.col(SRC).alias("member"), F.col(DST).alias("target"))
    links = links.where(F.col("member").isNotNull() & F.col("target").isNotNull()).distinct()
    shared = links.groupBy("target").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    links = written(links.join(shared, "target"), "shared-links")
    pairs, rows = links.agg(F.sum(F.col("_n") - 1), F.count(F.lit(1))).first()
    links = links.drop("_n")
    blocks = max(1, -(-links.select("member").distinct().count() // block_members))
    if (pairs or 0) <= rows * blocks:
        everyone = links.select(F.col("member").alias("node_id")) if seeds is None else seeds
        return top_k(_shared_targets(everyone, links), ["seed"], [F.col("shared").desc(), F.col("member").asc()], k)
    dealt = links.withColumn("block", F.pmod(F.xxhash64("member"), F.lit(blocks)).cast("int"))
    if seeds is None:
        dealt = dealt.withColumn("asked", F.lit(True))
    else:
        wanted = seeds.select(F.col("node_id").alias("member")).distinct().withColumn("asked", F.lit(True))
        dealt = dealt.join(wanted, "member", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    row = ["member", "target", "asked"]
    left = dealt.select(*row, F.col("block").alias("bi"), F.explode(F.sequence("block", F.lit(blocks - 1))).alias("bj"))
    right = dealt.select(*[F.col(c).alias(c) for c in row], F.explode(F.sequence(F.lit(0), F.col("block"))).alias("ci"), F.col("block").alias("cj"))

    def tile(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        here = [_best_partners(a, b, k)]
        if key[0] != key[1]:
            here.append(_best_partners(b, a, k))
        return pd.concat(here, ignore_index=True)

    kinds = dict(links.dtypes)
    schema = f"seed {kinds['member']}, member {kinds['member']}, shared bigint"
    found = left.groupBy("bi", "bj").cogroup(right.groupBy("ci", "cj")).applyInPandas(tile, schema)
    return top_k(found, ["seed"], [F.col("shared").desc(), F.col("member").asc()], k)


#: Pairs that a tile holds at once.
TILE_PAIRS = 4_000_000


def _best_partners(a: pd.DataFrame, b: pd.DataFrame, k: int) -> pd.DataFrame:
    """(seed, member, shared): for each asked member of one block the k others of another that share most targets."""
    a = a[a["asked"]]
    none = pd.DataFrame({"seed": a["member"].iloc[:0], "member": a["member"].iloc[:0], "shared": np.empty(0, np.int64)})
    if a.empty or b.empty:
        return none
    targets, _ = pd.factorize(pd.concat([a["target"], b["target"]], ignore_index=True))
    seeds, seed_ids = pd.factorize(a["member"], sort=True)
    others, other_ids = pd.factorize(b["member"], sort=True)
    order = np.argsort(targets[len(a):], kind="stable")
    held, others = targets[len(a):][order], others[order]
    rows = np.argsort(seeds, kind="stable")
    seeds, wanted = seeds[rows], targets[: len(a)][rows]
    low, high = np.searchsorted(held, wanted, "left"), np.searchsorted(held, wanted, "right")
    sizes = high - low
    own = pd.Index(other_ids).get_indexer(seed_ids)
    borders = np.append(np.flatnonzero(np.append(True, seeds[1:] != seeds[:-1])), seeds.size)
    pairs = np.append(0, np.cumsum(sizes))
    out, first = [], 0
    while first < borders.size - 1:
        last = max(first + 1, int(np.searchsorted(pairs[borders], pairs[borders[first]] + TILE_PAIRS, "right")) - 1)
        cut = slice(borders[first], borders[last])
        if last == first + 1:
            total = np.zeros(other_ids.size, np.int64)
            for lo, hi in zip(low[cut].tolist(), high[cut].tolist()):
                total[others[lo:hi]] += 1
            partner = np.flatnonzero(total)
            seed, count = np.full(partner.size, seeds[borders[first]]), total[partner]
        else:
            at = np.repeat(low[cut] - (pairs[cut] - pairs[borders[first]]), sizes[cut]) + np.arange(pairs[borders[last]] - pairs[borders[first]])
            cells, count = np.unique(np.repeat(seeds[cut], sizes[cut]) * other_ids.size + others[at], return_counts=True)
            seed, partner = cells // other_ids.size, cells % other_ids.size
        other = partner != own[seed]
        seed, partner, count = seed[other], partner[other], count[other]
        best = np.lexsort((partner, -count, seed))
        seed, partner, count = seed[best], partner[best], count[best]
        keep = np.arange(seed.size) - np.searchsorted(seed, seed, "left") < k
        out.append(pd.DataFrame({"seed": np.asarray(seed_ids)[seed[keep]], "member": np.asarray(other_ids)[partner[keep]], "shared": count[keep]}))
        first = last
    return pd.concat(out, ignore_index=True) if out else none
