"""URL filters: explicit rules, and link-graph propagation of trust and distrust for other pages.

A page whose url fits a rule has the longest one's verdict. Other pages have their host's: a
personalised PageRank flows from trusted hosts along links, another from blocked hosts against
them (who links to a blocked host is suspect), and a host whose distrust is above ``ratio`` times
its trust is blocked. Seeds are the hosts with more pages allowed than blocked by rules, and those
with more blocked, each weighted by the difference. Edges are the links between different hosts in
the pages' html, counted, and the ties of a host to its parent domains of two labels or more
(``tie`` links each way), since one operator runs them. Parent domains are nodes whether or not they
have pages, so hosts beside each other reach each other; ports don't count, addresses of numbers have
no parents, and registries such as co.uk are none. The walks go on until no verdict can change, or they change by less than ``TOLERANCE``.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: what
follows up to ``?``, ``#`` or the end. A NULL url, or one without ``://``, has both empty, fits no
rule and is allowed; NULL html has no links. Repeated pages count each time. Without seeds or
edges all scores are 0 and pages without a rule are allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import col, lower_ascii, release, stored

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"(?is)<a\s[^>]*?href\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s>]+)"
DAMPING = 0.85
#: Largest sum of changes in a round at which the walks end in any case; their totals are at most 1.
TOLERANCE = 1e-9
#: Rounds between two looks.
LOOK = 5
#: Scores are rounded to 12 digits before they are compared.
ROUNDED = 1e-11
#: Moves in one file of a round.
HOST_ROWS = 1_000_000
#: Moves from one host that stay together in a join.
WIDE = 10_000
#: Labels below a country's that many owners share.
REGISTRY = r"^(ac|co|com|edu|gob|gov|gv|ltd|mil|ne|net|nom|or|org|sch)\.[a-z]{2}$"
#: Rules of the registered query: (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, NULL for none; rules are a short list.

    Of equally long rules the first in the alphabet wins, and a block before an allow.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]], r[0] != "block")):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def ruled(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url") -> DataFrame:
    """page_id, host, path, rule and its verdict of every row."""
    parts = pages.select("page_id", host_of(col(url)).alias("host"), path_of(col(url)).alias("path"))
    return parts.withColumn("r", fitting_rule(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "r.rule", "r.verdict")


def host_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts, counted over all pages."""
    links = pages.select(host_of(col(url)).alias("src"), F.explode(F.regexp_extract_all(col(html), F.lit(LINK), 1)).alias("dst"))
    links = links.select("src", lower_ascii(F.col("dst")).alias("dst")).where("src <> '' AND src <> dst")
    return links.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("n"))


def domain_ties(hosts: DataFrame, tie: float = 1.0) -> DataFrame:
    """(src, dst, n): each host and its parent domains, with or without pages, both ways."""
    labels = F.split(F.regexp_replace("host", ":[0-9]*$", ""), r"\.")
    parents = F.transform(F.sequence(F.lit(2), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    up = hosts.where((F.size(labels) >= 3) & ~F.col("host").rlike("^[0-9.]+(:[0-9]*)?$"))
    up = up.select(F.col("host").alias("src"), F.explode(parents).alias("dst"), F.lit(tie).alias("n")).where(F.col("dst").rlike(r"^[^.]+\.") & ~F.col("dst").rlike(REGISTRY))
    return up.unionAll(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))


def propagated(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int | None = None, tolerance: float = TOLERANCE, wide: int = WIDE, ratio: float | None = None) -> DataFrame:
    """(host, trust, distrust) from edges (src, dst, n) and seeds (host, trust, distrust).

    Both walks take one join and one sum a round. Trust leaves a host along its links, distrust
    against them, each in proportion to n; what a host without way on holds is lost. The rest of
    a walk that isn't damped starts anew at its seeds, whose shares sum to 1. What is still to come
    shrinks by ``damping`` a round, so the walks end: once the scores change by less than ``tolerance``
    in all in a round, or after ``rounds`` rounds if given. With a ``ratio`` they also end when no verdict can
    change any more: no host is newly reached, and everywhere distrust and ``ratio`` times trust lie farther
    apart than all that is still to come. Hosts of more than ``wide`` moves are dealt into parts by where these lead.

    Every round is written to the shared folder and the one before the last deleted, so its plan is
    always of the same small shape; a state holds the one before it beside it.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("out"))
    into = edges.groupBy("dst").agg(F.sum("n").alias("into"))
    edges = edges.join(out, "src").join(into, "dst")
    moves = edges.select(F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("n") / F.col("out")).alias("t"), F.lit(0.0).alias("d"))
    back = edges.select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(0.0).alias("t"), (F.col("n") / F.col("into")).alias("d"))
    moves = stored(moves.unionAll(back).groupBy("host", "to").agg(F.sum("t").alias("t"), F.sum("d").alias("d")), "host-moves")
    parts = moves.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / F.lit(wide)).cast("int").alias("parts")).where("parts > 1")
    parts, on = stored(parts, "wide-hosts"), ["host"]
    if not parts.isEmpty():
        dealt = moves.join(parts, "host", "left").withColumn("part", F.pmod(F.xxhash64("to"), F.coalesce("parts", F.lit(1))).cast("int"))
        moves, on = stored(dealt.drop("parts"), "dealt-moves"), ["host", "part"]
    files = -(-moves.count() // HOST_ROWS) + 1
    moves = stored(moves.coalesce(files), "host-moves-packed")
    total = seeds.agg(F.struct(F.sum("trust").alias("t"), F.sum("distrust").alias("d"))).scalar()
    share = lambda c, k: F.coalesce(F.col(c) / F.nullif(total[k], F.lit(0.0)), F.lit(0.0)).alias(c)
    start = stored(seeds.select("host", share("trust", "t"), share("distrust", "d")).coalesce(files), "host-seeds")
    none = [F.lit(0.0).alias("old_trust"), F.lit(0.0).alias("old_distrust")]
    base = start.select("host", ((1 - damping) * F.col("trust")).alias("trust"), ((1 - damping) * F.col("distrust")).alias("distrust"), *none)
    state, old = start, None
    k = 0
    while rounds is None or k < rounds:
        k += 1
        here = state.select("host", "trust", "distrust")
        if len(on) > 1:
            here = here.join(parts, "host", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        moved = moves.join(here.hint("shuffle_hash"), on).select(
            F.col("to").alias("host"), (damping * F.col("trust") * F.col("t")).alias("trust"), (damping * F.col("distrust") * F.col("d")).alias("distrust"), *none
        )
        before = state.select("host", *[F.lit(0.0).alias(c) for c in ("trust", "distrust")], F.col("trust").alias("old_trust"), F.col("distrust").alias("old_distrust"))
        new = moved.unionAll(base).unionAll(before).groupBy("host").agg(*[F.sum(c).alias(c) for c in ("trust", "distrust", "old_trust", "old_distrust")])
        new = stored(new.coalesce(files), "host-state")
        if old is not None and old is not start:
            release(old)
        old, state = state, new
        if k % LOOK == 0 and _settled(state, damping, tolerance, ratio):
            break
    return state.select("host", "trust", "distrust")


def _settled(state: DataFrame, damping: float, tolerance: float, ratio: float | None) -> bool:
    """Whether the walks may end after the round that a state and the one before it show."""
    apart = F.abs(F.col("trust") - F.col("old_trust")) + F.abs(F.col("distrust") - F.col("old_distrust"))
    fresh = (F.col("old_trust") + F.col("old_distrust") == 0) & (F.col("trust") + F.col("distrust") > 0)
    gap = F.abs(F.col("distrust") - F.lit(1.0 if ratio is None else ratio) * F.col("trust"))
    change, new, least = state.agg(F.sum(apart), F.count(F.when(fresh, 1)), F.min(gap)).first()
    if (change or 0.0) < tolerance:
        return True
    rest = change * damping / (1 - damping)
    return ratio is not None and new == 0 and least > (1 + ratio) * rest + ROUNDED


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], ratio: float = 1.0, url: str = "url", html: str = "html", rounds: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust, of every row."""
    parts = stored(ruled(pages, rules, url), "ruled-pages")
    counts = parts.where("host <> ''").groupBy("host").agg(
        F.sum(F.when(F.col("verdict") == "allow", 1).when(F.col("verdict") == "block", -1).otherwise(0)).cast("double").alias("net")
    )
    counts = stored(counts, "hosts")
    seeds = counts.where("net <> 0").select("host", F.greatest("net", F.lit(0.0)).alias("trust"), F.greatest(-F.col("net"), F.lit(0.0)).alias("distrust"))
    edges = host_links(pages, url, html).unionAll(domain_ties(counts)).groupBy("src", "dst").agg(F.sum("n").alias("n"))
    scores = propagated(stored(edges, "host-edges"), seeds, rounds=rounds, ratio=ratio)
    scores = stored(scores.select("host", F.round("trust", 12).alias("trust"), F.round("distrust", 12).alias("distrust")), "host-scores")
    scored = parts.join(scores, "host", "left")
    trust, distrust = (F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust"))
    of_host = F.when(distrust > ratio * trust, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("verdict", of_host).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
