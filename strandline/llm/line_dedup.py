"""Near-duplicate lines by an exact set-similarity join on native columns.

The tokens of a line are its distinct five-word shingles (a shorter line is one token as a
whole); two lines match when the Jaccard similarity of their tokens is at least ``percent``. A line
goes if it matches an earlier line, in the order of (doc_id, text hash, place), whether or not that
one stays.

Lines of the same words form a class. A first prefix filter, in an order that is cheap to work out
(shingles whose first sign is in FRONT come before the others), leaves the classes that share SHARED
keys with others; only these are parted into words and sets. Their tokens are ordered by rarity: by
the count of their hash bucket over these sets, then by hash. They are joined on their prefixes with
length and positional filters and verified on the whole sets. Only lines that are still in question
after the comparison with the center of their keys enter the join of all pairs.

Lines without words are no lines: they stay and never match. NULL and empty texts have none. Rows
that repeat a doc_id with its text are one document and are treated alike; NULL as doc_id sorts
first. An empty table gives an empty result. A document that loses its last line goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import SPACE, col, free_names, release, stored
from strandline.llm.prefix_join import live_postings, prefix_size, run_pairs, star_pairs, verified
from strandline.llm.quality_hosts import trimmed_words, windows

SIZE = 5
PERCENT = 80
BUCKET_BITS = 15
#: Places of lines to be cut from the texts again are marked in so many bits.
MARK_BITS = 24
#: First signs of the shingles that come first in the order of the first filter: about two in five.
FRONT = "b-hk-nprsw"
#: Keys that two lines that match share at least, in prefixes longer than the plain one by one less.
SHARED = 3
PLACE = ["doc_id", "th", "pos"]
BLANKS = " \t\n\x0b\f\r"


def _pieces(docs: DataFrame) -> DataFrame:
    """(doc_id, th, pos, line) of all lines, from (doc_id, text)."""
    return docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def marked(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """The lines, with ``h``, whose hashed places fall on a bit that a wanted place sets.

    The bits are a table of at most 2 ** MARK_BITS / 64 rows, whatever the data, and may be broadcast. What it lets
    through by chance goes in the join behind it; with very many wanted lines it lets through all.
    """
    bit = F.shiftrightunsigned("h", 64 - MARK_BITS)
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.bitwiseAND(63).cast("int"))
    bits = wanted.select(F.shiftright(bit, 6).alias("word"), one.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    lines = lines.withColumn("h", F.xxhash64(*PLACE))
    near = lines.join(F.broadcast(bits), F.shiftright(bit, 6) == F.col("word"))
    return near.where(F.col("bits").bitwiseAND(one) != 0).drop("word", "bits")


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, th, pos, line) of the lines with words, from (doc_id, text); a single blank is before every word.

    Texts with other white space are mended as a whole, which leaves the places of their lines.
    """
    text = F.col("text")
    odd = text.contains("  ")
    for space in BLANKS.replace(" ", "").replace("\n", ""):
        odd = odd | text.contains(space)
    even = F.when(odd, F.regexp_replace(text, r"[\x20\t\x0B\f\r]+", " ")).otherwise(text)
    lines = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split(even, "\n")).alias("pos", "line"))
    return lines.select("doc_id", "th", "pos", F.concat(F.lit(" "), F.trim("line")).alias("line")).where("line <> ' '")


def _shingles(line: Column, first: str) -> Column:
    """The shingles of a line of _lines whose first sign is in a class, as texts."""
    word = "[^ ]+"
    return F.regexp_extract_all(line, F.lit(f" (?=({first}[^ ]*{(' ' + word) * (SIZE - 1)}))"), 1)


def _sketched(lines: DataFrame, percent: int) -> DataFrame:
    """(doc_id, th, pos, s1, s2, prefix): hashes of each line's words and a prefix of its hashed shingles.

    The size of a set is at most the number of its windows, so the prefix is no shorter than that of the set, and
    SHARED - 1 keys more where it has them. Shingles in
    FRONT are negative and thus first; the others are only looked up where those in front don't fill the prefix.
    A line of fewer words than a shingle matches none of other words and has no prefix.
    """
    words = F.octet_length("line") - F.octet_length(F.replace(F.col("line"), F.lit(" "), F.lit("")))
    size = prefix_size(F.greatest(words - (SIZE - 1), F.lit(0)), percent) + (SHARED - 1)
    front = F.array_distinct(F.transform(_shingles(F.col("line"), f"[{FRONT}]"), lambda s: F.xxhash64(s).bitwiseOR(F.lit(-(1 << 63)))))
    out = lines.select(*PLACE, "line", size.alias("size"), front.alias("front"))
    back = F.transform(_shingles(F.col("line"), f"[^{FRONT} ]"), lambda s: F.xxhash64(s).bitwiseAND(F.lit((1 << 63) - 1)))
    keys = F.when(F.size("front") >= F.col("size"), F.col("front")).otherwise(F.array_distinct(F.concat("front", back)))
    return out.select(
        *PLACE, F.xxhash64("line").alias("s1"), F.xxhash64(F.lit(1), "line").alias("s2"), F.slice(F.sort_array(keys), F.lit(1), F.col("size")).alias("prefix")
    )


def _sharing(sketched: DataFrame, percent: int) -> DataFrame:
    """(s1, s2) of the lines that share enough keys of their prefix with lines of other words.

    Two sets that match have at least ``percent`` of each in common; of these members the first SHARED,
    or all if they are fewer, lie in both prefixes. A set has no fewer members than its prefix.
    """
    keys = sketched.select("s1", F.explode("prefix").alias("key")).groupBy("key").agg(F.min("s1").alias("low"), F.max("s1").alias("high"))
    keys = stored(keys.where("low <> high").select("key"), "shared-keys")
    least = F.least(F.lit(SHARED), F.floor((F.size("prefix") * percent + 99) / 100).cast("int")).alias("least")
    held = sketched.select(F.xxhash64(*PLACE).alias("h"), "s1", "s2", least, F.explode("prefix").alias("key")).join(keys, "key", "left_semi")
    held = held.groupBy("h", "s1", "s2", "least").agg(F.count(F.lit(1)).alias("n")).where("n >= least")
    out = stored(held.select("s1", "s2").distinct(), "sharing-lines")
    release(keys)
    return out


def _levels(sets: DataFrame) -> Column:
    """10-bit step of the count of every bucket, as one array constant of ``2 ** BUCKET_BITS`` entries.

    The counts of the buckets are all that the driver gathers; their number is fixed.
    """
    bucket = F.shiftrightunsigned("h", 64 - BUCKET_BITS).alias("id")
    counts = sets.select(F.explode("tokens").alias("h")).select(bucket).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    level = F.least(F.floor(8 * F.log2(F.col("n") + 1.0)), F.lit(1023))
    known = {r["id"]: r["level"] for r in counts.select("id", level.alias("level")).collect()}
    return F.split(F.lit(",".join(str(known.get(k, 0)) for k in range(1 << BUCKET_BITS))), ",").cast("array<int>")


def _sets(lines: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns and ``tokens``, the distinct hashed shingles of each line."""
    out = lines.select(*keep, "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    tokens = F.when(F.size("hashes") >= SIZE, windows(F.col("hashes"), SIZE)).otherwise(F.array(F.xxhash64(F.array_join("words", " "))))
    return out.select(*keep, F.array_distinct(tokens).alias("tokens"))


def _signed(sets: DataFrame, levels: Column, percent: int) -> DataFrame:
    """(rep, n, parity, prefix): size of each set, its rarest tokens in order."""

    def key(h: Column) -> Column:
        level = F.coalesce(F.get(levels, F.shiftrightunsigned(h, 64 - BUCKET_BITS).cast("int")), F.lit(0))
        return F.shiftleft(level.cast("bigint"), 53).bitwiseOR(F.shiftrightunsigned(h, 11))

    out = sets.select("rep", F.sort_array(F.transform("tokens", key)).alias("keys"))
    size = F.size("keys")
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), k.bitwiseAND(63).cast("int"))
    return out.select(
        "rep", size.alias("n"),
        F.aggregate("keys", F.lit(0).cast("bigint"), lambda s, k: s.bitwiseXOR(bit(k))).alias("parity"),
        F.slice("keys", F.lit(1), prefix_size(size, percent)).alias("prefix"),
    )


def _cut(texts: DataFrame, places: DataFrame) -> DataFrame:
    """(rep, tokens) of the lines at the places (rep, first); only these are parted into words."""
    wanted = places.select("rep", *[F.col(f"first.{c}").alias(f"{c}_") for c in PLACE])
    wanted = stored(wanted.withColumn("h", F.xxhash64(*[f"{c}_" for c in PLACE])), "wanted-lines")
    lines = marked(_pieces(texts), wanted)
    here = F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (F.col("th") == F.col("th_")) & (F.col("pos") == F.col("pos_"))
    lines = lines.join(wanted, (lines["h"] == wanted["h"]) & here).select("rep", trimmed_words(F.col("line")).alias("words"))
    sets = stored(_sets(lines, ["rep"]).dropDuplicates(["rep"]), "line-sets")  # rows may repeat a document
    release(wanted)
    return sets


def first_lines(docs: DataFrame, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """(doc_id, th, pos) of the lines that stay; th is the xxhash64 of the whole text."""
    texts = docs.select(F.col("doc_id"), col(text).cast("string").alias("text"))
    sketched = stored(_sketched(_lines(texts), percent), "lines")
    alike = sketched.groupBy("s1", "s2").agg(F.min(F.struct(*PLACE)).alias("first"))
    classes = stored(alike.select(F.monotonically_increasing_id().alias("rep"), "first", "s1", "s2"), "line-classes")
    sharing = _sharing(sketched, percent)
    release(sketched)
    firsts = stored(classes.join(sharing, ["s1", "s2"]).select("rep", "first"), "sharing-classes")
    release(sharing)
    sets = _cut(texts, firsts)
    signed = stored(_signed(sets, _levels(sets), percent), "line-prefixes")
    live = live_postings(signed)
    release(signed)

    def checked(pairs: DataFrame) -> DataFrame:
        """The links among the pairs."""
        pairs = stored(pairs.select("a", "b", "na", "nb"), "line-pairs")
        links = stored(verified(pairs, sets, percent), "line-links")
        release(pairs)
        return links

    def later(links: DataFrame) -> DataFrame:
        for side in "ab":
            links = links.join(firsts.select(F.col("rep").alias(side), F.col("first").alias(f"first_{side}")), side)
        return links.select(F.when(F.col("first_a") < F.col("first_b"), F.col("b")).otherwise(F.col("a")).alias("rep")).distinct()

    star = checked(star_pairs(live, percent))
    gone = stored(later(star), "later-lines")
    release(star)
    ordered = live.join(firsts, "rep")
    open_ = ordered.join(gone, "rep", "left_anti")
    across = checked(run_pairs(ordered, open_, lambda x, y: x("first") < y("first"), percent))
    release(live, sets)
    every = stored(gone.unionAll(across.select(F.col("b").alias("rep"))).distinct(), "gone-lines")
    release(gone, across, firsts)
    out = stored(classes.join(every, "rep", "left_anti").select("first.*"), "first-lines")
    release(every, classes)
    return out


def _kept(docs: DataFrame, percent: int, text: str) -> DataFrame:
    """(doc_id, th, kept) with the places of the lines that stay, in order."""
    return first_lines(docs, percent, text).groupBy(F.col("doc_id").alias("kept_id"), F.col("th").alias("kept_th")).agg(F.sort_array(F.collect_list("pos")).alias("kept"))


def _worded(lines: Column) -> Column:
    return F.transform(lines, lambda x: x.rlike(SPACE.replace("[", "[^", 1)))


def line_report(docs: DataFrame, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """doc_id, n_lines (with words), n_removed and the places of the lines that stay, comma-joined."""
    slim = docs.select(
        "doc_id",
        F.xxhash64(col(text)).alias("th"),
        F.size(F.filter(_worded(F.split(F.coalesce(col(text), F.lit("")), "\n")), lambda x: x)).cast("bigint").alias("n_lines"),
    )
    kept = _kept(docs, percent, text)
    out = slim.join(kept, slim["doc_id"].eqNullSafe(kept["kept_id"]) & (slim["th"] == kept["kept_th"]), "left")
    places = F.coalesce("kept", F.array().cast("array<int>"))
    return out.select("doc_id", "n_lines", (F.col("n_lines") - F.size(places)).alias("n_removed"), F.array_join(places, ",").alias("kept_lines"))


def without_repeats(docs: DataFrame, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """The documents without lines that match an earlier one, in their columns."""
    th, all_lines, blank, ident, kept_th, places = free_names(docs, "_text_hash", "_lines", "_blank_lines", "_kept_id", "_kept_hash", "_kept")
    kept = _kept(docs, percent, text).withColumnsRenamed({"kept_id": ident, "kept_th": kept_th, "kept": places})
    lines = col(all_lines)
    out = docs.withColumns({th: F.xxhash64(col(text)), all_lines: F.split(F.coalesce(col(text), F.lit("")), "\n")})
    bare = F.filter(F.transform(_worded(lines), lambda x, i: F.when(~x, i)), lambda i: i.isNotNull())
    out = out.withColumn(blank, bare)
    out = out.join(kept, col("doc_id").eqNullSafe(col(ident)) & (col(th) == col(kept_th)), "left")
    gone = F.size(lines) - F.size(col(blank)) - F.coalesce(F.size(col(places)), F.lit(0))
    stay = F.sort_array(F.concat(col(blank), col(places)))
    rest = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    new = F.when(gone > 0, rest).otherwise(col(text))
    return out.where(col(places).isNotNull() | (gone == 0)).select([new.alias(c) if c == text else col(c) for c in docs.columns])
