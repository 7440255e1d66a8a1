"""Readers for entity JSON, CSV of unknown encoding, timed text and nested documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions import text

# Supported languages and the timed-text patterns.
LANGUAGES = ["en", "fr", "es", "nl", "ar"]
NUMBER_LINE = r"^\d+$"
TIMING_LINE = r"^\d{2}:\d{2}:\d{2},\d{3} --> \d{2}:\d{2}:\d{2},\d{3}$"
TIME_OF_DAY = r"(\d{2}):(\d{2}):(\d{2}),(\d{3})"
TIMING_LOOSE = r"(\d+):(\d+):(\d+)[,.](\d+)\s*-->\s*(\d+):(\d+):(\d+)[,.](\d+)"

_TEXT = T.StringType()
_LIST = T.ArrayType(T.StringType())


def _struct(texts: list[str], lists: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, _TEXT) for n in texts] + [T.StructField(n, _LIST) for n in lists])


# Fields of the entity tables.
ENTITY_SCHEMAS = {
    "films": _struct(
        ["id", "title", "original_title", "original_title_romanised", "image", "movie_banner", "description",
         "director", "producer", "release_date", "running_time", "rt_score", "url"],
        ["people", "species", "locations", "vehicles"],
    ),
    "people": _struct(["id", "name", "gender", "age", "eye_color", "hair_color", "species", "url"], ["films"]),
    "locations": _struct(["id", "name", "climate", "terrain", "surface_water", "url"], ["residents", "films"]),
    "species": _struct(["id", "name", "classification", "eye_colors", "hair_colors", "url"], ["people", "films"]),
    "vehicles": _struct(["id", "name", "description", "vehicle_class", "length", "pilot", "url"], ["films"]),
}


def read_json_entities(
    spark: SparkSession, path: str, schema: T.StructType, source: str | None = None, multi_line: bool = True
) -> DataFrame:
    """JSON arrays of entities with an explicit schema, stamped with load time and source."""
    out = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    out = out.withColumn("loaded_at", F.current_timestamp())
    return out.withColumn("source", F.lit(source)) if source else out


def decode_bytes(content: Column | str, fallback: str = "ISO-8859-1") -> Column:
    """Bytes as UTF-8 where they are valid UTF-8, else in the fallback encoding.

    The fallback maps every byte, so an encoding after it is never reached.
    """
    c = F.col(content) if isinstance(content, str) else content
    as_text = c.cast("string")
    return F.when(F.is_valid_utf8(as_text), as_text).otherwise(F.decode(c, fallback))


def read_csv_with_encodings(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV files, each in UTF-8 or Latin-1, with a header line; quoted fields may hold line ends.

    All files are parsed as Latin-1, which maps every byte to a sign and leaves the signs that CSV
    is made of alone. A scan line by line tells which files are valid UTF-8; it is joined by file,
    and the texts of these are turned back into their bytes and read as what they are. No file
    name reaches the driver.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), F.is_valid_utf8("value").alias("ok"))
    files = lines.groupBy("_file").agg(F.bool_and("ok").alias("_ok"))
    read = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "ISO-8859-1")
    rows = read.csv(path)
    joined = rows.select("*", F.col("_metadata.file_path").alias("_file")).join(files, "_file", "left")
    plain = lambda c: F.when(F.col("_ok"), F.encode(c, "ISO-8859-1").cast("string")).otherwise(F.col(c)).alias(c)
    return joined.select(*[plain(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in rows.schema.fields])


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """Timed-text files as one row per entry; see :func:`parse_timed_text`."""
    files = spark.read.format("binaryFile").load(path)
    named = files.select(
        F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("film_slug"), decode_bytes("content").alias("content")
    )
    return parse_timed_text(named, "content")


def _seconds(numbers: Column, first: int) -> Column:
    """Seconds from four number texts (hours, minutes, seconds, milliseconds)."""
    h, m, s, ms = (F.get(numbers, F.lit(first + i)).try_cast("double") for i in range(4))
    return (h * 3600000.0 + m * 60000.0 + s * 1000.0 + ms) / 1000.0


def parse_timed_text(files: DataFrame, content: str) -> DataFrame:
    """Entries of timed text: number, start, end, duration, cleaned text, ``ok``.

    ``first_time`` is the first time of day on the timing line, even of a broken one.

    Entries are separated by blank lines; an entry whose number or timing cannot be
    read keeps ``ok = false`` so that it can be counted as skipped.
    """
    ids = [c for c in files.columns if c != content]
    flat = F.regexp_replace(F.regexp_replace(F.col(content), "\r\n?", "\n"), "^﻿", "")
    blocks = F.filter(F.split(flat, r"\n[ \t]*\n\s*"), lambda x: F.trim(x) != "")
    rows = files.select(*ids, F.posexplode_outer(blocks).alias("position", "block")).filter(F.col("block").isNotNull())
    parts = rows.withColumn("_lines", F.split(F.regexp_replace("block", r"^\n+|\n+$", ""), "\n"))
    line = F.coalesce(F.get("_lines", F.lit(1)), F.lit(""))
    rest = F.array_join(F.slice("_lines", 3, F.greatest(F.size("_lines"), F.lit(1))), "\n")
    fields = F.struct(
        F.trim(F.get("_lines", F.lit(0))).try_cast("bigint").alias("number"),
        F.when(line.rlike(TIMING_LOOSE), F.regexp_extract_all(line, F.lit(r"\d+"), F.lit(0))).alias("pair"),
        F.regexp_extract_all(F.regexp_extract(line, TIME_OF_DAY, 0), F.lit(r"\d+"), F.lit(0)).alias("first"),
        text.clean_text(rest).alias("text"),
    )
    # A one-element explode keeps later filters from being rewritten in terms of the
    # patterns, which would evaluate them many times per row.
    parsed = parts.select(*ids, "position", F.explode(F.array(fields)).alias("_e"))
    out = parsed.select(
        *ids,
        "position",
        F.col("_e.number").alias("subtitle_index"),
        _seconds(F.col("_e.pair"), 0).alias("start_time"),
        _seconds(F.col("_e.pair"), 4).alias("end_time"),
        _seconds(F.col("_e.first"), 0).alias("first_time"),
        F.col("_e.text").alias("dialogue_text"),
    )
    return out.withColumn("duration", F.col("end_time") - F.col("start_time")).withColumn(
        "ok", F.col("subtitle_index").isNotNull() & F.col("start_time").isNotNull() & F.col("end_time").isNotNull()
    )


def detect_language(name: Column | str) -> Column:
    """Language code of ``<slug>_<lang>[_v2]_parsed`` names; NULL when unreadable or unknown."""
    n = F.col(name) if isinstance(name, str) else name
    parts = F.split(F.regexp_replace(n, r"\.json$", ""), "_")

    def last(i: int) -> Column:
        return F.try_element_at(parts, F.lit(-i))

    readable = (F.size(parts) >= 3) & (last(1) == "parsed")
    versioned = (F.size(parts) >= 4) & (last(2) == "v2")
    code = F.lower(F.when(versioned, last(3)).otherwise(last(2)))
    return F.when(readable & code.isin(LANGUAGES), code)


def split_by_language(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a supported language, and the quarantined rest."""
    tagged = df.withColumn("language_code", detect_language(name))
    return tagged.filter(F.col("language_code").isNotNull()), tagged.filter(F.col("language_code").isNull())


def file_language(slug: Column | str) -> Column:
    """Language by the end of a slug; English when there is none."""
    s = F.col(slug) if isinstance(slug, str) else slug
    code = F.regexp_extract(s, r"_(ja|fr|es|nl|ar)$", 1)
    return F.when(code != "", code).otherwise(F.lit("en"))


def document_metadata(lines: DataFrame, slug: str = "film_slug", keys: list[str] | None = None) -> DataFrame:
    """Name, language, number of entries and covered time per document.

    Entries without readable times do not count; a document with none of them has a
    duration of 0.
    """
    keys = keys or [slug]
    good = F.col("ok") if "ok" in lines.columns else F.lit(True)
    name = text.title_from_slug(F.regexp_replace(F.col(slug), r"_(en|ja|fr|es|nl|ar)", ""))
    return (
        lines.groupBy(*keys)
        .agg(
            F.count(F.when(good, 1)).alias("total_subtitles"),
            F.count(F.when(~good, 1)).alias("skipped"),
            F.coalesce(
                F.max(F.when(good, F.col("end_time"))) - F.min(F.when(good, F.col("start_time"))), F.lit(0.0)
            ).alias("total_duration"),
        )
        .withColumn("film_name", name)
        .withColumn("language_code", file_language(slug))
    )


DOCUMENT_SCHEMA = T.StructType(
    [
        T.StructField(
            "metadata",
            T.StructType(
                [
                    T.StructField("film_name", _TEXT),
                    T.StructField("film_slug", _TEXT),
                    T.StructField("language_code", _TEXT),
                    T.StructField("total_subtitles", T.LongType()),
                    T.StructField("total_duration", T.DoubleType()),
                    T.StructField("parse_timestamp", _TEXT),
                ]
            ),
        ),
        T.StructField(
            "subtitles",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("subtitle_index", T.LongType()),
                        T.StructField("start_time", T.DoubleType()),
                        T.StructField("end_time", T.DoubleType()),
                        T.StructField("duration", T.DoubleType()),
                        T.StructField("dialogue_text", _TEXT),
                    ]
                )
            ),
        ),
    ]
)


def explode_documents(docs: DataFrame) -> DataFrame:
    """Nested documents to one row per line with the document's metadata."""
    return docs.select("metadata.*", F.posexplode("subtitles").alias("position", "_s")).select(
        "*", "_s.*"
    ).drop("_s")


def versioned_source_pick(versions: list[DataFrame], keys: list[str]) -> DataFrame:
    """Per key the row of the last version that has it.

    Maximum by version: map-side partial aggregation, no sort and no window.
    """
    tagged = [
        v.select(*keys, F.lit(i).alias("_v"), F.struct(*[c for c in v.columns if c not in keys]).alias("_row"))
        for i, v in enumerate(versions)
    ]
    both = tagged[0]
    for t in tagged[1:]:
        both = both.unionByName(t)
    picked = both.groupBy(*keys).agg(F.max_by("_row", "_v").alias("_row"), (F.max("_v") + 1).cast("bigint").alias("version"))
    return picked.select(*keys, "_row.*", "version")


def parse_markdown_table(lines: DataFrame, value: str = "value") -> DataFrame:
    """Rows of ``| a | b | ...`` tables: title, language and score; bad scores become 0."""
    parts = F.transform(F.split(F.trim(F.col(value)), r"\|"), lambda x: F.trim(x))
    rows = lines.withColumn("_p", parts).filter(
        F.trim(F.col(value)).startswith("|")
        & ~F.trim(F.col(value)).startswith("|---")
        & ~(F.col(value).contains("Film") & F.col(value).contains("Language") & F.col(value).contains("Status"))
        & (F.size("_p") >= 7)
    )
    return rows.select(
        text.plain_slug(F.get("_p", F.lit(1)), True).alias("film_slug"),
        F.get("_p", F.lit(1)).alias("film_title"),
        F.lower(F.get("_p", F.lit(2))).alias("language"),
        F.coalesce(F.get("_p", F.lit(5)).try_cast("bigint"), F.lit(0).cast("bigint")).alias("priority_score"),
    ).filter((F.col("film_title") != "") & (F.col("language") != ""))


def lookup_rows(json_objects: DataFrame, column: str, schema: str, skip: list[str] | None = None) -> DataFrame:
    """A JSON object keyed by slug to one row per slug."""
    entries = json_objects.select(F.explode(F.from_json(column, f"map<string,struct<{schema}>>")).alias("film_slug", "_v"))
    return entries.filter(~F.col("film_slug").isin(skip or ["_documentation"])).select("film_slug", "_v.*")
