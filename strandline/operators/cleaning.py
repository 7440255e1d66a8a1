"""Table-level cleaning and staging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions import text


def stage_columns(df: DataFrame, integers: list[str] = (), texts: list[str] = (), renames: dict[str, str] | None = None) -> DataFrame:
    """Text numbers to integers and NULL texts to ''."""
    out = df.withColumns(
        {**{c: F.col(c).try_cast("int") for c in integers}, **{c: F.coalesce(F.col(c), F.lit("")) for c in texts}}
    )
    return out.withColumnsRenamed(renames) if renames else out


def stage_films(films: DataFrame) -> DataFrame:
    staged = stage_columns(
        films, ["release_date", "running_time", "rt_score"], ["director", "producer", "description"],
        {"release_date": "release_year"},
    )
    return staged.drop("original_title", "original_title_romanised", "url")


def whitelist(df: DataFrame, column: str, allowed: list[str], out: str | None = None) -> DataFrame:
    """Values outside the list become NULL."""
    return df.withColumn(out or column, F.when(F.col(column).isin(allowed), F.col(column)))


def stage_people(people: DataFrame) -> DataFrame:
    out = whitelist(people, "gender", ["Male", "Female"])
    return out.withColumn("species_id", text.last_segment("species")).drop("species", "url")


def percent_to_double(column: str):
    """'80%' to 80.0; '' and NULL to NULL."""
    c = F.col(column)
    return F.when(c.isNotNull() & (c != ""), F.replace(c, F.lit("%"), F.lit("")).try_cast("double"))


def stage_locations(locations: DataFrame) -> DataFrame:
    return (
        stage_columns(locations, texts=["climate", "terrain"])
        .withColumn("surface_water_pct", percent_to_double("surface_water"))
        .drop("surface_water", "url")
    )


def stage_species(species: DataFrame) -> DataFrame:
    wanted = ["id", "name", "classification", "eye_colors", "hair_colors", "people", "films", "loaded_at", "source"]
    return species.select(*[c for c in wanted if c in species.columns])


def fill_missing(df: DataFrame, numbers: list[str], strings: list[str], label: str = "Unknown") -> DataFrame:
    """NULL numbers to 0 and NULL strings to a label."""
    numbers = [c for c in numbers if c in df.columns]
    strings = [c for c in strings if c in df.columns]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    values = {c: (F.lit(0).cast(kinds[c]) if not isinstance(kinds[c], T.StringType) else F.lit("0")) for c in numbers}
    values.update({c: F.lit(label) for c in strings})
    return df.withColumns({c: F.coalesce(F.col(c), v) for c, v in values.items()})


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """NULLs per column in one pass, one row per column."""
    one = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns])
    return one.unpivot([], columns, "column", "missing")


def stage_financials(raw: DataFrame) -> DataFrame:
    """Cleaned title, parsed duration and money of a financial table."""
    return raw.withColumns(
        {
            "title": text.clean_title("name"),
            "duration": text.parse_duration("duration"),
            "budget": text.clean_currency("budget"),
            "revenue": text.clean_currency("revenue"),
        }
    )


def split_valid(df: DataFrame, column: str, max_length: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected rows with the reason."""
    tagged = df.withColumn("reason", text.input_problem(column, max_length))
    return tagged.filter(F.col("reason").isNull()).drop("reason"), tagged.filter(F.col("reason").isNotNull())
