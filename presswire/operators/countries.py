"""Country and region lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from presswire.functions import fixed_values as V
from presswire.functions import text as T


def regional_name(code: Column) -> Column:
    """Name of a regional code, NULL for any other."""
    names = F.create_map(*[F.lit(x) for kv in V.REGIONAL_CODES.items() for x in kv])
    return names[code]


def country_name(df: DataFrame, code_col: str, iso: DataFrame, name: str = "COUNTRY") -> DataFrame:
    """Add the name of a regional, two-letter or three-letter code, NULL when unknown.

    `iso` has `alpha2`, `alpha3` and `name`. Both code forms are stacked into one lookup
    table; Spark broadcasts it as long as it is below the broadcast threshold.
    """
    lookup = iso.select(
        F.explode(F.array("alpha2", "alpha3")).alias("_code"), F.col("name").alias("_name")
    ).filter(F.length("_code").isin(2, 3)).dropDuplicates(["_code"])
    code = F.upper(T.strip(F.col(code_col)))
    return (
        df.withColumn("_code", code)
        .join(lookup, "_code", "left")
        .withColumn(name, F.coalesce(regional_name(F.col("_code")), F.col("_name")))
        .drop("_code", "_name")
    )


def region_label(df: DataFrame, iso: DataFrame, name: str = "REGION") -> DataFrame:
    """Country name, else the code itself, else `Global`."""
    code = F.col("ACTOR_COUNTRY_CODE")
    return country_name(df, "ACTOR_COUNTRY_CODE", iso, "_country").withColumn(
        name, F.coalesce(F.col("_country"), F.when(code != "", code), F.lit("Global"))
    ).drop("_country")


def region_members(df_region: Column) -> Column:
    """Member codes of a region name, NULL for an unknown one."""
    pairs = [x for k, v in V.REGION_MEMBERS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]
    return F.create_map(*pairs)[F.lower(df_region)]


def region_expand(events: DataFrame, region: str) -> DataFrame:
    """Events whose country belongs to `region`."""
    return events.filter(F.col("ACTOR_COUNTRY_CODE").isin(V.REGION_MEMBERS[region.lower()]))


def expand_regions(regions: DataFrame, region_col: str = "region") -> DataFrame:
    """One row per region and member country."""
    return regions.select(
        F.lower(F.col(region_col)).alias("region"),
        F.explode(region_members(F.col(region_col))).alias("ACTOR_COUNTRY_CODE"),
    )


def country_alias(
    df: DataFrame,
    name_col: str,
    iso: DataFrame,
    stop_words: Sequence[str] | DataFrame,
    code: str = "COUNTRY_CODE",
) -> DataFrame:
    """Add the three-letter code of a country name or nationality, NULL when unknown.

    Stop words, single characters and numbers have none. Known aliases come first; other
    names take the closest country whose name contains them, else one that starts with the
    same three letters. Stop words are a list or the first column of a table of any size. Rows without a name have no
    code and take no part in the match: each input partition gives its own a key that no name has, so they do not
    meet in one task of the last join. Only distinct names are matched. Both acceptance rules need the first three
    letters of the name to occur in the country name, which makes the match an equi-join
    on those letters.
    """
    clean = F.lower(T.strip(F.col(name_col)))
    names = df.select(clean.alias("_name")).filter(F.length("_name") >= 2).distinct()
    if isinstance(stop_words, DataFrame):
        stopped = stop_words.select(F.lower(T.strip(F.col(stop_words.columns[0]))).alias("_name"))
        names = names.join(stopped, "_name", "left_anti")
    else:
        names = names.filter(~F.col("_name").isin(list(stop_words)))
    aliases = F.create_map(*[F.lit(x) for kv in V.COUNTRY_ALIASES.items() for x in kv])
    named = names.withColumn("_alias", aliases[F.col("_name")])
    exact = named.filter(F.col("_alias").isNotNull()).select("_name", F.col("_alias").alias(code))

    country = F.lower(F.col("name"))
    grams = F.array_distinct(
        F.transform(F.sequence(F.lit(1), F.length(country) - 2), lambda i: F.substring(country, i, F.lit(3)))
    )
    places = iso.filter(F.length("name") >= 3).select(
        country.alias("_country"), F.col("alpha3").alias("_alpha3"), F.explode(grams).alias("_gram")
    )
    unknown = named.filter(
        F.col("_alias").isNull() & (F.length("_name") >= 3) & ~T.matches(F.col("_name"), r"^\d+$")
    ).withColumn("_gram", F.substring("_name", 1, 3))
    near = unknown.join(places, "_gram").filter(
        F.col("_country").contains(F.col("_name")) | F.col("_country").startswith(F.col("_gram"))
    )
    rank = F.struct(
        (~F.col("_country").contains(F.col("_name"))).alias("outside"),
        F.levenshtein("_name", "_country").alias("distance"),
        "_country",
        "_alpha3",
    )
    closest = near.groupBy("_name").agg(F.min(rank).alias("_best"))
    fuzzy = closest.select("_name", F.col("_best._alpha3").alias(code))
    nameless = F.concat(F.lit("\0"), F.spark_partition_id().cast("string"))
    return (
        df.withColumn("_name", F.coalesce(clean, nameless))
        .join(exact.unionByName(fuzzy), "_name", "left")
        .drop("_name")
    )
