"""Whole-table normalization of entities (entity_id, business_name, business_address, country)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwell.functions import phonetic, scripts, text


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def normalize_entities(df: DataFrame, indic: bool = False) -> DataFrame:
    """df with the derived columns; the given ones stay. indic: romanize Indic scripts (an Arrow UDF)."""
    require(df, "business_name", "business_address", "country")
    name, address = F.col("business_name"), F.col("business_address")
    df = df.withColumns(
        {
            "name_raw": name,
            "name_norm": text.normalize_name(name, indic),
            "name_script": scripts.script_of(name),
            "name_embedded_url": text.embedded_url(name),
            "address_raw": address,
            "address_norm": text.normalize_address(address, indic),
            "address_script": scripts.script_of(address),
            "postal_code": text.postal_code(address),
            "is_landmark_address": text.is_landmark(address),
            "country_raw": F.col("country"),
            "country_norm": text.normalize_country(F.col("country")),
        }
    )
    return df.withColumns({"name_tokens": text.token_set(F.col("name_norm")), "address_tokens": text.words(F.col("address_norm"))})


def add_phonetic(df: DataFrame) -> DataFrame:
    """df with name_phonetic (reduced where the script is not Latin) and name_phonetic_applied."""
    require(df, "name_norm", "name_script")
    use = phonetic.applies(F.col("name_script"))
    return df.withColumns({"name_phonetic": F.when(use, phonetic.reduced(F.col("name_norm"))).otherwise(F.coalesce("name_norm", F.lit(""))), "name_phonetic_applied": use})
