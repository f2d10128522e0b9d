"""Regulatory filings of companies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.text import strip_accents


def match_filings(filings: DataFrame, companies: DataFrame, categories: list[str] | None = None, kinds: dict[str, str] = config.FILING_KINDS) -> DataFrame:
    """Filings (name, tax_id, category, subject, reference, delivered, protocol, version, link) of companies (ticker, tax_id, terms array).

    By the digits of the tax id; companies without one by a term of their name, without accents. Rows without a link are
    dropped. kind follows the category. Id matches are an equi-join; only distinct names and the terms of id-less companies see a name test.
    """
    f = filings.where(F.trim(F.coalesce("link", F.lit(""))) != "")
    if categories:
        f = f.where(F.col("category").isin(categories))
    f = f.withColumn("digits_", F.regexp_replace(F.coalesce("tax_id", F.lit("")), r"\D", "")).withColumn("name_", F.upper(strip_accents(F.coalesce("name", F.lit("")))))
    c = companies.select("ticker", F.regexp_replace(F.coalesce("tax_id", F.lit("")), r"\D", "").alias("digits_"), "terms")
    by_id = f.join(c.where("digits_ != ''").drop("terms"), "digits_")
    named = c.where("digits_ = ''").select("ticker", F.explode("terms").alias("t_")).select("ticker", F.upper(strip_accents(F.col("t_"))).alias("t_"))
    # names are tested once each, however many filings bear them: a registry of names against one of terms
    hit = f.select("name_").distinct().join(named, F.contains(F.col("name_"), F.col("t_"))).select("name_", "ticker").distinct()
    by_name = f.join(hit, "name_").dropDuplicates(["ticker", "link", "protocol", "version"])
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("category")], F.lit("CVM"))
    cols = ["ticker", F.trim("link").alias("url"), kind.alias("kind"), "category", F.substring(F.coalesce(F.nullif("subject", F.lit("")), "category", F.lit("")), 1, 200).alias("title"), "reference", "delivered", "protocol", "version"]
    return by_id.select(*cols).unionByName(by_name.select(*cols))
