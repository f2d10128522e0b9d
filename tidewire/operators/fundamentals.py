"""Statements: codes to concepts, identity checks, ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.text import norm


def family(revenue_label: Column) -> Column:
    n = norm(revenue_label)
    return F.when(n.contains("intermediacao financeira") | n.contains("juros"), "banco").when(n.contains("seguradora") | n.contains("resseguradora"), "seguradora").otherwise("industria")


def concept(code: Column, label: Column, codes: dict[str, str] = config.STATEMENT_CODES, ambiguous=config.AMBIGUOUS_CODES) -> Column:
    """Concept of a line by its code; an ambiguous code goes by its normalized label first."""
    out = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])[code]
    n = norm(label)
    for cd, names in ambiguous.items():
        for c, parts in reversed(names.items()):
            hit = F.lit(False)
            for p in parts:
                hit = hit | n.contains(p)
            out = F.when((code == cd) & hit, c).otherwise(out)
    return out


def pivot_statements(lines: DataFrame, codes: dict[str, str] = config.STATEMENT_CODES, ambiguous=config.AMBIGUOUS_CODES) -> DataFrame:
    """(company, period, filed, name, family, concepts map) of lines (company, name, filed, period, exercise, code, label, value, scale, line).

    Only the current exercise; values in thousands are scaled; of one concept the last line (column line) counts.
    """
    x = lines.where(F.col("exercise") == "ÚLTIMO").withColumn("concept", concept(F.col("code"), F.col("label"), codes, ambiguous)).where("concept is not null")
    v = F.col("value").try_cast("double") * F.when(F.upper(F.coalesce("scale", F.lit(""))).startswith("MIL"), 1000).otherwise(1)
    x = x.withColumn("v_", v).where("v_ is not null")
    one = x.groupBy("company", "period", "concept").agg(F.max_by("v_", "line").alias("v_"))
    head = x.groupBy("company", "period").agg(F.max_by("filed", "line").alias("filed"), F.max_by("name", "line").alias("name"), F.max_by(F.when(F.col("code") == "3.01", family(F.col("label"))), F.when(F.col("code") == "3.01", F.col("line"))).alias("family"))
    # a period has as many entries as there are concepts: a dozen
    return head.join(one.groupBy("company", "period").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("concept", "v_")))).alias("concepts")), ["company", "period"])


def validate(periods: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """periods with problems: identities (gross profit = revenue + cost) off by over the tolerance."""
    c = F.col("concepts")
    real, want = c["lucro_bruto"], c["receita_liquida"] + c["custo"]
    off = F.abs(real - want) / F.greatest(F.abs(real), F.abs(want), F.lit(1.0)) > tolerance
    return periods.withColumn("problems", F.array_compact(F.array(F.when(off, F.lit("lucro_bruto != receita_liquida + custo")))))


def ratios(periods: DataFrame, market_value: str | None = None) -> DataFrame:
    """periods with margins, return on equity and, with a market value, price ratios (quarterly profit x 4); null where undefined."""
    c = lambda k: F.col("concepts")[k]
    div = lambda a, b: F.try_divide(a, F.nullif(b, F.lit(0.0)))
    out = {"net_margin": div(c("lucro_liquido"), c("receita_liquida")), "gross_margin": div(c("lucro_bruto"), c("receita_liquida")), "ebit_margin": div(c("ebit"), c("receita_liquida")), "roe": div(c("lucro_liquido"), c("patrimonio_liquido"))}
    if market_value:
        out |= {"pe": div(F.col(market_value), c("lucro_liquido") * 4), "pb": div(F.col(market_value), c("patrimonio_liquido"))}
    return periods.withColumns(out)
