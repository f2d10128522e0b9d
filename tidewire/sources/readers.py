"""Readers of landed files: article lists, feeds, charts, surveys, statements, filings, consensus, registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ARTICLE = ["url", "title", "body", "domain", "lang", "published_ts", "source"]


def _first_per_url(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("url").orderBy("published_ts", "title")
    return rows.withColumn("k_", F.row_number().over(w)).where("k_ = 1").select(*ARTICLE)


def read_gdelt_json(spark: SparkSession, path: str) -> DataFrame:
    """Article rows of {"articles": [{url, title, seendate, domain, language}]}; no url or a bad date drops a row; one a url."""
    schema = "articles array<struct<url:string,title:string,seendate:string,domain:string,language:string>>"
    a = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("articles").alias("a")).select("a.*")
    ts = F.try_to_timestamp(F.regexp_replace("seendate", r"^(\d{8})T(\d{6})Z$", "$1$2"), F.lit("yyyyMMddHHmmss"))
    rows = a.select("url", F.trim(F.coalesce("title", F.lit(""))).alias("title"), F.lit(None).cast("string").alias("body"), F.coalesce("domain", F.lit("")).alias("domain"), F.coalesce("language", F.lit("")).alias("lang"), ts.alias("published_ts"), F.lit("gdelt").alias("source"))
    return _first_per_url(rows.where("url is not null and url != '' and published_ts is not null"))


def feed_date(s: Column) -> Column:
    """RFC 2822 (weekday optional; a missing or -0000 zone is UTC) or ISO date; null otherwise."""
    bare = F.regexp_replace(F.trim(s), r"^[A-Za-z]{3,},?\s+", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"-0000$", "+0000"), r"(?:GMT|UTC|UT|Z)$", "+0000")
    bare = F.when(bare.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} [\d:]+$"), F.concat(bare, F.lit(" +0000"))).otherwise(bare)
    rfc = F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss xx"))
    return F.coalesce(rfc, F.trim(s).try_cast("timestamp"))


def read_feeds(spark: SparkSession, path: str, collected: str, languages: dict[str, str] | None = None) -> DataFrame:
    """Article rows of RSS and Atom files; a title and a link are required, a missing date is the collection time."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("f"), "value")
    lang = F.lower(F.regexp_extract("value", r"(?is)<language>\s*([^<]+?)\s*</language>", 1))
    items = files.select("f", lang.alias("lang"), F.regexp_extract("value", r"(?is)<(?:channel|feed)\b[^>]*>.*?<link[^>]*?(?:href=[\"']|>)\s*(https?://[^\"'<\s]+)", 1).alias("home"),
                         F.explode(F.regexp_extract_all("value", F.lit(r"(?is)(<(?:item|entry)\b.*?</(?:item|entry)>)"), F.lit(1))).alias("x"))

    def tag(name: str) -> Column:
        raw = F.regexp_extract("x", rf"(?is)<{name}\b[^>]*>(.*?)</{name}>", 1)
        return F.trim(F.regexp_replace(raw, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1"))

    link = F.coalesce(F.nullif(tag("link"), F.lit("")), F.nullif(F.regexp_extract("x", r"""(?is)<link\b[^>]*href=["']([^"']+)""", 1), F.lit("")))
    body = F.coalesce(F.nullif(tag("description"), F.lit("")), F.nullif(tag("summary"), F.lit("")))
    date = F.coalesce(feed_date(F.nullif(tag("pubDate"), F.lit(""))), feed_date(F.nullif(tag("updated"), F.lit(""))), F.lit(collected).cast("timestamp"))
    names = F.create_map(*[F.lit(v) for kv in (languages or {"pt-br": "portuguese", "pt": "portuguese", "en": "english", "en-us": "english", "en-gb": "english"}).items() for v in kv])
    rows = items.select(link.alias("url"), tag("title").alias("title"), body.alias("body"), F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(F.nullif("home", F.lit("")), link), r"https?://([^/]+)", 1)), r"^www\.", "").alias("domain"),
                        F.coalesce(names[F.col("lang")], F.col("lang")).alias("lang"), date.alias("published_ts"), F.lit("rss").alias("source"))
    return _first_per_url(rows.where("url is not null and title != ''"))


def read_chart_json(spark: SparkSession, path: str, bars: bool = False) -> DataFrame:
    """(symbol, date or ts, open, close) of quote charts: parallel arrays, adjusted close first; null and zero closes go."""
    schema = "chart struct<result:array<struct<meta:struct<symbol:string>,timestamp:array<long>,indicators:struct<quote:array<struct<open:array<double>,close:array<double>>>,adjclose:array<struct<adjclose:array<double>>>>>>>"
    r = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("chart.result").alias("r"))
    q, adj = F.col("r.indicators.quote")[0], F.get(F.col("r.indicators.adjclose"), F.lit(0))["adjclose"]
    z = F.arrays_zip(F.col("r.timestamp").alias("t"), q["open"].alias("o"), q["close"].alias("c"), F.coalesce(adj, q["close"]).alias("a"))
    x = r.select(F.col("r.meta.symbol").alias("symbol"), F.explode(z).alias("z")).select("symbol", F.timestamp_seconds("z.t").alias("ts"), F.col("z.o").alias("open"), F.coalesce("z.a", "z.c").alias("close")).where("close is not null and close != 0")
    if bars:
        return x
    return x.groupBy("symbol", F.to_date("ts").alias("date")).agg(F.max_by("open", "ts").alias("open"), F.max_by("close", "ts").alias("close"))


def read_quotes_json(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, date, close) of {"results": [{symbol, historicalDataPrice: [{date, close, adjustedClose}]}]}."""
    schema = "results array<struct<symbol:string,historicalDataPrice:array<struct<date:long,close:double,adjustedClose:double>>>>"
    x = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("results").alias("r")).select("r.symbol", F.explode("r.historicalDataPrice").alias("p"))
    return x.select("symbol", F.to_date(F.timestamp_seconds("p.date")).alias("date"), F.coalesce(F.nullif("p.adjustedClose", F.lit(0.0)), "p.close").alias("close")).where("close is not null and close != 0")


def month(s: Column) -> Column:
    """'MM/YYYY' to the first of the month."""
    return F.to_date(F.try_to_timestamp(F.concat(F.lit("01/"), s), F.lit("dd/MM/yyyy")))


def read_expectations(spark: SparkSession, path: str) -> DataFrame:
    """(indicator, ref_month, projected, median, stddev, n_resp) of survey responses."""
    schema = "value array<struct<Indicador:string,DataReferencia:string,Data:string,Mediana:double,DesvioPadrao:double,numeroRespondentes:int>>"
    v = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("value").alias("v")).select("v.*")
    return v.select(F.col("Indicador").alias("indicator"), month(F.col("DataReferencia")).alias("ref_month"), F.col("Data").try_cast("date").alias("projected"), F.col("Mediana").alias("median"), F.col("DesvioPadrao").alias("stddev"), F.col("numeroRespondentes").alias("n_resp")).where("ref_month is not null and projected is not null")


def realized_months(rows: DataFrame) -> DataFrame:
    """(indicator, ref_month, value): the last reading of each month of (indicator, data 'dd/mm/yyyy', valor)."""
    d = F.to_date(F.try_to_timestamp("data", F.lit("dd/MM/yyyy")))
    x = rows.select("indicator", d.alias("d"), F.regexp_replace("valor", ",", ".").try_cast("double").alias("v")).where("d is not null and v is not null")
    return x.groupBy("indicator", F.trunc("d", "month").alias("ref_month")).agg(F.max_by("v", "d").alias("value"))


def read_realized(spark: SparkSession, path: str, indicator: str) -> DataFrame:
    return realized_months(spark.read.schema("data string, valor string").json(path, multiLine=True).withColumn("indicator", F.lit(indicator)))


def _csv(spark: SparkSession, path: str, names: dict[str, str], line: str | None = None) -> DataFrame:
    """The columns of names; line: a column that orders rows by file name, place of the split and row within it."""
    raw = spark.read.csv(path, sep=";", encoding="ISO-8859-1", header=True)
    place = [F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row")).alias(line)] if line else []
    return raw.select(*[(F.col(k) if k in raw.columns else F.lit(None).cast("string")).alias(v) for k, v in names.items()], *place)


def read_statements_csv(spark: SparkSession, path: str) -> DataFrame:
    """Lines of regulator statements for fundamentals.pivot_statements; `line` keeps the order of files by name and of their lines."""
    return _csv(spark, path, {"CNPJ_CIA": "company", "DENOM_CIA": "name", "DT_REFER": "filed", "DT_FIM_EXERC": "period", "ORDEM_EXERC": "exercise", "CD_CONTA": "code", "DS_CONTA": "label", "VL_CONTA": "value", "ESCALA_MOEDA": "scale"}, "line")


def read_filings_csv(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, {"Nome_Companhia": "name", "CNPJ_Companhia": "tax_id", "Categoria": "category", "Assunto": "subject", "Data_Referencia": "reference", "Data_Entrega": "delivered", "Protocolo_Entrega": "protocol", "Versao": "version", "Link_Download": "link"})


def clean_consensus(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of rows of strings (ticker, period, metric, consensus, dispersion, n_analysts, asof_date): ticker upper,
    metric lower, the date ISO or epoch seconds. Bad: no ticker, period or metric, no number, no date."""
    at = F.coalesce(F.when(F.col("asof_date").rlike(r"^\d{9,}$"), F.timestamp_seconds(F.col("asof_date").try_cast("long"))), F.trim("asof_date").try_cast("timestamp"))
    x = raw.select(F.upper(F.trim("ticker")).alias("ticker"), F.trim("period").alias("period"), F.lower(F.trim("metric")).alias("metric"), F.col("consensus").try_cast("double").alias("consensus"), F.col("dispersion").try_cast("double").alias("dispersion"), F.col("n_analysts").try_cast("int").alias("n_analysts"), at.alias("asof_ts"))
    ok = F.coalesce((F.col("ticker") != "") & (F.col("period") != "") & (F.col("metric") != "") & F.col("consensus").isNotNull() & F.col("asof_ts").isNotNull(), F.lit(False))
    return x.where(ok), x.where(~ok)


def read_consensus_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    names = ["ticker", "period", "metric", "consensus", "dispersion", "n_analysts", "asof_date"]
    raw = spark.read.csv(path, header=True)
    return clean_consensus(raw.select(*[(F.col(n) if n in raw.columns else F.lit(None).cast("string")).alias(n) for n in names]))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Active companies of the regulator's registry: (tax_id, name, sector)."""
    x = _csv(spark, path, {"CNPJ_CIA": "tax_id", "DENOM_SOCIAL": "name", "SETOR_ATIV": "sector", "SIT": "status"})
    return x.where(F.upper(F.trim("status")) == "ATIVO").drop("status")


def clean_universe(raw: DataFrame) -> DataFrame:
    """Candidate entities with a well-formed ticker (four letters and one or two digits), one row each."""
    t = F.upper(F.trim("ticker"))
    x = raw.withColumn("ticker", t).where(F.col("ticker").rlike(r"^[A-Z]{4}[0-9]{1,2}$"))
    rest = [c for c in x.columns if c != "ticker"]
    return x.groupBy("ticker").agg(F.min(F.struct(*rest)).alias("r_")).select("ticker", "r_.*").select(raw.columns)
