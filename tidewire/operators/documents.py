"""Reports: register, page chunks, term facts, text quality, links of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config


def register(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new (ticker, url, content, ...) that existing (ticker, sha256, url) lacks, with sha256: one a (ticker, content) and (ticker, url)."""
    from ..sources.sinks import insert_new

    n = new.withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256))
    return insert_new(existing, insert_new(existing, n, ["ticker", "sha256"], ["url"]), ["ticker", "url"], ["sha256"])


def page_chunks(text: Column, size: int = 12_000, mark: str = r"\[PÁGINA \d+\]") -> Column:
    """array<struct<pages array<int>, text>>: pages (split before each mark) gathered greedily up to `size` characters;
    a page is never cut, so one longer than that is a chunk of its own."""
    pieces = F.filter(F.split(text, f"(?={mark})"), lambda p: F.trim(p) != "")
    page = lambda p: F.try_to_number(F.nullif(F.regexp_extract(p, r"^\[PÁGINA (\d+)\]", 1), F.lit("")), F.lit("9999999")).cast("int")
    none = F.array().cast("array<int>")
    start = F.struct(F.array().cast("array<struct<pages:array<int>,text:string>>").alias("done"), none.alias("pages"), F.lit("").alias("cur"))

    def add(a: Column, p: Column) -> Column:
        cut = (F.length(a["cur"]) + F.length(p) > size) & (a["cur"] != "")
        mine = F.array_compact(F.array(page(p)))
        return F.when(cut, F.struct(F.concat(a["done"], F.array(F.struct(a["pages"].alias("pages"), a["cur"].alias("text")))).alias("done"), mine.alias("pages"), p.alias("cur"))).otherwise(
            F.struct(a["done"].alias("done"), F.concat(a["pages"], mine).alias("pages"), F.concat(a["cur"], p).alias("cur")))

    return F.aggregate(pieces, start, add, lambda a: F.when(a["cur"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(F.struct(a["pages"].alias("pages"), a["cur"].alias("text"))))))


def term_facts(text: Column, terms: list[str] = config.REPORT_TERMS, before: int = 180, after: int = 450, most: int = 8) -> Column:
    """struct<counts map, snippets array>: occurrences of each term, and the surroundings of the first of those found (`most` at most)."""
    low = F.lower(text)
    counts = F.map_from_arrays(F.array(*[F.lit(t) for t in terms]), F.array(*[F.regexp_count(low, F.lit("\\Q" + t + "\\E")) for t in terms]))

    def snippet(t: str) -> Column:
        at = F.locate(t, low)
        start = F.greatest(at - before, F.lit(1))
        return F.when(at > 0, F.regexp_replace(F.substring(text, start, at + after - start), "\n", " "))

    return F.struct(counts.alias("counts"), F.slice(F.array_compact(F.array(*[snippet(t) for t in terms])), 1, most).alias("snippets"))


def text_quality(text: Column) -> Column:
    """Share of letters and white space; 0 of an empty text."""
    n = F.length(text)
    return F.when(n > 0, F.length(F.regexp_replace(text, r"[^\p{L}\s]", "")) / n).otherwise(0.0)


def extract_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(page, link, label, kind) of anchors on the page's own host that look like documents.

    Relative addresses resolve against the page; fragments are cut."""
    anchors = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"(?is)(<a\b[^>]*>.*?</a>)"), F.lit(1))
    a = pages.select(F.col(url).alias("page"), F.explode(anchors).alias("tag"))
    unescape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&quot;"), F.lit('"')), F.lit("&#39;"), F.lit("'")), F.lit("&amp;"), F.lit("&"))
    a = a.withColumn("href", unescape(F.regexp_extract("tag", r"""(?i)href=["']([^"']+)["']""", 1))).where("href != ''")
    a = a.withColumn("label", F.trim(F.regexp_replace(unescape(F.regexp_replace("tag", r"<[^>]+>", " ")), r"\s+", " ")))
    scheme, root = F.regexp_extract("page", r"^([a-zA-Z]+):", 1), F.regexp_extract("page", r"^([a-zA-Z]+://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace("page", r"[?#].*$", ""), r"(?<=[^/])/[^/]*$", "/")
    full = F.when(F.col("href").rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.col("href")).when(F.startswith("href", F.lit("//")), F.concat(scheme, F.lit(":"), "href")).when(
        F.startswith("href", F.lit("/")), F.concat(root, "href")).otherwise(F.concat(folder, "href"))
    a = a.withColumn("link", F.regexp_replace(full, r"#.*$", ""))
    host = lambda c: F.lower(F.regexp_extract(c, r"^https?://([^/?#]+)", 1))
    low = F.lower(F.concat_ws(" ", "link", "label"))
    some = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
    ok = (host(F.col("link")) != "") & (host(F.col("link")) == host(F.col("page"))) & some(config.DOCUMENT_HINTS) & ~some(config.NOT_DOCUMENTS)
    kind = F.when(some(["resultado", "earnings", "release", "quarter"]), "RESULTADO").otherwise("RI")
    found = a.where(ok).select("page", "link", "label", kind.alias("kind"))
    return found.groupBy("page", "link").agg(F.min(F.struct("label", "kind")).alias("x")).select("page", "link", "x.label", "x.kind")
