"""Queries over articles: text, scores, mentions, stories, attention, signals, routing, alarms, quality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import config
from ..functions import stats, text, timeutil
from ..operators import alarms, attention, calibrate, dedupe, documents, entity, evaluate, models, quality, routing, score, signal, sources_weight
from ..sources import readers, sinks
from ..streaming import streams
from .mapping import ARTICLES, BARS, CLUSTERED, R, articles, bars, clustered, content_sql, figures_sql, norm_sql, r6, table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


# A lexicon of words and phrases that the tables' texts hold.
POS = {"the": 0.1, "an": 0.4, "de": 0.3, "le": 0.5, "der": 0.45, "and": 0.35, "with": 0.2, "para": 0.6}
NEG = {"of": -0.3, "la": -0.45, "die": -0.5, "to": -0.25, "was": -0.6, "por": -0.35}
PHRASE = {"of the": -0.2, "on the": 0.55, "de la": 0.15, "in der": -0.4}
NO, HEDGE = ["not", "it", "en", "das"], ["this", "un", "von"]
EVENT = [("first", r"\b(clown|idiot|moron)\b", 0.9), ("second", r"\b(heing|thing)\b", 0.7), ("third", r"\b(leaux|lichen|asor)\b|token", 0.55)]
WORDS = {"idiot": 1.0, "clown": 0.8, "worthless": 0.9, "the": 0.2, "que": 0.3, "und": 0.4, "token": 0.7}
MARKET, NOISE = ["the", "and", "of", "de", "que", "la", "der", "und", "die", "in"], ["to", "le", "un"]
WATCH = {"AAAA3": ["AAAA3", "and the", "thing"], "BBBB4": ["la de", "que", "BBBB4"], "CCCC1": ["und der", "ist"], "DDDD2": ["idiot", "moron", "to the"]}

_DOTS = r"[^a-z0-9%+\-.\s]"


def _strings(items) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


@query("text_norm", f"SELECT doc_id, md5({norm_sql('text')}) AS norm_md5, len(list_filter(string_split({norm_sql('text')}, ' '), lambda t: t <> '')) AS n_tokens FROM documents")
def qnorm_sql(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.norm(F.col("text")).cast("binary")).alias("norm_md5"), F.size(text.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query("content_tokens", f"SELECT doc_id, array_to_string({content_sql('text')}, ' ') AS toks FROM documents")
def q_content(spark, sf):
    return articles(spark, sf).select(F.col("article_id").alias("doc_id"), F.array_join(F.array_sort(text.content_tokens(F.col("body"))), " ").alias("toks"))


_FIG = "x AS (SELECT doc_id, lower(strip_accents('a ' || (doc_id % 977) || ',' || (doc_id % 10) || ' bi b ' || doc_id % 3 || '.5 milhoes ' || text)) AS t FROM documents)"


@query("figures", f"WITH {_FIG} SELECT doc_id, array_to_string({figures_sql('t')}, ' ') AS figs FROM x")
def q_figures(spark, sf):
    t = F.concat(F.lit("a "), (F.col("doc_id") % 977).cast("string"), F.lit(","), (F.col("doc_id") % 10).cast("string"), F.lit(" bi b "), (F.col("doc_id") % 3).cast("string"), F.lit(".5 milhoes "), "text")
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(text.figures(t), text.figure_string), " ").alias("figs"))


@query("same_story_scores", f"""WITH {ARTICLES}, w AS (SELECT article_id, ts, {content_sql('title')} AS k, {figures_sql("lower(strip_accents(title))")} AS f, list_filter(string_split({norm_sql("title || ' ' || substr(body, 1, 400)")}, ' '), lambda t: t <> '') AS t FROM articles),
h AS (SELECT article_id, len(t) AS n, unnest(list_transform(range(1, greatest(1, len(t) - 2) + 1), lambda i: ('0x' || substr(md5(array_to_string(t[i:i + 2], ' ')), 1, 16))::UBIGINT)) AS h FROM w),
bits AS (SELECT article_id, i, 2 * sum((h >> i) & 1) > greatest(1, n - 2) AS on_ FROM h, range(63) r(i) GROUP BY article_id, i, n), sig AS (SELECT article_id, bit_or(CASE WHEN on_ THEN 1::UBIGINT << i ELSE 0 END) AS sig FROM bits GROUP BY article_id),
v AS (SELECT * FROM w JOIN sig USING (article_id)), p AS (SELECT a.article_id AS a, b.article_id AS b, a.ts, CASE WHEN len(a.k) = 0 OR len(b.k) = 0 THEN 0 ELSE len(list_intersect(a.k, b.k)) / len(list_distinct(list_concat(a.k, b.k)))::DOUBLE END AS j, bit_count(xor(a.sig, b.sig))::INT AS h, list_has_any(a.f, b.f) AS f
  FROM v a JOIN v b ON b.ts - a.ts < 172800 AND (a.ts < b.ts OR a.ts = b.ts AND a.article_id < b.article_id)),
m AS (SELECT b, min({{'ts': ts, 'a': a, 'j': j, 'h': h}}) AS x FROM p WHERE j >= {config.JACCARD_MIN}::DOUBLE OR h <= {config.HAMMING_MAX} OR f AND j >= {config.JACCARD_WITH_FIGURE}::DOUBLE GROUP BY b)
SELECT x.a AS a, b, {R('x.j')} AS jaccard, x.h AS hamming FROM m""")
def q_same_story(spark, sf):
    """Each article that repeats a story with the article it is matched to, and by how much."""
    a = articles(spark, sf)
    p = dedupe.parents(a, 48, hash="md5").where("parent is not null").select(F.col("parent").alias("a"), F.col("article_id").alias("b"))
    f = sinks.written(dedupe.story_features(a, hash="md5"), "stories")
    side = lambda n: f.select(F.col("article_id").alias(n), F.col("toks").alias("t" + n), F.col("sig").alias("s" + n))
    j = p.join(side("a"), "a").join(side("b"), "b")
    return j.select("a", "b", r6(text.jaccard(F.col("ta"), F.col("tb"))).alias("jaccard"), text.hamming(F.col("sa"), F.col("sb")).alias("hamming"))


_LETTERS = r"CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^\p{L}\s]', '', 'g')) / length(text)::DOUBLE ELSE 0 END"


@query("text_quality", f"SELECT doc_id, {R(_LETTERS)} AS quality FROM documents")
def q_quality(spark, sf):
    return table(spark, sf, "documents").select("doc_id", r6(documents.text_quality(F.col("text"))).alias("quality"))


def _scored(spark, sf, df=None):
    return score.lexicon_score(df if df is not None else articles(spark, sf), positive=POS, negative=NEG, phrases=PHRASE, negators=NO, hedges=HEDGE, events=EVENT)


def _lexicon_sql() -> str:
    table_ = ", ".join(f"'{k}': {v!r}::DOUBLE" for k, v in {**NEG, **POS}.items())
    phrase = " + ".join(f"CASE WHEN contains(t, '{k}') THEN {v!r}::DOUBLE ELSE 0.0 END" for k, v in PHRASE.items())
    hits = " + ".join(f"contains(t, '{k}')::INT" for k in PHRASE)
    event = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p, _ in EVENT)
    mag = " ".join(f"WHEN regexp_matches(t, '{p}') THEN {w!r}::DOUBLE" for _, p, w in EVENT)
    return f"""lt AS (SELECT article_id, {norm_sql("title || ' ' || substr(body, 1, 600)")} AS t FROM articles), lk AS (SELECT article_id, t, list_filter(string_split(t, ' '), lambda x: x <> '') AS k FROM lt),
lf AS (SELECT article_id, t, k, list_filter(list_transform(range(1, len(k) + 1), lambda i: CASE WHEN list_has_any(k[greatest(i - 3, 1):i - 1], {_strings(NO)}) THEN -0.7 * MAP {{{table_}}}[k[i]] ELSE MAP {{{table_}}}[k[i]] END), lambda w: w IS NOT NULL) AS w FROM lk),
ls AS (SELECT article_id, t, k, coalesce(list_sum(w), 0) + {phrase} AS total, len(w) + {hits} AS hits FROM lf),
sc0 AS (SELECT article_id, CASE WHEN hits = 0 THEN 0.0 ELSE greatest(-1.0, least(1.0, total / sqrt(hits))) END AS s,
  (CASE {mag} ELSE 0.25 END) * (CASE WHEN list_has_any(k, {_strings(HEDGE)}) THEN 0.45 ELSE 1 END) * (CASE WHEN hits = 0 THEN 0.3 ELSE 1 END) AS magnitude, CASE {event} ELSE 'unclassified' END AS event_type FROM ls), sc AS (SELECT article_id, round(s, 4) + 0.0 AS s, round(magnitude, 4) AS magnitude, event_type FROM sc0)"""


LEX = _lexicon_sql()


@query("lexicon_score", f"WITH {ARTICLES}, {LEX} SELECT article_id, s, magnitude, event_type FROM sc")
def q_lexicon(spark, sf):
    return _scored(spark, sf).select("article_id", "s", "magnitude", "event_type")


@query("orientation", f"""WITH {ARTICLES}, x AS (SELECT article_id, {norm_sql('body')} AS t FROM articles), y AS (SELECT article_id, CASE WHEN regexp_matches(t, '\\b(the|le)\\b') THEN 'passado' END AS a, CASE WHEN regexp_matches(t, '\\b(of|de)\\b') OR regexp_matches(t, '\\bder\\b') THEN 'presente' END AS b, CASE WHEN regexp_matches(t, '\\b\\w+(?:er|ing)\\b') THEN 'futuro' END AS c FROM x)
SELECT article_id, CASE WHEN a IS NULL AND b IS NULL AND c IS NULL THEN 'presente' ELSE concat_ws(',', c, a, b) END AS orientation FROM y""")
def q_orientation(spark, sf):
    o = score.orientation(F.col("body"), [r"\b(the|le)\b"], [r"\b(of|de)\b", r"\bder\b"], [r"\b\w+(?:er|ing)\b"])
    return articles(spark, sf).select("article_id", F.array_join(o, ",").alias("orientation"))


@query("event_nature", f"WITH {ARTICLES}, x AS (SELECT article_id, {norm_sql('body')} AS t FROM articles) SELECT article_id, CASE WHEN regexp_matches(t, '\\b(the|der)\\b') THEN 'judicial' WHEN regexp_matches(t, '\\b(of|la)\\b') THEN 'macro' WHEN article_id % 3 = 0 THEN 'judicial' ELSE 'corporativo' END AS nature FROM x")
def q_nature(spark, sf):
    old = F.when(F.col("article_id") % 3 == 0, "regulatory").when(F.col("article_id") % 3 == 1, "earnings")
    return articles(spark, sf).select("article_id", score.event_nature(F.col("body"), old, [("judicial", r"\b(the|der)\b"), ("macro", r"\b(of|la)\b")]).alias("nature"))


_AROUSAL = " + ".join(f"CASE WHEN contains(t, '{w}') THEN {v!r}::DOUBLE ELSE 0 END" for w, v in WORDS.items())


@query("arousal", f"WITH {ARTICLES}, x AS (SELECT article_id, {norm_sql('body')} AS t FROM articles) SELECT article_id, {R(f'1 - exp(-({_AROUSAL}) / 1.5)')} AS arousal FROM x")
def q_arousal(spark, sf):
    return articles(spark, sf).select("article_id", r6(attention.arousal(F.col("body"), WORDS)).alias("arousal"))


@query("language_gate", "SELECT lang, count(*) AS n, lang IN ('portuguese', 'english', 'pt', 'en', 'pt-br', 'en-us', 'en-gb') OR coalesce(lang, '') = '' AS covered FROM documents GROUP BY lang")
def q_language(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n")).withColumn("covered", score.language_covered(F.col("lang")))


CODE_CHARS = 2000  #: queries whose SQL says so look for codes in so many first characters of a body


def _mentions(spark, sf, code_chars=CODE_CHARS):
    gaz = entity.gazetteer(entity.entities_from(spark, WATCH), [])
    return entity.link_mentions(articles(spark, sf), gaz, MARKET, NOISE, code_chars)


def _mention_sql(raw_body: str) -> str:
    names = [(t, i, a) for t, al in WATCH.items() for i, a in enumerate(al) if not (len(a) == 5 and a[:4].isupper() and a[4].isdigit())]
    codes = [(t, i, a) for t, al in WATCH.items() for i, a in enumerate(al) if len(a) == 5 and a[:4].isupper() and a[4].isdigit()]
    values = ", ".join(f"('{t}', {i}, '{a}', {str((t, i, a) in codes).lower()})" for t, i, a in names + codes)
    return rf"""mt AS (SELECT article_id, {norm_sql('title')} AS nt, {norm_sql('body')} AS nb, title AS rt, {raw_body} AS rb FROM articles), al(ticker, rank, alias, cased) AS (VALUES {values}),
mh AS (SELECT article_id, ticker, rank, alias, regexp_matches(CASE WHEN cased THEN rt ELSE nt END, CASE WHEN cased THEN '(^|[^A-Za-z0-9])' || alias || '([^A-Za-z0-9]|$)' ELSE '(^|[^a-z0-9])' || alias || '([^a-z0-9]|$)' END) AS it,
  regexp_matches(CASE WHEN cased THEN rb ELSE nb END, CASE WHEN cased THEN '(^|[^A-Za-z0-9])' || alias || '([^A-Za-z0-9]|$)' ELSE '(^|[^a-z0-9])' || alias || '([^a-z0-9]|$)' END) AS ib, string_split(trim(nt || ' ' || nb), ' ') AS toks FROM mt, al),
mb AS (SELECT article_id, ticker, arg_min((alias, it), rank) AS m, any_value(toks) AS toks FROM mh WHERE it OR ib GROUP BY ALL), mn AS (SELECT *, count(*) OVER (PARTITION BY article_id) AS n FROM mb),
mentions AS (SELECT article_id, ticker, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (0.2::DOUBLE + CASE WHEN m[2] THEN 0.35::DOUBLE ELSE 0 END + least(len(list_intersect(list_distinct(toks), {_strings(MARKET)})), 6) * 0.09::DOUBLE - len(list_intersect(list_distinct(toks), {_strings(NOISE)})) * 0.3::DOUBLE)
  * CASE WHEN n > 3 THEN 0.55::DOUBLE WHEN n = 3 THEN 0.75::DOUBLE ELSE 1 END)) AS relevance, m[1] AS matched_alias FROM mn)"""


MEN = _mention_sql(f"substr(body, 1, {CODE_CHARS})")
MEN_WHOLE = _mention_sql("body")


@query("mentions", f"""WITH {ARTICLES}, {MEN} SELECT article_id, ticker, {R('relevance')} AS relevance, matched_alias FROM mentions
UNION ALL SELECT article_id, '__none__', 0.0, NULL FROM articles WHERE article_id NOT IN (SELECT article_id FROM mentions)""")
def q_mentions(spark, sf):
    return _mentions(spark, sf).withColumn("relevance", r6("relevance"))


@query("pending_pairs", f"WITH {ARTICLES}, {MEN} SELECT article_id, ticker FROM mentions WHERE relevance >= 0.35::DOUBLE AND article_id % 4 <> 0")
def q_pending(spark, sf):
    done = articles(spark, sf).where("article_id % 4 = 0").select("article_id", F.explode(F.array(*[F.lit(t) for t in WATCH])).alias("ticker"), F.lit("lexicon").alias("scorer"))
    return score.pending_pairs(_mentions(spark, sf), done, "lexicon").select("article_id", "ticker")


@query("novelty", f"WITH RECURSIVE {CLUSTERED} SELECT article_id, {R('CASE WHEN cluster_id IS NULL THEN 1 ELSE 1 / sqrt(rank() OVER (PARTITION BY cluster_id ORDER BY ts)) END')} AS novelty, CASE WHEN cluster_id IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY cluster_id) END AS cluster_size FROM clustered")
def q_novelty(spark, sf):
    return dedupe.novelty(clustered(spark, sf).select("article_id", "cluster_id", "published_ts")).select("article_id", r6("novelty").alias("novelty"), "cluster_size")


@query("story_clusters")
def q_clusters(spark, sf):
    return dedupe.cluster(articles(spark, sf), 48)


@query("story_clusters_history")
def q_clusters_history(spark, sf):
    return dedupe.cluster_history(articles(spark, sf))


WEIGHTS = """ca AS (SELECT cluster_id, domain, ts FROM clustered WHERE cluster_id IS NOT NULL AND ts > (SELECT max(ts) FROM clustered) - 120 * 86400), cc AS (SELECT cluster_id, min(ts) AS first, median(ts) AS mid FROM ca GROUP BY cluster_id HAVING count(*) >= 2),
cd AS (SELECT cluster_id, domain, min(ts) AS ts FROM ca GROUP BY ALL), st AS (SELECT domain, count(*) AS n, count(*) FILTER (ts = first) AS scoops, median((mid - ts) / 60.0) AS lead_min FROM cd JOIN cc USING (cluster_id) GROUP BY domain),
sw AS (SELECT st.*, (scoops + 8 * g) / (n + 8) AS shrunk, g FROM st, (SELECT sum(scoops) / sum(n)::DOUBLE AS g FROM st)), weights AS (SELECT domain, n, scoops, lead_min, shrunk, greatest(0.15, least(1.0, 0.45 * CASE WHEN g > 0 THEN shrunk / g ELSE 1 END * (1 + greatest(-0.3, least(0.3, lead_min / 180.0))))) AS weight FROM sw)"""


def _weights(spark, sf, a=None):
    return sources_weight.fit_weights(sources_weight.cluster_stats(a if a is not None else clustered(spark, sf)))


@query("source_weights", f"WITH RECURSIVE {CLUSTERED}, {WEIGHTS} SELECT domain, n, scoops, {R('lead_min')} AS lead_min, {R('shrunk')} AS scoop_shrunk, round(weight, 4) AS weight FROM weights")
def q_weights(spark, sf):
    return _weights(spark, sf).select("domain", "n", "scoops", r6("lead_min").alias("lead_min"), r6("scoop_shrunk").alias("scoop_shrunk"), "weight")


@query("effective_sources", f"WITH RECURSIVE {CLUSTERED}, c AS (SELECT cluster_id, domain, count(*) AS c FROM clustered WHERE cluster_id IS NOT NULL GROUP BY ALL), p AS (SELECT cluster_id, c / sum(c) OVER (PARTITION BY cluster_id)::DOUBLE AS p FROM c) SELECT cluster_id, {R('exp(-sum(p * ln(p)))')} AS effective_sources FROM p GROUP BY cluster_id")
def q_effective(spark, sf):
    return attention.effective_sources(clustered(spark, sf).where("cluster_id is not null"), ["cluster_id"]).withColumn("effective_sources", r6("effective_sources"))


GRID = """grid AS (SELECT to_timestamp(1700000000 + k * 43200)::TIMESTAMP AS at_, 1700000000 + k * 43200 AS at_s FROM range(1, 61) t(k))"""


def _grid(spark, sf):
    """Instants every twelve hours over the articles' days: a parameter of the queries."""
    return spark.range(1, 61, 1, 1).select(F.timestamp_seconds(1_700_000_000 + F.col("id") * 43_200).alias("asof"))


@query("cluster_features", f"""WITH RECURSIVE {CLUSTERED}, x AS (SELECT cluster_id, ts, domain, {norm_sql('body')} AS t FROM clustered WHERE cluster_id IS NOT NULL), g AS (SELECT DISTINCT cluster_id, 1700000000 + k * 432000 AS a FROM x, range(1, 7) r(k)), j AS (SELECT x.*, a, min(ts) OVER (PARTITION BY x.cluster_id, a) AS t0 FROM x JOIN g ON x.cluster_id = g.cluster_id AND ts <= a),
dc AS (SELECT cluster_id, a, domain, count(*)::DOUBLE AS c, count(*) FILTER (ts - t0 <= 7200)::DOUBLE AS d FROM j GROUP BY ALL),
e AS (SELECT cluster_id, a, exp(ln(sum(c)) - sum(c * ln(c)) / sum(c)) AS e FROM dc GROUP BY ALL), f AS (SELECT cluster_id, a, exp(ln(sum(d)) - sum(d * ln(d)) / sum(d)) AS f FROM dc WHERE d > 0 GROUP BY ALL),
b AS (SELECT cluster_id, a, count(*) AS copies, (a - min(t0)) / 3600.0 AS h, max(1 - exp(-({_AROUSAL}) / 1.5)) AS m FROM j GROUP BY cluster_id, a)
SELECT cluster_id, a AS asof_s, {R('e')} AS effective_sources, {R('f')} AS cascade, copies, {R('1 - e / copies')} AS repetition, {R('h')} AS hours_alive, {R('m')} AS arousal FROM b JOIN e USING (cluster_id, a) JOIN f USING (cluster_id, a)""")
def q_cluster_features(spark, sf):
    a = clustered(spark, sf).where("cluster_id is not null").select("article_id", "cluster_id", "published_ts", "domain", attention.arousal(F.col("body"), WORDS).alias("arousal"))
    a = sinks.written(a, "attention")  # read many times, searched once
    g = a.select("cluster_id", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("k")).distinct().select("cluster_id", F.timestamp_seconds(1_700_000_000 + F.col("k") * 432_000).alias("asof"))
    f = attention.cluster_features(a, g)
    return f.select("cluster_id", F.unix_timestamp("asof").alias("asof_s"), "copies", *[r6(c).alias(c) for c in ("effective_sources", "cascade", "repetition", "hours_alive", "arousal")])


def _mention_times(spark, sf, a=None, code_chars=CODE_CHARS):
    a = articles(spark, sf) if a is None else a
    return _mentions(spark, sf, code_chars).where(F.col("ticker") != config.NOBODY).join(a.select("article_id", "published_ts", *[c for c in a.columns if c == "cluster_id"]), "article_id")


def _ticker_grid(spark, sf):
    t = F.explode(F.array(*[F.lit(x) for x in WATCH])).alias("ticker")
    return _grid(spark, sf).select(t, "asof")


@query("attention_burst", f"""WITH {ARTICLES}, {MEN}, {GRID}, m AS (SELECT ticker, ts FROM mentions JOIN articles USING (article_id)), g AS (SELECT ticker, at_s FROM grid, (VALUES {', '.join(f"('{t}')" for t in WATCH)}) t(ticker)),
j AS (SELECT g.ticker, at_s, count(ts) AS b, count(ts) FILTER (at_s - ts < 86400) AS w FROM g LEFT JOIN m ON m.ticker = g.ticker AND ts <= at_s AND at_s - ts < 30 * 86400 GROUP BY ALL)
SELECT ticker, at_s AS asof_s, {R('CASE WHEN b > 0 THEN (w / 24.0) / (b / 720.0) ELSE 0 END')} AS burst FROM j""")
def q_burst(spark, sf):
    return attention.burst(sinks.written(_mention_times(spark, sf), "mention-times"), _ticker_grid(spark, sf)).select("ticker", F.unix_timestamp("asof").alias("asof_s"), r6("burst").alias("burst"))


@query("attention_panel", f"""WITH RECURSIVE {CLUSTERED}, {MEN_WHOLE}, {GRID}, own AS (SELECT article_id, ts, domain, {norm_sql('body')} AS t, coalesce(cluster_id::VARCHAR, 'a' || article_id) AS cid FROM clustered), m AS (SELECT ticker, ts, cid FROM mentions JOIN own USING (article_id)),
g AS (SELECT ticker, at_s FROM grid, (VALUES {', '.join(f"('{t}')" for t in WATCH)}) t(ticker)), live AS (SELECT g.ticker, at_s, cid FROM m JOIN g ON g.ticker = m.ticker AND ts <= at_s AND at_s - ts < 129600), k AS (SELECT DISTINCT cid, at_s FROM live),
j AS (SELECT own.*, at_s, min(ts) OVER (PARTITION BY own.cid, at_s) AS t0 FROM own JOIN k ON own.cid = k.cid AND ts <= at_s), dc AS (SELECT cid, at_s, domain, count(*)::DOUBLE AS c, count(*) FILTER (ts - t0 <= 7200)::DOUBLE AS d FROM j GROUP BY ALL),
e AS (SELECT cid, at_s, exp(ln(sum(c)) - sum(c * ln(c)) / sum(c)) AS e FROM dc GROUP BY ALL), f AS (SELECT cid, at_s, exp(ln(sum(d)) - sum(d * ln(d)) / sum(d)) AS f FROM dc WHERE d > 0 GROUP BY ALL),
b AS (SELECT cid, at_s, count(*) AS copies, (at_s - min(t0)) / 3600.0 AS h, max(1 - exp(-({_AROUSAL}) / 1.5)) AS a FROM j GROUP BY cid, at_s),
p AS (SELECT ticker, at_s, max(f) AS f, max(e) AS e, max(1 - e / copies) AS r, max(a) AS a, sum(copies)::BIGINT AS copies, min(h) AS h, count(*) AS n FROM live JOIN b USING (cid, at_s) JOIN e USING (cid, at_s) JOIN f USING (cid, at_s) GROUP BY ALL),
bu AS (SELECT g.ticker, at_s, count(ts) AS b, count(ts) FILTER (at_s - ts < 86400) AS w FROM g LEFT JOIN m ON m.ticker = g.ticker AND ts <= at_s AND at_s - ts < 30 * 86400 GROUP BY ALL)
SELECT ticker, at_s AS asof_s, {R('CASE WHEN b > 0 THEN (w / 24.0) / (b / 720.0) ELSE 0 END')} AS burst, {R('f')} AS cascade, {R('e')} AS effective_sources, {R('r')} AS repetition, {R('a')} AS arousal, copies, {R('h')} AS hours_alive, coalesce(n, 0) AS n FROM bu LEFT JOIN p USING (ticker, at_s)""")
def q_panel(spark, sf):
    a = clustered(spark, sf).select("article_id", "cluster_id", "published_ts", "domain", attention.arousal(F.col("body"), WORDS).alias("arousal"))
    a = sinks.written(a, "attention")  # running sums read both many times, and texts would be searched each time
    p = attention.panel(sinks.written(_mention_times(spark, sf, a, None), "mention-times"), a, _ticker_grid(spark, sf))
    return p.select("ticker", F.unix_timestamp("asof").alias("asof_s"), "copies", "n", *[r6(c).alias(c) for c in ("burst", "cascade", "effective_sources", "repetition", "arousal", "hours_alive")])


def _evidence(spark, sf, a=None, code_chars=CODE_CHARS):
    a = clustered(spark, sf) if a is None else a
    nov = dedupe.novelty(a.select("article_id", "cluster_id", "published_ts")).select("article_id", "novelty")
    men = sinks.written(_mentions(spark, sf, code_chars).where(F.col("ticker") != config.NOBODY), "mentions")  # linked once, read twice
    routed = F.col("article_id") % 5 == 0
    men = men.withColumns({"driver": F.when(routed, "USDBRL"), "driver_weight": F.when(routed, 0.3), "driver_sign": F.when(routed, F.when(F.col("article_id") % 2 == 0, 1).otherwise(-1))})
    sc = sinks.written(_scored(spark, sf).select("article_id", "s", "magnitude", "event_type"), "scores")  # scored once, not once a joined row
    sc = sc.join(nov, "article_id").join(men.select("article_id", "ticker"), "article_id")
    return signal.evidence(sc, men, a)


EV = f"""{CLUSTERED}, {LEX}, {MEN}, {WEIGHTS}, {GRID}, nov AS (SELECT article_id, CASE WHEN cluster_id IS NULL THEN 1 ELSE 1 / sqrt(rank() OVER (PARTITION BY cluster_id ORDER BY ts)) END AS novelty FROM clustered),
ev AS (SELECT m.ticker, a.article_id, a.ts, round(s, 4) AS s, coalesce(round(w.weight, 4), 0.35) * relevance * novelty * round(magnitude, 4) AS w0, a.article_id % 5 = 0 AS routed FROM mentions m JOIN sc USING (article_id) JOIN nov USING (article_id) JOIN articles a USING (article_id) LEFT JOIN weights w ON w.domain = a.domain),
wev AS (SELECT e.ticker, at_s, article_id, routed, CASE WHEN routed AND article_id % 2 = 1 THEN -s ELSE s END AS s, w0 * pow(0.5, (at_s - ts) / 3600.0 / 8.0) * CASE WHEN routed THEN 0.3 ELSE 1 END AS w FROM ev e JOIN grid ON ts <= at_s AND at_s - ts < 129600),
we AS (SELECT * FROM wev WHERE w > 1e-6)"""


def _weighted(spark, sf, ev=None, a=None):
    a = clustered(spark, sf) if a is None else a
    return signal.evidence_asof(ev if ev is not None else _evidence(spark, sf, a), _ticker_grid(spark, sf), _weights(spark, sf, a))


@query("signals", f"""WITH RECURSIVE {EV}, z AS (SELECT ticker, at_s, sum(s * w) / sum(w) AS z, sum(w) AS n_eff, sum(s * s * w) AS ssw, sum(s * w) AS sw, count(*) AS n, count(*) FILTER (routed) AS r FROM we GROUP BY ALL)
SELECT ticker, at_s AS asof_s, round(z, 4) + 0.0 AS z, round(n_eff, 4) + 0.0 AS n_eff, round(sqrt(greatest((ssw - 2 * z * sw + z * z * n_eff) / n_eff, 0)), 4) + 0.0 AS dispersion, n AS n_articles, r AS n_routed FROM z""")
def q_signals(spark, sf, ev=None, a=None):
    s = signal.aggregate_signal(_weighted(spark, sf, ev, a))
    return s.select("ticker", F.unix_timestamp("asof").alias("asof_s"), "z", "n_eff", "dispersion", "n_articles", "n_routed")


@query("top_evidence", f"WITH RECURSIVE {EV}, k AS (SELECT ticker, at_s, article_id, row_number() OVER (PARTITION BY ticker, at_s ORDER BY w DESC, article_id) AS rank FROM we) SELECT ticker, at_s AS asof_s, article_id, rank FROM k WHERE rank <= 12")
def q_top(spark, sf):
    return signal.top_evidence(_weighted(spark, sf)).select("ticker", F.unix_timestamp("asof").alias("asof_s"), "article_id", F.col("rank").cast("long").alias("rank"))


@query("article_weights", f"WITH RECURSIVE {EV} SELECT ticker, article_id, {R('w0 + 1e-9')} AS weight FROM ev")  # a nudge, so that halves of the last place round alike
def q_article_weights(spark, sf):
    a = clustered(spark, sf)
    return signal.article_weights(_evidence(spark, sf, a), _weights(spark, sf, a)).select("ticker", "article_id", r6(F.col("weight") + 1e-9).alias("weight"))


HISTORY = EV.replace(GRID, """grid AS (SELECT epoch(d)::BIGINT + 72000 AS at_s FROM (SELECT DISTINCT CAST(to_timestamp(ts - 10800) AT TIME ZONE 'UTC' AS DATE) AS d FROM mentions JOIN articles USING (article_id)) WHERE isodow(d) <= 5)""")


@query("signals_history", f"""WITH RECURSIVE {HISTORY}, z AS (SELECT ticker, at_s, sum(s * w) / sum(w) AS z, sum(w) AS n_eff, sum(s * s * w) AS ssw, sum(s * w) AS sw, count(*) AS n, count(*) FILTER (routed) AS r FROM we GROUP BY ALL)
SELECT ticker, at_s AS asof_s, round(z, 4) + 0.0 AS z, round(n_eff, 4) + 0.0 AS n_eff, round(sqrt(greatest((ssw - 2 * z * sw + z * z * n_eff) / n_eff, 0)), 4) + 0.0 AS dispersion, n AS n_articles, r AS n_routed FROM z""")
def q_history(spark, sf):
    a = clustered(spark, sf)
    ev = sinks.written(_evidence(spark, sf, a), "evidence")
    days = articles(spark, sf).select(timeutil.local_date(F.col("published_ts")).alias("date")).distinct().where(F.dayofweek("date").between(2, 6))
    s = signal.rebuild_history(ev, days.select(F.explode(F.array(*[F.lit(t) for t in WATCH])).alias("ticker"), "date"), _weights(spark, sf, a))
    return s.select("ticker", F.unix_timestamp("asof").alias("asof_s"), "z", "n_eff", "dispersion", "n_articles", "n_routed")


MACRO = f"""mood AS (SELECT ticker, domain AS indicator, CAST(to_timestamp(ts) AT TIME ZONE 'UTC' AS DATE) AS rel, (count(*) FILTER (lang = 'en') - 2 * count(*) FILTER (lang = 'de')) * 1.5::DOUBLE / count(*) AS imp FROM articles, (VALUES {', '.join(f"('{t}')" for t in WATCH)}) t(ticker) GROUP BY ALL),
latest AS (SELECT g.ticker, at_s, indicator, max(rel) AS rel, arg_max(imp, rel) AS imp FROM (SELECT * FROM grid, (VALUES {', '.join(f"('{t}')" for t in WATCH)}) t(ticker)) g JOIN mood e ON e.ticker = g.ticker AND rel <= CAST((to_timestamp(at_s - 10800) AT TIME ZONE 'UTC') AS DATE) GROUP BY ALL),
faded AS (SELECT ticker, at_s, 0.12 * pow(0.5, greatest(0, CAST((to_timestamp(at_s - 10800) AT TIME ZONE 'UTC') AS DATE) - rel) / 10.0) AS w, greatest(-1, least(1, imp)) AS c FROM latest),
macro AS (SELECT ticker, at_s, sum(c * w) AS mc, sum(w) AS mw FROM faded GROUP BY ALL)"""


def _macro(spark, sf):
    """What the releases of each domain, one a day, add to every entity at each instant."""
    mood = (F.count_if(F.col("lang") == "en") - 2 * F.count_if(F.col("lang") == "de")) * 1.5 / F.count("*")
    e = articles(spark, sf).groupBy(F.col("domain").alias("indicator"), F.to_date("published_ts").alias("release_date")).agg(mood.alias("implied_pp"))
    e = e.select(F.explode(F.array(*[F.lit(t) for t in WATCH])).alias("ticker"), "indicator", "implied_pp", "release_date")
    return signal.macro_surprise(e, _ticker_grid(spark, sf))


@query("macro_contribution", f"WITH {ARTICLES}, {GRID}, {MACRO} SELECT ticker, at_s AS asof_s, round(mc, 6) + 0.0 AS contribution, round(mw, 6) + 0.0 AS weight FROM macro")
def q_macro(spark, sf):
    return _macro(spark, sf).select("ticker", F.unix_timestamp("asof").alias("asof_s"), r6("contribution").alias("contribution"), r6("weight").alias("weight"))


@query("signals_with_macro", f"""WITH RECURSIVE {EV.replace(MEN, MEN_WHOLE)}, {MACRO}, e AS (SELECT ticker, at_s, sum(s * w) AS sw, sum(w) AS w, sum(s * s * w) AS ssw, count(*) AS n FROM we GROUP BY ALL),
k AS (SELECT e.*, coalesce(mc, 0) AS mc, coalesce(mw, 0) AS mw, CASE WHEN coalesce(mw, 0) > w * {config.SURPRISE_CAP} / (1 - {config.SURPRISE_CAP}::DOUBLE) THEN w * {config.SURPRISE_CAP} / (1 - {config.SURPRISE_CAP}::DOUBLE) / mw ELSE 1 END AS k FROM e LEFT JOIN macro USING (ticker, at_s)),
z AS (SELECT *, (sw + mc * k) / (w + mw * k) AS z, w + mw * k AS den FROM k)
SELECT ticker, at_s AS asof_s, round(z, 4) + 0.0 AS z, round(den, 4) + 0.0 AS n_eff, round(sqrt(greatest((ssw - 2 * z * sw + z * z * w) / den, 0)), 4) + 0.0 AS dispersion, n AS n_articles, k < 1 AS capped FROM z""")
def q_signals_macro(spark, sf):
    """Signals with releases in them, whose share is capped; capped tells where that was so."""
    a = clustered(spark, sf)
    w, m = sinks.written(_weighted(spark, sf, _evidence(spark, sf, a, None), a), "weighted"), sinks.written(_macro(spark, sf), "macro")
    s = signal.aggregate_signal(w, m)
    full = w.groupBy("ticker", "asof").agg(F.sum("w").alias("w_")).join(m, ["ticker", "asof"], "left")
    over = full.select("ticker", "asof", (F.coalesce("weight", F.lit(0.0)) > F.col("w_") * config.SURPRISE_CAP / (1 - config.SURPRISE_CAP)).alias("capped"))
    return s.join(over, ["ticker", "asof"]).select("ticker", F.unix_timestamp("asof").alias("asof_s"), "z", "n_eff", "dispersion", "n_articles", "capped")


TOPICS = [("USDBRL", "the of"), ("USDBRL", "onre"), ("BRENT", "de la"), ("GAS", "und die"), ("setor:banks", "que la")]


@query("route_articles", f"""WITH {ARTICLES}, x AS (SELECT article_id, domain, {norm_sql("title || ' ' || body")} AS t FROM articles), terms(topic, term) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in TOPICS)}), l(topic, ticker, weight, sign, layer, o) AS (VALUES ('USDBRL', 'AAAA3', 0.4, 1, 'driver', 2), ('USDBRL', 'BBBB4', 0.2, -1, 'driver', 2), ('BRENT', 'AAAA3', 0.3, -1, 'driver', 2), ('setor:banks', 'BBBB4', 0.35, 1, 'sector', 3), ('GAS', 'CCCC1', 0.7, 1, 'driver', 2)),
h AS (SELECT DISTINCT article_id, domain, topic FROM x JOIN terms ON regexp_matches(t, '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)')), j AS (SELECT article_id, ticker, topic, weight, sign, row_number() OVER (PARTITION BY article_id, ticker ORDER BY o, weight DESC, topic) AS k FROM h JOIN l USING (topic))
SELECT article_id, ticker, round(least(1.0, 0.4 + weight), 6) AS relevance, 'driver:' || topic AS matched_alias, CAST(weight AS DOUBLE) AS driver_weight, sign AS driver_sign FROM j WHERE k = 1""")
def q_route(spark, sf):
    terms = spark.createDataFrame(TOPICS, "topic string, term string")
    lis = spark.createDataFrame([("USDBRL", "AAAA3", 0.4, 1, "driver"), ("USDBRL", "BBBB4", 0.2, -1, "driver"), ("BRENT", "AAAA3", 0.3, -1, "driver"), ("setor:banks", "BBBB4", 0.35, 1, "sector"), ("GAS", "CCCC1", 0.7, 1, "driver")], "topic string, ticker string, weight double, sign int, layer string")
    m = routing.routed_mentions(routing.route_articles(articles(spark, sf), lis, terms))
    return m.select("article_id", "ticker", r6("relevance").alias("relevance"), "matched_alias", "driver_weight", "driver_sign")


SECTORS = {"AAAA3": "banks", "BBBB4": "banks", "CCCC1": "mines", "DDDD2": None}
EFFECTS = [("heat", "AAAA3", 1), ("heat", "CCCC1", -1), ("rain", "BBBB4", -1), ("rain", "DDDD2", 0)]
LAYER_TOPICS = [("USDBRL", "the of"), ("setor:banks", "que la"), ("setor:mines", "und die"), ("tema:heat", "de la"), ("tema:rain", "of the"), ("tema:rain", "to the")]
_LISTENERS = [("USDBRL", "AAAA3", 0.4, 1, "driver", 2), ("USDBRL", "CCCC1", 0.2, -1, "driver", 2), *[("setor:" + x, t, config.SECTOR_WEIGHT, 1, "sector", 3) for t, x in SECTORS.items() if x], *[("tema:" + h, t, config.THEME_WEIGHT, e, "theme", 4) for h, t, e in EFFECTS if e]]


@query("route_layers", f"""WITH {ARTICLES}, x AS (SELECT article_id, {norm_sql("title || ' ' || body")} AS t FROM articles), terms(topic, term) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in LAYER_TOPICS)}), l(topic, ticker, weight, sign, layer, o) AS (VALUES {', '.join(str(v) for v in _LISTENERS)}),
h AS (SELECT DISTINCT article_id, topic FROM x JOIN terms ON regexp_matches(t, '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)')), j AS (SELECT article_id, ticker, topic, weight, sign, layer, row_number() OVER (PARTITION BY article_id, ticker ORDER BY o, weight DESC, topic) AS k FROM h JOIN l USING (topic))
SELECT article_id, ticker, topic AS driver, layer, CAST(weight AS DOUBLE) AS weight, sign FROM j WHERE k = 1""")
def q_layers(spark, sf):
    """Articles to entities through drivers, sectors and themes; of several ways the first layer counts."""
    terms = spark.createDataFrame(LAYER_TOPICS, "topic string, term string")
    drivers = spark.createDataFrame([v[:5] for v in _LISTENERS if v[4] == "driver"], "topic string, ticker string, weight double, sign int, layer string")
    sectors = routing.sector_listeners(spark.createDataFrame(list(SECTORS.items()), "ticker string, sector string"))
    themes = routing.theme_listeners(spark.createDataFrame(EFFECTS, "theme string, ticker string, effect int"))
    hits = routing.route_articles(articles(spark, sf), drivers.unionByName(sectors).unionByName(themes), terms)
    return routing.union_layers(hits).select("article_id", "ticker", "driver", "layer", "weight", "sign")


def _score_labels(spark, sf):
    """Signals and outcomes: the lexicon's score against the documents' labels."""
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("article_id"), (F.col("quality") - 2 * F.col("toxic")).alias("q"))
    j = _scored(spark, sf).join(lab, "article_id")
    return sinks.written(j.select("article_id", F.col("s").alias("z"), F.when(F.col("q") > 0, 1).when(F.col("q") < 0, -1).otherwise(0).alias("cls"), ((F.col("article_id") % 80) / 10.0).alias("n_eff")), "score-labels")


ZL = f"{ARTICLES}, {LEX}, zl AS (SELECT article_id, s AS z, CASE WHEN quality - 2 * toxic > 0 THEN 1 WHEN quality - 2 * toxic < 0 THEN -1 ELSE 0 END AS cls, (article_id % 80) / 10.0 AS n_eff FROM sc JOIN labels ON doc_id = article_id)"


@query("probabilities", f"""WITH {ZL}, p AS (SELECT *, n_eff / (n_eff + 2) AS w, 1 / (1 + exp(-(0.8 * z + 0.4))) AS pu, 1 / (1 + exp(-(0.5 * -z - 1.6))) AS pd FROM zl), q AS (SELECT article_id, w * pu + (1 - w) * 0.6 AS u, w * pd + (1 - w) * 0.15 AS d FROM p)
SELECT article_id, round(u / greatest(1, u + d), 4) AS p_up, round(d / greatest(1, u + d), 4) AS p_down, round(greatest(0, 1 - u / greatest(1, u + d) - d / greatest(1, u + d)), 4) + 0.0 AS p_flat FROM q""")
def q_probabilities(spark, sf):
    s = _score_labels(spark, sf).withColumns({"base_up": F.lit(0.6), "base_flat": F.lit(0.25), "base_down": F.lit(0.15)})
    fit = calibrate.Direction("platt", 1000, True, up=(0.8, 0.4), down=(0.5, -1.6))
    return calibrate.probabilities(s, fit).select("article_id", "p_up", "p_down", "p_flat")


@query("calibration")
def q_calibration(spark, sf):
    s = _score_labels(spark, sf)
    out = [(m, k, float(v)) for m in ("platt", "isotonic") for k, v in calibrate.fit_direction(s, m).metrics.items()]
    return spark.createDataFrame(out, "method string, metric string, value double")


@query("isotonic_fit")
def q_isotonic(spark, sf):
    s = _score_labels(spark, sf).withColumn("y", (F.col("cls") == 1).cast("int"))
    return s.select("article_id", "z", calibrate.predict_isotonic(F.col("z"), calibrate.fit_isotonic(s, "z", "y")).alias("p"))


@query("metalabel")
def q_metalabel(spark, sf):
    s = _score_labels(spark, sf).withColumns({"vol_pred": F.col("article_id") % 7 / 7.0, "vol_real": F.col("article_id") % 5 / 5.0, "dispersion": F.col("article_id") % 3 / 3.0, "right": (F.signum("z") == F.col("cls")).cast("int")})
    m = models.metalabel_fit(s, least=1)
    return models.metalabel_gate(s, m).select("article_id", "meta_p", "take")


@query("auc", f"""WITH {ZL}, r AS (SELECT cls, rank() OVER (ORDER BY z) + (count(*) OVER (PARTITION BY z) - 1) / 2.0 AS r FROM zl), a AS (SELECT count(*) FILTER (cls = 1)::DOUBLE AS n1, count(*) FILTER (cls <> 1)::DOUBLE AS n0, sum(r) FILTER (cls = 1) AS s FROM r), b AS (SELECT *, (s - n1 * (n1 + 1) / 2) / (n1 * n0) AS v FROM a),
c AS (SELECT *, sqrt((v * (1 - v) + (n1 - 1) * (v / (2 - v) - v * v) + (n0 - 1) * (2 * v * v / (1 + v) - v * v)) / (n1 * n0)) AS se FROM b) SELECT n1::BIGINT AS n_pos, n0::BIGINT AS n_neg, {R('v')} AS auc, {R('v - 1.96 * se')} AS lo, {R('v + 1.96 * se')} AS hi FROM c""")
def q_auc(spark, sf):
    a = stats.auc(_score_labels(spark, sf).withColumn("y", (F.col("cls") == 1).cast("int")), "z", "y")
    return a.select("n_pos", "n_neg", *[r6(c).alias(c) for c in ("auc", "lo", "hi")])


@query("brier_skill", f"WITH {ZL}, p AS (SELECT 1 / (1 + exp(-z)) AS p, (cls = 1)::INT AS y FROM zl), b AS (SELECT count(*) AS n, avg(pow(p - y, 2)) AS br, avg(pow(0.7 - y, 2)) AS ba FROM p) SELECT n, {R('br')} AS brier, {R('ba')} AS brier_base, {R('1 - br / ba')} AS skill FROM b")
def q_brier(spark, sf):
    s = _score_labels(spark, sf).select((1 / (1 + F.exp(-F.col("z")))).alias("p"), (F.col("cls") == 1).cast("int").alias("y"), F.lit(0.7).alias("base"))
    return stats.brier_skill(s, "p", "y", "base").select("n", *[r6(c).alias(c) for c in ("brier", "brier_base", "skill")])


@query("reliability", f"""WITH {ZL}, e AS (SELECT quantile_cont(z, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM zl), b AS (SELECT len(list_filter(e, lambda x: x < z)) AS bin, z, (cls = 1)::INT AS y FROM zl, e), g AS (SELECT bin, count(*) AS n, avg(z) AS p_mean, avg(y) AS rate FROM b GROUP BY bin)
SELECT bin::INT AS bin, n, {R('p_mean + 1e-9')} AS p_mean, {R('rate')} AS rate, {R('((rate + 3.8416 / (2 * n)) / (1 + 3.8416 / n)) - 1.96 * sqrt(rate * (1 - rate) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)')} AS lo FROM g""")
def q_reliability(spark, sf):
    s = _score_labels(spark, sf).withColumn("y", (F.col("cls") == 1).cast("int"))
    return evaluate.reliability(s, "z", "y").select("bin", "n", r6(F.col("p_mean") + 1e-9).alias("p_mean"), r6("rate").alias("rate"), r6("lo").alias("lo"))  # a nudge: means of forty four-place scores end in halves


@query("calibration_error", f"""WITH {ZL}, e AS (SELECT quantile_cont(z, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM zl), b AS (SELECT len(list_filter(e, lambda x: x < z)) AS bin, z, (cls = 1)::INT AS y FROM zl, e), g AS (SELECT bin, count(*) AS n, avg(z) AS p_mean, avg(y) AS rate FROM b GROUP BY bin)
SELECT {R('sum(n * abs(p_mean - rate)) / sum(n)')} AS ece FROM g WHERE n >= 20""")
def q_ece(spark, sf):
    s = _score_labels(spark, sf).withColumn("y", (F.col("cls") == 1).cast("int"))
    return evaluate.ece(evaluate.reliability(s, "z", "y")).select(r6("ece").alias("ece"))


@query("top_precision", f"""WITH {ZL}, c AS (SELECT quantile_cont(z, [0.95, 0.9, 0.8, 0.5]) AS q, avg((cls = 1)::INT) AS base FROM zl), s AS (SELECT unnest([0.05::DOUBLE, 0.1, 0.2, 0.5]) AS share, unnest(q) AS cut, base FROM c)
SELECT share, {R('cut')} AS cut, count(*) AS n, {R('avg((cls = 1)::INT)')} AS precision, {R('base')} AS base FROM zl JOIN s ON z >= cut GROUP BY share, cut, base""")
def q_top_precision(spark, sf):
    s = _score_labels(spark, sf).withColumn("y", (F.col("cls") == 1).cast("int"))
    return evaluate.top_precision(s, "z", "y").select("share", "n", *[r6(c).alias(c) for c in ("cut", "precision", "base")])


@query("hit_rate", f"WITH {ZL} SELECT count(*) AS n, {R('avg((sign(z) = cls)::INT)')} AS hit_rate FROM zl WHERE abs(z) > 0.4 AND cls <> 0")
def q_hits(spark, sf):
    return evaluate.hit_rate(_score_labels(spark, sf), "z", "cls").withColumn("hit_rate", r6("hit_rate"))


@query("decile_table", f"""WITH {ZL}, r AS (SELECT z, cls, rank() OVER (ORDER BY z) + (count(*) OVER (PARTITION BY z) - 1) / 2.0 AS r, count(*) OVER () AS n FROM zl), b AS (SELECT least(floor((ceil(r) - 1) / greatest(1, n // 10)), 9)::INT AS bucket, z, cls FROM r)
SELECT bucket, count(*) AS n, {R('avg(z) + 1e-9')} AS mean_z, {R('avg(cls / 2.0)')} AS mean_car_sigma FROM b GROUP BY bucket""")
def q_deciles(spark, sf):
    d = _score_labels(spark, sf).withColumn("two", F.lit(2.0))
    return evaluate.decile_table(d, "z", "cls", "two").select("bucket", "n", r6(F.col("mean_z") + 1e-9).alias("mean_z"), r6("mean_car_sigma").alias("mean_car_sigma"))


@query("threshold_sweep", f"WITH {ZL}, t AS (SELECT unnest([0.0::DOUBLE, 0.2, 0.4]) AS threshold), g AS (SELECT threshold, count(*) AS a, count(*) FILTER (z >= threshold) AS n, avg((cls = 1)::INT) FILTER (z >= threshold) AS acc FROM zl, t GROUP BY threshold) SELECT threshold, n, {R('n / a::DOUBLE')} AS coverage, {R('acc')} AS accuracy, {R('sqrt(acc * (1 - acc) / n)')} AS se FROM g")
def q_sweep(spark, sf):
    s = _score_labels(spark, sf).withColumn("right", (F.col("cls") == 1).cast("int"))
    return evaluate.threshold_sweep(s, [0.0, 0.2, 0.4], "z").select("threshold", "n", *[r6(c).alias(c) for c in ("coverage", "accuracy", "se")])


@query("permutation_ic")
def q_permutation(spark, sf):
    return evaluate.permutation_ic(_score_labels(spark, sf), "z", "cls", 50)


@query("walk_forward")
def q_walk_forward(spark, sf):
    s = _score_labels(spark, sf).join(articles(spark, sf).select("article_id", F.col("published_ts").alias("asof")), "article_id")
    return evaluate.walk_forward(s, embargo_days=1, min_train=20).groupBy("fold", "role").count()


@query("scorer_accuracy", f"""WITH {ARTICLES}, {LEX}, x AS (SELECT article_id, {norm_sql('body')} AS t FROM articles), g AS (SELECT article_id, CASE WHEN regexp_matches(t, '\\bthe\\b') THEN 'en' WHEN regexp_matches(t, '\\bla\\b') THEN 'rom' WHEN regexp_matches(t, '\\bder\\b') THEN 'de' END AS rule, CASE WHEN regexp_matches(t, '\\bthe\\b') THEN 1 WHEN regexp_matches(t, '\\bla\\b') THEN -1 ELSE 0 END AS gold FROM x)
SELECT rule, count(*) AS n, {R('avg((CASE WHEN gold = 0 THEN abs(s) < 0.15 ELSE sign(s) = gold AND abs(s) >= 0.05 END)::INT)')} AS accuracy FROM g JOIN sc USING (article_id) WHERE rule IS NOT NULL GROUP BY rule""")
def q_gold(spark, sf):
    g = evaluate.gold_labels(_scored(spark, sf), [("en", r"\bthe\b", 1), ("rom", r"\bla\b", -1), ("de", r"\bder\b", 0)], "body")
    return evaluate.scorer_accuracy(g).withColumn("accuracy", r6("accuracy"))


KINDS = ("click", "view", "purchase", "signup", "error")  #: the types of events, standing for entities
_KIND = f"[{', '.join(repr(k) for k in KINDS)}][article_id % 5 + 1]"


@query("event_study", f"""WITH {ARTICLES}, {LEX}, {BARS}, b AS (SELECT symbol, ts, close / lag(close) OVER w - 1 AS ret, epoch(ts) - epoch(lag(ts) OVER w) AS gap, lag(close) OVER w AS p FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)), r AS (SELECT symbol, ts, ret FROM b WHERE gap <= 14400 AND p <> 0),
m AS (SELECT ts, avg(ret) AS m FROM r GROUP BY ts HAVING count(*) >= 3), e AS (SELECT symbol AS ticker, epoch(ts) AS ts, ret - m AS res FROM r JOIN m USING (ts)),
c AS (SELECT ticker, ts, {', '.join(f"CASE WHEN count(res) OVER w{k} = {k} THEN sum(res) OVER w{k} END AS c{k}" for k in (1, 5, 15))} FROM e WINDOW {', '.join(f"w{k} AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING)" for k in (1, 5, 15))}),
n AS (SELECT {_KIND} AS ticker, (SELECT min(ts) FROM e) + ts - 1700000000 AS ts, s * magnitude AS strength FROM sc JOIN articles USING (article_id)), j AS (SELECT n.ticker, c.ts, strength, c1, c5, c15 FROM n ASOF JOIN c ON n.ticker = c.ticker AND n.ts < c.ts),
x AS (SELECT ticker, ts, round(avg(strength), 9) AS strength, count(*) AS m, first(c1) AS c1, first(c5) AS c5, first(c15) AS c15 FROM j GROUP BY ticker, ts),
y AS ({' UNION ALL '.join(f"SELECT {k} AS k, strength, m, c{k} AS c FROM x WHERE c{k} IS NOT NULL" for k in (1, 5, 15))}),
z AS (SELECT *, rank() OVER (PARTITION BY k ORDER BY strength) + (count(*) OVER (PARTITION BY k, strength) - 1) / 2.0 AS a, rank() OVER (PARTITION BY k ORDER BY c) + (count(*) OVER (PARTITION BY k, c) - 1) / 2.0 AS b FROM y)
SELECT k AS window, sum(m)::BIGINT AS n_events, count(*) AS n_cells, {R('corr(a, b)')} AS ic, {R('avg((sign(strength) = sign(c))::INT) FILTER (strength <> 0 AND c <> 0)')} AS hit_rate FROM z GROUP BY k""")
def q_event_study(spark, sf):
    from ..operators import panel

    res = panel.cross_sectional_residual(panel.bar_returns(bars(spark, sf)), "ret", "ts").select(F.col("symbol").alias("ticker"), "ts", "residual")
    start = res.agg(F.min("ts").alias("t0"))
    news = _scored(spark, sf).join(F.broadcast(start)).select(_kind(), F.timestamp_seconds(F.unix_timestamp("t0") + F.unix_timestamp("published_ts") - 1_700_000_000).alias("published_ts"), (F.col("s") * F.col("magnitude")).alias("strength"))
    names = res.select("ticker").distinct()
    return evaluate.event_study(news.join(names, "ticker", "left_semi"), res, (1, 5, 15)).withColumns({c: r6(c) for c in ("ic", "hit_rate")})


def _kind():
    return F.element_at(F.array(*[F.lit(x) for x in KINDS]), (F.col("article_id") % 5 + 1).cast("int")).alias("ticker")


@query("weighting_schemes", f"""WITH RECURSIVE {CLUSTERED}, {LEX}, {WEIGHTS}, nov AS (SELECT article_id, CASE WHEN cluster_id IS NULL THEN 1 ELSE 1 / sqrt(rank() OVER (PARTITION BY cluster_id ORDER BY ts)) END AS novelty FROM clustered),
d AS (SELECT event_type AS ticker, ts::DATE AS date, sum(CAST(round(value * 1000) AS BIGINT))::DOUBLE / count(*) / 1000.0 AS close FROM events GROUP BY ALL), r AS (SELECT ticker, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM d), m AS (SELECT date, avg(ret) AS m FROM r WHERE ret IS NOT NULL GROUP BY date HAVING count(*) >= 3),
t AS (SELECT ticker, date, lead(ret - m) OVER (PARTITION BY ticker ORDER BY date) AS y FROM r JOIN m USING (date) WHERE ret IS NOT NULL),
n AS (SELECT {_KIND} AS ticker, (SELECT min(date) FROM d) + ((ts - 1700000000) // 86400)::INT AS date, s, novelty, coalesce(round(w.weight, 4), 0.35) AS sw FROM sc JOIN clustered USING (article_id) JOIN nov USING (article_id) LEFT JOIN weights w USING (domain)),
x AS (SELECT 'equal' AS scheme, ticker, date, s, 1.0::DOUBLE AS w FROM n UNION ALL SELECT 'novelty', ticker, date, s, novelty FROM n UNION ALL SELECT 'sources', ticker, date, s, sw FROM n UNION ALL SELECT 'both', ticker, date, s, novelty * sw FROM n),
z AS (SELECT scheme, ticker, date, round(sum(s * w) / sum(w), 9) AS z FROM x WHERE w > 0 GROUP BY ALL), j AS (SELECT scheme, z, y FROM z JOIN t USING (ticker, date) WHERE y IS NOT NULL),
k AS (SELECT scheme, rank() OVER (PARTITION BY scheme ORDER BY z) + (count(*) OVER (PARTITION BY scheme, z) - 1) / 2.0 AS a, rank() OVER (PARTITION BY scheme ORDER BY y) + (count(*) OVER (PARTITION BY scheme, y) - 1) / 2.0 AS b FROM j)
SELECT scheme, count(*) AS n, {R('corr(a, b)')} AS ic FROM k GROUP BY scheme""")
def q_schemes(spark, sf):
    from ..operators import panel

    e = table(spark, sf, "events")
    daily = e.groupBy(F.col("event_type").alias("ticker"), F.to_date("ts").alias("date")).agg((F.sum(F.round(F.col("value") * 1000).cast("long")).cast("double") / F.count("*") / 1000.0).alias("close"))
    res = panel.cross_sectional_residual(panel.returns(daily))
    target = res.select("ticker", "date", F.lead("residual").over(Window.partitionBy("ticker").orderBy("date")).alias("next_abn"))
    a = clustered(spark, sf)
    nov = dedupe.novelty(a.select("article_id", "cluster_id", "published_ts")).select("article_id", "novelty")
    days = F.floor((F.unix_timestamp("published_ts") - 1_700_000_000) / 86_400).cast("int")
    news = _scored(spark, sf, a).join(nov, "article_id").join(_weights(spark, sf, a).select("domain", "weight"), "domain", "left").join(F.broadcast(daily.agg(F.min("date").alias("d0"))))
    rows = news.select(_kind(), F.date_add("d0", days).alias("date"), "s", "novelty", F.coalesce("weight", F.lit(config.DEFAULT_SOURCE_WEIGHT)).alias("sw"))
    schemes = {"equal": F.lit(1.0), "novelty": F.col("novelty"), "sources": F.col("sw"), "both": F.col("novelty") * F.col("sw")}
    return evaluate.weighting_schemes(rows, target, schemes).withColumn("ic", r6("ic"))


@query("alarms", f"""WITH RECURSIVE {EV}, z AS (SELECT ticker, at_s, round(sum(s * w) / sum(w), 4) + 0.0 AS z, round(sum(w), 4) AS n_eff FROM we GROUP BY ALL), s AS (SELECT *, 1 / (1 + exp(-z)) AS pu, 1 / (1 + exp(z)) AS pd FROM z),
f AS (SELECT DISTINCT e.ticker, at_s FROM ev e JOIN nov USING (article_id) JOIN grid ON ts <= at_s AND at_s - ts < 129600 WHERE novelty >= 0.95), x AS (SELECT ticker, at_s, 'up' AS direction, pu AS p FROM s UNION ALL SELECT ticker, at_s, 'down', pd FROM s), r(ticker, e, n, d) AS (VALUES ('AAAA3', 0.02, 0.1, 'both'), ('BBBB4', 0.01, 0.05, 'down'), ('CCCC1', 0.12, 0.05, 'both'), ('DDDD2', 0.12, 0.05, 'both'))
SELECT x.ticker, x.at_s AS asof_s, direction, round(p - 0.45, 6) AS edge FROM x JOIN s USING (ticker, at_s) JOIN r ON r.ticker = x.ticker JOIN f ON f.ticker = x.ticker AND f.at_s = x.at_s WHERE n_eff >= n AND d IN ('both', direction) AND p - 0.45 >= e""")
def q_alarms(spark, sf):
    return _alarms(spark, sf).select("ticker", F.unix_timestamp("asof").alias("asof_s"), "direction", r6("edge").alias("edge"))


def _alarms(spark, sf):
    a = clustered(spark, sf)
    ev = sinks.written(_evidence(spark, sf, a), "evidence")
    s = q_signals(spark, sf, ev, a)
    s = s.select("ticker", F.timestamp_seconds("asof_s").alias("asof"), "z", "n_eff", (1 / (1 + F.exp(-F.col("z")))).alias("p_up"), (1 / (1 + F.exp(F.col("z")))).alias("p_down"), F.lit(0.45).alias("base_up"), F.lit(0.45).alias("base_down"), F.lit(1).alias("calibrated"))
    rules = spark.createDataFrame([("AAAA3", 0.02, 0.1, 90, None, None, None), ("BBBB4", 0.01, 0.05, None, None, True, "down"), ("*", None, 0.05, None, None, None, None)], "ticker string, min_edge double, min_n_eff double, cooldown_min int, require_calibrated boolean, require_novelty boolean, direction string")
    return alarms.candidates(s, alarms.resolve_rules(s.select("ticker"), rules), ev.select("ticker", "published_ts", "novelty"))


@query("alarm_cooldown")
def q_cooldown(spark, sf):
    return alarms.cooldown(_alarms(spark, sf).withColumn("cooldown_min", F.lit(2000))).select("ticker", F.unix_timestamp("asof").alias("asof_s"), "direction")


@query("offsets", f"""WITH {ARTICLES}, l AS (SELECT domain, its - ts + CASE WHEN domain LIKE '%1' THEN -10800 WHEN domain LIKE '%2' THEN 3600 ELSE 0 END AS lag FROM articles), s AS (SELECT domain, list_sort(list(lag)) AS l FROM l GROUP BY domain HAVING count(*) >= 12), p AS (SELECT domain, len(l) AS n, l[CAST(floor(0.1 * (len(l) - 1)) AS INT) + 1] AS p10_s FROM s)
SELECT domain, n, p10_s, CASE WHEN NOT (abs(p10_s / 3600.0 - round(p10_s / 3600.0)) <= 0.25 AND round(p10_s / 3600.0) <> 0) THEN 'ok' WHEN p10_s < -600 THEN 'wrong' WHEN abs(p10_s / 3600.0) >= 0.75 THEN 'suspicion' ELSE 'ok' END AS verdict FROM p""")
def q_offsets(spark, sf):
    shift = F.when(F.col("domain").endswith("1"), -10800).when(F.col("domain").endswith("2"), 3600).otherwise(0)
    a = articles(spark, sf).withColumn("ingested_ts", F.timestamp_seconds(F.unix_timestamp("ingested_ts") + shift))
    return timeutil.diagnose_offsets(a).select("domain", "n", "p10_s", "verdict")


@query("applied_offsets", f"""WITH {ARTICLES}, l AS (SELECT article_id, domain, ts, its - ts + CASE WHEN domain LIKE '%1' THEN -10800 WHEN domain LIKE '%2' THEN 3600 ELSE 0 END AS lag FROM articles), s AS (SELECT domain, list_sort(list(lag)) AS l FROM l GROUP BY domain HAVING count(*) >= 12), p AS (SELECT domain, l[CAST(floor(0.1 * (len(l) - 1)) AS INT) + 1] / 3600.0 AS h FROM s)
SELECT article_id, ts + CASE WHEN abs(h - round(h)) <= 0.25 AND round(h) <> 0 AND h * 3600 < -600 THEN round(h)::BIGINT * 3600 ELSE 0 END AS ts FROM l LEFT JOIN p USING (domain)""")
def q_apply_offsets(spark, sf):
    shift = F.when(F.col("domain").endswith("1"), -10800).when(F.col("domain").endswith("2"), 3600).otherwise(0)
    a = articles(spark, sf).withColumn("ingested_ts", F.timestamp_seconds(F.unix_timestamp("ingested_ts") + shift))
    return timeutil.apply_offsets(a, timeutil.diagnose_offsets(a)).select("article_id", F.unix_timestamp("published_ts").alias("ts"))


@query("repaired_timestamps", f"WITH {ARTICLES}, x AS (SELECT article_id, its, CASE WHEN article_id % 50 = 0 THEN ts + 40000000 WHEN article_id % 51 = 0 THEN 1000 ELSE ts END AS ts FROM articles) SELECT article_id, CASE WHEN ts > its + 3600 OR ts < 946684800 THEN its ELSE ts END AS ts, CASE WHEN ts > its + 3600 THEN 'future' WHEN ts < 946684800 THEN 'ancient' END AS suspect FROM x")
def q_repair(spark, sf):
    t, i = F.unix_timestamp("published_ts"), F.col("article_id")
    a = articles(spark, sf).withColumn("published_ts", F.timestamp_seconds(F.when(i % 50 == 0, t + 40_000_000).when(i % 51 == 0, 1000).otherwise(t)))
    return timeutil.repair_timestamps(a).select("article_id", F.unix_timestamp("published_ts").alias("ts"), "suspect")


@query("local_time", "SELECT event_id, CAST(ts - INTERVAL 3 HOUR AS DATE) AS local_date, hour(ts - INTERVAL 3 HOUR)::INT AS local_hour, hour(ts - INTERVAL 3 HOUR) BETWEEN 10 AND 16 AS in_session, CAST(epoch(CAST(ts - INTERVAL 3 HOUR AS DATE)) AS BIGINT) + 20 * 3600 AS close_s FROM events")
def q_local(spark, sf):
    d = timeutil.local_date(F.col("ts"))
    return table(spark, sf, "events").select("event_id", d.alias("local_date"), timeutil.local_hour(F.col("ts")).alias("local_hour"), timeutil.in_session(F.col("ts")).alias("in_session"), F.unix_timestamp(timeutil.session_close_utc(d)).alias("close_s"))


@query("audit", f"WITH RECURSIVE {CLUSTERED} SELECT (SELECT count(*) FROM clustered WHERE cluster_id IS NULL) AS n_unclustered, (SELECT count(*) FROM articles WHERE lang <> 'en') AS n_uncovered_scores, (SELECT count(DISTINCT p_type) FROM part WHERE p_type NOT IN ('ECONOMY', 'LARGE')) AS n_ghost_drivers, (SELECT count(*) FROM events) AS n_signals, (SELECT count(DISTINCT CAST(ts AS DATE)) FROM events) AS n_signal_days")
def q_audit(spark, sf):
    a = clustered(spark, sf)
    reg = spark.createDataFrame([("ECONOMY",), ("LARGE",)], "driver string")
    return quality.audit(a, a.select("article_id"), table(spark, sf, "part").select(F.col("p_type").alias("driver")), reg, table(spark, sf, "events").select(F.col("ts").alias("asof")))


@query("bar_coverage", """SELECT event_type AS symbol, CASE WHEN event_id % 2 = 0 THEN '1h' ELSE '1d' END AS "interval", count(*) AS n, min(ts) AS "first", max(ts) AS "last", count(*) >= 100 AS usable FROM events GROUP BY ALL""")
def q_coverage(spark, sf):
    return quality.bar_coverage(table(spark, sf, "events").select(F.col("event_type").alias("symbol"), F.when(F.col("event_id") % 2 == 0, "1h").otherwise("1d").alias("interval"), "ts"))


@query("page_links")
def q_links(spark, sf):
    from ..operators.documents import extract_links

    return extract_links(table(spark, sf, "pages").withColumn("html", F.concat("html", F.lit('<a href="/files/report.pdf#p2">Earnings &amp; release</a><a href="/tag/x.pdf">no</a>'))))


@query("term_facts", "WITH x AS (SELECT conv_id, turn, lower(text) AS t FROM conversations) SELECT conv_id, turn, (length(t) - length(replace(t, 'tion', ''))) // 4 AS n_tion, (length(t) - length(replace(t, 'the', ''))) // 3 AS n_the FROM x")
def q_terms(spark, sf):
    f = documents.term_facts(F.col("text"), ["tion", "the"])
    return table(spark, sf, "conversations").select("conv_id", "turn", f["counts"]["tion"].cast("long").alias("n_tion"), f["counts"]["the"].cast("long").alias("n_the"))


@query("report_chunks")
def q_chunks(spark, sf):
    t = F.concat(F.lit("[PÁGINA 1]"), F.col("text"), F.lit("[PÁGINA 2]"), F.reverse("text"), F.lit("[PÁGINA 3]"), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.posexplode(documents.page_chunks(t, 3000)).alias("chunk", "c")).select("doc_id", "chunk", F.array_join("c.pages", ",").alias("pages"), F.length("c.text").alias("chars"))


@query("document_register", "SELECT min(doc_id) AS doc_id, source AS ticker FROM documents WHERE doc_id % 3 <> 0 AND (source, text) NOT IN (SELECT source, text FROM documents WHERE doc_id % 3 = 0) GROUP BY source, text")
def q_register(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("ticker"), F.format_string("u%012d", "doc_id").alias("url"), F.col("text").alias("content"), "doc_id")
    old = d.where("doc_id % 3 = 0").withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256))
    return documents.register(old, d.where("doc_id % 3 != 0")).select("doc_id", "ticker")


@query("insert_new", "SELECT min(c_custkey) AS k, c_mktsegment, c_nationkey FROM customer WHERE (c_mktsegment, c_nationkey) NOT IN (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer WHERE c_custkey % 40 = 0) GROUP BY c_mktsegment, c_nationkey")
def q_insert(spark, sf):
    c = table(spark, sf, "customer")
    return sinks.insert_new(c.where("c_custkey % 40 = 0"), c, ["c_mktsegment", "c_nationkey"], ["c_custkey"]).select(F.col("c_custkey").alias("k"), "c_mktsegment", "c_nationkey")


@query("upsert", "WITH u AS (SELECT o_custkey, 0 AS g, o_orderdate, o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_custkey, 1, o_orderdate, o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 1) SELECT o_custkey, arg_max(o_orderkey, (g, o_orderkey)) AS o_orderkey, arg_max(o_orderstatus, (g, o_orderkey)) AS o_orderstatus FROM u GROUP BY o_custkey")
def q_upsert(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return sinks.upsert(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["o_custkey"], "o_orderkey")


@query("consensus_import", "WITH x AS (SELECT o_orderkey, upper(trim(' ab' || o_custkey || ' ')) AS ticker, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE '2T24' END AS period, CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE CAST(o_orderkey AS VARCHAR) END AS c, CASE WHEN o_orderkey % 5 = 0 THEN 'soon' END AS d FROM orders) SELECT count(*) FILTER (period <> '' AND c <> 'n/a' AND d IS NULL) AS good, count(*) FILTER (period = '' OR c = 'n/a' OR d IS NOT NULL) AS bad FROM x")
def q_consensus(spark, sf):
    k = F.col("o_orderkey")
    raw = table(spark, sf, "orders").select(F.concat(F.lit(" ab"), F.col("o_custkey").cast("string"), F.lit(" ")).alias("ticker"), F.when(k % 9 == 0, "").otherwise("2T24").alias("period"), F.lit("EPS").alias("metric"), F.when(k % 7 == 0, "n/a").otherwise(k.cast("string")).alias("consensus"), F.lit(None).cast("string").alias("dispersion"), F.lit("3").alias("n_analysts"),
                                            F.when(k % 5 == 0, "soon").otherwise(F.when(k % 2 == 0, "1700000000").otherwise("2024-03-01")).alias("asof_date"))
    good, bad = readers.clean_consensus(raw)
    return good.agg(F.count("*").alias("good")).join(F.broadcast(bad.agg(F.count("*").alias("bad"))))


@query("universe", "WITH x AS (SELECT upper(substr(c_mktsegment, 1, 4)) || c_nationkey AS ticker FROM customer) SELECT DISTINCT ticker FROM x WHERE regexp_full_match(ticker, '[A-Z]{4}[0-9]{1,2}')")
def q_universe(spark, sf):
    raw = table(spark, sf, "customer").select(F.concat(F.lit(" "), F.lower(F.substring("c_mktsegment", 1, 4)), F.col("c_nationkey").cast("string")).alias("ticker"), F.col("c_mktsegment").alias("name"))
    return readers.clean_universe(raw).select("ticker")


@query("realized_months", "SELECT event_type AS indicator, CAST(date_trunc('month', ts) AS DATE) AS ref_month, max(CAST(ts AS DATE)) AS last_day FROM events GROUP BY event_type, date_trunc('month', ts)")
def q_realized(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("indicator"), F.date_format("ts", "dd/MM/yyyy").alias("data"), F.date_format("ts", "yyyyMMdd").alias("valor")).distinct()
    return readers.realized_months(e).select("indicator", "ref_month", F.to_date(F.col("value").cast("long").cast("string"), "yyyyMMdd").alias("last_day"))


@query("windowed_attention", "WITH w AS (SELECT event_type, unnest(generate_series(date_trunc('hour', ts) - INTERVAL 23 HOUR, date_trunc('hour', ts), INTERVAL 1 HOUR)) AS s FROM events) SELECT event_type AS ticker, s AS start, s + INTERVAL 24 HOUR AS \"end\", count(*) AS n FROM w GROUP BY ALL")
def q_windowed(spark, sf):
    return streams.windowed_attention(table(spark, sf, "events").select(F.col("event_type").alias("ticker"), F.col("ts").alias("published_ts")))


@query("story_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 2 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id AS cluster_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def q_sessions(spark, sf):
    return streams.story_sessions(table(spark, sf, "events").select(F.col("user_id").alias("cluster_id"), F.col("ts").alias("published_ts")))


_Z, _IC = "((doc_id % 601) - 300) / 100.0", "((doc_id % 37) - 18) / 20.0"
_X = f"abs(({_IC}) * ({_Z}) / sqrt(1 - ({_IC}) * ({_IC})))"


@query("p_up_given_z", f"""WITH x AS (SELECT doc_id, {_X}::DOUBLE AS x, ({_IC}) * ({_Z}) >= 0 AS pos FROM documents), t AS (SELECT *, 1 / (1 + 0.2316419::DOUBLE * x) AS t FROM x),
p AS (SELECT *, exp(-x * x / 2) / sqrt(2 * pi()) * t * (0.319381530::DOUBLE + t * (-0.356563782::DOUBLE + t * (1.781477937::DOUBLE + t * (-1.821255978::DOUBLE + t * 1.330274429::DOUBLE)))) AS tail FROM t)
SELECT doc_id, {R('CASE WHEN pos THEN 1 - tail ELSE tail END')} AS p FROM p""")
def q_p_up(spark, sf):
    z, ic = (F.col("doc_id") % 601 - 300) / 100.0, (F.col("doc_id") % 37 - 18) / 20.0
    return table(spark, sf, "documents").select("doc_id", r6(stats.p_up_given_z(z, ic)).alias("p"))


@query("ic_to_hits", f"WITH x AS (SELECT doc_id, ((doc_id % 199) - 99) / 100.0 AS ic FROM documents) SELECT doc_id, {R('0.5 + asin(ic) / pi()')} AS hits, {R('ic')} AS ic FROM x")
def q_hits_ic(spark, sf):
    ic = (F.col("doc_id") % 199 - 99) / 100.0
    return table(spark, sf, "documents").select("doc_id", r6(stats.ic_to_hits(ic)).alias("hits"), r6(stats.hits_to_ic(stats.ic_to_hits(ic))).alias("ic"))
