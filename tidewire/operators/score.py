"""Scorers of articles: lexicon with negation and hedging, event type, orientation, nature, structured responses."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.text import norm, once, tokens

RESULT = ["s", "magnitude", "event_type", "raw"]  #: what every scorer adds


def _map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def article_text(title: Column, body: Column, chars: int = 600) -> Column:
    return norm(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.substring(F.coalesce(body, F.lit("")), 1, chars)))


def event_type(text: Column, events=config.EVENTS) -> tuple[Column, Column]:
    """(name, weight) of the first pattern that the normal text holds; ('unclassified', .25) without one."""
    name, weight = F.lit("unclassified"), F.lit(0.25)
    for n, p, w in reversed(events):
        hit = text.rlike(p)
        name, weight = F.when(hit, n).otherwise(name), F.when(hit, F.lit(float(w))).otherwise(weight)
    return name, weight


def entity_role(text: Column, aliases: Column, adverse=config.ADVERSE, favourable=config.FAVOURABLE, span: int = 60) -> Column:
    """-1 if the entity (array of normal names) follows an adverse marker within `span` characters, 1 after a
    favourable one, 0 for both or neither."""

    def near(patterns: list[str]) -> Column:
        # what follows each marker: the look-ahead lets markers overlap the spans of earlier ones
        tails = [F.regexp_extract_all(text, F.lit(f"(?:{p})(?=(.{{0,{span}}}))"), F.lit(1)) for p in patterns]
        return F.exists(F.concat(*tails), lambda t: F.exists(aliases, lambda a: F.contains(t, a)))

    bad, good = near(adverse), near(favourable)
    return F.when(bad & ~good, -1).when(good & ~bad, 1).otherwise(0)


def lexicon_score(df: DataFrame, title: str = "title", body: str = "body", positive=config.POSITIVE, negative=config.NEGATIVE, phrases=config.PHRASES,
                  negators=config.NEGATORS, hedges=config.HEDGES, events=config.EVENTS, aliases: str | None = None) -> DataFrame:
    """df with s, magnitude, event_type and raw.

    s: weights of phrases (by substring) and tokens over the square root of their number, within -1 and 1; a token
    with a negator among the three before counts -0.7 times. magnitude: that of the event, x .85 where the
    entity's role (column `aliases`, array) decides, x .45 hedged, x .3 without any hit.
    """
    weights = {**negative, **positive}
    t = df.withColumn("text_", article_text(F.col(title), F.col(body))).withColumn("toks_", F.filter(F.split("text_", " "), lambda x: x != ""))
    table = _map({k: float(v) for k, v in weights.items()})
    t = t.withColumn("found_", F.filter(F.transform("toks_", lambda x, i: F.struct(table[x].alias("w"), i.alias("at"))), lambda x: x["w"].isNotNull()))
    # only the tokens found look back, at the three before each
    negated = lambda at: reduce(lambda a, b: a | b, [F.coalesce(F.get("toks_", at - k).isin(list(negators)), F.lit(False)) for k in (1, 2, 3)])
    word_sum = F.aggregate("found_", F.lit(0.0), lambda a, x: a + F.when(negated(x["at"]), -x["w"] * 0.7).otherwise(x["w"]))
    hit = {p: F.contains(F.col("text_"), F.lit(p)) for p in phrases}
    phrase_sum = reduce(lambda a, b: a + b, [F.when(h, F.lit(float(phrases[p]))).otherwise(0.0) for p, h in hit.items()], F.lit(0.0))
    phrase_hits = reduce(lambda a, b: a + b, [h.cast("int") for h in hit.values()], F.lit(0))
    t = t.withColumn("sum_", phrase_sum + word_sum).withColumn("hits_", phrase_hits + F.size("found_"))
    role = entity_role(F.col("text_"), F.col(aliases)) if aliases else F.lit(0)
    t = t.withColumn("role_", role)
    s = F.when(F.col("hits_") == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("sum_") / F.sqrt(F.greatest(F.col("hits_"), F.lit(1))))))
    s = F.when(((F.col("role_") < 0) & (s > 0)) | ((F.col("role_") > 0) & (s < 0)), -s).otherwise(s)
    name, mag = event_type(F.col("text_"), events)
    t = t.withColumn("event_", F.struct(name.alias("name"), mag.alias("weight")))  # one column, which both results read
    mag = F.col("event_.weight") * F.when(F.col("role_") != 0, 0.85).otherwise(1.0) * F.when(F.arrays_overlap("toks_", F.array(*[F.lit(h) for h in hedges])), 0.45).otherwise(1.0) * F.when(F.col("hits_") == 0, 0.3).otherwise(1.0)
    raw = F.to_json(F.struct(F.col("hits_").alias("hits"), F.round("sum_", 3).alias("sum")))
    out = t.withColumns({"s": F.round(s, 4), "magnitude": F.round(mag, 4), "event_type": F.col("event_.name"), "raw": raw})
    return out.drop("text_", "toks_", "found_", "sum_", "hits_", "role_", "event_")


def language_covered(lang: Column, scorer: str = "lexicon", languages=config.LANGUAGES) -> Column:
    """Only the lexicon is bound to its languages; an unstated language passes."""
    low = F.lower(F.trim(F.coalesce(lang, F.lit(""))))
    return F.lit(True) if scorer != "lexicon" else (low == "") | low.isin(languages)


def orientation(text: Column, past=config.PAST, present=config.PRESENT, future=config.FUTURE) -> Column:
    """Sorted array of the time orientations that the text shows; present without any."""

    def shown(t: Column) -> Column:
        some = lambda ps: reduce(lambda a, b: a | b, [t.rlike(p) for p in ps])
        return F.array_compact(F.array(F.when(some(future), "futuro"), F.when(some(past), "passado"), F.when(some(present), "presente")))

    return once(once(norm(text), shown), lambda got: F.when(F.size(got) == 0, F.array(F.lit("presente"))).otherwise(got))


def event_nature(text: Column, old: Column, natures=config.NATURES, mapped=config.NATURE_OF_EVENT) -> Column:
    def found(t: Column) -> Column:
        out = F.coalesce(_map(mapped)[old], F.lit("corporativo"))
        for name, pattern in reversed(natures):
            out = F.when(t.rlike(pattern), name).otherwise(out)
        return out

    return once(norm(text), found)


RESPONSE = "s double, magnitude double, event_type string, ja_precificado boolean, is_rumor boolean"


def structured_score(df: DataFrame, response: str) -> DataFrame:
    """df with the score of a landed JSON response (fenced or within other text): clipped, x .25 if already priced,
    x .45 if a rumour. All null where there is no JSON object."""
    text = F.regexp_extract(F.col(response), r"(?s)(\{.*\})", 1)
    obj = F.from_json(F.nullif(text, F.lit("")), RESPONSE, {"mode": "PERMISSIVE"})
    ok = obj.isNotNull() & (text != "")
    mag = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(obj["magnitude"], F.lit(0.0))))
    mag = mag * F.when(obj["ja_precificado"], 0.25).otherwise(1.0) * F.when(obj["is_rumor"], 0.45).otherwise(1.0)
    s = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(obj["s"], F.lit(0.0))))
    return df.withColumns({"s": F.when(ok, F.round(s, 4)), "magnitude": F.when(ok, F.round(mag, 4)), "event_type": F.when(ok, F.coalesce(obj["event_type"], F.lit("outro"))), "raw": F.when(ok, text)})


def ensemble(lexicon: DataFrame, structured: DataFrame, key: list[str] = ("article_id", "ticker")) -> DataFrame:
    """(key..., s, magnitude, event_type, raw, disagreement): the structured score; the lexicon's where there is none,
    and at .4 of its magnitude where the structured one saw nothing and it did."""
    key = list(key)
    a, b = (d.select(*key, *[F.col(c).alias(p + c) for c in RESULT]) for d, p in ((lexicon, "l_"), (structured, "t_")))
    j = a.join(b, key, "left")
    wl, wt = F.abs("l_s") * F.col("l_magnitude"), F.abs("t_s") * F.col("t_magnitude")
    none, damp = F.col("t_s").isNull(), (wt <= 1e-6) & (wl > 0.05)
    pick = lambda c: F.when(none | damp, F.col("l_" + c)).otherwise(F.col("t_" + c)).alias(c)
    mag = F.when(none, F.col("l_magnitude")).when(damp, F.round(F.col("l_magnitude") * 0.4, 4)).otherwise(F.col("t_magnitude"))
    return j.select(*key, pick("s"), mag.alias("magnitude"), pick("event_type"), pick("raw"), F.when(none, 0.0).otherwise(F.round(wl - wt, 4)).alias("disagreement"))


SCORERS: dict[str, Callable[..., DataFrame]] = {"lexicon": lexicon_score, "structured": structured_score}


def register_scorer(name: str, fn: Callable[..., DataFrame]) -> None:
    """Add a scorer: a function of a DataFrame that adds s, magnitude, event_type and raw."""
    SCORERS[name] = fn


def run_scorer(df: DataFrame, name: str, **options) -> DataFrame:
    return SCORERS[name](df, **options).withColumn("scorer", F.lit(name))


def pending_pairs(mentions: DataFrame, scores: DataFrame, scorer: str, min_relevance: float = 0.35) -> DataFrame:
    """Mentions relevant enough that the scorer has not scored yet."""
    done = scores.where(F.col("scorer") == scorer).select("article_id", "ticker")
    return mentions.where((F.col("relevance") >= min_relevance) & (F.col("ticker") != config.NOBODY)).join(done, ["article_id", "ticker"], "left_anti")
