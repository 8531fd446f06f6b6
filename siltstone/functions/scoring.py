"""Scores, badges, token and cost estimates, and query inspection as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
AUTHORITY_BOOST = {"official": 1.2, "semi_official": 1.0, "third_party": 0.8}
AUTHORITY_RANK = {"third_party": 1, "semi_official": 2, "official": 3}
BADGES = {"official": "🔴 [OFFICIAL]", "semi_official": "🟡 [SEMI-OFFICIAL]", "third_party": "⚪ [THIRD-PARTY]"}
MODEL_COSTS = {"gpt-4o": (0.005, 0.015), "gpt-4o-mini": (0.00015, 0.0006), "gpt-4": (0.03, 0.06), "gpt-3.5-turbo": (0.0005, 0.0015)}
TOPIC_PATTERNS = {
    "chancenkarte": "chancenkarte|opportunity card",
    "work_visa": "work permit|arbeitserlaubnis|work visa",
    "student_visa": "student visa|studentenvisum",
    "freelance_visa": "freelance|freiberufler",
    "entrepreneur_visa": "entrepreneur|unternehmer",
}
SUSPICIOUS = ("ignore previous instructions", "system prompt", "you are now", "disregard", "pretend you are", "forget about", "new instructions", "execute code", r"eval\(", "import os")
GERMAN_WORDS = "der|die|das|und|in|zu|mit"


def choose(key: Column, table: dict, default) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def recency_factor(fetched_at: Column, as_of: Column) -> Column:
    days = F.floor((F.unix_micros(as_of) - F.unix_micros(fetched_at)) / F.lit(86_400_000_000))
    return 1 - F.least(days, F.lit(365)) / F.lit(365.0) * 0.1


def authority_boost(level: Column) -> Column:
    return choose(level, AUTHORITY_BOOST, 0.8)


def adjusted_score(score: Column, fetched_at: Column, level: Column, as_of: Column) -> Column:
    return score * recency_factor(fetched_at, as_of) * authority_boost(level)


def authority_badge(level: Column) -> Column:
    return choose(level, BADGES, "")


def authority_at_least(level: Column, minimum: str | None) -> Column:
    return F.lit(True) if minimum is None else choose(level, AUTHORITY_RANK, 0) >= AUTHORITY_RANK[minimum]


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def cost_estimate(tokens_in: Column, tokens_out: Column, model: Column) -> Column:
    price_in = choose(model, {k: v[0] for k, v in MODEL_COSTS.items()}, 0.0)
    price_out = choose(model, {k: v[1] for k, v in MODEL_COSTS.items()}, 0.0)
    return F.round(tokens_in / 1000 * price_in + tokens_out / 1000 * price_out, 6)


def client_cost(tokens_in: Column, tokens_out: Column, model: Column) -> Column:
    """The hosted client's own estimate: no price for gpt-4o, nothing rounded."""
    known = {k: v for k, v in MODEL_COSTS.items() if k != "gpt-4o"}
    price_in, price_out = (choose(model, {k: v[i] for k, v in known.items()}, 0.0) for i in (0, 1))
    return tokens_in / 1000 * price_in + tokens_out / 1000 * price_out


def detect_topics(query: Column) -> Column:
    low = F.lower(query)
    return F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(name)) for name, p in TOPIC_PATTERNS.items()]))


def detect_languages(query: Column) -> Column:
    low = F.lower(query)
    german = low.rlike("[äöüß]") | low.rlike(rf"(^|[^\p{{L}}\p{{N}}_])({GERMAN_WORDS})($|[^\p{{L}}\p{{N}}_])")
    found = F.array_compact(F.array(F.when(query.rlike(r"[\x{4e00}-\x{9fff}]"), F.lit("zh")), F.when(german, F.lit("de"))))
    return F.when(F.size(found) == 0, F.array(F.lit("en"))).otherwise(found)


def needs_expansion(query: Column, enabled: bool = True) -> Column:
    """Whether a query goes to the language model: expansion off, or under three words."""
    return F.lit(not enabled) | (F.size(F.filter(F.split(query, r"\s+"), lambda w: w != "")) < 3)


def search_queries(query: Column, corrected: Column, english: Column, variants: Column, enabled: bool = True) -> Column:
    """The queries to search with, in order, each once."""
    if not enabled:
        return F.array(query)
    several = F.filter(F.array_distinct(F.array_compact(F.array(corrected, english, F.get(variants, 0)))), lambda q: q != "")
    return F.when(F.length(F.btrim(query)) > 50, F.array(query)).otherwise(several)


TRANSFORMED = "corrected_query string, query_variants array<string>, detected_visa_types array<string>, languages_detected array<string>, confidence double"


def transformed_query(query: Column, reply: Column | None = None, enabled: bool = True) -> Column:
    """A struct of TRANSFORMED. Queries that need no expansion are taken as they are.

    The others get the model's JSON reply; where there is none that can be read, the query itself with less confidence.
    """
    row = lambda topics, languages, confidence: F.struct(query.alias("corrected_query"), F.array(query).alias("query_variants"), topics.alias("detected_visa_types"), languages.alias("languages_detected"), F.lit(confidence).alias("confidence"))
    plain = row(detect_topics(query), detect_languages(query), 0.9)
    failed = row(F.array().cast("array<string>"), F.array(F.lit("de")), 0.5)
    if reply is None:
        return F.when(needs_expansion(query, enabled), failed).otherwise(plain)
    read = json_reply(reply, TRANSFORMED)
    return F.when(~needs_expansion(query, enabled), plain).when(read["corrected_query"].isNull(), failed).otherwise(read)


def with_disclaimer(answer: Column, disclaimer: str) -> Column:
    return F.concat(answer, F.lit(f"\n\n{disclaimer}"))


def user_message(question: Column, template: str) -> Column:
    """(role, content) of the last message to a model; the template names {question}."""
    return F.struct(F.lit("user").alias("role"), fill_template(template, question=question).alias("content"))


def is_context_safe(context: Column) -> Column:
    return ~F.lower(context).rlike("|".join(SUSPICIOUS))


def quality_flags(text: Column, header: Column) -> Column:
    low = F.lower(text)
    noise = F.contains(low, F.lit("cookie")) | F.contains(low, F.lit("privacy policy"))
    return F.array_compact(F.array(F.when(F.length(text) < 100, "too_short"), F.when(noise, "web_noise"), F.when(header.isNull() | header.isin("", "Introduction"), "generic_header")))


def sse_event(piece: Column) -> Column:
    body = F.struct(F.array(F.struct(F.struct(piece.alias("content")).alias("delta"), F.lit(None).cast("string").alias("finish_reason"))).alias("choices"))
    return F.concat(F.lit("data: "), F.to_json(body, {"ignoreNullFields": "false"}), F.lit("\n\n"))


def json_reply(reply: Column, schema: str) -> Column:
    """The JSON object of a model's reply, inside a code fence or not; null if there is none."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.from_json(F.when(fenced != "", fenced).otherwise(reply), schema)


def fill_template(template: str, **values: Column) -> Column:
    """The template with each {name} replaced by its column, in one pass: braces inside values stay. Null values count as empty."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(F.coalesce(values[x].cast("string"), F.lit("")) if i % 2 else F.lit(x) for i, x in enumerate(parts)))


def source_list(hits: Column) -> Column:
    """(url, title, authority) of each element of an array of hits, in order."""
    return F.transform(hits, lambda h: F.struct(h["source_url"].alias("url"), h["source_title"].alias("title"), h["authority_level"].alias("authority")))


def evaluation_contexts(sources: Column) -> Column:
    """What an evaluation gets as context of each source: its title in brackets, then its URL."""
    return F.transform(sources, lambda s: F.concat(F.lit("["), F.coalesce(s["title"], F.lit("Unknown")), F.lit("]\n"), F.coalesce(s["url"], F.lit(""))))


def iso_timestamp(text: Column) -> Column:
    """An ISO 8601 timestamp; null if it is none."""
    return F.try_to_timestamp(text)
