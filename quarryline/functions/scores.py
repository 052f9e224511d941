"""Scoring formulas as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
BREAKOUT_WEIGHTS = {"g7": 0.45, "median_metric_24h": 0.25, "trusted_indegree_30d": 0.20, "new_entity_rate": 0.10}
AGE_EXPONENT, SPREAD_WEIGHT, SNAPSHOT_HOURS = 1.8, 0.8, 6.0
AXIS_CAP, MIN_AXES, HALF_LIFE_DAYS = 20.0, 2, 7.0


def engagement_rate(views, reactions) -> Column:
    """Reactions per view; null without views."""
    return F.when(views > 0, reactions / views)


def combined_engagement(own, overall) -> Column:
    """Geometric mean of the two ratios; where one is missing or zero, the other."""
    both = F.when((own > 0) & (overall > 0), F.sqrt(own * overall)).when(own > 0, own).when(overall > 0, overall).otherwise(own)
    return F.when(own.isNull(), overall).when(overall.isNull(), own).otherwise(both)


def copy_penalty(copies) -> Column:
    return F.when(copies >= 1, 1 - 1 / copies).otherwise(0.0)


def source_weight(reposts) -> Column:
    return 1 / (1 + F.greatest(F.lit(0), reposts))


def decay(age_days, half_life: float = HALF_LIFE_DAYS) -> Column:
    return F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age_days) / half_life) if half_life > 0 else F.lit(1.0)


def channel_significance(forward_factor, reposts, copies, engagement, topic_weight, age_days, half_life: float = HALF_LIFE_DAYS) -> Column:
    """Product of the factors of a channel post; null without engagement."""
    topic = F.coalesce(topic_weight, F.lit(1.0))
    return forward_factor * source_weight(reposts) * copies * engagement * (1 - copy_penalty(copies)) * topic * decay(age_days, half_life)


def post_significance(likes, replies, copies, graph_authors, hours, missing) -> Column:
    """Speed and spread, fading with age; from the spread alone where the metrics are missing."""
    spread = F.greatest(F.lit(0), F.greatest(F.lit(1), F.coalesce(copies, F.lit(1))) - 1, F.coalesce(graph_authors, F.lit(0)))
    age = F.greatest(F.lit(0.0), F.coalesce(hours, F.lit(0.0)))
    velocity = (F.coalesce(likes, F.lit(0)) + 2 * F.coalesce(replies, F.lit(0))) / SNAPSHOT_HOURS
    popular = (F.log1p(velocity) + SPREAD_WEIGHT * F.log1p(spread)) / F.pow(1 + age / 24, F.lit(AGE_EXPONENT))
    graph = F.pow(spread, F.lit(0.8)) / F.pow(age + 2, F.lit(AGE_EXPONENT))
    return F.when(missing, graph).otherwise(popular)


def legacy_post_score(velocity, replies, spread, lead_minutes) -> Column:
    """0.45 engagement, 0.35 spread, 0.20 being first."""
    engage = F.log10(1 + 10 * F.coalesce(velocity, F.lit(0.0)) + 2 * F.coalesce(replies, F.lit(0)))
    first = F.when(lead_minutes >= 0, 1 / (1 + lead_minutes / 60)).otherwise(0.0)
    return 0.45 * engage + 0.35 * spread + 0.20 * first


def viral_index(axes: dict[str, tuple[Column, Column]], age_days, capped: tuple[str, ...] = ("likes", "comments"), least: int = MIN_AXES) -> Column:
    """Geometric mean of the ratios (value, median) that are positive, fading with age; null for fewer than ``least``."""
    ratios = {k: F.when((v > 0) & (m > 0), v / m) for k, (v, m) in axes.items()}
    ratios = {k: F.least(r, F.lit(AXIS_CAP)) + r * 0 if k in capped else r for k, r in ratios.items()}
    known = reduce(lambda a, b: a + b, (r.isNotNull().cast("int") for r in ratios.values()))
    logs = reduce(lambda a, b: a + b, (F.coalesce(F.ln(r), F.lit(0.0)) for r in ratios.values()))
    return F.when(known >= least, F.exp(logs / known) * decay(age_days))


def weighted_present(z: dict[str, Column], weights: dict[str, float] = BREAKOUT_WEIGHTS) -> Column:
    """Weighted mean of the values that are present; null for none."""
    total = reduce(lambda a, b: a + b, (F.coalesce(z[k] * w, F.lit(0.0)) for k, w in weights.items()))
    weight = reduce(lambda a, b: a + b, (F.when(z[k].isNotNull(), F.lit(w)).otherwise(0.0) for k, w in weights.items()))
    return F.when(weight > 0, total / weight)


def edge_weight(base, popularity, sources, pop_weight: float = 0.5, independence_weight: float = 0.5, saturation: float = 5.0) -> Column:
    """Kind of the edge times popularity of its post times independence of its sources."""
    pop = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(popularity, F.lit(0.0))))
    independent = F.least(F.lit(1.0), F.greatest(F.lit(0), F.coalesce(sources, F.lit(1)) - 1) / saturation)
    return base * (1 + pop_weight * pop) * (1 + independence_weight * independent)


def per_thousand(part, whole) -> Column:
    return F.when(whole > 0, 1000 * part / whole)


def channel_candidate_score(source_weight, size, mentions) -> Column:
    """Weight of where a channel was found, plus the logarithm of its size, plus a half for every repeated mention."""
    repeats = F.greatest(F.coalesce(mentions, F.lit(1)), F.lit(1)) - 1
    return F.round(F.coalesce(source_weight, F.lit(1.0)) + F.log10(F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)) + 1) + 0.5 * repeats, 4)


def account_candidate_priority(sources, trusted_sources, is_first_rubric, found_via, is_spam) -> Column:
    """Sources, three more for every trusted one, two for a first rubric, one for authors (not only mentioned), two less for a name like spam."""
    flag = lambda c, points: F.when(F.coalesce(c, F.lit(False)), points).otherwise(0.0)
    as_author = found_via.startswith("author") | found_via.startswith("orig")
    at_least_one = F.when(F.coalesce(sources, F.lit(0)) == 0, 1).otherwise(sources)
    return F.round(at_least_one + 3.0 * F.coalesce(trusted_sources, F.lit(0)) + flag(is_first_rubric, 2.0) + flag(as_author, 1.0) - flag(is_spam, 2.0), 4)


#: Weights of topics; other and unknown topics weigh one.
TOPIC_WEIGHTS = {
    "модели и релизы": 1.40, "агенты и автоматизация": 1.30, "кодинг и разработка": 1.20, "чипы и железо": 1.15, "дата-центры и энергия": 1.15,
    "наука и медицина": 1.10, "регулирование и безопасность": 1.05, "деньги и сделки": 1.05, "стартапы и бизнес": 1.05, "запуски и анонсы": 1.00,
    "роботы и физический ИИ": 1.00, "ИИ-инструменты для обычных людей": 1.00, "медиа и творчество": 0.90, "дизайн и креатив": 0.90,
    "обучение и навыки": 0.90, "влоги и личный опыт": 0.70, "прочее": 0.60,
}


def topic_weight(topic, weights: dict[str, float] = TOPIC_WEIGHTS) -> Column:
    table = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    return F.coalesce(table[F.coalesce(topic, F.lit(""))], F.lit(1.0))


# Weights of the parts of a video's packaging, penalties by level, and limits.
PACKAGING_WEIGHTS = {"title": 30, "description": 30, "hashtags": 10, "tags": 10, "chapters": 10, "topic": 10}
PENALTY = {"high": 0.5, "mid": 0.25, "low": 0.1}
TITLE_LENGTHS, TITLE_CAPS, TITLE_EMOJI = (30, 60, 70), 0.5, 3
SNIPPET_LENGTH, HASHTAGS, TAGS, CHAPTERS_FROM = 150, (3, 5, 15), (8, 12, 50), 480


def packaging(title_length, caps_ratio, emoji, description_length, hashtags, tags, duration, timestamps, topic_match) -> Column:
    """Struct of ``score`` (0 to 100), ``issues`` (codes in order) and ``not_applicable`` (parts whose weight is left out).

    Every issue takes a share of its part by its level. Hashtags need a description, chapters a known duration, the topic a known match.
    """
    zero = lambda c: F.coalesce(c, F.lit(0))
    low, high, hard = TITLE_LENGTHS
    few, many, ignored = HASHTAGS
    tags_few, tags_many, tags_risk = TAGS
    issues: dict[str, list[tuple[str, str, Column]]] = {
        "title": [
            ("title_too_long", "high", zero(title_length) > hard),
            ("title_too_long", "mid", (zero(title_length) > high) & (zero(title_length) <= hard)),
            ("title_too_short", "low", zero(title_length) < low),
            ("title_caps", "mid", zero(caps_ratio) > TITLE_CAPS),
            ("title_emoji", "low", zero(emoji) > TITLE_EMOJI),
        ],
        "description": [("description_no_snippet", "high", zero(description_length) < SNIPPET_LENGTH)],
        "hashtags": [
            ("hashtags_missing", "low", zero(hashtags) == 0),
            ("hashtags_few", "low", zero(hashtags).between(1, few - 1)),
            ("hashtags_over_limit", "high", zero(hashtags) > ignored),
            ("hashtags_many", "low", (zero(hashtags) > many) & (zero(hashtags) <= ignored)),
        ],
        "tags": [
            ("tags_missing", "low", zero(tags) == 0),
            ("tags_few", "low", zero(tags).between(1, tags_few - 1)),
            ("tags_spam_risk", "mid", zero(tags) > tags_risk),
            ("tags_many", "low", (zero(tags) > tags_many) & (zero(tags) <= tags_risk)),
        ],
        "chapters": [("description_no_chapters", "mid", (duration >= CHAPTERS_FROM) & (zero(timestamps) == 0))],
        "topic": [("topic_mismatch", "mid", topic_match == 0)],
    }
    applies = {"hashtags": zero(description_length) > 0, "chapters": duration.isNotNull(), "topic": topic_match.isNotNull()}
    got, possible, codes, skipped = F.lit(0.0), F.lit(0.0), [], []
    for part, weight in PACKAGING_WEIGHTS.items():
        on = applies.get(part, F.lit(True))
        penalty = F.lit(0.0)
        for code, level, condition in issues[part]:
            here = on & F.coalesce(condition, F.lit(False))
            penalty = penalty + F.when(here, PENALTY[level]).otherwise(0.0)
            codes.append(F.when(here, code))
        got = got + F.when(on, weight * F.greatest(F.lit(0.0), 1 - penalty)).otherwise(0.0)
        possible = possible + F.when(on, float(weight)).otherwise(0.0)
        skipped.append(F.when(~on, part))
    score = F.round(100 * got / possible, 1)
    return F.struct(score.alias("score"), F.array_compact(F.array(*codes)).alias("issues"), F.array_compact(F.array(*skipped)).alias("not_applicable"))
