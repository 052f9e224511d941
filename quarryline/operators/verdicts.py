"""Rules that judge posts and candidates: each is an ordered list of (name, condition), the first that holds decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.operators.ranking import first_reason

# Limits of the review of candidates.
MIN_POSTS_30D = 3
MIN_MEDIAN_LIKES = 20.0
PROMOTE, HOLD, REJECT = "promote", "hold", "reject"
STATUS_OF = {PROMOTE: "promoted", HOLD: "hold", REJECT: "rejected"}
VALIDATED_OF = {PROMOTE: "ok", HOLD: "pending", REJECT: "reject"}


def holds(condition: Column) -> Column:
    """An unknown condition does not hold."""
    return F.coalesce(condition, F.lit(False))


def honest(is_promo, status, flood_until, now) -> Column:
    """Posts that a rating may show: not paid, and of a source that is not flooded, now or for some time yet."""
    flooded = holds(status == "flooded") | holds(flood_until > now)
    return ~holds(is_promo) & ~flooded


def left_out(is_repost, is_pinned, deleted_at, metrics_source) -> Column:
    """Posts that no sum counts: reposts, pinned and deleted ones, and those whose numbers are of the post that they repeat."""
    return holds(is_repost) | holds(is_pinned) | deleted_at.isNotNull() | holds(metrics_source == "cdn_rt")


def quality_skip(status, promo_source, is_promo, active: tuple[str, ...] = ("active", "provisional")) -> Column:
    """Why a list of viral posts passes a post over: ``candidate``, ``status``, ``promo_source``, ``ad``; null for none. A source without status counts as active."""
    known = F.lower(F.trim(F.coalesce(status, F.lit("active"))))
    rules = [
        ("candidate", known.startswith("candidate")),
        ("status", ~known.isin(*active)),
        ("promo_source", holds(promo_source)),
        ("ad", holds(is_promo)),
    ]
    return first_reason(rules)


def complementary(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """The rows without a reason, and the others with it: together all rows, each once."""
    marked = rows.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def _verdict(rules: list[tuple[str, str, Column]], otherwise: str) -> Column:
    """``verdict`` and ``reason`` of the first rule (verdict, reason, condition) that holds; ``otherwise`` promotes."""
    decided = F
    for verdict, reason, condition in rules:
        decided = decided.when(holds(condition), F.struct(F.lit(verdict).alias("verdict"), F.lit(reason).alias("reason")))
    return decided.otherwise(F.struct(F.lit(PROMOTE).alias("verdict"), F.lit(otherwise).alias("reason")))


def channel_verdict(known, blocked, outcome, posts_30d, size) -> Column:
    """A channel of short posts: known or blocked ones, unreadable feeds and silent channels are rejected; few posts or an unknown size wait."""
    posts = F.coalesce(posts_30d, F.lit(0))
    return _verdict(
        [
            (REJECT, "duplicate", known),
            (REJECT, "blocked", blocked),
            (REJECT, "gone", outcome == "gone"),
            (REJECT, "no_feed", outcome.isin("no_feed", "unreadable")),
            (HOLD, "no_answer", outcome.isNull() | (outcome == "fetch_error")),
            (REJECT, "no_posts_30d", posts == 0),
            (HOLD, "few_posts_30d", posts < MIN_POSTS_30D),
            (HOLD, "size_unknown", size.isNull()),
        ],
        "posts_and_size",
    )


def video_channel_verdict(exists, videos_30d, size) -> Column:
    """A video channel: gone ones and those without videos are rejected; no answer, few videos or a hidden size wait."""
    videos = F.coalesce(videos_30d, F.lit(0))
    return _verdict(
        [
            (REJECT, "gone", ~exists),
            (HOLD, "no_answer", exists.isNull()),
            (REJECT, "no_videos_30d", videos == 0),
            (HOLD, "few_videos_30d", videos < MIN_POSTS_30D),
            (HOLD, "size_unknown", size.isNull()),
        ],
        "videos_and_size",
    )


def account_verdict(known, blocked, place, budget, outcome, posts_30d, median_likes) -> Column:
    """An account: ``place`` counts (from 1) the accounts that need a request, in queue order; those beyond ``budget`` wait unasked."""
    posts = F.coalesce(posts_30d, F.lit(0))
    return _verdict(
        [
            (REJECT, "duplicate", known),
            (REJECT, "blocked", blocked),
            (HOLD, "budget", place > budget),
            (REJECT, "gone", outcome == "gone"),
            (REJECT, "protected", outcome == "protected"),
            (HOLD, "no_answer", outcome.isNull() | outcome.isin("budget", "fetch_error")),
            (REJECT, "no_posts_30d", posts == 0),
            (HOLD, "few_posts_30d", posts < MIN_POSTS_30D),
            (HOLD, "few_likes", median_likes.isNull() | (median_likes < MIN_MEDIAN_LIKES)),
        ],
        "posts_and_likes",
    )


def promotion_reason(antifraud, posts, vr_state, vr, min_posts: int, min_vr: float, need_vr: bool = True) -> Column:
    """Why a candidate channel is not promoted, or null: signs of fraud, few posts, and an unknown or low median of views per follower."""
    rules = [("antifraud", F.coalesce(antifraud, F.lit(0)) != 0), ("too_few_posts", F.coalesce(posts, F.lit(0)) < min_posts)]
    if need_vr:
        rules += [("vr_unknown", F.coalesce(vr_state, F.lit("")) != "ok"), ("vr_low", vr.isNull() | (vr < min_vr))]
    return first_reason(rules)


def growth_gate(size, posts_14d, has_outlier, blocked, growth) -> Column:
    """How an author passes the selection: ``verified``, ``unknown`` (no growth history yet) or null.

    Sizes of 1,000 to 500,000, three posts in 14 days and a post at three times the author's median; growth in 7 days of 3 %, or 10 % below 5,000.
    """
    fits = size.between(1_000, 500_000) & (F.coalesce(posts_14d, F.lit(0)) >= 3) & holds(has_outlier) & ~holds(blocked)
    enough = growth >= F.when(size >= 5_000, 0.03).otherwise(0.10)
    return F.when(~holds(fits), None).when(growth.isNull(), "unknown").when(enough, "verified")
