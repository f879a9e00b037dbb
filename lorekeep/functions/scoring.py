"""Scores, decays, Beta statistics, rewards and tiers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def recency_exponential(age_days: Column) -> Column:
    """e to the minus age in hours over 720."""
    return F.exp(-(age_days * 24) / F.lit(720.0))


def recency_half_life(age_days: Column, half_life: float = 30.0) -> Column:
    return F.pow(F.lit(2.0), -age_days / F.lit(half_life))


def recency_weight(age_days: Column) -> Column:
    """Full weight for a week, then a half-life of 30 days."""
    return F.when(age_days <= 7, F.lit(1.0)).otherwise(recency_half_life(age_days))


def reliability_by_usage(confidence: Column, success_rate: Column, usage: Column) -> Column:
    u = F.least(usage, F.lit(10)) / F.lit(10.0)
    return (confidence * 0.4 + success_rate * 0.6) * u + confidence * (F.lit(1.0) - u)


def reliability_by_outcome(effectiveness: Column, confidence: Column, success: Column) -> Column:
    return effectiveness * 0.6 + confidence * 0.3 + F.when(success, F.lit(0.1)).otherwise(F.lit(0.0))


def reuse_log100(n: Column) -> Column:
    """ln n / ln 100, 1 at most; nothing for unused rows."""
    return F.when(n > 0, F.least(F.log(n.cast("double")) / F.log(F.lit(100.0)), F.lit(1.0))).otherwise(F.lit(0.0))


def reuse_log_max(n: Column, most: Column) -> Column:
    return clamp(F.log(F.lit(1.0) + n) / F.log(F.lit(1.0) + most))


def quality(effectiveness: Column, confidence: Column, reward: Column, success: Column) -> Column:
    return effectiveness * 0.4 + confidence * 0.3 + reward * 0.2 + F.when(success, F.lit(0.1)).otherwise(F.lit(0.0))


def relevance(q: Column, age_days: Column, surprise: Column) -> Column:
    """Quality under a 90-day half-life, raised by surprise."""
    return q * F.exp(age_days * F.lit(-0.0077)) * (F.lit(1.0) + surprise * 0.2)


def five_factor(similarity: Column, recency: Column, reliability: Column, reward: Column, reuse: Column, weights=(0.5, 0.1, 0.2, 0.1, 0.1)) -> Column:
    total = sum(weights)
    parts = (similarity, recency, reliability, reward, reuse)
    out = None
    for w, x in zip(weights, parts, strict=True):
        out = x * w if out is None else out + x * w
    return clamp(out / F.lit(total))


def four_factor(similarity: Column, recency: Column, reliability: Column, reuse: Column, weights=(0.5, 0.2, 0.2, 0.1)) -> Column:
    out = None
    for w, x in zip(weights, (similarity, recency, reliability, reuse), strict=True):
        out = x * w if out is None else out + x * w
    return clamp(out / F.lit(sum(weights)))


def evidence_quality(success_rate: Column, confidence: Column, effectiveness: Column, similarity: Column, age_days: Column) -> Column:
    base = success_rate * 0.4 + confidence * 0.3 + effectiveness * 0.2 + similarity * 0.1
    return base * F.when(age_days > 30, F.exp(-(age_days - 30) / F.lit(180.0))).otherwise(F.lit(1.0))


def beta_mean(a: Column, b: Column) -> Column:
    return a / (a + b)


def beta_variance(a: Column, b: Column) -> Column:
    return a * b / ((a + b) * (a + b) * (a + b + 1))


def beta_confidence(n: Column) -> Column:
    return F.lit(1.0) - F.lit(1.0) / (n + F.lit(1.0))


def brier(probability: Column, outcome: Column) -> Column:
    d = probability - F.when(outcome, F.lit(1.0)).otherwise(F.lit(0.0))
    return d * d


def base_reward(outcome: Column) -> Column:
    # The reward an outcome starts from.
    return F.when(outcome == "success", 0.9).when(outcome == "partial", 0.7).when(outcome == "neutral", 0.5).otherwise(0.2)


def reward_step(outcome: Column, security: Column | None = None) -> Column:
    # What one outcome adds to a reward.
    failed = F.when(security, -0.30).otherwise(-0.15) if security is not None else F.lit(-0.15)
    return F.when(outcome == "success", 0.10).when(outcome == "partial", 0.05).when(outcome == "failure", failed).otherwise(0.0)


def reward_modifiers(confidence: Column, context: Column, speed: Column, satisfaction: Column, verified: Column) -> Column:
    """Product of modifiers, kept within 0.5 and 1.5; a missing speed or satisfaction changes nothing."""
    one = F.lit(1.0)
    out = (confidence * 0.4 + 0.7) * (context * 0.2 + 0.8)
    out = out * F.coalesce(speed * 0.1 + 0.95, one) * F.coalesce(satisfaction * 0.4 + 0.8, one)
    return clamp(out * F.when(verified, F.lit(1.05)).otherwise(one), 0.5, 1.5)


def tier_by_score(reward: Column, reuse: Column) -> Column:
    return F.when((reward >= 0.9) & (reuse >= 20), "reflex").when((reward >= 0.7) & (reuse >= 5), "crystal").otherwise("booster")


def tier_with_hysteresis(reward: Column, reuse: Column, old: Column) -> Column:
    """The next tier: promotion by score, else one step down where the reward has fallen below a lower bar."""
    rank = lambda t: F.when(t == "reflex", 3).when(t == "crystal", 2).otherwise(1)
    new = tier_by_score(reward, reuse)
    return F.when(rank(new) > rank(old), new).when((old == "reflex") & (reward < 0.8), "crystal").when((old == "crystal") & (reward < 0.6), "booster").otherwise(old)


def temperature(days_since: Column, hits: Column) -> Column:
    return F.when((days_since <= 7) & (hits >= 3), "hot").when(days_since <= 30, "warm").otherwise("cold")


def wilson(positive: Column, n: Column, z: float, upper: bool) -> Column:
    p = positive / n.cast("double")
    mid = p + F.lit(z * z) / (n * 2)
    half = F.sqrt(p * (F.lit(1.0) - p) / n + F.lit(z * z) / (n * n * 4)) * z
    edge = (mid + half if upper else mid - half) / (F.lit(z * z) / n + 1)
    return F.when(n == 0, F.lit(1.0 if upper else 0.0)).otherwise(clamp(edge))


def fisher(p: Column) -> Column:
    """Fisher information of a success rate, over 25; near certainty counts little."""
    return F.least(F.when((p > 0.05) & (p < 0.95), F.lit(1.0) / (p * (F.lit(1.0) - p))).otherwise(F.lit(0.5)) / 25.0, F.lit(1.0))


def importance(successes: Column, total: Column) -> Column:
    p = successes / total.cast("double")
    usage = F.least(F.greatest(F.log(total.cast("double")), F.lit(1.0)) / 10.0, F.lit(1.0))
    return F.when(total == 0, F.lit(0.0)).otherwise(F.least(fisher(p) * 0.3 + p * 0.5 + usage * 0.2, F.lit(1.0)))


def protected_update(now: Column, proposed: Column, fisher_info: Column, important: Column, strength: float) -> Column:
    """A reward moves less the more important it is; changes below 0.001 pass."""
    change = proposed - now
    damp = F.when(important, F.lit(1.0) / (fisher_info * change * change * strength + 1)).otherwise(F.lit(1.0))
    return F.when(F.abs(change) < 0.001, proposed).otherwise(now + change * damp)


def metacognitive_quality(reward: Column, outcome: Column) -> Column:
    raw = reward * outcome
    return clamp(raw * (F.lit(1.0) - F.abs(reward - outcome) * 0.5 * (F.lit(1.0) - raw)))


def wormhole_decay(strength: Column, days_idle: Column, rate: float = 0.01) -> Column:
    """No decay for 30 idle days, then geometric."""
    return F.when(days_idle > 30, strength * F.pow(F.lit(1.0 - rate), days_idle - 30)).otherwise(strength)


def hierarchy_label(depth: Column) -> Column:
    out = F.when(depth.isNull(), "unclassified").when(depth < 0.2, "root").when(depth < 0.4, "high_level")
    return out.when(depth < 0.6, "mid_level").when(depth < 0.8, "detailed").otherwise("leaf")


def coherence_energy(penalty: Column, n_supports: Column) -> Column:
    """Penalties of conflicts (0.1 minor, 0.25 moderate, 0.5 major) against a bonus for support."""
    return clamp((F.lit(1.0) - F.least(penalty, F.lit(1.0))) * (F.least(n_supports * 0.1, F.lit(0.3)) + 1))


def coherence_action(n_conflicts: Column, n_major: Column, energy: Column, most: int = 3, threshold: float = 0.7) -> Column:
    return F.when(n_conflicts == 0, "accept").when(n_major > 0, "reject").when(n_conflicts > most, "review").when(energy >= threshold, "warn").otherwise("review")


def wilson_interval(positive: Column, n: Column, z: Column) -> tuple[Column, Column]:
    """Both ends of the Wilson interval for a z that may differ by row; without cases all of [0, 1]."""
    p = positive / n
    mid, half, whole = p + z * z / (n * 2), F.sqrt((p * (F.lit(1.0) - p) + z * z / (n * 4)) / n) * z, z * z / n + 1
    none = n == 0
    return F.when(none, 0.0).otherwise(clamp((mid - half) / whole)), F.when(none, 1.0).otherwise(clamp((mid + half) / whole))


def attention_after(x: Column, ticks: Column, rate: float) -> Column:
    return x * F.pow(F.lit(1.0 - rate), ticks)


def boosted(x: Column, factor: float, most: float = 1.0) -> Column:
    return clamp(x * factor, 0.0, most)


def inhibited(x: Column, factor: float) -> Column:
    return x * max(1.0 - factor, 0.0)
