"""Scalar scoring: substance, salience, sensitivity, routing, confidence, verdicts, conformal steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_of, n_words, trim_u

# Phrases, lexicons, stakes and weights that results depend on.
CONTRAST = ("not because", "but because", "instead of", " not a ", " not the ", "değil", " ama ", "yerine", " vs ", "rather than")
HUMAN = ("i just love", "i wish", "the truth is", "i stopped", "i kept", "ben ", "kendi", "bu yüzden", "aslında")
HEALTH = ("hasta", "hastalık", "teşhis", "tedavi", "ameliyat", "ilaç", "tanı", "kanser", "depresyon", "terapi", "psikiyatr", "diagnos", "surgery", "chemo", "therapy", "medication", "hospital", "hastane", "semptom")
FINANCE = ("maaş", "salary", "borç", "kredi", "gelir", "kazanç", "ciro", "revenue", "net worth", "servet")
FAMILY = ("annem", "babam", "kardeşim", "ailemin", "my mom", "my mother", "my dad", "my father", "my sister", "my brother")
STRONG_HEALTH = ("kanser", "depresyon", "psikiyatr", "chemo", "ameliyat")
MONEY = r"[$₺€£]\s?\d[\d.,]*\s?(?:k|m|bin|milyon)?|\d[\d.,]*\s?(?:tl|try|usd|eur|dolar|euro|lira|₺)"
REVERSIBLE = ("ucuz", "düşük", "dusuk", "cheap", "low", "kolay", "revert")
STAKES = {"decision": 0.9, "idea": 0.8, "report": 0.6, "projectdoc": 0.5, "writing": 0.4}
TRUE_WORDS = ("true", "yes", "evet", "pass", "1", "geçti", "gecti")
FALSE_WORDS = ("false", "no", "hayır", "hayir", "fail", "0", "ihlal")
PRIVATE_CHANNELS = ("notes", "personal")


def substance_prior(body: Column) -> Column:
    """1 to 10 from length, numbers, contrast and stance of the text itself."""
    # Bound once each by a lambda: as plain expressions they would be evaluated at every use.
    parts = F.transform(
        F.array(trim_u(F.coalesce(body, F.lit("")))),
        lambda t: F.struct(
            (t == "").alias("empty"), F.lower(t).alias("low"), n_words(t).alias("n"), F.regexp_count(t, F.lit(r"(?U)\b\d[\d.,]*\b")).alias("numbers"),
            (F.length(t) - F.length(F.translate(t, ".\n", ""))).alias("stops"),
        ),
    )
    return F.element_at(F.transform(parts, _substance), 1)


def _substance(p: Column) -> Column:
    low, n, numbers, stops = p["low"], p["n"], p["numbers"], p["stops"]

    def add(when: Column, points: float) -> Column:
        return F.when(when, F.lit(points)).otherwise(F.lit(0.0))

    score = F.lit(3.0) + add(n >= 40, 1.0) + add(n >= 120, 1.0) + add(n < 20, -1.5)
    score = score + add(numbers >= 1, 0.7) + add(numbers >= 3, 0.6)
    score = score + add(any_of(low, CONTRAST), 0.8) + add(any_of(low, HUMAN), 0.6)
    score = score + add((stops <= 1) & (n < 30), -1.0)
    return F.when(p["empty"], F.lit(1.0)).otherwise(clamp(score, 1.0, 10.0))


def clamp(x: Column, low: float, high: float) -> Column:
    """x within the bounds; null stays null, which least and greatest would skip."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def salience(body: Column, passed: Column | None = None, items: Column | None = None, smells: Column | None = None, approved: Column | None = None) -> Column:
    """share of passed items (nudged by the holistic judgement), else substance; short texts lose 2, approval is 10."""
    score = substance_prior(body)
    if items is not None:
        share = F.lit(1.0) + F.lit(9.0) * passed / items
        nudged = F.when(F.coalesce(smells, F.lit(False)), F.least(F.lit(9.0), share + 0.5)).otherwise(share)
        score = F.when(F.coalesce(items, F.lit(0)) > 0, nudged).otherwise(score)
    score = score - F.when(n_words(F.coalesce(body, F.lit(""))) < 40, 2.0).otherwise(0.0)
    if approved is not None:
        score = F.when(F.coalesce(approved, F.lit(False)), 10.0).otherwise(score)
    return clamp(F.bround(score, 1), 1.0, 10.0)


def pass_summary(passed: Column, items: Column) -> Column:
    """G7: 'p/n', or 'unscored' without items."""
    return F.when(F.coalesce(items, F.lit(0)) > 0, F.format_string("%d/%d", passed, items)).otherwise("unscored")


def has_money(text: Column) -> Column:
    return text.rlike("(?i)" + MONEY)


def structural_hit(sentence: Column) -> Column:
    """First reason for which a sentence is sensitive, else null."""
    low = F.lower(sentence)
    family = any_of(low, FAMILY)
    return (
        F.when(has_money(sentence), "money")
        .when(family & any_of(low, HEALTH), "family+health")
        .when(family & any_of(low, FINANCE), "family+finance")
        .when(any_of(low, STRONG_HEALTH), "health")
    )


def trace_sensitive(flag: Column, channel: Column, body: Column) -> Column:
    """Marked, from a private channel, or a private fact with a private name. Unknown is not safe to quote only if marked."""
    low = F.lower(F.coalesce(body, F.lit("")))
    private = any_of(low, FAMILY) & (any_of(low, HEALTH) | has_money(low))
    return F.coalesce(flag, F.lit(False)) | F.coalesce(channel.isin(*PRIVATE_CHANNELS), F.lit(False)) | private


def is_reversible(cost: Column) -> Column:
    """P5: does the cost of taking a decision back read as low?"""
    return any_of(F.lower(F.coalesce(cost, F.lit(""))), REVERSIBLE)


def familiarity(weight: Column, score: Column) -> Column:
    """F13."""
    return F.lit(0.65) * F.coalesce(weight, F.lit(0.0)) + F.lit(0.35) * F.least(F.lit(1.0), F.coalesce(score, F.lit(0.0)) / 0.6)


def route(channel: Column, weight: Column, score: Column, max_iter: int = 4, k: int = 3) -> Column:
    """struct(path, max_iter, k, abstain_floor, sure_bar, familiarity, stakes)."""
    fam = familiarity(weight, score)
    stakes = F.lit(0.5)
    for name, value in STAKES.items():
        stakes = F.when(channel == name, F.lit(value)).otherwise(stakes)
    fast = (fam >= 0.6) & (stakes < 0.7)
    extra = F.when((fam < 0.4) | (stakes >= 0.85), 1).otherwise(0)
    return F.struct(
        F.when(fast, "fast").otherwise("slow").alias("path"),
        F.when(fast, F.lit(max(2, max_iter - 2))).otherwise(F.lit(max_iter) + extra).cast("long").alias("max_iter"),
        F.when(fast, F.lit(k)).otherwise(F.lit(k + 2)).cast("long").alias("k"),
        F.when(fast, F.lit(0.45)).otherwise(F.lit(0.45) + F.lit(0.15) * stakes).alias("abstain_floor"),
        F.when(fast, F.lit(0.78)).otherwise(F.lit(0.78) + F.lit(0.07) * stakes).alias("sure_bar"),
        fam.alias("familiarity"),
        stakes.alias("stakes"),
    )


def assess(law: Column, any_fail: Column, smells: Column, weight: Column, score: Column, iterations: Column, max_iter: Column, floor: Column | float = 0.45, bar: Column | float = 0.78) -> Column:
    """struct(score, verdict, weakest, law, voice_fit, grounding, effort)."""
    voice = F.coalesce(weight, F.lit(0.4))
    ground = F.coalesce(clamp(score / 0.5, float("-inf"), 1.0), F.lit(0.5))
    effort = F.lit(1.0) - F.greatest(F.lit(0), iterations - 1) / F.greatest(F.lit(1), max_iter)
    blend = F.lit(0.45) * law + F.lit(0.22) * voice + F.lit(0.18) * ground + F.lit(0.15) * effort
    blend = F.when(smells, F.least(F.lit(1.0), blend + 0.03)).when(~smells, F.greatest(F.lit(0.0), blend - 0.08)).otherwise(blend)
    floor = F.lit(floor) if isinstance(floor, float) else floor
    bar = F.lit(bar) if isinstance(bar, float) else bar
    verdict = F.when(blend < floor, "abstain").when((blend >= bar) & ~F.coalesce(any_fail, F.lit(True)), "sure").otherwise("tentative")
    parts = (("law", law), ("voice_fit", voice), ("grounding", ground), ("effort", effort))
    order = F.array(*[F.struct(value.alias("value"), F.lit(k).alias("k"), F.lit(name).alias("name")) for k, (name, value) in enumerate(parts)])
    return F.struct(blend.alias("score"), verdict.alias("verdict"), F.array_min(order)["name"].alias("weakest"), *[v.alias(n) for n, v in parts])


def confidence_line(verdict: Column, score: Column, weakest: Column) -> Column:
    """F16: one sentence that states the certainty and what is weakest. Halves of a percent go to the even number."""
    percent = F.format_string("%d%%", F.bround(score * 100, 0).cast("int"))
    return (
        F.when(verdict == "abstain", F.concat(F.lit("abstaining ("), percent, F.lit("); weakest: "), weakest))
        .when(verdict == "sure", F.concat(F.lit("very likely ("), percent, F.lit(")")))
        .otherwise(F.concat(F.lit("possible, not certain ("), percent, F.lit("); weakest: "), weakest))
    )


def as_bool(value: Column) -> Column:
    """a judge's boolean in any of its spellings; null if it can't be read."""
    low = F.lower(trim_u(value))
    number = low.try_cast("double")
    return F.when(low.isin(*TRUE_WORDS), True).when(low.isin(*FALSE_WORDS), False).when(number.isNotNull(), number != 0)


def nonconformity(proximity: Column) -> Column:
    """F6."""
    return F.lit(1.0) - clamp(proximity, 0.0, 1.0)


def recency_date(date: Column) -> Column:
    """Dates of the form DD.MM.YYYY; others have none."""
    return F.try_to_date(F.when(date.rlike(r"^\d{2}\.\d{2}\.\d{4}\z"), date), "dd.MM.yyyy")
