"""Text quality score and bands (X-07, X-08)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom import rules
from paperloom.functions.regex import SPACE, first_match, let, strip


def _without(text: Column, part: str) -> Column:
    return F.replace(text, F.lit(part), F.lit(""))


def _counts(text: Column) -> Column:
    """Counts by removing long runs: far fewer matches than one per character."""
    single_spaced = F.regexp_replace(text, f"{SPACE}+", " ")
    return let(
        single_spaced,
        lambda spaced: F.struct(
            F.length(text).alias("chars"),
            F.length(F.regexp_replace(text, "[^֐-׿]+", "")).alias("hebrew"),
            # the letter count only matters where there is Hebrew at all
            F.when(text.rlike("[֐-׿]"), F.length(F.regexp_replace(text, r"\P{L}+", ""))).otherwise(F.lit(0)).alias("letters"),
            F.length(_without(spaced, " ")).alias("solid"),
            (F.length(spaced) - F.length(_without(spaced, " ")) + 1).alias("words"),
            (F.length(text) - F.length(F.regexp_replace(text, rules.CONSONANT_RUN, ""))).alias("run_chars"),
            (F.length(text) - F.length(_without(text, "\n")) + 1).alias("lines"),
        ),
    )


def _script_signal(n: Column, lang: str) -> Column:
    if lang != "heb":
        return F.lit(rules.NEUTRAL_LANG_SCORE)
    share = F.when(n["letters"] > 0, n["hebrew"] / F.greatest(n["letters"], F.lit(1))).otherwise(F.lit(0.0))
    return first_match([(share >= t, F.lit(s)) for t, s in rules.HEBREW_RATIO_TIERS], F.lit(rules.HEBREW_RATIO_FLOOR))


def _word_signal(n: Column) -> Column:
    mean = n["solid"] / F.greatest(n["words"], F.lit(1))
    return first_match([(mean.between(lo, hi), F.lit(s)) for lo, hi, s in rules.WORD_LENGTH_TIERS], F.lit(rules.WORD_LENGTH_FLOOR))


def _noise_signal(n: Column) -> Column:
    share = n["run_chars"] / F.greatest(n["chars"], F.lit(1))
    return first_match([(share < t, F.lit(s)) for t, s in rules.CONSONANT_TIERS], F.lit(rules.CONSONANT_FLOOR))


def _line_signal(n: Column) -> Column:
    return first_match(
        [(n["lines"] >= 3, F.lit(1.0)), (n["lines"] == 2, F.lit(0.7)), (n["chars"] < 100, F.lit(0.6))], F.lit(0.3)
    )


def quality_score(text: Column, lang: str = "heb") -> Column:
    """X-07: four tiered signals, weighted, in [0, 1]; blank text scores 0."""

    def score(n: Column) -> Column:
        signals = [_script_signal(n, lang), _word_signal(n), _noise_signal(n), _line_signal(n)]
        weighted = [s * F.lit(w) for s, w in zip(signals, rules.QUALITY_WEIGHTS)]
        total = weighted[0] + weighted[1] + weighted[2] + weighted[3]
        return F.when(n["chars"] == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))

    return let(strip(F.coalesce(text, F.lit(""))), lambda clean: let(_counts(clean), score))


def quality_band(score: Column) -> Column:
    """X-08."""
    return first_match(
        [(score >= rules.GOOD_QUALITY, F.lit("GOOD")), (score >= rules.BORDERLINE_QUALITY, F.lit("BORDERLINE"))],
        F.lit("LOW"),
    )
