"""Dates, numbers and scores as Column expressions (inventory 2.10, 2.11)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Weights of tracker similarity, evidence, citation and cross-validation; highest scores of facts that only a
# second tracker knows, that none knows, and that came from damaged output.
TRACKER, EVIDENCE, CITATION, CROSS = 0.50, 0.35, 0.15, 0.10
CAP_SECOND, CAP_NONE, CAP_AT_C = 0.69, 0.49, 0.6999
SOON_DAYS = 180


def tracker_points(similarity: Column) -> Column:
    """From 0.25 on: 1; from 0.10 on: 0.5 to 1; below: 0.3."""
    return F.when(similarity >= 0.25, 1.0).when(similarity >= 0.10, 0.5 + (similarity - 0.10) / 0.15 * 0.5).otherwise(0.3)


def evidence(verified_share: Column, longest_share: Column) -> Column:
    """Share of verified spans, cut where one of them quotes over half, or over three quarters, of its passage."""
    return verified_share * F.when(longest_share > 0.75, 0.6).when(longest_share > 0.5, 0.8).otherwise(1.0)


def confidence(similarity: Column, grounding: Column, citation: Column, cross: Column, second_tracker: Column) -> Column:
    """A weighted sum of which a cross-validation score, where there is one, takes a tenth. Without a tracker's similarity (null)
    the other parts are averaged by weight, and the score stays below tier B (a second tracker knows the law) or C."""
    base = TRACKER * tracker_points(similarity) + EVIDENCE * grounding + CITATION * citation
    known = F.when(cross.isNull(), base).otherwise((1 - CROSS) * base + CROSS * cross)
    rest = EVIDENCE * grounding + CITATION * citation
    alone = F.when(cross.isNull(), rest / (EVIDENCE + CITATION)).otherwise((rest + CROSS * cross) / (EVIDENCE + CITATION + CROSS))
    capped = F.when(second_tracker, F.least(alone, F.lit(CAP_SECOND))).otherwise(F.least(alone, F.lit(CAP_NONE)))
    return F.when(similarity.isNull(), capped).otherwise(known)


def damaged(score: Column, is_damaged: Column) -> Column:
    """Scores of truncated or repaired output stay in tier C."""
    return F.when(is_damaged, F.least(score, F.lit(CAP_AT_C))).otherwise(score)


def dimensions(grounding: Column, citation: Column, tracker: Column, valid: Column, completeness: Column, second: Column) -> Column:
    """struct(source_grounding, tracker_alignment, schema_completeness): the score's parts, side by side."""
    both = F.when(tracker > 0, tracker * 0.6 + second * 0.4).otherwise(second)
    return F.struct(
        rounded(grounding * 0.7 + citation * 0.3).alias("source_grounding"),
        rounded(F.when(second.isNull(), tracker).otherwise(both)).alias("tracker_alignment"),
        rounded(valid * 0.5 + completeness * 0.5).alias("schema_completeness"),
    )


def rounded(c: Column, places: int = 4) -> Column:
    """Halves go up, computed in doubles, so that other engines can say the same."""
    return F.floor(c * 10**places + 0.5) / 10**places


def weighted_mean(parts: list[tuple[float, Column]]) -> Column:
    """Of the parts that are there; weights of missing ones go to the others."""
    total = sum((F.when(c.isNotNull(), F.lit(w)).otherwise(0.0) for w, c in parts), F.lit(0.0))
    value = sum((F.coalesce(c * w, F.lit(0.0)) for w, c in parts), F.lit(0.0))
    return F.when(total > 0, value / total)


def date_of(c: Column) -> Column:
    """ISO, US, dotted or compact; else null. Words such as `pending` are no date."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in ("yyyy-MM-dd", "MM/dd/yyyy", "dd.MM.yyyy", "yyyyMMdd")]).cast("date")


def urgency(deadline: Column, today: Column) -> Column:
    days = F.datediff(deadline, today)
    return F.when(days.isNull(), "unknown").when(days <= 0, "now").when(days <= SOON_DAYS, "soon").otherwise("future")


def age_label(hours: Column) -> Column:
    of = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(unit))
    return F.when(hours < 1, "just now").when(hours < 24, of(hours, "h ago")).when(hours < 24 * 30, of(hours / 24, "d ago")).otherwise(of(hours / (24 * 30), "mo ago"))


# How numbers of a unit are written; the second of a pair is the factor to the unit's base.
UNITS = {
    "usd": ((r"(?i)\$\s*([0-9,]+(?:\.[0-9]+)?)", 1.0), (r"(?i)(?:^|[^0-9.])([0-9,]{4,}(?:\.[0-9]+)?)\s*dollars", 1.0)),
    "days": ((r"(?i)([0-9]+)\s*(?:calendar\s+|business\s+)?days?\b", 1.0),),
    "hours": ((r"(?i)([0-9]+)[\s-]*hours?\b", 1.0),),
    "months": ((r"(?i)([0-9]+)\s*months?\b", 1.0), (r"(?i)([0-9]+)\s*years?\b", 12.0)),
    "count": ((r"(?<![0-9.,$])([0-9,]{1,12})(?![0-9])", 1.0),),
}
POWERS = (r"([0-9]+(?:\.[0-9]+)?)\s*\^\s*([0-9]+)", r"(?i)([0-9]+(?:\.[0-9]+)?)\s*x\s*10\s*\^?\s*([0-9]+)", r"([0-9]+(?:\.[0-9]+)?)\s*[eE]\s*([0-9]+)")
FLOPS_TOLERANCE, FLOPS_LEAST = 0.01, 1e9


def _plain(pattern: str, factor: float, c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    return F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double") * factor)


def candidates(c: Column, unit: str) -> Column:
    """Numbers of a unit that a text states, in the unit's base; `flops` also knows powers."""
    if unit != "flops":
        return F.array_compact(F.concat(*[_plain(p, f, c) for p, f in UNITS[unit]]))
    parts = [F.arrays_zip(F.regexp_extract_all(c, F.lit(p), F.lit(1)).alias("m"), F.regexp_extract_all(c, F.lit(p), F.lit(2)).alias("e")) for p in POWERS]
    number = lambda s, k: s[k].cast("double")
    bare = F.transform(parts[0], lambda s: F.pow(number(s, "m"), number(s, "e")))
    tens = [F.transform(a, lambda s: number(s, "m") * F.pow(F.lit(10.0), number(s, "e"))) for a in parts[1:]]
    large = F.filter(candidates(c, "count"), lambda x: x >= FLOPS_LEAST)
    return F.concat(bare, *tens, large)


def grounded(value: Column, text: Column, unit: str) -> Column:
    """Whether the text states the value: grounded, mismatch, or unverifiable where it states none of that unit; null: no value."""
    found = candidates(F.coalesce(text, F.lit("")), unit)
    if unit == "flops":
        agrees = lambda x: F.when(x == 0, value == 0).otherwise(F.abs(value - x) / F.nullif(x, F.lit(0.0)) <= FLOPS_TOLERANCE)
    else:
        agrees = lambda x: F.abs(value - x) < 1e-6
    return F.when(value.isNull(), F.lit(None)).when(F.size(found) == 0, "unverifiable").when(F.exists(found, agrees), "grounded").otherwise("mismatch")


def digits(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, "[^0-9]", ""), F.lit("")).try_cast("bigint")


def token_budget(limit: Column, length: Column) -> Column:
    share = F.when(length < 2000, 0.5).when(length < 8000, 0.75).otherwise(1.0)
    return F.greatest(F.lit(2048), (limit * share).cast("int"))
