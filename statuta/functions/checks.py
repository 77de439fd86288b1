"""Checks of what a model or an editor says: edited values, quotes, gaps, alignment, likeness to a tracker (inventory 2.8.12,
2.9.11, 2.11.18, 2.11.20, 2.13.16, 2.14.2, 2.14.6, 2.14.7)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .rules import normal_date
from .text import bound, jaccard, loose, strip, tokens

# Whom a tracker's scope codes cover.
_EVERYONE = ("developer", "provider", "deployer", "operator", "distributor", "compute_provider", "controller", "processor", "data_broker", "regulator", "government_agency", "individual", "regulated_entity")
SCOPES = {
    "G": _EVERYONE,
    "G*": _EVERYONE,
    "F": ("developer", "provider", "compute_provider"),
    "D": ("deployer", "operator", "controller", "data_broker"),
    "A": ("developer", "provider", "deployer", "operator", "controller", "processor", "regulated_entity"),
    "A*": ("developer", "provider", "deployer", "operator", "controller", "processor", "data_broker", "regulated_entity"),
}
TRUE, FALSE = ("true", "yes", "1"), ("false", "no", "0")
REQUIREMENTS, ENFORCEMENT = 0.6, 0.4
SAMPLE = 20


def edited_value(widget: Column, value: Column, choices: Column | None = None) -> Column:
    """struct(valid, value, note) of an edit, the value as text: numbers plain, dates in ISO form, booleans as true and false. An
    unknown choice is kept and noted; read-only and grouped fields take none."""
    made = lambda ok, v, note: F.struct(F.lit(ok).alias("valid"), v.cast("string").alias("value"), F.lit(note).cast("string").alias("note"))
    empty = F.coalesce(value, F.lit("")) == ""
    number, day, low = value.try_cast("double"), normal_date(value), F.lower(strip(value))
    plain = F.when(number == F.floor(number), number.cast("long").cast("string")).otherwise(number.cast("string"))
    unknown = ~F.coalesce(F.array_contains(choices, value), F.lit(True)) if choices is not None else F.lit(False)
    return (
        F.when(widget == "readonly", made(False, value, "system field"))
        .when(widget.isin("nested", "list_nested"), made(False, value, "group of fields"))
        .when(widget.isin("number", "date", "boolean") & empty, made(True, F.lit(None), None))
        .when(widget == "number", F.when(number.isNull(), made(False, value, "no number")).otherwise(made(True, plain, None)))
        .when(widget == "date", F.when(day.isNull(), made(False, value, "no date")).otherwise(made(True, day, None)))
        .when(widget == "boolean", F.when(low.isin(*TRUE), made(True, F.lit("true"), None)).when(low.isin(*FALSE), made(True, F.lit("false"), None)).otherwise(made(False, value, "neither yes nor no")))
        .when((widget == "select") & ~empty & unknown, made(True, value, "not a standard value"))
        .otherwise(made(True, value, None))
    )


def scope_actors(codes: Column) -> Column:
    """Actors that a list of scope codes, with commas, covers."""
    of = F.create_map(*[x for k, v in SCOPES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.array_distinct(F.flatten(F.filter(F.transform(F.split(codes, ","), lambda c: of[strip(c)]), lambda a: a.isNotNull())))


def alignment(actor: Column, codes: Column) -> Column:
    """aligned, scope_mismatch, or tracker_silent where nothing is known about the law, its scope or the actor."""
    actors = scope_actors(codes)
    silent = (F.coalesce(codes, F.lit("")) == "") | (F.coalesce(actor, F.lit("")) == "") | (F.coalesce(F.size(actors), F.lit(0)) == 0)
    return F.when(silent, "tracker_silent").when(F.array_contains(actors, actor), "aligned").otherwise("scope_mismatch")


def tracker_likeness(texts: Column, requirements: Column, enforcement: Column) -> Column:
    """struct(requirements, enforcement, combined, matched) of a payload's texts (an array) against a tracker's two cells; null
    cells weigh nothing, and combined is null without either. `matched`: the first 20 shared words."""
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    words = F.struct(tokens(F.array_join(texts, " ")).alias("own"), tokens(F.coalesce(requirements, F.lit(""))).alias("r"), tokens(F.coalesce(enforcement, F.lit(""))).alias("e"))
    rounded = lambda c: F.floor(c * 10000 + 0.5) / 10000

    def compared(w: Column) -> Column:
        r, e = jaccard(w["own"], w["r"]), jaccard(w["own"], w["e"])
        both = F.when(given(requirements) & given(enforcement), REQUIREMENTS * r + ENFORCEMENT * e).when(given(requirements), r).when(given(enforcement), e)
        shared = F.sort_array(F.array_union(F.array_intersect(w["own"], w["r"]), F.array_intersect(w["own"], w["e"])))
        return F.struct(rounded(r).alias("requirements"), rounded(e).alias("enforcement"), rounded(both).alias("combined"), F.slice(shared, 1, SAMPLE).alias("matched"))

    return bound(words, compared)


def quoted_in(passage: Column, quote: Column) -> Column:
    """Whether a passage holds a quote, whatever case and signs; an empty quote is in none. Only a passage that has all words of its quote
    somewhere is taken apart."""

    def held(asked: Column) -> Column:
        words = bound(F.lower(passage), lambda low: F.forall(F.split(asked, " "), lambda w: F.contains(low, w)))
        return (F.coalesce(asked, F.lit("")) != "") & F.coalesce(words & F.contains(loose(passage), asked), F.lit(False))

    return bound(loose(quote), held)


def guarded_clause(passage: Column, clause: Column) -> Column:
    """A quoted clause, null unless the passage holds it."""
    return F.when(quoted_in(passage, clause), clause)


def backoff_seconds(attempt: Column, retry_after: Column, share: Column, cap: float = 60.0, jitter: float = 0.25) -> Column:
    """Seconds before the next attempt: what the server asks for, else a power of two, capped, and moved by a `share` of -1 to 1
    of the jitter."""
    base = F.least(F.coalesce(F.when(retry_after > 0, retry_after), F.pow(F.lit(2.0), attempt)), F.lit(cap))
    return F.greatest(F.lit(0.0), base + base * jitter * share)


def foreign_token(token: Column, current: Column) -> Column:
    """Whether an edit was begun under another state of its record: its token and the record's are told and differ, whatever
    their order."""
    return F.coalesce(token != current, F.lit(False))
