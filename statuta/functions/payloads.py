"""Payloads of extracted facts: their schemas, the kind of fact that they hold, and the flat form of the serving side
(inventory 2.12.6, 2.12.8, 2.12.9)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import bound, strip

TIMELINE = "struct<effective_date: string, compliance_deadline: string, sunset_date: string, phase_in_period: string, timeline_text: string, date_parse_status: map<string, string>>"
ENFORCEMENT = "struct<enforcing_body: string, penalty_type: string, penalty_description: string, private_right_of_action: boolean, max_civil_penalty_usd: bigint, cure_period_days: int, enforcement_text: string>"
OBLIGATION = f"subject string, subject_normalized string, modality string, action string, object string, condition string, jurisdiction string, obligation_family string, timeline {TIMELINE}, enforcement {ENFORCEMENT}"
DEFINITION = "term string, definition_text string, scope string, cross_references array<string>, actors array<struct<actor_name: string, actor_type: string>>, framework_refs array<struct<framework_name: string, section_or_standard: string>>"
THRESHOLD = "threshold_type string, threshold_value string, threshold_unit string, threshold_condition string, threshold_sub_type string, applies_to_obligation string, compute_flops double, sector_applicability string, exceptions array<struct<exception_type: string, description: string>>"
AMBIGUITY = "ambiguous_text string, ambiguity_type string, severity string, affected_obligations string, interpretation_notes string, suggested_clarification string"
# Words of a subject that enforces, beginnings of words of what it imposes.
ENFORCERS = (
    "court", "judge", "judicial_authority", "attorney_general", "ag", "commission", "prosecutor", "district_attorney", "secretary",
    "commissioner", "regulator", "agency",
)
PENALTY_VERBS = ("fine", "penalt", "sanction", "forfeit", "assess", "impose", "award")
# Date fields of a timeline, and the kind of deadline that each is.
DEADLINES = {"effective_date": "effective", "compliance_deadline": "compliance", "sunset_date": "sunset"}


def parsed(c: Column) -> Column:
    """A text that is one JSON value and nothing else as a variant, else null. Spark's parser takes the first value of a text and leaves
    what follows; as the value of a list and of an object at once it has to end where the text does."""
    as_value = lambda t, before, after: F.try_parse_json(F.concat(F.lit(before), t, F.lit(after)))
    whole = lambda t: as_value(t, "[", "]").isNotNull() & as_value(t, '{"v":', "}").isNotNull()
    return bound(c, lambda t: bound(F.try_parse_json(t), lambda v: F.when(v.isNotNull() & whole(t), v)))


def _filled(*columns: Column) -> Column:
    """Whether one of them is neither null nor empty."""
    return F.coalesce(F.nullif(F.concat_ws("", *columns), F.lit("")).isNotNull(), F.lit(False))


def _both(a: Column, b: Column) -> Column:
    return (F.coalesce(strip(a), F.lit("")) != "") & (F.coalesce(strip(b), F.lit("")) != "")


def _some(items: Column) -> Column:
    return F.coalesce(F.size(items), F.lit(0)) > 0


def _any(text: Column, words) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def obligation_type(p: Column) -> Column:
    """obligation, or enforcement or timeline where that is all it tells; a court that imposes penalties enforces."""
    e, t = p["enforcement"], p["timeline"]
    core, enforced = _both(p["subject"], p["action"]), _filled(e["enforcing_body"], e["penalty_type"], e["penalty_description"])
    dated = _filled(t["effective_date"], t["compliance_deadline"], t["sunset_date"], t["phase_in_period"])
    subject = F.lower(F.coalesce(F.nullif(p["subject_normalized"], F.lit("")), p["subject"], F.lit("")))
    imposes = _any(subject, ENFORCERS) & _any(F.lower(F.coalesce(p["action"], F.lit(""))), PENALTY_VERBS)
    return F.when(enforced & (~core | imposes), "enforcement").when(~core & dated, "timeline").otherwise("obligation")


def definition_type(p: Column) -> Column:
    core = _both(p["term"], p["definition_text"])
    return F.when(core, "definition").when(_some(p["actors"]), "actor_mapping").when(_some(p["framework_refs"]), "framework_ref").otherwise("definition")


def threshold_type(p: Column) -> Column:
    """By the stated sub-type; without one, exceptions alone are an exception."""
    sub, stated = F.coalesce(p["threshold_sub_type"], F.lit("")), _filled(p["threshold_type"], p["threshold_value"], p["threshold_condition"])
    return F.when(sub == "exemption", "exception").when(sub.isin("scope", "temporal", "other"), "threshold").when(~stated & _some(p["exceptions"]), "exception").otherwise("threshold")


#: Which agent's payloads may be of several types; payloads of all others have their agent's only one.
TYPES = {"obligation": obligation_type, "definition_actor": definition_type, "threshold_exception": threshold_type}


def _listed(*parts: Column) -> Column:
    return F.nullif(F.concat_ws("; ", *[F.nullif(p, F.lit("")) for p in parts]), F.lit(""))


def _led(words: str, value: Column) -> Column:
    return F.when(value != "", F.concat(F.lit(words), value))


def _joined(items: Column, one) -> Column:
    return F.when(_some(items), F.array_join(F.transform(items, one), "; "))


def _adapt_obligation(p: Column) -> Column:
    t, e = p["timeline"], p["enforcement"]
    timeline = _listed(_led("Effective: ", t["effective_date"]), _led("Deadline: ", t["compliance_deadline"]), _led("Sunset: ", t["sunset_date"]), _led("Phase-in: ", t["phase_in_period"]), t["timeline_text"])
    right = F.when(e["private_right_of_action"], "Private right of action: Yes")
    enforcement = _listed(_led("Enforced by: ", e["enforcing_body"]), _led("Penalty: ", e["penalty_type"]), e["penalty_description"], right, e["enforcement_text"])
    # only dates known to be parsed are deadlines
    dated = [F.when((t["date_parse_status"][f] == "parsed") & (t[f] != ""), F.struct(F.lit(kind).alias("deadline_type"), t[f].alias("deadline_date"))) for f, kind in DEADLINES.items()]
    own = [p[c].alias(c) for c in ("subject", "subject_normalized", "modality", "action", "object", "condition", "jurisdiction", "obligation_family")]
    kept = [e[c].alias(c) for c in ("private_right_of_action", "max_civil_penalty_usd", "cure_period_days")]
    return F.struct(*own, timeline.alias("timeline"), t.alias("timeline_structured"), F.array_compact(F.array(*dated)).alias("deadlines"), enforcement.alias("enforcement"), *kept, e["enforcing_body"].alias("enforcement_authority"))


def _adapt_threshold(p: Column) -> Column:
    own = [p[c].alias(c) for c in ("threshold_type", "threshold_value", "threshold_unit", "threshold_condition", "applies_to_obligation", "compute_flops", "sector_applicability")]
    said = _joined(p["exceptions"], lambda x: F.concat(F.when(x["exception_type"] != "", F.concat(x["exception_type"], F.lit(": "))).otherwise(""), F.coalesce(x["description"], F.lit(""))))
    return F.struct(*own, said.alias("exceptions"))


def _adapt_definition(p: Column) -> Column:
    named = lambda name, more: lambda x: F.concat(F.coalesce(x[name], F.lit("")), F.when(x[more] != "", F.concat(F.lit(" ("), x[more], F.lit(")"))).otherwise(""))
    actors, refs = _joined(p["actors"], named("actor_name", "actor_type")), _joined(p["framework_refs"], named("framework_name", "section_or_standard"))
    return F.struct(p["term"].alias("term"), p["definition_text"].alias("definition_text"), p["scope"].alias("scope"), actors.alias("actors"), _joined(p["cross_references"], lambda x: x).alias("cross_references"), refs.alias("framework_refs"))


def _adapt_ambiguity(p: Column) -> Column:
    return F.struct(*[p[c.split()[0]].alias(c.split()[0]) for c in AMBIGUITY.split(", ")])


ADAPTERS = {"obligation": _adapt_obligation, "threshold": _adapt_threshold, "exception": _adapt_threshold, "definition": _adapt_definition, "ambiguity": _adapt_ambiguity}


def adapted(kind: str, payload: Column) -> Column:
    """The payload's flat form, its fields all there even if null; kinds without one pass as they are."""
    return bound(payload, ADAPTERS[kind]) if kind in ADAPTERS else payload
