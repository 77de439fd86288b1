"""Facts in a sentence or two for readers, by templates, and what a law's facts say of whom it covers (inventory 2.4.19, 2.9.61).

A payload is a JSON text; nulls count as missing. Everything is a Column expression over one parse of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: What templates read of a payload.
PAYLOAD = """
subject string, subject_normalized string, modality string, action string, condition string, section_reference string,
timeline struct<effective_date:string,compliance_deadline:string,phase_in_period:string>,
enforcement struct<enforcing_body:string,max_civil_penalty_usd:bigint,private_right_of_action:boolean,cure_period_days:bigint>, enforcing_body string,
threshold_value string, threshold_unit string, threshold_condition string, compute_flops double, compute_description string, sector_applicability array<string>,
applies_to_obligation string, exceptions array<struct<exception_type:string,description:string>>,
term string, definition_text string, scope string, actors array<struct<actor_name:string>>, framework_refs array<struct<framework_name:string>>,
ambiguity_type string, severity string, ambiguous_text string, interpretation_notes string, suggested_clarification string,
right_holder string, right_holder_normalized string, right_type string, right_description string, duty_bearer string, trigger_condition string,
remedies array<struct<remedy_type:string,description:string>>,
mechanism_type string, responsible_party string, responsible_party_normalized string, description string, reporting_frequency string, reporting_recipient string,
is_bias_testing boolean, is_red_teaming boolean, is_third_party_audit boolean, assessment_frequency_months bigint, incident_reporting_hours bigint, nist_measure_refs array<string>,
conflict_type string, related_authority string, preemption_language string
""".replace("\n", " ")

# Words that tell an exemption of small businesses.
SMALL_BUSINESS = ("small business", "small businesses", "small entity", "small entities", "smaller business")


def title(c: Column) -> Column:
    """Each run of letters with a capital first letter and small ones behind it; what is no letter stays."""
    runs = F.regexp_extract_all(c, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30)))), "")


def _given(c: Column) -> Column:
    """A text, null where it is empty."""
    return F.nullif(c, F.lit(""))


def _or(c: Column, other: str) -> Column:
    return F.coalesce(_given(c), F.lit(other))


def _head(c: Column, most: int) -> Column:
    return F.substring(c, 1, most)


def _say(template: str, *values: Column) -> Column:
    """The template with each {} replaced by a value in turn; null if one of them is null."""
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for value, rest in zip(values, parts[1:]):
        out += [value, F.lit(rest)]
    return F.concat(*out)


def _words(c: Column) -> Column:
    return F.replace(F.coalesce(c, F.lit("")), F.lit("_"), F.lit(" "))


def _list(items: Column, most: int, f: Callable[[Column], Column]) -> Column:
    """Up to `most` items in words, null for none."""
    told = F.array_compact(F.transform(F.slice(items, 1, most), f))
    return F.when(F.size(told) > 0, told)


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _money(c: Column) -> Column:
    return F.format_number(c, 0)


def obligation(p: Column, place: Column) -> Column:
    who = title(F.coalesce(_given(p["subject_normalized"]), _given(p["subject"]), F.lit("Entity")))
    first = F.concat(who, F.lit(" "), F.coalesce(p["modality"], F.lit("must")), F.lit(" "), _text(p["action"]), _text(_say(", {}", _given(p["condition"]))))
    t, e = p["timeline"], p["enforcement"]
    enforced = F.array_compact(F.array(
        _say("Enforced by {}", _given(e["enforcing_body"])),
        _say("up to ${} penalty", _money(F.nullif(e["max_civil_penalty_usd"], F.lit(0)))),
        F.when(e["private_right_of_action"], F.lit("private right of action")),
        _say("{}-day cure period", F.nullif(e["cure_period_days"], F.lit(0)).cast("string")),
    ))
    return F.concat_ws(
        " ", first, _say("Effective: {}.", _given(t["effective_date"])), _say("Compliance deadline: {}.", _given(t["compliance_deadline"])), _say("Phase-in: {}.", _given(t["phase_in_period"])),
        F.when(F.size(enforced) > 0, F.concat(F.array_join(enforced, ". "), F.lit("."))), _say("[§ {}]{}", _given(p["section_reference"]), _text(_say(" ({})", _given(place)))),
    )


def threshold(p: Column, place: Column) -> Column:
    value, unit = _given(p["threshold_value"]), _given(p["threshold_unit"])
    exceptions = _list(p["exceptions"], 3, lambda x: _head(_text(x["description"]), 80))
    told = F.concat_ws(
        " ", F.coalesce(_say("Threshold: {} {}.", value, unit), _say("Threshold: {}.", value), _say("Applies when: {}.", _head(_given(p["threshold_condition"]), 150))),
        F.when(p["compute_flops"] != 0, _say("Compute threshold: {} FLOPS.", F.format_string("%.0e", p["compute_flops"]))),
        _given(p["compute_description"]), F.when(F.size(p["sector_applicability"]) > 0, _say("Sectors: {}.", F.array_join(p["sector_applicability"], ", "))),
        _say("Modifies: {}.", _head(_given(p["applies_to_obligation"]), 100)), _say("Exceptions: {}.", F.array_join(exceptions, "; ")),
    )
    return _or(told, "Threshold extraction (no summary details).")


def definition(p: Column, place: Column) -> Column:
    said = _text(p["definition_text"])
    short = F.when(F.length(said) > 200, F.concat(_head(said, 197), F.lit("..."))).otherwise(said)
    return F.concat_ws(
        " ", _say('"{}" means {}', F.coalesce(p["term"], F.lit("Unknown term")), short), _say("Scope: {}.", _given(p["scope"])),
        _say("Actors: {}.", F.array_join(_list(p["actors"], 3, lambda a: _text(a["actor_name"])), ", ")), _say("References: {}.", F.array_join(_list(p["framework_refs"], 2, lambda a: _text(a["framework_name"])), ", ")),
    )


def ambiguity(p: Column, place: Column) -> Column:
    first = _say('{} {}: "{}"', F.upper(F.coalesce(p["severity"], F.lit("unknown"))), _words(p["ambiguity_type"]), _head(_text(p["ambiguous_text"]), 120))
    return F.concat_ws(" ", first, _head(_given(p["interpretation_notes"]), 150), _say("Suggested fix: {}", _head(_given(p["suggested_clarification"]), 150)))


def rights(p: Column, place: Column) -> Column:
    first = _say("{} right to {}: {}", title(F.coalesce(_given(p["right_holder_normalized"]), p["right_holder"], F.lit("Individual"))), _words(p["right_type"]), _head(_text(p["right_description"]), 200))
    remedies = F.transform(F.slice(p["remedies"], 1, 2), lambda r: _say("Remedy ({}): {}.", _text(r["remedy_type"]), _head(_text(r["description"]), 80)))
    return F.concat_ws(" ", first, _say("Duty bearer: {}.", _given(p["duty_bearer"])), _say("Triggered when: {}.", _head(_given(p["trigger_condition"]), 100)), remedies)


def compliance(p: Column, place: Column) -> Column:
    first = _say("{}: {} must {}", title(_words(p["mechanism_type"])), F.coalesce(_given(p["responsible_party_normalized"]), p["responsible_party"], F.lit("Entity")), _head(_text(p["description"]), 150))
    number = lambda c: F.nullif(p[c], F.lit(0)).cast("string")
    return F.concat_ws(
        " ", first, _say("Frequency: {}.", _given(p["reporting_frequency"])), _say("Reports to: {}.", _given(p["reporting_recipient"])), F.when(p["is_bias_testing"], "Includes bias testing."),
        F.when(p["is_red_teaming"], "Includes red teaming."), F.when(p["is_third_party_audit"], "Requires third-party audit."), _say("Assessment every {} months.", number("assessment_frequency_months")),
        _say("Incidents reported within {} hours.", number("incident_reporting_hours")), F.when(F.size(p["nist_measure_refs"]) > 0, _say("NIST: {}.", F.array_join(F.slice(p["nist_measure_refs"], 1, 3), ", "))),
    )


def preemption(p: Column, place: Column) -> Column:
    first = _say("[{}] {}: {}", F.upper(F.coalesce(p["severity"], F.lit("unknown"))), title(_words(_or(p["conflict_type"], "other"))), _head(_text(p["description"]), 200))
    return F.concat_ws(" ", first, _say("Authority: {}.", _given(p["related_authority"])), _say('Preemption language: "{}".', _head(_given(p["preemption_language"]), 120)))


def enforcement(p: Column, place: Column) -> Column:
    e = p["enforcement"]
    told = F.concat_ws(
        " ", _say("Enforced by {}.", _given(e["enforcing_body"])), _say("Max penalty: ${}.", _money(F.nullif(e["max_civil_penalty_usd"], F.lit(0)))),
        _say("Cure period: {} days.", F.nullif(e["cure_period_days"], F.lit(0)).cast("string")), F.when(e["private_right_of_action"], "Private right of action available."),
    )
    alone = F.when(e.isNull(), _text(_say("Enforced by {}.", _given(p["enforcing_body"])))).otherwise(told)
    return _or(alone, "Enforcement mechanism (see payload for details).")


#: Type of a fact -> its template.
TEMPLATES = {
    "obligation": obligation, "definition": definition, "actor_mapping": definition, "framework_ref": definition, "threshold": threshold, "exception": threshold,
    "ambiguity": ambiguity, "rights_protection": rights, "compliance_mechanism": compliance, "preemption_signal": preemption, "enforcement": enforcement, "timeline": obligation,
}


def summary(kind: Column, payload: Column, place: Column) -> Column:
    """A fact in words; types without a template, and payloads that are no JSON object, get a note instead."""
    name = title(_words(kind))
    parsed = F.from_json(payload, PAYLOAD)

    def told(p: Column) -> Column:
        out = F.concat(name, F.lit(" extraction (see payload for details)."))
        for k, template in TEMPLATES.items():
            out = F.when(kind == k, F.trim(template(p, place))).otherwise(out)
        return out

    read = F.transform(F.array(parsed), told)[0]
    return F.when(F.coalesce(F.startswith(F.ltrim(payload), F.lit("{")), F.lit(False)), read).otherwise(F.concat(name, F.lit(" extraction (summary generation failed).")))


def small_business(texts: Column) -> Column:
    """True if one of the exceptions exempts small businesses, else null: silence says nothing."""
    low = lambda t: F.lower(F.coalesce(t, F.lit("")))
    held = F.exists(texts, lambda t: low(t).rlike("|".join(SMALL_BUSINESS)))
    return F.when(F.coalesce(held, F.lit(False)), F.lit(True))
