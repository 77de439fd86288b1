"""Summaries of facts and of laws on payloads worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from statuta.functions import summaries as S
from statuta.plans import summaries as plans

CASES = [
    ("obligation", {"subject": "AI developer's", "modality": "shall", "action": "conduct audits", "condition": "if deployed", "section_reference": "6-1-1703", "timeline": {"effective_date": "2026-02-01", "phase_in_period": "90 days"}, "enforcement": {"enforcing_body": "AG", "max_civil_penalty_usd": 20000, "private_right_of_action": True, "cure_period_days": 60}}, "CO",
     "Ai Developer'S shall conduct audits, if deployed Effective: 2026-02-01. Phase-in: 90 days. Enforced by AG. up to $20,000 penalty. private right of action. 60-day cure period. [§ 6-1-1703] (CO)"),
    ("obligation", {"subject_normalized": "deployer", "subject": "x", "action": "act", "section_reference": "4"}, None, "Deployer must act [§ 4]"),
    ("timeline", {}, "CO", "Entity must"),
    ("threshold", {"threshold_value": "50", "threshold_unit": "employees", "sector_applicability": ["health", "finance"], "exceptions": [{"description": "x" * 100}, {"description": "b"}]}, None, "Threshold: 50 employees. Sectors: health, finance. Exceptions: " + "x" * 80 + "; b."),
    ("exception", {"threshold_condition": "c" * 200, "compute_flops": 1e26, "applies_to_obligation": "the duty"}, None, "Applies when: " + "c" * 150 + ". Compute threshold: 1e+26 FLOPS. Modifies: the duty."),
    ("threshold", {}, None, "Threshold extraction (no summary details)."),
    ("definition", {"term": "AI", "definition_text": "d" * 201, "scope": "act", "actors": [{"actor_name": "a"}, {"actor_name": "b"}], "framework_refs": [{"framework_name": "NIST"}]}, None, '"AI" means ' + "d" * 197 + "... Scope: act. Actors: a, b. References: NIST."),
    ("ambiguity", {"ambiguity_type": "vague_term", "severity": "high", "ambiguous_text": "reasonable", "suggested_clarification": "say how"}, None, 'HIGH vague term: "reasonable" Suggested fix: say how'),
    ("rights_protection", {"right_holder": "consumer", "right_type": "opt_out", "right_description": "of profiling", "duty_bearer": "deployer", "remedies": [{"remedy_type": "damages", "description": "up to"}]}, None, "Consumer right to opt out: of profiling Duty bearer: deployer. Remedy (damages): up to."),
    ("compliance_mechanism", {"mechanism_type": "impact_assessment", "responsible_party": "deployer", "description": "assess", "is_bias_testing": True, "assessment_frequency_months": 12, "nist_measure_refs": ["a", "b", "c", "d"]}, None, "Impact Assessment: deployer must assess Includes bias testing. Assessment every 12 months. NIST: a, b, c."),
    ("preemption_signal", {"severity": "low", "description": "may conflict", "preemption_language": "supersedes"}, None, '[LOW] Other: may conflict Preemption language: "supersedes".'),
    ("enforcement", {"enforcement": {"max_civil_penalty_usd": 1500000, "private_right_of_action": False}}, None, "Max penalty: $1,500,000."),
    ("enforcement", {"enforcing_body": "FTC"}, None, "Enforced by FTC."),
    ("enforcement", {}, None, "Enforcement mechanism (see payload for details)."),
    ("new_kind", {"a": 1}, None, "New Kind extraction (see payload for details)."),
]


def test_summaries(spark):
    rows = [(n, k, json.dumps(p), place) for n, (k, p, place, _) in enumerate(CASES)] + [(99, "obligation", "no json", None), (98, "obligation", None, None)]
    df = spark.createDataFrame(rows, "n int, kind string, payload string, place string")
    got = {r.n: r.s for r in df.select("n", S.summary(F.col("kind"), F.col("payload"), F.col("place")).alias("s")).collect()}
    for n, case in enumerate(CASES):
        assert got[n] == case[-1], case[0]
    assert got[99] == got[98] == "Obligation extraction (summary generation failed)."


@pytest.mark.parametrize("said, want", [("attorney-general o'brien", "Attorney-General O'Brien"), ("ÉTAT 3d", "État 3D"), ("", ""), (None, None)])
def test_title(spark, said, want):
    assert spark.createDataFrame([(said,)], "c string").select(S.title(F.col("c")).alias("t")).first().t == want


def test_law_summaries(spark):
    rows = [
        ("a", "size", "employees", None, "500", None, None, None), ("a", "size", "employees", None, "50", None, ["For Small Businesses"], None), ("a", "annual revenue", "USD", None, "$25 million", None, None, False),
        ("b", None, None, None, "many", None, None, False), ("b", None, None, None, None, None, ["large firms", None], True), ("c", "size", "employees", "in any", "high", None, [], None),
    ]
    df = spark.createDataFrame(rows, "law string, kind string, unit string, condition string, value string, flops double, exceptions array<string>, private_action boolean")
    got = {r.law: (r.min_employees, r.min_revenue, r.consumer_count, r.small_business_exempt, r.private_right_of_action) for r in plans.covered(df, "law").collect()}
    assert got == {"a": (50, 25e6, None, True, False), "b": (None, None, None, None, True), "c": (None, None, None, None, None)}
