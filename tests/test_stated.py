"""Facts, triggers, citations, edits and sinks on small rows whose results were worked out by hand."""

import pytest
from pyspark.sql import functions as F

from statuta.functions import checks as K, citations as C, payloads as P, stated as S, text as T
from statuta.sources import sinks


def one(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def text(v):
    return F.lit(v).cast("string")


def test_enforcement_facts(spark):
    note = "The Attorney General may seek up to $7,500 per violation or $1.5 million; a 60-day cure applies. No private right of action. No criminal penalties."
    f = one(spark, S.enforcement_facts(text(note)))[0]
    assert (f.max_penalty, f.penalty_per, f.cure_days, f.body, f.private_right, f.criminal, f.covered) == (1_500_000, "violation", 60, "Attorney General", False, False, True)
    empty = one(spark, S.enforcement_facts(text(None)))[0]
    assert empty.asDict() == {"max_penalty": None, "penalty_per": None, "cure_days": None, "body": None, "private_right": None, "criminal": None, "covered": False, "excerpt": None}


def test_applicability_facts(spark):
    f = one(spark, S.applicability_facts(text("Developers and deployers with 50 or more full-time employees or 20 employees, annual revenue of $25 million, in health care; private sector")))[0]
    assert (f.kinds, f.sectors, f.employees, f.revenue, f.government_only, f.covered) == (["developer", "deployer"], ["healthcare"], 20, 25_000_000, False, True)


def test_timeline_facts(spark):
    f = one(spark, S.timeline_facts(text("Takes effect on July 1, 2026. 45 calendar days to respond; annual assessment"), text("cure period of 30 days")))[0]
    assert (f.effective, f.response_days, f.cure_days, f.assessment_months, f.covered) == ("2026-07-01", 45, 30, 12, True)
    assert one(spark, S.timeline_facts(text("Effective upon enactment"), text(None)))[0].effective == "upon_enactment"


@pytest.mark.parametrize("raw, want", [("$25 million", 25e6), ("25,000,000", 25e6), ("50", 50.0), ("10^26", 1e26), ("1.5e3", 1500.0), ("-3 %", -3.0), ("many", None), ("", None), (None, None)])
def test_trigger_values(spark, raw, want):
    assert one(spark, S.trigger_value(text(raw)))[0] == want


@pytest.mark.parametrize(
    "kind, unit, condition, value, want",
    [
        ("size", "employees", "more than 50 employees", "50", ("employee_count", "gt", 50.0)),
        (None, "USD", "no fewer than the annual revenue", "1", ("revenue", "gte", 1.0)),
        ("other", None, None, "7", ("other", "gte", 7.0)),
        ("other", None, None, None, ("other", "any", None)),
    ],
)
def test_triggers(spark, kind, unit, condition, value, want):
    assert tuple(one(spark, S.trigger(text(kind), text(unit), text(condition), text(value), F.lit(None).cast("double"), text(None)))[0]) == want


@pytest.mark.parametrize(
    "raw, code, want",
    [
        ("C.R.S. § 6-1-1702(3)(a)", "CO", "§ 6-1-1702(3)(a)"),
        ("Colo. Rev. Stat. § 6-1-1702", "co", "§ 6-1-1702"),
        ("Cal. Bus. & Prof. Code § 22575", "CA", "§ 22575"),
        ("N.Y. Gen. Bus. Law § 899-aa", "NY", "§ 899-aa"),
        ("New York Laws Chapter 202 of 2021", "NY", "§ Chapter 202 of 2021"),
        ("Tex. Bus. & Com. Code § 503.001", "TX", "§ 503.001"),
        ("C.G.S. § 36a-701b", "CT", "§ 36a-701b"),
        ("820 ILCS 5/820-110", "IL", "§ 820-110"),
        ("Utah Code Ann. § 13-37-201", "UT", "§ 13-37-201"),
        ("15 U.S.C. § 6501", "US", "§ 6501"),
        ("Section 4(a)(2)", None, "§ 4(a)(2)"),
        ("Subsection 4(a)", "XX", "§ 4(a)"),
        ("&sect;5   b", None, "§ 5 b"),
        (None, "CO", ""),
    ],
)
def test_citations(spark, raw, code, want):
    assert one(spark, C.normal_citation(text(raw), text(code)))[0] == want


@pytest.mark.parametrize("said, want", [(" ny ", "NY"), ("New York", "NY"), ("State of West Virginia", "VA"), ("zz", ""), ("utah", "UT")])
def test_states(spark, said, want):
    assert one(spark, C.state_code(text(said)))[0] == want


@pytest.mark.parametrize("payload, want", [('{"subject": "Provider", "action": "keep records"}', "obligation"), ('{"subject": " ", "enforcement": {"penalty_type": "civil"}}', "enforcement"), ('{"timeline": {"sunset_date": "2030"}}', "timeline"), ('{"subject": "The court", "action": "shall impose a fine", "enforcement": {"enforcing_body": "AG"}}', "enforcement"), ("{}", "obligation")])
def test_obligation_types(spark, payload, want):
    assert one(spark, P.obligation_type(F.from_json(F.lit(payload), P.OBLIGATION)))[0] == want


def test_adapters_have_all_their_fields(spark):
    for kind, schema in (("obligation", P.OBLIGATION), ("threshold", P.THRESHOLD), ("definition", P.DEFINITION), ("ambiguity", P.AMBIGUITY)):
        row = one(spark, P.adapted(kind, F.from_json(F.lit("{}"), schema)))[0].asDict()
        assert all(v in (None, []) or (hasattr(v, "asDict") and not any(v.asDict().values())) for v in row.values()), row
    said = one(spark, P.adapted("obligation", F.from_json(F.lit('{"timeline": {"effective_date": "2026-01-01", "phase_in_period": "1 year", "date_parse_status": {"effective_date": "parsed"}}, "enforcement": {"enforcing_body": "AG", "private_right_of_action": true}}'), P.OBLIGATION)))[0]
    assert (said.timeline, said.enforcement, [tuple(x) for x in said.deadlines]) == ("Effective: 2026-01-01; Phase-in: 1 year", "Enforced by: AG; Private right of action: Yes", [("effective", "2026-01-01")])


@pytest.mark.parametrize("widget, value, want", [("number", "5.0", (True, "5", None)), ("number", "x", (False, "x", "no number")), ("date", "July 1, 2026", (True, "2026-07-01", None)), ("boolean", "Yes", (True, "true", None)), ("boolean", "maybe", (False, "maybe", "neither yes nor no")), ("select", "odd", (True, "odd", "not a standard value")), ("readonly", "x", (False, "x", "system field")), ("number", "", (True, None, None))])
def test_edited_values(spark, widget, value, want):
    assert tuple(one(spark, K.edited_value(text(widget), text(value), F.array(F.lit("civil"))))[0]) == want


@pytest.mark.parametrize("actor, codes, want", [("developer", "F,D", "aligned"), ("individual", "F,D", "scope_mismatch"), ("developer", "", "tracker_silent"), (None, "G", "tracker_silent"), ("developer", "Z", "tracker_silent"), ("data_broker", "A*", "aligned"), ("data_broker", "A", "scope_mismatch")])
def test_alignment(spark, actor, codes, want):
    assert one(spark, K.alignment(text(actor), text(codes)))[0] == want


def test_backoff(spark):
    wait = lambda n, after, share: one(spark, K.backoff_seconds(F.lit(n), F.lit(after).cast("double"), F.lit(share)))[0]
    assert [wait(3, None, 0), wait(10, None, 0), wait(3, 20.0, 0), wait(3, None, 1), wait(3, None, -1)] == [8, 60, 20, 10, 6]


def test_both_fold_tables(spark):
    narrow = "‘a’ “b” –— ­x"
    wide = "‑‒–— ‘’‚ “”„     ­"
    assert one(spark, T.fold(F.lit(narrow)), T.fold(F.lit(wide), T.WIDE_FOLD)) == ["'a' \"b\" -- x", "---- ''' \"\"\"     ­"]
    assert one(spark, T.span_tier(F.lit("He said „no”."), F.lit('he said "no".')))[0] == 2


def test_markers_hold_the_sign_of_a_section():
    assert "§" in T.LEGAL_MARKERS and "the" not in T.LEGAL_MARKERS and len(T.LEGAL_MARKERS) == 19


def test_keyed_sinks(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "id long, v string")
    target, incoming = rows((1, "a"), (2, "b")), rows((2, "B"), (3, "C"))
    as_set = lambda df: {tuple(r) for r in df.collect()}
    assert as_set(sinks.first_write(target, incoming, ["id"])) == {(1, "a"), (2, "b"), (3, "C")}
    assert as_set(sinks.last_write(target, incoming, ["id"])) == {(1, "a"), (2, "B"), (3, "C")}
    known, aside = sinks.split_known(incoming, target, ["id"])
    assert as_set(known) == {(2, "B")} and as_set(aside) == {(3, "C")}
    path = sinks.write_version(target, str(tmp_path / "t"), "r1")
    assert as_set(spark.read.parquet(path)) == as_set(target)
    sent = {}
    sinks.copy_tables(spark, lambda name: spark.range(1200).toDF("id"), lambda name, df: sent.update({name: df.groupBy("batch_no").count().collect()}), ["parents", "children"])
    assert list(sent) == ["parents", "children"] and len(sent["parents"]) == 3 and sum(r["count"] for r in sent["parents"]) == 1200
    parents, children = sinks.merged(rows((1, "a"), (2, "b")), spark.createDataFrame([(7, 2), (8, 1)], "child long, id long"), spark.createDataFrame([(2, 1)], "old long, new long"), "id")
    assert as_set(parents) == {(1, "a")} and as_set(children) == {(7, 1), (8, 1)}


def test_notes_of_one_file_are_read_by_all_cores(spark, sf):
    """A file of a few MB is one task; its rows are dealt before they are read for what they state."""
    from statuta.plans import stated as plans

    for q in (plans.enforcement_facts, plans.applicability_facts, plans.timeline_facts, plans.triggers):
        assert q(spark, sf).rdd.getNumPartitions() > 1
