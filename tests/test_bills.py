"""Bill contexts, actors, agents, edges of statuses and scale-safe rollups on small rows worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from statuta.functions import bills as B, rules as R
from statuta.operators.agents import Agents
from statuta.plans import rollups, serving


def one(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def text(v):
    return F.lit(v).cast("string")


@pytest.mark.parametrize(
    "kind, said, path, want",
    [
        ("definitions", "As used in this section", "Section 2", True),
        ("definitions", "x " * 300 + "definition", "Section 2", False),
        ("definitions", "nothing", "Definitions", True),
        ("scope", "This act shall apply to all", None, True),
        ("scope", "nothing", "Short-title", True),
        ("enforcement", "a fine not to exceed $5", "", True),
        ("enforcement", None, None, False),
    ],
)
def test_kinds_of_passages(spark, kind, said, path, want):
    assert one(spark, B.is_kind(kind, text(said), text(path)))[0] is want


PASSAGES = "bill string, n int, said string, path string"


def contexts(spark, rows):
    return {r.bill: r for r in B.bill_context(spark.createDataFrame(rows, PASSAGES).repartition(3), "bill", "n", "said", "path").collect()}


def test_bill_context_keeps_to_its_budget(spark):
    found = contexts(spark, [("b", k, f"\t{k} scope " + "x" * 9_000 + " ", "Section") for k in range(5)] + [("c", 1, "nothing here", "Section"), ("c", 0, None, None)])
    assert [p[:7] for p in found["b"].scope.split("\n---\n")] == ["0 scope", "1 scope", "[... tr"] and found["b"].scope.endswith("\n---\n[... truncated ...]")
    assert (found["c"].scope, found["b"].definitions, found["c"].total_passages, found["c"].structure) == ("", "", 2, "  Section")


def test_first_passage_above_the_budget_keeps_its_head(spark):
    long_ = "definitions " + "y" * 39_988
    found = contexts(spark, [("b", 1, long_, "x"), ("b", 2, "short definition", "x")])["b"]
    assert found.definitions == long_[:29_996] + " [...]" and found.definitions_passages == 2


def test_budget_counts_what_parts_passages(spark):
    """Enforcement has 10,000: 4,996 and 4 twice fit exactly; one character more does not."""
    fits = [("b", 1, "enforcement " + "z" * 4_984, "x"), ("b", 2, "enforcement " + "z" * 4_984, "x")]
    assert contexts(spark, fits)["b"].enforcement == "\n---\n".join(r[2] for r in fits)
    over = [fits[0], ("b", 2, fits[1][2] + "z", "x"), ("b", 3, "  \n", "enforcement")]
    assert contexts(spark, over)["b"].enforcement == fits[0][2] + "\n---\n[... truncated ...]"


def test_passages_that_define_are_not_enforcement(spark):
    rows = [("b", 2, "a penalty applies", "Section 2"), ("b", 1, "definition of penalty", "Section 1"), ("b", 3, "a penalty applies", "Section 2")]
    found = contexts(spark, rows)["b"]
    assert found.enforcement == "a penalty applies\n---\na penalty applies" and found.definitions == "definition of penalty" and found.enforcement_passages == 2


def test_outline_and_terms(spark):
    rows = [("b", k, f"definitions “AI System” means that; \"deployer {k}\"\u00a0refers to x; “ai system” has the meaning y", "p" * 997) for k in (3, 1, 2, 4, 5, 6)]
    found = contexts(spark, rows)["b"]
    assert found.structure == "\n".join(["  " + "p" * 997] * 5 + ["  ..."])
    assert found.defined_terms == ["AI System", "deployer 1", "deployer 2", "deployer 3", "deployer 4", "deployer 5", "deployer 6"]


def test_neighbours_of_repeated_turns(spark):
    from statuta.operators import places

    rows = [("a", 1, "x"), ("a", 1, "y"), ("a", 1, "y"), ("a", None, "first"), ("a", 5_000, "last"), ("b", 2, None), ("b", 3, "z"), (None, 1, "n")]
    found = places.neighbours(spark.createDataFrame(rows, "block string, turn int, text string"), "block", "turn", "text").collect()
    assert len(found) == len(rows)
    assert sorted((r.text, r.before, r.after) for r in found if r.block == "a") == [("first", None, "x"), ("last", "y", None), ("x", "first", "y"), ("y", "x", "y"), ("y", "y", "last")]
    assert {(r.block, r.text, r.before, r.after) for r in found if r.block != "a"} == {("b", None, None, "z"), ("b", "z", None, None), (None, "n", None, None)}


def test_excerpts(spark):
    short, long_ = one(spark, B.bill_excerpt(text("abc"), text("m"), 2), B.bill_excerpt(text("abcdefghij"), text("m"), 2))
    assert short == "abc" and long_ == "MATCHED SECTIONS:\nm\n\nOPENING OF BILL:\nab\n\nEND OF BILL:\nij"


@pytest.mark.parametrize("name, want", [("developer", "developer"), ("website", None), ("deploy   ployer", None), ("ab", None), ("  ", None), (None, None)])
def test_clean_actors(spark, name, want):
    assert one(spark, B.clean_actor(text(name)))[0] == want


@pytest.mark.parametrize(
    "raw, named, raw_code, named_code, want",
    [
        ("a large developer", "developer", None, None, "developer"),
        ("person who acts as a creator", "developer", None, None, None),
        ("person who acts as a creator", "developer", "provider", None, "provider"),
        ("vendor", "supplier", "provider", "provider", "supplier"),
        ("", "developer", None, None, "developer"),
    ],
)
def test_reconciled_actors(spark, raw, named, raw_code, named_code, want):
    assert one(spark, B.reconciled_actor(*map(text, (raw, named, raw_code, named_code))))[0] == want


def test_agents(spark):
    agents = Agents()
    agents.add("words", lambda t, _: F.split(t, " "), lambda fact, t: F.when(F.length(fact) > 2, F.upper(fact)))
    agents.add("note", lambda _, c: F.array(c))
    rows = spark.createDataFrame([(1, "one to three", "c1"), (2, "x", "c2")], "id long, t string, c string")
    assert sorted(map(tuple, agents.facts(rows, "id", "t", "c").collect())) == [(1, "note", 0, "c1"), (1, "words", 0, "ONE"), (1, "words", 1, "THREE"), (2, "note", 0, "c2")]
    assert sorted(map(tuple, agents.bill_facts(rows, "id", "t", "c").collect())) == [(1, "note", "c1"), (1, "words", "ONE"), (2, "note", "c2")]
    with pytest.raises(ValueError):
        agents.add("note", lambda _, c: F.array(c))


def test_constants_are_the_published_ones():
    """Written out here, so that a slip in the code is not shared by its twin."""
    assert R.MONTH_NUMBER == {"jan": "01", "feb": "02", "mar": "03", "apr": "04", "may": "05", "jun": "06", "jul": "07", "aug": "08", "sep": "09", "oct": "10", "nov": "11", "dec": "12"}
    assert rollups.NEXT["enacted"] == ("active", "future_effective", "repealed", "stayed") and rollups.NEXT["vetoed"] == rollups.NEXT["repealed"] == () and rollups.NEXT["dead"] == ("introduced", "pending")
    assert len(R.SIGNALS) == 6 and "carve[- ]?out[s]?" in R.SIGNALS["threshold_exception"] and "attorney general" in R.SIGNALS["compliance_mechanism"]
    assert {k: most for k, (_, _, most) in B.KINDS.items()} == {"definitions": 30_000, "scope": 20_000, "enforcement": 10_000}


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], [3.0] * 500 + [1.0, 9.0], [random.Random(1).random() ** 4 for _ in range(700)], [None, 2.0, 4.0]])
def test_percentiles_are_exact(spark, tmp_path, values):
    """Whatever the values: one, all alike, mostly one, skewed, or null."""
    rows = [(k, "t", v) for k, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000))).write.parquet(f"{tmp_path}/events.parquet")
    got = serving.latency(spark, str(tmp_path)).collect()[0]
    known = sorted(v for v in values if v is not None)
    at = lambda p: (lambda h: known[int(h)] + (known[min(int(h) + 1, len(known) - 1)] - known[int(h)]) * (h - int(h)))((len(known) - 1) * p)
    assert got.p50 == pytest.approx(at(0.5)) and got.p95 == pytest.approx(at(0.95)) and got.n == len(values)


@pytest.mark.parametrize(
    "kind, clause, told, cites, refs, state, want",
    [
        ("federal_preemption", "nothing here preempts", "does not conflict", None, None, "CA", ("true_preemption", True, None, True)),
        ("federal_preemption", None, "does not appear to conflict with federal law", None, None, "CA", ("true_preemption", False, "self_negating_description", False)),
        ("federal_preemption", None, "May conflict", "47 U.S.C. § 230", None, "CA", ("true_preemption", True, None, True)),
        ("dormant_commerce_clause", None, "hedge", "US Constitution Art. I § 8", None, "CA", ("true_preemption", False, "no_external_authority", False)),
        ("cross_state_conflict", None, "California's amendment may conflict", None, None, "CA", ("interstate_conflict", False, "no_external_authority", False)),
        ("cross_state_conflict", None, "may conflict with Texas law", None, None, "CA", ("interstate_conflict", True, None, True)),
        ("cross_state_conflict", None, "may conflict with Texas law", None, None, None, ("interstate_conflict", False, "no_external_authority", False)),
        ("first_amendment", None, "speech", None, None, "CA", ("constitutional_limit", True, None, True)),
        ("other", None, "cites another", None, ["Penal Code"], "CA", ("cross_law_reference", True, None, True)),
        ("other", None, "cites", None, None, "CA", ("unclassified", True, None, False)),
    ],
)
def test_legal_contexts(spark, kind, clause, told, cites, refs, state, want):
    from statuta.functions.conflicts import legal_context

    named = F.array(*map(F.lit, refs)) if refs else F.lit(None).cast("array<string>")
    assert tuple(one(spark, legal_context(text(kind), text(clause), text(told), text(cites), named, text(state)))[0]) == want


ROWS = "k int, v string, at int"


def kept(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_sinks_of_repeated_and_null_keys(spark):
    from statuta.sources import sinks

    target = spark.createDataFrame([(1, "old", 0), (None, "none", 0), (9, "stays", 0)], ROWS)
    incoming = spark.createDataFrame([(1, "b", 2), (1, "c", 3), (1, "a", 1), (None, "new none", 1), (2, "x", 5), (2, "w", 6), (2, "w", 6)], ROWS).repartition(4)
    first, last = sinks.first_write(target, incoming, ["k"], ["at"]), sinks.last_write(target, incoming, ["k"], ["at"])
    assert kept(first) == sorted([(1, "old", 0), (None, "none", 0), (9, "stays", 0), (2, "x", 5)], key=repr)
    assert kept(last) == sorted([(1, "c", 3), (None, "new none", 1), (9, "stays", 0), (2, "w", 6)], key=repr)
    assert kept(sinks.first_write(first, incoming, ["k"], ["at"])) == kept(first)
    assert kept(sinks.last_write(last, incoming, ["k"], ["at"])) == kept(last)


@pytest.mark.parametrize("token, current, foreign", [("10", "9", True), ("9", "10", True), ("9", "9", False), (None, "9", False), ("9", None, False), (None, None, False)])
def test_lock_tokens(spark, token, current, foreign):
    from statuta.functions import checks as K

    assert one(spark, K.foreign_token(text(token), text(current)))[0] is foreign
