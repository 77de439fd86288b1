"""Text, date and score functions on small rows whose results were worked out by hand."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from statuta.functions import rules, scores, text as T


def one(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


@pytest.mark.parametrize(
    "similarity, grounding, citation, cross, second, expected",
    [
        (0.25, 1.0, 1.0, None, False, 1.0),
        (0.10, 1.0, 0.6, None, False, 0.25 + 0.35 + 0.09),
        (0.0, 0.5, 0.0, None, False, 0.15 + 0.175),
        (0.3, 1.0, 1.0, 0.0, False, 0.9),
        (None, 1.0, 1.0, None, True, 0.69),
        (None, 1.0, 1.0, None, False, 0.49),
        (None, 0.4, 0.0, None, True, 0.28),
        (None, 0.4, 0.0, 1.0, True, 0.4),
    ],
)
def test_confidence(spark, similarity, grounding, citation, cross, second, expected):
    lit = lambda v: F.lit(v).cast("double")
    got = one(spark, scores.confidence(lit(similarity), lit(grounding), lit(citation), lit(cross), F.lit(second)))[0]
    assert got == pytest.approx(expected)


@pytest.mark.parametrize(
    "text, unit, found",
    [
        ("a penalty of $25,000,000 or 5000 dollars", "usd", [25000000.0, 5000.0]),
        ("$25,000,000 and 1,200 people", "count", [1200.0]),
        ("3 years or 6 months", "months", [6.0, 36.0]),
        ("thirty days", "days", []),
        ("10^26 operations", "flops", [1e26]),
        ("10 x 10^26", "flops", [1e26, 1e27]),
        ("2e9", "flops", [2e9]),
    ],
)
def test_candidates(spark, text, unit, found):
    assert one(spark, scores.candidates(F.lit(text), unit))[0] == pytest.approx(found)


def test_grounded(spark):
    ask = lambda v, t, u: scores.grounded(F.lit(v).cast("double"), F.lit(t).cast("string"), u)
    assert one(spark, ask(36, "3 years", "months"), ask(35, "3 years", "months"), ask(1, "", "days"), ask(1, None, "days"), ask(None, "1 day", "days"), ask(1.005e26, "10^26", "flops"), ask(1.1e26, "10^26", "flops")) == ["grounded", "mismatch", "unverifiable", "unverifiable", None, "grounded", "mismatch"]


@pytest.mark.parametrize("ref, expected", [("§ 6-1-1702(3)(a)", 1.0), ("(3)(a)(ii)", 1.0), ("§ 5", 0.6), ("12.34", 0.6), ("Section 5", 0.3), ("somewhere", 0.2), ("  ", 0.0), (None, 0.0)])
def test_section_specificity(spark, ref, expected):
    assert one(spark, T.section_specificity(F.lit(ref).cast("string")))[0] == expected


@pytest.mark.parametrize("text, expected", [("", 0.0), (None, 0.0), ("plain words", 0.6), ("The section shall apply.", 1.0), ("��", 0.0)])
def test_parse_quality(spark, text, expected):
    assert one(spark, T.parse_quality(F.lit(text).cast("string"), T.any_word(T.LEGAL_MARKERS)))[0] == expected


def plain_damage(text):
    """The rule as a loop over characters."""
    if not (text or "").strip():
        return 0.0, "empty_passage"
    n, lost, flags = len(text), 0.0, []
    broken, garbled = text.count("�"), sum(c in rules.GARBLED for c in text)
    control = sum(c < " " and c not in "\t\n\r" or "\x7f" <= c <= "\x9f" for c in text)
    runs = len(re.findall(r"(.)\1{5,}", text))
    letters = sum(map(len, re.findall("[a-zA-Z]{2,}", text)))
    odd = sum(ord(c) > 127 and not unicodedata.category(c).startswith("L") for c in text)
    for name, hit, cost in (
        ("encoding_errors", broken > 0, min(broken / n * 10, 0.5)), ("garbled_chars", garbled > 2, min(garbled / n * 8, 0.4)), ("control_chars", control > 0, min(control / n * 10, 0.3)),
        ("repeated_junk", runs > 2, 0.2), ("low_word_density", letters / n < 0.4, 0.3), ("high_non_ascii", odd / n > 0.1, min(odd / n * 3, 0.3)),
    ):
        if hit:
            lost += cost
            flags.append(name)
    return max(0.0, 1 - lost), ",".join(flags)


def test_text_damage_agrees_with_a_loop(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    made = ["", " \n", "a b c d e f", "�" * 3 + "word word", "■□■ squares", "\x00\x01 control", "aaaaaaa bbbbbbb ccccccc", "— – … “odd”", "ééé ñ"]
    texts |= {-1 - i: t for i, t in enumerate(made)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").select("doc_id", rules.text_damage(F.col("text")).alias("t"))
    for row in df.collect():
        score, flags = plain_damage(texts[row.doc_id])
        assert row.t.score == pytest.approx(score, abs=6e-4) and ",".join(row.t.flags) == flags, texts[row.doc_id][:80]


@pytest.mark.parametrize("said, day", [("2026-01-02", "2026-01-02"), ("2026-01", "2026-01-01"), ("2026", "2026-01-01"), ("1999", None), ("7/17/34", "2034-07-17"), ("1/1/2026", "2026-01-01"), ("January 1, 2026", "2026-01-01"), ("Jan. 1 2026", "2026-01-01"), ("in September 2027", "2027-09-01"), ("pending", None), ("", None), (None, None)])
def test_normal_date(spark, said, day):
    assert one(spark, rules.normal_date(F.lit(said).cast("string")))[0] == day


@pytest.mark.parametrize("note, band", [("$1,000", "under_10k"), ("$1 million", "over_1m"), ("$500k", "100k_to_1m"), ("up to $10,000", "10k_to_100k"), ("felony", "criminal"), ("penalty TBD", "unspecified"), ("no civil penalty", "none"), ("Attorney General", "unspecified"), ("", None), (None, None)])
def test_penalty_severity(spark, note, band):
    assert one(spark, rules.penalty_severity(F.lit(note).cast("string")))[0] == band


@pytest.mark.parametrize(
    "passage, span, tier",
    [
        ("A “deployer”  shall notify.", 'a "deployer" shall', 2),
        ("A “deployer”  shall notify.", 'A "deployer" shall', 1),
        ("the developer, and the deployer", "developer and the deployer", 3),
        ("the developer, and x", "developer and", None),
        ("12 the developer shall com-\n  ply with this section of law", "developer shall comply with this section", 4),
        ("the developer shall\n14 comply with this chapter", "developer shall comply with this chapter", 4),
        ("see SECTIONA1 of the act of the state", "see section 1 of the act of the state", 4),
        ("text", "", None),
        ("", "text", None),
    ],
)
def test_span_tier(spark, passage, span, tier):
    assert one(spark, T.span_tier(F.lit(passage), F.lit(span)))[0] == tier


def test_patterns_are_asked_once(spark, sf):
    """What several columns read is worked out once for a row."""
    from statuta.plans import rules as plans
    from statuta.plans import stated

    for q, pattern in ((plans.text_damage, "[^a-zA-Z]"), (plans.routing, "attorney general"), (stated.enforcement_facts, "superintendent")):
        assert q(spark, sf)._jdf.queryExecution().optimizedPlan().toString().count(pattern) == 1
