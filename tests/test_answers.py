"""Repair of model answers, sections and scopes on texts whose results were worked out by hand."""

import json

import pytest

from statuta.operators import answers as A, segments as G


@pytest.mark.parametrize(
    "text, value, repairs",
    [
        ('{"extractions": [{"a": 1}]}', {"extractions": [{"a": 1}]}, []),
        ('{"detected": false}{"extra": true}', {"detected": False}, ["first_object_extraction"]),
        ('[{"a": 1}, {"b": 2}][{"c": 3}]', [{"a": 1}, {"b": 2}], ["first_object_extraction"]),
        ('{"extractions": [{"a": 1}, {"b": 2},]}', {"extractions": [{"a": 1}, {"b": 2}]}, ["trailing_comma_strip"]),
        ('{"a": 1, "b": 2,}', {"a": 1, "b": 2}, ["trailing_comma_strip"]),
        ('{"text": "contains {braces} and [brackets]"}extra', {"text": "contains {braces} and [brackets]"}, ["first_object_extraction"]),
        ('{"a": "x\\d \n\t y"}', {"a": "x\\d \n\t y"}, ["string_escape_repair"]),
        ('{"a": "\x07x"}', {"a": "x"}, ["control_char_strip"]),
        ('{"\\tterm": {" b ": [{"c ": 1}]}}', {"term": {"b": [{"c": 1}]}}, ["stripped_keys"]),
        ('{"extractions": [{"a": 1}, "{\\"b\\": 2}"]}', {"extractions": [{"a": 1}, {"b": 2}]}, ["unescaped_strings"]),
        ('{"key": "value", "nested": {"inner": true', {"key": "value", "nested": {"inner": True}}, ["truncation_salvage"]),
    ],
)
def test_repairs(text, value, repairs):
    got, done, _ = A.repaired(text)
    assert json.loads(got) == value and done == repairs


def test_what_is_no_json_stays():
    assert A.repaired("This is not JSON at all")[:2] == ("This is not JSON at all", [])
    assert A.repaired("  ")[0] == A.repaired(None)[0] == ""


@pytest.mark.parametrize(
    "text, want",
    [
        ("", ""),
        ("just plain text", "just plain text"),
        ("{", "{}"),
        ("[", "[]"),
        ('{"a": [1, 2, 3]}', '{"a": [1, 2, 3]}'),
        ('[{"a": 1}, {"b": 2}]', '[{"a": 1}]'),
        ('[{"a": 1}, {"b": 2}, {"c', '[{"a": 1}, {"b": 2}]'),
        ('{"text": "has {brackets} and [arrays]", "next":', '{"text": "has {brackets} and [arrays]", "next":}'),
        ('{"extractions": [{"text": "trunc', '{"extractions": [{"text": "trunc"}]}'),
        ('{"a": "x\\"', '{"a": "x\\""}'),
    ],
)
def test_closed(text, want):
    assert A.closed(text) == want


def test_elements_started():
    assert A.elements_started('{"extractions": [{"a": {"x": 1}}, {"b": "[{"}, {"c') == 3
    assert A.elements_started('[{"a": 1}, {') == 2 and A.elements_started('{"a": {"b": 1}}') == 0


def test_loops_are_cut_before_their_third_turn():
    block = "the same sentence comes again and again and again. "
    text, looped = A.unlooped("Head. " + block * 9)
    assert looped and text.count(block.strip()) == 6  # the longest block that repeats holds two turns
    assert A.unlooped("no loop here " * 3) == ("no loop here " * 3, False)
    assert A.unlooped(None) == (None, False)


def test_sections_and_offsets():
    body = "word " * 200
    text = f"Section 1. {body}\n\nSection 2. {body}\n\nSection 3. {body}{body}{body}"
    found = G.sections(text)
    assert [(m, marks) for m, _, _, _, marks in found] == [("Section 1.", ["Section 1.", "Section 2."]), ("Section 3.", ["Section 3."])]
    for _, part, start, end, _ in found:
        assert text[start:end].strip()[:40] == part[:40] and part[-4:] == text[start:end].strip()[-4:]


def test_a_marker_alone_is_the_head_of_what_follows():
    (marker, text, *_), = G.sections("SECTION 7.\n\nChapter 272 of the General Laws is hereby amended by adding words.")
    assert marker == "SECTION 7." and text.startswith("SECTION 7.\n\nChapter 272 of")


def test_one_line_texts_get_breaks_before_markers():
    assert [m for m, *_ in G.sections("Section 1. Words. " + "x" * 3000 + ". Section 2. More; see Section 3 there.")] == ["Section 1.", "Section 2."]
    assert G.sections("no marker here") == [] == G.sections(None)


RESTATED = "Lead. (a) see subdivision (b) and (d). (1) A deepfake is synthetic. (2) Other. (b) Under Section 84514 do so. (1) plain (c) nothing here"


def test_regions_of_a_restated_section():
    found = G.regions(RESTATED, ["84514"])
    assert "".join(RESTATED[s:e] for _, s, e, *_ in found) == RESTATED
    # "(b)" inside (a) continues the sequence, as a reference that stands for a mark would
    labels = [x[0] for x in found]
    assert labels[0] is None and labels[1] == "(a)" and found[0][4] == "shared_preamble"
    assert any(x[4] == "keyword:synthetic" for x in found) and any(x[4] == "references_added_section:84514" for x in found)
    assert found[-1][3:] == (False, "no_ai_domain_signal")
    text = G.excerpt(RESTATED, found)
    assert text.endswith("[...]") and "nothing here" not in text
    assert G.regions("no marks", []) == [(None, 0, 8, True, "no_subdivision_structure")]
    assert G.excerpt("no marks", G.regions("no marks", [])) is None


def test_lead_follows_a_part_in_scope():
    found = {x[0]: x[3:] for x in G.regions("(a) lead words (1) synthetic media (2) other", [])}
    assert found == {"(a)": (True, "adjacent_to_in_scope_sibling"), "(a)(1)": (True, "keyword:synthetic"), "(a)(2)": (False, "no_ai_domain_signal")}


def test_evidence_offsets():
    text = "Café — “The Provider,  shall\nnot” disclose it."
    assert G.evidence_offset("the provider shall NOT", text) == text.index("The")
    assert G.evidence_offset("short", text) is None and G.evidence_offset("something quite different", text) is None
    loose, places = G.loose_with_offsets("A  b_C")
    assert loose == "a b c" and [places[0], places[2], places[4]] == [0, 3, 5]


def test_deep_and_long_answers():
    """A hundred thousand brackets are no JSON and no error, and time grows with the answer's length alone."""
    import time

    from statuta.operators.answers import repaired

    began = time.time()
    for said in ("[" * 100_000, '{"a":' * 50_000, "[" * 400 + "]" * 400, "[" + '{"a": 1}, ' * 60_000 + '{"a"', '{"a": 1} ' * 60_000):
        repaired(said)
    assert repaired("[" * 100_000)[0] is not None and time.time() - began < 30
    assert repaired('{"a": {"b": "}"}} and {"c": 2}')[:2] == ('{"a": {"b": "}"}}', ["first_object_extraction"])
