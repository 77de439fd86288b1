"""Terms found by one automaton, and definitions said twice, against loops."""

import random
import re
import tempfile
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from statuta.functions import vocabularies as V
from statuta.operators import vocabularies as W
from statuta.operators.definitions import first_definitions

RULES = {"in": lambda t: re.escape(t), "word": lambda t: rf"\b{re.escape(t)}\b", "words": lambda t: rf"\b{re.escape(t)}s?\b"}


def found(df):
    return {r.i: sorted((h.kind, h.place, h.term) for h in r.hits) for r in df.collect()}


@pytest.mark.parametrize("limit", [100_000, 7])
def test_terms_are_those_of_a_loop(spark, limit, monkeypatch):
    """Random texts and overlapping terms of all rules, in one automaton and in several."""
    monkeypatch.setattr(W, "LIMIT", limit)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("ab_-§é ") for _ in range(rng.randrange(1, 4)))
    terms = [(kind, n, word(), rule) for kind, rule in (("x", "in"), ("y", "word"), ("z", "words"), ("x2", "words")) for n in range(9)]
    texts = ["".join(rng.choice("abs_-§é  .") for _ in range(rng.randrange(0, 25))) for _ in range(120)] + [None, ""]
    rows = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "i int, low string, other string").repartition(5)
    out = W.with_hits(rows, "low", spark.createDataFrame(terms, W.TERMS))
    assert out.columns == ["i", "other", "hits"]
    assert found(out) == {i: sorted({(k, n, t) for k, n, t, rule in terms if re.search(RULES[rule](t), text or "")}) if text else [] for i, text in enumerate(texts)}


def test_terms_of_a_file(spark, tmp_path):
    path = tmp_path / "terms.csv"
    path.write_text('raw_term,code\n Employer ,e\n"a, b",x\n,none\nvendor,v\n')
    terms = W.terms_read(spark, str(path), "role", "raw_term", "words")
    assert sorted(map(tuple, terms.collect())) == [("role", 0, "employer", "words"), ("role", 1, "a, b", "words"), ("role", 2, "vendor", "words")]
    rows = spark.createDataFrame([(1, "employers"), (2, "employment, a, b"), (3, "the vendor's")], "i int, low string")
    assert found(W.with_hits(rows, "low", terms)) == {1: [("role", 0, "employer")], 2: [("role", 1, "a, b")], 3: [("role", 2, "vendor")]}
    with pytest.raises(Exception, match="no rule"):
        W.with_hits(rows, "low", W.terms_of(spark, "k", ["a"], "anywhere")).collect()


@pytest.mark.parametrize(
    "action, want",
    [
        ("conduct an impact_assessment before deployment", ("impact_assessment", "assessment")),
        ("provide disclosure to affected individuals", ("disclosure_to_user", "disclosure")),
        ("complete registration with the state registry", ("registration", "registration")),
        ("a third_party_audit and disclosure", ("third_party_audit", "assessment")),
        ("do the thing described elsewhere", (None, None)),
    ],
)
def test_families(spark, action, want):
    rows = spark.createDataFrame([(1, action)], "i int, low string")
    hits = W.with_hits(rows, "low", W.terms_of(spark, "family", [t for t, _ in V.FAMILY_TERMS]))
    code = W.first_code("family", V.FAMILY_TERMS, longest=True)
    assert tuple(hits.select(code.alias("c"), V.crosswalk(code, V.FAMILY_TYPES).alias("t")).first()) == want


def test_first_in_file_order_and_longest_first(spark):
    codes = [("ab", "short"), ("b c", "second"), ("abc", "long"), ("cde", "as long")]
    rows = spark.createDataFrame([(1, "xabc cdex"), (2, "b c"), (3, "none")], "i int, low string")
    out = W.with_hits(rows, "low", W.terms_of(spark, "k", [t for t, _ in codes])).select("i", W.first_code("k", codes).alias("f"), W.first_code("k", codes, True).alias("l"), W.of_kind("k").alias("all"))
    assert {r.i: (r.f, r.l, r.all) for r in out.collect()} == {1: ("short", "long", ["ab", "abc", "cde"]), 2: ("second", "second", ["b c"]), 3: (None, None, [])}


def test_terms_of_a_law(spark):
    df = spark.range(1).select(V.law_terms(F.array(F.lit("Automated Decision Systems; AI"), F.lit(None).cast("string"), F.lit("Deepfakes/ hiring ")), F.lit("The Deployer's notice, noticed; BIAS"), F.lit("fine; fined; penalties")).alias("t"))
    assert sorted(df.first().t) == sorted(["automated decision systems", "deepfakes", "hiring", "deployer", "notice", "bias", "fine", "penalties"])


@pytest.mark.parametrize("text, want", [("an A.I. system", True), ("automatic tools", True), ("the aid system", False), ("automated things", False), ("ai   model", True), (None, None)])
def test_key_patterns(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(V.key_pattern(F.col("t")).alias("k")).first().k is want


# definitions


def loose(text):
    return " ".join("".join(c.lower() if c.isalnum() else " " for c in text or "").split())


def same(a, b, term):
    pattern = r"^(?:(?:as used|for (?:the )?purposes?) (?:of |in )?this \w+ )?(?:the term )?" + re.escape(loose(term)) + r" (?:means|includes|has the same meaning as) "
    a, b = (re.sub(pattern, "", loose(x), count=1) for x in (a, b))
    return bool(a and b) and (a == b or a.startswith(b) or b.startswith(a) or SequenceMatcher(None, a, b).ratio() >= 0.9)


def loop_definitions(rows):
    """Each definition against all of its law and term that stayed, in the order of writing."""
    stayed, out = {}, {}
    for law, order, term, text in sorted(rows, key=lambda r: r[1]):
        out[order] = None
        if not loose(term) or not loose(text):
            continue
        mine = stayed.setdefault((law, loose(term)), [])
        out[order] = next((o for o, t in mine if same(text, t, term)), None)
        if out[order] is None:
            mine.append((order, text))
    return out


def told(spark, rows):
    df = spark.createDataFrame(rows, "law string, at long, term string, said string").repartition(6)
    out = first_definitions(df, "law", "at", "term", "said").collect()
    assert len(out) == len(rows)
    return {r.order: r.duplicate_of for r in out}


@pytest.mark.parametrize("size", [60, 300])
def test_definitions_are_those_of_a_loop(spark, size):
    """Random edits of a few texts, short and long (where the matcher drops frequent characters)."""
    rng = random.Random(size)
    base = ["".join(rng.choice("abcdefgh  ") for _ in range(rng.randrange(size // 2, size))) for _ in range(5)]

    def edited(t):
        t = list(t)
        for _ in range(rng.choice([0, 1, len(t) // 18, len(t) // 10, len(t) // 5])):
            at = rng.randrange(len(t))
            t[at : at + 1] = rng.choice([[], [rng.choice("xyzab")], [t[at], "q"]])
        return rng.choice(["", "", "As used in this act, “AI” means ", "The term ai includes "]) + "".join(t)[: rng.choice([None, None, len(t) - 7])] + rng.choice(["", ".", " ;"])

    rows = [(rng.choice(["l1", "l2", None]), n, rng.choice(["AI", "ai ", "a.i."]), rng.choice(["", None, edited(rng.choice(base))] + [edited(rng.choice(base))] * 6)) for n in range(240)]
    want = loop_definitions(rows)
    assert told(spark, rows) == want and sum(v is not None for v in want.values()) > 30


def test_preambles_and_copies(spark):
    body = "to delay or linger without a lawful purpose for being on the property and for the purpose of committing a crime"
    rows = [("l", 1, "loiter", body), ("l", 2, "Loiter", "As used in this subdivision, “loiter” means " + body + "."), ("l", 3, "loiter", "to be anywhere at night"), ("m", 4, "loiter", body), ("l", 5, "linger", body)]
    rows += [("l", 10 + k, "loiter", body.upper()) for k in range(200)] + [("l", 300, "loiter", body[:60])]
    assert told(spark, rows) == {1: None, 2: 1, 3: None, 4: None, 5: None, 300: 1} | {10 + k: 1 for k in range(200)}


def test_prose_of_one_language_is_seldom_compared(monkeypatch):
    """Texts of the same characters, in other words, are told apart before the matcher is asked."""
    import random

    from statuta.operators import definitions as D

    rng, calls = random.Random(5), []
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    ratio = D.SequenceMatcher.ratio
    monkeypatch.setattr(D.SequenceMatcher, "ratio", lambda self: calls.append(1) or ratio(self))
    stayed = D.Stayed()
    for n in range(60):
        text = " ".join(rng.choice(words) for _ in range(70))[:400]
        assert stayed.alike(text) is None
        stayed.add(n, text)
    assert len(calls) < 60 and stayed.alike(stayed.texts[7][:200]) == 7


def test_whole_texts_are_compared(spark, sf):
    """Two texts that differ only after their first 400 characters are two definitions, unless nine tenths are the same."""
    from statuta.plans.records import definitions_once

    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    said = [(r.source, r.doc_id, r.lang, (f'As used in this section, "{r.lang}" means ' if r.doc_id % 3 == 0 else "") + r.text) for r in docs.values()]
    got = {r.doc_id: r.duplicate_of for r in definitions_once(spark, sf).collect()}
    assert got == loop_definitions(said) and any(got.values())
    head, rng = "the same beginning of both texts " * 15, random.Random(1)
    tail = lambda: "".join(rng.choice("abcdefgh ") for _ in range(500))
    folder = tempfile.mkdtemp(prefix="texts-", dir="/tmp")
    spark.createDataFrame([("s", 1, "en", head + tail()), ("s", 2, "en", head + tail())], "source string, doc_id long, lang string, text string").write.parquet(f"{folder}/documents.parquet")
    assert {r.doc_id: r.duplicate_of for r in definitions_once(spark, folder).collect()} == {1: None, 2: None}


def test_long_near_copies_are_those_of_a_loop(spark):
    """Texts of 30 to 2,500 characters with rare anchors, many anchors and none, edited in up to a fifth of their words."""
    rng, rows = random.Random(8), []
    for kind in ("etaoinshrdlu", "etaoinshrdluqxzjkvw0123456789", "".join(map(chr, range(0x4E00, 0x4F00)))):
        word = lambda: "".join(rng.choice(kind) for _ in range(rng.randrange(1, 9)))  # noqa: E731, B023
        for size in (6, 30, 90, 400):
            for _ in range(4):
                base = [word() for _ in range(size)]
                for share in (0, 0.01, 0.03, 0.05, 0.1, 0.2):
                    rows.append([w if rng.random() >= share else rng.choice(["", word(), w + " " + w]) for w in base[: rng.choice([None, None, None, size * 2 // 3])]])
    rng.shuffle(rows)
    rows = [(rng.choice("lm"), n, "ai", " ".join(r)) for n, r in enumerate(rows)]
    want = loop_definitions(rows)
    assert told(spark, rows) == want and sum(v is not None for v in want.values()) > 60


def test_blocks_are_those_of_the_library():
    from statuta.operators.definitions import Anchors, blocks_enough

    rng, alike = random.Random(2), 0
    for _ in range(300):
        signs = rng.choice(["etaoinshrdlu   qxz", "".join(map(chr, range(97, 123))) + "0123456789   "])
        b = "".join(rng.choice(signs) * rng.choice([1, 1, 2]) for _ in range(rng.choice([80, 150, 300, 700])))
        a = list(b)
        for _ in range(rng.choice([0, 1, 2, len(a) // 40, len(a) // 15])):
            at = rng.randrange(len(a))
            a[at : at + rng.choice([0, 1, 5])] = rng.sample(signs, rng.choice([0, 1, 4]))
        a, matcher = "".join(a), SequenceMatcher(None, "", b)
        want = SequenceMatcher(None, a, b).ratio() >= 0.9
        assert blocks_enough(matcher, a) == want
        alike += want
        if len(b) >= 200:
            (alo, ahi), (blo, bhi) = (sorted(rng.sample(range(len(x) + 1), 2)) for x in (a, b))
            assert Anchors(matcher, a).longest(alo, ahi, blo, bhi) == tuple(matcher.find_longest_match(alo, ahi, blo, bhi))
    assert 60 < alike < 280
