"""Language filters, conversation repair and vector codes against brute force and on awkward tables."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import spark_rows, sql_rows, views
from pyspark.sql import functions as F

from statuta.llm import chat_repair, language_filters, queries as llm, vector_codes

SPACE = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def con(sf):
    return views(sf)


@pytest.mark.parametrize("name", ["op12_conversation_repair", "op13_vector_codes"])
def test_queries_agree_with_sql(spark, sf, con, name):
    assert spark_rows(llm.queries()[name](spark, sf)) == sql_rows(con, llm.oracle_sql()[name])


# 11 language filters

DOCS = "doc_id long, text string, lang string, source string, fp long, grams long"
SAID = {"aa": "the house of law and order stands there", "bb": "la maison de la loi et des ordres publics", "cc": "das Haus von Recht und Ordnung steht dort"}


def language_docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, 2) for i, t, lang in rows], DOCS)


def taught():
    rng = random.Random(2)
    said = lambda lang, n: " ".join(rng.choice(SAID[lang].split()) for _ in range(n))
    return [(i, said(lang, rng.randrange(1, 60)), lang) for i, lang in ((i, rng.choice(list(SAID))) for i in range(300))]


def test_languages_of_held_out_rows(spark, sf):
    out = llm.op11_language_id(spark, sf)
    told = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("d"), "lang", "text")
    rows = out.join(told, F.col("doc_id") == F.col("d")).collect()
    assert len(rows) == told.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)


def test_languages_ignore_what_they_must(spark):
    """Held-out rows' lang, and every row's source and id, change nothing; neither does the order of rows."""
    rows = taught()
    first = {r.doc_id: (r.lang_pred, r.score) for r in language_filters.languages(language_docs(spark, rows)).collect()}
    lied = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    second = {r.doc_id: (r.lang_pred, r.score) for r in language_filters.languages(language_docs(spark, lied[::-1]).repartition(7)).collect()}
    assert first == second
    assert sum(first[i][0] == lang for i, _, lang in rows) >= 0.97 * len(rows)


def test_languages_on_awkward_rows(spark):
    rows = taught() + [(1000, None, "aa"), (1001, "", "aa"), (1002, " 12 !?\n", "bb"), (1003, "日本語の法律", None), (None, SAID["bb"], "bb"), (None, None, None)]
    rows += [(1004, SAID["cc"] + " 9 " * 50_000, None)] * 2 + [(1005, (SAID["aa"] + "\n") * 20_000, None), (1006, "x" * 300_000, None)] + [(7, "other text of the same id", "bb")]
    found = language_filters.languages(language_docs(spark, rows))
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    out = found.collect()
    assert len(out) == len(rows) and all(math.isfinite(r.score) and 0 <= r.score <= 1 for r in out)
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1000].score == 0
    assert by[1003].lang_pred == "aa" and by[1003].score == pytest.approx(1 / 3, abs=0.01)
    assert by[1004].lang_pred == "cc" and by[1005].lang_pred == "aa"
    clash = spark.createDataFrame([(*r, "Das", 3) for r in rows], "doc_id long, text string, lang string, Text string, LANG int")
    assert Counter(map(tuple, language_filters.languages(clash).collect())) == Counter(map(tuple, out))
    assert language_filters.languages(language_docs(spark, rows).filter("false")).count() == 0
    untaught = language_filters.languages(language_docs(spark, [(i, t, None) for i, t, _ in rows])).collect()
    assert {(r.lang_pred, r.score) for r in untaught} == {("und", 0.0)}


def brute_grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    flat = " " + " ".join(words) + " " if words else " "
    return [flat[i : i + n] for n in (1, 2, 3, 4) for i in range(len(flat) - n + 1) if flat[i : i + n].strip() and " " not in flat[i : i + n].strip() and " " not in flat[i + 1 : i + n - 1]]


@pytest.mark.parametrize("text", ["", "a", "A b", "The law, 12 of it; naïve ÉTÉ", "日本 x", "l'été\n\n«où»  ç", "x" * 40])
def test_ngrams_are_those_of_a_loop(text, monkeypatch):
    whole = np.concatenate([np.zeros(0, np.uint64), *language_filters.pieces(language_filters.plain(text))])
    want = brute_grams(text)
    assert len(whole) == len(want) and len(set(whole.tolist())) == len(set(want))
    assert sorted(Counter(whole.tolist()).values()) == sorted(Counter(want).values())
    monkeypatch.setattr(language_filters, "CHUNK", 3)
    parts = np.concatenate([np.zeros(0, np.uint64), *language_filters.pieces(language_filters.plain(text))])
    assert sorted(parts.tolist()) == sorted(whole.tolist())


def test_filter_holds_all_languages_of_an_ngram_and_corrects_false_ones():
    """70 languages, so two words of bits; each n-gram's mask holds all languages it was given, and true counts are near."""
    rng = np.random.default_rng(1)
    given = {f"l{i:02d}": rng.integers(0, 2**63, 5000).astype(np.uint64) for i in range(70)}
    given["l01"] = np.concatenate([given["l01"], given["l68"][:1000]])
    f = language_filters.Filter(given)
    assert f.words == 2 and f.names == sorted(given)
    for i in (0, 1, 63, 64, 69):
        masks = f.masks(given[f"l{i:02d}"])
        assert all(int(m) >> (i % 64) & 1 for m in masks[:, i // 64])
    hits = f._popcounts(f.masks(given["l68"]))
    true = np.maximum(hits - f.false * 5000, 0) / (1 - f.false)
    assert hits[68] == 5000 and abs(true[1] - 1000) < 30 and true[[0, 2, 40, 69]].max() < 40
    assert (hits[[0, 2, 40, 69]] >= true[[0, 2, 40, 69]]).all()


# 12 conversation repair

SAYINGS = "conv_id long, turn long, role string, text string, ahead long, h string"
TOLD = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def nul(v):
    return " " if v is None else str(v)


def brute_repair(said):
    """Cheapest edits by a search over (row, last initial), least audit first; the grammar by the last initial kept."""
    convs, out = defaultdict(list), {}
    for c, t, role, text in said:
        kind, role, text = zlib.crc32(f"{nul(c)}:{nul(t)}".encode()) % 20, nul(role), nul(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs[c] += [(t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for c, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        turns = [t for t, *_ in rows if t is not None]
        faults, met = [], set()
        for _, role, text in rows:
            bare = text.rstrip(SPACE)
            faults.append("blank" if not bare else "again" if (role, text) in met else "cut" if bare[-1] not in ".!?" else "")
            met.add((role, text))
        follows = {"": "su", "s": "u", "u": "a", "a": "u"}
        heap, done = [(0, "", 0, "", ())], set()
        while True:
            cost, audit, i, last, lines = heapq.heappop(heap)
            if i == len(rows) and last in ("", "a"):
                break
            if (i, last) in done:
                continue
            done.add((i, last))
            names = [n for n in ("user", "assistant") if n[0] in follows[last]]
            ways = [(5, "I", n[0], i, n + ":") for n in names]
            if i < len(rows):
                _, role, text = rows[i]
                ways.append((2, "D", last, i + 1, None))
                if faults[i] in ("", "cut"):
                    more = 5 * (faults[i] == "cut")
                    ways += [(1 + more, "R", n[0], i + 1, n + ":" + text) for n in names]
                    if role and role[0] in follows[last]:
                        ways.append((more, "K", role[0], i + 1, role + ":" + text))
            for more, letter, at, j, line in ways:
                heapq.heappush(heap, (cost + more, audit + letter, j, at, lines if line is None else (*lines, line)))
        n = Counter(faults)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (gaps, n["blank"], n["again"], n["cut"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repaired(df):
    rows = chat_repair.repair_conversations(df).collect()
    out = {r.conv_id: tuple(r[k] for k in TOLD) for r in rows}
    assert len(out) == len(rows)
    return out


def sayings(seed, rows=1500, convs=150):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "umpire", "Ünal"]
    texts = ["a.", "b!", "c", "d?", " ", None, "", "e. ", "f.\n", "g.\x0b", "h. ", "日本。", ".", "i j k."]
    return [(rng.choice([None, *range(convs)]), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_is_that_of_a_search(spark, seed):
    said = sayings(seed)
    df = spark.createDataFrame([(*r, 1, "x") for r in said], SAYINGS).repartition(6)
    assert repaired(df) == brute_repair(said)


def test_repair_of_the_tables(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    assert repaired(df) == brute_repair([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])


def test_repair_by_hand(spark):
    """Turns are chosen so that nothing is damaged (5 and more out of crc32 % 20)."""
    sound = [t for t in range(200) if zlib.crc32(f"1:{t}".encode()) % 20 > 4]
    def of(*rows):
        said = [(1, sound[i], role, text) for i, (role, text) in enumerate(rows)]
        return repaired(spark.createDataFrame([(*r, 1, "x") for r in said], SAYINGS))[1][5:7]
    assert of(("system", "s."), ("user", "u."), ("assistant", "a.")) == (0, "KKK")
    assert of(("user", "u."), ("user", "v."), ("assistant", "a.")) == (2, "DKK")
    assert of(("user", "u."), ("user", "v.")) == (1, "KR")
    assert of(("user", "u.")) == (2, "D")
    assert of(("assistant", "u."), ("assistant", "v.")) == (1, "RK")
    assert of(("user", "u."), ("assistant", "a."), ("user", "u."), ("assistant", "b.")) == (4, "KDDK")
    assert of(("system", "s.")) == (2, "D")


def test_repair_on_awkward_tables(spark):
    empty = spark.createDataFrame([], SAYINGS)
    assert repaired(empty) == {}
    gone = next(t for t in range(100) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repaired(spark.createDataFrame([(5, gone, "user", "a.", 1, "x")], SAYINGS)) == {5: nothing}
    # one conversation of many rows and batches, a long text, repeated rows
    said = [(1, t, ("user", "assistant")[t % 2], f"row {t}." if t % 7 else "again.") for t in range(25_000)] + [(2, 1, "user", "long " * 300_000 + ".")] * 3
    got = repaired(spark.createDataFrame([(*r, "x") for r in said], "conv_id long, turn long, role string, text string, Role string").repartition(9))
    assert got[2] == brute_repair(said[-3:])[2]
    assert len(got[1][6]) >= 23_000 and Counter(got[1][6])["I"] * 5 + Counter(got[1][6])["D"] * 2 <= got[1][5]


def test_costs_of_states_stay_close():
    """The four costs fit in one number: reachable differences are closed and stay under 32."""
    seen, open_ = set(), [chat_repair.packed_costs(chat_repair.AT_END)]
    while open_:
        code = open_.pop()
        if code in seen:
            continue
        seen.add(code)
        ahead = chat_repair.unpacked_costs(code)
        assert max(ahead) < 32
        open_ += [chat_repair.packed_costs(chat_repair.costs(ahead, x, cut)) for x in ("s", "u", "a", "t", "") for cut in (False, True)]
    assert len(seen) < 200


# 13 vector codes

VECTORS = "vec_id long, embedding array<float>, label int, code string, v int"


def brute_codes(vectors, parts=16, entries=64, rounds=2):
    """Loops in Python's own whole numbers: (vec_id, code, error, label) and codebooks."""
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    cut = lambda v: [v[p * w : p * w + w] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda x, book: min(range(len(book)), key=lambda e: (d2(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            of = defaultdict(list)
            for _, v, _ in kept:
                of[nearest(cut(v)[p], books[p])].append(cut(v)[p])
            books[p] = [[sum(c) // len(of[e]) for c in zip(*of[e])] if e in of else old for e, old in enumerate(books[p])]
    out = []
    for i, v, lab in kept:
        near = [nearest(x, books[p]) for p, x in enumerate(cut(v))]
        out.append((i, "".join(f"{e:02x}" for e in near), sum(d2(x, books[p][near[p]]) for p, x in enumerate(cut(v))), lab))
    return out, books


def coded_rows(df, **kw):
    coded, books = vector_codes.vector_codes(df, **kw)
    return Counter((r.vec_id, r.code, r.error, r.label) for r in coded.collect()), books


@pytest.mark.parametrize("kind", ["spread", "ties", "few"])
def test_codes_are_those_of_loops(spark, kind):
    rng = random.Random(kind)
    draw = (lambda: rng.choice([-0.01, 0.0, 0.004, 0.01])) if kind == "ties" else (lambda: rng.gauss(0, 0.2))
    rows = [(rng.choice([k, k, None, 3]), [draw() for _ in range(32)], rng.choice([None, 1, 2])) for k in range(40 if kind == "few" else 260)]
    rows += [(7, None, 1), (8, [None] + [0.1] * 31, 1), (9, [float("nan")] * 32, 2), (10, [float("-inf")] + [0.0] * 31, 2)] + rows[:3]
    df = spark.createDataFrame([(i, v, lab, "c", 1) for i, v, lab in rows], VECTORS).repartition(5)
    got, books = coded_rows(df)
    # single floats, as the table holds them
    want, want_books = brute_codes([(i, v and [x if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows])
    assert got == Counter(want) and books.astype(int).tolist() == want_books


def test_more_rounds_and_small_codebooks(spark):
    rng = random.Random(5)
    rows = [(k, [float(np.float32(rng.gauss(k % 3, 0.3))) for _ in range(8)], k % 2) for k in range(150)]
    got, _ = coded_rows(spark.createDataFrame([(*r, "c", 1) for r in rows], VECTORS), parts=4, entries=6, rounds=5)
    assert got == Counter(brute_codes(rows, 4, 6, 5)[0])


def test_label_errors_and_decoding(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("label", F.when(F.col("vec_id") % 5 > 0, F.col("label")))
    coded, books = vector_codes.vector_codes(df)
    out, sums = vector_codes.with_label_error(coded).collect(), Counter()
    for r in out:
        sums[r.label] += r.error
    assert len(out) == df.count() and all(r.label_error == sums[r.label] for r in out) and None in sums
    near = vector_codes.decoded(coded, books).join(df.select(F.col("vec_id").alias("i"), "embedding"), F.col("vec_id") == F.col("i")).collect()
    for r in near:
        assert sum((math.floor(256 * x) - round(256 * y)) ** 2 for x, y in zip(r.embedding, r.approx)) == r.error


def test_vectors_that_cannot_be_cut(spark):
    rows = [(1, [0.5] * 16, 1, "c", 1), (2, [0.25] * 16, 1, "c", 1), (3, [0.5] * 7, 1, "c", 1), (4, [], 2, "c", 1), (5, [3e38] * 16, 2, "c", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, Embedding string, v int")
    out = {r.vec_id: (r.code is None, r.error) for r in vector_codes.with_label_error(vector_codes.vector_codes(df)[0]).collect()}
    assert set(out) == {1, 2, 3, 4, 5} and out[3] == out[4] == (True, None) and out[1] == (False, 0) and out[5] == (False, 0)
    assert vector_codes.vector_codes(df.filter("vec_id in (3, 4)"))[0].filter("code is null").count() == 2
    assert vector_codes.with_label_error(vector_codes.vector_codes(df.filter("false"))[0]).count() == 0


def test_bounds_spare_scans_and_keep_ties():
    """Assignments under bounds equal full scans over several moves, with many equal distances, and scan fewer rows."""
    rng = np.random.default_rng(3)
    for scale, most in ((2, 1.0), (40, 0.75)):  # equal distances everywhere, then clusters
        x = (rng.integers(-scale, scale + 1, (3000, 4)) + (scale > 2) * 1000 * rng.integers(0, 8, (3000, 1))).astype(np.float64)
        book, scanned = x[:32].copy(), 0
        near, upper, lower = vector_codes.scan(x, book)
        for _ in range(4):
            old, book = book, np.stack([x[near == e].sum(axis=0) // max(1, (near == e).sum()) if (near == e).any() else book[e] for e in range(32)])
            near, upper, lower, n = vector_codes.assigned(x, book, vector_codes.Moves(book, old), near, upper, lower)
            scanned += n
            full = np.array([[int(((a - b) ** 2).sum()) for b in book] for a in x[:400]])
            assert (near[:400] == full.argmin(axis=1)).all() and (near == vector_codes.scan(x, book)[0]).all()
        assert scanned <= 4 * 3000 * most


def test_distances_of_large_numbers_are_exact():
    x = np.array([[2.0**27, -(2.0**27)], [3.0, 4.0]])
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in x] for p in x]
    assert vector_codes.distances(x, x).tolist() == want


# texts of many lines, and long ones without spaces: earlier operators in linear time


def test_many_lines_of_one_text(spark):
    """200,000 lines, most of them distinct; each line once with the words of all its places."""
    import time

    from statuta.llm import line_rules

    lines = [f"line {k % 150_000} of it" for k in range(200_000)]
    df = spark.createDataFrame([(1, "\n".join(lines), "s"), (1, "\n".join(lines), "s"), (2, "One line\n\n one LINE \nb", "s"), (3, None, None)], "doc_id long, text string, source string")
    began = time.time()
    out = Counter((r.doc_id, r.words) for r in line_rules.document_lines(df).select("doc_id", "words").collect())
    assert out == {(1, 8): 2 * 50_000, (1, 4): 2 * 100_000, (2, 4): 1, (2, 1): 1}
    assert time.time() - began < 60


def test_long_text_without_spaces():
    import gc
    import time

    from statuta.llm import sp_transducer as sp

    m, rng = sp.Transducer(sp.load()), random.Random(4)
    text = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(500_000))
    began = time.time()
    with sp.uncollected():
        ids = m.encode(text)
    assert time.time() - began < 60 and m.decode(ids) == text and gc.isenabled()
    head = text[:2000]
    assert m.encode(head).tolist() == ids[: len(m.encode(head))].tolist() or len(m.encode(head)) > 2000
