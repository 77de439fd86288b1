"""The ten operators against brute force, on awkward tables and on the smallest test tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from statuta.llm import exact_dedup, line_dedup, line_rules, mil_quality, mixing, quotes, sharding, simhash, sp_transducer, toxicity
from statuta.llm import queries as llm

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, size long, cell string, target double, h string, d long, fp long, score double, link string, __id long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 1, 2, "c", 0.5, "h", 4, 5, 0.5, "l", 6) for i, t, lang, s in rows], SCHEMA)


def awkward():
    rng = random.Random(3)
    words = "law notice duty Term clause » naïve ÉTÉ 日本 a b c d e f".split()
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = "Shared Line of all"
    rows = [(1, None, "en", "s1"), (2, "", "en", None), (3, "   \n\t", None, "s1"), (4, "\n", "fr", "s2"), (5, prose(40_000), "en", "hot")]
    rows += [(6 + k, "same text\nshared line of all", "en", "hot") for k in range(30)]
    rows += [(6, "same text\nshared line of all", "en", "hot")] * 2 + [(None, "text without id", "de", "s2"), (None, None, None, None)]
    rows += [(40 + k, prose(30) + f"\n  {shared}\t\n" + prose(12), "en", ("s1", "s2", "hot")[k % 3]) for k in range(40)]
    rows += [(90 + k, prose(k) + "\r\n" + "a b c d e f g h i " * k, "es", "s3") for k in range(12)]
    rows += [(110, "x y z\x0bw", "en", "s4"), (111, "X Y z\x0bw", "en", "s4")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return docs_of(spark, rows).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [(1, "a", "en", "s")]).filter("false")


@pytest.fixture(scope="module")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


def got(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


# 1 sharding


@pytest.mark.parametrize("shards", [3, 24])
def test_sharding_law(docs, rows, shards):
    out = sharding.shard_documents(docs, n_shards=shards).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    sizes = Counter(r.shard for r in out)
    assert set(sizes) <= set(range(shards)) and max(sizes.values()) - min(sizes[s] for s in range(shards)) <= 1
    for s in sizes:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
    assert {(r.law, r.grown_shard) for r in out} == {("rows", None)}


def cut_groups(out, group):
    shards = defaultdict(set)
    for r in out:
        shards[group(r.doc_id)].add(r.shard)
    sizes = Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes[s] for s in range(24)) <= 1
    return Counter(len(x) for x in shards.values()), shards


def test_sharding_cuts_no_more_than_it_must(spark):
    """2000 groups of five, all linked: 24 shards of 416 or 417 rows hold 83 whole groups each, so 8 must be cut."""
    out = sharding.shard_documents(docs_of(spark, [(k, f"group {k // 5}", "en", "s") for k in range(10_000)])).collect()
    spread, _ = cut_groups(out, lambda i: i // 5)
    assert sum(spread.values()) - spread[1] <= 8 * 1.1


@pytest.mark.parametrize("kind", ["mixed", "hot", "large"])
def test_sharding_under_skew(spark, kind):
    """Groups that fit stay whole but for one a shard, and a group above a quota lies in as few shards as it can."""
    rng, groups = random.Random(4), []
    if kind == "mixed":
        groups = [rng.randrange(2, 21) for _ in range(900)]
    elif kind == "hot":  # a third of all rows in one group
        groups = [3500] + [rng.randrange(2, 11) for _ in range(1150)]
    else:
        groups = [300] * 30 + [rng.randrange(1, 4) for _ in range(1000)]
    of = [g for g, n in enumerate(groups) for _ in range(n)]
    out = sharding.shard_documents(docs_of(spark, [(k, f"group {g}", "en", "s") for k, g in enumerate(of)])).collect()
    spread, shards = cut_groups(out, of.__getitem__)
    quota = len(of) // 24
    cut = [g for g, n in enumerate(groups) if len(shards[g]) > 1 and n <= quota]
    assert len(cut) <= 24 and len(out) == len(of)
    assert all(len(shards[g]) <= -(-n // quota) + 1 for g, n in enumerate(groups) if n > quota)


# 2 quotation linking


MESSAGES = "conv_id long, turn long, role string, text string, level int, key string"


def brute_conversations(said):
    """Loops over messages: (conv, turn) -> parent, root, depth, position, linked pieces, origins."""
    def parse(text):
        out, last = [], None
        for line in (text or "").split("\n"):
            bare, level = line, 0
            while bare.lstrip(" \t").startswith(">"):
                bare, level = bare.lstrip(" \t")[1:], level + 1
            normal = b" ".join(bare.encode().lower().split()).decode()
            if not normal:
                last = None
            elif level == last:
                out[-1][1].append(normal)
            else:
                out.append((level, [normal]))
                last = level
        return out

    convs, out = defaultdict(lambda: defaultdict(list)), {}
    for c, t, _, text in said:
        if c is not None and t is not None:
            convs[c][t].append(parse(text))
    for c, turns in convs.items():
        says, parent = defaultdict(list), {}
        for t in sorted(turns):
            votes, origins, n = Counter(), set(), 0
            latest = lambda x: max(says[x], default=None)
            for parsed in turns[t]:
                for level, lines in parsed:
                    if level:
                        pieces = [" ".join(lines)]
                        if latest(pieces[0]) is None and len(lines) > 1:
                            pieces = [x for x in lines if len(x.split(" ")) >= 3]
                        for x in pieces:
                            if (source := latest(x)) is not None:
                                n += 1
                                origins.add((level, source))
                                votes[source] += len(x) if level == 1 else 0
            best = max(((chars, s) for s, chars in votes.items() if chars), default=(0, None))[1]
            parent[t] = best
            out[c, t] = [best, n, ",".join(f"{a}:{b}" for a, b in sorted(origins))]
            for parsed in turns[t]:
                for level, lines in parsed:
                    if not level:
                        for x in {" ".join(lines), *(x for x in lines if len(x.split(" ")) >= 3)}:
                            says[x].append(t)
        path = {}
        for t in sorted(turns):
            path[t] = (path[parent[t]] if parent[t] is not None else ()) + (t,)
        for k, t in enumerate(sorted(turns, key=path.__getitem__)):
            out[c, t] += [path[t][0], len(path[t]) - 1, k]
    return out


def generated_conversations(seed=12):
    """Thousands of messages that quote earlier ones: whole, in part, nested, edited, rewrapped, ambiguous, or by one word."""
    rng, said = random.Random(seed), []
    word = lambda: rng.choice("law term notice party clause date rule fee act form".split()) + str(rng.randrange(40))
    for c in range(60):
        texts = []
        for t in range(rng.choice([1, 20, 60, 90])):
            lines = [" ".join(word() for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 5))]
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(["", "yes", "Thank you very much", "I agree"]))
            quoted = []
            if texts and rng.random() < 0.7:
                for source in rng.sample(texts, min(len(texts), rng.choice([1, 1, 2]))):
                    part = source.split("\n")
                    kind = rng.randrange(6)
                    if kind == 0:
                        part = part[rng.randrange(len(part)) :]
                    elif kind == 1:
                        part[rng.randrange(len(part))] += " edited"
                    elif kind == 2 and all(x and not x.startswith(">") for x in part):
                        part = [" ".join(part)]
                    elif kind == 3:
                        part = ["Yes"]
                    quoted += [rng.choice(["> ", ">", " >\t"]) + rng.choice([x, x.upper()]) for x in part] + [""]
            texts.append("\n".join(quoted + lines))
            said.append((c, t * 700, rng.choice(["user", "assistant"]), texts[-1]))
    return said


def test_quotes_against_a_loop(spark):
    said = generated_conversations()
    said += [(7, 700, "user", "> I agree\nA second text of this turn"), (8, None, "user", "> I agree"), (None, 3, "user", "> I agree"), (9, 1_000_000, "user", None)]
    said.append((9, 1_000_001, "user", "long " * 50_000 + "\n" + "\n".join(f"> Thank you very much\n>> line {k}" for k in range(3000))))
    want = brute_conversations(said)
    out = quotes.linked_conversations(spark.createDataFrame([(*r, 9, "x") for r in said], MESSAGES).repartition(7))
    rows = out.collect()
    found = {(r.conv_id, r.turn): [r.parent_turn, r.n_linked, r.origins, r.thread_root, r.depth, r.position] for r in rows}
    assert len(rows) == len(said) > 2000
    assert {k: v for k, v in found.items() if None not in k} == want
    assert sum(v[1] for v in want.values()) > 1000 and max(v[4] for v in want.values()) > 5 and any("2:" in v[2] for v in want.values())
    assert found[8, None] == [None, 0, "", None, 0, None] and found[None, 3][0] is None
    read = [(r.conv_id, r.position) for r in rows if r.position is not None]
    assert read == sorted(read)  # the table reads as conversations
    text = {(c, t): x for c, t, _, x in said}
    for r in rows:
        if r.conv_id is not None and r.turn is not None and (r.conv_id, r.turn) != (7, 700):
            lines = text[r.conv_id, r.turn]
            assert r.clean_text == (None if lines is None else "\n".join(x for x in lines.split("\n") if not x.strip(" \t").startswith(">")))


def test_quotes(spark):
    said = [
        (1, 0, "user", "Hello World\nsecond point made here"),
        (1, 1, "assistant", "> hello   world\n> second point\n> made here\nAnswer one"),
        (1, 2, "user", "> second point made here\nelsewhere"),
        (1, 3, "assistant", "> Answer one\n>> Hello world second point made here\nreply"),
        (1, 4, "user", None),
        (1, 5, "user", "> never said\nend"),
        (1, 6, "user", "> world\nend"),
        (1, 7, "user", ">> elsewhere\nonly a deeper quote"),
        (None, 0, "user", "> Hello World"),
        (2, None, "user", ""),
        (2, 1, "user", "> Hello World"),
    ]
    out = quotes.linked_conversations(spark.createDataFrame([(*r, 9, "x") for r in said], MESSAGES))
    found = {(r.conv_id, r.turn): r for r in out.collect()}
    assert len(found) == len(said)
    assert [found[1, k].parent_turn for k in range(8)] == [None, 0, 0, 1, None, None, None, None]
    assert [found[1, k].thread_root for k in range(8)] == [0, 0, 0, 0, 4, 5, 6, 7]
    assert [found[1, k].position for k in range(8)] == [0, 1, 3, 2, 4, 5, 6, 7]
    assert (found[1, 3].depth, found[1, 3].n_quoted, found[1, 3].n_linked, found[1, 3].origins, found[1, 3].clean_text) == (2, 2, 2, "1:1,2:0", "reply")
    assert (found[1, 7].n_linked, found[1, 7].origins) == (1, "2:2")
    assert found[1, 4].clean_text is None and found[2, 1].parent_turn is None and found[None, 0].parent_turn is None
    assert quotes.linked_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_quotes_twin_on_generated_messages(spark, tmp_path):
    """The SQL twin where quotes abound, which the tables' conversations do not hold."""
    from compare import spark_rows, sql_rows

    import duckdb

    from statuta.llm.oracles import CHAT

    spark.createDataFrame([(*r, 9, "x") for r in generated_conversations(13)], MESSAGES).select("conv_id", "turn", "role", "text").write.parquet(f"{tmp_path}/conversations")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations/*.parquet')")
    assert spark_rows(quotes.linked_conversations(spark.read.parquet(f"{tmp_path}/conversations"))) == sql_rows(con, CHAT)


# 3 mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, list(names), 1.5 * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total >= 2 * sizes[s]]
        if not full:
            return target | {s: left * weight[s] / total for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def brute_mix(rows, seed="mix-1"):
    """Turns served of each (id, text, source), by one queue after the other and one sorted list of finish times."""
    words = [len(WORD.findall(t or "")) for _, t, *_ in rows]
    sizes, queues, turns = Counter(), defaultdict(list), []
    for k, (i, t, _, s) in enumerate(rows):
        sizes[s] += words[k]
        name = str(i) if i is not None else hashlib.md5((t or "").encode()).hexdigest()
        queues[s].append((hashlib.md5(f"{seed}:{name}".encode()).hexdigest(), -1 if i is None else i, words[k], k))
    target = brute_targets(sizes)
    for s, queue in queues.items():
        upto = 0
        for shuffle, i, n, k in sorted(queue):
            upto += n
            for turn in range(2 if n else 1):
                turns.append(((turn * sizes[s] + upto) / target[s] if target[s] else 0.0, shuffle, i, n, k, turn))
    served, total = [], 0
    for *_, n, k, turn in sorted(turns):
        total += n
        if total > 1.5 * sum(sizes.values()):
            break
        served.append(k)
    return target, sizes, words, Counter(served)


def test_mixing(docs, rows):
    target, sizes, words, served = brute_mix(rows)
    out, taken = mixing.fair_queue(docs).collect(), Counter()
    for r in out:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size and r.taken == r.turns * r.size
        taken[r.source] += r.taken
    assert Counter((r.doc_id, r.size, r.turns) for r in out) == Counter((rows[k][0], words[k], served[k]) for k in range(len(rows)))
    for s in sizes:  # within the document that the source serves next
        assert abs(taken[s] - target[s]) <= max(n for (*_, x), n in zip(rows, words) if x == s) + 1
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    again = mixing.fair_queue(docs.repartition(3)).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in again) == Counter((r.doc_id, r.size, r.taken) for r in out)


def test_mixed_documents_are_the_turns_served(docs, rows):
    """Repeated ids, null ids and texts, clashing columns: each row comes once for each of its turns."""
    out, served = mixing.mixed_documents(docs), brute_mix(rows)[3]
    assert out.columns == docs.columns
    assert Counter((r.doc_id, r.text, r.source, r.h) for r in out.collect()) == sum((Counter({(rows[k][0], rows[k][1], rows[k][3], "h"): n}) for k, n in served.items()), Counter())
    assert out.count() == mixing.fair_queue(docs).agg(F.sum("turns")).first()[0]


def test_mix_reaches_targets_on_many_documents(spark):
    found = mixing.fair_queue(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).groupBy("source").agg(F.max("target").alias("target"), F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= 0.03 * r.target for r in found)


# 4 quality rules


def brute_rules(text):
    text = text or ""
    words, lines, seen, dups = WORD.findall(text), text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if n[w] > 1:
            hit.update(range(i, i + 8))
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(hit), failed


def test_quality_rules(docs, rows):
    out = line_rules.line_verdicts(docs, min_docs=8, max_percent=0)
    found = got(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert found == Counter((i, *brute_rules(t)) for i, t, *_ in rows)
    holders = defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for i, t, _, s in rows:
        for x in (t or "").split("\n"):
            if WORD.search(x):
                holders[s, key(x)].add((i, t))
    for r in out.collect():
        if r.doc_id is None:
            continue
        t, s = next((t, s) for i, t, _, s in rows if i == r.doc_id)
        common = sum(len(WORD.findall(x)) for x in (t or "").split("\n") if len(holders[s, key(x)]) > 8)
        left = r.n_words - common
        assert r.n_common_words == common
        assert r.kept == (not r.base_failed and not (common and (left < 10 or 100 * left < 20 * r.n_words)))
    assert out.filter("n_common_words > 0").count() > 20


# 5 line dedup


def brute_lines(rows):
    holders, split = Counter(), lambda t: (t or "").encode().split(b"\n")
    key = lambda x: x.strip(b" \t\n\x0b\x0c\r").lower()
    for _, t, *_ in rows:
        holders.update({key(x) for x in split(t)})
    out = Counter()
    for i, t, *_ in rows:
        kept = [x for x in split(t) if not key(x) or holders[key(x)] < 10]
        out[i, len(split(t)), len(split(t)) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()] += 1
    return out


@pytest.mark.parametrize("shard_keys", [line_dedup.SHARD_KEYS, 1])
def test_line_dedup(docs, rows, shard_keys):
    out = line_dedup.drop_common_lines(docs, shard_keys=shard_keys)
    assert got(out, "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256)) == brute_lines(rows)
    assert sum(r.n_dropped for r in out.collect()) >= 70


def test_line_dedup_is_reversible(spark, docs, rows):
    before = line_dedup.LineIndex.of(docs)
    before.filters()
    more = docs_of(spark, [(500 + k, "new line\nother", "en", "s") for k in range(12)])
    grown = before.insert(more)
    assert grown.drop_lines(more).filter("n_dropped = 2").count() == 12
    back = grown.delete(more)
    assert back.drop_lines(more).filter("n_dropped > 0").count() == 0
    assert got(back.counts, "hi", "lo", "n_docs") == got(before.counts, "hi", "lo", "n_docs")
    assert got(back.drop_lines(docs), "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256)) == brute_lines(rows)


def test_line_dedup_follows_changes_over_many_shards(spark):
    old = docs_of(spark, [(k, "\n".join(f"line {j} of many" for j in range(k % 7, 60)), "en", "s") for k in range(14)])
    new = docs_of(spark, [(100 + k, "\n".join([f"line {j} of many" for j in range(8)] + ["fresh"]), "en", "s") for k in range(12)])
    decided = lambda index, docs: got(index.drop_lines(docs), "doc_id", "n_lines", "n_dropped", "kept_text")
    before = line_dedup.LineIndex.of(old, shard_keys=5)
    assert before.filters().count() > 8 and before.shards > 8
    grown = before.insert(new)
    assert grown._filters is not None  # carried over, not built anew
    afresh = line_dedup.LineIndex.of(old.unionByName(new), shard_keys=5)
    for docs in (old, new):
        assert decided(grown, docs) == decided(afresh, docs) != decided(before, docs)
    shrunk = grown.delete(new)
    assert shrunk._filters is not None and all(decided(shrunk, docs) == decided(before, docs) for docs in (old, new))


def test_false_positives_are_exceptions(spark):
    """Among many rare lines some look to the filter like frequent ones; they stay all the same."""
    rows = [(k, "\n".join([f"often {j}" for j in range(40)] + [f"rare {k} {j}" for j in range(4000)]), "en", "s") for k in range(12)]
    index = line_dedup.LineIndex.of(docs_of(spark, rows))
    assert sum(len(r.wrong) for r in index.filters().collect()) >= 16
    assert {(r.n_lines, r.n_dropped) for r in index.drop_lines(docs_of(spark, rows)).collect()} == {(4040, 40)}


def test_cuckoo_filter():
    import numpy as np

    rng = np.random.default_rng(1)
    keys = rng.integers(-(1 << 62), 1 << 62, (20_000, 2))
    f = line_dedup.CuckooFilter.of(keys[:10_000, 0], keys[:10_000, 1])
    assert f.contains(keys[:10_000, 0], keys[:10_000, 1]).all() and f.contains(keys[10_000:, 0], keys[10_000:, 1]).mean() < 0.001
    assert all(f.delete(int(h), int(x)) for h, x in keys[:5000]) and f.contains(keys[5000:10_000, 0], keys[5000:10_000, 1]).all()


# 6 SentencePiece


def test_sentencepiece_agrees_with_the_library(spark, sf, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sp_transducer.DEFAULT_MODEL)
    odd = docs_of(spark, [(900, "  two  spaces ", "en", "s"), (901, "▁mark ▁▁x", "en", "s"), (902, "tabs\tand\r\nlines\n\n", "en", "s"), (903, "😀 emoji‍", "en", "s"), (904, " ", "en", "s")])
    own = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id") + 10_000, "text").toDF("doc_id", "text"))
    out = sp_transducer.encoded(own).join(own.withColumnRenamed("doc_id", "i"), F.col("doc_id").eqNullSafe(F.col("i"))).filter("doc_id IS NOT NULL").collect()
    assert len(out) > 250
    for r in out:
        assert list(r.ids) == (sp.encode(r.text) if r.text else []), r.doc_id
        assert r.n_tokens == len(r.ids) and r.decoded == (r.text or "").replace("▁", " ")


def invented_model(kind):
    pieces = ["<unk>"] + [f"<0x{b:02X}>" for b in range(256)] + ["▁", "a", "b", "c", "ab", "bc", "▁a", "abc", "ca", "▁ab", "cab", "é"]
    scores = [0.0] * 257 + [-3.0, -2.5, -2.75, -3.25, -4.0, -4.5, -3.75, -5.5, -5.0, -4.25, -6.5, -3.5]
    return sp_transducer.compiled(pieces, scores, set(range(257)), kind), dict(zip(pieces[257:], scores[257:]))


def test_unigram_paths_are_the_shortest():
    """The same machine with additive weights, against all ways to cut a text."""
    tables, score = invented_model("unigram")
    m, rng = sp_transducer.Transducer(tables), random.Random(6)
    fallback = max(-x for x in score.values()) + sp_transducer.FALLBACK

    def ways(text):
        if not text:
            yield 0.0, ()
        for k in range(1, len(text) + 1):
            if text[:k] in score:
                yield from ((w - score[text[:k]], (tables.pieces.index(text[:k]), *ids)) for w, ids in ways(text[k:]))
        if text and text[0] not in score:
            yield from ((w + fallback, (*(tables.byte_ids[b] for b in text[0].encode()), *ids)) for w, ids in ways(text[1:]))

    for _ in range(300):
        text = "".join(rng.choice("aaabbcc é日") for _ in range(rng.randrange(1, 10)))
        found, every = tuple(m.encode(text).tolist()), list(ways("▁" + text.replace(" ", "▁")))
        least = min(w for w, _ in every)
        assert any(ids == found and w == pytest.approx(least) for w, ids in every), text
        assert m.decode(found) == text


def test_merge_paths_are_what_the_merges_make():
    tables, score = invented_model("merge")
    m, rng = sp_transducer.Transducer(tables), random.Random(7)
    for _ in range(300):
        text = "".join(rng.choice("aaabbcc é日") for _ in range(rng.randrange(1, 12)))
        parts = list("▁" + text.replace(" ", "▁"))
        while pairs := [(-score[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in score]:
            k = min(pairs)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        want = [i for p in parts for i in ([tables.pieces.index(p)] if p in score else [tables.byte_ids[b] for b in p.encode()])]
        assert m.encode(text).tolist() == want and m.decode(want) == text


def test_arc_tables():
    """States of the fallback count the bytes that are missing; the normaliser has one arc for every character."""
    tables, _ = invented_model("merge")
    f, n = tables.fallback, tables.normaliser
    assert len(f.label) == 128 + 64 + 3 * 64 and set(f.target.tolist()) == {0, 1, 2, 3}
    assert sorted(zip(n.source.tolist(), n.label.tolist())) == [(0, sp_transducer.NOTHING), (1, sp_transducer.ANY), (1, ord(" "))]
    assert (tables.ends != sp_transducer.NOTHING).sum() == 12


# 7 exact dedup


def test_exact_dedup(docs, rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[norm(t)].append(i)
    want = Counter()
    for i, t, *_ in rows:
        own = groups[norm(t)]
        keep = min((x for x in own if x is not None), default=None)
        want[i, keep, len(own), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()] += 1
    assert got(exact_dedup.exact_groups(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns and left.count() == len(groups)


# 9 SimHash


def brute_fingerprint(text):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    h = [xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(marked, radius=4):
    parent = list(range(len(marked)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(marked)):
        for b in range(a):
            if (marked[a][1] ^ marked[b][1]).bit_count() <= radius:
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(marked):
        least[root(k)] = min(least.get(root(k), i), i)
    return Counter((i, f"{f:016x}", least[root(k)]) for k, (i, f) in enumerate(marked))


def test_simhash_documents(spark, sf, docs, rows):
    marked = [(i, brute_fingerprint(t)) for i, t, *_ in rows if i is not None]
    out = simhash.near_components(docs.filter("doc_id IS NOT NULL"))
    assert got(out, "doc_id", simhash.hex_of(F.col("fp")), "component_id") == brute_components(marked)
    real = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert got(llm.op9_simhash(spark, sf), "doc_id", "fingerprint", "component_id") == brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in real])


@pytest.mark.parametrize("block", [1024, 8])
def test_simhash_chains_and_full_buckets(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "FEW", simhash.FEW if block > 8 else 1)
    rng, marked, i = random.Random(8), [], 0
    for _ in range(25):
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 40])):
            marked.append((i := i + 1, f))
            for b in rng.sample(range(64), rng.choice([1, 3, 4, 5])):
                f ^= 1 << b
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in marked]
    out = simhash.components_of(spark.createDataFrame(signed, "doc_id long, fp long"))
    assert got(out, "doc_id", simhash.hex_of(F.col("fp")), "component_id") == brute_components(marked)


def test_masks_cover_every_pair_within_the_radius():
    masks, rng = simhash.covering_masks(), random.Random(1)
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not diff & m & (1 << 64) - 1 for m in masks)


def test_near_copies_keep_one_of_each(docs):
    left = simhash.drop_near_copies(docs.filter("doc_id IS NOT NULL"))
    ids = [r.doc_id for r in left.collect()]
    assert left.columns == docs.columns and len(ids) == len(set(ids)) and 6 in ids and 7 not in ids


# 8 and 10: held-out accuracy


def auc(pairs):
    ranked = sorted(pairs)
    n1 = sum(y for _, y in pairs)
    return sum(sum(1 for s2, y2 in ranked if y2 == 0 and s2 < s) + 0.5 * sum(1 for s2, y2 in ranked if y2 == 0 and s2 == s) for s, y in ranked if y == 1) / max(1, n1 * (len(pairs) - n1))


@pytest.mark.parametrize("query, label, floor", [("op8_quality_classifier", "quality", 0.9), ("op10_toxicity", "toxic", 0.9)])
def test_classifier_on_the_held_out_fold(spark, query, label, floor):
    sf = "/root/testdata/sf0.01"
    scored = llm.queries()[query](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("d"), F.col(label).alias("y"))
    out = scored.join(labels, F.col("doc_id") == F.col("d")).filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and 0 <= r.score <= 1 for r in out)
    assert auc([(r.score, r.y) for r in out]) > floor
    assert sum(r.predicted == r.y for r in out) / len(out) > floor


def test_classifiers_on_awkward_rows(spark, docs, empty, labels):
    for found in (toxicity.toxicity(docs, labels), mil_quality.quality(docs, labels)):
        out = found.collect()
        assert len(out) == docs.count() and all(r.score is not None and math.isfinite(r.score) for r in out)
        assert len({r.score for r in out if r.doc_id in range(6, 36)}) == 1
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    none = labels.filter("false")
    assert toxicity.drop_toxic(docs, none).count() == docs.count()
    assert {r.score for r in mil_quality.quality(docs, none).collect()} == {1.0}
    assert toxicity.toxicity(empty, labels).count() == mil_quality.quality(empty, labels).count() == 0


def test_convolution_scores_are_those_of_plain_loops():
    """Tables and chunks of the scorer, and the net itself, against loops over words, filters and windows."""
    import numpy as np

    net, rng = toxicity.ConvNet(), random.Random(5)
    net.trained, net.scale, net.shift = True, 1.7, -0.3
    for k in net.b:
        net.b[k] = np.linspace(-0.2, 0.2, len(net.b[k])).astype(np.float32)

    def brute(text):
        words = [sum((net.e[r] for r in toxicity.word_ids(w)), np.zeros(toxicity.DIM, np.float32)) for w in toxicity.words_of(text)]
        words += [np.zeros(toxicity.DIM, np.float32)] * (3 - len(words))
        total, at = float(net.c), 0
        for k, w in net.w.items():
            for f in range(w.shape[2]):
                best = max(sum(float(words[i + j] @ w[j][:, f]) for j in range(k)) for i in range(len(words) - k + 1))
                total += max(best + float(net.b[k][f]), 0.0) * float(net.v[at])
                at += 1
        return total

    scorer = toxicity.Scorer(net)
    for text in ["", None, "one", "two words", *(" ".join(rng.choice("a bad Word, of some Kind; ouch 日本 9".split()) for _ in range(n)) for n in (3, 4, 50, 130))]:
        want = brute(text)
        ids = np.array([toxicity.word_ids(w) for w in toxicity.words_of(text)] or [[0] * 4])
        assert net.logit(ids) == pytest.approx(want, abs=1e-3)
        assert scorer.score(text) == pytest.approx(1 / (1 + math.exp(-(1.7 * want - 0.3))), abs=1e-3)


def test_chunks_leave_scores_as_they_are(monkeypatch):
    net, rng = toxicity.ConvNet(), random.Random(6)
    net.trained = True
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(n)) for n in (1, 7, 8, 9, 40)]
    whole = [toxicity.Scorer(net).score(t) for t in texts]
    monkeypatch.setattr(toxicity, "CHUNK", 4)
    assert [toxicity.Scorer(net).score(t) for t in texts] == pytest.approx(whole, abs=1e-6)


def test_attention_is_that_of_plain_loops_and_its_gradients_those_of_differences():
    import numpy as np

    net, rng = mil_quality.GatedAttention(), np.random.default_rng(2)
    bag = rng.standard_normal((4, mil_quality.Describer.width)).astype(np.float32)
    p = net.p

    def brute():
        h = [[math.tanh(sum(float(x[i]) * float(p["W"][i, j]) for i in range(len(x))) + float(p["b"][j])) for j in range(mil_quality.H)] for x in np.clip(bag, -6, 6)]
        def gate(v):
            t = [math.tanh(sum(v[i] * float(p["V"][i, a]) for i in range(mil_quality.H))) for a in range(mil_quality.A)]
            s = [1 / (1 + math.exp(-sum(v[i] * float(p["U"][i, a]) for i in range(mil_quality.H)))) for a in range(mil_quality.A)]
            return sum(t[a] * s[a] * float(p["w"][a]) for a in range(mil_quality.A))
        e = [math.exp(gate(v)) for v in h]
        z = [sum(w / sum(e) * v[j] for w, v in zip(e, h)) for j in range(mil_quality.H)]
        return sum(a * float(c) for a, c in zip(z, p["c"])) + float(p["k"][0]), [x / sum(e) for x in e]

    logit, weights = brute()
    assert net.logit(bag) == pytest.approx(logit, abs=1e-4) and net.attention(bag).tolist() == pytest.approx(weights, abs=1e-5)
    # the first step of training moves each weight against its slope, as differences tell it
    net.p = {k: v.astype(np.float64) for k, v in p.items()}
    wide = bag.astype(np.float64)
    net.mean, net.std = wide.mean(axis=0), wide.std(axis=0) + 1e-3
    loss = lambda: math.log(1 + math.exp(-net.logit(wide)))  # noqa: E731  label 1
    slopes = {}
    for name, v in net.p.items():
        for at in list(np.ndindex(v.shape))[:40]:
            old = v[at]
            v[at] = old + 1e-5
            up = loss()
            v[at] = old - 1e-5
            slopes[name, at] = (up - loss()) / 2e-5
            v[at] = old
    before = {k: v.copy() for k, v in net.p.items()}
    net.train([(wide, 1), (wide, 1)], epochs=1)
    clear = {k: s for k, s in slopes.items() if abs(s) > 5e-3}
    assert len({name for name, _ in clear}) >= 5
    for (name, at), slope in clear.items():
        assert (net.p[name][at] - before[name][at]) * slope < 0, name


def test_passages_of_a_text_are_described_alike_in_chunks(monkeypatch):
    import numpy as np

    text = "Some words, 12 of them; and $$$ more! " * 90
    whole = mil_quality.Describer().passages(text)
    monkeypatch.setattr(mil_quality, "CHUNK", 2)
    assert np.allclose(mil_quality.Describer().passages(text), whole)


def test_drop_toxic_without_languages(docs, labels):
    plain = docs.select("doc_id", "text", "h")
    assert toxicity.drop_toxic(plain, labels).columns == plain.columns


def test_attention_is_a_distribution_over_passages():
    import numpy as np

    bag = mil_quality.Describer().passages("Some words, 12 of them; and $$$ more! " * 60)
    a = mil_quality.GatedAttention().attention(bag)
    assert len(a) == len(bag) > 1 and np.isclose(a.sum(), 1) and (a > 0).all()


# empty tables


@pytest.mark.parametrize(
    "apply",
    [sharding.shard_documents, mixing.fair_queue, mixing.mixed_documents, line_rules.line_verdicts, line_dedup.drop_common_lines, sp_transducer.encoded, exact_dedup.exact_groups, exact_dedup.drop_exact_copies, simhash.near_components, simhash.drop_near_copies],
)
def test_empty_tables(empty, apply):
    assert apply(empty).count() == 0
