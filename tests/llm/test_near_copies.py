"""Near copies of the pipeline against brute-force Jaccard."""

import random

import corpus_pipeline
from statuta.llm import near_copies, simhash
from statuta.llm.common import written

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_pairs_from_0_8_on_are_linked_and_others_are_not(spark):
    rng, texts = random.Random(5), []
    for k in range(120):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 300))]
        texts.append(" ".join(words))
        for at in rng.sample(range(len(words)), 1 + k % 4):
            words[at] = f"other{k}"
        texts.append(" ".join(words).upper())
    sets, first = list(map(shingles, texts)), list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                first = [first[j] if f == first[i] else f for f in first]
    heads = {min(i for i, f in enumerate(first) if f == g) for g in set(first)}
    assert 120 < len(heads) < 200
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == sorted(heads)


def test_large_group_over_several_blocks_and_empty_texts(spark):
    base = [f"b{i}" for i in range(100)]
    rows = [(i, " ".join(base[: 50 + i % 7] + [f"x{i}"] + base[50 + i % 7 :]), "en", "s", 0) for i in range(1500)]
    docs = spark.createDataFrame(rows + [(5000, None, "en", "s", 0), (5001, "", "en", "s", 0), (None, "one other text", "en", "s", 0)], DOCS)
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == {0, 5000, None}


def test_leaders_and_splits_lose_no_link(spark, monkeypatch):
    """Families of copies and chains of them in buckets of many small blocks, at each depth, against all pairs."""
    rng, texts = random.Random(9), []
    base = [f"b{i}" for i in range(200)]
    for family in range(12):
        words = list(base)
        for at in rng.sample(range(200), 6 * (family % 3)):
            words[at] = f"f{family}"
        for _ in range(25):
            texts.append(" ".join(words))
            words[rng.randrange(200)] = f"m{len(texts)}"
    sets, first = list(map(shingles, texts)), list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and first[i] != first[j]:
                first = [min(first[i], first[j]) if f in (first[i], first[j]) else f for f in first]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    own = docs.select("doc_id", "text", near_copies._text_key("text").alias("text_key"))
    marked = written(own.mapInArrow(near_copies._marks, "doc_id long, fp long, text_key long, bands array<long>"))
    key = {r.doc_id: r.fp for r in marked.collect()}
    monkeypatch.setattr(near_copies, "BLOCK", 4)
    monkeypatch.setattr(near_copies, "FEW", 1)
    monkeypatch.setattr(simhash, "LEADERS", 2)
    for splits in (0, 1, 2):
        monkeypatch.setattr(near_copies, "SPLITS", splits)
        label = {r.node: r.component for r in simhash.connected_components(near_copies.links(docs, marked)).collect()}
        found = [label.get(key[i], key[i]) for i in range(len(texts))]
        told = {frozenset(i for i, f in enumerate(x) if f == g) for x in (found,) for g in set(x)}
        assert told == {frozenset(i for i, f in enumerate(first) if f == g) for g in set(first)}


def test_simhash_links_what_shares_no_minima(spark):
    """Pairs within op9's radius are found by the covering masks alone, and a pair of one fingerprint but other words is not linked."""
    base = [f"b{i}" for i in range(600)]
    texts = [" ".join(base), " ".join([*base[:200], "x", *base[201:]]), " ".join(f"o{i}" for i in range(300))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    sets = [near_copies.shingle_set(t) for t in texts]
    prints = [near_copies.fingerprint(s) for s in sets]
    assert 0 < (prints[0] ^ prints[1]).bit_count() <= simhash.RADIUS
    prints[2] = prints[0]
    text_keys = [r.k for r in docs.orderBy("doc_id").select(near_copies._text_key("text").alias("k")).collect()]
    alone = [[p, *range(100 * i, 100 * i + near_copies.BANDS)] for i, p in enumerate(prints)]
    rows = [(i, near_copies.set_key(s), text_keys[i], alone[i]) for i, s in enumerate(sets)]
    marked = written(spark.createDataFrame(rows, "doc_id long, fp long, text_key long, bands array<long>"))
    a, b = sorted(r[1] for r in rows[:2])
    assert [tuple(r) for r in near_copies.links(docs, marked).collect()] == [(a, b)]
