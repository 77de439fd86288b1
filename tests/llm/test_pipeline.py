"""The pipeline, stage by stage, against brute force on what the stage before it kept."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
import sentencepiece
from compare import spark_rows, sql_rows, views
from test_operators import awkward, brute_mix, docs_of

from statuta.llm import queries as llm
from statuta.llm import sp_transducer
from statuta.llm.common import made_so_far


def shingles(text):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_operator_query_agrees_with_sql(spark, sf, name):
    assert spark_rows(llm.queries()[name](spark, sf)) == sql_rows(views(sf), llm.oracle_sql()[name])


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append([r.asDict() for r in docs.collect()])
    clean, exact, near, mixed = kept

    toxic = {r.doc_id for r in llm.op10_toxicity(spark, sf).filter("flagged").collect()}
    assert {r["doc_id"] for r in clean} == {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect()} - toxic

    norm, groups = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), defaultdict(list)
    for r in clean:
        groups[norm(r["text"])].append(r["doc_id"])
    assert Counter(r["doc_id"] for r in exact) == Counter(map(min, groups.values()))

    sets = {r["doc_id"]: shingles(r["text"]) for r in exact}
    first = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and len(sets[i] & sets[j]) >= 0.8 * max(1, len(sets[i] | sets[j])):
                a, b = first[i], first[j]
                first = {k: min(a, b) if v in (a, b) else v for k, v in first.items()}
    assert Counter(r["doc_id"] for r in near) == Counter(set(first.values()))

    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in near]
    served = brute_mix(rows)[3]
    assert Counter(r["doc_id"] for r in mixed) == Counter({rows[k][0]: n for k, n in served.items()})

    sp = sentencepiece.SentencePieceProcessor(model_file=sp_transducer.DEFAULT_MODEL)
    got = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in corpus_pipeline.encode(spark, docs, sf).collect())
    assert got == Counter((r["doc_id"], tuple(sp.encode(r["text"])) if r["text"] else (), (r["text"] or "").replace("▁", " ")) for r in mixed)


def test_stages_on_awkward_rows_and_on_none(spark, sf):
    """Null and repeated ids, null and empty texts, clashing extra columns, and an empty table: no stage fails or loses columns."""
    rows = docs_of(spark, awkward())
    for docs in (rows, rows.filter("false")):
        columns, n = docs.columns, docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == columns, name
            if name in ("exact_dedup", "near_dedup"):
                keys = Counter((r.doc_id, r.text) for r in docs.collect())
                assert all(k == 1 for k in keys.values())
        out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
        assert out.columns == ["doc_id", "ids", "n_tokens", "decoded"] and (out.count() > 0) == (n > 0)


def test_run_leaves_one_table_behind(spark, sf):
    began = made_so_far()
    corpus_pipeline.run(spark, sf).count()
    assert made_so_far() == began + 1


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "ids", "n_tokens", "decoded"] and out.count() > 0
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
