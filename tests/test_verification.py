"""Passes of verification: what is checked again, what is read, and that nothing changes twice."""

from statuta.operators import verification as V

FACTS = "fact_id long, passage_id long, quote string, number string, cited string"


def stamps_of(df):
    return {r.fact_id: (r.fingerprint, r.quote_found, r.number_found, r.section, r.section_how) for r in df.collect()}


def stored(spark, path, change=None):
    rows = [(k, f"law{k % 3}", None if k % 4 == 0 else f"Section {k}", f"Passage {k} says: a fine of {100 * k} dollars.") for k in range(40)]
    V.store_passages(spark.createDataFrame([r if k != change else (*r[:3], r[3].replace("fine", "penalty")) for k, r in enumerate(rows)], "passage_id long, law string, path string, text string"), path)
    return path


def facts(spark, edits=()):
    rows = {k: (k, k, f"a FINE of {100 * k}", str(100 * k), f"Sec. {k}") for k in range(40)}
    rows[50] = (50, 99, "no passage", "1", None)
    rows[51] = (51, None, None, None, None)
    for k, *new in edits:
        rows[k] = (k, *new)
    return spark.createDataFrame(list(rows.values()), FACTS).repartition(4)


def test_first_pass(spark, tmp_path):
    found, n = V.verification_pass(spark, facts(spark), stored(spark, str(tmp_path / "p")))
    got = {k: v[1:] for k, v in stamps_of(found).items()}
    assert n == 42 and got[5] == (True, True, 5, "exact") and got[1] == (True, True, 1, "exact")
    assert got[8] == (True, True, 38, "number") and got[4] == (True, True, 34, "number")  # their own sections have no path
    assert got[50] == (False, False, None, None) and got[51] == (False, None, None, None)


def test_second_pass_changes_nothing_and_reads_no_text(spark, tmp_path, monkeypatch):
    path = stored(spark, str(tmp_path / "p"))
    first = V.Steps(spark).written("s", V.verification_pass(spark, facts(spark), path)[0])
    monkeypatch.setattr(V, "checked", lambda *a: (_ for _ in ()).throw(AssertionError("nothing is to be checked")))
    again, n = V.verification_pass(spark, facts(spark), path, first)
    assert n == 0 and stamps_of(again) == stamps_of(first)
    assert "text" not in again._jdf.queryExecution().executedPlan().toString().replace("textFile", "")


def test_only_changed_facts_are_checked(spark, tmp_path, monkeypatch):
    """An edited fact, a new one and one that is gone; a changed text; a new version of the rules."""
    path, seen, real = stored(spark, str(tmp_path / "p")), [], V.checked
    first = V.Steps(spark).written("s", V.verification_pass(spark, facts(spark), path)[0])

    def watched(changed, passages, sections):
        seen.append((sorted(r.fact_id for r in changed.collect()), passages))
        return real(changed, passages, sections)

    monkeypatch.setattr(V, "checked", watched)
    edits = [(7, 7, "another quote", "8", "Sec. 9"), (60, 3, "passage 3", None, None)]
    found, n = V.verification_pass(spark, facts(spark, edits).filter("fact_id <> 20"), path, first)
    got, before = stamps_of(found), stamps_of(first)
    assert n == 2 and seen[-1][0] == [7, 60] and 20 not in got and len(got) == 42
    assert {k: v for k, v in got.items() if k not in (7, 60)} == {k: v for k, v in before.items() if k not in (7, 20)}
    # the reader opens the folders of two passages at most
    assert 1 <= seen[-1][1].select("passage_id").inputFiles().__len__() and "PartitionFilters: [" in seen[-1][1]._jdf.queryExecution().executedPlan().toString()
    other = stored(spark, str(tmp_path / "q"), change=12)
    found, n = V.verification_pass(spark, facts(spark), other, first)
    assert n == 1 and seen[-1][0] == [12] and stamps_of(found)[12][1] is False
    monkeypatch.setattr(V, "RULES", V.RULES + 1)
    assert V.verification_pass(spark, facts(spark), path, first)[1] == 42


def test_a_law_s_sections_are_part_of_the_fingerprint(spark, tmp_path):
    path = stored(spark, str(tmp_path / "p"))
    first = V.Steps(spark).written("s", V.verification_pass(spark, facts(spark), path)[0])
    rows = spark.read.parquet(path).drop("key", "bucket")
    more = rows.unionByName(spark.createDataFrame([(100, "law1", "Section 4", "x")], rows.schema))
    V.store_passages(more, str(tmp_path / "q"))
    _, n = V.verification_pass(spark, facts(spark), str(tmp_path / "q"), first)
    assert n == 13  # the facts of law1
