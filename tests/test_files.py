"""File sources on a small folder."""

import pytest
from pyspark.sql import functions as F

from statuta.sources import files as S


@pytest.fixture()
def folder(tmp_path):
    body = "plain words. " * 60
    for name, data in {
        "a.txt": ("Section 1. " + body).encode(), "a.pdf": b"%PDF", "a.html": b"<html>", "b.html": ("<html>" + body).encode(), "c.txt": b"Section 1", "d.txt": body.encode(),
        "e.txt": body.encode() + b"\xa7 1", "f.txt": (body + "§ 1").encode(), "g.doc": b"x", "sub/h.htm": (body + "WHEREAS").encode(), "empty.txt": b"",
    }.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(data)
    return str(tmp_path)


def test_files_by_precedence_and_gate(spark, folder):
    found = S.local_files(spark, folder)
    rows = {r.law_id: (r.path.rpartition("/")[2], r.content_type, r.status) for r in found.collect()}
    text = "text/plain"
    assert rows == {
        "a": ("a.txt", text, "ok"), "b": ("b.html", "text/html", "capture_failed"), "c": ("c.txt", text, "too_short"), "d": ("d.txt", text, "no_statutory_structure"),
        "e": ("e.txt", text, "ok"), "f": ("f.txt", text, "ok"), "h": ("h.htm", "text/html", "ok"),
    }  # Spark lists no file of 0 bytes
    good, bad = S.split_quarantine(found)
    assert {r.law_id for r in good.collect()} == {"a", "e", "f", "h"} and {r.law_id: r.reason for r in bad.collect()}["b"] == "capture_failed"


def test_page_text(spark):
    html = "<html><head><style>p {}</style></head><body><nav>menu</nav><p>One &amp; two<br/>three</p><del>old</del><section>kept</section><s class='x'>gone</s> &sect; 5 &amp;lt;</body>"
    assert spark.range(1).select(S.page_text(F.lit(html)).alias("t")).first().t == "One & two\nthree\nkept\n§ 5 &lt;"
    assert spark.range(1).select(S.page_text(F.lit(None).cast("string")).alias("t")).first().t is None


def test_vocabulary(spark, tmp_path):
    (tmp_path / "aliases.csv").write_text('raw_term,code\nDeployer,DEP\n"Big, firm",ORG\ndeveloper,OLD\n ,X\nnone,\n')
    (tmp_path / "crosswalk.csv").write_text("code,terms\nDEV,developer; Provider ;\nGOV,agency\n")
    terms = S.vocabulary(S.csv_rows(spark, str(tmp_path / "aliases.csv")), S.csv_rows(spark, str(tmp_path / "crosswalk.csv")))
    assert {r.term: r.code for r in terms.collect()} == {"deployer": "DEP", "big, firm": "ORG", "developer": "DEV", "provider": "DEV", "agency": "GOV"}
    rows, unknown = S.coded(spark.createDataFrame([("DEVELOPER ",), ("nobody",), (None,), ("",), ("Nobody",)], "actor string"), "actor", terms)
    assert sorted(r.actor_code for r in rows.collect()) == ["DEV", "other", "other", "other", "other"]
    assert [tuple(r) for r in unknown.collect()] == [("nobody", 2)]


def test_continuations(spark):
    cells = [(1, 1, "CA", "scope"), (1, 2, None, "goes on"), (1, 3, None, None), (1, 4, "CO", "x"), (2, 1, None, "lost"), (2, 2, "NY", None)]
    rows = S.merge_continuations(spark.createDataFrame(cells, "page int, pos int, state string, scope string"), "pos", "state", "page")
    assert sorted((r.page, r.pos, r.state, r.scope) for r in rows.collect()) == [(1, 1, "CA", "scope goes on"), (1, 4, "CO", "x"), (2, 2, "NY", "")]


def test_export(spark, tmp_path):
    facts = spark.createDataFrame([(1, "x", "A"), (2, None, "D"), (3, "x", "C")], "id int, agent string, tier string")
    S.export(facts, str(tmp_path / "all"), "agent")
    assert sorted(p.name for p in (tmp_path / "all").iterdir() if p.is_dir()) == ["agent=_unattributed", "agent=x"]
    assert {r.id for r in spark.read.csv(str(tmp_path / "all"), header=True, inferSchema=True).filter("agent = 'x'").collect()} == {1, 3}
    S.export(S.low_confidence(facts), str(tmp_path / "low"), "agent", "json")
    assert {r.id for r in spark.read.json(str(tmp_path / "low")).collect()} == {2, 3}
