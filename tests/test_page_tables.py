"""Tables of pages, logs, catalogues and composed texts on small rows worked out by hand."""

import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from statuta.operators import catalogue, composed as N, page_tables as P
from statuta.sources import append_log as L


def grid(html, **kw):
    reader = P.Reader()
    for at in range(0, len(html), kw.get("piece", 1 << 16)):
        reader.feed(html[at : at + kw.get("piece", 1 << 16)])
    reader.close()
    return [(t, r, [c["text"] for c in cells]) for t, r, _, cells in reader.out]


@pytest.mark.parametrize("piece", [1 << 16, 1, 7])
@pytest.mark.parametrize(
    "html, want",
    [
        ("<table><tr><td>a<td>b<tr><td>c</table>", [(0, 0, ["a", "b"]), (0, 1, ["c"])]),
        ("<table><tr><td rowspan=2>a</td><td>b</td></tr><tr><td>c</td></tr><tr><td>d</td></tr></table>", [(0, 0, ["a", "b"]), (0, 1, ["a", "c"]), (0, 2, ["d"])]),
        ("<table><tr><td>a</td><td rowspan=3>b</td></tr><tr><td>c</td></tr><tr></tr><tr><td>d</td></tr></table>", [(0, 0, ["a", "b"]), (0, 1, ["c", "b"]), (0, 2, ["", "b"]), (0, 3, ["d"])]),
        ("<table><tr><td colspan=2 rowspan=2>a</td><td>b</td></tr><tr><td>c</td></tr></table>", [(0, 0, ["a", "a", "b"]), (0, 1, ["a", "a", "c"])]),
        ("<table><tr><td>a <table><tr><td>in</td></tr></table> z</td><td>b</td></tr></table>", [(1, 0, ["in"]), (0, 0, ["a z", "b"])]),
        ("<table><tr><td>x &amp; y<br>z<script>no()</script></td></tr>", [(0, 0, ["x & y z"])]),
        ("<table><td>loose</td></table><p>out</p><table><tr><th>h</th></tr></table>", [(0, 0, ["loose"]), (1, 0, ["h"])]),
        ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>", [(0, 0, ["a", "b"]), (0, 1, ["a", "c"]), (0, 2, ["a", "d"])]),
        ("<table><tr><td colspan='x'>a</td><td colspan=-3>b</td></tr></table></table><td>stray", [(0, 0, ["a", "b"])]),
        ("no table", []),
        ("", []),
    ],
)
def test_grids(html, want, piece):
    assert grid(html, piece=piece) == want


def test_wide_cells_are_bounded():
    (row,) = grid("<table><tr><td colspan=999999999>a</td></tr></table>")
    assert len(row[2]) == P.WIDE_MOST


HEADS = "<tr><th>State</th><th>Bill Number</th><th>Bill Title</th><th>Status</th><th>Last action date</th><th>Topic</th></tr>"


def test_bill_tracker(spark):
    rows = [
        (1, "<table><tr><td>menu</td></tr></table><table>" + HEADS + "<tr><td>Colorado</td><td><a href='/a'>SB 205</a></td><td>AI Act</td><td>Signed</td></tr><tr><td>Nowhere</td><td>1</td><td>2</td><td>3</td></tr><tr><td>Texas</td><td>2</td></tr><tr><td>State</td><td>x</td><td>y</td><td>z</td></tr></table>"),
        (2, "<table><tr><td>State</td><td>Bill</td><td>Title</td><td>Status</td></tr><tr><td>ca</td><td>AB 1</td><td><a href=' /t '>T</a></td><td>Dead</td></tr></table>"),
        (3, "<table><tr><td>one</td></tr></table>"), (4, None), (5, ""),
    ]
    told = P.table_rows(spark.createDataFrame(rows, "page int, html string").repartition(3), "page", "html")
    got = {(r.page, r.row, r.state_code, r.bill_number, r.bill_title, r.status, r.last_action, r.topic, r.url) for r in P.bill_tracker(told, "page").collect()}
    assert got == {(1, 1, "CO", "SB 205", "AI Act", "Signed", "", "", "/a"), (2, 1, "CA", "AB 1", "T", "Dead", "", "", "/t")}


def test_law_tracker(spark):
    head = "<tr><th>State</th><th>AI Scope</th><th>Relevant Law</th><th>Law Link</th><th>Effective Date</th><th>Key Requirements</th><th>Enforcement &amp; penalties</th></tr>"
    rows = [(1, f"<table>{head}<tr><td>Utah</td><td>chat</td><td></td><td><a href='u'>SB 149</a></td><td>May 1</td><td>notice</td><td>AG</td></tr><tr><td>?</td><td>x</td><td><a href='n'>Named</a></td></tr></table>")]
    told = P.table_rows(spark.createDataFrame(rows, "page int, html string"), "page", "html")
    got = [(r.state_code, r.scope, r.law_name, r.url, r.effective_date, r.key_requirements, r.enforcement) for r in P.law_tracker(told, "page").orderBy("row").collect()]
    assert got == [("UT", "chat", "SB 149", "u", "May 1", "notice", "AG"), ("", "x", "Named", "n", "", "", "")]


@pytest.mark.parametrize(
    "heads, want",
    [
        (["State", "Bill Number", "Bill title", "Status"], {"state": 0, "bill_number": 1, "bill_title": 2, "status": 3}),
        (["Bill", "Statehouse", "State", "Title", "Scope", "Subject", "Last", "Date"], {"bill_number": 0, "state": 1, "bill_title": 3, "topic": 5, "last_action": 6, "effective_date": 7}),
        (["Billing", "Bill", "Status", "Status date"], {"bill_number": 1, "status": 2, "effective_date": 3}),
        ([], {}),
    ],
)
def test_column_roles(spark, heads, want):
    df = spark.createDataFrame([(heads,)], "h array<string>")
    got = df.select(P.column_roles(F.col("h"), P.BILL_TRACKER).alias("r")).first().r.asDict()
    assert {k: v for k, v in got.items() if v is not None} == want


# the log

ENTRY = "record_id long, warning_type string, details string, raw_response string"


def test_log_shows_rows_once(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(k, "t", "é\n", "r" * 900) for k in range(50)], ENTRY)
    assert L.read_log(spark, path, ENTRY).count() == 0
    L.append(L.warning_rows(rows.repartition(4)), path)
    L.append(L.warning_rows(rows.limit(3).coalesce(1)), path)
    got = L.read_log(spark, path, "timestamp string, " + ENTRY).collect()
    assert sorted(r.record_id for r in got) == sorted([*range(50), *(r.record_id for r in rows.limit(3).collect())])
    assert {(r.warning_type, r.details, len(r.raw_response)) for r in got} == {("t", "é\n", 500)} and all("T" in r.timestamp for r in got)


def test_repeated_and_lost_attempts_are_not_seen(spark, tmp_path):
    """The same partition written twice, of which one attempt is committed; a third is lost before the driver hears of it."""
    from pyspark.sql import Row

    path, row = str(tmp_path / "log"), Row(record_id=1, warning_type="t", details="d", raw_response=None)
    writer = L.LogWriter(path)
    first, second, _ = writer.write(iter([row])), writer.write(iter([row])), writer.write(iter([row]))
    assert L.read_log(spark, path, ENTRY).count() == 0
    writer.commit([second, writer.write(iter([])), None])
    assert [r.record_id for r in L.read_log(spark, path, ENTRY).collect()] == [1]
    writer.abort([first])
    assert L.committed(path) == [second.name]


def test_failed_job_leaves_the_log_as_it_was(spark, tmp_path):
    path = str(tmp_path / "log")
    L.append(spark.createDataFrame([(1, "t", "d", "r")], ENTRY), path)
    fails = F.udf(lambda k: 1 // (k - 7), "int")
    bad = spark.range(20).repartition(4).select("id", fails("id").alias("x"))
    with pytest.raises(Exception):
        L.append(bad, path)
    assert [r.record_id for r in L.read_log(spark, path, ENTRY).collect()] == [1]
    with pytest.raises(Exception, match="appended"):
        bad.write.format(L.NAME).mode("overwrite").save(path)


# the catalogue


def brute_fields(value, path="$"):
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(value), "number")
    yield path, kind
    if isinstance(value, dict):
        for k, v in value.items():
            yield from brute_fields(v, f"{path}.{k}")
    elif isinstance(value, list):
        for v in value:
            yield from brute_fields(v, path + "[]")


def test_catalogue_of_random_payloads(spark):
    from collections import Counter

    rng = random.Random(2)

    def made(depth):
        kind = rng.randrange(7 if depth else 5)
        return [None, True, 3, 1.5, "s"][kind] if kind < 5 else {rng.choice("abc"): made(depth - 1) for _ in range(2)} if kind == 5 else [made(depth - 1) for _ in range(rng.randrange(3))]

    payloads = [{"x": made(5), "y": made(3)} for _ in range(60)]
    rows = spark.createDataFrame([(json.dumps(p),) for p in payloads] + [("{cut",), (None,)], "payload string").repartition(3)
    got = {(r.path, r.kind): r.n for r in catalogue.field_catalogue(rows, "payload").collect()}
    assert got == Counter(f for p in payloads for f in brute_fields(p))
    assert catalogue.field_catalogue(rows.filter("false"), "payload").count() == 0


# composed texts


def test_composed_texts(spark):
    rng = random.Random(3)
    signs = "aeiou ÅñΩ" + "̧́̈ͅ각가ÅΩ豈がक़ẛ̣"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(12))) for _ in range(500)] + [None, "", "plain é"]
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "i int, said string, other string").repartition(3)
    out = N.composed(df, "said")
    assert out.columns == df.columns
    assert {r.i: r.said for r in out.collect()} == {i: t and unicodedata.normalize("NFC", t) for i, t in enumerate(texts)}


def test_safe_characters_are_what_composition_leaves(spark):
    """Every character of the ranges is its own composed form, alone and behind any other of them."""
    df = spark.createDataFrame([(c, chr(c)) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000], "c int, t string")
    safe = [r.c for r in df.filter(N.surely_composed(F.col("t"))).collect()]
    assert len(safe) > 40_000
    for c in safe:
        assert unicodedata.combining(chr(c)) == 0 and unicodedata.is_normalized("NFC", chr(c)), hex(c)
    whole = "".join(map(chr, safe))
    assert unicodedata.normalize("NFC", whole) == whole and unicodedata.normalize("NFC", whole[::-1]) == whole[::-1]
