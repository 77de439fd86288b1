"""States and kinds of addresses, trackers by two keys, exports under their head."""

import csv
import datetime
import glob
import re

import pytest
from pyspark.sql import functions as F

from statuta.functions import origins as O
from statuta.operators.trackers import edited, tracked, tracker_index
from statuta.sources.exports import BILL_FIELDS, DISCLAIMER, bill_rows, export_bills

#: title, address, state
STATES = [
    ("Colorado act", "https://www.ILGA.gov/x", "illinois"),
    ("An act", "https://legiscan.com/nh/bill", "new hampshire"),
    ("Arkansas rules", "", "arkansas"),
    ("West Virginia Code", "", "west virginia"),
    ("On data", "https://x.example/new-jersey/New Jersey", "new jersey"),
    ("SB 4, TX and KS", "", "texas"),
    ("SB 4, XX and KS", "", "kansas"),
    ("éTX law", "", None),
    ("tx law", "", None),
    ("C.R.S. 6-1", "", "colorado"),
    ("KRS 367", "", "kentucky"),
    ("KRSé 367", "", None),
    ("W. Va. Code 5", "", "virginia"),
    ("N.Y. rule", "", "new york"),
    ("Local Law 144 on hiring", "", "new york"),
    ("District of Columbia", "", None),
    (None, None, None),
    ("", "", None),
]


def test_states(spark):
    rows = spark.createDataFrame([(i, t, u) for i, (t, u, _) in enumerate(STATES)], "id int, title string, url string")
    found = rows.select("id", O.inferred_state(F.col("title"), F.col("url")).alias("s"), O.reference_url(O.inferred_state(F.col("title"), F.col("url"))).alias("r")).orderBy("id").collect()
    assert [r.s for r in found] == [s for _, _, s in STATES]
    assert found[4].r == "https://ai-law-center.orrick.com/new-jersey/" and found[-1].r is None


def test_states_of_all_codes_and_sites(spark):
    """Against a loop over the lists, as the rule is told."""
    titles = [f"Act {c} of" for c in O.FIFTY.values()] + [f"The {n.title()} act" for n in O.FIFTY] + [re.sub(r"\\b$", " 5", p).replace("\\", "") for p in O.STATUTES]
    rows = [(t, "") for t in titles] + [("", f"http://www.{s}/1") for s in O.SITES]

    def told(title, url):
        both = f"{title} {url}".lower()
        for part, state in O.SITES.items():
            if part.lower() in url.lower():
                return state
        for name in sorted(O.FIFTY, key=len, reverse=True):
            if name in both:
                return name
        for code in re.findall(r"\b([A-Z]{2})\b", title):
            if code in O.FIFTY.values():
                return next(n for n, c in O.FIFTY.items() if c == code)
        return next((s for p, s in O.STATUTES.items() if re.search(p, title)), "new york" if "nyc" in both or "local law 144" in both else None)

    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, title string, url string")
    found = [r.s for r in df.select("id", O.inferred_state(F.col("title"), F.col("url")).alias("s")).orderBy("id").collect()]
    assert found == [told(*r) for r in rows] and None not in found


@pytest.mark.parametrize("url, kind, kept", [
    ("https://leg.colorado.gov/x", "official", True), (" https://law-center.ORRICK.com/ai/x ", "stub", False), ("https://www.orrick.com/AI", "stub", False), ("(IAPP tracker PDF)", "stub", False),
    ("https://files.orrick.com/a.PDF", "kept", True), ("infobytes.orrick.com/a", "kept", True), (" https://x.example/a ", "other", True), ("page 4", "none", False), ("", "none", False), (None, "none", False),
    ("https://iapp tracker.gov", "stub", False),
])
def test_addresses(spark, url, kind, kept):
    row = spark.createDataFrame([(url,)], "url string").select(O.url_class(F.col("url")).alias("k"), O.primary_url(F.col("url")).alias("p")).first()
    assert (row.k, row.p) == (kind, url.strip() if kept else None)


def test_tracker_has_two_keys_and_the_last_row_wins(spark):
    rows = spark.createDataFrame([(1, "California ", "SB 205", "old"), (2, "california", "sb 205", "new"), (3, "Utah", "HB 1", "utah"), (4, "", "HB 1", "x"), (5, "Utah", None, "x"), (6, "CA", "HB 9", "by code")], "at int, jurisdiction string, bill string, scope string")
    codes = spark.createDataFrame([("California", "CA"), ("Ohio", "OH"), ("Utah", " "), (None, "x")], "name string, code string")
    index = tracker_index(rows, codes, "at")
    assert sorted((r.place, r.number, r.row.scope) for r in index.collect()) == [("ca", "hb 9", "by code"), ("ca", "sb 205", "new"), ("california", "sb 205", "new"), ("utah", "hb 1", "utah")]
    asked = [(1, "CALIFORNIA", None, " sb 205", None), (2, None, "ca", "", "SB 205"), (3, "California", "CA", "hb 9", "SB 205"), (4, "Utah", "UT", None, None), (5, None, None, "sb 205", None), (5, None, None, "sb 205", None)]
    found = tracked(spark.createDataFrame(asked, "id int, name string, code string, cite string, bill_id string"), index).collect()
    assert sorted((r.id, r.row.scope if r.row else None, r.how) for r in found if r.id < 5) == [(1, "new", "name"), (2, "new", "code"), (3, "by code", "code"), (4, None, None)]
    assert sum(r.id == 5 for r in found) == 2
    assert tracker_index(rows.limit(0), codes, "at").count() == 0 and tracked(spark.createDataFrame(asked, "id int, name string, code string, cite string, bill_id string"), index.limit(0)).filter("row IS NULL").count() == 6


def test_tracker_edits_are_repeatable(spark):
    rows = spark.createDataFrame([("CA", "SB 1", "a"), ("UT", "HB 1", "b"), (None, "X", "c")], "place string, bill string, scope string")
    changed = spark.createDataFrame([("CA", "SB 1", "a2"), ("OH", "HB 7", "new"), (None, "X", "c2")], rows.schema)
    gone = spark.createDataFrame([("UT", "HB 1")], "place string, bill string")
    once = edited(rows, changed, gone, ["place", "bill"])
    expected = {("CA", "SB 1", "a2"), ("OH", "HB 7", "new"), (None, "X", "c2")}
    assert set(map(tuple, once.collect())) == expected and set(map(tuple, edited(once, changed, gone, ["place", "bill"]).collect())) == expected


def test_bill_export_reads_as_one_csv(spark, tmp_path):
    at = datetime.datetime(2025, 3, 4, 5, 6, 7)
    taken = spark.createDataFrame([(i, 1 + i % 2, "scope", None if i % 3 else "m", i or None, None, i % 2 == 0, "pending", '{"a":"x, \\"y\\"\\nz"}' if i % 2 else None, at if i else None) for i in range(40)] + [(99, 77, "lost", None, 1, 1, False, "pending", None, at)],
        "id long, version_id long, agent_name string, model_id string, input_tokens long, output_tokens long, truncated boolean, review_status string, payload_json string, created_at timestamp")
    versions = spark.createDataFrame([(1, 5), (2, 6)], "version_id long, law_id long")
    laws = spark.createDataFrame([(5, 1, "A, \"act\"", "T"), (6, 2, None, "U")], "law_id long, jurisdiction_id long, law string, title string")
    rows = bill_rows(taken, versions, laws, spark.createDataFrame([(1, "utah"), (2, "ohio")], "jurisdiction_id long, jurisdiction string"))
    export_bills(rows.repartition(4), str(tmp_path / "e"), at, "full")
    lines = "".join(open(p, newline="").read() for part in ("head", "rows") for p in sorted(glob.glob(f"{tmp_path}/e/{part}/part-*")))
    assert lines.startswith("# RUN: 2025-03-04 05:06:07 UTC | type=full\n" + DISCLAIMER + "\n" + ",".join(BILL_FIELDS) + "\n")
    read = list(csv.DictReader(lines.split("\n", 2)[2].splitlines()))
    assert [(r["jurisdiction"], int(r["id"])) for r in read] == [("ohio", i) for i in range(1, 40, 2)] + [("utah", i) for i in range(0, 40, 2)]
    assert read[0]["payload_json"] == '{"a":"x, \\"y\\"\\nz"}' and read[0]["law"] == "" and read[20]["law"] == 'A, "act"' and read[20]["created_at"] == "" and read[20]["input_tokens"] == "0" and read[1]["created_at"] == "2025-03-04T05:06:07"
    export_bills(rows.limit(0), str(tmp_path / "none"), at, "full")
    assert not (tmp_path / "none").exists()
