"""Many terms found in many texts by one pass (inventory 2.9.20, 2.9.22, 2.9.23, 2.9.52, 2.9.54).

All terms of all vocabularies make one automaton (Aho-Corasick), which reads each text once however many terms there are; per term
and text nothing is done. Terms are rows (kind, place, term, rule), from plain values or from CSV files. Rules: `in`: anywhere;
`word`: between word borders; `words`: likewise, with an s behind it or without.

The terms are few against the texts: LIMIT of them at most are sent to the tasks at once. A larger vocabulary is dealt into
parts of that size, and the texts go through one automaton after the other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

LIMIT = 100_000
RULES = ("in", "word", "words")
TERMS = "kind string, place int, term string, rule string"
_HITS = "array<struct<kind:string,place:int,term:string>>"


def terms_of(spark: SparkSession, kind: str, terms: Sequence[str], rule: str = "in") -> DataFrame:
    """Terms of one kind in the order given."""
    return spark.createDataFrame([(kind, n, t, rule) for n, t in enumerate(terms)], TERMS)


def terms_read(spark: SparkSession, path: str, kind: str, column: str, rule: str = "in") -> DataFrame:
    """Terms of a CSV file with a header, in lower case, in the order of its lines; blank ones are left out."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    place = F.row_number().over(Window.orderBy("_line")) - 1  # a vocabulary file, not a corpus
    own = rows.select(F.lower(F.trim(column)).alias("term")).withColumn("_line", F.monotonically_increasing_id()).filter("term <> ''")
    return own.select(F.lit(kind).alias("kind"), place.cast("int").alias("place"), "term", F.lit(rule).alias("rule"))


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _border(text: str, at: int) -> bool:
    """Whether exactly one of the characters around a place belongs to a word."""
    return (at > 0 and _is_word(text[at - 1])) != (at < len(text) and _is_word(text[at]))


def holds(text: str, start: int, end: int, rule: str) -> bool:
    """Whether a term found at start:end counts under its rule."""
    if rule == "in":
        return True
    if not _border(text, start):
        return False
    return _border(text, end) or (rule == "words" and text[end : end + 1] == "s" and _border(text, end + 1))


def automaton(rows: Sequence[tuple[str, int, str, str]]) -> ahocorasick.Automaton:
    made: dict[str, list] = {}
    for kind, place, term, rule in rows:
        if rule not in RULES:
            raise ValueError(f"no rule {rule}")
        made.setdefault(term, []).append((kind, place, rule))
    found = ahocorasick.Automaton()
    for term, uses in made.items():
        found.add_word(term, (term, uses))
    if made:
        found.make_automaton()
    return found


def hits_in(text: str | None, machine: ahocorasick.Automaton) -> list[tuple[str, int, str]]:
    """(kind, place, term) of each term that a text holds, each once, sorted."""
    if not text or not len(machine):
        return []
    met = set()
    for end, (term, uses) in machine.iter(text):
        for kind, place, rule in uses:
            if (kind, place, term) not in met and holds(text, end + 1 - len(term), end + 1, rule):
                met.add((kind, place, term))
    return sorted(met)


def with_hits(rows: DataFrame, text: str, terms: DataFrame, name: str = "hits") -> DataFrame:
    """`rows` without the column `text`, with the terms that it holds: an array of (kind, place, term), sorted. Texts are compared as
    they are, so both sides are lower-cased by the caller. Other columns pass through, no row is moved."""
    total = terms.count()
    parts = max(1, -(-total // LIMIT))
    kept = [c for c in rows.columns if c != text]
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = rows.withColumn(name, F.array().cast(_HITS))
    for part in range(parts):
        own = terms if parts == 1 else terms.filter(F.pmod(F.xxhash64("term"), F.lit(parts)) == part)
        # a part holds LIMIT terms or about as many: the terms are hashed
        known = rows.sparkSession.sparkContext.broadcast([tuple(r) for r in own.select("kind", "place", "term", "rule").collect()])
        last = part == parts - 1
        names = [*kept, *([] if last else [text]), name]

        def run(batches: Iterator[pa.RecordBatch], known=known, names=names) -> Iterator[pa.RecordBatch]:
            machine = automaton(known.value)
            for b in batches:
                found = [sorted({(h["kind"], h["place"], h["term"]) for h in before} | set(hits_in(t, machine))) for t, before in zip(b.column(text).to_pylist(), b.column(name).to_pylist())]
                hits = pa.array([[dict(zip(("kind", "place", "term"), h)) for h in row] for row in found], pa.list_(pa.struct([("kind", pa.string()), ("place", pa.int32()), ("term", pa.string())])))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:-1]), hits], names=names)

        schema = ", ".join(f"`{c}` {types[c]}" for c in names[:-1])
        out = out.select(*[F.col(f"`{c}`") for c in (*kept, text)], name).mapInArrow(run, f"{schema}, {name} {_HITS}")
    return out


def of_kind(kind: str, hits: Column | str = "hits") -> Column:
    """The terms of one kind, in the order of their vocabulary."""
    own = F.filter(F.col(hits) if isinstance(hits, str) else hits, lambda h: h["kind"] == kind)
    return F.transform(F.array_sort(own, lambda a, b: a["place"] - b["place"]), lambda h: h["term"])


def first_code(kind: str, codes: Sequence[tuple[str, str]], longest: bool = False, hits: str = "hits") -> Column:
    """The code of the first term found, in the order of the vocabulary; or of the longest, the first of equal ones. Null: none."""
    order = sorted(range(len(codes)), key=lambda n: (-len(codes[n][0]) if longest else 0, n))
    rank = F.create_map(*[F.lit(x) for r, n in enumerate(order) for x in (n, r)]) if codes else None
    places = F.transform(F.filter(F.col(hits), lambda h: h["kind"] == kind), lambda h: rank[h["place"]])
    return F.get(F.array(*[F.lit(codes[n][1]) for n in order]), F.array_min(places))
