"""Statute texts as sections, and what of a restated section a bill is about (inventory 2.9.4, 2.9.8, 2.9.14, 2.9.15,
2.9.31-2.9.33).

Markers that continue a sequence, parts that swallow their neighbours, and offsets into the raw text are told by walking a
text once, so these run as Arrow functions, each text within its row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .packing import passages
from .steps import in_parts

# What opens a section, and the sizes that matter.
MARKER = re.compile(r"(?:Section|SECTION|Sec\.|SEC\.)\s+\d+[\w.\-]*|§\s*\d+[\w.\-]*|(?:Article|ARTICLE)\s+\w+|(?:Chapter|CHAPTER|Part|PART|Title|TITLE|Rule|RULE)\s+\d+[\w.\-]*")
OPENING = re.compile(r"\n\n?(?=Section|SECTION|Sec\.|SEC\.|§\s*\d|Article|ARTICLE|Chapter|CHAPTER|Part|PART|Title|TITLE|Rule|RULE)")
INLINE = re.compile(r"(?<=[.;)\]])\s+(?=(?:Section|SECTION|Sec\.|SEC\.)\s+\d|§\s*\d|(?:Article|ARTICLE)\s+[IVXLCDM\d]|(?:Chapter|CHAPTER|Part|PART|Title|TITLE|Rule|RULE)\s+\d)")
CHARS_A_LINE, LEAST, TARGET = 2000, 10, 3000
DOMAIN_TERMS = ("synthetic", "digitization", "digitized", "computer-generated", "computer generated", "intimate image", "materially deceptive")
LOOSE_LEAST = 15


def sections(text: str | None) -> list[tuple[str, str, int, int, list[str]]]:
    """(first marker, text, start, end, all markers) of chunks of about TARGET characters; none where no marker opens one.

    Offsets are those of the text as it is cut: one with hardly any line breaks gets some before its markers first."""
    text = text or ""
    if text.count("\n") < len(text) / CHARS_A_LINE:
        text = INLINE.sub("\n\n", text)
    cuts = [0, *(m.start() for m in OPENING.finditer(text) if m.start()), len(text)]
    found = []
    for start, end in zip(cuts, cuts[1:]):
        opened = MARKER.match(text, start + len(text[start:end]) - len(text[start:end].lstrip("\n")))
        if opened and len(body := text[opened.start() : end].strip()) >= LEAST:
            found.append([opened.group().strip(), body, start, end])
    whole: list[list] = []
    for k, (marker, body, start, end) in enumerate(found):
        # A marker alone is the head of what follows: a reference that was taken for the next section.
        if whole and whole[-1][4]:
            whole[-1][1:5] = [f"{whole[-1][1]}\n\n{body}", whole[-1][2], end, body == marker and k + 1 < len(found)]
        else:
            whole.append([marker, body, start, end, body == marker and k + 1 < len(found)])
    chunks: list[list] = []
    for marker, body, start, end, _ in whole:
        if chunks and chunks[-1][5] + len(body) <= TARGET:
            last = chunks[-1]
            chunks[-1] = [last[0], f"{last[1]}\n\n{body}", last[2], end, [*last[4], marker], last[5] + len(body)]
        else:
            chunks.append([marker, body, start, end, [marker], len(body)])
    return [tuple(c[:5]) for c in chunks]


def sectioned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each chunk: id, place, section, text, start, end, markers. Texts that no marker opens are packed by
    paragraphs, without offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()))
        for b in in_parts(batches):
            at, rows = [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                found = [(n, *chunk) for n, chunk in enumerate(sections(t))] or [(-1, None, t, None, None, [])]
                at += [k] * len(found)
                rows += found
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [()] * 6, kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *columns], names=[id_col, "place", "section", "text", "start", "end", "markers"])

    kind = docs.schema[id_col].dataType.simpleString()
    cut = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, place int, section string, text string, start long, end long, markers array<string>")
    packed = passages(cut.filter("place < 0").select(id_col, "text"), id_col=id_col)
    none = F.lit(None).cast("long")
    rest = packed.select(id_col, (F.col("ordinal") - 1).cast("int").alias("place"), F.col("label").alias("section"), F.col("passage").alias("text"), none.alias("start"), none.alias("end"), F.array().cast("array<string>").alias("markers"))
    return cut.filter("place >= 0").unionByName(rest)


def _in_sequence(text: str, shape: str, labels: list[str]) -> list[tuple[str, int, int]]:
    """(label, start, end) of marks in brackets that go on where the last one stopped; all others are references."""
    found, wanted = [], iter(labels)
    label = next(wanted)
    for m in re.finditer(rf"\(({shape})\)", text):
        if m.group(1) == label:
            found.append((label, m.start()))
            label = next(wanted, None)
    return [(x, start, end) for (x, start), end in zip(found, [s for _, s in found[1:]] + [len(text)])]


def subdivisions(text: str) -> list[tuple[str, int, int]]:
    return _in_sequence(text, "[a-z]", [chr(c) for c in range(ord("a"), ord("z") + 1)])


def parts_of(text: str) -> list[tuple[str, int, int]]:
    """Second-level marks: numbers up to 50, or else capitals."""
    return _in_sequence(text, r"\d+", [str(n) for n in range(1, 51)]) or _in_sequence(text, "[A-Z]", [chr(c) for c in range(ord("A"), ord("Z") + 1)])


def regions(text: str, added: list[str], keywords=DOMAIN_TERMS) -> list[tuple[str | None, int, int, bool, str]]:
    """(label, start, end, in scope, why) of regions that part the whole text.

    A region is in scope by its own keyword, or by a reference to a section that the bill adds anywhere in its
    subdivision; the lead of a subdivision also by a keyword in one of its parts. What precedes the first subdivision is shared."""
    words = sorted(keywords)
    keyword = lambda s: next((w for w in words if w in s.lower()), None)
    tops = subdivisions(text)
    if not tops:
        return [(None, 0, len(text), True, "no_subdivision_structure")]
    out = [(None, 0, tops[0][1], True, "shared_preamble")] if tops[0][1] else []
    for label, start, end in tops:
        body = text[start:end]
        cited = next((s for s in sorted(added) if re.search(rf"\bSection\s+{re.escape(s)}\b", body)), None)
        inner = parts_of(body)

        def verdict(own: str) -> tuple[bool, str]:
            if word := keyword(own):
                return True, f"keyword:{word}"
            return (True, f"references_added_section:{cited}") if cited else (False, "no_ai_domain_signal")  # noqa: B023

        lead = verdict(body[: inner[0][1]] if inner else body)
        if inner and not lead[0] and any(keyword(body[s:e]) for _, s, e in inner):
            lead = (True, "adjacent_to_in_scope_sibling")
        out.append((f"({label})", start, start + inner[0][1] if inner else end, *lead))
        out += [(f"({label})({x})", start + s, start + e, *verdict(body[s:e])) for x, s, e in inner]
    return out


def excerpt(text: str, found: list[tuple], label: str | None = None) -> str | None:
    """What is in scope, word for word, with marks where something is left out; None if that is all or nothing."""
    kept = [r for r in found if r[3]]
    if len(kept) in (0, len(found)):
        return None
    out, last = [f"[Excerpt of {label or 'a restated section'}: parts outside the bill's subject are left out; they restate the law as it is.]"], 0
    for _, start, end, *_ in kept:
        out += ["[...]"] * (start > last) + [text[start:end]]
        last = end
    return "\n".join(out + ["[...]"] * (last < len(text)))


def scoped(docs: DataFrame, id_col: str, text_col: str, added_col: str, keywords=DOMAIN_TERMS) -> DataFrame:
    """id, regions and excerpt of each restated section; `added_col` holds the numbers of sections that its bill adds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("in_scope", pa.bool_()), ("why", pa.string())])
        for b in in_parts(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            found = [regions(t, a or [], keywords) for t, a in zip(texts, b.column(2).to_pylist())]
            rows = [[dict(zip(("label", "start", "end", "in_scope", "why"), r)) for r in f] for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(region)), pa.array([excerpt(t, f) for t, f in zip(texts, found)], pa.string())], names=[id_col, "regions", "excerpt"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col, added_col).mapInArrow(run, f"`{id_col}` {kind}, regions array<struct<label: string, start: bigint, end: bigint, in_scope: boolean, why: string>>, excerpt string")


def loose_with_offsets(text: str) -> tuple[str, list[int]]:
    """Lower-case letters and digits with single spaces between runs, and where each character stands in the text."""
    out, places = [], []
    for m in re.finditer(r"[^\W_]+", text):
        if out:
            out.append(" ")
            places.append(m.start())
        for k, c in enumerate(m.group()):
            low = c.lower()
            out.append(low)
            places += [m.start() + k] * len(low)
    return "".join(out), places


def evidence_offset(evidence: str | None, text: str | None) -> int | None:
    """Where a quote of LOOSE_LEAST loose characters or more stands in the raw text, whatever case and signs."""
    asked, (held, places) = loose_with_offsets(evidence or "")[0], loose_with_offsets(text or "")
    at = held.find(asked) if len(asked) >= LOOSE_LEAST else -1
    return places[at] if at >= 0 else None


def located(docs: DataFrame, id_col: str, evidence_col: str, text_col: str) -> DataFrame:
    """id, offset of each row's evidence in its text; null where it is not found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches):
            found = [evidence_offset(e.as_py(), t.as_py()) for e, t in zip(b.column(1), b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64())], names=[id_col, "offset"])

    return docs.select(id_col, evidence_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, offset long")
