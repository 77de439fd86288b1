"""Answers of models: broken JSON mended, cut-off JSON closed, loops cut (inventory 2.9.12, 2.12.1-2.12.3).

JSON has no repair among the built-in functions, so these run as Arrow functions, one pass over each answer. An answer is
read as a row of marks (strings and brackets), and every question - which brackets are open, where the first value
ends, where the last whole element ends - is put to that row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_MARKS = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)|[{}\[\]]', re.DOTALL)
_JUNK = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
_INSIDE = re.compile(r'\\(?:u.{0,4}|["\\/bfnrt])|\\|[\n\r\t\b\f]', re.DOTALL)
_COMMA = re.compile(r",\s*([}\]])")
_NEXT = re.compile(r"\s*,")
# Control characters inside strings, and what they are written as.
_CONTROLS = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
_CLOSE = {"{": "}", "[": "]"}
LOOP_LEAST, LOOP_MOST, LOOP_TIMES = 40, 200, 3


#: Brackets open at once beyond which a text counts as no JSON; deeper ones would run into Python's own limit.
DEPTH_MOST = 300


def _deep(text: str) -> bool:
    return text.count("{") + text.count("[") > DEPTH_MOST and any(len(open_) > DEPTH_MOST for _, _, open_ in _brackets(text))


def _valid(text: str):
    """(the value,) or None."""
    try:
        return None if _deep(text) else (json.loads(text),)
    except ValueError:
        return None


def _first_value(text: str) -> str | None:
    """The JSON value that a text begins with, or None; one pass, however many brackets there are."""
    try:
        return None if _deep(text) else text[: json.JSONDecoder().raw_decode(text)[1]]
    except ValueError:
        return None


def _brackets(text: str) -> Iterator[tuple[int, str, list[str]]]:
    """(place, bracket, brackets still open behind it) of each bracket outside strings."""
    open_: list[str] = []
    for m in _MARKS.finditer(text):
        mark = m.group()
        if mark in _CLOSE:
            open_.append(mark)
        elif mark in "}]" and open_:
            open_.pop()
        if mark[0] != '"':
            yield m.start(), mark, open_


def _open_string(text: str) -> bool:
    last = None
    for last in _MARKS.finditer(text):
        pass
    return last is not None and last.group()[0] == '"' and last.end() == len(text) and not re.fullmatch(r'"(?:[^"\\]|\\.)*"', last.group(), re.DOTALL)


def closed(text: str) -> str:
    """A cut-off JSON text, ended behind the last whole element of a top-level list, or else closed where it stops."""
    text = text.rstrip()
    if text[:1] not in ("{", "["):
        return text
    whole, open_ = None, []
    for at, mark, open_ in _brackets(text):
        if mark == "}" and len(open_) == 1 and _NEXT.match(text, at + 1):
            whole = text[: at + 1] + _CLOSE[open_[0]]
    if whole:
        return whole
    return text + ('"' if _open_string(text) else "") + "".join(_CLOSE[b] for b in reversed(open_))


def elements_started(text: str) -> int:
    """Objects that open straight inside a list."""
    return sum(mark == "{" and open_[-2:-1] == ["["] for _, mark, open_ in _brackets(text))


def _strings_mended(text: str) -> str:
    """Escapes that JSON lacks get their backslash doubled, raw control characters inside strings are escaped."""
    inner = lambda m: _CONTROLS.get(m.group()) or ("\\\\" if m.group() == "\\" else m.group())
    return _MARKS.sub(lambda m: m.group()[0] + _INSIDE.sub(inner, m.group()[1:]) if m.group()[0] == '"' else m.group(), text)


def _plain_keys(value):
    if isinstance(value, dict):
        return {k.strip(): _plain_keys(v) for k, v in value.items()}
    return [_plain_keys(v) for v in value] if isinstance(value, list) else value


def repaired(text: str | None, items: str = "extractions") -> tuple[str, list[str], int | None]:
    """(text, names of the repairs that changed it, elements that a cut-off answer had started)."""
    text, done, started = (text or "").strip(), [], None

    def take(new: str, name: str) -> None:
        nonlocal text
        if new != text:
            text = new
            done.append(name)

    if not text:
        return text, done, started
    take(_JUNK.sub("", text), "control_char_strip")
    if not _valid(text):
        take(_strings_mended(text), "string_escape_repair")
    if not _valid(text):
        if text[:1] in _CLOSE:
            take(_first_value(text) or text, "first_object_extraction")
        take(_COMMA.sub(r"\1", text), "trailing_comma_strip")
    if not _valid(text) and _valid(cut := closed(text)):
        started = elements_started(text)
        take(cut, "truncation_salvage")
    value = _valid(text)
    if not value:
        return text, done, started
    value = value[0]
    if isinstance(value, dict) and isinstance(value.get(items), list):
        inner = [(_valid(x) or (x,))[0] if isinstance(x, str) else x for x in value[items]]
        if inner != value[items]:
            take(json.dumps(value | {items: inner}), "unescaped_strings")
            return text, done, started
    if (plain := _plain_keys(value)) != value:
        take(json.dumps(plain), "stripped_keys")
    return text, done, started


def unlooped(text: str | None, least: int = LOOP_LEAST) -> tuple[str | None, bool]:
    """(text up to the third occurrence of a block that repeats, whether there is one). Blocks are taken from the middle on,
    where loops are sure to run, the longest first."""
    if text is None or len(text) < least * LOOP_TIMES:
        return text, False
    middle = len(text) // 2
    for size in range(min(LOOP_MOST, len(text) // 4), least - 1, -1):
        block = text[middle : middle + size]
        if block.strip() and text.count(block) >= LOOP_TIMES:
            at = -size
            for _ in range(LOOP_TIMES):
                at = text.index(block, at + size)
            return text[:at].rstrip(), True
    return text, False


def mended(answers: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, answer, repairs, n_started, looped of each answer: loops are cut first, then its JSON is repaired."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                cut, looped = unlooped(t)
                rows.append((*repaired(cut), looped))
            kinds = (pa.string(), pa.list_(pa.string()), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 4, kinds))], names=[id_col, "answer", "repairs", "n_started", "looped"])

    kind = answers.schema[id_col].dataType.simpleString()
    return answers.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, answer string, repairs array<string>, n_started int, looped boolean")
