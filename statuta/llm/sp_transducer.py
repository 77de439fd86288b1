"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three transducers are compiled from a model, as tables of arcs (state, label, next state, output, weight):

- the normaliser: a dummy space ahead (from its first state to its second), spaces to the piece alphabet's space mark,
  every other character to itself;
- the lexicon: a tree of states over characters, whose last state of each piece writes it and returns to the root;
- byte fallback: an acceptor of UTF-8 that writes a piece for every byte, for characters that are no piece themselves.

The tables are made once, on the driver, and sent along. They are composed with a text's chain of characters as far as its
positions are reached, and the shortest path in the tropical semiring (weights add up along a path, the least sum wins)
is found by relaxing positions in the order of their weight. A path's state at a position is its last piece; weights are of two kinds:

- `unigram`: a piece weighs its negative score, whatever came before; a character in bytes weighs more than any piece;
- `merge` (BPE): ranks say which of two merges comes first and are no costs that add up. The arc from piece `a` to piece
  `b` weighs 0 if the merges leave `a b` as these two pieces, and infinity else. A sequence is what the merges make of a
  string exactly if all its neighbours are stable in this sense (the first merge to cross a border would do so in the two
  neighbours alone), so a prefix has one path of finite weight and the shortest path is the encoding.

In both a position keeps one path, the best. Stable pairs and encoded units are remembered; a unit is a run of space
marks with the characters up to the next run, cut also wherever two neighbouring characters occur together in no piece. No
piece crosses a unit's border, so units are encoded one by one and texts of any length take no more memory than their ids.

Defined results: a null or empty text has no ids and decodes to an empty text; of equal weights the path found first wins, always
the same one; repeated rows are encoded alike; null ids are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from heapq import heappop, heappush
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MARK = "▁"
#: Words, parts of words and pairs of pieces that one Python worker remembers, of each.
MEMORY = 300_000
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
INF = float("inf")
#: Labels and outputs besides code points and ids: nothing read, any character not named, the character itself.
NOTHING, ANY, SAME = -1, -2, -3
#: What a character in bytes weighs beyond the dearest piece.
FALLBACK = 10.0
_SHIFT = 21  # a code point has fewer bits


@dataclass
class Arcs:
    """Arc k leads from state source[k] to target[k], reads label[k], writes out[k] and weighs weight[k]."""

    source: np.ndarray
    label: np.ndarray
    target: np.ndarray
    out: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, int, int, int, float]]) -> Arcs:
        columns = list(zip(*rows)) or [()] * 5
        return cls(*(np.array(c, np.int32) for c in columns[:4]), np.array(columns[4], np.float64))


@dataclass
class Tables:
    """A compiled model: the three transducers, and of the lexicon the piece and weight of each state that ends one."""

    kind: str
    pieces: list[str]
    special: frozenset[int]
    byte_ids: list[int]
    normaliser: Arcs
    lexicon: Arcs
    fallback: Arcs
    ends: np.ndarray
    end_weights: np.ndarray
    scores: np.ndarray


def compiled(pieces: list[str], scores: list[float], special: set[int], kind: str = "merge") -> Tables:
    """`special` ids (controls, bytes and the like) are no part of the lexicon. Byte pieces are named <0x00> to <0xFF>."""
    normaliser = Arcs.of([(0, NOTHING, 1, ord(MARK), 0.0), (1, ord(" "), 1, ord(MARK), 0.0), (1, ANY, 1, SAME, 0.0)])
    states, arcs, ends = {"": 0}, [], {}
    for i, p in enumerate(pieces):
        if i not in special:
            for k in range(1, len(p) + 1):
                if p[:k] not in states:
                    states[p[:k]] = len(states)
                    arcs.append((states[p[: k - 1]], ord(p[k - 1]), states[p[:k]], NOTHING, 0.0))
            ends[states[p]] = i
    ids, weights = np.full(len(states), NOTHING, np.int32), np.zeros(len(states))
    for state, i in ends.items():
        ids[state], weights[state] = i, -scores[i] if kind == "unigram" else 0.0
    byte_ids = [pieces.index(f"<0x{b:02X}>") for b in range(256)]
    dear = max((-scores[i] for i in ends.values()), default=0.0) + FALLBACK if kind == "unigram" else 0.0
    # State k of the fallback waits for k more bytes of a character; the first byte carries its weight.
    first = [(0, b, 0 if b < 0xC0 else 1 if b < 0xE0 else 2 if b < 0xF0 else 3, byte_ids[b], dear) for b in range(256) if not 0x80 <= b < 0xC0]
    follow = [(k, b, k - 1, byte_ids[b], 0.0) for k in (1, 2, 3) for b in range(0x80, 0xC0)]
    return Tables(kind, list(pieces), frozenset(special), byte_ids, normaliser, Arcs.of(arcs), Arcs.of(first + follow), ids, weights, np.array(scores, np.float64))


def load(model_path: str = DEFAULT_MODEL, kind: str = "merge") -> Tables:
    """A model file's tables; the file, under 1 MB, is read on the driver."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=Path(model_path).read_bytes())
    size = sp.get_piece_size()
    special = {i for i in range(size) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)}
    return compiled([sp.id_to_piece(i) for i in range(size)], [sp.get_score(i) for i in range(size)], special, kind)


class _Words(dict):
    """Ids of single words as far as they are remembered; each has a space mark or a line break ahead."""

    def __init__(self, machine: Transducer):
        self.machine = machine

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = self[word] = self.machine.unit_ids(word if word[:1] == "\n" else MARK + word)
        return found


class Transducer:
    """The composed machine of one Python process."""

    def __init__(self, tables: Tables):
        self.t = t = tables
        both = lambda a: (a.source.astype(np.int64) << _SHIFT | a.label).tolist()
        # The lexicon's states are kept shifted, ready to take in the next character, each with the piece that it ends.
        target = t.lexicon.target
        self.step = dict(zip(both(t.lexicon), zip((target.astype(np.int64) << _SHIFT).tolist(), t.ends[target].tolist())))
        self.bytes = dict(zip(both(t.fallback), zip(t.fallback.target.tolist(), t.fallback.out.tolist(), t.fallback.weight.tolist())))
        self.end_weights = dict(zip(t.ends.tolist(), t.end_weights.tolist()))
        # The normaliser has one path through any text: what it writes at the start, and what for each character it names.
        n = t.normaliser
        rows = list(zip(n.source.tolist(), n.label.tolist(), n.target.tolist(), n.out.tolist()))
        self.prefix, start = next(((chr(out), to) for at, label, to, out in rows if at == 0 and label == NOTHING), ("", 0))
        self.spelling = {label: chr(out) for at, label, _, out in rows if at == start and label >= 0}
        words = [p for i, p in enumerate(t.pieces) if i not in t.special]
        self.score = {p: t.scores[i] for i, p in enumerate(t.pieces) if i not in t.special}
        self.letters = {c for p in words for c in p}
        self.together = {p[i : i + 2] for p in words for i in range(len(p) - 1)}
        #: What each id decodes to; byte pieces are put together apart.
        self.text = ["" if i in t.special else p.replace(MARK, " ") for i, p in enumerate(t.pieces)]
        self.byte_of = {i: b for b, i in enumerate(t.byte_ids)}
        self.stable_pairs: dict[tuple[int, int], bool] = {}
        self.parts: dict[str, tuple[int, ...]] = {}
        self.words = _Words(self)

    def merged(self, text: str) -> list[str]:
        """What the merges make of a short string: the best-ranked neighbours first, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = -INF, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and s > best:
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stable(self, last: int, piece: int) -> bool:
        """Whether the merges leave these two pieces as they are (`last` NOTHING: the piece alone). Bytes never merge."""
        known = self.stable_pairs.get((last, piece))
        if known is None:
            if len(self.stable_pairs) > MEMORY:
                self.stable_pairs.clear()
            pieces = self.t.pieces
            two = [pieces[i] for i in (last, piece) if i != NOTHING and i not in self.byte_of]
            known = self.stable_pairs[last, piece] = piece in self.byte_of or self.merged("".join(two)) == two
        return known

    def in_bytes(self, char: str) -> tuple[tuple[int, ...], float]:
        """Output and weight of the fallback's path through a character's bytes."""
        state, out, weight = 0, [], 0.0
        for b in char.encode("utf-8", "surrogatepass"):
            state, piece, w = self.bytes[state << _SHIFT | b]
            out.append(piece)
            weight += w
        return tuple(out), weight

    def shortest_path(self, part: str) -> tuple[int, ...]:
        """Output of the least path through `part`: positions are taken in the order of their weight, the furthest of equals
        first, and relax what lies ahead of them. Arcs out of a position are the pieces that begin there, found by walking
        the lexicon's states, or the bytes of a character that is none."""
        n, merge, known = len(part), self.t.kind == "merge", self.stable_pairs
        step, weights, codes = self.step.get, self.end_weights, list(map(ord, part))
        cost, came, wrote = [INF] * (n + 1), [0] * (n + 1), [NOTHING] * (n + 1)
        cost[0], spelled, heap = 0.0, {}, [(0.0, 0)]
        while True:
            here, at = heappop(heap)
            if at == -n:
                break
            at = -at
            if here > cost[at]:
                continue
            last, state, single = wrote[at], 0, False
            for k in range(at, n):
                arc = step(state | codes[k])
                if arc is None:
                    break
                state, piece = arc
                if piece != NOTHING:
                    single |= k == at
                    if (w := here + weights[piece]) < cost[k + 1]:
                        if merge:
                            fits = known.get((last, piece))
                            if not (fits if fits is not None else self.stable(last, piece)):
                                continue
                        cost[k + 1], came[k + 1], wrote[k + 1] = w, at, piece
                        heappush(heap, (w, -k - 1))
            if not single:
                out, weight = self.in_bytes(part[at])
                if here + weight < cost[at + 1]:
                    cost[at + 1], came[at + 1], wrote[at + 1], spelled[at + 1] = here + weight, at, out[-1], out
                    heappush(heap, (here + weight, -at - 1))
        path, at = [], n
        while at:
            path.append(spelled[at] if at in spelled and wrote[at] == spelled[at][-1] else (wrote[at],))
            at = came[at]
        return tuple(chain.from_iterable(reversed(path)))

    def part_ids(self, part: str) -> tuple[int, ...]:
        found = self.parts.get(part)
        if found is None:
            if len(self.parts) >= MEMORY:
                self.parts.clear()
            found = self.parts[part] = self.shortest_path(part)
        return found

    def unit_ids(self, unit: str) -> tuple[int, ...]:
        """Of a unit with any characters, cut where no piece can cross."""
        together, found, at = self.together, [], 0
        for i in range(1, len(unit)):
            if unit[i - 1 : i + 1] not in together:
                found.append(self.part_ids(unit[at:i]))
                at = i
        found.append(self.part_ids(unit[at:]))
        return found[0] if len(found) == 1 else tuple(chain.from_iterable(found))

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        if MARK in text or "  " in text or "\n" in self.letters:
            units = re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", self.prefix + text.translate(self.spelling))
            return np.fromiter(chain.from_iterable(map(self.unit_ids, units)), np.int32)
        if len(self.words) > MEMORY:
            self.words.clear()
        words, head = text.replace("\n", " \n").split(" "), ()
        if text[0] == " ":
            words, head = words[2:], self.unit_ids(MARK + MARK + words[1])
        return np.fromiter(chain(head, chain.from_iterable(map(self.words.__getitem__, words))), np.int32)

    def decode(self, ids) -> str:
        """Pieces put together, runs of byte pieces as UTF-8, without the dummy space ahead."""
        out, run = [], bytearray()
        ids = ids.tolist() if isinstance(ids, np.ndarray) else list(ids)
        if self.byte_of.keys().isdisjoint(ids):
            return "".join(map(self.text.__getitem__, ids))[1:]
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                run.append(b)
            else:
                if run:
                    out.append(run.decode("utf-8", "replace"))
                    run = bytearray()
                out.append(self.text[i])
        out.append(run.decode("utf-8", "replace"))
        return "".join(out)[1:]


_machines: dict[str, Transducer] = {}


def machine(name: str, tables: Tables) -> Transducer:
    """The composed machine of this Python process; its memory serves all tasks that the process runs."""
    if name not in _machines:
        _machines.clear()
        _machines[name] = Transducer(tables)
    return _machines[name]


@contextmanager
def uncollected():
    """Without passes over all remembered words, which hold no cycles and would cost a third of the time; only as long as
    this operator's own code runs, since Spark uses the process for other work too."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = DEFAULT_MODEL, kind: str = "merge") -> DataFrame:
    """doc_id, ids, n_tokens, decoded for every document. The compiled tables (a few MB, whatever the data) are broadcast."""
    tables, name = docs.sparkSession.sparkContext.broadcast(load(model_path, kind)), f"{kind}:{model_path}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(name, tables.value)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                with uncollected():
                    ids = [m.encode(t.as_py()) for t in part.column(1)]
                sizes = np.fromiter(map(len, ids), np.int32, len(ids))
                flat = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(sizes.astype(np.int64)), pa.array(map(m.decode, ids), pa.string())], names=["doc_id", "ids", "n_tokens", "decoded"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>, n_tokens long, decoded string")
