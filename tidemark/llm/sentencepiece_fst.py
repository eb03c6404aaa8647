"""SentencePiece unigram encoding and decoding as a weighted finite-state transducer.

Machines compiled from the model file: the normaliser (writes the dummy prefix, turns spaces into the space mark),
and the pieces joined with byte fallback (a trie whose ends write a piece at the cost of its negated score and go back
to the start; a character that is no piece is written as its UTF-8 bytes, ten costlier than the costliest piece).
Composing the two and removing empty arcs gives one machine from raw characters to ids. It is composed with each
input, state by state, and the path of least total cost in the tropical semiring (min, +) is read off.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import BYTE, MATCHED, SPACE, Vocabulary, load

#: Labels of arcs: no character; any character that the state has no arc of its own for.
NONE, OTHER = "", "other"
#: Outputs that depend on the character read: itself, or its UTF-8 bytes.
COPY, BYTES = "copy", "bytes"
Arc = tuple[object, float, int]  # output, cost, next state


@dataclass
class Machine:
    """A transducer that starts in state 0: arcs of each state by label, and the cost of ending there."""

    arcs: list[dict[str, list[Arc]]] = field(default_factory=lambda: [{}])
    final: dict[int, float] = field(default_factory=dict)

    def state(self) -> int:
        self.arcs.append({})
        return len(self.arcs) - 1

    def add(self, state: int, label: str, output: object, cost: float, to: int) -> None:
        self.arcs[state].setdefault(label, []).append((output, cost, to))


def normaliser(vocabulary: Vocabulary) -> Machine:
    """Raw characters to normalised ones."""
    out = Machine()
    rest = out.state()
    if vocabulary.dummy_prefix:
        out.add(0, NONE, SPACE, 0.0, rest)
    else:
        out.add(0, NONE, NONE, 0.0, rest)
    out.add(rest, " ", SPACE, 0.0, rest)
    out.add(rest, OTHER, COPY, 0.0, rest)
    out.final[rest] = 0.0
    return out


def pieces_or_bytes(vocabulary: Vocabulary) -> Machine:
    """Normalised characters to ids, any number of pieces and bytes one after another."""
    out, at = Machine(final={0: 0.0}), {"": 0}
    for i, (piece, score, kind) in enumerate(vocabulary.pieces):
        if kind not in MATCHED:
            continue
        for k in range(len(piece)):
            if piece[: k + 1] not in at:
                at[piece[: k + 1]] = out.state()
                out.add(at[piece[:k]], piece[k], (), 0.0, at[piece[: k + 1]])
        out.add(at[piece], NONE, (i,), -score, 0)
    spelt = out.state()  # where a character has been written as bytes
    out.add(spelt, NONE, (), 0.0, 0)
    single = {p for p, _, kind in vocabulary.pieces if kind in MATCHED and len(p) == 1}
    for label in [x for x in out.arcs[0] if x not in single]:
        out.add(0, label, vocabulary.spelt(label), -vocabulary.unknown_score, spelt)
    out.add(0, OTHER, BYTES, -vocabulary.unknown_score, spelt)
    return out


def composed(a: Machine, b: Machine, spell: Callable[[str], tuple[int, ...]]) -> Machine:
    """The machine that reads what `a` reads and writes what `b` writes when it reads a's output."""
    out, at, todo = Machine(), {(0, 0): 0}, [(0, 0)]

    def to(pair: tuple[int, int]) -> int:
        if pair not in at:
            at[pair] = out.state()
            todo.append(pair)
        return at[pair]

    def steps(symbol: str, q: int) -> Iterator[Arc]:
        for written, more, q2 in b.arcs[q].get(symbol) or b.arcs[q].get(OTHER, ()):
            yield spell(symbol) if written == BYTES else written, more, q2

    while todo:
        p, q = pair = todo.pop()
        own = at[pair]
        for written, cost, q2 in b.arcs[q].get(NONE, ()):
            out.add(own, NONE, written, cost, to((p, q2)))
        for label, arcs in a.arcs[p].items():
            for symbol, cost, p2 in arcs:
                if symbol == NONE:
                    out.add(own, label, (), cost, to((p2, q)))
                elif symbol == COPY:  # each label of b that `a` has no arc of its own for, and all other characters
                    for x in [x for x in b.arcs[q] if x not in (NONE, OTHER) and x not in a.arcs[p]]:
                        for written, more, q2 in steps(x, q):
                            out.add(own, x, written, cost + more, to((p2, q2)))
                    for written, more, q2 in b.arcs[q].get(OTHER, ()):
                        out.add(own, OTHER, written, cost + more, to((p2, q2)))
                else:
                    for written, more, q2 in steps(symbol, q):
                        out.add(own, label, written, cost + more, to((p2, q2)))
        if p in a.final and q in b.final:
            out.final[own] = a.final[p] + b.final[q]
    return out


def without_empty_arcs(machine: Machine) -> Machine:
    """The same paths from states that have no empty arcs: an empty arc is joined to each arc that leads to it."""

    def onward(output: tuple, cost: float, to: int) -> Iterator[Arc]:
        if to in machine.final or any(x != NONE for x in machine.arcs[to]):
            yield output, cost, to
        for written, more, beyond in machine.arcs[to].get(NONE, ()):
            yield from onward(written or output, cost + more, beyond)  # of two such arcs one writes nothing

    out = Machine([{} for _ in machine.arcs], machine.final)
    for state, arcs in enumerate(machine.arcs):
        for label, some in arcs.items():
            if label != NONE:
                out.arcs[state][label] = [x for arc in some for x in onward(*arc)]
    return out


class Paths(dict):
    """Shortest paths of stretches, found when first asked for; those of short stretches are kept, up to `room`."""

    def __init__(self, find: Callable[[str], tuple[int, ...]], room: int):
        super().__init__()
        self.find, self.room = find, room

    def __missing__(self, run: str) -> tuple[int, ...]:
        ids = self.find(run)
        if len(run) < 100:
            if len(self) >= self.room:
                self.clear()
            self[run] = ids
        return ids


class Transducer:
    """A model's machine, with the paths of stretches of text that it has found."""

    def __init__(self, vocabulary: Vocabulary, room: int = 300_000):
        self.vocabulary = vocabulary
        whole = composed(normaliser(vocabulary), pieces_or_bytes(vocabulary), vocabulary.spelt)
        self.home = next(iter(whole.final))  # between two pieces
        self.begin = self._start(whole)
        self.machine = without_empty_arcs(whole)
        self.stretch = vocabulary.stretch_pattern()
        self.first = Paths(lambda run: self.shortest(run, self.begin), room)
        self.later = Paths(lambda run: self.shortest(run, [(self.home, 0.0, ())]), room)
        # the inverse writes these bytes for each id
        self.plain = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(SPACE, " ").encode() for p, _, kind in vocabulary.pieces]

    def _start(self, whole: Machine) -> list[tuple[int, float, tuple]]:
        """States that the start's empty arcs (the dummy prefix) lead to: state, cost, path. The home state is last."""
        front, done = [(0, 0.0, ())], []
        while front:
            state, cost, crumb = front.pop()
            done.append((state, cost, crumb))
            front += [(to, cost + more, (crumb, output) if output else crumb) for output, more, to in whole.arcs[state].get(NONE, ())]
        return sorted(done[1:], key=lambda x: x[0] == self.home)

    def shortest(self, run: str, front: list[tuple[int, float, tuple]]) -> tuple[int, ...]:
        """Ids on the cheapest path through the composition of `run` with the machine.

        States stand in the order in which their pieces begin; inside of pieces no two paths meet. Of equal costs the
        path that came first stays: its last piece begins earliest.
        """
        arcs, spell, home = self.machine.arcs, self.vocabulary.spelt, self.home
        for c in run:
            after, best, last = [], None, ()
            for state, cost, crumb in front:
                some = arcs[state].get(c)
                if some is None:
                    some = arcs[state].get(OTHER, ())
                for output, more, to in some:
                    if to != home:
                        after.append((to, cost + more, crumb))
                    elif best is None or cost + more < best:
                        best, last = cost + more, (crumb, spell(c) if output == BYTES else output)
            if best is not None:
                after.append((home, best, last))
            front = after
        crumb, out = front[-1][2], []
        while crumb:
            crumb, ids = crumb
            out.append(ids)
        return tuple(i for ids in reversed(out) for i in ids)

    def encode(self, text: str) -> list[int]:
        """Between stretches every path is between two pieces, so a text's path is theirs one after another."""
        if not text:
            return []
        first, *rest = self.stretch.findall(text)
        return [*self.first[first], *chain.from_iterable(map(self.later.__getitem__, rest))]

    def decode(self, ids: list[int]) -> str:
        """The inverse: pieces, then bytes, joined; space marks become spaces and the dummy prefix goes."""
        text = b"".join(map(self.plain.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.vocabulary.dummy_prefix and text.startswith(" ") else text


@lru_cache(maxsize=1)
def compiled(model_path: str) -> Transducer:
    """The machine of a model file; a worker keeps it, with the paths that it knows, from task to task."""
    return Transducer(load(model_path), room=600_000)


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id and ids (array of int) of each text; null or empty text has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(model_path)
        for batch in batches:
            ids = [machine.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of each row of ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(model_path)
        for batch in batches:
            texts = [machine.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (little-endian 32-bit ids) and lossless: whether decoding gives the text back.

    The space mark itself decodes to a space, so a text that holds it isn't lossless.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(model_path)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                ids = machine.encode(text or "")
                rows.append((len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()), machine.decode(ids) == (text or "")))
            n, crc, same = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "ids_crc32", "lossless"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, lossless boolean")
