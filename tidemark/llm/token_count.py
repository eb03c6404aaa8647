"""Count-only Viterbi: how many unigram pieces a text has, without making the pieces.

An Aho-Corasick automaton over the vocabulary's pieces of text (no control and byte pieces) enumerates every match
that ends at each character; dynamic programming carries the best score and the number of pieces. Of equal scores the
earliest start, so the longest last piece, wins, as in the tokenizer. A character that is no piece costs ten below the
least score and counts one piece for each UTF-8 byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import MATCHED, SPACE, Vocabulary, load


class Counter(dict):
    """Pieces of each stretch of text, remembered for up to `room` short ones."""

    def __init__(self, vocabulary: Vocabulary, room: int = 300_000):
        import ahocorasick

        super().__init__()
        self.room, self.automaton = room, ahocorasick.Automaton()
        for piece, score, kind in vocabulary.pieces:
            if kind in MATCHED:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown, self.stretch = vocabulary.unknown_score, vocabulary.stretch_pattern()
        self.prefix = SPACE if vocabulary.dummy_prefix else ""

    def __missing__(self, run: str) -> int:
        value = self.best(run)
        if len(run) < 100:
            if len(self) >= self.room:
                self.clear()
            self[run] = value
        return value

    def best(self, run: str) -> int:
        size = len(run)
        score, count = [0.0] * (size + 1), [0] * (size + 1)
        at = 0  # ends up to here are done

        def close(end: int, matches: list) -> None:
            # longest first, so the earliest start comes first and only a better score replaces it
            top, pieces, single = None, 0, False
            for length, value in matches:
                single |= length == 1
                if top is None or score[end - length] + value > top:
                    top, pieces = score[end - length] + value, count[end - length] + 1
            if not single and (top is None or score[end - 1] + self.unknown > top):
                top, pieces = score[end - 1] + self.unknown, count[end - 1] + len(run[end - 1].encode("utf-8", "replace"))
            score[end], count[end] = top, pieces

        waiting: list = []
        for last, match in self.automaton.iter(run):
            if last + 1 != at:
                if at:
                    close(at, sorted(waiting, reverse=True))
                for end in range(at + 1, last + 1):
                    close(end, [])
                at, waiting = last + 1, []
            waiting.append(match)
        if at:
            close(at, sorted(waiting, reverse=True))
        for end in range(at + 1, size + 1):
            close(end, [])
        return count[size]

    def of(self, text: str) -> int:
        if not text:
            return 0
        first, *rest = self.stretch.findall(text.replace(" ", SPACE))
        return self[self.prefix + first] + sum(map(self.__getitem__, rest))


@lru_cache(maxsize=1)
def compiled(model_path: str) -> Counter:
    """The counter of a model file; a worker keeps it, with the runs that it knows, from task to task."""
    return Counter(load(model_path), room=600_000)


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens (0 for null or empty text). Repeated rows are counted one by one.

    Scores are summed in double precision. Stretches of a text whose ends no piece crosses are counted on their own.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = compiled(model_path)
        for batch in batches:
            n = [counter.of(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n_tokens long")
