"""Ids of whole texts, run of text by run of text, so that a run that comes again isn't tokenised again."""

from __future__ import annotations

import json
import os
import string
from collections.abc import Iterator
from functools import cache

import numpy as np

from .common import chunks

#: The normaliser and the pre-tokenizer under which `split_runs` holds. White space becomes one space and is
#: dropped between words; letters are lower-cased; a word is a stretch of letters, one digit, a stretch of other
#: characters, or an apostrophe's ending. So no word crosses white space, none holds both a letter and a punctuation mark
#: behind it, and composition (NFC) joins nothing to a space or an ASCII mark in front of it.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
LOWER = bytes(range(256)).lower().replace(b"\n", b" ")
LETTER, MARK = (np.array([chr(b) in found for b in range(256)]) for found in (string.ascii_lowercase, string.punctuation))


def split_runs(text: bytes) -> list[bytes]:
    """Runs of text whose ids, one after another, are the text's ids.

    Such a tokenizer cuts between a letter and a mark anyway, and it lower-cases anyway; special tokens must stay as they are.
    """
    if b"<|" in text:
        return text.replace(b"\n", b" ").split(b" ")
    text = text.translate(LOWER)
    row = np.frombuffer(text, np.uint8)
    cut = np.flatnonzero(LETTER[row[:-1]] & MARK[row[1:]]) + 1
    return (np.insert(row, cut, 32).tobytes() if len(cut) else text).split(b" ")


class WordIds:
    """Little-endian 32-bit ids of texts; those of runs are remembered, the last `room` to twice as many of them.

    A tokenizer whose file has the parts above reads a text as its runs; any other one reads each text whole. Runs
    that are new are tokenised together: plain words joined by spaces in one call, told apart again by the pieces that
    end words, and other runs one by one.
    """

    def __init__(self, path: str, room: int = 250_000):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer, self.room, self.known, self.older = Tokenizer.from_file(path), room, {}, {}
        told = json.loads(self.tokenizer.to_str())
        as_runs = told["normalizer"] == NORMALIZER and told["pre_tokenizer"] == PRE_TOKENIZER and all("<|" in x["content"] for x in told["added_tokens"])
        self.split = split_runs if as_runs else lambda text: [text]
        vocabulary, end = self.tokenizer.get_vocab(), told["model"].get("end_of_word_suffix")
        self.ends = None
        if as_runs and end and all(x + end in vocabulary for x in vocabulary if len(x) == 1):  # every word ends with such a piece
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for x, i in vocabulary.items() if x.endswith(end)]] = True

    def _each(self, runs: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)]

    def _joined(self, words: list[str]) -> list[bytes]:
        ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        last = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        if len(last) != len(words):  # each word has at least one end, so equal numbers mean one each
            return self._each(words)
        data, last = ids.tobytes(), last.tolist()
        return [data[a:b] for a, b in zip([0, *last], last)]

    def _fresh(self, runs: list[bytes]) -> dict[bytes, bytes]:
        texts = [x.decode("utf-8", "replace") for x in runs]
        plain = [i for i, t in enumerate(texts) if t.isalpha()] if self.ends is not None else []
        out = {}
        for part in chunks(plain, lambda i: len(texts[i]), 1 << 14):
            out.update(zip((runs[i] for i in part), self._joined([texts[i] for i in part]), strict=True))
        rest = [i for i, x in enumerate(runs) if x not in out]
        out.update(zip((runs[i] for i in rest), self._each([texts[i] for i in rest]), strict=True))
        return out

    def of(self, texts: list[bytes]) -> Iterator[bytes]:
        for part in chunks(texts, len, 1 << 19):
            runs = [self.split(t) for t in part]
            if len(self.known) >= self.room:
                self.known, self.older = {}, self.known
            own, older, new = self.known, self.older, []
            for x in set().union(*runs).difference(own):
                if x in older:
                    own[x] = older[x]
                else:
                    new.append(x)
            fresh = self._fresh(new)
            own.update(fresh)
            for words in runs:
                yield b"".join(map(own.__getitem__, words))
            for x in fresh:
                if len(x) >= 100:  # not worth the memory
                    del own[x]


@cache
def word_ids(path: str) -> WordIds:
    """One for each Python worker, which serves many tasks."""
    return WordIds(path)
