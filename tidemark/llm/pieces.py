"""Reads a SentencePiece model file: pieces with scores and kinds, and the switches of its normaliser."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property

NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
SPACE = "▁"
#: Kinds of pieces that text can be matched with.
MATCHED = (NORMAL, USER_DEFINED)


@dataclass(frozen=True)
class Vocabulary:
    pieces: list[tuple[str, float, int]] = field(repr=False)
    dummy_prefix: bool = True

    @cached_property
    def byte_ids(self) -> list[int]:
        at = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        return [at[f"<0x{b:02X}>"] for b in range(256)]

    @cached_property
    def unknown_score(self) -> float:
        """Of a character that no piece is: ten below the least score."""
        return min(s for _, s, kind in self.pieces if kind == NORMAL) - 10.0

    def spelt(self, character: str) -> tuple[int, ...]:
        """Ids of a character's UTF-8 bytes."""
        return tuple(self.byte_ids[b] for b in character.encode("utf-8", "replace"))

    def stretch_pattern(self) -> re.Pattern:
        """Stretches of a raw text whose ends no piece crosses: a space begins one, a line feed is one."""
        pieces = [p for p, _, kind in self.pieces if kind in MATCHED]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            return re.compile(r".+", re.S)
        if any("\n" in p for p in pieces):
            return re.compile(f"[ {SPACE}]+[^ {SPACE}]*|[^ {SPACE}]+")
        return re.compile(f"[ {SPACE}]+[^ {SPACE}\n]*|[^ {SPACE}\n]+|\n")


def load(path: str) -> Vocabulary:
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    assert sentencepiece  # the proto comes with it
    spec = model.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("the model's normaliser does more than a dummy prefix and space marks")
    return Vocabulary([(p.piece, p.score, p.type) for p in model.pieces], spec.add_dummy_prefix)
