"""Reading a SentencePiece model file: the fields of its protobuf that encoding needs."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

#: Fixed values of the file format.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE = "▁"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        number, kind = key >> 3, key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield number, value


@dataclass
class PieceModel:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    space_at_end: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    fold_spaces: bool = True
    escape_spaces: bool = True

    @property
    def unknown(self) -> int:
        return self.kinds.index(UNKNOWN)


def read_model(path: str) -> PieceModel:
    model = PieceModel()
    with open(path, "rb") as file:
        data = file.read()
    for number, value in _fields(data):
        if number == 1:
            piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(value))
            model.pieces.append(piece[1].decode())
            model.scores.append(struct.unpack("<f", piece[2])[0])
            model.kinds.append(piece[3])
        elif number == 2:
            spec = dict(_fields(value))
            model.model_type = spec.get(3, UNIGRAM)
            model.space_at_end = bool(spec.get(24, 0))
            model.byte_fallback = bool(spec.get(35, 0))
        elif number == 3:
            spec = dict(_fields(value))
            model.charsmap = spec.get(2, b"")
            model.dummy_prefix, model.fold_spaces = bool(spec.get(3, 1)), bool(spec.get(4, 1))
            model.escape_spaces = bool(spec.get(5, 1))
    if model.space_at_end or not model.escape_spaces:
        raise ValueError("models that put the space mark after words, or use none, are not supported")
    return model
