"""SentencePiece vocabularies: normalisation with alignment, and the units no piece crosses.

Normalisation follows the compiled character map of the model: at every position the longest key
of its double-array trie is replaced, anything else is copied. Each normalised character keeps the byte
span of the text it came from.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as schema

SPACE = "▁"
CHUNK_CHARS = 1 << 19
# Piece kinds of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class CharacterMap:
    """Longest-prefix replacement by the trie and the strings of a compiled map."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if size else ()
        self.strings = blob[4 + size :]
        self.first = frozenset(self._children(0)) if size else frozenset()

    def _step(self, node: int) -> int:
        unit = self.units[node]
        return node ^ ((unit >> 10) << ((unit & 0x200) >> 6))

    def _follows(self, node: int, byte: int) -> bool:
        return node < len(self.units) and self.units[node] & 0x800000FF == byte

    def _children(self, node: int) -> list[int]:
        base = self._step(node)
        return [b for b in range(1, 256) if self._follows(base ^ b, b)]

    def longest(self, data: bytes, at: int) -> tuple[int, str] | None:
        """Length of the longest key at ``at`` and its replacement."""
        found, node = None, self._step(0)
        for end in range(at, len(data)):
            node ^= data[end]
            if not self._follows(node, data[end]):
                break
            ends_here = self.units[node] >> 8 & 1
            node = self._step(node)
            if ends_here:
                found = (end + 1 - at, self.units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        start = found[1]
        return found[0], self.strings[start : self.strings.index(b"\0", start)].decode()


def _byte_lengths(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return 1 + (points > 0x7F) + (points > 0x7FF).astype(np.int64) + (points > 0xFFFF)


class PieceModel:
    """A vocabulary file with its normaliser, and the library's segmenter without one."""

    def __init__(self, path: str):
        proto = schema.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        rules = proto.normalizer_spec
        self.map = CharacterMap(rules.precompiled_charsmap)
        self.dummy = rules.add_dummy_prefix
        self.squeeze = rules.remove_extra_whitespaces
        self.space = SPACE if rules.escape_whitespaces else " "
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        self.byte_fallback = proto.trainer_spec.byte_fallback
        self.kinds = np.array([p.type for p in proto.pieces], np.uint8)
        self.lengths = np.array([len(p.piece) for p in proto.pieces], np.int64)
        self.scores = {p.piece: p.score for p in proto.pieces if p.type in (NORMAL, USER_DEFINED)}
        self.lowest = min(p.score for p in proto.pieces if p.type == NORMAL)
        self.own = sorted((p.piece for p in proto.pieces if p.type == USER_DEFINED), key=len, reverse=True)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        rules.precompiled_charsmap, rules.add_dummy_prefix, rules.remove_extra_whitespaces = b"", False, False
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self._joinable([p.piece for p in proto.pieces if p.type in (NORMAL, USER_DEFINED, UNUSED)])
        self._special = self._special_pattern()

    def _joinable(self, pieces: list[str]) -> None:
        """Which neighbouring characters stand next to each other in some piece."""
        chars = sorted({c for p in pieces if len(p) > 1 for c in p})
        number = {c: k + 1 for k, c in enumerate(chars)}
        self.classes = np.zeros(0x110000, np.uint16)
        self.classes[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.together = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for p in pieces:
            for a, b in zip(p, p[1:], strict=False):
                self.together[number[a], number[b]] = True

    def _special_pattern(self) -> re.Pattern | None:
        """Matches where something other than copying may happen."""
        parts = [re.escape(p).encode() for p in self.own]
        if self.map.first:
            parts.append(b"[" + b"".join(b"\\x%02x" % b for b in sorted(self.map.first)) + b"]")
        return re.compile(b"|".join(parts)) if parts else None

    def _segments(self, text: str) -> Iterator[tuple[str, int, int | None]]:
        """``(normalised, source start, source length)``; no length: copied byte for byte."""
        if self._special is None:
            yield text, 0, None
            return
        data, done, at = text.encode(), 0, 0
        while match := self._special.search(data, at):
            at = match.start()
            if data[at] & 0xC0 == 0x80:  # inside a character
                at += 1
                continue
            own = next((p for p in self.own if data.startswith(p.encode(), at)), None)
            hit = (len(own.encode()), own) if own else self.map.longest(data, at)
            if hit is None:
                at += 1
                continue
            if at > done:
                yield data[done:at].decode(), done, None
            yield hit[1], at, hit[0]
            done = at = at + hit[0]
        if done < len(data):
            yield data[done:].decode(), done, None

    def normalise(self, text: str) -> tuple[str, np.ndarray, np.ndarray]:
        """The normalised text and the source byte span of each of its characters."""
        if not text:
            return "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        out, starts, ends = [], [], []
        for norm, start, length in self._segments(text):
            out.append(norm)
            if length is None:
                stop = start + np.cumsum(_byte_lengths(norm))
                ends.append(stop)
                starts.append(np.concatenate([[start], stop[:-1]]))
            else:
                starts.append(np.full(len(norm), start, np.int64))
                ends.append(np.full(len(norm), start + length, np.int64))
        norm, first, last = "".join(out), np.concatenate(starts), np.concatenate(ends)
        if self.squeeze:
            points = np.frombuffer(norm.encode("utf-32-le"), np.uint32)
            blank = points == 32
            keep = ~blank | np.concatenate([[False], ~blank[:-1]])
            norm = points[keep].tobytes().decode("utf-32-le")
            first, last = first[keep], last[keep]
            if not norm:
                return "", first, last
        norm = norm.replace(" ", self.space)
        if self.dummy and not self.suffix:
            norm, first, last = self.space + norm, np.append(0, first), np.append(0, last)
        if self.squeeze:
            norm = norm.rstrip(self.space)
            first, last = first[: len(norm)], last[: len(norm)]
        if self.dummy and self.suffix:
            size = len(text.encode())
            norm, first, last = norm + self.space, np.append(first, size), np.append(last, size)
        return norm, first, last

    def cuts(self, norm: str, text_starts: np.ndarray) -> np.ndarray:
        """Borders that no piece crosses, from 0 to the end; text starts are borders."""
        points = np.frombuffer(norm.encode("utf-32-le"), np.uint32)
        kind = self.classes[points]
        border = np.ones(len(points) + 1, bool)
        border[1:-1] = ~self.together[kind[:-1], kind[1:]]
        border[text_starts] = True
        return np.flatnonzero(border)


_loaded: dict[str, PieceModel] = {}


def load(path: str) -> PieceModel:
    """The model of a vocabulary file, once per Python worker."""
    if path not in _loaded:
        _loaded[path] = PieceModel(path)
    return _loaded[path]


class UnitTable:
    """Values of distinct units, worked out once and forgotten when there are too many.

    ``solve`` takes sorted new units and gives the number of values of each and one
    or more flat arrays with those values.
    """

    MOST = 1_000_000

    def __init__(self, solve: Callable[[list[str]], tuple[np.ndarray, ...]]):
        self.solve, self.rows, self.flat = solve, {}, None

    def look_up(self, units: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """How many values each unit has, and the values of all units in order."""
        if len(self.rows) > self.MOST:
            self.rows, self.flat = {}, None
        missing = sorted(set(units).difference(self.rows))
        if missing:
            self.rows.update(zip(missing, range(len(self.rows), len(self.rows) + len(missing)), strict=True))
            new = self.solve(missing)
            self.flat = [np.concatenate(x) for x in zip(self.flat, new, strict=True)] if self.flat else list(new)
        if not units:
            return np.zeros(0, np.int64), []
        sizes, *values = self.flat
        row = np.fromiter(map(self.rows.__getitem__, units), np.int64, len(units))
        n = sizes[row]
        at = np.repeat((np.cumsum(sizes) - sizes)[row] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return n, [v[at] for v in values]


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Row ranges of at most CHUNK_CHARS characters, or one longer text."""
    start = size = 0
    for row, text in enumerate(texts):
        if row > start and size + len(text) > CHUNK_CHARS:
            yield start, row
            start, size = row, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def units(model: PieceModel, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units of all texts in order, units per text, their first characters, and each character's source span."""
    parts = [model.normalise(t) for t in texts]
    norm = "".join(p[0] for p in parts)
    text_at = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
    borders = model.cuts(norm, text_at) if norm else np.zeros(1, np.int64)
    marks = borders.tolist()
    found = [norm[a:b] for a, b in zip(marks, marks[1:], strict=False)]
    per_text = np.diff(np.searchsorted(borders, text_at))
    first = np.concatenate([p[1] for p in parts])
    last = np.concatenate([p[2] for p in parts])
    return found, per_text, borders[:-1], first, last
