"""SentencePiece encoding and decoding by a streaming Viterbi search.

The vocabulary file's own model decides what the best path is.  For a unigram
model it is the path with the largest sum of scores.  For a byte-pair model it
is the path of the merges, and a forward search finds that too: the best path
to a position ends in the one piece that stands next to the previous path's
last piece without the merges joining or splitting them.  So each position
keeps one backpointer, as in any Viterbi search, and the ids are those of the
merge procedure.

The search streams.  Pieces to come start at most the longest piece's length
back, so only the paths to these last positions survive.  Their backpointers
are followed until they meet on one boundary; the ids up to there are committed
and forgotten.  What is retained is a small multiple of the longest piece, as
soon as the surviving paths agree, whatever the text's length.  Between two
characters that no piece holds side by side all paths meet at once; texts are
cut at some such places, and the ids of short segments remembered.  The pieces
that can end at a position come from an automaton over all of them, whose
steps are made as texts need them.
"""

from __future__ import annotations

import re
import struct
from bisect import bisect_left
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Segments whose ids a worker remembers, twice, and their longest length; in 12,000 texts of check_l 150,000 were no faster.
CACHE_SEGMENTS = 60_000
REMEMBERED = 64
_CACHE_PAIRS = 200_000
_CACHE_STEPS = 400_000
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_UNIGRAM, _BPE = 1, 2
_SPACE = "▁"


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, data[at : at + n]
            at += n


class _Recent(dict):
    """A bounded memory: the entries since it was last full, and those of the time before."""

    def __init__(self, size: int) -> None:
        self._size, self._old = size, {}

    def __missing__(self, key: str) -> bytes | None:
        value = self._old.get(key)
        if value is not None:
            self.keep(key, value)
        return value

    def keep(self, key: str, value: bytes) -> None:
        if len(self) >= self._size:
            self._old = dict(self)
            self.clear()
        self[key] = value


class PieceModel:
    """A SentencePiece vocabulary, and the search over it."""

    def __init__(self, data: bytes) -> None:
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        self.kind, self.byte_fallback, self.dummy_prefix, self.squeeze, rule = _UNIGRAM, False, True, True, ""
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.types.append(piece.get(3, _NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
                self.kind, self.byte_fallback = trainer.get(3, _UNIGRAM), bool(trainer.get(35, 0))
            elif number == 3:
                norm = dict(_fields(value))
                rule = norm.get(1, b"").decode()
                self.dummy_prefix, self.squeeze = bool(norm.get(3, 1)), bool(norm.get(4, 1))
        if self.kind not in (_UNIGRAM, _BPE) or not self.byte_fallback or self.squeeze or rule not in ("", "identity"):
            raise ValueError("only unigram and byte-pair vocabularies that keep texts whole are supported: byte fallback, no normalisation")
        # Spaces stand for themselves here, so the mark in a text is an ordinary character that falls back to bytes.
        self.id_of = {p.replace(_SPACE, " "): i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t in (_NORMAL, _USER, _UNUSED)}
        self._packed = {p: struct.pack("<i", i) for p, i in self.id_of.items()}
        self.longest = max(map(len, self.id_of), default=1)
        self.bytes_of = [self._bytes(p, t) for p, t in zip(self.pieces, self.types)]
        self.byte_id = {b[0]: i for i, (b, t) in enumerate(zip(self.bytes_of, self.types)) if t == _BYTE}
        self._unknown = min(self.scores, default=0.0) - 10.0
        # Steps of the automaton, made as texts need them: what a text ends in decides which pieces can end there.
        self._sorted = sorted(self.id_of)
        self._nodes: dict[str, tuple[dict, list]] = {}
        self._n_steps = 0
        self._beside: dict[str, dict[str, bool]] = {}
        self._n_beside = 0
        self._whole: dict[str, bool] = {}
        self._segments = _Recent(CACHE_SEGMENTS)
        within = {a + b for p in self.id_of for a, b in zip(p, p[1:])}
        self._splits = not any(b == " " != a or "\n" in (a, b) for a, b in within)
        # Words are searched without the marks after them that no piece holds behind a letter.
        letters = {c for c in "".join(self.id_of) if c.isalpha()}
        marks = {c for c in "".join(self.id_of) if not c.isalnum() and c != "\n"} - {pair[1] for pair in within if pair[0] in letters}
        word = f" *[{re.escape(''.join(sorted(letters)))}]++(?=[{re.escape(''.join(sorted(marks)))}\n]|\\Z)|" if letters else ""
        self._segment = re.compile(word + r" *[^ \n]+| +|\n")

    @staticmethod
    def _bytes(piece: str, kind: int) -> bytes:
        if kind == _BYTE:
            return bytes([int(piece[3:5], 16)])
        return b"" if kind in (_CONTROL, _UNKNOWN) else piece.replace(_SPACE, " ").encode()

    # The byte-pair procedure on short strings, which decides what may stand side by side.

    def _merged(self, text: str) -> list[str]:
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.id_of.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or self.scores[found] > best):
                    best, at = self.scores[found], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stands(self, piece: str) -> bool:
        known = self._whole.get(piece)
        if known is None:
            known = self._whole[piece] = self._merged(piece) == [piece]
        return known

    def _adjacent(self, left: str, right: str) -> bool:
        """Whether the merges leave the two side by side; nothing stands before the first piece."""
        beside = self._beside[right]
        if self._n_beside >= _CACHE_PAIRS:
            self._n_beside = 0
            for known in self._beside.values():
                known.clear()
        self._n_beside += 1
        beside[left] = known = not left or self._merged(left + right) == [left, right]
        return known

    # The automaton over the pieces: its state is the longest end of the text that begins a piece.

    def _node(self, text: str) -> tuple[dict, list]:
        """The steps from the state after ``text``, and the pieces of several characters that can end there, longest first.

        A piece comes with its size and with what is known to stand before it.
        ``steps[""]`` is the state.
        """
        for at in range(max(0, len(text) - self.longest), len(text) + 1):
            state = text[at:]
            found = bisect_left(self._sorted, state)
            if not state or (found < len(self._sorted) and self._sorted[found].startswith(state)):
                break
        node = self._nodes.get(state)
        if node is None:
            ends = [state[i:] for i in range(len(state) - 1)]
            node = {"": state}, [(len(p), p, self._beside.setdefault(p, {})) for p in ends if p in self.id_of and self._stands(p)]
            self._nodes[state] = node
        return node

    def _step(self, steps: dict, character: str) -> tuple[dict, list, bool]:
        """The node after a character, and whether no piece holds it and what is before it."""
        if self._n_steps >= _CACHE_STEPS:
            self._forget()
        self._n_steps += 1
        node, ends = self._node(steps[""] + character)
        steps[character] = node, ends, len(node[""]) < 2
        return steps[character]

    def _forget(self) -> None:
        """Without the steps; nodes hold each other, so each is emptied but for its state, from which a search goes on."""
        for state, (steps, _) in self._nodes.items():
            steps.clear()
            steps[""] = state
        self._nodes.clear()
        self._n_steps = 0

    def _best_piece(self, text: str, end: int, base: int, sums: list[float]) -> str:
        """The piece that ends the path to ``end`` with the largest sum of scores, which is appended to ``sums``."""
        chosen, best = "", None
        for start in range(max(base, end - self.longest), end):
            piece = text[start:end]
            found = self.id_of.get(piece)
            if found is None and len(piece) > 1:
                continue
            total = sums[start - base] + (self._unknown if found is None else self.scores[found])
            if best is None or total > best:
                chosen, best = piece, total
        sums.append(best)
        return chosen

    def _meeting(self, base: int, end: int, last: list[str]) -> int:
        """The latest boundary that is on the paths to all of the last positions, from which pieces may start."""
        n = end - base
        live = ((1 << min(self.longest, n + 1)) - 1) << max(0, n + 1 - self.longest)
        while live & (live - 1):
            at = live.bit_length() - 1
            live ^= 1 << at
            live |= 1 << (at - len(last[at]))
        return base + live.bit_length() - 1

    def _commit(self, base: int, to: int, last: list[str]) -> list[str]:
        """The pieces of the path from the committed boundary to another, whose backpointers are then forgotten."""
        done, at = [], to
        while at > base:
            done.append(last[at - base])
            at -= len(done[-1])
        del last[: to - base]
        return done[::-1]

    def paths(self, text: str) -> Iterator[list[str]]:
        """Pieces of the best path, as lists that end at each boundary on which all surviving paths were found to agree.

        ``last`` holds, for the committed boundary ``base`` and each position
        after it, the last piece of the best path to there: the backpointers.
        """
        return self._merge_paths(text) if self.kind == _BPE else self._sum_paths(text)

    def _merge_paths(self, text: str) -> Iterator[list[str]]:
        """The path to a position ends in the longest piece that stands next to the path before it.

        Where no piece that begins before a position can end after it, all
        paths meet, and no merge joins what is on both sides.
        """
        base, end, last, look, n = 0, 0, [""], 2 * self.longest, len(text)
        beside = [""]  # as last, but empty where all paths meet: what follows there stands beside nothing
        steps, append, stand = self._node("")[0], last.append, beside.append
        for character in text:
            step = steps.get(character)
            if step is None:
                step = self._step(steps, character)
            steps, ends, apart = step
            if apart:
                beside[-1] = ""
            end += 1
            chosen = character  # where equal scores leave the merges' order open
            for size, piece, known in ends:
                before = beside[-size]
                fits = known.get(before)
                if fits is None:
                    fits = self._adjacent(before, piece)
                if fits:
                    chosen = piece
                    break
            append(chosen)
            stand(chosen)
            if end == look and end < n:
                to = self._meeting(base, end, last)
                look = end + self.longest
                if to > base:
                    yield self._commit(base, to, last)
                    del beside[: to - base]
                    base = to
                    if len(steps[""]) > end - base:  # pieces no longer start before the boundary
                        steps = self._node(text[base:end])[0]
        if n:
            yield self._commit(base, n, last)

    def _sum_paths(self, text: str) -> Iterator[list[str]]:
        """The path to a position has the largest sum of scores."""
        base, last, sums, look, n = 0, [""], [0.0], 2 * self.longest, len(text)
        for end in range(1, n + 1):
            last.append(self._best_piece(text, end, base, sums))
            if end == look and end < n:
                to = self._meeting(base, end, last)
                look = end + self.longest
                if to > base:
                    yield self._commit(base, to, last)
                    del sums[: to - base]
                    base = to
        if n:
            yield self._commit(base, n, last)

    def _ids(self, text: str) -> bytes:
        packed = self._packed
        return b"".join([packed.get(piece) or self._bytes_packed(piece) for pieces in self.paths(text) for piece in pieces])

    def _bytes_packed(self, character: str) -> bytes:
        return b"".join(struct.pack("<i", self.byte_id[b]) for b in character.encode())

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        if not text:
            return b""
        whole = " " + text if self.dummy_prefix else text
        if not self._splits:
            return self._ids(whole)
        known = self._segments
        segments = self._segment.findall(whole)
        out = list(map(known.get, segments))
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    segment = segments[i]
                    ids = known[segment]
                    if ids is None:
                        ids = self._ids(segment)
                        if len(segment) <= REMEMBERED:
                            known.keep(segment, ids)
                    out[i] = ids
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        if self.dummy_prefix and data.startswith(b" "):
            data = data[1:]
        return data.decode("utf-8", "replace")

    def end_id(self) -> int | None:
        return self.pieces.index("</s>") if "</s>" in self.pieces else None


class _Sent:
    """A vocabulary for tasks: a worker makes its search once, and drops it with the broadcast as soon as other tasks come."""

    def __init__(self, data: bytes) -> None:
        self.data = data

    def __reduce__(self) -> tuple:
        return _Sent, (self.data,)

    @cached_property
    def pieces(self) -> PieceModel:
        return PieceModel(self.data)

    def __del__(self) -> None:
        if "pieces" in self.__dict__:
            self.pieces._forget()


def read_model(path: str) -> bytes:
    """The vocabulary file's bytes, which tasks get as they are (about 0.5 MB)."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, text_col: str = "text", out_col: str = "ids", packed: bool = False) -> DataFrame:
    """``docs`` with its texts' ids: an array of ints, or with ``packed`` the bytes of little-endian 32-bit ints.

    A null text has null ids, an empty one has none.  A column named as
    ``out_col`` is replaced.
    """
    source = docs.drop(out_col).withColumn(text_col, F.col(text_col).cast("string"))
    at = source.columns.index(text_col)
    schema = source.withColumn(out_col, F.lit(None).cast("binary" if packed else "array<int>")).schema
    sent = docs.sparkSession.sparkContext.broadcast(_Sent(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = sent.value.pieces
        for batch in batches:
            found = [None if t is None else pieces.encode_bytes(t) for t in (x.as_py() for x in batch.column(at))]
            ids = pa.array(found, pa.binary())
            if not packed:
                sizes = np.array([0 if b is None else len(b) // 4 for b in found], np.int32)
                ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int32))).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(b for b in found if b), "<i4"))
                ids = pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array([b is None for b in found]))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, out_col])

    return source.mapInArrow(run, schema)


def decode(rows: DataFrame, model: bytes, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the texts of their ids, which are an array of ints or packed; null ids give null."""
    source = rows.drop(out_col)
    at = source.columns.index(ids_col)
    schema = source.withColumn(out_col, F.lit(None).cast("string")).schema
    sent = rows.sparkSession.sparkContext.broadcast(_Sent(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = sent.value.pieces
        for batch in batches:
            texts = []
            for x in batch.column(at):
                ids = x.as_py()
                if isinstance(ids, bytes):
                    ids = np.frombuffer(ids, "<i4").tolist()
                texts.append(None if ids is None else pieces.decode(ids))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out_col])

    return source.mapInArrow(run, schema)
