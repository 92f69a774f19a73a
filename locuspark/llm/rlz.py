"""Substring deduplication by relative Lempel-Ziv parsing.

Texts are kept in blocks in the shared folder.  A window is ``length``
consecutive words of a document; its anchor is the smallest hash of the short
word sequences within it, so equal windows have equal anchors.  Anchors deal
the text to reference indexes: first the anchors alone, which shows those that
occur once and whose windows cannot repeat; then the text of the others.

A block is parsed against itself, and each index parses the text it gets,
ordered by document and position, against what comes earlier.  The parse is
greedy: the first window that occurs earlier is looked up, and the copy is
followed word by word as far as it goes, which is a factor.  A factor of
``length`` words or more is a duplicate span.  The window across its end is
looked up next and may start another factor, so nothing is lost at factor
boundaries.  Hashes only find candidates: words are compared, by numbers that a
dictionary of the words themselves gives.  Factors go back to their blocks.

What a block holds twice is a factor within the block: an index gets one copy
of a window from each block, however often a passage occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuspark.llm import files
from locuspark.llm.common import materialise, scratch_path

#: Bytes of text in a block; what a task holds at once is a small multiple of it.
BLOCK_BYTES = 8 << 20
#: Blocks whose anchors one index gets, on average.
BLOCKS_PER_INDEX = 2
#: Words of the sequences that compete to be a window's anchor.
ANCHOR_WORDS = 4
_CHUNK_WORDS = 1 << 18
_LAST_ID = np.iinfo(np.int64).max
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)  # odd multipliers
_S29, _S32 = np.uint64(29), np.uint64(32)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hashes of its two parts."""
    x = (a ^ (a >> _S29)) * _K1 + (b ^ (b >> _S32)) * _K2
    return x ^ (x >> _S32)


def _rolling(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all sequences of ``length`` consecutive entries."""
    power, size, whole, done = words, 1, None, 0
    while True:
        if length & size:
            if whole is None:
                whole = power
            else:
                n = len(words) - done - size + 1
                whole = _mix(whole[: max(0, n)], power[done : done + max(0, n)])
            done += size
        if done == length:
            return whole
        n = len(power) - size
        power = _mix(power[: max(0, n)], power[size:]) if n > 0 else power[:0]
        size *= 2


def _rolling_min(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest of each ``width`` consecutive entries, and where it comes first."""

    def merged(ahead: int) -> tuple[np.ndarray, np.ndarray]:
        n = max(0, len(low) - ahead)
        later = low[ahead:] < low[:n]
        return np.where(later, low[ahead:], low[:n]), np.where(later, at[ahead:], at[:n])

    size, low, at = 1, values, np.arange(len(values))
    while 2 * size <= width:
        low, at = merged(size)
        size *= 2
    return merged(width - size) if width > size else (low, at)


def write_blocks(docs: DataFrame, path: str, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """Rows of ``block`` and ``file``; a file holds a block's documents by id, nulls last."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held, size = TaskContext.get().partitionId(), [], [], 0

        def flush() -> None:
            block = pa.Table.from_batches(held)
            order = pa.compute.sort_indices(block, sort_keys=[("doc_id", "ascending")], null_placement="at_end")
            name = f"{path}/block-{task:07d}-{len(made):05d}.arrow"
            files.write_block(name, block.take(order))
            made.append((task << 20 | len(made), name))
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                size += pa.compute.sum(pa.compute.binary_length(part.column(1))).as_py() or 0
                held.append(part)
                if size >= block_bytes:
                    flush()
                    size = 0
        if held:
            flush()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made)], ["block", "file"])

    return materialise(source.mapInArrow(run, "block long, file string"), "rlz-blocks")


def _chunks(file: str, length: int) -> Iterator[tuple]:
    """For the documents of a block, some at a time: their words; and row, start, anchor, its place, and word number of every window."""
    digest = xxhash.xxh3_64_intdigest
    row, words, sizes, first = 0, [], [], 0

    def windows() -> tuple:
        flat = np.fromiter(map(digest, words), np.uint64, len(words))
        n = np.array(sizes, np.int64)
        ends = np.cumsum(n)
        count = np.maximum(n - length + 1, 0)
        of = np.repeat(np.arange(len(n)), count)
        start = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        at = (ends - n)[of] + start
        anchors, places = _rolling_min(_rolling(flat, ANCHOR_WORDS), length - ANCHOR_WORDS + 1)
        return words, first + of, start, anchors[at], places[at], at

    for text in read_texts(file):
        found = text.split() if text else []
        sizes.append(len(found))
        words += found
        row += 1
        if len(words) >= _CHUNK_WORDS:
            yield windows()
            words, sizes, first = [], [], row
    if words:
        yield windows()


def read_texts(file: str) -> Iterator[bytes | None]:
    for chunk in files.read_block(file).column("text").cast(pa.large_binary()).chunks:
        for value in chunk:
            yield value.as_py()


def _changes(*columns: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Where a run starts: a column changes, or ``steps`` doesn't go up by one."""
    new = np.ones(len(steps), bool)
    if len(steps):
        new[1:] = steps[1:] != steps[:-1] + 1
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return np.nonzero(new)[0]


def _first_of(values: np.ndarray) -> np.ndarray:
    """For each entry, the position of the first entry with its value."""
    order = np.argsort(values, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = values[order][1:] != values[order][:-1]
    first = np.empty(len(order), np.int64)
    first[order] = order[np.nonzero(new)[0]][np.cumsum(new) - 1]
    return first


def _numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, the same for the same word alone."""
    return np.asarray(pa.array(words, pa.binary()).dictionary_encode().indices).astype(np.int64)


def _common(words: np.ndarray, a: int, b: int, limit: int, step: int = 64) -> int:
    """How many words from a and from b are the same, up to a limit."""
    n = 0
    while n < limit:
        m = min(step, limit - n)
        differs = words[a + n : a + n + m] != words[b + n : b + n + m]
        at = int(differs.argmax())
        if differs[at]:
            return n + at
        n += m
        step *= 2
    return limit


def parse(words: np.ndarray, at: np.ndarray, stop: np.ndarray, length: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Factors of ``length`` words or more: the first window of each, and its number of windows.

    Windows come in order: ``at`` is a window's first word, ``stop`` the end of
    the text that it is part of, up to where the windows listed are consecutive.
    """
    if hashes is None:
        mixed = _mix(words.astype(np.uint64), words.astype(np.uint64))
        hashes = _rolling(mixed, length)[at]
    source = _first_of(hashes)
    again = np.nonzero(source < np.arange(len(at)))[0]
    first, size, k = [], [], 0
    while k < len(again):
        here = int(again[k])
        copied = _copied(words, at, stop, here, int(source[here]))
        if copied < length:  # another window with this hash
            same = np.nonzero(hashes[:here] == hashes[here])[0].tolist()
            copied = max((_copied(words, at, stop, here, s) for s in same), default=0)
        if copied < length:
            k += 1
            continue
        first.append(here)
        size.append(copied - length + 1)
        k = k + 1 if size[-1] == 1 else int(np.searchsorted(again, here + size[-1]))
    return np.array(first, np.int64), np.array(size, np.int64)


def _copied(words: np.ndarray, at: np.ndarray, stop: np.ndarray, here: int, source: int) -> int:
    a, b = int(at[here]), int(at[source])
    return _common(words, a, b, min(int(stop[here]) - a, int(stop[source]) - b))


def duplicate_spans(blocks: DataFrame, length: int = 20) -> DataFrame:
    """``block``, ``file`` and ``spans`` of every block: rows, starts and numbers of windows that occur earlier."""
    if length < ANCHOR_WORDS:
        raise ValueError(f"windows have {ANCHOR_WORDS} words at least")
    n_blocks = max(1, blocks.count())
    n_index = max(1, -(-n_blocks // BLOCKS_PER_INDEX))

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, file in zip(*(c.to_pylist() for c in batch.columns)):
                found = []
                for _, row, start, anchor, place, _ in _chunks(file, length):
                    # Windows that share one occurrence of their anchor differ; only other occurrences can repeat them.
                    found.append(anchor[_changes(row, place, steps=start)])
                if not found:
                    continue
                values, counts = np.unique(np.concatenate(found), return_counts=True)
                index = (values >> _S32) % np.uint64(n_index)
                order = np.argsort(index, kind="stable")
                values, counts, index = values[order], counts[order], index[order]
                cuts = np.searchsorted(index, np.arange(n_index + 1, dtype=np.uint64))
                rows = [(i, block, values[a:b].tobytes(), np.packbits(counts[a:b] > 1).tobytes()) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows]) for k in (1, 2, 3))], ["index", "block", "anchors", "often"])

    def repeated(rows: pd.DataFrame) -> pd.DataFrame:
        anchors = [np.frombuffer(x, np.uint64) for x in rows["anchors"]]
        often = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(a)).astype(bool) for x, a in zip(rows["often"], anchors)]
        values, counts = np.unique(np.concatenate(anchors), return_counts=True)
        many = np.union1d(values[counts > 1], np.concatenate([a[o] for a, o in zip(anchors, often)]))
        return pd.DataFrame({"block": rows["block"], "anchors": [a[np.isin(a, many, assume_unique=True)].tobytes() for a in anchors]})

    spread = blocks.repartition(n_blocks)
    anchors = spread.mapInArrow(send_anchors, "index int, block long, anchors binary, often binary")
    shared = anchors.groupBy("index").applyInPandas(repeated, "block long, anchors binary")
    # Planned sizes of what Python makes are guesses: these joins must not broadcast it.
    wanted = blocks.join(shared.groupBy("block").agg(F.collect_list("anchors").alias("anchors")).hint("merge"), "block")

    def send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, file, lists in zip(*(c.to_pylist() for c in batch.columns)):
                many = np.sort(np.frombuffer(b"".join(lists), np.uint64))
                if not len(many):
                    continue
                words, kept = [], []
                for some, row, start, anchor, _, at in _chunks(file, length):
                    near = np.minimum(np.searchsorted(many, anchor), len(many) - 1)
                    hit = many[near] == anchor
                    kept.append((row[hit], start[hit], anchor[hit], at[hit] + len(words)))
                    words += some
                row, start, anchor, at = (np.concatenate(c) for c in zip(*kept))
                ids = files.read_block(file).column("doc_id").to_pandas().astype("Int64").fillna(_LAST_ID).to_numpy(np.int64)
                yield _fragments(block, ids, words, row, start, anchor, at, n_index, length)

    def factors(rows: pd.DataFrame) -> pd.DataFrame:
        decided = rows[rows["text"].str.len() == 0]
        out = [(b, _triples(r, s, n)) for b, r, s, n in zip(decided["block"], *(decided[c].map(_ints) for c in ("row", "start", "size")))]
        rows = rows[rows["text"].str.len() > 0]
        if len(rows):
            out += _parsed(rows, length)
        return pd.DataFrame(out, columns=["block", "spans"])

    schema = "index int, block long, doc_id binary, row binary, start binary, size binary, text binary"
    sent = wanted.repartition(n_blocks).mapInArrow(send_windows, schema)
    spans = sent.groupBy("index").applyInPandas(factors, "block long, spans binary")
    return blocks.join(spans.groupBy("block").agg(F.collect_list("spans").alias("spans")).hint("merge"), "block", "left")


def _ints(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int32)


def _triples(row: np.ndarray, start: np.ndarray, size: np.ndarray) -> bytes:
    return np.stack([row, start, size], axis=1).astype(np.int32).tobytes()


def _fragments(block: int, ids: np.ndarray, words: list[bytes], row: np.ndarray, start: np.ndarray, anchor: np.ndarray, at: np.ndarray, n_index: int, length: int) -> pa.RecordBatch:
    """What a block sends: the spans of its factors against itself, and to each index the text of the other windows."""
    runs = _changes(row, steps=start)
    lengths = np.diff(np.append(runs, len(row)))
    stop = np.repeat(at[runs] + lengths + length - 1, lengths)
    first, size = parse(_numbered(words), at, stop, length)
    out = []
    if len(first):
        out.append((n_index + block % n_index, b"", row[first].astype(np.int32).tobytes(), start[first].astype(np.int32).tobytes(), size.astype(np.int32).tobytes(), b""))
    covered = np.zeros(len(row) + 1, np.int64)
    covered[first] += 1
    np.subtract.at(covered, first + size, 1)
    new = np.cumsum(covered[:-1]) == 0
    row, start, anchor, at = row[new], start[new], anchor[new], at[new]
    cut = _changes(row, anchor, steps=start)
    size = np.diff(np.append(cut, len(row)))
    index = ((anchor[cut] >> _S32) % np.uint64(n_index)).astype(np.int64)
    begin, end = at[cut].tolist(), (at[cut] + size + length - 1).tolist()
    for i in np.unique(index).tolist():
        mine = np.nonzero(index == i)[0]
        c = cut[mine]
        text = b" ".join([w for k in mine.tolist() for w in words[begin[k] : end[k]]])
        out.append((i, ids[row[c]].tobytes(), row[c].astype(np.int32).tobytes(), start[c].astype(np.int32).tobytes(), size[mine].astype(np.int32).tobytes(), text))
    columns = [pa.array([o[0] for o in out], pa.int32()), pa.array([block] * len(out), pa.int64())] + [pa.array([o[k] for o in out], pa.binary()) for k in range(1, 6)]
    return pa.RecordBatch.from_arrays(columns, ["index", "block", "doc_id", "row", "start", "size", "text"])


def _parsed(rows: pd.DataFrame, length: int) -> list[tuple[int, bytes]]:
    """Factors of an index's fragments, as spans for each block."""
    row, start, size = (np.concatenate([_ints(x) for x in rows[c]]) for c in ("row", "start", "size"))
    ids = np.concatenate([np.frombuffer(x, np.int64) for x in rows["doc_id"]])
    words = _numbered(b" ".join(rows["text"]).split(b" "))
    block = np.repeat(rows["block"].to_numpy(), rows["row"].str.len() // 4)
    begin = np.cumsum(size + length - 1) - (size + length - 1)
    # The reference: all fragments, by document and position.
    order = np.lexsort((start, row, block, ids))
    n = size[order].astype(np.int64)
    fragment = np.repeat(order, n)
    within = np.arange(len(fragment)) - np.repeat(np.cumsum(n) - n, n)
    first, count = parse(words, begin[fragment] + within, begin[fragment] + size[fragment] + length - 1, length)
    of = fragment[first]
    spans = pd.DataFrame({"block": block[of], "row": row[of], "start": start[of] + within[first], "size": count})
    return [(b, _triples(g["row"].to_numpy(), g["start"].to_numpy(), g["size"].to_numpy())) for b, g in spans.groupby("block")]


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept``, the kept words joined by a space, for every row.

    A word goes where some window over it has a word sequence that also starts
    earlier: in a document with a smaller id, or before in the same document.
    Words are runs without ASCII white space, compared as they are; windows are
    judged on the input.  Null texts have no words.  Null ids come last; rows
    that repeat an id count as one document after the other, in table order.
    Columns but these two are left out.
    """
    blocks = write_blocks(docs, scratch_path(docs.sparkSession, "rlz"), id_col, text_col, block_bytes)
    spans = duplicate_spans(blocks, length).repartition(max(1, blocks.count()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, lists in zip(batch.column("file").to_pylist(), batch.column("spans").to_pylist()):
                found = np.frombuffer(b"".join(lists or []), np.int32).reshape(-1, 3)
                found = found[np.argsort(found[:, 0], kind="stable")]
                ids = files.read_block(file).column("doc_id").to_pylist()
                bounds = np.searchsorted(found[:, 0], np.arange(len(ids) + 1))
                rows, held = [], 0
                for i, text in enumerate(read_texts(file)):
                    words = text.split() if text else []
                    kept = words
                    if bounds[i] < bounds[i + 1]:
                        cover = np.zeros(len(words) + 1, np.int32)
                        part = found[bounds[i] : bounds[i + 1]]
                        np.add.at(cover, part[:, 1], 1)
                        np.add.at(cover, part[:, 1] + part[:, 2] + length - 1, -1)
                        kept = [w for w, c in zip(words, np.cumsum(cover).tolist()) if not c]
                    rows.append((ids[i], len(words), len(words) - len(kept), b" ".join(kept)))
                    held += len(rows[-1][3])
                    if held > 4 << 20:
                        yield _kept(rows)
                        rows, held = [], 0
                if rows:
                    yield _kept(rows)

    return spans.select("file", "spans").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")


def _kept(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
    columns[3] = columns[3].cast(pa.string())
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept"])
