"""Token sequences in training order, in shards of fixed-stride records.

Documents' ids are cut into sequences.  A sequence's index counts the sequences
of documents with smaller ids; a keyed Feistel permutation, walked until it
lands among the sequences, turns the index into a global slot.  Slots are dealt
by range to shards, files of records of one size: a reader seeks to any slot
and goes on from there, and the order is the same however the job was split.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tiktoken import Encoding

from locuspark.llm import files
from locuspark.llm.common import materialise, scratch_path

#: Bytes of records that a task deals at once, and rows of a shard.
BLOCK_BYTES = 16 << 20
SHARD_ROWS = 1 << 15
ROUNDS = 6
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class SlotPermutation:
    """A keyed permutation of 0..n-1, computed for any element on its own."""

    def __init__(self, n: int, key: int | str) -> None:
        if n < 0:
            raise ValueError("a permutation needs a size of zero or more")
        self.n = n
        self.half = np.uint64(max(1, -(-max(1, (n - 1).bit_length()) // 2)))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        digest = hashlib.sha256(f"{key}".encode()).digest() + hashlib.sha256(f"{key}/2".encode()).digest()
        self.keys = np.frombuffer(digest, "<u8")[:ROUNDS]

    def _round(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * _MIX[0]
        x = (x ^ (x >> np.uint64(30))) * _MIX[1]
        x = (x ^ (x >> np.uint64(27))) * _MIX[2]
        return (x ^ (x >> np.uint64(31))) & self.mask

    def _pass(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in keys:
            if back:
                left, right = right ^ self._round(left, key), left
            else:
                left, right = right, left ^ self._round(right, key)
        return left << self.half | right

    def _walk(self, values: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        out = np.asarray(values, np.uint64).copy()
        if len(out) and int(out.max()) >= self.n:
            raise ValueError("not an element of the permutation")
        todo = np.arange(len(out))
        while len(todo):
            out[todo] = self._pass(out[todo], keys, back)
            todo = todo[out[todo] >= self.n]
        return out.astype(np.int64)

    def slots(self, indexes: np.ndarray) -> np.ndarray:
        return self._walk(indexes, self.keys, False)

    def indexes(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, self.keys[::-1], True)


def record_type(sequence: int, id_bytes: int) -> np.dtype:
    """A record: the document and whether it has an id, the sequence's place in it, its number of ids, the ids and zeros."""
    return np.dtype([("doc_id", "<i8"), ("named", "u1"), ("part", "<i4"), ("n", "<i4"), ("ids", f"<u{id_bytes}", (sequence,))])


#: Fixed value: how byte-level vocabularies of this kind cut texts before merging.
CUTS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The same cuts, which are found faster: without ways back, and for texts without the runs of space below, before which the lookahead cuts.
_CUTS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_PLAIN_CUTS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"""
_SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_RUN = f"[{_SPACE}][{_SPACE}][^{_SPACE}]"


def read_ranks(path: str) -> bytes:
    """A vocabulary file's lines, each a piece in base64 and its rank, which tasks get as they are (about 1 MB)."""
    with open(path, "rb") as f:
        return f.read()


def vocabulary_size(ranks: bytes) -> int:
    return len(ranks.split(b"\n")) - ranks.endswith(b"\n")


@lru_cache(maxsize=1)  # a worker's tasks share it
def encoder(ranks: bytes) -> Callable[[pa.Array], list[bytes | None]]:
    """Packed ids of texts, which never are Python numbers."""
    known = {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in ranks.splitlines())}
    # The library looks for special pieces on this way, and without any it would find empty ones; this one is not allowed, so it is plain text.
    special = {"<|end|>": max(known.values()) + 1}
    plain, cut = (Encoding("byte-level", pat_str=cuts, mergeable_ranks=known, special_tokens=special).encode_to_numpy for cuts in (_PLAIN_CUTS, _CUTS))

    def encode(texts: pa.Array) -> list[bytes | None]:
        runs = pc.match_substring_regex(texts, _RUN).to_pylist()
        return [None if t is None else (cut if r else plain)(t, disallowed_special=()).astype("<i4", copy=False).tobytes() for t, r in zip(texts.to_pylist(), runs)]

    return encode


def tokenise(docs: DataFrame, ranks: bytes, text_col: str = "text") -> DataFrame:
    """``doc_id`` and packed ``ids`` by byte-level merges.  Null texts have null ids."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(encode(batch.column(1)), pa.binary())], ["doc_id", "ids"])

    return source.mapInArrow(run, "doc_id long, ids binary")


def _sequences(tokens: DataFrame) -> DataFrame:
    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids")


def _ids(packed: pa.Scalar, end_id: int | None, id_bytes: int) -> np.ndarray:
    ids = np.frombuffer(packed.as_py() or b"", "<i4")
    if len(ids) and int(ids.max()) >= 1 << 8 * id_bytes:
        raise ValueError(f"an id needs more than {id_bytes} bytes")
    if end_id is not None and packed.is_valid:
        ids = np.append(ids, end_id)
    return ids.astype(f"<u{id_bytes}")


def _counted(tokens: DataFrame, end_id: int | None, sequence: int) -> DataFrame:
    """A row per document: its partition, its row there, and its number of sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = [-(-(len(x.as_py()) // 4 + (end_id is not None)) // sequence) if x.is_valid else 0 for x in batch.column(1)]
            n = batch.num_rows
            columns = [pa.array([task] * n, pa.int32()), pa.array(range(row, row + n), pa.int64()), batch.column(0), pa.array(sizes, pa.int64())]
            row += n
            yield pa.RecordBatch.from_arrays(columns, ["block", "row", "doc_id", "sequences"])

    return materialise(_sequences(tokens).mapInArrow(run, "block int, row long, doc_id long, sequences long"), "order-docs")


def _write_firsts(numbered: DataFrame, path: str) -> int:
    """A file for each partition of the tokens: its documents in order, and the index of each one's first sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, listed in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = pa.Table.from_struct_array(listed.values).sort_by("row")
                files.write_block(f"{path}/{block:07d}.arrow", rows)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32())], ["block"])

    listed = numbered.groupBy("block").agg(F.collect_list(F.struct("row", "doc_id", "first")).alias("rows"))
    return materialise(listed.mapInArrow(run, "block int"), "order-firsts").count()


def _numbered(docs: DataFrame) -> tuple[DataFrame, int]:
    """Documents with ``first``, the index of their first sequence, by document id, and the number of sequences."""
    parts = max(1, docs.count() // 500_000)
    order = [F.asc_nulls_last("doc_id"), "block", "row"]
    ranged = materialise(docs.repartitionByRange(parts, *order).withColumn("piece", F.spark_partition_id()), "order-ranges")
    # One row for each range.
    sums = dict(ranged.groupBy("piece").agg(F.sum("sequences")).collect())
    starts, total = {}, 0
    for piece in sorted(sums):
        starts[piece], total = total, total + sums[piece]
    if not starts:
        return ranged.withColumn("first", F.lit(0).cast("long")), 0
    base = docs.sparkSession.createDataFrame(list(starts.items()), "piece int, base long")
    before = Window.partitionBy("piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("sequences").over(before), F.lit(0)) + F.col("base")
    return ranged.join(F.broadcast(base), "piece").withColumn("first", first), total


def write_shards(
    tokens: DataFrame, path: str, sequence: int, key: int | str = 0, end_id: int | None = None, id_bytes: int = 2, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """Write ``doc_id`` and packed ``ids`` as shards; returns ``shard``, ``file``, ``first_slot``, ``records``.

    A document's ids, with ``end_id`` after them, are cut into sequences; the
    last is padded with zeros.  Null ids give none, and empty ones none but
    the end.  A null doc_id counts as the largest, and its records are marked
    as without an id.  A shard that is there in full is left as it is, so a job
    can be resumed under the same path.

    ``tokens`` is run twice, to count and to write, so that ids are never
    stored but in shards.  It must give the same rows in the same partitions,
    as scans do; documents that differ are an error.
    """
    numbered, total = _numbered(_counted(tokens, end_id, sequence))
    firsts = scratch_path(tokens.sparkSession, "order-firsts")
    _write_firsts(numbered, firsts)
    record, order = record_type(sequence, id_bytes), SlotPermutation(total, key)

    def packed(records: list[np.ndarray], index: list[np.ndarray]) -> pa.RecordBatch:
        slots, made = order.slots(np.concatenate(index)), np.concatenate(records)
        shard = slots // shard_rows
        by = np.argsort(shard, kind="stable")
        cuts = np.nonzero(np.diff(shard[by], prepend=-1))[0]
        rows = []
        for a, b in zip(cuts, [*cuts[1:], len(by)]):
            at = by[a:b]
            rows.append((int(shard[by[a]]), len(at), pa.Codec("zstd").compress(slots[at].tobytes() + made[at].tobytes(), asbytes=True)))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary()))], ["shard", "n", "data"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, at = None, 0
        records, index, held = [], [], 0
        for batch in batches:
            if known is None and batch.num_rows:
                rows = files.read_block(f"{firsts}/{TaskContext.get().partitionId():07d}.arrow")
                known = rows.column("doc_id").to_pylist(), rows.column("first").to_pylist()
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                if at >= len(known[0]) or known[0][at] != doc:
                    raise ValueError("the tokens differ from those that were counted; write them to a table first")
                values, first = _ids(ids, end_id, id_bytes), known[1][at]
                at += 1
                n = -(-len(values) // sequence)
                if not n:
                    continue
                made = np.zeros(n, record)
                made["doc_id"], made["named"], made["part"] = doc or 0, doc is not None, np.arange(n)
                made["n"] = np.minimum(sequence, len(values) - sequence * np.arange(n))
                made["ids"] = np.pad(values, (0, n * sequence - len(values))).reshape(n, sequence)
                records.append(made)
                index.append(first + np.arange(n))
                held += made.nbytes
                if held >= BLOCK_BYTES:
                    yield packed(records, index)
                    records, index, held = [], [], 0
        if records:
            yield packed(records, index)

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["shard"].iloc[0])
        first = shard * shard_rows
        size = min(shard_rows, total - first)
        name = f"{path}/shard-{shard:08d}.bin"
        if files.size_of(name) != size * record.itemsize:
            out, filled = np.zeros(size, record), np.zeros(size, bool)
            for n, data in zip(rows["n"], rows["data"]):
                data = pa.Codec("zstd").decompress(data, n * (8 + record.itemsize), asbytes=True)
                at = np.frombuffer(data[: 8 * n], np.int64) - first
                out[at], filled[at] = np.frombuffer(data[8 * n :], record), True
            if not filled.all():
                raise ValueError(f"shard {shard} lacks sequences")
            with files.writing(name) as to:
                to.write(out.tobytes())
        return pd.DataFrame({"shard": [shard], "file": [name], "first_slot": [first], "records": [size]})

    dealt = _sequences(tokens).mapInArrow(deal, "shard long, n int, data binary") if total else tokens.sparkSession.createDataFrame([], "shard long, n int, data binary")
    return materialise(dealt.groupBy("shard").applyInPandas(write, "shard long, file string, first_slot long, records long"), "order-shards")


def read_slots(shards: DataFrame, sequence: int, id_bytes: int = 2, start: int = 0, stop: int | None = None) -> DataFrame:
    """``slot``, ``doc_id``, ``part``, ``n_ids`` and packed ``ids`` of the slots from start up to stop.

    Only files that hold such slots are opened, and only their part is read.
    """
    record = record_type(sequence, id_bytes)
    ends = F.col("first_slot") + F.col("records")
    wanted = shards.where(ends > start)
    if stop is not None:
        wanted = wanted.where(F.col("first_slot") < stop)
    n = max(1, wanted.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, first, records in zip(*(c.to_pylist() for c in batch.columns)):
                at, end = max(0, start - first), records if stop is None else min(records, stop - first)
                with files.seeking(file) as stream:
                    stream.seek(at * record.itemsize)
                    while at < end:
                        got = np.frombuffer(stream.read(min(8192, end - at) * record.itemsize), record)
                        ids = [x["ids"][: x["n"]].tobytes() for x in got]
                        doc = pa.array(got["doc_id"], mask=got["named"] == 0)
                        slots = pa.array(np.arange(first + at, first + at + len(got)))
                        yield pa.RecordBatch.from_arrays([slots, doc, pa.array(got["part"]), pa.array(got["n"]), pa.array(ids, pa.binary())], ["slot", "doc_id", "part", "n_ids", "ids"])
                        at += len(got)

    return wanted.select("file", "first_slot", "records").repartition(n).mapInArrow(run, "slot long, doc_id long, part int, n_ids int, ids binary")


def materialise_order(tokens: DataFrame, sequence: int, key: int | str = 0, end_id: int | None = None, id_bytes: int = 2) -> DataFrame:
    """Shards of ``tokens`` in the shared folder, read in slot order."""
    return read_slots(write_shards(tokens, scratch_path(tokens.sparkSession, "order"), sequence, key, end_id, id_bytes), sequence, id_bytes)
