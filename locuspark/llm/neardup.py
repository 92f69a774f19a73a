"""Near-duplicate groups at a given shingle similarity, on wide SimHash fingerprints.

At a Jaccard similarity of 0.8, fingerprints of 64 bits differ in 10 bits on
average, and so do many unrelated pairs of a large corpus.  Here fingerprints
have 256 bits, and links are verified on the shingle sets themselves.

The first vantage point is the empty set: sets of similarity s have sizes
within a factor s, so sizes are cut into rings of that factor, and a document
meets its own ring and visits the next.  Within a ring the pairs are searched
by vantage points in Hamming space, and those of small sets, whose distances
are wide, by shingles that they share.  A first pass finds the documents that
have a candidate at all; only their shingle sets are shuffled, and a second
pass verifies candidates, closest first, as long as they are not yet linked.
It answers with stars, which star contraction joins into groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuspark.llm.common import keep_rows, materialise, stable, text_sum
from locuspark.llm.components import connected_components
from locuspark.llm.simhash import _Forest

WORDS = 4
SHINGLE = 5
SIMILARITY = 0.8
#: Documents of a ring's block; a task compares two blocks.
BLOCK_ROWS = 16384
#: Keys up to this many are sent to all tasks (16 bytes each); beyond it the join shuffles.
BROADCAST_KEYS = 500_000
_SEEDS = tuple(np.uint64(s) for s in (0, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)
_PAIRS = 1 << 20
_STEP = 64
#: Pairs of sets of which one has at most this many shingles are found by shared shingles, not by fingerprints.
SMALL = 64
_SMALL_PAIRS = 1 << 14
#: Share of the pairs at exactly the similarity, larger than SMALL, whose fingerprints may differ in more bits than allowed.
MISS = 1e-7
#: Unions of sets up to this size are looked at for the worst case; beyond it ties weigh less and less.
_UNION = 256


def radius_for(similarity: float, bits: int, deviations: float = 3.5) -> int:
    """Bits in which fingerprints of sets with this similarity differ at most, but for one pair in some thousands."""
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return math.ceil(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


def _binomial(n: int) -> np.ndarray:
    logs = np.array([math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) for k in range(n + 1)])
    return np.exp(logs - n * math.log(2))


def _bit_differs(a_only: int, b_only: int, shared: int) -> float:
    """Probability that a fingerprint bit of two sets differs; a tie of a set is 0."""
    ones = np.arange(shared + 1)

    def one(own: int) -> np.ndarray:
        above = np.append(np.cumsum(_binomial(own)[::-1])[::-1], 0.0)
        least = (own + shared) // 2 + 1 - ones
        return np.where(least <= 0, 1.0, above[np.clip(least, 0, own + 1)])

    pa, pb = one(a_only), one(b_only)
    return float(_binomial(shared) @ (pa * (1 - pb) + pb * (1 - pa)))


@lru_cache
def worst_radius(similarity: float, bits: int, small: int = SMALL, miss: float = MISS) -> int:
    """Bits in which the fingerprints of two sets of this similarity, both larger than ``small``, differ at most, but for a share of ``miss``."""
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    for union in range(small + 1, _UNION + 1):
        shared = math.ceil(similarity * union - 1e-9)
        for a_only in range((union - shared) // 2 + 1):
            if shared + a_only > small:
                p = max(p, _bit_differs(a_only, union - shared - a_only, shared))
    tail = 0.0
    for r in range(bits, -1, -1):
        tail += math.comb(bits, r) * p**r * (1 - p) ** (bits - r)
        if tail > miss:
            return r
    return 0


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text, A-Z lower-cased; of a shorter text, the whole."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(1, len(words) - shingle + 1)
    stops = ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter([digest(joined[s:e]) for s, e in zip(starts[:last].tolist(), stops.tolist())], np.uint64, last))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """256 bits: each is set if it is in over half of the mixed hashes."""
    out = np.zeros(WORDS, np.uint64)
    for k, seed in enumerate(_SEEDS):
        mixed = (hashes ^ seed) * _MULTIPLIER
        mixed = (mixed ^ (mixed >> _SHIFT)) * _MULTIPLIER
        mixed ^= mixed >> _SHIFT
        counts = np.zeros(64, np.int64)
        for at in range(0, len(mixed), 1 << 16):
            counts += np.unpackbits(mixed[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * counts > len(hashes)).view(np.uint64)[0]
    return out


def _marked(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """Row, text checksum, doc_id, key of the shingle set, its size, fingerprint, and the set as 32-bit hashes."""
    source = docs.select(
        F.monotonically_increasing_id().alias("row"), text_sum(F.col(text_col)).alias("sum"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, prints, sets = [], [], [], []
            for text in batch.column(3):
                h = shingle_hashes(text.as_py(), shingle)
                keys.append(xxhash.xxh3_64_intdigest(h.tobytes()))
                sizes.append(len(h))
                prints.append(wide_fingerprint(h).tobytes())
                sets.append(np.unique(h.astype(np.uint32)).tobytes())
            key = pa.array(np.array(keys, np.uint64).view(np.int64))
            columns = [*batch.columns[:3], key, pa.array(sizes, pa.int32()), pa.array(prints, pa.binary()), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "sum", "doc_id", "key", "size", "print", "members"])

    return materialise(source.mapInArrow(run, "row long, sum long, doc_id long, key long, size int, print binary, members binary"), "neardup")


def _dealt(classes: DataFrame, similarity: float, block_rows: int, extra: list[str]) -> DataFrame:
    """Rows keyed by ring and pair of blocks; ``own`` rows are the home block, the others the queries.

    A ring's blocks are as many as its rows need.  A query meets every home
    block of its ring from its own on, and every home block of the next ring.
    """
    ring = F.floor(F.log(F.greatest(F.col("size"), F.lit(1))) / F.lit(-math.log(similarity)) + F.lit(1e-9)).cast("int")
    rows = classes.where("size > 0").withColumn("ring", ring)
    # One row for each ring: about five for each doubling of the largest document.
    blocks = {r["ring"]: max(1, -(-r["n"] // block_rows)) for r in rows.groupBy("ring").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not blocks:
        return rows.selectExpr("ring", "0 as home", "0 as query", "true as near", "true as own", "key", "size", "print", *extra).limit(0)
    count = F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv])
    mine, following = count[F.col("ring")], F.coalesce(count[F.col("ring") + 1], F.lit(0))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("key"), mine).cast("int"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    key = lambda ring, home, query, near, own: F.struct(ring.cast("int").alias("ring"), home.cast("int").alias("home"), query.cast("int").alias("query"), F.lit(near).alias("near"), F.lit(own).alias("own"))
    before = F.coalesce(count[F.col("ring") - 1], F.lit(0))
    block = F.col("block")
    places = F.concat(
        # Home to the queries of this ring up to this block, and to those of the ring before.
        F.transform(F.sequence(F.lit(0), block), lambda q: key(F.col("ring"), block, q, True, True)),
        F.transform(upto(before), lambda q: key(F.col("ring"), block, q, False, True)),
        # Query to the later blocks of this ring, and to those of the next.
        F.transform(F.filter(upto(mine), lambda h: h > block), lambda h: key(F.col("ring"), h, block, True, False)),
        F.transform(upto(following), lambda h: key(F.col("ring") + 1, h, block, False, False)),
    )
    return rows.select("key", "size", "print", *extra, F.explode(places).alias("at")).select("at.*", "key", "size", "print", *extra)


def _prints(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint64).reshape(-1, WORDS)


def _near(home: np.ndarray, other: np.ndarray, radius: int, narrow: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions and distances of pairs within the radius.

    Vantage points split both sides into rings by the first 64 bits, in which a
    pair within the radius differs in ``narrow`` at most.
    """
    rng = np.random.default_rng(0)
    stack = [(np.arange(len(home)), np.arange(len(other)), 0)]
    while stack:
        i, j, depth = stack.pop()
        if not len(i) or not len(j):
            continue
        if len(i) * len(j) > 1 << 18 and depth < 8:
            vantage = home[i[rng.integers(len(i))], 0]
            di, dj = np.bitwise_count(home[i, 0] ^ vantage), np.bitwise_count(other[j, 0] ^ vantage)
            order = np.argsort(dj, kind="stable")
            j, dj = j[order], dj[order]
            cuts = np.searchsorted(dj, np.arange(66))
            parts = [(i[di == d], j[cuts[max(0, d - narrow)] : cuts[min(65, d + narrow + 1)]], depth + 1) for d in np.unique(di).tolist()]
            if sum(len(a) * len(b) for a, b, _ in parts) < 0.8 * len(i) * len(j):
                stack += parts
                continue
        step = max(1, _PAIRS // len(j))
        b = other[j, 0]
        for at in range(0, len(i), step):
            rows = i[at : at + step]
            x, y = np.nonzero(np.bitwise_count(home[rows, 0][:, None] ^ b) <= narrow)
            x, y = rows[x], j[y]
            d = np.bitwise_count(home[x] ^ other[y]).sum(axis=1)
            keep = d <= radius
            if keep.any():
                yield x[keep], y[keep], d[keep]


def _sharing(home: list[np.ndarray], other: list[np.ndarray], similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs that can have the similarity, some more than once.

    Of a set's n members in a common order, rare ones first, similar sets share
    one of the first n - ceil(similarity * n) + 1 each.
    """
    sets = home + other
    sizes = np.array([len(m) for m in sets], np.int64)
    if not sizes.sum():
        return
    _, member, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.lexsort((member, counts[member], owner))
    member, owner = member[order], owner[order]
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    first = rank <= sizes[owner] - np.ceil(similarity * sizes[owner] - 1e-9)
    member, owner = member[first], owner[first]
    mine = owner < len(home)
    hm, ho, qm, qo = member[mine], owner[mine], member[~mine], owner[~mine] - len(home)
    order = np.argsort(qm, kind="stable")
    qm, qo = qm[order], qo[order]
    begin, end = np.searchsorted(qm, hm, "left"), np.searchsorted(qm, hm, "right")
    held = end > begin
    ho, begin, lengths = ho[held], begin[held], (end - begin)[held]
    stops = np.cumsum(lengths)
    for at in range(0, int(stops[-1]) if len(stops) else 0, _SMALL_PAIRS):
        pair = np.arange(at, min(at + _SMALL_PAIRS, int(stops[-1])))
        k = np.searchsorted(stops, pair, "right")
        yield ho[k], qo[begin[k] + pair - (stops[k] - lengths[k])]


def _pairs(home: pd.DataFrame, query: pd.DataFrame, radius: int, narrow: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions and distances of pairs whose sizes allow the similarity; where one is small all of them, else those within the radius."""
    hp, qp = _prints(home["print"]), _prints(query["print"])
    hs, qs = home["size"].to_numpy(), query["size"].to_numpy()
    fits = lambda x, y: np.minimum(hs[x], qs[y]) >= similarity * np.maximum(hs[x], qs[y]) - 1e-9
    hl, ql = np.flatnonzero(hs > SMALL), np.flatnonzero(qs > SMALL)
    for x, y, d in _near(hp[hl], qp[ql], radius, narrow):
        x, y = hl[x], ql[y]
        ok = fits(x, y)
        yield x[ok], y[ok], d[ok]
    most = SMALL / similarity + 1e-9
    hl, ql = np.flatnonzero(hs <= most), np.flatnonzero(qs <= most)
    if not len(hl) or not len(ql) or min(hs.min(), qs.min()) > SMALL:
        return
    members = lambda rows, at: [np.frombuffer(m, np.uint32) for m in rows["members"].iloc[at]]
    for x, y in _sharing(members(home, hl), members(query, ql), similarity):
        x, y = hl[x], ql[y]
        ok = fits(x, y) & (np.minimum(hs[x], qs[y]) <= SMALL)
        x, y = x[ok], y[ok]
        yield x, y, np.bitwise_count(hp[x] ^ qp[y]).sum(axis=1)


def _similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= similarity * (len(a) + len(b) - shared) - 1e-9


def near_duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, block_rows: int = BLOCK_ROWS, broadcast_keys: int = BROADCAST_KEYS
) -> DataFrame:
    """``doc_id`` and ``component_id``: the smallest id that links of this similarity reach, for every row.

    Rows with the same shingle set are one class; null and wordless texts are
    one class as well, which links to no other.  Null ids keep their rows; a
    group whose ids are all null has a null component.
    """
    marked = _marked(docs, id_col, text_col, shingle)
    grouped = _grouped(marked, similarity, block_rows, broadcast_keys)
    least = grouped.groupBy("root").agg(F.min("first.doc_id").alias("component_id"))
    named = grouped.select("key", "root").join(least, "root").select("key", "component_id")
    return marked.select("doc_id", "key").join(named, "key").select("doc_id", "component_id")


def _grouped(marked: DataFrame, similarity: float, block_rows: int, broadcast_keys: int) -> DataFrame:
    """Key and root of every class of equal sets, and its first row by id, nulls last, and place."""
    radius, narrow = worst_radius(similarity, 64 * WORDS), worst_radius(similarity, 64)
    few = F.when(F.col("size") <= SMALL / similarity + 1e-9, F.col("members"))
    classes = marked.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row", "sum")).alias("first"), F.first("size").alias("size"), F.first("print").alias("print"), F.first(few).alias("members"))
    classes = materialise(classes, "neardup-classes")
    at = ["ring", "home", "query", "near"]

    def found(rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        """Home and query rows of a key; blocks that meet themselves have no query rows of their own."""
        home = rows[rows["own"]]
        near, same = bool(rows["near"].iloc[0]), rows["home"].iloc[0] == rows["query"].iloc[0]
        return home, home if near and same else rows[~rows["own"]]

    def candidates(rows: pd.DataFrame) -> pd.DataFrame:
        home, query = found(rows)
        hit_h, hit_q = np.zeros(len(home), bool), np.zeros(len(query), bool)
        if len(home) and len(query):
            hk, qk = home["key"].to_numpy(), query["key"].to_numpy()
            for x, y, _ in _pairs(home, query, radius, narrow, similarity):
                ok = hk[x] != qk[y]
                hit_h[x[ok]] = True
                hit_q[y[ok]] = True
        return pd.DataFrame({"key": np.unique(np.concatenate([home["key"].to_numpy()[hit_h], query["key"].to_numpy()[hit_q]])).astype(np.int64)})

    first = _dealt(classes, similarity, block_rows, ["members"]).groupBy(*at).applyInPandas(candidates, "key long")
    wanted = materialise(first.distinct(), "neardup-wanted")
    small = wanted.count() <= broadcast_keys
    sets = marked.select("key", "members").join(F.broadcast(wanted) if small else wanted, "key", "left_semi")
    sets = sets.groupBy("key").agg(F.first("members").alias("members"))
    held = classes.drop("members").join(sets, "key").select("key", "size", "print", "members")
    held = materialise(held, "neardup-held")

    def verified(rows: pd.DataFrame) -> pd.DataFrame:
        home, query = found(rows)
        src, dst = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(home) and len(query):
            keys, inverse = np.unique(np.concatenate([home["key"].to_numpy(), query["key"].to_numpy()]), return_inverse=True)
            hi, qi = inverse[: len(home)], inverse[len(home) :]
            hm, qm = ([np.frombuffer(m, np.uint32) for m in s["members"]] for s in (home, query))
            forest = _Forest(len(keys))
            for x, y, d in _pairs(home, query, radius, narrow, similarity):
                order = np.argsort(d, kind="stable")
                x, y = x[order], y[order]
                while len(x):
                    # The closest pairs that are still apart; what they link need not be looked at.
                    apart = forest.label[hi[x]] != forest.label[qi[y]]
                    x, y = x[apart], y[apart]
                    linked = [_similar(hm[a], qm[b], similarity) for a, b in zip(x[:_STEP].tolist(), y[:_STEP].tolist())]
                    forest.union(hi[x[:_STEP][linked]], qi[y[:_STEP][linked]])
                    x, y = x[_STEP:], y[_STEP:]
            linked = forest.label != np.arange(len(keys))
            src, dst = keys[linked], keys[forest.label[linked]]
        return pd.DataFrame({"src": src.astype(np.int64), "dst": dst.astype(np.int64)})

    stars = _dealt(held, similarity, block_rows, ["members"]).groupBy(*at).applyInPandas(verified, "src long, dst long")
    roots = connected_components(stars)
    tied = roots.select(F.col("node").alias("key"), "root").union(roots.select(F.col("root").alias("key"), "root").distinct())
    return classes.select("key", "first").join(tied, "key", "left").withColumn("root", F.coalesce("root", "key"))


def one_of_each_group(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, block_rows: int = BLOCK_ROWS, broadcast_keys: int = BROADCAST_KEYS
) -> DataFrame:
    """All columns of the rows to keep: of each group the row with the smallest id, null ids last, the first in the table of equals.

    Rows are told apart by their place, not by id: copies without an id go, and
    of rows that repeat an id each is judged by its own text.  ``docs`` is
    scanned twice; what is not a scan of files is written to a table first.
    """
    docs = stable(docs, "neardup-docs")
    marked = _marked(docs, id_col, text_col, shingle)
    grouped = _grouped(marked, similarity, block_rows, broadcast_keys)
    kept = grouped.groupBy("root").agg(F.min("first").alias("first")).select("first.row", "first.sum")
    return keep_rows(docs, kept, text_col)
