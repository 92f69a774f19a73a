"""SimHash near-duplicate detection over vantage-point shards.

Documents get a 64-bit SimHash.  A vantage-point tree, fitted on a bounded
sample, deals distinct fingerprints to shards by Hamming distance.  A
fingerprint also visits every later shard that the triangle bound does not
exclude, so each pair within the radius meets in one shard.  There a local
vantage-point recursion splits both sides into rings of equal distance and only
compares rings that the triangle bound leaves.  A shard answers with a spanning
star for each linked set, never with pairs; the stars are merged by distributed
star contraction.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuspark.llm.common import materialise
from locuspark.llm.components import connected_components

#: Fingerprints that the driver fits the tree on, whatever the size of the table.
SAMPLE = 4096
#: Distinct fingerprints that a shard should hold.
SHARD_ROWS = 1 << 16
#: Bound on the shards, and so on the tree that every task gets.
MAX_SHARDS = 4096
#: Comparisons that one task of a shard should make before pruning.
TASK_PAIRS = 1 << 33
#: Fingerprints of several rows or with links that are sent to all tasks (17 bytes each); beyond it each is joined in so many parts.
BROADCAST_CLASSES = 500_000
SALTS = 16
_SEED = 42
_BLOCK = 1 << 22
_UNSIGNED = np.uint64


def text_fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash of the word shingles of a text, repeats included.

    A-Z are lower-cased; words are runs without ASCII white space.  A text of
    fewer words than a shingle is one shingle; null and wordless texts give 0.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, _SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    last = len(words) - shingle + 1
    hashes = np.fromiter(
        [digest(joined[s:e], _SEED) for s, e in zip(starts[:last].tolist(), ends[shingle - 1 :].tolist())], _UNSIGNED, last
    )
    return _majority(hashes)


def _majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``id_col`` and ``fp``, the SimHash as a signed 64-bit number, for every row.

    Null ids and repeated rows stay; other columns are left out, whatever their names.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            fp = pa.array(np.array(found, _UNSIGNED).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], ["doc_id", "fp"])

    return source.mapInArrow(run, "doc_id long, fp long")


class VantageTree:
    """Binary vantage-point tree over 64-bit fingerprints; its leaves are shards."""

    def __init__(self, sample: np.ndarray, total: int, radius: int, shard_rows: int, max_shards: int) -> None:
        self.radius = radius
        self.vantage: list[int] = []
        self.bound: list[int] = []
        self.inside: list[int] = []
        self.outside: list[int] = []
        self.leaves = 0
        self._scale = total / max(1, len(sample))
        self._rows, self._max = shard_rows, max_shards
        self._rng = np.random.default_rng(_SEED)
        self.root = self._grow(sample, max_shards)

    def _grow(self, points: np.ndarray, budget: int) -> int:
        """A node's index, or -1 - shard for a leaf."""
        best = None
        if len(points) * self._scale > self._rows and budget > 1 and len(points) > 32:
            for vantage in self._rng.choice(points, min(8, len(points)), replace=False):
                d = np.bitwise_count(points ^ vantage)
                for bound in np.unique(np.quantile(d, [0.35, 0.5, 0.65]).astype(int)):
                    near = np.mean(d <= bound + self.radius) * np.mean(d <= bound)
                    far = np.mean(d > bound - self.radius) * np.mean(d > bound)
                    if 0 < np.mean(d <= bound) < 1 and (best is None or near + far < best[0]):
                        best = (near + far, vantage, int(bound), d)
        if best is None or best[0] > 0.97:
            self.leaves += 1
            return -self.leaves
        _, vantage, bound, d = best
        at = len(self.vantage)
        self.vantage.append(int(vantage))
        self.bound.append(bound)
        self.inside.append(0)
        self.outside.append(0)
        self.inside[at] = self._grow(points[d <= bound], budget // 2)
        self.outside[at] = self._grow(points[d > bound], budget - budget // 2)
        return at

    def route(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each shard: positions of the points that belong there, and of those that visit it.

        A point visits only shards after its own: of a pair in two shards, the
        earlier shard's point visits the later one.
        """
        at = np.arange(len(points))  # ``after``: the point's own shard comes before this subtree
        stack = [(self.root, at, np.ones(len(at), bool), np.zeros(len(at), bool))]
        while stack:
            node, at, home, after = stack.pop()
            if not len(at):
                continue
            if node < 0:
                yield -1 - node, at[home], at[~home]
                continue
            d = np.bitwise_count(points[at] ^ _UNSIGNED(self.vantage[node]))
            bound = self.bound[node]
            side = d <= bound
            # Leaves of the inside are numbered before those of the outside.
            near = (d <= bound + self.radius) & ((home & side) | after)
            far = (d > bound - self.radius) & (home | after)
            stack.append((self.inside[node], at[near], (home & side)[near], after[near]))
            stack.append((self.outside[node], at[far], (home & ~side)[far], (after | (home & side))[far]))


def _linked(home: np.ndarray, other: np.ndarray, radius: int, hit: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Call ``hit`` with positions in home and other of all pairs within the radius."""
    rng = np.random.default_rng(_SEED)
    stack = [(np.arange(len(home)), np.arange(len(other)), 0)]
    while stack:
        i, j, depth = stack.pop()
        if not len(i) or not len(j):
            continue
        if len(i) * len(j) <= 1 << 17 or depth > 12:
            step = max(1, _BLOCK // len(j))
            b = other[j]
            for k in range(0, len(i), step):
                near = np.bitwise_count(home[i[k : k + step], None] ^ b) <= radius
                x, y = np.nonzero(near)
                if len(x):
                    hit(i[k : k + step][x], j[y])
            continue
        vantage = home[i[rng.integers(len(i))]]
        di, dj = np.bitwise_count(home[i] ^ vantage), np.bitwise_count(other[j] ^ vantage)
        oi, oj = np.argsort(di, kind="stable"), np.argsort(dj, kind="stable")
        i, di, j, dj = i[oi], di[oi].astype(int), j[oj], dj[oj].astype(int)
        lo, hi = np.searchsorted(di, np.arange(66)), np.searchsorted(dj, np.arange(66))
        kept = 0
        rings = []
        for ring in range(65):
            part = i[lo[ring] : lo[ring + 1]]
            if len(part):
                near = j[hi[max(0, ring - radius)] : hi[min(65, ring + radius + 1)]]
                rings.append((part, near, depth + 1))
                kept += len(part) * len(near)
        if kept > 0.97 * len(i) * len(j):  # one tight group: no bound prunes it
            rings = [(i, j, 99)]
        stack.extend(rings)


class _Forest:
    """Union-find whose labels stay flat."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def union(self, x: np.ndarray, y: np.ndarray) -> None:
        while True:
            a, b = self.label[x], self.label[y]
            differ = a != b
            if not differ.any():
                return
            a, b = a[differ], b[differ]
            x, y = x[differ], y[differ]
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(self.label, high, low)
            while True:
                flat = self.label[self.label]
                if np.array_equal(flat, self.label):
                    break
                self.label = flat


def _shard_stars(home: np.ndarray, visitors: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Each linked fingerprint of a shard with one of its linked set."""
    points, inverse = np.unique(np.concatenate([home, visitors]), return_inverse=True)
    hi, vi = inverse[: len(home)], inverse[len(home) :]
    forest = _Forest(len(points))
    _linked(home, visitors, radius, lambda x, y: forest.union(hi[x], vi[y]))
    linked = forest.label != np.arange(len(points))
    return points[linked], points[forest.label[linked]]


def similar_fingerprints(
    fps: DataFrame,
    radius: int = 4,
    shard_rows: int = SHARD_ROWS,
    sample: int = SAMPLE,
    max_shards: int = MAX_SHARDS,
    task_pairs: int = TASK_PAIRS,
) -> DataFrame:
    """Stars ``src``, ``dst`` over distinct ``fp`` whose components are those of "within ``radius`` bits".

    Null fingerprints take no part.  ``sample`` bounds what the driver sees.
    """
    fps = fps.where(F.col("fp").isNotNull()).select("fp").distinct()
    total = fps.count()
    seen = [r[0] for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()]
    tree = VantageTree(np.array(seen, np.int64).view(_UNSIGNED), total, radius, shard_rows, max_shards)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.asarray(batch.column(0)).view(_UNSIGNED)
            parts = [
                (np.full(len(at), shard, np.int32), np.full(len(at), role, np.int8), points[at].view(np.int64))
                for shard, home, visit in tree.route(points)
                for role, at in ((0, home), (1, visit))
                if len(at)
            ]
            if parts:
                columns = [pa.array(np.concatenate(c)) for c in zip(*parts)]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "role", "fp"])

    dealt = fps.mapInArrow(deal, "shard int, role byte, fp long")
    # At most two rows a shard, and max_shards shards.
    sizes: dict[int, list[int]] = {}
    for shard, role, n in dealt.groupBy("shard", "role").count().collect():
        sizes.setdefault(shard, [0, 0])[role] = n
    # A shard with too much work is split by its visitors; its own fingerprints go to each part.
    parts = {s: max(1, -(-(h * (h + v)) // task_pairs)) for s, (h, v) in sizes.items() if h}
    many = F.create_map(*[F.lit(x) for kv in parts.items() if kv[1] > 1 for x in kv]) if any(n > 1 for n in parts.values()) else None
    n_parts = F.lit(1) if many is None else F.coalesce(many[F.col("shard")], F.lit(1))
    dealt = dealt.withColumn("n", n_parts).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    keyed = dealt.select("shard", "role", "fp", "own", F.explode(F.when(F.col("role") == 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array("own"))).alias("part"))
    # Own fingerprints compare with the shard's own once: where their part is the key's.
    keyed = keyed.withColumn("query", (F.col("part") == F.col("own")))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        fp = rows["fp"].to_numpy().view(_UNSIGNED)
        own = rows["role"].to_numpy() == 0
        src, dst = _shard_stars(fp[own], fp[rows["query"].to_numpy()], radius)
        return pd.DataFrame({"src": src.view(np.int64), "dst": dst.view(np.int64)})

    return keyed.select("shard", "part", "role", "fp", "query").groupBy("shard", "part").applyInPandas(compare, "src long, dst long")


def near_duplicate_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, broadcast_classes: int = BROADCAST_CLASSES, **shards: int
) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``: the smallest id that links reach from the row.

    Rows link where their fingerprints differ in ``radius`` bits or fewer.
    Null and empty texts have fingerprint 0 and link like others.  Repeated
    rows and null ids keep a row each; a class whose ids are all null has a
    null component.  An empty table gives no rows.
    """
    marked = materialise(fingerprints(docs, id_col, text_col, shingle), "simhash")
    classes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "simhash-classes")
    roots = connected_components(similar_fingerprints(classes, radius, **shards))
    linked = classes.join(roots, classes["fp"] == roots["node"]).select("fp", "root", "first_id")
    least = linked.union(
        classes.join(roots.select(F.col("root")).distinct(), classes["fp"] == F.col("root")).select("fp", "root", "first_id")
    )
    best = least.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = least.select("fp", "root").join(best, "root").select("fp", "component_id")
    # A fingerprint of one row without links needs no join; the others may be those of very many rows.
    named = classes.join(of, "fp", "left").withColumn("component_id", F.coalesce("component_id", "first_id"))
    named = materialise(named.where((F.col("n") > 1) | ~F.col("component_id").eqNullSafe(F.col("first_id"))).select("fp", "component_id"), "simhash-named")
    if named.count() <= broadcast_classes:
        joined = marked.join(F.broadcast(named.withColumn("found", F.lit(True))), "fp", "left")
    else:
        spread = marked.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        copies = named.withColumn("found", F.lit(True)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = spread.join(copies, ["fp", "salt"], "left")
    component = F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "fp", component.alias("component_id"))
