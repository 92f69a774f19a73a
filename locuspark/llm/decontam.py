"""Benchmark decontamination with DataFrame functions alone.

A document is compared with an item through its windows of the item's number
of words.  Only windows that hold one of the item's shingles can be similar to
it, so a scan first marks the documents' shingles that occur in the benchmark.
The windows around these marks get SimHash fingerprints.  A multi-index of
Hamming blocks then finds every item of the window's size within the radius:
split into more blocks than a third of the radius, some block differs in two
bits at most.  Candidates are verified by exact weighted Jaccard similarity of their
shingles, counted with repeats.  A document with fewer shingles than an item is
one window itself; it is verified wherever it shares a shingle with the item.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locuspark.llm.common import let, materialise

SHINGLE = 5
SIMILARITY = 0.8
#: Bits in which fingerprints of similar windows may differ.  At similarity 0.8 the mean is 10 and the deviation 3.
RADIUS = 22
#: Blocks of a fingerprint; with two bits of slack each they cover a radius below three times their number.
BLOCKS = 8
SLACK = 2
#: Distinct shingles of a benchmark that are sent to all tasks, as literals of the plan; beyond it a join shuffles.
SENT_SHINGLES = 50_000


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; null and wordless texts have none."""
    cleaned = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(cleaned == "", F.array().cast("array<string>")).otherwise(F.split(cleaned, " "))


def shingles(w: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words of an array, in order; none if it is shorter."""
    parts = lambda i: F.xxhash64(*[w[(i + k).cast("int")] for k in range(size)])
    return F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(0), F.size(w) - size), parts)).otherwise(F.array().cast("array<bigint>"))


def _simhash(hashes: Column) -> Column:
    """Bits set in over half of an array of hashes."""
    bit = lambda b: F.aggregate(hashes, F.lit(0), lambda n, h: n + F.getbit(h, b).cast("int"))
    half = F.size(hashes)
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(63)),
        F.lit(0).cast("bigint"),
        lambda out, b: out.bitwiseOR(F.when(bit(b) * 2 > half, F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))),
    )


def _blocks(fp: Column) -> Column:
    """Number and bits of each block of a fingerprint."""
    width = 64 // BLOCKS
    bits = lambda i: F.call_function("shiftrightunsigned", fp, i * width).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda i: F.struct(i.alias("block"), bits(i).alias("bits")))


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Items with words: item_id, words, their number n, shingle size, shingle hashes, fingerprint."""
    base = benchmark.select(F.col(id_col).cast("long").alias("item_id"), words(F.col(text_col).cast("string")).alias("item_words"))
    base = base.where("item_id is not null and size(item_words) > 0").dropDuplicates(["item_id", "item_words"])
    base = base.withColumn("n", F.size("item_words")).withColumn("k", F.least(F.col("n"), F.lit(SHINGLE)))
    sized = F.lit(None).cast("array<bigint>")
    for k in range(1, SHINGLE + 1):
        sized = F.when(F.col("k") == k, shingles(F.col("item_words"), k)).otherwise(sized)
    return base.withColumn("item_hashes", sized).withColumn("item_fp", _simhash(F.col("item_hashes")))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
    sent_shingles: int = SENT_SHINGLES,
) -> DataFrame:
    """``doc_id``, ``item_id``, ``start``, ``n_words``, ``similarity``: each item that a document holds.

    ``start`` is the first word of the most similar window, the earliest of
    equals; ``n_words`` are its words, fewer than the item's only where the
    document has fewer.  Items of fewer than five words are one shingle, and so must occur
    whole.  Items without words or id find nothing; rows that repeat an id
    are searched each, and answered once an id; null ids are answered as null.
    """
    if radius >= (SLACK + 1) * BLOCKS:
        raise ValueError(f"blocks guarantee a radius below {(SLACK + 1) * BLOCKS}")
    items = materialise(_items(benchmark, item_col, item_text_col), "decontam-items")
    sizes = [r[0] for r in items.select("k").distinct().collect()]  # five values at most
    marks = items.select("k", F.explode("item_hashes").alias("hash")).distinct()
    marks = materialise(marks, "decontam-marks")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = None
    for k in sizes:
        mine = marks.where(F.col("k") == k).select("hash")
        held = _marked(source, mine, k, sent_shingles)
        part = _matches(held, items.where(F.col("k") == k), k, similarity, radius)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return source.limit(0).select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in (("item_id", "long"), ("start", "int"), ("n_words", "int"), ("similarity", "double"))])
    first = F.max_by(F.struct("start", "n_words", "similarity"), F.struct("similarity", F.negative(F.col("start"))))
    return found.groupBy("doc_id", "item_id").agg(first.alias("best")).select("doc_id", "item_id", "best.*")


def _marked(source: DataFrame, marks: DataFrame, k: int, sent_shingles: int) -> DataFrame:
    """Documents with a shingle in ``marks``: row, doc_id, the hashes of all shingles, and the marked positions."""
    n = marks.count()
    if not n:
        return source.limit(0).selectExpr("0L as row", "doc_id", "array(0L) as hashes", "array(0) as at")
    hashes = let(words(F.col("text")), lambda w: shingles(w, k))
    if n <= sent_shingles:
        values = [r[0] for r in marks.collect()]
        inside = lambda h: h.isin(values)
        # The filter decides on the scan's rows; the few that pass are hashed again.
        rows = source.where(F.exists(hashes, inside)).select("doc_id", hashes.alias("hashes"))
        rows = rows.withColumn("at", F.filter(F.transform("hashes", lambda h, i: F.when(inside(h), i)), lambda i: i.isNotNull()))
        rows = rows.withColumn("row", F.monotonically_increasing_id())
        return materialise(rows.select("row", "doc_id", "hashes", "at"), "decontam-rows")
    numbered = materialise(source.withColumn("row", F.monotonically_increasing_id()), "decontam-numbered")
    listed = numbered.select("row", F.posexplode(hashes).alias("i", "hash"))
    at = listed.join(marks, "hash").groupBy("row").agg(F.array_sort(F.collect_list("i")).alias("at"))
    rows = numbered.join(at, "row").select("row", "doc_id", hashes.alias("hashes"), "at")
    return materialise(rows, "decontam-rows")


def _matches(rows: DataFrame, items: DataFrame, k: int, similarity: float, radius: int) -> DataFrame:
    """Windows of ``rows`` that are similar to an item, verified."""
    by_hash = items.select("item_id", "n", F.explode("item_hashes").alias("hash")).distinct()
    # Windows of the size of an item that hold one of its shingles.
    mark = F.transform("at", lambda i: F.struct(i.alias("i"), F.col("hashes")[i].alias("hash")))
    hits = rows.select("row", F.size("hashes").alias("total"), F.explode(mark).alias("mark")).select("row", "total", "mark.*")
    m = F.col("n") - (k - 1)
    near = hits.join(by_hash.select("n", "hash").distinct(), "hash").withColumn("from", F.greatest(F.lit(0), F.col("i") - m + 1)).withColumn("to", F.least(F.col("i"), F.col("total") - m))
    starts = near.where(F.col("to") >= F.col("from")).select("row", "n", F.explode(F.sequence("from", "to")).alias("start")).distinct()
    windows = starts.join(rows.select("row", "doc_id", "hashes"), "row")
    windows = windows.select("row", "doc_id", "n", "start", F.slice("hashes", F.col("start") + 1, m).alias("window"))
    windows = materialise(windows.withColumn("fp", _simhash(F.col("window"))), "decontam-windows")
    # Multi-index: a key for each block and each way to change a few of its bits, on the items' side.
    slack = [sum(1 << b for b in bits) for size in range(SLACK + 1) for bits in combinations(range(64 // BLOCKS), size)]
    index = items.select("item_id", "n", "item_fp", F.explode(_blocks(F.col("item_fp"))).alias("key")).select("item_id", "n", "item_fp", "key.*")
    index = index.select("*", F.explode(F.array(*map(F.lit, slack))).alias("mask")).withColumn("bits", F.col("bits").bitwiseXOR(F.col("mask"))).drop("mask")
    probes = windows.select("n", "fp").distinct().select("n", "fp", F.explode(_blocks(F.col("fp"))).alias("key"))
    close = probes.select("n", "fp", "key.*").join(index, ["n", "block", "bits"])
    close = close.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).select("n", "fp", "item_id").distinct()
    pairs = windows.join(close, ["n", "fp"]).join(items.select("item_id", "n", "item_hashes"), ["item_id", "n"])
    score = _weighted_jaccard(F.col("window"), F.col("item_hashes"))
    pairs = pairs.withColumn("similarity", score).select("doc_id", "item_id", "start", F.col("n").alias("n_words"), "similarity")
    # Documents with fewer shingles than the item: whole, without fingerprints, as small sets have wide distances.
    short = hits.join(by_hash, "hash").where((F.col("total") < m) & (F.col("total") >= similarity * m - 1e-9)).select("row", "item_id", "n").distinct()
    short = short.join(rows.select("row", "doc_id", "hashes"), "row").join(items.select("item_id", "n", "item_hashes"), ["item_id", "n"])
    whole = short.withColumn("similarity", _weighted_jaccard(F.col("hashes"), F.col("item_hashes")))
    whole = whole.select("doc_id", "item_id", F.lit(0).alias("start"), (F.size("hashes") + (k - 1)).alias("n_words"), "similarity")
    return pairs.unionByName(whole).where(F.col("similarity") >= similarity - 1e-12).withColumn("similarity", F.round("similarity", 6))


def _weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of the smaller counts of each shingle over the sum of the larger; both arrays are not empty."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    shared = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))
    return shared / (F.size(a) + F.size(b) - shared)
