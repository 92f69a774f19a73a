"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuspark.llm import decontam, quality, rlz, secrets, simhash, spm, topk, toxicity, training_order, warc
from locuspark.llm.common import bound_arrow_batches, table

Query = Callable[[SparkSession, str], DataFrame]

#: Vocabulary file of the token queries; its path is a parameter of the operators.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Ids of a training sequence.
SEQUENCE = 256
#: Share of the documents that importance resampling draws.
SAMPLED_FRACTION = 0.5


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document; see ``simhash.near_duplicate_classes``."""
    bound_arrow_batches(spark)
    classes = simhash.near_duplicate_classes(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold; see ``decontam.contaminated``."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels that are not held out; see ``toxicity``."""
    bound_arrow_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    models = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, models)
    held_out = (toxicity.fold(F.col("doc_id")) == 0).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document's ids, and whether they decode to its text; see ``spm``."""
    bound_arrow_batches(spark)
    model = spm.read_model(PIECE_MODEL)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = spm.decode(spm.encode(docs, model, packed=True), model)
    return rows.select(
        "doc_id",
        (F.coalesce(F.octet_length("ids"), F.lit(0)) / 4).cast("long").alias("n_tokens"),
        F.sha2(F.coalesce("ids", F.lit(b"")), 256).alias("ids_sha256"),
        F.col("text").eqNullSafe(F.col("decoded")).alias("round_trip"),
    )


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages say of each; see ``warc.archive_and_read``."""
    bound_arrow_batches(spark)
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the shards of all documents' ids hold, read in slot order; see ``training_order``."""
    bound_arrow_batches(spark)
    ranks = training_order.read_ranks(BYTE_RANKS)
    tokens = training_order.tokenise(table(spark, sf_dir, "documents"), ranks)
    rows = training_order.materialise_order(tokens, SEQUENCE, key="epoch-0", end_id=training_order.vocabulary_size(ranks))
    return rows.select("slot", "doc_id", "part", "n_ids", F.sha2("ids", 256).alias("ids_sha256"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; see ``secrets.scan``."""
    bound_arrow_batches(spark)
    return secrets.span_digest(secrets.scan(table(spark, sf_dir, "documents")))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 20-word passages that occur earlier; see ``rlz.deduplicate``."""
    bound_arrow_batches(spark)
    kept = rlz.deduplicate(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query vector's five best; see ``topk.search_ids``."""
    bound_arrow_batches(spark)
    return topk.search_ids(table(spark, sf_dir, "embeddings"))


def op10_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weight of every document, and the sample drawn by them; see ``quality``."""
    bound_arrow_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ratio = quality.fit(docs, table(spark, sf_dir, "labels"))
    weighted = quality.log_weights(docs, ratio).drop("text")
    return quality.gumbel_top_k(weighted, SAMPLED_FRACTION)


SQL = {
    "op2_benchmark_decontamination": r"""
        with b as (
            select item_id, words, len(words) as n, least(len(words), 5) as k from (
                select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as words from benchmark)
            where item_id is not null and len(words) > 0),
        d as (
            select row_number() over () as rid, doc_id,
                   list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as words from documents),
        item_grams as (
            select item_id, n, k, array_to_string(words[p : p + k - 1], ' ') as gram from (select *, unnest(range(1, n - k + 2)) as p from b)),
        doc_grams as (
            select rid, doc_id, total, k, p, array_to_string(words[p : p + k - 1], ' ') as gram
            from (select rid, doc_id, words, len(words) as total, k, unnest(range(1, len(words) - k + 2)) as p from d, (select distinct k from b))),
        hits as (
            select rid, doc_id, total, item_id, n, k, p, gram from doc_grams join (select distinct item_id, n, k, gram from item_grams) using (k, gram)),
        starts as (
            select distinct rid, doc_id, item_id, n, k, s from (
                select *, unnest(range(greatest(1, p - (n - k)), p + 1)) as s from hits) where s + n - 1 <= total),
        held as (
            select a.rid, a.doc_id, a.item_id, a.n, a.k, a.s, h.gram, count(*) as c
            from starts a join hits h on h.rid = a.rid and h.item_id = a.item_id and h.p between a.s and a.s + a.n - a.k group by all),
        scored as (
            select rid, doc_id, held.item_id, n, s, sum(least(held.c, i.c)) as shared, n - k + 1 as m
            from held join (select item_id, gram, count(*) as c from item_grams group by all) i on i.item_id = held.item_id and i.gram = held.gram group by all),
        whole as (
            select rid, doc_id, c.item_id, total, sum(least(c.c, i.c)) as shared, total - c.k + 1 as size, c.n - c.k + 1 as m
            from (select rid, doc_id, total, item_id, n, k, gram, count(*) as c from hits where total < n group by all) c
            join (select item_id, gram, count(*) as c from item_grams group by all) i on i.item_id = c.item_id and i.gram = c.gram group by all),
        alike as (
            select doc_id, item_id, s - 1 as start, n as n_words, round(shared / (2 * m - shared), 6) as similarity
            from scored where shared / (2 * m - shared) >= 0.8 - 1e-12
            union all
            select doc_id, item_id, 0, total, round(shared / (size + m - shared), 6)
            from whole where shared / (size + m - shared) >= 0.8 - 1e-12)
        select doc_id, item_id, cast(start as integer) as start, cast(n_words as integer) as n_words, similarity from (
            select *, row_number() over (partition by doc_id, item_id order by similarity desc, start) as r from alike) where r = 1""",
    "op8_substring_dedup": r"""
        with d as (
            select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
        windows as (
            select doc_id, s, array_to_string(words[s : s + 19], ' ') as gram from (select doc_id, words, unnest(range(1, len(words) - 18)) as s from d)),
        again as (
            select doc_id, s from (select doc_id, s, row_number() over (partition by gram order by doc_id, s) as r from windows) where r > 1),
        covered as (select distinct doc_id, unnest(range(s, s + 20)) as i from again),
        placed as (select doc_id, i, words[i] as word from (select doc_id, words, unnest(range(1, len(words) + 1)) as i from d)),
        kept as (
            select doc_id, string_agg(word, ' ' order by i) as kept, count(*) as n
            from placed anti join covered using (doc_id, i) group by doc_id)
        select d.doc_id, cast(len(words) as bigint) as n_words, cast(len(words) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
        from d left join kept using (doc_id)""",
    "op5_warc_revisits": """
        with payloads as (
            select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest
            from pages),
        known as (
            select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest) else page_id end as original
            from payloads)
        select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
               case when page_id = original then 'response' else 'revisit' end as record_type,
               case when page_id = original then null else original end as refers_to
        from known""",
    "op9_topk_search": """
        with points as (
            select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q
            from embeddings
            where vec_id is not null and embedding is not null
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        scored as (
            select a.rid, a.vec_id as query_id, b.vec_id, cast(list_inner_product(a.q, b.q) as bigint) as score
            from points a join points b on a.vec_id % 50 = 0 and a.rid <> b.rid),
        ranked as (
            select *, row_number() over (partition by rid order by score desc, vec_id) as rank from scored)
        select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 5""",
}


def queries() -> dict[str, Query]:
    return {name: value for name, value in globals().items() if name.startswith("op") and name[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
