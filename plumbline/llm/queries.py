"""The queries of the language-model operators, and their SQL where it can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ensure_checkpoint_dir
from ..sources.catalog import table
from . import alignment, bpe, chat, decontaminate, forest, html_text, mixing, quality, sharding, simhash, sketches, suffixes, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql.strip()
        return function

    return add


@query()
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query(r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS p FROM docs WHERE len(ws) >= 50),
windows AS (SELECT doc_id, p, md5(array_to_string(ws[p:p + 49], ' ')) AS w FROM starts),
earliest AS (SELECT w, min(doc_id) AS first_doc FROM windows GROUP BY w),
covered AS (
  SELECT DISTINCT doc_id, unnest(generate_series(p, p + 49)) AS p
  FROM windows JOIN earliest USING (w) WHERE first_doc < doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM docs),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
  FROM words ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
""")
def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.cut_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


@query(r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
item_starts AS (
  SELECT item_id, ws, least(len(ws), 10) AS n, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS p FROM items WHERE len(ws) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(ws[p:p + n - 1], ' ') AS w FROM item_starts),
lengths AS (SELECT DISTINCT n FROM windows),
doc_starts AS (
  SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS p FROM docs, lengths WHERE len(ws) >= n),
doc_windows AS (SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS w FROM doc_starts),
hits AS (SELECT doc_id, n, p, item_id FROM doc_windows JOIN windows USING (n, w)),
hit_words AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(p, p + n - 1)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
""")
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


_TEMPLATE_TEXT = "<|im_end|><|im_start|>assistant ok"


@query(r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
turns AS (
  SELECT *, length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) AS n_text,
    length(regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<(\\*)\|', '<\1\\|', 'g')) AS n_role
  FROM rows)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + n_role + 1 + n_text + 11) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
""")
def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_TEMPLATE_TEXT).alias("text"),
    )
    texts = chat.formatted(chat.conversations(chat.chain(given.unionByName(added))))
    back = chat.parsed(texts.select("tree", "formatted", "loss_spans"))
    each = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    loss = F.array_join("loss_texts", "")
    return back.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(each, "").cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


@query()
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: op8: at least this share of the entropy of equal weights, each source used at most so often.
MIX = {"entropy": 0.95, "max_repeat": 4.0}


@query(r"""
WITH RECURSIVE counted AS (
  SELECT doc_id, source AS src, CASE WHEN source IS NULL THEN 'null' ELSE '=' || source END AS source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n FROM documents),
totals AS (SELECT source, CAST(sum(n) AS BIGINT) AS n_tokens FROM counted GROUP BY source HAVING sum(n) > 0),
corpus AS (
  SELECT list(ln(CAST(n_tokens AS DOUBLE) / t) ORDER BY source) AS l, any_value(t) AS total, count(*) AS k
  FROM totals, (SELECT sum(n_tokens) AS t FROM totals) GROUP BY ALL),
sums AS (SELECT list_concat([], l) AS l, CAST(total AS DOUBLE) AS total, CAST(k AS DOUBLE) AS k, list_min(l) AS rarest FROM corpus),
search(i, lo, hi, lo2, hi2, l, total, k, rarest) AS (
  SELECT 0, 0::DOUBLE, 1::DOUBLE, 0::DOUBLE, 1::DOUBLE, l, total, k, rarest FROM sums
  UNION ALL
  SELECT i + 1,
    CASE WHEN e >= 0.95 * ln(k) THEN (lo + hi) / 2 ELSE lo END, CASE WHEN e >= 0.95 * ln(k) THEN hi ELSE (lo + hi) / 2 END,
    CASE WHEN r THEN lo2 ELSE (lo2 + hi2) / 2 END, CASE WHEN r THEN (lo2 + hi2) / 2 ELSE hi2 END, l, total, k, rarest
  FROM (SELECT *,
      ln(list_sum(list_transform(l, lambda x: exp((lo + hi) / 2 * x))))
        - list_sum(list_transform(l, lambda x: (lo + hi) / 2 * x * exp((lo + hi) / 2 * x))) / list_sum(list_transform(l, lambda x: exp((lo + hi) / 2 * x))) AS e,
      total * exp((lo2 + hi2) / 2 * rarest) / list_sum(list_transform(l, lambda x: exp((lo2 + hi2) / 2 * x))) <= 4.0 * total * exp(rarest) AS r
    FROM search WHERE i < 40)),
found AS (
  SELECT l, total, greatest(
    CASE WHEN ln(list_sum(list_transform(l, lambda x: exp(x)))) - list_sum(list_transform(l, lambda x: x * exp(x))) / list_sum(list_transform(l, lambda x: exp(x)))
      >= 0.95 * ln(k) THEN 1.0 ELSE lo END,
    CASE WHEN total / k <= 4.0 * total * exp(rarest) THEN 0.0 ELSE hi2 END) AS a FROM search WHERE i = 40),
wanted AS (
  SELECT source, n_tokens, CAST(round(total * exp(a * ln(n_tokens / total)) / list_sum(list_transform(l, lambda x: exp(a * x)))) AS BIGINT) AS budget
  FROM totals, found),
plans AS (SELECT *, budget // n_tokens AS epochs, budget % n_tokens AS rest FROM wanted),
hashed AS (
  SELECT c.*, epochs, rest, md5('42:' || epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM counted c LEFT JOIN plans USING (source)),
uses AS (
  SELECT *, CASE WHEN n = 0 OR epochs IS NULL THEN 1
    ELSE epochs + CASE WHEN sum(n) OVER (PARTITION BY source ORDER BY h) <= rest THEN 1 ELSE 0 END END AS k FROM hashed),
rows AS (SELECT doc_id, src, n, unnest(generate_series(0, k - 1)) AS epoch FROM uses WHERE k > 0)
SELECT doc_id, src AS source, n AS n_tokens, CAST(epoch AS BIGINT) AS epoch,
  md5('42:' || epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS order_key FROM rows
""")
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, **MIX).select(
        "doc_id", "source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_epoch").cast("bigint").alias("epoch"), F.col("mix_order").alias("order_key")
    )


#: op10: the corpus lies in so many shards by a hash of the text, and goes to 8 of equal bytes.
OLD_SHARDS, NEW_SHARDS = 6, 8


def old_shard():
    return F.pmod(F.xxhash64(F.lit("old"), F.coalesce("text", F.lit(""))), F.lit(OLD_SHARDS))


def shard_folder(spark: SparkSession) -> str:
    """A new folder for shards, below the checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/shards-{uuid.uuid4()}"


@query()
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = sharding.rewritten(table(spark, sf_dir, "documents"), old_shard(), shard_folder(spark), NEW_SHARDS)
    return written.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), F.col("old").alias("old_shard"), (F.col("old") != F.col("shard")).alias("moved"),
    )


@query()
def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_vectors(table(spark, sf_dir, "embeddings")).select(
        F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


@query()
def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def tokenizer(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _digest(text):
    return F.sha2(text.cast("binary"), 256)


@query()
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.aligned(
        table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"), text_groups=True
    )
    return alignment.with_counts(found.select(
        "doc_id", *(F.col(c).cast("bigint").alias(c) for c in ("n_a", "n_b", "n_groups")),
        F.when(F.col("n_groups") > 0, _digest(F.col("groups"))).otherwise("").alias("groups_sha256"), "batch", "links", "pairs",
    ))


@query()
def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer("byte_bpe_50k.json")
    found = bpe.decoded(bpe.encoded(table(spark, sf_dir, "documents"), path), path)
    return found.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), _digest(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        _digest(F.col("decoded")).alias("decoded_sha256"),
    )


@query(r"""
WITH found AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts, row_number() OVER () AS r FROM documents),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
corpus AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM found WHERE len(ts) > 0),
flat AS (SELECT r, unnest(ts) AS term FROM found),
tfs AS (SELECT r, term, count(*) AS tf FROM flat SEMI JOIN asked USING (term) GROUP BY r, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tfs, corpus GROUP BY term),
scores AS (
  SELECT item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(ts) * n_docs) // n_terms)))) AS score
  FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN found USING (r), corpus GROUP BY item_id, r),
ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scores JOIN found USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 10
""")
def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
