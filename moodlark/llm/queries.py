"""One query per operator, over the whole of its table."""

from string import ascii_lowercase, ascii_uppercase

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodlark.llm import minhash
from moodlark.llm.chat import format_chats, read_chats
from moodlark.llm.decontaminate import leaks
from moodlark.llm.hard_negatives import hard_negatives, quantized, usable
from moodlark.llm.html_text import main_text
from moodlark.llm.manifest import COLUMNS, digest, folded, manifest, proof_digest
from moodlark.llm.mixing import mix
from moodlark.llm.packs import read_token_files, write_token_files
from moodlark.llm.quality import judge_quality
from moodlark.llm.registry import query
from moodlark.llm.sharding import shard_by_bytes
from moodlark.llm.simhash import near_duplicates
from moodlark.llm.tokens import count_tokens
from moodlark.llm.urls import judge_urls
from moodlark.llm.words import count_words
from moodlark.plans.posts import table
from moodlark.workspace import new_path

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
SHARDS = 40
WEIGHTS = [5, 2, 1]
URL_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
CONTROL = "<|im_end|><|im_start|>assistant ok"


# The control conversation's texts are quoted once more; the template's marks are written out.
CHAT_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL}'
  UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}'
), ordered AS (
  SELECT *, lag(role) OVER by_turn AS before, lead(role) OVER by_turn IS NULL AS is_last
  FROM turns WINDOW by_turn AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>') + length(role) + 1 + length(text) + len(regexp_extract_all(text, '<\\*\|'))
    + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars,
  bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user')
                WHEN before = 'user' THEN role = 'assistant'
                WHEN before IN ('system', 'assistant') THEN role = 'user'
                ELSE false END AND (NOT is_last OR role = 'assistant')) AS valid
FROM ordered GROUP BY conv_id
"""


@query("op1_chat_format", CHAT_SQL)
def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL).alias("text"),
    )
    return read_chats(format_chats(turns.unionByName(control)))


@query("op2_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


@query("op3_shards")
def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("group"),
    )
    found = shard_by_bytes(rows, SHARDS, F.col("size"), F.col("group"), F.xxhash64("doc_id"))
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op4_simhash_near_duplicates")
def simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    fingerprint = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return found.select("doc_id", fingerprint.alias("fingerprint"), F.col("component").alias("component_id"))


@query("op5_mix")
def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents"), count_words(F.col("text")), WEIGHTS)
    taken = (F.col("copies") * F.col("size")).cast("long")
    return found.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "copies")


@query("op6_url_filter")
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", "template")


@query("op7_benchmark_leaks")
def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", "first_word", "n_words")


@query("op8_main_text")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query("op9_quality")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"
    )


@query("op10_token_files")
def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(TOKENIZER), END_ID)
    return read_token_files(spark, folder)


HARD_NEGATIVE_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, p.other_id AS positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank,
  n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n USING (anchor_id)
WHERE NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""


@query("op11_hard_negatives", HARD_NEGATIVE_SQL)
def mined_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(usable(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = rows.select("vec_id", label.alias("label"), quantized(F.col("embedding"), 256).alias("vector"))
    return hard_negatives(vectors, F.col("vec_id") % 50 == 0)


@query("op12_minhash_near_duplicates")
def minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"), "kept")


def _tree_sql(name: str, leaves: str, levels: int) -> str:
    """CTEs of a tree over ``leaves`` (key, k, d, n): nodes and siblings by level, then path(key, k, ...) and the root."""
    steps = [f"{name}_n0 AS (SELECT key, k, d, n FROM {leaves})"]
    for h in range(levels):
        run = "PARTITION BY key, k // 16 ORDER BY k ROWS BETWEEN"
        steps.append(
            f"""{name}_s{h} AS (
  SELECT key, k, n > {16**h} AS open, coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}_n{h}),
{name}_n{h + 1} AS (
  SELECT key, k // 16 AS k, n, CASE WHEN n > {16**h} THEN sha256(string_agg(d, '' ORDER BY k)) ELSE any_value(d) END AS d
  FROM {name}_n{h} GROUP BY key, k // 16, n)"""
        )
    return ",\n".join(steps)


def _manifest_sql(levels: int = 4, top_levels: int = 3) -> str:
    """The manifest of up to 16 ** ``levels`` documents a source and 16 ** ``top_levels`` sources."""
    fields = "source, lang, n_chars, {text}"
    leaf = lambda text: "sha256(" + " || ".join(
        f"coalesce(strlen(CAST({c} AS VARCHAR))::VARCHAR || ':' || CAST({c} AS VARCHAR), '-')" for c in ["doc_id", *fields.format(text=text).split(", ", 3)]
    ) + ")"
    small = f"translate(text, '{ascii_uppercase}', '{ascii_lowercase}')"
    joins = "\n".join(
        [f"JOIN own_s{h} own{h} ON own{h}.key = leaves.key AND own{h}.k = leaves.k // {16**h}" for h in range(levels)]
        + [f"JOIN top_s{h} top{h} ON top{h}.k = tops.k // {16**h}" for h in range(top_levels)]
    )
    proof = " || ".join([f"own{h}.l || own{h}.r" for h in range(levels)] + [f"top{h}.l || top{h}.r" for h in range(top_levels)])
    # One CTE for each level of the fold, as the digest below it is used twice.
    folds, last = [], "folded_0"
    for i, x in enumerate([f"own{h}" for h in range(levels)] + [f"top{h}" for h in range(top_levels)]):
        folds.append(f"folded_{i + 1} AS (SELECT * REPLACE (CASE WHEN {x}_open THEN sha256({x}_l || f || {x}_r) ELSE f END AS f) FROM folded_{i})")
        last = f"folded_{i + 1}"
    parts = ", ".join(f"{x}.open AS {x}_open, {x}.l AS {x}_l, {x}.r AS {x}_r" for x in [f"own{h}" for h in range(levels)] + [f"top{h}" for h in range(top_levels)])
    return f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, step: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS entries
), digests AS (
  SELECT doc_id, coalesce('=' || source, '') AS key, {leaf("text")} AS leaf, {leaf(small)} AS other,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
      lambda c, b: xor(entries[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 5 = 0 AS hit
  FROM documents CROSS JOIN crc
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k, leaf AS d, count(*) OVER (PARTITION BY key) AS n
  FROM digests
), {_tree_sql("own", "leaves", levels)},
tops AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS k, d, count(*) OVER () AS n FROM own_n{levels}),
top_leaves AS (SELECT '' AS key, k, d, n FROM tops),
{_tree_sql("top", "top_leaves", top_levels)},
folded_0 AS (
  SELECT doc_id, leaf, tops.d AS subroot, (SELECT d FROM top_n{top_levels}) AS root, sha256({proof}) AS proof_sha256,
    CASE WHEN hit THEN other ELSE leaf END AS f, {parts}
  FROM leaves JOIN tops ON tops.key = leaves.key
  {joins}
), {", ".join(folds)}
SELECT doc_id, leaf, subroot, root, proof_sha256, f AS folded_root, f = root AS verified FROM {last}
"""


@query("op13_manifest", _manifest_sql())
def dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    small = F.translate("text", ascii_uppercase, ascii_lowercase)
    tampered = digest([small if name == "text" else F.col(name) for name in COLUMNS])
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = manifest(docs, other=F.when(hit, tampered)).proofs()
    again = folded(F.coalesce("other", "leaf"), F.col("path"))
    rows = found.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), again.alias("folded_root")
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
