"""Registered queries of the subpackage and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from . import (brown, chat_format, decontaminate, encode, exact_dedup, fill_in_middle, hard_negatives, near_dedup, packing, quality,
               substring_dedup, token_files, toxicity, unigram)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op5_exact_dedup", f"""
WITH t AS (SELECT doc_id, {LOWERED} AS body FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM t""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; the row with the largest doc_id stays."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op6_chat_format", r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, n, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, r)),
e AS (SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS body,
             replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') AS head FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, body)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|im_start|>' || head || chr(10) || body || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, then read back from the formatted text and its loss spans."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(chat_format.control_conversation(spark)).withColumn("parts", chat_format.text_parts(F.col("text")))
    back = chat_format.read_back(chat_format.format_conversations(rows))
    said = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select("conv_id", F.size("messages").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@query("op8_decontamination", f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '{WORD}') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWERED}, '{WORD}') AS ws FROM benchmark),
bw AS (SELECT item_id, least(13, len(ws)) AS size, ws, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, size, array_to_string(ws[i:i + size - 1], ' ') AS body FROM bw),
sizes AS (SELECT DISTINCT size FROM win),
dp AS (SELECT doc_id, size, ws, unnest(range(1, len(ws) - size + 2)) AS i FROM d, sizes WHERE len(ws) >= size),
m AS (SELECT dp.doc_id, dp.i, dp.size, win.item_id FROM (SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS body FROM dp) dp
      JOIN win USING (size, body)),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS w FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in every document."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op9_token_files")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as bit-plane token files and read back."""
    docs = table(spark, sf_dir, "documents")
    return token_files.read_tokens(spark, token_files.write_tokens(spark, docs, encode.tokenizer_path("word_bpe_49k.json")))


@query("op3_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2048 tokens."""
    packed = packing.pack(spark, table(spark, sf_dir, "documents"), encode.tokenizer_path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op10_near_dedup", f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + least(5, len(ws)) - 1], ' ') AS sh
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT u, v FROM common JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(v) AS component_id, d.doc_id = min(v) AS kept
FROM d JOIN reach ON u = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""".replace("\\\\x", "\\x"))
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_dedup.near_duplicates(spark, table(spark, sf_dir, "documents"))


@query("op1_quality")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(spark, docs, table(spark, sf_dir, "labels")))


@query("op4_lm_score")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-based log probabilities of every document."""
    return brown.score(spark, table(spark, sf_dir, "documents"))


@query("op2_substring_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte strings of 400 bytes that occur again, removed from every document."""
    found = substring_dedup.repeated_spans(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@query("op7_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of every document."""
    scores = unigram.pieces(encode.tokenizer_path("piece_bpe_32k.model"))
    return unigram.token_counts(table(spark, sf_dir, "documents"), scores)


@query("op11_fill_in_middle", r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS body, sha256('42:' || CAST(doc_id AS VARCHAR)) AS h,
                  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
g AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
             CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                  WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM g),
s AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(body) AS restored_sha256
FROM s""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents rewritten for filling in the middle, and restored from outputs and forms."""
    back = fill_in_middle.restore(fill_in_middle.transform(table(spark, sf_dir, "documents")))
    digests = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


@query("op12_hard_negatives", """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_dot_product(a.q, v.q) AS BIGINT) AS score
      FROM v a JOIN v ON a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the anchors among all embeddings."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(spark, rows.withColumn("label", moved), F.col("id") % 100 == 0)


@query("op13_toxicity")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(spark, docs, table(spark, sf_dir, "labels")))
