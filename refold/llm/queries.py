"""One query for each corpus operator, over its whole table with production parameters, and the SQL
that checks those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, common, decontamination, licenses, packing, pii, quality_rules, simhash, token_files, token_rollups, warc


#: Files of public tokenizers by version; operators take their paths as parameters.
WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(_table(spark, sf_dir, "conversations"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(_table(spark, sf_dir, "documents"))
    bits = F.col("fail_bits")
    return rows.select(
        *("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"),
        (~quality_rules.passes(bits, "base-1")).alias("base_failed"),
        quality_rules.passes(bits).alias("kept"),
        "fail_bits",
    )


def op5_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches, each delivered twice: all documents under two tokenizer versions, a revision
    that adds the end token to each count of the first version, and the second version's retirement
    and return in one batch. The totals are those of the documents as they then stand."""
    docs = _table(spark, sf_dir, "documents")
    first = common.settle(token_rollups.counted(docs, {v: tokenizer_path(v) for v in (WORD_BPE, BYTE_BPE)}), "counts")
    book = token_rollups.Rollups(spark, common.scratch(spark, "rollups"))
    words, pieces = (first.where(F.col("tokenizer") == v) for v in (WORD_BPE, BYTE_BPE))
    revised = words.select(*token_rollups.KEYS, F.col("tokens").alias("tokens_before"), (F.col("tokens") + 1).alias("tokens_after"))
    again = token_rollups.deletes(pieces).unionByName(token_rollups.inserts(pieces.withColumn("tokenizer", F.concat("tokenizer", F.lit("+end"))).withColumn("tokens", F.col("tokens") + 1)))
    for batch, changes in (("load", token_rollups.inserts(first)), ("revise", revised), ("retire", again)):
        for _ in range(2):
            book.commit(batch, changes)
    return book.totals()


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.passages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch(spark, "tokens")
    files = token_files.write(_table(spark, sf_dir, "documents"), path, tokenizer_path(BYTE_BPE))
    return token_files.read_documents(spark, path, files)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch(spark, "warc")
    files = warc.write(_table(spark, sf_dir, "pages"), path)
    return warc.records(spark, path, files).drop("file", "offset")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.cluster(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


#: Counted with plain aggregates over unnested words, windows and lines.
_OP4 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '[ \t-\r]+'), lambda x: x <> '') AS ws FROM d),
tri AS (SELECT r, i, [ws[i], ws[i + 1], ws[i + 2]] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM tri) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY r),
ln AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS l FROM d),
m AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(array_to_string(ws, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
    length(regexp_replace(array_to_string(ws, ''), '[^\p{Lu}]', '', 'g')) AS n_upper,
    length(regexp_replace(array_to_string(ws, ''), '\p{L}', '', 'g')) AS n_nonletters
  FROM d JOIN w USING (r) JOIN ln USING (r) LEFT JOIN cov USING (r)),
b AS (SELECT *,
    (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
   + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
   + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END
   + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 8 ELSE 0 END
   + CASE WHEN 10 * n_dup_lines > 7 * n_lines THEN 16 ELSE 0 END
   + CASE WHEN 10 * n_upper > 6 * word_chars THEN 32 ELSE 0 END
   + CASE WHEN 10 * n_nonletters > 6 * word_chars THEN 64 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""

_OP2 = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '{chat.UNNAMED}') AS role, coalesce(text, '') AS text, md5(coalesce(text, '')) AS tie FROM conversations),
o AS (SELECT *, row_number() OVER w AS place, (coalesce(sum(length(role) + length(text) + 32) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {chat.SIZE})::BIGINT AS part
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, tie)),
p AS (SELECT DISTINCT conv_id, role AS participant FROM t WHERE role NOT IN ('system')),
later AS (SELECT DISTINCT conv_id, part FROM o WHERE part > 0),
s AS (SELECT conv_id, part, place, role, text FROM o UNION ALL
  SELECT o.conv_id, later.part, place, role, text FROM o JOIN later ON o.conv_id IS NOT DISTINCT FROM later.conv_id WHERE o.part = 0 AND role IN ('system')),
x AS (
  SELECT s.conv_id, part, participant, role = participant AS own, row_number() OVER (PARTITION BY s.conv_id, part, participant ORDER BY place) AS k,
    CASE WHEN role = participant THEN '<|im_start|>assistant' WHEN role IN ('system') THEN '<|im_start|>system'
      ELSE '<|im_start|>user name=' || replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<|', '<\|') END || chr(10) AS head,
    regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') || '<|im_end|>' || chr(10) AS body
  FROM s JOIN p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
y AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, part, participant ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM x)
SELECT conv_id, part, participant, count(*)::BIGINT AS n_turns, string_agg(head || body, '' ORDER BY k) AS text,
  coalesce(string_agg((pos + length(head))::VARCHAR || ':' || (pos + length(head) + length(body) - 1)::VARCHAR, ',' ORDER BY k) FILTER (own), '') AS loss_spans
FROM y GROUP BY conv_id, part, participant
"""

#: The same archive facts from digests alone.
_OP8 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, upper(sha1(html)) AS h, max(page_id) OVER (PARTITION BY sha1(html)) AS canon FROM p),
b AS (SELECT *, unhex(h) AS raw FROM g),
d AS (SELECT *, (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ('0x' || substr(h, 10 * k + 1, 10))::BIGINT // (32 ** (7 - j))::BIGINT % 32 + 1, 1), '' ORDER BY k, j)
  FROM range(4) a(k), range(8) c(j)) AS payload_digest FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = canon THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> canon THEN canon END AS refers_to FROM d
"""

QUERIES = {f.__name__: f for f in (op1_pii, op2_chat, op3_packing, op4_quality_rules, op5_token_rollups, op6_decontamination, op7_token_files, op8_warc, op9_simhash, op10_licenses)}
ORACLES = {"op2_chat": _OP2, "op8_warc": _OP8, "op4_quality_rules": _OP4}
