"""The registered queries over the training-data tables, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparrowsql.llm import bitpack, bpe, chat, decontam, exact_dedup, html_text, jaccard, quality, secret_scan, suffix_dedup
from sparrowsql.llm.common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.annotate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP3_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 8) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM b, unnest(range(1, len(w) - n + 2)) t(i)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM b), unnest(range(1, len(w) - n + 2)) t(i)),
h AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
names AS (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM names GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(s, sha256('')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


# The patterns of secret_scan in RE2: the match is group 1, the value group 2 or the match itself.
_KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 12),
    ("access", r"(AKIA[A-Z0-9]{14,})", 1, 18),
    ("hex", r"([0-9a-f]{16,})", 1, 16),
    ("bearer", r"(Bearer\x20+([A-Za-z0-9._~+/=-]+))", 2, 20),
    ("github", r"(gh[pousr]_[A-Za-z0-9]+)", 1, 40),
    ("slack", r"(xox[abprs]-[A-Za-z0-9-]+)", 1, 15),
    ("jwt", r"(eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)", 1, 30),
    ("pem", r"(-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----)", 1, 20),
]


def _kind_sql(rank: int, name: str, pattern: str, group: int, least: int) -> str:
    cut = "(?s)(?:.*?)" + pattern.replace("'", "''")
    return f"""SELECT doc_id, source, {rank} AS rank, '{name}' AS kind, {least} AS least, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS piece, unnest(m) AS found, unnest(v) AS value
FROM (SELECT doc_id, source, regexp_extract_all(t, '{cut}', 0) AS p, regexp_extract_all(t, '{cut}', 1) AS m, regexp_extract_all(t, '{cut}', {group}) AS v FROM d)"""


OP6_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_kind_sql(i, *k) for i, k in enumerate(_KINDS))}),
placed AS (SELECT *, CAST(sum(length(piece)) OVER (PARTITION BY doc_id, rank ORDER BY i) AS BIGINT) AS stop FROM f),
s AS (SELECT doc_id, source, rank, value, stop - length(found) AS start, kind || ':' || (stop - length(found)) || ':' || stop AS said FROM placed WHERE length(value) >= least),
o AS (SELECT value, count(DISTINCT coalesce(source, chr(1))) AS owners FROM s GROUP BY value),
e AS (SELECT s.*, owners, owners <= 1 AND len(list_distinct(string_split(value, ''))) >= 8 AND NOT regexp_matches(value, '(?i)example|sample|dummy|placeholder|changeme|xxxx|1234567') AS live FROM s JOIN o USING (value)),
g AS (SELECT doc_id, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS b, count(*) FILTER (rank = 2) AS c,
      string_agg(said, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(said, ',' ORDER BY start, rank) AS spans,
      count(*) FILTER (live) AS live, count(*) FILTER (owners > 1) AS shared FROM e GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(live, 0) AS n_live, coalesce(shared, 0) AS n_shared
FROM documents LEFT JOIN g USING (doc_id)
"""


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.select("conv_id", "turn", "role", "text").schema)
    messages = chat.from_turns(rows.select("conv_id", "turn", "role", "text").union(extra))
    return chat.digests(chat.format_conversations(messages))


OP4_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n'))
              + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 24) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), outputs=False)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


OP9_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
h AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 10 * c >= 8 * (nx.n + ny.n - c)),
l AS (SELECT x, y FROM h UNION ALL SELECT y, x FROM h),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
k AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT x AS doc_id, min(y) AS class_id, coalesce(any_value(k.n), 0) AS n_links FROM r LEFT JOIN k USING (x) GROUP BY x
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_exact_dedup": op1_exact_dedup,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_decontamination": op3_decontamination,
        "op4_chat_formatting": op4_chat_formatting,
        "op5_bpe": op5_bpe,
        "op6_secret_scan": op6_secret_scan,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_html_extraction": op8_html_extraction,
        "op9_ngram_jaccard": op9_ngram_jaccard,
        "op10_bit_packing": op10_bit_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": OP1_SQL,
        "op3_decontamination": OP3_SQL,
        "op4_chat_formatting": OP4_SQL,
        "op6_secret_scan": OP6_SQL,
        "op9_ngram_jaccard": OP9_SQL,
    }
