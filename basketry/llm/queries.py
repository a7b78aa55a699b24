"""The queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_documents, token_digests
from .chat_format import conversations, format_preferences, with_other_ending
from .decontaminate import decontaminate
from .exact_dedup import exact_dedup
from .html_text import extract
from .language_id import identify
from .ngram_join import near_duplicates
from .pii import find_spans, span_digests
from .substring_dedup import substring_dedup
from .token_counts import token_counts

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_preferences(with_other_ending(conversations(_read(spark, sf_dir, "conversations"))))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated", F.size("near").cast("long").alias("n_near"),
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_read(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_read(spark, sf_dir, "pages"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def _ranks() -> tuple[str, str]:
    """The rank file and the pattern of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(encode_documents(_read(spark, sf_dir, "documents"), *_ranks()))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(find_spans(_read(spark, sf_dir, "documents")))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_read(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # 50256 is the id that the rank file leaves free
    return token_counts(_read(spark, sf_dir, "documents"), *_ranks(), eod=50256)


QUERIES: dict[str, Query] = {
    "op1_chat_format": op1_chat_format,
    "op2_decontaminate": op2_decontaminate,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_language_id": op4_language_id,
    "op5_html_text": op5_html_text,
    "op6_ngram_join": op6_ngram_join,
    "op7_bpe": op7_bpe,
    "op8_pii": op8_pii,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_token_counts": op10_token_counts,
}

ORACLES: dict[str, str] = {
    "op1_chat_format": """
WITH c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn, role, text) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
p AS (SELECT c.conv_id AS pair_id, c.t AS c, list_concat(list_slice(c.t, 1, c.conv_id % len(c.t)), coalesce(list_slice(o.t, c.conv_id % len(c.t) + 1, len(o.t)), [])) AS r
      FROM c LEFT JOIN c o ON o.conv_id = xor(c.conv_id, 1)),
n AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: c[i].role IS DISTINCT FROM r[i].role OR c[i].text IS DISTINCT FROM r[i].text)) - 1,
                         least(len(c), len(r))) AS n FROM p),
s AS (SELECT pair_id, n, list_slice(c, 1, n) AS p, list_slice(c, n + 1, len(c)) AS c, list_slice(r, n + 1, len(r)) AS r FROM n)
SELECT pair_id, n AS n_prefix,
  coalesce(array_to_string(list_transform(p, lambda t: '<|im_start|>' || coalesce(t.role, 'unknown') || chr(10) || coalesce(t.text, '') || '<|im_end|>' || chr(10)), ''), '') AS prompt,
  coalesce(array_to_string(list_transform(c, lambda t: '<|im_start|>' || coalesce(t.role, 'unknown') || chr(10) || coalesce(t.text, '') || '<|im_end|>' || chr(10)), ''), '') AS chosen,
  coalesce(array_to_string(list_transform(c, lambda t: CASE WHEN coalesce(t.role, 'unknown') = 'assistant' THEN '0:22,1:' || (length(coalesce(t.text, '')) + 11)
     ELSE '0:' || (13 + length(coalesce(t.role, 'unknown')) + length(coalesce(t.text, '')) + 11) END), ','), '') AS chosen_mask,
  coalesce(array_to_string(list_transform(r, lambda t: '<|im_start|>' || coalesce(t.role, 'unknown') || chr(10) || coalesce(t.text, '') || '<|im_end|>' || chr(10)), ''), '') AS rejected,
  coalesce(array_to_string(list_transform(r, lambda t: CASE WHEN coalesce(t.role, 'unknown') = 'assistant' THEN '0:22,1:' || (length(coalesce(t.text, '')) + 11)
     ELSE '0:' || (13 + length(coalesce(t.role, 'unknown')) + length(coalesce(t.text, '')) + 11) END), ','), '') AS rejected_mask
FROM s
""",
    "op2_decontaminate": r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + 12), ' ') AS p
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 11, 2))) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
starts AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS p
           FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM starts JOIN win USING (n, p)),
cov AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY 1),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS s FROM hit GROUP BY 1),
wt AS (SELECT DISTINCT p, unnest(string_split(p, ' ')) AS t FROM win),
dt AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS at FROM dw WHERE len(w) > 0),
dfs AS (SELECT t, count(DISTINCT doc_id) AS df FROM dt SEMI JOIN wt USING (t) GROUP BY t),
known AS (SELECT p FROM wt LEFT JOIN dfs USING (t) GROUP BY p HAVING count(df) = count(*)),
rk AS (SELECT p, t, row_number() OVER (PARTITION BY p ORDER BY df, t) AS r FROM wt JOIN dfs USING (t) SEMI JOIN known USING (p)),
two AS (SELECT DISTINCT a.t AS rare, b.t AS other FROM rk a LEFT JOIN rk b ON b.p = a.p AND b.r = 2 WHERE a.r = 1),
near AS (SELECT DISTINCT x.doc_id, x.at FROM two JOIN dt x ON x.t = rare WHERE other IS NULL UNION
         SELECT DISTINCT x.doc_id, x.at FROM two JOIN dt x ON x.t = rare JOIN dt y ON y.doc_id = x.doc_id AND y.t = other WHERE abs(x.at - y.at) < 16),
nn AS (SELECT doc_id, count(*) AS n_near FROM near GROUP BY 1)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN nn USING (doc_id)
""",
    "op3_substring_dedup": r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM dw WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS m FROM s GROUP BY h),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM s JOIN f USING (h) WHERE m < doc_id),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM dw WHERE len(w) > 0),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS t FROM each ANTI JOIN cov USING (doc_id, k) GROUP BY doc_id),
gone AS (SELECT doc_id, count(*) AS n FROM cov GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM dw LEFT JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)
""",
    "op6_ngram_join": r"""
WITH RECURSIVE dw AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM dw WHERE len(w) > 0)),
sets AS (SELECT doc_id, md5(string_agg(g, '|' ORDER BY g)) AS s, count(*) AS n FROM sh GROUP BY 1),
reps AS (SELECT s, min(doc_id) AS rep, any_value(n) AS n, count(*) AS n_copies FROM sets GROUP BY 1),
rs AS (SELECT rep, g FROM sh JOIN reps ON rep = doc_id),
pairs AS (SELECT a.rep AS a, b.rep AS b, count(*) AS x FROM rs a JOIN rs b ON a.g = b.g AND a.rep < b.rep GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN reps p ON p.rep = a JOIN reps q ON q.rep = b WHERE 5 * x >= 4 * (p.n + q.n - x)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT rep, rep FROM reps UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
cls AS (SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY 1),
deg AS (SELECT a AS rep, count(*) AS n_links FROM edges GROUP BY 1)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(n_links, 0) AS n_links, coalesce(n_copies, 1) AS n_copies
FROM documents d LEFT JOIN sets USING (doc_id) LEFT JOIN reps USING (s) LEFT JOIN cls USING (rep) LEFT JOIN deg USING (rep)
""",
    "op9_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
""",
}
