"""Queries opN_<name> over the driver's tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toxicity
from .chat import render
from .egojoin import self_join
from .license import license_scan
from .lines import line_dedup
from .media import media_columns
from .minhash import near_duplicates
from .mixing import mix
from .packing import pack
from .periodic import digests, periodic_runs, with_planted_periods
from .substring import substring_dedup
from .trie import prefix_trie, with_shared_openings
from .viterbi import token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies; the operators take paths and know no names."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return self_join(_table(spark, sf_dir, "embeddings"), least=0.93)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean, cut = substring_dedup(_table(spark, sf_dir, "documents"))
    clean = clean.withColumn("n_removed", F.lit(0).cast("long"))
    cols = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    return clean.select(cols).unionByName(cut.select(cols))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(_table(spark, sf_dir, "conversations"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", "held_out", "score", "predicted")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(_table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(_table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(_table(spark, sf_dir, "conversations"), with_shared_openings)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(periodic_runs(_table(spark, sf_dir, "documents"), with_planted_periods))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_near_dedup": op1_embedding_near_dedup,
        "op2_token_counts": op2_token_counts,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_chat_formatting": op4_chat_formatting,
        "op5_toxicity": op5_toxicity,
        "op6_packing": op6_packing,
        "op7_license_scan": op7_license_scan,
        "op8_media_columns": op8_media_columns,
        "op9_source_mixing": op9_source_mixing,
        "op10_minhash": op10_minhash,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_line_dedup": op12_line_dedup,
        "op13_periodic_runs": op13_periodic_runs,
    }


_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_OP3 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
),
least_doc AS (SELECT h, min(doc_id) AS lo FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p
  FROM win JOIN least_doc USING (h) WHERE doc_id > lo
),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
  FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_OP10 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
),
sh AS (
  SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i, i + 4), ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
),
link AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * common >= 85 * (x.n + y.n - common)
),
reach(node, other) AS (
  SELECT doc_id, doc_id FROM d
  UNION
  SELECT r.node, l.b FROM reach r JOIN link l ON l.a = r.other
),
comp AS (SELECT node, min(other) AS c FROM reach GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c AS component_id, d.doc_id = c AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN comp ON comp.node = d.doc_id
"""


_OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL
    AND list_aggregate(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)), 'bool_and')
),
u AS (SELECT * FROM v WHERE list_dot_product(e, e) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93
),
reach(node, other) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.node, l.b FROM reach r JOIN link l ON l.a = r.other
),
comp AS (SELECT node, min(other) AS c FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, c AS component_id, vec_id = c AS kept
FROM embeddings JOIN comp ON node = vec_id LEFT JOIN n ON n.a = vec_id
"""

_OP4 = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
line AS (
  SELECT conv_id, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
         string_agg(concat('<|im_start|>', role, chr(10), text, '<|im_end|>', chr(10)), '') OVER w AS chat,
         string_agg(concat(md5(role), md5(text)), '') OVER w AS id
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT min(conv_id) AS conv_id, n AS n_turns, chat
FROM line WHERE pos = n AND id NOT IN (SELECT id FROM line WHERE pos < n)
GROUP BY id, n, chat
"""


# The checksum of a decimal number, bit by bit: a byte is mixed in, then eight steps of the polynomial follow.
_CRC = """list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
    lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda x, o: CASE WHEN o >= 0 THEN xor(x, o) WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)"""

_OP11 = rf"""
WITH RECURSIVE t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
         md5(coalesce(role, '')) || md5(coalesce(text, '')) AS id,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
),
c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor({_CRC}, 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)
),
lent AS (SELECT c.*, least(h, coalesce(b.n, 0)) AS m FROM c LEFT JOIN (SELECT conv_id, count(*) AS n FROM t GROUP BY 1) b ON b.conv_id = base),
r AS (
  SELECT lent.conv_id, pos AS depth, id, words FROM lent JOIN t ON t.conv_id = base AND pos <= m
  UNION ALL
  SELECT conv_id, m + pos - h, id, words FROM t JOIN lent USING (conv_id) WHERE pos > h
),
size AS (SELECT c.conv_id, count(depth) AS n FROM c LEFT JOIN r USING (conv_id) GROUP BY 1),
pre AS (
  SELECT conv_id, depth, words, string_agg(id, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS id FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM c
),
node AS (SELECT id, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved FROM pre GROUP BY id, depth),
kid AS (SELECT left(id, 64 * (depth - 1)) AS id, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
sub AS (
  SELECT a.id, count(*) FILTER (k.n IS NULL) AS leaves, sum(x.saved) AS saved
  FROM node x JOIN pre a ON a.conv_id = x.conv_id AND a.depth <= x.depth LEFT JOIN kid k ON k.id = x.id GROUP BY a.id
),
fin AS (
  SELECT id, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS sha
  FROM pre JOIN size USING (conv_id) WHERE depth = n GROUP BY id
)
SELECT x.conv_id, CAST(x.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, x.n_convs,
       CAST(coalesce(k.n, 0) AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
       CAST(sub.saved AS BIGINT) AS saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
FROM node x JOIN sub USING (id) LEFT JOIN node p ON x.depth > 0 AND p.id = left(x.id, 64 * (x.depth - 1))
LEFT JOIN kid k ON k.id = x.id LEFT JOIN fin ON fin.id = x.id
"""

_OP12 = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
line AS (SELECT rid, doc_id, i, l[i] AS line FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM d)),
k AS (
  SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM line
),
f AS (
  SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 AND doc_id IS NOT NULL
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
),
m AS (SELECT k.*, coalesce(doc_id <> top, false) AS dropped FROM k LEFT JOIN f USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY rid
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_embedding_near_dedup": _OP1,
        "op3_substring_dedup": _OP3,
        "op4_chat_formatting": _OP4,
        "op10_minhash": _OP10,
        "op11_prefix_trie": _OP11,
        "op12_line_dedup": _OP12,
    }
