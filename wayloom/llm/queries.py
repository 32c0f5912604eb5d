"""The registered queries of this subpackage, one for each operator, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid
from .bpe import bpe_decode, bpe_encode
from .common import read
from .cws import edited_likeness
from .decontam import contamination, is_contaminated
from .html import extract_text
from .license import license_scan
from .linededup import dedup_lines
from .minhash import minhash_groups
from .simhash import near_duplicates
from .spelling import spelling_variants
from .suffixes import remove_repeats
from .tokencount import token_counts
from .trie import prefix_trie


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs.where(~langid.held_out("doc_id"))))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    decoded = bpe_decode(bpe_encode(read(spark, sf_dir, "documents"), ranks), ranks)
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' texts without repeated lines."""
    return dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes kept are given as text too, in which a character cut in two shows as the replacement character."""
    found = remove_repeats(read(spark, sf_dir, "documents"))
    text = F.make_valid_utf8(F.col("kept").cast("string")).alias("text")
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), text)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(read(spark, sf_dir, "documents"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_groups(read(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read(spark, sf_dir, "documents"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_langid": op2_langid,
    "op3_bpe": op3_bpe,
    "op4_token_counts": op4_token_counts,
    "op5_license": op5_license,
    "op6_decontamination": op6_decontamination,
    "op7_html": op7_html,
    "op8_lines": op8_lines,
    "op9_repeats": op9_repeats,
    "op10_fingerprints": op10_fingerprints,
    "op11_minhash": op11_minhash,
    "op12_spelling": op12_spelling,
    "op13_trie": op13_trie,
}


def crc_step(c: int) -> int:
    """What four bits c add to a CRC-32."""
    for _ in range(4):
        c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
    return c


#: The CRC-32 of a text s, by half bytes, the low one first.
CRC = f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(hex(encode(s)))), lambda i: (strpos('0123456789ABCDEF', hex(encode(s))[xor(i, 1) + 1]) - 1)::BIGINT)),
        lambda a, b: xor(a >> 4, ({[crc_step(c) for c in range(16)]}::BIGINT[])[(xor(a, b) & 15) + 1])), 4294967295)"""

ORACLE_SQL: dict[str, str] = {
    "op6_decontamination": r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), i AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), g AS (
    SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS gram
    FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)
), h AS (
    SELECT doc_id, s, n, item_id
    FROM (
        SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS gram
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)
    ) JOIN g USING (n, gram)
), k AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id
), t AS (
    SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM h) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)
""",
    "op11_minhash": r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS gram
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s AS x JOIN s AS y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(root) AS component_id, d.doc_id = min(root) AS kept
FROM d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id, n
""",
    "op12_spelling": f"""
WITH RECURSIVE t AS (
    SELECT doc_id, run, count(*) AS k, concat(doc_id::VARCHAR, ':', run) AS s
    FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
    WHERE length(run) >= 6 GROUP BY ALL
), h AS (SELECT run, k, {CRC} AS h FROM t),
w AS (
    SELECT word, sum(k)::BIGINT AS n
    FROM (SELECT k, CASE WHEN h % 199 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word FROM h)
    WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5
), g AS (SELECT word, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
d AS (SELECT g.word AS x, w.word AS y FROM g JOIN w ON w.word = g.a || g.b),
p AS (
    SELECT x.word AS word, y.word AS near FROM g AS x JOIN g AS y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
    UNION SELECT x, y FROM d UNION SELECT y, x FROM d
), q AS (SELECT p.word, near, w.n AS near_n, row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, near) AS at, count(*) OVER (PARTITION BY p.word) AS n_near FROM p JOIN w ON w.word = near),
f AS (
    SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
    FROM w LEFT JOIN q ON q.word = w.word AND q.at = 1
), r AS (SELECT word, word AS at FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.at AND f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, r.at AS root FROM f JOIN r ON r.word = f.word JOIN f AS last ON last.word = r.at AND last.form IS NULL
""",
    "op13_trie": r"""
WITH t AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS at
    FROM conversations WHERE conv_id IS NOT NULL
), c AS (
    SELECT conv_id, conv_id - conv_id % 100 AS head,
           xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(8 * strlen(s)), lambda i: ((ascii(s[(i // 8 + 1)::INT]) >> (i % 8)::INT) & 1)::BIGINT)),
               lambda a, b: xor(a >> 1, CASE WHEN (xor(a, b) & 1) = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % 6 AS h
    FROM (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM t)
), k AS (SELECT c.conv_id, c.h, count(t.at) AS n FROM c LEFT JOIN t ON t.conv_id = c.head AND t.at <= c.h GROUP BY ALL),
r AS (
    SELECT c.conv_id, t.at AS depth, t.role, t.text FROM c JOIN t ON t.conv_id = c.head AND t.at <= c.h
    UNION ALL SELECT k.conv_id, k.n + t.at - k.h, t.role, t.text FROM k JOIN t ON t.conv_id = k.conv_id AND t.at > k.h
), p AS (
    SELECT conv_id, depth, list({'role': role, 'text': text}) OVER (PARTITION BY conv_id ORDER BY depth) AS path, length(text) AS size,
           depth = max(depth) OVER (PARTITION BY conv_id) AS last
    FROM r
    UNION ALL SELECT conv_id, 0, [], 0, NOT EXISTS (SELECT 1 FROM r WHERE r.conv_id = c.conv_id) FROM c
), n AS (
    SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(size) AS saved,
           sha256(coalesce(string_agg(CASE WHEN last THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
    FROM p GROUP BY path, depth
), e AS (SELECT a.path, a.depth, a.conv_id, a.n_convs, a.saved, a.ends_sha256, b.conv_id AS parent_conv_id, (SELECT count(*) FROM n AS x WHERE x.depth = a.depth + 1 AND x.path[:a.depth] = a.path) AS n_children
    FROM n AS a LEFT JOIN n AS b ON a.depth > 0 AND b.path = a.path[:a.depth - 1]
), s AS (SELECT path, saved, n_children, unnest(range(depth + 1)) AS d FROM e)
SELECT e.conv_id, e.depth, e.parent_conv_id, e.n_convs, e.n_children, count(*) FILTER (s.n_children = 0) AS n_leaves, sum(s.saved)::BIGINT AS saved_tokens, e.ends_sha256
FROM e JOIN s ON s.d = e.depth AND s.path[:s.d] = e.path
GROUP BY e.path, e.conv_id, e.depth, e.parent_conv_id, e.n_convs, e.n_children, e.ends_sha256
""",
}
