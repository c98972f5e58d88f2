"""The registered queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfield.llm import bpe, byte_cnn, decontaminate, kdtree, longest_match, middle, phrases, pii, pivots, repair, secret_tags, simhash, toxicity
from lumenfield.llm.tables import read
from lumenfield.plans.scratch import new_path


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_kdtree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.shards(read(spark, sf_dir, "documents"), 16)


def op4_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    repair.write(read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return repair.read(spark, path)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_cnn.identify(read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_pivot_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(read(spark, sf_dir, "embeddings"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longest_match.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, with the item that they hold most of."""
    found = decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.filter("contaminated").select(
        "doc_id", "contaminated", found["contaminating_item"].alias("item_id"), found["contamination"].alias("score")
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = middle.transform(read(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    back = middle.restored(F.col("form"), F.col("output"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256")
    )


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


def op13_secret_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return secret_tags.find(docs, secret_tags.fit(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_kdtree_shards": op3_kdtree_shards,
    "op4_repair_token_files": op4_repair_token_files,
    "op5_language_id": op5_language_id,
    "op6_toxicity": op6_toxicity,
    "op7_pivot_near_duplicates": op7_pivot_near_duplicates,
    "op8_token_counts": op8_token_counts,
    "op9_simhash": op9_simhash,
    "op10_decontamination": op10_decontamination,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_phrase_mining": op12_phrase_mining,
    "op13_secret_tags": op13_secret_tags,
}

_MIDDLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w
  FROM documents),
c AS (
  SELECT *, len(w) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(w) + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (len(w) + 1) AS c2,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (
  SELECT *, array_to_string(w[1:least(c1, c2)], '') AS a, array_to_string(w[least(c1, c2) + 1:greatest(c1, c2)], '') AS b,
         array_to_string(w[greatest(c1, c2) + 1:], '') AS z
  FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

_PHRASES_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
places AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 6) AS ks(k)),
f AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM places GROUP BY ALL HAVING count(*) >= 100),
free AS (
  SELECT * FROM f AS p WHERE k >= 2 AND NOT EXISTS (
    SELECT 1 FROM f AS q WHERE q.lang = p.lang AND q.k > p.k AND contains(' ' || q.phrase || ' ', ' ' || p.phrase || ' ') AND 100 * q.f >= 100 * p.f)),
cuts AS (SELECT *, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS c FROM free),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.f AS a, l.f AS l, r.f AS r, n.n, c, (1000::HUGEINT * cuts.f * n.n) // (l.f::HUGEINT * r.f) AS score
  FROM cuts JOIN n USING (lang)
  JOIN f AS l ON l.lang = cuts.lang AND l.phrase = array_to_string(ws[1:c], ' ')
  JOIN f AS r ON r.lang = cuts.lang AND r.phrase = array_to_string(ws[c + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM best QUALIFY rank <= 2000
"""

#: The queries that SQL can express. The other methods (models, library encodings, sketches, alignments) cannot be put in SQL.
ORACLE_SQL: dict[str, str] = {"op11_fill_in_middle": _MIDDLE_SQL, "op12_phrase_mining": _PHRASES_SQL}
