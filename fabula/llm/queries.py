"""One query per operator over its whole table, and the corpus pipeline; SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, html_text, langid, line_dedup, media, merkle, near_dup, pii, ppm, quality, toxicity, vector_codes
from .common import crc_fold

#: A document is toxic from this score on.
TOXIC = 0.7


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: its main text."""
    return html_text.main_text(_table(spark, sf_dir, "pages"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and benchmark item that it holds, as it is or with other numbers and names."""
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: count and hash of its token ids, and the hash of what they decode to."""
    import public_tokenizers

    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: log10 probabilities by word counts and by partial matching, learnt outside the held-out fold."""
    return ppm.score(_table(spark, sf_dir, "documents"), crc_fold(F.col("doc_id"), 7) == 2)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many of them were dropped, and the text of the rest."""
    out = line_dedup.deduplicate(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), "text")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the toxicity score of a model of the labels outside the held-out fold."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = crc_fold(F.col("doc_id"), 3) == 1
    scores = toxicity.score(docs, toxicity.train(docs, labels, ~held_out))
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the language by a model of the documents outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents")
    held_out = crc_fold(F.col("doc_id"), 4) == 2
    found = langid.predict(docs, langid.train(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=80)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its personal data, by fixed rules and by the span classifier."""
    return pii.digests(pii.find(_table(spark, sf_dir, "documents")))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its text as a film, and what reading the film back gives."""
    return media.digests(media.encode(_table(spark, sf_dir, "documents")))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its counts, whether it fails the limits, and whether it is kept among its language and source."""
    out = quality.assess(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its leaf, its proof's hash, and the root that its proof gives once some counts of characters are one higher."""
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.when(crc_fold(F.col("doc_id"), 7) == 0, F.col("n_chars").cast("decimal(20,0)") + 1)
    now = merkle.digest(*(merkle.field(tampered if c == "n_chars" else F.col(c)) for c in fields))
    docs = _table(spark, sf_dir, "documents")
    out = merkle.manifest(docs, [F.col(c) for c in fields], F.col("lang"), F.col("doc_id"), {"now": F.when(tampered.isNotNull(), now)})
    hexed = [merkle.as_hex(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")]
    folded = merkle.folded(F.coalesce("now", "leaf"), F.col("proof")).alias("folded_root")
    out = out.select(F.col("order").alias("doc_id"), *hexed, merkle.proof_digest(F.col("proof")).alias("proof_sha256"), folded)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector: its parts' nearest entries in codebooks of two rounds, and their squared distances."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")
    return vector_codes.digests(*vector_codes.encode(rows))


#: All distances to all entries, three times over; parts of four components.
OP13_SQL = r"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS FIRST, embedding) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(NOT isfinite(x), true))) = 0),
parts AS MATERIALIZED (SELECT r, p, q[4 * p + 1] AS a, q[4 * p + 2] AS b, q[4 * p + 3] AS c, q[4 * p + 4] AS d FROM kept, range(16) x(p)),
book0 AS (SELECT p, r AS e, a, b, c, d FROM parts WHERE r < 64),
code0 AS MATERIALIZED (SELECT x.r, x.p, min({'s': (x.a - y.a) ** 2 + (x.b - y.b) ** 2 + (x.c - y.c) ** 2 + (x.d - y.d) ** 2, 'e': y.e}) AS n FROM parts x JOIN book0 y USING (p) GROUP BY ALL),
mean1 AS (SELECT p, n.e AS e, floor(sum(a) / count(*)) AS a, floor(sum(b) / count(*)) AS b, floor(sum(c) / count(*)) AS c, floor(sum(d) / count(*)) AS d FROM code0 JOIN parts USING (r, p) GROUP BY ALL),
book1 AS MATERIALIZED (SELECT p, e, coalesce(y.a, x.a) AS a, coalesce(y.b, x.b) AS b, coalesce(y.c, x.c) AS c, coalesce(y.d, x.d) AS d FROM book0 x LEFT JOIN mean1 y USING (p, e)),
code1 AS MATERIALIZED (SELECT x.r, x.p, min({'s': (x.a - y.a) ** 2 + (x.b - y.b) ** 2 + (x.c - y.c) ** 2 + (x.d - y.d) ** 2, 'e': y.e}) AS n FROM parts x JOIN book1 y USING (p) GROUP BY ALL),
mean2 AS (SELECT p, n.e AS e, floor(sum(a) / count(*)) AS a, floor(sum(b) / count(*)) AS b, floor(sum(c) / count(*)) AS c, floor(sum(d) / count(*)) AS d FROM code1 JOIN parts USING (r, p) GROUP BY ALL),
book2 AS MATERIALIZED (SELECT p, e, coalesce(y.a, x.a) AS a, coalesce(y.b, x.b) AS b, coalesce(y.c, x.c) AS c, coalesce(y.d, x.d) AS d FROM book1 x LEFT JOIN mean2 y USING (p, e)),
code2 AS MATERIALIZED (SELECT x.r, x.p, min({'s': (x.a - y.a) ** 2 + (x.b - y.b) ** 2 + (x.c - y.c) ** 2 + (x.d - y.d) ** 2, 'e': y.e}) AS n FROM parts x JOIN book2 y USING (p) GROUP BY ALL),
coded AS (SELECT r, lower(string_agg(printf('%02x', n.e), '' ORDER BY p)) AS code, sum(n.s)::BIGINT AS error FROM code2 GROUP BY r),
digest AS (SELECT sha256(string_agg(concat_ws(',', a::BIGINT, b::BIGINT, c::BIGINT, d::BIGINT), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (r) CROSS JOIN digest
"""


#: Levels from the leaves up, each leaf's siblings level by level, and the fold of its proof.
OP12_SQL = r"""
WITH RECURSIVE base AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, source, lang, n_chars, text) AS r, doc_id, lang, n_chars,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: ascii(c)::BIGINT)), lambda h, b:
      list_reduce([xor(h, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, lang, r, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) AS other, xor(crc, 4294967295::BIGINT) % 7 = 0 AS tampered FROM base),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS t FROM leaves),
nodes AS (
  SELECT t, 0 AS k, p, leaf AS h, count(*) OVER (PARTITION BY t) AS n FROM placed
  UNION ALL
  SELECT t, any_value(k) + 1, p // 2, sha256(string_agg(h, '' ORDER BY p)), (any_value(n) + 1) // 2 FROM nodes WHERE n > 1 GROUP BY t, p // 2),
subroots AS (SELECT t, k AS depth, h AS subroot FROM nodes WHERE n = 1),
upper_nodes AS (
  SELECT 0 AS k, t AS p, subroot AS h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT any_value(k) + 1, p // 2, sha256(string_agg(h, '' ORDER BY p)), (any_value(n) + 1) // 2 FROM upper_nodes WHERE n > 1 GROUP BY p // 2),
top AS (SELECT k AS height, h AS root FROM upper_nodes WHERE n = 1),
steps AS (
  SELECT r, k, l.p // (2 ** k)::BIGINT AS here, t FROM placed l JOIN subroots s USING (t), range(0, s.depth) x(k)),
proof AS (
  SELECT s.r, s.k, s.here, b.h AS sibling FROM steps s LEFT JOIN nodes b ON b.t = s.t AND b.k = s.k AND b.p = xor(s.here, 1)
  UNION ALL
  SELECT l.r, s.depth + x.k, l.t // (2 ** x.k)::BIGINT, b.h FROM placed l JOIN subroots s USING (t), top, range(0, top.height) x(k) LEFT JOIN upper_nodes b ON b.k = x.k AND b.p = xor(l.t // (2 ** x.k)::BIGINT, 1)),
proofs AS (SELECT r, sha256(coalesce(string_agg(coalesce(sibling, ''), '' ORDER BY k), '')) AS proof_sha256, count(*) AS size FROM proof GROUP BY r),
folded AS (
  SELECT r, 0 AS k, CASE WHEN tampered THEN other ELSE leaf END AS h FROM placed
  UNION ALL
  SELECT f.r, f.k + 1, sha256(CASE WHEN p.here % 2 = 1 THEN p.sibling || f.h ELSE f.h || coalesce(p.sibling, '') END) FROM folded f JOIN proof p ON p.r = f.r AND p.k = f.k)
SELECT l.doc_id, l.leaf, s.subroot, top.root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = top.root AS verified
FROM placed l JOIN subroots s USING (t) CROSS JOIN top LEFT JOIN proofs p USING (r) JOIN folded f ON f.r = l.r AND f.k = coalesce(p.size, 0)
"""


#: Shingle sets, all pairs that share a shingle, and the reachable minimum.
OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM sets),
items AS (SELECT doc_id, unnest(s) AS x FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS hits FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * hits >= 80 * (x.n + y.n - hits)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, l.b FROM reach JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON reach.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN least USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_text": op1_html_text,
        "op2_decontamination": op2_decontamination,
        "op3_bpe": op3_bpe,
        "op4_lm_score": op4_lm_score,
        "op5_line_dedup": op5_line_dedup,
        "op6_toxicity": op6_toxicity,
        "op7_language_id": op7_language_id,
        "op8_minhash_near_dedup": op8_minhash_near_dedup,
        "op9_pii": op9_pii,
        "op10_media": op10_media,
        "op11_quality": op11_quality,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_vector_codes": op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_minhash_near_dedup": OP8_SQL, "op12_merkle_manifest": OP12_SQL, "op13_vector_codes": OP13_SQL}
