"""Registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basinflow.llm import ann, collocations, decontam, langid, lm, minhash, packing, quality, sharding, substrings, toxicity, warc, whitening
from basinflow.llm.sampling import fold, held_out
from basinflow.sources.shared import few_files, materialise, small_arrow_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, to be read by Python tasks in batches of bounded bytes."""
    small_arrow_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0))
    scored = toxicity.score(docs, toxicity.train_on_labels(docs, learned), toxicity.CATEGORIES)
    return scored.withColumn("held_out", held_out("doc_id", 5, 0))


def op2_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = langid.train(docs.where(~held_out("doc_id", 5, 0) & F.col("doc_id").isNotNull()))
    return langid.score(docs, trees).withColumn("held_out", held_out("doc_id", 5, 0)).select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")


def op3_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(table(spark, sf_dir, "documents"), fold("doc_id", 7) != 2)
    return scored.select("doc_id", held_out("doc_id", 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op5_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialise(quality.document_statistics(table(spark, sf_dir, "documents")), "statistics")
    learned = table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0))
    model = quality.train(stats, learned.select(F.col("doc_id").alias("doc"), F.col("quality").alias("label")))
    return quality.score(stats, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op6_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return few_files(minhash.near_duplicate_groups(table(spark, sf_dir, "documents")))


def op8_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sharding.assign_shards(docs, "doc_id", ["source", "lang", "size", "doc_id"], shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def digest_pieces(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_pieces(packing.pack(table(spark, sf_dir, "documents")))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = warc.archive_folder(pages)
    index = warc.write_archives(pages, folder)
    return warc.read_archives(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_residue_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components_of(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity_chain": op1_toxicity_chain,
    "op2_ppm_language": op2_ppm_language,
    "op3_backoff_automaton": op3_backoff_automaton,
    "op4_hnsw": op4_hnsw,
    "op5_quality_discriminant": op5_quality_discriminant,
    "op6_bm25_decontamination": op6_bm25_decontamination,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_hilbert_sharding": op8_hilbert_sharding,
    "op9_lexical_packing": op9_lexical_packing,
    "op10_warc": op10_warc,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_collocations": op12_collocations,
    "op13_residue_whitening": op13_residue_whitening,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
#: crc32 of an id as text: each byte goes through eight steps of the shift register.
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c // 256, "
    "list_reduce(list_prepend(xor(c % 256, b), range(8)), lambda x, y: xor(x // 2, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END)))), 4294967295)"
)

SQL: dict[str, str] = {
    "op3_backoff_automaton": rf"""
        WITH d AS MATERIALIZED (
            SELECT row_number() OVER () AS r, doc_id, {_CRC} % 7 = 2 AS held_out, list_concat([NULL], {_WORDS}, [NULL]) AS ws FROM documents),
        t AS MATERIALIZED (
            SELECT r, held_out, k, coalesce(ws[k], chr(0)) AS w, CASE WHEN k > 1 THEN coalesce(ws[k - 1], chr(0)) END AS v, CASE WHEN k > 2 THEN coalesce(ws[k - 2], chr(0)) END AS u
            FROM (SELECT r, held_out, ws, unnest(range(2, len(ws) + 1)) AS k FROM d)),
        c1 AS MATERIALIZED (SELECT w, count(*) AS n FROM t WHERE NOT held_out GROUP BY w),
        c2 AS MATERIALIZED (SELECT v, w, count(*) AS n FROM t WHERE NOT held_out GROUP BY v, w),
        c3 AS MATERIALIZED (SELECT u, v, w, count(*) AS n FROM t WHERE NOT held_out AND u IS NOT NULL GROUP BY u, v, w),
        s AS (SELECT sum(n)::BIGINT AS total, count(*) AS types FROM c1),
        p AS (
            SELECT t.r, a.n AS n1, total, (coalesce(a.n, 0) + 1.0::DOUBLE) / (total + types + 1) AS p1,
                   coalesce(b.n, 0) AS n2, coalesce(x.n, 0) AS m2, coalesce(c.n, 0) AS n3, coalesce(y.n, 0) AS m3
            FROM t CROSS JOIN s LEFT JOIN c1 a ON a.w = t.w LEFT JOIN c1 x ON x.w = t.v LEFT JOIN c2 b ON b.v = t.v AND b.w = t.w
            LEFT JOIN c2 y ON y.v = t.u AND y.w = t.v LEFT JOIN c3 c ON c.u = t.u AND c.v = t.v AND c.w = t.w),
        q AS (SELECT *, CASE WHEN m2 > 0 THEN (n2 + 2.0::DOUBLE * pow(m2, 0.85) * p1) / (m2 + 2.0::DOUBLE * pow(m2, 0.85)) ELSE p1 END AS p2 FROM p)
        SELECT any_value(d.doc_id) AS doc_id, any_value(d.held_out) AS held_out, count(*)::BIGINT AS n_tokens, count(n1)::BIGINT AS n_known, any_value(total)::BIGINT AS train_tokens,
               sum(log10(p1)) AS base_score, sum(log10(CASE WHEN m3 > 0 THEN (n3 + 2.0::DOUBLE * pow(m3, 0.85) * p2) / (m3 + 2.0::DOUBLE * pow(m3, 0.85)) ELSE p2 END)) AS score
        FROM q JOIN d ON d.r = q.r GROUP BY d.r
    """,
    "op4_hnsw": """
        WITH e AS MATERIALIZED (
            SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        n AS (
            SELECT q.vec_id AS query_id, e.vec_id, sqrt(list_sum(list_transform(list_zip(q.v, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score
            FROM e AS q JOIN e ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id AND len(e.v) = len(q.v)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank FROM n)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op7_minhash_near_dedup": r"""
        WITH RECURSIVE w AS MATERIALIZED (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS MATERIALIZED (
            SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k + 4], ' '))
                WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
        u AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
        links AS MATERIALIZED (
            SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
        reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
        least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
        SELECT doc_id, len(sh)::BIGINT AS n_shingles, least(doc_id, coalesce(least.b, doc_id)) AS component_id, least(doc_id, coalesce(least.b, doc_id)) = doc_id AS kept
        FROM s LEFT JOIN least ON least.a = s.doc_id
    """,
    "op10_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT page_id, payload_bytes, p.payload_digest,
               CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to
        FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
    """,
    "op11_substring_dedup": r"""
        WITH d AS MATERIALIZED (
            SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        w AS MATERIALIZED (SELECT r, doc_id, k, array_to_string(ws[k:k + 12], ' ') AS x FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 11)) AS k FROM d)),
        f AS (SELECT x, min(doc_id) AS first FROM w GROUP BY x),
        gone AS MATERIALIZED (SELECT DISTINCT r, k + unnest(range(13)) AS k FROM w JOIN f USING (x) WHERE first < doc_id),
        kept AS (
            SELECT t.r, list(t.w ORDER BY t.k) AS ws FROM (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS k FROM d) t
            ANTI JOIN gone ON gone.r = t.r AND gone.k = t.k GROUP BY t.r)
        SELECT doc_id, len(d.ws)::BIGINT AS n_words, (len(d.ws) - coalesce(len(kept.ws), 0))::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept.ws, ' '), '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (r)
    """,
    "op12_collocations": rf"""
        WITH p AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        q AS MATERIALIZED (SELECT row_number() OVER () AS r, lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
        g AS (SELECT lang, m, ws[k:k + m - 1] AS w FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS k FROM q, (SELECT unnest([1, 2, 3, 4]) AS m))),
        c AS MATERIALIZED (SELECT lang, m, w, count(*) AS f FROM g GROUP BY lang, m, w),
        cut AS (SELECT c.lang, c.w, c.f AS a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.f // (x.f + y.f))::BIGINT AS score
            FROM (SELECT *, unnest(range(1, m)) AS k FROM c WHERE m > 1 AND f >= 30) c JOIN c x ON x.lang = c.lang AND x.w = c.w[1:k] JOIN c y ON y.lang = c.lang AND y.w = c.w[k + 1:]),
        s AS (SELECT lang, w, any_value(a) AS a, arg_min({{'l': l, 'r': r, 'score': score}}, (score, k)) AS best FROM cut GROUP BY lang, w),
        longer AS (SELECT lang, w[b:e] AS w, max(f) AS f FROM (SELECT lang, w, f, b, unnest(range(b + 1, m + 1)) AS e FROM (SELECT *, unnest(range(1, m)) AS b FROM c WHERE m > 2 AND f >= 30)) WHERE e - b + 1 < len(w[1:4]) GROUP BY 1, 2),
        n AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE m = 1 GROUP BY lang),
        o AS (SELECT s.lang, array_to_string(s.w, ' ') AS phrase, a, best.l AS l, best.r AS r, n, best.score AS score FROM s JOIN n ON n.lang = s.lang LEFT JOIN longer x ON x.lang = s.lang AND x.w = s.w WHERE coalesce(100 * x.f < 80 * a, true))
        SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o) WHERE rank <= 2000
    """,
}
