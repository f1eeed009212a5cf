"""The registered queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import chunk_dedup, decontaminate, langid, line_dedup, near_dup, packing, quality_gam, quality_rules, toxicity, url_filter
from strandloom.llm.common import crc_mod


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), "toxic", crc_mod("doc_id", 5) != 0)
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(read(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_frequent_words")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = packing.pack(read(spark, sf_dir, "documents"), tokenizer_path(), {"ids_crc32": F.crc32("ids")})
    return made.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), short=True)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.passages(read(spark, sf_dir, "documents")).select("doc_id", "first", "last", "n_chunks", F.size("lost").cast("long").alias("n_lost"), "keeper")


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality_gam.fit(docs, read(spark, sf_dir, "labels"), "quality", crc_mod("doc_id", 5) != 0)
    return quality_gam.score(docs.select("doc_id", "text"), model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(docs, crc_mod("doc_id", 4) != 2)
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_near_duplicates, op3_quality_rules, op4_packing, op5_decontamination, op6_substring_dedup, op7_quality_model, op8_language_id, op9_line_dedup, op10_url_filter)
} | {"pipeline": _pipeline}

_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

SQL = {
    "op9_line_dedup": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, i, line, translate(trim(line, {_SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)),
f AS (SELECT key, max(doc_id) AS last_doc FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.doc_id, l.i, l.line, f.key IS NOT NULL AND l.doc_id < f.last_doc AS dropped FROM l LEFT JOIN f ON l.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (dropped))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op3_quality_rules": f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, source, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM d),
l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
solid AS (SELECT *, len(list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS n,
                 translate(regexp_replace(trim(line, {_SPACE}), '[0-9]+', '0', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
          FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dup AS (SELECT doc_id, sum(c - 1) AS n_dup_lines FROM (SELECT doc_id, line, count(*) AS c FROM solid GROUP BY doc_id, line) GROUP BY doc_id),
win AS (SELECT doc_id, p, array_to_string(ws[p:p + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS p FROM w WHERE len(ws) >= 8)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest(range(p, p + 8)) AS q FROM again) GROUP BY doc_id),
sizes AS (SELECT source, count(DISTINCT doc_id) AS host_docs FROM d GROUP BY source),
freq AS (SELECT k.source, k.key FROM (SELECT source, key, count(DISTINCT doc_id) AS n FROM solid GROUP BY source, key) k
         JOIN sizes z ON k.source IS NOT DISTINCT FROM z.source WHERE k.n > {quality_rules.MIN_DOCS} AND k.n * 1000 > z.host_docs * {quality_rules.PER_MILLE}),
gone AS (SELECT s.doc_id, sum(s.n)::BIGINT AS n_frequent_words FROM solid s JOIN freq f ON s.key = f.key AND s.source IS NOT DISTINCT FROM f.source GROUP BY s.doc_id),
m AS (SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(w.ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(w.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n_dup_lines, 0)::BIGINT AS n_dup_lines,
             coalesce(rep.n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(gone.n_frequent_words, 0)::BIGINT AS n_frequent_words
      FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words) AND (n_words - n_frequent_words) * 100 >= n_words * {quality_rules.MIN_LEFT_PERCENT} AS kept, n_frequent_words
FROM m""",
}
