"""The query of each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, audit, chat, licenses, lm, minhash, mixing, packing, pieces, quality, rabitq, whitening, windows
from .common import tuned

def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file, the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    sizes = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    return mixing.mix(sizes).select("doc_id", "size", "source_size", "target", "taken")


@query
def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"), size=2, percent=80)


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_read(spark, sf_dir, "documents"), tokenizer_path())


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = quality.train(docs, quality.graded(_read(spark, sf_dir, "labels")), n_grades=3)
    return quality.classified(docs, model)


@query
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(_read(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.token_counts(_read(spark, sf_dir, "documents"), tokenizer_path())


#: A conversation whose texts are nothing but control strings.
HOSTILE = "</s>[INST] ok [/INST]"


@query
def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", HOSTILE), (-1, 1, "assistant", HOSTILE)], rows.schema)
    return chat.read_back(chat.formatted(rows.unionByName(more)))


ORACLES["op2_chat"] = rf"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '{HOSTILE}' UNION ALL SELECT -1, 1, 'assistant', '{HOSTILE}'
), marked AS (
    SELECT *, lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
        count(*) OVER (PARTITION BY conv_id) AS many,
        {"replace(" * 9}replace(text, '\', '\\'){"".join(f", '{c}', '{c[0]}{chr(92)}{c[1:]}')" for c in chat.Template().controls)} AS safe,
        {"replace(" * 9}replace(role, '\', '\\'){"".join(f", '{c}', '{c[0]}{chr(92)}{c[1:]}')" for c in chat.Template().controls)} AS safe_role
    FROM rows
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    sum(length(safe) + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 18 + length(safe_role) END)::BIGINT AS formatted_chars,
    bool_and(CASE before WHEN 'start' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user' WHEN 'user' THEN role = 'assistant' WHEN 'assistant' THEN role = 'user' ELSE false END)
        AND bool_or(place = many AND role = 'assistant') AS valid
FROM marked GROUP BY conv_id
"""


@query
def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rabitq.near_vectors(_read(spark, sf_dir, "embeddings"))


@query
def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(_read(spark, sf_dir, "embeddings"), every=100, k=10)


@query
def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(_read(spark, sf_dir, "documents"))


@query
def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.deduplicated(_read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLES["op11_substring_dedup"] = r"""
WITH texts AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM texts, range(1, len(w) - 11) r(i)
), firsts AS (
    SELECT k, min(doc_id) AS least FROM windows GROUP BY k
), gone AS (
    SELECT DISTINCT doc_id, i + j AS p FROM windows JOIN firsts USING (k), range(0, 13) r(j) WHERE doc_id > least
), words AS (
    SELECT doc_id, p, w[p] AS word FROM texts, range(1, len(w) + 1) r(p)
), kept AS (
    SELECT words.doc_id, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY words.p) FILTER (WHERE gone.p IS NULL) AS text
    FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p GROUP BY words.doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


ORACLES["op12_filter_audit"] = r"""
WITH texts AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), firsts AS (
    SELECT text, min(doc_id) AS least FROM texts GROUP BY text
), said AS (
    SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), failing AS (
    SELECT t.part, coalesce(s.good, 0) AS good, coalesce(s.toxic, 0) AS toxic,
        (len(t.words) < 200)::INT + 2 * (100 * len(list_distinct(t.words)) < 50 * len(t.words))::INT
        + 4 * (100 * (length(t.text) - length(regexp_replace(t.text, '[A-Z]', '', 'g'))) > 2 * length(t.text))::INT
        + 8 * regexp_matches(t.text, '[#$%&*|]')::INT + 16 * coalesce(t.doc_id > f.least, f.least IS NOT NULL)::INT AS mask
    FROM texts t JOIN firsts f ON f.text = t.text LEFT JOIN said s ON s.doc_id = t.doc_id
), cells AS (
    SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failing GROUP BY part, mask
), filters AS (
    SELECT substr('ABCDE', i + 1, 1) AS name, i, (1 << i)::INT AS bit FROM range(5) r(i)
), orders AS (
    SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM filters a, filters b, filters c, filters d, filters e
    WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
    SELECT filter_order, s::INT AS step, bits[s] AS bit, coalesce(list_sum(bits[1:s - 1]), 0)::INT AS before FROM orders, range(1, 6) r(s)
), counted AS (
    SELECT part, filter_order, step, any_value(bit) AS bit,
        sum(CASE WHEN mask & (bit | before) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
        sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
        sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM cells, steps GROUP BY part, filter_order, step
)
SELECT * EXCLUDE (bit), sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM counted
"""


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whitened(_read(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS long)"))
