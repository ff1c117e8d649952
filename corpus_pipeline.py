"""Documents to packed training sequences: quality, near-duplicates, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's `docs`. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import minhash, mixing, packing, quality
from skein.llm.common import tuned, written
from skein.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of the top grade is below the bar go: toxic and low-quality ones.

    Null and empty texts are judged as texts without words, long ones as a whole; repeated rows share a fate; ids may be
    null or repeated. Columns beside those of documents are dropped. An empty table gives an empty result.
    """
    labels = tuned(spark).read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, quality.graded(labels), n_grades=3)
    return quality.selected(docs.select(*COLUMNS), model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by similarities of 0.8 or more on five-word shingles: the least id's (nulls last).

    Rows are told apart by id and text, so rows without an id or with a shared one stay unless their text goes. Null and
    empty texts link with nothing and stay; of rows with the same id and text one stays. Empty: empty.
    """
    tuned(spark)
    return minhash.distinct_rows(docs.select(*COLUMNS), size=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document; the last one of a source may be cut.

    A null source is a source. Null and empty texts have no words to take and go. Repeated rows are documents of their
    own. Empty: empty.
    """
    tuned(spark)
    return mixing.mixed_documents(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row gives at least one piece, an empty text that of the end id alone; texts are cut at the capacity only.
    """
    tuned(spark)
    return packing.packed_documents(docs, tokenizer_path())


STAGES = [("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("mixing", mix_sources), ("packing", pack_sequences)]

#: No stage's decisions (a fitted model, hashed orders, an evolved packing) can be said in SQL; tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result but the last is a table in the shared folder."""
    docs = tuned(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
