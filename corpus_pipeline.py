"""The corpus pipeline: five stages, each one operator of ``oratora.llm``, over the documents table.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet
and read again as the next one's ``docs``.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oratora.llm import decontaminate, packing, pii, quality_rules, simhash
from oratora.llm.common import stored, table
from oratora.llm.queries import vocabulary


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects.

    Null and empty texts go (no words); repeated rows and null ids are judged each by its text; no rows give no rows.
    """
    return quality_rules.keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the smallest id.

    Rows with a null id are compared like others and come last; unlike texts
    under one id are kept each; null and empty texts are one group.
    """
    return simhash.keep_one_per_group(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Each text is judged by itself, so null and repeated ids don't matter; null texts, and all texts if
    there are no items, stay.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and disclosing terms replaced, ``n_chars`` renewed.

    All rows stay, repeated ones and null ids too; null and empty texts stay as they are.
    """
    return pii.sanitise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences.

    A null or empty text is its end id; repeated rows and null ids are packed like others; no rows give no pieces.
    """
    return packing.pack(docs, vocabulary(), {"ids_crc32": F.crc32("ids")})


STAGES = [
    ("quality_rules", good_quality),
    ("simhash_dedup", one_of_each),
    ("decontamination", uncontaminated),
    ("pii", without_personal_data),
    ("packing", packed),
]

#: Tokenising and fingerprints are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; results in between are Parquet in the shared checkpoint folder until the driver ends."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
