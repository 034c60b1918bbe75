"""Column names, and the speech table's schema at the boundary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, LongType, StringType, StructField, StructType


@dataclass(frozen=True)
class Columns:
    """Names of the dimensions; every operator takes them from here."""

    id: str = "speech_id"
    text: str = "cleaned_text"
    speaker: str = "deputy"
    party: str = "group"
    topic: str = "cluster"
    date: str = "date"
    source: str = "source"
    role: str = "role"
    embedding: str = "embedding"


SPEECH_SCHEMA = StructType(
    [StructField("speech_id", LongType())]
    + [StructField(n, StringType()) for n in ("date", "deputy", "speaker_base", "group", "text", "source", "url", "role", "role_category", "profile_url")]
)
SPEECH_RECORD = StructType(
    [StructField(n, StringType()) for n in ("speaker", "party", "text", "date")]
    + [StructField("session_number", IntegerType()), StructField("url", StringType()), StructField("notes", ArrayType(StringType()))]
    + [StructField(n, StringType()) for n in ("role", "role_category", "profile_url")]
)
ROSTER_SCHEMA = "full_name string, party string, profile_url string, source string"
EMBEDDING_SCHEMA = StructType([StructField("speech_id", LongType()), StructField("embedding", ArrayType(FloatType()))])


def conform(df: DataFrame, schema: StructType = SPEECH_SCHEMA, required: tuple[str, ...] = ("text",)) -> DataFrame:
    """Columns of the schema in its types; optional ones that are missing become typed nulls."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
