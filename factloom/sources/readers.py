"""Readers of dialogue and question files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXAMPLE = "id string, category string, intensity string, sessions array<struct<session_id:string,input:string>>, questions array<struct<query:string,expected_answer_contains:array<string>,expected_conflict:boolean,expected_supporting_ids:array<string>>>, gold_entity_groups map<string,array<string>>"
INSTANCE = "question_id string, question_type string, question string, answer string, haystack_session_ids array<string>, haystack_sessions array<array<struct<role:string,content:string>>>, answer_session_ids array<string>"
DIALOGUE = "dialogue_id string, turns array<struct<utterance:string,slots:array<string>,values:array<string>>>"


def examples(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark examples, one a line."""
    return spark.read.schema(EXAMPLE).json(path)


def instances(spark: SparkSession, path: str, question_type: str | None = None, abstention: bool | None = None) -> DataFrame:
    """Question instances of a JSON array; abstention questions end in _abs."""
    df = spark.read.schema(INSTANCE).option("multiLine", True).json(path)
    if question_type is not None:
        df = df.where(F.col("question_type") == question_type)
    if abstention is not None:
        df = df.where(F.endswith("question_id", F.lit("_abs")) == abstention)
    return df


def flatten_sessions(df: DataFrame) -> DataFrame:
    """question_id, session_id, text: a session's turns as ``role: content`` lines."""
    s = df.select("question_id", F.explode(F.arrays_zip("haystack_session_ids", "haystack_sessions")).alias("s"))
    lines = F.transform("s.haystack_sessions", lambda t: F.concat_ws(": ", t["role"], t["content"]))
    return s.select("question_id", F.col("s.haystack_session_ids").alias("session_id"), F.array_join(lines, "\n").alias("text"))


def dialogue_states(spark: SparkSession, path: str) -> DataFrame:
    """dialogue_id, turn, slot, value from columnar slot and value lists."""
    d = spark.read.schema(DIALOGUE).json(path)
    t = d.select("dialogue_id", F.posexplode("turns").alias("turn", "t"))
    z = F.explode(F.arrays_zip(F.col("t.slots").alias("slot"), F.col("t.values").alias("value")))
    return t.select("dialogue_id", "turn", z.alias("z")).select("dialogue_id", "turn", "z.slot", "z.value")
