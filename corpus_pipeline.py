"""A corpus pipeline of five operators: each stage works on all that the one before it kept.

Stages take (spark, docs, sf_dir) and return a DataFrame with the columns of documents; the
last returns pieces of sequences. ``run`` writes each stage's rows and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm import toxicity
from factloom.llm.durable import settle
from factloom.llm.minhash import near_duplicates
from factloom.llm.mixing import mix
from factloom.llm.packing import pack
from factloom.llm.queries import tokenizer_path
from factloom.llm.substring import substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier doesn't call toxic.

    Null and empty texts get the intercept's score, which is the prior, and stay. A null doc_id is
    no row to learn from, and its text is judged like any other; so is each of repeated rows. Very
    long texts are read whole. Equal scores fare alike. Without labels nothing is toxic; an empty
    table stays empty. Columns beyond those of documents are dropped.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(COLUMNS), model).where("predicted = 0").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each near-duplicate group (similarity 0.8 or more).

    Null, empty and blank texts have no shingles and stay, as do rows without doc_id. Rows that
    share a doc_id are one document: all stay or all go. Very long texts are compared whole; ties
    go to the smaller id; an empty table stays empty. Columns beyond those of documents are dropped.
    """
    gone = near_duplicates(docs, percent=80).where("not kept").select("doc_id").distinct()
    return docs.select(COLUMNS).join(gone, "doc_id", "left_anti").select(COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that repeat an earlier document; other texts stay as they are.

    Null and empty texts, and those under 50 words, stay; rows without doc_id keep all words and
    cut nothing; rows that share a doc_id don't cut one another. Of equal passages that of the
    smallest doc_id stays. Very long texts are read whole. A document may lose all its words, and
    stays as an empty text. An empty table stays empty. Columns beyond those of documents are dropped.
    """
    _, cut = substring_dedup(docs, carry=("lang", "source", "n_chars"))
    cut = settle(cut, "cut")
    changed = F.col("n_removed") > 0
    cut = cut.select(
        "doc_id",
        F.col("kept_text").alias("text"),
        "lang",
        "source",
        F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )
    rest = docs.select(COLUMNS).join(cut.select("doc_id").distinct(), "doc_id", "left_anti")
    return rest.select(COLUMNS).unionByName(cut)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, or up to three times.

    Null and empty texts hold no words and aren't taken. Rows without doc_id and rows that share
    one are paired with their sizes and sources, and are mixed each; a null source is a source of its
    own. Among equal lengths a hash of doc_id decides. Very long texts count whole; an empty table
    stays empty. Columns beyond those of documents are dropped.
    """
    picks = mix(docs).groupBy(F.col("doc_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("size", "source", "copies"))).alias("p"))
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    order = Window.partitionBy("doc_id").orderBy(size, F.col("source").asc_nulls_first(), "text")
    rows = docs.select(COLUMNS).withColumn("k", F.row_number().over(order)).join(picks, F.col("doc_id").eqNullSafe(F.col("id")))
    copies = F.element_at("p", F.col("k"))["copies"].cast("int")
    return rows.withColumn("copies", copies).where("copies > 0").withColumn("c", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens.

    A null or empty text has the closing token alone. Repeated rows, and those without doc_id, are
    packed each; very long texts are cut into full sequences and a rest; equal lengths are placed
    in the order of their rows. An empty table gives no pieces.
    """
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A learned classifier and tokenizer ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
