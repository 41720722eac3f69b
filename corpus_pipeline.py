"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``docs``. Stages
accept nulls in any column, empty and very long texts, repeated rows, empty tables and further
columns; what each does with them is said in its text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxtrail.llm import language_id, mixing, packing, pii, simhash
from voxtrail.llm.common import stored

MIX_BLOCK = 256  # words


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: null or empty text, or no letter in it.

    A null ``lang`` is filled with the predicted one. Without a labelled document to learn from, a
    letter is enough."""
    model = language_id.learn(docs)
    if not model:
        return docs.filter(F.regexp(F.col("text"), F.lit(r"\p{L}")))
    found = language_id.identify(docs, model, docs.columns, out=("__lang", "__score"))
    return (found.filter(F.col("__lang") != "und").withColumn("lang", F.coalesce("lang", "__lang"))
            .select(*[f"`{c}`" for c in docs.columns]))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates.

    Repeated rows of an id stay once. Documents without an id belong to no group; their exact
    copies stay once."""
    groups = simhash.near_duplicates(docs.select("doc_id", "text"))
    stay = groups.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__stay")).distinct()
    named = (docs.join(stay, F.col("doc_id") == F.col("__stay")).drop("__stay").dropDuplicates(["doc_id"]))
    return named.unionByName(docs.filter(F.col("doc_id").isNull()).dropDuplicates(["text"]))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates for personal data; ``n_chars`` follows the text where that changed."""
    out = pii.replace(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__entities") > 0, F.length("text").cast(
            docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[f"`{c}`" for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: a row per document and round, with the words taken of it."""
    return mixing.mixed_documents(docs, mixing.plan(docs, block=MIX_BLOCK))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids and their place in sequences of at most 1024 tokens.

    A document that the mix takes in several rounds is packed once a round; pieces of one row follow each
    other by ``start``, and the ids of a sequence, by ``offset``, are its content."""
    return packing.pack(docs)


STAGES = [
    ("language_id", keep_languages),
    ("simhash", drop_near_duplicates),
    ("pii", replace_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # learned profiles, tokenizer ids and keyed draws have no SQL form; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
