"""A training-data pipeline: toxicity, line dedup, near-duplicate groups, decontamination, mixing.

Each stage takes what the one before kept, and returns the columns of
``documents``; the last one adds what the mix takes. Stages are written to the
shared checkpoint folder and read again, so a lost executor costs no more than
the stage that runs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm.common import checkpoint_folder, read
from quirelake.llm.decontamination import contaminated_pairs
from quirelake.llm.line_dedup import dedup_lines
from quirelake.llm.mixing import mix_sources
from quirelake.llm.ngram_join import jaccard_join
from quirelake.llm.toxicity import fit_toxicity, score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOXIC_FROM = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score ``TOXIC_FROM`` or more go."""
    model = fit_toxicity(docs, read(spark, sf_dir, "labels"))
    return score_toxicity(docs.select(*COLUMNS), model, score_col="_toxicity").filter(F.col("_toxicity") < TOXIC_FROM).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more share stay in one of them; every document stays, ``n_chars`` follows the text."""
    return dedup_lines(docs, carry=("lang", "source")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the smallest id stays.

    Rows that repeat an id are one document, of which the least row stays;
    documents without an id cannot be told apart and all stay.
    """
    groups = jaccard_join(docs, n=5, share=(80, 100))
    kept = groups.filter("doc_id = component_id").select("doc_id").distinct()
    others = [c for c in COLUMNS if c != "doc_id"]
    one = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*others)).alias("_row")).select("doc_id", "_row.*")
    return one.unionByName(docs.filter("doc_id IS NULL").select(*COLUMNS)).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = contaminated_pairs(docs, read(spark, sf_dir, "benchmark"), short_items=True).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with ``copies`` and ``taken`` (words, copies counted) and their source's ``target``.

    Documents without an id can't be named in a mix and are left out here.
    """
    named = docs.filter("doc_id IS NOT NULL")
    chosen = mix_sources(named).filter("copies > 0").select("doc_id", "size", "target", "taken", "copies")
    return named.select(*COLUMNS).join(chosen, "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix),
]

#: No SQL: the toxicity stage trains and applies compression dictionaries.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    folder = f"{checkpoint_folder(spark)}/corpus_pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
