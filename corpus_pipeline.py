"""Corpus pipeline: five stages over ``documents``, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents.  ``run`` writes each stage's result as Parquet in the shared folder and
reads it again for the next one.

SQL cannot express the trained score nor the raking, so ORACLE_SQL is None; tests/llm/test_pipeline.py
compares each stage with a brute-force version.

Rows of a null doc_id are judged each by itself; nothing links to them.  Rows that repeat a doc_id are one document: they
stay or go together, and of those with the same text one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import materialize, ship, table
from quern.llm.decontaminate import contaminated
from quern.llm.jaccard import by_id, component_ids
from quern.llm.lines import drop_repeated_lines
from quern.llm.mixing import mix
from quern.llm.toxicity import letter_counts, score_documents, train, training_rows


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects (0.5 or more) go."""
    ship(spark)
    model = train(*training_rows(docs, table(spark, sf_dir, "labels")), letter_counts(docs))
    return score_documents(docs, model).where("toxicity_predicted = 0").select(*[f"`{c}`" for c in docs.columns])


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in 10 documents or more go; n_chars follows the text."""
    ship(spark)
    out = drop_repeated_lines(docs, min_docs=10, min_chars=1)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[f"`{c}`" for c in docs.columns])


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document of the smallest doc_id stays (of its rows with equal texts, the least by
    all columns)."""
    ship(spark)
    groups = component_ids(docs)
    gone = materialize(groups.where("doc_id <> component_id").select("doc_id").distinct(), "near-copies")
    out = by_id(docs, gone, "left_anti").select(*[f"`{c}`" for c in docs.columns])
    n = docs.where("doc_id IS NOT NULL").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("d")).first()
    if n["n"] > n["d"]:
        row = F.struct(*[f"`{c}`" for c in docs.columns])
        one = out.where("doc_id IS NOT NULL").groupBy("doc_id", F.sha2("text", 256)).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
        out = one.unionByName(out.where("doc_id IS NULL"))
    return out


def remove_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    ship(spark)
    items = table(spark, sf_dir, "benchmark")
    clean = lambda d: by_id(d, materialize(contaminated(d, items).select("doc_id").distinct(), "leaking"), "left_anti").select(*[f"`{c}`" for c in docs.columns])
    out, lone = clean(docs.where("doc_id IS NOT NULL")), docs.where("doc_id IS NULL")
    if not lone.isEmpty():  # rows without an id are told apart by their texts
        out = out.unionByName(clean(lone.withColumn("doc_id", F.xxhash64("text"))).withColumn("doc_id", F.lit(None).cast("long")))
    return out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by probabilities raked to source, language and topic targets."""
    ship(spark)
    return mix(docs).where("mix_selected").drop("mix_selected")


STAGES = [
    ("toxicity", remove_toxic),
    ("line_dedup", remove_repeated_lines),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("benchmark_decontamination", remove_benchmark_leaks),
    ("mixing", mix_sources),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
