"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave.llm import decontamination, importance, packing, set_join, toxicity
from siteweave.llm.common import prepare, table
from siteweave.llm.queries import held_out, tokenizer_path
from siteweave.session import shared_folder


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with numbers for names, so that none can clash with a column that an operator adds, and the name that each column has now."""
    names = [f"__{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))


def named(docs: DataFrame, at: dict[str, str]) -> DataFrame:
    """The columns of numbered() with their names again, without others."""
    return docs.select(*[F.col(n).alias(c) for c, n in at.items()])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the lexicon, learned from the labels, does not reject.

    Null and empty texts have no match and stay; repeated rows stay or go together. Rows with a null
    doc_id have no label but are scored. An empty table gives an empty result.
    """
    prepare(spark)
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    rows, at = numbered(docs)
    return named(toxicity.score(rows, lexicon, text=at["text"]).where("predicted = 0"), at)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that importance resampling keeps.

    Null and empty texts have weight 1, like texts of the target, and compete with it; repeated rows
    stay or go together, as do rows that tie with the last one kept. Empty table: empty result.
    """
    model = importance.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    rows, at = numbered(docs)
    return named(importance.resample(rows, model, key=at["doc_id"], text=at["text"]).where("kept"), at)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share 0.8 of their 5-word shingles, the one with the smallest id.

    Null and empty texts link with nothing and stay, as do rows without an id. Rows that repeat an id
    stay or go together. An empty table gives an empty result.
    """
    found = set_join.jaccard_components(docs, shingle=5, percent=80)
    others = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a window of a benchmark item; null and empty texts have none and stay, repeated rows stay or go together."""
    rows, at = numbered(docs)
    found = decontamination.find_windows(rows, table(spark, sf_dir, "benchmark"), text=at["text"])
    return named(found.where(F.size("spans") == 0), at)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the sequences; a null or empty text is the end id alone, repeated rows are packed as often as they occur."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: A learned classifier decides in the first two stages, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written in the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = os.path.join(shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
