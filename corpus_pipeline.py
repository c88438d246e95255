"""A corpus pipeline of five operators: toxicity, language, near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read back as the next one's
``docs``. The first four return rows of ``docs`` with all its columns, whatever their names (doc_id, text and, for the language,
lang are the ones that they read); the last returns the packed pieces. An empty table gives no rows in any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.llm import decontamination, language, near_dedup, packing, toxicity
from terravane.llm.shared import stored

#: A text whose language is known with less than this score goes, as do texts without a letter.
LEAST_LANGUAGE_SCORE = 0.5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns renamed to __0, __1 and so on, so that no name clashes with an operator's, and the new names by the old."""
    names = {c: f"__{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def _back(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*[F.col(n).alias(c) for c, n in names.items()])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on ``labels``, does not predict to be toxic.

    Null and empty texts and rows with a null doc_id are scored like others (a text without words is not toxic); each repeated
    row is judged on its own, alike. Without labels of both kinds nothing is known to be toxic, and all rows stay.
    """
    model = toxicity.fit(docs.select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    rows, names = _numbered(docs)
    return _back(toxicity.score(rows, model, rows.columns, names["text"], "toxicity_").where("toxicity_predicted = 0"), names)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the classifier knows and is sure of.

    Null and empty texts and texts without a letter have no language and go. Rows with a null doc_id or lang and repeated rows are
    judged by their text like others. If no row has a language to learn from, none can be judged, and all rows stay.
    """
    model = language.fit(docs.select("doc_id", "text", "lang"))
    if not model.languages:
        return docs
    rows, names = _numbered(docs)
    predicted = language.predict(rows, model, rows.columns, names["text"], "language_")
    return _back(predicted.where((F.col("language_lang_pred") != "und") & (F.col("language_score") >= LEAST_LANGUAGE_SCORE)), names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id, once.

    Texts without words are no one's duplicates and stay; repeated rows of a doc_id become one; rows with a null doc_id stay, each.
    """
    kept = near_dedup.near_duplicates(docs.select("doc_id", "text")).where("kept and doc_id is not null").select(F.col("doc_id").alias("kept_id")).distinct()
    rows, names = _numbered(docs)
    doc_id = F.col(names["doc_id"])
    found = rows.where(doc_id.isNotNull()).hint("merge").join(kept.hint("merge"), doc_id == F.col("kept_id"), "left_semi")
    return _back(found.dropDuplicates([names["doc_id"]]).unionByName(rows.where(doc_id.isNull())), names)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of ``benchmark``. Null and empty texts hold none and stay, as do all if there are no items; each row is judged on its own."""
    rows, names = _numbered(docs)
    found = decontamination.decontaminate(rows, _table(spark, sf_dir, "benchmark"), rows.columns, names["text"])
    return _back(found.where("not contaminated"), names)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences. A null or empty text is one piece, the end id; repeated rows and null doc_ids are packed, each."""
    return packing.pack(docs, with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL can express neither the fitted classifiers nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the ``documents`` of ``sf_dir``."""
    docs = _table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
