"""A corpus cleaning pipeline of five stages over ``documents``.

Stages run in order, each on all that the one before it kept, written as Parquet
and read again between them:

1. toxicity: documents scored 0.5 or more go.
2. line dedup: lines whose key ten or more documents hold go from every document;
   documents keep their remaining lines (a text can become empty, null stays null).
3. n-gram Jaccard join: of each group of linked documents that with the smallest id
   stays.
4. benchmark decontamination: documents that hold a window of ten consecutive words
   of a benchmark item go.
5. SentencePiece: each document becomes its ids with the end id, and its decoded text.

All but the last return the columns of documents; n_chars follows the text where
lines went.  The whole cannot be expressed in SQL (a trained score, a tokenizer).

Defined results: null and empty texts are clean, have no lines to drop, no links and no
windows, and become the end id alone.  Rows without an id are judged like others, but
never linked.  Repeated rows are rows like others; repeated ids go together in the third
stage, which drops rows by id.  Texts of any length are read whole.  Of linked documents
the smallest id stays, so ties cannot arise.  Columns that are not used pass unchanged,
whatever their names.  An empty table gives an empty result at every stage.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import table, written
from palimpsest.llm.decontaminate import find_contamination
from palimpsest.llm.jaccard_join import similar_documents
from palimpsest.llm.line_dedup import dedup_lines
from palimpsest.llm.sentencepieces import encode_documents
from palimpsest.llm.toxicity import score_documents, trained_model

TOXIC = 0.5


def plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under neutral column names, so that no extra column clashes with an operator's, and the names by the old ones."""
    new = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    return docs.toDF(*new.values()), new


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = trained_model(spark, docs.select("doc_id", "text"), sf_dir)
    rows, at = plain(docs)
    scored = score_documents(rows, model, text=at["text"], keep=tuple(rows.columns))
    return scored.where(F.col("score") < TOXIC).select(*rows.columns).toDF(*docs.columns)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, at = plain(docs)
    out = dedup_lines(rows, doc_id=at["doc_id"], text=at["text"])
    changed = F.col("n_dropped") > 0
    if "n_chars" in at:
        n = F.char_length("kept_text").cast(dict(docs.dtypes)["n_chars"])
        out = out.withColumn(at["n_chars"], F.when(changed, n).otherwise(F.col(at["n_chars"])))
    out = out.withColumn(at["text"], F.when(changed, F.col("kept_text")).otherwise(F.col(at["text"])))
    return out.select(*rows.columns).toDF(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without an id stay; a row goes if a document with its id is linked, at any distance, to a smaller id."""
    found = similar_documents(docs.select("doc_id", "text")).where("doc_id IS NOT NULL AND component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(found, docs["doc_id"] == found["_gone"], "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, at = plain(docs)
    found = find_contamination(rows, table(spark, sf_dir, "benchmark"), doc_id=at["doc_id"], text=at["text"], keep=rows.columns)
    return found.where(F.size("items") == 0).select(*rows.columns).toDF(*docs.columns)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), texts=True, remembered=200_000, held=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_common_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding and decoding", to_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
