"""The corpus pipeline: documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and its result is written as Parquet and
read again as the next one's ``docs``:

1. toxicity: documents that the factorization machine rejects go;
2. ngram_jaccard_join: of each group of near copies the smallest doc_id stays;
3. secret_scan: reported secrets are replaced by a mark, all documents stay;
4. mixing: documents are repeated so that domains approach their target shares
   (every document stays: rates are at least 1);
5. best_fit_packing: pieces with their sequence and offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.mixing import resample
from quillon.llm.ngram_join import keep_one_per_group
from quillon.llm.packing import pack_documents
from quillon.llm.queries import vocabulary
from quillon.llm.secrets import redact
from quillon.llm.toxicity import drop_toxic
from quillon.session import load, stage

#: Shares of the corpus's expected tokens, and its growth by repeats. No document goes, so a
#: domain that holds more than its share of the growth stays over its target.
TARGETS = {"high": 0.80, "low": 0.17, "toxic": 0.03}
BUDGET = 1.25


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at the threshold or above go, each row by its own text; null and empty texts and
    clean documents stay, with all columns. An empty table stays empty."""
    return drop_toxic(docs, load(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays. Null and empty texts and rows of a null
    doc_id stay; of rows equal in doc_id and text all stay or go. An empty table stays empty."""
    return keep_one_per_group(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reported secrets become a mark; all rows stay, null texts as they are. An empty table stays empty."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are repeated so that domains approach their targets; every row stays at least once, also
    those of null and empty texts. An empty table stays empty."""
    return resample(docs, load(spark, sf_dir, "labels"), TARGETS, BUDGET)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and offset; a null or empty text is its end id alone. An empty table gives no pieces."""
    return pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("secret_scan", secret_scan),
    ("mixing", mixing),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents below ``sf_dir``; each is written and read again."""
    docs = load(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs)
    return docs


#: SQL cannot express the trained classifiers and the packing plan.
ORACLE_SQL = None
