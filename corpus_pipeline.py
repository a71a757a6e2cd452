"""A pipeline over documents in stages; each stage reads what its predecessor wrote.

Defined results, by stage (the modules have the details): an empty table gives no rows in each; all columns of the input stay in all
but the last, whatever their names.

  toxicity     null and empty texts score by the bias alone; rows with a null doc_id are scored, never trained on; repeated rows score alike
  exact_dedup  null and empty texts are copies of each other; of equal texts the largest doc_id stays, of its repeated rows one
  simhash      of texts with a similarity of 4/5, chains included, the least doc_id stays, nulls last; null and empty texts are one group
  mixing       texts without words are left out; others come 0, 1 or 2 times; a null source is a source; ties are broken by row
  bpe          a row out for each row in; texts are encoded whole, however long
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import bpe, exact_dedup, mixing, near, toxicity
from strandlake.llm.common import documents, kept
from strandlake.llm.queries import VOCABULARY, labels


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, labels(spark, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.unique(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.tokenized(docs, VOCABULARY)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash", drop_near_copies), ("mixing", mix), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The toxicity model and SimHash have no SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None
