"""A training-data pipeline: each stage takes the documents that the stage before kept.

A stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read again as the next
stage's documents. All but the last return the columns of documents; the last returns the pieces of packed sequences.

    toxicity         rows that the ordinal model calls toxic go
    quality_rules    rows that fail the base rules or the trees go
    near_duplicates  one row of each class of exact and near copies stays: that of the smallest id
    secrets          all rows stay; secrets in their texts become `[secret]`, and n_chars follows
    packing          all texts as tokens in sequences of at most 4096

Defined cases: a null text is no crash in any stage; it fails the base rules, so it is gone after the second. Null and
repeated ids are kept apart by a row number, so of equal rows one stays, whatever its id. Other columns pass unchanged,
whatever their names. An empty table gives no pieces. Models are fitted on the documents that a stage is given and on the
labels table; without labels of both kinds nothing is toxic and the base rules alone decide on quality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm.common import Scratch, read_table
from cairn.llm.op2_minhash import minhash_stage
from cairn.llm.op3_rules import rules_stage
from cairn.llm.op4_secrets import secrets_stage
from cairn.llm.op5_toxicity import toxicity_stage
from cairn.llm.op9_packing import packing_stage

STAGES = [
    ("toxicity", toxicity_stage),
    ("quality_rules", rules_stage),
    ("near_duplicates", minhash_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

# trees, hashed signatures and a tokenizer are beyond SQL; tests/llm/test_pipeline.py holds each stage against a plain version
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
