"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token ids.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``documents``.  ``run`` applies
them in order, with each result written to the shared work folder and read
again.  A stage first deletes the work tables of the one before, whose result is
written by then; stages of one run are called by one thread, and other threads'
tables are left alone.

Nulls, empty and very long texts, ties and repeated rows are handled as each stage's
operator states.  An empty table gives an empty result, extra columns
pass through every stage but the last, under any name.  No stage is expressible in SQL as a whole (a learned list, link
components, edit distances, a seeded knapsack, a tokenizer), so the pipeline
is tested against brute force.
"""

from __future__ import annotations

import functools
import threading

from pyspark.sql import DataFrame, SparkSession

from framewright.llm import decontaminate, minhash, mixing, quality_rules, token_ids
from framewright.llm.common import clear_scratch, drop_table, read, scratch_tables, write_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_copies(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def binary_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_ids.token_ids(docs)


class _Work(threading.local):
    """Work tables of the stage that this thread of the driver called last."""

    def __init__(self):
        self.paths: set[str] = set()


_work = _Work()


def _tidy(stage):
    """The stage, which first deletes the work tables of the stage before and then notes its own."""

    @functools.wraps(stage)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        clear_scratch(spark, _work.paths)
        before = scratch_tables()
        out = stage(spark, docs, sf_dir)
        _work.paths = scratch_tables() - before
        return out

    return call


STAGES = [
    ("quality_rules", _tidy(quality)),
    ("minhash_near_duplicates", _tidy(near_duplicates)),
    ("benchmark_decontamination", _tidy(benchmark)),
    ("source_mixing", _tidy(mix_sources)),
    ("token_ids", _tidy(binary_ids)),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), name, scratch=False)
        drop_table(before)
        before = docs
    return docs
