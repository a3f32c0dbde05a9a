"""The corpus pipeline: stages over `documents`, each written as Parquet and read again by the next one."""

from __future__ import annotations

import os
import threading
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vitrine.llm import line_dedup, near_dedup, packing, substring_dedup, weak_labels
from vitrine.session import configure, own_folder, shared_dir
from vitrine.sinks import tables

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier rejects go."""
    return weak_labels.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line matches go; every document stays, emptied ones with an empty text."""
    return line_dedup.line_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of smallest id; emptied documents are one group."""
    return near_dedup.near_dedup(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that start earlier too go; every document stays."""
    return substring_dedup.substring_dedup(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their ids, and the place that each has in a sequence."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


#: What the last stage of a run has left in the shared folder: its number and its folder, by thread, session and inputs.
_LEFT: dict[tuple, tuple[int, str]] = {}


def _staged(number: int, name: str, stage: Stage) -> Stage:
    """The stage, with its intermediates in a folder that goes when the next stage starts: by then its rows are written.

    If the next stage's documents still read from that folder, it stays. So do the last stage's intermediates.
    """

    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        run_of = threading.get_ident(), spark.sparkContext.applicationId, sf_dir
        before, folder = _LEFT.pop(run_of, (None, ""))
        if before is not None and before + 1 == number and not any(os.path.basename(folder) in file for file in docs.inputFiles()):
            tables.remove(spark, folder)
        with own_folder(spark, f"pipeline-{name.replace(' ', '-')}-work") as folder:
            out = stage(spark, docs, sf_dir)
        _LEFT[run_of] = number, folder
        return out

    return begin


STAGES: list[tuple[str, Stage]] = [
    (name, _staged(number, name, stage))
    for number, (name, stage) in enumerate(
        [
            ("quality classifier", quality),
            ("line dedup", lines),
            ("near dedup", near_copies),
            ("substring dedup", passages),
            ("packing", sequences),
        ]
    )
]

#: SQL cannot express the classifier, the sampling or the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, in order."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
