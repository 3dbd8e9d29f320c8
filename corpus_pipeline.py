"""The corpus pipeline: language ID, near-duplicate removal, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), with ``docs`` the table that its predecessor wrote, and
returns the rows it keeps. The language stage drops documents whose language is not recognised; of
each group of near duplicates one document stays; documents with a benchmark item go; the mix takes
every source as often as its target asks, repeats included; the last stage adds shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, language, mixture, neardup, shards
from millrace.llm.store import Workspace
from millrace.session import table

STAGES = [
    ("language", language.stage),
    ("near_duplicates", neardup.stage),
    ("decontamination", decontaminate.stage),
    ("mixture", mixture.stage),
    ("shards", shards.stage),
]

#: The language model, the mix's permutation and the communication matrix are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    space, docs, before = Workspace(spark, "pipeline"), table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with Workspace.scope():
            docs = space.put(stage(spark, docs, sf_dir), name)
        space.drop(*before)
        before = [name]
    return docs
