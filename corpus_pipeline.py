"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet in the shared folder and read again as the next one's docs. All but the last
return the columns of documents. The rows of the last are the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm.mixing import mix_stage
from weftgraph.llm.packing import pack_stage
from weftgraph.llm.pii import sanitise_stage
from weftgraph.llm.quality import keep_good
from weftgraph.llm.shared import DOCUMENT_COLUMNS, materialize, table
from weftgraph.llm.simhash import dedup_stage

STAGES = [
    ("quality", keep_good),
    ("near_duplicates", dedup_stage),
    ("pii", sanitise_stage),
    ("mixing", mix_stage),
    ("packing", pack_stage),
]

#: Trained, iterative and tokenizing stages are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents").select(*DOCUMENT_COLUMNS)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
