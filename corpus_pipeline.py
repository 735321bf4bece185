"""The training-data pipeline: five stages over ``documents``, each one of the
operators in ``tenderlake.llm``.

Every stage takes (spark, docs, sf_dir), works on all rows it is given and
returns a DataFrame; ``run`` writes each stage's rows and reads them again as
the next one's documents.  All but the last return the columns of
``documents``.

1. quality classifier: documents that it rejects (score under 0.3) go;
2. SimHash near-dedup: of each group the document of the least id stays;
3. secret scans: secrets in the texts are replaced by a mark;
4. mixing sources: whole copies and word runs that the mix takes, one row each;
5. best-fit packing: sequences of at most 2048 tokens.

An empty table gives an empty result in every stage.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from tenderlake.llm.common import read_table, written  # noqa: E402
from tenderlake.llm.stages import (  # noqa: E402
    filter_quality, keep_one_per_class, mix_documents, pack_sequences, redact_secrets)

STAGES = [
    ("quality_classifier", filter_quality),
    ("simhash_near_dedup", keep_one_per_class),
    ("secret_scans", redact_secrets),
    ("source_mixing", mix_documents),
    ("best_fit_packing", pack_sequences),
]

#: Trained networks, hashes by seed and tokenizers have no SQL form; tests hold
#: the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
