"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which
:func:`run` writes as Parquet in the shared folder and reads again as the next
stage's documents. All stages but the last return the columns of documents.
The stages themselves are in ``civicspark/llm/pipeline.py``.
"""

from civicspark.llm.pipeline import STAGES, run

#: SQL has no MinHash, tokenizer or dynamic program; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]
