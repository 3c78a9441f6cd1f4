"""Token counts of whole texts (operator 4)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.arrow import by_bytes
from gridlake.llm.encoding import Counter, worker_copy


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row.

    For tokenizers that drop white space. Batches are cut by bytes, long texts between
    words. A null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated
    rows are counted each; other columns are not read.
    """

    def count(batches):
        counter = worker_copy(Counter, tokenizer_path)
        for batch in by_bytes(batches):
            counts = counter(batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    return (
        docs.select(F.col(id_col).alias("doc_id"), size.alias("n_bytes"), F.col(text_col).alias("text"))
        .mapInArrow(count, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long")
        .withColumn("over_limit", F.col("n_tokens") > limit))
