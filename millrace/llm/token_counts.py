"""Token counts with a whole-token shortcut."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import tokenizer
from millrace.llm.common import batched, frugal


def token_counts(
    docs: DataFrame, limit: int = 512, path: str | None = None, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Rows (id, n_bytes, n_tokens, over_limit), one for each input row, whole texts.

    The set of whole tokens is proven once on the driver and broadcast; its size is bounded by
    the vocabulary.  A null or empty text has 0 bytes and 0 tokens, a null id stays null, equal
    rows stay apart, an empty table gives no rows and other columns are ignored.  The work is one
    narrow pass, so a lost executor costs its own partitions only.
    """
    path = path or tokenizer.default_path()
    whole = docs.sparkSession.sparkContext.broadcast(tokenizer.whole_tokens(path))

    def count(batches):
        counter = tokenizer.TokenCounter(path, whole.value)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            n = pa.array([counter.count(t.as_py() or "") for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, batch.column(2), n], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_column].dataType.simpleString()
    counted = batched(docs).select(
        F.col(id_column).alias("id"),
        F.col(text_column).alias("text"),
        F.coalesce(F.octet_length(text_column), F.lit(0)).cast("long").alias("n_bytes"),
    ).mapInArrow(frugal(count), f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
