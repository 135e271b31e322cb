"""Index upkeep from a stream: assign each micro-batch to lists and append."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.ivf import IvfIndex


def append_stream(stream: DataFrame, index: IvfIndex, checkpoint: str, vec: str = "embedding", key: str = "id", once: bool = True) -> StreamingQuery:
    """Inserts every micro-batch; ``once`` stops when what is there has been read.

    A batch is a load of its own in the index, by its number and the
    checkpoint's name, so a retried batch replaces what its first try wrote.
    Rows of one key within a batch are inserted once.
    """
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def insert(batch: DataFrame, number: int) -> None:
        index.insert(batch.dropDuplicates([key]), vec, key, f"s{name}-{number}", "overwrite")

    writer = stream.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
