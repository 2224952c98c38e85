"""Answer a stream of requests: every micro-batch of JSON lines is answered and appended to a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..batch import answer_line
from ..engine import Engine


def answer_stream(engine: Engine, requests: DataFrame, output: str, checkpoint: str, batch_limit: int = 1_000) -> StreamingQuery:
    """Start answering ``requests`` (value STRING); a micro-batch is bounded by the source's rate and refused beyond ``batch_limit``."""

    def one(df: DataFrame, number: int) -> None:
        lines = [r[0] for r in df.limit(batch_limit + 1).collect()]
        if len(lines) > batch_limit:
            raise ValueError(f"a micro-batch has more than {batch_limit} requests: bound the source, maxFilesPerTrigger for files")
        answers = [(answer_line(engine, line),) for line in lines]
        df.sparkSession.createDataFrame(answers, "value string").coalesce(1).write.mode("overwrite").text(f"{output}/batch={number}")

    return requests.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
