"""Streaming scoring of request records.

``readStream`` of JSON request files with the fixed request schema, and the same
stateless projection and model as batch scoring (M10).  Every micro-batch is read
and scored once; its answers, a few narrow columns, are kept while they are split
into scored records and rejected ones with their reason.  Each part
is written to the folder of its batch number, in place of what an interrupted
attempt left there, so a restart between the two writes loses and repeats nothing.
No state, no watermark: every record is scored on its own.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from gearlens import schema as S
from gearlens.plans.score import answer_requests, split_answers
from gearlens.session import shared_folder


def score_stream(spark: SparkSession, in_path: str, out_path: str, model: PipelineModel, columns,
                 checkpoint: str | None = None, available_now: bool = True,
                 processing_time: str | None = None, max_files_per_trigger: int | None = None,
                 ) -> list[StreamingQuery]:
    """Start the scoring stream and return its query.  ``{out_path}/scored`` and
    ``{out_path}/rejected`` are parquet tables with a partition column ``batch``.
    ``available_now`` processes what is there and stops."""
    reader = spark.readStream.schema(S.REQUEST_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    out = out_path.rstrip("/")

    def split(batch: DataFrame, number: int) -> None:
        answers = answer_requests(batch, model, columns).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for name, frame in zip(("scored", "rejected"), split_answers(answers)):
                frame.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        finally:
            answers.unpersist()

    ck = (checkpoint or shared_folder(spark, "score-stream")).rstrip("/")
    w = reader.json(in_path).writeStream.foreachBatch(split).option("checkpointLocation", ck)
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return [w.start()]


def run_to_completion(queries) -> None:
    for q in queries:
        q.awaitTermination()
