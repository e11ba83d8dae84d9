"""Table functions that SQL can call."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from nightloom.schema import PAD_STAGE, SEQUENCE_LENGTH


class RecordSequences:
    """The sequences of each record of a table (record, epoch_idx, stage) that is partitioned by its record:

    ``SELECT * FROM record_sequences(TABLE(labels) PARTITION BY (record), 21)``. A row for each place of each sequence; places
    beyond the record have the pad stage. It holds the labels of one record at a time."""

    def __init__(self) -> None:
        self.record, self.stages, self.length = None, {}, SEQUENCE_LENGTH

    def eval(self, row: Row, length: int = SEQUENCE_LENGTH) -> None:
        self.record, self.length = row[0], length
        self.stages[row[1]] = row[2]

    def terminate(self) -> Iterator[tuple]:
        for start in range(max(len(self.stages) - self.length, 0) + 1 if self.stages else 0):
            for off in range(self.length):
                stage = self.stages.get(start + off)
                yield self.record, start, off, start + off, PAD_STAGE if stage is None else stage, stage is None


def register(spark: SparkSession, record_type: str = "int") -> None:
    """Makes record_sequences() known to a session; the type is that of the records' column."""
    made = udtf(RecordSequences, returnType=f"record {record_type}, rel_idx int, off int, epoch_idx int, stage int, padded boolean")
    spark.udtf.register("record_sequences", made)
