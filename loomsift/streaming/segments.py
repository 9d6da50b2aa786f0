"""Tables that micro-batches add to: one segment per batch, merged like a log-structured tree.

A batch writes a segment and then a manifest with its number, which names the live segments. When ``fan`` segments of one size stand at the
end they are merged to one, so that a reader meets at most about ``fan * log(batches)`` of them. A batch starts from the manifest
before it and writes nothing but files under its own number: when it is replayed it writes the same again and counts once. Segments
that were merged stay where they are.
"""

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

Merge = Callable[[DataFrame], DataFrame]


class SegmentTable:
    """``merge`` makes one segment of the rows of several; without it they are put side by side."""

    def __init__(self, spark: SparkSession, folder: str, schema, merge: Merge | None = None, fan: int = 8, buckets: str | None = None):
        self.spark, self.folder, self.schema, self.merge, self.fan, self.buckets = spark, folder, schema, merge, fan, buckets

    def segments(self, batch: int | None = None) -> list[tuple[int, int]]:
        """First and last batch of the live segments before ``batch``, or of all."""
        try:
            told = self.spark.read.schema("segments string, batch bigint").json(f"{self.folder}/manifest")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        if batch is not None:
            told = told.filter(told["batch"] < batch)
        last = told.orderBy("batch", ascending=False).first()
        return [] if last is None else [tuple(s) for s in json.loads(last["segments"])]

    def read(self, batch: int | None = None) -> DataFrame:
        """Rows of the live segments before ``batch``, or of all."""
        return self._rows(self.segments(batch))

    def _path(self, segment: tuple[int, int]) -> str:
        return f"{self.folder}/segment-{segment[0]}-{segment[1]}"

    def _rows(self, live: list[tuple[int, int]]) -> DataFrame:
        if not live:
            return self.spark.createDataFrame([], self.schema)
        reader = self.spark.read.schema(self.schema)
        frames = [reader.option("basePath", self._path(s)).parquet(self._path(s)) for s in live]
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionByName(frame)
        return out

    def _write(self, rows: DataFrame, segment: tuple[int, int]) -> None:
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(self.buckets) if self.buckets else writer).parquet(self._path(segment))

    def add(self, rows: DataFrame, batch: int) -> None:
        """Add the rows of a batch; batches come in ascending order, the last one any number of times."""
        live = [*self.segments(batch), (batch, batch)]
        self._write(rows, live[-1])
        level = 1
        while len(live) >= self.fan and all(b - a + 1 >= level for a, b in live[-self.fan :]) and live[-self.fan][1] - live[-self.fan][0] + 1 < level * self.fan:
            joined = self._rows(live[-self.fan :])
            live = [*live[: -self.fan], (live[-self.fan][0], batch)]
            self._write(joined if self.merge is None else self.merge(joined), live[-1])
            level *= self.fan
        told = self.spark.createDataFrame([(json.dumps(live), batch)], "segments string, batch bigint")
        told.coalesce(1).write.mode("overwrite").json(f"{self.folder}/manifest/number={batch}")
