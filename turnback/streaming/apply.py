"""Fitted encoders and flows on streams, and fits that grow with a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from turnback.plans.encoders import _Scaled
from turnback.plans.stats import Stats


def encode_stream(stream: DataFrame, model) -> DataFrame:
    """A model's or flow's forward on a stream: stateless, row by row."""
    if not stream.isStreaming:
        raise ValueError("not a stream")
    return model.forward(stream)


class OnlineFit:
    """Statistics of a numeric or datetime encoder over micro-batches; ``model`` is the fit of all rows so far.

    A batch that Spark hands over again after a failure has the same number and counts once.
    """

    def __init__(self, encoder: _Scaled):
        encoder.check()
        self.encoder = encoder
        self.each = [Stats() for _ in encoder.cols]
        self.last = -1

    def update(self, batch: DataFrame, number: int) -> None:
        if number <= self.last:
            return
        row = batch.agg(*self.encoder.fit_exprs(batch)).first()
        self.each = [s + Stats.of(row, f"{self.encoder.name}__{i}") for i, s in enumerate(self.each)]
        self.last = number

    @property
    def model(self) -> _Scaled:
        return self.encoder.fitted(self.encoder.state_of(self.each))

    def attach(self, stream: DataFrame, then: Callable[[DataFrame, int], None] | None = None) -> DataStreamWriter:
        """A writer that updates the fit with every micro-batch, then hands the batch on."""
        def step(batch: DataFrame, number: int) -> None:
            self.update(batch, number)
            if then:
                then(batch, number)

        return stream.writeStream.foreachBatch(step)
