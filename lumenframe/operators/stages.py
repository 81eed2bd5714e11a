"""The seam for models at the edge: a batch function over Arrow batches, behind its gate.

Catalyst does not push filters through Python stages, so the gate is applied before the function, and rows
that fail it come back with null outputs instead of being scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ScoringStage:
    """load() makes a scorer once in a worker; scorer(pdf) gives a frame of the outputs, row by row."""

    load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]
    inputs: tuple[str, ...]
    outputs: str  # DDL of the output columns

    def apply(self, rows: DataFrame, gate: Column | None = None) -> DataFrame:
        """rows with the outputs; only the rows that pass the gate reach the scorer."""
        names = rows.columns
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), self.outputs])
        load, inputs = self.load, list(self.inputs)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            scorer = load()
            for pdf in batches:
                out = scorer(pdf[inputs])
                yield pd.concat([pdf[names].reset_index(drop=True), out.reset_index(drop=True)], axis=1)

        if gate is None:
            return rows.mapInPandas(run, schema)
        ok = F.coalesce(gate, F.lit(False))
        return rows.where(ok).mapInPandas(run, schema).unionByName(rows.where(~ok), allowMissingColumns=True)
