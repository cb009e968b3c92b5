"""Islands of contigs that arrive over several files, with keyed state.

The state of a contig is its open end: the number of its last island, where its last gene starts and ends, and what it must share with the next one.  Files
may be cut anywhere, in the middle of contigs and islands; the rows that come out are those of the batch operator, if each contig's
genes arrive in the order of their starts.  A gene that comes late is an error, not a wrong island.  With ``idle_ms``, the
state of a contig that has had no gene for so long is dropped by a timer, and the next gene of it starts anew; such a query goes on until it is stopped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

#: The state store that keyed state with timers needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OpenIslands(StatefulProcessor):
    """Numbers the genes of each contig as ``intervals.islands`` does, from the open end on."""

    def __init__(self, start: str, end: str, same: str, gap: int, order: Sequence[str], columns: Sequence[str], idle_ms: int | None):
        self.start, self.end, self.same, self.gap, self.order = start, end, same, gap, list(order)
        self.columns, self.idle_ms = list(columns), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "island long, start long, end long, same string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A call has few genes, so arrays are worked on, and the state is asked once.
        parts = list(rows)
        genes = parts[0] if len(parts) == 1 else pd.concat(parts)
        known = self.open.get()
        if not len(genes):
            return
        by = [genes[c] for c in (self.start, *self.order)]
        if all(c.dtype.kind in "iuf" for c in by):
            genes = genes.take(np.lexsort([c.to_numpy() for c in reversed(by)]))
        else:
            genes = genes.sort_values([self.start, *self.order], kind="stable")
        island, last_start, last_end, last_same = known if known is not None else (0, None, None, None)
        starts, ends, same = genes[self.start].to_numpy(), genes[self.end].to_numpy(), genes[self.same].astype(object).to_numpy()
        if last_start is not None and starts[0] < last_start:
            raise ValueError(f"contig {key[0]}: a gene at {starts[0]} came after one at {last_start}")
        before_end = np.append(last_end if last_end is not None else 0, ends[:-1])
        # An unknown neighbour is another one.
        names = [None if pd.isna(s) else str(s) for s in same.tolist()]
        apart = starts - before_end > self.gap
        apart |= np.array([a is None or a != b for a, b in zip(names, [last_same, *names])])
        if island == 0:
            apart[0] = True
        numbers = island + np.cumsum(apart)
        self.open.update((int(numbers[-1]), int(starts[-1]), int(ends[-1]), names[-1]))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield genes[self.columns].assign(island=numbers)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.open.clear()
        yield from ()

    def close(self) -> None:
        pass


def keyed_islands(genes: DataFrame, contig: str, start: str, end: str, same: str, gap: int, order: Sequence[str] = (), idle_ms: int | None = None) -> DataFrame:
    """A stream of genes with ``island``, whatever batches a contig's genes come in."""
    columns = genes.columns
    schema = StructType([*genes.schema.fields, StructField("island", LongType())])
    return genes.groupBy(contig).transformWithStateInPandas(
        statefulProcessor=OpenIslands(start, end, same, gap, order, columns, idle_ms),
        outputStructType=schema, outputMode="Append", timeMode="None" if idle_ms is None else "ProcessingTime",
    )


def stream_islands(
    spark: SparkSession, source: str, schema, contig: str, start: str, end: str, same: str, gap: int, target: str, checkpoint: str,
    order: Sequence[str] = (), fmt: str = "parquet", files_per_trigger: int = 1, idle_ms: int | None = None,
):
    """``keyed_islands`` of files, from the oldest on, appended to ``target``; returns the query, which ends with the last file at hand unless contigs can fall idle."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    genes = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(source)
    found = keyed_islands(genes, contig, start, end, same, gap, order, idle_ms)
    out = found.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if idle_ms is None else out.trigger(processingTime="1 second")).start()
