"""Keyed processing in event-time order.

Rows are held in state until the watermark has passed them and then worked through sorted, so a
stream gives what a batch over the same rows gives. Later rows are dropped and counted by Spark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Rows that wait, those that came together in one text: reading and writing state costs a call for each entry.
ROWS = "rows string"
OUT = T.StructType([
    T.StructField("group", T.StringType()), T.StructField("us", T.LongType()), T.StructField("seq", T.LongType()),
    T.StructField("id", T.StringType()), T.StructField("result", T.StringType()),
])


class OrderedProcessor(StatefulProcessor):
    """Subclasses implement ``step(state, us, body)``: update the state of the key (a dict) with
    one row and return a result to emit, or None. The state is kept as JSON."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", ROWS)
        self.state = handle.getValueState("state", "json string")

    def step(self, state: dict, us: int, body: dict):
        raise NotImplementedError

    def load(self, state: dict) -> dict:
        """The state as ``step`` works on it."""
        return state

    def dump(self, state: dict) -> dict:
        """The state as it is kept, of what JSON can hold."""
        return state

    def prune(self, state: dict, watermark_us: int) -> None:
        """Forget what no later row can need."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            if pdf[["us", "seq"]].isna().any(axis=None):
                raise ValueError("a row without time or number has no place in the order")
            new = list(zip(pdf["us"].tolist(), pdf["seq"].tolist(), pdf["id"].tolist(), pdf["body"].tolist()))
            self.pending.appendList([(json.dumps(new),)])
            low = min(r[0] for r in new)
            first = low if first is None else min(first, low)
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(r) for text, in self.pending.get() for r in json.loads(text)) if self.pending.exists() else []
        ready = [r for r in rows if r[0] <= watermark]
        if not ready:
            return
        kept = rows[len(ready):]
        state = self.load(json.loads(self.state.get()[0]) if self.state.exists() else {})
        out = []
        for us, seq, ident, body in ready:
            result = self.step(state, us, json.loads(body))
            if result is not None:
                out.append((key[0], us, seq, ident, json.dumps(result)))
        self.prune(state, watermark)
        self.state.update((json.dumps(self.dump(state)),))
        if kept:
            self.pending.put([(json.dumps(kept),)])
            self.handle.registerTimer(-(-kept[0][0] // 1000))
        else:
            self.pending.clear()
        if out:
            yield pd.DataFrame(out, columns=["group", "us", "seq", "id", "result"])

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, processor: OrderedProcessor) -> DataFrame:
    """Run a processor over rows of ``group, timestamp, us, seq, id, body``; the stream must carry a
    watermark on ``timestamp`` and use the RocksDB state store."""
    return rows.select("group", "timestamp", "us", "seq", "id", "body").groupBy("group").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=OUT, outputMode="Append", timeMode="EventTime"
    )


def body(*columns) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("body")
