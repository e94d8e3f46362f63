"""Slice state kept by the stream itself, one state row per source."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from slicelake.operators.lifecycle import SOURCE

# The stream's driver-side helper process does not see files added to the application.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

OUTPUT = (
    "mapping_id bigint, bucket_name string, resource_name string, seq bigint, action string, "
    "prev_state string, state string, success boolean, visible_seq bigint"
)


def step(state: str, visible: int | None, seq: int, action: str, ok: bool) -> tuple[str, int | None, bool]:
    """(state, visible version, success) after one event whose load has ended."""
    if action == "DELETE":
        return ("ABSENT" if state == "ABSENT" else "DELETED"), None, True
    if (action == "CREATE" and state == "ACTIVE") or (action == "UPDATE" and state == "ABSENT"):
        return state, visible, False
    return ("ACTIVE", seq, True) if ok else ("ERROR", visible, False)


class SliceProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slice = handle.getValueState("slice", "state string, visible bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # what one source sent in this micro-batch, in arrival order
        batch = pd.concat(list(rows)).sort_values("seq")
        state, visible = self.slice.get() if self.slice.exists() else ("ABSENT", None)
        out = []
        for seq, action, ok in zip(batch["seq"], batch["action"], batch["ok"]):
            before = state
            state, visible, success = step(state, visible, int(seq), action, bool(ok))
            out.append((*key, int(seq), action, before, state, success, visible))
        self.slice.update((state, visible))
        frame = pd.DataFrame(
            out, columns=[*SOURCE, "seq", "action", "prev_state", "state", "success", "visible_seq"]
        )
        yield frame.astype({"visible_seq": "Int64"})

    def close(self) -> None:
        pass


def lifecycle_stream(events: DataFrame) -> DataFrame:
    """Streaming form of the lifecycle fold; needs the RocksDB state store.

    Input: SOURCE, ``seq``, ``action``, ``ok``. Order holds inside a micro-batch; across
    micro-batches arrival decides.
    """
    columns = [F.col("mapping_id").cast("bigint").alias("mapping_id"), *SOURCE[1:], "seq", "action", "ok"]
    return (
        events.select(*columns)
        .groupBy(*SOURCE)
        .transformWithStateInPandas(
            SliceProcessor(), outputStructType=OUTPUT, outputMode="append", timeMode="none"
        )
    )
