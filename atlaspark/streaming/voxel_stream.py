"""The voxel map as a stream: observations update keyed state as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.voxels import MapSettings

STATE = "st double, lt double, hits int, pos int, neg int, last_occ int, last_free int"
OUTPUT = f"key long, {STATE}"
START = (0.0, 0.0, 0, 0, 0, -1, -1)


def observe(state: tuple, epoch: int, kind: int, p: MapSettings) -> tuple:
    """One observation applied to a key's state, as the batch fold does."""
    st, lt, hits, pos, neg, last_occ, last_free = state
    clamp = lambda x: min(max(x, p.low), p.high)
    if kind == 0:
        return clamp(st + p.occ_step), lt, hits + 1, pos + 1, 0, epoch, last_free
    neg += 1
    gap = epoch == 0 if last_occ < 0 else epoch - last_occ > p.carve_gap
    if neg >= p.free_to_lt_after and gap:
        lt = clamp(lt + p.lt_free_scale * p.free_step)
    return clamp(st + p.free_step), lt, hits, 0, neg, last_occ, epoch


def voxel_stream(events: DataFrame, params: MapSettings = MapSettings()) -> DataFrame:
    """State of each key after every micro-batch that holds events (key, epoch, seq, kind) of it.

    Micro-batches must arrive in order of (epoch, seq); within one they are
    sorted. Use output mode update.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else START
        rows = pd.concat(list(batches)).sort_values(["epoch", "seq", "kind"])
        for epoch, kind in zip(rows.epoch.tolist(), rows.kind.tolist(), strict=True):
            now = observe(now, epoch, kind, params)
        state.update(now)
        yield pd.DataFrame([(key[0], *now)], columns=[c.split()[0] for c in OUTPUT.split(", ")])

    return events.groupBy("key").applyInPandasWithState(update, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


class EdgeAges(StatefulProcessor):
    """For each frame pair how many epochs ago it was last run: 0 when it runs, one more otherwise."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.age = handle.getValueState("age", "age int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        age = self.age.get()[0] if self.age.exists() else -1
        for part in rows:
            for ran in part.sort_values("epoch").ran.tolist():
                age = 0 if ran else age + 1
        self.age.update((age,))
        yield pd.DataFrame({"pair": [key[0]], "age": [age]})

    def close(self) -> None:
        pass


def edge_ages(pairs: DataFrame) -> DataFrame:
    """(pair, age) after each micro-batch of (pair, epoch, ran). Needs the RocksDB state store; use output mode update."""
    return pairs.groupBy("pair").transformWithStateInPandas(EdgeAges(), "pair string, age int", "update", "none")
