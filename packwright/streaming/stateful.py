"""Packing a stream with Spark's own state: late examples wait for their place.

Every subset is a state of ``transformWithStateInPandas``. Examples may arrive in any order
within the ``delay`` of the watermark: they wait in the state, sorted by their key, and are
laid down once the watermark says that nothing before them can come any more. So the blocks
are those of the batch. What comes later than the watermark allows is left out: by the engine,
which counts it in its progress (``numRowsDroppedByWatermark``), or, if the watermark moved on
only with the batch it came in, here (``late``).

The state of a subset has three parts: the examples that wait, the unfinished block, and
counters. What arrives together is sorted and waits as one run, cut into parts of bounded size
under the first and last event time they hold; ids and masks are bytes there, so no number is
handled by itself. Laying down merges the runs and holds one part of each, and blocks are handed
on as they fill. A batch touches only the parts it adds and takes away.
It is kept, checkpointed and restored by the engine, so a restart goes on where it stood.

A subset is one task's. To spread a large subset, give it ``lanes``: its examples go to that
many states by ranges of their key (``lane_keys`` keys to a range), and each lane fills
blocks of its own. The blocks of a lane are those of the batch over its examples.
"""

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from heapq import merge
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from packwright.operators.packing import CONTEXT_LENGTH, SUBSET

# The state store this needs; ``start`` sets it for the session where none is set.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

PART_KEY = "run bigint, part bigint, first_us bigint, last_us bigint"
PART_VALUE = "places binary, token_ids binary, tgt_mask binary"
REST = "token_ids binary, tgt_mask binary"
COUNTERS = "blocks bigint, tokens bigint, late bigint, arrived bigint, laid_until_us bigint"

# Tokens of a waiting part, and of the blocks handed on at a time. A longer example is a part
# of its own.
PART_TOKENS = 1 << 17
OUT_TOKENS = 1 << 20
# What is written of a waiting example's place: event time, key, number of arrival, tokens.
PLACE_FIELDS = 4


@dataclass(frozen=True)
class Packing:
    """How a stream is packed. ``event_time`` orders examples, then ``key``."""

    context_length: int = CONTEXT_LENGTH
    groups: Sequence[str] = SUBSET
    key: str = "doc_id"
    event_time: str = "ts"
    delay: str = "10 minutes"
    lanes: int = 1
    lane_keys: int = 1 << 20


def block_schema(groups: Sequence[str], like: T.StructType) -> str:
    named = [f"`{g}` {like[g].dataType.simpleString()}" for g in groups]
    return ", ".join([*named, "lane int", "block_idx bigint", "token_ids array<int>", "tgt_mask array<int>", "late bigint"])


class BlockBuilder(StatefulProcessor):
    """One subset (or one lane of it): waiting examples, unfinished block, counters."""

    def __init__(self, context_length: int, groups: Sequence[str], key: str, event_time: str):
        self.context_length, self.groups, self.key, self.event_time = context_length, list(groups), key, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("runs", PART_KEY, PART_VALUE)
        self.rest = handle.getValueState("rest", REST)
        self.counters = handle.getValueState("counters", COUNTERS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        blocks, tokens, late, arrived, laid_until = self._counts()
        new_late = 0
        for frame in rows:
            events = frame[self.event_time].to_numpy(dtype="datetime64[us]").astype(np.int64)
            numbers = _whole(frame[self.key].to_numpy(), np.int64)
            nth = np.arange(arrived + 1, arrived + 1 + len(frame), dtype=np.int64)
            in_time = np.flatnonzero(events > laid_until)
            if len(in_time):
                order = in_time[np.lexsort((nth[in_time], numbers[in_time], events[in_time]))]
                places = np.column_stack([events[order], numbers[order], nth[order]])
                ids, masks = frame["token_ids"].to_numpy(), frame["tgt_mask"].to_numpy()
                # A run is named by the number its first arrival has: no other has it.
                self._wait(int(nth[0]), 0, places, [_whole(ids[i]) for i in order], [_whole(masks[i]) for i in order])
            arrived += len(frame)
            new_late += len(frame) - len(in_time)
        made = 0
        for out in self._lay(timerValues, blocks, tokens, late + new_late, arrived, laid_until):
            made += 1
            yield self._named(key, out)
        if new_late and not made:
            yield self._named(key, self._counted_only(late + new_late))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for out in self._lay(timerValues, *self._counts()):
            yield self._named(key, out)

    def close(self) -> None:
        pass

    def _counts(self) -> tuple[int, int, int, int, int]:
        return tuple(self.counters.get()) if self.counters.exists() else (0, 0, 0, 0, -1)

    def _wake(self, event_us: int | None) -> None:
        """Come back when the watermark has passed the first that waits."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if event_us is not None:
            self.handle.registerTimer(-(-event_us // 1_000))

    def _wait(self, run: int, part: int, places: np.ndarray, ids: list[np.ndarray], masks: list[np.ndarray]) -> None:
        """Keep sorted examples as the parts of a run, from the number ``part`` on."""
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        if any(len(m) != n for m, n in zip(masks, sizes)):
            raise ValueError("a mask is not as long as its ids")
        first, held = 0, 0
        for i, size in enumerate([*sizes.tolist(), None]):
            # An example takes up its place too, if it has no tokens.
            if i > first and (size is None or held + size + PLACE_FIELDS > PART_TOKENS):
                here = np.column_stack([places[first:i], sizes[first:i]])
                value = (here.tobytes(), np.concatenate(ids[first:i]).tobytes(), np.concatenate(masks[first:i]).tobytes())
                self.waiting.updateValue((run, part, int(places[first, 0]), int(places[i - 1, 0])), value)
                first, held, part = i, 0, part + 1
            held += (size or 0) + PLACE_FIELDS

    def _read(self, place: tuple[int, int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places, and ids and mask end to end with where each example begins in them."""
        places, ids, mask = self.waiting.getValue(place)
        places = np.frombuffer(places, dtype=np.int64).reshape(-1, PLACE_FIELDS)
        starts = np.concatenate([[0], np.cumsum(places[:, 3])])
        return places, np.frombuffer(ids, dtype=np.int32), np.frombuffer(mask, dtype=np.int32), starts

    def _in_order(self, run: list[tuple[int, int, int, int]], passed: int, left: list[int]) -> Iterator[tuple]:
        """Examples of a run up to ``passed``, part by part. What has been given goes out of the state."""
        for place in run:
            places, ids, mask, starts = self._read(place)
            n = int(np.searchsorted(places[:, 0], passed, side="right"))
            for (event, number, nth), at, end in zip(places[:n, :3].tolist(), starts[:n].tolist(), starts[1 : n + 1].tolist()):
                yield event, number, nth, ids[at:end], mask[at:end]
            self.waiting.removeKey(place)
            if n < len(places):
                cut = range(n, len(places))
                pieces = lambda values: [values[starts[i] : starts[i + 1]] for i in cut]  # noqa: E731, B023
                self._wait(place[0], place[1], places[n:, :3], pieces(ids), pieces(mask))
                left.append(int(places[n, 0]))
                # The parts behind this one begin no earlier than it goes on.
                return

    def _lay(self, timerValues, blocks: int, tokens: int, late: int, arrived: int, laid_until: int) -> Iterator[dict]:
        """Lay down what nothing can come before any more, and cut off full blocks."""
        passed = timerValues.getCurrentWatermarkInMs() * 1_000
        parts = sorted(tuple(k) for k in self.waiting.keys())
        left = [p[2] for p in parts if p[2] > passed]
        ready = [p for p in parts if p[2] <= passed]
        runs = [self._in_order(list(run), passed, left) for _, run in groupby(ready, key=lambda p: p[0])]
        ids, mask, held = [], [], 0
        if self.rest.exists():
            ids, mask = ([np.frombuffer(v, dtype=np.int32)] for v in self.rest.get())
            held = len(ids[0])
        n = self.context_length
        for _, _, _, more_ids, more_mask in merge(*runs, key=lambda e: e[:3]):
            ids.append(more_ids)
            mask.append(more_mask)
            held += len(more_ids)
            tokens += len(more_ids)
            if held >= max(n, OUT_TOKENS):
                out, ids, mask = self._cut(ids, mask, blocks, late)
                blocks, held = blocks + len(out["block_idx"]), len(ids[0])
                yield out
        if held >= n:
            out, ids, mask = self._cut(ids, mask, blocks, late)
            blocks += len(out["block_idx"])
            yield out
        self.rest.update(tuple(np.concatenate([np.zeros(0, dtype=np.int32), *v]).tobytes() for v in (ids, mask)))
        self._wake(min(left, default=None))
        # What is laid down fixes the past: events up to here are late from now on.
        self.counters.update((blocks, tokens, late, arrived, max(laid_until, passed)))

    def _cut(self, ids: list[np.ndarray], mask: list[np.ndarray], blocks: int, late: int) -> tuple[dict, list, list]:
        """The full blocks, and what is left over."""
        n, ids, mask = self.context_length, np.concatenate(ids), np.concatenate(mask)
        made = len(ids) // n
        out = {
            "block_idx": list(range(blocks, blocks + made)),
            "token_ids": list(ids[: made * n].reshape(made, n)),
            "tgt_mask": list(mask[: made * n].reshape(made, n)),
            "late": [late] * made,
        }
        return out, [ids[made * n :].copy()], [mask[made * n :].copy()]

    def _counted_only(self, late: int) -> dict:
        return {"block_idx": [None], "token_ids": [None], "tgt_mask": [None], "late": [late]}

    def _named(self, key, out: dict) -> pd.DataFrame:
        frame = pd.DataFrame({"block_idx": pd.array(out["block_idx"], "Int64"), **{c: out[c] for c in ("token_ids", "tgt_mask", "late")}})
        for place, (name, value) in enumerate(zip([*self.groups, "lane"], key)):
            frame.insert(place, name, value)
        return frame


def _whole(values, kind=np.int32) -> np.ndarray:
    """Whole numbers of a kind; a null among them or one beyond it is an error."""
    found = np.asarray(values)
    if found.ndim != 1 or (found.size and found.dtype.kind not in "iu"):
        raise ValueError("a null or no whole number among keys, ids or flags")
    kept = found.astype(kind, copy=False)
    if found.dtype.itemsize > kept.dtype.itemsize and (kept != found).any():
        raise ValueError("an id or a flag is beyond int")
    return kept


def lane_of(key: Column, lanes: int, lane_keys: int) -> Column:
    """Ranges of keys dealt out to lanes in turn."""
    return F.pmod(F.floor(key / F.lit(lane_keys)), F.lit(lanes)).cast("int")


def packed_stream(examples: DataFrame, packing: Packing = Packing()) -> DataFrame:
    """Blocks of a streaming DataFrame of ``groups, key, event_time, token_ids, tgt_mask``.

    Rows: the groups, ``lane``, ``block_idx`` (counted per lane), ids, mask, and ``late``: how
    many examples of the lane have come too late so far. A row whose ``block_idx`` is null only
    reports more late ones. Examples of one event time are laid down by key; equal keys as
    they arrived. An example without tokens takes no place.
    """
    lane = lane_of(F.col(packing.key), packing.lanes, packing.lane_keys).alias("lane")
    keyed = examples.withWatermark(packing.event_time, packing.delay).select(
        *packing.groups, lane, packing.key, packing.event_time, "token_ids", "tgt_mask"
    )
    return keyed.groupBy(*packing.groups, "lane").transformWithStateInPandas(
        statefulProcessor=BlockBuilder(packing.context_length, packing.groups, packing.key, packing.event_time),
        outputStructType=T.StructType.fromDDL(block_schema(packing.groups, examples.schema)),
        outputMode="append",
        timeMode="eventTime",
    )


def start(examples: DataFrame, path: str, checkpoint: str, packing: Packing = Packing(), **trigger) -> StreamingQuery:
    """Write the blocks of a stream to ``path``, exactly once over restarts."""
    spark = examples.sparkSession
    if spark.conf.get(PROVIDER, "").rsplit(".", 1)[-1] != ROCKS.rsplit(".", 1)[-1]:
        spark.conf.set(PROVIDER, ROCKS)
    writer = packed_stream(examples, packing).writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
