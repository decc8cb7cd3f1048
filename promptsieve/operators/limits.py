"""Rate and connection limits per client."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptsieve import constants as K

_JUDGED = "client string, at bigint, allowed bigint"
_MAPS = "client string, run bigint, block bigint, first bigint, last bigint, los array<array<bigint>>, vals array<array<bigint>>, moving array<array<boolean>>"
_LEVELS = "client string, run bigint, block bigint, level bigint"
#: Pieces of a level map above which it is looked whether fewer levels are left.
_FEW_PIECES = 8


def _units(rate: float, burst: int) -> tuple[int, int, int]:
    """(units of a token, units refilled in a millisecond, units of a full bucket), whole numbers. A
    rate that is no fraction with a denominator up to a million is taken as the nearest one."""
    exact = Fraction(rate).limit_denominator(10**6)
    shared = gcd(exact.numerator, 1000 * exact.denominator)
    unit = 1000 * exact.denominator // shared
    return unit, exact.numerator // shared, burst * unit


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new group of sorted rows begins."""
    changes = np.zeros(max(0, len(keys[0]) - 1), dtype=bool)
    for key in keys:
        changes |= key[1:] != key[:-1]
    return np.flatnonzero(np.append(True, changes))


def _bucket(batches: Iterator[pd.DataFrame], rate: float, burst: int) -> Iterator[pd.DataFrame]:
    """Token bucket over sorted (client, run, at in ms, n); a run starts with a full bucket. Where rows
    have a ``block`` and a ``level``, each block of a run starts with the level of its rows.

    A run that starts full and asks for no more than ``burst`` gets it all, which is settled for all such
    runs of a batch at once; only the others are walked.
    """
    unit, step, full = _units(rate, burst)
    current, last, tokens = None, 0, full
    for batch in batches:
        if batch.empty:
            continue
        client, run, at, n = (batch[c].to_numpy() for c in ("client", "run", "at", "n"))
        block, level = (batch[c].to_numpy() if c in batch else np.full(len(n), v) for c, v in (("block", 0), ("level", full)))
        starts = _starts(client, run, block)
        ends = np.append(starts[1:], len(n))
        allowed = n.copy()
        walked = (np.add.reduceat(n, starts) > burst) | (level[starts] < full)
        walked[0] |= (client[0], run[0], block[0]) == current
        walked[-1] = True  # may go on in the next batch
        for a, b in zip(starts[walked].tolist(), ends[walked].tolist()):
            if (client[a], run[a], block[a]) != current:
                current, last, tokens = (client[a], run[a], block[a]), int(at[a]), int(level[a])
            for k, t, asked in zip(range(a, b), at[a:b].tolist(), n[a:b].tolist()):
                tokens = min(full, tokens + (t - last) * step)
                last = t
                allowed[k] = min(asked, tokens // unit)
                tokens -= int(allowed[k]) * unit
        yield pd.DataFrame({"client": client, "at": at, "allowed": allowed})


# A map of levels: pieces (lo, val, width, moving) in order of lo. Levels lo to lo + width - 1 become val, or,
# in a moving piece, val and what they are above lo.
Piece = tuple[int, int, int, bool]


def _append(pieces: list[Piece], lo: int, val: int, width: int, moving: bool) -> None:
    """Add the next piece, as part of the one before where both are one."""
    if pieces and pieces[-1][3] == moving and pieces[-1][1] + (pieces[-1][2] if moving else 0) == val:
        first = pieces[-1]
        pieces[-1] = (first[0], first[1], first[2] + width, moving)
    else:
        pieces.append((lo, val, width, moving))


def _after_tick(pieces: list[Piece], refill: int, asked: int, unit: int, full: int) -> list[Piece]:
    """The map after a refill and then ``asked`` events: a level gives as many whole tokens as it has."""
    out: list[Piece] = []
    for lo, val, width, moving in pieces:
        val += refill
        free = min(width, full - val) if moving else 0  # levels that the bucket's size does not cut
        at, end = val, val + max(0, free)
        while at < end:
            held = at // unit
            until = end if held >= asked else min(end, (held + 1) * unit)
            _append(out, lo + at - val, at - min(asked, held) * unit, until - at, True)
            at = until
        if end - val < width:
            top = min(val, full) if not moving else full
            _append(out, lo + end - val, top - min(asked, top // unit) * unit, width - (end - val), False)
    return out


def _images(pieces: list[Piece]) -> list[Piece]:
    """The levels that pieces lead to, each once, as pieces that leave them as they are."""
    out: list[Piece] = []
    for val, end in sorted((p[1], p[1] + (p[2] if p[3] else 1)) for p in pieces):
        if out and val <= out[-1][0] + out[-1][2]:
            start, _, width, _ = out[-1]
            out[-1] = (start, start, max(width, end - start), True)
        else:
            out.append((val, val, end - val, True))
    return out


class _LevelMap:
    """What a block of ticks makes of every level that the bucket can have at its first tick.

    It is a chain of maps. A flood takes all whole tokens, so that many levels lead to the same few ones, and a
    full bucket makes all levels one: when the levels that are left are fewer pieces than the map has, it is
    put aside and a new one begun over them.
    """

    def __init__(self, first: int, rate: float, burst: int):
        self.unit, self.step, self.full = _units(rate, burst)
        self.first = self.last = first
        self.done: list[list[Piece]] = []
        self.pieces: list[Piece] = [(0, 0, self.full + 1, True)]
        self.look = _FEW_PIECES

    def add(self, at: int, asked: int) -> None:
        self.pieces = _after_tick(self.pieces, (at - self.last) * self.step, asked, self.unit, self.full)
        self.last = at
        if len(self.pieces) > self.look:
            left = _images(self.pieces)
            if 2 * len(left) <= len(self.pieces):
                self.done.append(self.pieces)
                self.pieces = left
            self.look = max(_FEW_PIECES, 2 * len(self.pieces))

    def row(self) -> tuple:
        chain = [*self.done, self.pieces]
        return self.first, self.last, *([[p[i] for p in pieces] for pieces in chain] for i in (0, 1, 3))


def _level_after(los, vals, moving, level: int) -> int:
    """The level at the last tick of a block, of that at its first."""
    for lo, val, goes in zip(los, vals, moving):
        i = bisect_right(lo, level) - 1
        level = int(val[i]) + (level - int(lo[i]) if goes[i] else 0)
    return level


def _maps(batches: Iterator[pd.DataFrame], rate: float, burst: int) -> Iterator[pd.DataFrame]:
    """Level maps of sorted (client, run, block, at, n), a row per block."""
    names = [c.split()[0] for c in _MAPS.split(", ")]
    current, levels = None, None
    for batch in batches:
        if batch.empty:
            continue
        client, run, block, at, n = (batch[c].to_numpy() for c in ("client", "run", "block", "at", "n"))
        starts = _starts(client, run, block)
        rows = []
        for a, b in zip(starts.tolist(), np.append(starts[1:], len(n)).tolist()):
            key = (client[a], int(run[a]), int(block[a]))
            if key != current:
                if current is not None:
                    rows.append((*current, *levels.row()))
                current, levels = key, _LevelMap(int(at[a]), rate, burst)
            for t, asked in zip(at[a:b].tolist(), n[a:b].tolist()):
                levels.add(t, asked)
        yield pd.DataFrame(rows, columns=names)
    if current is not None:
        yield pd.DataFrame([(*current, *levels.row())], columns=names)


def _first_levels(batches: Iterator[pd.DataFrame], rate: float, burst: int) -> Iterator[pd.DataFrame]:
    """The level at the first tick of each block, from sorted maps: a step per block."""
    _, step, full = _units(rate, burst)
    current, level, last = None, full, 0
    for batch in batches:
        rows = []
        for client, run, block, first, end, los, vals, moving in batch.itertuples(index=False):
            if (client, run) != current:
                current, level = (client, run), full
            else:
                level = min(full, level + (first - last) * step)
            rows.append((client, run, block, level))
            level, last = _level_after(los, vals, moving, level), end
        yield pd.DataFrame(rows, columns=["client", "run", "block", "level"])


def _runs(ticks: DataFrame, slot_ms: int, rate: float, burst: int = K.RATE_BURST, block_ticks: int = 20_000) -> DataFrame:
    """(client, slot, run, block, parts): a run begins with a slot at whose first event the bucket is full, even
    if every event before it had been admitted, so it does not depend on what came before.

    With x = events asked for before a moment, less tokens refilled up to it, the bucket is full
    where x falls to a new minimum. Both parts are summed in two levels, per slot and over a
    client's slots, so a client that never idles is spread over its slots. Beginnings within
    rounding of the minimum are left out; a longer run gives the same answer.

    A run of more than ``block_ticks`` ticks that asks for more than ``burst`` is cut: ``block`` is the number of
    the block that its slot begins in, ``parts`` how many pieces of equal length the slot itself is cut into.
    Both are NULL for other runs.
    """
    refilled = lambda at: (at - F.col("slot") * slot_ms) * (rate / 1000.0)
    within = Window.partitionBy("client", "slot").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    asked = F.coalesce(F.sum("n").over(within), F.lit(0))
    slots = ticks.withColumn("x", asked - refilled(F.col("at"))).groupBy("client", "slot").agg(
        F.sum("n").alias("n"), F.count("*").alias("ticks"), F.min("x").alias("low"), (-refilled(F.min("at"))).alias("first"))
    order = Window.partitionBy("client").orderBy("slot")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("slot") * (slot_ms * rate / 1000.0)
    lowest = F.min(F.col("level") + F.col("low")).over(before)
    slack = 1e-3 + F.abs("level") * 1e-12
    begins = F.coalesce(F.col("level") + F.col("first") <= lowest - slack, F.lit(True))
    whole = Window.partitionBy("client", "run")
    cut = (F.sum("ticks").over(whole) > block_ticks) & (F.sum("n").over(whole) > burst)
    block = F.floor(F.coalesce(F.sum("ticks").over(before), F.lit(0)) / block_ticks)
    return (
        slots.withColumn("level", level).withColumn("begin", F.when(begins, F.col("slot")))
        .select("client", "slot", "n", "ticks", block.alias("block"), F.last("begin", ignorenulls=True).over(order).alias("run"))
        .select("client", "slot", "run", F.when(cut, F.col("block")).alias("block"),
                F.when(cut, F.ceil(F.col("ticks") / block_ticks)).alias("parts"))
    )


def _judged(ticks: DataFrame, rate: float, burst: int) -> DataFrame:
    """(client, at, allowed) of ticks (client, run, block, at, n); the blocks of a run, where it has any, apart."""
    keys = ["client", "run", "block"]
    maps = ticks.where("block is not null").repartition(*keys).sortWithinPartitions(*keys, "at").select(*keys, "at", "n").mapInPandas(
        lambda b: _maps(b, rate, burst), _MAPS)
    levels = maps.repartition("client", "run").sortWithinPartitions(*keys).mapInPandas(
        lambda b: _first_levels(b, rate, burst), _LEVELS)
    full = _units(rate, burst)[2]
    placed = ticks.join(levels, keys, "left").select(
        "client", "run", F.coalesce("block", F.lit(0)).alias("block"), "at", "n", F.coalesce("level", F.lit(full)).alias("level"))
    return placed.repartition(*keys).sortWithinPartitions(*keys, "at").mapInPandas(
        lambda b: _bucket(b, rate, burst), _JUDGED)


def _networks(lists: DataFrame, name: str) -> DataFrame:
    """Integer ranges of addresses and CIDR blocks."""
    bits = F.coalesce(F.split_part("cidr", F.lit("/"), F.lit(2)).try_cast("int"), F.lit(32))
    size = F.pow(F.lit(2.0), 32 - bits).cast("bigint")
    start = F.floor(ip_number(F.split_part("cidr", F.lit("/"), F.lit(1))) / size) * size
    return lists.where(F.col("list") == name).select(
        start.alias("_from"), (start + size - 1).alias("_to"), bits.alias("_bits"))


def ip_number(ip) -> Column:
    """IPv4 address as a number, NULL if it is none."""
    part = lambda i: F.split_part(ip, F.lit("."), F.lit(i)).try_cast("bigint")
    return F.when(
        ip.rlike(r"\A\d{1,3}(\.\d{1,3}){3}\z"),
        part(1) * 16777216 + part(2) * 65536 + part(3) * 256 + part(4))


def _listed(df: DataFrame, lists: DataFrame, name: str, client: str) -> DataFrame:
    """Flag rows whose client address is on a list, as one equi-join per prefix length on the
    masked address: a range join without comparing all pairs."""
    ranges = _networks(lists, name).select("_bits", "_from").distinct()
    lengths = [r[0] for r in ranges.select("_bits").distinct().collect()]  # at most 33 rows
    if not lengths:
        return df.withColumn(f"_{name}", F.lit(False))
    masks = F.array(*[F.struct(
        F.lit(b).alias("bits"),
        (F.floor(ip_number(F.col("client")) / (1 << (32 - b))) * (1 << (32 - b))).cast("bigint").alias("net"))
        for b in lengths])
    clients = df.select(F.col(client).alias("client")).distinct()
    hits = (
        clients.select("client", F.inline(masks))
        .join(ranges, (F.col("bits") == F.col("_bits")) & (F.col("net") == F.col("_from")), "left_semi")
        .select(F.col("client").alias(client), F.lit(True).alias(f"_{name}")).distinct()
    )
    return df.join(hits, client, "left").withColumn(f"_{name}", F.coalesce(f"_{name}", F.lit(False)))


def rate_limit(
    events: DataFrame, client: str = "client", ts: str = "ts", event_id: str = "event_id",
    rate: float = K.RATE_PER_SECOND, burst: int = K.RATE_BURST, lists: DataFrame | None = None,
    block_ticks: int = 20_000,
) -> DataFrame:
    """Append ``decision``: blocked (block list), listed (allow list), allowed, limited.

    lists: (list = allow | block, cidr). Lists come first; then a token bucket per client of
    ``burst`` tokens refilled at ``rate`` per second. A limited event takes no token.

    The bucket is sequential per client, so its input is cut down: events of one millisecond
    are one row (combined before the shuffle); wherever the bucket must be full again, a run
    begins that does not depend on the ones before (``_runs``). A run that asks for more than its
    rate is cut into blocks of about ``block_ticks`` milliseconds with events: each block says, by itself, what it makes of every
    level the bucket can have before it (``_LevelMap``); one step per block then finds the level each
    begins with, and the blocks are judged apart. Levels are whole numbers, so cuts change nothing.
    The counts are then joined back on (client, millisecond). Events without a time are not
    metered: their decision is NULL.
    """
    if lists is None:
        listed = events.withColumns({"_block": F.lit(False), "_allow": F.lit(False)})
    else:
        listed = _listed(_listed(events, lists, "block", client), lists, "allow", client)
    timed = listed.withColumns({
        "_client": F.coalesce(F.col(client).cast("string"), F.lit("unknown")), "_at": F.unix_millis(F.col(ts).cast("timestamp"))})
    metered = timed.where(~F.col("_block") & ~F.col("_allow"))
    slot_ms = max(1, int(-(-burst * 1000 // rate)))
    ticks = metered.groupBy(F.col("_client").alias("client"), F.col("_at").alias("at")).agg(
        F.count("*").alias("n")).withColumn("slot", F.floor(F.col("at") / slot_ms)).where(
        "client is not null and slot is not null")
    runs = _runs(ticks, slot_ms, rate, burst, block_ticks)
    block = F.col("block") + F.floor((F.col("at") - F.col("slot") * slot_ms) * F.col("parts") / slot_ms)
    placed = ticks.join(runs, ["client", "slot"]).select("client", "run", block.alias("block"), "at", "n")
    judged = _judged(placed, rate, burst).select(F.col("client").alias("_client"), F.col("at").alias("_at"), "allowed")
    # Only a millisecond that was cut short needs its events told apart by id.
    nth = F.row_number().over(Window.partitionBy("_client", "_at", "_block", "_allow").orderBy(event_id))
    decision = (
        F.when(F.col("_block"), "blocked").when(F.col("_allow"), "listed")
        .when(F.col("_at").isNull(), F.lit(None))
        .when(nth <= F.col("allowed"), "allowed").otherwise("limited")
    )
    return timed.join(judged, ["_client", "_at"], "left").select(*events.columns, decision.alias("decision"))


def concurrency(
    intervals: DataFrame, client: str = "client", limit: int = K.CONNECTION_LIMIT,
    slot_seconds: int = 3600,
) -> DataFrame:
    """Most simultaneous connections per client (started_at, ended_at), and whether the limit
    was passed. A connection that ends when another starts does not overlap it.

    A running sum of +1/-1 events in two levels: changes are summed per instant and per time
    slot before any window, so a busy client is spread over its slots.
    """
    changes = intervals.select(F.col(client).alias("client"), F.inline(F.array(
        F.struct(F.unix_micros(F.col("started_at").cast("timestamp")).alias("at"), F.lit(1).alias("d")),
        F.struct(F.unix_micros(F.col("ended_at").cast("timestamp")).alias("at"), F.lit(-1).alias("d")),
    )))
    instants = changes.groupBy("client", "at").agg(F.sum("d").alias("d")).withColumn(
        "slot", F.floor(F.col("at") / (slot_seconds * 1_000_000)))
    before = Window.partitionBy("client").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = instants.groupBy("client", "slot").agg(F.sum("d").alias("d")).select(
        "client", "slot", F.coalesce(F.sum("d").over(before), F.lit(0)).alias("open"))
    within = Window.partitionBy("client", "slot").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    now = instants.join(starts, ["client", "slot"]).select(
        "client", (F.col("open") + F.sum("d").over(within)).alias("now"))
    return now.groupBy(F.col("client").alias(client)).agg(
        F.max("now").alias("max_open"), (F.max("now") > limit).alias("over_limit"))
