"""Hard negatives of embeddings, mined by exact integer products in a residue number system.

Components become whole numbers floor(scale * x); a score is the inner product of two rows. For
every anchor the first ``positives`` other rows of its label are its positives, and for each of
these the first ``negatives`` rows of other labels with
``low`` * positive score <= 100 * score <= ``high`` * positive score are its hard negatives. Higher
scores come first, ties by smaller vec_id.

1. A first pass over the table finds the greatest squared length; by Cauchy and Schwarz no score is
   larger. It fixes as many primes as are needed for their product to exceed all scores twice.
2. Rows are packed into slabs, sorted by vec_id, and anchors into blocks; both are written to the
   shared folder. Anchor blocks, a small share of the rows, are sent to every slab, and a task takes
   one slab after another and the blocks one by one past it. So a task holds one slab and one block,
   whatever the table's size, and a lost task is done again from the written tables.
3. For every prime the matrices of remainders, between -p/2 and p/2, are multiplied in float32, WIDTH
   components at a time, so that no sum exceeds 2^24 and all are exact. The exact signed scores
   follow by Chinese remaindering (mixed radix digits).
4. Every slab gives its best ``positives`` rows of an anchor, from products with rows of its label
   only; the best of all slabs are the positives. A second pass selects, in the window of every
   positive, the best ``negatives`` of a slab, and the best of all slabs are returned.

Nulls and ties: rows with a NULL label, a NULL vector, or a NULL, NaN or infinite component take no
part. Rows without vec_id come after all others and are never anchors. "Other rows" are those
of another vec_id. Repeated rows count each; a repeated anchor has its rows repeated. Shorter
vectors are filled up with zeros. Scores are longs: components so large that a score could exceed
2^62 raise an ArithmeticError. Extra columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptsieve.llm.common import prepared, saved

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: Percent of the positive's score.
LOW, HIGH = 50, 95
#: Components multiplied at a time; with primes up to 2 * 2^8, sums stay at or below 2^24.
WIDTH = 256
HALF = 1 << 8
SLAB_ROWS, SLAB_BYTES, BLOCK_ANCHORS, TILE = 1 << 15, 1 << 24, 1 << 10, 1 << 11
#: Sorts rows without vec_id last.
NO_ID = np.iinfo(np.int64).max
NO_SCORE = np.iinfo(np.int64).min
SLABS = "slab long, size int, width int, ids binary, labels binary, matrix binary"
ENTRIES = "block long, place long, anchor_id long, window long, id long, score long"
WINDOWS = "array<struct<place: int, rank: int, low: long, high: long>>"
MATRIX = np.dtype("<i8")


def primes() -> Iterator[int]:
    """Odd primes from 2 * HALF downwards."""
    for n in range(2 * HALF, 2, -1):
        if all(n % k for k in range(2, int(n**0.5) + 1)):
            yield n


def moduli(bound: int) -> list[int]:
    """Primes whose product is more than twice ``bound``."""
    found, product = [], 1
    for p in primes():
        if product > 2 * bound + 1:
            break
        found.append(p)
        product *= p
    return found


def centred(values: np.ndarray, p: int) -> np.ndarray:
    """Remainders between -p/2 and p/2 of whole float64 numbers."""
    return values - p * np.rint(values / p)


def remainders(matrix: np.ndarray, mods: list[int]) -> list[np.ndarray]:
    out = []
    for p in mods:
        r = np.mod(matrix, p)
        out.append(np.where(r > p // 2, r - p, r).astype(np.float32))
    return out


def products(left: list[np.ndarray], right: list[np.ndarray], mods: list[int]) -> np.ndarray:
    """Exact int64 products of the rows of two matrices, given by their remainders."""
    digits: list[np.ndarray] = []
    for k, p in enumerate(mods):
        total = None
        for at in range(0, max(1, left[k].shape[1]), WIDTH):
            part = centred((left[k][:, at: at + WIDTH] @ right[k][:, at: at + WIDTH].T).astype(np.float64), p)
            total = part if total is None else centred(total + part, p)
        for q, digit in zip(mods, digits):
            inverse = pow(q, -1, p)
            total = centred((total - digit) * (inverse - p if inverse > p // 2 else inverse), p)
        digits.append(total)
    scores = digits[-1].astype(np.int64)
    for p, digit in zip(mods[-2::-1], digits[-2::-1]):
        scores *= p
        scores += digit.astype(np.int64)
    return scores


def best(scores: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of the first ``n`` entries of each row of ``scores``, which is used up;
    NO_SCORE is no entry. Columns are in the order of ties."""
    rows = np.arange(len(scores))
    found = []
    for _ in range(min(n, scores.shape[1])):
        at = scores.argmax(axis=1)
        top = scores[rows, at]
        some = top > NO_SCORE
        if not some.any():
            break
        found.append((rows[some], ids[at[some]], top[some]))
        scores[rows, at] = NO_SCORE
    if not found:
        return rows[:0], ids[:0], np.empty(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and whole-number vector of the rows that take part."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    ).where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound)


def _whole(scale: int) -> Column:
    return F.transform("embedding", lambda x: F.floor(x * F.lit(float(scale))).cast("double"))


def extent(rows: DataFrame, scale: int) -> tuple[int, int, int]:
    """(rows, longest vector, bound of all scores)."""
    length = F.aggregate(_whole(scale), F.lit(0.0), lambda s, x: s + x * x)
    found = rows.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width"), F.max(length).alias("norm")).first()
    # Sums of squares are rounded; the bound is taken a little larger.
    norm = (found.norm or 0.0) * (1 + 1e-9) + 1
    if not norm < 2.0**62:
        raise ArithmeticError(f"scores of up to {norm:.3g} are beyond a long")
    return found.n, found.width or 0, int(norm)


def _packed(width: int, scale: int, size: int):
    schema = pa.schema([("slab", pa.int64()), ("size", pa.int32()), ("width", pa.int32()),
                        ("ids", pa.binary()), ("labels", pa.binary()), ("matrix", pa.binary())])

    def pack(frames):
        ids, labels, matrix = (np.concatenate(c) for c in zip(*frames))
        order = np.argsort(ids, kind="stable")
        return pa.RecordBatch.from_arrays(
            [pa.array([v], f.type) for v, f in zip(
                (0, len(ids), width, ids[order].tobytes(), labels[order].tobytes(), matrix[order].tobytes()), schema)],
            schema=schema)

    def run(batches):
        held, count = [], 0
        for batch in batches:
            column = batch.column(2)
            lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
            values = np.floor(column.flatten().to_numpy(zero_copy_only=False) * float(scale)).astype(MATRIX)
            matrix = np.zeros((len(lengths), width), MATRIX)
            row = np.repeat(np.arange(len(lengths)), lengths)
            matrix[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
            ids = pc.fill_null(batch.column(0), NO_ID).to_numpy()
            labels = batch.column(1).to_numpy()
            for at in range(0, len(ids), size):
                part = slice(at, at + size)
                if held and count + len(ids[part]) > size:
                    yield pack(held)
                    held, count = [], 0
                held.append((ids[part], labels[part], matrix[part]))
                count += len(ids[part])
        if held:
            yield pack(held)
    return run


def _slabs(rows: DataFrame, width: int, scale: int, size: int, purpose: str) -> DataFrame:
    """Rows packed into slabs of up to ``size`` rows, numbered, and written."""
    packed = rows.mapInArrow(_packed(width, scale, size), SLABS)
    return saved(packed.withColumn("slab", F.monotonically_increasing_id()), purpose)


class _Slab:
    def __init__(self, row: dict, mods: list[int]):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.labels = np.frombuffer(row["labels"], np.int64)
        matrix = np.frombuffer(row["matrix"], MATRIX).reshape(row["size"], row["width"])
        self.parts = remainders(matrix, mods)

    def part(self, at) -> list[np.ndarray]:
        return [p[at] for p in self.parts]


def _reduced(anchor, window, ids, scores, n: int) -> list[np.ndarray]:
    """The first ``n`` entries of every (anchor, window), higher scores first, then smaller ids."""
    order = np.lexsort((ids, -scores, window, anchor))
    key = np.column_stack([anchor, window])[order]
    new = np.ones(len(order), bool)
    new[1:] = (key[1:] != key[:-1]).any(1)
    first = np.flatnonzero(new)
    rank = np.arange(len(order)) - first[np.cumsum(new) - 1] if len(order) else order
    order = order[rank < n]
    return [c[order] for c in (anchor, window, ids, scores)]


def _find_positives(slab: _Slab, block: dict, anchors: _Slab, mods, n: int):
    """Entries (anchor, 0, id, score) of rows with the anchor's label."""
    order = np.argsort(slab.labels, kind="stable")
    labels = slab.labels[order]
    for label in np.unique(anchors.labels):
        low, high = np.searchsorted(labels, [label, label + 1])
        own = np.flatnonzero(anchors.labels == label)
        left = anchors.part(own)
        for at in range(low, high, TILE):
            place = order[at: min(high, at + TILE)]
            scores = products(left, slab.part(place), mods)
            ids = slab.ids[place]
            scores[anchors.ids[own][:, None] == ids[None, :]] = NO_SCORE
            row, found, score = best(scores, ids, n)
            yield own[row], np.zeros(len(row), np.int64), found, score


def _find_negatives(slab: _Slab, block: dict, anchors: _Slab, mods, n: int):
    """Entries (anchor, positive's rank, id, score) in the windows of the block's positives."""
    wanted = block["windows"] or []
    if not wanted:
        return
    most = max(w["rank"] for w in wanted)
    low = np.full((most, len(anchors.ids)), np.iinfo(np.int64).max)
    high = np.full((most, len(anchors.ids)), NO_SCORE)
    for w in wanted:
        low[w["rank"] - 1, w["place"]], high[w["rank"] - 1, w["place"]] = w["low"], w["high"]
    left = anchors.parts
    for at in range(0, len(slab.ids), TILE):
        ids = slab.ids[at: at + TILE]
        scores = products(left, slab.part(slice(at, at + TILE)), mods)
        scores[anchors.labels[:, None] == slab.labels[at: at + TILE][None, :]] = NO_SCORE
        for k in range(most):
            inside = (scores >= low[k][:, None]) & (scores <= high[k][:, None])
            row, found, score = best(np.where(inside, scores, NO_SCORE), ids, n)
            yield row, np.full(len(row), k + 1), found, score


def _past(find, mods: list[int], n: int):
    """Takes slabs and the anchor blocks that follow each; gives the slab's best entries."""
    schema = pa.schema([(f.split()[0], pa.int64()) for f in ENTRIES.split(", ")])

    def run(batches):
        slab = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] is None:
                    slab = _Slab(row, mods)
                    continue
                anchors = _Slab(row, mods)
                found = list(find(slab, row, anchors, mods, n))
                if not found:
                    continue
                place, window, ids, scores = _reduced(*(np.concatenate(c) for c in zip(*found)), n)
                columns = (np.full(len(place), row["block"]), place, anchors.ids[place], window, ids, scores)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)
    return run


def _searched(slabs: DataFrame, blocks: DataFrame, find, mods: list[int], n: int) -> DataFrame:
    """The ``n`` best of what ``find`` gives for every anchor and window, over all slabs."""
    part = F.shiftright("slab", 33)
    spans = slabs.groupBy(part.alias("part")).agg(F.min("slab").alias("low"), F.max("slab").alias("high")).collect()
    if not spans:
        return slabs.sparkSession.createDataFrame([], ENTRIES + ", rank int")
    every = F.concat(*(F.sequence(F.lit(r.low), F.lit(r.high)) for r in spans))
    columns = ["slab", "block", "size", "width", "ids", "labels", "matrix", "windows"]
    own = slabs.withColumns({"block": F.lit(None).cast("long"), "windows": F.lit(None).cast(WINDOWS)})
    sent = blocks.withColumn("slab", F.explode(every))
    parts = int(slabs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = (
        own.select(columns).union(sent.select(columns))
        .repartition(parts, "slab").sortWithinPartitions("slab", F.col("block").asc_nulls_first())
        .mapInArrow(_past(find, mods, n), ENTRIES)
    )
    order = Window.partitionBy("block", "place", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _share(column: str, percent: int, up: bool) -> Column:
    """percent of a long, rounded up or down."""
    part = F.col(column).cast("decimal(20,0)") * percent
    whole = F.call_function("div", F.abs(part) + F.lit(99).cast("decimal(3,0)"), F.lit(100).cast("decimal(3,0)"))
    down = F.call_function("div", F.abs(part), F.lit(100).cast("decimal(3,0)"))
    positive, negative = (whole, -down) if up else (down, -whole)
    return F.when(part >= 0, positive).otherwise(negative)


def hard_negatives(vectors: DataFrame, anchors: str = "vec_id % 50 = 0", positives: int = POSITIVES,
                   negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. ``vectors`` has
    vec_id, label and embedding; ``anchors`` is the condition that makes a row an anchor."""
    spark = prepared(vectors.sparkSession)
    rows = usable(vectors)
    chosen = rows.where(anchors).where("vec_id is not null")
    count, width, bound = extent(rows, scale)
    mods = moduli(bound)
    size = max(1, min(SLAB_ROWS, SLAB_BYTES // (8 * max(1, width))))
    parts = max(4 * spark.sparkContext.defaultParallelism, -(-count // (64 * size)))
    slabs = _slabs(rows.coalesce(parts), width, scale, size, "slabs")
    per_block = max(1, min(BLOCK_ANCHORS, size))
    dealt = chosen.repartition(max(1, -(-chosen.count() // per_block)))
    blocks = _slabs(dealt, width, scale, per_block, "anchors").withColumnRenamed("slab", "block")
    first = blocks.withColumn("windows", F.lit(None).cast(WINDOWS))
    top = saved(_searched(slabs, first, _find_positives, mods, positives).select(
        "block", "place", "anchor_id", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    windows = top.groupBy("block").agg(F.collect_list(F.struct(
        F.col("place").cast("int").alias("place"), "rank", _share("positive_score", low, True).alias("low"),
        _share("positive_score", high, False).alias("high"))).cast(WINDOWS).alias("windows"))
    found = _searched(slabs, blocks.join(windows, "block"), _find_negatives, mods, negatives).select(
        "block", "place", F.col("window").alias("of"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    best_of = top.withColumnRenamed("rank", "of")
    known = lambda name: F.nullif(F.col(name), F.lit(NO_ID)).alias(name)
    return found.join(best_of, ["block", "place", "of"]).select(
        "anchor_id", known("positive_id"), "rank", known("negative_id"), "positive_score", "negative_score")


SQL = f"""
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, embedding
  from embeddings
  where label is not null and embedding is not null
    and not list_contains(list_transform(embedding, lambda x: x is not null and isfinite(x)), false)
), e as (
  select vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)) as e from v
), s as (
  select a.vec_id as a, b.vec_id as b, a.label = b.label as same, list_dot_product(a.e, b.e)::bigint as score
  from e a join e b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id
), p as (
  select a, b as p, score from s where same qualify row_number() over (partition by a order by score desc, b) <= {POSITIVES}
)
select p.a as anchor_id, p.p as positive_id,
       row_number() over (partition by p.a, p.p order by s.score desc, s.b)::int as rank,
       s.b as negative_id, p.score as positive_score, s.score as negative_score
from p join s on p.a = s.a and not s.same and {LOW} * p.score <= 100 * s.score and 100 * s.score <= {HIGH} * p.score
qualify row_number() over (partition by p.a, p.p order by s.score desc, s.b) <= {NEGATIVES}
"""
