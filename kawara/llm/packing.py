"""Best-fit packing of token sequences by patterns of lengths.

Only the histogram of piece lengths reaches the driver (at most LIMIT numbers, whatever the corpus). There, patterns
of a few lengths that fill a sequence exactly are enumerated, and non-negative least squares fits how often each is
repeated to the histogram: rows are weighted by one over their count, so that every length matters alike, and
coordinate descent from 0 leaves the support sparse, so that the repeats stay whole where they can. Lengths that are
still short draw new patterns for some rounds. The repeats are rounded, cut to what the histogram holds, the fit runs
once more on what is left, and the residual is packed best-fit, again as patterns with repeats.

The plan has one slot for each (pattern, position): a first rank among the pieces of that length, a number of repeats,
the first sequence and the offset. Pieces are ranked by length in Spark, in groups of about GROUP rows, so that one
length may hold any share of all rows; each piece finds its slot by binary search in the plan, which grows with the
number of distinct lengths (some tens of thousands of slots), not with the corpus.

Defined results: a null or empty text is one piece that holds only the end token. Repeated rows are pieces of their
own. An empty table gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kawara.llm import bpe
from kawara.llm.common import map_rows, written

LIMIT = 4096
END = 1
#: Pieces of one length that are ranked together, about.
GROUP = 2_000
#: Draws of each number of parts in a round, rounds and sweeps of the fit, and fits one after the other.
DRAWS, ROUNDS, SWEEPS, PASSES = 3_000, 3, 4, 2
#: Parts of a pattern: one more than a sequence holds on average, within these bounds.
LEAST_PARTS, MOST_PARTS = 6, 12

_END_BYTES = np.array([END], "<u4").tobytes()


def _cut(coder, doc_id, ids: bytes):
    ids += _END_BYTES
    for piece, start in enumerate(range(0, len(ids), 4 * LIMIT)):
        part = ids[start : start + 4 * LIMIT]
        yield doc_id, piece, start // 4, len(part) // 4, zlib.crc32(part)


def pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    return bpe.encode_with(docs, "doc_id long, piece int, start long, length long, ids_crc32 long", _cut, path)


def enumerate_patterns(counts: np.ndarray, weight: np.ndarray, parts: int, draws: int, rng, limit: int = LIMIT) -> set[tuple[int, ...]]:
    """Patterns of lengths in the histogram that sum to the limit.

    All single lengths and pairs are taken; of larger patterns all lengths but the last are drawn by weight, and the
    last one is what closes the sequence.
    """
    present = np.flatnonzero(counts)
    there = counts > 0
    found = {(limit,)} if there[limit] else set()
    low = present[(present > 0) & (present <= limit // 2)]
    found |= {(int(a), limit - int(a)) for a in low[there[limit - low]]}
    small = present[(present > 0) & (present < limit)]
    if len(small):
        p = weight[small] / weight[small].sum()
        for n in range(3, parts + 1):
            draw = rng.choice(small, (draws, n - 1), p=p)
            rest = limit - draw.sum(1)
            good = (rest > 0) & there[np.clip(rest, 0, limit)]
            rows = np.sort(np.column_stack([draw[good], rest[good]]), axis=1)
            found |= set(map(tuple, rows.tolist()))
    return found


def fit(counts: np.ndarray, parts: int, rng, limit: int = LIMIT) -> dict[tuple[int, ...], float]:
    """Repeats x > 0 of patterns that minimise the misfit of their lengths to the histogram, squared over the counts."""
    left, draws = counts.astype(float), min(DRAWS, 4 * int(counts.sum()) + 100)
    scale = 1 / np.maximum(left, 1)
    x: dict[tuple[int, ...], float] = {}
    columns: dict[tuple[int, ...], tuple[list[int], list[int], float]] = {}
    for _ in range(ROUNDS):
        for p in enumerate_patterns(counts, np.maximum(left, 0) + 1e-3 * counts, parts, draws, rng, limit):
            if p not in columns:
                lengths, each = np.unique(p, return_counts=True)
                if (each <= counts[lengths]).all():
                    columns[p] = lengths.tolist(), each.tolist(), float((each * each * scale[lengths]).sum())
        order = sorted(columns, key=lambda p: (len(p), -p[-1], p))
        short, weigh = left.tolist(), scale.tolist()
        for _ in range(SWEEPS):
            for p in order:
                lengths, each, size = columns[p]
                old = x.get(p, 0.0)
                new = max(0.0, old + sum(m * short[k] * weigh[k] for k, m in zip(lengths, each, strict=True)) / size)
                if new != old:
                    x[p] = new
                    for k, m in zip(lengths, each, strict=True):
                        short[k] -= m * (new - old)
        left = np.array(short)
        x = {p: v for p, v in x.items() if v > 1e-9}
        columns = {p: columns[p] for p in x}
    return x


def best_fit(left: np.ndarray, limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that pack all of left: the longest piece first, then the longest that still fits."""
    left, plan = left.copy(), []
    lengths = [int(x) for x in np.flatnonzero(left)]
    top = len(lengths) - 1
    while top >= 0:
        if not left[lengths[top]]:
            top -= 1
            continue
        room, pattern, used = limit, [], {}
        i = top
        while room > 0 and i >= 0:
            # the longest length not over room: the list is sorted, and only what is in it can be there
            i = min(i, int(np.searchsorted(lengths, room, side="right")) - 1)
            while i >= 0 and left[lengths[i]] - used.get(lengths[i], 0) <= 0:
                i -= 1
            if i < 0:
                break
            pattern.append(lengths[i])
            used[lengths[i]] = used.get(lengths[i], 0) + 1
            room -= lengths[i]
        repeats = min(int(left[k]) // v for k, v in used.items())
        for k, v in used.items():
            left[k] -= v * repeats
        plan.append((tuple(pattern), repeats))
        if len(plan) % 256 == 0:
            top_length = lengths[top]
            lengths = [x for x in lengths if left[x]]
            top = int(np.searchsorted(lengths, top_length, side="right")) - 1
    return plan


def fitted(counts: np.ndarray, limit: int = LIMIT) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """(pattern, repeats) from the rounded fit, and what they leave of the histogram."""
    left, out = counts.astype(np.int64).copy(), []
    least = max(1, lower_bound(left, limit))
    parts = int(np.clip(-(-int(left.sum()) // least) + 1, LEAST_PARTS, MOST_PARTS))
    rng = np.random.default_rng(7)
    for k in range(PASSES):
        x = fit(left, parts, rng, limit) if left.any() else {}
        for p in sorted(x, key=lambda p: (-x[p], -p[-1], p)):
            lengths, each = np.unique(p, return_counts=True)
            # a pattern fills its sequence exactly, so at the end a fraction may become one
            n = max(int(x[p] + 0.5), int(k == PASSES - 1))
            n = min(n, int((left[lengths] // each).min()))
            if n:
                left[lengths] -= each * n
                out.append((p, n))
    return out, left


def lower_bound(counts: np.ndarray, limit: int = LIMIT) -> int:
    """Sequences that the tokens alone need."""
    return -(-int((counts * np.arange(len(counts))).sum()) // limit)


def plan(counts: np.ndarray, limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that hold each piece of the histogram exactly once."""
    found, left = fitted(counts, limit)
    found = found + best_fit(left, limit)
    needs = lambda rows: sum(n for _, n in rows)
    if needs(found) > lower_bound(counts, limit):
        # the patterns may have used up the small pieces: then best fit from the start does better
        found = min(found, best_fit(counts.astype(np.int64), limit), key=needs)
    return found


def slots(packed: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, repeats, first sequence, offset) for each position of each pattern."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, repeats in packed:
        offset = 0
        for length in pattern:
            first = taken.get(length, 0)
            out.append((length, first, repeats, sequence, offset))
            taken[length] = first + repeats
            offset += length
        sequence += repeats
    return out


def histogram(rows: DataFrame) -> np.ndarray:
    """Pieces of each length."""
    counts = np.zeros(LIMIT + 1, np.int64)
    for length, n in rows.groupBy("length").count().collect():  # LIMIT rows at most
        counts[length] = n
    return counts


def ranked(rows: DataFrame, counts: np.ndarray) -> DataFrame:
    """rows with rank, from 0 among those of their length."""
    groups = [(int(k), int(-(-counts[k] // GROUP))) for k in np.flatnonzero(counts)]  # LIMIT rows at most
    groups = rows.sparkSession.createDataFrame(groups, "length long, groups long")
    salted = rows.join(F.broadcast(groups), "length")
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.col("groups"))).drop("groups")
    per = salted.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = salted.withColumn("rank", F.row_number().over(within) - 1).join(per, ["length", "salt"])
    return numbered.select(*rows.columns, (F.col("rank") + F.col("before")).cast("long").alias("rank"))


def pack(rows: DataFrame) -> DataFrame:
    """rows (doc_id, piece, length, ...) with sequence_id and offset added. rows is read three times: write it first."""
    counts = histogram(rows)
    # one number for (length, rank): ranks stay under 2**50, lengths under 2**13
    found = np.array(sorted((k << 50 | first, sequence - first, offset) for k, first, _, sequence, offset in slots(plan(counts))), np.int64).reshape(-1, 3)

    names = rows.columns

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            own = {n: batch.column(n) for n in names}
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(found[:, 0], batch.column("length").to_numpy() << 50 | rank, side="right") - 1
            return own | {"sequence_id": found[at, 1] + rank, "offset": found[at, 2]}

        return step

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return map_rows(ranked(rows, counts), f"{schema}, sequence_id long, offset long", make)


def packed(docs: DataFrame, path: str | None = None) -> DataFrame:
    return pack(written(pieces(docs, path), "pieces"))
