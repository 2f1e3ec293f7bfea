"""Near-duplicate classes from DartMinHash signatures (Christiani, 2020) and exact verification.

A document is the multiset of its 5-word shingles: a shingle that occurs w times has weight w. Darts are thrown at
the plane of each shingle (weight across, rank upwards): every cell of one unit of weight and 1 / K of rank gets a
Poisson(1) number of darts, all drawn from a hash of (shingle, cell), so equal regions hold equal darts in every
document. A dart belongs to one of K coordinates, and a coordinate keeps its dart of lowest rank. Two documents keep
the same dart with a probability that is their weighted Jaccard similarity. Rank rows are thrown from the lowest up
until all coordinates have a dart, so a document costs O(shingles + K log K), not O(shingles * K).

Bands of the signature give candidates. Candidates are checked with their whole texts: a link needs a weighted
Jaccard similarity of THRESHOLD. Classes are the connected components of the links.

In a band's bucket the smallest document is compared with each other member (a star, never all pairs). Buckets that
still hold more than one component afterwards are worked off exactly, in blocks of at most BLOCK or so on either side:
members outside the bucket's largest component meet all its members by their signatures, and partners in other components that agree are verified with
their texts on the spot, in the first band that a pair shares. A pair whose components have been linked meanwhile is
passed over, so a block gives out fewer links than it has components.

Defined results: a null text counts as empty; equal texts always share a class; a text of fewer than five words is
one shingle of all its words; a text without words joins equal texts only. Where rows share a doc_id or have none,
each row is a document of its own, and a class is named by the smallest doc_id of its rows (null if none has one). An
empty table gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kawara.llm.common import BROADCAST_IDS, Rolling, WordHashes, hashed_text, keyed, map_rows, mixed, with_ids, written
from kawara.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
#: 20 bands of 5 coordinates: at a similarity of 0.8 a pair shares a band with probability 0.9996.
BANDS, ROWS = 20, 5
K = BANDS * ROWS
#: Pairs whose signatures agree on less than this share are not verified in the second pass: four standard errors
#: of the estimate below THRESHOLD.
LEAST_AGREEMENT = THRESHOLD - 4 * (THRESHOLD * (1 - THRESHOLD) / K) ** 0.5
BLOCK = 512
#: Pairs of one document that are verified side by side.
HOT = 256

#: Poisson(1): upper ends of 0, 1, 2, ... darts on the scale of 2**32.
_POISSON = np.round(np.cumsum(np.exp(-1) / np.cumprod([1, *range(1, 12)])) * 2**32).astype(np.uint64)


def elements(text: bytes, words: WordHashes, rolling: Rolling) -> np.ndarray:
    """Sorted hashes of (shingle, occurrence): as a set they have the multiset's weighted Jaccard similarity."""
    found = words.of(text.split())
    if not len(found):
        return found
    shingles = np.sort(rolling(found) if len(found) >= SHINGLE else Rolling(len(found))(found))
    first = np.ones(len(shingles), bool)
    first[1:] = shingles[1:] != shingles[:-1]
    if not first.all():
        starts = np.flatnonzero(first)
        occurrence = np.arange(len(shingles)) - np.repeat(starts, np.diff(np.append(starts, len(shingles))))
        shingles = np.sort(mixed(shingles + occurrence.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)))
    else:
        shingles = np.sort(mixed(shingles))
    return shingles


def signature(unit_cells: np.ndarray) -> np.ndarray:
    """The darts kept, one 64-bit number for each of K coordinates: the rank row, then the dart's height in it.

    unit_cells: a hash of each (element, unit of weight).
    """
    kept = np.full(K, np.iinfo(np.uint64).max, np.uint64)
    at_once, row = max(1, 8 * K // max(1, len(unit_cells))), 0
    while len(unit_cells):
        rows = np.arange(row, row + at_once, dtype=np.uint64)
        cells = mixed((unit_cells + (rows[:, None] + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)).ravel())
        count = np.searchsorted(_POISSON, cells >> np.uint64(32), side="right")
        darts = np.repeat(cells, count)
        number = np.arange(len(darts)) - np.repeat(np.cumsum(count) - count, count)
        darts = mixed(darts + (number + 1).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        place = ((darts >> np.uint64(32)) * np.uint64(K)) >> np.uint64(32)
        rank = (np.repeat(np.repeat(rows, len(unit_cells)), count) << np.uint64(44)) | (mixed(darts) >> np.uint64(20))
        np.minimum.at(kept, place.astype(np.int64), rank)
        row += at_once
        if (kept != np.iinfo(np.uint64).max).all():
            break
    return kept


def _signer():
    words, rolling = WordHashes(), Rolling(SHINGLE)

    def step(batch: pa.RecordBatch) -> dict:
        texts = batch.column(1).to_pylist()
        out = {"doc_id": batch.column(0), "digest": [], "bands": [], "signature": []}
        for text in texts:
            out["digest"].append(xxhash.xxh3_128_digest(text))
            found = elements(text, words, rolling)
            if not len(found):
                out["bands"].append([])
                out["signature"].append(b"")
                continue
            kept = signature(found)
            bands = mixed(np.arange(BANDS, dtype=np.uint64))
            for k in range(ROWS):
                bands = mixed(bands + kept[k::ROWS])
            out["bands"].append(bands.view(np.int64))
            out["signature"].append(mixed(kept).astype("<u2").tobytes())
        return out

    return step


def signatures(docs: DataFrame) -> DataFrame:
    return map_rows(hashed_text(docs), "doc_id long, digest binary, bands array<long>, signature binary", _signer)


def _judge():
    words, rolling = WordHashes(), Rolling(SHINGLE)

    def step(batch: pa.RecordBatch) -> dict:
        out = {"a": batch.column(0), "b": batch.column(1), "similarity": []}
        last: tuple = (None, None)
        for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x = elements(left, words, rolling)
            if right != last[0]:
                last = right, elements(right, words, rolling)
            out["similarity"].append(similarity(x, last[1]))
        return out

    return step


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b) of documents, those whose whole texts reach THRESHOLD. doc_id has to be a key of docs.

    A document may be the b of any share of the pairs: beyond HOT pairs its text is given to several parts, and the
    pairs are dealt over them.
    """
    ends = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))
    texts = with_ids(hashed_text(docs), ends)
    hot = pairs.groupBy("b").count().where(F.col("count") > HOT).select("b", F.ceil(F.col("count") / HOT).cast("int").alias("parts"))
    hot = written(hot, "hot")
    if hot.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        hot = F.broadcast(hot)
    parts = F.coalesce("parts", F.lit(1))
    dealt = pairs.join(hot, "b", "left").withColumn("part", F.pmod(F.xxhash64("a"), parts).cast("int")).drop("parts")
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("right")).join(hot, "b", "left")
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    rows = dealt.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("left")), "a").join(right, ["b", "part"])
    judged = map_rows(rows.select("a", "b", "left", "right"), "a long, b long, similarity double", _judge)
    return judged.where(F.col("similarity") >= THRESHOLD)


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _settled(strays: pa.Table, members: pa.Table) -> pa.Table:
    """Links that join the components of one block of a bucket."""
    if not len(strays) or not len(members):
        return _LINK.empty_table()
    words, rolling = WordHashes(), Rolling(SHINGLE)
    made: dict[int, np.ndarray] = {}
    top: dict[int, int] = {}

    def find(comp: int) -> int:
        while (up := top.get(comp, comp)) != comp:
            comp = up
        return comp

    def bag(side: tuple, i: int) -> np.ndarray:
        if (own := side[0][i]) not in made:
            made[own] = elements(side[4][i].as_py(), words, rolling)
        return made[own]

    def read(t: pa.Table) -> tuple:
        wide = lambda name, kind, n: np.frombuffer(b"".join(t.column(name).to_pylist()), kind).reshape(len(t), n)
        keys = np.array(t.column("bands").to_pylist(), np.int64)
        return t.column("id").to_numpy(), t.column("comp").to_numpy(), wide("signature", "<u2", K), keys, t.column("text")

    x, y = read(strays), read(members)
    band, most = strays.column("band")[0].as_py(), strays.column("most")[0].as_py()
    here = int(np.flatnonzero(x[3][0] == band)[0])
    left, right, agreement = [], [], []
    for i in range(len(strays)):
        agree = (y[2] == x[2][i]).sum(1)
        fit = (agree >= LEAST_AGREEMENT * K) & (y[1] != x[1][i])
        fit &= (y[1] == most) | (y[0] < x[0][i])  # of two strays, one asks
        hit = np.flatnonzero(fit)
        if here and len(hit):
            hit = hit[~(y[3][hit, :here] == x[3][i, :here]).any(1)]
        left.append(np.full(len(hit), i))
        right.append(hit)
        agreement.append(agree[hit])
    left, right = np.concatenate(left), np.concatenate(right)
    out = []
    for k in np.argsort(-np.concatenate(agreement), kind="stable"):
        i, j = left[k], right[k]
        p, q = find(x[1][i]), find(y[1][j])
        if p != q and similarity(bag(x, i), bag(y, j)) >= THRESHOLD:
            top[p] = q
            out.append((max(x[0][i], y[0][j]), min(x[0][i], y[0][j])))
    return pa.Table.from_arrays([pa.array([r[n] for r in out], pa.int64()) for n in (0, 1)], schema=_LINK)


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Weighted Jaccard similarity of two documents' elements."""
    if not len(x) or not len(y):
        return 0.0
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    common = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
    return common / (len(x) + len(y) - common)


def _open_rows(full: DataFrame, found: DataFrame) -> DataFrame:
    """The members of buckets that hold more than one component, with the bucket's largest and its numbers of blocks."""
    full = full.join(found, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    per = full.groupBy("band", "comp").agg(F.count("*").alias("rows"))
    several = per.groupBy("band").agg(
        F.max_by("comp", F.struct("rows", "comp")).alias("most"), F.count("*").alias("comps"), F.sum("rows").alias("n"), F.max("rows").alias("top")
    )
    several = several.where("comps > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    several = several.withColumn("stray_blocks", F.ceil((F.col("n") - F.col("top")) / BLOCK).cast("int"))
    return full.join(several.select("band", "most", "blocks", "stray_blocks"), "band")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id) for each row: class_id is the smallest doc_id of the row's near-duplicate class."""
    rows = keyed(docs.select("doc_id", "text"))
    if rows is None:
        return classes(docs)
    found = classes(rows.select(F.col("row_key").alias("doc_id"), "text"))
    own = rows.select(F.col("row_key").alias("key"), F.col("doc_id").alias("own_id"))
    named = found.withColumnsRenamed({"doc_id": "key", "class_id": "first"}).join(own, "key")
    # keys follow the order of the doc_ids, so a class's smallest key has its smallest doc_id
    first = own.withColumnsRenamed({"key": "first", "own_id": "class_id"})
    return named.join(first, "first").select(F.col("own_id").alias("doc_id"), "class_id")


def classes(docs: DataFrame) -> DataFrame:
    """As near_duplicates(), where doc_id is a key."""
    signed = written(signatures(docs), "signatures")
    copies = signed.groupBy("digest").agg(
        F.min("doc_id").alias("id"), F.min_by(F.struct("bands", "signature"), "doc_id").alias("s")
    )
    copies = written(copies.select("digest", "id", "s.bands", "s.signature"), "copies")

    rows = copies.select("id", F.explode("bands").alias("band"))
    buckets = rows.groupBy("band").agg(F.min("id").alias("leader"), F.count("*").alias("n")).where("n > 1")
    full = written(rows.join(buckets.drop("n"), "band").select("band", "id", "leader"), "buckets")
    stars = written(full.where("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct(), "pairs")
    links = written(verified(docs, stars).select("a", "b"), "links")
    found = components(links)

    # What a bucket's star has not joined: the rest of the bucket, by signature, in blocks of either side.
    rows = written(_open_rows(full.select("band", "id"), found), "open")
    if rows.limit(1).count():
        texts = with_ids(hashed_text(docs), rows.select(F.col("id").alias("doc_id")))
        members = copies.join(rows.select("id").distinct(), "id", "left_semi").select("id", "signature", "bands")
        rows = rows.join(members.join(texts.withColumnRenamed("doc_id", "id"), "id"), "id")
        own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        strays = rows.where("comp <> most").withColumn("stray_block", own("stray_blocks")).withColumn("block", every("blocks"))
        blocks = rows.withColumn("block", own("blocks")).withColumn("stray_block", every("stray_blocks"))
        strays = strays.select(*(F.col(c).alias(c) for c in strays.columns))  # columns of its own
        pairs = strays.groupBy("band", "block", "stray_block").cogroup(blocks.groupBy("band", "block", "stray_block"))
        second = written(pairs.applyInArrow(_settled, "a long, b long").distinct(), "links")
        if second.limit(1).count():
            found = components(links.unionByName(second))

    whole = copies.select("digest", "id").join(found, "id", "left")
    whole = whole.select("digest", F.coalesce("comp", "id").alias("class_id"))
    return signed.select("doc_id", "digest").join(whole, "digest").select("doc_id", "class_id")
