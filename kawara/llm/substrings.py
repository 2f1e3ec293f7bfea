"""Removal of passages that stand in an earlier document.

Every window of LENGTH words gets a Rabin-Karp hash; the smallest doc_id of each hash decides. A word goes if a
window over it also starts in a document with a smaller doc_id; overlapping windows merge into maximal intervals.

The windows are counted in Spark in one shuffle, as sorted hash lists rather than as rows:

1. A task takes some millions of windows at a time. Equal windows meet there first: only the smallest document of a
   hash asks the corpus, all others of the batch already know their answer. So a passage that a third of all
   documents share leaves a task once, not once for each document.
2. The questions (hash, document) are dealt out by ranges of the hash and packed: sorted hashes as differences, their
   bytes in planes, compressed. A range holds all questions on its hashes, and answers each but the smallest
   document's.
3. Answers and compressed texts are dealt out by document, and each text is cut there.

Hashes have 64 bits. Of n windows, about n**2 / 2**65 pairs collide by chance: 5e-4 at 10**8 windows.

Defined results: a null text has no words, and nothing is removed from it. Rows that repeat a doc_id are each cut by
the same rule; documents do not remove their own repeats. A null doc_id counts as larger than any other. An empty
table gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType, _parse_datatype_string

from kawara.llm.common import Rolling, WordHashes, bounded_batches, covered, fresh_worker, hashed_text, mixed

LENGTH = 13
#: Windows a task gathers before it deals them out: 16 bytes each, and as much again to sort them.
BATCH = 1_000_000
#: A null doc_id, as an integer.
NO_ID = np.iinfo(np.int64).max
PART = "kind int, key int, docs binary, hashes binary, rest binary"
KIND = pa.schema([("kind", pa.int32()), ("key", pa.int32()), ("docs", pa.binary()), ("hashes", pa.binary()), ("rest", pa.binary())])
#: Text in a group at most, on average: a group is one Arrow table in a worker.
GROUP_BYTES = 32 << 20
ASK, REMOVE, TEXT = 0, 1, 2


def packed(x: np.ndarray) -> bytes:
    """64-bit integers as compressed byte planes of their differences; cheap where x is sorted."""
    steps = np.diff(x.view(np.int64), prepend=np.int64(0))
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.int64).ravel())


def packed_ids(x: np.ndarray) -> bytes:
    """As packed(), for ids that repeat in no order: the distinct ones, then each one's place among them."""
    distinct, place = np.unique(x, return_inverse=True)
    head = packed(distinct)
    kind = np.uint16 if len(distinct) < 1 << 16 else np.uint32
    planes = np.ascontiguousarray(place.astype(kind).view(np.uint8).reshape(len(x), -1).T)
    tail = zstandard.ZstdCompressor(level=1).compress(planes.tobytes())
    return len(head).to_bytes(4, "little") + bytes([kind().itemsize]) + head + tail


def unpacked_ids(data: bytes) -> np.ndarray:
    n, width = int.from_bytes(data[:4], "little"), data[4]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[5 + n :]), np.uint8).reshape(width, -1)
    return unpacked(data[5 : 5 + n])[np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()]


def _deal(kind: int, key: np.ndarray, docs: np.ndarray, hashes: np.ndarray) -> Iterator[tuple]:
    """One row for each key; within it hashes ascend."""
    order = np.lexsort((hashes, key))
    key, docs, hashes = key[order], docs[order], hashes[order]
    cuts = np.flatnonzero(np.diff(key)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(key)], strict=True):
        if b > a:
            yield kind, int(key[a]), packed_ids(docs[a:b]), packed(hashes[a:b]), None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), KIND, strict=True)], schema=KIND)


def _group(docs: np.ndarray, groups: int) -> np.ndarray:
    return (mixed(docs.view(np.uint64)) % np.uint64(groups)).astype(np.int32)


def _questions(ranges: int, groups: int):
    shift = np.uint64(64 - ranges.bit_length() + 1)

    def settle(docs: list, sizes: list, hashes: list) -> Iterator[pa.RecordBatch]:
        doc, h = np.repeat(np.array(docs, np.int64), sizes), np.concatenate(hashes)
        order = np.lexsort((doc, h))
        doc, h = doc[order], h[order]
        new_hash = np.ones(len(h), bool)
        new_hash[1:] = h[1:] != h[:-1]
        new = new_hash.copy()
        new[1:] |= doc[1:] != doc[:-1]
        later = new & ~new_hash
        out = list(_deal(ASK, (h[new_hash] >> shift).astype(np.int32), doc[new_hash], h[new_hash]))
        if later.any():
            # spread by document, not by hash: these need no more answers
            out += _deal(REMOVE, (_group(doc[later], groups) % ranges).astype(np.int32), doc[later], h[later])
        for i in range(0, len(out), 64):
            yield _batch(out[i : i + 64])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        words, rolling = WordHashes(), Rolling(LENGTH)
        docs, sizes, hashes, n = [], [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = rolling(words.of(text.split()))
                if len(h):
                    docs.append(NO_ID if doc is None else doc)
                    sizes.append(len(h))
                    hashes.append(h)
                    n += len(h)
                if n >= BATCH:
                    yield from settle(docs, sizes, hashes)
                    docs, sizes, hashes, n = [], [], [], 0
        if n:
            yield from settle(docs, sizes, hashes)

    return run


def _answers(groups: int):
    def run(found: pa.Table) -> pa.Table:
        """All questions of one range of hashes; what is known already passes through."""
        kinds = found.column("kind").to_pylist()
        ids, hashes = found.column("docs").to_pylist(), found.column("hashes").to_pylist()
        asked = [i for i, k in enumerate(kinds) if k == ASK]
        known = [i for i, k in enumerate(kinds) if k == REMOVE]
        doc = np.concatenate([unpacked_ids(ids[i]) for i in asked] or [np.empty(0, np.int64)])
        h = np.concatenate([unpacked(hashes[i]) for i in asked] or [np.empty(0, np.int64)])
        order = np.argsort(h, kind="stable")
        doc, h = doc[order], h[order]
        if len(h):
            starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            least = np.repeat(np.minimum.reduceat(doc, starts), np.diff(np.append(starts, len(h))))
            gone = doc > least
            doc, h = doc[gone], h[gone]
        doc = np.concatenate([doc, *(unpacked_ids(ids[i]) for i in known)])
        h = np.concatenate([h, *(unpacked(hashes[i]) for i in known)])
        rows = list(_deal(REMOVE, _group(doc, groups), doc, h)) if len(h) else []
        return pa.Table.from_batches([_batch(rows)] if rows else [], schema=KIND)

    return run


def _texts(groups: int):
    """Texts as rows of their own, compressed: docs is ids and lengths, hashes the texts, rest the other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        pack = zstandard.ZstdCompressor(level=3)

        def flush(at: int) -> tuple:
            texts, rest = held.pop(at)
            numbers = np.array([(i, len(t)) for i, t in texts], np.int64)
            sink = pa.BufferOutputStream()
            if rest:
                with pa.ipc.new_stream(sink, rest[0].schema) as out:
                    out.write_table(pa.Table.from_batches(rest).combine_chunks())
            kept = pack.compress(sink.getvalue().to_pybytes()) if rest else None
            return TEXT, at, numbers.tobytes(), pack.compress(b"".join(t for _, t in texts)), kept

        held: dict[int, tuple[list, list]] = {}
        size = 0
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            texts, key = batch.column(1).to_pylist(), _group(ids, groups)
            others = batch.select(range(2, batch.num_columns)) if batch.num_columns > 2 else None
            order = np.argsort(key, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
                if len(rows):
                    own = held.setdefault(int(key[rows[0]]), ([], []))
                    own[0].extend((int(ids[k]), texts[k]) for k in rows)
                    if others:
                        own[1].append(others.take(pa.array(rows)))
            size += sum(map(len, texts)) + (others.nbytes if others else 0) + 64 * len(texts)
            if size > 16 << 20:
                yield _batch([flush(at) for at in list(held)])
                size = 0
        if held:
            yield _batch([flush(at) for at in list(held)])

    return run


def kept_words(text: bytes, gone: np.ndarray, words: WordHashes, rolling: Rolling) -> tuple[int, int, list[bytes]]:
    """Number of words, number removed, and the words kept. gone: sorted hashes of windows to remove."""
    found = text.split()
    if not len(gone) or len(found) < LENGTH:
        return len(found), 0, found
    h = rolling(words.of(found))
    at = np.searchsorted(gone, h)
    hits = gone[np.minimum(at, len(gone) - 1)] == h
    cut = covered(hits, LENGTH, len(found))
    return len(found), int(cut.sum()), [w for w, c in zip(found, cut.tolist(), strict=True) if not c]


def _finish(target: pa.Schema, row):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, texts = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], []
        for batch in batches:
            for kind, d, h, rest in zip(*(batch.column(c).to_pylist() for c in ("kind", "docs", "hashes", "rest")), strict=True):
                if kind == TEXT:
                    texts.append((d, h, rest))
                else:
                    ids.append(unpacked_ids(d))
                    hashes.append(unpacked(h).view(np.uint64))
        doc, h = np.concatenate(ids), np.concatenate(hashes)
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        words, rolling = WordHashes(), Rolling(LENGTH)
        for d, data, rest in texts:
            owners, sizes = np.frombuffer(d, np.int64).reshape(-1, 2).T
            whole, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
            lows, highs = np.searchsorted(doc, owners), np.searchsorted(doc, owners, side="right")
            for owner, size, a, b in zip(owners.tolist(), sizes.tolist(), lows, highs, strict=True):
                out.append(row(None if owner == NO_ID else owner, *kept_words(whole[at : at + size], h[a:b], words, rolling)))
                at += size
            columns = dict(zip(row.names, zip(*out, strict=True), strict=True))
            if rest:
                with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(rest)) as stream:
                    others = stream.read_all().combine_chunks()
                columns |= {n: others.column(k).combine_chunks() for k, n in enumerate(row.rest)}
            arrays = [columns[k].cast(f.type) if isinstance(columns[k], pa.Array) else pa.array(columns[k], f.type) for k, f in zip(row.order, target, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return run


class Row:
    """What a document's row is made of: make(doc_id, n_words, n_removed, kept words) gives the columns in names, and
    rest are columns that travel with the text as they are. order: the columns of the result."""

    def __init__(self, make, names: list[str], rest: list[str], order: list[str]):
        self.make, self.names, self.rest, self.order = make, names, rest, order

    def __call__(self, *parts):
        return self.make(*parts)


def deduplicated(docs: DataFrame, schema: StructType, row: Row) -> DataFrame:
    """The rows that row makes of each document. docs: doc_id, text and the columns in row.rest, in this order."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    bounded_batches(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # several ranges and groups for each partition, so that they even out, and as many as memory asks for
    ranges = groups = 1 << max(4, (2 * partitions - 1).bit_length(), (size // GROUP_BYTES).bit_length())
    asked = docs.select("doc_id", "text").mapInArrow(_questions(ranges, groups), PART)
    answered = asked.groupBy("key").applyInArrow(_answers(groups), PART)
    rows = answered.unionByName(docs.mapInArrow(_texts(groups), PART))
    return rows.groupBy("key").applyInArrow(_finish(to_arrow_schema(schema), row), schema)


def _digest(doc, n, removed, words):
    return doc, n, removed, hashlib.sha256(b" ".join(words)).hexdigest()


def digests(docs: DataFrame) -> DataFrame:
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    names = [x.split()[0] for x in schema.split(", ")]
    return deduplicated(hashed_text(docs), _parse_datatype_string(schema), Row(_digest, names, [], names))


def _text(doc, n, removed, words):
    text = b" ".join(words).decode()
    return doc, text, len(text)


def cut(docs: DataFrame) -> DataFrame:
    """docs with all their columns; text is the words kept, joined by one space, and n_chars, if there, its length.

    The other columns travel as Arrow data beside their texts, so that values of any type come back as they were.
    """
    own = [c for c in docs.columns if c in ("doc_id", "text", "n_chars")]
    rest = [c for c in docs.columns if c not in own]
    # columns are told apart by place, so that they may have any names
    inner = [f"c{k}" for k in range(len(rest))]
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), *(F.col(f"`{c}`").alias(n) for c, n in zip(rest, inner, strict=True)))
    place = dict(zip(rest, inner, strict=True))
    order = [place.get(c, c) for c in docs.columns]
    schema = StructType([StructField(n, LongType() if n in ("doc_id", "n_chars") else docs.schema[c].dataType) for c, n in zip(docs.columns, order, strict=True)])
    found = deduplicated(rows, schema, Row(_text, ["doc_id", "text", "n_chars"], inner, order))
    return found.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, order, strict=True)))
