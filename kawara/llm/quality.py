"""Quality rules: whole-text statistics, then a hashed n-gram log-likelihood ratio.

Two multinomials over hashed byte trigrams are counted in Spark: one over all documents (the raw corpus), one over
the documents that labels.quality marks as 1 (the trusted target). A document's score is the mean over its trigrams
of log(target / raw), so length does not matter, and a document is kept if its score is at least THRESHOLD. Counts
are summed in each task before the shuffle; the two vectors of BUCKETS numbers are all that reaches the driver.

Defined results: a null text has no words. Without trusted documents the ratio says nothing, and the verdict is to
keep. Texts of fewer than three bytes have no trigram and a score of 0. A document counts once as trusted, however
often labels repeats it; repeated documents count as often as they stand there. An empty table gives an empty
result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kawara.llm.common import BROADCAST_IDS, Rolling, WordHashes, bounded_batches, covered, filtered, hashed_text, map_rows

BITS = 16
BUCKETS = 1 << BITS
SMOOTHING = 0.5
#: Nats for each trigram. Trusted documents score about 0 or more; a text of which a few trigrams in a hundred are
#: foreign to the target falls well below.
THRESHOLD = -0.5
SYMBOLS = b"#*$%&|<>"
REPEAT = 5
LEAST_WORDS, MOST_REPEATED = 10, 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def trigrams(data: np.ndarray) -> np.ndarray:
    """Buckets of all byte trigrams."""
    if len(data) < 3:
        return np.empty(0, np.int64)
    b = data.astype(np.uint32)
    k = b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA6B) ^ b[2:] * np.uint32(0xC2B2AE35)
    k ^= k >> np.uint32(15)
    k *= np.uint32(0x2C1B3C6D)
    return (k >> np.uint32(32 - BITS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text, trusted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = trigrams(np.frombuffer(text, np.uint8))
            if len(found) * 8 > BUCKETS:
                counts = np.bincount(found, minlength=BUCKETS)
                raw += counts
                if trusted:
                    target += counts
            else:
                np.add.at(raw, found, 1)
                if trusted:
                    np.add.at(target, found, 1)
    used = np.flatnonzero(raw)
    yield pa.RecordBatch.from_pydict({"bucket": used.astype(np.int32), "raw": raw[used], "target": target[used]})


def weights(docs: DataFrame, labels: DataFrame) -> np.ndarray | None:
    """log(target / raw) for each bucket; None without trusted documents."""
    bounded_batches(docs.sparkSession)
    trusted = labels.where("quality = 1").select("doc_id").distinct().withColumn("trusted", F.lit(True))
    short = trusted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rows = hashed_text(docs).join(F.broadcast(trusted) if short else trusted, "doc_id", "left")
    counts = rows.select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    counts = counts.mapInArrow(_count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for k, r, t in counts.collect():  # BUCKETS rows at most
        raw[k], target[k] = r, t
    if not target.sum():
        return None
    smooth = lambda x: np.log(x + SMOOTHING) - np.log(x.sum() + SMOOTHING * BUCKETS)
    return smooth(target) - smooth(raw)


def statistics(text: bytes, words: WordHashes, rolling: Rolling) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    found = text.split()
    data = np.frombuffer(text, np.uint8)
    follow = int(np.count_nonzero((data & 0xC0) == 0x80))
    seen, again = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            again += 1
        elif line and not line.isspace():
            seen.add(line)
    repeated = 0
    if len(found) > REPEAT:
        h = rolling(words.of(found))
        order = np.argsort(h)
        same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
        if len(same):
            hits = np.zeros(len(h), bool)
            hits[order[same]] = hits[order[same + 1]] = True
            repeated = int(covered(hits, REPEAT, len(found)).sum())
    n = len(found)
    failed = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n
    return n, sum(map(len, found)) - follow, int(np.count_nonzero(_SYMBOL[data])), again, repeated, failed


def verdict(text: bytes, ratio: np.ndarray | None, failed: bool, threshold: float) -> tuple[bool, float]:
    """Kept or not, and the score."""
    found = trigrams(np.frombuffer(text, np.uint8))
    score = float(ratio[found].mean()) if ratio is not None and len(found) else 0.0
    return not failed and score >= threshold, score


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The statistics, score and verdict of each document. labels: doc_id and quality."""
    ratio = weights(docs, labels)

    def make():
        words, rolling = WordHashes(), Rolling(REPEAT)

        def step(batch: pa.RecordBatch) -> dict:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = statistics(text, words, rolling)
                rows.append((doc_id, *own, *verdict(text, ratio, own[-1], threshold)))
            return dict(zip(names, map(list, zip(*rows, strict=True)) if rows else [[]] * len(names), strict=True))

        return step

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"
    names = [x.split()[0] for x in schema.split(", ")]
    return map_rows(hashed_text(docs), schema, make)


def kept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are kept, with all their columns."""
    ratio = weights(docs, labels)

    def make():
        words, rolling = WordHashes(), Rolling(REPEAT)
        return lambda texts: [verdict(t, ratio, statistics(t, words, rolling)[-1], threshold)[0] for t in texts]

    return filtered(docs, make)
