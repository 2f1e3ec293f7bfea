"""Toxicity by weak supervision: many noisy voters, a generative label model, a linear classifier.

1. The features of all labelled training rows are written and counted by class in Spark: lower-case words and their
   first four or five letters. Features that stand out among toxic rows are dealt over VOTERS lexicons; patterns of
   shouting, repetition, contact data and symbols vote too. In a text of some length silence is a vote for clean, in
   a short one an abstention. The training label is a voter like the others.
2. The label model is a mixture of two classes with an accuracy for each voter and class, the label's too, fitted by
   expectation maximisation on all training rows (as counts of equal votes), starting from the labels. Voters that agree beyond what the class explains are correlated; each
   one's evidence is divided by what it shares with the others, so that ten copies of a voter count once.
3. A logistic regression on the selected features is trained on the model's posterior labels of a bounded sample of the
   training rows (SAMPLE rows, those of the smallest hash). Documents without a label do not vote.

Only step 3's weights, at most FEATURES numbers, go to the tasks that score the documents. labels, lang, source and
doc_id are never inputs of a score.

Defined results: a null text counts as empty, and an empty text gets the classifier's prior. Without training rows of
both kinds every score is 0 (nothing is known to be toxic). Labels that contradict each other for one document count
as the larger. An empty table gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kawara.llm.common import BROADCAST_IDS, bounded_batches, filtered, fresh_worker, hashed_text, map_rows, written

#: Training rows of the regression at most; the model stops improving well before.
SAMPLE = 12_000
FEATURES = 4_096
VOTERS = 24
PREFIXES = (4, 5)
#: A feature is used if at least this share of the rows that have it are toxic.
PURITY = 0.5
SPACE_BITS = 31
FOLDS = 5
#: Features from which on a text is long enough for a silent lexicon or pattern to speak against toxicity.
SILENT = 40
#: Features that a task counts at a time: 4 bytes each, and as much again to sort them.
COUNTED = 4_000_000

_TOKEN = re.compile(r"[^\W\d_]+")
_PATTERNS = [
    re.compile(r"!{2,}"),
    re.compile(r"\b[A-Z]{4,}\b(?:\W+[A-Z]{4,}\b){3}"),
    re.compile(r"(\b\w{3,}\b)(?:\W+\1\b){3}"),
    re.compile(r"\byou(?:'re| are)? (?:an? )?\w+\b.{0,20}!"),
    re.compile(r"[\w.]+@[\w.]+"),
    re.compile(r"[#*$%&]{3,}"),
]


class Features(dict):
    """Buckets of a word: of itself and, where it is long enough, of its prefixes."""

    LIMIT = 60_000

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.LIMIT:
            self.clear()
        shift = 64 - SPACE_BITS
        found = [xxhash.xxh3_64_intdigest("w" + word) >> shift]
        found += [xxhash.xxh3_64_intdigest("p" + word[:n]) >> shift for n in PREFIXES if len(word) >= n]
        value = self[word] = tuple(found)
        return value

    def of(self, text: str) -> np.ndarray:
        found = {k for w in set(_TOKEN.findall(text.lower())) for k in self[w]}
        return np.sort(np.fromiter(found, np.int32, len(found)))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0


def _features():
    words = Features()

    def step(batch: pa.RecordBatch) -> dict:
        texts = [x.decode() for x in batch.column(2).to_pylist()]
        return {
            "doc_id": batch.column(0),
            "toxic": batch.column(1),
            "features": [words.of(t).tobytes() for t in texts],
            "patterns": [sum(bool(p.search(t)) << k for k, p in enumerate(_PATTERNS)) for t in texts],
        }

    return step


def training(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic (0 / 1), features and patterns of all training rows."""
    train = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(True)))
    train = train.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    short = train.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rows = hashed_text(docs).join(F.broadcast(train) if short else train, "doc_id").select("doc_id", "toxic", "text")
    return map_rows(rows, "doc_id long, toxic int, features binary, patterns int", _features)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and toxic rows of each feature, summed over some millions of features at a time."""

    def counted() -> pa.RecordBatch:
        every, n = np.unique(np.concatenate([x for side in held for x in side]), return_counts=True)
        own, k = np.unique(np.concatenate([*held[1], every[:0]]), return_counts=True)
        toxic = np.zeros(len(every), np.int64)
        toxic[np.searchsorted(every, own)] = k
        held[0].clear(), held[1].clear()
        return pa.RecordBatch.from_pydict({"feature": every, "n": n.astype(np.int64), "k": toxic})

    fresh_worker()
    held, size = ([], []), 0
    for batch in batches:
        for toxic, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held[toxic].append(np.frombuffer(data, np.int32))
            size += len(data) // 4
            if size >= COUNTED:
                yield counted()
                size = 0
    if held[0] or held[1]:
        yield counted()


def select(rows: DataFrame, n_rows: int, n_toxic: int) -> tuple[np.ndarray, np.ndarray]:
    """The features of toxic rows, and their evidence in nats.

    Evidence is the large-deviation bound on as many toxic rows by chance, n * KL(k / n, prior). It has to exceed the
    logarithm of the number of features tried, so that about none gets in by luck, however many there are.
    """
    bounded_batches(rows.sparkSession)
    counts = rows.select("toxic", "features").mapInArrow(_counts, "feature int, n long, k long")
    counts = counts.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).where("k > 0")
    prior = n_toxic / n_rows
    share = F.least(F.col("k") / F.col("n"), F.lit(1 - 1e-9))
    counts = counts.withColumn("share", share).withColumn(
        "evidence", F.col("n") * (share * F.log(share / prior) + (1 - share) * F.log((1 - share) / (1 - prior)))
    )
    counts = written(counts, "counts")
    tried = counts.where("n >= 3").count()
    good = counts.where((F.col("share") >= max(PURITY, prior)) & (F.col("evidence") >= float(np.log(max(2, tried)))) & (F.col("evidence") > 0))
    best = good.orderBy(F.desc("evidence"), "feature").limit(FEATURES).select("feature", "evidence").collect()  # FEATURES rows at most
    best.sort()
    return np.array([r[0] for r in best], np.int32), np.array([r[1] for r in best], np.float64)


def _voting(chosen: np.ndarray, lexicon: np.ndarray):
    """Votes as bits (lexicons, patterns, whether the text is long enough for silence to be a vote), and the places of a
    row's features among the chosen ones."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            found = [np.frombuffer(x, np.int32) for x in batch.column(2).to_pylist()]
            own = [np.flatnonzero(np.isin(chosen, x, assume_unique=True)) for x in found]
            bits = [int(np.bitwise_or.reduce(1 << lexicon[r], initial=0)) for r in own]
            long = [int(len(x) >= SILENT) << VOTERS + len(_PATTERNS) for x in found]
            votes = [b | p << VOTERS | s for b, p, s in zip(bits, batch.column(3).to_pylist(), long, strict=True)]
            return {"doc_id": batch.column(0), "toxic": batch.column(1), "votes": votes, "own": [r.astype(np.int32).tobytes() for r in own]}

        return step

    return make


def label_model(votes: np.ndarray, long: np.ndarray, y: np.ndarray, times: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Posterior of class 1 for each row of a 0 / 1 vote matrix that stands for so many equal ones.

    A 1 is a vote for class 1. A 0 is a vote for class 0 in a long text, and an abstention in a short one. The training
    label is one voter among the others: how far it can be trusted is estimated like theirs.
    """
    prior = float(np.clip(np.average(y, weights=times), 0.01, 0.99))
    votes = np.column_stack([votes, y == 1]).astype(float)
    cast = np.maximum(votes, np.column_stack([np.repeat(long[:, None], votes.shape[1] - 1, 1), np.ones(len(y))]))
    post = np.where(y == 1, 0.9, 0.1 * prior)
    share = np.ones(votes.shape[1])
    for k in range(rounds):
        # of the votes that are cast, the share for class 1, in either class
        rate = [((w[:, None] * votes).sum(0) + 1) / ((w[:, None] * cast).sum(0) + 20) for w in (times * post, times * (1 - post))]
        if k == rounds // 2:
            # what is left of each pair's covariance once the class is known
            left = cast * (votes - (post[:, None] * rate[0] + (1 - post)[:, None] * rate[1]))
            scale = np.sqrt(np.average(left**2, axis=0, weights=times)) + 1e-9
            together = np.clip((left.T @ (times[:, None] * left)) / times.sum() / scale[:, None] / scale, 0, 1)
            np.fill_diagonal(together, 1)
            # the label is given by a reader, not by any of the lists: it is no copy of one
            together[-1, :-1] = together[:-1, -1] = 0
            share = 1 / np.where(together > 0.1, together, 0).sum(0)
        weigh = lambda r: votes @ (share * np.log(r)) + (cast - votes) @ (share * np.log1p(-r))  # noqa: B023, E731
        gap = weigh(rate[0]) - weigh(rate[1]) + np.log(prior / (1 - prior))
        post = 1 / (1 + np.exp(-np.clip(gap, -30, 30)))
    return post


def regress(rows: list[np.ndarray], target: np.ndarray, n: int, rounds: int = 400, ridge: float = 2e-4) -> tuple[np.ndarray, float]:
    """Logistic regression by full gradient steps with per-weight step sizes (Adagrad)."""
    flat = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, bias = np.zeros(n), float(np.log(target.mean() / (1 - target.mean())))
    seen, seen_bias = np.full(n, 1e-8), 1e-8
    for _ in range(rounds):
        gap = np.bincount(owner, w[flat], len(rows)) + bias
        error = 1 / (1 + np.exp(-np.clip(gap, -30, 30))) - target
        step = np.bincount(flat, error[owner], n) / len(rows) + ridge * w
        seen += step**2
        seen_bias += error.mean() ** 2
        w -= 0.5 * step / np.sqrt(seen)
        bias -= 0.1 * error.mean() / np.sqrt(seen_bias)
    return w, bias


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float] | None:
    """(features, their weights, bias); None if the training rows are all of one kind."""
    rows = written(training(docs, labels), "training")
    sizes = dict(map(tuple, rows.groupBy("toxic").count().collect()))  # two rows at most
    if len(sizes) < 2:
        return None
    chosen, evidence = select(rows, sum(sizes.values()), sizes[1])
    # strong features are dealt round-robin, so that every lexicon has a share of the best
    strong = np.argsort(-evidence, kind="stable")
    lexicon = np.empty(len(chosen), np.int64)
    lexicon[strong] = np.arange(len(strong)) % VOTERS
    voted = written(map_rows(rows, "doc_id long, toxic int, votes long, own binary", _voting(chosen, lexicon)), "voted")
    equal = voted.groupBy("votes", "toxic").count().orderBy("votes", "toxic").toArrow()
    bits, y, times = (equal.column(c).to_numpy() for c in ("votes", "toxic", "count"))
    voters = VOTERS + len(_PATTERNS)
    post = label_model(bits[:, None] >> np.arange(voters) & 1, bits >> voters & 1, y, times.astype(np.float64))
    found = voted.orderBy(F.xxhash64("doc_id"), "doc_id", "votes", "own").limit(SAMPLE).toArrow()  # SAMPLE rows
    # votes and toxic in one number, in the order of equal
    at = np.searchsorted(bits * 2 + y, found.column("votes").to_numpy() * 2 + found.column("toxic").to_numpy())
    own = [np.frombuffer(x, np.int32) for x in found.column("own").to_pylist()]
    w, bias = regress(own, post[at], len(chosen))
    used = w != 0
    return chosen[used], w[used], bias


def scorer(model: tuple[np.ndarray, np.ndarray, float] | None):
    """What makes a scorer of texts, once for each task."""

    def make():
        words = Features()

        def score(text: bytes) -> float:
            if model is None:
                return 0.0
            chosen, w, bias = model
            found = words.of(text.decode())
            gap = bias
            if len(found) and len(chosen):
                at = np.minimum(np.searchsorted(chosen, found), len(chosen) - 1)
                gap += w[at[chosen[at] == found]].sum()
            return float(1 / (1 + np.exp(-np.clip(gap, -30, 30))))

        return score

    return make


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score and predicted for each document."""
    scorers = scorer(train(docs, labels))

    def make():
        score = scorers()

        def step(batch: pa.RecordBatch) -> dict:
            scores = list(map(score, batch.column(1).to_pylist()))
            return {"doc_id": batch.column(0), "score": scores, "predicted": [int(s >= 0.5) for s in scores]}

        return step

    return map_rows(hashed_text(docs), "doc_id long, score double, predicted int", make)


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    scorers = scorer(train(docs, labels))

    def make():
        score = scorers()
        return lambda texts: [score(t) < 0.5 for t in texts]

    return filtered(docs, make)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(docs, labels)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
