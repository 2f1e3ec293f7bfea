"""Cases that once went wrong, awkward rows, and full recomputations in plain Python."""

import datetime
import hashlib
import math
import re
import tracemalloc
import unicodedata
from collections import Counter

import brute
import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from kawara.llm import bpe, chat, common, fingerprints, html, minhash, packing, quality, queries, substrings, toxicity, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


# near duplicates


def test_rows_that_share_an_id(spark):
    long = " ".join(f"w{i}" for i in range(40))
    made = [(1, long), (5, "q w e r t y"), (5, long + " x"), (None, "q w e r t y"), (None, None), (7, "only one")]
    rows = minhash.near_duplicates(spark.createDataFrame(made, DOCS)).collect()
    assert sorted(((r.doc_id, r.class_id) for r in rows), key=str) == [(1, 1), (5, 1), (5, 5), (7, 7), (None, 5), (None, None)]


def test_blocks_and_hot_leaders(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "HOT", 2)
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(60)]
    made = []
    for i in range(80):
        words = list(base)
        for _ in range(int(rng.integers(0, 3))):
            words[int(rng.integers(60))] = f"x{rng.integers(9)}"
        made.append((i, " ".join(words)))
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(made, DOCS)).collect()}
    want = brute.near_classes(made)
    # every class is a part of a true one, and nearly all links are found
    assert all(want[i] == want[c] for i, c in got.items()) and sum(got[i] != want[i] for i in want) <= 2


# encoding


def test_other_vocabularies_are_encoded_whole(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert bpe.is_known_kind(bpe.vocabulary()) and not bpe.is_known_kind(path)
    texts = ["Hello  World's\n\nend", "", "x" * 40_000 + " tail", "é汉🙂 <|endoftext|>"]
    rows = {r.doc_id: r.ids for r in bpe.encode(spark.createDataFrame(list(enumerate(texts)), DOCS), path).collect()}
    tokenizer = bpe.Coder(path).tokenizer
    assert all(list(rows[i]) == tokenizer.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts))


# substrings


def test_columns_of_any_type_come_back(spark):
    passage = " ".join(f"s{i}" for i in range(20))
    when = datetime.datetime(2024, 1, 2, 3, 4, 5, 123456)
    made = [(1, f"a {passage} b", when, b"\x00\xff", [{"k": 1.5}], 1, "x"), (2, f"c {passage} d", when, None, None, None, None), (None, None, None, b"", [], 2, "y")]
    schema = "doc_id long, text string, at timestamp, raw binary, deep array<struct<k:double>>, key int, hashes string"
    docs = spark.createDataFrame(made, schema).withColumn("rest", F.lit(float("nan")))
    rows = {r.doc_id: r for r in substrings.cut(docs).collect()}
    assert rows[2].text == "c d" and rows[1].text == made[0][1] and rows[None].text == ""
    assert rows[1].at == when and bytes(rows[1].raw) == b"\x00\xff" and rows[1].deep[0].k == 1.5 and math.isnan(rows[1].rest)
    assert (rows[1].key, rows[1].hashes, rows[2].raw, bytes(rows[None].raw)) == (1, "x", None, b"")
    assert substrings.cut(docs).schema.simpleString() == docs.schema.simpleString()


# quality


def bucket(t):
    k = (t[0] * 0x9E3779B1 ^ t[1] * 0x85EBCA6B ^ t[2] * 0xC2B2AE35) & 0xFFFFFFFF
    k ^= k >> 15
    return (k * 0x2C1B3C6D & 0xFFFFFFFF) >> 16


def test_quality_by_brute_force(spark):
    texts = documents(spark)
    trusted = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    grams = {i: Counter(bucket(t[k : k + 3]) for k in range(len(t) - 2)) for i, t in ((i, t.encode()) for i, t in texts.items())}
    raw, target = Counter(), Counter()
    for i, c in grams.items():
        raw.update(c)
        if i in trusted:
            target.update(c)
    smooth = lambda c, k: math.log(c[k] + 0.5) - math.log(c.total() + 0.5 * 65536)
    rows = queries.op4_quality(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t, w = texts[r.doc_id], brute.words(texts[r.doc_id])
        seen, again = set(), 0
        for line in t.split("\n"):
            if brute.words(line):
                again += line in seen
                seen.add(line)
        windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len(covered))
        n = grams[r.doc_id].total()
        score = sum(v * (smooth(target, k) - smooth(raw, k)) for k, v in grams[r.doc_id].items()) / n if n else 0.0
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        assert r.base_failed == failed and r.score == pytest.approx(score, abs=1e-9)
        assert r.kept == (not failed and r.score >= quality.THRESHOLD)


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    half = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    rows = quality.judged(docs, labels.where(half)).join(labels.where(~half), "doc_id").select("quality", "score", "kept", "base_failed").toPandas()
    good, bad = rows[rows.quality == 1], rows[rows.quality == 0]
    order = rows.score.rank()
    auc = (order[rows.quality == 1].sum() - len(good) * (len(good) + 1) / 2) / len(good) / len(bad)
    assert auc > 0.9 and good.kept.mean() > 0.95


# fingerprints


def test_fingerprints_by_brute_force(spark):
    texts = documents(spark)

    def canonical(t):
        return re.sub(r"[\s\x1c-\x1f\x85]+", " ", unicodedata.normalize("NFKC", t).casefold()).strip(" ")

    order = sorted(texts, reverse=True)
    made = {}
    for k, i in enumerate(order):
        follow, cut = texts[order[(k + 1) % len(order)]], len(texts[i]) // 3
        made[i] = texts[i][: len(texts[i]) - cut] + follow[:cut], follow
    rows = {r.doc_id: r for r in queries.op5_fingerprints(spark, SF).collect()}
    assert len(rows) == len(texts)
    hashed = lambda t, seed: xxhash.xxh64_hexdigest(canonical(t).encode(), seed)
    same = Counter()
    for i, t in texts.items():
        edited, follow = made[i]
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), brute.sha(edited.encode()))
        assert r.near_edited == float(canonical(t) == canonical(edited)) and r.near_next == float(canonical(t) == canonical(follow))
        assert r.class_id == min(j for j in texts if canonical(texts[j]) == canonical(t))
        assert re.fullmatch(r"[0-9a-f]{32}", r.fingerprint) and (r.fingerprint == r.edited_fingerprint) == bool(r.near_edited)
        same[hashed(t, 1), r.fingerprint] += 1
    # as many fingerprints as canonical texts
    assert len(same) == len({k for k, _ in same}) == len({f for _, f in same})


def test_wide_and_missing_ids(spark):
    made = [(-(2**63), "aaa bbb"), (2**63 - 1, "ccc ddd eee"), (None, "nul a"), (None, "nul b"), (5, "x y z"), (5, "x y z"), (5, "other text"), (None, None)]
    rows = fingerprints.report(spark.createDataFrame(made, DOCS)).collect()
    assert len(rows) == 8
    first = next(r for r in rows if r.doc_id == 2**63 - 1)
    assert first.edited_sha256 in {brute.sha(("ccc ddd eee"[:8] + t[:3]).encode()) for t in ("x y z", "other text")}
    assert sum(r.near_next for r in rows) == 1.0


def test_ranges_of_documents(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE", 3)
    made = [(i * i * (-1) ** i, f"text {i} " * (i % 5 + 1)) for i in range(200)]
    order = sorted(dict(made).items(), reverse=True)
    rows = {r.doc_id: r for r in fingerprints.report(spark.createDataFrame(made, DOCS).repartition(5)).collect()}
    for (i, t), (_, follow) in zip(order, order[1:] + order[:1], strict=True):
        assert rows[i].edited_sha256 == brute.sha((t[: len(t) - len(t) // 3] + follow[: len(t) // 3]).encode())


# toxicity


def test_toxicity_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = queries.op6_toxicity(spark, folder).where("held_out").join(labels, "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("share"), F.count("*").alias("n"))
    share = {r.toxic: r.share for r in rows.collect()}
    assert share[1] > 0.8 and share[0] < 0.02


def test_toxicity_labels_that_contradict(spark):
    made = [(i, ("fine words of a day " * 3) + ("vile scum" if i % 3 == 0 else "")) for i in range(300)] + [(None, "vile scum")]
    marks = [(i, int(i % 3 == 0)) for i in range(300)] + [(i, 0) for i in range(0, 300, 30)] + [(None, 1)]
    rows = toxicity.report(spark.createDataFrame(made, DOCS), spark.createDataFrame(marks, "doc_id long, toxic int")).collect()
    assert all(r.predicted == int(r.doc_id % 3 == 0) for r in rows if r.doc_id is not None) and [r.predicted for r in rows if r.doc_id is None] == [1]


def test_label_model_trusts_voters_as_they_deserve():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.3
    vote = lambda hit, false: (rng.random(4000) < np.where(truth, hit, false)).astype(float)
    voters = [vote(0.8, 0.02), vote(0.7, 0.05), vote(0.75, 0.03)]
    label = truth ^ (rng.random(4000) < 0.1)  # one label in ten is wrong
    post = toxicity.label_model(np.column_stack([*voters, voters[0], voters[0]]), np.ones(4000, int), label.astype(int), np.ones(4000))
    assert np.mean((post > 0.5) == truth) > 0.96 > np.mean(label == truth)


# pages


BODY = "<h1>Head</h1><p>" + "A long sentence of the article. " * 10 + "</p>"
TEXT = "Head\n" + " ".join(["A long sentence of the article."] * 10)


@pytest.mark.parametrize("page, want", [
    (f"<body><form action=x><input name=q><div class=menu>Menu</div><article>{BODY}</article><button>Go</button></form></body>", TEXT),
    (f"<body><form>{BODY}<select><option>a</select></form><div>Short</div></body>", TEXT),
    (f"<body><article>{BODY}</article><form><label>Mail</label><input></form></body>", TEXT),
    (f"<body><article>{BODY}<p>We have <math><mi>x</mi><mo>=</mo><mn>1</mn></math> here</p></article></body>", f"{TEXT}\nWe have x=1 here"),
    (f"<body><article>{BODY}<figure class=banner><figcaption>The caption</figcaption></figure></article></body>", f"{TEXT}\nThe caption"),
    (f"<body><article>{BODY}<div class=related-work><p>Other work did this</p></div></article></body>", f"{TEXT}\nOther work did this"),
    (f"<body><article>{BODY}<div class=related><ul><li><a href=x>Another story</a></ul></div></article></body>", TEXT),
    (f"<body><article>{BODY}</article><div class=banner>Buy this</div><div class=comments><p>So true</p></div></body>", TEXT),
])
def test_pages(page, want):
    assert html.main_text(page, None) == want


def test_deep_pages(spark):
    def peak(n):
        tracemalloc.start()
        assert html.main_text("<div>" * n + "deep text" + "</p></b>" * n + "</div>" * n, None) == "deep text"
        size = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return size

    assert peak(8000) < 6 * peak(2000)
    made = spark.createDataFrame([(1, "u", "<p>a" * 3, 1), (1, "u", "<p>a" * 3, 2), (2, None, None, 3)], "page_id long, url string, html string, path int").withColumn("host", F.lit("x"))
    assert sorted((r.page_id, r.text) for r in html.extracted(made).collect()) == [(1, "a\na\na"), (1, "a\na\na"), (2, "")]


# packing


def test_patterns_place_most_pieces():
    rng = np.random.default_rng(3)
    counts = np.bincount(np.minimum(rng.lognormal(6.5, 0.9, 20_000).astype(int) + 1, 4096), minlength=4097)
    found, left = packing.fitted(counts)
    assert all(sum(p) == 4096 for p, _ in found)
    placed = sum(len(p) * n for p, n in found if len(p) > 1)
    assert placed > 0.7 * counts.sum() and placed + sum(n for p, n in found if len(p) == 1) + left.sum() == counts.sum()
    made = packing.plan(counts)
    again = Counter()
    for p, n in made:
        assert sum(p) <= 4096
        for length in p:
            again[length] += n
    assert again == {k: int(counts[k]) for k in np.flatnonzero(counts)} and sum(n for _, n in made) <= packing.lower_bound(counts) + 1
    assert packing.plan(np.zeros(4097, np.int64)) == [] and packing.plan(np.eye(1, 4097, 3000, dtype=np.int64)[0] * 7) == [((3000,), 7)]


def test_hot_lengths_are_ranked_in_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 4)
    docs = spark.createDataFrame([(i, "a b c" if i % 3 else f"x{i} " * (i % 40)) for i in range(300)] + [(None, None), (7, "a b c")], DOCS)
    rows = packing.packed(docs).collect()
    assert len(rows) == 302 and len({(r.sequence_id, r.offset) for r in rows}) == 302
    total = Counter()
    for r in rows:
        total[r.sequence_id] += r.length
    assert max(total.values()) <= 4096 and all(total[r.sequence_id] >= r.offset + r.length for r in rows)


# archives


def test_archives_from_outside():
    made = [warc.record(i, None if i % 2 else f"http://h/{i}\r\n ", b"p" * (i * 37), hashlib.sha256(b"p" * (i * 37)).hexdigest(), i * 37, None) for i in range(40)]
    data = warc.archive(made)
    size = int.from_bytes(data[4:8], "little")
    first = 8 + size + len(data[8 + size :])
    more = data + (0x184D2A50).to_bytes(4, "little") + (3).to_bytes(4, "little") + b"abc" + zstandard.ZstdCompressor().compress(made[3])
    found = list(warc.frames(more))
    assert found == [*made, made[3]] and first == len(data)
    assert warc.read_record(found[1])["url"] is None and warc.read_record(found[2])["url"] == "http://h/2%0D%0A%20"
    for broken in (more[:-1], more[: len(data) + 9], data[:-40]):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.frames(broken))


def test_archive_rows(spark):
    big = "<p>" + "word " * 300_000
    made = [(1, "u", big, 1), (1, "u", big, 2), (2, None, big, 3), (None, "u", big, 4), (3, "u", None, 5)]
    pages = spark.createDataFrame(made, "page_id long, url string, html string, digest int").withColumn("payload", F.lit(0))
    rows = sorted(((r.page_id, r.record_type, r.refers_to, r.url) for r in warc.round_trip(pages).collect()), key=str)
    assert rows == [(1, "response", None, "u"), (1, "response", None, "u"), (2, "revisit", 1, None), (3, "response", None, "u"), (None, "revisit", 1, "u")]


# conversations


def test_query_uses_several_layouts(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    layouts = {r.layout: r["count"] for r in chat.canonical(chat.records_of(rows)).groupBy("layout").count().collect()}
    assert set(layouts) == {"messages", "conversations", "prompt_response"}
    assert chat.canonical(chat.records_of(rows)).select("fingerprint").distinct().count() == 3


def test_chat_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    made = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", None), (2, None, None, None), (3, 0, "user", "q"), (3, 1, "assistant", "r" * 200_000), (None, 0, "User", "x")]
    rows = spark.createDataFrame(made, schema).withColumn("layout", F.lit(1)).withColumn("record", F.lit(2)).withColumn("t", F.lit(3))
    got = {r.conv_id: r for r in chat.report(rows).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 3, 2: 1, 3: 2, None: 1}
    assert got[3].loss_chars == 200_000 and got[1].turns_sha256 == brute.sha(b"user\na\nuser\na\nassistant\n\n")
    assert chat.report(rows.limit(0)).count() == 0


def test_layout_by_fingerprint(spark):
    # equal needed paths, other fields: other fingerprints, and the declared fallback
    made = ['{"prompt":"a","completion":"b"}', '{"prompt":"a","completion":"b","meta":{"a":{"b":[1]}}}', '{"messages":[]}', '{"prompt":"a","completion":"b","response":"c"}']
    rows = chat.canonical(spark.createDataFrame([(x,) for x in made], "j string"), "j").collect()
    assert [r.layout for r in rows] == ["prompt_completion", "prompt_completion", None, "prompt_completion"]
    assert len({r.fingerprint for r in rows}) == 4
    both = spark.createDataFrame([(("a", "b", None),), (("a", None, "c"),)], "record struct<prompt:string,response:string,completion:string>")
    assert [(r.layout, r.turns[1].text) for r in chat.canonical(both).orderBy("layout").collect()] == [("prompt_completion", "c"), ("prompt_response", "b")]


# the pipeline


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    toxic, low, near, cut = (stage for _, stage in corpus_pipeline.STAGES[:-1])
    ids = lambda df: {r.doc_id for r in df.collect()}
    first = common.written(toxic(spark, docs, SF), "t")
    assert ids(first) == ids(toxicity.report(docs, labels).where("predicted = 0"))
    second = common.written(low(spark, first, SF), "t")
    assert ids(second) == ids(quality.judged(first, labels).where("kept"))
    rows = [(r.doc_id, r.text) for r in second.collect()]
    third = common.written(near(spark, second, SF), "t")
    assert ids(third) == {i for i, c in brute.near_classes(rows).items() if i == c}
    want = brute.substring_cut([(r.doc_id, r.text) for r in third.collect()])
    last = {r.doc_id: r for r in cut(spark, third, SF).collect()}
    assert {i: r.text for i, r in last.items()} == {i: " ".join(w[2]) for i, w in want.items()} and all(r.n_chars == len(r.text) for r in last.values())


def test_pipeline_on_awkward_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    say = lambda name: " ".join(f"{name}{i}" for i in range(40))
    made = [(1, say("a"), None, None, None), (2, None, "x", "y", 0), (3, "", "x", "y", 0), (4, say("b"), "x", "y", 1), (4, say("b"), "x", "y", 1), (None, " ".join(reversed(say("a").split())), "x", "y", 1)]
    spark.createDataFrame([(1, 0, 0), (4, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(made, schema).write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "4", "None"]
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_no_folder_of_its_own_on_a_cluster(spark, monkeypatch):
    class Elsewhere:
        master = "yarn"
        getConf = staticmethod(lambda: {})
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Elsewhere

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)
