"""Each operator on awkward rows, and on the smallest tables against plain Python."""

import hashlib
import html as entities
import math
import re

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kawara.llm import bpe, chat, fingerprints, html, minhash, packing, quality, queries, substrings, toxicity, warc

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 5000} and{i}" for i in range(9000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
ROWS = [
    (1, "", "x"), (2, None, "x"), (3, "one", None), (4, f"first {PASSAGE} end", "x"), (5, f"second {PASSAGE} stop", "y"),
    (6, LONG, "x"), (7, LONG + " tail", "x"), (8, "same words here again now", "x"), (9, "same words here again now", "x"),
    (9, "same words here again now", "x"), (10, "A b\n\tc  d e\x0bf", None), (11, "é é ﬁ ZZ", "x"), (12, "a " * 50, "x"),
]
SCHEMA = "doc_id long, text string, word string"


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("key", F.lit(1)).withColumn("count", F.lit("z")).repartition(3)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(i, 1, i % 2) for i in range(1, 13)], "doc_id long, quality int, toxic int")


def sample(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_near_duplicates(spark, docs, nothing):
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert got == brute.near_classes([(i, t) for i, t, _ in ROWS])
    assert minhash.near_duplicates(nothing).count() == 0


def test_near_duplicates_by_brute_force(spark):
    got = {r.doc_id: r.class_id for r in queries.op1_minhash_dedup(spark, SF).collect()}
    assert got == brute.near_classes(sample(spark))


def test_bpe(spark, docs, nothing):
    tokenizer = bpe.coder(bpe.vocabulary()).tokenizer
    rows = bpe.round_trip(docs).collect()
    assert len(rows) == len(ROWS)
    texts = {i: t or "" for i, t, _ in ROWS}
    for r in rows:
        ids = brute.tokens(tokenizer, texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), brute.sha(brute.id_bytes(ids)))
        assert r.decoded_sha256 == brute.sha(tokenizer.decode(ids, skip_special_tokens=False).encode())
    assert bpe.round_trip(nothing).count() == 0
    back = bpe.decode(bpe.encode(docs)).where("doc_id = 3").first()
    assert back.text == tokenizer.decode(brute.tokens(tokenizer, "one"), skip_special_tokens=False)


def test_substrings(spark, docs, nothing):
    want = brute.substring_cut([(i, t) for i, t, _ in ROWS])
    for r in substrings.digests(docs).collect():
        n, removed, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, removed, brute.sha(" ".join(kept).encode()))
    assert substrings.digests(nothing).count() == 0
    cut = substrings.cut(docs)
    assert cut.columns == docs.columns
    assert cut.where("doc_id = 5").first().text == "second stop"
    assert cut.where("doc_id = 3").first().word is None


def test_quality(spark, docs, nothing, labels):
    for r in quality.judged(docs, labels).collect():
        text = {i: t or "" for i, t, _ in ROWS}[r.doc_id]
        w = brute.words(text)
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        again = {k + j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(5)} if len(w) < 500 else set()
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(again))
        assert r.base_failed == (len(w) < 10 or 100 * len(again) > 20 * len(w))
    assert quality.judged(nothing, labels).count() == 0
    assert quality.judged(docs, labels.where("quality = 0")).where("NOT base_failed AND NOT kept").count() == 0
    assert quality.kept(docs, labels).columns == docs.columns


def test_fingerprints(spark, docs, nothing):
    rows = sorted(fingerprints.report(docs).collect(), key=lambda r: r.doc_id)
    order = sorted([(i, t or "") for i, t, _ in ROWS], key=lambda r: (-r[0], r[1]))
    edited = {}
    for k, (i, t) in enumerate(order):
        cut = len(t) // 3
        edited[i] = t[: len(t) - cut] + order[(k + 1) % len(order)][1][:cut]
    for r in rows:
        assert r.edited_sha256 == brute.sha(edited[r.doc_id].encode())
    by = {r.doc_id: r for r in rows}
    assert by[8].fingerprint == by[9].fingerprint and by[8].class_id == by[9].class_id == 8 and by[1].fingerprint == by[2].fingerprint
    assert fingerprints.report(nothing).count() == 0
    made = spark.createDataFrame([(1, "É  ﬁN"), (2, "é fin ")], "doc_id long, text string")
    assert len({r.fingerprint for r in fingerprints.fingerprinted(made).collect()}) == 1


def test_toxicity(spark, docs, nothing, labels):
    assert toxicity.report(nothing, labels).count() == 0
    assert {r.score for r in toxicity.report(docs, labels.where("toxic = 0")).collect()} == {0.0}
    made = [(i, ("fine words of a day " * 3) + ("vile scum" if i % 3 == 0 else "")) for i in range(300)]
    texts = spark.createDataFrame(made, "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    held = [r for r in toxicity.report(texts, marks).collect() if r.held_out]
    assert held and all(r.predicted == int(r.doc_id % 3 == 0) for r in held)


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><script>var x='</p>';</script></head><body><header>Site</header><nav><a href=x>Menu</a></nav>"
    "<div class='cookie-notice'>Cookies</div><div id=wrap><div class=post-7><h1>Head&amp;line</h1><p>First  para <b>bold</b>&nbsp;x<p>Second<br>line that is long"
    " enough to count as the text of it<ul><li>item one<li>item two</ul><form>Mail <input></form></div><aside>Side</aside>"
    "<div class=comments><p>A reader writes a long comment here, longer than most of the text of the page itself</div></div><footer>&copy; Foot</footer><p"
)


def test_html(spark, nothing):
    pages = spark.createDataFrame([(1, "http://a.example/x", PAGE), (2, None, None), (3, "nonsense", "<p>only"), (3, "nonsense", "<p>only")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extracted(pages).collect()}
    assert got[1] == "Head&line\nFirst para bold x\nSecond line that is long enough to count as the text of it\nitem one\nitem two"
    assert got[2] == "" and got[3] == "only"
    assert html.extracted(pages.limit(0)).count() == 0


def test_html_with_many_classes(spark):
    text = "A sentence of the article that is long enough to win its page. " * 5
    page = f"<body><div class='a b c teaser'><p>Read this too</p></div><div class='a b c x-story'><p>{text}</p></div></body>"
    pages = spark.createDataFrame([(1, "http://a.example/x", page)], "page_id long, url string, html string")
    assert html.extracted(pages).first().text == text.strip()


def test_html_by_brute_force(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op7_html(spark, SF).collect():
        body = re.search(r"<article>(.*?)(</article>|$)", re.sub(r"<!--.*?-->", "", pages[r.page_id], flags=re.S), re.S)[1]
        lines = [" ".join(entities.unescape(re.sub(r"<[^>]*>?", " ", x)).split()) for x in re.split(r"</?(?:h1|p)>", body)]
        assert r.text == "\n".join(x for x in lines if x) and r.n_chars == len(r.text)


def test_packing(spark, docs, nothing):
    tokenizer = bpe.coder(bpe.vocabulary()).tokenizer
    one = docs.dropDuplicates(["doc_id"])
    rows = [r.asDict() for r in packing.packed(one).collect()]
    brute.check_packing(rows, tokenizer, {i: t or "" for i, t, _ in ROWS})
    assert packing.packed(nothing).count() == 0
    assert packing.packed(docs).groupBy("sequence_id", "offset").count().where("count > 1").count() == 0


def test_warc(spark):
    same = "<p>" + "x" * 200
    made = [(5, "http://a/", same), (2, "http://b/", same), (9, None, same), (1, "u", "short"), (3, "v", "short"), (4, "w", None)]
    pages = spark.createDataFrame(made, "page_id long, url string, html string").repartition(2)
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {
        2: ("response", None), 5: ("revisit", 2), 9: ("revisit", 2), 1: ("response", None), 3: ("response", None), 4: ("response", None)
    }
    assert all(r.payload_digest == hashlib.sha256((t or "").encode()).hexdigest() and r.payload_bytes == len(t or "") for (i, _, t) in made for r in [got[i]])
    assert warc.round_trip(pages.limit(0)).count() == 0
    data = warc.archive([warc.record(i, "u", b"p" * i, hashlib.sha256(b"p" * i).hexdigest(), i, None) for i in range(300)])
    assert len(list(warc.frames(data))) == 300
    for broken in (data[:-5], data[:6], data + b"junk"):
        assert warc.read_archives(spark.createDataFrame([(bytearray(broken),)], "a binary")).where("error IS NOT NULL").count() == 1
    wrong = warc.record(1, "u", b"abc", "0" * 64, 3, None)
    with pytest.raises(ValueError):
        warc.read_record(wrong)


def test_chat(spark):
    said = ["</s>[INST] ok [/INST]", r"<\/s><<SYS>>\\<|im_end|>", None, "<<s>[[INST]", "<|im_start|>user\nhi<|im_end|>\n", "é🙂"]
    made = [(1, k, role, t) for k, (role, t) in enumerate(zip(["system", "user", "assistant", "user", "assistant", "assistant"], said, strict=True))]
    made += [(2, 0, "odd\nrole\\n", "x"), (3, 1, None, None)]
    got = {r.conv_id: r for r in chat.report(spark.createDataFrame(made, "conv_id long, turn long, role string, text string")).collect()}
    for i in (1, 2, 3):
        turns = [(r or "", t or "") for c, _, r, t in made if c == i]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[i].turns_sha256 == brute.sha("".join(f"{r}\n{t}\n" for r, t in turns).encode())
        assert (got[i].n_turns, got[i].loss_chars, got[i].loss_sha256) == (len(turns), len(loss), brute.sha(loss.encode()))


def test_chat_layouts(spark):
    made = [
        '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}',
        '{"id":1,"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}',
        '{"instruction":"a","input":"","output":"b"}', '{"instruction":"a","output":"b"}', '{"prompt":"a","completion":"b"}',
        '{"prompt":"a","response":"b"}', '{"question":"a","answer":"b"}',
    ]
    rows = chat.canonical(spark.createDataFrame([(x,) for x in made], "record string").withColumnRenamed("record", "j"), "j").collect()
    assert all([tuple(t) for t in r.turns] == [("user", "a"), ("assistant", "b")] for r in rows), rows
    bad = chat.canonical(spark.createDataFrame([("{",), ('{"x":1}',)], "j string"), "j").collect()
    assert all(r.turns is None for r in bad)


def test_chat_beyond_json_limits(spark):
    n = 21_000_000
    made = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "x")], "conv_id long, turn long, role string, text string")
    text = F.when(F.col("role") == "assistant", F.repeat("text", F.lit(n))).otherwise(F.col("text"))
    row = chat.report(made.withColumn("text", text)).first()
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (2, n, brute.sha(b"x" * n))
    assert row.turns_sha256 == brute.sha(b"user\nhi\nassistant\n" + b"x" * n + b"\n")
    record = F.concat(F.lit('{"prompt":"a","response":"'), F.repeat(F.lit("x"), F.lit(n)), F.lit('"}'))
    with pytest.raises(Exception, match="too large for a variant"):
        chat.canonical(spark.range(1).select(record.alias("j")), "j").select(F.size("turns")).collect()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = [r.asDict() for r in corpus_pipeline.run(spark, SF).collect()]
    brute.check_packing(rows, bpe.coder(bpe.vocabulary()).tokenizer, texts)


def test_pipeline_with_repeated_ids(spark):
    say = lambda name, n=60: " ".join(f"{name}{i}" for i in range(n))
    made = [
        (1, say("a"), "x"), (2, say("b"), "x"), (2, say("b"), "y"), (2, say("a"), "x"), (2, say("c"), "x"), (3, say("d"), "x"),
        (3, say("e") + " " + say("d", 20), "x"), (None, say("f"), "x"), (None, say("f"), "x"), (None, say("a"), "x"),
    ]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string").repartition(3)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    want = [(1, made[0][1]), (2, made[1][1]), (2, made[4][1]), (3, made[5][1]), (3, made[6][1]), (None, made[7][1])]
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(rows, key=str) == sorted(want, key=str)
    cut = corpus_pipeline.cut_repeats(spark, kept, SF)
    assert cut.columns == docs.columns
    # one of the two rows of doc_id 3 gives up the passage that they share
    assert sum(len(r.text.split()) for r in cut.collect()) == 60 * 6
    assert sorted(r.doc_id or 0 for r in cut.collect()) == [0, 1, 2, 2, 3, 3]


def test_toxicity_counts_every_training_row(spark, monkeypatch):
    # the word of the last toxic rows stands in none of the few rows that the regression sees first
    made = [(i, f"fine words of a day {i} " + ("vile scum" if i % 3 == 0 else "")) for i in range(600)]
    texts = spark.createDataFrame(made, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE", 20)
    rows = toxicity.training(texts, marks)
    n, k = rows.count(), rows.where("toxic = 1").count()
    assert n > 400 and n == marks.where(~toxicity.held_out(F.col("doc_id"))).count()
    chosen, evidence = toxicity.select(rows, n, k)
    strong = dict(zip(chosen.tolist(), evidence.tolist(), strict=True))
    # a word of all toxic rows and of no other one has the evidence of all of them
    for bucket in toxicity.Features()["scum"]:
        assert strong[bucket] == pytest.approx(k * math.log(n / k), rel=1e-6)
    chosen, weights, _ = toxicity.train(texts, marks)
    assert set(toxicity.Features()["vile"]) <= set(chosen.tolist()) and (weights > 0).all()


def test_chat_deep_fields(spark):
    made = [
        '{"messages":[{"role":"user","content":"a","annotations":[{"type":[{"k":{"z":1}}]}]}]}',
        '{"messages":[{"role":"user","audio":{"meta":{"k":1}},"content":"a"}],"a b":{"c`d":{"e":[[{"f":1}]]}}}',
    ]
    rows = chat.canonical(spark.createDataFrame([(x,) for x in made], "j string"), "j").collect()
    assert [[tuple(t) for t in r.turns] for r in rows] == [[("user", "a")]] * 2
    inner = spark.createDataFrame([('{"data":{"messages":[{"role":"user","content":"a"}]}}',)], "j string")
    row = chat.canonical(inner, "j").select("layout", "turns").first()
    assert row.layout is None and row.turns is None
    got = inner.select(chat.paths(F.try_parse_json("j"))).first()[0]
    assert got == ["data", "data.messages", "data.messages[].content", "data.messages[].role"]


def test_chat_fingerprints(spark):
    made = ['{"prompt":"a","response":"b"}', '{"response":"d","prompt":"c"}', '{"prompt":"a","response":"b","id":1}', '{"prompt":"a","response":"b","meta":{"id":1}}']
    rows = chat.canonical(spark.createDataFrame([(x,) for x in made], "j string"), "j").collect()
    assert {r.layout for r in rows} == {"prompt_response"} and all(r.turns for r in rows)
    assert rows[0].fingerprint == rows[1].fingerprint and len({r.fingerprint for r in rows}) == 3
