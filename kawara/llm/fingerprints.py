"""Exact document fingerprints of canonical texts, in DataFrame operations only.

The canonical form applies Unicode normalisation (NFKC), full case folding, and folds runs of white space into one
space. The fingerprint is 128 bits of xxhash over its bytes: two differently seeded 64-bit lanes. Equal canonical
texts have equal fingerprints; where fingerprints are equal, the canonical bytes are compared, so that a collision
can neither merge classes nor count as likeness. The likeness of two fingerprints is 1 or 0.

The next document (descending doc_id) is found without a global sort: documents are cut into ranges at keys that a
bounded sample of the table holds, so ranges are even however the ids lie, and each range is sorted on its own. A
range's upper end is a document of the table; a copy of that document goes to the range above as well, where it is the
last one's next. So texts move once, and no range waits for another.

Defined results: a null text counts as empty. doc_ids may be any 64-bit integers. Rows that share a doc_id, or have
none (they come last), follow each other by falling xxhash of their texts; rows that share both lie in one range.
The last document's next is the first one; a single document is its own next one. An empty table gives an empty
result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kawara.llm.common import BROADCAST_IDS, written

#: Documents in a range, about, and the most ranges there are; sampled keys for each range.
RANGE, RANGES, SAMPLED = 256, 32_768, 8
#: Parts of the documents that meet their classes by shuffle, where the classes are too many to broadcast.
SALT = 32
_ICU = "com.ibm.icu"


def canonical(text: Column) -> Column:
    composed = F.java_method(F.lit(f"{_ICU}.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    folded = F.java_method(F.lit(f"{_ICU}.lang.UCharacter"), F.lit("foldCase"), composed, F.lit(True))
    return F.trim(F.regexp_replace(folded, r"[\s\p{Z}\x{85}]+", " "))


def fingerprint(canon: Column) -> Column:
    lanes = [F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), canon))), 16, "0") for seed in (1, 2)]
    return F.concat(*lanes)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, text, canon, fingerprint."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("canon", canonical(F.col("text"))).withColumn("fingerprint", fingerprint(F.col("canon")))


def classes(docs: DataFrame) -> DataFrame:
    """(fingerprint, class_id, other) for the fingerprints that stand more than once.

    class_id is the smallest doc_id with these canonical bytes; other is null unless different bytes share the
    fingerprint, and then their SHA-256. Only texts of repeated fingerprints move, one copy from each task.
    """
    rows = fingerprinted(docs)
    again = rows.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint")
    short = again.limit(BROADCAST_IDS // 4 + 1).count() <= BROADCAST_IDS // 4
    some = rows.join(F.broadcast(again) if short else again, "fingerprint", "left_semi")
    same = some.groupBy("fingerprint", "canon").agg(F.min("doc_id").alias("class_id"))
    same = same.select("fingerprint", "class_id", F.sha2(F.col("canon").cast("binary"), 256).alias("bytes"))
    per = same.groupBy("fingerprint").agg(F.collect_list(F.struct("bytes", "class_id")).alias("c"))
    one = F.size("c") == 1
    return per.select("fingerprint", F.explode("c").alias("c"), one.alias("one")).select(
        "fingerprint", "c.class_id", F.when(~F.col("one"), F.col("c.bytes")).alias("other")
    )


def order_key(doc_id: Column, text: Column) -> Column:
    """A string that sorts as (doc_id, xxhash of the text) do; null doc_ids come first."""
    low = F.expr("shiftleft(1L, 63)")
    hexed = lambda c: F.lpad(F.hex(c.bitwiseXOR(low)), 16, "0")
    return F.concat(F.when(doc_id.isNull(), "0").otherwise("1"), hexed(F.coalesce(doc_id, F.lit(0).cast("long"))), hexed(F.xxhash64(text)))


def upper_ends(rows: DataFrame) -> list[str]:
    """Falling keys of documents of the table, the greatest one first: where its ranges start."""
    n, top = rows.agg(F.count("*"), F.max("key")).first()
    ranges = min(RANGES, n // RANGE)
    if ranges < 2:
        return [top] if n else []
    keys = rows.sample(min(1.0, SAMPLED * ranges / n), seed=7).select("key").collect()  # SAMPLED * RANGES keys, about
    keys = sorted({r[0] for r in keys} - {top}, reverse=True)
    return [top, *keys[:: max(1, len(keys) // ranges)]]


def with_next(rows: DataFrame, carry: list[str]) -> DataFrame:
    """rows with the carried columns of the next document in descending doc_id, prefixed next_."""
    keyed = rows.withColumn("key", order_key(F.col("doc_id"), F.col("text")))
    ends = upper_ends(keyed.select("key"))
    if not ends:
        return rows.select("*", *(F.col(c).alias(f"next_{c}") for c in carry))
    known = F.split(F.lit(",".join(ends)), ",")
    # the last end that is not under the key, by halving: a bounded literal, looked up in place
    state = F.struct(F.lit(0).alias("lo"), F.lit(len(ends) - 1).alias("hi"))
    middle = lambda s: F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")

    def halve(s: Column, _: Column) -> Column:
        far = F.get(known, middle(s)) >= F.col("key")
        return F.struct(F.when(far, middle(s)).otherwise(s["lo"]).alias("lo"), F.when(far, s["hi"]).otherwise(F.greatest(s["lo"], middle(s) - 1)).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(max(1, len(ends).bit_length())))
    keyed = keyed.withColumn("range", F.aggregate(steps, state, halve, lambda s: s["lo"]))
    own = F.array(F.struct("range", F.lit(0).alias("copy")))
    above = F.array(F.struct(F.pmod(F.col("range") - 1, F.lit(len(ends))).alias("range"), F.lit(1).alias("copy")))
    places = F.when(F.get(known, F.col("range")) == F.col("key"), F.concat(own, above)).otherwise(own)
    keyed = keyed.withColumn("place", F.explode(places)).select(*rows.columns, "key", "place.range", "place.copy")
    order = Window.partitionBy("range").orderBy("copy", F.desc("key"), F.desc("text"))
    seen = keyed.withColumn("next", F.lead(F.struct(*carry)).over(order)).where("copy = 0")
    return seen.select(*rows.columns, *(F.col(f"next.{c}").alias(f"next_{c}") for c in carry))


def likeness(fp: str, other: str, canon: Column, other_canon: Column) -> Column:
    """1 for equal fingerprints of equal bytes; the bytes are only made where the fingerprints are equal."""
    return F.when(F.col(fp) != F.col(other), F.lit(0.0)).otherwise((canon == other_canon).cast("double"))


def report(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document."""
    rows = fingerprinted(docs).withColumn("bytes", F.sha2(F.col("canon").cast("binary"), 256))
    rows = rows.select("doc_id", "text", "fingerprint", "bytes")
    rows = with_next(rows, ["text", "fingerprint"]).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next_text", F.lit(1), cut)
    )
    rows = rows.withColumn("edited", edited).withColumn("edited_canon", canonical(F.col("edited")))
    rows = rows.withColumn("edited_fingerprint", fingerprint(F.col("edited_canon")))
    own = canonical(F.col("text"))
    rows = rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint", own, F.col("edited_canon")).alias("near_edited"),
        likeness("fingerprint", "next_fingerprint", own, canonical(F.col("next_text"))).alias("near_next"),
        "bytes",
    )
    found = written(classes(docs).withColumnRenamed("fingerprint", "shared"), "classes")
    same = (F.col("fingerprint") == F.col("shared")) & (F.col("other").isNull() | (F.col("other") == F.col("bytes")))
    if found.limit(BROADCAST_IDS // 4 + 1).count() <= BROADCAST_IDS // 4:
        found = F.broadcast(found)
    else:  # a fingerprint may be that of a third of all documents: they are dealt over SALT parts
        found = found.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        same &= F.col("part") == F.pmod(F.xxhash64("doc_id", "edited_sha256"), F.lit(SALT))
    rows = rows.join(found, same, "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    return rows.drop("shared", "other", "bytes", "part")
