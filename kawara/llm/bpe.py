"""Byte-pair encoding and decoding of whole texts, in trees of halves.

encode() cuts a long text in two, encodes each half, and joins the halves: a window around the cut, bounded by token
boundaries of both sides, is encoded anew and grows until its first tokens are the left half's and its last tokens
the right half's. The halves are independent, so at cluster scale long texts become rows of pieces that are encoded
in parallel and joined afterwards; the joins are the same code.

Why agreement makes the result exact: white space ends every word of the pre-tokenizer, so an encoding never reaches
across it, and inside a word a token sequence is the encoding if and only if each pair of neighbours is the encoding
of its own text. Each pair of the joined sequence stands in the left half, the window or the right half. The window
agrees on AGREE tokens on either side, and it is longer than any added token, so one that is cut is seen whole. A file
whose settings differ from those that this rests on (is_known_kind) is encoded by whole texts.

The pieces and ids of one document meet in one task, which so holds that document's text and ids; nothing else grows.

Defined results: a null text counts as empty and has no tokens. Repeated rows get equal results, an empty table gives
an empty one, and columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kawara.llm.common import WORKER_CACHE, map_rows

VOCABULARY = "word_bpe_49k.json"
#: Texts of at most this many code points are a leaf, and encoded at once.
LEAF = 1 << 14
#: Longer texts become rows of pieces.
ROW = 1 << 15
#: Code points on either side of a cut that the first window holds, and the tokens on which both sides must agree.
WINDOW, AGREE = 64, 2

_SPACE = re.compile("[ \n]+")


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: What the fast way below is made for. Other files are encoded whole by the library.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_END = "</w>"


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == kind)


#: _SPLIT for the characters of Latin-1.
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^\x09-\x0d\x20\x85\xa0{_class('L')}{_class('N')}]+")


def _bytes_of(token: str, alphabet: dict[str, int]) -> bytes:
    """A token's bytes; the end of a word is a space, which no word contains."""
    end = token.endswith(_END) and token != _END
    return bytes(alphabet[c] for c in (token[: -len(_END)] if end else token)) + b" " * end


def _alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes as: printable ones themselves, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


@functools.cache
def is_known_kind(path: str) -> bool:
    """Whether the file is of the kind that words and windows can be encoded apart for, checked piece by piece.

    Normaliser and pre-tokenizer have to be the fixed ones. Ids have to follow the merges' order and every token has to
    be the encoding of its own text: then merging the pair whose joint text has the smallest id is merging by the list
    (by the time that a text is merged, its two parts are the ones that they are in that text alone).
    """
    from tokenizers import Tokenizer, models

    data = json.loads(Tokenizer.from_file(path).to_str())
    split = (data["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    own = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    model = data["model"]
    plain = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": _END, "byte_fallback": False, "ignore_merges": False}
    if (
        (data["normalizer"] or {}).get("normalizers") != _NORMALIZER or len(split) != 2 or split[1] != own or data["post_processor"]
        or split[0] != {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}
        or any(model.get(k) != v for k, v in plain.items()) or any(t["normalized"] for t in data["added_tokens"])
    ):
        return False
    vocab, merges = model["vocab"], [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    made = [vocab[a + b] for a, b in merges]
    if made != sorted(set(made)) or any(vocab[x] >= k for (a, b), k in zip(merges, made, strict=True) for x in (a, b)):
        return False
    inner = Tokenizer(models.BPE(vocab, merges))
    last = Tokenizer(models.BPE(vocab, merges, end_of_word_suffix=_END))
    for one, tokens in ((inner, [t for t in vocab if not t.endswith(_END)]), (last, [t for t in vocab if t.endswith(_END)])):
        texts = [t.removesuffix(_END) for t in tokens]
        if any(e.ids != [vocab[t]] for t, e in zip(tokens, one.encode_batch_fast(texts, add_special_tokens=False), strict=True)):
            return False
    return True


class Words(dict):
    """The ids of a word, as little-endian unsigned 32-bit integers, remembered for the words seen lately.

    A word is what stands between spaces. In Latin-1 lower-casing is one character for one and nothing composes, so
    the pre-tokenizer's parts come from _WORDS; most words are a run of letters, perhaps with a comma or full stop.
    Any other word goes to the library.
    """

    #: Words of each of two generations: what the older one holds is found again, what nobody asks for is forgotten.
    REMEMBER = 150_000

    def __init__(self, tokenizer):
        import tiktoken

        super().__init__()
        self.older: dict[str, bytes] = {}
        self.tokenizer, alphabet = tokenizer, _alphabet()
        added = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
        ranks = {_bytes_of(t, alphabet): i for t, i in tokenizer.get_vocab().items() if t not in added}
        self.piece = tiktoken.Encoding("words", pat_str=r"[^ ]+ ", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.marks = {c: self._part(c) for c in ",."}

    def _part(self, part: str) -> bytes:
        return array("I", self.piece(part.encode() + b" ")).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self._encoded(word)
        if len(self) >= self.REMEMBER:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def _encoded(self, word: str) -> bytes:
        if not word:
            return b""
        if not word.isascii() and max(word) > "\xff":
            return array("I", self.tokenizer.encode_batch_fast([word], add_special_tokens=False)[0].ids).tobytes()
        if word.isalpha():
            low = word.lower()
            return self._part(low) if low == word else self[low]
        if word[-1] in self.marks and (stem := word[:-1]).isalpha():
            return self[stem.lower()] + self.marks[word[-1]]
        return b"".join(map(self._part, _WORDS.findall(word.lower())))


class Coder:
    """One vocabulary file. apart: whether it is of the known kind, so that texts can be encoded in parts."""

    def __init__(self, path: str, apart: bool | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.apart = is_known_kind(path) if apart is None else apart
        self.words = Words(self.tokenizer) if self.apart else None
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokens = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())]

    # A leaf is encoded by its words: a space or line feed always ends a word of the pre-tokenizer, and no normaliser
    # step reaches across one. Added tokens are matched first, so texts that hold one take the general way.
    def leaf(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not self.apart or any(t in text for t in self.added):
            return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))

    def spans(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids and the code points that each stands for."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        return e.ids, e.offsets

    def encode(self, text: str) -> bytes:
        if len(text) <= LEAF or not self.apart:
            return self.leaf(text)
        middle = len(text) // 2
        return self.join(text[:middle], self.encode(text[:middle]), text[middle:], self.encode(text[middle:]))

    def join(self, left: str, left_ids: bytes, right: str, right_ids: bytes) -> bytes:
        """The ids of left + right, of which both sides' are known."""
        if not left or not right:
            return left_ids or right_ids
        size = WINDOW
        while True:
            whole = size >= len(left) and size >= len(right)
            # The window starts and ends at white space where there is some in reach: there any encoding has a boundary.
            a, b = self._start(left, size), self._end(right, size)
            ids, at = self.spans(left[a:] + right[:b])
            cut = len(left) - a
            if whole:
                return np.array(ids, "<u4").tobytes()
            tail, tail_at = self.spans(left[a:])
            head, head_at = self.spans(right[:b])
            keep = self._prefix(ids, at, tail, tail_at)
            drop = self._suffix(ids, at, head, head_at, cut)
            # At a text's own end nothing has to agree; a side that is shorter than the window is encoded anew.
            if (a == 0 or keep >= AGREE) and (b == len(right) or drop >= AGREE) and self._ends(left_ids, tail) and self._starts(right_ids, head):
                own = np.array(ids, "<u4").tobytes()
                return left_ids[: len(left_ids) - 4 * len(tail)] + own + right_ids[4 * len(head) :]
            size *= 2

    @staticmethod
    def _start(left: str, size: int) -> int:
        """Where the window starts: the first white space in the outer half of its left side, or its far end."""
        far = max(0, len(left) - size)
        if far == 0:
            return 0
        found = _SPACE.search(left, far, len(left) - size // 2)
        return found.start() if found else far

    @staticmethod
    def _end(right: str, size: int) -> int:
        far = min(len(right), size)
        if far == len(right):
            return far
        found = None
        for found in _SPACE.finditer(right, size // 2, far):  # noqa: B007
            pass
        return found.end() if found else far

    @staticmethod
    def _prefix(ids: list, at: list, tail: list, tail_at: list) -> int:
        """Tokens at the start on which the window and the left side's end agree."""
        n = 0
        while n < min(len(ids), len(tail)) and ids[n] == tail[n] and at[n] == tail_at[n]:
            n += 1
        return n

    @staticmethod
    def _suffix(ids: list, at: list, head: list, head_at: list, cut: int) -> int:
        n = 0
        while n < min(len(ids), len(head)) and ids[-1 - n] == head[-1 - n] and at[-1 - n] == (head_at[-1 - n][0] + cut, head_at[-1 - n][1] + cut):
            n += 1
        return n

    @staticmethod
    def _ends(ids: bytes, tail: list) -> bool:
        return not tail or ids[-4 * len(tail) :] == np.array(tail, "<u4").tobytes()

    @staticmethod
    def _starts(ids: bytes, head: list) -> bool:
        return ids[: 4 * len(head)] == np.array(head, "<u4").tobytes()

    def decode(self, ids: bytes) -> str:
        """As the library does for a vocabulary without a decoder: the tokens with a space between."""
        if self.tokenizer.decoder is not None:
            return self.tokenizer.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def coder(path: str, apart: bool | None = None) -> Coder:
    """One for each worker process and vocabulary: workers serve many tasks, and keep what they have learnt."""
    if path not in WORKER_CACHE:
        WORKER_CACHE[path] = Coder(path, apart)
    return WORKER_CACHE[path]


def _pieces(text):
    n = F.length(text)
    return F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((n - 1) / ROW)).cast("int")),
        lambda i: F.struct(i.alias("piece"), F.substring(text, i * ROW + 1, F.lit(ROW)).alias("text")),
    )


def encode_with(docs: DataFrame, schema: str, finish, path: str | None = None) -> DataFrame:
    """finish(coder, doc_id, ids) for each document: rows (tuples) of schema. ids: little-endian unsigned 32-bit.

    Short texts are encoded where they are read. Pieces of long ones are dealt out, encoded in parallel, and meet
    again by document, where the joins are made.
    """
    path = path or vocabulary()
    apart = is_known_kind(path)
    docs = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    names = [x.split()[0] for x in schema.split(",")]

    def columns(rows):
        return dict(zip(names, map(list, zip(*rows, strict=True)) if rows else [[] for _ in names], strict=True))

    def whole():
        c = coder(path, apart)

        def step(batch: pa.RecordBatch) -> dict:
            return columns([r for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in finish(c, i, c.encode(t))])

        return step

    def pieces():
        c = coder(path, apart)

        def step(batch: pa.RecordBatch) -> dict:
            return {n: batch.column(n) for n in ("row", "doc_id", "piece", "text")} | {"ids": [c.encode(t) for t in batch.column("text").to_pylist()]}

        return step

    def joined(found: pa.Table) -> pa.Table:
        c = coder(path, apart)
        parts = sorted(found.select(["piece", "text", "ids"]).to_pylist(), key=lambda x: x["piece"])
        nodes = [(x["text"], x["ids"]) for x in parts]
        while len(nodes) > 1:  # the tree, from its leaves upwards
            pairs = [(a[0] + b[0], c.join(*a, *b)) for a, b in zip(nodes[::2], nodes[1::2], strict=False)]
            nodes = pairs + nodes[2 * len(pairs) :]
        out = columns(list(finish(c, found.column("doc_id")[0].as_py(), nodes[0][1])))
        return pa.Table.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))
    if not apart:
        return map_rows(docs, schema, whole, keeps_cache=True)
    short = map_rows(docs.where(F.length("text") <= ROW), schema, whole, keeps_cache=True)
    # a repeated row is a document of its own: the row number keeps its pieces apart
    long = docs.where(F.length("text") > ROW).withColumn("row", F.monotonically_increasing_id())
    cut = long.select("row", "doc_id", F.explode(_pieces(F.col("text"))).alias("p")).select("row", "doc_id", "p.piece", "p.text")
    cut = cut.repartition(F.xxhash64("row", "piece"))
    encoded = map_rows(cut, "row long, doc_id long, piece int, text string, ids binary", pieces, keeps_cache=True)
    return short.unionByName(encoded.groupBy("row").applyInArrow(joined, schema))


def _digests(c: Coder, doc_id: int | None, ids: bytes):
    import hashlib

    yield doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest()


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Each text encoded and decoded again, as digests."""
    return encode_with(docs, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", _digests, path)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids)."""
    return encode_with(docs, "doc_id long, ids array<int>", lambda c, i, ids: [(i, np.frombuffer(ids, "<i4"))], path)


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""
    path = path or vocabulary()

    def make():
        c = coder(path)
        return lambda batch: {
            "doc_id": batch.column(0),
            "text": [c.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()],
        }

    return map_rows(rows.select("doc_id", "ids"), "doc_id long, text string", make, keeps_cache=True)
