"""Byte-level BPE encoding and decoding; long texts by tree concatenation.

A text of more than LONG characters is halved again and again; the pieces are encoded in one parallel call and joined pair by
pair. At a join, the window from the last sure word start of the left side into the right side is encoded anew, and grows until
a word start in it is one of the right side too. A word start is sure once three characters and a character other than white
space follow it in the window: nothing behind can move it, as the split pattern looks ahead no further. From a common word
start on both scans read the same text, so the joined ids are those of the whole text. In a word that is itself long (text
without a split), windows are cut at tokens instead, and grow until their first and last tokens are those of both sides: a
sequence whose neighbouring tokens were all neighbours in an encoding is the encoding.

Defined results: null and empty texts have no tokens; bytes that are not UTF-8 count as U+FFFD. An empty table gives an empty table. Very long texts are coded whole. Every row is coded alone, so repeated rows, null ids and order play no
part; further columns stay out of the result. Strings of special tokens in a text become those tokens, as the library does.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_of

LONG = 32_768
LEAF = 8_192
#: A word of more than this many characters is joined at tokens.
LONG_WORD = 4_096
THREADS = "2"
#: What the split pattern takes for white space; Python's own strip() takes U+001C to U+001F too.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


@dataclass
class Part:
    """An encoded stretch of text: ids, the character at which each starts, and which start a word."""

    text: str
    ids: list[int]
    starts: list[int]
    word: list[bool]


class Coder:
    def __init__(self, model: str, long: int = LONG, leaf: int = LEAF, long_word: int = LONG_WORD):
        os.environ.setdefault("RAYON_NUM_THREADS", THREADS)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(model)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.long, self.leaf, self.long_word = long, leaf, long_word
        self.added = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.bytes = self._byte_table()

    def _byte_table(self) -> list[bytes]:
        """The bytes of each id: printable bytes stand for themselves, the others for characters from U+0100 on."""
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        rest = [b for b in range(256) if b not in set(own)]
        at = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}
        vocab = self.tok.get_vocab(with_added_tokens=True)
        table = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            table[i] = piece.encode() if piece in self.added else bytes(at[c] for c in piece)
        return table

    # Encoding

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text; short texts and the pieces of long ones go to the library in parallel calls."""
        out: list[list[int] | None] = [None] * len(texts)
        short = [k for k, t in enumerate(texts) if len(t) <= self.long]
        for k, e in zip(short, self.tok.encode_batch_fast([texts[k] for k in short], add_special_tokens=False), strict=True):
            out[k] = e.ids
        for k, t in enumerate(texts):
            if out[k] is None:
                out[k] = self._encode_long(t)
        return out

    def _encode_long(self, text: str) -> list[int]:
        ids: list[int] = []
        for piece in self._between_added(text):
            if isinstance(piece, int):
                ids.append(piece)
            elif len(piece) <= self.long:
                ids += self.tok.encode(piece, add_special_tokens=False).ids
            else:
                ids += self._tree(piece).ids
        return ids

    def _between_added(self, text: str) -> list[str | int]:
        import re

        if not self.added:
            return [text]
        cut = re.split("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")", text)
        return [self.added[p] if k % 2 else p for k, p in enumerate(cut) if p]

    def _part(self, text: str, e) -> Part:
        words = e.word_ids
        return Part(text, e.ids, [a for a, _ in e.offsets], [k == 0 or words[k] != words[k - 1] for k in range(len(words))])

    def _encode_parts(self, texts: list[str]) -> list[Part]:
        return [self._part(t, e) for t, e in zip(texts, self.tok.encode_batch(texts, add_special_tokens=False), strict=True)]

    def _tree(self, text: str) -> Part:
        n = 1
        while len(text) / n > self.leaf:
            n *= 2
        cuts = [len(text) * k // n for k in range(n + 1)]
        parts = self._encode_parts([text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
        while len(parts) > 1:
            parts = [self._join(parts[k], parts[k + 1]) for k in range(0, len(parts), 2)]
        return parts[0]

    @staticmethod
    def _glue(left: Part, i: int, mid: Part, at: int, j_mid: int, right: Part, j: int) -> Part:
        """left's ids before i, mid's (whose text starts at character `at`) before j_mid, right's from j."""
        n = len(left.text)
        return Part(
            left.text + right.text,
            left.ids[:i] + mid.ids[:j_mid] + right.ids[j:],
            left.starts[:i] + [s + at for s in mid.starts[:j_mid]] + [s + n for s in right.starts[j:]],
            left.word[:i] + mid.word[:j_mid] + right.word[j:],
        )

    def _join(self, left: Part, right: Part) -> Part:
        m = len(left.text)
        # The last sure word start of the left side; at worst its beginning.
        i = max((k for k in range(len(left.ids) - 1, -1, -1) if left.word[k]), default=0)
        while i and not (left.word[i] and left.starts[i] + 3 <= m and left.text[left.starts[i] :].strip(WHITE)):
            i -= 1
            while i and not left.word[i]:
                i -= 1
        p = left.starts[i] if left.ids else 0
        first = next((k for k in range(1, len(right.ids)) if right.word[k]), len(right.ids))
        end = right.starts[first] if first < len(right.ids) else len(right.text)
        if m - p > self.long_word and end > self.long_word:
            joined = self._join_in_word(left, i, right, first)
            if joined:
                return joined
        grow = 64
        while True:
            if grow >= len(right.text):
                (mid,) = self._encode_parts([left.text[p:] + right.text])
                return self._glue(left, i, mid, p, len(mid.ids), right, len(right.ids))
            (mid,) = self._encode_parts([left.text[p:] + right.text[:grow]])
            theirs = {s: k for k, s in enumerate(right.starts) if right.word[k] and s < grow}
            for k, s in enumerate(mid.starts):
                x = s + p - m
                if mid.word[k] and x >= 0 and x in theirs and x + 3 <= grow and right.text[x:grow].strip(WHITE):
                    return self._glue(left, i, mid, p, k, right, theirs[x])
            grow *= 4

    def _join_in_word(self, left: Part, i: int, right: Part, first: int) -> Part | None:
        """The join inside one long word, from left's token i to right's before `first`; None if the cut is a word's end after all."""
        m = len(left.text)
        grow = 16
        while True:
            a, b = len(left.ids) - grow, grow
            while a > i and (left.starts[a] == left.starts[a - 1] or left.starts[a] + 1 > m or a + 1 < len(left.ids) and left.starts[a + 1] == left.starts[a]):
                a -= 1  # the window starts with a whole character
            while b < first and right.starts[b] == right.starts[b - 1]:
                b += 1
            if a <= i or b >= first:
                return None
            (mid,) = self._encode_parts([left.text[left.starts[a] :] + right.text[: right.starts[b]]])
            if sum(mid.word) > 1:
                return None
            if mid.ids[0] == left.ids[a] and mid.ids[-1] == right.ids[b - 1]:
                mid.word[0] = False
                return self._glue(left, a, mid, left.starts[a], len(mid.ids), right, b)
            grow *= 4

    # Decoding

    def decode(self, ids: list[int]) -> bytes:
        """The text in UTF-8, as the library's decode(ids, skip_special_tokens=False) gives it."""
        raw = b"".join(map(self.bytes.__getitem__, ids))
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()


@lru_cache(maxsize=4)
def _coder(model: str) -> Coder:
    return Coder(model)


def model_text(path: str | None = None) -> str:
    """A tokenizer file, read by the driver; by default the public byte-level vocabulary of 50,257 ids."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def _encoded(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    coder = _coder(model.value)
    for b in batches:
        ids = coder.encode_batch(b.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    coder = _coder(model.value)
    for b in batches:
        texts = [coder.decode(x or []).decode() for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])


def _digests(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    import numpy as np

    coder = _coder(model.value)
    for b in batches:
        n, packed, decoded = [], [], []
        for ids in coder.encode_batch(b.column(1).to_pylist()):
            n.append(len(ids))
            packed.append(hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
            decoded.append(hashlib.sha256(coder.decode(ids)).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(packed, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _run(rows: DataFrame, f, schema: str, path: str | None) -> DataFrame:
    model = rows.sparkSession.sparkContext.broadcast(model_text(path))  # one vocabulary file, some MB
    return map_batches(rows, partial(f, model=model), schema)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text."""
    return _run(_texts(docs), _encoded, "doc_id long, ids array<int>", path)


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""
    return _run(rows.select("doc_id", F.col("ids").cast("array<int>").alias("ids")), _decoded, "doc_id long, text string", path)


def coded_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoded, then decoded, in one pass."""
    return _run(_texts(docs), _digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", path)


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    return coded_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
