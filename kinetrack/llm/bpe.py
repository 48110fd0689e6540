"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The leaves hold, for each pair of neighbouring symbols, ``rank << 32 | position`` (or a sentinel where the pair
has no merge); every inner node holds the smaller of its children. The root is the leftmost pair of the lowest
rank. A merge changes at most three leaves, so a word of n symbols takes O(n log n), however long it is.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .tokens import WordCache, byte_symbols, texts_of

NONE = 1 << 62
MASK = (1 << 32) - 1


def merge_symbols(symbols: list[int], merges: dict[int, tuple[int, int]]) -> list[int]:
    """Apply BPE merges to symbols (numbers below 2**16): lowest rank first, leftmost first.

    ``merges`` maps ``left << 16 | right`` to ``(rank << 32, merged)``.
    """
    n = len(symbols) - 1
    if n < 1:
        return symbols
    get = merges.get
    leaves = []
    for i in range(n):
        m = get(symbols[i] << 16 | symbols[i + 1])
        leaves.append(m[0] | i if m else NONE)
    size = 1 << (n - 1).bit_length()
    tree = [NONE] * size + leaves + [NONE] * (size - n)
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    if (root := tree[1]) == NONE:
        return symbols
    symbols = symbols.copy()
    after, before = list(range(1, n + 2)), list(range(-1, n))
    while root != NONE:
        i = root & MASK
        j = after[i]
        merged = symbols[i] = get(symbols[i] << 16 | symbols[j])[1]
        symbols[j] = -1
        k = after[i] = after[j]
        h = before[i]
        fresh = NONE
        if k <= n:
            before[k] = i
            if m := get(merged << 16 | symbols[k]):
                fresh = m[0] | i
        changed = [(i, fresh)]
        if j < n:  # the pair (j, k) is gone
            changed.append((j, NONE))
        if h >= 0:
            m = get(symbols[h] << 16 | merged)
            changed.append((h, m[0] | h if m else NONE))
        for at, value in changed:
            at += size
            if tree[at] != value:
                tree[at] = value
                at >>= 1
                while at:
                    a, b = tree[2 * at], tree[2 * at + 1]
                    if b < a:
                        a = b
                    if tree[at] == a:
                        break
                    tree[at] = a
                    at >>= 1
        root = tree[1]
    return [s for s in symbols if s >= 0]


class BpeCodec:
    """Encoder and decoder of a tokenizer file whose model is BPE over byte symbols with a word-end suffix.

    It reads the normaliser's and pre-tokeniser's steps from the file and refuses kinds that it does not know.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        model, pre = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in pre] != ["Split", "ByteLevel"] or spec.get("decoder"):
            raise ValueError(f"{path}: only NFC, white-space, lower-case, split, byte-level BPE without a decoder is known")
        self.vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        v = self.vocab
        if max(v.values()) >= 1 << 16:
            raise ValueError(f"{path}: the vocabulary has more than 65,536 ids")
        self.merges = {v[a] << 16 | v[b]: (rank << 32, v[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        self.split = regex.compile(pre[0]["pattern"]["Regex"])
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        symbols = byte_symbols()
        self.inner, self.last = [v.get(x) for x in symbols], [v.get(x + self.suffix) for x in symbols]
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in special.items()}
        self.byte_of = {c: b for b, c in enumerate(symbols)}
        self.ids, self.text = WordCache(), WordCache()
        self.known: set[str] = set()

    def word_ids(self, word: str) -> list[int]:
        raw = word.encode("utf-8")
        symbols = [*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]]
        return merge_symbols([x for x in symbols if x is not None] if None in symbols else symbols, self.merges)

    def lowered(self, text: str) -> str:
        """The normaliser's steps, but for white space, which no id depends on."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # the library lowers character by character
                return "".join(map(str.lower, text))
        return text.lower()

    def foreign(self, text: str) -> bool:
        """Whether Python's Unicode tables do not know some character that the library's may know."""
        fresh = set(text).difference(self.known)
        strange = {c for c in fresh if unicodedata.category(c) == "Cn"}
        self.known |= fresh - strange
        return bool(strange)

    def plain_words(self, text: str) -> list[str]:
        if not text.isascii() and self.foreign(text):
            found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [bytes(map(self.byte_of.__getitem__, w)).decode() for w, _ in found]
        return self.split.findall(self.lowered(text))

    def words(self, text: str) -> list[str]:
        """Special tokens, and the words of what lies between them."""
        if self.special_at and "<|" in text:
            return [w for k, run in enumerate(self.special_at.split(text)) for w in ([run] if k % 2 else self.plain_words(run))]
        return self.plain_words(text)

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens joined by spaces: what a file without a decoder stands for."""
        return " ".join(self.token[i] for i in ids if i in self.token)

    def encode_batch(self, texts: list[str]) -> tuple[list[str], list[str]]:
        """Of each text its ids (decimal, joined by spaces) and its decoded form."""
        cut = [self.words(t) for t in texts]
        ids, text, words = self.ids.room(), self.text.room(), set(chain.from_iterable(cut))
        for w in self.ids.missing(words):
            self.ids.put(w, " ".join(map(str, [self.special[w]] if w in self.special else self.word_ids(w))))
        for w in self.text.missing(words):
            self.text.put(w, self.decode(map(int, ids[w].split())))
        return [" ".join(filter(None, map(ids.__getitem__, c))) for c in cut], [" ".join(filter(None, map(text.__getitem__, c))) for c in cut]

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.encode_batch([text])[0][0].split()]


@lru_cache(maxsize=2)
def codec_of(path: str) -> BpeCodec:
    """The codec of this process: later tasks of a worker find the words that earlier ones met."""
    return BpeCodec(path)


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def count(ids: str) -> int:
    return ids.count(" ") + 1 if ids else 0


def encode_texts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_tokens, the ids (decimal, joined by spaces) and the decoded text. Null text counts as empty.

    Repeated rows give repeated rows; no value depends on another row. Narrow: nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(tokenizer_path)
        for batch in batches:
            for part in slices(batch, 1):
                ids, decoded = codec.encode_batch(texts_of(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(count, ids), pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids string, decoded string")


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``encode_texts`` with SHA-256 digests in place of the ids and the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(tokenizer_path)
        for batch in batches:
            for part in slices(batch, 1):
                ids, decoded = codec.encode_batch(texts_of(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(count, ids), pa.int64()), pa.array(map(digest, ids), pa.string()), pa.array(map(digest, decoded), pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
