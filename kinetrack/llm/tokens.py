"""Token ids of whole texts by a byte-level BPE vocabulary, and the cache of words that tokenisers here share."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes that a cache's newer half may take before it becomes the older half; bounds memory, not the result.
CACHE_BYTES = 64 << 20
#: What an entry takes beside its strings, about; and the longest string that is worth keeping.
ENTRY_BYTES, KEPT_LENGTH = 200, 64
# Fixed value: how byte-level vocabularies of this kind cut a text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class WordCache:
    """Values by string in two halves: what is met again moves to the newer one, and the older one goes when that is full.

    ``room`` is called once before each slice of data; all strings of a slice then stay until the next call.
    """

    def __init__(self, limit: int = CACHE_BYTES):
        self.limit, self.bytes = limit, 0
        self.new: dict[str, object] = {}
        self.old: dict[str, object] = {}
        self.passing: list[str] = []

    def room(self) -> dict:
        for key in self.passing:
            self.new.pop(key, None)
        self.passing = []
        if self.bytes > self.limit:
            self.old, self.new, self.bytes = self.new, {}, 0
        return self.new

    def missing(self, keys: Iterable[str]) -> list[str]:
        """The keys that have no value yet, each once."""
        wanted = set(keys).difference(self.new)
        back = wanted.intersection(self.old)
        for key in back:
            self.put(key, self.old[key])
        return list(wanted.difference(back))

    def put(self, key: str, value) -> None:
        self.new[key] = value
        if len(key) > KEPT_LENGTH:
            self.passing.append(key)
        else:
            self.bytes += ENTRY_BYTES + len(key) + len(value)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Encoder:
    """Ids of a byte-level tokenizers file, as that library gives them.

    The file's vocabulary is handed to tiktoken, which merges the same pairs in the same order and is three times as
    fast; a text on which its expression gives up (a white-space run of some 100,000 characters) goes to the
    tokenizers library itself. Files of another kind are refused.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        vocab, special = model["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        if model["type"] != "BPE" or spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError(f"{path}: only byte-level BPE without a normaliser is known")
        if max(vocab.values()) >= 1 << 16:
            raise ValueError(f"{path}: the vocabulary has more than 65,536 ids")
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if [vocab[a + b] for a, b in pairs] != list(range(256, 256 + len(pairs))):
            raise ValueError(f"{path}: ids are not in the order of merges")
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in vocab.items() if t not in special}
        self.fast = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.allowed = set() if special_as_text else set(special)
        self.slow = Tokenizer.from_file(path)
        self.slow.no_truncation()
        self.slow.no_padding()
        self.slow.encode_special_tokens = special_as_text

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint16)
        try:
            return self.fast.encode_to_numpy(text, allowed_special=self.allowed, disallowed_special=()).astype(np.uint16)
        except ValueError:
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint16)

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, ``end_id`` behind each, and where each begins and the last one ends."""
        end = np.array([end_id], np.uint16)
        rows = [x for text in texts for x in (self.ids(text), end)]
        bounds = np.cumsum([0, *(len(x) + 1 for x in rows[::2])])
        return np.concatenate([*rows, end[:0]]).astype("<u2"), bounds


@lru_cache(maxsize=2)
def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """The encoder of this process; later tasks of a worker find it ready."""
    return Encoder(path, special_as_text)


def binaries(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The ids of each text as one binary value."""
    at = pa.py_buffer((bounds * ids.itemsize).astype(np.int64))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, at, pa.py_buffer(ids)]).cast(pa.binary())


def texts_of(array) -> list[str]:
    return [x or "" for x in array.to_pylist()]
