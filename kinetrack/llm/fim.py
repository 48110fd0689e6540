"""Fill-in-middle transformation by content-defined chunk memoization.

A rolling hash of the last 32 bytes cuts texts into chunks whose borders depend on content alone, so passages that
documents share give the same chunks. Each distinct chunk is summarised once a worker (lines, code points, marks, and
its border bytes); the cache is looked up by content, never by hash alone. A document's line count and the byte and
code point of each cut come from adding the summaries of its chunks up; only the two chunks that hold a cut are read
again.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, slices

#: The marks of the output, in the order prefix, suffix, middle.
MARKS = ("<P>", "<S>", "<M>")
#: A chunk holds from LEAST to MOST bytes, about 2 ** BITS on average; the last one of a text may be shorter.
LEAST, MOST, BITS = 64, 8192, 9
#: Bytes that are hashed at a time; bounds the memory of a long text, not what is read.
STRETCH = 1 << 20
#: What the newer half of the cache may take, and what an entry takes beside its bytes, about.
CACHE_BYTES, ENTRY_BYTES = 32 << 20, 300
GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, np.uint32)
CONTINUING = bytes(range(0x80, 0xC0))


class Summary(NamedTuple):
    """What a chunk adds to its text: lines that end in it, code points that begin in it, whether a mark lies inside, border bytes."""

    lines: int
    points: int
    marked: bool
    head: bytes
    tail: bytes


def borders(data: np.ndarray) -> np.ndarray:
    """Places behind which the rolling hash allows a border: its top BITS are zero. Depends on the 32 bytes before each place."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):  # the hash of 2 * step bytes from two of step bytes
        h[step:] += h[:-step] << np.uint32(step)
    return np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1


def chunks(data: np.ndarray, start: int, end: int) -> list[int]:
    """Ends of the chunks of data[start:end]."""
    out, last = [], start
    for a in range(start, end, STRETCH):
        b = min(a + STRETCH, end)
        lead = min(31, a - start)
        found = borders(data[a - lead : b]) + (a - lead)
        for at in found[found > a].tolist():
            while at - last > MOST:
                out.append(last := last + MOST)
            if at - last >= LEAST:
                out.append(last := at)
    while end - last > MOST:
        out.append(last := last + MOST)
    if last < end:
        out.append(end)
    return out


class ChunkCache:
    """Summaries by the bytes of the chunk, in two halves; the older one goes when the newer one is full."""

    def __init__(self, limit: int = CACHE_BYTES, marks: tuple[str, ...] = MARKS):
        self.limit, self.bytes = limit, 0
        self.marks = [m.encode() for m in marks]
        self.new: dict[bytes, Summary] = {}
        self.old: dict[bytes, Summary] = {}

    def get(self, chunk: bytes) -> Summary:
        found = self.new.get(chunk)
        if found is None:
            found = self.old.get(chunk) or Summary(chunk.count(b"\n"), len(chunk.translate(None, CONTINUING)), any(m in chunk for m in self.marks), chunk[:2], chunk[-2:])
            if self.bytes > self.limit:
                self.old, self.new, self.bytes = self.new, {}, 0
            self.new[chunk] = found
            self.bytes += ENTRY_BYTES + len(chunk)
        return found


class Lines:
    """Line counts of one text, and the byte and code point behind each of its lines."""

    def __init__(self, text: bytes, cache: ChunkCache):
        self.text = text
        self.ends = chunks(np.frombuffer(text, np.uint8), 0, len(text))
        told = [cache.get(text[a:b]) for a, b in zip([0, *self.ends], self.ends, strict=False)]
        self.lines, self.points = list(accumulate(s.lines for s in told)), list(accumulate(s.points for s in told))
        self.count = (self.lines[-1] if told else 0) + (bool(text) and not text.endswith(b"\n"))
        tail, self.marked = b"", False
        for s in told:  # a mark may lie across borders
            joint = tail + s.head
            self.marked |= s.marked or any(m in joint for m in cache.marks)
            tail = (tail + s.tail)[-2:]

    def behind(self, k: int) -> tuple[int, int]:
        """Byte and code point at which the first ``k`` lines end."""
        if k == 0:
            return 0, 0
        if not self.lines or k > self.lines[-1]:
            return len(self.text), self.points[-1] if self.points else 0
        at = bisect_left(self.lines, k)
        start = self.ends[at - 1] if at else 0
        chunk = self.text[start : self.ends[at]]
        inside = int(np.flatnonzero(np.frombuffer(chunk, np.uint8) == 10)[k - 1 - (self.lines[at - 1] if at else 0)]) + 1
        return start + inside, (self.points[at - 1] if at else 0) + len(chunk[:inside].translate(None, CONTINUING))


@lru_cache(maxsize=2)
def cache_of(marks: tuple[str, ...]) -> ChunkCache:
    """The cache of this process: later tasks of a worker find the chunks that earlier ones met."""
    return ChunkCache(marks=marks)


def draws(seed: int, name: int | None) -> list[int]:
    """The first four 8-digit groups of the SHA-256 of ``seed:name``, as numbers; a null name counts as empty."""
    digest = sha256(f"{seed}:{'' if name is None else name}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def rearranged(name: int | None, text: bytes, cache: ChunkCache, rate: int, spm_rate: int, seed: int) -> tuple[int, str, int | None, int | None, bytes]:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    h1, h2, h3, h4 = draws(seed, name)
    told = Lines(text, cache)
    n = told.count
    if not text or told.marked or h3 % 100 >= rate:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    (i, a), (j, b) = told.behind(low), told.behind(high)
    p, s, m = cache.marks
    parts = (s, text[j:], p, text[:i], m, text[i:j]) if h4 % 100 < spm_rate else (p, text[:i], s, text[j:], m, text[i:j])
    return n, "spm" if h4 % 100 < spm_rate else "psm", a, b - a, b"".join(parts)


TYPES = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]


def fill_in_middle(docs: DataFrame, rate: int = 100, spm_rate: int = 50, seed: int = 7, marks: tuple[str, str, str] = MARKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n (lines of the text), form, prefix_chars, middle_chars and the output text.

    The cut points, the form and whether a text is left plain depend on ``seed`` and the id alone, so repeated rows
    give repeated results and rows without an id draw as if the id were empty. A null text counts as empty; an empty
    text, and one that contains a mark, stays plain. Very long texts are cut whole. An empty table gives no row; other
    columns are not read. Narrow: nothing is shuffled, and a lost task reads its rows again.
    """
    if len(marks) != 3 or any(len(m.encode()) != 3 or "\n" in m or m[0] in m[1:] for m in marks):
        raise ValueError("marks are three strings of three bytes whose first character does not come again")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = cache_of(tuple(marks))
        for batch in batches:
            for part in slices(batch, 1):
                ids = part.column(0).to_pylist()
                rows = [rearranged(name, text, cache, rate, spm_rate, seed) for name, text in zip(ids, byte_rows(part.column(1)), strict=True)]
                n, form, prefix, middle, output = zip(*rows, strict=True)
                columns = [ids, n, form, prefix, middle]
                arrays = [pa.array(c, t) for c, (_, t) in zip(columns, TYPES[:-1], strict=True)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(output, pa.binary()).cast(pa.string())], [c for c, _ in TYPES])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str = "output", form: str = "form", marks: tuple[str, str, str] = MARKS) -> Column:
    """The text from which ``fill_in_middle`` made ``output``. Built-in functions only; null output gives null."""
    p, s, m = (F.lit(x) for x in marks)
    o = F.col(output)
    width = len(marks[0])

    def between(start: Column, stop: Column) -> Column:
        return F.substring(o, start, stop - start)

    at_p, at_s, at_m = F.instr(o, p), F.instr(o, s), F.instr(o, m)
    middle = F.substring(o, at_m + width, F.length(o))
    psm = F.concat(between(at_p + width, at_s), middle, between(at_s + width, at_m))
    spm = F.concat(between(at_p + width, at_m), middle, between(at_s + width, at_p))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(o)
