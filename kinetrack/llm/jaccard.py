"""N-gram Jaccard join by parity sketches.

A document's set is its distinct word 5-grams. A parity sketch toggles one bit for each member, so that the
Hamming distance of two sketches is at most the sets' symmetric difference. Sizes a <= b with a Jaccard
similarity of s differ by at most (a + b)(1 - s)/(1 + s), and b is at most a / s; with s = 0.8 that is a/4.

Candidates: per size band the sketch has p slices, far wider than a set, so a slice is stored as the XOR of 64-bit
hashes of its set bits. At most d = a/4 slices can differ. Each document emits its first d + 1 non-empty slices in
an order that depends on a slice's content alone (most uncommon members first). Of the document whose last
emitted slice comes first in that order, one of the d + 1 is unchanged in the other one, which emits it too. Sets
just below a band's upper edge emit for the next band as well.

Verification: sizes, then the Hamming distance of 1,024-bit sketches, then the exact intersection.

A bucket of g documents is first joined as a star: its smallest member against each of the others, then its 8
smallest. Members that links have joined need no further test, so a group of a thousand near copies costs about a
thousand tests. What then still stands apart in a bucket is compared by sketches, chunk against chunk, and only pairs
that pass are emitted and verified. So every pair of a bucket is joined, or tested, or ruled out by its sketches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_rows, save, slices, with_texts
from .components import components

SHINGLE = 5
SKETCH_BITS = 1024
#: Documents in the sample that tells common members from uncommon ones. It orders slices; no result depends on it.
SAMPLE_DOCS = 3000
BANDS = [0, 64, *[round(64 * 2.5**k) for k in range(1, 22)]]
CACHE_WORDS = 250_000
_MULT = np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Centres a bucket in the rounds of stars, and members of a chunk in the round that compares all that is left.
STARS = (1, 8)
BLOCK = 1024


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Distinct hashed shingles of a text's words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased)."""

    def __init__(self, k: int = SHINGLE):
        self.k, self.words = k, {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        table = self.words
        if len(table) > CACHE_WORDS:
            table.clear()
        for w in set(words).difference(table):
            table[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
        k = min(self.k, len(h))
        mixed = np.full(len(h) - k + 1, np.uint64(k))
        for j in range(k):
            mixed += h[j : len(h) - k + 1 + j] * _MULT[j]
        return np.unique(_mix(mixed))


def sketch(members: np.ndarray, bits: int = SKETCH_BITS) -> bytes:
    """Parity of the members that fall on each bit."""
    odd = np.bincount((members >> np.uint64(40)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def slice_keys(members: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Keys of the slices that a set emits, over the bands that it takes part in."""
    n = len(members)
    out = []
    band = int(np.searchsorted(BANDS, n, side="right")) - 1
    rare = (~within(common, members)).astype(float)
    for b in [band] + [band + 1] * (n * 5 // 4 >= BANDS[band + 1]):
        parts = max(128, BANDS[b + 1] // 3)
        part = (_mix(members ^ np.uint64(b)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        at = np.flatnonzero(np.diff(part[order], prepend=-1))
        need = n // 4 + 1
        if len(at) < need:  # too many members share slices: two such sets may agree in empty ones only, and meet under one key
            out.append(np.array([b], np.uint64))
        held = np.bitwise_xor.reduceat(_mix(members + np.uint64(b))[order], at)
        keys = _mix(held + part[order][at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(b))
        counts = np.diff(np.append(at, n))
        uncommon = np.add.reduceat(rare[order], at)
        out.append(keys[np.lexsort((keys, -counts, -uncommon))[:need]])
    return np.concatenate(out)


SET_ROWS = "doc_id long, n_shingles long, digest binary, sketch binary, keys array<long>, hot_keys array<long>"


def sampled(texts: DataFrame, n: int, sample: int) -> DataFrame:
    """About ``sample`` of ``n`` documents, by the hash of the id."""
    return texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample / max(n, 1))) + 1)


def often_in(some: DataFrame, members: Callable[[bytes], np.ndarray], n: int, sample: int) -> np.ndarray:
    """Hashes that 1 in 500 documents of a bounded sample hold; at most 500 times a document's mean number of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in byte_rows(batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(members(text).view(np.int64))], ["h"])

    rows = some.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= max(3, min(n, sample) // 500)).select("h").toArrow()
    return np.sort(rows.column(0).to_numpy().astype(np.int64).view(np.uint64))


def within(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def sets(texts: DataFrame, k: int, sample: int = SAMPLE_DOCS) -> DataFrame:
    """Size, digest, sketch and slice keys of each document's set; keys that many documents emit stand apart."""
    n, context = texts.count(), texts.sparkSession.sparkContext
    some = sampled(texts, n, sample)
    common = often_in(some, Shingler(k), n, sample)
    shared = context.broadcast(common)

    def keys_of(text: bytes, shingler: Shingler = Shingler(k)) -> np.ndarray:
        members = shingler(text)
        return slice_keys(members, shared.value) if len(members) else members

    hot = context.broadcast(often_in(some, keys_of, n, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, often = Shingler(k), shared.value
        for batch in batches:
            for part in slices(batch, 1):
                n, digest, bits, keys, hot_keys = [], [], [], [], []
                for text in byte_rows(part.column(1)):
                    members = shingler(text)
                    n.append(len(members))
                    digest.append(xxhash.xxh3_128_digest(members.tobytes()) if len(members) else None)
                    bits.append(sketch(members) if len(members) else None)
                    mine = slice_keys(members, often) if len(members) else members
                    is_hot = within(hot.value, mine)
                    keys.append(mine[~is_hot].view(np.int64))
                    hot_keys.append(mine[is_hot].view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bits, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(hot_keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "sketch", "keys", "hot_keys"])

    return texts.mapInArrow(run, SET_ROWS)


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable by links, itself included).

    Two documents link when ``100 * |A & B| >= percent * |A | B|``. Null, empty and blank texts have an empty set and
    link with nothing; a text with fewer than ``k`` words is one shingle. Repeated rows link (their texts are equal); ids
    are expected to be unique, and rows of one id get one component. A row without an id has none and joins nothing.
    ``percent`` must be 80 or more: the slices are laid out for that.
    """
    if percent < 80:
        raise ValueError("slices are laid out for a similarity of 0.8 or more")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    every = save(sets(texts, k), "sets")
    same = every.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.min("sketch").alias("sketch"))
    reps = save(same.filter("rep is not null"), "distinct_sets")
    member = save(every.filter("digest is not null and doc_id is not null").select("doc_id", "digest").join(reps.select("digest", "rep"), "digest").select("doc_id", "rep").distinct(), "members")
    # a key that one document emits joins nothing: one shuffle tells; keys that many emit need no such test
    named = every.filter("doc_id is not null")
    cold = named.select("doc_id", F.explode("keys").alias("key")).withColumn("n", F.count("*").over(Window.partitionBy("key"))).filter("n > 1").select("doc_id", "key")
    entries = save(cold.union(named.select("doc_id", F.explode("hot_keys").alias("key"))), "entries")
    buckets = entries.join(member, "doc_id").select("key", "rep").distinct()
    buckets = save(_unlike(buckets), "buckets")
    groups = _link(texts, reps, buckets, k, percent)
    whole = member.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component_id", "rep").alias("component_id")).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = every.select("doc_id", "n_shingles").join(whole, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _unlike(buckets: DataFrame) -> DataFrame:
    """Buckets of several members, one for each set of members: similar documents share many buckets.

    A set of members is told by its size and two 64-bit hashes.
    """
    mark = [F.bit_xor(F.xxhash64(F.lit(k), "rep")).alias(f"h{k}") for k in (1, 2)]
    one = buckets.groupBy("key").agg(F.count("*").alias("m"), *mark).filter("m > 1").groupBy("m", "h1", "h2").agg(F.min("key").alias("key"))
    return buckets.join(one.select("key"), "key", "left_semi")


def _link(texts: DataFrame, reps: DataFrame, buckets: DataFrame, k: int, percent: int) -> DataFrame:
    """Components ``(node, component_id)`` of the sets that share buckets."""
    info = reps.select("rep", "n", "sketch")
    needed = buckets.select("rep").distinct()
    held = save(with_texts(texts, needed.withColumnRenamed("rep", "doc_id")).dropDuplicates(["doc_id"]), "candidate_texts")
    links = tested = groups = None
    left = buckets.withColumn("component_id", F.col("rep"))
    # stars first: they join large groups at linear cost; what still stands apart is then compared in blocks
    for width in (*STARS, None):
        pairs = _star_pairs(left, width) if width else _block_pairs(left, info, percent)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = save(pairs, "pairs")
        good = save(_verify(_sketch_filter(pairs, info, percent) if width else pairs, held, k, percent), "links")
        links = good if links is None else save(links.union(good), "links")
        tested = pairs if tested is None else save(tested.union(pairs), "tested")
        groups = save(components(links, "a", "b"), "groups")
        if width is None:
            return groups
        moved = left.drop("component_id").join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component_id", "rep").alias("component_id"))
        left = save(moved, "left")
        apart = left.groupBy("key").agg(F.min("component_id").alias("low"), F.max("component_id").alias("top")).filter("low < top").select("key")
        left = save(_unlike(left.join(apart, "key", "left_semi")), "left")
        if left.isEmpty():
            return groups
    return groups


def _star_pairs(left: DataFrame, width: int) -> DataFrame:
    """The ``width`` smallest members of each bucket against its other members, where they are not joined yet."""
    hubs = left.groupBy("key").agg(F.min(F.struct("rep", "component_id")).alias("hub"))
    if width > 1:
        numbered = left.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("rep")))
        hubs = numbered.filter(F.col("nth") <= width).select("key", F.struct("rep", "component_id").alias("hub"))
    star = left.join(hubs.select("key", F.col("hub.rep").alias("a"), F.col("hub.component_id").alias("ca")), "key")
    return star.filter("rep > a and component_id <> ca").select("a", F.col("rep").alias("b")).distinct()


def _block_pairs(left: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """Pairs within a bucket, of different components, whose sizes and sketches allow the similarity.

    A bucket of m members is cut into about m / BLOCK chunks, and a task compares two chunks bit by bit; it emits the
    pairs that pass, not all pairs.
    """
    chunks = F.ceil(F.col("m") / BLOCK).cast("int")
    sized = left.join(left.groupBy("key").agg(F.count("*").alias("m")), "key").withColumn("chunk", F.pmod(F.xxhash64("rep"), chunks).cast("int"))
    # chunk c meets chunk o in the cell (smaller, larger)
    cells = sized.withColumn("o", F.explode(F.sequence(F.lit(0), chunks - 1))).join(info, "rep")
    cells = cells.select("key", F.least("chunk", "o").alias("i"), F.greatest("chunk", "o").alias("j"), "chunk", "rep", "component_id", "n", "sketch")
    dealt = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "chunk", "rep")

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """Pairs of the groups (key, i, j) of a sorted table."""
        key, i, j, chunk, rep, comp, n = (t.column(k).to_numpy() for k in range(7))
        bits = np.frombuffer(b"".join(t.column(7).to_pylist()), np.uint64).reshape(len(key), -1)
        new = np.flatnonzero((np.diff(key, prepend=~key[:1]) != 0) | (np.diff(i, prepend=-1) != 0) | (np.diff(j, prepend=-1) != 0))
        out = []
        for a, b in zip(new, [*new[1:], len(key)], strict=True):
            same = i[a] == j[a]
            half = b if same else a + int(np.searchsorted(chunk[a:b], j[a]))
            for x in range(a, half):
                y = slice(x + 1, b) if same else slice(half, b)
                ok = np.flatnonzero((comp[y] != comp[x]) & (100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x]))) + y.start
                ok = ok[np.bitwise_count(bits[ok] ^ bits[x]).sum(1, dtype=np.int64) <= (n[x] + n[ok]) * (100 - percent) // (100 + percent)]
                if len(ok):
                    out.append((np.minimum(rep[x], rep[ok]), np.maximum(rep[x], rep[ok])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # the last group of a batch may go on in the next one
            t = [batch.column(k).to_numpy() for k in range(3)]
            start = int(np.flatnonzero((t[0] != t[0][-1]) | (t[1] != t[1][-1]) | (t[2] != t[2][-1]))[-1]) + 1 if ((t[0] != t[0][-1]) | (t[1] != t[1][-1]) | (t[2] != t[2][-1])).any() else 0
            if start:
                yield from compare(pa.Table.from_batches([*held, batch.slice(0, start)]))
                held = [batch.slice(start)]
            elif held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in range(3)):
                yield from compare(pa.Table.from_batches(held))
                held = [batch]
            else:
                held.append(batch)
        if held:
            yield from compare(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _sketch_filter(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes and sketches allow the similarity."""
    a = info.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    b = info.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    both = pairs.join(a, "a").join(b, "b").filter(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in (3, 5))
            apart = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
            room = (batch.column(2).to_numpy() + batch.column(4).to_numpy()) * (100 - percent) // (100 + percent)
            yield batch.filter(pa.array(apart <= room)).select([0, 1])

    return both.select("a", "b", "na", "sa", "nb", "sb").mapInArrow(run, "a long, b long")


def _verify(pairs: DataFrame, held: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose sets are similar enough, by exact intersection."""
    a = held.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    b = held.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, last, left = Shingler(k), None, None
        for batch in batches:
            keep = []
            ids = batch.column(0).to_pylist()
            for i in range(batch.num_rows):
                if ids[i] != last:
                    last, left = ids[i], shingler((batch.column(2)[i].as_py() or "").encode())
                right = shingler((batch.column(3)[i].as_py() or "").encode())
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * both >= percent * (len(left) + len(right) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return pairs.join(b, "b").join(a, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")
