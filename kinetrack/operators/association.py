"""Spatial association of two trackers' boxes (J7) and tracking quality."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import FPS

HALF = 8.0


#: Pairs of neighbours that a task measures at a time.
PAIRS_HELD = 1 << 16


def _nine(v: np.ndarray) -> np.ndarray:
    """Non-negative numbers rounded to 9 decimals as Spark's ``round`` does: halves of the shortest decimal form go up."""
    scaled = v * 1e9
    low = np.floor(scaled)
    part = scaled - low
    out = (low + (part >= 0.5)) / 1e9
    for k in (np.abs(part - 0.5) < 1e-5).nonzero()[0].tolist():
        out[k] = float(Decimal(repr(float(v[k]))).quantize(Decimal("1e-9"), ROUND_HALF_UP))
    return out


def _whole(batches: Iterator[pa.RecordBatch], key: Sequence[str]) -> Iterator[pa.Table]:
    """Sorted batches as tables that hold all rows of each of their groups; at most one group waits for its next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.num_rows - 1
        same = np.ones(batch.num_rows, bool)
        for c in key:
            same &= np.asarray(pa.compute.equal(batch.column(c), batch.column(c)[last]))
        start = int(np.argmax(same))  # the last group may go on
        ends = bool(held) and (start or any(held[0].column(c)[0] != batch.column(c)[0] for c in key))
        if start:
            yield pa.Table.from_batches([*held, batch.slice(0, start)])
            held = []
        elif ends:
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    code = column.combine_chunks().dictionary_encode()
    return (code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy()


def candidates(truth: DataFrame, predicted: DataFrame, min_iou: float = 0.5, cell: float = 64.0, half: float = HALF) -> DataFrame:
    """Pairs of boxes of one frame with enough overlap, IoU rounded to 9 decimals. Boxes meet by grid cell, so a crowded frame is no cross product.

    A truth box lies in its centre's cell; a prediction enters the cells that it can match from, so a pair is met once. A
    task holds one cell's boxes, ordered by x, and hands on each truth box with a list of its matches: what is shuffled
    grows with the boxes, and pairs are rows only where they are read. Boxes without a finite centre match nothing.
    """
    t = max(0.0, min_iou)
    reach = 2 * half * (1 - t) / (1 + t) + 1e-6  # centres of equal boxes with this IoU are no farther apart
    pitch = cell + 4 * reach
    full = 8 * half * half  # two boxes' area, a constant as in SQL: differences of a box's edges are off by their last bits
    key = ["video", "frame", "gx", "gy"]

    def gridded(df: DataFrame, side: int) -> DataFrame:
        rows = df.select("video", "frame", F.col("track_id").alias("id"), F.col("cx").cast("double").alias("x"), F.col("cy").cast("double").alias("y"), F.lit(side == 1).alias("side"))
        known = rows.filter((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")) & F.col("video").isNotNull() & F.col("frame").isNotNull())
        span = lambda c: F.explode(F.sequence(*[F.floor((F.col(c) + side * r) / cell) for r in (-reach, reach)]))
        return known.withColumn("gx", span("x")).withColumn("gy", span("y"))

    # few bytes become many pairs: a fixed number of tasks, which Spark does not merge by the bytes they read
    tasks = int(truth.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = gridded(truth, 0).unionByName(gridded(predicted, 1)).repartition(tasks, *key).sortWithinPartitions(*key)

    def met(table: pa.Table) -> Iterator[pa.RecordBatch]:
        frame, gx, gy, x, y, side = (table.column(c).to_numpy() for c in ("frame", "gx", "gy", "x", "y", "side"))
        codes = (_codes(table.column("video")), frame, gx, gy)
        new = np.any([c[1:] != c[:-1] for c in codes], axis=0)
        place = np.concatenate([[0], np.cumsum(new)]) * pitch + (x - gx * cell)  # groups lie side by side, out of reach
        gt, pred = (~side).nonzero()[0], side.nonzero()[0]
        pred = pred[np.argsort(place[pred], kind="stable")]
        at = place[pred]
        low = np.searchsorted(at, place[gt] - reach)
        n = np.searchsorted(at, place[gt] + reach, "right") - low
        ends = np.cumsum(n)
        edges = np.stack([x - half, y - half, x + half, y + half])
        of_gt, of_pred = edges[:, gt], edges[:, pred]
        y_gt, y_pred = y[gt], y[pred]
        columns = [table.column(c).combine_chunks() for c in ("video", "frame", "id")]
        columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
        for start in range(0, int(ends[-1]) if len(ends) else 0, PAIRS_HELD):
            stop = min(start + PAIRS_HELD, int(ends[-1]))
            a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop)) + 1
            first = ends[a:b] - n[a:b]
            k = np.repeat(np.arange(a, b), np.minimum(ends[a:b], stop) - np.maximum(first, start))
            q = np.arange(start, stop) + (low[a:b] - first)[k - a]
            near = np.abs(y_gt[k] - y_pred[q]) <= reach
            k, q = k[near], q[near]
            one, two = of_gt[:, k], of_pred[:, q]
            sides = np.maximum(np.minimum(one[2:], two[2:]) - np.maximum(one[:2], two[:2]), 0.0)
            shared = sides[0] * sides[1]
            union = full - shared
            iou_ = _nine(np.divide(shared, union, out=np.zeros_like(shared), where=union > 0))
            keep = iou_ >= min_iou
            k, q, iou_ = k[keep], q[keep], iou_[keep]
            if not len(k):
                continue
            heads = np.concatenate([[True], k[1:] != k[:-1]]).nonzero()[0]
            who = pa.array(gt[k[heads]])
            pairs = pa.StructArray.from_arrays([columns[2].take(pa.array(pred[q])), pa.array(iou_)], ["pred", "iou"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(k)).astype(np.int32)), pairs)
            yield pa.RecordBatch.from_arrays([*[c.take(who) for c in columns], lists], ["video", "frame", "gt", "pairs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches, key):
            yield from met(table)

    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema}
    told = dealt.mapInArrow(run, f"video {kinds['video']}, frame {kinds['frame']}, gt {kinds['id']}, pairs array<struct<pred: {kinds['id']}, iou: double>>")
    return told.select("video", "frame", "gt", F.inline("pairs"))


def greedy_matches(pairs: DataFrame) -> DataFrame:
    """Each truth box, in id order, takes its best unused prediction (ties: the smaller id).

    Frames are dealt to tasks and sorted; a task walks over its candidates once and remembers one frame's taken boxes.
    """
    dealt = pairs.select("video", F.col("frame").cast("long"), F.col("gt").cast("long"), F.col("pred").cast("long"), "iou").repartition("video", "frame")
    ordered = dealt.sortWithinPartitions("video", "frame", "gt", F.desc("iou"), "pred")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, taken, last = None, set(), None
        for batch in batches:
            keep = []
            for video, frame, gt, pred in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if (video, frame) != at:
                    at, taken, last = (video, frame), set(), None
                free = gt != last and pred not in taken
                if free:
                    taken.add(pred)
                    last = gt
                keep.append(free)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return ordered.mapInArrow(walk, ordered.schema)


#: Places of a frame's predictions that are looked at together.
BLOCK = 128


def _best_free(truth: tuple[np.ndarray, np.ndarray, np.ndarray], predicted: tuple[np.ndarray, np.ndarray, np.ndarray], half: float, min_iou: float) -> list[tuple[int, int, float]]:
    """(truth id, prediction's id, overlap) of one frame's greedy matches, from ids and centres of its boxes.

    Predictions at one place are a queue of ids. Places lie in blocks of neighbours; a truth box visits blocks by the
    largest overlap that their bounds allow and stops where no block can do better, so no pair is listed.
    """
    ids, x, y = predicted
    strip = np.argsort(np.argsort(x, kind="stable"), kind="stable") // max(1, int(np.sqrt(len(x) * BLOCK)))
    order = np.lexsort((ids, x, y, strip))
    ids, x, y = ids[order], x[order], y[order]
    new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    first, names = np.flatnonzero(new), ids.tolist()
    head, end = first.tolist(), [*first[1:].tolist(), len(x)]
    others: dict[int, list[int]] = {}  # places of ids that stand more than once
    if len(np.unique(ids)) < len(ids):
        for name, p in zip(names, (np.cumsum(new) - 1).tolist(), strict=True):
            others.setdefault(name, []).append(p)
    edges = lambda x, y: np.stack([-(x - half), x + half, -(y - half), y + half])
    # edges of places, low ones negated: an overlap's sides are sums of two minima
    flat = np.full((4, -(-len(first) // BLOCK) * BLOCK), -np.inf)
    flat[:, : len(first)] = edges(x[first], y[first])
    blocks = np.ascontiguousarray(flat.reshape(4, -1, BLOCK).transpose(1, 0, 2))
    bounds = np.ascontiguousarray(blocks.max(2).T)
    full = 8 * half * half  # two boxes' area, as in candidates
    slack = 2e-9 * full  # overlaps nearer than this may round to the same IoU

    def overlaps(of: np.ndarray, box: np.ndarray) -> np.ndarray:
        m = np.minimum(of, box)
        m = np.maximum(m[::2] + m[1::2], 0.0)
        return m[0] * m[1]

    order = np.lexsort((truth[2], truth[1], truth[0]))
    tid, boxes = truth[0][order].tolist(), np.ascontiguousarray(edges(truth[1][order], truth[2][order]).T)[:, :, None]
    taken: set[int] = set()
    out: list[tuple[int, int, float]] = []
    least = max(0.0, min_iou - 1e-8)
    least = least / (1 + least) * full
    best, reach = (0.0, 0, -1), least  # IoU, minus the id, place; the overlap to reach
    for i, now in enumerate(tid):
        box = boxes[i]
        can = overlaps(bounds, box)
        while True:
            b = int(can.argmax())
            if not can[b] > 0 or can[b] < reach - slack:
                break
            can[b] = -1.0
            met = overlaps(blocks[b], box)
            top = float(met[met.argmax()])
            if top <= 0 or top < reach - slack:
                continue
            for k in (met >= max(top - slack, 5e-324)).nonzero()[0].tolist():
                q, wh = b * BLOCK + k, float(met[k])
                best = max(best, (round(wh / (full - wh) * 1e9) / 1e9, -names[head[q]], q))
            reach = max(reach, top)
        if i + 1 < len(tid) and tid[i + 1] == now:
            continue  # another box of this id
        if best[2] >= 0 and best[0] >= min_iou:
            pred = -best[1]
            taken.add(pred)
            out.append((now, pred, best[0]))
            for p in others.get(pred, [best[2]]):
                while head[p] < end[p] and names[head[p]] in taken:
                    head[p] += 1
                if head[p] == end[p]:
                    b, k = divmod(p, BLOCK)
                    blocks[b, :, k] = -np.inf
                    bounds[:, b] = blocks[b].max(1)
        best, reach = (0.0, 0, -1), least
    return out


def greedy(truth: DataFrame, predicted: DataFrame, min_iou: float = 0.5, half: float = HALF) -> DataFrame:
    """``greedy_matches`` of ``candidates``, without the table of candidates, which grows with the square of a frame's boxes.

    Boxes of a frame meet in one task, ordered; a task holds one frame at a time. Boxes without an id or a finite centre
    match nothing.
    """
    box = lambda df, side: df.select("video", F.col("frame").cast("long").alias("frame"), F.col("track_id").cast("long").alias("id"), F.col("cx").cast("double").alias("x"), F.col("cy").cast("double").alias("y"), F.lit(side).alias("side"))
    finite = F.col("id").isNotNull() & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf")) & F.col("video").isNotNull() & F.col("frame").isNotNull()
    dealt = box(truth, 0).union(box(predicted, 1)).filter(finite).repartition("video", "frame").sortWithinPartitions("video", "frame")

    def matched(frames: pa.Table) -> Iterator[pa.RecordBatch]:
        video = frames.column("video").combine_chunks()
        frame, id_, x, y, side = (frames.column(c).to_numpy() for c in ("frame", "id", "x", "y", "side"))
        code = _codes(frames.column("video"))
        cuts = [0, *(np.flatnonzero((frame[1:] != frame[:-1]) | (code[1:] != code[:-1])) + 1).tolist(), len(frame)]
        rows: list[tuple[int, int, int, float]] = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            is_truth = side[a:b] == 0
            if is_truth.any() and not is_truth.all():
                sides = [tuple(c[a:b][k] for c in (id_, x, y)) for k in (is_truth, ~is_truth)]
                rows += [(a, *m) for m in _best_free(*sides, half, min_iou)]
        if rows:
            at, gt, pred, iou_ = zip(*rows, strict=True)
            at = pa.array(at)
            yield pa.RecordBatch.from_arrays([video.take(at), pa.array(frame).take(at), pa.array(gt, pa.int64()), pa.array(pred, pa.int64()), pa.array(iou_, pa.float64())], ["video", "frame", "gt", "pred", "iou"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches, ["video", "frame"]):
            yield from matched(table)

    return dealt.mapInArrow(walk, "video string, frame long, gt long, pred long, iou double")


def tracking_quality(truth: DataFrame, predicted: DataFrame, fps: float = FPS, fragment_s: float = 0.5) -> DataFrame:
    """Per video, share of truth tracks matched in half of their frames, identity switches per track, short predicted tracks.

    A truth track's frames count where the predictions have the frame too; tracks without such a frame are not covered.
    """
    m = greedy(truth, predicted)
    w = Window.partitionBy("video", "gt").orderBy("frame")
    sw = m.withColumn("sw", F.coalesce((F.col("pred") != F.lag("pred").over(w)).cast("int"), F.lit(0))).groupBy("video", "gt").agg(F.count("*").alias("hit"), F.sum("sw").alias("sw"))
    shared = predicted.select("video", "frame").distinct().withColumn("_both", F.lit(1))
    size = truth.join(shared, ["video", "frame"], "left").groupBy("video", F.col("track_id").alias("gt")).agg(F.sum(F.coalesce("_both", F.lit(0))).alias("n"))
    covered = (F.coalesce("hit", F.lit(0)) >= 0.5 * F.col("n")) & (F.col("n") > 0)
    per = size.join(sw, ["video", "gt"], "left").groupBy("video").agg(F.count("*").alias("n_gt"), F.avg(covered.cast("double")).alias("coverage"), (F.sum(F.coalesce("sw", F.lit(0))) / F.count("*")).alias("id_switches"))
    frag = predicted.groupBy("video", "track_id").agg(F.count("*").alias("n")).groupBy("video").agg(F.avg((F.col("n") < fragment_s * fps).cast("double")).alias("fragmentation"))
    return per.join(frag, "video", "left")
