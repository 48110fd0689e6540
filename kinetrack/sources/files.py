"""File sources and sinks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRACKS = "track_id long, frame int, cx double, cy double, x1 double, y1 double, x2 double, y2 double, conf double"
TRACK_FILE = r"^(\w+?)(?:_(botsort_reid|botsort|bytetrack|ocsort))?_tracks\.csv$"
REQUIRED = ("track_id", "frame", "cx", "cy")


def name_parts(file_name: Column) -> tuple[Column, Column]:
    """Video and tracker of a track file's name; files without a suffix are ``plain``."""
    tracker = F.regexp_extract(file_name, TRACK_FILE, 2)
    return F.regexp_extract(file_name, TRACK_FILE, 1), F.when(tracker == "", "plain").otherwise(tracker)


def read_tracks(spark: SparkSession, path: str, plain_only: bool = False) -> DataFrame:
    """All per-video track files of a folder, with video and tracker columns."""
    raw = spark.read.schema(TRACKS).option("header", True).option("pathGlobFilter", "*_tracks.csv").csv(path)
    video, tracker = name_parts(F.col("_metadata.file_name"))
    out = raw.select(video.alias("video"), tracker.alias("tracker"), *raw.columns)
    return out.filter("tracker = 'plain'") if plain_only else out


def prefer_source(sources: Sequence[tuple[str, DataFrame]], key: str = "video") -> DataFrame:
    """Of several cohorts' rows, each participant's from the first source that has it."""
    tagged = [df.withColumns({"source": F.lit(name), "_p": F.lit(k)}) for k, (name, df) in enumerate(sources)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    best = out.groupBy(key).agg(F.min("_p").alias("_p"))
    return out.join(best, [key, "_p"], "left_semi").drop("_p")


def parse_annotations(lines: DataFrame, width: float = 640, height: float = 480) -> DataFrame:
    """``fid cls cx cy w h`` lines (video, frame, line, pos) to tracks; ids are dense, by first appearance in a video."""
    f = F.split(F.trim("line"), r"\s+")
    rows = lines.withColumn("f", f).filter(F.size("f") >= 6)
    num = lambda i: F.expr(f"try_cast(f[{i}] as double)")
    rows = rows.select("video", "frame", "pos", F.col("f")[0].alias("fid"), *[num(i).alias(n) for i, n in ((2, "nx"), (3, "ny"), (4, "w"), (5, "h"))])
    first = rows.groupBy("video", "fid").agg(F.min(F.struct("frame", "pos")).alias("at"))
    ids = first.withColumn("track_id", F.row_number().over(Window.partitionBy("video").orderBy("at")).cast("long")).drop("at")
    at = rows.join(ids, ["video", "fid"]).withColumns({"cx": F.col("nx") * width, "cy": F.col("ny") * height, "bw": F.col("w") * width, "bh": F.col("h") * height})
    return at.select("video", "track_id", "frame", "cx", "cy", (F.col("cx") - F.col("bw") / 2).alias("x1"), (F.col("cy") - F.col("bh") / 2).alias("y1"), (F.col("cx") + F.col("bw") / 2).alias("x2"), (F.col("cy") + F.col("bh") / 2).alias("y2"), F.lit(1.0).alias("conf"))


def read_annotation_texts(spark: SparkSession, path: str) -> DataFrame:
    """Annotation files ``<video>_frame_<n>_with_ftid.txt`` as (video, frame, pos, line)."""
    raw = spark.read.text(path, wholetext=True).withColumn("name", F.col("_metadata.file_name"))
    pattern = r"^(.+)_frame_(\d+)_with_ftid\.txt$"
    return raw.select(F.regexp_extract("name", pattern, 1).alias("video"), F.regexp_extract("name", pattern, 2).cast("int").alias("frame"), F.posexplode(F.split("value", "\n")).alias("pos", "line")).filter("video <> ''")


BOX = "struct<frame:int,x:double,y:double,w:double,h:double,bbox_x:double,bbox_y:double,bbox_w:double,bbox_h:double,width:double,height:double>"


def parse_json_annotations(docs: DataFrame, column: str = "value") -> DataFrame:
    """A list of boxes, or an object with ``frames`` of ``bboxes`` or ``objects``, with fallback keys, to flat boxes."""
    flat = F.from_json(column, f"array<{BOX}>")
    nested = F.from_json(column, f"struct<frames:array<struct<frame:int,frame_id:int,bboxes:array<{BOX}>,objects:array<{BOX}>>>>")
    is_list = F.ltrim(F.col(column)).startswith("[")
    keep = [c for c in docs.columns if c != column]
    a = docs.filter(is_list).select(*keep, F.explode(flat).alias("b")).select(*keep, F.col("b.frame").alias("frame"), "b")
    n = docs.filter(~is_list).select(*keep, F.explode(nested["frames"]).alias("f"))
    b = n.select(*keep, F.coalesce("f.frame", "f.frame_id").alias("frame"), F.explode(F.coalesce("f.bboxes", "f.objects")).alias("b"))
    pick = lambda *c: F.coalesce(*[F.col(f"b.{x}") for x in c], F.lit(0.0))
    return a.union(b).select(*keep, "frame", pick("x", "bbox_x").alias("x"), pick("y", "bbox_y").alias("y"), pick("w", "width", "bbox_w").alias("w"), pick("h", "height", "bbox_h").alias("h"))


ALIASES = {"frame": ("frame", "frame_id", "frame_idx"), "x": ("x", "bbox_x", "left"), "y": ("y", "bbox_y", "top"), "w": ("w", "width", "bbox_w"), "h": ("h", "height", "bbox_h")}


def by_alias(df: DataFrame, aliases: dict[str, Sequence[str]] = ALIASES) -> DataFrame:
    """Columns under their first alias that the table has; missing ones are 0."""
    lower = {c.lower().strip(): c for c in df.columns}
    found = {to: next((lower[n] for n in names if n in lower), None) for to, names in aliases.items()}
    return df.select(*[(F.col(f"`{c}`").cast("double") if c else F.lit(0.0)).alias(to) for to, c in found.items()])


def explode_detections(frames: DataFrame) -> DataFrame:
    """(video, frame, boxes array<array<double>>) to one row per box; frames without boxes stay, with nulls."""
    names = ("x1", "y1", "x2", "y2", "conf", "cls")
    out = frames.select("video", "frame", F.explode_outer("boxes").alias("b")).select("video", "frame", *[F.get("b", F.lit(i)).alias(n) for i, n in enumerate(names)])
    return out.withColumn("cls", F.col("cls").cast("int"))


def nest_detections(boxes: DataFrame) -> DataFrame:
    """The inverse of ``explode_detections``."""
    b = F.array(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2", "conf", "cls")])
    return boxes.groupBy("video", "frame").agg(F.sort_array(F.collect_list(F.when(F.col("x1").isNotNull(), b))).alias("boxes"))


def trimmed(df: DataFrame, renames: dict[str, str] | None = None, key: str | None = None) -> DataFrame:
    """Trimmed headers, renames, key as text."""
    out = df.toDF(*[c.strip() for c in df.columns])
    out = out.withColumnsRenamed(renames or {})
    return out.withColumn(key, F.col(key).cast("string")) if key else out


def decimal_comma(c: Column) -> Column:
    """A number with a decimal comma; null if it is none."""
    return F.regexp_replace(F.trim(c.cast("string")), ",", ".").try_cast("double")


def read_decimal_comma(spark: SparkSession, path: str, key: str) -> DataFrame:
    raw = spark.read.option("sep", ";").option("header", True).csv(path)
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    return raw.select(F.trim(key).alias(key), *[decimal_comma(F.col(f"`{c}`")).alias(c) for c in raw.columns if c != key])


def pick_column(df: DataFrame, needle: str) -> str:
    """The first column whose name holds ``needle``, ignoring case."""
    for c in df.columns:
        if needle.lower() in c.lower():
            return c
    raise KeyError(needle)


def preferred_percentages(summaries: DataFrame, use_adjusted: bool = True) -> DataFrame:
    """Adjusted percentages, else raw ones, else 0."""
    classes = ("progressive", "non_progressive", "immotile")
    have = set(summaries.columns)
    pick = lambda c: F.coalesce(*[F.col(n) for n in ([f"adjusted_{c}_pct"] if use_adjusted else []) + [f"{c}_pct"] if n in have], F.lit(0.0))
    rest = [c for c in ("experiment",) if c in have]
    return summaries.select("video", *rest, *[pick(c).alias(f"{c}_pct") for c in classes])


def experiments(summaries: DataFrame) -> DataFrame:
    """Experiments that hold a summary."""
    return summaries.select("experiment").distinct()


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir``; only a local session may leave it unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="kinetrack-")
    return f"{root.rstrip('/')}/tables-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to a new table in the shared folder and read back: what several later steps read is computed once, and a lost executor costs the reading of a file."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_table(df: DataFrame, path: str, form: str = "parquet", by: Sequence[str] = ()) -> None:
    """A table as Parquet, JSON or CSV, partitioned by columns; only the partitions at hand are replaced."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True)
    (w.partitionBy(*by) if by else w).format(form).save(path)


def write_named(df: DataFrame, path: str, name: Column, columns: Sequence[str | Column], order: Sequence[str] = (), form: str = "csv") -> None:
    """One file of each ``name`` in the folder ``path``: ``columns`` of its rows in ``order``; a file of that name is replaced, others stay.

    Spark's own committer writes an attempt folder beside the target (which readers skip), one task a name; only when
    all of it is there are the files renamed, by the folder's Hadoop file system, so a lost task or job leaves no part
    of a file. The driver handles names, never rows. Rows whose name is null are refused.
    """
    spark = df.sparkSession
    attempt = f"{path.rstrip('/')}/_attempt-{uuid.uuid4().hex}"
    named = df.select(F.when(name.isNull(), F.raise_error(F.lit("a row without a file name"))).otherwise(name).alias("_name"), *columns)
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(attempt)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        named.repartition("_name").sortWithinPartitions("_name", *order).write.partitionBy("_name").option("header", True).format(form).save(attempt)
        for folder in fs.listStatus(at):
            if folder.isDirectory():
                parts = [f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-")]
                if len(parts) != 1:
                    raise RuntimeError(f"{folder.getPath().getName()}: {len(parts)} parts")
                to = jvm.org.apache.hadoop.fs.Path(path, unquote(folder.getPath().getName().removeprefix("_name=")))
                fs.delete(to, False)
                if not fs.rename(parts[0], to):
                    raise RuntimeError(f"{to} could not be written")
    finally:
        fs.delete(at, True)


def track_file(video: Column, tracker: Column) -> Column:
    """Name of a track file; ``plain`` ones have no suffix."""
    return F.concat(video, F.when(tracker == "plain", "").otherwise(F.concat(F.lit("_"), tracker)), F.lit("_tracks.csv"))


def write_tracks(tracks: DataFrame, path: str) -> None:
    """(video, tracker, track columns) as one file of each video and tracker."""
    fields = [f.split()[0] for f in TRACKS.split(", ")]
    have = [F.col(c) if c in tracks.columns else F.lit(None).cast("double").alias(c) for c in fields]
    write_named(tracks, path, track_file(F.col("video"), F.col("tracker")), have, ["track_id", "frame"])


MOTILITY = "track_id long, n_frames long, duration_s double, VCL double, VSL double, VAP double, LIN double, STR double, WOB double, ALH double, BCF double, motility string"


def write_motility(metrics: DataFrame, path: str) -> None:
    """The metrics of each video's tracks as ``<video>_motility.csv``."""
    fields = [f.split()[0] for f in MOTILITY.split(", ")]
    write_named(metrics, path, F.concat("video", F.lit("_motility.csv")), fields, ["track_id"])


def read_motility(spark: SparkSession, path: str, schema: str = MOTILITY) -> DataFrame:
    """The ``<video>_motility.csv`` files of a folder as one table, tagged with their video.

    Columns are found by the header; those of ``schema`` get its types without a pass over the files, others stay text.
    """
    raw = spark.read.option("header", True).option("pathGlobFilter", "*_motility.csv").csv(path)
    kinds = dict(f.split() for f in schema.split(", "))
    told = [F.col(f"`{c}`").try_cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in raw.columns]
    return raw.select(*told, F.regexp_replace(F.col("_metadata.file_name"), r"_motility\.csv$", "").alias("video"))


def work_list(experiments: DataFrame, videos: DataFrame, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(experiment, video) for all known experiments and videos, or the wanted ones of them; and the wanted names that are unknown.

    ``wanted`` has (kind, name), kind being ``experiment`` or ``video``; a kind without a wanted name is taken whole.
    The two lists are small names tables; their product is the work to do.
    """
    known = {"experiment": experiments.select("experiment").distinct(), "video": videos.select("video").distinct()}
    if wanted is None:
        none = experiments.sparkSession.createDataFrame([], "kind string, name string")
        return known["experiment"].crossJoin(known["video"]), none
    sides, unknown = [], None
    for kind, table in known.items():
        asked = wanted.filter(F.col("kind") == kind).select(F.col("name").alias(kind)).distinct()
        any_ = asked.limit(1).select(F.lit(True).alias("_any"))
        marked = table.join(asked.withColumn("_asked", F.lit(True)), kind, "left").join(any_, how="left")
        sides.append(marked.filter("_asked or _any is null").select(kind))
        odd = asked.join(table, kind, "left_anti").select(F.lit(kind).alias("kind"), F.col(kind).alias("name"))
        unknown = odd if unknown is None else unknown.union(odd)
    return sides[0].crossJoin(sides[1]), unknown


def pending(work: DataFrame, done: DataFrame, keys: Sequence[str] = ("experiment", "video")) -> DataFrame:
    """Work that has no output yet."""
    return work.join(done, list(keys), "left_anti")


def label_lines(boxes: DataFrame, width: float, height: float, cls: int = 0) -> DataFrame:
    """``cls cx cy w h`` lines, normalised, clamped and rounded to 6 decimals (halves up), per frame."""
    from ..functions.scalar import normalise

    parts = normalise(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], width, height)
    line = F.format_string("%d %.6f %.6f %.6f %.6f", F.lit(cls), *[F.floor(x * 1e6 + 0.500001) / 1e6 for x in parts])
    return boxes.groupBy("video", "frame").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("labels"))


def validated(df: DataFrame, required: Sequence[str] = REQUIRED) -> DataFrame:
    """Counts of rows, tracks and frames; raises if a required column is missing."""
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct(*[c for c in ("video", "track_id") if c in df.columns]).alias("n_tracks"), F.count_distinct("frame").alias("n_frames"))


def label_census(boxes: DataFrame, splits: dict[str, str]) -> DataFrame:
    """Boxes of each class and split with their share of the split; videos without a split are ``train``."""
    table = F.create_map(*[F.lit(x) for kv in splits.items() for x in kv]) if splits else None
    split = F.coalesce(table[F.col("video")], F.lit("train")) if splits else F.lit("train")
    c = boxes.groupBy(split.alias("split"), "cls").agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("split")))


def frame_split(frames: DataFrame, fraction: float = 0.2, seed: int = 0) -> DataFrame:
    """``val`` for a seeded fifth of each video's frames (at least one), else ``train``."""
    d = frames.select("video", "frame").distinct()
    w = Window.partitionBy("video")
    order = F.md5(F.concat_ws("|", "video", F.col("frame").cast("string"), F.lit(str(seed))))
    return d.withColumn("split", F.when(F.row_number().over(w.orderBy(order, "frame")) <= F.greatest(F.lit(1), F.floor(F.count("*").over(w) * fraction)), "val").otherwise("train"))
