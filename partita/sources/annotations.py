"""Annotation files: text lists, labelled intervals, nested annotation sets, split files, WAV; and their sinks."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partita.functions.paths import file_base, file_name
from partita.operators.ranking import number_rows
from partita.operators.sequences import compress_intervals
from partita.session import broadcast_small, cut_lineage

INTERVALS = "path string, position bigint, start double, end double, label string"


def read_textlist(spark: SparkSession, path: str) -> DataFrame:
    """(value) of each line; only the line end is cut, blank lines stay."""
    return spark.read.text(path)


def write_textlist(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def collect_files(spark: SparkSession, directory: str, pattern: str, min_depth: int = 0, max_depth: int | None = None) -> DataFrame:
    """(path, size, depth) of the files below a directory that match a glob, sorted; depth counts the directories between.

    Contents are not read: only path and length of the binary-file source are selected.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(directory).select(F.col("path"), F.col("length").alias("size"))
    root = F.lit(directory.split(":", 1)[-1].rstrip("/"))
    rest = F.regexp_replace(F.col("path"), "^[a-z]+:/*", "/")
    depth = F.size(F.split(F.substr(rest, F.length(root) + 2), "/")) - 1
    out = files.withColumn("depth", depth).where(F.col("depth") >= min_depth)
    return (out if max_depth is None else out.where(F.col("depth") <= max_depth)).orderBy("path")


def _whitespace(spark: SparkSession, path: str) -> DataFrame:
    line = F.posexplode(F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n")).alias("position", "line")
    rows = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "utf-8").alias("text")).select("path", line)
    part = lambda i: F.regexp_extract(F.trim("line"), r"^(\S+)\s+(\S+)\s+(.*)$", i)
    return rows.where(F.trim("line") != "").select("path", F.col("position").cast("bigint").alias("position"), part(1).try_cast("double").alias("start"), part(2).try_cast("double").alias("end"), part(3).alias("label"))


def _json(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.format("binaryFile").load(path).select("path", F.from_json(F.decode("content", "utf-8"), "intervals array<array<double>>, labels array<string>").alias("j"))
    each = rows.select("path", F.posexplode(F.arrays_zip(F.col("j.intervals").alias("iv"), F.col("j.labels").alias("label"))).alias("position", "z"))
    return each.select("path", F.col("position").cast("bigint").alias("position"), F.col("z")["iv"][0].alias("start"), F.col("z")["iv"][1].alias("end"), F.col("z")["label"].alias("label"))


#: Reader of each extension; a new format is one entry.
LOADERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"lab": _whitespace, "txt": _whitespace, "json": _json}


def read_intervals(spark: SparkSession, path: str, compress: bool = False) -> DataFrame:
    """(path, position, start, end, label) of lab, txt or json files; an unknown extension raises. Runs of a label can be joined."""
    ext = path.rsplit(".", 1)[-1].lower()
    if ext not in LOADERS:
        raise ValueError(f"no interval reader for .{ext}")
    rows = LOADERS[ext](spark, path)
    return compress_intervals(rows, "path", ["position"], "label", "start", "end") if compress else rows


def annotations_to_json(df: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """(key, json): one JSON array of records per key, sorted by the fields in turn."""
    packed = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("data"))
    return packed.select(key, F.to_json(F.struct("data")).alias("json"))


def annotations_from_json(df: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """The inverse, one row per record, with the number of the key's records. Text that is no JSON gives no rows."""
    struct = ", ".join(f"{n}: {t}" for n, t in fields.items())
    parsed = df.select(key, F.from_json("json", f"data array<struct<{struct}>>").alias("j"))
    return parsed.select(key, F.size("j.data").cast("bigint").alias("n_items"), F.explode("j.data").alias("r")).select(key, "n_items", "r.*")


SET_SCHEMA = "map<string, struct<chord: array<struct<data: array<struct<start: double, end: double, label: string, confidence: double>>, sandbox: map<string,string>, annotation_metadata: map<string,string>>>, sandbox: map<string,string>>>"


NOTE_FIELDS = ["key", "annotation", "metadata", "sandbox", "start", "end", "label", "confidence"]


def read_annotation_set(spark: SparkSession, path: str) -> DataFrame:
    """(key, annotation, metadata, sandbox, start, end, label, confidence) of JSON objects of tracks, one object a file or a line.

    One row per interval. An annotation without intervals has one row with null bounds, so that writing gives it back.
    """
    files = spark.read.format("binaryFile").load(path).where("length > 0").select(F.decode("content", "utf-8").alias("text"))
    whole = F.from_json("text", SET_SCHEMA)
    # a sink writes one object a line, other tools one object a file
    lines = F.transform(F.split("text", "\n"), lambda x: F.from_json(x, SET_SCHEMA))
    each = files.select(F.when(whole.isNotNull() & (F.size(F.map_keys(whole)) > 0) & ~F.trim(F.col("text")).rlike(r"\}\s*\n\s*\{"), F.array(whole)).otherwise(lines).alias("sets"))
    tracks = each.select(F.explode("sets").alias("set")).where("set is not null").select(F.explode("set").alias("key", "track"))
    notes = tracks.select("key", F.posexplode("track.chord").alias("annotation", "a"))
    data = notes.select("key", "annotation", F.col("a.annotation_metadata").alias("metadata"), F.col("a.sandbox").alias("sandbox"), F.explode_outer("a.data").alias("r"))
    return data.select("key", "annotation", "metadata", "sandbox", "r.*")


def annotation_lines(rows: DataFrame) -> DataFrame:
    """(key, value): one JSON object {key: track} per key, with all annotations of the key in order.

    ``rows`` are those of read_annotation_set(); the metadata and sandbox of an annotation are those of any of its
    rows that has them, {} if none has. Rows with null bounds hold no interval.
    """
    none = F.create_map().cast("map<string,string>")
    item = F.when(F.col("start").isNotNull() | F.col("end").isNotNull(), F.struct("start", "end", "label", "confidence"))
    notes = rows.groupBy("key", "annotation").agg(F.array_sort(F.collect_list(item)).alias("data"), F.first("sandbox", ignorenulls=True).alias("sandbox"), F.first("metadata", ignorenulls=True).alias("metadata"))
    note = F.struct(F.col("annotation"), F.struct("data", F.coalesce("sandbox", none).alias("sandbox"), F.coalesce("metadata", none).alias("annotation_metadata")).alias("note"))
    track = notes.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("annotation", F.to_json(note["note"]).alias("note")))), lambda x: x["note"]).alias("notes"))
    text = F.concat(F.lit("{"), F.to_json(F.array("key")).substr(F.lit(2), F.length(F.to_json(F.array("key"))) - 2), F.lit(':{"chord":['), F.array_join("notes", ","), F.lit('],"sandbox":{}}}'))
    return track.select("key", text.alias("value"))


def write_annotation_set(rows: DataFrame, path: str) -> None:
    """annotation_lines() as a text sink; read_annotation_set() reads it back."""
    annotation_lines(rows).select("value").write.mode("overwrite").text(path)


def intervals_to_annotations(rows: DataFrame, metadata: DataFrame | None, timestamp: str, key: Callable[[Column], Column] = lambda base: base) -> DataFrame:
    """Interval rows of read_intervals() as annotation rows: the key comes from the file's name, the sandbox names file and time.

    ``metadata(key, metadata)`` joins left; a key without has {}.
    """
    none = F.create_map().cast("map<string,string>")
    sandbox = F.create_map(F.lit("source_file"), file_name(F.col("path")), F.lit("timestamp"), F.lit(timestamp))
    notes = rows.select(key(file_base(F.col("path"))).alias("key"), F.lit(0).alias("annotation"), sandbox.alias("sandbox"), "start", "end", "label", F.lit(1.0).alias("confidence"))
    if metadata is None:
        notes = notes.withColumn("metadata", none)
    else:
        notes = notes.join(metadata.select("key", "metadata"), "key", "left").withColumn("metadata", F.coalesce("metadata", none))
    return notes.select(*NOTE_FIELDS)


def pair_annotators(a: DataFrame, b: DataFrame, key: Callable[[Column], Column], names: tuple[str, str]) -> DataFrame:
    """Annotation rows of two annotators' files, paired on the key in the names and not by list position: annotations 0 and 1 of a key.

    The annotator is in the metadata. ``paired`` says whether both annotated the key; files of one annotator alone stay.
    """
    sides = []
    for i, (df, name) in enumerate(zip((a, b), names, strict=True)):
        rows = intervals_to_annotations(df, None, "", key).withColumns({"annotation": F.lit(i), "sandbox": F.create_map(F.lit("source_file"), F.element_at("sandbox", "source_file")), "metadata": F.create_map(F.lit("annotator"), F.lit(name))})
        sides.append(rows)
    both = sides[0].select("key").distinct().join(sides[1].select("key").distinct(), "key").withColumn("paired", F.lit(True))
    return sides[0].unionByName(sides[1]).join(both, "key", "left").withColumn("paired", F.coalesce("paired", F.lit(False)))


def decoded_annotations(segments: DataFrame, key: str, label: Column, penalty: Column, path: Column | None = None) -> DataFrame:
    """Decoded segments (start, end, confidence) as annotation rows tagged as a machine's, with penalty and run parameters in the sandbox.

    Annotations of a key are numbered by penalty.
    """
    run = run_parameters(path) if path is not None else None
    fields = [] if run is None else [x for f in ("model", "dropout", "fold", "split", "checkpoint") for x in (F.lit(f), run[f])]
    sandbox = F.create_map(F.lit("penalty"), penalty.cast("string"), *fields)
    rows = segments.select(F.col(key).alias("key"), penalty.alias("__p"), sandbox.alias("sandbox"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), label.alias("label"), F.col("confidence").cast("double").alias("confidence"))
    order = rows.select("key", "__p").distinct().withColumn("annotation", F.row_number().over(Window.partitionBy("key").orderBy("__p")) - 1)
    rows = rows.join(order, ["key", "__p"]).withColumn("metadata", F.create_map(F.lit("data_source"), F.lit("machine estimation")))
    return rows.select(*NOTE_FIELDS, F.col("__p").alias("penalty"))


def write_decodes(annotations: DataFrame, path: str) -> None:
    """decoded_annotations() as one text sink per penalty (a folder each), so that penalties are read apart."""
    lines = None
    for p in [r[0] for r in annotations.select("penalty").distinct().collect()]:
        part = annotation_lines(annotations.where(F.col("penalty") == p)).select("value", F.lit(p).alias("penalty"))
        lines = part if lines is None else lines.unionByName(part)
    if lines is not None:
        lines.write.mode("overwrite").partitionBy("penalty").text(path)


def read_voicings(spark: SparkSession, path: str) -> DataFrame:
    """(label, tab) of a JSON object of labels and tablatures."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("label", "tab"))


def public_columns(df: DataFrame) -> DataFrame:
    """Without columns, and fields of structs, whose name begins with an underscore."""

    def kept(c: Column, t: T.DataType) -> Column:
        if isinstance(t, T.StructType):
            return F.struct(*[kept(c[f.name], f.dataType).alias(f.name) for f in t if not f.name.startswith("_")]) if any(not f.name.startswith("_") for f in t) else F.lit(None)
        return c

    return df.select(*[kept(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema if not f.name.startswith("_")])


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """(fold, split, key) of a JSON split file {fold: {split: [keys]}}."""
    folds = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,map<string,array<string>>>")).alias("fold", "s"))
    return folds.select("fold", F.explode("s").alias("split", "keys")).select("fold", "split", F.explode("keys").alias("key"))


def write_stash(df: DataFrame, path: str, *by: str) -> None:
    """Records as parquet, partitioned by the given columns (for instance fold and split), so that reading one part prunes the rest."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def timbre_fields(path: Column) -> list[Column]:
    """icode, note_number and fcode of a file name of exactly three parts; other names raise."""
    parts = F.split(file_base(path), "_")
    ok = F.when(F.size(parts) != 3, F.raise_error(F.concat(F.lit("not three parts: "), path))).otherwise(parts)
    return [F.element_at(ok, i + 1).alias(n) for i, n in enumerate(("icode", "note_number", "fcode"))]


def run_parameters(path: Column) -> Column:
    """(model, dropout, fold, split, checkpoint) of an output path; four parts mean the best checkpoint."""
    parts = F.split(F.regexp_replace(path, r"\.[^./]*$", ""), "/")
    tail = F.slice(parts, -4, 4)
    five = F.slice(parts, -5, 5)
    fields = ("model", "dropout", "fold", "split")
    return F.when(F.size(parts) >= 5, F.struct(*[F.get(five, F.lit(i)).alias(n) for i, n in enumerate(fields)], F.get(five, F.lit(4)).alias("checkpoint"))).otherwise(
        F.struct(*[F.get(tail, F.lit(i)).alias(n) for i, n in enumerate(fields)], F.lit("best").alias("checkpoint"))
    )


def checkpoint_sweep(checkpoints: DataFrame, keys: DataFrame, start: int, stride: int) -> DataFrame:
    """Every key with every stride-th checkpoint by name order. Checkpoints are a list of files of one training run."""
    chosen = number_rows(checkpoints.select("path").distinct(), ["path"]).where((F.col("number") >= start) & ((F.col("number") - start) % stride == 0))
    chosen = cut_lineage(chosen.select(F.col("path").alias("checkpoint")))
    # each key once per chosen checkpoint is the result asked for
    return keys.crossJoin(broadcast_small(chosen, chosen.count()))


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """(path, samplerate, channels, samples) of PCM WAV files; samples are doubles in [-1, 1), channels averaged. Other files have null samples."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    with wave.open(io.BytesIO(content)) as w:
                        width, ch, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
                        raw = w.readframes(w.getnframes())
                    if width == 1:
                        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
                    else:
                        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(float) / 2.0 ** (8 * width - 1)
                    out.append((p, float(rate), ch, x.reshape(-1, ch).mean(axis=1)))
                except (wave.Error, EOFError, KeyError):
                    out.append((p, None, None, None))
            yield pd.DataFrame(out, columns=["path", "samplerate", "channels", "samples"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, samplerate double, channels int, samples array<double>")


