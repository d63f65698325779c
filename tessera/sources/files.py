"""Readers of the reference's inputs: folders, lists, tables, arrays, results, manifests, structured annotations."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp")


def folder(spark: SparkSession, path: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES, content: bool = False) -> DataFrame:
    """(path, name, stem, length[, content]) of files below a folder. Content is read only where asked for."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    out = rows.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), "length", *(["content"] if content else []))
    return out


def listing(spark: SparkSession, path: str, root: str = "", suffix: str = "") -> DataFrame:
    """(line, path): one name a line, blank lines left out."""
    rows = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")
    return rows.select("line", F.concat(F.lit(root), F.col("line"), F.lit(suffix)).alias("path"))


def label_lines(spark: SparkSession, path: str) -> DataFrame:
    """(name, label) of lines `name label`."""
    part = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(part) >= 2).select(F.regexp_replace(part[0], r"\.[^.]*$", "").alias("name"), part[1].cast("int").alias("label"))


def with_labels(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Images keep their place without a label."""
    return images.join(labels.withColumnRenamed("name", "stem"), "stem", "left")


QUESTIONS = "index long, question string, answer string, category string, l2_category string, A string, B string, C string, D string, image string"


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Multiple-choice questions of a tab-separated file: options as a map without absent ones, image bytes."""
    rows = spark.read.csv(path, sep="\t", header=True, multiLine=True, quote='"', escape='"')
    have = [c for c in "ABCD" if c in rows.columns]
    options = F.map_filter(F.create_map(*[x for c in have for x in (F.lit(c), F.col(c))]), lambda _, v: v.isNotNull())
    keep = [c for c in ("index", "question", "answer", "category", "l2_category") if c in rows.columns]
    return rows.select(*keep, options.alias("options"), *([F.unbase64("image").alias("image")] if "image" in rows.columns else []))


def results(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, metric, value) of the `results` object of JSON files."""
    text = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.from_json(F.get_json_object("value", "$.results"), "map<string, double>").alias("results"))
    return text.select("path", F.explode("results").alias("metric", "value"))


def write_result(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def arrays(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """(path, shape, values) of .npy files, or of one key of .npz files; only that key is unpacked."""

    @F.pandas_udf("shape array<int>, values array<float>")
    def load(content: pd.Series) -> pd.DataFrame:
        found = []
        for data in content:
            got = np.load(io.BytesIO(data), allow_pickle=False)
            got = got[key] if key is not None else got
            found.append((list(got.shape), got.astype(np.float32).ravel()))
        return pd.DataFrame(found, columns=["shape", "values"])

    suffix = "npy" if key is None else "npz"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{suffix}").load(path)
    return rows.select("path", load("content").alias("a")).select("path", "a.shape", "a.values")


def yuv420_frames(spark: SparkSession, path: str, h: int, w: int) -> DataFrame:
    """(path, frame_idx, y, u, v) of raw 8-bit 4:2:0 files; a cut-off frame at the end is left out."""
    size = h * w * 3 // 2
    rows = spark.read.format("binaryFile").load(path)
    # The frames are cut out before they become rows, so that no row holds more than its own.
    places = F.filter(F.sequence(F.lit(0), F.floor(F.length("content") / size).cast("int")), lambda k: k < F.floor(F.length("content") / size))
    frames = F.transform(places, lambda k: F.substring(F.col("content"), k * size + 1, F.lit(size)))
    each = rows.select("path", F.posexplode(frames).alias("frame_idx", "frame"))
    at = lambda start, n: F.substring("frame", start + 1, n)
    return each.select("path", "frame_idx", at(0, h * w).alias("y"), at(h * w, h * w // 4).alias("u"), at(h * w + h * w // 4, h * w // 4).alias("v"))


# Manifests


def manifest(lines: DataFrame, base_url: str, column: str = "value") -> DataFrame:
    """(dest, url, algo, expected) of lines `dest [url] [sha256:|md5:|size:value]`; comments and blank lines left out."""
    parts = F.split(F.trim(column), r"\s+")
    rows = lines.where((F.trim(column) != "") & ~F.startswith(F.trim(column), F.lit("#"))).select(parts.alias("p"))
    check = F.get(F.filter(F.slice("p", 2, 2), lambda x: x.rlike("^(sha256|md5|size):")), F.lit(0))
    url = F.get(F.filter(F.slice("p", 2, 1), lambda x: ~x.rlike("^(sha256|md5|size):")), F.lit(0))
    return rows.select(
        F.col("p")[0].alias("dest"), F.coalesce(url, F.concat(F.lit(base_url.rstrip("/") + "/"), F.col("p")[0])).alias("url"),
        F.nullif(F.split_part(check, F.lit(":"), F.lit(1)), F.lit("")).alias("algo"), F.lower(F.nullif(F.split_part(check, F.lit(":"), F.lit(2)), F.lit(""))).alias("expected"),
    )


def verify(entries: DataFrame, files: DataFrame, dest: str = "dest") -> DataFrame:
    """Adds the status of each entry against (dest, content): ok, missing, size_mismatch, checksum_mismatch. Stated hashes may be prefixes."""
    joined = entries.join(files, dest, "left")
    return joined.withColumn("status", status(F.col("content"), F.col("algo"), F.col("expected"))).drop("content")


def status(content: Column, algo: Column, expected: Column) -> Column:
    digest = F.when(algo == "sha256", F.sha2(content, 256)).when(algo == "md5", F.md5(content))
    return (
        F.when(content.isNull(), "missing")
        .when(algo.isNull(), "ok")
        .when(algo == "size", F.when(F.octet_length(content) == expected.try_cast("long"), "ok").otherwise("size_mismatch"))
        .when(F.startswith(digest, expected), "ok")
        .otherwise("checksum_mismatch")
    )


# Annotations


def structured_data(texts: DataFrame, column: str = "value") -> DataFrame:
    """(cls, box) of JSON like {"Object Detection": {"plane_1": [x1, y1, x2, y2]}}, with the other columns."""
    boxes = F.from_json(F.get_json_object(column, "$['Object Detection']"), "map<string, array<double>>")
    others = [c for c in texts.columns if c != column]
    rows = texts.select(*others, F.explode(boxes).alias("name", "box"))
    return rows.select(*others, F.regexp_replace("name", r"_\d+$", "").alias("cls"), "box")


def numbered(boxes: DataFrame, image: str) -> DataFrame:
    """Names boxes cls_1, cls_2, ... in each image and class, left to right."""
    by = Window.partitionBy(image, "cls").orderBy("box")
    return boxes.withColumn("name", F.concat_ws("_", "cls", F.row_number().over(by)))


def structured_text(boxes: DataFrame, image: str) -> DataFrame:
    """The JSON of each image's named boxes."""
    rows = boxes.groupBy(image).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "box")))).alias("b"))
    return rows.select(image, F.to_json(F.struct(F.col("b").alias("Object Detection"))).alias("value"))


# Re-identification


def identities(names: DataFrame, column: str = "name") -> DataFrame:
    """Adds pid and camid from file names; names of another form and the junk identity -1 are left out."""
    from tessera.functions.text import reid_fields

    return names.withColumn("f", reid_fields(F.col(column))).select(*names.columns, "f.pid", "f.camid").where("pid IS NOT NULL AND pid <> -1")


def relabelled(rows: DataFrame, key: str = "pid") -> DataFrame:
    """Adds `label`: identities numbered from 0 in order. The distinct identities are ranked, not the rows."""
    ids = rows.select(key).distinct().withColumn("label", F.dense_rank().over(Window.orderBy(key)) - 1)
    return rows.join(ids, key)


def identity_statistics(rows: DataFrame, pid: str = "pid", cam: str = "camid") -> DataFrame:
    return rows.agg(F.count_distinct(pid).alias("n_pids"), F.count("*").alias("n_images"), F.count_distinct(cam).alias("n_cams"), (F.max(cam) + 1).alias("cam_range"))
