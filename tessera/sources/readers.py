"""Readers: annotation JSON, JSON lines, banks, manifests, label lists, images, Arrow streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..operators.running import numbered
from . import mat, png
from .json_documents import elements

COCO = (
    "images array<struct<id:bigint,width:int,height:int,file_name:string,coco_url:string,not_exhaustive_category_ids:array<int>>>, "
    "annotations array<struct<id:bigint,image_id:bigint,category_id:int,segmentation:string,bbox:array<double>,area:double,iscrowd:int>>, "
    "categories array<struct<id:int,name:string,original_name:string,cityscapes_label_id:int>>"
)
PREDICTIONS = "image_id bigint, file_name string, category_id int, category string, score double, method string, prompt_mode string, merge_strategy string, segmentation struct<size:array<int>,counts:string>"
BANK = "class_name string, image_id bigint, ann_id bigint, patch_no int, embedding array<float>, score float, tp int, fp int"
SCENES = "image struct<bytes:binary,path:string>, filename string, folder string, source struct<filename:string,folder:string>, objects array<struct<name:string,raw_name:string,depth_ordering_rank:int,polygon:struct<x:array<int>,y:array<int>>>>, instances array<struct<bytes:binary>>"


def coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, categories). file_name falls back to the base name of coco_url; images without either drop out;
    segmentation stays raw JSON."""
    found = elements(spark, path)
    shape = {f.name: f.dataType.elementType for f in StructType.fromDDL(COCO)}
    of = lambda key: found.where(F.col("key") == key).select(F.from_json("element", shape[key]).alias("x"), "block", "seq")
    images = of("images").select("x.*")
    name = F.coalesce(F.nullif(F.trim("file_name"), F.lit("")), F.nullif(F.element_at(F.split(F.trim("coco_url"), "/"), -1), F.lit("")))
    images = images.withColumn("file_name", name).where("file_name is not null").withColumn("not_exhaustive_category_ids", F.coalesce("not_exhaustive_category_ids", F.array().cast("array<int>")))
    categories = numbered(of("categories").select("x.*", "block", "seq"), "block", "seq", name="_n").withColumn("ord", (F.col("_n") - 1).cast("int")).drop("block", "seq", "_n")
    return images, of("annotations").select("x.*"), categories


def grouped_annotations(annotations: DataFrame) -> DataFrame:
    """(image_id, category_id, annotations in id order)."""
    return annotations.groupBy("image_id", "category_id").agg(F.array_sort(F.collect_list(F.struct("id", "segmentation", "bbox", "area", "iscrowd"))).alias("annotations"))


def records(images: DataFrame, annotations: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(image_id, file_name, valid_cats): images whose file exists and that keep a category."""
    rows = images.withColumnRenamed("id", "image_id")
    if existing is not None:
        rows = rows.join(existing.select("file_name").distinct(), "file_name", "left_semi")
    cats = annotations.groupBy("image_id").agg(F.collect_set("category_id").alias("_c"))
    out = rows.join(cats, "image_id").withColumn("valid_cats", F.array_sort(F.array_except("_c", "not_exhaustive_category_ids")))
    return out.where(F.size("valid_cats") > 0).select("image_id", "file_name", "width", "height", "valid_cats")


def json_lines(spark: SparkSession, path: str, schema: str = PREDICTIONS) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """The objects of one JSON array."""
    return elements(spark, path).select(F.from_json("element", PREDICTIONS).alias("x")).select("x.*")


def manifest(spark: SparkSession, path: str, item: str) -> DataFrame:
    """A list of items, or an object with the list under items."""
    listed = spark.read.option("multiLine", True).schema(f"items array<struct<{item}>>").json(path)
    inside = listed.where("items is not null").select(F.explode("items").alias("i")).select("i.*")
    plain = spark.read.option("multiLine", True).schema(", ".join(x.replace(":", " ", 1) for x in _fields(item))).json(path)
    return inside.unionByName(plain.dropna(how="all"))


def _fields(item: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, ch in enumerate(item):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(item[last:i])
            last = i + 1
    return [*out, item[last:]]


def bank(spark: SparkSession, path: str, classes: list[str] | None = None, scored: bool = False) -> DataFrame:
    """A bank partitioned by class; only the partitions of classes are read; scored: rows with a score only."""
    out = spark.read.schema(BANK).parquet(path)
    out = out if classes is None else out.where(F.col("class_name").isin(classes))
    return out.where("score is not null") if scored else out


def prototypes(spark: SparkSession, path: str, classes: list[str] | None = None) -> DataFrame:
    """(class_name, place, embedding) kept beside a bank; no rows if it has none."""
    at, shape = f"{path.rstrip('/')}/_prototypes", "class_name string, place int, embedding array<float>"
    out = spark.read.schema(shape).parquet(at) if exists(spark, at) else spark.createDataFrame([], shape)
    return out if classes is None else out.where(F.col("class_name").isin(classes))


def bank_classes(banks: DataFrame) -> DataFrame:
    return banks.select("class_name").distinct().where(~F.col("class_name").startswith("_")).orderBy("class_name")


def image_ids(files: DataFrame, name: str = "file_name", strict: bool = False) -> DataFrame:
    """Distinct image ids that file names <image>_<ann>.pt begin with; other names are skipped, or fail with strict."""
    part = F.split_part(F.col(name), F.lit("_"), F.lit(1))
    if strict:
        return files.select(part.cast("bigint").alias("image_id")).distinct()
    return files.select(part.try_cast("bigint").alias("image_id")).where("image_id is not null").distinct()


def shards(spark: SparkSession, root: str, required: tuple[str, ...] = ("train", "validation")) -> dict[str, DataFrame]:
    """Parquet shards <split>-*.parquet of each split; all must exist."""
    out = {}
    for split in required:
        if not exists(spark, f"{root}/{split}-*.parquet"):
            raise FileNotFoundError(f"no {split}-*.parquet under {root}")
        out[split] = spark.read.schema(SCENES).parquet(f"{root}/{split}-*.parquet")
    return out


def exists(spark: SparkSession, pattern: str) -> bool:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def first_existing(spark: SparkSession, candidates: list[str]) -> str:
    """The first candidate path that exists."""
    for c in candidates:
        if exists(spark, c):
            return c
    raise FileNotFoundError(f"none of {candidates}")


#: Probe order of dataset layouts: name and the paths (under the root) of which all must exist.
LAYOUTS = (
    ("parquet", ("train-*.parquet", "validation-*.parquet")),
    ("ade150", ("images/training", "annotations/training")),
    ("ade847", ("*.arrow",)),
    ("cityscapes", ("leftImg8bit", "gtFine")),
    ("lvis", ("lvis_v1_train.json", "lvis_v1_val.json")),
    ("coco", ("train.json", "val.json")),
    ("coco", ("train.json", "test.json")),
    ("pascal", ("JPEGImages", "SegmentationClass")),
)


def layout(spark: SparkSession, root: str) -> str:
    for name, paths in LAYOUTS:
        if all(exists(spark, f"{root}/{p}") for p in paths):
            return name
    raise FileNotFoundError(f"no known layout under {root}")


def split_ids(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines of a split file."""
    return spark.read.text(path).select(F.trim("value").alias("stem")).where("stem <> ''")


def label_list(spark: SparkSession, path: str) -> DataFrame:
    """(label, name) of lines "id: name" or "id - name"."""
    rows = spark.read.text(path).select(F.regexp_extract("value", r"^\s*(\d+)\s*[:\-]?\s*(.+?)\s*$", 1).alias("i"), F.regexp_extract("value", r"^\s*(\d+)\s*[:\-]?\s*(.+?)\s*$", 2).alias("name"))
    return rows.where("i <> ''").select(F.col("i").cast("int").alias("label"), "name")


def tab_list(spark: SparkSession, path: str) -> DataFrame:
    """(label, name): last column of tab-separated lines, lower case, numbered from 1 in the file's order (one small file)."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "")).alias("k", "line"))
    return lines.select((F.col("k") + 1).alias("label"), F.lower(F.trim(F.element_at(F.split("line", "\t"), -1))).alias("name"))


def image_files(spark: SparkSession, root: str, pattern: str = "*.{png,jpg,jpeg}") -> DataFrame:
    """(path, length, content): content is read only where it is selected."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root).select("path", "length", "content")


def raw_bytes(cell: Column) -> Column:
    """Bytes of an image cell struct<bytes, data, ...>: the first of the two that is there."""
    return F.coalesce(cell["bytes"], cell["data"])


def decoded(images: DataFrame, content: str = "content") -> DataFrame:
    """images with pixels struct<height, width, data> as RGB, null where bytes cannot be read: PNG by this package's reader,
    other formats by an imaging library if there is one."""
    import io

    def load(b):
        if b[:8] == png.SIGNATURE:
            try:
                return png.decode(bytes(b), colours=True)
            except ValueError:
                pass
        from PIL import Image

        im = Image.open(io.BytesIO(b)).convert("RGB")
        return np.asarray(im)

    @F.pandas_udf("struct<height:int,width:int,data:binary>")
    def decode(x: pd.Series) -> pd.DataFrame:
        out = []
        for b in x:
            try:
                pixels = load(b)
                out.append((*pixels.shape[:2], pixels.tobytes()))
            except Exception:  # a row that cannot be read is null, whatever the reason
                out.append((None, None, None))
        return pd.DataFrame(out, columns=["height", "width", "data"])

    return images.withColumn("pixels", decode(content))


class ArrowStreams(DataSource):
    """spark.read.format("arrow_stream").option("path", "a.arrow,b.arrow").schema(...): Arrow IPC streams, one task a file."""

    @classmethod
    def name(cls) -> str:
        return "arrow_stream"

    def schema(self) -> str:
        import pyarrow as pa
        from pyspark.sql.pandas.types import from_arrow_schema

        with pa.memory_map(self.options["path"].split(",")[0]) as f:
            return from_arrow_schema(pa.ipc.open_stream(f).schema)

    def reader(self, schema) -> DataSourceReader:
        return _ArrowReader(self.options["path"].split(","))


class _ArrowReader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator:
        import pyarrow as pa

        with pa.memory_map(partition.value) as f:
            yield from pa.ipc.open_stream(f)


def arrow_streams(spark: SparkSession, paths: list[str]) -> DataFrame:
    spark.dataSource.register(ArrowStreams)
    return spark.read.format("arrow_stream").option("path", ",".join(paths)).load()


def image_root(spark: SparkSession, root: str, candidates: list[str], samples: list[str]) -> str:
    """The first candidate folder that holds the first 3 of at most 10 sample files; else the folder under root that holds
    most of the samples (the least name on a tie), by a listing that reads no contents."""
    for c in candidates:
        if all(exists(spark, f"{c}/{s}") for s in samples[:10][:3]):
            return c
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    ends = F.array(*[F.lit("/" + s) for s in samples[:10]])
    hits = listed.withColumn("s", F.explode(ends)).where(F.endswith("path", "s")).select(F.expr("substr(path, 1, length(path) - length(s))").alias("root"))
    top = hits.groupBy("root").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "root").first()
    if top is None:
        raise FileNotFoundError(f"no folder under {root} holds any of {samples[:10]}")
    return top["root"]


def label_masks(images: DataFrame, content: str = "content") -> DataFrame:
    """(path, label, start, len): column-major runs of each label of label images (PNG, .npy, and level-5 .mat with the
    matrix LabelMap); files that cannot be read give no rows."""
    import io

    def load(path: str, data: bytes):
        if path.endswith(".mat"):
            return mat.variables(data)["LabelMap"].astype(np.int64)
        if path.endswith(".npy"):
            return np.load(io.BytesIO(data))
        return png.decode(bytes(data))

    def run(batches):
        for x in batches:
            out = []
            for path, data in zip(x["path"], x[content], strict=True):
                try:
                    flat = load(path, data).ravel(order="F")
                except (ValueError, KeyError, OSError):
                    continue
                edges = np.flatnonzero(np.diff(flat)) + 1
                starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(flat)]])
                out += [(path, int(flat[s]), int(s), int(e - s)) for s, e in zip(starts, ends, strict=True)]
            yield pd.DataFrame(out, columns=["path", "label", "start", "len"])

    return images.select("path", content).mapInPandas(run, "path string, label int, start long, len long")
