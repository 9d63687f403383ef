"""Reading and writing reviews and reports."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import or_
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.functions.text import category_from_file_name
from reviewlens.schema import REVIEW_SCHEMA, conform

# The form of a review file: no field is quoted, and no character escapes another. The reader wants a
# quote all the same, so it gets a code point that is no character. An empty one would mean NUL.
TSV = {"sep": "\t", "quote": "\ufdd0", "escape": "\ufdd0"}

BAD_LINE = "__bad_line"

# What a row of a list of files takes in a broadcast, and the largest list, in bytes, that is broadcast.
FILE_BYTES = 400
MAX_BROADCAST_BYTES = 64 << 20


def review_files(marketplace: str) -> str:
    """A glob that the names of a marketplace's review files fit, and few others."""
    return f"*_reviews_{marketplace}_*_v*.tsv.gz"


def read_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Reviews from a Parquet tree, `product_category` being a column or a partition of it."""
    paths = [path] if isinstance(path, str) else path
    found = spark.read.parquet(*paths)
    category = "product_category"
    if category in found.columns and found.schema[category].dataType != T.StringType():
        # Folder names that look like numbers: read again as they are spelt.
        fields = [T.StructField(category, T.StringType()) if f.name == category else f for f in found.schema]
        found = spark.read.schema(T.StructType(fields)).parquet(*paths)
    return conform(found)


def _read_lines(spark: SparkSession, path: str | list[str], checked: bool, names: str | None = None) -> DataFrame:
    """Lines of tab-separated files, of those only whose name fits the glob `names`, without headers. If `checked`, column `BAD_LINE` holds a line that has
    another number of fields than the schema or a field that is not of its type.

    Fields are read as text and cast here: the reader itself looks at the types of only those columns a
    query asks for, so a line would be bad in one report and good in the next.
    """
    schema = T.StructType([T.StructField(f.name, T.StringType()) for f in REVIEW_SCHEMA])
    options = {**TSV, "header": False, "mode": "PERMISSIVE"}
    if names is not None:
        options["pathGlobFilter"] = names
    if checked:
        schema = schema.add(BAD_LINE, T.StringType())
        options |= {"columnNameOfCorruptRecord": BAD_LINE, "columnPruning": False}
    first = REVIEW_SCHEMA[0].name
    rows = spark.read.schema(schema).options(**options).csv(path)
    rows = rows.where(~F.coalesce(F.col(first).startswith(first), F.lit(False)))
    typed = {f.name: F.col(f.name).try_cast(f.dataType) for f in REVIEW_SCHEMA if f.dataType != T.StringType()}
    if checked:
        unreadable = reduce(or_, [F.col(name).isNotNull() & value.isNull() for name, value in typed.items()])
        fields = [F.coalesce(F.col(f.name), F.lit("")) for f in REVIEW_SCHEMA]
        typed[BAD_LINE] = F.coalesce(BAD_LINE, F.when(unreadable, F.concat_ws("\t", *fields)))
    return rows.withColumns(typed)


def read_tsv(
    spark: SparkSession,
    path: str | list[str],
    category_from_file: bool = False,
    marketplace: str = "us",
    bad: str = "fail",
) -> DataFrame:
    """Reviews from tab-separated files, compressed or not, with or without header lines.

    Quotes are ordinary characters: with Spark's default an unbalanced one swallows the tabs after
    it. A line whose first field starts with the header's is dropped wherever it stands, as files
    put together from parts repeat it. With `category_from_file` the category is that in the file
    name (see `file_categories`), and files named otherwise are left out: most of them are not opened. An
    empty field is null.

    `bad` says what becomes of a line with too few or too many fields, or a number or date that cannot
    be read: "fail" the job, "drop" the line, or "keep" it with nulls for what it lacks. `bad_lines`
    shows them.

    A gzip file is read by one task: convert once with `write_parquet`, or see `spread`.
    """
    if bad not in ("fail", "drop", "keep"):
        raise ValueError(f"bad is {bad!r}, not fail, drop or keep")
    rows = _categorised(spark, path, bad != "keep", category_from_file, marketplace)
    if bad == "drop":
        rows = rows.where(F.col(BAD_LINE).isNull())
    if bad == "fail":
        told = F.concat(F.lit("unreadable line: "), F.substring(BAD_LINE, 1, 200))
        rows = rows.where(F.when(F.col(BAD_LINE).isNull(), True).otherwise(F.raise_error(told).cast("boolean")))
    return rows.drop(BAD_LINE)


def file_list(spark: SparkSession, path: str | list[str], names: str | None = None) -> DataFrame:
    """file (its path, as `_metadata.file_path` has it), name and bytes of every file under `path`, of those
    only whose name fits the glob `names`. No file is opened."""
    reader = spark.read.format("binaryFile")
    if names is not None:
        reader = reader.option("pathGlobFilter", names)
    of = {"file": "file_path", "name": "file_name", "bytes": "file_size"}
    return reader.load(path).select(*[F.col(f"_metadata.{c}").alias(alias) for alias, c in of.items()])


def file_categories(spark: SparkSession, path: str | list[str], marketplace: str = "us") -> DataFrame:
    """file and product_category of every review file of a marketplace, a row each: a name is parsed once,
    however many lines its file has."""
    found = file_list(spark, path, review_files(marketplace))
    category = category_from_file_name(F.col("name"), marketplace)
    return found.select("file", category.alias("product_category")).where(F.col("product_category").isNotNull())


def _categorised(
    spark: SparkSession, path: str | list[str], checked: bool, category_from_file: bool, marketplace: str, file: str | None = None
) -> DataFrame:
    """`_read_lines`, the category being that in the file name if asked for, and the file's name as column
    `file`, if one is given.

    Files of other marketplaces are left out as they are listed. A line finds its category by its file in
    the list of files, which the driver holds anyway; it is broadcast unless they are very many.
    """
    rows = _read_lines(spark, path, checked, review_files(marketplace) if category_from_file else None)
    if file is not None:
        rows = rows.withColumn(file, F.col("_metadata.file_name"))
    if not category_from_file:
        return rows
    listed = file_categories(spark, path, marketplace)
    listed = F.broadcast(listed) if len(rows.inputFiles()) * FILE_BYTES <= MAX_BROADCAST_BYTES else listed
    listed = listed.withColumnsRenamed({"file": "__path", "product_category": "__category"})
    named = rows.withColumn("__at", F.col("_metadata.file_path")).join(listed, F.col("__at") == F.col("__path"))
    return named.withColumn("product_category", F.col("__category")).select(rows.columns)


def bad_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The lines that `read_tsv` cannot read whole, each with the name of its file, to count or to store."""
    rows = _read_lines(spark, path, checked=True).where(F.col(BAD_LINE).isNotNull())
    return rows.select(F.col("_metadata.file_name").alias("file"), F.col(BAD_LINE).alias("line"))


@dataclass(frozen=True)
class Split:
    """What `split_tsv` wrote: reviews, the lines that are none (file, line), and how many of each."""

    reviews: DataFrame
    bad: DataFrame
    n_reviews: int
    n_bad: int


def split_tsv(
    spark: SparkSession,
    path: str | list[str],
    reviews_path: str,
    bad_path: str,
    category_from_file: bool = False,
    marketplace: str = "us",
) -> Split:
    """Tab-separated files as Parquet, in one reading: reviews by category under `reviews_path` (see
    `write_parquet`), the lines that `read_tsv` calls bad under `bad_path`, with their file. Both are counted
    on the way.

    Both places must be free. They are filled by renaming once all is written.
    """
    for place in (reviews_path, bad_path):
        if exists(spark, place):
            raise FileExistsError(place)
    rows = _categorised(spark, path, True, category_from_file, marketplace, "__file")
    is_bad = F.col(BAD_LINE).isNotNull()
    seen = Observation()
    rows = rows.observe(seen, F.count_if(~is_bad).alias("reviews"), F.count_if(is_bad).alias("bad"))
    category = F.col("product_category")
    told = F.raise_error(F.lit("an empty product_category cannot name a folder")).cast("string")
    rows = rows.withColumn("product_category", F.when(is_bad, None).when(category == "", told).otherwise(category))
    rows = rows.withColumn("__kind", F.when(is_bad, "bad").otherwise("reviews"))
    staged = f"{reviews_path.rstrip('/')}-_split-{uuid.uuid4().hex}"
    rows.hint("rebalance", "__kind", "product_category").write.partitionBy("__kind", "product_category").parquet(staged)
    for kind, place in (("reviews", reviews_path), ("bad", bad_path)):
        if exists(spark, f"{staged}/__kind={kind}"):
            rename(spark, f"{staged}/__kind={kind}", place)
        else:
            make_folder(spark, place)
    delete(spark, staged)
    return Split(_split_rows(spark, reviews_path, True), read_set_apart(spark, bad_path), seen.get["reviews"], seen.get["bad"])


def _split_rows(spark: SparkSession, path: str, good: bool) -> DataFrame:
    """One of the two places of `split_tsv`, which may hold no file."""
    fields = [f for f in REVIEW_SCHEMA if f.name != "product_category"]
    others = [T.StructField(c, T.StringType()) for c in (BAD_LINE, "__file", "product_category")]
    rows = spark.read.schema(T.StructType([*fields, *others])).parquet(path)
    return conform(rows) if good else rows


def read_set_apart(spark: SparkSession, path: str) -> DataFrame:
    """The lines that `split_tsv` set apart under `path`, and the names of their files: file, line."""
    rows = _split_rows(spark, path, False)
    return rows.select(F.col("__file").alias("file"), F.col(BAD_LINE).alias("line"))


def union_parts(parts: Iterable[DataFrame]) -> DataFrame:
    """All rows of all parts, by column name and without removing duplicates."""
    return reduce(DataFrame.unionByName, parts)


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores if its scan has fewer splits than there are, as with a few gzip files.

    Splits are planned by size, so a table large enough to keep the cluster busy is left as it is, and so is
    a frame with a shuffle, which has spread its rows and would run to tell its number of partitions.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def write_parquet(reviews: DataFrame, path: str) -> None:
    """Reviews as Parquet, one folder per category.

    Rebalancing gathers a category into files of the advisory size and splits one too large for a
    task, however many reviews a single category holds. An empty category is refused: its folder would
    be that of the null one.
    """
    category = F.col("product_category")
    told = F.raise_error(F.lit("an empty product_category cannot name a folder"))
    named = reviews.withColumn("product_category", F.when(category == "", told.cast("string")).otherwise(category))
    balanced = named.hint("rebalance", "product_category")
    balanced.write.mode("errorifexists").partitionBy("product_category").parquet(path)


# How tab-separated files are written.
_WRITTEN = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": ""}
_WRITTEN |= {**TSV, "header": True, "compression": "gzip"}


def _fields() -> list[Column]:
    """The review columns as fields of a line: without tabs and line breaks, as the form has no quoting."""
    return [F.regexp_replace(F.col(f.name).cast("string"), r"[\t\r\n]+", " ").alias(f.name) for f in REVIEW_SCHEMA]


def write_tsv(reviews: DataFrame, path: str) -> None:
    """Reviews as gzip files of tab-separated lines, each under a header line. Tabs and line breaks in
    a field become spaces, as the form has no quoting; null and empty fields are written alike."""
    reviews.select(_fields()).write.mode("errorifexists").options(**_WRITTEN).csv(path)


def write_named_tsv(reviews: DataFrame, path: str, dataset: str = "data") -> list[str]:
    """Reviews as files named `<dataset>_reviews_<marketplace>_<Category>_v1_<number>.tsv.gz`, the
    marketplace in lower case and a category's spaces as `_`, and these names.

    Categories are rebalanced as `write_parquet` does it. Files are written beside each other in a folder
    of this call and then renamed, so that a run that fails leaves no half file under a name; the driver
    handles names alone. A name needs a marketplace and a category without slashes.
    """
    parts = {"marketplace": F.lower("marketplace"), "category": F.translate("product_category", " ", "_")}
    told = F.raise_error(F.lit("a file name needs a marketplace and a category without slashes")).cast("string")
    named = {f"__{k}": F.when((v != "") & ~v.contains("/"), v).otherwise(told) for k, v in parts.items()}
    staged = f"{path}/_named-{uuid.uuid4().hex}"
    rows = reviews.select(*_fields(), *[v.alias(k) for k, v in named.items()]).hint("rebalance", *named)
    rows.write.partitionBy(*named).options(**_WRITTEN).csv(staged)
    numbers: Counter[tuple[str, str]] = Counter()
    names = []
    for file in sorted(files_under(reviews.sparkSession, staged)):
        folder = file.rsplit("/", 3)
        if not folder[3].startswith("part-"):
            continue
        marketplace, category = (unquote(part.split("=", 1)[1]) for part in folder[1:3])
        name = f"{dataset}_reviews_{marketplace}_{category}_v1_{numbers[marketplace, category]:02}.tsv.gz"
        numbers[marketplace, category] += 1
        rename(reviews.sparkSession, file, f"{path}/{name}")
        names.append(name)
    delete(reviews.sparkSession, staged)
    return names


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by spark.checkpoint.dir."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return folder


# Folders handed out by `new_folder` and not yet released, each with the table it is the place of, if any.
_handed_out: dict[str, str | None] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder, for an intermediate that `release` removes."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _handed_out[path] = None
    return path


def file_system(spark: SparkSession, path: str):
    """The file system that holds `path`, and the path as it takes it."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    system, target = file_system(spark, path)
    return system.exists(target)


def make_folder(spark: SparkSession, path: str) -> None:
    system, target = file_system(spark, path)
    system.mkdirs(target)


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Moves a file or a folder to a place that is free, in one file system."""
    system, source = file_system(spark, path)
    target = file_system(spark, to)[1]
    if system.exists(target):
        raise FileExistsError(to)
    system.mkdirs(target.getParent())
    if not system.rename(source, target):
        raise OSError(f"cannot rename {path} to {to}")


def delete(spark: SparkSession, path: str) -> None:
    system, target = file_system(spark, path)
    system.delete(target, True)


def files_under(spark: SparkSession, path: str) -> list[str]:
    """The paths of all files below a folder."""
    system, target = file_system(spark, path)
    found, listed = [], system.listFiles(target, True)
    while listed.hasNext():
        found.append(listed.next().getPath().toString())
    return found


def intermediates() -> list[str]:
    """The paths of this process's intermediates that have not been released."""
    return list(_handed_out)


def release(spark: SparkSession, paths: Iterable[str] | None = None) -> None:
    """Deletes intermediates, all of this process's without `paths`. Frames that read them are of no
    use afterwards."""
    for path in list(_handed_out if paths is None else paths):
        delete(spark, path)
        table = _handed_out.pop(path, None)
        if table is not None:
            spark.sql(f"DROP TABLE IF EXISTS {table}")


def keep(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """`store`, and the path that `release` takes."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(T.StructType(df.schema.fields)).parquet(path), path


def store(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back: computed once, whoever reads it how often,
    and not lost with an executor. `release` removes the files."""
    return keep(df, name)[0]


def store_bucketed(df: DataFrame, name: str, column: str, buckets: int | None = None) -> DataFrame:
    """`store` as a table of `buckets` by `column`, one sorted file each: a join by that column finds it in
    place. Fewer buckets than shuffles have partitions would be shuffled after all, so that is the default."""
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_folder(spark, name)
    table = f"{name}_{path.rsplit('-', 1)[1]}"
    dealt = df.repartition(buckets, column)
    dealt.write.option("path", path).bucketBy(buckets, column).sortBy(column).saveAsTable(table)
    _handed_out[path] = table
    return spark.table(table)


def small(rows: DataFrame, row_bytes: int) -> DataFrame:
    """A list to be broadcast if it is small enough at `row_bytes` a row; it is counted first."""
    return F.broadcast(rows) if rows.count() * row_bytes <= MAX_BROADCAST_BYTES else rows
