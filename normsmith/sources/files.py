"""File sources and sinks.

CSV and JSON are read with declared schemas (no inference pass).  Results
that are expensive to recompute are written once as parquet under the
shared checkpoint folder the cluster names, keyed by a content fingerprint
of their input plus their parameters.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nulls import normalise_nulls
from ..operators.ranks import runs, sorted_rows
from ..session import checkpoint_dir, discard


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str, null_value: str | None = "NA",
             tokens: Iterable[str] | None = ("", "NA"), levels: dict[str, list[str]] | None = None) -> DataFrame:
    """Header CSV with a declared schema.  ``null_value`` is the
    reader's own null token; ``tokens`` are further strings turned to null
    in every string column (the R reader's default is empty and ``NA``).
    Pass ``null_value=''`` and ``tokens=None`` for recode tables whose text
    ``NA`` is a label.  A byte-order mark on the first header name is
    harmless: columns come from ``schema``, not from the header.
    ``levels`` declares factor columns: a value outside its level list
    becomes null and ``<column>_ord`` holds the level's place."""
    r = spark.read.option("header", True).option("encoding", "UTF-8").schema(schema)
    if null_value is not None:
        r = r.option("nullValue", null_value)
    df = r.csv(path)
    if tokens:
        df = normalise_nulls(df, tokens)
    for name, known in (levels or {}).items():
        place = F.nullif(F.array_position(F.array(*[F.lit(x) for x in known]), F.col(name)), F.lit(0)).cast("int")
        df = df.withColumn(f"{name}_ord", place).withColumn(name, F.when(place.isNotNull(), F.col(name)))
    return df


def read_export_dir(spark: SparkSession, path: str, schema: T.StructType | str, status_col: str = "user_status",
                    statuses: Iterable[str] = ("guest", "registered")) -> DataFrame:
    """Every CSV page of an export directory, whole-row duplicates
    removed (pages overlap), rows of the wanted user statuses only."""
    df = read_csv(spark, path, schema)
    return df.distinct().where(F.col(status_col).isin(list(statuses)))


def latest_file(spark: SparkSession, directory: str, pattern: str, schema: T.StructType | str) -> DataFrame:
    """Rows of the newest export only.  The names of the files (or
    folders of part files) matching ``pattern`` carry the date, so the
    greatest name is the latest.  Only names are listed (the ``binaryFile``
    source reads no content when none is asked for); the older exports are
    never opened."""
    root = directory.rstrip("/")
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/{pattern}").select("path")
    # the path element below the directory
    element = F.element_at(F.split(F.element_at(F.split("path", re.escape(f"{root.rsplit('/', 1)[-1]}/")), -1), "/"), 1)
    newest = names.agg(F.max(element)).first()[0]
    return spark.read.option("header", True).schema(schema).csv(f"{root}/{newest}")


def read_project_json(spark: SparkSession, path: str, schema: T.DataType) -> DataFrame:
    """Nested project file (one JSON array of components), one row per
    component."""
    raw = spark.read.option("multiLine", True).text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", schema)).alias("c")).select("c.*")


class PagedExport:
    """S3: the rows of ``df`` in ``key`` order, in pages of any size.

    The rows are sorted once by one range shuffle and staged (``ranks``); the
    page directory has one row per partition, its number of rows and the
    place of its first.  A page opens only the ranges that hold it: its filter
    is on the stored place, which the files' statistics are about, and no row
    passes through a single task but the page's own."""

    def __init__(self, df: DataFrame, key: Iterable[str]):
        self._columns, key = df.columns, list(key)
        self._rows = sorted_rows(df, [], key)
        # one entry per partition of the sort
        self._directory = sorted((r["__first"], r["__before"], r["__c"]) for r in runs(self._rows, []).collect())

    def page(self, size: int, number: int) -> DataFrame:
        """Rows ``number * size`` and on; empty behind the last."""
        lo, hi = number * size, (number + 1) * size
        wanted = F.lit(False)
        for first, before, count in self._directory:
            if before < hi and before + count > lo:
                wanted = wanted | F.col("__at").between(first + max(lo - before, 0), first + min(hi - before, count) - 1)
        return self._rows.where(wanted).orderBy("__at").select(*self._columns)

    def close(self) -> None:
        """Delete the staged rows."""
        discard(self._rows)


def page(df: DataFrame, key: Iterable[str], size: int, number: int) -> DataFrame:
    """S3: one page (from 0) in ``key`` order; for several pages of one table
    keep a ``PagedExport``."""
    return PagedExport(df, key).page(size, number)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Iterable[str] | None = None,
                mode: str = "overwrite") -> None:
    """Sink; parquet by default, optionally partitioned (e.g. by task
    so later task subsets prune files)."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


# --------------------------------------------------------------------------
# S11 / S12
# --------------------------------------------------------------------------
def fingerprint(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """One-row (n_rows, fingerprint) of a DataFrame's content, order
    independent: the sum of 64-bit row hashes as an exact decimal
    (xor would cancel duplicate rows).  One aggregate, partial per task."""
    cols = list(columns) if columns is not None else df.columns
    h = F.xxhash64(*[F.col(f"`{c}`") for c in cols]).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).cast("long").alias("n_rows"), F.sum(h).cast("string").alias("fingerprint"))


def fingerprint_by(df: DataFrame, by: Iterable[str], columns: Iterable[str] | None = None) -> DataFrame:
    """S12 per group (e.g. per task, as the reference names one cache file
    per task)."""
    by = list(by)
    cols = list(columns) if columns is not None else [c for c in df.columns if c not in by]
    h = F.xxhash64(*[F.col(f"`{c}`") for c in cols]).cast("decimal(38,0)")
    return df.groupBy(*by).agg(F.count(F.lit(1)).cast("long").alias("n_rows"),
                               F.sum(h).cast("string").alias("fingerprint"))


def digest_by(df: DataFrame, by: Iterable[str], columns: Iterable[str]) -> DataFrame:
    """S12 with a digest that other engines have too: per group the sums of
    the first two 32-bit words of the rows' MD5."""
    by = list(by)
    d = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]))
    words = [F.conv(F.substring(d, at, 8), 16, 10).cast("decimal(38,0)") for at in (1, 9)]
    return df.groupBy(*by).agg(F.count(F.lit(1)).cast("long").alias("n_rows"),
                               F.sum(words[0]).cast("string").alias("lo"), F.sum(words[1]).cast("string").alias("hi"))


def cache_path(spark: SparkSession, name: str, data: DataFrame, params: dict, root: str | None = None,
               by_files: bool = False) -> str:
    """Path ``<root>/<name>_<hash>`` where the hash covers the input's
    fingerprint *and* the parameters (so changed parameters never reuse a
    stale result).  With ``by_files`` the input is known by the paths, lengths
    and times of the files it reads, and its rows are not read: for inputs
    that are files as they are."""
    import hashlib

    root = root or checkpoint_dir(spark)
    if not root:
        raise RuntimeError("no spark.checkpoint.dir configured for cached results")
    if by_files:
        known = {"files": sorted(file_marks(spark, data.inputFiles()))}
    else:
        row = fingerprint(data).first()
        known = {"n": row["n_rows"], "fp": row["fingerprint"]}
    key = json.dumps({**known, "params": params}, sort_keys=True, default=str)
    return f"{root.rstrip('/')}/normsmith-cache/{name}_{hashlib.sha256(key.encode()).hexdigest()[:16]}"


def file_marks(spark: SparkSession, paths: list[str]) -> list[tuple[str, int, int]]:
    """(path, length, modification time) of files."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        status = p.getFileSystem(conf).getFileStatus(p)
        out.append((path, status.getLen(), status.getModificationTime()))
    return out


def publish(spark: SparkSession, df: DataFrame, path: str) -> bool:
    """Write ``df`` to a folder of its own, then give it its name by one
    rename that fails where the name is taken.  Of several jobs that publish
    the same path one wins; the others delete what they wrote and return
    False.  Readers never see a result that is half written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    own = f"{path}.part-{uuid.uuid4().hex}"
    df.write.parquet(own)
    source, target = jvm.org.apache.hadoop.fs.Path(own), jvm.org.apache.hadoop.fs.Path(path)
    store = source.getFileSystem(conf)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), conf)
    options = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
    try:
        context.rename(store.makeQualified(source), store.makeQualified(target), options)
        return True
    except Py4JJavaError as e:
        if not store.exists(target):
            raise
        if "FileAlreadyExists" not in str(e.java_exception.getClass().getName()) and not store.exists(source):
            raise
        store.delete(source, True)
        return False


def run_or_load(spark: SparkSession, name: str, data: DataFrame, params: dict,
                compute: Callable[[], DataFrame], root: str | None = None, by_files: bool = False) -> DataFrame:
    """Read the stored result if it exists, otherwise compute it and
    publish it under its name (``publish``); where another job was faster, its
    result is read.  A run that dies half-way leaves no result."""
    path = cache_path(spark, name, data, params, root, by_files)
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        publish(spark, compute(), path)
    return spark.read.parquet(path)
