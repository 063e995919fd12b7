"""What the corpus operators share: reading tables, cutting lineage, hashing columns."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are runs of anything but ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; only where the cluster names none, one in the warehouse.

    On a cluster a warehouse on the machine's own disk is refused: other executors couldn't read it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if not spark.sparkContext.master.startswith("local") and warehouse.startswith(("file:", "/")):
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
    return f"{warehouse.rstrip('/')}/shared"


class _Written(threading.local):
    """Folders that are still there, by the thread that wrote them, so that one run never deletes what another reads."""

    def __init__(self):
        self.paths: list[str] = []


_WRITTEN = _Written()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back.

    The result no longer depends on the tasks that made it, so a lost executor costs at most the
    tasks that were reading it, and values such as row numbers stay what they were.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)
        if path in _WRITTEN.paths:
            _WRITTEN.paths.remove(path)


def forget(df: DataFrame) -> None:
    """Deletes what cut wrote for df, which nothing may read any more."""
    _delete(df.sparkSession, [df.cut_path])


def written() -> int:
    """A mark for tidy: what this thread writes from here on."""
    return len(_WRITTEN.paths)


def tidy(spark: SparkSession, mark: int = 0, keep: DataFrame | None = None) -> None:
    """Deletes what cut has written in this thread since the mark but for one table, once no result that reads it is needed."""
    _delete(spark, [p for p in _WRITTEN.paths[mark:] if keep is None or p != keep.cut_path])


def row_key(df: DataFrame) -> list[Column]:
    """128 bits (k1, k2) that name a row by all its columns; rows alike in every column share them."""

    def parts(name: str, kind: T.DataType) -> list[Column]:
        col = F.col(f"`{name}`")
        if "map" in kind.simpleString():
            col = F.to_json(F.struct(col))
        return [col.isNull(), col]  # null has no hash of its own

    every = [p for f in df.schema.fields for p in parts(f.name, f.dataType)]
    return [F.xxhash64(*every).alias("k1"), F.xxhash64(F.lit(1), *every).alias("k2")]


def rows_with(docs: DataFrame, decided: DataFrame, total: str) -> DataFrame:
    """(doc: struct of docs' columns, total) of the rows whose key decided (k1, k2, total) holds: rows alike are one.

    Where no row repeats this is one join. Else those that do are joined apart, one of each kind
    picked in two phases, so that a row which is there very often is never gathered.
    """
    every = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *row_key(docs))
    out = every.join(decided.where("many = 1").select("k1", "k2", total), ["k1", "k2"])
    again = decided.where("many > 1")
    if not again.isEmpty():
        out = out.unionByName(every.join(again.select("k1", "k2", total), ["k1", "k2"]).dropDuplicates(["k1", "k2"]))
    return out.select("doc", total)


def word_count(text: Column) -> Column:
    """Number of words (long); null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(True))
