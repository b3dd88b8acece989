"""What the training-data operators share: reading, words, cutting lineage, small expression helpers."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a Java regular expression.
SPACES = r"[\x20\x09-\x0D]+"
#: Rows that a Python worker gets at once.
BATCH, BATCH_BYTES = 512, 16 << 20
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input. Python tasks get few rows at once, so long texts stay within a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local master gets one of its own; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if found:
        return found
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="folioscope-")


def gone_at_end(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def free(spark: SparkSession) -> None:
    """Lets go of shuffle files of finished steps.

    Spark drops them only when the driver collects its garbage, which a driver with little to do puts off while
    executors' disks fill.
    """
    gc.collect()
    spark._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared folder: a lost executor costs no recomputation."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
        # the folder that Spark made there for this application goes when the driver's JVM ends
        gone_at_end(spark, spark.sparkContext._jsc.sc().getCheckpointDir().get())
    out = df.checkpoint(eager=True)
    free(spark)
    return out


def keep(df: DataFrame) -> DataFrame:
    """As cut, for large rows: a Parquet table in the shared folder, read by column. It goes when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/folioscope-{uuid.uuid4().hex}"
    df.write.parquet(path)
    gone_at_end(spark, path)
    free(spark)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row, whatever the optimizer merges."""
    return F.element_at(F.transform(F.array(value), body), 1)


def boxed(docs: DataFrame, **keys: Column) -> DataFrame:
    """Whole rows in one column `row`, beside keys, so that no column of docs can clash with a name of ours. `row.*` opens them."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in keys.items()])


def has_any(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def words(text: Column) -> Column:
    """The words of a text, split at ASCII white space; none for null. Texts with single spaces and line ends need no regular expression."""

    def single(t: Column) -> Column:
        return F.trim(F.when(has_any(t, ["  ", "\t", "\x0b", "\f", "\r"]), F.regexp_replace(t, SPACES, " ")).otherwise(t))

    none = F.array().cast("array<string>")
    return let(single(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" "))), lambda t: F.when(t == "", none).otherwise(F.split(t, " ")))


def plain_lines(text: Column) -> Column:
    """The lines of a text in lower case, trimmed, inner white space as one space."""
    t = F.lower(F.coalesce(text, F.lit("")))
    odd = ["  ", " \n", "\n ", "\t", "\x0b", "\f", "\r"]
    tidy = let(t, lambda t: F.when(has_any(t, odd), F.regexp_replace(F.regexp_replace(t, r"[\x20\x09\x0B-\x0D]+", " "), " ?\n ?", "\n")).otherwise(t))
    return F.split(F.trim(tidy), "\n")


def n_chars(text: Column, of: str) -> Column:
    """How many of the characters of a text are among those of `of`, which are ASCII."""
    left = text
    for c in of:
        left = F.replace(left, F.lit(c), F.lit(""))
    return F.octet_length(text) - F.octet_length(left)
