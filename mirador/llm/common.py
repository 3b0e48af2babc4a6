"""What the corpus operators share: scratch tables, tokens, row identities, running sums."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import weakref
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values of the contracts: a word is a run of characters outside these six.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_scratch: dict[str, str] = {}
_watched: dict[str, object] = {}
_written: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def scratch_root(spark: SparkSession) -> str:
    """The folder for tables that cut lineage: below spark.checkpoint.dir, or else the context's checkpoint folder; all executors share it.

    Only where neither is set and the master is local (tests, a laptop) a folder of this machine is set up for the session.
    """
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not root:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise RuntimeError("a cluster needs a shared folder: set spark.checkpoint.dir")
            root = "file://" + tempfile.mkdtemp(prefix="mirador-")
            spark.sparkContext.setCheckpointDir(root)
        _scratch[app] = f"{root.rstrip('/')}/mirador-{app}"
        atexit.register(_clear, spark, _scratch[app])
    return _scratch[app]


def _clear(spark: SparkSession, path: str) -> None:
    """Best effort: a session that is already gone keeps its scratch folder."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the JVM may have ended before this process
        return


#: How scratch tables are written: Spark drops the shuffle files of a write as soon as it is done, for what is written no longer needs
#: them; and what goes to Python goes in small batches, so that neither side holds large buffers.
_LEAN = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


@contextlib.contextmanager
def _lean(spark: SparkSession) -> Iterator[None]:
    was = {k: spark.conf.get(k, None) for k in _LEAN}
    for k, v in _LEAN.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialise(df: DataFrame) -> DataFrame:
    """Write df once to the shared scratch folder and read it back: a lost executor costs a reread, not a rerun.

    The files go when no plan in the driver refers to them any more and the JVM has noticed, or with discard().
    """
    spark = df.sparkSession
    _sweep(spark)
    path = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    with _lean(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    # every plan over this table holds its list of files
    files = out._jdf.queryExecution().analyzed().relation().location()
    _watched[path] = spark.sparkContext._jvm.java.lang.ref.WeakReference(files)
    _written[out] = path
    return out


def discard(*written: DataFrame) -> None:
    """Deletes the files of tables from materialise() that nothing reads any more."""
    for df in written:
        if path := _written.pop(df, None):
            _watched.pop(path, None)
            _clear(df.sparkSession, path)


def _sweep(spark: SparkSession) -> None:
    """Deletes the tables whose list of files the JVM has collected."""
    here = _scratch.get(spark.sparkContext.applicationId, "")
    for path, files in list(_watched.items()):
        if not here or not path.startswith(here):
            del _watched[path]  # of a session that has ended
        elif files.refersTo(None):
            del _watched[path]
            _clear(spark, path)


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many _ before it as it takes for no column of df to be called so, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def quoted(name: str) -> str:
    """A column's name as Spark's parser takes it, dots and blanks included."""
    return "`" + name.replace("`", "``") + "`"


def all_of(df: DataFrame) -> list[Column]:
    return [F.col(quoted(c)) for c in df.columns]


def with_row_id(df: DataFrame, name: str = "_rid") -> DataFrame:
    """df, written once, with an id for each row, so that repeated doc_ids stay apart. The name must be free."""
    return materialise(df.withColumn(name, F.monotonically_increasing_id()))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def n_words(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running_start(df: DataFrame, keys: list[str], chunk: str, order: list, value: str, out: str) -> DataFrame:
    """Sum of value over the rows of the same keys that come before, by (chunk, *order).

    Two levels: totals by chunk are summed over chunks, rows only within theirs, so that a key with a third of
    all rows is dealt out over its chunks instead of one task.
    """
    totals = df.groupBy(*keys, chunk).agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_base", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    inside = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(totals, [*keys, chunk])
        .withColumn(out, F.col("_base") + F.col("_inside"))
        .drop("_base", "_inside")
    )
