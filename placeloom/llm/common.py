"""Shared helpers: tables in the shared folder, skew-safe joins, word patterns."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: A key is hot if it holds at least 1/HOT_PARTS of all rows, so there are at most HOT_PARTS hot keys.
HOT_PARTS = 2000


#: Tables that end with their scratch(), innermost last.
_scratch: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a new local one in local mode (tests); on a cluster this raises."""
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get()


def save(df: DataFrame, name: str, codec: str = "snappy", kept: bool = False) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: the lineage ends here, and a lost executor loses nothing.

    Within scratch() the table is deleted at its end, unless kept."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    if _scratch and not kept:
        _scratch[-1].append(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Tables saved inside are deleted at the end; what is computed from them has to be written (kept) by then."""
    _scratch.append([])
    try:
        yield
    finally:
        conf = spark._jsc.hadoopConfiguration()
        for path in map(spark._jvm.org.apache.hadoop.fs.Path, _scratch.pop()):
            path.getFileSystem(conf).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that df does not have."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Texts of ASCII letters go the short way."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


#: Tables of so many rows at most (ids and digests) are broadcast.
SMALL_ROWS = 500_000


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """df, broadcast if it has `most` rows or fewer; df has to be written, as it is counted."""
    return F.broadcast(df) if df.count() <= most else df


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once for a row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def attach(rows: DataFrame, classes: DataFrame, keys: list[str], n: str, total: int, spread: Column, parts: int = HOT_PARTS) -> DataFrame:
    """rows LEFT JOIN classes USING (keys), without piling a hot key's rows up in one task.

    classes has one row per key with its number of rows n; total is the number of rows. Keys with
    n >= total / parts are at most `parts` and are broadcast; a row with such a key takes part in
    the shuffled join under a salt (spread) that matches nothing, so it is dealt out evenly. Null keys match nothing.
    """
    values = [c for c in classes.columns if c not in keys]
    hot = classes.filter(F.col(n) * parts >= total)
    cold = classes.filter(F.col(n) * parts < total)
    hot = F.broadcast(hot.select(*keys, *[F.col(c).alias(f"__hot_{c}") for c in values]))
    cold = cold.select(*keys, *[F.col(c).alias(f"__cold_{c}") for c in values], F.lit(0).cast("long").alias("__salt"))
    salt = F.when(F.col(f"__hot_{n}").isNotNull(), spread.bitwiseOR(F.lit(1))).otherwise(F.lit(0)).cast("long")
    out = rows.join(hot, keys, "left").withColumn("__salt", salt).join(cold, [*keys, "__salt"], "left")
    both = [F.coalesce(f"__hot_{c}", f"__cold_{c}").alias(c) for c in values]
    return out.select(*rows.columns, *both)


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def per_process(name: str, make):
    """make(), called once in each Python worker process and kept for its later tasks."""
    kept = sys.modules.setdefault("_placeloom_kept", types.ModuleType("_placeloom_kept")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]


def slices(batch, column: int, most: int = 32 << 20):
    """Parts of an Arrow batch with about `most` bytes of text each, so that very long texts do not add up."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    part = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
