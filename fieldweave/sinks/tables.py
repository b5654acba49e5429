"""Write modes: overwrite by partition, upserts, ledgers and manifests. A table is written whole beside the old one and then takes its place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

Names = Sequence[str]


def same_key(a: DataFrame, b: DataFrame, keys: Names) -> Column:
    """Equality of keys in which nulls are equal, so that rows with a null in their key are replaced and not doubled."""
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def last_wins(df: DataFrame, keys: Names, *order: str) -> DataFrame:
    """The last row of each key, nulls in keys equal to each other."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upserted(old: DataFrame, new: DataFrame, keys: Names) -> DataFrame:
    """All new rows, and the old ones whose key is not among them."""
    return old.join(new, same_key(old, new, keys), "left_anti").unionByName(new, allowMissingColumns=True)


def inserted_or_ignored(old: DataFrame, new: DataFrame, keys: Names) -> DataFrame:
    """All old rows, and the new ones whose key is not among them."""
    return old.unionByName(new.join(old, same_key(new, old, keys), "left_anti"), allowMissingColumns=True)


def upserted_filling(old: DataFrame, new: DataFrame, keys: Names, always: Names = ()) -> DataFrame:
    """As an upsert in which a null does not replace a value, but for the columns that are always replaced."""
    a, b = old.alias("o").withColumn("_o", F.lit(True)), new.alias("n").withColumn("_n", F.lit(True))
    both = a.join(b, same_key(old, new, keys), "full")
    out = []
    for c in old.columns:
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        out.append((F.when(F.col("_n"), n).otherwise(o) if c in always else F.coalesce(n, o)).alias(c))
    return both.select(*out)


def replaced_groups(old: DataFrame, new: DataFrame, group: Names) -> DataFrame:
    """Old rows of all groups but those that new has, and all new rows: delete, then insert."""
    groups = new.select(*group).distinct()
    return old.join(groups, same_key(old, groups, group), "left_anti").unionByName(new)


def next_revision(df: DataFrame, revision: str) -> int:
    return df.agg(F.coalesce(F.max(revision), F.lit(0)) + 1).first()[0]


def appended_to_ledger(ledger: DataFrame, new: DataFrame, id: str = "artifact_id") -> DataFrame:
    """New rows at the end of a ledger of this schema, with ids after its greatest; new has a column `entry` that orders it."""
    from ..operators.ranks import ranked

    first = ledger.agg(F.coalesce(F.max(id), F.lit(0))).first()[0]
    numbered = ranked(new.drop(id), [], [F.col("entry")], rank=id, size="_all").withColumn(id, F.col(id) + F.lit(first + 1)).drop("entry", "_all")
    return ledger.unionByName(numbered, allowMissingColumns=True)


def overwrite(df: DataFrame, path: str, by: Names = ()) -> None:
    """The whole table, or with `by` only the partitions that df has."""
    writer = df.write.mode("overwrite")
    if by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*by)
    writer.parquet(path)


def _take_place(spark: SparkSession, path: str) -> None:
    """The folder path.partial becomes path. The old one waits as path.old until then, so that a crash between loses neither."""
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    here, new, old = (Path(path + end) for end in ("", ".partial", ".old"))
    store = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(here):
        store.delete(old, True)
        if not store.rename(here, old):
            raise OSError(f"could not move {path}")
    if not store.rename(new, here):
        if store.exists(old):
            store.rename(old, here)
        raise OSError(f"could not move {path}.partial")
    store.delete(old, True)


def swap_in(df: DataFrame, path: str) -> None:
    """Writes df next to path, then puts it there: also for a df that reads from path."""
    df.write.mode("overwrite").parquet(f"{path}.partial")
    _take_place(df.sparkSession, path)


def upsert_manifest(spark: SparkSession, path: str, new: DataFrame, keys: Names) -> None:
    """JSON lines in which new rows replace those of the same keys."""
    try:
        old = spark.read.schema(new.schema).json(path)
        merged = upserted(old, new, keys)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        merged = new
    merged.write.mode("overwrite").json(f"{path}.partial")
    _take_place(spark, path)


def write_nonempty_manifest(df: DataFrame, path: str) -> None:
    if df.isEmpty():
        raise ValueError("a manifest needs a row")
    df.write.mode("overwrite").json(path)


def report_json(df: DataFrame) -> DataFrame:
    """One JSON text for each row, without NaN."""
    clean = [F.nanvl(F.col(n), F.lit(None).cast(t)).alias(n) if t in ("double", "float") else F.col(n) for n, t in df.dtypes]
    return df.select(F.to_json(F.struct(*clean)).alias("json"))


def records(df: DataFrame, most: int) -> list[Row]:
    """At most so many rows, for an answer to one request."""
    if most < 1:
        raise ValueError("the limit must be 1 or more")
    return df.limit(most).collect()


def require_outside(path: str, forbidden: Sequence[str]) -> str:
    """Refuses to write private results below any of the folders named."""
    if any(path == f or path.startswith(f.rstrip("/") + "/") for f in forbidden):
        raise ValueError(f"private results must not go to {path}")
    return path
