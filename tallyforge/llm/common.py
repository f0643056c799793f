"""Helpers shared by the corpus operators: reading, staging and text expressions."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The six white space characters that part words, as a regex class body.
SPACE = r"\x20\x09-\x0D"
KELVIN = "K"

_made: list[tuple[SparkSession, str]] = []
_tables: list[tuple[SparkSession, str]] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The whole table; any path that Spark can read will do."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the cluster's own spark.checkpoint.dir. Only where that is unset, and
    only on a local master, a temporary folder takes its place.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    at = f"file://{tempfile.mkdtemp(prefix='tallyforge-')}"
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def _delete(spark: SparkSession, at: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(at)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def _clean() -> None:
    for spark, name in _tables:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        except Exception:  # the session may be gone already
            break
    for spark, at in _made:
        try:
            _delete(spark, at)
        except Exception:  # the session may be gone already
            return


atexit.register(_clean)

#: Lets Spark remove a query's shuffle files once the query is over.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a result to the shared folder once and read it back.

    This cuts the lineage as checkpoint() does, but in a columnar form of which
    later steps read only the columns they need. What was shuffled for it is
    removed at once. The files go with ``release`` or when the application ends.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, at))
    with _cleaned(spark):
        df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._staged_at = at
    return out


@contextmanager
def _cleaned(spark: SparkSession):
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Like ``staged``, as a table in buckets by ``key``: joins by it with tables dealt to as many partitions do not shuffle this one."""
    spark = df.sparkSession
    unique = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    at = f"{shared_dir(spark)}/{unique}"
    _made.append((spark, at))
    with _cleaned(spark):
        df.write.format("parquet").bucketBy(buckets, key).option("path", at).saveAsTable(unique)
    _tables.append((spark, unique))
    return spark.table(unique)


def release(*tables: DataFrame) -> None:
    """Removes staged tables that no later step reads."""
    for df in tables:
        at = getattr(df, "_staged_at", None)
        if at is not None:
            _made.remove((df.sparkSession, at))
            _delete(df.sparkSession, at)
            df._staged_at = None


def staged_alone(make, name: str) -> DataFrame:
    """What ``make`` returns, staged; the tables that were staged for it alone are removed."""
    before = len(_made)
    out = staged(make(), name)
    for spark, at in _made[before:]:
        if at != out._staged_at:
            _delete(spark, at)
    _made[before:] = [x for x in _made[before:] if x[1] == out._staged_at]
    return out


#: A table of at most so many rows is broadcast where its rows are narrow.
SMALL_ROWS = 10_000


def few(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """The narrow table for a broadcast where a count shows it to be small, else as it is for a join by key."""
    return F.broadcast(df) if df.count() <= most else df


def without(docs: DataFrame, judged: DataFrame, most: int = 200_000) -> DataFrame:
    """The rows of ``docs`` but those whose doc_id no row of ``judged`` keeps. A null doc_id is an id like any other."""
    gone = judged.groupBy("doc_id").agg(F.max("kept").alias("any")).filter("not any").select(F.col("doc_id").alias("__id"))
    gone = few(staged(gone, "gone"), most)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__id"]), "left_anti")


def most_common(df: DataFrame, count: str, most: int) -> tuple[DataFrame, DataFrame]:
    """The rows with the highest counts, at most ``most`` of them, and all others.

    The cut is found from a histogram of the counts' logarithms, about a thousand
    rows whatever the table's size, so no task sorts or sends more than it holds
    of the rows above the cut. Rows within the cut's last step go to the others.
    """
    level = F.floor(F.log2(F.col(count)) * 16)
    steps = sorted(((r[0], r[1]) for r in df.groupBy(level.alias("level")).count().collect()), reverse=True)
    total, cut = 0, math.inf
    for at, n in steps:
        total += n
        if total > most:
            break
        cut = at
    high = F.lit(False) if cut == math.inf else level >= F.lit(cut)
    return df.filter(high), df.filter(~high)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Null stays null.

    lower() is exact and quick on texts of one byte a character; other texts
    take the slower translate().
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def words(text: Column, separators: str = SPACE) -> Column:
    """The runs of characters other than the separators, in order; none for a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{separators}]+"), "")


#: Code points of text on either side that a match carries along.
CONTEXT = 16


def _parts(piece: Column, found: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.when(piece.isNotNull(), F.size(found) - 1)),
        lambda i: F.struct(
            F.length(F.get(piece, i)).alias("gap"),
            F.get(found, i).alias("body"),
            F.right(F.get(piece, i), F.lit(CONTEXT)).alias("before"),
            F.left(F.get(piece, i + 1), F.lit(CONTEXT)).alias("after"),
        ),
    )


def with_parts(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Adds, for each kind, what the places of its matches are summed from.

    Spark has no function for match offsets. The pieces between the matches are
    split off with the same pattern; a running sum over pieces and matches gives
    the places (see ``places``). A column is null where nothing matched, so the
    second pass over a text is made only where it is needed. No pattern may match
    the empty string.
    """
    df = df.withColumns({f"found_{k}": F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)) for k, p in patterns.items()})
    df = df.withColumns({f"pieces_{k}": F.when(F.size(f"found_{k}") > 0, F.split(F.col(text), p, -1)) for k, p in patterns.items()})
    parts = {f"parts_{k}": _parts(F.col(f"pieces_{k}"), F.col(f"found_{k}")) for k in patterns}
    return df.withColumns(parts).drop(*[f"{x}_{k}" for k in patterns for x in ("found", "pieces")])


def word_count(text: Column) -> Column:
    """The number of runs of characters that are no white space; 0 for a null."""
    return F.size(words(text)).cast("long")


def places(parts: DataFrame, keys: list[str], kinds: list[str]) -> DataFrame:
    """A row for each match: the keys, ``kind``, ``start``, ``end`` (code points, end exclusive), ``body``, ``before``, ``after``.

    The running sum is a window over the matches of one kind in one text, so its
    groups are bounded by a text and the work is linear but for a sort.
    """
    lists = F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"parts_{k}").alias("parts")) for k in kinds]), lambda x: x["parts"].isNotNull())
    each = parts.select(*keys, F.explode(lists).alias("x")).select(*keys, "x.kind", F.posexplode("x.parts").alias("nth", "part"))
    order = W.partitionBy(*keys, "kind").orderBy("nth").rowsBetween(W.unboundedPreceding, 0)
    body = F.col("part.body")
    end = F.sum(F.col("part.gap") + F.length(body)).over(order)
    each = each.withColumn("end", end)
    return each.select(*keys, "kind", (F.col("end") - F.length(body)).alias("start"), "end", "part.body", "part.before", "part.after")


def joined(spans: Column) -> Column:
    """kind:start:end of an array of structs, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
