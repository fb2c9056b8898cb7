"""Helpers that several corpus operators share."""

from __future__ import annotations

import json
import re
import tempfile
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space that separates words, as a character class body and as characters.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset and Spark runs in this process only (tests, a laptop) a local folder is made and set; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="heddle-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null, empty and blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE_CLASS}]+"))


def keep(df: DataFrame, condition: Column | str) -> DataFrame:
    """Rows that meet a condition on computed columns, judged after these are computed.

    A plain filter would move below them and compute their expressions again, inside lambdas even once an
    element; a column that isn't deterministic holds it back."""
    condition = F.expr(condition) if isinstance(condition, str) else condition
    return df.withColumn("__at", F.monotonically_increasing_id()).where(condition & (F.col("__at") >= 0)).drop("__at")


def carried(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns beside ``__row``, which holds a whole row: whatever names its columns have, nothing computed meanwhile replaces them."""
    return docs.select(*needed, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"))


def double_array(values: Iterable[float]) -> Column:
    """One constant array column; the optimizer folds it, so a long list stays one expression."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def ordered_parts(df: DataFrame, keys: Sequence[str], payload: Sequence[str], before: int = 0, after: int = 1, per_partition: int = 4) -> tuple[DataFrame, str]:
    """Deal rows into parts by ranges of ``keys`` and sort them, each part with its neighbours' edge rows.

    ``keys`` tell rows apart; rows that agree in all of them are copies of each other and stay in one part. Split keys come
    from a sample of distinct keys, whose size follows the number of shuffle partitions, never the input. Returned rows have
    ``part`` and ``halo`` (-1: the last row of the part before, 1: the first row of the part after, 0: the part's own), so
    that a pass over a part sees every row beside its true neighbours. One shuffle, with as many parts in each task; any
    part may be streamed.
    """
    spark = df.sparkSession
    n = shuffle_partitions(spark) * per_partition
    light = df.select(*keys)
    total = light.count()
    order = F.struct(*keys)
    rate = min(1.0, 16.0 * n / max(total, 1))
    hashed = F.pmod(F.xxhash64(*keys), F.lit(1_000_003)) < int(rate * 1_000_003) + 1
    sample = [r[0] for r in light.where(hashed).select(order.alias("k")).distinct().orderBy("k").collect()]  # a key once, however often it repeats
    splits = list(dict.fromkeys(sample[i * len(sample) // n] for i in range(1, n))) if sample else []  # in Spark's order
    kind = T.StructType([T.StructField(k, df.schema[k].dataType) for k in keys])
    bounds = F.from_json(F.lit(json.dumps([dict(zip(keys, s, strict=True)) for s in splits])), T.ArrayType(kind))  # one constant
    part = _bisect(bounds, keys, len(splits))
    edges = light.select(part.alias("part"), order.alias("k")).groupBy("part").agg(F.min("k").alias("first"), F.max("k").alias("last")).orderBy("part").collect()
    spread: dict[tuple, list[tuple[int, int]]] = {}
    for i, e in enumerate(edges):
        if after and i:
            spread.setdefault(tuple(e["first"]), []).append((edges[i - 1]["part"], 1))
        if before and i + 1 < len(edges):
            spread.setdefault(tuple(e["last"]), []).append((edges[i + 1]["part"], -1))
    to = T.ArrayType(T.StructType([T.StructField("part", T.IntegerType()), T.StructField("halo", T.IntegerType())]))
    halo = spark.createDataFrame([(*k, v) for k, v in spread.items()], T.StructType([*kind.fields, T.StructField("to", to)]))
    base = df.select(*dict.fromkeys([*keys, *payload])).alias("a")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys])
    own = F.array(F.struct(F.col("__p").alias("part"), F.lit(0).alias("halo")))
    met = base.withColumn("__p", part).alias("a").join(F.broadcast(halo).alias("h"), same, "left")  # two rows a part at most
    dealt = met.select("a.*", F.explode_outer(F.concat(own, F.coalesce("h.to", F.array().cast(to)))).alias("__t")).select("*", "__t.part", "__t.halo").drop("__p", "__t")
    tasks = shuffle_partitions(spark)
    return dealt.repartitionById(tasks, F.pmod("part", F.lit(tasks))).sortWithinPartitions("part", *keys), "part"


def _bisect(array: Column, keys: Sequence[str], n: int) -> Column:
    """How many entries of a sorted array of ``n`` key structs are not above the row's key: a binary search of log2(n) steps."""
    if not n:
        return F.lit(0)
    steps = F.lit([1 << b for b in reversed(range(n.bit_length()))])
    key = F.struct(*keys)
    fits = lambda at: (at <= n) & (F.get(array, at - 1) <= key)
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(fits(at + s), at + s).otherwise(at))
