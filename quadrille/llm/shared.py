"""What several operators need: the shared folder, staged tables, checked broadcasts, draws by hash, free names, texts cut by a pattern."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a table that may be broadcast.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session's spark.checkpoint.dir names it.

    Only a local session (one machine, as in tests) may go without the setting.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "/tmp/checkpoints/quadrille"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _width(column: Column, kind: T.DataType) -> Column:
    """Bytes of a value, about as a hashed relation holds it."""
    if isinstance(kind, T.StringType):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        each = F.aggregate(F.coalesce(column, F.array().cast(kind)), F.lit(0).cast("bigint"), lambda n, x: n + _width(x, kind.elementType)) if isinstance(kind.elementType, (T.StringType, T.ArrayType, T.StructType)) else F.coalesce(F.size(column), F.lit(0)) * 8
        return each + 16
    if isinstance(kind, T.StructType):
        return sum((_width(column[f.name], f.dataType) for f in kind.fields), F.lit(16))
    return F.lit(8)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if its rows are measured to take at most `limit` bytes, else as it is: then a shuffle joins it.

    The measure is one aggregate over df, so df should be staged or cheap.
    """
    width = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16))
    return F.broadcast(df) if (df.agg(F.sum(width.cast("bigint")).alias("n")).first()["n"] or 0) <= limit else df


def drawn(share: Column | float, *columns: str) -> Column:
    """Whether a row is in a sample of the given share, by a hash of its columns: of any row count, as shares need not be whole parts of a million."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53)) < share


def fresh(df: DataFrame, name: str) -> str:
    """The first of name, _name, __name ... that is no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


_HELD: dict[str, Callable[[], None]] = {}


def holding(name: str, forget: Callable[[], None] | None = None) -> None:
    """Says in a worker which operator's task begins: what other operators' tasks have left in its memory is forgotten and given back.

    forget: drops what this operator remembers between tasks.
    """
    others = [k for k in _HELD if k != name]
    for other in others:
        _HELD.pop(other)()
    if others:
        gc.collect()
        if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # of the GNU library
            trim(0)
    if forget:
        _HELD[name] = forget


#: Spark's own bound on the bytes of a batch that goes to a Python worker and back, and the one that tasks over whole texts get.
USUAL_BATCH, BATCH = 64 << 20, 4 << 20


def modest(df: DataFrame) -> DataFrame:
    """df, after its session's batches for Python workers are made small, unless they have a size of the user's choice: texts are long, and each batch is held on both sides."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    if conf.get(key).removesuffix("b") == str(USUAL_BATCH):
        conf.set(key, str(BATCH))
    return df


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Stands around finds while a text is cut; a text that holds it is searched twice instead.
MARK = "\ue000"


def cut(text: Column, pattern: str) -> Column:
    """A text cut so that every second piece is a find of the pattern; null for a null text."""
    marked = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK)
    twice = F.flatten(F.zip_with(F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, m: F.array(p, m)))
    return F.when(text.contains(MARK), F.filter(twice, lambda p: p.isNotNull())).otherwise(marked)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
