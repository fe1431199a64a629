"""What the corpus operators share: tables in the cluster's shared folder, and record batches cut to a byte bound."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step of a Python worker handles; a single longer text is handled alone.
STEP_BYTES = 4 << 20


_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``. Where that is unset, a local session gets a temporary folder of its own; on a cluster it is an error."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="framelake-")
    return _LOCAL[app]


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/framelake-{spark.sparkContext.applicationId}"


def settled_at(df: DataFrame, name: str, by: str | None = None) -> tuple[DataFrame, str]:
    """``df`` written once as Parquet into the application's part of the shared folder, in a folder for each value of ``by`` if given, and read again, and the table's path for :func:`let_go`."""
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path), path


def settled(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written once and read again: later uses, retries and lost executors read the same rows."""
    return settled_at(df, name, by)[0]


def let_go(spark: SparkSession, path: str) -> None:
    """Deletes a settled table that nothing reads any more: what was made of it must be settled too."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def clear_settled(spark: SparkSession) -> None:
    """Deletes the tables that this application settled; results that still read them are lost, so write these first."""
    let_go(spark, _own_folder(spark))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores appended where ``df`` has such a column already, in upper or lower case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def own_columns(df: DataFrame) -> list[Column]:
    """All columns of ``df`` by their whole names, dots and all."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns and of where they are null, as Spark's hash passes over nulls; columns with maps are hashed as JSON, in the maps' order."""
    columns = own_columns(df)
    hashed = [F.to_json(F.struct(c.alias("x"))) if "map<" in f.dataType.simpleString() else c for c, f in zip(columns, df.schema, strict=True)]
    return F.xxhash64(*hashed, *(c.isNull() for c in columns))


#: A key with more than this part of all rows is joined by broadcast, so there are fewer such keys than this.
HOT_KEYS = 1000


def spread_join(rows: DataFrame, small: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined by ``key`` with ``small``, one row a key with the number ``n`` of its rows (dropped), so that no key's rows meet in one task.

    Of ``total`` rows at most, fewer than ``HOT_KEYS`` keys can have more than a ``HOT_KEYS``-th; these are broadcast and the others shuffled.
    """
    often = max(100, total // HOT_KEYS)
    hot, others = F.broadcast(small.where(F.col("n") > often).drop("n")), small.where(F.col("n") <= often).drop("n")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(others, key))


def salted_join(rows: DataFrame, small: DataFrame, key: str, total: int) -> DataFrame:
    """As :func:`spread_join`, for rows that cost much to make: they are made once. A frequent key's row is repeated for each of its salts, which its rows take by their hash.

    A key has a salt for each ``HOT_KEYS``-th of ``total`` rows, so salts are at most twice as many as keys and ``HOT_KEYS`` together.
    """
    salt, salts = free_names(rows, "salt", "salts")
    often = max(100, total // HOT_KEYS)
    dealt = small.withColumn(salts, F.ceil(F.col("n") / often).cast("int")).drop("n")
    hot = F.broadcast(dealt.where(F.col(salts) > 1).select(key, salts))  # fewer than HOT_KEYS
    salted = rows.join(hot, key, "left").withColumn(salt, F.pmod(F.xxhash64(*own_columns(rows)), F.coalesce(salts, F.lit(1))).cast("int")).drop(salts)
    each = dealt.withColumn(salt, F.explode(F.sequence(F.lit(0), F.greatest(F.col(salts), F.lit(1)) - 1))).drop(salts)
    return salted.join(each, [key, salt]).drop(salt)


#: Bits of a bitmap of hashes that prefilters rows before an exact join: 2 MB, where the number of hashes isn't told.
FILTER_BITS = 1 << 24
#: Bits a hash, where their number is told, as long as the bitmap has no more than so many: 64 MB.
BITS_A_HASH, MOST_FILTER_BITS = 16, 1 << 29


def hash_bitmap(hashes: DataFrame, column: str, n: int = 0) -> Broadcast:
    """A broadcast bitmap of bounded size, larger for ``n`` hashes than for few, with the bits of all hashes in ``column``; built by a map-side aggregation over its words."""
    bits = FILTER_BITS
    while bits < min(BITS_A_HASH * n, MOST_FILTER_BITS):
        bits *= 2
    cells = hashes.selectExpr(f"shiftright(`{column}` & {bits - 1}, 6) cell", f"shiftleft(1L, cast(`{column}` & 63 as int)) bits").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()  # of the bitmap's size at most
    bitmap = np.zeros(bits >> 6, np.uint64)
    bitmap[cells["cell"].to_numpy()] = cells["bits"].to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(bitmap)


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be among those of the bitmap: all that are, and few others as long as they are fewer than its bits."""
    bit = hashes.astype(np.uint64, copy=False) & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) > 0


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without copying them, and each row's offsets into these; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Record batches cut so that the texts of each hold ``most`` bytes at most (or one row): (rows, bytes, offsets from 0)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            first = last
