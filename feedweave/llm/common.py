"""What the training-data operators share: stored intermediates, block assignment and word access."""

from __future__ import annotations

import ctypes
import gc
import pickle
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees, as ``spark.checkpoint.dir`` names it.

    On a cluster the setting is required; only a local master, whose executors are this machine, gets a new local folder.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not path:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
        path = "file://" + tempfile.mkdtemp(prefix="feedweave-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def stored(df: DataFrame, made: list[DataFrame] | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts lineage, survives lost executors, and keeps column pruning.

    The table is noted in ``made``, for ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/feedweave/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if made is not None:
        made.append(out)
    return out


def discard(*tables: DataFrame, shuffles: bool = True) -> None:
    """Deletes tables made by ``stored`` that nothing will read again, and lets Spark drop the shuffle files of finished steps."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if tables and shuffles:  # Spark's cleaner drops the shuffles of plans that were collected
        gc.collect()
        tables[0].sparkSession._jvm.System.gc()


def shared(spark: SparkSession, value):
    """A function that returns a copy of ``value`` on any executor: broadcast, its classes included, as these needn't be installed there."""
    box = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get():
        return pickle.loads(box.value)

    return get


def crc_mod(column: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null ids count as the empty string."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` and ``text`` (null text: empty); all other columns, whatever their names, stay behind."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))


def give_back() -> None:
    """Returns freed memory to the system: Python workers outlive a stage, and what their allocators keep adds up from stage to stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def tidy(run):
    """``run`` over batches, with freed memory given back after each batch and at the end."""

    def tidied(batches):
        try:
            for batch in run(batches):
                yield batch
                give_back()
        finally:
            give_back()

    return tidied


def carried(docs: DataFrame, carry: bool, more: str) -> tuple[DataFrame, str]:
    """The input of a mapInArrow over texts and its output schema: ``doc_id, text``, or the whole row as one struct, so that no name clashes."""
    if not carry:
        return id_and_text(docs), f"doc_id long, {more}"
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))
    return rows, f"row {rows.schema['row'].dataType.simpleString()}, {more}"


def row_texts(batch: pa.RecordBatch) -> list[bytes]:
    """The texts of a batch of ``carried`` rows; null: empty."""
    column = batch["text"] if "text" in batch.schema.names else batch["row"].field("text")
    return byte_texts(pc.fill_null(column.cast(pa.string()), ""))


def byte_texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z: bytes.lower and bytes.split do exactly this."""
    return text.lower().split()


def split_words(texts: list[bytes] | pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` of a batch in a row, A-Z lower-cased if asked, and each text's word count."""
    column = (texts.cast(pa.binary()) if isinstance(texts, pa.Array) else pa.array(texts, pa.binary())).view(pa.string())
    parts = pc.ascii_split_whitespace(pc.ascii_lower(column) if lower else column)
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = parts.flatten().cast(pa.binary())
    some = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # white space at either end leaves empty parts
    if not some.all():
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[some], minlength=len(counts))
        flat = flat.filter(pa.array(some))
    return flat, counts


def flat_words(texts: list[bytes] | pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All lower-cased words of a batch, dictionary-encoded in order of first appearance, and each text's word count."""
    words, counts = split_words(texts)
    return words.dictionary_encode(), counts


def spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the runs that start at ``first`` and are ``sizes`` long, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(first - (ends - sizes), sizes) + np.arange(int(sizes.sum()))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary or string array in a row, and each value's begin and the last one's end."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]] if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def binary_array(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sorted_groups(batches, keys: list[str]):
    """Tables of whole groups from record batches that come sorted by ``keys``: a group cut by a batch's end is held back and joined with the next."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if rest is not None:
            t = pa.concat_tables([rest, t])
        if not t.num_rows:
            continue
        starts = group_starts(t, keys)
        last = int(starts[-1])
        if last:
            yield t.slice(0, last), starts[:-1]
        rest = t.slice(last)
    if rest is not None and rest.num_rows:
        yield rest, np.zeros(1, np.int64)


def group_starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in keys:
        col = t[k].to_numpy()
        new[1:] |= col[1:] != col[:-1]
    return np.flatnonzero(new)


def slices(texts: list[bytes], room: int = 4_000_000):
    """Ranges (i, j) of a batch's texts of about ``room`` bytes, one text at least, so that memory follows the slice."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= room):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


def with_ids(rows: DataFrame, ids: DataFrame, bits: int = 1 << 24) -> DataFrame:
    """The rows whose doc_id is among ``ids(doc_id)``.

    A bitmap of ``bits`` hashed ids, at most bits / 64 rows and so bounded, is broadcast and drops most other rows before the
    exact semi-join shuffles what is left.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    marks = ids.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("mask"))
    near = rows.withColumn("word", F.shiftright(place, 6)).withColumn("bit", place.bitwiseAND(63).cast("int"))
    near = near.join(F.broadcast(marks), "word").where(F.expr("(shiftright(mask, bit) & 1) = 1")).drop("word", "bit", "mask")
    return near.join(ids, "doc_id", "left_semi")
