"""Helpers the operators share: inputs, written intermediates, block exchange, word hashing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcases.session import work_dir

U = np.uint64
#: doc_id that stands for null inside the operators; it sorts before every other
NULL_ID = -(2**63)


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows for what runs inside (rows that carry whole documents
    or signatures); the session's own setting holds again afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back. Cuts the lineage without a
    checkpoint on one executor: a lost executor costs a re-read."""
    path = f"{work_dir(df.sparkSession)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def doc_key(id_col: str = "doc_id", text_col: str = "text"):
    """Two columns that tell rows apart inside an operator: the id with null as NULL_ID, and a
    hash of the text, so that rows sharing an id but not the text stay separate."""
    return (F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("did"),
            F.xxhash64(F.col(text_col)).alias("th"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row`` (all columns of the table as one struct, so that none clashes with an operator's own),
    did and th."""
    return docs.select(F.struct("*").alias("row"), *doc_key(id_col, text_col))


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of all texts: one column-pruned pass, one number to the driver."""
    return int(docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0)


def n_blocks(spark: SparkSession, n_bytes: int, per_block: int = 8 << 20) -> int:
    """How many blocks an exchange is dealt into: by the measured bytes, so that a block stays
    about ``per_block`` bytes of text whatever the input, and odd, so that ids with a common
    power of two spread."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-n_bytes // per_block)) | 1


def block_of(did, th, n: int):
    """Block of a document, told by its id and its text's hash (rows that share an id spread); numpy and
    Spark give the same number."""
    if isinstance(did, np.ndarray):
        return (did ^ (did >> 17) ^ th) % n
    return F.pmod(did.bitwiseXOR(F.shiftright(did, 17)).bitwiseXOR(th), F.lit(n)).cast("long")


def slices_of(sizes: Sequence[int], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of at most ``limit`` bytes together (a larger row is alone): the
    working arrays of a task stay bounded, whole texts stay whole."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def slices(texts: list[bytes | None], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """``slices_of`` for texts."""
    return slices_of([len(t) if t else 0 for t in texts], limit)


def arrow_batches(fn: Callable, it: Iterator[pa.RecordBatch], schema: pa.Schema):
    """Run ``fn`` (columns of a batch -> dict of columns) over the batches of a partition."""
    for batch in it:
        out = fn(batch)
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in schema],
                                             schema=schema)


def binary_list(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(np.int64)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (ASCII white space separates them), one after the other, and where each
    text's words begin and end; null texts have none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    real = pc.greater(pc.binary_length(flat), 0)        # outer white space leaves empty pieces
    kept = np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))
    return flat.filter(real), kept[offsets]


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, one after the other, and the number of words of each text; each
    different word is hashed once."""
    flat, bounds = split_words(pa.array(texts, pa.binary()))
    coded = flat.dictionary_encode()
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return known[coded.indices.to_numpy()], np.diff(bounds)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads each bit of a 64-bit value over all (wrapping arithmetic)."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    x *= U(0x9FB21C651E98DF25)
    x ^= x >> U(32)
    return x


def pair_hash(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """Hash of the ordered pair (a, b)."""
    return mix(a * U(0xC2B2AE3D27D4EB4F) + mix(b + U(salt)))


def windows_hash(h: np.ndarray, width: int, salt: int = 1) -> np.ndarray:
    """Hash of every ``width`` consecutive values, by doubling: a window of 2n is the pair of
    its halves, so a width costs its number of binary digits, not its length."""
    out, done, power, size, n = None, 0, h, 1, len(h)
    left = width
    if n < width:
        return np.zeros(0, np.uint64)
    while left:
        if left & 1:
            if out is None:
                out = power
            else:
                m = n - (done + size) + 1
                out = pair_hash(out[:m], power[done:done + m], salt + size)
            done += size
        left >>= 1
        if left:
            m = n - 2 * size + 1
            power = pair_hash(power[:m], power[size:size + m], salt + 7 * size)
            size *= 2
    return out[:n - width + 1]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    size, cur = 1, x
    while size * 2 <= width:
        cur = np.minimum(cur[:-size], cur[size:])
        size *= 2
    rest = width - size
    return np.minimum(cur[:len(cur) - rest], cur[rest:]) if rest else cur


_packer = zstandard.ZstdCompressor(level=1)
_unpacker = zstandard.ZstdDecompressor()


def pack(x: np.ndarray) -> bytes:
    return _packer.compress(x.tobytes())


def unpack(x: bytes, dtype) -> np.ndarray:
    return np.frombuffer(_unpacker.decompress(x), dtype)


def runs(x: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal neighbours."""
    if not len(x):
        return []
    cut = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    return list(zip(cut.tolist(), np.append(cut[1:], len(x)).tolist(), strict=True))


def least_pieces(pieces: np.ndarray, n_windows: int, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least piece of every window, and the mask of pieces that are least in some window.

    ``pieces``: hash of the piece at every offset; a window at offset i holds the pieces from i to
    ``i + len(pieces) - n_windows``; ``valid`` marks the windows to look at (within a document).
    Equal windows select the same pieces of theirs."""
    span = len(pieces) - n_windows + 1
    keys = sliding_min(pieces, span)
    pad = np.zeros(span - 1, np.uint64)
    top = ~sliding_min(~np.concatenate([pad, np.where(valid, keys, U(0)), pad]), span)
    return keys, top == pieces
