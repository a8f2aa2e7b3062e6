"""What the corpus operators share: words, scratch tables in the cluster's shared folder, Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from terraloom.operators.scratch import Scratch  # noqa: F401

#: Words are runs of anything but space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, in any case of letters, from the given ones."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 250) -> Iterator[pa.RecordBatch]:
    """Parts of at most so many rows of each batch, as texts can be long and what is made of them takes many times their
    bytes. Spark bounds a batch itself by bytes; no setting of the session is changed."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def words_of(text: str | None) -> list[bytes]:
    """The words as UTF-8; bytes.split() splits at exactly the six white-space bytes of WORD."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


class _Known(dict):
    """Hashes by word, made where they are missed."""

    def __init__(self, digest):
        super().__init__()
        self.digest = digest

    def __missing__(self, word: bytes) -> int:
        value = self[word] = self.digest(word)
        return value


class WordHash:
    """64-bit hashes of words, kept in a table of bounded size; the bound changes only the speed."""

    def __init__(self, limit: int = 100_000):
        import xxhash

        self.limit = limit
        self.known = _Known(xxhash.xxh3_64_intdigest)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.limit:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of runs of k words; with fewer words, of the whole sequence; none without words."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    return np.unique(runs(hashes, min(k, n)))


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words, by position of the first."""
    n = max(0, len(hashes) - k + 1)
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = mix(h + hashes[j : j + n] * np.uint64(0x9E3779B97F4A7C15))
    return h


def record_batches(schema: pa.Schema, columns: Iterable) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
