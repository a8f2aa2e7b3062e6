"""Quality rules: counts of a text and bands of its zstandard ratios, whole and in fixed chunks.

A ratio is bytes over compressed bytes, of the whole text and of each of its chunks, the last and shorter one included. What
is usual depends on the length, so the limits are fitted by length: for every half octave of bytes the quartiles of the log
ratios of all distinct texts that pass the base rule, and fences around them. A text goes if its own ratio is outside the
fences of its length, or if chunks outside those of theirs hold too many of its bytes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Mapping
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, Scratch, sliced, table, texts

SYMBOLS = "#*$%&|<>"
CHUNK_BYTES = 4096
#: A text goes if chunks with this share of its bytes or more are outside their limits.
BAD_SHARE = 0.25
LEVEL = 3
#: Fences are so many times the distance of the quartiles beyond them, and at least LEAST (of the log ratio) off the median.
FENCE = 3.0
LEAST = log(1.05)
#: A length class with fewer pieces takes the fences of the nearest class that has them.
PIECES = 50
#: Width of the bins in which log ratios are counted.
BIN = 0.01
CLASSES = 96
#: Where no class has enough pieces: limits of the ratio from so many bytes on.
DEFAULT = ((0, 0.0, 2.8), (256, 1.25, 2.4), (512, 1.35, 2.6), (1024, 1.4, 2.8), (2048, 1.4, 3.0), (4096, 1.45, 3.2), (16384, 1.5, 3.5), (65536, 1.5, 4.0))
#: Pieces shorter than this are not judged: the frame of the compressed form outweighs them.
SHORTEST = 64

Limits = Mapping[int, tuple[float, float]]


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in WHITE)
    symbols = sum(text.count(c) for c in SYMBOLS)
    seen: set[str] = set()
    dup_lines = 0
    for line in text.split("\n"):
        if line in seen:
            dup_lines += 1
        elif line.strip(WHITE):
            seen.add(line)
    return n, chars, symbols, dup_lines, repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three that are found twice or more, by numbers of the words, so without collisions."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    k = len(number)
    if k < 2_000_000:
        windows = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    else:  # the product could pass 63 bits
        windows = np.unique(np.unique(ids[:-2] * k + ids[1:-1], return_inverse=True)[1] * k + ids[2:], return_inverse=True)[1]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    repeated = np.zeros(n - 2, bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for j in range(3):
        covered[j : j + n - 2] |= repeated
    return int(covered.sum())


def length_class(size: int) -> int:
    """Half octaves of a number of bytes."""
    return min(CLASSES - 1, int(2 * log(size, 2) + 1e-9)) if size > 0 else 0


class Compression:
    """Ratios of texts; not picklable, so it is made in the task."""

    def __init__(self, level: int = LEVEL, chunk_bytes: int = CHUNK_BYTES):
        import zstandard

        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.chunk_bytes = chunk_bytes

    def ratio(self, data: bytes) -> float:
        return len(data) / len(self.compress(data)) if data else 0.0

    def __call__(self, text: str | None) -> tuple[int, float, list[float]]:
        """Bytes, the whole text's ratio, and those of its chunks, if it has more than one."""
        data = (text or "").encode("utf-8", "surrogatepass")
        size = self.chunk_bytes
        chunks = [self.ratio(data[i : i + size]) for i in range(0, len(data), size)] if len(data) > size else []
        return len(data), self.ratio(data), chunks


def measure(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, th, the counts, bytes, ratio and chunks of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = Compression()
        for batch in sliced(batches):
            rows = [(*counts(t), *ratios(t)) for t in texts(batch, "text")]
            kinds = [*[pa.int64()] * 6, pa.float64(), pa.list_(pa.float64())]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["id", "th", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "bytes", "ratio", "chunks"])

    schema = f"id {dict(df.dtypes)[id_col]}, th long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, bytes long, ratio double, chunks array<double>"
    return df.select(df[id_col].alias("id"), F.xxhash64(df[text_col]).alias("th"), df[text_col].alias("text")).mapInArrow(run, schema)


def _class(size):
    return F.least(F.lit(CLASSES - 1), F.floor(2 * F.log2(size.cast("double")) + 1e-9)).cast("int")


def _pieces(chunk_bytes: int):
    """The chunks of a text, or all of it where it has one, as structs of bytes and ratio."""
    size = F.col("bytes")

    def one(ratio, i):
        return F.struct(F.least(F.lit(chunk_bytes).cast("long"), size - i * chunk_bytes).alias("bytes"), ratio.alias("ratio"))

    return F.when(F.size("chunks") > 0, F.transform("chunks", one)).otherwise(F.array(F.struct("bytes", "ratio")))


def fit(measured: DataFrame, base_failed) -> Limits:
    """Limits of the ratio by length class, from all distinct texts that pass the base rule and their chunks.

    What reaches the driver is a count for every class and bin of the log ratio, some thousand rows at any size.
    """
    texts_ = measured.where(~base_failed & (F.col("bytes") >= SHORTEST)).select("th", "bytes", "ratio", "chunks").dropDuplicates(["th"])
    pieces = texts_.select(F.explode(F.concat(_pieces(CHUNK_BYTES), F.when(F.size("chunks") > 0, F.array(F.struct("bytes", "ratio"))).otherwise(F.expr("cast(array() as array<struct<bytes:bigint,ratio:double>>)")))).alias("p"))
    counted = pieces.where(F.col("p.bytes") >= SHORTEST).groupBy(_class(F.col("p.bytes")).alias("class"), F.floor(F.log("p.ratio") / BIN).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for r in counted.collect():
        bins[r["class"]].append((r["bin"], r["n"]))
    limits = {}
    for k, own in bins.items():
        if sum(n for _, n in own) >= PIECES:
            low, middle, high = (_quantile(sorted(own), q) for q in (0.25, 0.5, 0.75))
            wide = FENCE * (high - low)
            limits[k] = exp(min(low - wide, middle - LEAST)), exp(max(high + wide, middle + LEAST))
    return limits


def _quantile(bins: list[tuple[int, int]], share: float) -> float:
    """The quantile of values counted in bins, spread evenly in each."""
    left = share * sum(n for _, n in bins)
    for at, n in bins:
        if left <= n:
            return (at + left / n) * BIN
        left -= n
    return (bins[-1][0] + 1) * BIN


def by_class(limits: Limits) -> list[tuple[float, float]]:
    """The limits of every class: its own, the nearest, or the default ones where there are none."""
    if limits:
        return [limits[min(limits, key=lambda k: (abs(k - c), k))] for c in range(CLASSES)]
    return [[band[1:] for band in DEFAULT if band[0] <= 2 ** ((c + 1) / 2)][-1] for c in range(CLASSES)]


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeat_percent: int = 50, limits: Limits | None = None) -> DataFrame:
    """One row a row of df: its id, the counts, the ratio, the share of its bytes in bad chunks, and the verdicts.

    Limits are fitted on df unless given. A null or empty text has no words and fails the base rule; repeated rows are judged
    one by one and count once in the fit; extra columns are not carried on; an empty table gives no rows. Texts are read
    whole, however long. Measures are written to the shared folder once, as the fit and the verdict both read them.
    """
    scratch = Scratch(df.sparkSession, "quality")
    measured = scratch.write(measure(df, id_col, text_col), "measured")
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    bounds = by_class(fit(measured, base_failed) if limits is None else limits)
    low, high = (F.array(*[F.lit(float(b[i])) for b in bounds]) for i in (0, 1))

    def outside(size, ratio):
        at = _class(size)
        return (size >= SHORTEST) & ~ratio.between(F.get(low, at), F.get(high, at))

    bad = F.aggregate(F.filter(_pieces(CHUNK_BYTES), lambda p: outside(p["bytes"], p["ratio"])), F.lit(0).cast("long"), lambda a, p: a + p["bytes"])
    judged = measured.withColumns({"base_failed": base_failed, "bad_chunks": F.when(F.col("bytes") > 0, bad / F.col("bytes")).otherwise(0.0)})
    kept = ~F.col("base_failed") & ~outside(F.col("bytes"), F.col("ratio")) & (F.col("bad_chunks") < BAD_SHARE)
    return judged.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio", "bad_chunks", "base_failed", kept.alias("kept"))


def op10_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict, by limits fitted on all documents."""
    return quality_rules(table(spark, sf_dir, "documents"))
