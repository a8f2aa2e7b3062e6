"""Language identification by rank-order profiles of character n-grams and their out-of-place distance."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import sliced, table, texts

UNKNOWN = "und"
PROFILE = 300
#: Profiles are counted on about so many labelled documents of each language at most; all of them where there are fewer.
DOCS_PER_LANGUAGE = 2000
#: Counts of so many labels may be broadcast.
BROADCAST_LABELS = 100_000
_BITS = 21  # of a code point
_MARK = 1  # not a letter, and not 0, so that a mark and a letter are no letter alone
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point whether it is a letter; made once a process."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The text's distinct n-grams of 1 to 3 letters in words with an edge mark on either side, and their counts."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[codes]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    s = np.full(len(codes) + 2, _MARK, np.int64)
    s[1:-1] = np.where(letter, codes, _MARK)
    s = s[np.append(True, (s[1:] != _MARK) | (s[:-1] != _MARK))]  # one mark between words
    two = (s[:-1] << _BITS) | s[1:]
    three = (two[:-1] << _BITS) | s[2:]
    keys = np.concatenate([s[s != _MARK], two, three[s[1:-1] != _MARK]])
    return np.unique(keys, return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, ties by the n-gram."""
    return keys[np.lexsort((keys, -counts))[:size]]


@dataclass(frozen=True)
class Profiles:
    languages: list[str]
    ranks: dict[str, list[int]]
    size: int = PROFILE

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """All n-grams, sorted, and for each its rank in every language; `size` where it has none."""
        keys = np.unique(np.array([k for ks in self.ranks.values() for k in ks], np.int64))
        rank = np.full((len(keys), len(self.languages)), self.size, np.int64)
        for j, name in enumerate(self.languages):
            own = np.array(self.ranks[name], np.int64)
            rank[np.searchsorted(keys, own), j] = np.arange(len(own))
        return keys, rank


class Judge:
    def __init__(self, profiles: Profiles):
        self.languages, self.size = profiles.languages, profiles.size
        self.keys, self.rank = profiles.table()

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """The nearest language, how much nearer than the next (0 to 1), and its distance as a share of the largest (0 to 1)."""
        found, counts = grams(text)
        if not len(found) or not self.languages:
            return UNKNOWN, 0.0, 1.0
        own = ranked(found, counts, self.size)
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        known = self.keys[at] == own
        rank = np.where(known[:, None], self.rank[at], self.size)
        apart = np.where(rank == self.size, self.size, np.abs(rank - np.arange(len(own))[:, None])).sum(0)
        best = int(apart.argmin())
        rest = np.delete(apart, best)
        most = len(own) * self.size
        second = int(rest.min()) if len(rest) else most
        return self.languages[best], float(1 - apart[best] / second) if second else 0.0, float(apart[best] / most)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = PROFILE, docs_per_language: int = DOCS_PER_LANGUAGE) -> Profiles:
    """Profiles from labelled rows; rows with a null language or text teach nothing.

    Of a language with more rows than docs_per_language, those are taken whose hash of the id falls below the share, so
    the same rows at every run. What reaches the driver is `size` n-grams a language.
    """
    spark = labelled.sparkSession
    rows = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    known = counts.count()
    if not known:
        return Profiles([], {}, size)
    chance = F.pmod(F.xxhash64(F.coalesce("id", F.lit(""))), F.lit(1_000_003)) / F.lit(1_000_003.0)
    taken = rows.join(F.broadcast(counts) if known <= BROADCAST_LABELS else counts.hint("merge"), "lang").where(chance < F.lit(float(docs_per_language)) / F.col("n")).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, Counter] = {}
        for batch in sliced(batches):
            for text, name in zip(texts(batch, "text"), texts(batch, "lang")):
                keys, counts = grams(text)
                total = totals.setdefault(name, Counter())
                for k, n in zip(keys.tolist(), counts.tolist()):
                    total[k] += n
        for name, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(total), pa.string()), pa.array(total.keys(), pa.int64()), pa.array(total.values(), pa.int64())], names=["lang", "gram", "n"])

    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    counted = taken.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).select("lang", "gram", "rank").collect()
    ranks: dict[str, list[int]] = {name: [] for name in sorted({r["lang"] for r in top})}
    for r in sorted(top, key=lambda r: (r["lang"], r["rank"])):
        ranks[r["lang"]].append(r["gram"])
    return Profiles(list(ranks), ranks, size)


def identify(df: DataFrame, profiles: Profiles, text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "distance")) -> DataFrame:
    """df with lang_pred, score and distance, or other names, in place of columns of these names.

    A null text or one without a letter is `und` with the score 0 and the distance 1; so is every text if nothing was
    learned. Ties go to the language that sorts first. Repeated rows are judged each; an empty table gives no rows.
    """
    keep = df.drop(*names)
    schema = keep.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(profiles)
        for batch in sliced(batches):
            out = [judge(t) for t in texts(batch, text_col)]
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64())], names=[*batch.schema.names, *names])

    from pyspark.sql import types as T

    full = T.StructType([*schema.fields, *[T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.DoubleType()))]])
    return keep.mapInArrow(run, full)


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0


def op8_rank_order_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, from profiles of the documents whose crc32 of the id leaves a rest by 5."""
    docs = table(spark, sf_dir, "documents")
    profiles = fit(docs.where(~F.coalesce(held_out(), F.lit(True))))
    out = identify(docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text"), profiles)
    return out.select("doc_id", "held_out", "lang_pred", "score", "distance")
