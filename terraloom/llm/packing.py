"""Best-fit packing: a configuration linear program over the histogram of piece lengths.

The fractional packing is found by multiplicative weights: lengths that the chosen patterns cover badly weigh more, and a
knapsack dynamic program over the capacity finds the heaviest pattern. One table of the program gives, for every length, the
heaviest pattern that holds it; those within TOLERANCE of the heaviest of all share a round. Weights over the heaviest
pattern's are a solution of the dual program, so every round also gives a bound from below. The patterns are rounded down, what
is left is solved again, and the rest is packed by best fit into gaps and new sequences; rows take their places by their rank
among the rows of their length. Best fit over the whole histogram is taken instead where it needs fewer sequences.
Only counts by length reach the driver: at most as many as the capacity has tokens.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import ByteBPE, rank_path
from .common import Scratch, sliced, table, texts

CAPACITY = 2048
ROUNDS = 60
#: Patterns in a round weigh at least this much less than the heaviest.
TOLERANCE = 0.01
#: Step of the weights; a round covers the length that it covers most by so much.
STEP = 0.2
#: How often what the rounding leaves is solved again.
SOLVES = 8
#: So many patterns of a solution are rounded, the most used ones, so that the plan has a bound.
PATTERNS = 4096
#: Patterns of the rounded program may leave at most this share of a sequence free; the rounding with the fewest sequences is taken.
SLACKS = (0.005, 0.02, 1.0)
#: Pieces of at most this part of the capacity are kept out of the program, to fill the gaps that its patterns leave.
SAND = 16
END = 0
LONG_TEXT = 500_000


def knapsack(lengths: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The highest worth that fits each capacity from 0 up, copies unbounded, and the length taken last (-1: none)."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1, np.int64)
    first = int(lengths.min())
    at = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(first, capacity + 1):
        best[c] = best[c - 1]
        value = best[c - lengths[: at[c]]] + worth[: at[c]]
        k = int(value.argmax())
        if value[k] > best[c] + 1e-15:
            best[c], took[c] = value[k], k
    return best, took


def _patterns(lengths: np.ndarray, worth: np.ndarray, capacity: int, most: np.ndarray, tolerance: float) -> tuple[float, list[tuple[int, dict[int, int]]]]:
    """The worth of the heaviest pattern, and for every length (by index) the heaviest pattern with it, of those near the heaviest.

    A pattern that takes more copies than there are is cut.
    """
    best, took = knapsack(lengths, worth, capacity)
    down = np.zeros(capacity + 1, np.int64)  # the capacity at which something was taken last
    held = np.flatnonzero(took >= 0)
    if len(held):
        at = np.searchsorted(held, np.arange(capacity + 1), side="right") - 1
        down = np.where(at >= 0, held[np.maximum(at, 0)], 0)
    top = float(best[capacity])
    steps, below, sizes = took.tolist(), down.tolist(), lengths.tolist()
    out = []
    for i in np.flatnonzero(worth + best[capacity - lengths] >= (1 - tolerance) * top).tolist():
        pattern = {i: 1}
        c = below[capacity - sizes[i]]
        while c:
            k = steps[c]
            pattern[k] = pattern.get(k, 0) + 1
            c = below[c - sizes[k]]
        for k, n in pattern.items():
            if n > most[k]:
                pattern[k] = int(most[k])
        out.append((i, pattern))
    return top, out


def fractional(lengths: np.ndarray, count: np.ndarray, capacity: int, rounds: int, tolerance: float = TOLERANCE) -> tuple[dict[tuple, float], float]:
    """Patterns ((index, copies), ...) with how often each is used, and a bound from below on the number of sequences."""
    covered = np.zeros(len(lengths))
    used: Counter = Counter()
    log_worth = np.log(lengths / capacity)
    bound = 0.0
    for _ in range(rounds):
        worth = np.exp(log_worth - log_worth.max())
        top, near = _patterns(lengths, worth, capacity, count, tolerance)
        bound = max(bound, float(worth @ count) / top)
        # Each length's pattern is used as often as its pieces ask for; together they are one answer of the pricing.
        gain = np.zeros(len(lengths))
        mass = [count[i] / pattern[i] for i, pattern in near]
        for m, (_, pattern) in zip(mass, near):
            for k, n in pattern.items():
                gain[k] += m * n
        gain /= count
        step = STEP / gain.max()
        for m, (_, pattern) in zip(mass, near):
            used[tuple(sorted(pattern.items()))] += m * step
        covered += gain * step
        log_worth -= gain * step / STEP * 0.5
    mean = float(covered @ (lengths * count)) / float(lengths @ count)
    return {key: x / mean for key, x in used.items()}, bound


def program(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS, solves: int = SOLVES) -> tuple[list[list[tuple[int, dict[int, int]]]], float]:
    """Patterns (copies, {length: pieces}) of the rounded program, one list for each of SLACKS, and the bound on sequences."""
    lengths = np.array(sorted(n for n, k in histogram.items() if k), np.int64)
    count = np.array([histogram[int(n)] for n in lengths], np.int64)
    whole, bound = fractional(lengths, count, capacity, rounds)
    found = []
    for slack in SLACKS:
        left = count.copy()
        opened: list[tuple[int, dict[int, int]]] = []
        used, live = whole, np.arange(len(lengths))
        for _ in range(solves):
            due, taken = 0.0, 0
            most = sorted(used.items(), key=lambda p: (-p[1], p[0]))[:PATTERNS]
            scale = sum(used.values()) / sum(x for _, x in most)
            for key, x in most:
                # Parts of a copy add up: a pattern is opened when what is due reaches one.
                due += x * scale
                copies = min(int(due), *(int(left[live[i]]) // n for i, n in key))
                if copies > 0 and sum(int(lengths[live[i]]) * n for i, n in key) >= capacity * (1 - slack):
                    opened.append((copies, {int(lengths[live[i]]): n for i, n in key}))
                    for i, n in key:
                        left[live[i]] -= copies * n
                    due -= copies
                    taken += copies
            live = np.flatnonzero(left)
            if not taken or left.sum() * 100 < count.sum():
                break
            used, _ = fractional(lengths[live], left[live], capacity, max(4, rounds // 8))
        found.append(opened)
    return found, bound


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[list[tuple[int, dict[int, int]]], dict[str, float]]:
    """(copies, {length: pieces}) of patterns that hold every piece once, and figures: sequences, the bound from below on any
    packing, sequences that the rounded program opened, and those of best fit alone. Full pieces are patterns of their own."""
    histogram = {n: k for n, k in histogram.items() if k}
    plain = best_fit(histogram, capacity)
    tokens = sum(n * k for n, k in histogram.items())
    figures = {"sequences": _size(plain), "bound": -(-tokens // capacity), "program": 0, "best_fit": _size(plain)}
    full = [(histogram[capacity], {capacity: 1})] if histogram.get(capacity) else []
    small = {n: k for n, k in histogram.items() if n <= capacity // SAND}
    middle = {n: k for n, k in histogram.items() if capacity // SAND < n < capacity}
    if not middle:
        return plain, figures
    found, low = program(middle, capacity, rounds)
    halves = sum(k for n, k in histogram.items() if 2 * n > capacity)  # no two of these meet
    figures["bound"] = max(figures["bound"], halves, _size(full) + math.ceil(low - 1e-6))
    best = plain
    for opened in found:
        left = Counter(middle)
        for copies, pattern in opened:
            for n, k in pattern.items():
                left[n] -= copies * k
        packed = full + best_fit(small | {n: k for n, k in left.items() if k}, capacity, opened)
        if _size(packed) < _size(best) or (best is plain and _size(packed) == _size(plain)):
            best = packed
            figures |= {"sequences": _size(packed), "program": _size(opened)}
    return best, figures


def _size(patterns: list[tuple[int, dict[int, int]]]) -> int:
    return sum(copies for copies, _ in patterns)


def best_fit(histogram: dict[int, int], capacity: int, opened: list[tuple[int, dict[int, int]]] = ()) -> list[tuple[int, dict[int, int]]]:
    """Best-fit decreasing over a histogram, many equal pieces at a time, into opened patterns first: open sequences are kept
    by their free tokens."""
    kinds: dict[int, Counter] = {}  # free tokens -> pattern -> copies
    for copies, pattern in opened:
        kinds.setdefault(capacity - sum(n * k for n, k in pattern.items()), Counter())[tuple(pattern.items())] += copies
    for n in sorted(histogram, reverse=True):
        left = histogram[n]
        while left:
            free = next((f for f in sorted(kinds) if f >= n), None)
            if free is None:
                each = capacity // n
                full, rest = divmod(left, each)
                for copies, k in ((full, each), (1 if rest else 0, rest)):
                    if copies:
                        kinds.setdefault(capacity - k * n, Counter())[((n, k),)] += copies
                left = 0
                continue
            pattern, copies = kinds[free].popitem()
            if not kinds[free]:
                del kinds[free]
            each = min(free // n, left)
            used = min(copies, left // each)
            grown = pattern + ((n, each),)
            kinds.setdefault(free - each * n, Counter())[grown] += used
            if used < copies:
                kinds.setdefault(free, Counter())[pattern] += copies - used
            left -= used * each
    out = []
    for _, group in sorted(kinds.items()):
        for pattern, copies in sorted(group.items()):
            whole: Counter = Counter()
            for n, k in pattern:
                whole[n] += k
            out.append((copies, dict(whole)))
    return out


def places(patterns: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, pieces of the length in it, offset of the first) for every length of every pattern."""
    ranks: Counter = Counter()
    rows, sequence = [], 0
    for copies, pattern in patterns:
        offset = 0
        for n in sorted(pattern, reverse=True):
            k = pattern[n]
            rows.append((n, ranks[n], ranks[n] + copies * k - 1, sequence, k, offset))
            ranks[n] += copies * k
            offset += n * k
        sequence += copies
    return rows


class Encoder:
    """Ids as the `tokenizers` file gives them without special tokens of its own: its added tokens are known in a text, and what
    is between them is encoded by the ranks of the same vocabulary, which is four times as fast."""

    def __init__(self, path: str, added: dict[str, int]):
        self.bpe = ByteBPE(path)
        self.added = added
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split if added else None

    def __call__(self, text: str) -> list[int]:
        if self.split is None or not any(token in text for token in self.added):
            return self.plain(text)
        out: list[int] = []
        for part in self.split(text):
            out += [self.added[part]] if part in self.added else self.plain(part)
        return out

    def plain(self, text: str) -> list[int]:
        if len(text) > LONG_TEXT:  # the pattern's engine gives up on very long runs
            return self.bpe.encode(text).tolist()
        return self.bpe.whole.encode_ordinary(text)


def added_tokens(name: str = "byte_bpe_50k.json") -> dict[str, int]:
    """Tokens that the file adds to its vocabulary, with their ids."""
    with open(rank_path(name), encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document: id, piece, start, length, ids_crc32, and the piece's task and rank in it by length.

    A document is its ids and an end; one longer than the capacity is cut into full pieces, of which the first may be
    shorter. A null or empty text is one piece with the end alone.
    """
    path, added = rank_path(), added_tokens()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = Encoder(path, added)
        task = TaskContext.get().partitionId()
        seen: Counter = Counter()
        for batch in sliced(batches):
            rows: list[list] = [[] for _ in range(7)]
            for row, text in enumerate(texts(batch, "text")):
                ids = np.array([*(encode(text) if text else ()), END], "<u4")
                begin, k = 0, 0
                while begin < len(ids):
                    end = begin + ((len(ids) - begin - 1) % capacity + 1)
                    n = end - begin
                    for column, value in zip(rows, (row, k, begin, n, zlib.crc32(ids[begin:end].tobytes()), task, seen[n])):
                        column.append(value)
                    seen[n] += 1
                    begin, k = end, k + 1
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[0], pa.int64()))] + [pa.array(c, t) for c, t in zip(rows[1:], kinds)], names=["id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    schema = f"id {dict(df.dtypes)[id_col]}, piece int, start long, length int, ids_crc32 long, task int, rank long"
    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, schema)


class Spots:
    """Where the piece of a length and rank goes; spots are sorted by length and first rank, so that a search finds it."""

    def __init__(self, spots: list[tuple[int, int, int, int, int, int]]):
        self.table = np.array(sorted(spots), np.int64).reshape(-1, 6)
        self.starts = np.searchsorted(self.table[:, 0], np.arange(int(self.table[:, 0].max(initial=0)) + 2))

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces."""
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for n in np.unique(length).tolist():
            at = np.flatnonzero(length == n)
            own = self.table[self.starts[n] : self.starts[n + 1]]
            spot = own[np.searchsorted(own[:, 1], rank[at], side="right") - 1]
            copy, place = np.divmod(rank[at] - spot[:, 1], spot[:, 4])
            sequence[at], offset[at] = spot[:, 3] + copy, spot[:, 5] + place * n
        return sequence, offset


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """A row a piece: its document, number, start, length, checksum, sequence and offset.

    Repeated rows are packed each; a null id is kept; extra columns are not carried on; an empty table gives no rows. The
    pieces are written to the shared folder once, since their ranks must not change when a task runs again. What is broadcast
    is the plan: a row a length and pattern, of at most SOLVES * PATTERNS patterns and those of best fit.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "packing")
    cut = scratch.write(pieces(df, id_col, text_col, capacity), "pieces")
    by_task = scratch.write(cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r[0]: r[1] for r in by_task.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    plan = spark.sparkContext.broadcast(places(solve(histogram, capacity, rounds)[0]))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spots = Spots(plan.value)
        for batch in sliced(batches, 10_000):
            length = batch.column(3).to_numpy()
            sequence, offset = spots(length, batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(length, pa.int64()), batch.column(4), pa.array(sequence), pa.array(offset)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # A row a length and task: more with every task, so not to be broadcast.
    ranked = cut.join(firsts.hint("merge"), ["length", "task"]).select("id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", (F.col("first") + F.col("rank")).alias("at"))
    out = ranked.mapInArrow(put, f"id {dict(df.dtypes)[id_col]}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))
