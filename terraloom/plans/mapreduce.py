"""A map/reduce job as a DataFrame plan: explode, shuffle by key, aggregate."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.scratch import Scratch


def map_reduce(df: DataFrame, emit: Column, reduce: dict[str, Callable[[Column], Column]], key_order: bool = False) -> DataFrame:
    """key and one column an aggregate.

    `emit` is an array of structs of key and value for each row; `reduce` gives an aggregate of the value for each name.
    Aggregates run partly before the shuffle where Spark can, which is what a combiner does. Spark fails the job where a
    map fails, after its retries.
    """
    pairs = df.select(F.explode(emit).alias("p")).select("p.key", "p.value")
    out = pairs.groupBy("key").agg(*[f(F.col("value")).alias(n) for n, f in reduce.items()])
    return out.orderBy("key") if key_order else out


@dataclass(frozen=True)
class Results:
    """What a job did: rows mapped, pairs emitted, keys reduced, and its seconds."""

    rows: int
    pairs: int
    keys: int
    seconds: float


def run_job(df: DataFrame, emit: Column, reduce: dict[str, Callable[[Column], Column]]) -> tuple[DataFrame, Results]:
    """map_reduce run at once: its result, read from a written table, and counters that Spark takes along the way."""
    import time

    rows, pairs, keys = Observation(), Observation(), Observation()
    start = time.monotonic()
    seen = df.observe(rows, F.count(F.lit(1)).alias("n"))
    emitted = seen.select(F.explode(emit).alias("p")).select("p.key", "p.value").observe(pairs, F.count(F.lit(1)).alias("n"))
    out = emitted.groupBy("key").agg(*[f(F.col("value")).alias(n) for n, f in reduce.items()]).observe(keys, F.count(F.lit(1)).alias("n"))
    held = Scratch(df.sparkSession, "job").write(out, "result")
    return held, Results(rows.get["n"], pairs.get["n"], keys.get["n"], time.monotonic() - start)


class Timers:
    """Seconds and counts by group, of work on the driver and in tasks alike: accumulators that Spark adds up."""

    def __init__(self, spark, groups: Iterable[str]):
        sc = spark.sparkContext
        self.held = {g: (sc.accumulator(0.0), sc.accumulator(0)) for g in groups}

    def timed(self, group: str):
        """A context; in tasks too, where it is sent along."""
        from contextlib import contextmanager
        from time import monotonic

        seconds, count = self.held[group]

        @contextmanager
        def run():
            start = monotonic()
            try:
                yield
            finally:
                seconds.add(monotonic() - start)
                count.add(1)

        return run()

    def count(self, group: str) -> tuple[float, int]:
        return self.held[group][0].value, self.held[group][1].value


def write_parts(df: DataFrame, line: Column, path: str, name: str, parts: int, keys: tuple[str, ...] = ()) -> None:
    """The lines of each of so many parts as one text file, path/<name><i>_of_<parts>, rows dealt by the keys. For a path that all
    nodes see; a part is written whole under another name first, so that one that runs again leaves one file."""
    import os

    dealt = df.select(line.alias("line"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    dealt = dealt.repartition(parts, *[f"k{i}" for i in range(len(keys))]) if keys else dealt.repartition(parts)

    def run(frames):
        import pandas as pd
        from pyspark import TaskContext

        context = TaskContext.get()
        i = context.partitionId()
        os.makedirs(path, exist_ok=True)
        target = os.path.join(path, f"{name}{i}_of_{parts}")
        part = f"{target}.{context.taskAttemptId()}"
        n = 0
        with open(part, "w") as f:
            for frame in frames:
                n += len(frame)
                f.writelines(f"{s}\n" for s in frame["line"])
        os.replace(part, target)
        yield pd.DataFrame({"part": [i], "n": [n]})

    # Adaptive merging of partitions would leave fewer parts than asked for; a repartition to a number is not merged.
    dealt.mapInPandas(run, "part int, n long").write.format("noop").mode("overwrite").save()


def map_reduce_python(df: DataFrame, mapper: Callable[[dict], Iterable[tuple]], reducer: Callable[[object, Iterator], Iterable[tuple]], kinds: tuple[str, str], out_schema: str, partitions: int | None = None) -> DataFrame:
    """The general form: mapper gives (key, value) pairs of a row, reducer rows of a key and its values.

    kinds are the SQL types of key and value; out_schema has plain types, so that no comma stands within one. Rows are dealt by key and sorted by it, and reducers see the keys of a
    partition in order and the values as a stream, so no key's values are held at once.
    """
    from itertools import groupby

    import pandas as pd

    def run_map(frames):
        for frame in frames:
            pairs = [p for row in frame.to_dict("records") for p in mapper(row)]
            yield pd.DataFrame(pairs, columns=["key", "value"])

    def run_reduce(frames):
        rows = ((k, v) for frame in frames for k, v in zip(frame["key"].tolist(), frame["value"].tolist()))
        held: list[tuple] = []
        for key, group in groupby(rows, key=lambda r: r[0]):
            held += reducer(key, (v for _, v in group))
            if len(held) > 10_000:
                yield pd.DataFrame(held, columns=names)
                held = []
        yield pd.DataFrame(held, columns=names)

    names = [c.strip().split()[0].strip("`") for c in out_schema.split(",")]
    pairs = df.mapInPandas(run_map, f"key {kinds[0]}, value {kinds[1]}")
    dealt = pairs.repartition(partitions, "key") if partitions else pairs.repartition("key")
    return dealt.sortWithinPartitions("key").mapInPandas(run_reduce, out_schema)


def primes(limit: int, spark, partitions: int = 8) -> DataFrame:
    """key true with the primes below limit, by trial division up to the square root."""
    numbers = spark.range(0, limit, 1, partitions).select(F.col("id").alias("n"))
    root = F.floor(F.sqrt(F.col("n"))).cast("int")
    prime = (F.col("n") >= 2) & ((root < 2) | F.forall(F.sequence(F.lit(2), F.greatest(root, F.lit(2))), lambda d: (F.col("n") % d != 0) | (d > root)))
    return numbers.where(prime)
