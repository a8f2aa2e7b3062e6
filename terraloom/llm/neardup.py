"""Near-duplicates: MinHash bands give candidates, odd sketches sift them, full shingle sets confirm them.

An odd sketch is a bitmap of parities: every MinHash sample flips one bit. Two sketches differ in about as many bits as
samples differ, so the number of ones in their XOR estimates high similarities well and costs a few machine words.

The sketch of the samples is coarse: 4.5 standard errors below the threshold must still pass. Nodes whose buckets stay open
after the first round get a second sketch that folds the whole set: its XOR has at most as many ones as the sets differ in
items, so it never loses a pair and, with four bits an item, keeps few others.

Rows with the same set are one node, whatever their ids; ids that several sets share link these. In a bucket (nodes with the same samples in a band) not all pairs are made: of those
whose sketches are near enough, a first round confirms a spanning forest of the most similar ones, and a second round only
pairs between what the first left apart. A bucket larger than a block is dealt to blocks; if its nodes are still apart
afterwards, those outside its largest component are compared with all the rest, a block at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.operators.graph import components

from .common import Scratch, WordHash, mix, shingles, sliced, table, texts

BANDS, ROWS = 24, 4
SKETCH_BITS = 512
#: Sketches may underestimate: pairs go on to the exact check down to so many standard errors below the threshold.
ERRORS = 4.5
BLOCK = 256


class Samples:
    """MinHash samples of 32 bits, band keys and odd sketches."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, bits: int = SKETCH_BITS, seed: int = 20240607):
        self.bands, self.rows, self.bits = bands, rows, bits
        base = mix(np.arange(2 * bands * rows, dtype=np.uint64) + np.uint64(seed))
        self.mul = (base[::2] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        self.add = (base[1::2] >> np.uint64(32)).astype(np.uint32)
        self.number = np.arange(bands * rows, dtype=np.uint64)

    def __call__(self, items: np.ndarray) -> tuple[np.ndarray, bytes]:
        x = (mix(items) >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.mul), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), 1024):
            np.minimum(least, (np.multiply.outer(self.mul, x[i : i + 1024]) + self.add[:, None]).min(1), out=least)
        wide = least.astype(np.uint64)
        key = np.arange(self.bands, dtype=np.uint64)
        for j in range(self.rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + wide[j :: self.rows])
        bit = mix((self.number << np.uint64(32)) | wide) % np.uint64(self.bits)
        odd = (np.bincount(bit.astype(np.int64), minlength=self.bits) & 1).astype(np.uint8)
        return key.astype(np.int64), np.packbits(odd).tobytes()

    def most_ones(self, similarity: float, errors: float = ERRORS) -> int:
        """Ones in the XOR up to which a pair can be as similar as this."""
        k = self.bands * self.rows
        low = max(0.0, similarity - errors * math.sqrt(similarity * (1 - similarity) / k))
        return math.ceil(self.bits / 2 * (1 - math.exp(-4 * k * (1 - low) / self.bits)) + errors * math.sqrt(self.bits) / 2)


def _sets(batch: pa.RecordBatch, hashes: WordHash, words: int) -> Iterator[np.ndarray]:
    for text in texts(batch, "text"):
        yield shingles(hashes((text or "").encode("utf-8", "surrogatepass").lower().split()), words)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """id, th, n (size of the set), k1 and k2 (a digest of the set), bands and sketch; from columns id, th and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes, samples = WordHash(), Samples()
        for batch in sliced(batches):
            n, k1, k2, bands, sketches = [], [], [], [], []
            for items in _sets(batch, hashes, words):
                digest = np.frombuffer(xxhash.xxh3_128_digest(items.tobytes()), np.int64)
                keys, sketch = samples(items) if len(items) else (np.empty(0, np.int64), b"")
                n.append(len(items)), k1.append(digest[0]), k2.append(digest[1]), bands.append(keys), sketches.append(sketch)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["id", "th", "n", "k1", "k2", "bands", "sketch"]
            )

    return docs.select("id", "th", "text").mapInArrow(run, "id long, th long, n long, k1 long, k2 long, bands array<long>, sketch binary")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """id and items, the sorted hashes of its whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in _sets(batch, hashes, words)], pa.binary())], names=["id", "items"])

    return docs.select("id", "text").mapInArrow(run, "id long, items binary")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The columns of each run of rows with the same first `keys` columns; runs may pass from one batch to the next."""
    held: list[list] = []
    held_key = None

    def joined():
        return [np.concatenate([h[c] for h in held]) for c in range(len(held[0]))]

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        change = np.zeros(batch.num_rows, bool)
        for c in columns[:keys]:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for s, e in zip(starts, starts[1:]):
            key = tuple(c[s] for c in columns[:keys])
            if key != held_key:
                if held:
                    yield joined()
                held, held_key = [], key
            held.append([c[s:e] for c in columns[keys:]])
    if held:
        yield joined()


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ones in the XOR of every pair of sketches."""
    x, y = (np.frombuffer(b"".join(s), np.uint64).reshape(len(s), -1) for s in (a, b))
    return sum(np.bitwise_count(x[:, None, j] ^ y[None, :, j]).astype(np.int32) for j in range(x.shape[1]))


def folded_sets(sets: DataFrame) -> DataFrame:
    """id and fine, the parity bitmap of all items: a power of two of bits, four an item at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for raw in batch.column(1).to_pylist():
                items = np.frombuffer(raw, np.uint64)
                bits = max(64, 1 << (4 * len(items) - 1).bit_length())
                place = (mix(items + np.uint64(0x5BD1E995)) & np.uint64(bits - 1)).astype(np.int64)
                out.append(np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "fine"])

    return sets.select("id", "items").mapInArrow(run, "id long, fine binary")


class Fine:
    """Bitmaps as integers, and folded to fewer bits as they are asked for: the upper half is XORed into the lower."""

    def __init__(self, raw: np.ndarray):
        self.raw = raw
        self.held: dict[tuple[int, int], int] = {}

    def bits(self, i: int) -> int:
        return 8 * len(self.raw[i])

    def at(self, i: int, bits: int) -> int:
        value = self.held.get((i, bits))
        if value is None:
            own = self.bits(i)
            if own == bits:
                value = int.from_bytes(self.raw[i], "little")
            else:
                value = self.at(i, 2 * bits)
                value = (value >> bits) ^ (value & ((1 << bits) - 1))
            self.held[i, bits] = value
        return value


def _apart(i: np.ndarray, j: np.ndarray, n, other_n, fine, other_fine, percent: int) -> np.ndarray:
    """Of pairs, those that may differ in no more items than the threshold allows."""
    x = Fine(fine)
    y = x if other_fine is fine else Fine(other_fine)
    keep = np.empty(len(i), bool)
    for k, (p, q) in enumerate(zip(i.tolist(), j.tolist())):
        bits = min(x.bits(p), y.bits(q))
        keep[k] = (x.at(p, bits) ^ y.at(q, bits)).bit_count() * (100 + percent) <= (int(n[p]) + int(other_n[q])) * (100 - percent)
    return keep


def _pairs(label, n, sketch, other_label, other_n, other_sketch, percent: int, most: int, upper: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ones = _near(sketch, other_sketch)
    fits = (ones <= most) & (label[:, None] != other_label[None, :]) & (100 * np.minimum(n[:, None], other_n[None, :]) >= percent * np.maximum(n[:, None], other_n[None, :]))
    i, j = np.nonzero(np.triu(fits, 1) if upper else fits)
    return i, j, ones[i, j]


def _edges(ids: list, others: list) -> pa.RecordBatch:
    a, b = np.concatenate(ids), np.concatenate(others)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _within(percent: int, most: int, forest: bool):
    """Candidate pairs inside each block: a spanning forest of the most similar, or all between different labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, size = [], [], 0
        for ids, label, n, sketch, *fine in _groups(batches, 2):
            if len(ids) < 2 or (label == label[0]).all():
                continue
            i, j, ones = _pairs(label, n, sketch, label, n, sketch, percent, most, True)
            if fine and len(i):
                keep = _apart(i, j, n, n, fine[0], fine[0], percent)
                i, j, ones = i[keep], j[keep], ones[keep]
            if forest and len(i) > 1:
                order = np.lexsort((np.maximum(ids[i], ids[j]), np.minimum(ids[i], ids[j]), ones))
                root = {x: x for x in set(label.tolist())}
                chosen = []
                for k in order.tolist():
                    p, q = label[i[k]], label[j[k]]
                    while root[p] != p:
                        root[p] = p = root[root[p]]
                    while root[q] != q:
                        root[q] = q = root[root[q]]
                    if p != q:
                        root[max(p, q)] = min(p, q)
                        chosen.append(k)
                i, j = i[chosen], j[chosen]
            if len(i):
                left.append(ids[i]), right.append(ids[j])
                size += len(i)
            if size > 50_000:
                yield _edges(left, right)
                left, right, size = [], [], 0
        if left:
            yield _edges(left, right)

    return run


def _across(percent: int, most: int):
    """Candidate pairs between a block's members (side 0) and a chunk of those outside the largest component (side 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for side, ids, label, n, sketch, fine in _groups(batches, 3):
            x, y = side == 0, side == 1
            if x.any() and y.any():
                i, j, _ = _pairs(label[x], n[x], sketch[x], label[y], n[y], sketch[y], percent, most, False)
                keep = _apart(i, j, n[x], n[y], fine[x], fine[y], percent)
                if keep.any():
                    yield _edges([ids[x][i[keep]]], [ids[y][j[keep]]])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            same = []
            for p, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
                same.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.bool_())], names=["a", "b", "same"])

    return run


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, block: int = BLOCK, by_id: bool = True) -> DataFrame:
    """id, n_shingles, component_id (the smallest id reachable over links), kept and text_hash (xxhash64 of the text).

    Texts are linked if 100 * intersection >= percent * union of their sets of distinct runs of `words` words, lower-cased
    for A to Z. A text with fewer words is one shingle; a null one or one without words has none and is linked with
    nothing. Every row of df comes back: repeated rows each, a null id as a component of its own (null). An empty table
    gives no rows; extra columns are not carried on. Bands find a pair at the threshold with 1 - 3e-6, more similar ones
    nearly always; all that bands and sketches let through is confirmed on full sets.

    With by_id rows that share an id are one document: what their texts are linked with is one component, and kept says
    whether the row's id is that of its component. Without, links are between texts alone, and kept are the rows of
    the component's smallest id and, of that id's texts, the one with the smallest hash.
    """
    scratch = Scratch(df.sparkSession, "neardup")
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    signed = scratch.write(signatures(docs, words), "signed")
    full = signed.where("n > 0 and id is not null")
    one = scratch.write(full.groupBy("k1", "k2").agg(F.min(F.struct("id", "th")).alias("one")).select("k1", "k2", "one.*"), "sets-found")
    first = full.join(one, ["k1", "k2", "id", "th"]).dropDuplicates(["k1", "k2", "id", "th"])
    # A node's number is fixed by being written.
    nodes = scratch.write(first.select(F.monotonically_increasing_id().alias("node"), "id", "th", "k1", "k2", "n", "bands", "sketch"), "nodes")
    edges = _links(docs, nodes, scratch, words, percent, block)
    if by_id:
        shared = _by_id(full, nodes, scratch)
        edges = edges.unionByName(shared) if edges is not None and shared is not None else edges if shared is None else shared
    labels = components(edges, scratch) if edges is not None else None
    named = nodes.select("node", "id", "th", "k1", "k2")
    named = named.join(labels.withColumnRenamed("x", "node"), "node", "left").withColumn("root", F.coalesce("p", "node")) if labels is not None else named.withColumn("root", F.col("node"))
    low = scratch.write(named.groupBy("root").agg(F.min(F.struct("id", "th")).alias("low")), "low")
    named = scratch.write(named.join(low, "root").select("k1", "k2", F.col("low.id").alias("component"), F.col("low.th").alias("first")), "named")
    members = full.select("id", "th", "n", "k1", "k2").join(named, ["k1", "k2"]).select("id", "th", "n", "component", "first")
    alone = signed.where("n = 0 or id is null").select("id", "th", "n", F.col("id").alias("component"), F.col("th").alias("first"))
    kept = F.col("id").eqNullSafe(F.col("component"))
    if not by_id:
        kept = kept & (F.col("th") == F.col("first"))
    scratch.drop_all_but("signed", "named")
    return members.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"), F.col("th").alias("text_hash"))


def _by_id(full: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame | None:
    """Links (a, b) between the nodes that hold rows of the same id; None if no id has two."""
    several = full.groupBy("id").agg(*[f(k).alias(f"{f.__name__}_{k}") for f in (F.min, F.max) for k in ("k1", "k2")]).where("min_k1 <> max_k1 or min_k2 <> max_k2")
    several = scratch.write(several.select("id"), "ids-of-several")
    if several.isEmpty():
        return None
    held = full.select("id", "k1", "k2").join(several, "id").distinct().join(nodes.select("node", "k1", "k2"), ["k1", "k2"]).select("id", "node")
    held = scratch.write(held, "nodes-by-id")
    first = scratch.write(held.groupBy("id").agg(F.min("node").alias("a")), "first-by-id")
    return held.join(first, "id").where("a <> node").select("a", F.col("node").alias("b"))


def _links(docs: DataFrame, nodes: DataFrame, scratch: Scratch, words: int, percent: int, block: int) -> DataFrame | None:
    """Confirmed links (a, b) between nodes, enough of them for the components of all links; None if no bucket has two nodes."""
    samples = Samples()
    most = samples.most_ones(percent / 100)
    places = nodes.select(F.col("node").alias("nid"), "id", "th")
    nodes = nodes.select(F.col("node").alias("id"), "n", "bands", "sketch")
    keyed = nodes.select("id", F.explode("bands").alias("key"))
    shared = scratch.write(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "shared")
    buckets = scratch.write(keyed.join(shared, "key").select("key", "id", F.ceil(F.col("size") / F.lit(block)).cast("int").alias("blocks")), "buckets")
    if buckets.isEmpty():
        return None
    near = buckets.select("id").distinct()
    facts = nodes.select("id", "n", "sketch")
    # The text of a node is that of the row it was named after.
    texts_of = scratch.write(places.join(near.withColumnRenamed("id", "nid"), "nid", "left_semi"), "places")
    # The places grow with the table, so they are not to be broadcast, however few there are now.
    wanted = docs.join(texts_of.hint("merge"), ["id", "th"]).dropDuplicates(["id", "th"]).select(F.col("nid").alias("id"), "text")
    sets = scratch.write(full_sets(wanted, words), "sets")
    place = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        a, b = sets.select(F.col("id").alias("a"), F.col("items").alias("x")), sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
        both = pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y")
        return scratch.write(both.mapInArrow(_confirm(percent), "a long, b long, same boolean"), name)

    def candidates(labelled: DataFrame, forest: bool) -> DataFrame:
        more = () if forest else ("fine",)
        dealt = labelled.select("key", place.alias("place"), "id", "label", "n", "sketch", *more).repartition("key", "place").sortWithinPartitions("key", "place")
        return dealt.mapInArrow(_within(percent, most, forest), "a long, b long").distinct()

    known = buckets.join(facts, "id")
    first = confirmed(candidates(known.withColumn("label", F.col("id")), True), "first")
    links = first.where("same").select("a", "b")
    labels = components(links, scratch, "first-components")

    def labelled(labels: DataFrame | None) -> DataFrame:
        if labels is None:
            return known.withColumn("label", F.col("id"))
        return known.join(labels.withColumnRenamed("x", "id"), "id", "left").withColumn("label", F.coalesce("p", "id")).drop("p")

    state = scratch.write(labelled(labels).select("key", "id", "blocks", "label", "n", "sketch"), "state")
    apart = state.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    open_state = scratch.write(state.join(apart, "key", "left_semi"), "open")
    fine = scratch.write(folded_sets(sets.join(open_state.select("id").distinct(), "id", "left_semi")), "fine")
    open_state = open_state.join(fine, "id")
    second = confirmed(candidates(open_state, False).join(first.select("a", "b"), ["a", "b"], "left_anti"), "second")
    links = scratch.write(links.unionByName(second.where("same").select("a", "b")), "links")
    large = open_state.where("blocks > 1")
    if large.isEmpty():
        return links
    tested = first.select("a", "b").unionByName(second.select("a", "b"))
    labels = components(links, scratch, "second-components")
    now = large.drop("label")
    now = (now.join(labels.withColumnRenamed("x", "id"), "id", "left").withColumn("label", F.coalesce("p", "id")).drop("p") if labels is not None else now.withColumn("label", F.col("id")))
    now = scratch.write(now.select("key", "id", "blocks", "label", "n", "sketch", "fine"), "large")
    sizes = now.groupBy("key", "label").agg(F.count(F.lit(1)).alias("own"))
    largest = sizes.groupBy("key").agg(F.max_by("label", "own").alias("main"), F.sum("own").alias("all"), F.max("own").alias("own"))
    largest = largest.where("all > own").select("key", "main", F.ceil((F.col("all") - F.col("own")) / F.lit(block)).cast("int").alias("chunks"))
    split = now.join(largest, "key")
    rest = split.where("label <> main").select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("place"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("side"), "id", "label", "n", "sketch", "fine")
    whole = split.select("key", place.alias("place"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("side"), "id", "label", "n", "sketch", "fine")
    met = whole.unionByName(rest).repartition("key", "place", "chunk").sortWithinPartitions("key", "place", "chunk").mapInArrow(_across(percent, most), "a long, b long").distinct()
    third = confirmed(met.join(tested, ["a", "b"], "left_anti"), "third")
    return scratch.write(links.unionByName(third.where("same").select("a", "b")), "all-links")


def op7_odd_sketch_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component by sets of two-word shingles and a similarity of 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80).drop("text_hash")
