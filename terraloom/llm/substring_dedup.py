"""Substring dedup: suffix automata over shards of reference passages, and matching statistics of what streams past them.

A window of `length` words is a repeat if it also starts in a row with a smaller id. To compare only what can match, every
window is owned by an anchor: the run of `gram` words in it with the smallest hash. Equal windows have equal anchors, so only
anchors found under two ids matter, and a passage (the windows of one anchor at one place, with their words) needs to meet
only passages of the same anchor. Hashes say no more than what meets what: every window is judged by an automaton, word by
word, and where the longest match that ends at a word has the window's length, the window is a repeat.

The passages of an anchor are a reference shard. They stream, by growing id, past the automaton of those before, which takes
in a passage if a window of it is new. At an anchor that more than PLACES rows hold (in a passage that everyone quotes) every
window is a passage of its own under its own key, so that what differs around the anchor is dealt apart. Where a shard still
has more than PLACES passages, its references are picked first: its distinct passages with their smallest ids, which are one
for a window's key and for others come from at most PLACES rows. They are sent to as many tasks as the passages need, PLACES
to a task, and the passages stream past an automaton of them that knows the smallest id behind each match. So neither a shard
nor what streams past it in one task grows with the table.

An automaton of all references would have to be broadcast and grows with the corpus; shards go to the tasks that need them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, WordHash, mix, sliced, table, texts, words_of

LENGTH = 13
GRAM = 5
#: Odd factors of a run's words.
FACTORS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
#: Passages of a key that one task streams; more are dealt to several.
PLACES = 1000
#: Keys with more passages are few; so many of them may be broadcast.
BROADCAST_ROWS = 100_000


class SuffixAutomaton:
    """A suffix automaton of several word sequences, each under an id; no match runs from one to the next.

    `owner` holds the smallest id that a state's words were added under, once `settle` has carried ids to shorter matches.
    """

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.size = [0]
        self.owner: list[int | None] = [None]

    def add(self, words: list, owner: int = 0) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w, owner)

    def _extend(self, last: int, w, owner: int) -> int:
        nxt, link, size = self.next, self.link, self.size
        if w in nxt[last]:  # the sequence so far was seen before
            q = nxt[last][w]
            if size[q] != size[last] + 1:
                q = self._clone(last, w, q)
            self.owner[q] = owner if self.owner[q] is None else min(owner, self.owner[q])
            return q
        cur = len(nxt)
        nxt.append({}), link.append(0), size.append(size[last] + 1), self.owner.append(owner)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if size[q] == size[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w, q: int) -> int:
        nxt, link, size = self.next, self.link, self.size
        clone = len(nxt)
        nxt.append(nxt[q].copy()), link.append(link[q]), size.append(size[p] + 1), self.owner.append(self.owner[q])
        link[q] = clone
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        return clone

    def settle(self) -> None:
        """What a state's words are under holds for its shorter suffixes too."""
        owner, link = self.owner, self.link
        for state in sorted(range(1, len(link)), key=self.size.__getitem__, reverse=True):
            up = link[state]
            if up > 0 and (owner[up] is None or (owner[state] is not None and owner[state] < owner[up])):
                owner[up] = owner[state]

    def matches(self, words: list) -> Iterator[tuple[int, int]]:
        """Matching statistics: for each word the length of the longest match that ends there, and its state."""
        nxt, link, size = self.next, self.link, self.size
        state = matched = 0
        for w in words:
            to = nxt[state].get(w)
            while to is None and state:
                state = link[state]
                matched = size[state]
                to = nxt[state].get(w)
            if to is not None:
                state = to
                matched += 1
            yield matched, state

    def repeated(self, words: list, length: int) -> int:
        """The windows of `length` words that some sequence holds, as bits by the place of the first word."""
        nxt, link, size = self.next, self.link, self.size
        state = matched = mask = 0
        bit = 1
        skip = length - 1
        for w in words:
            to = nxt[state].get(w)
            while to is None and state:
                state = link[state]
                matched = size[state]
                to = nxt[state].get(w)
            if to is not None:
                state = to
                matched += 1
            if skip:
                skip -= 1
                continue
            if matched >= length:
                mask |= bit
            bit <<= 1
        return mask

    def repeated_before(self, words: list, length: int, before: int) -> int:
        """The same for sequences under an id smaller than `before`; after `settle`."""
        mask = 0
        for end, (n, state) in enumerate(self.matches(words), 1 - length):
            if n >= length:
                while self.size[self.link[state]] >= length:
                    state = self.link[state]
                if self.owner[state] < before:
                    mask |= 1 << end
        return mask


def rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words: word hashes are random, so a sum with odd factors and a final mix is enough."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += hashes[j : j + n] * FACTORS[j]
    return mix(out)


def owners(hashes: np.ndarray, sizes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a batch of texts, one after the other: the run hashes, the first words of all windows, and the place of the anchor
    of each, the leftmost smallest run in it."""
    own = rolled(hashes, gram)
    wide = length - gram + 1
    starts = np.cumsum(sizes) - sizes
    windows = np.concatenate([np.empty(0, np.int64), *(np.arange(s, s + n - length + 1) for s, n in zip(starts.tolist(), sizes.tolist()) if n >= length)])
    if not len(windows):
        return own, windows, windows
    return own, windows, (np.lib.stride_tricks.sliding_window_view(own, wide).argmin(1)[windows] + windows)


def _batch(batch: pa.RecordBatch, hashes: WordHash) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """All words of a batch of texts, their hashes, and the number of words of each text."""
    words: list[bytes] = []
    sizes = []
    for text in texts(batch, "text"):
        own = words_of(text)
        words += own
        sizes.append(len(own))
    return words, hashes(words), np.array(sizes, np.int64)


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(anchor, id, th): the distinct anchors of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in sliced(batches):
            words, hashed, sizes = _batch(batch, hashes)
            own, windows, at = owners(hashed, sizes, length, gram)
            if len(at):
                at = at[np.append(True, at[1:] != at[:-1])]
                row = np.searchsorted(np.cumsum(sizes), at, side="right")
                anchor = own[at]
                order = np.lexsort((anchor, row))
                anchor, row = anchor[order], row[order]
                first = np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]))
                taken = pa.array(row[first])
                yield pa.RecordBatch.from_arrays([pa.array(anchor[first].view(np.int64)), batch.column(0).take(taken), batch.column(1).take(taken)], names=["anchor", "id", "th"])

    return docs.select("id", "th", "text").mapInArrow(run, "anchor long, id long, th long")


def passages(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """key, id, th, start and words of every passage at an anchor of column `shared`, and of every window at one of `crowded`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in sliced(batches):
            words, hashed, sizes = _batch(batch, hashes)
            own, windows, at = owners(hashed, sizes, length, gram)
            if not len(at):
                continue
            begin = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            count = np.diff(np.append(begin, len(at)))
            start, key = windows[begin], own[at[begin]].view(np.int64)
            ends = np.cumsum(sizes)
            row = np.searchsorted(ends, start, side="right")
            keep, apart = (_among(row, key, *_pairs(batch.column(c))) for c in (3, 4))
            keep &= ~apart
            # Windows of crowded anchors: a passage of `count` windows gives as many rows, each under the hash of its words.
            n = count[apart]
            single = np.repeat(start[apart], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            under = rolled(hashed, length)[single].view(np.int64) if len(single) else single
            start = np.concatenate([start[keep], single])
            key = np.concatenate([key[keep], under])
            row = np.concatenate([row[keep], np.repeat(row[apart], n)])
            end = start + np.concatenate([count[keep], np.ones(len(single), np.int64)]) + length - 1
            text = b" ".join(words)
            offset = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
            pieces = [text[a:b] for a, b in zip(offset[start].tolist(), (offset[end] - 1).tolist())]
            within = start - (ends - sizes)[row]
            taken = pa.array(row)
            columns = [pa.array(key), batch.column(0).take(taken), batch.column(1).take(taken), pa.array(within.astype(np.int32)), pa.array(pieces, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "th", "start", "words"])

    return docs.select("id", "th", "text", "shared", "crowded").mapInArrow(run, "key long, id long, th long, start int, words binary")


def _pairs(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of all values of an array of lists, sorted by both."""
    values = lists.flatten().to_numpy()
    rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    order = np.lexsort((values, rows))
    return rows[order], values[order]


def _among(row: np.ndarray, value: np.ndarray, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether pairs of row and value are among others, which are sorted."""
    keep = np.zeros(len(row), bool)
    starts = np.searchsorted(rows, np.arange(int(row.max(initial=-1)) + 2))
    own = np.searchsorted(row, np.arange(len(starts)))
    for r in range(len(starts) - 1):
        a, b = own[r], own[r + 1]
        held = values[starts[r] : starts[r + 1]]
        if b > a and len(held):
            keep[a:b] = held[np.minimum(np.searchsorted(held, value[a:b]), len(held) - 1)] == value[a:b]
    return keep


HIT = "id long, th long, start int, mask long"


class _Hits:
    """Hits on their way out, some thousands at a time."""

    def __init__(self):
        self.held: list[tuple] = []

    def sent(self, least: int) -> Iterator[pa.RecordBatch]:
        if len(self.held) > least:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.held), kinds)], names=["id", "th", "start", "mask"])
            self.held = []


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _streamed(length: int):
    """The repeated windows of passages (key, task, side, id, th, start, words) sorted by the first four.

    Side 1 are passages. Where references of the shard come first (side 0), passages stream past the automaton of these; else
    past that of the passages with smaller ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = _Hits()
        for _, shard in groupby(_rows(batches), key=lambda r: r[:2]):
            automaton = SuffixAutomaton()
            references, settled = False, False
            at, new = None, []
            for _, _, side, id_, th, start, raw in shard:
                words = raw.split(b" ")
                if side == 0:
                    automaton.add(words, id_)
                    references = True
                    continue
                if references:
                    if not settled:
                        automaton.settle()
                        settled = True
                    mask = automaton.repeated_before(words, length, id_)
                else:
                    if id_ != at:
                        for before in new:
                            automaton.add(before)
                        at, new = id_, []
                    mask = automaton.repeated(words, length)
                    if mask + 1 != 1 << (len(words) - length + 1):
                        new.append(words)
                if mask:
                    hits.held.append((id_, th, start, mask))
            yield from hits.sent(20_000)
        yield from hits.sent(0)

    return run


def repeated_spans(docs: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM, places: int = PLACES) -> DataFrame:
    """(id, th, hits): for every row (id, th, text) with repeats the starts of its passages and their repeated windows as bits.

    th is a hash of the text: rows are told apart by it and the id, so rows that share an id are judged each by its own text.
    """
    found = scratch.write(anchors(docs, length, gram), "anchors")
    shared = found.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high")
    shared = scratch.write(shared.select("anchor", (F.col("n") > places).alias("many")), "shared")
    lists = [F.collect_set(F.when(F.col("many") == many, F.col("anchor"))).alias(name) for name, many in (("shared", False), ("crowded", True))]
    by_text = scratch.write(found.select("anchor", "th").join(shared, "anchor").groupBy("th").agg(*lists), "by-text")
    scratch.drop("anchors", "shared")
    held = scratch.write(passages(docs.join(by_text, "th"), length, gram), "passages")
    scratch.drop("by-text")
    sizes = scratch.write(held.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > places).select("key", F.ceil(F.col("n") / F.lit(places)).cast("int").alias("tasks")), "sizes")
    tasks = F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes.hint("merge")
    dealt = held.join(tasks, "key", "left")
    streams = dealt.select("key", F.coalesce(F.pmod(F.xxhash64("id", "th", "start"), F.col("tasks")).cast("int"), F.lit(0)).alias("task"), F.lit(1).alias("side"), "id", "th", "start", "words")
    # All other passages meet in one group, which map-side aggregation makes a row a task.
    mine = [F.when(F.col("tasks").isNotNull(), F.col(c)).alias(c) for c in ("key", "words")]
    references = dealt.groupBy(*mine).agg(F.min("id").alias("id"), F.max("tasks").alias("tasks")).where("tasks is not null")
    sent = references.select("key", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.lit(0).alias("side"), "id", F.lit(0).cast("long").alias("th"), F.lit(0).alias("start"), "words")
    hits = streams.unionByName(sent).repartition("key", "task").sortWithinPartitions("key", "task", "side", "id").mapInArrow(_streamed(length), HIT)
    out = scratch.write(hits.groupBy("id", "th").agg(F.collect_set(F.struct("start", "mask")).alias("hits")), "hits")
    scratch.drop_all_but("hits")
    return out


def _covered(hits: pa.Array, sizes: np.ndarray, length: int) -> np.ndarray:
    """Which words of a batch of texts, one after the other, are in a repeated window."""
    first = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(hits)), pc.fill_null(pc.list_value_length(hits), 0).to_numpy())
    flat = hits.flatten()
    start, mask = flat.field("start").to_numpy().astype(np.int64), flat.field("mask").to_numpy()
    steps = np.zeros(int(sizes.sum()) + 1, np.int64)
    for k in range(int(mask.max(initial=0)).bit_length()):
        hit = (mask >> k) & 1 == 1
        at = first[row[hit]] + start[hit] + k
        steps += np.bincount(at, minlength=len(steps)) - np.bincount(at + length, minlength=len(steps))
    return np.cumsum(steps[:-1]) > 0


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, digest: bool = False) -> DataFrame:
    """id, n_words, n_removed, spans (word ranges removed, maximal), text (the words kept, joined by one space) and text_hash
    (xxhash64 of the text as it was).

    Windows are judged on the input. Every row comes back: a null or empty text or one with fewer words than the window
    keeps all; a row with a null id is never a repeat nor a reference; rows with the same id do not repeat each other, and
    each is judged by its own text; the text of a row without repeats is as it was. With `digest`, kept_sha256 takes the
    place of spans, text and text_hash. An empty table gives no rows.
    """
    scratch = Scratch(df.sparkSession, "substring")
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    hits = repeated_spans(docs.where("id is not null"), scratch, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            split = [words_of(t) for t in texts(batch, "text")]
            sizes = np.array([len(w) for w in split], np.int64)
            gone = _covered(batch.column(3), sizes, length)
            ends = np.cumsum(sizes)
            removed, spans, kept = [], [], []
            for text, words, end in zip(texts(batch, "text"), split, ends.tolist()):
                own = gone[end - len(words) : end]
                n = int(own.sum())
                left = [w for w, g in zip(words, own.tolist()) if not g] if n else words
                removed.append(n)
                if digest:
                    kept.append(hashlib.sha256(b" ".join(left)).hexdigest())
                else:
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))) if n else own[:0]
                    spans.append([{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2])])
                    kept.append(b" ".join(left).decode("utf-8", "surrogatepass") if n else text)
            head = [batch.column(0), pa.array(sizes), pa.array(removed, pa.int64())]
            if digest:
                yield pa.RecordBatch.from_arrays([*head, pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept_sha256"])
            else:
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([*head, pa.array(spans, kind), pa.array(kept, pa.string()), batch.column(1)], names=["id", "n_words", "n_removed", "spans", "text", "text_hash"])

    tail = "kept_sha256 string" if digest else "spans array<struct<start:int,end:int>>, text string, text_hash long"
    joined = docs.join(hits, ["id", "th"], "left").select("id", "th", "text", "hits")
    return joined.mapInArrow(run, f"id long, n_words long, n_removed long, {tail}").withColumnRenamed("id", id_col)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words in 13-word windows that also start in a document with a smaller doc_id removed."""
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True)


SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(words) - 11)) AS i, words FROM w),
keyed AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 12], ' ')) AS k FROM win),
low AS (SELECT k, min(doc_id) AS low FROM keyed GROUP BY k),
hit AS (SELECT doc_id, list(i) AS starts FROM keyed JOIN low USING (k) WHERE low < doc_id GROUP BY doc_id),
pos AS (SELECT doc_id, list(DISTINCT j) AS gone FROM (SELECT doc_id, unnest(range(s, s + 13)) AS j FROM (SELECT doc_id, unnest(starts) AS s FROM hit)) GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE list_transform(list_filter(range(1, len(words) + 1), lambda j: NOT list_contains(gone, j)), lambda j: words[j]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN pos USING (doc_id)
"""
