"""Byte-level BPE by overlapping chunks, and decoding by concatenating raw bytes.

A long text is cut into chunks that overlap, and chunks are rows: each is split into pre-tokens on its own, from its first
character on, and these are encoded each by itself, in any task. The split of a position depends only on what follows, so two
chunks that share a boundary agree after it: chunks are stitched at the first boundary that both have in their overlap, and
only where there is none is a stretch split again. A text of one chunk needs no stitching and does not travel.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, sliced, table, texts

CHUNK, OVERLAP = 65_536, 512
#: A pre-token is settled once so many characters after its end are known: contractions look two ahead.
AHEAD = 2
MEMO = 200_000


def rank_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteBPE:
    """Encodes and decodes; made once a task, as neither the pattern nor the encoding can be sent."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import public_tokenizers
        import regex
        import tiktoken

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.raw = {rank: token for token, rank in self.ranks.items()}
        pattern = public_tokenizers.PATTERN
        self.find = regex.compile(pattern).finditer
        self.whole = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.single = tiktoken.Encoding("single", pat_str=r"[\s\S]+", mergeable_ranks=self.ranks, special_tokens={})
        self.chunk, self.overlap = chunk, overlap
        self.memo: dict[str, list[int]] = {}

    def ends(self, text: str, more: bool) -> list[int]:
        """Where the pre-tokens of a text end; if more text follows, only those that it can't change."""
        found = [m.end() for m in self.find(text)]
        if more:
            while found and found[-1] + AHEAD > len(text):
                found.pop()
        return found

    def encode_piece(self, piece: str) -> list[int]:
        ids = self.memo.get(piece)
        if ids is None:
            if len(self.memo) > MEMO:
                self.memo.clear()
            ids = self.single.encode_ordinary(piece)  # it is one pre-token already
            if len(piece) <= 64:
                self.memo[piece] = ids
        return ids

    def part(self, text: str, start: int, more: bool) -> tuple[list[int], list[list[int]]]:
        """The ends of a chunk's pre-tokens as places in the whole text, which the chunk starts in, and the ids of each."""
        ends, ids = [], []
        begin = 0
        for end in self.ends(text, more):
            ids.append(self.encode_piece(text[begin:end]))
            ends.append(start + end)
            begin = end
        return ends, ids

    def chunks(self, text: str) -> Iterator[tuple[int, str, bool]]:
        """Start and text of the chunks, and whether more follows."""
        text = sound(text)
        n = len(text)
        if n <= self.chunk + self.overlap:
            yield 0, text, False
            return
        for start in range(0, n, self.chunk):
            stop = min(n, start + self.chunk + self.overlap)
            yield start, text[start:stop], stop < n

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text; lone surrogates count as U+FFFD, which is what the library makes of them."""
        whole = Stitch(self)
        for start, chunk, more in self.chunks(text or ""):
            whole.add(start, chunk, more, *self.part(chunk, start, more))
        return whole.ids()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids.tolist()))


def sound(text: str) -> str:
    """Lone surrogates as U+FFFD."""
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


class Stitch:
    """The ids of a text from its chunks, which come in order; holds one chunk and what a pre-token across its end needs."""

    def __init__(self, bpe: ByteBPE):
        self.bpe = bpe
        self.out: list[int] = []
        self.ends: list[int] = []  # of the pre-tokens held
        self.held: list[list[int]] = []
        self.last = 0  # where those before end
        self.text, self.start = "", 0  # from `last` or before it on

    def _settle(self, n: int) -> None:
        """Gives out the first n pre-tokens held."""
        for ids in self.held[:n]:
            self.out += ids
        if n:
            self.last = self.ends[n - 1]
        self.ends, self.held = self.ends[n:], self.held[n:]

    def add(self, start: int, text: str, more: bool, ends: list[int], held: list[list[int]]) -> None:
        if start:
            known = set(ends)
            at = next((k for k in range(bisect_right(self.ends, start), len(self.ends)) if self.ends[k] in known), None)
            if at is None:  # a pre-token as long as the overlap: go on from the last settled boundary
                self._settle(len(self.ends))
                text = self.text[self.last - self.start : max(0, start - self.start)] + text[max(0, self.last - start) :]
                start = self.last
                ends, held = self.bpe.part(text, start, more)
            else:
                self._settle(at + 1)
                k = bisect_right(ends, self.last)
                ends, held = ends[k:], held[k:]
        self.ends, self.held, self.text, self.start = ends, held, text, start

    def ids(self) -> np.ndarray:
        self._settle(len(self.ends))
        return np.array(self.out, np.uint32)


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """id, n_tokens, ids (array of int) and decoded (bytes), one row a row of df.

    A null or empty text has no ids and decodes to no bytes; repeated rows are encoded each; extra columns are not carried
    on; an empty table gives no rows. path must be readable on every executor. The chunks of texts of more than one are
    written to the shared folder, since they are numbered there.
    """
    return _encode(df, id_col, text_col, path, chunk, overlap, False)


def _encode(df: DataFrame, id_col: str, text_col: str, path: str | None, chunk: int, overlap: int, digests: bool) -> DataFrame:
    path = path or rank_path()
    id_type = dict(df.dtypes)[id_col]
    kinds = ("string", "string") if digests else ("array<int>", "binary")
    schema = f"id {id_type}, n_tokens long, ids {kinds[0]}, decoded {kinds[1]}"

    def made(bpe: ByteBPE, ids: pa.Array, found: list[np.ndarray]) -> pa.RecordBatch:
        raw = [bpe.decode(i) for i in found]
        if digests:
            first, second = [hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in found], [hashlib.sha256(r).hexdigest() for r in raw]
            types = pa.string(), pa.string()
        else:
            first, second, types = [i.astype(np.int32) for i in found], raw, (pa.list_(pa.int32()), pa.binary())
        columns = [ids, pa.array([len(i) for i in found], pa.int64()), pa.array(first, types[0]), pa.array(second, types[1])]
        return pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids", "decoded"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE(path, chunk, overlap)
        for batch in sliced(batches):
            yield made(bpe, batch.column(0), [bpe.encode(t) for t in texts(batch, "text")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE(path, chunk, overlap)
        for batch in sliced(batches, 1):
            rows = list(bpe.chunks(texts(batch, "text")[0]))
            same = pa.array(np.zeros(len(rows), np.int64))
            columns = [batch.column(0).take(same), batch.column(1).take(same), *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.bool_())))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "start", "chunk", "more"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE(path, chunk, overlap)
        names = [*"key id start chunk more".split(), "ends", "sizes", "held"]
        for batch in sliced(batches, 16):
            found = [bpe.part(t, s, m) for s, t, m in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)))]
            columns = [pa.array([e for e, _ in found], pa.list_(pa.int64())), pa.array([[len(i) for i in h] for _, h in found], pa.list_(pa.int32())), pa.array([[x for i in h for x in i] for _, h in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=names)

    def stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE(path, chunk, overlap)
        rows = ((batch.column(1).slice(k, 1), batch.slice(k, 1).to_pylist()[0]) for batch in batches for k in range(batch.num_rows))
        for _, own in groupby(rows, key=lambda r: r[1]["key"]):
            stitch = Stitch(bpe)
            for id_, r in own:
                edges = np.cumsum([0, *r["sizes"]]).tolist()
                stitch.add(r["start"], r["chunk"], r["more"], r["ends"], [r["held"][a:b] for a, b in zip(edges, edges[1:])])
            yield made(bpe, id_, [stitch.ids()])

    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    long = F.coalesce(F.length("text"), F.lit(0)) > chunk + overlap
    fields = f"key long, id {id_type}, start long, chunk string, more boolean"
    some = rows.where(long).select(F.monotonically_increasing_id().alias("key"), "id", "text").mapInArrow(cut, fields)
    some = Scratch(df.sparkSession, "bpe").write(some.repartition("key", "start"), "chunks")
    out = rows.where(~long).mapInArrow(whole, schema)
    if not some.isEmpty():
        encoded = some.mapInArrow(parts, f"{fields}, ends array<long>, sizes array<int>, held array<int>")
        out = out.unionByName(encoded.repartition("key").sortWithinPartitions("key", "start").mapInArrow(stitched, schema))
    return out.toDF(id_col, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of every document's ids and of what they decode to, made where the ids are, so that they need not travel."""
    return _encode(table(spark, sf_dir, "documents"), "doc_id", "text", None, CHUNK, OVERLAP, True)
