"""Byte-level BPE by recursive DuckDB queries in each partition.

Texts are cut by the public pattern. Pieces that a task has not met before become token-position rows, one for each
byte, and a recursive query joins neighbouring rows with the merge table and contracts the leftmost pair of least rank of
each piece until no piece has a pair left; the rows in order give the ids. An ordered aggregation decodes ids to bytes. One pass, no shuffle: a task needs its batch,
the merge table (bounded by the vocabulary) and bounded caches of pieces and of runs of ids.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Pieces that a worker keeps (when there are more, those met once go), and code points it works on at once.
CACHE_PIECES = 400_000
CHUNK = 1_000_000
#: A contraction takes a round over a piece's rows, so work grows with the square of its length: pieces of more bytes take a heap instead, with
#: the same result (README has the figures), and a batch of the recursion holds pieces whose squared lengths add up to at most BATCH_WORK.
LONG_PIECE = 128
BATCH_WORK = 8_000_000

ENCODE = """
WITH RECURSIVE state(piece, pos, token, round) AS (
  SELECT piece, pos, token, 0::SMALLINT FROM start
  UNION ALL
  (WITH pairs AS (SELECT piece, pos, token, lead(pos) OVER w AS next_pos, lead(token) OVER w AS next_token FROM state WINDOW w AS (PARTITION BY piece ORDER BY pos)),
        best AS (SELECT piece, min(rank::BIGINT << 32 | pos) AS choice, arg_min(next_pos, rank::BIGINT << 32 | pos) AS gone FROM pairs JOIN merges ON a = token AND b = next_token GROUP BY piece)
   SELECT s.piece, s.pos, CASE WHEN s.pos = (choice & 4294967295) THEN (choice >> 32)::INT ELSE s.token END, (round + 1)::SMALLINT
   FROM state s JOIN best USING (piece) WHERE s.pos <> gone)
)
SELECT piece, token FROM state JOIN (SELECT piece, max(round) AS round FROM state GROUP BY piece) USING (piece, round) ORDER BY piece, pos
"""
DECODE = "SELECT block, list(bytes ORDER BY pos) AS parts FROM coded JOIN vocabulary USING (id) GROUP BY block ORDER BY block"


class _Numbers(dict):
    """Numbers of pieces in the order they were first met; `new` has those that are not learned yet."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.new.append(piece)
        return n


class _Lists:
    """Numbered arrays, end to end."""

    def __init__(self, dtype):
        self.flat, self.at = np.zeros(0, dtype), np.zeros(1, np.int64)

    def append(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.flat = np.concatenate([self.flat, flat])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(lengths)])

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arrays of these numbers end to end, and where each starts (and the last ends)."""
        n = self.at[numbers + 1] - self.at[numbers]
        ends = np.concatenate([[0], np.cumsum(n)])
        return self.flat[np.repeat(self.at[numbers] - ends[:-1], n) + np.arange(ends[-1])], ends


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, path: str = RANKS, pattern: str = PATTERN):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.bytes_ = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        if (self.bytes_ < 0).any():
            raise ValueError("the ranks lack a single byte")
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        rows = [(a, b, r) for k, r in self.ranks.items() for i in range(1, len(k)) if (a := self.ranks.get(k[:i])) is not None and (b := self.ranks.get(k[i:])) is not None]
        self._table("merges", {n: np.array(x, np.int32) for n, x in zip(("a", "b", "rank"), zip(*rows))} if rows else {n: np.zeros(0, np.int32) for n in ("a", "b", "rank")})
        self._table("vocabulary", {"id": pa.array(self.ranks.values(), pa.int32()), "bytes": pa.array(self.ranks.keys(), pa.binary())})
        self.lengths = np.zeros(max(self.ranks.values()) + 1, np.int64)
        self.lengths[list(self.ranks.values())] = list(map(len, self.ranks))
        self.numbers, self.ids, self.texts = _Numbers(), _Lists(np.int32), _Lists(np.uint8)
        self.met = np.zeros(0, np.int64)

    def _table(self, name: str, columns: dict) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _learn(self) -> None:
        """Encode the new pieces."""
        new, todo = self.numbers.new, []
        found: list = [None] * len(new)
        for i, x in enumerate(new):
            raw = x.encode("utf-8", "replace")
            if (rank := self.ranks.get(raw)) is not None:
                found[i] = (rank,)
            elif len(raw) > LONG_PIECE:
                found[i] = self._by_heap(raw)
            else:
                todo.append((i, raw))
        todo.sort(key=lambda x: len(x[1]))  # pieces of like lengths are done after like numbers of rounds
        work = np.cumsum([len(r) ** 2 for _, r in todo]) // BATCH_WORK
        cuts = [0, *(np.flatnonzero(np.diff(work)) + 1).tolist(), len(todo)] if todo else []
        for i, j in zip(cuts, cuts[1:]):
            part = todo[i:j]
            n = np.array([len(r) for _, r in part])
            flat = np.frombuffer(b"".join(r for _, r in part), np.uint8)
            start = pa.table({"piece": np.repeat(np.arange(len(part), dtype=np.int32), n), "pos": (np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32), "token": self.bytes_[flat]})
            self.db.register("start", start)
            out = self.db.sql(ENCODE).to_arrow_table()
            self.db.unregister("start")
            values = out["token"].to_numpy()
            at = np.searchsorted(out["piece"].to_numpy(), np.arange(len(part) + 1)).tolist()
            for (k, _), a, b in zip(part, at, at[1:]):
                found[k] = values[a:b]
        self.ids.append(np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32), np.array([len(x) for x in found], np.int64))
        self.numbers.new = []

    def _forget(self) -> None:
        """Keep the pieces that were met more than once since the last time, if they are at most half of what may be kept."""
        self.met.resize(len(self.numbers), refcheck=False)
        keep = np.flatnonzero(self.met > 1)
        keep = keep if len(keep) <= CACHE_PIECES // 2 else keep[:0]
        old, names = (self.ids, self.texts), list(self.numbers)
        self.numbers, self.ids, self.texts, self.met = _Numbers(), _Lists(np.int32), _Lists(np.uint8), np.zeros(0, np.int64)
        for i in keep.tolist():
            self.numbers[names[i]]
        self.numbers.new = []
        self.ids.append(*(lambda flat, ends: (flat, np.diff(ends)))(*old[0].take(keep)))
        if len(old[1].at) > len(names):
            self.texts.append(*(lambda flat, ends: (flat, np.diff(ends)))(*old[1].take(keep)))

    def _by_heap(self, raw: bytes) -> list[int]:
        """The same contraction in n log n: pairs wait in a heap by rank, then position."""
        n = len(raw)
        part, after, before = [raw[i : i + 1] for i in range(n)], list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, bytes, bytes]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (r := self.ranks.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (r, i, part[i], part[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if part[i] != a or (j := after[i]) >= n or part[j] != b:
                continue
            part[i], part[j], after[i] = a + b, b"", after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [self.ranks[x] for x in part if x]

    def _groups(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For some texts at a time, the numbers of their pieces end to end, and where each text's start (and the last end); all are learned."""
        i = 0
        while i < len(texts):
            if len(self.numbers) > CACHE_PIECES:
                self._forget()
            size, numbers = 0, []
            while i < len(texts) and size < CHUNK:
                pieces = self.pattern.findall(texts[i]) if texts[i] else []
                numbers.append(np.fromiter(map(self.numbers.__getitem__, pieces), np.int64, len(pieces)))
                size += len(texts[i] or "")
                i += 1
            if self.numbers.new:
                self._learn()
            flat = np.concatenate(numbers)
            own = np.bincount(flat, minlength=len(self.numbers))
            own[: len(self.met)] += self.met
            self.met = own
            yield flat, np.cumsum([0, *map(len, numbers)])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token ids of each text; null or empty: none."""
        out = []
        for numbers, ends in self._groups(texts):
            flat, at = self.ids.take(numbers)
            out += np.split(flat, at[ends[1:-1]])
        return out

    def round_trip(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[bytes]]:
        """Token ids of each text, and the bytes they decode to; the ids of a piece are decoded once."""
        ids, decoded = [], []
        for numbers, ends in self._groups(texts):
            flat, at = self.ids.take(numbers)
            ids += np.split(flat, at[ends[1:-1]])
            done = len(self.texts.at) - 1
            new, starts = self.ids.take(np.arange(done, len(self.numbers)))
            if len(starts) > 1:
                raw = np.frombuffer(self._decode_flat(new), np.uint8)
                sizes = np.concatenate([[0], np.cumsum(self.lengths[new])])
                self.texts.append(raw, np.diff(sizes[starts]))
            flat, at = self.texts.take(numbers)
            whole, cuts = flat.tobytes(), at[ends].tolist()
            decoded += [whole[a:b] for a, b in zip(cuts, cuts[1:])]
        return ids, decoded

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """Bytes of each list of ids; unknown ids raise."""
        flat = np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int64)
        if len(flat) and (flat.min() < 0 or flat.max() >= len(self.lengths) or not self.lengths[flat].all()):
            raise ValueError("an id is not in the vocabulary")
        raw = b"".join(self._decode_flat(flat[i : i + CHUNK]) for i in range(0, len(flat), CHUNK))
        cuts = np.concatenate([[0], np.cumsum(self.lengths[flat])])[np.cumsum([0, *map(len, ids)])].tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def _decode_flat(self, flat: np.ndarray) -> bytes:
        if not len(flat):
            return b""
        pos = np.arange(len(flat), dtype=np.int32)
        self.db.register("coded", pa.table({"block": pos // 4_096, "pos": pos, "id": flat.astype(np.int32)}))
        out = self.db.sql(DECODE).to_arrow_table()
        self.db.unregister("coded")
        raw = []
        for lists in out["parts"].chunks:
            at, values = lists.offsets.to_numpy(), lists.values
            _, where, data = values.buffers()
            wide = np.int64 if pa.types.is_large_binary(values.type) else np.int32
            ends = np.frombuffer(where, wide)[values.offset :]
            raw.append(memoryview(data)[ends[at[0]] : ends[at[-1]]])
        return b"".join(raw)


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()))


_codecs: dict[tuple[str, str], Codec] = {}


def _codec(path: str, pattern: str) -> Codec:
    """One codec for each Python worker."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode_documents(docs: DataFrame, path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """doc_id and token ids (array<int>) of every whole text.

    Null or empty text: an empty array. Null doc_id stays null; repeated rows give repeated results; no rows: no rows. Other
    columns are neither read nor returned. `path` must be readable where executors run (it is part of a Python package).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):  # bounded pieces of output
                b = batch.slice(i, 500)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), _lists(codec.encode(b.column("text").to_pylist()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """doc_id, ids and decoded (binary) of every row; a null list decodes to no bytes, an unknown id raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                b = batch.slice(i, 500)
                lists = b.column("ids").fill_null([]) if b.column("ids").null_count else b.column("ids")
                at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists, pa.array(codec.decode([flat[x:y] for x, y in zip(at, at[1:])]), pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """doc_id, ids and decoded of every whole text: encode_documents, then decode_documents, by one codec and one worker for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                b = batch.slice(i, 500)
                ids, decoded = codec.round_trip(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), _lists(ids), pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row's encoding and decoding."""
    out = round_trip(docs)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
