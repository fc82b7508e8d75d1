"""Repeated 200-byte strings by run-length indexes.

A window of 200 bytes is dealt by its minimizer, the 32 bytes of least hash in it, so equal windows meet and each window belongs to one
segment: the windows of a document that share one minimizer. Only segments whose minimizer occurs again go on. Buckets of
minimizers then build a run-compressed Burrows-Wheeler transform of their distinct segments, keep suffix-array samples and
common prefixes at run ends alone, and stream matching statistics along the text: within a run the value is the one before it
less one. Windows whose matching statistic reaches 200, or whose segment has copies, are repeated.

A minimizer with more than HOT distinct segments (the edges of a passage that very many documents share) is not put in one bucket. Equal
windows lie at the same distance from it, so its segments are cut into pieces of a few windows by that distance; pieces are dealt by the
bytes that all their windows share, equal ones are one, and each bucket of pieces gets a run index of its own. Only where one such core still has
more than HOT distinct pieces are its windows made equal one by one, pre-aggregated, so that no task holds an unbounded group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, materialize, n_buckets, passes, table

LENGTH = 200
GRAM = 32
#: Segment rows a bucket should hold, and rows of one minimizer above which it is hot.
BUCKET_ROWS, HOT = 3_000, 3_000
#: Windows of a block of a hot minimizer's segment.
BLOCK = 16
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _grams(raw: bytes) -> np.ndarray:
    """64-bit hash of every GRAM-byte string."""
    n = len(raw) - GRAM + 1
    words = np.ndarray(shape=(len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for i in range(GRAM // 8):
            h ^= words[8 * i : 8 * i + n] * _C[i]
            h = (h ^ (h >> np.uint64(32))) * _C[(i + 1) % 4]
        h ^= h >> np.uint64(29)
    return h


def segments(raw: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, window after the last, minimizer's hash (as long) and place of each segment of a text."""
    n = len(raw) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4
    h = _grams(raw)
    m = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equal ones
    width, have = length - GRAM + 1, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < width:
        m = np.minimum(m[: len(m) - (width - have)], m[width - have :])
    at = (m & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return first, np.append(first[1:], n), h[at[first]].view(np.int64), at[first]


def _row_key(doc_id: str | None, raw: bytes) -> bytes:
    """128 bits that stand for a row; rows alike in id and text share them, and their fate."""
    return xxhash.xxh3_128_digest(raw + b"\0" + repr(doc_id).encode())


def _key_bits(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(k[:8] for k in keys), np.int64)


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id as text (in pandas a null would make doubles of its neighbours) and text."""
    return docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text")


def _texts(pdf: pd.DataFrame) -> Iterator[tuple[str | None, bytes]]:
    for d, t in zip(pdf["doc_id"], pdf["text"]):
        yield (d if isinstance(d, str) else None), (t.encode("utf-8", "replace") if isinstance(t, str) else b"")


def _minimizers(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held = [segments(raw)[2] for _, raw in _texts(pdf)]
            yield pd.DataFrame({"anchor": np.concatenate(held) if held else np.zeros(0, np.int64)})

    return _rows(docs).mapInPandas(run, "anchor long")


PARTS = "kind int, anchor long, seg long, row_key binary, start int, copies long, back int, body binary"


def _parts(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """Kind 0: where each segment of a repeated minimizer lies. Kind 1: each distinct segment of a batch with its bytes and copies."""
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(repeated, "anchor"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            places, distinct = [], {}
            for doc_id, raw in _texts(pdf):
                lo, hi, anchor, place = segments(raw)
                keep = passes(bits.value, anchor)
                if not keep.any():
                    continue
                key = _row_key(doc_id, raw)
                for a, b, k, p in zip(lo[keep].tolist(), hi[keep].tolist(), anchor[keep].tolist(), place[keep].tolist()):
                    body = raw[a : b + LENGTH - 1]
                    seg = xxhash.xxh3_64_intdigest(body) - (1 << 63)
                    places.append((k, seg, key, a))
                    old = distinct.get((k, seg))
                    distinct[k, seg] = (old[0] + 1 if old else 1, p - a, body)
            cols = list(zip(*places)) if places else [[], [], [], []]
            yield pd.DataFrame({"kind": 0, "anchor": np.array(cols[0], np.int64), "seg": np.array(cols[1], np.int64), "row_key": pd.Series(list(cols[2]), dtype=object), "start": pd.array(cols[3], dtype="Int32"), "copies": pd.array([None] * len(places), dtype="Int64"), "back": pd.array([None] * len(places), dtype="Int32"), "body": None})
            n = len(distinct)
            yield pd.DataFrame({"kind": 1, "anchor": np.array([k for k, _ in distinct], np.int64), "seg": np.array([s for _, s in distinct], np.int64), "row_key": pd.Series([None] * n, dtype=object), "start": pd.array([None] * n, dtype="Int32"), "copies": pd.array([c for c, _, _ in distinct.values()], dtype="Int64"), "back": pd.array([x for _, x, _ in distinct.values()], dtype="Int32"), "body": [b for _, _, b in distinct.values()]})

    return _rows(docs).mapInPandas(run, PARTS)


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of texts, with suffix-array samples and common prefixes at run ends."""

    def __init__(self, bodies: list[bytes]):
        self.starts = np.cumsum([0] + [len(b) + 1 for b in bodies])
        s = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8).astype(np.int16) + 1
        s[self.starts[1:] - 1] = 0
        self.n, most = len(s), 2 * max(map(len, bodies))
        sa = self._suffixes(s, most)
        bwt = np.where(sa > 0, s[sa - 1], -1)  # nothing stands before the first symbol
        new = bwt[1:] != bwt[:-1]
        heads, tails = np.concatenate([[True], new]), np.concatenate([new, [True]])
        self.runs = int(heads.sum())
        self.head_at, self.tail_at = sa[heads], sa[tails]  # the samples
        j = np.flatnonzero(heads)
        j = j[j > 0]
        common = self._common(s, sa[j - 1], sa[j], most)
        self.head_common = np.concatenate([[0], common])
        self.tail_common = np.concatenate([common, [0]])  # a run's tail and the next run's head are neighbours

    @staticmethod
    def _suffixes(s: np.ndarray, most: int) -> np.ndarray:
        """Positions by their next `most` symbols, equal ones by place: doubling, in which only what is tied is sorted again."""
        n = len(s)
        padded = np.concatenate([s, np.zeros(8, np.int16)]).astype(np.uint64)
        key = np.zeros(n, np.uint64)
        for i in range(7):
            key = (key << np.uint64(9)) | padded[i : i + n]
        order = np.argsort(key, kind="stable")
        k = key[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size = np.diff(np.append(first, n))
        rank = np.empty(n + 1, np.int64)
        rank[n] = -1
        rank[order] = np.repeat(first, size)
        tied = order[np.repeat(size > 1, size)]
        h = 7
        while h < most and len(tied):
            after = rank[np.minimum(tied + h, n)] + 1
            both = (rank[tied].astype(np.uint64) << np.uint64(32)) | after.astype(np.uint64)
            o = np.argsort(both, kind="stable")
            tied, both = tied[o], both[o]
            head = both >> np.uint64(32)
            new = np.concatenate([[True], both[1:] != both[:-1]])
            group = np.concatenate([[True], head[1:] != head[:-1]])
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(tied)))
            in_group = np.arange(len(tied)) - np.maximum.accumulate(np.where(group, np.arange(len(tied)), 0))
            rank[tied] = head.astype(np.int64) + np.repeat(in_group[first], size)
            tied = tied[np.repeat(size > 1, size)]
            h *= 2
        return np.argsort(rank[:n], kind="stable")

    @staticmethod
    def _common(s: np.ndarray, x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
        """Length of the common prefix, `most` at most, of the suffixes at x and y."""
        padded = np.concatenate([s, np.full(4, -1, np.int16)])
        four = np.ndarray(shape=(len(s),), dtype="<u8", buffer=padded.tobytes(), strides=(2,))
        out, left, depth = np.zeros(len(x), np.int64), np.arange(len(x)), 0
        last = len(s) - 1
        while len(left) and depth < most:
            a, b = x[left] + depth, y[left] + depth
            inside = (a <= last) & (b <= last)
            a, b = np.minimum(a, last), np.minimum(b, last)
            differ = four[a] ^ four[b]
            same = inside & (differ == 0)
            low = differ & (~differ + np.uint64(1))
            out[left] = depth + np.where(same, 4, np.where(inside, np.where(low == 0, 0, (low >= np.uint64(1 << 16)).astype(np.int64) + (low >= np.uint64(1 << 32)) + (low >= np.uint64(1 << 48))), 0))
            left = left[same]
            depth += 4
        return np.minimum(out, most)

    def statistics(self) -> np.ndarray:
        """Matching statistic of every position: the longest match with any other, streamed from the samples at run ends."""
        at, best = np.arange(self.n), np.zeros(self.n, np.int64)
        for place, value in ((self.head_at, self.head_common), (self.tail_at, self.tail_common)):
            sampled = np.full(self.n, -(1 << 40), np.int64)
            sampled[place] = value + place  # value at i is the last sample's less the distance to it
            last = np.maximum.accumulate(np.where(sampled > -(1 << 39), at, -1))
            best = np.maximum(best, np.where(last >= 0, sampled[np.maximum(last, 0)] - at, 0))
        return best


def _ranges(flags: np.ndarray) -> list[int]:
    """Starts and ends, flat, of the runs of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edge.tolist()


def _bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """Repeated windows of each distinct segment (or piece) of a bucket."""
    out = {"anchor": [], "seg": [], "ranges": []}
    total = pdf.groupby("anchor")["copies"].transform("sum")
    pdf = pdf[total > 1]
    if len(pdf):
        per = pdf.groupby(["anchor", "seg"], sort=False).agg(copies=("copies", "sum"), body=("body", "first")).reset_index()
        bodies = per["body"].tolist()
        index = RunIndex(bodies)
        match = index.statistics()
        for a, g, c, body, at in zip(per["anchor"], per["seg"], per["copies"], bodies, index.starts):
            n = len(body) - LENGTH + 1
            r = [0, n] if c > 1 else _ranges(match[at : at + n] >= LENGTH)
            if r:
                out["anchor"].append(a)
                out["seg"].append(g)
                out["ranges"].append(r)
    return pd.DataFrame({"anchor": np.array(out["anchor"], np.int64), "seg": np.array(out["seg"], np.int64), "ranges": pd.Series(out["ranges"], dtype=object)})


def blocks_of(body: bytes, back: int) -> list[tuple[int, int, int, bytes, bytes | None]]:
    """Blocks of a segment's windows by distance to the minimizer, which lies `back` bytes after the first window's start.

    Number, first and last window, hash of what all windows of that block share, and hash of what they span if the segment has all of them.
    """
    out, n = [], len(body) - LENGTH + 1
    for j in range((back - n + 1) // BLOCK, back // BLOCK + 1):
        near, far = BLOCK * j, BLOCK * j + BLOCK - 1
        lo, hi = max(0, back - far), min(n - 1, back - near)
        core = xxhash.xxh3_128_digest(body[back - near : back - far + LENGTH])
        whole = hi - lo == BLOCK - 1
        out.append((j, lo, hi, core, xxhash.xxh3_128_digest(body[back - far : back - near + LENGTH]) if whole else None))
    return out


_MARKS = "anchor long, seg long, ranges array<int>"


def _hot(rows: DataFrame) -> DataFrame:
    """The same for hot minimizers, by run indexes of pieces."""
    spark = rows.sparkSession
    per = materialize(rows.groupBy("anchor", "seg").agg(F.sum("copies").alias("copies"), F.first("back").alias("back"), F.first("body").alias("body")), "hot-segments")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(a, s, c, lo, hi, *np.frombuffer(core, np.int64).tolist()) for a, s, c, back, body in zip(pdf["anchor"], pdf["seg"], pdf["copies"], pdf["back"], pdf["body"]) for _, lo, hi, core, _ in blocks_of(body, int(back))]
            yield pd.DataFrame(found, columns=["anchor", "seg", "copies", "lo", "hi", "core", "core2"])

    blocks = materialize(per.mapInPandas(cut, "anchor long, seg long, copies long, lo int, hi int, core long, core2 long"), "hot-blocks")
    shared = blocks.groupBy("core", "core2").agg(F.sum("copies").alias("times")).where("times > 1").select("core", "core2")  # a core that stands once has no equal windows
    live = blocks.join(shared, ["core", "core2"]).join(per.select("anchor", "seg", "body"), ["anchor", "seg"])
    body = F.substring("body", F.col("lo") + 1, F.col("hi") - F.col("lo") + LENGTH)
    pieces = materialize(live.select("anchor", "seg", "copies", "lo", "core", body.alias("body")).withColumn("name", F.xxhash64(F.sha2("body", 256))), "hot-pieces")
    distinct = materialize(pieces.groupBy("core", "name").agg(F.sum("copies").alias("copies"), F.first("body").alias("body")), "hot-distinct")
    over = materialize(distinct.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("core"), "hot-cores")
    own = distinct.select(F.col("core").alias("anchor"), F.col("name").alias("seg"), "copies", "body")
    buckets = n_buckets(spark, distinct.count(), BUCKET_ROWS)
    by_index = own.join(over.withColumnRenamed("core", "anchor"), "anchor", "left_anti").groupBy(F.pmod(F.xxhash64("anchor"), F.lit(buckets)).alias("bucket")).applyInPandas(lambda pdf: _bucket(pdf), _MARKS)

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(a, s, c, w, body[w : w + LENGTH]) for a, s, c, body in zip(pdf["anchor"], pdf["seg"], pdf["copies"], pdf["body"]) for w in range(len(body) - LENGTH + 1)]
            yield pd.DataFrame(found, columns=["anchor", "seg", "copies", "at", "window"])

    windows = own.join(over.withColumnRenamed("core", "anchor"), "anchor", "left_semi").select("anchor", "seg", "copies", "body").mapInPandas(explode, "anchor long, seg long, copies long, at int, window binary")
    windows = materialize(windows.withColumn("window", F.sha2("window", 256)), "hot-windows")
    again = windows.groupBy("window").agg(F.sum("copies").alias("times")).where("times > 1").select("window")
    one_by_one = windows.join(again, "window").select("anchor", "seg", F.array("at", F.col("at") + 1).alias("ranges"))
    marks = materialize(by_index.union(one_by_one), "hot-marks").withColumnsRenamed({"anchor": "core", "seg": "name"})
    placed = pieces.join(marks, ["core", "name"]).select("anchor", "seg", F.transform("ranges", lambda x: x + F.col("lo")).alias("ranges"))
    return placed.groupBy("anchor", "seg").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))  # bounded by a segment


def remove_ranges(raw: bytes, windows: np.ndarray, length: int = LENGTH) -> tuple[bytes, int, int]:
    """Text without the bytes that windows (rows of first and after-last start) cover, removed bytes and removed runs."""
    edge = np.zeros(len(raw) + 1, np.int64)
    np.add.at(edge, windows[:, 0], 1)
    np.add.at(edge, windows[:, 1] - 1 + length, -1)
    gone = np.cumsum(edge)[:-1] > 0
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), len(_ranges(gone)) // 2


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: what is left) and kept_sha256 of every row; kept is null where nothing was removed.

    Null or empty text, and texts under 200 bytes, lose nothing. Rows repeated with one doc_id are rows like others: their texts repeat
    each other. Null doc_id stays null. No rows: no rows. Other columns are neither read nor returned. Segments and rows are
    named by 128 bits of hash, which are assumed not to collide; whether windows are equal is decided on their bytes.
    """
    spark = docs.sparkSession
    repeated = materialize(_minimizers(docs).groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor"), "minimizers")
    parts = materialize(_parts(docs, repeated), "segments")
    bodies = parts.where("kind = 1").select("anchor", "seg", "copies", "back", "body")
    per_anchor = materialize(bodies.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("anchor"), "hot")
    hot = spark.sparkContext.broadcast(bit_filter(per_anchor, "anchor"))

    def split(want: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf[passes(hot.value, pdf["anchor"].to_numpy(np.int64)) == want]

        return bodies.mapInPandas(run, "anchor long, seg long, copies long, back int, body binary")

    buckets = n_buckets(spark, bodies.count(), BUCKET_ROWS)
    cold = split(False).groupBy(F.pmod(F.col("anchor"), F.lit(buckets)).alias("bucket")).applyInPandas(lambda pdf: _bucket(pdf), _MARKS)
    marks = cold.union(_hot(split(True)))
    places = parts.where("kind = 0").select("anchor", "seg", "row_key", "start")
    spans = places.join(marks, ["anchor", "seg"]).groupBy("row_key").agg(F.collect_list(F.struct("start", "ranges")).alias("marks"))  # bounded by the document
    spans = materialize(spans.withColumn("row_bits", F.expr("conv(concat_ws('', reverse(regexp_extract_all(hex(substring(row_key, 1, 8)), '(..)', 1))), 16, -10)").cast("long")), "marks")
    bits = spark.sparkContext.broadcast(bit_filter(spans, "row_bits"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = list(_texts(pdf))
            keys = [_row_key(d, raw) for d, raw in rows]
            touched = passes(bits.value, _key_bits(keys))
            yield pd.DataFrame({"row_key": keys, "doc_id": [d for d, _ in rows], "n_bytes": [len(r) for _, r in rows], "sha": [hashlib.sha256(r).hexdigest() for _, r in rows], "raw": [r if t else None for t, (_, r) in zip(touched, rows)]})

    rows = _rows(docs).mapInPandas(read, "row_key binary, doc_id string, n_bytes long, sha string, raw binary")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = {"n_removed": [], "n_spans": [], "kept": [], "kept_sha256": []}
            for raw, sha, marks_ in zip(pdf["raw"], pdf["sha"], pdf["marks"]):
                if marks_ is None or raw is None:
                    row = (0, 0, None, sha)
                else:
                    w = np.array([(m["start"] + m["ranges"][i], m["start"] + m["ranges"][i + 1]) for m in marks_ for i in range(0, len(m["ranges"]), 2)], np.int64)
                    kept, n, spans_ = remove_ranges(raw, w)
                    row = (n, spans_, kept, hashlib.sha256(kept).hexdigest())
                for k, v in zip(out, row):
                    out[k].append(v)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": pdf["n_bytes"]} | out)

    return rows.join(spans, "row_key", "left").select("doc_id", "n_bytes", "sha", "raw", "marks").mapInPandas(cut, "doc_id string, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string").withColumn("doc_id", F.col("doc_id").cast("long"))


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, length(h) // 2 AS n_bytes FROM d),
w AS (SELECT doc_id, i, md5(substring(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, greatest(n_bytes - 199, 0))) AS i FROM n)),
r AS (SELECT doc_id, i FROM w JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
islands AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r)),
spans AS (SELECT doc_id, min(i) AS lo, max(i) + 200 AS hi FROM islands GROUP BY doc_id, island),
parts AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS since FROM spans),
kept AS (SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substring(h, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) || substring(any_value(h), 2 * max(hi) + 1) AS rest FROM parts JOIN n USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256 FROM n LEFT JOIN kept USING (doc_id)
"""
