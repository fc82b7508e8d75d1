"""Exact dedup: a minimal perfect hash over the distinct digests of the history.

Digests of the history are made distinct (map-side combined), dealt to shards, and each shard gets a minimal perfect
hash: levels of bit arrays in which a key owns the bit that no other key of the level wants; its slot is the rank of
that bit. Slots hold the full digest, the winner's locator (largest doc_id) and the number of copies. A lookup computes
the slot and compares all bytes of the digest: members are repeats and update the slot, nonmembers form groups apart.

Skew: both sides are distinct digests before any group meets in a task, so a digest that holds a third of the rows
is one row there. The last join (rows to groups) has unique keys on one side, so adaptive execution may split it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, n_buckets

NO_ID = np.iinfo(np.int64).min
MAX_LEVELS = 24
SHARD = "shard int, n int, sizes array<long>, bits binary, digests binary, locators binary, copies binary"


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit finalizer, seeded by the level."""
    with np.errstate(over="ignore"):
        x = keys + np.uint64((level * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: slot() gives each its own number in [0, n) and others any number or -1."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.ranks = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels, rest = [], [], keys
        for level in range(MAX_LEVELS):
            if not len(rest):
                break
            m = max(8, 2 * len(rest))
            at = (_mix(rest, level) % np.uint64(m)).astype(np.int64)
            own = np.bincount(at, minlength=m) == 1
            sizes.append(m)
            levels.append(own)
            rest = rest[~own[at]]
        if len(rest):
            raise ValueError("keys of a shard are not distinct")
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, bool))

    def slot(self, keys: np.ndarray) -> np.ndarray:
        out, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, m in enumerate(self.sizes):
            if not len(left):
                break
            at = (_mix(keys[left], level) % np.uint64(m)).astype(np.int64) + base
            hit = self.bits[at]
            out[left[hit]] = self.ranks[at[hit]]
            left, base = left[~hit], base + m
        return out


def _keys(digests: np.ndarray) -> np.ndarray:
    """64 bits of each 32-byte digest."""
    return digests[:, :8].copy().view("<u8").ravel() if len(digests) else np.zeros(0, np.uint64)


def _digests(col: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.uint8).reshape(-1, 32)


def _ids(col: pd.Series) -> np.ndarray:
    return np.array([NO_ID if x is None or x != x else int(x) for x in col.astype(object)], np.int64)


def _build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    digests = _digests(pdf["digest"])
    h = PerfectHash.build(_keys(digests))
    at = h.slot(_keys(digests))
    by_slot = np.empty_like(at)
    by_slot[at] = np.arange(len(at))
    return pd.DataFrame([{"shard": int(pdf["shard"].iloc[0]), "n": len(pdf), "sizes": h.sizes, "bits": np.packbits(h.bits).tobytes(), "digests": digests[by_slot].tobytes(), "locators": _ids(pdf["locator"])[by_slot].tobytes(), "copies": pdf["copies"].to_numpy(np.int64)[by_slot].tobytes()}])


def _look_up(index: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
    if len(index):
        row = index.iloc[0]
        sizes = [int(x) for x in row["sizes"]]
        h = PerfectHash(sizes, np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(sizes)).astype(bool))
        digests = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        locators, copies = (np.frombuffer(row[k], np.int64).copy() for k in ("locators", "copies"))
    else:
        h, digests, locators, copies = None, np.zeros((0, 32), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    new, ids, n = _digests(probes["digest"]), _ids(probes["locator"]), probes["copies"].to_numpy(np.int64)
    at = h.slot(_keys(new)) if h is not None and len(new) else np.full(len(new), -1, np.int64)
    member = at >= 0
    member[member] = (digests[at[member]] == new[member]).all(axis=1)  # every byte, not the 64 bits of the key
    np.maximum.at(locators, at[member], ids[member])
    np.add.at(copies, at[member], n[member])
    repeated = np.zeros(len(locators), bool)
    repeated[at[member]] = True
    all_ids = np.concatenate([locators, ids[~member]])
    return pd.DataFrame({
        "digest": [x.tobytes() for x in digests] + [x.tobytes() for x in new[~member]],
        "keep_id": pd.array([None if x == NO_ID else int(x) for x in all_ids], dtype="Int64"),
        "group_size": np.concatenate([copies, n[~member]]),
        "in_history": np.concatenate([np.ones(len(locators), bool), np.zeros(int((~member).sum()), bool)]),
        "repeated": np.concatenate([repeated, np.zeros(int((~member).sum()), bool)]),
    })


def with_digest(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 (binary) of each whole text, A-Z lower-cased; a null text counts as empty."""
    return docs.select("doc_id", F.unhex(F.sha2(ascii_lower(F.col("text")), 256)).alias("digest"))


def distinct_digests(rows: DataFrame) -> DataFrame:
    """One row for each digest: winner's locator (largest doc_id; null if all are null) and copies."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("locator"), F.count(F.lit(1)).alias("copies"))


def build_index(distinct: DataFrame, shards: int) -> DataFrame:
    """The perfect-hash index, a row for each shard that has digests."""
    return distinct.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(_build_shard, SHARD)


def look_up(index: DataFrame, probes: DataFrame, shards: int) -> DataFrame:
    """All groups after the distinct probes have met the index: digest, keep_id, group_size, in_history, repeated."""
    dealt = probes.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))
    return index.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInPandas(_look_up, "digest binary, keep_id long, group_size long, in_history boolean, repeated boolean")


def exact_dedup(docs: DataFrame, history_share: int = 2, keys_per_shard: int = 100_000) -> DataFrame:
    """Exact duplicate groups of all documents, by whole text with A-Z lower-cased.

    One in `history_share` rows, by a hash of doc_id, is the history that gets the index; the others are looked up in it.
    Which rows are history changes no result. Returns doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; empty texts are equal to one another. Null doc_id loses to any other id; if all ids of a
    group are null, all its rows are kept. Rows repeated with the same doc_id are kept together. No rows: no rows.
    Other columns of docs are neither read nor returned.
    """
    spark = docs.sparkSession
    rows = materialize(with_digest(docs), "digests")
    old = F.pmod(F.xxhash64("doc_id"), F.lit(history_share)) == 0
    shards = n_buckets(spark, rows.count(), keys_per_shard)
    index = build_index(distinct_digests(rows.where(old)), shards)
    groups = look_up(index, distinct_digests(rows.where(~old)), shards).select("digest", "keep_id", "group_size")
    return rows.join(groups, "digest").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""
