"""N-gram Jaccard join: extended prefixes over word shingles; rare tokens are indexed alone, frequent ones in combinations.

Two sets of Jaccard similarity 0.8 or more share a token among the first n - ceil(0.8 n) + 1 tokens of each in any
order that both follow. The order here: tokens of the rare class by hash, then those of the frequent class, those in fewest sets first. The
class follows from how often a token occurs in the extended prefixes (a quarter longer than a prefix in hash order). Documents of the
same set are one class first, and only components are asked for, so what is known to be linked isn't compared again.

* Rare tokens are indexed alone: their buckets hold at most RARE sets, whose pairs are verified.
* Sets whose prefix has no room without frequent tokens are indexed by their whole sets in that order. Sets of a bucket of a
  frequent token are held against the bucket's first set (a leader), those left against the next: near copies by the thousand become one component
  with as many comparisons as sets.
* Buckets that still hold several components are brought together where they share sets. In a group with at most MINOR sets outside its
  largest component, those are held against all, in blocks, so that work grows with the group (blocks compare sketches, and as sets only what
  these can't tell apart). The buckets of other groups are compared whole up to
  BLOCK sets; larger ones are indexed again by combinations: the token (or tokens) of the bucket with each token of a prefix in the order of how
  often tokens occur within the bucket, those in all of its sets left out. Buckets with the same sets count once. Sets that are nearly only what
  all share are held against those short enough for them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FORGET, bit_filter, map_rows, materialize, passes, release, releasing, slices, table
from .components import connected_components

WORDS, PERCENT = 5, 80
#: Buckets of at most so many sets are verified pair by pair.
RARE = 8
#: Sets that are compared with one another at once; larger buckets get combinations of one more token.
BLOCK = 400
#: Sets of a block whose sketches one task compares with another block's, and tokens of sets that are compared at once, or one set's.
SKETCHES, PIECE = 1_000, 500_000
#: Leaders that a bucket's sets are held against, one after the other, and most tokens of a combination (beyond them blocks meet in pairs).
LEADERS, MOST_TOKENS = 4, 4
#: Sets outside the largest component of a group of buckets, at most, that are held against all sets of the group.
MINOR = 20_000
#: Texts that are read into sets at once.
ROWS = 1_000
_M = np.uint64(0x9E3779B97F4A7C15)


#: Words whose hashes are kept between texts: none, since to look a word up among very many takes longer than to hash it.
_words = ()


def words_of(text: str | None) -> list[bytes]:
    """Runs of other than space and tab to carriage return, A-Z lower-cased, in UTF-8 (where bytes know ASCII only)."""
    return (text or "").encode("utf-8", "replace").lower().split()


def shingle_set(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; with fewer words the whole sequence is one; without words none."""
    return shingles(words_of(text), n)


def shingles(words: list[bytes], n: int = WORDS) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    a = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(n, len(a))
    with np.errstate(over="ignore"):
        h = a[: len(a) - k + 1] + np.uint64(k)
        for i in range(1, k):
            h = (h ^ (h >> np.uint64(31))) * _M + a[i : len(a) - k + 1 + i]
        h = (h ^ (h >> np.uint64(29))) * _M
        h ^= h >> np.uint64(32)
    return np.unique(h)


def pack(words: list[bytes]) -> bytes:
    """The words, compressed: a fraction of their shingles' eight bytes each."""
    raw = b" ".join(words)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


@lru_cache(64)
def unpack(packed: bytes) -> np.ndarray:
    """The shingle set of packed words; leaders come again and again."""
    return shingles(pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True).split())


FORGET.append(unpack.cache_clear)


def prefix_length(n: int) -> int:
    return n - (PERCENT * n + 99) // 100 + 1 if n else 0


def extended_length(n: int) -> int:
    return min(n, prefix_length(n) * 5 // 4 + 4) if n else 0


def class_id(tokens: np.ndarray) -> bytes:
    """128 bits that stand for all documents of one set."""
    return xxhash.xxh3_128_digest(tokens.tobytes())


def _long(tokens: np.ndarray) -> np.ndarray:
    return tokens.view(np.int64)


def parity_sketch(tokens: np.ndarray) -> bytes:
    """Bit i is the parity of the tokens that are i modulo a power of two from n to 2n: two sketches differ in no more bits than their sets in tokens."""
    bits = max(64, 1 << int(len(tokens) - 1).bit_length())
    return np.packbits(np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def may_be_similar(n: int, x: bytes, m: int, y: bytes) -> bool:
    """False only if the sketches prove that the sets are not similar."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    differ = int(np.unpackbits(a ^ b).sum())
    return (100 + PERCENT) * differ <= (100 - PERCENT) * (n + m)


def _scan(docs: DataFrame, whole: bool) -> DataFrame:
    """doc_id, n and cls of each row; with `whole` also its sketch and ext (the extended prefix in order of the unsigned hash)."""

    def run(columns: dict[str, list]) -> dict:
        sets = [shingle_set(t) for t in columns["text"]]
        out = {"n": [len(s) for s in sets], "cls": [class_id(s) for s in sets]}
        if whole:
            out |= {"sketch": [parity_sketch(s) for s in sets], "ext": [_long(s[: extended_length(len(s))]) for s in sets]}
        return out

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, ["text"], "n long, cls binary" + ", sketch binary, ext array<long>" * whole, ROWS)


def whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls and packed words of the classes in wanted (cls, first_id, materialized): only documents whose ids may be wanted are read into sets again; null ids may be."""
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted, "first_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            ids = batch.column("doc_id")
            own = ids.is_null().to_numpy(zero_copy_only=False) | passes(bits.value, ids.fill_null(0).to_numpy(zero_copy_only=False))
            words = [words_of(t) for t in batch.column("text").filter(pa.array(own)).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([class_id(shingles(w)) for w in words], pa.binary()), pa.array([pack(w) for w in words], pa.binary())], ["cls", "packed"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(releasing(run), "cls binary, packed binary")
    return found.join(wanted.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(F.first("packed").alias("packed"))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def _verify_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ok = [similar(unpack(x), unpack(y)) for x, y in zip(pdf["packed_a"], pdf["packed_b"])]
        yield pdf.loc[ok, ["a", "b"]]


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Star edges, by row number, that connect what a symmetric boolean matrix links."""
    left, out = np.ones(len(linked), bool), []
    for i in range(len(linked)):
        if not left[i]:
            continue
        left[i] = False
        front = [i]
        while front:
            j = front.pop()
            new = np.flatnonzero(linked[j] & left)
            left[new] = False
            out += [(i, int(k)) for k in new]
            front += new.tolist()
    return out


def overlaps(sets: list[np.ndarray], columns: int = 16_384) -> np.ndarray:
    """Sizes of all intersections, by dense products over slices of the tokens that two of the sets have."""
    own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = n[at] > 1
    number = np.cumsum(n > 1) - 1
    own, at, total = own[keep], number[at[keep]], int((n > 1).sum())
    order = np.argsort(at, kind="stable")
    own, at = own[order], at[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    for c in range(0, total, columns):
        lo, hi = np.searchsorted(at, [c, c + columns])
        m = np.zeros((len(sets), min(columns, total - c)), np.float32)
        m[own[lo:hi], at[lo:hi] - c] = 1
        out += m @ m.T
    return out


def _likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ok = [may_be_similar(*x) for x in zip(pdf["n_a"], pdf["sketch_a"], pdf["n_b"], pdf["sketch_b"])]
        yield pdf.loc[ok, ["a", "b"]]


def _verify_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """A forest of the links that are not within one of the parts known so far."""
    pdf = pdf.drop_duplicates("cls")
    sets = [unpack(x) for x in pdf["packed"]]
    common, n = overlaps(sets), np.array([len(s) for s in sets], np.float64)
    linked = 100 * common >= PERCENT * (n[:, None] + n[None, :] - common)
    parts, at = np.unique(pdf["part"].to_numpy(object), return_inverse=True)
    joined = np.zeros((len(parts), len(parts)), bool)
    x, y = np.nonzero(linked)
    joined[at[x], at[y]] = True
    return pd.DataFrame([(parts[i], parts[j]) for i, j in forest(joined)], columns=["a", "b"])


def distances(sketches: list[bytes], rows: np.ndarray, columns: np.ndarray, at_once: int = 1024) -> np.ndarray:
    """In how many bits the sketches of some rows and columns differ, some bytes at a time; those of the columns, up to twice as long, are folded."""
    a, b = (np.stack([np.frombuffer(sketches[i], np.uint8) for i in own]) for own in (rows, columns))
    if b.shape[1] > a.shape[1]:
        b = b[:, : a.shape[1]] ^ b[:, a.shape[1] :]
    out = np.zeros((len(a), len(b)), np.int64)
    for at in range(0, a.shape[1], at_once):
        x, y = (np.unpackbits(m[:, at : at + at_once], axis=1).astype(np.float32) for m in (a, b))
        out += (x.sum(axis=1)[:, None] + y.sum(axis=1)[None, :] - 2 * (x @ y.T)).astype(np.int64)
    return out


def candidates(n: np.ndarray, sketches: list[bytes], part: np.ndarray) -> np.ndarray:
    """Symmetric matrix of the pairs of different parts that sizes and sketches allow to be similar. Similar sets have sketches of equal or of twice the length."""
    out = np.zeros((len(n), len(n)), bool)
    width = np.array([len(x) for x in sketches])
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        for columns in (rows, np.flatnonzero(width == 2 * w)):
            if not len(columns):
                continue
            x, y = n[rows][:, None], n[columns][None, :]
            ok = (100 * np.minimum(x, y) >= PERCENT * np.maximum(x, y)) & (part[rows][:, None] != part[columns][None, :])
            if ok.any():
                ok &= (100 + PERCENT) * distances(sketches, rows, columns) <= (100 - PERCENT) * (x + y)
                out[np.ix_(rows, columns)] = ok
                out[np.ix_(columns, rows)] |= ok.T
    return out


def _screen(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a cell (key, x, y) the sets that may be similar to one of another part, in pairs of pieces (z) of BLOCK sets and PIECE tokens or so."""
    pdf = pdf.drop_duplicates("cls").sort_values(["n", "cls"], ignore_index=True)
    n = pdf["n"].to_numpy(np.int64)
    likely = candidates(n, pdf["sketch"].tolist(), np.unique(pdf["part"].to_numpy(object), return_inverse=True)[1])
    rows = np.flatnonzero(likely.any(axis=1))
    piece = np.maximum(np.arange(len(rows)) // BLOCK, (np.cumsum(n[rows]) - n[rows]) // PIECE)
    piece = np.unique(piece, return_inverse=True)[1]
    found, z = [], 0
    for i in range(piece.max(initial=-1) + 1):
        for k in range(i, piece.max() + 1):
            x, y = rows[piece == i], rows[piece == k]
            ok = likely[np.ix_(x, y)]
            own = np.union1d(x[ok.any(axis=1)], y[ok.any(axis=0)])
            if len(own):
                found.append(pdf.iloc[own][["key", "x", "y", "cls", "part"]].assign(z=z))
                z += 1
    return pd.concat(found) if found else pdf.iloc[:0][["key", "x", "y", "cls", "part"]].assign(z=0)


def _released(run: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """run over a group, after which a large one's memory goes back."""

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        out = run(pdf)
        if len(pdf) >= BLOCK // 2:
            release()
        return out

    return apply


def _compared(dealt: DataFrame, sets: DataFrame) -> DataFrame:
    """Links, told by part, within cells of sets (key, cls, part, x, y): only what sketches can't tell apart is held against one another as sets."""
    likely = dealt.join(sets.select("cls", "n", "sketch"), "cls").groupBy("key", "x", "y").applyInPandas(_released(_screen), "key binary, x int, y int, cls binary, part binary, z int")
    likely = materialize(likely, "likely-sets")
    return likely.join(sets.select("cls", "packed"), "cls").groupBy("key", "x", "y", "z").applyInPandas(_released(_verify_block), "a binary, b binary")


def _blocks(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links within buckets (key, cls, part, m), m the bucket's size: every pair of its blocks is one task's group. Links are told by part."""
    n = F.ceil(F.col("m") / SKETCHES).cast("int")
    dealt = rows.withColumn("blocks", n).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = other.select("key", "cls", "part", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    return _compared(pairs, sets)


def _grouped(rows: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links in groups of mixed buckets (key, cls, part) whose sets outside the largest part are few, and the rows of the buckets of other groups."""
    mixed = rows.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.min("cls").alias("a")).where("lo <> hi").select("key", "a")
    rows = materialize(rows.join(mixed, "key"), "mixed")
    groups = connected_components(rows.select("a", F.col("cls").alias("b"))).select(F.col("node").alias("cls"), F.col("component").alias("group"))
    own = materialize(rows.select("cls", "part").distinct().join(groups, "cls", "left").select("cls", "part", F.coalesce("group", "cls").alias("group")), "grouped")
    sizes = own.groupBy("group", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("group").agg(F.max(F.struct("n", "part")).alias("top"), F.sum("n").alias("m"))
    sizes = sizes.select("group", "m", F.col("top.part").alias("main"), (F.col("m") - F.col("top.n")).alias("u"))
    known = materialize(own.join(sizes, "group"), "grouped")
    h = F.xxhash64("cls")
    few = known.where(F.col("u") <= MINOR).withColumn("across", F.ceil(F.col("u") / SKETCHES).cast("int")).withColumn("down", F.ceil(F.col("m") / SKETCHES).cast("int"))
    few = few.withColumn("x", F.pmod(h, "across").cast("int")).withColumn("y", F.pmod(F.xxhash64("cls", F.lit(1)), "down").cast("int"))
    columns = F.transform(F.sequence(F.lit(0), F.col("across") - 1), lambda i: F.struct(i.alias("x"), F.col("y").alias("y")))
    lines = F.transform(F.sequence(F.lit(0), F.col("down") - 1), lambda j: F.struct(F.col("x").alias("x"), j.alias("y")))
    cells = F.when(F.col("part") == F.col("main"), columns).otherwise(F.array_union(columns, lines))
    dealt = few.select(F.col("group").alias("key"), "cls", "part", F.explode(cells).alias("cell")).select("key", "cls", "part", "cell.x", "cell.y")
    links = _compared(dealt, sets)
    left = known.where(F.col("u") > MINOR).select("cls")
    return materialize(links, "group-links"), materialize(rows.join(left, "cls", "left_semi").select("key", "cls", "part"), "other-buckets")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The similar ones of pairs of classes."""
    own = pairs.select("a", "b")
    for side in "ab":
        own = own.join(sets.select(F.col("cls").alias(side), F.col("packed").alias(f"packed_{side}")), side)
    return own.mapInPandas(releasing(_verify_pairs), "a binary, b binary")


def _index(reps: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Index rows (token, cls, n) of sets whose prefix has room for rare tokens only, and the classes of the other sets.

    counts (materialized) has the tokens that two extended prefixes or more have.
    """
    bits = reps.sparkSession.sparkContext.broadcast(bit_filter(counts, "token"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            lens = np.array([len(x) for x in pdf["ext"]])
            flat = np.concatenate([np.asarray(x, np.int64) for x in pdf["ext"]])
            keep = passes(bits.value, flat)
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
            own = np.repeat(np.arange(len(pdf)), lens)[keep]
            yield pd.DataFrame({"token": flat[keep], "pos": pos[keep].astype(np.int32), "cls": pdf["cls"].to_numpy()[own], "n": pdf["n"].to_numpy()[own]})

    rows = reps.select("cls", "n", "ext").mapInPandas(releasing(run), "token long, pos int, cls binary, n long").join(counts, "token")
    rows = materialize(rows, "prefix-rows")
    p = F.expr(f"n - (({PERCENT} * n + 99) div 100) + 1")
    room = F.expr(f"least(n, (n - (({PERCENT} * n + 99) div 100) + 1) * 5 div 4 + 4)")
    frequent = rows.where(F.col("c") > RARE)
    per = frequent.groupBy("cls").agg(F.count(F.lit(1)).alias("f"), F.first("n").alias("n"))
    full = per.where((room - F.col("f") < p) & (F.col("f") > 0)).select("cls")
    # the rank of a rare token: its place less the frequent ones before it; places differ by f at most, so only tokens at p or later need the count
    before = frequent.groupBy("cls").agg(F.sort_array(F.collect_list("pos")).alias("at"))  # bounded by the extended prefix
    rare = rows.where(F.col("c") <= RARE).join(full, "cls", "left_anti").join(before, "cls", "left")
    rank = F.col("pos") - F.coalesce(F.size(F.filter("at", lambda x: x < F.col("pos"))), F.lit(0))
    return rare.where(F.when(F.col("at").isNull(), F.col("pos")).otherwise(rank) < p).select("token", "cls", "n"), full


def _tokens(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n and token of every token of sets (keys, packed), some thousands of rows of a long set at a time."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString().replace('bigint', 'long')}" for f in rows.select(*keys).schema.fields) + ", n long, token long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            packed, i = pdf["packed"].to_numpy(), 0
            while i < len(packed):
                sets, size = [], 0
                while i + len(sets) < len(packed) and size < 200_000:
                    sets.append(_long(unpack(packed[i + len(sets)])))
                    size += len(sets[-1])
                lens = np.array([len(s) for s in sets], np.int64)
                own = np.repeat(np.arange(len(sets)), lens)
                yield pd.DataFrame({k: pdf[k].to_numpy()[own + i] for k in keys} | {"n": lens[own], "token": np.concatenate(sets)})
                i += len(sets)

    return rows.select(*keys, "packed").mapInPandas(releasing(run), schema)


def _full_index(full: DataFrame, sets: DataFrame, counts: DataFrame) -> DataFrame:
    """Index rows (token, cls, n) of the sets in full: their prefixes in the order (frequent or not, sets that have it, hash) of whole sets."""
    rows = _tokens(full.join(sets, "cls"), ["cls"])
    often = counts.where(F.col("c") > RARE).select("token", F.lit(1).alias("often"))
    known = materialize(rows.join(often, "token", "left").withColumn("often", F.coalesce("often", F.lit(0))), "full-tokens")
    many = known.where("often = 1").groupBy("token").agg(F.count(F.lit(1)).alias("sets"))
    rows = known.join(many, "token", "left").withColumn("sets", F.coalesce("sets", F.lit(0)))
    ranked = rows.groupBy("cls", "n").agg(F.sort_array(F.collect_list(F.struct("often", "sets", "token"))).alias("all"))  # bounded by the set
    p = F.expr(f"cast(n - (({PERCENT} * n + 99) div 100) + 1 as int)")
    return ranked.select("cls", "n", F.explode(F.slice("all", F.lit(1), p)).alias("t")).select(F.col("t.token").alias("token"), "cls", "n")


def _leaders(large: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of sets to leaders: each set stands in one bucket (key, cls), and is held against the bucket's first set, then, if that isn't similar, against the first of those left."""
    first = materialize(large.groupBy("cls").agg(F.min("key").alias("key")), "leader-rows")
    links = None
    for _ in range(LEADERS):
        lead = first.groupBy("key").agg(F.min("cls").alias("a"))
        own = materialize(_verified(first.join(lead, "key").where("cls <> a").select("a", F.col("cls").alias("b")), sets), "leader-links")
        links = own if links is None else links.union(own)
        first = materialize(first.join(own.select(F.col("b").alias("cls")), "cls", "left_anti").join(lead.select(F.col("a").alias("cls")), "cls", "left_anti"), "leader-rows")
    return links


def _distinct_buckets(rows: DataFrame) -> DataFrame:
    """rows (key, cls, part) of the buckets that hold more than one part, with m; of buckets with the same sets one stays."""
    per = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("part").alias("lo"), F.max("part").alias("hi"), F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("h1"), F.sum(F.xxhash64("cls", F.lit(1)).cast("decimal(38,0)")).alias("h2")).where("lo <> hi")
    keep = per.groupBy("m", "h1", "h2").agg(F.min("key").alias("key")).select("key", "m")
    return materialize(rows.join(keep, "key"), "buckets")


def _short(large: DataFrame, loose: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of loose sets (key, cls, part, n) with the sets of their bucket that are short enough to be similar; large has key, cls, part, n and m."""
    most = loose.groupBy("key").agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("loose"))
    near = large.join(most, "key").where(F.col("n") * PERCENT <= F.col("most") * 100).select("key", "cls", "part")
    near = near.join(near.groupBy("key").agg(F.count(F.lit(1)).alias("m")), "key")
    return _blocks(near, sets)


def _combined(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the parts of buckets (key, cls, part), by combinations of one more token where a bucket is large."""
    out = None
    add = lambda more: more if out is None else out.union(more)
    for depth in range(2, MOST_TOKENS + 1):
        rows = _distinct_buckets(rows)
        out = add(materialize(_blocks(rows.where(F.col("m") <= BLOCK), sets), "bucket-links"))
        large = rows.where(F.col("m") > BLOCK)
        if large.isEmpty():
            return out
        if depth == MOST_TOKENS:
            return add(materialize(_blocks(large, sets), "bucket-links"))
        tokens = materialize(_tokens(large.join(sets, "cls"), ["key", "cls", "part", "m"]), "bucket-tokens")
        local = tokens.groupBy("key", "token").agg(F.count(F.lit(1)).alias("sets"))
        e = F.expr(f"cast(n - (({PERCENT} * n + 99) div 100) as int)")
        rest = tokens.join(local, ["key", "token"]).where(F.col("sets") < F.col("m")).groupBy("key", "cls", "part", "n").agg(F.sort_array(F.collect_list(F.struct("sets", "token"))).alias("all"))  # bounded by the set
        whole = tokens.groupBy("key", "cls", "part", "n").agg(F.first("m").alias("m"))
        ranked = materialize(whole.join(rest.select("key", "cls", F.slice("all", F.lit(1), e + 1).alias("first")), ["key", "cls"], "left"), "bucket-prefixes")
        loose = ranked.where(F.coalesce(F.size("first"), F.lit(0)) <= e)
        if not loose.isEmpty():
            out = add(materialize(_short(ranked, loose, sets), "short-links"))
        again = ranked.where(F.size("first") > e).select("key", "cls", "part", F.explode("first").alias("t"))
        rows = materialize(again.select(F.concat("key", F.unhex(F.lpad(F.hex("t.token"), 16, "0"))).alias("key"), "cls", "part"), "combinations")
    return out


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, cls and component_id of every row.

    Null, empty or blank text: no shingles, linked with nothing, component_id is the row's own doc_id. Fewer than five words: one shingle. Equal sets
    are linked whatever their number. Null doc_id: it takes part, and loses to any other id as component_id (null if
    all ids of a component are null). Rows repeated with one doc_id are linked through their texts only. No rows: no
    rows. Other columns are neither read nor returned.
    """
    scanned = materialize(_scan(docs, True), "scanned")  # texts are made into sets once: to do it again for the labels costs more than to keep the prefixes
    found = scanned.where("n > 0").groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n", "sketch", "ext")).alias("r"))
    reps = materialize(found.select("cls", F.col("r.doc_id").alias("first_id"), F.col("r.n").alias("n"), F.col("r.sketch").alias("sketch"), F.col("r.ext").alias("ext")), "classes")
    ids = reps.select("cls", "first_id")
    counts = materialize(reps.select(F.explode("ext").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "token-counts")
    rare, full = _index(reps, counts)
    rare, full = materialize(rare, "rare-index"), materialize(full, "full")
    full_sets = materialize(whole_sets(docs, materialize(full.join(ids, "cls"), "full-ids")), "full-sets")
    index = materialize(rare.union(_full_index(full, full_sets, counts).select(rare.columns)), "index")
    sizes = index.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    index = materialize(index.join(sizes, "token"), "index")
    # small buckets: their pairs, where sizes and sketches allow the similarity
    bucket = index.where(F.col("m") <= RARE).groupBy("token").agg(F.sort_array(F.collect_list(F.struct("n", "cls"))).alias("s"))  # RARE at most
    pairs = bucket.select("s", F.posexplode("s").alias("i", "x")).select("x", F.explode(F.expr("slice(s, i + 2, size(s))")).alias("y")).where(F.col("x.n") * 100 >= F.col("y.n") * PERCENT)
    pairs = pairs.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).distinct()
    sketches = reps.select("cls", "n", "sketch")
    for side in "ab":
        pairs = pairs.join(sketches.select(F.col("cls").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}")), side)
    pairs = materialize(pairs.mapInPandas(releasing(_likely), "a binary, b binary"), "likely-pairs")
    large = index.where(F.col("m") > RARE).select(F.unhex(F.lpad(F.hex("token"), 16, "0")).alias("key"), "cls")
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).union(large.select("cls")).distinct()
    sets = materialize(whole_sets(docs, materialize(wanted.join(ids, "cls"), "wanted")).join(sketches, "cls"), "sets")
    links = materialize(_verified(pairs, sets).union(_leaders(large, sets)), "links")
    parts = materialize(connected_components(links), "parts")
    rest = large.join(parts.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", F.coalesce("component", "cls").alias("part"))
    more, others = _grouped(materialize(rest, "large-buckets"), sets)
    if not others.isEmpty():
        more = more.union(_combined(others, sets))
    if not more.isEmpty():
        parts = connected_components(links.union(more))
    label = ids.join(parts.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    label = label.join(label.groupBy("component").agg(F.min("first_id").alias("component_id")), "component").select("cls", "component_id")
    empty = F.col("n") == 0
    return scanned.select("doc_id", "n", "cls").join(label, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), "cls", F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS shingles FROM w),
u AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS t FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b USING (t) WHERE a.doc_id <> b.doc_id AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80 GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a)
SELECT doc_id, len(shingles) AS n_shingles, least(doc_id, (SELECT min(b) FROM reach WHERE a = doc_id)) AS component_id FROM s
"""
