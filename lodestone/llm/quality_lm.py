"""Quality classifier: interpolated modified Kneser-Ney character n-grams of trusted text, perplexity, quantiles by language.

N-grams run over word edges, so the order of words counts. Counts of all trusted documents are pre-aggregated by task and summed by n-gram; lower
orders, sums of histories, discounts and interpolated probabilities are joins and sums of those tables, dealt by n-gram. Documents are written once
in blocks of some megabytes; the distinct n-grams of each block, their suffixes and histories are joined with the model in shards by n-gram, and what is
found comes back to the block, which stays where it was written and whose documents it scores. No table of the model is gathered anywhere, so none has to be small. A document is kept if
its perplexity is at most MARGIN times the QUANTILE of the trusted documents of its language.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HELD_OUT, fold, materialize, materialize_dealt, table

ORDER = 4
START, END = "\x02", "\x03"
#: Characters that texts lose, as white space: the two marks, and the one that arrays of strings end with.
MARKS = {0: " ", 2: " ", 3: " "}
QUANTILE, MARGIN = 0.99, 1.5
#: Characters of text in a block (a longer text is a block of its own), and code points worked on at once.
BLOCK_CHARS, CHUNK = 12_000_000, 1_000_000
#: Score of a document without words.
NO_WORDS = 1.0


def sequence_of(text: str | None) -> str:
    """A text between marks: lower case, words apart by one space; without words nothing."""
    words = text.lower().translate(MARKS).split() if text else []
    return START * (ORDER - 1) + " ".join(words) + END if words else ""


def chunks(sequences: list[str]) -> Iterator[list[tuple[int, str]]]:
    """(number, piece) of the sequences, CHUNK code points or a little more at once; pieces of a long one share ORDER - 1 characters."""
    held, size = [], 0
    for i, s in enumerate(sequences):
        for at in range(0, max(1, len(s) - ORDER + 1), CHUNK):
            piece = s[at : at + CHUNK + ORDER - 1]
            if len(piece) < ORDER:
                continue
            held.append((i, piece))
            size += len(piece)
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def distinct_grams(pieces: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct n-grams of some pieces, the number of each place's one, and where each piece's places start."""
    codes = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
    alphabet, ids = np.unique(codes, return_inverse=True)
    lens = np.array([len(p) for p in pieces])
    ends = np.cumsum(lens)
    at = np.arange(len(codes))
    at = at[np.repeat(ends, lens) - at >= ORDER]
    starts = np.cumsum(lens - ORDER + 1) - (lens - ORDER + 1)
    width = int(len(alphabet)).bit_length()
    if width * ORDER <= 64:
        ids = ids.astype(np.uint64)
        key = np.zeros(len(at), np.uint64)
        for k in range(ORDER):
            key = (key << np.uint64(width)) | ids[at + k]
        _, first, number = np.unique(key, return_index=True, return_inverse=True)
    else:
        _, first, number = np.unique(np.stack([ids[at + k] for k in range(ORDER)], axis=1), axis=0, return_index=True, return_inverse=True)
    rows = np.ascontiguousarray(np.stack([codes[at[first] + k] for k in range(ORDER)], axis=1))
    return rows.view(f"<U{ORDER}").ravel().tolist(), number.ravel(), starts


def trusted_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id of trusted documents: labelled of quality 1 and never of 0, in the folds other than 2."""
    return labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality_label")).where("quality_label > 0").select("doc_id")


def _counts(texts: DataFrame) -> DataFrame:
    """gram and its count c in the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], ["gram", "c"])
            sums.clear()
            return done

        for batch in batches:
            for held in chunks([sequence_of(t) for t in batch.column("text").to_pylist()]):
                grams, number, _ = distinct_grams([p for _, p in held])
                sums.update(dict(zip(grams, np.bincount(number).tolist())))
                if len(sums) > 1_000_000:
                    yield out()
        if sums:
            yield out()

    return texts.select("text").mapInArrow(count, "gram string, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def _discounts(counts: DataFrame) -> list[float]:
    n = {int(r["k"]): r["n"] for r in counts.where("c <= 4").groupBy(F.col("c").alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}  # four rows
    n1, n2, n3, n4 = (n.get(k, 0) for k in (1, 2, 3, 4))
    if not n1 or not n2:
        return [0.5, 0.75, 0.75]
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.05), k - 0.05) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3 if n3 else 1.5))]


def kneser_ney(counts: DataFrame) -> DataFrame:
    """gram, p (the interpolated probability of its last character) and gamma (its back-off weight as a history), null where it has none; '' has the probability of an unseen character as p."""
    by_order = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        by_order[k] = materialize(by_order[k + 1].groupBy(F.expr(f"substring(gram, 2, {k})").alias("gram")).agg(F.count(F.lit(1)).alias("c")), f"kn-{k}")
    parts, lower = [], None
    for k in range(1, ORDER + 1):
        c = by_order[k]
        d = _discounts(c)
        h = F.expr(f"substring(gram, 1, {k - 1})")
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        hist = c.withColumn("h", h).withColumn("d", cut).groupBy("h").agg(F.sum("c").alias("s"), F.sum("d").alias("cut")).select("h", "s", (F.col("cut") / F.col("s")).alias("gamma"))
        here = c.withColumn("h", h).withColumn("d", cut).join(hist, "h")
        if lower is None:
            size = c.count() + 1
            p = here.select("gram", ((F.col("c") - F.col("d")) / F.col("s") + F.col("gamma") / size).alias("value"))
            parts.append(c.sparkSession.createDataFrame([("", 1.0 / size, None)], "gram string, p double, gamma double"))
        else:
            low = lower.select(F.col("gram").alias("tail"), F.col("value").alias("low"))
            p = here.withColumn("tail", F.expr(f"substring(gram, 2, {k - 1})")).join(low, "tail").select("gram", ((F.col("c") - F.col("d")) / F.col("s") + F.col("gamma") * F.col("low")).alias("value"))
        lower = materialize(p, f"kn-p{k}")
        parts += [lower.select("gram", F.col("value").alias("p"), F.lit(None).cast("double").alias("gamma")), hist.select(F.col("h").alias("gram"), F.lit(None).cast("double").alias("p"), "gamma")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return materialize(out.groupBy("gram").agg(F.max("p").alias("p"), F.max("gamma").alias("gamma")), "kn-model")


def gram_log_probability(gram: str, p: dict[str, float], gamma: dict[str, float], unseen: float) -> float:
    """log P(last character | the others) by the longest seen n-gram and the weights of the histories above it."""
    weight = 1.0
    for k in range(ORDER, 0, -1):
        g = gram[ORDER - k :]
        if (x := p.get(g)) is not None:
            return math.log(weight * x)
        weight *= gamma.get(g[:-1], 1.0)
    return math.log(weight * unseen)


def gram_log_probability(gram: str, model: dict[str, tuple[float | None, float | None]], unseen: float) -> float:
    """log P(last character | the others) by the longest seen n-gram and the weights of the histories above it."""
    weight = 1.0
    for k in range(ORDER, 0, -1):
        g = gram[ORDER - k :]
        p = model.get(g, _NONE)[0]
        if p is not None:
            return math.log(weight * p)
        gamma = model.get(g[:-1], _NONE)[1]
        weight *= 1.0 if gamma is None else gamma
    return math.log(weight * unseen)


_NONE = (None, None)


def pack_rows(rows: pa.RecordBatch) -> bytes:
    """doc_id, lang and sequence of some rows, in compressed Arrow: they are written once, and not shuffled."""
    sequences = pa.array([sequence_of(t) for t in rows.column("text").to_pylist()], pa.string())
    own = pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("lang"), sequences], ["doc_id", "lang", "sequence"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
        out.write_batch(own)
    return sink.getvalue().to_pybytes()


def unpack_rows(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(packed).read_all()


def _in_blocks(docs: DataFrame) -> DataFrame:
    """`block`, a number that some neighbours of a partition share, and these, packed, in a row or more; written, so that it stays, dealt by block, so that it isn't shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            first, numbers, packed = 0, [], []
            for i, n in enumerate(batch.column("chars").to_pylist()):
                if size and size + n > BLOCK_CHARS:
                    if i > first:
                        numbers.append(block)
                        packed.append(pack_rows(batch.slice(first, i - first)))
                    block, size, first = block + 1, 0, i
                size += n
            if batch.num_rows > first:
                numbers.append(block)
                packed.append(pack_rows(batch.slice(first)))
            for number, own in zip(numbers, packed):
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([own], pa.binary())], ["block", "packed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"))
    return materialize_dealt(rows.mapInArrow(run, "block long, packed binary"), "quality-blocks", "block")


def _asked(blocks: DataFrame) -> DataFrame:
    """block and gram: everything that the model may be asked for about each block's n-grams, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = set(), None

        def out() -> pa.RecordBatch:
            names = {g[k:] for g in held for k in range(ORDER)}
            names |= {g[k:-1] for g in held for k in range(ORDER - 1)}
            return pa.RecordBatch.from_arrays([pa.array([block] * len(names), pa.int64()), pa.array(list(names), pa.string())], ["block", "gram"])

        for batch in batches:
            for number, packed in zip(batch.column("block").to_pylist(), batch.column("packed")):
                if number != block and held:
                    yield out()
                    held.clear()
                block = number
                for some in chunks(unpack_rows(packed.as_buffer()).column("sequence").to_pylist()):
                    held.update(distinct_grams([p for _, p in some])[0])
        if held:
            yield out()

    return blocks.mapInArrow(run, "block long, gram string")


def _perplexities(docs: DataFrame, model: DataFrame) -> DataFrame:
    """doc_id, lang, perplexity and n_units of every row, by joins dealt by n-gram and then by block."""
    blocks = _in_blocks(docs)
    unseen = model.where("gram = ''").first()["p"]
    found = _asked(blocks).join(model.where("gram <> ''").hint("shuffle_merge"), "gram").select("block", "gram", "p", "gamma")
    top = {"": (None, model.where("gram = ''").first()["gamma"])}  # the weight of the empty history

    def score(rows: pa.Table, known: pa.Table) -> pa.Table:
        names = dict(zip(known.column("gram").to_pylist(), zip(known.column("p").to_pylist(), known.column("gamma").to_pylist()))) | top
        rows = pa.concat_tables([unpack_rows(x.as_buffer()) for x in rows.column("packed")])
        texts = rows.column("sequence").to_pylist()
        sums, units, logs = np.zeros(len(texts)), np.zeros(len(texts), np.int64), {}
        for some in chunks(texts):
            grams, number, starts = distinct_grams([p for _, p in some])
            own = np.empty(len(grams))
            for i, g in enumerate(grams):
                x = logs.get(g)
                if x is None:
                    x = logs[g] = gram_log_probability(g, names, unseen)
                own[i] = x
            at = [i for i, _ in some]
            np.add.at(sums, at, np.add.reduceat(own[number], starts))
            np.add.at(units, at, np.diff(np.append(starts, len(number))))
        perplexity = np.where(units > 0, np.exp(-sums / np.maximum(units, 1)), NO_WORDS)
        return pa.table([rows.column("doc_id"), rows.column("lang"), pa.array(perplexity), pa.array(units)], names=["doc_id", "lang", "perplexity", "n_units"])

    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(score, "doc_id long, lang string, perplexity double, n_units long")


def classify_quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """doc_id, lang, n_units, perplexity, threshold and keep of every whole text.

    threshold is `margin` times the quantile of the trusted documents' perplexities in the row's language, null where a
    language (null is one too) has none; such rows are kept, and so are texts without words, whose perplexity is 1. Without
    trusted text every score rests on the uniform distribution and all rows are kept. Repeated rows give repeated results; null doc_id is
    never trusted. The characters in MARKS count as white space. No rows: no rows. Other columns are ignored.
    """
    trusted = materialize(trusted_rows(docs, labels), "trusted")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull()).join(trusted, "doc_id")
    model = kneser_ney(materialize(_counts(texts), "kn-counts"))
    scored = materialize(_perplexities(docs, model), "perplexities")
    cut = scored.join(trusted, "doc_id", "left_semi").where("n_units > 0").groupBy(F.col("lang").alias("of")).agg((F.percentile_approx("perplexity", quantile, 10_000) * margin).alias("threshold"))
    cut = materialize(cut, "thresholds")
    out = scored.join(cut, scored["lang"].eqNullSafe(cut["of"]), "left")
    return out.select("doc_id", "lang", "n_units", "perplexity", "threshold", (F.col("threshold").isNull() | (F.col("n_units") == 0) | (F.col("perplexity") <= F.col("threshold"))).alias("keep"))


def query(spark, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
