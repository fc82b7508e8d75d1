"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counts are taken over at most about TRAIN_DOCS documents of the training folds, chosen by a hash of doc_id with a threshold
that follows from their number, and summed by language and bucket by executors. Log-probabilities go out in matrices of BLOCK languages,
one broadcast each, so any number of languages can be told apart. Scoring is one pass without a shuffle: the n-grams of a batch are the entries
of a sparse document x bucket matrix, which is multiplied with the log-probabilities in numpy; each block of languages adds to what rows carry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HELD_OUT, fold, map_rows, materialize, table

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: The classifier is fitted on at most about so many labelled documents.
TRAIN_DOCS = 20_000
#: Languages of a matrix.
BLOCK = 64
#: Code points worked on at once; longer texts go in pieces that know the end of the one before.
PIECE = 1 << 18


def _pieces(text: str) -> Iterator[tuple[np.ndarray, int]]:
    """Lower-cased code points, with each run of other than letters as one space, and spaces around; in pieces, with how many of each were in the one before."""
    text = text.lower()
    tail, other_before = np.array([32], np.uint32), True  # a space stands before the text
    held = 0
    for i in range(0, max(1, len(text)), PIECE):
        a = np.frombuffer(text[i : i + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        other = (a < 65) | ((a > 90) & (a < 97)) | ((a > 122) & (a < 170))
        again = other & np.concatenate([[other_before], other[:-1]])[: len(other)]
        if len(other):
            other_before = bool(other[-1])
        a = np.where(other, np.uint32(32), a)[~again]
        if i + PIECE >= len(text):
            a = np.append(a, np.zeros(0, np.uint32) if other_before else np.array([32], np.uint32))
        yield np.concatenate([tail, a]).astype(np.uint32), held
        tail = np.concatenate([tail, a])[-(max(ORDERS) - 1) :]
        held = len(tail)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def hashed(codes: np.ndarray, held: int = 0) -> np.ndarray:
    """Bucket numbers of all n-grams of the orders that end after the first `held` code points."""
    c, out = codes.astype(np.uint64), []
    with np.errstate(over="ignore"):
        for n in ORDERS:
            c_n = c[max(0, held - n + 1) :]
            if len(c_n) < n:
                continue
            h = np.full(len(c_n) - n + 1, np.uint64(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            for i in range(n):
                h = (h ^ c_n[i : len(c_n) - n + 1 + i]) * np.uint64(0xFF51AFD7ED558CCD)
                h ^= h >> np.uint64(29)
            out.append((h >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def text_buckets(text: str | None) -> Iterator[np.ndarray]:
    for codes, held in _pieces(text or ""):
        yield hashed(codes, held)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, bucket (BUCKETS: documents) and n, summed by task; at most BLOCK languages are held."""
    sums: dict[str, np.ndarray] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(v[at])], ["lang", "bucket", "n"])
        sums.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            if lang not in sums and len(sums) >= BLOCK:
                yield from out()
            v = sums.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
            v[BUCKETS] += 1
            for h in text_buckets(text):
                v[:BUCKETS] += np.bincount(h, minlength=BUCKETS)
    yield from out()


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Iterator[tuple[list[str], np.ndarray]]:
    """Blocks of languages in order and their matrices of log-probabilities, the prior in the last row. Rows with null lang or text teach nothing."""
    own = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT))
    n = own.count()
    if n > train_docs:
        own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * train_docs / n))
    counts = materialize(own.select("lang", "text").mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "lang-counts")
    langs = [(r["lang"], r["n"]) for r in counts.where(F.col("bucket") == BUCKETS).orderBy("lang").select("lang", "n").toLocalIterator()]  # a row for each language
    total = sum(n for _, n in langs)
    for i in range(0, len(langs), BLOCK):
        names = [x for x, _ in langs[i : i + BLOCK]]
        rows = counts.where((F.col("bucket") < BUCKETS) & F.col("lang").isin(names)).toArrow()  # at most BLOCK x BUCKETS rows
        place = {x: k for k, x in enumerate(names)}
        grams = np.full((BUCKETS, len(names)), 0.5)
        grams[rows.column("bucket").to_numpy(), [place[x] for x in rows.column("lang").to_pylist()]] += rows.column("n").to_numpy()
        prior = np.log([n / total for _, n in langs[i : i + BLOCK]])
        yield names, np.concatenate([np.log(grams / grams.sum(axis=0)), prior[None, :]]).astype(np.float32)


def score_sums(texts: list[str | None], logp: np.ndarray) -> np.ndarray:
    """Log-likelihood and prior of each text in each language of a matrix: the product of the batch's sparse matrix of n-grams, some entries at a time."""
    sums = np.zeros((len(texts), logp.shape[1]))
    entries: list[np.ndarray] = []
    rows: list[int] = []
    n = 0

    def multiply() -> None:
        nonlocal entries, rows, n
        if entries:
            starts = np.cumsum([0, *map(len, entries[:-1])])
            np.add.at(sums, rows, np.add.reduceat(logp[np.concatenate(entries)], starts, axis=0, dtype=np.float64))
        entries, rows, n = [], [], 0

    for i, t in enumerate(texts):
        for h in text_buckets(t):
            if len(h):
                entries.append(h)
                rows.append(i)
                n += len(h)
                if n * logp.shape[1] >= 1 << 21:
                    multiply()
    multiply()
    return sums + logp[BUCKETS]


def _add_block(rows: DataFrame, names: list[str], logp: np.ndarray) -> DataFrame:
    """rows with lang_pred, best and mass (the log of the summed likelihoods) over the languages so far and these."""
    model = rows.sparkSession.sparkContext.broadcast((names, logp))

    def run(columns: dict[str, list]) -> dict:
        langs, matrix = model.value
        s = score_sums(columns["text"], matrix)
        at = s.argmax(axis=1)
        own = s[np.arange(len(s)), at] if len(s) else np.zeros(0)
        mass = own + np.log(np.exp(s - own[:, None]).sum(axis=1))
        out: dict[str, list] = {"text": columns["text"], "lang_pred": [], "best": [], "mass": []}
        for lang, best, total, k, x, m in zip(columns["lang_pred"], columns["best"], columns["mass"], at, own, mass):
            first = best is None
            out["lang_pred"].append(langs[k] if first or x > best else lang)
            out["best"].append(float(x if first else max(x, best)))
            out["mass"].append(float(m if first else np.logaddexp(m, total)))
        return out

    return map_rows(rows, run, ["text", "lang_pred", "best", "mass"], "text string, lang_pred string, best double, mass double")


def identify_language(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text.

    Learns from text and non-null lang of the folds other than 2. Null text or text without a letter: 'und' with score
    0.0; so is everything if there is nothing to learn from. A tie goes to the language that sorts first. Null doc_id
    counts as the text 'null' for the fold. Repeated rows give repeated results; no rows: no rows. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "text", F.lit(None).cast("string").alias("lang_pred"), F.lit(None).cast("double").alias("best"), F.lit(None).cast("double").alias("mass"))
    for names, logp in train(docs, train_docs):
        rows = _add_block(rows, names, logp)

    def finish(columns: dict[str, list]) -> dict:
        known = [has_letter(t) and p is not None for t, p in zip(columns["text"], columns["lang_pred"])]
        return {
            "lang_pred": [p if k else "und" for k, p in zip(known, columns["lang_pred"])],
            "score": [float(np.exp(min(0.0, b - m))) if k else 0.0 for k, b, m in zip(known, columns["best"], columns["mass"])],
        }

    return map_rows(rows, finish, ["text", "lang_pred", "best", "mass"], "lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))
