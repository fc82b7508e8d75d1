"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Inputs of a word are a hashed embedding of the word and the largest values over hashed embeddings of its character n-grams. Two gated
recurrent passes read a window of words, attention pools their states, and a document's score is that of its worst window. Windows
overlap by half and cover the whole text. Embeddings start from log-odds of the label, counted by executors, and are trained by gradient with
the network. Since labels are of documents, each round trains on the windows that score highest now: executors choose them,
and only those (a few windows of a bounded sample of documents) reach the driver. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HELD_OUT, fold, map_rows, materialize, table

#: The model is fitted on about so many labelled documents, chosen by a hash of doc_id.
TRAIN_DOCS = 6_000
#: Windows a document gives to each round, by label; one more, by a hash, comes with label 0.
WINDOWS_EACH = {0: 2, 1: 1}
#: Passes over the windows of each round, and step sizes of the network and of the embeddings.
ROUNDS = ((4, 0.02, 0.05), (3, 0.01, 0.03), (3, 0.005, 0.02))
BUCKETS = 1 << 18
#: Steps of a round at least, for small samples.
STEPS = 150
PRIOR_DOCS = 4
HIDDEN, ATTENTION, DIMS = 6, 6, 4
INPUTS = 2 * DIMS
WINDOW, STRIDE = 48, 24
BATCH = 1_024
THRESHOLD = 0.3
CACHE_WORDS = 200_000
GRAMS = (3, 4, 5)
#: Lengths of word beginnings, which are told apart by whether the word goes on.
HEADS = (3, 4, 5, 6, 7, 8)
#: Words of a training window over so many characters count as empty there (scoring reads all of every word).
TRAIN_WORD = 100


def _hash(codes: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.full(max(0, len(codes) - n + 1), np.uint64(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        for i in range(n):
            h = (h ^ codes[i : len(codes) - n + 1 + i]) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(31)
    return (h >> np.uint64(44)).astype(np.int64) & (BUCKETS - 1)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word, buckets of all its character n-grams and beginnings, and where each word's start. Case and outer punctuation don't count."""
    bare = ["^" + w.lower().strip(".,;:!?\"'()[]{}|<>*_-") + "$$$" for w in words]
    lens = np.array([len(b) for b in bare], np.int64)
    codes = np.frombuffer("".join(bare).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.cumsum(lens) - lens
    with np.errstate(over="ignore"):
        h = codes * np.uint64(0x9E3779B97F4A7C15)
        pos = np.arange(len(codes)) - np.repeat(starts, lens)
        h = (h ^ (h >> np.uint64(32))) * (2 * pos + 1).astype(np.uint64)
        h ^= h >> np.uint64(29)
        word = np.add.reduceat(h, starts) * np.uint64(0xC4CEB9FE1A85EC53)
    per = []
    for n in GRAMS:
        g = np.zeros(len(codes), np.int64)
        own = _hash(codes, n)
        g[: len(own)] = own
        per.append(g)
    left = lens - 3  # n-grams may reach into the padding but not past it
    inside = pos < np.repeat(left, lens)
    grams = np.stack(per, axis=1)[inside].ravel()
    owner = np.repeat(np.repeat(np.arange(len(bare)), left), len(GRAMS))
    sums, heads, whose = np.cumsum(np.concatenate([[0], h]), dtype=np.uint64), [], []
    for n in HEADS:
        has = np.flatnonzero(left > n)
        goes_on = (left[has] > n + 1).astype(np.uint64)
        with np.errstate(over="ignore"):
            x = (sums[starts[has] + n + 1] - sums[starts[has]] + goes_on + np.uint64(2 * n)) * np.uint64(0xFF51AFD7ED558CCD)
            x = (x ^ (x >> np.uint64(33))) * np.uint64(0x9E3779B97F4A7C15)
        heads.append((x >> np.uint64(44)).astype(np.int64) & (BUCKETS - 1))
        whose.append(has)
    owner = np.concatenate([owner, *whose])
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(bare))
    return (word >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1), np.concatenate([grams, *heads])[order], np.cumsum(counts) - counts


def windows(ids: np.ndarray) -> np.ndarray:
    """Overlapping windows of word ids, padded with 0; at least one, and the last reaches the end."""
    n = max(1, -(-max(0, len(ids) - WINDOW) // STRIDE) + 1)
    padded = np.zeros((n - 1) * STRIDE + WINDOW, np.int64)
    padded[: len(ids)] = ids
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Weights of both directions, attention and output; inputs come as x @ W + b per word."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        scale = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"v": scale(ATTENTION), "A": scale(2 * HIDDEN, ATTENTION), "u": scale(2 * HIDDEN), "c": np.array([-1.0], np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": scale(INPUTS, 3 * HIDDEN), f"B{d}": np.zeros(3 * HIDDEN, np.float32), f"U{d}": scale(HIDDEN, 3 * HIDDEN)}
        self.m = {k: np.zeros_like(x) for k, x in self.p.items()}
        self.s = {k: np.zeros_like(x) for k, x in self.p.items()}
        self.t = 0

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x @ self.p["Wf"] + self.p["Bf"], x @ self.p["Wb"] + self.p["Bb"]

    def _pass(self, proj: np.ndarray, ids: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        b, w = ids.shape
        h, U = np.zeros((b, HIDDEN), np.float32), self.p[f"U{d}"]
        out = np.empty((w, b, HIDDEN), np.float32)
        for t in range(w) if d == "f" else range(w - 1, -1, -1):
            x, g = proj[ids[:, t]], h @ U
            zr = _sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(x[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
            new = (n + z * (h - n)) * mask[t]
            if keep is not None:
                keep.append((t, h, z, r, n, g[:, 2 * HIDDEN :]))
            h = out[t] = new
        return out

    def forward(self, pf: np.ndarray, pb: np.ndarray, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        mask = (ids > 0).T.astype(np.float32)[:, :, None]
        kf, kb = ([], []) if keep is not None else (None, None)
        h = np.concatenate([self._pass(pf, ids, mask, "f", kf), self._pass(pb, ids, mask, "b", kb)], axis=2)
        a = np.tanh(h @ self.p["A"])
        e = (a @ self.p["v"]) + (mask[:, :, 0] - 1) * 30
        e = np.exp(e - e.max(axis=0))
        alpha = e / e.sum(axis=0)
        pooled = (alpha[:, :, None] * h).sum(axis=0)
        y = _sigmoid(pooled @ self.p["u"] + self.p["c"][0])
        if keep is not None:
            keep |= {"mask": mask, "kf": kf, "kb": kb, "h": h, "a": a, "alpha": alpha, "pooled": pooled, "y": y}
        return y

    def gradients(self, x: np.ndarray, ids: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients, of the weighted cross-entropy on windows `ids` of the words with inputs x, by weights and by x."""
        pf, pb = self.project(x)
        k: dict = {}
        y, g = self.forward(pf, pb, ids, k), {}
        dy = ((y - label) * weight / weight.sum()).astype(np.float32)
        g["u"], g["c"] = k["pooled"].T @ dy, np.array([dy.sum()], np.float32)
        dp = dy[:, None] * self.p["u"]
        dh = k["alpha"][:, :, None] * dp
        da = (k["h"] * dp).sum(axis=2)
        de = k["alpha"] * (da - (k["alpha"] * da).sum(axis=0))
        dt = de[:, :, None] * self.p["v"] * (1 - k["a"] ** 2)
        g["v"] = (k["a"] * de[:, :, None]).sum(axis=(0, 1))
        g["A"] = np.einsum("tbh,tba->ha", k["h"], dt)
        dh = dh + dt @ self.p["A"].T
        dx_all = np.zeros((ids.shape[1], ids.shape[0], x.shape[1]), np.float32)
        for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            U, back = self.p[f"U{d}"], np.zeros((ids.shape[0], HIDDEN), np.float32)
            gU, gW, gB = np.zeros_like(U), np.zeros_like(self.p[f"W{d}"]), np.zeros(3 * HIDDEN, np.float32)
            for t, h, z, r, n, gn in reversed(k["k" + d]):
                s = (dh[t][:, part] + back) * k["mask"][t]
                dn = s * (1 - z) * (1 - n * n)
                dz = s * (h - n) * z * (1 - z)
                dr = dn * gn * r * (1 - r)
                dx = np.concatenate([dz, dr, dn], axis=1)
                dg = np.concatenate([dz, dr, dn * r], axis=1)
                gU += h.T @ dg
                gW += x[ids[:, t]].T @ dx
                gB += dx.sum(axis=0)
                dx_all[t] += dx @ self.p[f"W{d}"].T
                back = s * z + dg @ U.T
            g |= {f"U{d}": gU, f"W{d}": gW, f"B{d}": gB}
        at = ids.T.ravel()
        return g, np.stack([np.bincount(at, dx_all[:, :, i].ravel(), len(x)) for i in range(x.shape[1])], axis=1).astype(np.float32)

    def step(self, g: dict[str, np.ndarray], rate: float) -> None:
        """One Adam step."""
        self.t += 1
        for name, p in self.p.items():
            q = np.clip(g[name], -1, 1)
            self.m[name] = 0.9 * self.m[name] + 0.1 * q
            self.s[name] = 0.99 * self.s[name] + 0.01 * q * q
            p -= rate * (self.m[name] / (1 - 0.9**self.t)) / (np.sqrt(self.s[name] / (1 - 0.99**self.t)) + 1e-6)


def pooled(gram: np.ndarray, grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Largest values over each word's n-grams."""
    return np.maximum.reduceat(gram[grams], starts)


class Model:
    """Embeddings and network; scores texts."""

    def __init__(self, word: np.ndarray, gram: np.ndarray, net: Network):
        self.word, self.gram, self.net = word, gram, net
        self._forget()

    def __getstate__(self):
        return {"word": self.word, "gram": self.gram, "net": dict(self.net.p)}

    def __setstate__(self, s):
        net = Network()
        net.p = s["net"]
        self.__init__(s["word"], s["gram"], net)

    def _forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.n = 1
        self.pf, self.pb = self.net.project(np.zeros((1 << 12, INPUTS), np.float32))

    def _learn(self, words: list[str]) -> None:
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            w, grams, at = word_features(part)
            while self.n + len(part) > len(self.pf):
                self.pf, self.pb = (np.concatenate([a, np.zeros_like(a)]) for a in (self.pf, self.pb))
            new = slice(self.n, self.n + len(part))
            self.pf[new], self.pb[new] = self.net.project(np.concatenate([self.word[w], pooled(self.gram, grams, at)], axis=1))
            self.ids.update(zip(part, range(self.n, self.n + len(part))))
            self.n += len(part)

    def look_up(self, words: list[str]) -> np.ndarray:
        new = set(words).difference(self.ids)
        if new:
            self._learn(sorted(new))
        return np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))

    def score(self, texts: list[str | None]) -> np.ndarray:
        """The worst window's score of each text; texts without words: one empty window."""
        return np.array([y.max() for y in self.window_scores(texts)], float)

    def window_scores(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Scores of all windows of each text."""
        held: list[np.ndarray] = []
        n = 0

        def flush() -> list[np.ndarray]:
            nonlocal held, n
            if not held:
                return []
            ids = np.concatenate(held)
            y = np.concatenate([self.net.forward(self.pf, self.pb, ids[i : i + BATCH]) for i in range(0, len(ids), BATCH)])
            done = np.split(y, np.cumsum([len(w) for w in held])[:-1])
            held, n = [], 0
            return done

        for t in texts:
            if len(self.ids) > CACHE_WORDS:
                yield from flush()
                self._forget()
            w = windows(self.look_up((t or "").split()))
            held.append(w)
            n += len(w)
            if n >= 8 * BATCH:
                yield from flush()
        yield from flush()


def log_odds(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Log-odds of label 1 where a bucket is present against the base rate, shrunken by PRIOR_DOCS documents of the base rate."""
    base = (n_pos + 0.5) / (n_pos + n_neg + 1)
    rate = (pos + PRIOR_DOCS * base) / (pos + neg + PRIOR_DOCS)
    return np.clip(np.log(rate / (1 - rate)) - np.log(base / (1 - base)), -4, 5).astype(np.float32)


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """word_features() of many words, some at a time, in 32 bits, and where each word's end."""
    parts = [word_features(words[i : i + 5_000]) for i in range(0, len(words), 5_000)]
    bucket, grams = (np.concatenate([p[k].astype(np.int32) for p in parts]) for k in (0, 1))
    counts = np.concatenate([np.diff(np.append(p[2], len(p[1]))) for p in parts])
    ends = np.cumsum(counts)
    return bucket, grams, ends - counts, ends


class Trainer:
    """Embeddings and network as they are trained: what the counts give, by half of the documents, and what gradients have added."""

    def __init__(self, start: dict[tuple[str, int], np.ndarray], seed: int = 7):
        r = np.random.default_rng(seed)
        self.start, self.net, self.random = start, Network(seed), r
        self.added = {k: (0.1 * r.standard_normal((BUCKETS, DIMS))).astype(np.float32) for k in ("word", "gram")}
        for k in self.added:
            self.added[k][:, 0] = 0
        self.seen = {k: np.full((BUCKETS, DIMS), 1e-4, np.float32) for k in ("word", "gram")}

    def table(self, kind: str, half: int) -> np.ndarray:
        """Embeddings with the counts of one half's documents (2: of all)."""
        out = self.added[kind].copy()
        out[:, 0] += self.start[kind, half]
        return out

    def model(self, half: int = 2) -> Model:
        return Model(self.table("word", half), self.table("gram", half), self.net)

    def fit(self, found: pd.DataFrame, passes: int, rate: float, embedding_rate: float, batch: int = 256) -> None:
        """Gradient steps on the windows (half, label, window) given; a half's windows see the counts of the other half, as new texts will."""
        words: dict[tuple[int, str], int] = {}
        ids = np.zeros((len(found), WINDOW), np.int64)
        for i, (half, text) in enumerate(zip(found["half"], found["window"])):
            own = [words.setdefault((half, w), len(words) + 1) for w in text.split(" ")[:WINDOW]] if text else []
            ids[i, : len(own)] = own
        if not words:
            return
        half = np.array([0] + [1 - h for h, _ in words])
        bucket, grams, starts, ends = _features([""] + [w for _, w in words])
        label = found["label"].to_numpy(np.float32)
        weight = np.where(label == 1, 0.5 * (label == 0).sum() / max(1, label.sum()), 1.0).astype(np.float32)
        for _ in range(max(passes, -(-STEPS // -(-len(found) // batch)))):
            order = self.random.permutation(len(found))
            for i in range(0, len(order), batch):
                pick = order[i : i + batch]
                own, small = np.unique(np.append(ids[pick].ravel(), 0), return_inverse=True)
                small = small[:-1].reshape(len(pick), WINDOW)
                n = ends[own] - starts[own]
                first = np.cumsum(n) - n
                g = grams[np.repeat(starts[own] - first, n) + np.arange(n.sum())]
                e = self.added["gram"][g]
                e[:, 0] += np.stack([self.start["gram", 0], self.start["gram", 1]])[np.repeat(half[own], n), g]
                top = np.maximum.reduceat(e, first)
                x = np.concatenate([self.added["word"][bucket[own]], top], axis=1)
                x[:, 0] += np.stack([self.start["word", 0], self.start["word", 1]])[half[own], bucket[own]]
                x[0] = 0
                grad, gx = self.net.gradients(x, small, label[pick], weight[pick])
                self.net.step(grad, rate)
                gx[0] = 0
                for d in range(DIMS):
                    self._descend("word", bucket[own], d, gx[:, d], embedding_rate)
                    best = np.flatnonzero(e[:, d] == np.repeat(top[:, d], n))  # where the largest values stand
                    owner = np.searchsorted(first, best, side="right") - 1
                    self._descend("gram", g[best], d, gx[owner, DIMS + d], embedding_rate)

    def _descend(self, kind: str, at: np.ndarray, d: int, grad: np.ndarray, rate: float) -> None:
        rows, where = np.unique(at, return_inverse=True)
        total = np.bincount(where, grad, len(rows)).astype(np.float32)
        self.seen[kind][rows, d] += total * total
        self.added[kind][rows, d] -= rate * total / np.sqrt(self.seen[kind][rows, d])


def _half(doc_id) -> int:
    return zlib.crc32(f"half {doc_id}".encode()) & 1


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each label that hold each bucket, by half; kind 0 counts words, 1 their parts, and 2 documents."""
    sums = {(k, h, y): np.zeros(BUCKETS, np.int32) for k in ("word", "gram") for h in (0, 1) for y in (0, 1)}
    docs = np.zeros((2, 2), np.int64)
    for batch in batches:
        for doc_id, text, label in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "label"))):
            h = _half(doc_id)
            docs[h, label] += 1
            words = sorted(set(text.split()))
            if words:
                for k, x in zip(("word", "gram"), word_features(words)):
                    sums[k, h, label][np.unique(x)] += 1
    for n, k in enumerate(("word", "gram")):
        at = np.flatnonzero(sum(sums[k, h, y] for h in (0, 1) for y in (0, 1)))
        yield pa.RecordBatch.from_pydict({"kind": np.full(len(at), n, np.int8), "bucket": at.astype(np.int32)} | {f"n{h}{y}": sums[k, h, y][at] for h in (0, 1) for y in (0, 1)}, COUNTED)
    yield pa.RecordBatch.from_pydict({"kind": [2], "bucket": [0]} | {f"n{h}{y}": [int(docs[h, y])] for h in (0, 1) for y in (0, 1)}, COUNTED)


COUNTED = pa.schema([("kind", pa.int8()), ("bucket", pa.int32()), *((f"n{h}{y}", pa.int32()) for h in (0, 1) for y in (0, 1))])
CHOSEN = pa.schema([("doc_id", pa.int64()), ("place", pa.int32()), ("half", pa.int32()), ("label", pa.int32()), ("window", pa.string())])


def _choose(rows: DataFrame, models: list[Model]) -> pd.DataFrame:
    """The windows of each training document that score highest under the other half's model, and one by a hash; in a fixed order."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, label in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "label"))):
                h, words = _half(doc_id), [w if len(w) <= TRAIN_WORD else "" for w in text.split()]
                (y,) = shared.value[1 - h].window_scores([text])
                pick = set(np.lexsort((np.arange(len(y)), -y))[: WINDOWS_EACH[label]].tolist())
                if not label:
                    pick.add(zlib.crc32(f"any {doc_id}".encode()) % len(y))
                out += [(doc_id, i, h, label, " ".join(words[i * STRIDE : i * STRIDE + WINDOW])) for i in sorted(pick)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out) if out else [[]] * 5, CHOSEN)], schema=CHOSEN)

    found = rows.mapInArrow(run, "doc_id long, place int, half int, label int, window string").toArrow().to_pandas()  # at most three short windows of each of TRAIN_DOCS documents
    return found.sort_values(["doc_id", "place"], ignore_index=True)


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model | float:
    """Fit on labelled documents of the folds other than 2, about `train_docs` of them.

    A document with several labels counts as toxic if one is; of several rows with one doc_id the least text is taken. The
    score is constant if labels are all alike (0.0 without any).
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("label"))
    own = materialize(own, "toxicity-labels")
    n = own.count()
    if n > train_docs:
        own = materialize(own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * train_docs / n)), "toxicity-labels")  # small: Spark sends it to the documents
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull()).join(own, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    rows = materialize(rows, "toxicity-train")
    sums = [F.sum(c).cast("int").alias(c) for c in COUNTED.names[2:]]
    counted = rows.mapInArrow(_count_features, "kind tinyint, bucket int, n00 int, n01 int, n10 int, n11 int").groupBy("kind", "bucket").agg(*sums)
    several = (F.col("kind") == 2) | (F.expr("n00 + n01 + n10 + n11") > 1)  # what one document alone has says nothing
    counts = counted.where(several).toArrow()  # at most 2 BUCKETS + 1 short rows
    kind, bucket = (counts.column(c).to_numpy() for c in ("kind", "bucket"))
    n = {c: counts.column(c).to_numpy() for c in COUNTED.names[2:]}
    docs_of = {c: int(v[kind == 2].sum()) for c, v in n.items()}
    if not docs_of["n01"] + docs_of["n11"] or not docs_of["n00"] + docs_of["n10"]:
        return float(docs_of["n01"] + docs_of["n11"] > 0)
    start = {}
    for i, name in enumerate(("word", "gram")):
        for h in (0, 1, 2):
            both = []
            for y in (1, 0):
                halves = [f"n{h}{y}"] if h < 2 else [f"n0{y}", f"n1{y}"]
                dense = np.zeros(BUCKETS)
                dense[bucket[kind == i]] = sum(n[c][kind == i] for c in halves)
                both.append((dense, sum(docs_of[c] for c in halves)))
            start[name, h] = log_odds(both[0][0], both[1][0], both[0][1], both[1][1])
    del counts, kind, bucket, n
    trainer = Trainer(start)
    found = _choose(rows, [_Largest(start["word", h], start["gram", h]) for h in (0, 1)])
    for k, (passes, rate, embedding_rate) in enumerate(ROUNDS):
        if k:
            more = _choose(rows, [trainer.model(h) for h in (0, 1)])
            found = pd.concat([found, more]).drop_duplicates(["doc_id", "place"]).sort_values(["doc_id", "place"], ignore_index=True)
        trainer.fit(found, passes, rate, embedding_rate)
    return trainer.model()


class _Largest:
    """Scores of windows before the first round: the largest statistic in them."""

    def __init__(self, word: np.ndarray, gram: np.ndarray):
        self.word, self.gram = word, gram

    def window_scores(self, texts: list[str]) -> Iterator[np.ndarray]:
        for t in texts:
            words = t.split()
            if not words:
                yield np.zeros(1)
                continue
            known = {w: i + 1 for i, w in enumerate(dict.fromkeys(words))}
            bucket, grams, starts = word_features(list(known))
            value = np.append([-9.0], np.maximum(self.word[bucket], np.maximum.reduceat(self.gram[grams], starts)))
            yield value[windows(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))].max(axis=1)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text.

    Null, empty or blank text is scored as one window without words. Without labels every score is 0.0. Null doc_id counts
    as the text 'null' for the fold and is never learned from. Repeated rows give repeated results; no rows: no rows. Other
    columns are ignored.
    """
    return _scored(docs, labels, threshold, train_docs, False)


def score_rows(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """The same with the row that was scored beside it, as struct given_row: judges rows, whatever their ids. Executors send a text to Python once, in that row."""
    return _scored(docs, labels, threshold, train_docs, True)


def _scored(docs: DataFrame, labels: DataFrame, threshold: float, train_docs: int, whole: bool) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, train_docs))

    def score(columns: dict[str, list]) -> dict:
        m, texts = model.value, columns["text"]
        y = m.score(texts) if isinstance(m, Model) else np.full(len(texts), m)
        return {"score": y, "predicted": (y >= threshold).astype(np.int32)}

    text = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("given_row") if whole else F.col("text")
    within = {"text": ("given_row", [c.lower() for c in docs.columns].index("text"))} if whole else None
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), text)
    return map_rows(rows, score, ["text"], "score double, predicted int", within=within)


def query(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
