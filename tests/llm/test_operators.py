"""The ten operators and the pipeline against brute force, SQL, exact round trips and held-out accuracy."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from conftest import SMALL, bag
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tiktoken import Encoding
from tiktoken.load import load_tiktoken_bpe

import corpus_pipeline
from lodestone.llm import bpe, embedding_dedup, exact_dedup, jaccard_join, language_id, mixing, pii, quality_lm, queries, suffix_dedup, toxicity
from lodestone.llm.common import table

MIDDLE = "/root/testdata/sf0.01"
CLASH = ("cls", "n", "size", "target", "tokens", "digest", "kept", "row_key", "component_id", "gram", "spans", "toxic_label", "__bad_id", "__kept_id")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
LONG = " ".join(f"longword{i * 7919 % 5003}" for i in range(15_000))
ROWS = [
    (1, "Hello WORLD foo bar baz qux quux", "en", "a"), (2, "hello world foo bar baz qux quux", "en", "a"), (3, None, "en", None), (4, "", None, "b"),
    (5, " \t\n", None, None), (None, "a null id and some words to go with it", "en", "c"), (None, "A null id and some words to go with it", "de", "c"),
    (6, "one row given twice, call +44 20 7946 0958 or a.b@c.org", "de", "b"), (6, "one row given twice, call +44 20 7946 0958 or a.b@c.org", "de", "b"),
    (7, LONG, "en", "a"), (8, "one", None, "a"), (9, "ONE", "en", None), (10, "İstanbul straße nbsp \U0001f600 x", None, "é"), (11, "4111 1111 1111 1111 at 10.0.0.1 and 256.1.1.1", "en", "b"),
]


STEPS = toxicity.STEPS


@pytest.fixture(autouse=True)
def short_training(monkeypatch):
    """Tests that don't measure the network train it briefly; test_toxicity_held_out sets the production value again."""
    monkeypatch.setattr(toxicity, "STEPS", 8)


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame([r + (None,) + tuple("x" if i % 2 else None for i in range(len(CLASH))) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (7, 1, 0), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")


def rows_of(df, *cols):
    return Counter(map(tuple, df.select(*cols).collect()))


# 1: personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            sums = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(d) <= 19 and sums % 10 == 0, "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="0123459.@+- ()aZ%_é\n", max_size=60))
def test_pii_spans_equal_plain_patterns(text):
    assert [s[:3] for s in pii.find_spans(text) if s[0] in BASE] == brute_spans(text)


def test_pii_query(spark):
    got = {r["doc_id"]: r for r in pii.query(spark, SMALL).collect()}
    docs = table(spark, SMALL, "documents").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        want = brute_spans(d["text"])
        assert got[d["doc_id"]]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()


def test_pii_edges(messy):
    got = pii.detect_pii(messy).collect()
    assert len(got) == len(ROWS) and pii.detect_pii(messy.limit(0)).count() == 0
    found = lambda t: [(k, t[s:e], x) for k, s, e, x in pii.find_spans(t)]
    assert found("IBAN GB82 WEST 1234 5698 7654 32 OK then") == [("iban", "GB82 WEST 1234 5698 7654 32", 1.0)]
    assert found("x GB82WEST12345698765432 y DE89370400440532013000.") == [("iban", "GB82WEST12345698765432", 0.9), ("iban", "DE89370400440532013000", 0.9)]
    assert not found("GB82 WEST 1234 5698 7654 33") and not found("ssn 000-12-3456 or 666-12-3456, 901-12-3456, 123-00-3456, 123-45-0000")
    assert found("his ssn is 123-45-6789") == [("ssn", "123-45-6789", 0.5)] and not found("part 123-45-6789")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765431")


# 2: embeddings


def test_embeddings(spark):
    r = np.random.default_rng(3)
    centres, rows = r.standard_normal((12, 8)), []
    for i in range(600):
        v = centres[i % 12] + r.choice([0.0, 0.02, 0.08, 0.4]) * r.standard_normal(8)
        rows.append([i, [float(x) for x in v], int(i % 3)])
    rows += [[600 + i, rows[5][1], rows[5][2]] for i in range(20)]
    rows += [[700, None, 1], [701, [0.0] * 8, 1], [702, [1.0, None] + [0.0] * 6, 1], [703, [math.nan] * 8, 1], [704, rows[5][1], None], [705, [math.inf] + [0.0] * 7, 1], [706, [], 1], [707, [1.0, 2.0], 1], [708, [2.0, 4.0], 1]]
    df = spark.createDataFrame([(*x, "x", "y") for x in rows], "vec_id long, embedding array<double>, label long, cls string, copies string")
    got = {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in embedding_dedup.near_duplicates(df).collect()}
    ok = [i for i, x in enumerate(rows) if x[2] is not None and embedding_dedup.usable(x[1])]
    links = defaultdict(set)
    for i in ok:
        for j in ok:
            a, b = rows[i], rows[j]
            if i != j and a[2] == b[2] and len(a[1]) == len(b[1]) and np.dot(a[1], b[1]) / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.98:
                links[a[0]].add(b[0])
    least = smallest(links, [x[0] for x in rows])
    assert got == {x[0]: (len(links[x[0]]), least[x[0]], least[x[0]] == x[0]) for x in rows}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_cells_lose_no_pair():
    r = np.random.default_rng(1)
    u = r.standard_normal((400, 6))
    u = np.concatenate([u, u + 0.05 * r.standard_normal(u.shape)])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    radius = math.sqrt(0.04)
    home, near = embedding_dedup.cells(u, embedding_dedup.pivots_of(u, 30), radius)
    for i, j in np.argwhere(u @ u.T >= 0.98):
        assert near[j, home[i]]


@pytest.mark.parametrize("block", [1000, 7])
def test_near_copies_are_not_compared(spark, monkeypatch, block):
    """Near copies of a few vectors: links as by brute force, and many of them stand in cores, whose pairs are counted and not compared."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    seen, pairs = {}, []
    for each in (20, 80):
        r = np.random.default_rng(each)
        centres = r.standard_normal((6, 64))
        centres[1] = centres[0] + 0.17 * r.standard_normal(64)  # balls that visit one another
        spread = np.where(r.random(6 * each) < 0.1, 0.13, 0.08)[:, None]
        u = np.concatenate([np.repeat(centres, each, axis=0) + spread * r.standard_normal((6 * each, 64)), r.standard_normal((10, 64))])
        label = [0 if i < 2 * each else i % 2 for i in range(len(u))]
        df = spark.createDataFrame([(i, [float(c) for c in x], k) for i, (x, k) in enumerate(zip(u, label))], "vec_id long, embedding array<double>, label long")
        got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in embedding_dedup.near_duplicates(df).collect()}
        n = u / np.linalg.norm(u, axis=1, keepdims=True)
        ok = (n @ n.T >= 0.98) & (np.array(label)[:, None] == np.array(label)[None, :])
        links = {i: set(np.flatnonzero(ok[i]).tolist()) - {i} for i in range(len(u))}
        least = smallest(links, range(len(u)))
        assert got == {i: (len(links[i]), least[i]) for i in range(len(u))}
        found = embedding_dedup.balls_of(pd.DataFrame({"label": label, "vec": [x.tobytes() for x in u]}))
        place = np.concatenate([embedding_dedup.places(n[[i for i, k in enumerate(label) if k == own]], c, 0.98)[2] for own, c in found.items()])
        seen[each] = (place == embedding_dedup.CORE).mean()
        pairs.append(sum(map(len, links.values())))
    assert min(seen.values()) > 0.3 and pairs[1] > 10 * pairs[0]


def smallest(links, nodes):
    out = {}
    for n in sorted(nodes):
        front = [n] if n not in out else []
        while front:
            x = front.pop()
            if x not in out:
                out[x] = n
                front += links[x]
    return out


# 3: mixing


def sql_over(df, sql):
    db = duckdb.connect()
    db.register("documents", df.select("doc_id", "text", "source").toArrow())
    want = db.sql(sql)
    return bag(want.columns, want.fetchall())


def mix_query(docs):
    from pyspark.sql import functions as F

    return mixing.plan_mix(docs).select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


def test_mixing(spark, messy, same_as_sql):
    same_as_sql(mixing.query(spark, SMALL), mixing.SQL)
    one = mix_query(messy)
    assert bag(one.columns, map(tuple, one.collect())) == sql_over(messy, mixing.SQL)
    assert mixing.mix(messy).columns == messy.columns and mixing.mix(messy.limit(0)).count() == 0


# 4: toxicity


def test_toxicity_held_out(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", STEPS)
    docs, marks = table(spark, MIDDLE, "documents"), table(spark, MIDDLE, "labels")
    got = toxicity.score_toxicity(docs, marks).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, h in zip(got["doc_id"], got["held_out"]))
    own = got[got["held_out"]].merge(marks.toPandas().dropna(subset=["toxic"]), on="doc_id")
    bad, good = own[own["toxic"] == 1]["score"].to_numpy(), own[own["toxic"] == 0]["score"].to_numpy()
    assert len(bad) and len(good)
    assert (bad[:, None] > good[None, :]).mean() > 0.9


def test_toxicity_edges(messy, labels):
    got = toxicity.score_toxicity(messy, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["score"] == 0 for r in toxicity.score_toxicity(messy, labels.limit(0)).collect())
    assert toxicity.score_toxicity(messy.limit(0), labels).count() == 0


def test_network_by_hand():
    """The forward pass, word by word, and its gradients by small differences."""
    r = np.random.default_rng(5)
    net = toxicity.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = r.standard_normal((7, toxicity.INPUTS))
    x[0] = 0
    ids = np.zeros((3, toxicity.WINDOW), np.int64)
    for i, n in enumerate((1, 5, 9)):
        ids[i, :n] = r.integers(1, 7, n)
    sig = lambda v: 1 / (1 + np.exp(-v))

    def by_hand(words):
        states = []
        for d in "fb":
            h, out = np.zeros(toxicity.HIDDEN), {}
            for t in range(len(words)) if d == "f" else reversed(range(len(words))):
                a, g, k = x[words[t]] @ net.p["W" + d] + net.p["B" + d], h @ net.p["U" + d], toxicity.HIDDEN
                z, q = sig(a[:k] + g[:k]), sig(a[k : 2 * k] + g[k : 2 * k])
                n = np.tanh(a[2 * k :] + q * g[2 * k :])
                h = out[t] = (1 - z) * n + z * h
            states.append([out[t] for t in range(len(words))])
        h = np.concatenate(states, axis=1)
        e = np.exp(np.tanh(h @ net.p["A"]) @ net.p["v"])
        return sig((e / e.sum()) @ h @ net.p["u"] + net.p["c"][0])

    got = net.forward(*net.project(x), ids)
    assert np.allclose(got, [by_hand(row[row > 0]) for row in ids], atol=1e-5)
    label, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        y = net.forward(*net.project(x), ids)
        return float((weight * -(label * np.log(y) + (1 - label) * np.log(1 - y))).sum() / weight.sum())

    g, gx = net.gradients(x, ids, label, weight)
    for a, own in [(net.p[k], g[k]) for k in net.p] + [(x, gx)]:
        for at in [tuple(r.integers(0, n) for n in a.shape) for _ in range(4)]:
            if a is x and at[0] == 0:
                continue
            keep, step = a[at], 1e-3
            a[at] = keep + step
            up = loss()
            a[at] = keep - step
            down = loss()
            a[at] = keep
            assert abs((up - down) / (2 * step) - own[at]) < 2e-3


@pytest.mark.xfail(reason="open: training on differently partitioned rows ends in other weights; README", strict=False)
def test_toxicity_trains_alike(spark):
    docs, marks = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    twice = docs.union(docs).repartition(3)  # rows repeated with one id, in another order
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.score_toxicity(d, marks).collect()} for d in (docs, twice))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-3 * max(a[k], 1e-3) for k in a)  # products of single precision depend on the batch


# 5: shingle sets


def brute_classes(rows):
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c in string.ascii_uppercase else c for c in t or "")) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links = defaultdict(set)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                links[i].add(j)
                links[j].add(i)
    at = smallest(links, range(len(rows)))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[at[i]] = min(d, least.get(at[i], d))
    return Counter((d, len(s), least.get(at[i])) if s else (d, 0, d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def variants():
    r, out = random.Random(5), []
    for b in range(6):
        base = [f"w{r.randrange(4000)}" for _ in range(r.choice([12, 40, 90, 300]))]
        for _ in range(45 if b < 2 else 12):
            w = base[:]
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                w[r.randrange(len(w))] = f"v{r.randrange(9999)}"
            out.append(" ".join(w[: len(w) - r.choice([0, 0, 0, 4])]))
    return [(1000 + i * 7919 % 1009, t) for i, t in enumerate(out)]


def of_passages(n, seed=9):
    """Documents put together from a few passages, and near copies of some."""
    r = random.Random(seed)
    passages = [" ".join(f"p{r.randrange(3000)}" for _ in range(20)) for _ in range(12)]
    out = [" ".join(r.sample(passages, 4)) for _ in range(n)]
    out += [t.replace(" p1", " x1", 1) + " more" for t in out[::7]] + [passages[0] + " tail", passages[0], passages[0] + " other tail"]
    return [(50_000 + i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("rare, block, leaders, minor", [(jaccard_join.RARE, jaccard_join.BLOCK, jaccard_join.LEADERS, jaccard_join.MINOR), (2, 9, 1, 30), (2, 9, 1, 0)])
def test_jaccard_classes(spark, messy, monkeypatch, rare, block, leaders, minor):
    monkeypatch.setattr(jaccard_join, "MINOR", minor)
    monkeypatch.setattr(jaccard_join, "RARE", rare)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "LEADERS", leaders)
    rows = variants() + of_passages(60) + [r[:2] for r in ROWS] + [(2**53 + 1, "an id over two to the fifty third"), (2**53 + 2, "another id over it")]
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, cls string, n string")
    assert rows_of(jaccard_join.jaccard_classes(docs), "doc_id", "n_shingles", "component_id") == brute_classes(rows)


def test_jaccard_screen():
    """Only sets that sketches can't tell apart are compared as sets, in pieces; no similar pair of different parts is lost."""
    rng = random.Random(5)
    common = [f"p{i}" for i in range(40)]
    texts = []
    for i in range(120):
        own = [f"w{rng.randrange(10**9)}" for _ in range(rng.choice([9, 80, 85, 400, 420]))]
        texts.append(" ".join(common + own))
        if i % 6 == 0:
            texts.append(" ".join([*common, *own, "end"]))
    sets = [jaccard_join.shingle_set(t) for t in texts]
    packed = [jaccard_join.pack(jaccard_join.words_of(t)) for t in texts]
    assert all((jaccard_join.unpack(x) == s).all() for x, s in zip(packed, sets))
    pdf = pd.DataFrame({"key": b"k", "x": 0, "y": 0, "cls": [jaccard_join.class_id(s) for s in sets], "n": [len(s) for s in sets], "sketch": [jaccard_join.parity_sketch(s) for s in sets]}).assign(part=lambda d: d["cls"])
    similar = {(i, k) for i in range(len(sets)) for k in range(len(sets)) if i != k and jaccard_join.similar(sets[i], sets[k])}
    found = set(zip(*np.nonzero(jaccard_join.candidates(pdf["n"].to_numpy(), pdf["sketch"].tolist(), np.arange(len(sets))))))
    assert similar <= found and len(similar) >= 40 and len(found) < len(sets) ** 2 / 10
    left = jaccard_join._screen(pdf)
    assert set(left["cls"]) == {pdf["cls"][i] for i, _ in found} and len(set(left["cls"])) < len(sets)
    edges = [jaccard_join._verify_block(own.assign(packed=own["cls"].map(dict(zip(pdf["cls"], packed))))) for _, own in left.groupby("z")]
    assert {frozenset(x) for e in edges for x in e.to_numpy().tolist()} == {frozenset((pdf["cls"][i], pdf["cls"][k])) for i, k in similar}
    assert not len(jaccard_join._screen(pdf.assign(part=b"one")))


def test_quality_blocks_are_packed(spark, messy):
    """Blocks hold each row's sequence once, at less than half its bytes on documents: no plain text is written or shuffled."""
    for docs, least in ((table(spark, MIDDLE, "documents"), 2), (messy, 0)):
        blocks = quality_lm._in_blocks(docs).collect()
        rows = [r for b in blocks for r in quality_lm.unpack_rows(bytes(b["packed"])).to_pylist()]
        assert Counter((r["doc_id"], r["lang"], r["sequence"]) for r in rows) == Counter((r["doc_id"], r["lang"], quality_lm.sequence_of(r["text"])) for r in docs.collect())
        assert least * sum(len(b["packed"]) for b in blocks) < sum(len(r["sequence"].encode()) for r in rows)


def test_quality_blocks_stay_where_written(spark, messy, labels):
    """Texts are never shuffled: the blocks' side of the last join has no exchange, nothing above the joins by n-gram has one for them, and no table's name is left."""
    model = spark.createDataFrame([("", 0.1, None), ("one ", 0.5, None)], "gram string, p double, gamma double")
    plan = quality_lm._perplexities(messy, model)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan
    packed = next(x for x in plan.splitlines() if "packed#" in x and "FileScan" in x)
    above = plan.splitlines()[: plan.splitlines().index(packed)]
    assert "Bucketed: true" in packed and not any("Exchange" in x for x in above), plan
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("quality")]


def test_workers_give_memory_back(spark, messy):
    """A worker that has read texts holds neither their words nor the allocator's rest in the next task; score_rows reads texts from the row it returns."""

    def held(batches):
        for _ in batches:
            pass
        import pyarrow as pa

        from lodestone.llm import jaccard_join

        yield pa.RecordBatch.from_pydict({"n": [len(jaccard_join._words) + jaccard_join.unpack.cache_info().currsize]})

    docs = table(spark, MIDDLE, "documents")
    for found in (jaccard_join._scan(docs, True), jaccard_join.whole_sets(docs, jaccard_join._scan(docs, False).select("cls", F.col("doc_id").alias("first_id")))):
        found.write.format("noop").mode("overwrite").save()
        assert spark.range(64).repartition(8).mapInArrow(held, "n long").agg(F.max("n")).first()[0] == 0
    rows = toxicity.score_rows(messy, spark.createDataFrame([], "doc_id long, toxic int"))
    assert rows_of(rows, "given_row.doc_id", "given_row.text") == rows_of(messy, "doc_id", "text")


def test_jaccard_reads_texts_once(messy):
    """The labels come from the sets that were made for the join: no text goes to Python again."""
    plan = jaccard_join.jaccard_classes(messy)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "text" not in plan


def test_jaccard_of_nothing(messy):
    assert jaccard_join.jaccard_classes(messy.limit(0)).count() == 0


# 6: quality


def brute_perplexity(trusted, texts):
    def grams_of(t):
        q = quality_lm.sequence_of(t)
        return [q[i : i + 4] for i in range(len(q) - 3)]

    counts = {4: Counter(g for t in trusted for g in grams_of(t))}
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cut, hist = {}, {k: defaultdict(lambda: [0, 0.0]) for k in counts}
    for k, c in counts.items():
        n = Counter(c.values())
        if n[1] and n[2]:
            y = n[1] / (n[1] + 2 * n[2])
            d = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
            cut[k] = [min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)]
        else:
            cut[k] = [0.5, 0.75, 0.75]
        for g, x in c.items():
            hist[k][g[:-1]][0] += x
            hist[k][g[:-1]][1] += cut[k][min(x, 3) - 1]

    def p(g):
        k = len(g)
        if not k:
            return 1 / (len(counts[1]) + 1)
        low = p(g[1:])
        if g[:-1] not in hist[k]:
            return low
        s, d = hist[k][g[:-1]]
        c = counts[k].get(g, 0)
        return ((c - cut[k][min(c, 3) - 1]) / s if c else 0) + d / s * low

    out = []
    for t in texts:
        grams = grams_of(t)
        out.append(math.exp(-sum(math.log(p(g)) for g in grams) / len(grams)) if grams else 1.0)
    return out


@pytest.mark.parametrize("block, chunk", [(quality_lm.BLOCK_CHARS, quality_lm.CHUNK), (300, 7)])
def test_quality(spark, messy, labels, monkeypatch, block, chunk):
    monkeypatch.setattr(quality_lm, "BLOCK_CHARS", block)
    monkeypatch.setattr(quality_lm, "CHUNK", chunk)
    r = random.Random(2)
    rows = [(i, " ".join("".join(r.choice("abcde") for _ in range(r.randrange(1, 6))) for _ in range(20)), "en" if i % 3 else "fr") for i in range(60)]
    rows += [(90, None, "en"), (91, "", None), (92, "zzz qqq", "xx"), (None, "zzz", "en"), (93, "\x02\x03 \0a", "en"), (94, "xq zj kw " * 30, "en"), (2**53 + 1, "中文 abc", None)]
    docs = spark.createDataFrame([(*x, "x") for x in rows], "doc_id long, text string, lang string, gram string").repartition(3)
    marks = spark.createDataFrame([(i, 1 if i < 40 else 0, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    sure = {i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2}
    got = quality_lm.classify_quality(docs, marks).collect()
    want = brute_perplexity([t for i, t, _ in rows if i in sure], [x[1] for x in rows])
    assert Counter((x["doc_id"], float(f"{x['perplexity']:.9g}")) for x in got) == Counter((x[0], float(f"{p:.9g}")) for x, p in zip(rows, want))
    keep = {}
    for (i, t, lang), p in zip(rows, want):
        own = sorted(q for (k, u, other), q in zip(rows, want) if k in sure and other == lang)
        most = own[math.ceil(quality_lm.QUANTILE * len(own)) - 1] * quality_lm.MARGIN if own else None
        keep[i] = (most, most is None or not (t or "").translate(quality_lm.MARKS).split() or p <= most)
    assert {x["doc_id"]: x["keep"] for x in got} == {i: k for i, (_, k) in keep.items()}
    assert all((x["threshold"] is None) == (keep[x["doc_id"]][0] is None) and (x["threshold"] is None or math.isclose(x["threshold"], keep[x["doc_id"]][0], rel_tol=1e-6)) for x in got)
    assert not keep[94][1] and quality_lm.classify_quality(messy, labels).count() == len(ROWS)
    assert quality_lm.classify_quality(messy.limit(0), labels.limit(0)).count() == 0


def test_word_order_counts():
    a, b = quality_lm.sequence_of("one two"), quality_lm.sequence_of("two one")
    assert set(quality_lm.distinct_grams([a])[0]) != set(quality_lm.distinct_grams([b])[0])


def test_quality_held_out(spark):
    docs, marks = table(spark, MIDDLE, "documents"), table(spark, MIDDLE, "labels")
    got = quality_lm.classify_quality(docs, marks).toPandas().merge(marks.toPandas().dropna(subset=["quality"]), on="doc_id")
    own = got[[zlib.crc32(str(d).encode()) % 4 == 2 for d in got["doc_id"]]]
    good, bad = own[own["quality"] == 1], own[own["quality"] == 0]
    print("kept of good", good["keep"].mean(), "rejected of bad", 1 - bad["keep"].mean())
    assert good["keep"].mean() > 0.95


# 7: repeated strings


def brute_removed(rows):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(raw[i : i + 200] for raw in raws for i in range(len(raw) - 199))
    out = Counter()
    for (d, _), raw in zip(rows, raws):
        gone = bytearray(len(raw))
        for i in range(len(raw) - 199):
            if seen[raw[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[d, len(raw), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 2])
def test_suffix_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    r = random.Random(8)
    word = lambda n: "".join(r.choice("abcdefg é中") for _ in range(n))
    passages = [word(n) for n in (199, 150, 260, 400, 900)]
    rows = [(i, word(r.randrange(300)) + r.choice(passages)[r.randrange(40) :] + word(r.randrange(150)) + (r.choice(passages) if i % 3 else "")) for i in range(60)]
    rows += [(100, "ab" * 400), (101, "a" * 700), (102, passages[4] + passages[4]), (103, None), (104, ""), (None, passages[3]), (105, "x" * 199), (106, "x" * 199), (102, passages[4] + passages[4])]
    docs = spark.createDataFrame([(*x, "x", "y") for x in rows], "doc_id long, text string, row_key string, anchor string")
    got = rows_of(suffix_dedup.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute_removed(rows)
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_hot_minimizers(spark, monkeypatch):
    """One passage whose edges thousands share, so that its minimizers are hot at the bound that production has."""
    r = random.Random(6)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = word(600)
    rows = [(i, word(60) + passage[r.randrange(3) :] + word(60)) for i in range(300)]
    monkeypatch.setattr(suffix_dedup, "HOT", 50)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(suffix_dedup.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_removed(rows)


# ids


def test_ids_stay_whole(spark):
    """Ids over 2^53 beside null in one partition, in all ten operators."""
    big = (2**53 + 1, 2**53 + 3)
    docs = spark.createDataFrame([(big[0], "one text of a few words", "en", "a"), (None, "another text of a few words", "de", "a"), (big[1], "a third text, unlike the others", "en", "b")], "doc_id long, text string, lang string, source string").coalesce(1)
    marks = spark.createDataFrame([(big[0], 1, 0), (big[1], 0, 1)], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([(big[0], [1.0, 0.0], 1), (None, [0.0, 1.0], 1), (big[1], [1.0, 0.01], 1)], "vec_id long, embedding array<float>, label int").coalesce(1)
    want = Counter([(big[0],), (None,), (big[1],)])
    out = [pii.detect_pii(docs), pii.digests(docs), mixing.plan_mix(docs), toxicity.score_toxicity(docs, marks), jaccard_join.jaccard_classes(docs), quality_lm.classify_quality(docs, marks), suffix_dedup.remove_repeats(docs), bpe.digests(docs), language_id.identify_language(docs), exact_dedup.exact_dedup(docs)]
    for df in out:
        assert rows_of(df, "doc_id") == want
    near = embedding_dedup.near_duplicates(vectors)
    assert rows_of(near, "vec_id", "component_id") == Counter([(big[0], big[0]), (None, None), (big[1], big[0])])
    assert {r["component_id"] for r in jaccard_join.jaccard_classes(docs).collect()} == {big[0], None, big[1]}


# 8: tokens


@pytest.fixture(scope="module")
def tokenizer():
    return Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})


def brute_tokens(tokenizer, rows):
    out = Counter()
    for d, t in rows:
        ids = tokenizer.encode_ordinary(t or "")
        out[d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    return out


def test_bpe(spark, messy, tokenizer):
    cols = "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"
    assert rows_of(bpe.digests(messy), *cols) == brute_tokens(tokenizer, [r[:2] for r in ROWS])
    docs = [tuple(r) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    assert rows_of(bpe.query(spark, SMALL), *cols) == brute_tokens(tokenizer, docs)
    assert bpe.digests(messy.limit(0)).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.text(max_size=80))
def test_codec(tokenizer, text):
    text = text.encode("utf-8", "ignore").decode()
    codec = bpe._codec(bpe.RANKS, bpe.PATTERN)
    (ids,) = codec.encode([text])
    assert ids.tolist() == tokenizer.encode_ordinary(text) and codec.decode([ids]) == [text.encode()]
    raw = (text * 3).encode()
    if raw:
        assert codec._by_heap(raw) == tokenizer._encode_single_piece(raw)


def test_codec_of_long_pieces_and_small_caches(tokenizer, monkeypatch):
    r = random.Random(4)
    monkeypatch.setattr(bpe, "CACHE_PIECES", 40)
    monkeypatch.setattr(bpe, "CHUNK", 500)
    monkeypatch.setattr(bpe, "BATCH_WORK", 20_000)
    texts = ["".join(r.choice("abcdeé") for _ in range(n)) for n in (1, 127, 128, 129, 1_999, 2_001, 100_000)] + [" ".join(f"w{r.randrange(30)}x the" for _ in range(40)) for _ in range(30)] + [None, "", "ACGT" * 5_000]
    codec = bpe.Codec()
    for _ in range(2):
        ids, decoded = codec.round_trip(texts)
        assert [x.tolist() for x in ids] == [tokenizer.encode_ordinary(t or "") for t in texts]
        assert decoded == [(t or "").encode() for t in texts] == codec.decode(ids)
        assert [x.tolist() for x in codec.encode(texts)] == [x.tolist() for x in ids]
    with pytest.raises(ValueError):
        codec.decode([np.array([10**6])])


# 9: languages


def test_language_held_out(spark):
    docs = table(spark, MIDDLE, "documents")
    got = language_id.identify_language(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    own = got[got["held_out"] & got["lang"].notna() & (got["lang_pred"] != "und")]
    assert len(own) and (own["lang"] == own["lang_pred"]).mean() > 0.9


def brute_languages(train, texts):
    """Counts and sums in plain Python over the same hashed n-grams."""
    counts, docs = defaultdict(Counter), Counter()

    def buckets(t):
        codes = [32]
        for c in t.lower():
            o = ord(c)
            o = 32 if o < 65 or 90 < o < 97 or 122 < o < 170 else o
            if o != 32 or codes[-1] != 32:
                codes.append(o)
        codes += [] if codes[-1] == 32 else [32]
        return language_id.hashed(np.array(codes, np.uint32)).tolist()

    for lang, t in train:
        counts[lang].update(buckets(t))
        docs[lang] += 1
    out = []
    for t in texts:
        if not any(c.isalpha() for c in t or ""):
            out.append(("und", 0.0))
            continue
        sums = {}
        for lang in sorted(counts):
            total = sum(counts[lang].values()) + 0.5 * language_id.BUCKETS
            sums[lang] = math.log(docs[lang] / sum(docs.values())) + sum(math.log((counts[lang][b] + 0.5) / total) for b in buckets(t))
        best = max(sums, key=lambda x: sums[x])
        out.append((best, 1 / sum(math.exp(v - sums[best]) for v in sums.values())))
    return out


@pytest.mark.parametrize("block, piece", [(64, 1 << 18), (3, 7)])
def test_language_by_hand(spark, monkeypatch, block, piece):
    monkeypatch.setattr(language_id, "BLOCK", block)
    monkeypatch.setattr(language_id, "PIECE", piece)
    r = random.Random(3)
    alphabets = {f"l{i}": "".join(chr(97 + (i * 5 + k) % 26) for k in range(9)) for i in range(8)}
    rows = [(i, " ".join("".join(r.choice(alphabets[lang]) for _ in range(r.randrange(1, 8))) for _ in range(12)) + r.choice(["", " 1.", "\n!É"]), lang) for i, lang in enumerate(sorted(alphabets) * 6)]
    rows += [(900, None, "l1"), (901, "12 :-", "l1"), (902, "", None), (None, "abc abc", "l2"), (2**53 + 1, "abcd", None)]
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in language_id.identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    train = [(lang, t) for i, t, lang in rows if lang and t is not None and zlib.crc32(("null" if i is None else str(i)).encode()) % 4 != 2]
    for (i, _, _), (lang, score) in zip(rows, brute_languages(train, [x[1] for x in rows])):
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-3


def test_many_languages(spark):
    rows = [(i, f"{chr(0x4E00 + i // 2)}word{i // 2} {chr(0x4E00 + i // 2)}", f"l{i // 2}") for i in range(1_400)]
    got = language_id.identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2))
    assert got.select("lang_pred").distinct().count() > 500


def test_language_edges(messy):
    got = language_id.identify_language(messy).collect()
    assert len(got) == len(ROWS) and {r["lang_pred"] for r in got if r["doc_id"] in (3, 4, 5)} == {"und"}
    assert language_id.identify_language(messy.limit(0)).count() == 0


# 10: exact copies


def test_exact_dedup(spark, messy, same_as_sql):
    same_as_sql(exact_dedup.query(spark, SMALL), exact_dedup.SQL)
    one = exact_dedup.exact_dedup(messy)
    assert bag(one.columns, map(tuple, one.collect())) == sql_over(messy, exact_dedup.SQL)
    assert exact_dedup.exact_dedup(messy.limit(0)).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300))
def test_perfect_hash(keys):
    a = np.array(sorted(keys), np.uint64)
    assert sorted(exact_dedup.PerfectHash.build(a).slot(a).tolist()) == list(range(len(a)))


# the pipeline


def test_pipeline(spark, tokenizer):
    docs = [tuple(r) for r in table(spark, SMALL, "documents").select("doc_id", "text", "source").collect()]
    bad = {r["doc_id"] for r in toxicity.query(spark, SMALL).where("predicted = 1").collect()}
    left = [d for d in docs if d[0] not in bad]
    low = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    best = {}
    for d, t, _ in left:
        k = (t or "").translate(low)
        best[k] = max(d, best.get(k, d))
    left = [x for x in left if best[(x[1] or "").translate(low)] == x[0]]
    stay = {d for d, _, c in brute_classes([x[:2] for x in left]) if d == c}
    left = [x for x in left if x[0] in stay]
    kept = spark.createDataFrame(left, "doc_id long, text string, source string").toArrow()
    db = duckdb.connect()
    db.register("kept", kept)
    copies = db.sql("WITH " + mixing.PLAN_SQL.format(docs="kept") + "SELECT doc_id, text, copies FROM copied").fetchall()
    want = brute_tokens(tokenizer, [(d, t) for d, t, n in copies for _ in range(n)])
    assert rows_of(corpus_pipeline.run(spark, SMALL), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_take_messy_rows(spark, messy, stage):
    name, run = stage
    out = run(spark, messy, SMALL)
    out.collect()
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == messy.columns
    assert run(spark, messy.limit(0), SMALL).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, same_as_sql, name):
    same_as_sql(queries.QUERIES[name](spark, SMALL), queries.SQL[name])


def test_every_query_is_registered():
    import __spark_entry__

    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES} == set(range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert not [f for f in Path(jaccard_join.__file__).parents[1].rglob("*.py") if f.parent.name != "llm" and re.search(r"\bllm\b", f.read_text())]
