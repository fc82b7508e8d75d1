"""Embedding near-dedup: an exact metric range join of vectors with equal labels.

On the unit sphere cosine >= 0.98 is a distance of at most sqrt(0.04). Pivots, a bounded sample, cut the vectors into cells by
nearest pivot. A vector within r of one of another cell lies, by the triangle inequality, at most 2r farther from that cell's pivot
than from its own (and, in a Euclidean space, within r of the plane between the pivots), so copying it to the cells
where both hold loses no pair. Cells then join independently; large cells are cut into blocks whose pairs are tasks.
Equal vectors are one class with a multiplicity first, so copies meet as one row.

Near copies come first. Where vectors of a bounded sample crowd, balls are laid: a centre, and the vectors that have it within BALL (radians) as their nearest. Two
vectors whose angles to a centre add up to no more than the threshold's are linked, so those within half of it, the ball's core, are counted and not compared.
Others of the ball, its rim, and vectors of elsewhere that may link with one of the ball, visitors, are compared with all that lie there. What no ball
has is loose: it visits balls, and meets other loose vectors in the cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialize, table
from .components import connected_components
from .jaccard_join import forest

COSINE = 0.98
#: Vectors the pivots are chosen from and the most pivots: bounds of what is broadcast.
PIVOT_SAMPLE, MAX_PIVOTS = 2_000, 256
#: Vectors a pivot should stand for, and vectors of a block.
PER_PIVOT, BLOCK = 4_000, 1_000
#: Radius of a ball in radians, vectors that centres are chosen from, the most centres, and bytes of them.
BALL, BALL_SAMPLE, MAX_BALLS, BALL_BYTES = 0.14, 20_000, 4_096, 16_000_000
#: Places of a vector in a ball.
CORE, RIM, LOOSE, VISITOR = range(4)
#: Slack of the bounds, far above the rounding error of double precision.
SLACK = 1e-9


def usable(embedding) -> bool:
    if embedding is None:
        return False
    a = np.asarray([np.nan if x is None else x for x in embedding], np.float64)
    return len(a) > 0 and bool(np.isfinite(a).all()) and bool(a.any())


def _units(raw: pd.Series) -> np.ndarray:
    a = np.stack([np.frombuffer(x, np.float64) for x in raw])
    a = a / np.abs(a).max(axis=1, keepdims=True)  # neither overflow nor underflow in the norm
    return a / np.sqrt((a * a).sum(axis=1, keepdims=True))


def pivots_of(units: np.ndarray, n: int) -> np.ndarray:
    """n of the rows, each the farthest from those before."""
    picked = [0]
    far = ((units - units[0]) ** 2).sum(axis=1)
    while len(picked) < min(n, len(units)):
        k = int(far.argmax())
        if far[k] <= 0:
            break
        picked.append(k)
        far = np.minimum(far, ((units - units[k]) ** 2).sum(axis=1))
    return units[picked]


def cells(units: np.ndarray, pivots: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each vector, and a matrix of the cells that hold it."""
    d2 = np.maximum(2 - 2 * units @ pivots.T, 0)
    home = d2.argmin(axis=1)
    own2 = d2[np.arange(len(units)), home][:, None]
    gap = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))[home]
    near = (np.sqrt(d2) - np.sqrt(own2) <= 2 * r + SLACK) & (d2 - own2 <= 2 * gap * r + SLACK)
    near[np.arange(len(units)), home] = True
    return home, near


def crowds(units: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Size and unit mean of the groups of two rows or more that lie within BALL of the first of them, each row in one group."""
    out, left = [], np.ones(len(units), bool)
    for i in range(len(units)):
        if left[i]:
            own = left & (units @ units[i] >= np.cos(BALL))
            own[i] = True
            left &= ~own
            if own.sum() > 1:
                mean = units[own].sum(axis=0)
                out.append((int(own.sum()), mean / np.sqrt((mean * mean).sum())))
    return out


def balls_of(sample: pd.DataFrame) -> dict[int, np.ndarray]:
    """Centres by label, of the largest crowds of a sample (label, vec) of vectors of one length."""
    found = [(n, label, at, c) for label, own in sample.groupby("label") for at, (n, c) in enumerate(crowds(_units(own["vec"])))]
    found = sorted(found, key=lambda x: (-x[0], x[1], x[2]))[: min(MAX_BALLS, BALL_BYTES // max(1, len(sample["vec"].iloc[0])))]
    return {label: np.stack([c for _, own, _, c in found if own == label]) for label in {x[1] for x in found}}


def places(units: np.ndarray, centres: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, balls and places of vectors in the balls of their label; a vector without a ball is loose in ball -1 as well."""
    s = units @ centres.T
    home, rows = s.argmax(axis=1), np.arange(len(units))
    best = s[rows, home]
    inside = best >= np.cos(BALL)
    near = s >= np.cos(np.arccos(cosine) + BALL) - SLACK
    near[rows[inside], home[inside]] = True
    at, ball = np.nonzero(near)
    own = inside[at] & (home[at] == ball)
    core = s[at, ball] >= np.cos(np.arccos(cosine) / 2) + SLACK
    place = np.where(own, np.where(core, CORE, RIM), np.where(inside[at], VISITOR, LOOSE))
    loose = rows[~inside]
    return np.append(at, loose), np.append(ball, np.full(len(loose), -1)), np.append(place, np.full(len(loose), LOOSE))


def _edges(ok: np.ndarray, x: np.ndarray, y: np.ndarray) -> pd.DataFrame:
    """A forest of the links between x and y that a matrix tells, looked for among what has a link only: most of two blocks has none."""
    rows, columns = np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0))
    n, ids = len(rows), np.concatenate([x[rows], y[columns]])
    linked = np.zeros((len(ids), len(ids)), bool)
    linked[:n, n:] = ok[np.ix_(rows, columns)]
    linked[n:, :n] = linked[:n, n:].T
    return pd.DataFrame([(ids[i], ids[k]) for i, k in forest(linked)], columns=["a", "b"]).assign(partners=0)


def _verify_ball(pdf: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Partner counts and a forest of links of a block of a ball's vectors outside its core (side 0) and a block of all (side 1)."""
    left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
    if not len(left) or not len(right):
        return pd.DataFrame({"a": [], "b": [], "partners": pd.Series([], dtype=np.int64)})
    x, y = left["cls"].to_numpy(object), right["cls"].to_numpy(object)
    p, q = left["place"].to_numpy(), right["place"].to_numpy()
    ok = (_units(left["vec"]) @ _units(right["vec"]).T >= cosine) & (x[:, None] != y[None, :])
    ok &= (p[:, None] <= RIM) | (q[None, :] <= RIM)  # two that only visit meet elsewhere
    rim, core, edges = p != VISITOR, q == CORE, _edges(ok, x, y)
    counts = [pd.DataFrame({"a": own, "b": own, "partners": k}) for own, k in ((x[rim], (ok @ right["copies"].to_numpy(np.int64))[rim]), (y[core], (ok.T @ left["copies"].to_numpy(np.int64))[core]))]
    return pd.concat([edges, *counts])


def _in_balls(classes: DataFrame, lengths: list[int], cosine: float) -> DataFrame:
    """cls, label, vec, copies, ball and place of all classes."""
    spark, first, parts = classes.sparkSession, 0, []
    for length in lengths:
        own = classes.where(F.length("vec") == length)
        sample = own.orderBy(F.xxhash64("cls", F.lit(5))).limit(BALL_SAMPLE).select("label", "vec").toPandas()  # bounded
        found = {}
        for label, c in balls_of(sample).items():
            found[label] = first, c
            first += len(c)
        centres = spark.sparkContext.broadcast(found)

        def assign(batches: Iterator[pd.DataFrame], centres=centres) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for label, same in pdf.groupby("label"):
                    for i in range(0, len(same), BLOCK):
                        part = same.iloc[i : i + BLOCK]
                        if label in centres.value:
                            start, c = centres.value[label]
                            at, ball, place = places(_units(part["vec"]), c, cosine)
                            yield part.iloc[at].assign(ball=np.where(ball < 0, -1, ball + start), place=place)
                        else:
                            yield part.assign(ball=-1, place=LOOSE)

        parts.append(own.select("cls", "label", "vec", "copies").mapInPandas(assign, "cls binary, label long, vec binary, copies long, ball int, place int"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return materialize(out, "balls")


def _ball_links(placed: DataFrame, cosine: float) -> DataFrame:
    """a, b and partners, as _verify() gives them, of what stands in balls: the cores in bulk, the others in pairs of blocks."""
    core = placed.where(F.col("place") == CORE)
    whole = core.groupBy("ball").agg(F.sum("copies").alias("all"), F.min("cls").alias("least"))
    core = core.join(whole, "ball")
    links = core.select(F.col("cls").alias("a"), F.col("cls").alias("b"), (F.col("all") - F.col("copies")).alias("partners"))
    links = links.union(core.where("cls <> least").select(F.col("cls").alias("a"), F.col("least").alias("b"), F.lit(0).cast("long")))
    outer = F.col("place") != CORE
    sizes = placed.groupBy("ball").agg(F.ceil(F.count(F.when(outer, 1)) / BLOCK).cast("int").alias("across"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("down")).where("across > 0")
    dealt = placed.join(sizes, "ball").withColumn("x", F.pmod(F.xxhash64("cls", F.lit(11)), "across").cast("int")).withColumn("y", F.pmod(F.xxhash64("cls", F.lit(13)), "down").cast("int"))
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = dealt.where(outer).select("ball", "cls", "vec", "copies", "place", F.lit(0).alias("side"), "x", span("down").alias("y"))
    right = dealt.select("ball", "cls", "vec", "copies", "place", F.lit(1).alias("side"), span("across").alias("x"), "y")
    return links.union(left.unionByName(right).groupBy("ball", "x", "y").applyInPandas(lambda pdf: _verify_ball(pdf, cosine), "a binary, b binary, partners long"))


def _verify(pdf: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Partner counts of the x block's home vectors, and a forest of links, of one pair of blocks of a cell."""
    left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
    if not len(left) or not len(right):
        return pd.DataFrame({"a": [], "b": [], "partners": pd.Series([], dtype=np.int64)})
    u, v = _units(left["vec"]), _units(right["vec"])
    x, y = left["cls"].to_numpy(object), right["cls"].to_numpy(object)
    ok = (u @ v.T >= cosine) & (x[:, None] != y[None, :])
    partners = ok @ right["copies"].to_numpy(np.int64)
    edges = _edges(ok, x, y)
    return pd.concat([edges, pd.DataFrame({"a": x, "b": x, "partners": partners})])


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Vectors that are null, empty, zero, or hold a null or a component that is not finite, and rows with null label, link with nothing. Vectors of
    different lengths don't link. Rows repeated with one vec_id are separate vectors that link with each other. Null
    vec_id takes part and loses to any id; its row is kept only if its component has no other id. No rows: no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    r = float(np.sqrt(2 - 2 * cosine))

    def read(columns: dict[str, list]) -> dict:
        return {"vec": [(np.asarray(e, np.float64) + 0.0).tobytes() if usable(e) else None for e in columns["embedding"]]}

    rows = map_rows(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding"), read, ["embedding"], "vec binary")
    name = F.unhex(F.substring(F.sha2(F.concat(F.encode(F.col("label").cast("string"), "utf-8"), F.lit(b" "), F.col("vec")), 256), 1, 32))  # 128 bits
    rows = rows.withColumn("cls", F.when(F.col("label").isNotNull() & F.col("vec").isNotNull(), name))
    rows = materialize(rows, "vectors")
    classes = materialize(rows.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies")), "vector-classes")
    lengths = [r["bytes"] for r in classes.select(F.length("vec").alias("bytes")).distinct().collect()]  # a row for each length of vectors
    placed = _in_balls(classes, lengths, cosine) if lengths else None
    loose = placed.where("ball < 0") if lengths else classes
    links = [materialize(_ball_links(placed.where("ball >= 0"), cosine), "ball-links")] if lengths else []
    parts = []
    for row in loose.groupBy(F.length("vec").alias("bytes")).count().collect():
        own = loose.where(F.length("vec") == row["bytes"])
        sample = own.orderBy(F.xxhash64("cls", F.lit(7))).limit(PIVOT_SAMPLE).select("vec").toPandas()  # bounded
        pivots = spark.sparkContext.broadcast(pivots_of(_units(sample["vec"]), max(1, min(MAX_PIVOTS, row["count"] // PER_PIVOT))))

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                home, near = cells(_units(pdf["vec"]), pivots.value, r)
                at, cell = np.nonzero(near)
                yield pdf.iloc[at][["cls", "label", "vec", "copies"]].assign(cell=cell, home=home[at] == cell)

        parts.append(own.select("cls", "label", "vec", "copies").mapInPandas(assign, "cls binary, label long, vec binary, copies long, cell int, home boolean").withColumn("bytes", F.lit(row["bytes"])))
    if parts:
        placed = parts[0]
        for p in parts[1:]:
            placed = placed.union(p)
        placed = materialize(placed, "cells")
        key = ["bytes", "label", "cell"]
        sizes = placed.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        placed = placed.join(sizes, key).withColumn("own", F.pmod(F.xxhash64("cls", F.lit(11)), F.col("blocks")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        left = placed.where("home").select(*key, "cls", "vec", "copies", F.lit(0).alias("side"), F.col("own").alias("x"), other).withColumnRenamed("other", "y")
        right = placed.select(*key, "cls", "vec", "copies", F.lit(1).alias("side"), F.col("own").alias("y"), other).select(*key, "cls", "vec", "copies", "side", F.col("other").alias("x"), "y")
        links.append(materialize(left.unionByName(right).groupBy(*key, "x", "y").applyInPandas(lambda pdf: _verify(pdf, cosine), "a binary, b binary, partners long"), "vector-links"))
    if links:
        out = links[0].union(links[1]) if len(links) > 1 else links[0]
        counts = out.where("a = b").groupBy(F.col("a").alias("cls")).agg(F.sum("partners").alias("partners"))
        comps = connected_components(out.where("a <> b").select("a", "b")).withColumnRenamed("node", "cls")
    else:
        counts = spark.createDataFrame([], "cls binary, partners long")
        comps = spark.createDataFrame([], "cls binary, component binary")
    label = classes.select("cls", "first_id", "copies").join(counts, "cls", "left").join(comps, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = label.groupBy("component").agg(F.min("first_id").alias("component_id"))
    label = label.join(least, "component").select("cls", "component_id", (F.coalesce("partners", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    done = rows.select("vec_id", "cls").join(label, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return done.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a)
SELECT *, vec_id = component_id AS kept FROM (SELECT vec_id, (SELECT count(*) FROM pairs WHERE a = vec_id) AS n_links, least(vec_id, (SELECT min(b) FROM reach WHERE a = vec_id)) AS component_id FROM v)
"""
