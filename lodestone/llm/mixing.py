"""Mixing sources to target weights, with DataFrame functions only.

Words are summed by source (map-side combined, so a hot source is a few rows), a target for each source follows from
its weight and its cap, and each document is emitted floor(rate) times plus one copy with probability equal to the
fraction, drawn from a hash of its id. Only the small table of sources is ordered in one task; it has a row for each
source, whatever the number of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and tab to carriage return; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """From source and size of each document: mix_source, source_size and target of each source.

    Sources by code point, null last, get the weights in turn. Each wants level * weight words and stops at `most` times
    its own size; the level at which all targets add up to `share` of all words is found from prefix sums over the
    sources in order of the level at which they stop, which is where resharing the excess ends.
    """
    per = sizes.groupBy("mix_source").agg(F.sum("size").alias("source_size"))
    one = Window.orderBy(F.col("mix_source").isNull(), F.col("mix_source"))
    turn = F.pmod(F.row_number().over(one) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (turn + 1).cast("int")).cast("long")
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    by_stop = Window.orderBy(F.col("cap") / F.col("weight"), F.col("mix_source").isNull(), F.col("mix_source"))
    before, rest, every = by_stop.rowsBetween(Window.unboundedPreceding, -1), by_stop.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    total = F.sum("source_size").over(every) * F.lit(float(share))
    per = per.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest))
    open_ = F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("level"))
    first = F.first(open_, ignorenulls=True).over(by_stop.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    wanted = first * F.col("weight")
    return per.select("mix_source", "source_size", F.coalesce(F.least(F.col("cap").cast("double"), wanted), F.col("cap").cast("double")).alias("target"))


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the id and the seed only: 48 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 12), 16, 10).cast("long") / F.lit(float(2**48))


def plan_mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """Every row of docs with mix_size, mix_source_size, mix_target and mix_copies (0 to `most`) added.

    Null text has size 0. Null source is a source of its own, last in order. A null doc_id draws as the text 'null'.
    Equal rows draw alike. A source without words gets target 0 and no copies. No rows: no rows. Columns of docs
    stay as they are unless named like the four added ones, which replace them.
    """
    added = ("mix_size", "mix_source_size", "mix_target", "mix_copies")
    kept = docs.select(*[f"`{c}`" for c in docs.columns if c not in added])
    targets = source_targets(docs.select(F.col("source").alias("mix_source"), word_count(F.col("text")).alias("size")), weights, share, most)
    targets = targets.select(F.col("mix_source").alias("mix_of"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    targets = materialize(targets, "mix-targets")  # its size is then known, so Spark broadcasts it only below its threshold; beyond it adaptive execution splits hot sources
    own, of = F.struct(*[kept[f"`{c}`"] for c in kept.columns]), docs["source"].eqNullSafe(targets["mix_of"])
    out = docs.select(own.alias("mix_row"), docs["source"], docs["doc_id"], word_count(docs["text"]).alias("mix_size")).join(targets, of)
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + F.when(draw(F.col("doc_id"), seed) < rate - F.floor(rate), 1).otherwise(0)
    return out.select("mix_row.*", "mix_size", "mix_source_size", "mix_target", copies.cast("long").alias("mix_copies"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: each row of docs as many times as plan_mix says, with the columns of docs."""
    planned = plan_mix(docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mix_given")), **how)
    return planned.where("mix_copies > 0").select("mix_given", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int")))).select("mix_given.*")


def query(spark, sf_dir: str) -> DataFrame:
    planned = plan_mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return planned.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


PLAN_SQL = r"""
sized AS (SELECT *, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM {docs}),
per AS (SELECT source AS mix_source, sum(size)::BIGINT AS source_size FROM sized GROUP BY 1),
turn AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY mix_source IS NULL, mix_source) - 1) % 3 + 1)::INT]::BIGINT AS weight, source_size * 2 AS cap FROM per),
lev AS (SELECT *, ((sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, mix_source IS NULL, mix_source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
  / (sum(weight) OVER (ORDER BY cap / weight, mix_source IS NULL, mix_source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level FROM turn),
fixed AS (SELECT level FROM lev WHERE level * weight < cap ORDER BY cap / weight, mix_source IS NULL, mix_source LIMIT 1),
targets AS (SELECT mix_source, source_size, coalesce(least(cap::DOUBLE, (SELECT level FROM fixed) * weight), cap::DOUBLE) AS target FROM lev),
planned AS (SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
  ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.mix_source),
copied AS (SELECT *, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM planned)
"""
SQL = "WITH " + PLAN_SQL.format(docs="documents") + "SELECT doc_id, size, source_size, target, size * copies AS taken FROM copied"
