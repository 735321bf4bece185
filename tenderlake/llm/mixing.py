"""Mixing sources to target weights (DataFrame functions only).

Each source gets a target share of all words.  Shares follow fixed weights;
a source is never asked for more than ``max_repeats`` times what it has, and
what it cannot give is shared again among the others by weight.  The targets
are turned into whole blocks of equal length by Sainte-Lague apportionment
(highest quotients t / (2 n + 1)); every source's blocks are apportioned in
the same way to its shards, and each shard takes its quota as a run of blocks
that starts at a seeded place in the seeded order of its documents.

Scale: word counts are one JVM expression per text; a hot source is cut into
shards of about ``shard_docs`` documents.  Sources may be as many as documents,
and a source may have any number of shards: sums over them are grouped
aggregates, orders and sums up to a row are distributed running totals over
range partitions, and no window holds all sources or all shards of one.

Defined results: a null text has size 0, as an empty one; a document without
words takes 0.  A null source is a source of its own, ordered last.  Rows
that repeat are separate documents.  An empty table gives an empty result.
Columns other than id, text and source are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.llm.common import WORD, as_text, written
from tenderlake.operators.running import running_totals

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 32
SHARD_DOCS = 1000
MAX_REPEATS = 3
SEED = 20


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _hash(seed: int, *parts: Column) -> Column:
    """md5 of the seed and the parts, which other engines have too."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def _number(h: Column) -> Column:
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS,
                   max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``sizes``: (source, source_size, n_docs), a row a source.  Adds
    ``target`` by water filling: target = min(cap, level * weight), where the
    level makes the targets sum to all words.  Caps and weights are whole
    numbers, so that sums do not depend on the order of partitions."""
    one = F.lit(1.0).alias("_one")
    s = sizes.select("*", F.col("source").isNull().cast("int").alias("_null"), one)
    # the source's place by code point, null last
    placed = running_totals(s, [], ["_null", "source"], "_one", keep=["source_size", "n_docs"])
    s = placed.select("source", "source_size", "n_docs", F.col("before_count").alias("_i"))
    s = written(s.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_i") % len(weights) + 1).cast("int")))
                .withColumn("_cap", F.col("source_size").cast("double") * max_repeats).withColumn("_ratio", F.col("_cap") / F.col("_w")), "mix-caps")
    total = s.agg(F.sum(F.col("source_size").cast("double")).alias("words"), F.sum("_w").alias("w")).first()
    caps = running_totals(s, [], ["_ratio", "_i"], "_cap", keep=["_w"])
    parts = running_totals(s, [], ["_ratio", "_i"], "_w").select(F.col("_i").alias("_j"), F.col("before_sum").alias("_before_w"))
    level = (F.lit(float(total["words"] or 0)) - F.col("before_sum")) / (F.lit(float(total["w"] or 0)) - F.col("_before_w"))
    # the first source, by cap per weight, that the level of the rest does not fill
    first = (caps.join(parts, F.col("_i") == F.col("_j")).withColumn("_level", level).filter(F.col("_cap") >= F.col("_level") * F.col("_w"))
             .agg(F.min(F.struct("_ratio", "_i", F.col("_level").alias("l")))["l"].alias("l")).first())
    fill = F.lit(first["l"]).cast("double") * F.col("_w")
    return s.select("source", "source_size", "n_docs", F.least(F.col("_cap"), F.coalesce(fill, F.col("_cap"))).alias("target"))


def _equal(left: str, right: str, columns: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def apportion(rows: DataFrame, group: Sequence[str], key: Sequence[str], votes: str, seats: str, out: str) -> DataFrame:
    """Sainte-Lague: within each ``group``, give ``seats`` (the same in all
    rows of a group) to the rows by the highest quotients votes / (2 n + 1),
    ties to the smaller ``key`` (nulls last).  Adds ``out``.

    Only the quotients near the last seat are listed: with q = votes * seats
    / sum of votes and e = (rows + 1) / seats, the divisors 1 + e and 1 - e
    give at most and at least all seats, so that a group lists a number of
    quotients in proportion to its rows, not to its seats.  The listed ones
    are ranked by distributed running totals.
    """
    rows = written(rows, "apportion-rows")
    n = F.col(seats).cast("double")
    per = rows.groupBy(*group).agg(F.sum(F.col(votes).cast("double")).alias("_all_votes"), F.count(F.lit(1)).alias("_rows"))
    r = (rows.alias("a").join(per.alias("p"), _equal("a", "p", group)).select("a.*", "_all_votes", "_rows")
         .withColumn("_votes", F.col(votes).cast("double"))
         .withColumn("_q", F.when(F.col("_all_votes") > 0, F.col("_votes") * n / F.col("_all_votes")).otherwise(F.lit(0.0)))
         .withColumn("_e", (F.col("_rows") + 1) / F.greatest(n, F.lit(1.0)))
         .withColumn("_low", F.when(F.col("_votes") > 0, F.floor(F.col("_q") / (1 + F.col("_e")) + 0.5)).otherwise(F.lit(0)).cast("bigint"))
         .withColumn("_high", F.when(F.col("_votes") <= 0, F.lit(0)).when(F.col("_e") < 0.5, F.floor(F.col("_q") / (1 - F.col("_e")) + 0.5) + 1)
                     .otherwise(F.least(n, F.floor(3 * F.col("_q")) + 2 * F.col("_rows") + 4)).cast("bigint"))
         .withColumn("_high", F.least(F.col("_high"), n.cast("bigint"))))
    r = written(r, "apportion-bounds")
    free = r.groupBy(*group).agg((F.max(seats).cast("bigint") - F.sum("_low")).alias("_free"))
    nulls = {f"_no_{k}": F.col(k).isNull().cast("int") for k in key}
    listed = (r.filter(F.col("_high") > F.col("_low")).select(*group, *key, "_votes", F.explode(F.sequence("_low", F.col("_high") - 1)).alias("_n"))
              .withColumn("_least", -(F.col("_votes") / (2 * F.col("_n") + 1))).withColumns(nulls).withColumn("_one", F.lit(1.0)))
    order = ["_least", *[c for k in key for c in (f"_no_{k}", k)], "_n"]
    won = (running_totals(listed, list(group), order, "_one").alias("a").join(free.alias("f"), _equal("a", "f", group))
           .filter(F.col("a.before_count") < F.col("f._free")).groupBy(*[F.col(f"a.{c}").alias(c) for c in (*group, *key)]).agg(F.count(F.lit(1)).alias("_won")))
    return r.alias("a").join(won.alias("b"), _equal("a", "b", [*group, *key]), "left").select(
        *[F.col(f"a.{c}").alias(c) for c in rows.columns], (F.col("a._low") + F.coalesce(F.col("b._won"), F.lit(0))).alias(out))


def mix_sources(docs: DataFrame, weights: Sequence[int] = WEIGHTS, *, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", block_words: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS,
                max_repeats: int = MAX_REPEATS, seed: int = SEED, keep: Sequence[str] = ()) -> DataFrame:
    """A row a document: id, size, source_size, target, taken, and where the
    partial copy lies: ``full`` whole copies plus the words [part_start,
    part_start + part_words) (counted on a circle: it may pass the end of a
    document that fills its shard).  ``keep`` names further columns to carry;
    keep them narrow."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"),
                    _hash(seed, F.coalesce(F.col(id_col).cast("string"), F.lit("null")), as_text(text_col)).alias("_h"), *keep)
    d = written(d, "mix-sizes")
    sizes = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    targets = written(source_targets(written(sizes, "mix-totals"), weights, max_repeats), "mix-targets")
    seats = targets.agg(F.round(F.sum("target") / block_words).cast("bigint")).first()[0] or 0
    blocks = apportion(targets.withColumn("_all", F.lit(1)).withColumn("_seats", F.lit(seats).cast("bigint")),
                       ["_all"], ["source"], "target", "_seats", "source_blocks").drop("_all", "_seats")
    # a source's blocks are no more than its cap holds
    blocks = (blocks.withColumn("source_blocks", F.least("source_blocks", F.ceil(F.col("source_size") * max_repeats / block_words)))
              .withColumn("n_shards", F.ceil(F.col("n_docs") / shard_docs).cast("bigint")))
    blocks = written(blocks, "mix-sources")
    a, b = d.alias("d"), blocks.alias("b")
    d = (a.join(b, F.col("d.source").eqNullSafe(F.col("b.source")))
         .select("d.*", "b.source_size", "b.target", "b.source_blocks",
                 (_number(F.col("d._h")) % F.col("b.n_shards")).alias("shard")))
    shards = d.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.max("source_blocks").alias("source_blocks"))
    quotas = apportion(shards, ["source"], ["shard"], "shard_size", "source_blocks", "quota")
    quotas = quotas.select(
        "source", "shard", "shard_size",
        # words: whole passes over the shard, and a run of blocks for the rest
        F.least(F.col("quota") * block_words, F.col("shard_size") * max_repeats).alias("words"))
    quotas = quotas.select(
        "source", "shard", "shard_size", F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(0).cast("bigint").alias("full"),
        F.when(F.col("shard_size") > 0, F.col("words") % F.col("shard_size")).otherwise(0).cast("bigint").alias("rest"),
        (F.when(F.col("shard_size") > 0, F.floor(_number(_hash(seed, F.coalesce("source", F.lit("null")), F.col("shard").cast("string"))) % F.col("shard_size") / block_words)).otherwise(0)
         * block_words).cast("bigint").alias("begin"))
    w = Window.partitionBy("source", "shard").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("before", F.coalesce(F.sum("size").over(w), F.lit(0)))
    a, b = d.alias("d"), quotas.alias("b")
    d = a.join(b, F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.shard") == F.col("b.shard"))).select(
        "d.*", "b.shard_size", "b.full", "b.rest", "b.begin")
    # overlap of [before, before + size) with [begin, begin + rest) and its part past the end of the circle
    def overlap(lo: Column, hi: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("before") + F.col("size"), hi) - F.greatest(F.col("before"), lo))

    first = overlap(F.col("begin"), F.least(F.col("begin") + F.col("rest"), F.col("shard_size")))
    second = overlap(F.lit(0), F.col("begin") + F.col("rest") - F.col("shard_size"))
    return (d.withColumn("_first", first).withColumn("_second", second)
            .withColumn("part_words", F.col("_first") + F.col("_second"))
            .withColumn("part_start", F.when(F.col("_first") > 0, F.greatest(F.lit(0), F.col("begin") - F.col("before"))).otherwise(F.lit(0)))
            .select("doc_id", "size", "source_size", "target", (F.col("full") * F.col("size") + F.col("part_words")).cast("bigint").alias("taken"),
                    F.col("full"), F.col("part_start").cast("bigint").alias("part_start"), F.col("part_words").cast("bigint").alias("part_words"),
                    *keep))
