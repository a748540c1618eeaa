"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

Each source gets a target of words: its weight's share of the mix, at most a
multiple of what it has, the excess going to the other sources by weight. A
document is then due ``target / source size`` copies. The whole part is taken;
the fractions of documents of about the same size (within a power of two) are
paired: of two documents, words move at random from one to the other, keeping
their sum and each one's expectation, until one fraction is 0 or 1. What remains
of a group of documents goes on to the next level of a reduction tree, so no
group grows with the data. The few fractions left of each size are drawn last,
the largest document first; what a draw gives or takes too much shifts the
probabilities of the smaller ones, and a draw that they can't make up for isn't
left to chance, so that a source ends within about a small document of its
target. Draws are hashes of the keys: reruns agree.

Null text counts as no words. Documents without words take none. Null sources
are a source of their own, the last. Rows alike in key, source and size share
one draw. An empty table gives no row. ``mix_sources`` ignores further columns,
``mixed`` keeps all of them, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.llm.store import fresh, stored

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
#: Documents paired in one group; the tree's levels are the logarithm to this base.
FAN = 32
#: Groups that a size of a source keeps to the end.
KEPT = 8
#: More sources than this are joined by a shuffle.
BROADCAST_ROWS = 100_000
SEED = 7


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sizes``: a row for each source with source_size. Adds target: least(cap, level * weight), all adding up to the share.

    The windows hold one row for each source in one task: for sources by the million, no more.
    """
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    w = sizes.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")).withColumn("goal", share * F.sum("source_size").over(everything))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    capped = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.col("goal") - capped) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    w = w.withColumn("level", level).withColumn("at", F.row_number().over(order))
    # the first source, by cap to weight, that isn't capped sets the level of all such
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("at", "level"))).over(everything)
    return w.select("source", "source_size", "n", F.least(F.col("cap"), F.coalesce(first["level"] * F.col("weight"), F.col("cap"))).alias("target"))


def _small(spark_df: DataFrame) -> DataFrame:
    return spark_df.hint("broadcast" if spark_df.count() <= BROADCAST_ROWS else "merge")


def _draw(*keys: Column | int) -> Column:
    bits = F.xxhash64(*(k if isinstance(k, Column) else F.lit(k) for k in keys), F.lit(SEED))
    return F.shiftrightunsigned(bits, 11).cast("double") / float(2**53)


def _pair(level: int):
    def merge(acc: Column, j: Column) -> Column:
        i = acc["rest"]
        raise_i, lower_i = i["size"] * (1 - i["p"]), i["size"] * i["p"]
        raise_j, lower_j = j["size"] * (1 - j["p"]), j["size"] * j["p"]
        up, down = F.least(raise_i, lower_j), F.least(lower_i, raise_j)
        to_i = _draw(i["unit"], j["unit"], level) * (up + down) < down
        i_done = F.when(to_i, raise_i <= lower_j).otherwise(lower_i <= raise_j)
        new_i = F.greatest(F.lit(0.0), F.least(F.lit(1.0), i["p"] + F.when(to_i, up).otherwise(-down) / i["size"]))
        new_j = F.greatest(F.lit(0.0), F.least(F.lit(1.0), j["p"] - F.when(to_i, up).otherwise(-down) / j["size"]))
        item = lambda x, p: F.struct(x["unit"].alias("unit"), x["size"].alias("size"), p.alias("p"))
        done = F.when(i_done, item(i, F.when(to_i, 1.0).otherwise(0.0))).otherwise(item(j, F.when(to_i, 0.0).otherwise(1.0)))
        rest = F.when(i_done, item(j, new_j)).otherwise(item(i, new_i))
        return F.struct(rest.alias("rest"), F.concat(acc["done"], F.array(done)).alias("done"))

    return merge


ITEM = "struct<unit:bigint,size:double,p:double>"


def _round(level_rows: DataFrame, level: int) -> DataFrame:
    """(source, class, n, unit, size, p) in; the same out, all but one of a group with p 0 or 1."""
    # expected fill of a group: FAN
    groups = F.greatest(F.least(F.col("n"), F.lit(KEPT)), F.ceil(F.col("n") / float(FAN**level)))
    return (
        level_rows.withColumn("group", F.pmod(F.xxhash64("unit", F.lit(level), F.lit(SEED)), groups))
        .groupBy("source", "class", "n", "group")
        .agg(F.sort_array(F.collect_list(F.struct("unit", "size", "p"))).alias("items"))
        .select("source", "class", "n", F.aggregate(F.slice("items", 2, F.size("items")), F.struct(F.col("items")[0].alias("rest"), F.array().cast(f"array<{ITEM}>").alias("done")), _pair(level), lambda a: F.concat(a["done"], F.array(a["rest"]))).alias("items"))
        .select("source", "class", "n", F.inline("items"))
    )


def _last(left: DataFrame) -> DataFrame:
    """(unit, extra 0 or 1) of the fractions left: at most KEPT for each power of two of each source."""

    def draw(acc: Column, i: Column) -> Column:
        give, take = i["size"] * i["p"], i["size"] * (1 - i["p"])
        up, down = acc["up"] - take, acc["down"] - give  # what the smaller ones can make up for
        no, yes = acc["carry"] + give <= up, acc["carry"] - take >= -down
        chance = i["p"] + acc["carry"] / i["size"]
        taken = F.when(no & yes, _draw(i["unit"], 0) < chance).when(no | yes, yes).otherwise(chance >= 0.5).cast("double")
        step = F.array(F.struct(i["unit"].alias("unit"), taken.alias("extra")))
        return F.struct((acc["carry"] + i["size"] * (i["p"] - taken)).alias("carry"), up.alias("up"), down.alias("down"), F.concat(acc["done"], step).alias("done"))

    total = lambda f: F.aggregate("items", F.lit(0.0), lambda t, i: t + i["size"] * f(i["p"]))
    start = F.struct(F.lit(0.0).alias("carry"), total(lambda p: 1 - p).alias("up"), total(lambda p: p).alias("down"), F.array().cast("array<struct<unit:bigint,extra:double>>").alias("done"))
    largest_first = F.reverse(F.sort_array(F.collect_list(F.struct("size", "unit", "p"))))
    return left.groupBy("source").agg(largest_first.alias("items")).select(F.inline(F.aggregate("items", start, draw, lambda a: a["done"])))


def mix_sources(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """A row for each key, source and size: key, source, size, source_size, target, copies."""
    rows = stored(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(text).alias("size")), "sizes")
    sources = stored(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), weights, share, most), "targets")
    units = rows.groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("rows"))
    s = _small(sources.withColumnRenamed("source", "s"))
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = units.join(s, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("whole", F.floor(due)).withColumn("p", due - F.floor(due)).withColumn("unit", F.xxhash64("key", "source", "size"))
    units = stored(units, "units")
    words = (F.col("size") * F.col("rows")).cast("double")
    left = units.filter("p > 0 and size > 0").select("source", F.floor(F.log2(words)).cast("int").alias("class"), "unit", words.alias("size"), "p")
    # a few rows for each source
    classes = stored(left.groupBy("source", "class").agg(F.count(F.lit(1)).alias("n")), "classes")
    largest = classes.agg(F.max("n")).first()[0] or 0
    c = _small(classes.select(F.col("source").alias("s"), F.col("class").alias("c"), "n"))
    left = left.join(c, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c"))).select("source", "class", "n", "unit", "size", "p")
    level, done = 1, []
    while True:
        out = stored(_round(left, level), f"level{level}")
        fraction = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(out.filter(~fraction).select("unit", F.col("p").alias("extra")))
        left = out.filter(fraction)
        if KEPT * FAN**level >= largest:
            break
        level += 1
    done.append(_last(left))
    extra = reduce(DataFrame.unionByName, done).groupBy("unit").agg(F.max("extra").alias("extra"))
    return units.join(extra.hint("merge"), "unit", "left").select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", (F.col("whole") + F.coalesce("extra", F.lit(0.0))).cast("long").alias("copies"), "rows")


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **kw) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it has copies."""
    k, s, n, copies, copy = fresh(docs, "key", "from", "words", "copies", "copy")
    plan = mix_sources(docs, key, text, source, **kw).select(F.col(key).alias(k), F.col(source).alias(s), F.col("size").alias(n), F.col("copies").alias(copies))
    plan = stored(plan.filter(F.col(copies) > 0), "copies").hint("merge")
    same = F.col(key).eqNullSafe(F.col(k)) & F.col(source).eqNullSafe(F.col(s)) & (word_count(text) == F.col(n))
    taken = docs.join(plan, same)
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))).alias(copy)).drop(copy)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    plan = mix_sources(docs)
    each = F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int")))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), each.alias("row")).drop("row")
