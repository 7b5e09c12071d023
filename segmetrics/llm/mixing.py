"""Mixing sources to target weights by systematic sampling.

Every source has a weight. The targets share the total size by weight; no
target exceeds ``max_copies`` times its source's size, and what a full
source can't take is shared again among the others by weight. A document
then expects ``target / source_size`` copies. Walking along the documents
of a source, the expected copies are summed up, one random offset is added,
and a document is emitted once per whole number its step crosses.

All documents of a source expect the same number of copies, so the prefix
sum at the n-th document is n times that number, and the work is to number
the documents. They are numbered by (size, salt, doc_id), because a walk
along growing sizes keeps the words taken close to the target. No window
holds a whole source: numbers are built from offsets per (source, size),
offsets per (source, size, salt), and a row number among the documents of
one (source, size, salt).

Defined results: a null text has size 0; a null source is a source, after
all others; repeated rows are documents of their own; an empty table gives
an empty result; a source without words has target 0 and is not emitted.
"""
from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmetrics.llm.common import content_hash, n_words, stored

SALTS = 1024


def cyclic_weight(rank: Column) -> Column:
    """Weights 1, 2, 3, 1, 2, 3, ... by the source's rank (from 1)."""
    return ((rank - 1) % 3 + 1).cast("long")


def source_targets(sizes: DataFrame, weight: Callable[[Column], Column] = cyclic_weight,
                   max_copies: int = 3) -> DataFrame:
    """(source, source_size) -> the same with weight and target.

    The level L with sum(min(cap, L * weight)) = total is found in one pass:
    in the order of cap / weight the full sources come first, and source k
    is full if what the sources before it leave, shared by the weights from k
    on, gives it more than its cap. The windows run over one row per source,
    the table that a mixture is defined on."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("weight", weight(F.row_number().over(by_name))).withColumn(
        "cap", F.col("source_size") * F.lit(max_copies).cast("long"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    s = s.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), zero)).alias("left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), zero)).alias("shares"),
    )
    s = s.withColumn("full", F.col("left") * F.col("weight") > F.col("cap") * F.col("shares"))
    rest = F.sum("source_size").over(everything) - F.coalesce(
        F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), zero)
    open_shares = F.sum("weight").over(everything) - F.coalesce(
        F.sum(F.when(F.col("full"), F.col("weight"))).over(everything), zero)
    share = (rest * F.col("weight")).cast("double") / F.nullif(open_shares, zero).cast("double")
    return s.select("source", "source_size", "weight",
                    F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def random_offset(source: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the source and the seed alone."""
    name = F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 8), 16, 10).cast("double") / 4294967296.0


def sample_copies(docs: DataFrame, weight: Callable[[Column], Column] = cyclic_weight,
                  max_copies: int = 3, seed: int = 9) -> DataFrame:
    """Documents (doc_id, source, text) -> one row per document: doc_id,
    source, size, source_size, target, copies."""
    base = stored(docs.select(
        F.col("doc_id"), F.col("source"), n_words(F.col("text")).alias("size"),
        (F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % SALTS)
        .cast("int").alias("salt"),
    ), "mix-sizes")
    salted = stored(base.groupBy("source", "size", "salt").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    sized = salted.groupBy("source", "size").agg(F.sum("n").alias("n"))
    targets = source_targets(
        sized.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weight, max_copies)

    def offset(*group: str, order: str) -> Column:
        w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(w), F.lit(0).cast("long"))

    of_size = sized.select("source", "size", offset("source", order="size").alias("size_offset"))
    of_salt = salted.select("source", "size", "salt", offset("source", "size", order="salt").alias("salt_offset"))
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    z = of_size.select(F.col("source").alias("z_source"), F.col("size").alias("z_size"), "size_offset")
    starts = (
        of_salt.join(z, F.col("source").eqNullSafe(F.col("z_source")) & (F.col("size") == F.col("z_size")))
        .join(t, F.col("source").eqNullSafe(F.col("t_source")))
        .select(F.col("source").alias("o_source"), F.col("size").alias("o_size"), F.col("salt").alias("o_salt"),
                (F.col("size_offset") + F.col("salt_offset")).alias("first"), "source_size", "target")
    )
    numbered = base.withColumn(
        "n", F.row_number().over(Window.partitionBy("source", "size", "salt").orderBy("doc_id")))
    rows = numbered.join(starts, F.col("source").eqNullSafe(F.col("o_source"))
                         & (F.col("size") == F.col("o_size")) & (F.col("salt") == F.col("o_salt")))
    rate = F.col("target") / F.nullif(F.col("source_size"), F.lit(0).cast("long"))
    u = random_offset(F.col("source"), seed)
    n = (F.col("first") + F.col("n")).cast("double")
    copies = F.floor(n * rate + u) - F.floor((n - 1) * rate + u)
    return rows.select("doc_id", "source", "size", "source_size", "target",
                       F.coalesce(copies, F.lit(0)).cast("long").alias("copies"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: every document as often as ``sample_copies`` says,
    with all its columns. Rows that share doc_id, source and size are
    exchangeable for the sampler; their copies are dealt out in the order of
    a hash of the rows, so reruns agree."""
    drawn = sample_copies(docs, **how).groupBy(
        F.col("doc_id").alias("t_id"), F.col("source").alias("t_source"), F.col("size").alias("t_size")).agg(
        F.sort_array(F.collect_list(F.col("copies").cast("int")), asc=False).alias("drawn")).where("drawn[0] > 0")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["doc_id"].alias("d_id"),
                       docs["source"].alias("d_source"), n_words(docs["text"]).alias("d_size"))
    met = rows.join(drawn, F.col("d_id").eqNullSafe(F.col("t_id")) & F.col("d_source").eqNullSafe(F.col("t_source"))
                    & (F.col("d_size") == F.col("t_size")))
    row = F.row_number().over(Window.partitionBy("d_id", "d_source", "d_size").orderBy(
        F.xxhash64("doc.text"), content_hash(docs, "doc.")))
    copies = met.withColumn("row", row).withColumn("copies", F.expr("drawn[row - 1]")).where("copies > 0")
    return copies.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        *[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
