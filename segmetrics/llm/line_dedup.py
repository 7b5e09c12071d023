"""Line deduplication by a suffix array over line-id sequences.

The lines that have a word, of all documents in the order of doc_id, form
one sequence of line ids; every position starts a suffix, which ends with
its document. The suffixes are ranked by prefix doubling: ranks by the first
h lines, paired with the ranks h lines further on and sorted, give ranks by
2h lines. Suffixes of one rank are an interval of the suffix array that
shares a prefix of h lines; a suffix alone in its interval repeats nothing
and leaves the table, so later rounds move repeated lines only.

A repeated run must have ``min_words`` words; the maximal ones are deleted
whole from all copies but the first. They are covered by short windows: a
line of a run lies in the window of the fewest lines from it on that hold
enough words, or, near the run's end, in one that ends with the run and whose
lines after the first hold too few. So a position takes all lengths from
depth(i), the lines until the words suffice, up to those whose words after
the first are still fewer: ``min_words`` lines at most, where doubling may
stop. Two overlapping powers of two give the interval of suffixes that share
a window's lines. Its smallest position is the first copy; the others are
later copies, and the lines they cover are deleted.

Sorting is by ranges of distinct rank pairs, counted map-side, so a line
that stands in a third of all documents is one row there. Joins back to
positions are plain shuffle joins that Spark splits where skewed. Every round
is written to the shared folder.

Defined results: the first copy (least doc_id, null last, then place) of
each line always stays; a null text is empty; rows equal in doc_id and text
are one document and get the same result; blank lines belong to no run and
stay; an empty table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmetrics.llm.common import SPACES, WORD, let, running_total, stored

MIN_WORDS = 5


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"], F.lit(""))


def _line_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, lines: array of (line, h1, h2, words) with a word)."""
    text = _text(docs)
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(
        i.alias("line"), F.xxhash64(x).alias("h1"), F.xxhash64(F.lit("line"), x).alias("h2"),
        F.regexp_count(x, F.lit(WORD)).alias("words"))), lambda s: s["words"] > 0)
    return docs.select(docs["doc_id"].alias("doc_id"), F.xxhash64(text).alias("text_hash"), lines.alias("lines"))


def line_sequence(docs: DataFrame, min_words: int) -> DataFrame:
    """One row per line: pos (its place in the whole sequence), doc_id,
    text_hash, line, h1, h2, depth (lines from here until the words suffice;
    null if the document ends before), longest (depth, or the lines from here
    while those after the first have too few words to be a run) and n_after
    (lines after this one in its document)."""
    rows = _line_rows(docs)
    one = rows.groupBy("doc_id", "text_hash").agg(F.max(F.size("lines")).alias("n"))
    starts = running_total(one.withColumn("no_id", F.col("doc_id").isNull()), ["no_id", "doc_id", "text_hash"],
                           F.col("n"), "start", "line-starts").select(
        F.col("doc_id").alias("s_id"), F.col("text_hash").alias("s_hash"), "start", F.col("n").alias("n_lines"))
    lines = stored(rows.select("doc_id", "text_hash", F.posexplode("lines").alias("k", "l")).select(
        "doc_id", "text_hash", "k", "l.*"), "lines").dropDuplicates(["doc_id", "text_hash", "k"])
    here = Window.partitionBy("doc_id", "text_hash").orderBy("k")
    words = F.sum("words").over(here.rowsBetween(Window.unboundedPreceding, 0))
    summed = lines.withColumn("upto", words.cast("long"))
    # every line has a word: min_words lines ahead hold enough
    ahead = F.collect_list("upto").over(here.rowsBetween(0, min_words - 1))
    need = F.col("upto") - F.col("words") + F.lit(min_words)
    marked = summed.withColumn("need", need).withColumn("ahead", ahead).withColumn("depth", F.when(
        F.element_at("ahead", -1) >= F.col("need"), F.size(F.filter("ahead", lambda u: u < F.col("need"))) + 1)).withColumn("longest", F.when(
            F.col("depth").isNotNull(), F.greatest("depth", F.size(F.filter("ahead", lambda u: u < F.col("upto") + min_words)))))
    return marked.join(starts, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("text_hash") == F.col("s_hash"))).select(
        (F.col("start") + F.col("k")).alias("pos"), "doc_id", "text_hash", "line", "h1", "h2", "depth", "longest",
        (F.col("n_lines") - 1 - F.col("k")).alias("n_after"))


def rank_pairs(pairs: DataFrame, name: str) -> DataFrame:
    """(pos, a, b) -> (pos, rank) of the suffixes that share their pair with
    another: 1 + the number of such suffixes with a smaller pair."""
    classes = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ranked = running_total(classes, ["a", "b"], F.col("n"), "rank", name).select(
        F.col("a").alias("r_a"), F.col("b").alias("r_b"), (F.col("rank") + 1).alias("rank"))
    return pairs.join(ranked, (F.col("a") == F.col("r_a")) & (F.col("b") == F.col("r_b"))).select("pos", "rank")


def _at(ranks: DataFrame, shift: Column | int) -> DataFrame:
    return ranks.select((F.col("pos") - shift).alias("at"), F.col("rank").alias("next"))


def suffix_ranks(lines: DataFrame, depth: int) -> dict[int, DataFrame]:
    """h -> (pos, rank) by the first h lines, for h = 1, 2, 4, ... up to
    ``depth``; only suffixes that share these lines with another. ``lines``
    has pos, h1, h2 and n_after (lines after this one in its document)."""
    levels = {1: stored(rank_pairs(lines.select("pos", F.col("h1").alias("a"), F.col("h2").alias("b")), "ranks-1"), "suffixes-1")}
    h = 1
    while 2 * h <= depth:
        now = levels[h]
        longer = now.join(lines.where(F.col("n_after") >= 2 * h - 1).select(F.col("pos").alias("p")), F.col("pos") == F.col("p"))
        pairs = longer.select("pos", F.col("rank").alias("a")).join(_at(now, h), F.col("pos") == F.col("at")).select(
            "pos", "a", F.col("next").alias("b"))
        levels[2 * h] = stored(rank_pairs(pairs, f"ranks-{2 * h}"), f"suffixes-{2 * h}")
        h *= 2
    return levels


def later_copies(lines: DataFrame, levels: dict[int, DataFrame]) -> DataFrame:
    """(pos, depth) of the windows of each number of lines from ``depth`` to
    ``longest`` that also start earlier: members of an interval other than
    its smallest position."""
    # of lines that repeat at all
    lines = lines.where("depth IS NOT NULL").join(levels[1].select(F.col("pos").alias("r")), F.col("pos") == F.col("r"), "left_semi").select(
        "pos", F.explode(F.sequence("depth", "longest")).alias("depth"))
    parts = []
    for h, ranks in levels.items():
        top = F.lit(2 * h) if 2 * h in levels else F.lit(1 << 30)
        start = lines.where((F.col("depth") >= h) & (F.col("depth") < top)).select(F.col("pos").alias("p"), "depth")
        begun = ranks.join(start, F.col("pos") == F.col("p")).select(
            "pos", "depth", F.col("rank").alias("a"), (F.col("pos") + F.col("depth") - h).alias("second"))
        parts.append(begun.join(ranks.select(F.col("pos").alias("q"), F.col("rank").alias("b")), F.col("second") == F.col("q"))
                     .select("pos", "depth", "a", "b"))
    runs = parts[0]
    for p in parts[1:]:
        runs = runs.union(p)
    runs = stored(runs, "runs")
    # stored: the join deals both sides anew, and Spark may split a common run
    first = stored(runs.groupBy(*[F.col(c).alias(f"f_{c}") for c in ("depth", "a", "b")]).agg(
        F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "first-copies")
    same = [F.col(c) == F.col(f"f_{c}") for c in ("depth", "a", "b")]
    return runs.join(first, same[0] & same[1] & same[2]).where("pos > first").select("pos", "depth")


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Documents (doc_id, text) -> one row per document with deleted lines:
    doc_id, text_hash, lines (places among the ``\\n``-split lines, sorted)
    and n_runs (maximal runs of deleted lines)."""
    lines = stored(line_sequence(docs, min_words), "line-sequence")
    deepest = lines.agg(F.max("longest")).first()[0] or 1
    copies = later_copies(lines, suffix_ranks(lines, deepest))
    gone = copies.select(F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("depth") - 1)).alias("g")).distinct()
    # a document's deleted lines: bounded by its text
    hit = lines.join(gone, F.col("pos") == F.col("g")).groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("at"))
    run_starts = F.transform("at", lambda x, i: F.when(
        (i == 0) | (x["pos"] != F.element_at("at", F.greatest(i, F.lit(1)))["pos"] + 1), 1).otherwise(0))
    return hit.select("doc_id", "text_hash", F.transform("at", lambda x: x["line"]).alias("lines"),
                      F.aggregate(run_starts, F.lit(0), lambda acc, x: acc + x).cast("long").alias("n_runs"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, report: bool = False) -> DataFrame:
    """The documents, all columns, with later copies of maximal repeated line
    runs deleted from ``text``. With ``report``: doc_id, n_lines (with a
    word), n_removed, n_runs, kept_sha256 of the text that stays."""
    gone = repeated_lines(docs, min_words).select(
        F.col("doc_id").alias("g_id"), F.col("text_hash").alias("g_hash"), F.col("lines").alias("g_lines"), "n_runs")
    text = _text(docs)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["doc_id"].alias("d_id"),
                       F.xxhash64(text).alias("d_hash"))
    out = rows.join(gone, F.col("d_id").eqNullSafe(F.col("g_id")) & (F.col("d_hash") == F.col("g_hash")), "left")
    lines = F.split(F.coalesce(F.col("doc.text"), F.lit("")), "\n", -1)
    # places that stay, by a hash set: linear in the lines
    stay = let(lines, lambda ls: F.array_join(F.transform(F.array_except(
        F.sequence(F.lit(0), F.size(ls) - 1), "g_lines"), lambda i: F.get(ls, i)), "\n"))
    kept = F.when(F.col("g_lines").isNull(), F.col("doc.text")).otherwise(stay)
    if not report:
        return out.select(*[kept.alias(c) if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
    with_word = F.size(F.filter(lines, lambda x: F.translate(x, SPACES, "") != "")).cast("long")
    zero = F.lit(0).cast("long")
    return out.select(F.col("doc.doc_id").alias("doc_id"), with_word.alias("n_lines"),
                      F.when(F.col("g_lines").isNull(), zero).otherwise(F.size("g_lines").cast("long")).alias("n_removed"),
                      F.coalesce("n_runs", zero).alias("n_runs"),
                      F.sha2(F.coalesce(kept, F.lit("")).cast("binary"), 256).alias("kept_sha256"))
