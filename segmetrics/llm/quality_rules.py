"""Quality rules: word and line counts per document, and cross-document
line frequency. Built-in functions only.

Base rules read one document at a time and stay inside its row: arrays of
words, windows and lines, no row per word. The frequency rule hashes every
line that has a word (white space squeezed, ASCII and other letters lower
case), counts per host (``source``) the distinct documents that hold the
line, and removes lines above both limits: more than ``max_docs`` documents
and more than ``max_share`` of the host's. Documents count as distinct by
their text, so that exact copies are one document. A document which loses
over half of its words is depleted and rejected.

Shuffled are (host, line hash, text hash) rows, combined map-side, and the
few lines above the limits; never a text.

Defined results: a null or empty text has no words and fails the base rules;
a null host is a host of its own; repeated rows get a result each; an empty
table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmetrics.llm.common import SPACES, WORD, let, stored

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_DOCS = 20
MAX_SHARE = 0.002
BASE_COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def repeated_words(words: Column, width: int = 3) -> Column:
    """Words that stand in a window of ``width`` words found twice or more in
    the array. Windows are hashed and compared inside one document only."""
    def covered(places: Column) -> Column:
        nexts = F.concat(F.slice(places, 2, F.size(places)), F.array(F.element_at(places, -1) + F.lit(width)))
        steps = F.zip_with(places, nexts, lambda a, b: F.least(F.lit(width), b - a))
        return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)

    def repeats(found: Column) -> Column:
        # found: the windows' (hash, place) in order of the hash
        last = F.size(found)
        same = lambda a, b: a["h"] == b["h"]
        marked = F.transform(F.sequence(F.lit(1), last), lambda k: F.when(
            ((k > 1) & same(F.element_at(found, k), F.element_at(found, F.greatest(k - 1, F.lit(1)))))
            | ((k < last) & same(F.element_at(found, k), F.element_at(found, F.least(k + 1, last)))),
            F.element_at(found, k)["i"]))
        return let(F.sort_array(F.filter(marked, lambda x: x.isNotNull())), covered)

    def count(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - F.lit(width - 1))
        hashes = F.transform(starts, lambda i: F.xxhash64(*[F.element_at(w, i + F.lit(d)) for d in range(width)]))
        pairs = lambda hs: F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0))
                   .otherwise(let(pairs(hs), repeats)))

    return let(words, lambda w: F.when(F.size(w) < width, F.lit(0)).otherwise(count(w)))


def text_lines(text: Column) -> Column:
    """The ``\\n``-split lines of a text that have a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: _without(x, SPACES) != "")


def base_rules(docs: DataFrame, *keep: Column) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words (long), base_failed, and the columns ``keep``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    counted = docs.select(
        F.col("doc_id"),
        let(words, lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words"))).alias("w"),
        F.length(_without(text, SPACES)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        let(text_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.struct(*keep, F.lit(0).alias("_")).alias("keep"),
    )
    n, r = F.col("w.n_words"), F.col("w.n_repeat_words")
    kept = [f"keep.{c}" for c in counted.schema["keep"].dataType.names[:-1]]
    return counted.select("doc_id", n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
                          r.alias("n_repeat_words"), ((n < MIN_WORDS) | (100 * r > 50 * n)).alias("base_failed"), *kept)


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")))


def common_lines(lines: DataFrame, hosts: DataFrame, max_docs: int, max_share: float) -> DataFrame:
    """(host, line, text) hashes, one row per line and distinct text of a
    host -> the (host, line) above both limits."""
    n = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs"))
    h = hosts.select(F.col("host").alias("h_host"), "host_docs")
    return (n.where(F.col("n_docs") > max_docs).join(h, F.col("host").eqNullSafe(F.col("h_host")))
            .where(F.col("n_docs") > F.col("host_docs") * F.lit(max_share)).select("host", "line", "n_docs"))


def quality_rules(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE,
                  with_text: bool = False) -> DataFrame:
    """Documents (doc_id, text, source) -> one row per document: the base
    rules' columns, ``removed_lines`` and ``removed_words`` (of lines above
    the limits) and ``kept``: the base rules hold and at most half of the
    words are removed. ``with_text`` adds ``removed`` (the places of these
    lines among the ``\\n``-split ones, sorted) and ``remaining``, the text
    without them (null for a null text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    host, text_hash = F.col("source").alias("host"), F.xxhash64(text).alias("text_hash")
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(
        i.alias("place"), F.xxhash64(normalised(x)).alias("line"), F.regexp_count(x, F.lit(WORD)).alias("words"))),
        lambda x: x["words"] > 0)
    rows = stored(docs.select("doc_id", host, text_hash, F.explode(lines).alias("l")).select(
        "doc_id", "host", "text_hash", "l.*"), "line-hashes")
    # a line repeated in a text, or a text repeated in a host, counts once
    once = rows.select("host", "line", "text_hash").distinct()
    hosts = docs.select(host, text_hash).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    # stored: the join deals both sides anew, and Spark may split a common line
    common = stored(common_lines(once, hosts, max_docs, max_share).select(
        F.col("host").alias("c_host"), F.col("line").alias("c_line")), "common-lines")
    hit = rows.join(common, (F.col("line") == F.col("c_line")) & F.col("host").eqNullSafe(F.col("c_host")))
    # identical rows hold the same lines at the same places: count them once
    lost = hit.select("doc_id", "host", "text_hash", "place", "words").distinct().groupBy(
        F.col("doc_id").alias("r_id"), F.col("host").alias("r_host"), F.col("text_hash").alias("r_text")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("words").cast("long").alias("w"),
        # of one text: bounded by its lines
        *([F.sort_array(F.collect_list("place")).alias("places")] if with_text else []))
    base = base_rules(docs, host, text_hash, *([F.col("text").alias("whole")] if with_text else []))
    on = (F.col("doc_id").eqNullSafe(F.col("r_id")) & F.col("host").eqNullSafe(F.col("r_host"))
          & (F.col("text_hash") == F.col("r_text")))
    zero = F.lit(0).cast("long")
    out = base.join(lost, on, "left").withColumns(
        {"removed_lines": F.coalesce("n", zero), "removed_words": F.coalesce("w", zero)})
    kept = (~F.col("base_failed") & (2 * F.col("removed_words") <= F.col("n_words"))).alias("kept")
    columns = [*BASE_COLUMNS, "removed_lines", "removed_words", kept]
    if with_text:
        gone = F.coalesce("places", F.array().cast("array<int>"))
        stay = let(F.split("whole", "\n", -1), lambda ls: F.array_join(F.transform(F.array_except(
            F.sequence(F.lit(0), F.size(ls) - 1), gone), lambda i: F.get(ls, i)), "\n"))
        columns += [gone.alias("removed"), F.when(F.col("places").isNull(), F.col("whole")).otherwise(stay).alias("remaining")]
    return out.select(*columns)
