"""Quality rules from cross-document line frequency. Column functions only.

Lines are normalised and hashed; for every host the distinct documents that
hold a line are counted. A line in more documents than the limit is
boilerplate: it is removed, and a document that keeps too little is rejected.

A document is an id with its text: repeated rows count once, and an id with two texts
is two documents. Exact copies under ids of their own are documents of their own, so a
line that copies of one page share is as frequent as there are copies; with
``LineRules(copies_once=True)`` all of a host's copies of a text are one document.

Defined results: a null text is an empty one; a null host is a host of its own;
ids may be null and may repeat, they only name the result's rows; documents
without words fail the base rules; lines of any length and texts of any number of
lines are taken whole; a line that is exactly at a limit stays; rows with the same
text and host get the same result each; other columns are left alone, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, ascii_lower, let, stored, words


@dataclass(frozen=True)
class LineRules:
    """``min_docs`` and ``max_share``: a line is above the limit in a host if more
    distinct documents hold it than both ``min_docs`` and ``max_share`` of the
    host's distinct documents. A document is depleted if it has lost lines and
    keeps under ``min_words`` words or under ``min_kept`` of its words.
    ``copies_once`` counts a host's exact copies as one document."""

    min_docs: int = 20
    max_share: float = 0.005
    min_words: int = 3
    min_kept: float = 0.1
    copies_once: bool = False


def repeat_words(ws: Column, window: int = 5) -> Column:
    """Words in windows of ``window`` words that are found twice or more in the
    array ``ws``, the first ones included.

    Windows are compared by a 64-bit hash of their words' hashes. Sorting them
    with their positions puts equal ones side by side in n log n steps; texts
    without a repeated window, by far the most, stop at a hash set.
    """

    def covered(win: Column) -> Column:
        at = F.array_sort(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        found = let(
            at,
            lambda s: F.array_sort(
                F.transform(
                    F.filter(
                        F.transform(s, lambda x, k: F.struct(x["i"].alias("i"), (x["h"].eqNullSafe(F.get(s, k - 1)["h"]) | x["h"].eqNullSafe(F.get(s, k + 1)["h"])).alias("twice"))),
                        lambda x: x["twice"],
                    ),
                    lambda x: x["i"],
                )
            ),
        )
        return let(
            found,
            lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1), x + window) - x)),
                F.lit(0).cast("long"),
                lambda total, n: total + n,
            ),
        )

    def from_hashes(h: Column) -> Column:
        n = F.size(h) - (window - 1)
        win = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))
        once = F.lit(0).cast("long")
        return F.when(n < 2, once).otherwise(let(win, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), once).otherwise(covered(w))))

    return let(F.transform(ws, lambda w: F.xxhash64(w)), from_hashes)


def base_measures(text: Column) -> Column:
    """A struct of the base rules' measures of one text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))

    def of_words(ws: Column) -> Column:
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            repeat_words(ws).alias("n_repeat_words"),
        )

    return F.struct(
        let(words(text), of_words).alias("w"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    )


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def normal_line(line: Column) -> Column:
    """Lower case, runs of digits as 0, white space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " "))


def _keyed(docs: DataFrame, id_col: str, text_col: str, host_col: str, copies_once: bool = False) -> DataFrame:
    """Only the columns needed, with names of our own. ``key`` tells documents apart."""
    text = F.coalesce(docs[text_col], F.lit(""))
    text_hash = F.xxhash64(text)
    key = text_hash if copies_once else F.xxhash64(docs[id_col], text_hash)
    return docs.select(docs[id_col].alias("doc"), docs[host_col].alias("host"), text.alias("text"), text_hash.alias("text_hash"), key.alias("key"))


def document_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", copies_once: bool = False) -> DataFrame:
    """``(host, text_hash, key, at, line, n)``: for each document, place and line with
    a word, the hash of the line's normal form and its words."""
    keyed = _keyed(docs, id_col, text_col, host_col, copies_once)
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    n = lambda x: 1 + F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))  # noqa: E731  its words have one blank between them
    hashed = F.transform(F.transform(lines, normal_line), lambda x, i: F.struct(i.alias("at"), F.xxhash64(x).alias("line"), n(x).alias("n")))
    return keyed.select("host", "text_hash", "key", F.inline(hashed))


def host_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", copies_once: bool = False) -> DataFrame:
    """``(host, docs)``: the number of distinct documents of each host, those
    without words included."""
    each = _keyed(docs, id_col, text_col, host_col, copies_once).groupBy("host", "key").agg(F.lit(1).alias("one"))
    return each.groupBy("host").agg(F.count("*").alias("docs"))


def frequent_lines(lines: DataFrame, sizes: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """Lines above the limits, from the rows of ``document_lines`` and
    ``host_sizes``: ``(host, line, n, docs)``. A line's documents are first told
    apart by host, line and key, so one that very many documents hold is spread
    over all tasks, and then counted with partial sums."""
    held = lines.groupBy("host", "line", "key").agg(F.lit(1).alias("one"))
    counts = held.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > rules.min_docs)
    above = counts.join(sizes.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") > rules.max_share * F.col("docs"))
    return above.select("host", "line", "n", "docs")


def removed_lines(docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Documents with lines above the limits: ``(host, text_hash, removed_words,
    removed)``; ``removed`` holds the hashes of the lines to remove."""
    lines = stored(document_lines(docs, id_col, text_col, host_col, rules.copies_once), "lines")
    often = stored(frequent_lines(lines, host_sizes(docs, id_col, text_col, host_col, rules.copies_once), rules), "frequent-lines").select(F.col("host").alias("h"), F.col("line").alias("l"))
    return (
        lines.join(often, F.col("line").eqNullSafe(F.col("l")) & F.col("host").eqNullSafe(F.col("h")))
        .groupBy("host", "text_hash", "at", "line", "n")  # copies and repeated rows
        .agg(F.lit(1).alias("one"))
        .groupBy("host", "text_hash")
        .agg(F.sum("n").alias("removed_words"), F.collect_set("line").alias("removed"))
    )


def depleted(n_words: Column, removed_words: Column, rules: LineRules) -> Column:
    """Whether lines were removed and too little is left."""
    left = n_words - removed_words
    return (removed_words > 0) & ((left < rules.min_words) | (left < rules.min_kept * n_words))


def judge(docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: ``doc``, the base measures, ``base_failed``,
    ``removed_words`` and ``kept``."""
    m = _keyed(docs, id_col, text_col, host_col).select("doc", "host", "text_hash", base_measures(F.col("text")).alias("m"))
    m = m.select(
        "doc",
        "host",
        "text_hash",
        F.col("m.w.n_words").alias("n_words"),
        F.col("m.w.word_chars").alias("word_chars"),
        F.col("m.n_symbols").alias("n_symbols"),
        F.col("m.n_dup_lines").alias("n_dup_lines"),
        F.col("m.w.n_repeat_words").alias("n_repeat_words"),
    )
    gone = removed_lines(docs, rules, id_col, text_col, host_col).select(F.col("host").alias("h"), F.col("text_hash").alias("t"), "removed_words")
    judged = m.join(gone, m.host.eqNullSafe(F.col("h")) & (m.text_hash == F.col("t")), "left")
    removed = F.coalesce("removed_words", F.lit(0).cast("long"))
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return judged.select(
        "doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        removed.alias("removed_words"),
        (~failed & ~depleted(F.col("n_words"), removed, rules)).alias("kept"),
    )


def clean(docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The documents that pass, with every column of ``docs``: lines above the
    limits are removed from their texts, other texts are as they were."""
    gone = removed_lines(docs, rules, id_col, text_col, host_col)
    gone = gone.select(F.struct(F.col("host").alias("h"), F.col("text_hash").alias("t")).alias("_key"), F.struct("removed_words", "removed").alias("_gone"))
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), text.alias("_text"), F.struct(docs[host_col].alias("h"), F.xxhash64(text).alias("t")).alias("_key"))
    ws = let(words(F.col("_text")), lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("r")))
    rows = rows.withColumn("_w", ws).where(~base_failed(F.col("_w.n"), F.col("_w.r")))
    rows = rows.join(gone.withColumnRenamed("_key", "_gone_key"), F.col("_key").eqNullSafe(F.col("_gone_key")), "left")
    rows = rows.where(F.col("_gone").isNull() | ~depleted(F.col("_w.n"), F.col("_gone.removed_words"), rules))
    kept_lines = F.filter(F.split("_text", "\n"), lambda x: ~x.rlike(WORD) | ~F.array_contains(F.col("_gone.removed"), F.xxhash64(normal_line(x))))
    new_text = F.when(F.col("_gone").isNull(), F.col("_row").getField(text_col)).otherwise(F.array_join(kept_lines, "\n"))
    return rows.select(*[new_text.alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns])
