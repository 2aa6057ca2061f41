"""Token counts: an exact histogram of encoded lengths, and its suffix sums.

Documents are encoded and counted by their length, pre-aggregated in each task.
With the documents and tokens at or above every length, totals, quantiles and
truncated totals for any context limit follow without another look at a text.

Defined results: a null text is an empty one, of length 0; repeated rows count
each; null groups are a group; an empty table gives an empty histogram, for which
totals are 0 and quantiles null; texts of any length are encoded whole; other
columns are left alone, but a column to count by can't have a name that is used
here: ``length``, ``n_docs`` and so on raise a ValueError.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices

_encodings: dict = {}


def _encoding(path: str, pattern: str):
    import tiktoken

    if path not in _encodings:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def _free(by: tuple[str, ...]) -> None:
    if taken := {"length", "n_docs", "n_tokens", "_span", "_docs", "_tokens", "_all", "_text"} & set(by):
        raise ValueError(f"rename {', '.join(sorted(taken))} to count by it")


def encoded_lengths(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    """``length`` and the columns ``by`` for each row."""
    _free(by)
    rows = docs.select(docs[text_col].alias("_text"), *[docs[c] for c in by])
    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks_path, pattern)
        for batch in batches:
            for lo, hi in slices(batch.column(0), 2_000_000):
                found = [len(encoding.encode_ordinary(t or "")) for t in batch.column(0).slice(lo, hi - lo).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), *[c.slice(lo, hi - lo) for c in batch.columns[1:]]], names=["length", *by])

    return rows.mapInArrow(run, "length long" + kinds)


def histogram(lengths: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``(by..., length, n_docs)``."""
    return lengths.groupBy(*by, "length").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame, by: tuple[str, ...] = (), span: int = 1024) -> DataFrame:
    """The histogram with ``n_tokens``, ``docs_at_least``, ``tokens_at_least`` and
    ``truncated_total``, the tokens that a context limit of ``length`` leaves.

    Spans of lengths are summed first, so no task needs all lengths in order.
    """
    rows = hist.withColumn("n_tokens", F.col("length") * F.col("n_docs")).withColumn("_span", F.expr(f"length div {span}"))
    spans = rows.groupBy(*by, "_span").agg(F.sum("n_docs").alias("_docs"), F.sum("n_tokens").alias("_tokens"))
    above = Window.partitionBy(*by).orderBy(F.desc("_span")).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*by, "_span", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(c) for c in ("_docs", "_tokens")], F.sum("_tokens").over(Window.partitionBy(*by)).alias("_all"))
    spans = spans.withColumnsRenamed({c: f"_{c}_of" for c in (*by, "_span")})
    same = F.lit(True)
    for c in (*by, "_span"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}_of"))
    rows = rows.join(spans, same)
    inside = Window.partitionBy(*by, "_span").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    docs, tokens = F.col("_docs") + F.sum("n_docs").over(inside), F.col("_tokens") + F.sum("n_tokens").over(inside)
    return rows.select(*by, "length", "n_docs", "n_tokens", docs.alias("docs_at_least"), tokens.alias("tokens_at_least"), (F.col("_all") - tokens + F.col("length") * docs).alias("truncated_total"))


def totals(sums: DataFrame) -> DataFrame:
    """``(n_docs, n_tokens)`` of ungrouped suffix sums."""
    return sums.agg(F.coalesce(F.max("docs_at_least"), F.lit(0)).alias("n_docs"), F.coalesce(F.max("tokens_at_least"), F.lit(0)).alias("n_tokens"))


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """One row: ``truncated_<limit>``, the tokens that are left of all documents
    if none may have more than the limit."""

    def left(limit: int) -> Column:
        above = F.min_by(F.struct("docs_at_least", "tokens_at_least"), F.when(F.col("length") >= limit, F.col("length")))
        total = F.coalesce(F.max("tokens_at_least"), F.lit(0))
        return total - F.coalesce(above["tokens_at_least"] - limit * above["docs_at_least"], F.lit(0))

    return sums.agg(*[left(x).alias(f"truncated_{x}") for x in limits])


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """One row: ``quantile_<share>``, the least length that at least this share of
    the documents doesn't exceed."""
    total = sums.agg(F.max("docs_at_least")).first()[0] or 0
    upto = F.lit(total) - F.col("docs_at_least") + F.col("n_docs")
    return sums.agg(*[F.min(F.when(upto >= F.ceil(F.lit(q * total)), F.col("length"))).alias(f"quantile_{q}") for q in shares])
