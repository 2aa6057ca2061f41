"""Mixing sources to target weights. DataFrame functions only.

The words of a source's documents, one document after the other, are a stream
that is cut into blocks of a fixed length. Output shards hold a fixed number of
slots; for each shard the number of slots of each source is drawn from a
multinomial distribution. The slots of a source are numbered through all
shards, slot k stands in epoch k div n and index k mod n of the source's n
blocks, and a pseudorandom permutation of its own for each source and epoch
maps the index to a block. Blocks meet documents by a join on source and block.

So that a mix meets its targets and not only its expectations, slots beyond a
source's quota are dropped, missing ones are added in shard -1, and the last
slot is cut within its block.

Defined results: a null text has no words; a null source is the last of the
sources; documents without words are never taken; repeated rows are documents
of their own; the order of documents in a stream is that of hashed ids, so
nothing depends on files or partitions; an empty table gives an empty result.
The table of sources, one small row each, is ranked in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored


@dataclass(frozen=True)
class Mix:
    """``weights``: given to the sources in code point order, null last, again and
    again; ``max_epochs``: no source is taken more often; ``rounds`` of the
    permutation; ``chunk``: documents, or blocks, that one step of a running
    total covers."""

    weights: tuple[float, ...] = (1.0, 2.0, 3.0)
    max_epochs: int = 3
    block_words: int = 512
    shard_slots: int = 1024
    rounds: int = 16
    seed: int = 17
    chunk: int = 2000


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sized: DataFrame, mix: Mix) -> DataFrame:
    """``(sid, source, source_size, target)`` from rows with ``source`` and ``size``.

    Water-filling: in ascending order of cap over weight, the first source whose
    share of what the capped ones before it leave is within its cap sets the
    level for itself and all after it.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    weights = F.array(*[F.lit(float(w)) for w in mix.weights])
    t = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("sid", F.row_number().over(by_name).cast("long"))
    t = t.withColumn("weight", F.get(weights, ((F.col("sid") - 1) % len(mix.weights)).cast("int"))).withColumn("cap", F.lit(float(mix.max_epochs)) * F.col("source_size"))
    everything = Window.partitionBy()
    t = t.withColumn("total", F.sum("source_size").over(everything)).withColumn("all_weights", F.sum("weight").over(everything))
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    t = t.withColumn("level", left / (F.col("all_weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("sid"), F.col("level").alias("level")))
    t = t.withColumn("level", F.min(fits).over(everything)["level"])
    return t.select("sid", "source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), "cap")).alias("target"))


def _positioned(rows: DataFrame, mix: Mix, count: int) -> DataFrame:
    """Adds ``start``, the words of the source before each row. Totals of chunks
    come first, so that a source of any size is spread over many tasks."""
    chunks = max(1, count // mix.chunk)
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.lit(mix.seed)), F.lit(chunks)))
    totals = rows.groupBy("sid", "chunk").agg(F.sum("size").alias("n"))
    ahead = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("sid", "chunk", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("sid", "chunk").orderBy("doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(totals, ["sid", "chunk"]).withColumn("start", F.col("before") + F.col("inside")).drop("before", "inside", "chunk")


def permuted(index: Column, n: Column, rounds: int, *keys: Column) -> Column:
    """Swap-or-not: a keyed pseudorandom permutation of 0..n-1 for any n. Each
    round pairs every index with its mirror about a key and swaps the two or
    not, by a hash bit of the larger."""

    def step(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(*keys, r), n) - x, n)
        return F.when(F.xxhash64(*keys, r, F.greatest(x, mirror), F.lit(1)) % 2 == 0, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index.cast("long"), step)


def _slots(sources: DataFrame, mix: Mix) -> DataFrame:
    """``(sid, shard, slot, epoch, block, words)``: the blocks that each shard takes."""
    spark = sources.sparkSession
    size, block = F.col("source_size"), F.lit(mix.block_words)
    t = (
        sources.where("source_size > 0")
        .withColumn("quota", F.round("target").cast("long"))
        .withColumn("blocks", F.expr(f"(source_size + {mix.block_words - 1}) div {mix.block_words}"))
        .withColumn("epochs", F.expr("quota div source_size"))
        .withColumn("rest", F.expr("quota % source_size"))
        .withColumn("slots", F.col("epochs") * F.col("blocks") + F.when(F.col("rest") > 0, F.least("blocks", F.ceil(F.col("rest") / block) + 1)).otherwise(0))
    )
    t = stored(t.select("sid", size, "blocks", "epochs", "rest", "slots"), "mix-sources")
    total = t.agg(F.sum("slots")).first()[0] or 0

    # A slot's uniform number falls in one cell of a grid, and a join on the cell finds the sources there.
    cells = 4096
    upto = F.sum("slots").over(Window.orderBy("sid"))
    grid = t.withColumn("high", upto / F.lit(float(max(total, 1)))).withColumn("low", (upto - F.col("slots")) / F.lit(float(max(total, 1))))
    grid = grid.where("slots > 0").select("sid", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.lit(cells - 1), F.floor(F.col("high") * cells)))).alias("cell"))
    drawn = spark.range(total).select(F.expr(f"id div {mix.shard_slots}").alias("shard"), (F.shiftrightunsigned(F.xxhash64("id", F.lit(mix.seed)), 11) / F.lit(float(1 << 53))).alias("u"))
    drawn = drawn.withColumn("cell", F.floor(F.col("u") * cells)).join(grid, "cell").where("u >= low and u < high")
    counts = drawn.groupBy("sid", "shard").agg(F.count("*").alias("n"))

    through = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.join(t, "sid").withColumn("first", F.coalesce(F.sum("n").over(through), F.lit(0)))
    kept = counts.withColumn("n", F.least("n", F.col("slots") - F.col("first"))).where("n > 0")
    short = t.join(counts.groupBy("sid").agg(F.sum("n").alias("got")), "sid", "left").withColumn("first", F.coalesce("got", F.lit(0))).where("first < slots")
    cols = ["sid", "source_size", "blocks", "epochs", "rest", "shard", "first", "n"]
    ranges = kept.select(cols).unionByName(short.withColumn("shard", F.lit(-1).cast("long")).withColumn("n", F.col("slots") - F.col("first")).select(cols))

    s = ranges.select("*", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("slot"))
    s = s.withColumn("epoch", F.expr("slot div blocks")).withColumn("index", F.expr("slot % blocks"))
    s = s.withColumn("block", permuted(F.col("index"), F.col("blocks"), mix.rounds, F.lit(mix.seed), F.col("sid"), F.col("epoch")))
    s = s.withColumn("length", F.least(block, size - F.col("block") * block))
    s = stored(s.select("sid", "source_size", "blocks", "epochs", "rest", "shard", "slot", "epoch", "index", "block", "length"), "mix-slots")

    # In the last, partial epoch slots are cut where the quota is full; only a source's last block is short.
    tail = s.where("block = blocks - 1 and epoch = epochs").select("sid", F.col("index").alias("short_at"), F.col("length").alias("short_length"))
    s = s.join(tail, "sid", "left")
    ahead = F.col("index") * block - F.when(F.col("index") > F.col("short_at"), block - F.col("short_length")).otherwise(0)
    taken = F.when(F.col("epoch") < F.col("epochs"), F.col("length")).otherwise(F.greatest(F.lit(0), F.least("length", F.col("rest") - ahead)))
    return s.select("sid", "shard", "slot", "epoch", "block", taken.alias("words")).where("words > 0")


@dataclass(frozen=True)
class Mixed:
    """``documents``: every row with ``sid, start, size, source_size, target``.
    ``slots``: what each shard takes. ``pieces``: for each document and slot that
    meet, the words from ``low`` to ``high`` of the document that are taken."""

    documents: DataFrame
    slots: DataFrame
    pieces: DataFrame


def mix_documents(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", with_rows: bool = False) -> Mixed:
    """Mix ``docs``. ``with_rows`` keeps whole rows in the struct column ``row``."""
    text = F.coalesce(docs[text_col], F.lit(""))
    own = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if with_rows else []
    rows = docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), n_words(text).alias("size"), F.xxhash64(text).alias("tie"), *own)
    sized = stored(rows.drop("row"), "mix-sizes")
    sources = stored(source_targets(sized, mix), "mix-targets")
    rows = (rows if with_rows else sized).join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "source")
    placed = stored(_positioned(rows, mix, sized.count()), "mix-documents")
    slots = stored(_slots(sources, mix), "mix-taken")
    block = mix.block_words
    spans = placed.where("size > 0").select("sid", "start", "size", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block"))
    pieces = spans.join(slots, ["sid", "block"]).select(
        "sid",
        "start",
        "shard",
        "slot",
        "epoch",
        F.greatest(F.lit(0), F.col("block") * block - F.col("start")).alias("low"),
        F.least("size", F.col("block") * block + F.col("words") - F.col("start")).alias("high"),
    )
    return Mixed(placed, slots, pieces.where("high > low"))


def taken_words(mixed: Mixed) -> DataFrame:
    """A row for each document: ``doc_id, size, source_size, target, taken``."""
    taken = mixed.pieces.groupBy("sid", "start").agg(F.sum(F.col("high") - F.col("low")).alias("n"))
    taken = taken.withColumn("some", F.lit(True))
    docs = mixed.documents.withColumn("some", F.col("size") > 0)  # a start belongs to one document with words
    return docs.join(taken, ["sid", "start", "some"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("n", F.lit(0).cast("long")).alias("taken"))


def mixed_texts(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as rows like those of ``docs``: one for each document and epoch
    that takes any of its words, with the text of those words and the white
    space after each; a document that an epoch takes whole keeps its text."""
    mixed = mix_documents(docs, mix, id_col, text_col, source_col, with_rows=True)
    parts = mixed.pieces.groupBy("sid", "start", "epoch").agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("parts"), F.sum(F.col("high") - F.col("low")).alias("n"))
    rows = mixed.documents.where("size > 0").join(parts, ["sid", "start"])
    text = F.col("row").getField(text_col)
    units = F.regexp_extract_all(text, F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    cut = F.transform(F.array(units), lambda u: F.array_join(F.flatten(F.transform("parts", lambda p: F.slice(u, (p["low"] + 1).cast("int"), (p["high"] - p["low"]).cast("int")))), ""))[0]
    text = F.when(F.col("n") == F.col("size"), text).otherwise(cut)
    return rows.select(*[text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
