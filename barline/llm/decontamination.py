"""Benchmark decontamination by spaced seeds: masked token windows of tests and training texts meet by hash, and the overlaps
around the hits are verified token by token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 1 where a mask compares, 0 where it ignores a token; eight places each. Each place is ignored by one of them at least; chosen by
#: search for the largest share of hits in overlaps of 24 tokens with 15 to 30 % of them substituted.
MASKS = ("101110110011", "110100101111", "111001110101", "010111011110")
SPAN = 12
#: Tokens of a text that are laid out as windows at once.
PIECE = 4096
#: Rows of the benchmark's seeds (three longs each) up to which they are broadcast; a larger benchmark is met by a shuffle.
BROADCAST_ROWS = 2_000_000


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits. The first or last element is empty where the text begins or ends otherwise."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+")


def _windows(rows: DataFrame, key: str, span: int) -> DataFrame:
    """key, pos and the window's tokens w0 on, for all whole windows of t; a long text is laid out piece by piece."""
    pieces = F.sequence(F.lit(0), F.greatest(F.size("t") - span, F.lit(0)), F.lit(PIECE))
    held = rows.where(F.size("t") >= span).select(key, "t", F.explode(pieces).alias("base")).select(key, "base", F.slice("t", F.col("base") + 1, PIECE + span - 1).alias("t"))
    n = F.size("t")
    shifted = [F.slice("t", i + 1, n - (span - 1)).alias(f"w{i}") for i in range(span)]
    laid = held.select(key, "base", F.posexplode(F.arrays_zip(*shifted)).alias("at", "w"))
    return laid.select(key, (F.col("base") + F.col("at")).alias("pos"), "w")


def _seeds(windows: DataFrame, key: str) -> DataFrame:
    """key, pos, seed: a hash for each mask, which depends on the mask too."""
    hashes = [F.xxhash64(F.lit(m), *(F.col(f"w.w{i}") for i, c in enumerate(mask) if c == "1")) for m, mask in enumerate(MASKS)]
    return windows.select(key, "pos", F.explode(F.array(*hashes)).alias("seed"))


def _whole(windows: DataFrame, key: str, span: int) -> DataFrame:
    """The same for a short item's whole sequence."""
    return windows.select(key, "pos", F.xxhash64(F.lit(-span), *(F.col(f"w.w{i}") for i in range(span))).alias("seed"))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs: doc_id, text; benchmark: item_id, text (others ignored). Returns doc_id, item_id, matched, around, longest, n_tokens for each
    document and item that share a seed.

    matched counts the item's tokens that equal the document's at one alignment, the best one; around those of all alignments together
    that equal the document's within a window of a hit, so that pieces of an item in any order add up; longest is the longest run of
    equal tokens of one alignment.

    Items of fewer than 12 tokens are seeded by their whole sequence, those without tokens meet nothing. Null texts are empty; rows of null
    doc_id or item_id meet nothing. Rows of one id are looked at together. Very long texts: their windows are laid out piece by piece.
    No rows on either side: no rows.
    """
    items = benchmark.where("item_id is not null").select("item_id", F.filter(tokens(F.col("text")), lambda t: t != "").alias("t"))
    held = docs.where("doc_id is not null").select("doc_id", "text")
    # pos counts from the first element of a document's tokens, empty or not
    laid = held.select("doc_id", tokens(F.col("text")).alias("t"))
    seeds, own = _seeds(_windows(items, "item_id", SPAN), "item_id"), _seeds(_windows(laid, "doc_id", SPAN), "doc_id")
    short = items.where(F.size("t").between(1, SPAN - 1))
    for span in sorted(x.n for x in short.select(F.size("t").alias("n")).distinct().collect()):  # eleven lengths at most
        seeds = seeds.union(_whole(_windows(short.where(F.size("t") == span), "item_id", span), "item_id", span))
        own = own.union(_whole(_windows(laid, "doc_id", span), "doc_id", span))
    seeds = seeds.toDF("item_id", "at", "seed").distinct()
    if seeds.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        seeds = F.broadcast(seeds)
    hits = own.join(seeds, "seed").select("doc_id", "item_id", (F.col("pos") - F.col("at")).alias("shift"), "at").distinct()
    shifts = hits.groupBy("doc_id", "item_id", "shift").agg(F.collect_set("at").alias("at"))  # places in one item
    placed = shifts.join(held, "doc_id").join(items.withColumnRenamed("t", "item"), "item_id")
    placed = placed.select("doc_id", "item_id", "item", "shift", "at", tokens(F.col("text")).alias("t"))
    same = F.transform("item", lambda t, i: t.eqNullSafe(F.get("t", F.col("shift") + i)))
    placed = placed.select("doc_id", "item_id", "at", same.alias("same"))
    # in a hit's window: the tokens of the item that are equal, by place
    near = F.filter(F.sequence(F.lit(0), F.size("same") - 1), lambda i: F.get("same", i) & F.exists("at", lambda a: (i >= a) & (i < a + SPAN)))
    runs = F.transform(F.split(F.array_join(F.transform("same", lambda x: F.when(x, "1").otherwise("0")), ""), "0+"), F.char_length)
    verified = placed.select("doc_id", "item_id", F.size(F.filter("same", lambda x: x)).alias("matched"), near.alias("near"), F.array_max(runs).alias("longest"), F.size("same").alias("n_tokens"))
    each = verified.select("doc_id", "item_id", "matched", "longest", "n_tokens", F.explode_outer("near").alias("place"))
    most = (F.max(c).alias(c) for c in ("matched", "longest", "n_tokens"))
    return each.groupBy("doc_id", "item_id").agg(*most, F.count_distinct("place").cast("int").alias("around"))


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.5, least: int = 10, run: int = 13) -> DataFrame:
    """The overlaps that count: half of an item's tokens or more, and ten at least, at one alignment or around the hits of all; a run of
    13 tokens, whatever the item's length; a whole item of five to nine tokens. Shorter ones are too common to tell.
    """
    most = F.greatest("matched", "around")
    long = (most >= share * F.col("n_tokens")) & (most >= least)
    whole = (F.col("longest") == F.col("n_tokens")) & (F.col("n_tokens") >= 5)
    return overlaps(docs, benchmark).where(long | whole | (F.col("longest") >= run))
