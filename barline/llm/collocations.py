"""Phrase mining by tiles of frequency-ranked ids.

Texts are cut into slices of many documents of one language. Words that are frequent enough get ids by falling frequency, so that frequent
pairs of ids crowd together near the origin of the matrix of pairs. The matrix is split into tiles; within a slice crowded tiles are
counted by direct addresses (numpy's bincount), the others as sorted coordinates, and Spark adds up the slices' counts. For longer phrases
a slice ranks its frequent pairs again, by their own frequency, and counts pairs of such a rank and a word in the same way, and so on.

Which pairs are frequent a slice learns from a filter of fixed size, which is all that passes through the driver; what it lets pass wrongly is counted
exactly and found to be rare. Ids of words grow with the data, so slices meet them by keys, never by broadcast.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.llm._spark import written
from barline.llm._text import mix, text_bytes
from barline.plans.ranks import ranked

#: Words of a slice; bits of a tile's side; a tile with one occurrence for so many cells is counted by direct addresses.
SLICE_WORDS, TILE_BITS, CROWDED = 1_500_000, 11, 16
#: Bits of the filter of frequent phrases (8 MB for each length, whatever the data).
FILTER_BITS = 26

_TILES = 4  # tiles on a side of the corner that can be crowded
#: Lower case, tabs as spaces and the ends of pieces as line feeds.
_TABLE = bytearray(range(256))
_TABLE[65:91] = range(97, 123)
for _b in b".,;:!?\x0a\x0b\x0c\x0d":
    _TABLE[_b] = 0x0A


def squeezed(ids: np.ndarray) -> bytes:
    """Ids by planes of their bytes, compressed."""
    planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def expanded(held: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(held), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _slices(most: int):
    """Slices of so many words at most, or of one text."""
    return lambda batches: _cut(batches, most)


def _cut(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The words of many texts of a language: its distinct words and their counts, and the stream of their places among these, from 1 on; 0 ends a piece."""
    table, made = bytes(_TABLE), count(TaskContext.get().partitionId() << 32)
    held: dict[str, tuple[dict[bytes, int], array]] = {}

    def out(lang: str) -> pa.RecordBatch:
        own, stream = held.pop(lang)
        ids = np.frombuffer(stream, np.int32)
        times = np.bincount(ids, minlength=len(own) + 1)[1:].astype(np.int64)
        lists = [pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), x) for x in (pa.array(list(own), pa.binary()), pa.array(times))]
        return pa.RecordBatch.from_arrays([pa.array([next(made)], pa.int64()), pa.array([lang]), *lists, pa.array([int(times.sum())], pa.int64()), pa.array([squeezed(ids)], pa.binary())], ["slice", "lang", "keys", "times", "n", "stream"])

    total = 0
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        for k, lang in enumerate(batch.column("lang").to_pylist()):
            if lang not in held:
                held[lang] = (defaultdict(count(1).__next__), array("i"))
            own, stream = held[lang]
            before = len(stream)
            for piece in data[offsets[k] : offsets[k + 1]].tobytes().translate(table).split(b"\n"):
                stream.extend(map(own.__getitem__, piece.split()))
                stream.append(0)
            total += len(stream) - before
            full = lang if len(stream) >= most else max(held, key=lambda x: len(held[x][1])) if total >= 4 * most else None
            if full is not None:
                total -= len(held[full][1])
                yield out(full)
    for lang in list(held):
        yield out(lang)


def paired(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where two ids follow each other, and the pair's code."""
    at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    return at, ids[at] << 32 | ids[at + 1]


def tile_counts(codes: np.ndarray, bits: int = TILE_BITS, crowded: int = CROWDED) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes of pairs and their counts: tiles with enough occurrences by direct addresses, all others as sorted coordinates."""
    side, corner = 1 << bits, _TILES << bits
    first, second = codes >> 32, codes & 0xFFFFFFFF
    near = np.flatnonzero((first < corner) & (second < corner))
    tile = (first[near] >> bits) * _TILES + (second[near] >> bits)
    sparse, found = np.ones(len(codes), bool), []
    for t in np.flatnonzero(np.bincount(tile, minlength=_TILES * _TILES) * crowded >= side * side).tolist():
        mine = near[tile == t]
        sparse[mine] = False
        cells = np.bincount((first[mine] & side - 1) << bits | second[mine] & side - 1, minlength=side * side)
        filled = np.flatnonzero(cells)
        found.append((((t // _TILES << bits) + (filled >> bits)) << 32 | (t % _TILES << bits) + (filled & side - 1), cells[filled]))
    found.append(np.unique(codes[sparse], return_counts=True))
    return np.concatenate([x for x, _ in found]), np.concatenate([n for _, n in found])


def _places(words: np.ndarray, size: int) -> list[np.ndarray]:
    """Two places in a filter of each row of word ids."""
    h = np.zeros(len(words), np.uint64)
    for column in words.T:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64), 51)
    return [(mix(h, seed) >> np.uint64(64 - size)).astype(np.int64) for seed in (52, 53)]


def _passing(words: np.ndarray, bits: np.ndarray, size: int) -> np.ndarray:
    keep = np.ones(len(words), bool)
    for place in _places(words, size):
        keep &= (bits[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
    return keep


def _filter(frequent: DataFrame, words: int, size: int) -> np.ndarray:
    """Bits of all frequent phrases (key: their word ids), 2^size of them: gathered as words of 64 bits, so never more than a fixed number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column("key").to_pylist()), ">u4").reshape(-1, words)
            place = np.concatenate(_places(ids, size))
            yield pa.RecordBatch.from_arrays([pa.array(place >> 6), pa.array((np.uint64(1) << (place & 63).astype(np.uint64)).view(np.int64))], ["word", "bits"])

    found = frequent.select("key").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << size - 6, np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def phrase_counts(ids: np.ndarray, filters: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct phrases of len(filters) + 2 words in a stream of word ids, as rows of ids, and their counts; filters: of the frequent phrases of 2, 3, ... words.

    Frequent phrases of k words are ranked by their count here; a phrase of k + 1 is a pair of such a rank and a word.
    """
    at, codes = paired(ids)
    distinct, times = tile_counts(codes)
    words = np.stack([distinct >> 32, distinct & 0xFFFFFFFF], axis=1)
    for k, bits in enumerate(filters, 2):
        order = np.argsort(distinct)
        keep = _passing(words, bits, size)
        rank = np.zeros(len(distinct), np.int64)
        by = np.flatnonzero(keep)
        by = by[np.lexsort((distinct[by], -times[by]))]
        rank[by] = np.arange(1, len(by) + 1)
        here = np.zeros(len(ids) + 1, np.int64)
        here[at] = rank[order[np.searchsorted(distinct, codes, sorter=order)]] if len(distinct) else 0
        at = np.flatnonzero((here[:-1] > 0) & (here[1:] > 0))  # both the first and the last k words are frequent
        codes = here[at] << 32 | ids[at + k]
        known = words[by]
        distinct, times = tile_counts(codes)
        words = np.concatenate([known[(distinct >> 32) - 1], (distinct & 0xFFFFFFFF)[:, None]], axis=1)
    return words, times


def _counted(filters: list[np.ndarray], size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held in batch.column("stream"):
                words, times = phrase_counts(expanded(held.as_py()), filters, size)
                if filters:
                    width = 4 * words.shape[1]
                    key = pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer((np.arange(len(words) + 1) * width).astype(np.int32)), pa.py_buffer(words.astype(">u4").tobytes())])
                else:  # as one number
                    key = pa.array(words[:, 0] << 32 | words[:, 1])
                yield pa.RecordBatch.from_arrays([key, pa.array(times.astype(np.int64))], ["code", "n"])

    return run


def _stream(slices: pa.Table, ids: np.ndarray) -> pa.Table:
    return pa.table({"slice": slices.column("slice"), "stream": pa.array([squeezed(ids)], pa.binary())})


def _as_words(slices: pa.Table, found: pa.Table) -> pa.Table:
    """A slice whose words are their ids, 0 for infrequent ones."""
    local = expanded(slices.column("stream")[0].as_py())
    ids = np.zeros(int(local.max(initial=0)) + 1, np.int64)
    ids[found.column("place").to_numpy() + 1] = found.column("id").to_numpy()
    return _stream(slices, ids[local])


def _met(slices: DataFrame, found: DataFrame, run) -> DataFrame:
    """Each slice (bounded) with what was found for it. A slice without a frequent word goes."""

    def both(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        return run(mine, theirs) if mine.num_rows and theirs.num_rows else pa.table({"slice": pa.array([], pa.int64()), "stream": pa.array([], pa.binary())})

    return slices.select("slice", "stream").groupBy("slice").cogroup(found.withColumnRenamed("slice", "of").groupBy("of")).applyInArrow(both, "slice long, stream binary")


def _named(counts: DataFrame, least: int, keys: list[str], name: str) -> DataFrame:
    """Those that occur often enough, with id: their rank by falling count."""
    often = counts.where(F.col("n") >= least).withColumn("order", -F.col("n"))
    return written(ranked(often, ["order", *keys])[0].withColumnRenamed("rank", "id").drop("order"), name)


def _score(l: Column, r: Column) -> Column:
    wide = lambda c, n: c.cast(f"decimal({n},0)")
    parts = F.struct((wide(F.lit(1_000_000), 7) * wide(F.col("a"), 15) * wide(F.col("a"), 15)).alias("x"), (wide(l, 18) * wide(r, 18)).alias("y"))
    return F.call_function("div", parts.x, parts.y)


def phrases(docs: DataFrame, longest: int = 3, least: int = 10, slice_words: int = SLICE_WORDS, filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """All phrases of up to `longest` words with their counts: lang, size, phrase, a, heads and tails (counts of their first and of their last
    1, 2, ... words), wrapped (the largest count of a phrase of one word more that holds it, null for none); and the languages' word counts: lang, n."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    cut = written(texts.mapInArrow(_slices(slice_words), "slice long, lang string, keys array<binary>, times array<long>, n long, stream binary"), "phrases_words")
    totals = cut.groupBy("lang").agg(F.sum("n").alias("n"))
    each = cut.select("lang", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("lang", F.col("x.keys").alias("key"), F.col("x.times").alias("times"))
    words = _named(each.groupBy("lang", "key").agg(F.sum("times").alias("n")), least, ["lang", "key"], "phrases_1")
    asked = cut.select("slice", "lang", F.posexplode("keys").alias("place", "key")).join(words.select("lang", "key", "id").hint("merge"), ["lang", "key"]).select("slice", F.col("place").cast("long").alias("place"), "id")
    streams = written(_met(cut, asked, _as_words), "phrases_streams")
    text, as_key = F.col("key").cast("string"), lambda number, digits: F.unhex(F.lpad(F.hex(number), digits, "0"))
    level = words.select(as_key("id", 8).alias("key"), "lang", text.alias("phrase"), text.alias("last"), F.col("n").alias("a"), F.array("n").alias("heads"), F.array("n").alias("tails"))
    levels, filters = [], []
    for size in range(2, longest + 1):
        kind = "binary" if filters else "long"
        counts = streams.mapInArrow(_counted(list(filters), filter_bits), f"code {kind}, n long").groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        found = written(counts.select((F.col("code") if filters else as_key("code", 16)).alias("key"), F.col("n").alias("a")), f"phrases_{size}")
        front, back = F.substring("key", 1, 4 * size - 4), F.substring("key", 5, 4 * size - 4)
        held = found.select(F.explode(F.array(front, back)).alias("key"), "a").groupBy("key").agg(F.max("a").alias("wrapped"))
        levels.append(level.join(held, "key", "left").withColumn("size", F.lit(size - 1)))
        first = level.select(F.col("key").alias("front"), "lang", F.col("phrase").alias("before"), F.col("heads").alias("front_heads"))
        second = level.select(F.col("key").alias("back"), "last", F.col("tails").alias("back_tails"))
        level = found.withColumns({"front": front, "back": back}).join(first, "front").join(second, "back")
        level = level.select("key", "lang", F.concat_ws(" ", "before", "last").alias("phrase"), "last", "a", F.concat("front_heads", F.array("a")).alias("heads"), F.concat("back_tails", F.array("a")).alias("tails"))
        level = written(level, f"phrases_of_{size}")
        if size < longest:
            filters.append(_filter(found, size, filter_bits))
    levels.append(level.withColumns({"wrapped": F.lit(None).cast("long"), "size": F.lit(longest)}))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out.drop("last", "key"), totals


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, wrapped: int = 50, top: int = 2000) -> DataFrame:
    """docs: lang, text (others ignored). Returns of each language (null: und) the `top` phrases of 2 to `longest` words by score: lang, rank, phrase,
    a, l, r, n, score.

    A phrase occurs `least` times or more, within pieces of text; cut in two it scores floor(10^6 a^2 / (l r)), the cut with the least score
    counts, the earliest on ties (decimals, exact for counts below 10^15). It is left out if a longer phrase that holds it has `wrapped` percent of its
    count; it is enough to look at one word more, as what is longer still is rarer. Ties in the ranking: higher count, then the phrase in byte
    order. Null and empty texts hold no words, a language without words or phrases no rows. Repeated rows count as often as they occur. A very
    long text is part of one slice, which it fills alone if need be. No rows: no rows.
    """
    found, totals = phrases(docs, longest, least)
    kept = found.where(F.col("size") >= 2).where(F.col("wrapped").isNull() | (100 * F.col("wrapped") < wrapped * F.col("a")))
    cuts = []
    for k in range(1, longest):  # after the first k words
        l, r = F.get("heads", F.lit(k - 1)), F.get("tails", F.col("size") - k - 1)
        cuts.append(F.when(F.col("size") > k, F.struct(_score(l, r).alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r"))))
    best = kept.withColumn("cut", F.array_min(F.array_compact(F.array(*cuts)))).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranks = best.withColumn("rank", place.cast("long")).where(F.col("rank") <= top)
    return ranks.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
