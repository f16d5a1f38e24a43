"""Near-duplicate documents by b-bit MinHash: band candidates, collision-corrected estimates, confirmation on full sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.llm._spark import written
from barline.llm._text import Words, mix, sliced_words
from barline.llm.graph import components


@dataclass(frozen=True)
class Params:
    """At a similarity of 0.75 a pair shares none of 40 bands of 4 minima once in four million."""

    shingle: int = 5
    percent: int = 75
    bands: int = 40
    rows: int = 4
    #: Pairs of a lower estimate are not confirmed; nearly five standard errors below the threshold.
    least_estimate: float = 0.55


#: Low bits of each minimum that are kept, and how many of them a long holds; slots of the parities.
BITS, LANES, PARITIES = 2, 32, 1024
#: A hub's text, or one side of a bucket's comparison, is sent once for each so many members.
BLOCK = 1000
#: Tasks that share the rows of a class of equal sets.
SALTS = 16


def _shingled(w: Words, size: int) -> Iterator[tuple[np.ndarray, int]]:
    """For each document where its shingles begin (word numbers) and their length; no place without words."""
    for first, n in zip(w.first[:-1].tolist(), np.diff(w.first).tolist(), strict=True):
        yield np.arange(first, first + max(n - size + 1, min(n, 1))), min(n, size)


def _shingles(w: Words, size: int) -> list[np.ndarray]:
    """Each document's distinct shingle hashes, ascending."""
    return [np.unique(w.windows(at, n)) if len(at) else np.zeros(0, np.uint64) for at, n in _shingled(w, size)]


def _sketches(p: Params):
    k = p.bands * p.rows
    scale = mix(np.arange(1, k + 1, dtype=np.uint64), 11) | np.uint64(1)
    shift = mix(np.arange(1, k + 1, dtype=np.uint64), 12)
    by_row = (mix(np.arange(1, p.rows + 1, dtype=np.uint64), 13) | np.uint64(1))[:, None]
    by_band = mix(np.arange(1, p.bands + 1, dtype=np.uint64), 14)[:, None, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, w in sliced_words(batch.column("text"), True, 1 << 20):
                sets, other = [], []
                for at, n in _shingled(w, p.shingle):
                    one, where = np.unique(w.windows(at, n), return_index=True) if len(at) else (np.zeros(0, np.uint64), at)
                    sets.append(one)
                    other.append(w.windows(at[where], n, 1) if len(at) else one)
                n = np.array([len(x) for x in sets])
                full = np.flatnonzero(n)
                mins = np.zeros((k, len(full)), np.uint64)
                key = np.zeros((2, b - a), np.uint64)
                if len(full):
                    every = np.concatenate(sets)
                    starts = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                    for j in range(k):
                        mins[j] = np.minimum.reduceat(every * scale[j] + shift[j], starts)
                    for j, lane in enumerate((every, np.concatenate(other))):  # independent hashes of each shingle
                        key[j, full] = np.add.reduceat(mix(lane, 21 + j), starts)
                bands = np.zeros((b - a, p.bands), np.uint64)
                bands[full] = mix((mins.reshape(p.bands, p.rows, len(full)) * by_row + by_band).sum(1), 15).T
                low = (mins & np.uint64(2**BITS - 1)).reshape(k // LANES, LANES, len(full)) << (np.arange(LANES, dtype=np.uint64) * np.uint64(BITS))[:, None]
                bits = np.zeros((b - a, k // LANES), np.uint64)
                bits[full] = np.bitwise_or.reduce(low, 1).T
                lists = [_lists(x) for x in (bands, bits)]
                yield pa.RecordBatch.from_arrays([ids[a:b], pa.array(n, pa.int64()), *(pa.array(x.view(np.int64)) for x in key), *lists], ["doc_id", "n", "k1", "k2", "bands", "bits"])

    return run


def _lists(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).reshape(-1).view(np.int64)), x.shape[1]).cast(pa.list_(pa.int64()))


def _confirmed(p: Params):
    """Pairs whose full shingle sets are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for first in range(0, len(batch), 256):  # two sets of so many texts are held at once
                part = batch.slice(first, 256)
                left, right = ([s for _, _, w in sliced_words(part.column(c), True) for s in _shingles(w, p.shingle)] for c in ("ta", "tb"))
                for j, (x, y) in enumerate(zip(left, right, strict=True)):
                    both = len(np.intersect1d(x, y, True))
                    keep[first + j] = both > 0 and 100 * both >= p.percent * (len(x) + len(y) - both)
            kept = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], ["a", "b"])

    return run


def _parities(p: Params):
    """For each document its set's size and, for PARITIES slots that shingles hash to, whether a slot holds an odd number of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in sliced_words(batch.column("text"), True, 1 << 20):
                sets = _shingles(w, p.shingle)
                for first in range(0, len(sets), 1024):
                    part = sets[first : first + 1024]
                    n = np.array([len(x) for x in part])
                    slot = (np.concatenate(part) >> np.uint64(64 - PARITIES.bit_length() + 1)).astype(np.int64)
                    odd = np.bincount(np.repeat(np.arange(len(part)), n) * PARITIES + slot, minlength=len(part) * PARITIES) & 1
                    packed = np.packbits(odd.astype(np.uint8)).view(np.uint64).reshape(len(part), PARITIES // 64)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a + first : a + first + len(part)], pa.array(n, pa.int64()), _lists(packed)], ["id", "n", "odd"])

    return run


def estimate(x: list[Column], y: list[Column]) -> Column:
    """Similarity from packed low bits: equal lanes by bit counts, less the share that agrees by chance."""
    lanes = F.lit(0)
    for u, v in zip(x, y, strict=True):
        d = u.bitwiseXOR(v)
        lanes = lanes + F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    chance = 2.0**-BITS
    return ((1 - lanes / (len(x) * LANES)) - chance) / (1 - chance)


def apart(x: list[Column], y: list[Column]) -> Column:
    """Slots of unlike parity: two sets differ in as many shingles at least."""
    slots = F.lit(0)
    for u, v in zip(x, y, strict=True):
        slots = slots + F.bit_count(u.bitwiseXOR(v))
    return slots


def near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """docs: doc_id, text (others ignored). Returns for each row doc_id, n_shingles, component_id, kept.

    Words are runs outside ASCII blanks, A-Z lower-cased; a document's set holds its distinct shingles of five words, or its whole
    sequence if it has fewer. Two documents are linked if intersection / union is 0.75 at least; component_id is the smallest
    doc_id reachable.

    Documents of equal sets are one class with one representative. Representatives meet in bands of minima. First each member of a
    bucket is confirmed against the bucket's most central member, a link for each document; where a bucket still spans components,
    the same is done once more with the most central one of those outside its largest component. In the buckets that are left, members outside
    the largest component are compared in blocks with those of other components, on packed signatures: a pair leaves the
    comparison only if its corrected estimate, its sizes and the parities of its shingles (an exact bound) allow a link, in the first band that
    it shares. So pairs that can't be links are never made, and pairs inside a component neither. Each link is confirmed on full sets.

    Null or empty text, or no words: n_shingles 0 and no link. Null doc_id: no link, component_id null, kept. doc_id identifies a
    document; repeated rows get the same result, rows of one doc_id with different texts share one (of one of the texts; for such
    tables see distinct_documents). Very long texts: hashed alone. No rows: no rows.
    """
    docs = docs.select("doc_id", "text")
    sketch = written(docs.mapInArrow(_sketches(p), "doc_id long, n long, k1 long, k2 long, bands array<long>, bits array<long>"), "sketches")
    keys = ["k1", "k2", "n"]
    some = sketch.where("n > 0 and doc_id is not null").groupBy(keys).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = written(some, "classes")
    lead = sketch.where("n > 0").join(classes.select(*keys, F.col("rep").alias("doc_id")), [*keys, "doc_id"], "left_semi").dropDuplicates(["doc_id"])
    banded = lead.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    multi = written(banded.join(shared, "key"), "buckets")
    involved = multi.select(F.col("id").alias("doc_id")).distinct()
    texts = written(docs.join(involved, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "candidates")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """pairs: a, b. A text that many pairs name as a is sent once for each BLOCK of them."""
        pairs = written(pairs, "pairs")
        many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")).where("parts > 1")
        parts = F.coalesce("parts", F.lit(1))
        dealt = pairs.join(many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"))
        left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")).join(many, "a", "left")
        left = left.select("a", "ta", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
        return written(dealt.join(left, ["a", "part"]).join(right, "b").select("a", "b", "ta", "tb").mapInArrow(_confirmed(p), "a long, b long"), "links")

    # the most central member of a bucket is the one that meets most others over all bands
    central = written(multi.groupBy("id").agg(F.sum("size").alias("met")), "central")
    order = lambda x: F.struct("met", (-F.col(x)).alias("low"))

    def starred(members: DataFrame) -> DataFrame:
        """members: key, id, out (may be its centre's spoke), centre (may be a centre). A pair for each id at most: its most frequent centre."""
        hubs = members.where("centre").join(central, "id").groupBy("key").agg(F.max(order("id")).alias("top")).select("key", (-F.col("top.low")).alias("hub"))
        spokes = members.where("out").join(hubs, "key").where("id <> hub").groupBy("id", "hub").agg(F.count(F.lit(1)).alias("met"))
        best = spokes.groupBy("id").agg(F.max_by("hub", order("hub")).alias("hub"))
        return confirmed(best.select(F.col("hub").alias("a"), F.col("id").alias("b")))

    def spanning(links: DataFrame) -> DataFrame:
        """Bucket rows of the buckets that hold several components: key, id, size, comp, main (the component with most members)."""
        placed = multi.join(components(links), "id", "left").select("key", "id", "size", F.coalesce("comp", "id").alias("comp"))
        parts = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("members"))
        spans = parts.groupBy("key").agg(F.max(F.struct("members", "comp")).alias("main"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.col("main.comp").alias("main"))
        return written(placed.join(spans, "key"), "spanning")

    links = starred(multi.select("key", "id", F.lit(True).alias("out"), F.lit(True).alias("centre")))
    outside = (F.col("comp") != F.col("main")).alias("out")
    links = links.union(starred(spanning(links).select("key", "id", outside, outside.alias("centre"))))
    inside = spanning(links)
    ids = inside.select("id").distinct()
    odd = texts.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").mapInArrow(_parities(p), "id long, n long, odd array<long>")
    packed = sketch.select(F.col("doc_id").alias("id"), "bits", "bands").join(ids, "id", "left_semi").dropDuplicates(["id"])
    # single columns of longs keep the comparison in one small compiled method
    lanes, slots = [f"bits{i}" for i in range(p.bands * p.rows // LANES)], [f"odd{i}" for i in range(PARITIES // 64)]
    flat = [F.coalesce(F.get(c, F.lit(i)), F.lit(0)).alias(f"{c}{i}") for c, names in (("bits", lanes), ("odd", slots)) for i in range(len(names))]
    sized = inside.join(odd, "id").join(packed, "id").select("key", "id", "size", "comp", "main", "n", "bands", *flat)
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    few = sized.where("comp <> main").withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    other = sized.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    few, other = (x.select("key", "block", *(F.col(c).alias(f"{c}_{side}") for c in ("id", "comp", "main", "n", "bands", *lanes, *slots))) for x, side in ((few, "x"), (other, "y")))
    pair = lambda names: [[F.col(f"{c}_{side}") for c in names] for side in "xy"]
    # pairs outside the main component meet from both sides
    able = (F.col("comp_x") != F.col("comp_y")) & ((F.col("comp_y") == F.col("main_y")) | (F.col("id_x") < F.col("id_y")))
    both, off = F.col("n_x") + F.col("n_y"), apart(*pair(slots))
    able = able & (100 * (both - off) >= p.percent * (both + off)) & (estimate(*pair(lanes)) >= p.least_estimate)
    once = F.get(F.array_intersect("bands_x", "bands_y"), F.lit(0)) == F.col("key")
    rated = few.join(other, ["key", "block"]).where(able & once)
    links = links.union(confirmed(rated.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b"))))
    label = components(links).toDF("rep", "comp")
    # copies of a class are dealt to several tasks
    alike = classes.where("copies > 1").join(label, "rep", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    alike = alike.select(*keys, "salt", F.coalesce("comp", "rep").alias("of"))
    every = sketch.select("doc_id", *keys, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")).join(alike, [*keys, "salt"], "left")
    every = every.join(label.withColumnRenamed("rep", "doc_id"), "doc_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("of", "comp", "doc_id"))
    return every.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def distinct_documents(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """docs: doc_id, text, others. Returns the rows of docs, with all its columns, that stay: one of each group of near duplicates, the
    one with the smallest doc_id.

    Rows are told apart also where their doc_id is null or occurs again: such a row is a document of its own behind all that have an own
    doc_id, so that only a row that is a near copy of another row goes. Repeated rows are copies: one stays. Null or empty
    texts are copies of nothing and all stay. Very long texts and ties: see near_duplicates. No rows: no rows.
    """
    spare = next(f"row{k}" for k in range(len(docs.columns) + 1) if f"row{k}" not in {c.lower() for c in docs.columns})
    again = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id")
    beyond = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0)).cast("long").alias("top"))
    odd = docs.join(again, docs["doc_id"].eqNullSafe(again["doc_id"]), "left_semi")
    odd = written(odd.withColumn(spare, F.monotonically_increasing_id()), "odd")
    plain = docs.join(again, docs["doc_id"].eqNullSafe(again["doc_id"]), "left_anti")
    first = beyond.first().top + 1
    named = plain.select("doc_id", "text").union(odd.select((F.col(spare) + first).alias("doc_id"), "text"))
    gone = written(near_duplicates(named, p).where("not kept").select("doc_id"), "gone")
    stays = plain.join(gone, "doc_id", "left_anti")
    other = odd.join(gone.select((F.col("doc_id") - first).alias(spare)), spare, "left_anti")
    return stays.select(docs.columns).union(other.select(docs.columns))
