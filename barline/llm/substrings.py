"""Removal of word passages that repeat anywhere in a corpus, by difference-cover anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.llm._spark import written
from barline.llm._text import Words, mix, sliced_words, slices, text_bytes

#: Perfect difference covers by period. Any two residues have a shift that brings both into the cover.
COVERS = {3: (1, 2), 7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14)}

#: A hash that a row of texts has. Rows meet by h and part. Part is 0 for an anchor, FAR or more (with a second hash of the text) for a whole
#: text; between them, and below 0, it marks rows that are known to repeat: they need no meeting, and their parts spread them over all tasks.
#: For windows part holds a second hash whose low bits are 0, or any others for a row that is known to repeat.
_ROWS = "h long, part long, key long"
FAR, LOW = 1 << 62, (1 << 16) - 1


def _period(window: int) -> int:
    fit = [p for p in COVERS if p <= window - 4]
    if not fit:
        raise ValueError("a window has seven words or more")
    return max(p for p in fit if p <= max(min(fit), 0.6 * window))


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of so many members: each member's group and its place in it."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)


def _met(h: np.ndarray, part: np.ndarray, key: np.ndarray, known) -> pa.RecordBatch:
    """Rows of a slice's hashes, once for each key. Of equal ones the first key's goes to the meeting for all; if there are several, each is also
    known to repeat, under the part that known(part, key, first) gives it.
    """
    order = np.lexsort((key, part, h))
    h, part, key = h[order], part[order], key[order]
    lead, own = np.ones(len(h), bool), np.ones(len(h), bool)
    lead[1:] = (h[1:] != h[:-1]) | (part[1:] != part[:-1])
    own[1:] = lead[1:] | (key[1:] != key[:-1])
    size = np.diff(np.append(np.flatnonzero(lead), len(h)))
    several = np.repeat(size > 1, size) & own
    parts = np.concatenate([part[lead], known(part[several], key[several], lead[several])])
    columns = (np.concatenate([h[lead], h[several]]).view(np.int64), parts, np.concatenate([key[lead], key[several]]))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "part", "key"])


def _spread_of(key: np.ndarray, size: int) -> np.ndarray:
    return (mix(key.astype(np.uint64), 5) % np.uint64(size)).astype(np.int64)


def _known_anchor(part: np.ndarray, key: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of a whole text an odd number below 0 for the first in the slice, an even one for another."""
    s = _spread_of(key, 1 << 24)
    return np.where(part < FAR, 1 + s, np.where(first, -1, -2) - 2 * s)


def _known_window(part: np.ndarray, key: np.ndarray, first: np.ndarray) -> np.ndarray:
    return part | (1 + _spread_of(key, LOW))


def _covered(window: int, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sequences of n words: sequence and place of each anchor."""
    period = _period(window)
    cover = np.zeros(period, bool)
    cover[list(COVERS[period])] = True
    group, place = _spread(np.maximum(n - (window - period), 0))
    chosen = cover[place % period]
    return group[chosen], place[chosen]


def _hashes(column: pa.Array, row: int) -> np.ndarray:
    held = column[row].values
    return (np.zeros(0, np.int64) if held is None else held.to_numpy(zero_copy_only=False)).view(np.uint64)


def _wholes(w: Words) -> np.ndarray:
    """The hash of each text's whole word sequence; 0 without words."""
    n = np.diff(w.first)
    out = np.zeros(len(n), np.uint64)
    out[n > 0] = w.sequences(np.flatnonzero(n > 0))
    return out


def _anchors(window: int):
    """Each text's distinct anchor hashes and its whole word sequence.

    Equal sequences in one slice send their anchors once, under the smallest key.
    """
    length = window - _period(window) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            for a, b, w in sliced_words(batch.column("text")):
                n = np.diff(w.first)
                long = np.flatnonzero(n >= window)
                whole, more, own = w.sequences(long), (w.sequences(long, 1) >> np.uint64(2)).astype(np.int64) + FAR, keys[a:b][long]
                order = np.lexsort((own, more, whole))
                lead = np.ones(len(order), bool)
                lead[1:] = (whole[order][1:] != whole[order][:-1]) | (more[order][1:] != more[order][:-1])
                keep = np.sort(order[lead])
                group, place = _covered(window, n[long][keep])
                h = w.windows(w.first[long[keep]][group] + place, length)
                yield _met(np.concatenate([h, whole]), np.concatenate([np.zeros(len(h), np.int64), more]), np.concatenate([own[keep][group], own]), _known_anchor)

    return run


def _extended(window: int):
    """Each text's distinct windows around the anchors that are known to repeat."""
    back = _period(window) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            work = np.flatnonzero(pa.compute.fill_null(pa.compute.list_value_length(batch.column("anchors")), 0).to_numpy(zero_copy_only=False) > 0)
            if not len(work):
                continue
            part = batch.take(pa.array(work))
            known, others, keys = part.column("anchors"), part.column("others"), part.column("key").to_numpy(zero_copy_only=False)
            for a, b, w in sliced_words(part.column("text")):
                n, at, own, whole = np.diff(w.first), [], [], _wholes(w)
                group, place = _covered(window, n)
                h = w.windows(w.first[group] + place, window - back)
                edges = np.searchsorted(group, np.arange(b - a + 1))
                for k in np.flatnonzero(n >= window).tolist():
                    if whole[k] in _hashes(others, a + k):
                        continue
                    p = place[edges[k] : edges[k + 1]][np.isin(h[edges[k] : edges[k + 1]], _hashes(known, a + k))]
                    last = n[k] - window
                    edge = np.zeros(last + 2, np.int32)
                    p = p[p - back <= last]
                    np.add.at(edge, np.maximum(p - back, 0), 1)
                    np.add.at(edge, np.minimum(p, last) + 1, -1)
                    starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                    at.append(w.first[k] + starts)
                    own.append(np.full(len(starts), keys[a + k]))
                if at:
                    begin = np.concatenate(at)
                    yield _met(w.windows(begin, window), w.windows(begin, window, 1).view(np.int64) & ~LOW, np.concatenate(own), _known_window)

    return run


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            held, known, equal = data.tobytes(), batch.column("windows"), batch.column("equal")
            some = pa.compute.or_(pa.compute.fill_null(pa.compute.list_value_length(equal), 0).cast(pa.bool_()), known.is_valid()).to_numpy(zero_copy_only=False)
            words, removed, texts = [], [], []
            for a, b in slices(offsets):
                w = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) if some[a:b].any() else None
                whole = _wholes(w) if w else None
                for k in range(a, b):
                    own = held[offsets[k] : offsets[k + 1]].split()
                    n, gone = len(own), 0
                    if some[k] and n >= window:
                        first = w.first[k - a]
                        if whole[k - a] in _hashes(equal, k):
                            own, gone = [], n
                        else:
                            s = np.flatnonzero(np.isin(w.windows(np.arange(first, first + n - window + 1), window), _hashes(known, k)))
                            edge = np.zeros(n + 1, np.int32)
                            np.add.at(edge, s, 1)
                            np.add.at(edge, s + window, -1)
                            stays = np.cumsum(edge[:-1]) == 0
                            gone = int(n - stays.sum())
                            own = [x for x, y in zip(own, stays.tolist(), strict=True) if y]
                    words.append(n)
                    removed.append(gone)
                    texts.append(b" ".join(own))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def _neighbours(rows: DataFrame) -> DataFrame:
    """rows with the keys beside them that have the same hash and part."""
    order = Window.partitionBy("h", "part").orderBy("key")
    return rows.select("*", F.lag("key").over(order).alias("before"), F.lead("key").over(order).alias("after"))


def drop_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """Texts without the words that lie in a repeated window of words.

    docs: doc_id, text; other columns are ignored, whatever their names. Returns doc_id, n_words, n_removed, kept (the words
    that stay, joined by one space), a row for each row. A window of `window` words is repeated if the same words also start
    anywhere else in the corpus, in the same document too.

    Any two places of a repeated window have a common shift at which both lie on the difference cover, so every repeat shares an
    anchor hash (window - period + 1 words) there. Anchors that occur once go; around the others all windows are met in turn, by
    two independent hashes of 112 bits. Both meetings look at neighbours in sorted order and hold no group; what repeats within one
    slice of texts is settled there and sends one row for all, so that a passage of very many texts doesn't gather in one task. Texts of equal words
    are met in the first one too, by two independent hashes of the whole: one of them stands for all, as all their windows repeat.

    Null or empty text: no words. A null doc_id is a row like any other. Equal rows are copies of each other. Rows of one doc_id
    with different texts are each judged by their own words. Very long texts: hashed alone, one at a time. No rows: no rows.
    """
    docs = docs.select("doc_id", "text", F.coalesce("doc_id", F.xxhash64("text")).alias("key"))
    found = _neighbours(docs.mapInArrow(_anchors(window), _ROWS))
    part, met = F.col("part"), F.col("before").isNotNull() | F.col("after").isNotNull()
    anchor, whole = part.between(0, FAR - 1), part >= FAR
    equal = whole | (part < 0)
    # another than the first of equal texts
    other = F.when(whole, F.col("before").isNotNull()).otherwise((part < 0) & (part % 2 == 0))
    of = lambda kind: F.collect_list(F.when(kind, F.col("h")))
    places = found.where(met | ((part != 0) & ~whole)).groupBy("key").agg(of(anchor).alias("anchors"), of(equal).alias("equal"), of(other).alias("others"), of(whole & F.col("before").isNull()).alias("firsts"))
    places = written(places.select("key", "anchors", "equal", F.array_except("others", "firsts").alias("others")), "anchors")
    # the same columns of docs as below, so that both joins share one exchange of the texts
    extended = _neighbours(docs.join(places.drop("equal"), "key", "left").select("doc_id", "key", "text", "anchors", "others").mapInArrow(_extended(window), _ROWS))
    repeated = extended.where(met | (part.bitwiseAND(LOW) != 0)).groupBy("key").agg(F.collect_list("h").alias("windows"))
    every = docs.join(places.select("key", "equal"), "key", "left").join(repeated, "key", "left")
    return every.select("doc_id", "text", "equal", "windows").mapInArrow(_kept(window), "doc_id long, n_words long, n_removed long, kept string")
