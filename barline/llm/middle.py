"""Fill-in-middle transformation, with both cuts looked up in indexable skip lists.

A text's tokens (a word with the white space before it, or white space that ends the text) are the bottom lane of a skip list. Every
second token on average, chosen by a hash of its place, is also in the lane above, and so on; each link carries how many tokens and how many code
points it spans. A cut rank is reached from the top lane down: a lane is followed as long as the tokens passed don't exceed the rank,
and the code points passed add up on the way, so that a text is cut exactly where its tokens end. The lanes of all texts of a slice
are built and descended together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm._text import Words, mix, slices, text_bytes

#: The marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


class SkipLists:
    """The skip lists of some texts: data (UTF-8) and where each text begins, with the end last.

    size[d] is the number of text d's tokens. Each lane holds the head of every text and the tokens that reach it, in order: their `units` and
    `points` are the widths of the links to the next node, `down` their place in the lane below, `first` where a text's nodes begin.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words, docs = Words(data, offsets), len(offsets) - 1
        counts = np.diff(words.first)
        begun = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=begun[1:])  # code points that begin before each byte
        filled = offsets[1:] > offsets[:-1]
        tail = np.zeros(docs, bool)  # white space at the end is a token of its own
        tail[filled] = _BLANK[data[offsets[1:][filled] - 1]]
        self.size = counts + tail
        self.points = begun[offsets[1:]] - begun[offsets[:-1]]
        # nodes: the head of each text at width 0, then its tokens at the widths where they end
        first = np.concatenate([[0], np.cumsum(self.size + 1)])
        rank = np.arange(first[-1]) - np.repeat(first[:-1], self.size + 1)
        place = np.zeros(first[-1], np.int64)
        own = np.repeat(np.arange(docs), counts)
        nth = np.arange(len(words)) - words.first[:-1][own]
        place[first[own] + 1 + nth] = begun[words.ends] - begun[offsets[own]]
        place[first[1:][tail] - 1] = self.points[tail]
        tall = mix(np.arange(first[-1]).astype(np.uint64), 7)  # as many zero bits at its end as the lanes above the first that it reaches
        self.lanes, nodes, level = [], np.arange(first[-1]), 0
        while True:
            owner = np.searchsorted(first, nodes, "right") - 1
            units, points = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
            same = owner[1:] == owner[:-1]
            units[:-1][same], points[:-1][same] = np.diff(rank[nodes])[same], np.diff(place[nodes])[same]
            self.lanes.append({"units": units, "points": points, "first": np.searchsorted(nodes, first[:-1]), "nodes": nodes})
            if len(nodes) == docs:
                break
            level += 1
            nodes = nodes[(rank[nodes] == 0) | (tall[nodes] & np.uint64((1 << level) - 1) == 0)]
        for below, above in zip(self.lanes, self.lanes[1:], strict=False):
            above["down"] = np.searchsorted(below["nodes"], above["nodes"])

    def cut(self, ranks: np.ndarray) -> np.ndarray:
        """For each text the code points of its first ranks[d] tokens."""
        at = self.lanes[-1]["first"].copy()
        units, points = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        for k in range(len(self.lanes) - 1, -1, -1):
            lane = self.lanes[k]
            going = np.arange(len(ranks))
            while len(going):  # those whose next link doesn't pass the rank follow it; a text's last node has no link
                wide = lane["units"][at[going]]
                going = going[(wide > 0) & (units[going] + wide <= ranks[going])]
                units[going] += lane["units"][at[going]]
                points[going] += lane["points"][at[going]]
                at[going] += 1
            if k:
                at = lane["down"][at]
        return points


def _draws(seed: int, doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def _transformed(batch: pa.RecordBatch, rate: int, spm_rate: int, seed: int) -> list[pa.Array]:
    data, offsets = text_bytes(batch.column("text"))
    ids = batch.column("doc_id").to_pylist()
    sizes, forms, prefixes, middles, outputs = [], [], [], [], []
    for a, b in slices(offsets):
        lists = SkipLists(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        draws = np.array([_draws(seed, i) for i in ids[a:b]], np.int64).reshape(-1, 4)
        cuts = np.sort(draws[:, :2] % (lists.size + 1)[:, None], axis=1)
        ends = [lists.cut(cuts[:, k]).tolist() for k in (0, 1)]
        for k in range(b - a):
            text = data[offsets[a + k] : offsets[a + k + 1]].tobytes().decode("utf-8", "replace")
            one, two = ends[0][k], ends[1][k]
            form = "plain"
            if text and draws[k, 2] % 100 < rate and not any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
                form = "spm" if draws[k, 3] % 100 < spm_rate else "psm"
            before, between, after = text[:one], text[one:two], text[two:]
            sizes.append(int(lists.size[k]))
            forms.append(form)
            prefixes.append(None if form == "plain" else one)
            middles.append(None if form == "plain" else two - one)
            outputs.append({"plain": text, "psm": f"{PREFIX}{before}{SUFFIX}{after}{MIDDLE}{between}", "spm": f"{SUFFIX}{after}{PREFIX}{before}{MIDDLE}{between}"}[form])
    return [pa.array(sizes, pa.int64()), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), pa.array(outputs, pa.string())]


def transform(docs: DataFrame, rate: int = 50, spm_rate: int = 80, seed: int = 42) -> DataFrame:
    """docs: doc_id, text (others ignored). Returns doc_id, n (tokens), form (plain, psm, spm), prefix_chars, middle_chars (code points; null if
    plain), output: a row for each row, in one pass without a shuffle.

    rate: of a hundred texts so many are transformed, of those spm_rate in suffix-prefix-middle order, as hashes of seed and doc_id draw. Null text:
    empty; empty texts and those that hold a mark stay plain. Null doc_id: drawn by the empty string. Rows of one doc_id are drawn alike, each
    by its own number of tokens. Equal cuts leave an empty middle. Very long texts are cut whole, alone in a slice. No rows: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _few(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *_transformed(part, rate, spm_rate, seed)], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def _few(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of a few MB of text, or of one row."""
    _, offsets = text_bytes(batch.column("text"))
    for a, b in slices(offsets):
        yield batch.slice(a, b - a)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. No text of these forms holds a mark and no mark can overlap another or a text's end, so each
    is where it first occurs."""
    marks = {m: F.locate(m, output) for m in (PREFIX, SUFFIX, MIDDLE)}
    size = F.lit(len(PREFIX))
    between = lambda a, b: F.substring(output, a + size, b - a - size)
    middle = F.substring(output, marks[MIDDLE] + size, F.char_length(output))
    psm = F.concat(between(marks[PREFIX], marks[SUFFIX]), middle, between(marks[SUFFIX], marks[MIDDLE]))
    spm = F.concat(between(marks[PREFIX], marks[MIDDLE]), middle, between(marks[SUFFIX], marks[PREFIX]))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
