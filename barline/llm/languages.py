"""Language identification: script ranges narrow the candidates, per-word scores come from hashed letter trigrams, and Viterbi
with a penalty for each switch labels the spans of a text.
"""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.llm._spark import extended
from barline.llm._text import slices, text_bytes

#: Code points of scripts, first and last; what lies in none is of the script 0.
SCRIPTS = [
    ("latin", [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)]),
    ("greek", [(0x370, 0x3FF), (0x1F00, 0x1FFF)]),
    ("cyrillic", [(0x400, 0x52F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)]),
    ("armenian", [(0x530, 0x58F)]),
    ("hebrew", [(0x590, 0x5FF), (0xFB1D, 0xFB4F)]),
    ("arabic", [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)]),
    ("devanagari", [(0x900, 0x97F)]),
    ("bengali", [(0x980, 0x9FF)]),
    ("tamil", [(0xB80, 0xBFF)]),
    ("thai", [(0xE00, 0xE7F)]),
    ("georgian", [(0x10A0, 0x10FF)]),
    ("kana", [(0x3040, 0x30FF), (0x31F0, 0x31FF)]),
    ("han", [(0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FFFF)]),
    ("hangul", [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)]),
]
POINTS = 0x110000
BUCKETS = 1 << 16


@dataclass(frozen=True)
class Params:
    #: Labelled documents of each language that the model is trained on, about, chosen by hash.
    sample: int = 4_000
    #: Cost of a switch of language, in nats.
    switch: float = 12.0
    #: Share of a language's letters from which a script counts as one of its own.
    script_share: float = 0.001
    #: Most frequent trigram buckets that the model keeps of each language.
    grams: int = 16_384


@functools.cache
def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: 1 for a letter, 2 for a mark, else 0; lower case; script of a letter."""
    kind, lower, script = np.zeros(POINTS, np.uint8), np.arange(POINTS, dtype=np.uint32), np.zeros(POINTS, np.uint8)
    for c in range(POINTS):
        name = unicodedata.category(chr(c))
        if name[0] in "LM":
            kind[c] = 1 if name[0] == "L" else 2
            if name == "Lu" and len(low := chr(c).lower()) == 1:
                lower[c] = ord(low)
    for i, (_, ranges) in enumerate(SCRIPTS):
        for a, b in ranges:
            script[a : b + 1] = i + 1
    return kind, lower, np.where(kind == 1, script, 0).astype(np.uint8)


class _Letters:
    """Words (runs of letters and marks with a letter in them) of some documents, and the trigram bucket of each character of a word
    with its neighbours.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        kind, lower, script = _classes()
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        self.at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        n = len(points)
        held = kind[points]
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = held > 0
        cut = np.zeros(n + 1, bool)
        cut[self.at] = True
        starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
        ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
        letters = np.concatenate([[0], np.cumsum(held == 1)])
        worded = letters[ends] > letters[starts]
        edge = np.zeros(n + 1, np.int8)
        edge[starts[~worded]] = 1
        edge[ends[~worded]] -= 1
        inside[1:-1] &= np.cumsum(edge[:-1]) == 0  # marks alone are no words
        self.starts, self.ends = starts[worded], ends[worded]
        self.letters = letters[self.ends] - letters[self.starts]
        self.first = np.searchsorted(self.starts, self.at)
        low = np.zeros(n + 2, np.uint32)
        low[1:-1] = np.where(inside[1:-1], lower[points], 0)
        before, after = np.where(cut[:-1], 0, low[:-2]), np.where(cut[1:], 0, low[2:])
        h = before * np.uint32(0x9E3779B1) + low[1:-1] * np.uint32(0x85EBCA77) + after * np.uint32(0xC2B2AE3D)
        self.bucket = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
        self.inside = inside[1:-1]
        #: Script of each character of a word; marks and characters outside words have none of their own.
        self.script, self.letter = script[points], self.inside & (held == 1)


@dataclass
class Model:
    """Of each language at most Params.grams trigram buckets, so that its size is bounded by the labels."""

    languages: list[str]
    #: Log probabilities of the trigrams that a language has, sorted by bucket: where each bucket begins (the end last), language, value.
    first: np.ndarray
    language: np.ndarray
    value: np.ndarray
    #: By language, the log probability of a bucket that it lacks; by script what is added to a language for a letter of it.
    rest: np.ndarray
    scripts: np.ndarray

    def table(self, buckets: np.ndarray) -> np.ndarray:
        """Log probabilities of these buckets, by bucket and language."""
        out = np.repeat(self.rest[None], len(buckets), 0)
        n = self.first[buckets + 1] - self.first[buckets]
        row = np.repeat(np.arange(len(buckets)), n)
        at = np.arange(len(row)) + np.repeat(self.first[buckets] - (np.cumsum(n) - n), n)
        out[row, self.language[at]] = self.value[at]
        return out


def train(docs: DataFrame, p: Params = Params()) -> Model:
    """A model from labelled rows (doc_id, text, lang not null). Every label is learned, from about p.sample of its documents; a null doc_id
    is a row like any other.
    """
    counts = sorted(docs.groupBy("lang").count().collect())  # a row for each label
    names, kinds = [x.lang for x in counts], len(SCRIPTS) + 1
    shares = docs.sparkSession.createDataFrame([(x.lang, k, min(1.0, p.sample / x["count"])) for k, x in enumerate(counts)], "lang string, k int, share double")
    chosen = docs.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("k", "text")
    width = BUCKETS + kinds

    def count(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            langs = batch.column("k").to_numpy(zero_copy_only=False).astype(np.int64) * width
            for a, b in slices(offsets, 1 << 18):
                w = _Letters(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                grams = np.repeat(langs[a:b], np.diff(w.at))[w.inside] + w.bucket[w.inside]
                scripts = np.repeat(langs[a:b], np.diff(w.at))[w.letter] + BUCKETS + w.script[w.letter]
                at, n = np.unique(np.concatenate([grams, scripts]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((at // width).astype(np.int32)), pa.array((at % width).astype(np.int32)), pa.array(n.astype(np.int64))], ["k", "gram", "n"])

    grams = chosen.mapInArrow(count, "k int, gram int, n long").groupBy("k", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("k", F.col("gram") >= BUCKETS).orderBy(F.desc("n"), "gram"))
    rows = grams.withColumn("place", place).where(F.col("place") <= p.grams).drop("place").toPandas()  # p.grams and the scripts for each label at most
    k, gram, n = (rows[c].to_numpy() for c in ("k", "gram", "n"))
    letters = np.zeros((kinds, len(names)))
    letters[gram[gram >= BUCKETS] - BUCKETS, k[gram >= BUCKETS]] = n[gram >= BUCKETS]
    k, gram, n = (x[gram < BUCKETS] for x in (k, gram, n))
    total = np.bincount(k, n, len(names)) + 0.05 * BUCKETS
    order = np.lexsort((k, gram))
    own = letters >= p.script_share * np.maximum(letters.sum(0), 1)
    return Model(
        names,
        np.searchsorted(gram[order], np.arange(BUCKETS + 1)),
        k[order].astype(np.int32),
        np.log((n + 0.05) / total[k])[order].astype(np.float32),
        np.log(0.05 / total).astype(np.float32),
        np.where(own | ~own.any(1, keepdims=True), 0.0, -1e4).astype(np.float32),
    )


def _scores(m: Model, w: _Letters) -> np.ndarray:
    """Log likelihood of each word by language, with a large loss for each letter of a script that isn't the language's; summed over
    blocks of letters, so that the table of letters stays small.
    """
    k, n = len(m.languages), len(w.bucket)
    seen = np.zeros(BUCKETS, bool)
    seen[w.bucket] = True
    table, place, narrow = m.table(np.flatnonzero(seen)), np.cumsum(seen) - 1, m.scripts.any(1)
    out, carry, step = np.zeros((len(w.starts), k)), np.zeros((1, k)), max(1, (1 << 21) // k)
    for a in range(0, n, step):
        b = min(a + step, n)
        each = table[place[w.bucket[a:b]]]
        foreign = np.flatnonzero(w.letter[a:b] & narrow[w.script[a:b]])
        each[foreign] += m.scripts[w.script[a:b][foreign]]
        sums = np.concatenate([carry, each])
        np.cumsum(sums, 0, out=sums)
        x, y = np.searchsorted(w.starts, (a, b))
        out[x:y] -= sums[w.starts[x:y] - a]
        x, y = np.searchsorted(w.ends, (a, b), "right")
        out[x:y] += sums[w.ends[x:y] - a]
        carry = sums[-1:]
    return out


def _paths(scores: list[np.ndarray], switch: float) -> list[np.ndarray]:
    """For each document the best language of each word, by Viterbi.

    Staying in the best language is optimal where no stretch of words gains more than one penalty in another language, and no
    beginning and end together do: a part of a path outside the best language has at least as many switches as languages' stretches
    if it borders on that language, and else one less, but begins and ends with the text. The other documents are stepped through
    together.
    """
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(scores)
    hard = []
    for d, s in enumerate(scores):
        if len(s):
            best = int(s.sum(0).argmax())
            gain = np.cumsum(s - s[:, best : best + 1], 0)
            low = np.minimum.accumulate(np.vstack([np.zeros((1, s.shape[1]), gain.dtype), gain[:-1]]), 0)
            ends = gain[-1] - np.vstack([np.zeros((1, s.shape[1]), gain.dtype), gain[:-1]])
            if (gain - low).max() <= switch and gain.max() + ends.max() <= switch:
                out[d] = np.full(len(s), best)
            else:
                hard.append(d)
    hard.sort(key=lambda d: -len(scores[d]))
    if not hard:
        return out
    n = np.array([len(scores[d]) for d in hard])
    k = scores[hard[0]].shape[1]
    total, back = np.zeros((len(hard), k)), []
    flat, begin = np.concatenate([scores[d] for d in hard]), np.cumsum(n) - n
    for t in range(n[0]):
        live = int(np.searchsorted(-n, -t, "left"))  # documents of more than t words
        now = total[:live]
        top = now.argmax(1)
        jump = now[np.arange(live), top] - switch
        stay = now >= jump[:, None]
        back.append(np.where(stay, np.arange(k), top[:, None]).astype(np.int16 if k < 1 << 15 else np.int32) if t else None)
        total[:live] = np.where(stay, now, jump[:, None]) + flat[begin[:live] + t]
    for j, d in enumerate(hard):
        path = np.empty(n[j], np.int64)
        path[-1] = total[j].argmax()
        for t in range(n[j] - 1, 0, -1):
            path[t - 1] = back[t][j, path[t]]
        out[d] = path
    return out


def identify(docs: DataFrame, model: Model, p: Params = Params()) -> DataFrame:
    """docs: text, others. Adds lang_pred, score (0 to 1) and lang_spans (start, end in code points, lang); existing columns of these
    names give way.

    lang_pred is the language with most letters over the labelled words, ties by name; score is the letters' mean of the word's
    posterior where its label is lang_pred, else 0. A letter is a code point of the Unicode categories L; marks belong to the word they
    stand in. Null or empty text, text without letters, or a model without languages: `und`, 0 and no spans. Repeated rows each get
    their result. Very long texts: alone, by blocks of letters. No rows: no rows.
    """
    shared, names = docs.sparkSession.sparkContext.broadcast(model), np.array([*model.languages, "und"], object)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        m = shared.value
        k = len(m.languages)
        data, offsets = text_bytes(batch.column("text"))
        preds, scores, spans = [], [], []
        for a, b in slices(offsets, (1 << 22) // max(k, 16)):
            w = _Letters(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            if k == 0:
                preds += [0] * (b - a)
                scores += [0.0] * (b - a)
                spans += [[]] * (b - a)
                continue
            each = _scores(m, w)
            soft = np.exp(each - each.max(1, keepdims=True)) if len(each) else each
            soft = soft / soft.sum(1, keepdims=True)
            cuts = w.first
            paths = _paths([each[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)], p.switch)
            letters = w.letters
            for d, path in enumerate(paths):
                if not len(path):
                    preds.append(k)
                    scores.append(0.0)
                    spans.append([])
                    continue
                x, y, start = cuts[d], cuts[d + 1], w.at[d]
                size = letters[x:y]
                best = int(np.bincount(path, size, k).argmax())
                preds.append(best)
                scores.append(float(np.clip((soft[x:y, best] * size)[path == best].sum() / size.sum(), 0, 1)))
                turn = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1])
                stop = np.append(turn[1:], len(path))
                spans.append([{"start": int(w.starts[x + i] - start), "end": int(w.ends[x + j - 1] - start), "lang": str(names[path[i]])} for i, j in zip(turn, stop, strict=True)])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        return [pa.array(names[np.array(preds, np.int64)], pa.string()), pa.array(scores, pa.float64()), pa.array(spans, kind)]

    return extended(docs, run, "lang_pred string, score double, lang_spans array<struct<start:int,end:int,lang:string>>")


def held_out(doc_id: str = "doc_id"):
    """The fold that training never sees: crc32 of doc_id as text, modulo 5, is 0. A null doc_id is in no fold: null, neither learned nor held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0
