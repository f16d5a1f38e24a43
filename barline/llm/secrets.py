"""Secret scans: fixed patterns, and strings that a character Markov model of random strings explains better than one of
ordinary identifiers.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm._spark import extended
from barline.llm._text import slices, text_bytes

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "markov")
SPANS = "array<struct<kind:string,start:int,end:int,secret_start:int>>"

#: Bytes that are scored at once.
PIECE = 1 << 20

#: The characters a candidate consists of; the models' states.
ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
#: Alphabets of random strings, smallest first; a labelled value belongs to the first one that has all its characters.
RANDOM = {"hex": b"0123456789abcdef", "upper_hex": b"0123456789ABCDEF", "base36": ALPHABET[26:62], "base62": ALPHABET[:62], "base64": ALPHABET[:64], "base64url": ALPHABET[:62] + b"_-"}

_STATE = np.full(256, -1, np.int16)
_STATE[list(ALPHABET)] = np.arange(len(ALPHABET))
_CANDIDATE = _STATE >= 0
_SIGN = np.zeros(256, bool)
_SIGN[list(ALPHABET[62:])] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_N = len(ALPHABET)


@dataclass(frozen=True)
class Params:
    #: Documents that the ordinary model is trained on at most, about; chosen by hash.
    sample: int = 20_000
    #: Strings of 40 characters for each random alphabet, labelled random because they are drawn so.
    strings: int = 4_000
    #: Values in base spans are labelled random from so many characters on, and count this often, all together as much as those drawn at most.
    labelled: int = 16
    weight: int = 10
    #: The ordinary model learns from shorter runs only; a secret may have any length.
    shortest: int = 20
    #: Share of an even distribution in the ordinary model, so that no single unseen pair is evidence enough.
    even: float = 0.1
    #: A stretch needs this log-likelihood ratio in total.
    least: float = 14.0
    #: A stretch grows to the next sign or the end of its run where that costs no more than this.
    edge: float = 4.0


def _runs(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = ends - starts >= least
    return starts[long], ends[long]


def base_spans(text: bytes) -> list[tuple[int, int, int, int]]:
    """Start, kind, end, start of the secret itself, in bytes; in order of start, then kind."""
    out = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    starts, ends = _runs(_HEX[np.frombuffer(text, np.uint8)], 32)
    out += [(a, 2, b, a) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return sorted(out)


def _outside(data: np.ndarray, offsets: np.ndarray, base: list[list]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of the alphabet in each document, cut at its base spans, and the pair of each byte in a run."""
    state = _STATE[data].astype(np.int64)
    for at, spans in zip(offsets.tolist(), base, strict=False):
        for x, _, y, _ in spans:
            state[at + x : at + y] = -1
    inside, before = state >= 0, np.full(len(data), -1)
    before[1:] = state[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = -1
    starts = np.flatnonzero(inside & (before < 0))
    last = np.ones(len(data), bool)
    last[:-1] = (state[1:] < 0) | (before[1:] < 0)
    return starts, np.flatnonzero(inside & last) + 1, np.where(before < 0, _N, before) * _N + np.maximum(state, 0)


def _transitions(strings: list[bytes]) -> np.ndarray:
    """Counts of character pairs; a string begins in the state 0 beyond the alphabet."""
    counts = np.zeros((_N + 1) * _N, np.int64)
    for s in strings:
        x = _STATE[np.frombuffer(s, np.uint8)].astype(np.int64)
        counts += np.bincount(np.concatenate([[_N], x[:-1]]) * _N + x, minlength=len(counts))
    return counts


def _logs(counts: np.ndarray, prior: float, even: float = 0.0) -> np.ndarray:
    """Log probabilities of a character after another, drawn towards the characters' own shares by so many counts, then mixed with
    a share of an even distribution.
    """
    table = counts.reshape(_N + 1, _N).astype(float)
    share = (table.sum(0) + 0.5) / (table.sum() + 0.5 * _N)
    table += prior * share
    return np.log((1 - even) * table / table.sum(1, keepdims=True) + even / _N)


def _alphabet(value: bytes) -> int:
    """The first random alphabet that has all characters of a value, or -1."""
    held = set(value)
    return next((k for k, letters in enumerate(RANDOM.values()) if held <= set(letters)), -1)


def train(docs: DataFrame, p: Params = Params()) -> np.ndarray:
    """Log-likelihood ratios of character pairs, for each random alphabet against ordinary identifiers.

    Labelled samples, from about p.sample documents that a hash of doc_id chooses: random are the values in base spans (keys, digests
    and what is assigned to a password or token) of p.labelled characters or more, beside drawn strings of each alphabet; ordinary
    are the runs outside base spans of fewer than p.shortest characters: words, names, paths and numbers.
    """
    n = docs.count()
    part, size = min(1.0, p.sample / max(n, 1)), (_N + 1) * _N

    def count(batches):
        known: set[bytes] = set()  # a value of many documents counts once in a task
        for batch in batches:
            total = np.zeros((1 + len(RANDOM), size), np.int64)
            data, offsets = text_bytes(batch.column("text"))
            for a, b in slices(offsets, PIECE):
                part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                texts = [part[x:y].tobytes() for x, y in zip(own[:-1], own[1:], strict=True)]
                base = [base_spans(t) for t in texts]
                starts, ends, pairs = _outside(part, own, base)
                edge = np.zeros(len(part) + 1, np.int8)
                short = ends - starts < p.shortest
                edge[starts[short]] += 1
                edge[ends[short]] -= 1
                total[0] += np.bincount(pairs[np.cumsum(edge[:-1]) > 0], minlength=size)
                for text, spans in zip(texts, base, strict=True):
                    for value in {text[z:y].rstrip(b"=") for _, _, y, z in spans if y - z >= p.labelled} - known:
                        known.add(value)
                        if (k := _alphabet(value)) >= 0:
                            total[1 + k] += _transitions([value])
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array((at // size).astype(np.int32)), pa.array((at % size).astype(np.int32)), pa.array(total.ravel()[at])], ["kind", "pair", "n"])

    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < part * (1 << 20)).select("text")
    rows = chosen.mapInArrow(count, "kind int, pair int, n long").groupBy("kind", "pair").agg(F.sum("n").alias("n")).collect()  # a row for each pair of characters
    counts = np.zeros((1 + len(RANDOM), size), np.int64)
    for kind, pair, seen in rows:
        # seen once, an ordinary pair may come from the very secret in question
        counts[kind, pair] = seen - 1 if kind == 0 else seen
    rng, out = np.random.default_rng(20), []
    for k, letters in enumerate(RANDOM.values()):
        drawn = np.frombuffer(letters, np.uint8)[rng.integers(0, len(letters), (p.strings, 40))]
        random = _transitions([x.tobytes() for x in drawn])
        random = random + counts[1 + k] * min(p.weight, random.sum() / max(counts[1 + k].sum(), 1))
        out.append(_logs(random, 1.0) - _logs(counts[0], 20.0, p.even))
    ratios, digits = np.array(out), slice(52, 62)
    ratios[:, digits, digits] = np.minimum(ratios[:, digits, digits], 0)  # a number is ordinary, also where the sample has none
    return ratios


def _stretches(scores: np.ndarray, signs: np.ndarray, p: Params) -> list[tuple[int, int]]:
    """The stretches of one run whose scores (by random alphabet and character) sum to p.least or more: the best one, then those
    beside it; touching ones are joined.
    """
    sums = np.zeros((len(scores), scores.shape[1] + 1))
    np.cumsum(scores, 1, out=sums[:, 1:])
    found, todo = [], [(0, scores.shape[1])]
    while todo:
        a, b = todo.pop()
        if b <= a:
            continue
        part = sums[:, a : b + 1]
        gain = part[:, 1:] - np.minimum.accumulate(part, 1)[:, :-1]
        letters, y = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[letters, y] < p.least:
            continue
        own = part[letters]
        y = int(y) + 1
        x = int(own[:y].argmin())
        cuts = signs[(signs >= a) & (signs < b)] - a
        left, right = cuts[cuts < x], cuts[cuts >= y]
        x2, y2 = int(left[-1]) + 1 if len(left) else 0, int(right[0]) if len(right) else b - a
        x, y = x2 if own[x2] - own[x] <= p.edge else x, y2 if own[y] - own[y2] <= p.edge else y
        found.append((a + x, a + y))
        todo += [(a, a + x), (a + y, b)]
    out: list[tuple[int, int]] = []
    for x, y in sorted(found):
        if out and out[-1][1] == x:
            x = out.pop()[0]
        out.append((x, y))
    held = set(signs.tolist())
    return [(next((k for k in range(x, y) if k not in held), x), y) for x, y in out]  # signs before a secret stay


def _markov(data: np.ndarray, offsets: np.ndarray, base: list[list], ratios: np.ndarray, p: Params) -> list[list[tuple[int, int]]]:
    """Each document's stretches that look random, in bytes."""
    out: list[list[tuple[int, int]]] = [[] for _ in base]
    starts, ends, pairs = _outside(data, offsets, base)
    flat = ratios.reshape(len(ratios), -1)
    # no stretch of a run exceeds the sum of the run's gains under the best alphabet of each character
    most = np.zeros(len(data) + 1)
    np.cumsum(np.maximum(flat.max(0), 0)[pairs], out=most[1:])
    chosen = most[ends] - most[starts] >= p.least - 1e-6
    docs = np.searchsorted(offsets, starts[chosen], "right") - 1
    for k, x, y in zip(docs.tolist(), starts[chosen].tolist(), ends[chosen].tolist(), strict=True):
        for i, j in _stretches(flat[:, pairs[x:y]], np.flatnonzero(_SIGN[data[x:y]]), p):
            out[k].append((x + i - int(offsets[k]), x + j - int(offsets[k])))
    return out


def scan(docs: DataFrame, p: Params = Params(), mark: str = "<SECRET>") -> DataFrame:
    """docs: text, doc_id (for training), others. Adds secrets (kind, start, end, secret_start in code points, end exclusive; in
    order of start, then kind) and masked (the text with each secret itself replaced by mark); existing columns of these names
    give way.

    Base kinds are leftmost matches without overlap, each kind on its own: assign (a key word, : or =, a value of eight
    characters or more), access (AKIA and capitals or digits, 16 or more), hex (32 or more of 0-9a-f). markov adds, of the runs of the
    alphabet outside base spans, the stretches of any length whose likelihood ratio of random to ordinary reaches p.least.

    Null text: no secrets, masked stays null. Empty text: none. Null doc_id: scanned, not trained on. Repeated rows each get their result.
    Very long texts: alone. No rows: no rows.
    """
    ratios = train(docs.select("doc_id", "text").where("doc_id is not null"), p)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        data, offsets = text_bytes(batch.column("text"))
        valid, spans, masked = batch.column("text").is_valid().to_numpy(zero_copy_only=False), [], []
        base = [base_spans(data[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        random = []
        for a, b in slices(offsets, PIECE):
            random += _markov(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], base[a:b], ratios, p)
        for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            text = data[a:b].tobytes()
            found = sorted(base[k] + [(x, 3, y, x) for x, y in random[k]])
            at = np.cumsum((data[a:b] & 0xC0) != 0x80) if found else None
            cp = lambda i, at=at: int(at[i - 1]) if i else 0
            spans.append([{"kind": KINDS[kind], "start": cp(x), "end": cp(y), "secret_start": cp(z)} for x, kind, y, z in found])
            out, done = [], 0
            for _, _, y, z in sorted(found, key=lambda s: s[3]):
                if z >= done:
                    out += [text[done:z], mark.encode()]
                done = max(done, y)
            masked.append((b"".join(out) + text[done:]).decode() if valid[k] else None)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("secret_start", pa.int32())]))
        return [pa.array(spans, kind), pa.array(masked, pa.string())]

    return extended(docs, run, f"secrets {SPANS}, masked string")
