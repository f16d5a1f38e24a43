"""Byte-level BPE encoding and decoding with reuse of content-defined chunks across documents.

A rolling hash cuts each text into chunks where its content says so, so that documents that share a passage share its inner
chunks. Chunks that occur more than once in the corpus are encoded once, by the document that owns them, and met by hash; all
other text is encoded where it stands. Tokens near a cut can differ from those of the whole text, so each join is repaired by
encoding the text around it again, outwards, until both ends fall on token boundaries of the pieces beside it.
"""

from __future__ import annotations

import functools
import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm._text import slices, text_bytes

#: Fixed value: the pattern that splits text before merging, as published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bytes that the rolling hash sees; bits that are zero at a cut; shortest and longest chunk.
SPAN, CUT_BITS, SHORTEST, LONGEST = 32, 10, 256, 16384

_PRINTED = np.zeros(256, bool)
_PRINTED[0x21:0x7F] = True
_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x0A]] = True


def _byte_of() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary means: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Codec:
    """A byte-level BPE vocabulary file of the tokenizers library; its merges rank as its ids do."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte, special = _byte_of(), {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.coding = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.marks = [x.encode() for x in special]
        self.special = set(special)
        size = 1 + max([*ranks.values(), *special.values()])
        self.bytes = [b""] * size
        for t, i in [*ranks.items(), *((k.encode(), v) for k, v in special.items())]:
            self.bytes[i] = t
        self.length = np.array([len(x) for x in self.bytes], np.int64)

    def encode(self, text: bytes) -> np.ndarray:
        text = text.decode("utf-8")
        return np.array(self.coding.encode(text, allowed_special=self.special, disallowed_special=()), np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join([self.bytes[i] for i in ids.tolist()]).decode("utf-8", "replace")


def packed(ids: np.ndarray) -> bytes:
    """Ids as they are shuffled: two bytes each where that is enough, else four, compressed."""
    small = not len(ids) or int(ids.max()) < 1 << 16
    return zstandard.ZstdCompressor(level=3).compress((b"2" if small else b"4") + ids.astype(np.uint16 if small else np.uint32).tobytes())


def unpacked(held: bytes) -> np.ndarray:
    held = zstandard.ZstdDecompressor().decompress(held)
    return np.frombuffer(held[1:], np.uint16 if held[:1] == b"2" else np.uint32).astype(np.uint32)


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


@functools.cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """base^k and base^-k modulo 2^64 for k below size; they only place cuts, chunks are named by XXH3-128."""
    both = []
    for base in (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)):
        out = np.full(size, base, np.uint64)
        out[0] = 1
        both.append(np.cumprod(out))
    return both[0], both[1]


def cuts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each document its chunks' bounds, relative to its own start, both ends included; none for an empty one."""
    n = len(data)
    up, down = _powers(1 << max(16, n.bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    rolled = (sums[SPAN:] - sums[:-SPAN]) * down[: max(0, n + 1 - SPAN)]
    rolled *= np.uint64(0x9E3779B97F4A7C15)
    at = np.flatnonzero((rolled >> np.uint64(64 - CUT_BITS)) == 0) + SPAN
    at = at[(at < n)]
    at = at[(data[at] & 0xC0) != 0x80]
    edges = np.searchsorted(at, offsets)
    out = []
    for d in range(len(offsets) - 1):
        first, last = int(offsets[d]), int(offsets[d + 1])
        if first == last:
            out.append(np.zeros(0, np.int64))
            continue
        held, now = [0], first
        for p in [*at[edges[d] : edges[d + 1]].tolist(), last]:
            if first + SPAN > p < last:
                continue  # the hash saw the document before
            while p - now > LONGEST:
                q = now + LONGEST
                while (data[q] & 0xC0) == 0x80:
                    q -= 1
                held.append(q - first)
                now = q
            if p - now >= SHORTEST and p < last:
                held.append(p - first)
                now = p
        held.append(last - first)
        out.append(np.array(held, np.int64))
    return out


def _names(text: bytes, bounds: np.ndarray) -> list[bytes]:
    return [xxhash.xxh3_128_digest(text[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _documents(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """Row, text and chunk bounds."""
    data, offsets = text_bytes(batch.column("text"))
    for a, b in slices(offsets, 1 << 20):
        part = data[offsets[a] : offsets[b]]
        for i, bounds in enumerate(cuts(part, offsets[a : b + 1] - offsets[a])):
            yield a + i, data[offsets[a + i] : offsets[a + i + 1]].tobytes(), bounds


def _chunk_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, names, times = [], [], []
        for row, text, bounds in _documents(batch):
            own = Counter(_names(text, bounds))
            names += own.keys()
            times += own.values()
            rows += [row] * len(own)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(names, pa.binary()), pa.array(times, pa.int64())], ["doc_id", "chunk", "times"])


def _owned(path: str):
    """Encodes the chunks that a document owns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            names, ids, owns = [], [], batch.column("owns")
            for row, text, bounds in _documents(batch):
                wanted = set(owns[row].as_py() or ())
                for k, name in enumerate(_names(text, bounds) if wanted else ()):
                    if name in wanted:
                        wanted.discard(name)
                        names.append(name)
                        ids.append(packed(c.encode(text[bounds[k] : bounds[k + 1]])))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(ids, pa.binary())], ["chunk", "ids"])

    return run


def _safe(data: np.ndarray) -> np.ndarray:
    """Places between a character that isn't white space and an ASCII blank, where the splitting pattern always has a boundary. Of characters
    beyond ASCII those that may be a blank go by their first bytes (U+0085, U+00A0, U+1680, U+2000 to 207F, U+3000 to 307F).
    """
    last, one, two = data[:-1], np.concatenate([[0], data[:-2]]), np.concatenate([[0, 0], data[:-3]])[: len(data) - 1]
    wide = (last >= 0x80) & ~((one == 0xC2) & np.isin(last, (0x85, 0xA0))) & ~(np.isin(two, (0xE1, 0xE2, 0xE3)) & np.isin(one, (0x80, 0x81, 0x9A)))
    return np.flatnonzero((_PRINTED[last] | wide) & _GAP[data[1:]]) + 1


def _spliced(c: Codec, text: bytes, pieces: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
    """The tokens of text from those of its consecutive pieces (start, end, ids); exact.

    A window from the last safe place of the piece before a join to the first one of the piece after it is encoded again; where a piece has
    none, as in scripts without blanks, or its tokens don't have a boundary there, the window grows on.
    """
    if len(pieces) == 1:
        return pieces[0][2]
    safe = _safe(np.frombuffer(text, np.uint8))
    out, done, n = [], 0, len(pieces)  # done: up to here out is exact
    for k, (a, b, ids) in enumerate(pieces):
        ends = a + np.cumsum(c.length[ids])
        own = safe[np.searchsorted(safe, a, "right") : np.searchsorted(safe, b, "left")]
        own = own[np.isin(own, ends)] if len(own) else own
        first = a if k == 0 else (int(own[0]) if len(own) else None)
        last = b if k == n - 1 else (int(own[-1]) if len(own) else None)
        if k == 0 and last is None or k == n - 1 and first is None or first is None:
            continue  # the next window holds this piece
        if first > done:
            out.append(c.encode(text[done:first]))
        lo = 0 if first == a else int(np.searchsorted(ends, first, "left")) + 1
        hi = int(np.searchsorted(ends, last, "left")) + 1
        out.append(ids[lo:hi])
        done = last
    if done < len(text):
        out.append(c.encode(text[done:]))
    return np.concatenate(out)


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            shared, ids, texts = batch.column("shared"), [], []
            for row, text, bounds in _documents(batch):
                known = {x["chunk"]: x["ids"] for x in shared[row].as_py() or ()}
                pieces, own = [], 0  # own: where text that isn't shared begins
                for k, name in enumerate(_names(text, bounds) if known else ()):
                    if name in known:
                        a, b = int(bounds[k]), int(bounds[k + 1])
                        if own < a:
                            pieces.append((own, a, c.encode(text[own:a])))
                        pieces.append((a, b, unpacked(known[name])))
                        own = b
                if own < len(text):
                    pieces.append((own, len(text), c.encode(text[own:])))
                found = _spliced(c, text, pieces) if pieces else np.zeros(0, np.uint32)
                ids.append(found.astype(np.int32))
                texts.append(c.decode(found))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), flat, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs: doc_id, text (others ignored); path: a byte-level BPE file of the tokenizers library. Returns doc_id, ids
    array<int>, decoded: a row for each row.

    Strings of special tokens in a text are those tokens, no others are added. Null or empty text: no ids and an empty text.
    Null doc_id: encoded on its own. Rows of one doc_id each get their own result. No rows: no rows.
    """
    docs = docs.select("doc_id", "text")
    chunks = docs.mapInArrow(_chunk_names, "doc_id long, chunk binary, times long").where("doc_id is not null")
    owners = chunks.groupBy("chunk").agg(F.sum("times").alias("n"), F.min("doc_id").alias("doc_id")).where("n > 1")
    owned = owners.groupBy("doc_id").agg(F.collect_list("chunk").alias("owns"))
    once = docs.join(owned, "doc_id", "left").mapInArrow(_owned(path), "chunk binary, ids binary").dropDuplicates(["chunk"])
    met = chunks.join(once, "chunk").groupBy("doc_id").agg(F.collect_list(F.struct("chunk", "ids")).alias("shared"))
    return docs.join(met, "doc_id", "left").mapInArrow(_encoded(path), "doc_id long, ids array<int>, decoded string")
