"""Ids of a lower-casing BPE vocabulary with word ends, as the tokenizers library gives them.

Such a tokenizer drops white space and never looks across it, so that the ids of a text are those of its blank-separated chunks in a
row; chunks are encoded once for as long as a worker remembers them. Chunks of plain Latin letters, digits and marks are split by the
tokenizer's own pattern and merged by rank with tiktoken (the merges rank as ids do; a NUL stands for the word's end); whatever else a
chunk holds goes to the tokenizers library.
"""

from __future__ import annotations

import functools
import json
import re
from array import array

import numpy as np
import regex
import tiktoken
import tokenizers

from barline.llm.tokens import _byte_of

#: Fixed value: the pattern that splits a text before merging, as in the vocabulary's file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Chunks and words that a worker remembers, and the longest that it does.
MOST, LONGEST = 600_000, 64

#: Characters that are one code point in lower case too and that normalisation leaves alone.
_PLAIN = re.compile("[\x21-\x7e\xa1-įı-ɏ]+").fullmatch


class WordCodec:
    """path: a file of the tokenizers library of this kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != PATTERN or spec["model"]["end_of_word_suffix"] != "</w>":
            raise ValueError("not a vocabulary of lower-cased words with ends")
        byte, special = _byte_of(), [x["content"] for x in spec["added_tokens"]]
        ranks = {}
        for t, i in spec["model"]["vocab"].items():
            if t not in special:
                stem = t.removesuffix("</w>")
                ranks[bytes(byte[c] for c in stem) + b"\0" * (stem != t)] = i
        self.whole = tokenizers.Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.split = regex.compile(PATTERN).findall
        self.marked = re.compile("|".join(sorted({re.escape(x[:2]) for x in special})) or "$^").search
        self.kind = "H" if max(spec["model"]["vocab"].values()) < 1 << 16 else "I"
        self.words: dict[str, bytes] = {}
        self.chunks = _Chunks(self)

    def word(self, text: str) -> bytes:
        found = self.words.get(text)
        if found is None:
            found = array(self.kind, self.merge(text.encode() + b"\0")).tobytes()
            if len(text) <= LONGEST:
                if len(self.words) >= MOST:
                    self.words.clear()
                self.words[text] = found
        return found

    def ids(self, text: bytes) -> np.ndarray:
        """The ids of a text in UTF-8."""
        return np.frombuffer(b"".join(map(self.chunks.__getitem__, text.split())), np.dtype(self.kind)).astype(np.uint32)


class _Chunks(dict):
    def __init__(self, codec: WordCodec):
        self.codec = codec

    def __missing__(self, chunk: bytes) -> bytes:
        c, text = self.codec, chunk.decode("utf-8", "replace")
        plain = _PLAIN(text)
        if plain and text.isalpha():
            found = c.word(text.lower())
        elif plain and not c.marked(text):
            found = b"".join([c.word(w) for w in c.split(text.lower())])
        else:
            found = array(c.kind, c.whole.encode(text, add_special_tokens=False).ids).tobytes()
        if len(chunk) <= LONGEST:
            if len(self) >= MOST:
                self.clear()
            self[chunk] = found
        return found


@functools.cache
def codec(path: str) -> WordCodec:
    return WordCodec(path)
