"""Packing, fill-in-middle and phrase mining against brute force, on small made-up texts with nulls, empty and repeated rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tokenizers

from barline.llm import collocations, middle, packing
from barline.llm._text import text_bytes
from barline.llm.word_tokens import WordCodec

WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = ["Ünïcode naïve Ärger", "İstanbul ΣΑΣ ß ﬁ é ñ", "漢字かな交じり文。 next", "don't I'll we've 'S", "<|endoftext|> a<|startoftext|>b <|x|>", "a b c　d \x1c\x85 \x00 \x00\x00", "12345 ½ ² x³ _-_ $$$", "tab\tand\nlines\r\n\x0b\x0c end  ", "😀 emoji😀s 👩‍👩‍👧", "‍́ ­", "ŉ ǅ ĳ ª º"]


def prose(rng, n):
    stems = "the of and to in that is was for on ea st nt re ing ed er tion ly ou wh sh".split()
    return " ".join("".join(rng.choices(stems, k=rng.randint(1, 3))) for _ in range(n))


def frame(spark, rows):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 9, "x", 1, None) for i, t in rows], "doc_id long, text string, row long, n string, block long, ids long").repartition(3)


@pytest.fixture(scope="module")
def whole():
    return tokenizers.Tokenizer.from_file(WORDS)


def test_word_ids_are_those_of_the_library(whole):
    rng = random.Random(3)
    codec = WordCodec(WORDS)
    texts = [*ODD, prose(rng, 300), prose(rng, 50).upper(), "x" * 5000, "ab1" * 400]
    kinds = [*"abcXYZéßİſ09'.,-<|>", " ", " ", "\n", "́", " ", "漢", "'s", "<|endoftext|>", "\x00", "\x85"]
    texts += ["".join(rng.choices(kinds, k=rng.randint(1, 60))) for _ in range(3000)]
    for t in texts:
        assert codec.ids(t.encode()).tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_least_squares_without_negative_counts():
    rng = np.random.default_rng(5)
    for _ in range(20):
        a, b = (rng.random((12, 30)) < 0.3).astype(float), rng.random(12) * 50
        x = packing.nonnegative(a, b)
        assert (x >= 0).all()
        gradient = a.T @ (b - a @ x)  # optimal: no column could enter, those inside are at rest
        assert gradient.max() < 1e-5 and np.abs(gradient[x > 0]).max() < 1e-5


def test_combinations_fill_the_window():
    found = packing.combinations(24)
    assert all(sum(k * n for k, n in c.items()) == 24 for c in found)
    assert len({tuple(sorted(c.items())) for c in found}) == len(found)
    threes = {tuple(sorted((a, b, 24 - a - b))) for a in range(1, 23) for b in range(1, 24 - a)}
    assert threes <= {tuple(sorted(c.elements())) for c in found}


def held_packing(rows, made, whole, window):
    """What every packing must hold: returns the share of padding."""
    want = Counter()
    for i, t in rows:
        want[i, tuple([*whole.encode(t or "", add_special_tokens=False).ids, 1])] += 1
    docs, current = Counter(), None
    ids = lambda r: np.frombuffer(bytes(r.ids), "<u4").tolist()
    assert all(len(ids(r)) == r.length > 0 for r in made)
    sequences = {}
    for r in made:
        sequences.setdefault(r.sequence_id, []).append(r)
    padding = 0
    for held in sequences.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    # documents are whole again (rows of one doc_id are told apart by following their pieces)
    left = {}
    for r in sorted(made, key=lambda r: r.start):
        left.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for (i, n), pieces in left.items():
        open_ = []
        for r in pieces:
            if r.start == 0:
                open_.append(ids(r))
            else:
                fit = next(o for o in open_ if len(o) == r.start and any(tuple(o + ids(r)) == k[1][: r.start + r.length] for k in want if k[0] == i))
                fit += ids(r)
        for o in open_:
            assert len(o) == n
            docs[i, tuple(o)] += 1
    assert docs == want
    return padding / max(1, sum(r.length for r in made))


def test_packing(spark, whole):
    rng = random.Random(11)
    rows = [(i, prose(rng, rng.choice([3, 20, 60, 150, 400]))) for i in range(150)]
    rows += [(200 + i, t) for i, t in enumerate([None, "", "  \n", *ODD, prose(rng, 6000), rows[0][1], rows[0][1]])] + [(5, rows[5][1]), (5, "other text"), (None, "no id"), (None, None)]
    made = packing.pack(frame(spark, rows), WORDS, p=packing.Params(window=256, step=4)).collect()
    assert held_packing(rows, made, whole, 256) <= 3 * 3 / 256
    assert held_packing(rows[:7], packing.pack(frame(spark, rows[:7]), WORDS).collect(), whole, 2048) == 0
    assert packing.pack(frame(spark, rows).where("false"), WORDS).collect() == []


def test_packing_of_equal_lengths_and_blocks(spark, whole, monkeypatch):
    """A length without a partner goes end to end; ranks and running sums go on over blocks."""
    monkeypatch.setattr(packing, "BLOCK_BITS", 2)
    rows = [(i, "same words " * 30) for i in range(50)] + [(100 + i, "pair " * 63) for i in range(41)]
    made = packing.pack(frame(spark, rows), WORDS, p=packing.Params(window=128, step=4)).collect()
    assert held_packing(rows, made, whole, 128) <= 2 * 3 / 122
    assert {r.length for r in made if r.doc_id >= 100} == {64}


def test_most_documents_stay_whole(spark):
    rng = random.Random(2)
    rows = [(i, "a " * rng.randint(20, 200)) for i in range(3000)]
    made = packing.pack(frame(spark, rows), WORDS, p=packing.Params(window=256, step=4)).collect()
    assert sum(r.length < r.doc_tokens for r in made) < 0.1 * len(rows)


def tokens(text):
    return re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)


def test_skip_lists_reach_every_rank():
    rng = random.Random(7)
    texts = [*ODD, "", " ", "\n\t", "one", " one", "one ", prose(rng, 700), None]
    data, offsets = text_bytes(pa.array(texts))
    lists = middle.SkipLists(data, offsets)
    assert len(lists.lanes) > 5
    own = [tokens(t or "") for t in texts]
    assert lists.size.tolist() == [len(t) for t in own]
    for share in (0, 0.2, 0.5, 0.77, 1):
        ranks = np.array([int(share * len(t)) for t in own])
        assert lists.cut(ranks).tolist() == [len("".join(t[:k])) for t, k in zip(own, ranks.tolist(), strict=True)]
    for k in range(len(own[-2]) + 1):
        ranks = np.zeros(len(texts), np.int64)
        ranks[-2] = k
        assert lists.cut(ranks)[-2] == len("".join(own[-2][:k]))


def test_middle(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randint(0, 90)) + rng.choice(["", " ", "\n"])) for i in range(200)]
    rows += [(1000 + i, t) for i, t in enumerate([None, "", " ", "x <P> y", "<S>", "a<M>b", "< P>", "a < P", *ODD * 4, prose(rng, 30000)])] + [(7, rows[7][1]), (7, "other"), (None, "no id at all"), (None, None)]
    want = Counter()
    for i, t in rows:
        t = t or ""
        w, digest = tokens(t), hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
        h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted((h[0] % (len(w) + 1), h[1] % (len(w) + 1)))
        x, y, z = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
        if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
            want[i, len(w), "plain", None, None, t, t] += 1
        elif h[3] % 100 < 80:
            want[i, len(w), "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}", t] += 1
        else:
            want[i, len(w), "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}", t] += 1
    made = middle.transform(frame(spark, rows))
    got = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", middle.restored(made.output, made.form)).collect()
    assert Counter(map(tuple, got)) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert middle.transform(frame(spark, rows).where("false")).collect() == []


def mined(rows, longest, least, wrapped, top):
    """Brute force over (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    every = [p for p, a in f.items() if len(p) > 2 and a >= least]
    out = []
    for p in every:
        a, lang, w = f[p], p[0], p[1:]
        longer = [q for q in every if q[0] == lang and len(q) > len(p) and any(q[i : i + len(w)] == w for i in range(1, len(q) - len(w) + 1))]
        if any(100 * f[q] >= wrapped * a for q in longer):
            continue
        score, _, l, r = min((10**6 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, l, r, n[lang], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    ranked, before = [], Counter()
    for x in out:
        before[x[0]] += 1
        if before[x[0]] <= top:
            ranked.append((x[0], before[x[0]], *x[1:]))
    return ranked


def talk(rng, n):
    """Few words with Zipf's frequencies, set phrases among them."""
    vocabulary = [f"w{k}" for k in range(60)]
    fixed = ["new york city", "as well as", "by and large", "Über Nacht", "a a a a", "out of the box"]
    words = rng.choices(vocabulary, [1 / (k + 1) for k in range(60)], k=n)
    for _ in range(n // 8):
        words.insert(rng.randrange(len(words)), rng.choice(fixed))
    return "".join(w + rng.choice([" ", " ", " ", " ", "\t", ", ", ". ", "\n", "  ", "\r\x0b", " "]) for w in words)


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(13)
    rows = [(rng.choice(["en", "en", "en", "de", None, "und"]), talk(rng, rng.randint(1, 120)).replace("w1 ", rng.choice(["W1 ", "w1 "]))) for _ in range(250)]
    return rows + [("en", None), (None, None), ("fr", ""), ("it", "..,;"), ("en", "\x00 \x85 漢 漢 漢"), ("es", "sola vez " * 40), rows[0], rows[0], ("de", talk(rng, 9000))]


@pytest.mark.parametrize(("longest", "least", "wrapped", "top"), [(3, 10, 50, 2000), (3, 3, 30, 15), (4, 5, 50, 2000), (2, 10, 50, 2000)])
def test_collocations(spark, talks, longest, least, wrapped, top):
    docs = spark.createDataFrame([(*r, 1, "x") for r in talks], "lang string, text string, n int, id string").repartition(4)
    got = [tuple(r) for r in collocations.collocations(docs, longest, least, wrapped, top).orderBy("lang", "rank").collect()]
    want = mined(talks, longest, least, wrapped, top)
    assert got == want
    assert {x[0] for x in want} >= {"en", "de", "und", "es"}


def test_phrases_do_not_depend_on_slices_and_filter(spark, talks):
    docs = spark.createDataFrame(talks, "lang string, text string").coalesce(1)
    of = lambda x: sorted(map(repr, x[0].collect()))
    assert of(collocations.phrases(docs)) == of(collocations.phrases(docs, slice_words=300, filter_bits=12))
    assert collocations.collocations(docs.where("false")).collect() == []


def test_scores_pass_64_bits(spark):
    from pyspark.sql import functions as F

    big = 900_000_000_000_007
    got = spark.createDataFrame([(big - 2, big, big - 1)], "a long, l long, r long").select(collocations._score(F.col("l"), F.col("r"))).first()[0]
    assert got == 10**6 * (big - 2) ** 2 // (big * (big - 1))


def test_tiles_count_alike():
    rng = np.random.default_rng(3)
    codes = np.minimum(rng.zipf(1.3, 200_000), 90_000) << 32 | np.minimum(rng.zipf(1.3, 200_000), 90_000)
    want = np.unique(codes, return_counts=True)
    for bits, crowded in ((11, 16), (4, 16), (4, 1), (6, 1000)):
        got, times = collocations.tile_counts(codes, bits, crowded)
        order = np.argsort(got)
        assert (got[order] == want[0]).all() and (times[order] == want[1]).all()
