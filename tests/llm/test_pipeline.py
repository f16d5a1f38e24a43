"""The pipeline against a brute-force version, and the contract columns of the queries."""

import re
from collections import defaultdict

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from barline.llm import languages, queries
from test_text_operators import base_of, shingles


def brute(docs, items):
    """doc_id -> ids of what stays, by plain loops."""
    docs = {i: t for i, t in docs.items() if any(c.isalpha() for c in t or "")}
    sets, homes, root = {i: shingles(t) for i, t in docs.items()}, defaultdict(list), {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(sets):
        both = defaultdict(int)
        for s in sets[i]:
            for j in homes[s]:
                both[j] += 1
            homes[s].append(i)
        for j, n in both.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    docs = {i: t for i, t in docs.items() if find(i) == i}
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    grams = [{tuple(w[k : k + 8]) for k in range(len(w) - 7)} for w in map(words, items)]

    def leaked(t):
        w = words(t)
        own = {tuple(w[k : k + 8]) for k in range(len(w) - 7)}
        return any(len(own & g) >= 0.5 * len(g) for g in grams if g)

    theirs = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    value = re.compile(r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""")

    def masked(t):
        out, done = [], 0
        spans = [(a + (value.match(t[a:b]).end() if kind == 0 else 0), b) for a, kind, b in base_of(t)]
        for a, b in sorted(spans):
            if a >= done:
                out += [t[done:a], "<SECRET>"]
            done = max(done, b)
        return "".join(out) + t[done:]

    return {i: theirs.encode(masked(t), add_special_tokens=False).ids for i, t in docs.items() if not leaked(t)}


def test_pipeline(spark, sf_dir):
    docs = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    items = pq.read_table(f"{sf_dir}/benchmark.parquet").to_pydict()["text"]
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == brute(dict(zip(docs["doc_id"], docs["text"], strict=True)), items)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, place long, masked string, secrets int, lang_pred string, score double, row0 long, `column 1` string, facts map<string,int>"


def odd_rows(sf_dir):
    item = pq.read_table(f"{sf_dir}/benchmark.parquet").to_pydict()["text"][0]
    base = "The of and to in that is was for on many other days and nights of the long year in a far town by the sea."
    long = " ".join(f"word{k} goes on" for k in range(30_000))
    texts = [(1, None), (2, ""), (3, base), (3, base), (3, "Quite another text under the same number here."), (None, base), (None, "A line of plain words without any number."), (4, "..."),
             (5, long), (6, base.replace("far", "near") + " " + "more of it " * 3), (7, f"Intro words. {item} Closing words."), (8, 'so token = "0123456789abcdef0123456789abcdef" it is'), (None, item)]
    return [(i, t, "en" if t else None, "s", len(t or ""), 70 + k, "m", k, "xx", 0.5, k, "c", {"a": k}) for k, (i, t) in enumerate(texts)]


def test_stages_on_odd_rows(spark, sf_dir):
    rows = odd_rows(sf_dir)
    others = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 100_000)
    docs = spark.createDataFrame(rows, SCHEMA).unionByName(others, allowMissingColumns=True).repartition(3)
    gone = {"language ID": {0, 1, 7}, "MinHash near-dedup": {3, 5}, "benchmark decontamination": {10, 12}, "secret scan": set()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns, name
        got = {r.row0: r for r in kept.where("row0 is not null").collect()}
        away = set(range(len(rows))) - set(got)
        if name == "MinHash near-dedup":  # of three copies, one of them without a number, one stays
            assert away - {12} < {2, 3, 5} and len(away) == 3, name
        else:
            assert away == gone[name], name
        for k, r in got.items():
            want = dict(zip(docs.columns, rows[k], strict=True))
            if name == "secret scan" and k == 11:
                want |= {"text": 'so token = "<SECRET>" it is', "n_chars": len('so token = "<SECRET>" it is')}
            assert r.asDict() == want, name
    coded = corpus_pipeline.encode(spark, docs.where("row0 is not null"), sf_dir).collect()
    theirs = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((str(r[0]), theirs.encode(r[1] or "", add_special_tokens=False).ids) for r in rows)
    assert sorted((str(r.doc_id), list(r.ids)) for r in coded) == want and all(r.n_tokens == len(r.ids) for r in coded)


def test_stages_on_empty_tables(spark, sf_dir, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0, name
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(odd_rows(sf_dir), SCHEMA)
    assert corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).count() == docs.count()
    assert corpus_pipeline.identify_language(spark, docs.withColumn("lang", F.lit(None).cast("string")), sf_dir).count() == 0
    assert corpus_pipeline.run.__doc__ and len(corpus_pipeline.STAGES) == 5


def test_held_out_accuracy(spark, sf_dir):
    got = queries.op7_span_languages(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got) > 10


@pytest.mark.parametrize(
    "name, columns",
    [
        ("op1_chunk_reuse_bpe", "doc_id n_tokens ids_sha256 decoded_sha256"),
        ("op3_markov_secrets", "doc_id n_assign n_access n_hex base_sha256 spans"),
        ("op4_prefix_targets", "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars"),
        ("op5_consensus_html", "page_id url text n_chars"),
    ],
)
def test_contract_columns(spark, sf_dir, name, columns):
    assert set(columns.split()) <= set(queries.QUERIES[name](spark, sf_dir).columns)


def test_fold(spark):
    import zlib

    rows = spark.range(50).selectExpr("id as doc_id").select("doc_id", languages.held_out().alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
