import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkann.llm import packing as K
from sparkann.llm import quality as Q

TOK = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def encoder():
    return K.Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_ids_equal_the_tokenizers(text):
    assert encoder_().ids(text).tolist() == TOK.encode(text, add_special_tokens=False).ids


_kept = []


def encoder_():
    if not _kept:
        _kept.append(encoder())
    return _kept[0]


def test_ids_of_documents_and_cut_texts(spark, monkeypatch):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(150).collect()]
    texts += ["a  b   c", " \n x\t y", "<|endoftext|> x", "it's they'll  'S", "日本語 text", "1234 5678²", "x" * 3000]
    for part in (1 << 20, 50):
        monkeypatch.setattr(K, "PART", part)
        for t in texts:
            assert encoder_().ids(t).tolist() == TOK.encode(t, add_special_tokens=False).ids


def check(got, texts):
    ids = {k: np.array([*TOK.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for k, t in texts.items()}
    for k, rows in got.groupby("doc_id"):
        rows = rows.sort_values("start")
        assert rows.start.tolist() == [0, *rows.length.cumsum().tolist()[:-1]] and rows.length.sum() == len(ids[k])
        for r in rows.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[k][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[k])
    sums = []
    for _, rows in got.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows.offset.tolist() == [0, *rows.length.cumsum().tolist()[:-1]]
        sums.append(rows.length.sum())
    assert max(sums) <= 2048 and got.length.min() > 0
    return np.array(sums)


def test_packing_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sums = check(K.pack(docs).toPandas(), {r.doc_id: r.text for r in docs.collect()})
    assert 1 - sums.sum() / (2048 * len(sums)) < 0.01


@pytest.mark.parametrize("window", [3, 20_000])
def test_packing_edge_cases(spark, monkeypatch, window):
    monkeypatch.setattr(K, "WINDOW", window)
    texts = {1: None, 2: "", 3: "a " * 6000, 4: "b", 5: "c " * 2047, 6: "hello world " * 300}
    df = spark.createDataFrame([(k, t, 5, 6) for k, t in texts.items()], "doc_id long, text string, start int, length int")
    check(K.pack(df).toPandas(), texts)
    twice = K.pack(df.where("doc_id in (1, 4)").unionByName(df.where("doc_id in (1, 4)"))).toPandas()
    assert twice.groupby("doc_id").length.sum().to_dict() == {1: 2, 4: 4}
    assert K.pack(df.limit(0)).count() == 0
    assert K.pack(spark.createDataFrame([(None, "x")], "doc_id long, text string")).first().doc_id is None


def test_combinations_fill_and_nnls_solves():
    c = K.combinations(24)
    assert {tuple(sorted(x[x > 0].tolist())) for x in c} == {(24,)} | {(a, 24 - a) for a in range(1, 13)} | {tuple(sorted((a, b, 24 - a - b))) for a in range(1, 23) for b in range(1, 24 - a)}
    true = np.zeros(len(c))
    true[[3, 40, 60]] = [50, 70, 20]
    counts = np.zeros(25, int)
    for row, n in zip(c, true, strict=True):
        for x in row[row > 0]:
            counts[x] += int(n)
    x = K.nnls(c, counts, 1e-6)
    back = np.zeros(25)
    for row, n in zip(c, x, strict=True):
        for k in row[row > 0]:
            back[k] += n
    assert (x >= 0).all() and np.allclose(back[1:], counts[1:], atol=1e-3)


def test_nnls_is_as_near_as_a_projected_solver():
    r = np.random.default_rng(7)
    c = K.combinations(16)
    a = np.zeros((17, len(c)))
    for j, row in enumerate(c):
        for x in row[row > 0]:
            a[x, j] += 1
    for _ in range(5):
        counts = r.integers(0, 60, 17)
        target = np.r_[0, counts[1:]].astype(float)
        plain, step = np.zeros(len(c)), 1 / np.linalg.norm(a, 2) ** 2
        for _ in range(20_000):
            plain = np.maximum(0, plain - step * (a.T @ (a @ plain - target)))
        got = K.nnls(c, counts, 1e-9)
        assert (got >= 0).all() and ((a @ got - target) ** 2).sum() <= ((a @ plain - target) ** 2).sum() + 1e-3


PROSE = "One plain sentence says that all of this text is clean, and another follows it with different words so nothing repeats within."
CASES = {
    1: None,
    2: "",
    3: "few words only",
    4: f"Home | About | Contact\n{PROSE}\n",
    5: "a b c d e f g h " * 30,
    6: " ".join(f"x{i} | y{i}" for i in range(40)),
    7: f"{PROSE}\nAgain.\nAgain.\nPrivacy policy\n",
    8: "Read more\nHome\nNext\nwordword and so on with a few more words to get over the limit of twenty words in all, surely that is enough\n",
    9: "\n\n \n",
    10: " ".join(f"LOUD{i}!!" for i in range(30)),
    11: " ".join(f"é{i}" for i in range(25)) + "\u00a0\u2003x",
    12: " ".join(f"{i} # $ %" for i in range(9)) + " plain words follow here and there are some of them",
}


CASES |= {
    13: "Copyright law in Europe has a long and complicated history that we shall follow here.\nClick here and there was all that could be heard that day.\nPowered by steam engines of a new kind, the mills ran day and night.\nPrivacy policy is a field of study in its own right.\nTerms of use that nobody reads are the rule.",
    14: f"Copyright 2019 Some Company, all rights reserved.\n© Someone\n(c) 1999 X\nPrivacy policy | Terms of use\nClick here to see more!\nPowered by Some Engine 4.2\nThis site uses cookies to be better.\n{PROSE}",
    15: "One two\nA heading\nthree more words\n" * 9,
    16: f"{PROSE}\n" * 2 + "x " * 3000,
    17: f"“{PROSE}”\n«Fin»\nEt puis…\nwirklich?\n",
}


def test_lines_one_by_one():
    for line in CASES[13].split("\n"):
        assert not Q.line_fails(line), line
    for line in CASES[14].split("\n")[:-1] + ["Copyright 2020", "all rights reserved", "lorem ipsum dolor sit amet", "Two words", "Home | About"]:
        assert Q.line_fails(line), line
    for line in ("Two words.", "It’s “done”", "No end here but a whole line of words", "We use cookies in many of our recipes, such as those for cakes."):
        assert not Q.line_fails(line), line


def test_quality_against_sql_and_loops(spark):
    documents = pd.DataFrame(CASES.items(), columns=["doc_id", "text"])  # noqa: F841
    want = sorted(duckdb.sql(Q.figures_sql()).fetchall())
    df = spark.createDataFrame([(k, t, "k", 1) for k, t in CASES.items()], "doc_id long, text string, kept string, n_words int")
    got = sorted(tuple(r) for r in Q.figures(df).collect())
    assert got == want
    kept = Q.accepted(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in got if r[-1])
    assert {r[0] for r in got if r[-1]} == {4, 7, 8, 11, 13, 17}
    twice = df.where("doc_id < 9").unionByName(df.where("doc_id < 9"))
    assert sorted(tuple(r) for r in Q.figures(twice).collect()) == sorted([r for r in got if r[0] < 9] * 2)
    assert Q.figures(df.limit(0)).count() == 0 and Q.accepted(df.limit(0)).count() == 0


@given(st.lists(st.sampled_from("abc"), max_size=60))
@settings(max_examples=200, deadline=None)
def test_repeated_words_by_definition(words):
    w = Q.WINDOW
    grams = [tuple(words[i : i + w]) for i in range(len(words) - w + 1)]
    on = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(w)}
    assert Q.repeated_words(words) == len(on)
