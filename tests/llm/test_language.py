import re
import zlib

import pytest
import zstandard

from sparkann.llm import language_id as L

DATA = "/root/testdata/sf0.01"
EDGES = [(1, None), (2, ""), (3, "123 !!! 456"), (4, "été"), (None, "the house is over the hill"), (5, "x" * 300_000), (5, "x" * 300_000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return L.fit(docs.where(~L.held_out("doc_id")))


def test_held_out_accuracy(docs, model):
    got = L.classify(docs.where(L.held_out("doc_id")), model, keep=("lang",)).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got)
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.98
    assert sum(r.rejected for r in got) / len(got) < 0.02


def test_model_is_bounded_and_the_same_again(docs, model):
    assert set(model.dictionaries) == {"en", "fr", "de", "es"} and all(len(d) <= L.DICT_BYTES for d in model.dictionaries.values())
    assert L.fit(docs.repartition(3).where(~L.held_out("doc_id"))) == model


def plain_sizes(model, text):
    """Compressed sizes by language, with a compressor of its own for every piece."""
    data = " ".join(re.findall(r"[^\W\d_]+", text.lower())).encode()
    out = {}
    for lang, d in model.dictionaries.items():
        words = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(level=L.LEVEL)
        made = [zstandard.ZstdCompressor(level=L.LEVEL, dict_data=words, write_content_size=False, write_dict_id=False).compress(data[i : i + L.PIECE]) for i in range(0, len(data), L.PIECE)]
        whole = b"".join(zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)).decompressobj().decompress(x) for x in made)
        assert whole == data
        out[lang] = sum(map(len, made))
    return out


def test_predictions_are_the_smallest_sum(docs, model):
    judge = L.Classifier(model)
    for r in docs.limit(20).collect():
        sizes = plain_sizes(model, r.text)
        lang, score, margin = judge.predict(r.text)
        assert sizes[lang] == min(sizes.values()) and 0 <= score <= 1
        assert margin == (sorted(sizes.values())[1] - sizes[lang]) / sizes[lang]


def test_edge_cases(spark, docs, model):
    df = spark.createDataFrame([(i, t, "zz", 0.5) for i, t in EDGES], "doc_id long, text string, lang string, score double")
    got = {(r.doc_id, i): r for i, r in enumerate(L.classify(df, model).collect())}
    rows = list(got.values())
    assert [r.lang_pred for r in rows if r.doc_id in (1, 2, 3)] == ["und"] * 3
    assert all(r.rejected and r.score == 0 for r in rows if r.lang_pred == "und")
    assert len(rows) == len(EDGES) and len({(r.lang_pred, r.score) for r in rows if r.doc_id == 5}) == 1
    kept = L.accepted(df, model)
    assert kept.columns == df.columns and kept.where("doc_id in (1, 2, 3)").count() == 0
    assert L.classify(df.limit(0), model).count() == 0
    signs = spark.createDataFrame([(1, "½ ² ③ \U0001d7d8 \u2163"), (2, "½ the house ③ is"), (3, "the house is")], "doc_id long, text string")
    by_id = {r.doc_id: r for r in L.classify(signs, model).collect()}
    assert by_id[1].lang_pred == "und" and by_id[2].lang_pred == by_id[3].lang_pred != "und" and by_id[2].score == by_id[3].score
    nothing = L.fit(df.where("lang is null"))
    assert {r.lang_pred for r in L.classify(df, nothing).collect()} == {"und"}
