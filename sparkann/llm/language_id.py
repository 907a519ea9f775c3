"""Language identification by compression: the language whose dictionary makes a text smallest.

Each language has a zstandard raw-content dictionary made from a bounded sample of labelled texts. A text, lower-cased and
without digits and symbols, is cut into pieces of PIECE bytes, so that every part of a long text is held against the dictionaries, and
the compressed sizes are added up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import crc_mod, lean

#: Bounds of the fit, a language: bytes of dictionary, sampled texts, and characters of each that enter it, from a hashed place. So many slices
#: are what a dictionary holds.
DICT_BYTES, SAMPLE_ROWS, SLICE = 64 << 10, 256, 256
#: Bytes of a piece of text; zstandard's level.
PIECE, LEVEL = 4 << 10, 6
#: A prediction is rejected if the second language's size exceeds the best one's by less than this share.
MARGIN = 0.005
UNDETERMINED = "und"

_NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Number signs are word characters, but neither letters nor digits: those of the first plane, and the others.
_SIGNS = [re.compile(f"[{''.join(c for c in map(chr, part) if c.isnumeric() and not c.isalpha())}]+") for part in (range(1 << 16), range(1 << 16, 0x110000))]


def normalise(text: str | None) -> bytes:
    """Words of letters only, lower-case, with single spaces; empty for null or a text without letters."""
    words = _NOT_LETTERS.sub(" ", (text or "").lower())
    if not words.isascii():
        for signs in _SIGNS[: 1 + (max(words) > "\uffff")]:
            if signs.search(words):
                words = " ".join(signs.sub(" ", words).split())
    return words.strip().encode()


class Model(NamedTuple):
    """Dictionaries by language, and the languages' shares of all labelled rows."""

    dictionaries: dict[str, bytes]
    shares: dict[str, float]


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """The model of rows with a label and a text; without any, it has no language.

    The sample of a language are its SAMPLE_ROWS distinct texts of least hash, at most; the driver gets SLICE characters of
    each, from a place that is hashed too. All of them stand in the dictionary, unless their letters take more than DICT_BYTES. Only texts with hashes
    under a bound, which some four times as many are expected to have, are ranked, so that a language's rows never meet. The model's size is
    bounded by the number of languages times DICT_BYTES.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    place = F.pmod(F.xxhash64(text_col, F.lit(1)), F.greatest(F.lit(1), F.length(text_col) - SLICE + 1)) + 1
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text_col).alias("h"), F.substr(F.col(text_col), place.cast("int"), F.lit(SLICE)).alias("slice"))
    known = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("texts")).collect()
    bounds = [(r.lang, min((1 << 63) - 1, -(1 << 63) + (1 << 64) * 4 * SAMPLE_ROWS // max(1, r.texts))) for r in known]
    few = F.broadcast(labelled.sparkSession.createDataFrame(bounds, "lang string, bound long"))
    low = rows.join(few, "lang").where("h <= bound").groupBy("lang", "h").agg(F.min("slice").alias("slice"))
    ranked = low.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= SAMPLE_ROWS)
    slices: dict[str, list[bytes]] = {}
    for r in sorted(ranked.collect(), key=lambda r: (r.lang, r.k)):
        if piece := normalise(r.slice):
            slices.setdefault(r.lang, []).append(piece)
    counts = {r.lang: r.n for r in known if r.lang in slices}
    return Model({lang: b" ".join(dict.fromkeys(pieces))[:DICT_BYTES] for lang, pieces in slices.items()}, {lang: n / sum(counts.values()) for lang, n in counts.items()})


class Classifier:
    """A model, ready for compression. Of languages with equal sizes the one with more labelled rows is taken, then the first by name."""

    def __init__(self, model: Model) -> None:
        self.langs = sorted(model.dictionaries, key=lambda x: (-model.shares[x], x))
        self.packs = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(model.dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.packs.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

    def sizes(self, data: bytes) -> np.ndarray:
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        return np.array([sum(len(p(x)) for x in pieces) for p in self.packs], float)

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin. The score is the share of the best language in 2 ** -(bits a byte, times 8); the
        margin is how much larger the second language's size is, as a share of the best one's."""
        data = normalise(text)
        if not data or not self.langs:
            return UNDETERMINED, 0.0, 0.0
        size = self.sizes(data)
        best = int(size.argmin())
        weight = np.exp2(-64.0 * (size - size[best]) / len(data))
        rest = np.delete(size, best)
        return self.langs[best], float(1 / weight.sum()), float((rest.min() - size[best]) / size[best]) if len(rest) else 1.0


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score, margin, rejected, and the columns in keep: one row for each row of docs.

    lang_pred is 'und', with score and margin 0, for a null text and one without a letter. rejected is true for those and for margins
    below MARGIN. A very long text is worked on piece by piece. Repeated rows are repeated; other columns are not read.
    """
    seen = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).alias("text"))
    names = [*seen.columns[:-1], "lang_pred", "score", "margin"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Classifier(shared.value)
        for b in batches:
            out = [judge.predict(t.as_py()) for t in b.column(b.num_columns - 1)]
            lang, score, margin = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64())], names)

    schema = StructType([*seen.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("margin", DoubleType())])
    return seen.mapInArrow(lean(run), schema).withColumn("rejected", (F.col("lang_pred") == UNDETERMINED) | (F.col("margin") < MARGIN))


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose language is told with a margin of MARGIN at least."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def keeps(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        judge = Classifier(shared.value)
        for b in batches:
            found = [judge.predict(t) for t in b]
            yield pd.Series([f[0] != UNDETERMINED and f[2] >= MARGIN for f in found], dtype=bool)

    return docs.where(keeps(F.col(text_col)))


def held_out(key: str) -> Column:
    """Rows that a fit must not see: crc32 of the key as text is 2 modulo 4; a null key counts as held out."""
    return F.coalesce(crc_mod(F.col(key), 4) == 2, F.lit(True))
