"""Packing of tokenised documents into sequences, by non-negative least squares over shallow length combinations.

Each task packs what it reads, window by window, so nothing is shuffled and no id leaves its task. Whole windows of a
long document become sequences at once. The remaining ends are counted by length class; combinations of two or three
classes that fill a sequence are enumerated, their repeat counts are solved for against the histogram and rounded down,
and what is left is packed greedily, cut where a sequence ends.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import lean

SEQUENCE, END_ID = 2048, 1
#: Width of a length class in tokens, and ends of documents that are packed together.
CLASS, WINDOW = 8, 20_000
#: A long text is encoded in parts of about so many characters.
PART = 1 << 20

#: Characters on which the two tokenizer libraries' patterns surely agree; other texts go to the slower one.
_PLAIN = re.compile("[\\t\\n\\r -~¡-ɏ]*")
_CUT = re.compile("(?<=[^\\t\\n\\r ]) (?=[^\\t\\n\\r ])")


class Encoder:
    """Token ids of texts as the vocabulary file json_path gives them, without special tokens added.

    ranks_path is the same vocabulary in the form of a library that is several times faster; without it all texts go
    through the first. A text is cut only before a single space between two other characters, where no token crosses.
    """

    def __init__(self, json_path: str, ranks_path: str | None) -> None:
        self.json_path, self.fast, self.special = json_path, None, ()
        if ranks_path:
            with open(json_path, encoding="utf-8") as f:
                self.special = tuple(t["content"] for t in json.load(f)["added_tokens"])
            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def slow(self) -> Tokenizer:
        """Made when a text needs it, as it takes much memory."""
        return Tokenizer.from_file(self.json_path)

    def ids(self, text: str | None) -> np.ndarray:
        text = text or ""
        if self.fast is None or not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        parts, at = [], 0
        while len(text) - at > PART and (cut := _CUT.search(text, at + PART)):
            parts.append(text[at : cut.start()])
            at = cut.start()
        parts.append(text[at:])
        return np.concatenate([np.array(self.fast.encode_ordinary(p), np.uint32) for p in parts])


@lru_cache(1)
def combinations(units: int) -> np.ndarray:
    """Rows of three classes, the last or last two 0 if unused, that add up to units; classes descend."""
    pairs = [(a, units - a, 0) for a in range((units + 1) // 2, units)]
    threes = [(a, b, units - a - b) for a in range(1, units - 1) for b in range(max(1, (units - a + 1) // 2), min(a, units - a - 1) + 1)]
    return np.array([(units, 0, 0), *pairs, *threes], np.int64)


def nnls(combos: np.ndarray, counts: np.ndarray, tolerance: float = 1.0) -> np.ndarray:
    """Repeat counts x >= 0 of combos that minimise the squares of A x - counts, where A counts classes in combos.

    Lawson and Hanson's active sets, on normal equations, until no combination would explain more than tolerance further pieces;
    counts[0] is not used. Few of the combinations get values above zero, so that rounding loses little.
    """
    n, target = len(counts), counts.astype(float)
    target[0] = 0
    x, on = np.zeros(len(combos)), []
    a = np.zeros((n, 0))
    residual = target.copy()
    live = np.ones(len(combos), bool)
    for _ in range(3 * n):
        gain = (residual[combos] * (combos > 0)).sum(1)
        gain[on] = -1
        gain[~live] = -1
        j = int(gain.argmax())
        if gain[j] <= tolerance:
            break
        column = np.bincount(combos[j], minlength=n).astype(float)
        column[0] = 0
        on.append(j)
        a = np.column_stack([a, column])
        while True:
            gram = a.T @ a
            gram[np.diag_indices_from(gram)] += 1e-9
            s = np.linalg.solve(gram, a.T @ target)
            if s.min() > 1e-9:
                break
            bad = s <= 1e-9
            old = x[on]
            if (old[bad] <= 1e-12).all() and bad[-1]:
                live[j] = False
            step = np.min(old[bad] / np.maximum(old[bad] - s[bad], 1e-12))
            moved = old + step * (s - old)
            keep = (moved > 1e-9) & ~(bad & (old <= 1e-12))
            x[on] = np.where(keep, moved, 0)
            on = [c for c, k in zip(on, keep, strict=True) if k]
            a = a[:, keep]
            if not on:
                s = np.zeros(0)
                break
        x[on] = s
        residual = target - a @ s if on else target.copy()
    return x


class Packer:
    """Collects pieces (row, start, ids, tokens of the document) and gives out placed ones, with sequence and offset."""

    def __init__(self, first_sequence: int) -> None:
        self.next, self.ends = first_sequence, []

    def add(self, row: object, ids: np.ndarray) -> Iterator[tuple]:
        full = len(ids) // SEQUENCE * SEQUENCE
        for at in range(0, full, SEQUENCE):
            yield self._place([(row, at, ids[at : at + SEQUENCE], len(ids))])
        if full < len(ids):
            self.ends.append((row, full, ids[full:], len(ids)))

    def _place(self, pieces: list[tuple]) -> list[tuple]:
        offset, out = 0, []
        for row, start, ids, total in pieces:
            out.append((row, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, offset))
            offset += len(ids)
        self.next += 1
        return out

    def flush(self, last: bool) -> Iterator[list[tuple]]:
        """Sequences of what is held. Unless it is the last time, what doesn't fill a sequence is held on."""
        classes: list[list[tuple]] = [[] for _ in range(SEQUENCE // CLASS + 1)]
        for piece in sorted(self.ends, key=lambda p: len(p[2])):
            classes[-(-len(piece[2]) // CLASS)].append(piece)
        combos = combinations(SEQUENCE // CLASS)
        there = np.array([len(c) for c in classes])
        usable = combos[(((there[combos] > 0) | (combos == 0)).all(1))]
        if len(usable):
            repeats = np.floor(nnls(usable, there) + 1e-6).astype(np.int64)
            for j in np.argsort(-repeats, kind="stable"):
                members = [c for c in usable[j] if c]
                for _ in range(repeats[j]):
                    if any(len(classes[c]) < members.count(c) for c in members):
                        break
                    yield self._place([classes[c].pop() for c in members])
        left = [p for c in reversed(classes) for p in reversed(c)]
        total, held, space = sum(len(p[2]) for p in left), [], SEQUENCE
        while left and (last or total >= SEQUENCE or held):
            row, start, ids, tokens = left.pop(0) if len(left[0][2]) <= space or len(left) == 1 else left.pop()
            cut = min(space, len(ids))
            held.append((row, start, ids[:cut], tokens))
            if cut < len(ids):
                left.insert(0, (row, start + cut, ids[cut:], tokens))
            total, space = total - cut, space - cut
            if not space:
                yield self._place(held)
                held, space = [], SEQUENCE
        if held:
            yield self._place(held)
        self.ends = left


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece of a document.

    A document's ids are its text's, then END_ID; a null or empty text has that id alone. Every id is in one piece. A sequence is full, or shorter by less than
    three classes' width, or the last one of a task. sequence_id is unique, and tells the task apart in its upper bits. Repeated rows
    are packed as often as they occur; a null id is carried on; other columns are not read. Both paths default to the installed
    byte-level vocabulary, ranks_path only together with json_path.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def batch(kind_of: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], kind_of), *(pa.array(c, pa.int64()) for c in cols[1:])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if json_path is None:
            encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
        else:
            encoder = Encoder(json_path, ranks_path)
        packer, done, id_type = Packer(TaskContext.get().partitionId() << 40), [], None
        for b in batches:
            id_type = b.column(0).type
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for placed in packer.add(key, np.append(encoder.ids(text.as_py()), np.uint32(END_ID))):
                    done += placed
                if len(packer.ends) >= WINDOW:
                    for placed in packer.flush(last=False):
                        done += placed
                if len(done) >= 10_000:
                    yield batch(id_type, done)
                    done = []
        for placed in packer.flush(last=True):
            done += placed
        if done:
            yield batch(id_type, done)

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), schema)
