"""Encoding of a corpus, and of a text that changes (problem 6)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.arrowops import wide_rows
from millrace.llm.prefix_bpe import PrefixEncoder
from millrace.llm.text_encoding import code_points, piece_starts, text_encoder
from millrace.llm.vocabulary import Vocabulary, default_path, vocabulary


def encode_corpus(documents: DataFrame, *, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key and ids, the list of ids of each text, for every row of documents and in one pass without a shuffle.

    Null and empty texts give an empty list. Strings that look like special tokens are ordinary text. Repeated and null
    keys keep their rows; other columns are not read.
    """
    path = path or default_path()
    schema = T.StructType([documents.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(path)
        for b in batches:
            low = 0
            for rows, ids in encoder.encode(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(low, rows), ids], names=[key, "ids"])
                low += rows

    return wide_rows(documents).select(key, F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


@lru_cache(maxsize=2)
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all tokens one after the other, and where each begins."""
    tokens = vocabulary(path).tokens
    return np.frombuffer(b"".join(tokens), np.uint8), np.append(0, np.cumsum([len(t) for t in tokens]))


def decode_corpus(encoded: DataFrame, *, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """key and text, the text of each list of ids: the reverse of encode_corpus (null texts come back empty).

    A null list gives an empty text. Lists that are no encoding may give bytes that are no UTF-8: an error.
    """
    path = path or default_path()
    schema = T.StructType([encoded.schema[key], T.StructField("text", T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, begin = _token_bytes(path)
        for b in batches:
            column = b.column(1)
            token = pc.list_flatten(column).to_numpy(zero_copy_only=False)
            counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            size = begin[token + 1] - begin[token]
            stop = np.cumsum(size)
            text = data[np.repeat(begin[token] - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)]
            offsets = np.append(0, stop)[np.append(0, np.cumsum(counts))]
            out = pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(text))
            out.validate(full=True)
            yield pa.RecordBatch.from_arrays([b.column(0), out.cast(pa.string())], names=[key, "text"])

    return wide_rows(encoded).select(key, ids).mapInArrow(run, schema)


def token_lengths(documents: DataFrame, *, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key and n_tokens, the number of ids of each text; 0 for null and empty ones."""
    path = path or default_path()
    schema = T.StructType([documents.schema[key], T.StructField("n_tokens", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(encoder.lengths(b.column(1)), pa.int64())], names=[key, "n_tokens"])

    return wide_rows(documents).select(key, F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


class EditableText:
    """A text with its ids, kept up to date under appends and edits.

    Holds the last token of every byte prefix of every piece. A change encodes anew from the piece before it, reusing
    the stored prefix of that piece, until the pieces after it begin where they began before.
    """

    #: A piece depends on at most so many characters after its end (an apostrophe's contraction).
    LOOK_AHEAD = 2

    def __init__(self, vocabulary: Vocabulary, text: str = "", encoder: PrefixEncoder | None = None):
        self.encoder = encoder or PrefixEncoder(vocabulary)
        self.text, self.starts, self.last = "", [], []
        self.encoded_bytes = 0
        self.replace(0, 0, text)

    def append(self, text: str) -> None:
        self.replace(len(self.text), len(self.text), text)

    def replace(self, start: int, end: int, text: str) -> None:
        """Put text in the place of self.text[start:end]."""
        if not 0 <= start <= end <= len(self.text):
            raise ValueError("no such part of the text")
        old_starts, old_last, old_text = self.starts, self.last, self.text
        new_text = old_text[:start] + text + old_text[end:]
        ends = old_starts[1:] + [len(old_text)]
        keep = next((i for i, e in enumerate(ends) if e > start - self.LOOK_AHEAD), len(old_starts))
        begin = old_starts[keep] if keep < len(old_starts) else len(old_text) if keep else 0
        shift = len(text) - (end - start)
        at_old = {s + shift: i for i, s in enumerate(old_starts) if s >= end}
        starts, last = old_starts[:keep], old_last[:keep]
        for s, e in self._split(new_text, begin):
            if s >= start + len(text) and (same := at_old.get(s)) is not None:
                starts += [x + shift for x in old_starts[same:]]
                last += old_last[same:]
                break
            data = new_text[s:e].encode("utf-8", "surrogatepass")
            tokens: list[int] = []
            if s == begin and keep < len(old_starts):
                before = old_text[old_starts[keep] : ends[keep]].encode("utf-8", "surrogatepass")
                common = next((i for i, (a, b) in enumerate(zip(before, data)) if a != b), min(len(before), len(data)))
                tokens = old_last[keep][:common]
            self.encoded_bytes += len(data) - len(tokens)
            self.encoder.extend(data, tokens)
            starts.append(s)
            last.append(tokens)
        self.text, self.starts, self.last = new_text, starts, last

    @staticmethod
    def _split(text: str, begin: int, window: int = 256) -> Iterator[tuple[int, int]]:
        """Pieces of text from begin, where one begins, in windows that double until they hold a whole piece."""
        while begin < len(text):
            stop = min(len(text), begin + window)
            _, points = code_points(np.frombuffer(text[begin:stop].encode("utf-8", "surrogatepass"), np.uint8))
            cuts = [begin + int(s) for s in piece_starts(points, np.array([0]))] + [stop]
            pairs = list(zip(cuts[:-1], cuts[1:]))
            if stop < len(text):
                pairs = [(s, e) for s, e in pairs if e + EditableText.LOOK_AHEAD < stop]
                if not pairs:
                    window *= 2
                    continue
            yield from pairs
            begin = pairs[-1][1]

    def ids(self) -> list[int]:
        return [t for last in self.last for t in self.encoder.walk(last)]
