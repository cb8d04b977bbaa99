"""SentencePiece encoding and decoding through a table of distinct marked words.

Where no piece of the vocabulary continues across a white-space marker, a text falls into words
that each begin with their markers, and a word is segmented alike wherever it stands. A task keeps
a table of the distinct words that it has met: texts become positions in the table, each word new to
it is segmented once, and the positions read the ids off.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

MARKER = "▁"
#: Texts that a task holds at a time.
TEXTS_AT_A_TIME = 256
#: Words of a table; a full one is dropped before the next texts, which bounds memory only.
TABLE_WORDS = 1 << 18

_WORDS = re.compile(" +[^ ]*")


def load(path: str) -> sentencepiece.SentencePieceProcessor:
    """The model, if it fits the method: its pieces stay inside marked words, and spaces are kept as they are."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    if any(MARKER in p.lstrip(MARKER) for p in pieces):
        raise ValueError("a piece continues across a white-space marker")
    probe = "a  b\tc　é \n"
    if sp.normalize(probe) != MARKER + probe.replace(" ", MARKER):
        raise ValueError("only models with a dummy prefix, without normalisation and white-space removal")
    return sp


def words_of(text: str) -> list[str]:
    """The marked words of a text, the prefix marker included; a marker is written as a space."""
    return _WORDS.findall(" " + text.replace(MARKER, " ")) if text else []


def _encode(file: str, before: bytes, after: bytes):
    """Ids of each text: those of its words, in the order of their positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = sentencepiece.SentencePieceProcessor(model_file=SparkFiles.get(file))
        place, pieces = defaultdict(count().__next__), []  # position of each word, and its ids
        for b in _slices(batches):
            if len(place) > TABLE_WORDS:
                place, pieces = defaultdict(count().__next__), []
            positions = [list(map(place.__getitem__, words_of(t or ""))) for t in b.column(1).to_pylist()]
            pieces += _segment(sp, list(islice(place, len(pieces), None)))
            out = [before + b"".join(map(pieces.__getitem__, at)) + after for at in positions]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["id", "ids"])

    return run


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(at, TEXTS_AT_A_TIME) for b in batches for at in range(0, b.num_rows, TEXTS_AT_A_TIME))


def _segment(sp: sentencepiece.SentencePieceProcessor, words: list[str]) -> list[bytes]:
    """Ids of each marked word. The library puts the first marker in front itself, but not before an empty text."""
    found = sp.encode([w[1:] for w in words], num_threads=1)
    lone = [sp.piece_to_id(MARKER)]
    return [np.array(ids if w != " " else lone, "<u4").tobytes() for w, ids in zip(words, found, strict=True)]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", begin: bool = True, end: bool = True) -> DataFrame:
    """``doc_id, ids`` for every row: the ids of the whole text as packed little-endian unsigned 32-bit integers.

    They equal the library's for the same model, without sampling. Null and empty texts have the
    begin and end ids only. Repeated and null document ids stay rows; other columns are ignored; an
    empty table gives no rows. ``unpack`` turns the ids into an array. One pass without a shuffle;
    a task holds ``TEXTS_AT_A_TIME`` texts and a table of about ``TABLE_WORDS`` words.
    """
    sp = load(model_path)
    docs.sparkSession.sparkContext.addFile(model_path)
    special = [np.array([i] if on else [], "<u4").tobytes() for i, on in ((sp.bos_id(), begin), (sp.eos_id(), end))]
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_encode(model_path.rsplit("/", 1)[-1], *special), "id bigint, ids binary")
    return out.withColumnRenamed("id", id_col)


def _decode(file: str):
    """The rows with the text of their last column, packed ids, in its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = sentencepiece.SentencePieceProcessor(model_file=SparkFiles.get(file))
        surface, control, marked = [], set(), set()
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_control(i):
                control.add(i)
                surface.append(b"")
            elif sp.is_byte(i):
                surface.append(bytes([int(piece[1:-1], 16)]))
            elif sp.is_unknown(i):
                surface.append(sp.decode([i]).encode())
            else:
                surface.append(piece.replace(MARKER, " ").encode())
                if piece[0] == MARKER:
                    marked.add(i)
        for b in _slices(batches):
            texts = []
            for packed in b.column(b.num_columns - 1).to_pylist():
                ids = np.frombuffer(packed or b"", "<u4").tolist()
                try:
                    text = b"".join(map(surface.__getitem__, ids)).decode()
                except UnicodeDecodeError:  # byte pieces that are no character, which encode() never gives
                    texts.append(sp.decode(ids))
                    continue
                first = next((i for i in ids if i not in control), None)
                texts.append(text[1:] if first in marked else text)  # without the prefix marker
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*b.schema.names[:-1], "decoded"])

    return run


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with one more column ``decoded``, whose name it must not have yet: the text that the packed ids of ``ids_col`` stand for (null: empty).

    Markers become spaces, byte pieces are put together to characters, the prefix marker and
    control ids go. A map without a shuffle.
    """
    spark = encoded.sparkSession
    spark.sparkContext.addFile(model_path)
    columns = [F.col(f"`{c}`") for c in encoded.columns]
    rows = encoded.select(*columns, F.col(ids_col).alias("decoded"))
    schema = StructType([*encoded.schema.fields, StructField("decoded", StringType())])
    return rows.mapInArrow(_decode(model_path.rsplit("/", 1)[-1]), schema)


def unpack(ids: Column) -> Column:
    """Packed ids as an array of integers."""
    hexed = F.regexp_extract_all(F.hex(ids), F.lit("(.{8})"), F.lit(1))
    number = lambda w: F.conv(F.concat(*[F.substring(w, at, 2) for at in (7, 5, 3, 1)]), 16, 10)
    return F.transform(hexed, lambda w: number(w).cast("bigint"))
