"""Registered query: SentencePiece encoding and decoding (op12)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from spendgrid.llm.sentencepieces import decode, encode
from spendgrid.session import read_table

#: Fixed by the task: the model file.
PIECES = "piece_bpe_32k.model"


def op12_sentencepiece(spark, sf_dir):
    path = public_tokenizers.path(PIECES)
    out = decode(encode(read_table(spark, sf_dir, "documents"), path), path)
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


QUERIES = {"op12_sentencepiece": op12_sentencepiece}
SQL = {}
