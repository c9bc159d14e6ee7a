"""Sizes in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of the public vocabulary files, and the file used unless another is named.
FOLDER = os.environ.get("ZONESPARK_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: how the byte-level BPE vocabularies part a text into words.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("zonespark", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str) -> int:
    """Tokens of a text; special tokens' strings are ordinary text."""
    return len(_encoder(path).encode_ordinary(text)) if text else 0


def token_counts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str = VOCABULARY, folder: str = FOLDER) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``n_tokens`` of column ``text``; null and empty texts have none."""
    path = f"{folder}/{vocabulary}"
    rows = docs.select(*keep, F.col(text).alias("_text"))
    schema = rows.drop("_text").schema.add("n_tokens", T.IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            counts = [len(encoder.encode_ordinary(t)) if t else 0 for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int32())], [*keep, "n_tokens"])

    return rows.mapInArrow(run, schema)
