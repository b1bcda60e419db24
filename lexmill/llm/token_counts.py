"""Token counts by a published tokenizer, as batch encoding in Arrow functions that return lengths only.

Texts are cut into pieces at safe boundaries, one space between two characters that aren't white space, where
byte-level pre-tokenisation always starts a new word, so the pieces' counts add up to the text's. Pieces are
gathered into batches of at most `batch_bytes` bytes of UTF-8, whatever the number of texts, and only the length of
each encoding is kept. (A piece that is larger on its own, as a text without a boundary, is a batch by itself.)

Cases: a null text counts as empty and has no tokens; repeated rows are returned one by one; an empty table
gives an empty result; texts without a safe boundary are encoded whole; other columns are not read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import pick
from lexmill.session import table

LIMIT = 1024
PIECE_CHARS = 16_384
BATCH_BYTES = 1 << 20

_BOUNDARY = re.compile(r"(?<=\S) (?=\S)")
_LOADED: dict[str, object] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _tokenizer(path: str):
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the cores belong to Spark's tasks
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _LOADED[path] = tokenizer
    return _LOADED[path]


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Parts of the text in order; each but the last has at least size characters and ends at a safe boundary."""
    start = 0
    while len(text) - start > size:
        cut = _BOUNDARY.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def _lengths(path: str, batch_bytes: int, piece_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            texts = batch.column("text")
            counts = [0] * len(texts)
            held, owners, weight = [], [], 0

            def flush() -> None:
                for owner, encoding in zip(owners, tokenizer.encode_batch_fast(held, add_special_tokens=False), strict=True):
                    counts[owner] += len(encoding)
                held.clear()
                owners.clear()

            for row, value in enumerate(texts):
                text = value.as_py()  # one at a time: only what is held for a batch is in memory twice
                if not text:
                    continue
                for piece in pieces(text, piece_chars):
                    size = len(piece) if piece.isascii() else len(piece.encode("utf-8", "surrogatepass"))
                    if held and weight + size > batch_bytes:
                        flush()
                        weight = 0
                    held.append(piece)
                    owners.append(row)
                    weight += size
            if held:
                flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"]
            )

    return run


def token_counts(
    docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, batch_bytes: int = BATCH_BYTES, piece_chars: int = PIECE_CHARS
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per document. tokenizer: the path of a tokenizers JSON
    file that every executor has."""
    docs = pick(docs, doc_id="doc_id", text="text")
    kind = dict(docs.dtypes)["doc_id"]
    sized = docs.select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    counted = sized.mapInArrow(_lengths(tokenizer or default_tokenizer(), batch_bytes, piece_chars), f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
