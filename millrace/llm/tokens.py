"""Token counts: each distinct pre-token is encoded once, and documents sum its pieces by frequency.

A text is cut before every space that a visible character follows. No pattern of the byte-level pre-tokenizer
matches across such a place (a space joins what follows; a white-space run gives up its last character before a
visible one), so the parts' counts add up to the text's. The distinct parts of a batch meet the documents'
part frequencies inside the task: shuffling those would move more bytes than the texts themselves (README).
Ids are never kept, only how many there are.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator
from operator import mul

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, small_batches, table

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
#: Parts remembered by a worker; beyond that it starts anew. Longer parts are not remembered.
REMEMBERED, LONG_PART = 400_000, 48
CUT = re.compile(r" (?=\S)")
UNEVEN = re.compile(r" (?!\S)")


def parts(text: str) -> list[str]:
    """The text's pre-token parts, all but the first without the space that they begin with."""
    return CUT.split(text) if UNEVEN.search(text) else text.split(" ")


class Pieces:
    """How many pieces a pre-token has."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}

    def encoded(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        first, rest = [], []
        for t in texts:
            own = parts(t)
            first.append(own[0])
            rest.append(Counter(own[1:]))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [p for p in set().union(*rest) if p not in self.known]
        self.known.update(zip(new, self.encoded([" " + p for p in new]), strict=True))
        out = [n + sum(map(mul, freq.values(), map(self.known.__getitem__, freq))) for n, freq in zip(self.encoded(first), rest, strict=True)]
        for p in new:
            if len(p) > LONG_PART:
                del self.known[p]
        return out


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row's whole text.

    path: a tokenizer file that every executor has, by default the installed byte-level vocabulary. A null text
    counts as empty; repeated rows count each; special strings inside texts are single tokens, as by default.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Pieces(path or vocabulary_path())
        for part in pieces(batches):
            texts = [t or "" for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(known.counts(texts), pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64())], ["doc_id", "n_tokens", "n_bytes"])

    small_batches(docs.sparkSession)
    plain = docs.select("doc_id", "text")
    n = plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, n_bytes bigint")
    return n.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document by the 50k byte-level vocabulary."""
    return count(table(spark, sf_dir, "documents"))
