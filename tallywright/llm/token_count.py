"""Token counts by a tokenizer that is compiled to deterministic transducers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import at_spaces, by_size, texts_of
from .transducer import transducer

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, path: str, *, limit: int = 2048, slice_chars: int = 2_000_000) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens) of every text.

    Counts are those of the tokenizer's library without added special tokens; special strings inside a
    text count as one token each. A null text is empty: 0 bytes, 0 tokens. A null ``doc_id`` stays null,
    repeated rows are counted each, other columns are not read. Texts longer than ``slice_chars`` are
    read in slices cut behind spaces, where no token crosses.
    """

    def count(batches):
        machine = transducer(path)
        for batch in batches:
            texts = texts_of(batch)
            sizes = [len(t.encode("utf-8", "replace")) for t in texts]
            tokens = []
            for a, b in by_size(texts, slice_chars):
                parts = [at_spaces(t, slice_chars) for t in texts[a:b]]
                if all(len(p) == 1 for p in parts):
                    tokens += machine.encode(texts[a:b])[0].tolist()
                else:
                    tokens += [sum(int(machine.encode([s])[0][0]) for s in p) for p in parts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, SCHEMA)
