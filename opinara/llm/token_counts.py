"""Token counts with a whole-token shortcut.

Most pre-tokens of a text are vocabulary strings that encode alone as one token. Which
are is proven once, offline, by encoding every vocabulary string. Pre-tokens among them
count one; only the rest are merged by the library, once per worker and distinct string.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.batches import map_slices
from opinara.llm.tokenizing import Encoder, PieceTable, byte_letters, library, word_pieces

END = "</w>"  # suffix of vocabulary strings that end a word


def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings, as the model sees them, that encode alone as one token."""
    tokenizer = library(path)
    words = [v.removesuffix(END) for v in tokenizer.get_vocab(with_added_tokens=False) if v.endswith(END)]
    return frozenset(w for w in words if w and len(tokenizer.model.tokenize(w)) == 1)


class Counter(Encoder):
    """Numbers of tokens of whole texts by a lower-casing word encoder."""

    cuts = staticmethod(word_pieces)
    lower = True

    def __init__(self, path: str, proven: frozenset[str]):
        super().__init__(path)
        self.table = PieceTable(np.int64)
        self.proven = proven

    def whole(self, text: bytes) -> list[int]:
        return [len(super(Counter, self).whole(text))]

    def piece(self, piece: bytes) -> list[int]:
        shown = piece.decode().lower().encode().decode("latin-1").translate(byte_letters())
        return [1 if shown in self.proven else len(self.model.tokenize(shown))]


_counters: dict[str, Counter] = {}


def count_tokens(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 2048
) -> DataFrame:
    """Bytes and tokens of every text, one row per input row.

    A null or empty text has 0 of both. Repeated rows give repeated results; a null key
    stays null. Special strings inside a text count as the library counts them. Only
    the two named columns are read.
    """
    proven = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter = _counters.get(path)
        if counter is None:
            counter = _counters[path] = Counter(path, proven.value)
        values, at = counter.batch(batch.column(1))
        totals = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), sizes.cast(pa.int64()), pa.array(totals[at[1:]] - totals[at[:-1]])],
            names=[key, "n_bytes", "n_tokens"],
        )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key), F.col(text).alias("text"))
    counted = map_slices(rows, count, f"`{key}` {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
