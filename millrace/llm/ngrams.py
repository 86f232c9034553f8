"""Pairs of neighbouring tokens as rows, and what models of them share.

Tokens are lower-cased words and one end, which is a token too; the first word follows a start. Words are 64-bit hashes. A text's pairs are counted
before they leave the task, so no pair, however common, has more rows than there are texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.text import WordHashes, split_words

START, END = np.uint64(1), np.uint64(2)


def pairs(docs: DataFrame) -> DataFrame:
    """(key, ctx, word, n) from docs(key, text): each distinct pair of a text and how often it occurs there."""

    def each(batches):
        hashes = WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                keys, ctx, word, count = [], [], [], []
                for key, text in zip(part.column("key").to_pylist(), part.column("text").to_pylist()):
                    w = np.concatenate([[START], hashes.of(split_words(text)), [END]]).astype(np.uint64)
                    order = np.lexsort((w[1:], w[:-1]))
                    a, b = w[:-1][order], w[1:][order]
                    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
                    ctx.append(a[new])
                    word.append(b[new])
                    count.append(np.diff(np.append(new, len(a))))
                    keys.append(np.full(len(new), key, dtype=np.int64))
                if keys:
                    arrays = [np.concatenate(keys), np.concatenate(ctx).view(np.int64), np.concatenate(word).view(np.int64), np.concatenate(count).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["key", "ctx", "word", "n"])

    return docs.select("key", "text").mapInArrow(each, "key bigint, ctx bigint, word bigint, n int")
