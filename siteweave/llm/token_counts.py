"""Token counts by the whole-token shortcut."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import byte_bpe, sentence_pieces
from .common import appended, batches, prepare, texts, utf8, with_schema


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = 512) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    For a byte-level .json vocabulary, the vocabulary strings that encode alone as one token are
    proved on the driver, by encoding each, and sent out; a text's pre-tokens found among them count one, and only the
    rest are merged by the library. Any other .json or .model file is counted by its library.
    tokenizer is a path that exists on the driver and on every executor. A map over whole texts: nothing is shuffled.

    Null texts count as empty: 0 bytes, 0 tokens. Columns of the result's names are replaced; rows
    repeat as they do in docs; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    # One short string for each token of the vocabulary at most.
    proved = None if tokenizer.endswith(".model") else docs.sparkSession.sparkContext.broadcast(byte_bpe(tokenizer).alone())

    def counted(items):
        if proved is None:
            pieces = sentence_pieces(tokenizer)
            many = lambda xs: [len(x) for x in pieces.encode(xs, num_threads=1)]
        else:
            one = byte_bpe(tokenizer).assume(proved.value).count
            many = lambda xs: [one(x) for x in xs]
        for batch in batches(items):
            column = batch.column(text)
            n = many(texts(column))
            yield appended(batch, {
                "n_bytes": pa.array([len(x) for x in utf8(column)], pa.int64()),
                "n_tokens": pa.array(n, pa.int64()),
                "over_limit": pa.array([x > limit for x in n], pa.bool_()),
            })

    return docs.mapInArrow(counted, with_schema(docs, {"n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}))
