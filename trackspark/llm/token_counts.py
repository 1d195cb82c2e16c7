"""Token counts of whole texts.

Texts are batched by bytes and split at safe boundaries: at ASCII white space the normaliser, the pre-tokenizer and the
model start afresh, so a text's count is the sum over its blank-separated words, however long the text is. The
distinct words of a batch that the worker does not know yet are encoded in one library call, of which only the lengths
are kept.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .batches import loaded, map_arrow
from .bpe import VOCABULARY, Kept, Pretokenizer, byte_slices, extended, read_file, with_columns
from .registry import query, table


class Counter(Pretokenizer):
    """Counts for a tokenizer file whose pre-tokenizer drops white space, so that words are independent."""

    def build(self, library, bare, suffix: str, vocabulary: dict[str, int]) -> None:
        self.model = bare(suffix)
        self.piece_counts, self.word_counts = Kept(self.measure), Kept(self.learn)

    def measure(self, pieces: list[str]) -> dict[str, int]:
        return {p: len(e) for p, e in zip(pieces, self.model.encode_batch_fast(pieces, add_special_tokens=False), strict=True)}

    def learn(self, words: list[bytes]) -> dict[bytes, int]:
        split = [self.pieces(w) for w in words]
        counts = self.piece_counts.values([[p for p in ps if isinstance(p, str)] for ps in split])
        return {w: sum([counts[p] if isinstance(p, str) else 1 for p in ps]) for w, ps in zip(words, split, strict=True)}

    def count(self, texts: list[bytes]) -> list[int]:
        split = [t.split() for t in texts]
        get = self.word_counts.values(split).__getitem__
        return [sum(map(get, ws)) for ws in split]


def count_tokens(df: DataFrame, tokenizer: str = VOCABULARY, text: str = "text", count: str = "n_tokens") -> DataFrame:
    """Add the number of tokens of every whole text.

    Null and empty texts count 0. Rows are independent; extra columns pass through, one named like the result is replaced.
    """
    schema = extended(df, (count, LongType()))
    shipped = df.sparkSession.sparkContext.broadcast(read_file(tokenizer))

    def run(batches):
        counter = loaded(Counter, shipped.value)
        for batch in batches:
            for first, last, texts in byte_slices(batch.column(batch.schema.get_field_index(text))):
                yield with_columns(batch.slice(first, last - first), schema, **{count: pa.array(counter.count(texts), pa.int64())})

    return map_arrow(df, run, schema, models=True)


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes and tokens of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    counted = count_tokens(docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))
