"""Token ids and counts of whole texts, exactly as the tokenizer library gives them.

Encoding dominates, so two things are reused. Within a worker, the ids of each blank-separated word are kept in a
bounded table: the byte-level vocabularies never let a token reach over a blank that stands between two
other characters, so the ids of a text are the ids of its words in a row. Texts where a blank touches other
white space go to the library whole. Between runs, a table of digests keeps counts: only contents that no
run has counted are encoded.
"""

from __future__ import annotations

import array
import base64
import hashlib
import os
import sys
import uuid
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlq.llm.common import hot_join, only, stored
from crawlq.runtime import scratch_folder

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LIMIT = 512
#: Words a worker remembers; the table is emptied when full, which changes the speed only.
WORDS_KEPT = 300_000
LONGEST_KEPT = 64
#: Characters below this have had the same classes in every Unicode version the libraries may carry.
PLAIN = "\u0250"
#: White space in old Unicode versions only.
MONGOLIAN = "\u180e"
if sys.byteorder != "little" or array.array("I").itemsize != 4:
    raise RuntimeError("ids are packed as little-endian 32-bit numbers")


class _Whole(Exception):
    """This text must be encoded whole."""


class _Words(dict):
    """word -> its ids as little-endian unsigned 32-bit numbers; `lead` is what stands before each word."""

    def __init__(self, encode, lead: str):
        super().__init__()
        self.encode, self.lead = encode, lead

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace() or word[0] == MONGOLIAN or word[-1] == MONGOLIAN:
            raise _Whole
        ids = self.encode(self.lead + word)
        if len(word) <= LONGEST_KEPT:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = ids
        return ids


def _ranks(vocabulary: str):
    """The rank file beside a byte-level vocabulary, about four times as fast word by word; none without that file."""
    import tiktoken

    file = os.path.splitext(vocabulary)[0] + ".tiktoken"
    if not os.path.exists(file):
        return None
    with open(file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids of texts as packed bytes, four per token."""

    def __init__(self, vocabulary: str = VOCABULARY):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.ranks = _ranks(vocabulary)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.first, self.rest = _Words(self.word, ""), _Words(self.word, " ")

    def whole(self, text: str) -> bytes:
        return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, text: str) -> bytes:
        """The same ids, from the rank file of the same vocabulary where it is sure to agree: plain letters, no special token."""
        if self.ranks and max(text) < PLAIN and not any(t in text for t in self.special):
            return array.array("I", self.ranks.encode_ordinary(text)).tobytes()
        return self.whole(text)

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        words = iter(text.split(" "))
        try:
            return self.first[next(words)] + b"".join(map(self.rest.__getitem__, words))
        except _Whole:
            return self.whole(text)


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """The encoder of this worker process."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def version_digest(vocabulary: str) -> str:
    """SHA-256 of the vocabulary file: another file, another count."""
    with open(vocabulary, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def count_tokens(contents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """digest, n_tokens of (digest, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            counts = [len(encode(t.as_py())) // 4 for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return contents.mapInArrow(run, "digest string, n_tokens bigint")


def cached_counts(docs: DataFrame, folder: str, version: str) -> DataFrame:
    """digest, n_tokens of every run before under this tokenizer version; empty where there was none."""
    spark = docs.sparkSession
    try:
        found = spark.read.schema("digest string, n_tokens bigint").option("recursiveFileLookup", "true").parquet(f"{folder}/{version}")
    except AnalysisException:
        return spark.createDataFrame([], "digest string, n_tokens bigint")
    # Two runs at one time may both have counted a content.
    return found.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(
    docs: DataFrame,
    cache: str | None = None,
    vocabulary: str = VOCABULARY,
    limit: int = LIMIT,
    normalised: str = "text",
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit.

    `cache` is the folder of stored counts; without it a fresh one on the shared checkpoint storage is used.
    `normalised` is SQL text for the content that is digested and encoded; it must keep counts, and since this
    vocabulary normalises nothing itself, it is the text as it stands. A null text is an empty one: 0 tokens.
    Repeated contents are encoded once, and the rows of a content that stands in very many are spread. An empty table gives no rows and appends nothing.
    """
    spark = docs.sparkSession
    folder, version = cache or scratch_folder(spark), version_digest(vocabulary)
    rows = only(docs, doc_id=doc_id, text=text)
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("bigint")).withColumn("text", F.expr(normalised))
    rows = rows.withColumn("digest", F.sha2("text", 256))
    misses = rows.select("digest", "text").distinct().join(cached_counts(docs, folder, version), "digest", "left_anti")
    count_tokens(misses, vocabulary).write.parquet(f"{folder}/{version}/{uuid.uuid4().hex}")
    thin = stored(rows.select("doc_id", "n_bytes", "digest"))
    counted = hot_join(thin, cached_counts(docs, folder, version), "digest")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
