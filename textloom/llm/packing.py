"""Packing by power-of-two decomposition.

A document of n tokens (its end token included) is cut into n // L pieces of L
tokens and one piece for each set bit of n % L, longest first. Pieces of equal
length share a bucket and every piece is a sequence of its own, so no sequence
crosses documents and none needs padding: its length is a power of two.

Sequence ids are dense and bucket by bucket, longest bucket first. Within a bucket,
pieces are numbered per shard (a hash of document and start), and there are as many
shards as pieces of the table ask for, so that no task orders more than about
``SHARD_PIECES``. Counts give each shard its first id, in two levels: shards within a
bucket's super-shard of ``SUPER`` shards, and super-shards.

Tokens are those of the ``tokenizers`` file at ``tokenizer_path``. The vocabulary is
read as byte-pair ranks for tiktoken, which encodes several times faster; texts with
a special token's string, or with characters for which the two libraries' Unicode
tables might differ, go through ``tokenizers`` itself.

Edge cases: a null or empty text is the end token alone (one piece of one token); rows
that repeat a doc_id are packed each; a null doc_id stays null; ties between equal
pieces do not matter, as they differ in nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import Scratch, map_arrow, shuffle_partitions

TOKENIZER = "byte_bpe_50k.json"
SEQUENCE_TOKENS = 2048
END_ID = 1
#: Pieces that a shard should hold, over all its buckets, and shards in a super-shard.
SHARD_PIECES, SUPER = 50_000, 1024

#: Beyond Latin letters and general punctuation, Unicode tables of libraries may differ.
_EXOTIC = re.compile("[^\x00-ɏ‐-‧‰-⁞]")


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others, in order, as U+0100 and on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Encoder:
    """Token ids of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"]}
        byte_of = _byte_of_char()
        ranks = {bytes(map(byte_of.__getitem__, token)): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype="<u4")
        if not _EXOTIC.search(text) and not (self.special and self.special.search(text)):
            try:
                return np.asarray(self.fast.encode_ordinary(text), dtype="<u4")
            except BaseException as error:  # its regular expression engine panics on very long runs
                if type(error).__name__ != "PanicException":
                    raise
        return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")


def binary_pieces(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    out = [(i * longest, longest) for i in range(n // longest)]
    start, rest = n // longest * longest, n % longest
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            out.append((start, 1 << bit))
            start += 1 << bit
    return out


_encoders: dict[str, Encoder] = {}


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, sequence_tokens: int = SEQUENCE_TOKENS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece, and its ids if asked for."""
    if sequence_tokens < 1 or sequence_tokens & (sequence_tokens - 1):
        raise ValueError("sequence_tokens must be a power of two")
    path = tokenizer_path or public_tokenizers.path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        encoder = _encoders[path]
        for batch in batches:
            doc, start, length, crc, total, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                tokens = np.append(encoder.encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for a, n in binary_pieces(len(tokens), sequence_tokens):
                    own = tokens[a : a + n]
                    doc.append(i)
                    start.append(a)
                    length.append(n)
                    crc.append(zlib.crc32(own.tobytes()))
                    total.append(len(tokens))
                    if with_ids:
                        ids.append(own)
            if doc:
                columns = [batch.column(0).take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids
    return map_arrow(docs.select(F.col(id_col).cast("long"), text_col), run, schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, sequence_tokens: int = SEQUENCE_TOKENS, end_id: int = END_ID, with_ids: bool = False, shards: int | None = None) -> DataFrame:
    """The pieces with sequence_id and offset; the bucket of a sequence is its length."""
    spark = docs.sparkSession
    own = pieces(docs, id_col, text_col, tokenizer_path, sequence_tokens, end_id, with_ids)
    cut = Scratch(spark, "packing").keep(own, "pieces")
    shards = max(shuffle_partitions(spark), -(-cut.count() // SHARD_PIECES)) if shards is None else shards
    cut = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start"), F.lit(shards)))
    bases = _bases(cut.groupBy("length", "shard").agg(F.count(F.lit(1)).alias("n")))
    within = Window.partitionBy("length", "shard").orderBy("doc_id", "start", "doc_tokens", "ids_crc32")
    numbered = cut.withColumn("k", F.row_number().over(within) - 1)
    joined = numbered.join(bases, ["length", "shard"])
    return joined.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids, (F.col("base") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def _bases(counts: DataFrame) -> DataFrame:
    """length, shard, base (its first sequence id) from the counts (length, shard, n)."""
    rows = counts.withColumn("super", F.floor(F.col("shard") / SUPER))
    earlier = Window.partitionBy("length", "super").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.select("length", "super", "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("inner"))
    before = Window.orderBy(F.desc("length"), "super").rowsBetween(Window.unboundedPreceding, -1)  # lengths x super-shards rows
    outer = rows.groupBy("length", "super").agg(F.sum("n").alias("n")).select("length", "super", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("outer"))
    return inner.join(outer, ["length", "super"]).select("length", "shard", (F.col("inner") + F.col("outer")).alias("base"))
