"""Encoding a corpus with a public byte-level BPE tokenizer by a global distinct-word shuffle.

A byte-level BPE encodes every pre-token by itself, so each distinct pre-token
needs encoding once in the whole corpus:

1. the texts of a block are cut into pre-tokens; the block keeps its distinct
   words and, by position, the number of the word that stands there;
2. the distinct words over all blocks are encoded, once each;
3. the ids are joined back by word, and regrouped by block;
4. in each block the ids are put in the place of the numbers, by position.

Only (block, word) pairs are shuffled by word, never the positions: a frequent
word costs one row a block, whatever its number of occurrences, so there is no
hot key. The blocks are stored once in the shared folder, where later stages
find them again if executors are lost.
"""

from __future__ import annotations

import base64
import importlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm import scan
from heddle.session import scratch

#: The pattern of the pre-tokens in the tokenizer library's own dialect.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer_file(name: str = "byte_bpe_50k.tiktoken", module: str = "public_tokenizers") -> str:
    """Where a public vocabulary lies; the module knows its folder, a path can be given to the operators instead."""
    return importlib.import_module(module).path(name)


def load_encoding(path: str):
    """The tokenizer in a ``.tiktoken`` file of base64 tokens and ranks, without special tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _encoder(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = load_encoding(path).encode_ordinary
        for batch in batches:
            words = batch.column(0)
            ids = pa.array([one(w) for w in words.to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([words, ids], names=["word", "ids"])

    return encode


def _cut(texts: pa.Array) -> pa.DictionaryArray:
    """All pre-tokens of the texts, in order, and how many each text has."""
    data, offsets = scan.utf8(texts)
    points = scan.code_points(data)
    at = scan.byte_offsets(points)
    borders = np.searchsorted(at, offsets)
    starts = scan.pre_tokens(points, borders)
    words = scan.slices(data, at[starts]).dictionary_encode()
    return words, np.diff(np.searchsorted(starts, borders))


def _cut_long(texts: pa.Array, most: int):
    """As _cut, with texts of more than ``most`` bytes cut first, before a space between two other characters, where a pre-token begins in any case."""
    pieces, owner = [], []
    for i, t in enumerate(texts.to_pylist()):
        while len(t) > most:
            k = t.find(" ", most)
            while k >= 0 and (t[k - 1].isspace() or t[k + 1 : k + 2].isspace() or k + 1 == len(t)):
                k = t.find(" ", k + 1)
            if k < 0:
                break
            pieces.append(t[:k])
            owner.append(i)
            t = t[k:]
        pieces.append(t)
        owner.append(i)
    parts, sizes = [], np.zeros(len(texts), np.int64)
    for piece, i in zip(pieces, owner):
        words, size = _cut(pa.array([piece], pa.string()))
        parts.append(words)
        sizes[i] += size[0]
    return pa.chunked_array(parts).unify_dictionaries().combine_chunks(), sizes


def _blocks(block_bytes: int, kind: pa.DataType):
    out = pa.schema([
        ("block", pa.string()), ("words", pa.list_(pa.string())), ("keys", pa.list_(kind)), ("sizes", pa.list_(pa.int32())), ("codes", pa.binary()),
    ])

    def block(name: str, keys: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        one = pc.max(pc.binary_length(texts)).as_py() <= block_bytes
        words, sizes = _cut(texts) if one else _cut_long(texts, block_bytes)
        if isinstance(words, pa.ChunkedArray):
            words = words.combine_chunks()
        codes = words.indices.to_numpy(zero_copy_only=False)
        small = codes.astype(np.uint16 if len(words.dictionary) <= 65536 else np.uint32)
        packed = bytes([small.dtype.itemsize]) + zstandard.compress(small.tobytes(), 1)
        return pa.RecordBatch.from_arrays([
            pa.array([name]), pa.array([words.dictionary.cast(pa.string()).to_pylist()], out.field(1).type), _one_list(keys, kind),
            pa.array([sizes.astype(np.int32)], out.field(3).type), pa.array([packed], pa.binary()),
        ], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, no = TaskContext.get().partitionId(), 0
        for batch in batches:
            keys, texts = batch.columns
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            begin = 0
            while begin < len(texts):
                done = int(ends[begin - 1]) if begin else 0
                stop = max(begin + 1, int(np.searchsorted(ends, done + block_bytes, side="right")))
                yield block(f"{part}-{no}", keys.slice(begin, stop - begin), texts.slice(begin, stop - begin))
                begin, no = stop, no + 1

    return run


def _one_list(values: pa.Array, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind))


def _place(kind: pa.DataType):
    out = pa.schema([("k", kind), ("ids", pa.list_(pa.int32()))])

    def place(blocks: pa.Table, words: pa.Table) -> pa.Table:
        """The ids of a block's texts: by position, the ids of the word whose number stands there."""
        if not blocks.num_rows:
            return out.empty_table()
        packed = blocks.column("codes")[0].as_py()
        codes = np.frombuffer(zstandard.decompress(packed[1:]), np.uint16 if packed[0] == 2 else np.uint32).astype(np.int64)
        numbers = words.column("no").to_numpy()
        order = np.argsort(numbers)
        if not np.array_equal(numbers[order], np.arange(len(order))):
            raise ValueError("a pre-token is missing from the dictionary of its block")
        lists = words.column("ids").combine_chunks()
        lists = (lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists).take(pa.array(order))
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        begins = lists.offsets.to_numpy()[: len(order) + 1].astype(np.int64)
        begins -= begins[0]
        lengths = np.diff(begins)[codes]
        ends = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(lengths, out=ends[1:])
        # a run of ids for each position: its place in the flat list, counted on
        at = np.arange(int(ends[-1])) + np.repeat(begins[:-1][codes] - ends[:-1], lengths)
        sizes = np.concatenate([[0], np.cumsum(blocks.column("sizes").combine_chunks().flatten().to_numpy())])
        made = pa.ListArray.from_arrays(pa.array(ends[sizes].astype(np.int32)), pa.array(flat[at].astype(np.int32)))
        return pa.Table.from_arrays([blocks.column("keys").combine_chunks().flatten(), made], schema=out)

    return place


#: Spark's type of a key and Arrow's.
_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def encode(texts: DataFrame, key: str, text: str, *, path: str, block_bytes: int = 4_000_000) -> DataFrame:
    """(key, ids): the token ids of every text, without special tokens.

    One row for each row of ``texts``. A null or empty text has an empty list;
    their rows skip the shuffle. Strings that look like special tokens are
    ordinary text. Repeated rows and null keys are kept. ``key`` is a bigint,
    int or string. ``block_bytes`` bounds the text of a block, save for one
    text that is longer; it bounds what a task holds, not what is encoded.
    """
    kind = dict(texts.dtypes)[key]
    if kind not in _KINDS:
        raise TypeError(f"a key must be bigint, int or string, not {kind}")
    spark = texts.sparkSession
    rows = texts.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    bare = rows.filter("t IS NULL OR t = ''").select("k", F.array().cast("array<int>").alias("ids"))
    schema = f"block string, words array<string>, keys array<{kind}>, sizes array<int>, codes binary"
    where = scratch(spark, "blocks")
    rows.filter("t <> ''").mapInArrow(_blocks(block_bytes, _KINDS[kind]), schema).write.parquet(where)
    blocks = spark.read.schema(schema).parquet(where)
    pairs = blocks.select(F.col("block").alias("of"), F.posexplode("words").alias("no", "word"))
    ids = pairs.select("word").distinct().mapInArrow(_encoder(path), "word string, ids array<int>")
    known = pairs.join(ids, "word").select("of", "no", "ids")
    put = blocks.drop("words").groupBy("block").cogroup(known.groupBy("of")).applyInArrow(_place(_KINDS[kind]), f"k {kind}, ids array<int>")
    return put.unionByName(bare).withColumnRenamed("k", key)


def token_bytes(path: str) -> pa.BinaryArray:
    """The token-byte table of a vocabulary by id, null for ids it leaves free; as long as the vocabulary, whatever the corpus."""
    with open(path, "rb") as f:
        table = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    return pa.array([table.get(i) for i in range(max(table, default=-1) + 1)], pa.binary())


def _join_bytes(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            lists = batch.column(1)
            ids = lists.flatten()
            offsets = np.zeros(len(lists) + 1, np.int64)
            np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), out=offsets[1:])
            numbers = pc.fill_null(ids, -1).to_numpy(zero_copy_only=False)
            inside = (numbers >= 0) & (numbers < len(table))
            pieces = table.take(pa.array(np.where(inside, numbers, 0))) if len(table) else pa.nulls(len(numbers), pa.binary())
            wrong = ~inside | pieces.is_null().to_numpy(zero_copy_only=False)
            # the pieces lie one behind the other: a text is what lies between two of its lists' borders
            pieces = pc.if_else(pa.array(wrong), pa.scalar(b"", pa.binary()), pieces).cast(pa.large_binary())
            if isinstance(pieces, pa.ChunkedArray):
                pieces = pieces.combine_chunks()
            at = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1] if len(pieces) else np.zeros(1, np.int64)
            texts = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(lists), [None, pa.py_buffer(np.ascontiguousarray(at[offsets])), pieces.buffers()[2] or pa.py_buffer(b"")]
            ).cast(pa.binary())
            bad = np.zeros(len(numbers) + 1, np.int64)
            np.cumsum(wrong, out=bad[1:])
            none = (bad[offsets[1:]] > bad[offsets[:-1]]) | lists.is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.if_else(pa.array(none), pa.scalar(None, pa.binary()), texts)], names=["k", "b"])

    return run


#: Largest token-byte table that is sent to the tasks.
MOST_BYTES = 256_000_000


def decode(encoded: DataFrame, key: str, *, path: str) -> DataFrame:
    """(key, text) from (key, ids), by a map-side join with the token-byte table; null for ids that are null, unknown or not UTF-8 together.

    One row for each row. The table is read once, its size is checked (it is
    that of the vocabulary, whatever the corpus), and it is broadcast; a task
    looks all ids of a batch up at once, by position. Nothing is shuffled, so
    that frequent ids make no hot key and texts need not be put together again.
    """
    kind = dict(encoded.dtypes)[key]
    table = token_bytes(path)
    if table.nbytes > MOST_BYTES:
        raise ValueError(f"a token-byte table of {table.nbytes} bytes is above {MOST_BYTES}")
    shared = encoded.sparkSession.sparkContext.broadcast(table)
    rows = encoded.select(F.col(f"`{key}`").alias("k"), F.col("ids").cast("array<int>").alias("ids"))
    joined = rows.mapInArrow(_join_bytes(shared), f"k {kind}, b binary")
    return joined.select(F.col("k").alias(key), F.try_validate_utf8(F.col("b").cast("string")).alias("text"))
