"""Evaluation passages inside a corpus: a distributed positional inverted index.

The corpus is cut into shards; each shard lists, for every word in it, the
positions where it stands (postings), numbered through the texts of the shard
with a gap after each text. The postings are stored as a table of (shard, word,
number, positions) and queried by the words of the test passages alone.

A stretch of passage words is found by intersecting the postings of its words,
each shifted by the word's offset, starting from the rarest word of the stretch
in that shard: what remains are the exact places. Proximity matches keep places
where most words of a stretch stand in order with a few others between.

A word is a run of letters or digits, compared without case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm import scan
from heddle.session import scratch, stored

#: Positions between two texts of a shard, so that no stretch crosses them.
GAP = 1
INDEX_SCHEMA = "shard string, word string, n int, positions binary"
#: The word under which a shard keeps where its texts begin; no real word is empty.
TEXTS = ""


def _cut(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts, case folded, in order, and how many each text has: 'Straße' and 'STRASSE' are one word."""
    folded = pa.array([t.casefold() for t in texts.to_pylist()], pa.large_string())
    data, offsets = scan.utf8(folded)
    points = scan.code_points(data)
    at = scan.byte_offsets(points)
    borders = np.searchsorted(at, offsets)
    begins, ends = scan.word_runs(points, borders)
    words = scan.slices(data, at[begins], at[ends]).dictionary_encode()
    return words, np.diff(np.searchsorted(begins, borders))


def words_of(text: str) -> list[str]:
    """The words of one text in order, case folded."""
    words, _ = _cut(pa.array([text], pa.large_string()))
    return words.cast(pa.large_string()).to_pylist()


#: Words with fewer postings in a shard are stored as they are.
FEW = 16


def unpack(data: bytes) -> np.ndarray:
    """Ascending positions from their stored differences."""
    raw = zstandard.decompress(data[1:]) if data[:1] == b"z" else data[1:]
    return np.cumsum(np.frombuffer(raw, np.uint32), dtype=np.int64)


def _postings(shard: str, keys: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    found, sizes = _cut(texts)
    starts = np.concatenate([[0], np.cumsum(sizes + GAP)[:-1]]).astype(np.int64)
    codes = found.indices.to_numpy(zero_copy_only=False)
    n = len(found.dictionary)
    places = np.arange(len(codes), dtype=np.int64) + np.repeat(np.arange(len(texts), dtype=np.int64) * GAP, sizes)
    order = np.argsort(codes.astype(np.uint16) if n <= 65536 else codes, kind="stable")
    counts = np.bincount(codes, minlength=n).astype(np.int32) if n else np.zeros(0, np.int32)
    ends = np.cumsum(counts, dtype=np.int64)
    # differences within each word's list; its first place as it is
    sorted_places = places[order]
    steps = np.diff(sorted_places, prepend=0)
    begins = ends - counts
    steps[begins] = sorted_places[begins]
    raw = steps.astype(np.uint32).tobytes()
    press = zstandard.ZstdCompressor(level=1).compress
    data = [
        b"z" + press(raw[4 * a : 4 * b]) if b - a >= FEW else b"r" + raw[4 * a : 4 * b]
        for a, b in zip(begins.tolist(), ends.tolist())
    ]
    head = np.diff(starts, prepend=0).astype(np.uint32).tobytes()
    data.append(np.asarray(keys.cast(pa.int64())).astype(np.int64).tobytes() + b"r" + head)
    words = pa.concat_arrays([found.dictionary.cast(pa.string()), pa.array([TEXTS], pa.string())])
    return pa.RecordBatch.from_pydict({
        "shard": pa.array([shard] * len(words)), "word": words,
        "n": pa.array(np.concatenate([counts, [len(texts)]]).astype(np.int32)), "positions": pa.array(data, pa.binary()),
    })


def _index(shard_bytes: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, no = TaskContext.get().partitionId(), 0
        for batch in batches:
            keys, texts = batch.columns
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            begin = 0
            while begin < len(texts):
                done = int(ends[begin - 1]) if begin else 0
                stop = max(begin + 1, int(np.searchsorted(ends, done + shard_bytes, side="right")))
                yield _postings(f"{part}-{no}", keys.slice(begin, stop - begin), texts.slice(begin, stop - begin))
                begin, no = stop, no + 1

    return build


def build_index(texts: DataFrame, key: str, text: str, *, shard_bytes: int = 6_000_000, path: str | None = None) -> DataFrame:
    """The stored index of all texts: (shard, word, n, positions).

    Written to ``path``, or to a folder of its own in the shared folder. A
    shard holds texts of at most ``shard_bytes`` (or one text that is longer),
    so a word's postings in a shard are bounded however frequent it is.
    Every text is indexed whole; null and empty texts and null keys give no
    posting.
    """
    path = path or scratch(texts.sparkSession, "postings")
    rows = texts.select(F.col(f"`{key}`").cast("bigint").alias("k"), F.col(f"`{text}`").alias("t")).filter("k IS NOT NULL AND t <> ''")
    rows.mapInArrow(_index(shard_bytes), INDEX_SCHEMA).write.option("compression", "zstd").parquet(path)
    return texts.sparkSession.read.schema(INDEX_SCHEMA).parquet(path)


class _Shard:
    """Postings of one shard, for the words asked for."""

    def __init__(self, table: pa.Table):
        self.data = dict(zip(table.column("word").to_pylist(), table.column("positions").to_pylist()))
        self.count = dict(zip(table.column("word").to_pylist(), table.column("n").to_pylist()))
        head = self.data.pop(TEXTS)
        n = self.count.pop(TEXTS)
        self.keys = np.frombuffer(head[: 8 * n], np.int64)
        self.starts = unpack(head[8 * n :])
        self.open: dict[str, np.ndarray] = {}

    def of(self, word: str) -> np.ndarray:
        if word not in self.open:
            self.open[word] = unpack(self.data[word]) if word in self.data else np.empty(0, np.int64)
        return self.open[word]

    def text(self, places: np.ndarray) -> np.ndarray:
        return self.keys[np.searchsorted(self.starts, places, side="right") - 1]


def _in(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of ``a`` are in ascending ``b``; looked up one by one, for ``a`` is short where ``b`` is long."""
    if not len(b):
        return np.zeros(len(a), bool)
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return b[at] == a


def exact_places(shard: _Shard, passage: list[str], length: int) -> np.ndarray:
    """Places in the shard where a word stands that is part of ``length`` consecutive words of the passage, ascending and distinct.

    Every stretch of the passage is approached from its rarest word in this
    shard; stretches with a word that the shard lacks are left out at once. A
    stretch holds all words of one half around its rarest word, so the shifted
    lists of that half are intersected first, rarest first; for the places that
    are left, the words around them are counted out.
    """
    counts = np.array([shard.count.get(w, 0) for w in passage])
    reach = length // 2
    hits: list[np.ndarray] = []
    for a, alive in _rarest(counts, length).items():
        at = shard.of(passage[a])
        halves = []
        for side in (range(a, a + reach + 1), range(a - reach, a + 1)):
            if side.start < 0 or side.stop > len(passage) or not counts[side.start : side.stop].all():
                continue
            left = at
            for i in sorted((i for i in side if i != a), key=lambda i: counts[i]):
                left = left[_in(left + (i - a), shard.of(passage[i]))]
                if not len(left):
                    break
            if len(left):
                halves.append(left)
        if not halves:
            continue
        left = np.unique(np.concatenate(halves))
        low, high = min(alive), max(alive) + length
        kept = np.zeros((len(left), high - low), np.int16)
        for i in range(low, high):
            kept[:, i - low] = _in(left + (i - a), shard.of(passage[i]))
        sums = np.concatenate([np.zeros((len(left), 1), np.int32), np.cumsum(kept, axis=1)], axis=1)
        good = (sums[:, length:] - sums[:, :-length] == length).any(axis=1)
        hits.append(left[good])
    return np.unique(np.concatenate(hits)) if hits else np.empty(0, np.int64)


def _rarest(counts: np.ndarray, length: int) -> dict[int, list[int]]:
    """{offset of a rarest word: begins of the stretches approached from it}, without stretches that lack a word."""
    out: dict[int, list[int]] = {}
    for s in range(len(counts) - length + 1):
        window = counts[s : s + length]
        if window.all():
            out.setdefault(s + int(window.argmin()), []).append(s)
    return out


def near_places(shard: _Shard, passage: list[str], length: int, least: int, slack: int) -> np.ndarray:
    """Places near which ``least`` of ``length`` consecutive passage words stand in one text, in order and with at most ``slack`` words more among them than the passage has from the first to the last of them: a word in the place of a missing one does not count.

    Every stretch is approached from its length - least + 1 rarest words: a
    stretch that keeps ``least`` words has one of them. Places of such a word
    without enough words of a stretch nearby, in whatever order, are left out
    first; around the others the longest alignment is counted.
    """
    counts = np.array([shard.count.get(w, 0) for w in passage])
    last = len(passage) - length
    reach = length + slack - 1
    anchors: dict[int, list[int]] = {}
    for s in range(last + 1):
        window = counts[s : s + length]
        if (window > 0).sum() >= least:
            for i in np.argsort(window, kind="stable")[: length - least + 1]:
                anchors.setdefault(s + int(i), []).append(s)
    hits = []
    for a, stretches in sorted(anchors.items()):
        at = shard.of(passage[a])
        if not len(at):
            continue
        low, high = stretches[0], stretches[-1] + length
        kept = np.zeros((len(at), high - low), np.int16)
        kept[:, a - low] = 1
        for i in range(low, high):
            if i != a:
                kept[:, i - low] = _within(shard.of(passage[i]), at, (1, reach) if i > a else (-reach, -1))
        sums = np.concatenate([np.zeros((len(at), 1), np.int32), np.cumsum(kept, axis=1)], axis=1)
        at = at[(sums[:, length:] - sums[:, :-length] >= least).any(axis=1)]
        if not len(at):
            continue
        right = _aligned(shard, passage[a + 1 : high], at, reach, 1)
        left = _aligned(shard, passage[low:a][::-1], at, reach, -1)
        good = np.zeros(len(at), bool)
        for s in stretches:
            for b in range(s, min(a, s + length - least) + 1):
                for e in range(max(a, b + least - 1), s + length):
                    before, after, span = left[a - b], right[e - a], e - b + slack
                    for d in range(span + 1):
                        good |= before[d] + 1 + after[span - d] >= least
        hits.append(at[good])
    return np.unique(np.concatenate(hits)) if hits else np.empty(0, np.int64)


def _within(posts: np.ndarray, places: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    """Near which of ``places``, from the first to the last distance of ``span``, one of ``posts`` stands."""
    if not len(posts):
        return np.zeros(len(places), bool)
    at = np.searchsorted(posts, places + span[0])
    return (at < len(posts)) & (posts[np.minimum(at, len(posts) - 1)] <= places + span[1])


def _aligned(shard: _Shard, words: list[str], at: np.ndarray, reach: int, step: int) -> list[np.ndarray]:
    """[n][d, place]: how many of the first n words, the last of them included, stand in order among the d places next to each place, in its text, to the right (step 1) or left (-1); far below 0 if the last does not."""
    text = np.searchsorted(shard.starts, at, side="right") - 1
    ends = np.append(shard.starts[1:] - GAP, np.iinfo(np.int64).max)
    room = ends[text] - 1 - at if step > 0 else at - shard.starts[text]
    row = np.zeros((reach + 1, len(at)), np.int16)
    closed = [row]
    for word in words:
        posts, end = shard.of(word), np.full_like(row, -1000)
        for d in range(1, reach + 1):
            match = _in(at + step * d, posts) & (d <= room)
            end[d] = np.maximum(end[d - 1], np.where(match, row[d - 1] + 1, -1000))
        row = np.maximum(row, end)
        closed.append(end)
    return closed


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, sizes = _cut(batch.column(1))
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), words.cast(pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["item", "words"])


def _search(length: int, near: tuple[int, int] | None):
    out = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64())])

    def search(met: pa.Table, postings: pa.Table) -> pa.Table:
        """The passages that may stand in a shard, looked for in its postings."""
        if not met.num_rows or not postings.num_rows:
            return out.empty_table()
        shard = _Shard(postings)
        docs, items = [], []
        for batch in met.select(["item", "words"]).to_batches():
            for item, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words.as_py()
                places = near_places(shard, words, length, *near) if near else exact_places(shard, words, length)
                if len(places):
                    found = np.unique(shard.text(places))
                    docs.append(found)
                    items.append(np.full(len(found), item, np.int64))
        if not docs:
            return out.empty_table()
        return pa.table([np.concatenate(docs), np.concatenate(items)], schema=out)

    return search


#: A list of words is broadcast up to this many bytes, which are measured; a longer one is joined by shuffle.
MOST_BROADCAST = 64_000_000


def _small(words: DataFrame) -> DataFrame:
    size = words.agg(F.sum(F.octet_length("word") + 40).alias("b")).first()["b"] or 0
    return F.broadcast(words) if size <= MOST_BROADCAST else words


def anchors(passages: DataFrame, counts: DataFrame, length: int, least: int) -> DataFrame:
    """(item, words, word): for each passage the words from which its stretches are approached: of every stretch the ``length - least + 1`` that are rarest in the whole index, of which a place that holds ``least`` words of it has one. Words that the index lacks are none; a stretch that lacks too many is left out."""
    k = length - least + 1
    spread = passages.withColumn("no", F.monotonically_increasing_id()).select("no", "item", "words", F.posexplode("words").alias("at", "word"))
    known = spread.join(counts, "word", "left").groupBy("no").agg(
        F.first("item").alias("item"), F.first("words").alias("words"), F.array_sort(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n"), "word"))).alias("all"))
    starts = F.sequence(F.lit(1), F.size("all") - length + 1)
    rarest = lambda i: F.slice(F.array_sort(F.transform(F.slice("all", i, F.lit(length)), lambda x: F.struct(x["n"].alias("n"), x["word"].alias("word")))), 1, k)
    alive = F.filter(F.transform(starts, rarest), lambda r: F.element_at(r, k)["n"] > 0)
    every = F.array_distinct(F.transform(F.filter(F.flatten(alive), lambda x: x["n"] > 0), lambda x: x["word"]))
    return known.filter(F.size("all") >= length).select("item", "words", F.explode(every).alias("word"))


def search(index: DataFrame, items: DataFrame, item: str, passage: str, *, length: int = 13, near: tuple[int, int] | None = None) -> DataFrame:
    """(doc_id, item_id), distinct: texts that hold ``length`` consecutive words of a passage, of all passages in ``items``.

    near=(least, slack): instead, ``least`` of ``length`` words in order with at
    most ``slack`` foreign words among them, not counting one in the place of
    each missing word. Passages shorter than ``length`` are never found; null
    passages and ids give nothing.

    Words are counted over the whole index, which gives every stretch of a
    passage its rarest words; a shard and a passage meet where the shard has
    one of them, and only what meets is looked through. The work follows the
    number of places of rare words, not of shards times passages. Only the
    postings of passage words are read and shuffled, by shard; the passages are
    a table like any other and never on the driver.
    """
    asked = items.select(F.col(f"`{item}`").cast("bigint").alias("i"), F.col(f"`{passage}`").alias("p")).filter("i IS NOT NULL AND p <> ''").distinct()
    passages = stored(asked.mapInArrow(_passages, "item long, words array<string>"), "passages")
    words = stored(passages.select(F.explode("words").alias("word")).distinct(), "words")
    read = stored(index.join(_small(words.unionByName(index.sparkSession.range(1).select(F.lit(TEXTS).alias("word")))), "word", "left_semi"), "asked")
    counts = read.filter(F.col("word") != TEXTS).groupBy("word").agg(F.sum("n").alias("n"))
    begin = anchors(passages, counts, length, near[0] if near else length)
    met = read.select(F.col("shard").alias("at"), "word").join(begin, "word").select("at", "item", "words").distinct()
    hits = met.groupBy("at").cogroup(read.groupBy("shard")).applyInArrow(_search(length, near), "doc_id long, item_id long")
    return hits.distinct()


__all__ = ["build_index", "exact_places", "near_places", "search", "unpack", "words_of"]
