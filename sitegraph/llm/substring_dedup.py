"""Substring de-duplication with a count-min prefilter.

A window is ``size`` consecutive words of one document. A word goes if a window over it also starts in a document with a
smaller doc_id; windows are judged on the input.

1. Sketch. Every window is counted under its minimiser: the least hash among its runs of size * 4 // 5 words. Equal windows
   have equal minimisers, so the number of documents with a minimiser never falls short of that of any window behind it, and
   one minimiser stands for about six neighbouring windows. Each task counts its documents' minimisers (once per
   document) into partial count-min sketches whose counters stop at two; the partial sketches are merged segment by
   segment. The merged sketch overestimates and never underestimates. Its width follows the input up to ``max_bits``; a
   fuller sketch lets more windows through and changes no result.
2. Exact pass. Only windows estimated repeated are grouped, by 96-bit keys of their words: the least doc_id of each
   (map-side combined), joined back to the windows: keys of very many windows by broadcast, the rest by a shuffle. Two
   different windows share a key with a chance of 2**-96 (names of whole sequences: 2**-128).
   Texts whose whole word sequence is estimated repeated wait: of each class of equal sequences only the first
   document's windows are grouped, the others are removed outright, which changes no result either.
3. A last scan finishes texts that lose nothing on the spot; only those that a fixed-size filter over the ids of losers lets
   through are carried to a join with their removed places. No text is carried before.

Edge cases: a null or empty text has no words (hash of the empty string). Fewer than ``size`` words: nothing is removed.
A null doc_id is neither smaller nor larger than any: such rows stay whole and remove nothing. Rows with equal doc_id don't
remove each other's words, whether or not their texts are equal. Windows repeated within one document stay. An empty table
gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.llm.common import WordHashes, counted_join, keep, pieces, window_hashes
from sitegraph.llm.simhash_dedup import _place as filter_place
from sitegraph.llm.simhash_dedup import id_filter

SIZE = 50
_SEGMENT = 22  # log2 of the counters of a segment
_U64 = np.uint64
_ALL = (1 << 36) - 1  # the place that stands for all words
KEYS = "doc_id long, h1 long, h2 long, k1 array<long>, k2 array<int>, at array<long>"
CUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def minimisers(words: np.ndarray, size: int) -> np.ndarray:
    """For each window of ``size`` words, the least hash of its runs of size * 4 // 5 words."""
    run = max(1, size * 4 // 5)
    span, step, want = window_hashes(words, run, 0xA24BAED4963EE407), 1, size - run + 1
    while step * 2 <= want:
        span = np.minimum(span[: len(span) - step], span[step:])
        step *= 2
    n = len(words) - size + 1
    return np.minimum(span[:n], span[want - step : want - step + n])


def _whole(data: bytes) -> tuple[int, int]:
    """A 128-bit name of the word sequence, as two signed numbers."""
    import xxhash

    raw = xxhash.xxh3_128_digest(b" ".join(data.split()))
    a, b = np.frombuffer(raw, dtype="<i8")
    return int(a), int(b)


def _row(h1: int) -> int:
    """A tag of a row's text, held above the word numbers: it parts rows that share a doc_id."""
    return (h1 & 0x7FFFFFF) << 36


def bits_for(characters: int, max_bits: int) -> int:
    """log2 of the width of either row: four counters for each expected minimiser (one in about 36 characters)."""
    most = max(_SEGMENT, max_bits.bit_length() - 2)  # two rows of 2**bits counters, a bit each
    return min(most, max(_SEGMENT, (4 * (characters // 36) - 1).bit_length()))


def _places(items: np.ndarray, bits: int) -> list[np.ndarray]:
    """The counters of items in both rows; the second row's follow the first's."""
    mask = _U64((1 << bits) - 1)
    return [items & mask, ((items >> _U64(64 - bits)) & mask) + _U64(1 << bits)]


def sketch(docs: DataFrame, bits: int, size: int = SIZE) -> DataFrame:
    """The merged sketch: (segment, repeated), a bitmap of the counters that reached two."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, many = WordHashes(), [], 0

        def flush() -> pa.RecordBatch:
            items = np.concatenate(held) if held else np.zeros(0, dtype=_U64)
            segments, once, twice = [], [], []
            for place in _places(items, bits):
                index, n = np.unique(place, return_counts=True)
                segment = (index >> _U64(_SEGMENT)).astype(np.int64)
                inner = (index & _U64((1 << _SEGMENT) - 1)).astype("<u4")
                cuts = np.flatnonzero(np.diff(segment)) + 1
                for a, b in zip([0, *cuts], [*cuts, len(index)]):
                    if b > a:
                        segments.append(int(segment[a]))
                        once.append(inner[a:b].tobytes())
                        twice.append(inner[a:b][n[a:b] > 1].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(segments, pa.int64()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], names=["segment", "once", "twice"])

        for whole in batches:
            for batch in pieces(whole):
                for doc, text in zip(batch.column(0), batch.column(1)):
                    if not doc.is_valid:
                        continue
                    data = (text.as_py() or "").encode()
                    words = hashes(data.split())
                    if len(words) >= size:
                        items = [np.unique(minimisers(words, size)), np.array([_whole(data)[0]], dtype=np.int64).view(_U64)]
                        held += items
                        many += len(items[0]) + 1
                if many > 2_000_000:
                    yield flush()
                    held, many = [], 0
        yield flush()

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, more = None, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(more).tobytes()], pa.binary())], names=["segment", "repeated"])

        for batch in batches:
            for segment, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
                if segment != now:
                    if now is not None:
                        yield done()
                    now, seen, more = segment, np.zeros(1 << _SEGMENT, dtype=bool), np.zeros(1 << _SEGMENT, dtype=bool)
                index = np.frombuffer(once, dtype="<u4")
                more[index] |= seen[index]
                seen[index] = True
                more[np.frombuffer(twice, dtype="<u4")] = True
        if now is not None:
            yield done()

    partial = docs.mapInArrow(count, "segment long, once binary, twice binary")
    return partial.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment long, repeated binary")


def collected(merged: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of both rows as one array; its size is fixed by ``bits``, not by the input."""
    out = np.zeros((2 << bits) // 8, dtype=np.uint8)
    step = (1 << _SEGMENT) // 8
    for r in merged.toLocalIterator():
        out[r["segment"] * step : (r["segment"] + 1) * step] = np.frombuffer(r["repeated"], dtype=np.uint8)
    return out


def repeated(items: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    """Whether the sketch estimates two documents or more for each item."""
    out = np.ones(len(items), dtype=bool)
    for place in _places(items, bits):
        out &= (bitmap[(place >> _U64(3)).astype(np.int64)] >> (7 - (place & _U64(7)).astype(np.uint8)) & 1).astype(bool)
    return out


def _keys(words: np.ndarray, which: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    k1 = window_hashes(words, size, 0xD6E8FEB86659FD93)[which].view(np.int64)
    k2 = (window_hashes(words, size, 0xC2B2AE3D27D4EB4F)[which] >> _U64(32)).astype(np.uint32).view(np.int32)
    return k1, k2


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    names, types = zip(*(x.split() for x in schema.split(", ")))
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types)], names=list(names))


def _inside(batch: pa.RecordBatch, bitmap: np.ndarray) -> np.ndarray:
    """Which rows the filter over ids (places in column 2, null where the id is) lets through."""
    place = np.nan_to_num(batch.column(2).to_numpy(zero_copy_only=False)).astype(np.int64)
    at = np.maximum(place - 1, 0)
    return (place > 0) & (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _named(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.when(F.col("doc_id").isNotNull(), filter_place("doc_id")).alias("place"))


def probe(docs: DataFrame, bitmap, bits: int, size: int = SIZE, only=None) -> DataFrame:
    """KEYS: the windows estimated repeated of each text that has some. A text that waits has null keys, unless it is one of
    ``only`` (a filter over ids), which then are the only ones looked at."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, map_ = WordHashes(), bitmap.value
        for whole in batches:
            if only is not None:
                whole = whole.filter(pa.array(_inside(whole, only.value)))
            for batch in pieces(whole, 4 << 20):
                out = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    data = (text.as_py() or "").encode()
                    split = data.split()
                    if doc is None or len(split) < size:
                        continue
                    words = hashes(split)
                    h1, h2 = _whole(data)
                    if only is None and repeated(np.array([h1], dtype=np.int64).view(_U64), map_, bits)[0]:
                        out.append((doc, h1, h2, None, None, None))
                        continue
                    which = np.flatnonzero(repeated(minimisers(words, size), map_, bits))
                    if len(which):
                        out.append((doc, h1, h2, *_keys(words, which, size), which + _row(h1)))
                yield _table(out, KEYS)

    return _named(docs).mapInArrow(rows, KEYS)


def _exploded(keys: DataFrame) -> DataFrame:
    return keys.select("doc_id", F.explode(F.arrays_zip("k1", "k2", "at")).alias("w")).select("doc_id", "w.k1", "w.k2", "w.at")


def remove_repeats(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, max_bits: int = 1 << 31
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text): kept_text is null where nothing was removed."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    context = spark.sparkContext
    bits = bits_for(docs.agg(F.sum(F.length("text"))).head()[0] or 0, max_bits)
    bitmap = context.broadcast(collected(sketch(docs, bits, size), bits))
    passed = keep(spark, probe(docs, bitmap, bits, size))

    waiting = passed.where("k1 is null").select("doc_id", "h1", "h2")
    classes = waiting.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    named = keep(spark, counted_join(waiting, keep(spark, classes), ["h1", "h2"], "n"))
    firsts = named.where("doc_id = first").select("doc_id", "h1", "h2").distinct()
    first_ids = context.broadcast(id_filter(firsts.select(F.col("doc_id").alias("id"))))
    of_firsts = probe(docs, bitmap, bits, size, first_ids).dropDuplicates(["doc_id", "h1", "h2"]).join(firsts, ["doc_id", "h1", "h2"], "left_semi")
    windows = _exploded(passed.where("k1 is not null")).unionByName(_exploded(keep(spark, of_firsts)))

    least = windows.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    least = keep(spark, least.where("first < last").drop("last"))
    losers = counted_join(windows, least, ["k1", "k2"], "n").where("doc_id > first").select("doc_id", "at")
    tag = F.shiftleft(F.col("h1").bitwiseAND(F.lit(0x7FFFFFF)), 36)
    copies = named.where("doc_id > first").select("doc_id", tag.bitwiseOR(F.lit(_ALL)).alias("at"))
    gone = keep(spark, losers.unionByName(copies).groupBy("doc_id").agg(F.collect_set("at").alias("gone")))
    lost = context.broadcast(id_filter(gone.select(F.col("doc_id").alias("id"))))

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            carried = _inside(whole, lost.value)
            at = 0
            for batch in pieces(whole, 4 << 20):
                out = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if carried[at]:
                        out.append((doc, None, None, None, text.as_py() or ""))
                    else:
                        split = (text.as_py() or "").encode().split()
                        out.append((doc, len(split), 0, _sha(split), None))
                    at += 1
                yield _table(out, CUT)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 4 << 20):
                out = []
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    *done, text, places = row
                    if text is None:
                        out.append((*done, None))
                        continue
                    data = text.encode()
                    split = data.split()
                    tag = _row(_whole(data)[0])
                    at = np.array([p - tag for p in places or () if p >> 36 == tag >> 36], dtype=np.int64)
                    cover = np.zeros(len(split) + 1, dtype=np.int64)
                    if (at == _ALL).any():
                        cover[0] = 1
                    else:
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + size, -1)
                    kept = [w for w, x in zip(split, np.cumsum(cover[:-1]) > 0) if not x]
                    n = len(split) - len(kept)
                    out.append((done[0], len(split), n, _sha(kept), b" ".join(kept).decode() if n else None))
                yield _table(out, CUT)

    scanned = _named(docs).mapInArrow(finish, CUT)
    return scanned.join(gone, "doc_id", "left").select(*[x.split()[0] for x in CUT.split(", ")], "gone").mapInArrow(cut, CUT)


def digest(cut: DataFrame) -> DataFrame:
    return cut.select("doc_id", "n_words", "n_removed", "kept_sha256")
