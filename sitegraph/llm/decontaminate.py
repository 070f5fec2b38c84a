"""Benchmark decontamination by SimHash windows.

For every benchmark item of n words, each window of n words of a document may be a leak. Windows and items have 64-bit
SimHash fingerprints of their five-word shingles. The fingerprint is split into four blocks of 16 bits; two fingerprints
within ``radius`` bits agree in some block within radius // 4 (pigeonhole). So for each item size and block an index maps a block
value to the items whose block is within that distance; the four lists of a window's block values hold every item within the
radius, and only their members are looked at. Candidates are verified exactly: the weighted Jaccard similarity of the two
shingle multisets (weights: occurrences) must be at least ``similarity``.

A window of that similarity has a shingle of the item, so only windows that hold one are fingerprinted at all (a sorted array
of the benchmark's shingles finds them; nothing is lost by it).

The radius bounds fingerprints, the similarity texts: a window just over 0.8 differs by 10 of 64 bits on average, with a
deviation of about 3, so some one in a thousand of windows at the very bound lies beyond 20 bits in one alignment.

A document shorter than an item is one window as a whole, whatever its fingerprint: its shingles are compared with the item's.

Words are lower-cased and stripped of marks at their ends; words of marks alone don't count. The benchmark is the stated
query set: it is read in blocks of at most ``block_words`` words, each broadcast (so with a fixed bound) and searched in all
documents.

Edge cases: null or empty texts and items of fewer than five words have no shingles and match nothing. Rows with null or
repeated doc_id are searched one by one; repeated items each report. Of windows of equal similarity the first counts. Empty
tables give empty results (an empty benchmark: no leak). Only the named columns are read; ``keep_clean`` passes all through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegraph.llm.common import mix, pieces, window_hashes
from sitegraph.llm.simhash_dedup import words_of

SHINGLE = 5
FOUND = "doc_id long, item_id long, start_word long, n_words long, hamming int, similarity double"
_U64 = np.uint64
_BITS = 22
_ENDS = bytes(b for b in range(128) if not chr(b).isalnum())


class Words:
    """64-bit hashes of normalised words, remembered up to a bound; words without a letter or digit are left out."""

    def __init__(self, most: int = 400_000) -> None:
        self.most, self.known = most, {}

    def __call__(self, text: str | None) -> np.ndarray:
        import xxhash

        known = self.known
        if len(known) > self.most:
            known.clear()
        split = (text or "").encode().split()
        out = [known.get(w) for w in split]
        if None in out:
            for i, h in enumerate(out):
                if h is None:
                    w = split[i]
                    if (h := known.get(w)) is None:
                        core = w.decode().lower().encode().strip(_ENDS)
                        h = known[w] = (xxhash.xxh3_64_intdigest(core) | 1) if core else 0
                    out[i] = h
        found = np.array(out, dtype=_U64)
        return found[found != 0]

    def of_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The words' hashes of all texts, one text after another, and where each begins (and the last ends): each distinct word
        of the batch is hashed once."""
        import xxhash

        words = words_of(texts)
        n = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        cores = (w.lower().encode().strip(_ENDS) for w in coded.dictionary.to_pylist())
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(c) | 1 if c else 0 for c in cores), _U64, len(coded.dictionary))
        found = hashes[coded.indices.to_numpy()]
        real = found != 0
        return found[real], np.concatenate([[0], np.cumsum(real)])[np.concatenate([[0], np.cumsum(n)])]


def simhash(counts: np.ndarray) -> np.ndarray:
    """Fingerprints from rows of signed sums (one per bit)."""
    return np.packbits(counts > 0, axis=1, bitorder="little").view("<u8").reshape(-1)


def signs(shingles: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(mix(shingles).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


class Blocks:
    """The multi-index of one item size: block values to the items (numbers within the size) near them. Lists are made when
    first asked for and remembered up to ``most`` entries in all."""

    def __init__(self, fps: np.ndarray, distance: int, most: int = 4_000_000) -> None:
        self.blocks = [((fps >> _U64(16 * b)) & _U64(0xFFFF)).astype(np.uint16) for b in range(4)]
        self.distance, self.most, self.held, self.known = distance, most, 0, {}

    def near(self, block: int, value: int) -> np.ndarray:
        found = self.known.get((block, value))
        if found is None:
            found = np.flatnonzero(np.bitwise_count(self.blocks[block] ^ np.uint16(value)) <= self.distance)
            if self.held > self.most:
                self.known, self.held = {}, 0
            self.known[block, value] = found
            self.held += len(found) + 16
        return found

    def candidates(self, fp: int) -> np.ndarray:
        """Every item within 4 * distance + 3 bits of the fingerprint is among them."""
        lists = [self.near(b, fp >> 16 * b & 0xFFFF) for b in range(4)]
        return np.unique(np.concatenate(lists))


class Index:
    """One block of the benchmark, ready to search texts. Built anew in each task from the items, as flat arrays."""

    def __init__(self, items: list[tuple[int | None, str | None]], radius: int = 20, similarity: float = 0.8) -> None:
        self.items, self.radius, self.similarity = items, radius, similarity
        self._ready = False

    def __getstate__(self) -> dict:
        return {"items": self.items, "radius": self.radius, "similarity": self.similarity}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def _build(self) -> None:
        self.words, self._ready = Words(), True
        self.ids: list[int | None] = []
        self.bags: list[tuple[np.ndarray, np.ndarray]] = []
        fps, sizes = [], []
        for item, text in self.items:
            words = self.words(text)
            if len(words) < SHINGLE:
                continue
            own = window_hashes(words, SHINGLE)
            self.ids.append(item)
            self.bags.append(np.unique(own, return_counts=True))
            fps.append(simhash(signs(own).sum(axis=0, keepdims=True))[0])
            sizes.append(len(words))
        if not self.ids:
            return
        fps, sizes = np.array(fps, dtype=_U64), np.array(sizes)
        self.sizes = {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes)}
        self.fps = {n: fps[own] for n, own in self.sizes.items()}
        self.blocks = {n: Blocks(own, self.radius // 4) for n, own in self.fps.items()}
        # The sizes of the items that hold a shingle: pairs sorted by shingle.
        pairs = np.stack([np.concatenate([b for b, _ in self.bags]), np.repeat(sizes, [len(b) for b, _ in self.bags]).astype(_U64)])
        pairs = np.unique(pairs, axis=1)
        self.shingles, self.begins = np.unique(pairs[0], return_index=True)
        self.ends, self.holders = np.append(self.begins[1:], pairs.shape[1]), pairs[1].astype(np.int64)
        self.bitmap = np.zeros(1 << _BITS, dtype=bool)
        self.bitmap[self.shingles & _U64((1 << _BITS) - 1)] = True

    def search(self, text: str | None) -> list[tuple[int | None, int, int, int, float]]:
        """(item, first word, words, Hamming distance, similarity): for each leaked item its best window."""
        if not self._ready:
            self._build()
        if not text or not self.ids:
            return []
        return self._search(self.words(text))

    def search_all(self, texts: pa.Array) -> list[list[tuple[int | None, int, int, int, float]]]:
        """``search`` of each text: a batch's shingles are looked up together, and only texts that hold one are searched."""
        if not self._ready:
            self._build()
        out: list[list[tuple]] = [[] for _ in range(len(texts))]
        if not len(texts) or not self.ids:
            return out
        words, at = self.words.of_batch(texts)
        places, _ = self._held(window_hashes(words, SHINGLE))  # those that run into the next text are sorted out below
        for i in np.unique(np.searchsorted(at, places, side="right") - 1).tolist():
            out[i] = self._search(words[at[i] : at[i + 1]])
        return out

    def _held(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the benchmark's shingles stand, and which they are."""
        hits = np.flatnonzero(self.bitmap[own & _U64((1 << _BITS) - 1)])
        at = np.minimum(np.searchsorted(self.shingles, own[hits]), len(self.shingles) - 1)
        real = self.shingles[at] == own[hits]
        return hits[real], at[real]

    def _search(self, words: np.ndarray) -> list[tuple[int | None, int, int, int, float]]:
        if len(words) < SHINGLE:
            return []
        own = window_hashes(words, SHINGLE)
        near: dict[int, list[int]] = {}
        for p, k in zip(*(x.tolist() for x in self._held(own))):
            for n in self.holders[self.begins[k] : self.ends[k]].tolist():
                near.setdefault(n, []).append(p)
        found = []
        for n, places in near.items():
            m = n - SHINGLE + 1
            if len(own) < m:
                found += self._whole(own, n)
                continue
            live = np.zeros(len(own) + 1, dtype=np.int32)
            for p in places:
                live[max(0, p - m + 1)] += 1
                live[p + 1] -= 1
            starts = np.flatnonzero(np.cumsum(live[: len(own) - m + 1]) > 0)
            found += self._compare(own, starts, n, m)
        return sorted(found, key=lambda f: (f[0] is None, f[0] or 0, f[1]))

    def _alike(self, bag: tuple[np.ndarray, np.ndarray], k: int) -> float:
        """Weighted Jaccard similarity of a bag of shingles (values, counts) and an item's."""
        (x, n), (y, m) = bag, self.bags[k]
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        same = y[at] == x
        both = int(np.minimum(n[same], m[at[same]]).sum())
        return both / (int(n.sum()) + int(m.sum()) - both)

    def _whole(self, own: np.ndarray, n: int) -> list[tuple]:
        """A text shorter than the items of n words is one window as a whole; all such items are compared with it."""
        m, out, bag = n - SHINGLE + 1, [], None
        if len(own) < self.similarity * m:
            return out
        for k in self.sizes[n].tolist():
            bag = bag or np.unique(own, return_counts=True)
            alike = self._alike(bag, k)
            if alike >= self.similarity:
                fp = simhash(signs(own).sum(axis=0, keepdims=True))[0]
                far = int(np.bitwise_count(fp ^ self.fps[n][np.searchsorted(self.sizes[n], k)]))
                out.append((self.ids[k], 0, len(own) + SHINGLE - 1, far, alike))
        return out

    def _compare(self, own: np.ndarray, starts: np.ndarray, n: int, m: int) -> list[tuple]:
        best: dict[int, tuple] = {}
        index, item_fps, numbers = self.blocks[n], self.fps[n], self.sizes[n]
        for part in np.split(starts, np.flatnonzero(np.diff(starts >> 12)) + 1) if len(starts) else ():
            low = int(part[0])
            sums = np.zeros((int(part[-1]) - low + m + 1, 64), dtype=np.int32)
            np.cumsum(signs(own[low : int(part[-1]) + m]), axis=0, out=sums[1:])
            fps = simhash(sums[part - low + m] - sums[part - low])
            for start, fp in zip(part.tolist(), fps.tolist()):
                maybe = index.candidates(fp)
                far = np.bitwise_count(_U64(fp) ^ item_fps[maybe])
                inside = np.flatnonzero(far <= self.radius)
                if not len(inside):
                    continue
                bag = np.unique(own[start : start + m], return_counts=True)
                for i in inside.tolist():
                    k = int(numbers[maybe[i]])
                    alike = self._alike(bag, k)
                    if alike >= self.similarity and (k not in best or alike > best[k][4]):
                        best[k] = (self.ids[k], start, n, int(far[i]), alike)
        return list(best.values())


def blocks(benchmark: DataFrame, block_words: int = 2_000_000, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple]]:
    """The benchmark in blocks of bounded size (never all of it at once)."""
    held, words = [], 0
    for r in benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).toLocalIterator():
        held.append((r["i"], r["t"]))
        words += len((r["t"] or "").split())
        if words >= block_words:
            yield held
            held, words = [], 0
    if held:
        yield held


def leaks(docs: DataFrame, benchmark: DataFrame, radius: int = 20, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", **block: int) -> DataFrame:
    """FOUND: a row for each document and leaked item. One narrow pass for each block of the benchmark."""
    wanted = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    names = [x.split()[0] for x in FOUND.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.int32(), pa.float64()]

    def search(items: list[tuple]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, radius, similarity)
            for whole in batches:
                for batch in pieces(whole, 4 << 20):
                    out = [(doc.as_py(), *f) for doc, found in zip(batch.column(0), index.search_all(batch.column(1))) for f in found]
                    columns = list(zip(*out)) if out else [()] * len(names)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        return wanted.mapInArrow(rows, FOUND)

    out = docs.sparkSession.createDataFrame([], FOUND)
    for n, items in enumerate(blocks(benchmark, **block)):
        found = search(items)
        out = found if n == 0 else out.unionByName(found)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, radius: int = 20, similarity: float = 0.8, text_col: str = "text", **block: int) -> DataFrame:
    """The rows, with all their columns, in which no item is found."""
    for items in blocks(benchmark, **block):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def rows(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, radius, similarity)
            for whole in batches:
                for batch in pieces(whole, 4 << 20):
                    yield batch.filter(pa.array([not x for x in index.search_all(batch.column(text_col))], pa.bool_()))

        docs = docs.mapInArrow(rows, docs.schema)
    return docs


def digest(found: DataFrame) -> DataFrame:
    return found.withColumn("similarity", F.round("similarity", 6))
