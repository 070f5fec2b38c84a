"""Toxicity: a logistic classifier regularised by counterfactual identity swaps.

A text is the set of its words; a word has features (itself and its beginnings of 3 to 6 letters, so that inflected forms
share evidence). Counts over the training rows pick the features that tell labels apart, and a sparse logistic model is
fitted to them. Each training text has a counterfactual pair: where it names groups, itself and its twin with each identity
term exchanged for the next of its family; where it names none, a mention of a group is put in, and the pair is the text with
that term and with the next of its family (or, for every other text, without the mention). The loss adds ``penalty`` times the
squared change of the logit within pairs. So a group's name, and what it shares with other words (their beginnings), can't
carry weight of its own, and neutral mentions of a group aren't taken for abuse. Labels are never invented: a pair enters the
penalty alone.

Training rows: the labelled documents whose crc32(doc_id as text) mod 3 is not 1, at most ``sample_rows`` of them (those of
least hash; a documented bound, enough for a model of ``max_features`` weights; of several texts under one doc_id the one of
least hash). Features are counted on executors; the
driver gets the chosen features and, per training row, the numbers of those it has.

Edge cases: null and empty texts get the model's base score. Null labels aren't learned from; of several labels of one
document the highest counts. Without both labels among the training rows nothing can be told: every score is 0.5. Rows with
null or repeated doc_id are scored one by one (a null id isn't held out, nor learned from). An empty table gives an empty
result. Only the named columns are read by ``score``; ``keep_clean`` passes all columns through.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegraph.llm.common import keep, pieces

#: Families of identity terms; a swap stays within a family (and its grammatical number).
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants", "sikhs"),
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("female", "male"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "transgender", "heterosexual", "homosexual"),
    ("black", "white", "asian", "latino", "hispanic", "african", "european", "arab", "indigenous"),
    ("blacks", "whites", "asians", "latinos", "hispanics", "africans", "europeans", "arabs"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("immigrant", "refugee", "foreigner", "native", "citizen"),
    ("old", "young"), ("elderly", "youth"), ("disabled", "blind", "deaf"),
    ("mexican", "american", "chinese", "indian", "german", "french", "spanish", "russian", "turkish"),
    ("frauen", "männer"), ("frau", "mann"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("femme", "homme"),
    ("musulmans", "chrétiens", "juifs"), ("mujeres", "hombres"), ("mujer", "hombre"), ("musulmanes", "cristianos", "judíos"),
)
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features(word: str) -> list[str]:
    return [word, *(word[:k] + "~" for k in range(3, min(7, len(word))))]


def twin(words: set[str], families: tuple = IDENTITY) -> set[str]:
    """The words with each identity term exchanged for the next of its family."""
    swap = {t: f[(i + 1) % len(f)] for f in families for i, t in enumerate(f)}
    return {swap.get(w, w) for w in words}


def counterfactual(words: set[str], families: tuple = IDENTITY) -> tuple[set[str], set[str]]:
    """Two texts that differ in the groups named alone: the penalty is on the difference of their scores."""
    other = twin(words, families)
    if other != words:
        return words, other
    terms = [(f[i], f[(i + 1) % len(f)]) for f in families for i in range(len(f))]
    way, at = divmod(zlib.crc32(_marks(words).encode()), len(terms))
    term, swapped = terms[at]
    return words | {term}, words | {swapped} if way % 2 else words


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


#: Latin-1 characters as letters of words in lower case, all others as blanks.
_LETTERS = bytes(ord(c.lower()) if _WORD.match(c.lower()) else 32 for c in map(chr, range(256)))
#: What of eight bytes is a word's beginning of up to 7 letters, by its length.
_HEADS = np.array([(1 << 8 * k) - 1 for k in range(8)], dtype=np.uint64)


def _head(word: str) -> int:
    """A word's beginning of up to 7 letters, in Latin-1, as a number."""
    return int.from_bytes(word.encode("latin-1")[:7], "little")


class _Ranks:
    """Sorted numbers of words or beginnings with the ranks of their features."""

    def __init__(self, found: dict[int, int], none: int) -> None:
        self.none = none
        self.heads = np.array(sorted(found), dtype=np.uint64)
        self.ranks = np.array([found[h] for h in sorted(found)], dtype=np.int64)

    def __call__(self, heads: np.ndarray) -> np.ndarray:
        """The rank of each, or ``none``."""
        if not len(self.heads):
            return np.full(len(heads), self.none)
        at = np.minimum(np.searchsorted(self.heads, heads), len(self.heads) - 1)
        return np.where(self.heads[at] == heads, self.ranks[at], self.none)


class Model:
    """Weights of features; a text's logit is the bias and the weights of the distinct features it has."""

    def __init__(self, weights: dict[str, float], bias: float) -> None:
        self.weights, self.bias = weights, bias
        self._known: dict[str, tuple[str, ...]] = {}
        names = sorted(weights)
        self._by_rank = [weights[f] for f in names]
        # Of features that stand in Latin-1: beginnings by their length, words of up to 6 letters, and longer ones.
        ranks = {f: i for i, f in enumerate(names) if f and max(f) <= "\xff"}
        self._begins = {k: _Ranks({_head(f[:-1]): i for f, i in ranks.items() if f[-1] == "~" and len(f) == k + 1}, len(names)) for k in range(3, 7)}
        self._short = _Ranks({_head(f): i for f, i in ranks.items() if f[-1] != "~" and len(f) <= 6}, len(names))
        self._long = {f.encode("latin-1"): i for f, i in ranks.items() if f[-1] != "~" and len(f) > 6}
        self._long_heads = np.array([_head(w.decode("latin-1")) for w in self._long], dtype=np.uint64)

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "bias": self.bias}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def logit(self, words: set[str]) -> float:
        known, weights = self._known, self.weights
        if len(known) > 500_000:
            known.clear()
        found: set[str] = set()
        for w in words:
            own = known.get(w)
            if own is None:
                own = known[w] = tuple(f for f in features(w) if f in weights)
            if own:
                found.update(own)
        return self.bias + sum(weights[f] for f in sorted(found))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(words_of(text)), -40, 40))))

    def scores(self, texts: list[str | None]) -> list[float]:
        """``score`` of each text; those that Latin-1 holds are worked on together, in flat arrays of their words."""
        out, own, held = [0.0] * len(texts), [], []
        for i, text in enumerate(texts):
            try:
                held.append((text or "").encode("latin-1"))
                own.append(i)
            except UnicodeEncodeError:
                out[i] = self.score(text)
        for at in range(0, len(own), 2048):  # bounds the table of texts and features
            for i, logit in zip(own[at : at + 2048], self._logits(held[at : at + 2048])):
                out[i] = float(1 / (1 + np.exp(-np.clip(logit, -40, 40))))
        return out

    def _logits(self, held: list[bytes]) -> Iterator[float]:
        many = len(self._by_rank)
        joined = b" ".join([*held, bytes(8)]).translate(_LETTERS)
        inside = np.concatenate([[False], np.frombuffer(joined, dtype=np.uint8) != 32, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        begins, ends = edges[::2], edges[1::2]
        has = np.zeros((len(held), many + 1), dtype=bool)
        if len(begins):
            owner = np.searchsorted(np.cumsum([len(x) + 1 for x in held]), begins, side="right")
            eight = np.ndarray(len(joined) - 7, dtype="<u8", buffer=joined, strides=1)
            heads = pa.array(eight[begins] & _HEADS[np.minimum(ends - begins, 7)]).dictionary_encode()
            met, which = heads.dictionary.to_numpy(), heads.indices.to_numpy()
            flat, row = has.reshape(-1), owner * (many + 1)
            flat[row + self._short(met)[which]] = True
            for k, ranks in self._begins.items():
                longer = met >> np.uint64(8 * k) > 0
                flat[row + np.where(longer, ranks(met & _HEADS[k]), many)[which]] = True
            for w in np.flatnonzero(np.isin(met, self._long_heads)[which]).tolist():
                rank = self._long.get(joined[begins[w] : ends[w]])
                if rank is not None:
                    has[owner[w], rank] = True
        for row in has[:, :many]:
            yield self.bias + sum(map(self._by_rank.__getitem__, np.flatnonzero(row).tolist()))


def fit(
    rows: list[tuple[list[int], tuple[list[int], list[int]], int, float]], names: list[str], penalty: float = 1.0, decay: float = 2e-5, rounds: int = 400, rate: float = 0.1
) -> Model:
    """Fit to (feature numbers, those of the counterfactual pair, label, weight) rows: log loss + penalty x squared change of
    the logit within pairs."""
    weight = np.array([w for *_, w in rows])
    label = np.array([y for _, _, y, _ in rows], dtype=float)
    total = weight.sum()
    if not len(rows) or not names or len(set(label.tolist())) < 2:
        return Model({}, 0.0)
    share = float((weight @ label + 0.5) / (total + 1))
    bias = float(np.log(share / (1 - share)))

    def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        sizes = [len(x) for x in lists]
        return np.repeat(np.arange(len(lists)), sizes), np.fromiter((f for x in lists for f in x), dtype=np.int64, count=sum(sizes))

    (ro, fo), (ra, fa), (rb, fb) = flat([r[0] for r in rows]), flat([r[1][0] for r in rows]), flat([r[1][1] for r in rows])
    w, n = np.zeros(len(names)), len(rows)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for turn in range(1, rounds + 1):
        z = bias + np.bincount(ro, w[fo], n)
        gap = np.bincount(ra, w[fa], n) - np.bincount(rb, w[fb], n)
        pull = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label) / total
        push = 2 * penalty * weight * gap / total
        g = np.bincount(fo, pull[ro], len(w)) + np.bincount(fa, push[ra], len(w)) - np.bincount(fb, push[rb], len(w)) + decay * w
        gb = pull.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, b = 1 - 0.9**turn, 1 - 0.999**turn
        w -= rate * (m / a) / (np.sqrt(v / b) + 1e-8)
        bias -= rate * (mb / a) / (np.sqrt(vb / b) + 1e-8)
    return Model({k: float(x) for k, x in zip(names, w) if abs(x) > 1e-4}, float(bias))


def _marks(words: set[str]) -> str:
    """A name shared by texts of mostly equal words (three least hashes): copies weigh as one text in training."""
    return "-".join(map(str, sorted(zlib.crc32(w.encode()) for w in words)[:3]))


def train(
    docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, max_features: int = 4096, penalty: float = 1.0, label_col: str = "toxic"
) -> Model:
    """Learn from the labelled rows that aren't held out."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    known = known.where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # Bounded by sample_rows, so it may be broadcast.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # One text for each id, so the rows are bounded too, however often an id is repeated.
    one = texts.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("y", "text"), F.xxhash64("text")).alias("r"))
    rows = keep(spark, one.select("r.y", "r.text"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        hits: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64()), pa.array([hits[f] for f in seen], pa.int64())], names=["f", "n", "hits"]
            )
            seen.clear()
            hits.clear()
            return out

        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = {f for w in words_of(text.as_py()) for f in features(w)}
                seen.update(found)
                if y:
                    hits.update(found)
                if len(seen) > 500_000:
                    yield flush()
        yield flush()

    size = rows.agg(F.count("*").alias("n"), F.sum("y").alias("hits")).head()
    n, share = size["n"], (size["hits"] or 0) / max(size["n"], 1)
    if not n or not 0 < share < 1:
        return fit([], [])
    terms = sorted({t for family in IDENTITY for t in family})
    counted = rows.mapInArrow(count, "f string, n long, hits long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    gain = (F.col("hits") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    chosen = counted.where("n >= 3").withColumn("gain", F.abs(gain)).orderBy(F.desc("gain"), "f").limit(max_features).select("f")
    names = sorted({r["f"] for r in chosen.collect()} | {r["f"] for r in counted.where(F.col("f").isin(terms)).select("f").collect()} | set(terms))
    index = {f: i for i, f in enumerate(names)}

    def numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def numbers(words: set[str]) -> list[int]:
            return sorted({index[f] for w in words for f in features(w) if f in index})

        for batch in batches:
            sets = [words_of(x.as_py()) for x in batch.column(1)]
            pairs, kind = [counterfactual(s) for s in sets], pa.list_(pa.int32())
            lists = [[numbers(s) for s in sets], [numbers(a) for a, _ in pairs], [numbers(b) for _, b in pairs]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, kind) for x in lists), pa.array([_marks(s) for s in sets], pa.string())], names=["y", "own", "a", "b", "marks"]
            )

    found = rows.mapInArrow(numbered, "y int, own array<int>, a array<int>, b array<int>, marks string").collect()
    found.sort(key=lambda r: (r["marks"], r["y"], r["own"]))
    copies = Counter(r["marks"] for r in found)
    return fit([(r["own"], (r["a"], r["b"]), r["y"], 1 / copies[r["marks"]]) for r in found], names, penalty)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text; one narrow pass."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 2 << 20):
                found = model.scores(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(rows, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that score below the threshold."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 2 << 20):
                yield batch.filter(pa.array([x < threshold for x in model.scores(batch.column(text_col).to_pylist())], pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)


def digest(scored: DataFrame, threshold: float = 0.7) -> DataFrame:
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
