"""License scans: fuzzy search for short notices.

A notice of m characters that is found with at most k edits has one of any k + 1 disjoint parts of it unharmed (the
pigeonhole principle). So every notice is split into k + 1 parts; an Aho-Corasick automaton of all parts finds their exact
places in one pass over the text; and round each place the regex library's bounded-error matching decides whether the whole
notice stands there with at most k edits, and where. Texts are compared as lower-case words joined by single blanks, so
line breaks, comment signs and punctuation don't count as edits.

Exact places of the four base phrases are counted on their own and never lost.

Edge cases: null or empty texts have no words and no spans (score 0). Rows are judged one by one, so null and repeated ids
are harmless. An empty table gives an empty result. Only the two named columns are read. Matches begin and end at word ends;
those of one notice are taken from the left and don't overlap, each improved in place to its fewest edits: the same as the
pattern run over the whole text. The phrase "cc by" is too short for an edit and is found exactly, as a base phrase.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegraph.llm.common import pieces

BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Short notices (lower case words) and what they license.
NOTICES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "mit license": "mit",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "licensed under the apache license version 2 0": "apache",
    "apache license version 2 0": "apache",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "licensed under cc by": "cc-by",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "spdx license identifier": "spdx",
    "all rights reserved": "proprietary",
    "this work is dedicated to the public domain": "public-domain",
}
SPANS = "array<struct<label:string,notice:string,start:long,end:long,edits:int>>"
FOUND = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, spans {SPANS}"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def max_edits(notice: str) -> int:
    """Edits a notice may have: one in ten characters, at most four."""
    return min(4, len(notice) // 10)


def split(notice: str, parts: int) -> list[tuple[int, str]]:
    """The notice cut into ``parts`` disjoint parts of near-equal length, with their places."""
    cuts = [len(notice) * i // parts for i in range(parts + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    """Compiled once per task: the automaton of all parts and a bounded-error pattern per notice."""

    def __init__(self, notices: dict[str, str] = NOTICES) -> None:
        import ahocorasick
        import regex

        self.notices = [(n, label, max_edits(n)) for n, label in notices.items()]
        self.patterns = [regex.compile(f"(?e)(?<![^ ])(?:{regex.escape(n)}){{e<={k}}}(?![^ ])") for n, _, k in self.notices]
        places: dict[str, list[tuple[int, int]]] = {}
        for i, (n, _, k) in enumerate(self.notices):
            for at, part in split(n, k + 1):
                places.setdefault(part, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for part, where in places.items():
            self.automaton.add_word(part, (len(part), where))
        self.automaton.make_automaton()

    def candidates(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """For each notice, the merged regions in which it could stand (with some characters beyond its ends)."""
        found: dict[int, set[tuple[int, int]]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for i, at in where:
                n, _, k = self.notices[i]
                begin = end + 1 - size - at
                found.setdefault(i, set()).add((max(0, begin - k - 2), min(len(text), begin + len(n) + 2 * k + 2)))
        merged: dict[int, list[tuple[int, int]]] = {}
        for i, regions in found.items():
            own = merged[i] = []
            for a, b in sorted(regions):
                if own and a <= own[-1][1]:
                    own[-1] = own[-1][0], max(b, own[-1][1])
                else:
                    own.append((a, b))
        return merged

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(start, end, edits, notice) of the verified places, by start."""
        regions = ((i, a, b) for i, own in self.candidates(text).items() for a, b in own)
        return sorted((m.start(), m.end(), sum(m.fuzzy_counts), i) for i, a, b in regions for m in self.patterns[i].finditer(text, a, b))


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, str, np.ndarray]:
    """Word starts and word ends (bytes), the words joined by blanks, and the byte at which each joined byte stands."""
    low = _LOWER[np.frombuffer(data, dtype=np.uint8)]
    inside = _WORD[low]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    stays = inside.copy()
    stays[ends[ends < len(low)]] = True  # one separator after each word
    at = np.flatnonzero(stays)
    joined = low[at]
    joined[~inside[at]] = 32
    return starts, ends, joined.tobytes().decode(), at


def base_places(text: str, starts: np.ndarray, at: np.ndarray) -> list[tuple[int, str]]:
    """(word number, label) of every base phrase; text: joined words, all ASCII comparisons on its bytes."""
    data, out = text.encode(), []
    for phrase, label in BASE.items():
        want, i = phrase.encode(), -1
        while (i := data.find(want, i + 1)) >= 0:
            if (i == 0 or data[i - 1] == 32) and (i + len(want) == len(data) or data[i + len(want)] == 32):
                out.append((int(np.searchsorted(starts, at[i])), label))
    return out


def scan_text(text: str | None, scanner: Scanner) -> tuple:
    """The row of one text after doc_id (FOUND); spans in code points of the text, end exclusive."""
    data = (text or "").encode()
    if not data:
        return 0, 0, None, None, "", []
    starts, ends, joined, at = words_of(data)
    base = base_places(joined, starts, at)
    spans = []
    hits = scanner.matches(joined)
    if hits:
        raw = np.frombuffer(data, dtype=np.uint8)
        point = np.cumsum((raw & 0xC0) != 0x80) - 1  # code point of each byte
        head = np.frombuffer(joined.encode(), dtype=np.uint8)
        byte = np.flatnonzero((head & 0xC0) != 0x80)  # byte of each joined code point
        for a, b, edits, i in hits:
            while a < b and joined[a] == " ":
                a += 1
            while b > a and joined[b - 1] == " ":
                b -= 1
            if a < b:
                n, label, _ = scanner.notices[i]
                spans.append({"label": label, "notice": n, "start": int(point[at[byte[a]]]), "end": int(point[at[byte[b - 1]]]) + 1, "edits": edits})
    numbers = [w for w, _ in base]
    return (
        len(starts), len(base), min(numbers, default=None), max(numbers, default=None),
        ",".join(sorted({x for _, x in base})), spans,
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, str] = NOTICES) -> DataFrame:
    """Base counts and verified notice spans of every text; one narrow pass."""
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "spans"]
    span = pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))
    kinds = [pa.int64()] * 4 + [pa.string(), span]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices)
        for whole in batches:
            for batch in pieces(whole):
                found = [scan_text(x.as_py(), scanner) for x in batch.column(1)]
                columns = list(zip(*found)) if found else [()] * 6
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(rows, FOUND)


def digest(found: DataFrame) -> DataFrame:
    """labels: base labels and those of the spans; score: 1 for an exact place, else the best span's share of unharmed characters."""
    base = F.filter(F.split("base_labels", ","), lambda x: x != "")
    labels = F.array_sort(F.array_distinct(F.concat(base, F.transform("spans", lambda s: s["label"]))))
    best = F.array_max(F.transform("spans", lambda s: 1 - s["edits"] / F.length(s["notice"])))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
        F.size("spans").alias("n_spans"),
    )
