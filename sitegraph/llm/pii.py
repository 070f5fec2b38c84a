"""Personal data: base patterns, and a linear-chain conditional random field over word-shape features.

The field is trained on the driver from a small labelled table (``pii_labels``, a few hundred rows, or rows of the same form
given by the caller) by gradient ascent on the exact conditional likelihood (forward-backward). Labels tell an entity's first
word from its later ones, so neighbouring entities part and an entity may have any number of words. A word's features are its
shape, its length, its marks and whether it is a cue word; those of its neighbours count too. Words with equal features share
a class, so decoding needs a class number per word.

A line is one chain, however long. Words that are outside any entity on every best path (any other label there loses against
putting the words round it outside too, whatever labels stand farther off) are settled at once; what remains between them is
decoded by Viterbi in numpy batches, with the settled words as its ends. This is the best path of the whole line. Words amid
plain lower-case ones are settled by their classes alone, before any scores are reckoned; plain words (letters, perhaps a
closing mark, no cue) get their class by form, from flat arrays of a batch's characters.

Base patterns (email, ip, card, phone) are matched leftmost and non-overlapping per kind over the whole text; matches that
fail their test are dropped without another try. The field's spans are added where they overlap no base span.

Edge cases: null and empty texts have no spans. Rows are judged one by one, so null and repeated ids are harmless. An empty
table gives an empty result. Extra columns are not read by ``find`` and pass unchanged through ``redact``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegraph.llm.common import pieces
from sitegraph.llm.pii_labels import labelled_table

#: Neighbours whose features count, by their distance.
NEAR = (-1, 1, -2)
BASE_KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"
CUES = frozenset(
    "mr mr. mrs mrs. ms ms. dr dr. herr frau contact name is call tel tel: phone phone: fax mobile mobile: token key api_key secret secret: "
    "password password: = : iban account account: ssn number address address: at to by lives street avenue road".split()
)
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Runs of digits are taken whole: a match can't begin or end inside one, so the result is that of the plain pattern in
# linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, number of the kind) by start, then kind."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end(), 0))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if any(c in text for c in "0123456789"):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), m.end(), 2))
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def shape(word: str) -> str:
    """X for capitals, x for other letters, d for digits, others themselves; runs count once."""
    if word.isalpha():
        return "x" if word.islower() else "X" if word.isupper() else "Xx" if word[1:].islower() else "xX"
    out = []
    for c in word[:64]:
        k = "d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out[:12])


def features(word: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """A word's own features, and those it lends its neighbours."""
    core = word.strip("\"'()[],;.!?#$%&*|")
    plain = core.isalpha()
    digits = 0 if plain else sum(c.isdigit() for c in core)
    letters = len(core) if plain else sum(c.isalpha() for c in core)
    low = word.lower().strip("\"'(),;") if len(word) < 12 else ""
    cue = low if low in CUES else ""
    size = min(len(core), 40) // 4
    ends = "!" if word[-1] in "!?#$%&*|" else "." if word[-1] in ".;" else "," if word[-1] == "," else ""
    own = ["1", f"shape={shape(core)}", f"end={ends}"]
    if not plain:
        own += [f"digits={min(digits, 12) // 2}", f"len={size}"]
        own += ["mixed"] if digits >= 2 and letters >= 2 else []
        own += ["long-mixed"] if len(core) >= 16 and digits >= 4 and letters >= 3 else []
    elif size >= 5:
        own.append("long")
    own += [f"cue={cue}"] if cue else []
    own += ["quoted"] if word[0] in "\"'" else []
    coarse = "d" if digits > letters else "X" if core[:1].isupper() else "x" if letters else "s"
    return tuple(own), (f"coarse={coarse}{ends}", "cue=" + cue)


#: Words of every plain form: letters in lower case, or after one capital, and at most one mark, which closes them.
PLAIN = [w + end for w in ("zz", "Zz") for end in ("", ".", ",", "!")]
_LOW, _CAPITAL, _END, _OTHER = 1, 2, 4, 8  # what a character is; white space is 0
_ENDS = {**dict.fromkeys(".;", 1), ",": 2, **dict.fromkeys("!?#$%&*|", 3)}
_WHAT = np.array(
    [
        0 if c.isspace() else _LOW if c.isalpha() and c.islower() else _CAPITAL if c.isalpha() and c.isupper() else _END if c in _ENDS else _OTHER
        for c in map(chr, range(256))
    ],
    dtype=np.uint8,
)
_WHICH_END = np.array([_ENDS.get(chr(c), 0) for c in range(256)], dtype=np.int8)
_LOWERED = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.int64)
_WIDE_SPACE = np.array([c for c in range(256, 0x3100) if chr(c).isspace()], dtype=np.uint32)
#: By a word's first two letters: a bit for the number of letters of each cue word that begins so.
_CUE_SIZES = np.zeros(1 << 16, dtype=np.uint32)
for _cue in (c.rstrip(".:").encode() for c in CUES):
    if len(_cue):
        _CUE_SIZES[_cue[0] << 8 | (_cue[1] if len(_cue) > 1 else 0)] |= 1 << len(_cue)


class Flat:
    """The words of texts joined by line ends, as flat arrays: begins and ends in ``joined``, the number of each word's line,
    and its form: a number in PLAIN, or -1 for words (cue words among them) whose features must be looked at."""

    def __init__(self, texts: list[str]) -> None:
        self.joined = "\n".join(texts)
        try:
            codes = np.frombuffer(self.joined.encode("latin-1"), dtype=np.uint8)
            what, breaks = _WHAT[codes], codes == 10
        except UnicodeEncodeError:
            wide = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
            codes, breaks = wide.astype(np.uint8), wide == 10
            what = np.where(wide < 256, _WHAT[codes], np.where(np.isin(wide, _WIDE_SPACE), 0, _OTHER)).astype(np.uint8)
        inside = np.concatenate([[False], what > 0, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.begins, self.ends = edges[::2], edges[1::2]
        line = np.cumsum(breaks, dtype=np.int32)
        self.line = line[self.begins].astype(np.int64)
        if not len(self.begins):
            self.form = np.zeros(0, dtype=np.int64)
            return
        final, lead = self.ends - 1, codes[self.begins]
        capital, closed = what[self.begins] == _CAPITAL, what[final] == _END
        end = np.where(closed, _WHICH_END[codes[final]], 0)
        what[self.begins[capital]] = _LOW
        what[final[closed]] = 0
        size = self.ends - self.begins - closed
        second = np.where(size > 1, codes[np.minimum(self.begins + 1, len(codes) - 1)], 0)
        cue = _CUE_SIZES[_LOWERED[lead] << 8 | _LOWERED[second]] >> np.minimum(size, 31).astype(np.uint32) & 1
        plain = (np.bitwise_or.reduceat(what, self.begins) == _LOW) & (size < 20) & (size > capital) & (cue == 0)
        self.form = np.where(plain, 4 * capital + end, -1).astype(np.int64)


class Field:
    """A trained field: labels, weights of features and of label pairs."""

    def __init__(self, labels: list[str], index: dict[str, int], weights: np.ndarray, step: np.ndarray, start: np.ndarray) -> None:
        self.labels, self.index, self.weights, self.step, self.start = labels, index, weights, step, start
        self._classes: dict[tuple, int] = {}
        self._known: dict[str, int] = {}
        self._own: list[np.ndarray] = []
        self._calm: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def _sum(self, names: list[str]) -> np.ndarray:
        rows = [self.index[n] for n in names if n in self.index]
        return self.weights[rows].sum(axis=0) if rows else np.zeros(len(self.labels))

    def classes(self, words: list[str]) -> np.ndarray:
        """The class of each word; what is remembered of words is bounded, classes are few."""
        known = self._known
        if len(known) > 500_000:
            known.clear()
        out = list(map(known.get, words))
        if None in out:
            for i, c in enumerate(out):
                if c is None and (c := known.get(words[i])) is None:
                    own, lent = features(words[i])
                    c = self._classes.get((own, lent))
                    if c is None:
                        c = self._classes[own, lent] = len(self._own)
                        lent_to = [self._sum([f"{k}:{f}" for f in lent]) for k in NEAR]
                        self._own.append(np.stack([self._sum(["0:" + f for f in own]), *lent_to]).astype(np.float32))
                    known[words[i]] = c
                out[i] = c
        return np.array(out, dtype=np.int64)

    def flat_classes(self, flat: Flat) -> np.ndarray:
        """The class of each word of a batch: plain words get theirs by form, only the others are looked at one by one."""
        of_form = self.classes(PLAIN)
        out = of_form[np.maximum(flat.form, 0)]
        rest = np.flatnonzero(flat.form < 0)
        joined = flat.joined
        out[rest] = self.classes([joined[a:b] for a, b in zip(flat.begins[rest].tolist(), flat.ends[rest].tolist())])
        return out

    def emissions(self, classes: np.ndarray, line: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Scores (words x labels), of the words ``at`` alone if given; line: the number of each word's line, over whose ends
        no neighbour counts."""
        table = np.stack(self._own)
        at = np.arange(len(classes)) if at is None else at
        out = table[classes[at], 0]
        for k, shift in enumerate(NEAR, 1):
            of = np.clip(at + shift, 0, len(classes) - 1)
            same = np.flatnonzero((line[of] == line[at]) & (of == at + shift))
            lent = np.ascontiguousarray(table[:, k])
            out[same] += lent[classes[of[same]]]
        return out

    def calm(self, turns: int = 1) -> np.ndarray:
        """Which classes (of those met so far) are outside on every best path wherever all words from ``turns + 2`` before to
        ``turns + 1`` after are of such classes: ``settled`` with the most that any of them could score as each score."""
        if self._calm is None:
            step, start = self.step.astype(np.float32), self.start.astype(np.float32)
            own = np.unique(self.classes(PLAIN))
            while len(own):
                table = np.stack([self._own[c] for c in own])
                table = table - table[:, :, :1]
                lead = table[:, 0] + np.maximum(table[:, 1:].max(axis=0), 0).sum(axis=0)  # at a line's end no neighbour counts
                most = lead.max(axis=0)
                left = (np.vstack([step, start]) - np.append(step[:, 0], start[0])[:, None]).max(axis=0)
                right = np.maximum((step - step[:1]).max(axis=1), 0)
                for _ in range(turns):
                    left = np.minimum(left, np.maximum(((left + most)[:, None] + step - step[0, 0]).max(axis=0), start - start[0]))
                    right = np.minimum(right, np.maximum((step + (right + most)[None] - step[0, 0]).max(axis=1), 0))
                slack = (lead + left + right)[:, 1:].max(axis=1)
                if slack.max() < -1e-2:
                    break
                own = np.delete(own, slack.argmax())  # without it the others' neighbours may score less
            self._calm = own
        out = np.zeros(len(self._own), dtype=bool)
        out[self._calm] = True
        return out

    def settled(self, scores: np.ndarray, first: np.ndarray, last: np.ndarray, after: np.ndarray, before: np.ndarray, turns: int = 2) -> np.ndarray:
        """Which words are outside on every best path: with any other label there, putting all words up to ``turns`` away
        outside scores more, whatever labels stand beyond them. first, last: a line's first and last words; after, before:
        words that follow, or come before, one that is left out as it is known to be outside."""
        step, start = self.step.astype(np.float32), self.start.astype(np.float32)
        n, lead = len(step), (scores - scores[:, :1]).T.copy()
        into = np.vstack([step, start])  # also as a line's first word
        out_of = np.hstack([step, np.zeros((n, 1), dtype=np.float32)])  # also as its last
        # What a label at a word can gain over "outside" by the labels before it, and by those after it.
        left = np.repeat((into - into[:, :1]).max(axis=0)[:, None], len(scores), axis=1)
        right = np.repeat((out_of - out_of[:1]).max(axis=1)[:, None], len(scores), axis=1)
        for _ in range(turns):
            for gain, to, of, pair, ends in (
                (left, slice(1, None), slice(None, -1), step, ((first, start - start[0]), (after, step[0] - step[0, 0]))),
                (right, slice(None, -1), slice(1, None), step.T, ((last, np.zeros(n, dtype=np.float32)), (before, step[:, 0] - step[0, 0]))),
            ):
                wide = (gain + lead)[:, of]
                new = np.full_like(gain, -np.inf)
                for k in range(n):
                    np.maximum(new[:, to], wide[k] + (pair[k] - step[0, 0])[:, None], out=new[:, to])
                for at, end in ends:
                    new[:, at] = end[:, None]
                np.minimum(gain, new, out=gain)
        return ((lead + left + right)[1:] < -1e-3).all(axis=0)

    def decode(self, scores: np.ndarray, begins: np.ndarray, sizes: np.ndarray, head: np.ndarray | None = None, tail: np.ndarray | None = None, cells: int = 1 << 20) -> np.ndarray:
        """The best label of each word of the chains: Viterbi, chains of similar length together, about ``cells`` words at a
        time (or one chain). head and tail: what each chain's first and last label score beside its words."""
        out = np.zeros(len(scores), dtype=np.int16)
        n, step = len(self.labels), self.step.astype(np.float32)
        head = np.tile(self.start, (len(begins), 1)) if head is None else head
        tail = np.zeros((len(begins), n)) if tail is None else tail
        order = np.argsort(sizes, kind="stable")
        a = 0
        while a < len(order):
            room = np.maximum.accumulate(sizes[order[a : a + 4096]]) * np.arange(1, len(order[a : a + 4096]) + 1)
            own = order[a : a + max(1, int(np.searchsorted(room, cells, side="right")))]
            a += len(own)
            begin, size = begins[own], sizes[own]
            most, ends = int(size.max()), tail[own].T.astype(np.float32)
            back = np.zeros((most, n, len(own)), dtype=np.int8)
            best = (scores[begin] + head[own].astype(np.float32)).T.copy()
            final = best + ends
            for t in range(1, most):
                at = int(np.searchsorted(size, t, side="right"))  # sizes rise: chains that go on are the tail
                best = best[:, best.shape[1] - (len(own) - at) :]
                new, from_ = best[0] + step[0][:, None], back[t, :, at:]
                for k in range(1, n):
                    way = best[k] + step[k][:, None]
                    better = way > new
                    np.copyto(new, way, where=better)
                    np.copyto(from_, np.int8(k), where=better)
                best = new + scores[begin[at:] + t].T
                final[:, at:] = best + ends[:, at:]
            label = final.argmax(axis=0)
            for t in range(most - 1, -1, -1):
                at = int(np.searchsorted(size, t, side="right"))
                live = label[at:]
                out[begin[at:] + t] = live
                if t:
                    label[at:] = back[t, live, np.arange(at, len(own))]
        return out

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) of the entities in a text."""
        return self.spans_of([text])[0]

    def spans_of(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        flat = Flat(texts)
        line, many = flat.line, len(flat.begins)
        if not many:
            return found
        classes = self.flat_classes(flat)
        stirs = np.concatenate([[0], np.cumsum(~self.calm()[classes])])
        at = np.arange(many)
        near = np.flatnonzero(stirs[np.minimum(at + 3, many)] > stirs[np.maximum(at - 3, 0)])  # all others are outside
        if not len(near):
            return found
        scores = self.emissions(classes, line, near)
        edge = np.diff(line, prepend=-1, append=line[-1] + 1) > 0
        first, last = edge[near], edge[near + 1]
        apart = np.diff(near, prepend=-2, append=many + 1) > 1
        after, before = apart[:-1] & ~first, apart[1:] & ~last
        outside = self.settled(scores, first, last, after, before)
        beside = np.concatenate([[False], outside, [False]])
        begins = np.flatnonzero(~outside & (first | after | beside[:-2]))
        ends = np.flatnonzero(~outside & (last | before | beside[2:]))
        if not len(begins):
            return found
        head = np.where(first[begins, None], self.start, self.step[0])
        tail = np.where(last[ends, None], 0, self.step[:, 0])
        labels = self.decode(scores, begins, ends - begins + 1, head, tail)
        hits = np.flatnonzero(labels)
        labels, hits = labels[hits], near[hits]
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        owners = np.searchsorted(starts, flat.begins[hits], side="right") - 1
        kinds = [x[2:] for x in self.labels]
        open_ = (-2, -1, "")
        places = (flat.begins[hits] - starts[owners], flat.ends[hits] - starts[owners])
        for at, k, i, y, a, b in zip(hits.tolist(), line[hits].tolist(), owners.tolist(), labels.tolist(), *(x.tolist() for x in places)):
            kind = kinds[y]
            if open_ == (at - 1, k, kind) and self.labels[y][0] == "I":
                found[i][-1] = found[i][-1][0], b, kind
            else:
                found[i].append((a, b, kind))
            open_ = at, k, kind
        return [[_trim(texts[i], *s) for s in own] for i, own in enumerate(found)]


def _trim(text: str, a: int, b: int, kind: str) -> tuple[int, int, str]:
    while a < b - 1 and text[a] in "\"'([":
        a += 1
    while b > a + 1 and text[b - 1] in "\"').,;:!?]#$%&*|":
        b -= 1
    return a, b, kind


def train(table: list[tuple[int, list[str], list[str]]] | None = None, rounds: int = 150, rate: float = 0.1, decay: float = 2e-3, most: int = 5000) -> Field:
    """Fit a field to (sentence, words, tags) rows, at most ``most`` of them (the labelled table is small by contract)."""
    rows = sorted(table or labelled_table())[:most]
    labels = ["O", *sorted({t for _, _, tags in rows for t in tags} - {"O"})]
    n, at = len(labels), {x: i for i, x in enumerate(labels)}
    names: dict[str, int] = {}
    longest = max(len(w) for _, w, _ in rows)
    gold = np.full((len(rows), longest), -1)
    used: list[list[list[int]]] = []
    for r, (_, words, tags) in enumerate(rows):
        gold[r, : len(tags)] = [at[t] for t in tags]
        feats = [features(w) for w in words]
        own = []
        for i in range(len(words)):
            x = ["0:" + f for f in feats[i][0]]
            x += [f"{k}:{f}" for k in NEAR if 0 <= i + k < len(words) for f in feats[i + k][1]]
            own.append([names.setdefault(f, len(names)) for f in x])
        used.append(own)
    flat = [(r, t, f) for r, own in enumerate(used) for t, fs in enumerate(own) for f in fs]
    fr, ft, ff = (np.array(x) for x in zip(*flat))
    live = gold >= 0
    params = [np.zeros((len(names), n)), np.zeros((n, n)), np.zeros(n)]
    mom = [[np.zeros_like(p), np.zeros_like(p)] for p in params]

    def lse(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)

    for turn in range(1, rounds + 1):
        w, step, start = params
        score = np.zeros((len(rows), longest, n))
        np.add.at(score, (fr, ft), w[ff])
        fwd, bwd = np.zeros_like(score), np.zeros_like(score)
        fwd[:, 0] = score[:, 0] + start
        for t in range(1, longest):
            fwd[:, t] = np.where(live[:, t, None], lse(fwd[:, t - 1][:, :, None] + step, 1) + score[:, t], fwd[:, t - 1])
        total = lse(fwd[:, -1], 1)
        for t in range(longest - 2, -1, -1):
            bwd[:, t] = np.where(live[:, t + 1, None], lse(step + (score[:, t + 1] + bwd[:, t + 1])[:, None, :], 2), 0)
        p = np.exp(fwd + bwd - total[:, None, None]) * live[:, :, None]
        grads = [np.zeros_like(x) for x in params]
        diff = -p
        r_, t_ = np.nonzero(live)
        diff[r_, t_, gold[r_, t_]] += 1
        np.add.at(grads[0], ff, diff[fr, ft])
        grads[2] += diff[:, 0].sum(axis=0)
        for t in range(1, longest):
            on = live[:, t]
            pair = np.exp(fwd[on, t - 1][:, :, None] + step + (score[on, t] + bwd[on, t])[:, None, :] - total[on][:, None, None])
            grads[1] -= pair.sum(axis=0)
            np.add.at(grads[1], (gold[on, t - 1], gold[on, t]), 1)
        for x, g, (m, v) in zip(params, grads, mom):
            g = g / len(rows) - decay * x
            m[:] = 0.9 * m + 0.1 * g
            v[:] = 0.99 * v + 0.01 * g * g
            x += rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return Field(labels, names, *params)


def merged(text: str, added: list[tuple[int, int, str]]) -> list[tuple[str, int, int, bool]]:
    """Base spans, and the added ones that overlap none of them, by start, then kind."""
    base = [(BASE_KINDS[k], a, b, True) for a, b, k in base_spans(text)]
    more = [(k, a, b, False) for a, b, k in added if all(b <= x or a >= y for _, x, y, _ in base)]
    rank = {k: i for i, k in enumerate(BASE_KINDS)}
    return sorted(base + more, key=lambda s: (s[1], rank.get(s[0], len(rank)), s[0]))


def find(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): all personal data of each text; one narrow pass."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 2 << 20):
                texts = [x.as_py() or "" for x in batch.column(1)]
                found = [[dict(zip(("kind", "start", "end", "base"), s)) for s in merged(t, a)] for t, a in zip(texts, field.spans_of(texts))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(rows, f"doc_id long, spans {SPANS}")


def redacted(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    out, at = [], 0
    for kind, a, b, _ in spans:
        if b <= at:
            continue
        out += [text[at : max(a, at)], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """The same rows and columns with every span replaced by its kind; size_col, where there, follows the text."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 2 << 20):
                texts = [x.as_py() for x in batch.column(text_col)]
                new = [t if t is None else redacted(t, merged(t, a)) for t, a in zip(texts, field.spans_of([t or "" for t in texts]))]
                columns = dict(zip(batch.schema.names, batch.columns))
                columns[text_col] = pa.array(new, batch.schema.field(text_col).type)
                if size_col in columns:
                    columns[size_col] = pa.array([None if t is None else len(t) for t in new], batch.schema.field(size_col).type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.mapInArrow(rows, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    def named(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))
