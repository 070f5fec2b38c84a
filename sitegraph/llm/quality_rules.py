"""Quality by weak supervision: rules vote or abstain, EM learns how far to trust each, and the posterior decides.

Base counts (over whole texts): words, code points in them, symbol characters, repeated lines and words covered by
8-word windows that occur twice. Each rule of RULES looks at a few of these figures and votes +1 (good), -1 (bad) or 0
(abstains). The votes of all documents are counted per pattern (at most 3**rules patterns, whatever the input), and
expectation-maximisation over those counts estimates each rule's accuracy on good and bad documents and the share of
good ones. A document's verdict is the posterior probability of good, at least ``threshold`` - not all rules passing.

Edge cases: null and empty texts have no words (base_failed). Rows with null or repeated doc_id are judged one by one. An
empty table gives an empty result. Only the two named columns are read. Ties between patterns can't arise: a pattern has
one posterior, so equal texts get equal verdicts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegraph.llm.common import SPACE, mix, pieces, window_hashes

COUNTS = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, "
    "n_caps long, n_letters long, n_distinct long, n_digits long, n_symbol_words long, n_bare_words long, n_marks long, n_stutters long"
)
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_MARK = np.zeros(256, dtype=bool)  # ASCII punctuation
_MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_REPEAT = 8


def repeated_words(ids: np.ndarray, size: int = _REPEAT) -> int:
    """How many words lie in windows of ``size`` words whose sequence occurs twice or more; ids: equal for equal words."""
    if len(ids) < size + 1:
        return 0
    _, which, count = np.unique(window_hashes(mix(ids.astype(np.uint64) + np.uint64(1)), size), return_inverse=True, return_counts=True)
    cover = np.zeros(len(ids) + 1, dtype=np.int64)
    hit = np.flatnonzero(count[which] > 1)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + size, -1)
    return int((np.cumsum(cover) > 0).sum())


def counts_of(text: str | None) -> tuple[int, ...]:
    """The figures of one text, in the order of COUNTS after doc_id."""
    data = (text or "").encode()
    raw = np.frombuffer(data, dtype=np.uint8)
    words = data.split()
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    inner = ~SPACE[raw]
    starts = np.flatnonzero(inner & ~np.concatenate([[False], inner[:-1]])) if words else np.zeros(0, dtype=np.int64)

    def words_with(kind: np.ndarray) -> int:
        return int((np.add.reduceat(kind.astype(np.int64), starts) > 0).sum()) if words else 0

    marks = _MARK[raw]
    lines, dup, seen = 0, 0, set()
    for line in data.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    upper = int(((raw >= 65) & (raw <= 90)).sum())
    lower = int(((raw >= 97) & (raw <= 122)).sum())
    points = int(((raw & 0xC0) != 0x80).sum())
    digits = int(((raw >= 48) & (raw <= 57)).sum())
    return (
        len(words), points - int(SPACE[raw].sum()), int(_SYMBOL[raw].sum()), dup, repeated_words(ids), lines,
        upper, upper + lower, len(known), digits,
        words_with(_SYMBOL[raw]), len(words) - words_with(inner & ~marks), int(marks.sum()), int((ids[1:] == ids[:-1]).sum()),
    )


def count_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The figures of every text; one narrow pass."""
    names = [x.split()[0] for x in COUNTS.split(", ")]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                found = [counts_of(x.as_py()) for x in batch.column(1)]
                columns = list(zip(*found)) if found else [()] * (len(names) - 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(rows, COUNTS)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """Each rule's vote over the counts: a clear figure is a vote, an in-between or missing one an abstention."""
    words, mean = F.col("n_words"), F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    symbols = F.col("n_symbols") / F.greatest(words, F.lit(1))
    repeats = F.col("n_repeat_words") / F.greatest(words, F.lit(1))
    dup = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    caps = F.col("n_caps") / F.greatest(F.col("n_letters"), F.lit(1))
    variety = F.col("n_distinct") / F.greatest(words, F.lit(1))
    digits, marks = (F.col(c) / F.greatest(F.col("word_chars"), F.lit(1)) for c in ("n_digits", "n_marks"))
    signed, bare, stutter = (F.col(c) / F.greatest(words, F.lit(1)) for c in ("n_symbol_words", "n_bare_words", "n_stutters"))
    enough = words >= 40
    return {
        "length": _vote(words.between(50, 50_000), words < 20),
        "word_length": _vote(mean.between(2.5, 10), (mean < 2) | (mean > 15)),
        "symbols": _vote(symbols <= 0.02, symbols > 0.15),
        "repeats": _vote(enough & (repeats <= 0.1), repeats > 0.3),
        "dup_lines": _vote((F.col("n_lines") >= 3) & (dup <= 0.1), dup > 0.3),
        "capitals": _vote((F.col("n_letters") >= 40) & (caps <= 0.15), (F.col("n_letters") >= 40) & (caps > 0.5)),
        "variety": _vote(enough & (words <= 2000) & (variety >= 0.3), enough & (words <= 2000) & (variety < 0.15)),
        "digits": _vote(enough & (digits <= 0.05), digits > 0.3),
        "symbol_words": _vote(enough & (signed <= 0.03), signed > 0.2),
        "bare_words": _vote(enough & (bare <= 0.03), bare > 0.1),
        "marks": _vote(enough & (marks <= 0.1), marks > 0.2),
        "stutter": _vote(enough & (stutter <= 0.02), stutter > 0.2),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200, prior: float = 0.85) -> dict:
    """EM over vote patterns and their counts: per rule and class, the probabilities of -1, 0 and +1; the share of good.

    Conditional independence given the class; the starting point (one vote against leaves a document good, two make it bad) and
    Laplace smoothing (one vote each, three in favour of the stated direction) fix which class is "good". Cost depends on the
    number of patterns alone.
    """
    if not patterns:
        return {"share": prior, "table": np.zeros((2, 0, 3))}
    votes = np.array([p for p, _ in patterns], dtype=np.int64) + 1
    weight = np.array([n for _, n in patterns], dtype=np.float64)
    n_rules = votes.shape[1]
    pseudo = np.ones((2, n_rules, 3))
    pseudo[0, :, 0] += 2
    pseudo[1, :, 2] += 2
    hot = np.eye(3)[votes]
    good = 1 / (1 + np.exp(2.0 * (votes == 0).sum(axis=1) - 3.0))
    share = prior
    for _ in range(rounds):
        part = np.stack([(1 - good) * weight, good * weight])
        table = pseudo + np.einsum("cp,prv->crv", part, hot)
        table /= table.sum(axis=2, keepdims=True)
        share = float((part[1].sum() + 1) / (weight.sum() + 2))
        new = posterior(votes - 1, {"share": share, "table": table})
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return {"share": share, "table": table}


def posterior(votes: np.ndarray, model: dict) -> np.ndarray:
    """Probability of good for each row of votes. An abstention says nothing (its likelihood ratio is left out)."""
    at = np.log(model["table"])
    ratio = at[1] - at[0]
    ratio[:, 1] = 0.0
    odds = np.log(model["share"] / (1 - model["share"])) + sum(ratio[r, votes[:, r] + 1] for r in range(votes.shape[1]))
    return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


def judge(counted: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The counts with the rules' votes, the posterior and the verdict; EM runs over all of ``counted``.

    The driver gets one row per vote pattern (3**12 at most, 531,441; those that occur are far fewer) and gives back a table of
    as many posteriors, so that may be broadcast.
    """
    named = rules()
    voted = counted.withColumns({f"vote_{k}": v for k, v in named.items()})
    # A pattern is one number in base 3: cheap to group by, and to look up.
    code = sum(((F.col(f"vote_{k}") + 1) * 3**i for i, k in enumerate(named)), F.lit(0)).cast("int")
    coded = voted.withColumn("pattern", code)
    seen = [(r["pattern"], r["n"]) for r in coded.groupBy("pattern").agg(F.count("*").alias("n")).collect()]
    votes = {c: tuple(c // 3**i % 3 - 1 for i in range(len(named))) for c, _ in seen}
    model = fit(sorted((votes[c], n) for c, n in seen))
    order = sorted(votes)
    good = posterior(np.array([votes[c] for c in order]), model).tolist() if order else []
    table = counted.sparkSession.createDataFrame(list(zip(order, good)), "pattern int, quality double")
    return (
        coded.join(F.broadcast(table), "pattern", "left")
        .withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("quality") >= threshold, F.lit(False)))
    )


def digest(judged: DataFrame) -> DataFrame:
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )
