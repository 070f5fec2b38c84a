"""Packing by power-of-two decomposition.

Each document's token ids (with one closing id) are cut by the binary form of their count: as many pieces of
``max_len`` as fit, then one piece for each set bit of the rest, longest first. Every piece is a sequence of its own
whose length is a power of two, so no sequence crosses documents and none needs padding. Sequences of equal length form
buckets, and batches of about equal token counts are drawn from one bucket each.

Edge cases: a null or empty text is the closing id alone (one piece of length 1). Rows with a null or repeated doc_id are
packed like any other: nothing is grouped by doc_id. An empty table gives an empty result. Columns other than the two
named ones are not read, so their names can't clash. A text of any length is one row; its ids are held once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
    "bucket int, batch_id long"
)


def lengths(n: int, max_len: int = 1024) -> list[int]:
    """Piece lengths of n ids, longest first; max_len is a power of two."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


class Encoder:
    """Token ids of texts by a byte-level BPE vocabulary file of the tokenizers library.

    The same merges run through tiktoken's core where the ranks file of the vocabulary is beside it (about six times
    faster, same ids); texts it refuses, and vocabularies without ranks, go through the library itself. Strings
    of special tokens that stand in a text are ordinary text, as the description of the vocabulary files loads them
    (``encode_special_tokens = True``): a text can't end its own document. With ``special`` they become their ids.
    """

    def __init__(self, path: str, special: bool = False) -> None:
        self.path, self.special, self.fast, self.slow = path, special, None, None
        if special:
            return
        ranks = path.removesuffix(".json") + ".tiktoken"
        try:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding(
                "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={}
            )
        except (ImportError, FileNotFoundError):
            pass

    def _library(self, text: str) -> list[int]:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = not self.special
        return self.slow.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> list[int]:
        if not text:
            return []
        if self.fast is not None:
            try:
                return self.fast.encode_ordinary(text)
            except BaseException as why:  # noqa: BLE001 - the Rust core panics on some texts; that isn't an Exception
                if isinstance(why, (KeyboardInterrupt, SystemExit, GeneratorExit)):
                    raise
        return self._library(text)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def decompose(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_len: int = 1024,
    eos: int = 0,
    tokenizer: str | None = None,
    batch_tokens: int = 65_536,
    special: bool = False,
) -> DataFrame:
    """One row per piece: where it lies in its document, its ids (little-endian unsigned 32-bit), its sequence and batch.

    One narrow pass, no shuffle. sequence_id and batch_id are unique over the result: the task's number in the high bits
    and a counter in the low ones, so they repeat when a lost task runs again over the same input split.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = Encoder(tokenizer or default_tokenizer(), special)
        base = TaskContext.get().partitionId() << 40
        count, open_batch, batches_made = 0, {}, 0
        for batch in batches:
            out = {k: [] for k in ("doc_id", "start", "length", "doc_tokens", "batch_id")}
            blobs: list[bytes] = []
            size = 0
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1)
            for row, doc in enumerate(ids_of):
                ids = np.array([*encode(texts[row].as_py() or ""), eos], dtype="<u4")
                start = 0
                for n in lengths(len(ids), max_len):
                    blobs.append(ids[start : start + n].tobytes())
                    at, free = open_batch.get(n, (0, 0))
                    if not free:
                        at, free = batches_made, max(1, batch_tokens // n)
                        batches_made += 1
                    open_batch[n] = at, free - 1
                    for k, v in zip(out, (doc, start, n, len(ids), base | at)):
                        out[k].append(v)
                    start += n
                size += 4 * len(ids)
                if size > 8 << 20 or row == len(ids_of) - 1:
                    many = len(blobs)
                    length = np.array(out["length"], dtype=np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(out["doc_id"], pa.int64()),
                            pa.array(out["start"], pa.int64()),
                            pa.array(length),
                            pa.array(blobs, pa.binary()),
                            pa.array(out["doc_tokens"], pa.int64()),
                            pa.array(base | np.arange(count, count + many, dtype=np.int64)),
                            pa.array(np.zeros(many, dtype=np.int64)),
                            pa.array(np.log2(length).astype(np.int32)),
                            pa.array(out["batch_id"], pa.int64()),
                        ],
                        names=[x.split()[0] for x in PIECES.split(", ")],
                    )
                    count, size, blobs = count + many, 0, []
                    out = {k: [] for k in out}

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(rows, PIECES)


def write_buckets(packed: DataFrame, path: str) -> None:
    """The pieces as one folder per bucket of equal lengths, each readable on its own by a loader."""
    packed.write.partitionBy("bucket").parquet(path)


def digest(packed: DataFrame) -> DataFrame:
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket",
        "batch_id",
    )
