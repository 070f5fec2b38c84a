"""Near-duplicates by an LSH forest over SimHash fingerprints.

Links join documents whose sets of five-word shingles have a Jaccard similarity of at least 0.8; classes are the
components of links, named by their least doc_id.

1. One scan gives each row a 128-bit name of its word sequence, a 64-bit SimHash of its shingles and a 64-byte
   one-permutation min-hash sketch. Rows of one name are one text: names are aggregated (combined on the map side), and
   only distinct texts, each with a number of its own, go on.
2. The forest has ``trees`` tries; each orders the fingerprint's bits by a random permutation of its own. ``plan`` sets the
   deepest prefix from the number of documents, and then as many tries as give pairs at the similarity bound a common
   prefix of that depth in some trie with probability ``recall``. Shorter prefixes only raise it, so a leaf climbs while the
   shorter node still holds no more than ``dense`` texts: sparse regions are searched wider, and no leaf ends deeper than
   the target allows.
3. First pass, over the first ``first_tries`` tries: every text is verified against its likeliest partner in its leaf (large
   nodes are dealt into parts at random, in other ways in each trie). It only saves work: it folds groups of near copies
   into classes, at a cost in proportion to the rows.
4. Second pass, over all tries: every two texts of a leaf that are in different classes are compared (fingerprints within the
   Hamming radius, then sketches). Nodes of more than ``dense`` texts are dealt as block pairs in which every two members of
   different classes meet; members of a node's largest class needn't meet one another. Pairs that remain are verified on
   whole shingle sets, all of them. A leaf with more than ``per_member`` such pairs a member hands on its open members
   instead, and all their pairs are counted exactly in one task. There is no cap on partners, rounds or group sizes.

Shingle sets are compared as sets of 32-bit hashes. What a task holds is bounded by ``dense`` rows of sketches, or by two
chunks of shingle sets of about four million entries (or two single documents, if longer).

Edge cases: null, empty and blank texts have no shingles and stay alone. Texts of one to four words have one shingle, their
whole word sequence. Rows with a null doc_id have a null class. Several texts under one doc_id are compared each on its own
and each row has the class of its own text. An empty table gives an empty result. Ties are broken by hashes of the pair.
Only the two named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitegraph.llm.common import counted_join, keep, mix, pieces, window_hashes

SHINGLE = 5
BINS = 128
MARKS = [f"s{k}" for k in range(8)]  # the sketch: 128 half bytes
SIGNED = f"doc_id long, row long, h1 long, h2 long, fp long, {', '.join(m + ' long' for m in MARKS)}"
LEAF = ["tree", "climb", "leaf", "salt"]
_U64 = np.uint64
PIECE = 2 << 20  # bytes of text (or one text, if longer) whose words are worked on at once
_BLOOM = 27  # log2 of the bits of the filter over candidate ids


def words_of(texts: pa.Array) -> pa.Array:
    """The words of each text, null where there are none."""
    trimmed = pc.ascii_trim_whitespace(texts)
    return pc.ascii_split_whitespace(pc.if_else(pc.equal(trimmed, ""), None, trimmed))


def names_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit name of each word sequence, as two signed numbers."""
    joined = pc.fill_null(pc.binary_join(words, " "), "").cast(pa.large_binary())
    out = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.as_buffer()) for x in joined), dtype="<i8").reshape(-1, 2)
    return out[:, 0], out[:, 1]


def shingles(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, one text after another, and where each begins (and the last ends)."""
    n = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    known = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, known), _U64, len(known))[coded.indices.to_numpy()]
    at = np.concatenate([[0], np.cumsum(n)])
    whole = np.zeros(len(hashes), dtype=_U64)
    found = window_hashes(hashes, SHINGLE)
    whole[: len(found)] = found
    inside = np.arange(len(hashes)) + SHINGLE <= np.repeat(at[1:], n)  # the others run into the next text
    for k in np.flatnonzero((n > 0) & (n < SHINGLE)):
        whole[at[k]], inside[at[k]] = window_hashes(hashes[at[k] : at[k + 1]], int(n[k]))[0], True
    items, at = whole[inside], np.concatenate([[0], np.cumsum(np.where(n < SHINGLE, n > 0, n - SHINGLE + 1))])
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        items[a:b].sort()
    return distinct(items, at)


def distinct(items: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted sequences that stand one after another, without their repeats."""
    new = np.ones(len(items), dtype=bool)
    new[1:] = items[1:] != items[:-1]
    new[at[:-1][at[:-1] < at[1:]]] = True
    return items[new], np.concatenate([[0], np.cumsum(new)])[at]


def fingerprints(items: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each set of hashes (0 of an empty one). Every eighth bit is counted at once: a byte each of a 64-bit
    sum, over at most 255 hashes; those sums are added up."""
    out, size = np.zeros(len(at) - 1, dtype=_U64), np.diff(at)
    full = np.flatnonzero(size)
    if not len(full):
        return out
    many = -(-size[full] // 255)
    first = np.cumsum(many) - many
    cuts = np.repeat(at[full], many) + 255 * (np.arange(many.sum()) - np.repeat(first, many))
    bits = np.empty((len(full), 8, 8), dtype=bool)
    for k in range(8):
        lanes = np.add.reduceat(items >> _U64(k) & _U64(0x0101010101010101), cuts).view(np.uint8).reshape(-1, 8)
        bits[:, :, k] = 2 * np.add.reduceat(lanes, first, axis=0, dtype=np.int64) > size[full, None]
    out[full] = np.packbits(bits.reshape(-1, 64), axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def sketches(items: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One-permutation min-hash of each set: for each of 128 ranges of mixed hashes, four bits of its least member (0: none)."""
    texts = len(at) - 1
    mixed = mix(items ^ _U64(0x5851F42D4C957F2D))
    where = np.repeat(np.arange(texts) * BINS, np.diff(at)) + (mixed >> _U64(57)).astype(np.int64)
    least, used = np.full(texts * BINS, ~_U64(0)), np.zeros(texts * BINS, dtype=bool)
    np.minimum.at(least, where, mixed)
    used[where] = True
    marks = np.where(used, 1 + (mix(least) % _U64(15)).astype(np.uint8), np.uint8(0))
    return packed_marks(marks.reshape(texts, BINS)).view("<i8")


def packed_marks(marks: np.ndarray) -> np.ndarray:
    """Sketches given as rows of 128 marks, as rows of eight words of sixteen half bytes."""
    return np.ascontiguousarray(marks[:, ::2] | marks[:, 1::2] << 4).view("<u8")


def filled(words: np.ndarray) -> np.ndarray:
    """The lowest bit of each half byte that isn't zero."""
    words = words | words >> _U64(1)
    return (words | words >> _U64(2)) & _U64(0x1111111111111111)


def counted(words: np.ndarray) -> np.ndarray:
    """The bits that are set in each row of four or eight words, at most 255: the bytes of counts are summed by one product."""
    many = np.bitwise_count(words).view(f"<u{words.shape[1]}")[:, 0].astype(_U64)
    return ((many * _U64(0x0101010101010101) >> _U64(8 * words.shape[1] - 8)) & _U64(255)).astype(np.int64)


def estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarity of packed sketches, row by row: agreeing ranges, less those that agree by chance (one in 15)."""
    fx, fy = filled(x), filled(y)
    both, used = counted(fx & fy & ~filled(x ^ y)), np.maximum(counted(fx | fy), 1)
    return (both / used - 1 / 15) * (15 / 14)


def agreement(similarity: float) -> float:
    """Chance that a SimHash bit agrees for two sets of equal size and this Jaccard similarity."""
    return 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi


def plan(rows: int, dense: int = 2048, similarity: float = 0.8, recall: float = 0.99) -> tuple[int, int]:
    """(deepest prefix, number of tries): prefixes deep enough for nodes of ``dense`` rows, tries enough for the recall."""
    depth = min(30, max(0, math.ceil(math.log2(max(rows, 1) / dense))))
    if depth == 0:
        return 0, 1
    return depth, math.ceil(math.log(1 - recall) / math.log(1 - agreement(similarity) ** depth))


def _orders(trees: int, depth: int) -> np.ndarray:
    dice = np.random.default_rng(20_240_607)
    return np.stack([dice.permutation(64)[:depth] for _ in range(trees)]) if depth else np.zeros((trees, 0), dtype=np.int64)


def sign(docs: DataFrame) -> DataFrame:
    """SIGNED: name, fingerprint and sketch of each text; the fingerprint is null where there is no word or no doc_id."""
    names = [x.split()[0] for x in SIGNED.split(", ")]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, PIECE):
                words = words_of(batch.column(1))
                h1, h2 = names_of(words)
                items, at = shingles(words)
                bare = (at[:-1] == at[1:]) | batch.column(0).is_null().to_numpy(zero_copy_only=False)
                fp = pa.array(fingerprints(items, at).view("<i8"), mask=bare)
                marks = np.where(bare[:, None], 0, sketches(items, at))
                columns = [batch.column(0), batch.column(2), pa.array(h1), pa.array(h2), fp, *(pa.array(marks[:, k]) for k in range(8))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("row")).mapInArrow(rows, SIGNED)


def distinct_texts(signed: DataFrame, trees: int, depth: int) -> DataFrame:
    """(h1, h2, first, n, node, fp, sketch, prefixes): a row for each name; node numbers them once the table is written."""
    orders = _orders(trees, depth)
    same = [F.first(c).alias(c) for c in ("fp", *MARKS)]  # equal for equal names
    named = signed.where("fp is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), *same)
    named = named.withColumn("node", F.monotonically_increasing_id())
    schema = ", ".join(f"{c} long" for c in named.columns) + ", prefixes array<int>"

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = 1 << np.arange(depth)[::-1]
        for batch in batches:
            fp = np.ascontiguousarray(batch.column("fp").to_numpy())
            bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            found = np.stack([bits[:, o].astype(np.int64) @ weight for o in orders], axis=1).astype(np.int32)
            at = np.arange(0, found.size + 1, len(orders), dtype=np.int32)
            prefixes = pa.ListArray.from_arrays(pa.array(at), pa.array(found.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, prefixes], names=[*batch.schema.names, "prefixes"])

    return named.mapInArrow(rows, schema)


def leaves(texts: DataFrame, depth: int, dense: int) -> DataFrame:
    """(tree, prefix, climb, leaf, n): the leaf of each prefix in each trie, and how many texts it holds. A written table."""
    up = min(depth, 6)
    sizes = texts.select(F.posexplode("prefixes").alias("tree", "prefix")).groupBy("tree", "prefix").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("head", F.shiftright("prefix", up))
    sizes, climb = sizes.repartition("tree", "head"), F.lit(0)  # one shuffle serves all windows below
    for k in range(1, up + 1):
        over = Window.partitionBy("tree", "head", F.shiftright("prefix", k))
        sizes = sizes.withColumn(f"n{k}", F.sum("n").over(over))
        climb = F.when(F.col(f"n{k}") <= dense, F.lit(k)).otherwise(climb)
    sizes = sizes.withColumn("climb", climb).withColumn("leaf", F.expr("shiftright(prefix, climb)"))
    total = F.sum("n").over(Window.partitionBy("tree", "head", "climb", "leaf"))
    return keep(texts.sparkSession, sizes.select("tree", "prefix", "climb", "leaf", total.alias("n")))


def placed(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tree, prefix, climb, leaf, n, node, class, fp, sketch): where each text stands in each trie, n: texts of its leaf."""
    rows = members.select("node", "class", "many", "fp", *MARKS, F.posexplode("prefixes").alias("tree", "prefix"))
    # About trees * texts / dense nodes: broadcast while they are counted to be few, else joined by a shuffle.
    return rows.join(F.broadcast(nodes) if nodes.count() <= 500_000 else nodes, ["tree", "prefix"])


def parts(rows: DataFrame, dense: int) -> DataFrame:
    """First pass: large leaves dealt at random into parts of about ``dense`` texts."""
    return rows.withColumn("salt", F.pmod(F.xxhash64("node", "tree"), F.ceil(F.col("n") / dense)))


def meetings(rows: DataFrame, dense: int) -> DataFrame:
    """Second pass: leaves of more than ``dense`` texts dealt as blocks of two parts each, so that every two members of
    different classes share a block. Members of a leaf's largest class don't meet one another, only the others: a large
    class is read once for each ``dense`` others in its leaf, a leaf of one class not at all.
    """
    spark = rows.sparkSession
    few, large = rows.where(F.col("n") <= dense).withColumn("salt", F.lit(0).cast("long")), rows.where(F.col("n") > dense)
    classes = large.where("many").groupBy("tree", "leaf", "class").agg(F.count("*").alias("c"))
    tops = classes.groupBy("tree", "leaf").agg(F.max("c").alias("n_top"), F.max_by("class", F.struct("c", "class")).alias("top"))
    tops = keep(spark, tops)  # one row a large leaf at most
    large = large.join(F.broadcast(tops) if tops.count() <= 500_000 else tops, ["tree", "leaf"], "left")
    large = large.withColumn("n_top", F.coalesce("n_top", F.lit(0))).where("n > n_top")
    top_parts = F.greatest(F.ceil(F.col("n_top") / dense), F.lit(1))
    others, spread = F.ceil((F.col("n") - F.col("n_top")) / dense), F.xxhash64("node", "tree")
    q, zero, none = F.pmod(spread, others), F.lit(0).cast("long"), F.array().cast("array<bigint>")
    with_others = F.transform(F.sequence(zero, others - 1), lambda k: F.pmod(spread, top_parts) * others + k)
    with_tops = F.when(F.col("n_top") > 0, F.transform(F.sequence(zero, top_parts - 1), lambda k: k * others + q)).otherwise(none)
    among = F.transform(F.filter(F.sequence(zero, others - 1), lambda k: k != q), lambda k: -1 - (F.least(k, q) * others + F.greatest(k, q)))
    blocks = F.when(F.col("class") == F.col("top"), with_others).otherwise(F.concat(with_tops, among))
    return few.unionByName(large.withColumn("salt", F.explode(blocks)).select(few.columns))


def runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of each key (the first columns) of batches sorted by key, a run at a time."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        by = np.stack([batch.column(k).to_numpy() for k in range(keys)], axis=1)
        cuts = np.flatnonzero((by[1:] != by[:-1]).any(axis=1)) + 1
        for x, y in zip([0, *cuts], [*cuts, len(by)]):
            key = tuple(by[x].tolist())
            if key != now:
                if held:
                    yield now, pa.Table.from_batches(held)
                held, now = [], key
            held.append(batch.slice(x, y - x))
    if held:
        yield now, pa.Table.from_batches(held)


def dealt(rows: DataFrame) -> DataFrame:
    """Each leaf (or block) a run of rows in a sorted partition."""
    keys = [F.col(k).cast("long").alias(k) for k in LEAF]
    return rows.select(*keys, "node", "class", "fp", *MARKS).repartition(*LEAF).sortWithinPartitions(*LEAF)


def near_pairs(fp: np.ndarray, marks: np.ndarray, label: np.ndarray, radius: int, low: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, smaller row, estimated similarity) of a leaf's pairs of different labels, some thousand rows' pairs at a time.

    Fingerprints are compared in strips that stay in a core's cache. Of the pairs within the radius, those whose first half of the
    sketches rules the estimate out, even if all the rest agreed, go first.
    """
    n = len(fp)
    words = packed_marks(marks) if marks.dtype == np.uint8 else marks
    head, fill = np.ascontiguousarray(words[:, :4]), filled(words)
    many, rest = counted(fill), counted(np.ascontiguousarray(fill[:, 4:]))
    share = low * 14 / 15 + 1 / 15 - 1e-9  # agreeing ranges of those used that the estimate needs
    step = max(1, (1 << 15) // max(n, 1))
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for at in range(1, n, step):
        stop = min(n, at + step)
        near = np.flatnonzero(np.bitwise_count(fp[at:stop, None] ^ fp[None, :stop]) <= radius)
        i = near // stop
        j = near - i * stop
        i += at
        ok = (j < i) & (label[i] != label[j])
        held.append((i[ok], j[ok]))
        size += len(held[-1][0])
        if size < 1 << 14 and stop < n:
            continue
        i, j = (np.concatenate(x) for x in zip(*held))
        held, size = [], 0
        for k in range(0, len(i), 1 << 14):
            x, y = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
            hx, hy = np.take(head, x, axis=0), np.take(head, y, axis=0)
            both = counted(filled(hx) & ~filled(hx ^ hy))
            ok = both + np.minimum(rest[x], rest[y]) >= share * np.maximum(many[x], many[y])
            x, y = x[ok], y[ok]
            guess = estimate(words[x], words[y])
            ok = guess >= low
            if ok.any():
                yield x[ok], y[ok], guess[ok]


def _leaf(table: pa.Table) -> tuple[np.ndarray, ...]:
    fp = table["fp"].to_numpy().view(_U64)
    return table["node"].to_numpy(), table["class"].to_numpy(), fp, np.stack([table[m].to_numpy() for m in MARKS], axis=1).view(_U64)


def likeliest(rows: DataFrame, radius: int, low: float) -> DataFrame:
    """(a, b): the likeliest partner of each text over its leaves (of two texts that choose each other, one pair)."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in runs(batches, 4):
            node, _, fp, marks = _leaf(table)
            n = len(node)
            best, mate, dice = np.full(n, -1.0), np.full(n, -1), np.zeros(n, dtype=_U64)
            for i, j, guess in near_pairs(fp, marks, np.arange(n), radius, low):
                toss = mix((node[i] ^ node[j]).view(_U64))
                for x, y in ((i, j), (j, i)):
                    order = np.lexsort((toss, guess, x))
                    last = np.append(x[order][1:] != x[order][:-1], True)
                    x, y, g, t = x[order][last], y[order][last], guess[order][last], toss[order][last]
                    wins = (g > best[x]) | (g == best[x]) & (t > dice[x])
                    best[x[wins]], mate[x[wins]], dice[x[wins]] = g[wins], y[wins], t[wins]
            has = np.flatnonzero(mate >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(node[has]), pa.array(node[mate[has]]), pa.array(best[has])], names=["a", "b", "guess"])

    found = dealt(rows).mapInArrow(find, "a long, b long, guess double")
    one = found.groupBy("a").agg(F.max_by("b", F.struct("guess", F.xxhash64(F.col("a").bitwiseXOR(F.col("b"))))).alias("b"))
    return one.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


OPEN = f"{', '.join(k + ' long' for k in LEAF)}, a long, b long, ca long, cb long"


def open_pairs(rows: DataFrame, radius: int, low: float, per_member: int) -> DataFrame:
    """OPEN: pairs of different classes to verify (leaf columns null), or the open members of a leaf with very many (b null)."""
    names = [x.split()[0] for x in OPEN.split(", ")]

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, table in runs(batches, 4):
            node, label, fp, marks = _leaf(table)
            n = len(node)
            if (label == label[0]).all():
                continue
            most, held, many, live = per_member * n, [], 0, np.zeros(n, dtype=bool)
            for i, j, _ in near_pairs(fp, marks, label, radius, low):
                live[i] = live[j] = True
                many += len(i)
                held = [*held, (i, j)] if many <= most else []
            if not many:
                continue
            if many <= most:
                i, j = (np.concatenate(x) for x in zip(*held))
                up = node[i] > node[j]
                i, j = np.where(up, i, j), np.where(up, j, i)
                where = [pa.nulls(many, pa.int64())] * 4
                columns = [*where, pa.array(node[i]), pa.array(node[j]), pa.array(label[i]), pa.array(label[j])]
            else:
                where = [pa.array(np.full(live.sum(), k)) for k in key]
                nulls = pa.nulls(int(live.sum()), pa.int64())
                columns = [*where, pa.array(node[live]), nulls, pa.array(label[live]), nulls]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return dealt(rows).mapInArrow(find, OPEN)


def _place(column: str):
    """Where an id stands in the filter, from 1."""
    return F.pmod(F.xxhash64(column), F.lit(1 << _BLOOM)) + 1


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size over hashed ids (column id): ids that are in are never missed."""
    at = ids.select(F.bitmap_bucket_number(_place("id")).alias("k"), F.bitmap_bit_position(_place("id")).alias("at"))
    out = np.zeros((1 << _BLOOM) // 8, dtype=np.uint8)
    for r in at.groupBy("k").agg(F.bitmap_construct_agg("at").alias("bits")).toLocalIterator():
        part = np.frombuffer(r["bits"], dtype=np.uint8)
        out[(r["k"] - 1) * 4096 : (r["k"] - 1) * 4096 + len(part)] = part
    return out


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, items): shingle sets, as sorted 32-bit hashes, of the texts in ``wanted`` (node, first, h1, h2)."""
    bits = docs.sparkSession.sparkContext.broadcast(id_filter(wanted.select(F.col("first").alias("id"))))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = bits.value
        for whole in batches:
            place = whole.column(2).to_numpy() - 1
            inside = whole.filter(pa.array((bitmap[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)))
            for batch in pieces(inside, PIECE):
                words = words_of(batch.column(1))
                h1, h2 = names_of(words)
                items, at = shingles(words)
                items, at = distinct((items >> _U64(32)).astype("<u4"), at)
                sets = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(items)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h1), pa.array(h2), sets], names=["first", "h1", "h2", "items"])

    named = docs.where("doc_id is not null").select("doc_id", "text", _place("doc_id").alias("place"))
    found = named.mapInArrow(rows, "first long, h1 long, h2 long, items binary")
    return found.join(wanted, ["first", "h1", "h2"]).dropDuplicates(["node"]).select("node", "items")


def verify(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b and more) whose shingle sets are at least so similar."""
    columns = pairs.columns

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(v.as_py(), dtype="<u4") for v in (x, y))
                if min(len(x), len(y)) < similarity * max(len(x), len(y)):
                    ok.append(False)
                    continue
                both = len(x) + len(y) - len(np.union1d(x, y))
                ok.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.filter(pa.array(ok, pa.bool_())).select(columns)

    left = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select(*columns, "x", "y")
    return both.mapInArrow(rows, pairs.schema)


def leaf_links(label: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that join all labels that are linked (label is updated): all pairs are counted exactly."""
    n, found = len(label), []
    sizes = np.array([len(x) for x in sets])
    at = np.concatenate([[0], np.cumsum(sizes)])
    _, term, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    post = np.repeat(np.arange(n, dtype=np.int32), sizes)[np.argsort(term, kind="stable")]
    begin = np.cumsum(many) - many
    for i in range(n):
        own = term[at[i] : at[i + 1]]
        own = own[many[own] > 1]
        both = np.zeros(n, dtype=np.int64)
        part = np.cumsum(many[own]) >> 22
        for own in np.split(own, np.flatnonzero(part[1:] != part[:-1]) + 1):
            size = many[own]
            where = np.repeat(begin[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            both += np.bincount(post[where], minlength=n)
        alike = (both >= similarity * (sizes[i] + sizes - both)) & (label != label[i])
        for j in np.flatnonzero(alike).tolist():
            if label[j] != label[i]:
                found.append((i, j))
                label[label == label[j]] = label[i]
    return found


def settle(members: DataFrame, sets: DataFrame, similarity: float, most: int = 2_000_000) -> DataFrame:
    """(ca, cb): the links among the open members of each leaf that join different classes; sets are met in chunks of
    about ``most`` entries, two chunks at a time."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, leaf in runs(batches, 4):
            label, items = leaf["ca"].to_numpy().copy(), leaf["items"]
            first, found = label.copy(), []
            sizes = np.array([len(x.as_buffer()) // 4 for x in items])
            chunk = np.cumsum(sizes) // most
            groups = [np.flatnonzero(chunk == c) for c in np.unique(chunk)]
            for own in groups if len(groups) == 1 else map(np.concatenate, combinations(groups, 2)):
                links = leaf_links(label[own], [np.frombuffer(items[int(k)].as_py(), dtype="<u4") for k in own], similarity)
                for i, j in links:
                    a, b = int(own[i]), int(own[j])
                    found.append((int(first[a]), int(first[b])))
                    label[label == label[b]] = label[a]
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["ca", "cb"])

    whole = members.select(*LEAF, F.col("a").alias("node"), "ca").join(sets, "node").select(*LEAF, "ca", "items")
    return whole.repartition(*LEAF).sortWithinPartitions(*LEAF).mapInArrow(rows, "ca long, cb long").distinct()


def components(spark: SparkSession, links: DataFrame, rounds: int = 1000) -> DataFrame:
    """(id, label): the least id of each component of the links (a, b).

    Alternating large-star and small-star (Kiveris et al. 2014): O(log^2 n) rounds for n ids, about log n in practice. Every
    round's table is written to the shared folder. No label is returned before the links are stars round the least ids: an
    error if that takes more than ``rounds``. Ids with very many links are joined by broadcast.
    """
    edges = keep(spark, links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
        ends = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        size, open_ = ends.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if((F.col("up") > 1) | (F.col("up") == 1) & (F.col("down") == 1))).first()
        if not open_:  # every id hangs on one that hangs on none: stars
            stars = edges.select(F.col("a").alias("id"), F.col("b").alias("label"))
            return stars.union(edges.select("b", "b").distinct())
        both = edges.union(edges.select("b", "a"))
        least = keep(spark, both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"))
        large = counted_join(both, least, ["a"], "n", 2 * size).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = keep(spark, large)
        least = keep(spark, large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        small = counted_join(large, least, ["a"], "n", size).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = keep(spark, small.union(least.select("a", F.col("m").alias("b"))).distinct())
    raise RuntimeError(f"components have not settled in {rounds} rounds")


def classes(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """(doc_id, class_id), a row for each row of docs."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _classes(spark, docs, **settings).select("doc_id", "class_id")


def joined_texts(
    spark: SparkSession, docs: DataFrame, texts: DataFrame, depth: int, similarity: float, dense: int, first_tries: int, radius: int, low: float, per_member: int
) -> DataFrame:
    """(node, class): the class (its least node) of every distinct text."""

    def sets_for(nodes: DataFrame) -> DataFrame:
        wanted = texts.select("node", "first", "h1", "h2").join(nodes.distinct(), "node", "left_semi")
        return keep(spark, sets_of(docs, keep(spark, wanted)))

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("node")).union(pairs.where("b is not null").select("b"))

    alone = texts.select("node", F.col("node").alias("class"), F.lit(False).alias("many"), "fp", *MARKS, F.slice("prefixes", 1, first_tries).alias("prefixes"))
    nodes = leaves(texts, depth, dense)  # for both passes
    likely = keep(spark, likeliest(parts(placed(alone, nodes), dense), radius, low))
    labels = components(spark, verify(likely, sets_for(ends(likely)), similarity))
    found = labels.select(F.col("id").alias("node"), F.col("label").alias("class"))
    classed = texts.select("node", "fp", *MARKS, "prefixes").join(found, "node", "left")
    classed = keep(spark, classed.withColumn("many", F.col("class").isNotNull()).withColumn("class", F.coalesce("class", "node")))

    opened = keep(spark, open_pairs(meetings(placed(classed, nodes), dense), radius, low, per_member))
    pairs = keep(spark, opened.where("b is not null").select("a", "b", "ca", "cb").distinct())
    members = opened.where("b is null")
    sets = sets_for(ends(pairs.select("a", "b")).union(members.select("a")))
    late = verify(pairs, sets, similarity).select("ca", "cb").union(settle(members, sets, similarity))
    upper = components(spark, late.toDF("a", "b")).select(F.col("id").alias("class"), F.col("label").alias("top"))
    own = classed.select("node", "class")
    sizes = keep(spark, upper.join(own.groupBy("class").agg(F.count("*").alias("n")), "class"))
    return keep(spark, counted_join(own, sizes, ["class"], "n", how="left").select("node", F.coalesce("top", "class").alias("class")))


def _classes(
    spark: SparkSession, docs: DataFrame, similarity: float = 0.8, recall: float = 0.99, dense: int = 2048, first_tries: int = 3, radius: int = 22, low: float = 0.62, per_member: int = 8
) -> DataFrame:
    """(doc_id, row, node, class_id, stands): row is a hash of the text, node the number of its words (null where there are
    none); stands marks the text that names its class."""
    depth, trees = plan(docs.count(), dense, similarity, recall)
    signed = keep(spark, sign(docs))
    texts = keep(spark, distinct_texts(signed, trees, depth))
    of = joined_texts(spark, docs, texts, depth, similarity, dense, first_tries, radius, low, per_member)
    own = keep(spark, texts.select("node", "first", "h1", "h2", "n").join(of, "node"))
    sizes = own.groupBy("class").agg(F.min("first").alias("class_id"), F.count("*").alias("members"))
    named = counted_join(own, keep(spark, sizes), ["class"], "members")
    # Of several texts of the least doc_id the least number stands for the class.
    firsts = named.where("first = class_id").groupBy("class").agg(F.min("node").alias("stand"))
    stands = F.coalesce(F.col("node") == F.col("stand"), F.lit(False)).alias("stands")
    named = keep(spark, named.select("node", "h1", "h2", "n", "class_id").join(firsts.select("stand"), F.col("node") == F.col("stand"), "left").select("node", "h1", "h2", "n", "class_id", stands))
    rows = signed.select("doc_id", "row", "h1", "h2", F.col("fp").isNull().alias("bare"))
    columns = ["doc_id", "row", "node", "class_id", "stands"]
    told = counted_join(rows.where("not bare"), named, ["h1", "h2"], "n").select(columns)
    alone = rows.where("bare").select("doc_id", "row", F.lit(None).cast("long").alias("node"), F.col("doc_id").alias("class_id"), F.lit(True).alias("stands"))
    return told.unionByName(alone)


def keep_first(spark: SparkSession, docs: DataFrame, **settings) -> DataFrame:
    """The rows, with all their columns, that stand first in their class; rows with a null id all stay. Of several rows of one
    doc_id and one word sequence one stays, and of rows without words one for each doc_id and text."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = _classes(spark, texts, **settings).where("stands and doc_id = class_id")
    stays = found.groupBy("doc_id", "node", F.when(F.col("node").isNull(), F.col("row")).alias("bare")).agg(F.min("row").alias("__row"))
    tagged = docs.withColumn("__row", F.xxhash64("text"))
    kept = tagged.join(stays.select("doc_id", "__row"), ["doc_id", "__row"], "left_semi").dropDuplicates(["doc_id", "__row"])
    return kept.select(docs.columns).unionByName(docs.where("doc_id is null"))
