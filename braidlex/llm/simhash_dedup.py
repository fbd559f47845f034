"""SimHash near-dedup with bit-sliced comparison.

Fingerprints: a bit is 1 if set in over half of the XXH64 hashes of a text's
word shingles. Two fingerprints link at ``radius`` or fewer differing bits;
classes are the connected components of the links.

Candidates. 64 bits are cut into ``b`` blocks; two fingerprints within the
radius agree on at least ``b - radius`` of them, so each choice of that many
blocks is one table, keyed by those bits. No pair within the radius is missed
for any ``b``; only the cost depends on it, and ``b`` is picked from the
number of distinct fingerprints.

Bit-sliced comparison. Members of one key are compared with each other:
64 members are a lane block, stored vertically (plane ``i`` holds bit ``i`` of
each member). A member is compared with a lane block by XOR of a plane with
its own bit and a carry-save counter of a few bits for each lane; a lane block
is dropped once all lanes exceed the radius.

Similarity of shingle sets (``near_copies``). For a Jaccard similarity the same
comparison runs over fingerprints of ``WIDE`` bits of the distinct shingles.
Its radius follows from the similarity: the share of bits in which two such
sets differ has a largest value (``differing_share``), and the radius leaves
out pairs with a probability of ``MISSED`` at most. Radii this wide have no
useful blocks; here members of a key share a pair of min-hashes. The links are
then confirmed by exact comparison of the sets.

Hot groups. Copies share a fingerprint and count once. A key with more than
``TILE`` members is cut into tiles, each compared with each other one, so no
task holds more than two tiles of a key at once. Of the links found, a worker
sends a spanning forest, never all pairs of a group. Joins on fingerprints or
roots with very many rows are split (``split_join``).

Defined results. Null or empty text (or white space): fingerprint zero, linked
like any other. Fewer words than a shingle: the whole sequence is the one
shingle. Repeated rows each get a row. A null doc_id gets a fingerprint and
takes the class of its fingerprint, but never names one. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import accumulate, combinations, repeat
from math import acos, comb, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import U64, binary, columns_as, cut, mix, split_join

ALL = U64(0xFFFFFFFFFFFFFFFF)
ONE = U64(1)

#: Pairs of min-hashes that are keys, bits of a fingerprint of distinct shingles, and the share of true pairs that its radius may leave out.
BANDS, WIDE, MISSED = 10, 256, 1e-9
FACTORS = np.array([xxhash.xxh64_intdigest(str(i), 7) | 1 for i in range(2 * BANDS)], U64)
WORD_FACTORS = np.array([xxhash.xxh64_intdigest(str(i), 8) | 1 for i in range(WIDE // 64)], U64)
#: Members of one key that are compared in one piece.
TILE = 1024
#: Lanes (pairs of members) compared at a time by one worker, and rows gathered for it.
CHUNK_PAIRS, CHUNK_ROWS = 4_000_000, 60_000
#: Bytes of text of one tile of a candidate class; two tiles at most are compared exactly at a time.
TILE_BYTES = 2_000_000


def shingle_hashes(text: bytes, shingle: int, seed: int) -> list[int]:
    words = text.lower().split()
    joined = b" ".join(words)
    if not words:
        return []
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(joined, seed)]
    stops = list(accumulate(map((1).__add__, map(len, words))))
    starts = [0, *stops]
    pieces = [joined[a : b - 1] for a, b in zip(starts, stops[shingle - 1 :])]
    return list(map(xxhash.xxh64_intdigest, pieces, repeat(seed)))


def majority_bits(hashes: list[int]) -> int:
    if not hashes:
        return 0
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int32) if len(bits) > 255 else np.add.reduce(bits, axis=0, dtype=np.uint8)
    over = ones.astype(np.int64) * 2 > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id and its 64-bit fingerprint (as a signed long)."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([majority_bits(shingle_hashes(t or b"", shingle, seed)) for t in binary(batch.column("text"))], U64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    texts = columns_as(docs, doc_id="bigint", text="string")
    return texts.mapInArrow(rows_of, "doc_id long, fp long")


def block_edges(blocks: int) -> list[tuple[int, int]]:
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    return list(zip(edges, edges[1:], strict=False))


def choose_blocks(n: int, radius: int) -> int:
    """Blocks with the least work for n fingerprints: 2 microseconds a row and table, 1 nanosecond a pair."""

    def cost(blocks: int) -> float:
        tables = len(list(combinations(range(blocks), blocks - radius)))
        return tables * (2000 + n / 2 ** (64 * (blocks - radius) / blocks))

    return min(range(radius + 1, radius + 5), key=cost)


def table_masks(blocks: int, radius: int) -> list[int]:
    edges = block_edges(blocks)
    return [sum(((1 << (b - a)) - 1) << a for a, b in chosen) for chosen in combinations(edges, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def local_forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the links (u, v)."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label


def bitsliced_links(group: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of the same group within the radius; rows come sorted by group, a print is one or more words."""
    prints = prints.reshape(len(prints), -1)
    bits = [(word, U64(b)) for word in range(prints.shape[1]) for b in range(64)]
    n = len(group)
    new = np.flatnonzero(np.diff(group, prepend=group[0] - 1 if n else 0))
    sizes = np.diff(new, append=n)
    within = np.arange(n) - np.repeat(new, sizes)
    blocks_of = (sizes + 63) // 64
    first_block = np.cumsum(blocks_of) - blocks_of
    block = np.repeat(first_block, sizes) + within // 64
    lane = (within % 64).astype(U64)
    edges = np.flatnonzero(np.diff(block, prepend=-1))
    planes = [np.bitwise_or.reduceat(((prints[:, word] >> b) & ONE) << lane, edges) for word, b in bits]
    filled = np.bitwise_or.reduceat(ONE << lane, edges)
    block_start = edges
    last_block = np.repeat(first_block + blocks_of - 1, sizes)
    against = last_block - block + 1
    row = np.repeat(np.arange(n), against)
    blk = np.repeat(block, against) + np.arange(len(row)) - np.repeat(np.cumsum(against) - against, against)
    later = np.where(lane[row] < 63, ALL << np.minimum(lane[row] + ONE, U64(63)), U64(0))
    open_lanes = np.where(blk == block[row], filled[blk] & later, filled[blk])
    live = open_lanes != 0
    row, blk, open_lanes = row[live], blk[live], open_lanes[live]
    own = prints[row]
    digits = [np.zeros(len(row), U64) for _ in range(max(3, (radius + 1).bit_length()))]
    over = np.zeros(len(row), U64)
    for at, (word, b) in enumerate(bits):
        carry = planes[at][blk] ^ (U64(0) - ((own[:, word] >> b) & ONE))
        greater = np.zeros(len(row), U64)
        for i, digit in enumerate(digits):
            digits[i], carry = digit ^ carry, digit & carry
            greater = digits[i] | greater if not radius >> i & 1 else digits[i] & greater
        over = over | carry | greater
        if at % 8 == 7:
            live = (open_lanes & ~over) != 0
            if not live.all():
                row, blk, open_lanes, own, over = (y[live] for y in (row, blk, open_lanes, own, over))
                digits = [d[live] for d in digits]
            if not len(row):
                break
    hit = open_lanes & ~over
    us, vs = [], []
    for b in range(64):
        found = np.flatnonzero((hit >> U64(b)) & ONE)
        if len(found):
            us.append(row[found])
            vs.append(block_start[blk[found]] + b)
    if not us:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(us), np.concatenate(vs)


def _tail(n: int) -> list[float]:
    """P(X > k) for X of n fair bits, for k from -1 to n."""
    out = [0.0]
    for k in range(n, -1, -1):
        out.append(out[-1] + comb(n, k) / 2.0**n)
    return out[::-1]


def _differ(a: int, b: int, common: int) -> float:
    """The probability that a bit differs between sets with ``a`` and ``b`` shingles of their own and ``common`` ones."""
    tails = [_tail(a), _tail(b)]
    total = 0.0
    for c in range(common + 1):
        one, two = (tail[min(max((common + own) // 2 - c, -1), own) + 1] for own, tail in zip((a, b), tails, strict=True))
        total += comb(common, c) / 2.0**common * (one * (1 - two) + two * (1 - one))
    return total


@cache
def differing_share(similarity: float) -> float:
    """The largest probability that a bit differs between sets of that Jaccard similarity or more.

    Small sets are tried one by one; of large ones the angle between the sets decides.
    """
    worst = acos(2 * similarity / (1 + similarity)) / pi
    for common in range(1, 41):
        apart = int(common * (1 / similarity - 1) + 1e-9)
        worst = max([worst, *(_differ(a, k - a, common) for k in range(apart + 1) for a in range(k // 2 + 1))])
    return worst


@cache
def radius_of(similarity: float, bits: int = WIDE) -> int:
    """The least radius that leaves out a pair of that similarity with a probability of ``MISSED`` at most (bits are independent)."""
    p = differing_share(similarity)
    left, radius = 1.0, -1
    while left > MISSED and radius < bits:
        radius += 1
        left -= comb(bits, radius) * p**radius * (1 - p) ** (bits - radius)
    return radius


def group_links(radius: int):
    """Rows (grp, node, print), sorted by grp, to the links (node, root) of a spanning forest of each chunk of groups."""

    def links(group: np.ndarray, node: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        u, v = bitsliced_links(group, prints, radius)
        distinct, at = np.unique(node, return_inverse=True)
        label = local_forest(len(distinct), at[u], at[v])
        child = np.flatnonzero(label != np.arange(len(distinct)))
        return pa.RecordBatch.from_arrays([pa.array(distinct[child]), pa.array(distinct[label[child]])], names=["a", "b"])

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] = ()
        for batch in batches:
            if not batch.num_rows:
                continue
            prints = np.frombuffer(b"".join(batch.column("print").to_pylist()), "<u8").astype(U64).reshape(batch.num_rows, -1)
            new = (batch.column("grp").to_numpy(), batch.column("node").to_numpy(), prints)
            held = tuple(np.concatenate([a, b]) for a, b in zip(held, new, strict=True)) if held else new
            while True:
                ends = np.flatnonzero(np.diff(held[0])) + 1  # the last group may go on in the next batch
                if not len(ends):
                    break
                work = np.cumsum(np.diff(ends, prepend=0).astype(np.float64) ** 2)
                fit = ends[max(1, int(np.searchsorted(work, CHUNK_PAIRS))) - 1]
                if fit == ends[-1] and work[-1] < CHUNK_PAIRS and len(held[0]) < CHUNK_ROWS:
                    break
                yield links(*(x[:fit] for x in held))
                held = tuple(x[fit:] for x in held)
        while held and len(held[0]):
            ends = np.append(np.flatnonzero(np.diff(held[0])) + 1, len(held[0]))
            work = np.cumsum(np.diff(ends, prepend=0).astype(np.float64) ** 2)
            fit = ends[max(1, int(np.searchsorted(work, CHUNK_PAIRS))) - 1]
            yield links(*(x[:fit] for x in held))
            held = tuple(x[fit:] for x in held)

    return rows_of


def tiled(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, node, print) by group id: a key with more than ``TILE`` rows is cut into tiles, each paired with each.

    The hot keys are broadcast (at most one for ``TILE`` rows), so that rows are shuffled once.
    """
    hot = rows.groupBy(*keys).count().filter(F.col("count") > TILE).select(*keys, F.ceil(F.col("count") / TILE).cast("int").alias("tiles"))
    tiles = F.coalesce(F.col("tiles"), F.lit(1))
    own = F.pmod(F.xxhash64("node"), tiles)
    other = F.explode(F.sequence(F.lit(0), (tiles - 1).cast("int")))
    split = rows.join(F.broadcast(hot), keys, "left").select(*keys, "node", "print", own.alias("own"), other.alias("other"))
    grouped = split.select(F.xxhash64(*keys, F.least("own", "other"), F.greatest("own", "other")).alias("grp"), "node", "print")
    return grouped.repartition("grp").sortWithinPartitions("grp")


def fingerprint_links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b) between distinct fingerprints whose components are those of all pairs within the radius."""
    if not 0 <= radius <= 6:
        raise ValueError("tables of agreeing blocks serve radii from 0 to 6; near_copies takes wider ones")
    blocks = choose_blocks(distinct.count(), radius)
    masks = table_masks(blocks, radius)
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])
    as_bytes = F.to_binary(F.lpad(F.hex("fp"), 16, "0"), F.lit("hex"))  # in whatever order: all prints are read alike
    rows = distinct.select(F.col("fp").alias("node"), as_bytes.alias("print"), F.inline(keys))
    grouped = tiled(rows, ["t", "key"])
    return grouped.mapInArrow(group_links(radius), "a long, b long").distinct()


def connected(links: DataFrame) -> DataFrame:
    """node, label: the smallest node that each linked node reaches.

    Each round points every node at its smallest neighbour (or itself), follows
    the pointers to their ends, and puts the ends in the nodes' places: links
    inside an end vanish, equal ones become one. At least half of the nodes
    vanish in a round, mostly nearly all, so a link is read a few times
    whatever the size of its component. Tables are written after each step.
    """

    def drawn(a: str, b: str, rows: DataFrame) -> DataFrame:
        return cut(rows.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a > b").distinct(), "links")

    edges, labels = drawn("a", "b", links), None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "ends")
        while True:  # pointers to pointers: paths halve
            beyond = ends.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
            further = cut(split_join(ends, beyond, "label").select("node", F.col("beyond").alias("label"), F.col("label").alias("was")), "ends")
            ends = further.select("node", "label")
            if further.filter("label < was").isEmpty():
                break
        if labels is None:
            labels = ends
        else:
            over = split_join(labels, ends.select(F.col("node").alias("label"), F.col("label").alias("end")), "label", "left")
            labels = cut(over.select("node", F.coalesce("end", "label").alias("label")), "labels")
        left = cut(split_join(edges, ends.select(F.col("node").alias("a"), F.col("label").alias("end_a")), "a").select("end_a", "b"), "half")
        edges = drawn("end_a", "end_b", split_join(left, ends.select(F.col("node").alias("b"), F.col("label").alias("end_b")), "b"))
    return links.sparkSession.createDataFrame([], "node long, label long") if labels is None else labels


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable over links)."""
    prints = cut(fingerprints(docs, shingle, seed), "fingerprints")
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    labels = connected(fingerprint_links(distinct.select("fp"), radius))
    classes = distinct.join(labels, distinct.fp == labels.node, "left").select("fp", "rep", F.coalesce("label", "fp").alias("label"))
    named = classes.groupBy("label").agg(F.min("rep").alias("component_id"))
    of_print = classes.join(named, "label").select("fp", "component_id")
    return split_join(prints, of_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def signature(hashes: list[int]) -> tuple[list[int], bytes, bytes]:
    """Band keys, the fingerprint (WIDE bits) and a digest of a set of shingle hashes."""
    h = np.unique(np.array(hashes, U64))
    low = np.full(len(FACTORS), ALL, U64)
    ones = np.zeros(WIDE, np.int64)
    for k in range(0, len(h), 4096):
        part = h[k : k + 4096, None]
        low = np.minimum(low, (part * FACTORS).min(axis=0))
        bits = np.unpackbits(mix(part * WORD_FACTORS).view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    low = mix(low)
    bands = mix(low[::2] * U64(0x9E3779B97F4A7C15) ^ low[1::2])
    return bands.view(np.int64).tolist(), np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), xxhash.xxh3_128_digest(h.tobytes())


def exact_links(shingle: int, similarity: float, seed: int):
    """Rows (home, node, digest, text) of one home to links (a, b) of a spanning forest of its pairs at ``similarity`` or more.

    From each row not yet reached the sets of all rows not yet reached are
    compared exactly, then from the rows found, and so on. Repeated rows of a
    node are one.
    """

    def of_home(table: pa.Table) -> pa.Table:
        nodes, once = np.unique(table.column("node").to_numpy(), return_index=True)
        table = table.take(pa.array(once))
        texts = [t for c in table.column("text").chunks for t in binary(c)]
        sets = [np.unique(np.array(shingle_hashes(t or b"", shingle, seed), U64)) for t in texts]
        # two texts of one id may share the 64-bit hash of the join: the digest tells them apart
        right = np.array([xxhash.xxh3_128_digest(s.tobytes()) == d for s, d in zip(sets, table.column("digest").to_pylist(), strict=True)], bool)
        node, sets = nodes[right], [s for s, ok in zip(sets, right, strict=True) if ok]
        if not len(sets):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        n, size = len(sets), np.array(list(map(len, sets)), np.int64)
        stops = np.cumsum(size)
        names, ids = np.unique(np.concatenate(sets), return_inverse=True)
        owner, rest = np.repeat(np.arange(n), size), ids
        unseen, compacted = np.ones(n, bool), n
        child, parent = [], []
        for first in range(n):
            if not unseen[first]:
                continue
            unseen[first] = False
            reached = [first]
            while reached:
                x = reached.pop()
                left = int(unseen.sum())
                if left * 2 < compacted:
                    live = unseen[owner]
                    owner, rest, compacted = owner[live], rest[live], left
                mine = np.zeros(len(names), bool)
                mine[ids[stops[x] - size[x] : stops[x]]] = True
                both = np.bincount(owner[mine[rest]], minlength=n)
                near = np.flatnonzero(unseen & (both >= (size + size[x] - both) * similarity - 1e-9))
                unseen[near] = False
                reached += near.tolist()
                child += near.tolist()
                parent += [x] * len(near)
        return pa.table({"a": pa.array(node[child], pa.int64()), "b": pa.array(node[parent], pa.int64())})

    return of_home


def _text_key(text: Column) -> Column:
    """With the id, what a row is known by: rows without an id and texts that share one are told apart."""
    return F.xxhash64(text)


def near_classes(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """doc_id, text_key and the class of near copies of each row; ``first`` names the row of the class that comes first.

    Candidates share a pair of min-hashes (ten pairs: 99.996 % of the pairs at
    0.8 meet) and pass the bit-sliced comparison of their fingerprints of
    distinct shingles. Each class of candidates is then compared exactly: its
    texts are joined by id and text hash and meet in homes (two tiles of the
    class), where the sets decide. Rows with ids come first, by id, then by
    the hash of the text.
    """

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = [signature(shingle_hashes(t or b"", shingle, seed)) for t in binary(batch.column("text"))]
            bands, prints, digests = zip(*signed, strict=True) if signed else ((), (), ())
            columns = [*(batch.column(c) for c in ("doc_id", "text_key", "n_bytes")), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(prints, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "n_bytes", "digest", "bands", "print"])

    texts = columns_as(docs, doc_id="bigint", text="string").withColumn("text_key", _text_key(F.col("text")))
    sized = texts.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    schema = "doc_id long, text_key long, n_bytes long, digest binary, bands array<long>, print binary"
    rows = cut(sized.mapInArrow(rows_of, schema), "signatures")
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key")
    first = F.min_by(F.struct("n_bytes", "bands", "print"), place).alias("first")
    numbered = rows.groupBy("digest").agg(F.min(place).alias("row"), first).select("digest", "row", "first.*")
    same = cut(numbered.withColumn("node", F.monotonically_increasing_id()), "same")
    grouped = tiled(same.select("node", "print", F.posexplode("bands").alias("t", "key")), ["t", "key"])
    candidates = connected(grouped.mapInArrow(group_links(radius_of(similarity)), "a long, b long").distinct())
    members = cut(candidates.join(same.select("node", "n_bytes", "digest", "row"), "node"), "members")
    tiles = members.groupBy("label").agg(F.ceil(F.sum("n_bytes") / TILE_BYTES).cast("int").alias("tiles")).select("label", F.greatest("tiles", F.lit(1)).alias("tiles"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    placed = members.join(tiles, "label").select("node", "digest", "row", "label", F.pmod(F.xxhash64("node"), "tiles").alias("own"), other)
    homes = placed.select("node", "digest", "row", F.xxhash64("label", F.least("own", "other"), F.greatest("own", "other")).alias("home")).distinct()
    own_text = F.col("row.doc_id").eqNullSafe(texts.doc_id) & (F.col("row.text_key") == texts.text_key)
    met = homes.join(texts, own_text).select("home", "node", "digest", "text")
    labels = connected(met.groupBy("home").applyInArrow(exact_links(shingle, similarity, seed), "a long, b long").distinct())
    classes = cut(same.join(labels, "node", "left").select("digest", "row", F.coalesce("label", "node").alias("class")), "classes")
    named = classes.groupBy("class").agg(F.min("row").alias("first"))
    of_digest = split_join(classes.select("class", "digest"), named, "class").select("digest", "class", "first")
    return split_join(rows.select("doc_id", "text_key", "digest"), of_digest, "digest").select("doc_id", "text_key", "class", "first")


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """doc_id and component_id (the smallest id of its class; null where no row of it has one) of each row."""
    return near_classes(docs, shingle, similarity, seed).select("doc_id", F.col("first.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """The documents, all columns, one of each class of near copies: the one with the smallest id.

    Texts that share an id are told apart by the text. Rows without an id go
    where their class has a row with one; else the one with the smallest hash
    of its text stays. Of rows with the same id and text one stays, the one
    with the smallest hash of all columns.
    """
    classes = cut(near_classes(docs, shingle, similarity, seed), "near_classes")
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    gone = classes.filter(~is_first).select(F.col("doc_id").alias("__gone"), F.col("text_key").alias("__gone_key"))
    keyed = docs.withColumn("__key", _text_key(F.col("text").cast("string")))
    kept = keyed.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("__gone")) & (F.col("__key") == F.col("__gone_key")), "left_anti")
    repeated = classes.filter(is_first).groupBy("doc_id", "text_key").count().filter("count > 1").select(F.col("doc_id").alias("__twice"), F.col("text_key").alias("__twice_key"))
    if repeated.isEmpty():
        return kept.drop("__key")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__twice")) & (F.col("__key") == F.col("__twice_key"))
    whole = F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in docs.columns if c != "text"])))
    one = kept.join(repeated, same).groupBy("__key", "doc_id").agg(*[F.min_by(c, whole).alias(c) for c in docs.columns if c != "doc_id"])
    return kept.join(repeated, same, "left_anti").select(*docs.columns).unionByName(one.select(*docs.columns))
