"""SimHash near-duplicates: a grid join over the bit counts of fingerprints' segments, then exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textloom.llm.common import cut, per_document, pieces

#: Bits of a fingerprint, and the greatest Hamming distance of near duplicates: about one word in ten replaced.
BITS, DISTANCE = 256, 40
#: Bits of a grid coordinate's segment, and of the segments whose counts bound the distance from below before it is computed.
FINE, COARSE = 2, 16
SEGMENTS, LANES = BITS // FINE, BITS // 64
#: A pair at the greatest distance is found with probability RECALL, whatever the table's size; closer ones are found more often.
RECALL, SEED = 0.999, 7
#: The part of that which the grids inside a cell must find of the pairs that meet there.
INNER = 0.8
#: Rows of a shuffled grid's cell, on average, and at most: a larger cell is cut into blocks, and each pair of blocks is searched.
CELL, MOST = 200_000, 800_000
#: Unrelated fingerprints that share a fingerprint's cell of an inner grid, on average.
PARTNERS = 24
#: Chance that two unrelated fingerprints have the same count in a segment: words that a language shares make it higher than the 3/8 of random bits.
CHANCE = 0.404
#: All pairs of an inner cell are compared at once up to this size; larger ones are gridded again or searched breadth-first, which finds the same components.
SMALL_CELL, LARGE_CELL = 128, 4096
#: Characters of a text that are cut into words at a time.
BLOCK = 1 << 16

_BASE = 0x9E3779B97F4A7C15
_HALVES = np.uint64(0x5555555555555555)


# Fingerprints


@lru_cache(maxsize=1)
def _word_signs() -> np.ndarray:
    """Whether each code point belongs to a word: letters, digits and the underscore of any script."""
    return np.array([c.isalnum() or c == "_" for c in map(chr, range(0x110000))])


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base modulo 2^64, and of its inverse."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit number of each word of the lower-case text, equal for equal words; differences of running sums give all of them at once."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    word = _word_signs()[codes]
    out, at = [], 0
    while at < len(codes):
        end = min(at + BLOCK, len(codes))
        if end < len(codes):  # no word is cut: the block ends behind a sign that is in none
            gaps = np.flatnonzero(~word[at:end])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                later = np.flatnonzero(~word[end:])
                end = end + int(later[0]) + 1 if len(later) else len(codes)
        w = word[at:end]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], w, [False])).view(np.int8)))
        start, stop = edges[::2], edges[1::2]
        size = len(w) + 1
        up, down = _powers(BLOCK + 1 if size <= BLOCK + 1 else size)
        sums = np.zeros(size, np.uint64)
        np.cumsum(codes[at:end].astype(np.uint64) * up[: len(w)], out=sums[1:])
        out.append((sums[stop] - sums[start]) * down[start])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def lanes_of(words: np.ndarray) -> np.ndarray:
    """LANES well mixed numbers of each word's hash."""
    x = words[:, None] + np.arange(1, LANES + 1, dtype=np.uint64) * np.uint64(_BASE)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sums(text: str) -> np.ndarray | None:
    """The word counts' SimHash before its signs are taken: each distinct word adds its 256 signs, weighted with 1 + ln(count) in sixteenths, so sums are exact."""
    words, n = np.unique(word_hashes(text), return_counts=True)
    if not len(words):
        return None
    weights = np.rint(16 * (1 + np.log(n)))
    total = np.zeros(BITS)
    for at in range(0, len(words), 4096):
        bits = np.unpackbits(lanes_of(words[at : at + 4096]).astype(">u8").view(np.uint8), axis=1)
        total += weights[at : at + 4096].astype(np.float32) @ bits.astype(np.float32)
    return 2 * total - weights.sum()


def to_lanes(bits: np.ndarray) -> np.ndarray:
    """Rows of BITS booleans as rows of LANES uint64. Unsigned: bits of a negative number would be counted of its absolute value."""
    return np.packbits(bits, axis=1).view(">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, f0 to f3) of each row whose text has a word and whose id isn't null. Map-only."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in pieces(batch):
                found = [sums(t) if t else None for t in texts]
                there = [i for i, s in enumerate(found) if s is not None]
                if there:
                    lanes = to_lanes(np.array([found[i] for i in there]) > 0).view(np.int64)
                    yield pa.record_batch([ids.take(pa.array(there, pa.int64())), *(pa.array(lanes[:, k]) for k in range(LANES))], ["id", *(f"f{k}" for k in range(LANES))])

    known = docs.where(F.col(f"`{id_col}`").isNotNull())
    return per_document(known, id_col, text_col, ", ".join(f"f{k} long" for k in range(LANES)), f).withColumnRenamed(id_col, "id")


# The grids


def segments_for(n: float, share: float) -> int:
    """Segments after which so few unrelated fingerprints of n share a cell."""
    return max(0, ceil(log(max(n / share, 1)) / -log(CHANCE)))


def inner_grids(k: int, distance: int) -> int:
    """Grids of k segments of which one brings a pair at the distance together with probability INNER."""
    return 1 if not k else next(g for g in range(1, 1 << 30) if chance(k, g, distance) >= INNER)


@lru_cache(maxsize=1024)
def equal_segments(distance: int) -> tuple[tuple[int, float], ...]:
    """(number of segments with equal counts, its probability) of a pair that differs in distance random bits."""
    out: dict[int, float] = {}
    for both in range(max(0, distance - SEGMENTS), distance // 2 + 1):  # segments that differ in both bits; half of these have equal counts
        ways = comb(SEGMENTS, both) * comb(SEGMENTS - both, distance - 2 * both) * 2 ** (distance - 2 * both) / comb(BITS, distance)
        for even in range(both + 1):
            k = SEGMENTS - distance + both + even
            out[k] = out.get(k, 0.0) + ways * comb(both, even) / 2**both
    return tuple(out.items())


@lru_cache(maxsize=4096)
def chance(dims: int, grids: int, distance: int) -> float:
    """Probability that such a pair has equal counts in all dims segments of one of the grids: an average over pairs, as those with few equal segments meet in hardly any."""
    return sum(p * (1 - (1 - comb(k, dims) / comb(SEGMENTS, dims)) ** grids) for k, p in equal_segments(distance))


def recall(dims: int, tables: int, distance: int) -> float:
    """Probability that the pair is found: that it meets in a cell of one of the tables, and there in an inner grid."""
    k = segments_for(MOST, PARTNERS)
    inner = inner_grids(k, distance)
    total = 0.0
    for e, p in equal_segments(distance):
        outer = comb(e, dims) / comb(SEGMENTS, dims)
        within_cell = 1 - (1 - (comb(e - dims, k) / comb(SEGMENTS - dims, k) if e >= dims else 0)) ** inner
        total += p * (1 - (1 - outer * within_cell) ** tables)
    return total


@lru_cache(maxsize=64)
def _layout(dims: int, distance: int, target: float) -> int:
    least, tables = 0, 1
    while recall(dims, tables, distance) < target:
        least, tables = tables, 2 * tables
    while tables - least > 1:
        middle = (least + tables) // 2
        least, tables = (middle, tables) if recall(dims, middle, distance) < target else (least, middle)
    return tables


def layout(n: int, distance: int = DISTANCE, target: float = RECALL) -> np.ndarray:
    """The segments of each table's grid, for n distinct fingerprints.

    A grid has so many that its cells hold about CELL rows, and there are so many tables that a pair at the distance is found
    with the target's probability whatever n is: more rows make smaller shares of the pairs meet in one table, and more tables.
    Tables take segments off a shuffled list, and none comes again before all have had a turn.
    """
    dims = min(max(2, segments_for(n, CELL)), 24)
    tables = _layout(dims, distance, target)
    rng, whole = np.random.default_rng(SEED), SEGMENTS - SEGMENTS % dims
    turns = [rng.permutation(SEGMENTS)[:whole] for _ in range(ceil(tables * dims / whole))]
    return np.concatenate(turns)[: tables * dims].reshape(tables, dims)


def counts_of(lanes: np.ndarray) -> np.ndarray:
    """Each segment's bit count, in place of the segment."""
    return (lanes & _HALVES) + ((lanes >> np.uint64(1)) & _HALVES)


def cell_numbers(lanes: np.ndarray, grids: np.ndarray) -> Iterator[np.ndarray]:
    """Of each table, the rows' cells: a number made of the table's and of its segments' bit counts, from 0 to 2."""
    counts = counts_of(lanes)
    powers = 3 ** np.arange(grids.shape[1], dtype=np.int64)
    each = [((counts[:, s // 32] >> np.uint64(62 - 2 * (s % 32))) & np.uint64(3)).astype(np.int64) for s in range(SEGMENTS)]
    for g, segments in enumerate(grids):
        cell = np.full(len(lanes), g * 3 ** grids.shape[1], np.int64)
        for power, s in zip(powers, segments.tolist(), strict=True):
            cell += power * each[s]
        yield cell


def _lanes(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.stack([batch[f"f{k}"].to_numpy() for k in range(LANES)], axis=1).view(np.uint64)


def hot_cells(firsts: DataFrame, grids: np.ndarray, most: int) -> dict[int, int]:
    """Blocks of each cell that has more than most rows. There are rows * tables / most such cells at the utmost."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            for cell in cell_numbers(_lanes(batch), grids):
                for c, n in zip(*(x.tolist() for x in np.unique(cell, return_counts=True)), strict=True):
                    total[c] = total.get(c, 0) + n
        yield pa.record_batch([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["cell", "n"])

    found = firsts.mapInArrow(f, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > most)
    return {r["cell"]: -(-r["n"] // (most // 2)) for r in found.toLocalIterator()}


def cells(firsts: DataFrame, grids: np.ndarray, hot: dict[int, int]) -> DataFrame:
    """(cell, part, id, f0 to f3) in each table. A row of a hot cell is in one part for each block that its own is paired with."""
    names = sorted(hot)
    keys, blocks = np.array(names, np.int64), np.array([hot[c] for c in names], np.int64)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lanes = _lanes(batch)
            own = (lanes_of(lanes[:, 0] ^ lanes[:, 3])[:, 0] >> np.uint64(1)).astype(np.int64)
            for cell in cell_numbers(lanes, grids):
                at = np.searchsorted(keys, cell)
                warm = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == cell) if len(keys) else np.zeros(0, np.int64)
                cold = np.setdiff1d(np.arange(len(cell)), warm, assume_unique=True) if len(warm) else np.arange(len(cell))
                rows, part = [cold], [np.zeros(len(cold), np.int64)]
                if len(warm):
                    n = blocks[at[warm]]
                    mine = own[warm] % n
                    again, other = np.repeat(warm, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    mine = np.repeat(mine, n)
                    rows.append(again)
                    part.append(1 + np.minimum(mine, other) * (1 << 31) + np.maximum(mine, other))
                r = np.concatenate(rows)
                taken = batch.take(pa.array(r)) if len(warm) else batch
                yield pa.record_batch([pa.array(cell[r]), pa.array(np.concatenate(part)), *taken.columns], ["cell", "part", *batch.schema.names])

    out = StructType().add("cell", "long").add("part", "long")
    for field in firsts.schema.fields:
        out.add(field)
    return firsts.mapInArrow(f, out)


# Inside a cell


class Rows:
    """Fingerprints with the counts of their coarse segments, whose Manhattan distance never exceeds the Hamming distance."""

    def __init__(self, lanes: np.ndarray) -> None:
        self.lanes = lanes
        self.coarse = np.bitwise_count(np.ascontiguousarray(lanes).view(f"u{COARSE // 8}")).astype(np.int8)

    def near(self, a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
        """Whether the rows a and b are within the distance; the bound rules out what it can, the rest is compared bit by bit."""
        ok = np.abs(self.coarse[a] - self.coarse[b]).sum(axis=1, dtype=np.int16) <= distance
        at = np.flatnonzero(ok)
        if len(at):
            a, b = (x if np.ndim(x) == 0 else x[at] for x in (a, b))
            far = np.zeros(len(at), np.uint16)
            for k in range(LANES):
                far += np.bitwise_count(self.lanes[a, k] ^ self.lanes[b, k])
            ok[at] = far <= distance
        return ok


def search(rows: Rows, left: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges that join just the rows that paths of near pairs join: each row visited is compared with all not yet visited."""
    edges = []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = rows.near(np.int64(x), left, distance)
            for y in left[near].tolist():
                edges.append((x, y))
                queue.append(y)
            left = left[~near]
    return edges


def pairs_within(rows: Rows, at: np.ndarray, distance: int, rng: np.random.Generator, fixed: frozenset[int] = frozenset()) -> list[tuple[np.ndarray, np.ndarray]]:
    """Near pairs of the rows at, or as many of them as connect the same rows: by grids over segments that aren't fixed in the cell yet."""
    k = min(segments_for(len(at), PARTNERS), 40)
    free = np.array([s for s in range(SEGMENTS) if s not in fixed])
    out: list[tuple[np.ndarray, np.ndarray]] = []
    counts = counts_of(rows.lanes[at])
    for _ in range(inner_grids(k, distance)):
        taken = rng.permutation(free)[:k]
        mask = np.zeros(LANES, np.uint64)
        for s in taken.tolist():
            mask[s // 32] |= np.uint64(3) << np.uint64(62 - 2 * (s % 32))
        key = np.zeros(len(at), np.uint64)
        for lane in range(LANES):
            key = (key ^ (counts[:, lane] & mask[lane])) * np.uint64(_BASE)
            key ^= key >> np.uint64(29)
        order = np.argsort(key)
        key, sorted_rows = key[order], at[order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.concatenate((starts, [len(key)])))
        small = np.repeat(size <= SMALL_CELL, size)
        rank = np.arange(len(key)) - np.repeat(starts, size)
        for step in range(1, int(min(size.max(), SMALL_CELL))):
            j = np.flatnonzero(small & (rank >= step))
            a, b = sorted_rows[j - step], sorted_rows[j]
            ok = rows.near(a, b, distance)
            if ok.any():
                out.append((a[ok], b[ok]))
        for s, n in zip(starts[size > SMALL_CELL].tolist(), size[size > SMALL_CELL].tolist(), strict=True):
            own = sorted_rows[s : s + n]
            if n > LARGE_CELL and n < len(at) // 2 and len(fixed) + k < SEGMENTS // 2:
                out += pairs_within(rows, own, distance, rng, fixed | set(taken.tolist()))
            else:
                edges = np.array(search(rows, own, distance), np.int64).reshape(-1, 2)
                out.append((edges[:, 0], edges[:, 1]))
    return out


def forest(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(row, the first row of its component) of the rows that pairs join to an earlier one."""
    root = np.arange(n)
    if pairs:
        a, b = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
        while len(a):
            a, b = root[a], root[b]
            apart = a != b
            a, b = np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])
            np.minimum.at(root, b, a)
            while (root[root] != root).any():
                root = root[root]
    joined = np.flatnonzero(root != np.arange(n))
    return joined, root[joined]


def near_in_cells(placed: DataFrame, grids: np.ndarray, distance: int) -> DataFrame:
    """(u, v) of links that connect each cell's near fingerprints: a member and the component's first row in the cell."""

    def whole(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts).combine_chunks()
        lanes = _lanes(t)
        if len(lanes) < 2:
            return
        table = int(t["cell"][0].as_py()) // 3 ** grids.shape[1]
        rng = np.random.default_rng([SEED, table])
        u, v = forest(len(lanes), pairs_within(Rows(lanes), np.arange(len(lanes)), distance, rng, frozenset(grids[table].tolist())))
        if len(u):
            ids = t["id"].combine_chunks()
            ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
            yield pa.record_batch([ids.take(pa.array(u)), ids.take(pa.array(v))], ["u", "v"])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last: tuple[int, int] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, part = batch["cell"].to_numpy(), batch["part"].to_numpy()
            starts = [0, *(np.flatnonzero((cell[1:] != cell[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), len(cell)]
            for a, b in zip(starts, starts[1:]):
                now = (int(cell[a]), int(part[a]))
                if now != last and held:
                    yield from whole(held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = now
        if held:
            yield from whole(held)

    kind = placed.schema["id"].dataType
    return placed.repartition("cell", "part").sortWithinPartitions("cell", "part").mapInArrow(f, StructType().add("u", kind).add("v", kind))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of the edges (u, v); root is the least node of its component.

    Alternating large and small stars: each round is two aggregations and joins over the edges, whose number never grows.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        now = cut(small.distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = state


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(id, kept_id) of each document that is in a group with another; kept_id is the least id of the group.

    Groups are the components of pairs within the distance. A null id takes no part; nor does a text that is null, empty or
    without a word. Rows that share an id count as one document, so repeated rows give no pair of their own. An empty table
    gives an empty result. Other columns are never read. Equal fingerprints count once in the grids, so thousands of exact
    copies cost what one costs; a cell with more rows than a worker should hold is searched in pairs of blocks.
    """
    names = [f"f{k}" for k in range(LANES)]
    prints = cut(fingerprints(docs, id_col, text_col))
    firsts = cut(prints.groupBy(*names).agg(F.min("id").alias("id")).select("id", *names))
    members = prints.join(firsts.withColumnRenamed("id", "first"), names).select("id", "first")
    grids = layout(firsts.count(), distance)
    edges = near_in_cells(cells(firsts, grids, hot_cells(firsts, grids, MOST)), grids, distance)
    alike = members.where("id <> first").select(F.col("id").alias("u"), F.col("first").alias("v"))
    return components(edges.unionByName(alike)).select(F.col("node").alias(id_col), F.col("root").alias("kept_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """docs with the document of the least id of each group, and of rows that share an id the one whose text, then whole row, hashes lowest.

    Rows with a null id stay, as do those whose text has no word unless their id is that of another row that goes.
    """
    key = F.col(f"`{id_col}`")
    gone = near_duplicates(docs, id_col, text_col, distance).select(key.alias("gone"))
    kept = docs.join(gone, docs[f"`{id_col}`"] == gone["gone"], "left_anti")
    again = cut(docs.select(key.alias("again")).where("again IS NOT NULL").groupBy("again").count().where("count > 1").select("again"))
    if again.isEmpty():
        return kept
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(F.col(f"`{text_col}`").cast("string")), F.xxhash64(F.to_json(row))))
    several = kept.join(again, kept[f"`{id_col}`"] == again["again"], "left_semi")
    one = several.select(row.alias("row"), rank.alias("rank")).where("rank = 1").select("row.*")
    return kept.join(again, kept[f"`{id_col}`"] == again["again"], "left_anti").unionByName(one)
