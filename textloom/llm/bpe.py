"""Byte-level BPE with a pair occurrence index over the distinct words of a slice of a partition."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from textloom.llm.common import per_document, pieces

#: A file of "base64 rank" lines, and the pattern of the words that merges stay within. The file stays where it is.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a slice, and the tokens of distinct words that a worker keeps from slice to slice.
SLICE_CHARS, CACHED_TOKENS = 6_000_000, 1_000_000
#: Tokens that are decoded at once, or one run of them.
DECODED_TOKENS = 200_000
#: Rank of a pair that doesn't merge.
NEVER = np.int32(np.iinfo(np.int32).max)
#: Groups of new pairs beyond this size are sorted by rank in numpy.
MANY = 64


class Vocabulary:
    """Bytes of each token, and the merged token of each pair of tokens whose bytes together are a token; its id is its rank."""

    def __init__(self, path: str = VOCABULARY) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError(f"{path} lacks a byte")
        self.size = max(ranks.values()) + 1
        self.tokens = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:k]] * self.size + ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        pairs.sort()
        self.keys = np.array([k for k, _ in pairs] + [np.iinfo(np.int64).max], np.int64)
        self.merged = np.array([r for _, r in pairs] + [NEVER], np.int32)
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.merged[at], NEVER)


@lru_cache(maxsize=2)
def vocabulary(path: str = VOCABULARY) -> Vocabulary:
    return Vocabulary(path)


def merge(vocab: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all words, one word after another, and how many each has.

    The index holds, for each rank, the positions of all pairs that merge into it, over all words at once. The lowest rank is
    taken off, all its pairs are merged from left to right, and the pairs that this makes on either side go on their own
    ranks' lists. A position whose pair has changed since is passed over. As words share no pair, this is what merging the
    lowest-ranked pair of each word, the leftmost first, comes to.
    """
    lengths = np.array([len(w) for w in words], np.int64)
    raw = np.frombuffer(b"".join(words), np.uint8)
    n = len(raw)
    if not n:
        return np.zeros(0, np.int32), lengths
    token = vocab.of_byte[raw]
    after, before = np.arange(1, n + 1, dtype=np.int64), np.arange(-1, n - 1, dtype=np.int64)
    filled = lengths > 0
    ends = np.cumsum(lengths)[filled]
    after[ends - 1] = -1
    before[(ends - lengths[filled])] = -1
    pair = np.full(n, NEVER, np.int32)
    inner = np.flatnonzero(after >= 0)
    pair[inner] = vocab.rank(token[inner], token[inner + 1])
    index: dict[int, list] = {}
    heap: list[int] = []

    def add(at: np.ndarray, ranks: np.ndarray) -> None:
        if len(at) > MANY:
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            groups = zip(ranks[np.r_[0, cuts]].tolist(), np.split(at, cuts), strict=True)
        else:
            groups = zip(ranks.tolist(), at.tolist(), strict=True)
        for rank, some in groups:
            held = index.get(rank)
            if held is None:
                index[rank] = [some]
                heapq.heappush(heap, rank)
            else:
                held.append(some)

    live = np.flatnonzero(pair != NEVER)
    if len(live):
        add(live, pair[live])
    while heap:
        rank = heapq.heappop(heap)
        held = index.pop(rank)
        arrays = [x for x in held if isinstance(x, np.ndarray)]
        single = [x for x in held if not isinstance(x, np.ndarray)]
        at = np.concatenate([*arrays, np.array(single, np.int64)]) if arrays else np.array(single, np.int64)
        at = at[pair[at] == rank]
        if len(held) > 1:
            at = np.unique(at)
        if not len(at):
            continue
        follows = np.flatnonzero(after[at[:-1]] == at[1:])
        if len(follows):  # pairs that overlap: of a chain the first, third, fifth ... are merged
            chained = np.zeros(len(at), bool)
            chained[follows + 1] = True
            place = np.arange(len(at))
            first = np.maximum.accumulate(np.where(chained, 0, place))
            at = at[(place - first) % 2 == 0]
        gone = after[at]
        then = after[gone]
        token[at] = rank
        token[gone] = -1
        pair[gone] = NEVER
        after[at] = then
        inside = then >= 0
        before[then[inside]] = at[inside]
        prior = before[at]
        changed = np.concatenate([at, prior[prior >= 0]])
        changed = np.unique(changed) if len(at) > 1 else changed
        nexts = after[changed]
        pair[changed] = NEVER
        has = nexts >= 0
        changed, nexts = changed[has], nexts[has]
        ranks = vocab.rank(token[changed], token[nexts])
        pair[changed] = ranks
        useful = ranks != NEVER
        if useful.any():
            add(changed[useful], ranks[useful])
    alive = token >= 0
    word = np.repeat(np.arange(len(words)), lengths)
    return token[alive], np.bincount(word[alive], minlength=len(words))


class Encoder:
    """Encodes texts slice by slice; words that an earlier slice has met aren't merged again while they are kept."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab, self.words = vocab, regex.compile(PATTERN)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.tokens, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts, one after another, and how many each has. A null text has none."""
        if len(self.tokens) > CACHED_TOKENS:
            self.forget()
        known, fresh, of_text, sizes = self.known, [], [], []
        for t in texts:
            found = self.words.findall(t) if t else []
            sizes.append(len(found))
            for w in found:
                i = known.get(w)
                if i is None:
                    i = known[w] = len(known)
                    fresh.append(w)
                of_text.append(i)
        if fresh:
            tokens, counts = merge(self.vocab, [w.encode("utf-8", "surrogatepass") for w in fresh])
            self.starts = np.concatenate([self.starts, len(self.tokens) + np.cumsum(counts) - counts])
            self.tokens, self.counts = np.concatenate([self.tokens, tokens]), np.concatenate([self.counts, counts])
        word = np.array(of_text, np.int64)
        flat = spread(self.tokens, self.starts[word], self.counts[word])
        text = np.repeat(np.arange(len(texts)), sizes)
        return flat, np.bincount(text, self.counts[word], len(texts)).astype(np.int64)


def spread(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """values[start : start + count] of each, one after another."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(starts - ends + counts, counts)]


def decode(vocab: Vocabulary, tokens: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Bytes of each run of tokens. Ids that the vocabulary lacks raise an IndexError."""
    if len(tokens) and (tokens.min() < 0 or tokens.max() >= vocab.size):
        raise IndexError("no such token")
    ends, out, i = np.cumsum(counts), [], 0
    while i < len(counts):  # a part at a time, as each byte takes an index of its own
        first = int(ends[i] - counts[i])
        j = max(i + 1, int(np.searchsorted(ends, first + DECODED_TOKENS, "right")))
        part = tokens[first : int(ends[j - 1])]
        sizes = vocab.lengths[part]
        raw = spread(vocab.bytes, vocab.starts[part], sizes).tobytes()
        cuts = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], ends[i:j] - first])].tolist()
        out += [raw[x:y] for x, y in zip(cuts, cuts[1:])]
        i = j
    return out


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(id, tokens, n_tokens, exact) of each row; exact says whether the tokens decode to the text's very bytes.

    A null text has all three null; an empty one has no token. Special tokens' strings are ordinary text. Repeated rows are
    encoded alike, an empty table gives an empty one, other columns are ignored. Map-only. The index covers a slice of
    a partition, of SLICE_CHARS or one text, and the tokens that a worker keeps are bounded, so memory doesn't follow the input.
    """

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        encoder = Encoder(vocab)

        def out(ids: list[pa.Array], texts: list[str | None]) -> Iterator[pa.RecordBatch]:
            tokens, counts = encoder.encode(texts)
            none = np.array([t is None for t in texts], bool)
            raw = decode(vocab, tokens, counts)
            exact = np.array([t is not None and r == t.encode("utf-8", "surrogatepass") for r, t in zip(raw, texts, strict=True)], bool)
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, mask=np.r_[none, False]), pa.array(tokens))
            whole = pa.record_batch([pa.concat_arrays(ids), lists, pa.array(counts, mask=none), pa.array(exact, mask=none)], ["id", "tokens", "n_tokens", "exact"])
            for at in range(0, len(texts), 1000):
                yield whole.slice(at, 1000)

        ids: list[pa.Array] = []
        texts: list[str | None] = []
        total = 0
        for batch in batches:
            for part, some in pieces(batch):
                ids.append(part)
                texts += some
                total += sum(len(t) for t in some if t)
                if total >= SLICE_CHARS:
                    yield from out(ids, texts)
                    ids, texts, total = [], [], 0
        if texts:
            yield from out(ids, texts)

    return per_document(docs, id_col, text_col, "tokens array<int>, n_tokens long, exact boolean", f)


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens", path: str = VOCABULARY) -> DataFrame:
    """(id, text) of each row of tokens; bytes that aren't UTF-8, as of tokens cut off in a character, become U+FFFD. Null tokens give null."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import StringType, StructType

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            runs = [None if r is None else np.array(r, np.int64) for r in batch.column(1).to_pylist()]
            filled = [np.zeros(0, np.int64) if r is None else r for r in runs]
            raw = decode(vocab, np.concatenate(filled) if filled else np.zeros(0, np.int64), np.array([len(r) for r in filled], np.int64))
            yield pa.record_batch([batch.column(0), pa.array([None if r is None else b.decode("utf-8", "replace") for r, b in zip(runs, raw, strict=True)], pa.string())], ["id", "text"])

    picked = encoded.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{tokens_col}`").alias("tokens"))
    return picked.mapInArrow(f, StructType().add("id", encoded.schema[id_col].dataType).add("text", StringType())).withColumnRenamed("id", id_col)
