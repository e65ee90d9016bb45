"""Token counts by rank-synchronous array merging.

The model's pieces and scores define a merge table: two neighbouring symbols
merge if their concatenation is a piece, better scores first, the leftmost first
among equals.  Texts are cut into pre-tokens where no piece can reach across
(before a run of the word mark; checked against the vocabulary when it is
loaded).  The distinct pre-tokens of a slice are held as one ragged array of
symbols; in each round every sequence applies its lowest-rank pair, all sequences
at once, and only pairs beside a merge are looked up again.  Sequences without a
pair left are done, and their surviving symbols are counted: one token for each
piece, one per UTF-8 byte for a character outside the vocabulary.

All places of the lowest pair in a sequence are merged in one round if the new
symbol cannot start a pair of the same or a better rank (``_alone`` marks the
pieces where it can: then only the leftmost place is merged).  Long sequences of
such pieces, say a run of blanks, go through a heap instead.

Memory: one slice of text, two generations of about ``CACHE_WORDS``
short pre-tokens, and the merge table.  The vocabulary file is read on the executors from ``path``.

Defined results: null counts as empty and has 0 tokens; ids may repeat or be
null; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import map_slices, table, text_of

MARK = "▁"
CACHE_WORDS = 300_000
CACHED_LENGTH = 64
LONG = 64
LIMIT = 4096
_NONE = np.int32(2**31 - 1)


class PieceCounter:
    """Counts the tokens of a sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())
                  if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        if any(MARK in p.lstrip(MARK) for p, _ in pieces) or sp.normalize(" a  ﬁ\n") != f"{MARK}{MARK}a{MARK}{MARK}ﬁ\n":
            raise ValueError(f"{path}: pieces reach across words, or texts are normalised")
        known = {p for p, _ in pieces}
        names = sorted(known | {c for p in known for c in p})
        number = {p: i for i, p in enumerate(names)}
        self.size = len(names) + 1  # the last symbol stands for any other character
        order = {s: r for r, s in enumerate(sorted({s for _, s in pieces}, reverse=True))}
        self.rank_of = np.full(self.size, _NONE, np.int32)
        for p, s in pieces:
            self.rank_of[number[p]] = order[s]
        keys, merged = [], []
        self._alone = np.zeros(self.size, bool)
        for p, _ in pieces:
            whole = number[p]
            for i in range(1, len(p)):
                left, right = number.get(p[:i]), number.get(p[i:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    merged.append(whole)
                    for part in (left, right):
                        if self.rank_of[whole] <= self.rank_of[part] < _NONE:
                            self._alone[part] = True
        at = np.argsort(keys)
        self.keys, self.merged = np.array(keys, np.int64)[at], np.array(merged, np.int32)[at]
        self.char_symbol = np.full(0x110000, self.size - 1, np.int32)
        self.char_cost = np.ones(0x110000, np.int32)
        self.char_cost[0x80:] += 1
        self.char_cost[0x800:] += 1
        self.char_cost[0x10000:] += 1
        for name, i in number.items():
            if len(name) == 1:
                self.char_symbol[ord(name)] = i
                if name in known:
                    self.char_cost[ord(name)] = 1
        self.cache: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged symbol of each pair, or -1."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], -1)

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym, cost = self.char_symbol[chars], self.char_cost[chars]
        seq = np.repeat(np.arange(len(words)), lengths)
        counts = np.zeros(len(words), np.int64)
        if not len(sym):
            return counts
        new = np.full(len(sym), -1, np.int32)
        new[:-1] = np.where(seq[:-1] == seq[1:], self._pairs(sym[:-1], sym[1:]), -1)
        while len(sym):
            rank = np.where(new >= 0, self.rank_of[new], _NONE)
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            sizes = np.diff(np.r_[starts, len(sym)])
            best = np.minimum.reduceat(rank, starts)
            done = best == _NONE
            if done.any():
                counts[seq[starts[done]]] = np.add.reduceat(cost, starts)[done]
                keep = np.repeat(~done, sizes)
                sym, cost, seq, new, rank = sym[keep], cost[keep], seq[keep], new[keep], rank[keep]
                best, sizes = best[~done], sizes[~done]
                if not len(sym):
                    break
                starts = np.r_[0, np.cumsum(sizes)[:-1]]
            at = np.flatnonzero(rank == np.repeat(best, sizes))
            alone = self._alone[new[at]]
            if alone.any():
                # One place at a time for these: the first of the sequence.
                first = np.r_[True, seq[at[1:]] != seq[at[:-1]]]
                holds = np.zeros(len(counts), bool)
                holds[seq[at[alone]]] = True
                at = at[first | ~holds[seq[at]]]
                long = holds[seq[starts]] & (sizes > LONG)
                if long.any():
                    for s, n in zip(starts[long], sizes[long]):
                        counts[seq[s]] = self._by_heap(sym[s:s + n].tolist(), cost[s:s + n].tolist())
                    keep = np.repeat(~long, sizes)
                    moved = np.cumsum(keep) - 1
                    at = moved[at[keep[at]]]
                    sym, cost, seq, new = sym[keep], cost[keep], seq[keep], new[keep]
                    if not len(sym):
                        break
            # Of overlapping places the first, third, ... are merged.
            run = np.r_[True, np.diff(at) != 1]
            at = at[(np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))) % 2 == 0]
            sym[at], cost[at] = new[at], 1
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at = (np.cumsum(keep) - 1)[at]
            sym, cost, seq, new = sym[keep], cost[keep], seq[keep], new[keep]
            new[at] = -1
            again = np.unique(np.r_[at, at[at > 0] - 1])
            again = again[again < len(sym) - 1]
            same = seq[again] == seq[again + 1]
            new[again] = -1
            again = again[same]
            new[again] = self._pairs(sym[again], sym[again + 1])
        return counts

    def _by_heap(self, sym: list[int], cost: list[int]) -> int:
        """Surviving cost of one sequence, merged pair by pair."""
        n = len(sym)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        pairs = {}

        def pair(a: int, b: int) -> int:
            key = (a, b)
            if key not in pairs:
                pairs[key] = int(self._pairs(np.array([a]), np.array([b]))[0])
            return pairs[key]

        heap = []

        def push(i: int) -> None:
            j = after[i]
            if j < n and (m := pair(sym[i], sym[j])) >= 0:
                heapq.heappush(heap, (int(self.rank_of[m]), i, sym[i], sym[j], m))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], cost[i], sym[j], cost[j] = m, 1, -1, 0
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                push(before[i])
            push(i)
        return sum(cost)

    _SPACED = re.compile(f"{MARK}+[^{MARK}]*")

    def tokens(self, texts: list[str]) -> list[int]:
        """Tokens of each whole text."""
        split = [self._SPACED.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        wanted = set().union(*split)
        known, older = self.cache, self.older
        for w in wanted & older.keys():
            known.setdefault(w, older[w])
        fresh = list(wanted.difference(known))
        known.update(zip(fresh, self.count(fresh).tolist()))
        counts = [sum(map(known.__getitem__, words)) for words in split]
        for w in fresh:
            if len(w) > CACHED_LENGTH:
                del known[w]
        if len(known) > CACHE_WORDS:
            self.cache, self.older = {}, known
        return counts


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    """One counter per worker process and vocabulary."""
    return PieceCounter(path)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit."""
    def per_slice(ids, texts):
        return ids, [len(t.encode()) for t in texts], (n := counter(path).tokens(texts)), [x > limit for x in n]

    id_type = docs.schema[id_col].dataType.simpleString()
    return map_slices(docs.select(F.col(id_col), text_of(F.col(text_col)).alias("text")), per_slice,
                      f"`{id_col}` {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op10_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
