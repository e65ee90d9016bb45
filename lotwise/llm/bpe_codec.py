r"""BPE encoding and decoding with forced-boundary splitting.

A vocabulary with word ends spells every token as a row of byte symbols, the last
byte of a word being a symbol of its own (byte + ``</w>``).  Two neighbouring
symbols that stand together inside no token of the vocabulary can never be
merged, so a cut between them is certain.  Word ends are always such cuts; others
lie inside words.  The fragments between cuts are encoded independently, and
their ids are concatenated.

Before that, as the vocabulary file states: strings of the special tokens are set
apart, the rest is normalised (NFC, white space to one blank, lower case) and
split into letters, single digits and other signs.  Chunks between white space in
which all characters are below U+0300 take a pattern made here from the Unicode
categories (NFC leaves them alone); other chunks go through the library's own
normaliser and splitter, part by part.  The merging itself never does.

Decoding joins the tokens' strings by one blank, as the library does for a
vocabulary without a decoder: it returns the normalised words with ``</w>`` ends.

Memory: one slice of text and at most two generations of
``CACHE_FRAGMENTS`` short fragments.  The vocabulary file is read on the executors from ``path``.

Defined results: null counts as empty and has no ids; ids may repeat or be null;
an empty table gives an empty result; further columns are ignored unless carried.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import map_slices, table, text_of

CACHE_FRAGMENTS = 120_000
WORD_END = 0xFF
CACHED_LENGTH = 64
SHORT = 48
_LAST = 1 << 40
#: Where NFC starts to matter; all characters below are stable.
SAFE = 0x300
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CHUNKS = re.compile(f"[^{_WHITE}]+")
_BEYOND = re.compile(f"[^\\x00-\\u{SAFE - 1:04x}]")
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLITTER = [{"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True},
             {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: printable Latin-1 bytes
    stand for themselves, the others for the letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + other.index(b)) for b in range(256)]


def _category(first: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(SAFE) if unicodedata.category(chr(c))[0] == first)


class _Fragments(dict):
    """The ids of fragments met lately: when one generation is full, the next
    begins, and what is met again moves over."""

    def __init__(self, codec: ForcedBoundaryCodec):
        self.codec, self.older = codec, {}

    def __missing__(self, fragment: bytes) -> bytes:
        ids = self.older.get(fragment)
        if ids is None:
            ids = self.codec.fragment_ids(fragment)
        if len(fragment) <= CACHED_LENGTH:
            if len(self) >= CACHE_FRAGMENTS:
                self.older = dict(self)
                self.clear()
            self[fragment] = ids
        return ids


class ForcedBoundaryCodec:
    """Encoder and decoder of one word-end BPE vocabulary."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if (spec["normalizer"]["normalizers"], spec["pre_tokenizer"]["pretokenizers"], spec["decoder"],
                model["end_of_word_suffix"]) != (_NORMAL, _SPLITTER, None, "</w>"):
            raise ValueError(f"{path}: a vocabulary of another kind")
        self._library = Tokenizer.from_file(path)
        letters = byte_letters()
        self._byte = {c: b for b, c in enumerate(letters)}
        vocab = model["vocab"]
        self.names = [""] * (max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])]) + 1)
        for token, i in vocab.items():
            self.names[i] = token
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for token, i in self.special.items():
            self.names[i] = token
        self._specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        # Symbol b is byte b inside a word, 256 + b at its end.
        self.symbol_id = [vocab[c] for c in letters] + [vocab[c + "</w>"] for c in letters]
        self.joined = np.zeros((512, 512), bool)
        for token in vocab:
            s = self._symbols_of(token)
            self.joined[s[:-1], s[1:]] = True
        self._joined = self.joined.ravel()
        pairs = [(vocab[a], vocab[b]) for a, b in model["merges"]]
        self.rank_of = {pair: rank for rank, pair in reversed(list(enumerate(pairs)))}
        self.merged_id = [vocab[a + b] for a, b in model["merges"]]
        self._words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_category('L')}]+|[{_category('N')}]"
                                 f"|[^{_WHITE}{_category('L')}{_category('N')}]+")
        self._ids = _Fragments(self)

    def _symbols_of(self, token: str) -> list[int]:
        ends = token.endswith("</w>") and len(token) > 4
        s = [self._byte[c] for c in (token[:-4] if ends else token)]
        if ends:
            s[-1] += 256
        return s

    def fragments(self, words: list[str]) -> list[bytes]:
        """The bytes of all words, cut at every certain boundary; ``WORD_END``
        (a byte that UTF-8 never uses) follows the last byte of a word."""
        data = np.frombuffer("\n".join(words).encode() + b"\n", np.uint8)
        ends = data == 10
        symbols = data.astype(np.int32)
        symbols[:-1][ends[1:]] += 256
        cut = ~self._joined[symbols[:-1] << 9 | (symbols[1:] & 511)]
        cut &= ~(ends[:-1] | ends[1:])
        # Inside a word the cut follows its byte; at its end the mark comes first.
        at = np.flatnonzero(cut) + 1
        stops = np.flatnonzero(ends)
        spread = np.insert(data, np.r_[at, stops], np.r_[np.full(len(at), 10, np.uint8),
                                                         np.full(len(stops), WORD_END, np.uint8)])
        return spread.tobytes().split(b"\n")[:-1]

    def symbols(self, fragment: bytes) -> list[int]:
        if fragment[-1] == WORD_END:
            return [*fragment[:-2], fragment[-2] + 256]
        return list(fragment)

    def _merged(self, ids: list[int]) -> list[int]:
        """Merge the lowest-ranked pair, the leftmost among equals, until none is
        left: by looking at all pairs in short rows, by a heap in long ones."""
        n, rank_of = len(ids), self.rank_of
        if n <= SHORT:
            ranks = [rank_of.get(pair, _LAST) for pair in zip(ids, ids[1:])]
            while ranks and (best := min(ranks)) < _LAST:
                i = ranks.index(best)
                ids[i:i + 2] = [whole := self.merged_id[best]]
                del ranks[i]
                if i < len(ranks):
                    ranks[i] = rank_of.get((whole, ids[i + 1]), _LAST)
                if i:
                    ranks[i - 1] = rank_of.get((ids[i - 1], whole), _LAST)
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def push(i: int, j: int) -> None:
            if i >= 0 and j < n and (rank := rank_of.get((ids[i], ids[j]))) is not None:
                heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        for i in range(n - 1):
            push(i, i + 1)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.merged_id[rank], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            push(i, k)
            push(before[i], i)
        return [i for i in ids if i >= 0]

    def fragment_ids(self, fragment: bytes) -> bytes:
        """The ids of one fragment."""
        return np.array(self._merged([self.symbol_id[s] for s in self.symbols(fragment)]), "<u4").tobytes()

    def words(self, text: str) -> list[str]:
        """The normalised words of a text without special tokens."""
        if not _BEYOND.search(text):
            return self._words.findall(text.lower())
        out = []
        for chunk in _CHUNKS.findall(text):
            if not _BEYOND.search(chunk):
                out += self._words.findall(chunk.lower())
                continue
            for word, _ in self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(chunk)):
                out.append(bytes(map(self._byte.__getitem__, word)).decode())
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        out = []
        for part in self._specials.split(text) if "<|" in text else (text,):
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            elif words := self.words(part):
                out += map(self._ids.__getitem__, self.fragments(words))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str) -> ForcedBoundaryCodec:
    """One codec per worker process and vocabulary."""
    return ForcedBoundaryCodec(path)


def _digests(text: str, path: str) -> tuple[int, str, str]:
    ids = codec(path).encode(text)
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec(path).decode(ids).encode()).hexdigest()


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                     decoded: bool = True) -> DataFrame:
    """One row per document: id, n_tokens, ids (array of int), the digests of the
    ids and of the decoded text, and that text if ``decoded``."""
    def per_slice(ids, texts):
        c = codec(path)
        rows = [c.encode(t) for t in texts]
        out = [ids, [len(r) // 4 for r in rows], [np.frombuffer(r, "<i4") for r in rows],
               [hashlib.sha256(r).hexdigest() for r in rows]]
        back = [c.decode(r) for r in rows]
        out.append([hashlib.sha256(d.encode()).hexdigest() for d in back])
        return [*out, back] if decoded else out

    id_type = docs.schema[id_col].dataType.simpleString()
    return map_slices(docs.select(F.col(id_col), text_of(F.col(text_col)).alias("text")), per_slice,
                      f"`{id_col}` {id_type}, n_tokens bigint, ids array<int>, ids_sha256 string, decoded_sha256 string"
                      + ", decoded string" * decoded)


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens and the digests of its ids and of the
    decoded text; both stay inside the worker, only digests leave it."""
    def per_slice(ids, texts):
        return (ids, *map(list, zip(*(_digests(t, path) for t in texts))))

    id_type = docs.schema[id_col].dataType.simpleString()
    return map_slices(docs.select(F.col(id_col), text_of(F.col(text_col)).alias("text")), per_slice,
                      f"`{id_col}` {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_forced_bpe(spark, sf_dir):
    return round_trip_digests(table(spark, sf_dir, "documents"), vocabulary())
