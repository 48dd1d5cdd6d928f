"""Byte-level BPE encoding and decoding by backtracking over longest matches.

A piece of text (a match of the split pattern) is a string of Latin-1
characters, one a byte, so that an Aho-Corasick automaton over the vocabulary
finds the longest token that starts at each byte. The merges of a piece give
tokens ``t1 t2 ..`` exactly where the bytes of each neighbouring pair ``ti ti+1``
by themselves merge into these two tokens: no merge ever crosses a place where
tokens meet, and before a first one did, each pair would have been merged as it
is alone. So the encoding is the one path of tokens in which all neighbours are
compatible. The search takes the longest compatible token at a place, then
shorter ones, and steps back where none is left; the path to a place is unique,
so a place given up once is given up for good, and each place is entered once.
Whether two tokens are compatible is found by taking their merges back one by
one, the last first, and memorised.

As in the tiktoken library a piece that is a token of the vocabulary is that
token, whatever its bytes would merge into.

Defined results: a null or empty text has no ids and decodes to no bytes; null
ids decode to null; special names in a text are ordinary text; one text is
encoded like any other however long it is, in time and memory linear in its
longest piece; repeated rows are rows of their own; a piece has one encoding,
so there are no ties; an empty table gives an empty result; columns of any
other name pass through.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, table

#: Entries that a worker keeps of pieces and of pairs before it starts anew; they save time and change no result.
MEMO = 1 << 18
#: Longer pieces are not kept.
MEMO_CHARS = 64
#: Characters from which on a text's pieces are not held at once.
LONG = 1 << 20
_LOADED: dict[tuple[str, str], Vocabulary] = {}


def multi_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def merged(raw: bytes, ranks: dict[bytes, int], until: int = 1) -> list[bytes]:
    """The merges by their definition: the pair of least rank, leftmost first, until none is left or ``until`` parts are."""
    parts = [raw[i : i + 1] for i in range(len(raw))]
    never = 1 << 60
    while len(parts) > until:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], never), i) for i in range(len(parts) - 1))
        if rank == never:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class Pieces(dict):
    """Pieces and their ids as bytes, made by ``search`` when they are first met; the least recently filled half goes when it is full."""

    def __init__(self, search: Callable[[bytes], list[int]], ranks: dict[bytes, int]):
        super().__init__()
        self.search, self.ranks, self.old = search, ranks, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            found = array("i", self.search(raw) if whole is None else (whole,)).tobytes()
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.old = self.copy()
                self.clear()
            self[piece] = found
        return found


class Vocabulary:
    """A rank file with its automaton. ``ranks`` must hold all single bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.raw = {i: b for b, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for raw, i in ranks.items():
            self.automaton.add_word(raw.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.size = {i: len(b) for b, i in ranks.items()}
        self.sure = max(64, 3 * max(self.size.values()))  # a match that begins here or earlier in a window is in it whole
        self.window = self.sure + max(self.size.values())
        self.shorter_memo: dict[int, int] = {}
        self.last_memo: dict[int, tuple[int, int] | None] = {}
        self.order_memo: dict[int, bool] = {}
        self.pair_memo: dict[tuple[int, int], bool] = {}
        self.pieces = Pieces(self.search, ranks)

    def shorter(self, token: int) -> int:
        """The longest token that is a proper beginning of ``token``; -1 if there is none."""
        if (found := self.shorter_memo.get(token)) is None:
            raw = self.raw[token]
            found = next((self.ranks[raw[:k]] for k in range(len(raw) - 1, 0, -1) if raw[:k] in self.ranks), -1)
            self.shorter_memo[token] = found
        return found

    def last_merge(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; itself twice for a byte; None where its bytes do not merge into it."""
        if token not in self.last_memo:
            raw = self.raw[token]
            parts = merged(raw, self.ranks, 2)
            made = [token, token] if len(raw) == 1 else [self.ranks[p] for p in parts] if len(parts) == 2 else None
            self.last_memo[token] = tuple(made) if made else None
        return self.last_memo[token]

    def in_order(self, token: int) -> bool:
        """Whether each merge that makes ``token`` has a higher rank than those that made its two parts, so that merges come in the order of ranks."""
        if (found := self.order_memo.get(token)) is None:
            parts = self.last_merge(token) if len(self.raw[token]) > 1 else ()
            found = self.order_memo[token] = all(len(self.raw[p]) == 1 or p < token and self.in_order(p) for p in parts)
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether the bytes of both merge into these two tokens. ``left`` is -1 at the start of a piece: then ``right`` by itself."""
        if self.last_merge(right) is None:
            return False
        return left < 0 or self.apart(left, right)

    def apart(self, left: int, right: int) -> bool:
        """Whether no merge crosses the place where two tokens meet, each of which its own bytes merge into.

        Merges are taken back, the last one first, which is the one of the highest rank, and of equal
        ranks the right one (tokens whose merges are in another order are merged anew). The tokens that then meet would have merged if their pair
        came before the merge taken back: by a lower rank, or an equal one that
        stands further left.
        """
        ranks, raw = self.ranks, self.raw
        if not (self.in_order(left) and self.in_order(right)):
            return merged(raw[left] + raw[right], ranks) == [raw[left], raw[right]]
        a, b, before = left, right, len(ranks) + 1 + max(left, right)
        while True:
            pair = ranks.get(raw[a] + raw[b])
            if pair is not None and pair < before:
                return False
            rank_a, rank_b = (a if len(raw[a]) > 1 else -1), (b if len(raw[b]) > 1 else -1)
            if rank_a < 0 and rank_b < 0:
                return True
            if rank_a > rank_b:
                a, before = self.last_merge(a)[1], a
            else:
                b, before = self.last_merge(b)[0], b + 1

    def search(self, piece: bytes) -> list[int]:
        """Tokens of a piece by backtracking from the longest matches.

        The automaton walks on over longest matches for as long as these are
        taken; where a shorter token is, a new walk begins behind it. A walk sees a
        window of the piece, and ends where a token might reach beyond that.
        """
        text, end = piece.decode("latin-1"), len(piece)
        given_up = bytearray(end + 1)
        walks, size, known, shorter, tokens, at, before = self.automaton.iter_long, self.size, self.pair_memo, self.shorter, [], 0, -1
        walk, sure = walks(text[: self.window]), self.sure if end > self.window else end
        token = longest = next(walk)[1]
        while True:
            while token >= 0:
                after = at + size[token]
                if not given_up[after]:
                    fits = known.get((before, token))
                    if fits is None:
                        if len(known) >= MEMO:
                            known.clear()
                        fits = known[before, token] = self.compatible(before, token)
                    if fits:
                        break
                token = shorter(token)
            if token >= 0:
                tokens.append(token)
                at = after
                if at == end:
                    return tokens
                if token != longest or at >= sure:
                    window = at + self.window
                    walk, sure = walks(text[at:window]), at + self.sure if window < end else end
                before = token
                token = longest = next(walk)[1]
            elif not tokens:
                raise ValueError("the vocabulary lacks a byte of this piece")
            else:
                given_up[at] = 1
                token = tokens.pop()
                at -= size[token]
                before = tokens[-1] if tokens else -1
                token, longest = shorter(token), -1

    def encode(self, text: str) -> np.ndarray:
        """Ids; the pieces of a long text are taken one by one, never held at once."""
        cuts = self.pattern.findall(text) if len(text) < LONG else (m[0] for m in self.pattern.finditer(text))
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, cuts)), np.int32)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """The vocabulary of a rank file, once a worker process."""
    if (path, pattern) not in _LOADED:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path, pattern] = Vocabulary(ranks, pattern)
    return _LOADED[path, pattern]


def encoder(path: str, pattern: str) -> Callable[[Column], Column]:
    """A function of a text column that gives its ids. The file at ``path`` lies on every node."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids_of(texts: pa.Array) -> pa.Array:
        v = vocabulary(path, pattern)
        parts, ends = [np.zeros(0, np.int32)], [0]
        for t in texts:
            parts.append(v.encode(t.as_py() or ""))
            ends.append(ends[-1] + len(parts[-1]))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts), pa.int32()))

    return ids_of.asNondeterministic()  # or what stands on top of it would have it run once more for each use


def decoder(path: str, pattern: str) -> Callable[[Column], Column]:
    """A function of a column of ids that gives their bytes, which need not be whole characters."""

    @F.arrow_udf(T.BinaryType())
    def bytes_of(ids: pa.Array) -> pa.Array:
        v = vocabulary(path, pattern)
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        flat, ends = ids.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
        out = (v.decode(flat[end - n : end].tolist()) if there else None for n, end, there in zip(sizes, ends, ids.is_valid().to_pylist(), strict=True))
        return pa.array(out, pa.binary())

    return bytes_of


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of their texts in a column ``ids``, which must be new."""
    bounded_batches(docs.sparkSession)
    if ids.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"there is a column {ids} already")
    return docs.withColumn(ids, encoder(path, pattern)(F.col(text).cast("string")))


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", raw: str = "raw") -> DataFrame:
    """``encoded`` with the bytes of its ids in a column ``raw``, which must be new."""
    bounded_batches(encoded.sparkSession)
    if raw.lower() in (c.lower() for c in encoded.columns):
        raise ValueError(f"there is a column {raw} already")
    return encoded.withColumn(raw, decoder(path, pattern)(F.col(ids)))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of ``docs``."""
    coded = decode(encode(docs.select("doc_id", "text"), path, pattern), path, pattern)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), multi_path(), public_pattern())
