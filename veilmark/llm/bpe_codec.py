"""Byte-level BPE encoding and decoding in linear time.

Method.  A text is split by the tokenizer's pattern.  A piece's bytes are mapped to Latin-1 so that an Aho-Corasick
automaton over all tokens finds, in one pass, the longest token that starts at each byte.  The encoder takes longest
matches and backtracks: a token may follow another only if the two are compatible, that is, if merging their joined
bytes by rank gives back just these two.  A sequence whose neighbours are all compatible is the one that the merges
give, so the first one that reaches the end is exact.  Positions from which the end can't be reached are marked and
never tried again, which bounds the work by the piece's length.  Compatibility is memoised.

Scale.  One narrow pass, no shuffle.  A worker holds the vocabulary, and within a task caches of bounded size for
pieces and pairs.
Output columns are digests and counts; ``encode`` returns the ids themselves.

Defined cases.  A null text counts as empty: no ids, and the digests of no bytes.  Strings of special tokens are
ordinary text.  Lone surrogates can't occur in Spark strings.  Repeated rows each get a row, rows without an id too.  An
empty table gives an empty result.  Extra columns do not matter, whatever their names.  A very long text is encoded whole,
piece by piece.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import sys
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from veilmark.llm.sequences import handed_back

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PIECE_CACHE = 300_000
PAIR_CACHE = 300_000
BATCH_ROWS = 256


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


class _Cache(dict):
    """Results by key, worked out on first use; emptied when full, and without very long keys."""

    def __init__(self, work: Callable[[str], bytes]) -> None:
        super().__init__()
        self.work = work

    def __missing__(self, key: str) -> bytes:
        found = self.work(key)
        if len(key) <= 64:
            if len(self) >= PIECE_CACHE:
                self.clear()
            self[key] = found
        return found


class Codec:
    """Encoder and decoder for one vocabulary; ``pattern`` splits texts into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.split = regex.compile(pattern).findall
        self.pieces = _Cache(self.encode_piece)
        self.pairs: dict[int, bool] = {}
        #: Of each token that merging can make, the two parts of its last merge; the others only stand for a whole piece.
        self.halves: dict[int, tuple[int, int] | None] = {}
        for token, rank in ranks.items():
            parts = self.merged(token, 2)
            if len(parts) == 1 or token[: len(parts[0])] + parts[-1] == token:
                self.halves[rank] = None if len(token) == 1 else (ranks[parts[0]], ranks[parts[1]])
        self.shorter: dict[int, int] = {}
        self.automaton = ahocorasick.Automaton()
        for rank in self.halves:
            token = self.bytes_of[rank]
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
            self.shorter[rank] = next((r for n in range(len(token) - 1, 0, -1) if (r := ranks.get(token[:n], -1)) in self.halves), -1)
        self.automaton.make_automaton()

    def forget(self) -> None:
        """Empty the caches."""
        self.pieces.clear()
        self.pairs.clear()

    def merged(self, piece: bytes, until: int = 1) -> list[bytes]:
        """The definition, in quadratic time: join the neighbours of lowest rank until none can be joined."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > until:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives both back.

        It does not if at some time the part of ``left`` that then touches the border, and that of ``right``, make a
        token of lower rank than the merges that take them away from the border (``left_until``, ``right_until``; of
        equal ranks the one further left goes first).  Parts are visited backwards in time.
        """
        key = left << 32 | right
        found = self.pairs.get(key)
        if found is not None:
            return found
        name, halves, ranks = self.bytes_of, self.halves, self.ranks
        left_until = right_until = 1 << 60
        found = True
        while True:
            crossing = ranks.get(name[left] + name[right])
            if crossing is not None and crossing < left_until and crossing <= right_until:
                found = False
                break
            if halves[left] is None and halves[right] is None:
                break
            if halves[right] is None or halves[left] is not None and left > right:
                left_until, left = left, halves[left][1]
            else:
                right_until, right = right, halves[right][0]
        if len(self.pairs) >= PAIR_CACHE:
            self.pairs.clear()
        self.pairs[key] = found
        return found

    def tokens(self, piece: bytes) -> list[int]:
        """The exact merges of a piece, by backtracking."""
        n = len(piece)
        longest = [-1] * n
        for end, (token, length) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - length + 1] = token  # longer ones end later
        dead = bytearray(n + 1)
        taken: list[int] = []
        at, token = 0, longest[0]
        name, compatible, shorter = self.bytes_of, self.compatible, self.shorter
        while at < n:
            while token >= 0:
                end = at + len(name[token])
                if not dead[end] and (not taken or compatible(taken[-1], token)):
                    break
                token = shorter[token]
            if token >= 0:
                taken.append(token)
                at = end
                token = longest[at] if at < n else -1
            elif not taken:
                raise ValueError("the vocabulary lacks a byte of the text")
            else:
                dead[at] = 1
                token = taken.pop()
                at -= len(name[token])
                token = shorter[token]
        return taken

    def encode_piece(self, piece: str) -> bytes:
        raw = piece.encode()
        whole = self.ranks.get(raw)
        return self.packed([whole] if whole is not None else self.tokens(raw))

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        """Little-endian unsigned 32-bit integers."""
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """The packed ids."""
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(packed).cast("I") if sys.byteorder == "little" else struct.unpack(f"<{len(packed) // 4}I", packed)))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """A worker's codec; Spark reuses workers, so it is built once for many tasks."""
    return Codec(read_ranks(path), pattern)


def encode(docs: DataFrame, text: str = "text", id_col: str = "doc_id", path: str | None = None, pattern: str = public_tokenizers.PATTERN, with_ids: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, if asked for ids (array<int>), and docs' columns named in ``carry``."""
    path = path or public_tokenizers.path(VOCABULARY)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids, *carry]

    @handed_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                rows: list[tuple] = []
                for value in batch.column(1):
                    ids = own.encode(value.as_py() or "")
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest(), ids))
                n, coded, decoded, ids = zip(*rows)
                columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(coded), pa.array(decoded)]
                if with_ids:
                    ends = np.cumsum([0, *n])
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
                yield pa.RecordBatch.from_arrays([*columns, *(batch.column(i) for i in range(2, batch.num_columns))], names)
        own.forget()  # the worker may go on to other stages

    kinds = [docs.schema[id_col].dataType.simpleString(), "long", "string", "string", *["array<int>"] * with_ids, *(docs.schema[c].dataType.simpleString() for c in carry)]
    return docs.select(docs[id_col].alias("doc_id"), docs[text].alias("text"), *(docs[c] for c in carry)).mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in zip(names, kinds)))


def report(docs: DataFrame) -> DataFrame:
    return encode(docs, with_ids=False)
