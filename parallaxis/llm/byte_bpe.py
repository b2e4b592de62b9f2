"""Byte-level BPE by dynamic programming over prefixes.

For each byte prefix of a piece exactly one token can be the last token of the
prefix's encoding. prefix_tokens() stores it: position i holds the last token of the
encoding of the first i bytes, so walking back from any position yields that prefix's
encoding. A token may follow another only if merging the bytes of the two gives the
two again; that check is memoised. Appending bytes continues the array, and an edit
re-encodes only the pieces around it.

The pieces are the matches of the pattern; a piece that is itself in the vocabulary is
one token, as the ranks' own library has it. Null text counts as empty (no tokens).
Repeated rows are encoded each; an empty table gives no rows. Texts of any length are
encoded whole; memory is one text, its tokens and a bounded cache of pieces. Of two merges
with one rank the left one comes first. Columns other than doc_id and text play no part,
whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import documents, map_batches

#: Cached pieces in a worker (about 200 bytes each); the cache is emptied when full. Affects speed only.
CACHE_PIECES = 1_000_000


_LAYOUTS = [struct.Struct(f"<{n}I") for n in range(64)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PrefixEncoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.reachable = {t: r for t, r in ranks.items() if len(t) == 1 or self._merge(t) == [r]}
        #: every end of a token: its own rank if it is a token, else -1
        self.ends = {t[i:]: -1 for t in self.reachable for i in range(len(t))} | self.reachable
        self.follows: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}

    def _merge(self, data: bytes) -> list[int]:
        """Repeatedly join the neighbours of lowest rank, leftmost first: the definition, for short strings."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _may_follow(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.follows.get(key)
        if known is None:
            if len(self.follows) > 1_000_000:
                self.follows.clear()
            known = self.follows[key] = self._merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def prefix_tokens(self, data: bytes, last: list[int] | None = None) -> list[int]:
        """last[i] for every prefix; give the list of a beginning of data to append to it."""
        last = [-1] if last is None else last
        end_of, follows, may_follow = self.ends.get, self.follows, self._may_follow
        for end in range(len(last), len(data) + 1):
            choices = []
            start = end - 1
            while start >= 0 and (token := end_of(data[start:end])) is not None:
                if token >= 0:
                    choices.append((start, token))
                start -= 1
            while choices:
                start, token = choices.pop()
                if start == 0:
                    last.append(token)
                    break
                known = follows.get(last[start] << 32 | token)
                if known or (known is None and may_follow(last[start], token)):
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return last

    def walk_back(self, last: list[int], end: int) -> list[int]:
        out = []
        while end:
            out.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return out[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        rank = self.ranks.get(data)
        return [rank] if rank is not None else self.walk_back(self.prefix_tokens(data), len(data))

    def _packed(self, piece: str) -> bytes:
        ids = self.encode_piece(piece.encode("utf-8", "surrogatepass"))
        ids = _LAYOUTS[len(ids)].pack(*ids) if len(ids) < len(_LAYOUTS) else np.array(ids, "<u4").tobytes()
        if len(self.pieces) >= CACHE_PIECES:
            self.pieces.clear()
        if len(piece) <= 64:
            self.pieces[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        known, packed = self.pieces.get, self._packed
        return b"".join([known(p) or packed(p) for p in self.pattern.findall(text)]) if text else b""

    def re_encode(self, text: str, ids: bytes, start: int, end: int, new: str) -> tuple[str, bytes]:
        """The text with [start:end] replaced, and its ids: pieces away from the edit keep theirs."""
        changed = text[:start] + new + text[end:]
        before = list(self.pattern.finditer(text))
        # pieces look at most one character ahead: those that end before the edit with a piece between stay
        head = 0
        while head + 2 < len(before) and before[head + 2].start() < start:
            head += 1
        at = before[head].start() if before else 0
        kept = sum(self._count(m[0]) for m in before[:head])
        fresh, shift = [], len(changed) - len(text)
        old_start = {m.start() + shift: i for i, m in enumerate(before) if m.start() > end}
        for m in self.pattern.finditer(changed, at):
            if m.start() in old_start and m.start() > start + len(new):
                tail = sum(self._count(x[0]) for x in before[: old_start[m.start()]])
                return changed, ids[: 4 * kept] + b"".join(fresh) + ids[4 * tail :]
            fresh.append(self.pieces.get(m[0]) or self._packed(m[0]))
        return changed, ids[: 4 * kept] + b"".join(fresh)

    def _count(self, piece: str) -> int:
        return len(self.pieces.get(piece) or self._packed(piece)) // 4

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[int, PrefixEncoder] = {}


def _worker_encoder(shared) -> PrefixEncoder:
    """One encoder, with its cache, for the life of a Python worker."""
    ranks, pattern = shared.value
    key = hash((pattern, len(ranks), tuple(list(ranks.items())[-5:])))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = PrefixEncoder(ranks, pattern)
    return _encoders[key]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit). No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))  # the vocabulary, fixed in size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker_encoder(shared)
        for batch in batches:
            ids = [encoder.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return map_batches(_input(docs), run, "doc_id long, ids binary")


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """The contract's digests of ids and of the decoded bytes; ids are hashed where they are made."""
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker_encoder(shared)
        for batch in batches:
            counts, ids_hash, decoded_hash = [], [], []
            for text in batch.column(1).to_pylist():
                ids = encoder.encode(text)
                counts.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                decoded_hash.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(decoded_hash, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return map_batches(_input(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def op3_byte_bpe(spark, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    ranks = read_ranks(vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return round_trip(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)
