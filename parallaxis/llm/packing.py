"""Hierarchical multi-length packing.

Documents are routed to tiers of context size (powers of two). What fills whole
windows of the largest tier is cut off first; the rest of a document goes to the
smallest tier that holds it. From the largest tier down, each rest opens a window of
its tier; the window's gap is filled by the largest rests of shorter tiers that fit,
and a last gap by cutting a shorter rest to measure, whose remainder returns to its
own (shorter) tier. A window is therefore full, and a full window is a power of two
and needs no padding. The few rests that a task has left at its end are laid in line
and cut into powers of two.

Windows of a tier form step groups of equal token count (STEP_TOKENS); inside a task
the windows of a flush are dealt to groups in snake order of their attention cost (sum
of squared piece lengths), so groups of a tier cost about the same.

Each task packs its own documents, so nothing is shuffled; what is held is bounded by
FLUSH_TOKENS plus one document. A lost task is packed again from the same rows with
the same result. Null text counts as empty: its one piece is the end id. Repeated
rows are packed each. Rests of equal length stay in the order of the rows, and windows
of equal cost in the order of packing. An empty table gives no pieces. Columns other
than doc_id and text play no part, whatever their names.
sequence_id = partition * 2**33 + number in the partition.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import documents, map_batches

TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 65_536
FLUSH_TOKENS = 2_000_000
END_ID = 1

SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
    "context int, step_group long"
)


class Tokenizer:
    """Ids as encode(text, add_special_tokens=False) of the tokenizers library gives them for a byte-level BPE file.

    The same ranks in tiktoken give the same ids about five times as fast. The two libraries differ
    where a text spells out an added token, which is one id there, and could differ where they know
    different versions of Unicode. Texts that spell out an added token, or have characters outside
    PLAIN, long established ones, therefore go through tokenizers itself.
    """

    PLAIN = "\x00-ʯͰ-ͳΆ-ϿЀ-ӿ‐-‧€ぁ-ゖァ-ヺ一-龥가-힣"

    def __init__(self, json_text: str, pattern: str):
        import json

        import tiktoken
        import tokenizers

        self.exact = tokenizers.Tokenizer.from_str(json_text)
        plain = _printable_bytes()
        vocabulary = json.loads(json_text)["model"]["vocab"]
        self.added = [t["content"] for t in json.loads(json_text).get("added_tokens", [])]
        ranks = {bytes(plain[c] for c in t): i for t, i in vocabulary.items() if t not in self.added}
        self.quick = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.other = regex.compile(f"[^{self.PLAIN}]")

    def encode(self, text: str) -> list[int]:
        if any(t in text for t in self.added) or self.other.search(text):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.quick.encode_ordinary(text)


def _printable_bytes() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Packer:
    """add() documents, flush() windows; a window is (context, [(doc, start, ids, doc_tokens)])."""

    def __init__(self, tiers=TIERS, step_tokens: int = STEP_TOKENS):
        self.tiers, self.step_tokens = tuple(sorted(tiers)), step_tokens
        self.whole: list = []
        self.rests: list = []
        self.held = 0
        self.groups: dict[int, int] = {}
        self.next_group = 0
        self.filled: dict[int, tuple[int, int]] = {}

    def add(self, doc, ids: np.ndarray) -> None:
        top, n, start = self.tiers[-1], len(ids), 0
        self.held += n
        while n - start >= top:
            self.whole.append((top, [(doc, start, ids[start : start + top], n)]))
            start += top
        if start < n:
            self.rests.append((doc, start, ids[start:], n))

    def flush(self, last: bool) -> list:
        """Windows that are full; all that is left, too, if last."""
        windows, self.whole, self.held = self.whole, [], 0
        # rests by length; equal lengths in order of arrival
        lengths, rests = [], []
        for rest in sorted(self.rests, key=lambda r: len(r[2])):
            lengths.append(len(rest[2]))
            rests.append(rest)

        def take(at: int):
            lengths.pop(at)
            return rests.pop(at)

        def put(rest) -> None:
            at = bisect.bisect_left(lengths, len(rest[2]))
            lengths.insert(at, len(rest[2]))
            rests.insert(at, rest)

        total = sum(lengths)
        while rests:
            context = self.tiers[bisect.bisect_left(self.tiers, lengths[-1])]
            if total < context:
                break
            first = take(-1)
            pieces, gap = [first], context - len(first[2])
            while gap:
                at = bisect.bisect_right(lengths, gap) - 1
                if at >= 0:
                    piece = take(at)
                else:
                    doc, start, ids, n = take(0)
                    piece = (doc, start, ids[:gap], n)
                    put((doc, start + gap, ids[gap:], n))
                pieces.append(piece)
                gap -= len(piece[2])
            total -= context
            windows.append((context, pieces))
        self.rests = rests
        if last and rests:
            windows += self._powers(rests, total)
            self.rests = []
        return windows

    @staticmethod
    def _powers(rests: list, total: int) -> list:
        out, queue = [], list(rests)
        for bit in range(total.bit_length() - 1, -1, -1):
            size = 1 << bit
            if not total & size:
                continue
            pieces, gap = [], size
            while gap:
                doc, start, ids, n = queue.pop()
                pieces.append((doc, start, ids[:gap], n))
                if len(ids) > gap:
                    queue.append((doc, start + gap, ids[gap:], n))
                gap -= len(pieces[-1][2])
            out.append((size, pieces))
        return out

    def step_groups(self, windows: list) -> list[int]:
        """A step group for each window: equal tokens, and near-equal attention cost by snake order."""
        out = [0] * len(windows)
        by_context: dict[int, list[int]] = {}
        for i, (context, _) in enumerate(windows):
            by_context.setdefault(context, []).append(i)
        for context, members in sorted(by_context.items()):
            room = max(1, self.step_tokens // context)
            count = -(-len(members) // room)
            members.sort(key=lambda i: (-sum(len(p[2]) ** 2 for p in windows[i][1]), i))
            for place, i in enumerate(members):
                lap, at = divmod(place, count)
                out[i] = self.next_group + (at if lap % 2 == 0 else count - 1 - at)
            self.next_group += count
        return out


def pack(docs: DataFrame, tokenizer_json: str, pattern: str, tiers=TIERS) -> DataFrame:
    """One row per piece, with its ids (little-endian unsigned 32-bit). No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer_json, pattern))  # the vocabulary, fixed in size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(*shared.value)
        packer = Packer(tiers)
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 33
        end = np.array([END_ID], "<u4")

        def rows(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            windows = packer.flush(last)
            base = (context.partitionId() if context else 0) << 33
            groups = packer.step_groups(windows)
            for at in range(0, len(windows), 1000):
                columns: list[list] = [[] for _ in range(9)]
                for (size, pieces), group in zip(windows[at : at + 1000], groups[at : at + 1000], strict=True):
                    offset = 0
                    for doc, start, ids, n in pieces:
                        row = (doc, start, len(ids), ids.tobytes(), n, sequence, offset, size, base + group)
                        for column, value in zip(columns, row, strict=True):
                            column.append(value)
                        offset += len(ids)
                    sequence += 1
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 3, pa.int32(), pa.int64()]
                names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "context", "step_group"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packer.add(doc, np.concatenate((np.array(tokenizer.encode(text or ""), "<u4"), end)))
                if packer.held >= FLUSH_TOKENS:
                    yield from rows(last=False)
        yield from rows(last=True)

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
        "context", "step_group",
    )


def pack_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    with open(vocabulary or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return digest(pack(docs, f.read(), public_tokenizers.PATTERN))


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
