"""Language-model scores by online logistic context mixing.

A text is the sequence of its lower-cased words (A-Z only), then an end. A score is the
sum over tokens, in text order, of log10 probabilities of binary decisions, which
`mixing` predicts from several hashed contexts with gated weights and an adaptive map.

A token is coded in two steps. Its class comes first: each of the TOP most frequent
training words is a class of its own, the others share classes by form (first and last
two bytes) and frequency; there is one class for words without training occurrences, one
for the end, and one for other words that the document has had before. The class is
spelt by a Huffman code, and the contexts of its decisions are earlier tokens of the
document: none, the last class, the last two classes, the last frequent word, the last
two frequent words. Inside a class a known word has its share of the class' occurrences,
and a word that comes again an equal share of those that the document has had. An
unknown word is spelt in bytes with a closing blank; contexts there are the position and
the last one to five bytes of the word, learnt from the distinct training words. A
training document's own occurrences are left out of the counts that score it: a word
that no other training document has is unknown to it.

Counts of words are exact and grow with the input (a table of distinct words). Contexts'
counts are exact sums over all training documents in a fixed number of cells, which
contexts share by hash. Mixers and maps of classes learn online in text order: documents
are dealt by hash into segments of about SEGMENT_TOKENS tokens, and each segment learns
from its training documents as it goes; steps of STEP tokens. Segments, shards and steps
follow from the data alone, so a score does not depend on the number of cores.

Blocks of documents hold token numbers; only the distinct words of a block travel.

Null text counts as empty: one token, the end. A row with a null id is held out (its
remainder is unknown). Repeated rows count each. Without training tokens every bit is
even and the base score uses N = V = 0; an empty table has no rows. Any length of text
is scored whole. Columns other than doc_id and text play no part, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mixing
from ._common import discard, documents, map_batches, materialize

FOLDS, HELD_OUT = 7, 2
#: Words with a class of their own (short ones, so that the list is small), forms and frequencies of the other classes.
TOP, TOP_BYTES, FORMS, BANDS = 254, 64, 32, 16
UNKNOWN, END, AGAIN = 0, 1, 2
OTHERS = 3 + TOP
CLASSES = OTHERS + FORMS * BANDS
#: Bits of the contexts of classes: none, last class, last two, last frequent word, last two; of bytes: position, last two to five.
CLASS_BITS, CLASS_GATES = (0, 18, 20, 18, 20), (2, 4)
BYTE_BITS, BYTE_GATES = (11, 18, 20, 20, 20), (2, 4)
#: Characters of text that one block of documents holds about.
BLOCK_CHARS = 16_000_000
#: Distinct words that one shard learns spelling from about, and tokens of a segment; symbols of a step.
SHARD_WORDS, SEGMENT_TOKENS, STEP = 150_000, 1_000_000, 1 << 15
#: Tokens whose contexts are counted together.
COUNTED = 1 << 20
#: Entries of the cells that travel together.
PIECE = 1 << 13
#: Words of a block that one packed row holds at most; words of documents that are coded together, or of one.
PACKED, LOT = 1 << 20, 1 << 17


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


# ------------------------------------------------------------------ classes


def form_of(word: bytes) -> int:
    return zlib.crc32(word[:2] + b"|" + word[-2:]) % FORMS


def class_of(place: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Class of words seen so often; place: form, or -1 - rank of a top word."""
    band = np.minimum(np.frexp(np.maximum(count, 1))[1] - 1, BANDS - 1)
    known = np.where(place < 0, AGAIN - place, OTHERS + place * BANDS + band)
    return np.where(count > 0, known, UNKNOWN)


def share_of(place: np.ndarray, count: np.ndarray, masses: np.ndarray) -> np.ndarray:
    """log10 of a known word's share of its class; 0 for the others."""
    seen = np.maximum(count, 1).astype(np.float64)
    inside = (place >= 0) & (count > 0)
    return np.where(inside, np.log10(seen / np.maximum(seen, masses[class_of(place, count)])), 0.0)


def class_contexts(classes: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Hashed contexts of the tokens of some documents, laid in line; starts: of each document."""
    at = np.arange(len(classes), dtype=np.int64)
    begin = np.repeat(starts, np.diff(np.append(starts, len(classes))))

    def there(place: np.ndarray) -> np.ndarray:
        return np.where(place >= begin, classes[np.maximum(place, 0)], CLASSES)

    frequent = (classes > AGAIN) & (classes < OTHERS)
    last = np.concatenate([[-1], np.maximum.accumulate(np.where(frequent, at, -1))[:-1]]) if len(classes) else at
    before = np.where(last >= begin, last[np.maximum(last, 0)], -1)
    one, two, near, far = there(at - 1), there(at - 2), there(last), there(before)
    none = np.zeros(len(classes), np.uint32)
    return [none, mixing.hashed(one), mixing.hashed(one, two) + np.uint32(1), mixing.hashed(near) + np.uint32(5), mixing.hashed(near, far) + np.uint32(7)]


# ------------------------------------------------------------------ spelling


class Spelling:
    """Words in line as bytes with closing blanks: symbols, their word's number and their contexts."""

    def __init__(self, words: list[bytes]):
        closed = [w + b" " for w in words]
        lengths = np.array([len(w) for w in closed], np.int64)
        self.symbols = np.frombuffer(b"".join(closed), np.uint8).astype(np.int64)
        self.word = np.repeat(np.arange(len(words)), lengths)
        place = np.arange(len(self.symbols)) - (np.cumsum(lengths) - lengths)[self.word]
        self.contexts, running = [mixing.hashed(np.minimum(place, 7))], np.zeros(len(place), np.uint32)
        for k in range(1, len(BYTE_BITS) + 1):
            earlier = np.zeros(len(place), np.uint32)
            earlier[k:] = self.symbols[:-k] + 1
            earlier[place < k] = 0
            running = mixing.hashed(running, earlier)
            if k > 1:
                self.contexts.append(running)

    def steps(self, counted: np.ndarray, learnt: np.ndarray) -> Iterator[tuple]:
        for at in range(0, len(self.symbols), STEP):
            rows = slice(at, at + STEP)
            word = self.word[rows]
            yield self.symbols[rows], [c[rows] for c in self.contexts], counted[word], learnt[word]


# ------------------------------------------------------------------ tables


_CODEC = pa.Codec("zstd", compression_level=1)


def squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def restored(data: bytes) -> bytes:
    return _CODEC.decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """tokens_of each text, in line, by Arrow's kernels; how many words and bytes of words each text has. No nulls."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    parts, edges = split.values, split.offsets.to_numpy()
    size = pc.binary_length(parts).to_numpy().astype(np.int64)
    there = size > 0
    words, chars = (np.diff(np.concatenate([[0], np.cumsum(x)])[edges]) for x in (there, size))
    inner = slice(int(edges[0]), int(edges[-1]))
    return parts[inner].filter(pa.array(there[inner])).cast(pa.binary()), words, chars


def _blocks(docs: DataFrame) -> DataFrame:
    """One row per block: its distinct words, their counts in training documents, and its documents as token numbers.

    A block takes documents of one task until it holds BLOCK_CHARS.
    """
    document = pa.struct(
        [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64()), ("tokens", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 24
        held: list[tuple] = []
        chars = 0

        def block() -> pa.RecordBatch:
            coded = pa.chunked_array([h[1] for h in held]).dictionary_encode()  # by first appearance
            words = coded.chunk(0).dictionary if coded.num_chunks else pa.array([], pa.binary())
            ids = np.concatenate([np.zeros(0, np.uint32), *(c.indices.to_numpy() for c in coded.chunks)]).astype(np.uint32)
            docs_ = [d for h in held for d in h[0].to_pylist()]
            n_words, n_bytes = (np.concatenate([h[k] for h in held]) for k in (2, 3))
            held_out = np.array([d is None or zlib.crc32(str(d).encode()) % FOLDS == HELD_OUT for d in docs_])
            counts = np.bincount(ids[np.repeat(~held_out, n_words)], minlength=len(words)).astype(np.int64)
            ends = np.cumsum(n_words)
            tokens = [squeezed(ids[i:j].view(np.uint8).reshape(-1, 4).T.tobytes()) for i, j in zip(ends - n_words, ends, strict=True)]
            columns = [docs_, held_out, n_words + 1, n_bytes + n_words, tokens]
            rows = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, document, strict=True)], fields=list(document))
            whole = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in (words, pa.array(counts), rows)]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *whole], names=["block", "words", "counts", "docs"])

        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            size = pc.utf8_length(texts).to_numpy().astype(np.int64)
            low = 0
            while low < batch.num_rows:
                full = chars + np.cumsum(size[low:])
                n = min(int(np.searchsorted(full, BLOCK_CHARS)) + 1, len(full))
                held.append((batch.column(0).slice(low, n), *words_of(texts.slice(low, n))))
                low, chars = low + n, int(full[n - 1])
                if chars >= BLOCK_CHARS:
                    yield block()
                    number += 1
                    held, chars = [], 0
        if held:
            yield block()

    return map_batches(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")),
        run,
        "block long, words array<binary>, counts array<long>, "
        "docs array<struct<doc_id: long, held_out: boolean, n_tokens: long, n_bytes: long, tokens: binary>>",
    )


def _pieces(counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A task's tables of counts, in parts that are not all zero."""
    for k, table in enumerate(counts):
        for part in range(0, len(table), PIECE):
            piece = table[part : part + PIECE]
            if piece.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([part], pa.int32()), pa.array([squeezed(piece.tobytes())])],
                    names=["context", "part", "cells"],
                )


_PIECES = "context int, part int, cells binary"


def _summed(pieces: DataFrame, tables: mixing.Tables) -> list[np.ndarray]:
    """Whole-number sums over all tasks; a fixed number of cells, whatever the input."""

    def add(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(restored(x), np.int64) for x in table["cells"])
        return pd.DataFrame({"context": [key[0]], "part": [key[1]], "cells": [squeezed(total.tobytes())]})

    counts = tables.empty()
    for k, part, cells in pieces.groupBy("context", "part").applyInPandas(add, _PIECES).toLocalIterator():
        piece = np.frombuffer(restored(cells), np.int64)
        counts[k][part : part + len(piece)] = piece
    return [c.astype(np.float32) for c in counts]


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch.column(0).to_pylist(), batch.column(1).to_numpy()


def _byte_code(words: DataFrame) -> mixing.Code:
    """From how often each byte spells a distinct training word; 256 sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for tokens, _ in _words_of(batches):
            total += np.bincount(np.frombuffer(b" ".join([*tokens, b""]), np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256), pa.int32()), pa.array(total)], names=["byte", "n"])

    masses = np.zeros(256, np.int64)
    for byte, n in map_batches(words, run, "byte int, n long").groupBy("byte").agg(F.sum("n")).collect():
        masses[byte] = n
    return mixing.Code(masses)


def _spelling_model(words: DataFrame, distinct: int) -> mixing.Predictor:
    """From counts over all distinct training words, with the mean of the shards' mixers by weight of evidence."""
    shards = max(1, -(-distinct // SHARD_WORDS))
    training = words.where("count > 0").select("word", "count")
    dealt = materialize(training.repartition(shards, "word").sortWithinPartitions("word"), "training")
    code = _byte_code(dealt)
    tables = mixing.Tables(code, BYTE_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, n = tables.empty(), [], 0

        def note() -> None:
            spelling = Spelling(held)
            tables.note_all(counts, spelling.symbols, spelling.contexts)

        for tokens, _ in _words_of(batches):
            held, n = held + tokens, n + sum(map(len, tokens))
            if n >= COUNTED:
                note()
                held, n = [], 0
        if held:
            note()
        yield from _pieces(counts)

    whole_model = mixing.Predictor(tables, _summed(map_batches(dealt, count, _PIECES), tables), BYTE_GATES)
    # evidence of 2**BYTE_BITS cells, 16 MB whatever the input
    shared = words.sparkSession.sparkContext.broadcast(whole_model)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen, held = shared.value.anew(), 0, []

        def steps() -> None:
            every = np.ones(len(held), bool)
            for _ in model.run(Spelling(held).steps(every, every)):
                pass

        for tokens, _ in _words_of(batches):  # in equal lots, whatever the batches
            seen += len(tokens)
            held += tokens
            while len(held) >= STEP:
                held, rest = held[:STEP], held[STEP:]
                steps()
                held = rest
        if held:
            steps()
        if seen:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([seen], pa.int64()),
                    pa.array([model.mixer.weights.ravel().astype(np.float64)], pa.list_(pa.float64())),
                    pa.array([model.mixer.refine.ravel()], pa.list_(pa.float64())),
                ],
                names=["seen", "weights", "refine"],
            )

    # a shard for each task, read as it was dealt
    whole = dealt.repartition(shards, "word").sortWithinPartitions("word")
    rows = materialize(map_batches(whole, learn, "seen long, weights array<double>, refine array<double>"), "mixers")
    means = (
        rows.select("seen", F.posexplode("weights").alias("at", "w"))
        .groupBy("at")
        .agg((F.sum(F.col("w") * F.col("seen")) / F.sum("seen")).alias("value"))
        .select(F.lit("w").alias("kind"), "at", "value")
    )
    sums = rows.select(F.posexplode("refine").alias("at", "r")).groupBy("at").agg(F.sum("r").alias("value"))
    model = whole_model.anew()
    mixer = model.mixer
    weights, refine = mixer.weights.ravel(), mixer.refine.ravel()
    for kind, at, value in means.unionByName(sums.select(F.lit("r").alias("kind"), "at", "value")).collect():
        (weights if kind == "w" else refine)[at] = np.float32(value)
    discard(dealt, rows)
    return model


def _placed(words: DataFrame, distinct: int, top: dict[bytes, int]) -> DataFrame:
    """(word, count, place, spelt): where a word belongs, and log10 of its spelling for documents that do not know it."""
    # bounded as above, and TOP words
    shared = words.sparkSession.sparkContext.broadcast((_spelling_model(words, distinct), top))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, top_ = shared.value
        for tokens, n in _words_of(batches):
            spelling = Spelling(tokens)
            cost = np.concatenate([*model.run(spelling.steps(n > 0, np.zeros(len(tokens), bool)))])
            spelt = np.bincount(spelling.word, cost, len(tokens))
            place = [-1 - top_[w] if w in top_ else form_of(w) for w in tokens]
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens, pa.binary()), pa.array(n), pa.array(place, pa.int32()), pa.array(spelt.astype(np.float32))],
                names=["word", "count", "place", "spelt"],
            )

    return materialize(map_batches(words.select("word", "count"), run, "word binary, count long, place int, spelt float"), "placed")


def _masses(placed: DataFrame) -> np.ndarray:
    """Training occurrences of the words of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, np.int64)
        for batch in batches:
            n, place = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            np.add.at(total, class_of(place, n), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES), pa.int32()), pa.array(total)], names=["class", "n"])

    masses = np.zeros(CLASSES, np.int64)
    for at, n in map_batches(placed.select("count", "place"), run, "class int, n long").groupBy("class").agg(F.sum("n")).collect():
        masses[at] = n
    return masses


def _frequencies(coded: DataFrame) -> np.ndarray:
    """How often training documents have each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                total += np.bincount(_classes(data), minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES), pa.int32()), pa.array(total)], names=["class", "n"])

    out = np.zeros(CLASSES, np.int64)
    training = coded.where(~F.col("held_out")).select("classes")
    for at, n in map_batches(training, run, "class int, n long").groupBy("class").agg(F.sum("n")).collect():
        out[at] = n
    return out


def _packed(back: DataFrame) -> DataFrame:
    """(block, words): what a task has of a block's words (number, place, count, spelt), packed by columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n = 0

        def rows() -> Iterator[pa.RecordBatch]:
            block, number, place, count, spelt = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((number, block))
            block = block[order]
            columns = [number[order].astype("<u4"), place[order].astype("<i2"), count[order].astype("<i8"), spelt[order].astype("<f4")]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                steps = np.diff(columns[0][low:high], prepend=np.uint32(0))
                parts = [steps, *(c[low:high] for c in columns[1:])]
                planes = b"".join(p.view(np.uint8).reshape(len(p), -1).T.tobytes() for p in parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block[low]], pa.int64()), pa.array([int(high - low)], pa.int64()), pa.array([squeezed(planes)])],
                    names=["at", "n", "words"],
                )

        for batch in batches:
            if batch.num_rows:
                held.append([batch.column(k).to_numpy() for k in range(5)])
                n += batch.num_rows
            if n >= PACKED:
                yield from rows()
                held, n = [], 0
        if held:
            yield from rows()

    return map_batches(back, run, "at long, n long, words binary")


def _unpacked(n: int, data: bytes) -> list[np.ndarray]:
    raw, out, at = np.frombuffer(restored(data), np.uint8), [], 0
    for kind in ("<u4", "<i2", "<i8", "<f4"):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).ravel())
        at += n * size
    out[0] = np.cumsum(out[0], dtype=np.uint32)
    return out


_CODED = "doc_id long, held_out boolean, n_tokens long, n_bytes long, n_known long, base_score double, inside double, classes binary"


def coded_words(ids: np.ndarray, lengths: np.ndarray, training: np.ndarray, place: np.ndarray, count: np.ndarray, spelt: np.ndarray, masses: np.ndarray):
    """Class of each word of some documents in line, and what each word costs beyond its class."""
    starts = np.cumsum(lengths) - lengths
    document = np.repeat(np.arange(len(lengths)), lengths)
    key = (document << 32) | ids
    order = np.argsort(key, kind="stable")
    new = np.ones(len(ids), bool)
    new[1:] = np.diff(key[order]) != 0
    first = order[new]  # of each word of each document
    own = np.diff(np.append(np.flatnonzero(new), len(ids)))
    word = ids[first]
    where, seen = place[word], count[word] - own * training[document[first]]
    inverse = np.empty(len(ids), np.int64)
    inverse[order] = np.cumsum(new) - 1
    classes = class_of(where, seen)[inverse]
    inside = np.where(seen > 0, share_of(where, seen, masses), spelt[word])[inverse]
    other, again = (where >= 0)[inverse], np.ones(len(ids), bool)
    again[first] = False
    again &= other
    had = np.concatenate([[0], np.cumsum(other & ~again)])
    had = had[1:] - had[starts[document]]
    classes[again] = AGAIN
    inside[again] = -np.log10(had[again])
    return classes, inside


def _runs(lengths: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of neighbours that are `most` long together, or one alone."""
    low, held = 0, 0
    for at, n in enumerate(lengths.tolist()):
        if held + n > most and at > low:
            yield slice(low, at)
            low, held = at, 0
        held += n
    if low < len(lengths):
        yield slice(low, len(lengths))


def _coded(blocks: DataFrame, packed: DataFrame, masses: np.ndarray, ends: int, train_tokens: int, known_words: int) -> DataFrame:
    """Documents as classes, with the sums that need no context."""
    total = train_tokens + known_words + 1
    last = (np.log10((ends + 1) / total), int(ends > 0))

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        parts = [_unpacked(n, data) for n, data in zip(words["n"].to_pylist(), words["words"].to_pylist(), strict=True)]
        size = sum(len(p[0]) for p in parts)
        place, count, spelt = np.zeros(size, np.int16), np.zeros(size, np.int64), np.zeros(size, np.float32)
        for number, *values in parts:
            for whole, value in zip((place, count, spelt), values, strict=True):
                whole[number] = value
        base, known = np.log10((count + 1) / total), count > 0
        sums: list[list] = [[], [], [], []]
        held_out = docs["held_out"].to_numpy(zero_copy_only=False)
        data, lengths = docs["tokens"].to_pylist(), docs["n_tokens"].to_numpy() - 1
        for lot in _runs(lengths, LOT):
            planes = [np.frombuffer(restored(d), np.uint8).reshape(4, -1) for d in data[lot]]
            ids = np.ascontiguousarray(np.concatenate(planes, axis=1).T).view("<u4").ravel().astype(np.int64)
            size = lengths[lot]
            classes, inside = coded_words(ids, size, ~held_out[lot], place, count, spelt, masses)
            edges = np.append(np.cumsum(size) - size, len(ids))
            for values, per_word in zip(sums, (known[ids], base[ids], inside), strict=False):
                total_ = np.zeros(len(size))
                if (some := size > 0).any():
                    total_[some] = np.add.reduceat(per_word, edges[:-1][some], dtype=np.float64)
                values.append(total_)
            classes = classes.astype("<u2")
            end = np.array([END], "<u2").tobytes()
            # these bytes deal documents to segments: another codec would deal them otherwise
            sums[3] += [zlib.compress(classes[i:j].tobytes() + end, 1) for i, j in zip(edges[:-1], edges[1:], strict=True)]
        n_known, base_score, inside = (np.concatenate(x) for x in sums[:3])
        sums = [n_known.astype(np.int64) + last[1], base_score + last[0], inside, sums[3]]
        kinds = (pa.int64(), pa.float64(), pa.float64(), pa.binary())
        found = dict(zip(("n_known", "base_score", "inside", "classes"), map(pa.array, sums, kinds), strict=True))
        return pa.table({**{c: docs[c] for c in ("doc_id", "held_out", "n_tokens", "n_bytes")}, **found})

    documents_ = blocks.select("block", F.explode("docs").alias("d")).select("block", "d.*")
    return documents_.groupBy("block").cogroup(packed.groupBy("at")).applyInArrow(run, _CODED)


def _classes(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), "<u2").astype(np.int64)


def _class_counts(coded: DataFrame, tables: mixing.Tables) -> list[np.ndarray]:
    """Of all tokens of training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = tables.empty()
        for symbols, _, contexts in _lots(((d,) for batch in batches for d in batch.column(0).to_pylist()), COUNTED):
            tables.note_all(counts, symbols, contexts)
        yield from _pieces(counts)

    training = coded.where(~F.col("held_out")).select("classes")
    return _summed(map_batches(training, run, _PIECES), tables)


def _lots(rows: Iterator[tuple], least: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Documents in line, so many tokens or more: classes, where each document starts, contexts."""
    held, n = [], 0

    def lot():
        lengths = np.array([len(h) for h in held])
        starts, symbols = np.cumsum(lengths) - lengths, np.concatenate(held)
        return symbols, starts, class_contexts(symbols, starts)

    for (data,) in rows:
        held.append(_classes(data))
        n += len(held[-1])
        if n >= least:
            yield lot()
            held, n = [], 0
    if held:
        yield lot()


def score(docs: DataFrame) -> DataFrame:
    """One row per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    n_bytes: words and a blank after each; bits_per_byte: null without a word.
    """
    blocks = materialize(_blocks(docs), "blocks")
    spelt = blocks.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("number", "x")).select(
        "block", "number", F.col("x.words").alias("word"), F.col("x.counts").alias("count")
    )
    words = materialize(spelt.groupBy("word").agg(F.sum("count").alias("count")), "words")
    facts = words.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.when(F.col("count") > 0, 1)), F.count(F.lit(1))).first()
    training = F.size(F.filter("docs", lambda d: ~d["held_out"]))
    tokens = F.aggregate("docs", F.lit(0).cast("long"), lambda n, d: n + d["n_tokens"])
    ends, all_tokens = blocks.agg(F.coalesce(F.sum(training), F.lit(0)), F.coalesce(F.sum(tokens), F.lit(0))).first()
    train_tokens, known_words, distinct = facts[0] + ends, facts[1] + (ends > 0), facts[2]
    short = words.where((F.col("count") > 0) & (F.octet_length("word") <= TOP_BYTES))
    top = {bytes(r[0]): i for i, r in enumerate(short.orderBy(F.desc("count"), "word").limit(TOP).select("word").collect())}
    placed = _placed(words, distinct, top)
    discard(words)
    masses = _masses(placed)
    back = spelt.select("block", "number", "word").join(placed, "word").select("block", "number", "place", "count", "spelt")
    coded = materialize(_coded(blocks, _packed(back), masses, ends, train_tokens, known_words), "coded")
    discard(blocks, placed)
    tables = mixing.Tables(mixing.Code(_frequencies(coded)), CLASS_BITS)
    # evidence of 2**CLASS_BITS cells, 14 MB whatever the input
    shared = docs.sparkSession.sparkContext.broadcast(mixing.Predictor(tables, _class_counts(coded, tables), CLASS_GATES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value.anew()
        held: list[pa.RecordBatch] = []
        n = 0

        def rated() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            rows = [_classes(d) for d in table["classes"].to_pylist()]
            lengths = np.array([len(r) for r in rows])
            starts, symbols = np.cumsum(lengths) - lengths, np.concatenate(rows)
            contexts = class_contexts(symbols, starts)
            learnt = np.repeat(~table["held_out"].to_numpy(zero_copy_only=False), lengths)
            steps = [slice(at, at + STEP) for at in range(0, len(symbols), STEP)]
            cost = np.concatenate([*model.run((symbols[s], [c[s] for c in contexts], learnt[s], learnt[s]) for s in steps)])
            total = np.add.reduceat(cost, starts) + table["inside"].to_numpy()
            size = table["n_bytes"].to_numpy()
            bits = np.where(size > 0, -total / np.log10(2) / np.maximum(size, 1), np.nan)
            columns = [table[c].combine_chunks() for c in ("doc_id", "held_out", "n_tokens", "n_known")]
            columns += [pa.array([train_tokens] * len(rows), pa.int64()), table["base_score"].combine_chunks(), pa.array(total)]
            columns += [table["n_bytes"].combine_chunks(), pa.array(bits, pa.float64(), from_pandas=True)]
            names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"]
            yield from pa.table(columns, names=names).to_batches()

        for batch in batches:  # in lots that the documents alone decide
            ends_ = np.cumsum(batch.column(2).to_numpy())
            low = 0
            while low < batch.num_rows:
                high = int(np.searchsorted(ends_, STEP - n + (ends_[low - 1] if low else 0))) + 1
                held.append(batch.slice(low, min(high, batch.num_rows) - low))
                n += int(ends_[min(high, batch.num_rows) - 1] - (ends_[low - 1] if low else 0))
                low = high
                if n >= STEP:
                    yield from rated()
                    held, n = [], 0
        if held:
            yield from rated()

    segments = max(1, -(-all_tokens // SEGMENT_TOKENS))
    dealt = coded.repartition(segments, F.xxhash64("doc_id", "classes")).sortWithinPartitions("doc_id", "classes")
    return map_batches(
        dealt,
        run,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
        "n_bytes long, bits_per_byte double",
    )


def op5_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
