"""N-gram Jaccard join of documents: a size-aware heavy-light set similarity join.

A document's set holds its distinct word shingles (64-bit hashes). Documents with equal
sets form a class first (128-bit digest); only classes are compared.

Small sets enumerate subsets: every set drops up to as many elements as a link may lose,
and sets that share a subset large enough are linked outright; a star per subset is
enough. Large sets go through inverted lists. The boundary between the two is the size
at which enumerating makes more rows than scanning lists, whose lengths are measured.

Lists hold a part of a set that any linked set must meet: of the EXTENDED smallest
hashes, as many of the rarest (by exact frequency) as the threshold asks for. Pairs that
meet in a short list pass the size filter and a parity sketch (the sketches of two sets
differ in at most as many bits as the sets differ in elements); what passes, with the
members of long lists, forms candidate groups. A group's sets are brought together once,
in blocks of bounded size, scanned against each other and checked exactly; only merging
edges leave a block, never all pairs. Components of those edges give the result.

Nothing is capped or sampled, and a filter only drops pairs that provably do not link.

Null text, or text without words, has an empty set: linked with nothing, its own
component. A text of fewer words than a shingle has one element, the whole sequence. An
empty table gives no rows. Any length of text is read whole. Columns other than doc_id and
text play no part, whatever their names.
Rows that repeat an id or a text share its class. Rows with a null id take the component
of their class, null if the class has no id, and link nothing else.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import discard, documents, fresh, map_batches, materialize
from .graph import components

#: Sets up to this size are kept whole in the first table, so that they can enumerate subsets.
WHOLE = 32
#: A list longer than this is long. It decides how pairs are examined, never whether.
LONG_LIST = 64
#: Bits of the parity sketch, and words of 64 bits.
SKETCH_WORDS = 16
#: Sets and elements of one part of a group on average at most (sets are dealt by hash); a block brings two parts together.
BLOCK_SETS, BLOCK_ELEMENTS = 2048, 2_000_000
#: Groups above LEAST_PART sets are dealt into this many parts or more, so that a large one fills several tasks.
PARTS, LEAST_PART = 8, 256
#: Class ids up to which they are sent to all tasks that read texts again (8 bytes each, 16 MB); else a join.
BROADCAST_IDS = 2_000_000
CACHE_WORDS = 250_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Threshold:
    """Sets link when den * intersection >= num * union."""

    num: int
    den: int

    def links(self, common: int, a: int, b: int) -> bool:
        return self.den * common >= self.num * (a + b - common)

    def prefix(self, size: int) -> int:
        """Any linked set meets these many elements of a set, whichever they are ordered by."""
        return size - -(-size * self.num // self.den) + 1

    def dropped(self, size: int) -> int:
        """Elements that a set may have beyond its intersection with a linked one."""
        return size * (self.den - self.num) // self.den

    def overlap(self, a, b):
        """Least intersection of linked sets of two sizes."""
        return -(-(a + b) * self.num // (self.num + self.den))


class Shingler:
    """Texts to sorted arrays of distinct shingle hashes."""

    def __init__(self, words: int):
        self.words = words
        self.hashes: dict[bytes, int] = {}

    def elements(self, text: str | None) -> np.ndarray:
        tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not tokens:
            return np.empty(0, np.uint64)
        known = self.hashes
        if len(known) > CACHE_WORDS:
            known.clear()
        try:
            ids = [known[t] for t in tokens]
        except KeyError:
            for t in set(tokens):
                if t not in known:
                    known[t] = xxhash.xxh3_64_intdigest(t)
            ids = [known[t] for t in tokens]
        row = np.array(ids, np.uint64)
        width = min(self.words, len(row))
        n = len(row) - width + 1
        mixed = row[:n] + np.uint64(width)
        for k in range(1, width):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX + row[k : k + n]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX
        return np.unique(mixed ^ (mixed >> np.uint64(29)))


def sketch(elements: np.ndarray) -> np.ndarray:
    """Parity of the number of elements in each of 64 * SKETCH_WORDS cells."""
    cells = (elements >> np.uint64(13)) % np.uint64(64 * SKETCH_WORDS)
    odd = np.bincount(cells.astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def _listed(threshold: Threshold, extended: float, size: int) -> int:
    return min(size, max(threshold.prefix(size), math.ceil(extended * threshold.prefix(size))))


def _sets(docs: DataFrame, words: int, threshold: Threshold, extended: float) -> DataFrame:
    """doc_id, n, digest, first (smallest hashes; all of a small set), sketch; one row per row. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            sizes, digests, firsts, sketches = [], [], [], []
            for text in batch.column(1).to_pylist():
                e = shingler.elements(text)
                sizes.append(len(e))
                digests.append(xxhash.xxh3_128_digest(e.tobytes()))
                firsts.append(e[: max(WHOLE, _listed(threshold, extended, len(e)))].view(np.int64))
                sketches.append(sketch(e).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(firsts, pa.list_(pa.int64())),
                    pa.array(sketches, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n", "digest", "first", "sketch"],
            )

    return map_batches(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")),
        run,
        "doc_id long, n long, digest binary, first array<long>, sketch array<long>",
    )


def boundary(threshold: Threshold, sizes: dict[int, int], scanned: dict[int, float]) -> int:
    """The largest size of small sets: total rows of subsets below, and scanned in lists above, are least.

    sizes: how many sets have a size; scanned: rows that the lists of the sets of a size bring together.
    """

    def subsets(n: int) -> int:
        return sum(math.comb(n, a) for a in range(threshold.dropped(n) + 1)) if _may_link(threshold, n) else 0

    cost = {0: sum(scanned.values())}
    for n in range(1, WHOLE + 1):
        cost[n] = cost[n - 1] + sizes.get(n, 0) * subsets(n) - scanned.get(n, 0)
    return min(cost, key=lambda n: (cost[n], -n))


def _may_link(threshold: Threshold, n: int) -> bool:
    """Whether a set of this size can link with a different one at all."""
    return threshold.links(n, n, n + 1) or threshold.dropped(n) > 0


def _subset_edges(nodes: DataFrame, threshold: Threshold, largest: int) -> DataFrame:
    """Edges between small sets: a star for each shared subset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import combinations

        kind = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for node, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                e = np.array(first, np.int64).view(np.uint64)
                one, two = (e * _MIX) ^ (e >> np.uint64(31)), (e ^ (e >> np.uint64(27))) * np.uint64(0xC2B2AE3D27D4EB4F)
                for a in range(threshold.dropped(len(e)) + 1):
                    picks = np.array([*combinations(range(len(e)), a)], np.int64)  # one empty pick for a = 0
                    k1 = one.sum() - one[picks].sum(axis=1, dtype=np.uint64)
                    k2 = two.sum() - two[picks].sum(axis=1, dtype=np.uint64)
                    m = len(k1)
                    for column, values in zip(
                        rows, (k1.view(np.int64), k2.view(np.int64), [len(e) - a] * m, [a] * m, [node] * m), strict=True
                    ):
                        column.extend(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(rows, kind, strict=True)], names=["k1", "k2", "left", "a", "node"]
            )

    small = nodes.where((F.col("n") > 0) & (F.col("n") <= largest))
    rows = map_batches(small.select("node", "first"), run, "k1 long, k2 long, left int, a int, node long")
    most = threshold.dropped(largest)
    key = ["k1", "k2", "left"]
    stars = (
        rows.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("size"), *(F.min(F.when(F.col("a") == j, F.col("node"))).alias(f"c{j}") for j in range(most + 1)))
        .where("size > 1")
        .drop("size")
    )
    # a set that lost a elements and one that lost j share `left`: linked if that alone is enough
    enough = [
        F.when(threshold.den * F.col("left") >= threshold.num * (F.col("left") + F.col("a") + j), F.col(f"c{j}"))
        for j in range(most + 1)
    ]
    return (
        rows.join(stars, key)
        .select(F.col("node").alias("a"), F.explode(F.array(*enough)).alias("b"))
        .where("a <> b")
        .distinct()
    )


def _list_rows(nodes: DataFrame, threshold: Threshold, extended: float) -> DataFrame:
    """(token, node, n, df): the rarest tokens of each set's first ones, those in two or more sets."""
    size = _listed_column(threshold, extended)
    rows = nodes.select("node", "n", F.explode(F.slice("first", 1, size)).alias("token"))
    shared = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    met = rows.join(shared, "token")
    # a set keeps its prefix() rarest: tokens that no other set has come first, and need no row
    ranked = (
        met.groupBy("node", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("met"))
        .withColumn("keep", F.greatest(F.lit(0), F.size("met") - (size - _prefix_column(threshold))))
    )
    return ranked.select("node", "n", F.explode(F.expr("slice(met, 1, keep)")).alias("x")).select(
        F.col("x.token").alias("token"), "node", "n", F.col("x.df").alias("df")
    )


def _prefix_column(threshold: Threshold) -> Column:
    n = F.col("n").cast("int")
    return n - F.expr(f"(n * {threshold.num} + {threshold.den - 1}) div {threshold.den}").cast("int") + 1


def _listed_column(threshold: Threshold, extended: float) -> Column:
    p = _prefix_column(threshold)
    return F.least(F.col("n").cast("int"), F.greatest(p, F.ceil(F.lit(float(extended)) * p).cast("int")))


def _near(threshold: Threshold, left: str, right: str) -> Column:
    """Size filter and parity sketch, exact in what they drop."""
    n, m = F.col(f"{left}.n"), F.col(f"{right}.n")
    fits = threshold.den * F.least(n, m) >= threshold.num * F.greatest(n, m)
    bits = sum(
        (
            F.bit_count(F.get(F.col(f"{left}.sketch"), i).bitwiseXOR(F.get(F.col(f"{right}.sketch"), i)))
            for i in range(SKETCH_WORDS)
        ),
        F.lit(0),
    )
    total = threshold.num + threshold.den
    common = F.expr(f"(({left}.n + {right}.n) * {threshold.num} + {total - 1}) div {total}")
    return fits & (bits <= n + m - 2 * common)


def _candidate_groups(nodes: DataFrame, rows: DataFrame, threshold: Threshold) -> DataFrame:
    """(node, label): sets that may be linked, directly or in a chain, share a label."""
    short = rows.where(F.col("df") <= LONG_LIST).select("token", "node", "n")
    left, right = short.alias("l"), short.alias("r")
    fits = threshold.den * F.least("l.n", "r.n") >= threshold.num * F.greatest("l.n", "r.n")
    pairs = (
        left.join(right, (F.col("l.token") == F.col("r.token")) & (F.col("l.node") < F.col("r.node")) & fits)
        .select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))
        .distinct()
    )
    facts = nodes.select("node", "n", "sketch")
    near = (
        pairs.join(facts.alias("x"), F.col("a") == F.col("x.node"))
        .join(facts.alias("y"), F.col("b") == F.col("y.node"))
        .where(_near(threshold, "x", "y"))
        .select("a", "b")
    )
    long = rows.where(F.col("df") > LONG_LIST)
    heads = long.groupBy("token").agg(F.min("node").alias("b"))
    stars = long.join(heads, "token").select(F.col("node").alias("a"), "b")
    return components(near.unionByName(stars))


def _merge_block(threshold: Threshold):
    def run(table: pd.DataFrame) -> pd.DataFrame:
        """Edges that join up the linked sets of a block: of one part, or between its two parts."""
        table = table.sort_values("node", kind="stable").drop_duplicates("node").reset_index(drop=True)
        sets = [np.frombuffer(x, np.uint64) for x in table["elements"]]
        nodes, parts = table["node"].to_numpy(), table["part"].to_numpy()
        sizes = np.array([len(x) for x in sets], np.int64)
        marks = np.stack([sketch(x) for x in sets])
        between = bool(table["first_part"].iloc[0] != table["second_part"].iloc[0])
        root = np.arange(len(sets))
        edges = []
        for i in range(len(sets) - 1):
            there = np.arange(i + 1, len(sets))
            there = there[root[there] != root[i]]
            if between:
                there = there[parts[there] != parts[i]]
            low, high = np.minimum(sizes[there], sizes[i]), np.maximum(sizes[there], sizes[i])
            there = there[threshold.den * low >= threshold.num * high]
            bits = np.bitwise_count(marks[there] ^ marks[i]).sum(axis=1, dtype=np.int64)
            there = there[bits <= sizes[there] + sizes[i] - 2 * threshold.overlap(sizes[there], sizes[i])]
            for j in there.tolist():
                if root[i] == root[j]:
                    continue
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if threshold.links(common, len(sets[i]), len(sets[j])):
                    edges.append((nodes[i], nodes[j]))
                    root[root == root[j]] = root[i]
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    return run


def _list_edges(docs: DataFrame, nodes: DataFrame, groups: DataFrame, words: int, threshold: Threshold) -> DataFrame:
    """Verified edges inside candidate groups."""
    members = materialize(groups.join(nodes.select("node", "doc_id", "digest", "n"), "node"), "members")
    sizes = members.groupBy("label").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("elements"))
    size = F.least(F.lit(BLOCK_SETS), F.greatest(F.lit(min(LEAST_PART, BLOCK_SETS)), F.ceil(F.col("sets") / PARTS)))
    blocks = F.greatest(F.ceil(F.col("sets") / size), F.ceil(F.col("elements") / F.lit(BLOCK_ELEMENTS)), F.lit(1))
    placed = members.join(sizes.select("label", blocks.cast("int").alias("blocks")), "label").withColumn(
        "part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string")).where("id is not null")
    ids = members.select("doc_id").distinct()
    if members.count() <= BROADCAST_IDS:
        # as one array of numbers: rows of a joined table take the driver several times as many bytes
        numbers = ids.toArrow().column(0).to_numpy()
        sent = docs.sparkSession.sparkContext.broadcast(np.sort(numbers))
    else:
        sent, texts = None, texts.join(ids, F.col("id") == F.col("doc_id"), "left_semi")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            if sent is not None:
                wanted = sent.value
                at = np.searchsorted(wanted, batch.column(0).to_numpy())
                hit = np.zeros(batch.num_rows, bool)
                inside = at < len(wanted)
                hit[inside] = wanted[at[inside]] == batch.column(0).to_numpy()[inside]
                batch = batch.filter(pa.array(hit))
            out = [shingler.elements(text).tobytes() for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([xxhash.xxh3_128_digest(x) for x in out], pa.binary()), pa.array(out, pa.binary())],
                names=["doc_id", "digest", "elements"],
            )

    sets = map_batches(texts, shingle, "doc_id long, digest binary, elements binary")
    pairing = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.struct(F.least("part", other).alias("first_part"), F.greatest("part", other).alias("second_part")),
    )
    dealt = (
        placed.select("node", "doc_id", "digest", "label", "part", F.explode(pairing).alias("pair"))
        .select("node", "doc_id", "digest", "label", "part", "pair.first_part", "pair.second_part")
        .join(sets, ["doc_id", "digest"])  # of rows that repeat an id, the class's own
        .drop("doc_id", "digest")
    )
    return dealt.groupBy("label", "first_part", "second_part").applyInPandas(_merge_block(threshold), "a long, b long")


def link(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100, extended: float = 2.0) -> DataFrame:
    """One row per row: doc_id, n_shingles, component_id (smallest doc_id that links reach)."""
    threshold = Threshold(num, den)
    rows = materialize(_sets(docs, words, threshold, extended), "sets")
    classes = rows.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    nodes = materialize(
        rows.join(classes.withColumnRenamed("digest", "d"), (F.col("digest") == F.col("d")) & (F.col("doc_id") == F.col("rep")))
        .dropDuplicates(["digest", "doc_id"])
        .select(F.monotonically_increasing_id().alias("node"), "doc_id", "digest", "n", "first", "sketch"),
        "classes",
    )
    everything = materialize(_list_rows(nodes, threshold, extended), "lists")
    # a set meets half the others of a short list; a long list is scanned in blocks, which cost about as much. WHOLE + 1 rows each
    meets = F.sum(1 + F.least(F.col("df"), F.lit(LONG_LIST)) / 2)
    scanned = {r[0]: float(r[1]) for r in everything.where(F.col("n") <= WHOLE).groupBy("n").agg(meets).collect()}
    sizes = {r[0]: r[1] for r in nodes.where(F.col("n") <= WHOLE).groupBy("n").count().collect()}
    small = boundary(threshold, sizes, scanned)
    # smaller sets cannot link with a large one
    listed = everything.where(F.col("n") >= -(-threshold.num * (small + 1) // threshold.den))
    groups = materialize(_candidate_groups(nodes, listed, threshold), "groups")
    edges = _list_edges(docs, nodes, groups, words, threshold).unionByName(_subset_edges(nodes, threshold, small))
    joined = components(edges)
    named = joined.join(nodes.select("node", "doc_id", "digest"), "node")
    lowest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    moved = materialize(named.join(lowest, "label").select("digest", "component_id"), "components")
    discard(everything, groups)
    # classes of one row that links nothing need no name; written, so that a hot class can be split in the join
    shared = classes.where("copies > 1").select("digest", "rep").join(moved, "digest", "full")
    shared = materialize(shared.select("digest", F.coalesce("component_id", "rep").alias("component_id")), "shared")
    named_rows = rows.select("doc_id", "n", "digest").join(
        shared.withColumn("in_class", F.lit(True)), "digest", "left"
    )
    own = (F.col("n") == 0) | F.col("in_class").isNull()
    return named_rows.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(own, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def keep_first(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, extended: float = 1.25) -> DataFrame:
    """docs without the rows whose component has a smaller id; all columns stay, and so do null ids."""
    found = link(docs, words, num, den, extended)
    own = fresh(docs, "id")
    gone = materialize(found.where("component_id < doc_id").select(F.col("doc_id").alias(own)).distinct(), "dropped")
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(own), "left_anti")


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return link(documents(spark, sf_dir))
