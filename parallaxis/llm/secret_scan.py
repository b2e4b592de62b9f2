"""Secret scans with one combined deterministic automaton.

All rules are compiled together (subset construction, minimisation) into one
transition array, which reads each text's UTF-8 bytes once. Where a state accepts, a
rule has a match that ends there; the rule's own small mirrored automaton then walks
back to the leftmost start and its anchored one forward to the longest end, so spans
are leftmost, longest and without overlap inside a rule. Runs stand in the automaton
without counters, except for hex; how long a match has to be is checked where one is
found. A base match that is too short is dropped with all it covers; for the other rules
the search goes on behind its first byte. One rule of three runs (jwt) has only its lead
in the combined automaton, whose states it would multiply by six.

Null text counts as empty and yields no span; an empty table gives no rows. Repeated
rows each get their own result, and any length of text is scanned whole; state is one
integer per text. Spans that start together are listed in the order of the rules.
Columns other than doc_id and text play no part, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import automaton
from ._common import documents, map_batches


@dataclass(frozen=True)
class Rule:
    """A pattern; matches stay if they, and their part behind the separator, are long enough."""

    kind: str
    pattern: str
    ignore_case: bool = False
    base: bool = False
    value_pattern: str | None = None
    value_least: int = 0
    least: int = 0
    lead: str | None = None  # the first part of the pattern, which alone stands in the combined automaton


_ASSIGN_HEAD = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""

#: Base rules first, in the order in which ties of start are listed.
RULES = (
    Rule("assign", _ASSIGN_HEAD + "[A-Za-z0-9+/_.=-]+", True, True, "[A-Za-z0-9+/_.=-]+", 6),
    Rule("access", "AKIA[A-Z0-9]+", base=True, least=20),
    Rule("hex", "[0-9a-f]{24,}", base=True),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("stripe", "[rs]k_live_[A-Za-z0-9]+", least=24),
    Rule("google", "AIza[A-Za-z0-9_-]+", least=39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", lead="eyJ"),
    Rule("private_key", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9._+/=-]+", True, value_pattern="[A-Za-z0-9._+/=-]+", value_least=20),
)


class Scanner:
    def __init__(self, rules=RULES):
        self.rules = rules
        trees = [automaton.parse(r.pattern, r.ignore_case) for r in rules]
        leads = [automaton.parse(r.lead, r.ignore_case) if r.lead else t for r, t in zip(rules, trees, strict=True)]
        self.all = automaton.compile_rules(leads, unanchored=True)
        self.forward = [automaton.compile_rules([t], unanchored=False) for t in trees]
        self.backward = [automaton.compile_rules([automaton.mirrored(t)], unanchored=False) for t in leads]
        heads = [r.pattern.removesuffix(r.value_pattern) if r.value_pattern else None for r in rules]
        self.heads = [
            automaton.compile_rules([automaton.parse(h, r.ignore_case)], unanchored=False) if h else None
            for h, r in zip(heads, rules, strict=True)
        ]

    @staticmethod
    def _longest(dfa, data: bytes, at: int, step: int, stop: int) -> int:
        """Bytes of the longest match from a position in one direction, or -1."""
        state, best, n, width = 0, -1, 0, dfa.width
        dead = _dead_state(dfa)
        while at != stop:
            state = dfa.table[state + dfa.classes[data[at]]]
            if state == dead:
                break
            at += step
            n += 1
            if state // width >= dfa.first_accept:
                best = n
        return best

    def byte_spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) over bytes, by start, then rule."""
        dfa = self.all
        table, edge, state = dfa.table, dfa.first_accept * dfa.width, 0
        hits = []
        for at, c in enumerate(data.translate(dfa.classes)):
            state = table[state + c]
            if state >= edge:
                hits.append((at, state))
        if not hits:
            return []
        ends, found = [0] * len(self.rules), []
        for at, state in hits:
            mask = dfa.accepts[state // dfa.width]
            while mask:
                rule = (mask & -mask).bit_length() - 1
                mask &= mask - 1
                if at < ends[rule]:
                    continue
                back = self._longest(self.backward[rule], data, at, -1, ends[rule] - 1)
                if back < 0:
                    continue
                start = at + 1 - back
                length = self._longest(self.forward[rule], data, start, 1, len(data))
                if length < 0:
                    continue
                end = start + length
                if length >= self.rules[rule].least and self._value_length(rule, data, start, end) >= self.rules[rule].value_least:
                    found.append((start, end, rule))
                elif not self.rules[rule].base:
                    end = start + 1
                ends[rule] = end
        return sorted(found, key=lambda x: (x[0], x[2]))

    def _value_length(self, rule: int, data: bytes, start: int, end: int) -> int:
        if self.heads[rule] is None:
            return end - start
        return end - start - self._longest(self.heads[rule], data, start, 1, end)

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, kind) over code points, end exclusive, by start, then the rules' order."""
        if not text:
            return []
        data = text.encode("utf-8", "surrogatepass")
        found = self.byte_spans(data)
        if len(data) == len(text):
            return [(s, e, self.rules[r].kind) for s, e, r in found]
        out, byte, point = [], 0, 0
        for s, e, r in found:
            point += len(data[byte:s].decode("utf-8", "surrogatepass"))
            byte = s
            out.append((point, point + e - s, self.rules[r].kind))  # a match is ASCII
        return out


@functools.lru_cache(maxsize=4)
def scanner_for(rules=RULES) -> Scanner:
    """Compiled once in a process; a few seconds."""
    return Scanner(rules)


def _dead_state(dfa) -> int:
    """The state that only leads to itself and does not accept, times width; -1 if there is none."""
    if not hasattr(dfa, "dead"):
        dfa.dead = next(
            (
                s * dfa.width
                for s in range(dfa.first_accept)
                if s and all(dfa.table[s * dfa.width + c] == s * dfa.width for c in range(dfa.width))
            ),
            -1,
        )
    return dfa.dead


def scan(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """All columns of docs that are named doc_id or text, plus spans array<struct<start,end,kind>>. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(scanner_for(rules))  # a few hundred KB, fixed by the rules

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in batches:
            rows = [
                [{"start": s, "end": e, "kind": k} for s, e, k in scanner.spans(t)]
                for t in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=["doc_id", "text", "spans"])

    return map_batches(
        docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string").alias("text")),
        run,
        "doc_id long, text string, spans array<struct<start: long, end: long, kind: string>>",
    )


def digest(docs: DataFrame, rules=RULES) -> DataFrame:
    """The contract's columns: counts by base kind, the hash of the base spans and the list of all spans.

    Made in the scanning task itself, so neither texts nor span structures leave Python.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scanner_for(rules))
    base = [r.kind for r in rules if r.base]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        for batch in batches:
            counts: dict = {k: [] for k in base}
            hashes, lists = [], []
            for text in batch.column(1).to_pylist():
                spans = scanner.spans(text)
                for k in base:
                    counts[k].append(sum(x[2] == k for x in spans))
                own = ",".join(f"{k}:{s}:{e}" for s, e, k in spans if k in counts)
                hashes.append(hashlib.sha256(own.encode()).hexdigest())
                lists.append(",".join(f"{k}:{s}:{e}" for s, e, k in spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in base), pa.array(hashes), pa.array(lists)],
                names=["doc_id", *(f"n_{k}" for k in base), "base_sha256", "spans"],
            )

    return map_batches(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")),
        run,
        "doc_id long, " + "".join(f"n_{k} long, " for k in base) + "base_sha256 string, spans string",
    )


def redact(docs: DataFrame, rules=RULES, mark: str = "[SECRET]") -> DataFrame:
    """docs with each span (overlapping ones merged) replaced by a mark; other columns and rows stay. No shuffle.

    n_chars, where present, is brought up to date. Null text stays null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scanner_for(rules))

    names = docs.columns
    at = names.index("text")
    length = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            changed = {i: _cut(t, spans, mark) for i, t in enumerate(texts) if (spans := scanner.spans(t))}
            if changed:
                columns = list(batch.columns)
                columns[at] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], batch.schema.field(at).type)
                if length is not None:
                    old = columns[length].to_pylist()
                    new = [len(changed[i]) if i in changed else x for i, x in enumerate(old)]
                    columns[length] = pa.array(new, batch.schema.field(length).type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return map_batches(docs, run, docs.schema)


def _cut(text: str, spans, mark: str) -> str:
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir))
