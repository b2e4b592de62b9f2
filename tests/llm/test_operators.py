"""Text operators against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parallaxis.llm import (
    automaton,
    byte_bpe,
    exact_dedup,
    graph,
    jaccard_join,
    language_id,
    lm_scoring,
    mixing,
    packing,
    pii_surrogates,
    quality_rules,
    secret_scan,
    toxicity,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LINES = ["the cat sat on the mat", "a dog ran in the park", "", "numbers 1 2 3 ### $$$", "été à la plage", "x"]


def corpus(n=60, seed=3):
    """Documents with copies, near copies, repeated lines, blanks and a long one."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(80)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))
        if i % 5 == 1:
            text = rows[-1][1]
        if i % 5 == 2 and rows[-1][1]:
            text = rows[-1][1].replace(" ", "\n  ", 1) + "\t"
        if i % 7 == 3 and rows[-1][1]:
            w = rows[-1][1].split()
            w[len(w) // 2 : len(w) // 2 + 1] = ["changed"]
            text = " ".join(w)
        rows.append((i, text, "en" if i % 2 else "fr", f"s{i % 3}", len(text)))
    rows += [
        (100, None, None, None, None), (101, "", "en", "s0", 0), (102, " \n\t ", "en", "s0", 4), (103, "one", "en", "s1", 3),
        (104, "one two", "en", "s1", 7), (105, "long words " * 6000, "en", "s1", 66000), (106, "日本語 テキスト です", None, "s2", 11),
        (107, "\n".join(LINES * 3), "en", "s2", 10),
    ]
    rows += [rows[4], rows[4], (None, rows[5][1], "en", "s0", 1), (None, "alone without an id", "en", "s0", 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def clashing(docs):
    """Columns that operators use inside, already there."""
    return docs.withColumns({c: F.lit(1) for c in ("kept", "score", "spans", "id", "__id", "ID_", "sha", "row", "node", "digest", "word", "block", "lang_pred", "found", "ids")})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---------------------------------------------------------------- quality


def brute_quality(text):
    text = text or ""
    w = split(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if split(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(docs, clashing):
    assert quality_rules.judge(clashing).count() == docs.count()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = quality_rules.judge(docs).select("doc_id", *names, "base_failed", "kept").collect()
    want = Counter((r[0], *brute_quality(r[1])) for r in corpus())
    assert Counter(tuple(r)[:6] for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def test_bad_host_takes_its_documents_along(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, "too short", None, "bad", 0) for i in range(60)] + [(60, good, None, "bad", 0)]
    rows += [(100 + h * 100 + i, good + str(i), None, f"good{h}", 0) for h in range(9) for i in range(30)]
    rows += [(5000, "short", None, "tiny", 0), (5001, good, None, "tiny", 0), (5002, good, None, None, 0)]
    got = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[60]["host_rejected"] and not got[60]["kept"] and not got[60]["base_failed"]
    assert got[5001]["kept"], "two documents are no evidence against a host"
    assert got[5002]["kept"] and got[100]["kept"]
    assert quality_rules.judge(empty(spark)).count() == 0
    urls = [("https://User@Example.org:80/a?b", "example.org"), ("http://example.org", "example.org"), ("src1", "src1"), (None, None), ("a://", "a://")]
    df = spark.createDataFrame([u[:1] for u in urls], "source string").select(quality_rules.host_of(F.col("source")).alias("host"))
    assert [r["host"] for r in df.collect()] == [u[1] for u in urls]
    assert quality_rules.beta_prior(None, None) == (1.0, 1.0)


# ---------------------------------------------------------------- exact copies


def check_exact(got, rows):
    groups: dict = {}
    for doc, text, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(doc)
    want = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        for i in ids:
            want[(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)


def test_exact_dedup(docs, clashing, spark):
    check_exact(exact_dedup.deduplicate(docs).collect(), corpus())
    check_exact(exact_dedup.deduplicate(clashing).collect(), corpus())
    assert exact_dedup.deduplicate(empty(spark)).count() == 0


def test_exact_dedup_verifies_chunks_when_hashes_collide(docs):
    weak = lambda c: F.length(c) % 3
    check_exact(exact_dedup.deduplicate(docs, lambda c: weak(c).cast("bigint")).collect(), corpus())


@pytest.mark.parametrize("alphabet", ["abcde", "абвгдежзиклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "".join(map(chr, range(0x4E00, 0x9FA0))), "".join(map(chr, range(0xAC00, 0xD7A0)))])
def test_exact_dedup_cuts_where_content_says(spark, alphabet):
    blank = "" if alphabet[0] == "\u4e00" else " "
    text = blank.join("".join(random.Random(i).choices(alphabet, k=6)) for i in range(6000))
    rows = [(text,), (alphabet[1:7] + blank + text,), (text[:9000] + alphabet[2:9] + text[9000:],)]
    a, *others = [r[0] for r in spark.createDataFrame(rows, "text string").select(exact_dedup.chunks(F.col("text"))).collect()]
    assert "".join(a) == text and all(len(set(a) & set(b)) > 0.8 * len(a) for b in others)
    assert max(map(len, a)) <= exact_dedup.MOST_CHUNK


def test_exact_dedup_of_many_equal_rows(spark):
    """One row is repeated more often than all others together."""
    rows = [(7, "same row", "en", "s", 1)] * 3000 + [(i, f"text {i % 50}", "en", "s", 1) for i in range(500)]
    check_exact(exact_dedup.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect(), rows)


def test_keep_first_filters_rows(docs, clashing, spark):
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    for keep in (exact_dedup.keep_first, jaccard_join.keep_first):
        other = keep(clashing)
        assert other.columns == clashing.columns and other.count() == keep(docs).count()
    want = {re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in corpus()}
    got = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in kept.collect()]
    assert len(got) == len(want) and set(got) == want
    assert exact_dedup.keep_first(empty(spark)).count() == 0


# ---------------------------------------------------------------- BPE


def tiny_ranks():
    ranks = {bytes([b]): b for b in range(256)}
    for t in ("th", "he", "the", " the", "in", "ing", "an", "and", "aa", "aaa", "ab", "bc", "abc", "cat", "at"):
        ranks[t.encode()] = len(ranks)
    return ranks


def test_prefix_encoder_equals_merging():
    public = pytest.importorskip("public_tokenizers")
    e = byte_bpe.PrefixEncoder(tiny_ranks(), public.PATTERN)
    rng = random.Random(5)
    for _ in range(2000):
        data = "".join(rng.choice(["the", "a", "b", "c", "an", "in", "g", "t", "é", "h"]) for _ in range(rng.randint(0, 12))).encode()
        whole = e.ranks.get(data)
        assert e.encode_piece(data) == ([whole] if whole is not None else e._merge(data))
        last = e.prefix_tokens(data)
        assert all(e.walk_back(last, i) == e._merge(data[:i]) for i in range(len(data) + 1))
        assert e.prefix_tokens(data + b"the", list(last)) == e.prefix_tokens(data + b"the")


def test_bpe_equals_the_library(docs, clashing, spark):
    public, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    ranks = byte_bpe.read_ranks(public.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = Counter(tuple(r) for r in byte_bpe.round_trip(docs, ranks, public.PATTERN).collect())
    want = Counter()
    for doc, text, *_ in corpus():
        ids = np.array(library.encode_ordinary(text or ""), "<u4").tobytes()
        want[(doc, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())] += 1
    assert got == want
    assert Counter(tuple(r) for r in byte_bpe.round_trip(clashing, ranks, public.PATTERN).collect()) == want
    assert byte_bpe.round_trip(empty(spark), ranks, public.PATTERN).count() == 0
    e = byte_bpe.PrefixEncoder(ranks, public.PATTERN)
    rng = random.Random(2)
    parts = ["a", "the", "日本", " ", "  ", "\n", "😀", "é", "123", "!!", "ing", "x" * 30, "'s"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        start = rng.randint(0, len(text))
        end = rng.randint(start, len(text))
        new = "".join(rng.choice(parts) for _ in range(rng.randint(0, 3)))
        assert e.encode(text) == np.array(library.encode_ordinary(text), "<u4").tobytes()
        changed, ids = e.re_encode(text, e.encode(text), start, end, new)
        assert ids == e.encode(changed)


# ---------------------------------------------------------------- packing


def test_packing_is_whole_and_tight(docs, spark):
    public, tokenizers = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    special = [(800, "a <|endoftext|> b", None, None, 1), (801, "<|endoftext|><|endoftext|>x <|endoftext", None, None, 1), (802, "𝒂 \u0378 é", None, None, 1)]
    both = docs.unionByName(spark.createDataFrame(special, SCHEMA)).withColumns({"ids": F.lit(1), "length": F.lit("x"), "offset": F.lit(0)})
    with open(public.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        rows = packing.pack(both, f.read(), public.PATTERN).collect()
    want = Counter()
    for doc, text, *_ in [*corpus(), *special]:
        want[(doc, tuple(library.encode(text or "", add_special_tokens=False).ids) + (1,))] += 1
    # repeated rows may share (doc_id, start): compare what their ids add up to
    tokens = Counter()
    for (doc, ids), n in want.items():
        tokens[doc] += n * len(ids)
    got = Counter()
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] and r["start"] + r["length"] <= r["doc_tokens"]
        got[r["doc_id"]] += r["length"]
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert any(d == r["doc_id"] and list(t[r["start"] : r["start"] + r["length"]]) == ids and len(t) == r["doc_tokens"] for d, t in want)
    assert got == tokens
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padding = 0
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048
        padding += 0 if end & (end - 1) == 0 else 2048 - end
    assert padding == 0
    assert packing.pack_documents(empty(spark)).count() == 0


def test_packer_balances_step_groups():
    packer = packing.Packer(tiers=(4, 8, 16), step_tokens=32)
    rng = random.Random(1)
    total = 0
    for doc in range(300):
        n = rng.randint(1, 40)
        total += n
        packer.add(doc, np.arange(n, dtype="<u4"))
    windows = packer.flush(last=True)
    assert sum(len(p[2]) for _, pieces in windows for p in pieces) == total
    groups: dict = {}
    for (context, _), g in zip(windows, packer.step_groups(windows), strict=True):
        groups.setdefault(g, []).append(context)
    assert all(len(set(c)) == 1 and sum(c) <= 32 for c in groups.values())


# ---------------------------------------------------------------- language model


def test_lm_base_scores_and_sums(docs, spark):
    got = lm_scoring.score(docs).collect()
    counts, tokens = Counter(), []
    for doc, text, *_ in corpus():
        t = [*lm_scoring.tokens_of(text), None]
        out = doc is None or zlib.crc32(str(doc).encode()) % 7 == 2
        tokens.append((doc, out, t))
        if not out:
            counts.update(t)
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for doc, out, t in tokens:
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in t)
        want[(doc, out, len(t), sum(counts[x] > 0 for x in t), n, round(base, 4))] += 1
    assert Counter((*tuple(r)[:5], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert lm_scoring.score(empty(spark)).count() == 0


class SlowMixing:
    """The mixing of `mixing`, one decision at a time, from tables that are dictionaries."""

    def __init__(self, code, bits, gates):
        self.code, self.bits, self.gates, self.counts = code, bits, gates, Counter()
        self.mixer = mixing.Mixer(len(bits))

    def decisions(self, symbol, contexts):
        for k in range(self.code.lengths[symbol]):
            at = self.code.starts[symbol] + k
            mark = int(self.code.mark[at])
            cells = [
                (int(c) ^ mark) * 0x9E3779B1 % 2**32 >> (32 - b) if b else int(self.code.node[at])
                for c, b in zip(contexts, self.bits, strict=True)
            ]
            yield int(self.code.depth[at]), int(self.code.bit[at]), cells

    def note(self, symbol, contexts):
        for _, bit, cells in self.decisions(symbol, contexts):
            self.counts.update((i, c, bit) for i, c in enumerate(cells))

    def lot(self, symbols, contexts, counted, learnt):
        """log10 of each symbol; then the mixers learn, or before if nothing has been learnt."""
        rows = []
        for s, symbol in enumerate(symbols):
            for depth, bit, cells in self.decisions(symbol, [c[s] for c in contexts]):
                n = [[self.counts[i, c, b] - (counted[s] and b == bit) for b in (0, 1)] for i, c in enumerate(cells)]
                odds = [np.clip(np.log((np.float32(o) + 0.4) / (np.float32(z) + 0.4)), -9, 9) for z, o in n]
                inputs = np.array([*(np.rint(x * 14) / 14 for x in odds), 0.25], np.float32)
                known = [(sum(n[g]) > 1.5) + 0 + (sum(n[g]) > 15.5) for g in self.gates]
                rows.append((s, (depth * 3 + known[0]) * 3 + known[1], depth, bit, inputs, learnt[s]))
        if fresh := not self.mixer.refine.any():
            self.learn(rows)
        out = np.zeros(len(symbols))
        for s, m, depth, bit, inputs, _ in rows:
            x = np.float32(np.clip(self.mixer.weights[m] @ inputs, -12, 12))
            p = self.mixer.probability(np.array([depth]), np.array([x]))[0]
            out[s] += math.log10(p if bit else 1 - p)
        if not fresh:
            self.learn(rows)
        return out

    def learn(self, rows):
        slope = np.zeros((mixing.MIXERS, len(self.bits) + 1, 1))
        old = self.mixer.weights
        for _, m, depth, bit, inputs, learnt in rows:
            if not learnt:
                continue
            x = float(np.clip(old[m] @ inputs, -12, 12))
            p = 1 / (1 + math.exp(-x))
            where = (x + 12) * 32 / 24
            low = min(int(where), 31)
            for bucket, share in ((low, 1 - where + low), (low + 1, where - low)):
                self.mixer.refine[depth * 33 + bucket] += share * bit, share
            self.mixer.curve[m] += np.outer(inputs, inputs) * p * (1 - p)
            slope[m, :, 0] += inputs * (bit - p)
        self.mixer.weights = np.clip(old + np.linalg.solve(self.mixer.curve, slope)[:, :, 0], -3, 3).astype(np.float32)


def test_mixing_equals_one_decision_at_a_time():
    rng = np.random.default_rng(3)
    masses = np.array([40, 20, 9, 5, 3, 1, 0])
    code, bits = mixing.Code(masses), (0, 6, 8)
    assert abs(sum(2.0 ** -int(n) for n in code.lengths) - 1) < 1e-12
    tables, slow = mixing.Tables(code, bits), SlowMixing(code, bits, (1, 2))
    counts, lots = tables.empty(), []
    for _ in range(5):
        symbols = rng.choice(7, 120, p=masses / masses.sum())
        symbols[::10] = 6
        before = np.concatenate([[7], symbols[:-1]])
        contexts = [np.zeros(120, np.uint32), mixing.hashed(before), mixing.hashed(before, np.roll(before, 1))]
        training = rng.random(120) < 0.8
        tables.note(counts, tables.decisions(symbols[training], [c[training] for c in contexts]))
        for s in np.flatnonzero(training):
            slow.note(symbols[s], [c[s] for c in contexts])
        lots.append((symbols, contexts, training, training))
    assert all(table[2 * c + b] == slow.counts[k, c, b] for k, table in enumerate(counts) for c in range(len(table) // 2) for b in (0, 1))
    for lot, got in zip(lots, mixing.Predictor(tables, counts, (1, 2)).run(lots), strict=True):
        assert np.allclose(got, slow.lot(*lot), atol=2e-3)


def brute_lm(rows):
    """Classes of all tokens and the sums beyond classes, from plain loops; spellings given by a function."""
    texts = [(d, lm_scoring.tokens_of(t), d is None or zlib.crc32(str(d).encode()) % 7 == 2) for d, t, *_ in rows]
    count = Counter(w for _, t, out in texts if not out for w in t)
    ranked = sorted((w for w in count if len(w) <= 64), key=lambda w: (-count[w], w))[: lm_scoring.TOP]
    top = {w: i for i, w in enumerate(ranked)}

    def of(word, n):
        if n <= 0:
            return 0
        if word in top:
            return 3 + top[word]
        return 3 + lm_scoring.TOP + zlib.crc32(word[:2] + b"|" + word[-2:]) % 32 * 16 + min(n.bit_length() - 1, 15)

    masses = Counter()
    for w, n in count.items():
        masses[of(w, n)] += n
    out = []
    for doc, words, held_out in texts:
        had, classes, inside, spelt = set(), [], 0.0, []
        for w in words:
            n = count[w] - (0 if held_out else words.count(w))
            if w in had:
                classes.append(2)
                inside -= math.log10(len(had))
                continue
            classes.append(of(w, n))
            if n <= 0:
                spelt.append(w)
            elif w not in top:
                inside += math.log10(n / max(n, masses[of(w, n)]))
            if w not in top:
                had.add(w)
        out.append((doc, held_out, classes, inside, spelt))
    return out, count, top


def test_lm_classes_and_sums_equal_brute_force(docs, monkeypatch):
    monkeypatch.setattr(lm_scoring, "TOP", 20)
    monkeypatch.setattr(lm_scoring, "OTHERS", 23)
    monkeypatch.setattr(lm_scoring, "CLASSES", 23 + 32 * 16)
    rows = [r for r in corpus() if r[1] is None or len(r[1]) < 5000]
    want, count, top = brute_lm(rows)
    words = sorted({w for _, t, *_ in rows for w in lm_scoring.tokens_of(t)})
    number = {w: i for i, w in enumerate(words)}
    place = np.array([-1 - top[w] if w in top else lm_scoring.form_of(w) for w in words])
    n = np.array([count[w] for w in words])
    spelt = np.array([-1.0 - i / 7 for i in range(len(words))])
    masses = np.bincount(lm_scoring.class_of(place, n), n, lm_scoring.CLASSES)
    ids = [[number[w] for w in lm_scoring.tokens_of(t)] for _, t, *_ in rows]
    lengths = np.array([len(x) for x in ids])
    flat, training = np.array([i for x in ids for i in x], np.int64), np.array([not x[1] for x in want])
    got, cost = lm_scoring.coded_words(flat, lengths, training, place, n, spelt, masses)
    at = 0
    for (_, _, classes, inside, unknown), size in zip(want, lengths, strict=True):
        assert got[at : at + size].tolist() == classes
        assert abs(cost[at : at + size].sum() - inside - sum(spelt[number[w]] for w in unknown)) < 1e-9
        at += size
    assert [x for s in lm_scoring._runs(np.array([5, 9, 1, 1, 1, 0, 7]), 4) for x in range(7)[s]] == list(range(7))


def test_lm_contexts_stay_in_their_document():
    top = lm_scoring.OTHERS
    classes = np.array([5, top + 3, 1, 6, 0, 7, top + 9, 1])
    got = lm_scoring.class_contexts(classes, np.array([0, 3]))
    none = lm_scoring.CLASSES
    pairs = [(none, none), (5, none), (top + 3, 5), (none, none), (6, none), (0, 6), (7, 0), (top + 9, 7)]
    frequent = [(none, none), (5, none), (5, none), (none, none), (6, none), (6, none), (7, 6), (7, 6)]
    a, b = (np.array(x) for x in zip(*pairs, strict=True))
    c, d = (np.array(x) for x in zip(*frequent, strict=True))
    want = [mixing.hashed(a), mixing.hashed(a, b) + np.uint32(1), mixing.hashed(c) + np.uint32(5), mixing.hashed(c, d) + np.uint32(7)]
    assert not got[0].any() and all((x == y).all() for x, y in zip(got[1:], want, strict=True))


def test_lm_hears_the_order_of_words_and_not_the_cores(spark, monkeypatch):
    """Sentences of a fixed grammar cost less than the same words shuffled, and any partitioning gives the same scores."""
    monkeypatch.setattr(lm_scoring, "SEGMENT_TOKENS", 4000)
    monkeypatch.setattr(lm_scoring, "BLOCK_CHARS", 9000)
    rng = random.Random(6)
    parts = [["the", "a"], ["red", "old", "big"], ["dog", "cat", "bird"], ["sees", "likes"], ["no", "every"], ["tree", "house"]]
    rows = []
    for i in range(400):
        words = [rng.choice(p) for _ in range(12) for p in parts]
        if i % 7 == 3:
            rng.shuffle(words)
        rows.append((i, " ".join(words), None, "s", 1))
    df = spark.createDataFrame(rows, SCHEMA)
    one = {r["doc_id"]: r for r in lm_scoring.score(df.repartition(1)).collect()}
    other = {r["doc_id"]: r for r in lm_scoring.score(df.repartition(5)).collect()}
    assert all(abs(one[i]["score"] - other[i]["score"]) < 1e-6 for i in one)
    held = [one[i] for i in range(400) if one[i]["held_out"]]
    mean = [np.mean([r["score"] for r in held if (r["doc_id"] % 7 == 3) == s]) for s in (False, True)]
    assert mean[0] > mean[1] * 0.7, mean
    assert sum(r["score"] for r in held if r["doc_id"] % 7 != 3) > sum(r["base_score"] for r in held if r["doc_id"] % 7 != 3)
    assert all(abs(r["bits_per_byte"] + r["score"] / math.log10(2) / r["n_bytes"]) < 1e-9 for r in held)


def test_lm_spellings_are_a_distribution():
    """Over a short alphabet the probabilities of all spellings of up to three bytes add up to less than one, and to most of it."""
    words = [b"a", b"b", b"ab", b"ba", b"aab"]
    code = mixing.Code(np.bincount(np.frombuffer(b" ".join([*words, b""]), np.uint8), minlength=256))
    tables = mixing.Tables(code, lm_scoring.BYTE_BITS)
    counts, every = tables.empty(), np.ones(len(words), bool)
    for symbols, contexts, _, _ in lm_scoring.Spelling(words).steps(every, every):
        tables.note(counts, tables.decisions(symbols, contexts))
    counts = [c * 20 for c in counts]
    model = mixing.Predictor(tables, counts, lm_scoring.BYTE_GATES)
    for _ in range(20):
        list(model.run(lm_scoring.Spelling(words).steps(every, every)))
    some = [bytes(97 + b for b in x) for n in range(4) for x in np.ndindex(*[2] * n)]
    spelling, no = lm_scoring.Spelling(some), np.zeros(len(some), bool)
    cost = np.bincount(spelling.word, np.concatenate([*model.run(spelling.steps(no, no))]), len(some))
    assert 0.5 < (10**cost).sum() <= 1 + 1e-9


# ---------------------------------------------------------------- language


def test_language_profiles(spark):
    rng = random.Random(4)
    words = {"xx": ["schlacht", "ungen", "heit", "der", "und"], "yy": ["ation", "les", "queue", "eau", "et"]}
    rows = []
    for i in range(300):
        lang = "xx" if i % 3 else "yy"
        rows.append((i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(3, 40))), lang if i % 11 else None, "s", 1))
    rows += [(900, None, "xx", "s", 1), (901, "123 !!!", "xx", "s", 1), (902, "", None, "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(df).collect()}
    right = [got[i][0] == ("xx" if i % 3 else "yy") for i in range(300) if language_id.fold_of(i) == 0]
    assert sum(right) > 0.95 * len(right)
    assert all(got[i] == ("und", 0.0) for i in (900, 901, 902)) and all(0 <= s <= 1 for _, s in got.values())
    kept = language_id.keep_identified(df.withColumn("score", F.lit(1)))
    assert kept.columns == [*df.columns, "score"] and kept.count() == 300
    assert language_id.identify(empty(spark)).count() == 0
    nolang = df.withColumn("lang", F.lit(None).cast("string"))
    assert language_id.keep_identified(nolang).count() == df.count()


def brute_grams(text):
    """n-grams of words padded by a blank, most frequent first, then by code points."""
    line = "".join(c.lower() if len(c.lower()) == 1 else c for c in text if True)
    words = re.findall(r"[^\W\d_]+", "".join(c if c.isalpha() else " " for c in line))
    found = Counter()
    for at, w in enumerate(words):
        found.update(w)
        padded = f" {w} "
        found.update(padded[i : i + 2] for i in range(len(padded) - 1))
        found.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return [g for g, _ in sorted(found.items(), key=lambda x: (-x[1], [*map(ord, x[0].rjust(3, "\0"))]))]


def test_language_distance_equals_brute_force(spark):
    rng = random.Random(7)
    letters = {"xx": "abcdefgh", "yy": "efghijkl", "кк": "абвгдежз", "hh": "".join(map(chr, range(0x4E00, 0x4E80)))}
    rows = []
    for i in range(240):
        lang = list(letters)[i % 4]
        words = ["".join(rng.choices(letters[lang], range(len(letters[lang]), 0, -1), k=rng.randint(1, 5))) for _ in range(rng.randint(1, 50))]
        rows.append((i, rng.choice([" ", ", ", "-", "7"]).join(words), lang, "s", 1))
    rows += [(300, "long text here " * 30000, None, "s", 1), (301, "İstanbul ǅ ß", None, "s", 1), rows[0], rows[0], (302, "tie", None, "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit(1))
    want = brute_languages(rows)
    for r in language_id.identify(df).collect():
        assert (r["lang_pred"], round(r["score"], 9)) == want(r["text"])


def brute_languages(rows):
    """A function from texts to (language, score), from profiles of the rows' training fold."""
    profiles, k = {}, language_id.PROFILE
    for lang in {r[2] for r in rows} - {None}:
        total = Counter()
        for i, text, own, *_ in rows:
            if own == lang and text and i is not None and zlib.crc32(str(i).encode()) % 5 and (found := language_id.grams_of(text)):
                total.update(dict(zip(map(language_id.spelt, found[0].tolist()), found[1].tolist(), strict=True)))
                assert list(map(language_id.spelt, language_id.top_grams(*found, 10**6).tolist())) == brute_grams(text)
        ordered = sorted(total.items(), key=lambda x: (-x[1], [*map(ord, x[0].rjust(3, "\0"))]))
        profiles[lang] = {g: at for at, (g, _) in enumerate(ordered[:k])}

    def predict(text):
        own = brute_grams(text or "")[:k]
        if not own:
            return "und", 0.0
        distance = {x: sum(abs(p[g] - at) if g in p else k for at, g in enumerate(own)) for x, p in profiles.items()}
        best = min(sorted(distance), key=distance.get)
        return best, round(1 - distance[best] / (k * len(own)), 9)

    return predict


# ---------------------------------------------------------------- toxicity


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(8)
    clean = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    bad = ["vilefoo", "vilebar", "nasty", "foul"]
    rows = []
    for i in range(600):
        words = rng.choices(clean, k=30)
        if i % 6 == 0:
            words[:3] = rng.choices(bad, k=3)
        rows.append((i, " ".join(words) + ".", None, "s", 1))
    df = spark.createDataFrame([*rows, (700, None, None, "s", 1), (701, "", None, "s", 1)], SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(0, 400)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    assert toxicity.labelled_sample(df, labels).count() == 400 and toxicity.labelled_sample(df, labels, 50).count() == 50
    model = toxicity.fit_documents(df, labels)
    texts = [r[1] for r in rows[:400]]
    same = toxicity.fit(texts, toxic=[int(i % 6 == 0) for i in range(400)])
    assert set(model.weights) == set(same.weights) and np.allclose(model.thresholds, same.thresholds)
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    held = [(got[i]["toxic"], i % 6 == 0) for i in range(400, 600)]
    assert sum(a == b for a, b in held) > 0.97 * len(held)
    assert not got[700]["toxic"] and not got[701]["toxic"]
    none = toxicity.fit([], toxic=[])
    assert none.above("anything")[0] < 1e-6 and toxicity.score(empty(spark), none).count() == 0
    assert not toxicity.fit_documents(df, labels.limit(0)).weights and not toxicity.fit_documents(empty(spark), labels).weights


def test_toxicity_scores_equal_brute_force(docs, clashing, spark):
    """Every row's expected severity from the weights and thresholds alone; long texts and repeated rows as well."""
    rng = random.Random(12)
    rows = []
    for i in range(500):
        n, bad = rng.choice([10, 300]), rng.choice([1, 3, 6]) if i % 4 == 0 else 0
        words = [f"w{rng.randint(0, 60)}" for _ in range(n)] + rng.sample(["vile", "awful", "nasty", "gross", "horrid", "beastly"], bad)
        rows.append((i, " ".join(rng.sample(words, len(words))), None, "s", 1))
    rows += [rows[0], rows[0], (900, "vile nasty " * 20000, None, "s", 1), (901, None, None, "s", 1), (902, "VILE, awful!", None, "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"toxic": F.lit("x"), "id": F.lit(0), "grade": F.lit(9)})
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 7) for i in range(400)], "doc_id long, toxic int, text int")
    model = toxicity.fit_documents(df, labels)
    got = toxicity.score(df, model).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        found = {w[:k] + ("*" if k < len(w) else "") for w in re.findall(r"\w+", (texts[r["doc_id"]] or "").lower()) for k in (4, 5, 6, 7, len(w)) if k <= len(w)}
        total = sum(model.weights.get(f, 0) for f in found)
        above = [1 / (1 + math.exp(min(30, max(-30, t - total)))) for t in model.thresholds]
        assert abs(r["severity"] - sum(above)) < 1e-9 and abs(r["p_toxic"] - above[0]) < 1e-9
        assert r["grade"] == sum(p >= 0.5 for p in above) and r["toxic"] == (above[0] >= 0.5)
    severity = {r["doc_id"]: r["severity"] for r in got}
    few, many, clean = ([severity[i] for i in range(400, 500) if (set(texts[i].split()) & {"vile", "awful", "nasty", "gross", "horrid", "beastly"}).__len__() in k] for k in ((1,), (6,), (0,)))
    assert np.mean(clean) < 0.2 and np.mean(clean) + 0.3 < np.mean(few) < np.mean(many) - 0.8
    # equally bad texts are equally severe, whatever their length
    long, short = (np.mean([severity[i] for i in range(0, 500, 4) if (len(texts[i]) > 600) == s]) for s in (True, False))
    assert abs(long - short) < 0.5, (long, short)
    assert toxicity.score(clashing, model).count() == docs.count()


def test_ordinal_thresholds_are_ordered_and_monotone():
    rng = random.Random(1)
    texts, grades = [], []
    for _ in range(400):
        g = rng.choice([0, 0, 1, 2])
        texts.append(" ".join(["fine"] * 5 + ["bad"] * (g > 0) + ["worse"] * (g > 1) + [f"w{rng.randint(0, 30)}"]))
        grades.append(g)
    m = toxicity.fit(texts, grades)
    assert m.thresholds == sorted(m.thresholds)
    severity = [sum(m.above(t)) for t in ("fine", "fine bad", "fine bad worse")]
    assert severity[0] < 0.3 < severity[1] < 1.6 < severity[2]


# ---------------------------------------------------------------- surrogates

_PRIVATE = [
    (1, "write to ann.smith@mail.example.com or +1 (415) 555-1234 today", None, "s", 1),
    (2, "ann.smith@mail.example.com, again: 10.1.2.3.", None, "s", 1),
    (3, "card 4111 1111 1111 1111 and 078-05-1120", None, "s", 1),
    (4, "Mr. Miller met Mrs. Jones; г-жа Иванова", None, "s", 1),
    (5, None, None, "s", 1), (6, "nothing here", None, "s", 1), (7, "", None, "s", 1),
    (2, "ann.smith@mail.example.com, again: 10.1.2.3.", None, "s", 1),
]


def test_surrogates_keep_type_and_identity(spark):
    df = spark.createDataFrame(_PRIVATE, SCHEMA).withColumns({"found": F.lit(1), "n_entities": F.lit(0), "mark": F.lit("")})
    rows = pii_surrogates.replace(df, "one key").collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(_PRIVATE)
    assert re.fullmatch(r"write to [a-z]{3}\.[a-z]{5}@[a-z]{4}\.[a-z]{7}\.com or \+1 \(\d{3}\) \d{3}-\d{4} today", got[1]["text"])
    mail = re.search(r"\S+@\S+\.com", got[1]["text"])[0]
    assert mail != "ann.smith@mail.example.com" and got[2]["text"].startswith(mail + ", again: ")
    assert all(0 < int(x) < 256 for x in re.search(r"(\d+\.){3}\d+", got[2]["text"])[0].split("."))
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", got[3]["text"])[0]
    digits = [int(d) for d in card if d.isdigit()][::-1]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    assert re.search(r"Mr\. [A-Z][a-z]+ met Mrs\. [A-Z][a-z]+; г-жа [А-Я][а-я]+", got[4]["text"]) and "Miller" not in got[4]["text"]
    assert got[5]["text"] is None and got[6]["text"] == "nothing here" and got[7]["text"] == "" and got[4]["n_entities"] == 3
    assert pii_surrogates.replace(df, "other key").where("doc_id = 1").first()["text"] != got[1]["text"]
    assert pii_surrogates.replace(spark.createDataFrame([], SCHEMA)).count() == 0


def _swapped(spark, *texts):
    df = spark.createDataFrame([(i, t, None, "s", 1) for i, t in enumerate(texts)], SCHEMA)
    return [r["text"] for r in sorted(pii_surrogates.replace(df, "one key").collect(), key=lambda r: r["doc_id"])]


def test_notations_of_one_entity_share_a_surrogate(spark):
    phones = _swapped(spark, "+1 (415) 555-1234", "+14155551234", "415-555-1234", "(415) 555-1234", "415.555.1234", "+44 20 7946 0958", "+442079460958")
    assert {re.sub(r"\D", "", p)[-10:] for p in phones[:5]} == {re.sub(r"\D", "", phones[2])} != {"4155551234"}
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", phones[0]) and re.fullmatch(r"\+1\d{10}", phones[1])
    assert phones[5].startswith("+44 ") and phones[5].replace(" ", "") == phones[6] != "+442079460958"
    one, other = _swapped(spark, "DE89 3704 0044 0532 0130 00", "DE89370400440532013000")
    assert one.replace(" ", "") == other and re.fullmatch(r"DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d", one) and one[5:] != "3704 0044 0532 0130 00"
    assert int("".join(str(int(c, 36)) for c in other[4:] + other[:4])) % 97 == 1
    mails = _swapped(spark, "Bob@X.com", "bob@x.com", "bob@mail.co.uk", "ann@d.org.au")
    assert mails[0].lower() == mails[1] != "bob@x.com" and mails[0][0].isupper() and mails[0][4].isupper() and mails[0].endswith(".com")
    assert mails[2].endswith(".co.uk") and mails[3].endswith(".org.au") and "bob" not in mails[2] and "mail" not in mails[2]
    cards = _swapped(spark, "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111")
    assert len({re.sub(r"\D", "", c) for c in cards}) == 1 and cards[1].count("-") == 3


def test_names_of_several_words_and_scripts(spark):
    got = _swapped(
        spark, "Mr Smith met Mr. Smith; Smith left. Smithers stayed, SMITH too", "Mrs. Maria Jones-Brown saw Mr O'Brien and Mr McDonald. Jones-Brown ran.",
        "Mr Παπαδόπουλος, г-жа Иванова, г-н Иванов", "Mr Adam Smith Mrs Eva Smith", "Mr.", "Mr smith", "Dear Mrs Jones", "Herr Groß-Klein'sche",
    )
    a, b = re.fullmatch(r"Mr (\w+) met Mr\. \1; \1 left\. Smithers stayed, SMITH too", got[0]), re.fullmatch(r"Mrs\. (\w+-\w+) (\w+) saw Mr (\w+) and Mr (\w+)\. (\w+) ran\.", got[1])
    assert a and a[1] != "Smith" and b and b[2] == b[5] and not {"Maria", "Jones", "Brown", "Brien", "McDonald"} & set(re.findall(r"\w+", got[1]))
    c = re.fullmatch(r"Mr ([Α-Ω][α-ως]+), г-жа ([А-Я][а-я]+ова), г-н ([А-Я][а-я]+ов)", got[2])
    assert c and c[1] != "Παπαδόπουλος" and c[2] != "Иванова" and c[3] != "Иванов"
    d = re.fullmatch(r"Mr (\w+-\w+) (\w+) Mrs (\w+-\w+) (\w+)", got[3])
    assert d and d[2] == d[4] == a[1]
    assert d[1].split("-")[0] in pii_surrogates.GIVEN["latin", "male"].split() and d[3].split("-")[0] in pii_surrogates.GIVEN["latin", "female"].split()
    assert got[4:6] == ["Mr.", "Mr smith"] and re.fullmatch(r"Dear Mrs [A-Z][a-z]+", got[6]) and "Groß" not in got[7] and "Klein" not in got[7]


def test_rewriting_equals_brute_force(docs, clashing, spark):
    """Parts between matches stay as they are, and each match becomes what it becomes alone."""
    rng = random.Random(21)
    parts = ["a@b.com", "10.0.0.1", "+1 415 555 0100", "4111 1111 1111 1111", "078-05-1120", "plain words", "é|x", "$1 \\Q", "fe80::1:2", "DE89370400440532013000", "Ms Ng"]
    texts = [" ; ".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(60)] + ["a@b.com " * 3000, "x " * 60000]
    alone = dict(zip(parts, _swapped(spark, *parts), strict=True))
    assert sum(alone[p] != p for p in parts) == 8 and len(set(alone.values())) == len(parts)
    for text, got in zip(texts, _swapped(spark, *texts), strict=True):
        want = " ; ".join(alone.get(p, p) for p in text.split(" ; ")) if " ; " in text or text in alone else text.replace("a@b.com", alone["a@b.com"])
        assert got == want
    assert pii_surrogates.replace(clashing).count() == docs.count()


def test_entities_beside_letters_and_of_all_scripts(spark):
    """Addresses right after a letter, and those with letters and digits of the upper planes, as the plain properties find them."""
    plain = (
        r"(?<![\p{L}\p{M}\p{N}._%+\-])[\p{L}\p{N}_%+\-][\p{L}\p{M}\p{N}._%+\-]{0,63}+@(?:[\p{L}\p{N}\-]{1,63}\.){1,8}\p{L}{2,24}"
        r"|(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"
    )
    want = {
        "IP192.168.0.1 up": ["192.168.0.1"], "host_10.1.2.3, ok": ["10.1.2.3"], "地址10.1.2.3。": ["10.1.2.3"], "1.2.3.4.5 and 1.10.1.2.3": [],
        "to ａｎｎ１@ｍａｉｌ.com": ["ａｎｎ１@ｍａｉｌ.com"], "𝒂𝒃9@x.org;": ["𝒂𝒃9@x.org"], "ⰰⰱ@佐々木.jp": ["ⰰⰱ@佐々木.jp"],
        "é.ü@bücher.de×a@b.com": ["é.ü@bücher.de", "a@b.com"], "a.b-c%d+e@f-g.co.uk.": ["a.b-c%d+e@f-g.co.uk"],
    }
    rows = spark.createDataFrame([(t,) for t in want], "text string")
    found = rows.select("text", pii_surrogates.entities().alias("new"), F.regexp_extract_all("text", F.lit(plain), F.lit(0)).alias("old")).collect()
    for r in found:
        assert r["new"] == r["old"] == want[r["text"]], r


def test_surrogates_of_a_small_space_stay_distinct(spark, monkeypatch):
    """All 2 ** 7 surrogates that the first rounds can draw collide at once; the checks still keep entities apart."""
    real = pii_surrogates.surrogate_key

    def narrow(key, round_, secret):
        if round_ < 6:
            return F.concat(F.lit("email|a@b"), (F.crc32(F.concat(key.cast("binary"), F.lit(str(round_)).cast("binary"))) % 128).cast("string"), F.lit(".com"))
        return real(key, round_, secret)

    monkeypatch.setattr(pii_surrogates, "surrogate_key", narrow)
    rows = [(i, f"mail user{i}@x.com and user{i + 1}@x.com and a@b{i % 7}.com", None, "s", 1) for i in range(60)]
    got = {r["doc_id"]: re.findall(r"\S+@\S+", r["text"]) for r in pii_surrogates.replace(spark.createDataFrame(rows, SCHEMA)).collect()}
    of = {}
    for i, text, *_ in rows:
        for entity, made in zip(re.findall(r"\S+@\S+", text), got[i], strict=True):
            assert of.setdefault(entity, made) == made
    assert len(set(of.values())) == len(of) and not set(of) & set(of.values())


# ---------------------------------------------------------------- secrets

_BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


_ADDED = {
    "github": re.compile("gh[pousr]_[A-Za-z0-9]{36,}"), "slack": re.compile("xox[abprs]-[A-Za-z0-9-]{10,}"),
    "stripe": re.compile("[rs]k_live_[A-Za-z0-9]{16,}"), "google": re.compile("AIza[A-Za-z0-9_-]{35,}"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    "private_key": re.compile("-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"), "bearer": re.compile("bearer\x20+[A-Za-z0-9._+/=-]{20,}", re.I | re.A),
}


def brute_spans(text):
    found = [(m.start(), i, m.end(), k) for i, (k, r, ok) in enumerate(_BASE) for m in r.finditer(text or "") if ok(m)]
    return [(s, e, k) for s, _, e, k in sorted(found)]


def test_scanner_equals_the_expressions():
    scanner = secret_scan.scanner_for()
    rng = random.Random(1)
    parts = ["token", "secret", "password", "PassWD", "api_key", "APIKEY", "=", ":", '"', "'", " ", "abc", "abcdef", "AKIA", "AKIA0123",
             "ABCDEFGH01234567", "0123456789abcdef", "deadbeef", "é", "\n", "ghp_", "==", "eyJ", ".", "ſ"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert [x for x in scanner.spans(text) if x[2] in ("assign", "access", "hex")] == brute_spans(text), text

    added = _ADDED
    assert [r.kind for r in secret_scan.RULES if not r.base] == list(added)
    parts = ["ghp_", "gho_", "xoxb-", "sk_live_", "rk_live_", "AIza", "eyJ", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "Bearer ", "bearer", "  ",
             "a1B2c3D4", "Zz9Yy8Xx7Ww6Vv5Uu4", "eyJhbGciOiJI.", "eyJzdWIiOiIx.", "0123456789abcdef", "_", "-", ".", " ", "é", "=", "token=", "AKIA"]
    seen = Counter()
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 16)))
        order = list(added)
        want = sorted((m.start(), order.index(k), m.end(), k) for k, r in added.items() for m in r.finditer(text))
        assert [x for x in scanner.spans(text) if x[2] in added] == [(s, e, k) for s, _, e, k in want], text
        seen.update(k for *_, k in want)
    assert set(seen) == set(added), seen
    key = "ghp_" + "a1B2" * 10
    assert scanner.spans(f"é {key}") == [(2, 2 + len(key), "github")]
    assert (0, 31, "private_key") in scanner.spans("-----BEGIN RSA PRIVATE KEY-----")


def test_secret_digest_and_redaction(docs, clashing, spark):
    rows = [(1, "é token = abcdef12 x", None, "s", 20), (2, None, None, "s", None), (3, "clean", None, "s", 5), (3, "clean", None, "s", 5), (4, "", None, "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in secret_scan.digest(df).collect()}
    assert got[1]["spans"] == "assign:2:18" and got[1]["n_assign"] == 1
    assert got[1]["base_sha256"] == hashlib.sha256(b"assign:2:18").hexdigest() and got[2]["spans"] == ""
    cut = {r["doc_id"]: (r["text"], r["n_chars"]) for r in secret_scan.redact(df).collect()}
    assert cut == {1: ("é [SECRET] x", 12), 2: (None, None), 3: ("clean", 5), 4: ("", 0)}
    assert secret_scan.redact(clashing).columns == clashing.columns and secret_scan.digest(clashing).count() == docs.count()
    assert secret_scan.scan(df).where("size(spans) > 0").count() == 1
    assert secret_scan.redact(empty(spark)).count() == 0


def test_automaton_is_minimal():
    dfa = automaton.compile_rules([automaton.parse("(ab|cb)+d?")], unanchored=False)
    assert len(dfa.accepts) == 5
    with pytest.raises(ValueError):
        automaton.parse("a)b")


# ---------------------------------------------------------------- near copies


def shingles(text, k):
    w = (text or "").encode().lower().split()
    k = min(k, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def brute_components(rows, k, num, den):
    sets: dict = {}
    for doc, text, *_ in rows:
        sets.setdefault(shingles(text, k), []).append(doc)
    items = [s for s in sets if s]
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(items):
        for j in range(i):
            b = items[j]
            # sets that only rows without an id have link nothing
            if all(x is None for x in sets[a]) or all(x is None for x in sets[b]):
                continue
            if den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    lowest: dict = {}
    for i, s in enumerate(items):
        ids = [d for d in sets[s] if d is not None]
        if ids:
            lowest[find(i)] = min(lowest.get(find(i), ids[0]), *ids)
    out = Counter()
    for doc, text, *_ in rows:
        s = shingles(text, k)
        out[(doc, len(s), lowest.get(find(items.index(s))) if s else doc)] += 1
    return out


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 80, 100), (2, 50, 100)])
def test_jaccard_components_equal_brute_force(docs, k, num, den):
    got = Counter(tuple(r) for r in jaccard_join.link(docs, k, num, den).collect())
    assert got == brute_components(corpus(), k, num, den)


@pytest.mark.parametrize("extended", [1.0, 2.0])
def test_jaccard_on_chains_small_sets_and_long_lists(spark, monkeypatch, extended):
    """Families of edited texts of all lengths; short blocks and lists, so that every path is taken."""
    monkeypatch.setattr(jaccard_join, "LONG_LIST", 6)
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 8)
    rng = random.Random(11)
    rows, i = [], 0
    for family in range(12):
        base = [f"w{family}x{rng.randint(0, 400)}" for _ in range([8, 11, 12, 14, 19, 21, 25, 31, 40, 60, 90, 150][family])]
        for _ in range(25):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(words))
                words[at : at + 1] = rng.choice([[], [f"n{rng.randint(0, 9)}"], [words[at], "more"]])
            rows.append((i, " ".join(words + ["common passage that everyone shares"] * (family % 2)), "en", "s", 1))
            i += 3
            base = words if rng.random() < 0.3 else base
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = Counter(tuple(r) for r in jaccard_join.link(df, 3, 90, 100, extended).collect())
    assert got == brute_components(rows, 3, 90, 100)


def test_jaccard_edges_of_input(clashing, docs, spark):
    assert jaccard_join.link(empty(spark)).count() == 0
    assert jaccard_join.link(clashing).count() == docs.count()
    kept = jaccard_join.keep_first(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    near = jaccard_join.Threshold(90, 100)
    assert jaccard_join.boundary(near, {5: 10, 12: 10, 30: 10}, {}) == 11  # lists that bring nothing together are cheaper than subsets
    assert jaccard_join.boundary(near, {12: 10, 15: 10}, {12: 131.0, 15: 159.0}) == 14  # 13 and 16 subsets a set
    assert jaccard_join.boundary(near, {12: 10, 15: 10}, {12: 131.0, 15: 161.0}) == jaccard_join.WHOLE


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[119] == 100 and got[201] == 200 and 7 in got
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ids_of_candidates_are_sent_as_numbers(docs, monkeypatch):
    """No table is broadcast on purpose; beyond the bound a join gives the same rows."""

    def fail(*_):
        raise AssertionError("a table would pass through the driver")

    monkeypatch.setattr(jaccard_join.F, "broadcast", fail)
    sent = Counter(tuple(r) for r in jaccard_join.link(docs, 5, 80, 100).collect())
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", -1)
    assert Counter(tuple(r) for r in jaccard_join.link(docs, 5, 80, 100).collect()) == sent


def test_op5_step_places_each_decision_in_the_map_once(monkeypatch):
    """Learning takes from the prediction what it needs; a step without anything to learn moves nothing."""
    import numpy as np

    from parallaxis.llm import mixing

    calls, real = [], mixing.Mixer._buckets
    monkeypatch.setattr(mixing.Mixer, "_buckets", staticmethod(lambda depth, x: calls.append(len(x)) or real(depth, x)))
    rng = np.random.default_rng(3)
    symbols = rng.integers(0, 9, 400)
    contexts = [np.zeros(400, np.uint32), mixing.hashed(np.append(0, symbols[:-1])), *(mixing.hashed(symbols // k) for k in (2, 3))]
    tables = mixing.Tables(mixing.Code(np.bincount(symbols, minlength=9)), (0, 8, 9, 10))
    counts = tables.empty()
    tables.note(counts, tables.decisions(symbols, contexts))
    model = mixing.Predictor(tables, [c.astype(np.float32) for c in counts], (1, 2))
    every, none = np.ones(400, bool), np.zeros(400, bool)
    one, two = model.run([(symbols, contexts, every, every)] * 2)
    assert len(calls) == 3  # the first step teaches before it is scored
    before = [v.copy() for v in (model.mixer.weights, model.mixer.refine, model.mixer.curve)]
    for _ in model.run([(symbols, contexts, every, none)]):
        pass
    assert all(np.array_equal(a, b) for a, b in zip(before, (model.mixer.weights, model.mixer.refine, model.mixer.curve), strict=True))
    assert two.sum() > one.sum() - 1


def test_op5_spells_each_pair_of_context_and_symbol_once(monkeypatch):
    """Counts of a sequence that repeats itself are those of its single decisions, and take those of its distinct pairs only."""
    rng = np.random.default_rng(5)
    symbols = np.tile(rng.integers(0, 9, 50), 40)
    contexts = [np.zeros(2000, np.uint32), *(mixing.hashed(np.roll(symbols, k)) for k in (1, 2)), mixing.hashed(np.roll(symbols, 1), np.roll(symbols, 2))]
    tables = mixing.Tables(mixing.Code(np.bincount(symbols, minlength=9)), (0, 8, 9, 10))
    want, got, spelt = tables.empty(), tables.empty(), []
    tables.note(want, tables.decisions(symbols, contexts))
    real = mixing.Tables.decisions
    monkeypatch.setattr(mixing.Tables, "decisions", lambda self, s, c: spelt.append(len(s)) or real(self, s, c))
    tables.note_all(got, symbols, contexts)
    assert all(np.array_equal(a, b) for a, b in zip(want, got, strict=True))
    assert sum(spelt) == sum(len(set(zip(c.tolist(), symbols.tolist(), strict=True))) for c in contexts)
    nothing = tables.empty()
    tables.note_all(nothing, symbols[:0], [c[:0] for c in contexts])
    assert not any(c.any() for c in nothing)


def test_op5_models_share_evidence_and_learn_apart():
    symbols = np.random.default_rng(6).integers(0, 5, 300)
    tables = mixing.Tables(mixing.Code(np.bincount(symbols, minlength=5)), (0, 8, 9))
    contexts = [np.zeros(300, np.uint32), mixing.hashed(np.roll(symbols, 1)), mixing.hashed(np.roll(symbols, 2))]
    counts, every = tables.empty(), np.ones(300, bool)
    tables.note_all(counts, symbols, contexts)
    first = mixing.Predictor(tables, counts, (1, 2))
    costs = []
    for model in (first.anew(), first.anew()):
        assert all(a is b for a, b in zip(model.odds, first.odds, strict=True))
        costs += model.run([(symbols, contexts, every, every)])
    assert np.array_equal(*costs) and not first.mixer.refine.any()


def test_op5_words_by_kernels_equal_those_of_each_text():
    import pyarrow as pa

    texts = ["", " ", "A b\ta", " \x1c x\x85Y  c\xa0d\x0b\x0ce F\x00g\x1f\xc0\xc9 ABC\n\r", "one", "\n\nTwo  tWo", "end "]
    for kind in (pa.string(), pa.large_string()):
        for low, high in ((0, 7), (2, 6), (0, 2), (3, 3)):
            words, n_words, n_bytes = lm_scoring.words_of(pa.array(texts, kind).slice(low, high - low))
            want = [lm_scoring.tokens_of(t) for t in texts[low:high]]
            assert words.to_pylist() == [w for t in want for w in t] and words.type == pa.binary()
            assert n_words.tolist() == [len(t) for t in want] and n_bytes.tolist() == [sum(map(len, t)) for t in want]
    assert all(lm_scoring.restored(lm_scoring.squeezed(x)) == x for x in (b"", b"a", bytes(100_000)))


def test_op5_class_bytes_that_deal_segments_stay_zlib():
    """Segments follow from these bytes: another codec gives other segments, and so other scores."""
    classes = np.array([7, 300, 1, 7, 2])
    assert np.array_equal(lm_scoring._classes(zlib.compress(classes.astype("<u2").tobytes(), 1)), classes)
