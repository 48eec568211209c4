"""Filter audit, source audit and substring removal against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_operators import SCHEMA, sentence
from tidemark.llm import filter_audit, source_audit, substrings
from tidemark.llm.fmindex import FMIndex, WaveletTree

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    passage, shared = sentence(r, 60), sentence(r, 25)
    out = []
    for k in range(90):
        text = sentence(r, r.randint(1, 120))
        if k % 3 == 0:
            text = f"{sentence(r, 5)} {passage if k % 2 else shared} {text}"
        if k % 4 == 0:
            text = text.upper() + " #" * (k % 8)
        if k % 10 == 0:
            text += " again and again" * 20
        out.append((k, text, ("en", "de", None)[k % 3], f"s{k % 5}" if k % 7 else None, len(text)))
    out += [(200 + k, out[3][1], "en", f"s{k}", 1) for k in range(4)]
    out += [(2, None, "en", "s1", 1), (301, "", None, "s0", 0), (302, " \n\t ", "de", "new", 1), (303, None, "xx", "only", 1), out[9], out[9]]
    out += [(None, out[3][1], "fr", "s0", 1), (None, out[12][1], "fr", "s1", 1), (12, passage, "fr", "s2", 1), (400, "a b " * 300, "en", "s0", 1), (401, "a b " * 300 + "c", "en", "s1", 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    clashing = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for name in ("n_words", "mask", "part", "rank", "spans"):
        clashing = clashing.selectExpr("*", f"'mine' AS {name}")
    return clashing


def brute_masks(rows):
    least = {}
    for d, t, *_ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    for d, t, _, source, _ in rows:
        text = t or ""
        words = WORD.findall(text)
        fails = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), any(c in "#$%&*|" for c in text), d is not None and d > least[text]]
        yield d, source or "", sum(f << k for k, f in enumerate(fails))


def test_filter_audit(spark, docs, rows):
    labels = [(k, int(k % 2 == 0), int(k % 5 == 0)) for k in range(0, 90, 2)] + [(None, 1, 1), (4, None, None), (6, 1, 1), (301, None, 1)]
    frame = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    good, toxic = ({d for d, *x in labels if d is not None and x[k] == 1} for k in (0, 1))
    parts = defaultdict(list)
    for d, part, mask in brute_masks(rows):
        parts[part].append((d, mask))
    want = Counter()
    for part, own in parts.items():
        total = Counter()
        facts = {}
        for order in permutations(range(5)):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[1] >> f & 1]
                left = [x for x in left if not x[1] >> f & 1]
                total[f] += len(gone)
                fails = sum(m >> f & 1 for _, m in own)
                facts[order, step] = (f, len(left), len(gone), fails - len(gone), sum(m == 1 << f for _, m in own), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone))
        for (order, step), (f, *numbers) in facts.items():
            want[(part, "".join("ABCDE"[k] for k in order), step, *numbers, total[f])] += 1
    assert Counter(map(tuple, filter_audit.audit(docs.drop("part"), frame).collect())) == want
    assert filter_audit.audit(docs.drop("part").limit(0), frame).count() == 0


def test_survivors_are_subset_sums():
    counts = np.random.default_rng(1).integers(0, 9, (2, 16))
    left = filter_audit.survivors(counts)
    for subset in range(16):
        assert left[:, subset].tolist() == sum(counts[:, m] for m in range(16) if m & subset == 0).tolist()


@pytest.mark.parametrize(("tile", "chunk", "light", "size"), [(128, 2048, 6, 1 << 20), (2, 40, 2, 64)])
def test_source_audit(docs, rows, monkeypatch, tile, chunk, light, size):
    """With small tiles, chunks and slices, every path does a part of the sums."""
    monkeypatch.setattr(source_audit, "LIGHT", light)
    monkeypatch.setattr(source_audit, "SLICE_BYTES", size)
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    n, in_docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, t, lang, source, _ in rows:
        found = term.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        key = (lang or "", source or "")
        groups.add(key)
        n[key].update(found)
        in_docs[key[0]].update(set(found))
    want = Counter()
    for lang in {g for g, _ in groups}:
        kept = {t for t, k in in_docs[lang].items() if k >= 3}
        own = {s: n[lang, s] for g, s in groups if g == lang}
        total = {s: sum(c[t] for t in kept) for s, c in own.items()}
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (total[s] + len(kept)) for t in kept} for s, c in own.items()}
        q = {t: 1 + 10**9 * (sum(c[t] for c in own.values()) + 1) // (sum(total.values()) + len(kept)) for t in kept}
        for s in own:
            pairs = sorted((-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in own if o != s)
            terms = sorted((-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if own[s][t] and p[s][t] > q[t])[:200]
            for part, found in (("pair", pairs), ("term", terms)):
                want.update((lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1))
    found = source_audit.divergence(docs.drop("part", "rank"), tile=tile, chunk=chunk).select("lang", "source", "part", "item", "value", "rank")
    assert Counter(map(tuple, found.collect())) == want
    assert sum(r[2] == "pair" for r in want) > 30 and sum(r[2] == "term" for r in want) > 30
    assert source_audit.divergence(docs.limit(0)).count() == 0


def brute_removed(rows, window):
    first, order = {}, lambda d: (d is not None, d or 0)
    split = [(d, WORD.findall(t or "")) for d, t, *_ in rows]
    for d, w in split:
        for i in range(len(w) - window + 1):
            place = (order(d), i)
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, place), place)
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (order(d), i):
                gone.update(range(i, i + window))
        yield d, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)


@pytest.mark.parametrize(("window", "hot", "most", "size", "shard"), [(20, 2000, 10**6, 1 << 20, 1 << 18), (20, 3, 0, 100, 300), (5, 2, 10**6, 60, 100), (3, 2000, 0, 1 << 20, 1 << 18)])
def test_substring_dedup(docs, rows, monkeypatch, window, hot, most, size, shard):
    """Hot anchors, joins instead of broadcasts, slices and small shards change nothing."""
    for name in ("BROADCAST_ANCHORS", "BROADCAST_TEXTS", "BROADCAST_SPANS"):
        monkeypatch.setattr(substrings, name, most)
    monkeypatch.setattr(substrings, "SHARD_WORDS", shard)
    pieces, passes = substrings._pieces, substrings.passes
    monkeypatch.setattr(substrings, "_pieces", lambda texts, window, hashed=True: pieces(texts, window, size, hashed=hashed))
    if size < 1 << 20:
        monkeypatch.setattr(substrings, "passes", lambda batches: passes(batches, size=1))
        monkeypatch.setattr(substrings, "SLICE_BYTES", size)
    found = substrings.dedup_substrings(docs, window=window, hot=hot)
    assert found.columns == [c for c in docs.columns if c != "n_words"] + ["n_words", "n_removed"]
    want = Counter(brute_removed(rows, window))
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["text"] or "") for r in found.collect()) == want
    assert sum(k > 0 for _, _, k, _ in want) > 20


def test_substring_dedup_leaves_null_and_empty(spark, docs):
    kept = substrings.dedup_substrings(docs.where("text IS NULL OR doc_id = 301")).collect()
    assert {(r["doc_id"], r["text"], r["n_words"], r["mask"]) for r in kept} == {(2, None, 0, "mine"), (303, None, 0, "mine"), (301, "", 0, "mine")}
    assert substrings.dedup_substrings(docs.limit(0)).count() == 0


def test_substring_digest(docs, rows):
    want = Counter((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute_removed(rows, 20))
    assert Counter(map(tuple, substrings.digest(substrings.dedup_substrings(docs)).collect())) == want


def test_words_of_equal_anchor_hash_are_told_apart(spark):
    """Words that the anchors' hash takes for equal ones: only the words themselves count."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    assert substrings.span_hashes(*(np.frombuffer(a.encode(), np.uint8), np.array([0]), np.array([1024]))) == substrings.span_hashes(*(np.frombuffer(b.encode(), np.uint8), np.array([0]), np.array([1024])))
    rest = " x y z" * 12
    frame = spark.createDataFrame([(1, a + rest), (2, b + rest), (3, a + rest + " end")], "doc_id bigint, text string")
    found = {r["doc_id"]: r["n_removed"] for r in substrings.dedup_substrings(frame).collect()}
    want = {d: k for d, _, k, _ in brute_removed([(r["doc_id"], r["text"]) for r in frame.collect()], 20)}
    assert found == want and found[2] < found[3]


def test_wavelet_ranks_and_backward_search():
    r = np.random.default_rng(3)
    text = np.append(r.integers(0, 6, 700), 0)
    tree = WaveletTree(text)
    places, symbols = r.integers(0, 702, 400), r.integers(0, 7, 400)
    assert tree.rank(symbols, (places,))[0].tolist() == [int((text[:p] == s).sum()) for p, s in zip(places, symbols)]
    index = FMIndex(text, 8)
    ends = np.arange(8, 700)
    length, low, high = index.matching_statistics(ends, 8)
    stream = text.tolist()
    for e, n, a, b in zip(ends.tolist(), length.tolist(), low.tolist(), high.tolist()):
        times = [sum(0 not in stream[e - k : e] and stream[i : i + k] == stream[e - k : e] for i in range(len(stream) - k + 1)) for k in range(1, 9)]
        assert n == sum(np.cumprod([t > 1 for t in times])) and (n == 0 or b - a == times[n - 1])
        assert all(stream[i : i + n] == stream[e - n : e] for i in index.order[a:b].tolist()) or n == 0


def test_repeated_windows_of_a_shard():
    table = pa.table({"doc_id": [1, 2, 3], "at": [0, 5, 0], "h": [7, 7, 8], "words": ["a b c d", "x a b c", "a b c d e"]})
    assert [x.tolist() for x in substrings.repeated_windows(table, 3)] == [[], [1], []]
