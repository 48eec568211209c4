"""Every corpus operator against a brute-force version, with the awkward cases: nulls, empty
and long texts, ties, repeated rows, empty tables, columns whose names clash."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tidemark.llm import common, decontaminate, language, linededup, media, packing, preference, quality, sharding, simhash, toxicity
from tidemark.llm.queries import bpe_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def sentence(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    base = [sentence(r, r.randint(1, 120)) for _ in range(60)]
    near = [base[3] + " " + sentence(r, 1), base[3].replace(" ", "  "), base[4].upper()]
    line = "This line of more than forty characters repeats."
    lined = [f"{sentence(r, 5)}\n  {line.upper() if k % 2 else line}\t\n{sentence(r, 9)}" for k in range(6)]
    odd = [None, "", " ", "\n\n", "é" * 30, "日本語 テキスト", "\x00 zero", "a" * 70_000, sentence(r, 20_000), base[0], base[0], base[0]]
    return base + near + lined + odd


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k if k != 2 else None, t, None if k % 9 == 0 else "en", "s", 1) for k, t in enumerate(texts)]
    rows += [rows[5], rows[5]]  # repeated rows
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clash(df, *names):
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("mine") for n in names}).withColumn("extra col", F.lit(1))


# 1 -----------------------------------------------------------------------------------


def brute_contamination(text, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    own = word.findall(lower(text or ""))
    hit, found = set(), set()
    for item, t in items:
        w = word.findall(lower(t or ""))
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            for j in range(len(own) - size + 1):
                if own[j : j + size] == w[i : i + size]:
                    hit.update(range(j, j + size))
                    if item is not None:
                        found.add(str(item))
    return len(own), len(hit), sorted(found)


@pytest.fixture(scope="module")
def benchmark(spark, texts):
    long = texts[7] + " " + texts[8]
    rows = [(1, texts[10][:90]), (2, texts[11]), (10, texts[11]), (3, "Ab!cd"), (4, None), (5, ""), (None, texts[12]), (6, long), (6, texts[13]), (2, texts[11])]
    rows.append((7, " ".join(texts[14].split()[:12]).upper()))
    return spark.createDataFrame(rows, "item_id bigint, text string"), rows


@pytest.mark.parametrize("block", [1 << 24, 300])
def test_contamination_equals_brute_force(docs, benchmark, block):
    table, rows = benchmark
    found = decontaminate.contamination(clash(docs, "n_hit", "items"), table, block_bytes=block).collect()
    assert len(found) == docs.count()
    for r in found:
        assert (r["n_words"], r["n_hit"], r["items"]) == brute_contamination(r["text"], rows), r["doc_id"]
        assert r["extra col"] == 1


def test_contamination_longest_match(spark):
    bench = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(30)))], "item_id bigint, text string")
    text = "x y " + " ".join(f"w{k}" for k in range(3, 20)) + " z " + " ".join(f"w{k}" for k in range(0, 12))
    row = decontaminate.contamination(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), bench).first()
    assert (row["n_hit"], row["longest_match"], row["longest_at"]) == (29, 17, 2)


def doubled(times):
    """Two different words that sums of bytes times powers, modulo 2^64, cannot tell apart."""
    a, b = "a", "b"
    for _ in range(times):
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("times", [3, 10, 11, 12])
def test_contamination_compares_words_themselves(spark, times):
    a, b = doubled(times)
    docs = spark.createDataFrame([(1, f"x {a} y"), (2, f"x {b} y"), (3, f"{a} {b}")], "doc_id bigint, text string")
    for items, hit in (([(1, a)], {1: 1, 2: 0, 3: 1}), ([(1, a), (2, b)], {1: 1, 2: 1, 3: 2}), ([(1, f"{b} y")], {1: 0, 2: 2, 3: 0})):
        found = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id bigint, text string"))
        assert {r["doc_id"]: r["n_hit"] for r in found.collect()} == hit


@pytest.mark.parametrize("length", [1, 7, 8, 9, 15, 16, 17, 31, 64, 65, 200])
def test_words_at_the_edge_of_a_slice_have_one_number(length):
    """A word has the same number alone, at its text's end and before other text."""
    word = ("q" * length).encode()
    words = decontaminate.Vocabulary([b"r" * length, word, word + b"q"])
    for text, want in ((word, [1]), (b"abc " + word, [-1, 1]), (word + b" abc " + word + b"Q ", [1, -1, 2]), (b"x" * 16 + b" " + word + b" ", [0 if (b"x" * 16) == b"r" * length else -1, 1])):
        for size in (16, 1 << 20):
            assert decontaminate.numbered(pa.array([text.decode()]), words, size)[0].tolist() == want


def test_long_hash_is_the_hash_of_a_span(monkeypatch):
    data = np.random.default_rng(1).integers(0, 256, 3000).astype(np.uint8)
    want = common.span_hashes(data, np.array([0]), np.array([3000]))[0]
    assert common.long_hash(data) == want
    monkeypatch.setattr(common, "PASS_BYTES", 700)
    assert common.long_hash(data) == want


def test_contamination_empty_tables(empty, docs, benchmark, spark):
    assert decontaminate.contamination(empty, benchmark[0]).count() == 0
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.decontaminate(docs, none).count() == docs.count()


def test_suffix_array_orders_suffixes():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 300):
        text = r.integers(0, 3, n)
        order = decontaminate.suffix_array(text)
        assert order.tolist() == sorted(range(n), key=lambda i: text[i:].tolist())


# 2 -----------------------------------------------------------------------------------


def test_text_media_round_trip(docs):
    for r in media.text_media(docs).collect():
        kept = media.decode(bytes(r["media"])).tobytes()
        assert r["payload_sha256"] == hashlib.sha256(kept).hexdigest() and r["media_sha256"] == hashlib.sha256(bytes(r["media"])).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(kept[-64:]) and r["payload_bytes"] == len(kept) > 0 and len(kept) % 64 == 0
        assert kept[r["n_bytes"] :].strip(b"\0") == b"" and len(kept) - r["n_bytes"] <= 64
    by_id = {r["doc_id"]: r["payload_sha256"] for r in media.text_media(docs).collect()}
    assert len(by_id) > 60


def brute_resize(image, rows, columns):
    h, w = image.shape[:2]
    out = np.zeros((rows, columns, *image.shape[2:]))
    for i in range(rows):
        for j in range(columns):
            y0, y1, x0, x1 = i * h / rows, (i + 1) * h / rows, j * w / columns, (j + 1) * w / columns
            wy = np.array([max(0, min(y1, k + 1) - max(y0, k)) for k in range(h)])
            wx = np.array([max(0, min(x1, k + 1) - max(x0, k)) for k in range(w)])
            out[i, j] = np.tensordot(wx, np.tensordot(wy, image, (0, 0)), (0, 0)) / (wy.sum() * wx.sum())
    return out


@pytest.mark.parametrize("shape", [(1, 64), (7, 5), (40, 64), (33, 20, 3)])
def test_area_resize_equals_brute_force(shape, monkeypatch):
    monkeypatch.setattr(media, "_STRIP", 200)
    image = np.random.default_rng(0).integers(0, 256, shape).astype(np.uint8)
    for rows, columns in ((8, 9), (3, 3), (16, 16)):
        assert np.allclose(media.area_resize(image, rows, columns), brute_resize(image, rows, columns))


def test_image_formats(spark):
    gray = np.random.default_rng(2).integers(0, 256, (5, 7)).astype(np.uint8)
    colour = np.random.default_rng(3).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    assert (media.decode(media.encode_pgm(gray)) == gray).all()
    assert (media.decode(media.encode_bmp(gray)) == gray).all() and (media.decode(media.encode_bmp(colour)) == colour).all()
    assert (media.decode(b"P6\n# note\n7 5\n255\n" + colour.tobytes()) == colour).all()
    assert (media.decode(b"P2\n7 5\n255\n" + b" ".join(b"%d" % v for v in gray.ravel())) == gray).all()
    bits = gray > 100
    assert (media.decode(b"P4 7 5\n" + np.packbits(bits, axis=1).tobytes()) == bits).all()
    assert (media.decode(b"P1 7 5 " + b"".join(b"%d" % v for v in bits.ravel())) == bits).all()
    wide = gray.astype(np.uint16) * 200
    assert (media.decode(b"P5 7 5 60000\n" + wide.astype(">u2").tobytes()) == wide).all()
    rows = spark.createDataFrame([(1, bytearray(media.encode_bmp(colour))), (2, bytearray(b"junk")), (3, None), (4, bytearray(b"P5 9 9 255\nshort"))], "id int, image binary")
    found = {r["id"]: r for r in media.media_tiles(clash(rows, "dhash")).collect()}
    import io

    assert np.load(io.BytesIO(bytes(found[1]["npy"]))).shape == (16, 16, 3) and len(found[1]["dhash"]) == 16
    assert all(found[k]["dhash"] is None and found[k]["npy"] is None for k in (2, 3, 4))
    hostile = [b"P5 99999999999 99999999999\n255\n", b"P4 9999999999999999999999 3\n", b"P2 2 1 255 1 99999999999999999999999", b"P2 2 1 9 1 10", b"P5 2 1 9\n\x01\x0a",
               b"P1 100000 100000 1", b"BM" + b"\xff" * 60, b"P6", b"", b"P5 1 1 99999 0", b"P2 2 1 9 -1 3"]
    bad = media.media_tiles(spark.createDataFrame([(bytearray(x),) for x in hostile], "image binary")).collect()
    assert len(bad) == len(hostile) and all(r["npy"] is None and r["rows"] is None for r in bad)
    assert media.media_tiles(rows.limit(0)).count() == 0


# 3, 7, 10 ----------------------------------------------------------------------------


def labelled(spark, bad, good, label):
    r = random.Random(1)
    texts = [(bad(r), 0 if label == "quality" else 1) if k % 3 == 0 else (good(r), 1 if label == "quality" else 0) for k in range(240)]
    docs = spark.createDataFrame([(k, t, "x") for k, (t, _) in enumerate(texts)], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(k, y) for k, (_, y) in enumerate(texts)] + [(None, 1), (999, None), (998, 0)], f"doc_id bigint, {label} int")
    return docs, labels, dict(enumerate(y for _, y in texts))


def accuracy(scored, truth, threshold):
    rows = scored.collect()
    assert all(0 <= r["score"] <= 1 for r in rows)
    return np.mean([(r["score"] >= threshold) == truth[r["doc_id"]] for r in rows])


def test_quality_learns(spark, docs, empty):
    from pyspark.sql import functions as F

    own, labels, truth = labelled(spark, lambda r: re.sub(" ", " !!&& ", sentence(r, 30).upper()), lambda r: sentence(r, 30), "quality")
    model = quality.fit(own, labels, F.col("doc_id") % 5 != 0)
    assert accuracy(quality.score(own.where("doc_id % 5 = 0"), model), truth, quality.THRESHOLD) > 0.95
    everything = quality.score(docs, model).collect()
    assert len(everything) == docs.count() and all(0 <= r["score"] <= 1 for r in everything)
    assert quality.score(empty, model).count() == 0
    none = quality.fit(own, labels.limit(0), F.lit(True))
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}


def test_quality_scores_equal_the_network(spark):
    """The folded table gives what averaging vectors and a softmax over them would."""
    import pyarrow as pa

    sample = [(k % 2, ("good words here " if k % 2 else "BAD!! words ") * 3) for k in range(20)]
    model = quality.train(sample, epochs=3, dim=4, bits=12)
    buckets = np.concatenate([b[a:e] for b, (a,), (e,) in quality.features(pa.array(["good BAD!! words"]), 12)])
    want = 1 / (1 + np.exp(-(model.table[buckets].mean() + model.bias)))
    assert np.allclose(model.scores(pa.array(["good BAD!! words"])), want)


def test_language(spark, docs, empty):
    from pyspark.sql import functions as F

    r = random.Random(3)
    kinds = {"en": "the and of with house ", "de": "der und nicht haus mit ", "es": "el de casa con que ", "fr": "le maison avec les des "}
    rows = []
    for k in range(200):
        lang = list(kinds)[k % 4]
        words = kinds[lang].split()
        rows.append((k, " ".join(r.choice(words) for _ in range(12)), None if k % 25 == 0 else lang))
    own = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.fit(own, F.col("doc_id") % 4 != 5)
    assert model.families == ["germanic", "romance"] and len(model.pairs) == 2
    truth = {k: list(kinds)[k % 4] for k in range(200)}
    found = language.identify(own, model).collect()
    assert np.mean([x["lang_pred"] == truth[x["doc_id"]] for x in found]) > 0.97
    odd = {x["text"]: (x["lang_pred"], x["score"]) for x in language.identify(clash(docs, "score"), model).collect()}
    assert odd[None] == odd[""] == odd["\n\n"] == ("und", 1.0) and odd["日本語 テキスト"][0] in kinds
    assert language.identify(empty, model).count() == 0
    assert {x["lang_pred"] for x in language.identify(docs, language.train([])).collect()} == {"und"}
    assert {x["lang_pred"] for x in language.identify(docs, language.train([("en", "one two")])).collect()} == {"und", "en"}


def test_toxicity_learns(spark, docs, empty):
    from pyspark.sql import functions as F

    def rude(r):
        words = sentence(r, 60).split()
        for _ in range(4):
            words.insert(r.randrange(len(words)), r.choice(["worthlessness", "disgustingly", "stupidheaded"]))
        return " ".join(words)

    own, labels, truth = labelled(spark, rude, lambda r: sentence(r, 60), "toxic")
    model = toxicity.fit(own, labels, F.col("doc_id") % 3 != 1)
    assert accuracy(toxicity.score(own.where("doc_id % 3 = 1"), model), truth, toxicity.THRESHOLD) > 0.85
    everything = toxicity.score(docs, model).collect()
    assert len(everything) == docs.count() and all(0 <= r["score"] <= 1 for r in everything)
    assert toxicity.score(empty, model).count() == 0
    assert all(r["score"] < 1e-9 for r in toxicity.score(docs, toxicity.train([(0, "a")])).collect())


def test_toxicity_windows_cover_the_text():
    import pyarrow as pa

    texts = ["", None, "One two", sentence(random.Random(2), 500), "x" * 1000 + " y", "a\tb\nC"]
    body, spans, row = toxicity.windows(pa.array(texts))
    for k, t in enumerate(texts):
        own = [body[a : a + n].decode() for a, n in spans[row == k].astype(int).tolist()]
        assert "".join(w[:-1] for w in own) == ("" if not t else " " + re.sub(r"\s", " ", t.lower()))


# 4 -----------------------------------------------------------------------------------


def test_packing(docs, texts, empty, spark):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(bpe_path())
    found = packing.packed(clash(docs, "piece", "sequence_id", "length"), bpe_path()).toPandas()
    ids = {k if k != 2 else None: np.array(exact.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4") for k, t in enumerate(texts)}
    groups = found.assign(doc_id=found.doc_id.fillna(-1).astype(int)).groupby("doc_id")
    assert len(groups) == len(texts)
    for doc, g in groups:
        own = ids[None if doc == -1 else doc]
        times = 3 if doc == 5 else 1
        assert g.length.sum() == len(own) * times
        for r in g.itertuples():
            assert r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
            assert r.length <= 1024 and (r.piece == 0 or r.length == 1024) and (len(own) > 1024 or r.piece == 0)
    for _, g in found.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == (g.length.cumsum() - g.length).tolist() and g.length.sum() <= 1024
    assert packing.packed(empty, bpe_path()).count() == 0


def test_tokenizer_equals_the_library(monkeypatch):
    """Special tokens, long runs and random Unicode have the ids of ``tokenizers``."""
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(bpe_path())
    monkeypatch.setattr(packing, "LONG_RUN", 50)
    packing.tokenizer.cache_clear()
    encode = packing.tokenizer(bpe_path())
    packing.tokenizer.cache_clear()
    assert encode("x <|endoftext|> y").tolist() == [87, 220, 50256, 331]
    r = random.Random(8)
    kinds = ["a", "Bc", " ", "  ", "\n", "\t", "é", "日", "1", "!", "'s", "<|endoftext|>", "\x00", "\x1c", "\x85", "\u200b", "\u3000", " " * 60, "\n" * 51 + " ", "z" * 300]
    texts = ["".join(r.choice([*kinds, chr(r.randrange(0x20, 0xD800)), chr(r.randrange(0xE000, 0x110000))]) for _ in range(r.randint(0, 25))) for _ in range(1500)]
    for text in texts:
        assert encode(text).tolist() == exact.encode(text, add_special_tokens=False).ids, repr(text)
    packing.LONG_RUN = 100_000
    long = "a" + " " * 1_200_000 + "b " + "x" * 200_000
    assert packing.tokenizer(bpe_path())(long).tolist() == exact.encode(long, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(30))
def test_pack_plan(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 33, 64])
    counts = {x: r.choice([1, 2, 3, 50]) for x in r.sample(range(1, capacity), r.randint(0, capacity - 1))}
    plan = packing.pack(dict(counts), capacity)
    filled = Counter()
    for length, n in counts.items():
        slots = plan.slots[length]
        for rank in range(n):
            before, first, _ = max(s for s in slots if s[0] <= rank)
            filled[first + rank - before] += length
    assert len(filled) == plan.sequences and (not filled or max(filled.values()) <= capacity)
    large = [x for x, n in counts.items() for _ in range(n) if 3 * x > capacity]
    assert plan.sequences >= -(-sum(filled.values()) // capacity) and plan.sequences >= sum(2 * x > capacity for x in large)


@pytest.mark.parametrize("size", [40, 300, 5000])
def test_scores_of_slices_are_those_of_the_whole(monkeypatch, size):
    """Quality, language and toxicity of long texts do not depend on where slices end."""
    r = random.Random(4)
    texts = [sentence(r, 400) + "\n\n  " + "x" * 900 + " same same " + sentence(r, 30), " " * 700 + sentence(r, 200), "é日" * 400, "y" * 3000, "a b", None, ""]
    rows = pa.array(texts, pa.string())
    sample = [(k % 2, sentence(r, 40) + (" worthlessness" if k % 2 else "")) for k in range(80)]
    grades, tongues, tox = quality.train(sample), language.train([(("en", "de", "fr")[k % 3], sentence(r, 40)) for k in range(30)]), toxicity.train(sample)
    compressors = tox.pair.compressors()
    run = lambda: (grades.scores(rows), tongues.predict(rows), tox.scores(rows, compressors), [toxicity.windows(p, toxicity.WINDOW, f, e)[1][:, 1].tolist() for _, p, f, e in toxicity.slices(rows.slice(0, 1))])
    whole = run()
    for module in (common, toxicity):
        monkeypatch.setattr(module, "SLICE_BYTES", size)
    parts = run()
    assert np.allclose(whole[0], parts[0], atol=1e-9) and whole[1][0] == parts[1][0] and np.allclose(whole[1][1], parts[1][1], atol=1e-9)
    assert np.array_equal(whole[2], parts[2]) and sum(whole[3], []) == sum(parts[3], [])
    assert size > 4000 or len(parts[3]) > 1


# 5 -----------------------------------------------------------------------------------


def test_sharding(docs, empty, tmp_path, spark):
    found = sharding.assigned(clash(docs, "shard", "size", "key", "row", "part"), shards=4).toPandas()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, None if r["text"] is None else zlib.crc32(r["text"].encode())) for r in docs.collect())
    got = Counter((None if np.isnan(d) else int(d), int(n), None if np.isnan(c) else int(c)) for d, n, c in zip(found.doc_id, found["size"], found.text_crc32))
    assert got == want
    assert len(found) == docs.count() and set(found.law) == {"bytes"} and found.grown_shard.isna().all()
    for _, g in found.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert sharding.assigned(empty).count() == 0
    sharding.write_shards(clash(docs, "shard"), str(tmp_path / "shards"), shards=4)
    back = spark.read.parquet(str(tmp_path / "shards"))
    rows = lambda d: Counter(map(tuple, d.select(docs.columns).collect()))
    assert rows(back) == rows(docs) and "extra col" in back.columns and back.select("shard").distinct().count() <= 4


@pytest.mark.parametrize("hot", [None, "", "ab"])
def test_sharding_numbers_hot_short_texts_in_parts(spark, hot, monkeypatch):
    monkeypatch.setattr(sharding, "UNIT_ROWS", 100)
    r = random.Random(9)
    rows = [(k, sentence(r, 40)) for k in range(400)] + [(k, hot) for k in range(400, 1600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    found = sharding.assigned(docs).toPandas()
    for _, g in found.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert found[found.doc_id >= 400].shard.nunique() == 1 and len(found) == 1600
    kept = sharding.written(sharding.sized(docs))
    bounds, splits = sharding.splitting(kept, 16)
    placed = sharding.with_unit(kept, bounds, splits)
    parts = sharding.numbered(placed, sharding.units_of(placed, splits, 16)).groupBy("range", "piece", "part").count()
    assert parts.agg({"count": "max"}).first()[0] < 200


@pytest.mark.parametrize(("share", "most"), [(0.4, 1), (0.67, 1), (0.95, 1), (1.1, 2), (2.5, 3)])
def test_copies_share_a_shard_that_can_hold_them(spark, share, most):
    """Copies of one text, of a ``share`` of an equal part of all bytes."""
    r = random.Random(3)
    rest = [sentence(r, r.randint(20, 60)) for _ in range(1500)]
    text = sentence(r, 12)
    bytes_ = sum(len(t.encode()) + 1 for t in rest)
    copies = round(share * bytes_ / (16 - share) / (len(text.encode()) + 1))
    rows = [(k, t) for k, t in enumerate([*rest, *[text] * copies])]
    found = sharding.assigned(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).toPandas()
    assert found[found.doc_id >= 1500].shard.nunique() == most
    loads = found.groupby("shard")["size"].sum()
    assert len(loads) == 16 and loads.max() / loads.mean() < 1.06 and loads.min() / loads.mean() > 0.94


def test_sharding_is_even_with_a_hot_text(spark):
    r = random.Random(9)
    rows = [(k, sentence(r, r.randint(1, 60))) for k in range(1500)] + [(k, "the same text again and again") for k in range(1500, 3000)]
    found = sharding.assigned(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).toPandas()
    size = found.groupby("shard")["size"].sum()
    assert len(size) == 16 and size.max() / size.mean() < 1.05 and size.min() / size.mean() > 0.95
    texts = dict(rows)
    parted = found.assign(t=found.doc_id.map(texts)).groupby("t").shard.nunique()
    assert set(parted[parted > 1].index) <= {"the same text again and again"}


# 6 -----------------------------------------------------------------------------------


def test_preference(spark):
    turns = [
        (0, 0, "user", "hi <|x"), (0, 1, "assistant", "yes"), (0, 2, "user", "and?"), (0, 3, "assistant", "more"), (0, 4, "user", "bye"),
        (1, 0, "user", "other"), (1, 1, "assistant", "more"), (2, 0, None, None), (3, 0, "user", "a"), (3, 0, "user", "a"), (None, 0, "user", "lost"),
    ]
    rows = {r["pair_id"]: r for r in preference.format_pairs(preference.reply_pairs(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string"))).collect()}
    assert set(rows) == {0, 1, 2, 3}
    # Conversation 0's last reply equals its neighbour's: everything is prompt.
    assert rows[0]["prompt_turns"] == 4 and rows[0]["chosen"] == [] == rows[0]["rejected"]
    assert rows[0]["prompt"].startswith("<|im_start|>user\nhi < |x<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n")
    assert rows[2]["prompt"] == "<|im_start|>unknown\n<|im_end|>\n" and rows[3]["prompt_turns"] == 2
    chosen = [(0, "user", "q"), (1, "assistant", "good"), (2, "user", "r")]
    rejected = [(0, "user", "q"), (1, "assistant", "bad")]
    pair = spark.createDataFrame([(1, [c[1:] for c in chosen], [c[1:] for c in rejected])], "pair_id bigint, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    (r,) = preference.format_pairs(pair).collect()
    assert [(x["text"], x["train"]) for x in r["chosen"]] == [("<|im_start|>assistant\n", False), ("good<|im_end|>\n", True), ("<|im_start|>user\n", False), ("r<|im_end|>\n", False)]
    assert r["prompt_turns"] == 1 and [x["train"] for x in r["rejected"]] == [False, True]
    assert preference.digest(preference.format_pairs(pair)).first()["chosen_mask"] == "0:22,1:15,0:17,0:12"
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert preference.format_pairs(preference.reply_pairs(none)).count() == 0


# 8 -----------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    bits = np.array([[xxhash.xxh64_intdigest(g.encode(), 42) >> k & 1 for k in range(64)] for g in grams]) if grams else np.zeros((1, 64))
    return sum(1 << k for k in range(64) if 2 * bits[:, k].sum() > len(bits))


def roots(values, radius=4):
    root = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius and root[i] != root[j]:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return root


def test_simhash(docs, empty):
    rows = simhash.near_duplicates(docs).collect()
    source = docs.select("doc_id", "text").collect()
    want = Counter()
    prints = [brute_fingerprint(r["text"]) for r in source]
    root = roots(prints)
    for k, r in enumerate(source):
        ids = [source[i]["doc_id"] for i in range(len(source)) if root[i] == root[k] and source[i]["doc_id"] is not None]
        want[r["doc_id"], f"{prints[k]:016x}", min(ids, default=None)] += 1
    assert Counter(map(tuple, rows)) == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root))
    assert simhash.drop_near_duplicates(empty).count() == 0


@pytest.mark.parametrize("tile", [3, 20, 4096])
def test_simhash_links_in_tiles(spark, tile):
    r = np.random.default_rng(4)
    centre = r.integers(0, 1 << 62, 30).astype(np.uint64)
    values = [int(c) for c in centre]
    for c in centre[:6]:
        for _ in range(40):
            v = int(c)
            for b in r.choice(64, r.integers(1, 7), replace=False):
                v ^= 1 << int(b)
            values.append(v)
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    found = simhash.components(simhash.links(simhash.tiled(nodes, simhash.block_masks(len(values)), 4, tile), 4)).collect()
    label = {v: v for v in signed} | {x["node"]: x["root"] for x in found}
    want = roots(values)
    groups = lambda keys: {frozenset(i for i in range(len(keys)) if keys[i] == k) for k in keys}
    assert groups([label[v] for v in signed]) == groups(want)


def test_block_masks_keep_every_close_pair():
    r = random.Random(0)
    for count in (10, 10**7, 10**10, 10**14):
        masks = simhash.block_masks(count)
        for _ in range(300):
            a = r.getrandbits(64)
            b = a
            for k in r.sample(range(64), 4):
                b ^= 1 << k
            assert any((a & m % (1 << 64)) == (b & m % (1 << 64)) for m in masks)


# 9 -----------------------------------------------------------------------------------


def brute_lines(rows, min_chars=40, min_docs=5):
    key = lambda x: lower(x.strip(" \t\n\x0b\f\r"))
    holders = {}
    for i, (doc, text) in enumerate(rows):
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars:
                holders.setdefault(k, []).append(doc)
    last = {k: max((d for d in v if d is not None), default=None) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("most", [500_000, 0])
def test_line_dedup(docs, empty, monkeypatch, most):
    monkeypatch.setattr(linededup, "BROADCAST_ROWS", most)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    found = linededup.dedup_lines(clash(docs, "n_lines")).collect()
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in found) == Counter(brute_lines(rows))
    assert sum(r["n_dropped"] for r in found) == 5
    assert linededup.dedup_lines(empty).count() == 0
