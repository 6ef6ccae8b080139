"""The training-data operators against brute force, exact round trips and held-out accuracy."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandframe.llm import _tokens, bpe, chat, fingerprint, jaccard_join, langid, mixing, quality, queries, sharding, toxicity, url_filter
from strandframe.llm._graph import components

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
ODD = ["", None, " \n\t ", "x", "One two  three", "é" * 30, "日本語 テキスト " * 40, "a" * 5000, "\x0b\x0cw\r\nw\x85\xa0w", "<|endoftext|> mid <|endoftext|>"]


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "Zeta"]) + str(rng.randrange(400)) for _ in range(n))


def some_docs(n=60, seed=1):
    """Texts with exact and near copies, repeated rows, nulls in every column."""
    rng = random.Random(seed)
    texts = [*ODD]
    base = words(rng, 120)
    for k in range(n):
        if k % 3 == 0:
            w = base.split()
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = "new" + str(rng.randrange(9**6))
            texts.append(" ".join(w))
        elif k % 3 == 1:
            texts.append(rng.choice(texts))
        else:
            texts.append(words(rng, rng.randrange(1, 200)) + "\n" + words(rng, 12) + "\n!")
    rows = [(i * 7 % 1009, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3", None]), len(t or "")) for i, t in enumerate(texts)]
    return rows + [(None, "null id text of six words", None, None, None), (None, None, None, None, None), rows[15], rows[15]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(some_docs(), DOCS).repartition(3).cache()


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    import pyarrow as pa

    rng = random.Random(2)
    texts = ["".join(rng.choice("ab \n\té") for _ in range(rng.randrange(0, 90))) for _ in range(50)] + ["", "x" * 300, " "]
    data, offsets = _tokens.buffers(pa.array(texts))
    whole, first = _tokens.word_hashes(data, offsets, fold=True)
    assert [int(n) for n in np.diff(first)] == [len(t.encode().split()) for t in texts]
    named = collections.defaultdict(set)
    for h, w in zip(whole.tolist(), (w for t in texts for w in t.encode().split())):
        named[w].add(h)
    assert all(len(v) == 1 for v in named.values()) and len({min(v) for v in named.values()}) == len(named)
    monkeypatch.setattr(_tokens, "BLOCK", 64)
    assert (_tokens.word_hashes(data, offsets, fold=True)[0] == whole).all()


# -- 1: BPE


def test_bpe_equals_the_library(spark, docs):
    from tokenizers import Tokenizer

    path = queries.bpe_vocabulary()
    library = Tokenizer.from_file(path)
    rng = random.Random(5)
    wild = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x3000), rng.randrange(0x10000, 0x20000), 32, 10])) for _ in range(rng.randrange(80))) for _ in range(300)]
    texts = [t or "" for t in ODD] + wild + ["z" * 127, "z" * 128, "z" * 129, "ab" * 400, " " * 700]
    codec = bpe.ByteBpe(open(path).read())
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert [codec.encode(t) for t in texts] == want
    broken = [[rng.randrange(50257) for _ in range(7)] for _ in range(300)]
    assert [codec.decode(x) for x in broken] == [library.decode(x, skip_special_tokens=False) for x in broken]
    flat = np.array([i for x in broken for i in x])
    assert codec.decode_rows(flat, np.arange(0, len(flat) + 1, 7)).to_pylist() == [codec.decode(x) for x in broken]
    for r in queries.bpe_digests(docs, path).join(docs.dropDuplicates(["doc_id"]).where("doc_id is not null"), "doc_id").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    steps = bpe.decode(bpe.encode(docs, path), path).select("doc_id", "ids", "decoded")
    assert collections.Counter(map(str, steps.collect())) == collections.Counter(map(str, bpe.round_trip(docs, path).select("doc_id", "ids", "decoded").collect()))
    assert bpe.round_trip(docs.withColumn("decoded", F.lit(1)).limit(0), path).columns[-2:] == ["ids", "decoded"]
    again = docs.select("doc_id", F.lit(9).alias("ids"), "text")
    assert bpe.encode(again, path).columns == ["doc_id", "text", "ids"] and bpe.encode(again.limit(0), path).count() == 0


def test_workers_keep_no_codec(spark, docs):
    """Runs of one session share Python workers; a worker that goes on to other work has no codec any more."""
    for _ in range(3):
        queries.bpe_digests(docs, queries.bpe_vocabulary()).collect()

    def held(batches):
        import gc
        import time

        import pyarrow as pa

        time.sleep(0.5)  # so that no worker takes all tasks
        for _ in batches:
            n = sum(isinstance(x, bpe.ByteBpe) for x in gc.get_objects())
            yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    assert {r.n for r in spark.range(16, numPartitions=16).mapInArrow(held, "n long").collect()} == {0}


# -- 2: fingerprints


def test_fingerprints(spark, docs):
    got = fingerprint.compare_with_edits(docs).collect()
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: r[1])
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = collections.Counter()
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        a, b, c = (fingerprint.digest(x.encode()) for x in (t, edited, after))
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, fingerprint.likeness(a, b), fingerprint.likeness(a, c)] += 1
    assert collections.Counter(map(tuple, got)) == want
    assert fingerprint.compare_with_edits(docs.limit(0)).count() == 0
    lone = fingerprint.compare_with_edits(docs.where("text like 'One%'")).first()
    assert lone.near_next == 1.0


def test_fingerprint_orders_texts():
    rng = random.Random(4)
    text, other = words(rng, 300), words(random.Random(9), 300).upper()
    a, b, c = (fingerprint.digest(x.encode()) for x in (text, text.replace("alpha1", "alpha2"), other))
    assert fingerprint.likeness(a, a) == 1 and fingerprint.likeness(a, b) > 0.8 > fingerprint.likeness(a, c) >= 0
    assert fingerprint.bucket_counts(b"abcdef").sum() == 2 * 6 and fingerprint.bucket_counts(b"abcd").sum() == 0


def plain_digest(data):
    """A digest by its description, a triplet at a time."""
    counts = [0] * 256
    padded = data + b"\0" * (5 - len(data)) if 0 < len(data) < 5 else data
    for i in range(len(padded) - 4):
        for (j, k), salt in zip([(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4)], fingerprint._SALTS.tolist()):
            x = fingerprint._FIRST[padded[i]] ^ fingerprint._SECOND[padded[i + j]] ^ salt
            counts[int(fingerprint._SPREAD[x]) ^ int(fingerprint._THIRD[padded[i + k]])] += 1
    at = sorted(counts)
    q = at[63], at[127], at[191]
    codes = "".join(format(sum(c > x for x in q), "02b") for c in counts)
    length = min(255, round(8 * np.log2(len(data) + 1)))
    ratios = [int(100 * x / q[2]) % 16 if q[2] else 0 for x in q[:2]]
    return f"{length:02x}{ratios[0]:x}{ratios[1]:x}{int(codes, 2):0128x}"


def plain_difference(a, b):
    score = abs(int(a[:2], 16) - int(b[:2], 16))
    score = score if score <= 1 else 6 * score
    for x, y in zip(a[2:4], b[2:4]):
        gap = abs(int(x, 16) - int(y, 16))
        score += min(gap, 16 - gap)
    pairs = [[int(format(int(d[4:], 16), "0512b")[i : i + 2], 2) for i in range(0, 512, 2)] for d in (a, b)]
    weigh = lambda x, y: [0, 1, 2, 6][abs(x - y)]
    apart = sum(map(weigh, *pairs))
    chance = sum(weigh(x, y) for x in pairs[0] for y in pairs[1]) / 256
    return min(640, score + (round(640 * apart / chance) if apart else 0))


def test_digests_by_their_description():
    rng = random.Random(31)
    texts = [b"", b"a", b"b", b"ab", b"abc", b"abcd", b"wxyz", b"abcde", bytes(7), *(bytes(rng.randrange(256) for _ in range(rng.randrange(400))) for _ in range(12)), words(rng, 200).encode()]
    digests = [fingerprint.digest(t) for t in texts]
    assert digests == [plain_digest(t) for t in texts]
    assert all(fingerprint.difference(a, b) == plain_difference(a, b) for a in digests for b in digests[:14])


def test_short_and_unrelated_texts_are_unlike():
    rng = random.Random(32)
    near = lambda a, b: fingerprint.likeness(fingerprint.digest(a), fingerprint.digest(b))
    short = [b"", b"a", b"b", b"ab", b"xy", b"abcd", b"wxyz", b"12345678"]
    assert all(near(x, x) == 1 for x in short) and len({fingerprint.digest(x) for x in short}) == len(short)
    assert near(b"abcd", b"wxyz") < 0.2 and near(b"", b"ab") < 0.2 and near(b"abcd", b"abcx") > near(b"abcd", b"wxyz")
    unlike = [near(rng.randbytes(2000), rng.randbytes(2000)) for _ in range(20)]
    assert max(unlike) < 0.2


# -- 3: n-gram join


def brute_components(rows, num=4, den=5):
    fold = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in rows:
        w = (text or "").encode().translate(fold).split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return collections.Counter((d, len(s), (least.get(top(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def test_join_against_all_pairs(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    got = jaccard_join.near_duplicates(docs.where("doc_id is not null"))
    assert collections.Counter(map(tuple, got.collect())) == brute_components(rows)
    everything = jaccard_join.near_duplicates(docs).where("doc_id is null")
    assert sorted(map(tuple, everything.collect()), key=str) == sorted([(None, 2, None), (None, 0, None)], key=str)
    assert jaccard_join.near_duplicates(docs.limit(0)).count() == 0


def test_join_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT_LEAST", 20)  # so that the frequent n-grams' path is taken
    rng = random.Random(8)
    base = words(rng, 60).split()
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"n{k}x{rng.randrange(99)}"
        rows.append((k, " ".join(w[: rng.choice([60, 60, 50])])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert collections.Counter(map(tuple, jaccard_join.near_duplicates(df).collect())) == brute_components(rows)
    kept = jaccard_join.one_of_each(df.withColumn("component_id", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "component_id"]
    assert kept.count() == len({c for _, _, c in brute_components(rows)})


def test_join_of_repeated_ids(spark):
    """Rows of one doc_id with different texts are documents of their own, whichever text comes first."""
    rng = random.Random(12)
    a, b, c = (words(rng, 60).split() for _ in range(3))
    more = lambda w, k: " ".join([*w[:-1], f"tail{k}"])
    rows = [(5, more(a, 0)), (5, more(b, 0)), (1, more(a, 1)), (2, more(b, 1)), (5, more(c, 0)), (9, more(c, 0)), (7, more(c, 0)), (7, more(c, 2)), (7, ""), (5, more(a, 0))]
    for order in (rows, rows[::-1], sorted(rows)):
        df = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        assert collections.Counter(map(tuple, jaccard_join.near_duplicates(df).collect())) == brute_components(order)
    texts = spark.createDataFrame([(f"id{i}", t) for i, t in rows], "doc_id string, text string")
    want = brute_components([(f"id{i}", t) for i, t in rows])
    assert collections.Counter(map(tuple, jaccard_join.near_duplicates(texts).collect())) == want


def test_maps_never_forget(spark):
    keys = [k * 7919 - 10**6 for k in range(3000)]
    found = jaccard_join._map(spark.createDataFrame([(k,) for k in keys], "k long").repartition(5), len(keys))
    assert found.has(np.array(keys)).all() and found.has(np.arange(10**7, 10**7 + 20000)).mean() < 0.01


def test_maps_take_one_worker_a_task(spark, docs, monkeypatch):
    """What a map is made of comes from tables, not from another step of Python in the same task."""
    plans, make = [], jaccard_join._map

    def seen(keys, *more):
        plans.append(keys._jdf.queryExecution().executedPlan().toString())
        return make(keys, *more)

    monkeypatch.setattr(jaccard_join, "_map", seen)
    jaccard_join.near_duplicates(docs)
    assert len(plans) > 2 and not any("InArrow" in p for p in plans)


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(100, 140)] + [(0, k) for k in range(1, 30)] + [tuple(sorted(rng.sample(range(200, 260), 2))) for _ in range(40)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    least = {i: i for e in edges for i in e}
    for _ in range(len(least)):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    assert got == least


# -- 4: quality rules


def brute_quality(text):
    t = text or ""
    w = [x for x in t.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
    seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, docs):
    more = docs.unionByName(docs.select((F.col("doc_id") + 5000).alias("doc_id"), F.concat("text", F.lit("\n# same line\n same\n# same line\n"), "text").alias("text"), "lang", "source", "n_chars"))
    texts = {(r.doc_id, r.source, r.text) for r in more.collect()}
    got = quality.judged(more, keep=("doc_id", "source", "text"))
    assert got.count() == more.count()
    for r in got.collect():
        n = brute_quality(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n, r.text
        assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0]) and (not r.kept or not r.base_failed)
        assert (r.doc_id, r.source, r.text) in texts
    assert quality.passing(more).columns == more.columns
    assert quality.passing(more).count() == got.where("kept").count()
    assert quality.judged(docs.limit(0)).count() == 0


def test_bad_host_is_rejected(spark):
    rng = random.Random(6)
    rows = [(k, words(rng, 30) if k % 50 >= 25 or k % 7 == 0 else "bad", f"h{k % 50}") for k in range(2000)]
    rows += [(9000, words(rng, 30), "small")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.kept for r in quality.judged(df).collect()}
    assert got[0] is False and got[25] is True and got[9000] is True  # a good text of a bad host, of a good host, of a small one
    plan = quality.judged(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# -- 5 and 7: trained models


def test_toxicity_held_out(spark):
    rng = random.Random(7)
    bad = ["grumblo", "snarfit", "vexlop", "murgal"]
    rows = []
    for k in range(1500):
        toxic = rng.random() < 0.2
        w = words(rng, rng.randrange(20, 60)).split()
        if toxic:
            for x in rng.sample(bad, 3):
                w.insert(rng.randrange(len(w)), x)
        rows.append((k, " ".join(w), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df, df.select("doc_id", "toxic"))
    out = toxicity.scored(df, model).where(toxicity.fold(F.col("doc_id"), 5) == 0).collect()
    assert sum(r.predicted == r.toxic for r in out) / len(out) > 0.97
    again = toxicity.train(df.repartition(7), df.select("doc_id", "toxic"))
    assert np.allclose(model.weights, again.weights)
    odd = toxicity.scored(spark.createDataFrame(some_docs(), DOCS).withColumn("score", F.lit("mine")), model)
    assert odd.where("score < 0 or score > 1 or score is null").count() == 0
    assert {r.score for r in odd.where("text is null or text = ''").collect()}.__len__() == 1
    assert toxicity.train(df, df.select("doc_id", F.lit(0).alias("toxic"))) is None
    assert toxicity.scored(df.limit(0), model).count() == 0 and toxicity.scored(df.limit(2), None).where("score = 0").count() == 2
    held = toxicity.fold(F.col("doc_id"), 5) == 0
    turned = df.select("doc_id", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("toxic"))
    assert np.allclose(model.weights, toxicity.train(df, turned).weights)  # the held-out labels do not matter
    kept = toxicity.harmless(df.drop("toxic").withColumn("score", F.lit(3)), df.select("doc_id", "toxic"))
    assert kept.columns == ["doc_id", "text", "score"] and 1000 < kept.count() < 1400


def test_training_of_repeated_and_long_rows(spark):
    """A document counts once however often it is there, and a long text moves no more than its marks."""
    rng = random.Random(17)
    rows = [(k, words(rng, 40) + (" grumblo snarfit" if k % 4 == 0 else ""), int(k % 4 == 0), rng.choice(["xx", "yy"])) for k in range(300)]
    schema = "doc_id long, text string, toxic int, lang string"
    df = spark.createDataFrame(rows, schema)
    again = df.unionByName(df.where("doc_id < 50").crossJoin(spark.range(200)).drop("id"))
    labels = df.select("doc_id", "toxic")
    once, often = toxicity.train(df, labels), toxicity.train(again, labels.unionByName(labels))
    assert (once.marks == often.marks).all() and np.allclose(once.weights, often.weights)
    assert np.allclose(langid.train(df).table, langid.train(again).table)
    long = spark.createDataFrame([(9001, " ".join(f"w{i}" for i in range(1_000_000)), 1, "xx"), (9002, None, 0, None)], schema)
    both = df.unionByName(long)
    model = toxicity.train(both, both.select("doc_id", "toxic"))
    assert len(model.marks) <= toxicity.MOST_MARKS and toxicity.scored(long, model).count() == 2
    assert langid.identified(long, langid.train(both)).count() == 2


def test_many_languages_in_bounded_memory(spark):
    import pyarrow as pa

    rng = np.random.RandomState(2)
    model = langid.Model([f"l{k:03}" for k in range(100)], rng.normal(size=(1 << langid.BITS, 100)).astype(np.float32), np.zeros(100, np.float32), 0.0)
    texts = ["ab cd " * 60000, "short"]
    whole = model.probabilities(pa.array(texts))
    assert whole.shape == (2, 100) and np.allclose(whole.sum(1), 1)
    small = langid.Model(model.languages[:2], model.table[:, :2], model.bias[:2], 0.0).probabilities(pa.array(texts))
    assert np.allclose(whole[:, 0] / whole[:, 1], small[:, 0] / small[:, 1])
    df = spark.createDataFrame([(1, "abc", "mine", True)], "doc_id long, text string, letters string, __letters boolean")
    assert langid.identified(df, model).select("letters", "__letters").collect() == [("mine", True)]


def test_label_model_finds_the_good_voters():
    rng = np.random.RandomState(3)
    y = rng.rand(3000) < 0.3
    votes = np.stack([np.where(rng.rand(3000) < a, y, ~y) for a in (0.9, 0.85, 0.8, 0.8)] + [rng.rand(3000) < 0.5], 1)
    post, found = toxicity.label_model(votes, 0.3)
    assert ((post > 0.5) == y).mean() > 0.9
    assert abs(found["fires_if_toxic"][4] - found["fires_if_clean"][4]) < 0.1 < found["fires_if_toxic"][0] - found["fires_if_clean"][0]


def test_language_held_out(spark):
    rng = random.Random(9)
    parts = {"xx": ["ka", "lo", "mi", "tu"], "yy": ["sch", "ein", "ung", "er"], "zz": ["qué", "ñor", "ía", "os"]}
    rows = []
    for k in range(600):
        lang = rng.choice(list(parts))
        rows.append((k, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(20)), lang))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    out = langid.identified(df, model).where(langid.fold(F.col("doc_id"), 4) == 2).collect()
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.98 and all(0 <= r.score <= 1 for r in out)
    odd = {r.text: r.lang_pred for r in langid.identified(spark.createDataFrame([(None,), ("",), ("12 !?",), ("ka",)], "text string"), model).collect()}
    assert odd[None] == odd[""] == odd["12 !?"] == "und" and odd["ka"] in parts
    assert langid.train(df.limit(0)) is None and langid.identified(df.limit(3), None).where("lang_pred = 'und'").count() == 3
    import pyarrow as pa

    texts = [r[1] for r in rows[:40]] + ["", "a"]
    one = np.concatenate([model.probabilities(pa.array([t])) for t in texts])
    assert np.allclose(model.probabilities(pa.array(texts)), one)


# -- 6: URL filters


def test_urls(spark):
    urls = ["http://A.Example.org/es/x?q=1", "https://example.org/en/12", "https://example.org/en/2", "http://b.com/fr/", "http://b.com/de/9#t", "ftp://x.net/p", "http://example.org", "http://org/", None, "no scheme", "http://norg/", "a://b://c.org/x", "http://x.com?u=/de/"]
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: r for r in url_filter.judged(df).collect()}
    assert [got[i].rule for i in range(len(urls))] == ["example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", None, None, "org/", None, None, None, None, None]
    assert [got[i].verdict for i in range(5)] == ["block", "block", "allow", "allow", "block"]
    assert (got[0].host, got[0].path) == ("a.example.org", "/es/x") and (got[6].host, got[6].path) == ("example.org", "")
    assert (got[8].host, got[8].path, got[9].host) == ("", "", "") and got[11].host == "b:" and got[12].path == ""
    assert {got[i].verdict for i in (8, 9)} == {"allow"} and url_filter.judged(df.limit(0)).count() == 0


def test_mined_rules_decide_the_rest(spark):
    rows = [(k, f"http://h{k}.spam.com/de/win{'?ref=1' if k % 2 else ''}") for k in range(60)] + [(100 + k, f"http://h{k}.good.com/fr/page") for k in range(60)] + [(500, "http://q.spam.net/win?ref=9"), (501, "http://q.good.net/page")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judged(df).collect()}
    assert got[500] == "block" and got[501] == "allow"


def plain_rules(rows, support, confidence):
    """Minimal rules of (tokens, label) rows by going through all token combinations."""
    n, found = len(rows), []
    counts, labels = collections.Counter(), collections.Counter()
    for tokens, label in rows:
        own = sorted(set(tokens))
        for mask in range(1, 1 << len(own)):
            part = frozenset(t for i, t in enumerate(own) if mask >> i & 1)
            counts[part] += 1
            labels[part, label] += 1
    for (part, label), k in labels.items():
        if k >= support * n and k / counts[part] >= confidence:
            found.append((part, label, k / counts[part], k / n))
    return [r for r in found if not any(o[1] == r[1] and o[2] >= r[2] and o[0] < r[0] for o in found)]


def plain_verdict(own, rules):
    fits = [r for r in rules if r[0] <= set(own)]
    best = max(((c, s, v) for _, v, c, s in fits), default=(0, 0, None))
    return {v for _, v, c, s in fits if (c, s) == best[:2]} or {"allow"}


def test_mined_rules_against_all_combinations(spark):
    rng = random.Random(21)
    for trial in range(3):
        rows = []
        for k in range(240):
            label = rng.choice(["allow", "block"])
            tokens = [t for t, p in zip("abcdefgh", rng.choices([0.1, 0.5, 0.9], k=8)) if rng.random() < (p if label == "block" else 0.5)]
            tokens += ["x1", "x2", "x3"] if "a" in tokens else []
            tokens += ["only"] if label == "block" and rng.random() < 0.2 else []
            rows.append((tokens, label))
        df = spark.createDataFrame(rows, "tokens array<string>, label string").repartition(3)
        rules, items = url_filter.mine(df, 0.05, 0.8)
        want = plain_rules(rows, 0.05, 0.8)
        classes = collections.defaultdict(set)
        for t, i in items.items():
            classes[i].add(t)
        assert {t for m in rules for i in m.tokens for t in classes[i]} == {t for r in want for t in r[0]}
        seen = [(m.tokens, m.verdict, m.confidence, m.support) for m in rules]
        for _ in range(300):
            own = [t for t in [*"abcdefgh", "x1", "x2", "x3", "only"] if rng.random() < 0.4]
            assert plain_verdict({items[t] for t in own if t in items}, seen) & plain_verdict(own, want), own


def test_tokens_that_come_together_do_not_multiply(spark):
    """A path of many words in every URL of both verdicts would give 2 ** 40 combinations."""
    path = "/".join(f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40))
    rows = [(k, f"http://h.com/{'fr' if k % 2 else 'de'}/{path}") for k in range(200)] + [(900, f"http://x.net/fr/{path}"), (901, f"http://x.net/de/{path}")]
    df = spark.createDataFrame([(i, u, 1, 2) for i, u in rows], "page_id long, url string, url_tokens int, url_text int")
    got = {r.page_id: r for r in url_filter.judged(df).collect()}
    assert got[900].verdict == "allow" and got[901].verdict == "block" and got[901].rule is None and got[900].url_tokens == 1


# -- 8: mixing


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        level = (total - sum(fixed.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            return fixed | {s: level * weight[s] for s in free}
        fixed |= {s: 2.0 * sizes[s] for s in over}
        free -= set(over)
    return fixed


def test_mixing(spark, docs):
    got = mixing.mixed(docs).collect()
    assert len(got) == docs.count()
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r.source] += len((r.text or "").encode().split())
    want, taken = brute_targets(dict(sizes)), collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken_1 <= r["size"] and 0 <= r.taken_2 <= r.taken_1 and r.taken == r.taken_1 + r.taken_2
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert sorted(map(str, mixing.mixed(docs.repartition(5)).collect())) == sorted(map(str, got))
    assert mixing.mixed(docs.limit(0)).count() == 0 and mixing.mixed(docs.where("text is null")).agg(F.sum("taken")).first()[0] == 0


def test_mix_gives_the_words_of_the_plan(spark, docs):
    """Every row's words and whole texts but for the ends of passes, repeated rows one after another."""
    count = lambda t: len([w for w in re.split("[\x20\x09-\x0d]+", t or "") if w])
    same = [(77, " one two  three four\nfive ", "en", "s9", 27)] * 7 + [(78, "six seven", "en", "s9", 9)]
    for df in (docs, docs.unionByName(spark.createDataFrame(same, DOCS)), docs.where("doc_id is null or doc_id < 300").limit(9)):
        df = df.cache()
        out = mixing.mix(df)
        assert out.columns == df.columns and out.schema["n_chars"].dataType == df.schema["n_chars"].dataType
        rows, want, texts = out.collect(), collections.Counter(), collections.defaultdict(set)
        for r in mixing.mixed(df).collect():
            want[r.doc_id, r.source] += r.taken
        got = collections.Counter()
        for r in rows:
            got[r.doc_id, r.source] += count(r.text)
        assert got == +want
        for r in df.collect():
            texts[r.doc_id, r.source].add(r.text or "")
        parts = [r for r in rows if r.text not in texts[r.doc_id, r.source]]
        assert len(parts) <= 2 * 5 and all(any(t.startswith(r.text) for t in texts[r.doc_id, r.source]) and r.n_chars == len(r.text) for r in parts)
        assert sorted(map(str, mixing.mix(df.repartition(4)).collect())) == sorted(map(str, rows))
    assert mixing.mix(docs.limit(0)).count() == 0
    clash = mixing.mix(docs.select("doc_id", "text", "source", F.lit("mine").alias("mix_words"), F.lit(2).alias("rows")))
    assert clash.columns == ["doc_id", "text", "source", "mix_words", "rows"] and clash.where("mix_words <> 'mine'").count() == 0


def test_first_words(spark):
    df = spark.createDataFrame([(t, n) for t in (" a bb\tc\n", "a", "  ", "x\u00a0y z", "w " * 9000) for n in range(4)], "t string, n long")
    for r in df.select("t", "n", mixing.first_words(F.col("t"), F.col("n")).alias("cut")).collect():
        spans = [m.end() for m in re.finditer("[^\x20\x09-\x0d]+", r.t)]
        assert r.cut == ("" if r.n == 0 else r.t[: spans[r.n - 1]] if r.n <= len(spans) else r.t), (r.t[:9], r.n)


def test_schedule_is_even(spark):
    sizes = spark.createDataFrame([("a", 40000), ("b", 40000), ("c", 40000)], "source string, size long")
    slots = mixing.schedule(mixing.targets(sizes)).orderBy("slot").collect()
    share = collections.Counter(s.number for s in slots)
    for at in (100, 1000, 5000):
        part = collections.Counter(s.number for s in slots[:at])
        assert all(abs(part[n] / at - share[n] / len(slots)) < 5 / at**0.5 / 2 for n in share)
    ranks = collections.defaultdict(list)
    for s in slots:
        ranks[s.number].append(s.rank)
    assert all(sorted(r) == list(range(len(r))) for r in ranks.values())


# -- 9: sharding


def test_curve_is_hilbert(spark):
    for dims, bits in ((2, 3), (3, 2)):
        df = spark.range(1 << dims * bits).select(*(F.shiftrightunsigned("id", bits * k).bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias(f"d{k}") for k in range(dims)))
        rows = sorted(df.withColumn("at", sharding.curve_index([F.col(f"d{k}") for k in range(dims)], bits)).collect(), key=lambda r: r["at"])
        assert [r["at"] for r in rows] == list(range(1 << dims * bits))
        assert all(sum(abs(a[k] - b[k]) for k in range(dims)) == 1 for a, b in zip(rows, rows[1:]))


def test_shards(spark, docs):
    for n in (docs.count(), 3, 0):
        part = docs.limit(n)
        out = sharding.sharded(part).collect()
        assert len(out) == n
        by = collections.defaultdict(list)
        for r in out:
            by[r.shard].append(r.slot)
        counts = [len(by.get(s, [])) for s in range(40)]
        assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
        assert all(a.curve <= b.curve for a, b in zip(sorted(out, key=lambda r: (r.shard, r.slot)), sorted(out, key=lambda r: (r.shard, r.slot))[1:]))
    text = {(r.doc_id, zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 16) for r in docs.collect()}
    assert {(r.doc_id, r.text_crc32, r["size"]) for r in sharding.sharded(docs).collect()} == text
    plan = sharding.sharded(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_shards_prune_by_every_dimension(spark):
    """A reader that knows each shard's least and greatest source, language and size skips most shards."""
    rng = random.Random(14)
    rows = [(k, "x" * int(2 ** rng.uniform(1, 12)), rng.choice(["de", "en", "fr", "it"]), f"host{rng.randrange(12):02}") for k in range(8000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    held = sharding.sharded(df).select("doc_id", "shard", "size").join(df.drop("text"), "doc_id")
    ranges = held.groupBy("shard").agg(*(f(c).alias(f"{n}_{c}") for c in ("source", "lang", "size") for n, f in (("least", F.min), ("most", F.max)))).collect()
    assert len(ranges) == 40
    read = lambda c, v: sum(r[f"least_{c}"] <= v <= r[f"most_{c}"] for r in ranges) / 40
    assert sum(read("source", f"host{k:02}") for k in range(12)) / 12 < 0.45
    assert sum(read("lang", x) for x in ("de", "en", "fr", "it")) / 4 < 0.6
    assert sum(read("size", 2**k) for k in range(5, 12)) / 7 < 0.6


# -- 10: chat


def test_preferences(spark):
    talks = {
        0: [("user", "hi"), ("assistant", "yo"), ("user", "q"), ("assistant", "good")],
        1: [("user", "hi"), ("assistant", "yo"), ("user", "q"), ("assistant", "bad"), ("user", "x")],
        2: [("user", "same"), ("assistant", "same")], 3: [("user", "same"), ("assistant", "same")],
        4: [("user", "alone")], 6: [("system", None)], 7: [("user", "else")],
    }
    rows = [(c, t, r, x) for c, turns in talks.items() for t, (r, x) in enumerate(turns)] + [(None, 0, "user", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = {r.pair_id: r for r in chat.formatted(chat.neighbours(chat.conversations(df))).collect()}
    show = lambda turns: "".join(f"<|{r}|>\n{x or ''}\n<|end|>\n" for r, x in turns)
    assert [got[k].n_shared for k in (0, 1, 2, 3)] == [3, 2, 0, 0]
    assert got[0].prompt == show(talks[0][:3]) and got[0].chosen_completion == show(talks[0][3:]) and got[0].rejected_completion == show(talks[1][3:])
    for k in (0, 1, 3):
        assert got[k].prompt + got[k].chosen_completion == show(talks[2 * k]) and got[k].prompt + got[k].rejected_completion == show(talks[2 * k + 1])
    assert got[1].prompt == show(talks[2]) and got[1].chosen_completion == got[1].rejected_completion == "" and got[1].chosen_mask == []
    assert got[2].rejected_completion is None and got[2].chosen_completion == show(talks[4]) and got[2].prompt == ""
    s = got[0].rejected_mask[0]
    assert len(got[0].rejected_mask) == 1 and got[0].rejected_completion[s.start : s.end] == "bad\n<|end|>\n"
    assert chat.formatted(chat.neighbours(chat.conversations(df.limit(0)))).count() == 0
    begun = spark.createDataFrame([(1, [("user", "a"), ("assistant", "b")], [("user", "a")], "mine")], "limit int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, prompt string")
    row = chat.formatted(begun).first()
    assert (row.limit, row.n_shared, row.prompt, row.rejected_completion, row.rejected_mask) == (1, 1, show([("user", "a")]), "", [])
    assert row.chosen_completion == show([("assistant", "b")]) and chat.formatted(begun).columns.count("prompt") == 1
