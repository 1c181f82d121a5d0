"""Texts made to collide, rows that share an id, extreme numbers, very long texts and what a task leaves behind."""

import gc
import math
import random
import resource
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.llm import ann, bpe, hashing, langid, memory, ngramjoin, packing, pretoken, queries, substrings, words
from tests.llm.test_operators import edited, groups_brute, removal_brute, shingles, some_words


def pair(n=1024):
    """The Thue-Morse word of n letters and its complement: equal under any polynomial hash modulo a power of two."""
    own = ["ab"[bin(i).count("1") % 2] for i in range(n)]
    return "".join(own), "".join("ab"[c == "a"] for c in own)


def test_hashes_of_slices_and_runs():
    rnd = random.Random(1)
    texts = [*pair(), *(" ".join(x) for x in pair(64)), *("".join(rnd.choice("xyzß") for _ in range(rnd.randint(1, 40))) for _ in range(3000)), "q" * 5000, "q" * 4999 + "r"]
    w = words.Words(texts)
    own = [w.data[a:b].tobytes() for a, b in zip(w.starts, w.ends, strict=True)]
    for seed in (0, 1):
        h = w.hash(seed)
        assert len(set(h.tolist())) == len(set(own)) and len({(a, b) for a, b in zip(own, h.tolist(), strict=True)}) == len(set(own))
    grams = w.grams(7)
    assert len(set(grams.tolist())) == len({tuple(own[i : i + 7]) for i in range(len(grams))})
    other = np.array([own.index(x) for x in own])
    assert hashing.same_slices(w.data, w.starts, w.ends, other).all()
    wrong = np.roll(np.arange(len(own)), 1)
    assert hashing.same_slices(w.data, w.starts, w.ends, wrong).tolist() == [own[i] == own[j] for i, j in enumerate(wrong)]


def test_colliding_words_are_encoded_each():
    a, b = pair()
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        v = pretoken.Vocabulary(queries.vocabulary_file(name))
        own = [a, b, f"{a} {b}", b]
        want = [e.ids for e in v.tokenizer.encode_batch(own, add_special_tokens=False)]
        assert want[0] != want[1] and [x.tolist() for x in v.encode(own)] == want
        if v.lower:
            assert [ids.tolist() for ids, _ in bpe.ChunkCoder(queries.vocabulary_file(name)).encode(own)] == want


def test_colliding_words_are_no_copies(spark):
    a, b = pair()
    tail = " ".join(f"w{i}" for i in range(30))
    texts = [f"{a} {tail}", f"{b} " + " ".join(f"v{i}" for i in range(30)), " ".join([a] + ["x"] * 40), " ".join([b] + ["y"] * 40), " ".join(pair(64)[0]), " ".join(pair(64)[1])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in substrings.dedup(df, 20).collect()}
    assert found == removal_brute(texts, 20)
    joined = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.join(df, 20, 90, 100).collect()}
    assert joined == groups_brute(texts, 20, 90, 100) and {c for _, c in joined.values()} == set(range(6))


@pytest.mark.parametrize("shuffle", [1, 2])
def test_join_of_rows_that_share_ids(spark, shuffle):
    rnd = random.Random(4)
    a, b, c = (some_words(80, rnd) for _ in range(3))
    rows = [(1, a), (1, b), (2, edited(b, 1, rnd)), (3, c), (None, edited(c, 1, rnd)), (4, ""), (4, c), (5, None), (6, "alone in the world"), (None, "nobody"), (7, a), (7, a)]
    random.Random(shuffle).shuffle(rows)
    found = Counter((r["doc_id"], r["component_id"]) for r in ngramjoin.join(spark.createDataFrame(rows, "doc_id long, text string"), 5, 4, 5).collect())
    assert found == Counter([(1, 1), (1, 1), (2, 1), (7, 1), (7, 1), (3, 3), (None, 3), (4, 3), (4, 4), (5, 5), (6, 6), (None, None)])


def test_links_of_all_pairs(spark):
    rnd = random.Random(3)
    base = some_words(60, rnd)
    texts = [edited(base, rnd.choice((0, 1, 2, 4)), rnd) for _ in range(25)] + [base] * 3 + ["", None, "a b"] + [some_words(50, rnd) for _ in range(4)]
    pairs, rows = ngramjoin.links(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 4, 5)
    own = [shingles(t, 3) for t in texts]
    linked = lambda i, j: i != j and own[i] and own[j] and 5 * len(own[i] & own[j]) >= 4 * len(own[i] | own[j])
    found = {r["doc_id"]: r for r in rows.collect()}
    assert {i: r["n_links"] for i, r in found.items()} == {i: sum(bool(linked(i, j)) for j in range(len(own))) for i in range(len(own))}
    member = {}
    for i, s in enumerate(own):
        if s:
            assert member.setdefault(found[i]["class"], s) == s
    assert len(member) == len({frozenset(s) for s in own if s}) and found[28]["class"] is None
    assert sorted((r["a"], r["b"]) for r in pairs.collect()) == sorted((x, y) for x in member for y in member if x < y and 5 * len(member[x] & member[y]) >= 4 * len(member[x] | member[y]))


def test_extreme_finite_vectors_are_searched(spark):
    rows = [(0, [1e200, 0.0]), (1, [1e-200, 1e-201]), (2, [0.0, 5e-324]), (3, [3.0, 4.0]), (4, [-1.7e308, 1.7e308]), (5, [float("nan"), 1.0]), (6, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {(r["query_id"], r["vec_id"]): r["score"] for r in ann.search(df, df).collect()}
    exact = {i: [math.ldexp(x, -math.frexp(max(map(abs, v)))[1]) for x in v] for i, v in rows[:5]}
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.hypot(*a) / math.hypot(*b)
    assert set(found) == {(i, j) for i in range(5) for j in range(5) if i != j}
    assert all(s == pytest.approx(cosine(exact[i], exact[j]), abs=1e-15) for (i, j), s in found.items())


def test_neighbours_are_found_with_settings_of_a_sample(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 32))
    x = (centres[rng.integers(0, 40, 3000)] + 0.3 * rng.normal(size=(3000, 32))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    vectors = ann.usable(df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), "<f4")
    settings, n = ann.fitted(vectors, vectors.where("id % 50 = 0"), 5, "<f4")
    assert n == 3000 and settings.recall >= 0.9 and settings.share < 0.5  # clustered vectors: less than half is visited
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    found = Counter()
    for r in ann.search(df, df.where("vec_id % 50 = 0"), settings=settings).collect():
        s = u @ u[r["query_id"]]
        s[r["query_id"]] = -9
        found[r["vec_id"] in set(np.argsort(-s, kind="stable")[:5].tolist())] += 1
    assert found[True] / (5 * 60) >= 0.9


def test_language_of_one_id_is_learned(spark):
    rows = [(i, f"the thing with which they {i} thought", "en") for i in range(60)]
    for one in (8, 9, 12, 14):
        df = spark.createDataFrame(rows + [(one, f"żółć gęśl jaźń ćma {i} łódź", "pl") for i in range(900)], "doc_id long, text string, lang string")
        model = langid.train(df, rows_per_language=20)
        held = zlib.crc32(str(one).encode()) % 3 == 1
        assert model.predict("gęśl jaźń łódź")[0] == ("en" if held else "pl") and model.predict("they thought with the thing")[0] == "en"


def scored(model, text):
    """The prediction from the definition: n-grams counted one by one, then the machines' votes."""
    own = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    own = " ".join(own.split(" ")) if False else "".join(c for i, c in enumerate(own) if c != " " or i == 0 or own[i - 1] != " ")
    mask, count = (1 << 64) - 1, Counter()
    for n in langid.ORDERS:
        for i in range(len(own) - n + 1):
            if n == 1 and own[i] == " ":
                continue
            h = n
            for c in own[i : i + n]:
                h = ((h ^ ord(c)) * 0x9E3779B97F4A7C15) & mask
                h ^= h >> 29
            count[h >> (64 - langid.BITS)] += 1
    total = sum(count.values())
    value = {k: math.sqrt(v / total) for k, v in count.items()}

    def best(choice):
        if len(choice.names) == 1:
            return choice.names[0]
        wins, k = Counter(), 0
        for i, a in enumerate(choice.names):
            for b in choice.names[i + 1 :]:
                m = sum(float(choice.weights[k][f]) * v for f, v in value.items()) + float(choice.weights[k][-1])
                wins[a if m >= 0 else b] += 1
                wins[(a, "sum")] += m
                wins[(b, "sum")] -= m
                k += 1
        return max(choice.names, key=lambda n: (wins[n], wins[(n, "sum")], [-ord(c) for c in n]))

    return best(model.languages[best(model.families)])


def test_predictions_are_the_machines_votes():
    rnd = random.Random(6)
    sound = {"en": "the and wh ing sh", "de": "der und sch ung ei", "nl": "het en ij aan oe", "fr": "le et eau tion é", "es": "el que ció ñ ado", "xx": "zq qz zz"}
    text = lambda y: "".join(rnd.choice(sound[y].split()) + rnd.choice(("", " ", "1")) for _ in range(rnd.randint(3, 30)))
    model = langid.fit([(text(y), y) for y in list(sound) * 25])
    for t in [text(y) for y in list(sound) * 8] + ["x", "Éa"]:
        assert model.predict(t)[0] == scored(model, t)


def test_features_do_not_depend_on_blocks():
    rnd = random.Random(7)
    for text in ("", "a", " 12 ", "".join(rnd.choice("ab é1\n") for _ in range(500)), some_words(100)):
        whole = langid.features(text)
        for block in (1, 2, 7, 64):
            at, values = langid.features(text, block)
            assert at.tolist() == whole[0].tolist() and values.tolist() == whole[1].tolist()


def test_parts_of_batches_go_by_bytes():
    texts = ["a" * 100] * 50 + ["b" * 10_000, None, "", "c" * 900] + ["d"] * 30
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["i", "t"])
    found = list(memory.parts(batch, 1, 1000, 20))
    assert [x for p in found for x in p.column(1).to_pylist()] == texts
    assert all(p.num_rows <= 20 and (p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 1000) for p in found)


def test_caches_are_bounded_and_go_with_the_task():
    path = queries.vocabulary_file("word_bpe_49k.json")
    c = bpe.coder(path)
    rnd = random.Random(3)
    c.encode([" ".join("".join(rnd.choice("abcdefghij") for _ in range(9)) for _ in range(2000)) for _ in range(60)])
    assert c.v.bytes <= c.v.MOST + 50_000_000 and c.kept <= 2 * bpe.KEPT and 300 * len(c.words) <= bpe.KEPT + 300
    packing.vocabulary(queries.vocabulary_file("byte_bpe_50k.json"))
    assert pretoken._MADE
    list(memory.tidy(lambda batches: iter(()))(iter(())))
    assert not pretoken._MADE


def test_a_very_long_text_takes_little_memory():
    """20 MB of words; the peak is that of the whole process, so what stood before is subtracted."""
    rnd = random.Random(1)
    some = [some_words(2000, rnd) for _ in range(40)]
    text = " ".join(rnd.choice(some) for _ in range(int(20e6 / sum(map(len, some)) * len(some))))
    peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1e3
    gc.collect()
    before = peak()
    at, _ = langid.features(text)
    assert len(at) and peak() - before < 300
    ids = pretoken.Vocabulary(queries.vocabulary_file("byte_bpe_50k.json")).encode([text])[0]
    assert len(ids) > 1e6 and peak() - before < 600
    assert len(ngramjoin.sets_of([text], 5)[0]) > 1e4 and peak() - before < 900


def test_pipeline_of_rows_that_share_ids(spark):
    rnd = random.Random(11)
    own = ["the", "and", "of", "to", "which", "thing", "shore", "with"]
    vocabulary = [rnd.choice(own) if rnd.random() < 0.3 else "".join(rnd.choice("thewsrok") for _ in range(5)) for _ in range(400)]
    some = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    passage, a, b, c = some(60), some(90), some(90), some(90)
    x, y = some(50) + " " + passage, some(50) + "\n" + passage + " " + some(40)
    rows = [(1, a, "en"), (1, b, "en"), (1, "too short", "en"), (2, edited(b, 1, rnd), "en"), (3, x, "en"), (4, y, "en"), (4, c, "en"), (None, a, "en"), (None, "junk", None), (5, c, None), (6, b, "en"), (6, b, "en"), (7, None, "en"), (7, "", "en")] + [(100 + i, some(80), "en") for i in range(30)]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or ""), "kept", "mine", "l", 7, "r", 3, 4) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, score string, lang_pred string, left_text string, seg int, __row string, f int, i int")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, "unused"))
        assert docs.columns == columns and {tuple(r) for r in docs.select("score", "lang_pred", "left_text", "seg", "__row", "f", "i").distinct().collect()} == {("kept", "mine", "l", 7, "r", 3, 4)}
        seen[name] = Counter((r["doc_id"], r["text"]) for r in docs.collect() if (r["doc_id"] or 0) < 100)
    assert seen["language"] == Counter((i, t) for i, t, _ in rows if t and (i or 0) < 100)
    assert seen["quality"] == Counter({k: n for k, n in seen["language"].items() if k[1] not in ("too short", "junk")})
    # Of {1: a, None: a}, of {1: b, 2: near b, 6: b, 6: b} and of {4: c, 5: c} the smallest id stays; all of id 1 that differ.
    assert seen["near_duplicates"] == Counter([(1, a), (1, b), (3, x), (4, y), (4, c)])
    left = dict(seen["passages"])
    assert {(1, a), (1, b), (3, x), (4, c)} < set(left) and sum(left.values()) == 5
    changed = next(t for i, t in left if i == 4 and t != c)
    assert changed == " ".join([*y.split()[:50], *y.split()[110:]])
    again = corpus_pipeline.passages(spark, docs, "unused").collect()
    assert all(r["n_chars"] == len(r["text"]) for r in again)


def test_pipeline_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "unused")
        assert out.count() == 0 and (n + 1 == len(corpus_pipeline.STAGES) or out.columns == docs.columns)


def test_weak_scores_take_part_in_the_language_stage(spark, monkeypatch):
    rows = [(i, t, y) for i, (t, y) in enumerate([("the thing with which they thought and the shore", "en"), ("der und sch ung ei nicht mit das", "de")] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert corpus_pipeline.identify(spark, docs, "").count() == 40
    monkeypatch.setattr(corpus_pipeline, "LEAST_SCORE", 1.1)
    assert corpus_pipeline.identify(spark, docs, "").count() == 0
