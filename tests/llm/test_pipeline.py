"""The pipeline's stages against brute force, one after another, and the entry module's registration."""

import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
from lodestar.llm import packing, queries
from tests.llm.test_operators import edited, groups_brute, removal_brute, words_of


def corpus():
    rnd = random.Random(8)
    own = {"en": ["the", "and", "of", "to", "which", "thing", "shore", "with"], "fr": ["le", "et", "de", "la", "beau", "nation", "été", "une"]}
    words = {y: [rnd.choice(v) if rnd.random() < 0.3 else "".join(rnd.choice({"en": "thewsrok", "fr": "éauxlmqi"}[y]) for _ in range(rnd.randint(3, 7))) for _ in range(500)] for y, v in own.items()}
    some = lambda y, n: " ".join(rnd.choice(words[y]) for _ in range(n))
    passage = some("en", 70)
    out = [(some(y, rnd.randint(40, 200)), y) for y in ("en", "fr") * 30]
    out += [(edited(out[0][0], 2, rnd), "en"), (out[2][0], "en"), (some("en", 60) + " " + passage + "\n" + some("en", 40), "en"), (some("en", 50) + "\n" + passage + " " + some("en", 60), None)]
    out += [(None, "en"), ("", None), ("12 34 !!", "en"), ("too short", "en"), ("same words again and again in this line \n" * 40, "en"), ("THE%%% AND$$$ *** " * 3 + "LOUD!!! " + " ".join(f"{w.upper()}!!!" for w in words["en"][:80]), "en")]
    return [(i, t, y, f"src{i % 3}", len(t or "")) for i, (t, y) in enumerate(out)], passage


def test_stages(spark, tmp_path):
    rows, passage = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    columns = docs.columns
    seen = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "unused")
        if n + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == columns
            out.write.parquet(f"{tmp_path}/{n}")
            docs = spark.read.parquet(f"{tmp_path}/{n}")
            seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        else:
            seen[name] = out.collect()
    text = {r[0]: r[1] for r in rows}
    assert set(seen["language"]) == {i for i, t in text.items() if any(c.isalpha() for c in t or "")}
    gone = set(seen["language"]) - set(seen["quality"])
    assert gone == {67, 68, 69}  # too short, repeated, shouted
    kept = sorted(seen["quality"])
    groups = groups_brute([text[i] for i in kept], 5, 4, 5)
    assert set(seen["near_duplicates"]) == {kept[c] for _, c in groups.values()} and 60 not in seen["near_duplicates"] and 61 not in seen["near_duplicates"]
    left = sorted(seen["near_duplicates"])
    want = removal_brute([text[i] for i in left], 50)
    for k, i in enumerate(left):
        assert seen["passages"][i] == (want[k][2] if want[k][1] else text[i])
    assert passage in seen["passages"][62] and not set(words_of(passage)[:3]) <= set(words_of(seen["passages"][63])[50:53])
    t = packing.vocabulary(queries.vocabulary_file("byte_bpe_50k.json")).tokenizer
    pieces = defaultdict(list)
    for r in sorted(seen["packing"], key=lambda r: r["piece"]):
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == set(left)
    for i in left:
        ids = [*t.encode(seen["passages"][i], add_special_tokens=False).ids, 2]
        assert sum(r["length"] for r in pieces[i]) == len(ids) and all(r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[r["start"] : r["start"] + r["length"]])) for r in pieces[i])


def test_language_stage_without_labels(spark):
    docs = spark.createDataFrame([(1, "a clean text", None), (2, "12 34 !!", None), (3, None, None), (4, "", None), (5, "日本", None)], "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in corpus_pipeline.identify(spark, docs, "unused").collect()} == {1, 5}


def test_quality_stage_decides_row_by_row(spark):
    rows, _ = corpus()
    good, junk = rows[0][1], "too short"
    docs = spark.createDataFrame([(1, good, "en"), (1, junk, "en"), (None, good, "en"), (None, junk, "en"), (2, junk, "en"), (2, junk, None)], "doc_id long, text string, lang string")
    assert Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.rules(spark, docs, "unused").collect()) == {(1, good): 1, (None, good): 1}


def test_registration():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in names} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
