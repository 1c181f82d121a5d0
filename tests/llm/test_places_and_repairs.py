"""Marks of rows by their places, line runs of licence headers, the better of two packings, points of giant texts."""

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestar.llm import ann, licenses, ngramjoin, packing, places, pretoken, queries


def test_marked_rows_go_or_stay(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(places, "BLOCK", 64)
    df = spark.range(1000).select((F.col("id") % 7).alias("f"), F.col("id").alias("i"), F.concat(F.lit("t"), F.col("id")).alias("a.b"), F.array("id").alias("xs"))
    df.repartition(4).write.parquet(str(tmp_path / "t"))
    rows = places.from_files(spark.read.parquet(str(tmp_path / "t")))
    at = places.placed(rows, "file", "row")
    assert at.select("file", "row").distinct().count() == 1000 and at.select("file").distinct().count() == 4
    gone = at.where("i % 3 = 0").select(F.col("file").alias("f"), F.col("row").alias("i"))
    folder = places.marked(gone)
    left = places.without(rows, folder)
    assert left.columns == rows.columns and sorted(r["i"] for r in left.collect()) == [i for i in range(1000) if i % 3]
    assert left.where("i = 1").first().asDict() == {"f": 1, "i": 1, "a.b": "t1", "xs": [1]}
    some = places.placed(rows.select(F.col("`a.b`").alias("t")))
    assert sorted(r["t"] for r in places.picked(some, folder).collect()) == sorted(f"t{i}" for i in range(0, 1000, 3))
    assert places.without(rows, places.marked(gone.limit(0))).count() == 1000
    places.discarded(rows, folder)
    made = places.from_files(df)  # not from files: written first
    assert places.placed(made, "x", "y").select("x", "y").distinct().count() == 1000


HEADER = {
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
}


def wrapped(text, n):
    words = text.split()
    size = -(-len(words) // n)
    return [" ".join(words[k : k + size]) for k in range(0, len(words), size)]


def test_headers_at_any_line_over_several(spark):
    files, want = [], {}
    for name, text in HEADER.items():
        for at in range(7):
            for n in (2, 3, 4, 5):
                lines = [f"line {k} of code" for k in range(at)] + ["// " + x for x in wrapped(text, n)] + ["int x;"]
                want[len(files)] = name
                files.append((len(files), f"src/{len(files)}.c", "\n".join(lines)))
    files.append((999, "src/long.c", "\n".join(["licensed under the apache license file"] * 20_000)))
    df = spark.createDataFrame(files, "doc_id long, path string, text string").repartition(4)
    begin = time.time()
    got = {r["doc_id"]: r["own_license"] for r in licenses.scan(df).collect()}
    assert {i: got[i] for i in want} == want and time.time() - begin < 100


def test_runs_of_lines(spark):
    one = lambda text, n: spark.range(1).select(licenses.runs_of(F.split(F.lit(text), ","), n).alias("x")).first()["x"]
    assert one("a,b,c,d", 2) == ["a\nb", "b\nc", "c\nd"] and one("a,b,c,d", 4) == ["a\nb\nc\nd"] and one("a", 2) == []


def test_licence_names_titles_and_expressions(spark):
    text = {p.stem: p.read_text() for p in licenses.TEXTS.glob("*.txt")}
    gpl = text["GPL-3.0-only"]
    affero = gpl.replace("GNU GENERAL PUBLIC LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE", 1)
    tag = "// SPDX-License-Identifier: "
    files = [
        ("a/LICENSE-MIT", text["MIT"], "MIT"), ("b/MIT-LICENSE.txt", text["MIT"], "MIT"), ("c/COPYING", affero, "AGPL-3.0-only"), ("d/COPYING.LESSER", gpl, "GPL-3.0-only"),
        ("e/UNLICENSE", text["Unlicense"], "Unlicense"), ("f/LICENSE", text["ISC"], "ISC"), ("g/x.rs", tag + "MIT OR Apache-2.0\n", "MIT OR Apache-2.0"), ("g/y.rs", tag + "(MIT AND (ISC or BSD-2-Clause))", "MIT AND ISC OR BSD-2-Clause"),
        ("g/z.rs", tag + "MIT OR Nonsense-1.0", None), ("h/bsd2.c", "/* " + "\n * ".join(text["BSD-2-Clause"].splitlines()) + " */", "LicenseRef-BSD"), ("i/relicensed.py", "nothing", None),
    ]
    df = spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(files)], "doc_id long, path string, text string")
    got = {r["doc_id"]: r["own_license"] for r in licenses.scan(df).collect()}
    assert {files[i][0]: x for i, x in got.items()} == {p: x for p, _, x in files}


@pytest.mark.parametrize("seed", [1, 2])
def test_packings_are_near_the_bound(seed):
    """Lengths as the tables have them: many short documents, some of full size, of most lengths one or two."""
    rnd = random.Random(seed)
    lengths = [min(1024, max(2, int(rnd.lognormvariate(5.7, 0.9)))) for _ in range(1500)] + [1024] * 30
    histogram = Counter(lengths)
    made = packing.plan(dict(histogram), 1024)
    held = Counter()
    for filling, times in made:
        assert sum(n * k for n, k in filling) <= 1024 and times > 0
        for n, k in filling:
            held[n] += k * times
    assert held == histogram and sum(t for _, t in made) <= 1.01 * packing.solve(dict(histogram), 1024)[1] + 1
    assert packing.plan({}, 1024) == [] and packing.plan({1024: 3}, 1024) == [(((1024, 1),), 3)]


def test_points_of_giant_texts():
    fine = np.full(1 << 16, 2, np.uint16)
    fine[: 1 << 10] = 60_000
    point = ngramjoin.coarser(fine)
    assert int(point.astype(np.int64).sum()) == int(fine.astype(np.int64).sum()) and len(point) >= ngramjoin.COARSE
    assert len(ngramjoin.coarser(np.ones(1024, np.uint16))) == ngramjoin.COARSE
    n = int(fine.astype(np.int64).sum())
    tree = ngramjoin.CountTree(np.array([n, n]), np.vstack([point, point]).astype(np.int64))
    assert sorted(tree.search(n, point.astype(np.int64), 90, 100).tolist()) == [0, 1]


def test_neighbours_where_no_setting_finds_enough(spark, monkeypatch):
    monkeypatch.setattr(ann, "RECALL", 1.1)
    monkeypatch.setattr(ann, "PART", 50)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = ann.search(df, df.where("vec_id % 50 = 0"), k=5).collect()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for q in range(0, 300, 50):
        score = u @ u[q]
        score[q] = -2
        want = np.argsort(-score)[:5].tolist()
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [v for _, v, _ in own] == want and np.allclose([s for _, _, s in own], score[want])


def test_settings_fall_until_enough_is_found(spark, monkeypatch):
    monkeypatch.setattr(ann, "MOST_PROBES", 1)
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(1500, 24)))], "vec_id long, embedding array<double>").repartition(4)
    kind = "<f8"
    rows = ann.usable(df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), kind)
    s, n = ann.fitted(rows, rows.where("id % 20 = 0"), 5, kind)
    assert n == 1500 and s.recall >= ann.RECALL and s.hashes <= 2


def test_rows_go_by_bitmaps_without_python(spark, tmp_path, monkeypatch):
    df = spark.range(70_000).select((F.col("id") % 7).alias("f"), F.col("id").alias("i"), F.concat(F.lit("t"), F.col("id")).alias("a.b"), F.array("id").alias("xs"))
    df.repartition(2).write.parquet(str(tmp_path / "t"))
    rows = places.from_files(spark.read.parquet(str(tmp_path / "t")))
    gone = places.placed(rows, "file", "row").where("i % 3 = 0 or i < 9").select(F.col("file").alias("f"), F.col("row").alias("i"))
    left = places.apart(rows, gone)
    assert left.columns == rows.columns and sorted(r["i"] for r in left.select("i").collect()) == [i for i in range(70_000) if i % 3 and i > 8]
    assert left.where("i = 10").first().asDict() == {"f": 3, "i": 10, "a.b": "t10", "xs": [10]}
    assert places.apart(rows, gone.limit(0)).count() == 70_000


def test_quality_stage_runs_no_python(spark, tmp_path):
    rnd = random.Random(5)
    text = " ".join("".join(rnd.choice("etaoinsrhl") for _ in range(rnd.randint(3, 7))) for _ in range(60))
    spark.createDataFrame([(1, text, "en"), (2, "too short", "en")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "t"))
    out = corpus_pipeline.rules(spark, spark.read.parquet(str(tmp_path / "t")), "unused")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not any(x in plan for x in ("Python", "InArrow", "InPandas"))
    assert [r["doc_id"] for r in out.collect()] == [1]


def test_packing_encodes_a_rare_word_once():
    path = queries.vocabulary_file("byte_bpe_50k.json")
    pretoken._MADE.clear()
    v, asked = packing.vocabulary(path), Counter()
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefghié") for _ in range(8)) for _ in range(130_000)]
    texts = [" ".join(words[at : at + 10_000]) for at in range(0, len(words), 10_000)]
    first = v.encode(texts)
    known = len(v.index)
    for t, ids in zip(texts, v.encode(texts), strict=True):
        assert ids.tolist() == v.tokenizer.encode(t, add_special_tokens=False).ids
        asked[len(ids)] += 1
    assert asked == Counter(map(len, first)) and len(v.index) == known > 120_000 and v.bytes <= v.MOST
    pretoken._MADE.clear()


def test_probes_grow_with_the_queries_only(spark, tmp_path, monkeypatch):
    n, file = 51_282, str(tmp_path / "v.parquet")
    pq.write_table(pa.table({"id": np.arange(n), "v": list(np.random.default_rng(n).normal(size=(n, 64)))}), file)
    rows = ann.written(ann.usable(spark.read.parquet(file), "<f8"))
    asked = rows.where("id % 50 = 0")
    s, _ = ann.fitted(rows, asked, 5, "<f8")
    assert s.recall >= ann.RECALL and s.probes <= ann.MOST_PROBES <= 40
    assert ann.hashed(spark.read.parquet(file).where("id % 50 = 0"), s, "<f8", True).count() <= 40 * ann.TABLES * n // 50
    monkeypatch.setattr(ann, "MOST_PROBES", 1500)
    assert ann.fitted(rows, asked, 5, "<f8")[0].probes > 40


def test_classes_without_a_partner_of_like_size_leave_their_lists(spark):
    rows = [(1, 10, 50, 10), (1, 11, 51, 11), (1, 12, 60, 12), (2, 13, 20, 13), (2, 14, 30, 14), (3, 15, 40, 15), (3, 16, 41, 15), (3, 17, 42, 17)]
    df = spark.createDataFrame(rows, "token long, node long, size int, comp long")
    assert sorted(r["node"] for r in ngramjoin.partnered(df).collect()) == [10, 11, 16, 17]
