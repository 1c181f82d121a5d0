"""Kept generations, digests of directories and the LSIF data source."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lodestar.schema import EDGES, SYMBOLS, Graph
from lodestar.sources import formats, lsif
from lodestar.streaming import incremental, kept, trees
from tests.test_graph import build, rows

UPDATES = f"seq long, op string, path string, symbols array<struct<{', '.join(c.replace(' ', ': ') for c in SYMBOLS.split(', ')).strip()}>>"


def some(path, *ids):
    return [(i, "Function", i, path, 0, 0, 1, 0, None, None) for i in ids]


def size_of(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def test_generations(spark, tmp_path):
    g = build(spark, {"a": ("Function", "f", "x.rs", None), "b": ("Class", "C", "y.rs", None), "c": ("Class", "D", "z.rs", None)}, [("a", "Reference", "b"), ("b", "Reference", "c"), ("c", "Reference", "nobody")])
    folder = str(tmp_path / "g")
    kept.create(g, folder)
    same = lambda: (sorted(r["id"] for r in kept.load(spark, folder).symbols.collect()), rows(kept.load(spark, folder).edges))
    assert same() == (["a", "b", "c"], [("a", "b", "Reference"), ("b", "c", "Reference")])
    batch = spark.createDataFrame([(1, "added", "n.rs", some("n.rs", "n1")), (2, "modified", "x.rs", some("x.rs", "a", "a2")), (3, "removed", "n.rs", []), (4, "added", "m.rs", some("m.rs", "m"))], UPDATES)
    more = spark.createDataFrame([("a2", "b", "Import"), ("m", "a", "Reference"), ("m", "gone", "Reference")], EDGES)
    for _ in range(2):  # a batch that runs again changes nothing
        kept.apply(spark, folder, batch, 1, more)
        assert same() == (["a", "a2", "b", "c", "m"], [("a2", "b", "Import"), ("b", "c", "Reference"), ("m", "a", "Reference")])
    assert [r["id"] for r in kept.in_file(spark, folder, "m.rs").collect()] == ["m"] and kept.in_file(spark, folder, "n.rs").count() == 0
    kept.apply(spark, folder, spark.createDataFrame([(1, "removed", "y.rs", []), (2, "modified", "m.rs", [])], UPDATES), 2)
    assert same() == (["a", "a2", "c"], []) and kept.generations(spark, folder) == 3
    before = same()
    kept.compact(spark, folder, str(tmp_path / "small"))
    folder = str(tmp_path / "small")
    assert same() == before and kept.generations(spark, folder) == 1 and {r["path"] for r in kept.files(spark, folder).collect()} == {"x.rs", "z.rs", "m.rs"}


def test_an_update_writes_what_changed(spark, tmp_path):
    s = spark.range(60_000).select(F.concat(F.lit("s"), F.sha2(F.col("id").cast("string"), 256)).alias("id"), F.lit("Function").alias("kind"), F.sha2(F.concat(F.lit("n"), F.col("id")), 256).alias("name"), F.concat(F.lit("f"), F.col("id") % 300).alias("file_path"), *[F.lit(0).alias(c) for c in ("start_line", "start_char", "end_line", "end_char")], *[F.lit(None).cast("string").alias(c) for c in ("documentation", "detail")])
    kept.create(Graph(s, spark.createDataFrame([], EDGES)), str(tmp_path))
    whole = size_of(tmp_path / "symbols")
    changed = s.where("file_path in ('f1', 'f2', 'f3')").groupBy(F.col("file_path").alias("path")).agg(F.collect_list(F.struct(*s.columns)).alias("symbols"))
    kept.apply(spark, str(tmp_path), changed.select(F.lit(1).cast("long").alias("seq"), F.lit("modified").alias("op"), "path", "symbols"), 1)
    assert size_of(tmp_path / "symbols") - whole < 0.025 * whole and kept.load(spark, str(tmp_path)).symbols.count() == 60_000


def test_a_stream_of_generations(spark, tmp_path):
    g = build(spark, {"a": ("Function", "f", "x.rs", None), "b": ("Class", "C", "y.rs", None)}, [("a", "Reference", "b")])
    kept.create(g, f"{tmp_path}/g")
    for n, row in enumerate([(1, "added", "n.rs", some("n.rs", "n1")), (2, "removed", "x.rs", [])]):
        spark.createDataFrame([row], UPDATES).write.parquet(f"{tmp_path}/in/{n}")
        q = kept.stream(spark.readStream.schema(UPDATES).parquet(f"{tmp_path}/in/*"), f"{tmp_path}/g", f"{tmp_path}/ck")
        assert q.awaitTermination(120) and q.exception() is None
    now = kept.load(spark, f"{tmp_path}/g")
    assert sorted(r["id"] for r in now.symbols.collect()) == ["b", "n1"] and now.edges.count() == 0 and kept.generations(spark, f"{tmp_path}/g") == 3


def test_tree_changes(spark, tmp_path):
    rnd = random.Random(5)
    paths = [f"{rnd.choice('abc')}/{rnd.choice('def')}/{i}" for i in range(60)] + ["top", "a/one", "q/r/s/t/u"]
    old = {p: str(rnd.randint(0, 3)) for p in paths} | {"b/null": None}
    new = {p: h for p, h in old.items() if rnd.random() > 0.05}
    new |= {rnd.choice(paths): "9", "a/new": "1", "new/deep/er": "1", "b/null": ""}
    new.pop("q/r/s/t/u", None)
    frame = lambda x: spark.createDataFrame(list(x.items()), "path string, hash string")
    for k, x in enumerate((old, new)):
        trees.store(frame(x), f"{tmp_path}/{k}")
    got = trees.changes(spark, f"{tmp_path}/0", f"{tmp_path}/1")
    told = [r for r in rows(got.select("path", "status")) if r[0] != "b/null"]
    assert told == [r for r in rows(incremental.detect_changes(frame(old), frame(new)).select("path", "status")) if r[0] != "b/null"]
    assert got.where("path = 'b/null'").first()["status"] == "Modified"  # from a null hash to an empty one
    assert {r["path"]: r["content_hash"] for r in got.where("status <> 'Deleted'").collect()} == {p: h for p, h in new.items() if (p not in old or old[p] != h)}


def test_equal_directories_are_not_looked_at(spark, tmp_path):
    listing = {f"d{i // 50}/e{i % 5}/f{i}": "x" for i in range(1000)}
    frame = lambda x: spark.createDataFrame(list(x.items()), "path string, hash string")
    trees.store(frame(listing), f"{tmp_path}/0")
    trees.store(frame(listing | {"d3/e0/f150": "y"}), f"{tmp_path}/1")
    looked = []
    assert rows(trees.changes(spark, f"{tmp_path}/0", f"{tmp_path}/1", looked).select("path", "status")) == [("d3/e0/f150", "Modified")]
    assert looked == [20, 5, 10]
    none = []
    assert trees.changes(spark, f"{tmp_path}/0", f"{tmp_path}/0", none).count() == 0 and none == [20]
    trees.store(frame(listing).limit(0), f"{tmp_path}/2")
    assert trees.changes(spark, f"{tmp_path}/2", f"{tmp_path}/1").where("status = 'Added'").count() == 1000


@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
def test_ranges_of_bytes_have_every_line_once(tmp_path, size):
    rnd = random.Random(size)
    lines = ["".join(rnd.choice("aé𝒳 ") for _ in range(rnd.choice((0, 1, 3, 20, 90)))) for _ in range(80)]
    for ending in ("", "\n"):
        text = ("\n".join(lines) + "x" + ending).encode()
        path = tmp_path / "f"
        path.write_bytes(text)
        got = [x for at in range(0, len(text), size) for x in lsif.lines_of(str(path), at, min(at + size, len(text)))]
        want, place = [], 0
        for line in [*lines[:-1], lines[-1] + "x"]:
            want.append((place, line))
            place += len(line.encode()) + 1
        assert got == want


def test_the_data_source(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that there are several files
    try:
        source_round_trip(spark, tmp_path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def source_round_trip(spark, tmp_path):
    g = build(spark, {f"n{i}": ("Function", f"näme{i}", f"f{i % 3}.rs", None) for i in range(300)}, [])
    lines = formats.numbered(formats.lsif(g))
    folder = str(tmp_path / "out")
    for _ in range(2):  # writing again takes the place of what was there
        lsif.write_lines(lines, folder)
        names = sorted(os.listdir(folder))
        assert len(names) > 1 and all(n.startswith("part-") for n in names)
        assert [x for n in names for x in open(f"{folder}/{n}", encoding="utf-8").read().splitlines()] == [r["value"] for r in lines.orderBy("n").collect()]
    found = lsif.read_lines(spark, folder, 2000)
    assert found.rdd.getNumPartitions() > 20 and sorted(r["value"] for r in found.collect()) == sorted(r["value"] for r in lines.collect())
    with pytest.raises(Exception, match="holds files already"):
        lines.select("n", "value").write.format("lsif").mode("append").save(folder)
    assert sorted(os.listdir(folder)) == names
    bad = lines.select("n", F.when(F.col("n") == 100, F.raise_error(F.lit("broken"))).otherwise(F.col("value")).alias("value"))
    with pytest.raises(Exception, match="broken"):
        lsif.write_lines(bad, folder)
    assert sorted(os.listdir(folder)) == names
    single = tmp_path / "one.lsif"
    single.write_text('{"label":"x"}\n\n{"label":"y"}')
    assert [r["value"] for r in lsif.read_lines(spark, str(single)).orderBy("place").collect()] == ['{"label":"x"}', "", '{"label":"y"}']
