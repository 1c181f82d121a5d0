"""Personal data, Merkle manifests and drifted files against brute-force versions, with the hard cases of each."""

import datetime
import glob
import hashlib
import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestar.llm import drift, merkle, pii, queries

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def luhn(number):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(number))) % 10 == 0


def good(kind, value):
    n = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    return 14 <= len(n) <= 19 and luhn(n) if kind == "card" else 10 <= len(n) <= 15 if kind == "phone" else True


def base_spans(text):
    found = [(m.start(), i, m.end()) for i, k in enumerate(KINDS) for m in re.finditer(PATTERNS[k], text or "") if good(k, m[0])]
    return sorted(found)


def listed(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


PERSONAL = "doc_id long, text string, start long, kind string, row string, base string"
PIECES = ["a.b-c%d@host-1.example.org", "x@y", "x@y.z", "a@b.c_d@e.f", "@", ".", "+", "+1 (988) 555-2485", "+49 30 1234-5678", "+1 2", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "1.2.3.4", "256.1.1.1", "0001.002.255.9", "1.2.3", "1.2.3.4.5.6.7.8.9", "0.0.0.0", "12345678901234567890", "00000000000000", "(555) 010-0199", "é", "𝒳", "ß ", "word", "\n", "  ", "-", "_"]


def test_base_spans_are_the_leftmost_matches(spark):
    rnd = random.Random(3)
    texts = [None, "", " ", "no data"] + PIECES + [rnd.choice(("", " ")).join(rnd.choice(PIECES) for _ in range(rnd.randint(2, 40))) for _ in range(400)]
    texts += ["𝒳é " + " ".join(f"u{i}@h{i}.org 10.0.{i % 256}.{i % 300}" for i in range(700)), texts[-1], texts[-1]]
    df = spark.createDataFrame([(i, t, 1, "k", "r", "b") for i, t in enumerate(texts)], PERSONAL)
    got = {r.doc_id: r for r in pii.counted(pii.find(df)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want, r = base_spans(t), got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in want) for j in range(4)], t
        assert r.base_sha256 == sha(listed(want)), t
        assert set(filter(None, listed(want).split(","))) <= set(r.spans.split(",")), t


def test_long_runs_take_linear_time(spark):
    runs = ["a" * 400_000, "a." * 200_000, "a@" + "b." * 200_000, "1" * 400_000, "1." * 200_000, "1 " * 200_000, "+1" + " " * 400_000, "1(" * 200_000, "a@b.c " * 60_000, "1.2.3.4 " * 50_000]
    df = spark.createDataFrame(list(enumerate(runs)), "doc_id long, text string").repartition(4)
    begin = time.time()
    got = {r.doc_id: r for r in pii.counted(pii.find(df)).collect()}
    assert time.time() - begin < 90
    assert got[8].n_email == 60_000 and got[9].n_ip == 50_000 and got[2].n_email == 1 and not got[0].spans


AT = r"(?: ?[\[({] ?(?i:at) ?[\])}] ?| (?i:at) |@)"
DOT = r"(?: ?[\[({] ?(?i:dot) ?[\])}] ?| (?i:dot) |\.)"
POINT = r"(?:[\[({](?:\.|(?i:dot))[\])}]| (?i:dot) |[_-])"
GUESSES = {
    "email": r"[A-Za-z0-9._%+-]+" + AT + r"[A-Za-z0-9-]+(?:" + DOT + "[A-Za-z0-9-]+)+",
    "ip": r"(?<![0-9A-Za-z])[0-9]{1,3}(?:" + POINT + r"[0-9]{1,3}){3}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+.])\(?[0-9][ ().0-9-]{5,18}[0-9](?![0-9A-Za-z])",
    "card": PATTERNS["card"],
}


def normal(kind, value):
    if kind == "email":
        return re.sub(DOT, ".", re.sub(AT, "@", value)).lower()
    return re.sub("[^0-9]+", "." if kind == "ip" else "", value)


def guess(kind, value):
    n = len(re.sub("[^0-9]", "", value))
    if kind == "ip":
        return all(int(x) <= 255 for x in re.findall("[0-9]+", value))
    return 13 <= n <= 19 and not good("card", value) if kind == "card" else 7 <= n <= 15 if kind == "phone" else True


def words_before(text, start, previous):
    tail = text[previous:start][-80:].lower()
    words = tail.strip(" \t\n\x0b\f\r")
    words = re.split(r"[ \t\n\x0b\f\r]+", words)
    if not re.search(r"[^\W\d_]", words[-1]):
        return []
    if not re.search(r"[ \t\n\x0b\f\r]$", tail):
        return ["~" + words[-1]]
    return words[-1:] + ([f"{words[-2]} {words[-1]}"] if len(words) > 1 else [])


def spans_brute(texts):
    """All spans of each text, by the method's definition, with plain loops."""
    seeds, loose, edges, hits = defaultdict(list), defaultdict(list), Counter(), Counter()
    for d, t in texts.items():
        t = t or ""
        for table, patterns in ((seeds, PATTERNS), (loose, GUESSES)):
            for k, p in patterns.items():
                previous = 0
                held = k in ("card",) or table is seeds or re.search(r"(?i)[\[({] ?(?:at|dot) ?[\])}]| dot ", t) or k != "email"
                for m in re.finditer(p, t) if held else ():
                    if (good if table is seeds else guess)(k, m[0]):
                        table[d].append((m.start(), KINDS.index(k), m.end(), normal(k, m[0]), words_before(t, m.start(), previous)))
                    previous = m.end()
        loose[d] = [x for x in loose[d] if not any(b[0] < x[2] and x[0] < b[2] for b in seeds[d])]
    known = {(x[1], x[3]) for xs in seeds.values() for x in xs}
    for xs in [*seeds.values(), *loose.values()]:
        for x in xs:
            for w in x[4]:
                edges[x[1], w, x[3]] += 1
                hits[x[1], w] += 1
    said = Counter()
    for t in texts.values():
        words = re.split(r"[ \t\n\x0b\f\r]+", (t or "").lower().strip(" \t\n\x0b\f\r"))
        said.update(words)
        said.update(f"{a} {b}" for a, b in zip(words, words[1:]))
    values = defaultdict(set)
    for k, w, v in edges:
        values[k, w].add(v)
    use = {p for p, vs in values.items() if len([v for v in vs if (p[0], v) in known]) >= 3 and any((p[0], v) not in known for v in vs)}
    score = {(k, v): float((k, v) in known) for k, _, v in edges}
    for _ in range(3):
        sure = {p: sum(n * score[k, v] for (k, w, v), n in edges.items() if (k, w) == p) / max(hits[p], said[p[1]]) for p in use}
        score = {(k, v): 1.0 if (k, v) in known else 1 - math.prod(1 - min(sure[p], 0.999999) for p in {(x, w) for x, w, y in edges if (x, y) == (k, v)} & use) for k, v in score}
    return {d: sorted([x[:3] for x in seeds[d]] + [x[:3] for x in loose[d] if score.get((x[1], x[3]), 0) >= 0.8]) for d in texts}


def personal_texts():
    rnd = random.Random(8)
    card = lambda: next(n for n in iter(lambda: "4" + "".join(rnd.choice("0123456789") for _ in range(15)), "") if luhn(n))
    texts = [f"{rnd.choice(('Hello', 'Hi'))} there, please ring me on +1 ({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)} today" for _ in range(8)]
    texts += [f"Write to my mailbox u{i}@mail{i}.example.org soon. Card number {card()}." for i in range(6)]
    texts += ["you may ring me on 0171 555 0134 or not", "and then 0171 555 0134 again", "write to my mailbox jo [at] example [dot] com", "my MAILBOX ann at example dot org", "the number 0171 555 0134 9 is", "card number 4111 1111 1111 1112 here"]
    texts += [f"in the year {i} there were 5550{i} of them" for i in range(100, 140)] + ["version 10-0-0-1 of it", "he ran at home dot and", None, "", "the 1234567 the 7654321"]
    return dict(enumerate(texts * 2))


def test_patterns_discover_what_the_base_rules_miss(spark):
    texts = personal_texts()
    df = spark.createDataFrame([(i, t, 1, "k", "r", "b") for i, t in texts.items()], PERSONAL)
    got = {r.doc_id: r.spans for r in pii.counted(pii.find(df)).collect()}
    want = spans_brute(texts)
    assert got == {d: listed(x) for d, x in want.items()}
    new = {texts[d][a:b] for d, x in want.items() for a, k, b in x if (a, k, b) not in base_spans(texts[d])}
    assert {"0171 555 0134", "jo [at] example [dot] com", "ann at example dot org", "4111 1111 1111 1112"} == new


def test_no_personal_data_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a text", 1, "k", "r", "b"), (1, "a text", 1, "k", "r", "b"), (None, None, 1, "k", "r", "b")], PERSONAL)
    rows = pii.counted(pii.find(df)).collect()
    assert len(rows) == 3 and {(r.n_email, r.base_sha256, r.spans) for r in rows} == {(0, sha(""), "")}
    assert pii.counted(pii.find(df.limit(0))).collect() == []


# Merkle manifests


def leaf_brute(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree_brute(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def manifest_brute(rows, given):
    """rows: (doc_id, lang, text); given: the text presented for each row."""
    groups = defaultdict(list)
    for r, t in zip(rows, given, strict=True):
        groups[r[1]].append((r, t))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, leaf_brute(x[0])))
    trees = {g: tree_brute([leaf_brute(r) for r, _ in groups[g]]) for g in names}
    top = tree_brute([trees[g][-1][0] for g in names]) if names else []

    def path(tree, i):
        for level in tree[:-1]:
            yield level[i - i % 8 : i], level[i + 1 : i - i % 8 + 8]
            i //= 8

    out = []
    for k, g in enumerate(names):
        for i, (r, t) in enumerate(groups[g]):
            steps = [*path(trees[g], i), *path(top, k)]
            digest = leaf_brute((*r[:2], t))
            for left, right in steps:
                digest = sha("".join(left) + digest + "".join(right))
            root = top[-1][0]
            out.append((r[0], trees[g][0][i], trees[g][-1][0], root, sha("".join("".join(a) + "".join(b) for a, b in steps)), digest, digest == root))
    return out


def manifest_of(spark, rows, given):
    df = spark.createDataFrame([(*r, t, "g", 1, 2) for r, t in zip(rows, given, strict=True)], "doc_id long, lang string, text string, other string, g string, i long, total long")
    fields = [F.col("doc_id"), F.col("lang"), F.col("text")]
    got = merkle.manifest(df.repartition(3), fields, [*fields[:2], F.col("other")])
    return [tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8, None: 1, "": 9}, {"en": 513, "de": 512, "fr": 64, "é": 65, None: 7}, {"en": 4700, "x": 2}])
def test_manifests(spark, sizes):
    rows = [(i, g, None if i % 7 == 0 else "" if i % 5 == 0 else f"Text ß {i}") for g, n in sizes.items() for i in range(n)]
    given = [t.upper() if t and i % 3 == 0 else t for i, (_, _, t) in enumerate(rows)]
    got = manifest_of(spark, rows, given)
    assert ordered(got) == ordered(manifest_brute(rows, given))
    assert {r[-1] for r in got if r[0] == 1} <= {True, False} and any(r[-1] for r in got)


def test_manifest_of_many_groups_equal_rows_and_none(spark):
    rows = [(i, f"g{i:04d}", "t") for i in range(600)] + [(3, "g0003", "t")] * 3 + [(None, "g0004", None), (4, "g0004", "u")]
    texts = [r[2] for r in rows]
    got = manifest_of(spark, rows, texts)
    assert ordered(got) == ordered(manifest_brute(rows, texts)) and all(r[-1] for r in got)
    assert manifest_of(spark, [], []) == []


def test_any_change_shows(spark):
    rows = [(i, "en", f"text {i}") for i in range(100)]
    given = [t if i != 57 else "text 58" for i, (_, _, t) in enumerate(rows)]
    assert [r[0] for r in manifest_of(spark, rows, given) if not r[-1]] == [57]


# Drifted files

NAMES = ["client_id", "master_id", "source", "updated_at", "name", "email", "city", "nation_id", "segment", "balance"]
CLIENTS = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"


def clients(n, rnd):
    some = lambda x: None if rnd.random() < 0.1 else x
    when = datetime.datetime(1969, 12, 31, 23, 59, 59, 999_999)
    return [(i * 3 - 5, some(i), some("web"), some(when + datetime.timedelta(microseconds=rnd.randrange(10**16))), some(f"Näme|{i}"), some(f"e{i}@x"), some("a\nb"), some(rnd.randrange(25)), some("s"), some(rnd.uniform(-1000, 10000))) for i in range(n)]


def cell(i, v):
    if v is None:
        return "?"
    if i == 3:
        return str((v - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1))
    return str(math.floor(1048576 * v)) if i == 9 and math.isfinite(v) else str(v)


def files_brute(rows):
    crc = lambda r: zlib.crc32(str(r[0]).encode())
    rows, size, out = sorted(rows, key=lambda r: (crc(r), r[0])), 1 + len(rows) // 250, {}
    for f in range(-(-len(rows) // size)):
        version = zlib.crc32(f"19:{f}".encode()) % 24
        version = 0 if version > 15 else version
        part = [list(r) for r in rows[f * size : (f + 1) * size]]
        for r in part:
            if version & 4:
                r[7], r[8] = -1, "none"
            if version & 8 and r[9] is not None:
                r[9] = float(np.float32(r[9]))
        names = list(NAMES)
        if version & 1:
            names[4:6] = ["email", "name"]
        if version & 4:
            names = [c for c in names if c not in ("nation_id", "segment")]
        if version & 2:
            names = names[:1] + names[:0:-1]
        out[f] = (version, len(part), sum(v is None for r in part for v in r), sha(",".join(str(r[0]) for r in part)), sha("\n".join("|".join(cell(i, v) for i, v in enumerate(r)) for r in part)), ",".join(names), ",".join(NAMES), version != 0)
    return out


def evolved(df):
    return drift.evolve(df, wider={"nation_id": pa.int64()}, defaults={"nation_id": -1, "segment": "none"})


def test_evolved_files(spark):
    rows = clients(1300, random.Random(2))
    got = evolved(spark.createDataFrame(rows, CLIENTS).repartition(5)).collect()
    want = files_brute(rows)
    assert {r.file_no: (r.version, r.n_rows, r.n_nulls, r.ids_sha256, r.rows_sha256, r.start_columns, r.columns, r.rewritten) for r in got} == want
    assert {r.version for r in got} == set(range(16))
    place = lambda p: p.removeprefix("file://")
    folder = os.path.dirname(place(got[0].path))
    assert sorted(glob.glob(f"{folder}/*")) == sorted(place(r.path) for r in got) and os.listdir(os.path.dirname(folder)) == ["data"]
    for r in got:
        schema = pq.read_schema(place(r.path))
        assert [(f.name, f.metadata[b"PARQUET:field_id"], f.nullable) for f in schema] == [(n, str(i + 1).encode(), True) for i, n in enumerate(NAMES)] or not r.rewritten
        assert str(schema.field("nation_id").type) == "int64"
    again = evolved(spark.createDataFrame(rows, CLIENTS)).collect()
    assert not {r.path for r in again} & {r.path for r in got} and {r.rows_sha256 for r in again} == {r.rows_sha256 for r in got}


def test_files_that_start(spark, tmp_path):
    rows = clients(600, random.Random(4))
    df = spark.createDataFrame(rows, CLIENTS)
    fields = drift.fields_of(df, {"nation_id": pa.int64()})
    for r in drift.start(df, fields, f"file://{tmp_path}/x", "client_id").collect():
        schema = pq.read_schema(r.path.removeprefix("file://"))
        assert ",".join(schema.names) == r.columns == files_brute(rows)[r.file_no][5]
        ids = {int(f.metadata[b"PARQUET:field_id"]): f.name for f in schema}
        assert ids[5] == ("email" if r.version & 1 else "name") and (8 in ids) == (not r.version & 4)
        assert str(schema.field("balance").type) == ("float" if r.version & 8 else "double")


def test_hot_ids_equal_rows_nulls_and_further_columns(spark):
    rnd = random.Random(6)
    rows = [(*r, "m", 1) for r in clients(300, rnd)] + [(7, i % 4, "web", None, None, None, None, None, None, float(i % 4), "x", i % 4) for i in range(400)] + [(None, *[None] * 9, "y", None)] * 3
    rows += [(99991, 1, "s", None, None, None, None, 1, "s", v, "z", 1) for v in (math.nan, math.inf, -math.inf)]
    df = spark.createDataFrame(rows, CLIENTS + ", k0 string, v1 int")
    got = evolved(df).collect()
    assert sum(r.n_rows for r in got) == len(rows) and max(r.n_rows for r in got) == 1 + len(rows) // 250
    assert {r.columns for r in got} == {",".join([*NAMES, "k0", "v1"])}
    read = [x for r in got for x in pq.read_table(r.path.removeprefix("file://")).to_pylist()] if got else []
    assert Counter(r["client_id"] for r in read) == Counter(r[0] for r in rows) and Counter(r["k0"] for r in read) == Counter(r[10] for r in rows)
    assert evolved(df.limit(0)).collect() == []
    placed = drift.keyed(df, "client_id")
    bounds = drift.bounds_of(placed, len(rows), 3)
    assert bounds == sorted(bounds) and len(set(bounds)) == 2


def test_times_in_any_zone(spark):
    when = datetime.datetime(2024, 3, 31, 2, 30, 0, 7)
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        df = spark.createDataFrame([(when,)], "t timestamp_ntz")
        assert df.select(drift.micros(F.col("t"), df.schema[0].dataType)).first()[0] == (when - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_a_file_that_is_there_already_stays(tmp_path):
    for text in ("one", "two"):
        (tmp_path / f"t-{text}").write_text(text)
        drift.put(f"file://{tmp_path}/t-{text}", f"file://{tmp_path}/final")
    assert (tmp_path / "final").read_text() in ("one", "two") and len(list(tmp_path.iterdir())) == 1


def test_queries_are_registered():
    assert {"op11_pii", "op12_merkle", "op13_drift"} <= set(queries.QUERIES) and "op12_merkle" in queries.ORACLE
