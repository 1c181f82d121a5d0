"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import ann, bpe, drift, langid, licenses, merkle, ngramjoin, packing, pii, quality, substrings, urlfilter, warc
from lodestar.llm.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary_file("word_bpe_49k.json"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.json"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup(table(spark, sf_dir, "documents"), window=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


#: The rules of the query.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.rules_frame(spark, URL_RULES))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(table(spark, sf_dir, "pages")), with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.where("vec_id % 50 = 0"), k=5)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: each source is a tree of directories of 1000 and 100 ids, in which an id that 50 divides is
    a licence file."""
    docs = table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit("LICENSE."), F.col("doc_id"))).otherwise(F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".txt")))
    path = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 1000).cast("string"), F.floor(F.col("doc_id") / 100).cast("string"), name)
    return licenses.scan(docs.select("doc_id", "text", path.alias("path")))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.counted(pii.find(table(spark, sf_dir, "documents")))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is given to be verified is a third of the texts in lower case."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    fields = [F.col(c) for c in docs.columns]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    given = F.when(tampered, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    return merkle.manifest(docs, fields, [*fields[:-1], given])


def op13_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.evolve(table(spark, sf_dir, "clients"), wider={"nation_id": pa.int64()}, defaults={"nation_id": -1, "segment": "none"})


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_language, op2_bpe, op3_warc, op4_licenses, op5_packing, op6_url_filter, op7_substrings, op8_ngram_join, op9_quality, op10_neighbours, op11_pii, op12_merkle, op13_drift)}
URL_SQL = """
WITH cut AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  CASE WHEN regexp_matches(rest, '^[^/?#]*/') THEN regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') ELSE '' END AS path FROM cut),
rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
best AS (SELECT page_id, max_by(h || p, length(h) + length(p)) AS rule, max_by(verdict, length(h) + length(p)) AS verdict
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (page_id)
"""

WARC_SQL = """
WITH paid AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
kept AS (SELECT payload_digest, max(page_id) AS keeper FROM paid WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < keeper THEN keeper END AS refers_to
FROM paid LEFT JOIN kept USING (payload_digest)
"""

WORD_RE = r"[^\x20\x09-\x0D]+"
SUBSTRING_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD_RE}') AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i : i + 19], ' ') AS k FROM w, unnest(range(1, len(ws) - 18)) AS t(i) WHERE len(ws) >= 20),
gone AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1),
places AS (SELECT doc_id, list(p) AS ps FROM (SELECT DISTINCT doc_id, i + j AS p FROM gone, unnest(range(0, 20)) AS t(j)) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN places USING (doc_id)
"""

JOIN_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD_RE}') AS ws FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 2], ' ') AS s FROM w, unnest(range(1, len(ws) - 1)) AS t(i) WHERE len(ws) >= 3
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 2),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
steps AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
walk(d, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT d, y FROM walk JOIN steps ON x = r)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(r) AS component_id FROM documents JOIN walk ON d = doc_id LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""


def _term(p: str, q: str) -> str:
    mean = f"((({p}) + ({q})) / 2)"
    return f"((CASE WHEN {p} > 0 THEN ({p}) * log2(({p}) / {mean}) ELSE 0 END + CASE WHEN {q} > 0 THEN ({q}) * log2(({q}) / {mean}) ELSE 0 END) / 2)"


CHAR_CLASSES = ("upper_n", "digit_n", "n_symbols", "mark_n", "space_n", "rest_n")
QUALITY_SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD_RE}') AS ws, array_to_string(regexp_extract_all(coalesce(text, ''), '{WORD_RE}'), '') AS joined,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD_RE}')) AS ls FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i : i + 7], ' ') AS k FROM w, unnest(range(1, len(ws) - 6)) AS t(i) WHERE len(ws) >= 8),
repeated AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM windows), unnest(range(0, 8)) AS t(j) WHERE c > 1 GROUP BY 1),
base AS (SELECT doc_id, lang, len(ws)::BIGINT AS n_words, length(joined)::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(r.n, 0)::BIGINT AS n_repeat_words, length(text) - length(joined) AS space_n, length(joined) - length(regexp_replace(joined, '\p{{Lu}}', '', 'g')) AS upper_n, length(joined) - length(regexp_replace(joined, '\p{{Nd}}', '', 'g')) AS digit_n,
  length(joined) - length(regexp_replace(joined, '[\p{{P}}\p{{S}}]', '', 'g')) AS marks FROM w LEFT JOIN repeated r USING (doc_id)),
chars AS (SELECT *, marks - n_symbols AS mark_n, word_chars - upper_n - digit_n - marks AS rest_n, word_chars + space_n AS total FROM base),
refs AS (SELECT lang, {", ".join(f"sum({c}) / greatest(sum(total), 1) AS q_{c}" for c in CHAR_CLASSES)}, sum(n_words) AS all_words FROM chars GROUP BY 1),
words AS (SELECT doc_id, lang, lower(x) AS word, count(*) AS n FROM w, unnest(ws) AS t(x) GROUP BY ALL),
common AS (SELECT lang, word, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r FROM (SELECT lang, word, sum(n) AS n FROM words WHERE regexp_full_match(word, '\p{{L}}+') GROUP BY ALL)) WHERE r <= 40),
shares AS (SELECT c.lang, word, c.n / all_words AS q FROM common c JOIN refs USING (lang)),
others AS (SELECT lang, greatest(1 - coalesce(sum(q), 0), 0) AS q FROM refs LEFT JOIN shares USING (lang) GROUP BY 1),
own AS (SELECT ch.doc_id, sum({_term("coalesce(x.n, 0) / ch.n_words", "s.q")}) AS js, sum(coalesce(x.n, 0)) AS n_common, sum(s.q) / 2 AS none FROM chars ch JOIN shares s USING (lang) LEFT JOIN words x ON x.doc_id = ch.doc_id AND x.word = s.word WHERE ch.n_words > 0 GROUP BY 1),
judged AS (SELECT ch.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  CASE WHEN total >= 200 THEN sqrt(greatest({" + ".join(_term(f"ch.{c} / ch.total", f"r.q_{c}") for c in CHAR_CLASSES)}, 0)) ELSE 0 END AS char_distance,
  CASE WHEN n_words >= 40 THEN sqrt(greatest(js + {_term("(1 - n_common / n_words)", "o.q")}, 0)) ELSE 0 END AS word_distance, sqrt(none + {_term("1.0", "o.q")}) AS none_distance, n_common / n_words AS common_share, 1 - o.q AS common_ref
  FROM chars ch JOIN refs r USING (lang) JOIN others o USING (lang) LEFT JOIN own USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND char_distance <= 0.28 AND word_distance <= 0.45 AND NOT (word_distance > 0.6 * coalesce(none_distance, 9) AND coalesce(common_share, 0) < 0.3 * common_ref) AS kept
FROM judged
"""



def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TEMPLATES = ", ".join(f"({k}, {_quoted(name)}, {_quoted(text)}, {str(k >= len(licenses.TEMPLATES)).lower()})" for k, (name, text) in enumerate([*licenses.TEMPLATES, *licenses.HEADERS]))
#: Lines, runs of lines and licence files' whole texts against notices and headers, and inheritance; the tables' texts hold no
#: licence's full text and no SPDX tag, which the tests cover.
LICENSE_SQL = rf"""
WITH templates(k, name, text, header) AS (VALUES {_TEMPLATES}),
counted AS (SELECT k, term, count(*) AS n FROM (SELECT k, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM templates) GROUP BY ALL),
files AS (SELECT doc_id, source || '/' || (doc_id // 1000) || '/' || (doc_id // 100) AS dir, CASE WHEN doc_id % 50 = 0 THEN 'LICENSE.' || doc_id ELSE 'doc_' || doc_id || '.txt' END AS file, lower(coalesce(text, '')) AS text, doc_id % 50 = 0 AS whole FROM documents),
vocabulary AS (SELECT DISTINCT term FROM counted),
seen AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[a-z0-9]+'))) AS term FROM files) JOIN vocabulary USING (term) GROUP BY 1),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + coalesce(df, 0))) + 1 AS idf FROM vocabulary LEFT JOIN seen USING (term)),
lengths AS (SELECT k, sqrt(sum((n * idf) ** 2)) AS len FROM counted JOIN idf USING (term) GROUP BY 1),
weights AS (SELECT k, term, n * idf / len AS w FROM counted JOIN idf USING (term) JOIN lengths USING (k)),
lines AS (SELECT doc_id, whole, text, string_split(text, chr(10)) AS ls FROM files WHERE text <> ''),
units AS (SELECT DISTINCT doc_id, unit, header FROM (SELECT doc_id, unnest(ls) AS unit, false AS header FROM lines UNION ALL SELECT doc_id, text, false FROM lines WHERE whole
  UNION ALL SELECT doc_id, array_to_string(ls[i : i + n - 1], chr(10)), true FROM lines, (SELECT unnest(range(2, {licenses.HEADER_LINES + 1})) AS n), unnest(range(1, len(ls) - n + 2)) AS t(i))),
numbered AS (SELECT row_number() OVER () AS u, * FROM units WHERE regexp_matches(unit, '[a-z0-9]')),
tf AS (SELECT u, term, count(*) AS tf FROM (SELECT u, unnest(regexp_extract_all(unit, '[a-z0-9]+')) AS term FROM numbered) GROUP BY ALL),
weighed AS (SELECT u, term, tf * coalesce(idf, 1.0) AS w FROM tf LEFT JOIN idf USING (term)),
norms AS (SELECT u, sqrt(sum(w * w)) AS len FROM weighed GROUP BY 1),
scores AS (SELECT u, k, sum(a.w * b.w) AS dot FROM weighed a JOIN weights b USING (term) GROUP BY ALL),
best AS (SELECT doc_id, arg_max(name, (score, -k)) AS own_license, max(score) AS own_score FROM (SELECT doc_id, s.k, t.name, round(dot / len, 9) AS score FROM scores s JOIN norms USING (u) JOIN numbered x USING (u) JOIN templates t ON t.k = s.k WHERE t.header OR NOT x.header) WHERE score >= 0.8 GROUP BY 1),
given AS (SELECT dir AS above, arg_min(own_license, dir || '/' || file) AS name, min(dir || '/' || file) AS from_path FROM files JOIN best USING (doc_id) WHERE whole GROUP BY 1),
reached AS (SELECT dir, arg_max(name, length(above)) AS name, arg_max(from_path, length(above)) AS from_path FROM (SELECT DISTINCT dir FROM files) JOIN given ON dir = above OR starts_with(dir, above || '/') GROUP BY 1)
SELECT doc_id, dir || '/' || file AS path, own_license, own_score, coalesce(own_license, name) AS license, CASE WHEN own_license IS NULL THEN from_path END AS inherited_from
FROM files LEFT JOIN best USING (doc_id) LEFT JOIN reached USING (dir)
"""

def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    step = "list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: {step}), 4294967295)"


def _merkle_sql(heights: tuple[int, int] = (6, 3)) -> str:
    """The trees level by level, up to 8^6 leaves a language and 8^3 languages."""
    value = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    leaf = lambda text: "sha256(" + " || ".join(value(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    given = f"CASE WHEN {_crc32('doc_id::VARCHAR')} % 3 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END"
    out = [f"leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, {leaf('text')} AS d, {leaf('given')} AS t FROM (SELECT *, {given} AS given FROM documents))", "a0 AS (SELECT g, i, d FROM leaves)"]
    for name, height in zip("ab", heights, strict=True):
        for k in range(height):
            n = f"{name}{k}"
            out.append(f"{n}c AS (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {n})")
            out.append(f"{n}s AS (SELECT x.g, x.i, x.c, coalesce(string_agg(y.d, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS l, coalesce(string_agg(y.d, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS r FROM {n}c x JOIN {n}c y ON x.g = y.g AND x.i // 8 = y.i // 8 GROUP BY ALL)")
            out.append(f"{name}{k + 1} AS (SELECT g, i // 8 AS i, CASE WHEN max(c) = 1 THEN max(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d FROM {n}c GROUP BY g, i // 8)")
        if name == "a":
            out.append(f"b0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, d, g AS name FROM a{height})")
    out.append("f0 AS (SELECT doc_id, x.g, x.i AS ai, n.i AS bi, x.d AS leaf, n.d AS subroot, t AS d, '' AS p FROM leaves x JOIN b0 n ON n.name = x.g)")
    steps = [("a", "f.g", "ai", k) for k in range(heights[0])] + [("b", "''", "bi", k) for k in range(heights[1])]
    for n, (name, g, i, k) in enumerate(steps):
        out.append(f"f{n + 1} AS (SELECT f.* EXCLUDE (d, p), CASE WHEN s.c = 1 THEN f.d ELSE sha256(s.l || f.d || s.r) END AS d, f.p || s.l || s.r AS p FROM f{n} f JOIN {name}{k}s s ON s.g = {g} AND s.i = f.{i} // {8**k})")
    return "WITH " + ",\n".join(out) + f"\nSELECT doc_id, leaf, subroot, root, sha256(p) AS proof_sha256, f.d AS folded_root, f.d = root AS verified FROM f{len(steps)} f, (SELECT d AS root FROM b{heights[1]})"


ORACLE: dict[str, str] = {"op12_merkle": _merkle_sql(), "op3_warc": WARC_SQL, "op4_licenses": LICENSE_SQL, "op6_url_filter": URL_SQL, "op7_substrings": SUBSTRING_SQL, "op8_ngram_join": JOIN_SQL, "op9_quality": QUALITY_SQL}
