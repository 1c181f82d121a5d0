"""Language identification in two levels (operator 1).

A text's features are hashed character n-grams of 1 to 3 characters over its lower-cased letters, other characters
counting as spaces; a feature's value is the square root of its share. Linear support vector machines, one for each
pair, first tell families apart and then the languages of the chosen family. They are fitted on a bounded sample.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.memory import released

BITS, ORDERS = 13, (1, 2, 3)
#: At most this many labelled rows of each language are fitted on, those of smallest hash, and ROWS of all languages.
ROWS_PER_LANGUAGE, ROWS = 500, 40_000
#: Family by ISO 639-1 code; a language that isn't here is a family of its own.
FAMILIES = {
    "austronesian": ("ceb", "haw", "id", "jv", "mg", "mi", "ms", "su", "tl"),
    "baltic": ("lt", "lv"),
    "bantu": ("lg", "ny", "rw", "sn", "st", "sw", "xh", "zu"),
    "celtic": ("br", "cy", "ga", "gd"),
    "dravidian": ("kn", "ml", "ta", "te"),
    "germanic": ("af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv", "yi"),
    "indic": ("as", "bn", "gu", "hi", "mr", "ne", "or", "pa", "sa", "sd", "si", "ur"),
    "iranian": ("fa", "ku", "ps", "tg"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "semitic": ("am", "ar", "he", "mt", "ti"),
    "sinitic": ("yue", "zh"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "tai": ("lo", "th"),
    "turkic": ("az", "kk", "ky", "tk", "tr", "tt", "ug", "uz"),
    "uralic": ("et", "fi", "hu"),
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}
U = np.uint64
_LETTERS: np.ndarray | None = None


def letters() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)
    return _LETTERS


def features(text: str | None, block: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """Places and values (of unit length) of a text's features; none if it has no letter. The text is read in blocks."""
    count, any_real = np.zeros(1 << BITS, np.int64), False
    last = np.full(1, 32, U)  # what the next n-grams may begin in
    text = text or ""
    for at in range(0, len(text) + 1, block):
        cps = np.frombuffer(text[at : at + block].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        real = letters()[cps]
        any_real = any_real or bool(real.any())
        cps = np.concatenate([last, np.where(real, cps, np.uint32(32)).astype(U), np.full(int(at + block > len(text)), 32, U)])
        keep = np.ones(len(cps), bool)
        keep[1:] = (cps[1:] != 32) | (cps[:-1] != 32)
        keep[: len(last)] = True
        cps = cps[keep]
        for n in ORDERS:
            own = cps[max(0, len(last) - n + 1) :]  # n-grams that end in this block
            if len(own) >= n:
                h = np.full(len(own) - n + 1, n, U)
                for k in range(n):
                    h = (h ^ own[k : len(own) - n + 1 + k]) * U(0x9E3779B97F4A7C15)
                    h ^= h >> U(29)
                h >>= U(64 - BITS)
                count += np.bincount((h if n > 1 else h[own != 32]).astype(np.int64), minlength=1 << BITS)
        last = cps[-(max(ORDERS) - 1) :]
    if not any_real:
        return np.zeros(0, np.int64), np.zeros(0)
    at = np.flatnonzero(count)
    return at, np.sqrt(count[at] / count[at].sum())


Row = tuple[np.ndarray, np.ndarray]


def fit_pair(rows: list[Row], y: np.ndarray, c: float = 4.0, rounds: int = 30) -> np.ndarray:
    """Weights (the last one is the bias) of a linear SVM with squared hinge loss, by dual coordinate descent over rows
    of places and values."""
    w, alpha = np.zeros((1 << BITS) + 1), np.zeros(len(rows))
    size = np.array([v @ v for _, v in rows]) + 1 + 0.5 / c
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(rows)).tolist():
            at, values = rows[i]
            step = max(-alpha[i], (1 - y[i] * (w[at] @ values + w[-1]) - alpha[i] * 0.5 / c) / size[i])
            if step:
                alpha[i] += step
                w[at] += step * y[i] * values
                w[-1] += step * y[i]
    return w


@dataclass
class Choice:
    """One-versus-one machines between names."""

    names: list[str]
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, (1 << BITS) + 1)))

    @classmethod
    def fit(cls, rows: list[Row], names: list[str]) -> Choice:
        own, weights = sorted(set(names)), []
        for a, b in combinations(own, 2):
            some = [i for i, n in enumerate(names) if n in (a, b)]
            weights.append(fit_pair([rows[i] for i in some], np.array([1.0 if names[i] == a else -1.0 for i in some])))
        return cls(own, np.array(weights, np.float32)) if weights else cls(own)

    def best(self, at: np.ndarray, values: np.ndarray) -> tuple[str, float]:
        """The name with most wins (then the largest sum of margins, then the first), and its least sure win, 0 to 1."""
        if len(self.names) == 1:
            return self.names[0], 1.0
        margin = self.weights[:, at] @ values + self.weights[:, -1]
        wins, total, least = np.zeros(len(self.names)), np.zeros(len(self.names)), np.full(len(self.names), np.inf)
        for (a, b), m in zip(combinations(range(len(self.names)), 2), margin, strict=True):
            wins[a if m >= 0 else b] += 1
            total[a] += m
            total[b] -= m
            least[a], least[b] = min(least[a], m), min(least[b], -m)
        k = max(range(len(self.names)), key=lambda i: (wins[i], total[i], -i))
        return self.names[k], float(1 / (1 + np.exp(-4 * np.clip(least[k], -50, 50))))


@dataclass
class Model:
    families: Choice
    languages: dict[str, Choice]

    def predict(self, text: str | None) -> tuple[str, float]:
        at, values = features(text)
        if not len(at) or not self.families.names:
            return "und", 0.0
        family, sure = self.families.best(at, values)
        language, surer = self.languages[family].best(at, values)
        return language, sure * surer


def fit(sample: list[tuple[str | None, str]]) -> Model:
    """A model from (text, language) rows; without rows with letters it says `und` of everything."""
    return fitted([(features(t), y) for t, y in sample])


def fitted(found: list[tuple[Row, str]]) -> Model:
    """A model from features and languages."""
    rows, labels = [f for f, _ in found if len(f[0])], [y for f, y in found if len(f[0])]
    if not rows:
        return Model(Choice([]), {})
    families = [FAMILY.get(y, y) for y in labels]
    own = {f: [i for i, x in enumerate(families) if x == f] for f in sorted(set(families))}
    return Model(Choice.fit(rows, families), {f: Choice.fit([rows[i] for i in at], [labels[i] for i in at]) for f, at in own.items()})


def held_out(c: Column) -> Column:
    return F.coalesce(F.crc32(c.cast("string")) % 3 == 1, F.lit(False))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE, rows: int = ROWS) -> Model:
    """Fits on the labelled rows that aren't held out: of each language at most rows_per_language, and fewer if all of
    them were more than `rows`; those of smallest hash of id and text. Rows with a null id, text or label take no part;
    rows that repeat count one by one, so a language that is all under one id is learned like any other. Other columns
    are not looked at. Without any labelled row the model says `und` of everything. Only features reach the driver.
    """
    c = F.col(id_col)
    usable = df.where(F.col(label_col).isNotNull() & c.isNotNull() & F.col(text_col).isNotNull() & ~held_out(c))
    known = usable.select(F.xxhash64(c.cast("string"), F.col(text_col)).alias("h"), F.col(text_col).alias("t"), F.col(label_col).cast("string").alias("y"))
    languages = known.select("y").distinct().count()
    most = max(1, min(rows_per_language, rows // max(languages, 1)))
    first = lambda order: F.row_number().over(Window.partitionBy("y").orderBy(*order))
    # The largest hash that is wanted of each language, from rows without texts; then only rows up to it are sorted.
    bound = known.select("y", "h").withColumn("k", first(["h"])).where(F.col("k") <= most).groupBy("y").agg(F.max("h").alias("b"))
    near = known.join(F.broadcast(bound), "y").where("h <= b").withColumn("k", first(["h", "t"])).where(F.col("k") <= most)  # bound: one row a language

    @F.arrow_udf("binary")
    def made(texts: pa.Array) -> pa.Array:
        return pa.array([b"".join(x.tobytes() for x in (at.astype("<u2"), values.astype("<f4"))) for at, values in (features(t.as_py()) for t in texts)], pa.binary())

    found = []
    for r in sorted(near.select("y", "k", made("t").alias("f")).collect(), key=lambda r: (r["y"], r["k"])):  # at most `rows` rows, or one for each language
        n = len(r["f"]) // 6
        found.append(((np.frombuffer(r["f"], "<u2", n).astype(np.int64), np.frombuffer(r["f"], "<f4", n, 2 * n).astype(np.float64)), r["y"]))
    return fitted(found)


def predict(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds lang_pred and score to every row; `und` and 0 for a null text or one without a letter.

    The whole text counts. Equal texts get equal results. An existing column of these names is replaced.
    """

    @F.arrow_udf("struct<lang_pred: string, score: double>")  # the model: (families^2 + languages^2) / 2 vectors of 2^BITS numbers
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for texts in batches:
                found = [model.predict(t.as_py()) for t in texts]
                yield pa.StructArray.from_arrays([pa.array([y for y, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["lang_pred", "score"])
        finally:
            released()

    name = "__language"
    out = df.drop(*[c for c in df.columns if c.lower() in ("lang_pred", "score")]).withColumn(name, run(F.col(text_col)))
    return out.withColumn("lang_pred", F.col(f"{name}.lang_pred")).withColumn("score", F.col(f"{name}.score")).drop(name)
