"""Personal data in texts (operator 11), in DataFrame functions only.

Base spans are what fixed patterns match and checks confirm. They are also seeds of the method: the words before seeds are
lexical patterns of a kind, and loosely shaped candidates (an address spelled out, a number without its plus sign or with
a wrong check digit) are instances that nothing has confirmed yet. Patterns and instances are a bipartite graph. A pattern
is as sure as the share of its occurrences in all texts at which a sure instance stands; an instance that is no seed is as
sure as one of its patterns being right. The scores go round ROUNDS times. Candidates whose score is at least LEAST are
personal data wherever they stand. Only patterns before SUPPORT different seeds count, so a copied text gives none.

A match's place comes from the text split at the matches: a place is the sum of the lengths before it, summed in runs of RUN.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.tables import written

KINDS = ("email", "ip", "card", "phone")
SUPPORT, ROUNDS, LEAST = 3, 3, 0.8
RUN, TAIL = 256, 80
SPACES = " \t\n\x0b\f\r"
#: Patterns, so many rows of two short texts each, that are broadcast at most to the texts' words; beyond it Spark shuffles the words' counts.
BROADCAST_PATTERNS = 50_000

_LOCAL = "[A-Za-z0-9._%+-]"
# What a match may not start after, and possessive repeats, leave the leftmost matches as they are and the time linear.
_ADDRESS = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++"
_AT, _DOT = (rf"(?:\x20?[\[({{]\x20?(?i:{w})\x20?[\])}}]\x20?|\x20(?i:{w})\x20|{c})" for w, c in (("at", "@"), ("dot", r"\.")))
_POINT = r"(?:[\[({](?:\.|(?i:dot))[\])}]|\x20(?i:dot)\x20|[_-])"
BASE = {
    "email": _ADDRESS + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"{_ADDRESS}{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++",
    "ip": rf"(?<![0-9A-Za-z])[0-9]{{1,3}}(?:{_POINT}[0-9]{{1,3}}){{3}}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+.])\(?[0-9][\x20().0-9-]{5,18}[0-9](?![0-9A-Za-z])",
}
_PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9][0-9]?)?"
IP = rf"^{_PART}(?:\.{_PART}){{3}}$"
#: What a text with a match holds; cheaper to look for.
HOLDS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(BASE["ip"]),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": lambda t: t.contains("+"),
    "email?": lambda t: t.rlike(r"(?i)[\[({]\x20?(?:at|dot)\x20?[\])}]|\x20dot\x20"),
    "ip?": lambda t: t.rlike(LOOSE["ip"]),
    "phone?": lambda t: t.rlike(LOOSE["phone"]),
}
NONE = "array<string>"


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits' sum, every second one from the right doubled and cast down, is a multiple of 10."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, F.char_length(number) + 1 - i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(number)), F.lit(0), add) % 10 == 0


def confirmed(kind: str, value: Column) -> Column:
    """Whether a match of the base pattern counts."""
    n = F.char_length(digits(value))
    if kind == "ip":
        return value.rlike(IP)
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits(value))).otherwise(False)
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def possible(kind: str, value: Column) -> Column:
    """Whether a loose match may be an identifier of the kind."""
    n = F.char_length(digits(value))
    if kind == "ip":
        return F.regexp_replace(value, "[^0-9]+", ".").rlike(IP)
    return n.between(13, 19) if kind == "card" else n.between(7, 15) if kind == "phone" else F.lit(True)


def same(kind: str, value: Column) -> Column:
    """Equal for two ways of writing one identifier."""
    if kind == "email":
        return F.lower(F.regexp_replace(F.regexp_replace(value, _AT, "@"), _DOT, "."))
    return F.regexp_replace(value, "[^0-9]+", ".") if kind == "ip" else digits(value)


def running(values: Column) -> Column:
    """The sum before each place of an array of numbers that isn't empty."""
    run = lambda b: F.slice(values, b * RUN + 1, F.lit(RUN))
    runs = F.sequence(F.lit(0), F.expr("0") + ((F.size(values) - 1) / RUN).cast("int"))
    start = lambda at: F.struct(F.array().cast("array<bigint>").alias("xs"), at.cast("bigint").alias("at"))
    along = lambda xs, at: F.aggregate(xs, start(at), lambda a, x: F.struct(F.concat(a.xs, F.array(a.at)).alias("xs"), (a.at + x).alias("at")), lambda a: a.xs)
    sums = F.transform(runs, lambda b: F.aggregate(run(b), F.lit(0).cast("bigint"), lambda a, x: a + x))
    return F.flatten(F.zip_with(along(sums, F.lit(0)), runs, lambda at, b: along(run(b), at)))


def before(gap: Column) -> Column:
    """The patterns before a match: its last word and its last two; a word that the match continues is a pattern of its own."""
    tail = F.lower(F.substring(gap, -TAIL, TAIL))
    words = F.split(F.btrim(tail, F.lit(SPACES)), r"\s+")
    last, second = F.element_at(words, -1), F.get(words, F.size(words) - 2)
    apart = F.array_compact(F.array(last, F.concat(second, F.lit(" "), last)))
    return F.when(~last.rlike(r"\p{L}"), F.array().cast(NONE)).when(tail.rlike(r"\s$"), apart).otherwise(F.array(F.concat(F.lit("~"), last)))


def matched(df: DataFrame, names: dict[str, tuple[str, Column]]) -> DataFrame:
    """Adds for each name the matches of its pattern in texts for which the condition holds: structs of start and stop (code
    points), value and before (patterns)."""
    text = F.col("text")
    df = df.withColumns({f"m_{n}": F.when(held, F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(F.array().cast(NONE)) for n, (p, held) in names.items()})
    df = df.withColumns({f"g_{n}": F.when(F.size(f"m_{n}") > 0, F.slice(F.split(text, p, -1), F.lit(1), F.size(f"m_{n}"))) for n, (p, _) in names.items()})
    df = df.withColumns({f"s_{n}": F.zip_with(f"g_{n}", f"m_{n}", lambda g, m: F.char_length(g) + F.char_length(m)) for n in names})
    df = df.withColumns({f"a_{n}": running(F.col(f"s_{n}")) for n in names})

    def spans(n: str) -> Column:
        place = F.transform(f"a_{n}", lambda a, i: F.struct((a + F.char_length(F.get(f"g_{n}", i))).alias("start"), F.get(f"m_{n}", i).alias("value"), before(F.get(f"g_{n}", i)).alias("before")))
        return F.when(F.size(f"m_{n}") > 0, F.transform(place, lambda x: F.struct(x.start.alias("start"), (x.start + F.char_length(x.value)).alias("stop"), x.value.alias("value"), x.before.alias("before"))))

    return df.withColumns({n: spans(n) for n in names}).drop(*[f"{k}_{n}" for n in names for k in "mgsa"])


def scanned(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (a key of its own), id, base and loose (structs of start, kind as its place in KINDS, stop, same and before)."""
    source = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    names = {k: (BASE[k], HOLDS[k](F.col("text"))) for k in KINDS} | {f"{k}?": (LOOSE[k], HOLDS[f"{k}?"](F.col("text"))) for k in LOOSE}
    found = matched(source, names)

    def kept(name: str, kind: str, good) -> Column:
        one = lambda x: F.struct(x.start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x.stop.alias("stop"), same(kind, x.value).alias("same"), x.before.alias("before"))
        return F.transform(F.filter(F.coalesce(F.col(f"`{name}`"), F.array()), lambda x: good(x.value)), one)

    base = F.concat(*[kept(k, k, partial(confirmed, k)) for k in KINDS])
    loose = F.concat(*[kept(f"{k}?", k, partial(possible, k)) for k in LOOSE], kept("card", "card", lambda v: possible("card", v) & ~confirmed("card", v)))
    return written(found.select(F.monotonically_increasing_id().alias("row"), "id", F.array_sort(base).alias("base"), loose.alias("loose")))


def apart(scan: DataFrame) -> DataFrame:
    """row, start, kind, stop, same, before of loose spans that overlap no base span."""
    one = lambda c, seed: F.explode(F.transform(c, lambda x: F.struct(x.start.alias("start"), x.kind.alias("kind"), x.stop.alias("stop"), x.same.alias("same"), x.before.alias("before"), F.lit(seed).alias("seed")))).alias("x")
    held = scan.where(F.size("loose") > 0)
    rows = held.select("row", one("loose", False)).unionByName(held.select("row", one("base", True))).select("row", "x.*")
    by = Window.partitionBy("row")
    until = F.max(F.when(F.col("seed"), F.col("stop"))).over(by.orderBy("start").rangeBetween(Window.unboundedPreceding, 0))
    upto = F.min(F.when(F.col("seed"), F.col("start"))).over(by.orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, -1))
    free = (F.coalesce(until, F.lit(0)) <= F.col("start")) & (F.coalesce(upto, F.col("stop")) >= F.col("stop"))
    return rows.withColumn("free", free).where("free and not seed").drop("free", "seed")


def occurrences(texts: Column, patterns: DataFrame, df: DataFrame) -> DataFrame:
    """before, all: how often each pattern's words stand in the texts. patterns: one column, before, of distinct values."""
    words = F.split(F.btrim(F.lower(texts), F.lit(SPACES)), r"\s+")
    pairs = F.zip_with(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    said = df.select(words.alias("w")).select(F.explode(F.concat("w", pairs)).alias("before"))
    if patterns.count() <= BROADCAST_PATTERNS:
        said = said.join(F.broadcast(patterns), "before", "left_semi")
    counts = said.groupBy("before").agg(F.count(F.lit(1)).alias("all"))
    return counts.join(patterns, "before", "left_semi")


def discovered(seeds: DataFrame, loose: DataFrame, texts: Column, df: DataFrame) -> DataFrame | None:
    """kind, same, score of candidates that are sure; None if no pattern stands before enough seeds."""
    rows = lambda x, seed: x.select("kind", "same", F.explode("before").alias("before"), F.lit(seed).alias("seed"))
    edges = written(rows(seeds, 1).unionByName(rows(loose, 0)).groupBy("kind", "before", "same").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed")))
    patterns = written(edges.groupBy("kind", "before").agg(F.sum("seed").alias("seeds"), F.sum("n").alias("hits"), F.count(F.lit(1)).alias("values")).where((F.col("seeds") >= SUPPORT) & (F.col("seeds") < F.col("values"))).select("kind", "before", "hits"))
    if patterns.isEmpty():
        return None
    seen = occurrences(texts, patterns.select("before").distinct(), df)
    totals = patterns.join(seen, "before", "left").select("kind", "before", F.greatest("hits", F.coalesce("all", F.lit(0))).alias("all"))
    graph = written(edges.join(totals, ["kind", "before"]))
    known = graph.select("kind", "same", F.col("seed").cast("double").alias("score")).groupBy("kind", "same").agg(F.max("score").alias("score"))
    for _ in range(ROUNDS):
        sure = graph.join(known, ["kind", "same"]).groupBy("kind", "before").agg(F.round(F.sum(F.col("n") * F.col("score")) / F.max("all"), 9).alias("sure"))
        wrong = F.exp(F.sum(F.log(1 - F.least("sure", F.lit(0.999999)))))
        known = written(graph.join(sure, ["kind", "before"]).groupBy("kind", "same").agg(F.when(F.max("seed") == 1, 1.0).otherwise(F.round(1 - wrong, 9)).alias("score"), F.max("seed").alias("seed"))).select("kind", "same", "score", "seed")
        last, known = known.where(f"seed = 0 and score >= {LEAST}"), known.drop("seed")
    return last.select("kind", "same", "score")


def written_out(spans: Column) -> Column:
    """kind:start:end of each span (start, kind, stop, ...), comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x.kind), x.start.cast("string"), x.stop.cast("string"))), ",")


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id_col, base and spans (arrays of structs: start, kind, stop; by start, then kind, then stop).

    base is what the patterns match and the checks confirm; spans adds what the method discovers, which overlaps no base
    span. A null text counts as empty; an empty one has no spans. Rows of one id are texts of their own, equal rows have
    equal spans. Other columns are left out. An empty table gives no rows.
    """
    scan = scanned(df, id_col, text_col)
    place = lambda c: F.transform(c, lambda x: F.struct(x.start.alias("start"), x.kind.alias("kind"), x.stop.alias("stop")))
    out = scan.select("row", "id", place("base").alias("base"))
    loose = written(apart(scan))
    seeds = scan.select(F.explode("base").alias("x")).select("x.kind", "x.same", "x.before")
    new = None if loose.isEmpty() else discovered(seeds, loose, F.coalesce(F.col(text_col).cast("string"), F.lit("")), df)
    if new is None:
        return out.select(F.col("id").alias(id_col), "base", F.col("base").alias("spans"))
    more = loose.join(new, ["kind", "same"]).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "stop")).alias("more"))
    both = F.array_sort(F.concat("base", F.coalesce("more", F.array())))
    return out.join(more, "row", "left").select(F.col("id").alias(id_col), "base", both.alias("spans"))


def counted(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The number of base spans of each kind, the digest of the base spans, and all spans, of what find() gives."""
    count = lambda k: F.size(F.filter("base", lambda x: x.kind == k)).cast("long")
    numbers = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(id_col, *numbers, F.sha2(written_out(F.col("base")), 256).alias("base_sha256"), written_out(F.col("spans")).alias("spans"))
