"""Secret scans with a randomness test battery (operator 2), in SQL functions only.

Base spans are the matches of three patterns. The battery adds candidates: maximal runs of letters, digits and +/_=-
of at least 20 characters. A candidate's encoding is inferred (hex in either case, also with dashes, which are left out;
base32, base36, base64); for the alphabet of that
encoding three tests ask whether its symbols are independent and uniform: chi-squared of the symbol counts, the number
of runs of symbols in the lower and upper half, and the serial correlation of successive symbols. The three p-values
are combined by Bonferroni. Under randomness the combined p is uniform at least; text piles up at 0. For each
encoding and length class the battery estimates, from the counts of p in 50 bins over all candidates of the corpus,
which share of those above a threshold is not random, and keeps candidates above the lowest threshold at which that
share is at most q (false-discovery control). A class with fewer than ``SPARSE`` candidates above the lowest bin allows
no estimate; it keeps all of these, so that a random one is lost with a probability of 1/50 at most, whatever else the
corpus has. The table of thresholds has at most 4 x 6 rows whatever the corpus.

Positions count code points; ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored

# The base patterns, and the least length of the text that decides (of group 2 for assign).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
BINS, Q = 50, 0.1
SPARSE = 50
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "0123456789abcdefghijklmnopqrstuvwxyz", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}


SPAN = "struct<start:bigint,kind_no:int,end:bigint,kind:string,match:string>"
TOGETHER = 64  # matches added up at a time: an array grows by copying


def matches(text: Column, pattern: str, kind: str, order: int) -> Column:
    """The spans of all matches, leftmost and not overlapping: the lengths of the gaps between them and of the matches, added up."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g).cast("long"))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(g.alias("gap"), F.char_length(m).cast("long").alias("size"), m.alias("match")))

    def add(state: Column, step: Column) -> Column:
        start = state["at"] + step["gap"]
        span = F.struct(start.alias("start"), F.lit(order).alias("kind_no"), (start + step["size"]).alias("end"), F.lit(kind).alias("kind"), step["match"].alias("match"))
        return F.struct((start + step["size"]).alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    def add_some(state: Column, some: Column) -> Column:
        inner = F.aggregate(some, F.struct(state["at"].alias("at"), F.expr(f"cast(array() as array<{SPAN}>)").alias("out")), add)
        return let(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(state["parts"], F.array(x["out"])).alias("parts")))

    def all_of(steps: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor(F.size(steps) / TOGETHER).cast("int")), lambda k: F.slice(steps, k * TOGETHER + 1, F.lit(TOGETHER)))
        empty = F.struct(F.lit(0).cast("long").alias("at"), F.expr(f"cast(array() as array<array<{SPAN}>>)").alias("parts"))
        return F.aggregate(parts, empty, add_some, lambda s: F.flatten(s["parts"]))

    return let(steps, all_of)


NONE = f"cast(array() as array<{SPAN}>)"


def scanned(text: Column, pattern: str, kind: str, order: int, likely: Column) -> Column:
    """matches, for the texts that are likely to have any."""
    return F.when(likely, matches(text, pattern, kind, order)).otherwise(F.expr(NONE))


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def normal_tail(z: Column) -> Column:
    """P(|Z| >= |z|) for a standard normal Z (approximation of erfc by Numerical Recipes; error under 2e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.5 * x)
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368):
        poly = F.lit(c) + t * poly
    return t * F.exp(-x * x - 1.26551223 + t * poly)


def battery(value: Column) -> Column:
    """struct(encoding, length_class, p) of a candidate: three tests for the alphabet of its inferred encoding, combined; null p without an encoding."""
    digits = F.lower(F.rtrim(F.translate(value, "=-", " ")))
    return let(F.when(digits.rlike("^[0-9a-f]+$"), digits).otherwise(F.rtrim(F.translate(value, "-_=", "+/ "))), _by_encoding)


def _by_encoding(bare: Column) -> Column:
    encoding = F.when(bare.rlike("^[0-9a-f]+$"), "hex").when(bare.rlike("^[A-Z2-7]+$"), "base32").when(bare.rlike("^[0-9a-z]+$"), "base36").when(bare.rlike("^[A-Za-z0-9+/]+$"), "base64").otherwise("none")

    def codes(name: Column) -> Column:
        alphabet = F.lit("")
        for known, letters in ALPHABETS.items():
            alphabet = F.when(name == known, letters).otherwise(alphabet)
        places = F.transform(F.filter(F.split(bare, ""), lambda c: c != ""), lambda c: (F.position(c, alphabet) - 1).cast("double"))
        return let(F.struct(places.alias("codes"), F.char_length(alphabet).cast("double").alias("k"), F.char_length(bare).cast("double").alias("n"), name.alias("encoding")), _tests)

    return let(encoding, codes)


def _tests(x: Column) -> Column:
    codes, k, n = x["codes"], x["k"], x["n"]
    # Chi-squared of the counts, by the cube-root normal approximation; one-sided: too uneven.
    squares = total(F.transform(F.array_distinct(codes), lambda d: F.pow(F.size(F.filter(codes, lambda c: c == d)), F.lit(2.0))))
    free = k - 1
    spread = 2 / (9 * free)
    z_chi = (F.pow(F.greatest(k / n * squares - n, F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)
    p_chi = let(z_chi, lambda z: F.when(z > 0, normal_tail(z) / 2).otherwise(1 - normal_tail(z) / 2))
    # Runs of symbols in the lower and in the upper half of the alphabet.
    after = F.slice(codes, F.lit(2), F.size(codes) - 1)
    before = F.slice(codes, F.lit(1), F.size(codes) - 1)
    runs = 1 + F.size(F.filter(F.zip_with(before, after, lambda a, b: (a >= k / 2) != (b >= k / 2)), lambda c: c)).cast("double")
    ups = F.size(F.filter(codes, lambda c: c >= k / 2)).cast("double")
    mean = 1 + 2 * ups * (n - ups) / n
    variance = (mean - 1) * (mean - 2) / (n - 1)
    p_runs = F.when(variance > 0, normal_tail((runs - mean) / F.sqrt(variance))).otherwise(0.0)
    # Serial correlation of successive symbols.
    middle = total(codes) / n
    power = total(F.transform(codes, lambda c: (c - middle) * (c - middle)))
    lag = total(F.zip_with(before, after, lambda a, b: (a - middle) * (b - middle)))
    p_serial = F.when(power > 0, normal_tail((lag / power + 1 / n) * F.sqrt(n))).otherwise(0.0)
    p = F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_serial))
    usable = (x["encoding"] != "none") & (n >= 16)
    length_class = F.greatest(F.lit(0), F.least(F.lit(5), F.floor(F.log2(n / 20)))).cast("int")
    return F.struct(x["encoding"].alias("encoding"), length_class.alias("length_class"), F.when(usable, p).alias("p"))


def thresholds(tested: DataFrame, q: float = Q) -> DataFrame:
    """For each encoding and length class, the lowest p from which at most q of the candidates are estimated not to be random."""
    bins = tested.where("p is not null").groupBy("encoding", "length_class", F.least(F.lit(BINS - 1), F.floor(F.col("p") * BINS)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    by_bin = F.map_from_entries(F.collect_list(F.struct("bin", "n")))
    classes = bins.groupBy("encoding", "length_class").agg(by_bin.alias("by_bin"))
    n = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.coalesce(F.try_element_at("by_bin", i), F.lit(0)).cast("double"))
    # In the bins above one half nearly all are random; their mean is the random part of each bin.
    half = BINS // 2
    classes = classes.withColumn("n", n).withColumn("even", total(F.slice("n", half + 1, half)) / half)
    fits = F.filter(F.sequence(F.lit(0), F.lit(half)), lambda i: total(F.slice("n", i + 1, F.lit(BINS) - i)) * (1 - q) <= F.col("even") * (F.lit(BINS) - i))
    estimated = F.when(F.col("even") * BINS >= 1, F.array_min(fits) / F.lit(float(BINS)))
    least = F.when(total(F.slice("n", 2, BINS - 1)) < SPARSE, F.lit(1.0 / BINS)).otherwise(estimated)
    return classes.select("encoding", "length_class", least.alias("least")).where("least is not null")


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``base`` (spans) and ``candidates`` (spans apart from the base ones, with the battery's encoding, length_class and p)."""
    t = F.coalesce(F.col(text), F.lit(""))
    assign = F.filter(scanned(t, ASSIGN, "assign", 0, t.rlike(ASSIGN)), lambda s: F.char_length(F.regexp_extract(s["match"], ASSIGN, 2)) >= LEAST["assign"])
    access = F.filter(scanned(t, ACCESS, "access", 1, F.contains(t, F.lit("AKIA"))), lambda s: s["end"] - s["start"] >= LEAST["access"])
    # Runs of hexadecimal digits are maximal either way, so the length can be asked for at once.
    long_hex = f"[0-9a-f]{{{LEAST['hex']},}}+"
    hexes = scanned(t, f"(?<![0-9a-f]){long_hex}", "hex", 2, t.rlike(long_hex))
    runs = scanned(t, CANDIDATE + "+", "random", 3, t.rlike(CANDIDATE))
    df = docs.withColumn("base", F.array_sort(F.concat(assign, access, hexes))).withColumn("candidates", runs)
    apart = F.filter("candidates", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return df.withColumn("candidates", F.transform(apart, lambda c: F.struct(c.alias("span"), battery(c["match"]).alias("test"))))


def limits(found: DataFrame, q: float = Q) -> dict[str, float]:
    """The thresholds by "encoding:length class"; at most 4 x 6 whatever the corpus."""
    rows = thresholds(found.select(F.explode("candidates.test").alias("t")).select("t.*"), q).collect()
    return {f"{r['encoding']}:{r['length_class']}": r["least"] for r in rows}


def judged(found: DataFrame, least: dict[str, float]) -> DataFrame:
    """found with ``spans``: the base ones and the candidates whose p reaches the threshold of their class."""
    held = F.create_map(*(F.lit(x) for pair in least.items() for x in pair)) if least else F.expr("map('', 1D)")
    kept = F.filter("candidates", lambda c: c["test"]["p"] >= F.coalesce(F.try_element_at(held, F.concat_ws(":", c["test"]["encoding"], c["test"]["length_class"])), F.lit(2.0)))
    return found.withColumn("spans", F.array_sort(F.concat("base", F.transform(kept, lambda c: c["span"])))).drop("candidates")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: float = Q) -> DataFrame:
    """One row per row of docs: the id, ``base`` and ``spans`` (base and random ones), arrays of structs (start, kind_no,
    end, kind, match) ordered by start, then kind.

    A random span that overlaps a base span is part of it and isn't added. Null and empty texts have none; ids may be
    null or repeated; an empty table gives no rows. Texts are scanned once and never shuffled; only the counts of the
    bins are. What was found is stored, so that the thresholds and the result rest on the same spans.
    """
    found = stored(find(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).drop("text"), "spans")
    return judged(found, limits(found, q)).select(F.col("id").alias(id_col), "base", "spans")


def redact(docs: DataFrame, text_col: str = "text", q: float = Q) -> DataFrame:
    """docs with every span of the text replaced by [REDACTED]; rows without spans, and null texts, stay as they are.
    Texts are scanned twice: for the thresholds, and to replace."""
    least = limits(find(docs.select(F.col(text_col).alias("text"))).drop("text"), q)
    named = [f"`{c}`" for c in docs.columns]
    found = judged(find(docs.select(F.col(text_col).alias("text"), F.struct(*named).alias("row"))), least)
    merged = F.aggregate(
        "spans",
        F.expr("struct(0L as at, cast(array() as array<string>) as parts)"),
        lambda s, x: F.when(x["start"] >= s["at"], F.struct(x["end"].alias("at"), F.concat(s["parts"], F.array(F.substr("text", (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")))).alias("parts"))).otherwise(
            F.struct(F.greatest(x["end"], s["at"]).alias("at"), s["parts"].alias("parts"))
        ),
        lambda s: F.array_join(F.concat(s["parts"], F.array(F.substr("text", (s["at"] + 1).cast("int")))), "[REDACTED]"),
    )
    clean = F.when(F.size("spans") > 0, merged).otherwise(F.col("text"))
    return found.withColumn("clean", clean).select(*(F.col("clean").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
