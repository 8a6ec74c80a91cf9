import math
import random
import re

from pyspark.sql import functions as F

from tessera.llm import secrets as S

PARTS = ["password", "Token", 'secret="', "api_key", "APIKEY", " : ", "=", "abc", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef01234567", "é😀", " ", "\n", "xyz.123", "token:", '"', "'"]


def brute(t):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def test_base_spans(spark):
    rnd = random.Random(5)
    rows = [(i, "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 25)))) for i in range(1500)] + [(9000, None), (9001, ""), (9002, "a" * 30000)]
    got = {r["doc_id"]: [tuple(x)[:4] for x in r["base"]] for r in S.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: brute(t or "") for i, t in rows}


def test_random_strings_are_found_and_words_are_not(spark):
    rnd = random.Random(1)
    letters = S.ALPHABETS["base64"]
    keys = ["".join(rnd.choice(letters) for _ in range(60)) for _ in range(200)]
    words = ["thetionandingthetionandingtheretheretionandthe" + w for w in ("ing", "the", "and")] * 70
    rows = [(i, f"see {k} here") for i, k in enumerate(keys + words)]
    got = S.scan(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", F.size(F.filter("spans", lambda s: s["kind"] == "random")).alias("n")).collect()
    found = {r["doc_id"] for r in got if r["n"]}
    assert len([i for i in found if i < 200]) >= 170 and not [i for i in found if i >= 200]


def test_single_keys_are_found(spark):
    rnd, rows, keys = random.Random(7), [], []
    for letters, size in (("0123456789ABCDEF", 32), ("0123456789ABCDEF", 40), ("0123456789abcdef", 32), (S.ALPHABETS["base64"], 40), (S.ALPHABETS["base64"], 100)):
        for _ in range(10):
            key = "".join(rnd.choice(letters) for _ in range(size))
            keys.append("-".join((key[:8], key[8:12], key[12:16], key[16:20], key[20:])) if letters[10:] == "abcdef" else key)
    plain = "thetionandingthetionandingtheretheretionandthe THETIONANDINGTHETIONANDING 2024-01-01-2024-01-01-2024 some/long/path/to/some/file/name"
    found = lambda texts: [r["n"] for r in S.scan(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).select("doc_id", F.size(F.filter("spans", lambda s: s["kind"] == "random")).alias("n")).orderBy("doc_id").collect()]
    together = found([*(f"see {k} here" for k in keys), plain])
    assert sum(together) >= 46 and together[-1] == 0 and max(together) == 1
    for k in range(4, 50, 10):  # each alone in its corpus
        assert found([f"see {keys[k]} here", plain]) == [together[k], 0]


def test_redact(spark):
    df = spark.createDataFrame([(1, "é password=hunter22 x token: abcdef1 y", "k"), (2, None, "k"), (3, "clean", None)], "id long, text string, base string")
    got = {r["id"]: (r["text"], r["base"]) for r in S.redact(df).collect()}
    assert got == {1: ("é [REDACTED] x [REDACTED] y", "k"), 2: (None, "k"), 3: ("clean", None)}
    assert S.redact(df.limit(0)).columns == df.columns


def plain_battery(value):
    """(encoding, length class, p) by the definitions of the three tests."""
    digits = value.replace("=", "").replace("-", "").lower() if re.fullmatch("[0-9a-f]+", value.replace("-", "").rstrip("=").lower()) else None
    bare = digits if digits else value.replace("-", "+").replace("_", "/").rstrip("=")
    for name, pattern in (("hex", "[0-9a-f]+"), ("base32", "[A-Z2-7]+"), ("base36", "[0-9a-z]+"), ("base64", "[A-Za-z0-9+/]+")):
        if re.fullmatch(pattern, bare):
            break
    else:
        return "none", None, None
    codes, k, n = [S.ALPHABETS[name].index(c) for c in bare], len(S.ALPHABETS[name]), len(bare)
    two_sided = lambda z: math.erfc(abs(z) / math.sqrt(2))
    chi = sum((codes.count(c) - n / k) ** 2 / (n / k) for c in range(k))
    spread = 2 / (9 * (k - 1))
    z = ((chi / (k - 1)) ** (1 / 3) - (1 - spread)) / math.sqrt(spread)
    p_chi = two_sided(z) / 2 if z > 0 else 1 - two_sided(z) / 2
    upper = [c >= k / 2 for c in codes]
    runs, ups = 1 + sum(a != b for a, b in zip(upper, upper[1:])), sum(upper)
    mean = 1 + 2 * ups * (n - ups) / n
    variance = (mean - 1) * (mean - 2) / (n - 1)
    p_runs = two_sided((runs - mean) / math.sqrt(variance)) if variance > 0 else 0.0
    middle = sum(codes) / n
    power = sum((c - middle) ** 2 for c in codes)
    lag = sum((a - middle) * (b - middle) for a, b in zip(codes, codes[1:]))
    p_serial = two_sided((lag / power + 1 / n) * math.sqrt(n)) if power > 0 else 0.0
    return name, max(0, min(5, math.floor(math.log2(n / 20)))), min(1.0, 3 * min(p_chi, p_runs, p_serial))


def test_battery_by_its_definitions(spark):
    rnd, rows = random.Random(11), []
    for letters in ("0123456789abcdef", "0123456789ABCDEF", *S.ALPHABETS.values(), "ab", "aaaaaaab", "0123"):
        rows += ["".join(rnd.choice(letters) for _ in range(rnd.randint(20, 300))) for _ in range(25)]
    got = spark.createDataFrame([*enumerate(rows)], "i long, v string").select("i", S.battery(F.col("v")).alias("t")).orderBy("i").collect()
    for v, r in zip(rows, got):
        encoding, size, p = plain_battery(v)
        assert r["t"]["encoding"] == encoding, v
        if encoding != "none":
            assert r["t"]["length_class"] == size and abs(r["t"]["p"] - p) < 1e-5, (v, r, p)


def test_thresholds_by_their_definition(spark):
    rnd, rows = random.Random(12), []
    for size, even, low in ((0, 400, 900), (1, 3000, 0), (2, 30, 0), (3, 60, 5000), (4, 0, 200)):
        rows += [("hex", size, rnd.random()) for _ in range(even)] + [("hex", size, rnd.random() ** 8 / 3) for _ in range(low)]
    rows += [("base64", 0, None)] * 5
    got = {r["length_class"]: r["least"] for r in S.thresholds(spark.createDataFrame(rows, "encoding string, length_class int, p double")).collect()}
    want = {}
    for size in range(5):
        n = [0] * S.BINS
        for _, own, p in rows[:-5]:
            if own == size:
                n[min(S.BINS - 1, int(p * S.BINS))] += 1
        half = S.BINS // 2
        even = sum(n[half:]) / half
        if sum(n[1:]) < S.SPARSE:
            want[size] = 1 / S.BINS
        elif even * S.BINS >= 1 and (fits := [i for i in range(half + 1) if sum(n[i:]) * (1 - S.Q) <= even * (S.BINS - i)]):
            want[size] = min(fits) / S.BINS
    assert got == want


def test_scan_of_odd_tables(spark):
    secret = "api_key = " + "9f86d081884c7d65"
    rows = [(1, secret, "x"), (1, secret, "x"), (None, secret, "y"), (2, None, None), (3, "", "z"), (4, ("word " * 30 + secret + " ") * 500, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string").selectExpr("*", "1 as base", "2 as candidates")
    got = sorted(((r["doc_id"] or 0, len(r["base"]), len(r["spans"])) for r in S.scan(df).collect()))
    assert got == [(0, 1, 1), (1, 1, 1), (1, 1, 1), (2, 0, 0), (3, 0, 0), (4, 500, 500)]
    assert S.scan(df.limit(0)).count() == 0


def test_positions_of_many_matches(spark):
    text = "".join(f"token={'é' * (k % 3)}{k:06d} " for k in range(400))
    got = S.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["base"]
    assert [tuple(x)[:4] for x in got] == brute(text) and len(got) > 64
