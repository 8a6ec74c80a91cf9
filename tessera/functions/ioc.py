"""Indicators of compromise in canonical form, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What defanged notations stand for, replaced in this order.
REFANG = [("[.]", "."), ("(.)", "."), ("{.}", "."), ("[dot]", "."), ("(dot)", "."), ("[:]", ":"), ("[at]", "@"), ("(at)", "@"), ("[@]", "@"), ("hxxps", "https"), ("hxxp", "http"), ("hXXps", "https"), ("hXXp", "http")]
HASHES = ("file-sha256", "file-sha1", "file-md5")
OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"


def refang(value: Column) -> Column:
    for old, new in REFANG:
        value = F.replace(value, F.lit(old), F.lit(new))
    return value


def ipv6(v: Column) -> Column:
    """An IPv6 address in its shortest form (lower case, the first longest run of two or more zero groups as ::, mapped
    IPv4 addresses dotted); what isn't an address in lower case."""
    low = F.lower(v)
    tail = F.regexp_extract(low, rf"^.*:({OCTET}(\.{OCTET}){{3}})$", 1)
    bytes_ = F.split(tail, r"\.")
    pair = lambda k: F.lower(F.hex(F.get(bytes_, F.lit(k)).cast("long") * 256 + F.get(bytes_, F.lit(k + 1)).cast("long")))
    text = F.when(tail != "", F.concat(F.substr(low, F.lit(1), F.length(low) - F.length(tail)), pair(0), F.lit(":"), pair(2))).otherwise(low)
    halves = F.split(text, "::")
    groups = lambda k: F.when(F.coalesce(F.get(halves, F.lit(k)), F.lit("")) == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(F.get(halves, F.lit(k)), ":"))
    left, right = groups(0), groups(1)
    size = F.size(left) + F.size(right)
    filled = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(8 - size, F.lit(0)).cast("int")), right)
    whole = F.when(F.size(halves) == 1, size == 8).otherwise((F.size(halves) == 2) & (size < 8))
    valid = whole & F.forall(filled, lambda g: g.rlike("^[0-9a-f]{1,4}$")) & F.contains(low, F.lit(":"))
    short = F.transform(filled, lambda g: F.lower(F.conv(g, 16, 16)))

    def longest(s: Column, g: Column) -> Column:
        run = F.when(g == "0", s["run"] + 1).otherwise(0)
        better = run > s["size"]
        return F.struct((s["at"] + 1).alias("at"), run.cast("int").alias("run"), F.when(better, run).otherwise(s["size"]).cast("int").alias("size"), F.when(better, s["at"] + 1).otherwise(s["end"]).cast("int").alias("end"))

    zero = F.lit(0)
    best = F.aggregate(short, F.struct(zero.alias("at"), zero.alias("run"), zero.alias("size"), zero.alias("end")), longest)
    joined = lambda begin, n: F.array_join(F.slice(short, begin, n), ":")
    shortest = F.when(best["size"] < 2, F.array_join(short, ":")).otherwise(F.concat(joined(F.lit(1), best["end"] - best["size"]), F.lit("::"), joined(best["end"] + 1, 8 - best["end"])))
    mapped = (F.array_join(F.slice(short, 1, 6), ":") == "0:0:0:0:0:ffff")
    number = lambda k: F.conv(F.get(short, F.lit(k)), 16, 10).cast("long")
    dotted = F.concat_ws(".", *(F.shiftright(number(k), 8) if high else number(k) % 256 for k in (6, 7) for high in (True, False)))
    return F.when(F.coalesce(valid, F.lit(False)), F.when(mapped, F.concat(F.lit("::ffff:"), dotted)).otherwise(shortest)).otherwise(low)


def normalize_ioc(kind: Column, value: Column) -> Column:
    """The value by its kind: domains and hashes in lower case, URLs and mail addresses in the parts where case doesn't matter, IPv6 compressed; others as they are."""
    v = F.btrim(refang(value), F.lit(" \t\n\r\f\x0b"))
    scheme = F.when(F.contains(v, F.lit("://")), F.concat(F.lower(F.regexp_extract(v, r"(?s)^(.*?)://", 1)), F.lit("://"))).otherwise("")
    rest = F.when(F.contains(v, F.lit("://")), F.regexp_replace(v, r"(?s)^.*?://", "")).otherwise(v)
    url = F.concat(scheme, F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_replace(rest, r"^[^/?#]*", ""))
    mail = F.when(F.contains(v, F.lit("@")), F.concat(F.regexp_extract(v, "(?s)^(.*@)[^@]*$", 1), F.lower(F.regexp_extract(v, "[^@]*$", 0)))).otherwise(F.lower(v))
    ipv4 = F.when(v.rlike(rf"^{OCTET}(\.{OCTET}){{3}}$"), v).otherwise(F.lower(v))
    return (
        F.when(kind == "domain", F.lower(F.rtrim(v, F.lit("."))))
        .when(kind == "ipv4", ipv4)
        .when(kind == "ipv6", ipv6(v))
        .when(kind == "url", url)
        .when(kind == "email-addr", mail)
        .when(kind.isin(*HASHES), F.lower(v))
        .otherwise(v)
    )
