"""Markdown as column expressions: links, citations, code fences, relative paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a link and as a code fence, and the fence languages that are programs.
LINK = r"(!?)\[([^\]]+)\]\(([^)]+)\)"
FENCE = r"```(\w*)[^\n]*\n([\s\S]*?)\n```"
JAVASCRIPT = ("js", "javascript", "quickjs")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def all_links(body: Column) -> Column:
    """array<struct<ordinal, text, target>> of the links that aren't images, in order; targets and texts are stripped."""
    parts = [F.regexp_extract_all(body, F.lit(LINK), F.lit(k)) for k in (1, 2, 3)]
    zipped = F.arrays_zip(*(p.alias(n) for p, n in zip(parts, ("mark", "text", "target"))))
    numbered = F.transform(zipped, lambda x, i: F.struct(i.alias("ordinal"), x["mark"].alias("mark"), strip(x["text"]).alias("text"), strip(x["target"]).alias("target")))
    return F.filter(numbered, lambda x: x["mark"] == "")


def is_citation(target: Column) -> Column:
    return target.startswith("http://") | target.startswith("https://")


def is_internal(target: Column) -> Column:
    return ~is_citation(target) & (target.endswith(".md") | target.contains(".md#") | target.contains(".md?"))


def resolve_path(target: Column, source: Column) -> Column:
    """The concept id that a link target names, seen from a concept: without anchor, query and .md; a leading slash means the root; . and .. collapse, and going above the root is silent."""
    path = F.regexp_replace(F.regexp_replace(target, r"(?s)[#?].*$", ""), r"\.md$", "")
    folder = F.when(F.contains(source, F.lit("/")), F.regexp_replace(source, r"/[^/]*$", "")).otherwise("")
    combined = F.when((folder == "") | path.startswith("/"), F.regexp_replace(path, "^/+", "")).otherwise(F.concat(folder, F.lit("/"), path))
    empty = F.expr("cast(array() as array<string>)")
    up = lambda s: F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))
    parts = F.aggregate(F.split(combined, "/"), empty, lambda s, x: F.when((x == ".") | (x == ""), s).when(x == "..", up(s)).otherwise(F.concat(s, F.array(x))))
    return F.array_join(parts, "/")


def fences(body: Column) -> Column:
    """array<struct<lang, code>> in order, stripped."""
    zipped = F.arrays_zip(F.regexp_extract_all(body, F.lit(FENCE), F.lit(1)).alias("lang"), F.regexp_extract_all(body, F.lit(FENCE), F.lit(2)).alias("code"))
    return F.transform(zipped, lambda x: F.struct(strip(x["lang"]).alias("lang"), strip(x["code"]).alias("code")))


def program(body: Column, engine: Column) -> Column:
    """The fences in the engine's language, joined by an empty line; null without an engine or a fence."""
    own = F.transform(F.filter(fences(body), lambda f: F.lower(f["lang"]).isin(*JAVASCRIPT)), lambda f: f["code"])
    return F.when(F.lower(engine).isin(*JAVASCRIPT) & (F.size(own) > 0), F.array_join(own, "\n\n"))


def ancestors(concept_id: Column) -> Column:
    """array<struct<parent, child>>: the edge from each directory of the path to what it holds on this path."""
    parts = F.split(concept_id, "/")
    depth = F.size(parts)
    prefix = lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")
    return F.when(depth > 1, F.transform(F.sequence(F.lit(1), depth - 1), lambda k: F.struct(prefix(k).alias("parent"), prefix(k + 1).alias("child")))).otherwise(F.expr("cast(array() as array<struct<parent:string,child:string>>)"))
