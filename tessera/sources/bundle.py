"""Markdown bundles: a directory of concepts with YAML front matter."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import markdown
from tessera.session import ship

RESERVED = ("index.md", "log.md")
PARSED = (
    "concept_id string, concept_type string, title string, description string, resource_uri string, tags array<string>, timestamp string, consumes array<string>, produces array<string>, "
    "engine string, scopes array<string>, timeout_ms bigint, extra_metadata map<string,string>, body string, file_hash string, source_path string, error string"
)


def split_frontmatter(content: str) -> tuple[str | None, str]:
    """(YAML, body): front matter opens with --- at the very start and ends at the first line that begins with ---; the body loses leading line ends."""
    if not content.startswith("---"):
        return None, content
    rest = content[3:]
    end = rest.find("\n---")
    if end < 0:
        return None, content
    return rest[:end], rest[end + 4 :].lstrip("\r\n")


def yaml_loader():
    """YAML 1.2 core scalars only: dates and yes/no stay strings."""
    import yaml

    class Loader(yaml.SafeLoader):
        yaml_implicit_resolvers = {
            k: [(tag, pattern) for tag, pattern in v if tag not in ("tag:yaml.org,2002:timestamp", "tag:yaml.org,2002:bool")] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()
        }

    import re

    Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile("^(true|True|TRUE|false|False|FALSE)$"), list("tTfF"))
    return lambda text: yaml.load(text, Loader)


def scalar(v) -> str | None:
    if isinstance(v, bool):
        return "true" if v else "false"
    return str(v) if isinstance(v, (str, int, float)) else None


def string_list(v) -> list[str]:
    return [x for x in v if isinstance(x, str)] if isinstance(v, list) else []


def parse(path: str, content: str, load) -> dict:
    """The fields of one file, or its error: type is required and may not be blank."""
    out = dict.fromkeys(("title", "description", "resource_uri", "timestamp", "engine", "timeout_ms", "error", "concept_type"))
    out |= {"concept_id": path.removesuffix(".md"), "source_path": path, "tags": [], "consumes": [], "produces": [], "scopes": [], "extra_metadata": {}}
    front, out["body"] = split_frontmatter(content)
    try:
        meta = (load(front) if front is not None else {}) or {}
        meta = dict(meta)
    except Exception as e:  # noqa: BLE001 - any YAML error is this file's error
        return out | {"error": f"{path}: {e}"}
    kind = meta.pop("type", None)
    if not isinstance(kind, str) or not kind.strip():
        return out | {"error": f"{path}: type is {'missing' if kind is None else 'not a filled string'}"}
    out["concept_type"] = kind.strip()
    for field, key in (("title", "title"), ("description", "description"), ("resource_uri", "resource")):
        out[field] = scalar(meta.pop(key, None))
    for key in ("tags", "consumes", "produces", "scopes"):
        out[key] = string_list(meta.pop(key, None))
    moment = meta.pop("timestamp", None)
    out["timestamp"] = moment if isinstance(moment, str) else None
    engine = scalar(meta.pop("engine", None))
    out["engine"] = "quickjs" if engine is not None and engine.strip().lower() in markdown.JAVASCRIPT else None
    limit = meta.pop("timeout-ms", None)
    out["timeout_ms"] = limit if isinstance(limit, int) and not isinstance(limit, bool) and limit >= 0 else None
    out["extra_metadata"] = {str(k): v if isinstance(v, str) else json.dumps(v, default=str) for k, v in meta.items()}
    return out


def parse_files(files: DataFrame) -> DataFrame:
    """Concepts of files (path relative to the bundle, content string); errors are in ``error``."""
    ship(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        load = yaml_loader()
        names = [x.split()[0] for x in PARSED.split(", ")]
        for frame in frames:
            rows = [parse(p, c, load) | {"file_hash": h} for p, c, h in zip(frame["path"], frame["content"], frame["file_hash"])]
            yield pd.DataFrame(rows, columns=names)

    hashed = files.select("path", "content", F.sha2(F.col("content").cast("binary"), 256).alias("file_hash"))
    parsed = hashed.mapInPandas(run, PARSED)
    parsed = parsed.withColumn("program", markdown.program(F.col("body"), F.col("engine")))
    return parsed.withColumn("timestamp", moment(F.col("timestamp")))


def moment(text: Column) -> Column:
    """An RFC 3339 time as naive UTC; null if it isn't one."""
    fits = text.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$")
    return F.when(fits, F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.upper(text).try_cast("timestamp_ltz").cast("timestamp_ntz")))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the bundle's .md files but the reserved ones, by any path that Spark reads."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(path)
    root = path.rstrip("/").rpartition("://")[2].removeprefix("file:")
    relative = F.regexp_replace(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), F.concat(F.lit("^.*?"), F.lit("\\Q" + root + "\\E/+")), F.lit(""))
    named = raw.select(relative.alias("path"), F.decode("content", "UTF-8").alias("content"))
    return named.where(~F.lower(F.regexp_extract("path", "[^/]*$", 0)).isin(*RESERVED))


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """The concepts of a bundle; the first file with an error raises."""
    concepts = parse_files(read_files(spark, path))
    if bad := concepts.where("error is not null").orderBy("concept_id").select("error").limit(1).collect():
        raise ValueError(bad[0][0])
    return concepts.drop("error")


def manifest(spark: SparkSession, path: str) -> tuple[str, str | None]:
    """(name, description) from bundle.json; the directory's name if there is none or it can't be read."""
    name = path.rstrip("/").rpartition("/")[2]
    try:
        text = spark.read.text(f"{path.rstrip('/')}/bundle.json", wholetext=True).first()[0]
        held = json.loads(text)
        return held["name"] if isinstance(held.get("name"), str) else name, held.get("description")
    except Exception:  # noqa: BLE001 - any error means the default
        return name, None


def links(concepts: DataFrame) -> DataFrame:
    """(source_id, target_id, link_text): the first link of each pair in document order."""
    found = concepts.select(F.col("concept_id").alias("source_id"), F.explode(markdown.all_links(F.col("body"))).alias("l")).where(markdown.is_internal(F.col("l.target")))
    resolved = found.select("source_id", markdown.resolve_path(F.col("l.target"), F.col("source_id")).alias("target_id"), "l.ordinal", F.col("l.text").alias("link_text"))
    return resolved.groupBy("source_id", "target_id").agg(F.min_by("link_text", "ordinal").alias("link_text"))


def citations(concepts: DataFrame) -> DataFrame:
    found = concepts.select(F.col("concept_id").alias("source_id"), F.explode(markdown.all_links(F.col("body"))).alias("l")).where(markdown.is_citation(F.col("l.target")))
    return found.groupBy("source_id", F.col("l.target").alias("target_url")).agg(F.min_by("l.text", "l.ordinal").alias("link_text"))


def hierarchy(concepts: DataFrame, within_bundle: bool = False) -> DataFrame:
    """(parent_id, child_id) for the directories of each path; ``within_bundle`` keeps edges both of whose ends are concepts."""
    edges = concepts.select(F.explode(markdown.ancestors(F.col("concept_id"))).alias("e")).select(F.col("e.parent").alias("parent_id"), F.col("e.child").alias("child_id")).distinct()
    if not within_bundle:
        return edges
    from tessera.operators.sync import within

    return within(edges, concepts, "parent_id", "child_id")
