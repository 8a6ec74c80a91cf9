"""STIX 2.1 bundles: objects to concepts, relationships to typed edges or links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.ioc import normalize_ioc

# Subtypes of domain objects, where observables have their value, and the shapes of typed relations.
SUBTYPES = {
    "attack-pattern": "attack-pattern",
    "intrusion-set": "intrusion-set",
    "threat-actor": "threat-actor",
    "campaign": "campaign",
    "malware": "malware",
    "tool": "tool",
    "indicator": "indicator",
    "course-of-action": "course-of-action",
    "x-mitre-data-source": "data-source",
    "x-mitre-data-component": "data-component",
}
OBSERVABLES = {"ipv4-addr": ("ipv4", "value"), "ipv6-addr": ("ipv6", "value"), "domain-name": ("domain", "value"), "url": ("url", "value"), "email-addr": ("email-addr", "value"), "mutex": ("mutex", "name"), "windows-registry-key": ("registry-key", "key")}
FILE_HASHES = [("SHA-256", "file-sha256"), ("SHA-1", "file-sha1"), ("MD5", "file-md5")]
WITH_PLATFORM = ("attack-pattern", "malware", "tool", "data-source")
SHAPES = {
    "indicates": ("indicates", ["indicator"], ["attack-pattern", "intrusion-set", "threat-actor", "campaign", "malware", "tool"]),
    "uses": ("uses", ["intrusion-set", "threat-actor", "campaign", "malware", "tool"], ["attack-pattern", "malware", "tool"]),
    "attributed-to": ("attributed-to", ["intrusion-set", "campaign"], ["intrusion-set", "threat-actor"]),
    "mitigates": ("mitigates", ["course-of-action"], ["attack-pattern", "malware", "tool", "indicator"]),
    "targets": ("targets", ["intrusion-set", "threat-actor", "campaign"], ["host-asset"]),
    "detects": ("requires-evidence", ["data-component"], ["attack-pattern"]),
    "evidence-of": ("evidence-of", ["data-component"], ["data-source"]),
}


def objects(spark: SparkSession, path: str) -> DataFrame:
    """The column ``object`` (JSON text), one row per object of a bundle file."""
    files = spark.read.text(path, wholetext=True)
    return bundle_objects(files.select(F.col("value").alias("bundle")))


def bundle_objects(bundles: DataFrame) -> DataFrame:
    kind, held = F.get_json_object("bundle", "$.type"), F.from_json(F.get_json_object("bundle", "$.objects"), "array<string>")
    checked = bundles.select(
        F.when(kind.isNotNull() & (kind != "bundle"), F.raise_error(F.concat(F.lit("expected a STIX bundle, got type "), kind)).cast("array<string>")).when(held.isNull(), F.raise_error(F.lit("STIX bundle has no 'objects' array")).cast("array<string>")).otherwise(held).alias("objects")
    )
    return checked.select(F.explode("objects").alias("object"))


def concept_id(stix_id):
    return F.concat(F.lit("stix/"), F.regexp_replace(stix_id, "^(.*?)--", "$1/"))


def get(path: str):
    return F.get_json_object("object", f"$.{path}")


def strings(path: str):
    return F.coalesce(F.from_json(get(path), "array<string>"), F.expr("cast(array() as array<string>)"))


def canonical(text: Column) -> Column:
    """JSON with sorted keys and no blanks, so that equal objects have equal hashes; a variant keeps its keys sorted."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def concepts(stix: DataFrame) -> DataFrame:
    """A row per object that isn't a relationship; without type or id the read fails."""
    kind, own = get("type"), get("id")
    need = lambda c, text: F.when(c.isNull(), F.raise_error(F.lit(text)).cast("string")).otherwise(c)
    rows = stix.withColumn("type", need(kind, "STIX object missing required 'type'")).where("type <> 'relationship'").withColumn("stix_id", need(own, "STIX object missing required 'id'"))
    ioc_type, raw = F.lit(None).cast("string"), F.lit(None).cast("string")
    for algo, name in reversed(FILE_HASHES):
        has = (F.col("type") == "file") & get(f"hashes['{algo}']").isNotNull()
        ioc_type, raw = F.when(has, name).otherwise(ioc_type), F.when(has, get(f"hashes['{algo}']")).otherwise(raw)
    for name, (token, field) in OBSERVABLES.items():
        has = (F.col("type") == name) & get(field).isNotNull()
        ioc_type, raw = F.when(has, token).otherwise(ioc_type), F.when(has, get(field)).otherwise(raw)
    hint = F.lit("cyber-object")
    for name, token in SUBTYPES.items():
        hint = F.when(F.col("type") == name, token).otherwise(hint)
    rows = rows.withColumns({"ioc_type": ioc_type, "raw": raw}).withColumn("type_hint", F.when(F.col("ioc_type").isNotNull(), "observable").otherwise(hint))
    retired = F.coalesce((get("revoked") == "true") | (get("x_mitre_deprecated") == "true"), F.lit(False)) | F.coalesce(get("revoked") == "true", F.lit(False)) | F.coalesce(get("x_mitre_deprecated") == "true", F.lit(False))
    references = F.coalesce(F.from_json(get("external_references"), "array<struct<source_name:string,external_id:string>>"), F.expr("cast(array() as array<struct<source_name:string,external_id:string>>)"))
    attack = F.filter(references, lambda r: (r["source_name"] == "mitre-attack") & r["external_id"].isNotNull())
    phases = F.from_json(get("kill_chain_phases"), "array<struct<phase_name:string>>")
    return rows.select(
        concept_id(F.col("stix_id")).alias("concept_id"),
        "stix_id",
        F.col("type").alias("concept_type"),
        "type_hint",
        get("name").alias("title"),
        get("description").alias("description"),
        strings("labels").alias("tags"),
        "ioc_type",
        normalize_ioc(F.col("ioc_type"), F.col("raw")).alias("ioc_value"),
        get("pattern").alias("stix_pattern"),
        F.to_timestamp(get("valid_until")).cast("timestamp_ntz").alias("valid_until"),
        (get("revoked") == "true").alias("revoked"),
        F.when(~retired & (F.size(attack) > 0), F.get(attack, F.lit(0))["external_id"]).alias("attack_id"),
        F.when(F.col("type_hint").isin(*WITH_PLATFORM), F.array_sort(F.array_distinct(strings("x_mitre_platforms")))).otherwise(F.expr("cast(array() as array<string>)")).alias("platform"),
        F.coalesce(F.filter(F.transform(phases, lambda p: p["phase_name"]), lambda p: p.isNotNull()), F.expr("cast(array() as array<string>)")).alias("kill_chain_phase"),
        F.sha2(canonical(F.col("object")).cast("binary"), 256).alias("file_hash"),
        F.col("object").alias("metadata_json"),
        F.when(F.col("type") == "x-mitre-data-component", get("x_mitre_data_source_ref")).alias("source_ref"),
    )


def relations(stix: DataFrame, held: DataFrame) -> DataFrame:
    """(source, target, rel_type, relation): relation is the typed edge's name, or null for a plain link. An edge is typed
    if its shape is known and both ends are concepts of this bundle that may play there; incomplete ones are skipped."""
    sro = stix.where(get("type") == "relationship").select(get("source_ref").alias("s"), get("target_ref").alias("t"), get("relationship_type").alias("rel_type"))
    sro = sro.where("s <> '' and t <> '' and rel_type <> ''").select(concept_id(F.col("s")).alias("source"), concept_id(F.col("t")).alias("target"), "rel_type")
    made = held.where("source_ref is not null").select(F.col("concept_id").alias("source"), concept_id(F.col("source_ref")).alias("target"), F.lit("evidence-of").alias("rel_type"))
    shapes = stix.sparkSession.createDataFrame([(k, r, s, t) for k, (r, s, t) in SHAPES.items()], "rel_type string, relation string, sources array<string>, targets array<string>")
    kinds = held.groupBy("concept_id").agg(F.last("type_hint").alias("hint"))
    rows = sro.union(made).join(F.broadcast(shapes), "rel_type", "left")  # one row for each shape
    rows = rows.join(kinds.select(F.col("concept_id").alias("source"), F.col("hint").alias("source_type")), "source", "left").join(kinds.select(F.col("concept_id").alias("target"), F.col("hint").alias("target_type")), "target", "left")
    admitted = F.array_contains("sources", F.col("source_type")) & F.array_contains("targets", F.col("target_type"))
    return rows.select("source", "target", "rel_type", F.when(admitted, F.col("relation")).alias("relation"))


def post_sync(typed: DataFrame, edges: DataFrame) -> DataFrame:
    """Typed edges (source, target, relation) that aren't held yet, each once."""
    from tessera.operators.sync import missing_from

    return missing_from(typed.where("relation is not null").select("source", "target", "relation"), edges, ["source", "target", "relation"])
