"""The registered queries of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), 4096)


@register
def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.bpe_codec import encode

    coded = encode(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@register
def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.secrets import LEAST, scan

    found = scan(table(spark, sf_dir, "documents"))
    label = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    of_kind = lambda kind: F.filter("base", lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in LEAST]
    listed = {c: F.array_join(F.transform(c, label), ",") for c in ("base", "spans")}
    return found.select("doc_id", *counts, F.sha2(listed["base"].cast("binary"), 256).alias("base_sha256"), listed["spans"].alias("spans"))


@register
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.decontamination import build_index, search

    found = search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), window=10, slop=2)
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
    )


@register
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.warc import read, write

    pages = table(spark, sf_dir, "pages")
    read_back = read(spark, write(pages), pages.schema["page_id"].dataType, keep_payload=False)
    return read_back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sharding import shard

    packed = shard(table(spark, sf_dir, "documents"), 24)
    return packed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@register
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.kneser_ney import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.jaccard_join import link

    return link(table(spark, sf_dir, "documents"), percent=85, n=4)


@register
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.cross_entropy import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op4_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each document whose id is divisible by 20."""
    from tessera.llm.bm25 import build_index, search

    docs = table(spark, sf_dir, "documents")
    found = search(build_index(docs), docs.where("doc_id % 20 = 0"), k=10)
    return found.select("query", "doc_id", F.round("score", 5).alias("score"), "place")


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = f"regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLES["op4_bm25_topk"] = f"""WITH words AS (SELECT doc_id, {WORDS} AS w FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM words) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), stats AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM words), lengths AS (SELECT doc_id, len(w) AS size FROM words),
parts AS (SELECT q.doc_id AS query, t.doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * size / mean)) AS part
  FROM (SELECT doc_id, term FROM tf WHERE doc_id % 20 = 0) q JOIN tf t USING (term) JOIN df USING (term) JOIN lengths l ON l.doc_id = t.doc_id, stats),
scored AS (SELECT query, doc_id, round(sum(part), 9) AS score FROM parts GROUP BY ALL), placed AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT query, doc_id, round(score, 5) AS score, place FROM placed WHERE place <= 10"""

#: The exact matches of op6; SQL for the near ones would join every window with every place of its words.
EXACT_MATCHES = f"""WITH docs AS (SELECT doc_id, {WORDS} AS w FROM documents), items AS (SELECT item_id::VARCHAR AS item, {WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item, size, array_to_string(w[k:k + size - 1], ' ') AS gram FROM (SELECT item, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM items WHERE len(w) > 0)),
places AS (SELECT doc_id, k, size, array_to_string(w[k:k + size - 1], ' ') AS gram FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
found AS (SELECT doc_id, item, k, size FROM places JOIN windows USING (size, gram)), hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM found) GROUP BY doc_id),
listed AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS own FROM found GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(own), 0) AS n_items, sha256(coalesce(array_to_string(own, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN listed USING (doc_id)"""

BASE32 = "array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda s: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || substr(h, 5 * g + 1, 5))::INT >> s) & 31) + 1]), '')), '')"
ORACLES["op7_warc"] = f"""WITH hashed AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages), first AS (SELECT h, min(page_id) AS first FROM hashed GROUP BY h)
SELECT page_id, payload_bytes, {BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM hashed JOIN first USING (h)"""

ORACLES["op9_jaccard_join"] = f"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + least(4, len(w)) - 1], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS k FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id), sets AS (SELECT doc_id, n, md5(array_to_string(list_sort(list(gram)), '|')) AS name FROM grams JOIN sizes USING (doc_id) GROUP BY ALL),
nodes AS (SELECT name, n, min(doc_id) AS node FROM sets GROUP BY ALL), own AS (SELECT node, n, gram FROM nodes JOIN grams ON doc_id = node),
pairs AS (SELECT a.node AS a, b.node AS b FROM own a JOIN own b USING (gram) WHERE a.node < b.node AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reached AS (SELECT node AS a, node AS b FROM nodes UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(c.least, d.doc_id) AS component_id FROM documents d LEFT JOIN sets s USING (doc_id) LEFT JOIN nodes o USING (name) LEFT JOIN (SELECT a, min(b) AS least FROM reached GROUP BY a) c ON c.a = o.node"""
