"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, media_avi, quality, toxicity
from .common import fold_of, pick, table
from .decontaminate import decontaminate
from .license_scan import license_scan
from .ngram_join import ngram_join
from .secret_scan import secret_scan
from .url_filter import GLOBS, RULES, url_filter


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("detections")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(fold_of(F.col("doc_id")) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    out = bpe.bpe(docs)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.render(table(spark, sf_dir, "conversations"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.quality(docs, table(spark, sf_dir, "labels"))
    good = F.col("score") >= quality.KEEP
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "evidence", "host_rate", "path_rate", "score", good.cast("int").alias("predicted"), good.alias("keep"))


def op7_media_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media_avi.read(media_avi.media(table(spark, sf_dir, "documents")))
    clips = F.transform("clips", lambda c: F.concat_ws("-", c["first_frame"].cast("string"), c["n_frames"].cast("string"), F.format_number(c["brightness"], 2)))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.concat_ws(" ", clips).alias("feature"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(table(spark, sf_dir, "documents"))
    spans = F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), F.concat_ws(",", spans).alias("spans"), "n_inferred")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(pick(table(spark, sf_dir, "documents"), "doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "_items"), 256).alias("items_sha256"), (F.col("_n_hit") > 0).alias("contaminated"),
    )


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_license_scan, op3_toxicity, op4_bpe, op5_chat_format, op6_quality, op7_media_avi, op8_secret_scan, op9_decontaminate, op10_ngram_join)}


def _glob_sql(glob: str) -> str:
    """A glob as a regular expression over the whole canonical form."""
    return "(?s)" + "".join(".*" if c == "*" else "." if c == "?" else c if c.isalnum() else "\\" + c for c in glob)


def _url_filter_sql() -> str:
    rules = ", ".join(f"('{r}', '{a}')" for a, r in RULES)
    globs = ", ".join(f"('{g}', '{a}', '{_glob_sql(g)}')" for a, g in GLOBS)
    return rf"""
WITH rules(rule, action) AS (VALUES {rules}), globs(method_rule, action, pattern) AS (VALUES {globs}),
 cut AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
 raw AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM cut),
 parts AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM raw),
 urls AS (SELECT DISTINCT host, path FROM parts),
 fits AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action FROM urls JOIN rules
   ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, strpos(rule, '/'))) GROUP BY host, path),
 more AS (SELECT host, path, arg_max(method_rule, length(method_rule)) AS method_rule, arg_max(action, length(method_rule)) AS action FROM urls JOIN globs ON regexp_full_match('.' || host || '#' || path, pattern) GROUP BY host, path)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.action, m.action, 'allow') AS verdict, m.method_rule
FROM parts p LEFT JOIN fits f USING (host, path) LEFT JOIN more m USING (host, path)"""


ORACLE_SQL = {
    "op1_url_filter": _url_filter_sql(),
    "op5_chat_format": chat_format.SQL,
    "op10_ngram_join": r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 grams AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 4) - 1], ' ') AS g FROM words, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS u(i) WHERE len(w) > 0),
 sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
 shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
 links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * i >= 85 * (p.n + q.n - i)),
 reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) USING (doc_id)""",
    "op9_decontaminate": r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
 windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g FROM items, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS u(i) WHERE len(w) > 0),
 sizes AS (SELECT DISTINCT size FROM windows),
 grams AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS g FROM words, sizes, unnest(range(1, len(w) - size + 2)) AS u(i)),
 found AS (SELECT doc_id, grams.size, i, item_id FROM grams JOIN windows ON grams.g = windows.g AND grams.size = windows.size),
 hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT doc_id, i, size FROM found), unnest(range(0, size)) AS v(k) GROUP BY doc_id),
 its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS list FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""",
}
