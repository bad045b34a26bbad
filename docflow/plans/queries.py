"""Registered queries of the library's own operators over the driver's tables, and their DuckDB counterparts.

The tables stand in for document images: a document is an image, its source the folder, a line item a text box.
Inputs are derived by whole-number arithmetic, so Spark and DuckDB start from the same values.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docflow.config import DEFAULTS, UNITS, VOCABULARY
from docflow.functions import geometry, text, vectors
from docflow.operators import classify, images, layout, lines, models, vocabulary
from docflow.plans import pipeline
from docflow.schemas import DECISION
from docflow.sources import manifest, stores
from docflow.sources.buckets import Buckets
from docflow.sources.work import work_dir
from docflow.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- manifest, stores -------------------------------------------------------------------------------------

ENDINGS = (".jpg", ".JPEG", ".png", ".txt", ".PNG")
ITEMS_SQL = f"""files AS (SELECT coalesce(source, '') AS folder_name, doc_id || list_extract({list(ENDINGS)}, 1 + (doc_id % 5)::INT) AS file_name, doc_id AS scan_pos FROM documents),
    items AS (SELECT * FROM files WHERE regexp_matches(lower(file_name), '\\.(jpg|jpeg|png)$'))"""
WHITE_SQL = "[\\x09-\\x0D\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
ENDS_SQL = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]"
NO_LINES = "[]::VARCHAR[]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WHITE_SQL}+|{WHITE_SQL}+$', '', 'g')"


def lines_sql(x: str) -> str:
    return f"coalesce(list_filter(list_transform(string_split_regex({x}, '{ENDS_SQL}'), lambda s: {strip_sql('s')}), lambda s: s <> ''), {NO_LINES})"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("doc_id") % 5 + 1).cast("int"))
    return docs.select(F.coalesce("source", F.lit("")).alias("folder_name"), F.concat(F.col("doc_id").cast("string"), ending).alias("file_name"), F.col("doc_id").alias("scan_pos"))


def marked(spark: SparkSession, sf_dir: str, condition: str) -> DataFrame:
    """Files with a label that meets a condition."""
    labels = table(spark, sf_dir, "labels").where(condition).select(F.col("doc_id").alias("scan_pos"), "quality", "toxic")
    return files(spark, sf_dir).join(labels, "scan_pos")


@query(f"""WITH {ITEMS_SQL}, scan AS (SELECT * FROM items ORDER BY scan_pos LIMIT {DEFAULTS.max_raw_scan})
    SELECT folder_name, file_name, scan_pos FROM scan WHERE scan_pos NOT IN (SELECT doc_id FROM labels) ORDER BY scan_pos LIMIT {DEFAULTS.fetch_limit}""")
def manifest_cap_skip_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = manifest.only_images(files(spark, sf_dir))
    return manifest.manifest(items, marked(spark, sf_dir, "true")).select("folder_name", "file_name", "scan_pos")


@query(f"""WITH {ITEMS_SQL} SELECT folder_name, file_name FROM files JOIN labels ON doc_id = scan_pos WHERE quality = 1
    UNION SELECT folder_name, file_name FROM files JOIN labels ON doc_id = scan_pos WHERE toxic = 1""")
def skip_key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.union_keys(marked(spark, sf_dir, "quality = 1"), marked(spark, sf_dir, "toxic = 1"))


@query(f"WITH {ITEMS_SQL} SELECT folder_name, file_name, folder_name || '/' || file_name AS item_key, lower(regexp_extract(file_name, '\\.[^.]*$')) AS extension FROM items")
def ext_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest.only_images(files(spark, sf_dir))
    return rows.select("folder_name", "file_name", text.item_key(F.col("folder_name"), F.col("file_name")).alias("item_key"), text.extension(F.col("file_name")).alias("extension"))


@query(f"""WITH {ITEMS_SQL} SELECT folder_name, file_name, scan_pos FROM files ANTI JOIN labels ON doc_id = scan_pos AND quality = 1""")
def stage_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.without(files(spark, sf_dir), marked(spark, sf_dir, "quality = 1")).select("folder_name", "file_name", "scan_pos")


@query(f"""WITH {ITEMS_SQL} SELECT folder_name, file_name, CASE WHEN quality = 1 THEN 'cached' ELSE 'classify' END AS work,
    CASE WHEN quality = 1 THEN toxic = 1 END AS is_handwritten FROM files LEFT JOIN labels ON doc_id = scan_pos""")
def cache_hit_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    fp = F.when(F.col("quality") == 1, DEFAULTS.fingerprint()).otherwise("stale")
    cache = marked(spark, sf_dir, "true").select("folder_name", "file_name", F.struct((F.col("toxic") == 1).alias("is_handwritten"), fp.alias("_cfg")).alias("decision"))
    hits, misses = classify.cache_split(files(spark, sf_dir), cache)
    kept = hits.select("folder_name", "file_name", F.lit("cached").alias("work"), "decision.is_handwritten")
    return kept.unionByName(misses.select("folder_name", "file_name", F.lit("classify").alias("work"), F.lit(None).cast("boolean").alias("is_handwritten")))


@query(f"""WITH {ITEMS_SQL} SELECT CASE WHEN toxic = 1 THEN 'handwritten' ELSE 'printed' END AS kind, count(*) AS n, min(scan_pos) AS first
    FROM files LEFT JOIN labels ON doc_id = scan_pos GROUP BY 1""")
def manifest_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = marked(spark, sf_dir, "true").select("folder_name", "file_name", F.struct((F.col("toxic") == 1).alias("is_handwritten")).alias("decision"))
    printed, hand = classify.routed(files(spark, sf_dir).join(decided, ["folder_name", "file_name"], "left"))
    both = printed.withColumn("kind", F.lit("printed")).unionByName(hand.withColumn("kind", F.lit("handwritten")))
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.min("scan_pos").alias("first"))


def transcriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").cast("string").alias("folder_name"), F.col("turn").cast("string").alias("file_name"), text.lines(F.col("text")).alias("lines"))


TRANSCRIPTIONS_SQL = f"t AS (SELECT conv_id::VARCHAR AS folder_name, turn::VARCHAR AS file_name, {lines_sql('text')} AS lines FROM conversations)"


@query(f"WITH {TRANSCRIPTIONS_SQL} SELECT folder_name, file_name, len(lines) AS n_lines, array_to_string(lines, chr(10)) AS content FROM t")
def nested_store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folders = stores.nested(transcriptions(spark, sf_dir)).select(F.to_json(F.map_from_arrays(F.array("folder_name"), F.array("files"))).alias("document"))
    rows = stores.long_form(folders, "document", stores.LINES, "lines")
    return rows.select("folder_name", "file_name", F.size("lines").cast("long").alias("n_lines"), F.array_join("lines", "\n").alias("content"))


@query(f"WITH {TRANSCRIPTIONS_SQL} SELECT folder_name, file_name, pos::INT AS line_no, lines[pos] AS line FROM t, unnest(generate_series(1, len(lines))) AS u(pos)")
def text_to_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transcriptions(spark, sf_dir).select("folder_name", "file_name", F.posexplode("lines").alias("pos", "line"))
    return rows.select("folder_name", "file_name", (F.col("pos") + 1).alias("line_no"), "line")


LINE_REST = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query(f"""SELECT l_orderkey, l_linenumber, {', '.join(LINE_REST)} FROM lineitem QUALIFY row_number() OVER (
    PARTITION BY l_orderkey, l_linenumber ORDER BY (l_linestatus = 'O') DESC, {', '.join(c + ' DESC NULLS LAST' for c in LINE_REST)}) = 1""")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *LINE_REST)
    new = F.col("l_linestatus") == "O"
    return stores.upsert(rows.where(~new), rows.where(new), ["l_orderkey", "l_linenumber"], LINE_REST)


@query(f"""WITH {ITEMS_SQL}, {TRANSCRIPTIONS_SQL}, p AS (SELECT folder_name, file_name, {lines_sql('text')} AS lines FROM files JOIN documents ON doc_id = scan_pos)
    SELECT folder_name, file_name, 'printed' AS kind, len(lines)::INT AS n_lines, array_to_string(lines, chr(10)) AS content FROM p
    UNION ALL SELECT folder_name, file_name, 'handwritten', len(lines)::INT, array_to_string(lines, chr(10)) FROM t""")
def merge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("scan_pos"), text.lines(F.col("text")).alias("lines"))
    return stores.report(files(spark, sf_dir).join(docs, "scan_pos"), transcriptions(spark, sf_dir))


@query("""SELECT (SELECT count(*) FROM documents) + (SELECT count(*) FROM conversations) AS images, (SELECT count(*) FROM documents) AS printed,
    (SELECT count(*) FROM conversations) AS handwritten""")
def store_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    printed = files(spark, sf_dir).select("folder_name", "file_name", F.array().cast("array<string>").alias("lines"))
    return stores.counters(stores.report(printed, transcriptions(spark, sf_dir)))


@query(f"SELECT conv_id, turn, len({lines_sql('text')})::INT AS n_lines FROM conversations")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A streaming run over a table that is there, put into a keyed table that is then read."""
    path, folder = f"{sf_dir}/conversations.parquet", work_dir(spark)
    items = spark.readStream.schema(spark.read.parquet(path).schema).option("recursiveFileLookup", True).parquet(path)
    work = lambda rows: rows.select("conv_id", "turn", F.size(text.lines(F.col("text"))).alias("n_lines"))
    ingest.ingest(items, f"{folder}/store", f"{folder}/checkpoint", work, ["conv_id", "turn"])
    return Buckets(spark, f"{folder}/store", ["conv_id", "turn"]).rows()


VERSIONS = 3


@query(f"""SELECT doc_id % 4000 AS item, doc_id % {VERSIONS} AS version, doc_id, n_chars FROM documents
    QUALIFY row_number() OVER (PARTITION BY doc_id % 4000 ORDER BY doc_id % {VERSIONS} DESC, doc_id DESC) = 1""")
def keyed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as versions of items, committed to a keyed table in several batches, the first of them twice; of an item
    the last batch counts, and within it the last document."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select((F.col("doc_id") % 4000).alias("item"), (F.col("doc_id") % VERSIONS).alias("version"), "doc_id", "n_chars")
    store = Buckets(spark, f"{work_dir(spark)}/items", ["item"], 16)
    for k in (0, *range(VERSIONS)):
        store.put(rows.where(F.col("version") == k), ["doc_id"], "versions", k)
    return store.rows()


# --- boxes, reading order ---------------------------------------------------------------------------------

BOX_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
BOXES_SQL = f"""b AS (SELECT l_suppkey AS page, (l_partkey % 4) * 400 + (l_partkey % 17) * 5 AS x1, (l_orderkey * 7 + l_linenumber * 13) % 1500 AS y1,
      x1 + 60 + l_linenumber * 10 AS x2, y1 + 20 AS y2, ((l_partkey * 7 + l_orderkey * 11) % 101)::DOUBLE / 100 AS score,
      row_number() OVER (PARTITION BY l_suppkey ORDER BY l_linenumber % 2, {', '.join(BOX_ORDER)}) AS ins FROM lineitem),
    k AS (SELECT *, round_even(x1 / 10.0, 0) AS k1, round_even(y1 / 10.0, 0) AS k2, round_even(x2 / 10.0, 0) AS k3, round_even(y2 / 10.0, 0) AS k4 FROM b),
    e AS (SELECT page, x1, y1, x2, y2, score, min(k.ins) OVER (PARTITION BY page, k1, k2, k3, k4) AS ins, (x1 + x2) / 2.0::DOUBLE AS x, (y1 + y2) / 2.0::DOUBLE AS y FROM k
      QUALIFY row_number() OVER (PARTITION BY page, k1, k2, k3, k4 ORDER BY score DESC, k.ins) = 1)"""
COLUMNS_SQL = f"""g AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY page ORDER BY x, ins) > {DEFAULTS.column_gap} THEN 1 ELSE 0 END AS s FROM e),
    c AS (SELECT page, ins, x, y, score, sum(s) OVER (PARTITION BY page ORDER BY x, ins ROWS UNBOUNDED PRECEDING)::INT AS col_id FROM g)"""
ROWS_SQL = f"""a AS (SELECT page, col_id, list_reduce(list_transform(list_sort(list(y)), lambda v: [v]),
      lambda a, v: CASE WHEN v[1] - a[len(a)] > {DEFAULTS.row_tolerance} THEN list_concat(a, v) ELSE a END) AS anchors FROM c GROUP BY page, col_id),
    r AS (SELECT c.*, (len(list_filter(anchors, lambda t: t <= y)) - 1)::INT AS row_id FROM c JOIN a USING (page, col_id))"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    rows = rows.repartition(layout.tasks_for(rows), "l_suppkey")
    w = Window.partitionBy("l_suppkey").orderBy(F.col("l_linenumber") % 2, *BOX_ORDER)
    x1 = (F.col("l_partkey") % 4) * 400 + (F.col("l_partkey") % 17) * 5
    y1 = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 1500
    box = F.array(x1, y1, x1 + 60 + F.col("l_linenumber") * 10, y1 + 20).cast("array<int>")
    score = ((F.col("l_partkey") * 7 + F.col("l_orderkey") * 11) % 101).cast("double") / 100
    return rows.select(F.col("l_suppkey").alias("page"), F.row_number().over(w).cast("long").alias("ins"), box.alias("box"), F.lit("").alias("text"), score.alias("score"))


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.best_readings(boxes(spark, sf_dir), tasks=layout.tasks_for(table(spark, sf_dir, "lineitem")))


@query(f"WITH {BOXES_SQL} SELECT page, ins, x1, y1, x2, y2, score FROM e")
def ensemble_box_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = merged(spark, sf_dir)
    return best.select("page", "ins", *[F.col("box")[k].cast("long").alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))], "score")


@query(f"WITH {BOXES_SQL} SELECT page, ins, (x1 + x2) / 2.0::DOUBLE AS x, (y1 + y2) / 2.0::DOUBLE AS y FROM b")
def box_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.centred(boxes(spark, sf_dir)).select("page", "ins", "x", "y")


@query(f"WITH {BOXES_SQL}, {COLUMNS_SQL} SELECT page, ins, x, col_id FROM c")
def column_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.columns(layout.centred(merged(spark, sf_dir))).select("page", "ins", "x", "col_id")


@query(f"WITH {BOXES_SQL}, {COLUMNS_SQL}, {ROWS_SQL} SELECT page, ins, y, col_id, row_id FROM r")
def row_clusters_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.rows(layout.columns(layout.centred(merged(spark, sf_dir)))).select("page", "ins", "y", "col_id", "row_id")


@query(f"""WITH {BOXES_SQL}, {COLUMNS_SQL}, {ROWS_SQL} SELECT page, ins, col_id, row_id, score,
    row_number() OVER (PARTITION BY page ORDER BY col_id, row_id, x, y, ins)::INT AS line_no FROM r""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.reading_order(layout.centred(merged(spark, sf_dir))).select("page", "ins", "col_id", "row_id", "score", "line_no")


# --- text -------------------------------------------------------------------------------------------------


@query(f"""WITH l AS (SELECT doc_id, pos::INT AS pos, parts[pos] AS text, ((doc_id * 7 + pos * 11) % 101)::DOUBLE / 100 AS score
      FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '{ENDS_SQL}') AS parts FROM documents), unnest(generate_series(1, len(parts))) AS u(pos)), s AS (SELECT *, {strip_sql('text')} AS t FROM l)
    SELECT doc_id, pos, score, length(t)::INT AS n FROM s WHERE t <> '' AND score >= CASE WHEN length(t) >= {DEFAULTS.long_text_chars} THEN {DEFAULTS.long_text_confidence}::DOUBLE ELSE {DEFAULTS.confidence}::DOUBLE END""")
def confidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    parts = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), text.LINE_END, -1)).alias("pos", "text"))
    scored = parts.select("doc_id", (F.col("pos") + 1).alias("pos"), "text").withColumn("score", ((F.col("doc_id") * 7 + F.col("pos") * 11) % 101).cast("double") / 100)
    return layout.confident(scored).select("doc_id", "pos", "score", F.char_length(text.strip(F.col("text"))).alias("n"))


UNIT_ROWS = [(-k - 1, f"72 {u.upper()} x") for k, (u, _) in enumerate(UNITS)] + [(-90, "120 mmHg at 72 BPM"), (-91, ""), (-92, None)]


@query(
    "WITH d AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES "
    + ", ".join(f"({k}, {'NULL' if t is None else repr(t)})" for k, t in UNIT_ROWS)
    + ")) SELECT doc_id, CASE "
    + " ".join(f"WHEN contains(lower(text), '{u}') THEN '{label}'" for u, label in UNITS)
    + " END AS vitals_type FROM d"
)
def vitals_unit_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(UNIT_ROWS, "doc_id long, text string"))
    return rows.select("doc_id", text.unit_tag(F.col("text")).alias("vitals_type"))


TERMS_SQL = "(VALUES " + ", ".join(f"({k}, '{t}')" for k, t in enumerate(VOCABULARY)) + ")"


@query(f"""WITH v(pos, term) AS (SELECT * FROM {TERMS_SQL}), t AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN term WHEN 1 THEN left(term, length(term) - 1)
      WHEN 2 THEN term || 'x' WHEN 3 THEN 'q' || substr(term, 2) ELSE p_name END AS text, (p_partkey * 7 % 101)::DOUBLE / 100 AS score
      FROM part JOIN v ON pos = p_partkey % {len(VOCABULARY)}),
    m AS (SELECT p_partkey, pos, term, length(term) - bit_count(list_reduce(list_transform(string_split(text, ''), lambda c: list_sum(list_transform(range(1, length(term) + 1),
        lambda i: CASE WHEN term[i] = c THEN 1::BIGINT << (i - 1)::INT ELSE 0::BIGINT END))::BIGINT),
        lambda s, b: ((s + (s & b)) | (s - (s & b))) & ((1::BIGINT << length(term)::INT) - 1), ((1::BIGINT << length(term)::INT) - 1)::BIGINT)) AS lcs, text, score FROM t, v WHERE score < 0.85 AND text <> ''),
    best AS (SELECT p_partkey, arg_max(term, [200.0 * lcs / (length(text) + length(term)), -pos]) AS term, max(200.0 * lcs / (length(text) + length(term))) AS s FROM m GROUP BY p_partkey)
    SELECT t.p_partkey, t.score, t.text, CASE WHEN s >= {DEFAULTS.vocabulary_threshold} THEN term ELSE t.text END AS corrected FROM t LEFT JOIN best USING (p_partkey)""")
def vocab_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    term = F.element_at(F.array(*map(F.lit, VOCABULARY)), (p % len(VOCABULARY) + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", term.alias("term"), ((p * 7 % 101).cast("double") / 100).alias("score"))
    t, kind = F.col("term"), F.col("p_partkey") % 5
    changed = F.when(kind == 0, t).when(kind == 1, F.substring(t, F.lit(1), F.char_length(t) - 1)).when(kind == 2, F.concat(t, F.lit("x"))).when(kind == 3, F.concat(F.lit("q"), F.substring(t, F.lit(2), F.char_length(t)))).otherwise(F.col("p_name"))
    rows = rows.select("p_partkey", "score", changed.alias("text"))
    return layout.with_corrections(rows.withColumn("read", F.col("text"))).select("p_partkey", "score", F.col("read").alias("text"), F.col("text").alias("corrected"))


WORDS_SQL = "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS {} FROM {}"


@query(f"""WITH t AS ({WORDS_SQL.format('term', 'benchmark')}), r AS ({WORDS_SQL.format('text', 'conversations')}),
    k AS (SELECT term, length(term) AS n, map_from_entries(list_transform(list_distinct(string_split(term, '')), lambda c: struct_pack(k := c, v := list_sum(list_transform(range(1, length(term) + 1), lambda i: CASE WHEN term[i] = c THEN 1::BIGINT << (i - 1)::INT ELSE 0::BIGINT END))::BIGINT))) AS masks FROM t),
    c AS (SELECT text, term, length(text) AS m, n, n - bit_count(list_reduce(list_transform(string_split(text, ''), lambda x: coalesce(masks[x], 0)::BIGINT), lambda s, b: ((s + (s & b)) | (s - (s & b))) & ((1::BIGINT << n::INT) - 1), ((1::BIGINT << n::INT) - 1)::BIGINT)) AS lcs
        FROM r, k WHERE 200 * least(length(text), n) >= {DEFAULTS.vocabulary_threshold} * (length(text) + n))
    SELECT text, term, 200.0::DOUBLE * lcs / (m + n) AS score FROM c WHERE 200.0::DOUBLE * lcs / (m + n) >= {DEFAULTS.vocabulary_threshold}
    QUALIFY row_number() OVER (PARTITION BY text ORDER BY 200.0::DOUBLE * lcs / (m + n) DESC, term) = 1""")
def vocab_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct words of conversations against those of the benchmark as a vocabulary, by the index of letter pairs."""
    words = lambda name, into: table(spark, sf_dir, name).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0)).alias(into)).distinct()
    return vocabulary.matched(words("conversations", "text"), words("benchmark", "term"), DEFAULTS.vocabulary_threshold)


def requests(rows: DataFrame, folder: Column, file: Column, body: Column) -> DataFrame:
    """Rows as pages to transcribe: bytes that begin as a JPEG's do go into a request as they are."""
    return rows.select(folder.cast("string").alias("folder_name"), F.concat(file.cast("string"), F.lit(".jpg")).alias("file_name"), F.concat(F.lit(b"\xff\xd8"), F.coalesce(body, F.lit("")).cast("binary")).alias("content"))


def number(name: str) -> Column:
    """The number that a requested file is named by."""
    return F.regexp_extract("file_name", r"^(-?\d+)\.jpg$", 1).cast("long").alias(name)


@query("SELECT doc_id, 'image/jpeg ' || base64('\\xFF\\xD8'::BLOB || encode(coalesce(text, ''))) AS payload FROM documents")
def base64_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a request says: the type and base64 of each page, as the transcription stage makes them."""
    pages = requests(table(spark, sf_dir, "documents"), F.lit("f"), F.col("doc_id"), F.col("text"))
    answers = models.transcribed(pages, lambda: lambda image, mime: f"{mime} {image}")
    return answers.where("status = 'ok'").select(number("doc_id"), F.col("text").alias("payload"))


@query("SELECT conv_id, turn, coalesce(text, '') AS content FROM conversations")
def response_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What answers of the service say: each turn's text in the wire format, read as the transcription stage reads it."""
    wire = F.to_json(F.struct(F.array(F.struct(F.struct(F.coalesce("text", F.lit("")).alias("content")).alias("message"))).alias("choices")))
    pages = requests(table(spark, sf_dir, "conversations").withColumn("wire", wire), F.col("conv_id"), F.col("turn"), F.col("wire"))
    answers = models.transcribed(pages, lambda: lambda image, mime: models.said(base64.b64decode(image)[2:]), wait=0.0)
    return answers.where("status = 'ok'").select(F.col("folder_name").cast("long").alias("conv_id"), number("turn"), F.col("text").alias("content"))


@query("""WITH p AS (SELECT doc_id, string_split(text, ' ') AS a, string_split(text, chr(10)) AS b FROM documents)
    SELECT doc_id, least(len(a), len(b))::INT AS n, a[least(len(a), len(b))] AS last_word, b[least(len(a), len(b))] AS last_line FROM p""")
def zip_shorter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arrays joined by place, up to the shorter one's end."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ", -1).alias("a"), F.split("text", "\n", -1).alias("b"))
    pairs = rows.select("doc_id", vectors.zip_shorter(F.col("a"), F.col("b")).alias("z"))
    return pairs.select("doc_id", F.size("z").alias("n"), F.element_at("z", -1)["a"].alias("last_word"), F.element_at("z", -1)["b"].alias("last_line"))


@query(f"SELECT event_id, least(event_id % 5 + 1, {DEFAULTS.attempts})::INT AS attempts, CASE WHEN event_id % 5 < {DEFAULTS.attempts} THEN 'ok' ELSE 'failed' END AS status FROM events")
def retry_status_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests that fail event_id % 5 times: the stored ones and the dead letters."""

    def load():
        seen: dict[str, int] = {}

        def ask(image: str, mime: str) -> str:
            event = int(base64.b64decode(image)[2:])
            seen[image] = seen.get(image, 0) + 1
            if seen[image] <= event % 5:
                raise RuntimeError(f"failed at attempt {seen[image]}")
            return f"read at attempt {seen.pop(image)}"

        return ask

    pages = requests(table(spark, sf_dir, "events"), F.lit("f"), F.col("event_id"), F.col("event_id").cast("string"))
    rows = models.transcribed(pages, load, wait=0.0)
    attempts = F.regexp_extract(F.coalesce("text", "error"), r"attempt (\d+)$", 1).cast("int").alias("attempts")
    return rows.select(number("event_id"), attempts, "status")


# --- classification ---------------------------------------------------------------------------------------


@query(f"""WITH s AS (SELECT p_partkey, p_size * 37 % 97 AS h, p_partkey % 53 AS w FROM part), t AS (SELECT *, r, c, h * r // 3 AS y0, h * (r + 1) // 3 AS y1, w * c // 2 AS x0, w * (c + 1) // 2 AS x1
      FROM s, range(3) AS a(r), range(2) AS b(c)) SELECT p_partkey, r::INT AS tile_row, c::INT AS tile_col, y0::INT AS y0, y1::INT AS y1, x0::INT AS x0, x1::INT AS x1 FROM t WHERE y1 > y0 AND x1 > x0""")
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 37 % 97).alias("h"), (F.col("p_partkey") % 53).alias("w"))
    return rows.select("p_partkey", F.inline(geometry.tiles(F.col("h"), F.col("w"), DEFAULTS.tile_grid)))


@query(f"""WITH s AS (SELECT p_partkey, p_size * 97 AS h, p_partkey % 4001 + 1 AS w FROM part) SELECT p_partkey,
    (CASE WHEN greatest(h, w) > {DEFAULTS.classifier_max_side} THEN floor(h * ({DEFAULTS.classifier_max_side}::DOUBLE / greatest(h, w))) ELSE h END)::INT AS height,
    (CASE WHEN greatest(h, w) > {DEFAULTS.classifier_max_side} THEN floor(w * ({DEFAULTS.classifier_max_side}::DOUBLE / greatest(h, w))) ELSE w END)::INT AS width FROM s""")
def resize_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 97).cast("long").alias("h"), (F.col("p_partkey") % 4001 + 1).alias("w"))
    cap = DEFAULTS.classifier_max_side
    return rows.select("p_partkey", geometry.resized(F.col("h"), F.col("w"), cap).cast("int").alias("height"), geometry.resized(F.col("w"), F.col("h"), cap).cast("int").alias("width"))


TILES_SQL = "t AS (SELECT vec_id // 6 AS page, (vec_id * 37 % 50)::DOUBLE / 100 AS ink, (vec_id * 13 % 101)::DOUBLE / 100 AS h, 1 - h AS p FROM embeddings)"
VOTES_SQL = f"""v AS (SELECT page, count(*) AS tiles, count(*) FILTER (ink >= {DEFAULTS.min_tile_weight}::DOUBLE) AS n, coalesce(sum(ink) FILTER (ink >= {DEFAULTS.min_tile_weight}::DOUBLE), 0) AS w,
      coalesce(sum(ink) FILTER (ink >= {DEFAULTS.min_tile_weight}::DOUBLE AND h >= {DEFAULTS.handwritten_threshold}::DOUBLE AND h - p >= {DEFAULTS.handwritten_margin}::DOUBLE), 0) AS hw FROM t GROUP BY page)"""


def tile_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    h = (v * 13 % 101).cast("double") / 100
    return table(spark, sf_dir, "embeddings").select(F.floor(v / 6).alias("page"), ((v * 37 % 50).cast("double") / 100).alias("ink"), h.alias("p_handwritten"), (1 - h).alias("p_printed"))


@query(f"WITH {TILES_SQL}, {VOTES_SQL} SELECT page, n AS non_blank_tiles, round(w, 6) AS ink, round(hw, 6) AS hand_ink, round(CASE WHEN w > 0 THEN hw / w END, 6) AS handwritten_ratio FROM v")
def tile_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = classify.tile_votes(tile_rows(spark, sf_dir), ["page"])
    return votes.select("page", "non_blank_tiles", *[F.round(c, 6).alias(c) for c in ("ink", "hand_ink", "handwritten_ratio")])


@query(f"""WITH {TILES_SQL}, {VOTES_SQL}, g AS (SELECT *, (page * 29 % 101)::DOUBLE / 100 AS gh, 1 - gh AS gp, page % 7 = 0 AS tabular FROM v)
    SELECT page, CASE WHEN tabular THEN 'structural_table_override' WHEN gp >= 0.4::DOUBLE AND gp - gh >= 0.08::DOUBLE THEN 'whole_page_printed' WHEN gh >= 0.85::DOUBLE AND gh - gp >= 0.4::DOUBLE THEN 'whole_page_handwritten'
      WHEN n = 0 OR w <= 0 THEN 'all_tiles_blank' WHEN n < 4 THEN 'insufficient_tile_evidence' ELSE 'tile_vote' END AS decision,
      CASE decision WHEN 'whole_page_handwritten' THEN true WHEN 'tile_vote' THEN hw / w >= 0.75::DOUBLE ELSE false END AS is_handwritten,
      CASE WHEN decision IN ('tile_vote', 'insufficient_tile_evidence') THEN n::INT END AS non_blank_tiles FROM g""")
def page_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ladder: ruled lines, whole page, tiles."""
    votes = classify.tile_votes(tile_rows(spark, sf_dir), ["page"])
    h = (F.col("page") * 29 % 101).cast("double") / 100
    pages = votes.withColumn("p_handwritten", h).withColumn("p_printed", 1 - h).withColumn("tabular", F.col("page") % 7 == 0)
    return classify.decided(pages).select("page", "decision.decision", "decision.is_handwritten", "decision.non_blank_tiles")


ZERO_SQL = """n AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM n),
    z AS (SELECT u.vec_id, 100 * list_dot_product(u.e, a.e) AS sa, 100 * list_dot_product(u.e, b.e) AS sb FROM u, (SELECT e FROM u WHERE vec_id = 0) a, (SELECT e FROM u WHERE vec_id = 1) b),
    q AS (SELECT vec_id, exp(sa - greatest(sa, sb)) / (exp(sa - greatest(sa, sb)) + exp(sb - greatest(sa, sb))) AS p, exp(sb - greatest(sa, sb)) / (exp(sa - greatest(sa, sb)) + exp(sb - greatest(sa, sb))) AS h FROM z)"""


def zero_shot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of two prompts, the first two vectors, for all vectors; the prompts are literals of the plan."""
    vecs = table(spark, sf_dir, "embeddings")
    prompts = [F.array(*map(F.lit, r.embedding)) for r in vecs.where("vec_id in (0, 1)").orderBy("vec_id").collect()]
    p, h = vectors.zero_shot(F.col("embedding"), prompts)
    return vecs.select("vec_id", p.alias("p_printed"), h.alias("p_handwritten"))


@query(f"WITH {ZERO_SQL} SELECT vec_id, round(p, 6) AS p_printed, round(h, 6) AS p_handwritten FROM q")
def zero_shot_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zero_shot_rows(spark, sf_dir).select("vec_id", F.round("p_printed", 6).alias("p_printed"), F.round("p_handwritten", 6).alias("p_handwritten"))


@query(f"""WITH {ZERO_SQL} SELECT vec_id, CASE WHEN p >= 0.4::DOUBLE AND p - h >= 0.08::DOUBLE THEN 'whole_page_printed' WHEN h >= 0.85::DOUBLE AND h - p >= 0.4::DOUBLE THEN 'whole_page_handwritten' END AS decision FROM q""")
def whole_page_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zero_shot_rows(spark, sf_dir).select("vec_id", classify.page_shortcut(F.col("p_printed"), F.col("p_handwritten")).alias("decision"))


@query(f"""WITH s AS (SELECT l_suppkey AS page, 1000 AS height, 800 AS width, l_partkey % 800 AS x1, l_orderkey % 1000 AS y1, (l_partkey * 7 + l_linenumber * 3) % 800 AS x2, l_orderkey % 1000 + (l_partkey % 5) * 3 AS y2 FROM lineitem
      UNION ALL SELECT l_suppkey, 1000, 800, l_partkey % 800, l_orderkey % 300, l_partkey % 800 + l_linenumber % 4, 300 + l_orderkey % 700 FROM lineitem),
    m AS (SELECT *, sqrt(((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))::DOUBLE) AS l, abs(degrees(atan2((y2 - y1)::DOUBLE, (x2 - x1)::DOUBLE))) AS a FROM s),
    f AS (SELECT page, l >= floor(least(height, width) * 0.35::DOUBLE) AND (a <= 5 OR a >= 175) AND l >= width * 0.35::DOUBLE AS hor, l >= floor(least(height, width) * 0.35::DOUBLE) AND a BETWEEN 85 AND 95 AND l >= height * 0.35::DOUBLE AS ver FROM m)
    SELECT page, count(*) FILTER (hor) AS horizontal, count(*) FILTER (ver AND NOT hor) AS vertical, count(*) FILTER (hor) >= 4 AND count(*) FILTER (ver AND NOT hor) >= 1 AS tabular FROM f GROUP BY page""")
def line_orientation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    p, o, n = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber")
    size = [F.col("l_suppkey").alias("page"), F.lit(1000).alias("height"), F.lit(800).alias("width")]
    ends = lambda *c: [x.cast("long").alias(n) for x, n in zip(c, ("x1", "y1", "x2", "y2"), strict=True)]
    one = rows.select(*size, *ends(p % 800, o % 1000, (p * 7 + n * 3) % 800, o % 1000 + (p % 5) * 3))
    two = rows.select(*size, *ends(p % 800, o % 300, p % 800 + n % 4, 300 + o % 700))
    return classify.ruled_lines(one.unionByName(two), ["page"])


#: A page for each document: a dashed line, 21 pixels and places 10 apart, and a short one that is left out.
RULED = {"threshold": 40, "spread": 1, "gap": 10}
COS_SQL, SIN_SQL = (lambda a, v=v: f"list_extract({v}, ({a} + 1)::INT)" for v in (lines.COS, lines.SIN))
RULED_SQL = f"""d AS (SELECT doc_id, doc_id * 29 % 180 AS a0, doc_id * 13 % 300 AS o0, 60 + coalesce(n_chars, 0) % 120 AS size FROM documents),
    g AS (SELECT doc_id, a0, o0, size, t FROM d, unnest(range(0, size)) AS u(t) WHERE t % 30 < 21 UNION ALL SELECT doc_id, a0, o0 + 60, size, t FROM d, unnest(range(0, 30)) AS u(t)),
    p AS (SELECT doc_id, (o0 * {COS_SQL('a0')} - t * {SIN_SQL('a0')} + 524288) >> 20 AS x, (o0 * {SIN_SQL('a0')} + t * {COS_SQL('a0')} + 524288) >> 20 AS y, a0 FROM g),
    q AS (SELECT doc_id, x, y, (a0 + s + 180) % 180 AS angle, (x * {COS_SQL('angle')} + y * {SIN_SQL('angle')} + 524288) >> 20 AS o FROM p, unnest([-1, 0, 1]) AS u(s)),
    v AS (SELECT doc_id, angle, o, count(*) AS votes FROM q GROUP BY ALL HAVING count(*) >= 40),
    n AS (SELECT v.doc_id, v.angle, v.o, v.votes FROM v ANTI JOIN (SELECT doc_id, (angle + i + 180) % 180 AS angle, CASE WHEN angle + i BETWEEN 0 AND 179 THEN o ELSE -o END + j AS o, votes, angle AS a, o AS b
        FROM v, unnest(range(-3, 4)) AS e(i), unnest(range(-3, 4)) AS f(j)) w ON v.doc_id = w.doc_id AND v.angle = w.angle AND v.o = w.o AND (w.votes > v.votes OR (w.votes = v.votes AND (w.a < v.angle OR (w.a = v.angle AND w.b < v.o))))),
    l AS (SELECT DISTINCT doc_id, n.angle, n.o AS line, votes, (y * {COS_SQL('q.angle')} - x * {SIN_SQL('q.angle')} + 524288) >> 20 AS t FROM n JOIN q USING (doc_id, angle) WHERE abs(q.o - n.o) <= {lines.BAND}),
    s AS (SELECT *, CASE WHEN t - lag(t) OVER w > 10 THEN 1 ELSE 0 END AS s FROM l WINDOW w AS (PARTITION BY doc_id, angle, line ORDER BY t)),
    i AS (SELECT *, sum(s) OVER (PARTITION BY doc_id, angle, line ORDER BY t ROWS UNBOUNDED PRECEDING) AS island FROM s),
    e AS (SELECT doc_id, angle, line, votes, island, min(t) AS a, max(t) AS b FROM i GROUP BY ALL HAVING max(t) - min(t) >= 50)"""


@query(f"""WITH {RULED_SQL} SELECT doc_id, angle::INT AS angle, line AS line_offset, votes, ((line * {COS_SQL('angle')} - a * {SIN_SQL('angle')} + 524288) >> 20)::INT AS x1, ((line * {SIN_SQL('angle')} + a * {COS_SQL('angle')} + 524288) >> 20)::INT AS y1,
    ((line * {COS_SQL('angle')} - b * {SIN_SQL('angle')} + 524288) >> 20)::INT AS x2, ((line * {SIN_SQL('angle')} + b * {COS_SQL('angle')} + 524288) >> 20)::INT AS y2 FROM e""")
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments found on a page for each document, from pixels of dashed lines at all angles."""
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", (d * 29 % 180).cast("int").alias("angle"), (d * 13 % 300).alias("o"), (60 + F.coalesce("n_chars", F.lit(0)) % 120).alias("size"))
    dashed = docs.select("doc_id", "angle", "o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)).alias("t")).where("t % 30 < 21")
    short = docs.select("doc_id", "angle", (F.col("o") + 60).alias("o"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(29).cast("long"))).alias("t"))
    x, y = lines.point(F.col("o"), F.col("t"), F.col("angle"))
    pixels = dashed.unionByName(short).select("doc_id", x.alias("x"), y.alias("y"), "angle")
    return lines.segments(pixels, ["doc_id"], F.lit(50), **RULED).withColumnRenamed("offset", "line_offset")


@query("""SELECT doc_id, substr(sha1(concat_ws('|', coalesce(lang, 'None'), coalesce(source, 'None'), coalesce(n_chars::VARCHAR, 'None'), coalesce(text, 'None'))), 1, 12) AS fingerprint FROM documents""")
def config_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of settings that stand in a table: each document's columns as the settings of a run."""
    parts = F.array(*[F.col(c).cast("string") for c in ("lang", "source", "n_chars", "text")])
    return table(spark, sf_dir, "documents").select("doc_id", text.fingerprint(parts).alias("fingerprint"))


def jvm_jpeg(spark: SparkSession, grey: np.ndarray) -> bytes:
    """Grey pixels as a JPEG file, by the JVM's own writer."""
    jvm = spark._jvm
    height, width = grey.shape
    picture = jvm.java.awt.image.BufferedImage(width, height, 10)
    samples = spark.sparkContext._gateway.new_array(jvm.int, grey.size)
    for k, x in enumerate(grey.ravel().tolist()):
        samples[k] = x
    picture.getRaster().setPixels(0, 0, width, height, samples)
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(picture, "jpg", out)
    return bytes(out.toByteArray())


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 2 THEN 'error' WHEN 3 THEN 'error' ELSE 'tile_vote' END AS decision, doc_id % 4 < 2 AS is_handwritten,
    CASE WHEN doc_id % 4 < 2 THEN 6 END::INT AS non_blank_tiles, doc_id % 4 >= 2 AS has_error FROM documents""")
def image_run_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages that only their tiles decide: PNG, JPEG, a damaged PNG and a damaged JPEG in turn."""
    page = np.full((48, 48), 255, np.uint8)
    page[::4] = 0
    jpeg = jvm_jpeg(spark, page)
    pages = [images.encode_png(images.three_channels(page)), jpeg, images.SIGNATURE, jpeg[:30]]
    score = lambda: lambda batch: [(0.5, 0.5) if images.png_size(x) == (48, 48) else (0.05, 0.95) for x in batch]
    kind = (F.col("doc_id") % 4 + 1).cast("int")
    name = F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".png").otherwise(".jpg"))
    items = table(spark, sf_dir, "documents").select(F.lit("f").alias("folder_name"), name.alias("file_name"), F.element_at(F.array(*map(F.lit, pages)), kind).alias("content"))
    cache = spark.createDataFrame([], f"folder_name string, file_name string, decision {DECISION}")
    decided = pipeline.classified(items, cache, score)
    number = F.regexp_extract("file_name", r"^(-?\d+)", 1).cast("long").alias("doc_id")
    return decided.select(number, "decision.decision", "decision.is_handwritten", "decision.non_blank_tiles", F.col("decision.error").isNotNull().alias("has_error"))


#: Otsu's level from the distinct bytes of each text; a text of one byte only has its level at 0.
INK_SQL = """WITH b AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM documents WHERE text <> ''),
    c AS (SELECT doc_id, ('0x' || h)::INT AS level, count(*) AS k FROM b GROUP BY ALL),
    s AS (SELECT doc_id, level, k, sum(k) OVER w AS below, sum(k * level) OVER w AS mass, sum(k) OVER e AS n, sum(k * level) OVER e AS whole FROM c
        WINDOW w AS (PARTITION BY doc_id ORDER BY level), e AS (PARTITION BY doc_id)),
    v AS (SELECT doc_id, below::DOUBLE / n AS ink, level, ((whole * below)::DOUBLE / n - mass) AS d, (below * (n - below))::DOUBLE AS both_ FROM s WHERE below < n),
    best AS (SELECT doc_id, ink FROM v QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY d * d / both_ DESC, level) = 1),
    same AS (SELECT doc_id, max(level) AS level FROM c GROUP BY doc_id)
    SELECT doc_id, round(coalesce(best.ink, CASE WHEN same.level = 0 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS ink FROM documents LEFT JOIN best USING (doc_id) LEFT JOIN same USING (doc_id)"""


@query(INK_SQL)
def ink_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of each text as the grey pixels of an image of one line."""
    body = F.coalesce("text", F.lit("")).cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", F.round(images.ink_column(body, F.length(body), F.lit(1)), 6).alias("ink"))
