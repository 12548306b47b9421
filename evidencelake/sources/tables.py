"""Tables and views over them: search results, questions, messages, crawl log and trace events.

The view texts run unchanged on Spark and DuckDB.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: How many research sessions there are: one for twelve pages.
SESSIONS = "(SELECT CAST(greatest(floor(count(*) / 12.0), 1) AS BIGINT) FROM pages)"

SERP = rf"""WITH lanes AS (SELECT 0 AS source_ordinal, 'general' AS search_lane UNION ALL SELECT 1, 'academic'),
b AS (SELECT p.page_id % {SESSIONS} AS research_id, CAST(floor(p.page_id / CAST({SESSIONS} AS DOUBLE)) AS BIGINT) % 3 AS query_ordinal,
 l.source_ordinal, l.search_lane, p.page_id,
 CASE WHEN l.source_ordinal = 0 THEN p.url
      ELSE concat(regexp_replace(p.url, '#.*$', ''), CASE WHEN p.url LIKE '%?%' THEN '&' ELSE '?' END, 'utm_medium=b') END AS url,
 regexp_extract(p.html, '<title>([^<]*)</title>', 1) AS title
 FROM pages p JOIN lanes l ON l.source_ordinal = 0 OR p.page_id % 2 = 0)
SELECT research_id, query_ordinal, source_ordinal, search_lane,
 row_number() OVER (PARTITION BY research_id, query_ordinal, source_ordinal ORDER BY page_id) AS position,
 page_id, url, title, CASE WHEN page_id % 5 = 0 AND source_ordinal = 0 THEN '' ELSE substring(title, 1, 40) END AS content,
 CASE page_id % 4 WHEN 0 THEN 'brave' WHEN 1 THEN 'tavily' WHEN 2 THEN 'exa' ELSE 'searxng' END AS engine,
 CASE WHEN source_ordinal = 1 THEN CAST(2000 + page_id % 25 AS VARCHAR(4)) END AS published_date
FROM b"""
QUESTIONS = f"""SELECT r.research_id, b.text AS question FROM (SELECT research_id, research_id % nullif((SELECT count(*) FROM benchmark), 0) AS item_id FROM (SELECT DISTINCT page_id % {SESSIONS} AS research_id FROM pages) d) r JOIN benchmark b ON b.item_id = r.item_id"""
MESSAGES = r"""SELECT conv_id, turn, role, CASE WHEN turn % 3 = 0 THEN concat(text, ' see (https://example.com/a?x=', CAST(conv_id AS VARCHAR(20)), '). and https://EXAMPLE.com/a?x=', CAST(conv_id AS VARCHAR(20))) ELSE text END AS text FROM conversations"""
CRAWL_LOG = f"""SELECT page_id, page_id % {SESSIONS} AS research_id, url, CASE page_id % 5 WHEN 3 THEN 403 WHEN 4 THEN 503 ELSE 200 END AS status_code, CASE WHEN page_id % 7 = 0 THEN 'js' ELSE 'http' END AS used_render, CASE WHEN page_id % 11 = 0 THEN 'pdf' ELSE 'html' END AS resource_type, page_id % 5 < 3 AS success FROM pages"""
TRACE = r"""SELECT user_id AS turn_id, event_id AS seq,
 CASE event_type WHEN 'signup' THEN 'plan' WHEN 'view' THEN 'search_results' WHEN 'click' THEN 'url_selection' WHEN 'purchase' THEN 'final_evidence'
  WHEN 'error' THEN CASE event_id % 4 WHEN 0 THEN 'direct_sources' WHEN 1 THEN 'refresh_sources' WHEN 2 THEN 'direct_evidence' ELSE 'stage' END ELSE 'stage' END AS type,
 CASE WHEN event_id % 17 = 0 THEN '' ELSE concat('q', CAST(event_id % 3 AS VARCHAR(2))) END AS query,
 CASE WHEN event_id % 11 = 0 THEN '' ELSE concat('https://src.example/', regexp_extract(props, '([0-9]+)', 1)) END AS url,
 CASE WHEN event_id % 13 = 0 THEN '' ELSE concat('L1-S1-C', lpad(regexp_extract(props, '([0-9]+)', 1), 3, '0')) END AS chunk_id,
 CASE WHEN event_id % 7 = 0 THEN '' ELSE concat('Source ', regexp_extract(props, '([0-9]+)', 1)) END AS title,
 CASE WHEN event_id % 26 = 0 THEN '' ELSE repeat(concat(' part  ', regexp_extract(props, '([0-9]+)', 1)), 1 + CAST(event_id % 40 AS INT)) END AS text,
 CASE WHEN event_id % 19 = 0 THEN 'own' ELSE '' END AS stage FROM events"""

VIEWS = {"serp": (SERP, ("pages",)), "questions": (QUESTIONS, ("pages", "benchmark")), "messages": (MESSAGES, ("conversations",)), "crawl_log": (CRAWL_LOG, ("pages",)), "trace": (TRACE, ("events",))}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``, or a view derived from them."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text, needs = VIEWS[name]
    for need in needs:
        spark.read.parquet(f"{sf_dir}/{need}.parquet").createOrReplaceTempView(need)
    return spark.sql(text)


def sessions(spark: SparkSession, sf_dir: str) -> int:
    """How many research sessions there are, by the rows that the page table's footers state."""
    return max(1, spark.read.parquet(f"{sf_dir}/pages.parquet").count() // 12)


def trace_stream(spark: SparkSession, sf_dir: str, files_a_batch: int = 1) -> DataFrame:
    """The trace view over the events as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    path = f"{sf_dir}/event[s].parquet"  # a pattern may be a single file; a plain path may not
    spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path).createOrReplaceTempView("events")
    return spark.sql(TRACE)


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; a local session without one gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='evidencelake-')}"
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table below the shared folder: what is made of it later holds a scan in its plan, not what it was made of."""
    path = shared_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Raw pages as they were archived: page_id, url, html."""
    return spark.read.parquet(path).select("page_id", "url", "html")
