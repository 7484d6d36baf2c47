"""Event-time windows over events, as batch and as stream, and formats read from the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrain.sources import formats as f
from loomgrain.sources.tables import table
from loomgrain.streaming import streams as s


def _events(spark, where):
    return table(spark, where, "events")


def _stream(spark, where):
    schema = _events(spark, where).schema.simpleString()[7:-1].replace(":", " ")
    return s.read_files(spark, where, schema, "events.parquet")


def stream_windows(spark, where):
    return s.run_to_table(s.windowed(_stream(spark, where), "1 day"), "complete", "windows")


def _texts(spark, where):
    return table(spark, where, "documents").filter("text is not null").select("doc_id", "text")


QUERIES = {
    "tumbling_windows": lambda spark, d: s.windowed(_events(spark, d), "1 hour"),
    "sliding_windows": lambda spark, d: s.windowed(_events(spark, d), "1 hour", "30 minutes"),
    "user_sessions": lambda spark, d: s.sessions(_events(spark, d), "2 hours"),
    "stream_windows": stream_windows,
    "env_references": lambda spark, d: f.env_references(_texts(spark, d), "doc_id", "text"),
    "sql_tables": lambda spark, d: f.sql_tables(_texts(spark, d), "doc_id", "text"),
    "markdown_titles": lambda spark, d: f.markdown_info(_texts(spark, d), "doc_id", "text").select("doc_id", "title", F.size("links").alias("links")),
    "rust_declarations": lambda spark, d: f.declarations(_texts(spark, d), "doc_id", "text", "rust"),
    "python_symbols": lambda spark, d: f.python_symbols(_texts(spark, d), "doc_id", "text"),
}

_DECLARED = " union all ".join(f"select doc_id, '{kind}' as kind, unnest(list_distinct(regexp_extract_all(text, '{pattern}', 1))) as name from documents where text is not null" for kind, pattern in f.DECLARATIONS["rust"].items())
ORACLES = {
    "tumbling_windows": "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all",
    "sliding_windows": "select start, event_type, count(*) as n, round(sum(value), 4) as total from (select time_bucket(interval 30 minute, ts) - (k * interval 30 minute) as start, event_type, value from events, unnest([0, 1]) u(k)) group by all",
    "user_sessions": "with o as (select *, case when ts < lag(ts) over w + interval 2 hour then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)), n as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) k from o) select user_id, min(ts) as start, max(ts) + interval 2 hour as \"end\", count(*) as n from n group by user_id, k",
    "stream_windows": "select time_bucket(interval 1 day, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all",
    "env_references": "select doc_id, unnest(list_distinct(regexp_extract_all(text, '{}', 1))) as name from documents where text is not null".format(f.ENV_REFERENCE.replace("'", "''")),
    "sql_tables": "select distinct doc_id, unnest(list_transform(regexp_extract_all(text, '(?i)\\b(?:from|join|into|update|table)\\s+[\"`]?([A-Za-z_][A-Za-z0-9_.]*)', 1), lambda x: lower(x))) as \"table\" from documents where text is not null",
    "rust_declarations": _DECLARED,
}
