"""Registered queries: packing, URL filters and mixing (op3, op5, op7)."""

from __future__ import annotations

from spendgrid.llm.mixing import mix_sources
from spendgrid.llm.packing import pack
from spendgrid.llm.url_filter import judge_pages
from spendgrid.session import read_table

#: Production parameters of the registered queries and the pipeline.
MIX_WEIGHTS = [3, 1, 2]
MIX_SHARE = 1.5
MIX_CAP = 2
PACK_BUCKETS = 16
PACK_TOKENS = 65_536

#: Fixed by the task: (host, path, verdict).
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op3_pack(spark, sf_dir):
    return pack(read_table(spark, sf_dir, "documents"), PACK_BUCKETS, PACK_TOKENS)


def op5_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_pages(read_table(spark, sf_dir, "pages"), rules)


def op7_mix(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return mix_sources(docs, MIX_WEIGHTS, MIX_SHARE, MIX_CAP).select("doc_id", "size", "source_size", "target", "taken", "copies")


def _url_sql() -> str:
    longest_first = sorted(URL_RULES, key=lambda r: -len(r[0] + r[1]))
    fits = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in longest_first)
    verdicts = " ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for h, p, v in URL_RULES)
    return f"""WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p AS (SELECT page_id,
  translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT page_id, host, path, CASE {fits} END AS rule FROM p)
SELECT page_id, host, path, rule, CASE {verdicts} ELSE 'allow' END AS verdict FROM r"""


QUERIES = {"op3_pack": op3_pack, "op5_url_filter": op5_url_filter, "op7_mix": op7_mix}
SQL = {"op5_url_filter": _url_sql()}
