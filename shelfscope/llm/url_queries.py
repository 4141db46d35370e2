"""The registered query of the URL filter, with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

from shelfscope.llm import urls

#: The rules of the registered query: (verdict, host and path).
RULES = [
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    model = urls.train(urls.labelled_urls(spark))
    return urls.judge(pages, model, RULES).select("page_id", "host", "path", "rule", "verdict")


def url_sql(steps: int = 200, rate: float = 12.0, decay: float = 0.0002, unwanted: float = 0.25) -> str:
    """The same training and judging in SQL, weights as rows instead of an array."""
    bias = repr(math.log(unwanted / (1.0 - unwanted)))
    labelled = ", ".join(f"('{u}', {y}.0)" for y, part in ((0, urls.ORDINARY), (1, urls.UNWANTED)) for u in part)
    ranked = sorted(RULES, key=lambda r: -len(r[1]))
    fits = [
        (rule, verdict, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}')")
        for verdict, rule in ranked for h, _, p in [rule.partition("/")]
    ]
    rule = " ".join(f"WHEN {test} THEN '{rule}'" for rule, _, test in fits)
    verdict = " ".join(f"WHEN '{rule}' THEN '{verdict}'" for rule, verdict, _ in fits)

    def cut(table: str, key: str) -> str:
        return f"""SELECT {key}, translate(regexp_extract(tail, '^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}') AS host,
      regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path
    FROM (SELECT *, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS tail FROM {table})"""

    def features(table: str, key: str) -> str:
        grams = " UNION ALL ".join(
            f"SELECT {key}, unnest(list_transform(range(1, length({part}) + 4 - {n}), lambda i: '{part[0]}' || substr('.' || {part} || '.', i, {n}))) AS gram FROM {table}"
            for part in ("host", "path") for n in urls.SIZES
        )
        return f"SELECT DISTINCT {key}, CAST('0x' || substr(md5(gram), 1, 8) AS BIGINT) % {urls.BUCKETS} AS bucket FROM ({grams})"

    return f"""
WITH RECURSIVE labelled(url, label) AS (VALUES {labelled}),
seen AS (SELECT url, label, CASE label WHEN 1 THEN {unwanted!r} ELSE {1.0 - unwanted!r} END / count(*) OVER (PARTITION BY label) AS share FROM labelled),
seen_cut AS ({cut("seen", "url, label, share")}),
seen_features AS (SELECT * FROM ({features("seen_cut", "url")}) JOIN (SELECT url, label, share FROM seen) USING (url)
  JOIN (SELECT url, 1 / sqrt(count(*)) AS scale FROM ({features("seen_cut", "url")}) GROUP BY url) USING (url)),
descent AS (
  SELECT 0 AS step, bucket, CAST(0 AS DOUBLE) AS w FROM (SELECT DISTINCT bucket FROM seen_features)
  UNION ALL
  SELECT max(step) + 1, d.bucket, max(w) - {rate!r} * (sum(pull) + {decay!r} * max(w))
  FROM descent AS d JOIN seen_features AS f ON d.bucket = f.bucket JOIN (
    SELECT f.url, (1 / (1 + exp(-(sum(w) * max(scale) + {bias}))) - max(label)) * max(share) * max(scale) AS pull
    FROM descent AS d JOIN seen_features AS f ON d.bucket = f.bucket GROUP BY f.url
  ) AS e ON e.url = f.url
  WHERE step < {steps} GROUP BY d.bucket
),
weights AS (SELECT bucket, w FROM descent WHERE step = {steps}),
numbered AS (SELECT row_number() OVER () AS no, page_id, url FROM pages),
page_cut AS MATERIALIZED ({cut("numbered", "no, page_id")}),
score AS (
  SELECT no, 1 / (1 + exp(-(sum(coalesce(w, 0)) / sqrt(count(*)) + {bias}))) AS score
  FROM ({features("page_cut", "no")}) LEFT JOIN weights USING (bucket) GROUP BY no
),
ruled AS (SELECT *, CASE {rule} END AS rule FROM page_cut)
SELECT page_id, host, path, rule,
  coalesce(CASE rule {verdict} END, CASE WHEN coalesce(score, {unwanted!r}) >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN score USING (no)
"""


URL_SQL = url_sql()
