"""The registered query of conversation repair: damaged conversations, repaired; with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.llm import repair
from shelfscope.llm.sql import crc32


def damaged(turns: DataFrame) -> DataFrame:
    """One row in five dropped (`gone`), emptied, without sentence ends, repeated, or said by the user."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hurt = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    text = F.when(F.col("hurt") == 1, "").when(F.col("hurt") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return (
        turns.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), hurt.alias("hurt"))
        .withColumn("times", F.when(F.col("hurt") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
        .select("conv_id", "turn", F.when(F.col("hurt") == 4, "user").otherwise(F.col("role")).alias("role"),
                text.alias("text"), (F.col("hurt") == 0).alias("gone"), F.explode("times"))
        .drop("col")
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair.repair(damaged(turns))


WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
KEY = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"

REPAIR_SQL = f"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {KEY} AS k FROM conversations),
hurt AS (SELECT *, {crc32("k")} % 20 AS h FROM keyed),
conv AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
damaged AS (
  SELECT c, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hurt JOIN conv ON hurt.conv_id IS NOT DISTINCT FROM conv.conv_id JOIN (VALUES (1), (2)) AS t(copy) ON copy = 1 OR h = 3
  WHERE h <> 0
),
placed AS (
  SELECT *, row_number() OVER w AS i, rtrim(text, {WHITE}) AS trimmed, left(role, 1) AS initial, lag(left(role, 1)) OVER w AS before
  FROM damaged WINDOW w AS (PARTITION BY c ORDER BY turn NULLS FIRST, role, text)
),
faulty AS (
  SELECT *, CASE WHEN trimmed = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM placed
),
counted AS (
  SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY c
),
inserts(state, k, mid, told) AS (VALUES
  (0, 0, 0, []), (0, 1, 2, ['user:']), (0, 2, 3, ['user:', 'assistant:']),
  (1, 0, 1, []), (1, 1, 2, ['user:']), (1, 2, 3, ['user:', 'assistant:']),
  (2, 0, 2, []), (2, 1, 3, ['assistant:']), (3, 0, 3, []), (3, 1, 2, ['user:'])),
edits(mid, letter, needs, goes, role, paid) AS (VALUES
  (0, 'D', '', 0, '', 3), (1, 'D', '', 1, '', 3), (2, 'D', '', 2, '', 3), (3, 'D', '', 3, '', 3),
  (0, 'K', 's', 1, '', 0), (0, 'K', 'u', 2, '', 0), (1, 'K', 'u', 2, '', 0), (2, 'K', 'a', 3, '', 0), (3, 'K', 'u', 2, '', 0),
  (0, 'R', '', 2, 'user', 2), (1, 'R', '', 2, 'user', 2), (2, 'R', '', 3, 'assistant', 2), (3, 'R', '', 2, 'user', 2)),
best AS (
  SELECT c, 0::BIGINT AS i, 0 AS state, 0 AS cost, '' AS audit, []::VARCHAR[] AS told FROM conv
  UNION ALL
  SELECT c, i, goes, cost, audit, told FROM (
    SELECT b.c, b.i + 1 AS i, e.goes, b.cost + 2 * n.k + e.paid + CASE WHEN letter <> 'D' AND fault = 'truncated' THEN 1 ELSE 0 END AS cost,
      b.audit || repeat('I', n.k) || letter AS audit,
      b.told || n.told || CASE letter WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [e.role || ':' || f.text] END AS told
    FROM best AS b JOIN faulty AS f ON f.c = b.c AND f.i = b.i + 1
      JOIN inserts AS n ON n.state = b.state JOIN edits AS e ON e.mid = n.mid
    WHERE letter = 'D' OR (fault NOT IN ('blank', 'duplicate') AND (letter = 'R' OR needs = initial))
  ) QUALIFY row_number() OVER (PARTITION BY c, goes ORDER BY cost, audit) = 1
),
ended AS (
  SELECT b.c, b.cost + 2 * n.k AS cost, b.audit || repeat('I', n.k) AS audit, b.told || n.told AS told
  FROM best AS b LEFT JOIN counted USING (c) JOIN inserts AS n ON n.state = b.state
  WHERE b.i = coalesce(counted.n, 0) AND n.mid IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY b.c ORDER BY b.cost + 2 * n.k, b.audit || repeat('I', n.k)) = 1
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(cost AS BIGINT) AS cost, audit,
  sha256(array_to_string(told, chr(10))) AS repaired_sha256
FROM conv JOIN ended USING (c) LEFT JOIN counted USING (c)
"""
