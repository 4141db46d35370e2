"""The registered query of spelling variant grouping, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.llm import spelling
from shelfscope.llm.sql import crc32
from shelfscope.llm.storage import stored

#: Letters of a word at least, occurrences of a word at least, and how many times as often its form occurs.
SHORTEST, LEAST, FACTOR = 7, 2, 10


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    words = spelling.runs(docs, SHORTEST).select(spelling.misspelt(F.col("doc_id"), F.col("run")).alias("word"))
    vocabulary = stored(spelling.counted(words, SHORTEST, LEAST), "vocabulary")
    return spelling.spelling_groups(vocabulary, FACTOR).select("word", "form", "root", "n", "n_near", "form_n")


SPELLING_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS told
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{spelling.UPPER}', '{spelling.LOWER}'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]{{{SHORTEST},}}')) AS run FROM documents)
  GROUP BY doc_id, run
),
summed AS (SELECT run, n, {crc32("told")} AS h FROM runs),
hurt AS (
  SELECT n, CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word
  FROM summed
),
words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM hurt WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(n) >= {LEAST}
),
cut AS MATERIALIZED (
  SELECT word, n, at_place, left(word, at_place) || substr(word, at_place + 2) AS kept
  FROM (SELECT word, n, CAST(unnest(range(length(word))) AS INT) AS at_place FROM words)
),
pairs AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut AS a JOIN cut AS b ON a.kept = b.kept AND a.at_place = b.at_place AND a.word <> b.word
  UNION SELECT cut.word, cut.n, words.word, words.n FROM cut JOIN words ON cut.kept = words.word
  UNION SELECT words.word, words.n, cut.word, cut.n FROM cut JOIN words ON cut.kept = words.word
),
best AS (
  SELECT word, count(*) OVER (PARTITION BY word) AS n_near, other, other_n
  FROM pairs QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1
),
formed AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {FACTOR} * n THEN other END AS form,
    CASE WHEN other_n >= {FACTOR} * n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)
),
chain AS (
  SELECT word, word AS root FROM words
  UNION ALL SELECT chain.word, form FROM chain JOIN formed ON chain.root = formed.word WHERE form IS NOT NULL
)
SELECT formed.word, form, chain.root, n, n_near, form_n FROM formed JOIN chain USING (word)
WHERE chain.root NOT IN (SELECT word FROM formed WHERE form IS NOT NULL)
"""
