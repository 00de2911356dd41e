"""The given tables as the library's tables, and the same in SQL.

Lines of documents are blocks; what a document format would add (styles,
numbers, layout, page breaks) follows from a line's position and length, so
that SQL can repeat it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("i", "raw_text"))
    b = d.select("doc_id", "source", (F.col("i") + 1).cast("int").alias("pos"), "raw_text", F.trim("raw_text").alias("text")).where("text <> ''")
    return b.selectExpr(
        "*",
        "length(text) AS n",
        "CASE WHEN pos % 11 = 0 THEN 'tbl' ELSE 'p' END AS kind",
        "CASE WHEN pos % 11 = 0 THEN NULL WHEN pos % 7 = 1 THEN 1 WHEN pos % 7 = 3 THEN 2 WHEN pos % 7 = 5 THEN 3 END AS level",
        "CASE pos % 4 WHEN 0 THEN 'Title' WHEN 1 THEN 'Heading' WHEN 2 THEN 'Sub' ELSE 'Body' END AS style_id",
        "CASE WHEN pos % 14 = 1 THEN 0 WHEN pos % 14 = 3 THEN 1 END AS direct_outline",
        "CASE WHEN pos % 6 = 2 THEN 'n1' WHEN pos % 6 = 4 THEN 'n2' END AS num_id",
        "CASE WHEN pos % 6 IN (2, 4) THEN CAST(pos % 3 % 2 AS INT) END AS num_ilvl",
        "CASE WHEN length(text) % 3 = 0 THEN 'center' ELSE 'left' END AS alignment",
        "CAST(length(text) % 5 AS DOUBLE) / 4 AS bold_fraction",
        "CAST(20 + length(text) % 12 AS INT) AS max_font_size",
        "CAST(CASE WHEN doc_id % 3 <> 0 AND pos % 9 = 0 THEN 1 ELSE 0 END AS INT) AS page_breaks",
        "CAST(ceil((length(text) - length(regexp_replace(text, '[^\\\\x00-\\\\x7F]', ''))) / 1.6D + length(regexp_replace(text, '[^\\\\x00-\\\\x7F]', '')) / 4.0D) AS INT) AS tokens",
    )


BLOCKS = r"""
lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw_text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents
), blocks AS (
  SELECT doc_id, source, CAST(i AS INT) AS pos, raw_text, trim(raw_text, ' ') AS text, length(trim(raw_text, ' ')) AS n,
    CASE WHEN i % 11 = 0 THEN 'tbl' ELSE 'p' END AS kind,
    CASE WHEN i % 11 = 0 THEN NULL WHEN i % 7 = 1 THEN 1 WHEN i % 7 = 3 THEN 2 WHEN i % 7 = 5 THEN 3 END AS level,
    CASE i % 4 WHEN 0 THEN 'Title' WHEN 1 THEN 'Heading' WHEN 2 THEN 'Sub' ELSE 'Body' END AS style_id,
    CASE WHEN i % 14 = 1 THEN 0 WHEN i % 14 = 3 THEN 1 END AS direct_outline,
    CASE WHEN i % 6 = 2 THEN 'n1' WHEN i % 6 = 4 THEN 'n2' END AS num_id,
    CASE WHEN i % 6 IN (2, 4) THEN CAST(i % 3 % 2 AS INT) END AS num_ilvl,
    CASE WHEN length(trim(raw_text, ' ')) % 3 = 0 THEN 'center' ELSE 'left' END AS alignment,
    CAST(length(trim(raw_text, ' ')) % 5 AS DOUBLE) / 4 AS bold_fraction,
    20 + length(trim(raw_text, ' ')) % 12 AS max_font_size,
    CASE WHEN doc_id % 3 <> 0 AND i % 9 = 0 THEN 1 ELSE 0 END AS page_breaks,
    CAST(ceil((length(trim(raw_text, ' ')) - length(regexp_replace(trim(raw_text, ' '), '[^\x00-\x7F]', '', 'g'))) / 1.6::DOUBLE
      + length(regexp_replace(trim(raw_text, ' '), '[^\x00-\x7F]', '', 'g')) / 4.0::DOUBLE) AS INT) AS tokens
  FROM lines WHERE trim(raw_text, ' ') <> ''
)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each blank-separated part of a block."""
    r = blocks(spark, sf_dir).select("doc_id", "pos", F.posexplode(F.split("text", " ")).alias("run_no", "text"))
    return r.selectExpr("doc_id", "pos", "run_no", "text", "run_no % 3 = 0 AS bold", "CAST(10 + length(text) AS INT) AS font_size", "CASE WHEN run_no % 7 = 3 THEN 'del' WHEN run_no % 7 = 5 THEN 'ins' WHEN run_no % 11 = 4 THEN 'moveFrom' END AS revision")


RUNS = BLOCKS + r""", runs AS (
  SELECT doc_id, pos, run_no, text, run_no % 3 = 0 AS bold, CAST(10 + length(text) AS INT) AS font_size,
    CASE WHEN run_no % 7 = 3 THEN 'del' WHEN run_no % 7 = 5 THEN 'ins' WHEN run_no % 11 = 4 THEN 'moveFrom' END AS revision
  FROM (SELECT doc_id, pos, unnest(string_split(text, ' ')) AS text, unnest(range(0, len(string_split(text, ' ')))) AS run_no FROM blocks)
)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table cells: the parts of table blocks, three to a row; some span columns or go on from above."""
    r = blocks(spark, sf_dir).where("kind = 'tbl'").select("doc_id", F.col("pos").alias("table_id"), F.posexplode(F.split("text", " ")).alias("k", "text"))
    return r.selectExpr(
        "doc_id", "table_id", "CAST(floor(k / 3) + 1 AS INT) AS row", "CAST(k % 3 + 1 AS INT) AS cell_no", "1 AS para_no", "text",
        "CAST(CASE WHEN floor(k / 3) % 4 = 2 THEN 1 ELSE 0 END AS INT) AS grid_before",
        "CAST(CASE WHEN k % 10 = 4 THEN 2 ELSE 1 END AS INT) AS grid_span",
        "CASE WHEN k % 3 = 0 AND floor(k / 3) % 4 = 0 THEN 'restart' WHEN k % 3 = 0 AND floor(k / 3) % 4 = 1 THEN 'continue' END AS vmerge",
    )


CELLS = BLOCKS + r""", cells AS (
  SELECT doc_id, table_id, CAST(k // 3 + 1 AS INT) AS row, CAST(k % 3 + 1 AS INT) AS cell_no, 1 AS para_no, text,
    CASE WHEN k // 3 % 4 = 2 THEN 1 ELSE 0 END AS grid_before, CASE WHEN k % 10 = 4 THEN 2 ELSE 1 END AS grid_span,
    CASE WHEN k % 3 = 0 AND k // 3 % 4 = 0 THEN 'restart' WHEN k % 3 = 0 AND k // 3 % 4 = 1 THEN 'continue' END AS vmerge
  FROM (SELECT doc_id, pos AS table_id, unnest(string_split(text, ' ')) AS text, unnest(range(0, len(string_split(text, ' ')))) AS k FROM blocks WHERE kind = 'tbl')
)"""


def tokens_sql(x: str) -> str:
    """estimate_tokens() of an expression."""
    wide = f"length(regexp_replace({x}, '[\\x00-\\x7F]', '', 'g'))"
    return f"CASE WHEN coalesce(length({x}), 0) = 0 THEN 0 ELSE greatest(1, CAST(ceil({wide} / 1.6::DOUBLE + (length({x}) - {wide}) / 4.0::DOUBLE) AS INT)) END"


def truncate_sql(x: str, tokens: int, least: int, mark: str = "") -> str:
    """truncate() of an expression."""
    size = f"CAST(greatest({least}, floor(length({x}) * {tokens} / CAST({tokens_sql(x)} AS DOUBLE))) AS INT)"
    return f"CASE WHEN {tokens_sql(x)} <= {tokens} THEN {x} ELSE regexp_replace(substr({x}, 1, {size}), '\\s+$', '') || '{mark}' END"


def ends(b: DataFrame) -> DataFrame:
    return b.groupBy("doc_id").agg((F.max("pos") + 1).alias("range_end"))


def fold_sql(source: str, keys: str, order: str, weight: str, limit: str, most: str = "1000000000", flush: str = "n > 0") -> str:
    """CTEs r and folded (keys, order, w, batch) for the greedy fold over the relation source."""
    on = " AND ".join(f"r.{k} = f.{k}" for k in keys.split(", "))
    new = f"((f.used + r.w > {limit} OR f.n >= {most}) AND f.{flush})"
    return f"""
r AS (SELECT {keys}, {order}, CAST({weight} AS DOUBLE) AS w, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS i FROM {source}),
folded AS (
  SELECT {keys}, {order}, i, w, w AS used, 1 AS n, 1 AS batch FROM r WHERE i = 1
  UNION ALL
  SELECT {', '.join('r.' + k for k in keys.split(', '))}, r.{order}, r.i, r.w, CASE WHEN {new} THEN r.w ELSE f.used + r.w END, CASE WHEN {new} THEN 1 ELSE f.n + 1 END, f.batch + CASE WHEN {new} THEN 1 ELSE 0 END
  FROM folded f JOIN r ON {on} AND r.i = f.i + 1
)"""
