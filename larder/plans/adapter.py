"""Recipe-shaped tables derived from the star-schema tables; the same SQL text runs in Spark and in an oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: {name} stands for a table of the input.
SQL = {
    "food": """SELECT 2700000 + p_partkey AS fdc_id, p_partkey AS ingredient_id, p_name AS ingredient_name,
  concat(p_name, ', ', lower(p_type), CASE WHEN p_size % 3 = 0 THEN ', raw' WHEN p_size % 3 = 1 THEN ', NFS' ELSE '' END) AS description
FROM {part}""",
    "food_nutrient": """SELECT 2700000 + p_partkey AS fdc_id, nutrient_id, CAST((p_partkey * mult) % cap AS DECIMAL(18,4)) AS amount
FROM {part} CROSS JOIN (VALUES (203,7,30),(204,11,20),(205,13,80),(208,37,300),(269,5,12),(307,29,400)) AS n(nutrient_id, mult, cap)
WHERE p_partkey % 13 <> 0""",
    "ingredient_mapping": """SELECT p_partkey AS ingredient_id, 2700000 + p_partkey AS fdc_id FROM {part} WHERE p_partkey % 11 <> 0""",
    "recipes": """SELECT o_orderkey AS recipe_id,
  concat(CASE WHEN o_orderkey % 3 = 0 THEN 'Soup ' WHEN o_orderkey % 3 = 1 THEN 'SOUP  ' ELSE ' soup ' END, CAST(o_custkey AS STRING),
    CASE WHEN o_orderkey % 4 = 0 THEN ' stews' WHEN o_orderkey % 4 = 1 THEN ' stew!' ELSE ' stew' END) AS recipe_name,
  CASE o_orderkey % 7 WHEN 0 THEN 'MAKES 4 TO 7 SERVINGS' WHEN 1 THEN '6 servings' WHEN 2 THEN '4 - 5' WHEN 3 THEN 'Makes a 900 g loaf'
    WHEN 4 THEN '' WHEN 5 THEN '99' ELSE '2' END AS servings_raw,
  CASE WHEN o_orderkey % 7 IN (0, 1) THEN 6 WHEN o_orderkey % 7 = 3 THEN 8 WHEN o_orderkey % 7 IN (2, 4, 5) THEN 4 ELSE 2 END AS servings_expected
FROM {orders}""",
    "recipe_ingredient": """SELECT recipe_id, ingredient_id, ingredient_index, unit,
  CASE WHEN qsel = 0 THEN '1/2' WHEN qsel = 1 THEN '1 1/2' ELSE CAST(qint AS STRING) END AS qty_text,
  CASE WHEN qsel = 0 THEN CAST(0.5 AS DECIMAL(10,2)) WHEN qsel = 1 THEN CAST(1.5 AS DECIMAL(10,2)) ELSE CAST(qint AS DECIMAL(10,2)) END AS qty_expected,
  CASE unit WHEN 'cup' THEN 240 WHEN 'tbsp' THEN 15 WHEN 'tsp' THEN 5 WHEN 'cloves' THEN 4 WHEN 'large' THEN 150 WHEN 'medium' THEN 110 ELSE NULL END AS unit_grams
FROM (SELECT l_orderkey AS recipe_id, l_partkey AS ingredient_id,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS INT) AS ingredient_index,
    CASE l_linenumber WHEN 1 THEN 'cup' WHEN 2 THEN 'tbsp' WHEN 3 THEN 'tsp' WHEN 4 THEN 'cloves' WHEN 5 THEN 'large' WHEN 6 THEN 'medium' ELSE '' END AS unit,
    CAST(l_quantity AS INT) % 4 + 1 AS qint, l_suppkey % 5 AS qsel FROM {lineitem}) t""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input, or one that the adapter derives from it."""
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    used = [t for t in TABLES if f"{{{t}}}" in SQL[name]]
    return spark.sql(SQL[name], **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def with_views(sql: str, more: dict[str, str] | None = None) -> str:
    """sql after common table expressions for the derived tables that it names, in an oracle's dialect."""
    parts = {**{k: v.format(**{t: t for t in TABLES}) for k, v in SQL.items()}, **(more or {})}
    names = list(parts)
    need: set[str] = set()

    def visit(text: str, before: int) -> None:
        import re

        for n in names[:before]:
            if n not in need and re.search(rf"\b{n}\b", text):
                need.add(n)
                visit(parts[n], names.index(n))

    visit(sql, len(names))
    return "WITH " + ",\n".join(f"{n} AS ({parts[n]})" for n in names if n in need) + "\n" + sql if need else sql
