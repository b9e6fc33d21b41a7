"""Queries of trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gneiss.operators import trees as T
from gneiss.session import table


def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elements of every page with their parents and headings."""
    return T.element_trees(table(spark, sf_dir, "pages"))


_HOLDERS = "(" + ", ".join(f"'{t}'" for t in T.HOLDERS) + ")"
PAGE_ELEMENTS = f"""
WITH RECURSIVE m AS (SELECT page_id, regexp_extract_all(regexp_replace(coalesce(html, ''), '{T.HIDDEN}', '', 'g'), '{T.TAG}') AS x FROM pages),
t AS (SELECT page_id, unnest(range(len(x))) AS k, unnest(x) AS mark FROM m),
s AS (SELECT page_id, k, lower(regexp_replace(mark, '[</]', '', 'g')) AS tag, mark LIKE '</%' AS closes FROM t),
d AS (SELECT page_id, k, tag, CASE WHEN tag NOT IN {_HOLDERS} THEN 0 WHEN closes THEN -1 ELSE 1 END AS side FROM s WHERE tag IN {_HOLDERS} OR NOT closes),
n AS (SELECT *, sum(side) OVER (PARTITION BY page_id ORDER BY k) AS total FROM d),
l AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY page_id ORDER BY k)) AS level FROM n),
e AS (SELECT page_id, k, tag, side, (level + (side = 0)::INT)::INT AS depth FROM l WHERE side >= 0),
p AS (SELECT e.page_id, e.k, e.tag, e.depth, h.k AS parent FROM e ASOF LEFT JOIN (SELECT * FROM e WHERE side = 1) h ON e.page_id = h.page_id AND e.depth - 1 = h.depth AND e.k > h.k),
o AS (SELECT *, max(CASE WHEN regexp_matches(tag, '^h[1-6]$') THEN k END) OVER (PARTITION BY page_id, parent ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS own FROM p),
walk AS (
  SELECT page_id, k, tag, depth, parent, own AS heading FROM o WHERE parent IS NULL
  UNION ALL SELECT o.page_id, o.k, o.tag, o.depth, o.parent, coalesce(o.own, w.heading) FROM walk w JOIN o ON o.page_id = w.page_id AND o.parent = w.k
)
SELECT page_id, k::INT AS k, tag, depth, parent::INT AS parent, heading::INT AS heading FROM walk
"""
