"""The table of registered queries."""

from __future__ import annotations

from collections.abc import Callable

from attnmaps.sources.fixtures import Inputs, ctes

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

#: Test parameters: canvas, kernel and limits of clicks and subjects.
SIDE, KERNEL, MIN_CLICKS, MAX_CLICKS, MIN_SUBJECTS = 32, 5, 1, 6, 5

#: Submissions with key and click count; cleaned submissions; their clicks.
SUB = """sub AS (
  SELECT s.*, regexp_extract(image_path, '[^/]+/[^/]+$') AS image_key, coalesce(z.n, 0) AS n
  FROM submissions s LEFT JOIN (SELECT sub_id, count(*) AS n FROM clicks GROUP BY sub_id) z USING (sub_id))"""
CLEAN = f"""{SUB},
dd AS (SELECT *, row_number() OVER (PARTITION BY image_key, user_id, image_path ORDER BY ts NULLS LAST, ord) AS rn
  FROM sub WHERE user_catch_trial >= 0.95 AND NOT is_mobile),
cl AS (SELECT *, least(n, {MAX_CLICKS}) AS size FROM (SELECT *, count(*) OVER (PARTITION BY image_key) AS subjects FROM dd WHERE rn = 1 AND n > {MIN_CLICKS}) WHERE subjects >= {MIN_SUBJECTS}),
px AS (SELECT c.*, cl.image_key FROM clicks c JOIN cl USING (sub_id)
  WHERE pos < {MAX_CLICKS} AND x >= 0 AND x < {SIDE} AND y >= 0 AND y < {SIDE}),
ra AS (SELECT image_key, sub_id, y, x, least(count(*), 255) AS n FROM px GROUP BY ALL),
va AS (SELECT image_key, sub_id FROM ra GROUP BY ALL HAVING sum(n) >= {MIN_CLICKS}),
vi AS (SELECT image_key, count(*) AS maps FROM va GROUP BY image_key HAVING count(*) >= {MIN_SUBJECTS}),
mm AS (SELECT image_key, y, x, sum(n) / any_value(maps) AS v FROM ra JOIN vi USING (image_key) GROUP BY image_key, y, x)"""


def query(sql: str | None = None, *names: str, extra: str = "", recursive: bool = False):
    """Register a function of :class:`Inputs` under its name, with its DuckDB SQL.

    ``names`` are the adapters that the SQL reads, ``extra`` its further common tables, of which
    one may read itself.
    """

    def register(fn: Callable) -> Callable:
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql is not None:
            head = ctes(*names) + (",\n" + extra if extra else "") if names else ("WITH " + extra if extra else "")
            if recursive:
                head = head.replace("WITH ", "WITH RECURSIVE ", 1)
            ORACLES[fn.__name__] = f"{head}\n{sql}"
        return fn

    return register
