"""DuckDB SQL of the agreement jobs, from the same hashes as the Spark jobs draw with.

The tables build on each other: ``mp`` holds the maps that take part, ``hw`` the weights of the
halves, ``hm`` the mean maps as sparse rows, ``lt`` what is compared with what, ``b2`` the
blurred maps and ``sr`` the scores.
"""

from __future__ import annotations

from attnmaps.plans.base import KERNEL, SIDE

#: Part of a canvas that is compared.
CROP, EDGE = 24, (SIDE - 24) // 2


def number(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


def partners(source: str, columns: str, text: str, seed: int) -> str:
    """pt (columns, p_columns): every row of ``source`` with its partner."""
    names = columns.split(", ")
    theirs = ", ".join(f"b.{c} AS p_{c}" for c in names)
    return f"""pa_ AS (SELECT DISTINCT {columns}, {text} AS t FROM {source}),
pn AS (SELECT *, row_number() OVER (ORDER BY {number("t")} % 256, {columns}) - 1 AS i, count(*) OVER () AS total FROM pa_),
pt AS (SELECT {", ".join(f"a.{c}" for c in names)}, {theirs} FROM pn a
  JOIN pn b ON b.i = (a.i + 1 + {number(f"a.t || '|{seed}'")} % greatest(a.total - 1, 1)) % a.total WHERE a.total > 1)"""


def halves(seed: int, iterations: int, redraw: bool = False, by: str = "") -> str:
    """hw and hm from mp (by, image_key, level, sub_id) and pxl (image_key, level, sub_id, y, x, n)."""
    by = f"{by}, " if by else ""
    keys = f"{by}image_key, level, iteration"
    text = lambda more: f"concat_ws('|', '{seed}', image_key, level, iteration, {more})"
    draw = lambda k, tag, n: f"{number(text(f'{k}, {chr(39)}{tag}{chr(39)}'))} % ({n})"
    again = (
        f"SELECT {keys}, CASE WHEN q < h THEN q ELSE {draw('q - h', 'test', 'h')} END, 1 FROM (SELECT *, {draw('r', 'again', '2 * h')} AS q FROM dh WHERE h > 0)"
        if redraw
        else f"SELECT {keys}, {draw('r', 'test', 'h')}, 1 FROM dh WHERE r < h"
    )
    return f"""di AS (SELECT mp.*, CAST(i AS INT) AS iteration FROM mp, range({iterations}) t(i)),
dh AS (SELECT *, n // 2 AS h FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY md5({text("sub_id")}), sub_id) - 1 AS r, count(*) OVER (PARTITION BY {keys}) AS n FROM di)),
sl AS (SELECT {keys}, r AS slot, CASE WHEN r < h AND {redraw} THEN 0 ELSE 1 END AS w FROM dh
  UNION ALL SELECT {keys}, h + {draw('r', 'ref', 'n - h')}, 1 FROM dh WHERE r < h
  UNION ALL {again}),
hw AS (SELECT {keys}, CASE WHEN r < h THEN 'test' ELSE 'ref' END AS half, sub_id, w, CASE WHEN r < h AND NOT {redraw} THEN 2 * h ELSE n END AS size
  FROM (SELECT {keys}, slot AS r, sum(w) AS w FROM sl GROUP BY ALL) JOIN dh USING ({keys}, r)),
hk AS (SELECT DISTINCT {keys}, half FROM hw),
hm AS (SELECT {keys}, half, y, x, sum(w * n) / max(size) AS v FROM hw JOIN pxl USING (image_key, level, sub_id) GROUP BY {keys}, half, y, x)"""


DISK = f"""dk AS (SELECT CAST(y - c AS INT) AS dy, CAST(x - c AS INT) AS dx, 1.0::DOUBLE / count(*) OVER () AS weight
  FROM (SELECT ({KERNEL} - 1) / 2 AS c, y, x FROM range({KERNEL}) r(y), range({KERNEL}) s(x)) WHERE (x - c) * (x - c) + (y - c) * (y - c) <= c * c)"""
INSIDE = f"y + dy BETWEEN 0 AND {SIDE - 1} AND x + dx BETWEEN 0 AND {SIDE - 1}"
SPEARMAN = """ra_ AS (SELECT *, rank() OVER (p ORDER BY a) + (count(*) OVER (p_a) - 1) / 2 AS u, rank() OVER (p ORDER BY b) + (count(*) OVER (p_b) - 1) / 2 AS w FROM dn
  WINDOW p AS (PARTITION BY {lot}), p_a AS (PARTITION BY {lot}, a), p_b AS (PARTITION BY {lot}, b)),
so AS (SELECT {lot}, CASE WHEN var_pop(u) > 0 AND var_pop(w) > 0 THEN corr(u, w) END AS score FROM ra_ GROUP BY {lot}),
sr AS (SELECT {lot}, CASE WHEN whole THEN score END AS score FROM lots LEFT JOIN so USING ({lot}))"""
AUC = """un AS (SELECT {lot}, (a - min(a) OVER q) / (max(a) OVER q - min(a) OVER q + 1e-8) AS a, (b - min(b) OVER q) / (max(b) OVER q - min(b) OVER q + 1e-8) AS b FROM dn WINDOW q AS (PARTITION BY {lot})),
th AS (SELECT {lot}, k, coalesce(count(*) FILTER (a > k * 0.05 AND b > k * 0.05) / nullif(count(*) FILTER (a > k * 0.05 OR b > k * 0.05), 0), 0) AS v FROM un, range(1, 20) r(k) GROUP BY {lot}, k),
so AS (SELECT {lot}, sum((v + w) / 2 * 0.05) AS score FROM (SELECT *, lead(v) OVER (PARTITION BY {lot} ORDER BY k) AS w FROM th) WHERE w IS NOT NULL GROUP BY {lot}),
sr AS (SELECT {lot}, CASE WHEN whole THEN score END AS score FROM lots LEFT JOIN so USING ({lot}))"""


def scores(lot: str, metric: str = SPEARMAN) -> str:
    """sr (lot, score) from tm (lot, half, y, x, v), the mean maps of every lot, and lots (lot, whole).

    ``lot`` names the columns that tell the comparisons apart; ``whole`` is false where a half
    is missing, and so is the score.
    """
    return f"""{DISK},
b1 AS (SELECT {lot}, half, y + dy AS y, x + dx AS x, sum(v * weight) AS v FROM tm, dk WHERE {INSIDE} GROUP BY {lot}, half, y + dy, x + dx),
b2 AS (SELECT {lot}, half, y + dy AS y, x + dx AS x, sum(v * weight) AS v FROM b1, dk WHERE {INSIDE} GROUP BY {lot}, half, y + dy, x + dx),
gr AS (SELECT * FROM lots, (SELECT y, x FROM range({EDGE}, {EDGE + CROP}) r(y), range({EDGE}, {EDGE + CROP}) s(x))),
dn AS (SELECT {lot}, y, x, round(coalesce(max(v) FILTER (half = 'test'), 0), 10) AS a, round(coalesce(max(v) FILTER (half = 'ref'), 0), 10) AS b
  FROM gr LEFT JOIN b2 USING ({lot}, y, x) GROUP BY {lot}, y, x),
{metric.format(lot=lot)}"""


#: Maps of one level and their pixels.
ONE_LEVEL = """mp AS (SELECT image_key, 0 AS level, sub_id FROM {subs}),
pxl AS (SELECT image_key, 0 AS level, sub_id, y, x, n FROM {pixels})"""


def image_job(kinds: tuple[str, ...], seed: int, iterations: int, redraw: bool = False, metric: str = SPEARMAN, by: str = "", maps: str | None = None) -> str:
    """The tables of ceilings and floors; ``maps`` gives mp and pxl, by default of one level."""
    more = f"{by}, " if by else ""
    lot = f"{more}image_key, level, kind, iteration"
    tm = {
        "ceiling": f"SELECT {more}image_key, level, 'ceiling' AS kind, iteration, half, y, x, v FROM hm",
        "floor": f"SELECT {more}image_key, level, 'floor' AS kind, iteration, half, y, x, v FROM hm WHERE half = 'test' UNION ALL SELECT {more}pt.image_key, level, 'floor', iteration, half, y, x, v FROM hm JOIN pt ON pt.p_image_key = hm.image_key WHERE half = 'ref'",
    }
    known = {
        "ceiling": f"SELECT {more}image_key, level, 'ceiling' AS kind, iteration, half FROM hk",
        "floor": f"SELECT {more}image_key, level, 'floor' AS kind, iteration, half FROM hk JOIN pt USING (image_key) WHERE half = 'test' UNION ALL SELECT {more}pt.image_key, level, 'floor', iteration, half FROM hk JOIN pt ON pt.p_image_key = hk.image_key WHERE half = 'ref'",
    }
    return ",\n".join(
        [
            maps or ONE_LEVEL.format(subs="cl", pixels="ra"),
            partners("mp", "image_key", "image_key", seed),
            halves(seed, iterations, redraw, by),
            "tm AS (" + " UNION ALL ".join(tm[k] for k in kinds) + ")",
            f"lots AS (SELECT {lot}, count(DISTINCT half) = 2 AS whole FROM (" + " UNION ALL ".join(known[k] for k in kinds) + f") GROUP BY {lot})",
            scores(lot, metric),
        ]
    )


#: Test maps rescaled by the ratio of two scales, on the canvas' centre.
RESCALED = f"""rs AS (SELECT DISTINCT s, CAST(trunc({SIDE} / s) AS INT) AS side FROM lt WHERE s IS NOT NULL),
ax AS (SELECT s, side, i, least(CAST(floor(i / s) AS INT), side - 1) AS cell FROM rs, range({SIDE}) r(i)),
ac AS (SELECT *, count(*) OVER (PARTITION BY s, cell) AS n FROM ax),
mv AS (SELECT key, diff, kind, level, iteration, half, CAST(ty AS INT) AS y, CAST(tx AS INT) AS x, v FROM (
  SELECT key, diff, kind, level, iteration, half, a.cell + floor(({SIDE} - a.side) / 2.0) AS ty, b.cell + floor(({SIDE} - a.side) / 2.0) AS tx, sum(v) / (a.n * b.n) AS v
  FROM ft JOIN ac a ON a.s = ft.s AND a.i = ft.y JOIN ac b ON b.s = ft.s AND b.i = ft.x GROUP BY key, diff, kind, level, iteration, half, a.cell, b.cell, a.side, a.n, b.n)
  WHERE ty BETWEEN 0 AND {SIDE - 1} AND tx BETWEEN 0 AND {SIDE - 1})"""
#: Test maps moved to the side by a fifth of the difference of two frames' numbers.
SHIFTED = f"""mv AS (SELECT key, diff, kind, level, iteration, half, y, CAST(round(x + 0.2 * s) AS INT) AS x, v FROM ft WHERE s IS NOT NULL AND round(x + 0.2 * s) BETWEEN 0 AND {SIDE - 1})"""

#: Test maps seen by a camera a fifth of the frames' difference further, where the left half is two and a half times as
#: deep and moves less far: rounded places, the nearest point of a cell, and nothing behind the target's surface.
DEPTHS = f"""pj AS (SELECT key, diff, kind, level, iteration, half, y, x, v, CAST(round_even(x + s * 0.1 * CASE WHEN x < {SIDE // 2} THEN 0.8 ELSE 2 END, 0) AS INT) AS tx, CASE WHEN x < {SIDE // 2} THEN 25 ELSE 10 END AS z
  FROM (SELECT l.*, g.y, g.x, coalesce(ft.v, 0) AS v FROM (SELECT DISTINCT key, diff, kind, s, level, iteration, half FROM ft WHERE s IS NOT NULL) l
    CROSS JOIN (SELECT y, x FROM range({SIDE}) r(y), range({SIDE}) s(x)) g LEFT JOIN ft USING (key, diff, kind, level, iteration, half, y, x))),
fr2 AS (SELECT *, row_number() OVER (PARTITION BY key, diff, kind, level, iteration, half, y, tx ORDER BY z, x DESC) AS rn FROM pj
  WHERE tx BETWEEN 0 AND {SIDE - 1} AND z <= 1.1 * CASE WHEN tx < {SIDE // 2} THEN 25 ELSE 10 END),
mv AS (SELECT key, diff, kind, level, iteration, half, y, tx AS x, v FROM fr2 WHERE rn = 1 AND v <> 0)"""


def frame_job(pairs: str, ratio: str, moved: str, seed: int, iterations: int) -> str:
    """The tables of constancy: pairs (key, diff, target_key) and fr (frame_key, scale, frame)."""
    lot = "key, diff, kind, level, iteration"
    return ",\n".join(
        [
            "fs AS (SELECT cl.*, frame_key FROM cl JOIN frames USING (image_key))",
            "fp AS (SELECT frame_key AS image_key, sub_id, y, x, n FROM ra JOIN frames USING (image_key))",
            "fr AS (SELECT frame_key, scale, image_id % 24 AS frame, CAST(floor(image_id / 24) AS INT) AS seq FROM frames)",
            f"pr AS ({pairs})",
            ONE_LEVEL.format(subs="(SELECT frame_key AS image_key, sub_id FROM fs)", pixels="fp"),
            partners("pr", "key, diff", "'{' || key || ', ' || diff || '}'", seed),
            f"lt AS (SELECT pr.key, pr.diff, 'ceiling' AS kind, pr.target_key, CASE WHEN diff <> 0 THEN {ratio} END AS s FROM pr JOIN fr a ON a.frame_key = pr.key JOIN fr b ON b.frame_key = pr.target_key"
            " UNION ALL SELECT key, diff, 'floor', p_key, NULL FROM pt)",
            halves(seed, iterations),
            "ft AS (SELECT key, diff, kind, s, level, iteration, half, y, x, v FROM hm JOIN lt ON lt.key = hm.image_key WHERE half = 'test')",
            moved,
            """tm AS (SELECT * FROM mv UNION ALL SELECT key, diff, kind, level, iteration, half, y, x, v FROM ft WHERE s IS NULL
  UNION ALL SELECT key, diff, kind, level, iteration, half, y, x, v FROM hm JOIN lt ON lt.target_key = hm.image_key WHERE half = 'ref')""",
            """lots AS (SELECT key, diff, kind, a.level, a.iteration, true AS whole FROM lt JOIN hk a ON a.image_key = lt.key AND a.half = 'test'
  JOIN hk b ON b.image_key = lt.target_key AND b.half = 'ref' AND a.level = b.level AND a.iteration = b.iteration)""",
            scores(lot),
        ]
    )


SCALE_PAIRS = """SELECT a.frame_key AS key, CAST(d AS INT) AS diff, b.frame_key AS target_key
  FROM (SELECT *, unnest(range(CAST(-(frame % 3) AS INT), CAST(3 - frame % 3 AS INT))) AS d FROM fr) a JOIN fr b ON b.seq = a.seq AND b.frame = a.frame + a.d"""
ROTATION_PAIRS = """SELECT a.frame_key AS key, CAST(d AS INT) AS diff, b.frame_key AS target_key
  FROM (SELECT *, unnest(range(-3, 5)) AS d FROM fr) a JOIN fr b ON b.seq = a.seq AND b.frame = (a.frame + 3 * a.d + 24) % 24"""
