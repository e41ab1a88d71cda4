"""Camera stands on navigation grids as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from atlasloom.operators import stands as S
from atlasloom.operators.grid import FREE, OCCUPIED, UNKNOWN
from atlasloom.plans.base import Registry

q = Registry()
QUERIES, ORACLE_SQL = q.queries, q.sql

_EDGE = 0.25
_FOOT = 0.9


def _grid(t):
    cells = t("lineitem").groupBy((F.col("l_suppkey") * 4 + F.col("l_linenumber") % 4).cast("long").alias("row"), (F.col("l_partkey") % 64).cast("long").alias("col"))
    found = cells.agg(F.max("l_quantity").alias("q"), F.bool_or((F.col("l_tax") == 0.08) & (F.col("l_discount") == 0.1)).alias("drop"), F.bool_or(F.col("l_returnflag") == "N").alias("seen"), (F.max(F.col("l_partkey") % 7) * 0.25).alias("top"))
    state = F.when(F.col("q") >= 49, OCCUPIED).when(F.col("seen"), FREE).otherwise(UNKNOWN)
    floor = F.when(F.col("drop"), S.DROP).when(F.col("seen"), S.SEEN).otherwise(S.UNSEEN)
    return found.select("row", "col", state.alias("state"), floor.alias("floor"), "top")


def _stands(t):
    k = F.col("s_suppkey")
    pitch, height = F.radians(k % 4 * 10), 1 + k % 5 * 0.2
    turn = F.array(*[F.lit(0.0)] * 7, -F.cos(pitch), -F.sin(pitch))
    ring = S.blind_radius(height, turn, F.lit(200.0), F.lit(120.0), F.lit(240.0))
    return t("supplier").select(k.alias("stand"), ((k * 13 % 64 + 0.37) * _EDGE).alias("x"), ((k * 4 + 1.61) * _EDGE).alias("y"), height.alias("height"), ring.alias("ring"))


@q("""WITH a AS (SELECT s_suppkey AS stand, radians(s_suppkey % 4 * 10) AS p, 1 + s_suppkey % 5 * 0.2 AS h FROM supplier), d AS (SELECT stand, h, asin((cos(p) * 0.6 + sin(p)) / sqrt(1.36)) AS angle FROM a)
      SELECT stand, round(CASE WHEN degrees(angle) < 2 THEN 0 ELSE least(h / tan(angle), 2.0) END, 6) AS ring FROM d""")
def blind_discs(t):
    """How far each stand's camera misses the floor before it."""
    return _stands(t).select("stand", F.round("ring", 6).alias("ring"))


@q(f"""WITH g AS (SELECT CAST(l_suppkey * 4 + l_linenumber % 4 AS BIGINT) AS row, CAST(l_partkey % 64 AS BIGINT) AS col, max(l_quantity) AS q, bool_or(l_tax = 0.08 AND l_discount = 0.1) AS dropped, bool_or(l_returnflag = 'N') AS seen FROM lineitem GROUP BY 1, 2),
      b AS (SELECT min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM g),
      s AS (SELECT s_suppkey AS stand, (s_suppkey * 13 % 64 + 0.37) * {_EDGE}::DOUBLE AS x, (s_suppkey * 4 + 1.61) * {_EDGE}::DOUBLE AS y FROM supplier),
      n AS (SELECT unnest(range(-5, 6)) AS k),
      c AS (SELECT s.*, CAST(floor(y / {_EDGE}) AS BIGINT) + i.k AS row, CAST(floor(x / {_EDGE}) AS BIGINT) + j.k AS col, i.k = 0 AND j.k = 0 AS own FROM s, n i, n j),
      f AS (SELECT * FROM (SELECT *, sqrt(pow((col + 0.5) * {_EDGE} - x, 2) + pow((row + 0.5) * {_EDGE} - y, 2)) AS dist FROM c JOIN b ON row BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1) WHERE own OR dist <= {_FOOT}),
      m AS (SELECT stand, x, y, greatest(8, CAST(ceil(2 * pi() * (max(dist) + {_EDGE}) / 0.125) AS BIGINT)) AS rays, CAST(ceil((max(dist) + {_EDGE} + 0.125) / 0.125) AS BIGINT) AS steps FROM f GROUP BY ALL),
      r AS (SELECT *, unnest(range(steps)) * 0.125::DOUBLE AS t FROM (SELECT *, unnest(range(rays)) AS ray FROM m)),
      h AS (SELECT stand, ray, min(t) AS horizon FROM r JOIN g ON g.dropped AND g.row = CAST(floor((y + sin((ray + 0.5) * 2 * pi() / rays) * t) / {_EDGE}) AS BIGINT) AND g.col = CAST(floor((x + cos((ray + 0.5) * 2 * pi() / rays) * t) / {_EDGE}) AS BIGINT) GROUP BY ALL),
      w AS (SELECT f.*, rays, atan2((row + 0.5) * {_EDGE} - y, (col + 0.5) * {_EDGE} - x) AS way FROM f JOIN m USING (stand, x, y)),
      v AS (SELECT *, least(rays - 1, CAST(floor((CASE WHEN way < 0 THEN way + 2 * pi() ELSE way END) / (2 * pi() / rays)) AS BIGINT)) AS ray FROM w),
      o AS (SELECT v.row, v.col, min(v.stand) AS freed_by FROM v LEFT JOIN h USING (stand, ray) LEFT JOIN g ON g.row = v.row AND g.col = v.col WHERE NOT coalesce(g.dropped, false) AND NOT coalesce(v.dist >= h.horizon, false) GROUP BY ALL)
      SELECT row, col, CASE WHEN freed_by IS NOT NULL THEN 1 WHEN q >= 49 THEN 2 WHEN seen THEN 1 ELSE 0 END AS state, CASE WHEN dropped THEN 3 WHEN seen THEN 1 WHEN freed_by IS NOT NULL THEN 2 ELSE 0 END AS floor, freed_by FROM g FULL JOIN o USING (row, col)""")
def stand_footprints(t):
    """The grid after each stand's own disc is free, but for drops and what lies behind them."""
    return S.marked(_grid(t), _stands(t), _EDGE, _FOOT, "footprint").drop("top")


@q()
def stand_marking(t):
    """The grid after each stand's own disc and its blind disc are free."""
    return S.marked(_grid(t), _stands(t), _EDGE, 0.3).drop("top")
