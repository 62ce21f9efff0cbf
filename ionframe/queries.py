"""The engine's operators bound to the test tables, each with the SQL that must give the same rows.

Bindings: `embeddings` supplies geometry (components 1-3 a position, 4-6 a velocity, 7-15 a triangle, 16-27 a tetrahedron),
`events` trajectories, `lineitem` matrices, weights and samples. Every query runs over whole tables.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionframe.constants import ELEMENTARY_CHARGE, EV_TO_J, KT_REFERENCE, SPECIES, species_rows, species_table
from ionframe.functions import physics, rng, units
from ionframe.functions import vectors as V
from ionframe.operators import deposition, distribute, fem, gather, mesh, spatial, tracks
from ionframe.sources import config, particles, text
from ionframe.storage import materialise, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = re.sub(r"\bby\b", '"by"', sql)  # a column name here; the keyword is in capitals
        return f

    return keep


def r(c, digits: int = 6) -> Column:
    return F.round(c, digits)


# ---------------------------------------------------------------- bindings


def _e(k: int) -> Column:
    return F.col("embedding")[k - 1].cast("double")


def _vec(k: int, scale: float, shift: float = 0.0) -> Column:
    return V.vec(*[_e(k + i) * scale + shift for i in range(3)])


def bound_particles(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(s[0]) for s in SPECIES])
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), names[(F.col("vec_id") % 12).cast("int")].alias("species"), _vec(1, 100.0).alias("pos"), _vec(4, 1000.0).alias("v"))


def bound_triangles(spark: SparkSession, d: str) -> DataFrame:
    corners = [_vec(7 + 3 * i, 20.0, 50.0).alias(f"v{i}") for i in range(3)]
    nodes = [((F.col("vec_id") * k + 3 * k) % 40).alias(f"n{i}") for i, k in enumerate((1, 7, 11))]
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("tri_id"), *corners, *nodes, (F.col("vec_id") % 97).alias("cnt"))


def bound_tetras(spark: SparkSession, d: str) -> DataFrame:
    corners = [_vec(16 + 3 * i, 100.0).alias(f"v{i}") for i in range(4)]
    nodes = [((F.col("vec_id") * k + 5 * i) % 61 + 1).alias(f"n{i}") for i, k in enumerate((1, 3, 7, 13))]
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("tetra_id"), *corners, *nodes)


def _sql3(name: str, k: int, scale: float, shift: float = 0.0) -> str:
    return ", ".join(f"CAST(embedding[{k + i}] AS DOUBLE) * {scale} + {shift} AS {name}{a}" for i, a in enumerate("xyz"))


_SPECIES_SQL = "species(species, mass, radius, vti, vss_alpha, charge_ions, charge_c) AS (VALUES " + ", ".join(f"('{s[0]}', {s[1]!r}::DOUBLE, {s[2]!r}::DOUBLE, {s[3]!r}::DOUBLE, {s[4]!r}::DOUBLE, {s[5]}, {s[6]!r}::DOUBLE)" for s in species_rows()) + ")"
_NAMES_SQL = "[" + ", ".join(f"'{s[0]}'" for s in SPECIES) + "]"
_P = f"p AS (SELECT vec_id AS id, ({_NAMES_SQL})[vec_id % 12 + 1] AS species, {_sql3('p', 1, 100.0)}, {_sql3('v', 4, 1000.0)} FROM embeddings)"
_T = f"t AS (SELECT vec_id AS tri_id, {_sql3('a', 7, 20.0, 50.0)}, {_sql3('b', 10, 20.0, 50.0)}, {_sql3('c', 13, 20.0, 50.0)}, (vec_id + 3) % 40 AS n0, (vec_id * 7 + 21) % 40 AS n1, (vec_id * 11 + 33) % 40 AS n2, vec_id % 97 AS cnt FROM embeddings)"
_K = f"k AS (SELECT vec_id AS tetra_id, {_sql3('a', 16, 100.0)}, {_sql3('b', 19, 100.0)}, {_sql3('c', 22, 100.0)}, {_sql3('d', 25, 100.0)}, vec_id % 61 + 1 AS n0, (vec_id * 3 + 5) % 61 + 1 AS n1, (vec_id * 7 + 10) % 61 + 1 AS n2, (vec_id * 13 + 15) % 61 + 1 AS n3 FROM embeddings)"


def _det(a: str, b: str, c: str, d: str) -> str:
    """SQL of (b - a) . ((c - a) x (d - a)) over points named by prefix."""
    u, v, w = ([f"({q}{x} - {a}{x})" for x in "xyz"] for q in (b, c, d))
    return f"({u[0]} * ({v[1]} * {w[2]} - {v[2]} * {w[1]}) + {u[1]} * ({v[2]} * {w[0]} - {v[0]} * {w[2]}) + {u[2]} * ({v[0]} * {w[1]} - {v[1]} * {w[0]}))"


def _draw_sql(seed: int, key: str, step, number: int) -> str:
    return f"(CAST('0x' || substr(md5('{seed}|' || {key} || '|{step}|{number}'), 1, 8) AS BIGINT) / 4294967296.0)"


# ---------------------------------------------------------------- deposition


@query("""SELECT CAST(floor(l_quantity) AS BIGINT) AS bin, round(sum(CAST(l_tax AS DOUBLE)), 6) AS total FROM lineitem
WHERE l_extendedprice / 1000 BETWEEN 48 AND 52 GROUP BY 1""")
def deposition_histogram(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: a band filter, a floor bin, a weighted sum."""
    found = deposition.weighted_histogram(table(spark, d, "lineitem"), F.col("l_extendedprice") / 1000, 48.0, 52.0, F.floor("l_quantity").cast("long"), F.col("l_tax").cast("double"))
    return found.select("bin", r("total").alias("total"))


def _left_sql(c: float) -> str:
    return f"CASE WHEN {c} <= s[1] THEN 0.0 WHEN {c} >= s[3] THEN 1.0 WHEN {c} <= s[2] THEN ({c} - s[1]) * ({c} - s[1]) / nullif((s[2] - s[1]) * (s[3] - s[1]), 0) ELSE 1 - (s[3] - {c}) * (s[3] - {c}) / nullif((s[3] - s[2]) * (s[3] - s[1]), 0) END"


_BAND = f"WITH {_T}, o AS (SELECT *, (ax + bx + cx) / 3 AS mx, (ay + by_ + cy) / 3 AS my, list_sort([ax, bx, cx]) AS s FROM (SELECT *, by AS by_ FROM t)), w AS (SELECT *, {_left_sql(52.0)} - ({_left_sql(48.0)}) AS ov FROM o) "


@query(_BAND + "SELECT floor(my) AS y_bin, round(sum(cnt * ov), 6) AS total FROM w WHERE mx BETWEEN 48 AND 52 AND ov >= 0.75 GROUP BY 1")
def band_overlap_histogram(spark: SparkSession, d: str) -> DataFrame:
    found = deposition.band_histogram(bound_triangles(spark, d))
    return found.select(F.col("y_bin").cast("double").alias("y_bin"), r("total").alias("total"))


@query(_BAND + "SELECT tri_id, round(mx, 6) AS centroid_x, round(ov, 6) AS overlap, cnt FROM w WHERE ov > 0.75")
def band_overlap_listing(spark: SparkSession, d: str) -> DataFrame:
    return deposition.band_listing(bound_triangles(spark, d)).select("tri_id", r("centroid_x").alias("centroid_x"), r("overlap").alias("overlap"), "cnt")


@query("""WITH e AS (SELECT event_id, user_id, ts, value, max(value) OVER w AS envelope FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT event_id, round(envelope, 6) AS envelope, round(sum(envelope) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS smooth FROM e""")
def envelope_smoothing(spark: SparkSession, d: str) -> DataFrame:
    found = deposition.envelope(table(spark, d, "events"), "value", ["ts", "event_id"], ["user_id"])
    return found.select("event_id", r("envelope").alias("envelope"), r("smooth").alias("smooth"))


@query("""WITH p AS (SELECT round(l_extendedprice / 1000) AS x, CAST(l_quantity AS DOUBLE) AS y, count(*) * 0.14 AS w FROM lineitem GROUP BY 1, 2),
m AS (SELECT sum(w) AS w, sum(w * w) AS w2, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p),
c AS (SELECT m.*, (m.w * m.w / m.w2) ** (-1.0 / 3) / (1 - m.w2 / (m.w * m.w)) / m.w AS k, s.* FROM m, (SELECT sum(p.w * (x - mx) * (x - mx)) AS sxx, sum(p.w * (x - mx) * (y - my)) AS sxy, sum(p.w * (y - my) * (y - my)) AS syy FROM p, m) s),
i AS (SELECT *, sxx * k * syy * k - sxy * k * sxy * k AS det FROM c),
g AS (SELECT a.range AS gx, b.range AS gy, x0 - 0.5 + a.range * (x1 - x0 + 1) / 29 AS px, y0 - 0.5 + b.range * (y1 - y0 + 1) / 29 AS py FROM range(30) a, range(30) b, m)
SELECT gx, gy, round(sum(p.w * exp(-0.5 * (syy * k * (px - x) * (px - x) - 2 * sxy * k * (px - x) * (py - y) + sxx * k * (py - y) * (py - y)) / det)) / (2 * pi() * sqrt(any_value(det)) * any_value(i.w)), 9) AS density
FROM p, g, i GROUP BY gx, gy""")
def kde_grid(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "lineitem").groupBy(F.round(F.col("l_extendedprice") / 1000).alias("x"), F.col("l_quantity").cast("double").alias("y")).agg((F.count(F.lit(1)) * 0.14).alias("w"))
    return deposition.kde(points, 30).select("gx", "gy", r("density", 9).alias("density"))


@query("""SELECT CAST(floor((l_quantity - 1) / 49 * 20) AS INTEGER) AS q_bin, CAST(floor(l_discount / 0.2 * 100 + 1e-9) AS INTEGER) AS d_bin, count(*) AS cnt FROM lineitem
WHERE l_quantity >= 1 AND l_quantity < 50 AND l_discount >= 0 AND l_discount < 0.2 GROUP BY 1, 2""")
def binned_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("q"), (F.col("l_discount").cast("double") + 2e-12).alias("d"))
    return deposition.histogram(rows, {"q": (1.0, 50.0, 20), "d": (0.0, 0.2, 100)})


@query("""WITH h AS (SELECT CAST(floor(l_extendedprice / 5000) AS DOUBLE) AS x, count(*) AS y FROM lineitem GROUP BY 1)
SELECT round(exp(regr_intercept(ln(y), x)), 4) AS a, round(-1 / regr_slope(ln(y), x), 6) AS scale FROM h""")
def exponential_fit(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "lineitem").groupBy(F.floor(F.col("l_extendedprice") / 5000).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("y"))
    return deposition.exponential_fit(h, "x", "y").select(r("a", 4).alias("a"), r("scale").alias("scale"))


@query("SELECT l_orderkey, l_linenumber, round(sum(l_quantity) * 0.14, 6) AS thickness_nm FROM lineitem GROUP BY 1, 2")
def deposited_thickness(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(r(F.sum(F.col("l_quantity").cast("double")) * 0.14).alias("thickness_nm"))


# ---------------------------------------------------------------- particles


@query(f"WITH {_SPECIES_SQL}, {_P} SELECT id, round(0.5 * mass * (vx * vx + vy * vy + vz * vz) * 1e24, 6) AS energy_yj FROM p JOIN species USING (species)")
def kinetic_energy(spark: SparkSession, d: str) -> DataFrame:
    rows = bound_particles(spark, d).join(F.broadcast(species_table(spark)), "species")
    return rows.select("id", r(physics.kinetic_energy(F.col("mass"), F.col("v")) * 1e24).alias("energy_yj"))


@query(f"""WITH {_SPECIES_SQL}, s AS (SELECT event_id, value, user_id, ({_NAMES_SQL})[event_id % 12 + 1] AS species, (user_id % 7) / 10.0 AS expansion, {_draw_sql(5, 'event_id', 0, 0)} * 2 - 1 AS u FROM events),
w AS (SELECT event_id, sqrt(2 * (value + 1) * {EV_TO_J!r} / mass) AS v, CASE WHEN expansion <> 0 THEN 0.5 + u * expansion ELSE 0.5 END AS t FROM s JOIN species USING (species))
SELECT event_id, round(v * sin(t) * cos(0.3), 4) AS vx, round(v * sin(t) * sin(0.3), 4) AS vy, round(v * cos(t), 4) AS vz FROM w""")
def velocity_from_energy(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(s[0]) for s in SPECIES])
    rows = table(spark, d, "events").select("event_id", "value", ((F.col("user_id") % 7) / 10.0).alias("x"), names[(F.col("event_id") % 12).cast("int")].alias("species")).join(F.broadcast(species_table(spark)), "species")
    u = rng.between(rng.draw(5, F.col("event_id"), 0, 0), -1.0, 1.0)
    v = physics.velocity_from_energy(F.col("value") + 1, F.col("mass"), F.col("x"), F.lit(0.3), F.lit(0.5), u)
    return rows.select("event_id", v.alias("v")).select("event_id", *[r(F.col("v")[a], 4).alias(f"v{a}") for a in "xyz"])


@query(f"WITH {_P} SELECT id, round(px + vx * 0.001, 6) AS x, round(py + vy * 0.001, 6) AS y, round(pz + vz * 0.001, 6) AS z FROM p")
def position_update(spark: SparkSession, d: str) -> DataFrame:
    rows = bound_particles(spark, d).withColumn("pos", physics.moved(F.col("pos"), F.col("v"), 0.001))
    return rows.select("id", *[r(F.col("pos")[a]).alias(a) for a in "xyz"])


def _cross_sql(a: list[str], b: list[str]) -> list[str]:
    return [f"({a[1]} * {b[2]} - {a[2]} * {b[1]})", f"({a[2]} * {b[0]} - {a[0]} * {b[2]})", f"({a[0]} * {b[1]} - {a[1]} * {b[0]})"]


def _boris_sql() -> str:
    names = lambda p: [f"{p}{a}" for a in "xyz"]
    v, b, e, m, t, s, q = (names(x) for x in ("v", "b", "e", "m", "t", "s", "q"))
    vb, mt, qs = _cross_sql(v, b), _cross_sql(m, t), _cross_sql(q, s)
    col = lambda xs, ns: ", ".join(f"{x} AS {n}" for x, n in zip(xs, ns, strict=True))
    one = f"SELECT id, {', '.join(v)}, charge_c / mass AS g, {col([f'CAST(embedding[{28 + i}] AS DOUBLE) * 10' for i in range(3)], e)}, {col([f'CAST(embedding[{31 + i}] AS DOUBLE) * 0.01' for i in range(3)], b)} FROM p JOIN species USING (species) JOIN embeddings ON id = vec_id"
    two = f"SELECT *, {col([f'g * ({e[i]} + {vb[i]})' for i in range(3)], names('a'))}, {col([f'{b[i]} * g * 1e-4 / 2' for i in range(3)], t)} FROM one"
    three = f"SELECT *, {col([f'{v[i]} + a{a} * 1e-4 / 2' for i, a in enumerate('xyz')], m)}, {col([f'{t[i]} * 2 / (1 + tx * tx + ty * ty + tz * tz)' for i in range(3)], s)} FROM two"
    four = f"SELECT *, {col([f'{m[i]} + {mt[i]}' for i in range(3)], q)} FROM three"
    out = ", ".join(f"round({m[i]} + {qs[i]} + a{a} * 1e-4 / 2, 5) AS v{a}" for i, a in enumerate("xyz"))
    return f"WITH {_SPECIES_SQL}, {_P}, one AS ({one}), two AS ({two}), three AS ({three}), four AS ({four}) SELECT id, {out} FROM four"


@query(_boris_sql())
def boris_push(spark: SparkSession, d: str) -> DataFrame:
    fields = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), _vec(28, 10.0).alias("e"), _vec(31, 0.01).alias("b"))
    rows = bound_particles(spark, d).join(F.broadcast(species_table(spark)), "species").join(fields, "id")
    return physics.boris_push(rows, 1e-4).select("id", *[r(F.col("v")[a], 5).alias(f"v{a}") for a in "xyz"])


def _collision_sql(model: str, gas: str, n: float, dt: float) -> str:
    _, gm, gr, om, al, _ = next(s for s in SPECIES if s[0] == gas)
    section = f"{math.pi!r} * (radius + {gr!r}) * (radius + {gr!r})"
    if model != "HS":
        section = f"{math.pi!r} * ((radius + {gr!r}) * (radius + {gr!r}) / {math.gamma(2.5 - om)!r}) * pow(2 * {KT_REFERENCE!r} / (mass * {gm!r} / (mass + {gm!r}) * speed * speed), {om - 0.5!r})"
    u = [_draw_sql(11, "id", 3, i) for i in range(3)]
    cosine = {"HS": f"{u[1]} * 2 - 1", "VHS": u[1], "VSS": f"2 * pow({u[1]}, {1 / al!r}) - 1"}[model]
    base = f"c AS (SELECT *, sqrt(vx * vx + vy * vy + vz * vz) AS speed FROM p JOIN species USING (species)), h AS (SELECT *, {u[0]} < {section} * speed * {n!r} * {dt!r} AS hit, {cosine} AS co, 2 * {math.pi!r} * {u[2]} AS ph FROM c), "
    base += f"q AS (SELECT *, {gm!r} / ({gm!r} + mass) * speed AS len, sqrt(1 - co * co) AS si FROM h), w AS (SELECT *, len * si * cos(ph) AS dx, len * si * sin(ph) AS dy, len * co AS dz, acos(vz / speed) AS be, atan2(vy, vx) AS ga FROM q), "
    if model == "VSS":
        base += "x AS (SELECT *, cos(be) * dx + sin(be) * dz AS rx, cos(be) * dz - sin(be) * dx AS rz FROM w), y AS (SELECT *, cos(ga) * rx - sin(ga) * dy AS fx, sin(ga) * rx + cos(ga) * dy AS fy, rz AS fz FROM x)"
    else:
        base += "y AS (SELECT *, dx AS fx, dy AS fy, dz AS fz FROM w)"
    out = ", ".join(f"round(CASE WHEN hit THEN f{a} + v{a} * (mass / ({gm!r} + mass)) ELSE v{a} END, 5) AS v{a}" for a in "xyz")
    return f"WITH {_SPECIES_SQL}, {_P}, {base} SELECT id, hit AS collided, {out} FROM y"


def _collision(spark: SparkSession, d: str, model: str, gas: str, n: float, dt: float) -> DataFrame:
    rows = bound_particles(spark, d).join(F.broadcast(species_table(spark)), "species")
    return physics.collide(rows, model, gas, n, dt, 11, 3).select("id", "collided", *[r(F.col("v")[a], 5).alias(f"v{a}") for a in "xyz"])


@query(_collision_sql("HS", "Ne", 2.4e20, 1e-4))
def collision_hs(spark: SparkSession, d: str) -> DataFrame:
    return _collision(spark, d, "hs", "Ne", 2.4e20, 1e-4)


@query(_collision_sql("VHS", "He", 2.4e20, 1e-4))
def collision_vhs(spark: SparkSession, d: str) -> DataFrame:
    return _collision(spark, d, "VHS", "He", 2.4e20, 1e-4)


@query(_collision_sql("VSS", "Ar", 2.4e20, 1e-4))
def collision_vss(spark: SparkSession, d: str) -> DataFrame:
    return _collision(spark, d, "Vss", "Ar", 2.4e20, 1e-4)


@query(f"WITH {_P} SELECT id, round({_draw_sql(7, 'id', 2, 0)}, 9) AS u, round({_draw_sql(7, 'id', 2, 1)} * 8 - 3, 9) AS bounded FROM p")
def counter_rng(spark: SparkSession, d: str) -> DataFrame:
    rows = bound_particles(spark, d)
    return rows.select("id", r(rng.draw(7, F.col("id"), 2, 0), 9).alias("u"), r(rng.between(rng.draw(7, F.col("id"), 2, 1), -3.0, 5.0), 9).alias("bounded"))


@query(f"WITH {_SPECIES_SQL}, {_P} SELECT id, species, round(mass * 1e27, 6) AS mass, round(radius * 1e12, 6) AS radius, round(vti, 6) AS vti, round(vss_alpha, 6) AS vss_alpha, charge_ions, round(charge_c / {ELEMENTARY_CHARGE!r}, 6) AS charge FROM p JOIN species USING (species)")
def species_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = bound_particles(spark, d).join(F.broadcast(species_table(spark)), "species")
    return rows.select("id", "species", r(F.col("mass") * 1e27).alias("mass"), r(F.col("radius") * 1e12).alias("radius"), r("vti").alias("vti"), r("vss_alpha").alias("vss_alpha"), "charge_ions", r(F.col("charge_c") / ELEMENTARY_CHARGE).alias("charge"))


@query(f"WITH {_P} SELECT id, round(vx / m * 0.05, 6) AS x, round(vy / m * 0.05, 6) AS y, round(vz / m * 0.05, 6) AS z FROM (SELECT *, greatest(abs(vx), abs(vy), abs(vz)) AS m FROM p)")
def source_displacement(spark: SparkSession, d: str) -> DataFrame:
    rows = bound_particles(spark, d).select("id", physics.displacement(F.col("v"), 0.05).alias("m"))
    return rows.select("id", *[r(F.col("m")[a]).alias(a) for a in "xyz"])


@query("SELECT s_suppkey AS source_id, s_nationkey + 1 AS n, s_suppkey * 1000 + k AS id FROM supplier, LATERAL (SELECT unnest(range(s_nationkey + 1)) AS k)")
def point_source_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id"), (F.col("s_nationkey").cast("long") + 1).alias("n"))
    return particles.generated(rows, {"k": F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))}).select("source_id", "n", (F.col("source_id") * 1000 + F.col("k")).alias("id"))


@query("""SELECT s_suppkey AS cell, CAST(1000 // count(*) OVER w + CASE WHEN row_number() OVER (PARTITION BY s_nationkey ORDER BY CAST(s_suppkey AS VARCHAR)) <= 1000 % count(*) OVER w THEN 1 ELSE 0 END AS BIGINT) AS n
FROM supplier WINDOW w AS (PARTITION BY s_nationkey)""")
def surface_source_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select(F.col("s_nationkey").alias("name"), F.col("s_suppkey").cast("string").alias("cell_key"), F.lit(1000).cast("long").alias("count"), F.col("s_suppkey").alias("cell"))
    return particles.cell_counts(rows).select("cell", F.col("n").cast("long").alias("n"))


@query(f"WITH {_P} SELECT id FROM p WHERE sqrt(vx * vx + vy * vy + vz * vz) >= 100 AND id NOT IN (SELECT user_id FROM events WHERE value > 50)")
def flying_particles(spark: SparkSession, d: str) -> DataFrame:
    settled = table(spark, d, "events").where("value > 50").select(F.col("user_id").alias("particle_id")).distinct()
    return gather.unsettled(gather.fast(bound_particles(spark, d), 100.0), settled).select("id")


@query("SELECT user_id AS tri_id, count(*) AS cnt FROM events GROUP BY 1")
def settled_counts(spark: SparkSession, d: str) -> DataFrame:
    return gather.settled_counts(table(spark, d, "events").select(F.col("user_id").alias("tri_id")))


# ---------------------------------------------------------------- geometry and joins


@query(f"WITH {_P} SELECT gx, gy, gz, count(*) AS cnt FROM (SELECT " + ", ".join(f"CAST(least(greatest(trunc((p{a} + 40) / 5), 0), 15) AS INTEGER) AS g{a}" for a in "xyz") + " FROM p) GROUP BY 1, 2, 3")
def grid_index_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = bound_particles(spark, d).select(*[spatial.grid_index(F.col("pos")[a], -40.0, 5.0, spatial.grid_divisions(-40.0, 40.0, 5.0)).alias(f"g{a}") for a in "xyz"])
    return rows.groupBy("gx", "gy", "gz").agg(F.count(F.lit(1)).alias("cnt"))


_INSIDE = " OR ".join("(" + " AND ".join(f"{_det(*['p' if i == j else q for j, q in enumerate('abcd')])} {op} 0" for i in range(4)) + ")" for op in (">=", "<="))


@query(f"WITH {_P}, {_K} SELECT id, tetra_id FROM p JOIN k ON px BETWEEN least(ax, bx, cx, dx) AND greatest(ax, bx, cx, dx) AND ({_INSIDE}) AND {_det('a', 'b', 'c', 'd')} <> 0")
def particle_in_tetra(spark: SparkSession, d: str) -> DataFrame:
    return spatial.containing_tetras(bound_particles(spark, d), bound_tetras(spark, d), 10.0)


def _hit_sql() -> str:
    dirs, e1, e2, s = ([f"({p}{x} - {q}{x})" for x in "xyz"] for p, q in (("g", "p"), ("b", "a"), ("c", "a"), ("p", "a")))
    dot = lambda a, b: "(" + " + ".join(f"{p} * {q}" for p, q in zip(a, b, strict=True)) + ")"
    h, q = _cross_sql(dirs, e2), _cross_sql(s, e1)
    return f"SELECT id, tri_id, {dot(s, h)} / nullif({dot(e1, h)}, 0) AS u, {dot(dirs, q)} / nullif({dot(e1, h)}, 0) AS w, {dot(e2, q)} / nullif({dot(e1, h)}, 0) AS share FROM s, t"


_SEGMENTS = f"s AS (SELECT vec_id AS id, {_sql3('p', 40, 20.0, 50.0)}, {_sql3('g', 43, 20.0, 50.0)} FROM embeddings)"


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), _vec(40, 20.0, 50.0).alias("p0"), _vec(43, 20.0, 50.0).alias("p1"))


@query(f"WITH {_T}, {_SEGMENTS}, h AS ({_hit_sql()}) SELECT id, tri_id, round(share, 6) AS share FROM h WHERE u >= 0 AND w >= 0 AND u + w <= 1 AND share BETWEEN 0 AND 1")
def segment_triangle_hits(spark: SparkSession, d: str) -> DataFrame:
    hits = spatial.segment_hits(_segments(spark, d), bound_triangles(spark, d), 4.0, points=False)
    return hits.select("id", "tri_id", (F.floor(F.col("share") * 1e6 + 0.5) / 1e6).alias("share"))  # as round does, without a decimal for each hit


@query(f"WITH {_T}, {_SEGMENTS}, h AS ({_hit_sql()}), o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY share, tri_id) AS n FROM h WHERE u >= 0 AND w >= 0 AND u + w <= 1 AND share BETWEEN 0 AND 1) SELECT id, tri_id, round(share, 6) AS share FROM o WHERE n = 1")
def first_wall_hit(spark: SparkSession, d: str) -> DataFrame:
    return spatial.first_hits(_segments(spark, d), bound_triangles(spark, d), 4.0).select("id", "tri_id", r("share").alias("share"))


@query(f"WITH {_P} SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id < b.id AND sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py) + (a.pz - b.pz) * (a.pz - b.pz)) < 4")
def overlapping_particles(spark: SparkSession, d: str) -> DataFrame:
    return spatial.overlapping(bound_particles(spark, d).withColumn("radius", F.lit(2.0)), 4.0)


@query(f"WITH {_P} SELECT round(min(px), 6) AS x_min, round(max(px), 6) AS x_max, round(min(py), 6) AS y_min, round(max(py), 6) AS y_max, round(min(pz), 6) AS z_min, round(max(pz), 6) AS z_max FROM p")
def bounding_box(spark: SparkSession, d: str) -> DataFrame:
    box = mesh.bounding_box(bound_particles(spark, d).select("pos.*"))
    return box.select(*[r(c).alias(c) for c in box.columns])


@query(f"WITH {_T} SELECT tri_id, round((ax + bx + cx) / 3, 6) AS x, round((ay + t.by + cy) / 3, 6) AS y, round((az + bz + cz) / 3, 6) AS z, round(sqrt(pow((t.by - ay) * (cz - az) - (bz - az) * (cy - ay), 2) + pow((bz - az) * (cx - ax) - (bx - ax) * (cz - az), 2) + pow((bx - ax) * (cy - ay) - (t.by - ay) * (cx - ax), 2)) / 2, 6) AS area FROM t")
def triangle_shapes(spark: SparkSession, d: str) -> DataFrame:
    return mesh.with_shape(bound_triangles(spark, d)).select("tri_id", *[r(F.col("centroid")[a]).alias(a) for a in "xyz"], r("area").alias("area"))


_ADJ = f"{_T}, e AS (SELECT DISTINCT tri_id, least(p, q) AS p, greatest(p, q) AS q FROM (SELECT tri_id, n0 AS p, n1 AS q FROM t UNION ALL SELECT tri_id, n1, n2 FROM t UNION ALL SELECT tri_id, n0, n2 FROM t)), j AS (SELECT DISTINCT x.tri_id, y.tri_id AS neighbour FROM e x JOIN e y ON x.p = y.p AND x.q = y.q AND x.tri_id <> y.tri_id)"


@query(f"WITH {_ADJ} SELECT tri_id, neighbour FROM j")
def mesh_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return mesh.adjacency(bound_triangles(spark, d))


@query("WITH RECURSIVE " + _ADJ + ", n(source, tri_id, level) AS (SELECT tri_id, tri_id, 0 FROM t UNION SELECT n.source, j.neighbour, n.level + 1 FROM n JOIN j USING (tri_id) WHERE n.level < 2) SELECT source, tri_id, min(level) AS level FROM n GROUP BY 1, 2")
def neighbour_levels(spark: SparkSession, d: str) -> DataFrame:
    return mesh.triangle_levels(bound_triangles(spark, d), 2)


@query(f"WITH {_T} SELECT tri_id FROM t WHERE n0 < 25 AND n1 < 25 AND n2 < 25")
def physical_group_cells(spark: SparkSession, d: str) -> DataFrame:
    return mesh.group_cells(bound_triangles(spark, d), spark.range(25).select(F.col("id").alias("node_id")))


@query("""WITH e AS (SELECT vec_id AS element_id, [vec_id % 100, (vec_id * 3) % 100, (vec_id * 7) % 100] AS n FROM embeddings), x AS (SELECT element_id, unnest(n) AS id, generate_subscripts(n, 1) - 1 AS pos FROM e)
SELECT element_id, round(sum(CASE WHEN pos = 0 THEN CAST(v.embedding[1] AS DOUBLE) END), 6) AS x0, round(sum(CASE WHEN pos = 2 THEN CAST(v.embedding[3] AS DOUBLE) END), 6) AS z2 FROM x JOIN embeddings v ON v.vec_id = x.id GROUP BY 1""")
def element_corners(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    v = F.col("vec_id")
    cells = e.select(v.alias("element_id"), F.array(v % 100, (v * 3) % 100, (v * 7) % 100).alias("nodes"))
    nodes = e.select(v.alias("node_id"), _e(1).alias("x"), _e(2).alias("y"), _e(3).alias("z"))
    return mesh.joined_corners(cells, nodes, 3).select("element_id", r("v0.x").alias("x0"), r("v2.z").alias("z2"))


@query(f"WITH {_P}, w AS (SELECT id, px AS ax, py AS ay, pz AS az, vx AS bx, vy AS b_y, vz AS bz FROM p) SELECT id, round(ax * bx + ay * b_y + az * bz, 4) AS dot, round(ay * bz - az * b_y, 4) AS cx, round(az * bx - ax * bz, 4) AS cy, round(ax * b_y - ay * bx, 4) AS cz, round(sqrt(ax * ax + ay * ay + az * az), 6) AS module, round(bx / sqrt(bx * bx + b_y * b_y + bz * bz), 6) AS nx, sign(ax) AS sx, false AS parallel FROM w")
def vector_algebra(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("pos"), F.col("v")
    c = V.cross(a, b)
    return bound_particles(spark, d).select("id", r(V.dot(a, b), 4).alias("dot"), r(c["x"], 4).alias("cx"), r(c["y"], 4).alias("cy"), r(c["z"], 4).alias("cz"), r(V.module(a)).alias("module"), r(V.normalised(b)["x"]).alias("nx"), V.signs(a)["x"].cast("tinyint").alias("sx"), V.is_parallel(a, b).alias("parallel"))


@query(f"WITH {_P}, g AS (SELECT *, acos(vz / sqrt(vx * vx + vy * vy + vz * vz)) AS b, atan2(vy, vx) AS c FROM p), h AS (SELECT *, cos(b) * px + sin(b) * pz AS rx, cos(b) * pz - sin(b) * px AS rz FROM g) SELECT id, round(b, 6) AS beta, round(degrees(c), 6) AS gamma_deg, round(cos(c) * rx - sin(c) * py, 6) AS x, round(sin(c) * rx + cos(c) * py, 6) AS y, round(rz, 6) AS z FROM h")
def flight_frame_rotation(spark: SparkSession, d: str) -> DataFrame:
    beta, gamma = V.beta_gamma(F.col("v"))
    rows = bound_particles(spark, d).withColumn("b", beta).withColumn("g", gamma).withColumn("t", V.rotated(F.col("pos"), F.col("b"), F.col("g")))
    return rows.select("id", r("b").alias("beta"), r(units.degrees(F.col("g"))).alias("gamma_deg"), *[r(F.col("t")[a]).alias(a) for a in "xyz"])


# ---------------------------------------------------------------- gather and finite elements

_LOCATED = "l AS (SELECT event_id AS id, user_id % 400 AS tetra_id, ((event_id % 5) - 1) AS charge_c FROM events)"
_VOL = f"vol AS (SELECT tetra_id, abs({_det('a', 'b', 'c', 'd')}) / 6 AS volume, n0, n1, n2, n3 FROM k)"
_CELLS = f"{_K}, {_VOL}, {_LOCATED}, c AS (SELECT tetra_id, sum(charge_c) AS charge, any_value(volume) AS volume FROM l JOIN vol USING (tetra_id) GROUP BY 1)"


def _cells(spark: SparkSession, d: str) -> DataFrame:
    located = table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 400).alias("tetra_id"), ((F.col("event_id") % 5) - 1).cast("double").alias("charge_c"))
    return gather.tetra_charge(located, fem.with_gradients(bound_tetras(spark, d)))


@query(f"WITH {_CELLS} SELECT tetra_id, round(charge, 6) AS charge, round(charge / volume, 6) AS density FROM c")
def tetra_charge_density(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d).select("tetra_id", r("charge").alias("charge"), r("density").alias("density"))


@query(f"WITH {_CELLS}, b AS (SELECT tetra_id, unnest([n0, n1, n2, n3]) AS node_id FROM vol) SELECT node_id, round(sum(charge) / sum(volume), 6) AS value FROM b JOIN c USING (tetra_id) GROUP BY 1 HAVING sum(volume) > 0")
def node_charge_density(spark: SparkSession, d: str) -> DataFrame:
    return gather.node_density(_cells(spark, d), fem.tetra_nodes(bound_tetras(spark, d))).select("node_id", r("value").alias("value"))


@query(f"WITH {_LOCATED} SELECT 3 AS step, tetra_id, list_aggregate(list_sort(list(id)), 'string_agg', ',') AS ids FROM l GROUP BY tetra_id")
def particle_tracker(spark: SparkSession, d: str) -> DataFrame:
    located = table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 400).alias("tetra_id"))
    return gather.particle_lists(gather.tracker(located, 3)).select("step", "tetra_id", F.array_join(F.transform("particles", lambda x: x.cast("string")), ",").alias("ids"))


def _stiffness_sql() -> str:
    e = {i: [f"({q}{x} - a{x})" for x in "xyz"] for i, q in ((1, "b"), (2, "c"), (3, "d"))}
    g = {1: _cross_sql(e[2], e[3]), 2: _cross_sql(e[3], e[1]), 3: _cross_sql(e[1], e[2])}
    grads = ", ".join(f"{g[i][j]} / det AS g{i}{x}" for i in (1, 2, 3) for j, x in enumerate("xyz"))
    zero = ", ".join(f"-(g1{x} + g2{x} + g3{x}) AS g0{x}" for x in "xyz")
    cells = ", ".join(f"{{'row': n{i}, 'col': n{j}, 'value': abs(det) / 6 * (" + " + ".join(f"g{i}{x} * g{j}{x}" for x in "xyz") + ")}" for i in range(4) for j in range(4))
    return f"{_K}, kd AS (SELECT *, {_det('a', 'b', 'c', 'd')} AS det FROM k), kg AS (SELECT *, {grads} FROM kd WHERE det <> 0), k0 AS (SELECT *, {zero} FROM kg), ke AS (SELECT unnest([{cells}]) AS e FROM k0), m AS (SELECT e.row AS row, e.col AS col, sum(e.value) AS value FROM ke GROUP BY 1, 2)"


@query(f"WITH {_stiffness_sql()} SELECT row, col, round(value, 5) AS value FROM m")
def stiffness_assembly(spark: SparkSession, d: str) -> DataFrame:
    return fem.stiffness(bound_tetras(spark, d)).select("row", "col", r("value", 5).alias("value"))


@query(f"WITH {_stiffness_sql()}, pot AS (SELECT n_nationkey + 1 AS node_id, n_nationkey * 0.5 AS phi FROM nation), z AS (SELECT tetra_id, unnest([{', '.join(f'{{{chr(39)}n{chr(39)}: n{i}, {chr(39)}x{chr(39)}: g{i}x, {chr(39)}y{chr(39)}: g{i}y, {chr(39)}z{chr(39)}: g{i}z}}' for i in range(4))}]) AS g FROM k0) SELECT tetra_id, round(sum(-phi * g.x), 5) AS ex, round(sum(-phi * g.y), 5) AS ey, round(sum(-phi * g.z), 5) AS ez FROM z JOIN pot ON g.n = node_id GROUP BY 1")
def tetra_field(spark: SparkSession, d: str) -> DataFrame:
    pot = table(spark, d, "nation").select((F.col("n_nationkey") + 1).alias("node_id"), (F.col("n_nationkey") * 0.5).alias("phi"))
    return fem.field(bound_tetras(spark, d), pot).select("tetra_id", *[r(f"e{a}", 5).alias(f"e{a}") for a in "xyz"])


_COO = "m AS (SELECT l_partkey AS row, l_suppkey AS col, CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2)"


def _coo(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col")).agg(F.sum("l_quantity").cast("double").alias("value"))


@query(f"WITH {_COO} SELECT row, count(DISTINCT col) AS nnz FROM m GROUP BY 1")
def matrix_graph(spark: SparkSession, d: str) -> DataFrame:
    return fem.graph(_coo(spark, d))


@query(f"WITH {_COO} SELECT row AS idx, round(sum(value * s_acctbal), 4) AS value FROM m JOIN supplier ON col = s_suppkey GROUP BY 1")
def matrix_vector_product(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "supplier").select(F.col("s_suppkey").alias("idx"), F.col("s_acctbal").cast("double").alias("value"))
    return fem.spmv(_coo(spark, d), x).select("idx", r("value", 4).alias("value"))


@query(f"WITH {_COO}, b AS (SELECT DISTINCT s_suppkey - 1 AS row FROM supplier WHERE s_nationkey < 5) SELECT row, col, round(value, 6) AS value FROM m WHERE row NOT IN (SELECT row FROM b) UNION ALL SELECT row, row, 1.0 FROM b")
def dirichlet_matrix(spark: SparkSession, d: str) -> DataFrame:
    bc = table(spark, d, "supplier").where("s_nationkey < 5").select(F.col("s_suppkey").alias("node_id"))
    return fem.dirichlet_matrix(_coo(spark, d), bc).select("row", "col", r("value").alias("value"))


@query("SELECT p_partkey AS idx, round(coalesce(CAST(s_acctbal AS DOUBLE), CAST(p_retailprice AS DOUBLE)), 6) AS value FROM part LEFT JOIN (SELECT * FROM supplier WHERE s_nationkey < 5) ON p_partkey = s_suppkey - 1")
def dirichlet_rhs(spark: SparkSession, d: str) -> DataFrame:
    bc = table(spark, d, "supplier").where("s_nationkey < 5").select(F.col("s_suppkey").alias("node_id"), F.col("s_acctbal").cast("double").alias("value"))
    rhs = table(spark, d, "part").select(F.col("p_partkey").alias("idx"), F.col("p_retailprice").cast("double").alias("value"))
    return fem.dirichlet_rhs(rhs, bc).select("idx", r("value").alias("value"))


@query("WITH b AS (SELECT CAST(unnest(string_split(ids, ',')) AS BIGINT) AS node_id, v FROM (SELECT string_agg(CAST(s_suppkey AS VARCHAR), ',') AS ids, s_nationkey * 1.5 AS v FROM supplier GROUP BY s_nationkey)) SELECT node_id, round(v, 6) AS value FROM b")
def boundary_conditions(spark: SparkSession, d: str) -> DataFrame:
    keyed = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.array_join(F.collect_list(F.col("s_suppkey").cast("string")), " , ").alias("node_ids")).select("node_ids", (F.col("s_nationkey") * 1.5).alias("value"))
    return config.boundary_conditions(keyed).select("node_id", r("value").alias("value"))


@query()
def potential_solve(spark: SparkSession, d: str) -> DataFrame:
    """Conjugate gradients over a mesh's stiffness matrix; compared with a dense solve in the tests."""
    tetras = bound_tetras(spark, d)
    bc = table(spark, d, "nation").where("n_nationkey < 4").select((F.col("n_nationkey") + 1).alias("node_id"), F.col("n_nationkey").cast("double").alias("value"))
    rhs = fem.tetra_nodes(tetras).select("node_id").distinct().select(F.col("node_id").alias("idx"), F.lit(1.0).alias("value"))
    shifted = fem.stiffness(tetras).select((F.col("row") - 1).alias("row"), (F.col("col") - 1).alias("col"), "value")
    return fem.solve(shifted, rhs.select((F.col("idx") - 1).alias("idx"), "value"), bc).select("idx", r("value", 4).alias("value"))


# ---------------------------------------------------------------- distribution and tracks

_SHAPES = "h AS (SELECT tri_id, cnt, (ax + bx + cx) / 3 AS mx, (ay + t.by + cy) / 3 AS my, (az + bz + cz) / 3 AS mz, sqrt(pow((t.by - ay) * (cz - az) - (bz - az) * (cy - ay), 2) + pow((bz - az) * (cx - ax) - (bx - ax) * (cz - az), 2) + pow((bx - ax) * (cy - ay) - (t.by - ay) * (cx - ax), 2)) / 2 AS area FROM t)"


@query(f"""WITH {_ADJ}, {_SHAPES}, n AS (SELECT tri_id AS source, tri_id AS target FROM t UNION SELECT tri_id, neighbour FROM j),
p AS (SELECT source, target, s.cnt AS c, g.area, pow(s.mx - g.mx, 2) + pow(s.my - g.my, 2) + pow(s.mz - g.mz, 2) AS d2 FROM n JOIN h s ON s.tri_id = source JOIN h g ON g.tri_id = target WHERE s.cnt > 0),
m AS (SELECT source, greatest(0.5, 2 * sqrt(avg(area))) AS sigma FROM p GROUP BY 1), w AS (SELECT p.*, area * exp(-d2 / (2 * sigma * sigma)) AS w FROM p JOIN m USING (source))
SELECT source, target, CAST(greatest(1, round(c * 100.0 * w / sum(w) OVER (PARTITION BY source))) AS BIGINT) AS num FROM w""")
def distribution_shares(spark: SparkSession, d: str) -> DataFrame:
    cells = bound_triangles(spark, d)
    members = mesh.classes(cells)
    return distribute.class_shares(cells, members, mesh.class_levels(members, 1), 2)


_TRACKS = "tr AS (SELECT user_id AS particle_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, value AS x, value * 2 AS y, CAST(event_id % 100 AS DOUBLE) AS z FROM events)"


def _tracks(spark: SparkSession, d: str) -> DataFrame:
    rows = tracks.ordered(table(spark, d, "events"), "user_id", ["ts", "event_id"])
    return rows.select(F.col("user_id").alias("particle_id"), F.col("seq").cast("long").alias("seq"), F.col("value").alias("x"), (F.col("value") * 2).alias("y"), (F.col("event_id") % 100).cast("double").alias("z"))


@query(f"WITH {_TRACKS}, s AS (SELECT *, lag(x) OVER w AS px, lag(z) OVER w AS pz FROM tr WINDOW w AS (PARTITION BY particle_id ORDER BY seq)) SELECT particle_id, seq, round(px, 6) AS x0, round(x, 6) AS x1, round(pz, 6) AS z0, round(z, 6) AS z1 FROM s WHERE px IS NOT NULL")
def track_segments(spark: SparkSession, d: str) -> DataFrame:
    return tracks.segments(_tracks(spark, d)).select("particle_id", "seq", r("p0.x").alias("x0"), r("p1.x").alias("x1"), r("p0.z").alias("z0"), r("p1.z").alias("z1"))


@query(f"WITH {_TRACKS} SELECT particle_id, seq, round(x + 0.25 * (coalesce(lead(x) OVER w, x) - x), 6) AS ix, round(z + 0.25 * (coalesce(lead(z) OVER w, z) - z), 6) AS iz FROM tr WINDOW w AS (PARTITION BY particle_id ORDER BY seq)")
def track_interpolation(spark: SparkSession, d: str) -> DataFrame:
    return tracks.interpolated(_tracks(spark, d), 0.25).select("particle_id", "seq", r("ix").alias("ix"), r("iz").alias("iz"))


@query(f"WITH {_TRACKS}, l AS (SELECT particle_id, count(*) AS n_points FROM tr GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY n_points DESC, particle_id) - 1 AS n FROM l) SELECT particle_id, n_points, CAST(n // 7 AS INTEGER) AS spawn FROM o WHERE n < 35")
def spawn_groups(spark: SparkSession, d: str) -> DataFrame:
    return tracks.spawn_groups(_tracks(spark, d), 7, 5)


@query(f"WITH {_TRACKS} SELECT particle_id, seq FROM tr WHERE particle_id IN (SELECT DISTINCT particle_id FROM tr ORDER BY 1 LIMIT 50)")
def recorded_tracks(spark: SparkSession, d: str) -> DataFrame:
    return tracks.recorded(_tracks(spark, d), 50).select("particle_id", "seq")


@query(f"WITH {_TRACKS} SELECT particle_id, count(*) AS n, string_agg(CAST(CAST(z AS BIGINT) AS VARCHAR), ' ' ORDER BY seq) AS zs FROM tr GROUP BY 1 HAVING count(*) > 1")
def nested_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Tracks as arrays, through their JSON form and back."""
    made = tracks.nested(_tracks(spark, d)).select("particle_id", F.from_json(F.to_json("points"), "array<struct<x:double,y:double,z:double>>").alias("p"))
    return made.select("particle_id", F.size("p").cast("long").alias("n"), F.array_join(F.transform("p", lambda q: q["z"].cast("long").cast("string")), " ").alias("zs"))


@query("WITH v AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT value FROM events WHERE value IS NOT NULL)) SELECT i.range AS pos, round(value, 6) AS value FROM range(9) i JOIN v ON place = CAST(round_even(i.range * (n - 1.0) / 8, 0) AS BIGINT)")
def spaced_values(spark: SparkSession, d: str) -> DataFrame:
    return tracks.spaced_values(table(spark, d, "events"), "value", 9).select("pos", r("value").alias("value"))


# ---------------------------------------------------------------- at the reference's parameters (the queries above follow their SQL's)


@query()
def recorded_tracks_reference(spark: SparkSession, d: str) -> DataFrame:
    return tracks.recorded(_tracks(spark, d)).select("particle_id", "seq")


@query()
def kde_grid_reference(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "lineitem").groupBy(F.round(F.col("l_extendedprice") / 1000).alias("x"), F.col("l_quantity").cast("double").alias("y")).agg((F.count(F.lit(1)) * 0.14).alias("w"))
    return deposition.kde(points).select("gx", "gy", r("density", 9).alias("density"))


@query()
def neighbour_levels_reference(spark: SparkSession, d: str) -> DataFrame:
    return mesh.triangle_levels(bound_triangles(spark, d))


@query()
def distribution_shares_reference(spark: SparkSession, d: str) -> DataFrame:
    cells = bound_triangles(spark, d)
    members = mesh.classes(cells)
    return distribute.class_shares(cells, members, mesh.class_levels(members), 2)


# ---------------------------------------------------------------- scalar functions and text


@query("""WITH u AS (SELECT event_id, CAST(round(value, 3) AS VARCHAR) AS t, round(value, 3) AS v, (['K', 'F', 'C'])[event_id % 3 + 1] AS tu, (['ns', 'ms', 'min'])[event_id % 3 + 1] AS su, (['mPa', 'kPa', 'psi'])[event_id % 3 + 1] AS pu FROM events)
SELECT event_id, round(CASE tu WHEN 'K' THEN v WHEN 'F' THEN (v - 32) * (5.0 / 9) + 273.15 ELSE v + 273.15 END, 6) AS kelvin,
round(CASE WHEN v > 0 THEN v * CASE su WHEN 'ns' THEN 1e-9 WHEN 'ms' THEN 1e-3 ELSE 60 END ELSE 0 END, 6) AS seconds, round(CASE WHEN v > 0 THEN v * CASE pu WHEN 'mPa' THEN 1e-3 WHEN 'kPa' THEN 1e3 ELSE 6894.76 END ELSE 0 END, 8) AS pascal FROM u""")
def unit_conversion(spark: SparkSession, d: str) -> DataFrame:
    k = (F.col("event_id") % 3).cast("int")
    pick = lambda *names: F.array(*[F.lit(n) for n in names])[k]
    value = F.round("value", 3).cast("string")
    return table(spark, d, "events").select("event_id", r(units.to_kelvin(value, pick("K", "F", "C"))).alias("kelvin"), r(units.to_si(value, pick("ns", "ms", "min"), "time")).alias("seconds"), r(units.to_si(value, pick("mPa", "kPa", "psi"), "pressure"), 8).alias("pascal"))


@query(f"WITH {_P} SELECT id, round(CAST(printf('%.6f', px) AS DOUBLE), 6) AS x, round(CAST(printf('%.6f', py) AS DOUBLE), 6) AS y, round(CAST(printf('%.6f', pz) AS DOUBLE), 6) AS z FROM p")
def coordinate_keys(spark: SparkSession, d: str) -> DataFrame:
    """Points through their text keys of six decimals and back."""
    key = F.format_string("%.6f, %.6f, %.6f", F.col("pos.x"), F.col("pos.y"), F.col("pos.z"))
    return bound_particles(spark, d).select("id", V.from_text(key).alias("p")).select("id", *[r(F.col("p")[a]).alias(a) for a in "xyz"])


@query(f"WITH {_P} SELECT id, round(px, 6) AS x, round(vz, 6) AS vz, round(sqrt(vx * vx + vy * vy + vz * vz), 6) AS magnitude FROM p")
def vector_view_lines(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written as .pos lines, parsed again."""
    line = text.vector_line([F.col("pos")[a] for a in "xyz"], [F.col("v")[a] for a in "xyz"])
    cells = [c.alias(n) for c, n in zip(text.vector_cells(F.col("line")), ("x", "y", "z", "vx", "vy", "vz"), strict=True)]
    found = bound_particles(spark, d).select("id", line.alias("line")).select("id", *cells)
    return found.select("id", r("x").alias("x"), r("vz").alias("vz"), r(F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2 + F.col("vz") ** 2)).alias("magnitude"))


@query(f"WITH {_P} SELECT id, round(acos(vz / sqrt(vx * vx + vy * vy + vz * vz)), 6) AS theta, round(atan2(vy, vx), 6) AS phi FROM p")
def direction_angles(spark: SparkSession, d: str) -> DataFrame:
    theta, phi = units.theta_phi(F.col("v"))
    return bound_particles(spark, d).select("id", r(theta).alias("theta"), r(phi).alias("phi"))


@query("SELECT event_id, round(P / (8.314 * T) * 6.02214076e23 / 1e18, 3) AS n_e18 FROM (SELECT event_id, 1.0 + user_id % 10 AS P, 300.0 AS T FROM events)")
def gas_concentration(spark: SparkSession, d: str) -> DataFrame:
    each = units.concentration(1.0, 300.0)
    return table(spark, d, "events").select("event_id", r((1.0 + F.col("user_id") % 10) * each / 1e18, 3).alias("n_e18"))


@query(f"WITH {_P} SELECT id, round(0.8 * px - 0.6 * py + 1, 6) AS x, round(0.6 * px + 0.8 * py - 2, 6) AS y, round(2 * pz + 3, 6) AS z FROM p")
def affine_transform(spark: SparkSession, d: str) -> DataFrame:
    moved = V.affine(F.col("pos"), [[0.8, -0.6, 0, 1], [0.6, 0.8, 0, -2], [0, 0, 2, 3], [0, 0, 0, 1]])
    return bound_particles(spark, d).select("id", moved.alias("p")).select("id", *[r(F.col("p")[a]).alias(a) for a in "xyz"])


# ---------------------------------------------------------------- cells, lookups and directions


@query(f"WITH {_K} SELECT tetra_id, round((ax + bx + cx + dx) / 4, 6) AS x, round((ay + by + cy + dy) / 4, 6) AS y, round((az + bz + cz + dz) / 4, 6) AS z, round(abs({_det('a', 'b', 'c', 'd')}) / 6, 4) AS volume FROM k")
def tetra_centres(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("centre")
    return fem.with_centre(bound_tetras(spark, d)).select("tetra_id", *[r(c[a]).alias(a) for a in "xyz"], r("volume", 4).alias("volume"))


@query(f"WITH {_K} SELECT round(sum(abs({_det('a', 'b', 'c', 'd')}) / 6), 2) AS volume FROM k")
def mesh_volume(spark: SparkSession, d: str) -> DataFrame:
    return fem.total_volume(bound_tetras(spark, d)).select(r("volume", 2).alias("volume"))


@query(f"WITH {_P}, {_K} SELECT DISTINCT id FROM p JOIN k ON px BETWEEN least(ax, bx, cx, dx) AND greatest(ax, bx, cx, dx) AND ({_INSIDE}) AND {_det('a', 'b', 'c', 'd')} <> 0")
def inside_mesh(spark: SparkSession, d: str) -> DataFrame:
    return spatial.inside_mesh(bound_particles(spark, d), bound_tetras(spark, d), 10.0).select("id")


@query("""WITH t AS (SELECT event_id % 4 AS step, event_id AS particle_id, user_id % 400 AS tetra_id FROM events)
SELECT e.event_id % 3 AS step, e.event_id AS particle_id, t.tetra_id FROM events e LEFT JOIN t ON t.particle_id = e.event_id AND t.step = e.event_id % 3""")
def tracked_cells(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select(F.col("event_id").alias("particle_id"), (F.col("user_id") % 400).alias("tetra_id"))
    tracked = events.select((F.col("particle_id") % 4).alias("step"), "particle_id", "tetra_id")
    return gather.tracked_cells(tracked, events.select((F.col("particle_id") % 3).alias("step"), "particle_id"))


@query("SELECT l_orderkey AS node_id, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 150000) GROUP BY 1")
def free_nodes(spark: SparkSession, d: str) -> DataFrame:
    fixed = table(spark, d, "orders").where("o_totalprice > 150000").select(F.col("o_orderkey").alias("node_id"))
    return fem.free_nodes(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("node_id")), fixed).groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(DISTINCT l_orderkey) AS rows, count(DISTINCT l_partkey) AS cols, count(*) AS nnz, count(*) = 0 AS empty FROM lineitem")
def matrix_shape(spark: SparkSession, d: str) -> DataFrame:
    return fem.shape(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col")))


@query(f"WITH m AS (SELECT DISTINCT l_orderkey AS idx FROM lineitem) SELECT idx, round({_draw_sql(9, 'idx', 0, 0)} * 2 - 1, 9) AS value FROM m")
def randomised_vector(spark: SparkSession, d: str) -> DataFrame:
    return fem.randomised(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("idx")).distinct(), 9).select("idx", r("value", 9).alias("value"))


@query(f"SELECT event_id, {', '.join('round(' + _draw_sql(3, 'event_id', 1, i) + f' * 10 - 5, 9) AS {a}' for i, a in enumerate('xyz'))} FROM events")
def random_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", V.random(3, F.col("event_id"), 1, -5.0, 5.0).alias("v")).select("event_id", *[r(F.col("v")[a], 9).alias(a) for a in "xyz"])


@query("WITH m AS (SELECT max(value) AS most FROM events), i AS (SELECT event_id, CAST(least(greatest(floor(coalesce(value / nullif(most, 0), 0) * 256), 0), 255) AS INTEGER) AS idx FROM events, m) SELECT event_id, idx, round(idx / 255.0, 6) AS red, round(1 - idx / 255.0, 6) AS blue FROM i")
def colour_entries(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    most = events.agg(F.max("value").alias("most"))  # one row
    idx = events.join(F.broadcast(most)).select("event_id", units.colour_index(F.col("value"), F.col("most")).alias("idx"))
    return idx.withColumn("c", units.colour(F.col("idx"))).select("event_id", "idx", r("c.red").alias("red"), r("c.blue").alias("blue"))


_TURNS = "WITH t AS (SELECT event_id, radians(event_id % 80 + 1) AS a, radians(user_id % 70 + 2) AS b, radians(event_id % 60 + 3) AS c FROM events), q AS (SELECT event_id, cos(b) * cos(c) AS x, sin(a) * sin(c) AS y, cos(a) * cos(b) AS z FROM t) "


@query(_TURNS + "SELECT event_id, round(acos(z / sqrt(x * x + y * y + z * z)), 6) AS theta, round(atan2(y, x), 6) AS phi FROM q")
def turned_directions(spark: SparkSession, d: str) -> DataFrame:
    theta, phi = units.theta_phi_of_turns(F.col("event_id") % 80 + 1, F.col("user_id") % 70 + 2, F.col("event_id") % 60 + 3)
    return table(spark, d, "events").select("event_id", r(theta).alias("theta"), r(phi).alias("phi"))


@query(f"WITH {_P}, w AS (SELECT id, vx - px AS x, vy - py AS y, vz - pz AS z FROM p) SELECT id, round(acos(z / sqrt(x * x + y * y + z * z)), 6) AS theta, round(atan2(y, x), 6) AS phi FROM w")
def two_point_directions(spark: SparkSession, d: str) -> DataFrame:
    theta, phi = units.theta_phi_between(F.col("pos"), F.col("v"))
    return bound_particles(spark, d).select("id", r(theta).alias("theta"), r(phi).alias("phi"))


@query("SELECT min(vec_id) AS min_id, max(vec_id % 97) AS max_cnt FROM embeddings")
def mesh_extremes(spark: SparkSession, d: str) -> DataFrame:
    return mesh.extremes(bound_triangles(spark, d))


@query("SELECT max(n) AS n_points FROM (SELECT count(*) AS n FROM events GROUP BY user_id)")
def longest_track(spark: SparkSession, d: str) -> DataFrame:
    return tracks.longest(table(spark, d, "events").select(F.col("user_id").alias("particle_id")))


@query(f"""WITH {_SPECIES_SQL}, s AS (SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS name, ({_NAMES_SQL})[s_suppkey % 12 + 1] AS species, CAST(s_suppkey % 50 + 1 AS BIGINT) AS n, (s_suppkey % 3) / 10.0 AS x FROM supplier),
b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s),
g AS (SELECT name, species, x, CAST(before AS BIGINT) + unnest(range(n)) AS id FROM b),
w AS (SELECT id, name, sqrt(2 * 10.0 * {EV_TO_J!r} / mass) AS v, CASE WHEN x <> 0 THEN 0.4 + ({_draw_sql(7, 'id', 0, 0)} * 2 - 1) * x ELSE 0.4 END AS t FROM g JOIN species USING (species))
SELECT id, name AS source, round(v * sin(t) * cos(0.2), 4) AS vx, round(v * sin(t) * sin(0.2), 4) AS vy, round(v * cos(t), 4) AS vz FROM w""")
def point_particles(spark: SparkSession, d: str) -> DataFrame:
    """The generator of point sources: ids over all sources, velocities from energy and a drawn angle."""
    names = F.array(*[F.lit(s[0]) for s in SPECIES])
    key = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(
        key.cast("string").alias("name"), names[(key % 12).cast("int")].alias("type"), (key % 50 + 1).cast("long").alias("count"), F.lit(10.0).alias("energy_ev"),
        F.lit(0.2).alias("phi"), F.lit(0.4).alias("theta"), ((key % 3) / 10.0).alias("expansion"), V.vec(0, 0, 0).alias("pos"),
    )
    return particles.from_points(rows, seed=7).select("id", "source", *[r(F.col("v")[a], 4).alias(f"v{a}") for a in "xyz"])


@query("""WITH s AS (SELECT s_nationkey, s_suppkey, format('{}, 0, 0', s_suppkey) AS cell_key, row_number() OVER (PARTITION BY s_nationkey ORDER BY format('{}, 0, 0', s_suppkey)) AS k, count(*) OVER (PARTITION BY s_nationkey) AS c FROM supplier),
n AS (SELECT s_suppkey, CAST(s_nationkey AS VARCHAR) || ':' || cell_key AS source, 100 // c + CASE WHEN k <= 100 % c THEN 1 ELSE 0 END AS n FROM s)
SELECT source, CAST(n AS BIGINT) AS n, CAST(s_suppkey AS DOUBLE) AS x, round(sqrt(2 * 2.0 * """ + repr(EV_TO_J) + """ / 7.9485017e-26), 4) AS vz FROM n WHERE n > 0""")
def surface_particles(spark: SparkSession, d: str) -> DataFrame:
    """The generator of surface sources: a source's count over its cells, each particle along its cell's normal."""
    key = F.concat(F.col("s_suppkey").cast("string"), F.lit(", 0, 0"))
    rows = table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("name"), F.lit("Ti").alias("type"), F.lit(100).cast("long").alias("count"), F.lit(2.0).alias("energy_ev"), key.alias("cell_key"), V.vec(0, 0, 1).alias("normal"))
    found = particles.from_surfaces(rows)
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("pos.x").alias("x"), r(F.max("v.z"), 4).alias("vz"))


@query("""WITH g AS (SELECT o_custkey, list(o_orderkey % 5 ORDER BY o_orderkey) AS l FROM orders GROUP BY 1), p AS (SELECT *, len(l) - list_position(list_reverse(l), 3) + 1 AS last FROM g)
SELECT o_custkey, array_to_string(CASE WHEN list_contains(l, 3) THEN list_concat(l[1 : last - 1], l[last + 1 :]) ELSE l END, ',') AS rest FROM p""")
def lists_without_last(spark: SparkSession, d: str) -> DataFrame:
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: k % 5).alias("l"))
    return lists.select("o_custkey", F.array_join(F.transform(units.without_last(F.col("l"), F.lit(3).cast("long")), lambda x: x.cast("string")), ",").alias("rest"))
