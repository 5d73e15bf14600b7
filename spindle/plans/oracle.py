"""DuckDB SQL twins of the registered queries (views: the driver tables).

Each query is ``WITH <needed CTEs> <body>``; CTEs are listed in dependency
order and pulled in by name.
"""

from __future__ import annotations

CTES: dict[str, str] = {
    "sig": """sig AS (
  SELECT 'R' || CAST(user_id % 2 AS VARCHAR) AS rat, '2024-01' AS dt, event_type AS channel,
         CAST(floor((epoch_us(ts) - 1704067200000000) / 3600000000.0) AS BIGINT) AS time,
         row_number() OVER (PARTITION BY user_id % 2, event_type ORDER BY ts, event_id) - 1 AS i,
         CAST(round(value * 100) AS BIGINT) AS v, event_id
  FROM events)""",
    "taps": """taps AS (
  SELECT CAST(label + 5 AS INTEGER) AS frequency, CAST(u AS INTEGER) AS u,
         CAST(round(avg(e) * 1000) AS SMALLINT) AS h
  FROM (SELECT label, unnest(range(len(embedding))) AS u, unnest(embedding) AS e FROM embeddings)
  GROUP BY label, u)""",
    "conv": """conv AS (
  SELECT t.rat, t.dt, t.channel, t.time, t.i, k.frequency, CAST(sum(CAST(k.h AS BIGINT) * s.v) AS BIGINT) AS y
  FROM sig t
  JOIN sig s ON s.rat = t.rat AND s.dt = t.dt AND s.channel = t.channel
            AND s.i BETWEEN t.i - (SELECT max(u) FROM taps) AND t.i
  JOIN taps k ON k.u = t.i - s.i
  WHERE t.i >= (SELECT max(u) FROM taps)
  GROUP BY t.rat, t.dt, t.channel, t.time, t.i, k.frequency)""",
    "pw": """pw AS (
  SELECT rat, dt, channel, time, frequency, CAST(y * y AS FLOAT) AS convolution FROM conv)""",
    "av": """av AS (
  SELECT time, frequency, avg(convolution) AS convolution FROM pw GROUP BY time, frequency)""",
    "ra": """ra AS (
  SELECT DISTINCT p.rat, p.frequency, p.channel, p.dt, av.convolution, p.time
  FROM pw p JOIN av ON p.time = av.time AND p.frequency = av.frequency)""",
    "st": """st AS (
  SELECT rat, dt, channel, frequency, CAST(avg(convolution) AS FLOAT) AS mean,
         CAST(stddev_pop(convolution) AS FLOAT) AS sd
  FROM ra GROUP BY rat, dt, channel, frequency)""",
    "z": """z AS (
  SELECT r.rat, r.dt, r.channel, r.time, r.frequency,
         CAST((r.convolution - s.mean) / nullif(s.sd, 0) AS FLOAT) AS convolution
  FROM ra r JOIN st s ON r.rat = s.rat AND r.dt = s.dt AND r.channel = s.channel AND r.frequency = s.frequency)""",
    "passes": """passes AS (
  SELECT CAST(floor((epoch_us(ts) - 1704067200000000) / 3600000000.0) AS BIGINT) AS lo,
         CAST(floor((epoch_us(ts) - 1704067200000000) / 3600000000.0) AS BIGINT) + 2 AS hi
  FROM events WHERE value >= 200)""",
    "zp": """zp AS (
  SELECT * FROM z WHERE EXISTS (SELECT 1 FROM passes p WHERE z.time >= p.lo AND z.time <= p.hi))""",
    "phase": """phase AS (
  SELECT time, CAST((time * 1234567) % 6283187 - 3141593 AS INTEGER) AS phase
  FROM (SELECT DISTINCT CAST(floor((epoch_us(ts) - 1704067200000000) / 3600000000.0) AS BIGINT) AS time
        FROM events))""",
    "pb": """pb AS (
  SELECT time, CAST(floor(((phase - (-3141593)) / 6283187.0) * 75) + 1 AS INTEGER) AS phaserange FROM phase)""",
    "prof": """prof AS (
  SELECT zp.rat, zp.dt, zp.channel, zp.frequency, pb.phaserange, CAST(avg(zp.convolution) AS FLOAT) AS convolution
  FROM zp JOIN pb ON zp.time = pb.time
  GROUP BY zp.rat, zp.dt, zp.channel, zp.frequency, pb.phaserange)""",
}

_DEPS: dict[str, list[str]] = {
    "sig": [], "taps": [], "conv": ["sig", "taps"], "pw": ["conv"], "av": ["pw"], "ra": ["av"],
    "st": ["ra"], "z": ["st"], "passes": [], "zp": ["z", "passes"], "phase": [], "pb": ["phase"],
    "prof": ["zp", "pb"],
}


def with_ctes(*names: str, body: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        for d in _DEPS[n]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(CTES[n] for n in order) + "\n" + body


# --- transforms -------------------------------------------------------------

SERIES64 = """SELECT vec_id, j, CAST(embedding[j + 1] AS DOUBLE) AS x, CAST(embedding[len(embedding) - j] AS DOUBLE) AS y
  FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS j FROM embeddings)"""

USER_SEGMENTS = """SELECT user_id, jj // 128 AS segment, jj % 128 AS j, value AS x, CAST(0 AS DOUBLE) AS y
  FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS jj FROM events)"""


def dft_sql(src: str, keys: list[str], out_index: str, inverse: bool = False, scale: bool = False,
            half: bool = False, digits: int | None = 4) -> str:
    """sum_j (x + iy) e^{-+2 pi i j k / n} for every group of ``src`` (columns keys, j, x, y)."""
    ks = ", ".join(keys)
    using = " AND ".join(f"s.{k} = kk.{k}" for k in keys)
    sgn = "+" if inverse else "-"
    rng = "range(n // 2 + 1)" if half else "range(n)"
    f = " / kk.n" if scale else ""
    t = "(2 * pi() * ((s.j * kk.k) % kk.n) / kk.n)"

    def rnd(e: str) -> str:
        return e if digits is None else f"round({e}, {digits}) + 0.0"

    re = f"sum(s.x * cos({t}) {'-' if sgn == '+' else '+'} s.y * sin({t})){f}"
    im = f"sum({'' if sgn == '+' else '-'}s.x * sin({t}) + s.y * cos({t})){f}"
    return f"""WITH s AS ({src}),
nn AS (SELECT {ks}, max(j) + 1 AS n FROM s GROUP BY {ks}),
kk AS (SELECT {ks}, n, unnest({rng}) AS k FROM nn)
SELECT {", ".join(f"kk.{k}" for k in keys)}, kk.k AS {out_index},
       {rnd(re)} AS re, {rnd(im)} AS im
FROM s JOIN kk ON {using}
GROUP BY {", ".join(f"kk.{k}" for k in keys)}, kk.k, kk.n"""
