"""Shared SQL fragments of the checks: the derived tables, written independently of the DataFrame code."""

from __future__ import annotations

COMPOSITE = "0.3*stablecoin_risk + 0.25*defi_liquidity_risk + 0.25*contagion_risk + 0.2*arbitrage_opacity"

SUMS = """sums AS (
  SELECT c_mktsegment AS series_id, CAST(l_shipdate AS DATE) AS ds, count(*) AS n,
         CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS q,
         CAST(sum(CAST(round(l_discount*100) AS BIGINT)) AS BIGINT) AS d,
         CAST(sum(CAST(round(l_tax*100) AS BIGINT)) AS BIGINT) AS t,
         count(*) FILTER (WHERE l_returnflag = 'R') AS r
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  GROUP BY 1, 2)"""

_CH = """SELECT *, CAST(0.3 AS DOUBLE)*stablecoin_risk + CAST(0.25 AS DOUBLE)*defi_liquidity_risk
    + CAST(0.25 AS DOUBLE)*contagion_risk + CAST(0.2 AS DOUBLE)*arbitrage_opacity AS idx FROM (
    SELECT series_id, ds, CAST(q AS DOUBLE)/n*CAST(2 AS DOUBLE) AS stablecoin_risk, CAST(d AS DOUBLE)/n*CAST(10 AS DOUBLE) AS defi_liquidity_risk,
           CAST(t AS DOUBLE)/n*CAST(12.5 AS DOUBLE) AS contagion_risk, CAST(r AS DOUBLE)/n*CAST(100 AS DOUBLE) AS arbitrage_opacity FROM {src})"""

PANEL = SUMS + ",\npanel AS (" + _CH.format(src="sums") + ")"

TOTAL = (
    SUMS
    + """,
total_sums AS (SELECT 'ALL' AS series_id, ds, sum(n) AS n, CAST(sum(q) AS BIGINT) AS q, CAST(sum(d) AS BIGINT) AS d,
  CAST(sum(t) AS BIGINT) AS t, sum(r) AS r FROM sums GROUP BY ds),
panel AS ("""
    + _CH.format(src="total_sums")
    + ")"
)

EVENTS_DIM = """events_dim AS (SELECT * FROM (VALUES
  ('E1', DATE '1996-05-12', 'critical'), ('E2', DATE '1997-06-17', 'high'),
  ('E3', DATE '1998-11-11', 'critical'), ('E4', DATE '2000-03-11', 'elevated')) v(event, event_date, expected_level))"""

COINS = """coins AS (SELECT *, abs(1.0 - price) AS peg_deviation FROM (
  SELECT p_brand AS symbol, CAST(sum(CAST(round(p_retailprice*100) AS BIGINT) * p_size) AS DOUBLE)/100.0 AS circulating,
         1.0 + (CAST(sum(p_size) AS DOUBLE)/count(*) - 25.0)/1000.0 AS price FROM part GROUP BY 1))"""

PROTOCOLS = """protocols AS (SELECT s_suppkey AS protocol_id,
  CASE s_nationkey % 4 WHEN 0 THEN 'Lending' WHEN 1 THEN 'RWA' WHEN 2 THEN 'Dexes' ELSE 'Bridge' END AS category,
  greatest(s_acctbal, 0.0) AS tvl,
  CASE s_suppkey % 5 WHEN 0 THEN '2' WHEN 1 THEN '0' WHEN 2 THEN 'yes' WHEN 3 THEN '' END AS audits,
  CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal/1000.0 END AS change_1d FROM supplier)"""

REVENUE = """revenue AS (SELECT l_suppkey AS supplier, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
  CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS DOUBLE) AS cents FROM lineitem GROUP BY 1, 2)"""

DAILY_ORDERS = """daily_orders AS (SELECT CAST(o_orderdate AS DATE) AS ds,
  CAST(sum(CAST(round(o_totalprice*100) AS BIGINT)) AS DOUBLE)/100.0 AS tvl, count(*) AS n FROM orders GROUP BY 1)"""

OBSERVATIONS = (
    DAILY_ORDERS
    + """,
observations AS (SELECT 'treasury_10y' AS indicator, ds,
  CASE WHEN date_diff('day', DATE '1970-01-01', ds) % 7 = 0 THEN '.' ELSE CAST(round(2.0 + n % 40 / 10.0, 1) AS VARCHAR) END AS value
  FROM daily_orders)"""
)

PEG_POINTS = """peg_points AS (SELECT 'K' || CAST(user_id % 10 AS VARCHAR) AS symbol, ts,
  1.0 + (round(value*100) % 100 - 50)/1000.0 AS price FROM events WHERE value IS NOT NULL)"""

HEADLINES = """headlines AS (SELECT doc_id, text AS title, source, lang,
  (doc_id * 37 % 201 - 100)/100.0 AS sentiment FROM documents)"""


def W(*ctes: str, q: str) -> str:
    """WITH clause from the fragments, then the query."""
    return "WITH " + ",\n".join(ctes) + "\n" + q


def draw_sql(seed: int, rep: str, num: str) -> str:
    h = f"(({seed} + ({rep})::BIGINT*1000003 + ({num})::BIGINT*7919 + 12345) % 2147483647)"
    h = f"(({h}*48271) % 2147483647)"
    h = f"(xor({h}, {h} >> 15))"
    h = f"(({h}*69621) % 2147483647)"
    h = f"(xor({h}, {h} >> 13))"
    return f"(({h}*16807) % 2147483647)"


def normal_tail_sql(z: str) -> str:
    """Two-sided normal tail of |z|, by Simpson's rule over the density from 0 to |z|."""
    y = f"least(abs({z}), 40.0)"
    return f"""greatest(0.0, 1 - 2*{y}/12000/sqrt(2*pi()) * list_sum(list_transform(range(0, 4001), lambda g: CASE WHEN g = 0 OR g = 4000 THEN 1 WHEN g % 2 = 1 THEN 4 ELSE 2 END * exp(-0.5*({y}*g/4000)^2))))"""


def student_tail_sql(t: str, df: str) -> str:
    """Two-sided Student tail, the beta integral in asin(sqrt(.)) by Simpson's rule."""
    top = f"asin(sqrt({df}/({df} + ({t})*({t}))))"
    return f"""{top}/12000 * list_sum(list_transform(range(1, 4001), lambda g: CASE WHEN g = 4000 THEN 1 WHEN g % 2 = 1 THEN 4 ELSE 2 END * 2*exp(({df}-1)*ln(sin({top}*g/4000)) + lgamma(({df}+1)/2.0) - lgamma(0.5::DOUBLE) - lgamma({df}/2.0))))"""


def _entry(i: int, j: int, diagonal: str) -> str:
    return diagonal if i == j else f"r{min(i, j)}{max(i, j)}"


def cofactor_sql(i: int, j: int, diagonal: str) -> str:
    """Cofactor of the symmetric 4 x 4 matrix with `diagonal` and the correlations r12 .. r34."""
    a, b = ([k for k in range(1, 5) if k != x] for x in (i, j))
    m = [[_entry(x, y, diagonal) for y in b] for x in a]
    det = " + ".join(f"{m[0][k]}*({m[1][(k + 1) % 3]}*{m[2][(k + 2) % 3]} - {m[1][(k + 2) % 3]}*{m[2][(k + 1) % 3]})" for k in range(3))
    return f"{'-' if (i + j) % 2 else ''}({det})"


_CHANNELS = ("stablecoin_risk", "defi_liquidity_risk", "contagion_risk", "arbitrage_opacity")
_SIX = [(i, j) for i in range(1, 5) for j in range(i + 1, 5)]
_SQUARES = " + ".join(f"r{i}{j}*r{i}{j}" for i, j in _SIX)
_TRIPLES = "r12*r13*r23 + r12*r14*r24 + r13*r14*r34 + r23*r24*r34"
_FOURS = "r12*r12*r34*r34 + r13*r13*r24*r24 + r14*r14*r23*r23 - 2*(r12*r34*r13*r24 + r12*r34*r14*r23 + r13*r24*r14*r23)"

# Correlations of the channels, the determinant, and the four eigenvalues less 1: the outer ones by Newton's steps from outside on the
# characteristic polynomial of the matrix without its diagonal, the inner ones from the quadratic that is left.
CORRELATIONS = (
    "cm AS (SELECT series_id, count(*) AS n, "
    + ", ".join(f"corr({_CHANNELS[i - 1]}, {_CHANNELS[j - 1]}) AS r{i}{j}" for i, j in _SIX)
    + f""" FROM panel GROUP BY 1),
 cd AS (SELECT *, {_SQUARES} AS sq, 1 - ({_SQUARES}) + 2*({_TRIPLES}) + {_FOURS} AS det, 2*({_TRIPLES}) AS s3, {_FOURS} AS s4 FROM cm)"""
)
_STEP = "{x} - CASE WHEN 4*{x}*{x}*{x} - 2*sq*{x} - s3 = 0 THEN 0 ELSE ({x}*{x}*{x}*{x} - sq*{x}*{x} - s3*{x} + s4)/(4*{x}*{x}*{x} - 2*sq*{x} - s3) END"
SPECTRUM = (
    CORRELATIONS
    + f""",
 nw AS (WITH RECURSIVE w AS (SELECT series_id, sq, s3, s4, 0 AS step, CAST(3 AS DOUBLE) AS a, CAST(-1 AS DOUBLE) AS b FROM cd
   UNION ALL SELECT series_id, sq, s3, s4, step + 1, {_STEP.format(x="a")}, {_STEP.format(x="b")} FROM w WHERE step < 120) SELECT series_id, a, b, sq FROM w WHERE step = 120),
 ev AS (SELECT series_id, unnest([1, 2, 3, 4]) AS component, unnest([a, (-(a+b) + gap)/2, (-(a+b) - gap)/2, b]) AS mu FROM (SELECT *, sqrt(greatest(0.0, (a+b)*(a+b) - 4*(-sq - a*b + (a+b)*(a+b)))) AS gap FROM nw))"""
)

# Loadings: the column of the adjugate of R - (1 + mu) I with the largest diagonal entry, of unit length, times the root of the eigenvalue.
_ADJUGATE = [[cofactor_sql(i, j, "(-mu)") for j in range(1, 5)] for i in range(1, 5)]
LOADINGS = (
    SPECTRUM
    + ",\n aj AS (SELECT *, "
    + ", ".join(f"[{', '.join(row)}] AS k{i}" for i, row in enumerate(_ADJUGATE, 1))
    + """ FROM ev JOIN cd USING (series_id)),
 co AS (SELECT series_id, n, component, mu, CASE greatest(abs(k1[1]), abs(k2[2]), abs(k3[3]), abs(k4[4])) WHEN abs(k1[1]) THEN k1 WHEN abs(k2[2]) THEN k2 WHEN abs(k3[3]) THEN k3 ELSE k4 END AS v FROM aj),
 ld AS (SELECT series_id, n, component, (1+mu)/4 AS share, list_transform(v, lambda x: x * CASE WHEN list_sum(v) < 0 THEN -1 ELSE 1 END * sqrt(greatest(0.0, 1+mu)) / sqrt(list_inner_product(v, v))) AS l FROM co),
 """
    + "lo AS (" + " UNION ALL ".join(f"SELECT series_id, n, component, '{c}' AS channel, l[{i}] AS loading, share FROM ld" for i, c in enumerate(_CHANNELS, 1)) + ")"
)
