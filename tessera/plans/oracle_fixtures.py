"""The FIXTURES.md views as DuckDB SQL, for the oracle side of every query.

``with_fixtures(body, *names)`` prepends the needed views as CTEs (dependencies first).
"""

from __future__ import annotations

FIXTURE_SQL = {
    "bars_h": """SELECT event_type AS tic, date_trunc('hour', ts) AS ts, min_by(value, event_id) AS open,
  max(value) AS high, min(value) AS low, max_by(value, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
FROM events GROUP BY event_type, date_trunc('hour', ts)""",
    "bars_d": """SELECT o_orderpriority AS tic, CAST(o_orderdate AS DATE) AS date, min_by(o_totalprice, o_orderkey) AS open,
  max(o_totalprice) AS high, min(o_totalprice) AS low, max_by(o_totalprice, o_orderkey) AS close,
  CAST(count(*) AS DOUBLE) AS volume, CAST(isodow(o_orderdate) - 1 AS INT) AS day
FROM orders WHERE isodow(o_orderdate) - 1 < 5
GROUP BY o_orderpriority, CAST(o_orderdate AS DATE), isodow(o_orderdate) - 1""",
    "bars_x": """SELECT p_brand AS tic, CAST(l_shipdate AS DATE) AS date, max(l_extendedprice) AS close,
  sum(l_quantity) AS volume
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, CAST(l_shipdate AS DATE)""",
    "macro_m": """SELECT o_orderpriority AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
  round(avg(o_totalprice), 4) AS value
FROM orders WHERE NOT (o_orderpriority = '5-LOW' AND o_orderdate >= TIMESTAMP '2001-05-01 00:00:00')
GROUP BY o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE)""",
    "news": """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM'
    WHEN 3 THEN '4-NOT SPECIFIED' ELSE '5-LOW' END AS tic,
  DATE '1995-01-01' + CAST(((doc_id * 7) % 200) * 12 + floor(doc_id / 400) % 3 AS INT) AS created,
  regexp_extract(text, '^[^.\n]*', 0) AS title, text AS body,
  CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 17 = 0 THEN 'As an AI language model I cannot say'
       WHEN doc_id % 13 = 0 THEN 'Rate: 8' ELSE CAST(1 + (doc_id * 3 + n_chars) % 10 AS VARCHAR) END AS benz_rate
FROM documents""",
    "earnings": """SELECT tic, fiscal AS fiscalDateEnding, fiscal + CAST(20 + (month(fiscal) * 7) % 15 AS INT) AS reportedDate,
  eps AS reportedEPS, est AS estimatedEPS, round(eps - est, 4) AS surprise
FROM (SELECT tic, fiscal, eps, CASE WHEN month(fiscal) = 7 AND year(fiscal) = 1997 THEN NULL
        ELSE lag(eps) OVER (PARTITION BY tic ORDER BY fiscal) END AS est
      FROM (SELECT o_orderpriority AS tic, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS fiscal,
              round(avg(o_totalprice) / 10000, 4) AS eps
            FROM orders GROUP BY 1, 2) q) e""",
    "preds": """SELECT tic, date, lag(close) OVER (PARTITION BY tic ORDER BY date) AS prediction, close AS observed
FROM bars_d""",
    "feed": """SELECT event_id AS id, CAST(ts AS DATE) AS date, event_type AS ticker, CAST(event_id % 6 AS INT) AS importance,
  CASE event_id % 3 WHEN 0 THEN 'Upgrades' WHEN 1 THEN 'Downgrades' ELSE 'Maintains' END AS action,
  value AS yield, props
FROM events""",
    "universe": """SELECT p_partkey AS symbol_id, concat('P', CAST(p_partkey AS VARCHAR)) AS symbol, p_name AS name,
  p_type AS sector, p_brand AS exchange, p_retailprice AS close, p_retailprice * p_size * 1000000 AS marketcap
FROM part""",
}

DEPENDS = {"preds": ["bars_d"]}


def sql_round_even(expr: str, n: int) -> str:
    """DuckDB text of ``tessera.functions.numeric.round_half_even`` (same arithmetic)."""
    return f"(round_even(round(({expr}) * {10 ** (n + 3)}) / 1000, 0) / {10 ** n})"


def with_fixtures(body: str, *names: str) -> str:
    """Prefix ``body`` with the named fixture views (and their dependencies) as CTEs."""
    order: list[str] = []

    def add(n):
        for d in DEPENDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    if not order:
        return body.strip()
    ctes = ",\n".join(f"{n} AS (\n{FIXTURE_SQL[n]}\n)" for n in order)
    body = body.strip()
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes},\n{body[14:].lstrip()}"
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
