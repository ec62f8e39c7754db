"""DuckDB-runnable SQL twins of the registered queries.

The adapter CTEs shape the driver tables like the card domain (FIXTURES.md
§4).  Money sums are written over DECIMAL(18,2) so that they are exact in
both engines; standard deviations, medians, correlations and other values
that two engines round differently are rounded to a fixed number of
decimals on both sides.
"""

ADAPTERS = {
    "txn": """
SELECT l.l_orderkey*10 + l.l_linenumber AS transaction_id,
       o.o_orderdate AS date, o.o_custkey AS client_id, l.l_orderkey AS card_id,
       l.l_extendedprice AS amount_usd,
       CASE WHEN l.l_linestatus = 'F' THEN 'Chip Transaction' ELSE 'Swipe Transaction' END AS transaction_type,
       l.l_suppkey AS merchant_id, n.n_name AS merchant_city,
       CASE WHEN n.n_nationkey % 5 = 0 THEN NULL ELSE r.r_name END AS merchant_state,
       p.p_size AS mcc,
       CASE WHEN l.l_returnflag = 'R' THEN 'Insufficient Balance'
            WHEN l.l_returnflag = 'A' AND l.l_quantity < 5 THEN 'Bad PIN' END AS errors
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey JOIN part p ON l.l_partkey = p.p_partkey""",
    "cards": """
SELECT o_orderkey AS card_id, o_custkey AS client_id, o_totalprice AS credit_limit_usd,
       o_orderstatus = 'P' AS card_on_dark_web
FROM orders""",
    "users": """
SELECT c_custkey AS id,
       CASE WHEN c_nationkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
       CASE WHEN c_custkey % 97 <> 0 THEN CAST(300 + c_custkey % 551 AS INT) END AS credit_score,
       c_acctbal*10 AS yearly_income, c_acctbal AS total_debt, c_acctbal/2 AS per_capita_income,
       CAST(1 + c_nationkey % 9 AS INT) AS num_credit_cards,
       CAST(18 + c_custkey % 70 AS INT) AS current_age,
       CAST(60 + c_custkey % 10 AS INT) AS retirement_age
FROM customer""",
    "event_txn": """
SELECT event_id AS transaction_id, ts AS date, user_id AS client_id, value AS amount_usd,
       CASE WHEN event_type = 'error' THEN 'error' END AS errors
FROM events""",
    "raw_cards": """
SELECT o_orderkey AS id, o_custkey AS client_id,
       CASE WHEN o_orderkey % 7 = 0 THEN concat('$-', CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR), ' ')
            WHEN o_orderkey % 11 = 0 THEN concat(' $1,', lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0'), '.50')
            ELSE concat('$', CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR)) END AS amount,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE concat(CAST(o_orderkey % 99999 AS VARCHAR), '.0') END AS zip,
       concat(CAST(extract(month FROM o_orderdate) AS VARCHAR), '/', CAST(extract(year FROM o_orderdate) AS VARCHAR)) AS expires,
       CASE o_orderstatus WHEN 'F' THEN ' yes' WHEN 'O' THEN 'NO' ELSE 'unknown' END AS has_chip,
       CASE WHEN o_orderkey % 17 = 0 THEN 'garbage' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS opened
FROM orders""",
    "city_coords": """
SELECT upper(concat(n.n_name, '|', CASE WHEN n.n_nationkey % 3 = 0 THEN 'elsewhere' ELSE r.r_name END)) AS city_state,
       CAST(20 + n.n_nationkey*1.5 AS DOUBLE) AS lat, CAST(-130 + n.n_nationkey*3.0 AS DOUBLE) AS lon
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "state_coords": """
SELECT CASE WHEN r_regionkey = 3 THEN 'elsewhere' ELSE r_name END AS state,
       CAST(30 + r_regionkey*4 AS DOUBLE) AS lat, CAST(-120 + r_regionkey*9 AS DOUBLE) AS lon
FROM region""",
    "labels_in": """
SELECT o_orderkey AS id, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority = '1-URGENT' END AS fraud FROM orders""",
    "mcc_codes": """
SELECT p_size AS id, min(p_type) AS description FROM part GROUP BY p_size""",
}

# Reusable SQL fragments (exact money moments).
def msum(x: str) -> str:
    return f"CAST(SUM(CAST({x} AS DECIMAL(18,6))) AS DOUBLE)"


def mmean(x: str) -> str:
    return f"(CAST(SUM(CAST({x} AS DECIMAL(18,6))) AS DOUBLE) / COUNT({x}))"


def mstd(x: str, nd: int = 6) -> str:
    return f"round(stddev_samp({x}), {nd})"


def with_(names: list[str], body: str, extra: dict[str, str] | None = None) -> str:
    parts = [f"{n} AS ({ADAPTERS[n]}\n)" for n in names]
    for k, v in (extra or {}).items():
        parts.append(f"{k} AS ({v}\n)")
    return "WITH " + ",\n".join(parts) + "\n" + body


# ---------------------------------------------------------------- isolation forest

def _word(text: str, k: int) -> str:
    return f"CAST(concat('0x', substr(md5({text}), {1 + 8 * k}, 8)) AS BIGINT)"


def _path(n: str) -> str:
    return f"(CASE WHEN {n} = 2 THEN 1.0 WHEN {n} > 2 THEN 2 * (ln({n} - 1) + 0.5772156649015329) - 2 * ({n} - 1) / CAST({n} AS DOUBLE) ELSE 0.0 END)"


def forest(src: str, key: str, keep: str, features: list[str], trees: int, psi: int, contamination: float, seed: int) -> dict[str, str]:
    """CTEs that build and score the forest of ``operators.iforest`` over ``src``; the last is ``labelled``
    (key, keep, anomaly_score, anomaly).  Levels are unrolled: psi bounds the depth."""
    prime, k = 2 ** 31 - 1, len(features)
    depth = max(1, (psi - 1).bit_length())
    cte = {
        "fx": f"SELECT {key}, {keep}, [{', '.join(f'CAST(coalesce({c}, avg({c}) OVER ()) AS DOUBLE)' for c in features)}] AS x FROM {src}",
        "fsize": f"SELECT least({psi}, count(*)) AS psi, greatest(1, ceil(log2(least({psi}, count(*))))) AS depth FROM fx",
        "ftree": f"SELECT range AS t, 1 + {_word(f'concat({seed}, chr(58), range)', 0)} % {prime - 1} AS factor, "
                 f"{_word(f'concat({seed}, chr(58), range)', 1)} AS shift FROM range({trees})",
        "fbase": f"SELECT *, CAST({key} AS VARCHAR) AS k, {_word(f'CAST({key} AS VARCHAR)', 0)} % {prime} AS base FROM fx",
        "fs0": f"""SELECT t, x, CAST(0 AS BIGINT) AS node FROM (SELECT t, x,
       row_number() OVER (PARTITION BY t ORDER BY (base * factor + shift) % {prime}, k) AS place FROM fbase, ftree)
WHERE place <= (SELECT psi FROM fsize)""",
    }
    for d in range(depth + 1):
        cte[f"fn{d}"] = f"""SELECT t, node, n,
       CASE WHEN n > 1 AND {d} < (SELECT depth FROM fsize) AND len(ok) > 0 THEN ok[1 + {_word(f"concat({seed}, chr(58), t, chr(58), node)", 0)} % len(ok)] END AS f,
       {_word(f"concat({seed}, chr(58), t, chr(58), node)", 1)} / 4294967296.0::DOUBLE AS u, lo, hi
FROM (SELECT *, [i FOR i IN range(1, {k + 1}) IF hi[i] > lo[i]] AS ok FROM (
      SELECT t, node, count(*) AS n, [{', '.join(f'min(x[{i}])' for i in range(1, k + 1))}] AS lo,
             [{', '.join(f'max(x[{i}])' for i in range(1, k + 1))}] AS hi FROM fs{d} GROUP BY t, node))"""
        if d < depth:
            cte[f"fs{d + 1}"] = f"""SELECT s.t, s.x, 2 * s.node + CASE WHEN s.x[f] < lo[f] + (hi[f] - lo[f]) * u THEN 1 ELSE 2 END AS node
FROM fs{d} s JOIN fn{d} n ON s.t = n.t AND s.node = n.node WHERE f IS NOT NULL"""
    cte["fnodes"] = "\nUNION ALL ".join(f"SELECT t, node, n, f, lo[f] + (hi[f] - lo[f]) * u AS threshold FROM fn{d}" for d in range(depth + 1))
    cte["fw0"] = f"SELECT {key}, x, t, CAST(0 AS BIGINT) AS node FROM fx, ftree"
    for d in range(depth):
        cte[f"fw{d + 1}"] = f"""SELECT w.{key}, w.x, w.t, CASE WHEN n.f IS NULL THEN w.node WHEN w.x[n.f] < n.threshold THEN 2 * w.node + 1 ELSE 2 * w.node + 2 END AS node
FROM fw{d} w LEFT JOIN fnodes n ON w.t = n.t AND w.node = n.node"""
    cte["fscore"] = f"""SELECT {key}, -pow(2.0, -(total / (1000000000.0::DOUBLE * {trees})) / (SELECT {_path('psi')} FROM fsize)) AS score
FROM (SELECT w.{key}, CAST(sum(CAST(floor(log2(w.node + 1)) AS BIGINT) * 1000000000 + CAST(round({_path('coalesce(n.n, 0)')} * 1000000000) AS BIGINT)) AS DOUBLE) AS total
      FROM fw{depth} w LEFT JOIN fnodes n ON w.t = n.t AND w.node = n.node GROUP BY w.{key})"""
    cte["labelled"] = f"""SELECT fx.{key}, fx.{keep}, score - edge AS anomaly_score, CASE WHEN score - edge < 0 THEN -1 ELSE 1 END AS anomaly,
       CASE WHEN score - edge < 0 THEN 'Anomaly' ELSE 'Normal' END AS label
FROM fscore JOIN fx ON fscore.{key} = fx.{key}, (SELECT quantile_cont(score, {contamination}) AS edge FROM fscore)"""
    return cte
