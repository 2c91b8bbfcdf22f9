"""Building blocks of the equivalent SQL: named common table expressions with their needs."""

from __future__ import annotations

ROW = "ROWS BETWEEN {} PRECEDING AND CURRENT ROW"
PAST = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def win(n: int, by: str = "ticker", order: str = "date") -> str:
    return f"(PARTITION BY {by} ORDER BY {order} {ROW.format(n - 1)})"


def rolling(agg: str, x: str, n: int, by: str = "ticker", order: str = "date") -> str:
    """``agg(x)`` over the last n rows, null until n values are there."""
    w = win(n, by, order)
    return f"CASE WHEN count({x}) OVER {w} = {n} THEN {agg}({x}) OVER {w} END"


def lag(x: str, n: int) -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY ticker ORDER BY date)"


def r(x: str, digits: int = 6) -> str:
    """Rounded the way ``catalog.rounded`` does."""
    return f"(floor(CAST({x} AS DOUBLE) * 1e{digits} + 0.51) / 1e{digits})"


def rank_share(x: str, by: str = "date") -> str:
    """Average rank of the non-null values over their count."""
    return (
        f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {x} ASC NULLS LAST)"
        f" + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {by}) END"
    )


def average_rank(x: str, by: str) -> str:
    return (
        f"(rank() OVER (PARTITION BY {by} ORDER BY {x} ASC NULLS LAST)"
        f" + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0)"
    )


_PLACE = "(l_orderkey, l_linenumber, l_extendedprice / l_quantity)"


def _factor(priority: str) -> str:
    return (
        f"(coalesce(avg(CASE WHEN o_orderpriority = '{priority}' THEN o_totalprice END), avg(o_totalprice))"
        " - avg(o_totalprice)) / 1e7"
    )


BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {
    "bars": (
        (),
        f"""SELECT CAST(l_shipdate AS DATE) AS date, p_brand AS ticker,
  arg_min(l_extendedprice / l_quantity, {_PLACE}) AS open,
  max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  arg_max(l_extendedprice / l_quantity, {_PLACE}) AS close,
  arg_max(l_extendedprice / l_quantity, {_PLACE}) * (1 - avg(l_discount)) AS adj_close,
  CAST(sum(l_quantity) AS BIGINT) AS volume
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    ),
    "sectors": (
        (),
        """SELECT DISTINCT p_brand AS ticker, 'S' || CAST(CAST(substr(p_brand, 7) AS INT) % 4 AS VARCHAR) AS sector
FROM part WHERE CAST(substr(p_brand, 7) AS INT) % 7 <> 0""",
    ),
    "panel": (
        ("bars", "sectors"),
        "SELECT b.*, coalesce(s.sector, 'Unknown') AS sector FROM bars b LEFT JOIN sectors s USING (ticker)",
    ),
    "membership": (
        ("bars",),
        """SELECT ticker, min(date) AS added,
  CASE WHEN CAST(substr(ticker, 7) AS INT) % 5 = 0
    THEN min(date) + CAST(floor((max(date) - min(date)) * 6 / 10) AS INT) END AS removed
FROM bars GROUP BY 1""",
    ),
    "factors": (
        (),
        f"""SELECT CAST(o_orderdate AS DATE) AS date, {_factor('1-URGENT')} AS MKT_RF, {_factor('2-HIGH')} AS SMB,
  {_factor('3-MEDIUM')} AS HML, {_factor('4-NOT SPECIFIED')} AS RMW, {_factor('5-LOW')} AS CMA, 0.0001 AS RF
FROM orders GROUP BY 1""",
    ),
    "returns": (
        ("panel",),
        f"SELECT *, ln(adj_close) AS lp, ln(adj_close) - {lag('ln(adj_close)', 1)} AS lr FROM panel",
    ),
    "market": (
        ("returns",),
        "SELECT date, avg(lr) AS mkt, stddev_samp(lr) AS xs_std FROM returns GROUP BY 1",
    ),
    "matrix": (
        ("returns",),
        f"""SELECT date, ticker, adj_close, lp - {lag('lp', 5)} AS return_5d, {lag('lp', 5)} - {lag('lp', 65)} AS momentum_60,
  {rolling('stddev_samp', 'lr', 20)} AS vol_20, (high - low) / close AS range_ratio, ahead - avg(ahead) OVER (PARTITION BY date) AS y
FROM (SELECT *, lead(lp, 5) OVER (PARTITION BY ticker ORDER BY date) - lp AS ahead FROM returns)""",
    ),
    "predictions": (
        ("matrix",),
        """SELECT 'mom60' AS model_id, date, ticker, momentum_60 AS prediction FROM matrix WHERE momentum_60 IS NOT NULL
UNION ALL SELECT 'range1', date, ticker, range_ratio FROM matrix WHERE range_ratio IS NOT NULL
UNION ALL SELECT 'ret5', date, ticker, -return_5d FROM matrix WHERE return_5d IS NOT NULL
UNION ALL SELECT 'vol20', date, ticker, -vol_20 FROM matrix WHERE vol_20 IS NOT NULL""",
    ),
    "evaluation": (
        ("predictions", "matrix"),
        "SELECT p.*, m.y AS realized FROM predictions p LEFT JOIN matrix m USING (date, ticker)",
    ),
    "valid": (("evaluation",), "SELECT * FROM evaluation WHERE prediction IS NOT NULL AND realized IS NOT NULL"),
    "ranked": (
        ("valid",),
        f"""SELECT *, {average_rank('prediction', 'model_id, date')} AS rp, {average_rank('realized', 'model_id, date')} AS rr
FROM valid""",
    ),
    "ic_all": (
        ("ranked",),
        "SELECT model_id, date, corr(rp, rr) AS ic, count(*) AS n FROM ranked GROUP BY 1, 2",
    ),
    "ic": (("ic_all",), "SELECT * FROM ic_all WHERE n >= 5 AND ic IS NOT NULL AND isfinite(ic)"),
    "placed": (
        ("valid",),
        """SELECT *, row_number() OVER (PARTITION BY model_id, date ORDER BY prediction, ticker) AS pos,
  count(*) OVER (PARTITION BY model_id, date) AS n FROM valid""",
    ),
    "legs": (
        ("placed",),
        """SELECT *, CASE WHEN pos > n - k THEN 1 WHEN pos <= k THEN -1 END AS side
FROM (SELECT *, greatest(1, CAST(round_even(n * 0.2, 0) AS INT)) AS k FROM placed WHERE n >= 10)
WHERE pos > n - k OR pos <= k""",
    ),
    "book": (
        ("legs",),
        """SELECT model_id, date, avg(realized) FILTER (WHERE side = 1) - avg(realized) FILTER (WHERE side = -1) AS ret
FROM legs GROUP BY 1, 2""",
    ),
    "dispersion": (
        ("returns",),
        f"""SELECT date, dispersion FROM (SELECT date, {rolling('avg', 's', 20, '1', 'date')} AS dispersion
FROM (SELECT date, stddev_samp(lr) AS s FROM returns GROUP BY 1)) WHERE dispersion IS NOT NULL""",
    ),
    "tabular": (
        (),
        """SELECT event_id AS id, 'u' || CAST(user_id AS VARCHAR) AS code, event_type AS sub_code,
  'c' || CAST(length(event_type) AS VARCHAR) AS sub_category, [1, 3, 10, 25][CAST(user_id % 4 + 1 AS INT)] AS horizon,
  CAST(floor((epoch_us(ts) - 1704067200000000) / 3600000000.0) AS INT) AS ts_index, value AS feature_a,
  CASE WHEN k % 10 <> 0 THEN k END AS feature_b, value * (event_id % 7 + 1) AS feature_c,
  1.0 + value * value / 100.0 AS weight, (value - 20.0) / 10.0 + (event_id % 11 - 5) / 5.0 AS y_target
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)""",
    ),
}


def with_blocks(names: tuple[str, ...] | list[str], query: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """A statement with the named blocks and everything they need, then ``extra`` blocks, then ``query``."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in BLOCKS[name][0]:
            visit(need)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS MATERIALIZED ({BLOCKS[n][1]})" for n in order]
    parts += [f"{n} AS ({sql})" for n, sql in (extra or {}).items()]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(parts) + "\n" + query


def ols_blocks(name: str, source: str, by: list[str], xs: list[str] | tuple[str, ...], y: str, having: str = "true") -> dict[str, str]:
    """Blocks that end in ``name``: (by, n, a, b0, b1, ..., r2, sse), least squares with intercept per group.

    Elimination on the covariances, one statement per column; the slopes follow backwards.
    """
    p, keys = len(xs), "".join(f"{k}, " for k in by)
    every = [*xs, y]
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    sums = ", ".join(f"covar_pop({every[i]}, {every[j]}) AS s0_{i}_{j}" for i, j in pairs)
    means = ", ".join(f"avg({x}) AS m{i}" for i, x in enumerate(every))
    grouped = f" GROUP BY {', '.join(by)} HAVING {having}" if by else ""
    out = {f"{name}_0": f"SELECT {keys}count(*) AS n, {means}, {sums} FROM {source}{grouped}"}
    for k in range(p):
        left = [f"s{k}_{i}_{j} - s{k}_{k}_{i} * s{k}_{k}_{j} / s{k}_{k}_{k} AS s{k + 1}_{i}_{j}" for i, j in pairs if i > k]
        out[f"{name}_{k + 1}"] = f"SELECT *, {', '.join(left)} FROM {name}_{k}"
    slopes = []
    for j in reversed(range(p)):
        known = "".join(f" - s{j}_{j}_{k} * b{k}" for k in range(j + 1, p))
        slopes.append(f"(s{j}_{j}_{p}{known}) / s{j}_{j}_{j} AS b{j}")
    level = f"m{p}" + "".join(f" - m{i} * b{i}" for i in range(p))
    out[name] = (
        f"SELECT {keys}n, {', '.join(f'b{i}' for i in range(p))}, {level} AS a, 1 - s{p}_{p}_{p} / s0_{p}_{p} AS r2, "
        f"n * s{p}_{p}_{p} AS sse FROM (SELECT *, {', '.join(slopes)} FROM {name}_{p})"
    )
    return out
