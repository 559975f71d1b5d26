"""The same views as ``marketloom.sources.Tables`` in DuckDB SQL, used only by the check queries."""

from __future__ import annotations

import re

from ..functions import PHI_DEN, PHI_NUM

_PATH = """
{name}_s AS (SELECT {key} AS k, ts, r, w, volume, sum(r) OVER (PARTITION BY {key} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM {name}_d),
{name}_c AS (SELECT {sym} AS symbol, ts, w, volume, 100*exp(s) AS close, 100*exp(s-0.9*r) AS open FROM {name}_s),
{name} AS MATERIALIZED (SELECT symbol, ts, open, greatest(open,close)*(1+w) AS high, least(open,close)*(1-w) AS low, close, volume FROM {name}_c)"""

VIEWS = {
    "bars": """bars_d AS (SELECT l_suppkey, l_shipdate AS ts, 0.2*(sum(l_discount)-0.05*count(*))+0.002*sin(sum(l_extendedprice)) AS r,
 0.1*avg(l_tax) AS w, sum(l_quantity) AS volume FROM lineitem GROUP BY ALL),""" + _PATH.format(name="bars", key="l_suppkey", sym="'S'||k"),
    "bars_brand": """bars_brand_d AS (SELECT p_brand, l_shipdate AS ts, 0.2*(sum(l_discount)-0.05*count(*))/sqrt(count(*))+0.002*sin(sum(l_extendedprice)) AS r,
 0.1*avg(l_tax) AS w, sum(l_quantity) AS volume FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY ALL),""" + _PATH.format(name="bars_brand", key="p_brand", sym="k"),
    "ticks": """ticks AS MATERIALIZED (SELECT event_type AS symbol, ts, event_id AS seq, value AS price, value*(1-0.0002*(1+event_id%7)) AS bid, value*(1+0.0002*(1+event_id%7)) AS ask,
 1.0::DOUBLE+kk AS bid_size, 100.0::DOUBLE-kk AS ask_size, 1.0::DOUBLE+kk AS volume
 FROM (SELECT *, CAST(json_extract(props,'$.k') AS INT) AS kk FROM events WHERE value>0))""",
    "user_ticks": """user_ticks AS MATERIALIZED (SELECT 'U'||user_id AS symbol, ts, event_id AS seq, value AS price, value*(1-0.0002*(1+event_id%7)) AS bid, value*(1+0.0002*(1+event_id%7)) AS ask,
 1.0::DOUBLE+kk AS bid_size, 100.0::DOUBLE-kk AS ask_size, 1.0::DOUBLE+kk AS volume
 FROM (SELECT *, CAST(json_extract(props,'$.k') AS INT) AS kk FROM events WHERE value>0))""",
    "book_levels": """book_levels AS (SELECT symbol, ts, seq, side, level, CASE WHEN side='B' THEN bid-level*0.01 ELSE ask+level*0.01 END AS px,
 1.0::DOUBLE+((seq*31+level*17)%97) AS sz FROM ticks, range(10) r(level), (VALUES ('B'),('A')) s(side))""",
    "book_deltas": """book_deltas AS (SELECT symbol, seq, ts, CASE WHEN seq%2=0 THEN 'B' ELSE 'A' END AS side, round(price,0) AS px, (seq%7)::DOUBLE AS sz FROM ticks)""",
    "hourly": """hourly AS (SELECT event_type AS symbol, date_trunc('hour',ts)::TIMESTAMP AS ts, avg(kk) AS ak, sum(kk-49.5)::DOUBLE AS sk, round(avg(value),6) AS price
 FROM (SELECT *, CAST(json_extract(props,'$.k') AS INT) AS kk FROM events WHERE value>0) GROUP BY ALL)""",
    "funding": "funding AS MATERIALIZED (SELECT symbol, ts, round((ak-49.5)/100000,10) AS rate, price AS mark_px, price*0.9991317 AS index_px FROM hourly)",
    "oi": "oi AS MATERIALIZED (SELECT symbol, ts, 1e7+100*sum(sk) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS oi_usd, price FROM hourly)",
    "trades": """trades AS MATERIALIZED (SELECT trade_id, account, strategy, symbol, direction, entry_ts, exit_ts, entry_price,
 round(entry_price*(1+l_discount-0.045),6) AS exit_price, size_usd, gross_pnl_usd, fee_usd, slippage_usd, round(gross_pnl_usd-fee_usd,6) AS net_pnl_usd,
 round(100*(gross_pnl_usd-fee_usd)/size_usd,6) AS net_pnl_pct, exit_reason, (epoch(exit_ts)-epoch(entry_ts))::DOUBLE AS hold_seconds,
 entry_zscore, entry_ofi, entry_kyle_lambda, lead_lag_active, funding_signal, regime, quality_score, maker_order
 FROM (SELECT l_orderkey*1000+row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_extendedprice,l_quantity) AS trade_id,
 'C'||o_custkey AS account, o_orderpriority AS strategy, 'S'||l_suppkey AS symbol, CASE WHEN l_linestatus='O' THEN 'LONG' ELSE 'SHORT' END AS direction,
 least(o_orderdate,l_shipdate)+to_seconds(l_orderkey*7919%86400) AS entry_ts, greatest(o_orderdate,l_shipdate)+to_seconds(86400+l_partkey*7907%86400) AS exit_ts, round(l_extendedprice/l_quantity,6) AS entry_price,
 l_extendedprice AS size_usd, round(l_extendedprice*(l_discount-0.045),6) AS gross_pnl_usd, round(l_extendedprice*0.0007,6) AS fee_usd,
 round(l_extendedprice*l_tax*0.01,6) AS slippage_usd, CASE l_returnflag WHEN 'A' THEN 'TAKE_PROFIT' WHEN 'R' THEN 'STOP_LOSS' ELSE 'TIME_STOP' END AS exit_reason,
 l_discount, round((l_quantity-25)/10,6) AS entry_zscore, round(l_tax*12,6) AS entry_ofi, round(l_discount*10,6) AS entry_kyle_lambda,
 l_linenumber%2=0 AS lead_lag_active, CASE WHEN l_tax>0.04 THEN 'SHORT_CARRY' WHEN l_tax<0.02 THEN 'LONG_CARRY' END AS funding_signal,
 CASE WHEN l_quantity>33 THEN 'TRENDING' WHEN l_quantity>16 THEN 'RANGING' ELSE 'VOLATILE' END AS regime, round(l_quantity*2,6) AS quality_score,
 l_linenumber%3=0 AS maker_order FROM lineitem JOIN orders ON l_orderkey=o_orderkey))""",
    "equity": """equity AS MATERIALIZED (SELECT account, exit_ts AS ts, trade_id, 10000+sum(net_pnl_usd) OVER (PARTITION BY account ORDER BY exit_ts,trade_id ROWS UNBOUNDED PRECEDING)*0.0517131::DOUBLE AS balance FROM trades)""",
    "positions": """positions AS (SELECT o_orderkey AS position_id, o_orderpriority AS strategy, 'C'||(o_custkey%40) AS symbol, 'C'||o_custkey AS account,
 CASE WHEN o_orderkey%3=0 THEN 'SHORT' ELSE 'LONG' END AS direction, o_totalprice AS entry_price, round(o_totalprice*0.98,6) AS stop_price, o_totalprice AS size_usd, o_orderdate AS opened_at
 FROM orders WHERE o_orderstatus='O')""",
    "rets": """rets AS MATERIALIZED (SELECT * FROM (SELECT symbol, ts, close, ln(close/lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS r,
 row_number() OVER (PARTITION BY symbol ORDER BY ts)-1 AS i FROM bars) WHERE r IS NOT NULL)""",
    "brets": """brets AS MATERIALIZED (SELECT * FROM (SELECT symbol, ts, close, ln(close/lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS r,
 row_number() OVER (PARTITION BY symbol ORDER BY ts)-1 AS i FROM bars_brand) WHERE r IS NOT NULL)""",
}
NEEDS = {"book_levels": ["ticks"], "book_deltas": ["ticks"], "funding": ["hourly"], "oi": ["hourly"], "equity": ["trades"],
         "rets": ["bars"], "brets": ["bars_brand"]}


def r6(cols: str, places: int = 6) -> str:
    """round each named column; 'a=expr' names an expression. -0.0 becomes 0.0."""
    out = []
    for item in re.split(r";|\s+(?![^(]*\))", cols.strip()) if ";" not in cols else cols.split(";"):
        item = item.strip()
        if not item:
            continue
        name, _, expr = item.partition("=")
        expr = expr or name
        out.append(f"CASE WHEN round({expr},{places})=0 THEN 0.0::DOUBLE ELSE round({expr},{places})::DOUBLE END AS {name.strip()}")
    return ", ".join(out)


def sql(views: str, body: str, ctes: str = "") -> str:
    """views: names of the views the query reads; ctes: extra CTEs; body: the final SELECT."""
    order: list[str] = []

    def need(v):
        for d in NEEDS.get(v, []):
            need(d)
        if v not in order:
            order.append(v)

    for v in views.split():
        need(v)
    parts = [VIEWS[v] for v in order] + ([ctes.strip().rstrip(",")] if ctes else [])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def phi_sql(x: str) -> str:
    a = f"least(abs({x}),7.0)"

    def horner(cs):
        out = f"{cs[0]!r}::DOUBLE"
        for k in cs[1:]:
            out = f"({out}*{a}+{k!r}::DOUBLE)"
        return out

    tail = f"(exp(-{a}*{a}/2)*{horner(PHI_NUM)}/{horner(PHI_DEN)})"
    return f"(CASE WHEN {x}>0 THEN 1-{tail} ELSE {tail} END)"


def sdiv(a: str, b: str, fb: str = "0.0") -> str:
    return f"(CASE WHEN abs({b})>1e-12 THEN ({a})/({b}) ELSE {fb} END)"


def clamp_sql(x: str, lo, hi) -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN greatest({lo}, least({hi}, {x})) END)"
