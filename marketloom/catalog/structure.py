"""Queries over price structure and setups."""

from pyspark.sql import functions as F

from ..operators import features as ft, scores as sc, structure as s
from . import query
from .features import FEAT_EMA, SUITE, rec
from .quality import SCREEN
from .views import r6, sql

W = "PARTITION BY symbol ORDER BY ts"
SW = " AND ".join(f"{{c}}{{op}}{fn}({{c}},{k}) OVER ({W})" for fn in ("lag", "lead") for k in (1, 2))
query("swing_points", sql("bars", f"SELECT symbol, kind, ts, {r6('price')}, rank, rank<=3 AS is_zone FROM (SELECT *, row_number() OVER (PARTITION BY symbol, kind ORDER BY ts DESC) AS rank FROM sp) WHERE rank<=5",
      f"""sw AS (SELECT symbol, ts, high, low, {SW.format(c='high', op='>')} AS top, {SW.format(c='low', op='<')} AS bot FROM bars),
sp AS (SELECT symbol, ts, 'HIGH' AS kind, high AS price FROM sw WHERE top UNION ALL SELECT symbol, ts, 'LOW', low FROM sw WHERE bot)"""))(lambda t: s.swing_points(t.bars()))

FVG = f"""ga AS (SELECT *, lag(high,2) OVER ({W}) AS h2, lag(low,2) OVER ({W}) AS l2 FROM bars),
gb AS (SELECT symbol, ts, 'BULLISH' AS side, low AS top, h2 AS bottom, (low-h2)/h2*100 AS gap_pct, close<h2 AS filled FROM ga WHERE low>h2
 UNION ALL SELECT symbol, ts, 'BEARISH', l2, high, (l2-high)/l2*100, close>l2 FROM ga WHERE NOT low>h2 AND high<l2),
gc AS (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY ts DESC) AS rank FROM gb WHERE gap_pct>=0.1 AND NOT filled),
fvg AS (SELECT * FROM gc WHERE rank<=5)"""
query("fair_value_gaps", sql("bars", f"SELECT symbol, side, ts, {r6('top;bottom;equilibrium=(top+bottom)/2;gap_pct')}, CASE WHEN gap_pct>0.5 THEN 'STRONG' ELSE 'MODERATE' END AS strength, rank FROM fvg", FVG)
      )(lambda t: s.fair_value_gaps(t.bars()))
OB = f"""oa AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rev FROM bars) WHERE rev<=50),
ob AS (SELECT *, avg(abs(close-open)) OVER (PARTITION BY symbol) AS ab, avg(volume) OVER (PARTITION BY symbol) AS av, count(*) OVER (PARTITION BY symbol) AS m, lead(close) OVER ({W}) AS nc,
 max(close) FILTER (rev=1) OVER (PARTITION BY symbol) AS px FROM oa),
oc AS (SELECT *, CASE WHEN close<open AND nc>high THEN 'BULLISH' WHEN close>open AND nc<low THEN 'BEARISH' END AS side FROM ob WHERE rev>1 AND rev<m AND abs(close-open)>ab*1.5),
obs AS (SELECT symbol, ts, side, greatest(open,close) AS ob_top, least(open,close) AS ob_bottom, volume>av*1.2 AS institutional,
 abs(px-(CASE WHEN side='BULLISH' THEN low ELSE high END))/(CASE WHEN side='BULLISH' THEN low ELSE high END)*100 AS distance_pct FROM oc WHERE side IS NOT NULL)"""
query("order_blocks", sql("bars", f"SELECT symbol, ts, side, {r6('ob_top ob_bottom distance_pct')}, institutional, rank FROM (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY distance_pct, ts) AS rank FROM obs) WHERE rank<=5", OB)
      )(lambda t: s.order_blocks(t.bars()))
MS = f"""sa AS (SELECT * FROM (SELECT symbol, ts, high, low, close, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rev FROM bars) WHERE rev<=100),
sb AS (SELECT *, row_number() OVER ({W}) AS rn, max(high) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS mh, min(low) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS ml FROM sa),
sh AS (SELECT symbol, high, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM sb WHERE rn>5 AND rev>5 AND high=mh),
sl AS (SELECT symbol, low, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM sb WHERE rn>5 AND rev>5 AND low=ml),
sc AS (SELECT symbol, (SELECT high FROM sh WHERE sh.symbol=p.symbol AND k=1) AS h1, (SELECT high FROM sh WHERE sh.symbol=p.symbol AND k=2) AS h2,
 (SELECT low FROM sl WHERE sl.symbol=p.symbol AND k=1) AS l1, (SELECT low FROM sl WHERE sl.symbol=p.symbol AND k=2) AS l2, close AS price FROM sa p WHERE rev=1),
ms AS (SELECT symbol, price, CASE WHEN h2 IS NULL OR l2 IS NULL THEN 'INSUFFICIENT_DATA' WHEN h1>h2 AND l1>l2 THEN 'UPTREND' WHEN NOT h1>h2 AND NOT l1>l2 THEN 'DOWNTREND' ELSE 'TRANSITION' END AS structure,
 h1 AS last_swing_high, l1 AS last_swing_low, coalesce(price>h1,false) AS bos_bullish, coalesce(price<l1,false) AS bos_bearish FROM sc),
msb AS (SELECT *, CASE structure WHEN 'UPTREND' THEN 'BULLISH' WHEN 'DOWNTREND' THEN 'BEARISH' ELSE 'NEUTRAL' END AS structure_bias FROM ms)"""
query("market_structure", sql("bars", f"SELECT symbol, {r6('price last_swing_high last_swing_low')}, structure, structure_bias, bos_bullish, bos_bearish FROM msb", MS))(lambda t: s.market_structure(t.bars()))

RAW = "CASE l_linenumber%5 WHEN 0 THEN 'STRONG' WHEN 1 THEN l_quantity::INT%5||'/4' WHEN 2 THEN (l_quantity::INT%6)::VARCHAR WHEN 3 THEN 'Contested' ELSE (l_quantity::INT%4)||'/'||(l_quantity::INT%4+l_linenumber%3) END"
query("bias_strength_label", f"""WITH a AS (SELECT DISTINCT {RAW} AS raw FROM lineitem), b AS (SELECT raw, try_cast(split_part(raw,'/',1) AS INT) AS n, try_cast(split_part(raw,'/',2) AS INT) AS d, raw LIKE '%/%' AS isr, try_cast(raw AS DOUBLE) AS v FROM a)
SELECT raw, CASE WHEN raw IN ('VERY_WEAK','WEAK','MODERATE','STRONG','VERY_STRONG') THEN raw WHEN isr THEN CASE WHEN n/greatest(d,1)>=0.9 OR n>=4 THEN 'VERY_STRONG' WHEN n/greatest(d,1)>=0.7 OR n>=3 THEN 'STRONG'
 WHEN n/greatest(d,1)>=0.5 OR n>=2 THEN 'MODERATE' ELSE 'WEAK' END WHEN v IS NOT NULL THEN CASE WHEN v>=4 THEN 'VERY_STRONG' WHEN v>=3 THEN 'STRONG' WHEN v>=2 THEN 'MODERATE' WHEN v>=1 THEN 'WEAK' ELSE 'VERY_WEAK' END ELSE 'MODERATE' END AS label FROM b""")(
    lambda t: t.base("lineitem").select(F.expr(
        "CASE l_linenumber%5 WHEN 0 THEN 'STRONG' WHEN 1 THEN concat(int(l_quantity)%5,'/4') WHEN 2 THEN string(int(l_quantity)%6) WHEN 3 THEN 'Contested' "
        "ELSE concat(int(l_quantity)%4,'/',int(l_quantity)%4+l_linenumber%3) END").alias("raw")).distinct().withColumn("label", s.bias_strength_label(F.col("raw"))))

VOTE = FVG + ",\n" + OB + ",\n" + MS + """,
va1 AS (SELECT symbol, CASE WHEN sum((side='BULLISH')::INT)>sum((side='BEARISH')::INT) THEN 1 WHEN sum((side='BULLISH')::INT)<sum((side='BEARISH')::INT) THEN -1 ELSE 0 END AS f FROM fvg GROUP BY symbol),
va2 AS (SELECT symbol, CASE WHEN sum((side='BULLISH')::INT)>sum((side='BEARISH')::INT) THEN 1 WHEN sum((side='BULLISH')::INT)<sum((side='BEARISH')::INT) THEN -1 ELSE 0 END AS o FROM obs GROUP BY symbol),
va3 AS (SELECT symbol, (coalesce(f,0)=1)::INT+(coalesce(o,0)=1)::INT+2*(structure_bias='BULLISH')::INT AS bu, (coalesce(f,0)=-1)::INT+(coalesce(o,0)=-1)::INT+2*(structure_bias='BEARISH')::INT AS be
 FROM msb LEFT JOIN va1 USING (symbol) LEFT JOIN va2 USING (symbol)),
vote AS (SELECT symbol, bu AS bullish_factors, be AS bearish_factors, CASE WHEN bu>be THEN 'BULLISH' WHEN be>bu THEN 'BEARISH' ELSE 'NEUTRAL' END AS composite_bias,
 CASE WHEN bu=be THEN 'MODERATE' WHEN greatest(bu,be)/(bu+be)>=0.9 OR greatest(bu,be)>=4 THEN 'VERY_STRONG' WHEN greatest(bu,be)/(bu+be)>=0.7 OR greatest(bu,be)>=3 THEN 'STRONG'
 WHEN greatest(bu,be)/(bu+be)>=0.5 OR greatest(bu,be)>=2 THEN 'MODERATE' ELSE 'WEAK' END AS bias_strength FROM va3)"""
query("structure_bias", sql("bars", "SELECT symbol, composite_bias, bias_strength, bullish_factors, bearish_factors FROM vote", VOTE))(lambda t: s.structure_bias(t.bars()))

SETUP = FEAT_EMA + ",\n" + VOTE + """,
su AS (SELECT f.symbol, f.ts, f.close, f.atr, f.atr_percentile, coalesce(f.adx,20) AS adx, f.roc_10, f.volume_ratio, f.z, (f.close>ema20 AND ema20>ema50) AS bull, (f.close<ema20 AND ema20<ema50) AS bear,
 bias_strength, CASE composite_bias WHEN 'BULLISH' THEN 1 ELSE -1 END AS sg, CASE composite_bias WHEN 'BULLISH' THEN 'LONG' ELSE 'SHORT' END AS direction
 FROM feat f JOIN em USING (symbol, ts) JOIN vote v ON v.symbol=f.symbol WHERE f.i=f.n-1 AND composite_bias<>'NEUTRAL'),
tp AS (SELECT *, CASE WHEN adx>=25 THEN 2 WHEN adx>=18 THEN 1 ELSE 0 END+CASE WHEN (sg=1 AND bull) OR (sg=-1 AND bear) THEN 2 ELSE 0 END+CASE WHEN sg*roc_10>0.3 THEN 1 ELSE 0 END
 +CASE WHEN bias_strength IN ('STRONG','VERY_STRONG') THEN 2 WHEN bias_strength='MODERATE' THEN 1 ELSE 0 END+CASE WHEN volume_ratio>=0.9 THEN 1 ELSE 0 END AS tp_score FROM su)"""
query("dynamic_tp_multiplier", rec("bars", "SELECT symbol, direction, tp_score, CASE WHEN tp_score>=4 THEN 1.5 ELSE 1.0 END::DOUBLE AS tp_multiplier FROM tp", SETUP))(
    lambda t: s.dynamic_tp_multiplier(s.setup_features(t.bars())).select("symbol", "direction", "tp_score", "tp_multiplier"))
query("setup_quality_score", rec("bars", f"""SELECT symbol, direction, {r6('screener_pts=sp;regime_pts=rp;strength_pts=st;check_pts=ck;quality_score=greatest(0,least(100,sp+rp+st+ck-pen))')} FROM
 (SELECT symbol, direction, least(35,greatest(0,(score-50)/50)*35) AS sp, least(25, regime_pts*4/100*25) AS rp, CASE bias_strength WHEN 'VERY_WEAK' THEN 5 WHEN 'WEAK' THEN 10 WHEN 'MODERATE' THEN 15 ELSE 20 END AS st,
 5*(((sg=1 AND bull) OR (sg=-1 AND bear))::INT+(adx>=20)::INT+(sg*coalesce(su.z,0)<0.5)::INT+(sg*roc_10 BETWEEN 0.3 AND 5)::INT) AS ck, 8*((sg=1 AND bear) OR (sg=-1 AND bull))::INT AS pen FROM su JOIN screen USING (symbol))""",
      SETUP + ",\n" + SCREEN))(lambda t: s.setup_quality_score(
          s.setup_features(t.bars()).join(sc.screener_score(t.bars()).select("symbol", F.col("score").alias("screener_score"), (F.col("regime_pts") * 4).alias("regime_conf")), "symbol"))
          .select("symbol", "direction", "screener_pts", "regime_pts", "strength_pts", "check_pts", "quality_score"))
query("next_open_entry", sql("bars", f"SELECT symbol, ts, {r6('close;entry=CASE WHEN ok THEN nxt ELSE close END')}, CASE WHEN ok AND nxt<>close THEN 'NEXT_OPEN' ELSE 'CLOSE_FALLBACK' END AS entry_type FROM "
      f"(SELECT *, coalesce(abs(nxt-close)/close<0.2,false) AS ok FROM (SELECT symbol, ts, close, lead(open) OVER ({W}) AS nxt FROM bars))"))(lambda t: s.next_open_entry(t.bars()))
query("entry_levels", rec("bars", f"""SELECT symbol, direction, {r6('fill;sl_multiplier=m;stop=fill-sg*atr*1.5*m;target=fill+sg*atr*1.5*2*tpm')} FROM (SELECT symbol, direction, sg, atr, close*(1+sg*0.05/100) AS fill, CASE WHEN tp_score>=4 THEN 1.5 ELSE 1.0 END AS tpm,
 CASE WHEN cv>3 THEN greatest(b,1.3) WHEN cv>2 THEN greatest(b,1.15) WHEN cv<0.5 THEN least(b,0.85) ELSE b END AS m FROM (SELECT *, CASE WHEN atr_percentile>80 THEN 1.2 WHEN atr_percentile<25 THEN 0.9 ELSE 1.0 END AS b FROM tp JOIN suite USING (symbol)))""",
      SETUP + ",\n" + SUITE))(lambda t: s.entry_levels(s.dynamic_tp_multiplier(s.setup_features(t.bars())).withColumn("entry", F.col("close"))
                              .join(ft.realized_vol_suite(t.bars()).select("symbol", "consensus_vol_pct"), "symbol")).select("symbol", "direction", "fill", "sl_multiplier", "stop", "target"))
