"""Queries over data quality and scores."""

from pyspark.sql import functions as F

from ..operators import features as ft, quality as q, scores as sc
from . import query
from .views import r6, sdiv, sql

MT = """mt AS (SELECT symbol, count(*) AS total_rows, count(*) FILTER (g>4*86400) AS gap_count, count(*) FILTER (g>7*86400) AS critical_gaps FROM
 (SELECT symbol, epoch(ts)-epoch(lag(ts) OVER (PARTITION BY symbol ORDER BY ts)) AS g FROM bars) GROUP BY symbol),
mts AS (SELECT *, greatest(0,100-gap_count/total_rows*100*10) AS completeness_score FROM mt)"""
query("missing_ticks", sql("bars", f"SELECT symbol, total_rows, gap_count, critical_gaps, {r6('completeness_score')}, CASE WHEN gap_count=0 THEN 'CLEAN' WHEN gap_count<5 THEN 'MINOR_GAPS' ELSE 'SIGNIFICANT_GAPS' END AS assessment FROM mts", MT)
      )(lambda t: q.missing_ticks(t.bars()))
PO = """pq AS (SELECT symbol, avg(r) AS mu, stddev_pop(r) AS sd, quantile_cont(r,0.25) AS q1, quantile_cont(r,0.75) AS q3 FROM rets GROUP BY symbol),
po AS (SELECT symbol, count(*) FILTER (abs(r-mu)>3.5*sd) AS z_outliers, count(*) FILTER (r<q1-2.5*(q3-q1) OR r>q3+2.5*(q3-q1)) AS iqr_outliers FROM rets JOIN pq USING (symbol) GROUP BY symbol),
ph AS (SELECT symbol, count(*) AS n, count(*) FILTER (high<greatest(open,close) OR low>least(open,close) OR high<low) AS ohlc_errors FROM bars GROUP BY symbol),
pout AS (SELECT *, greatest(0,100-(z_outliers+ohlc_errors)/n*100*5) AS cleanliness_score, z_outliers+ohlc_errors AS tt FROM po JOIN ph USING (symbol))"""
query("price_outliers", sql("rets", f"SELECT symbol, z_outliers, iqr_outliers, ohlc_errors, {r6('cleanliness_score')}, CASE WHEN tt=0 THEN 'CLEAN' WHEN tt<5 THEN 'MINOR_ANOMALIES' WHEN tt<20 THEN 'SIGNIFICANT_ANOMALIES' ELSE 'SEVERELY_CONTAMINATED' END AS assessment FROM pout", PO)
      )(lambda t: q.price_outliers(t.bars()))



EA = """ea AS (SELECT symbol, close, volume, lag(close) OVER w AS p, coalesce(lag(ts) OVER w=ts,false) AS dup FROM eb WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
ex AS (SELECT symbol, count(*) FILTER (dup) AS duplicate_ts, count(*) FILTER (p<>0 AND abs(close/p-1)>0.3) AS price_jumps, max(CASE WHEN p<>0 THEN abs(close/p-1) END) AS max_move, count(*) FILTER (close=0) AS zero_close,
 count(*) FILTER (volume<0) AS negative_volume FROM ea GROUP BY symbol),
exa AS (SELECT *, (price_jumps>0)::INT+(zero_close>0)::INT+(negative_volume>0)::INT AS critical_anomalies, (price_jumps>0)::INT+(zero_close>0)::INT+(negative_volume>0)::INT+(duplicate_ts>0)::INT AS total_anomalies FROM ex),
exi AS (SELECT *, CASE WHEN total_anomalies=0 THEN 'RELIABLE' WHEN critical_anomalies=0 THEN 'QUESTIONABLE' ELSE 'COMPROMISED' END AS integrity FROM exa)"""
query("exchange_anomalies", sql("bars user_ticks", f"SELECT symbol, duplicate_ts, price_jumps, {r6('max_move')}, zero_close, negative_volume, critical_anomalies, total_anomalies, integrity FROM exi",
      "eb AS (SELECT symbol, ts, close, volume FROM bars UNION ALL SELECT symbol, ts, CASE WHEN seq%211=0 THEN 0 ELSE price END, CASE WHEN seq%97=0 THEN -volume ELSE volume END FROM user_ticks),\n" + EA)
      )(lambda t: q.exchange_anomalies(t.bars().select("symbol", "ts", "close", "volume").unionByName(t.user_ticks().select(
            "symbol", "ts", F.when(F.col("seq") % 211 == 0, 0.0).otherwise(F.col("price")).alias("close"),
            F.when(F.col("seq") % 97 == 0, -F.col("volume")).otherwise(F.col("volume")).alias("volume")))))
query("data_quality_report", sql("rets", f"SELECT symbol, {r6('completeness_score;cleanliness_score;integrity_score=is_;quality=qq')}, integrity, CASE WHEN qq>=85 THEN 'INSTITUTIONAL_GRADE' WHEN qq>=65 THEN 'ACCEPTABLE' WHEN qq>=40 THEN 'MARGINAL' ELSE 'UNRELIABLE' END AS quality_label FROM "
      "(SELECT *, completeness_score*0.3+cleanliness_score*0.4+is_*0.3 AS qq FROM (SELECT symbol, completeness_score, cleanliness_score, integrity, CASE integrity WHEN 'RELIABLE' THEN 100 WHEN 'QUESTIONABLE' THEN 60 ELSE 10 END AS is_ "
      "FROM mts JOIN pout USING (symbol) JOIN exi USING (symbol)))", "eb AS (SELECT symbol, ts, close, volume FROM bars),\n" + EA + ",\n" + MT + ",\n" + PO))(lambda t: q.data_quality_report(t.bars()))

SCREEN = """sra AS (SELECT symbol, close, ln(close/lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS lr, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rev FROM bars),
srb AS (SELECT symbol, avg(lr)*252 AS mu, stddev_samp(lr) AS sd, CASE WHEN count(*) FILTER (lr<0)>1 THEN stddev_samp(lr) FILTER (lr<0) ELSE stddev_samp(lr) END AS dsd, stddev_pop(lr) FILTER (rev<=14) AS sd14, avg(lr) FILTER (rev<=14) AS mu14,
 max(close) FILTER (rev=1) AS c1, max(close) FILTER (rev=4) AS c4, max(close) FILTER (rev=6) AS c6, max(close) FILTER (rev=11) AS c11, max(close) FILTER (rev=21) AS c21, avg(close) FILTER (rev<=20) AS zm, stddev_samp(close) FILTER (rev<=20) AS zs
 FROM sra GROUP BY symbol HAVING count(lr)>=20),
src AS (SELECT *, mu/(dsd*sqrt(252)) AS so, sd14/greatest(sd,1e-6/sqrt(252)) AS vr, (c1/c6-1)*100 AS r5, (c1/c11-1)*100 AS r10, (c1/c21-1)*100 AS r20, coalesce((c1-zm)/nullif(zs,0),0) AS z, sd*sqrt(252)*100 AS v FROM srb),
srd AS (SELECT *, CASE WHEN so>=1.5 THEN 30 WHEN so>=1 THEN 25 WHEN so>=0.5 THEN 18 WHEN so>=0 THEN 10 ELSE 0 END AS sortino_pts,
 CASE WHEN mu14>0 AND vr<1.2 THEN 'LOW_VOL_BULLISH' WHEN mu14<0 AND vr>1.5 THEN 'HIGH_VOL_BEARISH' WHEN abs(mu14)<sd*0.3 THEN 'SIDEWAYS_CHOP' WHEN mu14>0 THEN 'MILD_BULLISH' ELSE 'MILD_BEARISH' END AS regime_proxy,
 CASE WHEN r20>5 AND acc THEN 20 WHEN r20>2 AND acc THEN 17 WHEN r20>0 AND NOT (r5<0 AND r20>0) THEN 13 WHEN r20>-2 AND r5>0 THEN 8 WHEN r5<0 AND r20>0 THEN 3 ELSE 0 END AS momentum_pts,
 CASE WHEN z<-2 THEN 15 WHEN z<-1 THEN 13 WHEN z<0.5 THEN 12 WHEN z<1.5 THEN 8 WHEN z<2.5 THEN 3 ELSE 0 END AS zscore_pts,
 CASE WHEN v BETWEEN 15 AND 30 THEN 10 WHEN v BETWEEN 10 AND 45 THEN 8 WHEN v BETWEEN 5 AND 60 THEN 5 WHEN v>60 THEN 0 ELSE 3 END AS vol_pts FROM (SELECT *, (r5>r10 AND r10>0) OR (r5>0 AND r20>0) AS acc FROM src)),
sre AS (SELECT *, CASE regime_proxy WHEN 'LOW_VOL_BULLISH' THEN 25 WHEN 'HIGH_VOL_BEARISH' THEN 0 WHEN 'SIDEWAYS_CHOP' THEN 10 WHEN 'MILD_BULLISH' THEN 18 ELSE 5 END AS regime_pts FROM srd),
screen AS (SELECT *, sortino_pts+regime_pts+momentum_pts+zscore_pts+vol_pts AS score FROM sre),
screens AS (SELECT *, CASE WHEN score>=70 THEN 'READY' WHEN score>=50 THEN 'MARGINAL' ELSE 'REJECTED' END AS status FROM screen)"""
query("screener_score", sql("bars", f"SELECT symbol, status, regime_proxy, {r6('score sortino_pts regime_pts momentum_pts zscore_pts vol_pts')}, {r6('price=c1;change_3d=(c1/c4-1)*100')} FROM screens", SCREEN))(lambda t: sc.screener_score(t.bars()))


def markets(t):
    """Market of each symbol: the nation of the supplier."""
    return t.base("supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"),
                                     F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("market"))


query("screener_rank", sql("bars", f"SELECT 'N'||s_nationkey AS market, symbol, {r6('score')}, status, {r6('price=c1')}, row_number() OVER (PARTITION BY s_nationkey ORDER BY score DESC, symbol) AS rank, "
      "row_number() OVER (PARTITION BY s_nationkey ORDER BY score DESC, symbol)=1 AS top_pick FROM screens JOIN supplier ON symbol='S'||s_suppkey", SCREEN))(lambda t: sc.screener_rank(sc.screener_score(t.bars()), markets(t)))


query("macro_regime", sql("brets", f"SELECT as_of, {r6('nasdaq_pct=n;dxy_pct=d;gold_pct=g;risk_score=rs')}, CASE WHEN n>0.5 AND d<0.3 THEN 'RISK_ON' WHEN n<-0.5 OR d>0.5 THEN 'RISK_OFF' WHEN g>1 AND d>0.3 THEN 'INFLATION_FEAR' ELSE 'TRANSITIONAL' END AS macro_regime, "
      "CASE WHEN rs>60 THEN 'RISK_ON' WHEN rs<40 THEN 'RISK_OFF' ELSE 'NEUTRAL' END AS risk_label FROM (SELECT *, greatest(0,least(100,50+n*3-d*2-g)) AS rs FROM (SELECT ts AS as_of, coalesce(max((exp(r)-1)*100) FILTER (symbol='Brand#11'),0) AS n, "
      "coalesce(max((exp(r)-1)*100) FILTER (symbol='Brand#12'),0) AS d, coalesce(max((exp(r)-1)*100) FILTER (symbol='Brand#13'),0) AS g FROM brets WHERE symbol IN ('Brand#11','Brand#12','Brand#13') GROUP BY ts))"))(
    lambda t: sc.macro_regime(ft.simple_returns(t.bars_brand()).where("symbol in ('Brand#11','Brand#12','Brand#13')").select(
        F.col("ts").alias("as_of"), F.expr("CASE symbol WHEN 'Brand#11' THEN 'NASDAQ' WHEN 'Brand#12' THEN 'DXY' ELSE 'GOLD' END").alias("name"), (F.col("r") * 100).alias("change_pct"))))
SENT = "CASE doc_id%4 WHEN 0 THEN 'SENTIMENT: bullish\nREASONING: ' WHEN 1 THEN 'SENTIMENT: Bearish\nREASONING:' WHEN 2 THEN '' ELSE 'REASONING: first REASONING: ' END"
query("sentiment_label", f"SELECT doc_id, CASE WHEN upper(x) LIKE '%BULLISH%' THEN 'BULLISH' WHEN upper(x) LIKE '%BEARISH%' THEN 'BEARISH' ELSE 'NEUTRAL' END AS sentiment, md5(CASE WHEN x LIKE '%REASONING:%' THEN trim(list_last(string_split(x,'REASONING:')),' ') ELSE x END) AS reasoning_md5 "
      f"FROM (SELECT doc_id, {SENT}||text AS x FROM documents)")(
    lambda t: sc.sentiment_label(t.base("documents").select("doc_id", F.concat(F.expr(SENT.replace("\n", "\\n")), "text").alias("text"))).select("doc_id", "sentiment", F.md5("reasoning").alias("reasoning_md5")))
query("ownership_split", f"SELECT s_suppkey, {r6('insider_pct=i;institution_pct=n')}, {r6('public_pct=CASE WHEN i>0 OR n>0 THEN greatest(0,round(100-(i+n),2)) ELSE 100 END;')} FROM (SELECT s_suppkey, round(greatest(s_acctbal,0)/20000*100,2) AS i, round((s_suppkey%7)/10.0*100,2) AS n FROM supplier)")(
    lambda t: sc.ownership_split(t.base("supplier").select("s_suppkey", (F.greatest("s_acctbal", F.lit(0.0)) / 20000).alias("insider_frac"), ((F.col("s_suppkey") % 7) / 10.0).alias("institution_frac"))).drop("insider_frac", "institution_frac"))
