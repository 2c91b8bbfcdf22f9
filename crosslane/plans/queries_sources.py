"""Registered queries of sources, membership, splits and the prediction store."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from crosslane.functions.dates import parse_date
from crosslane.operators import folds as fo
from crosslane.operators.metrics import on_common_dates
from crosslane.plans import binding as b
from crosslane.plans.catalog import query, rounded
from crosslane.plans.experiment import load_panel
from crosslane.plans.oracle import BLOCKS, lag, r, with_blocks
from crosslane.session import fresh_path
from crosslane.sources import bars as br
from crosslane.sources import membership as ms
from crosslane.sources import store as st
from crosslane.sources import symbols as sy
from crosslane.sources.factors import FACTORS, factor_range, parse_factor_lines
from crosslane.streaming.bars import extend_from_stream, read_landed

_BAR = ("open", "high", "low", "close", "adj_close")
_BAR_OUT = "date, ticker, " + ", ".join(f"{r(c)} AS {c}" for c in _BAR) + ", volume"


# ---- bars -------------------------------------------------------------------------


@query("daily_bars", with_blocks(("bars",), f"SELECT {_BAR_OUT} FROM bars"))
def daily_bars(spark, sf):
    return rounded(b.build_bars(spark, sf))


@query(
    "normalize_vendor_bars",
    with_blocks(
        ("bars",),
        f"""SELECT date, ticker, {r('open')} AS open, {r('high')} AS high, {r('low')} AS low, {r('close')} AS close,
  {r("CASE WHEN extract(day FROM date) % 2 = 0 THEN adj_close ELSE close END")} AS adj_close, volume
FROM bars WHERE extract(day FROM date) <> 13""",
    ),
)
def normalize_vendor_bars(spark, sf):
    """Bars as vendor text columns with gaps, read back through the normalizer."""
    day = F.dayofmonth("date")
    vendor = b.bars(spark, sf).select(
        F.col("date").cast("string").alias("Date"),
        F.col("ticker").alias("Ticker"),
        F.col("open").cast("string").alias("Open"),
        F.col("high").cast("string").alias("HIGH"),
        F.col("low").cast("string").alias("('Low', 'X')"),
        F.when(day == 13, "n/a").otherwise(F.col("close").cast("string")).alias("Close"),
        F.when(day % 2 == 0, F.col("adj_close").cast("string")).otherwise("").alias("Adj Close"),
        F.col("volume").cast("string").alias("Volume"),
    )
    return rounded(br.normalize_bars(vendor).select("date", "ticker", *_BAR, "volume"))


_CUT = "DATE '1999-01-01'"


def _landed(spark, sf):
    """Rows from the last stored month on, with changed closes, as they would land later."""
    bars = b.bars(spark, sf)
    stored = bars.where(F.col("date") < "1999-01-01")
    landed = bars.where(F.col("date") >= "1998-12-01").withColumn("close", F.col("close") * 2.0)
    return stored, landed


@query(
    "merge_landed_bars",
    with_blocks(
        ("bars",),
        f"""SELECT b.date, b.ticker, {r('CASE WHEN b.date >= m.d THEN close * 2 ELSE close END')} AS close
FROM bars b LEFT JOIN (SELECT ticker, max(date) AS d FROM bars WHERE date < {_CUT} GROUP BY 1) m USING (ticker)""",
    ),
)
def merge_landed_bars(spark, sf):
    stored, landed = _landed(spark, sf)
    return rounded(br.merge_bars(stored, landed).select("date", "ticker", "close"))


@query(
    "bar_store_range",
    with_blocks(
        ("bars",),
        f"""SELECT b.date, b.ticker, {r('CASE WHEN b.date >= m.d THEN close * 2 ELSE close END')} AS close
FROM bars b LEFT JOIN (SELECT ticker, max(date) AS d FROM bars WHERE date < {_CUT} GROUP BY 1) m USING (ticker)
WHERE b.date BETWEEN DATE '1997-03-01' AND DATE '2000-06-30'""",
    ),
)
def bar_store_range(spark, sf):
    """Write, extend and range-read the stored panel."""
    stored, landed = _landed(spark, sf)
    store = br.BarStore(spark, fresh_path(spark, "bars"))
    store.write(stored)
    store.extend(landed)
    return rounded(store.read("1997-03-01", "2000-06-30").select("date", "ticker", "close"))


@query(
    "stream_extend_bars",
    with_blocks(
        ("bars",),
        f"""SELECT b.ticker, count(*) AS n, {r('sum(CASE WHEN b.date >= m.d THEN close * 2 ELSE close END)', 2)} AS total
FROM bars b LEFT JOIN (SELECT ticker, max(date) AS d FROM bars WHERE date < {_CUT} GROUP BY 1) m USING (ticker) GROUP BY 1""",
    ),
)
def stream_extend_bars(spark, sf):
    """Landed files arrive as a stream; the stored panel grows once per (date, ticker)."""
    stored, landed = _landed(spark, sf)
    folder = fresh_path(spark, "landing")
    landed.write.parquet(folder)
    store = br.BarStore(spark, fresh_path(spark, "bars"))
    store.write(stored)
    for _ in range(2):
        extend_from_stream(read_landed(spark, folder), store, f"{folder}-checkpoint").awaitTermination()
    out = store.read().groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.sum("close").alias("total"))
    return rounded(out, 2)


@query(
    "log_returns",
    with_blocks(("bars",), f"SELECT date, ticker, {r(f'ln(adj_close) - {lag("ln(adj_close)", 1)}')} AS log_return FROM bars"),
)
def log_returns(spark, sf):
    return rounded(br.add_log_return(b.bars(spark, sf)).select("date", "ticker", "log_return"))


@query("attach_sector", with_blocks(("panel",), "SELECT date, ticker, sector FROM panel"))
def attach_sector(spark, sf):
    return br.attach_sector(b.bars(spark, sf), b.sectors(spark, sf)).select("date", "ticker", "sector")


@query(
    "load_panel",
    with_blocks(
        ("panel", "membership"),
        f"""SELECT p.date, p.ticker, {r('close')} AS close, sector FROM panel p JOIN membership m ON p.ticker = m.ticker AND m.added <= p.date
  AND (m.removed IS NULL OR p.date < m.removed) WHERE p.date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' AND p.ticker <> 'Brand#1'""",
    ),
)
def load_panel_q(spark, sf):
    universe = b.bars(spark, sf).select("ticker").distinct().where(F.col("ticker") != "Brand#1")
    out = load_panel(
        b.bars(spark, sf), universe, "1996-01-01", "2000-12-31", b.membership(spark, sf), b.sectors(spark, sf)
    )
    return rounded(out.select("date", "ticker", "close", "sector"))


@query(
    "pushed_down_scan",
    f"SELECT l_orderkey, l_linenumber, {r('l_extendedprice')} AS l_extendedprice FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40",
)
def pushed_down_scan(spark, sf):
    """Three columns and two predicates reach the Parquet scan."""
    lines = b.table(spark, sf, "lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40))
    return rounded(lines.select("l_orderkey", "l_linenumber", "l_extendedprice"))


# ---- factors ------------------------------------------------------------------------


@query(
    "factor_file",
    with_blocks(("factors",), "SELECT date, " + ", ".join(f"{r(f)} AS {f}" for f in (*FACTORS, "RF")) + " FROM factors"),
)
def factor_file(spark, sf):
    """The factor table as the lines of a vendor text file (free text, header, percent values, annual block)."""
    rows = b.factors(spark, sf).select(
        (F.datediff("date", F.lit("1990-01-01").cast("date")) + 10).alias("line_no"),
        F.concat_ws(
            ",", F.date_format("date", "yyyyMMdd"), *[(F.col(c) * 100).cast("string") for c in (*FACTORS, "RF")]
        ).alias("line"),
    )
    around = spark.createDataFrame(
        [
            (0, "Daily factor returns, in percent"),
            (1, ""),
            (2, ",Mkt-RF,SMB,HML,RMW,CMA,RF"),
            (1000000, ""),
            (1000001, " Annual Factors: January-December"),
            (1000002, "  1999,1,1,1,1,1,1"),
        ],
        "line_no int, line string",
    )
    return rounded(parse_factor_lines(rows.unionByName(around)))


@query(
    "factor_range",
    with_blocks(("factors",), "SELECT date, " + ", ".join(f"{r(f)} AS {f}" for f in FACTORS) + " FROM factors WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'"),
)
def factor_range_q(spark, sf):
    return rounded(factor_range(b.factors(spark, sf), "1997-01-01", "1998-12-31").select("date", *FACTORS))


# ---- dates, symbols and membership -----------------------------------------------------


@query(
    "parse_dates",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 4 THEN make_date(extract(year FROM o_orderdate), 1, 1) WHEN o_orderkey % 6 = 5 THEN NULL
  ELSE CAST(o_orderdate AS DATE) END AS parsed FROM orders""",
)
def parse_dates(spark, sf):
    """Order dates as text in each of the accepted layouts, and as text that is no date."""
    day, kind = F.col("o_orderdate"), F.col("o_orderkey") % 6
    text = (
        F.when(kind == 0, F.date_format(day, "MMMM d, yyyy"))
        .when(kind == 1, F.date_format(day, "yyyy-MM-dd"))
        .when(kind == 2, F.concat(F.lit(" "), F.date_format(day, "d MMMM yyyy")))
        .when(kind == 3, F.date_format(day, "MMM d, yyyy"))
        .when(kind == 4, F.date_format(day, "yyyy"))
        .otherwise("—")
    )
    return b.table(spark, sf, "orders").select("o_orderkey", parse_date(text).alias("parsed"))


_RULES = sy.SymbolRules(
    renames={"Brand#1": "Brand#2", "Brand#3": "Brand#4", "Brand#6": "Brand#7"},
    dropped=("Brand#4", "Brand#5"),
    punctuation={"Brand#7": "Brand-7"},
)


@query(
    "resolve_symbols",
    """SELECT p_partkey, CASE WHEN t = 'Brand#7' THEN 'Brand-7' ELSE t END AS ticker FROM (
SELECT p_partkey, CASE p_brand WHEN 'Brand#1' THEN 'Brand#2' WHEN 'Brand#3' THEN 'Brand#4' WHEN 'Brand#6' THEN 'Brand#7' ELSE p_brand END AS t
FROM part WHERE p_brand NOT IN ('Brand#4', 'Brand#5')) WHERE t NOT IN ('Brand#4', 'Brand#5')""",
)
def resolve_symbols(spark, sf):
    parts = b.table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    return sy.resolve(parts, _RULES).select("p_partkey", "ticker")


@query(
    "universe_file",
    """SELECT DISTINCT CASE WHEN t = 'Brand#7' THEN 'Brand-7' ELSE t END AS ticker FROM (
SELECT CASE p_brand WHEN 'Brand#1' THEN 'Brand#2' WHEN 'Brand#3' THEN 'Brand#4' WHEN 'Brand#6' THEN 'Brand#7' ELSE p_brand END AS t
FROM part WHERE p_brand NOT IN ('Brand#4', 'Brand#5')) WHERE t NOT IN ('Brand#4', 'Brand#5')""",
)
def universe_file(spark, sf):
    """Write a universe file of all brands and load it with symbol resolution."""
    folder = fresh_path(spark, "universes")
    ms.write_universe(b.bars(spark, sf).select("ticker").distinct(), f"{folder}/all.txt")
    return sy.load_universe(spark, folder, "all", _RULES)


def _changes(spark, sf):
    """A change log: each brand's first line of a quarter, added and removed in turn; and a components table."""
    lines = b.bars(spark, sf).select("ticker", "date")
    quarter = F.year("date") * 4 + F.quarter("date")
    number = F.substring("ticker", 7, 10).cast("int")
    log = lines.withColumn("q", quarter).groupBy("ticker", "q").agg(F.min("date").alias("d"))
    side = F.floor((F.col("q") + number) / 3) % 2 == 0
    changes = log.select(
        F.date_format("d", "MMMM d, yyyy").alias("Date"),
        F.when(side, F.col("ticker")).otherwise("nan").alias("Added Ticker"),
        F.when(~side, F.col("ticker")).otherwise("").alias("Removed Ticker"),
    )
    components = (
        lines.groupBy("ticker").agg(F.min("date").alias("d"))
        .select(F.col("ticker").alias("Symbol"), F.date_format("d", "yyyy-MM-dd").alias("Date added"))
    )
    return ms.parse_components(components), ms.parse_changes(changes)


BLOCKS["change_log"] = (
    ("bars",),
    """SELECT ticker, min(date) AS date, CASE WHEN floor((q + n) / 3) % 2 = 0 THEN 1 ELSE 0 END AS is_add
FROM (SELECT ticker, date, extract(year FROM date) * 4 + extract(quarter FROM date) AS q, CAST(substr(ticker, 7) AS INT) AS n FROM bars)
GROUP BY ticker, q, n""",
)


@query(
    "parse_changes",
    with_blocks(
        ("change_log",),
        """SELECT date, CASE WHEN is_add = 1 THEN ticker ELSE '' END AS added_ticker, CASE WHEN is_add = 0 THEN ticker ELSE '' END AS removed_ticker
FROM change_log""",
    ),
)
def parse_changes(spark, sf):
    return _changes(spark, sf)[1]


@query(
    "parse_components",
    with_blocks(
        ("bars",),
        "SELECT ticker, min(date) AS added, CAST(NULL AS DATE) AS removed FROM bars GROUP BY 1",
    ),
)
def parse_components(spark, sf):
    return _changes(spark, sf)[0]


@query(
    "fold_membership",
    with_blocks(
        ("change_log", "bars"),
        """SELECT ticker, added, removed FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY i DESC) AS z FROM walk) WHERE z = 1""",
        {
            "ev": "SELECT ticker, date, is_add, row_number() OVER (PARTITION BY ticker ORDER BY date, is_add) AS i FROM change_log",
            "start": """SELECT ticker, max(added) AS added FROM (SELECT ticker, NULL::DATE AS added FROM change_log
  UNION ALL SELECT ticker, min(date) FROM bars GROUP BY 1) GROUP BY 1""",
            "walk": """SELECT ticker, 0::BIGINT AS i, added, NULL::DATE AS removed FROM start
  UNION ALL
  SELECT w.ticker, e.i,
    CASE WHEN e.is_add = 0 THEN coalesce(w.added, DATE '1970-01-01') WHEN w.added IS NULL OR w.removed IS NOT NULL THEN e.date ELSE w.added END,
    CASE WHEN e.is_add = 0 THEN e.date END
  FROM walk w JOIN ev e ON e.ticker = w.ticker AND e.i = w.i + 1""",
        },
        recursive=True,
    ),
)
def fold_membership(spark, sf):
    return ms.fold_membership(*_changes(spark, sf))


@query(
    "members_on_date",
    with_blocks(
        ("membership",),
        "SELECT ticker FROM membership WHERE added <= DATE '1999-06-30' AND (removed IS NULL OR removed > DATE '1999-06-30')",
    ),
)
def members_on_date(spark, sf):
    return ms.members_on(b.membership(spark, sf), "1999-06-30")


@query(
    "members_during_window",
    with_blocks(
        ("membership",),
        "SELECT ticker FROM membership WHERE added <= DATE '2001-01-01' AND (removed IS NULL OR removed > DATE '2000-01-01')",
    ),
)
def members_during_window(spark, sf):
    return ms.members_during(b.membership(spark, sf), "2000-01-01", "2001-01-01")


@query(
    "filter_panel_to_members",
    with_blocks(
        ("bars", "membership"),
        f"""SELECT b.date, b.ticker, {r('close')} AS close FROM bars b JOIN membership m ON b.ticker = m.ticker
  AND m.added <= b.date AND (m.removed IS NULL OR b.date < m.removed)""",
    ),
)
def filter_panel_to_members(spark, sf):
    out = ms.filter_to_members(b.bars(spark, sf), b.membership(spark, sf))
    return rounded(out.select("date", "ticker", "close"))


@query(
    "survivor_snapshot",
    with_blocks(
        ("bars", "membership"),
        """SELECT ticker, count(*) AS n FROM bars WHERE ticker IN (SELECT ticker FROM membership WHERE added <= (SELECT max(date) FROM bars)
  AND (removed IS NULL OR removed > (SELECT max(date) FROM bars))) GROUP BY 1""",
    ),
)
def survivor_snapshot(spark, sf):
    return ms.survivors(b.bars(spark, sf), b.membership(spark, sf)).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


@query(
    "universe_export",
    with_blocks(
        ("membership",),
        """SELECT ticker, CASE WHEN removed IS NULL OR removed > DATE '2001-06-30' THEN 'active' ELSE 'historical' END AS status
FROM membership WHERE added <= DATE '2001-01-01' AND (removed IS NULL OR removed > DATE '1996-01-01')""",
    ),
)
def universe_export(spark, sf):
    return ms.universe_table(b.membership(spark, sf), "1996-01-01", "2001-01-01", "2001-06-30")


# ---- splits ---------------------------------------------------------------------------


def _span(spark, sf):
    return b.bars(spark, sf).agg(F.min("date"), F.max("date")).first()


@query(
    "walk_forward_splits",
    with_blocks(
        ("bars",),
        """SELECT CAST(row_number() OVER (ORDER BY refit) - 1 AS INT) AS split, refit AS refit_date, refit - 6 AS train_end, refit AS test_start,
  least(refit + 20, e) AS test_end
FROM (SELECT s, e, CAST(unnest(range(s + 504, e + 1, INTERVAL 21 DAY)) AS DATE) AS refit FROM (SELECT min(date) AS s, max(date) AS e FROM bars)) WHERE refit - 6 > s""",
    ),
)
def walk_forward_splits(spark, sf):
    return fo.splits_table(spark, fo.walk_forward_splits(*_span(spark, sf)))


@query(
    "purged_fold_dates",
    with_blocks(
        ("bars",),
        """SELECT CAST(f AS INT) AS fold, min(date) FILTER (WHERE i < tt) AS train_start, max(date) FILTER (WHERE i < tt) AS train_end,
  count(*) FILTER (WHERE i < tt) AS n_train_dates, min(date) FILTER (WHERE i >= vf AND i < vt) AS val_start,
  max(date) FILTER (WHERE i >= vf AND i < vt) AS val_end, count(*) FILTER (WHERE i >= vf AND i < vt) AS n_val_dates
FROM (SELECT d.*, f, greatest(0, f * c - least(21, c - 1)) AS tt, f * c AS vf, CASE WHEN f < 5 THEN (f + 1) * c ELSE n END AS vt
  FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n, count(*) OVER () // 6 AS c FROM (SELECT DISTINCT date FROM bars)) d,
    (SELECT unnest(range(1, 6)) AS f)) GROUP BY 1""",
    ),
)
def purged_fold_dates(spark, sf):
    index = fo.date_index(b.bars(spark, sf))
    return fo.fold_dates(index, fo.chain_folds(index.count(), 5, 21))


@query(
    "block_fold_dates",
    with_blocks(
        ("bars",),
        """SELECT CAST(f AS INT) AS fold, min(date) FILTER (WHERE i < tt) AS train_start, max(date) FILTER (WHERE i < tt) AS train_end,
  count(*) FILTER (WHERE i < tt) AS n_train_dates, min(date) FILTER (WHERE i >= vf AND i < vt) AS val_start,
  max(date) FILTER (WHERE i >= vf AND i < vt) AS val_end, count(*) FILTER (WHERE i >= vf AND i < vt) AS n_val_dates
FROM (SELECT d.*, f, greatest(0, f * c - 33) AS tt, f * c AS vf, CASE WHEN f < 3 THEN (f + 1) * c ELSE n END AS vt
  FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n, count(*) OVER () // 4 AS c FROM (SELECT DISTINCT date FROM bars)) d,
    (SELECT unnest(range(1, 4)) AS f)) GROUP BY 1""",
    ),
)
def block_fold_dates(spark, sf):
    index = fo.date_index(b.bars(spark, sf))
    return fo.fold_dates(index, fo.block_folds(index.count(), 4, 33))


@query(
    "train_test_slices",
    with_blocks(
        ("bars",),
        """SELECT 'train' AS part, count(*) AS n, min(date) AS lo, max(date) AS hi FROM bars WHERE date BETWEEN DATE '1996-01-01' AND DATE '1998-06-25'
UNION ALL SELECT 'test', count(*), min(date), max(date) FROM bars WHERE date BETWEEN DATE '1998-07-01' AND DATE '1998-07-21'""",
    ),
)
def train_test_slices(spark, sf):
    split = fo.Split(date(1998, 7, 1), date(1998, 6, 25), date(1998, 7, 1), date(1998, 7, 21))
    parts = [
        part.groupBy(F.lit(name).alias("part")).agg(
            F.count(F.lit(1)).alias("n"), F.min("date").alias("lo"), F.max("date").alias("hi")
        )
        for name, part in (
            ("train", fo.slice_train(b.bars(spark, sf), split, date(1996, 1, 1))),
            ("test", fo.slice_test(b.bars(spark, sf), split)),
        )
    ]
    return parts[0].unionByName(parts[1])


@query(
    "fraction_split",
    with_blocks(
        ("bars",),
        """SELECT CASE WHEN i < n - h THEN 'train' ELSE 'val' END AS part, count(*) AS n FROM bars JOIN (
  SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n, CAST(round_even(count(*) OVER () * 0.15, 0) AS INT) AS h
  FROM (SELECT DISTINCT date FROM bars)) USING (date) GROUP BY 1""",
    ),
)
def fraction_split(spark, sf):
    train, val = fo.split_by_fraction(b.bars(spark, sf), 0.15)
    both = train.withColumn("part", F.lit("train")).unionByName(val.withColumn("part", F.lit("val")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query(
    "time_fraction_split",
    with_blocks(
        ("tabular",),
        """SELECT CASE WHEN ts_index <= c THEN 'train' ELSE 'val' END AS part, count(*) AS n FROM tabular, (
  SELECT ts_index AS c FROM (SELECT ts_index, row_number() OVER (ORDER BY ts_index) - 1 AS i, count(*) OVER () AS n
    FROM (SELECT DISTINCT ts_index FROM tabular)) WHERE i = floor(0.8 * n)) GROUP BY 1""",
    ),
)
def time_fraction_split(spark, sf):
    train, val = fo.split_time_fraction(b.tabular(spark, sf), "ts_index", 0.2)
    both = train.withColumn("part", F.lit("train")).unionByName(val.withColumn("part", F.lit("val")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query(
    "expanding_time_folds",
    with_blocks(
        ("tabular",),
        """SELECT CAST(k AS INT) AS fold, n_train, n_val, lo, hi FROM (SELECT k, count(*) FILTER (WHERE i < vs) AS n_train,
  count(*) FILTER (WHERE i >= vs AND i < vs + sz) AS n_val, min(ts_index) FILTER (WHERE i >= vs AND i < vs + sz) AS lo,
  max(ts_index) FILTER (WHERE i >= vs AND i < vs + sz) AS hi
FROM (SELECT t.*, k, CAST(floor(n * 0.6) AS INT) + CAST(floor((n - sz - CAST(floor(n * 0.6) AS INT)) * (k - 1) / 2.0) AS INT) AS vs
  FROM (SELECT ts_index, row_number() OVER (ORDER BY ts_index) - 1 AS i, count(*) OVER () AS n, CAST(floor(count(*) OVER () * 0.1) AS INT) AS sz
    FROM (SELECT DISTINCT ts_index FROM tabular)) t, (SELECT unnest([1, 2, 3]) AS k)) GROUP BY 1)""",
    ),
)
def expanding_time_folds(spark, sf):
    index = fo.date_index(b.tabular(spark, sf), "ts_index")
    out = fo.fold_dates(index, fo.expanding_time_folds(index.count(), 3), "ts_index")
    return out.select(
        "fold",
        F.col("n_train_dates").alias("n_train"),
        F.col("n_val_dates").alias("n_val"),
        F.col("val_start").alias("lo"),
        F.col("val_end").alias("hi"),
    )


# ---- store -----------------------------------------------------------------------------

BLOCKS["stored"] = (
    ("predictions",),
    """SELECT TIMESTAMP '2024-01-01 00:00:00' AS generated_at, date AS prediction_date, date + 5 AS target_date, 5 AS horizon_days, ticker, model_id,
  'base' AS experiment_id, prediction FROM predictions
UNION ALL SELECT TIMESTAMP '2024-02-01 00:00:00', date, date + 5, 5, ticker, model_id, 'rerun', prediction * 2 FROM predictions
  WHERE date >= DATE '1999-01-01'""",
)


def _store(spark, sf):
    """Predictions written twice: a base experiment and a later rerun of a part."""
    store = st.PredictionStore(spark, fresh_path(spark, "store"))
    predictions = b.predictions(spark, sf)
    store.write(predictions, "base", 5, generated_at=datetime(2024, 1, 1))
    again = predictions.where(F.col("date") >= "1999-01-01").withColumn("prediction", F.col("prediction") * 2)
    store.write(again, "rerun", 5, generated_at=datetime(2024, 2, 1))
    return store


_STORED = "prediction_date, target_date, horizon_days, ticker, model_id, experiment_id"


@query("store_rows", with_blocks(("stored",), f"SELECT {_STORED}, {r('prediction')} AS prediction FROM stored"))
def store_rows(spark, sf):
    out = _store(spark, sf).table()
    return rounded(out.select(*_STORED.split(", "), "prediction"))


@query(
    "store_latest",
    with_blocks(
        ("stored",),
        f"""SELECT {_STORED}, {r('prediction')} AS prediction FROM stored s WHERE model_id IN ('mom60', 'ret5') AND prediction_date = (
  SELECT max(prediction_date) FROM stored x WHERE x.model_id = s.model_id AND x.prediction_date <= DATE '2000-01-15')""",
    ),
)
def store_latest(spark, sf):
    out = _store(spark, sf).latest(["mom60", "ret5"], "2000-01-15")
    return rounded(out.select(*_STORED.split(", "), "prediction"))


@query("store_models", with_blocks(("stored",), "SELECT DISTINCT model_id FROM stored"))
def store_models(spark, sf):
    return _store(spark, sf).models()


@query("store_clear_experiment", with_blocks(("stored",), "SELECT experiment_id, count(*) AS n FROM stored WHERE experiment_id = 'base' GROUP BY 1"))
def store_clear_experiment(spark, sf):
    store = _store(spark, sf)
    store.clear_experiment("rerun")
    return store.table().groupBy("experiment_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "store_newest",
    with_blocks(
        ("stored",),
        f"""SELECT {_STORED}, {r('prediction')} AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY model_id, prediction_date, ticker
  ORDER BY generated_at DESC) AS k FROM stored) WHERE k = 1""",
    ),
)
def store_newest(spark, sf):
    out = st.newest_predictions(_store(spark, sf).table())
    return rounded(out.select(*_STORED.split(", "), "prediction"))


@query(
    "store_mean",
    with_blocks(
        ("stored",),
        f"SELECT prediction_date AS date, ticker, model_id, {r('avg(prediction)')} AS prediction FROM stored GROUP BY 1, 2, 3",
    ),
)
def store_mean(spark, sf):
    table = _store(spark, sf).table().withColumnRenamed("prediction_date", "date")
    return rounded(st.mean_predictions(table))


@query(
    "store_health",
    with_blocks(
        ("stored",),
        "SELECT count(*) AS n_rows, count(DISTINCT model_id) AS n_models, count(DISTINCT ticker) AS n_tickers, max(prediction_date) AS last_date FROM stored",
    ),
)
def store_health(spark, sf):
    return _store(spark, sf).health()


@query(
    "store_sql",
    with_blocks(
        ("stored",),
        f"SELECT experiment_id, model_id, count(*) AS n, {r('avg(prediction)')} AS mean_prediction FROM stored GROUP BY 1, 2",
    ),
)
def store_sql(spark, sf):
    out = _store(spark, sf).query(
        "SELECT experiment_id, model_id, count(*) AS n, avg(prediction) AS mean_prediction FROM predictions GROUP BY 1, 2"
    )
    return rounded(out)


@query(
    "csv_export_align",
    with_blocks(
        ("predictions",),
        "SELECT CAST(date AS VARCHAR) || '/' || ticker AS id, "
        + ", ".join(f"{r(f"max(prediction) FILTER (WHERE model_id = '{m}')")} AS {m}" for m in b.MODELS)
        + " FROM predictions GROUP BY 1",
    ),
)
def csv_export_align(spark, sf):
    """One CSV folder per model, read back side by side by id."""
    store = st.PredictionStore(spark, fresh_path(spark, "store"))
    paths = {}
    for m in b.MODELS:
        part = b.predictions(spark, sf).where(F.col("model_id") == m)
        paths[m] = fresh_path(spark, f"csv-{m}")
        store.export_csv(part.select(F.concat_ws("/", "date", "ticker").alias("id"), "prediction"), paths[m])
    return rounded(st.align_prediction_files(spark, paths, "id", "prediction"))


@query(
    "common_column_union",
    with_blocks(
        ("predictions",),
        f"SELECT date, ticker, {r('prediction')} AS prediction, model_id FROM predictions",
    ),
)
def common_column_union(spark, sf):
    base = b.predictions(spark, sf).select("date", "ticker", "prediction", "model_id")
    banded = base.where(F.col("model_id") == "vol20").withColumn("pred_lower", F.col("prediction") - 1)
    return rounded(st.common_columns_union([base.where(F.col("model_id") != "vol20"), banded]))


@query(
    "distinct_keys",
    with_blocks(("stored",), "SELECT DISTINCT prediction_date, ticker FROM stored"),
)
def distinct_keys(spark, sf):
    table = _store(spark, sf).table()
    return table.dropDuplicates(["prediction_date", "ticker"]).select("prediction_date", "ticker")


@query(
    "date_intersection_counts",
    with_blocks(
        ("predictions",),
        """SELECT ticker, count(*) AS n FROM predictions WHERE date IN (SELECT date FROM predictions GROUP BY 1 HAVING count(DISTINCT model_id) = 4) GROUP BY 1""",
    ),
)
def date_intersection_counts(spark, sf):
    return on_common_dates(b.predictions(spark, sf)).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
