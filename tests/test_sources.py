import random
from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from crosslane.functions.dates import parse_date
from crosslane.plans.experiment import load_panel
from crosslane.session import fresh_path, list_names, work_dir
from crosslane.sources import bars as br
from crosslane.sources import membership as ms
from crosslane.sources import store as st
from crosslane.sources import symbols as sy
from crosslane.sources.factors import FILE_COLUMNS, factor_range, read_factor_file
from crosslane.streaming.bars import extend_from_stream, read_landed

# ---- bars ------------------------------------------------------------------------


@pytest.mark.parametrize(
    "names",
    [
        ["Date", "Open", "High", "Low", "Close", "Adj Close", "Volume"],
        ["date", "open", "high", "low", "close", "adj_close", "volume"],
        ["Datetime", "('Open', 'AAA')", "('High', 'AAA')", "('Low', 'AAA')", "('Close', 'AAA')", "('Adj Close', 'AAA')", "('Volume', 'AAA')"],
    ],
)
def test_normalize_layouts(spark, names):
    rows = [("2024-01-02", 1.0, 2.0, 0.5, 1.5, 1.4, 100), ("2024-01-03", 1.0, 2.0, 0.5, None, 1.4, 100)]
    out = br.normalize_bars(spark.createDataFrame(rows, names), "AAA")
    assert out.schema.fieldNames() == br.BAR_SCHEMA.fieldNames()
    got = out.collect()
    assert len(got) == 1 and got[0]["date"] == date(2024, 1, 2) and got[0]["adj_close"] == 1.4 and got[0]["ticker"] == "AAA"


def test_normalize_without_adjusted_close_and_bad_cells(spark):
    raw = spark.createDataFrame([("2024-01-02", "1", "x", "0.5", "1.5", "7")], "Date string, Open string, High string, Low string, Close string, Volume string")
    row = br.normalize_bars(raw, "A").first()
    assert row["adj_close"] == 1.5 and row["high"] is None and row["volume"] == 7
    with pytest.raises(ValueError):
        br.normalize_bars(raw.drop("Volume"), "A")
    with pytest.raises(ValueError):
        br.normalize_bars(raw)


def _bars(spark, rows):
    return spark.createDataFrame(
        [(date(2024, 1, 1) + timedelta(days=d), t, c, c, c, c, c, 1) for t, d, c in rows], br.BAR_SCHEMA
    )


def test_store_extends_once_per_key(spark):
    store = br.BarStore(spark, fresh_path(spark, "bars"))
    assert store.read().isEmpty()
    store.write(_bars(spark, [("A", 0, 1.0), ("A", 1, 2.0), ("B", 0, 5.0)]))
    landed = _bars(spark, [("A", 0, 9.0), ("A", 1, 3.0), ("A", 2, 4.0), ("B", 1, 6.0), ("C", 0, 7.0)])
    for _ in range(2):
        store.extend(landed)
    got = {(r["ticker"], r["date"].day): r["close"] for r in store.read().collect()}
    # Day 1 of A is before its last stored date, so the landed row does not replace it.
    assert got == {("A", 1): 1.0, ("A", 2): 3.0, ("A", 3): 4.0, ("B", 1): 5.0, ("B", 2): 6.0, ("C", 1): 7.0}
    assert store.read("2024-01-02", "2024-01-02").count() == 2


def test_store_refuses_what_has_no_single_key(spark):
    store = br.BarStore(spark, fresh_path(spark, "bars"))
    none = spark.createDataFrame([(None, "A", 1.0, 1.0, 1.0, 1.0, 1.0, 1)], br.BAR_SCHEMA)
    store.write(_bars(spark, [("A", 0, 1.0)]).unionByName(none))
    store.extend(none)
    assert store.read().count() == 1
    with pytest.raises(ValueError):
        store.write(_bars(spark, [("A", 0, 1.0), ("A", 0, 2.0)]))


def test_extension_leaves_other_years(spark):
    store = br.BarStore(spark, fresh_path(spark, "bars"))
    store.write(_bars(spark, [("A", 0, 1.0), ("A", 400, 2.0), ("B", 0, 3.0)]))
    store.extend(_bars(spark, [("A", 401, 4.0)]))
    assert sorted(r["close"] for r in store.read().collect()) == [1.0, 2.0, 3.0, 4.0]
    assert store.read("2024-06-01").count() == 2


def _spoil(store, year):
    """Make a year's files unreadable."""
    folder = f"{store.path}/year={year}"
    for name in list_names(store.spark, folder):
        if name.endswith(".parquet"):
            Path(folder, name).write_bytes(b"not a table")


def test_extension_reads_touched_years_and_the_side_table_only(spark):
    store = br.BarStore(spark, fresh_path(spark, "bars"))
    store.write(_bars(spark, [("A", 0, 1.0), ("A", 400, 2.0), ("B", 0, 3.0), ("C", 410, 1.0)]))
    _spoil(store, 2024)
    # A day of A before its last date is refused, which only the side table can know without reading the first year.
    store.extend(_bars(spark, [("A", 399, 9.0), ("A", 401, 4.0), ("D", 380, 6.0)]))
    got = {(r["ticker"], r["close"]) for r in store.read("2025-01-01").collect()}
    assert got == {("A", 2.0), ("A", 4.0), ("C", 1.0), ("D", 6.0)}
    marks = {r["ticker"]: str(r["last_date"]) for r in store.last_dates().collect()}
    assert marks == {"A": "2025-02-05", "B": "2024-01-01", "C": "2025-02-14", "D": "2025-01-15"}


def test_last_dates_survive_a_writer_that_dies(spark, monkeypatch):
    store = br.BarStore(spark, fresh_path(spark, "bars"))
    store.write(_bars(spark, [("A", 0, 1.0)]))
    # The rows are there, the side table is still the old one, the mark stands.
    monkeypatch.setattr(br, "remove", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        store.extend(_bars(spark, [("A", 5, 2.0)]))
    monkeypatch.undo()
    assert [str(r["last_date"]) for r in store.last_dates().collect()] == ["2024-01-06"]
    store.extend(_bars(spark, [("A", 4, 7.0), ("A", 6, 3.0)]))
    assert sorted(r["close"] for r in store.read().collect()) == [1.0, 2.0, 3.0]
    assert len([n for n in list_names(spark, f"{store.path}/_last") if n.startswith("v")]) == 1
    store.write(_bars(spark, [("B", 1, 1.0)]))
    assert [(r["ticker"], str(r["last_date"])) for r in store.last_dates().collect()] == [("B", "2024-01-02")]


def test_stream_and_rerun(spark):
    folder = fresh_path(spark, "landing")
    store = br.BarStore(spark, fresh_path(spark, "bars"))
    _bars(spark, [("A", 0, 1.0)]).write.parquet(folder)
    extend_from_stream(read_landed(spark, folder), store, f"{folder}-ck").awaitTermination()
    _bars(spark, [("A", 0, 2.0), ("A", 1, 3.0)]).write.mode("append").parquet(folder)
    for _ in range(2):
        extend_from_stream(read_landed(spark, folder), store, f"{folder}-ck").awaitTermination()
    assert sorted(r["close"] for r in store.read().collect()) == [2.0, 3.0]


def test_sector_default(spark):
    sectors = spark.createDataFrame([("A", "Tech")], "ticker string, sector string")
    out = br.attach_sector(_bars(spark, [("A", 0, 1.0), ("B", 0, 1.0)]), sectors)
    assert {r["ticker"]: r["sector"] for r in out.collect()} == {"A": "Tech", "B": "Unknown"}
    assert br.attach_sector(out, sectors) is out


# ---- factors ---------------------------------------------------------------------

FILE = """This file was created for a test

,Mkt-RF,SMB,HML,RMW,CMA,RF
20240102,  1.00, 0.50,-0.25, 0.10, 0.00, 0.02
20240103, -2.00, 0.00, 0.00, 0.00, 0.00, 0.02

 Annual Factors: January-December
2024, 9, 9, 9, 9, 9, 9
"""


def _text(spark, text):
    path = fresh_path(spark, "factors")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return path


def test_factor_file(spark):
    out = read_factor_file(spark, _text(spark, FILE))
    rows = {r["date"]: r for r in out.collect()}
    assert set(rows) == {date(2024, 1, 2), date(2024, 1, 3)}
    assert rows[date(2024, 1, 2)]["MKT_RF"] == pytest.approx(0.01) and rows[date(2024, 1, 2)]["HML"] == pytest.approx(-0.0025)
    assert out.columns == ["date", *FILE_COLUMNS]
    assert factor_range(out, "2024-01-03", None).count() == 1


@pytest.mark.parametrize("text", ["nothing here\n1,2,3\n", ",Mkt-RF,SMB,HML,RMW,CMA,RF\n\n"])
def test_factor_file_errors(spark, text):
    with pytest.raises(ValueError):
        read_factor_file(spark, _text(spark, text))


# ---- dates, symbols, universes -----------------------------------------------------


def test_parse_dates(spark):
    texts = ["October 19, 1987", "1987-10-19", "19 October 1987", "Oct 19, 1987", " 1929 ", "—", "nan", "", None, "later"]
    want = [date(1987, 10, 19)] * 4 + [date(1929, 1, 1)] + [None] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r["d"] for r in df.withColumn("d", parse_date(F.col("t"))).orderBy("i").collect()]
    assert got == want


RULES = sy.SymbolRules({"OLD": "NEW", "GONE2": "DEAD", "B.OLD": "BRK.B"}, ("DEAD", "LOST"))


def test_resolve(spark):
    df = spark.createDataFrame([(s,) for s in ["OLD", "NEW", "GONE2", "LOST", "BRK.B", "B.OLD", "X"]], "symbol string")
    got = {r["symbol"]: r["ticker"] for r in sy.resolve(df, RULES).collect()}
    assert got == {"OLD": "NEW", "NEW": "NEW", "BRK.B": "BRK-B", "B.OLD": "BRK-B", "X": "X"}
    assert RULES.all_dropped() == {"DEAD", "LOST", "GONE2"}


def test_rules_from_files_are_joined(spark, tmp_path):
    (tmp_path / "renames.csv").write_text("old,new\nOLD,NEW\nGONE2,DEAD\nB.OLD,BRK.B\nOLD,NEWER\n" + "".join(f"S{k},T{k}\n" for k in range(3000)))
    (tmp_path / "dropped.txt").write_text("DEAD\n LOST \n\n" + "".join(f"D{k}\n" for k in range(3000)))
    rules = sy.read_rules(spark, str(tmp_path / "renames.csv"), str(tmp_path / "dropped.txt"))
    symbols = ["OLD", "GONE2", "B.OLD", "LOST", "DEAD", "X", "S7", "S2999", "D5", None, "X"]
    df = spark.createDataFrame([(s, 1, "kept") for s in symbols], "symbol string, n int, ticker string")
    out = sy.resolve(df, rules)
    assert out.columns == ["symbol", "n", "ticker"]
    got = sorted((r["symbol"], r["ticker"]) for r in out.collect())
    assert got == [("B.OLD", "BRK-B"), ("OLD", "NEWER"), ("S2999", "T2999"), ("S7", "T7"), ("X", "X"), ("X", "X")]


def test_universe_round_trip(spark):
    folder = fresh_path(spark, "universe")
    ms.write_universe(spark.createDataFrame([("B",), ("A",), ("OLD",), ("LOST",)], "ticker string"), f"{folder}/small.txt")
    assert sy.list_universes(spark, folder) == ["small"]
    assert [r[0] for r in sy.load_universe(spark, folder, "small", RULES).collect()] == ["A", "B", "NEW"]
    with pytest.raises(ValueError):
        sy.load_universe(spark, folder, "other")


# ---- membership --------------------------------------------------------------------


def _brute_fold(components, changes):
    table = {t: [a, None] for t, a in components}
    for d, added, removed in sorted(changes):
        for name, is_add in ((removed, False), (added, True)):
            if not name:
                continue
            entry = table.get(name)
            if is_add and entry is None:
                table[name] = [d, None]
            elif is_add and entry[1] is not None:
                table[name] = [d, None]
            elif not is_add and entry is None:
                table[name] = [date(1970, 1, 1), d]
            elif not is_add:
                entry[1] = d
    return {t: tuple(v) for t, v in table.items()}


@pytest.mark.parametrize("seed", range(4))
def test_fold_against_brute_force(spark, seed, small_tasks):
    rng = random.Random(seed)
    names = [f"N{i}" for i in range(8)]
    components = [(n, date(2000, 1, 1)) for n in names[:3]]
    days = rng.sample(range(4000), 80)
    # Half of the events are of one name, so its key is split.
    pick = lambda: "N0" if rng.random() < 0.5 else rng.choice(names)
    changes = []
    for d in days:
        when = date(2001, 1, 1) + timedelta(days=d)
        a, z = (pick() if rng.random() < 0.7 else ""), (pick() if rng.random() < 0.7 else "")
        changes.append((when, a, z if z != a else ""))
    c = spark.createDataFrame([(t, a, None) for t, a in components], "ticker string, added date, removed date")
    g = spark.createDataFrame(changes, "date date, added_ticker string, removed_ticker string")
    got = {r["ticker"]: (r["added"], r["removed"]) for r in ms.fold_membership(c, g).collect()}
    assert got == _brute_fold(components, changes)


def _membership(spark):
    """One member since ever, one since 2010, one that left, one that came late."""
    rows = [
        ("OLDEST", date(1970, 1, 1), None),
        ("STEADY", date(2010, 4, 6), None),
        ("LEAVER", date(2011, 9, 1), date(2014, 7, 8)),
        ("LATE", date(2013, 2, 11), None),
    ]
    return spark.createDataFrame(rows, "ticker string, added date, removed date")


def test_interval_answers(spark):
    m = _membership(spark)
    names = lambda df: {r[0] for r in df.collect()}
    assert names(ms.members_on(m, "2013-02-10")) == {"OLDEST", "STEADY", "LEAVER"}
    assert names(ms.members_on(m, "2014-07-08")) == {"OLDEST", "STEADY", "LATE"}
    assert ms.is_member(m, "LEAVER", "2014-07-07") and not ms.is_member(m, "LEAVER", "2014-07-08")
    assert names(ms.members_during(m, "2014-07-07", "2014-12-31")) == {"OLDEST", "STEADY", "LEAVER", "LATE"}
    assert names(ms.members_during(m, "2014-07-08", "2014-12-31")) == {"OLDEST", "STEADY", "LATE"}
    with pytest.raises(ValueError):
        ms.members_during(m, "2015-01-01", "2014-01-01")
    table = ms.universe_table(m, "2010-01-01", "2014-01-01", "2016-01-01")
    status = {r["ticker"]: r["status"] for r in table.collect()}
    assert status == {"OLDEST": "active", "STEADY": "active", "LATE": "active", "LEAVER": "historical"}


def test_filter_to_members(spark):
    days = [("LEAVER", 2014, 7, 7), ("LEAVER", 2014, 7, 8), ("LATE", 2013, 2, 10), ("LATE", 2013, 2, 11), ("NEVER", 2013, 5, 5)]
    panel = spark.createDataFrame([(t, date(y, m, d)) for t, y, m, d in days], "ticker string, date date")
    out = ms.filter_to_members(panel, _membership(spark))
    assert out.columns == panel.columns
    assert {(r["ticker"], r["date"].day) for r in out.collect()} == {("LEAVER", 7), ("LATE", 11)}
    assert ms.filter_to_members(panel.limit(0), _membership(spark)).isEmpty()
    with pytest.raises(ValueError):
        ms.filter_to_members(panel.drop("date"), _membership(spark))
    assert {r["ticker"] for r in ms.survivors(panel, _membership(spark)).collect()} == {"LATE"}


def test_membership_parsers(spark):
    listed = [("BF.B", "1929"), ("LATE", "February 11, 2013"), ("Q", "unknown")]
    components = spark.createDataFrame(listed, "Symbol string, `Date added` string")
    got = {r["ticker"]: r["added"] for r in ms.parse_components(components).collect()}
    assert got == {"BF-B": date(1929, 1, 1), "LATE": date(2013, 2, 11), "Q": date(1970, 1, 1)}
    changes = spark.createDataFrame(
        [("July 8, 2014", "CAME", "LEAVER"), ("nan", "P", "Q"), ("2012-12-12", "nan", ""), ("2012-11-30", "R", None)],
        "`Date Date` string, `Added Ticker` string, `Removed Ticker` string",
    )
    got = {(r["date"], r["added_ticker"], r["removed_ticker"]) for r in ms.parse_changes(changes).collect()}
    assert got == {(date(2014, 7, 8), "CAME", "LEAVER"), (date(2012, 11, 30), "R", "")}
    with pytest.raises(ValueError):
        ms.parse_components(components.drop("Symbol"))
    with pytest.raises(ValueError):
        ms.parse_changes(changes.drop("Date Date"))


def test_load_panel_order(spark, panel):
    members = spark.createDataFrame([("T00", date(2020, 3, 1), date(2020, 4, 1)), ("T01", date(1970, 1, 1), None)], "ticker string, added date, removed date")
    out = load_panel(panel.drop("sector"), panel.select("ticker").distinct(), "2020-02-01", "2020-05-01", members, spark.createDataFrame([("T00", "S")], "ticker string, sector string"))
    spans = {r["ticker"]: (r["lo"], r["hi"], r["s"]) for r in out.groupBy("ticker").agg(F.min("date").alias("lo"), F.max("date").alias("hi"), F.first("sector").alias("s")).collect()}
    assert spans == {"T00": (date(2020, 3, 1), date(2020, 3, 31), "S"), "T01": (date(2020, 2, 1), date(2020, 5, 1), "Unknown")}


# ---- store -------------------------------------------------------------------------


def _predictions(spark, model, day, values):
    return spark.createDataFrame([(model, day, t, v) for t, v in values.items()], "model_id string, date date, ticker string, prediction double")


def test_store(spark):
    from datetime import datetime

    store = st.PredictionStore(spark, fresh_path(spark, "store"))
    assert store.table().isEmpty() and store.health().first()["n_rows"] == 0
    d1, d2 = date(2024, 1, 2), date(2024, 1, 3)
    assert store.write(_predictions(spark, "a", d1, {"X": 1.0, "Y": 2.0}), "e1", 21, generated_at=datetime(2024, 1, 5)) == 2
    assert store.write(_predictions(spark, "a", d1, {"X": 5.0}), "e2", 21, generated_at=datetime(2024, 1, 6)) == 1
    assert store.write(_predictions(spark, "b", d2, {"X": 3.0}).withColumn("pred_lower", F.lit(0.5)), "e1", 5) == 1
    assert store.write(_predictions(spark, "b", d2, {}), "e1", 5) == 0
    assert store.table().columns == st.STORE_SCHEMA.fieldNames()
    row = store.table().where("model_id = 'a' and ticker = 'Y'").first()
    assert row["target_date"] == date(2024, 1, 23) and row["pred_lower"] is None and row["prediction_kind"] == "excess_return"
    newest = {(r["model_id"], r["ticker"]): r["prediction"] for r in st.newest_predictions(store.table()).collect()}
    assert newest == {("a", "X"): 5.0, ("a", "Y"): 2.0, ("b", "X"): 3.0}
    assert store.latest(["a"]).count() == 3 and store.latest(as_of="2024-01-02").count() == 3
    assert [r[0] for r in store.models().collect()] == ["a", "b"]
    assert store.query("SELECT count(*) AS n FROM predictions WHERE horizon_days = 21").first()["n"] == 3
    store.clear_experiment("e1")
    assert [r["experiment_id"] for r in store.table().collect()] == ["e2"]


class _Session:
    """Only what ``work_dir`` reads of a session."""

    def __init__(self, master, **conf):
        self.sparkContext = self
        self.conf = self
        self.master, self.applicationId, self._conf = master, "app", conf

    def get(self, key, default=None):
        return self._conf.get(key, default)


def test_work_dir_comes_from_the_session(spark):
    assert work_dir(_Session("yarn", **{"spark.checkpoint.dir": "hdfs://x/shared/"})) == "hdfs://x/shared/crosslane"
    with pytest.raises(RuntimeError):
        work_dir(_Session("yarn"))
    assert work_dir(spark) == work_dir(spark)
