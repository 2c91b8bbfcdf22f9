import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from crosslane.session import build_session  # noqa: E402
from crosslane.sources.factors import FACTORS  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]",
        "tests",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def small_tasks(spark):
    """Groups of more than 20 rows count as too large for one task."""
    spark.conf.set("crosslane.taskRows", "20")
    yield 20
    spark.conf.unset("crosslane.taskRows")


def noise(seed, *columns):
    """A uniform number in [0, 1) keyed by columns: the same on every run."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1000003)) / F.lit(1000003.0)


def make_panel(spark, tickers=6, days=900, seed=42):
    """Synthetic bars: a random walk per ticker, two tickers per sector."""
    from pyspark.sql import Window

    base = spark.range(tickers * days).select(
        F.concat(F.lit("T"), F.lpad(F.floor(F.col("id") / days).cast("string"), 2, "0")).alias("ticker"),
        (F.col("id") % days).cast("int").alias("i"),
    )
    w = Window.partitionBy("ticker").orderBy("i")
    steps = base.withColumn("step", (noise(seed, "ticker", "i") - 0.5) * 0.04)
    price = F.exp(F.sum("step").over(w)) * 100.0
    out = steps.withColumn("close", price).select(
        F.date_add(F.lit("2020-01-02").cast("date"), F.col("i")).alias("date"),
        "ticker",
        (F.col("close") * (0.99 + 0.02 * noise(seed + 1, "ticker", "i"))).alias("open"),
        (F.col("close") * 1.005 * (1 + 0.01 * noise(seed + 2, "ticker", "i"))).alias("high"),
        (F.col("close") * 0.985).alias("low"),
        "close",
        (F.col("close") * (0.9 + 0.1 * F.col("i") / days)).alias("adj_close"),
        (1000 + 5000 * noise(seed + 3, "ticker", "i")).cast("long").alias("volume"),
    )
    sector = F.element_at(F.array(F.lit("Tech"), F.lit("Health"), F.lit("Energy")), (F.substring("ticker", 2, 2).cast("int") % 3 + 1))
    return out.withColumn("sector", sector)


def make_factors(spark, panel, seed=11):
    days = panel.select("date").distinct()
    columns = [((noise(seed + k, "date") - 0.5) * 0.02).alias(f) for k, f in enumerate(FACTORS)]
    return days.select("date", *columns, F.lit(0.0001).alias("RF"))


def make_scores(spark, dates=60, tickers=30, strength=1.0, seed=7, model="m"):
    """Evaluation frame: realized = strength * prediction + noise."""
    base = spark.range(dates * tickers).select(
        F.date_add(F.lit("2022-01-03").cast("date"), F.floor(F.col("id") / tickers).cast("int")).alias("date"),
        F.concat(F.lit("T"), F.lpad((F.col("id") % tickers).cast("string"), 2, "0")).alias("ticker"),
    )
    p = noise(seed, "date", "ticker") - 0.5
    return base.withColumn("prediction", p).select(
        F.lit(model).alias("model_id"),
        "date",
        "ticker",
        "prediction",
        (F.col("prediction") * strength + (noise(seed + 1, "date", "ticker") - 0.5)).alias("realized"),
    )


@pytest.fixture(scope="session")
def panel(spark):
    return make_panel(spark).cache()


@pytest.fixture(scope="session")
def factors(spark, panel):
    return make_factors(spark, panel).cache()
