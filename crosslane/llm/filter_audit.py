"""Filter interaction audit: which filters fail which documents together, and what each order of the filters removes.

An existential self-join finds texts that a smaller id already has (left semi on hash, exact text and smaller id). The ids of
all failures are united and their bits combined; everything about orders follows from the counts of the bit combinations.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosslane.llm.common import drop_path, scratch, table
from crosslane.session import broadcast_if

# Copies of one text that one task compares: more are dealt over further tasks.
COPIES_A_TASK = 512

TextTest = Callable[[Column], Column]


def word_list(text: Column) -> Column:
    """Maximal runs of characters that are neither blanks nor the control characters 0x09 to 0x0D."""
    return F.array_remove(F.split(text, r"[ \t-\r]+"), "")


def too_short(text: Column) -> Column:
    return F.size(word_list(text)) < 200


def repetitive(text: Column) -> Column:
    return F.size(F.array_distinct(word_list(text))) * 100 < F.size(word_list(text)) * 50


def shouting(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") * 100 > F.length(text).cast("long") * 3


def symbols(text: Column) -> Column:
    return text.rlike(r"[#$%&*|]")


# Bit 0 on: the filters of single texts, in natural order. The repeat filter takes the bit after them.
TEXT_TESTS: dict[str, TextTest] = {"A": too_short, "B": repetitive, "C": shouting, "D": symbols}
REPEAT = "E"


def _shift(bit: int) -> Column:
    return F.lit(1 << bit)


def text_failures(docs: DataFrame, tests: dict[str, TextTest], key: str, text: str, part: str) -> DataFrame:
    """(id, part, h1, h2, bits) per row: which tests the text fails, and two hashes that route equal texts together."""
    raw = docs.select(
        F.col(f"`{key}`").alias("id"),
        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"),
    )
    bits = [F.when(test(F.col("body")), _shift(n)).otherwise(F.lit(0)) for n, test in enumerate(tests.values())]
    return raw.select("id", "part", *text_hashes("body"), reduce(lambda a, b: a + b, bits, F.lit(0)).alias("bits"))


def text_hashes(column: str) -> list[Column]:
    return [F.xxhash64(column).alias("h1"), F.xxhash64(F.lit(1), column).alias("h2")]


def repeats(docs: DataFrame, failures: DataFrame, key: str, text: str, part: str) -> tuple[DataFrame, list[str]]:
    """(id, part, h1, h2) of the rows whose exact text a smaller id has; and the scratch tables behind it.

    Hash counts leave only texts that can have a copy; only those are read again, and only those are shuffled. Of each of
    them one row, with its smallest id, is the right side of the semi join: a smaller id exists where that one is smaller. A
    text with many copies is dealt over as many salts as its count asks for.
    """
    found = (
        failures.where(F.col("id").isNotNull())
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("low"), F.max("id").alias("high"))
        .where("low < high")
        .select("h1", "h2", F.ceil(F.col("copies") / COPIES_A_TASK).cast("int").alias("salts"))
    )
    found, found_path = scratch(found, "audit-hashes")
    bodies = docs.select(
        F.col(f"`{key}`").alias("id"),
        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"),
    ).where(F.col("id").isNotNull())
    suspects = bodies.select("*", *text_hashes("body")).join(broadcast_if(found, found.count()), ["h1", "h2"])
    suspects, suspects_path = scratch(suspects, "audit-copies")
    first = suspects.groupBy("h1", "h2", "body").agg(F.min("id").alias("first_id"), F.max("salts").alias("salts"))
    right = first.select("h1", "h2", "body", "first_id", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    left = suspects.withColumn("salt", F.pmod(F.xxhash64("id", "part"), F.col("salts")).cast("int"))
    same = [left[c] == right[c] for c in ("h1", "h2", "salt", "body")]
    later = left.join(right, [*same, right["first_id"] < left["id"]], "left_semi")
    return later.select("id", "part", "h1", "h2"), [found_path, suspects_path]


def combinations(
    docs: DataFrame,
    labels: DataFrame,
    tests: dict[str, TextTest] | None = None,
    key: str = "doc_id",
    text: str = "text",
    part: str = "lang",
    good: str = "quality",
    toxic: str = "toxic",
) -> DataFrame:
    """(part, bits, n, n_good, n_toxic): documents of each part by the set of filters that they fail.

    Null texts are empty; a null part is the empty string. A null id has no smaller id and makes none. A repeated id counts
    once a row; its rows are repeats of each other only through a smaller id. An id with several labels counts as good
    (toxic) if any of them says 1; null labels say nothing. Ids are united and their bits combined by aggregation, once more
    per id before the labels are joined, so an id on many rows is one row there. Only the named columns are read. An empty
    table gives no rows.
    """
    tests = TEXT_TESTS if tests is None else tests
    failures, path = scratch(text_failures(docs, tests, key, text, part), "audit-failures")
    later, paths = repeats(docs, failures, key, text, part)
    ids = failures.withColumn("n", F.lit(1).cast("long")).unionByName(
        later.withColumns({"bits": _shift(len(tests)), "n": F.lit(0).cast("long")})
    )
    rows = ids.groupBy("id", "part", "h1", "h2").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    by_id = rows.groupBy("id", "part", "bits").agg(F.sum("n").alias("n"))
    marks = (
        labels.select(F.col(f"`{key}`").alias("id"), F.col(f"`{good}`").alias("good"), F.col(f"`{toxic}`").alias("toxic"))
        .where(F.col("id").isNotNull() & ((F.col("good") == 1) | (F.col("toxic") == 1)))
        .groupBy("id")
        .agg(*[F.max(F.coalesce((F.col(c) == 1).cast("long"), F.lit(0))).alias(c) for c in ("good", "toxic")])
    )
    counted = by_id.join(marks, "id", "left")
    out = counted.groupBy("part", "bits").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("good") == 1, F.col("n")).otherwise(0)).alias("n_good"),
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("n_toxic"),
    )
    out, _ = scratch(out, "audit-combinations")
    for done in (path, *paths):
        drop_path(docs.sparkSession, done)
    return out


def order_effects(counted: DataFrame, names: str) -> DataFrame:
    """One row per part, order of the filters and step: what the filter of that step removes after those before it.

    ``names`` has one letter per bit of ``bits``. A row of ``counted`` adds to each of the orders by itself; sums follow.
    """
    orders = ["".join(p) for p in permutations(names)]
    steps = F.sequence(F.lit(1), F.lit(len(names)))

    def bit_at(place: Column) -> Column:
        letter = F.substring(F.col("filter_order"), place, F.lit(1))
        return F.call_function("shiftleft", F.lit(1), F.instr(F.lit(names), letter) - 1)

    placed = counted.select(
        "*", F.explode(F.array(*[F.lit(o) for o in orders])).alias("filter_order")
    ).select("*", F.explode(steps).alias("step"))
    earlier = F.aggregate(
        F.transform(F.filter(steps, lambda i: i < F.col("step")), bit_at), F.lit(0), lambda a, b: a.bitwiseOR(b)
    )
    placed = placed.withColumns({"own": bit_at(F.col("step")), "before": earlier})
    fails = F.col("bits").bitwiseAND(F.col("own")) != 0
    passed = F.col("bits").bitwiseAND(F.col("before")) == 0

    def total(amount: str | Column, *conditions: Column) -> Column:
        amount = F.col(amount) if isinstance(amount, str) else amount
        return F.sum(F.when(reduce(lambda a, b: a & b, conditions), amount).otherwise(F.lit(0))).cast("long")

    # Of the filters that a document fails, each is the first one in an equal number of orders.
    each = F.lit(math.factorial(len(names))) / F.greatest(F.bit_count("bits"), F.lit(1))
    return placed.groupBy("part", "filter_order", "step").agg(
        total("n", passed, ~fails).alias("kept"),
        total("n", passed, fails).alias("removed"),
        total("n", ~passed, fails).alias("redundant"),
        total("n", F.col("bits") == F.col("own")).alias("unique_fails"),
        total("n_good", passed, fails).alias("good_lost"),
        total("n_toxic", passed, fails).alias("toxic_lost"),
        total(F.col("n") * each.cast("long"), fails).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, tests: dict[str, TextTest] | None = None, **columns: str) -> DataFrame:
    """The effects of every order of the text tests and the repeat filter, per part; see ``combinations``."""
    tests = TEXT_TESTS if tests is None else tests
    names = "".join(tests) + REPEAT
    if len(set(names)) != len(tests) + 1:
        raise ValueError("filters need different names of one letter")
    return order_effects(combinations(docs, labels, tests, **columns), names)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 120 orders of the five filters over whole ``documents``, per language."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
f AS (
  SELECT doc_id, part,
    (CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS bits FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels GROUP BY doc_id),
m AS (SELECT part, bits, count(*) AS n, sum(coalesce(good, 0)) AS g, sum(coalesce(bad, 0)) AS x
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, bits),
c AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(c, b)),
o AS (
  SELECT c1.c || c2.c || c3.c || c4.c || c5.c AS filter_order, [c1.b, c2.b, c3.b, c4.b, c5.b] AS bs
  FROM c AS c1, c AS c2, c AS c3, c AS c4, c AS c5 WHERE c1.b + c2.b + c3.b + c4.b + c5.b = 31
    AND (c1.b | c2.b | c3.b | c4.b | c5.b) = 31),
s AS (SELECT filter_order, step, bs[step] AS own, list_sum(list_concat([0], bs[1:step - 1]))::INT AS before
  FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN bits & (before | own) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN bits & before = 0 AND bits & own <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN bits & before <> 0 AND bits & own <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN bits = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN bits & before = 0 AND bits & own <> 0 THEN g ELSE 0 END) AS good_lost,
    sum(CASE WHEN bits & before = 0 AND bits & own <> 0 THEN x ELSE 0 END) AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, own),
h AS (SELECT part, own, sum(removed) AS shapley FROM r GROUP BY part, own)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  shapley::BIGINT AS shapley
FROM r JOIN h USING (part, own)
"""
