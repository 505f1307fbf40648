"""What each filter of a chain removes by itself, after others, and on average over all orders.

Documents are counted once by part and failure flags. A CUBE over the flags then has, for every subset of the filters,
the documents that fail none of it; a step of an order is the difference of two subsets, so that no order ever reads
the documents again.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.spark import read, written

SPACE = r"[\x20\x09-\x0D]+"
#: A cube has 2 ** k subsets and a part k! orders.
MOST_FILTERS = 6


def quality_flags(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, A, B, C, D, E) of each document, true where it fails.

    A: under 50 words; B: under 65 % of the words are distinct; C: over 5 % capitals; D: one of ``#$%&*|``; E: another
    row with a smaller id has the same text, whichever filter that row fails. A null text is empty: it fails A, and E
    if an earlier text is empty too. A null part is "". Rows of equal id and text don't duplicate one another; a row
    without an id is never a duplicate, nor the first of others. Texts are compared by their SHA-256.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    split = base.select("id", "part", "text", F.sha2("text", 256).alias("digest"), F.array_remove(F.split("text", SPACE), "").alias("words"))
    n = F.col("n_words")
    counted = split.select("id", "part", "digest", F.size("words").alias("n_words"), F.size(F.array_distinct("words")).alias("n_distinct"), F.length("text").alias("n_chars"), F.length(F.regexp_replace("text", "[^A-Z]+", "")).alias("n_capitals"), F.col("text").rlike(r"[#$%&*|]").alias("D"))
    flagged = counted.select("id", "part", "digest", (n < 50).alias("A"), (100 * F.col("n_distinct") < 65 * n).alias("B"), (100 * F.col("n_capitals") > 5 * F.col("n_chars")).alias("C"), "D")
    # The first row of each text is known by id and digest: copies of one text, however many, are spread by their ids.
    first = base.where(F.col("id").isNotNull()).groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("id").alias("id")).withColumn("is_first", F.lit(True))
    return flagged.join(first, ["id", "digest"], "left").select("id", "part", "A", "B", "C", "D", (F.col("id").isNotNull() & F.col("is_first").isNull()).alias("E"))


def survivors(flagged: DataFrame, filters: str, marks: dict[str, str], part_col: str = "part") -> DataFrame:
    """(part, subset, n, a column for each mark): by subset of the filters, as bits, the rows that fail none of it.

    marks: names of counts and the boolean columns that they count; a null flag or mark is false. Subsets without
    survivors have no row, but the empty one has a row for each part.
    """
    flags = [F.coalesce(F.col(f), F.lit(False)).alias(f) for f in filters]
    counted = flagged.groupBy(F.col(part_col).alias("part"), *flags).agg(F.count("*").alias("n"), *[F.count_if(c).alias(m) for m, c in marks.items()])
    subset = " + ".join(f"(1 - grouping({f})) * {1 << i}" for i, f in enumerate(filters))
    sums = ", ".join(f"sum({m}) AS {m}" for m in ("n", *marks))
    cube = flagged.sparkSession.sql(f"SELECT part, {', '.join(filters)}, CAST({subset} AS INT) AS subset, {sums} FROM {{counted}} GROUP BY part, CUBE({', '.join(filters)})", counted=counted)
    # A flag that the grouping set leaves out is null there.
    none_fails = reduce(Column.__and__, [~F.coalesce(F.col(f), F.lit(False)) for f in filters])
    return cube.where(none_fails).select("part", "subset", "n", *marks)


def audit(flagged: DataFrame, filters: str = "ABCDE", marks: dict[str, str] | None = None, part_col: str = "part") -> DataFrame:
    """A row for each part, order of the filters and step, zeros included, with long counts within the part.

    kept, removed, redundant (fails the step's filter, but went earlier), unique_fails (fails that filter only),
    ``<mark>_lost`` (removed here with the mark) and shapley (what its filter removes, summed over all orders). Each
    filter is a boolean column named by one letter. A null part is a part of its own; a table without rows has no parts.
    """
    if not 0 < len(filters) <= MOST_FILTERS or len(set(filters)) != len(filters):
        raise ValueError(f"1 to {MOST_FILTERS} filters with different names are wanted")
    marks = marks or {}
    spark = flagged.sparkSession
    bit = {f: 1 << i for i, f in enumerate(filters)}
    whole = sum(bit.values())
    steps = []
    for order in map("".join, permutations(filters)):
        before = 0
        for k, f in enumerate(order):
            steps.append((len(steps), order, k + 1, f, before, before | bit[f], bit[f], whole - bit[f], whole))
            before |= bit[f]
    at = spark.createDataFrame(steps, "at int, filter_order string, step int, filter string, before int, after int, own int, others int, every int")
    left = written(survivors(flagged, filters, marks, part_col), "filter-subsets")
    out = left.where("subset = 0").select("part", F.col("n").alias("n_all"), F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))).alias("at")).join(F.broadcast(at), "at")
    for name in ("before", "after", "own", "others", "every"):
        sums = [F.col(m).alias(f"{m}_{name}") for m in ("n", *(marks if name in ("before", "after") else ()))]
        side = left.select(F.col("part").alias("_part"), F.col("subset").alias("_subset"), *sums)
        out = out.join(side, F.col("part").eqNullSafe(F.col("_part")) & (F.col(name) == F.col("_subset")), "left").drop("_part", "_subset")
    out = out.na.fill(0, [c for c in out.columns if c not in ("part", "filter_order", "filter")])
    lost = lambda m: F.col(f"{m}_before") - F.col(f"{m}_after")
    out = out.withColumn("removed", lost("n"))
    return out.select(
        "part", "filter_order", "step", F.col("n_after").alias("kept"), "removed",
        (F.col("n_all") - F.col("n_own") - F.col("removed")).alias("redundant"),
        (F.col("n_others") - F.col("n_every")).alias("unique_fails"),
        *[lost(m).alias(f"{m}_lost") for m in marks],
        F.sum("removed").over(Window.partitionBy("part", "filter")).alias("shapley"),
    )


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    flagged = quality_flags(read(spark, sf_dir, "documents"))
    labels = read(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return audit(flagged.join(labels, "id", "left"), "ABCDE", {"good": "good", "toxic": "toxic"})


_ORDERS = ", ".join(f"('{''.join(o)}')" for o in permutations("ABCDE"))

OP12_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END ||
    CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END ||
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l USING (doc_id)
), g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
o AS (SELECT o AS filter_order, s AS step, substr(o, s, 1) AS filter, substr(o, 1, s - 1) AS earlier FROM (VALUES {_ORDERS}) v(o), range(1, 6) r(s)),
x AS (SELECT *, translate(fails, earlier, '') = fails AS there, strpos(fails, filter) > 0 AS hit FROM g, o),
y AS (
  SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (there AND NOT hit), 0) AS kept, coalesce(sum(n) FILTER (there AND hit), 0) AS removed,
    coalesce(sum(n) FILTER (NOT there AND hit), 0) AS redundant, coalesce(sum(n) FILTER (fails = filter), 0) AS unique_fails,
    coalesce(sum(good) FILTER (there AND hit), 0) AS good_lost, coalesce(sum(toxic) FILTER (there AND hit), 0) AS toxic_lost
  FROM x GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INT) AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM y
"""
