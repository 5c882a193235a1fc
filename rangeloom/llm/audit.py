"""How filters act on each other: duplicates by partition refinement, then counts by failure mask for every order."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeloom.llm._text import documents
from rangeloom.llm.bitmap import likely
from rangeloom.shared import stored

#: The filters; filter i fails where bit i of a document's mask is set.
LETTERS = "ABCDE"
DUPLICATE = 1 << LETTERS.index("E")
#: Code points of the first block; each later block is twice as long as the one before.
BLOCK = 64
_WHITE = r"[\x20\x09-\x0D]+"
_CLASS = ["length", "hash"]


def _cut(h: Column, bits: int) -> Column:
    return h if bits == 64 else F.pmod(h, F.lit(1 << bits).cast("long"))


def _blocks(text: Column, length: Column) -> Column:
    """Hashes of a text's successive blocks of 64, 128, 256... code points; none of an empty text."""
    count = F.ceil(F.log2(length / float(BLOCK) + 1)).cast("int")
    twice = lambda i: F.lit(BLOCK) * F.pow(F.lit(2), i).cast("int")
    one = lambda i: F.xxhash64(F.substring(text, twice(i) - (BLOCK - 1), twice(i)))
    return F.when(length > 0, F.transform(F.sequence(F.lit(0), count - 1), one)).otherwise(F.array().cast("array<bigint>"))


def _texts(docs: DataFrame, id_col: str, text_col: str, part_col: str, bits: int) -> DataFrame:
    """``doc_id, part, text, length, blocks, hash``; a class is a length and the running hash of all blocks, of ``bits`` bits."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("length", F.length("text")).withColumn("blocks", _blocks(F.col("text"), F.col("length")))
    return rows.withColumn("hash", F.aggregate("blocks", F.lit(0).cast("long"), lambda h, b: _cut(F.xxhash64(h, b), bits)))


def _masked(texts: DataFrame) -> DataFrame:
    """``texts`` with ``mask``, the bits of the filters A to D.

    A: under 200 words; B: fewer than half of the words are distinct; C: over 2 % of the code points are A-Z; D: any of ``#$%&*|``.
    """
    rows = texts.withColumn("words", F.array_remove(F.split("text", _WHITE), ""))
    n = F.size("words")
    fails = [n < 200, 100 * F.size(F.array_distinct("words")) < 50 * n, 100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long") > 2 * F.col("length"), F.col("text").rlike(r"[#$%&*|]")]
    return rows.withColumn("mask", sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))).drop("words")


def refined(rows: DataFrame, bits: int = 64) -> DataFrame:
    """``length, hash, first`` of the classes of at least two rows that length and block hashes cannot tell apart.

    ``rows`` (``doc_id, length, blocks``) are split by length, and every class by the hash of its next block, until its
    texts have no further block; rows alone in their class leave at every step. Equal texts are never apart; a class may
    hold different texts whose hashes collide. Each step writes the rows that are left; classes are counted by partial
    sums, and a class that many rows share is joined from its own side, a row for each class.
    """
    found, level = None, 0
    alive = rows.select("doc_id", "length", "blocks", F.lit(0).cast("long").alias("hash"))
    while True:
        counts = stored(alive.groupBy(*_CLASS).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.max(F.size("blocks")).alias("blocks")).where("n > 1"), "audit-classes")
        ended = counts.where(F.col("blocks") <= level).select(*_CLASS, "first")
        found = ended if found is None else found.unionByName(ended)
        going = counts.where(F.col("blocks") > level).select(*_CLASS)
        if going.isEmpty():
            return found
        left = alive.join(going, _CLASS, "left_semi")
        alive = stored(left.withColumn("hash", _cut(F.xxhash64("hash", F.get("blocks", F.lit(level))), bits)), "audit-alive")
        level += 1


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", bits: int = 64) -> DataFrame:
    """``doc_id, part, mask`` of every row; bit E is set where a smaller doc_id has the same text.

    Classes that the refinement leaves are compared on their full texts: grouped by class and text, a text leaves a task
    once however many rows there have it. A class of one text is marked by its smallest id; in one of several texts the texts
    are joined themselves. Texts of other classes stay out of the exchange but for a few, see
    :func:`rangeloom.llm.bitmap.likely`. A null doc_id comes after all others; rows of one doc_id do not mark each other.
    """
    texts = _texts(docs, id_col, text_col, part_col, bits)
    rows = stored(_masked(texts).drop("text"), "audit-rows")
    classes = stored(refined(rows, bits), "audit-refined")
    near = likely(texts.select("doc_id", "text", *_CLASS), classes, _CLASS)
    distinct = near.groupBy(*_CLASS, "text").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    compared = stored(distinct.groupBy(*_CLASS).agg(F.count(F.lit(1)).alias("texts"), F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1"), "audit-compared")
    late = F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")))
    mark = lambda x: x.select("doc_id", "part", F.when(late, F.col("mask").bitwiseOR(F.lit(DUPLICATE))).otherwise(F.col("mask")).alias("mask"))
    mixed = compared.where("texts > 1").select(*_CLASS)
    if mixed.isEmpty():
        return mark(rows.join(compared, _CLASS, "left"))
    several = _masked(texts).join(mixed, _CLASS, "left_semi")
    firsts = several.groupBy(*_CLASS, "text").agg(F.min("doc_id").alias("first"))
    return mark(rows.join(mixed, _CLASS, "left_anti").join(compared, _CLASS, "left")).unionByName(mark(several.join(firsts, [*_CLASS, "text"])))


def _by_mask(count: str) -> Column:
    """A count of each of the 32 masks, 0 where a part has none."""
    return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda m: F.coalesce(F.try_element_at("cells", m)[count], F.lit(0).cast("long")))


def _by_set(counts: str) -> Column:
    """For each of the 32 sets of filters, the rows that fail none of them."""
    over = lambda s: F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), lambda acc, m: acc + F.when(m.bitwiseAND(s) == 0, F.get(counts, m)).otherwise(0))
    return F.transform(F.sequence(F.lit(0), F.lit(31)), over)


def interactions(marked: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter does at each place of each order: a row for each part, order of ABCDE and step.

    ``marked`` (``doc_id, part, mask``) meets ``labels`` (``doc_id, quality, toxic``; several of one id count once) and is
    counted by part and mask, 32 numbers a part; all 120 orders follow from those without reading a document again.
    """
    known = labels.groupBy(labels["doc_id"].cast("long").alias("__id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("bad"))
    joined = marked.select("doc_id", "part", "mask").join(known, F.col("doc_id") == F.col("__id"), "left")
    cells = joined.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    parts = cells.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "bad")))).alias("cells"))
    kinds = ("n", "good", "bad")
    parts = parts.select("part", *(_by_mask(c).alias(c) for c in kinds))
    parts = parts.select("part", "n", *(_by_set(c).alias(f"left_{c}") for c in kinds))
    orders = F.split(F.lit(" ".join("".join(p) for p in permutations(LETTERS))), " ")
    lines = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))
    bits = {x: 1 << i for i, x in enumerate(LETTERS)}
    own = sum((F.when(F.substring(F.col("filter_order"), F.col("step"), F.lit(1)) == x, b).otherwise(0) for x, b in bits.items()), F.lit(0))
    before = sum((F.when(F.instr("filter_order", x) < F.col("step"), b).otherwise(0) for x, b in bits.items()), F.lit(0))
    lines = lines.withColumn("own", own).withColumn("before", before).withColumn("after", F.col("own").bitwiseOR(F.col("before")))
    gone = lambda c: F.get(f"left_{c}", F.col("before")) - F.get(f"left_{c}", F.col("after"))
    weights = F.array(*(F.lit(factorial(k) * factorial(4 - k)).cast("long") for k in range(5)))
    gain = lambda s: F.get(weights, F.bit_count(s)) * (F.get("left_n", s) - F.get("left_n", s.bitwiseOR(F.col("own"))))
    shapley = F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), lambda acc, s: acc + F.when(s.bitwiseAND(F.col("own")) == 0, gain(s)).otherwise(0))
    return lines.select(
        "part", "filter_order", "step",
        F.get("left_n", F.col("after")).alias("kept"), gone("n").alias("removed"), (F.get("left_n", F.lit(0)) - F.get("left_n", F.col("own")) - gone("n")).alias("redundant"),
        F.get("n", F.col("own")).alias("unique_fails"), gone("good").alias("good_lost"), gone("bad").alias("toxic_lost"), shapley.alias("shapley"),
    )


def audited(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    Null texts count as empty, a null part as the empty string; repeated rows all count; an empty table gives no part and so no row. Other
    columns are not read.
    """
    return interactions(failures(docs, id_col, text_col, part_col), labels)


def op11_refined_audit(spark, sf_dir: str) -> DataFrame:
    return audited(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
f AS (
  SELECT doc_id, part,
    CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY 1),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(bad, 0)) AS bad FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (
  SELECT o, step, 1 << CAST(ascii(o[step]) - 65 AS INTEGER) AS own, list_sum(list_transform(range(1, step), lambda i: 1 << CAST(ascii(o[i]) - 65 AS INTEGER))) AS b
  FROM (SELECT o, unnest(range(1, 6)) AS step FROM o)),
r AS (
  SELECT c.part, s.o AS filter_order, CAST(s.step AS INTEGER) AS step, s.own,
    coalesce(sum(n) FILTER (WHERE mask & (own | coalesce(b, 0)) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (WHERE mask & own <> 0 AND mask & coalesce(b, 0) = 0), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE mask & own <> 0 AND mask & coalesce(b, 0) <> 0), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE mask = own), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE mask & own <> 0 AND mask & coalesce(b, 0) = 0), 0) AS good_lost,
    coalesce(sum(bad) FILTER (WHERE mask & own <> 0 AND mask & coalesce(b, 0) = 0), 0) AS toxic_lost
  FROM c, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""
