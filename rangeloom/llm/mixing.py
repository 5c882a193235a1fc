"""Mixing sources to target weights by packed blocks; DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangeloom.llm._text import documents
from rangeloom.shared import stored

@dataclass(frozen=True)
class MixSpec:
    """``weights`` repeat over the sources in order; no source is taken more than ``max_epochs`` times.

    ``block``: words of a packed block; ``shard_slots``: slots of an output shard; ``chunk_rows``: rows of a
    source's chunk, the unit of the prefix sums; ``seed`` draws the shards and the block permutations, which have
    ``rounds`` rounds.
    """

    weights: tuple[int, ...] = (5, 2, 1)
    max_epochs: int = 3
    block: int = 512
    shard_slots: int = 2048
    chunk_rows: int = 100_000
    seed: int = 0
    rounds: int = 24


def word_count(text: Column) -> Column:
    """Maximal runs of ``[^\\x20\\x09-\\x0D]``; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _hex(digits: int, *of: Column) -> Column:
    return F.substring(F.md5(F.concat_ws(":", *(c.cast("string") for c in of)).cast("binary")), 1, digits)


def hashed(digits: int, *of: Column) -> Column:
    """The first ``digits`` (at most 15) hex digits of the MD5 of the values, as a number."""
    return F.conv(_hex(digits, *of), 16, 10).cast("long")


def permuted(i: Column, n: Column, key: Column, rounds: int) -> Column:
    """``i`` of 0..n-1 to another index, one to one, by a swap-or-not shuffle.

    In each round an index and its mirror image ``(k - i) mod n`` change places or don't, by a hashed bit that both agree
    on, so each round is a permutation of any ``n``; ``k`` and the bits follow from ``key`` and the round.
    """

    def swap(x: Column, r: Column) -> Column:
        mirror = F.pmod(hashed(12, key, r, F.lit("k")) - x, n)
        return F.when(_hex(1, key, r, F.greatest(x, mirror)) >= "8", mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), i, swap)


def targets(sizes: DataFrame, spec: MixSpec = MixSpec()) -> DataFrame:
    """A row per source: rank, size, target and the numbers of its blocks and slots.

    ``sizes`` has ``source, size``. Shares follow the weights, at most ``max_epochs`` times a source's size; what
    is cut goes to the others by weight until none is above. That settles at ``min(cap, level * weight)`` for
    one level; with the sources by ``cap / weight``, the level is the largest of (total - caps before) /
    (weights from here on). One row per source, so the windows without partition are small.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weights = F.array(*map(F.lit, spec.weights))
    ranked = (
        by_source.withColumn("source_no", F.row_number().over(order).cast("long") - 1)
        .withColumn("weight", F.get(weights, (F.col("source_no") % len(spec.weights)).cast("int")).cast("long"))
        .withColumn("cap", spec.max_epochs * F.col("source_size"))
    )
    every, by_cap = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("weight"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    w = (
        ranked.withColumn("total", F.sum("source_size").over(every))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(by_cap), F.lit(0)))
        .withColumn("weights_from", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_cap), F.lit(0)))
        .withColumn("level", F.max((F.col("total") - F.col("caps_before")) / F.col("weights_from")).over(every))
        .withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
    )
    words, size = F.floor(F.col("target") + 0.5), F.col("source_size")
    w = w.withColumn("words", F.least(words, F.col("cap"))).withColumn("n_blocks", F.ceil(size / F.lit(spec.block)))
    w = w.withColumn("epochs", F.when(size > 0, F.expr("words div source_size")).otherwise(F.lit(0).cast("long")))
    w = w.withColumn("rest", F.col("words") - F.col("epochs") * size)
    w = w.withColumn("rest_slots", F.ceil(F.col("rest") / F.lit(spec.block)))
    w = w.withColumn("n_slots", F.col("epochs") * F.col("n_blocks") + F.col("rest_slots"))
    before = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    return w.select(
        "source", "source_no", "weight", "source_size", "target", "words", "n_blocks", "epochs", "rest", "rest_slots", "n_slots",
        F.coalesce(F.sum("n_slots").over(before), F.lit(0)).alias("slots_before"),
        F.sum("n_slots").over(every).alias("all_slots"),
    )


def drawn(sources: DataFrame, spec: MixSpec = MixSpec()) -> DataFrame:
    """``shard, source_no, n``: how many slots of each output shard a source gets.

    All slots of the mix, each source's number of them, are put in a random order by a hash of seed, source and slot,
    and dealt to shards of ``shard_slots``: a multinomial draw under the condition that the sources' totals are
    met. Slots are made in runs of 4096, so no task makes all slots of a hot source, and are ranked in groups by hash,
    moved up by the counts of the groups before, so no window holds all slots.
    """
    run = 4096
    runs = sources.where("n_slots > 0").withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_slots - 1) div {run}"))))
    s = runs.repartition("source_no", "run").withColumn("slot", F.explode(F.sequence(F.col("run") * run, F.least(F.col("run") * run + (run - 1), F.col("n_slots") - 1))))
    groups = F.greatest(F.lit(1024).cast("long"), F.expr(f"all_slots div {spec.chunk_rows}"))
    s = s.select("source_no", "slot", hashed(15, F.lit(spec.seed), F.col("source_no"), F.col("slot")).alias("draw"), groups.alias("groups"))
    s = s.withColumn("group", F.col("draw") % F.col("groups"))
    totals = s.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    # One row per group of 100,000 slots of 512 words.
    starts = totals.select("group", F.coalesce(F.sum("n").over(ahead), F.lit(0).cast("long")).alias("group_at"))
    rank = F.row_number().over(Window.partitionBy("group").orderBy("draw", "source_no", "slot")).cast("long") - 1
    ranked = s.withColumn("rank", rank).join(starts.hint("merge"), "group").withColumn("place", F.col("group_at") + F.col("rank"))
    return ranked.groupBy(F.expr(f"place div {spec.shard_slots}").alias("shard"), "source_no").agg(F.count(F.lit(1)).alias("n"))


def slots(sources: DataFrame, spec: MixSpec = MixSpec()) -> DataFrame:
    """Every slot of the mix: ``source_no, slot, epoch, block, slot_words, shard, shard_slot``.

    A source's slots go on from shard to shard by the counts that were drawn, through whole epochs of its blocks and
    then through part of one. Each epoch visits the blocks by a pseudorandom permutation of its own; the short last block
    comes last, and the last slot is cut to the words that are left, so the words taken are the target's. Within a
    shard the slots are in a hashed order.
    """
    counts = stored(drawn(sources, spec), "mix-shards")
    # Slots before a shard: first within 4096 shards, then those before them.
    part = F.expr("shard div 4096").alias("part")
    ahead = Window.partitionBy("source_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy("source_no", part).agg(F.sum("n").alias("m")).select("source_no", "part", F.coalesce(F.sum("m").over(ahead), F.lit(0).cast("long")).alias("part_at"))
    within = Window.partitionBy("source_no", "part").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    at = counts.select("*", part).withColumn("first", F.sum("n").over(within) - F.col("n")).join(parts, ["source_no", "part"])
    # So many tasks at any size of the counts: each of their rows becomes up to a shard's slots.
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = at.select("source_no", "shard", "n", (F.col("part_at") + F.col("first")).alias("first")).repartition(tasks, "source_no", "shard")
    s = at.withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
    s = s.select("source_no", "shard", "slot").join(sources.select("source_no", "n_blocks", "source_size", "rest_slots", "n_slots", "rest"), "source_no")
    i, full = F.col("slot") % F.col("n_blocks"), F.col("n_blocks") - 1
    s = s.withColumn("epoch", F.expr("slot div n_blocks"))
    key = F.concat_ws(":", F.lit(str(spec.seed)), F.col("source_no").cast("string"), F.col("epoch").cast("string"))
    s = s.withColumn("block", F.when(i < full, permuted(i, F.greatest(full, F.lit(1).cast("long")), key, spec.rounds)).otherwise(full))
    length = F.when(F.col("block") < full, F.lit(spec.block)).otherwise(F.col("source_size") - full * spec.block)
    last = (F.col("rest_slots") > 0) & (F.col("slot") == F.col("n_slots") - 1)
    s = s.withColumn("slot_words", F.when(last, F.col("rest") - (F.col("rest_slots") - 1) * spec.block).otherwise(length).cast("long"))
    order = Window.partitionBy("shard").orderBy(hashed(15, F.lit(spec.seed), F.col("shard"), F.col("source_no"), F.col("slot")), "source_no", "slot")
    s = s.withColumn("shard_slot", F.row_number().over(order).cast("long") - 1)
    return s.select("source_no", "slot", "epoch", "block", "slot_words", "shard", "shard_slot")


def packed(sizes: DataFrame, sources: DataFrame, spec: MixSpec = MixSpec()) -> DataFrame:
    """``sizes`` (``doc_id, source, size``) with each row's place in its source: ``source_no, source_size, target, chunk, rn, at``.

    The running word count of a source is made in two steps, so no window holds a source: within chunks of
    about ``chunk_rows`` rows (by a hash of doc_id and size), then over the chunks' totals.
    """
    own = sources.select(F.col("source").alias("__source"), "source_no", "source_size", "target")
    rows = sizes.join(own, sizes["source"].eqNullSafe(own["__source"])).drop("__source")
    chunks = max(256, -(-sizes.count() // spec.chunk_rows))
    rows = rows.withColumn("chunk", hashed(12, F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size")) % F.lit(chunks).cast("long"))
    tag = [c for c in sizes.columns if c == "tag"]
    order = Window.partitionBy("source_no", "chunk").orderBy("doc_id", "size", *tag)
    rows = rows.withColumn("rn", F.row_number().over(order)).withColumn("before", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    totals = rows.groupBy("source_no", "chunk").agg(F.sum("size").alias("chunk_size"))
    ahead = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("source_no", "chunk", F.coalesce(F.sum("chunk_size").over(ahead), F.lit(0).cast("long")).alias("chunk_at"))
    return rows.join(starts, ["source_no", "chunk"]).select("doc_id", *tag, "source_no", "size", "source_size", "target", "chunk", "rn", (F.col("chunk_at") + F.col("before")).alias("at"))


def mix(sizes: DataFrame, spec: MixSpec = MixSpec()) -> tuple[DataFrame, DataFrame]:
    """``(rows, pieces)`` of a mix of ``sizes`` (``doc_id, source, size`` and, to tell rows of one doc_id apart, a ``tag``).

    ``rows``: :func:`packed`. ``pieces``: what each slot takes of each document: ``doc_id, source_no, chunk, rn,
    epoch, shard, shard_slot, word_start, n_words``, one row per slot and document with words in it; joined by
    source and block index, where a block has at most ``block`` documents and ``max_epochs + 1`` slots.
    """
    sizes = stored(sizes, "mix-sizes")
    tag = [c for c in sizes.columns if c == "tag"]
    sources = stored(targets(sizes, spec), "mix-sources")
    rows = stored(packed(sizes, sources, spec), "mix-rows")
    spans = rows.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"at div {spec.block}"), F.expr(f"(at + size - 1) div {spec.block}"))))
    first = F.greatest(F.col("block") * spec.block, F.col("at"))
    end = F.least((F.col("block") + 1) * spec.block, F.col("at") + F.col("size"))
    spans = spans.select("doc_id", *tag, "source_no", "chunk", "rn", "block", (first - F.col("at")).alias("word_start"), (first - F.col("block") * spec.block).alias("from"), (end - F.col("block") * spec.block).alias("to"))
    pieces = spans.join(slots(sources, spec).hint("merge"), ["source_no", "block"]).withColumn("n_words", F.least("to", "slot_words") - F.col("from")).where("n_words > 0")
    return rows, pieces.select("doc_id", *tag, "source_no", "chunk", "rn", "epoch", "shard", "shard_slot", "word_start", "n_words")


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", spec: MixSpec = MixSpec()) -> DataFrame:
    """Words that the mix takes of every row: ``doc_id, size, source_size, target, taken``.

    Null texts have size 0; a null source is a source of its own, ranked last; sources without words have target
    0; an empty table gives an empty one. Repeated rows are rows of their own. Other columns are not read.
    """
    rows, pieces = mix(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"), word_count(docs[text_col].cast("string")).alias("size")), spec)
    key = ["source_no", "chunk", "rn"]
    some = pieces.select(*key, "n_words")
    every = rows.select(*key, "doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("n_words"))
    both = every.unionByName(some, allowMissingColumns=True)
    out = both.groupBy(*key).agg(*(F.max(c).alias(c) for c in ("doc_id", "size", "source_size", "target")), F.sum("n_words").alias("taken"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, spec: MixSpec = MixSpec(), draw: str | None = None) -> DataFrame:
    """The mix as documents: for each document and epoch a row of its columns with the words taken then.

    A document that an epoch takes whole keeps its text; else the taken words are joined by one space. ``n_chars``
    is set to the new text's code points. Rows that repeat a doc_id, source and text count once; documents
    without words are in no block and so in no mix. ``docs`` has ``doc_id, text, source, n_chars``, others stay.
    ``draw`` names one more column, what was drawn for the row's first words: ``epoch, shard, slot``.
    """
    marked = docs.withColumn("__size", word_count(F.col("text"))).withColumn("__tag", F.xxhash64("text", "source"))
    key = [F.col("doc_id").cast("long").alias("doc_id"), F.col("__tag").alias("tag")]
    same = lambda s: marked["doc_id"].cast("long").eqNullSafe(s["__id"]) & (marked["__tag"] == s["tag"])
    named = lambda df: df.withColumnRenamed("doc_id", "__id")
    sizes = stored(marked.select(*key, "source", F.col("__size").alias("size")), "mix-words")
    again = named(stored(sizes.groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), "mix-repeated"))
    if not again.isEmpty():
        sizes = sizes.dropDuplicates(["doc_id", "tag"])
        repeated = marked.join(again, same(again), "left_semi").dropDuplicates(["doc_id", "__tag"])
        marked = marked.join(again, same(again), "left_anti").unionByName(repeated)
    _, pieces = mix(sizes, spec)
    spans = pieces.groupBy("doc_id", "tag", "epoch").agg(F.sum("n_words").alias("__taken"), F.array_sort(F.collect_list(F.struct("word_start", "n_words"))).alias("__spans"), F.min_by(F.struct("epoch", "shard", F.col("shard_slot").alias("slot")), "word_start").alias("__draw"))
    spans = spans.select(F.col("doc_id").alias("__id"), F.col("tag").alias("__of"), "__taken", "__spans", "__draw")
    joined = marked.join(spans, marked["doc_id"].cast("long").eqNullSafe(spans["__id"]) & (marked["__tag"] == spans["__of"]))
    words = F.split(F.regexp_replace(F.regexp_replace("text", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+", " "), " ")
    part = F.transform("__spans", lambda s: F.array_join(F.slice(F.col("__words"), s["word_start"].cast("int") + 1, s["n_words"].cast("int")), " "))
    text = F.when(F.col("__taken") == F.col("__size"), F.col("text")).otherwise(F.array_join(part, " "))
    out = joined.withColumn("__words", F.when(F.col("__taken") < F.col("__size"), words)).withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns, *([F.col("__draw").alias(draw)] if draw else []))


def op8_block_mix(spark, sf_dir: str) -> DataFrame:
    return taken(documents(spark, sf_dir))


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
r AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS source_no FROM d GROUP BY source),
c AS (
  SELECT *, [5, 2, 1][source_no % 3 + 1] AS weight, 3 * source_size AS cap FROM r),
l AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT)
              - coalesce(CAST(sum(cap) OVER (ORDER BY cap / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS free,
         sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights_from
  FROM c),
t AS (
  SELECT *, least(CAST(cap AS DOUBLE), max(CAST(free AS DOUBLE) / CAST(weights_from AS DOUBLE)) OVER () * weight) AS target FROM l),
w AS (
  SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), cap) AS words, (source_size + 511) // 512 AS n_blocks FROM t),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS epochs,
         CASE WHEN source_size > 0 THEN words % source_size ELSE 0 END AS rest FROM w),
n AS (SELECT *, (rest + 511) // 512 AS rest_slots FROM e),
i AS (
  SELECT *, unnest(range(0, rest_slots)) AS i FROM n WHERE rest_slots > 0),
x AS (
  SELECT source_no, epochs, n_blocks, i, i AS cur, 1 AS turn FROM i WHERE i < n_blocks - 1
  UNION ALL
  SELECT source_no, epochs, n_blocks, i,
         CASE WHEN substr(md5('0:' || source_no || ':' || epochs || ':' || turn || ':' || greatest(cur, mirror)), 1, 1) >= '8' THEN mirror ELSE cur END, turn + 1
  FROM (SELECT *, ((CAST('0x' || substr(md5('0:' || source_no || ':' || epochs || ':' || turn || ':k'), 1, 12) AS BIGINT) - cur) % (n_blocks - 1) + n_blocks - 1) % (n_blocks - 1) AS mirror FROM x)
  WHERE turn <= 24),
b AS (
  SELECT i.source_no, coalesce(x.cur, i.n_blocks - 1) AS block,
         CASE WHEN i.i = i.rest_slots - 1 THEN i.rest - i.i * 512
              WHEN i.i < i.n_blocks - 1 THEN 512
              ELSE i.source_size - (i.n_blocks - 1) * 512 END AS slot_words
  FROM i LEFT JOIN x ON x.source_no = i.source_no AND x.i = i.i AND x.turn = 25),
k AS (SELECT greatest(256, (count(*) + 99999) // 100000) AS chunks FROM d),
o AS (
  SELECT d.doc_id, d.size, n.source_no, n.source_size, n.target, n.epochs,
         CAST(sum(d.size) OVER (PARTITION BY n.source_no ORDER BY CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || d.size), 1, 12) AS BIGINT) % chunks, d.doc_id NULLS FIRST, d.size
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - d.size AS beg
  FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source CROSS JOIN k),
p AS (
  SELECT *, unnest(range(beg // 512, (beg + size - 1) // 512 + 1)) AS block FROM o WHERE size > 0),
q AS (
  SELECT p.doc_id, p.beg, sum(greatest(least(p.beg + p.size, p.block * 512 + b.slot_words) - greatest(p.beg, p.block * 512), 0)) AS more
  FROM p JOIN b ON p.source_no = b.source_no AND p.block = b.block GROUP BY p.doc_id, p.beg, p.source_no)
SELECT o.doc_id, o.size, o.source_size, o.target, CAST(o.epochs * o.size + coalesce(q.more, 0) AS BIGINT) AS taken
FROM o LEFT JOIN q ON o.doc_id = q.doc_id AND o.beg = q.beg AND o.size > 0
"""
