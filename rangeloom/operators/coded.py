"""Replicated placement and the coded exchange, as tables.

``k`` nodes, replication ``r``; file ``f`` lives on the r nodes of its set, a group has r + 1 nodes. Blocks are
``(file_id, dest)``. One file per r-subset is supported, other numbers of files are not.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import comb

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rangeloom.functions.keys import masked_nodes
from rangeloom.operators import records
from rangeloom.shared import stored

_MOST_NODES = 20
#: Rows of a table of blocks or chunks, known from the nodes alone, that are broadcast at most; larger ones are joined by an exchange.
_BROADCAST = 250_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= _BROADCAST else df


def node_subsets(spark: SparkSession, k: int, r: int) -> DataFrame:
    """``(subset_id 0-based, mask, nodes)`` of all r-subsets in the order of their masks; at most 2**20 masks."""
    if not 1 <= r <= k <= _MOST_NODES:
        raise ValueError(f"need 1 <= r <= k <= {_MOST_NODES}")
    masks = spark.range(2**k).select(F.col("id").alias("mask")).where(F.bit_count("mask") == r)
    order = F.row_number().over(Window.orderBy("mask")) - 1
    return masks.select(order.alias("subset_id"), "mask", masked_nodes(F.col("mask"), k).alias("nodes"))


def files(spark: SparkSession, k: int, r: int) -> DataFrame:
    """``(file_id 1-based, mask, nodes)``."""
    return node_subsets(spark, k, r).select((F.col("subset_id") + 1).alias("file_id"), "mask", "nodes")


def placement(spark: SparkSession, k: int, r: int) -> DataFrame:
    """``(file_id, node)``: every file on each node of its set."""
    return files(spark, k, r).select("file_id", F.explode("nodes").alias("node"))


def groups_of_node(spark: SparkSession, k: int, r: int, node: int) -> DataFrame:
    """Groups (r + 1 nodes) that contain ``node``."""
    return node_subsets(spark, k, r + 1).where(F.array_contains("nodes", node)).withColumnRenamed("subset_id", "group_id")


def exchange_demand(spark: SparkSession, k: int, r: int) -> DataFrame:
    """``(group_id, dest, file_id, nodes)``: in each group every node wants the file of the others."""
    groups = node_subsets(spark, k, r + 1).select(F.col("subset_id").alias("group_id"), F.col("mask").alias("group_mask"), F.explode("nodes").alias("dest"))
    wanted = groups.withColumn("mask", F.expr("group_mask - shiftleft(1L, dest - 1)"))
    return wanted.join(files(spark, k, r), "mask").select("group_id", "dest", "file_id", "nodes")


def place_records(df: DataFrame, key: str, order_cols: Sequence[str], k: int, r: int, num_samples: int = 10_000, place: str | None = None) -> DataFrame:
    """Add ``file_id`` (input split by position), ``dest`` (range of the key, nodes 1..k).

    ``place``: a column that has every row's index in the order of ``order_cols`` already; then no row is sorted or moved for it.
    """
    split = records.split_input(df, comb(k, r), order_cols, place) if comb(k, r) > 1 else df.withColumn("split_id", F.lit(0))
    sample = records.systematic_sample(df.select(*dict.fromkeys([key, *order_cols, *([place] if place else [])])), num_samples, order_cols, place)
    cuts = records.splitter_list(records.choose_splitters(sample, key, k))
    placed = records.range_assign(split, key, cuts)
    return placed.withColumn("file_id", F.col("split_id") + 1).withColumn("dest", F.col("pid") + 1).drop("split_id", "pid", "idx")


def replicate(df: DataFrame, placed: DataFrame) -> DataFrame:
    """Every record on each node that has its file; the placement is bounded by its number of nodes."""
    return df.join(F.broadcast(placed), "file_id")


def prune_replicas(df: DataFrame, placed: DataFrame) -> DataFrame:
    """Keep a replica for the node itself, or for a node that does not have the file."""
    own = placed.select("file_id", F.col("node").alias("dest"))
    foreign = df.where("dest <> node").join(F.broadcast(own), ["file_id", "dest"], "left_anti")
    return df.where("dest = node").unionByName(foreign.select(*df.columns))


def remote(df: DataFrame, spark: SparkSession, k: int, r: int) -> DataFrame:
    """Records whose destination lacks their file, with the group that serves the block."""
    demand = exchange_demand(spark, k, r)
    return df.join(F.broadcast(demand), ["file_id", "dest"])


def chunk_blocks(df: DataFrame, r: int, order_cols: Sequence[str], k: int = _MOST_NODES) -> DataFrame:
    """Cut each block in r chunks of ``floor(n / r)`` lines, the last with the rest (all lines if n < r).

    Adds ``part`` (0-based), ``offset`` in the chunk and ``sender``, the ``part``-th node that has the file. A line's
    place in its block is its row index in the order of (file, dest, ``order_cols``) less that of the block's first
    line, so a block that holds much of the input is spread over many ranges. Of ``k`` nodes there are
    ``(k - r) * C(k, r)`` such blocks; where these are few, no line moves to meet its block's size.
    """
    placed = records.with_row_index(df, ["file_id", "dest", *order_cols], "__at")
    blocks = placed.groupBy("file_id", "dest").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    place = placed.join(_small(blocks, (k - r) * comb(k, r)), ["file_id", "dest"]).withColumn("__pos", F.col("__at") - F.col("__first")).withColumn("__size", F.expr(f"__n div {r}"))
    part = F.when(F.col("__size") == 0, F.lit(r - 1)).otherwise(F.least(F.expr("__pos div __size"), F.lit(r - 1))).cast("int")
    out = place.withColumn("part", part).withColumn("offset", (F.col("__pos") - F.col("part") * F.col("__size")).cast("long"))
    return out.withColumn("sender", F.element_at("nodes", F.col("part") + 1)).select(*df.columns, "part", "offset", "sender")


def xor_encode(chunks: DataFrame, words: Sequence[str]) -> DataFrame:
    """Packet lines ``group_id, sender, offset, words``: XOR of the group's chunks; a missing line is zero."""
    return chunks.groupBy("group_id", "sender", "offset").agg(*(F.bit_xor(w).alias(w) for w in words))


def chunk_metadata(chunks: DataFrame, spark: SparkSession, k: int, r: int) -> DataFrame:
    """``group_id, sender, dest, file_id, part, size`` of every chunk, those of size 0 included."""
    every = exchange_demand(spark, k, r).select("group_id", "dest", "file_id", F.posexplode("nodes").alias("part", "sender"))
    sizes = chunks.groupBy("group_id", "sender", "dest", "file_id", "part").agg(F.count(F.lit(1)).alias("size"))
    joined = every.join(sizes, ["group_id", "sender", "dest", "file_id", "part"], "left")
    return joined.withColumn("size", F.coalesce("size", F.lit(0).cast("long")))


def packet_metadata(meta: DataFrame, r: int) -> DataFrame:
    """One row per packet: its chunks ``(dest, file_id, part 1-based, size)``, its lines, its header's bytes ``4 + 44 r``."""
    item = F.struct("dest", "file_id", (F.col("part") + 1).alias("part"), "size")
    packets = meta.groupBy("group_id", "sender").agg(F.sort_array(F.collect_list(item)).alias("chunks"), F.max("size").alias("packet_size"))
    return packets.withColumn("header_bytes", F.lit(4 + 44 * r))


def xor_decode(packets: DataFrame, meta: DataFrame, chunks: DataFrame, words: Sequence[str], sizes: int | None = None) -> DataFrame:
    """Every receiver XORs a packet with the chunks of the others, cut to its own chunk's size.

    An equi-join on (group, sender): the metadata has r receivers for each packet. ``sizes``: its number of rows, where known; if
    it is small, lines are not brought together by (group, sender), of which there are few, before they are by line. The packet's line and the r - 1
    known lines of a receiver then meet in one sum by line and receiver.
    """
    own = meta.select("group_id", "sender", F.col("dest").alias("receiver"), "file_id", "part", "size")
    own = own if sizes is None else _small(own, sizes)
    line = ["group_id", "sender", "offset", "receiver", "file_id", "part"]
    coded = packets.join(own, ["group_id", "sender"]).where("offset < size").select(*line, *words)
    known = chunks.select("group_id", "sender", "offset", "dest", *words).join(own, ["group_id", "sender"])
    known = known.where("dest <> receiver and offset < size").select(*line, *words)
    return coded.unionByName(known).groupBy(*line).agg(*(F.bit_xor(w).alias(w) for w in words)).withColumnRenamed("receiver", "dest")


def reassemble(local: DataFrame, decoded: DataFrame, words: Sequence[str]) -> DataFrame:
    """``dest, file_id, words``: the lines a node has itself and those it decoded."""
    cols = ["dest", "file_id", *words]
    return local.select(*cols).unionByName(decoded.select(*cols))


def completeness(spark: SparkSession, local: DataFrame, decoded: DataFrame, blocks: DataFrame, k: int, r: int) -> DataFrame:
    """``node, files_seen, files_expected, lines, ok``: a file counts as seen if a node holds all of its lines.

    What a node has itself and what it decoded are held against ``blocks`` (``file_id, dest, lines``), the sizes of the
    blocks when they were placed, file by file; an empty block is complete as it is. ``lines`` are those it holds.
    """
    every = files(spark, k, r).select("file_id", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("dest"))
    count = lambda x, n: x.groupBy("dest", "file_id").agg(F.count(F.lit(1)).alias(n))
    cells = every.join(blocks.withColumnRenamed("lines", "wanted"), ["dest", "file_id"], "left").join(count(decoded, "got"), ["dest", "file_id"], "left").join(count(local, "own"), ["dest", "file_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    held = zero("got") + zero("own")
    out = cells.groupBy(F.col("dest").alias("node")).agg(F.count_if(held == zero("wanted")).alias("files_seen"), F.count(F.lit(1)).alias("files_expected"), F.sum(held).alias("lines"))
    return out.withColumn("ok", F.col("files_seen") == F.col("files_expected"))


def coded_parts(df: DataFrame, k: int, r: int, order_cols: Sequence[str]) -> dict[str, DataFrame]:
    """Tables of a coded exchange of ``df`` (``file_id, dest`` set): local, chunks, meta, blocks. Placed lines, their blocks' sizes and chunks are written."""
    spark = df.sparkSession
    df = stored(df, "placed-lines")
    placed = placement(spark, k, r)
    mine = placed.select("file_id", F.col("node").alias("dest"))
    blocks = stored(df.groupBy("file_id", "dest").agg(F.count(F.lit(1)).alias("lines")), "block-sizes")
    chunks = stored(chunk_blocks(remote(df, spark, k, r), r, order_cols, k), "chunks")
    return {"local": df.join(F.broadcast(mine), ["file_id", "dest"], "left_semi"), "chunks": chunks, "meta": chunk_metadata(chunks, spark, k, r), "placed": placed, "blocks": blocks}


def coded_sort(df: DataFrame, key: str, k: int, r: int, words: Sequence[str], order_cols: Sequence[str], num_samples: int = 10_000, place: str | None = None) -> DataFrame:
    """Total sort through the coded exchange: rows ``dest, file_id, words`` in the order of ``words``.

    ``words`` are BIGINT columns that carry the whole record, the key's words first, such that their order is the
    order wanted (see ``to_words``); only they go through the exchange. ``place``: as in :func:`place_records`. Encoding needs no replicas: each remote line stands in one packet only. Runs jobs for the
    split and the splitters, writes what is decoded, and fails where a node lacks lines.
    """
    spark = df.sparkSession
    placed = place_records(df, key, order_cols, k, r, num_samples, place).select("file_id", "dest", *words)
    parts = coded_parts(placed, k, r, words)
    meta = stored(parts["meta"], "chunk-sizes")
    packets = xor_encode(parts["chunks"], words)
    decoded = stored(xor_decode(packets, meta, parts["chunks"], words, r * (r + 1) * comb(k, r + 1)), "decoded-lines")
    if not completeness(spark, parts["local"], decoded, parts["blocks"], k, r).where("not ok").isEmpty():
        raise ValueError("a node lacks lines")
    whole = reassemble(parts["local"], decoded, words)
    return whole.repartitionById(k, F.col("dest") - 1).sortWithinPartitions(*words)


def load_report(df: DataFrame, k: int, r: int) -> DataFrame:
    """Per node: lines mapped, remote lines it receives uncoded, packet lines it sends, and their ratio."""
    spark = df.sparkSession
    sizes = df.groupBy("file_id", "dest").agg(F.count(F.lit(1)).alias("n"))
    placed = placement(spark, k, r)
    mapped = sizes.join(F.broadcast(placed), "file_id").groupBy("node").agg(F.sum("n").alias("lines_mapped"))
    demand = exchange_demand(spark, k, r)
    blocks = demand.join(sizes, ["file_id", "dest"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    received = blocks.groupBy(F.col("dest").alias("node")).agg(F.sum("n").alias("remote_lines"))
    chunk = blocks.select("group_id", "n", F.posexplode("nodes").alias("part", "sender"))
    size = F.when(F.col("part") == r - 1, F.col("n") - F.expr(f"n div {r}") * (r - 1)).otherwise(F.expr(f"n div {r}"))
    packets = chunk.groupBy("group_id", "sender").agg(F.max(size).alias("lines"))
    sent = packets.groupBy(F.col("sender").alias("node")).agg(F.sum("lines").alias("packet_lines"))
    out = mapped.join(received, "node").join(sent, "node")
    return out.withColumn("coded_over_uncoded", F.try_divide(F.col("packet_lines"), F.col("remote_lines")))
