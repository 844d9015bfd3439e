"""Resharding with the fewest bytes moved, by minimum-cost flow.

A layout is a folder of files, each of one shard, and a list of the blocks in each file. A
block is the rows of one hash of the text, so equal texts share it; one larger than a small
part of a shard (a hot text) is split by a hash of its rows. Old shard sizes and new
capacities form a transport network in which a byte that stays costs nothing and a byte
that moves costs one; its minimum-cost flow says how much of each old shard stays and how much
leaves. Whole blocks realise it: an old shard keeps blocks up to its stay, giving up whole
files first; those that leave go, largest first, where most room is left. So the bytes moved
exceed the least by less than a small block a shard (tested at one part in a hundred).

Only files that give up a block are rewritten, into new files of their own shard and of the
shards that receive; all other files stay as they are and are read in place. A row's slot is its
file's offset in the shard plus its position in the file, so it needs no rewriting.

The driver holds a row per block; there are BLOCKS a shard, or as many as FILE_BYTES asks for,
and never more than MOST, so tasks are bounded by bytes.

Edge cases: a null text has size 16 and the checksum of no bytes; equal texts stay
together unless their block was split; identical rows of a split block stay together;
an empty table gives no rows; null ids come first within their file; other
columns are carried into the files, unless named like one of the operator's.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._tables import read, shared_dir

OVERHEAD = 16
OLD, SHARDS, BLOCKS = 32, 40, 128
#: Bytes of a file, about; files of a shard, at least; blocks of a table, at most.
FILE_BYTES, FILES, MOST = 64 << 20, 8, 1 << 17
OWN = ("size", "shard", "slot", "text_crc32", "old_shard", "moved")


def min_cost_flow(supply: list[int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """Bytes sent from each supply i to each capacity j at least cost, where i to i is free and all else costs one.

    Successive shortest paths with potentials over the bipartite network.
    """
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    to: list[list[int]] = []  # [head, residual, cost] by arc; arc ^ 1 is its reverse
    out: list[list[int]] = [[] for _ in range(n + m + 2)]

    def arc(a: int, b: int, room: int, cost: int) -> None:
        out[a].append(len(to))
        to.append([b, room, cost])
        out[b].append(len(to))
        to.append([a, 0, -cost])

    for i, s in enumerate(supply):
        arc(source, i, s, 0)
        for j in range(m):
            arc(i, n + j, s, int(i != j))
    for j, c in enumerate(capacity):
        arc(n + j, sink, c, 0)
    height = [0] * (n + m + 2)
    left = min(sum(supply), sum(capacity))
    while left:
        dist = [None] * (n + m + 2)
        via = [-1] * (n + m + 2)
        dist[source] = 0
        heap = [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > dist[a]:
                continue
            for k in out[a]:
                b, room, cost = to[k]
                if room and (dist[b] is None or d + cost + height[a] - height[b] < dist[b]):
                    dist[b] = d + cost + height[a] - height[b]
                    via[b] = k
                    heapq.heappush(heap, (dist[b], b))
        for v, d in enumerate(dist):
            height[v] += d if d is not None else 0
        push, v = left, sink
        while v != source:
            push = min(push, to[via[v]][1])
            v = to[via[v] ^ 1][0]
        v = sink
        while v != source:
            to[via[v]][1] -= push
            to[via[v] ^ 1][1] += push
            v = to[via[v] ^ 1][0]
        left -= push
    flow = {}
    for i in range(n):
        for k in out[i]:
            if k % 2 == 0 and to[k ^ 1][1]:
                flow[i, to[k][0] - n] = to[k ^ 1][1]
    return flow


def assign(blocks: dict, capacity: list[int], files: dict | None = None) -> dict:
    """New shard of each block {block: (old shard, bytes)}, realising the minimum-cost flow.

    files: the file of each block, by which blocks that leave are chosen together.
    """
    supply = [0] * (1 + max((o for o, _ in blocks.values()), default=0))
    held: dict[int, list] = defaultdict(list)
    for block, (old, size) in blocks.items():
        supply[old] += size
        held[old].append(block)
    total, room = sum(supply), sum(capacity)
    scaled = [-(-c * total // room) for c in capacity] if room else capacity
    stay = defaultdict(int, {i: x for (i, j), x in min_cost_flow(supply, scaled).items() if i == j})
    chosen, load, leaving = {}, [0] * len(capacity), []
    for old, own in held.items():
        spare = supply[old] - stay[old]
        groups: dict = defaultdict(list)
        for b in own:
            groups[files[b] if files else b].append(b)
        keep: list = []
        # whole files leave while they fit in what must go; of the rest, blocks stay largest first while they fit
        for g in sorted(groups, key=lambda g: (-sum(blocks[b][1] for b in groups[g]), g)):
            size = sum(blocks[b][1] for b in groups[g])
            if size <= spare:
                leaving += groups[g]
                spare -= size
            else:
                keep.append(g)
        broken = sorted(keep, key=lambda g: (sum(blocks[b][1] for b in groups[g]), g))[:1] if spare else []
        for g in keep:
            if g not in broken:
                for b in groups[g]:
                    chosen[b] = old
                    load[old] += blocks[b][1]
        for b in sorted((b for g in broken for b in groups[g]), key=lambda b: (-blocks[b][1], b)):
            if load[old] + blocks[b][1] <= stay[old]:
                chosen[b] = old
                load[old] += blocks[b][1]
            else:
                leaving.append(b)
    need = [(x - c, j) for j, (x, c) in enumerate(zip(load, scaled, strict=True))]
    heapq.heapify(need)
    for b in sorted(leaving, key=lambda b: (-blocks[b][1], b)):
        gap, j = heapq.heappop(need)
        chosen[b] = j
        heapq.heappush(need, (gap + blocks[b][1], j))
    return chosen


def _size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


class Layout:
    """Files of shards: rows with columns __block, __part, __pos (position in the file) and __file."""

    def __init__(self, folder: str, shards: int, columns: list[str], text_col: str, id_col: str):
        self.folder, self.shards, self.columns, self.text_col, self.id_col = folder, shards, columns, text_col, id_col
        self.blocks: dict[tuple[int, int], tuple[int, int]] = {}  # bytes, rows
        self.file: dict[tuple[int, int], int] = {}
        self.shard: dict[int, int] = {}  # of each file

    def write(self, rows: DataFrame, folder: str, plan: dict[tuple[int, int], int]) -> None:
        """Write the rows of the blocks in plan to the files named there."""
        spark = rows.sparkSession
        table = spark.createDataFrame([(b, p, f) for (b, p), f in plan.items()], "__block int, __part int, __file int")
        order = Window.partitionBy("__file").orderBy(F.col(f"`{self.id_col}`").asc_nulls_first(), F.md5(F.col(f"`{self.text_col}`")))
        placed = rows.join(F.broadcast(table), ["__block", "__part"]).withColumn("__pos", F.row_number().over(order).cast("long") - 1)
        placed.select(*(F.col(f"`{c}`") for c in self.columns), "size", "__block", "__part", "__pos", "__file").write.partitionBy("__file").option("compression", "zstd").parquet(folder)


def write_shards(df: DataFrame, folder: str, shards: int = OLD, blocks: int = BLOCKS, goal: int = SHARDS, file_bytes: int = FILE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> Layout:
    """Write df as files of `shards` shards; blocks are fit for `goal` shards too."""
    own = [c for c in df.columns if c not in OWN]
    out = Layout(folder, shards, own, text_col, id_col)
    text = F.col(f"`{text_col}`")
    rows = df.select(*(F.col(f"`{c}`") for c in own), _size(text).alias("size"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    if not total:
        return out
    number = min(MOST, max(shards * blocks, 8 * (total // file_bytes)))
    rows = rows.withColumn("__block", F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(number)).cast("int"))
    coarse = {r[0]: (r[1], r[2]) for r in rows.groupBy("__block").agg(F.sum("size"), F.count("*")).collect()}
    grain = max(1, total // (goal * 64))
    hot = {b: min(n, -(-x // grain)) for b, (x, n) in coarse.items() if x > 16 * grain and n > 1}
    parts = F.lit(1)
    if hot:
        parts = F.coalesce(F.create_map(*[F.lit(x) for bn in hot.items() for x in bn])[F.col("__block")], F.lit(1))
    rows = rows.withColumn("__part", F.pmod(F.xxhash64(F.col(f"`{id_col}`"), text), parts).cast("int"))
    out.blocks = {(b, 0): coarse[b] for b in coarse if b not in hot}
    if hot:
        split = rows.where(F.col("__block").isin(list(hot))).groupBy("__block", "__part").agg(F.sum("size"), F.count("*")).collect()
        out.blocks |= {(r[0], r[1]): (r[2], r[3]) for r in split}
    files = max(FILES, -(-total // (shards * file_bytes)))
    for k, (b, p) in enumerate(sorted(out.blocks)):
        shard = (b + p) % shards
        out.file[b, p] = shard * files + (k // shards) % files
        out.shard[out.file[b, p]] = shard
    out.write(rows, folder, out.file)
    return out


def reshard(spark: SparkSession, old: Layout, folder: str, capacity: list[int]) -> DataFrame:
    """Move blocks so that shards hold bytes in proportion to capacity; returns the table of all files.

    Added columns: size, shard, slot (from 0 in the shard, gapless), old_shard, moved. Files of `old`
    that lose no block stay; what the others held is written to `folder`.
    """
    if not old.blocks:
        kinds = ", ".join(["size bigint, shard int, slot bigint, old_shard int, moved boolean"])
        return spark.createDataFrame([], kinds).select(*(F.lit(None).alias(c) for c in old.columns), "*")
    was = {b: old.shard[old.file[b]] for b in old.blocks}
    chosen = assign({b: (was[b], x) for b, (x, _) in old.blocks.items()}, capacity, old.file)
    touched = {old.file[b] for b, j in chosen.items() if j != was[b]}
    fresh = 1 + max(old.shard)
    # what a touched file keeps is one new file; what comes to a shard is dealt over as many as its bytes ask for
    plan, shard_of = {}, {f: s for f, s in old.shard.items() if f not in touched}
    names: dict[tuple, int] = {}
    gained: dict[int, int] = defaultdict(int)
    for b, j in sorted(chosen.items()):
        if old.file[b] in touched:
            key = (j, old.file[b], 0) if j == was[b] else (j, -1, gained[j] // FILE_BYTES)
            gained[j] += old.blocks[b][0] if j != was[b] else 0
            plan[b] = names.setdefault(key, fresh + len(names))
            shard_of[plan[b]] = j

    def files_of(names: set[int]) -> DataFrame:
        return spark.read.option("basePath", old.folder).parquet(*[f"{old.folder}/__file={f}" for f in sorted(names)])

    count: dict[int, int] = defaultdict(int)
    for b, (_, n) in old.blocks.items():
        count[plan.get(b, old.file[b])] += n
    offset, at = {}, [0] * len(capacity)
    for f in sorted(count):
        offset[f] = at[shard_of[f]]
        at[shard_of[f]] += count[f]
    parts = [files_of(kept)] if (kept := set(old.shard) - touched) else []
    if touched:
        old.write(files_of(touched).drop("__file", "__pos"), folder, plan)
        parts.append(spark.read.parquet(folder))
    stays = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    files = spark.createDataFrame([(f, shard_of[f], offset[f]) for f in count], "__file int, shard int, __offset bigint")
    moves = spark.createDataFrame([(b, p, was[b, p], j != was[b, p]) for (b, p), j in chosen.items()], "__block int, __part int, old_shard int, moved boolean")
    out = stays.join(F.broadcast(files), "__file").join(F.broadcast(moves), ["__block", "__part"])
    return out.select(*(F.col(f"`{c}`") for c in old.columns), "size", "shard", (F.col("__offset") + F.col("__pos")).alias("slot"), "old_shard", "moved")


def op3_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    old = write_shards(docs, shared_dir(spark, "shards-old"))
    files = reshard(spark, old, shared_dir(spark, "shards-new"), [1] * SHARDS)
    crc = F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return files.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.col("size").cast("long").alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard", "moved")
