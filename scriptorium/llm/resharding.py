"""Resharding by minimum-cost flow: from old shard sizes to new capacities, moving the fewest bytes.

The flow is solved on the driver over old and new shards only. In each old shard the documents lie on a
byte axis; the flow cuts that axis into blocks, what stays first. A document goes with the block that its
middle lies in. Places on the axis come from prefix sums over parts of bounded size, so an old shard that
holds a third of all rows is spread like any other. Only shards that gain or lose blocks are rewritten.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import new_folder, staged

#: Rows of a part of an old shard.
PART_ROWS = 2_000


class Network:
    """Arcs with capacity and cost, each followed by its reverse; flow by the primal-dual method."""

    def __init__(self, n: int):
        self.n = n
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, u: int, v: int, room: int, cost: int) -> int:
        number = len(self.to)
        for a, b, r, c in ((u, v, room, cost), (v, u, 0, -cost)):
            self.out[a].append(len(self.to))
            self.to.append(b)
            self.room.append(r)
            self.cost.append(c)
        return number

    def min_cost_flow(self, source: int, sink: int) -> int:
        """The cost of a greatest flow of least cost (costs of arcs not negative); the arcs' rooms are left as it leaves them.

        Each round finds the least costs of paths from the source, then fills the arcs on cheapest paths until
        they are blocked; so there are as many rounds as paths of different cost.
        """
        price, total = [0] * self.n, 0
        while True:
            dist: list[int | None] = [None] * self.n
            dist[source], heap = 0, [(0, source)]
            while heap:
                d, u = heapq.heappop(heap)
                if d > dist[u]:
                    continue
                for e in self.out[u]:
                    v = self.to[e]
                    if self.room[e] and (dist[v] is None or d + self.cost[e] + price[u] - price[v] < dist[v]):
                        dist[v] = d + self.cost[e] + price[u] - price[v]
                        heapq.heappush(heap, (dist[v], v))
            if dist[sink] is None:
                return total
            most = max(d for d in dist if d is not None)
            price = [p + (most if d is None else d) for p, d in zip(price, dist, strict=True)]
            total += self._block(source, sink, price) * (price[sink] - price[source])

    def _block(self, source: int, sink: int, price: list[int]) -> int:
        """Flow along arcs of no reduced cost until every such path is blocked."""
        at, dead, sent = [0] * self.n, [False] * self.n, 0
        path: list[int] = []
        on, u = [False] * self.n, source
        on[source] = True
        while True:
            if u == sink:
                amount = min(self.room[e] for e in path)
                sent += amount
                for e in path:
                    self.room[e] -= amount
                    self.room[e ^ 1] += amount
                for e in path:
                    on[self.to[e]] = False
                path, u = [], source
                continue
            while at[u] < len(self.out[u]):
                e = self.out[u][at[u]]
                v = self.to[e]
                if self.room[e] and not on[v] and not dead[v] and self.cost[e] + price[u] == price[v]:
                    break
                at[u] += 1
            if at[u] < len(self.out[u]):
                path.append(self.out[u][at[u]])
                u = self.to[path[-1]]
                on[u] = True
            elif u == source:
                return sent
            else:
                dead[u], on[u] = True, False
                u = self.to[path.pop() ^ 1]


@dataclass
class Block:
    """Bytes lo to hi of an old shard's axis, which go to a new shard."""

    old: int
    lo: int
    hi: int
    shard: int


def blocks(sizes: dict[int, int], n_new: int) -> list[Block]:
    """Blocks of a cheapest flow to n_new shards of equal capacity; a byte costs nothing where it lies and 1 elsewhere.

    All that moves passes one node between old and new shards, so the network has an arc or two for each
    shard, and there are no more blocks than shards, old and new.
    """
    olds, total = sorted(sizes), sum(sizes.values())
    source, hub, sink = 0, 1, 2
    old_node, new_node = {s: 3 + i for i, s in enumerate(olds)}, [3 + len(olds) + j for j in range(n_new)]
    net, stay, leave = Network(3 + len(olds) + n_new), {}, {}
    for s in olds:
        net.arc(source, old_node[s], sizes[s], 0)
        if 0 <= s < n_new:
            stay[s] = net.arc(old_node[s], new_node[s], sizes[s], 0)
        leave[s] = net.arc(old_node[s], hub, sizes[s], 1)
    enter = [net.arc(hub, new_node[j], total, 0) for j in range(n_new)]
    for j in range(n_new):
        net.arc(new_node[j], sink, total // n_new + (j < total % n_new), 0)
    net.min_cost_flow(source, sink)
    flow = lambda e: net.room[e ^ 1]
    found, j, free = [], 0, flow(enter[0])
    for s in olds:
        at = flow(stay[s]) if s in stay else 0
        if at:
            found.append(Block(s, 0, at, s))
        left = flow(leave[s])
        while left:
            while not free:
                j += 1
                free = flow(enter[j])
            moved = min(left, free)
            found.append(Block(s, at, at + moved, j))
            at, left, free = at + moved, left - moved, free - moved
    return found


@dataclass
class Resharded:
    """The documents with their places; blocks; the shards whose files change; the folder they were rewritten to."""

    placed: DataFrame
    blocks: list[Block]
    affected: list[int]
    folder: str | None = None

    def moved_bytes(self) -> int:
        return sum(b.hi - b.lo for b in self.blocks if b.old != b.shard)


def reshard(docs: DataFrame, old_shard: Column, *, n_new: int = 8, rewrite: bool = True) -> Resharded:
    """placed: doc_id, text, size, text_crc32, old_shard, shard, slot; and the rewritten files if asked for.

    size is the UTF-8 bytes of the text (null: none) plus 1. Slots are gapless from 0 in each shard. Null
    texts are written as empty ones. Equal rows lie side by side and keep a slot each. Other columns are
    left out. No rows: no blocks, no files.
    """
    raw = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", raw.alias("text"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"), F.coalesce(old_shard.cast("int"), F.lit(0)).alias("old_shard"))
    parts = 1 + docs.count() // PART_ROWS
    sized = sized.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts)))
    keys, order = ["old_shard", "part"], ["doc_id", "text_crc32"]
    narrow = staged(sized.select(*keys, *order, "size"), "sizes")
    per_part = narrow.groupBy(*keys).agg(F.sum("size").alias("bytes"))
    earlier = Window.partitionBy("old_shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    plan = blocks({r["old_shard"]: r["s"] for r in per_part.groupBy("old_shard").agg(F.sum("bytes").alias("s")).collect()}, n_new)
    # The ends of each old shard's blocks and where they go: two arrays, for a lookup without a join by range.
    cuts: dict[int, tuple[list[int], list[int]]] = {}
    for b in plan:
        ends, goals = cuts.setdefault(b.old, ([], []))
        ends.append(b.hi)
        goals.append(b.shard)
    known = docs.sparkSession.createDataFrame([(old, *pair) for old, pair in cuts.items()], "old_shard int, ends array<long>, goals array<int>")
    bases = per_part.select(*keys, F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("base")).join(known, "old_shard")

    def on_axis(df: DataFrame) -> DataFrame:
        own = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        middle = F.col("base") + F.sum("size").over(own) - F.col("size") / 2
        return df.withColumns({"nth": F.row_number().over(own), "middle": middle}).withColumn("shard", F.expr("element_at(goals, least(size(goals), 1 + size(filter(ends, e -> e <= middle))))"))

    counts = on_axis(narrow.join(bases, keys)).groupBy(*keys, "shard").agg(F.count("*").alias("n"), F.min("nth").alias("first"))
    in_shard = Window.partitionBy("shard").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    deltas = counts.withColumn("delta", F.coalesce(F.sum("n").over(in_shard), F.lit(0)) - F.col("first"))
    table = deltas.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("shard", "delta"))).alias("delta")).join(bases, keys)
    placed = on_axis(sized.join(staged(table, "bases"), keys)).select("doc_id", "text", "size", "text_crc32", "old_shard", "shard", (F.col("nth") + F.element_at("delta", F.col("shard"))).alias("slot"))
    kept = {b.old for b in plan} - {b.old for b in plan if b.old != b.shard} - {b.shard for b in plan if b.old != b.shard}
    out = Resharded(placed, plan, sorted({b.shard for b in plan} - kept))
    if rewrite:
        out.folder = new_folder(docs.sparkSession, "shards")
        placed.where(F.col("shard").isin(out.affected)).write.partitionBy("shard").parquet(out.folder)
    return out


def read_back(resharded: Resharded) -> DataFrame:
    """All documents in their new places: rewritten shards from their files, the others from where they lie."""
    spark = resharded.placed.sparkSession
    still = resharded.placed.where(~F.col("shard").isin(resharded.affected))
    if not resharded.folder or not resharded.affected:
        return resharded.placed
    written = spark.read.schema(resharded.placed.schema).parquet(resharded.folder)
    names = resharded.placed.columns
    return written.select(*names) if len(resharded.affected) == len({b.shard for b in resharded.blocks}) else written.select(*names).union(still.select(*names))
