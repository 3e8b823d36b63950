"""Parent-child links to full hierarchies: paths, levels, roots, everything below, and cycles.

Method: subtree sizes are computed upward, sibling preorder ranges are allocated downward by prefix sums of those
sizes, and nested-set ranges give what is below and above a part; what the upward processing never reaches reveals the cycles.

Links form a graph, not a tree, so the ranges are those of a spanning forest: every part with children hangs below the
smallest of its parents (a part on a loop of such choices, the smallest of the loop, becomes a top), every link to a
part without children is a place of its own. Upward and downward steps double their reach, so their number is the
logarithm of the depth. The links outside the forest are few where assemblies share few parts, and are exact for any
number: an *entry* is a top or the head of such a link, every part belongs to the segment of the nearest entry above it, and
entries and the links between segments (a link outside the forest, or the forest link of an entry) form a small graph.
Shortest ways run over this graph; below an entry they are differences of depth, and its range gives the parts.
Cycles are those of the small graph: entries all of whose links lead to processed entries are processed, upward and
downward, and the rest falls into strongly connected groups, whose members are the parts whose ranges hold a
link that stays in the group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from partloom.functions.keys import key
from partloom.operators.skew import join_unique
from partloom.session import Cuts, static_plans

#: rows of a step that one task handles
ROWS_PER_TASK = 20_000
#: rows of a step for which one more salt is taken, so that a hot entry's rows are spread; the links of the small graph are copied as often
ROWS_PER_SALT, MOST_SALTS = 1_000_000, 64
#: sibling blocks for the prefix sums, so that a parent with very many children isn't summed in one task
BLOCKS = 32
#: places of a range that are listed by one row
STRETCH = 4_096


def links(rows: DataFrame, parent: str, child: str) -> DataFrame:
    """(parent, child): the distinct links; rows with a null or blank parent or child don't count."""
    return rows.select(key(parent).alias("parent"), key(child).alias("child")).where("parent is not null and child is not null").distinct()


def prefix_sums(rows: DataFrame, group: str, order: str, size: str, out: str) -> DataFrame:
    """rows with `out`, the sum of `size` over the rows of the group before it.

    The order is by block, then by `order`: sums run within blocks of a group and over the blocks' totals, so no group meets in one task.
    """
    blocked = rows.withColumn("_block", F.pmod(F.xxhash64(order), F.lit(BLOCKS)).cast("int"))
    totals = blocked.groupBy(group, "_block").agg(F.sum(size).alias("_total"))
    starts = totals.select(group, "_block", (F.sum("_total").over(Window.partitionBy(group).orderBy("_block")) - F.col("_total")).alias("_start"))
    within = F.sum(size).over(Window.partitionBy(group, "_block").orderBy(order)) - F.col(size)
    return blocked.withColumn("_within", within).join(starts, [group, "_block"]).withColumn(out, F.col("_start") + F.col("_within")).drop("_block", "_start", "_within")


def contained(ranges: DataFrame, points: DataFrame, on: str, bits: int) -> DataFrame:
    """ranges (on, lo, hi, ...) with the points (on, pos, span, ...) inside them: every pair with lo <= pos <= hi, once.

    A range falls into at most two aligned blocks of each power of two, a point lies in one block of each; so both meet by
    equality, and nothing is compared in vain. span: the longest range of `on` a point may lie in; bits: those of the greatest position.
    """
    cells = []
    for k in range(bits + 1):
        left, right = F.shiftright(F.col("lo") + F.lit((1 << k) - 1), k), F.shiftright(F.col("hi") + 1, k)
        for edge, at in ((left, left), (right, right - 1)):
            cells.append(F.when((left < right) & (edge % 2 == 1), F.struct(F.lit(k).alias("_k"), at.alias("_b"))))
    cover = ranges.select("*", F.inline(F.array_compact(F.array(*cells))))
    steps = F.sequence(F.lit(0), F.floor(F.log2(F.col("span").cast("double"))).cast("int"))
    blocks = points.select("*", F.explode(steps).alias("_k")).withColumn("_b", F.expr("shiftright(pos, _k)"))
    return cover.join(blocks, [on, "_k", "_b"]).drop("_k", "_b", "lo", "hi", "pos", "span")


class Hierarchy:
    """The hierarchy of the links (parent, child), any graph; work tables go to the shared folder.

    nodes: (part, up, top, pre, last, depth, near, off, root, entry, ...) of every part that has children: its parent, top, range and
    depth in the forest, the nearest entry at or above it with the links between. Empty links give empty results.
    """

    def __init__(self, edges: DataFrame):
        self.spark = edges.sparkSession
        self.cuts = Cuts(self.spark, "hierarchy")
        self.rounds = 0
        self._places: dict[bool, DataFrame] = {}
        self.edges, self.n_edges, _ = self.cuts.write(edges.select("parent", "child"))
        parents = self.edges.groupBy("parent").agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed("parent", "child")
        marked = join_unique(self.edges, parents, "child", n=self.n_edges).select("parent", "child", F.col("_n").isNull().alias("leaf"))
        self.cuts.n += 1
        path, seen = f"{self.cuts.root}/{self.cuts.n:04d}", Observation()
        marked.observe(seen, F.count(F.when(F.col("leaf"), 1)).alias("n")).write.partitionBy("leaf").parquet(path)
        self.n_leaf_links = int(seen.get["n"])
        self.n_inner_links = self.n_edges - self.n_leaf_links
        read = lambda n, leaf: self.spark.read.schema("parent string, child string").parquet(f"{path}/leaf={leaf}") if n else self.spark.createDataFrame([], "parent string, child string")
        self.leaf_links, self.inner = read(self.n_leaf_links, "true"), read(self.n_inner_links, "false")
        self._forest()
        self._small_graph()


    # --- steps ---------------------------------------------------------------------------------

    def _tasks(self, n: int) -> int:
        most = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.spark.sparkContext.defaultParallelism)
        return max(1, min(most, -(-n // ROWS_PER_TASK))) if n <= most * ROWS_PER_TASK * 50 else -(-n // (ROWS_PER_TASK * 50))

    def _step(self, df: DataFrame, n: int, **count: Column) -> tuple[DataFrame, int, dict[str, int]]:
        """df written with a plan for about n rows, read back, with its rows and further counts."""
        seen = Observation()
        with static_plans(self.spark, self._tasks(n)):
            table, rows, _ = self.cuts.write(df.observe(seen, *[F.count(F.when(c, 1)).alias(k) for k, c in count.items()]) if count else df)
        return table, rows, seen.get if count else {}

    # --- the forest ------------------------------------------------------------------------------

    def _forest(self) -> None:
        per = self.leaf_links.groupBy("parent").agg(F.count(F.lit(1)).alias("leaves")).select(F.col("parent").alias("part"), "leaves", F.lit(None).cast("string").alias("up"), F.lit(0).alias("ups"), F.lit(False).alias("self"), F.lit(True).alias("other"))
        is_self = F.col("parent") == F.col("child")
        down = self.inner.groupBy(F.col("parent").alias("part")).agg(F.lit(0).cast("long").alias("leaves"), F.lit(None).cast("string").alias("up"), F.lit(0).alias("ups"), F.max(is_self).alias("self"), F.max(~is_self).alias("other"))
        above = self.inner.where(~is_self).groupBy(F.col("child").alias("part")).agg(F.lit(0).cast("long").alias("leaves"), F.min("parent").alias("up"), F.count(F.lit(1)).cast("int").alias("ups"), F.lit(False).alias("self"), F.lit(False).alias("other"))
        parts = per.unionByName(down).unionByName(above).groupBy("part").agg(F.sum("leaves").alias("leaves"), F.max("up").alias("up"), F.max("ups").alias("ups"), F.max("self").alias("self"), F.max("other").alias("other"))
        start = parts.select("part", "up", "leaves", (F.col("up").isNull() & F.col("other")).alias("root"), (F.col("up").isNull() | (F.col("ups") > 1) | F.col("self")).alias("entry"))
        done: list[DataFrame] = []
        todo, n = start, self.n_edges
        while n:
            finished, todo, n = self._settle(todo, n)
            done.append(finished)
        settled = reduce(DataFrame.unionByName, done) if done else self._upward_state(start)
        first = F.when(F.col("up").isNull(), F.lit(1).cast("long"))
        kids = prefix_sums(settled.where("up is not null"), "up", "part", "size", "_before").withColumn("acc", F.col("_before") + F.col("up_leaves") + 1).drop("_before")
        state = settled.where("up is null").withColumn("acc", first).unionByName(kids).drop("jump", "low", "up_leaves")
        table, self.n_nodes, _ = self._step(state, self.n_edges)
        for k in range(self.rounds):
            table, _, _ = self._step(self._over(table, k, "acc", lambda a, b: a + b), self.n_nodes)
        self.nodes = table.withColumn("pre", F.col("acc")).withColumn("last", F.col("acc") + F.col("size") - 1).drop("acc")

    def _upward_state(self, start: DataFrame) -> DataFrame:
        has = F.col("up").isNotNull()
        return start.select(
            "part", "up", "leaves", "root", "entry", F.col("up").alias("jump"), (F.col("leaves") + 1).alias("size"), has.cast("int").alias("depth"), F.when(~has, F.col("part")).alias("top"),
            F.when(F.col("entry"), F.col("part")).alias("near"), F.lit(0).alias("off"), F.col("up").alias("low"), F.lit(None).cast("long").alias("up_leaves"), F.array().cast("array<string>").alias("jumps"),
        )

    def _settle(self, start: DataFrame, n: int) -> tuple[DataFrame, DataFrame, int]:
        """Sizes upward, and depth, top and nearest entry: (the parts below a top, those below a loop of parents with the loops cut, how many).

        After round k each part knows its forest to 2^k links: jump is its ancestor there, size the places less than that below it,
        low the smallest of the ancestors so far. Depths have no gap, so if a round finishes no part, the others hang below
        loops; a part that is the smallest of its own ancestors is the smallest of a loop.
        """
        has = F.col("jump").isNotNull()
        state, n, seen = self._step(self._upward_state(start), n, open=has)
        before, step = None, 1
        while seen["open"]:
            if seen["open"] == before and seen["loops"]:
                break
            before = seen["open"]
            look = state.select(F.col("part").alias("_key"), *[F.col(c).alias(f"_{c}") for c in ("jump", "depth", "top", "near", "off", "low", "leaves")])
            more = state.where(has).groupBy(F.col("jump").alias("part")).agg(F.sum("size").alias("_more"))
            met = join_unique(state.withColumn("_key", F.coalesce("jump", "part")), look, "_key", n=n).join(more, "part", "left")
            found = F.col("near").isNull() & has
            state, _, seen = self._step(met.select(
                "part", "up", "leaves", "root", "entry", F.when(has, F.col("_jump")).alias("jump"), (F.col("size") + F.coalesce("_more", F.lit(0))).alias("size"),
                F.when(has, F.col("depth") + F.col("_depth")).otherwise(F.col("depth")).alias("depth"), F.when(has, F.col("_top")).otherwise(F.col("top")).alias("top"),
                F.when(found, F.col("_near")).otherwise(F.col("near")).alias("near"), F.when(found, F.lit(step) + F.col("_off")).otherwise(F.col("off")).alias("off"),
                F.when(has, F.least("low", "_low")).otherwise(F.col("low")).alias("low"), F.coalesce("up_leaves", F.when(has, F.col("_leaves"))).alias("up_leaves"),
                F.when(has, F.concat("jumps", F.array("jump"))).otherwise(F.col("jumps")).alias("jumps"),
            ), n, open=has, loops=F.col("low") == F.col("part"))
            step *= 2
        # a last round that finished no part gave none a farther ancestor either
        self.rounds = max(self.rounds, step.bit_length() - 1 - (seen["open"] > 0))
        cut = F.col("low") == F.col("part")
        rest = state.where(has).select("part", F.when(~cut, F.col("up")).alias("up"), "leaves", "root", (F.col("entry") | cut).alias("entry"))
        return state.where(~has), rest, seen["open"]

    def _over(self, table: DataFrame, k: int, value: str, add) -> DataFrame:
        """table with `value` extended by that of the part 2^k links above; add(own, above)."""
        jump = F.get("jumps", F.lit(k))
        look = table.select(F.col("part").alias("_key"), F.col(value).alias("_above"))
        met = join_unique(table.withColumn("_key", F.coalesce(jump, "part")), look, "_key", n=self.n_nodes)
        return met.withColumn(value, F.when(jump.isNotNull(), add(F.col(value), F.col("_above"))).otherwise(F.col(value))).drop("_key", "_above")

    # --- the small graph of entries --------------------------------------------------------------

    def _small_graph(self) -> None:
        """tails: (src, head, pos, w, at, span, tail, cross): the links between segments, from the entry src over a part `tail` of its segment at pos."""
        ups = self.nodes.select(F.col("part").alias("child"), F.col("up").alias("_up"))
        cross = join_unique(self.inner, ups, "child", n=self.n_inner_links).where("_up is null or _up <> parent").select("parent", "child", F.lit(1).alias("cross"))
        nest = self.nodes.where("entry and up is not null").select(F.col("up").alias("parent"), F.col("part").alias("child"), F.lit(0).alias("cross"))
        found, n, _ = self._step(cross.unionByName(nest), self.n_inner_links)
        own = self.nodes.select(F.col("part").alias("parent"), F.col("near").alias("src"), F.col("pre").alias("pos"), (F.col("off") + 1).alias("w"), F.col("depth").alias("at"))
        spans = self.nodes.where("entry").select(F.col("part").alias("src"), F.col("size").alias("span"))
        self.tails, self.n_tails, _ = self._step(join_unique(join_unique(found, own, "parent", "inner", n=n), spans, "src", "inner", n=n).select("src", F.col("child").alias("head"), "pos", "w", "at", "span", F.col("parent").alias("tail"), "cross"), max(n, 1))
        self.bits = max(1, (self.n_edges + self.n_nodes).bit_length())

    def _trimmed(self, both: bool) -> tuple[DataFrame, int]:
        """The links between entries that are never processed: upward, those whose head is none that is done; with both, likewise downward."""
        left, n = self.tails, self.n_tails
        before = None
        while n and n != before:
            before = n
            kept = left.join(left.select(F.col("src").alias("head")).distinct(), "head", "left_semi")
            if both:
                kept = kept.join(left.select(F.col("head").alias("src")).distinct(), "src", "left_semi")
            left, n, _ = self._step(kept, n)
        return left, n

    @property
    def has_cycle(self) -> bool:
        """Whether a part contains itself, directly or indirectly."""
        return self._trimmed(True)[1] > 0

    # --- results ---------------------------------------------------------------------------------

    def roots(self) -> DataFrame:
        """(part): parents of another part that are no other part's child."""
        return self.nodes.where("root").select("part")

    def _all_places(self, with_paths: bool) -> DataFrame:
        """(top, pos, part, depth[, path]): every place of the forest, those of parts without children included."""
        if with_paths not in self._places:
            nodes = self.nodes
            if with_paths:
                table = nodes.select("part", "jumps", F.array("part").alias("path"))
                for k in range(self.rounds):
                    table, _, _ = self._step(self._over(table, k, "path", lambda a, b: F.concat(b, a)), self.n_nodes)
                nodes = nodes.join(table.select("part", "path"), "part")
            path = ["path"] if with_paths else []
            own = nodes.select("top", F.col("pre").alias("pos"), "part", "depth", *path)
            ranked = prefix_sums(self.leaf_links.withColumn("one", F.lit(1)), "parent", "child", "one", "rank")
            stored, n, _ = self.cuts.write(ranked.select("parent", "child", "rank"))
            above = nodes.select(F.col("part").alias("parent"), "top", "pre", "depth", *path)
            leaves = join_unique(stored, above, "parent", "inner", n=n).select("top", (F.col("pre") + F.col("rank") + 1).alias("pos"), F.col("child").alias("part"), (F.col("depth") + 1).alias("depth"), *[F.concat("path", F.array("child")).alias("path")] * with_paths)
            self._places[with_paths] = self.cuts.write(own.unionByName(leaves))[0]
        return self._places[with_paths]

    def _entries_reached(self, seeds: DataFrame, n: int, with_paths: bool) -> tuple[DataFrame, int]:
        """(root, head, level, cross[, path]): the entries that each seed reaches over a link between segments, with the fewest links.

        cross is 0 if the forest link is such a shortest way, so that the range above holds the entry's. Every round follows the links of
        the entries that became nearer; a round meets the links once and the entries known so far once.
        """
        tails = self.tails
        path_of = ["path"] if with_paths else []
        if with_paths:
            paths = self._all_places(True).join(self.nodes.select("part", "top", F.col("pre").alias("pos")), ["top", "pos", "part"]).select(F.col("part").alias("tail"), "path")
            trail = F.concat(F.slice("path", F.size("path") - F.col("w") + 2, F.col("w") - 1), F.array("head"))
            tails, _, _ = self._step(tails.join(paths, "tail").withColumn("trail", trail), self.n_tails)
        began = seeds.select("root", F.col("near").alias("src"), F.col("pre").alias("lo"), F.col("last").alias("hi"), F.col("depth").alias("_depth"))
        points = tails.select("src", "pos", "span", "head", "at", "cross", *["path"] * with_paths)
        way = F.concat(F.slice("path", F.col("_depth") + 1, F.col("at") - F.col("_depth") + 1), F.array("head")) if with_paths else None
        best = lambda df: df.groupBy("root", "head").agg(F.min(F.struct("level", *path_of, "cross")).alias("m"))
        met = contained(began, points, "src", self.bits).select("root", "head", (F.col("at") - F.col("_depth") + 1).cast("long").alias("level"), "cross", *[way.alias("path")] if with_paths else [])
        known, n_known, seen = self._step(best(met).select("root", "head", "m", F.lit(True).alias("new")), max(n, self.n_tails), new=F.lit(True))
        while seen["new"]:
            salts = max(1, min(MOST_SALTS, seen["new"] // ROWS_PER_SALT))
            front = known.where("new").select("root", F.col("head").alias("src"), "m", F.pmod(F.xxhash64("root"), F.lit(salts)).cast("int").alias("_salt"))
            onward = tails.select("src", "head", "w", "cross", *["trail"] * with_paths, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
            moved = front.join(onward, ["src", "_salt"]).select("root", "head", (F.col("m.level") + F.col("w")).alias("level"), "cross", *[F.concat("m.path", "trail").alias("path")] * with_paths)
            both = known.select("root", "head", "m").join(best(moved).withColumnRenamed("m", "got"), ["root", "head"], "full_outer")
            nearer = F.col("m").isNull() | F.coalesce(F.col("got") < F.col("m"), F.lit(False))
            known, n_known, seen = self._step(both.select("root", "head", F.when(nearer, F.col("got")).otherwise(F.col("m")).alias("m"), nearer.alias("new")), max(n_known, seen["new"]), new=F.col("new"))
        return known.select("root", "head", F.col("m.level").alias("level"), F.col("m.cross").alias("cross"), *[F.col("m.path").alias("path")] * with_paths), n_known

    def places(self, with_paths: bool = False, seeds: DataFrame | None = None) -> DataFrame:
        """(root, part, level[, path]): one row per root and part reachable from it, roots included at level 0.

        seeds: the parts (part) to start from instead of the roots; all parents give the whole closure. level = fewest links from the
        root. path: the keys from the root to the part over that many links, of several such the smallest.
        """
        start = self.roots() if seeds is None else seeds.select("part").where("part is not null").distinct()
        mine = start.join(self.nodes, "part").select(F.col("part").alias("root"), "part", "near", "top", "pre", "last", "depth")
        began, n, _ = self._step(mine, self.n_nodes)
        reached, _ = self._entries_reached(began, n, with_paths)
        path_of = [F.col("path")] if with_paths else []
        ends = self.nodes.where("entry").select(F.col("part").alias("head"), "top", F.col("pre").alias("lo"), F.col("last").alias("hi"), F.col("depth").alias("from"))
        own = began.select("root", "top", F.col("pre").alias("lo"), F.col("last").alias("hi"), F.col("depth").alias("from"), F.lit(0).cast("long").alias("level"), *[F.array("part").alias("way")] * with_paths)
        ranges = own.unionByName(reached.where("cross = 1").join(ends, "head").select("root", "top", "lo", "hi", "from", "level", *[c.alias("way") for c in path_of]))
        stretch = F.explode(F.sequence(F.expr(f"lo div {STRETCH}"), F.expr(f"hi div {STRETCH}")))
        cut = ranges.withColumn("_s", stretch).withColumn("lo", F.greatest("lo", F.col("_s") * STRETCH)).withColumn("hi", F.least("hi", (F.col("_s") + 1) * STRETCH - 1)).drop("_s")
        listed = cut.repartition("root", "lo").select("root", "top", F.explode(F.sequence("lo", "hi")).alias("pos"), "from", "level", *["way"] * with_paths)
        met = listed.join(self._all_places(with_paths), ["top", "pos"])
        below = met.select("root", "part", (F.col("level") + F.col("depth") - F.col("from")).alias("level"), *[F.concat("way", F.slice("path", F.col("from") + 2, F.greatest(F.col("depth") - F.col("from"), F.lit(0)))).alias("path")] * with_paths)
        if with_paths:
            out = below.groupBy("root", "part").agg(F.min(F.struct("level", "path")).alias("m")).select("root", "part", "m.level", "m.path")
        else:
            out = below.groupBy("root", "part").agg(F.min("level").alias("level"))
        if seeds is None:
            return out
        bare = start.join(self.nodes.select("part"), "part", "left_anti")
        return out.unionByName(bare.select(F.col("part").alias("root"), "part", F.lit(0).cast("long").alias("level"), *[F.array("part").alias("path")] * with_paths))

    def longest(self) -> tuple[DataFrame, DataFrame]:
        """((part, depth): the longest chain below every part with children that can't reach a cycle; (part): those that can)."""
        loops, n_loops = self._trimmed(False)
        ever = loops.select(F.col("src").alias("head")).distinct().withColumn("_ever", F.lit(True))
        deep, _, _ = self._step(self.nodes.groupBy(F.col("near").alias("entry_key")).agg(F.max(F.col("off") + (F.col("leaves") > 0).cast("int")).cast("double").alias("long")), self.n_nodes)
        # longest way from each entry: rounds over the links between entries that can't reach a cycle
        sound, n_sound, _ = self._step(self.tails.join(ever.select(F.col("head").alias("src")), "src", "left_anti").select("src", "head", "w").groupBy("src", "head").agg(F.max("w").alias("w")), max(self.n_tails, 1))
        changed = n_sound
        while changed:
            onward = sound.join(deep.withColumnRenamed("entry_key", "head"), "head").groupBy(F.col("src").alias("entry_key")).agg(F.max(F.col("w") + F.col("long")).alias("_far"))
            grown = F.coalesce(F.col("_far") > F.col("long"), F.lit(False))
            deep, _, seen = self._step(deep.join(onward, "entry_key", "left").select("entry_key", F.greatest("long", "_far").alias("long"), grown.alias("_g")), self.n_nodes, grown=F.col("_g"))
            deep, changed = deep.drop("_g"), seen["grown"]
        # upward over the forest: the farthest place below each part, without end where a link leads to an entry without end
        via = self.tails.join(deep.withColumnRenamed("entry_key", "head"), "head", "left").join(ever, "head", "left").select(F.col("tail").alias("part"), F.when(F.col("_ever"), F.lit(float("inf"))).otherwise(1 + F.coalesce("long", F.lit(0.0))).alias("far"))
        far = self.nodes.select("part", F.col("leaves").cast("boolean").cast("double").alias("far")).unionByName(via).groupBy("part").agg(F.max("far").alias("far"))
        table, _, _ = self._step(self.nodes.select("part", "depth", "jumps").join(far, "part").withColumn("far", F.col("far") + F.col("depth")), self.n_nodes)
        for k in range(self.rounds):
            jump = F.get("jumps", F.lit(k))
            up = table.where(jump.isNotNull()).groupBy(jump.alias("part")).agg(F.max("far").alias("_far"))
            table, _, _ = self._step(table.join(up, "part", "left").withColumn("far", F.greatest("far", "_far")).drop("_far"), self.n_nodes)
        endless = F.col("far") == float("inf")
        return table.where(~endless).select("part", (F.col("far") - F.col("depth")).cast("int").alias("depth")), table.where(endless).select("part")

    # --- cycles ----------------------------------------------------------------------------------

    def cycles(self) -> DataFrame:
        """(group_key, part): every part that can be reached from itself, with the smallest key of those it reaches and that reach it."""
        core, n = self._trimmed(True)
        if not n:
            return self.spark.createDataFrame([], "group_key string, part string")
        labels = self._components(core.select(F.col("src").alias("parent"), F.col("head").alias("child")).distinct(), n)
        side = lambda c, out: labels.select(F.col("part").alias(c), F.col("label").alias(out))
        inside, n, _ = self._step(core.join(side("src", "_a"), "src").join(side("head", "_b"), "head").where("_a = _b").select("src", "pos", "span", F.col("_a").alias("label")), n)
        near = self.nodes.join(inside.select(F.col("src").alias("near")).distinct(), "near", "left_semi").select("part", F.col("near").alias("src"), F.col("pre").alias("lo"), F.col("last").alias("hi"))
        members, _, _ = self._step(contained(near, inside, "src", self.bits).select("label", "part").distinct(), self.n_nodes)
        least = members.groupBy("label").agg(F.min("part").alias("group_key"))
        return members.join(least, "label").select("group_key", "part")

    def _components(self, edges: DataFrame, n: int) -> DataFrame:
        """(part, label): strongly connected components of the links (parent, child) by labels: f = smallest key that reaches a part, b = smallest it reaches.

        Parts with f = b belong to that key's component. All members of a component share f and b, so the links
        between other parts with the same (f, b) remain for the next round; the smallest key of every remaining
        weak component settles at least itself, so the rounds end. Parts that lose their last link have a component of their own.
        """
        nodes = edges.select(F.col("parent").alias("part")).union(edges.select(F.col("child").alias("part"))).distinct()
        every, n_nodes, _ = self._step(nodes, n)
        settled: list[DataFrame] = []
        edges, n, _ = self._step(edges.where("parent <> child"), n)
        while n:
            labels = self._spread(edges, n)
            settled.append(labels.where("f = b").select("part", F.col("f").alias("label")))
            left = labels.where("f <> b")
            ends = lambda c: left.select(F.col("part").alias(c), F.col("f").alias(f"f_{c}"), F.col("b").alias(f"b_{c}"))
            edges, n, _ = self._step(edges.join(ends("parent"), "parent").join(ends("child"), "child").where("f_parent = f_child and b_parent = b_child").select("parent", "child"), n)
        if not settled:
            return every.withColumn("label", F.col("part"))
        found = reduce(DataFrame.unionByName, settled)
        return every.join(found, "part", "left").withColumn("label", F.coalesce("label", "part"))

    def _spread(self, edges: DataFrame, n: int) -> DataFrame:
        """(part, f, b): the smallest key that reaches a part and the smallest that it reaches, its own included; both spread in the same rounds."""
        nodes = edges.select(F.col("parent").alias("part")).union(edges.select(F.col("child").alias("part"))).distinct()
        labels, n, seen = self._step(nodes.select("part", F.col("part").alias("f"), F.col("part").alias("b"), F.lit(True).alias("new")), n, new=F.lit(True))
        none = F.lit(None).cast("string")
        ways = edges.select(F.inline(F.array(F.struct(F.col("parent").alias("part"), F.col("child").alias("to"), F.lit(True).alias("on")), F.struct(F.col("child").alias("part"), F.col("parent").alias("to"), F.lit(False).alias("on")))))
        while seen["new"]:
            met = labels.where("new").join(ways, "part")
            sent = met.groupBy(F.col("to").alias("part")).agg(F.min(F.when(F.col("on"), F.col("f")).otherwise(none)).alias("gf"), F.min(F.when(~F.col("on"), F.col("b")).otherwise(none)).alias("gb"))
            less = F.coalesce(F.col("gf") < F.col("f"), F.lit(False)) | F.coalesce(F.col("gb") < F.col("b"), F.lit(False))
            labels, n, seen = self._step(labels.join(sent, "part", "left").select("part", F.least("f", "gf").alias("f"), F.least("b", "gb").alias("b"), less.alias("new")), n, new=F.col("new"))
        return labels.select("part", "f", "b")


def below(h: Hierarchy, part: str) -> DataFrame:
    """(part, levels): the places of the forest below a part, by its range."""
    me = h.nodes.where(F.col("part") == part).select("top", F.col("pre").alias("lo"), F.col("last").alias("hi"), F.col("depth").alias("from"))
    return h._all_places(False).join(F.broadcast(me), "top").where("pos > lo and pos <= hi").select("part", (F.col("depth") - F.col("from")).alias("levels"))


def above(h: Hierarchy, part: str) -> DataFrame:
    """(part, levels): the parts above the places of a part in the forest: those whose range holds one; the fewest links count."""
    me = h._all_places(False).where(F.col("part") == part).select("top", "pos", F.col("depth").alias("at"))
    tops = h.nodes.select("part", "top", "pre", "last", "depth")
    met = tops.join(me, "top").where("pre < pos and last >= pos")
    return met.groupBy("part").agg(F.min(F.col("at") - F.col("depth")).alias("levels"))
