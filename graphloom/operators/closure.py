"""Transitive closures by a semi-naive loop, and what is read off them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..terms import A, SUBCLASS

#: Rows up to which a table of the ontology's size is broadcast, by its count.
SMALL = 300_000


#: Rows read for each task of a shuffle, the compressed bytes up to which Spark may put small tasks together, and those of a file that a task reads.
#: A triple takes some 220 bytes in an operator's memory and 16 in a shuffle's file.
TASK_ROWS, TASK_BYTES, FILE_BYTES = 200_000, "4m", "4m"
_rows_of: dict[tuple[str, ...], int] = {}

#: Edges from which a closure is found by chains, nodes of a chain that stand together, and pairs for each task that spells them out.
MANY, BLOCK, TASK_PAIRS = 20_000, 512, 4_000_000


def rows_read(df: DataFrame) -> int:
    """How many rows the Parquet files have that ``df`` reads, by their footers."""
    files = tuple(sorted(f for f in df.inputFiles() if f.endswith(".parquet")))
    if files and files not in _rows_of:
        _rows_of[files] = df.sparkSession.read.option("recursiveFileLookup", True).parquet(*files).count()
    return _rows_of.get(files, 0)


def widen(df: DataFrame) -> DataFrame:
    """``df``, whose shuffles from here on have a task for so many of the rows that it reads, however many the session asks for.

    With a fixed number of tasks the memory of each grows with the input.  The session's number is raised, never lowered;
    Spark puts small tasks together up to TASK_BYTES and reads files in pieces of FILE_BYTES, unless the session says otherwise.
    """
    conf = df.sparkSession.conf
    n = rows_read(df) // TASK_ROWS
    if n > int(conf.get("spark.sql.shuffle.partitions")):
        conf.set("spark.sql.shuffle.partitions", str(n))
        for limit, size in (("spark.sql.adaptive.advisoryPartitionSizeInBytes", TASK_BYTES), ("spark.sql.files.maxPartitionBytes", FILE_BYTES)):
            if conf.get(limit, None) is None:
                conf.set(limit, size)
    return df


def shared_folder(df: DataFrame) -> str:
    """The folder named by spark.checkpoint.dir, made the checkpoint folder (a temporary one in local tests)."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            named = tempfile.mkdtemp(prefix="graphloom-")
        sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    shared_folder(df)
    return df.checkpoint()


def stored(g: DataFrame) -> DataFrame:
    """A graph as a table in the shared folder, by predicate, so that each later scan reads the predicates that it asks for only."""
    path = f"{shared_folder(g)}/graph-{uuid.uuid4().hex}"
    widen(g).select("s", "p", "o").sortWithinPartitions("p", "s").write.parquet(path)
    return g.sparkSession.read.schema("s string, p string, o string").parquet(path)


def reach(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(s, o) pairs joined by one or more edges (s, o); ``start`` (column s) limits where walks begin.

    From a start, each round extends only the pairs that are new, one edge further.  From everywhere, a
    round doubles the length of the walks: a shortest walk of more than n and at most 2n edges is
    one of exactly n and one of at most n, so only those of exactly n are extended, by all that are known.
    Rounds are then the logarithm of the longest shortest walk.  Cycles end, no pair is kept twice.
    What a round finds is written once; only every eighth round are the parts put together.
    Of many edges, long chains are told apart first, and pairs are neither shuffled nor written.
    """
    edges = edges.select("s", "o").distinct()
    if start is not None:
        return _stepwise(edges, start)
    edges = cut(edges)
    n = edges.count()
    return edges if n == 0 else _doubled(edges) if n <= MANY else _by_chains(edges)


def _doubled(edges: DataFrame) -> DataFrame:
    known = longest = edges.withColumn("n", F.lit(1).cast("bigint"))
    reached = 1
    while True:
        more = known.select(F.col("s").alias("_m"), F.col("o").alias("_o"), F.col("n").alias("_n"))
        far = longest.join(more, F.col("o") == F.col("_m")).groupBy("s", F.col("_o").alias("o")).agg(F.min(F.col("n") + F.col("_n")).alias("n"))
        new = cut(far.join(known, ["s", "o"], "left_anti"))
        reached *= 2
        longest = new.where(F.col("n") == reached)
        if new.isEmpty():
            return known.select("s", "o")
        known = known.unionByName(new)
        if longest.isEmpty():
            return known.select("s", "o")


def _chains(edges: DataFrame) -> DataFrame:
    """(node, chain, at): nodes put one after the other along edges, each chain named by its first node.

    A node goes on to the successor that has the fewest edges into it, where that one takes it as its predecessor with the fewest
    edges out of it.  Places are found by doubling; in the last round that moves any node, as many move as before
    only if all of them lie on circles, and each such node is a chain of its own.
    """
    many = lambda c: edges.groupBy(c).agg(F.count(F.lit(1)).alias(f"_{c}"))
    e = edges.where("s <> o").join(many("s"), "s").join(many("o"), "o")
    on = e.groupBy("s").agg(F.min(F.struct("_o", "o")).alias("m")).select("s", F.col("m.o").alias("o"))
    back = e.groupBy("o").agg(F.min(F.struct("_s", "s")).alias("m")).select(F.col("m.s").alias("s"), "o")
    nodes = edges.select(F.explode(F.array("s", "o")).alias("node")).distinct()
    links = on.join(back, ["s", "o"]).select(F.col("o").alias("node"), "s")
    known = cut(nodes.join(links, "node", "left").select("node", F.coalesce("s", "node").alias("first"), F.col("s").isNotNull().cast("bigint").alias("at"), F.col("s").isNotNull().alias("moves")))
    before = known.where("moves").count()
    while before:
        far = known.select(F.col("node").alias("first"), F.col("first").alias("_f"), F.col("at").alias("_at"))
        moved = known.where("moves").join(far, "first").select("node", F.col("_f").alias("first"), (F.col("at") + F.col("_at")).alias("at"), (F.col("_at") > 0).alias("moves"))
        known = cut(known.where(~F.col("moves")).unionByName(moved))
        n = known.where("moves").count()
        if n == before:
            break
        before = n
    return known.select("node", F.when(F.col("moves"), F.col("node")).otherwise(F.col("first")).alias("chain"), F.when(F.col("moves"), F.lit(0)).otherwise(F.col("at")).cast("bigint").alias("at"))


def _by_chains(edges: DataFrame) -> DataFrame:
    """What ``_doubled`` finds, for graphs with long chains.

    Whoever reaches a place on a chain reaches all after it, so a node keeps one row for each chain that it reaches: the first place.
    Edges between chains that another one says already (it leaves no earlier and arrives no later) are left out; ends of the
    others, and the stretches of chain between them, are a smaller graph, whose closure is doubled.  Pairs are
    spelled out at the end, in a join of these rows with blocks of chains.
    """
    spark, places = edges.sparkSession, cut(_chains(edges))
    end = lambda c, chain, at: places.select(F.col("node").alias(c), F.col("chain").alias(chain), F.col("at").alias(at))
    across = edges.join(end("s", "c", "p"), "s").join(end("o", "d", "m"), "o").where((F.col("c") != F.col("d")) | (F.col("m") <= F.col("p")))
    first = across.groupBy("c", "d", "p").agg(F.min("m").alias("m")).groupBy("c", "d", "m").agg(F.max("p").alias("p"))
    later = Window.partitionBy("c", "d").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, -1)
    steps = first.withColumn("_m", F.min("m").over(later)).where("_m is null or m < _m").select("c", "p", "d", "m")
    steps = cut(steps.join(end("s", "c", "p"), ["c", "p"]).join(end("o", "d", "m"), ["d", "m"]))
    ends = steps.select("s", "c", "p").unionByName(steps.select(F.col("o").alias("s"), F.col("d").alias("c"), F.col("m").alias("p"))).distinct()
    along = ends.select("s", F.lead("s").over(Window.partitionBy("c").orderBy("p")).alias("o")).where("o is not null")
    between = cut(steps.select("s", "o").unionByName(along).distinct())
    far = between if between.isEmpty() else _doubled(between)
    far = far.join(steps.select("s", F.col("c").alias("chain"), F.col("p").alias("leaves")).distinct(), "s").join(steps.select("o", "d", "m").distinct(), "o")
    far = far.groupBy("chain", "leaves", "d").agg(F.min("m").alias("m"))

    exits = steps.select(F.col("c").alias("chain"), F.col("p").alias("at"), F.col("p").alias("exit")).distinct()
    onward = Window.partitionBy("chain").orderBy(F.desc("at"))
    nodes = places.join(exits, ["chain", "at"], "left")
    nodes = nodes.withColumn("leaves", F.last("exit", True).over(onward.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_last", F.lag("at").over(onward).isNull())
    nodes = cut(nodes.select("node", "chain", "at", "leaves", "_last"))
    own = nodes.where(~F.col("_last")).select(F.col("node").alias("s"), F.col("chain").alias("d"), (F.col("at") + 1).alias("m"))
    rows = own.unionByName(nodes.join(far, ["chain", "leaves"]).select(F.col("node").alias("s"), "d", "m")).groupBy("s", "d").agg(F.min("m").alias("m"))
    rows = cut(rows.join(nodes.where("_last").select(F.col("chain").alias("d"), F.col("at").alias("_to")), "d"))

    tasks = int(rows.agg(F.sum(F.col("_to") - F.col("m") + 1)).first()[0] or 0) // TASK_PAIRS
    tasks = max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    block = lambda c: F.floor(F.col(c) / BLOCK)
    rows = rows.select("s", "d", "m", F.explode(F.sequence(block("m"), block("_to"))).alias("block"))
    members = places.select(F.col("chain").alias("d"), block("at").alias("block"), "at", F.col("node").alias("o"))
    return rows.repartition(tasks, "d", "block").join(members.repartition(tasks, "d", "block"), ["d", "block"]).where("at >= m").select("s", "o")


def _stepwise(edges: DataFrame, start: DataFrame) -> DataFrame:
    known = new = cut(edges.join(start.select("s").distinct(), "s", "left_semi"))
    step = edges.select(F.col("s").alias("_m"), F.col("o").alias("_o"))
    parts = 1
    while True:
        far = new.join(step, F.col("o") == F.col("_m")).select("s", F.col("_o").alias("o")).distinct()
        new = cut(far.join(known, ["s", "o"], "left_anti"))
        if new.isEmpty():
            return known
        known, parts = known.unionByName(new), parts + 1
        if parts % 8 == 0:
            known = cut(known)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of undirected edges (s, o): each component is named by its least node.

    Nodes hook onto the least of their neighbours and of those that these hang on, in turn, until nothing
    changes; the rounds grow with the logarithm of the longest shortest way.
    """
    e = cut(edges.select(F.greatest("s", "o").alias("u"), F.least("s", "o").alias("v")).distinct())
    nodes = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    e = e.where("u <> v")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new = cut(small)
        if new.exceptAll(e).isEmpty() and e.exceptAll(new).isEmpty():
            return nodes.join(e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        e = new


def with_self(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pairs`` and (n, n) for each of ``nodes`` (column s)."""
    return pairs.unionByName(nodes.select("s", F.col("s").alias("o"))).distinct()


def ancestors(g: DataFrame, predicate: str = SUBCLASS) -> DataFrame:
    """(child, ancestor) over a hierarchy predicate, reflexive over its nodes."""
    edges = g.where(F.col("p") == predicate).select("s", "o")
    nodes = edges.select(F.explode(F.array("s", "o")).alias("s")).distinct()
    return with_self(reach(edges), nodes).select(F.col("s").alias("child"), F.col("o").alias("ancestor"))


def instances(g: DataFrame, classes: DataFrame | list[str], hierarchy: DataFrame | None = None) -> DataFrame:
    """(node, class) for the instances of the classes (column class) or of their subclasses."""
    if isinstance(classes, list):
        classes = g.sparkSession.createDataFrame([(c,) for c in classes], "class string")
    up = ancestors(g) if hierarchy is None else hierarchy
    kinds = up.join(classes.select(F.col("class").alias("ancestor")), "ancestor").select(F.col("child").alias("_t"), F.col("ancestor").alias("class"))
    kinds = kinds.unionByName(classes.select(F.col("class").alias("_t"), "class")).distinct()
    if kinds.count() <= SMALL:  # few classes have all the types between them: no task per class
        kinds = F.broadcast(kinds)
    return g.where(F.col("p") == A).join(kinds, F.col("o") == F.col("_t")).select(F.col("s").alias("node"), "class").distinct()


def imports(edges: DataFrame, root: str, limit: int = -1) -> DataFrame:
    """(name, depth) of what ``root`` imports over (s, o) edges, up to ``limit`` steps away (-1: all); the root has depth 0."""
    spark = edges.sparkSession
    known = front = spark.createDataFrame([(root, 0)], "name string, depth int")
    depth = 0
    while limit < 0 or depth < limit:
        depth += 1
        step = edges.join(front.select(F.col("name").alias("s")), "s").select(F.col("o").alias("name")).distinct()
        front = cut(step.join(known, "name", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        known = cut(known.unionByName(front))
    return known
