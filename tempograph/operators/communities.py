"""Communities: label propagation, their building and upkeep."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempograph.sources.tables import written


#: Groups that may be broadcast, a few numbers each: where groups are few, one may have most nodes.
FEW_GROUPS = 500_000


def propagate(nodes: list[str], edges: list[tuple[str, str]]) -> dict[str, int]:
    """Synchronous label propagation over nodes in order; labels start as places.

    A neighbour's label weighs its parallel edges (a self loop counts twice); of equal weights the larger
    label wins.  The best is taken if its weight is above 1, else the larger of best and own.  Ends when
    nothing changes or after max(100, n squared) rounds.
    """
    nodes = list(dict.fromkeys(nodes))
    place = {u: i for i, u in enumerate(nodes)}
    near: list[Counter[int]] = [Counter() for _ in nodes]
    for a, b in edges:
        if a in place and b in place:
            near[place[a]][place[b]] += 1
            near[place[b]][place[a]] += 1
    label = list(range(len(nodes)))
    rounds, before = max(100, len(nodes) ** 2), None
    for k in range(rounds):
        new = label[:]
        for i, ns in enumerate(near):
            if ns:
                weight: Counter[int] = Counter()
                for j, n in ns.items():
                    weight[label[j]] += n
                n, best = max((n, x) for x, n in weight.items())
                new[i] = best if n > 1 else max(best, label[i])
        if new == label:
            break
        if new == before:  # two states in turn: the last round decides which is left
            label = new if (rounds - k - 1) % 2 == 0 else label
            break
        before, label = label, new
    return {u: label[place[u]] for u in nodes}


def label_propagation(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """(group_id, uuid, label, n_members): clusters never cross groups; nodes in order of uuid descending.  As propagate() of each group, by rounds of joins."""
    got = propagate_rounds(entities, facts)
    n = got.groupBy(F.col("group_id").alias("g"), F.col("label").alias("l")).agg(F.count("*").alias("n_members"))
    return got.join(n, F.col("group_id").eqNullSafe(F.col("g")) & (F.col("label") == F.col("l"))).select("group_id", "uuid", "label", "n_members")


def propagate_rounds(entities: DataFrame, facts: DataFrame, rounds: int | None = None, written=written) -> DataFrame:  # noqa: ANN001
    """(uuid, group_id, label) of propagate() for all groups at once, or of at most ``rounds`` of its rounds: two shuffles of the weighed links a round, as numbers.

    A round gives each node its new label beside its last two.  It is over when every group has nothing changed, or the state
    of two rounds before: which of both is left then, the number of the group's rounds decides.
    """
    e = entities.select("uuid", "group_id").dropDuplicates(["uuid"])
    # places over all groups, of range partitions that begin after each other; the driver holds a number for each
    at = written(e.orderBy("group_id", F.desc("uuid")).select("uuid", "group_id", F.monotonically_increasing_id().alias("at")))
    total, before = 0, []
    for r in at.groupBy(F.shiftright("at", 33).alias("p")).count().orderBy("p").collect():
        before.append((r["p"], total))
        total += r["count"]
    starts = F.broadcast(at.sparkSession.createDataFrame(before, "p long, before long"))
    node = at.join(starts, F.shiftright("at", 33) == F.col("p")).select("uuid", "group_id", (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("k"))
    group = written(node.groupBy(F.col("group_id").alias("g")).agg(F.min("k").alias("first"), F.count("*").alias("size")))
    group = F.broadcast(group) if group.count() <= FEW_GROUPS else group
    node = written(node.join(group, F.col("group_id").eqNullSafe(F.col("g"))).select("uuid", "group_id", "k", "first", "size"))
    own = lambda end, k: node.where("group_id is not null").select(F.col("uuid").alias(end), F.col("k").alias(k), F.col("first").alias(f"{k}_g"))
    f = facts.select("source_node_uuid", "target_node_uuid").join(own("target_node_uuid", "b"), "target_node_uuid").join(own("source_node_uuid", "a"), "source_node_uuid").where("a_g = b_g")
    both = f.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"))
    g = written(both.groupBy("x.a", "x.b").agg(F.count("*").alias("n")))
    label = node.select("k", "first", F.col("k").alias("label"), F.lit(None).cast("long").alias("old"))
    most, done = max(100, (node.agg(F.max("size")).first()[0] or 0) ** 2) if rounds is None else rounds, 0
    while done < most:
        w = g.join(label.select(F.col("k").alias("b"), "label"), "b").select("a", "label", "n")
        best = w.groupBy("a", "label").agg(F.sum("n").alias("n")).groupBy("a").agg(F.max(F.struct("n", "label")).alias("m")).select(F.col("a").alias("k"), F.col("m.n").alias("n"), F.col("m.label").alias("best"))
        best = label.join(best, "k", "left")
        new = F.when(F.col("n") > 1, F.col("best")).otherwise(F.greatest("label", F.coalesce("best", "label")))
        state = written(best.select("k", "first", new.alias("label"), F.col("label").alias("old"), F.col("old").alias("older")))
        done += 1
        open_ = state.groupBy("first").agg(F.max((F.col("label") != F.col("old")).cast("int")).alias("moved"), F.max((~F.col("label").eqNullSafe(F.col("older"))).cast("int")).alias("other"))
        label = state.drop("older")
        if not open_.where("moved = 1 and other = 1").head(1):
            break
    last = F.greatest(F.lit(100).cast("decimal(38,0)"), F.col("size").cast("decimal(19,0)") * F.col("size").cast("decimal(19,0)")) if rounds is None else F.lit(done)
    # what turns between two states ends in the last if as many rounds as are left bring it back
    out = node.drop("first").join(label.select("k", "first", "label", "old"), "k")
    return out.select("uuid", "group_id", (F.when((last - done) % 2 == 0, F.col("label")).otherwise(F.coalesce("old", "label")) - F.col("first")).cast("long").alias("label"))


def summarize_tree(summaries: list[str], combine) -> str:  # noqa: ANN001
    """Pairwise reduction: halves pair i with i + n // 2, an odd last one is carried."""
    while len(summaries) > 1:
        half = len(summaries) // 2
        rest = summaries[2 * half :]
        summaries = [combine(summaries[i], summaries[i + half]) for i in range(half)] + rest
    return summaries[0] if summaries else ""


def build(entities: DataFrame, clusters: DataFrame, most: int = 500) -> tuple[DataFrame, DataFrame]:
    """Community rows and has_member rows of clusters of two or more, with the deterministic text fallback."""
    c = clusters.where("n_members > 1").join(entities.select("uuid", "name", "summary"), "uuid")
    c = c.withColumn("community", F.sha2(F.concat_ws("|", F.lit("community"), "group_id", F.col("label").cast("string")), 256))
    rows = F.array_sort(F.collect_list(F.struct("uuid", "name", "summary")))
    g = c.groupBy("community", "group_id").agg(rows.alias("m"))
    texts = F.filter(F.transform("m", lambda x: F.trim(F.coalesce(x["summary"], F.lit("")))), lambda s: s != "")
    names = F.filter(F.transform("m", lambda x: x["name"]), lambda s: F.trim(F.coalesce(s, F.lit(""))) != "")
    lower = F.transform(names, F.lower)
    firsts = F.filter(names, lambda n, i: F.array_position(lower, F.lower(n)) == i + 1)
    out = g.select(F.col("community").alias("uuid"), F.concat(F.lit("Community: "), F.array_join(F.slice(firsts, 1, 3), ", ")).alias("name"), "group_id", F.substring(F.array_join(texts, "; "), 1, most).alias("summary"))
    return out, c.select(F.sha2(F.concat_ws("|", "community", "uuid"), 256).alias("uuid"), "group_id", F.col("community").alias("source_node_uuid"), F.col("uuid").alias("target_node_uuid"))


def join_community(new: DataFrame, facts: DataFrame, has_member: DataFrame) -> DataFrame:
    """(uuid, community): a new entity's own community, else its neighbours' commonest (ties: the first seen), else none."""
    own = has_member.groupBy(F.col("target_node_uuid").alias("uuid")).agg(F.min("source_node_uuid").alias("own"))
    f = facts.select("uuid", F.col("source_node_uuid").alias("a"), F.col("target_node_uuid").alias("b"))
    near = f.select("a", "b", "uuid").unionByName(f.select(F.col("b").alias("a"), F.col("a").alias("b"), "uuid")).withColumnsRenamed({"uuid": "edge"})
    n = near.join(new.select(F.col("uuid").alias("a")), "a", "left_semi").join(has_member.select(F.col("target_node_uuid").alias("b"), F.col("source_node_uuid").alias("c")), "b")
    count = n.groupBy("a", "c").agg(F.count("*").alias("n"), F.min("edge").alias("first"))
    mode = count.withColumn("k", F.row_number().over(W.partitionBy("a").orderBy(F.desc("n"), "first", "c"))).where("k = 1").select(F.col("a").alias("uuid"), F.col("c").alias("near"))
    return new.select("uuid").join(own, "uuid", "left").join(mode, "uuid", "left").select("uuid", F.coalesce("own", "near").alias("community"))
