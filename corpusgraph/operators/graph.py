"""Property-graph operators on vertex and edge tables."""

from __future__ import annotations

import unicodedata
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StringType

from corpusgraph.plans.scratch import Scratch

#: Words that are cut from the ends of entity names.
EDGE_WORDS = ("the", "a", "an", "of", "in", "on", "for", "to", "and")


@F.arrow_udf(StringType())
def _compatible(names: pa.Array) -> pa.Array:
    """Unicode NFKC. A batch of ASCII alone comes back as it is."""
    if pa.compute.all(pa.compute.string_is_ascii(names), min_count=0).as_py() is not False:
        return names.cast(pa.string())
    return pa.array([None if x is None else unicodedata.normalize("NFKC", x) for x in names.to_pylist()], pa.string())


def normalised_name(name: Column) -> Column:
    """NFKC, lower case, without edge words, punctuation and doubled blanks; '' if nothing is left."""
    words = "|".join(EDGE_WORDS)
    text = F.trim(F.lower(_compatible(F.coalesce(name, F.lit("")))))
    text = F.regexp_replace(F.regexp_replace(text, rf"^(({words})(\s+|$))+", ""), rf"((^|\s+)({words}))+$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


def consolidate_entities(mentions: DataFrame) -> DataFrame:
    """normalized_name, entity_type, name, mentions, chunks from (seq, name, entity_type, source_id); the first mention names the entity."""
    m = mentions.withColumn("normalized_name", normalised_name(F.col("name"))).where("normalized_name <> ''")
    return m.groupBy("normalized_name", "entity_type").agg(
        F.min_by("name", "seq").alias("name"), F.count("*").alias("mentions"), F.count_distinct("source_id").alias("chunks")
    )


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, degree: undirected, 0 for isolated vertices."""
    counts = both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return vertices.select("id").join(counts, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def pagerank(vertices: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 20, keep_every: int = 10) -> DataFrame:
    """id, pagerank: (1 - d) + d * sum(rank / degree) over undirected edges, parallel ones counted, without scaling."""
    scratch = Scratch(vertices.sparkSession, "pagerank")
    degree = degrees(vertices, edges)
    arcs = both_ways(edges).groupBy("src", "dst").agg(F.count("*").alias("n")).join(degree.withColumnRenamed("id", "src"), "src")
    arcs = scratch.save(arcs.select("src", "dst", (F.col("n") / F.col("degree")).alias("w")), "arcs")
    ranks = vertices.select("id", F.lit(1.0 - damping).alias("pagerank"))
    nothing = vertices.select("id", F.lit(0.0).alias("s"))
    for i in range(1, rounds + 1):
        # Vertices without a neighbour come in as rows of 0, so a round is one join and one aggregate.
        # Ranks are the small side and have one row a vertex: they are hashed, so that arcs aren't sorted in every round.
        shares = arcs.join(ranks.hint("shuffle_hash"), F.col("src") == F.col("id")).select(F.col("dst").alias("id"), (F.col("pagerank") * F.col("w")).alias("s"))
        ranks = nothing.unionAll(shares).groupBy("id").agg((F.lit(1 - damping) + F.lit(damping) * F.sum("s")).alias("pagerank"))
        if i % keep_every == 0:
            ranks = scratch.save(ranks, f"ranks{i}")
    return ranks


#: Arcs of a bucket, about; each round a task reads one bucket.
BUCKET_ARCS = 1 << 24


def _dealt(arcs: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """arcs as a table of buckets by src, and its entry in the session's catalogue: joins by src don't shuffle them."""
    spark = arcs.sparkSession
    arcs = scratch.save(arcs, "plain")
    buckets = max(spark.sparkContext.defaultParallelism, -(-arcs.count() // BUCKET_ARCS))
    entry = f"arcs_{uuid.uuid4().hex}"
    arcs.repartition(buckets, "src").write.bucketBy(buckets, "src").option("path", scratch.path("arcs")).format("parquet").saveAsTable(entry)
    scratch.free("plain")
    return spark.table(entry), entry


def pagerank_by_deltas(vertices: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, most: int = 100) -> tuple[DataFrame, list[int]]:
    """id, pagerank, as pagerank() would reach it, and the number of vertices that held more than the tolerance in each round.

    A vertex holds what its rank lacks by what its neighbours have told it. In each round all send a change, until nobody holds more
    than the tolerance, or for `most` rounds; what is held is then added. Changes are conjugate directions: arcs go both ways, so over
    degrees the equations are symmetric, which takes far fewer rounds than sending on what is held. Arcs lie in
    buckets by src and aren't shuffled; what they carry is summed in each bucket first. The driver holds a few sums a round.
    """
    scratch = Scratch(vertices.sparkSession, "deltas")
    degree = degrees(vertices.select("id").distinct(), edges)
    arcs = both_ways(edges).groupBy("src", "dst").agg(F.count("*").alias("n")).join(degree.withColumnRenamed("id", "src"), "src")
    arcs = arcs.join(vertices.select(F.col("id").alias("dst")), "dst", "left_semi")
    arcs, entry = _dealt(arcs.select("src", "dst", (F.col("n") / F.col("degree")).alias("w")), scratch)
    start = F.lit(1.0 - damping)
    table = scratch.save(degree.select("id", F.greatest("degree", F.lit(1)).alias("degree"), F.lit(0.0).alias("sent"), start.alias("held"), start.alias("step")), "0")
    state, sent = table, []
    product = lambda x, y: F.sum(F.col(x) * F.col(y) / F.col("degree"))
    rest = lambda rows: rows.agg(product("held", "held").alias("size"), F.count_if(F.abs("held") > tolerance).alias("open")).first()
    now = rest(state)
    for i in range(1, most + 1):
        if not now["open"]:
            break
        sent.append(now["open"])
        told = arcs.join(state.select(F.col("id").alias("src"), "step").where("step <> 0").hint("shuffle_hash"), "src")
        gains = told.groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("step") * F.col("w")).alias("gain"))
        left = F.col("step") - F.lit(damping) * F.coalesce("gain", F.lit(0.0))
        table = scratch.save(state.join(gains.hint("shuffle_hash"), "id", "left").select(*state.columns, left.alias("change")), f"{i}")
        scratch.free(f"{i - 1}")
        far = now["size"] / table.agg(product("step", "change")).first()[0]
        moved = table.select("id", "degree", (F.col("sent") + far * F.col("step")).alias("sent"), (F.col("held") - far * F.col("change")).alias("held"), "step")
        before, now = now, rest(moved)
        state = moved.withColumn("step", F.col("held") + F.lit(now["size"] / before["size"]) * F.col("step"))
    vertices.sparkSession.sql(f"DROP TABLE IF EXISTS {entry}")
    scratch.free("arcs")
    return state.select("id", (F.col("sent") + F.col("held")).alias("pagerank")), sent


def connected_components(vertices: DataFrame, edges: DataFrame, most: int = 50) -> DataFrame:
    """id, component: the smallest id that a vertex is connected with, by least labels and pointer jumping."""
    scratch = Scratch(vertices.sparkSession, "labels")
    both = scratch.save(both_ways(edges).distinct(), "edges")
    labels = scratch.save(vertices.select("id", F.col("id").alias("component")).distinct(), "0")
    for i in range(1, most + 1):
        near = both.join(labels, F.col("dst") == F.col("id")).groupBy("src").agg(F.min("component").alias("m"))
        hop = labels.join(near, F.col("id") == F.col("src"), "left").select("id", F.col("component").alias("was"), F.least("component", F.coalesce("m", "component")).alias("component"))
        jump = labels.select(F.col("id").alias("at"), F.col("component").alias("beyond"))
        new = scratch.save(hop.join(jump, F.col("component") == F.col("at")).select("id", "was", F.least("component", "beyond").alias("component")), f"{i}")
        if not new.where("was <> component").take(1):
            return new.select("id", "component")
        labels = new.select("id", "component")
    raise RuntimeError("components did not converge")


def neighbours(starts: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """start, id, path_length: the shortest way of at most hops undirected edges from each start to each other vertex."""
    both = both_ways(edges).distinct()
    front = starts.select(F.col("id").alias("start"), "id")
    seen = front.withColumn("path_length", F.lit(0))
    for i in range(1, hops + 1):
        front = front.join(both, F.col("id") == F.col("src")).select("start", F.col("dst").alias("id")).distinct()
        seen = seen.unionAll(front.withColumn("path_length", F.lit(i)))
    return seen.groupBy("start", "id").agg(F.min("path_length").alias("path_length")).where("path_length > 0")


def community_key(level: Column, community: Column) -> Column:
    return F.concat(F.lit("community_L"), level.cast("string"), F.lit("_"), community.cast("string"))


def parse_community_key(key: Column) -> Column:
    """struct(level, community); a key without a level is of level 0."""
    level = F.regexp_extract(key, r"^community_(?:L(\d+)_)?(\d+)$", 1)
    return F.struct(F.when(level == "", 0).otherwise(level.try_cast("int")).alias("level"), F.regexp_extract(key, r"^community_(?:L(\d+)_)?(\d+)$", 2).try_cast("long").alias("community"))


def top_members(members: DataFrame, k: int) -> DataFrame:
    """The k members of each community of highest pagerank, then degree, then id."""
    order = W.partitionBy("community").orderBy(F.desc("pagerank"), F.desc("degree"), "id")
    return members.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def find_by_names(names: DataFrame, entities: DataFrame) -> DataFrame:
    """Distinct rows of entities whose normalized_name is the normalised form of a name; unknown names give nothing."""
    wanted = names.select(normalised_name(F.col("name")).alias("normalized_name")).where("normalized_name <> ''").distinct()
    return entities.join(wanted, "normalized_name", "left_semi").distinct()


def community_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Directed edges with both ends in one community of members (id, community): community, src, dst, type, weight; type and weight have defaults."""
    a = members.select(F.col("id").alias("src"), "community")
    b = members.select(F.col("id").alias("dst"), F.col("community").alias("other"))
    found = edges.join(a, "src").join(b, "dst").where("community = other")
    return found.select("community", "src", "dst", F.coalesce("type", F.lit("RELATED_TO")).alias("type"), F.coalesce("weight", F.lit(1.0)).alias("weight"))


def induced(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with both ends among vertices (id)."""
    ends = vertices.select("id").distinct()
    return edges.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")


def members_with_degree(members: DataFrame, edges: DataFrame) -> DataFrame:
    """members (id, community, pagerank) with degree; isolated members have 0, a missing pagerank is 0."""
    degree = degrees(members, edges)
    return members.join(degree, "id").withColumn("pagerank", F.coalesce("pagerank", F.lit(0.0)))


def chunk_degrees(paths: DataFrame) -> DataFrame:
    """chunk, degree from paths (chunks, start_degree, degree): the greatest sum of both degrees over the paths that name the chunk."""
    each = paths.select(F.explode("chunks").alias("chunk"), (F.col("start_degree") + F.col("degree")).alias("both"))
    return each.where("chunk IS NOT NULL").groupBy("chunk").agg(F.max("both").alias("degree"))


def merge_nodes(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Merges rows (normalized_name, entity_type, name, chunk_ids, seq) by name and type.

    A stored node keeps its name; chunk ids are appended in order, each once, so that merging again changes nothing. Among new rows the first creates the node.
    """
    rows = stored.withColumn("late", F.lit(0)).unionByName(new.withColumn("late", F.lit(1)))
    order = F.struct("late", "seq")
    parts = F.array_sort(F.collect_list(F.struct("late", "seq", "chunk_ids")))
    return rows.groupBy("normalized_name", "entity_type").agg(F.min_by("name", order).alias("name"), F.array_distinct(F.flatten(F.transform(parts, lambda x: x["chunk_ids"]))).alias("chunk_ids"))


#: Parts that the beginnings of edges of one pair of names are dealt to, so that a name of very many nodes isn't one task's work.
NAME_PARTS = 16


def first_edges(edges: DataFrame) -> DataFrame:
    """src_name, dst_name, type, weight, seq: of equal edges the first."""
    one = edges.groupBy("src_name", "dst_name", "type").agg(F.min_by(F.struct("weight", "seq"), "seq").alias("first"))
    return one.select("src_name", "dst_name", "type", "first.weight", "first.seq")


def merge_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """src_id, type, dst_id, weight from edges (src_name, dst_name, type, weight, seq) and nodes (id, normalized_name).

    Ends are found by normalised name alone, so they fan out over types; edges without an end vanish. The first
    of equal edges gives the weight. Equal edges are merged before they fan out; after it, two rows can only be equal where an end has
    several names. Those alone are merged again, all others leave the join as they are, so that no task holds what a name of many nodes gives.
    """
    named = nodes.where("normalized_name IS NOT NULL").select("id", "normalized_name").distinct()
    named = named.withColumn("several", F.count("*").over(W.partitionBy("id")) > 1)
    a = named.select(F.col("id").alias("src_id"), F.col("normalized_name").alias("src_name"), F.col("several").alias("src_several"), F.pmod(F.xxhash64("id"), F.lit(NAME_PARTS)).alias("part"))
    b = named.select(F.col("id").alias("dst_id"), F.col("normalized_name").alias("dst_name"), F.col("several").alias("dst_several"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(NAME_PARTS - 1).cast("long"))).alias("part"))
    one = first_edges(edges)
    # So many tasks stay, however few bytes the ends are: what they give is what counts.
    tasks = max(4 * NAME_PARTS, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = lambda x, y: one.join(a.where(x), "src_name").repartition(tasks, "dst_name", "part").join(b.where(y), ["dst_name", "part"])
    plain = found("NOT src_several", "NOT dst_several").select("src_id", "type", "dst_id", "weight")
    if not named.where("several").limit(1).count():
        return plain
    again = found("src_several", "true").unionByName(found("NOT src_several", "dst_several"))
    return plain.unionByName(again.groupBy("src_id", "type", "dst_id").agg(F.min_by("weight", "seq").alias("weight")))


def hierarchy(assigned: DataFrame, levels: int = 3) -> DataFrame:
    """level, community, parent, members from (id, communities: finest first); short arrays are padded with their last value.

    The parent is the community of the same members one level up; null at the top.
    """
    last = F.element_at("communities", -1)
    padded = F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda i: F.when(i < levels, F.coalesce(F.get("communities", i), last)))
    rows = assigned.where(F.size("communities") > 0).select("id", padded.alias("c"))
    each = rows.select("id", "c", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"))
    each = each.select("id", "level", F.get("c", F.col("level")).alias("community"), F.get("c", F.col("level") + 1).alias("parent"))
    return each.groupBy("level", "community").agg(F.min("parent").alias("parent"), F.count("*").alias("members"))


def community_text(members: DataFrame, edges: DataFrame, most: int = 8000) -> DataFrame:
    """community, context: entities by pagerank, degree and id, then relationships, cut at 4 * most code points.

    members has id, community, name, pagerank, degree; edges has community, src, dst, type. Only as many rows as the cut
    can show (each takes a line) are gathered, so a huge community does not fill a task.
    """
    limit = 4 * most
    place = F.row_number().over(W.partitionBy("community").orderBy(F.desc("pagerank"), F.desc("degree"), "id"))
    shown = members.withColumn("place", place).where(F.col("place") <= limit // 4)
    rank = F.when(F.col("pagerank") > 0, F.concat(F.lit(" (PR "), F.format_string("%.3f", F.col("pagerank")), F.lit(")"))).otherwise("")
    top = shown.groupBy("community").agg(F.array_sort(F.collect_list(F.struct("place", F.concat(F.lit("- "), "name", rank).alias("line")))).alias("m"))
    nth = F.row_number().over(W.partitionBy("community").orderBy("src", "dst", "type"))
    some = edges.withColumn("nth", nth).where(F.col("nth") <= limit // 4)
    rel = some.groupBy("community").agg(F.array_sort(F.collect_list(F.struct("nth", F.concat(F.lit("- "), F.col("src").cast("string"), F.lit(" "), "type", F.lit(" "), F.col("dst").cast("string")).alias("line")))).alias("r"))
    text = F.concat_ws("\n", F.lit("Entities:"), F.transform("m", lambda x: x["line"]), F.lit("Relationships:"), F.transform("r", lambda x: x["line"]))
    return top.join(rel, "community", "left").select("community", F.left(text, F.lit(limit)).alias("context"))


def _moved(arcs: DataFrame, labels: DataFrame, total: float, gamma: float, turn: int) -> DataFrame:
    """labels (id, degree, community) with moved, after one round in which vertices whose hash is of this turn move to the neighbouring community of most gain.

    Only arcs of those vertices are read. A row that crosses the network tells all that is needed of the community it leads to, and the rows
    of a vertex are dealt once, by the vertex, for its sums, its gains and its choice.
    """
    weight = labels.groupBy("community").agg(F.sum("degree").alias("whole"))
    home = labels.join(weight, "community")
    turns = lambda c: F.pmod(F.xxhash64(c, F.lit(turn // 2)), F.lit(2)) == turn % 2
    near = home.select(F.col("id").alias("dst"), F.col("community").alias("to"), "whole")
    links = arcs.where((F.col("src") != F.col("dst")) & turns("src")).join(near.hint("shuffle_hash"), "dst").select("src", "to", "whole", "w")
    own = home.where(turns("id")).select(F.col("id").alias("src"), "community", "degree", "whole")
    stay = own.select("src", F.col("community").alias("to"), "whole", F.lit(0.0).alias("w"))
    sums = links.unionByName(stay).repartition("src").groupBy("src", "to").agg(F.max("whole").alias("whole"), F.sum("w").alias("k"))
    choices = sums.join(own.drop("whole").hint("shuffle_hash"), "src")
    others = F.col("whole") - F.when(F.col("to") == F.col("community"), F.col("degree")).otherwise(0.0)
    choices = choices.withColumn("gain", F.round(F.col("k") - F.lit(gamma / total) * F.col("degree") * others, 9))
    # The own community wins ties, then the smaller one; both directions of a swap never move in one turn.
    best = choices.groupBy("src").agg(F.max_by("to", F.struct("gain", (F.col("to") == F.col("community")).cast("int"), -F.col("to"))).alias("best"))
    now = F.coalesce("best", "community")
    return labels.join(best, F.col("id") == F.col("src"), "left").select("id", "degree", now.alias("community"), (now != F.col("community")).alias("moved"))


def _settle(scratch: Scratch, name: str, arcs: DataFrame, labels: DataFrame, total: float, gamma: float, turns: int) -> DataFrame:
    quiet = 0
    for turn in range(turns):
        new = scratch.save(_moved(arcs, labels, total, gamma, turn), f"{name}_{turn}")
        moved = new.where("moved").limit(1).count()
        labels, quiet = new.drop("moved"), 0 if moved else quiet + 1
        if turn:
            scratch.free(f"{name}_{turn - 1}")
        if quiet == 2:
            break
    return labels


def _within(arcs: DataFrame, labels: DataFrame) -> DataFrame:
    """Arcs with both ends in one community of labels (id, community)."""
    ends = labels.select("id", "community")
    return arcs.join(ends.toDF("src", "a").hint("shuffle_hash"), "src").join(ends.toDF("dst", "b").hint("shuffle_hash"), "dst").where("a = b").select("src", "dst", "w")


def leiden(edges: DataFrame, gamma: float = 1.0, levels: int = 3, turns: int = 10) -> DataFrame:
    """id, communities (finest first, each named by a vertex in it): hierarchical modularity communities.

    At each level vertices move in parallel turns (half of them, by hash, so neighbours don't swap for ever); the
    communities are then refined from single vertices moving within them, and split where a refined part is
    not connected. The refined parts become the vertices of the next level, so every community is connected. All is
    joins on arcs; the driver holds only the total weight. Runs agree. Vertices without edges don't appear.
    """
    scratch = Scratch(edges.sparkSession, "leiden")
    arcs = both_ways(edges).where("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    arcs = scratch.save(arcs, "arcs")
    total = arcs.agg(F.sum("w")).first()[0] or 0.0
    path = scratch.save(arcs.select(F.col("src").alias("id")).distinct().select("id", F.col("id").alias("top"), F.array().cast("array<bigint>").alias("communities")), "path")
    if not total:
        return path.select("id", "communities")
    for level in range(levels):
        single = scratch.save(arcs.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("degree")).withColumn("community", F.col("id")), f"single{level}")
        coarse = _settle(scratch, f"move{level}", arcs, single, total, gamma, turns)
        # Refining moves vertices within their community, so only arcs within one are read from here on.
        inside = scratch.save(_within(arcs, coarse), f"inside{level}")
        fine = _settle(scratch, f"fine{level}", inside, single, total, gamma, turns)
        within = _within(inside, fine)
        parts = scratch.save(connected_components(fine, within).withColumnRenamed("component", "part"), f"parts{level}")
        renamed = parts.select(F.col("id").alias("top"), "part")
        path = scratch.save(path.join(renamed, "top").select("id", F.col("part").alias("top"), F.concat("communities", F.array("part")).alias("communities")), f"path{level}")
        a, b = parts.toDF("src", "a"), parts.toDF("dst", "b")
        folded = arcs.join(a, "src").join(b, "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w"))
        before = single.count()
        arcs = scratch.save(folded, f"arcs{level}")
        if parts.select("part").distinct().count() == before:
            break
    return path.select("id", "communities")


def modularity(edges: DataFrame, labels: DataFrame, gamma: float = 1.0) -> DataFrame:
    """One row: modularity of labels (id, community) over undirected edges, parallel ones counted, loops left out."""
    arcs = both_ways(edges).where("src <> dst")
    a, b = labels.toDF("src", "a"), labels.toDF("dst", "b")
    by = arcs.join(a, "src").join(b, "dst").groupBy(F.col("a").alias("community")).agg(F.count("*").alias("d"), F.count_if(F.col("a") == F.col("b")).alias("inner"))
    sums = by.agg(F.sum("inner").alias("i"), F.sum(F.col("d").cast("double") * F.col("d")).alias("q"), F.sum("d").alias("t"))
    return sums.select(F.round(F.col("i") / F.col("t") - F.lit(gamma) * F.col("q") / (F.col("t").cast("double") * F.col("t")), 6).alias("modularity"))


def drawing(vertices: DataFrame, edges: DataFrame, longest: int = 150) -> tuple[DataFrame, DataFrame]:
    """vertices (id, name) with size 30 to 90 by degree, and edges (src, dst, weight, description) with width 0.5 to 5 and a tooltip of longest characters."""
    degree = degrees(vertices, edges)
    span = degree.agg(F.min("degree").alias("low"), F.max("degree").alias("high"))
    size = 30 + 60 * (F.col("degree") - F.col("low")) / F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(1)
    nodes = vertices.join(degree, "id").join(F.broadcast(span)).select("id", "name", size.alias("size"))
    tip = F.when(F.char_length("description") > longest, F.concat(F.left("description", F.lit(longest)), F.lit("..."))).otherwise(F.col("description"))
    width = F.greatest(F.lit(0.5), F.least(F.coalesce("weight", F.lit(1.0)), F.lit(5.0)))
    return nodes, edges.select("src", "dst", width.alias("width"), tip.alias("tooltip"))


def save_assignments(assigned: DataFrame, folder: str, seed: int) -> None:
    """Saves community assignments (id, community) under their seed."""
    assigned.select("id", "community").write.mode("overwrite").parquet(f"{folder}/seed={seed}")


def load_assignments(spark: SparkSession, folder: str, seed: int) -> DataFrame | None:
    """Assignments that were saved under a seed as a whole; None if there are none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/seed={seed}/_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.parquet(f"{folder}/seed={seed}")


def written_back(nodes: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """nodes with a column taken from values (id, column) where they have the node's id; others keep theirs."""
    new = values.select("id", F.col(column).alias("_new"))
    return nodes.join(new, "id", "left").withColumn(column, F.coalesce("_new", column)).drop("_new")
