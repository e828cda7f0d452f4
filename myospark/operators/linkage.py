"""Ward's linkage of movies of any number of series, by rounds of joins on the table of their distances.

In every round all pairs of clusters that are each other's nearest merge at once: by Ward's measure no later merge can come
between them, so the tree is the one that merging pair by pair gives. The distances of merged clusters follow from those of
their parts. A movie's distances lie in as many tasks as it has clusters; what meets in one task are the merges of a movie,
of which there are fewer than series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import discard, materialize, shared_path

MOVIE = "movie_id"


def nearest_pairs(pairs: DataFrame) -> DataFrame:
    """(movie_id, i, j, d, ni, nj): pairs i < j of clusters each of which is the other's nearest; the lesser of equals is nearer."""
    end = lambda c, o, nc, no: F.struct(F.col(c).alias("c"), F.struct("d", F.col(o).alias("o"), F.col(nc).alias("nc"), F.col(no).alias("no")).alias("m"))
    ends = pairs.select(MOVIE, F.inline(F.array(end("u", "v", "nu", "nv"), end("v", "u", "nv", "nu"))))
    near = ends.groupBy(MOVIE, "c").agg(F.min("m").alias("m")).select(MOVIE, "c", "m.*")
    back = near.select(MOVIE, F.col("c").alias("o"), F.col("o").alias("back"))
    found = near.join(back, [MOVIE, "o"]).where("back = c and c < o")
    return found.select(MOVIE, F.col("c").alias("i"), F.col("o").alias("j"), "d", F.col("nc").alias("ni"), F.col("no").alias("nj"))


def merged(pairs: DataFrame, merging: DataFrame) -> DataFrame:
    """The pairs of the clusters that are left, a merged one under the id of its lesser part, by the recurrence of Lance and Williams.
    Where both sides of a pair have merged, that of the lesser id goes first."""
    side = lambda c: F.struct(F.col(c).alias("c"), F.col("i").alias("to"), F.col("d").alias("h"), (F.col("ni") + F.col("nj")).alias("n"))
    moved = merging.select(MOVIE, F.inline(F.array(side("i"), side("j"))))
    of = lambda c: moved.select(MOVIE, F.col("c").alias(c), F.struct("to", "h", "n").alias(f"m{c}"))
    here = pairs.join(of("u"), [MOVIE, "u"], "left").join(of("v"), [MOVIE, "v"], "left")
    end = lambda c: F.struct(F.coalesce(f"m{c}.to", c).alias("to"), F.col(c).alias("c"), F.col(f"n{c}").alias("n"), F.col(f"m{c}.h").alias("h"), F.coalesce(f"m{c}.n", f"n{c}").alias("all"))
    both = here.select(MOVIE, "d", end("u").alias("p"), end("v").alias("q")).where("p.to <> q.to")
    up = F.col("p.to") < F.col("q.to")
    both = both.select(MOVIE, "d", F.when(up, F.col("p")).otherwise(F.col("q")).alias("p"), F.when(up, F.col("q")).otherwise(F.col("p")).alias("q"))
    flat = both.select(MOVIE, "d", *(F.col(f"{s}.{f}").alias(f"{s}_{f}") for s in "pq" for f in ("to", "c", "n", "h", "all"))).repartition(MOVIE, "p_to")
    first = flat.groupBy(MOVIE, "p_to", "q_to", "q_c").agg(*(F.max(c).alias(c) for c in ("p_h", "p_all", "q_n", "q_h", "q_all")), F.max("d").alias("d"), F.sum((F.col("p_n") + F.col("q_n")) * F.col("d")).alias("s"))
    d = F.when(F.col("p_h").isNull(), F.col("d")).otherwise((F.col("s") - F.col("q_n") * F.col("p_h")) / (F.col("p_all") + F.col("q_n")))
    first = first.withColumn("d", d)
    second = first.groupBy(MOVIE, "p_to", "q_to").agg(*(F.max(c).alias(c) for c in ("p_all", "q_h", "q_all")), F.max("d").alias("d"), F.sum((F.col("q_n") + F.col("p_all")) * F.col("d")).alias("s"))
    d = F.when(F.col("q_h").isNull(), F.col("d")).otherwise((F.col("s") - F.col("p_all") * F.col("q_h")) / (F.col("q_all") + F.col("p_all")))
    return second.select(MOVIE, F.col("p_to").alias("u"), F.col("q_to").alias("v"), F.col("p_all").alias("nu"), F.col("q_all").alias("nv"), d.alias("d"))


def leaf_numbers(distances: DataFrame) -> DataFrame:
    """(movie_id, sarc_id, leaf): the series of each movie numbered from 0."""
    ids = distances.select(MOVIE, F.explode(F.array("sarc_a", "sarc_b")).alias("sarc_id")).distinct()
    return ids.withColumn("leaf", F.row_number().over(Window.partitionBy(MOVIE).orderBy("sarc_id")) - 1)


def ward_tree(distances: DataFrame) -> DataFrame:
    """(movie_id, step, a, b, height, size, start) from rows (movie_id, sarc_a, sarc_b, dist): merges by height, clusters numbered on
    from the number of series, a < b. The leaves of a merge stand at start to start + size - 1 of the movie's leaf order, those of a
    before those of b. Pairs that are missing count as infinitely far; each pair is given once."""
    spark = distances.sparkSession
    one = F.lit(1).cast("long")
    pairs = materialize(distances.select(MOVIE, F.least("sarc_a", "sarc_b").alias("u"), F.greatest("sarc_a", "sarc_b").alias("v"), one.alias("nu"), one.alias("nv"), (F.col("dist") * F.col("dist")).alias("d")), "pairs")
    leaves = materialize(leaf_numbers(distances), "leaves")
    path, turn = shared_path(spark, "merges"), 0
    while True:
        found = materialize(nearest_pairs(pairs), "merging")
        found.write.parquet(f"{path}/turn={turn}")
        if found.isEmpty():
            break
        last, pairs = pairs, materialize(merged(pairs, found), "pairs")
        discard(last, found)
        turn += 1
    merges = spark.read.parquet(path)
    order = Window.partitionBy(MOVIE).orderBy("d", "turn", "i")
    every = Window.partitionBy(MOVIE)
    merges = materialize(merges.withColumn("step", F.row_number().over(order) - 1).withColumn("leaves", F.count(F.lit(1)).over(every) + 1), "merges")
    # a part is the merge that made its id last, or the leaf of that id
    part = lambda c, n: F.struct(F.col(c).alias("id"), F.col(n).alias("n"))
    parts = merges.select(MOVIE, "turn", "step", "leaves", F.inline(F.array(part("i", "ni"), part("j", "nj"))))
    before = F.lag("step").over(Window.partitionBy(MOVIE, "id").orderBy("turn"))
    named = parts.withColumn("before", before).join(leaves.withColumnRenamed("sarc_id", "id"), [MOVIE, "id"])
    named = named.withColumn("name", F.when(F.col("before").isNull(), F.col("leaf")).otherwise(F.col("leaves") + F.col("before")).cast("int"))
    tree = named.groupBy(MOVIE, "step", "leaves").agg(F.array_sort(F.collect_list(F.struct("name", "n"))).alias("parts"))
    a, b = F.col("parts")[0], F.col("parts")[1]
    height = merges.select(MOVIE, "step", F.sqrt(F.greatest("d", F.lit(0.0))).alias("height"))
    tree = materialize(tree.select(MOVIE, "step", "leaves", a["name"].alias("a"), b["name"].alias("b"), a["n"].alias("na"), (a["n"] + b["n"]).alias("size")).join(height, [MOVIE, "step"]), "tree")
    return tree.join(starts(tree), [MOVIE, "step"]).select(MOVIE, "step", "a", "b", "height", F.col("size").cast("int").alias("size"), F.col("start").cast("int").alias("start"))


def starts(tree: DataFrame) -> DataFrame:
    """(movie_id, step, start): what stands before a merge's leaves, added up along its way to the root, which halves every turn."""
    child = lambda name, add: F.struct((F.col(name) - F.col("leaves")).alias("step"), add.alias("start"))
    under = tree.select(MOVIE, F.col("step").alias("up"), F.inline(F.array(child("a", F.lit(0).cast("long")), child("b", F.col("na"))))).where("step >= 0")
    now = materialize(tree.select(MOVIE, "step").join(under, [MOVIE, "step"], "left").select(MOVIE, "step", "up", F.coalesce("start", F.lit(0)).alias("start")), "starts")
    while not now.where("up is not null").isEmpty():
        above = now.select(MOVIE, F.col("step").alias("up"), F.col("up").alias("next"), F.col("start").alias("more"))
        last, now = now, materialize(now.join(above, [MOVIE, "up"], "left").select(MOVIE, "step", F.col("next").alias("up"), (F.col("start") + F.coalesce("more", F.lit(0))).alias("start")), "starts")
        discard(last)
    return now.select(MOVIE, "step", "start")


def leaf_positions(tree: DataFrame, leaves: DataFrame) -> DataFrame:
    """(movie_id, sarc_id, pos) from a tree and the leaf_numbers of its series."""
    n = tree.groupBy(MOVIE).agg((F.count(F.lit(1)) + 1).alias("n"))
    end = lambda c, at: F.struct(F.col(c).alias("leaf"), at.alias("pos"))
    ends = tree.select(MOVIE, F.inline(F.array(end("a", F.col("start")), end("b", F.col("start") + F.col("size") - 1)))).join(n, MOVIE).where("leaf < n")
    return ends.join(leaves, [MOVIE, "leaf"]).select(MOVIE, "sarc_id", "pos")
