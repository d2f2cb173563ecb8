"""Blocking, pairs, components, confidence and best-of-group ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lodestone.functions import similarity as S
from lodestone.operators import tiles
from lodestone.operators.graph import components_within, thinned
from lodestone.sources.tables import cut, shuffled

#: Rows of a block that one task compares with as many others; larger blocks are tiled.
TILE = 4096
PAIR = ["asset_id", "hash", "feature", "capture_ts", "lat", "lon", "face_count", "faceprints", "color_signature"]


def with_block(assets: DataFrame) -> DataFrame:
    key = S.blocking_key(F.col("capture_ts"), F.col("width"), F.col("height"), F.col("is_screenshot"))
    return assets.withColumn("block", key)


def block_pairs(rows: DataFrame, columns: list[str], theta: Column | None = None, block: str = "block", tile: int | None = TILE) -> DataFrame:
    """Pairs within blocks, the smaller asset_id left: columns a_* and b_*.

    A block above ``tile`` rows is cut into T tiles by id; a row meets the others tile by tile,
    so no task holds more than two tiles and a hot block's work spreads over T * T / 2 tasks.
    Without such a block (or with ``tile`` None) the pairs are a plain hash join. ``rows`` are computed and shuffled once: both
    sides read the same exchange. Other columns of ``rows`` are ignored.
    """
    own = ["asset_id", *[c for c in dict.fromkeys(columns) if c != "asset_id"]]
    rows = rows.select(F.col(block).alias("__block"), *own)
    large = large_blocks(rows, tile) if tile else None
    key = ["__block"]
    if large is not None and large.head(1):
        rows = cells(rows, large, own)
        key, own = [*key, "__p", "__q"], ["__tile", *own]
    rows = rows.repartition(*key)
    a, b = (rows.select(*key, *[F.col(c).alias(f"{side}_{c}") for c in own]) for side in "ab")
    on = [a[k] == b[k] for k in key] + [F.col("a_asset_id") < F.col("b_asset_id")]
    if "__tile" in own:  # a pair of one tile meets only in its own cell
        on.append((F.col("a___tile") != F.col("b___tile")) | (a["__p"] == a["__q"]))
    if theta is not None:
        on.append(theta)
    return a.join(shuffled(b), on).select(a["__block"].alias(block), *[f"{side}_{c}" for side in "ab" for c in own if c != "__tile"])


def large_blocks(rows: DataFrame, tile: int) -> DataFrame:
    """__block, __tiles of blocks above ``tile`` rows."""
    return cut(rows.groupBy("__block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile).select("__block", F.ceil(F.col("n") / tile).cast("int").alias("__tiles")))


def cells(rows: DataFrame, large: DataFrame, own: list[str]) -> DataFrame:
    """Rows once for each cell (__block, __p, __q) in which they meet others; blocks that aren't large are one cell."""
    tiled = rows.join(F.broadcast(large) if _few(large) else large, "__block", "left").withColumn("__tiles", F.coalesce("__tiles", F.lit(1))).withColumn("__tile", F.pmod(F.xxhash64("asset_id"), F.col("__tiles")).cast("int"))
    meet = F.transform(F.sequence(F.lit(0), F.col("__tiles") - 1), lambda i: F.struct(F.least(F.col("__tile"), i).alias("p"), F.greatest(F.col("__tile"), i).alias("q")))
    return tiled.withColumn("__cell", F.explode(meet)).select("__block", F.col("__cell.p").alias("__p"), F.col("__cell.q").alias("__q"), "__tile", *own)


def by_cells(rows: DataFrame, large: DataFrame, own: list[str]) -> DataFrame:
    """``cells``, each whole in one task and sorted: few bytes stand for many pairs, so partitions aren't merged by their size."""
    n_tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells(rows, large, own).repartition(n_tasks, *tiles.CELL).sortWithinPartitions(*tiles.CELL)


def pair_counts(rows: DataFrame, tile: int = 4 * TILE) -> DataFrame:
    """block and, of its pairs, how many pass each of the predicates (``tiles.COUNTS``); blocks without a pair are left out.

    Pairs are counted where they meet, many at a time, and never become rows.
    """
    own = ["asset_id", "hash", F.unix_micros("capture_ts").alias("us"), "lat", "lon", "face_count", "faceprints", "color_signature"]
    rows = rows.where("block is not null and asset_id is not null").select(F.col("block").alias("__block"), *own)
    met = by_cells(rows, large_blocks(rows, tile), [c for c in rows.columns if c != "__block"])
    counted = met.mapInArrow(tiles.count_pairs, ", ".join(["__block string", *[f"{c} long" for c in tiles.COUNTS]]))
    return counted.groupBy(F.col("__block").alias("block")).agg(*[F.sum(c).alias(c) for c in tiles.COUNTS]).where("n_pairs > 0")


def _few(df: DataFrame, most: int = 10_000) -> bool:
    """Whether a table has no more than ``most`` rows (then it may be broadcast)."""
    return len(df.select(F.lit(1)).limit(most + 1).collect()) <= most


def col(side: str, name: str) -> Column:
    return F.col(f"{side}_{name}")


def of_pair(f, *names: str) -> Column:
    """f over the columns of both sides, name by name: f(a_x, b_x, a_y, b_y, ...)."""
    return f(*[col(side, n) for n in names for side in "ab"])


def near_bits() -> Column:
    return of_pair(S.hamming, "hash") <= S.PREFILTER_BITS


def in_session() -> Column:
    return S.same_session(F.col("a_capture_ts"), F.col("b_capture_ts"), F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))


def cross_pairs(left: DataFrame, right: DataFrame, columns: list[str], theta: Column | None = None, block: str = "block", tile: int = TILE) -> DataFrame:
    """Pairs of a row of ``left`` and one of ``right`` in the same block, as ``block_pairs`` has them.

    No asset stands on both sides. A block that has more than ``tile`` rows on the right is cut into tiles by
    id, and the rows on the left meet each of them.
    """
    own = ["asset_id", *[c for c in dict.fromkeys(columns) if c != "asset_id"]]
    sizes = right.groupBy(F.col(block).alias("__block")).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("__tiles"))
    tiled = lambda rows: rows.select(F.col(block).alias("__block"), *own).join(sizes, "__block")
    x = tiled(left).select("__block", F.explode(F.sequence(F.lit(0), F.col("__tiles") - 1)).alias("__tile"), *[F.col(c).alias(f"x_{c}") for c in own])
    y = tiled(right).select("__block", F.pmod(F.xxhash64("asset_id"), F.col("__tiles")).cast("int").alias("__tile"), *[F.col(c).alias(f"y_{c}") for c in own])
    first = F.col("x_asset_id") < F.col("y_asset_id")
    sides = [F.when(first, F.col(f"{p}_{c}")).otherwise(F.col(f"{q}_{c}")).alias(f"{side}_{c}") for side, p, q in (("a", "x", "y"), ("b", "y", "x")) for c in own]
    pairs = x.join(y, ["__block", "__tile"]).select(F.col("__block").alias(block), *sides)
    return pairs if theta is None else pairs.where(theta)


def cheap_test(sensitivity: str) -> Column:
    """What a pair has to pass before the costly tests."""
    return near_bits() | in_session() if S.SENSITIVITIES[sensitivity].groups_poses else near_bits()


def accepted_pairs(rows: DataFrame, sensitivity: str, block: str = "block", face_distance: S.Distance = S.vector_distance) -> DataFrame:
    """Block, src, dst, distance of accepted pairs. Cheap tests form the join; costly ones run on what is left.

    A pair near in bits needs the strict distance. In the mode that groups poses a pair of one
    session may have the relaxed distance if its colours are similar. Both need the same people,
    by ``face_distance`` of two face prints, which may be of any type it takes.
    """
    large = large_blocks(rows.select(F.col(block).alias("__block")), TILE)
    if not large.head(1):
        return judged(block_pairs(rows, PAIR, cheap_test(sensitivity), block, None), sensitivity, block, face_distance)
    ordinary = judged(block_pairs(rows.join(*of_large(large, block, "left_anti")), PAIR, cheap_test(sensitivity), block, None), sensitivity, block, face_distance)
    tiled = tiled_pairs(rows.join(*of_large(large, block, "left_semi")), large, sensitivity, block)
    return ordinary.unionByName(judged(tiled, sensitivity, block, face_distance))


def of_large(large: DataFrame, block: str, how: str) -> tuple[DataFrame, Column, str]:
    """What rows are joined with to have those of large blocks, or the others."""
    found = large.select(F.col("__block").alias("__large"))
    return F.broadcast(found) if _few(found) else found, F.col(block) == F.col("__large"), how


def tiled_pairs(rows: DataFrame, large: DataFrame, sensitivity: str, block: str = "block") -> DataFrame:
    """Pairs of rows of ``large`` blocks that pass the cheap tests, for ``judged``: tested in arrays, tile by tile.

    ``settled`` has the distance of those that need no other test; their other columns are null. Where ``rows`` have
    a column ``new``, one of a pair at least is new.
    """
    s, others = S.SENSITIVITIES[sensitivity], [c for c in PAIR if c != "asset_id"]
    new = F.col("new") if "new" in rows.columns else F.lit(True)
    rows = rows.where(F.col(block).isNotNull() & F.col("asset_id").isNotNull()).select(F.col(block).alias("__block"), *PAIR, F.unix_micros("capture_ts").alias("us"), new.alias("__new"))
    met = by_cells(rows, large.withColumn("__tiles", F.ceil(F.col("__tiles") / 4).cast("int")), [c for c in rows.columns if c != "__block"])
    t = rows.schema
    schema = StructType([t["__block"], StructField("settled", DoubleType()), *[StructField(f"{side}_asset_id", t["asset_id"].dataType) for side in "ab"], *[StructField(f"{side}_{c}", t[c].dataType) for side in "ab" for c in others]])
    return met.mapInArrow(tiles.Found(others, s.strict, s.groups_poses), schema).withColumnRenamed("__block", block)


def judged(pairs: DataFrame, sensitivity: str, block: str = "block", face_distance: S.Distance = S.vector_distance) -> DataFrame:
    """Block, src, dst, distance of those pairs that passed the cheap tests and pass the others too (what is ``settled`` has)."""
    s = S.SENSITIVITIES[sensitivity]
    # filters aren't pushed below what isn't deterministic: in the join's condition the costly tests would
    # stand before the cheap ones and run on all pairs of a block
    pairs = pairs.withColumn("__task", F.spark_partition_id())
    settled = F.col("settled") if "settled" in pairs.columns else F.lit(None).cast("double")
    found = pairs.select(
        block,
        "__task",
        F.col("a_asset_id").alias("src"),
        F.col("b_asset_id").alias("dst"),
        F.coalesce(settled, of_pair(S.pair_distance, "feature", "hash")).alias("distance"),
        settled.isNotNull().alias("settled"),
        near_bits().alias("near"),
        (in_session() if s.groups_poses else F.lit(False)).alias("session"),
        S.same_people(*[col(side, n) for n in ("face_count", "faceprints") for side in "ab"], face_distance).alias("people"),
        (of_pair(S.similar_color, "color_signature") if s.groups_poses else F.lit(False)).alias("color"),
    )
    strict = F.col("near") & (F.col("distance") <= s.strict)
    relaxed = F.col("session") & (F.col("distance") <= s.relaxed) & F.col("color")
    return found.where((F.col("__task") >= 0) & (F.col("settled") | (F.col("people") & (strict | relaxed if s.groups_poses else strict)))).select(block, "src", "dst", "distance")


def group_members(rows: DataFrame, sensitivity: str, block: str = "block", face_distance: S.Distance = S.vector_distance) -> DataFrame:
    """group_id (smallest member), asset_id of groups of two or more; an asset stands in one block."""
    edges = cut(thinned(accepted_pairs(rows, sensitivity, block, face_distance), block))
    return components_within(edges, block).select(F.col("component").alias("group_id"), F.col("node").alias("asset_id"))


def _ones(word: Column) -> Column:
    """How many of the values of a 64-bit column have each bit, as an array of 64 counts."""
    return F.array(*[F.sum(F.shiftrightunsigned(word, i).bitwiseAND(1)) for i in range(64)])


def group_confidence(members: DataFrame, rows: DataFrame) -> DataFrame:
    """group_id, n, confidence: 1 - mean distance over all pairs of members, within 0.5 and 0.99.

    Members with feature vectors of one size meet in pairs. All other pairs differ by the bits of their
    hashes, and the sum of these needs no pairs: of n values a bit that m of them have differs in
    m * (n - m) pairs. So a group's sum is that over all its members, less that within each size of
    vectors, plus the distances of those vectors. Pairs without any distance don't count; a group of only such pairs has 0.5.
    """
    vector = F.when(~F.exists("feature", lambda x: x.isNull()), F.col("feature"))
    data = members.select("group_id", "asset_id").join(shuffled(rows.select("asset_id", "hash", vector.alias("feature"))), "asset_id").withColumn("size", F.size("feature"))
    size = data.groupBy("group_id", "size").agg(F.count(F.lit(1)).alias("n"), F.count("hash").alias("h"), _ones(F.col("hash")).alias("ones"))
    pairs = lambda n: F.col(n) * (F.col(n) - 1) / 2
    bits = lambda ones, n: F.aggregate(ones, F.lit(0.0), lambda s, m: s + F.coalesce(m, F.lit(0)).cast("double") * (F.col(n) - F.coalesce(m, F.lit(0)))) / 64
    sized = F.col("size").isNotNull()
    size = size.select("group_id", "h", "ones", F.when(sized, pairs("n") - pairs("h")).otherwise(0.0).alias("pairs"), F.when(sized, -bits(F.col("ones"), "h")).otherwise(0.0).alias("bits"))
    whole = size.groupBy("group_id").agg(F.sum("h").alias("h"), F.sum("pairs").alias("pairs"), F.sum("bits").alias("bits"), F.array(*[F.sum(F.col("ones")[i]) for i in range(64)]).alias("ones"))
    whole = whole.select("group_id", (F.col("pairs") + pairs("h")).alias("pairs"), (F.col("bits") + bits(F.col("ones"), "h")).alias("sum"))
    vectors = cut(data.where(sized).select(F.concat_ws("|", "group_id", "size").alias("class"), "group_id", "asset_id", "feature"))
    near = block_pairs(vectors, ["group_id", "feature"], block="class")
    near = near.groupBy(F.col("a_group_id").alias("group_id")).agg(F.sum(of_pair(S.vector_distance, "feature")).alias("vectors"))
    mean = whole.join(near, "group_id", "left").select("group_id", ((F.col("sum") + F.coalesce("vectors", F.lit(0.0))) / F.nullif("pairs", F.lit(0.0))).alias("mean"))
    size = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    return size.join(mean, "group_id", "left").select("group_id", "n", F.when(F.col("n") <= 1, F.lit(1.0)).otherwise(S.clamp(1 - F.col("mean"), 0.5, 0.99)).alias("confidence"))


def placeholder_keeper(members: DataFrame, rows: DataFrame) -> DataFrame:
    """group_id, keeper_id: most pixels, the smaller id of equals."""
    data = members.join(shuffled(rows.select("asset_id", "pixel_count")), "asset_id")
    return data.groupBy("group_id").agg(F.max_by("asset_id", F.struct("pixel_count", -F.col("asset_id"))).alias("keeper_id"))


#: Badges in their order.
BADGES = ["Sharpest", "Best exposure", "Highest resolution", "Lower resolution", "Edited", "Favorite", "Live Photo", "Has people", "Blurry", "Protected"]
NEGATIVE = ["Lower resolution", "Blurry"]


#: What ranking reads of an asset.
JUDGED = ["pixel_count", "sharpness", "exposure", "contrast", "motion_blur", "face_count", "is_favorite", "is_edited", "is_live", "is_hidden", "is_shared"]


def rank_groups(members: DataFrame, rows: DataFrame, confidence: DataFrame | None = None, off: tuple[str, ...] = ()) -> DataFrame:
    """Members with score, rank, is_keeper, is_protected, is_removal, reasons and badges.

    Members that have no row are left out. Rank goes by rounded score, then edited, pixels,
    favorite, live, people, then the smaller id. In groups of two or fewer, or with a confidence
    of 0.95 or more, people alone don't protect.
    """
    data = members.select("group_id", "asset_id").join(shuffled(rows.select("asset_id", *JUDGED)), "asset_id").withColumn("has_people", F.col("face_count") > 0)
    data = data.join(confidence.select("group_id", "confidence"), "group_id", "left") if confidence is not None else data.withColumn("confidence", F.lit(0.0))
    group = Window.partitionBy("group_id")
    data = data.withColumn("most", F.max("pixel_count").over(group)).withColumn("n", F.count(F.lit(1)).over(group)).withColumn("score", S.quality_score(F.col("most")))
    better = [F.desc(S.hundredths(F.col("score"))), F.desc("is_edited"), F.desc("pixel_count"), F.desc("is_favorite"), F.desc("is_live"), F.desc("has_people"), "asset_id"]
    sharpest, exposed = Window.partitionBy("group_id").orderBy(F.desc("sharpness"), "asset_id"), Window.partitionBy("group_id").orderBy(F.desc("exposure"), "asset_id")
    data = data.withColumn("rank", F.row_number().over(Window.partitionBy("group_id").orderBy(*better)))
    data = data.withColumn("reasons", S.protection_reasons(off))
    sure = (F.col("n") <= 2) | (F.coalesce("confidence", F.lit(0.0)) >= 0.95)
    data = data.withColumn("is_protected", (F.size("reasons") > 0) & ~(sure & (F.array_join("reasons", ",") == "hasPeople")))
    marks = [
        F.row_number().over(sharpest) == 1,
        F.row_number().over(exposed) == 1,
        F.col("pixel_count") == F.col("most"),
        F.col("pixel_count") != F.col("most"),
        F.col("is_edited"),
        F.col("is_favorite"),
        F.col("is_live"),
        F.col("has_people"),
        (F.col("motion_blur") > 0.6) | (F.col("sharpness") < 0.3),
        F.col("is_protected"),
    ]
    data = data.withColumns({f"m{i}": m for i, m in enumerate(marks)})
    badges = F.array_compact(F.array(*[F.when(F.col(f"m{i}"), F.lit(b)) for i, b in enumerate(BADGES)]))
    keeper = F.col("rank") == 1
    return data.select("group_id", "asset_id", "confidence", "n", "score", "rank", keeper.alias("is_keeper"), "is_protected", (~keeper & ~F.col("is_protected")).alias("is_removal"), "reasons", badges.alias("badges"))


def keepers(placeholder: DataFrame, ranked: DataFrame) -> DataFrame:
    """group_id, keeper_id: the ranked keeper, or the placeholder where nothing could be ranked."""
    best = ranked.where("is_keeper").select("group_id", F.col("asset_id").alias("best"))
    return placeholder.join(best, "group_id", "left").select("group_id", F.coalesce("best", "keeper_id").alias("keeper_id"))


def decisions(ranked: DataFrame) -> DataFrame:
    """One row a group: keeper_id, n_removals, n_protected, warning (or null)."""
    out = ranked.groupBy("group_id").agg(F.max(F.when(F.col("is_keeper"), F.col("asset_id"))).alias("keeper_id"), F.count_if("is_removal").alias("n_removals"), F.count_if("is_protected").alias("n_protected"))
    warning = F.when(F.col("keeper_id").isNull(), "noKeeper").when((F.col("n_removals") == 0) & (F.col("n_protected") > 0), "allProtected")
    return out.withColumn("warning", warning)


def side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns of two tables of one row each."""
    return a.withColumn("__one", F.lit(1)).join(b.withColumn("__one", F.lit(1)), "__one").drop("__one")


def cleanup_plan(ranked: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """One row: groups, removals, distinct protected, warnings, savings (null without sizes)."""
    d = decisions(ranked).agg(F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum("n_removals"), F.lit(0)).alias("n_removals"), F.count("warning").alias("n_warnings"))
    p = ranked.where("is_protected").agg(F.countDistinct("asset_id").alias("n_protected"))
    out = side_by_side(d, p)
    if sizes is None:
        return out.withColumn("savings", F.lit(None).cast("long"))
    return side_by_side(out, ranked.where("is_removal").join(shuffled(sizes), "asset_id", "left").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("savings")))


def cleanup_stats(ranked: DataFrame, rows: DataFrame) -> DataFrame:
    """One row of tallies; categories of protected members overlap."""
    held = ranked.where("is_protected").select("asset_id").distinct().join(shuffled(rows), "asset_id")
    p = held.agg(F.count_if("is_favorite").alias("protected_favorites"), F.count_if("is_live").alias("protected_live"), F.count_if(F.col("face_count") > 0).alias("protected_people"))
    return ranked.agg(F.countDistinct("group_id").alias("group_count"), F.count_if("is_removal").alias("reviewable")).transform(side_by_side, p)


def snapshot(members: DataFrame) -> DataFrame:
    """One row: groups, and members beyond one a group (protection aside)."""
    return members.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("group_count"), F.coalesce(F.sum(F.greatest(F.lit(0), F.col("n") - 1)), F.lit(0)).alias("reviewable"))


def override_removals(ranked: DataFrame, toggled: DataFrame) -> DataFrame:
    """group_id, asset_id to remove after a person's toggles of (group_id, asset_id): symmetric difference."""
    own = ranked.where("is_removal").select("group_id", "asset_id", F.lit(1).alias("own"))
    other = toggled.select("group_id", "asset_id").distinct().withColumn("other", F.lit(1))
    return own.join(other, ["group_id", "asset_id"], "full").where("own is null or other is null").select("group_id", "asset_id")
