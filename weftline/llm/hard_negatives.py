"""Hard negatives: the nearest rows of other labels whose score lies in a window below a positive's, by cover trees.

Equal vectors of one label are one class with its smallest ids. Classes are dealt to regions around the centres of a net over
norm-augmented vectors (the top of the cover tree, with exact covering angles), regions to shards of bounded size, and each shard's
cover tree is built once and written. An anchor first searches the shard it lies in; the k-th score found there is
joined to it, and only regions whose bounds can still reach that score, inside the window, are searched after that. Anchors
meet trees in tiles of a bounded number of both; nothing but the net's sample and its centres passes the driver.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.llm.common import bound_batches, list_arrays
from weftline.llm.cover_tree import CoverTree, augmented, net, score_bounds
from weftline.llm.top_k import integers
from weftline.plans.lineage import materialize

SCALE = 256
SHARD_ROWS = 4096
BLOCK_ANCHORS = 2048
SAMPLE = 16_384  # vectors the net is fitted on; every row is dealt to a region and found exactly
MOST_REGIONS = 1024

_PLACED = "class_id long, label string, ids array<long>, vec array<long>, region int, turn double"
_FOUND = "class_id long, goal long, found long, score long, ids array<long>"


def _valid(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, vec) of the rows that take part: integer vectors of the commonest length, with id and label."""
    vec = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), vec.alias("vec"))
    fine = F.forall("vec", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & fine)
    lengths = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    rows = rows.where(F.size("vec") == (lengths[0]["n"] if lengths else 0))
    return rows.withColumn("vec", F.transform("vec", lambda x: F.floor(x * SCALE)))


def _classes(rows: DataFrame, keep: int) -> DataFrame:
    """(class_id, label, ids, vec): equal vectors of a label, with their ``keep`` smallest ids; ranks are limited before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("label", "vec").orderBy("vec_id"))
    few = rows.distinct().withColumn("_rank", rank).where(F.col("_rank") <= keep)
    classes = few.groupBy("label", "vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return classes.select(F.monotonically_increasing_id().alias("class_id"), "label", "ids", "vec")


def _matrix(column: pa.Array) -> np.ndarray:
    rows = list_arrays(column)
    return integers(rows) if rows else np.zeros((0, 1))


def _dealer(sent):
    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            centres, peak = sent.value
            points = augmented(_matrix(batch.column(3)), peak)
            turn = np.arccos(np.clip(points @ centres.T, -1.0, 1.0))
            region = turn.argmin(axis=1)
            columns = [*batch.columns, pa.array(region.astype(np.int32)), pa.array(turn[np.arange(len(region)), region])]
            yield pa.RecordBatch.from_arrays(columns, ["class_id", "label", "ids", "vec", "region", "turn"])

    return deal


def _planter(peak: float):
    def plant(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("class_id")
        rows = integers(frame["vec"])
        labels, kind = np.unique(frame["label"].to_numpy().astype(str), return_inverse=True)
        held = {
            "tree": CoverTree(rows, peak), "classes": frame["class_id"].to_numpy(), "firsts": np.array([x[0] for x in frame["ids"]], dtype=np.int64),
            "ids": [np.asarray(x).tolist() for x in frame["ids"]], "labels": labels.tolist(), "kind": kind,
        }
        return pd.DataFrame({"shard": [key[0]], "tree": [pickle.dumps(held, protocol=5)]})

    return plant


def _plant(placed: DataFrame, area: list[Column], peak: float, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(shard, tree), (shard, area...) and the shard of each class, for shards of at most about SHARD_ROWS classes of one area."""
    names = [f"area_{i}" for i in range(len(area))]
    rows = placed.select("*", *[c.alias(n) for c, n in zip(area, names, strict=True)])
    counts = materialize(rows.groupBy(*names).agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).alias("parts")), f"{name}-areas")
    part = F.pmod(F.xxhash64("class_id", F.lit(11)), F.col("parts"))
    shard = F.concat_ws("/", *[F.col(n).cast("string") for n in reversed(names)], part.cast("string"))
    dealt = rows.join(counts, names).withColumn("shard", shard).drop("parts")
    trees = dealt.select("shard", "class_id", "label", "ids", "vec").groupBy("shard").applyInPandas(_planter(peak), "shard string, tree binary")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    shards = counts.select(*names, every.alias("_part")).select(
        *names, F.concat_ws("/", *[F.col(n).cast("string") for n in reversed(names)], F.col("_part").cast("string")).alias("shard")
    )
    homes = dealt.select("class_id", "shard")
    return materialize(trees, f"{name}-trees"), materialize(shards, f"{name}-shards"), homes


def _searcher(k: int, others: bool):
    """Searches a tile: goals are windows below a positive score, or (null) any score; ``others`` leaves out the anchor's label."""

    def search(anchors: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(anchors) and len(trees):
            held = pickle.loads(trees["tree"].iloc[0])
            tree, queries = held["tree"], integers(anchors["vec"])
            low, high = tree.bounds(queries)
            place = {label: n for n, label in enumerate(held["labels"])}
            allowed = {}
            for i, (own, label, goals) in enumerate(zip(anchors["class_id"], anchors["label"], anchors["goals"], strict=True)):
                if others and label not in allowed:
                    allowed[label] = held["kind"] != place.get(label, -1)
                for goal in goals:
                    top, least = goal["top"], goal["least"]
                    window = (None, None) if top is None else (-(-4 * top // 5), top)
                    for row, score in tree.search(queries[i], low[i], high[i], held["firsts"], k, window, least, allowed.get(label)):
                        out.append((own, top, held["classes"][row], score, held["ids"][row]))
        frame = pd.DataFrame(out, columns=["class_id", "goal", "found", "score", "ids"])
        return frame.astype({"goal": "Int64"})

    return search


def _tiles(pairs: DataFrame, trees: DataFrame, blocks: int, k: int, others: bool, name: str) -> DataFrame:
    """Best classes of each anchor and goal from (class_id, label, vec, goals, shard)."""
    asked = pairs.withColumn("block", F.pmod(F.xxhash64("class_id", F.lit(5)), F.lit(blocks)))
    asked = materialize(asked, f"{name}-pairs")
    wanted = asked.select(F.col("shard").alias("_shard"), F.col("block").alias("_block")).distinct()
    right = trees.join(wanted, F.col("shard") == F.col("_shard")).select("_shard", "_block", "tree").groupBy("_shard", "_block")
    left = asked.groupBy("shard", "block")
    return materialize(left.cogroup(right).applyInPandas(_searcher(k, others), _FOUND), f"{name}-found")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best classes of each anchor and goal, ties to the smaller first id."""
    order = Window.partitionBy("class_id", "goal").orderBy(F.desc("score"), F.col("ids")[0], "found")
    return found.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)


def _kth(found: DataFrame, k: int) -> DataFrame:
    """(class_id, goal, least): the k-th score, where k classes were found."""
    return _best(found, k).where(F.col("_rank") == k).select("class_id", "goal", F.col("score").alias("least"))


def _reach(sent):
    """Regions whose bounds meet a goal: (class_id, regions)."""

    def reach(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            centres, outer, peak = sent.value
            queries = _matrix(batch.column(1)).astype(np.float64)
            length = np.sqrt((queries * queries).sum(axis=1))[:, None]
            theta = np.arccos(np.clip(queries / np.where(length > 0, length, 1.0) @ centres[:, : queries.shape[1]].T, -1.0, 1.0))
            low, high = score_bounds(theta, np.zeros(len(centres))[None, :], outer[None, :], length * peak)
            lists = []
            for i, goals in enumerate(batch.column(2).to_pylist()):
                meets = np.zeros(len(centres), dtype=bool)
                for goal in goals:
                    top, least = goal["top"], goal["least"]
                    floor = None if top is None else -(-4 * top // 5)
                    floor = max((x for x in (floor, least) if x is not None), default=None)
                    meets |= (True if floor is None else high[i] >= floor) & (True if top is None else low[i] <= top)
                lists.append(np.flatnonzero(meets).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int32()))], ["class_id", "regions"])

    return reach


def _goals(goals: DataFrame, least: DataFrame | None) -> DataFrame:
    """(class_id, goals array<struct<top, least>>) from (class_id, goal) and the k-th scores known."""
    if least is None:
        rows = goals.withColumn("least", F.lit(None).cast("long"))
    else:
        known = least.select(F.col("class_id").alias("_c"), F.col("goal").alias("_g"), "least")
        rows = goals.join(known, (F.col("class_id") == F.col("_c")) & F.col("goal").eqNullSafe(F.col("_g")), "left")
    # at most one goal per positive of an anchor
    return rows.groupBy("class_id").agg(F.collect_list(F.struct(F.col("goal").alias("top"), "least")).alias("goals"))


class _Index:
    """Regions, and the shards of one layout: by label (positives), or of all labels (negatives)."""

    def __init__(self, placed: DataFrame, centres: np.ndarray, outer: np.ndarray, peak: float, by_label: bool):
        self.by_label, self.name = by_label, "positives" if by_label else "negatives"
        area = [F.col("region")]
        if by_label:
            sizes = placed.groupBy("label").agg((F.count(F.lit(1)) > SHARD_ROWS).alias("_large"))
            placed = placed.join(materialize(sizes, "label-sizes"), "label")
            # labels that fit one shard aren't cut by region
            area = [F.when(F.col("_large"), F.col("region")).otherwise(F.lit(-1)), F.col("label")]
        self.trees, self.shards, self.homes = _plant(placed, area, peak, self.name)
        self.sent = placed.sparkSession.sparkContext.broadcast((centres, outer, peak))

    def search(self, asked: DataFrame, goals: DataFrame, blocks: int, k: int) -> DataFrame:
        """Best ``k`` classes of each goal, from the anchor's own shard first, then from all others that can hold better ones."""
        home = asked.join(self.homes, "class_id")
        home = materialize(home.select("class_id", "label", "vec", "shard"), f"{self.name}-home")
        first = _tiles(home.join(_goals(goals, None), "class_id"), self.trees, blocks, k, not self.by_label, self.name)
        known = materialize(_goals(goals, _kth(first, k)), f"{self.name}-goals")
        open_goals = asked.join(known, "class_id")
        regions = open_goals.select("class_id", "vec", "goals").mapInArrow(_reach(self.sent), "class_id long, regions array<int>")
        regions = materialize(regions, f"{self.name}-regions")
        near = open_goals.join(regions, "class_id").withColumn("region", F.explode(F.concat("regions", F.array(F.lit(-1)))))
        where = (F.col("region") == F.col("area_0")) & ((F.col("label") == F.col("area_1")) if self.by_label else F.lit(True))
        pairs = near.join(self.shards, where).select("class_id", "label", "vec", "goals", "shard")
        pairs = pairs.join(home.select("class_id", "shard"), ["class_id", "shard"], "left_anti")
        second = _tiles(pairs.select("class_id", "label", "vec", "goals", "shard"), self.trees, blocks, k, not self.by_label, self.name)
        return _best(first.unionByName(second), k)


def _ids(found: DataFrame, k: int) -> DataFrame:
    """(class_id, goal, found, vec_id, score, place): the ``k`` best ids of each goal."""
    ids = found.select("class_id", "goal", "found", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("class_id", "goal").orderBy(F.desc("score"), "vec_id", "found")
    return ids.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def hard_negatives(
    df: DataFrame, every: int = 100, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), exact as long as scores fit a long.

    Anchors are the rows whose id is divisible by ``every``; scores are inner products of floor(256 * x). An anchor's positives are its
    ``k`` best other rows of the same label; the negatives of a positive are the ``k`` best rows of other labels with
    80 * positive score <= 100 * score <= 100 * positive score. Ties go to the smaller id. A positive with a
    negative score has no negatives, one of score 0 those of score 0.

    * Rows without id, label or vector, with null or non-finite components, or with another length than most take no part. Zero
      vectors take part.
    * Rows that repeat id, label and vector count once. Rows of one id with another vector or label are rows of their own: each is an anchor, and may
      be found by the others.
    * Fewer than ``k`` positives or negatives: all of them. Positives without negatives, and an empty table, give no row. Other columns are not read.
    """
    spark = df.sparkSession
    bound_batches(spark)
    rows = materialize(_valid(df, id_col, vector_col, label_col), "mining-rows")
    classes = materialize(_classes(rows, k + 1), "mining-classes")
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    count, longest = classes.agg(F.count(F.lit(1)), F.max(square)).first()
    peak = max(1.0, float(np.sqrt(longest or 0.0)) * (1 + 1e-12))
    regions = min(MOST_REGIONS, max(1, -(-count // SHARD_ROWS)))
    sample = classes.orderBy(F.xxhash64("class_id", F.lit(3)), "class_id").limit(SAMPLE if regions > 1 else 1).select("vec").toArrow()
    points = augmented(_matrix(sample.column(0).combine_chunks()), peak) if count else np.ones((1, 2))
    centres = points[net(points, regions)]
    dealt = classes.select("class_id", "label", "ids", "vec").mapInArrow(_dealer(spark.sparkContext.broadcast((centres, peak))), _PLACED)
    placed = materialize(dealt, "mining-placed")
    outer = np.zeros(len(centres))
    for region, turn in placed.groupBy("region").agg(F.max("turn")).collect():  # at most MOST_REGIONS rows
        outer[region] = turn

    same = [rows["label"] == classes["label"], rows["vec"] == classes["vec"]]
    members = rows.where(F.col("vec_id") % every == 0).join(classes, same).select(rows["vec_id"].alias("anchor_id"), "class_id").distinct()
    members = materialize(members, "mining-anchors")
    asked = placed.join(members.select("class_id").distinct(), "class_id", "left_semi").select("class_id", "label", "vec")
    asked = materialize(asked, "mining-asked")
    blocks = max(1, -(-asked.count() // BLOCK_ANCHORS))

    any_score = asked.select("class_id", F.lit(None).cast("long").alias("goal"))
    found = _Index(placed, centres, outer, peak, by_label=True).search(asked, any_score, blocks, k + 1)
    ids = materialize(_ids(found, k + 1).drop("goal", "place"), "mining-positives")
    own = (F.col("found") == F.col("class_id")) & (F.col("vec_id") == F.col("anchor_id"))
    order = Window.partitionBy("class_id", "anchor_id").orderBy(F.desc("score"), "vec_id", "found")
    positives = members.join(ids, "class_id").where(~own).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)
    positives = positives.select("class_id", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("goal"))
    positives = materialize(positives, "mining-goals")

    goals = positives.where("goal >= 0").select("class_id", "goal").distinct()
    found = _Index(placed, centres, outer, peak, by_label=False).search(asked, goals, blocks, k)
    negatives = _ids(found, k).select("class_id", "goal", F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return positives.join(negatives, ["class_id", "goal"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", F.col("goal").alias("positive_score"), "negative_score"
    )
