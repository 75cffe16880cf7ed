"""Hard negatives by the threshold algorithm over per-dimension sorted lists.

Rows are dealt into blocks. A block keeps, per dimension, its rows in order of that component; an
anchor reads each list from the end its own sign asks for, all lists equally deep. Every row met
on the way is scored in whole numbers by its id. What no list has shown yet scores at most the
threshold, the anchor times the last components read, so a block is done with an anchor once the
threshold lies strictly below the score that each of its searches would still have to beat.

Two searches are made: the positives (over the lists of the anchor's own label), then, with the
positives of all blocks known, the windows below each positive score. Anchors, one row in a
hundred, are the stated queries against all rows: every block streams them from a written table,
some hundred at a time, and hands on at most ``wanted`` rows per search. These are merged by a
window over each search, whose size is bounded by the number of blocks. No row is broadcast,
multiplied or paired outside the scores that a search keeps.

Defined results: rows with a null label or a vector that is null, holds a null or non-finite
component, or has another length than most take no part. Rows are told apart by place, not by id:
a repeated anchor has its copy as a positive and each copy has rows of its own in the result. A
null id is never an anchor and stands last among equal scores; equal ids are taken in any order,
as their rows read the same. A positive score below zero leaves no window. An empty table gives no
rows; other columns are ignored. Components so large that a score would not fit a long raise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import read
from tapeloom.plans.stage import written
from tapeloom.sources.files import open_path

#: Fixed values of the contract.
SCALE, LABELS, SHIFTED, ANCHORS = 256, 10, 7, 100
WANTED, LOW_PERCENT = 5, 80
#: Rows of a block, and anchors read at once.
BLOCK_ROWS, ANCHOR_ROWS = 131_072, 512
#: First depth to which lists are read, and the ratio of the depths at which thresholds are known.
FIRST, RATIO = 16, 1.1
#: Above any score.
LARGE = 2**63

POINT_DDL = "vec_id bigint, label int, x array<bigint>"
FOUND_DDL = "anchor_key bigint, search int, score bigint, id bigint, key bigint"


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = batch.column(2).cast(pa.list_(pa.float64()))
        entries = vectors.flatten().to_numpy(zero_copy_only=False)
        sound = ~np.asarray(vectors.is_null())
        sound[pc.list_parent_indices(vectors).to_numpy()[~np.isfinite(entries)]] = False
        sound &= np.asarray(batch.column(1).is_valid())
        keep = pa.array(sound)
        kept = vectors.filter(keep)
        values = np.floor(SCALE * kept.flatten().to_numpy(zero_copy_only=False))
        sizes = pc.list_value_length(kept).to_numpy(zero_copy_only=False)
        if len(values) and float(np.abs(values).max()) ** 2 * float(sizes.max()) >= LARGE:
            raise OverflowError("scores of these components would not fit a long")
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values.astype(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), lists], names=["vec_id", "label", "x"])


class Lists:
    """Rows of one block (or of one label in it) with their per-dimension orders."""

    def __init__(self, x: np.ndarray, members: np.ndarray):
        self.x, self.members = x, members
        self.order = np.ascontiguousarray(np.argsort(-x, axis=0, kind="stable").T.astype(np.int32))
        n = len(x)
        grid = [min(FIRST, n)]
        while grid[-1] < n:
            grid.append(min(n, max(grid[-1] + 1, int(grid[-1] * RATIO))))
        self.depths = np.array(grid)
        ranked = np.take_along_axis(x, self.order.T, axis=0)
        self.front, self.back = ranked[self.depths - 1], ranked[n - self.depths]

    def thresholds(self, anchors: np.ndarray) -> np.ndarray:
        """Per anchor and depth, the most that a row not met by that depth can score."""
        return np.maximum(anchors, 0) @ self.front.T + np.minimum(anchors, 0) @ self.back.T

    def scan(self, anchor: np.ndarray, thresholds: np.ndarray, search) -> int:
        """Read the lists until ``search`` cannot gain any more; the depth reached."""
        n = len(self.x)
        rising, falling = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        met, depth, step = np.zeros(n, bool), 0, 0
        while True:
            to = self.depths[step] if len(rising) + len(falling) else n
            before = met.copy()
            met[self.order[rising, depth:to]] = True
            met[self.order[falling, n - to : n - depth]] = True
            if to == n:
                met[:] = True
            fresh = np.flatnonzero(met & ~before)
            search.take(self.members[fresh], self.x[fresh] @ anchor)
            floor = search.floor()
            if to == n or thresholds[step] < floor:
                return int(to)
            # the threshold only falls: no need to look again before it can have passed the floor,
            # unless that is far off and the floor may rise on the way
            enough = step + 1 + int(np.argmax(thresholds[step + 1 :] < floor)) if thresholds[-1] < floor else len(self.depths) - 1
            depth, step = to, min(enough, max(step + 1, int(np.searchsorted(self.depths, 2 * to))))


class Search:
    """The best rows of one search: scores from ``low`` to ``high``, ties by id."""

    def __init__(self, low, high, ids: np.ndarray, places: np.ndarray, wanted: int = WANTED):
        self.low, self.high, self.ids, self.places, self.wanted = low, high, ids, places, wanted
        self.rows, self.scores = np.zeros(0, np.int64), np.zeros(0)

    def take(self, rows: np.ndarray, scores: np.ndarray) -> None:
        inside = (scores >= self.low) & (scores <= self.high)
        rows, scores = np.r_[self.rows, rows[inside]], np.r_[self.scores, scores[inside]]
        if len(rows) > self.wanted:
            least = np.partition(scores, len(scores) - self.wanted)[len(scores) - self.wanted]
            rows, scores = rows[scores >= least], scores[scores >= least]
            best = np.lexsort((self.places[rows], self.ids[rows], -scores))[: self.wanted]
            rows, scores = rows[best], scores[best]
        self.rows, self.scores = rows, scores

    def floor(self):
        """Thresholds strictly below this end the search."""
        return self.scores.min() if len(self.rows) == self.wanted else self.low


class _Positives(Search):
    """The nearest rows of the anchor's label but itself."""

    def __init__(self, key, block):
        super().__init__(-np.inf, np.inf, block.ids, block.keys)
        self.key, self.keys = key, block.keys

    def take(self, rows, scores):
        other = self.keys[rows] != self.key
        super().take(rows[other], scores[other])


class _Negatives:
    """All windows of an anchor, fed from one scan."""

    def __init__(self, label, positive_scores, block):
        self.label, self.labels = label, block.labels
        self.windows = [Search(-(-LOW_PERCENT * s // 100), s, block.ids, block.keys) for s in positive_scores]
        self.least = min(w.low for w in self.windows)

    def take(self, rows, scores):
        near = scores >= self.least
        rows, scores = rows[near], scores[near]
        other = self.labels[rows] != self.label
        rows, scores = rows[other], scores[other]
        if len(rows):
            for window in self.windows:
                window.take(rows, scores)

    def floor(self):
        return min(w.floor() for w in self.windows)


class _Block:
    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches).combine_chunks()
        column = {n: table.column(n).chunk(0) for n in table.column_names}
        self.keys = column["key"].to_numpy()
        self.given = column["vec_id"]
        # null ids stand last among equal scores
        self.ids = self.given.fill_null(2**63 - 1).to_numpy()
        self.labels = column["label"].to_numpy()
        self.x = exact(column["x"].flatten().to_numpy().reshape(len(self.keys), -1))
        self.whole, self.of_label = None, {}

    def lists(self, label: int | None) -> Lists | None:
        """Sorted lists of the rows of one label, or of all."""
        if label is None:
            self.whole = self.whole or Lists(self.x, np.arange(len(self.x)))
            return self.whole
        if label not in self.of_label:
            members = np.flatnonzero(self.labels == label)
            self.of_label[label] = Lists(self.x[members], members) if len(members) else None
        return self.of_label[label]

    def found(self, key: int, number: int, search: Search) -> dict:
        n = len(search.rows)
        return {
            "anchor_key": [key] * n, "search": [number] * n, "score": [int(s) for s in search.scores],
            "id": self.given.take(pa.array(search.rows, pa.int64())).to_pylist(), "key": self.keys[search.rows].tolist(),
        }


def exact(x: np.ndarray) -> np.ndarray:
    """As doubles where inner products of such rows stay whole in them, which is much faster."""
    return x.astype(np.float64) if x.size and float(np.abs(x).max()) ** 2 * x.shape[1] < 2**52 else x


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BLOCK_ROWS:
            yield _Block(held)
            held, n = [], 0
    if n:
        yield _Block(held)


def _anchors(files: list[str]) -> Iterator[pa.RecordBatch]:
    """The written anchors, some at a time."""
    for path in files:
        store, inner = open_path(path)
        with store.open_input_file(inner) as source:
            yield from pq.ParquetFile(source).iter_batches(ANCHOR_ROWS)


def _searched(files: list[str], windows: bool):
    """A task's part: for each of its blocks, every anchor."""

    def run(batches):
        for block in _blocks(batches):
            for batch in _anchors(files):
                out = {c.split()[0]: [] for c in FOUND_DDL.split(", ")}
                vectors = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
                if block.x.dtype == np.float64:
                    vectors = exact(vectors)
                labels = batch.column("label").to_numpy()
                keys = batch.column("key").to_pylist()
                scores = batch.column("scores").to_pylist() if windows else None
                for label in np.unique(labels).tolist():
                    lists = block.lists(None if windows else label)
                    if lists is None:
                        continue
                    group = np.flatnonzero(labels == label)
                    bounds = lists.thresholds(vectors[group])
                    for i, bound in zip(group.tolist(), bounds):
                        search = _Negatives(label, scores[i], block) if windows else _Positives(keys[i], block)
                        lists.scan(vectors[i], bound, search)
                        for number, one in enumerate(search.windows if windows else [search]):
                            for name, values in block.found(keys[i], number, one).items():
                                out[name] += values
                if out["key"]:
                    yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(c.split()[0], pa.int32() if c.endswith(" int") else pa.int64()) for c in FOUND_DDL.split(", ")]))

    return run


def _best(found: DataFrame, by: list[str]) -> DataFrame:
    """Of what all blocks found, the first rows of each search, numbered from 1."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"), "key")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= WANTED)


def hard_negatives(vectors: DataFrame, every: int = ANCHORS) -> DataFrame:
    """For each anchor of ``vectors(vec_id, embedding, label)`` and positive, the hardest negatives below it."""
    spark = vectors.sparkSession
    label = F.when(F.col("vec_id") % SHIFTED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    whole = vectors.select("vec_id", F.col("label").cast("int").alias("label"), "embedding").mapInArrow(_integers, POINT_DDL)
    rows = written(whole.select(F.monotonically_increasing_id().alias("key"), "vec_id", label.cast("int").alias("label"), "x"), "points")
    usual = rows.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    out = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if usual is None:
        return spark.createDataFrame([], out)
    rows = rows.filter(F.size("x") == usual["size"])
    n_blocks = max(-(-usual.n // BLOCK_ROWS), spark.sparkContext.defaultParallelism)
    blocks = rows.repartition(n_blocks)
    anchors = written(rows.filter(F.col("vec_id") % every == 0), "anchors")
    near = blocks.mapInArrow(_searched(anchors.inputFiles(), False), FOUND_DDL)
    positives = written(
        _best(near, ["anchor_key"]).select(
            "anchor_key", (F.col("rank") - 1).alias("search"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id")
        ),
        "positives",
    )
    held = positives.filter("positive_score >= 0").groupBy("anchor_key").agg(
        F.sort_array(F.collect_list(F.struct("search", "positive_score"))).alias("p")  # at most five
    )
    asked = written(
        anchors.join(held, F.col("key") == F.col("anchor_key")).select("key", "label", "x", F.col("p.positive_score").alias("scores")), "windows"
    )
    found = blocks.mapInArrow(_searched(asked.inputFiles(), True), FOUND_DDL)
    ids = anchors.select(F.col("key").alias("anchor_key"), F.col("vec_id").alias("anchor_id"))
    return (
        _best(found, ["anchor_key", "search"])
        .join(positives, ["anchor_key", "search"])
        .join(ids, "anchor_key")
        .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives(read(spark, folder, "embeddings", "vec_id", "embedding", "label"))


SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM r AS a JOIN r AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""
