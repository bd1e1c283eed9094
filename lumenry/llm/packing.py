"""Items of varying length packed into containers of fixed capacity, planned over the histogram of lengths.

Best fit decreasing runs on counts: the histogram has at most one row for each length up to the capacity,
however many items there are, and containers of equal content are planned together as ranges of container
numbers. Items then take the planned slots by joining on their rank within their length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import cut_lineage

#: Parts of each length that are ranked separately, so that a length that a third of all items have isn't one task's.
PARTS = 256
SLOTS = "spec_id bigint, size bigint, bucket bigint, first_rank bigint, items bigint, first_container bigint"
#: Items and slots meet by the bucket of the item's rank; the buckets of a length are so many that few slots lie in each.
SLOTS_PER_BUCKET = 4


def plan(lengths: Mapping[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Slots (length, first rank, items, first container): the items of a length with ranks from the first take one
    place each in the containers from the first. Also the number of containers."""
    slots, containers = [], 0
    free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    used: list[int] = []  # rooms that some container has, sorted
    for length in sorted((n for n in lengths if n > 0), reverse=True):
        rank, left = 0, lengths[length]
        at = bisect_left(used, length)
        while left and at < len(used):
            room = used[at]
            first, n = free[room].pop()
            taken = min(n, left)
            slots.append((length, rank, taken, first))
            if taken < n:
                free[room].append((first + taken, n - taken))
            elif not free[room]:
                del used[at]
            _add(free, used, room - length, first, taken)
            rank, left = rank + taken, left - taken
            at = bisect_left(used, length)
        fit = capacity // length
        for each, n in ((fit, left // fit), (left % fit, 1)):
            if each and n:
                for _ in range(each):
                    slots.append((length, rank, n, containers))
                    rank += n
                _add(free, used, capacity - each * length, containers, n)
                containers += n
    return slots, containers


def _add(free: list[list[tuple[int, int]]], used: list[int], room: int, first: int, n: int) -> None:
    if room:
        if not free[room]:
            insort(used, room)
        free[room].append((first, n))


def bucketed(slots: list[tuple[int, int, int, int]]) -> tuple[list[tuple[int, int, int, int, int]], dict[int, int]]:
    """(length, bucket, first rank, items, first container) of slots cut at the bounds of buckets of ranks, and the width of a bucket of each length."""
    total, number = Counter(), Counter()
    for length, _, items, _ in slots:
        total[length] += items
        number[length] += 1
    width = {length: max(1, total[length] * SLOTS_PER_BUCKET // number[length]) for length in total}
    found = []
    for length, rank, items, container in slots:
        end = rank + items
        while rank < end:
            bucket = rank // width[length]
            n = min(end, (bucket + 1) * width[length]) - rank
            found.append((length, bucket, rank, n, container))
            rank, container = rank + n, container + n
    return found, width


def pack(items: DataFrame, id_column: str, size_column: str, specs: DataFrame) -> DataFrame:
    """(spec_id, id, piece_no, start, size, container_id) for each container_spec and item.

    An item beyond the capacity is cut into full pieces and a rest. Items of size 0, of null size or of a
    negative one take no room and are spread over the containers. Specs without a positive capacity give no
    rows; an empty table gives none. Rows with equal ids are separate items.
    """
    spark = items.sparkSession
    capacities = {r["spec_id"]: r["capacity_tokens"] for r in specs.where("capacity_tokens > 0").select("spec_id", "capacity_tokens").collect()}
    if not capacities:
        return items.limit(0).select(F.lit(0).cast("bigint").alias("spec_id"), id_column, F.lit(0).alias("piece_no"), F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("container_id"))
    known = items.select(id_column, F.greatest(F.coalesce(F.col(size_column).cast("bigint"), F.lit(0)), F.lit(0)).alias("total"))
    by_spec = F.explode(F.array(*[F.struct(F.lit(s).cast("bigint").alias("spec_id"), F.lit(c).cast("bigint").alias("capacity")) for s, c in capacities.items()]))
    sized = known.select(id_column, "total", by_spec.alias("spec")).select(id_column, "total", "spec.*")
    last = F.greatest(F.ceil(F.col("total") / F.col("capacity")).cast("int") - 1, F.lit(0))
    pieces = sized.select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece_no")).select("spec_id", id_column, "piece_no", (F.col("piece_no") * F.col("capacity")).alias("start"), F.least("capacity", F.col("total") - F.col("piece_no") * F.col("capacity")).alias("size"))
    lengths: dict[int, dict[int, int]] = {s: {} for s in capacities}
    for r in pieces.groupBy("spec_id", "size").agg(F.count("*").alias("n")).collect():  # at most the sum of the capacities
        lengths[r["spec_id"]][r["size"]] = r["n"]
    planned = {s: plan(lengths[s], c) for s, c in capacities.items()}
    cut = {s: bucketed(rows) for s, (rows, _) in planned.items()}
    slots = spark.createDataFrame([(s, *slot) for s, (rows, _) in cut.items() for slot in rows], SLOTS)
    widths = spark.createDataFrame([(s, length, w) for s, (_, width) in cut.items() for length, w in width.items()], "spec_id bigint, size bigint, width bigint")
    totals = F.create_map(*[F.lit(x).cast("bigint") for s, (_, n) in planned.items() for x in (s, max(n, 1))])
    part = F.pmod(F.xxhash64(id_column, "piece_no"), F.lit(PARTS))
    parted = pieces.select("*", part.alias("part"))
    counts = parted.groupBy("spec_id", "size", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("spec_id", "size").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("spec_id", "size", "part", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(W.partitionBy("spec_id", "size", "part").orderBy(id_column, "piece_no")) - 1
    ranked = parted.withColumn("within", within).join(offsets.hint("merge"), ["spec_id", "size", "part"]).withColumn("rank", F.col("within") + F.col("before")).drop("within", "before", "part")
    spread = ranked.where("size = 0").select("spec_id", id_column, "piece_no", "start", "size", F.pmod("rank", totals[F.col("spec_id")]).alias("container_id"))
    fits = (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("items"))
    met = ranked.where("size > 0").join(widths, ["spec_id", "size"]).withColumn("bucket", (F.col("rank") / F.col("width")).cast("bigint"))
    placed = met.join(slots, ["spec_id", "size", "bucket"]).where(fits).select("spec_id", id_column, "piece_no", "start", "size", (F.col("first_container") + F.col("rank") - F.col("first_rank")).alias("container_id"))
    return placed.unionByName(spread)


def pack_documents(counts: DataFrame, specs: DataFrame) -> DataFrame:
    """Packs (doc_id, tokens). The counts are written once, as planning and placing both read them."""
    return pack(cut_lineage(counts), "doc_id", "tokens", specs)


def fill(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, containers, tokens, least, fullest, filled): containers with content, the least number that could hold
    as many tokens, the tokens of the fullest one, and the filled share of their room."""
    each = packed.where("size > 0").groupBy("spec_id", "container_id").agg(F.sum("size").alias("size"))
    total = each.groupBy("spec_id").agg(F.count("*").alias("containers"), F.sum("size").alias("tokens"), F.max("size").alias("fullest"))
    least = F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least")
    return total.join(specs.select("spec_id", "capacity_tokens"), "spec_id").select("spec_id", "containers", "tokens", least, "fullest", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("filled"))
