"""N-gram Jaccard join with adaptive multi-match prefixes.

A text is the set of its distinct word shingles, and two texts link when the Jaccard similarity of
their sets reaches the threshold.  Shingles are put into one global order, rare ones first.  If x
has n shingles and must share at least t of them with any partner, two linked texts share ``m``
shingles within their prefixes of ``n - t + m``.  A longer prefix (larger m) meets more texts, but
asks for more meetings before a pair is verified.  Every text picks the m with the least estimated
cost: meetings, plus verifications, of which there are at most meetings / m.  A pair is judged by
the smaller m of its two texts, within the prefixes of that m.

Frequent shingles never form all pairs of their texts.  Where many texts meet in one prefix shingle,
each is first compared with a few leaders of that shingle and joins the ball around a leader it
links with; then only centres of balls, and texts in none, are paired.  Distance (1 - similarity) is
a metric: members of two balls can link only if their centres are within the threshold plus both
radii, and such balls are compared text by text, in blocks, if nothing else has connected them.  So
no link between components is lost, while links inside a ball need not be listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import BROADCAST_BYTES, Staging, broadcast_if_small, estimated_bytes
from .arrowtext import mix, row_slices, shingles, text_buffer, words
from .components import connected_components
from .shipping import map_arrow

SHINGLE = 5
#: Threshold in hundredths.
SIMILAR = 75
#: Largest number of prefix shingles a pair may be asked to share.
MOST_MATCHES = 4
#: Cost of verifying a pair, in meetings of two texts in one shingle.
VERIFY_COST = 8.0
#: Counters of the frequency estimate, as a power of two; and counters in one row of it.
SKETCH_BITS = 20
_CHUNK = 1 << 14
#: Texts that may meet in a shingle before leaders are used, leaders, and rounds of them.
CROWD = 24
LEADERS = 4
ROUNDS = 4
#: Texts of a block when near balls are compared text by text.
BLOCK = 256
#: Rows of one shingle that are sorted together; a more frequent one is dealt out.
_TOGETHER_BITS = 14
#: A text has fewer than 2^30 words, so a prefix is shorter than this power of two.
_PLACE_BITS = 29
_SLICE = 1 << 20


def least_overlap(n):
    """Shingles a set of n must share with any set it links with."""
    return -(-SIMILAR * n // 100)


@dataclass
class ShingleSets:
    """Distinct shingle hashes of the texts of a batch, row by row, each row sorted by hash."""

    row: np.ndarray
    hash: np.ndarray
    size: np.ndarray

    @property
    def bounds(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.size)))

    def identity(self, salt: int) -> np.ndarray:
        """One number per row that depends on its set only."""
        total = np.zeros(len(self.size), np.uint64)
        some = self.size > 0
        if some.any():
            scattered = mix(self.hash ^ np.uint64(salt))
            total[some] = np.add.reduceat(scattered, self.bounds[:-1][some])
        return mix(total + self.size.astype(np.uint64)).view(np.int64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> ShingleSets:
    n_rows = len(offsets) - 1
    rows, hashes = words(data, offsets)
    found, bounds = shingles(rows, hashes, n_rows, size)
    row = np.repeat(np.arange(n_rows), np.diff(bounds))
    order = np.lexsort((found, row))
    row, found = row[order], found[order]
    first = np.ones(len(found), bool)
    first[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
    row, found = row[first], found[first]
    return ShingleSets(row, found, np.bincount(row, minlength=n_rows))


def _sets_of(column: pa.Array) -> Iterator[tuple[int, ShingleSets]]:
    data, offsets = text_buffer(column)
    for first, last in row_slices(offsets, _SLICE):
        part = data[offsets[first] : offsets[last]]
        yield first, shingle_sets(part, offsets[first : last + 1] - offsets[first])


def summarise(documents: DataFrame, salt: int) -> DataFrame:
    """``doc_id, x, y, n`` per text, and per task rows ``chunk, counts`` of the estimate.

    ``x`` names the set of a text, ``y`` is a second name to tell when two sets got one name.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, x long, y long, n long, chunk int, counts binary"
    names = [part.split()[0] for part in schema.split(", ")]

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, id_type = np.zeros(1 << SKETCH_BITS, np.uint32), pa.int64()
        for batch in batches:
            id_type, parts = batch.column(0).type, []
            for _, sets in _sets_of(batch.column(1)):
                places = (sets.hash >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                np.add.at(counters, places, np.uint32(1))
                parts.append((sets.identity(salt), sets.identity(salt + 1), sets.size))
            if not parts:
                continue
            x, y, n = (np.concatenate(c) for c in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(x, mask=n == 0),
                    pa.array(y),
                    pa.array(n.astype(np.int64)),
                    pa.nulls(len(n), pa.int32()),
                    pa.nulls(len(n), pa.binary()),
                ],
                names,
            )
        chunks = counters.reshape(-1, _CHUNK)
        used = np.flatnonzero(chunks.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [
                pa.nulls(len(used), id_type),
                *(pa.nulls(len(used), pa.int64()) for _ in range(3)),
                pa.array(used.astype(np.int32)),
                pa.array([chunks[k].tobytes() for k in used], pa.binary()),
            ],
            names,
        )

    return map_arrow(documents, per_task, schema)


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = np.frombuffer(counts, np.uint32).astype(np.uint64)
            sums[chunk] = sums.get(chunk, 0) + own
    for chunk, own in sums.items():
        own = np.minimum(own, np.iinfo(np.uint32).max).astype(np.uint32)
        yield pa.RecordBatch.from_arrays(
            [pa.array([chunk], pa.int32()), pa.array([own.tobytes()], pa.binary())],
            ["chunk", "counts"],
        )


def frequency_levels(summary: DataFrame) -> np.ndarray:
    """Four times the binary logarithm of each counter, which bounds its shingles' frequency.

    Counters are added up by tasks, first where they are and then by chunk; the driver gets
    ``2**SKETCH_BITS`` numbers whatever the size of the corpus.
    """
    rows = summary.filter("chunk IS NOT NULL").select("chunk", "counts")
    schema = "chunk int, counts binary"
    near = map_arrow(rows, _add_counts, schema)
    sums = map_arrow(near.repartition("chunk"), _add_counts, schema).toArrow()
    counters = np.zeros((1 << SKETCH_BITS) // _CHUNK * _CHUNK, np.uint32).reshape(-1, _CHUNK)
    for chunk, counts in zip(*(sums[c].to_pylist() for c in ("chunk", "counts")), strict=True):
        counters[chunk] = np.frombuffer(counts, np.uint32)
    return np.floor(4 * np.log2(1.0 + counters.ravel())).astype(np.uint8)


def prefixes(sets: ShingleSets, level: np.ndarray, noise: float):
    """Places of the prefix shingles in the global order, and each row's number of matches m.

    Returns row, hash, level, place (from 1) and the rows' m.
    """
    own_level = level[(sets.hash >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    order = np.lexsort((sets.hash, own_level, sets.row))  # stays grouped by row
    hashes, own_level, row = sets.hash[order], own_level[order], sets.row
    starts, size = sets.bounds[:-1], sets.size
    place = np.arange(len(row)) - starts[row] + 1
    meetings = np.maximum(np.exp2(own_level / 4.0) - 1 - noise, 0)
    summed = np.concatenate(([0.0], np.cumsum(meetings)))
    need = least_overlap(size)
    best, least = np.ones(len(size), np.int64), np.full(len(size), np.inf)
    for m in range(1, MOST_MATCHES + 1):
        end = np.minimum(size - need + m, size)
        cost = (summed[starts + end] - summed[starts]) * (1 + VERIFY_COST / m)
        better = (cost < least) & (m <= np.maximum(need, 1))
        best, least = np.where(better, m, best), np.where(better, cost, least)
    keep = place <= (size - need + best)[row]
    return row[keep], hashes[keep], own_level[keep], place[keep], best


def postings(documents: DataFrame, levels: np.ndarray, salt: int) -> DataFrame:
    """``token, part, x, info``: one row per text and prefix shingle, see :func:`unpacked`.

    ``part`` deals out the rows of a very frequent shingle, which is ``dealt``; it is 0 for the
    others.  Size, place, matches and that mark travel as one number.
    """
    shared = documents.sparkSession.sparkContext.broadcast(levels)
    noise = float(np.exp2(np.median(levels) / 4.0) - 1)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen = shared.value, set()
        for batch in batches:
            for _, sets in _sets_of(batch.column(1)):
                x = sets.identity(salt)
                # Copies name the same set, which is listed once per task.
                new = np.array([n > 0 and k not in seen for k, n in zip(x.tolist(), sets.size)])
                seen.update(x[new].tolist())
                row, hashes, own, place, m = prefixes(sets, level, noise)
                keep = new[row]
                row, hashes, own, place = row[keep], hashes[keep], own[keep], place[keep]
                bits = np.maximum(own.astype(np.int64) // 4 - _TOGETHER_BITS, 0)
                part = x[row] & ((np.int64(1) << bits) - 1)
                info = sets.size[row].astype(np.int64) << _PLACE_BITS | place
                info = (info << 2 | m[row] - 1) << 1 | (bits > 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hashes.view(np.int64)),
                        pa.array(part.astype(np.int32)),
                        pa.array(x[row]),
                        pa.array(info),
                    ],
                    ["token", "part", "x", "info"],
                )

    return map_arrow(documents, per_task, "token long, part int, x long, info long")


def unpacked(listed: DataFrame) -> DataFrame:
    """``token, part, x, n, place, m, dealt`` of postings and further columns."""
    place = F.shiftright("info", 3).bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return listed.withColumns(
        {
            "n": F.shiftright("info", _PLACE_BITS + 3).cast("int"),
            "place": place.cast("int"),
            "m": (F.shiftright("info", 1).bitwiseAND(F.lit(3)) + 1).cast("int"),
            "dealt": F.col("info").bitwiseAND(F.lit(1)) == 1,
        }
    ).drop("info")


def full_sets(documents: DataFrame, salt: int) -> DataFrame:
    """``x, shingles`` of every text that has any."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in _sets_of(batch.column(1)):
                some = np.flatnonzero(sets.size)
                lists = pa.ListArray.from_arrays(
                    pa.array(sets.bounds.astype(np.int32)), pa.array(sets.hash.view(np.int64))
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sets.identity(salt)[some]), lists.take(pa.array(some))],
                    ["x", "shingles"],
                )

    return map_arrow(documents, per_task, "x long, shingles array<long>")


@dataclass
class TextSets:
    """Finds the sets of named texts again, by the ids of rows that hold them."""

    rows: DataFrame
    classes: DataFrame
    salt: int

    def read(self, names: DataFrame, most: int) -> DataFrame:
        """``x, shingles`` of the sets in ``names`` (``x``), possibly more than once each.

        Texts are read where they lie; only if there may be too many names, of which there are at
        most ``most``, for their ids to be sent there, are texts shuffled to them.
        """
        ids = self.classes.join(names, "x").select(F.col("first").alias("wanted")).distinct()
        if estimated_bytes(most, 0, 4) <= BROADCAST_BYTES:
            ids = F.broadcast(ids)
        found = self.rows.join(ids, F.equal_null("doc_id", "wanted"), "left_semi")
        return full_sets(found, self.salt)


def verify(pairs: DataFrame, texts: TextSets, staging: Staging, name: str) -> DataFrame:
    """``a, b, similar, distance`` of the pairs of a written table, from their whole sets.

    The result is a written table too; the sets go from the texts to their pairs and nowhere else.
    """
    names = pairs.select(F.explode(F.array("a", "b")).alias("x")).distinct()
    sets = texts.read(names, 2 * pairs.count())
    at_a = sets.select(F.col("x").alias("a"), F.col("shingles").alias("set_a"))
    at_b = sets.select(F.col("x").alias("b"), F.col("shingles").alias("set_b"))
    shared = (
        pairs.join(at_a, "a")
        .join(at_b, "b")
        .select(
            "a",
            "b",
            F.size(F.array_intersect("set_a", "set_b")).cast("long").alias("both"),
            (F.size("set_a") + F.size("set_b")).cast("long").alias("together"),
        )
        # A set that several rows hold is read from each of them.
        .dropDuplicates(["a", "b"])
    )
    union = F.col("together") - F.col("both")
    judged = shared.select(
        "a",
        "b",
        (100 * F.col("both") >= SIMILAR * union).alias("similar"),
        (1 - F.col("both") / union).alias("distance"),
    )
    return staging.write(judged, name)


def _with_centres(shared: DataFrame, balls: DataFrame) -> DataFrame:
    """Postings with the centre of the ball each text is in, itself if in none."""
    return shared.join(balls.select("x", "centre", "radius"), "x", "left").select(
        *[F.col(name) for name in shared.columns],
        F.coalesce("centre", "x").alias("c"),
        F.coalesce("radius", F.lit(0.0)).alias("radius"),
    )


def form_balls(
    shared: DataFrame, texts: TextSets, staging: Staging
) -> tuple[DataFrame, DataFrame]:
    """Balls ``x, centre, radius`` and links ``a, b`` found while forming them.

    Only crowded shingles take part.  Leaders are drawn anew each round by a hash.
    """
    spark = shared.sparkSession
    balls = spark.createDataFrame([], "x long, centre long, radius double")
    links = spark.createDataFrame([], "a long, b long")
    crowd = shared.filter(F.col("met") > CROWD).select("token", "part", "x")
    # Parts are small, so a frequent shingle is no burden; each part has leaders of its own.
    part = Window.partitionBy("token", "part")
    for number in range(ROUNDS):
        # Dealt out once: distinct rows, their number and the leaders all go by shingle.
        dealt = _with_centres(crowd, balls).select("token", "part", "c")
        members = dealt.repartition("token", "part").distinct()
        lot = F.struct(F.xxhash64("c", F.lit(number)).alias("lot"), "c")
        group = F.pmod(F.xxhash64("c", F.lit(7)), F.lit(LEADERS))
        led = members.select(
            "c",
            F.count("c").over(part).alias("size"),
            *[F.min(F.when(group == k, lot)).over(part).alias(f"of_{k}") for k in range(LEADERS)],
        ).filter(F.col("size") > CROWD)
        # A centre with members stays one; all others look for a leader.
        centres = balls.select(F.col("centre").alias("c")).distinct()
        met = (
            led.join(centres, "c", "left_anti")
            .select("c", F.explode(F.array(*[f"of_{k}.c" for k in range(LEADERS)])).alias("leader"))
            .filter("c <> leader")
            .groupBy("c", "leader")
            .agg(F.count(F.lit(1)).alias("shared"))
        )
        best = met.groupBy("c").agg(F.max(F.struct("shared", "leader")).alias("best"))
        pairs = staging.write(
            best.select(F.col("c").alias("a"), F.col("best.leader").alias("b")), f"seek-{number}"
        )
        if pairs.isEmpty():
            break
        found = verify(pairs, texts, staging, f"found-{number}").filter("similar")
        links = links.unionByName(found.select("a", "b"))
        # Who has found a leader follows it, unless others have found it as theirs.
        followed = found.select(F.col("b").alias("a")).distinct()
        joined = found.join(followed, "a", "left_anti").select(
            F.col("a").alias("x"), F.col("b").alias("centre"), F.col("distance").alias("radius")
        )
        balls = staging.write(balls.unionByName(joined), f"balls-{number}")
    return balls, links


def meeting_pairs(shared: DataFrame, balls: DataFrame) -> DataFrame:
    """``a, b`` of centres that may link or whose members may."""
    rows = _with_centres(shared, balls)
    centres = balls.select(F.col("centre").alias("c"), F.lit(True).alias("ball")).distinct()
    rows = rows.join(centres, "c", "left").select(
        "token",
        "c",
        F.col("n").alias("least"),
        F.col("n").alias("most"),
        "place",
        "m",
        F.coalesce("ball", F.lit(False)).alias("ball"),
    )
    # Only balls have several members, and so several rows of one shingle.
    members = rows.filter("ball").groupBy("token", "c", "ball").agg(
        F.min("least").alias("least"),
        F.max("most").alias("most"),
        F.min("place").alias("place"),
        F.max("m").alias("m"),
    )
    rows = rows.filter("NOT ball").unionByName(members)

    def side(prefix: str) -> DataFrame:
        return rows.select(
            "token", *[F.col(c).alias(f"{prefix}_{c}") for c in rows.columns if c != "token"]
        )

    near_sizes = F.expr(
        f"100 * a_most >= {SIMILAR} * b_least AND 100 * b_most >= {SIMILAR} * a_least"
    )
    ball = F.col("a_ball") | F.col("b_ball")
    # What is left behind a shared shingle bounds how many more two texts can share.
    enough = F.expr(
        f"{100 + SIMILAR} * (1 + least(a_most - a_place, b_most - b_place))"
        f" >= {SIMILAR} * (a_most + b_most)"
    )
    m = F.least("a_m", "b_m")
    # What two sets of these sizes must share; their first m common shingles lie before the rest.
    whole = 100 + SIMILAR
    need = F.expr(f"({SIMILAR} * (a_most + b_most) + {whole - 1}) DIV {whole}")
    inside = (F.col("a_place") <= F.col("a_most") - need + m) & (
        F.col("b_place") <= F.col("b_most") - need + m
    )
    met = side("a").join(side("b"), "token").filter("a_c < b_c")
    met = met.filter(near_sizes).filter(ball | inside)
    counted = met.groupBy("a_c", "b_c").agg(
        F.count(F.lit(1)).alias("shared"),
        F.max(F.when(enough, 1).otherwise(0)).alias("enough"),
        F.max(m).alias("m"),
        F.max(ball.cast("int")).alias("ball"),
    )
    wanted = (F.col("ball") == 1) | ((F.col("enough") == 1) & (F.col("shared") >= F.col("m")))
    return counted.filter(wanted).select(F.col("a_c").alias("a"), F.col("b_c").alias("b"))


def near_balls(checked: DataFrame, balls: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs ``a, b, distance`` of unconnected centres whose members may still link."""
    radii = balls.groupBy(F.col("centre").alias("c")).agg(F.max("radius").alias("reach"))
    known = parts.select(F.col("id").alias("c"), "component")
    rows = checked.filter("NOT similar")
    for side in ("a", "b"):
        rows = rows.join(radii.toDF(side, f"reach_{side}"), side, "left")
        rows = rows.join(known.toDF(side, f"part_{side}"), side, "left")
    reach = F.coalesce("reach_a", F.lit(0.0)) + F.coalesce("reach_b", F.lit(0.0))
    # The last digits of a sum of distances must not decide.
    return rows.filter(
        (F.coalesce("part_a", "a") != F.coalesce("part_b", "b"))
        & (reach > 0)
        & (F.col("distance") <= 1 - SIMILAR / 100 + reach + 1e-9)
    ).select("a", "b", "distance")


def cloud_links(
    apart: DataFrame, balls: DataFrame, parts: DataFrame, texts: TextSets, staging: Staging
) -> DataFrame:
    """Links ``a, b`` between unconnected members of balls that lie near each other.

    Balls that are near make up a cloud.  The texts of a cloud are dealt out to blocks, and every
    two blocks are compared by one task, which returns a link per text and component at most.
    """
    clouds = connected_components(apart.select("a", "b"), staging, "clouds")
    centres = clouds.select(F.col("id").alias("x"), F.col("component").alias("cloud"))
    members = balls.select("x", F.col("centre").alias("id")).join(clouds, "id")
    members = centres.unionByName(members.select("x", F.col("component").alias("cloud")))
    sizes = members.groupBy("cloud").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    known = parts.select(F.col("id").alias("x"), "component")
    placed = staging.write(
        members.join(sizes, "cloud")
        .join(known, "x", "left")
        .select(
            "x",
            "cloud",
            "blocks",
            F.coalesce("component", "x").alias("part"),
            F.pmod(F.xxhash64("x"), "blocks").alias("own"),
        ),
        "placed",
    )
    sets = texts.read(placed.select("x"), placed.count()).dropDuplicates(["x"])
    sets = staging.write(sets, "cloud-sets")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    dealt = (
        placed.select("*", other)
        .join(sets, "x")
        .select(
            "cloud",
            F.least("own", "other").alias("low"),
            F.greatest("own", "other").alias("high"),
            "x",
            "part",
            "own",
            "shingles",
        )
    )
    found = dealt.groupBy("cloud", "low", "high").applyInArrow(_compare_blocks, "a long, b long")
    return staging.write(found.distinct(), "cloud-links")


def _compare_blocks(rows: pa.Table) -> pa.Table:
    """Links between the two blocks of a group, or within it if they are the same."""
    lists = rows["shingles"].combine_chunks()
    names, parts = rows["x"].to_numpy(), rows["part"].to_numpy()
    own, high = rows["own"].to_numpy(), rows["high"][0].as_py()
    one_block = rows["low"][0].as_py() == high
    hashes = lists.flatten().to_numpy()
    sizes = np.diff(lists.offsets.to_numpy())
    starts = np.cumsum(sizes) - sizes
    distinct, ids = np.unique(hashes, return_inverse=True)
    here, links = np.zeros(len(distinct), bool), []
    ahead = np.flatnonzero(own == high)
    if len(ahead):
        ahead_ids = np.concatenate([ids[starts[k] : starts[k] + sizes[k]] for k in ahead])
        ahead_starts = np.cumsum(sizes[ahead]) - sizes[ahead]
    for k in range(len(names)) if len(ahead) else []:
        if not one_block and own[k] == high:
            continue
        mine = ids[starts[k] : starts[k] + sizes[k]]
        here[mine] = True
        both = np.add.reduceat(here[ahead_ids].astype(np.int64), ahead_starts)
        here[mine] = False
        union = sizes[k] + sizes[ahead] - both
        linked = (100 * both >= SIMILAR * union) & (parts[ahead] != parts[k])
        # One link to each component is enough.
        _, first = np.unique(parts[ahead][linked], return_index=True)
        links += [(names[k], other) for other in names[ahead][linked][first]]
    a, b = zip(*links, strict=True) if links else ((), ())
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def jaccard_components(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    staging: Staging | None = None,
) -> DataFrame:
    """``<id>, n_shingles, component_id`` for every row.

    Words are lower-cased (A-Z) and cut at ASCII white space.  A text of fewer than five words is
    one shingle; a null text and one without words are empty and link with nothing, not even with
    each other.  Rows with equal sets are copies and share a component.  Repeated rows are kept;
    rows with a null id link like others, but only ids name components.  An empty table gives no
    rows.  Other columns are not read.
    """
    staging = staging or Staging(documents.sparkSession)
    rows = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    for salt in range(0, 64, 2):
        summary = staging.write(summarise(rows, salt), f"summary-{salt}")
        members = summary.filter("chunk IS NULL").select("doc_id", "x", "y", "n")
        classes = staging.write(
            members.filter("x IS NOT NULL")
            .groupBy("x")
            .agg(
                F.min("doc_id").alias("first"),
                F.min(F.struct("y", "n")).alias("low"),
                F.max(F.struct("y", "n")).alias("high"),
            )
            .select("x", "first", (F.col("low") != F.col("high")).alias("clash")),
            f"classes-{salt}",
        )
        if classes.filter("clash").isEmpty():
            break  # else two different sets got one name: name them all anew
    classes = classes.select("x", "first")
    listed = postings(rows, frequency_levels(summary), salt)
    together = Window.partitionBy("token", "part")
    # The rows of one part are few, so a frequent shingle is no burden; its parts always meet, so a
    # text that is the only one in its part stays.
    ends = [F.min("x").over(together).alias("low"), F.max("x").over(together).alias("high")]
    counted = listed.select("*", F.count("x").over(together).alias("count"), *ends)
    met = F.when(F.col("dealt"), 1 << _TOGETHER_BITS).otherwise(F.col("count"))
    shared = staging.write(
        unpacked(counted)
        .filter("low <> high OR dealt")
        .dropDuplicates(["token", "part", "x"])
        .select("token", "part", "x", "n", "place", "m", met.cast("int").alias("met")),
        "shared",
    )
    texts = TextSets(rows, classes, salt)
    balls, links = form_balls(shared, texts, staging)
    pairs = staging.write(meeting_pairs(shared, balls), "pairs")
    checked = verify(pairs, texts, staging, "checked")
    links = links.unionByName(checked.filter("similar").select("a", "b"))
    found = connected_components(links, staging, "near")
    if not balls.isEmpty():
        apart = staging.write(near_balls(checked, balls, found), "apart")
        if not apart.isEmpty():
            links = links.unionByName(cloud_links(apart, balls, found, texts, staging))
            found = connected_components(links, staging, "all")
    # The least id of a component, over the copies of all its sets.
    own = classes.join(found, classes["x"] == found["id"], "left").select(
        "x", "first", F.coalesce("component", "x").alias("component")
    )
    least = own.groupBy("component").agg(F.min("first").alias("component_id"))
    named = staging.write(own.join(least, "component").select("x", "component_id"), "named")
    return members.join(named, "x", "left").select(
        F.col("doc_id").alias(id_column),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias(
            "component_id"
        ),
    )
