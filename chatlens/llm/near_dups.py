"""Near-duplicate documents by DartMinHash over weighted word shingles.

A text is the multiset of its SHINGLE-word shingles; the weight of a shingle is
how often it occurs.  Every unit of weight is a region onto which hashed darts
are thrown: a Poisson process along the rank axis, fixed by the shingle and the
unit alone.  A document looks at the darts of all its regions up to a rank that
leaves about COORDINATES * log(COORDINATES) of them, whatever its length, and
keeps the earliest dart of each coordinate.  Two documents agree in a
coordinate with a probability equal to their weighted Jaccard similarity.

Bands of coordinates bring similar documents into common buckets.  Each member
is compared with one of the leaders of its buckets.  Members that this leaves
apart from their leader's group in some bucket are then compared with the closest members of other groups,
by signature, in a bounded part of their largest bucket, which joins most of a
large group.  This only leaves less to do for the last step, which compares
every two members of a bucket that are not of one group yet: in small buckets
those whose signatures agree enough, in others those that share one of their
least common regions, as any two of enough similarity do (a prefix filter).
Crowds that share even those meet in blocks of bounded size.  All comparisons
that make a link are exact, on the shingles themselves.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.llm.common import cut, drop, map_arrow, ship, written
from chatlens.llm.textbytes import mix, pieces, text_bytes, word_bounds, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
COORDINATES = BANDS * ROWS
#: Darts that a document looks at, about: enough to fill all coordinates most of the time.
DARTS = COORDINATES * np.log(COORDINATES) + 2 * COORDINATES
#: Regions and darts worked on at once.
AT_ONCE = 200_000
#: Agreement of two signatures under which an exact comparison is not made:
#: four standard deviations under SIMILARITY.
LEAST_AGREEMENT = SIMILARITY - 4 * np.sqrt(SIMILARITY * (1 - SIMILARITY) / COORDINATES)
#: Closest members of other groups that an unlinked member is compared with in a bucket.
CLOSEST = 4
#: Members of a bucket that meet in one task when groups are compared.
MET = 4096
#: Members of a bucket, or texts with a common region, of which all pairs are made as rows.
FEW = 64
#: Texts, and bytes of their regions, that a block holds when blocks are compared.
BLOCK, BLOCK_BYTES = 1024, 2 << 20
#: Counters of how common regions are; those that share one count as equally common.
SLOTS = 1 << 22

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, which text) of all shingles; fewer words than SHINGLE are one shingle, none give none."""
    starts, ends = word_bounds(data, offsets)
    hashed = np.append(word_hashes(data, starts, ends)[0], np.zeros(SHINGLE, np.uint64))
    first = np.searchsorted(starts, offsets)
    words = np.diff(first)
    n = np.where(words >= SHINGLE, words - SHINGLE + 1, (words > 0).astype(np.int64))
    text = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[:-1][text]
    end = first[1:][text]
    out = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        out = out * GOLDEN + np.where(at + k < end, hashed[at + k], np.uint64(0))
    return mix(out), text


def regions(hashed: np.ndarray, text: np.ndarray) -> np.ndarray:
    """A different number for each unit of weight: of a shingle's occurrences in one text, the first, the second ..."""
    if not len(hashed):
        return hashed
    own = mix(hashed ^ (text.astype(np.uint64) + np.uint64(1)) * GOLDEN)
    order = np.argsort(own, kind="stable")
    same = np.append(False, own[order][1:] == own[order][:-1])
    run = np.arange(len(own))
    times = np.empty(len(own), np.uint64)
    times[order] = run - np.maximum.accumulate(np.where(same, 0, run))
    return mix(hashed + times * GOLDEN)


def dart_signatures(region: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """The earliest dart of each coordinate: an array of texts x COORDINATES; 0 for texts without weight.

    Texts are taken a few at a time, as short ones throw as many darts as long
    ones: about AT_ONCE regions and darts, or one text.
    """
    out = np.zeros((texts, COORDINATES), np.uint64)
    ends = np.cumsum(np.maximum(np.bincount(text, minlength=texts), DARTS))
    first = 0
    while first < texts:
        stop = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + AT_ONCE, "right")))
        own = slice(*np.searchsorted(text, [first, stop]))
        out[first:stop] = _thrown(region[own], text[own] - first, stop - first)
        first = stop
    return out


def _thrown(region: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    out = np.zeros((texts, COORDINATES), np.uint64)
    weight = np.bincount(text, minlength=texts).astype(float)
    reach = np.where(weight > 0, DARTS / np.maximum(weight, 1), 0.0)
    todo = weight > 0
    while todo.any():
        own = todo[text]
        seeds, of = region[own], text[own]
        # The rank axis in blocks of length 1, each with darts of its own.
        blocks = np.ceil(reach[of]).astype(np.int64)
        block = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        state = mix(np.repeat(seeds, blocks) + block.astype(np.uint64) * GOLDEN)
        of = np.repeat(of, blocks)
        rank, top = block.astype(float), np.minimum(block + 1, reach[of])
        places, ranks, darts = [], [], []
        while len(state):
            state = mix(state + GOLDEN)
            rank = rank - np.log(((state >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53)
            alive = rank < top
            state, rank, top, of = state[alive], rank[alive], top[alive], of[alive]
            dart = mix(state ^ GOLDEN)
            places.append(of * COORDINATES + (dart >> np.uint64(32)).astype(np.int64) * COORDINATES // (1 << 32))
            ranks.append(rank)
            darts.append(dart)
        place, rank, dart = np.concatenate(places), np.concatenate(ranks), np.concatenate(darts)
        least = np.full(texts * COORDINATES, np.inf)
        np.minimum.at(least, place, rank)
        earliest = rank == least[place]
        out.reshape(-1)[place[earliest]] = dart[earliest]
        empty = np.isinf(least.reshape(texts, COORDINATES)).any(axis=1) & todo
        todo = empty
        reach = np.where(todo, 2 * reach, reach)
    return out


def _sketched(documents: DataFrame) -> DataFrame:
    """Rows (doc_id, key, bands, signature) for every document; bands is empty for texts without words."""
    schema = "doc_id bigint, key binary, bands array<bigint>, signature binary"
    texts = documents.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20):
            n = batch.num_rows
            hashed, text = shingles(*text_bytes(batch.column("text")))
            signature = dart_signatures(regions(hashed, text), text, n)
            band = np.zeros((n, BANDS), np.uint64)
            for k in range(ROWS):
                band = mix(band * GOLDEN + signature.reshape(n, BANDS, ROWS)[:, :, k])
            band = mix(band + np.arange(BANDS, dtype=np.uint64) * GOLDEN).astype(np.int64)
            worded = np.bincount(text, minlength=n) > 0
            short = (signature >> np.uint64(48)).astype("<u2")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("key"),
                    pa.array([b if w else [] for b, w in zip(band.tolist(), worded)], pa.list_(pa.int64())),
                    pa.array([s.tobytes() for s in short], pa.binary()),
                ],
                names=["doc_id", "key", "bands", "signature"],
            )

    return map_arrow(texts, run, schema)


def _regions(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (key, regions) of the texts with a wanted key: their regions in order, five bytes each.

    Two different regions agree in 40 bits so rarely that a similarity is off
    by less than a millionth.
    """
    texts = documents.select(F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("key"), "text")
    texts = texts.join(wanted, "key", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20):
            hashed, text = shingles(*text_bytes(batch.column("text")))
            region = regions(hashed, text) >> np.uint64(24)
            ends = np.cumsum(np.bincount(text, minlength=batch.num_rows))
            own = [np.unique(r).view(np.uint8).reshape(-1, 8)[:, :5].tobytes() for r in np.split(region, ends[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(own, pa.binary())], names=["key", "regions"])

    return map_arrow(texts, run, "key binary, regions binary").dropDuplicates(["key"])


def _unpacked(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(packed, np.uint8).reshape(-1, 5)
    return out.view(np.uint64).reshape(-1)


def _linked(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs (a, b) of text keys whose weighted similarity, on all their regions, is SIMILARITY or more."""
    both = pairs.join(held.toDF("a", "of_a"), "a").join(held.toDF("b", "of_b"), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("of_a"), batch.column("of_b")):
                x, y = _unpacked(x.as_py()), _unpacked(y.as_py())
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= SIMILARITY * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return cut(map_arrow(both.select("a", "b", "of_a", "of_b"), compare, "a binary, b binary"))


def components(links: DataFrame) -> DataFrame:
    """Rows (key, root) for the keys in links (a, b): the least key of each connected group.

    Every round takes the least root among a key's neighbours and then the root
    of that root, so the number of rounds grows with the logarithm of the
    longest chain.  All state is in written tables.
    """
    ways = links.unionAll(links.select("b", "a")).unionAll(links.select("a", "a")).unionAll(links.select("b", "b"))
    ways = cut(ways.toDF("key", "other").distinct())
    state = ways.groupBy("key").agg(F.min("other").alias("root"))
    before = last = None
    while True:
        near = state.toDF("root", "further")
        state = cut(state.join(near, "root").select("key", F.col("further").alias("root")))
        if last is not None:
            drop(last)
        # What all roots come to, as a number: the same twice means that none moved.
        now = state.agg(F.sum(F.xxhash64("key", "root").cast("decimal(38,0)"))).first()[0]
        if now == before:
            drop(ways)
            return state
        before, last = now, state
        at = state.toDF("other", "root")
        state = ways.join(at, "other").groupBy("key").agg(F.min("root").alias("root"))


def _apart(buckets: DataFrame, nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs to compare for members that stayed out of the group of their bucket's leader.

    Such a member asks in the largest of its buckets for the CLOSEST members of
    other groups, by signature; _rest() sees to the others.  Buckets are dealt
    out in parts of MET members, about, by a hash that differs from bucket to
    bucket; members ask in their own part.
    """
    grouped = (
        buckets.join(groups.withColumnRenamed("key", "node"), "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
        .join(groups.toDF("leader", "leader_root"), "leader", "left")
        .withColumn("out", F.col("root") != F.coalesce("leader_root", "leader"))
    )
    asking = grouped.where("out").groupBy("node").agg(F.max(F.struct("n", "bucket")).alias("b"))
    asking = cut(asking.select("node", "b.bucket", "b.n"))
    open_buckets = asking.groupBy("bucket").agg(F.ceil(F.max("n") / MET).cast("int").alias("parts"))
    members = (
        grouped.select("bucket", "node", "root")
        .join(open_buckets, "bucket")
        .join(asking.select("bucket", "node", F.lit(True).alias("asks")), ["bucket", "node"], "left")
        .withColumn("asks", F.coalesce("asks", F.lit(False)))
        .join(nodes.select(F.col("key").alias("node"), "signature"), "node")
    )
    part = F.pmod(F.xxhash64("node", "bucket"), F.col("parts")).cast("int")
    members = members.select("bucket", part.alias("part"), "node", "root", "asks", "signature")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        held = np.frombuffer(b"".join(rows.signature), "<u2").reshape(-1, COORDINATES)
        root, found = pd.factorize(rows.root)[0], []
        for i in np.flatnonzero(rows.asks.to_numpy()):
            agreement = (held == held[i]).mean(axis=1)
            near = np.flatnonzero((agreement >= LEAST_AGREEMENT) & (root != root[i]))
            near = near[np.argsort(-agreement[near], kind="stable")[:CLOSEST]]
            found += [sorted((rows.node.iat[i], rows.node.iat[j])) for j in near]
        return pd.DataFrame(found, columns=["a", "b"])

    ship(nodes.sparkSession)
    return members.groupBy("bucket", "part").applyInPandas(run, "a binary, b binary").distinct()


def _agreeing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures agree in LEAST_AGREEMENT or more."""
    signs = nodes.select("key", "signature")
    both = pairs.join(signs.toDF("a", "sign_a"), "a").join(signs.toDF("b", "sign_b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(text_bytes(batch.column(c))[0], "<u2").reshape(-1, COORDINATES) for c in ("sign_a", "sign_b"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= LEAST_AGREEMENT))

    return map_arrow(both.select("a", "b", "sign_a", "sign_b"), run, "a binary, b binary")


def _commonness(held: DataFrame) -> np.ndarray:
    """How often the regions of each of SLOTS slots occur, up to 255.

    Counts are summed by blocks of slots, so the driver gets SLOTS bytes however many regions there are.
    """
    size = min(SLOTS, 1 << 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.uint32)
        for batch in pieces(batches, "regions", 1 << 20):
            slot = _unpacked(text_bytes(batch.column("regions"))[0].tobytes()) % np.uint64(SLOTS)
            slot, n = np.unique(slot.astype(np.int64), return_counts=True)
            total[slot] += n.astype(np.uint32)
        blocks = np.minimum(total, 255).astype(np.uint8).reshape(-1, size)
        used = np.flatnonzero(blocks.any(axis=1))
        counts = [zlib.compress(blocks[k].tobytes(), 1) for k in used.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts, pa.binary())], names=["block", "counts"])

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size, np.uint16)
        for counts in rows["counts"]:
            total = np.minimum(total + np.frombuffer(zlib.decompress(counts), np.uint8), 255).astype(np.uint16)
        return pd.DataFrame({"block": [rows["block"].iat[0]], "counts": [zlib.compress(total.astype(np.uint8).tobytes(), 1)]})

    schema = "block bigint, counts binary"
    found = map_arrow(held.select("regions"), run, schema).groupBy("block").applyInPandas(summed, schema).collect()
    out = np.zeros((SLOTS // size, size), np.uint8)
    for row in found:
        out[row.block] = np.frombuffer(zlib.decompress(row.counts), np.uint8)
    return out.reshape(-1)


def prefix(region: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, int]:
    """A text's least common regions, and how many of them other texts find it by.

    If a text is SIMILARITY or more alike to one that is no shorter, one of
    the former's regions that it is found by is among the latter's prefix.
    """
    n = len(region)
    order = np.lexsort((region, common[(region % np.uint64(SLOTS)).astype(np.int64)]))
    longest = n - int(np.ceil(SIMILARITY * n - 1e-6)) + 1
    return region[order[:longest]], n - int(np.ceil(2 * SIMILARITY / (1 + SIMILARITY) * n - 1e-6)) + 1


def _prefixes(held: DataFrame, common: np.ndarray) -> DataFrame:
    """Rows (region, node, root, weight, size, found) for the prefixes of texts (key, regions, root, weight).

    Regions that are surely no other text's are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "regions", 1 << 20):
            sizes, parts, found = [], [], []
            for packed in batch.column("regions"):
                region = _unpacked(packed.as_py())
                own, first = prefix(region, common)
                # A region that occurs once is this text's alone.
                again = common[(own % np.uint64(SLOTS)).astype(np.int64)] > 1
                sizes.append(len(region))
                parts.append(own[again].astype(np.int64))
                found.append(np.flatnonzero(again) < first)
            of = np.repeat(np.arange(batch.num_rows), [len(p) for p in parts])
            columns = [pa.array(np.concatenate(parts)), *(batch.column(c).take(pa.array(of)) for c in ("key", "root", "weight"))]
            columns += [pa.array(np.array(sizes)[of]), pa.array(np.concatenate(found))]
            yield pa.RecordBatch.from_arrays(columns, names=["region", "node", "root", "weight", "size", "found"])

    schema = "region bigint, node binary, root binary, weight bigint, size bigint, found boolean"
    return map_arrow(held.select("key", "regions", "root", "weight"), run, schema)


def block_links(rows: pd.DataFrame) -> pd.DataFrame:
    """Links (a, b) that join all groups (root) that two blocks of texts (block, node, root, regions) hold links between."""
    one, other = (rows[rows.block == b] for b in (rows.block.min(), rows.block.max()))
    sides, unpacked = [], []
    for side in (one, other):
        each = [_unpacked(r) for r in side.regions]
        unpacked.append((np.concatenate(each), np.repeat(np.arange(len(each)), [len(e) for e in each])))
        sides.append(np.array([len(e) for e in each], float))
    both = np.intersect1d(unpacked[0][0], unpacked[1][0])
    entries = []
    for region, text in unpacked:
        at = np.searchsorted(both, region)
        shared = at < len(both)
        shared[shared] = both[at[shared]] == region[shared]
        order = np.argsort(at[shared], kind="stable")
        entries.append((at[shared][order], text[shared][order]))
    common = np.zeros((len(one), len(other)), np.float32)
    for start in range(0, len(both), 1024):
        dense = []
        for (at, text), side in zip(entries, sides):
            own = slice(*np.searchsorted(at, [start, start + 1024]))
            dense.append(np.zeros((len(side), 1024), np.float32))
            dense[-1][text[own], at[own] - start] = 1
        common += dense[0] @ dense[1].T
    common = common.astype(float)
    root = pd.factorize(pd.concat([one.root, other.root]))[0]
    left, right = root[: len(one)], root[len(one) :]
    alike = common >= SIMILARITY * (sides[0][:, None] + sides[1][None, :] - common)
    x, y = np.nonzero(alike & (left[:, None] != right[None, :]))
    first = np.unique(np.minimum(left[x], right[y]) * len(root) + np.maximum(left[x], right[y]), return_index=True)[1]
    top, kept = list(range(len(root))), []

    def of(k: int) -> int:
        while top[k] != k:
            top[k] = k = top[top[k]]
        return k

    for i, j in zip(x[first], y[first]):
        p, q = of(left[i]), of(right[j])
        if p != q:
            top[p] = q
            kept.append(sorted((one.node.iat[i], other.node.iat[j])))
    return pd.DataFrame(kept, columns=["a", "b"])


def _in_blocks(rows: DataFrame, held: DataFrame) -> DataFrame:
    """Links between texts of different groups among those that share a region, for regions of many texts.

    Rows are (region, node, root, size, found, n, main); main is the root of a
    region's largest group, of which no two are compared.  Nor are two of
    which neither is found by the region, or of which one is too short for the
    other.  Each text is dealt into one block, with others of its most common
    region; main groups have blocks of their own.  Two blocks that hold such a
    pair meet once, in a task, however many regions they share.
    """
    active = F.col("root") != F.col("main")
    home = F.max(F.struct("n", "region", active.alias("active")))
    texts = rows.groupBy("node", "root", "size").agg(home.alias("home"))
    texts = texts.select("node", "root", "size", F.col("home.region").alias("home"), F.col("home.active").alias("active"))
    parts = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(5 * F.col("size")) / BLOCK_BYTES)).alias("parts")
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    dealt = texts.join(texts.groupBy("home", "active").agg(parts), ["home", "active"])
    blocks = written(dealt.select("node", "root", F.xxhash64("home", "active", part).alias("block")), "blocks")
    sides = (
        rows.join(blocks.select("node", "block"), "node")
        .groupBy("region", "block")
        .agg(F.max("found").alias("found"), F.max(active).alias("active"), F.min("size").alias("least"), F.max("size").alias("most"))
    )
    sides = written(sides, "sides")
    x, y = sides.alias("x"), sides.alias("y")
    near = (F.col("x.most") >= SIMILARITY * F.col("y.least") - 1e-6) & (F.col("y.most") >= SIMILARITY * F.col("x.least") - 1e-6)
    meet = (F.col("x.region") == F.col("y.region")) & (F.col("x.block") <= F.col("y.block")) & near
    meet &= (F.col("x.found") | F.col("y.found")) & (F.col("x.active") | F.col("y.active"))
    pairs = written(x.join(y, meet).select(F.col("x.block").alias("i"), F.col("y.block").alias("j")).distinct(), "meetings")
    ends = pairs.select("i", "j", F.col("i").alias("block")).unionAll(pairs.where("i <> j").select("i", "j", F.col("j").alias("block")))
    filled = blocks.join(held.withColumnRenamed("key", "node"), "node")
    met = ends.join(filled, "block").select("i", "j", "block", "node", "root", "regions")
    ship(rows.sparkSession)
    links = cut(met.groupBy("i", "j").applyInPandas(lambda own: block_links(own[["block", "node", "root", "regions"]]), "a binary, b binary"))
    drop(blocks, sides, pairs)
    return links


def _rest(buckets: DataFrame, nodes: DataFrame, held: DataFrame, groups: DataFrame, tried: DataFrame) -> DataFrame:
    """Links that join all groups of which two members share a bucket and are alike, apart from the pairs ``tried``."""
    weights = groups.groupBy("root").agg(F.count("*").alias("weight"))
    weighted = groups.join(weights, "root").withColumnRenamed("key", "node")
    grouped = buckets.select("bucket", "node", "n").join(weighted, "node", "left")
    grouped = grouped.withColumns({"root": F.coalesce("root", "node"), "weight": F.coalesce("weight", F.lit(1))})
    open_buckets = grouped.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    grouped = written(grouped.join(open_buckets.select("bucket"), "bucket"), "open")

    def paired(rows: DataFrame, by: str, fits) -> DataFrame:
        x, y = rows.alias("x"), rows.alias("y")
        both = x.join(y, (F.col(f"x.{by}") == F.col(f"y.{by}")) & (F.col("x.root") != F.col("y.root")) & fits)
        return both.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()

    pairs = paired(grouped.where(F.col("n") <= FEW).select("bucket", "node", "root"), "bucket", F.col("x.node") < F.col("y.node"))
    crowded = grouped.where(F.col("n") > FEW).select(F.col("node").alias("key"), "root", "weight").distinct()
    links = None
    if not crowded.isEmpty():
        crowd = written(held.join(crowded, "key"), "crowd")
        rows = written(_prefixes(crowd, _commonness(crowd)), "prefixes")
        shared = rows.groupBy("region").agg(
            F.count("*").alias("n"),
            F.max("found").alias("any"),
            F.min("root").alias("low"),
            F.max("root").alias("high"),
            F.max(F.struct("weight", "root")).alias("most"),
        )
        shared = shared.where("any and low <> high").select("region", "n", F.col("most.root").alias("main"))
        rows = written(rows.join(shared, "region"), "shared")
        fits = F.col("x.found") & (F.col("x.size") <= F.col("y.size")) & (F.col("x.size") >= SIMILARITY * F.col("y.size") - 1e-6)
        pairs = pairs.unionAll(paired(rows.where(F.col("n") <= FEW), "region", fits)).distinct()
        links = _in_blocks(rows.where(F.col("n") > FEW), held)
    more = written(_agreeing(pairs.join(tried, ["a", "b"], "left_anti"), nodes), "pairs")
    more = _linked(more, held)
    return more.unionAll(links) if links is not None else more


def near_duplicate_classes(documents: DataFrame) -> DataFrame:
    """A row per row of ``documents``: doc_id, text_key, class_key, class_id (the least doc_id of its class), class_size.

    Classes are the connected groups of texts linked by a weighted similarity
    of SIMILARITY or more; equal texts are of one class.  Texts without words,
    null ones among them, are alike only if equal (null is the empty text).
    Rows without an id are in their text's class, but give it no name.
    Repeated rows stay; other columns are left out; an empty table gives none.

    A pair of a similarity of just SIMILARITY is not compared with a probability
    of some 3e-6, having no bucket in common, and in buckets of up to FEW
    members of some 3e-5, as its signatures differ by chance; more similar
    pairs are missed far more rarely.  In larger buckets no pair is missed.
    """
    sketches = written(_sketched(documents), "sketches")
    nodes = sketches.groupBy("key").agg(F.any_value("bands").alias("bands"), F.any_value("signature").alias("signature"))
    nodes = written(nodes, "nodes")
    rows = nodes.select(F.explode("bands").alias("bucket"), F.col("key").alias("node"))
    leaders = (
        rows.groupBy("bucket")
        .agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("node"), "node")).alias("first"))
        .where("n > 1")
        .select("bucket", F.col("first.node").alias("leader"), "n")
    )
    buckets = written(rows.join(leaders, "bucket"), "buckets")
    held = written(_regions(documents, buckets.select(F.col("node").alias("key")).distinct()), "regions")
    # At first each member meets one leader, the first of those of its buckets.
    first = F.min(F.struct(F.xxhash64("leader"), "leader")).alias("f")
    pairs = buckets.where("node <> leader").groupBy("node").agg(first).select("node", F.col("f.leader").alias("leader"))
    tried = cut(pairs.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct())
    links = _linked(tried, held)
    groups = components(links)
    for _ in range(2):
        more = cut(_apart(buckets, nodes, groups).join(tried, ["a", "b"], "left_anti"))
        if more.isEmpty():
            continue
        tried = tried.unionAll(more)
        links = links.unionAll(_linked(more, held))
        groups = components(links)
    more = cut(_rest(buckets, nodes, held, groups, tried))
    if not more.isEmpty():
        groups = components(links.unionAll(more))
    named = sketches.select("doc_id", "key").join(groups, "key", "left").withColumn("root", F.coalesce("root", "key"))
    names = named.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return named.join(names, "root").select(
        "doc_id", F.col("key").alias("text_key"), F.col("root").alias("class_key"), "class_id", "class_size"
    )


def drop_near_duplicates(documents: DataFrame) -> DataFrame:
    """One document of each class, all columns: the one whose doc_id names it.

    A class without any id keeps one of its rows.  Of repeated rows, or rows
    that share that id, one stays.
    """
    found = near_duplicate_classes(documents)
    rows = found.groupBy("class_key", "doc_id", "text_key").agg(F.count("*").alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "n")
    kept = cut(rows.groupBy("class_key").agg(F.min(order).alias("k")).select("k.doc_id", "k.text_key", "k.n"))
    keyed = documents.withColumn("__key", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    kept_rows = kept.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__kept"), F.col("n").alias("__n"))
    once = keyed.join(kept_rows, (F.col("__key") == F.col("__kept")) & keyed.doc_id.eqNullSafe(F.col("__id")))
    once = once.select(*documents.columns, "__n")
    if kept.where("n > 1").isEmpty():
        return once.drop("__n")
    again = once.where("__n > 1").dropDuplicates(["doc_id", "text"])
    return once.where("__n = 1").unionByName(again).drop("__n")
