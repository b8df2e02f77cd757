"""Near-duplicate documents by min-max hashing of word shingles.

Under each permutation both the minimum and the maximum of a document's shingles are kept, so a signature of 2P values
costs P hash evaluations per shingle. Bands of the signature are the candidate keys; a candidate pair becomes a link
only if the Jaccard similarity of the full shingle sets reaches the threshold.

Plan, none of whose steps gathers a group in one task or emits all pairs of a group:

1. one pass over the texts writes (doc_id, set size, 128-bit digest of the set, bands);
2. documents of equal sets are one class, by a pre-aggregated minimum; only representatives go on;
3. each bucket's hub is its most central member, the one that shares most buckets with others (pre-aggregated sums and
   maxima). Members are compared with hubs only; a group of near copies has its original as the hub of nearly all its
   buckets, so its pairs are few times its size. A hub's pairs are confirmed in tiles of bounded size;
4. connected components of these links;
5. what stars can miss: two members of a bucket that lie in different components. Jaccard distance is a metric, so a
   member that is linked to the hub can have a link only with members whose similarity to the hub is at least twice the
   threshold minus one; the stars tell which those are. All other links are between two members that are not linked to
   the hub. Of the documents that are left so, two that lie in different components and reach the threshold share one of
   the first shingles of both, if each document's shingles are
   ordered by how many of these documents have them and those that no other component has come first; a document with
   n shingles, of which t must be common, shows the first n - t + 1. So each such shingle is a group, in which blocks
   meet in tasks of their own, the number and the size of the blocks both growing with the root of the group's, and a pair
   becomes a candidate only where what follows the shingle in both documents can still make up the common part.
   Candidates are made distinct, so each pair is compared once, in tiles of documents of one hub;
6. connected components of all links, carried back to the members of the classes.

Joins on a bucket, hub, shingle or digest, any of which may hold a third of all rows, broadcast what belongs to the few
hot keys and shuffle the rest (``join_with_hot_keys``).

With the production bands the chance that a pair at the threshold of 0.8 shares no bucket is below 1e-5.

Defined results: words are split at white space after A-Z are lower-cased; a text of fewer words than a shingle is one
shingle; an empty or null text has none, is linked with nothing and is kept. doc_id names a document: repeated rows of
it are one document and share its result. Where rows of one doc_id differ in text, each is grouped by its own text, and
of those that represent a class the one of the least digest is compared with others. A row without doc_id takes part in
no link: its component is null and it is kept. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordinata.llm.shingles import mix, shingle_set, word_hashes
from ordinata.llm.workspace import discard, join_salted, join_with_hot_keys, materialize, release

BANDS, ROWS = 30, 5
#: So many candidate ids, about 30 MB as a hash table, may be sent to every executor.
BROADCAST_IDS = 1_000_000
#: About so many pairs of a hub are confirmed in one tile, and so many documents of a hub are one side of a later tile.
STAR_TILE, CELL = 64, 128
#: So many pairs of two blocks are compared at once.
STRIPE_PAIRS = 1 << 18
#: Rows of an Arrow batch where they hold whole texts or sets of documents that have candidates.
SET_ROWS = 128
_BLOCK = 4096


def permutations(count: int, seed: int = 2024) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of ``count`` permutations of the 32-bit values."""
    keys = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    low = (keys >> np.uint64(32)).astype(np.uint32)
    return (low[:count] | np.uint32(1))[:, None], low[count:][:, None]


def signature(shingles: np.ndarray, multipliers: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Minimum and maximum of a set of shingles under each permutation, interleaved."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = high = None
    for at in range(0, len(x), _BLOCK):
        y = x[at : at + _BLOCK] * multipliers
        y += offsets
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        a, b = y.min(axis=1), y.max(axis=1)
        low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
    return np.stack([low, high], axis=1).ravel()


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of a signature."""
    parts = values[: bands * rows].reshape(bands, rows).astype(np.uint64)
    out = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(rows):
        out = mix(out ^ parts[:, k])
    return out


def signatures(docs: DataFrame, shingle: int, *, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, d1, d2, bands) of every document; d1 and d2 are the digest of the set, null where it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = permutations((bands * rows + 1) // 2)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, d1, d2, keys = [], [], [], []
                for _, words in word_hashes(part.column(1).to_pylist()):
                    found = shingle_set(words, shingle)
                    sizes.append(len(found))
                    if len(found):
                        a, b = _digest(found)
                        d1.append(a)
                        d2.append(b)
                        keys.append(band_keys(signature(found, *own), bands, rows).view(np.int64))
                    else:
                        d1.append(None)
                        d2.append(None)
                        keys.append([])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "d1", "d2", "bands"])
        release()

    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return columns.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>")


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    """The two halves of a set's 128-bit digest."""
    return tuple(np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), np.int64).tolist())


def shingle_sets(wanted: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, shingles): the full sorted set of every (doc_id, text, d1, d2) whose set has this digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                ids, found = [], []
                for (_, words), *row in zip(word_hashes(part.column(1).to_pylist()), *(part.column(c).to_pylist() for c in (0, 2, 3)), strict=True):
                    own = shingle_set(words, shingle)
                    if _digest(own) == (row[1], row[2]):
                        ids.append(row[0])
                        found.append(own.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "shingles"])
        release()

    return wanted.select("doc_id", "text", "d1", "d2").mapInArrow(run, "doc_id long, shingles array<long>")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each run of equal values in the first ``keys`` columns, which cut the batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(keys)]
        changed = np.zeros(batch.num_rows, bool)
        for c in columns:
            changed[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        if last is not None and first != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(changed).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, least: int | None = None) -> DataFrame:
    """(a, b, linked): the ``pairs`` (tile, a, b) whose full sets reach the similarity, and with ``least`` < percent also
    those that reach only ``least``, which are not ``linked``.

    A set goes once to each tile that has a pair of it, so a task holds the sets of one tile.
    """
    needed = join_salted(pairs.select("tile", F.explode(F.array("a", "b")).alias("doc_id")).distinct(), sets, "doc_id", "tile")
    none, low = F.lit(None), percent if least is None else least
    rows = needed.select("tile", F.lit(0).alias("kind"), "doc_id", none.cast("long").alias("b"), "shingles").unionAll(pairs.select("tile", F.lit(1), "a", "b", none.cast("array<long>")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 1):
            held, a, b, linked = {}, [], [], []
            kinds, ids, others = (group.column(c).to_pylist() for c in (1, 2, 3))
            for kind, x, y, own in zip(kinds, ids, others, group.column(4), strict=True):
                if not kind:
                    held[x] = own.values.to_numpy().view(np.uint64)  # sorted as such
                    continue
                left, right = sorted((held[x], held[y]), key=len)
                at = np.searchsorted(right, left)
                common = np.count_nonzero(right[np.minimum(at, len(right) - 1)] == left)
                union = len(left) + len(right) - common
                if 100 * common >= low * union:
                    a.append(x)
                    b.append(y)
                    linked.append(100 * common >= percent * union)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(linked)], names=["a", "b", "linked"])
        release()

    return rows.repartition("tile").sortWithinPartitions("tile", "kind").mapInArrow(run, "a long, b long, linked boolean")


def components(edges: DataFrame, name: str = "links") -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b), the component being its least node.

    Alternates the large-star and small-star contractions; each round is written to the shared folder, so lineage stays
    short. The number of rounds grows with the logarithm of the number of nodes.
    """
    ordered = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now = materialize(ordered, name)
    mark, rows = None, now.count()
    while True:
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = materialize(join_with_hot_keys(both, least, "u", "n", 2 * rows).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), name)
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_with_hot_keys(large, low, "u", "n", 2 * rows).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        before, now = now, materialize(small, name)
        stat = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(before, large)
        if mark == tuple(stat):
            break
        mark, rows = tuple(stat), stat[0]
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))


def prefixes(live: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(s, doc_id, c, n, room, cell): the first shingles of every document that can reach one of another component.

    ``live`` has (doc_id, c, cell), c being the component. ``room`` counts the document's shingles that another component
    has, from s on.
    """
    held = materialize(sets.join(live.select("doc_id", "c"), "doc_id").select("doc_id", "c", F.explode("shingles").alias("s")), "minmax-held")
    spread = held.groupBy("s").agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("s", "k")
    shared = join_with_hot_keys(held.select("s", "doc_id"), spread, "s", "k", held.count(), most=1 << 16)  # 16 bytes a key
    by_doc = shared.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("k", "s"))).alias("order"))
    sized = sets.select("doc_id", F.size("shingles").alias("n")).join(live, "doc_id")
    needed = F.ceil(F.col("n") * percent / 100).cast("int")
    able = by_doc.join(sized, "doc_id").where(F.size("order") >= needed)
    first = able.select("*", F.posexplode(F.slice("order", F.lit(1), F.size("order") - needed + 1)).alias("at", "own"))
    out = materialize(first.select(F.col("own.s").alias("s"), "doc_id", "c", "n", (F.size("order") - F.col("at")).alias("room"), "cell"), "minmax-prefixes")
    discard(held)
    return out


def dealt(first: DataFrame, *, block: int = 128) -> DataFrame:
    """(s, i, j, own, doc_id, c, n, room, cell): the documents of each shingle that more than one component has, dealt into blocks, each two of which meet.

    A shingle of m documents has the root of m / ``block`` blocks, so its copies grow with the power 1.5 of m, and each block has about the
    root of m * ``block`` documents.
    """
    blocks = F.ceil(F.sqrt(F.col("m") / block)).cast("int")
    sizes = first.groupBy("s").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("s", "m", blocks.alias("blocks"))
    grouped = join_with_hot_keys(first, sizes, "s", "m", first.count()).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    met = grouped.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.select("s", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc_id", "c", "n", "room", "cell")


def candidates(first: DataFrame, percent: int, *, block: int = 128) -> DataFrame:
    """Distinct (tile, a, b) of different components that share one of their first shingles and have room for the threshold.

    Each meeting of two blocks is a task's group of its own, compared a stripe at a time.
    """
    rows = dealt(first, block=block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            own, ids, c, n, room, cell = (group.column(k).to_numpy() for k in range(3, 9))
            i, j = group.column(1)[0].as_py(), group.column(2)[0].as_py()
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            y = right[None, :]
            stripe = max(1, STRIPE_PAIRS // len(right)) if len(right) else 1
            for start in range(0, len(left) if len(right) else 0, stripe):
                x = left[start : start + stripe, None]
                total = n[x].astype(np.int64) + n[y]
                fits = (c[x] != c[y]) & ((100 + percent) * np.minimum(room[x], room[y]).astype(np.int64) >= percent * total)
                if i == j:
                    fits &= ids[x] < ids[y]
                at, to = np.nonzero(fits)
                at, to = x[at, 0], right[to]
                swap = ids[at] > ids[to]
                at, to = np.where(swap, to, at), np.where(swap, at, to)
                tile = mix(mix(cell[at].view(np.uint64)) + cell[to].view(np.uint64)).view(np.int64)
                for k in range(0, len(at), 20_000):
                    part = slice(k, k + 20_000)
                    yield pa.RecordBatch.from_arrays([pa.array(tile[part]), pa.array(ids[at[part]]), pa.array(ids[to[part]])], names=["tile", "a", "b"])
        release()

    return rows.repartition("s", "i", "j").sortWithinPartitions("s", "i", "j").mapInArrow(run, "tile long, a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``.

    Documents whose similarity reaches ``percent`` are linked; component_id is the least doc_id that links reach, and the
    document that bears it is kept.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sig = materialize(signatures(texts, shingle, bands=bands, rows=rows), "minmax")
    sized = sig.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialize(sized.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "minmax-classes")

    least = classes.select(F.col("rep").alias("doc_id"), "d1", "d2")
    own = F.min(F.struct("d1", "d2", F.col("n_shingles").cast("int").alias("n"), "bands")).alias("own")
    reps = materialize(sized.join(least, ["doc_id", "d1", "d2"], "left_semi").groupBy("doc_id").agg(own).select("doc_id", "own.*"), "minmax-reps")
    banded = reps.select("doc_id", "n", F.explode("bands").alias("band"))
    buckets = materialize(banded.groupBy("band").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "minmax-buckets")
    total = buckets.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    shared = materialize(join_with_hot_keys(banded, buckets, "band", "m", total), "minmax-shared")
    weights = shared.groupBy("doc_id").agg(F.sum(F.col("m") - 1).alias("w"))
    weighed = materialize(shared.join(weights, "doc_id"), "minmax-weighed")
    hubs = weighed.groupBy("band").agg(F.min(F.struct((-F.col("w")).alias("w"), F.col("doc_id").alias("id"), "n")).alias("hub"), F.count(F.lit(1)).alias("size"))
    hubs = hubs.select("band", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n"), "size")
    members = materialize(join_with_hot_keys(weighed.drop("w", "m"), hubs, "band", "size", total).drop("size"), "minmax-members")

    least = max(2 * percent - 100, 0)  # what a partner of a hub's partner has in common with the hub
    low, high = F.least("n", "hub_n").cast("long"), F.greatest("n", "hub_n").cast("long")
    stars = members.where((F.col("doc_id") != F.col("hub")) & (100 * low >= least * high)).select("hub", "doc_id").distinct()
    stars = materialize(stars, "minmax-stars")
    crowds = stars.groupBy("hub").agg(F.count(F.lit(1)).alias("size"))
    tiled = join_with_hot_keys(stars, crowds, "hub", "size", stars.count())
    tile = F.xxhash64("hub", F.pmod(F.xxhash64("doc_id"), F.floor(F.col("size") / STAR_TILE) + 1))
    wanted = materialize(members.select("doc_id").distinct().join(reps.select("doc_id", "d1", "d2"), "doc_id"), "minmax-wanted")
    if wanted.count() <= BROADCAST_IDS:  # beyond it the texts are shuffled instead
        wanted = F.broadcast(wanted)
    sets = materialize(shingle_sets(texts.join(wanted, "doc_id"), shingle).dropDuplicates(["doc_id"]), "minmax-sets", SET_ROWS)
    links = materialize(confirmed(tiled.select(tile.alias("tile"), F.col("hub").alias("a"), F.col("doc_id").alias("b")), sets, percent, least), "minmax-links", SET_ROWS)
    first = materialize(components(links.where("linked").select("a", "b"), "minmax-first"), "minmax-component")

    of = first.select(F.col("node").alias("doc_id"), "component")
    to_hub = links.select(F.col("a").alias("hub"), F.col("b").alias("doc_id"), "linked")
    linked = F.coalesce("linked", F.col("doc_id") == F.col("hub"))
    placed = members.join(of, "doc_id", "left").join(to_hub, ["hub", "doc_id"], "left")
    placed = materialize(placed.select("band", "hub", "doc_id", F.coalesce("component", "doc_id").alias("c"), linked.alias("linked"), F.col("linked").isNotNull().alias("close")), "minmax-placed")
    alone = F.when(~F.col("linked"), F.col("c"))
    close = F.when(F.col("close"), F.col("c"))
    hub_c = F.when(F.col("doc_id") == F.col("hub"), F.col("c"))
    state = placed.groupBy("band").agg(F.max(hub_c).alias("hc"), (F.min(alone) != F.max(alone)).alias("apart"), F.min(close).alias("low"), F.max(close).alias("high"), F.count(F.lit(1)).alias("size"))
    state = state.select("band", "hc", F.coalesce("apart", F.lit(False)).alias("apart"), F.coalesce((F.col("low") != F.col("hc")) | (F.col("high") != F.col("hc")), F.lit(False)).alias("reached"), "size").where("apart OR reached")
    left = join_with_hot_keys(placed, state, "band", "size", total).where(F.when(F.col("linked"), F.col("reached")).otherwise(F.col("apart") | (F.col("close") & (F.col("c") != F.col("hc")))))
    live = materialize(left.groupBy("doc_id").agg(F.min("c").alias("c"), F.min("hub").alias("near")), "minmax-live")
    crowds = live.groupBy("near").agg(F.count(F.lit(1)).alias("size"))
    cell = F.xxhash64("near", F.pmod(F.xxhash64("doc_id"), F.floor(F.col("size") / CELL) + 1))
    celled = join_with_hot_keys(live, crowds, "near", "size", live.count()).select("doc_id", "c", cell.alias("cell"))
    prefix = prefixes(celled, sets, percent)
    pairs = materialize(candidates(prefix, percent), "minmax-pairs")
    more = materialize(confirmed(pairs, sets, percent), "minmax-more", SET_ROWS)
    joined = first.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more.select("a", "b"))
    final = materialize(components(joined, "minmax-final").select(F.col("node").alias("rep"), "component"), "minmax-components")
    discard(reps, buckets, shared, weighed, members, stars, sets, links, first, placed, live, prefix, pairs, more)

    digest = F.xxhash64("d1", "d2").alias("digest")  # rows are matched by it and then by the whole digest
    placed = classes.join(final, "rep", "left").where("copies > 1 OR component IS NOT NULL").select(digest, "copies", F.struct("d1", "d2", F.coalesce("component", "rep").alias("component")).alias("own"))
    known = materialize(placed.groupBy("digest").agg(F.sum("copies").alias("copies"), F.collect_list("own").alias("found")), "minmax-known")
    copies = known.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    discard(classes, final)
    filled = sig.where("n_shingles > 0").select("doc_id", "n_shingles", "d1", "d2", digest)
    same = F.filter("found", lambda x: (x["d1"] == F.col("d1")) & (x["d2"] == F.col("d2")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.get(same, F.lit(0))["component"], F.col("doc_id")))
    out = join_with_hot_keys(filled, known, "digest", "copies", copies, "left").select("doc_id", "n_shingles", component.alias("component_id"))
    out = out.unionAll(sig.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
