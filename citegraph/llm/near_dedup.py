"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, union-find.

SuperMinHash gives every element a random permutation of the signature's slots and a
random number for each rank; slot i holds the least (rank + random number) that any element has
there. Ranks are worked off in order, so a document is done as soon as every slot is
filled below the next rank: after one or two ranks unless it is tiny.

Documents with equal shingle sets form one class first. Classes that share a band are
candidates. No pairs are made within a bucket: every member is first compared with one hub
of its buckets, the member that meets most others. Documents of buckets whose members are
still in different components are then compared across components, by an exact join on the rarest
shingles of each (prefix filter), as most of what is left in a large group of copies
is edited too much to have any link. All links are decided on full shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citegraph.llm.common import Stored, byte_table, per_batch
from citegraph.llm.components import components

#: Two sets of Jaccard similarity 0.8 share none of 40 bands of 6 values with probability
#: (1 - 0.8**6)**40 = 5e-6.
BANDS, ROWS = 40, 6
#: Elements whose permutations are held at once.
BLOCK = 1 << 16
LOWER = byte_table(lambda b: True)
GOLD, M1, M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles; a text of fewer words is one shingle.
    Words are split at ASCII white space, A-Z lower-cased."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(k, len(words))
    out = np.full(len(words) - width + 1, np.uint64(width))
    for j in range(width):
        out = mix(out * GOLD + h[j:len(h) - width + 1 + j])
    return np.unique(out)


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash: uint64 (sets, m) of rank << 32 | random number. Sets must not be empty."""
    h = np.full((len(sets), m), np.iinfo(np.uint64).max, np.uint64)
    flat = h.reshape(-1)
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")  # sets of like size finish after like numbers of ranks
    elems = np.concatenate([sets[i] for i in order]) if len(sets) else np.empty(0, np.uint64)
    owner = np.repeat(order, sizes[order])
    for s in range(0, len(elems), BLOCK):
        e, doc = elems[s:s + BLOCK], owner[s:s + BLOCK]
        perm = np.tile(np.arange(m, dtype=np.uint16), (len(e), 1))
        at = np.arange(len(e))
        for j in range(m):
            u = mix(e[at] + np.uint64((j + 1) * int(GOLD) & (1 << 64) - 1))
            k = j + (((u & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)
            slot = perm[at, k]
            perm[at, k] = perm[at, j]
            np.minimum.at(flat, doc[at] * m + slot, np.uint64(j << 32) | (u >> np.uint64(32)))
            here = np.unique(doc[at])
            open_ = here[h[here].max(1) >= np.uint64((j + 1) << 32)]  # a later rank can still lower a slot
            if not len(open_):
                break
            flag = np.zeros(len(sets), bool)
            flag[open_] = True
            at = at[flag[doc[at]]]
    return h


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """int64 (sets, bands): hash of each band's number and values."""
    part = sig.reshape(len(sig), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), part.shape[:2])
    for r in range(rows):
        key = mix(key * GOLD + part[:, :, r])
    return key.view(np.int64)


def _signer(k: int, bands: int, rows: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, k) for t in batch.column("text").to_pylist()]
        full = [i for i, s in enumerate(sets) if len(s)]
        keys = band_keys(signatures([sets[i] for i in full], bands * rows), bands, rows)
        offsets = np.zeros(len(sets) + 1, np.int32)
        offsets[np.array(full, np.int64) + 1] = bands
        return pa.RecordBatch.from_pydict({
            "id": batch.column("id"), "n": pa.array([len(s) for s in sets], pa.int64()),
            "fp": pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
            "bands": pa.ListArray.from_arrays(pa.array(np.cumsum(offsets, dtype=np.int32)), pa.array(keys.reshape(-1)))})

    return per_batch(run, 256)


def _shingler(k: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, k).view(np.int64) for t in batch.column("text").to_pylist()]
        offsets = np.cumsum([0, *map(len, sets)], dtype=np.int32)
        return pa.RecordBatch.from_pydict({
            "id": batch.column("id"), "fp": pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
            "items": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))})

    return per_batch(run, 256)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (fp_a, fp_b) of classes whose sets reach the similarity, as ids (a, b)."""
    left = sets.select(F.col("fp").alias("fp_a"), F.col("rep").alias("a"), F.col("items").alias("left"))
    right = sets.select(F.col("fp").alias("fp_b"), F.col("rep").alias("b"), F.col("items").alias("right"))
    both = F.size(F.array_intersect("left", "right"))
    return (pairs.join(left, "fp_a").join(right, "fp_b")
            .withColumn("both", both)
            .where(F.col("both") * 100 >= (F.size("left") + F.size("right") - F.col("both")) * percent)
            .select("a", "b").distinct())


def _prefixes(sets: DataFrame, mixed: DataFrame, percent: int) -> DataFrame:
    """The rarest shingles of every class of ``mixed``, with their position in the order of rarity.

    Two sets that reach the similarity have at least ``need = percent * (n_x + n_y) / (100 + percent)`` shingles in
    common, so the rarest one they share is among the first ``n - need + 1`` of both. A heavily edited copy
    has its own shingles there, which stand nowhere else (those are left out), and so meets nobody.
    """
    items = (sets.select("fp", "items").join(mixed, "fp")
             .select("fp", "n", "root", "apart", F.explode("items").alias("item")))
    counts = items.groupBy("item").agg(F.count("*").alias("c"))
    pos = F.row_number().over(Window.partitionBy("fp").orderBy("c", "item"))
    return (items.join(counts, "item").withColumn("pos", pos)
            .where(((F.col("n") - F.col("pos") + 1) * 100 >= F.col("n") * percent) & (F.col("c") > 1)).drop("c"))


def near_groups(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id",
                text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` for every row.

    Documents are linked when 100 * |intersection| >= percent * |union| of their sets of
    distinct ``shingle_words``-word shingles; with fewer words, the whole sequence is one shingle; null, empty and
    blank texts have no shingles and no links. ``component_id`` is the smallest id reachable over
    links. Rows that repeat an id are one document: their links are joined. A row with a null id
    is never linked: its ``component_id`` is null and it is kept. Other columns are not read.
    """
    store = Stored(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sig = store.put(source.mapInArrow(_signer(shingle_words, bands, rows),
                                      "id long, n long, fp binary, bands array<long>"), "signatures")
    # classes of equal sets; their fingerprint is their key, and their smallest id their node in the graph: an id with several
    # texts can be the smallest one of several classes
    classes = store.put(sig.where("fp is not null and id is not null").groupBy("fp")
                        .agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")
    named = store.put(sig.select("id", "n", "fp").join(classes.select("fp", "rep"), "fp", "left")
                      .select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep")), "rows")
    store.drop("signatures")
    twice = named.groupBy("id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    same_id = named.join(twice, "id").select(F.col("rep").alias("a"), F.col("lo").alias("b"))

    # buckets of several classes
    members = classes.select("fp", "rep", "n", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    bucket = store.put(members.join(shared, "key").select("key", "fp", "rep", "n", "size"), "buckets")
    meets = bucket.groupBy("fp").agg(F.sum("size").alias("meets"))
    hubs = (bucket.join(meets, "fp").groupBy("key")
            .agg(F.max_by("fp", F.col("meets")).alias("hub")))
    votes = (bucket.join(hubs, "key").where("fp <> hub").groupBy("fp", "hub").agg(F.count("*").alias("votes")))
    first = store.put(votes.groupBy("fp").agg(F.max_by("hub", F.col("votes")).alias("hub"))
                      .select(F.col("fp").alias("fp_a"), F.col("hub").alias("fp_b")), "first")
    # one set for each class, however many rows hold it
    taken = bucket.select("fp", "rep").distinct()
    sets = (source.join(taken.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
            .mapInArrow(_shingler(shingle_words), "id long, fp binary, items array<long>")
            .withColumnRenamed("id", "rep"))
    sets = store.put(sets.join(taken, ["fp", "rep"]).select("fp", "rep", "items").dropDuplicates(["fp"]), "sets")
    stars = components(store.put(_linked(first, sets, percent).unionByName(same_id), "links1"), store, "stars")
    stars = store.put(stars, "roots1")

    # buckets that still hold several components: compare their members across components
    bucket = (bucket.join(stars, bucket["rep"] == stars["node"], "left")
              .select("key", "fp", "n", F.coalesce("root", "rep").alias("root")))
    sizes = bucket.groupBy("key", "root").agg(F.count("*").alias("size"))
    main = sizes.groupBy("key").agg(F.max_by("root", F.col("size")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    mixed = store.put(bucket.join(main, "key").groupBy("fp", "n", "root")
                      .agg(F.max(F.col("root") != F.col("main")).alias("apart")), "mixed")
    prefix = store.put(_prefixes(sets, mixed, percent), "prefixes")
    x = prefix.where("apart").select("item", *(F.col(c).alias(f"{c}_x") for c in ("fp", "n", "root", "pos")))
    y = prefix.select("item", *(F.col(c).alias(f"{c}_y") for c in ("fp", "n", "root", "pos", "apart")))
    need = (F.col("n_x") + F.col("n_y")) * percent
    across = (x.join(y, "item")
              .where((F.col("root_x") != F.col("root_y")) & (~F.col("apart_y") | (F.col("fp_x") < F.col("fp_y")))
                     & (need <= (F.col("n_x") - F.col("pos_x") + 1) * (100 + percent))
                     & (need <= (F.col("n_y") - F.col("pos_y") + 1) * (100 + percent)))
              .select(F.col("fp_x").alias("fp_a"), F.col("fp_y").alias("fp_b")).distinct())
    late = store.put(_linked(store.put(across, "across"), sets, percent), "links2")
    for side in ("a", "b"):
        late = (late.join(stars, late[side] == stars["node"], "left")
                .withColumn(side, F.coalesce("root", side)).select("a", "b"))
    joined = components(late, store, "joined").select(F.col("node").alias("root"), F.col("root").alias("top"))
    final = store.put(stars.join(joined, "root", "left").select("node", F.coalesce("top", "root").alias("top"))
                      .unionByName(joined.select(F.col("root").alias("node"), "top")).distinct(), "final")
    store.drop("classes", "buckets", "sets", "first", "mixed", "prefixes", "across")
    return (named.join(final, named["rep"] == final["node"], "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.coalesce("top", "rep").alias("component_id"),
                    F.coalesce(F.col("id") == F.coalesce("top", "rep"), F.lit(True)).alias("kept")))


def keep_one(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``groups`` (from ``near_groups``) keeps, all columns; null ids stay."""
    gone = groups.where(~F.col("kept")).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(docs.columns)
