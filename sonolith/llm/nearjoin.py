"""Near-duplicate documents by a chosen-path set similarity join.

Every document follows random paths: each node of a tree chooses one or two minhash positions, and the document goes on
to the child named by its minwise token there. Similar sets share paths, others part soon. A branch ends where its node
is small: its members are compared exhaustively. The members of larger nodes are compared in random blocks first; what
then lies outside the node's largest component is compared with the whole node if it is small, else the branch goes on.
Independent trees repeat this to reach the recall wanted. Links are confirmed on the full sets.

Documents with equal sets are one class throughout, and members of one component are not compared again, so a group
of copies costs time in proportion to its size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .components import components

#: Minhash positions; each node draws its own, so that one mismatch doesn't end all of a pair's paths in a tree.
POSITIONS = 128
TREES = 7
#: Levels before node sizes are looked at first, with the chance of a second position at a node, and of each further step.
FIRST_LEVELS, FIRST_SECOND = 2, 0.4
MORE_LEVELS = 3
#: Paths that a link at the threshold keeps per further level on average; above 1, so that few are lost at any depth.
KEPT = 1.2
#: Levels in all; nodes that are still large there are compared in full, in blocks.
LEVELS = 17
#: Members of a node that are compared exhaustively at once.
SMALL = 2048
#: Estimates from POSITIONS positions so far below the threshold (over four standard deviations) are not confirmed.
SLACK = 0.14
#: Bytes of full sets that are compared at once; larger parts are compared in pieces, each with each.
SET_BYTES = 64 << 20

_RNG = np.random.Generator(np.random.PCG64(20240229))
_MUL = _RNG.integers(0, 1 << 31, POSITIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, POSITIONS, dtype=np.uint32)


_TO_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of the whole sequence, if it has fewer words."""
    words = text.translate(_TO_LOWER).split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), np.uint64)
    k = min(k, n)
    out = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        out = _mix(out + h[j : n - k + 1 + j])
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def _set_key(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def signature(s: np.ndarray) -> np.ndarray:
    """POSITIONS minwise values of a set that isn't empty."""
    high = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(POSITIONS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(s), 4096):
        least = np.minimum(least, (_MUL[:, None] * high[at : at + 4096] + _ADD[:, None]).min(axis=1))
    return least


def _schema(df: DataFrame, column: str) -> str:
    return dict(df.dtypes)[column]


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """Per row (doc_id, text): doc_id, n_shingles, and where the set isn't empty set_key, sig and its low bytes, small."""

    def run(batches):
        for part in C.pieces(batches):
            sizes, keys, sigs, low = [], [], [], []
            for x in part.column(1).cast(pa.binary()).to_pylist():
                s = shingle_set(x, k)
                sizes.append(len(s))
                keys.append(_set_key(s))
                sig = signature(s) if len(s) else None
                sigs.append(None if sig is None else sig.tobytes())
                low.append(None if sig is None else sig.astype(np.uint8).tobytes())
            made = [pa.array(sizes, pa.int64()), *(pa.array(x, pa.binary()) for x in (keys, sigs, low))]
            yield pa.RecordBatch.from_arrays([part.column(0), *made], ["doc_id", "n_shingles", "set_key", "sig", "small"])

    return docs.mapInArrow(run, f"doc_id {_schema(docs, 'doc_id')}, n_shingles long, set_key binary, sig binary, small binary")


def paths(rows: DataFrame, level: int, levels: int, second: float, trees: int | None = None) -> DataFrame:
    """(tree, path, rep, comp) so many levels on; rows have rep, comp and sig, and tree and path unless trees start here."""
    chance = np.uint64(int(second * (1 << 32)))

    def step(path, sig, at):
        two = np.flatnonzero((_mix(path + np.uint64(at)) >> np.uint64(32)) < chance)
        drawn = _mix(_mix(path + np.uint64((at + 1) << 32))) >> np.uint64(16)
        one = (drawn % np.uint64(POSITIONS)).astype(np.int64)
        other = (one + 1 + (drawn // np.uint64(POSITIONS) % np.uint64(POSITIONS - 1)).astype(np.int64)) % POSITIONS
        who = np.concatenate([np.arange(len(path)), two])
        where = np.concatenate([one, other[two]])
        token = sig[1][sig[0][who], where].astype(np.uint64)
        return who, _mix(_mix(path[who] + token) + where.astype(np.uint64) + np.uint64(at << 8))

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                n = part.num_rows
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint32).reshape(n, POSITIONS)
                if trees:
                    doc, tree = np.repeat(np.arange(n), trees), np.tile(np.arange(trees), n)
                    path = _mix(tree.astype(np.uint64) + np.uint64(1))
                else:
                    doc, tree = np.arange(n), part.column("tree").to_numpy()
                    path = part.column("path").to_numpy().view(np.uint64)
                for at in range(level, level + levels):
                    who, path = step(path, (doc, sig), at)
                    doc, tree = doc[who], tree[who]
                yield pa.RecordBatch.from_arrays([pa.array(tree.astype(np.int32)), pa.array(path.view(np.int64)), *(part.column(c).take(pa.array(doc)) for c in ("rep", "comp"))], ["tree", "path", "rep", "comp"])

    return rows.mapInArrow(run, f"tree int, path long, rep {_schema(rows, 'rep')}, comp {_schema(rows, 'comp')}")


def _runs(batches, key: str):
    """Consecutive rows of equal key as one table each."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        if held and held[0].column(key)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        for i in range(len(cuts) - 1):
            held.append(batch.slice(cuts[i], cuts[i + 1] - cuts[i]))
            if i < len(cuts) - 2:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _members(lists: DataFrame) -> DataFrame:
    """(gid, rep, comp) of distinct member lists."""
    lists = lists.distinct().withColumn("gid", F.md5(F.concat_ws(",", F.transform("members", lambda x: x.cast("string")))))
    pairs = lists.select("gid", F.explode(F.arrays_zip("members", "comps")).alias("m"))
    return pairs.select("gid", F.col("m.members").alias("rep"), F.col("m.comps").alias("comp"))


def _listed(rows: DataFrame, *key: str) -> DataFrame:
    """(members, comps): per key the distinct members in order."""
    lists = rows.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("rep", "comp"))).alias("m"))
    return lists.select(F.col("m.rep").alias("members"), F.col("m.comp").alias("comps"))


def _split(sizes: np.ndarray, most: int) -> list[np.ndarray]:
    """Members in pieces of at most half of ``most`` bytes of sets, then all pairs of pieces; one piece if all fit."""
    if 8 * sizes.sum() <= most:
        return [np.arange(len(sizes))]
    piece = np.cumsum(8 * sizes) // (most // 2)
    parts = [np.flatnonzero(piece == x) for x in np.unique(piece)]
    return [np.concatenate([parts[i], parts[j]]) for i in range(len(parts)) for j in range(i + 1, len(parts))] or parts


def _promising(groups: DataFrame, threshold: float) -> DataFrame:
    """(members, comps): members of a group with an estimated similarity near the threshold to one of another component,
    in parts that such pairs connect.

    groups has gid, rep, n, small (one byte of each minhash position), comp. Members of the largest component are
    compared with the others only.
    """
    # equal bytes by chance add one in 256 to the share of equal positions
    need = int(np.ceil(POSITIONS * ((threshold - SLACK) * 255 + 1) / 256))

    def run(batches):
        for group in _runs(batches, "gid"):
            m = group.num_rows
            reps, comp, n = (group.column(c).to_numpy() for c in ("rep", "comp", "n"))
            small = np.frombuffer(b"".join(group.column("small").to_pylist()), np.uint8).reshape(m, POSITIONS).T.copy()
            names, count = np.unique(comp, return_counts=True)
            label, touched = np.arange(m), np.zeros(m, bool)
            for i in np.flatnonzero(comp != names[count.argmax()]).tolist() if count.max() > 1 else range(m - 1):
                same = (small == small[:, i : i + 1]).sum(axis=0, dtype=np.uint8)
                near = (same >= need) & (comp != comp[i])
                near &= np.minimum(n[i], n) >= threshold * np.maximum(n[i], n) - 1e-9
                if near.any():
                    near[i] = touched[i] = True
                    touched |= near
                    for x in np.unique(label[near]).tolist():
                        label[label == x] = label[i]
            made = []
            for x in np.unique(label[touched]):
                part = np.flatnonzero(touched & (label == x))
                made += [part[piece] for piece in _split(n[part], SET_BYTES)]
            if made:
                lists = [pa.array([x[np.sort(p)].tolist() for p in made], pa.list_(pa.int64())) for x in (reps, comp)]
                yield pa.RecordBatch.from_arrays(lists, ["members", "comps"])

    placed = groups.repartition("gid").sortWithinPartitions("gid", "rep")
    return placed.mapInArrow(run, "members array<long>, comps array<long>")


def overlaps(sets: list[np.ndarray], wanted, most: int = 1 << 22):
    """(i, sizes of the intersections of set i with every set), for each i that ``wanted(i)`` holds for when its turn comes.

    Sets are compared through the list of sets that hold each element, at most so many entries at a time.
    """
    sizes = np.array([len(x) for x in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    new = np.concatenate([[True], flat[order][1:] != flat[order][:-1]])
    holders, starts = owner[order], np.flatnonzero(new)
    held = np.diff(np.append(starts, len(flat)))
    element = np.empty(len(flat), np.int64)
    element[order] = np.cumsum(new) - 1
    ends = np.cumsum(sizes)
    for i in range(len(sets)):
        if not wanted(i):
            continue
        own = element[ends[i] - sizes[i] : ends[i]]
        own = own[held[own] > 1]
        out = np.zeros(len(sets), np.int64)
        cuts = np.searchsorted(np.cumsum(held[own]), np.arange(most, held[own].sum() + 1, most))
        for part in np.split(own, cuts):
            n = held[part]
            at = np.arange(n.sum()) + np.repeat(starts[part] - (np.cumsum(n) - n), n)
            out += np.bincount(holders[at], minlength=len(sets))
        yield i, out


def _confirmed(groups: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that join the components of each group, confirmed on full sets.

    groups has gid, rep, comp, set. Pairs that links of the group connect already are not compared.
    """

    def run(batches):
        for group in _runs(batches, "gid"):
            reps, comp = group.column("rep").to_pylist(), group.column("comp").to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in group.column("set").to_pylist()]
            sizes = np.array([len(x) for x in sets])
            label = np.unique(comp, return_inverse=True)[1]
            a, b = [], []
            for i, common in overlaps(sets, lambda i, label=label: (label[i + 1 :] != label[i]).any()):
                linked = 100 * common >= percent * (sizes + sizes[i] - common)
                for j in np.flatnonzero(linked & (label != label[i])).tolist():
                    if label[j] != label[i]:
                        a.append(reps[i])
                        b.append(reps[j])
                        label[label == label[j]] = label[i]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    placed = groups.repartition("gid").sortWithinPartitions("gid", "rep")
    return placed.mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for part in C.pieces(batches):
            sets = [shingle_set(x, k).tobytes() for x in part.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["rep", "set"])

    return docs.mapInArrow(run, "rep long, set binary")


def _blocks(wide: DataFrame, small: int) -> DataFrame:
    """(members, comps): large nodes in random blocks, each with the node's first member."""
    own = F.pmod(F.xxhash64("rep", "path"), F.ceil(F.col("size") / F.lit(small)))
    rows = wide.groupBy("path", own.alias("block")).agg(F.collect_set(F.struct("rep", "comp")).alias("m"), F.min("hub").alias("hub"))
    lists = rows.select(F.array_sort(F.array_union("m", F.array("hub"))).alias("m"))
    return lists.select(F.col("m.rep").alias("members"), F.col("m.comp").alias("comps"))


def _rest_with_all(wide: DataFrame, small: int) -> DataFrame:
    """(members, comps): in every node, what lies outside its largest component meets all members, in blocks.

    wide has path, rep, comp, size, most (the largest component) and rest (members outside it). Where rest is at most
    ``small`` a node gives at most two rows a member.
    """
    blocks, slices = F.ceil(F.col("size") / F.lit(small)), F.ceil(F.col("rest") / F.lit(small))
    block, slice_ = F.pmod(F.xxhash64("rep", "path"), blocks), F.pmod(F.xxhash64("path", "rep"), slices)
    each = wide.select("path", "rep", "comp", block.alias("block"), F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))
    rest = wide.filter("comp <> most").select("path", "rep", "comp", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), slice_.alias("slice"))
    return _listed(each.unionByName(rest), "path", "block", "slice")


def linked(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = 5, percent: int = 80, trees: int = TREES, small: int = SMALL, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """(rows, links): per row doc_id, n_shingles, set_key; links (a, b) that join classes of equal sets.

    A class is named by its smallest doc_id. Two documents are linked if 100 * intersection >= percent * union of their
    sets of k-word shingles. The links suffice for the components: they hold a forest of each.
    """
    return _linked(docs, text, doc_id, k, percent, trees, small, levels)[:2]


def _linked(docs: DataFrame, text: str, doc_id: str, k: int, percent: int, trees: int = TREES, small: int = SMALL, levels: int = LEVELS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """linked(), and the components of the links; each turn adds its own to those found before."""
    if dict(docs.dtypes)[doc_id] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{doc_id} must be of an integer type")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = C.materialize(sketches(docs, k), "sketches")
    reps = rows.filter("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    # doc_id is part of the join key, so a large class is spread
    classes = rows.join(reps.select("set_key", F.col("rep").alias("doc_id")), ["set_key", "doc_id"], "left_semi")
    classes = classes.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "sig", "small").dropDuplicates(["rep", "n"])
    classes = C.materialize(classes, "classes")
    # what a comparison needs of a class; component labels travel with the paths
    brief = classes.select("rep", "n", "small")

    threshold = percent / 100
    second = min(1.0, max(0.0, KEPT / threshold - 1))
    at, level = paths(classes.withColumn("comp", F.col("rep")), 0, FIRST_LEVELS, FIRST_SECOND, trees), FIRST_LEVELS
    links = sets = lists = label = None
    while True:
        wide = at_ = placed = None
        if at is not None:
            at_ = C.materialize(at, "paths")
            member = F.struct("rep", "comp")
            nodes = at_.groupBy("path").agg(F.count("*").alias("size"), F.min(member).alias("hub"), F.min("comp").alias("x"), F.max("comp").alias("y"))
            placed = C.materialize(at_.join(nodes.filter("x < y").drop("x", "y"), "path"), "placed")
            few = _listed(placed.filter(F.col("size") <= small), "path")
            wide = placed.filter(F.col("size") > small)
            wide = None if wide.isEmpty() else wide
            lists = few if lists is None else lists.unionByName(few)
            lists = lists if wide is None else lists.unionByName(_blocks(wide, small))
        groups = C.materialize(_members(_promising(_members(lists).join(brief, "rep"), threshold)), "groups")
        if sets is None:
            needed = groups.select("rep") if wide is None else groups.select("rep").unionByName(wide.select("rep"))
            needed = needed.distinct().withColumnRenamed("rep", "doc_id")
            # by merge at every size: the ids that are needed grow with the corpus
            sets = C.materialize(_sets(docs.hint("merge").join(needed, "doc_id", "left_semi"), k).dropDuplicates(), "sets")
        found = C.materialize(_confirmed(groups.join(sets, "rep"), percent).distinct(), "found")
        links = found if links is None else links.unionByName(found)
        C.discard(at_, groups)
        if label is None or not found.isEmpty():
            label = C.materialize(components(found, known=label), "labels")
        if wide is None:
            C.discard(placed, classes, sets)
            return rows, links, label
        wide = wide.join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "comp")).drop("component")
        most = wide.groupBy("path", "comp").agg(F.count("*").alias("n")).groupBy("path").agg(F.max(F.struct("n", "comp")).alias("m"))
        most = most.select("path", F.col("m.comp").alias("most"), F.col("m.n").alias("held"))
        wide = wide.join(most, "path").withColumn("rest", F.col("size") - F.col("held")).filter("rest > 0")
        wide = C.materialize(wide.select("tree", "path", "rep", "comp", "size", "most", "rest"), "wide")
        C.discard(placed)
        ends = F.lit(level + MORE_LEVELS > levels) | (F.col("rest") <= small)
        lists = _rest_with_all(wide.filter(ends), small)
        more = wide.filter(~ends).select("tree", "path", "rep", "comp")
        at = None if more.isEmpty() else paths(more.join(classes.select("rep", "sig"), "rep"), level, MORE_LEVELS, second)
        level += MORE_LEVELS


def _labelled(docs: DataFrame, text: str, doc_id: str, k: int, percent: int, **options) -> DataFrame:
    """Per row: doc_id, n_shingles, set_key, component_id."""
    rows, _, label = _linked(docs, text, doc_id, k, percent, **options)
    classes = rows.filter("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = classes.join(label.withColumnRenamed("node", "rep"), "rep", "left")
    classes = C.materialize(classes.select("set_key", F.coalesce("component", "rep").alias("component_id"), "copies"), "components")
    return C.join_groups(rows.select("doc_id", "n_shingles", "set_key"), classes, "set_key", "copies", rows.count())


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = 5, percent: int = 80, **options) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept (doc_id = component_id).

    A text without words has an empty set, is linked with nothing and stays. Rows with one doc_id count as linked. Rows
    without a doc_id join the class of their set; a class of such rows only has no component_id and is linked with
    no other. Ids are integers; others are an error. An empty table gives an empty result.
    """
    out = _labelled(docs, text, doc_id, k, percent, **options)
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = 5, percent: int = 80, **options) -> DataFrame:
    """One row of each component, of its smallest doc_id, and every row without words; columns as in docs.

    Where that doc_id is repeated, one of its rows stays. Of rows without a doc_id one of each set stays.
    """
    rows = C.materialize(_labelled(docs, text, doc_id, k, percent, **options), "labelled")
    own = F.coalesce("component_id", "doc_id")
    kept = rows.filter(F.col("set_key").isNull() | F.col("doc_id").eqNullSafe(own))
    plain = rows.agg((F.count("*") == F.count_distinct("doc_id")).alias("x")).first()["x"]
    if plain:  # each row has an id of its own
        kept = kept.select(F.col("doc_id").alias("_kept")).hint("merge")
        return docs.join(kept, docs[doc_id].cast("long") == F.col("_kept"), "left_semi")
    key = C.in_frame("_set", docs)
    at = docs.columns.index(text)

    def run(batches):
        for part in C.pieces(batches):
            sets = (shingle_set(x, k) for x in part.column(at).cast(pa.binary()).to_pylist())
            keys = [_set_key(s) for s in sets]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys, pa.binary())], [*part.schema.names, key])

    full = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(key, T.BinaryType())]))
    # one class of each component, or of each set of rows without ids
    one = kept.filter("set_key IS NOT NULL").groupBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("set_key")).alias("g")).agg(F.min("set_key").alias("_k"))
    one = one.select(F.col("doc_id").alias("_kept"), "_k")
    words = full.join(one, (full[key] == one["_k"]) & full[doc_id].cast("long").eqNullSafe(one["_kept"]), "left_semi")
    return words.dropDuplicates([doc_id, key]).unionByName(full.filter(F.col(key).isNull())).drop(key)
