"""Near-duplicate documents by SuperMinHash: signatures, banding, verification on full sets, union-find grouping.

1. Each text becomes its set of distinct 5-word shingles (64-bit hashes). Texts of one set are a class; only the
   smallest doc_id of a class goes on, so copies never meet in pairs.
2. SuperMinHash gives the set a signature; its bands are bucket keys. Batches sign their sets together.
3. Each bucket has a hub, its member of lowest rank. Every member is compared with the lowest hub among its buckets, then, in
   rounds with other ranks, with the hub of each of its buckets that is in another component. Verified links are joined
   by union-find after each round. In the end only members of different components are left to compare. Members that hang
   together by buckets are a cluster, and each is reduced to how it differs from what most of its cluster holds. A pair is
   verified if it meets in the prefixes of these differences (_prefix_pairs), which every linked pair does, so that no link
   between members of a bucket is lost. Near copies of one text share nearly all of it but little of their differences.

Defined results: a null or empty text has an empty set and is alone; fewer than five words are one shingle; repeated rows
(same doc_id) each give a row; rows without doc_id are alone, with a null component. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.common import by_batch, forget, handed_on, scratch, written
from scriptorium.llm.words import MULT as _MULT
from scriptorium.llm.words import mix as _mix
from scriptorium.llm.words import word_hashes

SHINGLE = 5
#: A pair at the threshold shares no band with at most this probability; a signature has at most so many slots.
MISS, SLOTS = 1e-5, 160


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text, A to Z in lower case."""
    hashed = word_hashes(text or "", lower=True)[0]
    if not len(hashed):
        return hashed
    n, width = max(1, len(hashed) - width + 1), min(width, len(hashed))
    total = np.full(n, width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            total = _mix(total * _MULT + hashed[k : k + n])
    return np.unique(total)


def shape(percent: int) -> tuple[int, int]:
    """Rows and bands: as many rows, which keep pairs of low similarity apart, as SLOTS allows. 85: 6 rows, 25 bands."""
    for rows in range(12, 0, -1):
        n = math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** rows)) if percent < 100 else 1
        if rows * n <= SLOTS:
            return rows, n
    raise ValueError(f"no signature of {SLOTS} slots finds pairs of {percent} %")


def super_minhash(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """A signature for each set: slot i has the least (level + fraction) that any element puts there.

    An element visits the slots in the order of its own permutation, one a level, so that each slot gets one rank of each
    element. A slot filled at one level stays as it is at later ones, so a set is done once all its slots are filled.
    Sets are worked on together, up to so many elements at a time that their permutations stay small."""
    best = np.full((len(sets), slots), np.inf)
    group: list[int] = []
    held = 0
    for i, s in enumerate(sets):
        if group and held + len(s) > 8192:
            _signed(sets, group, best, slots)
            group, held = [], 0
        if len(s) > 8192:
            for at in range(0, len(s), 8192):
                part = np.full((1, slots), np.inf)
                _signed([s[at : at + 8192]], [0], part, slots)
                best[i] = np.minimum(best[i], part[0])
        elif len(s):
            group.append(i)
            held += len(s)
    if group:
        _signed(sets, group, best, slots)
    return best


def _signed(sets: list[np.ndarray], group: list[int], best: np.ndarray, slots: int) -> None:
    flat = best.reshape(-1)
    elements = np.concatenate([sets[i] for i in group])
    base = np.repeat(np.array(group) * slots, [len(sets[i]) for i in group])
    order, orders = None, None
    for level in range(slots):
        with np.errstate(over="ignore"):
            u = _mix(elements + np.uint64(level + 1) * _MULT)
            fraction = (u >> np.uint64(11)).astype(np.float64) * 2.0**-53
            other = level + ((_mix(u) >> np.uint64(32)) * np.uint64(slots - level) >> np.uint64(32)).astype(np.intp)
        if level == 0:
            slot = first = other
        else:
            if order is None:  # only elements of sets that need a second level
                order = np.tile(np.arange(slots, dtype=np.uint16), (len(elements), 1))
                orders = np.arange(len(elements))
                order[orders, first] = 0
            slot = order[orders, other]
            order[orders, other] = order[orders, level]
        np.minimum.at(flat, base + slot, fraction + level)
        done = np.isfinite(best[group]).all(axis=1)
        if done.all():
            return
        if done.any():
            keep = np.repeat(~done, [len(sets[i]) for i in group])
            group = [i for i, d in zip(group, done, strict=True) if not d]
            elements, base = elements[keep], base[keep]
            if order is None:
                first = first[keep]
            else:
                orders = orders[keep]


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    bits = signature.view(np.uint64).reshape(*signature.shape[:-1], -1, rows)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, bits.shape[-2] + 1, dtype=np.uint64) * _MULT, bits.shape[:-1])
        for i in range(rows):
            key = _mix(key * _MULT + bits[..., i])
    return key.view(np.int64)


def _featured(columns: dict, rows: int, n_bands: int) -> dict:
    import xxhash

    sets = [shingles(text) for text in columns["text"]]
    keys = bands(super_minhash(sets, rows * n_bands), rows)
    return columns | {
        "n_shingles": [len(x) for x in sets],
        "digest": [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets],
        "bands": [k.tobytes() if len(x) else None for x, k in zip(sets, keys, strict=True)],
    }


_FEATURES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("bands", T.BinaryType())])


def features(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if empty) and the packed band keys. No shuffle."""
    return by_batch(docs.select("doc_id", "text"), _FEATURES, _featured, *shape(percent))


def _unpacked(columns: dict) -> dict:
    keys = [np.frombuffer(b, np.int64) for b in columns["bands"]]
    repeat = [len(k) for k in keys]
    return {c: np.repeat(np.array(columns[c], np.int64), repeat) for c in ("node", "n")} | {"bucket": np.concatenate(keys) if keys else []}


def _verified(columns: dict, percent: int) -> dict:
    sets: dict[int, np.ndarray] = {}

    def of(node: int, text: str) -> np.ndarray:
        if node not in sets:
            if len(sets) > 256:
                sets.clear()
            sets[node] = shingles(text)
        return sets[node]

    a, b = [], []
    for x, y, s, t in zip(columns["a"], columns["b"], columns["text_a"], columns["text_b"], strict=True):
        p, q = of(x, s), of(y, t)
        both = len(np.intersect1d(p, q, assume_unique=True))
        if 100 * both >= percent * (len(p) + len(q) - both):
            a.append(x)
            b.append(y)
    return {"a": a, "b": b}


_PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _forest(batches):
    """Union-find over the links of one partition: every node with the smallest of its tree."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            p, q = root(x), root(y)
            if p != q:
                up[max(p, q)] = min(p, q)
    links = [(root(x), x) for x in list(up) if root(x) != x]
    for at in range(0, len(links), 100_000):
        part = links[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in part], pa.int64()) for i in (0, 1)], names=["a", "b"])


def components(links: DataFrame, per_task: int = 500_000) -> DataFrame:
    """node, component (the smallest node it reaches) for every node with a link (a, b).

    Union-find in tasks of at most about per_task links leaves a forest: of one task it is the answer, of more than one
    each node then takes the least label among its neighbours and, by pointer jumping, that label's label, until nothing
    changes. Only sums by key are shuffled whole; hot nodes meet joins only."""
    links = links.select("a", "b")
    tasks = 1 + links.count() // per_task
    edges = written(links.coalesce(tasks).mapInArrow(_forest, _PAIR), "edges")
    if tasks == 1:
        roots = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
        return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(roots)
    both = edges.union(edges.select("b", "a"))
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        old = labels.withColumnRenamed("component", "old")
        step = old.join(near, "node").select("node", "old", F.least("old", "near").alias("new"))
        over = labels.select(F.col("node").alias("new"), F.col("component").alias("over"))
        made = written(step.join(over, "new", "left").select("node", "old", F.least("new", F.coalesce("over", "new")).alias("component")), "labels")
        changed = not made.where("old <> component").isEmpty()
        forget(labels)
        labels = made.select("node", "component")
        if not changed:
            forget(edges)
            return labels


def near_duplicates(docs: DataFrame, percent: int = 85, hub_rounds: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: links are pairs with 100 * intersection >= percent * union."""
    with scratch():
        found = written(features(docs, percent), "features")
        if _repeated(found):
            return handed_on(_with_repeats(docs, percent, hub_rounds), "groups")
        classes = found.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n"))
        classes = written(classes, "classes")
        members = _bucketed(classes)
        texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("node"), "text")
        nodes = written(members.select("node").distinct(), "nodes")  # as a table of its own its size is known: small, it is broadcast
        texts = written(texts.join(nodes, "node", "left_semi"), "texts")
        labels = components(_links(members, texts, percent, hub_rounds))
        out = found.join(classes.select("digest", "node"), "digest", "left").join(labels, "node", "left")
        out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id")).alias("component_id"))
        return handed_on(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "groups")


def _repeated(rows: DataFrame) -> bool:
    return not rows.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()


def _bucketed(classes: DataFrame) -> DataFrame:
    """node, n, bucket of all buckets with more than one member. Written, so that a hot bucket meets joins that can be split."""
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("bucket", T.LongType())])
    every = by_batch(classes.select("node", "n", "bands"), schema, _unpacked)
    shared = written(every.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").select("bucket"), "shared")
    return written(every.join(shared, "bucket").select("node", "n", "bucket"), "members")


def _links(members: DataFrame, texts: DataFrame, percent: int, hub_rounds: int) -> DataFrame:
    """Verified links (a, b), enough to join all that hang together."""
    near = lambda n, m: _near(n, m, percent)
    links = labels = None
    for turn in range(hub_rounds + 1):
        if labels is None:
            here = members.withColumn("component", F.col("node"))
        else:
            here = members.join(labels, "node", "left").select("node", "n", "bucket", F.coalesce("component", "node").alias("component"))
        hub = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("rank"), "node", "n", "component")).alias("hub")
        mixed = written(here.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), hub).where("low < high").select("bucket", "hub"), "hubs")
        if turn < hub_rounds:
            met = here.join(mixed, "bucket").where((F.col("hub.component") != F.col("component")) & near(F.col("hub.n"), F.col("n")))
            if turn == 0:  # one hub a member joins most of a group of copies
                met = met.groupBy("node").agg(F.min(F.struct("hub.rank", "hub.node")).alias("hub"))
            pairs = met.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"))
        else:
            met = here.join(mixed.select("bucket", F.col("hub.node").alias("hub")), "bucket")
            rest = written(met.select("node", "n", "component", "hub").distinct(), "rest")
            pairs = _prefix_pairs(rest, texts, percent)
        checked = written(_checked(written(pairs.distinct(), "pairs"), texts, percent), "links")
        links = checked if links is None else written(links.union(checked), "links")
        forget(labels)
        if turn < hub_rounds:
            labels = components(links)
    return links


def _near(n: Column, m: Column, percent: int) -> Column:
    """Else the sizes alone rule a link out."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _tokens(columns: dict) -> dict:
    """A row for each shingle in which a set differs from what most of its cluster holds (major, sorted; null: nothing)."""
    found = []
    for text, major in zip(columns["text"], columns["major"], strict=True):
        own = shingles(text).view(np.int64)
        found.append(own if major is None else np.setxor1d(own, np.array(major, np.int64)))
    repeat = [len(x) for x in found]
    return {c: np.repeat(np.array(columns[c], np.int64), repeat) for c in ("cluster", "node")} | {"d": np.repeat(np.array(repeat, np.int64), repeat), "token": np.concatenate(found) if found else []}


#: A cluster's common shingles are dealt out to its members by so many at a time.
DEALT = 2048


def _prefix_pairs(rest: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components among rest (node, n, component, hub: a member of a shared bucket), enough to join
    all pairs at the threshold among them.

    Two sets of n and m shingles are at the threshold if they differ in at most (100 - percent) / (100 + percent) * (n + m)
    shingles. How they differ can be told from how each differs from one and the same third set, whatever that is: here the
    shingles that more than half of their cluster hold. With d and e such differences of which s are common, they differ in
    d + e - 2 s. So slack = (100 - percent) * n - (100 + percent) * d says two things. Pairs whose slacks sum to 0 or more are
    linked for certain; one pair of each such member with the member of most slack joins them all. All other linked pairs share
    at least least = -(sum of slacks) / 2 / (100 + percent) differences. These are put in one order, rare ones first, so the
    first common one is among the first d - least + 1 of one and the first e - least + 1 of the other. Near copies that differ
    in shingles of their own start with these and so do not meet, however many they are. A difference of one set alone only
    takes up places. Differences held by the same sets (by a 64-bit hash of them) stand together, and only the first of them is
    met, as the first common one is such a one."""
    more, total = 100 - percent, 100 + percent
    by_hub = written(components(rest.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).where("a < b")), "clusters")
    by_hub = by_hub.select("node", F.col("component").alias("cluster"))
    sizes = by_hub.groupBy("cluster").agg(F.count("*").alias("size"))
    part = F.pmod(F.xxhash64("node"), F.floor(F.col("size") / DEALT) + 1).alias("part")
    members = rest.select("node", "n", "component").distinct().join(by_hub.join(sizes, "cluster").select("node", "cluster", part), "node")
    members = written(members.join(texts, "node"), "clustered")
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("cluster", "node", "d", "token")])
    each = by_batch(members.select("cluster", "node", "text", F.lit(None).cast("array<long>").alias("major")), schema, _tokens)
    held = each.groupBy("cluster", "token").agg(F.count("*").alias("held")).join(sizes.where("size > 2"), "cluster").where("2 * held > size")
    major = held.groupBy("cluster", "size").agg(F.collect_list("token").alias("major"))
    major = written(major.select("cluster", "major", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("size") / DEALT))).alias("part")), "major")
    each = written(by_batch(members.join(major, ["cluster", "part"], "left").select("cluster", "node", "text", "major"), schema, _tokens), "tokens")
    few = each.select("node", "d").distinct()
    slack = members.drop("text", "part").join(few, "node", "left").withColumn("slack", more * F.col("n") - total * F.coalesce("d", F.lit(0)))
    top = slack.groupBy("cluster").agg(F.max(F.struct("slack", F.col("node").alias("center"))).alias("top")).select("cluster", F.col("top.slack").alias("most"), "top.center")
    slack = written(slack.join(top, "cluster").withColumn("central", F.col("slack") + F.col("most") >= 0), "slacks")
    star = slack.where("central AND node <> center").select(F.least("node", "center").alias("a"), F.greatest("node", "center").alias("b"))
    counts = written(each.groupBy("cluster", "token").agg(F.count("*").alias("held"), F.min("node").alias("node"), F.bit_xor(F.xxhash64("node")).alias("holders")), "counts")
    alone = counts.where("held = 1").groupBy("node").agg(F.count("*").alias("alone"))
    least = lambda s: F.greatest(F.ceil(-s / (2 * total) - 1e-9), F.lit(1))
    still = slack.join(alone, "node", "left").select("node", "n", "component", "slack", "central", F.coalesce("alone", F.lit(0)).alias("alone"), (F.col("d") - least(F.col("slack") + F.col("most")) + 1).alias("places"))
    still = written(still.where("alone < places"), "still")
    common = each.join(still, "node").join(counts.where("held > 1").select("cluster", "token", "held", "holders"), ["cluster", "token"])
    order = Window.partitionBy("node").orderBy("held", "holders", "token")
    place, before = F.col("alone") + F.row_number().over(order), F.lag("holders").over(order)
    prefix = common.select("cluster", "node", "n", "component", "slack", "central", "d", "token", "places", place.alias("place"), F.coalesce(before != F.col("holders"), F.lit(True)).alias("first"))
    prefix = written(prefix.where("first AND place <= places").drop("first", "places"), "prefix")
    other = prefix.select("cluster", "token", *(F.col(c).alias(f"{c}_b") for c in ("node", "n", "component", "slack", "central", "d", "place")))
    share = least(F.col("slack") + F.col("slack_b"))
    meet = (F.col("place") <= F.col("d") - share + 1) & (F.col("place_b") <= F.col("d_b") - share + 1) & (F.col("slack") + F.col("slack_b") < 0)
    apart = (F.col("node") < F.col("node_b")) & (F.col("component") != F.col("component_b")) & ~(F.col("central") & F.col("central_b"))
    met = prefix.join(other, ["cluster", "token"]).where(apart & _near(F.col("n"), F.col("n_b"), percent) & meet)
    return met.select(F.col("node").alias("a"), F.col("node_b").alias("b")).union(star)


def _checked(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    a, b = (texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    return by_batch(pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b"), _PAIR, _verified, percent)


def _with_repeats(docs: DataFrame, percent: int, hub_rounds: int) -> DataFrame:
    """Where a doc_id stands on several rows: its distinct texts are grouped under ids of their own, and all rows of a
    doc_id, being one document, hang together."""
    own = F.xxhash64("doc_id", "text").alias("own")
    named = docs.where("doc_id IS NOT NULL").select("doc_id", "text", own)
    rows = written(named.distinct(), "rows")
    done = written(near_duplicates(rows.select(F.col("own").alias("doc_id"), "text"), percent, hub_rounds).select(F.col("doc_id").alias("own"), "n_shingles", F.col("component_id").alias("node")), "grouped")
    links = rows.select("own", "doc_id").join(done, "own").select(F.col("node").alias("a"), F.xxhash64(F.lit("doc"), "doc_id").alias("b"), "doc_id")
    links = written(links, "links")
    top = components(links)
    least = links.join(top, links.b == top.node).groupBy("component").agg(F.min("doc_id").alias("component_id"))
    groups = written(top.join(least, "component").select("node", "component_id"), "groups")
    out = named.select("doc_id", "own").join(done, "own").join(groups, "node").select("doc_id", "n_shingles", "component_id")
    alone = features(docs.where("doc_id IS NULL")).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return out.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def representatives(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs that stay: one document of each group. Of the rows of one doc_id one stays, the least by its text;
    rows without doc_id all stay."""
    groups = near_duplicates(docs, percent).select("doc_id", "kept")
    if _repeated(groups):
        others = [c for c in docs.columns if c not in ("doc_id", "text")]
        one = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("text", *others)).alias("row")).select("doc_id", "row.*")
        docs = one.unionByName(docs.where("doc_id IS NULL")).select(docs.columns)
    # as a table of its own its size is known: small, it is broadcast and no text is shuffled
    gone = written(groups.where("NOT kept").select("doc_id"), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
