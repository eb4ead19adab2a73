"""Near-duplicate classes by ProbMinHash, banding and verification.

A document is the weighted set of its word shingles, a shingle's weight being
how often it occurs. Each shingle makes a Poisson process whose rate is its
weight; a register keeps the earliest arrival that falls on it, and arrivals
later than the latest register end early. Registers of two documents agree with
the probability Jaccard similarity of their weighted sets. Bands of registers
give candidate pairs, which are verified on the shingles themselves.

Within a band's bucket each document is first held against a few leaders of
the bucket, so that work grows with the rows of a bucket. Verified links are
closed into classes. Only buckets that still hold several classes can hide a
further link; there members of different classes are compared within groups of
bounded size, by registers and then on their texts, and a group gives only the links
that connect what it had not connected before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import BATCH_BYTES, Words, batch_of, batch_table, bounded_batches, discard, fresh, gram_hashes, id_type, map_batches, mix64, release, schema, slices, stored, string_bytes

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
#: How far below the threshold the agreement of two documents' registers may be for them to be verified.
COARSE_SLACK = 0.22
#: Members, and bytes of their texts, that one task compares with each other; larger buckets are split first.
GROUP, GROUP_BYTES = 1024, 32 << 20
#: Registers of the finer signatures of documents in buckets of several classes, and how far below the threshold
#: their agreement may be: four standard deviations of the estimate.
FINE, FINE_SLACK = 1024, 0.05
#: Elements of shingle sets that a verifying task remembers.
REMEMBERED = 2_000_000


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of size words; fewer words, but not none, are one run."""
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    return gram_hashes(words, min(size, len(words)))


def _uniform(bits: np.ndarray) -> np.ndarray:
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """For each (elements, weights): the element that reached each register first. An empty set gives zeros.

    Arrivals of all sets are made round by round. After a round only elements
    whose last arrival is before their set's latest register go on, which leaves
    out nothing that could still come first.
    """
    n = len(sets)
    sizes = np.array([len(e) for e, _ in sets], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    element = np.concatenate([e for e, _ in sets]) if n else np.zeros(0, np.uint64)
    rate = np.concatenate([w for _, w in sets]).astype(np.float64) if n else np.zeros(0)
    first = np.full(n * registers, np.inf)
    winner = np.zeros(n * registers, np.uint64)
    state, time = element.copy(), np.zeros(len(element))
    while len(owner):
        state = mix64(state + np.uint64(0x9E3779B97F4A7C15))
        time = time - np.log(_uniform(state)) / rate
        slot = owner * registers + (mix64(state ^ np.uint64(0xD1B54A32D192ED03)) >> np.uint64(33)).astype(np.int64) % registers
        alive = time < first[slot]
        if alive.any():
            s, t, e = slot[alive], time[alive], element[alive]
            np.minimum.at(first, s, t)
            won = t == first[s]
            winner[s[won]] = e[won]
        latest = first.reshape(n, registers).max(axis=1)
        on = time < latest[owner]
        owner, element, rate, state, time = owner[on], element[on], rate[on], state[on], time[on]
    return winner.reshape(n, registers)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard similarity of two weighted sets with ascending elements; two empty sets have 1.

    Each shared element adds 1 / sum over all elements of max(a_i / a, b_i / b), with a and b its own weights.
    """
    (ea, wa), (eb, wb) = a, b
    if not len(ea) or not len(eb):
        return float(len(ea) == len(eb))
    both, ia, ib = np.intersect1d(ea, eb, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = wa[ia].astype(np.float64), wb[ib].astype(np.float64)
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    ratio = x / y
    order = np.argsort(ratio)
    x, y, ratio = x[order], y[order], ratio[order]
    # For element j: sum_i max(x_i / x_j, y_i / y_j) = (sum of x_i with a larger ratio) / x_j + (sum of y_i with at most its ratio) / y_j.
    upto = np.searchsorted(ratio, ratio, side="right")
    x_sum, y_sum = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(y)])
    total = (x_sum[-1] - x_sum[upto] + only_a) / x + (y_sum[upto] + only_b) / y
    return float((1.0 / total).sum())


def weighted(texts: pa.Array, size: int = SHINGLE) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct shingles, ascending, and how often each occurs."""
    out = []
    for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), 0, 1 << 20):
        words = Words(part.column(0))
        out += [np.unique(shingles(words.of(i), size), return_counts=True) for i in range(part.num_rows)]
    return out


def _digest(column="text"):
    return F.unhex(F.md5(F.coalesce(F.col(column), F.lit("")).cast("binary")))


def sketch(docs: DataFrame, size: int = SHINGLE, registers: int = REGISTERS, rows: int = ROWS) -> DataFrame:
    """doc_id, digest and bytes of the text, and bands, a hash for each run of registers; none for texts without words."""
    out = schema(("doc_id", id_type(docs)), ("digest", "binary"), ("bytes", "long"), ("bands", "array<long>"), ("registers", "binary"))

    def hashed(batches):
        for batch in batches:
            for part in slices(batch, 1, 1 << 20, 500):
                sets = weighted(part.column(1), size)
                signs = signatures(sets, registers)
                full = [len(e) > 0 for e, _ in sets]
                keys = signs.reshape(len(sets), registers // rows, rows)
                bands = np.zeros(keys.shape[:2], np.uint64)
                for i in range(rows):
                    bands = mix64((bands ^ keys[:, :, i]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i + 1))
                bands = mix64(bands + np.arange(registers // rows, dtype=np.uint64)).view(np.int64)
                low = (signs & np.uint64(0xFFFF)).astype("<u2")
                yield batch_of(out, [
                    part.column(0), part.column(2), np.diff(string_bytes(part.column(1))[1]),
                    [b if f else [] for b, f in zip(bands, full)], [s.tobytes() if f else b"" for s, f in zip(low, full)],
                ])

    return map_batches(docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), _digest().alias("digest")), hashed, out)


def candidates(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of digests: each member of a bucket with the bucket's leaders.

    Leaders are the first and last members by digest and by a hash of it, so that buckets
    of different bands share them; a bucket of up to four texts is mostly compared whole.
    """
    bands = nodes.select("digest", F.explode("bands").alias("band"))
    rank = F.struct(F.xxhash64("digest").alias("h"), F.col("digest").alias("d"))
    leaders = bands.groupBy("band").agg(
        F.min("digest").alias("l1"), F.max("digest").alias("l2"), F.min(rank)["d"].alias("l3"), F.max(rank)["d"].alias("l4"),
    ).where(F.col("l1") != F.col("l2"))
    met = bands.join(leaders, "band").select("digest", F.explode(F.array_distinct(F.array("l1", "l2", "l3", "l4"))).alias("leader"))
    return met.where(F.col("digest") != F.col("leader")).select(
        F.least("digest", "leader").alias("a"), F.greatest("digest", "leader").alias("b")
    ).distinct()


def _likely(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Pairs whose registers agree in a share of at least `least`, well below the threshold."""
    signs = nodes.select("digest", "registers")
    both = pairs.join(signs.select(F.col("digest").alias("a"), F.col("registers").alias("ra")), "a").join(
        signs.select(F.col("digest").alias("b"), F.col("registers").alias("rb")), "b")
    out = schema(("a", "binary"), ("b", "binary"))

    def agree(batches):
        for batch in batches:
            keep = [(np.frombuffer(x, "<u2") == np.frombuffer(y, "<u2")).mean() >= least for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return map_batches(both.select("a", "b", "ra", "rb"), agree, out)


def texts_of(digests: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """digest and text of the digests named, from the rows that stand for them."""
    rows = nodes.join(digests.distinct(), "digest", "left_semi").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"))
    source = docs.select("doc_id", "text", _digest().alias("digest"))
    found = source.join(rows, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")))
    return found.groupBy("digest").agg(F.first("text").alias("text"))


def finer(texts: DataFrame, size: int, registers: int = FINE) -> DataFrame:
    """digest and fine, the low bytes of a longer signature."""
    out = schema(("digest", "binary"), ("fine", "binary"))

    def hashed(batches):
        for batch in batches:
            for part in slices(batch, 1, 1 << 20, 200):
                signs = signatures(weighted(part.column(1), size), registers)
                yield batch_of(out, [part.column(0), [s.tobytes() for s in (signs & np.uint64(0xFF)).astype(np.uint8)]])

    return map_batches(texts.select("digest", "text"), hashed, out)


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, size: int, threshold: float) -> DataFrame:
    """The pairs whose texts are similar to at least the threshold.

    Texts are fetched for the rows that stand for the pairs' digests only.
    """
    texts = stored(texts_of(pairs.select(F.explode(F.array("a", "b")).alias("digest")), docs, nodes))
    both = pairs.join(texts.select(F.col("digest").alias("a"), F.col("text").alias("ta")), "a").join(
        texts.select(F.col("digest").alias("b"), F.col("text").alias("tb")), "b")
    out = schema(("a", "binary"), ("b", "binary"))

    def check(batches):
        sets: dict[bytes, tuple] = {}
        for batch in batches:
            if sum(len(e) for e, _ in sets.values()) > REMEMBERED:
                sets.clear()
            for c in (0, 1):
                new = {d: i for i, d in enumerate(batch.column(c).to_pylist()) if d not in sets}
                if new:
                    sets.update(zip(new, weighted(batch.column(c + 2).take(pa.array(list(new.values()))), size)))
            keep = [similarity(sets[a], sets[b]) >= threshold for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    links = stored(map_batches(both.select("a", "b", "ta", "tb"), check, out))
    discard(texts)
    return links


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node and root for every node of edges (a, b): the smallest node it is connected with.

    Alternates the large-star and small-star steps until no edge changes. A star's
    centre is found by an aggregate and joined back, so that no task holds the
    neighbours of a large star.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    print_of = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    mark = print_of(now)
    for _ in range(max_rounds):
        # Large star: every larger neighbour of a node is linked to the node's smallest neighbour (or itself).
        arcs = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = arcs.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, now = now, stored(small)
        discard(before)
        last, mark = mark, print_of(now)
        if mark == last:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mixed(members: DataFrame) -> DataFrame:
    """band, n and bytes of the buckets whose members are of more than one class; two members have met as leaders."""
    found = members.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    return found.where((F.col("r0") != F.col("r1")) & (F.col("n") > 2)).select("band", "n", F.col("bytes").alias("in_all"))


def unmet(docs: DataFrame, nodes: DataFrame, roots: DataFrame, size: int, threshold: float, group: int = GROUP, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Links (a, b) between digests that share a bucket but no class and are similar to at least the threshold.

    Buckets of up to `group` members and group_bytes of text are compared in one group each. Larger ones are cut
    into blocks, and each pair of blocks is a group, which makes a row of a member for each block.
    A pair is made inside a group only, that of the first band it shares: signatures that do not rule it out send it
    to verification there, unless links found in the group connect it already. So a group gives fewer links than it has members.
    """
    named = nodes.join(roots.withColumnRenamed("node", "digest"), "digest", "left").select("digest", "bands", "bytes", F.coalesce("root", "digest").alias("root"))
    members = stored(named.where(F.size("bands") > 0).select("digest", "root", "bytes", F.posexplode("bands").alias("nth", "band")))
    whole = members.join(_mixed(members), "band")
    blocks = F.greatest(F.ceil(F.col("n") * 2 / group), F.ceil(F.col("in_all") * 2 / group_bytes))
    cut = whole.withColumn("k", F.when((F.col("n") <= group) & (F.col("in_all") <= group_bytes), 1).otherwise(blocks).cast("int"))
    cut = cut.withColumn("at", F.pmod(F.xxhash64("digest", F.lit(7)), F.col("k")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = stored(cut.select("digest", "root", "nth", "at", (F.col("at") == F.col("with")).alias("own"), F.xxhash64("band", F.least("at", "with"), F.greatest("at", "with")).alias("key")))
    texts = stored(texts_of(dealt.select("digest"), docs, nodes))
    fine = stored(finer(texts, size))
    full = dealt.join(nodes.select("digest", "registers", "bands").join(fine, "digest").join(texts, "digest"), "digest")
    least, fine_least = max(0.0, threshold - COARSE_SLACK), max(0.0, threshold - FINE_SLACK)
    out = schema(("a", "binary"), ("b", "binary"))

    def compare(table):
        digests = table.column("digest").to_pylist()
        _, root = np.unique(np.array([x.hex() for x in table.column("root").to_pylist()]), return_inverse=True)
        signs = np.stack([np.frombuffer(x, "<u2") for x in table.column("registers").to_pylist()])
        long = np.stack([np.frombuffer(x, np.uint8) for x in table.column("fine").to_pylist()])
        bands = np.stack([np.array(x, np.int64) for x in table.column("bands").to_pylist()])
        nth, block, own = table.column("nth")[0].as_py(), table.column("at").to_numpy(), table.column("own")[0].as_py()
        words = table.column("text")
        sets: dict[int, tuple] = {}
        of = lambda i: sets[i] if i in sets else sets.setdefault(i, weighted(pa.array([words[i].as_py()], pa.string()), size)[0])
        a, b = [], []
        for i in range(len(digests) - 1):
            others = i + 1 + np.flatnonzero((root[i + 1 :] != root[i]) & (own | (block[i + 1 :] != block[i])))
            others = others[(bands[others] == bands[i]).argmax(axis=1) == nth]
            others = others[(signs[others] == signs[i]).mean(axis=1) >= least]
            for j in others[(long[others] == long[i]).mean(axis=1) >= fine_least].tolist():
                if root[i] != root[j] and similarity(of(i), of(j)) >= threshold:
                    a.append(digests[i])
                    b.append(digests[j])
                    root[root == root[j]] = root[i]  # one class from now on
        if table.nbytes > BATCH_BYTES:
            del sets
            release()
        return batch_table(out, [a, b])

    bounded_batches(docs.sparkSession)
    links = stored(full.select("key", "digest", "root", "nth", "at", "own", "bands", "registers", "fine", "text").groupBy("key").applyInArrow(compare, out).distinct())
    discard(members, dealt, texts, fine)
    return links


def near_duplicates(docs: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, group: int = GROUP) -> DataFrame:
    """One row per row of docs: doc_id, digest, class_id, class_size, exact_copies, root.

    class_id is the smallest doc_id of the class, null where it has none; root, a digest,
    tells classes apart also where ids are null or repeated. Equal texts share a class
    (null and empty texts are equal), texts without words are else alone, and
    texts of fewer than size words are one shingle. class_size and exact_copies
    count rows. Columns besides doc_id and text are ignored; an empty table
    gives no rows.
    """
    base = stored(sketch(docs, size, bands * rows, rows))
    nodes = stored(base.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("registers").alias("registers"), F.first("bytes").alias("bytes"), F.count(F.lit(1)).alias("copies")))
    pairs = stored(_likely(candidates(nodes), nodes, max(0.0, threshold - COARSE_SLACK)))
    found = verified(pairs, docs, nodes, size, threshold)
    roots = stored(components(found))
    discard(pairs, found)
    links = unmet(docs, nodes, roots, size, threshold, group)
    if links.limit(1).count():
        # Links between classes: the classes they connect get one root.
        of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        merged = components(between.distinct()).select(F.col("node").alias("root"), F.col("root").alias("top"))
        known = roots.join(merged, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        roots = known.unionByName(merged.select(F.col("root").alias("node"), F.col("top").alias("root")).join(roots.select("node"), "node", "left_anti"))
    named = nodes.select("digest", "doc_id", "copies").join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    classes = named.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size"))
    members = named.join(classes, "root").select("digest", "class_id", "class_size", F.col("copies").alias("exact_copies"), "root")
    return base.select("doc_id", "digest").join(members, "digest").select("doc_id", "digest", "class_id", "class_size", "exact_copies", "root")


def one_of_each(docs: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with all their columns, one row of each near-duplicate class: that of the smallest doc_id.

    Rows without a doc_id stay if their class has no doc_id at all, one per class. Null and empty texts are one class,
    of repeated rows one stays, and an empty table stays empty.
    """
    found = near_duplicates(docs, size, threshold)
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("root").agg(F.min("digest").alias("digest_kept"), F.first("doc_id").alias("id_kept")).drop("root")
    key = fresh(docs, "key")
    keyed = docs.withColumn(key, _digest())
    kept = keyed.join(keep, (keyed[key] == keep["digest_kept"]) & keyed["doc_id"].eqNullSafe(keep["id_kept"]), "left_semi")
    return kept.dropDuplicates(["doc_id", key]).drop(key)
