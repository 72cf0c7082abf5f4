"""Near-duplicate documents by DartMinHash signatures and banded joining.

A document is the multiset of its five-word shingles (lower-cased runs of word characters; shorter texts are
one shingle), weighted by count. Two documents are linked if their weighted Jaccard similarity is at least
0.8; a class is a connected component of links.

Signature: every element owns a plane of weight by rank, cut into weight regions [0, 1), [1, 2), [2, 4), ...
Hashes throw darts into each region as a Poisson process in rank order, the same for every document that has
the element. A dart counts for a document if its weight coordinate lies below the element's weight there; the
earliest dart of each of the K coordinates is the signature. Only the about K ln K + 2 K darts of lowest rank
are thrown; a document with an empty coordinate throws further.

Joining: K = 80 values in 20 bands of 4 find a pair of similarity 0.8 with probability 1 - 3e-5. Texts with
equal words meet first, so a bucket holds different texts only. In each bucket all members are compared with
one leader, the member whose buckets are the largest; the links give first components. Twice, members
outside their bucket's main component are compared with another leader from it. Those still outside are
compared with all members of other components, in blocks of bounded size, unless a bound shows that they
can't be similar enough: from the sizes, and from the numbers of elements in each of 256 bins of hashes, of
which two texts share at most the smaller (`most_shared`). All comparisons that decide are exact, on the
shingles. Pairs of one component are never looked at, an outsider needs one link to each component, and
nothing is capped. Between files only ids, bucket numbers and the shingles of texts that share a bucket move.

Defined cases: texts without words are alike only if they are equal; a null text is alike to none; rows with
one doc_id count as one document (their classes are joined), whichever of its texts has the link; rows with
a null id are documents of their own, and their class is null only if it has nothing else; a very long text
is one row of shingles and never cut; an empty table stays empty; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timelore.llm.common import materialise, meet, remove, shuffle_partitions

WORD = re.compile(r"\w+")
SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 4
K = BANDS * ROWS
BINS = 256
CHUNK_BYTES = 1 << 18
EXTRA_LEADERS = 2
#: Most rows of a block of outsiders and of members, and shingles of a block of members (beyond one row).
OUT_BLOCK, MEMBER_BLOCK, BLOCK_SHINGLES = 256, 2_048, 1 << 21

_U = np.uint64
_POSITIONS = np.random.default_rng(1).integers(0, 1 << 63, 4096, dtype=np.uint64) * _U(2) + _U(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shifts and odd multipliers)."""
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def word_lists(texts: list[str]) -> list[list[str]]:
    return [WORD.findall(x.lower()) for x in texts]


def shingle_weights(words: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, count, document) of the distinct shingles, sorted by document and hash."""
    counts = np.array([len(w) for w in words], np.int64)
    if not counts.sum():
        return np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64)
    data = np.frombuffer((" ".join(" ".join(w) for w in words if w) + " ").encode("utf-8", "surrogatepass"), np.uint8)
    blank = data == 32
    ends = np.flatnonzero(blank)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    part = (data.astype(np.uint64) + _U(1)) * _POSITIONS[place % len(_POSITIONS)] + (place // len(_POSITIONS)).astype(np.uint64)
    part[blank] = 0
    hashes = mix(np.add.reduceat(part, starts))
    owner = np.repeat(np.arange(len(words)), counts)
    joined = np.zeros(len(hashes), np.uint64)
    size = np.minimum(counts, SHINGLE)[owner]
    at = np.arange(len(hashes))
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])[owner]
    for j in range(SHINGLE):
        use = (at + j < len(hashes)) & (j < size)
        ahead = np.zeros(len(hashes), np.uint64)
        ahead[use] = hashes[at[use] + j]
        joined += (ahead + use.astype(np.uint64)) * _POSITIONS[j]
    whole = at - first + size <= counts[owner]  # the shingle ends within its document
    h, o = mix(joined[whole]), owner[whole]
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])])
    at = np.flatnonzero(new)
    return h[at], np.diff(np.concatenate([at, [len(h)]])).astype(float), o[at]


def _step(i: int, by: int) -> np.uint64:
    return _U(i * by & 0xFFFFFFFFFFFFFFFF)


def _unit(h: np.ndarray) -> np.ndarray:
    return ((h >> _U(11)).astype(float) + 0.5) / float(1 << 53)


def dart_signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n_docs: int, k: int = K) -> np.ndarray:
    """[n_docs, k] identities of the earliest darts; documents without elements get zeros."""
    total = np.bincount(owner, weights, n_docs)
    rank = np.full(n_docs * k, np.inf)
    name = np.zeros(n_docs * k, np.uint64)
    # weight regions of each element: [0, 1), then [2**(v-1), 2**v) while they start below the weight
    key, low, wide, of, weight = [elements], [np.zeros(len(elements))], [np.ones(len(elements))], [owner], [weights]
    v = 0
    left = weights > 1
    while left.any():
        key.append(elements[left] + _step(v + 1, 0xD6E8FEB86659FD93))
        low.append(np.full(left.sum(), float(1 << v)))
        wide.append(np.full(left.sum(), float(1 << v)))
        of.append(owner[left])
        weight.append(weights[left])
        v += 1
        left = weights > (1 << v)
    key, low, wide, of, weight = map(np.concatenate, (key, low, wide, of, weight))
    bound = np.where(total > 0, k * (np.log(k) + 2) / np.maximum(total, 1e-300), 0.0)
    todo = total > 0
    while todo.any():
        now = np.flatnonzero(todo[of])
        at = np.zeros(len(now))
        m = 0
        while len(now):
            h = mix(mix(key[now]) + _step(m, 0x9E3779B97F4A7C15))
            at = at - np.log(_unit(h)) / wide[now]
            near = at <= bound[of[now]]
            now, at, h = now[near], at[near], h[near]
            again = mix(h + _U(0xA24BAED4963EE407))
            hit = low[now] + _unit(again) * wide[now] < weight[now]
            slot = of[now][hit] * k + (mix(again + _U(1))[hit] % _U(k)).astype(np.int64)
            r, h = at[hit], h[hit]
            np.minimum.at(rank, slot, r)
            best = rank[slot] == r
            name[slot[best]] = h[best]
            m += 1
        todo &= ~np.isfinite(rank).reshape(n_docs, k).all(axis=1)
        bound = np.where(todo, bound * 2, bound)
    return name.reshape(n_docs, k)


def band_hashes(signatures: np.ndarray) -> np.ndarray:
    """[n_docs, BANDS] bucket numbers."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * _U(0x9E3779B97F4A7C15)
    for j in range(ROWS):
        out = mix(out + parts[:, :, j])
    return out


def elements_of(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers for a multiset: the k-th copy of a shingle is an element of its own."""
    n = count.astype(np.int64)
    which = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out = np.repeat(h, n)
    again = which > 0
    out[again] = mix(out[again] + which[again].astype(np.uint64) * _POSITIONS[7])
    return np.sort(out)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of distinct elements."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    shared = int((b[at] == a).sum())
    return shared / (len(a) + len(b) - shared)


def text_chunks(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """The rows (id, text) of a batch, about CHUNK_BYTES of text at a time, so that a worker holds little beside the batch."""
    ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(ends // CHUNK_BYTES)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            part = batch.slice(a, b - a)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()


def signed(texts: DataFrame) -> DataFrame:
    """(id, key, bands) of (id, text): key says which texts have equal words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, some in text_chunks(batch):
                words = word_lists(some)
                h, w, o = shingle_weights(words)
                bands = band_hashes(dart_signatures(h, w, o, len(some))).view(np.int64)
                keys = [xxhash.xxh3_128_digest(("w" + " ".join(x) if x else "r" + t).encode("utf-8", "surrogatepass")) for x, t in zip(words, some, strict=True)]
                columns = [pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array([list(b) if x else [] for b, x in zip(bands, words, strict=True)], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "key", "bands"])

    return texts.mapInArrow(sign, "id long, key binary, bands array<long>")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(id, elements, size) of (id, text): the elements as one little-endian binary, sorted."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, some in text_chunks(batch):
                h, w, o = shingle_weights(word_lists(some))
                cuts = np.searchsorted(o, np.arange(len(some) + 1))
                found = [elements_of(h[a:b], w[a:b]).astype("<u8") for a, b in zip(cuts, cuts[1:])]
                columns = [pa.array(ids, pa.int64()), pa.array([x.tobytes() for x in found], pa.binary()), pa.array([len(x) for x in found], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "elements", "size"])

    return texts.mapInArrow(sets, "id long, elements binary, size int")


def similarity(a: pa.Scalar, b: pa.Scalar) -> float:
    """Of the elements of two rows of shingle_sets."""
    return jaccard(*(np.frombuffer(x.as_buffer(), "<u8") for x in (a, b)))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of a written table whose shingles are similar enough.

    `a` has few different values (leaders): their sets travel to the pairs, which carry the sets of `b`.
    """
    led = meet(sets.select(F.col("id").alias("b"), F.col("elements").alias("eb")), pairs, "b")
    leaders = materialise(pairs.select(F.col("a").alias("id")).distinct(), "leaders")
    of_leaders = meet(sets, leaders, "id", "left_semi").select(F.col("id").alias("a"), F.col("elements").alias("ea"))
    both = led.join(of_leaders.hint("merge"), "a")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similarity(x, y) >= SIMILARITY for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    out = materialise(both.select("a", "b", "ea", "eb").mapInArrow(compare, "a long, b long"), "links")
    remove(leaders)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(id, class) of every node of the edges (a, b); class is the smallest id of its component.

    Each round every node takes the smallest class among its neighbours', then the class of its class, so
    the rounds grow with the logarithm of the longest chain. Classes are written each round.
    """
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct().toDF("id", "other"), "edges")
    now = materialise(both.groupBy("id").agg(F.least(F.min("other"), F.first("id")).alias("class")), "classes")
    changed = not now.isEmpty()
    while changed:
        near = meet(both, now.toDF("other", "there"), "other").groupBy("id").agg(F.min("there").alias("there"))
        low = now.join(near, "id").select("id", F.least("class", "there").alias("low"), "class")
        step = meet(low, now.toDF("low", "next"), "low", "left").select("id", F.least("low", F.coalesce("next", "low")).alias("class"), F.col("class").alias("was"))
        step = materialise(step, "classes")
        changed = not step.filter("class <> was").isEmpty()
        remove(now)
        now = step.drop("was")
        now.written_to = step.written_to
    remove(both)
    return now


def joined_classes(found: DataFrame, links: DataFrame) -> DataFrame:
    """`found` (id, class) with the classes that the links (a, b) connect made one."""
    ends = meet(meet(links, found.toDF("a", "x"), "a"), found.toDF("b", "y"), "b").filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    moved = components(ends)
    out = materialise(meet(found, moved.toDF("class", "to"), "class", "left").select("id", F.coalesce("to", "class").alias("class")), "found")
    remove(moved, found)
    return out


def led_pairs(members: DataFrame, rank) -> DataFrame:
    """(a, b): the bucket's member of highest rank, and each other member; members: bucket, rep."""
    led = materialise(members.groupBy("bucket").agg(F.max_by("rep", F.struct(rank, "rep")).alias("leader")), "led")
    return meet(members, led, "bucket").filter("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()


def unsettled(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members of the buckets of three and more that lie in several components: bucket, rep, class, main (the largest class there)."""
    placed = meet(members.filter("n > 2").select("bucket", "rep"), found.toDF("rep", "class"), "rep")
    sizes = placed.groupBy("bucket", "class").agg(F.count("*").alias("n"))
    main = sizes.groupBy("bucket").agg(F.max_by("class", F.struct("n", "class")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("n_main")).filter("n > n_main").drop("n", "n_main")
    main = materialise(main, "main")
    out = materialise(meet(placed, main, "bucket"), "open")
    remove(main)
    return out


def histograms(sets: DataFrame) -> DataFrame:
    """(rep, size, bins) of shingle_sets: how many elements fall in each of BINS bins by hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = [np.bincount((np.frombuffer(x.as_buffer(), "<u8") % _U(BINS)).astype(np.int64), minlength=BINS).astype("<u4").tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(bins, pa.binary())], ["rep", "size", "bins"])

    return sets.mapInArrow(count, "rep long, size int, bins binary")


def most_shared(bins: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The most elements that a text can share with each of the others."""
    return np.minimum(others, bins).sum(axis=1)


def dealt_blocks(open_: DataFrame, details: DataFrame, heavy: bool) -> tuple:
    """Outsiders and all members of unsettled buckets as cogroups of bounded blocks; each pair of blocks is one group.

    open_: bucket, rep, class, main, size; `heavy` says that details hold the shingles, so blocks are cut by them too.
    """
    outside = F.col("class") != F.col("main")
    weight = F.greatest(F.count("*") / MEMBER_BLOCK, F.sum("size") / BLOCK_SHINGLES if heavy else F.lit(0.0))
    out_weight = F.greatest(F.count_if(outside) / OUT_BLOCK, F.sum(F.when(outside, F.col("size"))) / BLOCK_SHINGLES if heavy else F.lit(0.0))
    counts = materialise(open_.groupBy("bucket").agg(F.ceil(weight).cast("int").alias("blocks"), F.ceil(out_weight).cast("int").alias("chunks")).filter("chunks > 0"), "blocks")
    rows = meet(open_, counts, "bucket")
    place = lambda n: F.pmod(F.xxhash64("rep", F.lit(3)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["bucket", "chunk", "block"]
    out = rows.filter(outside).withColumn("chunk", place("chunks")).select("bucket", "rep", "class", "chunk", every("blocks").alias("block"))
    others = rows.withColumn("block", place("blocks")).select("bucket", "rep", "class", "block", every("chunks").alias("chunk"))
    out, others = (d.join(details, "rep").select(*keys, "class", *details.columns) for d in (out, others))
    out = out.toDF(*[f"out_{c}" for c in out.columns])
    return out.groupBy(*[f"out_{k}" for k in keys]).cogroup(others.groupBy(*keys))


def contested(open_: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows of open_ in some pair of components that may be similar. marks: rep, bands, bins."""
    found = dealt_blocks(open_, marks, False).applyInArrow(_contested_group, "bucket long, rep long").distinct()
    return open_.join(found, ["bucket", "rep"], "left_semi")


def outside_links(open_: DataFrame, details: DataFrame) -> DataFrame:
    """Links (a, b) between members outside a bucket's main component and members of other components.

    details: rep, bands, bins, elements. A pair is looked at in its first common band only, and the likely ones
    first; an outsider stops at its first link with each component.
    """
    return dealt_blocks(open_, details, True).applyInArrow(_outside_group, "a long, b long").distinct()


def _able(out: pa.Table, others: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of out, which rows of others it may be linked with, the most similar they can be)."""
    bucket = out["bucket"][0].as_py()

    def numbers(t: pa.Table) -> tuple[np.ndarray, ...]:
        return t["class"].to_numpy(), np.frombuffer(b"".join(t["bins"].to_pylist()), "<u4").reshape(-1, BINS), np.array(t["bands"].to_pylist(), np.int64)

    cls, bins, bands = numbers(out)
    o_cls, o_bins, o_bands = numbers(others)
    size, o_size = bins.sum(axis=1), o_bins.sum(axis=1)
    for i in range(len(cls)):
        able = (o_cls != cls[i]) & (np.minimum(size[i], o_size) >= SIMILARITY * np.maximum(size[i], o_size))
        at = np.flatnonzero(able)
        at = at[bands[i][(o_bands[at] == bands[i]).argmax(axis=1)] == bucket]
        shared = most_shared(bins[i], o_bins[at])
        most = np.zeros(len(o_cls))
        most[at] = shared / (size[i] + o_size[at] - shared)
        yield i, most >= SIMILARITY, most


def _contested_group(out: pa.Table, others: pa.Table) -> pa.Table:
    reps: set[int] = set()
    bucket: list[int] = []
    if out.num_rows and others.num_rows:
        out = out.rename_columns([c.removeprefix("out_") for c in out.column_names])
        ids, o_ids = out["rep"].to_numpy(), others["rep"].to_numpy()
        for i, able, _ in _able(out, others):
            if able.any():
                reps.add(int(ids[i]))
                reps.update(o_ids[able].tolist())
        bucket = [out["bucket"][0].as_py()] * len(reps)
    return pa.table({"bucket": pa.array(bucket, pa.int64()), "rep": pa.array(sorted(reps), pa.int64())})


def _outside_group(out: pa.Table, others: pa.Table) -> pa.Table:
    links: list[tuple[int, int]] = []
    if out.num_rows and others.num_rows:
        out = out.rename_columns([c.removeprefix("out_") for c in out.column_names])
        ids, o_ids, o_cls = out["rep"].to_pylist(), others["rep"].to_pylist(), others["class"].to_pylist()
        for i, able, most in _able(out, others):
            joined: set[int] = set()
            for j in sorted(np.flatnonzero(able).tolist(), key=lambda j: (-most[j], o_ids[j])):
                if o_cls[j] not in joined and similarity(out["elements"][i], others["elements"][j]) >= SIMILARITY:
                    joined.add(o_cls[j])
                    links.append((ids[i], o_ids[j]))
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})


def text_classes(texts: DataFrame) -> DataFrame:
    """(id, class) of (id, text), ids unique and texts not null; class is the smallest id of the class."""
    rows = materialise(signed(texts), "signed")
    reps = materialise(rows.groupBy("key").agg(F.min("id").alias("rep"), F.first("bands").alias("bands")), "reps")
    every = reps.select("rep", F.explode("bands").alias("bucket"))
    sizes = materialise(every.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    members = materialise(meet(every, sizes, "bucket"), "members")
    weight = materialise(members.groupBy(F.col("rep").alias("id")).agg(F.sum("n").alias("weight")), "weight")
    sets = materialise(shingle_sets(meet(texts, weight.select("id"), "id", "left_semi")), "sets")

    pairs = materialise(led_pairs(meet(members, weight.toDF("rep", "weight"), "rep"), F.col("weight")), "pairs")
    links = verified(pairs, sets)
    first = components(links)
    found = materialise(meet(weight.select("id"), first, "id", "left").select("id", F.coalesce("class", "id").alias("class")), "found")
    remove(sizes, weight, pairs, links, first)
    open_ = unsettled(members, found)
    for turn in range(EXTRA_LEADERS):
        if open_.isEmpty():
            break
        leaders = materialise(open_.filter("class = main").groupBy("bucket").agg(F.max_by("rep", F.xxhash64("rep", F.lit(turn))).alias("a")), "leaders")
        pairs = materialise(meet(open_.filter("class <> main"), leaders, "bucket").select("a", F.col("rep").alias("b")).distinct(), "pairs")
        links = verified(pairs, sets)
        found = joined_classes(found, links)
        remove(leaders, pairs, links, open_)
        open_ = unsettled(members, found)
    if not open_.isEmpty():
        ids = materialise(open_.select(F.col("rep").alias("id")).distinct(), "ids")
        bins = materialise(histograms(meet(sets, ids, "id", "left_semi")), "bins")
        sized = open_.join(bins.select("rep", "size"), "rep")
        marks = bins.drop("size").join(meet(reps.select("rep", "bands"), ids.toDF("rep"), "rep", "left_semi"), "rep")
        able = materialise(contested(sized, marks), "contested")
        links = materialise(outside_links(able, marks.join(sets.select(F.col("id").alias("rep"), "elements"), "rep")), "links")
        found = joined_classes(found, links)
        remove(ids, bins, able, links)
    remove(open_, members, sets)
    keyed = rows.select("id", "key").join(reps.select("key", "rep").hint("merge"), "key").select("id", "rep")
    return meet(keyed, found.toDF("rep", "class"), "rep", "left").select("id", F.coalesce("class", "rep").alias("class"))


def numbered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """((id, doc_id, text, row), whether id is doc_id): id is unique, and grows with doc_id, nulls last.

    Only where doc_ids repeat or are null, rows are numbered in a written table.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*docs.columns).alias("row"))
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null")
    if odd.isEmpty():
        return rows.withColumn("id", F.col("doc_id")), True
    order = [F.asc_nulls_last("doc_id"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return materialise(ordered.withColumn("id", F.monotonically_increasing_id()), "numbered"), False


def row_classes(rows: DataFrame, plain: bool) -> DataFrame:
    """(id, class) of every row of numbered()."""
    out = text_classes(rows.filter("text is not null").select("id", "text"))
    out = out.unionByName(rows.filter("text is null").select("id", F.col("id").alias("class")))
    if plain:
        return out
    found = materialise(out, "classes")
    same = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min("id").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    links = rows.select("id", "doc_id").join(same, "doc_id").filter("id <> a").select("a", F.col("id").alias("b"))
    return joined_classes(found, links)


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id): one row for each document row; class_id is the smallest doc_id of the class."""
    rows, plain = numbered(docs)
    found = row_classes(rows, plain)
    if plain:
        return found.toDF("doc_id", "class_id")
    names = rows.select("id", "doc_id")
    least = names.select(F.col("id").alias("class"), F.col("doc_id").alias("class_id"))  # ids grow with doc_id
    return found.join(names, "id").join(least, "class").select("doc_id", "class_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each class, that with the smallest id (the first by hash of the text where ids repeat), columns unchanged."""
    rows, plain = numbered(docs)
    copies = materialise(row_classes(rows, plain).filter("id <> class").select("id"), "copies")
    return meet(rows.select("id", "row"), copies, "id", "left_anti").select("row.*")
