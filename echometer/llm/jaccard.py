"""N-gram Jaccard join by T-occurrence search with DivideSkip, and the groups its links form.

Two documents link when the Jaccard similarity of their sets of word shingles reaches a threshold. The
result is each document's component, so links inside what is known to be one component are not looked
for again; no link between components is missed, and pairs within a group are never all emitted.

1. Equal sets are one class, told by a 128-bit digest; one document stands for it.
2. First blocks: documents with the same smallest shingle hash, in parts of ``BLOCK`` documents which all
   contain the block's first document.
3. Inverted lists over signature keys. Shingles are ordered rare ones first (a sketch of their frequency
   over all documents says which are frequent), and the first ``n - ceil(t n) + 1`` of a set of n are its
   keys; similar sets have a key in common. Frequent shingles make no lists. A set whose keys would reach
   into them has keys of a second kind: its shingles are dealt into more than twice as many parts as
   similar sets can differ in shingles, and each part's content is a key, so that similar sets have a part
   in common.
4. Long lists of the second kind, those of large groups of near copies, are never paired. Documents that such
   lists connect are a family, dealt by size into parts of ``BLOCK`` documents; each document outside the
   family's largest component is looked for in every part of sizes that allow a link. A family of f documents,
   q of them outside, takes some q f / ``BLOCK`` placed documents.
5. Other lists with several components give candidates: first the first document of each component against
   the first of the list, again while that joins many components, then all pairs across components whose sizes
   allow a link. A parity vector of each set bounds the overlap from above and drops most other pairs. The
   rest are searched in blocks of one document and its candidates.

In a block, DivideSkip finds the documents that reach the required overlap with a query document: its short
inverted lists are merged and counted, documents that can still reach it are looked up in its longest
lists by binary search, or those lists are merged too where that is less than the lookups. Merging is done
by counting the entries of whole lists in numpy, which gives the counts that a heap gives. Documents already
joined with the query are left out.

The frequency sketch and the keys cover all documents. The sketch only steers the order of shingles: any
order gives the same links. Hot keys: copies are one class; large blocks are split; a key's first documents
are minima with partial steps; the joins are equi-joins that adaptive execution can split.

A null or empty text has no shingles and links with nothing; with fewer words than a shingle the whole
sequence is one. Rows with one id are one document. A text without any id links nothing and has no
component. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echometer.llm import common
from echometer.llm.components import components
from echometer.llm.shingles import shingle_set

#: Similarity as a fraction, so that it is compared in whole numbers.
THRESHOLD = (75, 100)
#: Documents of a block.
BLOCK = 256
#: Buckets of the frequency sketch.
BUCKETS = 1 << 22
#: Buckets whose counts a task reports as one row.
PAGE = 1 << 14
#: Documents with a shingle of the bucket from which on it counts as frequent, at least.
FREQUENT = 64
#: Times the mean load of a bucket that a frequent one has at least.
ABOVE_MEAN = 8
#: Rows up to which a list of documents is broadcast; longer ones are joined by shuffle.
BROADCAST_ROWS = 300_000
#: Pairs of first documents per link found up to which they are tried again before all pairs are.
WORTH_A_ROUND = 4
#: Share of the least overlap that is left to long lists.
LONG_SHARE = 0.5
#: Entries of long lists that are merged in the time of one document's lookup.
PER_LOOKUP = 1000
#: Documents of a list of the second kind from which on it is searched by families.
FAMILY = 64

MARKS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("high", T.LongType()),
        T.StructField("low", T.LongType()),
        T.StructField("least", T.LongType()),
        T.StructField("parity", T.ArrayType(T.LongType())),
        T.StructField("page", T.IntegerType()),
        T.StructField("loads", T.BinaryType()),
    ]
)
_ARROW_MARKS = pa.schema(
    [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("high", pa.int64()), ("low", pa.int64()),
     ("least", pa.int64()), ("parity", pa.list_(pa.int64())), ("page", pa.int32()), ("loads", pa.binary())]
)


def needed(n: int, m: int | np.ndarray, threshold: tuple[int, int] = THRESHOLD) -> int | np.ndarray:
    """Least overlap of sets of n and m elements that reaches the similarity."""
    part, whole = threshold
    return -(-part * (n + m) // (part + whole))


def _bucket_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64(BUCKETS - 1)).astype(np.int64)


def _parity(tokens: np.ndarray) -> np.ndarray:
    """For each of many buckets whether an odd number of shingles falls into it, in 64-bit words.

    There are at least as many buckets as shingles, a power of two: similar sets have as many, or one of
    them has twice as many, and folding its halves by exclusive or gives the vector of the other length.
    """
    buckets = max(64, 1 << (len(tokens) - 1).bit_length()) if len(tokens) else 64
    bits = np.bincount((tokens >> np.uint64(22) & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def mark(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A stored row per document (size, digest, smallest shingle, parity), and per loaded page of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads = np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            rows = []
            for data in common.as_bytes(batch.column(1)):
                tokens = shingle_set(data)
                loads[_bucket_of(tokens)] += 1
                digest = xxhash.xxh3_128_intdigest(tokens.tobytes())
                least = int(tokens[0]) if len(tokens) else 0
                rows.append((len(tokens), _signed(digest >> 64), _signed(digest & (1 << 64) - 1),
                             _signed(least), _parity(tokens), None, None))
            columns = [batch.column(0), *(list(x) for x in zip(*rows))] if rows else [[] for _ in _ARROW_MARKS]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW_MARKS)], schema=_ARROW_MARKS)
        pages = loads.reshape(-1, PAGE)
        for part in np.array_split(np.flatnonzero(pages.any(axis=1)), 8):
            # As narrow as the largest count allows.
            packed = [zlib.compress(pages[k].astype(np.min_scalar_type(pages[k].max())).tobytes(), 1) for k in part]
            none = pa.nulls(len(part), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, none, none, none, none, pa.nulls(len(part), pa.list_(pa.int64())), pa.array(part, pa.int32()),
                 pa.array(packed, pa.binary())], schema=_ARROW_MARKS,
            )

    rows = docs.select(common.plain(key).cast("long").alias("doc_id"), common.plain(text).alias("text"))
    return common.stored(common.map_batches(rows, run, MARKS), "shingle-marks")


def frequent_buckets(marks: DataFrame) -> np.ndarray:
    """Buckets of frequent shingles: at most one in ``ABOVE_MEAN``, whatever the corpus."""
    total = marks.agg(F.sum("n_shingles")).first()[0] or 0
    enough = max(FREQUENT, ABOVE_MEAN * total // BUCKETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for page, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = zlib.decompress(packed)
                counts = np.frombuffer(data, f"u{len(data) // PAGE}")
                sums[page] = sums.get(page, 0) + counts.astype(np.int64)
        for page, counts in sums.items():
            found = np.flatnonzero(counts >= enough) + page * PAGE
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32())], names=["bucket"])

    pages = marks.filter("page IS NOT NULL").select("page", "loads")
    pages = pages.repartition(common.shuffle_partitions(marks.sparkSession), "page")
    schema = T.StructType([T.StructField("bucket", T.IntegerType())])
    return common.map_batches(pages, run, schema).toPandas()["bucket"].to_numpy(np.int64)


# Signature keys


def _class_of(n: int) -> int:
    """Sizes are grouped so that those of similar sets are in the same or in neighbouring groups."""
    return math.floor(math.log(n) / math.log(THRESHOLD[1] / THRESHOLD[0]) + 1e-9)


def _differences(group: int) -> int:
    """Most shingles in which similar sets of sizes up to this group can differ."""
    part, whole = THRESHOLD
    largest = math.ceil((whole / part) ** (group + 1)) + 1
    return (whole - part) * 2 * largest // (whole + part)


def part_keys(tokens: np.ndarray) -> np.ndarray:
    """Keys of the second kind, for a set's own size group and the next."""
    out = []
    for group in (_class_of(len(tokens)), _class_of(len(tokens)) + 1):
        most = _differences(group)
        parts = 2 * (most + 1)
        of = (tokens >> np.uint64(33)) % np.uint64(parts)
        content = np.zeros(parts, np.uint64)
        np.add.at(content, of.astype(np.int64), (tokens * np.uint64(0x9E3779B97F4A7C15)) ^ (tokens >> np.uint64(31)))
        filled = np.unique(of).astype(np.int64)
        # With that many filled parts, one of them is the same in any similar set; else empty ones count too.
        chosen = filled if len(filled) > most else np.arange(parts)
        seed = np.uint64((group * 0xD6E8FEB86659FD93 + 1) & (1 << 64) - 1)
        keys = (content[chosen] + seed) * np.uint64(0xC2B2AE3D27D4EB4F)
        keys = (keys ^ (keys >> np.uint64(32))) + chosen.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
        out.append((keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9))
    return np.concatenate(out)


def signature_keys(tokens: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, int]:
    """Keys of a set, and how many of them are shingles; sets similar enough have at least one in common.

    ``frequent`` is a flag per bucket. Shingles are keys in ascending order: the place of the first one that
    two sets have in common bounds their overlap.
    """
    n = len(tokens)
    if not n:
        return tokens, 0
    length = n - -(-THRESHOLD[0] * n // THRESHOLD[1]) + 1
    rare = tokens[~frequent[_bucket_of(tokens)]][:length]
    return (rare if len(rare) == length else np.concatenate((rare, part_keys(tokens)))), len(rare)


def keyed(docs: DataFrame, frequent: np.ndarray, key: str, text: str) -> DataFrame:
    """``node``, ``keys`` and ``n_rare``, the number of shingles among them, of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    schema = T.StructType(
        [T.StructField("node", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())),
         T.StructField("n_rare", T.IntegerType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(BUCKETS, bool)
        flags[shared.value] = True
        for batch in batches:
            found = [signature_keys(shingle_set(d), flags) for d in common.as_bytes(batch.column(1))]
            keys = pa.array([k.view(np.int64) for k, _ in found], pa.list_(pa.int64()))
            n_rare = pa.array([n for _, n in found], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), keys, n_rare], names=schema.names)

    rows = docs.select(common.plain(key).cast("long").alias("doc_id"), common.plain(text).alias("text"))
    return common.map_batches(rows, run, schema)


# Search within a block


@dataclass
class Forest:
    """Union-find over the documents of a block."""

    parents: list[int] = field(default_factory=list)

    def root(self, x: int) -> int:
        while self.parents[x] != x:
            self.parents[x] = x = self.parents[self.parents[x]]
        return x

    def join(self, a: int, b: int) -> None:
        self.parents[max(a, b)] = min(a, b)


def _probed(own: np.ndarray, tokens: np.ndarray) -> int:
    """How many of the lists of ``tokens`` a set is in, by binary search."""
    places = np.minimum(np.searchsorted(own, tokens), len(own) - 1)
    return int((own[places] == tokens).sum())


def search_block(sets: list[np.ndarray], leads: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that join all similar sets of a block, or all that are similar to one of ``leads``, by DivideSkip."""
    forest, links = Forest(list(range(len(sets)))), []
    sizes = np.array([len(s) for s in sets])
    tokens = np.concatenate(sets)
    owners = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owners = tokens[order], owners[order]
    starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
    ends = np.append(starts[1:], len(tokens))
    heads = tokens[starts]
    part, whole = THRESHOLD

    def merged(lists: np.ndarray) -> np.ndarray:
        entries = [owners[starts[i] : ends[i]] for i in lists]
        return np.bincount(np.concatenate(entries) if entries else np.empty(0, np.int64), minlength=len(sets))

    for x in range(len(sets)) if leads is None else leads:
        own = sets[x]
        lists = np.searchsorted(heads, own)
        lengths = ends[lists] - starts[lists]
        lists = lists[np.argsort(lengths, kind="stable")]
        lengths = ends[lists] - starts[lists]
        least = -(-part * len(own) // whole)
        if len(own) == 0 or (lengths > 1).sum() < least:
            continue
        # More long lists leave less to merge and more to look up.
        n_long = int(LONG_SHARE * (least - 1))
        cut = len(lists) - n_long
        counts = merged(lists[:cut])
        required = needed(len(own), sizes)
        enough = (counts >= least - n_long) & (counts + n_long >= required)
        if leads is None:
            enough[x:] = False
        enough[x] = False
        candidates = np.flatnonzero(enough)
        together = lengths[cut:].sum() <= PER_LOOKUP * len(candidates)
        if together:
            candidates = candidates[(counts + merged(lists[cut:]) >= required)[candidates]]
        for y in candidates.tolist():
            if forest.root(y) == forest.root(x):
                continue
            if together or counts[y] + _probed(sets[y], heads[lists[cut:]]) >= required[y]:
                forest.join(forest.root(x), forest.root(y))
                links.append((x, y))
    return links


def search_blocks(docs: DataFrame, members: DataFrame, key: str, text: str) -> DataFrame:
    """Links (``a``, ``b``) within blocks; ``members`` has (``block``, ``part``, ``node``), distinct.

    With a column ``lead`` only links with the nodes marked by it are looked for.
    """
    if "lead" not in members.columns:
        members = members.withColumn("lead", F.lit(None).cast("boolean"))
    # A short list goes to where the texts are; with a long one the texts are shuffled once more.
    if members.count() <= BROADCAST_ROWS:
        members = F.broadcast(members)
    rows = docs.select(common.plain(key).cast("long").alias("node"), common.plain(text).alias("text"))
    placed = rows.join(members, "node").select("block", "part", "node", "text", "lead")
    partitions = common.shuffle_partitions(docs.sparkSession)
    together = placed.repartition(partitions, "block", "part").sortWithinPartitions("block", "part", "node")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def found(nodes: list[int], sets: list[np.ndarray], marks: list[bool | None]) -> pa.RecordBatch:
        links = []
        if len(nodes) > 1:
            links = search_block(sets, None if marks[0] is None else [k for k, lead in enumerate(marks) if lead])
        pairs = [(nodes[x], nodes[y]) for x, y in links]
        # Rows with one id are one document.
        pairs = [(a, b) for a, b in pairs if a != b]
        return pa.RecordBatch.from_arrays(
            [pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, nodes, sets, marks, seen = (None, None), [], [], [], None
        for batch in batches:
            places = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            rows = zip(places, batch.column(2).to_pylist(), common.as_bytes(batch.column(3)), batch.column(4).to_pylist())
            for place, node, data, lead in rows:
                if place != block:
                    yield found(nodes, sets, marks)
                    block, nodes, sets, marks, seen = place, [], [], [], None
                if (node, data) == seen:
                    continue
                seen = (node, data)
                nodes.append(node)
                sets.append(shingle_set(data))
                marks.append(lead)
        yield found(nodes, sets, marks)

    return common.stored(common.map_batches(together, run, schema), "links")


def _split_blocks(members: DataFrame) -> DataFrame:
    """(``block``, ``node``) as parts of about ``BLOCK`` documents that share the block's first one."""
    sizes = members.groupBy("block").agg(F.count("*").alias("size"), F.min("node").alias("first"))
    sizes = sizes.filter("size > 1").withColumn("parts", F.ceil(F.col("size") / BLOCK).cast("int"))
    rest = members.join(sizes, "block").select(
        "block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node"
    )
    firsts = sizes.select(
        "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("first").alias("node")
    )
    return rest.unionByName(firsts).distinct()


# Candidates across components


def _relabelled(rows: DataFrame, labels: DataFrame, node: str = "node") -> DataFrame:
    """``rows`` with the ``component`` of each node, itself if it has no label."""
    known = labels.select(F.col("node").alias(node), F.col("component").alias("known"))
    return rows.drop("component").join(known, node, "left").withColumn(
        "component", F.coalesce("known", node)
    ).drop("known")


def _several(postings: DataFrame) -> DataFrame:
    """Postings of the keys whose documents are in several components, with the list's ``length`` and ``first``."""
    open_keys = (
        postings.groupBy("key")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"),
             F.count("*").alias("length"), F.min("node").alias("first"))
        .filter("low <> high")
        .select("key", "length", "first")
    )
    return postings.drop("length", "first").join(open_keys, "key")


def _family_blocks(postings: DataFrame, nodes: DataFrame) -> DataFrame:
    """Blocks of the families that these lists connect, led by the documents outside the largest component.

    A block has documents of one family and one size group; leads go to the parts of their own and of the
    neighbouring groups, which similar sets are in.
    """
    families = components(postings.select(F.col("first").alias("a"), F.col("node").alias("b")).distinct())
    group = F.floor(F.log("size") / math.log(THRESHOLD[1] / THRESHOLD[0]) + 1e-9).cast("int")
    members = nodes.join(families.withColumnRenamed("component", "family"), "node").withColumn("group", group)
    members = common.stored(members.select("family", "group", "node", "component"), "families")
    largest = members.groupBy("family", "component").count().groupBy("family").agg(
        F.max(F.struct("count", "component")).alias("largest")
    )
    sizes = members.groupBy("family", "group").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    block = F.xxhash64("family", "group").alias("block")
    data = members.join(sizes, ["family", "group"]).select(
        block, F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node", F.lit(False).alias("lead")
    )
    outside = members.join(largest, "family").filter("component <> largest.component")
    near = F.explode(F.array(*(F.col("group") + k for k in (-1, 0, 1))))
    leads = outside.select("family", near.alias("group"), "node").join(sizes, ["family", "group"]).select(
        block, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "node", F.lit(True).alias("lead")
    )
    return data.unionByName(leads).groupBy("block", "part", "node").agg(F.max("lead").alias("lead"))


def _first_pairs(postings: DataFrame) -> DataFrame:
    """First document of each component against the first document of the list."""
    by_component = postings.groupBy("key", "component").agg(F.min(F.struct("node", "size")).alias("one"))
    first = by_component.groupBy("key").agg(F.min(F.struct(F.col("one.node"), F.col("one.size"), "component")).alias("first"))
    return by_component.join(first, "key").filter("component <> first.component").select(
        F.col("one.node").alias("a"), F.col("one.size").alias("a_size"),
        F.col("first.node").alias("b"), F.col("first.size").alias("b_size"),
    )


def _all_pairs_across(postings: DataFrame) -> DataFrame:
    """Pairs of a list's documents in different components, of sizes and places that allow a link.

    The first key that two sets have in common leaves no more for their overlap than comes after it.
    """
    a, b = postings.alias("a"), postings.alias("b")
    part, whole = THRESHOLD
    least = (F.col("a.size") + F.col("b.size")) * part
    left = [(F.col(f"{x}.size") - F.col(f"{x}.place")) * (part + whole) >= least for x in "ab"]
    return a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.component") < F.col("b.component"))
                  & _sizes_allow(F.col("a.size"), F.col("b.size")) & left[0] & left[1]).select(
        F.col("a.node").alias("a"), F.col("a.size").alias("a_size"),
        F.col("b.node").alias("b"), F.col("b.size").alias("b_size"),
    )


def _sizes_allow(a: Column, b: Column) -> Column:
    part, whole = THRESHOLD
    return (a * part <= b * whole) & (b * part <= a * whole)


def _possible(pairs: DataFrame, parities: DataFrame) -> DataFrame:
    """Distinct pairs that sizes and parity vectors allow to link.

    Sets that differ in d shingles have parity vectors that differ in at most d bits.
    """
    part, whole = THRESHOLD
    distinct = pairs.filter(_sizes_allow(F.col("a_size"), F.col("b_size"))).distinct()
    vectors = distinct
    for side in ("a", "b"):
        vectors = vectors.join(
            parities.select(F.col("node").alias(side), F.col("parity").alias(f"{side}_parity")), side
        )
    words = F.least(F.size("a_parity"), F.size("b_parity"))

    def folded(vector: str) -> Column:
        halves = F.slice(vector, 1, words), F.slice(vector, words + 1, words)
        return F.when(F.size(vector) == words, F.col(vector)).otherwise(
            F.zip_with(*halves, lambda x, y: x.bitwiseXOR(y))
        )

    differing = F.zip_with(folded("a_parity"), folded("b_parity"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    bits = F.aggregate(differing, F.lit(0), lambda total, x: total + x)
    most = (F.col("a_size") + F.col("b_size")) * (whole - part)
    return vectors.filter(bits * (whole + part) <= most).select("a", "b").distinct()


def _blocks_of_pairs(pairs: DataFrame) -> DataFrame:
    """Blocks of one document and its candidates: the document with more candidates leads."""
    members = pairs.select(F.col("b").alias("block"), F.col("a").alias("node"))
    sizes = members.groupBy("block").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    rest = members.join(sizes, "block").select(
        "block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node", F.lit(False).alias("lead")
    )
    leads = sizes.select(
        "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("block").alias("node"),
        F.lit(True).alias("lead"),
    )
    return rest.distinct().unionByName(leads)


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row."""
    marks = mark(docs, key, text)
    rows = marks.filter("page IS NULL")
    classes = rows.filter("n_shingles > 0").groupBy("high", "low").agg(
        F.min("doc_id").alias("node"), F.first("least").alias("least"),
        F.first("n_shingles").alias("size"), F.first("parity").alias("parity"),
    )
    classes = common.stored(classes.filter("node IS NOT NULL"), "classes")

    # First blocks: the texts that share their smallest shingle.
    blocks = _split_blocks(classes.select(F.col("least").alias("block"), "node").distinct())
    links = search_blocks(docs, common.stored(blocks, "blocks"), key, text)
    labels = components(links)

    # What is left: keys whose documents are in several components.
    frequent = frequent_buckets(marks)
    nodes = _relabelled(classes.select("node", "size"), labels)
    # Stored, since what follows reads the postings twice.
    keys = common.stored(keyed(docs, frequent, key, text).join(nodes, "node"), "keys")
    postings = (
        keys.select(F.posexplode("keys").alias("nth", "key"), "n_rare", "node", F.col("size").cast("int").alias("size"), "component")
        .withColumn("place", F.when(F.col("nth") < F.col("n_rare"), F.col("nth")).otherwise(0))
        .withColumn("second", F.col("nth") >= F.col("n_rare"))
        .drop("nth", "n_rare")
    )
    postings = common.stored(_several(postings), "postings")
    parities = common.stored(classes.select("node", "parity"), "parities")
    in_families = F.col("second") & (F.col("length") > FAMILY)
    connecting = postings.filter(in_families)
    if connecting.limit(1).count():
        blocks = common.stored(_family_blocks(connecting, nodes), "blocks")
        links = links.unionByName(search_blocks(docs, blocks, key, text))
        labels = components(links)
        postings = common.stored(_several(_relabelled(postings.filter(~in_families), labels)), "postings")
    everything = False
    while True:
        pairs = _all_pairs_across(postings) if everything else _first_pairs(postings)
        possible = common.stored(_possible(pairs, parities), "pairs")
        found = search_blocks(docs, common.stored(_blocks_of_pairs(possible), "blocks"), key, text)
        joined = found.count()
        if joined:
            links = links.unionByName(found)
            labels = components(links)
        if everything:
            break
        if joined:
            postings = common.stored(_several(_relabelled(postings, labels)), "postings")
        # First documents alone are worth another round only while a good part of them links.
        everything = joined == 0 or joined * WORTH_A_ROUND < possible.count()

    named = rows.join(classes.select("high", "low", "node"), ["high", "low"], "left")
    named = named.select("doc_id", "n_shingles", "node").join(labels, "node", "left")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")).otherwise(F.col("doc_id"))
    return named.select("doc_id", "n_shingles", own.alias("component_id"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(common.documents(spark, sf_dir, "doc_id", "text"))
