"""SimHash near-duplicates by an inverted index over byte positions with count filtering.

Fingerprints of 64 bits at a distance of 4 or less agree in at least four of their eight
bytes, so they share at least four (position, byte) entries. Postings of one entry hold a
256th of all fingerprints, and tallying them would be quadratic. The index therefore
takes three positions at a time: of the 56 triples, 20 are enough for any four positions
to contain one of them (Turán's system). Where two fingerprints meet in a posting, their
shared positional bytes are tallied; pairs with fewer than four go, the rest are verified.

* Equal fingerprints are one node; copies never meet in a posting.
* Every member of a posting is tallied against its least and greatest member and one
  picked by hash. What links makes first components, in Spark.
* Only postings of three and more members that still hold several components are compared
  within. Members of its largest component are dealt into parts; all others, the
  outsiders, meet every part and each other. Rows are members + outsiders x parts, a task
  sees one block, and a block reports links that join components, not pairs.

So each linked pair is either verified or inside one component: no link is lost.

Edge cases: null, empty and wordless texts have fingerprint zero and are linked like any
other; fewer than four words make one shingle; rows that share a doc_id are one node each
by their texts. A null doc_id never names a component unless all of its rows have none.
Columns other than doc_id and text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionlake.llm.arrays import slices, split_words
from mentionlake.llm.components import components
from mentionlake.llm.tables import documents, texts_of
from mentionlake.staging import stage

SIZE = 4
SEED = 42
DISTANCE = 4
BYTES = 8
# Members of a posting that one part of a block holds
PART = 2048


def triples() -> list[tuple[int, int, int]]:
    """Turán's system: the positions fall into three classes; triples inside a class, and
    those with two of a class and one of the next."""

    def class_of(position: int) -> int:
        return position * 3 // BYTES

    def chosen(t: tuple[int, ...]) -> bool:
        classes = sorted(map(class_of, t), key=[class_of(p) for p in t].count)
        return len(set(classes)) == 1 or (len(set(classes)) == 2 and classes[0] == (classes[1] + 1) % 3)

    return [t for t in combinations(range(BYTES), 3) if chosen(t)]


def fingerprints(texts: pa.Array) -> np.ndarray:
    """The fingerprint of each text as unsigned 64 bits."""
    words = split_words(texts, lower=True)
    counts = words.counts
    # words joined by one blank each
    lengths = words.ends - words.starts
    joined_ends = np.cumsum(lengths + 1) - 1
    joined_starts = joined_ends - lengths
    at = np.repeat(words.starts - joined_starts, lengths + 1) + np.arange(int((lengths + 1).sum()))
    data = np.append(words.data, np.uint8(0x20))[np.minimum(at, len(words.data))]
    data[joined_ends] = 0x20
    each = np.where(counts >= SIZE, counts - SIZE + 1, np.minimum(counts, 1))
    rows = np.repeat(np.arange(len(counts)), each)
    first = np.arange(len(rows)) - np.repeat(np.cumsum(each) - each, each) + words.offsets[:-1][rows]
    last = first + np.minimum(counts, SIZE)[rows] - 1
    raw, hash64 = data.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (hash64(raw[i:j], SEED) for i, j in zip(joined_starts[first].tolist(), joined_ends[last].tolist())), np.uint64, len(rows)
    )
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(each)
    if len(full):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, (np.cumsum(each) - each)[full], axis=0, dtype=np.int64)
        over = 2 * ones > each[full][:, None]
        out[full] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, print) of every row; ``print`` is the bit pattern as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                prints = fingerprints(part.column("text")).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints)], ["doc_id", "print"])

    return texts_of(docs).mapInArrow(run, "doc_id long, print long")


def postings(print_: Column) -> Column:
    """The keys of a fingerprint: each triple of positions with its three bytes."""

    def byte(position: int) -> Column:
        return F.shiftrightunsigned(print_, 8 * position).bitwiseAND(F.lit(255))

    return F.array(*[
        F.lit(k << 24) + F.shiftleft(byte(a), 16) + F.shiftleft(byte(b), 8) + byte(c) for k, (a, b, c) in enumerate(triples())
    ])


# The lowest bit of every byte
_LOWEST = 0x0101010101010101


def shared_bytes(x: Column, y: Column) -> Column:
    """The number of positions at which two fingerprints have the same byte."""
    differ = x.bitwiseXOR(y)
    for step in (4, 2, 1):  # each byte's bits are gathered in its lowest
        differ = differ.bitwiseOR(F.shiftrightunsigned(differ, step))
    return F.lit(BYTES) - F.bit_count(differ.bitwiseAND(F.lit(_LOWEST)))


def linked(x: Column, y: Column) -> Column:
    return (shared_bytes(x, y) >= BYTES - DISTANCE) & (F.bit_count(x.bitwiseXOR(y)) <= DISTANCE)


def _linked(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    differ = x ^ y
    marks = differ
    for step in (4, 2, 1):
        marks = marks | (marks >> np.uint64(step))
    likely = np.flatnonzero(np.bitwise_count(marks & np.uint64(_LOWEST)) <= DISTANCE)
    return likely[np.bitwise_count(differ[likely]) <= DISTANCE]


def joining(prints: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between members of one block whose labels differ, few per component; blocks
    lie one after another from ``starts`` on. All blocks are compared at once, lag by lag."""
    ends = np.append(starts[1:], len(prints))
    end = np.repeat(ends, ends - starts)
    root = np.unique(labels, return_inverse=True)[1]
    found_a, found_b = [], []
    left = np.arange(len(prints))
    for lag in range(1, int((ends - starts).max(initial=0))):
        left = left[left + lag < end[left]]
        apart = left[root[left] != root[left + lag]]
        good = apart[_linked(prints[apart], prints[apart + lag])]
        if not len(good):
            continue
        low, high = np.minimum(root[good], root[good + lag]), np.maximum(root[good], root[good + lag])
        _, first = np.unique(low * len(prints) + high, return_index=True)
        found_a.append(prints[good[first]])
        found_b.append(prints[good[first] + lag])
        parent = np.arange(root.max() + 1)
        low, high = low[first], high[first]
        while len(low):  # hook larger roots to smaller ones until every link is inside one
            np.minimum.at(parent, high, low)
            while (parent[parent] != parent).any():
                parent = parent[parent]
            low, high = np.minimum(parent[low], parent[high]), np.maximum(parent[low], parent[high])
            live = low != high
            low, high = low[live], high[live]
        root = parent[root]
    none = [np.zeros(0, np.uint64)]
    return np.concatenate(none + found_a), np.concatenate(none + found_b)


def _within(blocks: DataFrame) -> DataFrame:
    """Links (a, b) that join components inside the blocks, which lie together and in order."""

    def links(table: pa.Table) -> pa.RecordBatch:
        keys = np.column_stack([table.column(c).to_numpy() for c in ("key", "i", "j")])
        starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
        a, b = joining(table.column("print").to_numpy().view(np.uint64), starts, table.column("component").to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            last = np.ones(table.num_rows, bool)
            for c in ("key", "i", "j"):
                values = table.column(c).to_numpy()
                last &= values == values[-1]
            cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            if cut:  # the last block may go on in the next batch
                yield links(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held:
            yield links(pa.Table.from_batches(held))

    ordered = blocks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return ordered.select("key", "i", "j", "print", "component").mapInArrow(run, "a long, b long")


def _blocks(members: DataFrame) -> DataFrame:
    """(key, i, j, print, component): outsiders meet all parts of a posting and each other."""
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(
        F.sum("n").alias("members"), F.max("n").alias("most"), F.max_by("component", F.struct("n", "component")).alias("largest"),
        F.count("*").alias("components"),
    ).filter("components > 1 AND members > 2").select(
        "key", "largest", F.ceil(F.col("most") / PART).cast("int").alias("inner"),
        F.ceil((F.col("members") - F.col("most")) / PART).cast("int").alias("outer"),
    )
    dealt = members.join(mixed, "key").withColumn("inside", F.col("component") == F.col("largest"))
    deal = F.xxhash64("print")
    mine = F.when(F.col("inside"), F.pmod(deal, F.col("inner"))).otherwise(F.pmod(deal, F.col("outer"))).cast("int")
    none = F.array().cast("array<struct<i:int,j:int>>")

    def upto(n: Column) -> Column:
        return F.sequence(F.lit(0), n - 1)

    # blocks (i, j) of inner part i and outer part j; (-1 - i, j) of the outer parts i < j
    to_inner = F.transform(upto(F.col("inner")), lambda i: F.struct(i.alias("i"), F.col("mine").alias("j")))
    to_outer = F.transform(
        F.filter(upto(F.col("outer")), lambda k: k != F.col("mine")),
        lambda k: F.struct((-1 - F.least(k, F.col("mine"))).alias("i"), F.greatest(k, F.col("mine")).alias("j")),
    )
    from_inner = F.transform(upto(F.col("outer")), lambda j: F.struct(F.col("mine").alias("i"), j.alias("j")))
    where = F.when(F.col("inside"), from_inner).otherwise(F.concat(to_inner, F.when(F.col("outer") > 1, to_outer).otherwise(none)))
    return dealt.withColumn("mine", mine).select("key", F.inline(where), "print", "component")


def classes(prints: DataFrame) -> DataFrame:
    """(print, component) of the distinct fingerprints that have a link."""
    entries = stage(prints.select("print", F.explode(postings(F.col("print"))).alias("key")), "simhash-entries")
    lists = entries.groupBy("key").agg(
        F.count("*").alias("members"), F.min("print").alias("low"), F.max("print").alias("high"),
        F.min_by("print", F.xxhash64("print")).alias("picked"),
    ).filter("members > 1")
    shared = stage(entries.join(lists, "key"), "simhash-shared")
    centres = F.filter(F.array("low", "high", "picked"), lambda c: (c != F.col("print")) & linked(c, F.col("print")))
    links = shared.select(F.col("print").alias("a"), F.explode(centres).alias("b")).distinct()
    first = stage(components(links), "simhash-components").select(F.col("node").alias("print"), "component")
    members = stage(
        shared.filter("members > 2").select("key", "print").join(first, "print", "left")
        .withColumn("component", F.coalesce("component", "print")), "simhash-members",
    )
    more = stage(_within(_blocks(members)).distinct(), "simhash-links")
    if more.isEmpty():
        return first
    both = first.select(F.col("print").alias("a"), F.col("component").alias("b")).unionByName(more)
    return stage(components(both), "simhash-components").select(F.col("node").alias("print"), "component")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``."""
    rows = stage(fingerprinted(docs), "simhash-rows")
    prints = stage(rows.groupBy("print").agg(F.min("doc_id").alias("first")), "simhash-prints")
    named = prints.join(classes(prints.select("print")), "print", "left").withColumn("component", F.coalesce("component", "print"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    names = stage(named.join(least, "component").select("print", "component_id"), "simhash-names")
    return rows.join(names, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
