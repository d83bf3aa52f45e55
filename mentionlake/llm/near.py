"""Near-duplicates by SetSketch registers, likelihood estimates and exact checks.

A document is the set of its five-word shingles. Documents with equal sets form a class;
everything below works on classes.

* A SetSketch (Ertl, VLDB 2021) has ``REGISTERS`` registers. Each shingle throws points of
  a Poisson process at them; a register keeps its least point, on an exponential scale.
  Points beyond what fills all registers of a set of that size are not generated.
* Five registers make a band, or fewer below 0.85; classes that agree in a band share a bucket. At the
  similarity wanted a pair misses all bands with a chance below one in a million.
* Each member of a bucket is paired with one centre of it: rows stay linear. The share of
  equal, larger and smaller registers gives the likelihood of every similarity; pairs for
  which the wanted one is out of reach are dropped, the rest verified on full sets.
* Links make components. Buckets whose members are still in different components are
  compared in blocks, on sketches: members of the bucket's largest component are dealt
  into parts, all others, the outsiders, meet every part and each other, so that rows are
  members + outsiders x parts. Only members with a plausible partner in another component
  then meet with their full sets, and each block reports the verified links that join
  components, not all pairs.

So every link that shares a bucket is either verified or runs inside one component.

Edge cases: texts without words have an empty set and are linked with nothing; fewer than
five words make one shingle; equal rows are one class; rows that share a doc_id but not
their text are linked only as their texts are. Rows without a doc_id are linked like any
other and named after the smallest id reachable; a component without any id has a null
name, all its rows have ``kept``, and ``without_near_duplicates`` leaves one of them.
Columns other than doc_id and text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionlake.llm.arrays import distinct_pairs, mix, shingles, slices, split_words
from mentionlake.llm.components import components
from mentionlake.llm.tables import documents, texts_of, unused
from mentionlake.staging import stage

PERCENT = 85
REGISTERS = 120
BASE = 1.1
# Chance that a pair at the wanted similarity shares no band
MISS = 1e-6
_SHIFT = 26
# A pair stays if the wanted similarity is at most e^12 times less likely than the best.
SLACK = 12.0
BLOCK = 1024
# Pairs of members looked at together
PAIRS = 1 << 16


def band_rows(percent: int) -> int:
    """Registers per band: the most by which a pair of equal sizes at ``percent`` is missed
    with a chance below ``MISS``."""
    equal = 1 + 2 * np.log1p(-(1 - percent / 100) / 2 * (BASE - 1) / BASE) / np.log(BASE)
    fit = [r for r in (5, 4, 3, 2) if (1 - equal**r) ** (REGISTERS // r) < MISS]
    return fit[0] if fit else 1


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle) without repeats, sorted, and the offsets of each text."""
    rows, values = distinct_pairs(*shingles(split_words(texts, lower=True)))
    return rows, values, np.searchsorted(rows, np.arange(len(texts) + 1))


def class_of(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, the same for equal sets."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(values ^ np.uint64(0x5DEECE66D)))])
    sizes = np.diff(offsets).astype(np.uint64)
    with np.errstate(over="ignore"):
        return mix((total[offsets[1:]] - total[offsets[:-1]]) ^ mix(sizes)).view(np.int64)


def sketch(rows: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One row of registers per text; a text without shingles has zeros."""
    least = np.full(len(sizes) * REGISTERS, np.inf)
    limit = (np.log(REGISTERS) + 6) / np.maximum(sizes, 1)
    owner, state, time = rows, values, np.zeros(len(rows))
    with np.errstate(over="ignore"):
        while len(owner):
            state = mix(state + np.uint64(0x9E3779B97F4A7C15))
            time = time - np.log(((state >> np.uint64(11)).astype(float) + 1) * 2.0**-53) / REGISTERS
            live = time <= limit[owner]
            owner, state, time = owner[live], state[live], time[live]
            register = ((mix(state ^ np.uint64(0xD1B54A32D192ED03)) >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
            np.minimum.at(least, owner * REGISTERS + register.astype(np.int64), time)
    filled = np.isfinite(least)
    steps = np.zeros(len(least))
    steps[filled] = np.floor(_SHIFT - np.log(least[filled]) / np.log(BASE))
    return np.clip(steps, 0, 255).astype(np.uint8).reshape(len(sizes), REGISTERS)


def _flat(values: np.ndarray, width: int) -> pa.Array:
    return pa.array([row.tobytes() for row in values.reshape(-1, width)], pa.binary())


def sketched(docs: DataFrame) -> DataFrame:
    """(row_key, doc_id, class, n_shingles, sketch) of every row; ``row_key`` stands for the
    row's id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows, values, offsets = shingle_sets(part.column("text"))
                sizes = np.diff(offsets)
                yield pa.RecordBatch.from_arrays([
                    part.column("row_key"), part.column("doc_id"), pa.array(class_of(values, offsets)),
                    pa.array(sizes, pa.int64()), _flat(sketch(rows, values, sizes), REGISTERS),
                ], ["row_key", "doc_id", "class", "n_shingles", "sketch"])

    keyed = texts_of(docs).withColumn("row_key", _row_key())
    return keyed.mapInArrow(run, "row_key long, doc_id long, class long, n_shingles long, sketch binary")


def _row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def full_sets(docs: DataFrame) -> DataFrame:
    """(class, full): the sorted shingles of every row, eight bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                _, values, offsets = shingle_sets(part.column("text"))
                full = [values[a:b].tobytes() for a, b in zip(offsets, offsets[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(class_of(values, offsets)), pa.array(full, pa.binary())], ["class", "full"])

    return docs.mapInArrow(run, "class long, full binary")


def plausible(more: np.ndarray, less: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether a similarity of ``percent`` or more is within reach, given how many of a's
    registers are larger and smaller than b's, and both sizes (known exactly)."""
    want = percent / 100
    u = na / (na + nb)
    top = np.minimum(u / (1 - u), (1 - u) / u)  # two sets of these sizes can't be more alike

    def likelihood(j: np.ndarray) -> np.ndarray:
        def share(x: np.ndarray) -> np.ndarray:
            return np.clip(-np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE), 1e-9, 1 - 1e-9)

        p, q = share(u - (1 - u) * j), share((1 - u) - u * j)
        same = REGISTERS - more - less
        return more * np.log(p) + less * np.log(q) + same * np.log(np.maximum(1 - p - q, 1e-9))

    near = np.maximum.reduce([likelihood(np.minimum(want + (1 - want) * t, top)) for t in np.linspace(0, 1, 8)])
    far = np.maximum.reduce([likelihood(np.minimum(want * t, top)) for t in np.linspace(0, 1, 25)])
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (near >= far - SLACK)


@lru_cache(maxsize=4)
def least_equal(percent: int) -> int:
    """Fewer equal registers than this make no pair plausible, whatever its sizes.

    The fewest over all numbers of larger and smaller registers, at size ratios up to the
    widest that counts, where they are fewest; less some for the ratios between.
    """
    more, less = (x.ravel() for x in np.indices((REGISTERS + 1, REGISTERS + 1)))
    more, less = more[some := more + less <= REGISTERS], less[some]
    fewest = REGISTERS
    for ratio in np.linspace(percent / 100, 1, 9):
        good = plausible(more, less, np.full(len(more), 1e6), np.full(len(more), np.ceil(1e6 * ratio)), percent)
        fewest = min(fewest, int((REGISTERS - more - less)[good].min(initial=REGISTERS)))
    return max(0, fewest - 6)


def _equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of equal registers of each two rows, eight added at a time."""
    eights = (a == b).view(np.uint64).sum(1)
    with np.errstate(over="ignore"):
        return ((eights * np.uint64(0x0101010101010101)) >> np.uint64(56)).astype(np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _likely_pairs(pairs: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of rows with both sketches and sizes that stay plausible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _matrix(batch.column("sketch_a"), REGISTERS), _matrix(batch.column("sketch_b"), REGISTERS)
            na, nb = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
            good = plausible((a > b).sum(1), (a < b).sum(1), na, nb, percent)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return pairs.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [
                _alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                for x, y in zip(batch.column("full_a").to_pylist(), batch.column("full_b").to_pylist())
            ]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def _apart(blocks: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Plausible pairs of rows of one block whose ends are in different components, each in the
    first band that it shares. ``blocks`` has whole blocks, the rows of each one together. A
    block holds one or two parts of a bucket; pairs of one part are found in the block of that
    part alone."""
    names, groups = blocks.column("class").to_numpy(), blocks.column("component").to_numpy()
    sizes, parts, band = blocks.column("n").to_numpy().astype(float), blocks.column("part").to_numpy(), blocks.column("band").to_numpy()
    marks = _matrix(blocks.column("sketch").combine_chunks(), REGISTERS)
    alone = blocks.column("i").to_numpy() == blocks.column("j").to_numpy()
    later = _block_ends(blocks) - np.arange(len(names)) - 1  # rows of its block behind each row
    upto = np.concatenate([[0], np.cumsum(later)])
    found, rows, enough = [], band_rows(percent), least_equal(percent)
    start = 0
    while start < len(names):
        end = max(start + 1, int(np.searchsorted(upto, upto[start] + PAIRS, "right")) - 1)
        x = np.repeat(np.arange(start, end), later[start:end])
        y = x + 1 + np.arange(len(x)) - (upto[x] - upto[start])
        # what a look at sizes or a count of equal registers rules out is most of a large bucket
        keep = (groups[x] != groups[y]) & (names[x] != names[y]) & (alone[x] | (parts[x] != parts[y]))
        keep &= 100 * np.minimum(sizes[x], sizes[y]) >= percent * np.maximum(sizes[x], sizes[y])
        x, y = x[keep], y[keep]
        near = _equal(marks[x], marks[y]) >= enough
        x, y = x[near], y[near]
        turn = np.where(alone[x], names[x] > names[y], parts[x] > parts[y])
        x, y = np.where(turn, y, x), np.where(turn, x, y)
        good = plausible((marks[x] > marks[y]).sum(1), (marks[x] < marks[y]).sum(1), sizes[x], sizes[y], percent)
        x, y = x[good], y[good]
        first = (marks[x] == marks[y]).reshape(-1, REGISTERS // rows, rows).all(2).argmax(1)
        found += zip(x[first == band[x]].tolist(), y[first == band[x]].tolist())
        start = end
    return found


def _block_ends(blocks: pa.Table) -> np.ndarray:
    """For each row the end of its block, a run of equal key, i and j."""
    n = blocks.num_rows
    change = np.zeros(n - 1, bool) if n else np.zeros(0, bool)
    for column in ("key", "i", "j"):
        value = blocks.column(column).to_numpy()
        change |= value[1:] != value[:-1]
    ends = np.append(np.flatnonzero(change) + 1, n)
    return np.repeat(ends, np.diff(ends, prepend=0)) if n else np.zeros(0, np.int64)


def _members_apart(blocks: DataFrame, percent: int) -> DataFrame:
    """The members with a partner in ``_apart``. Most buckets have a few members only, so blocks
    come one behind another, many in a batch, and not each as a group of its own."""

    def members(whole: pa.Table) -> list[pa.RecordBatch]:
        index = sorted({i for pair in _apart(whole, percent) for i in pair})
        return whole.take(pa.array(index, pa.int64())).select(["key", "band", "i", "j", "part", "class"]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch]).combine_chunks()
            ends = _block_ends(table)
            last = int(ends[ends < table.num_rows].max(initial=0))  # the last block may go on in the next batch
            yield from members(table.slice(0, last))
            held = table.slice(last).to_batches()
        if held:
            yield from members(pa.Table.from_batches(held))

    order = ["key", "i", "j"]
    dealt = blocks.repartition(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, "key long, band int, i int, j int, part int, class long")


def _joining_links(blocks: DataFrame, percent: int) -> DataFrame:
    """Verified links of each block that join components, without those that add nothing."""

    def run(block: pa.Table) -> pa.Table:
        groups = dict(enumerate(block.column("component").to_pylist()))
        names, full = block.column("class").to_pylist(), block.column("full")
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        links = []
        for x, y in _apart(block, percent):
            a, b = find(groups[x]), find(groups[y])
            if a != b and _alike(*(np.frombuffer(full[k].as_py(), np.uint64) for k in (x, y)), percent):
                root[max(a, b)] = min(a, b)
                links.append((names[x], names[y]))
        return pa.table({"a": pa.array([p[0] for p in links], pa.int64()), "b": pa.array([p[1] for p in links], pa.int64())})

    return blocks.groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``.

    Links join documents with 100 * common >= percent * union of their shingles.
    """
    return _decided(docs, percent).drop("row_key", "group")


def _decided(docs: DataFrame, percent: int) -> DataFrame:
    """The rows of ``near_duplicates`` with their ``row_key`` and the ``group`` they are in."""
    rows = stage(sketched(docs), "near-rows")
    some = rows.filter("n_shingles > 0")
    first = some.groupBy("class").agg(F.min("doc_id").alias("first_doc"))
    classes = stage(
        some.join(first, "class").filter(F.col("doc_id").eqNullSafe(F.col("first_doc")))
        .dropDuplicates(["class"]).select("class", "row_key", "first_doc", F.col("n_shingles").alias("n"), "sketch"),
        "near-classes",
    )
    width = band_rows(percent)
    keys = [
        F.struct(F.lit(b).alias("band"), F.xxhash64(F.lit(b), F.substring("sketch", b * width + 1, width)).alias("key"))
        for b in range(REGISTERS // width)
    ]
    bands = classes.select("class", F.inline(F.array(*keys)))
    buckets = bands.groupBy("key").agg(F.count("*").alias("members"), F.min("class").alias("centre")).filter("members > 1")
    shared = stage(bands.join(buckets, "key"), "near-buckets")

    marks = classes.select("class", "n", "sketch")

    def end(side: str) -> DataFrame:
        return marks.select(F.col("class").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}"))

    stars = shared.filter("class <> centre").select(F.col("class").alias("a"), F.col("centre").alias("b")).distinct()
    likely = stage(_likely_pairs(stars.join(end("b"), "b").join(end("a"), "a"), percent), "near-pairs")

    wanted = shared.select("class").distinct().join(classes.select("class", "row_key"), "class").select("row_key")
    texts = texts_of(docs).withColumn("row_key", _row_key()).join(stage(wanted, "near-wanted").hint("merge"), "row_key", "left_semi")
    sets = stage(full_sets(texts.select("text")), "near-sets")
    a, b = (sets.select(F.col("class").alias(x), F.col("full").alias(f"full_{x}")) for x in "ab")
    links = stage(_verified(likely.join(b, "b").join(a, "a"), percent).distinct(), "near-links")

    grouped = stage(components(links), "near-components").select(F.col("node").alias("class"), "component")
    more = stage(_links_between(shared, grouped, marks, sets, percent), "near-links")
    if not more.isEmpty():
        both = grouped.select(F.col("class").alias("a"), F.col("component").alias("b")).unionByName(more)
        grouped = stage(components(both), "near-components").select(F.col("node").alias("class"), "component")

    named = classes.select("class", "first_doc").join(grouped, "class")
    least = named.groupBy("component").agg(F.min("first_doc").alias("least"))
    names = named.join(least, "component").select("class", "component", "least")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("least", "first_doc")).otherwise(F.col("doc_id"))
    return (
        rows.join(classes.select("class", "first_doc").join(names, "class", "left"), "class", "left")
        .select("row_key", F.coalesce("component", "class").alias("group"), "doc_id", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def _blocks(members: DataFrame) -> DataFrame:
    """(key, band, i, j, part, class, component): inner parts hold the largest component of a
    bucket and meet outer parts only; outer parts meet all parts, themselves included."""
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(
        F.sum("n").alias("members"), F.max("n").alias("most"), F.max_by("component", F.struct("n", "component")).alias("largest"),
    ).filter("members > most").select(
        "key", "largest", F.ceil(F.col("most") / BLOCK).cast("int").alias("inner"),
        F.ceil((F.col("members") - F.col("most")) / BLOCK).cast("int").alias("outer"),
    )
    inside, deal, every = F.col("component") == F.col("largest"), F.xxhash64("class"), F.col("inner") + F.col("outer")
    part = F.when(inside, F.pmod(deal, F.col("inner"))).otherwise(F.col("inner") + F.pmod(deal, F.col("outer"))).cast("int")
    other = F.when(inside, F.sequence("inner", every - 1)).otherwise(F.sequence(F.lit(0), every - 1))
    dealt = members.join(mixed, "key").withColumn("part", part).withColumn("other", F.explode(other))
    return dealt.select(
        "key", "band", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "class", "component"
    )


def _links_between(shared: DataFrame, grouped: DataFrame, marks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of one bucket that the stars left in different components."""
    members = stage(
        shared.select("key", "band", "class").join(grouped, "class", "left")
        .withColumn("component", F.coalesce("component", "class")), "near-members",
    )
    blocks = _blocks(members)
    apart = stage(_members_apart(blocks.join(marks, "class"), percent), "near-apart")
    return _joining_links(
        apart.join(grouped, "class", "left").withColumn("component", F.coalesce("component", "class"))
        .join(marks, "class").join(sets, "class"), percent,
    )


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def without_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, of one document of each component.

    Repeated rows of one document are one document: they stay once.
    """
    decided = stage(_decided(docs, percent).select("row_key", "group", "component_id", "n_shingles", "kept"), "near-decided")
    # components without any id: the row of the least key stays
    nameless = decided.filter("kept AND component_id IS NULL AND n_shingles > 0").select("group", "row_key").distinct()
    chosen = nameless.groupBy("group").agg(F.min("row_key").alias("chosen"))
    others = nameless.join(chosen, "group").filter("row_key <> chosen").select("row_key")
    # the dropped rows are the fewer ones to look up; they grow with the documents, so the
    # plan is the same at every size
    key = unused(docs, "row_key")
    dropped = decided.filter("NOT kept").select("row_key").unionByName(others).select(F.col("row_key").alias(key))
    left = docs.withColumn(key, _row_key()).join(stage(dropped.distinct(), "near-dropped").hint("merge"), key, "left_anti")
    repeated = decided.filter("kept").groupBy("row_key").count().filter("count > 1")
    return (left if repeated.isEmpty() else left.dropDuplicates([key])).select(*docs.columns)
