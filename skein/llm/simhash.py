"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has 64 bits; each bit is the majority of that bit over the
XXH64 values of a text's word shingles, repeats included. Two fingerprints
that differ in at most ``max_bits`` bits agree wholly in two of
``max_bits + 2`` blocks, so equal pairs of blocks are the join keys and the
Hamming distance is verified after the join. Only distinct fingerprints are
joined: copies, however many, are one node.

A block that more than ``BUCKET`` fingerprints share is not joined (that would
emit all pairs of the bucket) but split again: its members differ only in
their other bits, which are cut into ``max_bits + 2`` blocks in turn, and so on
until buckets are small or at most ``max_bits`` bits are left, when all members
are links of each other and a star joins them. No pair within the distance is
lost and no bucket emits more than ``BUCKET`` rows per member. Components come
from alternating large and small stars, with a checkpoint in the shared folder
after each round.

``near_copies`` serves corpora whose near copies differ in more than a few bits
of one fingerprint: what the blocks link comes first, then an exact join of
five-word shingle sets by the prefix filter, common shingles last. Parity
fingerprints, whose Hamming distance never exceeds the difference of two sets,
rule out most pairs; the similarity of whole texts is verified for the others.

Edge cases: null and empty texts have fingerprint zero and link like any other;
fewer words than a shingle: the whole sequence is the one shingle; component_id
is the smallest doc_id reachable, null ids being larger than any; an empty table
gives an empty result; repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import LOWER_BYTES, Tables, bounded_batches, cut, few, fresh, stored, table

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
BUCKET = 24
BITS = 64
#: Row v holds the eight bits of byte v, lowest first.
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(parts: list[bytes], words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of ``words`` parts, joined by blanks; of all parts where they are fewer."""
    import xxhash

    flat = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(flat, seed)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate([[0], ends[: len(parts) - words]]).tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    return np.fromiter((digest(flat[s:e], seed) for s, e in zip(starts, stops, strict=True)), np.uint64, len(stops))


def majority(h: np.ndarray) -> int:
    """Each bit that is set in over half of ``h``."""
    octets = np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int(((2 * counts > len(h)).astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum())


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The fingerprint of one text as an unsigned integer."""
    parts = _words(text)
    return majority(shingle_hashes(parts, words, seed)) if parts else 0


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, keep: list[str] | None = None) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long)."""
    bounded_batches(docs.sparkSession)
    cols = keep or ["doc_id"]
    schema = T.StructType([*docs.select(*cols).schema.fields, T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(len(cols))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(cols))), pa.array(fps)], names=schema.names)

    return docs.select(*cols, F.col("text").cast("string").alias(fresh(docs, "_text"))).mapInArrow(run, schema)


def child_masks(mask: int, max_bits: int) -> list[int]:
    """``mask`` joined with blocks of the bits that are not in it (signed).

    The free bits are cut into ``max_bits + 2`` blocks, or fewer where bits are
    few. Two values that differ in at most ``max_bits`` bits agree in all but
    ``max_bits`` of them, so each choice of that many blocks is a key.
    """
    free = np.array([b for b in range(BITS) if not mask >> b & 1], dtype=np.int64)
    blocks = np.array_split(free, min(max_bits + 2, len(free)))
    out = []
    for chosen in combinations(blocks, len(blocks) - max_bits):
        m = (mask | sum(1 << int(b) for block in chosen for b in block)) & (2**64 - 1)
        out.append(m - (1 << 64) if m >= 1 << 63 else m)
    return out


def keyed_blocks(buckets: DataFrame, max_bits: int) -> DataFrame:
    """``buckets(space, fp, mask)`` -> a row per block: space, fp, mask (the bits a bucket shares) and key (their values)."""
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("space", "fp", "mask", "key")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            space, fp, mask = (batch.column(i).to_numpy() for i in range(3))
            spaces, fps, masks = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for m in np.unique(mask):
                here = mask == m
                for child in child_masks(int(m), max_bits):
                    spaces.append(space[here])
                    fps.append(fp[here])
                    masks.append(np.full(int(here.sum()), child, dtype=np.int64))
            s, f, k = map(np.concatenate, (spaces, fps, masks))
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(f), pa.array(k), pa.array(f & k)], names=schema.names)

    return buckets.select("space", "fp", "mask").mapInArrow(run, schema)


def _none_agrees(differ: Column, masks: list[int]) -> Column:
    """Whether the bits of every one of ``masks`` hold a difference."""
    out = F.lit(True)
    for m in masks:
        out = out & (differ.bitwiseAND(F.lit(m).cast("long")) != 0)
    return out


def links(nodes: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """Pairs (space, a, b), a < b, that connect all ``nodes(fp)`` within ``max_bits``.

    With a column ``space`` (a long) only nodes of one space are compared.
    """
    own = F.col("space").cast("long") if "space" in nodes.columns else F.lit(0).cast("long").alias("space")
    left = nodes.select(own, "fp").distinct().withColumn("mask", F.lit(0).cast("long"))
    block = ["space", "mask", "key"]
    tables = child_masks(0, max_bits)
    found: DataFrame | None = None
    while True:
        first = found is None
        keyed = cut(keyed_blocks(left, max_bits) if first else keyed_blocks(left, max_bits).distinct())
        sizes = cut(keyed.groupBy(*block).agg(F.count("*").alias("n"), F.min("fp").alias("least")).where("n > 1"))
        small = keyed.join(sizes.where(F.col("n") <= bucket).select(*block), block)
        members = small.groupBy(*block).agg(F.collect_list("fp").alias("fps"))  # at most `bucket`

        def close(a: Column, b: Column, first: bool = first) -> Column:
            differ = a.bitwiseXOR(b)
            here = (a < b) & (F.bit_count(differ) <= max_bits)
            if first:  # a link is found in the first of the tables whose bits agree
                for k, m in enumerate(tables):
                    here = here & ((F.col("mask") != m) | _none_agrees(differ, tables[:k]))
            return here

        # only verified links become rows
        met = F.transform("fps", lambda a: F.transform(F.filter("fps", lambda b: close(a, b)), lambda b: F.struct(a.alias("a"), b.alias("b"))))
        pairs = members.select("space", F.explode(F.flatten(met)).alias("p")).select("space", "p.a", "p.b")
        # all members of a bucket whose free bits are max_bits or fewer are links: a star is enough
        big = sizes.where(F.col("n") > bucket)
        tight = BITS - F.bit_count("mask") <= max_bits
        star = keyed.join(big.where(tight).select(*block, "least"), block)
        pairs = cut(pairs.union(star.select("space", F.col("least").alias("a"), F.col("fp").alias("b")).where("a < b")).distinct())
        found = pairs if found is None else found.union(pairs)
        left = cut(keyed.join(big.where(~tight).select(*block), block).select("space", "fp", "mask").distinct())
        if left.isEmpty():
            return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> (node, root): the smallest node of each node's component.

    Large star: every larger neighbour of a node is linked to the node's
    smallest neighbour; small star: the node and its smaller neighbours are.
    Both keep connectivity; the edge set becomes one star per component.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = e.union(e.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = cut(small.where("u <> v").distinct())
        n, total = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, total) == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = (n, total)


def cluster(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``fps(doc_id, fp, ...)`` -> the same rows with ``component_id``."""
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    stars = components(links(nodes.select("fp"), max_bits).select("a", "b"))
    rooted = nodes.join(stars.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    return fps.join(named, "fp")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_dedup(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint, component_id."""
    fps = cut(fingerprints(docs, words))
    return cluster(fps, max_bits).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


# ------------------------------------------------------------ near copies of a corpus

SIMILAR_WORDS = 5
SIMILAR = 0.8
#: Which shingles come last in the order of prefixes. Any order gives the same links, so a sample of texts
#: (one in ``SAMPLE``) may say which are common; ``MAX_COMMON`` bounds what a task holds.
SAMPLE = 16
COMMON_TEXTS = 4
MAX_COMMON = 1 << 18
#: Pairs that one text is compared with in a row of a task.
COMPARED = 64
LEAST_PARITY_BITS = 256


def shingle_set(text: str | None) -> np.ndarray:
    """The different five-word shingles of a text as sorted hashes; none without words."""
    parts = _words(text)
    return np.unique(shingle_hashes(parts, SIMILAR_WORDS)) if parts else np.zeros(0, np.uint64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two shingle sets have a Jaccard similarity of 0.8 or more; two empty ones have."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def parity(shingles: np.ndarray) -> bytes:
    """A fingerprint of a set: bit k is the parity of the shingles that fall on it. Two bits a shingle or more."""
    size = LEAST_PARITY_BITS
    while size < 2 * len(shingles):
        size *= 2
    on = np.bincount(((shingles >> np.uint64(20)) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(on.astype(np.uint8), bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """The Hamming distance of two parity fingerprints, the longer one folded: no more than the shingles that one set has alone."""
    if len(x) < len(y):
        x, y = y, x
    a, size = int.from_bytes(x, "little"), 8 * len(x)
    while size > 8 * len(y):
        size //= 2
        a = (a >> size) ^ (a & ((1 << size) - 1))
    return (a ^ int.from_bytes(y, "little")).bit_count()


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that occur in ``COMMON_TEXTS`` or more of a sample of the texts, sorted, and the texts they are in; the most frequent where they are too many."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py()).view(np.int64))], names=["token"])

    text = F.col("text").cast("string")
    found = docs.select(text.alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).mapInArrow(run, "token long")
    top = found.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON_TEXTS).orderBy(F.col("n").desc(), "token").limit(MAX_COMMON)
    top = top.toPandas().sort_values("token")  # at most MAX_COMMON
    return top["token"].to_numpy(np.int64), top["n"].to_numpy(np.int64)


def prefix(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first fifth (and one) of a shingle set, as signed longs, in the order of all shingles: others first, then ``common`` ones by their frequency.

    Sets of a similarity of 0.8 share four fifths of the larger one or more, so
    such prefixes have a shingle in common.
    """
    s = np.sort(shingles.view(np.int64))
    tokens, often = common
    if len(tokens) and len(s):
        at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
        rank = np.where(tokens[at] == s, often[at], 0)
        s = s[np.lexsort((s, rank))]
    return s[: len(s) // 5 + 1]


def prefixes(docs: DataFrame, keep: list[str], common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The ``keep`` columns, node (names the shingle set), n (its size), fp (its SimHash), bits (its parity) and prefix."""
    import xxhash

    bounded_batches(docs.sparkSession)
    more = [T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("bits", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType()))]
    schema = T.StructType([*docs.select(*keep).schema.fields, *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py()) for t in batch.column(len(keep))]
            names = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64).view(np.int64)
            fps = np.array([majority(s) for s in sets], dtype=np.uint64).view(np.int64)
            made = [pa.array(names), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps), pa.array([parity(s) for s in sets], pa.binary()), pa.array([prefix(s, common) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *made], names=schema.names)

    return docs.select(*keep, F.col("text").cast("string").alias(fresh(docs, "_text"))).mapInArrow(run, schema)


def _may_be_alike(x: Column, y: Column) -> Column:
    """Whether sets whose first common shingle this is can have a similarity of 0.8: ``rest`` shingles stand from it on."""
    return 9 * F.least(x["rest"], y["rest"]) >= 4 * (x["n"] + y["n"])


def plausible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs(a, b)`` without those that their sizes and parity fingerprints rule out (``sets(node, n, bits)``).

    Sets of a similarity of 0.8 differ in a ninth of their joint size at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, x, y = (batch.column(i).to_pylist() for i in range(2, 5))
            yield batch.select([0, 1]).filter(pa.array([9 * least_difference(p, q) <= n for n, p, q in zip(total, x, y, strict=True)], pa.bool_()))

    both = pairs.join(sets.toDF("a", "na", "xa"), "a").join(sets.toDF("b", "nb", "xb"), "b")
    sized = both.where((5 * F.col("na") >= 4 * F.col("nb")) & (5 * F.col("nb") >= 4 * F.col("na")))
    return sized.select("a", "b", (F.col("na") + F.col("nb")).alias("n"), "xa", "xb").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` whose whole texts are alike; ``sets(node, place)``, ``texts(place, text)``.

    Each b meets its partners in runs of ``COMPARED`` or so, so a text that has
    very many of them is compared in many tasks.
    """
    runs = pairs.groupBy("b").agg(F.ceil(F.count("*") / COMPARED).alias("runs"))
    dealt = pairs.join(runs, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("runs")).alias("run"))
    sides = dealt.select(F.col("a").alias("node"), "b", "run").union(dealt.select(F.col("b").alias("node"), "b", "run").distinct())
    placed = cut(sides.join(sets.select("node", "place"), "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known = None, np.zeros(0, np.uint64)
        for batch in batches:
            found = []
            for b, r, a, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if a == b:  # the first of its run
                    at, known = (b, r), shingle_set(text.as_py())
                    continue
                assert at == (b, r)
                if alike(shingle_set(text.as_py()), known):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    held = texts.join(few(placed), "place").select("b", "run", "node", "text")
    met = held.repartition("b", "run").sortWithinPartitions("b", "run", F.col("node") != F.col("b"), "node")
    return cut(met.mapInArrow(run, "a long, b long"))


def near_copies(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of every row and ``component``: equal for near copies (five-word similarity of 0.8 or more).

    Nodes are the different shingle sets. SimHashes that pigeonhole blocks link
    are candidates. They miss pairs whose fingerprints are further apart, so an
    exact join follows: two sets of that similarity have a shingle in common in
    their prefixes. The members of such a shingle are compared with the one that
    has it earliest; what the links leave apart, all members outside of the
    shingle's largest component, is compared with all others. Sizes, places and
    parity fingerprints rule out pairs that cannot be alike, whole texts decide
    about the others, and no pair is left out: components are exact. Texts are
    found again by their place in the scan of a stored table.

    A shingle that very many different texts have in their prefixes costs their
    number squared in checks of size and place (rows come of those that pass
    only): texts whose shingles are all common ones, of which the rarest come first.
    """
    spark, docs = docs.sparkSession, stored(docs)
    place = fresh(docs, "_place")
    docs = docs.withColumn(place, F.monotonically_increasing_id())
    texts = docs.select(F.col(place).alias("place"), F.col("text").cast("string").alias("text"))
    with Tables(spark) as tables:
        rows = tables.keep(prefixes(docs, [*keep, place], common_shingles(docs)))
        first = rows.groupBy("node").agg(F.min(place).alias(place))
        nodes = rows.select("node", "n", "fp", "bits", "prefix", place).join(first, ["node", place], "left_semi")
        nodes = tables.keep(nodes.withColumnRenamed(place, "place"))
        sets, where = nodes.select("node", "n", "bits"), nodes.select("node", "place")
        keyed = nodes.select("node", "n", F.posexplode("prefix").alias("at", "token")).select("token", "node", "n", (F.col("n") - F.col("at")).alias("rest"))
        # at equal places the lower bits of the node decide, so that a family's shingles name one chief
        order = F.shiftleft(F.least("at", F.lit(1 << 22)).cast("long"), 40).bitwiseOR(F.col("node").bitwiseAND(F.lit((1 << 40) - 1)))
        chiefs = nodes.select("node", F.posexplode("prefix").alias("at", "token")).groupBy("token").agg(F.count("*").alias("size"), F.min_by("node", order).alias("chief")).where("size > 1")
        shared = tables.keep(keyed.join(chiefs.select("token", "chief"), "token"))
        star = shared.where("node <> chief").select(F.col("node").alias("a"), F.col("chief").alias("b"))
        least = nodes.groupBy("fp").agg(F.min("node").alias("chief"))
        same = nodes.join(least, "fp").where("node <> chief").select(F.col("node").alias("a"), F.col("chief").alias("b"))
        near = links(least.select("fp")).select(F.col("a").alias("fa"), F.col("b").alias("fb"))
        near = near.join(least.toDF("fa", "a"), "fa").join(least.toDF("fb", "b"), "fb").select("a", "b")
        tested = cut(star.union(same).union(near).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        met = verified(cut(plausible(tested, sets)), where, texts)
        stars = components(met)
        # each member of a shingle outside of its largest component against all members of others
        rooted = shared.join(stars.withColumnRenamed("root", "star"), "node", "left").select("token", "node", "n", "rest", F.coalesce("star", "node").alias("root"))
        largest = rooted.groupBy("token", "root").agg(F.count("*").alias("k")).groupBy("token").agg(F.max_by("root", "k").alias("most"), F.count("*").alias("roots")).where("roots > 1")
        apart = tables.keep(rooted.join(largest.select("token", "most"), "token"))
        m = F.struct("node", "n", "rest")
        x = apart.where("root <> most").select("token", m.alias("x"), F.col("root").alias("rx"))
        y = apart.select("token", m.alias("y"), F.col("root").alias("ry"), "most")
        once = (F.col("ry") == F.col("most")) | (F.col("x.node") < F.col("y.node"))
        across = x.join(y, "token").where((F.col("rx") != F.col("ry")) & once & _may_be_alike(F.col("x"), F.col("y")))
        across = across.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
        more = verified(cut(plausible(across, sets)), where, texts)
        if not more.isEmpty():
            stars = components(met.union(more))
        return cut(rows.select(*keep, "node").join(stars, "node", "left").select(*keep, F.coalesce("root", "node").alias("component")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of near copies, the one with the smallest doc_id.

    Of rows with that same id the first of the scan stays. Rows are matched by
    their place in the scan of a stored table.
    """
    docs = stored(docs)
    row = fresh(docs, "_row")
    marked = docs.withColumn(row, F.monotonically_increasing_id())
    named = near_copies(marked.select("doc_id", F.col(row).alias("row"), "text"), ["doc_id", "row"])
    # stored, so that Spark can split the rows of a large component in the join
    first = cut(named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"), F.count("*").alias("rows")).where("rows > 1"))
    gone = cut(named.join(first, "component").where("row <> first.row").select(F.col("row").alias(row)))
    return marked.join(few(gone), row, "left_anti").select(*docs.columns)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))
