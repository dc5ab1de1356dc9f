"""Near-duplicate join: MinHash LSH forest, then exact Jaccard similarity of five-word shingles.

Each text has one label per tree, a sequence of minima. The labels of all texts, one row per text and tree, are sorted,
so that a tree's rows stand in the order of its trie, and a walk along them finds how long a prefix each row shares with
a neighbour; rows that share less than the shortest prefix meet nobody and go. The shortest prefix is the first at which
texts at the threshold meet in some tree with the target recall.

Prefixes are then shortened level by level. At each depth a text is compared with the hub of its node, but only where
it shares that much with another text and isn't yet in the hub's class, so a large group of similar texts costs about one
comparison per text, and only texts without a match go on with shorter prefixes. At the last depth, texts of different
classes that share a node are compared where they can reach the threshold: one of their rarest shingles must be shared.
So no link between different texts is lost that the forest has found, while texts that merely hold the same common
passage are not paired. When the classes are known, the links of each text are counted over all texts of its class, block
by block.

Identical texts are one node of the graph, told by a 64-bit hash. Only candidates' texts are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.llm.common import Rolling, batched, materialise, mix

WORDS = 5
THRESHOLD = 0.8
TREES = 32
DEPTH = 8
RECALL = 0.99999
BLOCK = 1_000_000  # bytes whose shingles are found at once
COUNTED = 1 << 20  # hash buckets in which shingles are counted to put the rare ones first
MEMBERS = 512  # texts of a class in a block whose links are counted at once
MEMBER_BYTES = 4_000_000  # and their bytes
COLUMNS = 8192  # shingles of a block in one product of matrices
NO_ID = -(1 << 63)


def depths(trees: int = TREES, depth: int = DEPTH, threshold: float = THRESHOLD, recall: float = RECALL) -> list[int]:
    """From the full depth down to the first at which texts at the threshold meet with the target probability."""
    out = [depth]
    while out[-1] > 1 and 1 - (1 - threshold ** out[-1]) ** trees < recall:
        out.append(out[-1] - 1)
    return out


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the word shingles of all texts, one after another, and how many each has.

    Words are cut at ASCII white space. Shorter texts are one shingle; texts without a word have none.
    """
    words = [t.split() for t in texts]
    sizes = np.array([len(w) for w in words])
    joined = b" ".join(b" ".join(w) for w in words if w)
    data = np.frombuffer(joined, np.uint8)
    ends = np.append(np.flatnonzero(data == 32), len(data))[:sizes.sum()]
    starts = np.concatenate([[0], ends[:-1] + 1])[:len(ends)]
    counts = np.where(sizes >= WORDS, sizes - WORDS + 1, np.minimum(sizes, 1))
    before = np.repeat(np.cumsum(sizes) - sizes, counts)
    first = before + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    last = first + np.repeat(np.minimum(sizes, WORDS), counts) - 1
    if not len(first):
        return np.zeros(0, np.uint64), counts
    return Rolling(data).of(starts[first], ends[last]), counts


def labels(hashes: np.ndarray, counts: np.ndarray, base: int, trees: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Text x tree: a hash of the first ``base`` minima, and the further minima packed in order; texts without shingles left out.

    Ordered by both, the rows of a tree stand in the order of its trie below ``base``.
    """
    starts = (np.cumsum(counts) - counts)[counts > 0]
    factors = np.random.default_rng(11).integers(1, 1 << 63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    short, tail = (np.zeros((len(starts), trees), np.uint64) for _ in range(2))
    bits = np.uint64(tail_bits(base, depth))
    for tree in range(trees):
        short[:, tree] = tree + 1
        for level in range(depth):
            least = np.minimum.reduceat(hashes * factors[tree * depth + level], starts)
            if level < base:
                short[:, tree] = mix(short[:, tree] * np.uint64(31) + least)
            else:
                tail[:, tree] = (tail[:, tree] << bits) | (mix(least) >> (np.uint64(64) - bits))
    return short, tail


def tail_bits(base: int, depth: int) -> int:
    """Bits of each minimum below the shortest prefix."""
    return 63 // max(1, depth - base)


def signatures(docs: DataFrame, trees: int, depth: int, base: int) -> DataFrame:
    """doc_id, id_key, node (hash of the text) and its labels: the shortest prefixes and what follows them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in batched(list(range(len(texts))), [len(t) for t in texts], BLOCK):
                hashes, counts = shingles([texts[i] for i in part])
                found = labels(hashes, counts, base, trees, depth)
                ends = np.concatenate([[0], np.cumsum(counts > 0)]) * trees
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(f.view(np.int64).ravel())) for f in found]
                own = batch.select(["doc_id", "id_key", "node"]).take(pa.array(part))
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id"), own.column("id_key"), own.column("node"), *lists],
                    ["doc_id", "id_key", "node", "short", "tail"])
    return with_node(docs).mapInArrow(
        run, "doc_id long, id_key long, node long, short array<long>, tail array<long>")


def walk(tries: DataFrame, base: int, depth: int) -> DataFrame:
    """The rows (short, tail, node) that share a prefix with another row, and how long a prefix: ``matched``.

    Rows are dealt by ranges, so a node that many texts share is split over tasks. The first and the last row of a range
    can't see one neighbour and count as matched in full, which compares a text too early but loses none.
    """
    bits = tail_bits(base, depth)

    def shared(short: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """Length of the prefix that each row shares with the next, 0 below the shortest."""
        same = short[1:] == short[:-1]
        out, differ = np.where(same, base, 0), tail[1:] ^ tail[:-1]
        for level in range(1, depth - base + 1):
            out += same & (differ >> (bits * (depth - base - level)) == 0)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, above = None, depth
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [np.asarray(batch.column(c)) for c in ("short", "tail", "node")]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            below = shared(rows[0], rows[1])
            matched = np.maximum(np.concatenate([[above], below[:-1]])[:len(below)], below)
            keep = matched > 0
            yield pa.RecordBatch.from_arrays([*[pa.array(x[:-1][keep]) for x in rows], pa.array(matched[keep].astype(np.int32))],
                                             ["short", "tail", "node", "matched"])
            above = int(below[-1]) if len(below) else above
            held = [x[-1:] for x in rows]
        if held is not None:
            yield pa.RecordBatch.from_arrays([*map(pa.array, held), pa.array([depth], pa.int32())],
                                             ["short", "tail", "node", "matched"])
    return tries.repartitionByRange("short", "tail", "node").sortWithinPartitions("short", "tail").mapInArrow(
        run, "short long, tail long, node long, matched int")


def with_node(docs: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(docs["doc_id"], F.coalesce(docs["doc_id"], F.lit(NO_ID)).alias("id_key"),
                       F.xxhash64(text).alias("node"), text.cast("binary").alias("text"))


def verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose exact similarity reaches the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set = None, None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keep = []
            for i in range(len(a)):
                if a[i] != hub:
                    hub, hub_set = a[i], np.unique(shingles([batch.column("text_a")[i].as_py()])[0])
                own = np.unique(shingles([batch.column("text_b")[i].as_py()])[0])
                both = len(np.intersect1d(hub_set, own, assume_unique=True))
                if both >= threshold * (len(hub_set) + len(own) - both) - 1e-9:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in keep], pa.int64()) for x in (a, b)], ["a", "b"])
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node and cls, the least node of its component, for all nodes of the links; halves paths each round."""
    both = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    state = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("cls")), "classes")
    while True:
        near = both.join(state.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("cls").alias("near"))
        new = state.join(near, "node").select("node", F.least("cls", "near").alias("cls"), F.col("cls").alias("was"))
        jump = new.select(F.col("node").alias("cls"), F.col("cls").alias("top"))
        new = materialise(new.join(jump, "cls").select("node", F.col("top").alias("cls"), "was"), "classes")
        if new.filter("cls <> was").isEmpty():
            return new.select("node", "cls")
        state = new.select("node", "cls")


def forest_rows(signed: DataFrame, base: int, depth: int) -> DataFrame:
    """The walked tries, and for each text how many others it meets in all trees: the original of a group of copies leads."""
    tries = signed.select("node", F.explode(F.arrays_zip("short", "tail")).alias("at")).select("at.short", "at.tail", "node")
    met = materialise(walk(tries, base, depth), "tries")
    sizes = met.groupBy("short").agg(F.count("*").alias("size"))
    central = met.join(sizes, "short").groupBy("node").agg(F.sum("size").alias("meets"))
    return materialise(met.join(central, "node"), "forest")


def with_hub(forest: DataFrame, level: int, base: int, depth: int) -> DataFrame:
    """Rows that share a prefix of this length, with the hub of its node."""
    rows = forest.filter(F.col("matched") >= level).withColumn(
        "prefix", F.shiftright("tail", tail_bits(base, depth) * (depth - level)) if level > base else F.lit(0).cast("long"))
    hubs = rows.groupBy("short", "prefix").agg(F.max(F.struct("meets", "node"))["node"].alias("hub"))
    return rows.join(hubs, ["short", "prefix"])


def classed(df: DataFrame, classes: DataFrame | None, column: str, name: str) -> DataFrame:
    """Add the class of a node: itself where it has no link yet."""
    if classes is None:
        return df.withColumn(name, F.col(column))
    own = classes.select(F.col("node").alias(column), F.col("cls").alias("own"))
    return df.join(own, column, "left").withColumn(name, F.coalesce("own", column)).drop("own")


def shingle_sets(batch: pa.RecordBatch) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Blocks of rows with their distinct shingles, text after text, and the row within the block of each shingle."""
    texts = batch.column("text").to_pylist()
    for part in batched(list(range(len(texts))), [len(t) for t in texts], BLOCK):
        hashes, counts = shingles([texts[i] for i in part])
        owner = np.repeat(np.arange(len(part)), counts)
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        new = np.ones(len(order), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        yield part, hashes[new], owner[new]


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """In how many texts the shingles of each of ``COUNTED`` hash buckets occur; a table of fixed size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTED, np.int64)
        for batch in batches:
            for _, hashes, _ in shingle_sets(batch):
                np.add.at(total, (hashes % np.uint64(COUNTED)).astype(np.int64), 1)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(total[hit])], ["bucket", "n"])
    most = np.iinfo(np.int32).max
    summed = texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(
        F.least(F.sum("n"), F.lit(most)).cast("int").alias("n")).toArrow()
    out = np.zeros(COUNTED, np.int32)
    for batch in summed.to_batches():
        out[np.asarray(batch.column("bucket"))] = np.asarray(batch.column("n"))
    return out


def rarest(texts: DataFrame, threshold: float) -> DataFrame:
    """node, cls, and the text's rarest shingles with their place in the common order and the text's number of shingles.

    Texts at the threshold share at least ``threshold`` of the larger one's shingles, so in any order common to all texts
    one of the first 1 - threshold of each is shared. Rare shingles come first: a passage of many texts comes last.
    """
    often = texts.sparkSession.sparkContext.broadcast(bucket_counts(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, hashes, owner in shingle_sets(batch):
                order = np.lexsort((hashes, often.value[(hashes % np.uint64(COUNTED)).astype(np.int64)], owner))
                hashes, owner = hashes[order], owner[order]
                size = np.bincount(owner, minlength=len(part))
                at = np.arange(len(owner)) - (np.cumsum(size) - size)[owner]
                keep = at <= (size - np.ceil(threshold * size - 1e-6))[owner]
                own = batch.select(["node", "cls"]).take(pa.array(np.array(part)[owner[keep]]))
                yield pa.RecordBatch.from_arrays(
                    [own.column("node"), own.column("cls"), pa.array(hashes[keep].view(np.int64)), pa.array(at[keep]),
                     pa.array(size[owner[keep]])], ["node", "cls", "gram", "at", "size"])
    return texts.select("node", "cls", "text").mapInArrow(run, "node long, cls long, gram long, at long, size long")


def across_classes(open_: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of different classes that meet in the forest and may reach the threshold, without forming the others.

    Only classes that share a rare shingle are paired, and of these the texts that hold it. In the common order, the texts
    can share no more than this shingle and what follows in both; what so stays below the threshold, first by the bounds
    of a class and then by those of a text, isn't formed.
    """
    met = materialise(open_.groupBy("node").agg(F.first("cls").alias("cls"), F.collect_set("short").alias("shorts")), "open-texts")
    rare = materialise(rarest(texts.join(met.select("node", "cls"), "node"), threshold), "rarest")
    mixed = rare.groupBy("gram").agg(F.min("cls").alias("x"), F.max("cls").alias("y")).filter("x <> y").select("gram")
    rare = materialise(rare.join(mixed, "gram"), "rarest")
    rare = rare.withColumn("rest", F.col("size") - F.col("at"))
    kinds = rare.groupBy("gram", "cls").agg(F.max("rest").alias("most"), F.min("size").alias("least"))

    def side(df: DataFrame, x: str) -> DataFrame:
        return df.select("gram", *[F.col(c).alias(f"{c}_{x}") for c in df.columns if c != "gram"])

    def can_reach(rest_a: str, size_a: str, rest_b: str, size_b: str) -> Column:
        shared = F.least(rest_a, rest_b)
        return shared >= threshold * (F.col(size_a) + F.col(size_b) - shared) - 1e-6
    pairs = side(kinds, "a").join(side(kinds, "b"), "gram").filter("cls_a < cls_b").filter(
        can_reach("most_a", "least_a", "most_b", "least_b"))
    members = rare.select("gram", "cls", "node", "rest", "size")
    pairs = pairs.join(side(members, "a"), ["gram", "cls_a"]).filter(can_reach("rest_a", "size_a", "most_b", "least_b"))
    pairs = pairs.join(side(members, "b"), ["gram", "cls_b"]).filter(can_reach("rest_a", "size_a", "rest_b", "size_b"))
    pairs = pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    for x in "ab":
        pairs = pairs.join(met.select(F.col("node").alias(x), F.col("shorts").alias(f"shorts_{x}")), x)
    return pairs.filter(F.arrays_overlap("shorts_a", "shorts_b")).select("a", "b")


def linked(block: pa.Table, cross: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the number of their links to others: within the block, or of its first part (side 0) with its second."""
    nodes, sides = np.asarray(block.column("node")), np.asarray(block.column("side"))
    grams, owners = [], []
    texts = block.column("text").to_pylist()
    for part in batched(list(range(len(texts))), [len(t) for t in texts], BLOCK):
        hashes, counts = shingles([texts[i] for i in part])
        owner = np.repeat(np.array(part), counts)
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        new = np.ones(len(order), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        grams.append(hashes[new])
        owners.append(owner[new])
    gram, owner = np.concatenate(grams), np.concatenate(owners)
    size = np.bincount(owner, minlength=len(nodes))
    _, gram, often = np.unique(gram, return_inverse=True, return_counts=True)
    common = often > 1  # what one text holds alone is shared with none
    place = np.cumsum(common) - 1
    gram, owner = place[gram[common[gram]]], owner[common[gram]]
    order = np.argsort(gram, kind="stable")
    gram, owner = gram[order], owner[order]
    left = np.flatnonzero(sides == 0) if cross else np.arange(len(nodes))
    right = np.flatnonzero(sides == 1) if cross else left
    both = np.zeros((len(left), len(right)), np.float32)
    width = int(common.sum())
    for low in range(0, width, COLUMNS):
        i, j = np.searchsorted(gram, [low, low + COLUMNS])
        held = np.zeros((len(nodes), min(COLUMNS, width - low)), np.float32)
        held[owner[i:j], gram[i:j] - low] = 1
        both += held[left] @ held[right].T
    near = both >= threshold * (size[left][:, None] + size[right][None, :] - both.astype(float)) - 1e-9
    if not cross:
        np.fill_diagonal(near, False)
        return nodes, near.sum(axis=1)
    return np.concatenate([nodes[left], nodes[right]]), np.concatenate([near.sum(axis=1), near.sum(axis=0)])


def degrees(classes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """node and n_links, how many other texts of its class are similar to it at or above the threshold; exact.

    The texts of a class are dealt into blocks by a hash, and a task gets two blocks and finds all their similarities as
    products of matrices; pairs are counted there and are never rows. A link of the forest lies within a class.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            block = pa.Table.from_batches(held)
            nodes, n = linked(block, block.column("x")[0].as_py() != block.column("y")[0].as_py(), threshold)
            return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(n.astype(np.int64))], ["node", "n"])
        held, last = [], None
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c)) for c in ("cls", "x", "y")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if held and last != tuple(keys[i].tolist()):
                    yield counted(held)
                    held = []
                last = tuple(keys[i].tolist())
                held.append(batch.slice(i, j - i))
        if held:
            yield counted(held)

    members = materialise(classes.join(texts, "node").select("cls", "node", "text"), "members")
    sizes = members.groupBy("cls").agg(F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(
        F.sum(F.octet_length("text")) / MEMBER_BYTES)).cast("long").alias("blocks")).filter("blocks > 1")
    blocks = F.coalesce("blocks", F.lit(1).cast("long"))
    own = members.join(F.broadcast(sizes), "cls", "left").withColumn("blocks", blocks).withColumn(
        "own", F.pmod(F.xxhash64("node", F.lit(5)), "blocks"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "cls", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "node",
        (F.col("own") > F.col("other")).cast("int").alias("side"), "text")
    pairs = dealt.repartition("cls", "x", "y").sortWithinPartitions("cls", "x", "y")
    return pairs.mapInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n_links"))


def near_members(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH,
                 recall: float = RECALL) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """One row per document - doc_id, node, cls -, node and cls of the linked texts, if there are any, and the texts."""
    cut = depths(trees, depth, threshold, recall)
    base = cut[-1]
    signed = materialise(signatures(docs, trees, depth, base), "signatures")
    own = materialise(signed.groupBy("node").agg(F.min("id_key").alias("id_key"), F.first("short").alias("short"),
                                                 F.first("tail").alias("tail")), "texts-signed")
    forest = forest_rows(own, base, depth)
    picked = own.select("node", "id_key").join(forest.select("node").distinct(), "node")
    texts = materialise(with_node(docs).select("id_key", "node", "text").join(picked, ["id_key", "node"])
                        .dropDuplicates(["id_key", "node"]).select("node", "text"), "forest-texts")
    classes, links = None, None
    for step in (*cut, "second", "rest"):
        if step in cut:
            pairs = with_hub(forest, step, base, depth).select(F.col("hub").alias("a"), F.col("node").alias("b"))
        else:
            known = classed(with_hub(forest, base, base, depth), classes, "node", "cls")
            mixed = known.groupBy("short").agg(F.min("cls").alias("x"), F.max("cls").alias("y")).filter("x <> y").select("short")
            open_ = known.join(mixed, "short").filter("node <> hub")
            if step == "second":  # the most central text outside the hub's class, against all of other classes
                outside = classed(open_, classes, "hub", "hub_cls").filter("cls <> hub_cls")
                hubs = outside.groupBy("short").agg(F.max(F.struct("meets", "node", "cls")).alias("top"))
                pairs = open_.join(hubs, "short").filter("cls <> top.cls").select(F.col("top.node").alias("a"), F.col("node").alias("b"))
            else:
                pairs = across_classes(materialise(open_.select("short", "node", "cls"), "open"), texts, threshold)
        pairs = pairs.filter("a <> b").distinct()
        if step in cut[1:]:
            pairs = classed(classed(pairs, classes, "a", "ca"), classes, "b", "cb").filter("ca <> cb").select("a", "b")
        found = materialise(verify(pairs, texts, threshold), "links")
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            classes = components(links)
    return classed(signed.select("doc_id", "node"), classes, "node", "cls"), classes, texts


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH,
                    recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id of its class), class_size, n_links.

    Classes are the connected components of similarity at or above the threshold. n_links counts the other
    texts that are similar to the document's text; all pairs within a class are compared. Null and empty texts are one class; they have no links. Rows that
    repeat an id are listed each. A class whose ids are all null has a null class_id. An empty table gives no rows.
    """
    members, classes, texts = near_members(docs, threshold, trees, depth, recall)
    size = F.count("*").alias("class_size")
    if classes is None:
        members = members.withColumn("n_links", F.lit(0).cast("long"))
    else:
        members = members.join(degrees(classes, texts, threshold), "node", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long")))
    heads = members.groupBy("cls").agg(F.min("doc_id").alias("class_id"), size)
    return members.join(heads, "cls").select("doc_id", "class_id", "class_size", "n_links")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents with the least id of their class, with their columns, one row for each class.

    A null id is taken only where the class has no other; of rows that share the id, one text of the class stays.
    """
    own = F.coalesce("doc_id", F.lit(NO_ID)).alias("id_key")
    heads = near_members(docs)[0].groupBy("cls").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), own, "node")).alias("head")).select("head.id_key", "head.node")
    rows = docs.select(F.coalesce(docs["doc_id"], F.lit(NO_ID)).alias("id_key"),
                       F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("node"), F.struct("*").alias("doc"))
    return rows.dropDuplicates(["id_key", "node"]).join(heads, ["id_key", "node"]).select("doc.*")
