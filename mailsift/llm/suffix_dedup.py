"""Removal of every byte that a repeated 100-byte string covers.

1. Anchors: of the grams in each 100-byte window the one with the least hash is its anchor, so equal windows have equal
   anchors. Anchors that occur once in the corpus end the matter for their windows; they are counted by a combining
   aggregation and joined back to their documents.
2. Shards: the windows of repeated anchors in a bounded share of the documents form one text. Its suffix array is
   built by Larsson-Sadakane refinement (only groups that still tie are sorted again, by the ranks h bytes on) as deep
   as 100 bytes, common prefixes of neighbours by comparing words as far. A run of suffixes with at least 100 bytes in common is one
   string; all but its earliest place in the shard are repeats.
3. Merge: what is first within its shard - one place per string and shard, however hot the string - goes with its
   bytes to the shard's peers by anchor; there the strings' sorted keys are searched by bisection for the earliest place.
   The windows of an anchor with too many bytes for that - a phrase in many texts - are dealt by their own hashes instead.

The text of documents with repeated anchors is shuffled once and kept bucketed by document, so that the last step, which
cuts the bytes out, needs no second shuffle of texts.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.llm.common import Rolling, batched, materialise, scratch_path

LENGTH = 100
GRAM = 24
BLOCK = 2_000_000  # bytes whose anchors are found at once
SHARD = 2_000_000  # bytes of the documents of one suffix array
MERGE = 4_000_000  # bytes of pieces merged at once, and of one anchor
SPREAD = 250_000  # bytes of pieces whose windows are dealt one by one at once
NO_ID = -(1 << 63)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of ``width`` values from each place on, by doubling."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:len(x) - rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: first and last window, 48-bit anchor, document; windows lie within documents."""
    empty = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return empty, empty, empty, empty
    starts = np.concatenate([[0], ends[:-1]])
    grams = Rolling(data).windows(GRAM)
    low = np.uint64(32)
    place = sliding_min(grams >> low << low | np.arange(len(grams), dtype=np.uint64), LENGTH - GRAM + 1)
    place = (place & np.uint64(0xFFFFFFFF)).astype(np.int64)
    n = len(place)
    long = ends - starts >= LENGTH
    edge = np.zeros(n + 1, np.int32)
    edge[starts[long]] = 1
    edge[ends[long] - LENGTH + 1] = -1
    inside = np.cumsum(edge[:n]) > 0
    new = np.ones(n, bool)
    new[1:] = place[1:] != place[:-1]
    new[starts[long]] = True
    lo = np.flatnonzero(new & inside)
    doc = np.searchsorted(ends, lo, side="right")
    hi = np.minimum(np.append(lo[1:] - 1, n - 1), ends[doc] - LENGTH)
    return lo, hi, (grams[place[lo]] >> np.uint64(16)).astype(np.int64), doc


def suffix_array(data: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks by Larsson-Sadakane refinement, from a first sort by as many bytes as fit beside a place in 64 bits.

    With ``most``, suffixes that agree in so many bytes or more may stay tied, their ranks equal.
    """
    n = len(data)
    bits = np.uint64(n.bit_length())
    h = (64 - int(bits)) // 8
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.ndarray(n, ">u8", wide.tobytes(), strides=(1,)).astype(np.uint64) >> np.uint64(64 - 8 * h)
    sa, key = in_order(key, bits)
    rank = np.empty(n, np.int64)
    start = np.concatenate([[True], key[1:] != key[:-1]]) if n else np.zeros(0, bool)
    where = np.arange(n)
    while True:
        first = np.maximum.accumulate(np.where(start, where, 0))
        rank[sa[where]] = first
        tie = ~start
        tie[:-1] |= ~start[1:]
        where = where[tie]
        if not len(where) or h >= n or most is not None and h >= most:
            return sa, rank
        part = sa[where]
        ahead = part + h
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = (rank[part] * (n + 1) + second).astype(np.uint64)
        order, key = in_order(key, bits)
        sa[where] = part[order]
        start = np.concatenate([[True], key[1:] != key[:-1]])
        h *= 2


def in_order(key: np.ndarray, bits: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys in their order, and the keys in it. Where both fit into 64 bits, one sort of the two moves no places after it."""
    if len(key) and int(key.max()).bit_length() + int(bits) > 64:
        order = np.argsort(key, kind="stable")
        return order, key[order]
    both = np.sort(key << bits | np.arange(len(key), dtype=np.uint64))
    return (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), both >> bits


def common_prefixes(data: np.ndarray, sa: np.ndarray, rank_of: np.ndarray, most: int | None = None) -> np.ndarray:
    """Bytes that each suffix shares with its predecessor in the array (0 for the first), counted up to at least ``most``.

    All neighbours are compared eight bytes per step together, those that still agree go on.
    """
    n, out = len(data), np.zeros(len(sa), np.int64)
    words = np.ndarray(n + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    todo = np.arange(1, len(sa))
    a, b = sa[1:], sa[:-1]
    while len(todo):
        differ = words[np.minimum(a, n)] ^ words[np.minimum(b, n)]
        same = np.full(len(todo), 8)
        stop = np.flatnonzero(differ)
        lowest = differ[stop] & (~differ[stop] + np.uint64(1))
        same[stop] = np.log2(lowest.astype(float)).astype(np.int64) // 8
        same = np.minimum(same, n - np.maximum(a, b))
        out[todo] += same
        go = same == 8
        todo, a, b = todo[go], a[go] + 8, b[go] + 8
        if most is not None and len(todo) and out[todo[0]] >= most:
            break
    return out


def repeats(data: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Valid places whose 100 bytes also start at an earlier valid place."""
    sa, rank = suffix_array(data, LENGTH)
    shared = common_prefixes(data, sa, rank, LENGTH)
    group = np.cumsum(shared < LENGTH)
    keep = valid[sa]
    places, group = sa[keep], group[keep]
    first = np.full(group[-1] + 1 if len(group) else 1, len(data), np.int64)
    np.minimum.at(first, group, places)
    out = np.zeros(len(data), bool)
    out[places] = places != first[group]
    return out


def intervals(places: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted window starts as disjoint byte ranges they cover, within each owner: owner, start, end."""
    if not len(places):
        return owner, places, places
    cut = (np.diff(places) > LENGTH) | (owner[1:] != owner[:-1])
    first, last = np.append(True, cut), np.append(cut, True)
    return owner[first], places[first], places[last] + LENGTH


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, a key that is never null, a second one that tells rows with equal ids apart, and the bytes."""
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(docs["doc_id"], F.coalesce(docs["doc_id"], F.lit(NO_ID)).alias("id_key"),
                       F.xxhash64(text).alias("tag"), text.cast("binary").alias("data"))


def anchor_rows(rows: DataFrame) -> DataFrame:
    """Distinct anchors of each document, with 2 for those it holds more than once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = batch.column("data").to_pylist(), np.asarray(batch.column("id_key"))
            for part in batched(list(range(len(texts))), [len(t) + 256 for t in texts], BLOCK):
                data = np.frombuffer(b"".join([texts[i] for i in part]), np.uint8)
                _, _, anchor, doc = anchors(data, np.cumsum([len(texts[i]) for i in part]))
                both, n = np.unique(anchor << 15 | doc, return_counts=True)  # a block has fewer than 2^15 documents
                yield pa.RecordBatch.from_arrays(
                    [pa.array(both >> 15), pa.array(keys[part][both & 0x7FFF]), pa.array(np.minimum(n, 2))],
                    ["anchor", "id_key", "n"])
    return rows.select("id_key", "data").mapInArrow(run, "anchor long, id_key long, n long")


def local_repeats(rows: DataFrame) -> DataFrame:
    """Of documents with their repeated anchors: byte ranges that repeat within the shard, and pieces for the merge.

    A row without ``anchor`` is a range; one with it holds the bytes of consecutive windows that share the anchor.
    """
    def shard(keys: np.ndarray, tags: np.ndarray, texts: list[bytes], wanted: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((tags, keys)).tolist()  # the place in the shard's text is the order in the corpus
        keys, tags = keys[order], tags[order]
        data = np.frombuffer(b"".join([texts[i] for i in order]), np.uint8)
        ends = np.cumsum([len(texts[i]) for i in order])
        lo, hi, anchor, doc = anchors(data, ends)
        held = np.concatenate([wanted[i] << 15 | k for k, i in enumerate(order)])  # a shard has fewer than 2^15 documents
        hit = np.isin(anchor << 15 | doc, held)
        lo, hi, anchor, doc = lo[hit], hi[hit], anchor[hit], doc[hit]
        if not len(lo):
            return
        begin = np.append(0, ends[:-1])
        covered, used = np.zeros((2, len(data) + 1), np.int32)
        covered[lo] += 1
        covered[hi + 1] -= 1
        np.add.at(used, lo, 1)
        np.add.at(used, hi + LENGTH, -1)
        at = np.flatnonzero(np.cumsum(used[:-1]) > 0)
        places = at[repeats(data[at], np.cumsum(covered[:-1])[at] > 0)]
        owner, start, end = intervals(places, np.searchsorted(ends, places, side="right"))
        n = len(owner)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[owner]), pa.array(tags[owner]), pa.array(start - begin[owner]), pa.array(end - begin[owner]),
             pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names)
        late = np.zeros(len(data) + 1, np.int64)
        late[places + 1] = 1
        late = np.cumsum(late)
        new = late[hi + 1] - late[lo] <= hi - lo  # at least one window is new here
        lo, hi, anchor, doc = lo[new], hi[new], anchor[new], doc[new]
        size = hi - lo + LENGTH
        offset = np.append(0, np.cumsum(size))
        raw = data[np.repeat(lo - offset[:-1], size) + np.arange(offset[-1])]
        pieces = pa.Array.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer(offset.astype(np.int32)), pa.py_buffer(raw)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[doc]), pa.array(tags[doc]), pa.array(lo - begin[doc]), pa.array(hi - begin[doc]),
             pa.array(anchor), pieces], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, tags = np.asarray(batch.column("id_key")), np.asarray(batch.column("tag"))
            texts, lists = batch.column("data").to_pylist(), batch.column("anchors")
            for part in batched(list(range(len(texts))), [len(t) + 256 for t in texts], SHARD):
                _, once = np.unique(np.stack([keys[part], tags[part]]), axis=1, return_index=True)  # no repeated rows
                part = np.array(part)[once].tolist()
                yield from shard(keys[part], tags[part], [texts[i] for i in part],
                                 [np.asarray(lists[i].values, np.int64) for i in part])

    names = ["id_key", "tag", "lo", "hi", "anchor", "piece"]
    return rows.select("id_key", "tag", "data", "anchors").mapInArrow(
        run, "id_key long, tag long, lo long, hi long, anchor long, piece binary")


def crowded(pieces: DataFrame) -> DataFrame:
    """Anchors whose pieces hold more than ``MERGE`` bytes: no more than the bytes of all pieces by ``MERGE``."""
    size = F.sum(F.col("hi") - F.col("lo") + LENGTH)
    return pieces.groupBy("anchor").agg(size.alias("size")).filter(F.col("size") > MERGE).select("anchor")


def merge_windows(pieces: DataFrame) -> DataFrame:
    """As ``merge_shards``, but each window is dealt by two hashes of its 100 bytes, so its anchor may be in any number of texts.

    A string comes at most once from a shard and is compared with the one before it in the order, so nothing is held.
    """
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("piece").to_pylist()
            keys, tags, lo = (np.asarray(batch.column(c)) for c in ("id_key", "tag", "lo"))
            for part in batched(list(range(len(texts))), [len(t) for t in texts], SPREAD):
                size = np.array([len(texts[i]) for i in part])
                counts = size - LENGTH + 1
                piece = np.repeat(np.arange(len(part)), counts)
                inner = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
                data, at = np.frombuffer(b"".join([texts[i] for i in part]), np.uint8), (np.cumsum(size) - size)[piece] + inner
                hashes = [Rolling(d).windows(LENGTH)[at].view(np.int64) for d in (data, data ^ np.uint8(0x5A))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (*hashes, keys[part][piece], tags[part][piece], lo[part][piece] + inner)], columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None  # of the string that the last batch ended with
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([np.asarray(batch.column(c)) for c in columns])
            if first is not None:
                rows = np.concatenate([first, rows], axis=1)
            new = np.ones(rows.shape[1], bool)
            new[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)
            start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            late = (rows[2:] != rows[2:, start]).any(axis=0)
            first = rows[:, start[-1:]]
            keys, tags, lo = rows[2:, late]
            order = np.lexsort((lo, tags, keys))
            keys, tags, lo = keys[order], tags[order], lo[order]
            text = np.zeros(len(lo), np.int64)
            text[1:] = np.cumsum((keys[1:] != keys[:-1]) | (tags[1:] != tags[:-1]))
            owner, begin, end = intervals(lo, text)
            at = np.searchsorted(text << 32 | lo, owner << 32 | begin)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[at], tags[at], begin, end)], ["id_key", "tag", "lo", "hi"])

    columns = ["strong", "check", "id_key", "tag", "lo"]
    windows = pieces.select("id_key", "tag", "lo", "piece").mapInArrow(spread, ", ".join(f"{c} long" for c in columns))
    return windows.repartition("strong").sortWithinPartitions(*columns).mapInArrow(
        run, "id_key long, tag long, lo long, hi long")


def later(strong: np.ndarray, check: Callable[[np.ndarray], np.ndarray], time: np.ndarray) -> np.ndarray:
    """Windows whose string, told by ``strong`` and ``check``, also has an earlier time. Strings that occur once need no check."""
    late = np.zeros(len(strong), bool)
    bits = np.uint64(len(strong).bit_length())
    by, key = in_order(strong >> bits, bits)  # the sorted run of keys, less their last bits
    new = np.append(True, key[1:] != key[:-1])
    several = ~new
    several[:-1] |= ~new[1:]
    by, group = by[several], np.cumsum(new[several])
    if not len(by):
        return late
    whole = np.stack([strong[by], check(by)])
    other = (whole[:, 1:] != whole[:, :-1]).any(axis=0)
    mixed = np.unique(group[1:][other & (group[1:] == group[:-1])])  # keys that agree, of strings that do not
    if len(mixed):
        m = np.flatnonzero(np.isin(group, mixed))
        order = m[np.lexsort((whole[1, m], whole[0, m], group[m]))]
        by[m], whole[:, m] = by[order], whole[:, order]
        other = (whole[:, 1:] != whole[:, :-1]).any(axis=0)
    start = np.flatnonzero(np.append(True, other))
    earliest = np.minimum.reduceat(time[by], start)
    place = np.searchsorted(start, np.arange(len(by)), side="right") - 1  # each window finds its string in the run by bisection
    late[by] = time[by] != earliest[place]
    return late


def merge_shards(pieces: DataFrame) -> DataFrame:
    """Byte ranges whose windows start earlier in another shard."""
    def merged(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys, tags, lo = (np.asarray(rows.column(c)) for c in ("id_key", "tag", "lo"))
        texts = rows.column("piece")
        offset = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offset[0]:offset[-1]]
        counts = np.diff(offset) - LENGTH + 1
        piece = np.repeat(np.arange(len(texts)), counts)
        inner = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = (offset[:-1] - offset[0])[piece] + inner
        order = np.lexsort((tags, keys))
        turn = np.empty(len(order), np.int64)
        changed = np.ones(len(order), bool)
        changed[1:] = (keys[order][1:] != keys[order][:-1]) | (tags[order][1:] != tags[order][:-1])
        turn[order] = np.cumsum(changed)
        time = turn[piece] << 32 | (lo[piece] + inner)  # earlier windows have smaller times
        late = later(Rolling(data).windows(LENGTH)[at], lambda w: Rolling(data ^ np.uint8(0x5A)).of(at[w], at[w] + LENGTH), time)
        owner, start, end = intervals((lo[piece] + inner)[late], piece[late])
        yield pa.RecordBatch.from_arrays([pa.array(keys[owner]), pa.array(tags[owner]), pa.array(start), pa.array(end)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column("piece").nbytes
            if size > MERGE:
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                cut = int(np.searchsorted(np.asarray(rows.column("anchor")), rows.column("anchor")[-1].as_py()))
                if cut:  # the last anchor may go on
                    yield from merged(rows.slice(0, cut))
                held, size = [rows.slice(cut)], rows.slice(cut).column("piece").nbytes
        if size:
            yield from merged(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    names = ["id_key", "tag", "lo", "hi"]
    return pieces.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(
        run, "id_key long, tag long, lo long, hi long")


def cut_out(rows: DataFrame) -> DataFrame:
    """id_key, tag, bytes removed, maximal removed runs and digest of the rest, from the bytes and the ranges."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("tag", "data", "ranges")]
            for tag, data, ranges in zip(*columns):
                spans: list[list[int]] = []
                for lo, hi in sorted((r["lo"], r["hi"]) for r in ranges if r["tag"] == tag):
                    if spans and lo <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], hi)
                    else:
                        spans.append([lo, hi])
                rest = hashlib.sha256()
                for a, b in zip([0, *[hi for _, hi in spans]], [*[lo for lo, _ in spans], len(data)]):
                    rest.update(data[a:b])
                out.append((sum(hi - lo for lo, hi in spans), len(spans), rest.hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id_key"), batch.column("tag"), *[pa.array(c, t) for c, t in zip(
                    zip(*out) if out else [()] * 3, kinds)]], ["id_key", "tag", "n_removed", "n_spans", "kept_sha256"])
    return rows.select("id_key", "tag", "data", "ranges").mapInArrow(
        run, "id_key long, tag long, n_removed long, n_spans long, kept_sha256 string")


def bucketed(df: DataFrame, *keys: str) -> DataFrame:
    """A table in the shared folder, dealt by ``keys``, that later joins on them read without a shuffle."""
    spark = df.sparkSession
    name = f"suffix_{uuid.uuid4().hex}"
    (df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)
     .option("path", scratch_path(spark, name)).saveAsTable(name))
    return spark.table(name)


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null texts are empty; texts below 100 bytes never lose a byte. Rows with null ids count as the earliest. Rows that
    share an id are ordered by a hash of their text; where they share the text too they are one document and all get its
    row. An empty table gives no rows.
    """
    rows = keyed(docs)
    often = anchor_rows(rows).groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor")
    wanted = (anchor_rows(rows).select("anchor", "id_key").join(often, "anchor")
              .groupBy("id_key").agg(F.collect_set("anchor").alias("anchors")))
    suspects = bucketed(rows.select("id_key", "tag", "data").join(wanted, "id_key"), "id_key")
    found = materialise(local_repeats(suspects), "repeats")
    pieces = found.filter("anchor IS NOT NULL")
    hot = materialise(crowded(pieces), "crowded")
    ranges = found.filter("anchor IS NULL").select("id_key", "tag", "lo", "hi").unionByName(
        merge_shards(pieces.join(F.broadcast(hot), "anchor", "left_anti")))
    if not hot.isEmpty():
        ranges = ranges.unionByName(merge_windows(pieces.join(F.broadcast(hot), "anchor", "left_semi")))
    ranges = ranges.groupBy("id_key").agg(F.collect_list(F.struct("tag", "lo", "hi")).alias("ranges"))
    cut = cut_out(suspects.select("id_key", "tag", "data").join(ranges, "id_key")).dropDuplicates(["id_key", "tag"])
    plain = rows.select("doc_id", "id_key", "tag", F.octet_length("data").cast("long").alias("n_bytes"),
                        F.sha2("data", 256).alias("sha"))
    none = F.lit(0).cast("long")
    return plain.join(cut, ["id_key", "tag"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
