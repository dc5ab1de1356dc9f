"""Merkle fixity audit of two replicas of a record archive, in DataFrame operations.

Records lie in archive files in the order of their ids; the digest of a record covers its header and payload, a leaf
covers the records that start in one range of offsets, and each higher node covers ``fan_out`` neighbours. The roots
of the replicas are compared first; below a pair of nodes that differ, and only there, the children are compared, down to
the records. Files are bounded by construction, so no window or group grows with the archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsift.llm.common import materialise, narrow

FILE_RECORDS = 4096  # ids per archive file
LEAF_BYTES = 1 << 16  # offsets per leaf
FAN_OUT = 8
CROWDED = 4  # times the usual records, beyond which a file is dealt into parts
NAMELESS = -(1 << 60)  # files of records without an id


def records(pages: DataFrame) -> DataFrame:
    """file, page_id, bytes of the record in the archive and its digest.

    Null urls and payloads are empty ones. Records without an id lie in files of their own, below all others, by their
    digests. Rows that repeat an id are records of their own, in the order of their digests.
    """
    df = narrow(pages, "page_id", "url", "html")
    body = F.coalesce("html", F.lit(""))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    header = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), name,
                      F.lit(">\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")), F.lit("\r\nContent-Length: "),
                      F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    raw = F.concat(header, body, F.lit("\r\n\r\n"))
    df = df.select("page_id", F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("digest"))
    nameless = F.lit(NAMELESS) - F.conv(F.substring("digest", 1, 3), 16, 10).cast("long")
    return df.withColumn("file", F.coalesce(F.floor(F.col("page_id") / FILE_RECORDS).cast("long"), nameless))


def node(digests: Column) -> Column:
    """Digest over digests, null over none."""
    return F.when(F.size(digests) > 0, F.sha2(F.concat_ws(",", digests), 256))


def ordered(digest: str, *by: str, of: Column | None = None) -> Column:
    item = F.struct(*by, F.col(digest).alias("_d"))
    return F.transform(F.sort_array(F.collect_list(F.when(F.col(digest).isNotNull() if of is None else of, item))), lambda x: x["_d"])


def place(recs: DataFrame) -> DataFrame:
    """Records of both replicas (``side`` 0 and 1) with their part of the file and their leaf.

    Offsets are those of the first replica: a record that changed its length must not move all that follow. The second
    replica's records go to the leaf of the last one of the first with their id, or before it. A file whose ids repeat so often that
    it holds many times its records is dealt into parts by digest, so that no window grows with one id.
    """
    rows = recs.groupBy("file", "side").agg(F.count("*").alias("n")).groupBy("file").agg(F.max("n").alias("n"))
    crowded = rows.filter(F.col("n") > CROWDED * FILE_RECORDS).select("file", F.ceil(F.col("n") / FILE_RECORDS).alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64("digest"), F.col("parts")), F.lit(0).cast("long"))
    recs = recs.join(crowded, "file", "left").withColumn("part", part).drop("parts")
    w = Window.partitionBy("file", "part").orderBy("page_id", "side", "digest")
    first = F.col("side") == 0
    offset = F.sum(F.when(first, F.col("n_bytes")).otherwise(0)).over(w) - F.col("n_bytes")
    recs = recs.withColumn("_own", F.when(first, F.floor(offset / LEAF_BYTES).cast("long")))
    return recs.withColumn("leaf", F.coalesce(F.last("_own", ignorenulls=True).over(w), F.lit(0).cast("long"))).drop("_own", "n_bytes")


def levels(recs: DataFrame, depth: int) -> list[DataFrame]:
    """Nodes of both trees, side by side, from the leaves (first) to one root per part of a file (last); each is written."""
    sides = [F.col("side") == k for k in (0, 1)]
    out = [materialise(recs.groupBy("file", "part", F.col("leaf").alias("node")).agg(
        *[node(ordered("digest", "page_id", of=of)).alias(name) for name, of in zip("ab", sides)]), "warc-level")]
    for _ in range(depth):
        up = out[-1].withColumn("parent", F.floor(F.col("node") / FAN_OUT).cast("long"))
        up = up.groupBy("file", "part", "parent").agg(*[node(ordered(name, "node")).alias(name) for name in "ab"])
        out.append(materialise(up.withColumnRenamed("parent", "node"), "warc-level"))
    return out


def differing(level: DataFrame) -> DataFrame:
    """Nodes whose digests differ or that only one side has."""
    return level.filter(~F.col("a").eqNullSafe(F.col("b"))).select("file", "part", "node")


FAULTS = "file long, leaf long, page_id long, status string, expected string, found string"


def audit(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """The records at fault: file, leaf, page_id, status (corrupt, missing, extra), expected and found digest.

    Equal replicas, and empty ones, give no rows. Of records that repeat an id, each that lacks its counterpart is reported,
    equal ones as often as they lack it; what is expected and what is found are paired in the order of the digests. A record
    without an id has no counterpart but an equal one, so a changed one is missing and extra. Hashing reads every record
    once; comparing reads only what lies below differing nodes, and ends at the roots of equal replicas.
    """
    both = records(pages).withColumn("side", F.lit(0)).unionByName(records(replica).withColumn("side", F.lit(1)))
    recs = materialise(place(materialise(both, "warc-records")), "warc-placed")
    most = recs.agg(F.max("leaf")).first()[0] or 0
    depth = 0
    while most >= FAN_OUT ** depth:
        depth += 1
    tree = levels(recs, depth)
    bad = materialise(differing(tree[-1]), "warc-roots")
    if bad.isEmpty():
        return pages.sparkSession.createDataFrame([], FAULTS)
    for level in tree[-2::-1]:
        below = level.withColumn("parent", F.floor(F.col("node") / FAN_OUT).cast("long"))
        bad = differing(below.join(bad.withColumnRenamed("node", "parent"), ["file", "part", "parent"], "left_semi"))
    suspects = recs.join(bad.withColumnRenamed("node", "leaf"), ["file", "part", "leaf"], "left_semi")
    # Equal records are counted on both sides; what one side has more of is at fault. Null ids group like any other.
    sides = [F.col("side") == k for k in (0, 1)]
    counted = suspects.groupBy("file", "page_id", "digest").agg(
        (F.count_if(sides[0]) - F.count_if(sides[1])).alias("more"), F.min("leaf").alias("leaf"))
    odd = counted.filter("more <> 0").withColumn("lost", F.col("more") > 0).withColumn(
        "copy", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("more"))))
    turn = F.row_number().over(Window.partitionBy("file", "page_id", "lost").orderBy("digest", "copy"))
    # A record without an id pairs with none.
    odd = odd.withColumn("turn", F.when(F.col("page_id").isNull() & F.col("lost"), -turn).otherwise(turn))
    found = odd.groupBy("file", "page_id", "turn").agg(
        F.coalesce(F.max(F.when(F.col("lost"), F.col("leaf"))), F.max("leaf")).alias("leaf"),
        F.max(F.when(F.col("lost"), F.col("digest"))).alias("expected"),
        F.max(F.when(~F.col("lost"), F.col("digest"))).alias("found"))
    status = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "extra").otherwise("corrupt")
    return found.select("file", "leaf", "page_id", status.alias("status"), "expected", "found")


def aged_replica(pages: DataFrame) -> DataFrame:
    """A replica as a bad disk would leave it: by a hash of the id some payloads change, some records go, some double."""
    h = F.coalesce(F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 2), F.lit(""))
    aged = pages.filter(~h.isin("10", "11")).withColumn(
        "html", F.when(h.isin("00", "01"), F.concat(F.substring("html", 2, 1 << 30), F.lit("~"))).otherwise(F.col("html")))
    doubled = pages.filter(h == "20").withColumn("page_id", -F.col("page_id") - 1)
    return aged.unionByName(doubled)
