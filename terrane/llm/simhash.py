"""SimHash near-duplicates, found with BK-trees.

Fingerprints are made distinct first (copies only count once, pre-aggregated before the shuffle).  Two fingerprints within
the radius r agree on at least one of r + 1 pieces of their 64 bits, so each distinct one goes to r + 1 buckets.  Buckets
with more than HOT members are dealt again by r + 1 pieces of their other bits, by the same argument.  A BK-tree holds
each bucket; its members are looked up in it, following only edges within the radius, and the bucket gives the links of a
spanning forest: at most one a member, never all pairs.  Components come from repeated hooking and shortcutting of links as
tables; no links or fingerprints reach the driver.

Texts without words, null ones included, have fingerprint zero and link like any other.  Null ids come last in choosing a
smallest id.  Repeated rows are in one component; an empty table gives none.  Texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from terrane.llm.common import _IS_WHITE, _LOWER, as_bytes, free_name, remove, two, written

RADIUS, SHINGLE, HOT = 4, 4, 2000
#: A fingerprint that one row in so many has is kept out of shuffles by fingerprint.
LARGE = 1000


def fingerprint_of(text: bytes, k: int = SHINGLE) -> int:
    """A bit is set if set in over half the hashes of the k-word shingles."""
    joined = _LOWER[np.frombuffer(text, np.uint8)]
    white = _IS_WHITE[joined]
    edge = np.diff(white.astype(np.int8), prepend=1, append=1)
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not first.size:
        return 0
    # Words joined by single spaces: all word bytes, and the one white byte before each word but the first.
    keep = ~white
    keep[first[1:] - 1] = True
    flat = np.where(white, np.uint8(32), joined)[keep].tobytes()
    size = last - first
    end = np.cumsum(size + 1) - 1
    start = end - size
    k = min(k, first.size)
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(flat[a:b], 42) for a, b in zip(start[: first.size - k + 1].tolist(), end[k - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, hashes.size, 65536):
        ones += np.unpackbits(hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > hashes.size, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint_of(t) for t in as_bytes(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return two(df, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Children are keyed by their distance to the parent."""

    def __init__(self):
        self.value: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, x: int) -> None:
        self.value.append(x)
        self.children.append({})
        new = len(self.value) - 1
        at = 0
        while at != new:
            d = (self.value[at] ^ x).bit_count()
            at = self.children[at].setdefault(d, new)

    def near(self, x: int, radius: int) -> Iterator[int]:
        """Positions of the values within the radius of x."""
        todo = [0] if self.value else []
        while todo:
            at = todo.pop()
            d = (self.value[at] ^ x).bit_count()
            if d <= radius:
                yield at
            for edge, child in self.children[at].items():
                if d - radius <= edge <= d + radius:
                    todo.append(child)


def forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links (value, value) that join what the radius joins: each value is searched among those before it."""
    tree, root, links = BKTree(), list(range(len(values))), []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, x in enumerate(values):
        for j in tree.near(x, radius):
            a, b = top(i), top(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((values[j], x))
        tree.add(x)
    return links


def _cuts(bits: int, parts: int) -> list[tuple[int, int]]:
    edges = [bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _taken(fp, low: int, width: int):
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))


def near_links(distinct: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that join all within the radius of each other."""
    cuts = _cuts(64, radius + 1)
    fp = F.col("fp")
    keyed = distinct.select("fp", F.posexplode(F.array(*(_taken(fp, a, w) for a, w in cuts))).alias("p", "v"))
    sizes = keyed.groupBy("p", "v").count().where(F.col("count") > hot).select("p", "v", F.lit(True).alias("hot"))
    keyed = keyed.join(sizes, ["p", "v"], "left")
    # The other bits of a hot bucket, closed up, and cut again.
    other = F.lit(None).cast("array<long>")
    for p, (low, width) in enumerate(cuts):
        below = _taken(fp, 0, low) if low else F.lit(0).cast("long")
        above = F.shiftleft(F.shiftrightunsigned(fp, low + width), low) if low + width < 64 else F.lit(0).cast("long")
        rest = below.bitwiseOR(above)
        other = F.when(F.col("p") == p, F.array(*(_taken(rest, a, w) for a, w in _cuts(64 - width, radius + 1)))).otherwise(other)
    again = F.when(F.col("hot"), other).otherwise(F.array(F.lit(-1).cast("long")))
    keyed = keyed.select("fp", "p", "v", F.posexplode(again).alias("p2", "v2"))
    keys = ["p", "v", "p2", "v2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, values = None, []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in (*keys, "fp")]
            out = []
            for *key, value in zip(*columns, strict=True):
                if key != now:
                    out += forest(values, radius) if len(values) > 1 else []
                    now, values = key, []
                values.append(value & (1 << 64) - 1)
            yield _links(out)
        yield _links(forest(values, radius) if len(values) > 1 else [])

    return keyed.repartition(*keys).sortWithinPartitions(*keys, "fp").mapInArrow(run, "a long, b long")


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    x = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, root for a table of nodes (node, label): root is the smallest label reachable.

    Each round every node takes the least label among its neighbours' and then its label's own label (pointer jumping
    over labels), as tables, until nothing changes.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "links")
    linked = nodes.join(both.select(F.col("a").alias("node")).distinct(), "node", "left_semi")
    now = written(linked.select("node", F.col("label").alias("root")), "roots")
    while True:
        offers = both.join(now.select(F.col("node").alias("a"), "root"), "a").groupBy(F.col("b").alias("node")).agg(F.min("root").alias("offer"))
        hooked = now.join(offers, "node").select("node", F.col("root").alias("was"), F.least("root", "offer").alias("root"))
        best = hooked.groupBy(F.col("was").alias("root")).agg(F.min("root").alias("best"))
        step = written(hooked.join(best.withColumnRenamed("root", "was"), "was").select("node", "was", F.least("root", "best").alias("root")), "roots")
        changed = not step.where("root < was").isEmpty()
        remove(now)
        now = step.select("node", "root")
        if not changed:
            remove(both)
            return nodes.join(now, "node", "left").select("node", F.coalesce("root", "label").alias("root"))


def _rooted(df: DataFrame, id_col: str, text_col: str, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, root: the component's least label (none, id, fp), where a null id is none, comes last and goes by its fp."""
    docs = written(fingerprints(df, id_col, text_col), "fingerprints")
    none, zero = F.col("doc_id").isNull(), F.lit(0).cast("long")
    label = F.struct(none.alias("none"), F.coalesce("doc_id", zero).alias("id"), F.when(none, F.col("fp")).otherwise(zero).alias("fp"))
    distinct = written(docs.groupBy("fp").agg(F.min(label).alias("label"), F.count("*").alias("copies")), "distinct")
    found = components(distinct.select(F.col("fp").alias("node"), "label"), near_links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    # Roots of fingerprints with at least one row in LARGE are broadcast, LARGE of them at most; the join of the others has no
    # key with more rows than that.
    large = F.broadcast(distinct.where(F.col("copies") * LARGE >= docs.count()).select("fp"))
    return docs.join(F.broadcast(found.join(large, "fp", "left_semi")), "fp").unionByName(docs.join(large, "fp", "left_anti").join(found.join(large, "fp", "left_anti"), "fp"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable by links)."""
    component = F.when(~F.col("root.none"), F.col("root.id")).alias("component_id")
    return _rooted(df, id_col, text_col, radius).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), component)


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with only the smallest id's row of each component; of several rows with that id, all stay.

    Null ids come last: of a component that has no other, one row stays.  All columns stay as they are, whatever their names.
    """
    own = free_name("own_fp", df.columns)
    plan = _rooted(df, id_col, text_col)
    rooted = written(plan, "rooted")
    remove(plan)
    keep = rooted.where("not root.none and doc_id = root.id").select(F.col("doc_id").alias(id_col)).distinct()
    alone = rooted.where("root.none").select(F.col("root.fp").alias(own)).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint_of(t or b"") for t in as_bytes(batch.column(text_col))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp)], [*batch.schema.names, own])

    nulls = df.where(F.col(id_col).isNull())
    nulls = nulls.mapInArrow(run, nulls.withColumn(own, F.lit(0).cast("long")).schema)
    return df.join(keep, id_col, "left_semi").select(df.columns).union(nulls.join(alone, own, "left_semi").dropDuplicates([own]).select(df.columns))
