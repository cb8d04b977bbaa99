"""SimHash near-duplicates over a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes. Two fingerprints within two bits differ in at
most two of them, so at least six of the eight agree. The index is therefore kept over sets of
six positions: a pair that reaches the guaranteed minimum meets in the list of every such set it
shares, and a pair below it meets nowhere. A list leaves two bytes open, so it holds at most
65,536 distinct fingerprints whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendgrid.llm.common import connected_components, numbered, written

SEED = 42
BYTES = 8
#: The index's position sets, and the two positions that each leaves open.
SETS = list(combinations(range(BYTES), BYTES - 2))
OPEN = np.array([[p for p in range(BYTES) if p not in c] for c in SETS])
#: Shingles whose hashes are unpacked to bits at a time.
BLOCK = 65_536


def fingerprint(text: str | None, words_per_shingle: int) -> int:
    """SimHash of the text's word shingles: bit i is set if it is set in over half the hashes.

    A-Z are lower-cased; words are runs without white space (space, U+0009 to U+000D). A text of
    fewer words has one shingle, all of them; without words the fingerprint is zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    k = min(words_per_shingle, len(words))
    a, b = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, dtype=np.int64), len(a)
    for at in range(0, n, BLOCK):
        h = np.array([digest(joined[i:j], SEED) for i, j in zip(a[at : at + BLOCK], b[at : at + BLOCK], strict=True)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(words_per_shingle: int):
    """The columns before the last, which is the text, and its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words_per_shingle) for t in b.columns[-1]], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp)], [*b.schema.names[:-1], "fp"])

    return run


def _merge(root: list[int], i: int, j: int) -> bool:
    """Union-find step; true if the two were apart."""
    while root[i] != i:
        root[i] = i = root[root[i]]
    while root[j] != j:
        root[j] = j = root[root[j]]
    if i == j:
        return False
    root[max(i, j)] = min(i, j)
    return True


#: Lists up to this size are compared pair by pair; the same links connect either way.
SMALL_LIST = 32


def _connect(open_bytes: list[int], max_bits: int) -> list[tuple[int, int]]:
    """Links that connect all of ``open_bytes`` (distinct 16-bit values) within ``max_bits`` bits.

    A link already implied by others is left out. In larger lists every value is looked up under
    each mask of one or two bits: 136 look-ups a value instead of all pairs.
    """
    m = len(open_bytes)
    root = list(range(m))
    if m <= SMALL_LIST:
        close = ((i, j) for i in range(m) for j in range(i) if (open_bytes[i] ^ open_bytes[j]).bit_count() <= max_bits)
        return [(i, j) for i, j in close if _merge(root, i, j)]
    values = np.array(open_bytes)
    place = np.full(1 << 16, -1, dtype=np.int64)
    place[values] = np.arange(m)
    links = []
    for bits in (c for k in range(1, max_bits + 1) for c in combinations(range(16), k)):
        other = place[values ^ sum(1 << x for x in bits)]
        at = np.flatnonzero(other > np.arange(m))
        links += [(i, j) for i, j in zip(at.tolist(), other[at].tolist(), strict=True) if _merge(root, i, j)]
    return links


def _links(max_bits: int):
    """Tally and verify each index list: pairs of fingerprints that connect what is within ``max_bits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members, a, b = batch.column(1), [], []
            ends = members.offsets.to_numpy()
            nodes = members.flatten().to_numpy(zero_copy_only=False)
            fps = nodes.view(np.uint64)
            sets = batch.column(0).to_numpy()
            byte = fps.view(np.uint8).reshape(-1, BYTES).astype(np.int64)
            which = np.repeat(sets, np.diff(ends))
            # six positional bytes agree by the list, the guaranteed minimum; the open two decide
            value = byte[np.arange(len(byte)), OPEN[which, 0]] << 8 | byte[np.arange(len(byte)), OPEN[which, 1]]
            for lo, hi in zip((ends[:-1] - ends[0]).tolist(), (ends[1:] - ends[0]).tolist(), strict=True):
                for i, j in _connect(value[lo:hi].tolist(), max_bits):
                    a.append(nodes[lo + i])
                    b.append(nodes[lo + j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _components(prints: DataFrame, max_bits: int) -> DataFrame:
    """``node, component`` for each of the distinct fingerprints ``fp`` that links to another; the smallest is the component.

    1. the inverted index over sets of six byte positions, and its lists of two or more; 2. verified
    links, each list reduced to a connecting set; 3. components.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("the index over six of eight bytes is complete for up to 2 differing bits")
    masks = [np.uint64(sum(0xFF << (8 * p) for p in c)).astype(np.int64).item() for c in SETS]
    keys = F.array(*[F.struct(F.lit(i).alias("set"), F.col("fp").bitwiseAND(F.lit(m)).alias("bytes")) for i, m in enumerate(masks)])
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prints = prints.repartition(parts, "fp")  # few bytes, but each becomes a posting per set
    postings = prints.select("fp", F.explode(keys).alias("key")).select("key.set", "key.bytes", "fp")
    lists = postings.groupBy("set", "bytes").agg(F.collect_list("fp").alias("members")).filter(F.size("members") > 1)
    links = lists.select("set", "members").mapInArrow(_links(max_bits), "a bigint, b bigint")
    return connected_components(links, "simhash")


def simhash_groups(docs: DataFrame, words_per_shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row; ``component_id`` is the smallest id reachable.

    Fingerprints within ``max_bits`` (0 to 2) bits link; rows link by their fingerprints only, not
    by equal ids. Null and empty texts have the fingerprint zero and link like any other. Rows with
    a null id link too and get, as component, the smallest known id that they reach (null if there
    is none). Repeated rows stay rows.

    1. fingerprints, in Python tasks over whole texts; 2. distinct fingerprints with their smallest
    id, so copies meet once; 3. components of fingerprints; 4. the smallest id of each.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    rows = written(rows.mapInArrow(_fingerprints(words_per_shingle), "id bigint, fp bigint"), "simhash-fingerprints")
    reps = rows.groupBy("fp").agg(F.min("id").alias("rep"))
    comps = _components(reps.select("fp"), max_bits)
    least = reps.join(comps, reps["fp"] == comps["node"]).groupBy("component").agg(F.min("rep").alias("component_id"))
    least = written(least, "simhash-least")  # plain joins here and below: the rows of a hot key can be split
    linked = comps.join(least, "component").select("node", "component_id")
    by_fp = reps.join(linked, reps["fp"] == linked["node"], "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    hexed = F.lower(F.lpad(F.hex(F.col("fp")), 16, "0"))
    by_fp = written(by_fp, "simhash-groups")
    return rows.join(by_fp, "fp", "left").select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, words_per_shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of each component of fingerprints one row.

    It is the row with the smallest id; null ids come last, and of equal ids the first stored row
    stays. Ids decide nothing else: rows without an id, or of one id, whose texts differ all stay.
    """
    stored, number = numbered(docs, "simhash-rows")
    rows = stored.select(F.col(number).alias("row"), F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    rows = written(rows.mapInArrow(_fingerprints(words_per_shingle), "row bigint, id bigint, fp bigint"), "simhash-fingerprints")
    best = rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("x"), "id", "row")).alias("best"))
    comps = _components(best.select("fp"), max_bits)
    groups = best.join(comps, best["fp"] == comps["node"], "left").groupBy(F.coalesce("component", "fp").alias("component"))
    kept = groups.agg(F.min("best").alias("best")).select(F.col("best.row").alias(number))
    kept = written(kept, "simhash-kept").hint("merge")  # both sides grow with the documents: one plan at every size
    return stored.join(kept, number, "left_semi").drop(number)
