"""Repeated passages by a distributed sparse suffix array.

A byte is removed when a string of ``length`` bytes that covers it starts anywhere else. A full
suffix array of the corpus would move every suffix; it is enough to sort suffixes at *anchors*.
The anchor of a window of ``length`` bytes is the position of its smallest hashed ``GRAM`` bytes
(the leftmost of equals), a function of the window's content: equal windows have their anchors at
the same place. So two windows are equal exactly if, around their anchors, the same number of
bytes lies before, and the bytes before and the suffix from the anchor agree. Anchors whose gram
occurs once cannot repeat and are left out first; the others' suffixes are sorted.

Sampled splitters range-partition the suffixes by their leading bytes. Each bucket sorts its
suffixes by multikey quicksort, and the reversed bytes before them likewise; neighbouring common
prefixes give, for each offset, the classes of equal windows. Grams that a splitter cuts in two
are compared across buckets by their windows' digests.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendgrid.llm.common import written

#: Bytes of an anchor's gram.
GRAM = 32
#: Offsets of a run's windows before its anchor are packed in this many bits each.
OFFSET_BITS = 12
#: Suffixes in a bucket, and sampled suffixes for each splitter.
BUCKET_ROWS, SAMPLES_PER_BUCKET = 32_768, 64
#: Texts are hashed in stretches of this many bytes.
STRETCH = 1 << 20
MULTIPLIER = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64."""
    inverse = pow(MULTIPLIER, -1, 1 << 64)
    up, down = np.full(n, MULTIPLIER, dtype=np.uint64), np.full(n, inverse, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Grams:
    """Rolling hashes of ``GRAM`` bytes, and the anchors of windows."""

    def __init__(self, length: int):
        if length <= GRAM:
            raise ValueError(f"a repeated string must be longer than a gram of {GRAM} bytes")
        self.length, self.span = length, length - GRAM + 1
        self.up, self.down = _powers(STRETCH + length + GRAM)

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums of the polynomial hash."""
        terms = (data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)]
        return np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(terms)])

    def hashes(self, sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hash of the bytes from ``lo`` up to ``hi``."""
        return _mixed((sums[hi] - sums[lo]) * self.down[lo] + (hi - lo).astype(np.uint64))

    def anchors(self, data: np.ndarray) -> tuple[np.ndarray, ...]:
        """``(anchor, first window, last window, gram hash, digest)`` of each run of windows with
        one anchor; the digest is of all bytes of the run and of the anchor's place in it."""
        parts = []
        windows = len(data) - self.length + 1
        for at in range(0, max(windows, 0), STRETCH):
            part = data[at : min(len(data), at + STRETCH + self.length - 1)]
            sums, grams = self.sums(part), np.arange(len(part) - GRAM + 1)
            h = self.hashes(sums, grams, grams + GRAM)
            # the position in the low bits: of equal hashes the leftmost is the smallest
            key = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
            n = len(part) - self.length + 1
            blocks = -(-len(key) // self.span)
            padded = np.full(blocks * self.span, np.iinfo(np.uint64).max, dtype=np.uint64)
            padded[: len(key)] = key
            grid = padded.reshape(blocks, self.span)
            left = np.minimum.accumulate(grid, axis=1).reshape(-1)
            right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
            low = np.minimum(right[:n], left[self.span - 1 : self.span - 1 + n])
            anchor = (low & np.uint64(0xFFFFFF)).astype(np.int64)
            first = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
            last = np.concatenate([first[1:] - 1, [n - 1]])
            a = anchor[first]
            digest = _mixed(self.hashes(sums, first, last + self.length) ^ (a - first).astype(np.uint64) * np.uint64(MULTIPLIER))
            parts.append((a + at, first + at, last + at, h[a], digest))
        if not parts:
            empty = np.zeros(0, dtype=np.int64)
            return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """Order of the rows of ``words`` (unsigned, most significant first).

    Every open segment is split in three around a pivot by one word at a time, all segments at
    once: smaller, equal and larger. Equal parts go on with the next word, the others with the
    same one; segments of one row and rows out of words are closed.
    """
    n, width = words.shape
    order = np.arange(n)
    lo, hi, depth = np.array([0]), np.array([n]), np.array([0])
    while True:
        live = (hi - lo > 1) & (depth < width)
        lo, hi, depth = lo[live], hi[live], depth[live]
        if not len(lo):
            return order
        size = hi - lo
        seg = np.repeat(np.arange(len(lo)), size)
        place = np.arange(len(seg)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
        rows = order[place]
        word = words[rows, depth[seg]]
        pivot = words[order[(lo + hi) // 2], depth]
        side = np.where(word < pivot[seg], 0, np.where(word == pivot[seg], 1, 2))
        order[place] = rows[np.argsort(seg * 3 + side, kind="stable")]
        counts = np.bincount(seg * 3 + side, minlength=3 * len(lo)).reshape(-1, 3)
        cut = lo[:, None] + np.cumsum(counts, axis=1)
        depth = np.concatenate([depth, depth + 1, depth])
        lo, hi = np.concatenate([lo, cut[:, 0], cut[:, 1]]), np.concatenate([cut[:, 0], cut[:, 1], cut[:, 2]])


def common_prefixes(sorted_bytes: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the row before it (the first: -1)."""
    differs = sorted_bytes[1:] != sorted_bytes[:-1]
    lcp = np.where(differs.any(axis=1), differs.argmax(axis=1), sorted_bytes.shape[1])
    return np.concatenate([[-1], lcp])


def sorted_neighbours(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte rows by multikey quicksort on eight bytes at a time, and neighbours' common prefixes."""
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order = multikey_quicksort(words)
    return order, common_prefixes(rows[order])


def window_classes(after: np.ndarray, before: np.ndarray, shortest: np.ndarray, longest: np.ndarray, length: int):
    """For each offset ``d``: members (suffixes whose run has a window ``d`` bytes before the
    anchor) and the class of equal windows of each. Windows are equal exactly if the reversed
    bytes before agree in ``d`` bytes and the suffixes in ``length - d``."""
    order_a, lcp_a = sorted_neighbours(after)
    order_b, lcp_b = sorted_neighbours(before)
    class_a, class_b = np.empty(len(after), dtype=np.int64), np.empty(len(after), dtype=np.int64)
    for d in range(int(shortest.min()), int(longest.max()) + 1):
        members = np.flatnonzero((shortest <= d) & (d <= longest))
        if len(members) == 0:
            continue
        class_a[order_a] = np.cumsum(lcp_a < length - d)
        class_b[order_b] = np.cumsum(lcp_b < d)
        _, label = np.unique(class_a[members] * (len(after) + 1) + class_b[members], return_inverse=True)
        yield d, members, label


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _pack(anchor, shortest, longest):
    """Anchor position and the smallest and largest offset of its windows in one number."""
    return (anchor << (2 * OFFSET_BITS)) | (shortest << OFFSET_BITS) | longest


def _unpack(place):
    mask = (1 << OFFSET_BITS) - 1
    return place >> (2 * OFFSET_BITS), (place >> OFFSET_BITS) & mask, place & mask


def _anchor_rows(length: int):
    """One row for each anchor: ``gram, digest, k, place, lead`` (first four bytes, and text size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(length)
        for b in batches:
            columns, held = [[] for _ in range(5)], 0

            def rows():
                out = pa.RecordBatch.from_arrays([_longs(np.concatenate(c)) for c in columns], ["gram", "digest", "k", "place", "lead"])  # noqa: B023
                for c in columns:  # noqa: B023
                    c.clear()
                return out

            for k, text in zip(b.column(0).to_numpy(zero_copy_only=False), b.column(1), strict=True):
                data = np.frombuffer(text.as_buffer() or b"", dtype=np.uint8) if text.is_valid else np.zeros(0, dtype=np.uint8)
                if len(data) < length:
                    continue
                anchor, first, last, gram, digest = grams.anchors(data)
                lead = np.zeros(len(anchor), dtype=np.int64)
                for i in range(4):
                    lead = lead << 8 | data[anchor + i]
                found = (gram, digest, np.full(len(anchor), k), _pack(anchor, anchor - last, anchor - first), lead << 32 | len(data))
                for c, x in zip(columns, found, strict=True):
                    c.append(x)
                held += len(anchor)
                if held >= 1 << 18:
                    held = 0
                    yield rows()
            if held:
                yield rows()

    return run


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts cross the shuffle as zstd frames."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for b in batches:
        z = [pack(t.as_buffer().to_pybytes()) for t in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(z, pa.binary())], ["k", "n", "z"])


def _suffixes(splitters: list[tuple[int, int, int]], length: int):
    """The bytes around each anchor that is to be sorted, and its bucket by the sampled splitters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for k, n, z, anchors in zip(*(b.column(i) for i in range(4)), strict=True):
                text, out = unpack(z.as_buffer()), {c: [] for c in ("bucket", "place", "gram", "lead", "single", "bytes")}
                for a in anchors.as_py():
                    at, shortest, longest = _unpack(a["place"])
                    out["bytes"].append(text[at - longest : at - shortest + length])
                    out["bucket"].append(bisect_right(splitters, (a["lead"], a["gram"], a["tie"])))
                    for c in ("place", "gram", "lead", "single"):
                        out[c].append(a[c])
                size = len(out["place"])
                head = {"k": pa.array([k.as_py()] * size, pa.int64()), "n": pa.array([n.as_py()] * size, pa.int32())}
                yield pa.RecordBatch.from_pydict(
                    head | {"bucket": pa.array(out.pop("bucket"), pa.int32()), "bytes": pa.array(out.pop("bytes"), pa.binary())} | {c: pa.array(v) for c, v in out.items()}
                )

    return run


def _spans_of(repeated: np.ndarray, first_offset: int) -> Iterator[tuple[int, int]]:
    """Runs of true in a row of offsets, as (smallest, largest offset)."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], repeated, [False]]).astype(np.int8)))
    for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        yield lo + first_offset, hi - 1 + first_offset


def _sort_bucket(length: int, cut: set[tuple[int, int]]):
    """Sort a bucket's suffixes and compare neighbours. Rows out: the repeated stretches of texts,
    and for grams that a splitter cuts the digest of each class of equal windows."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        place, gram, lead = (table.column(c).to_numpy() for c in ("place", "gram", "lead"))
        k, n, single = (table.column(c).to_numpy() for c in ("k", "n", "single"))
        at, shortest, longest = _unpack(place)
        column = table.column("bytes").chunk(0)
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(column.buffers()[2], dtype=np.uint8)
        anchor = offsets[:-1] + longest

        def stretch(width, step, room):
            width = -(-width // 8) * 8
            reach = np.arange(width)
            index = anchor[:, None] + (reach if step > 0 else -1 - reach)
            inside = reach < room[:, None]
            return np.where(inside, data[np.where(inside, index, 0)], 0).astype(np.uint8)

        after = stretch(length - int(shortest.min()), 1, length - shortest)
        before = stretch(max(int(longest.max()), 1), -1, longest)
        is_cut = np.array([(x, y) in cut for x, y in zip(lead.tolist(), gram.tolist(), strict=True)], dtype=bool)
        low = int(shortest.min())
        repeated = np.zeros((len(at), int(longest.max()) - low + 1), dtype=bool)
        out = {c: [] for c in ("k", "n", "start", "stop", "window", "members")}

        def row(i, start, stop, window=None, members=None):
            for c, v in zip(out, (int(k[i]), int(n[i]), start, stop, window, members), strict=True):
                out[c].append(v)

        for d, members, label in window_classes(after, before, shortest, longest, length):
            _, firsts, count = np.unique(label, return_index=True, return_counts=True)
            repeated[members, d - low] = count[label] > 1
            heads = members[firsts]
            for i, c in zip(heads[is_cut[heads]].tolist(), count[is_cut[heads]].tolist(), strict=True):
                # one row a class for the other buckets; a class of one asks for its own window
                alone, start = c == 1 and single[i], int(at[i]) - d
                window = data[anchor[i] - d : anchor[i] - d + length].tobytes()
                row(i, start if alone else None, start + length if alone else None, blake2b(window, digest_size=16).digest(), c)
        for i in np.flatnonzero(single & repeated.any(axis=1)).tolist():
            for d0, d1 in _spans_of(repeated[i], low):
                row(i, int(at[i]) - d1, int(at[i]) - d0 + length)
        kinds = {"k": pa.int64(), "n": pa.int32(), "start": pa.int64(), "stop": pa.int64(), "window": pa.binary(), "members": pa.int64()}
        return pa.table({c: pa.array(v, kinds[c]) for c, v in out.items()})

    return run


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union of ``[start, stop)`` stretches; touching ones join."""
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for b in batches:
        rows = []
        for z, spans in zip(b.column(2), b.column(3), strict=True):
            text, runs = unpack(z.as_buffer()), merged_spans([(s["start"], s["stop"]) for s in spans.as_py()])
            keep, at = sha256(), 0
            for start, stop in runs:
                keep.update(text[at:start])
                at = stop
            keep.update(text[at:])
            rows.append((sum(y - x for x, y in runs), len(runs), keep.hexdigest(), [{"start": x, "stop": y} for x, y in runs]))
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
        arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *arrays], ["k", "n", "n_removed", "n_spans", "kept_sha256", "spans"])


def _splitters(reps: DataFrame, rows: int) -> list[tuple[int, int, int]]:
    """Sorted splitters from a sample of the suffixes' leading bytes, gram and a tie-break, so that
    a gram with more suffixes than a bucket holds is dealt over several."""
    buckets = -(-rows // BUCKET_ROWS)
    if buckets <= 1:
        return []
    share = min(1.0, buckets * SAMPLES_PER_BUCKET / rows)
    picked = F.pmod(F.xxhash64("tie"), F.lit(1_000_000)) < int(share * 1_000_000) + 1
    sample = sorted((r["lead"], r["gram"], r["tie"]) for r in reps.filter(picked).select("lead", "gram", "tie").collect())
    return [sample[i * len(sample) // buckets] for i in range(1, buckets)] if sample else []


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row; with ``spans`` the removed stretches too.

    A text counts as its UTF-8 bytes (null: none); matches never cross documents. Every byte is
    removed that a string of ``length`` bytes covers which also starts anywhere else, in the same
    text or another, overlaps included, judged on the input. Rows with equal texts repeat each
    other whole; texts shorter than ``length`` keep all. Repeated ids are rows like others.

    Texts are keyed by content (64-bit hash and size), so copies are sorted and rewritten once.
    1. anchors of all texts; 2. runs of equal bytes around an anchor are found repeated by their
    digests, and one of each different run of a repeated gram goes on;
    3. their suffixes are bucketed by sampled splitters and sorted; 4. cut grams are compared
    across buckets; 5. stretches are united per text and applied. Texts move twice, compressed,
    and pre-aggregated by content; a very common gram is counted by partial aggregates and joined
    in splits, so no task has to take all its anchors.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("k", F.xxhash64("text")).withColumn("n", F.octet_length("text"))
    anchors = keyed.select("k", "text").mapInArrow(_anchor_rows(length), "gram bigint, digest bigint, k bigint, place bigint, lead bigint")
    anchors = written(anchors.withColumn("tie", F.xxhash64("k", "place")), "repeat-anchors")
    # grams that occur once cannot repeat; what is counted is combined before it is shuffled, and
    # the joins that bring it back to the anchors can be split where a gram is very common
    grams = anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("c"), F.min("digest").alias("low"), F.max("digest").alias("high"))
    grams = grams.filter("c > 1").select("gram", (F.col("low") != F.col("high")).alias("differ"))
    anchors = written(anchors.join(written(grams, "repeat-grams"), "gram"), "repeat-candidates")
    runs = anchors.groupBy("gram", "digest").agg(F.count(F.lit(1)).alias("c"), F.min("tie").alias("first"), F.first("differ").alias("_differ"))
    runs = written(runs.filter("c > 1 OR _differ").select("gram", "digest", "c", "first"), "repeat-runs")
    marked = anchors.join(runs, ["gram", "digest"])
    marked = marked.withColumn("repeated", F.col("c") > 1).withColumn("sorts", F.col("differ") & (F.col("tie") == F.col("first")))
    marked = marked.filter("repeated OR sorts").select(
        F.when(F.col("sorts"), F.col("gram")).alias("gram"), "k", "place", F.shiftrightunsigned("lead", 32).alias("lead"),
        F.col("lead").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("n"), "repeated", "sorts", "tie",
    )
    marked = written(marked, "repeat-marked")
    reps = marked.filter("sorts").select("gram", "lead", "k", "n", "place", (~F.col("repeated")).alias("single"), "tie").distinct()
    splitters = _splitters(reps, reps.count())
    texts = keyed.select("k", "n", "text").mapInArrow(_compressed, "k bigint, n int, z binary").groupBy("k", "n").agg(F.first("z").alias("z"))
    of_text = written(reps.groupBy("k", "n").agg(F.collect_list(F.struct("place", "gram", "lead", "tie", "single")).alias("anchors")), "repeat-suffixes")
    suffixes = texts.join(of_text, ["k", "n"]).select("k", "n", "z", "anchors")
    kinds = "k bigint, n int, bucket int, bytes binary, place bigint, gram bigint, lead bigint, single boolean"
    found = suffixes.mapInArrow(_suffixes(splitters, length), kinds).groupBy("bucket")
    cut = {(lead, gram) for lead, gram, _ in splitters}
    found = found.applyInArrow(_sort_bucket(length, cut), "k bigint, n int, start bigint, stop bigint, window binary, members bigint")
    found = written(found, "repeat-found")
    everywhere = F.sum("members").over(Window.partitionBy("window"))  # at most one row a bucket
    across = found.filter("window IS NOT NULL").withColumn("total", everywhere).filter("start IS NOT NULL AND total > 1")
    at = F.shiftright("place", 2 * OFFSET_BITS)
    mask = F.lit((1 << OFFSET_BITS) - 1)
    shortest, longest = F.shiftright("place", OFFSET_BITS).bitwiseAND(mask), F.col("place").bitwiseAND(mask)
    stretches = marked.filter("repeated").select("k", "n", (at - longest).alias("start"), (at - shortest + length).alias("stop"))
    for more in (found.filter("window IS NULL"), across):
        stretches = stretches.unionByName(more.select("k", "n", "start", "stop"))
    of_text = written(stretches.groupBy("k", "n").agg(F.collect_set(F.struct("start", "stop")).alias("spans")), "repeat-spans")
    kinds = "k bigint, n int, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,stop:bigint>>"
    done = texts.join(of_text, ["k", "n"]).select("k", "n", "z", "spans").mapInArrow(_removed, kinds)
    done = written(done if spans else done.drop("spans"), "repeat-removed")
    rows = keyed.select("id", "k", "n", F.sha2("text", 256).alias("whole"))
    j = rows.join(done, ["k", "n"], "left")
    out = [
        F.col("id").alias(id_col), F.col("n").cast("bigint").alias("n_bytes"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"),
    ]
    return j.select(*out, *(["spans"] if spans else []))
