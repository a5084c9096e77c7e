"""Removal of repeated passages with enhanced suffix arrays.

A byte goes if a string of LENGTH bytes that covers it also starts earlier
(smaller doc_id, or the same document and an earlier start). Matches never
cross documents.

1. Anchors. A rolling hash picks the smallest GRAM-byte gram of every window;
   equal strings of LENGTH bytes hold the same anchor at the same place, so
   only anchors (one for about forty bytes) are shuffled, each with a digest
   (128 bits of BLAKE2b) of its context: all strings of LENGTH bytes that hold
   the anchor. The rolling hash only deals anchors out; contexts count as equal
   by their digests alone.
2. Leaves. Occurrences of an anchor with equal contexts are one leaf of the
   interval tree: a repeat as long as the context. A task merges its own
   before the shuffle. An anchor that has very many contexts is hot: its leaves
   are dealt by digest, not by anchor, and merged once more. Anchors with
   several different contexts go on.
3. Tree. The first occurrence of each different context brings its bytes. Per
   anchor the suffixes from the anchor on are sorted into a suffix array with
   common prefix lengths; a stack scan gives its interval tree. Within each
   interval the reversed left contexts are sorted and scanned in the same
   way; where the left extensions differ ends a left-maximal repeat. Intervals
   that are diverse on both sides are the maximal repeat groups, reported with
   all their occurrences.
4. Removal. Every occurrence but the first of each group loses its bytes.

An anchor with more than HOT different contexts is lengthened before its tree
is built. Strings of LENGTH bytes start 0 to LEFT bytes left of the anchor; the
starts are halved, each half has a longer core that all its strings share, and
contexts are dealt by these cores, each with a tree of its own, and halved again
until the groups are small. Contexts that are equal as far as a half's strings
reach are one leaf of it and merged, so a passage that very many documents
share stays two rows a level. No size changes a result.

Defined results: a null text is empty; texts shorter than LENGTH keep all; a
null doc_id sorts before all others; rows that repeat a doc_id are documents
of their own, ordered by the SHA-256 of their text, unless their texts are equal
too: then they are one document in two rows. Extra columns pass through; one
that bears the name of an output column is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.arrow import binary_array, pieces, tidy, utf8_bytes
from citeloom.session import written

LENGTH, GRAM = 100, 24
LEFT = LENGTH - GRAM
#: Different contexts of an anchor from which it is lengthened, and rows of one anchor that a task holds.
HOT, HELD = 20_000, 500_000
#: Contexts of one gram that a task may have, at least, before it deals them by digest.
OFTEN = 16
#: Window starts that are hashed at a time, and anchors that a task merges at a time.
BLOCK, MERGED = 1 << 20, 500_000
BASE = 0x9E3779B97F4A7C15
OUTPUT = ("kept", "n_bytes", "n_removed", "n_spans")


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Polynomial hashes modulo 2**64 of all grams of a block."""

    size = BLOCK + 4 * LENGTH
    table = np.random.default_rng(11).integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    up: np.ndarray | None = None
    down: np.ndarray | None = None

    def __init__(self, raw: np.ndarray):
        if Hasher.up is None:
            Hasher.up, Hasher.down = _powers(BASE, self.size), _powers(pow(BASE, -1, 2**64), self.size)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.table[raw] * self.up[: len(raw)], out=self.sums[1:])

    def grams(self) -> np.ndarray:
        n = len(self.sums) - GRAM
        return self.mixed((self.sums[GRAM:] - self.sums[:-GRAM]) * self.down[:n])

    @staticmethod
    def mixed(h: np.ndarray) -> np.ndarray:
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
        return h


def digests(raw: np.ndarray, start: np.ndarray, end: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BLAKE2b of each raw[start:end], as two longs; with the bytes left of the anchor, as contexts differ by these too."""
    view, new = memoryview(np.ascontiguousarray(raw)), hashlib.blake2b
    each = b"".join([new(view[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    both = np.frombuffer(each, np.uint64).reshape(-1, 2)
    return (both[:, 0] ^ left.astype(np.uint64) * np.uint64(BASE)).view(np.int64), both[:, 1].copy().view(np.int64)


def anchors(raw: np.ndarray, start: np.ndarray, end: np.ndarray, first: int, last: int) -> tuple[np.ndarray, ...]:
    """Anchors of the strings of LENGTH bytes that start in [first, last) and end in their document.

    start, end: of each document in raw. Gives anchor positions, documents,
    gram hashes (48 bits), both halves of the contexts' digests and bytes right of the anchor.
    """
    none = (np.zeros(0, np.int64),) * 6
    if len(raw) < LENGTH:
        return none
    hasher, wide = Hasher(raw), LENGTH - GRAM + 1
    gram = hasher.grams()
    low = np.uint64((1 << 24) - 1)
    key = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)  # the leftmost of equal grams
    grid = np.concatenate([key, np.full(-len(key) % wide, 2**64 - 1, np.uint64)]).reshape(-1, wide)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: len(key) - wide + 1], ahead[wide - 1 : len(key)])
    inside = np.zeros(len(raw) + 1, np.int8)
    fits = end - start >= LENGTH
    np.add.at(inside, start[fits], 1)
    np.add.at(inside, end[fits] - LENGTH + 1, -1)
    valid = np.cumsum(inside[: len(least)], dtype=np.int8).astype(bool)
    valid[:first] = False
    valid[last:] = False
    at = (least[valid] & low).astype(np.int64)
    at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
    if not len(at):
        return none
    doc = np.searchsorted(start, at, side="right") - 1
    left = np.minimum(LEFT, at - start[doc])
    right = np.minimum(LENGTH, end[doc] - at)
    return at, doc, (gram[at] >> np.uint64(16)).astype(np.int64), *digests(raw, at - left, at + right, left), right


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of documents with those that overlap or touch joined."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    turn = np.append(0, np.cumsum(doc[1:] != doc[:-1]))
    reach = np.maximum.accumulate(end + turn * (1 << 40)) - turn * (1 << 40)
    new = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1]))
    at = np.flatnonzero(new)
    return doc[at], start[at], np.maximum.reduceat(end, at)


def spans_of(doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, starts and ends of contexts, given as pos * 128 + bytes right of the anchor."""
    at = pos >> 7
    return merged(doc, at - np.minimum(LEFT, at), at + (pos & 127))


def leaves(gram, one, two, doc, pos) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the occurrences, which of them are the first of their leaf, and where a gram begins."""
    order = np.lexsort((pos, doc, two, one, gram))
    g, x, y = gram[order], one[order], two[order]
    begin = np.append(True, g[1:] != g[:-1])
    return order, begin | np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])), begin


def _anchor_rows(docs: DataFrame, often: int) -> DataFrame:
    """gram, salt, one, two (digest), doc, pos (with the bytes right of it) of all anchors.

    Spans that a task knows already come with gram < 0: doc, pos (start) and
    one (end). A gram with more than `often` contexts in a task is hot: each
    of its rows has a salt by its digest, and a row with pos -1 says so.
    """

    def found(batches):
        for batch in pieces(batches, "text", BLOCK):
            raw, at = utf8_bytes(batch.column("text"))
            sid, row = batch.column("sid").to_numpy(), 0
            while row < len(sid):  # several short documents, or one block after another of a long one
                if at[row + 1] - at[row] <= BLOCK:
                    stop = max(row + 1, int(np.searchsorted(at, at[row] + BLOCK, side="right")) - 1)
                    part, base = raw[at[row] : at[stop]], at[row:stop] - at[row]
                    p, d, g, x, y, r = anchors(part, base, at[row + 1 : stop + 1] - at[row], 0, len(part))
                    yield g, x, y, sid[row + d], (p - base[d]) << 7 | r
                    row = stop
                    continue
                whole, last = raw[at[row] : at[row + 1]], -1
                for low in range(0, len(whole), BLOCK):
                    begin, finish = max(0, low - LENGTH), min(len(whole), low + BLOCK + 2 * LENGTH)
                    part = whole[begin:finish]
                    p, d, g, x, y, r = anchors(part, np.zeros(1, np.int64), np.array([len(part)]), low - begin, min(low + BLOCK, len(whole)) - begin)
                    new = p + begin > last  # the block before may have met the first ones
                    p, d, g, x, y, r = p[new], d[new], g[new], x[new], y[new], r[new]
                    last = int(p[-1]) + begin if len(p) else last
                    yield g, x, y, sid[row + d], (p + begin) << 7 | r
                row += 1

    def flush(held):
        g, x, y, d, p = (np.concatenate(c) for c in zip(*held, strict=True))
        if not len(g):
            return
        order, first, begin = leaves(g, x, y, d, p)
        g, x, y, d, p = g[order], x[order], y[order], d[order], p[order]
        doc, start, end = spans_of(d[~first], p[~first])
        long = end - start >= LENGTH
        doc, start, end = doc[long], start[long], end[long]
        spread = -1 - (doc.view(np.uint64) * np.uint64(BASE) >> np.uint64(20)).astype(np.int64)
        starts = np.flatnonzero(begin)
        contexts = np.add.reduceat(first.astype(np.int64), starts)
        hot = contexts > often
        salt = np.where(np.repeat(hot, np.diff(np.append(starts, len(g)))), 1 + (x & 1023), 0).astype(np.int32)
        said = g[starts[hot]]
        none, known = np.zeros(len(said), np.int64), np.zeros(len(doc), np.int64)
        columns = [np.concatenate(c) for c in ((g[first], spread, said), (salt[first], known.astype(np.int32), none.astype(np.int32)), (x[first], end, none), (y[first], known, none), (d[first], doc, none), (p[first], start, none - 1))]
        for i in range(0, len(columns[0]), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 200_000]) for c in columns], names=["gram", "salt", "one", "two", "doc", "pos"])

    def run(batches):
        held, n = [], 0
        for rows in found(batches):
            held.append(rows)
            n += len(rows[0])
            if n >= MERGED:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)

    return docs.mapInArrow(tidy(run), "gram long, salt int, one long, two long, doc long, pos long")


LEAF = "doc long, kind byte, a long, b long, one long, two long"


def _settled(g, s, x, y, d, p, hot: np.ndarray) -> pa.RecordBatch:
    """What the rows of some grams come to; hot: grams of which other rows are elsewhere."""
    known = g < 0
    zero = lambda n: np.zeros(n, np.int64)
    out = [(d[known], np.zeros(known.sum(), np.int8), p[known], x[known], zero(known.sum()), zero(known.sum()))]
    hot = np.union1d(hot, np.concatenate([g[p < 0], g[s > 0]]))
    own = ~known & (p >= 0)
    g, x, y, d, p = g[own], x[own], y[own], d[own], p[own]
    if len(g):
        order, first, begin = leaves(g, x, y, d, p)
        g, x, y, d, p = g[order], x[order], y[order], d[order], p[order]
        starts = np.flatnonzero(begin)
        several = np.repeat(np.add.reduceat(first.astype(np.int64), starts) > 1, np.diff(np.append(starts, len(g))))
        doc, start, end = spans_of(d[~first], p[~first])
        out.append((doc, np.zeros(len(doc), np.int8), start, end, zero(len(doc)), zero(len(doc))))
        apart = np.isin(g, hot) if len(hot) else np.zeros(len(g), bool)
        need, later = first & several & ~apart, first & apart
        out.append((d[need], np.ones(need.sum(), np.int8), p[need] >> 7, g[need], zero(need.sum()), zero(need.sum())))
        out.append((d[later], np.full(later.sum(), 2, np.int8), p[later], g[later], x[later], y[later]))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc", "kind", "a", "b", "one", "two"])


def _repeated_leaves(rows: DataFrame, most: int) -> DataFrame:
    """doc, kind, a, b, one, two: what is known of leaves when each gram's rows (or a hot gram's salted ones) have met.

    Kind 0: spans (start, end) that repeat. Kind 1: first occurrences (pos,
    gram) of contexts whose gram has others. Kind 2: those of hot grams (pos
    with the bytes right of it, gram, digest), to be merged once more. A gram
    with over `most` rows is hot, too, so that a task never holds more.
    """

    def run(batches):
        held: list[list[np.ndarray]] = []
        n, hot = 0, np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column(k).to_numpy() for k in ("gram", "salt", "one", "two", "doc", "pos")])
            n += batch.num_rows
            last = held[-1][0][-1]
            if n >= 100_000 and held[0][0][0] != last:
                columns = [np.concatenate(c) for c in zip(*held, strict=True)]
                cut = int(np.searchsorted(columns[0], last))
                yield _settled(*(c[:cut] for c in columns), hot)
                held, n, hot = [[c[cut:] for c in columns]], len(columns[0]) - cut, hot[hot == last]
            if n >= most:
                hot = np.array([last])
                yield _settled(*(np.concatenate(c) for c in zip(*held, strict=True)), hot)
                held, n = [], 0
        if n:
            yield _settled(*(np.concatenate(c) for c in zip(*held, strict=True)), hot)

    dealt = rows.repartition("gram", "salt").sortWithinPartitions("gram", "salt")
    return dealt.mapInArrow(tidy(run), LEAF)


def _hot_leaves(leaf: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans (doc, a, b) and first occurrences (doc, a: pos, b: gram) of hot grams, whose leaves lay in several tasks."""
    rows, key = leaf.filter("kind = 2"), ["b", "one", "two"]
    first = written(rows.groupBy(*key).agg(F.min(F.struct("doc", "a")).alias("first")), "firsts")
    later = rows.join(first, key).filter(F.struct("doc", "a") > F.col("first"))
    at = F.shiftright("a", 7)
    spans = later.select("doc", F.greatest(at - LEFT, F.lit(0)).alias("a"), (at + F.col("a").bitwiseAND(F.lit(127))).alias("b"))
    return spans, first.select("first.doc", F.shiftright("first.a", 7).alias("a"), "b")


def _contexts(docs: DataFrame, needs: DataFrame) -> DataFrame:
    """gram, doc, pos, left and bytes of the contexts that are asked for."""
    asked = needs.groupBy(F.col("doc").alias("sid")).agg(F.collect_list(F.struct("a", "b")).alias("asked"))
    joined = docs.join(asked, "sid").select("sid", F.col("asked.a").alias("pos"), F.col("asked.b").alias("gram"), "text")

    def run(batches):
        for batch in pieces(batches, "text", 4 << 20):
            raw, at = utf8_bytes(batch.column("text"))
            size = batch.column("pos").value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), size)
            pos, gram = (batch.column(k).flatten().to_numpy() for k in ("pos", "gram"))
            left = np.minimum(LEFT, pos)
            right = np.minimum(LENGTH, at[row + 1] - at[row] - pos)
            n = left + right
            end = np.cumsum(n)
            take = np.repeat(at[row] + pos - left - (end - n), n) + np.arange(int(end[-1]) if len(end) else 0)
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(batch.column("sid").to_numpy()[row]), pa.array(pos), pa.array(left.astype(np.int32)), binary_array(raw[take], n)], names=["gram", "doc", "pos", "left", "bytes"])

    return joined.mapInArrow(tidy(run), "gram long, doc long, pos long, left int, bytes binary")


def intervals(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """The common-prefix intervals (first, last, depth) of depth least or more: one scan with a stack.

    lcp[i] belongs to suffixes i - 1 and i; lcp[0] is 0.
    """
    stack = [(0, 0)]
    for i, depth in enumerate([*lcp.tolist()[1:], 0], 1):
        first = i - 1
        while stack[-1][1] > depth:
            first, had = stack.pop()
            if had >= least:
                yield first, i - 1, had
        if stack[-1][1] < depth:
            stack.append((first, depth))


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix, row by row."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def _sorted_rows(gram: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Order by gram, then by the bytes of a row, of which sizes count and the rest are 0."""
    pad = np.zeros((len(rows), -rows.shape[1] % 8 + rows.shape[1]), np.uint8)
    pad[:, : rows.shape[1]] = rows
    words = pad.view(">u8").astype(np.uint64)
    return np.lexsort((sizes, *words.T[::-1], gram))


def repeat_groups(gram: np.ndarray, left: np.ndarray, lengths: np.ndarray, raw: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Maximal repeats among the contexts of each gram: bytes left and right of the anchor, and all occurrences.

    Contexts of a gram are all different; raw has their bytes one after another.
    """
    n = len(gram)
    right = lengths - left
    at = np.cumsum(lengths) - lengths + left
    padded = np.concatenate([np.zeros(LEFT, np.uint8), raw, np.zeros(LENGTH, np.uint8)]).astype(np.int16)
    # Bytes to the right and, reversed, to the left; places beyond a document are 256.
    after = padded[LEFT + at[:, None] + np.arange(LENGTH)]
    before = padded[LEFT + at[:, None] - 1 - np.arange(LEFT)]
    after_in, before_in = np.arange(LENGTH) < right[:, None], np.arange(LEFT) < left[:, None]
    order = _sorted_rows(gram, np.where(after_in, after, 0).astype(np.uint8), right)
    after[~after_in], before[~before_in] = 256, 257
    sa_after, sa_before, sa_gram = after[order], before[order], gram[order]
    ends, begins = right[order], left[order]
    lcp = np.zeros(n, np.int64)
    lcp[1:] = np.where(sa_gram[1:] == sa_gram[:-1], np.minimum(_common(sa_after[1:], sa_after[:-1]), np.minimum(ends[1:], ends[:-1])), 0)
    beside = np.zeros(n, np.int64)
    beside[1:] = np.minimum(_common(sa_before[1:], sa_before[:-1]), np.minimum(begins[1:], begins[:-1]))
    for first, last, depth in intervals(lcp, GRAM):
        if last == first + 1:
            if beside[last] + depth >= LENGTH:
                yield int(beside[last]), depth, order[first : last + 1]
            continue
        own = np.arange(first, last + 1)
        child = np.append(0, np.cumsum(lcp[first + 1 : last + 1] == depth))
        by_left = _sorted_rows(np.zeros(len(own), np.int64), np.where(sa_before[own] > 255, 0, sa_before[own]).astype(np.uint8), begins[own])
        own, child = own[by_left], child[by_left]
        shared = np.zeros(len(own), np.int64)
        shared[1:] = np.minimum(_common(sa_before[own[1:]], sa_before[own[:-1]]), np.minimum(begins[own[1:]], begins[own[:-1]]))
        wanted = max(LENGTH - depth, 0)
        if wanted == 0:  # all members share enough on the right alone
            low = int(shared[1:].min())
            if low == 0:
                yield 0, depth, order[own]
        for a, b, common in intervals(shared, max(wanted, 1)):
            if (child[a : b + 1] != child[a]).any():
                yield common, depth, order[own[a : b + 1]]


def _tree_spans(contexts: DataFrame) -> DataFrame:
    """doc, a, b: spans of all occurrences but the first of each maximal repeat group."""

    def settle(gram, doc, pos, left, lengths, raw):
        out: list[list[np.ndarray]] = [[], [], []]
        size = 0
        for low, high, own in repeat_groups(gram, left, lengths, raw):
            d, p = doc[own], pos[own]
            keep = np.lexsort((p, d))[1:]
            out[0].append(d[keep])
            out[1].append(p[keep] - low)
            out[2].append(p[keep] + high)
            size += len(keep)
            if size > 50_000:  # nested groups name the same bytes again and again
                out = [[x] for x in merged(*(np.concatenate(x) for x in out))]
                size = 0
        if not out[0]:
            return
        d, a, b = merged(*(np.concatenate(x) for x in out))
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(a), pa.array(b)], names=["doc", "a", "b"])

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            blob = batch.column("bytes")
            lengths = pc.binary_length(blob).to_numpy(zero_copy_only=False).astype(np.int64)
            offsets = np.frombuffer(blob.buffers()[1], np.int32)[blob.offset : blob.offset + len(blob) + 1]
            raw = np.frombuffer(blob.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            held.append((*(batch.column(k).to_numpy() for k in ("gram", "doc", "pos", "left")), lengths, raw))
            n += batch.num_rows
            last = held[-1][0][-1]
            if n >= 4_000 and held[0][0][0] != last:
                columns = [np.concatenate(x) for x in zip(*held, strict=True)]
                cut = int(np.searchsorted(columns[0], last))
                edge = int(columns[4][:cut].sum())
                yield from settle(*(x[:cut] for x in columns[:5]), columns[5][:edge])
                held, n = [(*(x[cut:] for x in columns[:5]), columns[5][edge:])], len(columns[0]) - cut
        if n:
            yield from settle(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return contexts.mapInArrow(tidy(run), "doc long, a long, b long")


def lengthened(contexts: DataFrame) -> DataFrame:
    """Contexts (gram, doc, pos, left, bytes, low, high) dealt by longer cores, and cut to what their strings reach.

    low, high: how far left of the anchor the strings of LENGTH bytes start
    that a group is about. All of them share the core from low bytes left of
    the anchor to LENGTH - high right of it.
    """
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    right = F.octet_length("bytes") - F.col("left")
    each = []
    for low, high in ((F.col("low"), middle), (middle + 1, F.col("high"))):
        core = F.substring("bytes", F.col("left") - low + 1, low + LENGTH - high)
        left = F.least(high, "left")
        reach = F.substring("bytes", F.col("left") - left + 1, left + F.least(right, LENGTH - low))
        holds = (low <= high) & (F.greatest(low, LENGTH - right) <= left)
        each.append(F.when(holds, F.struct(F.xxhash64("gram", low, high, core).alias("gram"), left.alias("left"), reach.alias("bytes"), low.alias("low"), high.alias("high"))))
    dealt = contexts.select("doc", "pos", F.explode(F.array_compact(F.array(*each))).alias("to"))
    return dealt.select("to.gram", "doc", "pos", "to.left", "to.bytes", "to.low", "to.high")


def _split(contexts: DataFrame, big: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contexts in groups of at most HOT, and spans (doc, a, b) of equal ones found on the way. big: gram of larger groups."""
    columns, leaf = ["gram", "doc", "pos", "left", "bytes"], ["gram", "left", "bytes", "low", "high"]
    contexts = written(contexts, "contexts")
    small = contexts.join(big, "gram", "left_anti").select(columns)
    large = contexts.join(big, "gram", "left_semi").select(*columns, F.lit(0).alias("low"), F.lit(LEFT).alias("high"))
    spans = None
    while True:  # seven times at most: the starts halve, and a group with one start is one leaf
        grown = written(lengthened(large), "lengthened")
        firsts = written(grown.groupBy(*leaf).agg(F.min(F.struct("doc", "pos")).alias("first"), F.count(F.lit(1)).alias("n")), "firsts")
        later = grown.join(firsts.filter("n > 1").select(*leaf, "first"), leaf).filter(F.struct("doc", "pos") > F.col("first"))
        found = later.select("doc", (F.col("pos") - F.col("left")).alias("a"), (F.col("pos") - F.col("left") + F.octet_length("bytes")).alias("b"))
        spans = found if spans is None else spans.unionByName(found)
        grown = firsts.select("gram", "first.doc", "first.pos", "left", "bytes", "low", "high")
        big = written(grown.groupBy("gram").count().filter(F.col("count") > HOT).select("gram"), "hot")
        small = small.unionByName(grown.join(big, "gram", "left_anti").select(columns))
        if big.isEmpty():
            return small, spans
        large = grown.join(big, "gram", "left_semi").select(*columns, "low", "high")


def with_order_key(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs with __sid: a long that orders documents by doc_id, one for each different (doc_id, text).

    And whether doc_ids repeat or are null; only then is it not doc_id itself.
    """
    odd = docs.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1")
    if odd.isEmpty():
        return docs.withColumn("__sid", F.col("doc_id")), False
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    pairs = docs.select("doc_id", digest.alias("__th")).distinct().sort(F.asc_nulls_first("doc_id"), "__th")
    ranks = written(pairs.withColumn("__sid", F.monotonically_increasing_id()), "ranks")  # ids follow the order of the partitions
    keyed = docs.withColumn("__th", digest)
    same = keyed["doc_id"].eqNullSafe(ranks["doc_id"]) & (keyed["__th"] == ranks["__th"])
    return keyed.join(ranks, same).select(*[keyed[c] for c in docs.columns], ranks["__sid"]), True


def repeated_spans(texts: DataFrame) -> DataFrame:
    """doc, a, b: spans to remove. texts: sid (unique), text."""
    # A gram that has more of a task's anchors than a few partitions' fair share is hot.
    often = max(OFTEN, 4 * MERGED // int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    leaf = written(_repeated_leaves(_anchor_rows(texts, often), HELD), "leaves")
    spans, needs = leaf.filter("kind = 0").select("doc", "a", "b"), leaf.filter("kind = 1").select("doc", "a", "b")
    if not leaf.filter("kind = 2").isEmpty():
        more, firsts = _hot_leaves(leaf)
        spans, needs = spans.unionByName(more), needs.unionByName(firsts)
    big = written(needs.groupBy(F.col("b").alias("gram")).count().filter(F.col("count") > HOT).select("gram"), "hot")
    contexts = _contexts(texts, needs)
    if not big.isEmpty():
        contexts, more = _split(contexts, big)
        spans = spans.unionByName(more)
    return spans.unionByName(_tree_spans(contexts.repartition("gram").sortWithinPartitions("gram")))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs without text, with kept (the remaining bytes), n_bytes, n_removed and n_spans."""
    keep = [c for c in docs.columns if c not in ("text", *OUTPUT)]
    keyed, repeats = with_order_key(docs.select(*keep, "text"))
    texts = keyed.select(F.col("__sid").alias("sid"), "text")
    spans = repeated_spans(texts.dropDuplicates(["sid"]) if repeats else texts)
    gathered = spans.groupBy(F.col("doc").alias("__sid")).agg(F.collect_list("a").alias("__a"), F.collect_list("b").alias("__b"))
    joined = keyed.join(gathered, "__sid", "left").drop("__sid")
    schema = docs.select(*keep).schema.add("kept", "binary").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long")

    def run(batches):
        for batch in pieces(batches, "text", 8 << 20):
            raw, at = utf8_bytes(batch.column("text"))
            size = np.diff(at)
            n = batch.column("__a").fill_null([]).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            a, b = (batch.column(k).fill_null([]).flatten().to_numpy() for k in ("__a", "__b"))
            row, a, b = merged(row, a, b)
            edge = np.zeros(len(raw) + 1, np.int8)
            edge[at[row] + a] += 1
            np.add.at(edge, at[row] + b, -1)
            stays = np.cumsum(edge[:-1], dtype=np.int8) == 0
            removed = np.bincount(row, b - a, len(size)).astype(np.int64)
            spans = np.bincount(row, minlength=len(size))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), binary_array(raw[stays], size - removed), pa.array(size), pa.array(removed), pa.array(spans)], names=[*keep, *OUTPUT])

    return joined.mapInArrow(tidy(run), schema)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What is left of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
