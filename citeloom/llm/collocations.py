"""Phrases whose words stand together more often than their parts would suggest.

Every word of a piece of text is a suffix, known by a pointer. Suffixes are
dealt to segments by their leading word and then sorted by multikey three-way
quicksort down to `depth` words: a segment of pointers is parted by the next
word of each into less, equal and greater, the equal part goes on with the word
after, and its size is the count of the phrase it shares. All segments of a
block are parted in step, in numpy.

Counting takes two such sorts. Each task sorts the suffixes of its own texts
and sends, for each leading word, one row with its count and the tree of equal
parts below it. Rows are routed by the hash of the leading word, so that its
phrases meet in one place, whatever the corpus. There a part whose weight is
below the least count is abandoned, with all phrases in it. Leading words, and
pairs of them, that would fill too much of a task are routed by one word more;
the pieces of counts of such pairs are added up afterwards. How many of these
there can be follows from the number of tasks, so their list is broadcast.

Defined results: a null text is empty, a null language is `und`; rows that
repeat count each time; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.arrow import binary_array, pieces, tidy, utf8_bytes
from citeloom.session import written

#: Longest phrase, least count, share of a phrase (in hundredths) that makes its parts redundant, and rows for each language.
DEPTH, LEAST, NESTED, TOP = 3, 10, 50, 2_000
#: Before a word of level 2, 3, ... in a tree: bytes that no word can hold.
LEVELS = "\n\t\r\x0b\x0c.,;"
#: Bytes of text that one task sorts at a time, and suffixes for which a task of the second sort is planned.
BLOCK, ROUTED = 8 << 20, 1_000_000
#: Occurrences in one block from which a pair is reported, as it may be too many for one task.
MARK = 8
#: What each byte is to the splitting (0 of a word, 1 blank, 2 end of a piece), and lower case.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?\n\x0b\x0c\r"]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """The words of texts in order: code (a number for each different one), row, and left: words up to the end of the piece, depth at most."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, depth: int):
        kind = KIND[raw]
        inside = kind == 0
        start, stop = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1]
        stop[:-1] &= ~inside[1:]
        edges = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(raw))]  # words end with their text
        start[edges] = inside[edges]
        stop[edges - 1] = inside[edges - 1]
        begin, end = np.flatnonzero(start), np.flatnonzero(stop) + 1
        coded = binary_array(raw[inside], end - begin).dictionary_encode()
        self.words = coded.dictionary
        self.code = coded.indices.to_numpy(zero_copy_only=False)
        self.row = np.searchsorted(at[1:], begin, side="right").astype(np.int32)
        piece = np.cumsum(kind == 2, dtype=np.int32)[begin] if len(raw) else np.zeros(0, np.int32)
        goes_on = np.zeros(len(begin), bool)
        if len(begin):
            goes_on[:-1] = (piece[1:] == piece[:-1]) & (self.row[1:] == self.row[:-1])
        self.left = np.ones(len(begin), np.int8)
        for _ in range(depth - 1):
            self.left[:-1] = np.where(goes_on[:-1], np.minimum(self.left[1:] + 1, depth), 1)


def three_way(code: np.ndarray, left: np.ndarray, pointer: np.ndarray, weight: np.ndarray, size: np.ndarray, depth: int, least: int = 1, spared: np.ndarray | None = None):
    """Multikey three-way quicksort; yields (words, pointers, weights, places) of the equal parts.

    pointer and weight come in segments of the given sizes, of suffixes that
    share their leading word. An equal part is given by one of its pointers,
    its whole weight, and where it begins in the sorted order (in which a
    suffix that ends comes before all that go on). Parts lighter than least
    are abandoned, but for those that hold a spared suffix.
    """

    def going_on(keep, owner, place, done):
        """What is left of segments numbered by owner, without suffixes that end where their segment is compared next."""
        goes = keep.copy()
        goes[keep] = left[pointer[keep]] > done[owner[keep]]
        ended = np.bincount(owner[keep & ~goes], minlength=len(done))
        sizes = np.bincount(owner[goes], minlength=len(done))
        full = sizes > 0
        return pointer[goes], weight[goes], None if spared is None else spared[goes], sizes[full], (place + ended)[full], done[full]

    place = np.cumsum(size) - size
    pointer, weight, spared, size, place, done = going_on(np.ones(len(pointer), bool), np.repeat(np.arange(len(size)), size), place, np.ones(len(size), np.int64))
    while len(pointer):
        first = np.cumsum(size) - size
        key = code[pointer + np.repeat(done, size)]
        low, mid, high = key[first], key[first + size // 2], key[first + size - 1]
        pivot = np.repeat(np.maximum(np.minimum(low, mid), np.minimum(np.maximum(low, mid), high)), size)
        side = (key > pivot).astype(np.int64) * 2 + (key == pivot)  # 0 less, 1 equal, 2 greater
        part = np.repeat(np.arange(0, 3 * len(size), 3), size) + side
        sizes = np.bincount(part, minlength=3 * len(size))
        begins = np.cumsum(sizes) - sizes
        order = np.empty(len(pointer), np.int64)
        for own in range(3):
            of, mine = np.flatnonzero(side == own), sizes[own::3]
            order[np.arange(len(of)) + np.repeat(begins[own::3] - (np.cumsum(mine) - mine), mine)] = of
        pointer, weight = pointer[order], weight[order]
        spared = None if spared is None else spared[order]
        full = sizes > 0
        total, live = np.zeros(len(sizes), np.int64), full.copy()
        total[full] = np.add.reduceat(weight, begins[full])
        if least > 1:
            live &= total >= least
            if spared is not None:
                live[full] |= np.logical_or.reduceat(spared, begins[full])
        ahead = begins.reshape(-1, 3) - begins[::3, None]
        place = (place[:, None] + ahead).ravel()
        met = np.flatnonzero(live[1::3])
        for n in np.unique(done[met]).tolist():
            at = 3 * met[done[met] == n] + 1
            yield n + 1, pointer[begins[at]], total[at], place[at]
        deeper = np.stack([done, done + 1, done], axis=1).ravel()
        live &= deeper < depth
        owner = np.repeat(np.arange(len(sizes)), sizes)
        pointer, weight, spared, size, place, done = going_on(live[owner], owner, place, deeper)


def by_lead(lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal leads stand together, and the sizes of their segments."""
    order = np.argsort(lead, kind="stable")
    edges = np.flatnonzero(np.diff(lead[order])) + 1
    return order, np.diff(np.concatenate([[0], edges, [len(lead)]])) if len(lead) else np.zeros(0, np.int64)


def trees(words: Words, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """For each group (of a pointer) and leading word: one pointer, the weight and the tree below it; then pairs: pointers, weights.

    A tree is text: each equal part in order, as the byte of its level, its
    word and, after a space, how many suffixes end in it (left out where this
    is usual: one at the last level, none before).
    """
    pointer, size = by_lead(group.astype(np.int64) * (len(words.words) + 1) + words.code)
    first = np.cumsum(size) - size
    parts = [(np.ones(len(size), np.int64), pointer[first], size, first)]
    pairs = (pointer[:0], size[:0])
    for n, at, weight, place in three_way(words.code, words.left, pointer, np.ones(len(pointer), np.int64), size, depth):
        parts.append((np.full(len(at), n), at, weight, place))
        if n == 2:
            often = weight >= MARK
            pairs = (np.concatenate([pairs[0], at[often]]), np.concatenate([pairs[1], weight[often]]))
    level, at, weight, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((level, place))
    level, at, weight = level[order], at[order], weight[order]
    index, ends = np.arange(len(level)), weight.copy()
    for n in range(2, depth + 1):
        parent = np.maximum.accumulate(np.where(level == n - 1, index, 0))[level == n]
        ends -= np.bincount(parent, weight[level == n], minlength=len(level)).astype(np.int64)
    own = level > 1
    usual = ends == (level == depth)
    text = lambda values: pa.array(values, pa.string()).cast(pa.binary())
    number = pc.if_else(pa.array(usual), pa.scalar(b""), pc.binary_join_element_wise(b"", pa.array(ends).cast(pa.string()).cast(pa.binary()), b" "))
    node = pc.binary_join_element_wise(text(["", *LEVELS]).take(pa.array(level - 1)), words.words.take(pa.array(words.code[at + level - 1])), number, b"")
    node = pc.if_else(pa.array(own), node, pa.scalar(b""))
    heads = np.flatnonzero(~own)
    tails = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.append(heads, len(level))), node), b"")
    return at[heads], weight[heads], tails, *pairs


def suffixes(docs: DataFrame, lang: str = "lang", text: str = "text", depth: int = DEPTH) -> DataFrame:
    """lang, words, lead, n, tree of every block of texts: each leading word with its count and the phrases it leads.

    Rows of two words have no tree: pairs that are frequent in a block.
    """

    def run(batches):
        held, size = [], 0
        for batch in pieces(batches, "text", BLOCK):
            held.append(batch)
            size += batch.column("text").nbytes
            if size >= BLOCK:
                yield from block(held)
                held, size = [], 0
        if held:
            yield from block(held)

    def block(held):
        batch = pa.Table.from_batches(held).combine_chunks()
        langs = batch.column("lang").combine_chunks().dictionary_encode()
        raw, at = utf8_bytes(batch.column("text").combine_chunks())
        words = Words(LOWER[raw], at, depth)
        of_row = langs.indices.to_numpy(zero_copy_only=False)
        leads, weights, tails, pairs, often = trees(words, of_row[words.row], depth)
        word = lambda at: words.words.take(pa.array(words.code[at]))
        of = lambda at: langs.dictionary.take(pa.array(of_row[words.row[at]]))
        for i in range(0, len(leads), 1 << 15):
            own, n = leads[i : i + (1 << 15)], len(leads[i : i + (1 << 15)])
            yield row(of(own), np.full(n, 1), word(own), weights[i : i + n], tails.slice(i, n).cast(pa.string()))
        yield row(of(pairs), np.full(len(pairs), 2), pc.binary_join_element_wise(word(pairs), word(pairs + 1), b" "), often, pa.nulls(len(pairs), pa.string()))

    def row(lang, words, lead, n, tree):
        return pa.RecordBatch.from_arrays([lang.cast(pa.string()), pa.array(words.astype(np.int32)), lead.cast(pa.string()), pa.array(n), tree], names=["lang", "words", "lead", "n", "tree"])

    named = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    return named.mapInArrow(tidy(run), "lang string, words int, lead string, n long, tree string")


class Suffixes:
    """The suffixes of trees: code (depth numbers for each suffix, that of the leading word unused), left, weight, row; words: the dictionary."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, depth: int):
        role = np.zeros(256, np.int8)
        role[0x20] = 1
        role[[*LEVELS[: depth - 1].encode()]] = np.arange(2, depth + 1)
        kind = role[raw]
        inside = kind == 0
        start, stop = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1]
        stop[:-1] &= ~inside[1:]  # a tree begins with the byte of a level, so no token goes on into the next row
        begin, end = np.flatnonzero(start), np.flatnonzero(stop) + 1
        token = binary_array(raw[inside], end - begin)
        level = kind[begin - 1].astype(np.int64)
        word = level > 1
        coded = token.filter(pa.array(word)).dictionary_encode()
        self.words = coded.dictionary
        codes = coded.indices.to_numpy(zero_copy_only=False)
        ends = np.append(~word[1:], False)[word] if len(word) else word  # followed by a number
        level, begin = level[word], begin[word]
        weight = (level == depth).astype(np.int64)
        weight[ends] = token.filter(pa.array(~word)).cast(pa.string()).cast(pa.int64()).to_numpy()
        held = np.flatnonzero(weight)
        path, index = np.zeros((len(held), depth), np.int32), np.arange(len(level))
        for n in range(2, depth + 1):
            last = np.maximum.accumulate(np.where(level == n, index, 0)) if len(index) else index
            path[:, n - 1] = codes[last[held]] if len(held) else 0
        self.code, self.weight = path.ravel(), weight[held]
        self.left = np.repeat(level[held], depth).astype(np.int8)
        self.row = np.searchsorted(at[1:], begin[held], side="right")


def _split(tree: Column, level: int) -> Column:
    """A tree as trees of one part of that level each; suffixes that end before it are a tree of their own."""
    if level == 2:
        return F.transform(F.filter(F.split(tree, LEVELS[0]), lambda x: x != ""), lambda x: F.concat(F.lit(LEVELS[0]), x))
    parts = F.split(tree, LEVELS[1])
    head = F.substring_index(F.element_at(parts, 1), " ", 1)
    cut = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.concat(head, F.lit(LEVELS[1]), x))
    return F.concat(F.filter(F.slice(parts, 1, 1), lambda x: F.contains(x, F.lit(" "))), cut)


def counts(docs: DataFrame, lang: str = "lang", text: str = "text", depth: int = DEPTH, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, words, n of all phrases of depth words at most that occur least times or more; lang, total of all words."""
    found = written(suffixes(docs, lang, text, depth), "suffixes")
    spark = found.sparkSession
    leads = written(found.groupBy("lang", "words", "lead").agg(F.sum("n").alias("n")), "leads")
    total = leads.filter("words = 1").groupBy("lang").agg(F.sum("n").alias("total"))
    all_words = leads.filter("words = 1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-all_words // ROUTED))
    # Too wide is what alone may fill a quarter of a task: 4 * parts words and as many pairs, at most.
    wide = leads.filter(F.col("n") >= max(MARK, all_words // (4 * parts)))
    wide = [F.broadcast(wide.filter(f"words = {n}").select(F.col("lang").alias("__lang"), F.col("lead").alias("__lead"))) for n in (1, 2)]
    rows = found.filter("words = 1 AND tree != ''").select("lang", "lead", "tree")
    met = rows.join(wide[0], (rows["lang"] == F.col("__lang")) & (rows["lead"] == F.col("__lead")), "left")
    one = F.when(F.col("__lead").isNull(), F.array("tree")).otherwise(_split(F.col("tree"), 2))
    met = met.select("lang", "lead", F.col("__lead").isNotNull().alias("split"), F.explode(one).alias("tree"))
    second = F.when(F.col("split"), F.regexp_extract("tree", f"^\n([^{LEVELS} ]+)", 1))
    met = met.select("lang", "lead", "tree", second.alias("second"))
    met = met.join(wide[1], (met["lang"] == F.col("__lang")) & (F.concat_ws(" ", "lead", "second") == F.col("__lead")), "left")
    spared = F.col("__lead").isNotNull() & F.col("second").isNotNull() & F.lit(depth > 2)
    two = F.when(spared, _split(F.col("tree"), 3)).otherwise(F.array("tree"))
    met = met.select("lang", "lead", "second", spared.alias("spared"), F.explode(two).alias("tree"))
    third = F.when(F.col("spared"), F.regexp_extract("tree", f"{LEVELS[1]}([^{LEVELS} ]+)", 1))
    dealt = met.select("lang", "lead", "spared", "tree", F.xxhash64("lang", "lead", "second", third).alias("route")).repartition(parts, "route").drop("route")

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        del held
        key = pc.binary_join_element_wise(table.column("lang").combine_chunks(), table.column("lead").combine_chunks(), "\n").dictionary_encode()
        lead = key.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(lead, kind="stable")
        table, lead = table.take(pa.array(order)), lead[order]
        names = pc.split_pattern(key.dictionary, "\n")
        own = Suffixes(*utf8_bytes(table.column("tree").combine_chunks()), depth)
        flags = table.column("spared").to_numpy()[own.row]
        of = lead[own.row]
        _, size = by_lead(of)
        pointer = np.arange(len(of)) * depth
        for n, at, weight, _ in three_way(own.code, own.left, pointer, own.weight, size, depth, least, flags if flags.any() else None):
            for i in range(0, len(at), 1 << 16):
                part = at[i : i + (1 << 16)]
                whose = names.take(pa.array(of[part // depth]))
                words = [own.words.take(pa.array(own.code[part + k])).cast(pa.string()) for k in range(1, n)]
                phrase = pc.binary_join_element_wise(pc.list_element(whose, 1), *words, " ")
                yield pa.RecordBatch.from_arrays([pc.list_element(whose, 0), phrase, pa.array(np.full(len(part), n, np.int32)), pa.array(weight[i : i + (1 << 16)])], names=["lang", "phrase", "words", "n"])

    longer = dealt.mapInArrow(tidy(run), "lang string, phrase string, words int, n long")
    added = longer.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    single = leads.filter(F.col("words") == 1).filter(F.col("n") >= least).select("lang", F.col("lead").alias("phrase"), "words", "n")
    return written(added.unionByName(single), "phrases"), total


def scored(counted: DataFrame, least: int = LEAST, nested: int = NESTED) -> DataFrame:
    """lang, phrase, a, l, r, score of phrases that no longer one makes redundant, by the cut with the lowest score."""
    split = F.split("phrase", " ")
    candidates = counted.filter("words > 1").select("lang", "phrase", F.col("n").alias("a"), split.alias("w"))
    joined = lambda begin, n: F.array_join(F.slice("w", begin, n), " ")
    cut = candidates.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("first"), joined(F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    side = lambda part, name: counted.select("lang", F.col("phrase").alias(part), F.col("n").alias(name))
    met = cut.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    big = lambda c: F.col(c).cast("decimal(18,0)")
    # Products of two counts have up to 36 digits and the million six more than a score needs: both fit 38 for counts below 10^15.
    exact = met.withColumn("top", F.lit(1_000_000).cast("decimal(7,0)") * (big("a") * big("a")).cast("decimal(31,0)")).withColumn("below", big("l") * big("r"))
    ratio = F.expr("top div below")
    best = exact.withColumn("score", ratio).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
    held = candidates.filter(F.size("w") > 2).select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = best.join(held, ["lang", "phrase"], "left").filter(f"longer IS NULL OR 100 * longer < {nested} * a")
    return left.select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", depth: int = DEPTH, least: int = LEAST, nested: int = NESTED, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases by score, count and phrase."""
    counted, total = counts(docs, lang, text, depth, least)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # A language may hold most phrases: each of its parts gives its own first ones.
    part = scored(counted, least, nested).withColumn("__part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    firsts = part.withColumn("__rank", F.row_number().over(Window.partitionBy("lang", "__part").orderBy(*order))).filter(F.col("__rank") <= top)
    ranked = firsts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of two or three words of every language."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, 1 AS words, w[i] AS phrase FROM s UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM s WHERE i + 1 <= len(w) UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM s WHERE i + 2 <= len(w)),
f AS (SELECT lang, words, phrase, count(*) AS n FROM g GROUP BY ALL),
t AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang),
c AS (SELECT lang, words, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND n >= 10),
k AS (SELECT *, unnest(range(1, words)) AS k FROM c),
x AS (SELECT k.*, l.n AS l, r.n AS r, (1000000 * a::HUGEINT * a) // (l.n::HUGEINT * r.n) AS score FROM k
  JOIN f l ON l.lang = k.lang AND l.words = k.k AND l.phrase = array_to_string(k.w[1:k.k], ' ') JOIN f r ON r.lang = k.lang AND r.words = k.words - k.k AND r.phrase = array_to_string(k.w[k.k + 1:], ' ')),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
h AS (SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a FROM c WHERE words = 3),
d AS (SELECT lang, phrase, max(a) AS longer FROM h GROUP BY ALL),
o AS (SELECT b.lang, phrase, a, l, r, score::BIGINT AS score FROM b LEFT JOIN d USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT q.lang, rank, phrase, a, l, r, t.n, score FROM q JOIN t ON t.lang = q.lang WHERE rank <= 2000
"""
