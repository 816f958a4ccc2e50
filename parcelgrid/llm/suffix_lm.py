"""A probabilistic suffix tree over words.

Contexts grow one word at a time from word sequences that occur at least `least` times, an absolute count, so the tree grows
with the corpus.  It is counted and kept in Spark.  A context is kept if some next symbol's probability differs from that
under its longest proper suffix by a factor of `ratio` or more, or if it is a suffix of a kept one.  Next-symbol
distributions are smoothed towards that suffix, down to the add-half unigram model at the root.

A text's log probability is a sum: the root's for each token, log of what each kept context leaves to its parent, and, where a
symbol is explicit in a context, log p(context) - log p(suffix) - log left.  The last two belong to a sequence of words,
whatever surrounds it, so each sequence has one value per occurrence.  Those of the most frequent words and sequences, a
fixed number, are broadcast; all others are joined.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelgrid.llm.common import bytes_of, save
from parcelgrid.llm.hashing import U, binary, blocks, mix, words

END = np.array([0x5EED0E4D], dtype=U)
STEP = U(0x9E3779B97F4A7C15)


HEAD = 1 << 20  # words, and sequences, that are broadcast at most


@dataclass
class Tree:
    """The frequent head: sorted hashes of words with their log10 root probability, and of sequences with their values."""
    words: np.ndarray
    roots: np.ndarray
    sequences: np.ndarray
    values: np.ndarray
    marks: np.ndarray       # a filter over all sequences that have a value
    rest: DataFrame | None  # (key, value): log10 values of all other sequences


def tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with one end token after each document, and where each document's tokens begin."""
    h, first = words(data, bounds)
    return np.insert(h, first[1:], END[0]) if len(first) > 1 else h, first + np.arange(len(first))


def extended(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a context and the symbol that follows."""
    return mix(context * STEP + mix(word + U(1)))


def sequences(h: np.ndarray, first: np.ndarray, longest: int) -> list[np.ndarray]:
    """By length from 1 to `longest`: the hash of the tokens up to and with each one; 0 where the document has fewer."""
    n = len(h)
    place = np.arange(n) - np.repeat(first[:-1], np.diff(first))
    out = [extended(np.full(n, U(1)), h)]
    for k in range(1, longest):
        out.append(np.where(place >= k, extended(np.concatenate([np.zeros(1, U), out[-1][:-1]]), h), U(0)) if n else out[0])
    return out


def member(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each x in a sorted table, and whether it is there; equal ones are looked up once, in order."""
    if not len(table) or not len(x):
        return np.zeros(len(x), np.int64), np.zeros(len(x), dtype=bool)
    order = np.argsort(x)
    s = x[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = s[1:] != s[:-1]
    found = np.minimum(np.searchsorted(table, s[new]), len(table) - 1)
    at = np.empty(len(x), np.int64)
    at[order] = found[np.cumsum(new) - 1]
    return at, table[at] == x


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def counted(texts: DataFrame, pick, columns: list[str]) -> DataFrame:
    """Sums over all texts of what `pick(tokens, first)` yields: groups of an array by which equal rows come together and arrays for
    `columns`; each group is merged per task before the shuffle."""
    def merged(held):
        order, *keys, weights = (np.concatenate([x[i] for x in held]) for i in range(len(columns) + 2))
        at = np.argsort(order)
        order, weights, keys = order[at], weights[at], [k[at] for k in keys]
        new = np.ones(len(at), dtype=bool)
        if len(at):
            new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        first = np.flatnonzero(new)
        return [order[first], *(k[first] for k in keys), np.add.reduceat(weights, first) if len(first) else weights]

    def run(batches):
        held: dict[int, list] = {}
        size: dict[int, int] = {}

        def emit(rows):
            for cut in range(0, len(rows[0]), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(a[cut:cut + 50_000].view(np.int64)) for a in rows[1:]], names=[*columns, "n"])

        for batch in batches:
            for _, _, part, bounds in blocks(*binary(batch.column("text"))):
                for g, found in enumerate(pick(*tokens(part, bounds))):
                    held.setdefault(g, []).append([*found, np.ones(len(found[0]), dtype=np.int64)])
                    size[g] = size.get(g, 0) + len(found[0])
                    if size[g] > 2_000_000:
                        rows = merged(held[g])
                        held[g], size[g] = ([], 0) if len(rows[0]) > 1_000_000 else ([rows], len(rows[0]))
                        if not held[g]:
                            yield from emit(rows)
        for rest in held.values():
            if rest:
                yield from emit(merged(rest))

    schema = ", ".join(f"{c} long" for c in columns) + ", n long"
    return texts.mapInArrow(run, schema).groupBy(*columns).agg(F.sum("n").alias("n"))


def filter_of(keys: DataFrame) -> np.ndarray:
    """A filter over the column `key` of some sixteen bits a row, 2**28 at most; what passes it wrongly only adds rows that are
    dropped later."""
    bits = int(np.clip((16 * keys.count()).bit_length(), 20, 28))
    slot = F.shiftrightunsigned("key", 64 - bits) + 1
    out = np.zeros(1 << bits - 3, dtype=np.uint8)
    for r in (keys.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("b"))
              .agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m")).toLocalIterator()):  # at most 2**bits / 32768 rows
        out[(r["b"] - 1) * 4096:r["b"] * 4096] = np.frombuffer(bytes(r["m"]), dtype=np.uint8)
    return out


def passing(marks: np.ndarray, x: np.ndarray) -> np.ndarray:
    s = (x >> U(64 - (len(marks) * 8).bit_length() + 1)).astype(np.int64)
    return (marks[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1


def keyed(pairs: DataFrame) -> DataFrame:
    """Hash of context and word (`key`), and of suffix and word (`under`)."""
    def run(batches):
        for batch in batches:
            c, w, s = (batch.column(x).to_numpy().view(U) for x in ("context", "word", "suffix"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(extended(c, w).view(np.int64)), pa.array(extended(s, w).view(np.int64))],
                                             names=[*batch.schema.names, "key", "under"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema)
    return pairs.mapInArrow(run, schema + ", key long, under long")


def grown(texts: DataFrame, before: DataFrame, depth: int, least: float) -> DataFrame:
    """(context of `depth` words, next symbol) of at least `least` occurrences.

    Both its first and its last `depth` words must be among the sequences of `before`; a filter sorts out most others.
    """
    known = texts.sparkSession.sparkContext.broadcast(filter_of(before))

    def pick(h, first):
        up_to = sequences(h, first, depth + 1)
        whole, last = up_to[depth], up_to[depth - 1]
        at = np.flatnonzero(whole)
        at = at[passing(known.value, last[at - 1])]
        at = at[passing(known.value, last[at])]
        return [(whole[at], last[at - 1], h[at])]

    return counted(texts, pick, ["context", "word"]).filter(F.col("n") >= least)


def described(pairs: DataFrame, before: DataFrame) -> DataFrame:
    """Pairs with the context's suffix (one word fewer) and its own number of occurrences (`times`)."""
    states = before.select(F.col("key").alias("context"), F.col("under").alias("suffix"), F.col("n").alias("times"))
    return save(keyed(pairs.join(states, "context")), "pairs")


def most_frequent(rows: DataFrame, head: int) -> Column:
    """A condition on `n` that the most frequent rows meet, `head` of them at most, from a histogram of counts."""
    level = F.floor(8 * F.log2("n")).cast("int")
    total, cut = 0, None
    for r in rows.groupBy(level.alias("level")).agg(F.count("*").alias("rows")).orderBy(F.desc("level")).collect():  # a few hundred rows
        total += r["rows"]
        if total > head:
            break
        cut = r["level"]
    return level >= cut if cut is not None else F.lit(False)


def gathered(rows: DataFrame, key: str, value: str) -> tuple[np.ndarray, np.ndarray]:
    """Two columns of a table of bounded size, in order of `key`."""
    found = rows.select(key, value).toArrow()
    names = found.column(key).to_numpy().view(U)
    order = np.argsort(names)
    return names[order], found.column(value).to_numpy()[order]


def train(texts: DataFrame, depth: int = 3, ratio: float = 1.3, pull: float = 20.0, least: float = 16.0, head: int = HEAD) -> tuple[DataFrame, Tree, int, int]:
    """Word counts (word, n) of all training texts, the tree, and the numbers of tokens and of distinct ones."""
    least = max(2.0, least)

    def words_and_pairs(h, first):
        one, two = sequences(h, first, 2)
        at = np.flatnonzero(two)
        return (one, np.full(len(h), U(1)), h), (two[at], one[at - 1], h[at])

    counts = save(counted(texts, words_and_pairs, ["context", "word"]).filter((F.col("context") == 1) | (F.col("n") >= least)), "counts")
    vocabulary = counts.filter("context = 1").select("word", "n")
    total, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    size = total + 0.5 * (distinct + 1)
    root = vocabulary.filter(F.col("n") >= least).select(F.lit(1).cast("long").alias("context"), "word", F.lit(1).cast("long").alias("suffix"), "n")
    before = save(keyed(root).withColumn("under", F.lit(1).cast("long")).withColumn("p", (F.col("n") + 0.5) / F.lit(size)), "sequences")
    levels: list[DataFrame] = []
    for d in range(1, depth + 1):  # `before`: sequences of d words (key, n, p, under: the hash without the first word)
        pairs = described(counts.filter("context <> 1") if d == 1 else grown(texts, before, d, least), before)
        sizes = (pairs.groupBy("context").agg(F.sum("n").alias("explicit"), F.first("times").alias("t"))
                 .select("context", (F.col("t") + pull).alias("size"), ((F.col("t") + pull - F.col("explicit")) / (F.col("t") + pull)).alias("left")))
        share = F.col("n") / F.col("size")
        level = save(pairs.join(sizes, "context").join(before.select(F.col("key").alias("under"), F.col("p").alias("q")), "under")
                     .select("context", "suffix", "n", "key", "under", "times", "left", "q", (share + F.col("left") * F.col("q")).alias("p")), "level")
        levels.append(level)
        before = level
    apart = (F.col("p") >= ratio * F.col("q")) | (F.col("q") >= ratio * F.col("p"))
    above, rows = None, None
    for level in reversed(levels):  # every suffix of a kept context is a state too
        chosen = level.filter(apart).select("context")
        above = (chosen if above is None else chosen.union(above.select(F.col("suffix").alias("context")))).distinct()
        above = save(level.join(above, "context", "left_semi"), "kept")
        states = above.groupBy(F.col("context").alias("key")).agg(F.first("times").alias("n"), F.log10(F.first("left")).alias("value"))
        found = above.select("key", "n", F.log10(F.col("p") / F.col("q") / F.col("left")).alias("value")).union(states.select("key", "n", "value"))
        rows = found if rows is None else rows.union(found)
    values = save(rows.groupBy("key").agg(F.max("n").alias("n"), F.sum("value").alias("value")), "sequence_values")
    frequent = most_frequent(values, head)
    words, n = gathered(vocabulary.filter(most_frequent(vocabulary, head)), "word", "n")
    keys, gains = gathered(values.filter(frequent), "key", "value")
    return (vocabulary, Tree(words, np.log10((n + 0.5) / size), keys, gains, filter_of(values), values.filter(~frequent).select("key", "value")),
            int(total), int(distinct))


def looked_up(tree: Tree, h: np.ndarray, first: np.ndarray, depth: int):
    """For each token whether it is a head word, its log10 root probability and that with the head's sequences that end there; then
    all other sequences that may have a value, and the tokens they end with.

    For words outside the head the root probability counts as 1, so that their own is added once it is known.
    """
    at, known = member(tree.words, h)
    base = np.where(known, tree.roots[at] if len(tree.words) else 0.0, 0.0)
    model, found, ends = base.copy(), [], []
    for x in sequences(h, first, depth + 1):
        place = np.flatnonzero(x)
        place = place[passing(tree.marks, x[place])]
        k, hit = member(tree.sequences, x[place])
        model[place[hit]] += tree.values[k[hit]]
        place = place[~hit]
        found.append(x[place])
        ends.append(place)
    return known, base, model, np.concatenate(found), np.concatenate(ends)


def listed(keys: np.ndarray, doc: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
    """Distinct keys of each document and how often each occurs, as lists."""
    order = np.lexsort((keys, doc))
    keys, doc = keys[order], doc[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    ends = pa.array(np.searchsorted(doc[start], np.arange(n + 1)).astype(np.int32))
    return (pa.ListArray.from_arrays(ends, pa.array(keys[start].view(np.int64))),
            pa.ListArray.from_arrays(ends, pa.array(np.diff(np.append(start, len(order))).astype(np.int32))))


SCORED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_head", pa.int64()), ("base", pa.float64()),
                    ("model", pa.float64()), ("words", pa.list_(pa.int64())), ("times", pa.list_(pa.int32())), ("keys", pa.list_(pa.int64())),
                    ("key_times", pa.list_(pa.int32()))])


def score(docs: DataFrame, depth: int = 3, **settings) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of `docs`.

    Null and empty texts are the end token alone; rows without doc_id are training rows; repeated rows count each.  Frequent
    words and sequences are looked up in a broadcast of bounded size, all others in joins with the full tables.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), bytes_of().alias("text"))
    vocabulary, tree, total, distinct = train(texts.filter(~held_out(F.col("doc_id"))), depth=depth, **settings)
    rest, tree.rest = tree.rest, None
    shared = spark.sparkContext.broadcast(tree)
    size = total + 0.5 * (distinct + 1)

    def run(batches):
        for batch in batches:
            data, offsets = binary(batch.column("text"))
            for i, j, part, bounds in blocks(data, offsets):
                h, first = tokens(part, bounds)
                head, base, model, keys, ends = looked_up(shared.value, h, first, depth)
                words_ = np.flatnonzero(~head)
                doc = np.repeat(np.arange(j - i), np.diff(first))
                add = lambda x: np.bincount(doc, weights=x, minlength=j - i)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(i, j - i), batch.column("doc_id").slice(i, j - i), pa.array(np.diff(first)),
                     pa.array(add(head).astype(np.int64)), pa.array(add(base)), pa.array(add(model)),
                     *listed(h[words_], doc[words_], j - i), *listed(keys, doc[ends], j - i)], schema=SCORED)

    scored = save(texts.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text").mapInArrow(
        run, "row long, doc_id long, n_tokens long, n_head long, base double, model double, words array<long>, times array<int>, "
        "keys array<long>, key_times array<int>"), "scored")
    rare = (scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
            .join(vocabulary, "word", "left").groupBy("row")
            .agg(F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("n_rare"),
                 F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(size))).alias("rare")))
    deep = (scored.select("row", F.explode(F.arrays_zip("keys", "key_times")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.key_times").alias("times"))
            .join(rest, "key").groupBy("row").agg(F.sum(F.col("times") * F.col("value")).alias("deep")))
    more = F.coalesce("rare", F.lit(0.0))
    return (scored.drop("words", "times", "keys", "key_times").join(rare, "row", "left").join(deep, "row", "left")
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("n_head") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
                    F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"),
                    (F.col("model") + more + F.coalesce("deep", F.lit(0.0))).alias("score")))
