"""Phrase collocation mining with depth-limited count tries.

Every task counts the phrases of its shard of the corpus in tries of limited depth. A trie is built level
by level: a node is its parent and a word, so one sort of (parent, word) pairs gives the nodes of a level with
their counts. Tries are serialised as sorted rows, dealt out by prefix ranges of the phrase, and merged there by adding up counts.

A phrase is frequent only if all its words and all its pairs of words are. So a first pass counts words, a second
one tries of depth two over frequent words, and a third one deeper tries along frequent pairs. What is frequent
is told to the tasks as a Bloom filter of bounded size; a false answer only costs a few more counts.

The merged trie of frequent phrases is walked in order, by ranges of the first word: the nodes on the
way down to a phrase are its left parts. Suffix links, equal to the phrase without its first words, lead to its right parts.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import materialize, maybe_broadcast
from .textwords import mix

#: Words of the longest phrase, occurrences of a frequent one, and languages of texts without one.
DEPTH, LEAST, NO_LANGUAGE = 5, 100, "und"
#: Characters that end a piece; space and tab part its words.
ENDS, BREAK = b".,;:!?\n\x0b\x0c\r", b"\n"
#: Words and breaks of one trie; a shard writes a trie whenever so many are read.
TRIE_WORDS = 1 << 21
#: Bits of the Bloom filter: 16 for each frequent phrase, at most this many.
MOST_BITS = 1 << 27
_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + ENDS, b"abcdefghijklmnopqrstuvwxyz " + BREAK * len(ENDS))


class Words(dict):
    """Word to its number, in the order of first sight; 0 is the break between pieces."""

    def __init__(self):
        super().__init__({BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self)
        return out

    def read(self, text: bytes) -> np.ndarray:
        """Numbers of the text's words, with a 0 after each piece."""
        parted = text.translate(_FOLD).replace(BREAK, b" \n ").split(b" ")
        return np.fromiter((self[w] for w in (*parted, BREAK) if w), np.int32)


def shards(batches, take=TRIE_WORDS):
    """(language, words, numbers) of the largest language whenever ``take`` words are held, and of all at the end."""
    held: dict[str, tuple[Words, list]] = {}
    sizes: Counter = Counter()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words, parts = held.setdefault(lang, (Words(), []))
            parts.append(words.read(text.as_buffer().to_pybytes()) if text.is_valid else np.zeros(1, np.int32))
            sizes[lang] += len(parts[-1])
            if sizes.total() >= take:
                largest = sizes.most_common(1)[0][0]
                words, parts = held.pop(largest)
                del sizes[largest]
                yield largest, words, np.concatenate(parts)
    for lang, (words, parts) in held.items():
        yield lang, words, np.concatenate(parts)


def word_marks(lang: str, words: Words) -> np.ndarray:
    """A 64-bit hash of each word in its language."""
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def pair_marks(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(0xC2B2AE3D27D4EB4F) + second)


class Bloom:
    """Set of 64-bit hashes in a bounded number of bits: what was put in is always found."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    @staticmethod
    def places(marks: np.ndarray, mask: np.uint64):
        return ((mix(marks ^ seed) & mask) for seed in _SEEDS)

    def has(self, marks: np.ndarray) -> np.ndarray:
        out = np.ones(len(marks), bool)
        for at in self.places(marks, self.mask):
            out &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return out


def bloom_of(phrases: DataFrame):
    """Broadcast Bloom filter of (lang, phrase) rows: words, or two words parted by a space."""
    spark, n = phrases.sparkSession, phrases.count()
    size = min(MOST_BITS, max(1 << 16, 1 << (16 * n).bit_length()))

    def run(batches):
        for batch in batches:
            marks = np.empty(batch.num_rows, np.uint64)
            for k, (lang, phrase) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                seed = xxhash.xxh3_64_intdigest(lang.encode())
                own = [np.array([xxhash.xxh3_64_intdigest(w, seed)], np.uint64) for w in phrase.encode().split(b" ")]
                marks[k] = own[0][0] if len(own) == 1 else pair_marks(*own)[0]
            at = np.concatenate(list(Bloom.places(marks, np.uint64(size - 1)))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.int64(1), at & 63))], names=["at", "bits"])

    filled = phrases.select("lang", "phrase").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    bits = np.zeros(size // 64, np.int64)
    table = filled.toArrow()  # at most MOST_BITS / 64 rows of two numbers
    bits[table["at"].to_numpy()] = table["bits"].to_numpy()
    return spark.sparkContext.broadcast(bits.view(np.uint8))


class CountTrie:
    """Count trie of one shard: by level, each node's parent, word and count. Sorted, as a level's pairs are."""

    def __init__(self, numbers: np.ndarray, depth: int, frequent: np.ndarray, follows=None):
        """``frequent``: of each word; ``follows``: of two words' numbers, whether they may stand side by side."""
        self.levels = []
        n = len(frequent)
        live = frequent[numbers]
        beside = live[:-1] & live[1:]
        if follows is not None:
            at = np.flatnonzero(beside)
            beside[at] = follows(numbers[at], numbers[at + 1])
        place, node = np.arange(len(numbers)), numbers.astype(np.int64)
        self.levels.append((np.zeros(n, np.int64), np.arange(n), np.bincount(numbers, minlength=n)))
        for level in range(1, depth):
            place = place[place + level < len(numbers)]
            place = place[beside[place + level - 1]]
            pairs, at, counts = np.unique(node[place] * n + numbers[place + level], return_inverse=True, return_counts=True)
            self.levels.append((pairs // n, pairs % n, counts))
            node = np.zeros(len(numbers), np.int64)
            node[place] = at

    def phrases(self, words: list[bytes], level: int) -> pa.Array:
        """Phrases of a level's nodes, words parted by one space."""
        named = pa.array(words, pa.binary())
        parent, word, _ = self.levels[level]
        out = named.take(pa.array(word))
        if not level:
            return out
        return pc.binary_join_element_wise(self.phrases(words, level - 1).take(pa.array(parent)), out, pa.scalar(b" ", pa.binary()))


_ROWS = "lang string, phrase string, n long"
#: Pairs that each shard draws to find even ranges, and most of them that are looked at; ranges for each shuffle partition.
DRAWN, SAMPLE, RANGES = 64, 8192, 4


def _sorted_level(lang: str, phrases: pa.Array, counts: np.ndarray, borders: list[tuple[str, bytes]]) -> pa.RecordBatch:
    """A serialised level: sorted by phrase, with the number of the prefix range that each phrase lies in."""
    order = pc.sort_indices(phrases)
    phrases, at = phrases.take(order), np.zeros(len(phrases), np.int32)
    first = bisect_left(borders, (lang, b""))
    for _, border in borders[first : bisect_left(borders, (lang + "\0", b""))]:
        at[bisect_left(phrases, border, key=lambda x: x.as_py()) :] += 1
    return pa.RecordBatch.from_arrays([pa.array(at + first), pa.array([lang] * len(phrases), pa.string()), phrases.cast(pa.string()), pa.array(counts).take(order)], names=["range", "lang", "phrase", "n"])


def merged(tries: DataFrame, least: int) -> DataFrame:
    """Tries added up: each range of phrases goes to one task, where the sorted runs meet. Frequent phrases only."""
    parts = max(1, int(tries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    runs = tries.repartition(parts, "range").sortWithinPartitions("range", "lang", "phrase")
    return materialize(runs.groupBy("range", "lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "phrase", "n"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, phrase, n, pair) of all words, the one level deep tries of the shards added up; and some pairs of neighbours, how often they were drawn."""

    def run(batches):
        for lang, words, numbers in shards(batches):
            counts, named = np.bincount(numbers, minlength=len(words)), pa.array(list(words), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(words) - 1), pa.string()), named.slice(1).cast(pa.string()), pa.array(counts[1:]), pa.array(np.zeros(len(words) - 1, bool))], names=["lang", "phrase", "n", "pair"])
            beside = np.flatnonzero((numbers[:-1] > 0) & (numbers[1:] > 0))
            drawn = np.random.default_rng(len(numbers)).choice(beside, min(DRAWN, len(beside)), replace=False)
            pairs = pc.binary_join_element_wise(named.take(pa.array(numbers[drawn])), named.take(pa.array(numbers[drawn + 1])), pa.scalar(b" ", pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(drawn), pa.string()), pairs.cast(pa.string()), pa.array(np.ones(len(drawn), np.int64)), pa.array(np.ones(len(drawn), bool))], names=["lang", "phrase", "n", "pair"])

    return texts.mapInArrow(run, f"{_ROWS}, pair boolean").groupBy("lang", "phrase", "pair").agg(F.sum("n").alias("n"))


def _borders(pairs: DataFrame) -> list[tuple[str, bytes]]:
    """Phrases that cut the drawn pairs into even ranges: only where ranges begin depends on them, not what is counted."""
    wanted = RANGES * int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = sorted((r["lang"], r["phrase"].encode(), r["n"]) for r in pairs.orderBy(F.xxhash64("lang", "phrase")).limit(SAMPLE).collect())  # bounded
    total, out, so_far = sum(n for _, _, n in drawn), [], 0
    for lang, phrase, n in drawn:
        if so_far * wanted >= (len(out) + 1) * total:
            out.append((lang, phrase))
        so_far += n
    return out


def _tries(texts: DataFrame, first: int, depth: int, borders: list, word_set, pair_set=None) -> DataFrame:
    """Rows of the shards' tries, from level ``first`` to ``depth`` (both counted from 1)."""

    def run(batches):
        single = Bloom(word_set.value)
        pairs = pair_set and Bloom(pair_set.value)
        for lang, words, numbers in shards(batches):
            marks = word_marks(lang, words)
            frequent = single.has(marks)
            frequent[0] = False
            follows = pairs and (lambda a, b, m=marks: pairs.has(pair_marks(m[a], m[b])))
            trie, named = CountTrie(numbers, depth, frequent, follows), list(words)
            for level in range(first - 1, depth):
                yield _sorted_level(lang, trie.phrases(named, level), trie.levels[level][2], borders)

    return texts.mapInArrow(run, f"range int, {_ROWS}")


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", depth: int = DEPTH, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n) of all phrases of 1 to ``depth`` words with ``least`` occurrences or more, and (lang, total) of all words."""
    ship_package(docs.sparkSession)
    texts = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), docs[text_col].cast("string").cast("binary").alias("text"))
    counted = materialize(word_counts(texts))
    words, borders = counted.where("not pair").drop("pair"), _borders(counted.where("pair"))
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    single = words.where(F.col("n") >= least)
    if depth < 2:
        return single, totals
    word_set = bloom_of(single)
    double = merged(_tries(texts, 2, 2, borders, word_set), least)
    found = single.unionByName(double)
    if depth > 2:
        found = found.unionByName(merged(_tries(texts, 3, depth, borders, word_set, bloom_of(double)), least))
    return found, totals


def _left_parts(phrases: DataFrame) -> DataFrame:
    """Adds ``left``: how often the first 1, 2, ... words of each phrase occur. A walk through the sorted trie: the way down is a stack."""
    parts = int(phrases.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = F.split("phrase", " ")
    ranges = phrases.repartitionByRange(parts, "lang", F.get(words, F.lit(0))).sortWithinPartitions("lang", words)

    def run(batches):
        way: list[tuple[str, str, int]] = []
        for batch in batches:
            left = []
            for lang, phrase, n in zip(*(c.to_pylist() for c in batch.columns)):
                while way and not (way[-1][0] == lang and phrase.startswith(way[-1][1] + " ")):
                    way.pop()
                left.append([x[2] for x in way])
                way.append((lang, phrase, n))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(left, pa.list_(pa.int64()))], names=["lang", "phrase", "n", "left"])

    return ranges.mapInArrow(run, f"{_ROWS}, left array<long>")


def _whole(x: Column) -> Column:
    return x.cast("decimal(19,0)")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", depth: int = DEPTH, least: int = LEAST, percent: int = 100) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the collocations of each language.

    Texts are lower-cased (A-Z) and split at . , ; : ! ? and line ends into pieces, these at spaces and tabs into words;
    phrases lie within pieces. A candidate has 2 to ``depth`` words and occurs a >= ``least`` times; n counts the
    language's words. A cut into a left and a right part that occur l and r times scores floor(1000 * a * n / (l * r)); the lowest
    counts, the earliest of equal ones. Candidates inside a longer one with at least ``percent`` of their occurrences go.
    All numbers are exact (decimals of 38 digits). A null language is ``und``; null, empty and blank texts have no words;
    repeated rows count as often as they stand. Empty tables give no rows. Other columns are not read.
    """
    found, totals = frequent_phrases(docs, text_col, lang_col, depth, least)
    walked = materialize(_left_parts(found))
    many = walked.where(F.size("left") > 0)
    cuts = many.select("lang", "phrase", F.col("n").alias("a"), F.posexplode("left").alias("at", "l"))
    rest = F.array_join(F.slice(F.split("phrase", " "), F.col("at") + 2, depth), " ")
    links = found.select(F.col("lang"), F.col("phrase").alias("rest"), F.col("n").alias("r"))
    scored = cuts.withColumn("rest", rest).join(maybe_broadcast(links, size=F.length("rest")), ["lang", "rest"]).join(F.broadcast(totals), "lang")  # one row a language
    score = F.expr("(1000BD * CAST(a AS DECIMAL(16,0)) * CAST(total AS DECIMAL(18,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")
    least_cut = F.min(F.struct(score.alias("score"), "at", "l", "r", F.col("total").alias("n")))
    best = scored.groupBy("lang", "phrase", "a").agg(least_cut.alias("c"))
    words = F.split("phrase", " ")
    size = F.size(words)
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda s: F.array_join(F.slice(words, s, k), " "))))
    inner = many.where(size > 2).select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "n")
    longer = inner.groupBy("lang", "phrase").agg(F.max("n").alias("inside"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.col("inside").isNull() | (100 * _whole(F.col("inside")) < percent * _whole(F.col("a"))))
    return kept.select("lang", "phrase", "a", "c.l", "c.r", "c.n", "c.score")


def best_of_each(found: DataFrame, k: int) -> DataFrame:
    """Each language's first k collocations: by score, then a, both descending, then the phrase in the order of its bytes."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
