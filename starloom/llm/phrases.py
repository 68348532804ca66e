"""Phrases whose words occur together more often than apart, by partitioned frequent-phrase mining.

The corpus is dealt into a fixed number of shards.  Each is mined completely at a support lowered to the shard's share of its
language's words: a phrase with the support overall reaches the lowered one in some shard, so the union of what is frequent
somewhere misses none.  A shard is as large as its share of the corpus, so many tasks mine it together: words first, then
pairs of frequent words, then longer runs of frequent pairs.  The union, thinned by the most that other shards can still
hold, is then counted over all documents exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starloom.llm.text import Texts, mix, slices
from starloom.session import stage

BREAK = np.isin(np.arange(256), [*b".,;:!?", *range(0x0A, 0x0E)])
SEPARATOR = BREAK | np.isin(np.arange(256), [0x20, 0x09])
LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)
_U = np.uint64


@dataclass(frozen=True)
class PhraseParams:
    most_words: int = 5
    support: int = 100
    factor: int = 1000
    # A candidate inside a longer one goes if the longer one has this share of its occurrences.
    contained_percent: int = 100
    top: int = 2000
    shards: int = 8
    # Documents of so many successive ids fall into one shard, so that a task's texts are mostly of one.
    shard_ids: int = 4096
    # Words that a task counts at a time, at least, where its partition has as many, and less than twice as many: its memory.
    block_words: int = 1_500_000
    # Bits of the filters that hold phrases: a fixed size, at the price of false ones, which are counted exactly too.
    filter_bits: int = 26


@dataclass
class Block:
    """The words of several texts in a row: their places in ``dictionary``, their texts' groups (places in ``keys``, which
    are shard and language), and whether the next word is in the same piece."""

    words: np.ndarray
    groups: np.ndarray
    joined: np.ndarray
    dictionary: pa.Array
    keys: list[tuple[int, str]]


def parse(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """The words of all texts, whether the next one is in the same piece, and the first word of each text (and a last)."""
    texts = Texts.of(column)
    texts = Texts(LOWER[texts.data], texts.offsets)
    starts, ends, first = texts.spans(SEPARATOR)
    breaks = np.concatenate([[0], np.cumsum(BREAK[texts.data])])
    joined = np.zeros(len(starts), bool)
    joined[:-1] = breaks[starts[1:]] == breaks[ends[:-1]]
    last = first[1:][np.diff(first) > 0] - 1
    joined[last] = False
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    letters = texts.data[~SEPARATOR[texts.data]]
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters))
    return words.dictionary_encode(), joined, first


def blocks(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[Block]:
    """The batches' ``shard, lang, text`` as blocks of ``least`` words or more, as equal phrases of a block are one row.

    Only a partition of fewer words makes a smaller one; beyond twice as many, a block is as long as its last text makes it.
    """
    words: list[pa.DictionaryArray] = []
    joined: list[np.ndarray] = []
    groups: list[np.ndarray] = []
    keys: dict[tuple[int, str], int] = {}

    def first(pieces: int) -> Block:
        chunks = pa.chunked_array(words[:pieces]).unify_dictionaries().chunks
        places = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in chunks])
        block = Block(places, np.concatenate(groups[:pieces]), np.concatenate(joined[:pieces]), chunks[0].dictionary, list(keys))
        del words[:pieces], groups[:pieces], joined[:pieces]
        return block

    for piece in slices(batches, "text"):
        found, close, start = parse(piece.column("text"))
        key = zip(piece.column("shard").to_pylist(), piece.column("lang").to_pylist(), strict=True)
        numbers = [keys.setdefault(x, len(keys)) for x in key]
        words.append(found)
        joined.append(close)
        groups.append(np.repeat(np.array(numbers, np.int32), np.diff(start)))
        upto = np.cumsum([len(w) for w in words])
        if upto[-1] >= 2 * least:
            yield first(int(np.searchsorted(upto, least)) + 1)
    if words:
        yield first(len(words))


@dataclass
class Level:
    """The kept phrases of one length: group, first word's place in the block, occurrences, fingerprint."""

    group: np.ndarray
    place: np.ndarray
    count: np.ndarray
    fingerprint: np.ndarray


def levels(block: Block, longest: int, keep: Callable[[int, np.ndarray, np.ndarray], np.ndarray | None]) -> Iterator[Level]:
    """The phrases that ``keep(length, group, fingerprint)`` keeps (None: all), length by length.

    A phrase is looked at only if both phrases of one word less inside it were kept; the two name it exactly.  Fingerprints
    are those of language and words, so they are the same in all blocks and shards.
    """
    texts = Texts.of(block.dictionary)
    word_prints = texts.fingerprints(texts.offsets[:-1], texts.offsets[1:])
    names = Texts.of(pa.array([name for _, name in block.keys], pa.large_string()))
    name_prints = names.fingerprints(names.offsets[:-1], names.offsets[1:])
    factors = mix(np.arange(1, longest + 1, dtype=_U)) | _U(1)
    number, kept = block.words, max(1, len(block.dictionary))
    for length in range(1, longest + 1):
        if length == 1:
            at = np.arange(len(number))
            key = block.groups.astype(np.int64) * kept
            key += number
        else:
            near = (number[:-1] >= 0) & (number[1:] >= 0)
            at = np.flatnonzero(near & block.joined[:-1] if length == 2 else near)
            key = number[at].astype(np.int64) * kept
            key += number[at + 1]
        if not len(at):
            return
        code, _ = pd.factorize(key)
        del key
        count = np.bincount(code)
        place = np.empty(len(count), np.int64)
        place[code[::-1]] = at[::-1]
        group = block.groups[place]
        prints = name_prints[group]
        for j in range(length):
            prints = prints + word_prints[block.words[place + j]] * factors[j]
        prints = mix(prints)
        good = keep(length, group, prints)
        good = np.ones(len(count), bool) if good is None else good
        renumbered = np.where(good, np.cumsum(good) - 1, -1).astype(np.int32)
        number = np.full(len(block.words), -1, np.int32)
        number[at] = renumbered[code]
        del code, at
        kept = max(1, int(good.sum()))
        yield Level(group[good], place[good], count[good], prints[good])


def _texts(docs: DataFrame, params: PhraseParams) -> DataFrame:
    shard = F.pmod(F.xxhash64(F.floor(F.col("doc_id").cast("bigint") / F.lit(params.shard_ids))), F.lit(params.shards))
    return docs.select(
        shard.cast("int").alias("shard"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def word_totals(docs: DataFrame, params: PhraseParams = PhraseParams()) -> DataFrame:
    """``shard, lang, n``: all word occurrences (a null language is ``und``); groups without words are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, str], int] = {}
        for piece in slices(batches, "text"):
            _, _, first = Texts.of(piece.column("text")).spans(SEPARATOR)
            for *key, n in zip(piece.column("shard").to_pylist(), piece.column("lang").to_pylist(), np.diff(first).tolist(), strict=True):
                total[tuple(key)] = total.get(tuple(key), 0) + n
        shard, lang = [k[0] for k in total], [k[1] for k in total]
        yield pa.RecordBatch.from_pydict({"shard": pa.array(shard, pa.int32()), "lang": pa.array(lang, pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    rows = _texts(docs, params).mapInArrow(count, "shard INT, lang STRING, n BIGINT")
    return rows.groupBy("shard", "lang").agg(F.sum("n").alias("n")).where("n > 0")


@dataclass
class Groups:
    """Shards' languages by number: the least occurrences that are frequent there, and what tells their filter bits apart."""

    number: dict[tuple[int, str], int]
    least: list[int]
    words: int

    @staticmethod
    def of(totals: DataFrame, support: int) -> Groups:
        rows = totals.collect()  # as many as shards times languages
        words: dict[str, int] = {}
        for r in rows:
            words[r.lang] = words.get(r.lang, 0) + r.n
        return Groups({(r.shard, r.lang): i for i, r in enumerate(rows)}, [-(-support * r.n // words[r.lang]) for r in rows], sum(words.values()))

    def salts(self) -> np.ndarray:
        return mix(np.arange(1, len(self.least) + 1, dtype=_U))

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, lang, self.least[i], int(salt)) for ((_, lang), i), salt in zip(self.number.items(), self.salts().view(np.int64), strict=True)]
        return spark.createDataFrame(rows, "group INT, lang STRING, least BIGINT, salt BIGINT")


def bit_filter(prints: DataFrame, print_column: str, bits: int) -> np.ndarray:
    """A filter with the bits of all fingerprints set, in 64-bit words; its size doesn't depend on the data."""
    bit = F.col(print_column).bitwiseAND((1 << bits) - 1)
    words = prints.groupBy(F.shiftright(bit, 6).cast("bigint").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, int({print_column} & 63))")).alias("bits"))
    found = words.toArrow()  # at most 2^(bits - 6) rows
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.view(_U)


def is_set(filled: np.ndarray, prints: np.ndarray) -> np.ndarray:
    bit = prints & _U(len(filled) * 64 - 1)
    return (filled[bit >> _U(6)] >> (bit & _U(63))) & _U(1) > 0


def _dealt(texts: DataFrame, groups: Groups, params: PhraseParams) -> DataFrame:
    """The texts in no more partitions than blocks, without a shuffle, so that small input files don't make small blocks."""
    return texts.coalesce(max(1, -(-groups.words // params.block_words)))


def _frequent(docs: DataFrame, groups: Groups, filters: list[np.ndarray], longest: int, params: PhraseParams) -> DataFrame:
    """``group, print, n`` of the shards' frequent phrases of more words than there are ``filters``, up to ``longest``.

    The filters hold the shards' frequent phrases of 1, 2, ... words; no phrase around others is counted.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((groups.number, groups.salts(), filters))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, salts, known = shared.value
        for block in blocks(batches, params.block_words):
            number = np.array([numbers.get(key, 0) for key in block.keys])  # keys without words have none, nor rows

            def keep(length: int, group: np.ndarray, prints: np.ndarray, number=number) -> np.ndarray | None:
                return is_set(known[length - 1], prints ^ salts[number[group]]) if length <= len(known) else None

            for length, level in enumerate(levels(block, longest, keep), 1):
                if length > len(known):
                    columns = {"group": number[level.group].astype(np.int32), "print": level.fingerprint.view(np.int64), "n": level.count}
                    yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})

    rows = _dealt(_texts(docs, params), groups, params).mapInArrow(count, "group INT, print BIGINT, n BIGINT")
    least = groups.frame(spark).select("group", "least")
    return rows.groupBy("group", "print").agg(F.sum("n").alias("n")).join(least, "group").where("n >= least").drop("least")


def locally_frequent(docs: DataFrame, groups: Groups, params: PhraseParams = PhraseParams()) -> DataFrame:
    """``group, print, n``: all phrases that are frequent in a shard, with their occurrences there."""
    frame = groups.frame(docs.sparkSession)
    known, filters = None, []
    for longest in (1, 2, params.most_words):
        if longest > len(filters):
            found = stage(_frequent(docs, groups, filters, longest, params), "mined")
            known = found if known is None else known.unionByName(found)
            if longest < params.most_words:
                marked = found.join(frame, "group").select(F.col("print").bitwiseXOR(F.col("salt")).alias("mark"))
                filters.append(bit_filter(marked, "mark", params.filter_bits))
    return known


def possible(known: DataFrame, groups: Groups, params: PhraseParams = PhraseParams()) -> DataFrame:
    """``print`` of the phrases that can have the support: counted where they are frequent, one less than that elsewhere."""
    frame = groups.frame(known.sparkSession)
    slack = frame.groupBy("lang").agg(F.sum(F.col("least") - 1).alias("slack"))
    surplus = known.join(frame, "group").groupBy("lang", "print").agg(F.sum(F.col("n") - F.col("least") + 1).alias("surplus"))
    return surplus.join(slack, "lang").where(F.col("surplus") + F.col("slack") >= params.support).select("print")


def exact_counts(docs: DataFrame, groups: Groups, candidates: np.ndarray, params: PhraseParams = PhraseParams()) -> DataFrame:
    """``lang, phrase, words, f`` of all phrases with the support, among those in the filter, over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(candidates)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, params.block_words):
            names = pa.array([name for _, name in block.keys], pa.string())
            for length, level in enumerate(levels(block, params.most_words, lambda _, __, prints: is_set(shared.value, prints)), 1):
                parts = [block.dictionary.take(pa.array(block.words[level.place + j])) for j in range(length)]
                phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if length > 1 else parts[0]
                yield pa.RecordBatch.from_pydict({
                    "lang": names.take(pa.array(level.group)), "phrase": phrase.cast(pa.string()),
                    "words": pa.array(np.full(len(phrase), length, np.int32)), "n": pa.array(level.count),
                })

    texts = _texts(docs, params).withColumn("shard", F.lit(0))
    rows = _dealt(texts, groups, params).mapInArrow(count, "lang STRING, phrase STRING, words INT, n BIGINT")
    return rows.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("f")).where(F.col("f") >= params.support)


def frequent_phrases(docs: DataFrame, params: PhraseParams = PhraseParams()) -> tuple[DataFrame, DataFrame]:
    """All phrases of up to ``most_words`` words with the support (``lang, phrase, words, f``, a written table), and the word
    totals (``lang, n``)."""
    totals = stage(word_totals(docs, params), "words")
    groups = Groups.of(totals, params.support)
    candidates = bit_filter(possible(locally_frequent(docs, groups, params), groups, params), "print", params.filter_bits)
    return stage(exact_counts(docs, groups, candidates, params), "phrases"), totals.groupBy("lang").agg(F.sum("n").alias("n"))


def scored(phrases: DataFrame, totals: DataFrame, params: PhraseParams = PhraseParams()) -> DataFrame:
    """``lang, phrase, words, a, l, r, n, score`` of the phrases of two words and more, with their worst cut."""
    wide = "decimal(38,0)"
    part = F.split("phrase", " ")
    cuts = (
        phrases.where("words > 1").withColumnRenamed("f", "a").join(totals, "lang")
        .withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
        .withColumn("head", F.array_join(F.slice(part, F.lit(1), F.col("cut")), " "))
        .withColumn("tail", F.array_join(F.slice(part, F.col("cut") + 1, F.col("words")), " "))
    )
    heads = phrases.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = phrases.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    # A phrase's parts occur at least as often as it does, so both are in the table.
    joined = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    score = F.expr(f"(cast({params.factor} as {wide}) * cast(a as {wide}) * cast(n as {wide})) div (cast(l as {wide}) * cast(r as {wide}))")
    worst = joined.groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("w"))
    return worst.select("lang", "phrase", "words", "a", "w.l", "w.r", "n", "w.score")


def without_contained(candidates: DataFrame, params: PhraseParams = PhraseParams()) -> DataFrame:
    """The candidates that lie in no longer one with nearly as many occurrences.

    A phrase of one word more occurs at least as often as any longer one around it, so those of one word more decide.
    """
    part = F.split("phrase", " ")
    inner = F.array(*(F.array_join(F.slice(part, F.lit(i), F.col("words") - 1), " ") for i in (1, 2)))
    longer = candidates.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = F.col("around").isNull() | (100 * F.col("around") < params.contained_percent * F.col("a"))
    return candidates.join(longer, ["lang", "phrase"], "left").where(kept).drop("around")


def collocations(docs: DataFrame, params: PhraseParams = PhraseParams()) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of each language.

    Texts are lower-cased (A to Z), split into pieces at punctuation and line ends and those into words at blanks and tabs.  A
    null text is empty, a null language is ``und``; repeated rows and ids count as often as they occur.  Ties in the score go to
    the more frequent, then to the first phrase by its bytes.  Only ``doc_id, lang, text``
    are read, the id only to deal documents into shards; an empty table gives none.
    """
    phrases, totals = frequent_phrases(docs, params)
    candidates = stage(scored(phrases, totals, params), "scored")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = without_contained(candidates, params).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= params.top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_partitioned_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2,000 phrases of each language of the documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = """
WITH pieces AS (
    SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM (
        SELECT coalesce(lang, 'und') AS lang,
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
        FROM documents
    )
), words AS (
    SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces
), totals AS (
    SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang
), runs AS (
    SELECT lang, unnest(list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase, k
    FROM words, range(1, 6) AS r(k)
), f AS (
    SELECT lang, phrase, CAST(k AS BIGINT) AS k, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= 100
), cuts AS (
    SELECT p.lang, p.phrase, p.k, p.f AS a, cut, t.n,
           array_to_string(string_split(p.phrase, ' ')[1 : cut], ' ') AS head,
           array_to_string(string_split(p.phrase, ' ')[cut + 1 :], ' ') AS tail
    FROM f p JOIN totals t USING (lang), range(1, 5) AS r(cut) WHERE p.k > 1 AND cut < p.k
), measured AS (
    SELECT c.lang, c.phrase, c.k, c.a, c.n, c.cut, h.f AS l, t.f AS r,
           CAST((CAST(1000 AS HUGEINT) * c.a * c.n) // (CAST(h.f AS HUGEINT) * t.f) AS BIGINT) AS score
    FROM cuts c JOIN f h ON c.lang = h.lang AND c.head = h.phrase JOIN f t ON c.lang = t.lang AND c.tail = t.phrase
), worst AS (
    SELECT * FROM measured QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), around AS (
    SELECT lang, phrase, max(a) AS most FROM (
        SELECT lang, a, unnest([array_to_string(string_split(phrase, ' ')[1 : k - 1], ' '), array_to_string(string_split(phrase, ' ')[2 :], ' ')]) AS phrase
        FROM worst WHERE k > 2
    ) GROUP BY ALL
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, w.phrase, a, l, r, n, score
FROM worst w LEFT JOIN around USING (lang, phrase)
WHERE most IS NULL OR 100 * most < 100 * a
QUALIFY rank <= 2000
"""
