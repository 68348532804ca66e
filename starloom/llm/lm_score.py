"""Log probabilities of whole texts: word counts over the corpus, and the attention model over subword ids.

Documents are dealt into chunks of bounded size.  A chunk sends its distinct words, not its words, to the corpus count and
gets their counts back; the same pass counts subword ids and takes the windows to train on, all of them or a fixed share.
Then each chunk meets its dictionary and is scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starloom.llm import attention, bpe
from starloom.llm.text import WHITE, Texts, expand, mix, slices
from starloom.session import stage


@dataclass(frozen=True)
class LmParams:
    shape: attention.ModelShape = attention.ModelShape()
    chunk_bytes: int = 8 << 20
    # One of so many windows of the learnable texts is trained on; counts take all of them.
    train_one_in: int = 48
    # Windows of a trainer; there are as many trainers as this needs, and their parameters are averaged each round.
    trainer_windows: int = 8192
    rates: tuple[float, ...] = (0.01, 0.006, 0.003)
    # Deal the windows over the rounds, so that each is trained on once, instead of in every round.
    once: bool = False


# What the query trains on: every window of the learnable texts, once.
ALL_WINDOWS = LmParams(train_one_in=1, trainer_windows=16384, once=True)

WINDOWS_AT_ONCE = 2048
SLICE = 2 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def held_out() -> Column:
    """A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


def _lowered(column: pa.Array) -> Texts:
    texts = Texts.of(column)
    return Texts(_LOWER[texts.data], texts.offsets)


def _chunked(docs: DataFrame, params: LmParams) -> DataFrame:
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        held_out().alias("held_out"),
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = 1 + size // params.chunk_bytes
    return rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))


def _end_id(vocabulary: str) -> int:
    return bpe.vocabulary_size(vocabulary) - 1


@dataclass
class _Words:
    """The words of some texts and their subword ids, a space before each word and one end id behind each text."""

    distinct: np.ndarray
    back: np.ndarray  # of each word among the distinct ones
    first: np.ndarray  # first word of each text, and a last
    ids: np.ndarray
    first_id: np.ndarray

    @staticmethod
    def of(cache: bpe.PieceCache, texts: Texts, end: int) -> _Words:
        starts, ends, first = texts.spans(WHITE)
        distinct, where, back = bpe.distinct_keys(texts.fingerprints(starts, ends))
        entries = cache.entries_of(distinct, where, texts, starts, ends, " ")[back]
        lengths = cache.lengths[entries]
        upto = np.concatenate([[0], np.cumsum(lengths)])[first]
        ids = np.insert(cache.flat[expand(cache.places[entries], lengths)], upto[1:], end)
        return _Words(distinct, back.astype(np.int32), first, ids, upto + np.arange(len(upto)))

    def per_distinct(self, texts: np.ndarray) -> np.ndarray:
        """How often each distinct word is in the marked texts."""
        return np.bincount(self.back[np.repeat(texts, np.diff(self.first))], minlength=len(self.distinct))


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(back, np.concatenate(counts), len(distinct)).astype(np.int64)


def _window_rows(words: _Words, text: np.ndarray, number: np.ndarray, shape: attention.ModelShape) -> pa.ListArray:
    """The id before each window and its own ids, as :func:`gather` writes them."""
    low = words.first_id[text] + number * (shape.window - shape.overlap)
    lengths = np.minimum(low + shape.window, words.first_id[text + 1]) - low + 1
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1], lengths)
    ids = words.ids[np.maximum(np.repeat(low - 1, lengths) + at, 0)].astype(np.int32)
    later = np.repeat(number > 0, lengths)
    ids[~later & (at == 0)] = -1
    context = later & (at > 0) & (at <= shape.overlap)
    ids[context] = -2 - ids[context]
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))


def gather(docs: DataFrame, vocabulary: str, params: LmParams) -> DataFrame:
    """A written table of what the chunks tell: ``kind`` 0 words, 1 subword ids, 2 windows to train on.

    A window is the id before its own ids (-1 at the start of a text), then these; those that are context only are
    written as -2 - id.
    """
    end, shape = _end_id(vocabulary), params.shape

    def tell(group: pa.Table) -> pa.Table:
        cache = bpe.cache(vocabulary, "words")
        chunk = group.column("chunk")[0].as_py()
        keys, counts, ids_seen, taken = [], [], np.zeros(end + 1, np.int64), [pa.array([], pa.list_(pa.int32()))]
        for piece in slices(group.select(["text", "held_out"]).to_batches(), "text", SLICE):
            texts = _lowered(piece.column("text"))
            words = _Words.of(cache, texts, end)
            learn = ~piece.column("held_out").to_numpy(zero_copy_only=False)
            keys.append(words.distinct)
            counts.append(words.per_distinct(learn))
            ids_seen += np.bincount(words.ids[np.repeat(learn, np.diff(words.first_id))], minlength=end + 1)
            # A window is chosen by its text and number; equal texts offer the same ones.
            text, number = attention.window_places(words.first_id, shape)
            pick = mix(texts.fingerprints(texts.offsets[:-1], texts.offsets[1:]))
            chosen = learn[text] & (mix(pick[text] + number.astype(np.uint64)) % np.uint64(params.train_one_in) == 0)
            taken.append(_window_rows(words, text[chosen], number[chosen], shape))
        distinct, totals = _summed(keys, counts)
        seen = np.flatnonzero(ids_seen)
        rows = pa.concat_arrays(taken)
        n, m, k = len(distinct), len(seen), len(rows)
        return pa.table(
            {
                "kind": pa.array(np.repeat(np.array([0, 1, 2], np.int32), [n, m, k])), "chunk": pa.array(np.full(n + m + k, chunk, np.int32)),
                "key": pa.array(np.concatenate([distinct.view(np.int64), seen, np.arange(k)])),
                "n": pa.array(np.concatenate([totals, ids_seen[seen], np.zeros(k, np.int64)])),
                "ids": pa.concat_arrays([pa.nulls(n + m, rows.type), rows]),
            }
        )

    schema = "kind INT, chunk INT, key BIGINT, n BIGINT, ids ARRAY<INT>"
    return stage(_chunked(docs, params).groupBy("chunk").applyInArrow(tell, schema), "lm-gathered")


def fit(gathered: DataFrame, vocabulary: str, params: LmParams) -> tuple[attention.Vocabulary, dict[str, np.ndarray]]:
    """The model from the gathered ids and windows: each round, trainers go on from the same parameters over their own
    windows, and their results are averaged.  With ``params.once`` a round has its own share of the windows."""
    size, shape = bpe.vocabulary_size(vocabulary), params.shape
    each = gathered.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).collect()  # one row per id of the vocabulary
    known = attention.Vocabulary(np.array([r.key for r in each], np.int64), np.array([r.n for r in each], np.int64), size, shape)
    parameters = attention.initial(known, shape)
    rows = gathered.where("kind = 2")
    total = rows.count()
    if not total:
        return known, parameters
    rounds = max(1, len(params.rates)) if params.once else 1
    trainers = -(-total // (params.trainer_windows * rounds))
    place = F.pmod(F.xxhash64("chunk", "key"), F.lit(trainers * rounds))
    dealt = rows.select("chunk", "key", "ids", F.pmod(place, F.lit(trainers)).alias("trainer"), F.floor(place / trainers).alias("round"))
    rank = known.rank

    def trainer(rate: float, start: np.ndarray):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["chunk", "key"])
            n, length = len(group), shape.window
            inputs = np.full((n, length), shape.known + 1)
            targets, scored = np.zeros((n, length), np.int64), np.zeros((n, length), bool)
            for i, ids in enumerate(group["ids"]):
                ids = np.asarray(ids)
                plain = np.where(ids < -1, -2 - ids, ids)
                ranks = np.where(plain >= 0, rank[np.maximum(plain, 0)], shape.known + 1)
                m = len(ids) - 1
                inputs[i, :m], targets[i, :m], scored[i, :m] = ranks[:-1], ranks[1:], ids[1:] >= 0
            order = np.random.default_rng(5).permutation(n)
            done, _ = attention.train(attention.unflat(start, parameters), inputs[order], targets[order], scored[order], rate)
            return pd.DataFrame({"n": [n], "values": [attention.flat(done).astype(np.float64)]})

        return run

    for at, rate in enumerate(params.rates):
        now = dealt.where(F.col("round") == at % rounds).select("chunk", "key", "ids", "trainer")
        runs = now.groupBy("trainer").applyInPandas(trainer(rate, attention.flat(parameters)), "n BIGINT, values ARRAY<DOUBLE>")
        runs = runs.select("n", F.posexplode("values").alias("at", "value"))
        mean = runs.groupBy("at").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("value"))
        values = np.zeros(attention.flat(parameters).size)
        means = mean.collect()  # one row per parameter; none where so few windows leave a round without any
        if not means:
            continue
        for r in means:
            values[r["at"]] = r["value"]
        parameters = attention.unflat(values, parameters)
    return known, parameters


def scores(docs: DataFrame, params: LmParams = LmParams(), vocabulary: str | None = None) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, one row per row of ``docs``.

    Learns from the rows that are not held out and scores all; a null text is an empty one, of one token, its end.
    ``score`` is the model's log10 probability of the lower-cased words, each as the subwords of a space and the word,
    and the end.  A word is known by a 64-bit fingerprint.  Without learnable rows all counts are zero.
    """
    vocabulary = vocabulary or bpe.vocabulary_path(bpe.RANKS)
    spark, end, shape = docs.sparkSession, _end_id(vocabulary), params.shape
    gathered = gather(docs, vocabulary, params)
    words = gathered.where("kind = 0")
    per_word = words.groupBy("key").agg(F.sum("n").alias("c")).where("c > 0").agg(F.count("*").alias("v"), F.sum("c").alias("n")).first()
    ends = docs.where(~held_out()).count()
    distinct, total = per_word.v + (ends > 0), (per_word.n or 0) + ends
    shared = spark.sparkContext.broadcast(fit(gathered, vocabulary, params))

    # The counts that a chunk doesn't know already: those of words that other chunks have too.
    corpus = F.sum("n").over(Window.partitionBy("key"))
    dictionary = words.select("chunk", "key", "n", corpus.alias("c")).where("c != n").select("chunk", "key", "c")

    def score(group: pa.Table, counted: pa.Table) -> pa.Table:
        cache = bpe.cache(vocabulary, "words")
        known, parameters = shared.value
        keys = counted.column("key").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        keys, common = keys[order], counted.column("c").to_numpy()[order]
        group = group.select(["doc_id", "text", "held_out"])
        scorer = attention.Scorer(parameters)
        pieces = list(slices(group.to_batches(), "text", SLICE))
        marked = [piece.column("held_out").to_numpy(zero_copy_only=False) for piece in pieces]
        said = [_Words.of(cache, _lowered(piece.column("text")), end) for piece in pieces]
        # Words of this chunk alone are counted here.
        all_keys, counts = _summed([w.distinct for w in said], [w.per_distinct(~held) for w, held in zip(said, marked)])
        counts[np.searchsorted(all_keys, keys)] = common
        tables = []
        for piece, words in zip(pieces, said):
            n = piece.num_rows
            row = np.repeat(np.arange(n), np.diff(words.first))
            count = counts[np.searchsorted(all_keys, words.distinct)]
            n_tokens = np.diff(words.first) + 1
            n_known = np.bincount(row, (count > 0)[words.back], n).astype(np.int64) + (ends > 0)
            base = np.bincount(row, np.log10(count + 1.0)[words.back], n)
            base = base + np.log10(ends + 1.0) - n_tokens * np.log10(total + 1.0 * (distinct + 1))
            ranks = known.rank[words.ids]
            text, number = attention.window_places(words.first_id, shape)
            # Places are scored in the order of the texts' ids.
            natural = [np.zeros(0)]
            for at in range(0, len(text), WINDOWS_AT_ONCE):
                some = slice(at, at + WINDOWS_AT_ONCE)
                natural.append(scorer(*attention.windows(ranks, words.first_id, shape, (text[some], number[some]))))
            natural = np.concatenate(natural) + known.rest[words.ids]
            model = np.bincount(np.repeat(np.arange(n), np.diff(words.first_id)), natural, n) / np.log(10.0)
            tables.append(
                pa.table(
                    {
                        "doc_id": piece.column("doc_id"), "held_out": piece.column("held_out"), "n_tokens": pa.array(n_tokens),
                        "n_known": pa.array(n_known), "train_tokens": pa.array(np.full(n, total)),
                        "base_score": pa.array(base), "score": pa.array(model),
                    }
                )
            )
        return pa.concat_tables(tables)

    left = _chunked(docs, params).groupBy("chunk")
    return left.cogroup(dictionary.groupBy("chunk")).applyInArrow(
        score, "doc_id BIGINT, held_out BOOLEAN, n_tokens BIGINT, n_known BIGINT, train_tokens BIGINT, base_score DOUBLE, score DOUBLE"
    )


def op8_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), ALL_WINDOWS)
