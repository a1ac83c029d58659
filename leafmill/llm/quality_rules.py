"""Quality rules as weak supervision.

Each rule looks at one statistic of a text and votes good, bad or abstains. Expectation-maximisation over
the counts of vote patterns estimates how often each rule votes what on good and on bad texts; the
posterior probability of "good" given a text's votes then replaces an all-must-pass filter. Texts that fail
the base test teach nothing: they go anyway, and the rules have to tell the others apart.

Only pattern counts leave the executors: at most 3 ** len(RULES) rows, whatever the size of the corpus.

Defined results: a null or empty text has no words and fails the base test; repeated rows are judged alike
and each counts; very long texts are read whole; an empty table, or one in which all texts fail the base
test, gives no posterior and keeps nothing; only the named columns are read, so other columns don't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm import _words as W
from leafmill.llm._session import written

MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30
KEEP_PROBABILITY = 0.5
EM_STEPS = 200

#: rule: (statistic, votes bad at or below, votes bad at or above, votes good from, votes good to).
RULES = {
    "word_length": ("mean_chars", 2.0, 12.0, 3.0, 9.0),
    "symbols": ("symbol_share", -1.0, 0.1, 0.0, 0.02),
    "symbol_words": ("symbol_word_share", -1.0, 0.1, 0.0, 0.02),
    "duplicate_lines": ("dup_line_share", -1.0, 0.5, 0.0, 0.2),
    "repeated_words": ("repeat_share", -1.0, 0.25, 0.0, 0.1),
    "stutter": ("adjacent_share", -1.0, 0.2, 0.0, 0.05),
    "upper_case": ("upper_share", -1.0, 0.4, 0.0, 0.2),
    "marks": ("mark_share", -1.0, 1.0, 0.02, 0.5),
    "distinct_words": ("distinct_share", 0.15, 2.0, 0.45, 1.0),
}
_LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_distinct", "n_symbol_words", "n_adjacent")
STATS = T.StructType([T.StructField(n, T.LongType()) for n in _LONGS])
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".!?;:,")] = True


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it occur at least twice, and has it occurred before."""
    twice, before = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    if len(keys):
        order = np.argsort(keys)
        ranked = keys[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = ranked[1:] != ranked[:-1]
        runs = np.flatnonzero(fresh)
        lengths = np.diff(np.append(runs, len(keys)))
        twice[order] = np.repeat(lengths > 1, lengths)
        before[:] = twice
        before[np.minimum.reduceat(order, runs)] = False
    return twice, before


def slice_stats(texts: pa.Array) -> dict[str, np.ndarray]:
    """The statistics of a slice of whole texts."""
    w = W.Words(texts)
    data, offsets, n = w.data, w.offsets, len(w.counts)
    salt = W.mix(np.arange(1, n + 1, dtype=np.uint64))
    hashes = w.hashes()
    grams = W.windows(hashes, REPEAT_WINDOW)
    at = w.whole(REPEAT_WINDOW)
    repeated, _ = _again(W.mix(grams[at]) ^ salt[w.text[at]])
    cover = np.zeros(len(w.starts) + 1, np.int64)
    np.add.at(cover, at[repeated], 1)
    np.add.at(cover, at[repeated] + REPEAT_WINDOW, -1)
    covered = np.cumsum(cover)[:-1] > 0
    new_word = ~_again(hashes ^ salt[w.text])[1]

    symbolic = np.unique(np.searchsorted(w.starts, np.flatnonzero(_SYMBOL[data]), "right") - 1)

    breaks = np.flatnonzero(data == 0x0A)
    line_starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    owner = np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, "right") - 1])
    owner = np.sort(owner, kind="stable")
    line_ends = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    inside = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~w.space, out=inside[1:])
    wordy = np.flatnonzero(inside[line_ends] > inside[line_starts])
    line_text = owner[wordy]
    _, line_before = _again(w.spans(line_starts[wordy], line_ends[wordy]) ^ salt[line_text])

    return {
        "n_words": w.counts,
        "word_chars": _per_text(~w.space & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _per_text(_SYMBOL[data], offsets),
        "n_dup_lines": np.bincount(line_text[line_before], minlength=n),
        "n_repeat_words": np.bincount(w.text[covered], minlength=n),
        "n_lines": np.bincount(line_text, minlength=n),
        "n_upper": _per_text(_UPPER[data], offsets),
        "n_marks": _per_text(_MARK[data], offsets),
        "n_distinct": np.bincount(w.text[new_word], minlength=n),
        "n_symbol_words": np.bincount(w.text[symbolic], minlength=n),
        "n_adjacent": np.bincount(w.text[1:][(hashes[1:] == hashes[:-1]) & (w.text[1:] == w.text[:-1])], minlength=n),
    }


def _stats_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    names = [f.name for f in STATS.fields]
    for texts in batches:
        parts = [slice_stats(part) for _, part in W.pieces(texts)]
        columns = [np.concatenate([p[c] for p in parts] or [np.zeros(0, np.int64)]).astype(np.int64) for c in names]
        yield pa.StructArray.from_arrays([pa.array(c) for c in columns], names=names)


def text_stats(text: Column) -> Column:
    """A struct of the statistics of each whole text."""
    found = F.arrow_udf(_stats_batches, STATS, functionType=F.ArrowUDFType.SCALAR_ITER)
    return found.asNondeterministic()(text)  # so that no filter repeats it


def base_failed(stats: Column) -> Column:
    """The hard rules: under MIN_WORDS words, or more than MAX_REPEAT_PERCENT % of them in repeated windows."""
    n = stats["n_words"]
    return (n < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * n)


def pattern(stats: Column) -> Column:
    """The votes on one text as one integer: a base-3 digit for each rule, 0 bad, 1 abstains, 2 good."""
    share = lambda part, of: stats[part] / F.greatest(stats[of], F.lit(1))
    values = {
        "mean_chars": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "symbol_word_share": share("n_symbol_words", "n_words"),
        "adjacent_share": share("n_adjacent", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
        "mark_share": share("n_marks", "n_words"),
        "distinct_share": share("n_distinct", "n_words"),
    }
    votes = F.lit(0)
    for k, (name, low, high, good_from, good_to) in enumerate(RULES.values()):
        v = values[name]
        vote = F.when((v <= low) | (v >= high), 0).when((v >= good_from) & (v <= good_to), 2).otherwise(1)
        votes = votes + vote * 3**k
    return votes.cast("int")


def estimate(patterns: np.ndarray, counts: np.ndarray, steps: int = EM_STEPS) -> np.ndarray:
    """Posterior probability of "good" for each pattern, by expectation-maximisation over pattern counts.

    A rule's accuracy on a class is how often it votes bad, abstains and votes good there. The start takes a
    text with any bad vote to be good with probability 0.1, other texts with 0.9; a pseudo-vote of each kind,
    good class and bad, keeps every estimate inside (0, 1).
    """
    votes = (patterns[:, None] // 3 ** np.arange(len(RULES))) % 3
    kinds = [votes == v for v in range(3)]
    posterior = np.where(kinds[0].any(1), 0.1, 0.9)
    weight = counts.astype(float)
    for _ in range(steps):
        log = np.zeros((2, len(patterns)))
        for c, p in enumerate((1 - posterior, posterior)):
            p = p * weight
            told = np.stack([p @ kind + pseudo for kind, pseudo in zip(kinds, (1.0, 1.0, 1.0), strict=True)])
            accuracy = np.log(told / told.sum(0))
            log[c] = np.log(p.sum() + 1) + sum(kind @ accuracy[v] for v, kind in enumerate(kinds))
        after = 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))
        moved, posterior = np.abs(after - posterior).max(initial=0), after
        if moved < 1e-9:
            break
    return posterior


def fit(rows: DataFrame, stats: str) -> DataFrame:
    """From a struct column of statistics: (pattern, p_good) of each pattern of the texts that pass the base test."""
    patterns = rows.where(~base_failed(F.col(stats))).select(pattern(F.col(stats)).alias("pattern"))
    spark = rows.sparkSession
    seen = patterns.groupBy("pattern").count().toPandas()  # at most 3 ** len(RULES) rows
    p = estimate(seen["pattern"].to_numpy(np.int64), seen["count"].to_numpy(np.int64)) if len(seen) else []
    known = [(int(a), float(b)) for a, b in zip(seen["pattern"], p, strict=True)]
    return spark.createDataFrame(known, "pattern int, p_good double")


def judge(rows: DataFrame, model: DataFrame, stats: str) -> DataFrame:
    """rows with a struct column of statistics, plus (base_failed, p_good, kept)."""
    return (
        rows.withColumn("pattern", pattern(F.col(stats)))
        .join(F.broadcast(model), "pattern", "left")
        .withColumn("base_failed", base_failed(F.col(stats)))
        .withColumn("kept", ~F.col("base_failed") & (F.coalesce("p_good", F.lit(0.0)) >= KEEP_PROBABILITY))
    )


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its base statistics, base_failed, the posterior p_good and kept."""
    stats = written(docs.select(F.col(doc_id).alias("doc_id"), text_stats(F.col(text)).alias("s")), "quality")
    judged = judge(stats, fit(stats, "s"), "s")
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *[F.col("s")[c].alias(c) for c in base], "base_failed", "kept", "p_good")


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs whose text is kept, with all their columns.

    One pass over the texts writes statistics to learn from, another filters, so no text is written in between.
    """
    stats = text_stats(F.col(text))
    model = fit(written(docs.select(stats.alias("s")), "quality"), "s")
    return judge(docs.select(F.struct("*").alias("row"), stats.alias("s")), model, "s").where("kept").select("row.*")
