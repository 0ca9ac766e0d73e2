"""Language identification with spans of mixed-language text.

A word's script (by fixed Unicode ranges) narrows the candidates to the languages
that use it.  Each candidate scores the word by its character n-grams and its whole
form under a naive Bayes model with hashed features.  A Viterbi pass over the
words of a text, in which every change of language costs ``SWITCH`` nats, labels
them; runs of one label are the spans.  The language with most letters is that of the text.

Viterbi runs on blocks of ``BLOCK`` words side by side: for every state before a
block the best score of every state behind it is found, a text's blocks are chained,
and each block is then traced between its known ends.  A text of any length costs
time in proportion to it.

Texts that are null or have no letter are ``und`` with score 0 and no spans.  Every other
text gets a learned language, also one in a script that none uses; ``script_share`` tells.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatledger.llm.common import mixed, odd_numbers

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"

#: Feature buckets of a language's model; the model has this many numbers a language.
BUCKETS = 1 << 16
#: Training reads about this many documents of each language at most, drawn by hash.
TRAIN_DOCS = 20_000
NGRAMS = (1, 2, 3, 4)
SMOOTHING = 0.5
#: Scripts with a smaller share of a language's training words do not count as its own.
SCRIPT_SHARE = 0.01
#: Nats that a change of language costs, and that a word's features are scaled by.
SWITCH, SCALE = 8.0, 0.5
BLOCK = 128
BATCH_WORDS = 400_000

#: First code point of each range and its script; fixed values of the Unicode blocks.
SCRIPT_STARTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"),
    (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "other"),
    (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3130, "hangul"), (0x3190, "other"), (0x31F0, "kana"), (0x3200, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"),
    (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"),
    (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"),
    (0x20000, "han"), (0x32000, "other"),
]
SCRIPTS = sorted({s for _, s in SCRIPT_STARTS})
_STARTS = np.array([s for s, _ in SCRIPT_STARTS])
_SCRIPT_NO = np.array([SCRIPTS.index(s) for _, s in SCRIPT_STARTS])


def held_out(doc_id: Column) -> Column:
    """The fold that training never sees."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages
    uses: np.ndarray  # scripts x languages


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature buckets, the number of the word that each belongs to, and the words' scripts."""
    text = "\0" + "\0".join(words) + "\0"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    gap = points == 0
    word = np.cumsum(gap) - 1
    owners, buckets = [], []
    for n in NGRAMS:
        factors = odd_numbers(n, 100 + n)
        size = len(points) - n + 1
        total = np.full(size, n, np.uint64)
        for i in range(n):
            total += points[i : i + size] * factors[i]
        ok = word[:size] == word[max(0, n - 2) : max(0, n - 2) + size]
        ok &= word[:size] < len(words)
        if n == 1:
            ok &= ~gap
        owners.append(word[:size][ok])
        buckets.append(total[ok])
    starts = np.flatnonzero(gap)[:-1] + 1
    place = (np.arange(len(points)) - np.append(starts, 0)[np.minimum(word, len(words))]) % 64
    whole = np.add.reduceat(points * odd_numbers(64, 99)[place], starts)
    owners.append(np.arange(len(words)))
    buckets.append(whole)
    scripts = _SCRIPT_NO[np.searchsorted(_STARTS, points[starts].astype(np.int64), "right") - 1]
    spread = (mixed(np.concatenate(buckets)) & np.uint64(BUCKETS - 1)).astype(np.int64)
    return spread, np.concatenate(owners), scripts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, bucket, n`` of a partition; scripts follow the buckets."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        by_lang: dict[str, dict[str, int]] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen = by_lang.setdefault(lang, {})
            for w in WORD.findall(text.lower()):
                seen[w] = seen.get(w, 0) + 1
        for lang, seen in by_lang.items():
            if not seen:
                continue
            buckets, owners, scripts = _features(list(seen))
            times = np.fromiter(seen.values(), float, len(seen))
            sums = totals.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS)))
            sums[:BUCKETS] += np.bincount(buckets, times[owners], BUCKETS)
            sums[BUCKETS:] += np.bincount(scripts, times, len(SCRIPTS))
    for lang, sums in totals.items():
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(sums[at].astype(np.int64))],
            names=["lang", "bucket", "n"],
        )


def train(labelled: DataFrame, most_docs: int = TRAIN_DOCS) -> Model:
    """Fit the model to ``text, lang`` rows; null texts and langs are left out.

    A language with more than ``most_docs`` rows is thinned out to about that many by
    a hash of the text.  The driver holds ``BUCKETS`` numbers for each distinct ``lang``.
    """
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPTS), 0), bool))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, most_docs / n))])
    draw = F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1_000_000)) / 1_000_000
    sample = rows.where(draw < share[F.col("lang")])
    counts = sample.mapInArrow(_count, "lang string, bucket int, n long")
    table = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    languages = sorted(table["lang"].unique())
    number = {lang: i for i, lang in enumerate(languages)}
    sums = np.zeros((BUCKETS + len(SCRIPTS), len(languages)))
    sums[table["bucket"], table["lang"].map(number).astype(int)] = table["n"]
    features, scripts = sums[:BUCKETS] + SMOOTHING, sums[BUCKETS:]
    weights = np.log(features / features.sum(axis=0))
    uses = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1)
    return Model(languages, (SCALE * weights).astype(np.float32), uses)


def word_scores(words: list[str], model: Model) -> np.ndarray:
    """Score of every word in every language; languages that do not use the word's
    script come last by far, unless none uses it."""
    buckets, owners, scripts = _features(words)
    out = np.empty((len(words), len(model.languages)), np.float32)
    for i in range(len(model.languages)):
        out[:, i] = np.bincount(owners, model.weights[buckets, i], len(words))
    if not model.languages:
        return out
    out -= out.max(axis=1, keepdims=True)
    uses = model.uses[scripts]
    out[~uses & uses.any(axis=1, keepdims=True)] -= 50
    return out


def best_path(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Viterbi labels of the words of several texts that lie one after another."""
    kinds = scores.shape[1]
    per_text = -(-lengths // BLOCK)
    blocks = int(per_text.sum())
    if not blocks or not kinds:
        return np.zeros(len(scores), np.int64)
    first_block = np.cumsum(per_text) - per_text
    text = np.repeat(np.arange(len(lengths)), lengths)
    inside = np.arange(len(text)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    row, column = first_block[text] + inside // BLOCK, inside % BLOCK
    cells = np.zeros((BLOCK, blocks, kinds), np.float32)
    cells[column, row] = scores

    # Best score from every state before a block to every state behind it.
    through = np.where(np.eye(kinds, dtype=bool), 0, -1e30).astype(np.float32)
    through = np.repeat(through[None], blocks, axis=0)
    for t in range(BLOCK):
        np.maximum(through, through.max(axis=2, keepdims=True) - switch, out=through)
        through += cells[t][:, None, :]

    entry = np.zeros((blocks, kinds), np.float32)
    state = np.zeros((len(lengths), kinds), np.float32)
    order = np.argsort(-per_text, kind="stable")
    for k in range(int(per_text.max())):
        live = order[: np.searchsorted(-per_text[order], -k)]
        at = first_block[live] + k
        entry[at] = state[live]
        state[live] = (state[live][:, :, None] + through[at]).max(axis=1)
        state[live] -= state[live].max(axis=1, keepdims=True)
    leave = np.zeros(blocks, np.int64)
    enter = np.zeros(blocks, np.int64)
    end = state.argmax(axis=1)
    for k in range(int(per_text.max()) - 1, -1, -1):
        live = order[: np.searchsorted(-per_text[order], -k)]
        at = first_block[live] + k
        leave[at] = end[live]
        enter[at] = (entry[at] + through[at, :, end[live]]).argmax(axis=1)
        end[live] = enter[at]

    every = np.arange(blocks)
    best = np.full((blocks, kinds), -1e30, np.float32)
    best[every, enter] = 0
    jumped = np.zeros((BLOCK, blocks, kinds), bool)
    source = np.zeros((BLOCK, blocks), np.int64)
    for t in range(BLOCK):
        source[t] = best.argmax(axis=1)
        change = best[every, source[t]][:, None] - switch
        jumped[t] = best < change
        best = np.maximum(best, change) + cells[t]
    labels = np.zeros((BLOCK, blocks), np.int64)
    now = leave
    for t in range(BLOCK - 1, -1, -1):
        labels[t] = now
        now = np.where(jumped[t, every, now], source[t], now)
    return labels[column, row]


def _known_letters(words: list[str], letters: np.ndarray, model: Model) -> np.ndarray:
    """Letters of every word in scripts that some language of the model uses."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    known = model.uses.any(axis=1)[_SCRIPT_NO[np.searchsorted(_STARTS, points, "right") - 1]]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return np.minimum(np.add.reduceat(known.astype(np.int64), np.cumsum(sizes) - sizes), letters)


def _label(texts: list[str | None], model: Model) -> list[tuple[str, float, list[dict], float]]:
    found = [[w for w in WORD.findall(t.lower())] if t else [] for t in texts]
    index: dict[str, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for ws in found for w in ws), np.int64)
    lengths = np.array([len(ws) for ws in found])
    letters = np.fromiter((sum(map(str.isalpha, w)) if not w.isalpha() else len(w) for w in index), np.int64, len(index))
    scores = word_scores(list(index), model) if index else np.zeros((0, len(model.languages)), np.float32)
    scores[letters == 0] = 0
    labels = best_path(scores[ids], lengths)
    known = _known_letters(list(index), letters, model) if index else letters
    out, at = [], 0
    for text, size in zip(texts, lengths):
        own, weight = labels[at : at + size], letters[ids[at : at + size]]
        in_known = known[ids[at : at + size]].sum()
        at += size
        if not weight.sum():
            out.append((UNKNOWN, 0.0, [], 0.0))
            continue
        if not model.languages:
            out.append((UNKNOWN, 0.0, [], 0.0))
            continue
        totals = np.bincount(own, weight, len(model.languages))
        top = int(totals.argmax())
        out.append((model.languages[top], float(totals[top] / totals.sum()), _spans(text, own, model), float(in_known / weight.sum())))
    return out


def _spans(text: str, labels: np.ndarray, model: Model) -> list[dict]:
    cuts = np.flatnonzero(np.diff(labels)) + 1
    first = np.concatenate([[0], cuts])
    last = np.concatenate([cuts, [len(labels)]]) - 1
    if len(first) == 1:
        # The last word ends where no letter follows.
        end = len(text)
        while not WORD.match(text[end - 1]):
            end -= 1
        ends = [(WORD.search(text).start(), end)]
    else:
        # Positions in the text as given: lower-casing can lengthen it, but keeps the words.
        places = [m.span() for m in WORD.finditer(text)]
        ends = [(places[min(a, len(places) - 1)][0], places[min(b, len(places) - 1)][1]) for a, b in zip(first, last)]
    return [{"start": s, "end": e, "lang": model.languages[labels[a]]} for (s, e), a in zip(ends, first)]


def _batches_of_words(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``BATCH_WORDS`` words (six characters each)."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "") // 6 + BLOCK
        if size >= BATCH_WORDS:
            yield start, i + 1
            start, size = i + 1, 0
    yield start, len(texts)


SPANS = "array<struct<start: int, end: int, lang: string>>"


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``script_share`` (the share of letters in scripts that some learned
    language uses), ``lang_pred``, ``score`` (the share of letters in spans of that
    language) and ``spans`` (character ranges, end exclusive).  Columns of these names are replaced; all other columns stay as they are, a row for a row."""
    spark: SparkSession = docs.sparkSession
    docs = docs.drop("lang_pred", "score", "spans", "script_share")
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    arrow_spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for start, end in _batches_of_words(texts):
                if start == end:
                    continue
                lang, score, spans, known = zip(*_label(texts[start:end], shared.value))
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(known, pa.float64()), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(spans, arrow_spans)],
                    names=[*batch.schema.names, "script_share", "lang_pred", "score", "spans"],
                )

    from pyspark.sql import types as T

    schema = T.StructType(list(docs.schema.fields))
    schema = schema.add("script_share", "double").add("lang_pred", "string").add("score", "double")
    schema = schema.add("spans", T._parse_datatype_string(SPANS))
    return docs.mapInArrow(run, schema)
