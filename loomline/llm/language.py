"""Language of whole texts and of the spans within them.

Letters' script ranges say which languages a word can be of; among those, letter n-grams score the word; Viterbi over the
words of a text, with a penalty for each switch, labels spans of one language. The text's language is the one
of most words, its score the share of these words.

The model is learned from at most about ``SAMPLE_ROWS`` labelled rows of each language, chosen by a hash of the id among
the rows that ``learned_from`` allows, whole texts of them; the n-gram counts are Spark aggregates, cut at
``GRAMS`` n-grams a language, most frequent first. Prediction covers every row and reads the text only.

Defined cases: a null text, one without letters, and any text if nothing could be learned is ``und`` with score 0 and no span;
words without letters belong to no span count; equal texts get equal results; ties go to the first language by
name; other columns are kept, one of an output's name is replaced; an empty table gives no rows.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.session import materialize

SAMPLE_ROWS, GRAMS = 2000, 60_000
SWITCH_PENALTY = 12.0
BLOCK_WORDS = 256
BATCH_WORDS, FORM_CACHE, WORD_CACHE = 250_000, 300_000, 600_000
UNKNOWN = "und"
#: First code points of script ranges; a range ends where the next begins.
SCRIPT_RANGES = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB13, "other"), (0x20000, "han"), (0x32000, "other"),
)
_STARTS = [s for s, _ in SCRIPT_RANGES]
_script = lru_cache(1 << 16)(lambda letter: script(letter))


def script(letter: str) -> str:
    return SCRIPT_RANGES[bisect_right(_STARTS, ord(letter)) - 1][1]


def scripts_of(word: str) -> set[str]:
    return {"latin"} if word.isascii() else {_script(c) for c in word}


def letters(word: str) -> str:
    return word.lower() if word.isalpha() else "".join(filter(str.isalpha, word.lower()))


def grams(word: str, sizes: tuple[int, ...] = (2, 3)) -> list[str]:
    padded = f"^{word}$"
    return [padded[i:i + n] for n in sizes for i in range(len(padded) - n + 1)]


@dataclass
class Model:
    languages: list[str]
    scripts: dict[str, list[int]]  # script -> languages written in it
    scores: dict[str, list[float]]  # n-gram -> log probability by language
    floor: list[float]  # of n-grams never seen, by language


class _Scorer:
    """Scores of words by a model; words are looked up as they stand, then by their letters, then scored together."""

    def __init__(self, model: Model):
        self.model = model
        self.rank = {g: i for i, g in enumerate(model.scores)}
        self.grams = np.array([*model.scores.values(), model.floor], np.float32).reshape(-1, max(1, len(model.languages)))
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.spelt: dict[str, int] = {"": -1}
        self.table = np.empty((0, self.grams.shape[1]), np.float32)

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores by language of the words that have letters, and which words these are."""
        if len(self.spelt) > WORD_CACHE:
            self._forget()
        elif len(self.index) > FORM_CACHE:
            self.index = {}
        found = list(map(self.index.get, words))
        new = {words[i] for i, at in enumerate(found) if at is None}
        if new:
            own = {w: letters(w) for w in new}
            self._learn(sorted({x for x in own.values() if x not in self.spelt}))
            self.index.update((w, self.spelt[x]) for w, x in own.items())
            found = list(map(self.index.get, words))
        at = np.array(found, np.int64)
        spoken = np.flatnonzero(at >= 0)
        return self.table[at[spoken]], spoken

    def _learn(self, words: list[str]) -> None:
        if not words:
            return
        rank, unseen, model = self.rank, len(self.rank), self.model
        parts = [[rank.get(g, unseen) for g in grams(w)] for w in words]
        starts = np.cumsum([0, *map(len, parts[:-1])])
        scores = np.add.reduceat(self.grams[np.fromiter(chain.from_iterable(parts), np.int64)], starts)
        every = set(range(len(model.languages)))
        for i, word in enumerate(words):
            able = set().union(*(model.scripts.get(s, ()) for s in scripts_of(word))) or every
            if len(able) < len(every):
                scores[i, sorted(every - able)] = -1e4
        scores = np.maximum(scores - scores.max(1, keepdims=True), -1e3)
        self.spelt.update((w, len(self.table) + i) for i, w in enumerate(words))
        self.table = np.concatenate([self.table, scores])


def _forward(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, init: np.ndarray, penalty: float, keep: bool):
    """Best value of ending in each state for every run of words; all runs advance together, the longest first.

    With ``keep`` also where a state was entered by a switch, and from which state.
    """
    order = np.argsort(-lengths, kind="stable")
    at0, sizes, value = starts[order], lengths[order], init[order].astype(np.float64)
    steps = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(steps), side="left")  # runs longer than the step
    switched = np.zeros(scores.shape, bool) if keep else None
    source = np.zeros(len(scores), np.int16) if keep else None
    rows = np.arange(len(sizes))
    for t in range(steps):
        a = active[t]
        at, now = at0[:a] + t, value[:a]
        if t:
            best = now.argmax(1)
            jump = (now[rows[:a], best] - penalty)[:, None]
            if keep:
                switched[at] = now < jump
                source[at] = best
            now = np.maximum(now, jump)
        value[:a] = now + scores[at]
    out = np.empty_like(value)
    out[order] = value
    return out, switched, source


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float, block: int = BLOCK_WORDS) -> np.ndarray:
    """Best state of every word; the texts' words stand one after the other in ``scores``.

    Texts are cut into blocks that advance side by side, so a long text takes no more steps than a short one. For texts of
    several blocks, the best value from each state before a block to each state at its end is found first; a walk
    over the blocks then fixes the states at their borders, which makes the cut exact.
    """
    states = scores.shape[1]
    cuts = np.maximum(-(-lengths // block), (lengths > 0).astype(np.int64))
    text = np.repeat(np.arange(len(lengths)), cuts)
    first = np.cumsum(np.r_[0, cuts[:-1]])  # of a text's blocks
    number = np.arange(len(text)) - first[text]
    starts = np.cumsum(np.r_[0, lengths[:-1]])[text] + number * block
    sizes = np.minimum(lengths[text] - number * block, block)
    stays = np.where(np.eye(states, dtype=bool), 0.0, -penalty)  # from the state before a block
    before, last = np.full(len(text), -1), np.full(len(text), -1)
    many = np.flatnonzero(cuts > 1)
    if len(many):
        cut = np.flatnonzero(cuts[text] > 1)
        init = np.where((number[cut] > 0)[:, None, None], stays, 0.0).reshape(-1, states)
        through, _, _ = _forward(scores, np.repeat(starts[cut], states), np.repeat(sizes[cut], states), init, penalty, False)
        through = through.reshape(-1, states, states)
        place = np.full(len(text), -1)
        place[cut] = np.arange(len(cut))
        entered = np.zeros((len(cut), states), np.int64)
        value = through[place[first[many]], 0]
        for j in range(1, int(cuts[many].max())):
            on = cuts[many] > j
            at = place[first[many[on]] + j]
            paths = value[on][:, :, None] + through[at]
            entered[at] = paths.argmax(1)
            value[on] = paths.max(1)
        state = value.argmax(1)
        for j in range(int(cuts[many].max()) - 1, -1, -1):
            on = cuts[many] > j
            own = first[many[on]] + j
            last[own] = state[on]
            if j:
                state[on] = entered[place[own], state[on]]
                before[own] = state[on]
    init = np.where((before >= 0)[:, None], stays[before], 0.0)
    value, switched, source = _forward(scores, starts, sizes, init, penalty, True)
    here = np.where(last >= 0, last, value.argmax(1) if len(value) else last).astype(np.int16)
    order = np.argsort(-sizes, kind="stable")
    here, at0, ends = here[order], starts[order], sizes[order]
    found = np.zeros(len(scores), np.int16)
    steps = int(ends[0]) if len(ends) else 0
    active = np.searchsorted(-ends, -np.arange(steps), side="left")
    for t in range(steps - 1, -1, -1):
        a = active[t]
        at = at0[:a] + t
        found[at] = here[:a]
        here[:a] = np.where(switched[at, here[:a]], source[at], here[:a])
    return found


def learn(docs: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of the labelled rows where ``allowed`` holds."""
    rows = docs.filter(allowed & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(id_col, text_col).alias("h"))
    known = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not known:
        return Model([], {}, {}, [])
    share = F.create_map(*[x for lang, n in known.items() for x in (F.lit(lang), F.lit(min(1.0, SAMPLE_ROWS / n)))])
    some = rows.filter(F.pmod("h", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)).select("lang", "text")

    def count(batches):
        found: Counter = Counter()

        def flush():
            keys = list(found)
            yield pa.record_batch([[k[0] for k in keys], [k[1] for k in keys], list(found.values())], names=["lang", "gram", "n"])
            found.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word, n in Counter(text.as_py().split()).items():
                    own = letters(word)
                    if own:
                        for g in grams(own, (1, 2, 3)):
                            found[lang, g] += n
                if len(found) > 400_000:
                    yield from flush()
        if found:
            yield from flush()

    counted = some.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "grams")
    table = {}
    for lang in known:
        table[lang] = {r.gram: r.n for r in counted.filter(F.col("lang") == lang).orderBy(F.desc("n"), "gram").limit(GRAMS).collect()}
    languages = sorted(lang for lang in known if table[lang])
    every = sorted(g for g in set().union(*(table[lang] for lang in languages)) if len(g) > 1)
    totals = [sum(n for g, n in table[lang].items() if len(g) > 1) + 0.5 * len(every) for lang in languages]
    scores = {g: [math.log((table[lang].get(g, 0) + 0.5) / t) for lang, t in zip(languages, totals)] for g in every}
    scripts: dict[str, list[int]] = {}
    for k, lang in enumerate(languages):
        seen: Counter = Counter()
        for g, n in table[lang].items():
            if len(g) == 1 and g not in "^$":
                seen[script(g)] += n
        for s, n in seen.items():
            if 100 * n >= sum(seen.values()):
                scripts.setdefault(s, []).append(k)
    return Model(languages, scripts, scores, [math.log(0.5 / t) for t in totals])


def identify(docs: DataFrame, model: Model, text_col: str = "text", penalty: float = SWITCH_PENALTY) -> DataFrame:
    """The rows with lang_pred, score and ``spans``: (first word, words, language) by words between white space."""
    names = ["lang_pred", "score", "spans"]
    kept = docs.drop(*names)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    schema = kept.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0),
                               "spans": F.array(F.struct(F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("n"), F.lit("").alias("lang")))}).schema
    span = pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64()), ("lang", pa.string())]))
    place = kept.columns.index(text_col)

    def predict(batches):
        own = shared.value
        scorer = _Scorer(own)
        for batch in batches:
            at = 0
            column = batch.column(place)
            while at < batch.num_rows:
                words, lengths, to = [], [], at
                while to < batch.num_rows and len(words) < BATCH_WORDS:
                    found = (column[to].as_py() or "").split()
                    words += found
                    lengths.append(len(found))
                    to += 1
                yield _labelled(batch.slice(at, to - at), words, np.array(lengths, np.int64), scorer, penalty, span)
                at = to

    return kept.mapInArrow(predict, schema)


def _labelled(batch, words, lengths, scorer, penalty, span) -> pa.RecordBatch:
    languages = scorer.model.languages
    texts = np.repeat(np.arange(len(lengths)), lengths)
    if languages and words:
        scores, spoken = scorer(words)
    else:
        scores, spoken = np.zeros((0, 1), np.float32), np.zeros(0, np.int64)
    owner = texts[spoken]
    own = np.bincount(owner, minlength=len(lengths))
    state = viterbi(scores, own, penalty)
    votes = np.zeros((len(lengths), max(1, len(languages))), np.int64)
    np.add.at(votes, (owner, state), 1)
    best = votes.argmax(1)
    first = np.cumsum(np.r_[0, lengths[:-1]])
    changes = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (state[1:] != state[:-1])]) if len(owner) else np.zeros(0, np.int64)
    ends = np.r_[changes[1:], len(owner)]
    spans: list[list[dict]] = [[] for _ in lengths]
    for a, b in zip(changes.tolist(), ends.tolist()):
        text = int(owner[a])
        begin = int(spoken[a] - first[text])
        spans[text].append({"first": begin, "n": int(spoken[b - 1] - first[text]) - begin + 1, "lang": languages[state[a]]})
    predicted = [languages[b] if n else UNKNOWN for b, n in zip(best, own)]
    score = np.where(own > 0, votes.max(1) / np.maximum(own, 1), 0.0)
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(predicted, pa.string()), pa.array(score, pa.float64()), pa.array(spans, span)],
                                      names=[*batch.schema.names, "lang_pred", "score", "spans"])


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from: remainder 2, and rows without an id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))
