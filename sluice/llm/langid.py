"""Language identification of mixed-language texts (operator 6)."""

from __future__ import annotations

import functools
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from .common import by_batch, table, tune

#: Rows of labelled text that the model is fitted on (expected number; chosen by hash of doc_id).
TRAIN_ROWS = 12_000
#: Character n-grams fall into this many buckets, so a model has a fixed size per language.
BUCKETS = 1 << 17
SIZES = (1, 2, 3, 4)
#: Log-probability that a change of language costs in the Viterbi path.
SWITCH = 8.0
#: Code points of text that are worked on at once (a longer text alone), code points of new words that
#: are scored at once, and bytes of scores that a worker remembers; they bound the memory of a task.
CHUNK, SLICE, REMEMBERED = 1 << 19, 1 << 17, 8 << 20
UNKNOWN = "und"

#: (script, first, last): code point ranges of the scripts that are told apart.
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F),
    ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF),
    ("tamil", 0xB80, 0xBFF), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("latin", 0x1E00, 0x1EFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)
NAMES = tuple(dict.fromkeys(s for s, _, _ in SCRIPTS))
_EDGES = np.array([e for _, a, b in SCRIPTS for e in (a, b + 1)])
_KIND = np.array([k for s, _, _ in SCRIPTS for k in (NAMES.index(s), -1)])


def script_of(code: np.ndarray) -> np.ndarray:
    """Index of each code point's script in NAMES, or -1."""
    i = np.searchsorted(_EDGES, code, side="right") - 1
    return np.where(i >= 0, _KIND[np.maximum(i, 0)], -1)


@functools.cache
def _kinds() -> np.ndarray:
    """1 for letters, 2 for combining marks, 0 for the rest, by code point."""
    first = np.frombuffer("".join(unicodedata.category(chr(c))[0] for c in range(0x110000)).encode(), np.uint8)
    return (first == ord("L")) + 2 * (first == ord("M")).astype(np.uint8)


def word_places(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts joined by line feeds; start, end, text and number of letters of every word in it.

    A word is a letter with the letters and combining marks that follow it.
    """
    joined = "\n".join(texts)
    kind = _kinds()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    run = np.concatenate([[False], kind > 0, [False]])
    edge = np.flatnonzero(run[1:] != run[:-1])
    start, end = edge[::2], edge[1::2]
    letters = np.concatenate([[0], np.cumsum(kind == 1)])
    at = np.append(np.flatnonzero(kind == 1), len(kind))
    start = at[letters[start]]  # the first letter from there on
    start, end = start[start < end], end[start < end]
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]])
    return joined, start, end, np.searchsorted(begin, start, side="right") - 1, letters[end] - letters[start]


def words_in(texts: list[str]) -> list[str]:
    joined, start, end, _, _ = word_places(texts)
    return [joined[a:b].lower() for a, b in zip(start.tolist(), end.tolist(), strict=True)]


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of every character n-gram of the words, with a blank on both sides."""
    text = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    blank = text == 32
    word = np.cumsum(blank) - 1  # a blank counts to the word after it
    n, buckets, owners = len(text), [], []
    h = np.zeros(n, np.uint64)
    for size in range(1, max(SIZES) + 1):
        h = h[: n - size + 1] * np.uint64(0x100000001B3) + text[size - 1 :] * np.uint64(0x9E3779B97F4A7C15)
        if size in SIZES:
            # An n-gram may start or end with a blank, but none lies inside it, and it isn't one alone.
            ok = ~blank[: n - size + 1] if size == 1 else np.ones(n - size + 1, bool)
            for i in range(1, size - 1):
                ok &= ~blank[i : n - size + 1 + i]
            if size == 2:
                ok &= ~(blank[: n - 1] & blank[1:])
            k = ((h ^ (h >> np.uint64(29))) * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(64 - BUCKETS.bit_length() + 1)
            buckets.append(k[ok].astype(np.int64))
            owners.append(word[: n - size + 1][ok])
    return np.concatenate(buckets), np.concatenate(owners)


class Model:
    """Log-probabilities of n-gram buckets per language, and the languages' scripts."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        total = counts.sum(1, keepdims=True)
        self.logp = np.log((counts + 0.5) / (total + 0.5 * BUCKETS)).T.astype(np.float32).copy()  # bucket x language
        share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
        self.uses = np.vstack([(share > 0.01).T, np.ones((1, len(langs)), bool)])  # script (last: none) x language

    def word_scores(self, words: list[str]) -> np.ndarray:
        """A score per word and language: the mean n-gram log-probability times the root of their
        number, against the mean of all languages; languages that don't use the script of the word's
        first letter are out, unless no language does."""
        buckets, owner = word_grams(words)
        order = np.argsort(owner, kind="stable")
        buckets, owner = buckets[order], owner[order]
        start = np.searchsorted(owner, np.arange(len(words)))
        sums = np.add.reduceat(self.logp[buckets], start, axis=0)
        n = np.diff(np.append(start, len(owner)))[:, None]
        scores = sums / np.sqrt(n)
        uses = self.uses[script_of(np.fromiter((ord(w[0]) for w in words), np.int64, len(words)))]
        uses |= ~uses.any(1, keepdims=True)
        low = np.where(uses, scores, np.inf).min(1, keepdims=True)
        scores = np.where(uses, scores, low - 20)
        return (scores - scores.max(1, keepdims=True)).astype(np.float32)


class Scorer:
    """Scores of words by a model, remembered up to a bound."""

    def __init__(self, model: Model):
        self.model, self.most = model, REMEMBERED // (4 * len(model.langs))
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.model.langs)), np.float32)
        self.used = np.zeros(0, bool)
        self.size = 0

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A row of scores per word, and whether some language uses the script it begins with."""
        new = [w for w in dict.fromkeys(words) if w not in self.index]
        if len(self.index) + len(new) > self.most or self.size > REMEMBERED:
            self._forget()
            new = list(dict.fromkeys(words))
        at = 0
        while at < len(new):
            size, stop = 0, at
            while stop < len(new) and (stop == at or size + len(new[stop]) <= SLICE):
                size += len(new[stop])
                stop += 1
            some = new[at:stop]
            self.index.update(zip(some, range(len(self.index), len(self.index) + len(some)), strict=True))
            self.rows = np.concatenate([self.rows, self.model.word_scores(some)])
            script = script_of(np.fromiter((ord(w[0]) for w in some), np.int64, len(some)))
            self.used = np.concatenate([self.used, (script >= 0) & self.model.uses[script].any(1)])
            self.size, at = self.size + size, stop
        ids = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        return self.rows[ids], self.used[ids]


def viterbi(scores: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """Best language per word of each text: all texts advance together, longest first."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    lengths = np.array([len(scores[i]) for i in order])
    out = [np.zeros(len(s), np.int16) for s in scores]
    if not len(order) or not lengths[0]:
        return out
    flat = np.concatenate([scores[i] for i in order])
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    alive = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # texts longer than t
    best = flat[begin[: alive[0]]].copy()
    back = np.zeros(flat.shape, np.int16)
    stay = np.arange(flat.shape[1], dtype=np.int16)
    final = best.copy()
    for t in range(1, lengths[0]):
        n = alive[t]
        best = best[:n]
        change = best.max(1, keepdims=True) - switch
        moved = best < change
        back[begin[:n] + t] = np.where(moved, best.argmax(1)[:, None].astype(np.int16), stay)
        best = np.where(moved, change, best) + flat[begin[:n] + t]
        final[:n] = best
    path = np.zeros(len(flat), np.int16)
    state = final.argmax(1).astype(np.int16)
    for t in range(lengths[0] - 1, -1, -1):
        n = alive[t]
        path[begin[:n] + t] = state[:n]
        if t:
            state[:n] = back[begin[:n] + t, state[:n]]
    for k, i in enumerate(order):
        out[i] = path[begin[k] : begin[k] + lengths[k]]
    return out


def held_out(doc_id=None):
    return F.crc32((F.col("doc_id") if doc_id is None else doc_id).cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """Counts n-grams and scripts of texts with a lang, of documents that aren't held out.

    About `rows` of them are chosen by a hash of doc_id. What comes to the driver are counts per
    language and bucket, at most languages x BUCKETS numbers.
    """
    tune(docs.sparkSession)
    usable = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~F.coalesce(held_out(), F.lit(False)))
    n = usable.select("lang").count()
    if n > rows:
        usable = usable.where(F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 30)) < int((1 << 30) * rows / n))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for batch in batches:
            words: dict[str, Counter] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(words_in([text]))
            for lang, found in words.items():
                if not found:
                    continue
                times, distinct = np.fromiter(found.values(), np.float64), list(found)
                for i in range(0, len(distinct), SLICE // 8):
                    buckets, owner = word_grams(distinct[i : i + SLICE // 8])
                    grams[lang] = grams.get(lang, 0) + np.bincount(buckets, times[i : i + SLICE // 8][owner], BUCKETS)
                first = script_of(np.fromiter((ord(w[0]) for w in found), np.int64, len(found)))
                scripts[lang] = scripts.get(lang, 0) + np.bincount(first + 1, times, len(NAMES) + 1)[1:]
        for lang, c in grams.items():
            k = np.flatnonzero(c)
            s = np.flatnonzero(scripts[lang])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(k) + len(s))), pa.array(np.concatenate([k, BUCKETS + s]).astype(np.int64)), pa.array(np.concatenate([c[k], scripts[lang][s]]).astype(np.int64))], ["lang", "bucket", "n"])

    counted = usable.select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counted["lang"].unique())
    if not langs:
        return None
    at = counted["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()
    full = np.zeros((len(langs), BUCKETS + len(NAMES)))
    full[at, counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    return Model(langs, full[:, :BUCKETS], full[:, BUCKETS:])


def label_texts(texts: list[str | None], scorer: Scorer, spans: bool = True) -> list[tuple[str, float, float, list[tuple[int, int, str]]]]:
    """(language, score, known, spans) per text: score is the share of letters that the language has,
    known that of letters in words whose script some language uses; spans are (start, end, language)
    of code points. Texts of like length are worked on together, CHUNK code points at once."""
    out: list = [(UNKNOWN, 0.0, 0.0, [])] * len(texts)
    order = sorted((i for i, t in enumerate(texts) if t), key=lambda i: -len(texts[i]))
    at = 0
    while at < len(order):
        size, stop = 0, at
        while stop < len(order) and (stop == at or size + len(texts[order[stop]]) <= CHUNK):
            size += len(texts[order[stop]])
            stop += 1
        for i, got in zip(order[at:stop], _labelled([texts[i] for i in order[at:stop]], scorer, spans), strict=True):
            out[i] = got
        at = stop
    return out


def _labelled(texts: list[str], scorer: Scorer, spans: bool) -> Iterator[tuple[str, float, float, list[tuple[int, int, str]]]]:
    joined, start, end, owner, letters = word_places(texts)
    langs = scorer.model.langs
    scores, used = scorer.of([joined[a:b].lower() for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    paths = viterbi([scores[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
    offset = 0
    for text, a, b, path in zip(texts, cuts, cuts[1:], paths, strict=False):
        if a == b:
            yield UNKNOWN, 0.0, 0.0, []
        else:
            by = np.bincount(path, letters[a:b], len(langs))
            found = []
            if spans:
                cut = np.flatnonzero(np.diff(path)) + 1
                begins, ends = np.concatenate([[0], cut]), np.append(cut, len(path)) - 1
                found = [(int(start[a + x]) - offset, int(end[a + y]) - offset, langs[path[x]]) for x, y in zip(begins, ends, strict=True)]
            yield langs[int(by.argmax())], float(by.max() / by.sum()), float(letters[a:b][used[a:b]].sum() / by.sum()), found
        offset += len(text) + 1


class _Labels:
    """What a worker does with a batch of texts; its scorer lives as long as the task."""

    def __init__(self, held):
        self.held, self.scorer = held, None

    def __call__(self, texts: pa.Array, spans: bool = False) -> list[tuple]:
        if not self.held.value:
            return [(UNKNOWN, 0.0, 0.0, [])] * len(texts)
        self.scorer = self.scorer or Scorer(self.held.value)
        return label_texts(texts.to_pylist(), self.scorer, spans)


def identify(docs: DataFrame, model: Model | None, spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score (and spans) of whole texts.

    lang_pred is the language with the most letters on the Viterbi path over the words, score their
    share of all letters; of equal ones the first by name. Only characters of Unicode's letter
    categories are letters. Null text and text without a letter give `und` and 0; so does a model
    without any language. Rows that repeat and rows with a null doc_id stay; lang and source aren't
    read; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    tune(spark)
    labels = _Labels(spark.sparkContext.broadcast(model))
    schema = "doc_id long, lang_pred string, score double" + ", spans array<struct<start:int,end:int,lang:string>>" * spans

    def label(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = labels(batch.column(1), spans)
        cols = [batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
        if spans:
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
            cols.append(pa.array([[{"start": a, "end": b, "lang": x} for a, b, x in g[3]] for g in got], kind))
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "lang_pred", "score", "spans"][: len(cols)])

    return by_batch(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), label, schema)


def accepted(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """docs whose language is known: texts with a letter, of whose letters at least the share `least`
    are in words of a script that some language of the model uses. A text in several known languages
    stays. Null and letterless texts go; without a model all go; columns and repeated rows stay."""
    known = "lang_known"
    while known in docs.columns:
        known += "_"
    return with_language(docs, model, known=known).where(F.col(known) >= least).select(*docs.columns)


def with_language(docs: DataFrame, model: Model | None, lang: str | None = None, score: str | None = None, known: str | None = None) -> DataFrame:
    """docs with up to three more columns, of names that docs doesn't have: language, score and the
    share of letters in known scripts; its own columns and rows stay."""
    tune(docs.sparkSession)
    labels = _Labels(docs.sparkSession.sparkContext.broadcast(model))
    at = docs.columns.index("text")
    added = [(name, k, kind) for k, (name, kind) in enumerate(((lang, StringType()), (score, DoubleType()), (known, DoubleType()))) if name]

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = labels(batch.column(at))
        for name, k, kind in added:
            batch = batch.append_column(name, pa.array([g[k] for g in got], pa.string() if isinstance(kind, StringType) else pa.float64()))
        return batch

    schema = StructType([*docs.schema.fields])
    for name, _, kind in added:
        schema = schema.add(name, kind)
    return by_batch(docs, add, schema)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
