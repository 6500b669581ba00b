"""Language identification: script ranges, per-word scores and a Viterbi pass with a switching penalty.

A model holds, for each language, the scripts that it writes and log probabilities of
hashed letter trigrams (words are bounded by spaces). The counts are taken over all
labelled rows by a partially aggregated sum, so the model's size is languages times buckets
however many rows there are. A word's script narrows the languages to those that write it;
its trigrams score them; Viterbi over the words of a text, where a change of language
costs `penalty`, labels spans of mixed texts. The language with most letters is the
prediction, its share of all letters the score.

Defined results: texts that are null or have no letter get `und`, score 0 and no spans. A
word in a script that no language writes gives no evidence: its letters count for no language,
so a text of such words alone has score 0. Of languages with equally many
letters the first by name is predicted. Without any labelled row every text gets `und`. A
row whose language is null is not learned from. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import map_texts, text_slices
from .common import table
from .shingles import mix

BUCKETS, PENALTY, SMOOTHING = 1 << 17, 12.0, 0.1
#: A language writes a script if at least this share of its letters are in it.
SCRIPT_SHARE = 0.01

# The first code points of ranges of the basic plane and the script from there on.
SCRIPT_RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "burmese"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"),
    (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"),
]
SCRIPTS = sorted({s for _, s in SCRIPT_RANGES})
_U = np.uint64


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the basic plane: is a letter; lower-case form; script."""
    chars = [chr(i) for i in range(1 << 16)]
    letter = np.array([c.isalpha() for c in chars])
    lower = np.array([ord(c.lower()) if len(c.lower()) == 1 else i for i, c in enumerate(chars)], np.uint32)
    starts = np.array([s for s, _ in SCRIPT_RANGES])
    script = np.array([SCRIPTS.index(s) for _, s in SCRIPT_RANGES], np.uint8)[np.searchsorted(starts, np.arange(1 << 16), side="right") - 1]
    return letter, lower, script


def words_of(texts: list[str | None]):
    """(first word of each text, letters of each word, script of each word, first trigram of each word, hashed trigrams)."""
    blocks, held, size, bounds = [], [], 0, [0]
    for k, t in enumerate(texts):
        held.append(t or "")
        size += len(held[-1])
        if size > 1 << 20 or k + 1 == len(texts):
            starts, *rest = _block_words(held)
            bounds += (starts[1:] + bounds[-1]).tolist()
            blocks.append(rest)
            held, size = [], 0
    if not blocks:
        blocks = [_block_words([])[1:]]
    letters, script, trigrams = (np.concatenate([b[i] for b in blocks]) for i in range(3))
    return np.array(bounds), letters, script, np.concatenate(([0], np.cumsum(letters))), trigrams


def _block_words(texts: list[str]):
    letter, lower, scripts = _tables()
    codes = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.minimum(codes, 0xFFFF)
    is_letter = letter[low]
    for c in np.unique(codes[codes > 0xFFFF]):
        is_letter = np.where(codes == c, chr(c).isalpha(), is_letter)
    folded = np.where(codes > 0xFFFF, codes, lower[low]).astype(_U)
    folded[~is_letter] = _U(32)
    grams = mix((folded[:-2] * _U(0x1F1F1F1F) + folded[1:-1]) * _U(0x9E3779B97F4A7C15) + folded[2:]) & _U(BUCKETS - 1) if len(codes) > 2 else np.empty(0, _U)
    at = np.flatnonzero(is_letter)  # a word of n letters has n trigrams, one around each letter
    edge = np.flatnonzero(is_letter[1:] & ~is_letter[:-1]) + 1
    stop = np.flatnonzero(~is_letter[1:] & is_letter[:-1]) + 1
    bounds = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return np.searchsorted(edge, bounds), stop - edge, scripts[low[edge]], grams[at - 1].astype(np.int32)


def count_trigrams(rows: DataFrame) -> DataFrame:
    """(lang, bucket, n) over rows (lang, text); buckets from BUCKETS on count letters by script."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                mine = np.flatnonzero(langs == lang)
                for _, texts in text_slices(batch.take(pa.array(mine)), "text", 256):
                    _, letters, script, _, grams = words_of(texts)
                    total = totals.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS), np.int64))
                    total[:BUCKETS] += np.bincount(grams, minlength=BUCKETS)
                    total[BUCKETS:] += np.bincount(script, weights=letters, minlength=len(SCRIPTS)).astype(np.int64)
        for lang, total in totals.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(some), pa.string()), "bucket": pa.array(some, pa.int64()), "n": pa.array(total[some], pa.int64())})

    counted = rows.mapInArrow(run, "lang string, bucket long, n long")
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class LanguageModel:
    def __init__(self, counts: Iterable[tuple[str, int, int]]):
        columns: dict[str, np.ndarray] = {}
        for lang, bucket, n in counts:
            if lang not in columns:
                columns[lang] = np.zeros(BUCKETS + len(SCRIPTS))
            columns[lang][bucket] = n
        self.languages = sorted(columns)
        table = np.column_stack([columns[x] for x in self.languages]) if columns else np.zeros((BUCKETS + len(SCRIPTS), 0))
        grams, letters = table[:BUCKETS], table[BUCKETS:]
        self.logs = np.log((grams + SMOOTHING) / (grams.sum(axis=0) + SMOOTHING * BUCKETS)).astype(np.float32) if self.languages else grams.astype(np.float32)
        self.writes = letters >= SCRIPT_SHARE * np.maximum(1, letters.sum(axis=0))

    def label(self, texts: list[str | None], penalty: float = PENALTY) -> list[tuple[str, float, list[tuple[str, int]]]]:
        """(language, score, [(language, words) of each span]) of each text."""
        bounds, letters, script, first, grams = words_of(texts)
        n, k = len(letters), len(self.languages)
        if not n or not k:
            return [("und", 0.0, [])] * len(texts)
        scores = np.empty((n, k), np.float32)
        for at in range(0, n, 1 << 17):  # blocks bound the gathered table rows
            to = min(n, at + (1 << 17))
            scores[at:to] = np.add.reduceat(self.logs[grams[first[at] : first[to]]], first[at:to] - first[at])
        allowed = self.writes[script]
        scores[~allowed] = -1e6
        scores[~allowed.any(axis=1)] = 0
        path = self._viterbi(scores, bounds, penalty)
        doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
        share = np.bincount(doc * k + path, weights=letters * allowed.any(axis=1), minlength=len(texts) * k).reshape(len(texts), k)
        total = np.bincount(doc, weights=letters, minlength=len(texts))
        best = share.argmax(axis=1)
        cut = np.ones(n, bool)
        cut[1:] = (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])
        starts = np.flatnonzero(cut)
        sizes = np.diff(np.append(starts, n))
        spans: list[list] = [[] for _ in texts]
        for s, size in zip(starts.tolist(), sizes.tolist()):
            spans[doc[s]].append((self.languages[path[s]], size))
        return [(self.languages[b], float(share[i, b] / t), spans[i]) if t else ("und", 0.0, []) for i, (b, t) in enumerate(zip(best, total))]

    @staticmethod
    def _viterbi(scores: np.ndarray, bounds: np.ndarray, penalty: float) -> np.ndarray:
        """The best language of every word; all texts of the batch advance word by word together."""
        lengths = np.diff(bounds)
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = bounds[:-1][order], lengths[order]
        active = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), side="right")
        back = np.zeros(len(scores), np.uint16 if scores.shape[1] < 1 << 16 else np.uint32)  # the language before, of a word that changes; else marked by stay
        stay = np.ones(scores.shape, bool)
        value = np.zeros((len(starts), scores.shape[1]), np.float32)
        for t, m in enumerate(active.tolist()):
            at = starts[:m] + t
            v = value[:m]
            if t:
                top = v.argmax(axis=1)
                jump = v[np.arange(m), top] - penalty
                stay[at] = v >= jump[:, None]
                back[at] = top
                v = np.maximum(v, jump[:, None])
                v -= v.max(axis=1, keepdims=True)  # keeps single precision exact enough on long texts
            value[:m] = v + scores[at]
        path = np.zeros(len(scores), np.int64)
        now = value.argmax(axis=1)
        for t in range(len(active) - 1, -1, -1):
            m = active[t]
            at = starts[:m] + t
            path[at] = now[:m]
            if t:
                now[:m] = np.where(stay[at, now[:m]], now[:m], back[at])
        return path


def train(rows: DataFrame, lang_col: str = "lang", text_col: str = "text") -> LanguageModel:
    known = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    return LanguageModel((r.lang, r.bucket, r.n) for r in count_trigrams(known).toLocalIterator())


SPANS = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("words", T.LongType())]))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", penalty: float = PENALTY, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: id_col, the columns in keep, lang_pred, score and spans."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = held.value

        def each(texts):
            found = own.label(texts, penalty)
            return {"lang_pred": [f[0] for f in found], "score": [f[1] for f in found], "spans": [[{"lang": x, "words": n} for x, n in f[2]] for f in found]}

        return each

    return map_texts(docs, id_col, text_col, make, [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("spans", SPANS)], size=4096, keep=keep)


def fold(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 4


def op7_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(F.coalesce(fold(), F.lit(0)) != 2))
    out = identify(docs, model)
    return out.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
