"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are compared in normal form: lower case, every run of characters that are neither
letters nor digits as one space. A benchmark item is cut into overlapping windows (the whole
item where it is no longer than one): long ones, short ones at a small stride, so that every
stretch of SHORT + SHORT_STRIDE - 1 characters holds a whole one, and the item itself with an
edit budget of its own, for reworded items. A document holds a window if some stretch of it lies
within the window's edit budget. If so, the two share at least
    length + 1 - q * (edits + 1)
q-grams whose diagonals (document place minus item place) lie within `edits` of each other.
The filter counts shared q-grams in overlapping bands of diagonals and keeps the bands that
reach that number; banded alignment verifies them. The filter loses nothing.

Documents are read in place, without any shuffle. Items are taken in blocks of bounded size,
each broadcast for a pass of its own, so a benchmark of any size can be searched.

Items of fewer than `min_item` characters are found as they are, as whole words.

Defined results: a null or empty text holds nothing; an item without text or with fewer than
q characters in normal form is not searched, as it would occur by chance; an item
with a null id is reported as null; equal items are each reported under their own id; an
empty table gives an empty result. Other columns of both inputs are not read.
"""

from __future__ import annotations

import uuid
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import map_texts
from .common import maybe_broadcast, staged, table

Q, WINDOW, STRIDE, RATE, MIN_ITEM = 10, 60, 20, 0.07, 24
#: Further windows: short ones for verbatim passages, with edits at the same rate, and whole items.
SHORT, SHORT_STRIDE, WHOLE_RATE = 40, 5, 0.08
#: Characters of benchmark text per broadcast block.
BLOCK_CHARS = 4_000_000
_U = np.uint64
_B = _U(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For the basic plane: is a letter or digit; lower-case form."""
    chars = [chr(i) for i in range(1 << 16)]
    alnum = np.array([c.isalnum() for c in chars])
    lower = np.array([ord(c.lower()) if len(c.lower()) == 1 else i for i, c in enumerate(chars)], np.uint32)
    return alnum, lower


def normal_form(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(code points in normal form, the place of each in text)."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    alnum, lower = _tables()
    low = np.minimum(codes, 0xFFFF)
    word = alnum[low] | (codes > 0xFFFF)
    keep = word.copy()
    keep[1:] |= word[:-1]  # the first of a run of others stands for it
    if len(keep):
        keep[0] = word[0]
    at = np.flatnonzero(keep)
    out = np.where(word[at], np.where(codes[at] > 0xFFFF, codes[at], lower[low[at]]), 32).astype(np.uint32)
    if len(out) and out[-1] == 32:
        out, at = out[:-1], at[:-1]
    return out, at


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q-gram at each place, by doubling."""
    if len(codes) < q:
        return np.empty(0, _U)
    power, size, step = codes.astype(_U) + _U(1), 1, np.full(1, _B)
    total, covered = None, 0
    while True:
        if q & size:
            total = power if total is None else total[: len(power) - covered] * step + power[covered:] if covered else power
            covered += size
            m = len(codes) - covered + 1
            total = total[:m]
        if size * 2 > q:
            return total ^ (total >> _U(29))
        n = len(power) - size
        power = power[:n] * step + power[size:]
        size, step = size * 2, step * step


def budget(length: int, rate: float) -> int:
    return int(length * rate)


def spread(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers from first[k] to last[k] - 1, one k after the other."""
    n = last - first
    return np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)


def band_counts(unit: np.ndarray, band: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, band, distinct q-grams) of every band that a hit lies in: its own and the one before, as bands overlap by half."""
    unit, band, gram = np.concatenate((unit, unit)), np.concatenate((band, band - 1)), np.concatenate((gram, gram))
    order = np.lexsort((gram, band, unit))
    unit, band, gram = unit[order], band[order], gram[order]
    new = np.ones(len(unit), bool)
    new[1:] = (unit[1:] != unit[:-1]) | (band[1:] != band[:-1])
    fresh = new.copy()
    fresh[1:] |= gram[1:] != gram[:-1]
    starts = np.flatnonzero(new)
    return unit[starts], band[starts], np.add.reduceat(fresh.astype(np.int64), starts)


class Index:
    """The q-grams of a block of items, and their windows."""

    def __init__(self, items: list[tuple], q: int, window: int, stride: int, rate: float, min_item: int):
        self.q, self.windows, grams, places = q, [], [], []
        owned: list[list[int]] = []
        for item_id, text in items:
            codes, _ = normal_form(text or "")
            if len(codes) < q:
                continue
            if len(codes) < min_item:
                cuts = {(0, len(codes)): 0.0}
            else:
                cuts = {(s, s + n): rate for n, step in ((window, stride), (SHORT, SHORT_STRIDE)) if len(codes) > n for s in (*range(0, len(codes) - n, step), len(codes) - n)}
                cuts[0, len(codes)] = rate if len(codes) <= window else max(rate, WHOLE_RATE)
            first = len(self.windows)
            for (s, e), share in cuts.items():
                edits = budget(e - s, share)
                least = e - s + 1 - q * (edits + 1)
                while least < 1 and edits:  # short windows: the largest budget that the filter can serve
                    edits -= 1
                    least = e - s + 1 - q * (edits + 1)
                self.windows.append((item_id, codes[s:e], edits, max(1, least), s, len(codes) < min_item))
            h = gram_hashes(codes, q)
            grams.append(h)
            places.append(np.column_stack((np.full(len(h), len(owned)), np.arange(len(h)))))
            owned.append([first, len(self.windows)])
        if not self.windows:
            return
        h, p = np.concatenate(grams), np.concatenate(places)
        order = np.argsort(h, kind="stable")
        self.hashes, self.first = np.unique(h[order], return_index=True)
        self.last = np.append(self.first[1:], len(h))
        self.item, self.offset = p[order, 0], p[order, 1]
        self.bits = 22
        self.bitmap = np.zeros(1 << self.bits, bool)
        self.bitmap[self.hashes * _B >> _U(64 - self.bits)] = True
        self.owned = np.array(owned)
        self.edits, self.least, self.start = (np.array([w[k] for w in self.windows]) for k in (2, 3, 4))
        self.grams = np.array([len(w[1]) - q + 1 for w in self.windows])
        # What all windows of an item need at least, in bands wide enough for each of them.
        self.item_width = np.array([self.edits[a:b].max() + 1 for a, b in owned])
        self.item_least = np.array([self.least[a:b].min() for a, b in owned])

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, item, offset in it) of every q-gram that an item shares."""
        at = np.flatnonzero(self.bitmap[h * _B >> _U(64 - self.bits)])
        k = np.searchsorted(self.hashes, h[at])
        same = self.hashes[np.minimum(k, len(self.hashes) - 1)] == h[at]
        at, k = at[same], k[same]
        flat = spread(self.first[k], self.last[k])
        return np.repeat(at, self.last[k] - self.first[k]), self.item[flat], self.offset[flat]

    def candidates(self, h: np.ndarray) -> list[tuple[int, int]]:
        """(window, first diagonal of a band) where enough q-grams are shared.

        A band has 2 (edits + 1) diagonals and starts every edits + 1, so any edits + 1
        neighbouring diagonals lie within one. Items are tried first, with the widest band and the
        least number of their windows, so that only items with enough hits in one place are tried by window.
        """
        place, item, offset = self.hits(h)
        if not len(place):
            return []
        some = np.bincount(item, minlength=len(self.owned)) >= self.item_least
        if not some.any():
            return []
        mine = some[item]
        place, item, offset = place[mine], item[mine], offset[mine]
        band = (place - offset) // self.item_width[item]
        unit, low, counts = band_counts(item, band, offset)
        good = counts >= self.item_least[unit]
        if not good.any():
            return []
        # Hits in the good bands, once each, by the windows that hold their q-gram.
        width = np.int64(1) << 40
        wanted = np.unique(np.concatenate((unit[good] * width + low[good], unit[good] * width + low[good] + 1)) + (width >> 1))
        mine = np.isin(item * width + band + (width >> 1), wanted)
        place, item, offset = place[mine], item[mine], offset[mine]
        win = spread(self.owned[item, 0], self.owned[item, 1])
        n = self.owned[item, 1] - self.owned[item, 0]
        place, offset = np.repeat(place, n), np.repeat(offset, n) - self.start[win]
        mine = (offset >= 0) & (offset < self.grams[win])
        place, win, offset = place[mine], win[mine], offset[mine]
        if not len(place):
            return []
        unit, low, counts = band_counts(win, (place - offset) // (self.edits[win] + 1), offset)
        good = counts >= self.least[unit]
        return [(int(w), int(b) * int(self.edits[w] + 1)) for w, b in zip(unit[good], low[good])]


def verbatim(window: np.ndarray, region: np.ndarray, diagonals: int) -> int:
    """The first of so many places at which region holds the window as it is, or -1."""
    most = min(diagonals, len(region) - len(window) + 1)
    if most < 1:
        return -1
    at = np.flatnonzero(region[:most] == window[0])
    return next((int(k) for k in at if np.array_equal(region[k : k + len(window)], window)), -1)


def align(window: np.ndarray, region: np.ndarray, diagonals: int, slack: int = 0) -> tuple[int, int]:
    """(least edits, end) of window against any stretch of region that starts within its first `diagonals` places.

    With slack, the stretch starts at the first place and may drift by so many diagonals either way.

    Row by row; the band holds the diagonals that may be met. Of equally good ends, the first.
    """
    if slack:
        region, diagonals = np.concatenate((np.full(slack, 0xFFFFFFFE, np.uint32), region)), 2 * slack + 1
    steps = np.arange(diagonals)
    cost, down = np.abs(steps - slack) if slack else np.zeros(diagonals, np.int64), np.full(diagonals, 1 << 30)
    if slack:
        cost[:slack] = 1 << 20
    wide = np.concatenate((region.astype(np.int64), np.full(len(window) + diagonals, -1)))
    for i, c in enumerate(window.tolist()):
        down[:-1] = cost[1:] + 1
        best = np.minimum(cost + (wide[i : i + diagonals] != c), down) - steps
        cost = np.minimum.accumulate(best) + steps
    ends = steps + len(window)
    cost = np.where(ends <= len(region), cost, 1 << 30)
    k = int(np.argmin(cost))
    return int(cost[k]), int(ends[k]) - slack


def search(text: str | None, index: Index) -> list[tuple]:
    """(item id, start, end, edits) of the stretches of text that hold windows, merged per item; places in text, end exclusive."""
    codes, at = normal_form(text or "")
    found: dict = {}
    met = (-1, 0)
    for w, low in index.candidates(gram_hashes(codes, index.q)) if len(codes) >= index.q else ():
        item, part, edits, _, _, short = index.windows[w]
        if met == (w, low - edits - 1):
            continue  # the neighbouring band, which overlaps this one, has shown this stretch
        begin, stop = low - edits, low + 2 * (edits + 1) + edits
        region = codes[max(0, begin) : stop + len(part)]
        if begin < 0:  # places before the text equal no character
            region = np.concatenate((np.full(-begin, 0xFFFFFFFF, np.uint32), region))
        k = verbatim(part, region, stop - begin)
        least, end = (0, k + len(part)) if k >= 0 else align(part, region, stop - begin) if edits else (1, 0)
        if least <= edits:
            met = (w, low)
            start = begin + end - len(part)
            if least:
                pad = np.full(max(0, len(part) + edits - end), 0xFFFFFFFF, np.uint32)
                back = np.concatenate((pad, region[:end]))[::-1]
                start = begin + end - align(part[::-1], back[: len(part) + edits], 1, edits)[1]
            start, stop = max(0, start), begin + end
            if short and (start and codes[start - 1] != 32 or stop < len(codes) and codes[stop] != 32):
                continue  # short items count as whole words
            found.setdefault(item, []).append((int(at[start]), int(at[stop - 1]) + 1, least))
    out = []
    for item, spans in found.items():
        spans.sort()
        merged = [list(spans[0])]
        for s, e, d in spans[1:]:
            if s <= merged[-1][1]:
                merged[-1][1], merged[-1][2] = max(e, merged[-1][1]), max(d, merged[-1][2])
            else:
                merged.append([s, e, d])
        out += [(item, *m) for m in merged]
    return sorted(out, key=lambda x: (x[1], x[2], x[0] is None, x[0] or 0))


HITS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("edits", T.LongType())]))


def blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int):
    """Lists of (id, text) of bounded size; the items stream through the driver."""
    held, size = [], 0
    for item, text in benchmark.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).toLocalIterator():
        held.append((item, text))
        size += len(text or "")
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


_INDEX: dict = {}


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", q: int = Q, window: int = WINDOW, stride: int = STRIDE, rate: float = RATE, min_item: int = MIN_ITEM, block_chars: int = BLOCK_CHARS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: id_col, the columns in keep and hits, an array of (item_id, start, end, edits).

    One block of items is searched in place. Of several, each is searched in a pass of its own, whose
    hits (few) are staged and come back to their rows by id and a hash of the text.
    """
    context = docs.sparkSession.sparkContext

    def search_block(block: list[tuple], rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
        name, held = uuid.uuid4().hex, context.broadcast(block)

        def make():
            if name not in _INDEX:
                _INDEX.clear()  # one block's index at a time bounds a worker's memory
                _INDEX[name] = Index(held.value, q, window, stride, rate, min_item)
            index = _INDEX[name]

            def each(texts):
                found = [search(t, index) if t and index.windows else [] for t in texts]
                return {"hits": [[dict(zip(("item_id", "start", "end", "edits"), h)) for h in hits] for hits in found]}

            return each

        return map_texts(rows, id_col, text_col, make, [("hits", HITS)], size=2048, keep=columns)

    parts = blocks(benchmark, item_col, item_text_col, block_chars)
    block, more = next(parts, []), next(parts, None)
    if more is None:
        return search_block(block, docs, keep)
    found = []
    while block:
        hit = search_block(block, docs, (text_col,)).filter(F.size("hits") > 0)
        found.append(staged(hit.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), "hits").distinct(), "leaks"))
        block, more = more, next(parts, None)
    every = reduce(DataFrame.union, found).groupBy("id", "text_hash").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    order = F.array_sort("hits", lambda a, b: F.when(rank(a) < rank(b), -1).when(rank(a) > rank(b), 1).otherwise(0))
    every = maybe_broadcast(every.select("id", "text_hash", order.alias("found")))
    # The columns of docs may have any names, so they take part as one struct.
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col)).alias("hash"), F.struct(F.lit(0).alias("none"), *keep).alias("kept"))
    joined = rows.join(every, F.col("doc").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("text_hash")), "left")
    return joined.select(F.col("doc").alias(id_col), *[F.col("kept")[c].alias(c) for c in keep], F.coalesce("found", F.array().cast(HITS)).alias("hits"))


def rank(hit: Column) -> Column:
    """Hits are ordered by place, then by item, null last."""
    return F.struct(hit["start"], hit["end"], hit["item_id"].isNull(), hit["item_id"])


def op6_decontaminate(spark, sf_dir):
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"])))
    return found.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.size(items).cast("long").alias("n_items"), items.alias("item_ids"), "hits")
