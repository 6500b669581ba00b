"""SentencePiece encoding and decoding by a shared-prefix forward pass over distinct words.

A text is marked as the model's normaliser does it (spaces become U+2581, one in front) and
cut into marked words: U+2581 and what follows up to the next. No piece crosses such a cut,
so words are encoded apart. The distinct words of a batch are sorted, which orders them as
a depth-first walk of their trie: each word keeps the forward states of the prefix that it
shares with the word before and only computes the rest.

The state of a prefix is its best last piece. For a unigram model it is chosen by the best
sum of scores (Viterbi). For a BPE model summed scores would give other ids than the model's
merges do, so the state is the one piece that the merges leave at the end of the prefix: the
encoding of a string is the sequence of pieces of which each neighbouring pair is stable,
that is, encoded apart when encoded alone. Ids are the library's own, whichever kind of
model it is.

Characters without a piece become byte pieces (or the unknown piece). Defined results: a
null text encodes as an empty one, to no ids, and decodes to an empty text; a text holding
U+2581 itself decodes to spaces there, and `lossless` is false; texts of any length and
words of any length are encoded whole; an empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow import map_texts
from .common import table

MARK = "▁"
#: Distinct words that a worker remembers between batches, and the longest it remembers.
CACHE_WORDS, CACHE_CHARS = 250_000, 64
#: Pairs of pieces that it remembers as stable or not.
CACHE_PAIRS = 400_000
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


class PieceModel:
    """A SentencePiece model read from its file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that leave texts as they are are supported")
        if any(p.type == _USER for p in proto.pieces):
            raise ValueError("models with user-defined pieces aren't supported")
        self.unigram = proto.trainer_spec.model_type == 1
        if not self.unigram and proto.trainer_spec.model_type != 2:
            raise ValueError("only unigram and BPE models are supported")
        self.dummy_prefix = norm.add_dummy_prefix
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == _NORMAL}
        self.text = [p.piece for p in proto.pieces]
        self.score = [p.score for p in proto.pieces]
        self.longest = max(map(len, self.ids), default=1)
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == _UNKNOWN)
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == _BYTE}
        self.decoded = [
            bytes([int(p.piece[1:-1], 16)]) if p.type == _BYTE else b"" if p.type == _CONTROL else " ⁇ ".encode() if p.type == _UNKNOWN else p.piece.replace(MARK, " ").encode()
            for p in proto.pieces
        ]
        self.cuts_at_marks = not any(MARK in p.lstrip(MARK) for p in self.ids)
        # Pieces come to be in the order of falling score; ties are settled from left to right.
        self.rank = {i: -self.score[i] for i in self.ids.values()}
        ranks = [self.rank[i] for p, i in self.ids.items() if len(p) > 1 and p.strip(MARK)]
        self.ties = len(set(ranks)) < len(ranks)
        self.penalty = min((self.score[i] for i in self.ids.values()), default=0.0) - 10.0
        self._parts: dict[int, tuple] = {}
        self._stable: dict[int, bool] = {}
        #: The longest piece by its last three characters: no longer one needs to be looked up.
        self.reach: dict[str, int] = {}
        for p in self.ids:
            if len(p) > 2:
                self.reach[p[-3:]] = max(len(p), self.reach.get(p[-3:], 0))

    def fallback(self, char: str) -> list[int]:
        raw = char.encode("utf-8", "surrogatepass")
        return [self.bytes[b] for b in raw] if self.bytes else [self.unknown]

    def merge(self, word: str, trace: list | None = None) -> list[str]:
        """The merges of BPE carried out one by one; for words whose merges tie, and to see how a piece comes to be."""
        import heapq

        parts, left, right = list(word), [*range(-1, len(word) - 1)], [*range(1, len(word) + 1)]
        heap: list = []

        def offer(a: int, b: int) -> None:
            if 0 <= a and b < len(parts) and (i := self.ids.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (self.rank[i], a, b, parts[a], parts[b]))

        for k in range(len(word) - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, x, y = heapq.heappop(heap)
            if parts[a] != x or b >= len(parts) or parts[b] != y or right[a] != b:
                continue
            if trace is not None:
                trace.append((x, y))
            parts[a], parts[b] = x + y, ""
            right[a] = right[b]
            if right[b] < len(parts):
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [p for p in parts if p]

    def parts(self, piece: int) -> tuple:
        """(left half, right half) of the last merge of a piece; () for a single character, None if no merges lead to it."""
        if piece not in self._parts:
            word = self.text[piece]
            trace: list = []
            whole = self.merge(word, trace)
            self._parts[piece] = None if len(whole) > 1 else () if len(word) == 1 else tuple(self.ids[h] for h in trace[-1])
        return self._parts[piece]

    def stable(self, a: int, b: int) -> bool:
        """Whether a and b side by side stay as they are.

        Time runs back from the finished pieces: of the two that meet at the border the later
        made one is taken apart. A merge across the border comes first, and so spoils the
        pair, if it ranks before the merge that used up one of the two; at equal rank the
        one further left comes first.
        """
        x, y, used, across_wins_ties, ok = a, b, float("inf"), False, self.parts(b) is not None
        while ok:
            both = self.ids.get(self.text[x] + self.text[y])
            if both is not None and (self.rank[both] < used or across_wins_ties and self.rank[both] == used):
                ok = False
                break
            px, py = self.parts(x), self.parts(y)
            if not px and not py:
                break
            # Of two equally ranked merges the left one is the earlier, so the right one is undone first.
            if px and (not py or self.rank[x] > self.rank[y]):
                used, across_wins_ties, x = self.rank[x], False, px[1]
            else:
                used, across_wins_ties, y = self.rank[y], True, py[0]
        if len(self._stable) > CACHE_PAIRS:
            self._stable.clear()
        self._stable[a << 32 | b] = ok
        return ok

    def encode_sorted(self, words: list[str]):
        """(word, ids) of sorted distinct words, sharing the states of common prefixes."""
        step = self._best if self.unigram else self._last
        # By length of prefix: its last piece (-1: a character without one, None: no prefix), that piece's length, the sum of scores.
        last, size, score = [None], [0], [0.0]
        before = ""
        for word in words:
            if not self.unigram and (self.ties or word.startswith(MARK * 2)):
                ids: list[int] = []
                for p in self.merge(word):
                    ids += [self.ids[p]] if p in self.ids else self.fallback(p)
                yield word, ids
                continue
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], size[shared + 1 :], score[shared + 1 :]
            step(word, shared, last, size, score)
            before = word
            ids, end = [], len(word)
            while end:
                piece = last[end]
                if piece >= 0:
                    ids.append(piece)
                else:
                    ids += self.fallback(word[end - 1])[::-1]
                end -= size[end]
            ids.reverse()
            yield word, ids

    def _last(self, word: str, shared: int, last: list, size: list, score: list) -> None:
        """Extends the states from a prefix of `shared` characters to the whole word, for BPE."""
        get, stable, reach = self.ids.get, self._stable.get, self.reach.get
        for end in range(shared + 1, len(word) + 1):
            found, length = -1, 1
            start = end - reach(word[end - 3 : end], 2) if end > 2 else 0
            for start in range(start if start > 0 else 0, end):
                piece = get(word[start:end])
                if piece is None:
                    continue
                left = last[start]
                if left is None or left < 0:
                    ok = self.parts(piece) is not None
                else:
                    ok = stable(left << 32 | piece)
                    if ok is None:
                        ok = self.stable(left, piece)
                if ok:
                    found, length = piece, end - start
                    break
            last.append(found)
            size.append(length)

    def _best(self, word: str, shared: int, last: list, size: list, score: list) -> None:
        """The same for a unigram model: the best sum of scores."""
        for end in range(shared + 1, len(word) + 1):
            best = (float("-inf"), 0, 0) if word[end - 1] in self.ids else (score[end - 1] + self.penalty, -1, 1)
            for start in range(max(0, end - self.longest), end):
                piece = self.ids.get(word[start:end])
                if piece is not None and (total := score[start] + self.score[piece]) > best[0]:
                    best = (total, piece, end - start)
            for held, value in zip((score, last, size), best):
                held.append(value)


class Encoder:
    """Encodes batches of texts; remembers a bounded number of words."""

    def __init__(self, model: PieceModel):
        self.model, self.cache = model, {}
        self.cut = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall if model.cuts_at_marks else lambda s: [s]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        cut, prefix = self.cut, MARK if self.model.dummy_prefix else ""
        words = [cut(prefix + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.cache) > CACHE_WORDS:  # what this batch needs stays
            self.cache = {w: self.cache[w] for ws in words for w in ws if w in self.cache}
        cache = self.cache
        fresh = {w for ws in words for w in ws if w not in cache}
        long = []
        for word, ids in self.model.encode_sorted(sorted(fresh)):
            cache[word] = np.array(ids, np.int32).tobytes()
            if len(word) > CACHE_CHARS:
                long.append(word)
        out = [np.frombuffer(b"".join(map(cache.__getitem__, ws)), np.int32) for ws in words]
        for word in long:
            del cache[word]
        return out

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.model.decoded.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per model and worker process."""
    return Encoder(PieceModel(path))


def int_lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int32)))


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id_col, n_tokens, ids, decoded (the text read back from ids) and lossless."""

    def make():
        own = encoder(model_path)

        def each(texts):
            ids = own.encode(texts)
            back = [own.decode(x) for x in ids]
            return {"n_tokens": list(map(len, ids)), "ids": int_lists(ids), "decoded": back, "lossless": [b == (t or "") for b, t in zip(back, texts)]}

        return each

    fields = [("n_tokens", T.LongType()), ("ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType()), ("lossless", T.BooleanType())]
    return map_texts(docs, id_col, text_col, make, fields, size=2048)


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark, sf_dir):
    return encode_decode(table(spark, sf_dir, "documents"), piece_model_path())
