"""Personal data in texts: base rules, and a semi-Markov conditional random field that adds spans.

Base kinds are email, ip, card and phone. Each is matched by its pattern from left to right
without overlap; matches that fail their test are dropped.

The field works on windows of tokens around every segment that it can label: whatever the rest
of the text, a segment's posterior is bounded by its own score against that of no entity on its
tokens, and segments of plain words are below the bound as a whole. It scores whole segments of up to MAX_TOKENS tokens by features of
the segment (shape, digits, check sums, the words before) and of neighbouring kinds; one
dynamic program chooses boundaries and kinds together. Its weights maximise the likelihood
of a fixed set of generated, labelled sentences. Spans that it adds (those kinds in forms
that the patterns miss, and secrets) never overlap a base span, and base spans stay.

Defined results: a null text is empty and has no spans; places count code points, ends are
exclusive; texts of any length are read whole in time linear in their length; equal starts
are ordered by kind as listed; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import map_texts
from .common import table

KINDS = ("email", "ip", "card", "phone", "secret")
MAX_TOKENS = 5
#: Tokens on either side of a segment in question that a window holds; features look at four before a segment.
AROUND = 8
#: Least posterior probability of an added span.
MIN_POSTERIOR = 0.7

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """From each @ outwards, as its local part ends right before it: linear, where the pattern alone is quadratic."""
    out, at, last = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        last = m.end() if m else at + 1
        at = text.find("@", last)
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start and then kind as listed."""
    out = [(s, e, "email") for s, e in emails(text)]
    if re.search("[0-9]", text):
        small = lambda p: len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255
        out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(map(small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# --- the field -------------------------------------------------------------------------------

_TOKEN = re.compile(r"[^\s\"'<>{}\[\],;|=:]+(?:[\[(](?:at|dot)[\])][^\s\"'<>]*)?|[=:\"']|\[(?:at|dot)\]")
_SPELLED = re.compile(r"\bat\s*\w+\s*(?:[\[(]dot[\])]|dot\b|\.)\s*\w", re.IGNORECASE)
CUES = {
    "phone": {"phone", "call", "tel", "telephone", "mobile", "cell", "fax", "ring", "number"},
    "secret": {"token", "key", "secret", "password", "passwd", "pwd", "apikey", "api", "auth", "bearer"},
    "card": {"card", "visa", "mastercard", "credit", "amex", "pan"},
    "ip": {"ip", "host", "server", "address", "gateway"},
    "email": {"mail", "email", "e-mail", "contact", "write"},
}
_CUE_WORDS = frozenset().union(*CUES.values())


#: Signs that end a token without being part of it, or stand alone.
_STOPS = ".!?%$#*&"
#: Distinct tokens and stretches between white space that a worker remembers.
CACHE_TOKENS = 400_000


class _Plain(dict):
    """Whether a token is letters only, or a sign: such tokens alone never make a segment that is an entity."""

    def __missing__(self, token: str) -> bool:
        low = token.lower()
        value = low not in _CUE_WORDS and (low.isalpha() and len(token) < 20 or token in _STOPS)
        if len(token) < 64:
            self[token] = value
        return value


class _Stretch(dict):
    """Whether a stretch between white space holds a token that is not plain."""

    def __missing__(self, stretch: str) -> bool:
        value = not all(_PLAIN[stretch[s:e]] for s, e in tokens_of(stretch, 0, len(stretch)))
        if len(stretch) < 64:
            self[stretch] = value
        return value


_PLAIN, _STRETCH = _Plain(), _Stretch()


def tokens_of(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Tokens in text[start:end] without the stops at their ends."""
    out = []
    for m in _TOKEN.finditer(text, start, end):
        s, e = m.start(), m.end()
        while e - s > 1 and text[e - 1] in _STOPS:
            e -= 1
        out.append((s, e))
    return out


def features(text: str, toks: list[tuple[int, int]], i: int, j: int) -> list[str]:
    """Features of the segment of tokens i to j - 1."""
    seg = text[toks[i][0] : toks[j - 1][1]]
    digits = re.sub(r"[^0-9]", "", seg)
    n = len(digits)
    shape = re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", lambda m: "9" * min(len(m[0]), 5), seg))
    out = ["bias", f"tokens={j - i}", f"digits={min(n, 20) if n < 8 else n // 2 * 2}"]
    if len(shape) <= 24:
        out.append("shape=" + shape)
    letters = sum(c.isalpha() for c in seg)
    out.append("letters" if letters else "no letters")
    if seg and len(seg) >= 20 and j - i == 1:
        hexed = re.fullmatch(r"[0-9a-fA-F]+", seg) is not None
        mixed = re.fullmatch(r"[A-Za-z0-9_\-+/=.]+", seg) is not None and letters > 3 and n > 3
        out.append("long hex" if hexed and letters else "long mixed" if mixed else "long other")
    if j - i == 1 and letters and n:
        kinds = sum((any(c.islower() for c in seg), any(c.isupper() for c in seg)))
        out.append(f"mixed {min(len(seg), 40) // 6} {kinds}")
    if "@" in seg:
        out.append("has @")
    low = seg.lower()
    if re.search(r"\w\s*(?:[\[(]at[\])]|\bat\b)\s*\w+\s*(?:[\[(]dot[\])]|\bdot\b|\.)\s*\w{2,}", low):
        out.append("spelled address" if re.fullmatch(r"[\w.+-]+\s*(?:[\[(]at[\])]|at)\s*\w+(?:\s*(?:[\[(]dot[\])]|dot|\.)\s*\w{2,6})+", low) else "holds spelled address")
    if re.fullmatch(r"\(?\d{3}\)?[\s.-]?\d{3}[\s.-]\d{4}", seg):
        out.append("phone form")
    elif re.fullmatch(r"0\d{2,5}(?:[ /-]\d{2,8}){1,4}", seg) and 9 <= n <= 12:
        out.append("national phone form")
    if 13 <= n <= 19 and not letters and re.fullmatch(r"[0-9 .\-]+", seg):
        out.append("card digits, sum " + ("right" if luhn(digits) else "wrong"))
    if re.fullmatch(r"(?:\d{1,3}\.){3}\d{1,3}(?:[:/]\d+)?", seg):
        out.append("ip form")
    before = [text[s:e].lower().strip("=:\"'") for s, e in toks[max(0, i - 4) : i]]
    for kind, cues in CUES.items():
        if cues.intersection(before):
            out.append("after " + kind)
            out.append(f"after {kind} mixed {j - i > 1}" if n and letters else f"after {kind} digits={n // 4}" if n else f"after {kind} none")
    if i and text[toks[i - 1][0] : toks[i - 1][1]] in "=:\"'":
        out.append("after sign")
    return out


class Field:
    """Weights by (feature, kind) and (kind, kind); kind 0 is no entity, always one token long."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.kinds = len(KINDS) + 1
        self.w = np.zeros((0, self.kinds))
        self.move = np.zeros((self.kinds, self.kinds))

    def lattice(self, text: str, toks: list[tuple[int, int]], grow: bool = False) -> list[list[tuple[int, list[int]]]]:
        """For each end j the segments (start, feature numbers)."""
        out = []
        for j in range(1, len(toks) + 1):
            row = []
            for i in range(max(0, j - MAX_TOKENS), j):
                names = features(text, toks, i, j)
                row.append((i, [self.index.setdefault(f, len(self.index)) for f in names] if grow else [self.index[f] for f in names if f in self.index]))
            out.append(row)
        if grow and len(self.index) > len(self.w):
            self.w = np.vstack((self.w, np.zeros((len(self.index) - len(self.w), self.kinds))))
        return out

    def scores(self, lattice) -> list[list[tuple[int, np.ndarray]]]:
        out = []
        for j, row in enumerate(lattice, 1):
            now = []
            for i, f in row:
                s = self.w[f].sum(axis=0)
                if j - i > 1:
                    s = s.copy()
                    s[0] = -np.inf
                now.append((i, s))
            out.append(now)
        return out

    def sums(self, scores) -> tuple[np.ndarray, np.ndarray, float]:
        """Forward and backward log sums by place and kind, and the log of the total."""
        n = len(scores)
        alpha, beta = np.full((n + 1, self.kinds), -np.inf), np.full((n + 1, self.kinds), -np.inf)
        alpha[0, 0] = 0
        with np.errstate(divide="ignore", invalid="ignore"):
            into = [np.logaddexp.reduce(alpha[0][:, None] + self.move, axis=0)]
            for j, row in enumerate(scores, 1):
                alpha[j] = np.logaddexp.reduce([into[i] + s for i, s in row], axis=0)
                into.append(np.logaddexp.reduce(alpha[j][:, None] + self.move, axis=0))
            beta[n] = 0
            by_start: list[list] = [[] for _ in range(n)]
            for j, row in enumerate(scores, 1):
                for i, s in row:
                    by_start[i].append((j, s))
            for i in range(n - 1, -1, -1):
                ahead = np.logaddexp.reduce([s + beta[j] for j, s in by_start[i]], axis=0)
                beta[i] = np.logaddexp.reduce(self.move + ahead[None, :], axis=1)
        self.into = into
        return alpha, beta, float(np.logaddexp.reduce(alpha[n]))

    def weight(self, name: str) -> np.ndarray:
        return self.w[self.index[name]] if name in self.index else np.zeros(self.kinds)

    def bounds(self) -> tuple[np.ndarray, float]:
        """(what the neighbours can add to each kind's log odds, the most log odds of a segment of plain words)."""
        near = (self.move[:, 1:] - self.move[:, :1]).max(axis=0) + np.maximum(0, (self.move[1:, :] - self.move[0]).max(axis=1))
        one = lambda n: self.weight("bias") + self.weight("digits=0") + np.maximum(self.weight("letters"), self.weight("no letters")) + self.weight(f"tokens={n}")
        shapes = [self.w[k][1:] for f, k in self.index.items() if f.startswith("shape=") and not re.search("[9@]", f)]
        shape = np.max([np.zeros(self.kinds - 1), *shapes], axis=0)
        plain = self.weight("bias") + self.weight("digits=0") + self.weight("tokens=1")
        none = plain[0] + min(self.weight("letters")[0], self.weight("no letters")[0]) + min(0, *(self.weight(f"shape={x}")[0] for x in ("a", *_STOPS)))
        return near, max(float((one(n)[1:] + shape + near).max()) - n * none - (n - 1) * self.move[0, 0] for n in range(1, MAX_TOKENS + 1))

    def fit(self, examples: list[tuple[str, list[tuple[int, int, str]]]], rounds: int = 8, rate: float = 0.5) -> "Field":
        data = []
        for text, spans in examples:
            toks = tokens_of(text, 0, len(text))
            starts, ends = {s: k for k, (s, _) in enumerate(toks)}, {e: k + 1 for k, (_, e) in enumerate(toks)}
            gold, at = [], 0
            for s, e, kind in spans:
                i, j = starts[s], ends[e]
                gold += [(k, k + 1, 0) for k in range(at, i)] + [(i, j, KINDS.index(kind) + 1)]
                at = j
            gold += [(k, k + 1, 0) for k in range(at, len(toks))]
            data.append((self.lattice(text, toks, grow=True), gold))
        square_w, square_m = np.full_like(self.w, 1e-3), np.full_like(self.move, 1e-3)
        for _ in range(rounds):
            for lattice, gold in data:
                scores = self.scores(lattice)
                alpha, beta, total = self.sums(scores)
                into = self.into
                grad_m, touched = np.zeros_like(self.move), {}
                for j, row in enumerate(lattice, 1):
                    for (i, f), (_, s) in zip(row, scores[j - 1]):
                        p = np.exp(into[i] + s + beta[j] - total)
                        for x in f:
                            touched[x] = touched.get(x, 0) - p
                        grad_m -= np.exp(alpha[i][:, None] + self.move + (s + beta[j])[None, :] - total)
                last = 0
                for i, j, y in gold:
                    for x in next(f for k, f in lattice[j - 1] if k == i):
                        touched[x] = touched[x] + np.eye(self.kinds)[y]
                    grad_m[last, y] += 1
                    last = y
                for x, g in touched.items():
                    g = g - 0.002 * self.w[x]
                    square_w[x] += g * g
                    self.w[x] += rate * g / np.sqrt(square_w[x])
                square_m += grad_m**2
                self.move += rate * grad_m / np.sqrt(square_m)
        return self

    def decode(self, text: str, toks: list[tuple[int, int]]) -> list[tuple[int, int, str, float]]:
        """(start, end, kind, posterior) of the entities of the best segmentation."""
        scores = self.scores(self.lattice(text, toks))
        n = len(toks)
        best, back = np.full((n + 1, self.kinds), -np.inf), {}
        best[0, 0] = 0
        for j, row in enumerate(scores, 1):
            for i, s in row:
                ways = best[i][:, None] + self.move
                value = ways.max(axis=0) + s
                for y in np.flatnonzero(value > best[j]):
                    best[j, y] = value[y]
                    back[j, int(y)] = (i, int(ways[:, y].argmax()), s)
        out, j, y = [], n, int(best[n].argmax())
        held = None
        while j:
            i, before, s = back[j, y]
            if y:
                if held is None:
                    held = self.sums(scores)
                _, beta, total = held
                out.append((toks[i][0], toks[j - 1][1], KINDS[y - 1], float(np.exp(self.into[i][y] + s[y] + beta[j][y] - total))))
            j, y = i, before
        return out[::-1]


def labelled_sentences(n: int = 480, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Generated sentences with labelled spans: every kind in several forms, and numbers and words that are none of them."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["an", "er", "in", "on", "th", "re", "st", "nd", "ou", "el", "la", "de"]) for _ in range(r.randint(1, 3)))
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    of = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexed = lambda k: of("0123456789abcdef", k)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def card(right: bool) -> str:
        body = str(r.randint(2, 6)) + d(14)
        check = next(c for c in "0123456789" if luhn(body + c) == right)
        return body + check

    def key() -> str:
        return r.choice([
            lambda: hexed(r.choice([32, 40, 64])), lambda: "sk_live_" + hexed(24), lambda: "AK" + of(upper + "0123456789", r.randint(14, 18)), lambda: "ghp_" + of(upper + lower + "0123456789", 36),
            lambda: of(upper + lower + "0123456789", r.randint(20, 44)), lambda: of(upper + lower + "0123456789+/", r.randint(60, 420)) + "==",
        ])()

    def password() -> str:
        return r.choice([word() + d(r.randint(1, 4)), word() + d(1) + word(), word().capitalize() + d(3) + r.choice("_-") + word(), of(lower + upper + "0123456789", r.randint(8, 14)) + d(1)])

    def one() -> tuple[str, str, str]:
        kind = r.choice(["email", "ip", "card", "phone", "secret", "secret", "", "", "", ""])
        name = word() + r.choice([".", "", "", d(2)]) + word()
        if kind == "email":
            site = word() + r.choice([word(), ""])
            end = r.choice(["com", "org", "net", "de", "io"])
            return r.choice(["", "mail ", "contact ", "write to ", "reach me under "]), r.choice([f"{name}@{site}.{end}", f"{name} at {site} dot {end}", f"{word()} at {site} dot {end}", f"{name}[at]{site}.{end}", f"{name} (at) {site} (dot) {end}"]), kind
        if kind == "ip":
            x = ".".join(str(r.randint(1, 255)) for _ in range(4))
            return r.choice(["", "host ", "server "]), x, kind
        if kind == "card":
            x = card(True)
            return r.choice(["", "card ", "visa "]), r.choice([x, " ".join(x[k : k + 4] for k in (0, 4, 8, 12)), ".".join(x[k : k + 4] for k in (0, 4, 8, 12))]), kind
        if kind == "phone":
            a, b, c = d(3), d(3), d(4)
            form = r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+44 {d(4)} {d(6)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(4)} {d(6)}", f"0{d(3)}/{d(7)}", f"0{d(2)} {d(3)} {d(2)} {d(2)}"])
            return r.choice(["call ", "phone ", "tel ", "ring ", "fax "]) if form[0] == "0" else r.choice(["", "call ", "phone ", "tel "]), form, kind
        if kind == "secret":
            cue, sign = r.choice(["token", "api key", "secret", "auth token", "access key", "key"]), r.choice([' = "', ": ", "=", ' "'])
            return (cue + sign, key(), kind) if r.random() < 0.65 else (r.choice(["password: ", "password=", "passwd: ", "pwd = ", 'password = "']), password(), kind)
        return r.choice(["", "in ", "id ", "version ", "room "]), r.choice([
            d(4), d(6), d(2) + "." + d(2), d(3) + "," + d(3), card(False), d(16), f"{d(2)}/{d(2)}/{d(4)}", "$" + d(5), d(2) + "." + d(1) + "." + d(3), word() + d(3), f"{word()} at {word()}", f"{d(2)} {d(3)} {d(3)}", f"{d(4)}-{d(4)}", f"v{d(1)}.{d(1)}",
            f"{word()} at {word()}. {word()}", f"the password {word()} {word()}", f"key: {word()}", f"token of {word()}", f"{word()} dot {word()}", f"{word()} at the {word()} dot", upper[r.randrange(26)] + d(2), f"number {d(3)}", f"call {d(2)} {word()}", f"address {d(3)} {word()}", f"{word().upper()}-{word()[:2].upper()}", f"{word()}.{word()[:3]}",
        ]), ""

    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(r.randint(1, 4))) + " ", []
        for _ in range(r.randint(1, 2)):
            cue, value, kind = one()
            if kind == "card" and value.replace(" ", "").replace(".", "")[0] == "0":
                continue
            text += cue
            if kind:
                spans.append((len(text), len(text) + len(value), kind))
            text += value + ('"' if cue.endswith('"') else "") + " " + " ".join(word() for _ in range(r.randint(1, 4))) + " "
        toks = tokens_of(text, 0, len(text))
        if all(any(s == t[0] for t in toks) and any(e == t[1] for t in toks) for s, e, _ in spans):
            out.append((text, spans))
    return out


@lru_cache(maxsize=1)
def default_field() -> Field:
    return Field().fit(labelled_sentences())


def windows(text: str, field: Field) -> list[list[tuple[int, int]]]:
    """Token windows around every segment whose posterior can reach MIN_POSTERIOR.

    Each way through a segment of a kind has its counterpart that takes the segment's tokens
    for no entity, so the odds of the segment are at most those of the two on these tokens
    alone, times the most that the kinds before and after can add.
    """
    least = float(np.log(MIN_POSTERIOR / (1 - MIN_POSTERIOR))) - 1e-6
    if not hasattr(field, "held_bounds"):
        field.held_bounds = field.bounds()
    near, plain = field.held_bounds
    for cache in (_PLAIN, _STRETCH):
        if len(cache) > CACHE_TOKENS:
            cache.clear()
    spelled = {m.start() for m in _SPELLED.finditer(text)}
    if plain < least and not spelled and not any(map(_STRETCH.__getitem__, set(text.split()))):
        return []
    toks = tokens_of(text, 0, len(text))
    asked: set[tuple[int, int]] = set()
    for k, (s, e) in enumerate(toks):
        word = text[s:e]
        if plain < least and _PLAIN[word] and s not in spelled:
            continue
        cue = word.lower() in _CUE_WORDS
        # Segments that hold the token, and those that have a feature by it: signs count right behind, cues up to four on.
        last = k + 4 if cue else k + 1 if word in "=:\"'" else k
        for i in range(max(0, k - MAX_TOKENS + 1), min(last, len(toks) - 1) + 1):
            asked.update((i, j) for j in range(max(i, k if i <= k else i) + 1, min(i + MAX_TOKENS, len(toks)) + 1))
    score = lambda i, j: field.w[[field.index[f] for f in features(text, toks, i, j) if f in field.index]].sum(axis=0)
    none: dict[int, float] = {}
    held = np.zeros(len(toks), bool)
    for i, j in asked:
        for k in range(i, j):
            if k not in none:
                none[k] = float(score(k, k + 1)[0])
        odds = float((score(i, j)[1:] + near).max()) - sum(none[k] for k in range(i, j)) - (j - i - 1) * field.move[0, 0]
        if odds >= least:
            held[max(0, i - AROUND) : j + AROUND] = True
    cuts = np.flatnonzero(np.diff(np.concatenate(([0], held.astype(np.int8), [0]))))
    return [toks[a:b] for a, b in zip(cuts[::2].tolist(), cuts[1::2].tolist())]


def find_spans(text: str | None, field: Field) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans) of a text."""
    text = text or ""
    base = base_spans(text)
    added = []
    for toks in windows(text, field):
        for s, e, kind, p in field.decode(text, toks):
            if p >= MIN_POSTERIOR and not any(s < y and x < e for x, y, _ in base) and not any(s < y and x < e for x, y, _ in added):
                added.append((s, e, kind))
    return base, sorted([*base, *added], key=lambda x: (x[0], KINDS.index(x[2])))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """Per row of docs: id_col, base and spans (arrays of kind, start, end)."""
    held = docs.sparkSession.sparkContext.broadcast(field or default_field())
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))

    def make():
        own = held.value

        def each(texts):
            found = [find_spans(t, own) for t in texts]
            rows = lambda spans: [{"kind": k, "start": s, "end": e} for s, e, k in spans]
            return {"base": [rows(b) for b, _ in found], "spans": [rows(a) for _, a in found]}

        return each

    return map_texts(docs, id_col, text_col, make, [("base", kind), ("spans", kind)], size=2048)


def op3_pii(spark, sf_dir):
    found = find_pii(table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
