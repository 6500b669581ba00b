"""Line deduplication by a segment-partition edit join, native DataFrame operations only.

A line is lower-cased, its runs of ASCII white space become one space, and it is trimmed.
Every line is dropped that repeats an earlier line, however short it is; empty lines always
stay. Of lines of at least `min_chars` code points those are dropped, too, whose first
occurrence lies within `threshold` edits of another such line that occurs first at an
earlier place. Places are ordered by document id (null last), then by a hash of the
document's text, then by line number, so rows that repeat both id and text are one document
and share one decision. Equal lines are told by 128 bits of hash.

Edits are found exactly: a line is split into threshold + 1 segments, whose lengths depend
only on its class of lengths. The segments of the first half are placed from the line's
start, those of the second half from its end. Of two lines within the threshold, one segment
of either is in the other, moved by no more than there are segments before (or behind) it. So
a line is indexed by its own segments and probes with the moved ones, and lines just above the
limit of a class have the keys of the class below, too. Keys are hashes of (class, segment
number, content). Keys that only two lines share make their pair right in the aggregate that
counts a key's lines; pairs are then filtered by length and letter counts and verified by a
banded bit-parallel edit distance. No pair that decides a line is missed.

A line is decided by any one earlier neighbour, so not all pairs of a large group are
needed. Keys that index more than CROWD lines are crowded: the earliest line of each is
verified against the others (a star), whose near ones are decided and from then on only
serve as neighbours of others; the earliest of the rest is next, for ROUNDS rounds. What is
left of the lines without the segment that they share is cut into segments again, since it
differs by as few edits, so that the key is parted into finer ones, down to DEPTH levels.
Only lines that are still open meet the earlier lines of their keys.

Defined results: null text counts as one empty line and comes back as an empty text; a
document may lose all its lines and then has an empty text; an empty table gives an empty
result. Other columns of the input are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import count_within, maybe_broadcast, staged, table, text_of

THRESHOLD, MIN_CHARS = 2, 24

#: Letters whose counts bound the edit distance from below, one byte each in a long; lines of more than SOME_CHARS characters
#: are told apart well enough by the first SOME of them.
COUNTED, SOME, SOME_CHARS = "etaniors", 4, 98

#: Lines of crowded keys are also told apart by the counts of these.
ALL_COUNTED = "abcdefghijklmnopqrstuvwxyz .,"

#: Lines that a key may index before it counts as crowded, and rounds of stars over crowded keys.
CROWD, ROUNDS = 32, 2
#: Levels of segments within segments by which crowded keys are parted.
DEPTH = 3

#: Rows of a line from which it is looked up by broadcast (behind a count) instead of by shuffle.
COMMON = 1000


def normalised(text: Column) -> Column:
    """Lower case, runs of white space as one space; line ends stay. Lines still need a trim."""
    rare = F.contains(text, F.lit("  "))
    for c in "\t\x0b\f\r":
        rare = rare | F.contains(text, F.lit(c))
    return F.lower(F.when(rare, F.regexp_replace(text, r"[ \t\x0B\f\r]+", " ")).otherwise(text))


def letter_counts(line: Column, n: Column) -> Column:
    """A long of the counts of letters modulo 256 of a line of n characters."""

    def counts(letters) -> Column:
        total = F.lit(0).cast("long")
        for k, c in letters:
            size = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))
            total = total.bitwiseOR(F.shiftleft(size.cast("long").bitwiseAND(F.lit(255)), 8 * k))
        return total

    letters = list(enumerate(COUNTED))
    return counts(letters[:SOME]).bitwiseOR(F.when(n <= SOME_CHARS, counts(letters[SOME:])).otherwise(F.lit(0).cast("long")))


def counts_within(a: Column, b: Column, longer: Column, threshold: int) -> Column:
    """An edit changes the counts by 2 in sum at most, so larger differences rule a pair out whose longer line has so many characters."""

    def differences(places: range) -> Column:
        total = F.lit(0).cast("long")
        for k in places:
            byte = lambda x, k=k: F.shiftright(x, 8 * k).bitwiseAND(F.lit(255))
            d = (byte(a) - byte(b)).bitwiseAND(F.lit(255))
            total = total + F.least(d, F.lit(256) - d)
        return total

    few = differences(range(SOME))
    return (few <= 2 * threshold) & ((longer > SOME_CHARS) | (few + differences(range(SOME, len(COUNTED))) <= 2 * threshold))


def all_counts(line: Column) -> Column:
    return F.transform(F.array(*map(F.lit, ALL_COUNTED)), lambda c: F.octet_length(line) - F.octet_length(F.replace(line, c, F.lit(""))))


def all_counts_within(a: Column, b: Column, threshold: int) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0), lambda total, d: total + d) <= 2 * threshold


def segment(n: Column, parts: int, i: int) -> tuple[Column, Column]:
    """(start from 1, length) of segment i of a line of n characters; the last n mod parts are longer by one."""
    base, long_from = F.floor(n / parts).cast("int"), parts - n % parts
    return F.lit(1) + i * base + F.greatest(F.lit(0), i - long_from), base + F.when(i >= long_from, 1).otherwise(0)


def class_of(n: Column, threshold: int) -> Column:
    """The least length of the class of lines of n characters, of which there are more than threshold."""
    unit = 4
    while unit < threshold:
        unit *= 2
    width = F.when(n < 8 * unit, unit).when(n < 16 * unit, 2 * unit).when(n < 32 * unit, 4 * unit).otherwise(8 * unit)
    return F.greatest(F.lit(threshold + 1), n - n % width).cast("int")


def class_below(n: Column, m: Column, threshold: int) -> Column:
    """The class below m, if lines of it can be near one of n characters, which is of class m; else null."""
    return F.when((n - m < threshold) & (m > threshold + 1), class_of(m - 1, threshold))


Place = tuple[int, Column, Column]


def top() -> Column:
    """The key that holds all lines."""
    return F.lit(0).cast("long")


def index_places(n: Column, m: Column, threshold: int) -> list[Place]:
    """(segment, start, length) of the segments by class m of a line of n characters, n at least m."""
    out = []
    for i in range(threshold + 1):
        at, size = segment(m, threshold + 1, i)
        out.append((i, at if 2 * i <= threshold else at + n - m, size))
    return out


def probe_places(n: Column, m: Column, threshold: int, both: bool = False) -> list[Place]:
    """(segment, start, length) of what can equal a segment of another line that is moved.

    Up to 2 edits, moves to the right do unless both are asked for: a segment that is moved to the
    left has one edit before it, which seen from the other line moves that one's to the right, where
    none of its other segments is in place. No place lies outside the line.
    """
    out = []
    for i, at, size in index_places(n, m, threshold):
        most = min(i, threshold - i)
        out += [(i, at + shift, size) for shift in range(-most if both or threshold > 2 else 1, most + 1) if shift]
    return out


def place_key(line: Column, m: Column, at: Place, within: Column) -> Column:
    """Hash of the segment number, the length m and the content at a place, within a coarser key."""
    return F.xxhash64(within, m.cast("long") * 16 + at[0], F.substring(line, at[1], at[2]))


def line_keys(line: Column, n: Column, m: Column, threshold: int) -> Column:
    """The keys of a line by class m, those of its own segments first."""
    return F.array(*[place_key(line, m, p, top()) for p in index_places(n, m, threshold) + probe_places(n, m, threshold)])


def with_keys(lines: DataFrame, threshold: int) -> DataFrame:
    """lines (line, n) with keys, of its class, and below, null or those of the class below."""
    line, n, m, b = F.col("line"), F.col("n"), F.col("m"), F.col("b")
    out = lines.withColumn("m", class_of(n, threshold)).withColumn("b", class_below(n, m, threshold))
    return out.withColumns({"keys": line_keys(line, n, m, threshold), "below": F.when(b.isNotNull(), line_keys(line, n, b, threshold))}).drop("m", "b")


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _common_prefix(s: Column, t: Column) -> Column:
    """Code points that s and t share at their start, found by halving steps."""
    most = F.least(F.length(s), F.length(t))
    steps = F.transform(F.sequence(F.length(F.bin(most)) - 1, F.lit(0)), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.aggregate(steps, F.lit(0), lambda p, w: F.when((p + w <= most) & (F.substring(s, p + 1, w) == F.substring(t, p + 1, w)), p + w).otherwise(p))


def bounded_distance(s: Column, t: Column, threshold: int) -> Column:
    """As banded_distance, which sees only what lies between the common prefix and the common suffix."""
    def without_suffix(x: Column) -> Column:
        k = _common_prefix(F.reverse(x["s"]), F.reverse(x["t"]))
        return let(k, lambda n: F.struct(F.left(x["s"], F.length(x["s"]) - n).alias("s"), F.left(x["t"], F.length(x["t"]) - n).alias("t")))

    def possible(x: Column) -> Column:
        """The segment rule once more: what differs at both ends has threshold - 2 edits left for
        what lies between, so one of its threshold - 1 segments is in the other, nearly at its place."""
        s, t, n = x["s"], x["t"], F.length(x["s"]) - 2
        if threshold == 1:
            return F.greatest(F.length(s), F.length(t)) <= 1
        same = n < threshold - 1
        for i in range(threshold - 1):
            at, size = segment(n, threshold - 1, i)
            for shift in range(-threshold, threshold + 1):
                same = same | ((at + 1 + shift >= 1) & (F.substring(t, at + 1 + shift, size) == F.substring(s, at + 1, size)))
        return same

    def measured(x: Column) -> Column:
        a, b = F.length(x["s"]), F.length(x["t"])
        return F.when((a == 0) | (b == 0), F.greatest(a, b).cast("long")).when(possible(x), banded_distance(x["s"], x["t"], threshold)).otherwise(F.lit(threshold + 1).cast("long"))

    core = let(_common_prefix(s, t), lambda n: F.struct(F.substring(s, n + 1, F.length(s)).alias("s"), F.substring(t, n + 1, F.length(t)).alias("t")))
    return let(core, lambda x: let(without_suffix(x), measured))


def banded_distance(s: Column, t: Column, threshold: int) -> Column:
    """Edit distance of s and t, exact where it is at most threshold, else larger than threshold.

    One machine word holds the 2 * threshold + 1 vertical differences of the band around the
    diagonal; each character of t moves the band by one row. The lengths may differ by
    threshold at most.
    """
    width, mask = 2 * threshold + 1, (1 << (2 * threshold + 1)) - 1
    long = lambda v: F.lit(v).cast("long")
    a, b, m = F.split(s, ""), F.split(t, ""), F.length(s)
    state = lambda vp, vn, d: F.struct(vp.alias("vp"), vn.alias("vn"), d.alias("d"))

    def bit(word: Column, at: Column | int) -> Column:
        return F.call_function("shiftright", word, at if isinstance(at, Column) else F.lit(at)).bitwiseAND(long(1))

    def matches(j: Column, c: Column) -> Column:
        """Bit k is set where the k-th character of the band around row j equals c."""
        out = long(0)
        for k in range(width):
            out = out.bitwiseOR(F.when(F.get(a, j - threshold + k - 1) == c, long(1 << k)).otherwise(long(0)))
        return out

    def step(acc: Column, j: Column) -> Column:
        vp, vn, row = acc["vp"], acc["vn"], m - j + threshold

        def with_d0(d0: Column) -> Column:
            return let(vn.bitwiseOR(long(mask).bitwiseXOR(d0.bitwiseOR(vp))), lambda hp: with_hp(d0, hp))

        def with_hp(d0: Column, hp: Column) -> Column:
            hn, down = d0.bitwiseAND(vp), F.shiftright(d0, 1)
            d = acc["d"] + F.when(row >= 2 * threshold, long(1) - bit(d0, 2 * threshold)).otherwise(bit(hp, row) - bit(hn, row))
            return state(hn.bitwiseOR(long(mask).bitwiseXOR(down.bitwiseOR(hp))), down.bitwiseAND(hp), d)

        return let(matches(j, F.get(b, j - 1)), lambda pm: let((pm.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(pm).bitwiseOR(vn).bitwiseAND(long(mask)), with_d0))

    start = state(long(((1 << (threshold + 1)) - 1) << threshold), long(0), F.least(m, F.lit(threshold)).cast("long"))
    return F.aggregate(F.sequence(F.lit(1), F.length(t)), start, step, lambda acc: acc["d"])


def line_hash(line: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of different seeds that stand for a line."""
    return F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")


def occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, doc_hash, line_no, normalised line and its hashes of every line that is not empty."""
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("doc_hash"), normalised(text).alias("text"))
    rows = rows.select("id", "doc_hash", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    rows = rows.select("id", "doc_hash", "line_no", F.trim("line").alias("line")).filter("line <> ''")
    return rows.select("*", *line_hash(F.col("line")))


def place() -> Column:
    return F.struct(F.col("id").isNull().alias("no_id"), "id", "doc_hash", "line_no")


class EditJoin:
    """The lines that have an earlier one within threshold edits.

    lines: x (a number of its own), line, n (its length) and first (its place), distinct, of more than
    2 * threshold characters. Where texts is given, which looks up (x, line, first) of the x of a
    table, lines hold keys and below (see with_keys) instead of line.
    """

    def __init__(self, lines: DataFrame, threshold: int, crowd: int = CROWD, depth: int = DEPTH, texts=None):
        self.lines, self.threshold, self.crowd, self.depth = lines, threshold, crowd, depth
        self.texts = texts or (lambda wanted: lines.select("x", "line", "first").join(wanted, "x", "left_semi"))
        self.keyed = self.rows_of_keys(lines if texts else with_keys(lines, threshold))

    def rows_of_keys(self, lines: DataFrame) -> DataFrame:
        """key, x, n and own: whether the key is that of a segment in its place."""
        parts = lambda c: F.posexplode(c).alias("at", "key")
        rows = lines.select("x", "n", parts("keys")).union(lines.filter(F.col("below").isNotNull()).select("x", "n", parts("below")))
        return rows.select("key", "x", "n", (F.col("at") <= self.threshold).alias("own"))

    def met(self, x: DataFrame, y: DataFrame, rule: Column) -> DataFrame:
        """(a, b) of the rows of x and y that share a key and can be near; the rule is part of the join, so buckets emit only what passes it."""
        x, y = (rows.select("key", *[F.col(k).alias(f"{k}{side}") for k in rows.columns if k in ("x", "n", "first", "more")]) for rows, side in ((x, "a"), (y, "b")))
        near = (F.col("nb") - F.col("na")).between(-self.threshold, self.threshold)
        if "morea" in x.columns:
            near = near & all_counts_within(F.col("morea"), F.col("moreb"), self.threshold)
        return x.join(y.hint("merge"), (x["key"] == y["key"]) & rule & near).select(F.col("xa").alias("a"), F.col("xb").alias("b"))

    def later(self, pairs: DataFrame, texts=None) -> DataFrame:
        """x: of each pair (a, b) within the threshold the line that occurs first at the later place. texts: as in the class."""
        wanted = maybe_broadcast(pairs.select(F.col("a").alias("x")).union(pairs.select("b")).distinct())
        line = F.col("line")
        found = staged((texts or self.texts)(wanted).withColumns({"n": F.length(line), "counts": letter_counts(line, F.lit(0))}), "line-texts")
        side = lambda k: found.select(F.col("x").alias(k), *[F.col(c).alias(c + k) for c in ("line", "first", "n", "counts")])
        alike = (F.col("nb") - F.col("na")).between(-self.threshold, self.threshold) & counts_within(F.col("countsa"), F.col("countsb"), F.lit(0), self.threshold)
        both = pairs.join(side("a"), "a").join(side("b"), "b").filter(alike).filter(bounded_distance(F.col("linea"), F.col("lineb"), self.threshold) <= self.threshold)
        return staged(both.select(F.when(F.col("firsta") > F.col("firstb"), F.col("a")).otherwise(F.col("b")).alias("x")).distinct(), "near-lines")

    def crowded(self, index: DataFrame) -> DataFrame:
        return staged(index.groupBy("key").agg(F.count(F.lit(1)).alias("lines")).filter(F.col("lines") > self.crowd).select("key"), "crowded-keys")

    def near_lines(self) -> DataFrame:
        """x of every line that has an earlier neighbour."""
        size = [F.count(F.lit(1)).alias("rows"), F.sum(F.col("own").cast("int")).alias("lines")]
        ends = [f(c).alias(name + c) for c in ("x", "n") for f, name in ((F.min, "least_"), (F.max, "most_"))]
        shared = self.keyed.groupBy("key").agg(*size, *ends).filter("lines > 0 AND least_x < most_x")
        shared = staged(shared.filter((F.col("rows") > 2) | (F.col("most_n") - F.col("least_n") <= self.threshold)), "shared-keys", free=True)
        two = shared.filter("rows = 2").select(F.col("least_x").alias("a"), F.col("most_x").alias("b"))
        many = maybe_broadcast(shared.filter("rows > 2").select("key", (F.col("lines") > self.crowd).alias("is_crowded")))
        rows = staged(self.keyed.join(many, "key"), "rows-of-keys")
        crowded, rows = rows.filter("is_crowded"), rows.filter("NOT is_crowded")
        index, probe = rows.filter("own"), rows.filter("NOT own")
        pairs = [two, self.met(index, index, F.col("xa") < F.col("xb")), self.met(index, probe, F.col("xa") != F.col("xb"))]
        decided = None
        if not crowded.isEmpty():
            decided, more = self.crowded_pairs(crowded)
            pairs.append(more)
        pairs = reduce(DataFrame.union, pairs).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        found = self.later(staged(pairs.distinct(), "line-pairs"))
        return found if decided is None else found.union(decided).distinct()

    # --- crowded keys: rows (key, x, line, n, more, first) of what is left of a line without the segments met so far.

    def finer(self, rows: DataFrame, places, keys: DataFrame | None = None) -> DataFrame:
        """Rows by the places in them: the key within the key before (only those in keys, if given), and the line without that place."""
        line, n, m = F.col("line"), F.col("n"), F.col("m")
        of_class = class_of(n, self.threshold)
        rows = rows.withColumn("m", F.explode(F.array_compact(F.array(of_class, class_below(n, of_class, self.threshold)))))
        parts = [F.struct(place_key(line, m, p, F.col("key")).alias("key"), p[1].alias("at"), p[2].alias("size")) for p in places(n, m)]
        out = rows.withColumn("p", F.explode(F.array(*parts))).withColumn("key", F.col("p.key"))
        out = out if keys is None else out.join(keys, "key", "left_semi")
        rest = F.concat(F.substring("line", F.lit(1), F.col("p.at") - 1), F.substring("line", F.col("p.at") + F.col("p.size"), F.col("n")))
        more = "more" if "more" in rows.columns else all_counts(line).alias("more")
        return out.select("key", "x", rest.alias("line"), (F.col("n") - F.col("p.size")).alias("n"), more, "first")

    def finer_index(self, rows: DataFrame, keys: DataFrame | None = None) -> DataFrame:
        return self.finer(rows, lambda n, m: index_places(n, m, self.threshold), keys)

    def finer_probe(self, rows: DataFrame, keys: DataFrame | None = None) -> DataFrame:
        return self.finer(rows, lambda n, m: probe_places(n, m, self.threshold), keys)

    def finer_other(self, rows: DataFrame) -> DataFrame:
        """As rows of probes only meet those of the index, they have all places."""
        return self.finer(rows, lambda n, m: index_places(n, m, self.threshold) + probe_places(n, m, self.threshold, both=True))

    def crowded_pairs(self, crowded: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(x of lines that stars have decided, pairs (a, b) of an earlier line and an open one that share crowded keys all the way down)."""
        decided, pairs = None, []
        keys = maybe_broadcast(crowded.select("key").distinct())
        texts = staged(self.texts(maybe_broadcast(crowded.select("x").distinct())), "crowded-texts")
        looked_up = lambda wanted: texts.join(wanted, "x", "left_semi")
        base = texts.select(top().alias("key"), "x", "line", F.length("line").alias("n"), "first")
        index, probe = (staged(rows, "crowded-lines") for rows in (self.finer_index(base, keys), self.finer_probe(base, keys)))
        for level in range(self.depth):
            decided = self.stars(index, decided, looked_up)
            if level + 1 == self.depth:
                pairs.append(self.open_pairs(index, probe, decided))
                break
            # Lines too short for finer segments, and those that can be near them.
            short = [rows.filter(F.col("n") <= 2 * self.threshold) for rows in (index, probe)]
            if not short[0].isEmpty():
                pairs.append(self.open_pairs(*short, decided))
            index, probe = (rows.filter(F.col("n") > self.threshold) for rows in (index, probe))
            index, probe = self.finer_index(index), self.finer_probe(index).union(self.finer_other(probe))
            index, probe = (staged(rows, "finer-lines") for rows in (index, probe))
            crowded = self.crowded(index)
            keys = maybe_broadcast(crowded)
            pairs.append(self.open_pairs(*(rows.join(keys, "key", "left_anti") for rows in (index, probe)), decided))
            if crowded.isEmpty():
                break
            index, probe = (staged(rows.join(keys, "key", "left_semi"), "crowded-lines") for rows in (index, probe))
        return decided, reduce(DataFrame.union, pairs)

    def stars(self, index: DataFrame, decided: DataFrame | None, texts) -> DataFrame:
        """x of decided lines, with those that are near the earliest open line of a key, for some rounds."""
        for _ in range(ROUNDS):
            left = index if decided is None else index.join(maybe_broadcast(decided), "x", "left_anti")
            pivots = left.groupBy("key").agg(F.min_by(F.struct("x", "n", "more"), F.struct("first", "x")).alias("p")).select("key", F.col("p.x").alias("pivot"), F.col("p.n").alias("n0"), F.col("p.more").alias("more0"))
            star = left.join(maybe_broadcast(staged(pivots, "pivots")), "key").filter((F.col("x") != F.col("pivot")) & (F.col("n") - F.col("n0")).between(-self.threshold, self.threshold)).filter(all_counts_within(F.col("more"), F.col("more0"), self.threshold))
            near = self.later(staged(star.select(F.col("pivot").alias("a"), F.col("x").alias("b")).distinct(), "star-pairs"), texts)
            if near.isEmpty():
                return near if decided is None else decided
            decided = near if decided is None else staged(decided.union(near).distinct(), "decided-lines")
        return decided

    def open_pairs(self, index: DataFrame, probe: DataFrame, decided: DataFrame) -> DataFrame:
        """(a, b) of an earlier line a and a line b that is not decided."""
        some, earlier = maybe_broadcast(decided), F.col("firsta") < F.col("firstb")
        open_index, open_probe = (rows.join(some, "x", "left_anti") for rows in (index, probe))
        pairs = self.met(index, open_index.union(open_probe), earlier).union(self.met(probe, open_index, earlier))
        return staged(pairs.distinct(), "open-pairs", free=True)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: id_col, the columns in keep, n_lines, n_repeated, n_near and text without the dropped lines."""
    if min_chars <= 2 * threshold:
        raise ValueError("min_chars must exceed twice the threshold")
    seen, n = staged(occurrences(docs, id_col, text_col), "occurrences"), F.col("n")
    # Lines are told apart without their texts: those are looked up for the few that share a key.
    keyed = with_keys(seen.withColumn("n", F.length("line")), threshold)
    merged = keyed.groupBy("h1", "h2").agg(F.min(place()).alias("first"), F.count(F.lit(1)).alias("times"), *[F.first(c).alias(c) for c in ("n", "keys", "below")])
    lines = staged(merged.select(F.monotonically_increasing_id().alias("x"), "*"), "lines", free=True)

    def texts(wanted: DataFrame) -> DataFrame:
        """x, line and first of the lines in wanted, read at the place where they occur first."""
        found = maybe_broadcast(lines.select("x", "first").join(wanted, "x", "left_semi")).alias("f")
        at = (F.col("s.doc_hash") == F.col("f.first.doc_hash")) & (F.col("s.line_no") == F.col("f.first.line_no")) & F.col("s.id").eqNullSafe(F.col("f.first.id"))
        return seen.alias("s").join(found, at).select("f.x", "s.line", "f.first").dropDuplicates(["x"])

    near = EditJoin(lines.filter(n >= min_chars).select("x", "n", "keys", "below"), threshold, texts=texts).near_lines().withColumn("near", F.lit(True))
    judged = lines.select("x", "h1", "h2", "first", "times").join(maybe_broadcast(near), "x", "left").filter("times > 1 OR near")
    judged = staged(judged.select("h1", "h2", "first", "times", F.coalesce("near", F.lit(False)).alias("near")), "judged-lines", free=True)
    drops = _dropped(seen.select("id", "doc_hash", "line_no", "h1", "h2"), judged).groupBy("id", "doc_hash").agg(F.collect_set(F.struct("line_no", "repeated")).alias("gone"))
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("doc_hash"), text.alias("text"), F.struct(F.lit(0).alias("none"), *keep).alias("kept"))
    joined = rows.alias("r").join(drops.alias("d"), F.col("r.id").eqNullSafe(F.col("d.id")) & (F.col("r.doc_hash") == F.col("d.doc_hash")), "left")
    gone, again = F.coalesce(F.size("gone"), F.lit(0)), F.coalesce(F.size(F.filter("gone", lambda g: g["repeated"])), F.lit(0))
    ends = F.octet_length("r.text") - F.octet_length(F.replace("r.text", F.lit("\n"), F.lit("")))
    parts = F.split("r.text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), ends), F.col("gone.line_no"))
    return joined.select(
        F.col("r.id").alias(id_col),
        *[F.col("r.kept")[c].alias(c) for c in keep],
        (ends + 1).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(again).cast("long").alias("n_repeated"),
        F.when(F.col("gone").isNull(), 0).otherwise(gone - again).cast("long").alias("n_near"),
        F.when(F.col("gone").isNull(), F.col("r.text")).otherwise(let(parts, lambda p: F.array_join(F.transform(stay, lambda i: F.get(p, i)), "\n"))).alias(text_col),
    )


def _dropped(seen: DataFrame, judged: DataFrame) -> DataFrame:
    """id, doc_hash, line_no and repeated of the occurrences that go.

    Lines of very many rows are few: where a count allows, they are looked up in a broadcast,
    and their rows are dealt out by place instead of by hash.
    """
    common = judged.filter(F.col("times") >= COMMON)
    if count_within(common, 100_000):
        common = F.broadcast(common.select("h1", "h2", F.col("first").alias("first0"), F.col("near").alias("near0")))
        rest = judged.filter(F.col("times") < COMMON).select(F.col("h1").alias("dealt"), "h2", F.col("first").alias("first1"), F.col("near").alias("near1"))
        dealt = F.when(F.col("near0").isNull(), F.col("h1")).otherwise(F.xxhash64("doc_hash", "line_no"))
        both = seen.join(common, ["h1", "h2"], "left").withColumn("dealt", dealt).join(rest.hint("shuffle_hash"), ["dealt", "h2"], "left")
        hit = both.withColumns({"first": F.coalesce("first0", "first1"), "near": F.coalesce("near0", "near1")})
    else:
        hit = seen.join(judged, ["h1", "h2"])
    repeated = place() > F.col("first")
    return hit.filter(repeated | F.col("near")).select("id", "doc_hash", "line_no", repeated.alias("repeated"))


def op10_line_dedup(spark, sf_dir):
    return line_dedup(table(spark, sf_dir, "documents"))


# DuckDB's levenshtein counts bytes; letters of the test tables outside ASCII are mapped to single bytes first.
# The sum of the differences of letter counts is at most twice the distance; it spares SQL most distances.
OP10_SQL = """
WITH o AS (
  SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, part,
         lower(trim(regexp_replace(part, '[ \\t\\x0B\\f\\r]+', ' ', 'g'))) AS line
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS part,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no
        FROM documents)),
l AS (
  SELECT line, min(struct_pack(d := doc_id, n := line_no)) AS first, length(line) AS len,
         translate(line, 'éèêëçàâîïôùûœñíóúáüäöß', chr(1)||chr(2)||chr(3)||chr(4)||chr(5)||chr(6)||chr(7)||chr(8)||chr(14)||chr(15)||chr(16)||chr(17)||chr(18)||chr(19)||chr(20)||chr(21)||chr(22)||chr(23)||chr(24)||chr(25)||chr(26)||chr(27)) AS code
  FROM o WHERE line <> '' GROUP BY line),
c AS (SELECT *, [length(line) - length(replace(line, x, '')) FOR x IN ['e', 't', 'a', 'n', 'i', 'o', 'r', 's']] AS counts FROM l WHERE len >= 24),
near AS (
  SELECT DISTINCT b.line FROM (SELECT unnest([-2, -1, 0, 1, 2]) AS d) k JOIN c a ON true JOIN c b
  ON b.len = a.len + k.d AND a.line <> b.line AND a.first < b.first
  WHERE CASE WHEN list_sum([abs(a.counts[i] - b.counts[i]) FOR i IN range(1, 9)]) <= 4 THEN levenshtein(a.code, b.code) <= 2 ELSE false END),
j AS (
  SELECT o.doc_id, o.line_no, o.part,
         coalesce(struct_pack(d := o.doc_id, n := o.line_no) > l.first, false) AS repeated,
         near.line IS NOT NULL AS near
  FROM o LEFT JOIN l ON o.line = l.line LEFT JOIN near ON o.line = near.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (repeated) AS n_repeated,
       count(*) FILTER (near AND NOT repeated) AS n_near,
       coalesce(string_agg(part, chr(10) ORDER BY line_no) FILTER (NOT repeated AND NOT near), '') AS text
FROM j GROUP BY doc_id
"""
