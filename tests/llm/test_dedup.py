import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.llm import components, exact_dedup, line_dedup, near_dedup
from cuelake.llm.shingles import HyperMinHash, shingle_sets

DOCS = "doc_id long, text string, kept string, n long, keep_id string, id string, line string, node string"


def docs(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, "y", "z", "w", "v") for i, t in rows], DOCS)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_exact(spark):
    rows = [(1, "a b"), (2, "ab"), (3, " a\tb "), (4, None), (5, ""), (6, " \n"), (7, "A b"), (8, "x" * 200_000), (None, "a  b    c"), (9, "a b c"), (9, "a b c")]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs(spark, rows)).collect()}
    assert got == {(1, 3, 3, False), (2, 3, 3, False), (3, 3, 3, True), (4, 6, 3, False), (5, 6, 3, False), (6, 6, 3, True), (7, 7, 1, True), (8, 8, 1, True), (None, None, 3, True), (9, None, 3, False)}
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_exact_colliding_hashes(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.lit("0" * 32))
    got = {(r.doc_id, r.keep_id) for r in exact_dedup.exact_dedup(docs(spark, [(1, "a"), (2, "b"), (3, "a")])).collect()}
    assert got == {(1, 1), (2, 2), (3, 1)}


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_bounded_distance(spark, threshold):
    r = random.Random(threshold)
    pairs = []
    while len(pairs) < 300:
        a = "".join(r.choice("abé") for _ in range(r.randint(2 * threshold + 1, 16)))
        b = list(a)
        for _ in range(r.randint(0, threshold + 1)):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randint(0, 1)] = r.choice(["", "a", "é"])
        if b and abs(len(a) - len(b)) <= threshold:
            pairs.append((a, "".join(b)))
    for row in spark.createDataFrame(pairs, "a string, b string").withColumn("d", line_dedup.bounded_distance(F.col("a"), F.col("b"), threshold)).collect():
        assert min(row.d, threshold + 1) == min(edits(row.a, row.b), threshold + 1), row


def brute_lines(rows, threshold, least):
    norm = lambda x: " ".join(p for p in x.replace("\t", " ").split(" ") if p).lower()
    place, first = {}, {}
    for i, t in rows:
        for n, x in enumerate((t or "").split("\n")):
            if norm(x):
                place[i, n] = norm(x)
                first.setdefault(norm(x), (i, n))
    long = [x for x in first if len(x) >= least]
    near = {b for b in long for a in long if a != b and abs(len(a) - len(b)) <= threshold and first[a] < first[b] and edits(a, b) <= threshold}
    gone = {p for p, x in place.items() if p > first[x] or x in near}
    return {i: "\n".join(x for n, x in enumerate((t or "").split("\n")) if (i, n) not in gone) for i, t in rows}


def test_lines(spark):
    r = random.Random(4)
    base = ["".join(r.choice("abcd ") for _ in range(r.randint(6, 40))).strip() for _ in range(30)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(r.randint(0, 5)):
            x = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                k = r.randrange(len(x) + 1)
                x[k : k + r.randint(0, 1)] = r.choice(["", "a", "Q", "é"])
            lines.append("".join(x))
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, base[0] + "\n" + base[0]), (103, "short"), (104, "Short\n\n \nsh\n\nsh")]
    got = {x.doc_id: x.text for x in line_dedup.line_dedup(docs(spark, rows), threshold=2, min_chars=8).collect()}
    assert got == brute_lines(rows, 2, 8)


@pytest.mark.parametrize("crowd, depth", [(1000, 3), (3, 2)])
def test_crowded_keys(spark, crowd, depth):
    """Groups of near lines and of lines with common parts, by the plain join and by stars and finer segments."""
    r = random.Random(4)
    base = ["".join(r.choice("abcd ") for _ in range(r.randint(12, 40))).strip() for _ in range(6)]
    lines = set(base)
    while len(lines) < 90:
        x = list(r.choice(sorted(lines)))
        for _ in range(r.choice([1, 2, 3])):
            k = r.randrange(len(x) + 1)
            x[k : k + r.randint(0, 1)] = r.choice(["", "a", "q", "é"])
        if len(x) >= 8:
            lines.add("".join(x))
    lines = sorted(lines)
    r.shuffle(lines)
    near = {b for i, b in enumerate(lines) if any(abs(len(a) - len(b)) <= 2 and edits(a, b) <= 2 for a in lines[:i])}
    rows = spark.createDataFrame([(i, t, len(t), (False, i)) for i, t in enumerate(lines)], "x long, line string, n int, first struct<no_id:boolean,id:int>")
    rows = rows.withColumn("counts", line_dedup.letter_counts(F.col("line"), F.col("n")))
    assert {lines[x.x] for x in line_dedup.EditJoin(rows, 2, crowd, depth).near_lines().collect()} == near


def test_large_group_of_near_lines(spark):
    """2,000 lines near one another: the pairs that are verified grow with the lines, not with their square."""
    text = "a line of boilerplate that stands in very many documents with a number {} at its end"
    rows = [(i, text.format(str(1000 + i))) for i in range(2000)] + [(5000, text.format("")), (5001, "nothing like it in the rest of these lines")]
    got = {x.doc_id: x.n_near for x in line_dedup.line_dedup(docs(spark, rows)).collect()}
    digits = [t[0] for t in rows[:2000]]
    near = {i for i in digits if any(sum(a != b for a, b in zip(str(1000 + i), str(1000 + j))) <= 2 for j in range(0, i))}
    assert {i for i, n in got.items() if n} == near


def test_lines_cases(spark):
    long = "a line that is long enough to count " * 3000
    rows = [(None, long), (5, long + "\nother words of some length here"), (5, long + "\nother words of some length here"), (6, "Other  WORDS of some length here!")]
    got = [(x.doc_id, x.n_lines, x.n_repeated, x.n_near, len(x.text)) for x in line_dedup.line_dedup(docs(spark, rows)).collect()]
    kept = len(long) + 1 + len("other words of some length here")
    assert sorted(got, key=str) == sorted([(None, 1, 1, 0, 0), (5, 2, 0, 0, kept), (5, 2, 0, 0, kept), (6, 1, 0, 1, 0)], key=str)
    assert line_dedup.line_dedup(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        line_dedup.line_dedup(docs(spark, []), threshold=3, min_chars=6)


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (11, 12), (12, 13), (13, 14), (14, 15), (30, 20)]
    roots = {r.a: r.b for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert roots == {2: 1, 3: 1, 11: 10, 12: 10, 13: 10, 14: 10, 15: 10, 30: 20}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_near(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(r, n, copies):
    vocab = [f"w{k}" for k in range(50)]
    base = [[r.choice(vocab) for _ in range(r.randint(1, 80))] for _ in range(n)]
    rows = [" ".join(b) for b in base]
    for _ in range(copies):
        x = list(r.choice(base))
        for _ in range(r.randint(0, 4)):
            x[r.randrange(len(x))] = r.choice(vocab).upper()
        rows.append("  ".join(x) + r.choice(["", "\n", " more"]))
    return list(enumerate(rows + [None, "", "  ", "one", "ONE", "one two", "one two"]))


@pytest.mark.parametrize("words, percent", [(3, 85), (5, 80)])
def test_near(spark, words, percent):
    rows = corpus(random.Random(words), 25, 120)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_dedup(docs(spark, rows), words=words, percent=percent).collect()}
    assert got == brute_near(rows, words, percent)


def test_near_template(spark):
    """Many near copies of one text: a large bucket with several components."""
    r = random.Random(8)
    base = [f"t{k}" for k in range(120)]
    rows = []
    for i in range(150):
        x = list(base)
        for _ in range(r.randint(0, 12)):
            x[r.randrange(120)] = f"u{r.randrange(40)}"
        rows.append((i, " ".join(x)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_dedup(docs(spark, rows), words=3, percent=85).collect()}
    assert got == brute_near(rows, 3, 85)


@pytest.mark.parametrize("seed", [8, 9])
def test_near_repeated_rows_in_a_mixed_bucket(spark, seed):
    """Rows that repeat an id and text, null ids among them, count once in the prefix index."""
    r = random.Random(seed)
    base = [f"t{k}" for k in range(120)]
    rows = []
    for i in range(150):
        x = list(base)
        for _ in range(r.randint(0, 12)):
            x[r.randrange(120)] = f"u{r.randrange(40)}"
        rows.append((i, " ".join(x)))
    last = len(rows)  # stands for the null id, which is larger than any other
    rows.append((last, rows[3][1].replace("t60", "v60", 1)))
    given = [(None if i == last else i, t) for i, t in rows for _ in range(12)]
    got = {(last if r.doc_id is None else r.doc_id): (r.n_shingles, last if r.component_id is None else r.component_id) for r in near_dedup.near_dedup(docs(spark, given), words=3, percent=85).collect()}
    assert got == brute_near(rows, 3, 85)


def test_near_cases(spark):
    text = "some words that are the same in all of these rows"
    rows = [(None, text), (4, text), (4, text), (7, text + " x")]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_dedup(docs(spark, rows), words=3, percent=85).collect()), key=str)
    assert got == sorted([(None, 4, False), (4, 4, True), (4, 4, True), (7, 4, False)], key=str)
    assert near_dedup.near_dedup(docs(spark, [])).count() == 0
    assert near_dedup.near_dedup(docs(spark, [(1, None), (2, "")])).filter("kept").count() == 2


def test_registers():
    h = HyperMinHash(128, 10)
    r = np.random.default_rng(5)
    pool = r.integers(0, 1 << 62, 3000).astype(np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[1000:])
    same = (h.registers(a) == h.registers(b)).sum()
    true = 1000 / 3000
    assert abs(h.estimate(np.array([same]), np.array([2000]))[0] - true) < 5 * (true * (1 - true) / 128) ** 0.5
    small = np.unique(pool[:5])
    assert (h.registers(small) == h.registers(small)).all() and 0 <= h.collisions(5) < 0.01


def test_shingles():
    texts = [None, "", "A b", "a B", "x y z w", "x y z w x y z w", "x\ty\n z w"]
    sets = shingle_sets(texts, 3)
    assert [len(s) for s in sets] == [0, 0, 1, 1, 2, 4, 2]
    assert sets[2].tolist() == sets[3].tolist() and sets[4].tolist() == sets[6].tolist()


def test_letter_counts_at_their_limits(spark):
    rows = [("e" * 200 + "s" * 255, "x" * 300, False), ("e" * 200, "e" * 199 + "b", True), ("s" * 257, "s", True), ("s" * 130, "s", True), ("s" * 90, "s", False), ("e" * 129, "e" * 128, True), ("e" * 97 + "s", "e" * 97 + "so", True), ("e" * 99, "e" * 96 + "or", True)]
    frame = spark.createDataFrame(rows, "a string, b string, want boolean")
    a, b = F.col("a"), F.col("b")
    counts = [line_dedup.letter_counts(x, F.length(x)) for x in (a, b)]
    got = frame.select("a", "want", line_dedup.counts_within(*counts, F.greatest(F.length(a), F.length(b)), 2).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_keys_of_near_lines(spark, threshold):
    """Near lines share a key that one of them has for a segment in its place, on both sides of a class's limit; at 2 edits a line has four keys a class."""
    r = random.Random(threshold)
    pairs = []
    while len(pairs) < 600:
        a = "".join(r.choice("abcdefgé") for _ in range(r.choice([r.randint(2 * threshold + 1, 40), r.randint(60, 70), r.randint(126, 131)])))
        b = list(a)
        for _ in range(r.randint(0, threshold)):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randint(0, 1)] = r.choice(["", "h", "é"])
        if len(b) > 2 * threshold:
            pairs.append((a, "".join(b)))
    lines = sorted({x for p in pairs for x in p})
    frame = spark.createDataFrame([(x, len(x)) for x in lines], "line string, n int")
    keys = {}
    for line, own, below in line_dedup.with_keys(frame, threshold).select("line", "keys", "below").collect():
        keys[line] = [k for k in (own, below) if k]
    for a, b in pairs:
        every = [{k for part in keys[x] for k in part} for x in (a, b)]
        placed = [{k for part in keys[x] for k in part[: threshold + 1]} for x in (a, b)]
        assert placed[0] & every[1] or placed[1] & every[0], (a, b)
    if threshold == 2:
        assert {len(part) for parts in keys.values() for part in parts} == {4}
