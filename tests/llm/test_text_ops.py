"""Dedup, fingerprints and rules against brute force, on small tables with odd rows."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from runnel.llm import near_dedup, quality_rules, suffix_dedup, syncmers, toxicity, weak_quality
from runnel.llm.common import read, saved
from runnel.llm.graphs import components
from runnel.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __q string, h string, gram string"


def words(r, n, size=400):
    return [f"w{r.randrange(size)}" for _ in range(n)]


def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows."""
    r = random.Random(3)
    base = " ".join(words(r, 300))
    long = " ".join(words(r, 20_000, 5000))
    texts = [base, base, base.replace("w1 ", "q ", 1), " ".join(words(r, 200)), "", None, "a b", "a b", long, long + " end", "x" * 3000, "naïve ü 日本 " * 30]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", None, "q", "h", "g") for i, t in enumerate(texts)]
    return rows + [rows[3], (None, base, "en", "s", 1, "q", "h", "g"), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def similarity(a, b):
    """Longest common subsequence of the words, as a share of the longer text."""
    x, y = a.split(), b.split()
    row = [0] * (len(y) + 1)
    for w in x:
        old = row
        row = [0]
        for j, v in enumerate(y):
            row.append(old[j] + 1 if v == w else max(old[j + 1], row[j]))
    return row[-1] / max(len(x), len(y), 1)


def test_near_dedup_classes(spark, odd, none):
    r, rows = random.Random(1), []
    for g in range(12):
        w = words(r, 150, 3000)
        for _ in range(r.choice([1, 2, 4])):
            v = list(w)
            for _ in range(r.choice([0, 1, 2, 8])):
                v[r.randrange(len(v))] = f"n{r.random()}"
            rows.append((len(rows), " ".join(v)))
    got = {x.doc_id: x.class_id for x in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if similarity(rows[i][1], rows[j][1]) >= 0.8:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    assert got == dict(enumerate(label))
    out = [(x.doc_id, x.class_id) for x in near_dedup.classes(odd).collect()]
    assert len(out) == len(odd_rows()) and (0, 0) in out and (1, 0) in out and (2, 0) in out and (9, 8) in out and (7, 6) in out and out.count((None, None)) == 2
    assert near_dedup.classes(none).count() == 0
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns and {1, 2, 9, 7}.isdisjoint({x.doc_id for x in kept.collect()})


def test_near_dedup_families_whose_base_has_a_middle_id(spark):
    r, rows = random.Random(7), []
    for g in range(3):
        base = words(r, 200, 5000)
        family = []
        for _ in range(40):
            v = list(base)
            for i in r.sample(range(200), 21):  # near the base (0.895), not near each other (0.8 or less)
                v[i] = f"n{r.random()}"
            family.append(v)
        family.insert(20, base)
        rows += [(len(rows) + i, " ".join(v)) for i, v in enumerate(family)]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if similarity(rows[i][1], rows[j][1]) >= 0.8:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    got = {x.doc_id: x.class_id for x in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(rows) == 123 and label[20] == 0 and all(label[got[d]] == label[d] for d in got)  # no class joins two families
    assert sum(got[d] == label[d] for d in got) >= 0.95 * len(rows)  # each is linked to the base alone, with recall 0.96


def test_near_dedup_texts_beside_a_family_end_before_they_are_pairs(spark):
    """Before: each text that is just not near a family was a pair with most of its members, moved and aligned."""
    r, made = random.Random(9), []
    base = words(r, 200, 10**6)
    rows = [(0, " ".join(base))]
    for changed in [21] * 80 + [60] * 60:  # near the base (0.895); not near it (0.7), nor near those that are
        v = list(base)
        for i in r.sample(range(200), changed):
            v[i] = f"n{r.randrange(12)}"  # commoner than the words of the base
        rows.append((len(rows), " ".join(v)))
    real, near_dedup.starred = near_dedup.starred, lambda pairs, values: made.append(pairs.count()) or real(pairs, values)
    try:
        got = {x.doc_id: x.class_id for x in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        near_dedup.starred = real
    assert sum(got[d] == 0 for d in range(81)) >= 77 and all(got[d] == d for d in range(81, 141))
    assert made[-1] < 20  # before: 77


def test_near_dedup_parities_never_end_a_near_pair():
    t, r = near_dedup.WordHash(), random.Random(8)
    for n in (1, 5, 40, 200, 3000, 9000):
        a = words(r, n, 10 * n)
        b = [x if r.random() < 0.81 else f"n{r.random()}" for x in a]
        x, y = (near_dedup.shingles(near_dedup.word_hashes(" ".join(w), t), 1) for w in (a, b))
        apart = sum(int(v).bit_count() for v in (near_dedup.parity(x) ^ near_dedup.parity(y)).view(np.uint64))
        assert apart <= 2 * n - 2 * len(np.intersect1d(x, y))
    assert near_dedup.parity(x[:0]).tolist() == [0] * 64


def test_near_dedup_rows_get_their_parities_once(spark, monkeypatch):
    """Before: both sides of the comparison joined the parities, and what finer keys and labels made was made twice."""
    r = random.Random(11)
    passage = words(r, 90, 10**6)
    rows = [(i, " ".join(passage + words(r, r.randrange(40, 60), 200))) for i in range(60)]  # 0.6 of the words, and sketches, in common
    plans, read = [], []
    crossed, unsettled = near_dedup.crossed, near_dedup.unsettled
    monkeypatch.setattr(near_dedup, "crossed", lambda *a: plans.append((out := crossed(*a))._jdf.queryExecution().optimizedPlan().toString()) or out)
    monkeypatch.setattr(near_dedup, "unsettled", lambda rest: read.append(hasattr(rest, "scratch")) or unsettled(rest))
    got = {x.doc_id: x.class_id for x in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d for d in range(60)}
    assert [p.count("Join ") for p in plans] == [1]  # before: 3
    assert read[1:] == [True] * 3  # before: none


def test_near_dedup_words_of_one_component_are_no_keys(spark):
    rows = [(1, "a b c d e", 1), (2, "a b c d f", 1), (3, "g g h i j", 3), (4, "g k l m n o", 4)]
    got = near_dedup.prefixes(spark.createDataFrame(rows, "id long, value string, c long")).select("rep", "n", "top").collect()
    assert {x.rep for x in got} <= {3, 4} and all(x.n <= x.top <= x.n * 5 // 4 for x in got)  # before: "a" or another word of both
    near = [(1, "a b c d e", 1), (2, "a b c d f", 2)]
    assert len({x.k for x in near_dedup.prefixes(spark.createDataFrame(near, "id long, value string, c long")).collect()}) >= 1


def test_near_dedup_spans_of_near_texts_overlap_at_their_first_common_word():
    t, r = near_dedup.WordHash(), random.Random(10)
    room = np.arange(5000)
    assert all(near_dedup.needed(int(n)) <= k < near_dedup.needed(int(n) + 1) for k, n in zip(room, near_dedup.longest(room), strict=True))
    counts = np.array([r.randrange(50) for _ in range(64)])
    for _ in range(2000):
        n = r.choice((1, 3, 7, 40, 150))
        a = words(r, n, 4 * n)
        b = [x if r.random() < 0.85 else f"n{r.random()}" for x in a] + words(r, r.randrange(n // 5 + 1), 4 * n)
        x, y = (near_dedup.shingles(near_dedup.word_hashes(" ".join(w), t), 1) for w in (a, b))
        if len(np.intersect1d(x, y)) < near_dedup.needed(max(len(a), len(b))):
            continue
        p, q = near_dedup.rare_first(x, counts).tolist(), near_dedup.rare_first(y, counts).tolist()
        i = next(i for i, k in enumerate(p) if k in q)
        tops = near_dedup.longest(np.array([len(a) - i, len(b) - q.index(p[i])]))
        assert max(len(a), len(b)) <= tops.min()


def test_near_dedup_finer_keys_find_every_near_pair(spark):
    """Of texts that share a passage, against the longest common words of all pairs in any order."""
    r = random.Random(12)
    passage, rows = words(r, 60, 10**6), []
    for _ in range(40):
        v = passage + words(r, r.randrange(30, 45), 60)
        for n in (0, 8, 14, 18):
            rows.append([f"w{r.randrange(60)}" if r.random() < n / 100 else w for w in v] + words(r, r.choice([0, n]), 60))
    t = near_dedup.WordHash()
    h = [near_dedup.shingles(near_dedup.word_hashes(" ".join(v), t), 1) for v in rows]
    need = lambda i, j: near_dedup.needed(max(len(rows[i]), len(rows[j])))
    want = {(i, j) for j in range(len(rows)) for i in range(j) if len(np.intersect1d(h[i], h[j])) >= need(i, j)}
    docs = spark.createDataFrame([(i, " ".join(v), i) for i, v in enumerate(rows)], "id long, value string, c long")
    found = saved(near_dedup.unsettled(saved(near_dedup.prefixes(docs))))
    stars = {tuple(x) for x in near_dedup.starry(found).collect()}
    bits = docs.select("id", "value").mapInArrow(near_dedup._parity_rows, "rep long, bits array<long>")
    met = {tuple(x) for x in near_dedup.crossed(found.join(bits, "rep")).collect()}
    # Pairs of a key's centre are in both here, as its rows are not taken out.
    assert len(want) > 100 and want <= met and stars


def test_components_of_new_edges_keep_what_is_known(spark):
    pairs = lambda rows, names: spark.createDataFrame(rows, names)
    known = components(pairs([(1, 5), (5, 7), (3, 4)], "a long, b long"))
    got = {x.node: x.label for x in components(pairs([(4, 7), (8, 9)], "a long, b long"), known).collect()}
    assert got == {1: 1, 3: 1, 4: 1, 5: 1, 7: 1, 8: 8, 9: 8}


def test_near_dedup_pairs_of_a_common_passage_grow_with_the_texts(spark):
    """Before: 148,176 pairs went to signatures and alignment, as texts of the passage met one by one."""
    r = random.Random(5)
    passage, rows = words(r, 90, 10**6), []
    for _ in range(200):
        w = words(r, 60, 10**6)
        v = [f"n{r.random()}" if i % 6 == 0 else x for i, x in enumerate(w)]  # with its twin 140 of 150 words in common
        rows += [(len(rows), " ".join(passage + w)), (len(rows) + 1, " ".join(v[:30] + passage + v[30:] if len(rows) % 4 else passage + v))]
    docs, made = spark.createDataFrame(rows, "doc_id long, text string"), []
    real, near_dedup.starred = near_dedup.starred, lambda pairs, values: made.append(pairs.count()) or real(pairs, values)
    try:
        got = {x.doc_id: x.class_id for x in near_dedup.classes(docs).collect()}
    finally:
        near_dedup.starred = real
    label = [i - i % 2 if i % 4 == 1 else i for i in range(400)]
    assert got == dict(enumerate(label)) and sum(made) < 8000


def test_two_near_texts_share_one_of_their_rarest_words():
    t, r = near_dedup.WordHash(), random.Random(6)
    counts = np.array([r.randrange(50) for _ in range(64)])
    for n in (1, 2, 4, 5, 9, 50, 150) * 20:
        a = words(r, n, r.choice([5, 50, 5000]))
        gone = set(r.sample(range(n), n // 5))
        b = [f"n{r.random()}" if i in gone else x for i, x in enumerate(a)]
        x, y = (near_dedup.shingles(near_dedup.word_hashes(" ".join(w), t), 1) for w in (a, b))
        assert set(near_dedup.rare_first(x, counts)) & set(near_dedup.rare_first(y, counts))
        assert len(near_dedup.rare_first(x, counts)) == n // 5 + 1


def test_alignment_is_the_longest_common_subsequence():
    t, r = near_dedup.WordHash(), random.Random(4)
    for n in [1, 2, 5, 30, 70, 150] * 6:
        a = words(r, n, r.choice([3, 20, 1000]))
        b = list(a)
        for _ in range(r.randrange(n // 4 + 2)):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randrange(2)] = r.choice([[], ["x"], words(r, 1, 20)])
        want = similarity(" ".join(a), " ".join(b))
        got = near_dedup.aligned(near_dedup.word_hashes(" ".join(a), t), near_dedup.word_hashes(" ".join(b), t))
        assert got == want if want >= 0.8 else got < 0.8
    turned = near_dedup.word_hashes(" ".join(f"a{(i + 50) % 100}" for i in range(100)), t)
    assert near_dedup.aligned(near_dedup.word_hashes(" ".join(f"a{i}" for i in range(100)), t), turned) < 0.8


def test_sketches_of_blocks_are_those_of_the_whole():
    h = near_dedup.shingles(near_dedup.word_hashes(" ".join(words(random.Random(1), 900)), near_dedup.WordHash()))
    v = near_dedup._mix(h[None, :] ^ near_dedup._SEEDS)
    at, want = np.sort(np.argsort(v, axis=1)[:, : near_dedup.PICKS], axis=1), near_dedup._SEEDS.ravel()
    for j in range(near_dedup.PICKS):
        want = near_dedup._mix(want + h[at[:, j]])
    assert (near_dedup.sketches(h) == want).all() and (near_dedup.sketches(h, 100) == want).all()


def test_signatures_give_up_no_near_pair_and_most_others():
    t, r = near_dedup.WordHash(), random.Random(2)
    sig = lambda w: np.frombuffer(near_dedup.signature(near_dedup.word_hashes(" ".join(w), t)), np.uint8)
    near, far, base = [], [], []
    for _ in range(300):
        w = words(r, 150, 3000)
        v = list(w)
        for i in r.sample(range(150), 30):
            v[i] = f"n{r.random()}"
        base.append(sig(w))
        near.append(sig(v))
        far.append(sig(w[:50] + words(r, 100, 3000)))
    assert near_dedup.alike(np.array(base), np.array(near)).all() and near_dedup.alike(np.array(base), np.array(far)).mean() < 0.05


def brute_suffix(rows, size=50):
    first, last = {}, 1 << 63
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - size + 1):
            k = b[i : i + size]
            first[k] = min(first.get(k, last), last if d is None else d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - size + 1):
            if first[b[i : i + size]] < (last if d is None else d):
                gone[i : i + size] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffix_dedup(spark, odd, none):
    r, passage = random.Random(5), "ü".join(words(random.Random(9), 30))
    rows = []
    for i in range(40):
        t = " ".join(words(r, 40))
        if i % 3 == 0:
            t = t[: r.randrange(len(t))] + passage + t[5:]
        if i % 7 == 0:
            t += "ab" * 60
        rows.append((i, t))
    rows += [(50, rows[0][1]), (51, ""), (52, None), (53, "a" * 49), (54, "a" * 300), (55, "a" * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, suffix_dedup.digest(df).collect()), key=str) == brute_suffix(rows)
    assert suffix_dedup.digest(none).count() == 0
    odd_texts = [(x.doc_id, x.text) for x in odd.collect()]
    assert sorted(map(tuple, suffix_dedup.digest(odd).collect()), key=str) == brute_suffix(odd_texts)
    cut = suffix_dedup.cut_texts(odd)
    assert cut.columns == odd.columns and cut.count() == odd.count()
    assert {x.doc_id: x.text for x in cut.collect()}[1] == ""


def test_common_grams_are_split(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SPLIT", 2)
    rows = [(i, f"{i} " * 5 + "the same long passage that is in every document of this table, again " * 2 + f"{i}" * 7) for i in range(9)]
    line = "a line that its document repeats and that others have as well\n"
    rows += [(20, line * 30), (21, "x" + line * 3), (22, line * 9 + "end"), (23, "start " + line)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, suffix_dedup.digest(df).collect()), key=str) == brute_suffix(rows)


def test_blocks_keep_all_strings_and_equal_strings_meet():
    r = random.Random(3)
    texts = [" ".join(words(r, 12)) + " the anchor may lie here " + " ".join(words(r, 6 + i % 3)) for i in range(60)]
    rows = []
    for d, t in enumerate(texts + [x[20:] for x in texts]):
        b = np.frombuffer(t.encode(), np.uint8)
        for k, _, s, e in zip(*suffix_dedup.anchors(b)):
            rows.append((int(k.view(np.int64)), 0, d, 0, int(s), t.encode()[s : e + suffix_dedup.LEN], [d]))
    names = ["gram", "sub", "doc_id", "h", "begin", "bytes", "more"]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names)

    def strings(batches):
        return [(x["gram"], x["sub"], x["doc_id"], x["begin"] + i, x["bytes"][i : i + 50]) for b in batches for x in b.to_pylist() for i in range(len(x["bytes"]) - 49)]

    want = sorted((g, d, at, x) for g, _, d, at, x in strings([batch]))
    blocks = list(suffix_dedup._blocks(suffix_dedup.BLOCK)([batch]))
    for out in (blocks, list(suffix_dedup._blocks(1)(blocks))):
        got = strings(out)
        assert sorted((g, d, at, x) for g, _, d, at, x in got) == want
        assert len({(g, s, x) for g, s, _, _, x in got}) == len({x for *_, x in got})
    assert all(x["more"] == [x["doc_id"]] for b in blocks for x in b.to_pylist())
    assert sum(b.num_rows for b in blocks) <= 4 * len(rows)


def test_texts_read_in_pieces_have_the_same_anchors(monkeypatch):
    b = np.random.default_rng(1).integers(97, 100, 5000).astype(np.uint8)

    def by_start():
        out = {}
        for k, _, s, e in zip(*suffix_dedup.anchors(b)):
            for i in range(s, e + 1):
                out.setdefault(i, set()).add(int(k))
        return out

    whole = by_start()
    monkeypatch.setattr(suffix_dedup, "PIECE", 256)
    assert sorted(whole) == list(range(len(b) - suffix_dedup.LEN + 1)) and by_start() == whole


def test_strings_that_meet_in_one_window_are_settled_there():
    data = [b"x" * 60, b"y" + b"x" * 59, b"z" * 50]
    at = np.array([0, 7, 3])
    out = suffix_dedup._settled(np.array([5, 5, 6]), np.array([2, 1, 1]), np.array([0, 0, 0]), at, data, [None, [9], None]).to_pylist()
    sent = sorted((r["doc_id"], r["begin"], r["bytes"]) for r in out if r["bytes"])
    assert [(r["doc_id"], r["begin"], r["end"]) for r in out if not r["bytes"]] == [(2, 0, 60)]
    assert sent == [(1, 3, data[2]), (1, 7, data[1])]
    assert sorted((r["begin"], r["more"]) for r in out if r["doc_id"] == 1) == [(3, None), (7, [9])]


def test_equal_suffixes():
    r = np.random.default_rng(0)
    rows = r.integers(97, 99, (400, suffix_dedup.LEN)).astype(np.uint8)
    rows[:, : suffix_dedup.LEN - 4] = rows[r.integers(0, 3, 400), : suffix_dedup.LEN - 4]
    c = suffix_dedup.equal_suffixes(rows)
    want = {}
    for k, row in zip(c.tolist(), rows):
        assert want.setdefault(k, row.tobytes()) == row.tobytes()
    assert len(want) == len({x.tobytes() for x in rows})


def syncmers_of(text):
    """Brute force: (position, words) of the closed syncmers, by the hashes that Spark gives."""
    spark = SparkSession.getActiveSession()
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    pairs = sorted({(w[i], w[i + 1]) for i in range(len(w) - 1)})
    df = spark.createDataFrame(pairs or [("", "")], "a string, b string")
    h = {(x.a, x.b): x.h for x in df.select("a", "b", F.xxhash64(F.xxhash64("a"), F.xxhash64("b")).alias("h")).collect()}
    out = []
    for i in range(len(w) - syncmers.K + 1):
        inner = [h[w[j], w[j + 1]] for j in range(i, i + syncmers.K - syncmers.S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, tuple(w[i : i + syncmers.K])))
    return out or [(i, (x,)) for i, x in enumerate(w)]


def likeness_of(a, b):
    """Brute force: anchors with the same words at most a cell away, of both sides."""
    x, y = ({(k, i // syncmers.CELL) for i, k in t} for t in (a, b))
    if not x and not y:
        return 1.0
    near = lambda s, t: sum(any((k, c + d) in t for d in (-1, 0, 1)) for k, c in s)
    return (near(x, y) + near(y, x)) / (len(x) + len(y))


def test_syncmers(spark, odd, none):
    out = syncmers.edited(odd).collect()
    rows = sorted(((-(1 << 63) if x.doc_id is None else x.doc_id), x.text or "") for x in odd.collect())
    assert len(out) == len(rows) and syncmers.edited(none).count() == 0
    anchors = {t: syncmers_of(t) for _, t in rows}
    want = []
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        anchors[e] = anchors.get(e) or syncmers_of(e)
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), likeness_of(anchors[t], anchors[e]), likeness_of(anchors[t], anchors[n])))
    got = [(-(1 << 63) if x.doc_id is None else x.doc_id, x.n_chars, x.edited_sha256, x.near_edited, x.near_next) for x in out]
    assert sorted(got) == sorted(want)
    by_text = {}
    for x in out:
        t = next(t for i, t in rows if i == (-(1 << 63) if x.doc_id is None else x.doc_id) and len(t) == x.n_chars)
        assert by_text.setdefault(t, x.fingerprint) == x.fingerprint
        places = [int(p[8:], 16) for p in x.fingerprint.split(".") if p]
        assert list(np.cumsum(places)) == [i for i, _ in anchors[t]]  # all anchors, in order, with their places


def test_quality_rules(spark, odd, none):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = QUERIES["op7_quality_rules"](spark, SF)
    want = con.sql(ORACLE_SQL["op7_quality_rules"]).select(*df.columns).fetchall()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))
    limits = quality_rules.thresholds(saved(quality_rules.metrics(read(spark, SF, "documents")))).toPandas()
    assert all(limits[f"{side}_{k}"].nunique() > 1 for side, k, _, _ in quality_rules.LIMITS if k != "symbol_pm")
    rows = quality_rules.judge(odd)
    by = {x.doc_id: x for x in rows.collect()}
    assert rows.count() == odd.count() and by[4].n_words == 0 and by[4].base_failed and not by[4].kept and by[6].base_failed
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns and sorted(str(x.doc_id) for x in kept.collect()) == sorted(str(x.doc_id) for x in rows.where("kept").collect())
    assert quality_rules.judge(none).count() == 0 and quality_rules.keep_good(none).count() == 0


def test_toxicity(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    out = QUERIES["op8_toxicity"](spark, sf).join(labels, "doc_id").where("held_out").collect()
    right = [x.predicted == x.toxic for x in out]
    assert len(out) > 50 and sum(right) / len(right) >= 0.9  # some 300 labels to learn from
    weights = toxicity.fit(docs, labels)
    rows = toxicity.score(odd, weights)
    assert rows.count() == odd.count() and all(0 <= x.score <= 1 for x in rows.collect())
    assert toxicity.keep_clean(odd, weights).columns == odd.columns and toxicity.score(none, weights).count() == 0
    assert len(toxicity.fit(docs, labels.limit(0))[0]) == 1


def test_weak_quality(spark, odd, none):
    post, accuracy = weak_quality.posteriors(["1" * 10, "0" * 10, "1111111112"], np.array([70.0, 20.0, 10.0]))
    assert post[0] > 0.9 and post[1] < 0.1 and min(accuracy.values()) > 0.5
    sf = "/root/testdata/sf0.01"
    out = QUERIES["op5_weak_quality"](spark, sf).join(read(spark, sf, "labels"), "doc_id").collect()
    good, bad = [x.score for x in out if x.quality == 1], [x.score for x in out if x.quality == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc >= 0.9, auc
    assert weak_quality.classify(odd).count() == odd.count() and weak_quality.classify(none).count() == 0
