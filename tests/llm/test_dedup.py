"""Near copies, decontamination, mixing and neighbours against brute force."""

import itertools
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.llm import _common, ann_rabitq, decontam, minhash_oph, pfair_mix, queries
from quillframe.llm._bytes import CHUNK, alnum_split, pieces, shingles, spaces_split


def word_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in (text or "")))
    if not words:
        return set()
    return {tuple(words)} if len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows, k, percent):
    """Rows are nodes; rows of one doc_id and rows whose texts link are joined."""
    sets = [(d, word_set(t, k)) for d, t in rows]
    group = list(range(len(rows)))
    for (i, (a, x)), (j, (b, y)) in itertools.combinations(enumerate(sets), 2):
        if (a is not None and a == b) or (x and y and 100 * len(x & y) >= percent * len(x | y)):
            group = [group[i] if g == group[j] else g for g in group]
    least = {g: min((d for (d, _), h in zip(sets, group, strict=True) if h == g and d is not None), default=None) for g in group}
    return sorted(((d, len(s), least[g], d == least[g]) for (d, s), g in zip(sets, group, strict=True)), key=str)


def corpus(seed):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 100
    def add(words):
        nonlocal n
        n += int(rng.integers(1, 4))
        rows.append((n, " ".join(words)))
    for size in (4, 5, 6, 9, 13, 20, 40, 90, 200, 400):
        base = list(rng.choice(vocabulary, size))
        for edits in (0, 0, 1, 1, 2, 3, size // 30, size // 20, size // 12, size // 8):
            copy = list(base)
            for at in rng.integers(0, size, edits):
                copy[at] = str(rng.choice(vocabulary))
            add(copy)
    passage = list(rng.choice(vocabulary, 30))
    for _ in range(15):
        add(list(rng.choice(vocabulary, int(rng.integers(5, 40)))) + passage)
    chain = list(rng.choice(vocabulary, 120))
    for _ in range(12):  # each is near the one before, the ends are far apart
        add(chain)
        chain = [*chain[4:], *rng.choice(vocabulary, 4)]
    hub = list(rng.choice(vocabulary, 100))
    for _ in range(60):  # near the hub, often not near each other
        copy = list(hub)
        for at in rng.integers(0, 100, int(rng.integers(0, 5))):
            copy[at] = str(rng.choice(vocabulary))
        add(copy)
    order = rng.permutation(len(rows))
    return [(int(d), rows[i][1]) for d, i in zip(sorted(r[0] for r in rows), order, strict=True)]


EDGES = [(1, None), (2, ""), (3, "  \n "), (4, "one"), (5, "ONE"), (6, "one two three"), (7, "One\ttwo\nthree"), (8, "é É"), (9, "é é"), (None, "one"), (4, "one"), (None, "none has this"), (None, None)]
#: Different texts under one doc_id: the one with two texts joins what each of them links with, an empty one follows the others.
SHARED = [(9002, "a b c d e f"), (9004, "a b c d e f"), (9004, "u v w x y z"), (9009, "u v w x y z"), (9009, ""), (9011, "u v w x y z"), (None, "m n o p q r"), (9012, "m n o p q r"), (9013, "m n o p q r"), (9013, "m n o p q r"), (9014, "u v w x y z")]


@pytest.mark.parametrize(("seed", "k"), [(1, 4), (2, 5)])
def test_near_duplicates(spark, seed, k, monkeypatch):
    monkeypatch.setattr(minhash_oph, "HEAVY", 8)  # so that the index takes part
    monkeypatch.setattr(minhash_oph, "INDEX_SHINGLES", 1000)
    monkeypatch.setattr(_common, "BROADCAST_ROWS", 64)  # so that numbers are broadcast in slices
    rows = corpus(seed) + EDGES + SHARED
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as a", "3 as kept", "4 as component_id")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_oph.near_duplicates(docs, k, 80).collect()), key=str)
    assert got == brute(rows, k, 80)


@pytest.mark.parametrize("most", [2, 400_000])
def test_one_of_each(spark, most, monkeypatch):
    monkeypatch.setattr(_common, "BROADCAST_ROWS", most)
    rows = [(3, "a b c d e f g", 0), (1, "A b c d e f g", 1), (2, "other words stand here today ok", 2), (2, "other words stand here today ok", 3), (2, "a second text of this document", 4), (5, None, 5), (5, "", 6), (None, "a b c d e f g", 7)]
    rows += [(None, "one that nobody else has at all", 8), (None, "one that nobody else has at all", 9), (None, None, 10), (7, "one", 11), (8, "one", 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").withColumn("__at", F.lit(1)).withColumn("at", F.lit(1)).coalesce(1)
    got = minhash_oph.one_of_each(docs)
    assert got.columns == docs.columns and sorted(r.n for r in got.collect()) == [1, 2, 4, 5, 6, 8, 10, 11]
    assert minhash_oph.one_of_each(docs.limit(0)).count() == 0


@pytest.mark.parametrize("how", ["left_semi", "left_anti"])
def test_picked_in_slices(spark, how):
    rows = _common.numbered(spark.range(0, 5000, numPartitions=7).toDF("v"), "at")
    ids = rows.filter("v % 3 = 0").select("at")
    for most in (16, 100, 10_000):
        got = _common.picked(rows, ids, "at", how, lambda x: x.select("v"), most=most)
        assert sorted(r.v for r in got.collect()) == [v for v in range(5000) if (v % 3 == 0) == (how == "left_semi")]
    assert _common.picked(rows, ids.limit(0), "at", how, most=16).count() == (0 if how == "left_semi" else 5000)


def test_near_duplicates_of_a_very_long_text(spark):
    text = " ".join(f"w{i}" for i in range(120_000))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, text[: len(text) // 2]), (4, text)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash_oph.near_duplicates(docs, 5, 80).collect()) == [(1, 119_996, 1), (2, 119_997, 1), (3, len(text[: len(text) // 2].split()) - 4, 3), (4, 119_996, 1)]


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(5)
    for n in (6, 30, 130, 2000):
        found = []
        for _ in range(60):
            both, a, b = (rng.integers(0, 2**63, m, dtype=np.uint64) for m in (n, n // 8, n // 8))
            x, y = np.unique(np.concatenate([both, a])), np.unique(np.concatenate([both, b]))
            bins = minhash_oph.layout(n)
            found.append(np.mean(minhash_oph.sketch(x, bins) == minhash_oph.sketch(y, bins)))
        assert abs(np.mean(found) - n / (n + 2 * (n // 8))) < 0.05


def test_long_texts_are_read_whole():
    text = ("abc déf " * (CHUNK // 4)).encode()
    words = spaces_split()
    parts = [words.hashes(p, np.array([0, len(p)]))[0] for p in pieces(np.frombuffer(text, np.uint8), words.is_word)]
    assert len(parts) > 1 and sum(map(len, parts)) == 2 * (CHUNK // 4)
    assert len(shingles(np.concatenate(parts), 4)) == 2
    one = b"x" * (3 * CHUNK)
    assert [len(p) for p in pieces(np.frombuffer(one, np.uint8), words.is_word)] == [len(one)]


def words_of(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text))


def test_decontamination(spark):
    rng = np.random.default_rng(7)
    vocabulary = [f"v{i}" for i in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, f"{say(int(rng.integers(8, 50)))}. {say(int(rng.integers(3, 10)))}.") for i in range(40)]
    items += [(90, f"Question: {say(30)} Answer: {say(2)}"), (91, say(400)), (92, None), (93, ""), (94, "solo"), (None, "x y z")]
    docs = [(i, f"{say(int(rng.integers(0, 200)))} {items[i % len(items)][1] or ''} {say(int(rng.integers(0, 200)))}") for i in range(60)]
    docs += [(100 + i, say(300)) for i in range(20)] + [(200, None), (201, ""), (202, items[0][1][: len(items[0][1]) // 3]), (203, (items[1][1] + " ").upper()), (204, say(30_000) + " " + items[2][1])]
    items += [(95, f"{say(40)}. {say(3)}."), (96, items[5][1]), (5, items[5][1])]
    docs += [(205, items[-3][1].rsplit(". ", 1)[0] + " other end here now"), (206, items[-3][1].rsplit(". ", 1)[1]), (207, f"{say(9)} Question: {' '.join(items[40][1].split()[1:31])} {say(5)}")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as score")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as part", "2 as word")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(frame, bench).collect()}
    plain = lambda t: f" {' '.join(words_of(t or ''))} "
    want = {(d, i) for d, t in docs for i, x in items if i is not None and x and plain(x) in plain(t)}
    assert want <= got and {d for d, _ in got} == {d for d, _ in want} | {205} and (205, 95) in got  # all but the last sentence, but not that alone, nor a question without its answer
    ids = [r.item_id for r in decontam.contaminated(frame.filter("doc_id = 5"), bench).collect()]
    assert sorted(i for i in ids if i in (5, 96)) == [5, 5, 96]
    assert decontam.contaminated(frame, bench.limit(0)).count() == 0 and decontam.contaminated(frame.limit(0), bench).count() == 0
    kept = decontam.without_contaminated(frame, bench)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in got}


def test_wand_equals_full_scoring():
    rng = np.random.default_rng(8)
    vocabulary = [f"v{i}" for i in range(60)]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, say(int(rng.integers(4, 60)))) for i in range(50)]
    df: dict[int, int] = {}
    for _, t in items:
        for h in np.unique(decontam.word_hashes(t)):
            df[int(h)] = df.get(int(h), 0) + 1
    (index,) = decontam.build(items, df, len(items), 30.0)
    rows = [decontam.word_hashes(say(int(n))) for n in rng.integers(0, 500, 30)]
    h, first = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    got = {(row, item, low): score for row, item, low, score in decontam.search(index, h, first, 0.3)}
    want = {}
    for row, words in enumerate(rows):
        stride = index.window // 2
        for low in range(0, max(1, len(words) - stride), stride):
            terms = set(words[low : low + index.window].tolist())
            for i in range(len(items)):
                score = sum(index.impacts[p] for t in range(len(index.vocabulary)) if int(index.vocabulary[t]) in terms for p in range(index.starts[t], index.starts[t + 1]) if index.items[p] == i)
                if score >= 0.3 and len(words):
                    want[row, i, int(first[row]) + low] = score
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def plain_schedule(blocks, weights):
    """Slot by slot, without periods: (source, block, deadline, release) in order, windows anew when a source has run out."""
    left, done, out = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), []
    while left:
        q, run, began = pfair_mix.quotas({s: weights[s] for s in sorted(left)}), dict.fromkeys(left, 0), len(out)
        while True:
            t = len(out) - began
            free = [(-(-(run[s] + 1) * pfair_mix.SCALE // q[s]), s) for s in left if run[s] * pfair_mix.SCALE // q[s] <= t]
            deadline, s = min(free)
            assert t < deadline
            out.append((s, done[s]))
            run[s], done[s], left[s] = run[s] + 1, done[s] + 1, left[s] - 1
            assert all(abs(run[x] - (t + 1) * q[x] / pfair_mix.SCALE) < 1 for x in left)
            if not left[s]:
                del left[s]
                break
    return out


@pytest.mark.parametrize("scale", [20, 1000, 100_000])
def test_periods_give_the_schedule(scale, monkeypatch):
    monkeypatch.setattr(pfair_mix, "SCALE", scale)
    for seed in range(25):
        rng = np.random.default_rng(seed)
        names = [f"s{i}" for i in range(int(rng.integers(1, 9)))]
        weights = dict(zip(names, (rng.random(len(names)) + 0.05).tolist(), strict=True))
        rows = {s: int(rng.integers(0, 400)) for s in names}
        want = plain_schedule({s: -(-n // 3) for s, n in rows.items()}, weights)
        got, lost = {}, 0
        for p in pfair_mix.phases(rows, weights, 3):
            assert p.first == 0 or p.short == lost + 3 * -(-rows[want[p.first - 1][0]] // 3) - rows[want[p.first - 1][0]]
            lost = p.short
            for s, done in p.done.items():
                for b in range(done, -(-rows[s] // 3)):
                    turns, i = divmod(b - done, p.quotas[s])
                    if i < len(p.places[s]):
                        got[s, b] = p.first + turns * scale + p.places[s][i]  # a later phase has the last word
        assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == want and sorted(got.values()) == list(range(len(want)))


def test_many_items_take_little_memory():
    rng = np.random.default_rng(21)
    vocabulary = [f"v{i}" for i in range(3000)]
    weights = 1 / np.arange(1, 3001)
    say = lambda n: " ".join(rng.choice(vocabulary, n, p=weights / weights.sum()))
    items = [(i, say(40)) for i in range(20_000)]
    df: dict[int, int] = {}
    for _, t in items:
        for h in np.unique(decontam.word_hashes(t)).tolist():
            df[h] = df.get(h, 0) + 1
    (index,) = decontam.build(items, df, len(items), 40.0)
    rows = [decontam.word_hashes(f"{say(300)} {items[i * 37][1]} {say(200)}") for i in range(150)]
    h, first = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    tracemalloc.start()
    got = decontam.held(index, h, first)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300_000_000 and {(i, i * 37) for i in range(150)} <= {(r, item) for r, item, *_ in got}


def test_items_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(decontam, "ITEMS_A_PASS", 5)
    items = [(i, f"item number {i} asks what the word after {'x' * (i + 1)} is in this list. it is y{i}.") for i in range(12)] + [(3, "another text with the same number as one before has. end of it."), (4, "item number 4 asks what the word after xxxxx is in this list. it is y4.")]
    docs = [(i, f"before {t} after", i) for i, (_, t) in enumerate(items)] + [(None, f"x {items[2][1]}", 50), (None, "clean words", 51), (60, None, 52), (60, items[1][1], 53), (60, "clean too", 54), (60, "clean too", 55)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, n int").selectExpr("*", "1 as __text")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id) for r in decontam.contaminated(frame, bench).collect())
    want = sorted((str(d), i) for d, t, _ in docs for i, x in items if t and x in t)
    assert got == want
    kept = decontam.without_contaminated(frame, bench)
    assert kept.columns == frame.columns and sorted(r.n for r in kept.collect()) == [51, 52, 54, 55]


@pytest.mark.parametrize(("weights", "scale", "most"), [(None, 100_000, 400_000), ({"a": 0.5, "b": 0.3, "c": 0.2}, 100_000, 4), ({"a": 0.5, "b": 0.3, "c": 0.2}, 20, 400_000)])
def test_mixing(spark, weights, scale, most, monkeypatch):
    monkeypatch.setattr(pfair_mix, "SCALE", scale)
    counts = {"a": 700, "b": 90, "c": 301, None: 5, "zero": 0}
    rows = [(i, s, f"t{i}") for i, s in enumerate(s for s, n in counts.items() for _ in range(n))] + [(0, "a", "t0")] * 50 + [(None, "a", None)] * 200 + [(None, "c", "x" * 300_000), (3, "c", ""), (3, "c", "other")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 as __mix_of", "2 as MIX_SLOT", "3 as part", "4 as n").repartition(7)
    got = pfair_mix.mix(docs, weights, block_rows=10, most=most).collect()
    assert sorted(r.mix_position for r in got) == list(range(len(rows))) and sorted(map(str, ((r.doc_id, r.source, r.text) for r in got))) == sorted(map(str, rows))
    assert all((r["__mix_of"], r.part, r.n) == (1, 3, 4) for r in got)
    size = {s: sum(x == s for _, x, _ in rows) for s in counts}
    names = {s: "" if s is None else f"={s}" for s in counts}
    shares = {f"={s}": w for s, w in weights.items()} if weights else pfair_mix.tempered({names[s]: n for s, n in size.items() if n})
    want = plain_schedule({names[s]: -(-n // 10) for s, n in size.items()}, {n: shares.get(n, 1 / 3) for n in names.values()})
    by_slot = {}
    for r in sorted(got, key=lambda r: r.mix_position):
        by_slot.setdefault(r.mix_slot, []).append((names[r.source], r.mix_block))
    assert list(by_slot) == list(range(len(want)))  # positions follow slots
    for slot, (s, block) in enumerate(want):
        n = next(n for x, n in size.items() if names[x] == s)
        assert by_slot[slot] == [(s, block)] * min(10, n - 10 * block)
    assert pfair_mix.mix(docs.limit(0), weights).count() == 0


def test_mixing_moves_no_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = pfair_mix.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan


def plain_neighbours(rows, every, k):
    """Of rows (vec_id, vector), for each query row its (vec_id, score), sorted by query id and answers."""
    out = []
    for i, (q, v) in enumerate(rows):
        if q % every == 0:
            found = sorted((-float(np.add.accumulate(np.multiply(v, w))[-1]), c) for j, (c, w) in enumerate(rows) if j != i)[:k]
            out.append((q, [(c, -s) for s, c in found]))
    return sorted(out)


def answers(df):
    """The same of nearest()'s rows; repeated queries' ranks are dealt out in order."""
    ranks = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank, r.vec_id)):
        ranks.setdefault((r.query_id, r["rank"]), []).append((r.vec_id, r.score))
    return ranks


def test_neighbours(spark):
    rng = np.random.default_rng(9)
    sound = [(i, rng.standard_normal(16).tolist()) for i in range(300)]
    sound += [(300 + i, sound[7][1]) for i in range(60)] + [(20, sound[20][1]), (20, sound[3][1]), (1, sound[1][1]), (1, sound[5][1])]
    odd = [(360, None), (380, [0.0] * 16), (400, [1.0, None] + [0.0] * 14), (420, [float("nan")] * 16), (440, [float("inf")] + [0.0] * 15), (460, [1.0]), (None, sound[1][1])]
    df = spark.createDataFrame(sound + odd, "vec_id long, embedding array<double>").selectExpr("*", "1 as rank", "2 as query_id", "3 as at")
    got, want = answers(ann_rabitq.nearest(df, 20, 20, query_block=4)), {}
    for q, found in plain_neighbours(sound, 20, 20):
        for rank, x in enumerate(found, 1):
            want.setdefault((q, rank), []).append(x)
    assert got.keys() == want.keys()
    for key, x in want.items():
        assert [i for i, _ in got[key]] == [i for i, _ in sorted(x)] and [s for _, s in got[key]] == pytest.approx([s for _, s in sorted(x)])
    assert ann_rabitq.nearest(df.limit(0)).count() == 0 and ann_rabitq.nearest(df.filter("vec_id = 40")).count() == 0


def test_neighbours_of_few_repeated_rows(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.0])]
    got = answers(ann_rabitq.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert [got[20, i] for i in (1, 2)] == [[(1, 1.0)] * 2] * 2 and got[20, 3] == [(2, 0.0), (20, 0.0)] and got[20, 4] == [(2, -1.0), (20, 0.0)]


def test_recall_on_the_table(spark):
    got = queries.op9_ann_rabitq(spark, "/root/testdata/sf0.01").collect()
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    hit = 0
    for q in ids[ids % 20 == 0]:
        s = v @ v[ids == q][0]
        s[ids == q] = -np.inf
        hit += len(set(ids[np.argsort(-s)[:20]].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert hit / len(got) >= 0.99


def test_estimates_keep_their_bounds():
    rng = np.random.default_rng(10)
    for dim in (24, 64):
        v, q = rng.standard_normal((2000, dim)), rng.standard_normal((20, dim))
        turn = ann_rabitq.rotation(dim)
        assert np.allclose(turn @ turn.T, np.eye(dim))
        bits, radius, factor = ann_rabitq.codes(v, np.zeros(dim), turn)
        words, d = bits.view(np.uint64), turn.shape[1]
        assert words.shape == (2000, d // 64) and bits.nbytes * 8 == 2000 * d
        rounded = ann_rabitq.Rounded.of(q @ turn)
        got = rounded.products(words, np.bitwise_count(words).sum(axis=1), slice(0, 20))
        sign = np.unpackbits(bits, axis=1, count=d) * 2.0 - 1
        assert np.abs(got - (q @ turn) @ sign.T / np.sqrt(d)).max() < 5 * (rounded.step / 2).max()
        spread = radius / factor * np.sqrt(np.linalg.norm(q, axis=1)[:, None] ** 2 * (1 - factor**2) / (d - 1) + rounded.step[:, None] ** 2 / 4)
        assert np.mean(np.abs(got * radius / factor - q @ v.T) <= 3 * spread) > 0.99


def test_alnum_words():
    b = "A1 b-Cé9".encode()
    h, starts, first = alnum_split().hashes(np.frombuffer(b, np.uint8), np.array([0, len(b)]))
    assert starts.tolist() == [0, 3, 5] and first.tolist() == [0, 3]


@pytest.mark.parametrize("hot", [700, 701])
def test_neighbours_beside_a_vec_id_that_repeats(spark, hot):
    v = np.random.default_rng(31).standard_normal((1500, 64))
    v[701] = 1.5 * v[700]
    rows = [(int(i), v[i].tolist()) for i in np.concatenate([np.full(800, hot), np.arange(1500)])]
    got = answers(ann_rabitq.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1), 700, 900).filter("query_id = 700"))
    want = {}
    for q, found in plain_neighbours([r for r in rows if r[0] != 700] + [r for r in rows if r[0] == 700][: 1 if hot == 701 else None], 700, 900):
        for rank, x in enumerate(found, 1):
            if q == 700:
                want.setdefault(rank, []).append(x[0])
        if q == 700:
            break  # queries that repeat have the same answer
    assert all({i for i, _ in got[700, rank]} == set(want[rank]) for rank in range(1, 901))


def test_many_sources(spark, monkeypatch):
    """Sources beyond MOST_SOURCES share the windows of one."""
    monkeypatch.setattr(pfair_mix, "MOST_SOURCES", 3)
    size = {"a": 400, "b": 300, None: 200, **{f"s{i}": 10 + i for i in range(40)}}
    docs = spark.createDataFrame([(i, s) for s, n in size.items() for i in range(n)], "doc_id long, source string").repartition(5)
    for weights in (None, {"a": 0.5, "s7": 0.5}):
        got = pfair_mix.mix(docs, weights, block_rows=10).collect()
        assert sorted(r.mix_position for r in got) == list(range(sum(size.values())))
        usual = 0.5
        rest = sum(n**0.5 for s, n in size.items() if s and s[0] == "s") if weights is None else 0.5 + usual * 39
        given = {"=a": 400**0.5, "=b": 300**0.5, "": 200**0.5, "+": rest} if weights is None else {"=a": 0.5, "=b": usual, "": usual, "+": rest}
        own = {"=a": 400, "=b": 300, "": 200, "+": sum(n for s, n in size.items() if s and s[0] == "s")}
        want = [s for s, _ in plain_schedule({s: -(-n // 10) for s, n in own.items()}, {s: w / sum(given.values()) for s, w in given.items()})]
        slots = {r.mix_slot: ("" if r.source is None else f"={r.source}" if r.source in ("a", "b") else "+") for r in got}
        assert [slots[i] for i in sorted(slots)] == want[: len(slots)] and len(slots) == len(want)


def test_a_schedule_of_many_sources_is_quick():
    import time

    began = time.time()
    plan = pfair_mix.phases({f"s{i}": 10**9 + i * 10**7 for i in range(20)}, {f"s{i}": 1 / 20 for i in range(20)}, 256)
    assert len(plan) == 20 and time.time() - began < 12


def test_vectors_of_several_lengths(spark):
    """Each is compared with those of its own length, whichever is the commonest."""
    rng = np.random.default_rng(12)
    rows = [(i, rng.normal(size=(8, 8, 8, 12, 3)[i % 5]).tolist()) for i in range(200)]
    got = {}
    for r in ann_rabitq.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20, 20).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    for i in range(0, 200, 20):
        q = np.array(rows[i][1])
        want = sorted(((-float(q @ np.array(v)), j) for j, v in rows if j != i and len(v) == len(q)))[:20]
        assert [got[i][k + 1][0] for k in range(20)] == [j for _, j in want]


def test_each_source_has_its_share(spark, monkeypatch):
    """Sources beyond MOST_SOURCES run within the common windows by deadlines of their own, not one after another."""
    monkeypatch.setattr(pfair_mix, "MOST_SOURCES", 2)
    docs = spark.range(0, 1000, 1, 3).selectExpr("id as doc_id", "case when id < 300 then 'a' when id < 550 then 'b' when id < 750 then 'c' when id < 950 then 'd' else 'e' end as source")
    rows = pfair_mix.mix(docs, block_rows=4).orderBy("mix_position").collect()
    assert [r.mix_position for r in rows] == list(range(1000)) and len({r.doc_id for r in rows}) == 1000
    rest = [r.source for r in rows if r.source not in "ab"]
    due = lambda s, n: [((i // 4 + 1) / n**0.5, s, i) for i in range(n)]
    assert rest == [s for _, s, _ in sorted(due("c", 200) + due("d", 200) + due("e", 50))]
