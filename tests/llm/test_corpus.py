"""Filter audit, importance resampling and token files against brute force, with odd rows."""

import glob
import math
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from quillframe.llm import filter_audit, importance, queries, token_files
from tests.oracle import SF

DOCS = "doc_id long, text string, source string, TEXT2 string, word string, rank int, part string, row int, n int"
LABELS = "doc_id long, quality int, toxic int, part string"
LONG = " ".join(f"word{i % 180}" for i in range(30_000))
ROWS = [
    (1, " ".join(f"w{i}" for i in range(220)), "a"),
    (2, " ".join(f"w{i}" for i in range(220)), "a"),
    (2, " ".join(f"w{i}" for i in range(220)), None),
    (None, " ".join(f"w{i}" for i in range(220)), "a"),
    (None, None, None),
    (4, None, "b"),
    (5, "", ""),
    (6, "ABC $5 \x0b é", "b"),
    (7, LONG, "a"),
    (7, LONG, "a"),
    (8, "x " * 300, "b"),
    (9, "Dé, l’été! " * 60 + "A" * 30, "a"),
    (10, "a\tb c d|", "c"),
]
TOLD = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (7, 1, 1), (None, 1, 1), (9, None, None), (4, 0, 0), (99, 1, 1)]


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "t", "w", 1, "p", 2, 3) for r in rows], DOCS).repartition(3)


def audited(rows, labels):
    """By applying the filters one after another."""
    good, toxic = ({d for d, *x in labels if d is not None and x[i] == 1} for i in range(2))
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    flat = []
    for d, t, s in rows:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        flat.append((s or "", d, {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": d is not None and d > least[t]}))
    out = {}
    for part in {p for p, *_ in flat}:
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            left, gone = [x for x in flat if x[0] == part], []
            for step, f in enumerate(order, 1):
                now = [x for x in left if x[2][f]]
                redundant = sum(x[2][f] for x in gone)
                left, gone = [x for x in left if not x[2][f]], gone + now
                unique = sum(x[0] == part and x[2][f] and sum(x[2].values()) == 1 for x in flat)
                out[part, order, step] = [len(left), len(now), redundant, unique, sum(x[1] in good for x in now), sum(x[1] in toxic for x in now)]
                total[f] += len(now)
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


@pytest.mark.parametrize("rows", [ROWS, ROWS[4:5], []], ids=["odd", "null", "none"])
def test_audit(spark, rows):
    labels = spark.createDataFrame([(*x, "p") for x in TOLD], LABELS)
    got = {(r.part, r.filter_order, r.step): list(r[3:]) for r in filter_audit.audit(docs_of(spark, rows), labels).collect()}
    assert got == audited(rows, TOLD) and len(got) == 600 * len({s or "" for *_, s in rows})


def resampled(rows, target, percent, least):
    def features(text):
        w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        return [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]

    s, t = Counter(f for _, x, *_ in rows for f in features(x)), Counter(f for x in target for f in features(x))
    n, m = s.total() + 10_000, t.total() + 10_000
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * n / ((s[b] + 1) * m))) for b in s}
    out = []
    for d, x, *_ in rows:
        f = features(x)
        h = int(sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= 2 * least - 1), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = i
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("most", [importance.MOST_NODES, 50], ids=["one trie", "many tries"])
def test_resample(spark, most):
    rows = [*ROWS, *((100 + i, f"Été {i} " + "alpha beta, gamma " * (i % 17), "a") for i in range(300)), *((500, "the same text " * 9, "a") for _ in range(5))]
    target = ["Alpha beta", None, "", "gamma-alpha w1 w2 w3"]
    got = importance.resample(docs_of(spark, rows), spark.createDataFrame([(x,) for x in target], "text string"), percent=40, most_nodes=most)
    assert sorted(map(tuple, got.collect()), key=repr) == resampled(rows, target, 40, 20)


def test_resample_of_nothing(spark):
    empty, some = docs_of(spark, []), spark.createDataFrame([("a b",)], "text string")
    assert importance.resample(empty, some).count() == 0
    got = importance.resample(docs_of(spark, ROWS), some.filter("false")).collect()
    assert sorted(map(tuple, got), key=repr) == resampled(ROWS, [], 25, 20)


def test_hot_ties_are_split(spark):
    rows = spark.range(0, 60_000, 1, 8).selectExpr("5L as doc_id", "'x' as text")
    got = importance.resample(rows, rows.limit(1), least_words=1)
    assert got.filter("rank is not null").selectExpr("min(rank)", "max(rank)", "count(distinct rank)").first()[:] == (1, 15_000, 15_000)


ODD = ["", " ", "  a  b", "a b", "é à ü", "don't stop 'll", "x  y", "a 　b 世界 你好", "tab\t x\n\n y ", " lead", "trail ", "٣ ٤ 12 34", "😀 😀a b", "à b", "<|endoftext|> x <|endoftext|>", "A" * 5000, "y \x7f z \x00 q"]


@pytest.mark.parametrize("kept", [token_files.KEPT, 1], ids=["kept", "forgotten"])
def test_pieces_give_the_ids_of_texts(kept):
    path = token_files.vocabulary()
    whole = Tokenizer.from_file(path)
    rng = np.random.default_rng(3)
    letters = list("ab é  '.\n\t1٣世ñ ß  ")
    texts = [*ODD, *("".join(rng.choice(letters, 60)) for _ in range(500)), *pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()]
    encoder = token_files.Encoder(path, kept=kept)
    for some in (texts, texts[:3], [None, *texts[::7]]):
        got = encoder.encode(pa.array(some, pa.string()))
        assert got.to_pylist() == [[*whole.encode(t or "", add_special_tokens=False).ids, 2] for t in some]


class Counted:
    """A tokenizer that notes the texts it is asked for."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, []

    def encode_batch_fast(self, texts, **options):
        self.texts += texts
        return self.tokenizer.encode_batch_fast(texts, **options)


def counted(**options):
    encoder = token_files.Encoder(token_files.vocabulary(), **options)
    encoder.tokenizer = Counted(encoder.tokenizer)
    return encoder, encoder.tokenizer.texts


def test_words_met_often_are_not_asked_for_again():
    encoder, asked = counted(kept=20_000)
    whole = Tokenizer.from_file(token_files.vocabulary())
    often = " ".join(f"often{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}" for i in range(100))
    for i in range(60):
        text = f"{often} {' '.join(f'rare{i}x{j}' for j in range(200))} {often}"
        assert encoder.encode(pa.array([text])).to_pylist() == [[*whole.encode(text, add_special_tokens=False).ids, 2]]
        assert encoder.known.nbytes < 40_000
    assert "".join(asked).count("oftenbc") == 1 and "".join(asked).count("rare7x7 ") <= 1


def test_words_that_begin_lines_are_asked_for_together():
    encoder, asked = counted()
    words = [f"{a}{b}ontö" for a in "ABCDEFGHIJKLMNOPQRST" for b in "abcdefghijklmnopqrst"]
    text = "\n".join(f"{w} tà.\n{w} x$$$" for w in words)
    assert encoder.encode(pa.array([text])).to_pylist() == [[*Tokenizer.from_file(token_files.vocabulary()).encode(text, add_special_tokens=False).ids, 2]]
    assert len(asked) < len(words) / 10


@pytest.mark.parametrize("kept", [token_files.KEPT, 3000], ids=["kept", "forgotten"])
def test_cuts_at_lines_marks_and_letters_of_two_bytes(kept):
    whole = Tokenizer.from_file(token_files.vocabulary())
    rng = np.random.default_rng(5)
    parts = ["\n", "\n\n", "\n", " ", "  ", "\r\n", "\t", "a", "Été", "ö", "×", "÷", "ŗ", "Ə", "е", "\u0301", "\u00a0", "\u0085", "\u2028", "世", "😀", "'s", "'", ".", "$$$", "&", "12", "<|endoftext|>", "|>", "<|"]
    texts = ["".join(rng.choice(parts, rng.integers(1, 40))) for _ in range(4000)]
    encoder = token_files.Encoder(token_files.vocabulary(), kept=kept)
    for i in range(0, len(texts), 200):
        some = texts[i : i + 200]
        assert encoder.encode(pa.array(some)).to_pylist() == [[*whole.encode(t, add_special_tokens=False).ids, 2] for t in some]


def told(rows):
    """The sequence by whole texts, in order of doc_id."""
    whole, at, out, ids = Tokenizer.from_file(token_files.vocabulary()), 0, [], []
    for d, t in rows:
        own = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((d, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        at += len(own)
        ids += own
    return out, ids


def test_token_query_over_the_table(spark):
    t = pq.read_table(f"{SF}/documents.parquet").sort_by("doc_id")
    want, _ = told(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))
    assert sorted(map(tuple, queries.op13_token_files(spark, SF).collect())) == want


def test_token_files(spark, tmp_path):
    rows = [(i, f"text {i} " + ODD[i % len(ODD)] * (i % 5)) for i in range(2000)] + [(None, "null id"), (None, None), (7_000, LONG), *((3_000, "same") for _ in range(900))]
    token_files.write(docs_of(spark, [(*r, "s") for r in np.random.default_rng(1).permutation(np.array(rows, object)).tolist()]), str(tmp_path), row_group=64 << 10, page=4 << 10)
    want, ids = told(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None)))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = sorted((tuple(r) for r in token_files.read(spark, str(tmp_path)).select("doc_id", "start", "n_tokens", token_files.checksum()).collect()), key=key)
    cut = len(rows) - 2
    assert got[:cut] == sorted(want, key=key)[:cut]
    assert Counter(r[2:] for r in got[cut:]) == Counter(r[2:] for r in want[cut:])
    for lo, hi in ((0, 10), (5, 6), (900, 40_000), (0, len(ids)), (len(ids), len(ids) + 5)):
        if None in (d for d, s, n, _ in want if s < hi and s + n > lo):
            continue
        found = sorted(map(tuple, token_files.stretch(spark, str(tmp_path), lo, hi).collect()))
        assert [i for _, x in found for i in x] == ids[lo:hi] and all(a + len(x) == b for (a, x), (b, _) in zip(found, found[1:], strict=False))


def test_token_files_can_be_read_in_part(spark, tmp_path):
    rows = spark.range(0, 20_000, 1, 4).selectExpr("id as doc_id", "concat('text of ', id, repeat(' and more', id % 9)) as text")
    token_files.write(rows, str(tmp_path), row_group=64 << 10, page=4 << 10)
    files = sorted(glob.glob(f"{tmp_path}/tokens/*.parquet"))
    groups, used = 0, defaultdict(set)
    for f in files:
        meta = pq.ParquetFile(f).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                used[column.path_in_schema.split(".")[0]] |= set(column.encodings)
                assert column.has_column_index and column.has_offset_index
    assert groups > len(files)
    assert "RLE_DICTIONARY" in used["ids"] and all("DELTA_BINARY_PACKED" in used[c] and "RLE_DICTIONARY" not in used[c] for c in ("doc_id", "place", "n_tokens"))
    plan = token_files.read(spark, str(tmp_path)).filter("doc_id = 12345").select("doc_id", "start")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,12345)" in plan and "ids" not in plan.split("ReadSchema")[1]
    first = [pq.ParquetFile(f).read(columns=["doc_id"])["doc_id"].to_pylist() for f in files]
    assert sum(first, []) == list(range(20_000))


def test_token_files_of_nothing(spark, tmp_path):
    token_files.write(docs_of(spark, []), str(tmp_path))
    assert token_files.read(spark, str(tmp_path)).count() == 0 and token_files.stretch(spark, str(tmp_path), 0, 9).count() == 0
