"""Secrets: patterns of known forms, and a battery of randomness tests for other tokens.

Candidates of the battery are all tokens of MIN_LENGTH characters or more. A token's encoding is the first of ENCODINGS that
has all its letters, and within it three statistics are taken: for uniformity the coincidences (ordered pairs of equal
letters, which is chi-squared up to constants of the length), the runs of letter classes (lower and upper case, digits,
signs; vowels and others where there are letters alone), and the serial correlation of neighbours as vowels.

Each statistic is held against two tables by encoding and length. Under uniform letters its moments are exact; a token that
any of the three tests rejects as random at level UNLIKE, on either side, is none. Under ordinary text (words, numbers and
signs) the least random values that such tokens have are stated for each encoding: Q0, the chance of two places to have one
letter, R0, the share of neighbours of two classes, and the correlation SERIAL of vowels; these give three p-values, which
Fisher's method combines to one (two of them where the third would tell nothing, or the same as the second). Short tokens have p-values near the level, long ones far below it.

Benjamini-Hochberg control at ALPHA within each encoding and band of length decides, with the p-values counted in bins over
the whole corpus: one small table of counts reaches the driver. As a last filter, what the battery has found but a model of
the corpus's own words (ordinary()) finds likelier than random letters is let go; the model finds nothing itself.
Only DataFrame operations are used, all within a row of the text.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm._common import free, written

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
KINDS = ("assign", "access", "hex", "random")
MIN_LENGTH, ALPHA, UNLIKE = 16, 0.1, 0.0005
#: Lower ends of the bands of length within which false discoveries are controlled, and p-value bins per factor of 10.
BANDS, PER_DECADE, DECADES = (16, 20, 24, 32, 48, 96), 20, 16

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
VOWELS, SERIAL = "aeiouyAEIOUY", -0.3


@dataclass(frozen=True)
class Encoding:
    """letters, and of ordinary tokens in it: q0, the chance that two places have one letter, r0, the share of neighbours of two classes, spread, the variance of that share over the binomial one, and whether vowels tell anything."""

    name: str
    pattern: str
    letters: str
    q0: float
    r0: float
    spread: float = 1.0
    vowels: bool = True

    def class_of(self, letter: str) -> int:
        if all(kind(c) < 2 for c in self.letters):
            return int(letter in VOWELS)
        return kind(letter)

    def changes(self) -> tuple[float, float]:
        """Of uniform letters: the chance that neighbours are of two classes, and that a letter differs in class from both its neighbours."""
        share: dict[int, float] = {}
        for c in self.letters:
            share[self.class_of(c)] = share.get(self.class_of(c), 0) + 1 / len(self.letters)
        return 1 - sum(q * q for q in share.values()), sum(q * (1 - q) ** 2 for q in share.values())


def kind(letter: str) -> int:
    """0 to 3: lower case, upper case, digit, sign."""
    return 0 if letter in LOWER else 1 if letter in UPPER else 2 if letter in DIGITS else 3


ENCODINGS = (
    Encoding("hex", "^[0-9a-f]+$", DIGITS + "abcdef", 0.1, 0.12, 1.2, False),
    Encoding("HEX", "^[0-9A-F]+$", DIGITS + "ABCDEF", 0.1, 0.12, 1.2, False),
    Encoding("lower", "^[a-z]+$", LOWER, 0.06, 0.6, 0.8, False),
    Encoding("upper", "^[A-Z]+$", UPPER, 0.06, 0.6, 0.8, False),
    Encoding("base32", "^[A-Z2-7]+$", UPPER + "234567", 0.058, 0.08, 1.2),
    Encoding("base36", "^[a-z0-9]+$", LOWER + DIGITS, 0.05, 0.2, 1.2),
    Encoding("BASE36", "^[A-Z0-9]+$", UPPER + DIGITS, 0.05, 0.2, 1.2),
    Encoding("letters", "^[A-Za-z]+$", UPPER + LOWER, 0.052, 0.6, 0.8, False),
    Encoding("alnum", "^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS, 0.047, 0.3),
    Encoding("base64", "^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/", 0.047, 0.3),
    Encoding("base64url", "^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_", 0.047, 0.3),
    Encoding("mixed", "", UPPER + LOWER + DIGITS + "+/_-=", 0.047, 0.3),
)
#: Letters of tokens, and in their order the class of each: lower case, upper case, digit, sign.
LETTERS = ENCODINGS[-1].letters
CLASSES = [kind(c) for c in LETTERS]
WORD, WINDOW = r"[A-Za-z0-9+/_=-]+", 32
#: Shares of the model of ordinary text: a letter after its neighbour, one of the last WINDOW again, the next of the alphabet.
AFTER, AGAIN, NEXT = 0.75, 0.2, 0.05
#: Prior shares of the four classes at a start and after each class, and letters of European languages in a thousand, a to z.
STEPS = ((0.7, 0.15, 0.12, 0.03), (0.9, 0.02, 0.03, 0.05), (0.6, 0.3, 0.05, 0.05), (0.15, 0.05, 0.7, 0.1), (0.6, 0.12, 0.2, 0.08))
COMMON = (85, 16, 34, 42, 140, 15, 20, 30, 72, 3, 7, 45, 27, 77, 65, 23, 4, 68, 70, 75, 38, 12, 12, 3, 10, 7)
SPAN = "struct<start:int,kind:int,end:int>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once for each row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def chunks(xs: Column) -> Column:
    """The array in about as many pieces as one of them has elements, so that running sums and maxima cost the root of its size an element, not its size."""
    n, root = F.size(xs), F.ceil(F.sqrt(F.size(xs))).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.ceil(n / root).cast("int") - 1), lambda i: F.slice(xs, i * root + 1, root))).otherwise(F.slice(F.array(xs), 1, 0))


def spans(text: Column, pattern: str, kind: int, hits: Column, group: Column | None = None, least: int = 0) -> Column:
    """Leftmost non-overlapping matches (hits) as (start, kind, end) in code points: the lengths of the gaps between matches and of the matches are added up. group: parts of the matches that have so many characters at least."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    sized = F.arrays_zip(F.transform(hits, F.length).alias("m"), F.transform(hits if group is None else group, F.length).alias("g"), F.slice(gaps, 1, F.size(hits)).alias("before"))
    empty = F.array().cast(f"array<{SPAN}>")

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x.before
        new = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x.m).alias("end")))
        return F.struct((start + x.m).alias("at"), F.concat(acc.out, F.when(x.g >= least, new).otherwise(empty)).alias("out"))

    def joined(cs: Column) -> Column:
        total = F.transform(cs, lambda c: F.aggregate(c, F.lit(0), lambda acc, x: acc + x.before + x.m))
        start = lambda ts, i: F.aggregate(F.slice(ts, 1, i), F.lit(0), lambda acc, x: acc + x)
        return let(total, lambda ts: F.flatten(F.transform(cs, lambda c, i: F.aggregate(c, F.struct(start(ts, i).alias("at"), empty.alias("out")), add, lambda acc: acc.out))))

    return F.when(F.size(hits) > 0, let(sized, lambda s: let(chunks(s), joined))).otherwise(empty)


def _alone(found: Column) -> Column:
    """Of spans (start, kind, end, token) the tokens (kind 3), which overlap none another, that no span of another kind overlaps either: in order of starts, spans before it end before it starts, and the next one starts after its end."""

    def reached(cs: Column) -> Column:  # the furthest end of a span of another kind before each span
        most = lambda xs: F.coalesce(F.array_max(xs), F.lit(0))
        return let(F.transform(cs, most), lambda ms: F.flatten(F.transform(cs, lambda c, i: F.transform(c, lambda _, j: F.greatest(most(F.slice(ms, 1, i)), most(F.slice(c, 1, j)))))))

    ends = lambda xs: let(F.transform(xs, lambda x: F.when(x.kind < 3, x.end).otherwise(0)), chunks)
    clear = lambda xs, far: F.filter(xs, lambda x, i: (x.kind == 3) & (F.get(far, i) <= x.start) & (F.coalesce(F.get(xs, i + 1).start, x.end) >= x.end))
    return let(F.array_sort(found), lambda xs: let(let(ends(xs), reached), lambda far: clear(xs, far)))


def normal_below(z: Column) -> Column:
    """The standard normal distribution function, by a rational approximation with an error under 1e-7."""

    def tail(t: Column, a: Column) -> Column:
        #: Coefficients of the approximation.
        poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * poly

    upper = lambda a: let(1 / (1 + 0.2316419 * a), lambda t: tail(t, a))
    return let(z, lambda z: let(let(F.abs(z), upper), lambda p: F.when(z < 0, p).otherwise(1 - p)))


def encoding_of(bare: Column) -> Column:
    """The number of the token's encoding."""
    out = F.lit(len(ENCODINGS) - 1)
    for i in range(len(ENCODINGS) - 2, -1, -1):
        out = F.when(F.regexp_like(bare, F.lit(ENCODINGS[i].pattern)), i).otherwise(out)
    return out


def _gamma_below(y: Column, mean: Column, variance: Column) -> Column:
    """P(X <= y) of a gamma variable, by the cube root's normal distribution."""
    nu = 2 * mean * mean / variance
    return normal_below((F.pow(F.greatest(y, F.lit(0.0)) / mean, F.lit(1 / 3)) - (1 - 2 / (9 * nu))) / F.sqrt(2 / (9 * nu)))


def _tables() -> Column:
    """What the tests need of each encoding, as an array of structs."""
    one = []
    for e in ENCODINGS:
        change, both = e.changes()
        codes = "".join(str(e.class_of(c)) for c in LETTERS)
        one.append(F.struct(F.lit(e.letters).alias("letters"), F.lit(codes).alias("codes"), F.lit(float(len(e.letters))).alias("k"), F.lit(change).alias("change"), F.lit(both).alias("both"), F.lit(e.q0).alias("q0"), F.lit(e.r0).alias("r0"), F.lit(e.spread).alias("spread"), F.lit(e.r0 > change).alias("turned"), F.lit(e.vowels).alias("vowels")))
    return F.array(*one)


def _battery(token: Column, of: Column) -> Column:
    """The p-value of the hypothesis that the token is ordinary text, of holds its encoding's tables; 1 if it is not random by all tests."""
    n = F.length(token).cast("double")
    summed = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    neighbours = lambda xs, f: F.zip_with(F.slice(xs, 2, F.size(xs) - 1), F.slice(xs, 1, F.size(xs) - 1), f)
    equal = F.aggregate(F.split(of.letters, ""), F.lit(0.0), lambda acc, c: acc + F.pow(n - F.length(F.replace(token, c, F.lit(""))), F.lit(2))) - n
    runs = let(F.split(F.call_function("translate", token, F.lit(LETTERS), of.codes), ""), lambda xs: summed(neighbours(xs, lambda a, b: F.when(a != b, 1.0).otherwise(0.0))))
    signs = "".join("1" if c in VOWELS else "0" for c in LETTERS)
    vowels = F.transform(F.split(F.call_function("translate", token, F.lit(LETTERS), F.lit(signs)), ""), lambda c: c.cast("double"))
    apart = let(vowels, lambda xs: let(summed(xs) / n, lambda mean: F.transform(xs, lambda x: x - mean)))
    serial = let(apart, lambda xs: summed(neighbours(xs, lambda a, b: a * b)) / F.greatest(summed(F.transform(xs, lambda x: x * x)), F.lit(1e-9)))

    def told(s: Column) -> Column:
        pairs, steps, either = n * (n - 1), n - 1, lambda p: F.least(p, 1 - p)
        uniform = either(_gamma_below(s.equal, pairs / of.k, 2 * pairs / of.k * (1 - 1 / of.k)))
        spread = F.sqrt(steps * of.change * (1 - of.change) + 2 * (n - 2) * (of.both - of.change * of.change))
        uniform = F.least(uniform, normal_below(-F.greatest((F.abs(s.runs - steps * of.change) - 0.5) / spread, F.lit(0.0))), normal_below(-F.abs(s.serial + 1 / n) * F.sqrt(n)))
        few = _gamma_below(s.equal, pairs * of.q0, 2 * pairs * (of.q0 - of.q0 * of.q0 + 2 * (n - 2) * 0.6 * of.q0 * of.q0))
        z = (s.runs - steps * of.r0) / F.sqrt(steps * of.r0 * (1 - of.r0) * of.spread)
        half = 0.5 / F.sqrt(steps * of.r0 * (1 - of.r0) * of.spread)
        changing = F.when(of.turned, normal_below(z + half)).otherwise(normal_below(half - z))
        mute = normal_below((SERIAL - s.serial) * F.sqrt(n))
        log = lambda p: -F.log(F.greatest(p, F.lit(1e-300)))
        two = lambda h: F.exp(-h) * (1 + h)
        three = lambda h: F.exp(-h) * (1 + h + h * h / 2)
        p = F.when(of.vowels, let(log(few) + log(changing) + log(mute), three)).otherwise(let(log(few) + log(changing), two))
        return F.when(uniform < UNLIKE, F.lit(1.0)).otherwise(p)

    return let(F.struct(equal.alias("equal"), runs.alias("runs"), serial.alias("serial")), told)


def randomness(token: Column, likely: list[float] | None = None) -> Column:
    """The token's p-value under its inferred encoding; padding at its end counts for none. likely: a model of ordinary text, under which a token that is likelier than random letters has 1; it makes no p-value smaller."""
    bare = F.rtrim(token, F.lit("="))
    tables = _tables()
    model = None if likely is None else F.split(F.lit(",".join(f"{x:.6g}" for x in likely)), ",").cast("array<double>")

    def of(s: Column) -> Column:
        p = _battery(s.token, s.of)
        return p if model is None else let(p, lambda p: F.when((p < ALPHA) & (_odds_of_text(s.token, s.of.k, model) > 0), F.lit(1.0)).otherwise(p))

    p = let(F.struct(bare.alias("token"), F.get(tables, encoding_of(bare)).alias("of")), of)
    return F.when(F.length(bare) < MIN_LENGTH, F.lit(1.0)).otherwise(p)


def model(counts: dict[tuple[int, int], int]) -> list[float]:
    """From counts of neighbours in words, as places in LETTERS from 1 (0: a start), the likelihood of each letter after each: of its class after the last class, half by STEPS, times that of a letter in its class, which for a-z in either case is one fifth by frequency alone."""
    kinds, pairs, single = [[0.0] * 4 for _ in range(5)], [[0.0] * 26 for _ in range(27)], [0.0] * 26
    place = lambda i: 26 if not i or CLASSES[i - 1] > 1 else ord(LETTERS[i - 1].lower()) - 97
    for (a, b), n in counts.items():
        kinds[CLASSES[a - 1] + 1 if a else 0][CLASSES[b - 1]] += n
        if CLASSES[b - 1] < 2:
            pairs[place(a)][place(b)] += n
            single[place(b)] += n
    alone = [(n + 100 * c / sum(COMMON)) / (sum(single) + 100) / 2 + c / sum(COMMON) / 2 for n, c in zip(single, COMMON, strict=True)]
    out = []
    for a in range(len(LETTERS) + 1):
        of = CLASSES[a - 1] + 1 if a else 0
        for b in range(1, len(LETTERS) + 1):
            kind, row = CLASSES[b - 1], pairs[place(a)]
            step = (kinds[of][kind] + 10 * STEPS[of][kind]) / (sum(kinds[of]) + 10) / 2 + STEPS[of][kind] / 2
            own = 1 / CLASSES.count(kind) if kind > 1 else 0.2 * alone[place(b)] + 0.8 * (row[place(b)] + 10 * alone[place(b)]) / (sum(row) + 10)
            out.append(step * own)
    return out


def ordinary(docs: DataFrame) -> list[float]:
    """The model of ordinary text from the distinct words under MIN_LENGTH of all rows of docs: at most a few thousand counts reach the driver. Words are made distinct within a row, then within a task, and only those are shuffled."""
    found = F.array_distinct(F.regexp_extract_all(F.col("text").cast("string"), F.lit(WORD), F.lit(0)))
    words = docs.select(F.explode(F.filter(found, lambda w: F.length(w) < MIN_LENGTH)).alias("word")).distinct()
    at = F.transform(F.split("word", ""), lambda c: F.instr(F.lit(LETTERS), c))
    both = words.select(at.alias("at")).select(F.explode(F.arrays_zip(F.concat(F.array(F.lit(0)), F.slice("at", 1, F.size("at") - 1)).alias("a"), F.col("at").alias("b"))).alias("x"))
    return model({(r.a, r.b): r["count"] for r in both.groupBy("x.a", "x.b").count().collect()})


def _odds_of_text(token: Column, size: Column, likely: Column) -> Column:
    """The log of the token's likelihood under the model of ordinary text over that of random letters, of which there are size."""
    at = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(LETTERS), c))

    def summed(s: Column) -> Column:
        def ratio(x: Column, i: Column) -> Column:
            last, n = F.when(i > 0, F.get(s["at"], i - 1)).otherwise(0), F.least(i, F.lit(WINDOW))
            again = (n - F.size(F.array_remove(F.slice(s["at"], i - n + 1, n), x))) / F.greatest(n, F.lit(1))
            return F.log(AFTER * F.get(s.likely, last * len(LETTERS) + x - 1) + AGAIN * again + F.when((i > 0) & (x == last + 1), NEXT).otherwise(0.0))

        return F.aggregate(F.transform(s.at, ratio), F.lit(0.0), lambda a, x: a + x)

    return let(F.struct(at.alias("at"), likely.alias("likely")), summed) + F.length(token) * F.log(size)


def _band(token: Column) -> Column:
    """The number of the encoding and band of length within which a token is controlled."""
    out, n = F.lit(0), F.length(token)
    for i, low in enumerate(BANDS[1:], 1):
        out = F.when(n >= low, F.lit(i)).otherwise(out)
    return encoding_of(F.rtrim(token, F.lit("="))) * len(BANDS) + out


def _bin(p: Column) -> Column:
    """The number of the p-value's bin; bin i holds p-values up to 10 ** (-i / PER_DECADE)."""
    return F.least(F.lit(PER_DECADE * DECADES), F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * PER_DECADE)).cast("int")


def discoveries(counts: dict[tuple[int, int], int], alpha: float = ALPHA) -> dict[int, int]:
    """Of p-values counted by (band, bin): the least bin of each band that is accepted, by Benjamini-Hochberg."""
    out = {}
    for band in {b for b, _ in counts}:
        total, below = sum(n for (b, _), n in counts.items() if b == band), 0
        for i in range(PER_DECADE * DECADES, -1, -1):
            below += counts.get((band, i), 0)
            if below and 10 ** (-i / PER_DECADE) * total <= alpha * below:
                out[band] = i
    return out


def _scanned(docs: DataFrame, keep: list[str], base: str, tokens: str, likely: list[float] | None) -> DataFrame:
    """The columns keep of docs (text, ...) with the columns base, matches of known forms, and tokens (start, kind, end, band, bin), those that overlap none; a written table."""
    kept, out, text = [F.col(f"`{c}`") for c in docs.columns], [F.col(f"`{c}`") for c in keep], "text"
    raw = [free(docs, f"__m{i}") for i in range(4)]
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    found = lambda pattern, group=0: F.regexp_extract_all(whole, F.lit(pattern), F.lit(group))
    rows = docs.select(*kept, *(found(p).alias(c) for p, c in zip((ASSIGN, ACCESS, HEX, TOKEN), raw, strict=True)))
    known = F.concat(spans(whole, ASSIGN, 0, F.col(raw[0]), found(ASSIGN, 2), 12), spans(whole, ACCESS, 1, F.col(raw[1])), spans(whole, HEX, 2, F.col(raw[2])))
    rows = rows.select(*kept, F.array_sort(known).alias(base), spans(whole, TOKEN, 3, F.col(raw[3])).alias(tokens), raw[3])
    told = lambda xs, of: F.transform(xs, lambda t, i: F.struct(t.start.alias("start"), t.kind.alias("kind"), t.end.alias("end"), of(i).alias("token")))
    both = F.concat(told(F.col(base), lambda i: F.lit(None).cast("string")), told(F.col(tokens), lambda i: F.get(F.col(raw[3]), i)))
    rows = rows.select(*out, base, F.when(F.size(tokens) > 0, _alone(both)).otherwise(F.slice(both, 1, 0)).alias(tokens))
    return written(rows.select(*out, base, F.transform(tokens, lambda t: F.struct(t.start.alias("start"), t.kind.alias("kind"), t.end.alias("end"), _band(t.token).alias("band"), _bin(randomness(t.token, likely)).alias("bin"))).alias(tokens)))


def _accepted(rows: DataFrame, tokens: str, alpha: float) -> Callable[[Column], Column]:
    """A test of tokens: whether false-discovery control over all tokens of rows accepts them."""
    one = rows.select(F.explode(tokens).alias("t")).groupBy("t.band", "t.bin").count()
    least = discoveries({(r.band, r.bin): r["count"] for r in one.collect()}, alpha)
    bounds = [F.lit(least.get(b)).cast("int") for b in range(len(BANDS) * len(ENCODINGS))]
    return lambda t: F.coalesce(F.get(F.array(*bounds), t.band) <= t.bin, F.lit(False))


def scan(docs: DataFrame, alpha: float = ALPHA, likely: list[float] | None = None) -> DataFrame:
    """(doc_id, base, random) of each row of docs (doc_id, text): arrays of (start, kind, end), kind an index of KINDS.

    base holds every match of the known forms, random the tokens that the battery adds, none of which overlaps base.
    A null text counts as empty and has no spans; texts of any length are read whole, with any number of matches. Repeated
    rows are scanned alike and count as often as they stand, and so do rows with a null doc_id; a table without rows gives
    none; other columns are ignored. likely: the model of ordinary(docs), a last filter; without it the battery alone decides.
    """
    rows = _scanned(docs.select("doc_id", "text"), ["doc_id"], "base", "tokens", likely)
    random = F.transform(F.filter("tokens", _accepted(rows, "tokens", alpha)), lambda t: F.struct(t.start.alias("start"), t.kind.alias("kind"), t.end.alias("end")))
    return rows.select("doc_id", "base", random.alias("random"))


def listed(found: Column) -> Column:
    """kind:start:end, by start and then kind, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", F.get(kinds, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def without_secrets(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """docs without the rows whose text has a secret.

    Each row is judged by its own text, whatever its doc_id, which may be null or shared; null and empty texts have no
    secrets and stay, as do repeats of rows that stay. A table without rows gives none. Columns stay as they are.
    """
    base, tokens = free(docs, "__base"), free(docs, "__tokens")
    rows = _scanned(docs, docs.columns, base, tokens, ordinary(docs))
    return rows.filter((F.size(base) == 0) & ~F.exists(tokens, _accepted(rows, tokens, alpha))).select(*(F.col(f"`{c}`") for c in docs.columns))
