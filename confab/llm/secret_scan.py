"""Secret spans: fixed patterns, plus tokens that a battery of randomness tests can't tell from noise. Native.

Positions count code points, ends are exclusive. A kind's matches are leftmost and don't overlap: what a pattern
splits a text into and what it extracts alternate, so running lengths give every start without a positional regex.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confab.llm.common import free_names, let

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The shortest group 2 of an assignment that counts; shorter ones still use up the text they match.
ASSIGN_MIN = 8
#: Runs shorter than this are no finding, and since runs are maximal the bound can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Tokens for the battery: long enough for its tests to mean something.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Inferred encodings, narrowest first: pattern and alphabet (fixed values).
ENCODINGS = (
    ("^[0-9a-f]+$", "0123456789abcdef"),
    ("^[0-9A-F]+$", "0123456789ABCDEF"),
    ("^[2-7A-Z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("^[2-7a-z]+$", "abcdefghijklmnopqrstuvwxyz234567"),
    ("^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)
#: Share of neighbouring characters of ordinary identifiers that change class (digit to letter or back, lower to upper case).
ORDINARY_CHANGES = 0.2
#: How often ordinary text has each letter, a to z (per mille).
ORDINARY_LETTERS = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)


def ordinary(alphabet: str) -> Column:
    """struct<k2, k3, even, changes> of an encoding: chances that two and three letters of ordinary text are the same (of those letters
    that the alphabet has, without regard to case) and that two drawn evenly are, and the share of class changes of even draws."""
    letters = sorted(set(filter(str.isalpha, alphabet.lower())))
    own = [ORDINARY_LETTERS[ord(c) - ord("a")] for c in letters]
    k2, k3 = (sum((w / sum(own)) ** e for w in own) for e in (2, 3))
    digit, lower, upper = (sum(map(f, alphabet)) / len(alphabet) for f in (str.isdigit, str.islower, str.isupper))
    share = 2.0 * digit * (lower + upper) + lower * upper
    return F.struct(F.lit(k2).alias("k2"), F.lit(k3).alias("k3"), F.lit(1.0 / len(letters)).alias("even"), F.lit(share).alias("changes"))


def normal_tail(z: Column) -> Column:
    """P(Z > z); the published polynomial with an error below 1e-7."""
    a = F.abs(z)
    t = 1.0 / (1.0 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2.0) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(1.0 - tail)


def scanned(values: Column, merge) -> Column:
    """Running ``merge`` (of two integers, such as their sum) of an array<int>, each value included.

    A fold that grows an array copies it at every step. So the array is cut into about as many blocks as a block has values, blocks are
    folded apart, then what precedes each block is merged in: n values cost n * sqrt(n) copies of 4 bytes.
    """
    none = F.expr("cast(array() as array<int>)")
    start = F.struct(F.lit(None).cast("int").alias("sum"), none.alias("out"))
    both = lambda a, b: F.when(a.isNull(), b).otherwise(merge(a, b))

    def step(s: Column, x: Column) -> Column:
        return let(both(s["sum"], x), lambda now: F.struct(now.alias("sum"), F.array_append(s["out"], now).alias("out")))

    def before(s: Column, x: Column) -> Column:
        return F.struct(both(s["sum"], x).alias("sum"), F.array_append(s["out"], s["sum"]).alias("out"))

    def cut(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v).cast("double"))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / size).cast("int") - 1), lambda i: F.slice(v, i * size + 1, size))
        return let(F.transform(blocks, lambda b: F.aggregate(b, start, step, lambda s: s["out"])), whole)

    def whole(inner: Column) -> Column:
        offsets = F.aggregate(inner, start, lambda s, b: before(s, F.element_at(b, -1)), lambda s: s["out"])
        return F.flatten(F.zip_with(inner, offsets, lambda b, o: F.when(o.isNull(), b).otherwise(F.transform(b, lambda x: merge(o, x)))))

    return F.when(F.size(values) == 0, none).otherwise(let(values, cut))


def spans(text: str, found: str, pattern: str, kind: int) -> Column:
    """array<struct<start, end, kind, word>> of the matches in column ``found``, which ``pattern`` extracted from ``text``."""
    none = F.expr("cast(array() as array<struct<start:int,end:int,kind:int,word:string>>)")
    gaps = F.slice(F.split(F.col(text), pattern, -1), 1, F.size(found))
    ends = scanned(F.zip_with(gaps, F.col(found), lambda g, w: F.length(g) + F.length(w)), lambda a, b: a + b)
    out = F.zip_with(ends, F.col(found), lambda e, w: F.struct((e - F.length(w)).alias("start"), e.alias("end"), F.lit(kind).alias("kind"), w.alias("word")))
    return F.when(F.size(found) == 0, none).otherwise(out)


def uncovered(some: Column, base: Column) -> Column:
    """Those of ``some`` that lie within no span of ``base``: in the order of starts, the largest end of base spans so far tells."""
    mark = lambda s, inner, end: F.struct(s["start"].alias("start"), F.lit(inner).alias("own"), end.alias("reach"), s["end"].alias("end"), s["kind"].alias("kind"), s["word"].alias("word"))
    every = F.array_sort(F.concat(F.transform(base, lambda s: mark(s, 0, s["end"])), F.transform(some, lambda s: mark(s, 1, F.lit(-1)))))

    def kept(rows: Column) -> Column:
        reach = scanned(F.transform(rows, lambda r: r["reach"]), F.greatest)
        out = F.filter(F.zip_with(rows, reach, lambda r, e: F.when((r["own"] == 1) & (r["end"] > e), r)), lambda r: r.isNotNull())
        return F.transform(out, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["kind"].alias("kind"), r["word"].alias("word")))

    return F.when((F.size(some) == 0) | (F.size(base) == 0), some).otherwise(let(every, kept))


def symbol_counts(word: Column, letters: Column) -> Column:
    """How often the word has each of the letters."""
    return F.transform(letters, lambda c: (F.length(word) - F.length(F.replace(word, c, F.lit("")))).cast("double"))


def randomness(word: Column) -> Column:
    """struct<n, changes, p, o>: the smallest p-value of the battery, times three, for a word drawn uniformly from its alphabet, and
    the p-value for a word of ordinary text.

    Chi-squared uniformity of the symbols (Wilson-Hilferty tail), runs above and below the middle of the
    alphabet (two-sided) and lag-one serial correlation of the symbols' places (two-sided).
    """
    plain = F.regexp_replace(word, "=+$", "")
    alphabet, usual = F.lit(ENCODINGS[-1][1]), ordinary(ENCODINGS[-1][1])
    for pattern, letters in reversed(ENCODINGS[:-1]):
        fits = plain.rlike(pattern)
        alphabet, usual = F.when(fits, F.lit(letters)).otherwise(alphabet), F.when(fits, ordinary(letters)).otherwise(usual)

    def battery(x: Column) -> Column:
        n, k, codes = x["n"].cast("double"), x["k"].cast("double"), x["codes"]
        squares = F.aggregate(symbol_counts(x["plain"], F.split(x["alphabet"], "")), F.lit(0.0), lambda s, c: s + c * c)
        free = k - 1.0
        chi = F.greatest(squares * k / n - n, F.lit(0.0))
        p_chi = normal_tail((F.pow(chi / free, F.lit(1.0 / 3.0)) - (1.0 - 2.0 / (9.0 * free))) / F.sqrt(2.0 / (9.0 * free)))
        pairs = F.arrays_zip(F.slice(codes, F.lit(1), x["n"] - 1).alias("a"), F.slice(codes, F.lit(2), x["n"] - 1).alias("b"))
        half = k / 2.0
        up = F.size(F.filter(codes, lambda c: c >= half)).cast("double")
        runs = 1.0 + F.size(F.filter(pairs, lambda p: (p["a"] >= half) != (p["b"] >= half))).cast("double")
        mu = 2.0 * up * (n - up) / n + 1.0
        var = (mu - 1.0) * (mu - 2.0) / (n - 1.0)
        p_runs = F.when(var > 0, 2.0 * normal_tail(F.abs(runs - mu) / F.sqrt(var))).otherwise(0.0)
        sums = lambda mean: F.struct(
            F.aggregate(codes, F.lit(0.0), lambda s, c: s + (c - mean) * (c - mean)).alias("spread"),
            F.aggregate(pairs, F.lit(0.0), lambda s, p: s + (p["a"] - mean) * (p["b"] - mean)).alias("lag"),
        )
        p_lag = let(let(F.aggregate(codes, F.lit(0.0), lambda s, c: s + c) / n, sums), lambda m: F.when(m["spread"] > 0, 2.0 * normal_tail(F.abs(m["lag"] / m["spread"] + 1.0 / n) * F.sqrt(n))).otherwise(0.0))
        return F.struct(x["n"].alias("n"), x["changes"].alias("changes"), F.least(F.lit(1.0), 3.0 * F.least(p_chi, p_runs, p_lag)).alias("p"), _ordinary(x).alias("o"))

    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "[^A-Za-z0-9]", ""), "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A")
    changes = F.regexp_count(classes, F.lit("(?<=0)[aA]|(?<=[aA])0|(?<=a)A"))
    codes = let(alphabet, lambda letters: F.transform(F.regexp_extract_all(plain, F.lit("(?s)."), F.lit(0)), lambda c: (F.call_function("instr", letters, c) - 1).cast("double")))
    letters = symbol_counts(F.lower(plain), F.split(F.lit("abcdefghijklmnopqrstuvwxyz"), ""))
    return let(F.struct(F.length(plain).alias("n"), F.length(alphabet).alias("k"), plain.alias("plain"), alphabet.alias("alphabet"), codes.alias("codes"), changes.alias("changes"), letters.alias("letters"), usual.alias("usual")), battery)


def tested(words: Column, alpha: float, rate: float) -> Column:
    """The spans of ``words`` that look drawn at random.

    Each has a p-value for ordinary text, divided by its length over the text's mean length: longer tokens carry more evidence and get more of the error budget. Benjamini and Hochberg's step-up
    rule holds the text's false discovery rate at ``rate``; what the battery rejects at ``alpha`` isn't random and goes.
    """

    # What a lambda reads is computed before it, or it would be computed for each of its values.
    def judged(all_: Column) -> Column:
        return let(F.aggregate(all_, F.lit(0.0), lambda s, x: s + x["r"]["n"]) / F.size(all_), lambda mean: let(F.transform(all_, lambda x: F.struct(x["w"].alias("w"), x["r"].alias("r"), (x["r"]["o"] * mean / x["r"]["n"]).alias("q"))), cut))

    def cut(rows: Column) -> Column:
        ranked = F.array_sort(F.transform(rows, lambda x: x["q"]))
        below = lambda size: F.filter(F.transform(ranked, lambda q, i: F.when(q <= (i + 1) * rate / size, q)), lambda q: q.isNotNull())
        limit = let(F.size(rows), lambda size: F.coalesce(F.array_max(below(size)), F.lit(-1.0)))
        return let(limit, lambda most: F.transform(F.filter(rows, lambda x: (x["q"] <= most) & (x["r"]["p"] >= alpha)), lambda x: x["w"]))

    return let(F.transform(words, lambda w: F.struct(w.alias("w"), randomness(w["word"]).alias("r"))), judged)


def _ordinary(x: Column) -> Column:
    """The p-value of a word of ordinary text: the symbol counts of chi-squared, taken over letters, and the runs of classes.

    Ordinary text repeats its frequent letters and seldom changes class. How far each count lies on the random side is measured in
    deviations; the two are added with what even draws of this length and encoding would show of each as weights.
    """
    usual, letters = x["usual"], x["letters"]
    m = F.aggregate(letters, F.lit(0.0), lambda s, c: s + c)
    same = F.aggregate(letters, F.lit(0.0), lambda s, c: s + c * c) - m
    pairs, k2, k3 = m * (m - 1.0), usual["k2"], usual["k3"]
    spread = F.sqrt(2.0 * pairs * (k2 - k2 * k2) + 4.0 * pairs * (m - 2.0) * (k3 - k2 * k2))
    told = m >= 3.0
    z_same = F.when(told, (pairs * k2 - same - 1.0) / spread).otherwise(0.0)
    w_same = F.when(told, F.greatest(pairs * (k2 - usual["even"]) / spread, F.lit(0.0))).otherwise(0.0)
    steps = F.greatest(x["n"] - 1, F.lit(1)).cast("double")
    sd = F.sqrt(steps * ORDINARY_CHANGES * (1.0 - ORDINARY_CHANGES))
    z_changes = (x["changes"] - 0.5 - steps * ORDINARY_CHANGES) / sd
    w_changes = F.greatest(steps * (usual["changes"] - ORDINARY_CHANGES) / sd, F.lit(0.0))
    weight = F.sqrt(w_same * w_same + w_changes * w_changes)
    return F.when(weight > 0, normal_tail((z_same * w_same + z_changes * w_changes) / weight)).otherwise(1.0)


def find_secrets(docs: DataFrame, text: str = "text", alpha: float = 0.001, rate: float = 0.01) -> DataFrame:
    """``docs`` with ``secrets``: array<struct<start, end, kind, word>> by start, then kind (an index of KINDS).

    Null and empty texts have none. Every text is read whole; nothing is shuffled, so hot sources and copies cost
    what their rows cost. The battery's finds that lie within a fixed pattern's span aren't repeated. A column named
    secrets is replaced; others ride along.
    """
    found_, new_, body, *kinds = free_names(docs, "_base", "_new", "_body", *(f"_{k}" for k in KINDS))
    names = {"text": body, **dict(zip(KINDS, kinds, strict=True))}
    patterns = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, CANDIDATE), strict=True))
    rows = docs.drop("secrets").withColumn(names["text"], F.coalesce(F.col(text), F.lit("")))
    rows = rows.withColumns({names[k]: F.regexp_extract_all(F.col(names["text"]), F.lit(p), F.lit(0)) for k, p in patterns.items()})
    rows = rows.withColumns({names[k]: spans(names["text"], names[k], p, i) for i, (k, p) in enumerate(patterns.items())})
    long = F.filter(names["assign"], lambda s: F.length(F.regexp_extract(s["word"], f"^{ASSIGN}$", 2)) >= ASSIGN_MIN)
    rows = rows.withColumn(found_, F.concat(long, F.col(names["access"]), F.col(names["hex"])))
    rows = rows.withColumn(new_, uncovered(F.col(names["random"]), F.col(found_)))
    found = F.when(F.size(new_) == 0, F.col(found_)).otherwise(F.concat(F.col(found_), tested(F.col(new_), alpha, rate)))
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["word"].alias("word"))))
    return rows.withColumn("secrets", ordered).drop(*names.values(), found_, new_)


def told(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the fixed kinds, the digest of their spans, and all spans."""
    found = find_secrets(docs.select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"] < 3)
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind))
    counts = [of(k).cast("bigint").alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("secrets")).alias("spans"))
