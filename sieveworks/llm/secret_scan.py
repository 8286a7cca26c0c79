"""Secret scans with DataFrame functions alone.

Base kinds are regular expressions. The method adds spans of its own: every run of 20 or more characters of base64 or base64url that has a letter
is a candidate (a run that mixes both alphabets is split at / - and _, and an inner = ends a run), its encoding is inferred (the smallest alphabet that holds all its characters), and a battery asks
whether it looks random in that alphabet:

- chi-squared of the symbol counts against a uniform alphabet,
- the number of runs above and below the alphabet's middle,
- the lag-1 serial correlation of the symbols.

The least of the three p-values, Bonferroni-corrected, is the candidate's p. Secrets are random, so their p spreads
evenly over (0, 1); ordinary tokens pile up near 0. False-discovery control follows from that: in each class (of letters alone, or mixed with digits, by length:
short tokens are harder to tell apart) the even part is estimated from the upper half, and the smallest
threshold at which the estimated share of ordinary tokens among the accepted ones stays at or below `rate` is taken.
Small classes borrow from the others: each class's counts get `BORROWED` tokens spread as those of all classes, and these get `PRIOR` tokens, half of them even, half ordinary.
So one function of the counts serves classes of any size. The counts cover the distinct tokens of all documents, so copies are one test. Each task drops its own copies before the
shuffle by token, and cells are summed per class and bin (16 x 50).

Two narrow passes over the texts and no join; hot sources and copies meet one row a task.

Defined results: null and empty texts have no spans; an empty table gives an empty result; repeated rows are scanned each; without candidates
thresholds are those of the prior and touch nothing; tokens of digits alone are no candidates; spans of one start and kind order by their ends; very long texts and texts of many matches cost what their characters do; the
operator's output columns replace input columns of the same names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import without

#: Kind, pattern, group that must be long enough, its least length. Hex runs are maximal, so the least length can stand in the pattern.
BASE_KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]
RANDOM = "random"
#: A run that fits base64 or base64url as a whole; else its pieces between / - and _. = is padding only where nothing follows it.
_NEXT = "[A-Za-z0-9+/_-]"
TOKEN = rf"(?:(?<!{_NEXT})(?:[A-Za-z0-9+/]{{20,}}+|[A-Za-z0-9_-]{{20,}}+)(?!{_NEXT})|[A-Za-z0-9+]{{20,}}+)(?:=++(?!{_NEXT}))?"

#: Alphabets in the order in which they are tried: name, pattern, symbols in their order.
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = [
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("lower", "^[a-z]+$", _LOWER),
    ("upper", "^[A-Z]+$", _UPPER),
    ("base32", "^[A-Z2-7]+=*$", _UPPER + "234567"),
    ("base36", "^[0-9a-z]+$", _DIGITS + _LOWER),
    ("BASE36", "^[0-9A-Z]+$", _DIGITS + _UPPER),
    ("letters", "^[A-Za-z]+=*$", _UPPER + _LOWER),
    ("base58", "^[1-9A-HJ-NP-Za-km-z]+$", "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"),
    ("base62", "^[0-9A-Za-z]+=*$", _DIGITS + _UPPER + _LOWER),
    ("base64", "^[A-Za-z0-9+/]+=*$", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", "^[A-Za-z0-9_-]+=*$", _UPPER + _LOWER + _DIGITS + "-_"),
]
#: Lower ends of the length classes.
LENGTHS = [20, 24, 32, 40, 48, 64, 96, 160]
BINS = 50


def _scan(items: str, zero: str, kind: str, value: str, step: str, block: int = 256) -> str:
    """SQL of an array with `value` for each element e of an array, given c.at, which starts as zero and becomes `step` after each.

    Blocks bound what each step copies, so the work grows with the elements, not with their square.
    """
    inner = f"""aggregate(slice({items}, b + 1, {block}), struct(a.at AS at, CAST(array() AS array<{kind}>) AS out),
        (c, e) -> struct({step} AS at, concat(c.out, array({value})) AS out))"""
    return f"""aggregate(CASE WHEN size({items}) > 0 THEN sequence(0, size({items}) - 1, {block}) ELSE CAST(array() AS array<int>) END,
        struct({zero} AS at, CAST(array() AS array<array<{kind}>>) AS blocks),
        (a, b) -> element_at(transform(array({inner}), r -> struct(r.at AS at, concat(a.blocks, array(r.out)) AS blocks)), 1),
        a -> flatten(a.blocks))"""


def _spans(kind: str, rank: int, lengths: str, starts: str, keep: str) -> str:
    """Array of (start, rank, stop, kind) in code points, of the matches that `keep` takes."""
    every = f"transform({starts}, (s, i) -> struct(s AS start, {rank} AS rank, s + {lengths}[i].len AS stop, '{kind}' AS kind, i AS i))"
    return f"transform(filter({every}, x -> {keep}), x -> struct(x.start AS start, x.rank AS rank, x.stop AS stop, x.kind AS kind))"


def _battery(token: str) -> str:
    """SQL of the candidate's p; NULL for tokens that fit no alphabet."""
    case = lambda value: "CASE " + " ".join(f"WHEN t RLIKE '{pattern}' THEN {value(symbols)}" for _, pattern, symbols in ALPHABETS) + " END"
    sf = lambda z: f"(1 - 1 / (1 + exp(-(1.5976D * ({z}) + 0.07056D * pow({z}, 3)))))"  # noqa: E731  logistic form of the normal tail
    # each level names what the next one uses; transform over one element stands for LET
    let = lambda name, value, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    indices = "transform(filter(split(u, ''), c -> c != ''), c -> instr(s, c) - 1)"
    chi = "aggregate(array_distinct(x), 0D, (a, d) -> a + pow(CAST(size(filter(x, e -> e = d)) AS DOUBLE), 2)) * k / n - n"
    z_chi = "(pow(greatest(chi, 0.0001D) / (k - 1), 1 / 3D) - (1 - 2 / (9D * (k - 1)))) / sqrt(2 / (9D * (k - 1)))"
    high = "CAST(size(filter(x, e -> 2 * e >= k)) AS DOUBLE)"
    runs = "1D + size(filter(sequence(1, CAST(n AS INT) - 1), i -> (2 * x[i] >= k) != (2 * x[i - 1] >= k)))"
    z_runs = "CASE WHEN h = 0 OR h = n THEN 9D ELSE abs(r - (2 * h * (n - h) / n + 1)) / sqrt(greatest(2 * h * (n - h) * (2 * h * (n - h) - n) / (n * n * (n - 1)), 0.01D)) END"
    mean = "aggregate(x, 0D, (a, e) -> a + e) / n"
    power = "aggregate(x, 0D, (a, e) -> a + (e - m) * (e - m))"
    serial = "aggregate(sequence(1, CAST(n AS INT) - 1), 0D, (a, i) -> a + (x[i] - m) * (x[i - 1] - m))"
    z_serial = f"CASE WHEN v = 0 THEN 9D ELSE abs({serial} / v + 1 / n) * sqrt(n) END"
    p = f"least(1D, 3 * least({sf(f'greatest(zc, -6D)')}, 2 * {sf('zr')}, 2 * {sf('zs')}))"
    body = let("m", mean, let("v", power, let("zs", z_serial, let("h", high, let("r", runs, let("zr", z_runs, let("chi", chi, let("zc", z_chi, p))))))))
    body = let("x", indices, let("n", "CAST(size(x) AS DOUBLE)", f"CASE WHEN n >= 16 THEN {body} END"))
    body = let("s", case(lambda symbols: f"'{symbols}'"), let("k", "length(s)", let("u", "rtrim('=', t)", f"CASE WHEN s IS NOT NULL THEN {body} END")))
    return let("t", token, body)


def _class(t: str) -> str:
    """Letters alone (and signs) come after tokens that mix letters and digits; inside both, classes of length."""
    n = f"length({t})"
    length = "CASE " + " ".join(f"WHEN {n} >= {low} THEN {i}" for i, low in reversed(list(enumerate(LENGTHS)))) + " ELSE 0 END"
    return f"({length} + CASE WHEN {t} RLIKE '[0-9]' THEN 0 ELSE {len(LENGTHS)} END)"


def _candidates(text: Column) -> Column:
    """Candidate tokens of a text, in order; none of a text without a long run."""
    return F.when(text.rlike("[A-Za-z0-9+/_-]{20}"), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).otherwise(_none())


def _none() -> Column:
    return F.array().cast("array<string>")


def _may_match(kind: str, text: Column) -> Column:
    """False where plain substrings rule a base kind out."""
    if kind == "access":
        return text.contains("AKIA")
    low = F.lower(text)
    return reduce(Column.__or__, [low.contains(w) for w in ("passw", "secret", "token", "api")]) if kind == "assign" else F.lit(True)


#: Numbers are no secrets of this kind.
P_OF = f"transform(__tokens, t -> CASE WHEN t RLIKE '[A-Za-z]' THEN {_battery('t')} END)"
#: Tokens that each class borrows, and tokens known before any is counted.
BORROWED, PRIOR = 100.0, 100.0


def thresholds_of(counts: list[list[float]], rate: float) -> list[float]:
    """For each class the least p that is accepted (2.0 accepts none), from its counts by bin."""
    prior = [PRIOR * (0.5 / BINS + (0.5 if b == 0 else 0.0)) for b in range(BINS)]
    every = [prior[b] + sum(c[b] for c in counts) for b in range(BINS)]
    found = []
    for own in counts:
        bins = [n + BORROWED * x / sum(every) for n, x in zip(own, every, strict=True)]
        even = min(sum(bins), 2 * sum(bins[BINS // 2 :])) / BINS  # secrets expected in each bin
        best = 2.0
        for b in range(BINS - 1, -1, -1):
            accepted = sum(bins[b:])
            if max(0.0, accepted - even * (BINS - b)) / accepted <= rate:
                best = b / BINS
        found.append(best)
    return found


def thresholds(docs: DataFrame, text_col: str = "text", rate: float = 0.05) -> list[float]:
    """For each class the least p that is accepted. Counts the distinct tokens of all documents."""
    tokens = docs.select(_candidates(F.coalesce(F.col(text_col), F.lit(""))).alias("__tokens")).where("size(__tokens) > 0")
    scored = tokens.select("__tokens", F.expr(P_OF).alias("__p")).select(F.explode(F.arrays_zip("__tokens", "__p")).alias("c")).where("c.__p IS NOT NULL").select(F.col("c.__tokens").alias("token"), F.col("c.__p").alias("p")).distinct()
    cells = scored.groupBy(F.expr(_class("token")).alias("class"), F.expr(f"least({BINS - 1}, CAST(floor(p * {BINS}) AS INT))").alias("bin")).count().collect()
    count = {(r["class"], r["bin"]): float(r["count"]) for r in cells}
    return thresholds_of([[count.get((c, b), 0.0) for b in range(BINS)] for c in range(2 * len(LENGTHS))], rate)


def find_secrets(docs: DataFrame, text_col: str = "text", rate: float = 0.05) -> DataFrame:
    """docs with secrets: array of (start, rank, stop, kind), by start and then kind; rank < 3 marks base kinds."""
    least = thresholds(docs, text_col, rate)
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = len(BASE_KINDS) + 1
    own = ["secrets", "__text", "__tokens", "__p"] + [f"__{x}{i}" for x in "mgvls" for i in range(kinds)]
    out = without(docs, *own).withColumn("__text", text)
    for i, (kind, pattern, group, _) in enumerate(BASE_KINDS):
        out = out.withColumn(f"__m{i}", F.when(_may_match(kind, F.col("__text")), F.regexp_extract_all("__text", F.lit(pattern), F.lit(0))).otherwise(_none()))
        out = out.withColumn(f"__g{i}", F.when(F.size(f"__m{i}") > 0, F.split("__text", pattern, -1)))
        out = out.withColumn(f"__v{i}", F.when(F.size(f"__m{i}") > 0, F.regexp_extract_all("__text", F.lit(pattern), F.lit(group))))
    out = out.withColumn("__tokens", _candidates(F.col("__text")))
    out = out.withColumn("__g3", F.when(F.size("__tokens") > 0, F.split("__text", TOKEN, -1))).withColumn("__p", F.expr(P_OF))
    of_class = "element_at(array(" + ", ".join(f"{x}D" for x in least) + f"), 1 + {_class('__tokens[x.i]')})"
    parts = [(kind, f"__m{i}", f"length(__v{i}[x.i]) >= {n}") for i, (kind, _, _, n) in enumerate(BASE_KINDS)]
    parts.append((RANDOM, "__tokens", f"coalesce(__p[x.i] >= {of_class}, false)"))
    for i, (kind, matches, keep) in enumerate(parts):
        out = out.withColumn(f"__l{i}", F.expr(f"transform({matches}, (x, i) -> struct(length(__g{i}[i]) AS gap, length(x) AS len))"))
        out = out.withColumn(f"__s{i}", F.expr(_scan(f"__l{i}", "0", "int", "c.at + e.gap", "c.at + e.gap + e.len")))
        out = out.withColumn(f"__s{i}", F.expr(_spans(kind, i, f"__l{i}", f"__s{i}", keep)))
    out = out.withColumn("secrets", F.array_sort(F.concat(*[f"__s{i}" for i in range(kinds)])))
    return out.drop(*own[1:])


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", rate: float = 0.05) -> DataFrame:
    """Puts `mark` in place of every span (overlapping ones merged); all else, columns of any name included, stays as it is."""
    rest = [c for c in docs.columns if c != text_col]
    packed = docs.select(F.struct(F.lit(0).alias("__0"), *[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(rest)]).alias("__rest"), F.col(text_col).alias("__t"))
    found = find_secrets(packed, "__t", rate)
    # the furthest stop before each span; a span that starts behind it starts a cut, which ends at the furthest stop before the next one
    out = found.withColumn("__far", F.expr(_scan("secrets", "-1", "int", "c.at", "greatest(c.at, e.stop)")))
    out = out.withColumn("__first", F.expr("filter(transform(secrets, (s, i) -> i), i -> secrets[i].start > __far[i])"))
    out = out.withColumn("__end", F.expr("array_max(transform(secrets, s -> s.stop))"))
    out = out.withColumn("__cut", F.expr("transform(__first, (f, j) -> struct(secrets[f].start AS start, CASE WHEN j + 1 < size(__first) THEN __far[__first[j + 1]] ELSE __end END AS stop))"))
    # a text is taken apart once, into what stands between the cuts
    out = out.withColumn("__letters", F.when(F.size("__cut") > 0, F.split(F.col("__t"), "")))
    pieces = f"""array_join(transform(sequence(0, size(__cut)), i -> array_join(slice(__letters, CASE WHEN i = 0 THEN 1 ELSE __cut[i - 1].stop + 1 END,
        (CASE WHEN i = size(__cut) THEN size(__letters) ELSE __cut[i].start END) - (CASE WHEN i = 0 THEN 0 ELSE __cut[i - 1].stop END)), '')), '{mark}')"""
    masked = F.when(F.size("__cut") > 0, F.expr(pieces)).otherwise(F.col("__t"))
    return out.select(*[masked.alias(c) if c == text_col else F.col(f"__rest.__c{rest.index(c)}").alias(c) for c in docs.columns])
