r"""Secret scans: fixed base patterns, and a battery of randomness tests for anything else.

Base kinds (leftmost, non-overlapping, each kind on its own) are ``assign``, ``access`` and ``hex``.
The battery looks at runs of 20 or more credential characters; a run that mixes "+" or "/" with "-" or "_" fits no encoding and is
split at the ones and at the others; runs of digits only are numbers and not tested. Of a run with any of the four signs, the parts of 20 or more letters and digits between
them are tested as well, each as one more hypothesis: a key in a path or behind a prefix stands in such a part. For each run an encoding is inferred (hex, letters of one case,
base32 or letters and digits of either case, letters and digits, base64), and three tests ask how far it is from uniform over that alphabet: chi-squared of
classes of characters and of the number of distinct ones, runs above and below the middle of the alphabet, and serial correlation of
neighbours. Fisher's method joins the three to one distance.

A finding is a run that no ordinary name would be likely to come so near to random. The p-value of a run is the chance that an ordinary
run of its encoding and length has as small a distance, where the logarithm of the distance of ordinary runs is taken as normal with the moments
of made-up names (words of a fixed list in the usual styles, numbers, dates). Over all runs of all documents a
Benjamini-Hochberg procedure keeps the share of ordinary runs among the findings below ``rate``. Each p-value is divided by a weight first, the square root of
the run's length (of 256 at most), relative to the mean, since long runs tell more. Weighted values are rounded up to hundredths of a power of
ten, so one count per such step, some thousand at most, is all that reaches the driver. Findings are reported as kind ``random``.

Defined cases: a null text counts as empty; an empty text has no span and the digest of the empty
string; a repeated row gives a repeated result (and counts as often); an empty table gives an empty result; columns other than doc_id
and text are never read. Spans are in code points, end exclusive. Equal starts are listed as assign, access, hex, random.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from functools import lru_cache
from math import ceil, erfc, exp, gamma, log, log10, sqrt

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_batches, prepared

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_START = re.compile(r"[pP][aA][sS][sS][wW]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK]")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: Letters and digits between the signs of a run.
PURE = re.compile(r"[A-Za-z0-9]{20,}")
#: Parts of a run that mixes "+" or "/" with "-" or "_": first those between the former, then those between the latter.
PARTS = (re.compile(r"[A-Za-z0-9_-]{20,}={0,2}"), re.compile(r"[A-Za-z0-9+/]{20,}={0,2}"))
KINDS = ("assign", "access", "hex", "random")
#: Alphabets in the order in which they are tried.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base32lower": "abcdefghijklmnopqrstuvwxyz234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base36upper": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "alnum": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
SETS = {k: frozenset(v) for k, v in ALPHABETS.items()}
RANKS = {k: {c: i for i, c in enumerate(v)} for k, v in ALPHABETS.items()}
#: Classes of characters whose numbers are compared: names hold many of some and few of others.
CLASSES = ("0123456789", "aeiou", "dhlnrst", "bcfgjkmpqvwxyz", "AEIOUDHLNRST", "BCFGJKMPQVWXYZ", "+/-_")
HEX_CLASSES = ("01234", "56789", "abcABC", "defDEF")
#: Most of the findings that may be ordinary.
RATE = 0.05
#: Lengths at which ordinary runs are made up; between them moments are interpolated.
LENGTHS = (20, 24, 32, 48, 80, 160, 320)
# Words of ordinary names.
WORDS = (
    "the and for with from this that all new old last first next user name file data list item page index count total time date day week month year start end main test"
    " group order type value state status report project account service server client request response message session version update delete create change image video"
    " product customer address country city street number public private system config default option select table column string object class method result error"
    " windows library network manager document chapter section article review history summer winter music house water light world people market north south"
).split()
CONSONANTS, VOWELS = "tnsrlhdcmfpgwybvkxjqz", "eaoiu"
#: Letters come less often the later they stand.
CUMULATED = {letters: np.cumsum(1 / np.arange(2, len(letters) + 2)).tolist() for letters in (CONSONANTS, VOWELS)}
#: Encodings of one case, whose ordinary runs are long words of any language as well as names.
MIXED = ("lower", "upper", "base32", "base32lower", "base36", "base36upper")
HEX_WORDS = "dead beef cafe face feed added bad babe decade facade fade deed ace bead 00 000 0000 11 99 ff".split()


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function for whole or half a, by its recurrence."""
    if x <= 0:
        return 1.0
    q, k = (exp(-x), 1.0) if a == int(a) else (erfc(sqrt(x)), 0.5)
    term = 1.0 if k == 1.0 else None
    while k < a:
        term = x**k * exp(-x) / gamma(k + 1)
        q += term
        k += 1
    return min(1.0, q)


def encoding(run: str) -> str | None:
    own = set(run.rstrip("="))
    return next((k for k, v in SETS.items() if own <= v), None)


@lru_cache(1 << 8)
def classes(kind: str) -> tuple[dict[str, int], list[float]]:
    """The class of each character of an encoding, and the share of each class."""
    own = [c for c in (HEX_CLASSES if kind in ("hex", "HEX") else CLASSES) if SETS[kind] & set(c)]
    return {x: i for i, c in enumerate(own) for x in c if x in SETS[kind]}, [len(SETS[kind] & set(c)) / len(SETS[kind]) for c in own]


def distance(kind: str, body: str) -> float:
    """Fisher's statistic of the three tests: near 6 for random runs of any length, larger the less uniform a run is."""
    rank, size, n = RANKS[kind], len(ALPHABETS[kind]), len(body)
    values = [rank[c] for c in body]
    of, shares = classes(kind)
    counts = Counter(map(of.__getitem__, body))
    chi = sum((counts[i] - n * s) ** 2 / (n * s) for i, s in enumerate(shares))
    mean_distinct = size * (1 - (1 - 1 / size) ** n)
    spread = size * ((1 - 1 / size) ** n - (1 - 1 / size) ** (2 * n)) + 1e-9
    few = erfc(max(0.0, (mean_distinct - len(set(values)))) / sqrt(2 * max(spread, 1.0)))
    p_chi = min(1.0, 2 * min(upper_gamma((len(shares) - 1) / 2, chi / 2), few))
    middle = [2 * v >= size for v in values]
    above = sum(middle)
    below = n - above
    if not above or not below:
        p_runs = 1e-12
    else:
        runs = 1 + sum(a != b for a, b in zip(middle, middle[1:], strict=False))
        mu = 2 * above * below / n + 1
        var = (mu - 1) * (mu - 2) / (n - 1)
        p_runs = erfc(abs(runs - mu) / sqrt(2 * max(var, 0.25)))
    mean = sum(values) / n
    total = sum((v - mean) ** 2 for v in values) or 1.0
    serial = sum((a - mean) * (b - mean) for a, b in zip(values, values[1:], strict=False)) / total
    p_serial = erfc(abs(serial * n + 1) / sqrt(2 * n))
    return -2 * sum(log(max(p, 1e-12)) for p in (p_chi, p_runs, p_serial))


def syllables(dice: random.Random) -> str:
    """A made-up word of consonants and vowels by turns, as in names and in words of any language."""
    some = lambda letters, n: "".join(dice.choices(letters, cum_weights=CUMULATED[letters], k=n))
    return "".join(some(CONSONANTS, dice.choice((1, 1, 2))) + some(VOWELS, 1) + some(CONSONANTS, dice.choice((0, 0, 1))) for _ in range(dice.randrange(1, 4)))


def ordinary(kind: str, n: int, dice: random.Random) -> str:
    """A made-up ordinary run of an encoding."""
    if kind in ("hex", "HEX"):
        body = ""
        while len(body) < n:
            body += dice.choice((dice.choice(HEX_WORDS), f"20{dice.randrange(30):02}{dice.randrange(1, 13):02}{dice.randrange(1, 29):02}", str(dice.randrange(100)) * 2))
        return body[:n] if kind == "hex" else body[:n].upper()
    separator = {"base64": "/", "base64url": dice.choice("-_")}.get(kind, "")
    style = {"upper": "upper", "base32": "upper", "base36upper": "upper", "lower": "lower", "base32lower": "lower", "base36": "lower"}.get(kind) or dice.choice(("camel", "camel", "lower", "title"))
    number = lambda: dice.choice((str(dice.randrange(10)), str(dice.randrange(100)), str(dice.randrange(1990, 2030)), f"{dice.randrange(2000, 2030)}{dice.randrange(1, 13):02}"))
    if kind in ("base32", "base32lower"):
        number = lambda: dice.choice("234567") * dice.randrange(1, 3)
    elif kind in ("lower", "upper"):
        number = lambda: ""
    parts, size = [], 0
    while size < n:
        word = syllables(dice) if kind in MIXED and dice.random() < 0.5 else dice.choice(WORDS)
        if style == "upper":
            word = word.upper()
        elif style == "title" or style == "camel" and parts:
            word = word.capitalize()
        parts.append(word if dice.random() < 0.8 else number())
        size += len(parts[-1]) + len(separator)
    return separator.join(parts)[:n]


@lru_cache(32)
def moments(kind: str) -> tuple[list[float], list[float]]:
    """Mean and deviation of the logarithm of the distance of ordinary runs, at each of LENGTHS. Encodings of one case, whose lower tail is longer than a normal
    one, take the deviation that puts their lowest hundredth where it is."""
    dice = random.Random(f"ordinary {kind}")
    found = [np.log([max(1.0, distance(kind, ordinary(kind, n, dice))) for _ in range(400 if kind in MIXED else 200)]) for n in LENGTHS]
    tails = [float(x.mean() - np.quantile(x, 0.01)) / 2.326 if kind in MIXED else 0.0 for x in found]
    return [float(x.mean()) for x in found], [max(float(x.std()), tail, 0.1) for x, tail in zip(found, tails, strict=True)]


def battery(run: str) -> float | None:
    """P-value of "an ordinary run"; None if no encoding fits, or the run is short or digits only."""
    kind, body = encoding(run), run.rstrip("=")
    if kind is None or len(body) < 20 or body.isdigit():
        return None
    means, deviations = moments(kind)
    at = log(min(len(body), LENGTHS[-1]))
    places = [log(n) for n in LENGTHS]
    z = (log(max(1.0, distance(kind, body))) - np.interp(at, places, means)) / np.interp(at, places, deviations)
    return max(1e-15, 0.5 * erfc(-z / sqrt(2)))


def weight(n: int) -> float:
    return sqrt(min(256, n))


def step_of(p: float, n: int) -> int:
    """The weighted p-value of a run of length n, rounded up to hundredths of a power of ten."""
    return ceil(100 * log10(p / weight(n)))


def last_step(counts: dict[int, int], mean_weight: float, rate: float) -> int | None:
    """Benjamini-Hochberg on counts per step: the largest step whose runs are all findings."""
    total, below, last = sum(counts.values()), 0, None
    for step in sorted(counts):
        below += counts[step]
        if 10 ** (step / 100) * mean_weight * total <= rate * below:
            last = step
    return last


def tested_parts(run: re.Match) -> list[tuple[int, int]]:
    """Spans to test: the run if an encoding fits it, else its parts; and its parts of letters and digits."""
    patterns = (PURE,) if encoding(run.group()) is not None else (*PARTS, PURE)
    own = [run.span()] if len(patterns) == 1 else []
    return list(dict.fromkeys(own + [(run.start() + m.start(), run.start() + m.end()) for pattern in patterns for m in pattern.finditer(run.group())]))


def tested_runs(text: str) -> list[tuple[int, int, int]]:
    """(start, end, step) of all runs that are tested."""
    return [(s, e, step_of(p, e - s)) for m in RUN.finditer(text) for s, e in tested_parts(m) if (p := battery(text[s:e])) is not None]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Parts of both kinds that overlap are one span."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def random_runs(text: str, rate: float = RATE) -> list[tuple[int, int]]:
    """The findings of the battery in a text that stands alone."""
    found = tested_runs(text)
    if not found:
        return []
    last = last_step(Counter(x for _, _, x in found), sum(weight(e - s) for s, e, _ in found) / len(found), rate)
    return merged([(s, e) for s, e, x in found if last is not None and x <= last])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    spans = []
    if ASSIGN_START.search(text):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, spark: SparkSession | None = None, rate: float = RATE) -> DataFrame:
    """Counts per base kind, the digest of the base spans, and all spans with those of the battery."""
    spark = spark or docs.sparkSession

    def first(cols):
        out = {"doc_id": cols["doc_id"], "base": [], "starts": [], "ends": [], "steps": [], "weight": []}
        for text in cols["text"]:
            found = tested_runs(text or "")
            out["base"].append([x for s, k, e in base_spans(text or "") for x in (s, k, e)])
            for i, name in enumerate(("starts", "ends", "steps")):
                out[name].append([x[i] for x in found])
            out["weight"].append(sum(weight(e - s) for s, e, _ in found))
        return out

    schema = "doc_id bigint, base array<bigint>, starts array<bigint>, ends array<bigint>, steps array<int>, weight double"
    made = Scratch(spark, "secrets").write(map_batches(prepared(docs, "doc_id", "text"), first, schema), "runs")
    counts = {r["step"]: r["n"] for r in made.select(F.explode("steps").alias("step")).groupBy("step").agg(F.count("*").alias("n")).collect()}
    total = made.agg(F.sum("weight")).first()[0] or 0.0
    last = last_step(counts, total / max(1, sum(counts.values())), rate) if counts else None

    def second(cols):
        out = {"doc_id": cols["doc_id"], "n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "spans": [], "n_random": []}
        for flat, starts, ends, steps in zip(cols["base"], cols["starts"], cols["ends"], cols["steps"], strict=True):
            base = list(zip(flat[::3], flat[1::3], flat[2::3], strict=True))
            more = [(s, 3, e) for s, e in merged([(s, e) for s, e, x in zip(starts, ends, steps, strict=True) if last is not None and x <= last])]
            for i, name in enumerate(("n_assign", "n_access", "n_hex")):
                out[name].append(sum(k == i for _, k, _ in base))
            out["base_sha256"].append(hashlib.sha256(spans_text(base).encode()).hexdigest())
            out["spans"].append(spans_text(sorted(base + more)))
            out["n_random"].append(len(more))
        return out

    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_random bigint"
    return map_batches(made, second, schema)
