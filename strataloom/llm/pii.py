"""Personal data and secrets by weak supervision: labelers vote, expectation-maximisation weighs them, a span classifier decides."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import shared_table
from ._text import buffers

KINDS = ("email", "ip", "ssn", "iban", "card", "secret", "phone")
LABELERS = ("format", "plausible", "gazetteer", "context", "border", "shape")
#: Candidate spans that the classifier is fitted on, at most: those of the least hashes.
SAMPLE = 20_000
THRESHOLD = 0.5
DIMENSIONS = 512

CANDIDATE = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+)"
    r"|(?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<card>(?<!\d)\d(?:[ -]?\d){12,18}(?!\d))"
    r"|(?P<secret>(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,})"
    r"|(?P<phone>(?<![\d.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,5}\)[ .-]?)?|\(\d{1,5}\)[ .-]?|(?=0|\d+[ .-]))\d{1,12}(?:[ .-]\d{1,12}){0,6}(?!\d))"
)
_STRICT = {
    "email": re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}"),
    "ip": re.compile(r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)"),
    "ssn": re.compile(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}"),
    "iban": re.compile(r"[A-Z]{2}\d{2}[A-Z0-9 ]{11,40}"),
    "card": re.compile(r"\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5}"),
    "secret": re.compile(r"[0-9a-f]{24,}|[0-9A-F]{24,}|(?=.*[a-z])(?=.*[A-Z])(?=.*\d)[A-Za-z0-9+/_-]{20,}|(?:sk|pk|ghp|xox[a-z]|AKIA)[A-Za-z0-9_-]{16,}"),
    "phone": re.compile(r"\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}|\+\d{8,15}|\+\d{1,3}(?:([ .-])\d{1,8}){1,6}|\(\d{2,5}\)[ .-]?\d{3,8}(?:[ .-]?\d{3,4})?|\d{3}([ .-])\d{3}\2\d{4}|0\d{2,4}([ .-])\d{5,9}|0\d(?:([ .-])\d\d){4}"),
}
_NEAR = {
    "email": {"email", "e", "mail", "contact", "kontakt", "correo", "courriel", "write", "address"},
    "ip": {"ip", "host", "server", "address", "login", "from", "client", "addr", "ping"},
    "ssn": {"ssn", "social", "security", "taxpayer"},
    "iban": {"iban", "account", "konto", "cuenta", "compte", "bank"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "debit", "karte", "carte", "tarjeta", "payment", "account"},
    "secret": {"token", "key", "secret", "password", "passwd", "api", "apikey", "bearer", "auth", "credential", "credentials", "pwd", "access"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "cell", "fax", "telefon", "handy", "telefono", "whatsapp", "sms"},
}
_FAR = {"version", "page", "pages", "section", "chapter", "figure", "fig", "table", "isbn", "issn", "doi", "release", "licensed", "price", "order", "item", "sha", "sha1", "sha256", "md5", "commit", "uuid", "checksum", "hash"}
TLDS = {"com", "org", "net", "edu", "gov", "mil", "int", "io", "info", "biz", "de", "fr", "es", "uk", "co", "eu", "us", "ch", "at", "it", "nl", "be", "ca", "au", "jp", "cn", "in", "br", "ru", "app", "dev", "ai", "me", "example", "test", "local"}
COUNTRY_CODES = {"1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "94", "98", "212", "351", "352", "353", "358", "380", "420", "971", "972"}
IBAN_COUNTRIES = set("AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in (s.count(x) for x in set(s)))


_WORD = re.compile(r"[^\W\d_]+")


def votes(kind: str, span: str, left: str, right: str) -> tuple[int, ...]:
    """1 for, -1 against, 0 no opinion, of each labeler."""
    digits = re.sub(r"\D", "", span)
    form = 1 if _STRICT[kind].fullmatch(span) else -1
    plausible = 0
    if kind == "email":
        plausible = 1 if ".." not in span and len(span) <= 254 else -1
    elif kind == "ip":
        parts = [int(x) for x in span.split(".")]
        plausible = -1 if max(parts) > 255 or parts[0] == 0 or max(parts) < 10 else 1
    elif kind == "card":
        plausible = 1 if luhn(digits) else 0
    elif kind == "iban":
        s = span.replace(" ", "")
        plausible = 1 if int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1 else -1
    elif kind == "secret":
        plausible = 1 if entropy(span) >= 3 and digits and len(digits) < len(span) else -1
    elif kind in ("phone", "ssn"):
        plausible = 1 if 9 <= len(digits) <= 15 else -1
    gaz = 0
    if kind == "email":
        gaz = 1 if span.rpartition(".")[2].lower() in TLDS else -1
    elif kind == "phone" and span[0] == "+":
        code = re.match(r"\+(\d{1,3})", span)[1]
        gaz = 1 if any(code[:n] in COUNTRY_CODES for n in (1, 2, 3)) else -1
    elif kind == "card":
        gaz = 1 if digits[0] in "3456" or digits[:2] in {"22", "23", "24", "25", "26", "27"} else 0
    elif kind == "iban":
        gaz = 1 if span[:2] in IBAN_COUNTRIES else -1
    words = [w.lower() for w in _WORD.findall(left)[-5:]]
    context = 1 if any(w in _NEAR[kind] for w in words) else -1 if any(w in _FAR for w in words[-2:]) else 0
    before, after = left[-1:], right[:1]
    border = -1 if before.isalnum() or after.isalnum() else 1
    same = max((len(m.group()) for m in re.finditer(r"(\w)\1*", span)), default=0)
    shape = -1 if same >= 6 or len(set(digits)) == 1 and len(digits) > 3 or digits in "01234567890123456789" and len(digits) > 5 else 1 if len(set(span)) >= 6 else 0
    return form, plausible, gaz, context, border, shape


def _slot(*x) -> int:
    import zlib

    return zlib.crc32("\x1f".join(map(str, x)).encode()) % DIMENSIONS


def span_features(kind: str, span: str, left: str, right: str, vote: tuple[int, ...]) -> list[int]:
    """Places of the classifier's weights that are on: the span's shape, its surroundings, and what the labelers saw, by kind."""
    mask = re.sub(r"[A-Z]+", "A", re.sub(r"[a-z]+", "a", re.sub(r"\d+", "9", span)))
    words = [w.lower() for w in _WORD.findall(left)[-2:]]
    share = sum(c.isdigit() for c in span) * 4 // len(span)
    out = {_slot("kind", kind), _slot("mask", kind, mask), _slot("length", kind, min(8, len(span) // 5)), _slot("digits", kind, share), _slot("entropy", kind, int(entropy(span)))}
    out |= {_slot("near", kind, any(w in _NEAR[kind] for w in words)), _slot("edge", kind, left[-1:].isalnum(), right[:1].isalnum())}
    return sorted(out | {_slot("vote", kind, i, v) for i, v in enumerate(vote)})


def candidates(text: str) -> Iterator[tuple[str, int, int, tuple[int, ...], list[int]]]:
    for m in CANDIDATE.finditer(text):
        kind, span, s, e = m.lastgroup, m.group(), m.start(), m.end()
        if kind == "secret" and (not any(c.isalpha() for c in span) or not any(c.isdigit() for c in span)):
            continue
        if kind == "phone" and not 7 <= sum(c.isdigit() for c in span) <= 15:
            continue
        left, right = text[max(0, s - 48) : s], text[e : e + 8]
        v = votes(kind, span, left, right)
        yield kind, s, e, v, span_features(kind, span, left, right, v)


_SCHEMA = "doc_id bigint, kind string, start_char int, end_char int, votes string, features array<short>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        mark = np.flatnonzero(((data >= 48) & (data < 58)) | (data == 64))  # every candidate has a digit or an @
        rows = np.unique(np.searchsorted(offsets, mark, "right") - 1)
        out = []
        for i in rows.tolist():
            text = bytes(data[offsets[i] : offsets[i + 1]]).decode("utf-8", "replace")
            doc = batch.column("doc_id")[i].as_py()
            out += [(doc, k, s, e, "".join("-0+"[v + 1] for v in vote), f) for k, s, e, vote, f in candidates(text)]
        cols = list(zip(*out)) if out else [[]] * 6
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int16())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [x.split()[0] for x in _SCHEMA.split(", ")])


@dataclass
class Reliability:
    """What EM found: the share of true spans by kind, and each labeler's chances of each vote on true and on false spans."""

    prior: dict[str, float]
    chance: np.ndarray  # (labeler, truth, vote + 1)

    def posterior(self, kind: str, pattern: str) -> float:
        odds = math.log(self.prior[kind] / (1 - self.prior[kind]))
        for i, v in enumerate(pattern):
            odds += math.log(self.chance[i, 1, "-0+".index(v)] / self.chance[i, 0, "-0+".index(v)])
        return 1 / (1 + math.exp(-min(50.0, max(-50.0, odds))))


def expectation_maximisation(patterns: list[tuple[str, str, int]], rounds: int = 200, strength: float = 0.03) -> Reliability:
    """Dawid and Skene's model for counts of (kind, votes).

    Counts are taken as shares of all candidates, and so is the weight of what is assumed beforehand, that a labeler is right six times in ten
    and wrong once: `strength` for either class, whatever the number of candidates. So the same mixture of patterns gives the same model at every size, and the class of
    the false spans keeps its meaning where hardly any candidate is false. A kind's share of true spans is held between 0.05 and 0.98.
    """
    n = len(LABELERS)
    base = np.zeros((n, 2, 3))
    base[:, 1] = [0.1, 0.3, 0.6]
    base[:, 0] = [0.6, 0.3, 0.1]
    model = Reliability({k: 0.5 for k in KINDS}, base / base.sum(2, keepdims=True))
    total = sum(c for *_, c in patterns)
    for _ in range(rounds if total else 0):
        chance, truth, size = base * strength, dict.fromkeys(KINDS, 0.0), dict.fromkeys(KINDS, 0.0)
        for kind, pattern, c in patterns:
            p, c = model.posterior(kind, pattern), c / total
            truth[kind] += p * c
            size[kind] += c
            for i, v in enumerate(pattern):
                chance[i, 1, "-0+".index(v)] += p * c
                chance[i, 0, "-0+".index(v)] += (1 - p) * c
        new = chance / chance.sum(2, keepdims=True)
        done = np.abs(new - model.chance).max() < 1e-7
        prior = {k: (truth[k] + strength * size[k] / 2) / (size[k] * (1 + strength)) if size[k] else 0.5 for k in KINDS}
        model = Reliability({k: min(0.98, max(0.05, p)) for k, p in prior.items()}, new)
        if done:
            break
    return model


def logistic(features: list[list[int]], target: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 400) -> np.ndarray:
    """Weights (the last is the bias) for soft targets, by accelerated gradient steps."""
    n = len(features)
    w = v = np.zeros(DIMENSIONS + 1)
    if not n:
        return w
    row = np.repeat(np.arange(n), [len(f) for f in features])
    col = np.concatenate([np.asarray(f, np.int64) for f in features])
    share = weight / weight.sum()
    step = 4.0 / (2 + max(len(f) for f in features))
    for k in range(rounds):
        z = np.bincount(row, v[col], minlength=n) + v[-1]
        g = share * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target)
        grad = ridge * v
        grad[:-1] += np.bincount(col, g[row], minlength=DIMENSIONS)
        grad[-1] += g.sum()
        new = v - step * grad
        w, v = new, new + k / (k + 3) * (new - w)
    return w


def find_pii(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, kind, start_char, end_char, probability): the spans that the classifier takes for personal data or secrets.

    Candidates are wide regular expressions over the whole texts. Six labelers (format, plausibility with check digits and entropy,
    gazetteers, context words, borders, shape) vote on each; the votes of all candidates, counted by
    kind and pattern (at most 7 x 729 rows), go to the driver, where EM estimates how reliable each labeler is. The posteriors are
    the soft labels of a logistic classifier, which is fitted on at most `sample` candidates, those of the least hash, and decides all.

    Labelers see 48 characters to the left of a span and 8 to the right, besides the whole span. doc_id must be an integer.

    A null doc_id is reported with null spans' doc_id; null and empty texts have no spans; repeated rows are each reported
    on their own; offsets count characters from 0. Overlaps don't occur: a span goes to the first kind in the order of
    KINDS that matches at its place. Empty table, or no candidates: empty. Other columns aren't looked at. No text is shuffled.
    """
    text = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = shared_table(spark, text.mapInArrow(_find, _SCHEMA), "candidates")
    counted = [(r.kind, r.votes, r.n) for r in found.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).orderBy("kind", "votes").collect()]
    model = expectation_maximisation(counted)
    order = [F.xxhash64("doc_id", "start_char", "kind"), "doc_id", "start_char", "end_char", "kind"]
    rows = found.orderBy(*order).limit(sample).select("kind", "votes", "features").collect()
    target = np.array([model.posterior(r.kind, r.votes) for r in rows])
    w = logistic([r.features for r in rows], target, np.ones(len(rows)))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column("features")
            at = f.offsets.to_numpy()
            col = f.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            z = np.bincount(np.repeat(np.arange(batch.num_rows), np.diff(at)), w[col], minlength=batch.num_rows) + w[-1]
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(p)], ["doc_id", "kind", "start_char", "end_char", "probability"]).filter(pa.array(p >= threshold))

    return found.drop("votes").mapInArrow(decide, "doc_id bigint, kind string, start_char int, end_char int, probability double")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
