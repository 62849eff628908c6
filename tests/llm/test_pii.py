"""Planted personal data is found, look-alikes are left alone; EM against known reliabilities."""

import numpy as np
import pytest

from strataloom.llm import pii

GOOD = [
    ("write to jo.doe@mail3.example.com now", "email", "jo.doe@mail3.example.com"),
    ("host 152.143.123.131###", "ip", "152.143.123.131"),
    ("call +1 (017) 555-7713 or not", "phone", "+1 (017) 555-7713"),
    ("ends 4785380592391135$$$ here", "card", "4785380592391135"),
    ('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "secret", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"),
    ("Zoë's IBAN GB82 WEST 1234 5698 7654 32 ok", "iban", "GB82 WEST 1234 5698 7654 32"),
    ("ssn 123-45-6789.", "ssn", "123-45-6789"),
]
CLEAN = ["no data here", "Licensed under CC BY-NC 4.0.", "in 1999 and 2024", "a@b", "version 1.2.3.4", "", None, "page 12 14 16"]


@pytest.fixture(scope="module")
def found(spark):
    texts = [t for t, *_ in GOOD] * 5 + CLEAN + ["x " * 200_000 + GOOD[0][0]]
    rows = [(i, t, "a") for i, t in enumerate(texts)] + [(None, GOOD[1][0], "a"), (0, GOOD[0][0], "a")]
    return texts, pii.find_pii(spark, spark.createDataFrame(rows, "doc_id bigint, text string, kind string")).collect()


def test_spans(found):
    texts, rows = found
    by = {}
    for r in rows:
        if r.doc_id is not None:
            by.setdefault(r.doc_id, []).append((r.kind, texts[r.doc_id][r.start_char : r.end_char]))
    for i in range(5 * len(GOOD)):
        _, kind, span = GOOD[i % len(GOOD)]
        assert (kind, span) in by.get(i, []), (i, kind)
    for i in range(5 * len(GOOD), 5 * len(GOOD) + len(CLEAN)):
        assert i not in by, texts[i]
    assert by[len(texts) - 1] == [("email", GOOD[0][2])]
    assert len(by[0]) == 2 and [r.kind for r in rows if r.doc_id is None] == ["ip"]


def test_empty(spark):
    assert pii.find_pii(spark, spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_expectation_maximisation_recovers_reliabilities():
    rng = np.random.default_rng(4)
    good = np.array([0.95, 0.9, 0.8, 0.7, 0.85, 0.6])
    truth = rng.random(6000) < 0.6
    counts = {}
    for t in truth:
        right = rng.random(6) < good
        pattern = "".join("+" if r == t else "-" for r in right)
        counts[pattern] = counts.get(pattern, 0) + 1
    m = pii.expectation_maximisation([("email", p, c) for p, c in sorted(counts.items())])
    assert m.prior["email"] == pytest.approx(0.6, abs=0.04)
    assert m.chance[:, 1, 2] == pytest.approx(good, abs=0.05)


def test_same_model_at_every_size():
    """Counts of patterns as in a corpus where hardly any candidate is false, a thousand times over."""
    rng = np.random.default_rng(5)
    counts = {}
    for kind, n in (("email", 300), ("card", 250), ("phone", 200), ("ip", 150), ("secret", 120)):
        for _ in range(n):
            false = rng.random() < 0.01
            chance = [0.7, 0.2, 0.1] if false else [0.03, 0.25 if kind in ("ip", "card") else 0.1, 0]
            pattern = "".join("-" if x < chance[0] else "0" if x < chance[0] + chance[1] else "+" for x in rng.random(6))
            counts[kind, pattern] = counts.get((kind, pattern), 0) + 1
    accepted = []
    for times in (1, 10, 30, 100, 1000):
        m = pii.expectation_maximisation([(k, p, c * times) for (k, p), c in sorted(counts.items())])
        accepted.append({g for g in counts if m.posterior(*g) >= 0.5})
        assert min(m.prior[k] for k in ("email", "card", "phone", "ip", "secret")) > 0.8
    assert all(a == accepted[0] for a in accepted)
    assert sum(counts[g] for g in accepted[0]) > 0.97 * sum(counts.values())


@pytest.mark.parametrize("span", ["+15551234567", "(030) 12345678", "0151 23456789", "+49 151 23456789", "+33 6 12 34 56 78", "+1 (555) 555-5657", "555-123-4567"])
def test_forms_of_phone_numbers(span):
    got = [(k, s, e, v[0]) for k, s, e, v, _ in pii.candidates(f"call {span} now")]
    assert got == [("phone", 5, 5 + len(span), 1)]
