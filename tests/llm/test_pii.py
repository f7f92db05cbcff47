"""Operator 1: patterns against plain regular expressions, the tagger against numeric slopes and held-out spellings."""

from __future__ import annotations

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest

from joulecorpus.llm import pii, pii_model as M, pii_rules as R

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def card(rng) -> str:
    body = "".join(rng.choice("0123456789") for _ in range(15))
    return next(body + c for c in "0123456789" if R.luhn(body + c))


def item(kind: str, rng: random.Random) -> str:
    n = lambda a, b: rng.randint(a, b)
    return {
        "email": lambda: f"{rng.choice(['ann', 'li.po', 'x_y'])}{n(0, 99)}@mail{n(0, 9)}.example.{rng.choice(['com', 'org'])}",
        "ip": lambda: ".".join(str(n(0, 255)) for _ in range(4)),
        "card": lambda: card(rng),
        "phone": lambda: f"+{n(1, 9)} ({n(100, 999)}) {n(100, 999)}-{n(1000, 9999)}",
    }[kind]()


def prose(rng, size) -> str:
    return " ".join(rng.choice(["the", "lié", "of", "then.", "und", "Ein", "version 2.0", "日本"]) for _ in range(size))


def test_emails_are_those_of_the_pattern():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice("a@.-1 %é\n") for _ in range(rng.randint(0, 25)))
        assert R.emails(text) == [m.span() for m in EMAIL.finditer(text)], text


def test_base_rules():
    text = "+1 (389) 555-5010, 1.2.3.256 1.2.3.4.5 0001.2.3.4 4111 1111-1111 1111 4111111111111112 a@b a@b.c @x.y +12 +1234567"
    got = {k: [text[a:b] for a, b in v] for k, v in R.base_spans(text).items()}
    assert got == {"email": ["a@b.c"], "ip": ["1.2.3.4", "0001.2.3.4"], "card": [], "phone": ["+1 (389) 555-5010"]}
    assert [R.base_spans(x)["card"] for x in ("4111 1111-1111 1111,", "x4111111111111111")] == [[(0, 19)], [(1, 17)]]


def test_gradient_is_the_slope(monkeypatch):
    monkeypatch.setattr(M, "HIDDEN", 3)
    rng = np.random.default_rng(0)
    tagger = M.Tagger(2)
    code = rng.integers(0, M.CLASSES, (4, 7))
    truth = np.array([M.tags(7, {"ip": [(1, 4)], "card": [(5, 7)]}), M.tags(7, {}), M.tags(7, {"email": [(0, 7)]}), M.tags(7, {"phone": [(6, 7)]})])
    _, slope = tagger.gradient(code, truth)
    for name, value in tagger.weights.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in value.shape) if name != f"{name[:2]}_in" else (code[0, rng.integers(7)], rng.integers(12))
            keep = value[at]
            loss = []
            for d in (1e-5, -1e-5):
                value[at] = keep + d
                loss.append(tagger.gradient(code, truth)[0])
            value[at] = keep
            assert np.isclose((loss[0] - loss[1]) / 2e-5, slope[name][at], rtol=1e-3, atol=1e-6), name


def test_decoding_is_the_best_path(monkeypatch):
    monkeypatch.setattr(M, "HIDDEN", 3)
    rng = np.random.default_rng(5)
    tagger = M.Tagger(1)
    for v in tagger.weights.values():
        v += rng.normal(0, 1, v.shape)
    code = rng.integers(0, M.CLASSES, (20, 4))
    score, (fixed, start) = tagger.emissions(code), M.allowed()
    move = tagger.weights["move"] + fixed
    for row, spans in enumerate(tagger.decode(code)):
        value = lambda p: sum(score[t, row, p[t]] for t in range(4)) + start[p[0]] + sum(move[a, b] for a, b in zip(p, p[1:]))
        best = max(np.ndindex(*[M.TAGS] * 4), key=value)
        assert M.tags(4, {k: [(a, b) for a, b, n, _ in spans if n == k] for k in R.KINDS}).tolist() == list(best)


def test_reconciliation_is_the_heaviest_choice():
    rng = random.Random(3)
    for _ in range(200):
        found = [(a := rng.randint(0, 30), a + rng.randint(1, 9), rng.choice(R.KINDS), rng.uniform(0.1, 5)) for _ in range(rng.randint(0, 9))]
        taken = [(8, 11), (20, 21)]
        free = [f for f in found if not any(f[0] < b and a < f[1] for a, b in taken)]
        ways = [c for n in range(len(free) + 1) for c in combinations(free, n) if all(x[1] <= y[0] or y[1] <= x[0] for x, y in combinations(c, 2))]
        best = max(sum(f[3] for f in c) for c in ways)
        got = R.reconciled(found, taken)
        score = {}
        for a, b, k, s in found:
            score[a, b, k] = max(s, score.get((a, b, k), 0))
        assert np.isclose(sum(score[g] for g in got), best)


@pytest.fixture(scope="module")
def tagger():
    rng = random.Random(11)
    samples = []
    for i in range(220):
        text = f"{prose(rng, 8)} {item(R.KINDS[i % 4], rng)} {prose(rng, 8)}"
        samples += [(w, s) for _, w, s in pii.labelled_windows(text, i)]
    return pii.train(samples, epochs=10)


def test_held_out_spellings(tagger):
    rng = random.Random(77)
    hits, total, wrong = 0, 0, 0
    for i in range(160):
        kind = R.KINDS[i % 4]
        lead = prose(rng, rng.randint(1, 40)) + " "
        body = pii.respelled(kind, item(kind, rng), rng)
        text = f"{lead}{body} {prose(rng, rng.randint(1, 40))}"
        span = (len(lead), len(lead) + len(body))
        if not R.accepted(kind, text, *span) or any(R.base_spans(text).values()):
            continue
        total += 1
        (found,) = pii.model_spans([text], tagger)
        got = R.reconciled(found, [])
        hits += (*span, kind) in got
        wrong += len([g for g in got if g != (*span, kind)])
    assert total > 60 and hits / total > 0.8 and wrong / total < 0.1, (hits, wrong, total)


def test_clean_texts_stay_clean(tagger):
    rng = random.Random(5)
    texts = [prose(rng, 60) + " " + pii.plain_numbers("", rng) for _ in range(300)]
    assert sum(map(len, pii.model_spans(texts, tagger))) <= 3


def test_windows_cover_every_trigger():
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghij klm" * 9 + "7@") for _ in range(5000))
    starts = pii.window_starts(text)
    assert starts == sorted(set(starts))
    for m in R.TRIGGER.finditer(text):
        for size in range(1, pii.OVERLAP + 1):  # any span around it lies whole in some window
            a = max(0, m.start() - size // 2)
            assert any(s <= a and a + size <= s + pii.WIDTH for s in starts) or a + size > len(text)


def test_query_digest(spark, tagger):
    rows = [
        (1, "mail ann1@mail.example.com or 10.0.0.1, 10.0.0.2", "x", 1), (2, None, None, None), (3, "", "s", 1), (None, "é +1 (389) 555-5010", None, 0),
        (4, "x " * 60000 + "a@b.cd", None, 1), (4, "x " * 60000 + "a@b.cd", None, 1), (5, "plain text. version 2.0", None, 1),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, spans string, base int").repartition(2)
    got = {(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in pii.digest(pii.find_pii(df, tagger)).collect()}
    want = set()
    for i, t, *_ in rows:
        base = R.base_spans(t or "")
        want.add((i, *(len(base[k]) for k in R.KINDS), hashlib.sha256(R.joined(base).encode()).hexdigest(), R.joined(base)))
    assert got == want
    assert pii.find_pii(df.limit(0), None).collect() == []


def test_training_sample_is_the_same_for_any_partitioning(spark):
    rng = random.Random(4)
    rows = [(i, f"{prose(rng, 10)} {item(R.KINDS[i % 4], rng)} {prose(rng, 5)}") for i in range(40)] + [(None, None), (50, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    one, two = (pii.fit(d) for d in (df.repartition(2), df.repartition(7)))
    assert all(np.array_equal(one.weights[k], two.weights[k]) for k in one.weights)
    assert pii.fit(df.limit(0)) is None
