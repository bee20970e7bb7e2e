"""Operators that SQL can't express, against plain versions of their rules."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import brute
from tessel.llm import secrets, toxicity
from tessel.llm import text as tx
from tessel.llm.repetition import repetition


def repeats_verdict(text):
    """kept, words in maximal repeats of 6 words or more, the longest of them, and their number, by comparing all pairs of places."""
    w = brute.words(text)
    longest = brute.longest_repeats(w)
    places = [i for i, n in enumerate(longest) if n >= 6 and not (i and longest[i - 1] == n + 1)]
    share = len({j for i in places for j in range(i, i + longest[i])})
    top = max((longest[i] for i in places), default=0)
    failed = brute.repetition(text)[-1]
    return not failed and share <= 0.30 * len(w) and top <= 0.20 * len(w), share, top, len(places)


def test_verdict_on_repetition(spark):
    draw = random.Random(9)
    rows = []
    for i in range(120):
        w = [draw.choice("abcdefgh"[: 2 + i % 7]) + draw.choice(["", "x", "yy"]) for _ in range(draw.randint(0, 90))]
        for _ in range(i % 4):
            at, n = draw.randrange(len(w) + 1), draw.randint(5, 14)
            w[at:at] = w[: min(n, len(w))]
        rows.append((i, " ".join(w)))
    rows += [(500, " ".join(f"w{i}" for i in range(20000))), (501, "lorem " * 20000), (502, None)]
    got = {r["doc_id"]: r for r in repetition(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows[:120]:
        assert tuple(got[i][c] for c in ("kept", "repeat_covered", "longest_repeat", "n_maximal_repeats")) == repeats_verdict(text), i
    assert sum(r["kept"] for r in got.values()) > 10 and got[500]["kept"] and not got[501]["kept"] and got[501]["longest_repeat"] == 19999 and not got[502]["kept"]


def plain_score(text, model):
    """Noisy-or over sentences whose probability is logistic in their words and the words' beginnings."""
    none, spans, at = 1.0, [], 0
    for sentence in re.split(r"[.!?\n\r]", text or ""):
        words = re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", sentence)
        if words:
            z = model.bias
            for w in words:
                low = "".join(c.lower() if c.isascii() else c for c in w).encode()
                z += model.weights[int(tx.hashed(pa.array([low.decode()]))[0] >> np.uint64(64 - toxicity.BITS))]
                for n in toxicity.PREFIXES:
                    if len(low) > n:
                        key, _ = tx.prefixes(pa.array([low], pa.binary()), (n,))
                        z += model.weights[int(key[0] >> np.uint64(64 - toxicity.BITS))]
            p = 1 / (1 + math.exp(-z))
            none *= 1 - p
            if p >= 0.5:
                spans += [at, at + len(sentence)]
        at += len(sentence) + 1
    return 1 - none, spans


def test_scores_and_located_sentences(spark):
    draw = np.random.default_rng(1)
    model = toxicity.Model(draw.normal(0, 1, 1 << toxicity.BITS).astype(np.float32), -1.0)
    texts = ["You are fine. Internationally speaking!\nNo? É ü so-called \U0001f600 words", "", None, "...", "one", "a.b.c\r\nd", " ".join(f"word{i}." for i in range(3000))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.apply(rows, model).collect():
        score, spans = plain_score(texts[r["doc_id"]], model)
        assert r["score"] == pytest.approx(score, abs=1e-5) and r["predicted"] == (r["score"] >= 0.5) and r["offending"] == spans


def test_gradient_is_that_of_the_loss():
    draw = np.random.default_rng(3)
    doc = np.repeat(np.arange(6), [1, 2, 3, 1, 4, 2])
    some = np.array([True] * 11 + [False] * 2)
    at = np.sort(draw.integers(0, 11, 60)).astype(np.int32)
    own, y = draw.integers(0, 5, 60).astype(np.int32), np.array([0, 1, 0, 1, 1, 0.0])
    w, b, h = draw.normal(0, 0.5, 5), -0.7, 1e-6
    loss, grad = toxicity.slope(w, b, own, at, some, doc, y, 0.01)
    # The loss by its definition.
    z = [b + sum(w[f] for f, s in zip(own, at, strict=True) if s == i) for i in range(13)]
    clean = [math.prod(1 - 1 / (1 + math.exp(-z[i])) for i in range(13) if doc[i] == d and some[i]) for d in range(6)]
    assert loss == pytest.approx(-sum(math.log(1 - c if t else c) for c, t in zip(clean, y, strict=True)) / 6 + 0.005 * sum(w * w))
    for i in range(5):
        e = np.eye(5)[i] * h
        assert grad[i] == pytest.approx((toxicity.slope(w + e, b, own, at, some, doc, y, 0.01)[0] - toxicity.slope(w - e, b, own, at, some, doc, y, 0.01)[0]) / (2 * h), abs=1e-5)
    assert grad[5] == pytest.approx((toxicity.slope(w, b + h, own, at, some, doc, y, 0.01)[0] - toxicity.slope(w, b - h, own, at, some, doc, y, 0.01)[0]) / (2 * h), abs=1e-5)


def test_the_sample_is_bounded_in_rows_and_bytes(spark):
    docs = spark.createDataFrame([(i, "bad words here " * 50 if i % 2 else "good words there " * 50) for i in range(200)] + [(900, "bad " * 100000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(900, 1)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels).weights.any()
    assert toxicity.train(docs, labels, sample_bytes=0).bias == -20.0 and toxicity.train(docs, labels, sample=0).bias == -20.0
    assert toxicity.train(docs, labels, sample_bytes=100_000).weights.any()  # the large one is passed over


MACHINES = secrets.trained(secrets.examples())


def plain_parts(text, machine):
    """The best end of every start, walked one by one."""
    out = []
    for m in re.finditer(rb"[A-Za-z0-9_+/=.-]{8,}", text):
        value = m[0].strip(b".=-")
        if len(value) < 8:
            continue
        first = m.start() + m[0].index(value)
        last = first + len(value)
        for start in range(first, last):
            known = len(machine.head) >= secrets.HEAD and text.startswith(machine.head, start)
            if start > first and (text[start - 1 : start] not in (b"_", b"+", b"/", b"=", b".", b"-") and not known or text[start] not in machine.states[0][1]):
                continue
            best, state, total, strange = None, 0, 0.0, False
            for at in range(start, min(last, start + machine.longest)):
                step = machine.states[state][1].get(text[at])
                strange |= step is None and text[at] in b"/=."
                total += secrets.UNSEEN if step is None else step[0]
                state = state if step is None else step[1]
                whole, end = start == first and at + 1 == last, at + 1
                if (end == last or text[end] in b"/=.") and end - start >= machine.size and (whole or not strange):
                    over = (total + machine.states[state][0]) / (end - start + 1) - machine.least
                    if over >= 0 and (best is None or over > best[0]):
                        best = (over, start, end)
                if strange and start > first:
                    break
            if best:
                out.append(best)
    return out


def test_all_candidates_of_a_block_are_scored_as_one_by_one():
    draw = random.Random(12)
    some = [v for values in secrets.examples(6, seed=31).values() for v in values]
    glue = ["", " ", "=", "/", ".", "_", "-", "KEY=", " https://x.io/a?b=", "\n", "==", " é "]
    text = "".join(draw.choice(glue) + draw.choice([draw.choice(some), draw.choice(some)[: draw.randint(1, 30)], "plain", "0123456789abcdef" * draw.randint(0, 3)]) for _ in range(400)).encode()
    got = secrets.likely(text, MACHINES)
    for kind, machine in MACHINES.items():
        want = plain_parts(text, machine)
        own = [(s, e) for _, k, s, e in got if k == kind]
        assert own == [(s, e) for _, s, e in want] and [x[0] for x in got if x[1] == kind] == pytest.approx([o for o, _, _ in want])
    assert len(got) > 20


def test_states_are_distributions_and_learn_the_shape():
    for machine in MACHINES.values():
        for end, edges in machine.states:
            assert sum(math.exp(p) for p, _ in edges.values()) <= 1 + 1e-9 and end <= 0
    for kind, values in secrets.examples(30, seed=5).items():
        machine = MACHINES[kind]
        other = ["".join(reversed(v)) for v in values]
        assert np.mean([secrets.likelihood(machine.states, v.encode()) for v in values]) > np.mean([secrets.likelihood(machine.states, v.encode()) for v in other]) + 0.5


def test_labels_come_from_the_documents(spark):
    draw = random.Random(4)
    made = lambda n, alphabet: "".join(draw.choice(alphabet) for _ in range(n))
    values = ["zzq" + made(17, "0123456789") for _ in range(60)]
    rows = [(i, f"x token={v} y") for i, v in enumerate(values[:50])] * 2 + [(100, f"see {values[55]} here"), (101, "see zzqabc here"), (None, "secret: " + "q" * 3000), (102, None)]
    rows += [(200 + i, f"password={made(12, 'abcdefgh')}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = secrets.labels_in(docs)
    assert sorted(v for k, v in labels if v.startswith("zzq")) == sorted(values[:50]) and all(len(v) <= secrets.LONGEST_LABEL for _, v in labels)
    assert len(secrets.labels_in(docs, per_format=2)) == 20
    groups = secrets.grouped(labels)
    assert list(groups) == ["assign_zzq"] and len(groups["assign_zzq"]) == 50
    got = {r["doc_id"]: r["spans"] for r in secrets.secret_report(docs).collect()}
    assert got[100] == "assign_zzq:4:24" and got[101] == "" and got[0].startswith("assign:")


def test_added_spans_overlap_no_base_span():
    machines = MACHINES
    names = [*secrets.KINDS, *machines]
    key = secrets.examples(1, seed=77)["gitlab_token"][0]
    base = f"token={key}"
    assert [names[k] for _, k, _ in secrets.scan(base.encode(), machines, names)] == ["assign"]
    assert secrets.merged([(5, 0, 20)], [(9.0, "jwt", 0, 6), (8.0, "jwt", 20, 30), (7.0, "jwt", 25, 40)], names) == [(5, 0, 20), (20, names.index("jwt"), 30)]
    long = (f"x={key} " * 3000).encode()
    assert len(secrets.scan(long, machines, names)) == 3000
