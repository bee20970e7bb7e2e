import re

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tessel.llm import preference
from tessel.llm.line_dedup import line_dedup, without_duplicate_lines
from tessel.llm.mixing import mix
from tessel.llm.pii import find_pii, pii_report, redact


def plan(df):
    return df._jdf.queryExecution().toString()


def test_lines(docs, corpus, empty):
    found = line_dedup(docs)
    got = {r["doc_id"]: r["removed_lines"] for r in found.collect()}
    want = brute.lines(corpus)
    assert got == {i: want[i] for i, _ in corpus} and sum(map(len, got.values())) > 20
    assert not re.search("Python|Arrow|Pandas", plan(found))
    texts = {r["doc_id"]: r for r in without_duplicate_lines(docs).collect()}
    for i, text in corpus:
        assert texts[i]["text"] == (None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in want[i]))
        assert texts[i]["n_words"] == i
    assert line_dedup(empty).count() == 0 and line_dedup(docs.union(docs)).count() == 2 * len(corpus)


PRIVATE = [
    "a@b.c_d@e.f x@y.z. @ a@b",
    "1.2.3.4.5.6.7.8 256.1.1.1 00012.0.0.255 1.2.3x4.5.6.7 99999999999.1.1.1",
    "4111 1111 1111 1111, 4111-1111-1111-1111; 41111111111111111111111111 4111  1111111111111 4111111111111111- 4111111111111112",
    "+1 (743) 555-3824+1 2 call +123456789 +44 20 7946 0958. ++1 234 567 890 1",
    "é😀 a@b.co ü +1 (743) 555-3824 4111111111111111",
    "%" * 3000 + "@" + "a" * 3000,
    "1 " * 4000 + "2",
    "a@b.c " * 300,
]


def test_pii(spark, docs, corpus, empty):
    rows = [(1000 + i, t) for i, t in enumerate(PRIVATE)] + [(2000, None)]
    found = pii_report(docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string")))
    assert not re.search("Python|Arrow|Pandas", plan(found))
    for r in found.collect():
        text = dict(corpus + rows)[r["doc_id"]]
        want = brute.pii(text)
        assert r["base_sha256"] == brute.sha(",".join(want)) and r["spans"] == ",".join(want)
        assert [r[f"n_{k}"] for k in brute.PII] == [sum(x.startswith(k) for x in want) for k in brute.PII]
    assert pii_report(empty).count() == 0


def test_pii_checks_and_context(spark):
    texts = ["iban DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432", "DE88370400440532013000 part no DE89370400440532013000", "ssn 123-45-6789", "order 123-45-6789", "x@y.zz 1.2.3.4"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], texts[r["doc_id"]][s["start"] : s["end"]]) for s in r["spans"]] for r in find_pii(rows).collect()}
    assert got == {0: [("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432")], 1: [], 2: [("ssn", "123-45-6789")], 3: [], 4: [("email", "x@y.zz"), ("ip", "1.2.3.4")]}
    assert {r["doc_id"]: r["text"] for r in redact(rows).collect()}[4] == "[email] [ip]"


@pytest.mark.parametrize("skew", [False, True])
def test_mixing(spark, corpus, docs, skew):
    rows = [(i, "one" if skew and i % 3 else f"s{i % 4}" if i % 5 else None, t) for i, t in corpus] * (1 + skew)
    table = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mix(table).collect()
    assert len(got) == len(rows)
    sizes: dict = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.words(t))
    goal, taken = brute.targets(sizes), {}
    for r in got:
        assert r["size"] == len(brute.words(dict(corpus)[r["doc_id"]])) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(goal[r["source"]]) and r["taken"] <= 3 * r["size"] and (r["taken"] == 0 or r["taken"] % r["size"] == 0)
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    largest = max(r["size"] for r in got)
    assert all(abs(taken[s] - goal[s]) <= largest for s in sizes) and sum(taken.values()) <= sum(sizes.values())
    again = mix(table.repartition(5)).collect()
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, again)) == sorted(map(key, got))


def test_mixing_without_words(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, None, ""), (None, "a", " ")], "doc_id long, source string, text string")
    assert [r["taken"] for r in mix(rows).collect()] == [0, 0, 0] and mix(rows.limit(0)).count() == 0


def test_preferences(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "<|user|>yes"), (1, 0, "user", "other"), (1, 1, "assistant", "no"), (2, 0, "user", "alone"), (2, 1, "assistant", None), (None, 0, "user", "x"), (3, 0, None, "")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("prompt", F.lit("clash"))
    made = preference.preferences(table)
    assert not re.search("Python|Arrow|Pandas", plan(made))
    got = {r["conv_id"]: r for r in made.collect()}
    assert sorted(got) == [0, 1, 2, 3] and [got[i]["pair_id"] for i in range(4)] == [0, 0, 1, 1]
    r = got[0]
    assert r["n_common"] == 1 and r["prompt"] == "<|user|>\nhi<|end|>\n"
    assert r["chosen"] == "<|assistant|>\n< |user|>yes<|end|>\n" and r["rejected"] == "<|assistant|>\nno<|end|>\n"
    assert [r["chosen"][m["start"] : m["end"]] for m in r["chosen_mask"]] == ["< |user|>yes<|end|>\n"]
    assert got[1]["chosen"] == r["rejected"] and got[1]["rejected"] == r["chosen"] and got[1]["prompt"] == "<|user|>\nother<|end|>\n"
    # Conversation 3 has one turn, so 2 is rejected behind its first; 3 shares nothing with 2.
    assert got[2]["chosen"] == "<|assistant|>\n<|end|>\n" and got[2]["rejected"] == "" and got[2]["rejected_mask"] == []
    assert got[3]["n_common"] == 0 and got[3]["chosen"] == "<||>\n<|end|>\n" and got[3]["rejected"].startswith("<|user|>\nalone")
    assert preference.preference_report(table.limit(0)).count() == 0
    twice = {r["conv_id"]: r for r in preference.preferences(table.union(table)).collect()}
    assert sorted(twice) == [0, 1, 2, 3] and twice[0]["prompt"] == "<|user|>\nhi<|end|>\n" * 2


def test_one_side_is_the_beginning_of_the_other(spark):
    row = [(1, [(0, "user", "a"), (1, "assistant", "b")], [(0, "user", "a")]), (2, None, [(0, "user", "a")])]
    table = spark.createDataFrame(row, f"id long, chosen {preference.TURNS}, rejected {preference.TURNS}")
    a, b = preference.format_preferences(table).orderBy("id").collect()
    assert a["n_common"] == 1 and a["rejected"] == "" and a["rejected_mask"] == [] and b["n_common"] == 0 and b["prompt"] == ""


def test_running_sums(spark):
    from tessel.llm.native import offsets

    rows = [(list(range(n)),) for n in (0, 1, 2, 5, 17, 100)] + [(None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "x array<int>").select(offsets(F.col("x"))).collect()]
    assert got == [[sum(x[0][:i]) for i in range(len(x[0]))] for x in rows[:-1]] + [[]]


def test_long_texts_and_many_turns(spark):
    """Tens of thousands of matches, or turns, in one row: places grow by less than the square of their number."""
    text = "a@b.co 1.2.3.4 " * 20000
    r = find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert len(r["spans"]) == 40000 and r["spans"][39999]["start"] == len(text) - 8 and r["spans"][19999]["end"] == len(text) - 9
    turns = [(0, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(6000)]
    r = preference.preferences(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()[0]
    assert r["n_common"] == 3000 and len(r["chosen_mask"]) == 1500 and r["chosen"][r["chosen_mask"][-1]["start"] :] == "t5999<|end|>\n"
