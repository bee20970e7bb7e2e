"""Line deduplication against a plain version that takes the shingles of every position and compares every pair."""

import random
from collections import defaultdict

from tests.llm import brute
from tessel.llm.line_dedup import WIDTH, line_dedup


def shingles(line):
    low = line.lower()
    return {low[i : i + WIDTH] for i in range(len(low))}


def plain(rows, percent=75):
    found = [(i, n, x) for i, t in sorted(rows) for n, x in enumerate(t.split("\n")) if brute.WORD.search(x)]
    ids = {x: k for k, x in enumerate(dict.fromkeys(x for _, _, x in found))}
    part = brute.components({k: shingles(x) for x, k in ids.items()}, percent)
    seen, gone = set(), defaultdict(list)
    for i, n, x in found:
        if part[ids[x]] in seen:
            gone[i].append(n)
        seen.add(part[ids[x]])
    return gone


def removed(spark, rows):
    return {r["doc_id"]: r["removed_lines"] for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_every_character_of_a_line_counts(spark, corpus):
    draw = random.Random(3)
    long = "".join(draw.choice("abcdefghij0123456789") for _ in range(400))
    han = "".join(chr(0x4E00 + i) for i in range(120))
    lines = ["https://example.com/article/1842", "https://example.com/other/77-totally-different", "configuration_alpha=1", "configuration_omega=2"]
    lines += [long, long[:200] + "#" + long[201:], long[:12] + long[:11:-1], han, han + "\u65e5"]
    rows = [(1000 + i, x) for i, x in enumerate(lines)] + [(i, t) for i, t in corpus if t is not None]
    want, got = plain(rows), removed(spark, rows)
    assert got == {i: want[i] for i, _ in rows}
    assert [i for i, _ in rows if i >= 1000 and got[i]] == [1005, 1008]


def test_pairs_behind_foreign_hubs_are_found(spark):
    """All lines open with one passage, so buckets are led by lines that are similar to neither of a pair."""
    draw = random.Random(11)
    some = lambda n: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    head = some(88)
    lines = [head + some(32) for _ in range(1500)]
    for x in lines[:300]:
        lines.append(x[:100] + "#" + x[101:104] + "#" + x[105:])
    assert 0.75 <= len(shingles(lines[0]) & shingles(lines[1500])) / len(shingles(lines[0]) | shingles(lines[1500])) < 0.8
    assert len(shingles(lines[0]) & shingles(lines[1])) / len(shingles(lines[0]) | shingles(lines[1])) < 0.5
    got = removed(spark, list(enumerate(lines)))
    found = {i for i in got if got[i]}
    # A pair of this similarity shares no bucket with a probability of 1 or 2 in 10,000; all that share one are found.
    assert found <= set(range(1500, 1800)) and len(found) >= 299
