"""Secret scans: plain rules, and probabilistic automata inferred from labelled credentials.

Grammar inference: the labelled credentials of a format form a prefix tree with counts. States are visited from the root;
each is merged into the latest accepted state with which it is statistically compatible, in its ends and in all its
continuations, by Hoeffding's bound (state merging of the ALERGIA family), or else accepted itself. Rarely seen states are
compatible with nearly all, so the latest comes first: a random part folds into its own start, not into the root. Long random
parts fold into few states, fixed prefixes stay as they are.

Labels are what the plain rules confirm in the documents themselves, grouped by kind and by beginnings that many share, and the shapes of publicly
documented formats. Candidates are all runs of LEAST_RUN credential characters or more, and their parts. Automata are compiled to arrays, and the
candidates of a block take their steps through one together; the mean log-likelihood of a character decides, and those as likely as labelled ones are returned.

The scan is one narrow pass, after one that gathers the labels; the automata are of fixed size, as they are trained on at most ``per_format`` credentials each.
"""

from __future__ import annotations

import bisect
import math
import os
import random
import re
import string
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tessel.llm.shared import append, id_and_text, tune
from tessel.llm.text import blocks, raw

#: The base rules.
ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

#: Characters of a run; a part of one may start behind one of _+/=.-, or where an automaton knows the characters, and end before one of /=.
RUN = rb"[A-Za-z0-9_+/=.-]"
#: Characters that a known beginning has at least, and how many times as long as the longest label a part can be.
HEAD, LONGEST = 3, 4
#: Characters of a candidate at least, and of a label at most; labels of a format at most, and of a group that is one by itself at least.
LEAST_RUN, LONGEST_LABEL, PER_FORMAT, LEAST_GROUP, ALPHA = 8, 256, 80, 20, 0.05
_ALNUM, _URL = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "-_"

#: Publicly documented shapes of credentials, as parts (alphabet, length) or literal texts.
FORMATS = {
    "aws_key_id": [("ASIA",), (string.ascii_uppercase + "234567", 16)],
    "github_token": [("ghp_",), (_ALNUM, 36)],
    "gitlab_token": [("glpat-",), (_URL, 20)],
    "slack_token": [("xoxb-",), (string.digits, 12), ("-",), (string.digits, 12), ("-",), (_ALNUM, 24)],
    "stripe_key": [("sk_live_",), (_ALNUM, 24)],
    "google_key": [("AIza",), (_URL, 35)],
    "jwt": [("eyJ",), (_URL, 33), (".eyJ",), (_URL, 40), (".",), (_URL, 43)],
}


def examples(n: int = PER_FORMAT, seed: int = 7) -> dict[str, list[str]]:
    """Labelled credentials, none of them real: drawn from the documented shapes."""
    draw = random.Random(seed)
    one = lambda part: part[0] if len(part) == 1 else "".join(draw.choice(part[0]) for _ in range(part[1]))
    return {kind: ["".join(map(one, parts)) for _ in range(n)] for kind, parts in FORMATS.items()}


class Tree:
    """A prefix tree with counts: of visits and ends by state, and of passes by state and character."""

    def __init__(self, samples: list[str]) -> None:
        self.seen, self.ends = [0], [0]
        self.next: list[dict[str, int]] = [{}]
        self.flow: list[dict[str, int]] = [{}]
        for text in samples:
            at = 0
            for c in text:
                self.seen[at] += 1
                self.flow[at][c] = self.flow[at].get(c, 0) + 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.seen)
                    self.seen.append(0)
                    self.ends.append(0)
                    self.next.append({})
                    self.flow.append({})
                at = self.next[at][c]
            self.seen[at] += 1
            self.ends[at] += 1

    def compatible(self, a: int, b: int, bound: float) -> bool:
        """Ends and continuations differ by no more than chance, from here on downwards."""
        todo, done = [(a, b)], set()
        while todo:
            a, b = todo.pop()
            if a == b or (a, b) in done:
                continue
            done.add((a, b))
            n, m = self.seen[a], self.seen[b]
            most = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ends[a] / n - self.ends[b] / m) > most:
                return False
            for c in self.flow[a].keys() | self.flow[b].keys():
                if abs(self.flow[a].get(c, 0) / n - self.flow[b].get(c, 0) / m) > most:
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def fold(self, into: int, state: int) -> None:
        """Add the (still tree-shaped) branch at state to another state."""
        todo = [(into, state)]
        while todo:
            into, state = todo.pop()
            self.seen[into] += self.seen[state]
            self.ends[into] += self.ends[state]
            for c, to in self.next[state].items():
                self.flow[into][c] = self.flow[into].get(c, 0) + self.flow[state][c]
                if c in self.next[into]:
                    todo.append((self.next[into][c], to))
                else:
                    self.next[into][c] = to


def infer(samples: list[str], alpha: float = ALPHA) -> list[tuple[float, dict[int, tuple[float, int]]]]:
    """The automaton: for each state the log-probability to end, and by byte the log-probability and the next state."""
    tree, bound = Tree(samples), math.sqrt(0.5 * math.log(2 / alpha))
    accepted = [0]
    while True:
        edge = next(((a, c) for a in accepted for c in sorted(tree.next[a]) if tree.next[a][c] not in accepted), None)
        if edge is None:
            break
        state = tree.next[edge[0]][edge[1]]
        match = next((a for a in reversed(accepted) if tree.compatible(a, state, bound)), None)
        if match is None:
            accepted.append(state)
        else:
            tree.next[edge[0]][edge[1]] = match
            tree.fold(match, state)
    number = {state: i for i, state in enumerate(accepted)}
    return [(math.log((tree.ends[x] + 0.5) / (tree.seen[x] + 1)), {ord(c): (math.log(n / tree.seen[x]), number[tree.next[x][c]]) for c, n in tree.flow[x].items()}) for x in accepted]


#: Log-probability of a character that a state has not seen.
UNSEEN = math.log(1e-6)


def likelihood(machine, text: bytes) -> float:
    """Mean log-probability of a character (and the end); a character unseen where it stands keeps the state and costs UNSEEN."""
    state, total = 0, 0.0
    for c in text:
        step = machine[state][1].get(c)
        if step is None:
            total += UNSEEN
        else:
            total += step[0]
            state = step[1]
    return (total + machine[state][0]) / (len(text) + 1)


class Machine(NamedTuple):
    """A format: its automaton, the least likelihood to accept, the least and greatest length, what it begins with, and the automaton as arrays."""

    states: list
    least: float
    size: int
    longest: int
    head: bytes
    step: np.ndarray  # state x byte: the next state, the same one if the byte is unseen
    cost: np.ndarray  # state x byte: the log-probability
    seen: np.ndarray  # state x byte: whether it was seen there
    end: np.ndarray  # state: the log-probability to end


def compiled(states: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(states)
    step, cost, seen = np.repeat(np.arange(n, dtype=np.int32)[:, None], 256, axis=1), np.full((n, 256), UNSEEN), np.zeros((n, 256), bool)
    for i, (_, edges) in enumerate(states):
        for c, (p, to) in edges.items():
            step[i, c], cost[i, c], seen[i, c] = to, p, True
    return step, cost, seen, np.array([e for e, _ in states])


def walk(machine: Machine, data: np.ndarray, start: np.ndarray, first: np.ndarray, last: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each start the best end and by how much its likelihood is above the least to accept (negative: none); all starts step together.

    first and last are the ends of the start's run, stops marks the places where a part may end. A part goes over no stop that the automaton doesn't know where it stands;
    the whole run may, at the cost of UNSEEN. What is longer than ``longest`` is no credential of the format.
    """
    n = len(start)
    best, over = np.zeros(n, np.int64), np.full(n, -1.0)
    live, at = np.arange(n), start.copy()
    whole = start == first
    live = live[whole | machine.seen[0, data[start]]]
    state, total, strange = np.zeros(n, np.int32), np.zeros(n), np.zeros(n, bool)
    while len(live):
        c = data[at[live]]
        now = state[live]
        known = machine.seen[now, c]
        total[live] += machine.cost[now, c]
        state[live] = machine.step[now, c]
        strange[live] |= ~known & _STOPS[c]
        at[live] += 1
        length = at[live] - start[live]
        done = at[live] == last[live]
        ends = (done | stops[np.minimum(at[live], len(stops) - 1)]) & (length >= machine.size) & (~strange[live] | (whole[live] & done))
        some = live[ends]
        if len(some):
            score = (total[some] + machine.end[state[some]]) / (at[some] - start[some] + 1) - machine.least
            better = (score >= 0) & (score > over[some])
            over[some[better]], best[some[better]] = score[better], at[some[better]]
        live = live[~done & (length < machine.longest) & (whole[live] | ~strange[live])]
    return best, over


_STOPS = np.zeros(256, bool)
_STOPS[list(b"/=.")] = True
_RUN = np.zeros(257, bool)
_RUN[[i for i in range(256) if re.fullmatch(RUN, bytes([i]))]] = True
_BREAK = np.zeros(256, bool)
_BREAK[list(b"_+/=.-")] = True


def hashed_first(values: list[str], n: int) -> list[str]:
    """At most n of the values, by a hash of each."""
    return values if len(values) <= n else sorted(sorted(values, key=lambda v: (xxhash.xxh3_64_intdigest(v.encode()), v))[:n], key=values.index)


def trained(labelled: dict[str, list[str]], per_format: int = PER_FORMAT) -> dict[str, Machine]:
    """By format the compiled automaton. At most ``per_format`` labels of a format are used, by a hash of each; the first half trains and the second calibrates."""
    out = {}
    for kind, values in sorted(labelled.items()):
        values = hashed_first(values, per_format)
        half = max(1, len(values) // 2)
        states = infer(values[:half])
        scores = sorted(likelihood(states, v.encode()) for v in values[half:] or values)
        out[kind] = Machine(states, scores[len(scores) // 20] - 0.5, min(map(len, values)) * 3 // 4, max(map(len, values)) * LONGEST, os.path.commonprefix(values).encode(), *compiled(states))
    return out


def grouped(labels: list[tuple[str, str]], least: int = LEAST_GROUP) -> dict[str, list[str]]:
    """Labels (kind, value) by format: those of a kind that share their first HEAD characters with at least ``least`` others are one, and the rest of the kind
    is one if it has as many. Rarer ones tell too little of a format."""
    out: dict[str, list[str]] = {}
    for kind in sorted({k for k, _ in labels}):
        values = sorted({v for k, v in labels if k == kind})
        heads = Counter(v[:HEAD] for v in values)
        for head, n in sorted(heads.items()):
            if n >= least and len(heads) > 1:
                out[f"{kind}_{head}"] = [v for v in values if v[:HEAD] == head]
        rest = [v for v in values if heads[v[:HEAD]] < least or len(heads) == 1]
        if len(rest) >= least:
            out[f"{kind}_like"] = rest
    return out


def labels_in(docs: DataFrame, per_format: int = PER_FORMAT) -> list[tuple[str, str]]:
    """(kind, value) of what the plain rules confirm in the documents: distinct values of LONGEST_LABEL characters or fewer, of each kind at most 10 * ``per_format`` by a hash of the value."""

    def gather(batches):
        for block in blocks(batches):
            offsets, data = raw(block.column("text"))
            cuts = offsets.tolist()
            found = sorted({(KINDS[k], value.decode()) for i, j in zip(cuts[:-1], cuts[1:], strict=True) for k, value in values_of(data[i:j]) if len(value) <= LONGEST_LABEL})
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())], names=["kind", "value"])

    tune(docs.sparkSession)
    found = id_and_text(docs).select("text").mapInArrow(gather, "kind string, value string").distinct()
    place = F.row_number().over(W.partitionBy("kind").orderBy(F.xxhash64("value"), "value"))
    return [tuple(r) for r in found.withColumn("n", place).where(F.col("n") <= 10 * per_format).select("kind", "value").collect()]


def values_of(text: bytes) -> list[tuple[int, bytes]]:
    """(rank of the kind, credential) of confirmed base matches; of an assignment the value alone."""
    found = [(0, m[2]) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    return found + [(1, m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS] + [(2, m[0]) for m in HEX.finditer(text)]


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of confirmed base matches; matches that fail are dropped."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def candidates(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes as numbers, and the starts and ends of the runs that are candidates, without dots, equals signs and hyphens at either end."""
    numbers = np.frombuffer(data, np.uint8)
    inside = _RUN[numbers]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    first, last = edges[::2], edges[1::2]
    long = last - first >= LEAST_RUN
    first, last = first[long], last[long]
    ends = [(i + len(x) - len(x.lstrip(b".=-")), j - len(x) + len(x.rstrip(b".=-"))) for i, j in zip(first.tolist(), last.tolist(), strict=True) for x in [data[i:j]]]
    kept = np.array([x for x in ends if x[1] - x[0] >= LEAST_RUN], np.int64).reshape(-1, 2)
    return numbers, kept[:, 0], kept[:, 1]


def likely(data: bytes, machines: dict[str, Machine]) -> list[tuple[float, str, int, int]]:
    """(likelihood above the least, format, start, end) of all runs and parts of runs that a format accepts, the best end for each start."""
    numbers, first, last = candidates(data)
    if not len(first):
        return []
    run = np.repeat(np.arange(len(first)), last - first)
    place = np.concatenate([np.arange(i, j) for i, j in zip(first.tolist(), last.tolist(), strict=True)])
    stops = np.zeros(len(numbers) + 1, bool)
    stops[:-1] = _STOPS[numbers]
    begins = (place == first[run]) | _BREAK[numbers[np.maximum(place - 1, 0)]]
    out = []
    for kind, machine in machines.items():
        at = begins
        if len(machine.head) >= HEAD:
            known = np.zeros(len(numbers), bool)
            known[[m.start() for m in re.finditer(b"(?=" + re.escape(machine.head) + b")", data)]] = True
            at = begins | known[place]
        start, own = place[at], run[at]
        best, over = walk(machine, numbers, start, first[own], last[own], stops)
        out += [(float(over[i]), kind, int(start[i]), int(best[i])) for i in np.flatnonzero(over >= 0).tolist()]
    return out


def scan(text: bytes, machines: dict[str, Machine], names: list[str]) -> list[tuple[int, int, int]]:
    """Base spans and those that the automata add; an added span overlaps no base span, and of added ones that overlap the likeliest stays."""
    return merged(base_spans(text), likely(text, machines), names)


def merged(found: list[tuple[int, int, int]], more: list[tuple[float, str, int, int]], names: list[str]) -> list[tuple[int, int, int]]:
    taken: list[tuple[int, int]] = []  # apart from each other, ascending
    for s, _, e in sorted(found):
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))
    found = list(found)
    for _, kind, i, j in sorted(more, reverse=True):
        k = bisect.bisect_left(taken, (i, i))
        if (k == len(taken) or taken[k][0] >= j) and (k == 0 or taken[k - 1][1] <= i):
            taken.insert(k, (i, j))
            found.append((i, names.index(kind), j))
    return sorted(found)


def find_secrets(docs: DataFrame, labelled: dict[str, list[str]] | None = None, *, per_format: int = PER_FORMAT) -> DataFrame:
    """One row for each row of docs: doc_id and spans (kind, start, end in code points), by start, then kind.

    ``labelled`` are credentials by format; without them those that the plain rules confirm in docs are taken, and the publicly documented shapes. Null and empty texts have no
    spans; texts of any length are read whole. Repeated rows are judged each on their own (a value counts once as a label), an empty table gives an empty one, and other columns of docs, whatever their names, are not read.
    """
    machines = trained(labelled or examples() | grouped(labels_in(docs, per_format)), per_format)
    names = [*KINDS, *machines]

    def look(block: pa.RecordBatch) -> list[pa.Array]:
        offsets, data = raw(block.column("text"))
        cuts = offsets.tolist()
        # Texts are parted by a byte that is in no run, so that all of a block's candidates are scored together.
        more: list[list] = [[] for _ in cuts[1:]]
        joined = b"\x00".join(data[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True))
        begins = [c + n for n, c in enumerate(cuts[:-1])]
        for over, kind, i, j in likely(joined, machines):
            own = bisect.bisect_right(begins, i) - 1
            more[own].append((over, kind, i - begins[own], j - begins[own]))
        out = []
        for n, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            text, spans, done, chars = data[i:j], [], 0, 0
            for s, k, e in merged(base_spans(text), more[n], names):
                chars, done = chars + len(text[done:s].decode()), s  # spans come by start, so each stretch is decoded once
                spans.append({"kind": names[k], "start": chars, "end": chars + len(text[s:e].decode())})
            out.append(spans)
        return [pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))]

    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    return append(id_and_text(docs), look, [T.StructField("spans", T.ArrayType(span))]).drop("text")


def secret_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, counts of the base kinds, a digest of the base spans, and all spans as kind:start:end; see find_secrets()."""
    written = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return find_secrets(docs, **options).select("doc_id", *(count(k) for k in KINDS), F.sha2(written(F.filter("spans", lambda x: x["kind"].isin(*KINDS))), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
