import random

import pytest

from tessel.llm import secrets

MACHINES = secrets.trained(secrets.examples())
NAMES = [*secrets.KINDS, *MACHINES]


@pytest.mark.parametrize("before, after", [("AWS_ACCESS_KEY_ID=", ""), ("STRIPE_KEY=", ";"), ("path/to/", "/more/of/it"), ("https://x.example/?v=1&k=", "&z"), ("https://x.example/get/", ".html"), ("export_KEY_", " "), ("no1breakbefore", "")])
def test_credentials_inside_a_run(before, after):
    for kind, values in secrets.examples(40, seed=98).items():
        hits = [[(NAMES[k], s, e) for s, k, e in secrets.scan(f"{before}{v}{after}".encode(), MACHINES, NAMES)] for v in values]
        assert sum((kind, len(before)) in [(k, s) for k, s, _ in h] for h in hits) >= 34, (kind, hits[:3])
        ends = [e - s - len(v.rstrip("-")) for v, h in zip(values, hits, strict=True) for k, s, e in h if (k, s) == (kind, len(before))]
        assert all(0 <= x <= max(1, len(after)) for x in ends)


def test_two_in_a_run_and_no_digit():
    key = "ASIA" + "QWERTYUIOPASDFGH"
    text = f"A={key}/B={key}"
    assert [(NAMES[k], text[s:e]) for s, k, e in secrets.scan(text.encode(), MACHINES, NAMES)] == [("aws_key_id", key)] * 2


def test_parts_of_other_runs_are_left_alone():
    draw = random.Random(8)
    other = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz0123456789ABCDEF-_./=") for _ in range(draw.randint(15, 120))) for _ in range(2000)]
    other += ["/usr/share/doc/sk_live_mode/readme-2024.html", "internationalization/antidisestablishmentarianism", "A" * 5000, "a/" * 20000]
    assert not [x for x in other if [h for h in secrets.scan(x.encode(), MACHINES, NAMES) if h[1] > 2]]
