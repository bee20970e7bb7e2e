from tessel.llm import preference


def test_every_conversation_is_chosen_once(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", "other"), (1, 1, "user", "and"), (1, 2, "assistant", "no"), (5, 0, "user", "alone"), (5, 1, "assistant", "odd"), (8, 0, "user", "even"), (None, 0, "user", "x"), (-3, 0, "user", "below")]
    got = {r["conv_id"]: r for r in preference.preferences(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert sorted(got) == [-3, 0, 1, 5, 8] and [got[i]["pair_id"] for i in (-3, 0, 1, 5, 8)] == [-2, 0, 0, 2, 4]
    one = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    # The first half of three turns is one; the partner has one more behind it.
    assert got[1]["n_common"] == 1 and got[1]["prompt"] == one("user", "other")
    assert (got[1]["chosen"], got[1]["rejected"]) == (one("user", "and") + one("assistant", "no"), one("assistant", "yes"))
    assert got[5]["chosen"] == one("assistant", "odd") and got[5]["rejected"] == "" and got[5]["rejected_mask"] == []
    assert got[0]["rejected"] == one("user", "and") + one("assistant", "no")


def test_pairs_that_part_early(spark):
    row = [(1, [(0, "user", "a"), (1, "assistant", "b"), (2, "user", "c"), (3, "assistant", "d")], [(0, "user", "a"), (1, "assistant", "x"), (2, "user", "c"), (3, "assistant", "d")])]
    (r,) = preference.format_preferences(spark.createDataFrame(row, f"id long, chosen {preference.TURNS}, rejected {preference.TURNS}")).collect()
    assert r["n_common"] == 1 and r["prompt"] == "<|user|>\na<|end|>\n"
    assert [r["rejected"][m["start"] : m["end"]] for m in r["rejected_mask"]] == ["x<|end|>\n", "d<|end|>\n"]
