from planweave.llm.chat import format_preferences, neighbour_pairs


def test_null_ids_stay(spark):
    rows = [(None, 0, "user", "q"), (None, 1, "assistant", "a"), (2, 0, "user", "q"), (2, 1, "assistant", "b"), (3, 0, "user", "q"), (3, 1, "assistant", "c")]
    got = {r.pair_id: r for r in format_preferences(*neighbour_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert set(got) == {None, 2, 3} and got[None].identical and got[None].n_prompt_turns == 2
    assert not got[2].identical and "c<" in got[2].rejected
