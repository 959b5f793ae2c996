from vellumist.llm import batches


def test_a_worker_keeps_the_state_of_one_operator():
    batches.keep("a")["x"] = 1
    assert batches.keep("a") == {"x": 1}
    assert batches.keep("b") == {}
    assert batches.keep("a") == {}
    batches.keep("a")["x"] = 2
    assert batches.keep() == {} and batches.keep("a") == {}
