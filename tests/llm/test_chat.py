import random

from hypothesis import given, settings
from hypothesis import strategies as st

from stockflow.llm.chat import best_paths, digests, format_conversations, format_turns, linear_trees, parse_turns, unescape

NODES = "tree long, node long, parent long, role string, text string, score double"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="a\\n\n<|im_start>", max_size=8), st.text(alphabet="a\\n\n<|im_end>", max_size=14)), max_size=4),
       st.text(max_size=20))
def test_round_trip(turns, reply):
    turns = [*turns, ("assistant", reply)]
    text, spans = format_turns(turns)
    assert parse_turns(text) == turns
    assert "".join(unescape(text[a:b]) for a, b in spans) == "".join(t for r, t in turns if r == "assistant")


def test_reply_trees_match_brute_force(spark):
    rng, rows = random.Random(1), []
    for tree in (1, 2, None):
        rows += [(tree, i, rng.randrange(max(0, i - 3), i) if i else None, "user", f"m{i}", rng.choice([0.0, 1.0, 0.5, None])) for i in range(25)]
    rows += [(3, 0, 99, "user", "orphan", 1.0), (4, 0, 1, "user", "circle", 1.0), (4, 1, 0, "user", "circle", 1.0), (4, 2, 0, "user", "hangs on it", 1.0)]
    rows += [(5, i, i - 1 if i else None, "user", "deep", 1.0) for i in range(70)]
    got = {}
    for r in best_paths(spark.createDataFrame(rows, NODES), top=3).collect():
        got.setdefault((r.tree, r["rank"]), []).append((-r.depth, r.node))
    want = {}
    for tree in (1, 2, None, 3, 5):
        nodes = {r[1]: r for r in rows if r[0] == tree}
        paths = []
        for leaf in set(nodes) - {r[2] for r in nodes.values()}:
            path = [leaf]
            while nodes[path[0]][2] in nodes:
                path.insert(0, nodes[path[0]][2])
            paths.append((-sum(nodes[n][5] or 0 for n in path) / len(path), leaf, path))
        for k, (_, _, path) in enumerate(sorted(paths)[:3]):
            want[tree, k + 1] = path
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == want


def test_odd_rows(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (1, None, "system", "first"), (None, 1, "assistant", "no id"), (2, 5, "user\n<|x", "a\\n<|b" * 5000)]
    out = digests(format_conversations(linear_trees(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()
    assert sorted(((r.tree, r.n_turns) for r in out), key=str) == [(1, 3), (2, 1), (None, 1)]
    assert {r.tree: r.loss_chars for r in out} == {1: 0, 2: 0, None: 5}
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert digests(format_conversations(linear_trees(none))).collect() == []
