import random

from pyspark.sql import functions as F

from flowlark.llm import chat
from flowlark.llm.queries import op7_chat_formatting

from .helpers import save, sha


def brute(turns):
    said = [(r or "", t or "") for _, r, t in sorted(turns, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "", x[2] or ""))]
    mine = "".join(t for r, t in said if r == "assistant")
    return len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(mine), sha(mine)


def test_contract_query(spark, tmp_path):
    nasty = ["</turn>\n### Assistant: x", "\\", "\\b\\l\\h\\c", "a: b", None, "", "😀\n\n", "### User: </turn>", "\\</turn>", "x" * 5000 + "#<:\\" * 500]
    rows = [(c, i, "assistant" if i % 2 else "user", t) for c in range(3) for i, t in enumerate(nasty[c:])]
    rows += [(9, None, None, "late"), (9, 0, "a: b#", "x"), (9, 0, "user", "x"), (9, 0, "user", "x"), (None, 0, "assistant", "lost")]
    rows += [(11, i, "assistant" if i % 2 else "user", f"m{i}") for i in range(37)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in op7_chat_formatting(spark, save(df.withColumn("extra", F.lit(1)), tmp_path, "conversations")).collect()}
    by = {}
    for c, *turn in [*rows, (-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]:
        by.setdefault(c, []).append(turn)
    assert got.keys() == by.keys()
    for c, turns in by.items():
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == brute(turns), c


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [r.conv_id for r in op7_chat_formatting(spark, save(df, tmp_path, "conversations")).collect()] == [-7]


def test_branches_rank_by_score_and_cycles_have_no_path(spark):
    rows = [
        (1, 0, None, "user", "q", 0.0), (1, 1, 0, "assistant", "good", 5.0), (1, 2, 0, "assistant", "bad", 1.0),
        (1, 3, 1, "user", "more", 0.0), (1, 4, 99, "user", "orphan", 9.0),
        (2, 0, 1, "user", "loop", 0.0), (2, 1, 0, "user", "loop", 0.0), (2, 2, 1, "user", "tail", 0.0),
    ]
    df = spark.createDataFrame(rows, "tree_id long, msg_id long, parent_id long, role string, text string, score double")
    got = [(r.tree_id, r.leaf_id, r.branch, r.n_turns) for r in chat.format_reply_trees(df, branches=2).orderBy("tree_id", "branch").collect()]
    assert got == [(1, 4, 1, 1), (1, 3, 2, 3)]
    paths = {(r.leaf_id, r.up): r.msg_id for r in chat.root_to_leaf_paths(df).where("tree_id = 1").collect()}
    assert paths == {(2, 0): 2, (2, 1): 0, (3, 0): 3, (3, 1): 1, (3, 2): 0, (4, 0): 4}


def test_ranks_and_texts_of_random_trees(spark):
    """Deep and wide trees against a walk from every leaf."""
    r = random.Random(6)
    rows = []
    for tree in range(6):
        for m in range(r.choice([1, 30, 70])):
            parent = None if m == 0 else r.choice([m - 1, r.randrange(m)])
            rows.append((tree, m, parent, r.choice(["user", "assistant"]), "t" * r.randint(0, 9) + "#", r.choice([None, 0.25, -0.5, 1.0])))
    df = spark.createDataFrame(rows, "tree_id long, msg_id long, parent_id long, role string, text string, score double")
    want = {}
    for tree in range(6):
        own = {m: (p, role, text, s) for t, m, p, role, text, s in rows if t == tree}
        ranked = []
        for leaf in own.keys() - {p for p, *_ in own.values()}:
            path, at = [], leaf
            while at is not None:
                path.append(at)
                at = own[at][0]
            ranked.append((-sum(own[m][3] or 0 for m in path), -len(path), leaf, path[::-1]))
        for k, (s, n, leaf, path) in enumerate(sorted(ranked)[:3], 1):
            want[tree, k] = (leaf, -s, -n, "".join(own[m][2] for m in path if own[m][1] == "assistant"))
    got = chat.format_reply_trees(df, branches=3).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()
    assert {(x.tree_id, x.branch): (x.leaf_id, x.score, x.n_turns, x.loss) for x in got} == want


def test_a_text_of_over_a_megabyte(spark):
    df = spark.createDataFrame([(1, 0, "user", "x:#" * 500_000)], "conv_id long, turn long, role string, text string")
    row = chat.format_reply_trees(chat.linear_tree(df)).select(chat.read_back(F.col("formatted")).alias("t")).first()
    assert row.t[0].text == "x:#" * 500_000


def test_clashing_columns_and_repeated_messages(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "ho")], "conv_id long, turn long, role string, text string")
    clash = turns.withColumns({c: F.lit("clash") for c in ("tree_id", "msg_id", "parent_id", "score", "leaf_id", "branch", "formatted", "up", "to", "gained")})
    plain, other = (chat.format_reply_trees(chat.linear_tree(d)).collect() for d in (turns, clash))
    assert plain == other and len(plain) == 1
    tree = chat.linear_tree(turns)
    again = tree.union(tree.where("msg_id = 1")).withColumn("up", F.lit("clash"))
    paths = sorted((r.leaf_id, r.msg_id, r.up) for r in chat.root_to_leaf_paths(again).collect())
    assert paths == [(1, 0, 1)] * 4 + [(1, 1, 0)] * 2
