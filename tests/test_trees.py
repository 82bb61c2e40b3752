from __future__ import annotations

import json
import random
import re

from pyspark.sql import functions as F

from tidewright.operators.chunking import sections, split_sections, text_spans
from tidewright.operators.trees import BLOCKS, flatten_blocks, flatten_trees


def plain(node):
    if isinstance(node, str):
        return node
    if isinstance(node, list):
        return "".join(map(plain, node))
    if not isinstance(node, dict):
        return ""
    if node.get("type") == "text":
        return node.get("text") or ""
    if node.get("type") == "hardBreak":
        return "\n"
    return plain(node.get("content")) + ("\n" if node.get("type") in BLOCKS else "")


def tree(rng, depth):
    kind = rng.choice(["text", "text", "hardBreak", *BLOCKS, "doc", "odd"])
    if kind == "text":
        return {"type": "text", "text": rng.choice(["a", "b c", "", None, 'q"\n'])}
    if kind == "hardBreak":
        return {"type": kind}
    inner = [tree(rng, depth - 1) for _ in range(rng.randint(0, 12 if depth == 6 else 3))] if depth else rng.choice([None, "bare", 5, []])
    return {"type": kind, "content": inner} if rng.random() < 0.9 else {"content": inner}


def test_trees_of_any_depth_match_recursion(spark):
    rng = random.Random(3)
    bodies = [tree(rng, 6) for _ in range(40)] + [None, "text", 7, [], {}, ["a", ["b", {"type": "text", "text": "c"}]], {"type": "paragraph", "content": "s"}]
    deep = {"type": "text", "text": "deep"}
    for _ in range(23):
        deep = {"type": "listItem", "content": [deep]}
    bodies.append(deep)
    rows = [(i, None if b is None else json.dumps(b)) for i, b in enumerate(bodies)] + [(900, "{broken")]
    got = {r["k"]: r["text"] for r in flatten_trees(spark.createDataFrame(rows, "k long, body string"), "k", "body").collect()}
    assert got == {**{i: plain(b) for i, b in enumerate(bodies)}, 900: ""}


def test_trees_stay_a_row_each_and_equal_ids_apart(spark):
    trees = [json.dumps({"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": t}]}, None, {"type": 7}, {"text": "no type"}]}) for t in "ab"]
    made = flatten_trees(spark.createDataFrame([(1, trees[0]), (1, trees[1]), (2, '"x"'), (3, "7.5"), (4, "null")], "k long, body string"), "k", "body")
    assert sorted(map(tuple, made.collect())) == [(1, "a\n"), (1, "b\n"), (2, "x"), (3, ""), (4, "")]
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_block_lists(spark):
    run = lambda *t: {"rich_text": [{"plain_text": x} for x in t]}
    blocks = [{"type": "paragraph", "paragraph": run("a", "b")}, {"type": "bulleted_list_item", "bulleted_list_item": run("x")}, {"type": "numbered_list_item", "numbered_list_item": run("y")}, {"type": "code", "code": run("k = 1")}, {"type": "heading_1", "heading_1": run("H")}, {"type": "paragraph", "paragraph": run()}, {"type": "divider", "divider": {}}, {"type": "image"}, {}]
    rows = [(1, json.dumps(blocks)), (2, "[]"), (3, None), (4, "no json")]
    got = {r["i"]: r["t"] for r in spark.createDataFrame(rows, "i int, b string").select("i", flatten_blocks(F.col("b")).alias("t")).collect()}
    assert got == {1: "ab\n- x\n1. y\n```\nk = 1\n```\n\nH", 2: "", 3: "", 4: ""}


def test_sections_carry_their_path(spark):
    text = "intro  \n\n# One\nbody\n## Two  \nx\n#### Four\n### Three\ny\n# Five\n  \n#no heading\n   ###### Six\n    # code\n"
    rows = sorted(sections(spark.createDataFrame([(1, text), (2, "plain"), (3, ""), (4, None), (5, "## Only")], "doc_id long, text string")).collect(), key=lambda r: (r["doc_id"], r["section"]))
    assert [(r["doc_id"], r["section"], r["level"], r["title"], r["path"]) for r in rows] == [
        (1, 0, 0, None, []), (1, 1, 1, "One", ["One"]), (1, 2, 2, "Two", ["One", "Two"]), (1, 3, 4, "Four", ["One", "Two", "Four"]), (1, 4, 3, "Three", ["One", "Two", "Three"]), (1, 5, 1, "Five", ["Five"]), (1, 6, 6, "Six", ["Five", "Six"]),
        (2, 0, 0, None, []), (5, 0, 2, "Only", ["Only"]),
    ]
    cut = [text[r["start"] : r["end"]] for r in rows if r["doc_id"] == 1]
    assert cut == ["intro", "# One\nbody", "## Two  \nx", "#### Four", "### Three\ny", "# Five\n  \n#no heading", "###### Six\n    # code"]


def test_spans_and_chunks_by_heading(spark):
    text = "One. Two!  Three?\n\n  Next para. End\n"
    got = sorted(tuple(r)[1:] for r in text_spans(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect())
    assert [(k, p, text[s:e]) for k, p, s, e in got] == [("paragraph", 0, "One. Two!  Three?"), ("paragraph", 1, "Next para. End"), ("sentence", 0, "One."), ("sentence", 0, "Two!"), ("sentence", 0, "Three?"), ("sentence", 1, "Next para."), ("sentence", 1, "End")]
    rng = random.Random(1)
    for _ in range(60):
        t = "\n".join(rng.choice(["# Head", "## Sub part", "", "words of a line. More here.", "x" * 30]) for _ in range(rng.randint(0, 14)))
        heads = [m.start() for m in re.finditer(r"^#+ ", t, re.M)]
        for s, e in split_sections(t, 40, 10):
            assert 0 < e - s <= 40 and not any(s < h < e for h in heads)
        covered = set().union(*[range(s, e) for s, e in split_sections(t, 40, 10)], set())
        assert all(i in covered for i, c in enumerate(t) if not c.isspace())


def test_chunks_are_handed_on_while_texts_are_read():
    import pyarrow as pa

    from tidewright.operators import batches, chunking

    text, read = "Some words here. " * 2000, []

    def parts():
        for i in range(20):
            read.append(i)
            yield pa.record_batch({"doc_id": pa.array([i, None]), "text": pa.array([text, None])})

    out = []
    for batch in chunking._chunk(400, 60, split_sections)(parts()):
        assert batch.num_rows <= batches.ROWS
        # What is held are some rows more than were handed on, not all of the texts.
        assert len(read) * len(split_sections(text, 400, 60)) <= sum(b.num_rows for b in out) + batches.ROWS + 200
        out.append(batch)
    rows = [r for b in out for r in b.to_pylist()]
    assert [(r["doc_id"], r["chunk_index"], r["char_start"], r["char_end"], r["chunk"]) for r in rows] == [(d, i, s, e, text[s:e]) for d in range(20) for i, (s, e) in enumerate(split_sections(text, 400, 60))]
