"""Automata along ordered rows, documents in parts, and JSON trees against plain versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from strataloom.functions import automata, ordering
from strataloom.operators import knowledge_base, trees
from strataloom.sources import parts


def plain_states(rows, table, start):
    """rows (group, place, symbol) in any order."""
    out, now = {}, {}
    for g, i, s in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1])):
        out[g, i] = now.get(g, start)
        now[g] = out[g, i] if s is None else table[out[g, i]][s]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_states_are_those_of_one_pass(spark, seed):
    rng = random.Random(seed)
    n = rng.randint(1, 10)
    table = [[rng.randrange(n) for _ in range(4)] for _ in range(n)]
    sizes = [3000, 0, 1, 2, 700, *[rng.randint(1, 6) for _ in range(40)]]  # one document holds most of the rows
    rows = [(None if g == 4 else f"d{g}", i, rng.choice([None, 0, 1, 2, 3])) for g, size in enumerate(sizes) for i in range(size)]
    start = rng.randrange(n)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        frame = spark.createDataFrame(rng.sample(rows, len(rows)), "doc string, pos long, sym int").repartition(5)
        found = automata.states(frame, ["doc"], ["pos"], F.col("sym"), table, "state", start)
        assert found.columns == ["doc", "pos", "sym", "state"]
        assert {(r.doc, r.pos): r.state for r in found.collect()} == plain_states(rows, table, start)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert automata.states(frame.limit(0), ["doc"], ["pos"], F.col("sym"), table, "state").count() == 0


def test_the_line_automata(spark):
    """Fences, listings and pending blanks as the windows over one document have them."""
    rng = random.Random(5)
    lines = [("d", i, rng.choice(["```", "# h", "text", "", "----", "[source,x]", "// c"])) for i in range(500)]
    frame = spark.createDataFrame(lines, "doc string, pos long, line string")
    fence = F.when(F.col("line") == "```", 1).when(F.col("line").startswith("#"), 2).otherwise(0)
    listing = F.when(F.col("line").startswith("[source,"), 0).when(F.col("line") == "----", 1)
    pending = F.when(F.col("line") == "", 0).when(F.col("line").startswith("//"), 1).otherwise(2)
    for symbol, table, rule in (
        (fence, automata.FENCES, lambda now, x: (not now) if x == "```" else False if x.startswith("#") else now),
        (listing, automata.LISTINGS, lambda now, x: True if x.startswith("[source,") else False if x == "----" else now),
        (pending, automata.PENDING, lambda now, x: min(2, now + 1) if x == "" else now if x.startswith("//") else 0),
    ):
        want, now = [], 0
        for _, _, x in lines:
            want.append(int(now))
            now = rule(now, x)
        found = automata.states(frame, ["doc"], ["pos"], symbol, table, "state").orderBy("pos").collect()
        assert [r.state for r in found] == want


def test_numbers_follow_the_order(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None, "c"]), i) for i in range(500)]
    frame = spark.createDataFrame(rng.sample(rows, len(rows)), "g string, i int").repartition(7)
    assert [r.n for r in ordering.numbered(frame, ["i"], "n").orderBy("i").collect()] == list(range(500))
    found = ordering.place_in_group(frame, "g", ["i"], "n").collect()
    want = {}
    for g, i in sorted(rows, key=lambda r: r[1]):
        want[g, i] = sum(1 for h, j in rows if h == g and j < i)
    assert {(r.g, r.i): r.n for r in found} == want
    assert ordering.numbered(frame.limit(0), ["i"], "n").count() == 0


def test_parts_put_together_are_the_text(spark, tmp_path):
    nodes = trees.from_json(spark.createDataFrame([("book", json.dumps([{"title": "it's", "level": 1, "children": [{"type": "paragraph", "text": f"p {i}\nsecond \\ line"} for i in range(60)]}])), ("b2", '[{"title":"x","level":1}]')], "doc string, json string"))
    want = {r.doc: r.text for r in trees.sql_script(nodes).collect()}
    lines = trees.script_lines(nodes)
    parts.write_parts(lines, str(tmp_path / "script"), chars=700)
    got = {}
    for r in sorted(parts.read_parts(spark, str(tmp_path / "script")).collect(), key=lambda r: (r.doc, r.part)):
        got[r.doc] = got.get(r.doc, "") + r.text
    assert got == want and len(list((tmp_path / "script/book").glob("part-*"))) > 5
    (tmp_path / "script/book/part-000000002").unlink()
    with pytest.raises(Exception, match="a part is missing"):
        parts.read_parts(spark, str(tmp_path / "script")).collect()
    chunks = spark.createDataFrame([(f"s{i % 2}", f"B > {i}.1 T", 1 + i % 3, f"# {i}.1 T\nbody {i}", ["code"] * (i % 2), None if i % 3 else "next", i) for i in range(30)], "source_document string, section_path string, heading_level int, content string, code_blocks array<string>, overlap_next string, pos int")
    for form in ("markdown", "asciidoc"):
        parts.write_parts(knowledge_base.lines(chunks, form), str(tmp_path / form), "source_document", chars=300)
        got = {}
        for r in sorted(parts.read_parts(spark, str(tmp_path / form)).collect(), key=lambda r: (r.doc, r.part)):
            got[r.doc] = got.get(r.doc, "") + r.text
        assert {k: v.rstrip() + "\n" for k, v in got.items()} == {r.source_document: r.text for r in knowledge_base.export(chunks, form).collect()}


def plain_nodes(doc, text):
    try:
        roots = json.loads(text)
    except ValueError:
        return []
    out = []

    def walk(nodes, parent, depth):
        for i, x in enumerate(nodes if isinstance(nodes, list) else []):
            if isinstance(x, dict):
                path = f"{parent}/{i:09d}"
                level = x.get("level")
                level = level if isinstance(level, int) and not isinstance(level, bool) and abs(level) < 2**31 else 0
                string = [x.get(k) if isinstance(x.get(k), str) else None for k in ("title", "type", "text")]
                out.append((doc, path, parent or None, i, depth, level, string[0] or "", string[1], string[2]))
                walk(x.get("children"), path, depth + 1)

    walk(roots, "", 0)
    return out


def test_json_trees(spark):
    rng = random.Random(4)
    texts = ['a "q" \\ \n\t é😀', "", "x\u0001y", "{[", None, 3, True, ["l"], {"o": 1}]

    def node(depth):
        x = {k: rng.choice(texts) for k in ("title", "type", "text") if rng.random() < 0.7}
        if rng.random() < 0.8:
            x["level"] = rng.choice([1, 2, -1, 2**40, 1.0, 1.5, "2", True, None, [1]])
        if depth and rng.random() < 0.9:
            x["children"] = rng.choice([[node(depth - 1) for _ in range(rng.randint(0, 3))], {"a": node(0)}, "no", [[node(0)], 5, None, node(0)]])
        return x

    docs = [(f"d{i}", json.dumps([node(rng.randint(0, 6)) for _ in range(rng.randint(0, 3))], ensure_ascii=rng.random() < 0.5)) for i in range(40)]
    chain = {"title": 'deep\n"x"', "level": 1}
    for i in range(trees.LEVELS + 5):
        chain = {"title": f'level\t"{i}"', "children": [{"text": "beside\\"}, chain]}
    docs += [("chain", json.dumps([chain])), ("object", '{"title":"x"}'), ("number", "5"), ("bad", "[{"), ("twice", "[] []")]
    found = trees.from_json(spark.createDataFrame([*docs, ("null", None)], "doc string, json string"))
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(str(x) for d, t in docs for x in plain_nodes(d, t))


def test_shallow_trees_need_no_python(spark):
    found = trees.from_json(spark.createDataFrame([("d", '[{"title":"a","children":[{"title":"b"}]}]')], "doc string, json string"))
    assert found.count() == 2 and "InPandas" not in found._jdf.queryExecution().toString()
