"""Trees against a plain evaluation of set operators over made-up search results."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import setops
from quarry.plans import sql, tree

SCHEMA = "corpus string, source string, chunk_index int, line_start int, line_end int, location string, score double, chunk string, embedding array<float>, _ord int"
TOPICS = ["bread", "soup", "salad", "tea"]


def made():
    """For each topic rows (corpus, source, chunk_index, from, to, score); pieces of a long line share a place."""
    rng = random.Random(9)
    places = [(c, f, i, 20 * i + 1, 20 * i + 20 - 5 * (i % 2)) for c, f in itertools.product("pq", ("a.txt", "b.txt")) for i in range(6)]
    pieces = [("p", "a.txt", 6 + i, 200, 200) for i in range(3)]
    found = {t: [(*p, round(rng.random(), 2)) for p in rng.sample(places + pieces, 14)] for t in TOPICS}
    # of the tea all pieces, of the soup none
    found["tea"] = [r for r in found["tea"] if r[3] != 200] + [(*p, 0.5 + i / 10) for i, p in enumerate(pieces)]
    found["soup"] = [r for r in found["soup"] if r[3] != 200]
    return found


FOUND = made()
LOW = 0.2


def plain(node):
    """Rows of a node as (corpus, location, score), by definition."""
    if isinstance(node, str):
        return [((r[0], f"{r[1]}:{r[3]}-{r[4]}"), r[5]) for r in FOUND[node] if r[5] >= LOW]
    op = node.get("op", "difference" if "exclude" in node else "leaf").lower()
    if op == "leaf":
        return plain(node["query"])
    sets = [plain(q) for q in node.get("queries", [node.get("left", node.get("query")), node.get("right", node.get("exclude"))])]
    every = list(itertools.chain(*sets))
    keys = [{k for k, _ in s} for s in sets]
    best = {k: max(x for other, x in every if other == k) for k, _ in every}
    if op == "union_all":
        return every
    if op == "union":
        return list(best.items())
    if op == "intersect":
        return [(k, x) for k, x in best.items() if all(k in own for own in keys)]
    if op == "difference":
        return [(k, x) for k, x in sets[0] if k not in keys[1]]
    out = []
    for k in keys[0]:
        mine = sorted((x for other, x in sets[0] if other == k), reverse=True)
        out += [(k, x) for x in mine[sum(other == k for other, _ in sets[1]) :]]
    return out


@pytest.fixture
def search(spark):
    def run(texts, options):
        rows = [(c, s, i, a, b, f"{s}:{a}-{b}", x, f"{t} {i}", [1.0, 0.0] if i % 2 else [0.0, 1.0], n) for n, t in enumerate(texts) for c, s, i, a, b, x in FOUND[t]]
        return spark.createDataFrame(rows, SCHEMA).where(F.col("score") >= options["min_score"])

    return run


def op(name, *queries):
    return {"op": name, "queries": list(queries)}


def minus(a, b, name="difference"):
    return {"op": name, "left": a, "right": b}


TREES = [
    {"query": "bread"},
    op("union", "bread", "soup", "salad"),
    op("INTERSECT", "bread", "soup"),
    op("intersect", "bread", op("intersect", "soup", "salad")),
    minus("bread", "soup"),
    minus("tea", "soup"),
    minus(minus("tea", "soup"), op("intersect", "bread", "salad")),
    op("union", minus("tea", "soup"), "bread"),
    {"query": "bread", "exclude": "soup"},
    minus(op("union", "bread", {"op": "union", "queries": ["soup", "tea"]}), {"query": "salad"}),
    op("union", op("intersect", "bread", "soup"), minus("tea", op("union", "bread", "salad"))),
    op("intersect", minus("bread", "tea"), op("union", "soup", "salad")),
    op("union_all", "bread", "bread", op("union", "soup", "tea")),
    minus(op("union_all", "bread", "bread", "tea"), op("union_all", "bread", "soup"), "difference_all"),
    minus("bread", "bread"),
]


@pytest.mark.parametrize("spec", TREES)
def test_set_operators(search, spec):
    got = tree.lower(spec | {"min_score": LOW, "merge_adjacent": False}, search).collect()
    assert sorted(((r["corpus"], r["location"]), r["score"]) for r in got) == sorted(plain(spec))
    order = [(r["corpus"], r["source"], r["line_start"]) for r in got]
    assert order == sorted(order)
    used = tree._operators(tree.read(spec, []))
    if "difference_all" not in used:
        texts: list[str] = []
        node = tree.read(spec, texts)
        frames = tree._by_frames(node, search(texts, {"min_score": LOW}), 2.0)
        assert sorted(((r["corpus"], r["location"]), r["score"]) for r in frames.collect()) == sorted(plain(spec))


def test_one_scan_one_shuffle(search):
    rows = tree.lower(TREES[6] | {"min_score": LOW, "merge_adjacent": False, "sort": False}, search)
    plan = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange") == 1
    assert "collect_list" not in plan and "bit_or" in plan


def test_many_trees_are_each_tree_by_itself(search):
    specs = [TREES[i] | {"min_score": LOW} for i in range(len(TREES)) if not tree._operators(tree.read(TREES[i], [])) & tree.KEEP_ALL]
    together = tree.lower_many(specs, search)
    plan = together._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange") == 1
    rows = together.collect()
    for i, spec in enumerate(specs):
        alone = tree.lower(spec | {"merge_adjacent": False, "sort": False}, search).collect()
        best = {}
        for r in sorted(alone, key=lambda r: r["score"]):  # a passage is one row here
            best[r["corpus"], r["location"]] = (r["chunk_index"], r["score"])
        mine = [r for r in rows if r["tree"] == i]
        assert len(mine) == len(best) and {(r["corpus"], r["location"]): (r["chunk_index"], r["score"]) for r in mine} == best
    with pytest.raises(ValueError, match="same corpora"):
        tree.lower_many([{"query": "a", "min_score": 0.1}, {"query": "b", "min_score": 0.2}], search)
    with pytest.raises(ValueError, match="repeated"):
        tree.lower_many([{"op": "union_all", "queries": ["a", "b"]}], search)


def test_more_leaves_than_bits_of_a_word(search):
    """Sets 62 and more have their bits in a second word."""
    made = search(TOPICS, {"min_score": LOW}).withColumn("_ord", F.col("_ord") * 30)
    sets = setops.Leaves(made.drop("embedding"), 91)
    key = lambda rows: sorted(((r["corpus"], r["location"]), r["score"]) for r in rows.collect())
    assert key(sets.select(sets.union(*[sets.of(30 * i) for i in range(4)]))) == sorted(plain(op("union", *TOPICS)))
    assert key(sets.rows_of(90, [sets.of(30)])) == sorted(plain(minus("tea", "soup")))
    assert key(sets.select(sets.intersect(sets.of(0), sets.of(60)))) == sorted(plain(op("intersect", "bread", "salad")))


def test_semantic_difference_in_a_tree(search):
    spec = minus("bread", "soup") | {"min_score": LOW, "merge_adjacent": False, "semantic": True, "threshold": 0.5}
    assert tree.lower(spec, search).count() == 0  # soup has passages of both kinds
    assert tree.lower(spec | {"threshold": 1.5}, search).count() == len(plain(minus("bread", "soup")))
    with pytest.raises(ValueError):
        tree.lower(minus("bread", "soup", "difference_all") | {"semantic": True}, search)


def test_merge_is_default_and_limit_is_of_the_whole(search):
    merged = tree.lower({"query": "bread", "min_score": 0.0}, search)
    assert merged.count() < 14 and merged.columns == [c for c in setops.Passages(search(["bread"], {"min_score": 0})).columns if c != "embedding"]
    best = tree.lower(op("union", "bread", "soup") | {"min_score": 0.0, "merge_adjacent": False, "limit": 3}, search).collect()
    assert sorted(r["score"] for r in best) == sorted(sorted((x for _, x in plain(op("union", "bread", "soup"))), reverse=True)[:3])


@pytest.mark.parametrize(
    "spec", ["text", {}, {"op": "bogus", "queries": ["a", "b"]}, {"op": "union"}, {"op": "union", "queries": ["bread"]}, {"op": "difference", "left": "bread"}, op("union", "bread", 3)]
)
def test_errors(spec):
    with pytest.raises(ValueError):
        tree.lower(spec, lambda texts, options: None)


S = "SELECT * FROM search('{}')".format


@pytest.mark.parametrize(
    "text, expected",
    [
        (S("a"), {"query": "a"}),
        ('select * from search("it\'s") ;', {"query": "it's"}),
        ("SELECT * FROM search('it''s (x)')", {"query": "it's (x)"}),
        (f"{S('a')} UNION {S('b')} union {S('c')}", op("union", {"query": "a"}, {"query": "b"}, {"query": "c"})),
        (f"{S('a')} UNION ALL {S('b')} union all {S('c')}", op("union_all", {"query": "a"}, {"query": "b"}, {"query": "c"})),
        (f"{S('a')} UNION {S('b')} EXCEPT ALL {S('c')}", minus(op("union", {"query": "a"}, {"query": "b"}), {"query": "c"}, "difference_all")),
        (f"{S('a')} EXCEPT {S('b')} EXCEPT {S('c')}", {"op": "difference", "left": {"op": "difference", "left": {"query": "a"}, "right": {"query": "b"}}, "right": {"query": "c"}}),
        (f"{S('a')} UNION {S('b')} INTERSECT {S('c')}", op("union", {"query": "a"}, op("intersect", {"query": "b"}, {"query": "c"}))),
        (f"SELECT * FROM ({S('a')} UNION {S('b')}) AS t EXCEPT {S('c')}", {"op": "difference", "left": op("union", {"query": "a"}, {"query": "b"}), "right": {"query": "c"}}),
        (f"{S('a')} WHERE corpus IN ('x', 'y') AND min_score >= 0.4", {"query": "a", "corpuses": ["x", "y"], "min_score": 0.4}),
        (f"{S('WHERE')} where semantic = true and threshold > 0.75 limit 3", {"query": "WHERE", "semantic": True, "threshold": 0.75, "limit": 3}),
    ],
)
def test_sql(text, expected):
    assert sql.parse(text) == expected


@pytest.mark.parametrize("text", ["", "  ", "SELECT * FROM find('x')", "SELECT * search('x')", "SELECT * FROM search()", S("a") + " UNION", S("a") + " WHERE color = 1", S("a") + " extra"])
def test_sql_errors(text):
    with pytest.raises(ValueError):
        sql.parse(text)


def test_boolean_flags():
    spec = tree.boolean_query("a, b,", exclude=["c", "d"], union=True, semantic=True, max_chunks=4)
    assert spec["left"] == op("union", "a", "b") and spec["right"] == op("union", "c", "d")
    assert spec["semantic"] and spec["max_results"] == 4 and spec["min_score"] == 0.3
    with pytest.raises(ValueError):
        tree.boolean_query("a", union=True)
