"""Query trees (nested dicts) lowered to one lazy DataFrame.

A node is {"query": text}, {"op": "union" | "union_all" | "intersect", "queries": [...]},
{"op": "difference" | "difference_all", "left": ..., "right": ...} or {"query": ..., "exclude": ...};
a bare string stands for a leaf. "intersect" also takes left and right. Options
stand at the root and hold for all of the tree: corpuses, min_score,
max_results (of each leaf), semantic, threshold, sort, merge_adjacent, limit (of
the whole). Nested nodes keep their meaning wherever they stand.

All leaves come from one scan, and without a semantic difference all set
operators from one shuffle. "union_all" keeps every row; "difference_all" takes
away as many rows of a passage as the right side has, the best first. A semantic
difference works at every level, as rows carry their vectors; of "difference_all"
there is none.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import docorder, setops

#: (texts, options) to the rows of their searches, `_ord` giving the text's place.
Search = Callable[[list[str], dict[str, Any]], DataFrame]
OPTIONS = {"corpuses": None, "min_score": 0.3, "max_results": None, "semantic": False, "threshold": 0.7, "sort": True, "merge_adjacent": True, "limit": None}
DIFFERENCES = ("difference", "difference_all")
KEEP_ALL = {"union_all", "difference_all"}


def _operands(node: dict, op: str) -> list:
    if op == "intersect" and "left" in node and "right" in node:
        return [node["left"], node["right"]]
    if "queries" not in node:
        raise ValueError(f"{op} needs 'queries'")
    if not isinstance(node["queries"], list) or len(node["queries"]) < 2:
        raise ValueError(f"{op} needs at least 2 queries")
    return node["queries"]


def read(node: Any, texts: list[str]) -> tuple:
    """A node as (operator, operands), a leaf as ("leaf", place in `texts`); unions in unions and intersections in intersections become one."""
    if isinstance(node, str):
        if node not in texts:
            texts.append(node)
        return "leaf", texts.index(node)
    if not isinstance(node, dict):
        raise ValueError("a query node must be a dictionary or a string")
    op = str(node.get("op", "")).lower() or ("difference" if "exclude" in node else "")
    if not op:
        if "query" not in node:
            raise ValueError("a query node needs 'query' or 'op'")
        return read(str(node["query"]), texts)
    if op in ("union", "union_all", "intersect"):
        parts: list[tuple] = []
        for part in (read(q, texts) for q in _operands(node, op)):
            parts += part[1] if part[0] == op else [part]
        return op, parts
    if op in DIFFERENCES:
        left, right = node.get("left", node.get("query")), node.get("right", node.get("exclude"))
        if left is None or right is None:
            raise ValueError("difference needs 'left' and 'right', or 'query' and 'exclude'")
        return op, [read(left, texts), read(right, texts)]
    raise ValueError(f"unknown operation: {op}")


def _by_passage(node: tuple, sets: setops.Leaves | setops.Passages):
    op, parts = node
    return sets.of(parts) if op == "leaf" else getattr(sets, op)(*(_by_passage(p, sets) for p in parts))


def _one_leaf_less(node: tuple) -> tuple[tuple, list[tuple]]:
    """What stands leftmost in a chain of differences, and all that is taken away from it."""
    but: list[tuple] = []
    while node[0] == "difference":
        but.append(node[1][1])
        node = node[1][0]
    return node, but


def _by_frames(node: tuple, rows: DataFrame, threshold: float) -> DataFrame:
    op, parts = node
    if op == "leaf":
        return rows.where(F.col("_ord") == parts).drop("_ord")
    frames = [_by_frames(p, rows, threshold) for p in parts]
    if op == "difference":
        return setops.semantic_difference(*frames, threshold)
    return {"union": setops.union, "union_all": setops.union_all, "intersect": setops.intersect_all}[op](frames)


def _operators(node: tuple) -> set[str]:
    return {node[0]}.union(*map(_operators, node[1])) if node[0] != "leaf" else set()


def lower(spec: Any, search: Search) -> DataFrame:
    """Result rows of a query tree."""
    if not isinstance(spec, dict):
        raise ValueError("a query specification must be a dictionary")
    options = {k: spec.get(k, v) for k, v in OPTIONS.items()}
    texts: list[str] = []
    node = read(spec, texts)
    used = _operators(node)
    semantic = options["semantic"] and "difference" in used
    if options["semantic"] and "difference_all" in used:
        raise ValueError("difference_all is never semantic")
    rows = search(texts, options)
    if semantic:
        rows = _by_frames(node, rows, float(options["threshold"])).drop("embedding")
    elif node[0] == "leaf":
        rows = rows.drop("_ord", "embedding")
    else:
        rows = rows.drop("embedding")
        sets = setops.Passages(rows) if used & KEEP_ALL else setops.Leaves(rows, len(texts))
        left, but = _one_leaf_less(node)
        if isinstance(sets, setops.Leaves) and left[0] == "leaf":
            rows = sets.rows_of(left[1], [_by_passage(b, sets) for b in but])
        else:
            rows = sets.select(_by_passage(node, sets))
    if options["merge_adjacent"]:
        rows = docorder.merge_adjacent(rows)
    if options["limit"] is not None:
        rows = rows.orderBy(F.desc("score"), "corpus", "chunk_index").limit(int(options["limit"]))
    return docorder.document_order(rows) if options["sort"] else rows


def lower_many(specs: list, search: Search) -> DataFrame:
    """Result rows of several trees by one scan and one shuffle, one for each passage, `tree` giving the place in `specs`. Options that the search needs must be the same in all; merging, order and limits are left to the caller."""
    texts: list[str] = []
    nodes = [read(spec, texts) for spec in specs]
    given = [{k: (spec if isinstance(spec, dict) else {}).get(k, OPTIONS[k]) for k in ("corpuses", "min_score", "max_results", "semantic")} for spec in specs]
    if any(g != given[0] for g in given) or given[0]["semantic"]:
        raise ValueError("trees of one scan need the same corpora, minimum score and limit, and no semantic difference")
    if any(_operators(node) & KEEP_ALL for node in nodes):
        raise ValueError("trees of one scan have no operator that keeps repeated rows")
    sets = setops.Leaves(search(texts, OPTIONS | given[0]).drop("embedding"), len(texts))
    return sets.select_many([_by_passage(node, sets) for node in nodes])


def boolean_query(
    query: str, exclude: list[str] | None = None, union: bool = False, corpuses: list[str] | None = None, min_score: float = 0.3,
    max_chunks: int | None = None, semantic: bool = False, threshold: float = 0.7,
) -> dict:
    """A tree from command-line flags: comma-separated texts for a union, texts to exclude as a union on the right."""
    node: dict[str, Any] = {"query": query}
    if union:
        texts = [t.strip() for t in query.split(",") if t.strip()]
        if len(texts) < 2:
            raise ValueError("a union needs at least 2 queries, parted by commas")
        node = {"op": "union", "queries": texts}
    if exclude:
        right = {"query": exclude[0]} if len(exclude) == 1 else {"op": "union", "queries": list(exclude)}
        node = {"op": "difference", "left": node, "right": right}
        if semantic:
            node |= {"semantic": True, "threshold": threshold}
    if corpuses:
        node["corpuses"] = corpuses
    if max_chunks:
        node["max_results"] = max_chunks
    return node | {"min_score": min_score}
