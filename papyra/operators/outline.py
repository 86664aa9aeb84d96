"""Outlines in Markdown as graphs of stages."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LABELLED = re.compile(r"\*\*([^*]+)\*\*[：:\s-]*(.*)\Z", re.S)
_GROUP = re.compile(r"\*\*[^*]+\*\*\s*[：:]\s*")
_ITEM = re.compile(r"(\s*)(?:[-*+]|\d+[.)])\s+(.+)")
_HEADING = re.compile(r"(#+)\s+(.+)")
_EVIDENCE = [re.compile(p, re.I) for p in (r">\s*\[\^(?:quote|evidence):\s*(.*?)\]\s*\Z", r">\s*(?:quote|evidence):\s*[\"“]?(.+?)[\"”]?\s*\Z", r">\s*[\"“](.*?)[\"”]\s*\Z")]


def _clean(s: str) -> str:
    return " ".join(re.sub(r"[\0-\x1f]", " ", s).split())


def _entries(source: str):
    """(depth, text) of headings and items, (None, quote) of evidence; fenced lines are no entries.

    Depths are compared as they are: a heading's is above every item's, an item's goes by
    its indentation.
    """
    fenced = False
    for raw in source.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        line = raw.strip()
        if line.startswith(("```", "~~~")):
            fenced = not fenced
        elif line and not fenced:
            quote = next((m[1].strip() for p in _EVIDENCE if (m := p.match(line))), "")
            if quote:
                yield None, quote
            elif m := _HEADING.fullmatch(line):
                yield (0, len(m[1])), m[2].strip()
            elif m := _ITEM.fullmatch(raw):
                yield (1, len(m[1].replace("\t", "  "))), m[2].strip()


def stage_graph(source: str) -> dict | None:
    """title, nodes and edges of an outline; null without a title, a second heading and an item.

    Headings of the second level are stages; each follows, by `next`, what ends the stage
    before it, the nodes that lead to nothing.  Deeper headings and items hang below what is
    above them: `parallel`, or `detail` where an item hangs below another item.  An item that
    is but a bold label and a colon takes the items of its own depth that come after it.
    """
    title, nodes, edges, stack, stage = "", [], {}, [], []
    seen = set()

    def node(text: str) -> dict:
        m = _LABELLED.match(text)
        label, detail = (m[1], m[2]) if m else (text, "")
        nodes.append({"id": f"step_{len(nodes) + 1}", "label": _clean(label), "detail": _clean(detail), "type": "process", "evidence": []})
        return nodes[-1]

    def link(a: dict, b: dict, relation: str) -> None:
        edges.setdefault((a["id"], b["id"]), relation)

    for depth, text in _entries(source):
        if depth is None:
            if nodes:
                nodes[-1]["evidence"].append(text)
        elif depth == (0, 1):
            title = title or _clean(text)
        elif depth == (0, 2):
            seen.add("heading")
            new = node(text)
            leads = {a for a, _ in edges}
            for last in [n for n in stage if n["id"] not in leads] or stage[:1]:
                link(last, new, "next")
            stage, stack = [new], [(depth, new)]
        elif depth[0] == 0:
            seen.add("heading")
            if not stack:
                continue
            while stack and stack[-1][0][:2] >= depth:
                stack.pop()
            new = node(text)
            if stack:
                link(stack[-1][1], new, "parallel")
            stage.append(new)
            stack.append((depth, new))
        else:
            seen.add("item")
            new = node(text)
            group = bool(_GROUP.fullmatch(text))
            # a group stands above items of its own depth
            place = (*depth, 0) if group or new["detail"] else (*depth, 1)
            while stack and stack[-1][0] >= place:
                stack.pop()
            if stack:
                below_item = any(d[0] == 1 and d[1] < depth[1] for d, _ in stack)
                link(stack[-1][1], new, "detail" if below_item else "parallel")
            stage.append(new)
            stack.append(((*depth, 0 if group else 1), new))
    if not title or seen != {"heading", "item"} or len(nodes) < 2:
        return None
    nodes[0]["type"] = nodes[-1]["type"] = "terminator"
    return {"title": title, "nodes": nodes, "edges": [{"source": a, "target": b, "relation": r} for (a, b), r in edges.items()]}


_S = T.StringType()
NODE = T.StructType([T.StructField(n, _S) for n in ("id", "label", "detail", "type")] + [T.StructField("evidence", T.ArrayType(_S))])
EDGE = T.StructType([T.StructField(n, _S) for n in ("source", "target", "relation")])
GRAPH = T.StructType([T.StructField("title", _S), T.StructField("nodes", T.ArrayType(NODE)), T.StructField("edges", T.ArrayType(EDGE))])


@F.pandas_udf(GRAPH)
def stage_graph_udf(sources: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([stage_graph(x) or {"title": None, "nodes": None, "edges": None} for x in sources.fillna("")], columns=["title", "nodes", "edges"])


def stage_graphs(documents: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of every document's outline; documents that are none are left out."""
    graphs = documents.select(key, stage_graph_udf(column).alias("g")).where("g.nodes IS NOT NULL")
    return graphs.select(key, F.explode("g.nodes").alias("n")).select(key, "n.*"), graphs.select(key, F.explode("g.edges").alias("e")).select(key, "e.*")
