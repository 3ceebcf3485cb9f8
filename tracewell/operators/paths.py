"""Paths through continuation graphs: beam enumeration and node-disjoint flows.

Starts are independent, so beams run in parallel by start; flows are small combinatorial problems and run one
to a problem, in parallel over problems. Choices of disjoint paths: `choices`.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import in_groups

HYPOTHESIS = "problem long, start long, fragments array<long>, cost double, reason string"
#: Why a path ends: its last fragment says so, nothing fits, the search stopped, or it never began.
ENDED, OPEN, CUT, OUTSIDE = "ends in padding", "no continuation", "max depth", "no such fragment"


def beam(start: int, edges: dict[int, list[tuple[float, int]]], top: int = 4, width: int = 24, depth: int = 4096, most: int = 64) -> list[tuple[list[int], float, str]]:
    """Paths from start by least cost: `top` continuations of each, `width` open paths kept. Finished paths only, never their prefixes."""
    # open paths are of one length, so cost and path order them
    open_paths, done, onward = [(0.0, [start])], [], {}
    for _ in range(depth):
        grown = []
        for cost, path in open_paths:
            last = path[-1]
            if last not in onward:
                onward[last] = sorted(edges.get(last, ()))
            nexts = [(s, t) for s, t in onward[last] if t not in path][:top]
            if not nexts:
                done.append((path, cost, OPEN))
            grown += [(cost + s, [*path, t]) for s, t in nexts]
        if not grown:
            break
        grown.sort()
        open_paths = grown[:width]
    else:
        done += [(p, c, CUT) for c, p in open_paths]
    return sorted(done, key=lambda x: (-len(x[0]), x[1], x[0]))[:most]


def _problems(nodes: DataFrame, edges: DataFrame, run: Callable[[int, list[tuple], list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """The rows that run makes of each problem's nodes (columns after problem) and edges (src, dst, score); a problem is one group."""
    names = nodes.columns[1:]
    # one frame of both, nodes where there is no edge
    one = nodes.select("problem", F.struct(*names).alias("n"), F.lit(None).cast("struct<src:bigint,dst:bigint,score:double>").alias("e"))
    score = F.coalesce(F.col("score").cast("double"), F.lit(float("nan")))
    two = edges.select("problem", F.lit(None).cast(one.schema["n"].dataType).alias("n"), F.struct(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"), score.alias("score")).alias("e"))
    flat = one.unionByName(two).select("problem", F.col("n").isNotNull().alias("node"), *(F.col(f"n.{c}").alias(f"n{i}") for i, c in enumerate(names)), "e.*")

    def both(key: tuple, rows: list[tuple]) -> list[tuple]:
        ns, es = [r[1:-3] for r in rows if r[0]], [r[-3:] for r in rows if not r[0]]
        return run(key[0], ns, es)

    return in_groups(flat, 1, both, schema)


def hypotheses(starts: DataFrame, edges: DataFrame, top: int = 4, width: int = 24, depth: int = 4096, most: int = 64) -> DataFrame:
    """Beam paths of each start. starts: problem, start; edges: problem, src, dst, score. Edges are grouped by problem."""

    def run(problem: int, found: list[tuple], arcs: list[tuple]) -> list[tuple]:
        out = defaultdict(list)
        for a, b, c in arcs:
            out[a].append((c, b))
        return [(problem, x, p, c, r) for (x,) in sorted(set(found)) for p, c, r in beam(x, out, top, width, depth, most)]

    return _problems(starts.select("problem", F.col("start").cast("bigint").alias("start")), edges, run, HYPOTHESIS)


def flow(nodes: dict[int, int], edges: list[tuple[int, int, float]], starts: list[int], reward: float, forbidden: tuple[int, int] | None = None) -> tuple[list[list[int]], float]:
    """Node-disjoint paths from the starts of the most benefit, sum of (reward - score) over edges worth it.

    nodes: id -> physical index, which must rise along edges; no edge leads into a start. Successive shortest
    augmentations over split nodes by Bellman-Ford.
    """
    graph: list[list] = []  # [from, to, capacity, cost]
    first: dict = defaultdict(list)

    def arc(a, b, cost: float) -> None:
        first[a].append(len(graph))
        graph.append([a, b, 1, cost])
        first[b].append(len(graph))
        graph.append([b, a, 0, -cost])

    taken = set(starts)
    onward = defaultdict(list)
    for a, b, score in sorted(edges):
        if reward - score > 0 and nodes[b] > nodes[a] and b not in taken and (a, b) != forbidden:
            onward[a].append((b, score))
    # arcs in physical order, so that a round of relaxations settles nearly all
    for v in sorted(nodes, key=lambda v: (nodes[v], v)):
        if v in taken:
            arc("source", ("in", v), 0.0)
        arc(("in", v), ("out", v), 0.0)
        arc(("out", v), "sink", 0.0)
        for b, score in onward[v]:
            arc(("out", v), ("in", b), score - reward)
    total = 0.0
    for _ in range(len(taken)):
        dist, via = {"source": 0.0}, {}
        for _ in range(2 * len(nodes) + 2):
            changed = False
            for i, (a, b, cap, cost) in enumerate(graph):
                if cap and a in dist and dist[a] + cost < dist.get(b, float("inf")) - 1e-12:
                    dist[b], via[b], changed = dist[a] + cost, i, True
            if not changed:
                break
        if "sink" not in dist:
            break
        total -= dist["sink"]
        at = "sink"
        while at != "source":
            i = via[at]
            graph[i][2] -= 1
            graph[i ^ 1][2] += 1
            at = graph[i][0]
    after = {g[0][1]: g[1][1] for i, g in enumerate(graph) if not i % 2 and not g[2] and isinstance(g[1], tuple) and g[0] != "source" and g[0][0] == "out"}
    paths = []
    for s in sorted(taken):
        path = [s]
        while path[-1] in after:
            path.append(after[path[-1]])
        paths.append(path)
    return paths, total


FLOW = "problem long, start long, nodes array<long>, benefit double, margin double"


def solve_flows(nodes: DataFrame, edges: DataFrame, reward: float, most_margins: int = 64) -> DataFrame:
    """Node-disjoint paths by problem, and the benefit that the best solution without one of the chosen edges lacks: null if there are more than most_margins of them.

    nodes: problem, node, index, is_start; edges: problem, src, dst, score.
    """

    def run(problem: int, known: list[tuple], arcs: list[tuple]) -> list[tuple]:
        index = {v: i for v, i, _ in known}
        if len(index) != len(known) or len(set(index.values())) != len(known):
            raise ValueError("nodes and their physical indexes must be unique")
        starts = [v for v, _, first in known if first]
        if any(a == b or a not in index or b not in index for a, b, _ in arcs):
            raise ValueError("edges must join two different known nodes")
        paths, total = flow(index, arcs, starts, reward)
        chosen = [(a, b) for p in paths for a, b in zip(p, p[1:], strict=False)]
        margin = min((total - flow(index, arcs, starts, reward, x)[1] for x in chosen), default=None) if len(chosen) <= most_margins else None
        return [(problem, p[0], p, total, margin) for p in paths]

    return _problems(nodes.select("problem", F.col("node").cast("bigint").alias("node"), F.col("index").cast("bigint").alias("index"), "is_start"), edges, run, FLOW)


def assign(options: dict[int, list[tuple[float, int]]], none: float = 1e7) -> dict[int, int | None]:
    """One continuation or none for each open path, none used twice, at the least total; going without costs `none`.

    Branch and bound: paths with the fewest options first, and what is left at its cheapest as the bound.
    """
    order = sorted(options, key=lambda k: (len(options[k]), k))
    least = [0.0] * (len(order) + 1)
    for i in range(len(order) - 1, -1, -1):
        least[i] = least[i + 1] + min([s for s, _ in options[order[i]]] + [none])
    best: tuple[float, dict] = (float("inf"), {})

    def search(i: int, used: frozenset, cost: float, picked: dict) -> None:
        nonlocal best
        if cost + least[i] >= best[0]:
            return
        if i == len(order):
            best = (cost, dict(picked))
            return
        for s, f in sorted(options[order[i]]):
            if f not in used:
                search(i + 1, used | {f}, cost + s, {**picked, order[i]: f})
        search(i + 1, used, cost + none, {**picked, order[i]: None})

    search(0, frozenset(), 0.0, {})
    return best[1]


LOCAL = "problem long, start long, fragments array<long>, cost double, ambiguous int"


def local_chains(starts: DataFrame, edges: DataFrame, top: int = 6, steps: int = 10_000) -> DataFrame:
    """Chains by a joint choice at each step, the simpler counterpart of beams and disjoint selection; ambiguous counts steps with more than one option."""

    def run(problem: int, found: list[tuple], arcs: list[tuple]) -> list[tuple]:
        out: dict[int, list[tuple[float, int]]] = defaultdict(list)
        for a, b, c in arcs:
            out[a].append((c, b))
        chains = {x: ([x], 0.0, 0) for (x,) in found}
        used, open_ = set(chains), set(chains)
        for _ in range(steps):
            options = {k: sorted((c, t) for c, t in out.get(chains[k][0][-1], ()) if t not in used)[:top] for k in open_}
            open_ = {k for k in open_ if options[k]}
            if not open_:
                break
            for k, t in assign({k: options[k] for k in open_}).items():
                path, cost, unsure = chains[k]
                if t is None:
                    open_.discard(k)
                    continue
                chains[k] = ([*path, t], cost + dict((b, c) for c, b in options[k])[t], unsure + (len(options[k]) > 1))
                used.add(t)
        return [(problem, k, p, c, u) for k, (p, c, u) in sorted(chains.items())]

    return _problems(starts.select("problem", F.col("start").cast("bigint").alias("start")), edges, run, LOCAL)


def graph_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """problem, item and fault: nodes or physical indexes given twice, edges to themselves or to unknown nodes. Nodes: problem, node, index."""
    twice = lambda c, fault: nodes.groupBy("problem", F.col(c).cast("string").alias("item")).count().where("count > 1").select("problem", "item", F.lit(fault).alias("fault"))
    item = F.concat_ws("-", F.col("src").cast("string"), F.col("dst").cast("string")).alias("item")
    loops = edges.where("src = dst").select("problem", item, F.lit("edge to itself").alias("fault"))
    known = nodes.select("problem", F.col("node"))
    lost = [edges.join(known.withColumnRenamed("node", end), ["problem", end], "left_anti").select("problem", item, F.lit("unknown node").alias("fault")) for end in ("src", "dst")]
    return twice("node", "node twice").unionByName(twice("index", "index twice")).unionByName(loops).unionByName(lost[0]).unionByName(lost[1]).distinct()
