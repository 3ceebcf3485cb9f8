"""One path a start so that no fragment is used twice, at its best over all starts.

Starts that share no fragment, not even by way of others, don't concern each other. So a problem is first split into
components of starts, as a join and an aggregate a round. Lone starts are ranked by a window; other components are searched,
best first, with a bound on all parts of what is compared: an open choice is as good as the best that each remaining start
has left. What is second best over all is the least loss of any one component. A search visits so many nodes at most, and
says so if it was cut.
"""

from __future__ import annotations

import heapq
import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled
from .groups import in_groups

#: Nodes that a component's search visits at most, and attempts to finish what it had then.
MOST, DIVES = 250_000, 256


def components(members: DataFrame, most: int = 64) -> DataFrame:
    """problem, start and label, the least start of its component; starts of a problem are joined by fragments. members: problem, start, fragment."""
    joined = _joined(members, most)
    return members.select("problem", "start").distinct().join(joined, ["problem", "start"], "left").select("problem", "start", F.coalesce("label", "start").alias("label"))


def _joined(members: DataFrame, most: int = 64) -> DataFrame:
    """The components of the starts that share a fragment with another one.

    Labels go over shared fragments to all starts of each, and are then shortened to the label's own label.
    """
    shared = members.groupBy("problem", "fragment").agg(F.min("start").alias("low"), F.max("start").alias("high")).where("low < high")
    held = settled(members.select("problem", "start", "fragment").join(shared.select("problem", "fragment"), ["problem", "fragment"], "left_semi").distinct(), "members")
    labels = settled(held.select("problem", "start", F.col("start").alias("label")).distinct(), "labels")
    for _ in range(most):
        least = held.join(labels, ["problem", "start"]).groupBy("problem", "fragment").agg(F.min("label").alias("label"))
        offered = held.join(least, ["problem", "fragment"]).groupBy("problem", "start").agg(F.min("label").alias("label"))
        own = labels.select("problem", F.col("start").alias("label"), F.col("label").alias("to"))
        after = offered.join(own, ["problem", "label"]).select("problem", "start", F.least("label", "to").alias("label"))
        after = settled(after, "labels")
        changed = after.join(labels.withColumnRenamed("label", "was"), ["problem", "start"]).where("label <> was")
        labels = after
        if changed.isEmpty():
            return labels
    raise RuntimeError("components didn't settle")


def search(options: dict[int, list[tuple]], most: int = MOST) -> tuple[list[tuple[tuple, list[tuple]]], bool]:
    """The best and second best choice, each a key and (start, path, costs...) by start, and whether the search was cut. options: by start (path, costs...).

    Keys compare: more fragments, then the least sums of costs, the first before the next, then the paths themselves.
    """
    starts = sorted(options)
    bit = {f: i for i, f in enumerate({f for o in options.values() for p, *_ in o for f in p})}

    def mask(path: list[int]) -> int:
        bits = bytearray(len(bit) // 8 + 1)
        for f in path:
            bits[bit[f] >> 3] |= 1 << (bit[f] & 7)
        return int.from_bytes(bits, "little")

    left = [sorted((tuple(path), mask(path), (-len(path), *costs)) for path, *costs in options[s]) for s in starts]
    parts = max((len(o[0][2]) for o in left if o), default=1)
    # a path that leaves another start nothing is in no choice
    shrunk = True
    while shrunk:
        shrunk = False
        for i, j in itertools.permutations(range(len(left)), 2):
            kept = [o for o in left[i] if any(not o[1] & p[1] for p in left[j])]
            shrunk, left[i] = shrunk or len(kept) < len(left[i]), kept

    def bound(i: int, used: int, sums: tuple) -> tuple | None:
        """The best that may come of it; none if a start has nothing left."""
        out = list(sums)
        for some in left[i:]:
            free = [c for _, m, c in some if not m & used]
            if not free:
                return None
            for k in range(parts):
                out[k] += min(c[k] for c in free)
        return tuple(out)

    def finished(i: int, used: int, sums: tuple, paths: tuple) -> tuple | None:
        """The first way to go on that leaves each start something."""
        while i < len(left):
            for path, m, c in sorted(left[i], key=lambda o: (o[2], o[0])):
                if not m & used and bound(i + 1, used | m, sums) is not None:
                    i, used, sums, paths = i + 1, used | m, tuple(map(sum, zip(sums, c, strict=True))), (*paths, path)
                    break
            else:
                return None
        return sums, paths

    zero = (0,) * parts
    first = bound(0, 0, zero)
    # equal bounds go by their paths so far, so that choices are finished in order of their keys
    heap = [(first, (), 0, zero)] if first is not None else []
    done: list[tuple] = []
    visited, cut = 0, False
    while heap and len(done) < 2:
        if visited >= most:
            cut = True
            for _, paths, used, sums in heapq.nsmallest(DIVES, heap):
                if (end := finished(len(paths), used, sums, paths)) is not None:
                    done.append(end)
                if len(done) == 2:
                    break
            done.sort()
            break
        _, paths, used, sums = heapq.heappop(heap)
        visited += 1
        i = len(paths)
        if i == len(starts):
            done.append((sums, paths))
            continue
        for path, m, c in left[i]:
            if not m & used:
                after = tuple(map(sum, zip(sums, c, strict=True)))
                b = bound(i + 1, used | m, after)
                if b is not None:
                    heapq.heappush(heap, (b, (*paths, path), used | m, after))
    costs = [{(path, c): c for path, _, c in some} for some in left]

    def listed(sums: tuple, paths: tuple) -> tuple:
        """Which costs the paths had: of a path with several, those that add up."""
        ways = [[c for p, c in known if p == path] for path, known in zip(paths, costs, strict=True)]
        way = next(w for w in itertools.product(*ways) if tuple(map(sum, zip(zero, *w, strict=True))) == sums)
        return sums, [(s, list(p), *c[1:]) for s, p, c in zip(starts, paths, way, strict=True)]

    return [listed(*d) for d in done], cut


CHOSEN = "problem long, component long, start long, fragments array<long>, unresolved int, ambiguous int, cost double, loss struct<fragments:long,unresolved:long,ambiguous:long,cost:double>, cut boolean, fault string"
#: Why a start has no path.
CLASH, UNFINISHED = "no disjoint choice", "search cut before a choice"


def _alone(found: DataFrame) -> DataFrame:
    """What a search finds of starts that share no fragment with another one: their best path, and what their second best lacks."""
    by = Window.partitionBy("problem", "start").orderBy(F.desc("size"), "unresolved", "ambiguous", "cost", "fragments")
    best = found.withColumn("size", F.size("fragments").cast("bigint")).withColumn("rank", F.row_number().over(by)).where("rank <= 2")
    then = best.withColumn("then", F.lead(F.struct("size", "unresolved", "ambiguous", "cost")).over(by)).where("rank = 1")
    lacks = F.struct((F.col("size") - F.col("then.size")).alias("fragments"), *((F.col(f"then.{c}") - F.col(c)).alias(c) for c in ("unresolved", "ambiguous", "cost")))
    return then.select("problem", F.col("start").alias("component"), "start", "fragments", F.col("unresolved").cast("int").alias("unresolved"), F.col("ambiguous").cast("int").alias("ambiguous"), "cost",
        F.when(F.col("then").isNotNull(), lacks).alias("loss"), F.lit(False).alias("cut"), F.lit(None).cast("string").alias("fault"))


def select_disjoint(found: DataFrame, most: int = MOST) -> DataFrame:
    """The best choice of disjoint paths of each problem: problem, start, fragments, unresolved, ambiguous, cost, margin, cut, fault.

    found: problem, start, fragments, cost and, if known, unresolved and ambiguous, which count before cost. margin is what the second best
    choice of the problem costs more, if it has as many fragments; cut, that a search stopped early. Starts that no choice can
    give a path have null fragments and a fault; other components of the problem have their paths nevertheless.
    """
    costs = [(F.col(c) if c in found.columns else F.lit(0)).cast(kind).alias(c) for c, kind in (("unresolved", "bigint"), ("ambiguous", "bigint"), ("cost", "double"))]
    known = found.where("problem is not null and start is not null and fragments is not null")
    found = settled(known.select("problem", "start", F.col("fragments").cast("array<bigint>").alias("fragments"), *costs), "options")
    joined = _joined(found.select("problem", "start", F.explode("fragments").alias("fragment")))

    def run(key: tuple, rows: list[tuple]) -> list[tuple]:
        options: dict[int, list] = {}
        for s, p, u, a, c in rows:
            options.setdefault(s, []).append((p, u, a, c))
        best, cut = search(options, most)
        if not best:
            return [(*key, s, None, None, None, None, None, cut, UNFINISHED if cut else CLASH) for s in sorted(options)]
        loss = None
        if len(best) == 2:
            loss = dict(zip(("fragments", "unresolved", "ambiguous", "cost"), (b - a for a, b in zip(best[0][0], best[1][0], strict=True)), strict=True))
        return [(*key, *c, loss, cut, None) for c in best[0][1]]

    together = found.join(joined, ["problem", "start"]).select("problem", F.col("label").alias("component"), "start", "fragments", "unresolved", "ambiguous", "cost")
    chosen = in_groups(together, 2, run, CHOSEN).unionByName(_alone(found.join(joined, ["problem", "start"], "left_anti")))
    by = Window.partitionBy("problem")
    least = F.min("loss").over(by)
    margin = F.when(least["fragments"] == 0, F.greatest(F.lit(0.0), least["cost"]))
    return chosen.withColumns({"margin": margin, "cut": F.max("cut").over(by)}).select("problem", "start", "fragments", "unresolved", "ambiguous", "cost", "margin", "cut", "fault")
