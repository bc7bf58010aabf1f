"""Fill containers of fixed capacity with whole documents: bin completion by branch and bound.

Documents are spread evenly over groups of a bounded size, and each group is packed on its own, so at most about one
poorly filled container per group is lost against a global packing. In a group the largest open document
is completed by each of the undominated fillings found around it in turn, bounded by the containers the rest needs
at least; best fit gives the incumbent. A document longer than the capacity is cut into full parts; only its rest is packed."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.tokens import VOCABULARY, token_count
from broadsheet.runtime import cut

#: Documents of a group, and the nodes a search for one container may visit before it takes its incumbent.
GROUP_DOCS, NODES = 1500, 300
#: Fillings branched over per container, and fillings a group's search may try beyond its first descent.
WIDTH, STEPS = 4, 400
MAX_TASKS = 10_000


def complete(sizes: list[int], room: int, nodes: int = NODES) -> list[int]:
    """Indices into ``sizes`` (ascending) of a filling of at most ``room`` with the least waste found. Fillings are tried
    from the largest item down; a branch ends when all smaller items cannot beat the incumbent."""
    best: list[int] = []
    best_sum = 0
    left, take = room, []  # the incumbent: best fit, largest item that still fits, again and again
    hi = len(sizes)
    while hi and left and (j := bisect.bisect_right(sizes, left, 0, hi) - 1) >= 0:
        take.append(j)
        left -= sizes[j]
        hi = j
    best, best_sum = take, room - left
    if best_sum == room or not take:
        return best
    prefix = [0]
    for s in sizes:
        prefix.append(prefix[-1] + s)
    budget = [nodes]

    def search(hi: int, left: int, take: list[int], total: int) -> bool:
        nonlocal best, best_sum
        if total > best_sum:
            best, best_sum = take[:], total
            if best_sum == room:
                return True
        j = bisect.bisect_right(sizes, left, 0, hi) - 1
        while j >= 0 and budget[0] > 0:
            if total + min(left, prefix[j + 1]) <= best_sum:  # waste bound
                return False
            budget[0] -= 1
            if search(j, left - sizes[j], [*take, j], total + sizes[j]):
                return True
            v = sizes[j]
            while j >= 0 and sizes[j] == v:  # an equal item in its place is the same filling
                j -= 1
        return False

    search(len(sizes), room, [], 0)
    return best


def fillings(sizes: list[int], room: int, width: int = WIDTH, nodes: int = NODES) -> list[list[int]]:
    """Undominated fillings of at most ``room``, as indices into ``sizes`` (ascending), least waste first: at most ``width`` of them,
    the one of ``complete`` always first. A filling is dominated if a larger unused item fits in place of one of its items, or
    an unused item fits in beside them."""
    found: dict[tuple[int, ...], list[int]] = {}
    budget = [nodes]

    def keep(take: list[int], left: int) -> None:
        used = set(take)
        for j in [-1, *take]:
            v = sizes[j] if j >= 0 else 0
            i = bisect.bisect_right(sizes, v + left) - 1
            while i >= 0 and sizes[i] > v:
                if i not in used:
                    return
                i -= 1
        found.setdefault(tuple(sizes[j] for j in take), take)

    def search(hi: int, left: int, take: list[int]) -> None:
        j = bisect.bisect_right(sizes, left, 0, hi) - 1
        if j < 0:
            keep(take, left)
        while j >= 0 and budget[0] > 0 and len(found) < 4 * width:
            budget[0] -= 1
            search(j, left - sizes[j], [*take, j])
            v = sizes[j]
            while j >= 0 and sizes[j] == v:
                j -= 1

    best = complete(sizes, room, nodes)
    search(len(sizes), room, [])
    key = tuple(sizes[j] for j in best)
    others = sorted((f for k, f in found.items() if k != key), key=lambda f: (-sum(sizes[j] for j in f), len(f)))
    return [best, *others[: width - 1]]


def least_containers(sizes: list[int], capacity: int) -> int:
    """A lower bound of the containers for ``sizes`` (ascending): for each k up to half the capacity, items over capacity - k need one
    each, those over half of it too, and the rest from k on fill what the latter leave."""
    n = len(sizes)
    prefix = [0]
    for v in sizes:
        prefix.append(prefix[-1] + v)
    best = -(-prefix[n] // capacity)
    half = bisect.bisect_right(sizes, capacity // 2)
    for k in {v for v in sizes[:half]}:
        low, big = bisect.bisect_left(sizes, k), bisect.bisect_right(sizes, capacity - k)
        big = max(big, half)
        rest = prefix[half] - prefix[low] - ((big - half) * capacity - (prefix[big] - prefix[half]))
        best = max(best, n - half + max(0, -(-rest // capacity)))
    return max(best, n - half)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit decreasing: indices into ``sizes`` (ascending) per container."""
    boxes: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (space left, container), ascending
    for j in range(len(sizes) - 1, -1, -1):
        at = bisect.bisect_left(room, (sizes[j], -1))
        if at < len(room):
            left, n = room.pop(at)
        else:
            left, n = capacity, len(boxes)
            boxes.append([])
        boxes[n].append(j)
        bisect.insort(room, (left - sizes[j], n))
    return boxes


def bin_completion(sizes: list[int], capacity: int, steps: int = STEPS, nodes: int = NODES) -> list[list[int]]:
    """Indices into ``sizes`` (ascending, positive) per container. The largest open item is completed by each of its undominated
    fillings in turn; a branch ends when its containers and the lower bound of the rest are not fewer than the incumbent's.
    The incumbent is best fit decreasing. The search ends when the lower bound is met, all branches are done, or
    after ``steps`` fillings beyond the first descent; ``nodes`` bounds the search for the fillings of one container. Both are the
    caller's: larger ones search on, and ``packing_report`` gives the gap that is left."""
    best = best_fit(sizes, capacity)
    bound = least_containers(sizes, capacity)
    stack: list[tuple[list[int], list[list[int]], bool]] = [(list(range(len(sizes))), [], True)]
    budget = steps
    while stack:
        left, boxes, descent = stack.pop()
        if not left:
            if len(boxes) < len(best) or descent and len(boxes) == len(best):
                best = boxes
            if len(best) <= bound:
                break
            continue
        if not descent:
            budget -= 1
            if budget < 0:
                break
        own = [sizes[j] for j in left]
        if not descent and len(boxes) + least_containers(own, capacity) >= len(best):
            continue
        first, rest = left[-1], left[:-1]
        own.pop()
        room = capacity - sizes[first]
        # the first descent is made before any branch; its siblings wait on the stack with their open items
        ways = fillings(own, room, nodes=nodes) if len(best) > bound else [complete(own, room, nodes)]
        for n in range(len(ways) - 1, -1, -1):
            out = set(ways[n])
            stack.append(([j for i, j in enumerate(rest) if i not in out], [*boxes, [first, *(rest[i] for i in sorted(out, reverse=True))]], descent and n == 0))
    return best


def pack(items: list[tuple[object, int]], capacity: int, steps: int = STEPS, nodes: int = NODES) -> list[list[tuple[object, int]]]:
    """Containers of (key, size) items; no size may exceed the capacity, zero sizes go to the first container."""
    zero = [x for x in items if x[1] <= 0]
    order = sorted((x for x in items if x[1] > 0), key=lambda x: (x[1], str(x[0])))
    out = [[order[j] for j in box] for box in bin_completion([x[1] for x in order], capacity, steps, nodes)]
    if zero:
        if not out:
            out.append([])
        out[0].extend(zero)
    return out


def pack_documents(docs: DataFrame, sizes: DataFrame, path: str = VOCABULARY, group_docs: int = GROUP_DOCS, steps: int = STEPS, nodes: int = NODES) -> DataFrame:
    """One row per (size_name, doc_id, part): container_id, tokens, capacity. Every document comes out once per size:
    in one part if it fits, else in full parts and a rest, none of them shared but the rest. Null and empty texts
    have 0 tokens and take no space. ``group_docs``, ``steps`` and ``nodes`` bound the search of a group. A table of sizes with non-positive capacities gives no rows for them."""
    tokens = cut(docs.select("doc_id", token_count(F.col("text"), path).alias("tokens")))
    n = tokens.count()
    groups = max(1, -(-n // group_docs))
    caps = [(r.size_name, int(r.capacity_tokens)) for r in sizes.select("size_name", "capacity_tokens").distinct().collect() if r.capacity_tokens and r.capacity_tokens > 0]
    schema = "size_name string, capacity int, container_id string, doc_id bigint, part int, tokens bigint"

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        g = rows["g"].iloc[0]
        docs_ = sorted(zip(rows["doc_id"].tolist(), rows["tokens"].tolist(), strict=True))
        out = []
        for name, cap in caps:
            rest, box = [], 0
            for d, t in docs_:
                full = 0 if t <= cap else t // cap
                for part in range(full):
                    out.append((name, cap, f"{name}-{g}-{box}", d, part, cap))
                    box += 1
                if t - full * cap > 0 or full == 0:
                    rest.append(((d, full), t - full * cap))
            for filled in pack(rest, cap, steps, nodes):
                out.extend((name, cap, f"{name}-{g}-{box}", d, part, t) for (d, part), t in filled)
                box += 1
        return pd.DataFrame(out, columns=["size_name", "capacity", "container_id", "doc_id", "part", "tokens"])

    # a group is solved as it streams by; the number of tasks is set, for AQE would merge these small partitions
    grouped = tokens.withColumn("g", F.pmod(F.xxhash64("doc_id", F.lit("pack")), F.lit(groups)))
    return grouped.repartition(min(groups, MAX_TASKS), "g").groupBy("g").applyInPandas(solve, schema)


def packing_report(packed: DataFrame) -> DataFrame:
    """Per size: containers, documents, tokens, the tokens' lower bound of containers, the gap to it and the share of unused space."""
    boxes = packed.groupBy("size_name", "capacity", "container_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    agg = boxes.groupBy("size_name", "capacity").agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("pieces"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
    agg = agg.withColumn("lower_bound", F.ceil(F.col("tokens") / F.col("capacity")))
    return agg.withColumn("gap", F.col("containers") - F.col("lower_bound")).withColumn("unused_share", F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity")), 6))
