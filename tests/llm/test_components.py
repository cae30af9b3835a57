import random

from sparrowsql.llm.components import components


def brute(rows):
    nodes, groups = {}, {}
    for node, group in rows:
        nodes.setdefault(node, set()).add(group)
        groups.setdefault(group, set()).add(node)
    out, seen = {}, set()
    for node in sorted(nodes):
        if node in seen:
            continue
        todo, whole = [node], {node}
        while todo:
            for g in nodes[todo.pop()]:
                for k in groups[g] - whole:
                    whole.add(k)
                    todo.append(k)
        seen |= whole
        out |= dict.fromkeys(whole, min(whole))
    return out


def test_labels_are_the_least_nodes(spark):
    rng = random.Random(6)
    rows = [(i, i // 2) for i in range(1, 300)] + [(i, (i + 1) // 2) for i in range(100, 200)]  # pairs, and a chain of them
    rows += [(rng.randrange(1000, 1400), 10_000 + rng.randrange(300)) for _ in range(500)]
    rows += [(5_000 + i, 77_777) for i in range(2_000)] * 2  # a large group, and repeated rows
    got = {r.node: r.label for r in components(spark.createDataFrame(rows, "node long, group long")).collect()}
    assert got == brute(rows)
    assert components(spark.createDataFrame([], "node long, group long")).count() == 0
