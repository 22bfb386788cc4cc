"""Bodies of loops against a plain walk of siblings."""

import random

from graphloom.operators import bodies


def walk(rows):
    kids = {}
    for r in rows:
        kids.setdefault(r[1], []).append(r)
    out = []
    for siblings in kids.values():
        done = []
        for r in sorted(siblings, key=lambda r: (r[2], r[0])):
            if r[3] in bodies.SKIPPED:
                continue
            if r[3] != "flowControl" or r[4] not in bodies.LOOPS:
                done.append(r)
                continue
            if r[0] in kids:
                out += [(r[0], c[0], k) for k, c in enumerate(sorted(kids[r[0]], key=lambda c: (c[2], c[0])), 1)]
            else:
                at = len(done)
                while at and done[at - 1][3] not in ("loop", "return", "throw") and not (done[at - 1][3] == "call" and done[at - 1][5]):
                    at -= 1
                out += [(r[0], c[0], k) for k, c in enumerate(done[at:], 1)]
                del done[at:]
            done.append((r[0], r[1], r[2], "loop", None, None))
    return sorted(out)


def test_loop_bodies(spark):
    r = random.Random(8)
    types = ["call", "call", "flowControl", "flowControl", "return", "throw", "log", "dbProcess"]
    rows = [(f"n{i}", f"n{r.randrange(i)}" if i > 9 and r.random() < 0.3 else r.choice(["a", "b", "c"]), i % 7, r.choice(types), r.choice(["for", "while", "if", None]), r.choice([None, None, "f"])) for i in range(200)]
    got = bodies.loop_bodies(spark.createDataFrame(rows, "id string, parent_id string, ord int, type string, kind string, resolved_to string"))
    assert sorted(map(tuple, got.collect())) == walk(rows)
