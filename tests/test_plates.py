"""Plate texts against plain loops."""

import itertools
from collections import defaultdict

import numpy as np

from roadlens.operators import plates


def pruned(places, n):
    """Depth of each place: widened where the next letter loses least, until the product is n."""
    depth, product = dict.fromkeys(places, 1), 1
    while product < n:
        drops = [(v[depth[p] - 1][1] - v[depth[p]][1], p) for p, v in places.items() if depth[p] < len(v)]
        if not drops:
            break
        p = min(drops)[1]
        depth[p] += 1
        product = int(np.prod(list(depth.values())))
    return {p: places[p][: depth[p]] for p in places}


def texts(places, max_subs):
    last, out = max(places), []
    for choice in itertools.product(*(enumerate(places[p]) for p in sorted(places))):
        subs = 0
        for p, (k, (letter, total)) in zip(sorted(places), choice, strict=True):
            subs += k > 0 and total * 10 < places[p][0][1] * 9 and letter != "~" and p != last
        if subs <= max_subs:
            out.append(("".join(x.replace("~", "*") for _, (x, _) in choice), sum(t for _, (_, t) in choice)))
    return sorted(out)


def test_pruning_and_texts_against_loops(spark):
    rng = np.random.default_rng(4)
    rows = [(plate, pos, letter, int(rng.integers(0, 12))) for plate in range(60) for pos in range(plate % 8) if rng.random() < 0.9 for letter in "ABCDE~"[: rng.integers(1, 7)]]
    votes = spark.createDataFrame(rows, "plate_id long, pos long, letter string, total long")
    by = defaultdict(lambda: defaultdict(list))
    for plate, pos, letter, total in rows:
        by[plate][pos].append((letter, total))
    for places in by.values():
        for v in places.values():
            v.sort(key=lambda x: (-x[1], x[0]))
    for n in (1, 7, 25, 10**6):
        got = sorted(tuple(r) for r in plates.prune_letters(votes, n).select("plate_id", "pos", "letter", "total").collect())
        kept = {plate: pruned(places, n) for plate, places in by.items()}
        assert got == sorted((plate, pos, *x) for plate, v in kept.items() for pos, letters in v.items() for x in letters)
        if n == 25:
            found = defaultdict(list)
            for r in plates.n_best(plates.places(plates.prune_letters(votes, n)), 1).collect():
                found[r["plate_id"]].append((r["text"], r["total"]))
            assert {k: sorted(v) for k, v in found.items()} == {plate: texts(v, 1) for plate, v in kept.items()}
    assert plates.prune_letters(votes.limit(0), 5).count() == 0
