import numpy as np

from ambulo.llm.substrings import pieces_of


def matched(x, y, k=8):
    places = {tuple(y[j : j + k]): j for j in range(len(y) - k, -1, -1)}
    return np.array([(i, places[g]) for i in range(len(x) - k + 1) if (g := tuple(x[i : i + k])) in places])


def test_a_fuzzy_passage_far_from_an_exact_one_is_found():
    fresh = iter(np.random.default_rng(5).permutation(1 << 16).astype(np.uint16))
    own = lambda n: [next(fresh) for _ in range(n)]
    parts, exact = [own(45) for _ in range(3)], own(100)
    x = np.array([*own(30), *parts[0], *own(7), *parts[1], *own(7), *parts[2], *own(65), *exact, *own(30)])
    y = np.array([*own(20), *parts[0], *own(9), *parts[1], *own(9), *parts[2], *own(65), *exact, *own(10)])
    covered = {w for s, e, *_ in pieces_of(matched(x, y), x, y, 8, 0.8) for w in range(s, e)}
    assert covered == {*range(30, 179), *range(244, 344)}


def test_an_exact_run_inside_one_unlike_segment_is_kept():
    fresh = iter(np.random.default_rng(6).permutation(1 << 16).astype(np.uint16))
    own = lambda n: [next(fresh) for _ in range(n)]
    run, ends = own(55), [own(8) for _ in range(6)]
    def text():
        out = [*own(20), *run]
        for end in ends:
            out += [*own(20), *end]
        return np.array([*out, *own(20)])
    x, y = text(), text()
    found = pieces_of(matched(x, y), x, y, 8, 0.8)
    assert any(s <= 20 and e >= 75 for s, e, *_ in found)
