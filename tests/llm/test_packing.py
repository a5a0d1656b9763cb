import random
from collections import defaultdict
from functools import lru_cache

from folioscope.llm import packing, tokens

from tests.conftest import rows

WINDOWS = "window_id int, label string, capacity_tokens int"


def optimum(sizes, capacity):
    sizes = tuple(sorted(sizes, reverse=True))

    @lru_cache(None)
    def best(left):
        if not left:
            return 0
        first, rest = left[0], left[1:]
        result = [1 + best(rest)]

        def fill(chosen, at, room):
            for i in range(at, len(rest)):
                if rest[i] <= room and i not in chosen:
                    more = (*chosen, i)
                    result.append(1 + best(tuple(x for j, x in enumerate(rest) if j not in more)))
                    fill(more, i + 1, room - rest[i])

        fill((), 0, capacity - first)
        return min(result)

    return best(sizes)


def count(sizes):
    out = defaultdict(int)
    for s in sizes:
        out[s] += 1
    return out


def test_fixed_sets_lose_no_optimal_packing():
    rng = random.Random(5)
    for _ in range(120):
        capacity = rng.choice([10, 17, 30])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        packed = packing.pack(count(sizes), capacity)
        assert sorted(s for c, _ in packed for s in c) == sorted(sizes) and all(sum(c) <= capacity for c, _ in packed)
        rest = [s for c, fixed in packed if not fixed for s in c]
        assert sum(fixed for _, fixed in packed) + optimum(rest, capacity) == optimum(sizes, capacity)


def test_every_document_is_placed_once(spark):
    rng = random.Random(6)
    docs = [(i, rng.choice([0, 5, 40, 99, 100, 101, 250, rng.randint(1, 120)])) for i in range(500)] + [(500, None), (None, 7)]
    sized = spark.createDataFrame(docs + docs[:20], "doc_id long, tokens long").selectExpr("*", "1 as part", "2 as container")
    windows = spark.createDataFrame([(1, "a", 100), (2, "b", 64), (2, "b", 64), (3, None, None), (None, "c", 9), (4, "d", 0)], WINDOWS)
    out = packing.fill_containers(sized, windows, block_items=90).collect()
    for window, capacity in ((1, 100), (2, 64)):
        mine = [r for r in out if r.window_id == window]
        filled, placed = defaultdict(int), defaultdict(list)
        for r in mine:
            filled[r.container] += r.tokens
            placed[r.doc_id].append(r)
        assert max(filled.values()) <= capacity
        for doc, size in docs[:501]:
            parts = sorted(placed[doc], key=lambda r: r.part)
            assert sum(r.tokens for r in parts) == (size or 0) and len(parts) == (1 if (size or 0) <= capacity else -(-size // capacity))
            assert [r.first_token for r in parts] == [sum(q.tokens for q in parts[:i]) for i in range(len(parts))]
        # No packing needs fewer than the volume's containers, or than one per part over half the capacity.
        least = max(-(-sum(filled.values()) // capacity), sum(2 * r.tokens > capacity for r in mine))
        assert sum(1 for c in filled if filled[c]) <= 1.1 * least
    assert {r.window_id for r in out} == {1, 2}
    assert rows(packing.fill_containers(sized.limit(0), windows)) == [] and rows(packing.fill_containers(sized, windows.limit(0))) == []
    report = {r.window_id: r for r in packing.packing_report(packing.fill_containers(sized, windows)).collect()}
    assert report[1].tokens == sum(s or 0 for _, s in docs[:501]) and report[1].containers >= report[1].least_containers


def test_token_counts(spark):
    path = f"{tokens.TOKENIZERS}/{tokens.RANK_FILE}"
    long = "Hello there, world 12. " * 12_000
    assert tokens.token_count(long, path) == len(tokens.encoding(path).encode_ordinary(long))
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "x" * 3000)], "doc_id long, text string")
    got = dict(rows(tokens.with_token_counts(df)))
    assert got[1] == 2 and got[2] == 0 and got[3] == 0 and got[4] > 0
