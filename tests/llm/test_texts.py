import random
import re

import numpy as np
import pytest

from strandlake.llm.leaks import ItemIndex, find_leaks
from strandlake.llm.pack import exact_combinations, nnls, pack, plan_containers, token_sizes
from strandlake.llm.split import SplitRule, split_oversized, split_text
from strandlake.llm.tokens import tokenizer

from ..conftest import rows

DOCS = "doc_id long, text string, item_id int, i string, t string"
ITEMS = "item_id long, text string, doc_id string"


def leaks(docs, items, run=20):
    words = lambda t: re.findall("[a-z0-9]+", t.lower()) if t else []
    grams = lambda w: {tuple(w[k : k + run]) for k in range(len(w) - run + 1)}
    of = [(i, grams(words(t))) for i, t, *_ in items if i is not None]
    return sorted({(d, i) for d, t, *_ in docs for i, g in of if g & grams(words(t))}, key=repr)


@pytest.mark.parametrize("passes", [2048, 3])
def test_leaks_match_brute_force(spark, passes):
    r = random.Random(8)
    bag = [f"w{i}" for i in range(60)] + ["the", "of"]
    text = lambda n: " ".join(r.choice(bag) for _ in range(n))
    items = [(i, text(r.choice([19, 20, 25, 80])), "x") for i in range(12)] + [(50, None, ""), (None, text(30), ""), (51, "the " * 40, ""), (52, "", "")]
    shared = items[3][1]
    items.append((60, text(10) + " " + shared, "x"))
    docs = [(i, text(r.randrange(0, 300)), 1, "q", "q") for i in range(40)]
    for i in range(60):
        src = r.choice([x[1] for x in items if x[1] and len(x[1].split()) >= 20]).split()
        n = r.choice([18, 19, 20, 21, 40])
        k = r.randrange(0, max(1, len(src) - n))
        piece = r.choice([" ", "-\n", "... "]).join(w.upper() for w in src[k : k + n])
        docs.append((100 + i, text(r.randrange(70)) + "\n+" + piece + "; " + text(r.randrange(70)), 1, "q", "q"))
    docs += [(200, None, 1, "", ""), (201, "", 1, "", ""), (None, shared, 1, "", ""), (202, "the " * 20, 1, "", ""), (202, "the " * 20, 1, "", "")]
    got = find_leaks(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), pass_items=passes)
    assert rows(got) == leaks(docs, items)


def test_leaks_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a " * 50, 1, "", "")], DOCS), spark.createDataFrame([(1, "a " * 50, "")], ITEMS)
    assert rows(find_leaks(docs, items)) == [(1, 1)]
    assert rows(find_leaks(docs.limit(0), items)) == rows(find_leaks(docs, items.limit(0))) == []


def test_threshold_is_reached_by_every_run():
    r = random.Random(2)
    items = [(i, " ".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60))) for i in range(40)]
    index = ItemIndex(items)
    for i, t in items:
        w = t.split()
        for k in range(41):
            assert (0, i) in index.search(["zz " * r.randrange(40) + " ".join(w[k : k + 20])])


def pieces_hold(text, pieces, rule):
    data, done, end = text.encode(), b"", 0
    for k, (a, b, x, y, t) in enumerate(pieces):
        assert data[x:y].decode() == t and b - a <= rule.limit
        if k:
            assert rule.overlap <= end - a <= rule.overlap + 3
        done, end = done + data[len(done) : y], b
    assert done == data


RULE = SplitRule(limit=200, overlap=20, least=60, spacing=32, reach=16)


def test_pieces_rebuild_any_text():
    r, tok = random.Random(5), tokenizer()
    commits = "".join(f"diff --git a/f{i} b/f{i}\n@@ -1 +1 @@\n" + "".join(f"+line {r.random()}\n" for _ in range(r.randrange(30))) for i in range(20))
    for text in (commits, "x" * 5000, "é" * 3000, "日本語😀" * 800, "\n" * 3000, " ".join(str(r.random()) for _ in range(500)), "a b" * 1000):
        pieces = split_text(text, RULE, tok)
        assert len(pieces) > 1
        pieces_hold(text, pieces, RULE)
    assert len(split_text("short", RULE, tok)) == 1


def test_edits_alter_neighbours_only():
    r, tok = random.Random(6), tokenizer()
    lines = [f"value_{r.randrange(10**6)} = {r.random()}\n" for _ in range(1500)]
    before = [p[4] for p in split_text("".join(lines), RULE, tok)]
    lines[700] = "changed completely()\n\n"
    after = [p[4] for p in split_text("".join(lines), RULE, tok)]
    assert len(set(after) - set(before)) <= 6 and len(after) > 30


def test_split_defined_cases(spark):
    long_text = "word " * 6000
    df = spark.createDataFrame([(1, long_text, 0, "", ""), (1, long_text, 0, "", ""), (2, None, 0, "", ""), (3, "", 0, "", ""), (4, "a" * 4096, 0, "", ""), (None, long_text, 0, "", "")], DOCS)
    got = split_oversized(df, "doc_id", "text").collect()
    assert {g.id for g in got} == {1, None} and len(got) % 3 == 0
    assert all(g.token_to - g.token_from <= 4096 for g in got)
    assert split_oversized(df.limit(0), "doc_id", "text").collect() == []
    with pytest.raises(ValueError):
        SplitRule(limit=100, overlap=100)


def containers_hold(items, got, capacity):
    room, parts = {}, {}
    for r in got:
        if r.part_tokens:
            room.setdefault(r.container_id, []).append((r.place_from, r.place_from + r.part_tokens))
        parts.setdefault(r.id, []).append((r.token_from, r.part_tokens))
    for v in room.values():
        v.sort()
        assert v[-1][1] <= capacity and all(a[1] <= b[0] for a, b in zip(v, v[1:], strict=False))
    for i, n in items:
        own = sorted(parts[i])
        assert sum(p[1] for p in own) == (n or 0) and len(own) == max(1, -(-(n or 0) // capacity))
    return len(room)


def test_packing(spark):
    r = random.Random(7)
    items = [(i, r.choice([1, 7, 50, 63, 64, 65, 100, 500, 1024, 2047, 2048, 2049, 5000, r.randrange(3000)])) for i in range(3000)] + [(9000, 0), (9001, None), (9002, 700)]
    df = spark.createDataFrame([(i, n, 1) for i, n in items], "id long, n_tokens long, part int").repartition(5)
    got = pack(df, bucket_rows=100).collect()
    used, least = containers_hold(items, got, 2048), -(-sum(n or 0 for _, n in items) // 2048)
    assert used <= least * 1.02
    assert rows(pack(df.repartition(2), bucket_rows=100)) == sorted((tuple(g) for g in got), key=repr)
    same = [(i, 900) for i in range(500)]
    assert containers_hold(same, pack(spark.createDataFrame(same, "id long, n_tokens long")).collect(), 2048) == 250
    assert pack(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([(1, -1)], "id long, n_tokens long"))


def test_plan_uses_every_item_once():
    r = np.random.default_rng(1)
    for _ in range(20):
        counts = r.integers(0, 50, 65) * (r.random(65) < 0.4)
        plan, used = plan_containers(counts, 64), np.zeros(65, int)
        for combo, n in plan:
            assert sum(combo) <= 64 and n > 0
            for x in combo:
                used[x] += n
        assert (used[1:] == counts[1:]).all()


def test_least_squares_finds_an_exact_fit():
    parts = exact_combinations(np.array([2, 3, 4, 5, 6, 10]), 10)
    assert {tuple(sorted(p[p > 0])) for p in parts} == {(10,), (4, 6), (5, 5), (2, 2, 6), (2, 3, 5), (2, 4, 4), (3, 3, 4)}
    counts = np.zeros(11)
    counts[[4, 6, 10]] = 30, 30, 5
    x = nnls(parts, counts, 2000)
    assert (x >= 0).all() and abs(np.bincount(parts.ravel(), np.repeat(x, 3), minlength=11)[1:] - counts[1:]).max() < 0.1


def test_token_sizes(spark):
    df = spark.createDataFrame([(1, "hello world", 0, "", ""), (2, None, 0, "", ""), (3, "", 0, "", ""), (4, "<|endoftext|>", 0, "", "")], DOCS)
    assert {r.id: r.n_tokens for r in token_sizes(df, "doc_id", "text").collect()} == {1: 2, 2: 0, 3: 0, 4: 7}


def test_text_slices_cover_every_row():
    import pyarrow as pa

    from strandlake.llm.tokens import text_slices

    texts = pa.array(["a" * 10, None, "", "b" * 100, "c" * 3, "d" * 3, "e" * 4])
    assert list(text_slices(texts, 10)) == [(0, 3), (3, 4), (4, 7)]
    assert list(text_slices(texts.slice(3), 1000)) == [(0, 4)] and list(text_slices(texts.slice(0, 0), 10)) == []


def test_pieces_end_at_natural_boundaries_and_fit_on_their_own():
    r, tok = random.Random(12), tokenizer()
    long_lines = "".join("x=" + ";".join(str(r.random()) for _ in range(r.choice([3, 12]))) + "\n" for _ in range(300))
    pieces = split_text(long_lines, RULE, tok)
    assert all(p[4].endswith("\n") for p in pieces)
    for text in (long_lines, "".join(r.choice("ab \n'.é😀1") for _ in range(9000)), "🏳️‍🌈" * 900):
        pieces = split_text(text, RULE, tok)
        pieces_hold(text, pieces, RULE)
        assert max(tok.count(p[4]) for p in pieces) <= RULE.limit
