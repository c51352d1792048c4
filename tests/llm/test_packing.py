import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from eventloom.llm import packing, tokens

STRANGE = ["", "  ", "a<|endoftext|>b c", "don't DON'T it's 12345 ÀÉ́ x y z", "é ́a", "ΣΑΣ ΣΑΣ İstanbul ﬁ 한국어 日本 𝒳 👩‍👩‍👧 ́", "'s 't\t'll <|startoftext|> < |endoftext|>", "\x1c\x1d\x85a\x0bb\x0cc \x00", "ÀÉÎ ŒŁĘ İs ſs ŉ ẞ µ ª ÿŸ ǅ ×÷ 1²½ a\x7fb °C", "L'été D'Artagnan ''s 'S 'RE"]


def test_ids_are_those_of_the_whole_text(texts):
    r, letters = random.Random(1), "ab' \t\ńé<|>endoftextΣ1² \x1c😀İÀŒſŉßẞ×÷°\x7f\x00̇"
    many = [*list(texts.values())[:60], *STRANGE, *("".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(1500))]
    made = tokens.WordTokenizer()
    for text, ids in zip(many, made.ids(many), strict=True):
        assert ids.tolist() == made.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_ids_of_parts_are_those_of_the_whole_text(texts, monkeypatch):
    monkeypatch.setattr(tokens, "PART", 7)
    monkeypatch.setattr(tokens, "MEMO", 20)
    many = [*list(texts.values())[:20], " ".join(STRANGE), "\n".join(STRANGE * 3), "x" * 50, " " * 50, "a " * 9, "abcdefg ", "abcdefg", "", None]
    made = tokens.WordTokenizer()
    for text, ids in zip(many, made.ids(many), strict=True):
        assert ids.tolist() == made.tokenizer.encode(text or "", add_special_tokens=False).ids, text
    assert list(tokens._parts("ab cdefghi jkl m")) == ["ab cdefghi ", "jkl m"]


@pytest.mark.parametrize("lengths", [[4096] * 3, [1] * 5000, [2049] * 7 + [2047] * 7, [1365] * 500, list(range(1, 600)), [3000, 2000, 1096, 1096, 1000]])
def test_plan_packs_the_histogram(lengths):
    histogram = Counter(lengths)
    plan = packing.plan(histogram)
    got = Counter()
    for copies, take in plan.configurations:
        assert copies > 0 and sum(x * n for x, n in take.items()) <= 4096
        for x, n in take.items():
            got[x] += copies * n
    assert got == histogram
    assert plan.sequences <= packing.Plan(packing._best_fit(dict(histogram), 4096)).sequences


def test_plan_is_near_the_bound():
    lengths = np.minimum(4096, np.random.default_rng(1).lognormal(6, 1, 20_000).astype(int) + 1)
    assert packing.plan(Counter(lengths.tolist())).sequences <= -(-int(lengths.sum()) // 4096) + 2


def test_sequences_come_from_the_program(texts):
    made, histogram = tokens.WordTokenizer(), Counter()
    for ids in made.ids(list(texts.values())):
        histogram[4096] += (len(ids) + 1) // 4096 * 40
        histogram[(len(ids) + 1) % 4096] += 40
    del histogram[0]
    plan = packing.plan(histogram)
    need = sum(x * n for x, n in histogram.items()) / 4096
    assert plan.gap < 0.01 and plan.bound <= plan.sequences <= need + 1
    assert plan.rounded > 0.95 * plan.sequences


def test_dual_bound_and_knapsack():
    r = np.random.default_rng(2)
    for _ in range(30):
        lengths = np.sort(r.choice(np.arange(1, 30), r.integers(1, 6), replace=False))
        price, most = r.random(len(lengths)), r.integers(1, 4, len(lengths))
        best = packing._knapsack(price, lengths, most, 30)
        for room in range(31):
            ways = [sum(n * p for n, p in zip(ns, price, strict=True)) for ns in np.ndindex(*(most + 1)) if sum(n * x for n, x in zip(ns, lengths, strict=True)) <= room]
            assert abs(best[room] - max(ways)) < 1e-9
    for lengths in ([2049] * 9, [1365] * 500, [2100] * 5 + [1900] * 5, [4000] * 3 + [90] * 40):
        plan = packing.plan(Counter(lengths))
        assert plan.bound <= plan.sequences + 1e-9


def check(rows, docs, capacity):
    """rows hold every document's ids once each, in gapless sequences."""
    made = tokens.WordTokenizer()
    want = Counter()
    for r in docs:
        ids = np.append(made.ids([r["text"]])[0], np.uint32(1)).astype("<u4")
        for p, i in enumerate(range(0, len(ids), capacity)):
            want[r["doc_id"], p, i, len(ids[i : i + capacity]), crc32(ids[i : i + capacity].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


def test_documents(spark, documents):
    rows = packing.op4_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    n = check(rows, documents.collect(), 4096)
    assert n <= -(-sum(r["length"] for r in rows) // 4096) + 1


def test_odd_rows(odd, empty, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 2)  # many buckets
    check(packing.pack(odd, capacity=256).collect(), odd.collect(), 256)
    assert packing.pack(empty).collect() == []
