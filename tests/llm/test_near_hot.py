"""Near duplicates in large groups, with rows bounded, and under repeated ids."""

import random

import pytest

from tallyforge.llm import near_dedup

from . import plain


def copies(n, seed=5, words=60):
    """Copies of one text with none to many words put in, so that some pairs hold, some nearly do and some don't."""
    r = random.Random(seed)
    base = [f"w{r.randrange(5000)}" for _ in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 2, 3, 4])):
            w[r.randrange(words)] = f"x{i}"
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("block", [2048, 100])
def test_a_hot_group_writes_rows_in_proportion(spark, monkeypatch, block):
    rows = copies(2000 if block == 2048 else 300)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    written = {}

    def counted(df, name, staged=near_dedup.staged):
        out = staged(df, name)
        written[name] = max(written.get(name, 0), out.count())
        return out

    monkeypatch.setattr(near_dedup, "staged", counted)
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = plain.near_all(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    blocks = -(-len(rows) // block)
    groups = written["near-groups"]
    assert written["near-links"] <= groups and written["near-flagged"] <= 2 * blocks * groups and written["near-dealt"] <= 2 * blocks * groups


def test_components_by_steps_and_in_one_task(spark, monkeypatch):
    from tallyforge.llm import components

    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1030)]
    df = spark.createDataFrame(links, "a long, b long")
    one = sorted(map(tuple, components.components(df).collect()))
    monkeypatch.setattr(components, "SMALL_LINKS", 0)
    assert sorted(map(tuple, components.components(df).collect())) == one and (1030, 1000) in one


def test_an_id_has_the_links_of_all_its_texts(spark):
    t, u = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, t), (2, u), (9, t), (9, u), (4, t + " more"), (7, "alone here"), (None, u)]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in got) == [("1", 1), ("2", 1), ("4", 1), ("7", 7), ("9", 1), ("9", 1), ("None", 1)]


def test_recall_by_size_of_set(spark):
    """Of pairs just at the limit nearly all are found, whatever the sets' size."""
    r = random.Random(9)
    for words in (30, 120, 900):
        rows, pairs = [], 0
        for k in range(40):
            base = [f"p{k}w{r.randrange(10**6)}" for _ in range(words)]
            a = {tuple(base[i : i + 5]) for i in range(words - 4)}
            edited, best = list(base), list(base)
            for at in range(0, words, 7):
                edited[at] = f"e{k}x{at}"
                b = {tuple(edited[i : i + 5]) for i in range(words - 4)}
                if 100 * len(a & b) < 75 * len(a | b):
                    break
                best = list(edited)
            rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(best))]
            pairs += 1
        got = {x.doc_id: x.component_id for x in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert sum(got[2 * k + 1] == 2 * k for k in range(40)) >= 0.9 * pairs
