import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.llm import mixing as m
from orrery.llm import packing as p
from orrery.llm import tokens as t


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_pack_sizes_keeps_to_capacity(sizes):
    where, offset, fill = p.pack_sizes(np.array(sizes, int), 40)
    for c in range(len(fill)):
        at = sorted((o, s) for w, o, s in zip(where, offset, sizes) if w == c)
        assert all(a + s == b for (a, s), (b, _) in itertools.pairwise([*at, (fill[c], 0)])) and at[0][0] == 0 and fill[c] <= 40


def test_each_step_minimises_the_sum_of_squares():
    rng = np.random.default_rng(2)
    packer, levels = p.SumOfSquares(30), np.zeros(31, int)
    for s in rng.integers(1, 31, 500):
        options = {}
        for level in [0, *np.flatnonzero(levels[:30])]:
            if level + s <= 30:
                after = levels.copy()
                after[level] -= level > 0
                after[level + s] += level + s < 30
                options[level] = (after[:30] ** 2).sum()
        _, level = packer.place(int(s))
        assert options[level] == min(options.values())
        levels[level] -= level > 0
        levels[level + s] += level + s < 30
        assert (levels[1:30] == packer.counts[1:30]).all()


@pytest.mark.parametrize("shard", [100_000, 40])
def test_pack_is_whole(spark, shard):
    rng = np.random.default_rng(4)
    sizes = [int(x) for x in np.minimum(rng.lognormal(4, 1.2, 400), 7000)] + [0, None, 2048, 4096, 4097, 2049]
    rows = [(i, s) for i, s in enumerate(sizes)]
    df = spark.createDataFrame([*rows, *rows[:9], (None, 5)], "doc_id long, n_tokens long")
    out = p.pack(df, shard_docs=shard).toPandas()
    per = out.groupby("doc_id").n_tokens.sum()
    assert {i: s or 0 for i, s in rows} == per.to_dict()
    split = out[out.doc_id.isin([i for i, s in rows if (s or 0) <= 2048])]
    assert (split.groupby("doc_id").size() == 1).all()
    placed = out[out.container.notna()].sort_values(["container", "container_offset"])
    for _, g in placed.groupby("container"):
        assert (g.container_offset.to_numpy() == np.r_[0, g.n_tokens.cumsum().to_numpy()[:-1]]).all() and g.n_tokens.sum() <= 2048
    assert set(out[out.part > 0].doc_id) == {i for i, s in rows if (s or 0) > 2048}
    assert p.packing_report(p.pack(df, shard_docs=shard)).head()["fill_rate"] > 0.93
    assert p.pack(df.limit(0)).count() == 0


def test_tokens(spark):
    long = "word " * 120_000
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, long), (5, "x" * 450_000), (1, "Hello")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in t.document_tokens(df).collect()}
    enc = t.encoder(t.VOCABULARY)
    assert (got[1], got[2], got[3]) == (len(enc.encode_ordinary("Hello world")), 0, 0)
    assert abs(got[4] - len(enc.encode_ordinary(long))) <= 5 and got[5] > 0
    assert "".join(t.pieces(long)) == long and max(map(len, t.pieces("y" * 450_000))) <= t.PIECE_CHARS


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefg"), st.integers(0, 60)))
def test_pfair_stays_within_a_block(blocks):
    total = sum(blocks.values())
    got = dict.fromkeys(blocks, 0)
    for i, (s, j, slot) in enumerate(m.pfair(blocks)):
        assert slot == i and j == got[s]
        got[s] += 1
        assert all(abs(got[x] - blocks[x] * (i + 1) / total) < 1 for x in blocks)
    assert got == blocks


def test_mix(spark):
    rng = np.random.default_rng(5)
    docs = [(i, ("Big_A ", "big-a", "BIG_A")[i % 3] if i % 3 else "small", int(rng.integers(1, 900))) for i in range(900)] + [(5000, "unlisted", 10), (5001, None, 10), (5002, "small", 0)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("big_a", 0.3, 4), ("small", 0.65, 3), ("gone", 0.05, 2), ("none", 0.0, 1), (None, 0.5, 1)], "source string, target_share double, max_uses int")
    mixed, report = m.mix(df, targets, block_tokens=2000)
    size = {s: sum(n for _, x, n in docs if x and x.strip().lower().replace("-", "_") == s) for s in ("big_a", "small")}
    total = sum(size.values())
    rep = {r["source"]: r for r in report.collect()}
    assert {s for s, r in rep.items() if r["short"]} == {s for s, w, u in (("big_a", 0.3, 4), ("small", 0.65, 3), ("gone", 0.05, 2)) if w * total > u * size.get(s, 0)}
    out = mixed.toPandas()
    assert abs(out[out.source == "big_a"].n_tokens.sum() - 0.3 * total) < 900
    uses = out.groupby("doc_id").size()
    assert uses.max() <= 4 and out.groupby("doc_id").use.nunique().equals(uses)
    assert sum(r["actual_share"] for r in rep.values()) == pytest.approx(1.0)
    by_slot = out.drop_duplicates("slot").sort_values("slot")
    n = by_slot.source.value_counts()
    run = {s: (by_slot.source == s).cumsum().to_numpy() - n[s] / len(by_slot) * np.arange(1, len(by_slot) + 1) for s in n.index}
    assert max(abs(x).max() for x in run.values()) < 1
    empty, rep0 = m.mix(df.limit(0), targets)
    assert empty.count() == 0 and rep0.count() == 4


def test_rounds_keep_each_source_within_a_block(spark):
    blocks = {"a": 5000, "b": 300, "c": 41, "d": 7, "none": 0}
    got = m.schedule(spark, blocks, round_slots=256).orderBy("slot").toPandas()
    total = sum(blocks.values())
    assert got["slot"].tolist() == list(range(total)) and set(got["source"]) == set(blocks) - {"none"}
    for s, rows in got.groupby("source"):
        assert rows["block"].tolist() == list(range(blocks[s]))  # each block once, in order
        share = blocks[s] / total
        slot, block = rows["slot"].to_numpy(), rows["block"].to_numpy()
        assert np.maximum(share * slot - block, block + 1 - share * (slot + 1)).max() < 2  # half blocks
    assert m.schedule(spark, {}).count() == 0


def test_exact_pieces_have_the_tokens_of_the_whole():
    text = ("word 12a,  b" * 30_000) + "\n\n  x" + "ab1" * 40_000 + "y" * 250_000
    enc = t.encoder(t.VOCABULARY)
    parts = list(t.exact_pieces(text))
    assert "".join(parts) == text and len(parts) > 1
    assert sum(len(enc.encode_ordinary(p)) for p in parts) == len(enc.encode_ordinary(text))
