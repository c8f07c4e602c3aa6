"""Decontamination over many blocks of items: one at a time in a task, repeats searched for once."""

import random

import pytest
from prosegauge.llm import decontamination


def _bench(n, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    return [" ".join(word() for _ in range(rng.randrange(8, 14))) for _ in range(n)]


@pytest.mark.parametrize("held", [1, 2000, 1 << 26])
def test_many_blocks_equal_one(spark, monkeypatch, held):
    items = _bench(60)
    rng = random.Random(2)
    texts = [None, "", "nothing at all"]
    for k in range(80):
        a, b = rng.sample(items, 2)
        texts.append(f"x{k} {a} and {b[:-1]}q then" if k % 3 else f"plain {k}")
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {}
    for size in (10**9, 300):
        monkeypatch.setattr(decontamination, "BLOCK_CHARS", size)
        monkeypatch.setattr(decontamination, "HELD_BYTES", held)
        assert (len(decontamination.blocks(bench)) > 5) == (size == 300)
        got[size] = sorted((r.doc_id, r.item_ids, r.distance) for r in decontamination.match(docs, bench).collect() if r.doc_id > 2)
        assert len(decontamination.keep_clean(docs, bench).collect()) == 3 + sum(k % 3 == 0 for k in range(80))
    assert got[300] == got[10**9]


def test_one_stage_however_many_blocks(spark, monkeypatch, capsys):
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 200)
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    bench = spark.createDataFrame(list(enumerate(_bench(40))), "item_id bigint, text string")
    decontamination.match(docs, bench).explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1


def test_a_worker_holds_one_block_at_a_time(spark, monkeypatch):
    alive, most = set(), []

    class Counted(decontamination.Matcher):
        def __init__(self, *args):
            alive.add(id(self))
            most.append(len(alive))
            super().__init__(*args)

        def __del__(self):
            alive.discard(id(self))

    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 300)
    folders = decontamination.blocks(spark.createDataFrame(list(enumerate(_bench(60))), "item_id bigint, text string"))
    monkeypatch.setattr(decontamination, "Matcher", Counted)
    import pyarrow as pa

    part = pa.record_batch([pa.array([1, 2]), pa.array([_bench(60)[0], None])], names=["doc_id", "text"])
    decontamination._held.clear()
    hits = decontamination.search_parts([part, part], folders, decontamination.SHORTEST)
    assert hits == [[[(0, 0)], []]] * 2
    assert len(most) == len(folders) > 5 and max(most) == 1


def test_repeated_items_fill_a_block_once(spark, monkeypatch):
    item = _bench(1)[0]
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 500)
    rows = [(k % 3, item.upper() if k % 2 else item) for k in range(5000)]
    bench = spark.createDataFrame(rows, "item_id bigint, text string")
    assert len(decontamination.blocks(bench)) == 1
    docs = spark.createDataFrame([(1, f"so {item} it is"), (2, "no")], "doc_id bigint, text string")
    got = {r.doc_id: (r.item_ids, r.n_items, r.distance) for r in decontamination.match(docs, bench).collect()}
    assert got == {1: ([0, 1, 2], 3, 0), 2: ([], 0, None)}
