"""Memory of the reader for Markdown: a batch's structure comes out in pieces, so that its objects never stand together."""

import tracemalloc

import pyarrow as pa

from prosegauge.operators import structure
from prosegauge.plans.audit import audit


def test_memory_does_not_grow_with_a_batch():
    text = "See [here](http://example.com/a) and <a href='b'>there</a>.\n\n" * 50

    def peak(n):
        texts = pa.array([text, None] * n)
        tracemalloc.start()
        sizes = [len(piece) for piece in structure.in_pieces(texts)]
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert sum(sizes) == 2 * n
        return most

    peak(400)
    assert peak(1600) < 1.5 * peak(400)


def test_rows_keep_their_structure(spark):
    # Twice the size of a piece, in one batch; plain and null texts between.
    rows = [(k, None if k % 3 == 0 else "plain" if k % 3 == 1 else "x " * 5000 + f"[here](http://example.com/{k})") for k in range(900)]
    found = audit(spark.createDataFrame(rows, "doc bigint, text string").coalesce(1), only=["link-text"]).collect()
    assert {(r.doc, r.detail) for r in found} == {(k, f'link text "here" describes no destination (http://example.com/{k})') for k in range(2, 900, 3)}
    assert len(found) == 300
